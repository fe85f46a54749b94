"""Conversion with levels against a row-by-row walk of the same rules."""
import json
import random

from pyspark.sql import functions as F

from sheetloom.plans.convert import Level, SheetSpec, convert

C = F.col
NUMBER = {0: "{}. x{}", 1: "{}. y{}", 2: "{}) z{}"}
TRIGGERS = ("T1", "T2")
PLACE = ("-", "–", "—", "N/A", "n/a", "null", "NULL")


def spec():
    return SheetSpec(boundary=C("c0").isNotNull(), header={"no": C("c0"), "status": C("c1")}, lists={"notes": C("c6")}, levels=[
        Level("risks", key=C("c2"), key_name="risk", first={"label": C("c1")}),
        Level("authorities", key=C("c3"), keyed=True, triggers=TRIGGERS, free=C("c2").isNotNull(), key_name="authority",
              first={"term": C("c5")}, distinct={"sizes": C("c5")}, lists={"raw": C("c5")}, trees={"items": C("c4")})])


def grid_rows(seed=3, tables=3, n=160):
    rnd = random.Random(seed)
    rows = []
    for t in range(tables):
        for i in range(1, n + 1):
            c0 = str(i) if rnd.random() < 0.12 or i == 3 else None
            k = rnd.choice([-1, 0, 1, 2])
            item = "plain {}".format(i) if k == -1 else NUMBER[k].format(rnd.randint(1, 9) if k != 1 else "abc"[rnd.randint(0, 2)], i)
            cells = [c0, rnd.choice([None, None, "open", "shut"]), rnd.choice([None] * 4 + ["L", "M", "H"]),
                     rnd.choice([None] * 3 + ["T1", "T2", "Other"]), rnd.choice([item, item, None]),
                     rnd.choice([None, "-", "s", "m", "l"]), rnd.choice([None] * 5 + ["note"])]
            if rnd.random() < 0.05:
                cells = [None] * 7
            rows.append((f"t{t}", i, *cells))
    return rows


def level(text):
    for k, pat in ((0, r"^\d+\."), (1, r"^[a-z]\."), (2, r"^\d+\)")):
        import re
        if re.match(pat, text):
            return k
    return -1


def tree(items):
    """Numbered items nested; an item without a number goes under the deepest open item."""
    roots, slots = [], {}
    for text in items:
        node, k = {"text": text}, level(text)
        if k == -1:
            parent = slots[max(slots)] if slots else None
        else:
            above = [j for j in slots if j < k]
            parent = slots[max(above)] if above else None
            slots = {j: p for j, p in slots.items() if j < k} | {k: node}
        (parent.setdefault("sub", []) if parent is not None else roots).append(node)
    return roots or None


def walk(rows):
    """Documents by reading each table's rows in order, as the rules say."""
    docs = {}
    for t in sorted({r[0] for r in rows}):
        entry = risk = None
        last_risk_key = current_auth = None
        for _, i, *c in sorted(r for r in rows if r[0] == t):
            if all(x is None for x in c):
                continue
            opens = c[0] is not None
            if opens:
                entry = docs[(t, len([k for k in docs if k[0] == t]) + 1)] = {"no": c[0], "status": None, "notes": [], "risks": []}
            if entry is None:
                continue
            if c[1] is not None and entry["status"] is None:
                entry["status"] = c[1]
            if c[6] is not None:
                entry["notes"].append(c[6])
            if opens or (c[2] is not None and c[2] != last_risk_key):
                risk = {"risk": c[2], "label": None, "authorities": {}, "order": []}
                entry["risks"].append(risk)
                last_risk_key, current_auth = c[2], None
                auth_reset = True
            else:
                auth_reset = False
            if c[2] is not None:
                last_risk_key = c[2]
            if c[1] is not None and risk["label"] is None:
                risk["label"] = c[1]
            if auth_reset:
                current_auth = None
            if c[3] is not None and (c[3] in TRIGGERS or c[2] is not None):
                current_auth = c[3]
            if current_auth is not None:
                a = risk["authorities"].get(current_auth)
                if a is None:
                    a = risk["authorities"][current_auth] = {"authority": current_auth, "term": None, "sizes": [], "raw": [], "items": []}
                    risk["order"].append(current_auth)
                v = c[5]
                if v is not None and a["term"] is None:
                    a["term"] = v
                if v is not None and v not in PLACE:
                    a["raw"].append(v)
                    if v not in a["sizes"]:
                        a["sizes"].append(v)
                if c[4] is not None:
                    a["items"].append(c[4])
    out = {}
    for key, e in docs.items():
        risks = [{"risk": r["risk"], "label": r["label"],
                  "authorities": [{**r["authorities"][k], "items": tree(r["authorities"][k]["items"])} for k in r["order"]]}
                 for r in e["risks"]]
        out[key] = {"no": e["no"], "status": e["status"], "notes": e["notes"], "risks": risks}
    return out


def got(df):
    out = {}
    for r in df.select("table_id", "entry_id", F.to_json(F.struct("no", "status", "notes", "risks")).alias("j")).collect():
        d = json.loads(r.j)
        d.setdefault("status", None)
        for risk in d["risks"]:
            risk.setdefault("risk", None)
            risk.setdefault("label", None)
            for a in risk["authorities"]:
                a.setdefault("term", None)
                a["items"] = a["items"] if "items" in a else None
        out[(r.table_id, r.entry_id)] = d
    return out


def norm(tree_):
    if isinstance(tree_, list):
        return [norm(x) for x in tree_]
    if isinstance(tree_, dict):
        return {k: norm(v) for k, v in sorted(tree_.items())}
    return tree_


def test_levels_equal_the_walk(spark):
    rows = grid_rows()
    grid = spark.createDataFrame(rows, "table_id string, row_idx bigint, c0 string, c1 string, c2 string, c3 string, c4 string, c5 string, c6 string")
    result = convert(grid, spec())
    assert result.columns == ["table_id", "entry_id", "part", "no", "status", "notes", "risks"]
    assert norm(got(result)) == norm(walk(rows))


def test_levels_edges(spark):
    schema = "table_id string, row_idx bigint, c0 string, c1 string, c2 string, c3 string, c4 string, c5 string, c6 string"
    assert convert(spark.createDataFrame([], schema), spec()).count() == 0
    # rows before the first boundary belong to no entry; an entry without keys has one risk group of null key and no authorities
    rows = [("a", 1, None, "x", "L", "T1", "1. q", "s", None), ("a", 2, "7", None, None, None, None, None, None),
            ("a", 3, None, None, None, "Other", "a. r", "-", None)]
    grid = spark.createDataFrame(rows, schema)
    assert norm(got(convert(grid, spec()))) == norm(walk(rows))


def test_lineage_edges(spark):
    import pytest

    from sheetloom.plans.convert import lineage
    schema = "table_id string, row_idx bigint, c0 string, c1 string, c2 string, c3 string, c4 string, c5 string, c6 string"
    assert lineage(spark.createDataFrame([], schema), spec()).count() == 0
    rows = [("a", 1, None, "x", "L", "T1", "1. q", "s", None), ("a", 2, "7", "open", "L", "T1", None, "-", None),
            ("a", 3, None, "shut", "L", "Other", "a. r", "m", "n")]
    got_ = {(r.row_idx, r.col_idx) for r in lineage(spark.createDataFrame(rows, schema), spec()).collect()}
    # row 1 is before the entry and the status of row 3 is hidden by the first one; "Other" switches as c2 is
    # filled there; the placeholder of row 2 is the first value of its group, so it is held as such
    assert got_ == {(2, 0), (2, 1), (2, 2), (2, 3), (2, 5), (3, 2), (3, 3), (3, 4), (3, 5), (3, 6)}
    with pytest.raises(ValueError):
        lineage(spark.createDataFrame(rows, schema), SheetSpec(boundary=C("c0").isNotNull(), header={"no": F.upper("c0")}, lists={},
                                                               levels=[Level("x", key=C("c2"))]))
