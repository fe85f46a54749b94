"""Check documents: schema validation and the data-quality scan over one walk."""
from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import quality as Q
from ..operators import validate as V
from ..operators.nodes import nodes


@dataclass(frozen=True)
class Check:
    verdicts: DataFrame
    errors: DataFrame
    findings: DataFrame
    summary: DataFrame


def check(docs: DataFrame, schema: Mapping, checks: Mapping[str, Mapping] | None = None) -> Check:
    """``docs`` has ``doc_id`` and a VARIANT ``doc``; malformed schemas raise at once."""
    tree = nodes(docs)
    errors = V.validate(tree, schema)
    findings = Q.dq_scan(tree, checks)
    return Check(V.validity(docs, errors), errors, findings, Q.order_summary(Q.dq_summary(findings, checks)))
