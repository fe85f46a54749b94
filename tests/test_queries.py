"""Every registered query against its SQL."""
import pytest
from compare import compare

import workload

workload.load_all()


@pytest.mark.parametrize("name", sorted(workload.SQL))
def test_equals_sql(spark, con, sf_dir, name):
    assert compare(spark, con, workload.QUERIES[name], workload.SQL[name], sf_dir) is None


@pytest.mark.parametrize("name", sorted(set(workload.QUERIES) - set(workload.SQL)))
def test_gives_rows(spark, sf_dir, name):
    assert workload.QUERIES[name](spark, sf_dir).limit(1).count() == 1
