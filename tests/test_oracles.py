"""Queries held against their SQL on tables that tell the rules apart: copies of few rows, and columns that hardly tell the class."""

from collections import Counter

import duckdb
import pytest

from marlstone.plans import registry


def _same(spark, folder, name):
    db = duckdb.connect()
    for path in folder.glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found, wanted = registry.queries()[name](spark, str(folder)), db.execute(registry.oracle_sql()[name])
    assert found.columns == [c[0] for c in wanted.description]
    got = [tuple(r) for r in found.collect()]
    assert Counter(got) == Counter(wanted.fetchall())
    return got


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """Sixty copies of 40 customers under keys of their own: the five smallest hashes are those of one row's copies."""
    folder = tmp_path_factory.mktemp("copies")
    segments = "(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'])[1 + i % 5]"
    duckdb.sql(f"COPY (SELECT c * 40 + i AS c_custkey, {segments} AS c_mktsegment, (i * 137 % 1000)::DOUBLE + 0.25 AS c_acctbal FROM range(60) a(c), range(40) b(i)) TO '{folder}/customer.parquet'")
    return folder


@pytest.mark.parametrize("name", ["kmeans_fit", "kmeans_sparse"])
def test_kmeans_of_copies(spark, copies, name):
    found = _same(spark, copies, name)
    assert {r[0] for r in found} == set(range(5)) and sum(r[4] for r in found if r[1] == "c_acctbal") == 2400


@pytest.mark.parametrize("signals", [0, 2, 5])
def test_mined_classifier_of_few_rules(spark, tmp_path, signals):
    """All classes are equally frequent for every priority but the first few; fewer rules than wanted are found where these are fewer."""
    status = f"CASE WHEN p < {signals} AND r % 9 = 0 THEN 'F' ELSE (['F', 'O', 'P'])[1 + r % 3] END"
    status = f"CASE WHEN p < {signals} AND r % 9 = 1 THEN 'F' ELSE {status} END"
    duckdb.sql(f"COPY (SELECT p * 3 * 1800 + s * 1800 + r AS o_orderkey, (s % 5)::BIGINT AS o_custkey, {status} AS o_orderstatus, 'P' || p AS o_orderpriority, 5000.0 AS o_totalprice FROM range(5) a(p), range(5) b(s), range(1800) c(r)) TO '{tmp_path}/orders.parquet'")
    duckdb.sql(f"COPY (SELECT i AS c_custkey, 'S' || i AS c_mktsegment, 0.0 AS c_acctbal FROM range(5) t(i)) TO '{tmp_path}/customer.parquet'")
    found = _same(spark, tmp_path, "mined_classifier")
    assert sorted(r[0] for r in found) == list(range(len(found))) and (signals != 0 or len(found) == 1)
