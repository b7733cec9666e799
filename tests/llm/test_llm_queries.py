"""The package's queries against their SQL, or that they run, on the smallest tables."""

import pytest
from compare import compare, duck

from lexmill.llm import registry, search_queries

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert compare(QUERIES[name](spark, FOLDER), con, ORACLES[name]) == ""


def test_all_are_registered():
    assert sorted({int(n[2:].split("_")[0]) for n in QUERIES}) == list(range(1, 14))


def test_shards_match_sql(spark, con):
    """The SQL engine has no crc32; everything else is compared."""
    found = QUERIES["op2_sharding"](spark, FOLDER).drop("text_crc32")
    sql = f"SELECT doc_id, size, law, shard, grown_shard, slot FROM ({search_queries.OP2_SQL})"
    assert compare(found, con, sql) == ""

