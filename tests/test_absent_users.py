"""Boards when singers have no user row."""

import os

import pytest
from tests_common import duckdb_of, rows_of

from cadenza.plans import registry


@pytest.mark.parametrize("name", ["recent_feed", "songs_with_top_singer", "song_list_for_users"])
def test_absent_users(spark, tmp_path, name):
    folder = "/root/testdata/sf0.001"
    for f in os.listdir(folder):
        os.symlink(f"{folder}/{f}", tmp_path / f) if f != "customer.parquet" else None
    last = [r.user_id for r in registry.QUERIES["recent_feed"](spark, folder).collect()]
    best = [r.user_id for r in registry.QUERIES["songs_with_top_singer"](spark, folder).collect()]
    gone = {*last[:7], *best} - {None}
    c = spark.read.parquet(f"{folder}/customer.parquet")
    c.where(~c.c_custkey.isin(list(gone))).coalesce(1).write.parquet(f"{tmp_path}/users")
    (part,) = [f for f in os.listdir(tmp_path / "users") if f.endswith(".parquet")]
    os.symlink(tmp_path / "users" / part, tmp_path / "customer.parquet")
    assert rows_of(registry.QUERIES[name](spark, str(tmp_path))) == rows_of(duckdb_of(str(tmp_path)).execute(registry.ORACLES[name]))
    if name == "recent_feed":
        assert registry.QUERIES[name](spark, str(tmp_path)).count() == 20
