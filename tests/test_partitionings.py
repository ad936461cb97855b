"""Joins on intervals give the same rows however their shuffles are partitioned and coalesced."""

import os

import pytest

from cadenza.operators import joins as J
from cadenza.plans import registry
from tests_common import duckdb_of, rows_of

SF = "/root/testdata/sf0.01"
NAMES = "active_note bars_without_shot confirmed_bars frame_credits note_results session_scores section_stamps".split()


def session(spark, partitions, advisory):
    s = spark.newSession()
    s.conf.set("spark.sql.session.timeZone", "UTC")
    s.conf.set("spark.sql.shuffle.partitions", str(partitions))
    if advisory:
        s.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", advisory)
        s.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
        s.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    return s


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_any_partitioning(spark, name):
    want = rows_of(duckdb_of(SF).execute(registry.ORACLES[name]))
    for partitions, advisory in ((4, None), (64, None), (200, "65536")):
        assert rows_of(registry.QUERIES[name](session(spark, partitions, advisory), SF)) == want, (partitions, advisory)


def test_repeated_rows_stay_repeated(spark):
    points = spark.createDataFrame([("a", 1.0, 1), ("a", 1.0, 1), ("a", 9.0, 1), (None, 1.0, 1), ("a", None, 1)], "k string, t double, x int")
    spans = spark.createDataFrame([("a", 0.0, 2.0, "p"), ("a", 0.5, 3.0, "q"), ("a", 0.5, 2.0, "r")], "k string, a double, b double, name string")
    got = sorted((str(r.k), str(r.t), str(r.name)) for r in J.stab(points, spans, ["k"], "t", ("a", "b"), ["name"], 1.0).collect())
    assert got == [("None", "1.0", "None"), ("a", "1.0", "r"), ("a", "1.0", "r"), ("a", "9.0", "None"), ("a", "None", "None")]
    left = points.select("k", "t", (points.t + 1).alias("u"), "x")
    args = (left, spans, ["k"], ("t", "u"), ("a", "b"), 1.0)
    assert J.interval_pairs(*args, "left_semi").count() == 2 and J.interval_pairs(*args, "left_anti").count() == 3
    assert J.interval_pairs(*args, "left_semi", None, ["t"]).count() == 1
