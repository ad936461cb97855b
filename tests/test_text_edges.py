"""Values at the edges of the text queries: a score of zero, days of far years, a negative zero."""

from tests_common import rows_of

import __spark_entry__ as entry


def same_as_sql(spark, name, folder, tables):
    import duckdb

    c = duckdb.connect()
    for table, sql in tables.items():
        c.execute(f"COPY ({sql}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    assert rows_of(entry.queries()[name](spark, str(folder))) == rows_of(c.execute(entry.oracle_sql()[name]))


def test_play_labels_of_scores_that_are_zero_or_null(spark, tmp_path):
    events = "SELECT i AS event_id, i AS user_id, 'view' AS event_type, v::DOUBLE AS value, TIMESTAMP '2024-01-10 12:00:00' AS ts, '{}' AS props FROM (VALUES (1, 0), (2, NULL), (3, 0.4), (4, 59.6), (5, 6000.2), (6, -3)) t(i, v)"
    same_as_sql(spark, "play_labels", tmp_path, {"events": events})


def test_falsy_columns_of_far_days_and_a_negative_zero(spark, tmp_path):
    keys = (0, 1, 2932896, 2932897, 60_000_000, 100_000_000, -1, -719528, -719529, -1_000_000)
    customer = "SELECT k::BIGINT AS c_custkey, b::DOUBLE AS c_acctbal FROM (VALUES " + ", ".join(f"({k}, {b})" for k, b in zip(keys, ("0", "'-0'", "-1.5", "NULL", "7", "8", "9", "10", "11", "0.25"))) + ") t(k, b)"
    same_as_sql(spark, "falsy_columns", tmp_path, {"customer": customer})
