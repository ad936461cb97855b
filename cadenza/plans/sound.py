"""Queries of sound: the embeddings of a label, one after another, are a file of samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.plans.registry import query
from cadenza.plans.views import table
from cadenza.sources.shared import kept, shared_path
from cadenza.sources.sound import read_sound, write_sound

WINDOW, HOP, RATE = 64, 16, 8000.0


def frames(spark, sf_dir, measure: str, **options):
    """Windows of the sound of every label, read from its file by stretches."""
    path = shared_path(spark, "sound")
    kept(write_sound(table(spark, sf_dir, "embeddings"), "label", ["vec_id"], "embedding", path), "sound-files").count()
    d = read_sound(spark, path, measure=measure, window=WINDOW, hop=HOP, rate=RATE, stretch=4 * HOP * 1024, **options)
    return d.withColumn("song_id", F.regexp_extract("path", r"([^/]+)\.f32$", 1).cast("int"))


SAMPLES = f"""samples AS (SELECT label AS song_id, row_number() OVER (PARTITION BY label ORDER BY vec_id, i) - 1 AS n, x FROM (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE label IS NOT NULL) WHERE x IS NOT NULL),
windows AS (SELECT song_id, n // {HOP} - k AS frame, x FROM samples, range({WINDOW // HOP}) r(k) WHERE n // {HOP} >= k),
last AS (SELECT song_id, (count(*) - {WINDOW}) // {HOP} AS last FROM samples GROUP BY 1)"""


@query(f"WITH {SAMPLES} SELECT song_id, frame, frame * {HOP} / {RATE:.0f}::DOUBLE AS t, round(CAST(sqrt(sum(x * x) / {WINDOW}) AS FLOAT)::DOUBLE, 4) AS loudness FROM windows JOIN last USING (song_id) WHERE frame <= last GROUP BY 1, 2")
def sound_loudness(spark, sf_dir):
    """The loudness of every window of every file of sound."""
    d = frames(spark, sf_dir, "loudness")
    return d.select("song_id", "frame", "t", F.round(F.get("measured", F.lit(0)).cast("double"), 4).alias("loudness"))
