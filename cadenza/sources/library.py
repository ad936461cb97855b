"""A library of song maps kept up to date: of the documents under a folder only those that changed are read.

Two tables in versions: maps, a row for each document that could be parsed, and quarantine, one for each that couldn't. Either
row says which state of the file it was made from (path, modification time, length), so together they are the manifest that
a scan is held against. The listing and the comparison are Spark jobs; the driver sees the paths of changed files only.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from cadenza.sources.documents import SONG_MAP, unescaped
from cadenza.sources.shared import kept
from cadenza.sources.versions import Versions

STATE = "path string, modified timestamp, length long"
FIELDS = [f.split(" ", 1) for f in re.split(r",\s+", SONG_MAP)]  # within a type commas have no space
MAPS = f"song_id string, {STATE}, map struct<{','.join(map(':'.join, FIELDS))}>"
QUARANTINE = f"{STATE}, reason string, content string"
#: Paths read by one job.
AT_ONCE = 10_000
#: A row of this length says that its file has gone.
GONE = -1


def listed(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """path, modified, length of the files under a folder, and name, by which Spark opens them; nothing of them is read."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return d.select(F.col("_metadata.file_path").alias("path"), F.col("modificationTime").alias("modified"), "length", F.col("path").alias("name"))


def _parsed(spark: SparkSession, names: list[str]) -> DataFrame:
    plain = [re.sub(r"([\[\]{}*?\\])", r"\\\1", n) for n in names]
    d = spark.read.schema(SONG_MAP + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(plain, multiLine=True)
    song = F.regexp_extract(unescaped(F.col("_metadata.file_name")), r"(?:song_map_)?([^/]+?)\.json$", 1)
    m = F.col("_metadata")
    return d.select(song.alias("song_id"), m["file_path"].alias("path"), m["file_modification_time"].alias("modified"), m["file_size"].alias("length"), F.struct(*[name for name, _ in FIELDS]).alias("map"), F.col("_bad").alias("content"))


def _newer(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with the rows of new in place of those of their paths; those that have gone aren't there any more."""
    return old.join(new.select("path"), "path", "left_anti").select(*old.columns).unionByName(new.where(F.col("length") != GONE))


def refresh(spark: SparkSession, path: str, maps: Versions, quarantine: Versions) -> dict[str, int]:
    """Brings both tables (of MAPS and QUARANTINE) up to date with the files under a folder; how many were parsed, set aside
    and found to be gone. A file that is neither new nor changed isn't opened; one that can't be parsed is in
    quarantine, with its content, until it changes; an empty one counts as none; a run that breaks off leaves both tables as they were, or the one
    that it has committed up to date, and the next run does the rest."""
    now = listed(spark, path)
    known = maps.read().select("path", "modified", "length").unionByName(quarantine.read().select("path", "modified", "length"))
    names = [r.name for r in now.join(known, ["path", "modified", "length"], "left_anti").select("name").collect()]
    gone = known.select("path").distinct().join(now, "path", "left_anti")
    gone = gone.select("path", F.lit(None).cast("timestamp").alias("modified"), F.lit(GONE).cast("long").alias("length"))
    good, bad = gone.withColumns({"song_id": F.lit(None).cast("string"), "map": F.lit(None).cast(maps.schema["map"].dataType)}), gone.withColumns({"reason": F.lit(None).cast("string"), "content": F.lit(None).cast("string")})
    n_good = n_bad = 0
    for a in range(0, len(names), AT_ONCE):
        some = names[a : a + AT_ONCE]
        d = kept(_parsed(spark, some), "parsed")  # each file is opened once
        read = d.where("content IS NULL").select("song_id", "path", "modified", "length", "map")
        broken = d.where("content IS NOT NULL").select("path", "modified", "length", F.lit("not a song map").alias("reason"), "content")
        good, bad = good.unionByName(read), bad.unionByName(broken)
        n_good, n_bad = n_good + read.count(), n_bad + broken.count()
    n_gone = gone.count()
    if names or n_gone:
        # what is in one table now has left the other
        leave = lambda rows: rows.where(F.col("length") != GONE).select("path", F.lit(None).cast("timestamp").alias("modified"), F.lit(GONE).cast("long").alias("length"))
        moved = leave(good).withColumns({"reason": F.lit(None).cast("string"), "content": F.lit(None).cast("string")})
        mended = leave(bad).withColumns({"song_id": F.lit(None).cast("string"), "map": F.lit(None).cast(maps.schema["map"].dataType)})
        quarantine.upsert(bad.unionByName(moved), ["path"], _newer)
        maps.upsert(good.unionByName(mended), ["path"], _newer)
    return {"parsed": n_good, "set aside": n_bad, "gone": n_gone}


def current(maps: DataFrame, legacy: str | None = None) -> DataFrame:
    """A row for each song: of several documents of one song those not under a path that matches `legacy`, of them the last
    modified, then the first by path. Songs with legacy documents alone come after all others, each kind by song_id."""
    old = F.col("path").rlike(legacy) if legacy else F.lit(False)
    w = W.partitionBy("song_id").orderBy("_old", F.desc("modified"), "path")
    d = maps.withColumn("_old", old).withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return d.orderBy("_old", "song_id").drop("_n", "_old")


#: Fixed values, in seconds: how long before the next note one ends that would reach into it, and how long it lasts at least.
GAP, LASTS = 0.01, 0.05


def _trimmed(notes):
    """Notes by t_start and t_end, each ending before the next one begins."""
    by_time = F.transform(F.array_sort(F.transform(notes, lambda n: F.struct(n["t_start"].alias("a"), n["t_end"].alias("b"), n.alias("n")))), lambda x: x["n"])

    def trim(n, i):
        after = F.get(by_time, i + 1)["t_start"]
        return n.withField("t_end", F.when(n["t_end"] > after, F.round(F.greatest(after - GAP, n["t_start"] + LASTS), 3)).otherwise(n["t_end"]))

    return F.transform(by_time, trim)


def save(maps: Versions, edits: DataFrame, writer: str | None = None, batch: int | None = None) -> int:
    """The version in which the songs of edits (song_id, notes, pages: as in a map) have those notes and pages, and what
    follows from them: counts, page_flips, n_manual (notes whose src is manual), and a method that ends in +manual once.
    Songs that aren't there are left out. What was there stays readable as the version before, and each version as long as
    it is kept; a reader sees all edits or none; an edit of a song's state by hand lasts until its file changes."""
    e = edits.select("song_id", _trimmed(F.coalesce("notes", F.array().cast(maps.schema["map"].dataType["notes"].dataType))).alias("_notes"), F.coalesce("pages", F.array().cast(maps.schema["map"].dataType["pages"].dataType)).alias("_pages"))
    r = lambda c, places: F.round(c, places)
    pages = F.transform("_pages", lambda p: F.struct(r(p["vis_a"], 3).alias("vis_a"), r(p["t_end"], 3).alias("t_end"), r(p["R"], 3).alias("R"), r(p["T0"], 4).alias("T0")))
    m = F.col("map")
    for name, value in {
        "notes": F.col("_notes"), "n_notes": F.size("_notes"), "pages": pages, "n_pages": F.size("_pages"),
        "page_flips": F.transform(F.slice(pages, 2, F.greatest(F.lit(1), F.size("_pages"))), lambda p: p["vis_a"]),
        "n_manual": F.size(F.filter("_notes", lambda n: n["src"] == "manual")),
        "method": F.concat(F.replace(F.coalesce(F.col("map.method"), F.lit("")), F.lit("+manual"), F.lit("")), F.lit("+manual")),
    }.items():
        m = m.withField(name, value)
    d = current(maps.read()).join(e, "song_id").withColumn("map", m).drop("_notes", "_pages")
    return maps.upsert(d, ["path"], _newer, writer, batch)
