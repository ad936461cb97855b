"""Song maps: one nested JSON document per song, read with a fixed schema."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cadenza.functions.scalars import title_parts
from cadenza.operators.relational import falsy_coalesce

# The format of a song map.
SONG_MAP = """video string, meta struct<filename:string,title_jp:string,artist_jp:string,english_part:string,title_en:string,artist_en:string,youtube_id:string>,
family string, fps double, duration double, lattice struct<px_per_semitone:double,phase:double>, page_flips array<double>, n_pages int, n_notes int, method string, n_manual int,
pages array<struct<vis_a:double,t_end:double,R:double,T0:double>>,
notes array<struct<x0:int,x1:int,cy:double,cls:string,k:int,t_start:double,t_end:double,first_f:int,last_f:int,page:int,seen:int,src:string,midi:int,pc:int,name:string,name_jp:string>>,
lyrics array<struct<t_show:double,t_hide:double,bbox:array<int>,wipe:array<struct<t:double,front:int>>>>"""


def unescaped(name: Column) -> Column:
    """A file's name as it is, from the metadata column, which writes it as part of an address."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def read_maps(spark: SparkSession, path: str) -> DataFrame:
    """Every map under a path, with song_id from its file name; what can't be parsed has nulls."""
    d = spark.read.schema(SONG_MAP + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path, multiLine=True)
    return d.withColumn("song_id", F.regexp_extract(unescaped(F.col("_metadata.file_name")), r"(?:song_map_)?([^/]+?)\.json$", 1))


def summaries(maps: DataFrame) -> DataFrame:
    """song_id, duration, family, n_notes, n_pages (the number of pages where it is missing or 0), n_lyrics, anchored."""
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0))
    return maps.select("song_id", "duration", "family", size("notes").alias("n_notes"), falsy_coalesce(F.col("n_pages"), size("pages")).alias("n_pages"), size("lyrics").alias("n_lyrics"), F.coalesce(F.get(F.col("notes"), F.lit(0))["midi"].isNotNull(), F.lit(False)).alias("anchored"))


def note_rows(maps: DataFrame) -> DataFrame:
    return maps.select("song_id", F.posexplode("notes").alias("pos", "n")).select("song_id", "pos", "n.*")


def page_rows(maps: DataFrame) -> DataFrame:
    """Pages with their place; of maps without pages they follow from the flips, without a sweep."""
    flips = F.concat(F.array(F.lit(0.0)), F.coalesce("page_flips", F.array().cast("array<double>")))
    made = F.transform(flips, lambda t, i: F.struct(t.alias("vis_a"), F.coalesce(F.get(flips, i + 1), F.col("duration")).alias("t_end"), F.lit(None).cast("double").alias("R"), F.lit(None).cast("double").alias("T0")))
    return maps.select("song_id", F.posexplode(F.when(F.size("pages") > 0, F.col("pages")).otherwise(made)).alias("pos", "p")).select("song_id", "pos", "p.*")


def catalogue(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """song_id, path, size, modified of the files under a path, without reading them whole."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return d.select(F.regexp_extract("path", r"([^/]+?)\.[^./]*$", 1).alias("song_id"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def write_maps(maps: DataFrame, path: str) -> str:
    """Maps as text files of a JSON document a line, with song_id, in a new folder of `path`, whose name is given back:
    Spark's committer lets a reader see all files of a write or none, and what was written before stays as it is."""
    out = f"{path.rstrip('/')}/maps-{uuid.uuid4().hex[:12]}"
    maps.select(F.to_json(F.struct(*maps.columns)).alias("value")).write.text(out)
    return out


# What a video's info document holds, the names of which one is in a channel's name, the longest title.
INFO = "id string, title string, channel string, uploader string, duration double"
CHANNELS, LONGEST_TITLE = ("DIVA", "カラオケ"), 120


def songs_of_info(spark: SparkSession, path: str) -> DataFrame:
    """A row for each info document under a path (song_id: the folder that it is in): title_jp and artist_jp, of the title's
    form or else the title and the channel, cut; title_en, artist_en, duration, youtube_id; expected: whether the channel
    is one whose pictures are known. What can't be parsed has nulls, and isn't expected."""
    d = spark.read.schema(INFO).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.info.json").json(path, multiLine=True)
    d = d.select(unescaped(F.element_at(F.split("_metadata.file_path", "/"), -2)).alias("song_id"), "id", "duration", F.coalesce("title", F.lit("")).alias("title"), F.coalesce(F.nullif("channel", F.lit("")), "uploader", F.lit("")).alias("channel"))
    p = title_parts(F.col("title"))
    known = F.lit(False)
    for c in CHANNELS:
        known |= F.col("channel").contains(c)
    cut = lambda c: F.substring(c, 1, LONGEST_TITLE)
    return d.select("song_id", F.coalesce(p["title_jp"], cut("title")).alias("title_jp"), F.coalesce(p["artist_jp"], cut("channel")).alias("artist_jp"), p["title_en"].alias("title_en"), p["artist_en"].alias("artist_en"), "duration", F.col("id").alias("youtube_id"), known.alias("expected"))
