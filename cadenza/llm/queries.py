"""The query of each operator over its whole table, with production parameters, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cadenza.llm import bpe, chosen_path, dac, fingerprints, langid, merkle, negatives, packing, quality, quality_sql, quotes, rank_bpe, toxicity, warc
from cadenza.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query()
def op10_bpe(spark, sf_dir):
    """Digests of every document's ids by the backtracking encoder and of the text decoded from them; a row for each document."""
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), BYTE_BPE)


@query()
def op5_dac(spark, sf_dir):
    """Every document's place, number and crc32 of ids, read back from files of directly addressable codes."""
    return dac.read_digests(dac.write(table(spark, sf_dir, "documents"), BYTE_BPE, end_id=2))


@query()
def op7_packing(spark, sf_dir):
    """Every document's pieces in sequences of 2048 tokens at most; a row for each piece."""
    return packing.pack(table(spark, sf_dir, "documents"), WORD_BPE, end_id=0, capacity=2048)


@query()
def op1_fingerprints(spark, sf_dir):
    """Every document's fingerprint, its edited text's, and their likeness; a row for each document."""
    return fingerprints.against_edited(table(spark, sf_dir, "documents"))


@query(quality_sql.oracle())
def op9_quality(spark, sf_dir):
    """The quality measures and verdict of every document."""
    return quality.verdicts(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("""
SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
       payload_digest, CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> kept THEN kept END AS refers_to
FROM (SELECT *, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS kept,
        (SELECT string_agg('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + CAST(substr(bits, CAST(5 * i + 1 AS INT), 5)::BIT::INT AS INT)], '' ORDER BY i) FROM range(32) r(i)) AS payload_digest
      FROM (SELECT *, (SELECT string_agg(CAST((strpos('0123456789abcdef', substr(sha1(coalesce(html, '')), CAST(j AS INT), 1)) - 1)::UTINYINT::BIT AS VARCHAR)[5:8], '' ORDER BY j) FROM range(1, 41) q(j)) AS bits FROM pages))""")
def op3_warc(spark, sf_dir):
    """Every page's record, read back from the archives by its index."""
    found = warc.read(warc.write(table(spark, sf_dir, "pages")), payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op2_quotes(spark, sf_dir):
    """Every message without its quotes, with what it replies to, its thread and depth."""
    d = quotes.threads(quotes.conversations(table(spark, sf_dir, "conversations")))
    return d.select("conv_id", "turn", "role", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), "n_quoted", "n_linked", "max_level", "reply_to", "thread", "depth")


@query()
def op4_near_duplicates(spark, sf_dir):
    """Every document's group of near-duplicates: shingles of four words, similarity 0.8."""
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"), words=4, similarity=0.8)


@query()
def op6_langid(spark, sf_dir):
    """The predicted language of every document."""
    return langid.identify(table(spark, sf_dir, "documents"))


@query()
def op8_toxicity(spark, sf_dir):
    """The toxicity score of every document, by a model of the training labels."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query(merkle.ORACLE)
def op11_merkle(spark, sf_dir):
    """Every document's leaf, proof and roots, and what a leaf tampered with folds to."""
    return merkle.audit(table(spark, sf_dir, "documents"), tamper=merkle.every_seventh())


@query()
def op12_segment_tree_bpe(spark, sf_dir):
    """Digests of every document's ids by ranks and of the bytes decoded from them."""
    return rank_bpe.round_trip_digests(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


@query(negatives.ORACLE)
def op13_hard_negatives(spark, sf_dir):
    """Five hard negatives for each of five positives of every hundredth vector, labels of every seventh moved on."""
    v = table(spark, sf_dir, "embeddings")
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(v.withColumn("label", relabelled), anchor=F.col("vec_id") % 100 == 0)
