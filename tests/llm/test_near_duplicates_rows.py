"""What near-duplicates move: bytes of a document, rows of large nodes."""

import random

import pytest

pytest.importorskip("xxhash")
from cadenza.llm import chosen_path  # noqa: E402


def test_a_document_is_few_bytes_after_its_text(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}_{j}" for j in range(300))) for i in range(20)], "doc_id long, text string")
    r = chosen_path.signatures(docs, 4).first()
    assert sum(len(x) for x in r if isinstance(x, (bytes, bytearray))) <= 200


def test_rows_of_large_nodes(spark, monkeypatch):
    """Near copies of one text, which large nodes of all trees hold, and texts that share a passage and nothing else."""
    rng = random.Random(5)
    base, passage = [f"w{i}" for i in range(100)], [f"p{i}" for i in range(20)]
    texts = []
    for i in range(600):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2])):
            w[rng.randrange(100)] = f"x{rng.random()}"
        texts.append((i, " ".join(w)))
    texts += [(1000 + i, " ".join(passage + [f"y{i}_{j}" for j in range(60)])) for i in range(600)]
    monkeypatch.setattr(chosen_path, "BLOCK", 32)
    monkeypatch.setattr(chosen_path, "WIDE", 64)
    monkeypatch.setattr(chosen_path, "COMPARED", 1024)
    seen, candidates = [], chosen_path._candidates
    monkeypatch.setattr(chosen_path, "_candidates", lambda b, *rest: [seen.append(b.count()), candidates(b, *rest)][1])
    got = {r.doc_id: r.component_id for r in chosen_path.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), words=4).collect()}
    assert all(got[i] == 0 for i in range(600)) and all(got[1000 + i] == 1000 + i for i in range(600))
    assert sum(seen) < 12 * 1200, seen


def test_rows_of_one_id_and_text_in_several_tasks(spark):
    a, b = [f"w{i}" for i in range(60)], [f"v{i}" for i in range(60)]
    texts = [(7, " ".join(a))] * 12 + [(9, " ".join([*a[:-1], "z"]))] * 3 + [(8, " ".join(b))]
    got = chosen_path.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string").repartition(8), words=4).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(7, 7, True)] * 12 + [(8, 8, True)] + [(9, 7, False)] * 3


@pytest.mark.parametrize("similarity", [0.5, 0.6, 0.8, 0.9, 1.0])
def test_trees_for_a_similarity(similarity):
    assert (1 - similarity**chosen_path.LEVELS) ** chosen_path.trees(similarity) < 1e-4
