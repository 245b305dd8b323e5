"""The pipeline's near-duplicate stage on planted near copies and against brute force."""

import random

import numpy as np

import corpus_pipeline
from logloom.llm import common, jaccard, simhash
from logloom.ship import ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def similar(a: str, b: str) -> float:
    x, y = ({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} for w in (t.split() for t in (a, b)))
    return len(x & y) / len(x | y)


def planted():
    """Texts with copies of which 1 to 12 words differ: similarities from about 0.6 up to 1."""
    rng = random.Random(3)
    texts = []
    for _ in range(25):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(120, 300))]
        texts.append(" ".join(base))
        for edits in (1, 3, 6, 9, 12):
            copy = list(base)
            for k in rng.sample(range(len(copy)), edits):
                copy[k] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    return texts


def kept_by_brute_force(texts):
    label = list(range(len(texts)))
    near = [(i, j) for j in range(len(texts)) for i in range(j) if similar(texts[i], texts[j]) >= 0.8]
    while True:
        new = label[:]
        for i, j in near:
            new[i] = new[j] = min(new[i], new[j])
        if new == label:
            return set(label), near
        label = new


def test_planted_near_copies(spark):
    texts = planted()
    expected, near = kept_by_brute_force(texts)
    prints = [simhash.fingerprint(np.frombuffer(t.encode(), np.uint8)) for t in texts]
    # most of them lie beyond what op9's four bits see
    assert len(near) > 50 and sum((prints[i] ^ prints[j]).bit_count() > 4 for i, j in near) > len(near) / 2
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == expected


def test_dealt_out_groups(spark):
    ship(spark)
    texts = planted()
    expected, _ = kept_by_brute_force(texts)
    df = spark.createDataFrame([(i, 0, bytearray(t.encode())) for i, t in enumerate(texts)], "node long, component long, text binary")
    for block in (10**6, 3000):
        found = {r["node"]: r["component"] for r in common.connected_components(jaccard.verified(df, 5, 42, 0.8, block)).collect()}
        assert {found.get(i, i) for i in range(len(texts))} == expected


def test_one_worker_a_task(spark, monkeypatch):
    """Edges come to the components as written tables, so no task runs two Python operators at once."""
    plans, whole = [], jaccard.connected_components

    def seen(edges):
        plans.append(edges._jdf.queryExecution().optimizedPlan().toString())
        return whole(edges)

    monkeypatch.setattr(jaccard, "connected_components", seen)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(planted()[:12])], SCHEMA)
    assert 1 < corpus_pipeline.near_dedup(spark, docs, "").count() < 12
    assert len(plans) == 2 and not any("MapInArrow" in p for p in plans)
