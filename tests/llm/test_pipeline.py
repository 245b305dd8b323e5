"""Every stage of the pipeline against its own input."""

import re

import numpy as np
import pandas as pd

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(900_001, None, "en", "s", 0), (900_002, "123 456", "en", "s", 7)], docs.schema)
    frames = [docs.union(odd)]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], SF))
    assert [s for s, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "suffix_array_dedup", "pii", "packing"]
    assert all(sorted(f.dtypes) == sorted(docs.dtypes) for f in frames[:-1])
    known, unique, cut, masked = (f.toPandas().set_index("doc_id").sort_index() for f in frames[1:-1])
    assert set(known.index) == {r["doc_id"] for r in docs.select("doc_id").collect()}
    # near copies by definition: five-word shingles, Jaccard similarity of 0.8
    words = [re.findall(rb"[^\x20\x09-\x0d]+", bytes(x + 32 if 65 <= x <= 90 else x for x in t.encode())) for t in known.text]
    sets = [{b" ".join(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} for w in words]
    label = known.index.to_numpy()
    mask = np.array([[bool(len(x & y) >= 0.8 * len(x | y)) for y in sets] for x in sets])
    while True:
        new = np.where(mask, label[None, :], 1 << 60).min(axis=1)
        if (new == label).all():
            break
        label = new
    assert set(unique.index) == set(label.tolist())
    seen: set[bytes] = set()
    least = corpus_pipeline.REPEAT_BYTES
    for i, t in unique.text.items():
        raw = t.encode()
        mark = bytearray(len(raw))
        for k in range(len(raw) - least + 1):
            if raw[k : k + least] in seen:
                mark[k : k + least] = b"\1" * least
            seen.add(raw[k : k + least])
        left = bytes(b for b, m in zip(raw, mark) if not m).decode(errors="ignore")
        if i in cut.index:
            assert cut.text[i] == left and cut.n_chars[i] == len(left)
        else:
            assert any(mark) and not left.strip()
    assert set(masked.index) == set(cut.index)
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    assert cut.text.str.contains(email).any() and not masked.text.str.contains(email).any()
    clean = ~cut.text.str.contains("[0-9@]")
    assert (cut.text[clean] == masked.text[clean]).all() and (masked.n_chars == masked.text.str.len()).all()
    pieces = frames[-1].toPandas()
    assert set(pieces.doc_id) == set(masked.index) and pieces.length.sum() == pieces.drop_duplicates("doc_id").doc_tokens.sum()


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert isinstance(docs.toPandas(), pd.DataFrame) and docs.count() == 0
