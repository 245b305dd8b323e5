"""Ids, letters and column names at the edges of what operators take."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from logloom.llm import langid, merkle, simhash
from logloom.ship import ship


@pytest.mark.parametrize("kind, ids", [("string", ["a", "abcdef1", "abcdef2", "z", "é"]), ("double", [-3000.5, 0.25, 0.5, 4e6, 5e9])])
def test_ids_of_other_types(spark, kind, ids):
    ship(spark)
    df = spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(ids)], f"doc_id {kind}, text string")
    got = {r["id"]: r["next_text"] for r in merkle.with_next_text(df).collect()}
    assert got == {i: f"text {(k + 1) % len(ids)}" for k, i in enumerate(ids)}
    assert merkle.edit_report(df.limit(0)).collect() == []


def test_many_null_ids(spark):
    ship(spark)
    df = spark.createDataFrame([(None, f"t{k}") for k in range(50)] + [(1, "last")], "doc_id long, text string")
    rows = merkle.with_next_text(df).collect()
    assert sorted(r["next_text"] for r in rows) == sorted(r["text"] for r in rows)
    assert len(rows) == 51




def plain(text):
    """Root and leaves of the tree in plain Python."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    sections = re.split(r"(?<=\n)(?=[ \t]*\n)", text)
    return sha(",".join(sha(",".join(sha(p) for p in re.split(r"(?<=\n)", s))) for s in sections))


def test_likeness_is_that_of_the_fingerprints(spark):
    ship(spark)
    texts = ["one two three four five six\nseven eight\n\nnine ten", "one two three four five six\nseven 8\n\nnine ten", "", "other words", None, " \n\n ", "a b c d " * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(merkle.edit_report(df).collect(), key=lambda r: r["doc_id"])
    leaves = lambda f: set(re.split(r"[./|]", f.split(":")[1])) - {""}
    for k, r in enumerate(rows):
        assert r["fingerprint"].split(":")[0] == plain(texts[k] or "")
        for other, near in ((r["edited_fingerprint"], r["near_edited"]), (rows[(k + 1) % len(rows)]["fingerprint"], r["near_next"])):
            a, b = leaves(r["fingerprint"]), leaves(other)
            want = 1.0 if r["fingerprint"].split(":")[0] == other.split(":")[0] else 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0
            assert near == pytest.approx(want)


def test_letters_are_of_category_l(spark):
    ship(spark)
    model = langid.fit(spark.createDataFrame([("the cat", "en"), ("le chat", "fr")], "text string, lang string"))
    rows = langid.predict(spark.createDataFrame([(0, "½ ² Ⅷ"), (1, "the ½")], "doc_id long, text string"), model).collect()
    assert [r["lang_pred"] == "und" for r in sorted(rows, key=lambda r: r["id"])] == [True, False]


def test_columns_named_like_inner_ones(spark):
    ship(spark)
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", "x"), (2, "quite another text of words", "x"), (None, "a b c d e f", "x"), (None, "and one more text here", "x")]
    names = ("gone_id_", "stay_id_", "row", "group")
    df = spark.createDataFrame(rows, "doc_id long, text string, c string").select("doc_id", "text", *(F.col("c").alias(n) for n in names))
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), r.text[:5]) for r in kept.collect()) == [("1", "a b c"), ("2", "quite"), ("None", "and o")]
