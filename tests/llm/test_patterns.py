"""Contexts and rounds of the discovery of personal data."""

from logloom.llm import pii
from logloom.ship import ship


def discovered(spark, texts):
    ship(spark)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r["doc_id"], s["kind"], s["match"]) for r in pii.extract(df).collect() for s in r["spans"] if not s["base"]}


def test_second_generation_patterns(spark):
    seeds = [f"please call me at +1 (555) 010-{i:04d} today" for i in range(30)]
    both = [f"please call me at 555-01{i:02d} today" for i in range(6)] + [f"just dial now 555-01{i:02d} today" for i in range(6)]
    only = ["just dial now 555-0999 today", "room 555-0999 is far"]
    got = discovered(spark, seeds + both + only)
    assert got == {(30 + i, "phone", f"555-01{i % 6:02d}") for i in range(12)} | {(42, "phone", "555-0999")}


def test_contexts_across_numbers(spark):
    seeds = [f"order 12 mail bob{i}@x.com today" for i in range(30)] + [f"id {i}, +1 (555) 010-{i:04d}" for i in range(30)]
    unseen = ["order 12 mail bob@localhost today", "id 55, 555-0199", "at 55, 555-0199"]
    assert discovered(spark, seeds + unseen) == {(60, "email", "bob@localhost")}
    listed = [f"call 7 9 +1 (555) 010-{i:04d}" for i in range(30)]
    assert discovered(spark, [*listed, "call 7 9 555-0199"]) == {(30, "phone", "555-0199")}


def test_masks_are_cut_by_offsets(spark):
    ship(spark)
    texts = [f"please call me at +1 (555) 010-{i:04d} today" for i in range(30)] + ["9555-01998 please call me at 555-0199 today", "a@b.co 4111 1111 1111 1111 😀 1.2.3.4"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(30, "9555-01998 only", "x"), (None, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __pii_fresh string")
    got = pii.without_personal_data(df)
    assert got.columns == df.columns
    found = {(r.doc_id, r.text) for r in got.collect()}
    assert {(30, "9555-01998 please call me at <PHONE> today"), (30, "9555-01998 only"), (31, "<EMAIL> <CARD> 😀 <IP>"), (None, None)} <= found
