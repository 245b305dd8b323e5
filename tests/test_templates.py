"""Lines to templates, texts and JSON, on golden cases."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from logloom.config import GROUPERS, Limits, TemplaterConfig, grouper_name
from logloom.functions import sequences, text
from logloom.operators import grouping
from logloom.plans import api, render


def frame(spark, messages, window=0):
    return spark.createDataFrame([(window, i, m) for i, m in enumerate(messages)], "window_id long, line_index long, message string")


def groups(spark, messages, **settings):
    return api.template_logs(frame(spark, messages), TemplaterConfig(**settings)).orderBy("id").collect()


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


def test_compact_json(spark):
    found = groups(spark, [f'{{"level":"warning","time":"2025-01-08T08:18:{s}Z","msg":"ready"}}' for s in range(10, 18)])
    assert [g["count"] for g in found] == [8]
    assert '"time":"2025-01-08T08:18:<*>"' in found[0]["template"]


def test_words_in_slots(spark):
    found = groups(spark, [f"node phase changed to {s} now" for s in ("Succeeded", "Failed", "Skipped", "Succeeded", "Failed", "Skipped")])
    slot = found[0]["slots"][0]
    assert (len(found), slot["samples"], slot["distinct"], slot["numeric"]) == (1, ["Succeeded", "Failed", "Skipped"], 3, False)


def test_numbers_in_slots_and_text(spark):
    lines = ["latency 20ms"] * 3 + ["latency 8400ms"]
    slot = groups(spark, lines)[0]["slots"][0]
    assert (slot["numeric"], slot["min"], slot["max"], slot["median"], slot["unit"], slot["distinct"]) == (True, 20.0, 8400.0, 20.0, "ms", 2)
    report = render.render(api.template_logs(frame(spark, lines))).first()["text"]
    assert report == "[x4] latency <*> [20..8400ms p50=20ms] samples: latency 20ms | latency 20ms | latency 20ms"


def test_neighbouring_wildcards_keep_their_blank(spark):
    found = groups(spark, ["x a b c", "x d e c"])
    assert found[0]["template"] == "x <*>  c"
    assert (found[0]["slots"][0]["distinct"], found[0]["slots"][0]["samples"]) == (0, [])


def test_ragged_members(spark):
    lines = spark.createDataFrame([(0, 0, 0, "a b c"), (0, 1, 0, "a b"), (0, 2, 0, "a b c d"), (0, 3, 1, "u=1 v"), (0, 4, 1, "u=1=2 v")], "window_id long, line_index long, group_id long, message string")
    found = api.template_groups(lines).orderBy("id").collect()
    assert [g["template"] for g in found] == ["a b <*>", "<*> v"]


@pytest.mark.parametrize("name", GROUPERS)
def test_groupers_and_awkward_lines(spark, name):
    lines = ["GET /users/1 200", "GET /users/2 200", 'File "x.py", line 3, in foo', 'File "x.py", line 5, in bar', "", "", "  ", None, "disk full é x", "a,b <*> c", "x" * 5000]
    found = groups(spark, lines, grouper=name)
    assert sum(g["count"] for g in found) == len(lines)
    assert [g["id"] for g in found] == list(range(len(found)))
    assert [g["first_index"] for g in found] == sorted(g["first_index"] for g in found)
    assert found[0]["count"] == 2 and found[1]["count"] == 2
    assert (len([g for g in found if g["template"].strip() == ""]) == 1) == (name != "statistical")
    assert max(len(g["template"]) for g in found) == 120


def test_samples_json_and_empty(spark):
    lines = ["worker ready 1", "worker ready 2", "worker ready 3"]
    assert len(groups(spark, lines, sample_cap=2)[0]["samples"]) == 2
    doc = json.loads(render.to_json(api.template_logs(frame(spark, lines))).first()["json"])
    assert list(doc) == ["groups", "original_count", "template_count", "line_compression"]
    assert (doc["original_count"], doc["template_count"], doc["line_compression"]) == (3, 1, 3.0)
    assert list(doc["groups"][0]) == ["id", "first_index", "count", "template", "samples", "slots"]
    assert doc["groups"][0]["samples"][0] == {"index": 0, "text": "worker ready 1", "level": None, "timestamp": None}
    assert groups(spark, []) == []


def test_result_does_not_depend_on_partitions(spark):
    rng = random.Random(1)
    lines = [f"{rng.choice(['get', 'put', 'x1'])} {rng.choice('abc')} {rng.randint(0, 9)} {rng.choice(['up', 'down'])}" for _ in range(300)]
    df = frame(spark, lines)
    for name in GROUPERS:
        expected = None
        for parts, finer in ((1, True), (7, True), (3, False)):
            got = sorted(map(tuple, grouping.group(df.repartition(parts, F.rand(parts)), TemplaterConfig(grouper=name, finer_keys=finer)).collect()))
            expected = expected or got
            assert got == expected


def test_linear_captures_equal_the_lazy_pattern(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(600):
        parts = ["".join(rng.choice("ab, ") for _ in range(rng.randint(0, 3))) for _ in range(rng.randint(1, 4))]
        template = "z" + "<*>".join(parts)
        line = "".join(p.replace("<*>", "") + "".join(rng.choice("ab\n ") for _ in range(rng.randint(0, 3))) for p in ["z" + parts[0], *parts[1:]])
        rows.append((template, line.replace(",", "").strip() if rng.random() < 0.8 else line.replace(",", "")))
    got = spark.createDataFrame(rows, "t string, l string").select("t", "l", sequences.capture(F.col("t"), F.col("l"), F.lit(True)).alias("c")).collect()
    for r in got:
        pattern = "(.*?)".join(map(re.escape, r["t"].replace(",", "").split("<*>")))
        m = re.fullmatch(pattern, r["l"])
        assert r["c"] == (list(m.groups()) if m else None), r


def test_scalar_functions(spark):
    n = lambda v: one(spark, text.format_number(F.col("v")), v=v)
    assert [n(v) for v in (20.0, 0.8, 1e-5, 123456789.0, 12345678.5, 1e22, 0.1, -2.5, 1.5e-7)] == ["20", "0.8", "0.00001", "123456789", "12345678.5", "1" + "0" * 22, "0.1", "-2.5", "0.00000015"]
    unit = lambda v: one(spark, text.trailing_unit(F.col("v")), v=v)
    assert [unit(v) for v in ("45ms", "512MB", "100", "word")] == ["ms", "MB", "", ""]
    mask = lambda v: one(spark, text.mask(F.col("v")), v=v)
    assert [mask(v) for v in ("2026-05-22", "x -5", "a-5", "20ms", "10.0.0.1:80 0xFF")] == ["<NUM><NUM><NUM>", "x -<NUM>", "a<NUM>", "20ms", "<IP>:<NUM> <HEX>"]
    useful = lambda v: one(spark, text.is_useful_template(F.col("v")), v=v)
    assert [useful(v) for v in ("<*>", ": <*>", "acquired <*>", "abc <*>", "ab <*>")] == [False, False, True, True, False]
    lex = lambda v: one(spark, text.lex(F.col("v")), v=v)
    assert lex('{"a-b":1.5} é_x €€') == ["{", '"', "a-b", '"', ":", "1", ".", "5", "}", "é_x", "€€"]
    assert one(spark, text.first_number(F.col("v")), v="a-12.5b7") == -12.5
    assert one(spark, text.first_number(F.col("v")), v="٣") is None
    assert one(spark, sequences.collapse(F.split("v", " ")), v="a <*> <*> b <*>") == ["a", "<*>", "b", "<*>"]
    with pytest.raises(ValueError):
        text.Mask("a", "$1")


def test_settings():
    assert grouper_name("stock") == "drain-stock" and grouper_name("DRAIN", strict=False) == "drain" and grouper_name("nope", strict=False) == "drain"
    with pytest.raises(ValueError):
        grouper_name("Drain")
    limits = Limits.from_env({"LOGLOOM_LINES": "7", "LOGLOOM_SAMPLES": "0", "LOGLOOM_BODY_BYTES": "x"})
    assert (limits.lines, limits.samples, limits.body_bytes) == (7, 10, 4 << 20)
