"""Readers, limits, metrics, sessions and the command line."""

import io

import pytest
from pyspark.sql import functions as F

from logloom import sources, streaming
from logloom.__main__ import arguments
from logloom.config import Limits
from logloom.functions import parse
from logloom.operators import grouping, limits, metrics
from logloom.plans import catalogue


def bodies(spark, text):
    return sources.body_lines(spark.createDataFrame([(0, text)], "window_id long, body string"))


def test_text_lines(spark):
    body = "2026-05-22 14:13:00 [ERROR] disk  full\r\n \n1747923180 svc WARN: hi\nplain line\n2026-05-22T10:00:00.5+02:00 x\n2026-05-22 info\n"
    got = [tuple(r)[1:] for r in sources.parse_lines(bodies(spark, body)).collect()]
    assert got == [
        (0, "disk full", "error", "2026-05-22 14:13:00"),
        (1, "hi", "warn", "1747923180"),
        (2, "plain line", None, None),
        (3, "x", None, "2026-05-22T10:00:00.5+02:00"),
        (4, "", "info", "2026-05-22"),
    ]


def test_ndjson_lines(spark):
    body = '{"message":"a","level":3}\n{"message":1}\nnope\n{"message":"b"} x\n{"message":"c","message":"d","timestamp":"t"}\n[1]\n{"message":NaN}\n{"message":"\\ud800"}'
    got = [tuple(r)[2:] for r in sources.parse_lines(bodies(spark, body), "ndjson").collect()]
    assert got == [("a", None, None), ("d", None, "t")]
    with pytest.raises(Exception, match="invalid ndjson"):
        sources.parse_lines(bodies(spark, body), "ndjson", strict=True).collect()


def test_labelled_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('LineId,Content,EventTemplate\n1,"a, ""b""",A <*>\n2,short\n3,,E\n4,x,y,more\n')
    assert [tuple(r)[1:] for r in sources.read_structured_csv(spark, str(tmp_path / "a.csv")).collect()] == [('a, "b"', "A <*>"), ("", "E"), ("x", "y")]
    assert sources.read_structured_csv(spark, str(tmp_path / "a.csv"), 1).count() == 1
    (tmp_path / "b.jsonl").write_text('{"_oracle_template": "T <*>", "messages": [{"content": "Log list: [\'T 1\', \\"T 2\\"] end"}]}\n')
    assert [tuple(r)[1:] for r in sources.read_labelled_jsonl(spark, str(tmp_path / "b.jsonl")).orderBy("line_index").collect()] == [("T 1", "T <*>"), ("T 2", "T <*>")]
    (tmp_path / "c.txt").write_text("one\r\n\n two \n")
    assert [r["line"] for r in sources.read_text(spark, str(tmp_path / "c.txt")).orderBy("line_index").collect()] == ["one", " two "]


def test_quoted_list():
    assert parse.quoted_list("no list") == []
    assert parse.quoted_list("Log list: ['a\\n\\'', \"é\"] 'c'") == ["a\n'", "Ã©"]


def test_limits(spark):
    lines = spark.createDataFrame([("a", 0, "ok"), ("a", 1, "x" * 30), ("b", 0, "ok"), ("c", 0, None), ("d", 0, "1"), ("d", 1, "2"), ("d", 2, "3")], "r string, line_index long, message string")
    got = dict(map(tuple, limits.request_status(lines, "r", Limits(lines=2, line_chars=20)).collect()))
    assert got == {"a": 413, "b": None, "c": 400, "d": 413}
    assert spark.range(1).select(limits.body_status(F.lit("é" * 3), Limits(body_bytes=5))).first()[0] == 413
    assert limits.samples_status(11) == 413 and limits.samples_status(10) is None


def test_quality(spark):
    rows = [("s", "a", "A x"), ("s", "a", "A x"), ("s", "b", "B"), ("s", "b", "C"), ("t", "1", "L"), ("t", "1", "L")]
    lines = spark.createDataFrame(rows, "system string, group_id string, label string")
    names = spark.createDataFrame([("s", "a", " A  x"), ("s", "b", "B"), ("t", "1", "M")], "system string, group_id string, template string")
    got = {r["system"]: r for r in metrics.quality(lines, names).collect()}
    assert (got["s"]["ga"], got["s"]["fga"], got["s"]["fta"], got["s"]["purity"]) == (0.5, pytest.approx(0.4), pytest.approx(0.4), 0.75)
    assert (got["t"]["ga"], got["t"]["fga"], got["t"]["fta"], got["t"]["purity"]) == (1.0, 1.0, 0.0, 1.0)
    assert metrics.bootstrap_mean([]) == (0.0, 0.0) and metrics.bootstrap_mean([2.0]) == (2.0, 2.0)
    low, high = metrics.bootstrap_mean([0.1, 0.5, 0.9])
    assert low < 0.5 < high and metrics.bootstrap_delta([1.0, 2.0], [1.0, 2.0]) == (0.0, 0.0, 0.0)


def test_match_on_frames(spark):
    frame = lambda m: spark.createDataFrame([(0, i, x) for i, x in enumerate(m)], "window_id long, line_index long, message string")
    trained, asked = frame(["aa aa aa", "aa aa bb", "aa aa cc", "xx yy zz"]), frame(["aa aa tt", "xx yy zz", "xx yy rr", "nothing"])
    for strategy in ("never", "fallback", "always"):
        got = [r["first_index"] for r in grouping.match(trained, asked, strategy=strategy).orderBy("line_index").collect()]
        assert got == [0, 3, None, None]


def test_sessions(spark, tmp_path):
    rows = [("a", i, f"job {i} done") for i in range(5)] + [("b", i, f"x{i}") for i in range(3)]
    spark.createDataFrame(rows, "session_id string, line_index long, message string").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("session_id string, line_index long, message string").parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        return spark.table(name)

    assert sorted(map(tuple, run(streaming.session_totals(stream()), "totals", "update").collect())) == [("a", 5, 5), ("b", 3, 3)]
    events = run(streaming.online_drain(stream()), "events", "append").orderBy("session_id", "line_index").collect()
    assert [(r["session_id"], r["local_id"], r["cluster_size"]) for r in events] == [("a", 1, i + 1) for i in range(5)] + [("b", i + 1, 1) for i in range(3)]
    touched = []
    table = streaming.SessionTable(spark, str(tmp_path / "table"))
    assert table.ingest(stream(), str(tmp_path / "c"), lambda s: touched.append(s.count())).awaitTermination(60)
    assert touched == [2] and sorted(map(tuple, table.sizes().collect())) == [("a", 5), ("b", 3)]
    table.append(spark.createDataFrame([("a", 5, "job 9 done")], "session_id string, line_index long, message string"), 7)
    got = [(r["window_id"], r["count"], r["template"]) for r in table.templates().orderBy("window_id", "id").collect()]
    assert got == [("a", 6, "job <*> done"), ("b", 1, "x0"), ("b", 1, "x1"), ("b", 1, "x2")]


def test_streamed_tables(spark, tmp_path):
    """A streamed table may be one file, a folder of files or without rows; other files beside it are none of its own."""
    turns = spark.createDataFrame([(i % 3, i, "user", f"t{i}") for i in range(10)], "conv_id long, turn long, role string, text string")
    for name, rows in (("folder", turns), ("empty", turns.limit(0)), ("single", turns.coalesce(1))):
        rows.write.parquet(str(tmp_path / name / "conversations.parquet"))
    turns.write.parquet(str(tmp_path / "folder" / "conversations.parquet.old"))
    folder = tmp_path / "single" / "conversations.parquet"
    (part,) = folder.glob("*.parquet")
    part.rename(tmp_path / "single" / "file")
    for other in [*folder.iterdir()]:
        other.unlink()
    folder.rmdir()
    (tmp_path / "single" / "file").rename(folder)
    got = lambda name: sorted(map(tuple, catalogue.w3_session_totals(spark, str(tmp_path / name)).collect()))
    assert len([*(tmp_path / "folder" / "conversations.parquet").glob("*.parquet")]) > 1 and folder.is_file()
    assert got("folder") == got("single") == [("0", 4, 4), ("1", 3, 3), ("2", 3, 3)] and got("empty") == []
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        got("missing")


def test_arguments(capsys, monkeypatch):
    assert arguments(["--grouper", "stock", "--samples", "2", "--format", "json"]).grouper == "drain-stock"
    for bad in (["--grouper", "Drain"], ["--samples", "-1"], ["--format", "xml"], ["--nope"]):
        monkeypatch.setattr("sys.stderr", io.StringIO())
        with pytest.raises(SystemExit) as e:
            arguments(bad)
        assert e.value.code == 2


def test_synthetic(spark):
    rows = sources.synthetic_lines(spark, 9).orderBy("line_index").collect()
    assert rows[1]["message"].endswith("invalid user admin from 0.0.0.0 port 10001 ssh2") and rows[8]["message"].endswith("invalid user root [preauth]")
