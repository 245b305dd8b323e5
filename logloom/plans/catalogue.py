"""The engine's queries over the test tables, and the same in SQL where SQL can say it.

Log lines are derived from events: each type has a sentence of its own, so that token counts, first
tokens and variable parts differ; windows are user_id mod 8 and the order is event_id.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logloom import sources, streaming
from logloom.config import Limits, TemplaterConfig
from logloom.functions import parse, sequences, text
from logloom.operators import grouping, limits, metrics, profile
from logloom.plans import api, render
from logloom.scratch import shared_dir
from logloom.ship import ship

_K = "regexp_extract(props, '([0-9]+)', 1)"
#: The sentence of each type of event; DuckDB and Spark both read it.
MESSAGE = f"""CASE event_type
 WHEN 'view' THEN concat('GET /items/', {_K}, ' by user ', CAST(user_id AS STRING))
 WHEN 'click' THEN concat('click on button ', {_K}, ' at 10.0.0.', CAST(user_id AS STRING), ' port=', CAST(CAST({_K} AS INT) + 1000 AS STRING))
 WHEN 'purchase' THEN concat('order placed for user ', CAST(user_id AS STRING), ' total ', {_K}, 'ms')
 WHEN 'signup' THEN concat('{{"level":"info","user":', CAST(user_id AS STRING), ',"k":', {_K}, '}}')
 ELSE concat('2024-01-01 12:00:00 ERROR worker', CAST(user_id % 7 AS STRING), ' failed code 0x', {_K}, 'a retry ', {_K}) END"""
#: The same for the SQL side, as a common table expression.
LINES = f"WITH lines AS (SELECT user_id % 8 AS window_id, event_id AS line_index, event_type, user_id, {_K} AS k, {MESSAGE.replace('STRING', 'VARCHAR')} AS message FROM events) "
WORDS = "list_filter(string_split_regex(message, '\\s+'), lambda x: x <> '')"
MASKED = "regexp_replace(regexp_replace(regexp_replace(message, '\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}', '<IP>', 'g'), '0x[0-9a-fA-F]+', '<HEX>', 'g'), '\\b[-+]?\\d+\\b', '<NUM>', 'g')"
MASKED_WORDS = f"list_filter(string_split_regex({MASKED}, '\\s+'), lambda x: x <> '')"
LEXED = "regexp_extract_all(message, '[A-Za-z0-9_-]+|[!-,./:-@\\[-^`{-~]')"

_N = f"CAST({_K} AS INT)"
COLOURS = ("red", "green", "blue", "black", "white", "brown", "pink", "grey")
_COLOUR = f"CASE {_N} % 8 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(COLOURS)) + " END"
#: Sentences that the five groupers tell apart in five ways: compact JSON, delimiters inside words, first
#: words that differ, lines without an anchor, and words that agree in one place of three or in two.
MIXED = f"""CASE event_type
 WHEN 'signup' THEN concat('{{"op":"', {_COLOUR}, '","user":', CAST(user_id AS STRING), '}}')
 WHEN 'purchase' THEN concat('order placed ', CASE WHEN {_N} % 2 = 0 THEN 'a=b' ELSE 'a b' END, ' took ', {_K}, 'ms')
 WHEN 'click' THEN concat(CASE WHEN {_N} % 2 = 0 THEN 'alpha' ELSE 'beta' END, ' button pressed on page now')
 WHEN 'view' THEN concat(CAST(user_id AS STRING), ' -- ', {_K})
 ELSE concat('fail ', CASE {_N} % 3 WHEN 0 THEN 'disk full' WHEN 1 THEN 'net down' ELSE 'disk slow' END) END"""
#: What each grouper makes of them, per type: one group, or one of each value of an expression.
_ERROR = "WHEN 'error' THEN concat('e', CAST(k % 3 = 1 AS VARCHAR))"
_BY = {"s": "WHEN 'signup' THEN concat('s', CAST(k % 8 AS VARCHAR))", "p": "WHEN 'purchase' THEN concat('p', CAST(k % 2 AS VARCHAR))", "c": "WHEN 'click' THEN concat('c', CAST(k % 2 AS VARCHAR))", "v": "WHEN 'view' THEN concat('v', CAST(line_index AS VARCHAR))"}
SPLITS = {"drain": "pc", "drain-stock": "spc", "drain-delimited": "c", "drain-fullsearch": "sp", "statistical": "pv"}


def mixed_cte(grouper: str) -> str:
    """SQL: lines, and f with the label of each line's group and the group's first line."""
    label = f"CASE event_type {_ERROR} {' '.join(_BY[x] for x in SPLITS[grouper])} ELSE event_type END"
    lines = f"WITH lines AS (SELECT user_id % 8 AS window_id, event_id AS line_index, event_type, user_id, {_N} AS k, {_COLOUR} AS colour, {MIXED.replace('STRING', 'VARCHAR')} AS message FROM events)"
    return f"{lines}, l AS (SELECT *, {label} AS label FROM lines), f AS (SELECT *, min(line_index) OVER (PARTITION BY window_id, label) AS first_index FROM l) "


Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(window_id, line_index, event_type, user_id, k, message)."""
    ship(spark)
    events = table(spark, sf_dir, "events")
    return events.select((F.col("user_id") % 8).alias("window_id"), F.col("event_id").alias("line_index"), "event_type", "user_id", F.expr(_K).alias("k"), F.expr(MESSAGE).alias("message"))


def mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(window_id, line_index, event_type, k, message)."""
    ship(spark)
    events = table(spark, sf_dir, "events")
    return events.select((F.col("user_id") % 8).alias("window_id"), F.col("event_id").alias("line_index"), "event_type", F.expr(_N).alias("k"), F.expr(MIXED).alias("message"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.body_lines(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body")))


def by_type(lines: DataFrame) -> DataFrame:
    """Closed-form groups: the type, numbered by name."""
    types = F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view")))
    return lines.withColumn("group_id", F.array_position(types, F.col("event_type")) - 1)


TYPE_NUMBER = "list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1"


def s1_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_lines(spark, sf_dir).select("doc_id", "line_index", "line")


def s2_ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = event_lines(spark, sf_dir)
    n = F.col("line_index") % 5
    good = F.concat(F.lit('{"message": "m '), "k", F.lit('", "level": "info"}'))
    odd = F.concat(F.lit('{"message": "m '), "k", F.lit('", "level": 3, "timestamp": "t"}'))
    raw = lines.select("line_index", F.when(n == 0, "not json").when(n == 1, F.concat(F.lit('{"message": '), "k", F.lit("}"))).when(n == 2, odd).when(n == 3, F.concat(good, F.lit(" x"))).otherwise(good).alias("line"))
    return sources.parse_lines(raw, "ndjson")


def s4_body_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 6
    query = F.when(n == 0, "NDJSON").when(n == 1, "Text").when(n == 2, "other")
    kind = F.when(n == 3, "application/json; charset=utf-8").when(n == 4, "text/plain").when(n == 2, "application/x-ndjson")
    return table(spark, sf_dir, "events").select("event_id", parse.body_format(query, kind).alias("format"))


def s7_synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.synthetic_lines(spark, 2_000)


def p1_parse_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.parse_lines(event_lines(spark, sf_dir).select("line_index", F.col("message").alias("line")))


def p1_token_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = event_lines(spark, sf_dir).select(F.explode(text.words(F.col("message"))).alias("token")).distinct()
    return each.select("token", parse.is_time(F.col("token")).alias("is_time"), parse.is_level(F.col("token")).alias("is_level"), text.has_digit(F.col("token")).alias("has_digit"))


def f2_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_lines(spark, sf_dir).select("line_index", text.mask(F.col("message")).alias("masked"))


def f3_f4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("message")
    return event_lines(spark, sf_dir).select("line_index", F.array_join(text.whitespace_tokens(m), "|").alias("words"), F.array_join(text.delimited_tokens(m), "|").alias("delimited"), F.array_join(text.content_tokens(m, ("=", "/")), "|").alias("content"))


def f6_lex(spark: SparkSession, sf_dir: str) -> DataFrame:
    # columns first: an expression inside a lambda is evaluated for every element
    lines = event_lines(spark, sf_dir).withColumn("t", text.lex(F.col("message"))).withColumn("gaps", text.lex_gaps(F.col("message")))
    again = F.array_join(F.zip_with("gaps", "t", lambda g, x: F.concat(g, F.coalesce(x, F.lit("")))), "")
    return lines.select("line_index", F.array_join("t", " ").alias("tokens"), F.size("t").cast("long").alias("n_tokens"), (again == F.col("message")).alias("rebuilt"))


def f8_f9_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("message")
    return event_lines(spark, sf_dir).select("line_index", text.is_compact(m).alias("compact"), F.size(text.drain_tokens(m, "compact")).cast("long").alias("n_compact"), F.size(text.drain_tokens(m, "whitespace")).cast("long").alias("n_words"))


def f11_f12_f13_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = Window.partitionBy("window_id", "event_type").orderBy("line_index")
    pairs = event_lines(spark, sf_dir).withColumn("tokens", text.words(F.col("message"))).withColumn("template", F.lag("tokens").over(before)).where("template is not null")
    merged = sequences.merge(F.col("template"), F.col("tokens"))
    s = sequences.similarity(F.col("template"), F.col("tokens"))
    return pairs.select("line_index", s["sim"].alias("sim"), F.array_join(merged, " ").alias("merged"), F.array_join(sequences.collapse(merged), " ").alias("collapsed"))


def f18_f26_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = event_lines(spark, sf_dir).select(F.explode(text.lex(F.col("message"))).alias("token")).distinct()
    t = F.col("token")
    template = F.concat(F.lit("<*> "), t)
    return each.select("token", text.is_anchor(t).alias("is_anchor"), text.first_number(t).alias("first_number"), text.trailing_unit(t).alias("unit"), text.has_static_anchor(template).alias("anchored"), text.is_useful_template(template).alias("useful"))


def f26_anchor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = text.lex(F.col("message"))
    every = F.transform(tokens, lambda _: F.lit(True))
    return event_lines(spark, sf_dir).select("line_index", text.anchor_count(tokens, every).cast("long").alias("anchors"), text.anchor_chars(tokens, every).cast("long").alias("chars"))


def a1_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grouping.idf(event_lines(spark, sf_dir))
    return found.select("window_id", "token", "df", F.round("weight", 9).alias("weight"))


def a2_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.group_sizes(by_type(event_lines(spark, sf_dir)))


def a3_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = by_type(event_lines(spark, sf_dir))
    found = profile.static_positions(lines.select("window_id", "group_id", text.words(F.col("message")).alias("tokens")))
    return found.select("window_id", "group_id", F.array_join(F.transform("static", lambda s: s.cast("int").cast("string")), "").alias("static"))


def f17_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.templates(_labelled(spark, sf_dir))


def f21_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = F.lit("order placed a=b took <*>ms")
    return mixed_lines(spark, sf_dir).select("line_index", sequences.matches(template, text.trim_ws(F.replace(F.col("message"), F.lit(","), F.lit(""))), text.has_static_anchor(template)).alias("matches"))


def f27_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_ws(F.col("text")).alias("text"))


def f22_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = by_type(event_lines(spark, sf_dir)).where("event_type in ('view', 'purchase')")
    found = lines.select("window_id", "group_id", F.when(F.col("event_type") == "view", "GET /items/<*> by user <*>").otherwise("order placed for user <*> total <*>").alias("template")).distinct()
    return profile.captures(lines, found).select("line_index", F.col("slot").cast("long").alias("slot"), "value")


def a4_a8_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    captured = f22_captures(spark, sf_dir)
    lines = by_type(event_lines(spark, sf_dir)).select("window_id", "group_id", F.col("line_index").alias("l_"))
    s = profile.slot_summaries(captured.join(lines, F.col("line_index") == F.col("l_")).drop("l_"), 6)
    x = F.col("summary")
    return s.select("window_id", "group_id", "slot", x["numeric"].alias("numeric"), x["min"].alias("low"), x["max"].alias("high"), x["median"].alias("median"), x["unit"].alias("unit"), x["distinct"].alias("n_distinct"), F.array_join(x["samples"], ",").alias("samples"))


def a9_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = profile.raw_samples(by_type(event_lines(spark, sf_dir)), 3)
    return s.select("window_id", "group_id", F.array_join(F.col("samples.text"), " | ").alias("samples"))


def _grouped(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return grouping.group(mixed_lines(spark, sf_dir).select("window_id", "line_index", "message"), TemplaterConfig(grouper=name))

    return query


def d1_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = grouping.online(mixed_lines(spark, sf_dir).select("window_id", "line_index", "message"))
    return events.withColumn("cluster_size", F.col("cluster_size").cast("long"))


def d5_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = mixed_lines(spark, sf_dir).select("window_id", "line_index", "message")
    return grouping.match(lines.where("line_index % 2 = 0"), lines.where("line_index % 2 = 1"), strategy="fallback")


def d5_match_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = spark.sql("SELECT * FROM VALUES (1, array('GET', '<*>', 'by', 'user', '<*>')), (2, array('GET', '<*>', 'by', 'user', '8')), (3, array('order', 'placed', 'for', 'user', '9', 'total', '<*>')) AS t(cluster_id, tokens)")
    return grouping.match_all(clusters, event_lines(spark, sf_dir).select("line_index", text.words(F.col("message")).alias("tokens")))


def d8_online_lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.online(event_lines(spark, sf_dir).select("window_id", "line_index", "message"), max_clusters=3)


def d9_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.totals(grouping.online(mixed_lines(spark, sf_dir).select("window_id", "line_index", "message")))


def _mixed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.template_logs(mixed_lines(spark, sf_dir).select("window_id", "line_index", "message"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed lines with groups of the caller: type, and parity of k for orders and clicks."""
    lines = mixed_lines(spark, sf_dir)
    kinds = F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view")))
    half = F.when(F.col("event_type").isin("click", "purchase"), F.col("k") % 2).when(F.col("event_type") == "error", (F.col("k") % 3 == 1).cast("int")).otherwise(0)
    return lines.select("window_id", "line_index", "event_type", "message", (F.array_position(kinds, F.col("event_type")) * 2 + half).alias("group_id"))


def a12_template_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.summary(_mixed_groups(spark, sf_dir))


def a13_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.group_lines(_mixed_groups(spark, sf_dir))


def k1_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.render(_mixed_groups(spark, sf_dir))


def a13_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = document_lines(spark, sf_dir).select(F.col("doc_id").alias("window_id"), "line_index", F.col("line").alias("message"))
    return profile.summary(api.template_logs(lines))


def a14_groups_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.to_json(api.template_groups(_labelled(spark, sf_dir).drop("event_type")))


def a15_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = by_type(event_lines(spark, sf_dir))
    texts = lines.groupBy("window_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), "\n").alias("text"))
    return render.char_compression(lines, texts).select("window_id", F.round("char_compression", 9).alias("char_compression"))


def k3_k4_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    slot = F.struct(F.lit(True).alias("numeric"), v.alias("min"), (v + 1).alias("max"), v.alias("median"), F.lit("ms").alias("unit"), F.lit(2).cast("long").alias("distinct"), F.array(F.lit("a")).alias("samples"))
    return table(spark, sf_dir, "events").select("event_id", text.format_number(v).alias("number"), render.slot_text(slot.withField("max", v)).alias("one"))


def k5_k8_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_lines(spark, sf_dir).select(
        "line_index", text.clip(F.col("message"), 12).alias("clipped"), grouping.show_cluster(F.col("user_id"), F.col("line_index"), F.col("event_type")).alias("shown"), render.stats_line(F.col("line_index"), F.col("user_id") + 1).alias("stats")
    )


def m1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = event_lines(spark, sf_dir)
    # predictions split one type in two and lump two others together
    pred = F.when(F.col("event_type") == "view", F.concat_ws("-", "event_type", F.col("user_id") % 2)).when(F.col("event_type").isin("click", "error"), "mixed").otherwise(F.col("event_type"))
    found = metrics.quality(lines.select(F.col("window_id").alias("system"), pred.alias("group_id"), F.col("event_type").alias("label")))
    return found.select("system", *(F.round(c, 9).alias(c) for c in ("ga", "fga", "purity")), "n_lines", "n_pred", "n_label")


def m4_template_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _labelled(spark, sf_dir)
    # labels are the templates of two types, and another text for the rest
    label = F.when(F.col("event_type") == "click", F.concat(F.split("message", " ")[0], F.lit("  button pressed on page now "))).when(F.col("event_type") == "view", "<*>  -- <*>").otherwise(F.concat(F.lit("other "), F.col("group_id").cast("string")))
    named = lines.withColumnRenamed("window_id", "system").withColumn("label", label)
    found = metrics.quality(named, profile.templates(lines).withColumnRenamed("window_id", "system"))
    return found.select("system", *(F.round(c, 9).alias(c) for c in ("ga", "fga", "fta", "purity")))


def m7_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = m1_quality(spark, sf_dir).select(F.lit("arm").alias("arm"), "system", "purity")
    return metrics.bootstrap(scores, "arm", "system", "purity").select("arm", *(F.round(c, 9).alias(c) for c in ("mean", "low", "high")))


def m9_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = mixed_lines(spark, sf_dir)
    grouped = api.with_groups(lines)
    events = grouping.online(lines.select("window_id", "line_index", "message"))
    base = events.select("window_id", "line_index", F.col("cluster_id").alias("group_id")).join(lines.select("line_index", "event_type"), "line_index")
    arm = lambda df, name: metrics.quality(df.select(F.col("window_id").alias("system"), "group_id", F.col("event_type").alias("label"))).select(F.lit(name).alias("arm"), "system", *(F.round(c, 9).alias(c) for c in ("ga", "fga", "purity")), "n_pred")
    return arm(grouped, "drain").union(arm(base, "online"))


def m10_base_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.last_template(grouping.online(mixed_lines(spark, sf_dir).select("window_id", "line_index", "message")))


def v1_v3_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("line_index"), F.col("text").alias("message"))
    return limits.request_status(turns, "conv_id", Limits(lines=4, line_chars=1_000))


def w1_session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("window_id"), F.col("turn").alias("line_index"), F.col("text").alias("message"))
    return lines.groupBy("window_id").agg(F.count(F.lit(1)).alias("total")).join(profile.summary(api.template_logs(lines)).select("window_id", "original_count"), "window_id")


def _streamed(spark: SparkSession, table_file: str, sf_dir: str, schema: str, query: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """All rows that a stateful query gives out over a table read as a stream until it has no more."""
    base = f"{shared_dir(spark)}/logloom/stream-{uuid.uuid4().hex}"
    path = f"{sf_dir}/{table_file}"
    spark.read.schema(schema).parquet(path)  # a stream takes a missing table for one that may still come
    # as a pattern, the path may be a file or a folder of files
    stream = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
    out = query(stream)
    put_any = False

    def put(df: DataFrame, number: int) -> None:
        nonlocal put_any
        df.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")
        put_any = True

    # processing-time timeouts would go on asking for batches without data after the last row
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        out.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(out.schema).parquet(f"{base}/rows") if put_any else spark.createDataFrame([], out.schema)


def w3_session_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    turns = lambda s: streaming.session_totals(s.select(F.col("conv_id").cast("string").alias("session_id")))
    found = _streamed(spark, "conversations.parquet", sf_dir, "conv_id long, turn long, role string, text string", turns, "update")
    return found.groupBy("session_id").agg(F.sum("ingested").alias("ingested"), F.max("total").alias("total"))


def w7_online_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    lines = lambda s: s.select((F.col("user_id") % 8).cast("string").alias("session_id"), F.col("event_id").alias("line_index"), F.expr(MIXED).alias("message"))
    found = _streamed(spark, "events.parquet", sf_dir, schema, lambda s: streaming.online_drain(lines(s)), "append")
    return found.select(F.col("session_id").cast("long").alias("window_id"), "line_index", "cluster_size", "template", "update_type")


def w5_session_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projections of session windows that were ingested in two batches."""
    lines = mixed_lines(spark, sf_dir).select(F.col("window_id").cast("string").alias("session_id"), "line_index", "message")
    sessions = streaming.SessionTable(spark, f"{shared_dir(spark)}/logloom/sessions-{uuid.uuid4().hex}")
    for n in (0, 1):
        sessions.append(lines.where(F.col("line_index") % 2 == n), n)
    return render.group_lines(sessions.templates()).withColumn("window_id", F.col("window_id").cast("long"))


NAMED = (
    s1_text_lines, s2_ndjson, s4_body_format, s7_synthetic, p1_parse_line, p1_token_predicates, f2_mask, f3_f4_tokens, f6_lex, f8_f9_dispatch, f11_f12_f13_sequences, f18_f26_predicates,
    f26_anchor_counts, a1_idf, a2_sizes, a3_static, f17_templates, f22_captures, a4_a8_slots, a9_samples, d1_online, d5_match, d5_match_all, d8_online_lru, d9_totals, a12_template_logs,
    a13_report, k1_render, f21_matches, f27_normalize, m4_template_accuracy, a13_documents, a14_groups_json, a15_compression, k3_k4_numbers, k5_k8_texts, m1_quality, m7_bootstrap, m9_arms, m10_base_templates, v1_v3_limits, w1_session_windows,
    w3_session_totals, w5_session_templates, w7_online_stream,
)


def queries() -> dict[str, Query]:
    groupers = {f"g{i}_{n.replace('-', '_')}": _grouped(n) for i, n in enumerate(("drain", "drain-stock", "drain-delimited", "drain-fullsearch", "statistical"), 1)}
    return {f.__name__: f for f in NAMED} | groupers


def oracle_sql() -> dict[str, str]:
    nl = "chr(10)"
    groups = "SELECT window_id, line_index, dense_rank() OVER (PARTITION BY window_id ORDER BY first_index) - 1 AS group_id FROM f"
    show = lambda x: f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"
    vary = lambda x: f"CASE WHEN min({x}) <> max({x}) THEN '<*>' ELSE min({x}) END"
    uid, ms = "CAST(user_id AS VARCHAR)", "CAST(k AS VARCHAR) || 'ms'"
    # groups of the drain mode with template, samples, and their slots by hand: two for sign-ups and views (which
    # have no anchor, so nothing is captured), one for orders and for one kind of error
    profiles = f"""{mixed_cte("drain")}, r AS (SELECT *, row_number() OVER (PARTITION BY window_id, label ORDER BY line_index) AS r FROM f),
        g AS (SELECT window_id, label, event_type, min(first_index) AS first_index, count(*) AS count,
            CASE event_type WHEN 'signup' THEN '{{"op":"' || {vary("colour")} || '","user":' || {vary(uid)} || '}}' WHEN 'purchase' THEN CASE WHEN label = 'p0' THEN 'order placed a=b took ' ELSE 'order placed a b took ' END || {vary(ms)}
            WHEN 'view' THEN {vary(uid)} || ' -- ' || {vary("CAST(k AS VARCHAR)")} WHEN 'click' THEN min(message) ELSE 'fail ' || {vary("split_part(message, ' ', 2)")} || ' ' || {vary("split_part(message, ' ', 3)")} END AS template FROM f GROUP BY 1, 2, 3),
        c AS (SELECT window_id, label, line_index, 0 AS slot, CASE event_type WHEN 'signup' THEN colour WHEN 'purchase' THEN {ms} ELSE split_part(message, ' ', 3) END AS value FROM f WHERE event_type IN ('signup', 'purchase') OR label = 'efalse' UNION ALL SELECT window_id, label, line_index, 1, {uid} FROM f WHERE event_type = 'signup'),
        d AS (SELECT window_id, label, slot, value, min(line_index) AS place, row_number() OVER (PARTITION BY window_id, label, slot ORDER BY min(line_index)) AS r FROM c GROUP BY 1, 2, 3, 4),
        n AS (SELECT window_id, label, slot, TRY_CAST(regexp_extract(value, '[0-9]+') AS DOUBLE) AS v, value FROM c),
        s AS (SELECT window_id, label, slot, max(v) IS NOT NULL AS numeric, coalesce(min(v), 0.0) AS low, coalesce(max(v), 0.0) AS high, coalesce(quantile_cont(v, 0.5), 0.0) AS median, max(CASE WHEN value LIKE '%ms' THEN 'ms' ELSE '' END) AS unit, count(DISTINCT value) AS n_distinct FROM n GROUP BY 1, 2, 3),
        t AS (SELECT window_id, label, slot, list(value ORDER BY r) AS samples FROM d WHERE r <= 6 GROUP BY 1, 2, 3),
        z AS (SELECT * FROM s JOIN t USING (window_id, label, slot) UNION ALL SELECT window_id, label, x, false, 0.0, 0.0, 0.0, '', 0, CAST([] AS VARCHAR[]) FROM g, (SELECT 0 AS x UNION ALL SELECT 1) WHERE event_type = 'view'),
        o AS (SELECT window_id, label, slot, CASE WHEN numeric THEN '[' || {show("low")} || '..' || {show("high")} || unit || ' p50=' || {show("median")} || unit || ']' WHEN n_distinct > len(samples) THEN '[' || n_distinct || 'x ' || array_to_string(samples, ',') || ']' ELSE '[' || array_to_string(samples, ',') || ']' END AS shown FROM z),
        p AS (SELECT window_id, label, string_agg(' ' || shown, '' ORDER BY slot) AS slots FROM o GROUP BY 1, 2),
        q AS (SELECT window_id, label, string_agg(message, ' | ' ORDER BY line_index) AS samples FROM r WHERE r <= 3 GROUP BY 1, 2),
        report AS (SELECT window_id, dense_rank() OVER (PARTITION BY window_id ORDER BY first_index) - 1 AS id, '[x' || count || '] ' || template || coalesce(slots, '') || ' samples: ' || q.samples AS line FROM g JOIN q USING (window_id, label) LEFT JOIN p USING (window_id, label)) """
    pick = lambda options: f"list_extract({[*options]!r}, CAST(line_index % {len(options)} AS INT) + 1)"
    label_number = "CASE label WHEN 'c0' THEN 2 WHEN 'c1' THEN 3 WHEN 'efalse' THEN 4 WHEN 'etrue' THEN 5 WHEN 'p0' THEN 6 WHEN 'p1' THEN 7 WHEN 'signup' THEN 8 ELSE 10 END"
    number = "CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END"
    lev = "('error','err','warn','warning','fatal','critical','crit','info','debug','trace','notice')"
    anchor = "(NOT regexp_matches(x, '^[!-,./:-@\\[-^`{-~]$') AND NOT regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Za-z0-9_]'))"
    slots = LINES + f""", c AS (SELECT window_id, {TYPE_NUMBER} AS group_id, line_index, s.slot AS slot, CASE WHEN s.slot = 0 AND event_type = 'view' THEN k WHEN s.slot = 0 THEN CAST(user_id AS VARCHAR) WHEN event_type = 'view' THEN CAST(user_id AS VARCHAR) ELSE k || 'ms' END AS value
        FROM lines, (SELECT 0 AS slot UNION ALL SELECT 1) s WHERE event_type IN ('view', 'purchase')) """
    quality = """, t AS (SELECT system, p, l, count(*) AS n FROM p GROUP BY 1, 2, 3),
            a AS (SELECT system, p, sum(n) AS size, max(n) AS most FROM t GROUP BY 1, 2), b AS (SELECT system, l, sum(n) AS size FROM t GROUP BY 1, 2), x AS (SELECT t.system, sum(t.n) AS lines, count(*) AS sets FROM t JOIN a USING (system, p) JOIN b ON b.system = t.system AND b.l = t.l WHERE t.n = a.size AND t.n = b.size GROUP BY 1),
            y AS (SELECT system, sum(size) AS n_lines, count(*) AS n_pred, sum(size - most) AS impure FROM a GROUP BY 1), z AS (SELECT system, count(*) AS n_label FROM b GROUP BY 1)
            SELECT system, round(coalesce(lines, 0) / n_lines, 9) AS ga, round(coalesce(2.0 * sets / (n_pred + n_label), 0), 9) AS fga, round(1.0 - impure / n_lines, 9) AS purity, CAST(n_lines AS BIGINT) AS n_lines, n_pred, n_label FROM y JOIN z USING (system) LEFT JOIN x USING (system)"""
    m1 = LINES + ", p AS (SELECT window_id AS system, event_type AS l, CASE WHEN event_type = 'view' THEN 'view-' || CAST(user_id % 2 AS VARCHAR) WHEN event_type IN ('click', 'error') THEN 'mixed' ELSE event_type END AS p FROM lines)" + quality
    sql = {
        "s1_text_lines": f"WITH d AS (SELECT doc_id, list_filter(string_split(text, {nl}), lambda x: regexp_matches(x, '\\S')) AS l FROM documents) SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_index, unnest(l) AS line FROM d",
        "s2_ndjson": LINES + "SELECT line_index, 'm ' || k AS message, CASE WHEN line_index % 5 = 2 THEN NULL ELSE 'info' END AS level, CASE WHEN line_index % 5 = 2 THEN 't' END AS timestamp FROM lines WHERE line_index % 5 IN (2, 4)",
        "s4_body_format": "SELECT event_id, CASE WHEN event_id % 6 IN (0, 2, 3) THEN 'ndjson' ELSE 'text' END AS format FROM events",
        "p1_parse_line": LINES + f""", t AS (SELECT line_index, {WORDS} AS w FROM lines), u AS (SELECT line_index, w, CASE WHEN len(w) >= 2 AND regexp_full_match(w[1] || ' ' || w[2], '\\d{{4}}-\\d{{2}}-\\d{{2}}[T ]\\d{{2}}:\\d{{2}}:\\d{{2}}') THEN 2 WHEN regexp_full_match(w[1], '\\d{{4}}-\\d{{2}}-\\d{{2}}|\\d{{10,13}}') THEN 1 ELSE 0 END AS used FROM t),
            v AS (SELECT *, coalesce(list_position(list_transform(w[used + 1:used + 3], lambda x: lower(trim(x, '[](){{}}<>.,;:''\"')) IN {lev}), true), 0) AS place FROM u)
            SELECT line_index, array_to_string(w[used + place + 1:len(w)], ' ') AS message, CASE WHEN place > 0 THEN lower(trim(w[used + place], '[](){{}}<>.,;:''\"')) END AS level, CASE WHEN used > 0 THEN array_to_string(w[1:used], ' ') END AS timestamp FROM v""",
        "p1_token_predicates": LINES + f", t AS (SELECT DISTINCT unnest({WORDS}) AS token FROM lines) SELECT token, regexp_full_match(token, '\\d{{4}}-\\d{{2}}-\\d{{2}}([T ]\\d{{2}}:\\d{{2}}:\\d{{2}}(\\.\\d+)?(Z|[+-]\\d{{2}}:?\\d{{2}})?)?|\\d{{10,13}}') AS is_time, lower(trim(token, '[](){{}}<>.,;:''\"')) IN {lev} AS is_level, regexp_matches(token, '[0-9]') AS has_digit FROM t",
        "f2_mask": LINES + f"SELECT line_index, {MASKED} AS masked FROM lines",
        "f3_f4_tokens": LINES + f"SELECT line_index, array_to_string({MASKED_WORDS}, '|') AS words, array_to_string(list_filter(string_split_regex(regexp_replace({MASKED}, '[=:,{{}}\\[\\]()\"'';]', ' ', 'g'), '\\s+'), lambda x: x <> ''), '|') AS delimited, array_to_string(list_filter(string_split_regex(regexp_replace(message, '[=/]', ' ', 'g'), '\\s+'), lambda x: x <> ''), '|') AS content FROM lines",
        "f6_lex": LINES + f"SELECT line_index, array_to_string({LEXED}, ' ') AS tokens, len({LEXED}) AS n_tokens, true AS rebuilt FROM lines",
        "f8_f9_dispatch": LINES + f", t AS (SELECT line_index, len({WORDS}) <= 1 AND len({LEXED}) >= 6 AND len(list_filter({LEXED}, lambda x: regexp_matches(x, '^[!-,./:-@\\[-^`{{-~]$'))) >= 2 AS compact, len({LEXED}) AS nl, len({MASKED_WORDS}) AS nw FROM lines) SELECT line_index, compact, CASE WHEN compact THEN nl ELSE nw END AS n_compact, nw AS n_words FROM t",
        "f11_f12_f13_sequences": LINES + f""", t AS (SELECT window_id, event_type, line_index, {WORDS} AS b FROM lines), p AS (SELECT line_index, b, lag(b) OVER (PARTITION BY window_id, event_type ORDER BY line_index) AS a FROM t), m AS (SELECT line_index, len(b) AS n, list_transform(list_zip(a, b), lambda x: CASE WHEN x[1] = x[2] THEN x[1] ELSE '<*>' END) AS m FROM p WHERE a IS NOT NULL)
            SELECT line_index, len(list_filter(m, lambda x: x <> '<*>')) / n AS sim, array_to_string(m, ' ') AS merged, regexp_replace(array_to_string(m, ' '), '<\\*>( <\\*>)+', '<*>', 'g') AS collapsed FROM m""",
        "f18_f26_predicates": LINES + f", t AS (SELECT DISTINCT unnest({LEXED}) AS token FROM lines) SELECT token, {anchor.replace('x,', 'token,')} AS is_anchor, TRY_CAST(nullif(regexp_extract(token, '-?\\d+(\\.\\d+)?'), '') AS DOUBLE) AS first_number, regexp_extract(token, '[^A-Za-z]([A-Za-z]+)$', 1) AS unit, regexp_matches(token, '[A-Za-z0-9]') AS anchored, len(regexp_replace(token, '[^A-Za-z0-9]', '', 'g')) >= 3 AS useful FROM t",
        "f26_anchor_counts": LINES + f", t AS (SELECT line_index, list_filter({LEXED}, lambda x: {anchor}) AS a FROM lines) SELECT line_index, len(a) AS anchors, coalesce(len(regexp_replace(array_to_string(a, ''), '[^A-Za-z0-9]', '', 'g')), 0) AS chars FROM t",
        "a1_idf": LINES + f", t AS (SELECT window_id, line_index, unnest(list_distinct(list_filter({LEXED}, lambda x: {anchor}))) AS token FROM lines), n AS (SELECT window_id, count(*) AS n FROM lines GROUP BY 1), d AS (SELECT window_id, token, count(*) AS df FROM t GROUP BY 1, 2) SELECT window_id, token, df, round(ln((n + 1.0) / (df + 1.0)) + 1.0, 9) AS weight FROM d JOIN n USING (window_id)",
        "a2_sizes": LINES + f"SELECT window_id, {TYPE_NUMBER} AS group_id, count(*) AS count, min(line_index) AS first_index FROM lines GROUP BY 1, 2",
        "a3_static": LINES + f", t AS (SELECT window_id, {TYPE_NUMBER} AS group_id, {WORDS} AS w FROM lines), e AS (SELECT window_id, group_id, generate_subscripts(w, 1) AS pos, unnest(w) AS token FROM t), s AS (SELECT window_id, group_id, pos, CAST(CAST(count(DISTINCT token) = 1 AS INT) AS VARCHAR) AS same FROM e GROUP BY 1, 2, 3) SELECT window_id, group_id, string_agg(same, '' ORDER BY pos) AS static FROM s GROUP BY 1, 2",
        "f22_captures": slots + "SELECT line_index, slot, value FROM c",
        "a4_a8_slots": slots + """, v AS (SELECT *, CAST(regexp_extract(value, '[0-9]+') AS DOUBLE) AS n FROM c), f AS (SELECT window_id, group_id, slot, value, min(line_index) AS place FROM c GROUP BY 1, 2, 3, 4), r AS (SELECT *, row_number() OVER (PARTITION BY window_id, group_id, slot ORDER BY place) AS r FROM f),
            s AS (SELECT window_id, group_id, slot, string_agg(value, ',' ORDER BY r) AS samples, max(CASE WHEN r = 1 THEN regexp_extract(value, '[^A-Za-z]([A-Za-z]+)$', 1) END) AS unit FROM r WHERE r <= 6 GROUP BY 1, 2, 3)
            SELECT window_id, group_id, slot, true AS numeric, min(n) AS low, max(n) AS high, quantile_cont(n, 0.5) AS median, any_value(unit) AS unit, count(DISTINCT value) AS n_distinct, any_value(samples) AS samples FROM v JOIN s USING (window_id, group_id, slot) GROUP BY 1, 2, 3""",
        "a9_samples": LINES + f", r AS (SELECT window_id, {TYPE_NUMBER} AS group_id, message, line_index, row_number() OVER (PARTITION BY window_id, event_type ORDER BY line_index) AS r FROM lines) SELECT window_id, group_id, string_agg(message, ' | ' ORDER BY line_index) AS samples FROM r WHERE r <= 3 GROUP BY 1, 2",
        "d5_match_all": LINES + "SELECT line_index, CASE WHEN event_type = 'view' THEN 1 WHEN event_type = 'purchase' AND user_id = 9 THEN 3 END AS cluster_id FROM lines",
        # the clusters of the even lines; masked places match no line, as lines that ask aren't masked
        "d5_match": mixed_cte("drain-stock") + ", e AS (SELECT window_id, label, min(line_index) AS first_index FROM l WHERE line_index % 2 = 0 AND event_type IN ('purchase', 'click', 'error') GROUP BY 1, 2) SELECT l.window_id, line_index, first_index, CASE WHEN first_index IS NULL THEN NULL WHEN event_type = 'click' OR l.label = 'etrue' THEN message WHEN event_type = 'error' THEN 'fail disk <*>' ELSE regexp_replace(message, '[0-9]+ms', '<*>') END AS template FROM l LEFT JOIN e ON e.window_id = l.window_id AND e.label = l.label WHERE line_index % 2 = 1",
        # templates change as soon as a second value is seen in a place
        "d1_online": mixed_cte("drain-stock") + """, v AS (SELECT *, CASE event_type WHEN 'purchase' THEN CAST(k AS VARCHAR) WHEN 'error' THEN split_part(message, ' ', 3) ELSE '' END AS v FROM f), w AS (SELECT *, min(v) OVER so_far <> max(v) OVER so_far AS wild, lag(line_index) OVER (PARTITION BY window_id, label ORDER BY line_index) IS NULL AS created FROM v WINDOW so_far AS (PARTITION BY window_id, label ORDER BY line_index ROWS UNBOUNDED PRECEDING)),
            x AS (SELECT *, lag(wild) OVER (PARTITION BY window_id, label ORDER BY line_index) AS before FROM w) SELECT window_id, line_index, dense_rank() OVER (PARTITION BY window_id ORDER BY first_index) AS cluster_id, row_number() OVER (PARTITION BY window_id, label ORDER BY line_index) AS cluster_size,
            CASE event_type WHEN 'view' THEN '<NUM> -- <NUM>' WHEN 'signup' THEN regexp_replace(message, '[0-9]+', '<NUM>') WHEN 'purchase' THEN CASE WHEN wild THEN regexp_replace(message, '[0-9]+ms', '<*>') ELSE message END WHEN 'error' THEN CASE WHEN wild THEN 'fail disk <*>' ELSE message END ELSE message END AS template,
            CASE WHEN created THEN 'cluster_created' WHEN wild AND NOT before THEN 'cluster_template_changed' ELSE 'none' END AS update_type FROM x""",
        "d9_totals": mixed_cte("drain-stock") + "SELECT window_id, count(*) AS total_size, count(DISTINCT label) AS cluster_count FROM f GROUP BY 1",
        "a12_template_logs": mixed_cte("drain") + "SELECT window_id, count(*) AS original_count, count(DISTINCT label) AS template_count, count(*) / count(DISTINCT label) AS line_compression FROM f GROUP BY 1",
        "a13_report": profiles + "SELECT window_id, id, line FROM report",
        "k1_render": profiles + f"SELECT window_id, string_agg(line, {nl} ORDER BY id) AS text FROM report GROUP BY 1",
        "f17_templates": profiles + f"SELECT window_id, {label_number} AS group_id, template FROM g",
        "a14_groups_json": profiles + f""", sl AS (SELECT window_id, label, list({{'numeric': numeric, 'min': CAST(low AS DOUBLE), 'max': CAST(high AS DOUBLE), 'median': CAST(median AS DOUBLE), 'unit': unit, 'distinct': n_distinct, 'samples': samples}} ORDER BY slot) AS slots FROM z GROUP BY 1, 2),
            sa AS (SELECT window_id, label, list({{'index': line_index, 'text': message, 'level': CAST(NULL AS VARCHAR), 'timestamp': CAST(NULL AS VARCHAR)}} ORDER BY line_index) AS samples FROM r WHERE r <= 3 GROUP BY 1, 2),
            gr AS (SELECT window_id, list({{'id': {label_number}, 'first_index': first_index, 'count': count, 'template': template, 'samples': sa.samples, 'slots': coalesce(sl.slots, [])}} ORDER BY {label_number}) AS groups, sum(count) AS n, count(*) AS m FROM g JOIN sa USING (window_id, label) LEFT JOIN sl USING (window_id, label) GROUP BY 1)
            SELECT window_id, CAST(to_json({{'groups': groups, 'original_count': CAST(n AS BIGINT), 'template_count': m, 'line_compression': CAST(n / m AS DOUBLE)}}) AS VARCHAR) AS json FROM gr""",
        "f21_matches": mixed_cte("drain") + "SELECT line_index, event_type = 'purchase' AND k % 2 = 0 AS matches FROM l",
        "f27_normalize": "SELECT doc_id, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), ' ') AS text FROM documents",
        # four groups are a label's whole set; those of clicks and views have its text as template
        "m4_template_accuracy": mixed_cte("drain") + "SELECT window_id AS system, 1.0 AS ga, 1.0 AS fga, round(CAST(count(DISTINCT CASE WHEN event_type IN ('click', 'view') THEN label END) AS DOUBLE) / count(DISTINCT label), 9) AS fta, 1.0 AS purity FROM f GROUP BY 1",
        "s7_synthetic": f"WITH i AS (SELECT range AS line_index FROM range(2000)) SELECT line_index, replace(replace(replace(replace({pick(sources.SYNTHETIC_LINES)}, '{{user}}', {pick(sources.SYNTHETIC_USERS)}), '{{port}}', CAST(10000 + line_index % 55000 AS VARCHAR)), '{{ip}}', CAST(1 + line_index % 254 AS VARCHAR)), '{{host}}', {pick(sources.SYNTHETIC_HOSTS)}) AS message FROM i",
        "a15_compression": LINES + f", a AS (SELECT window_id, sum(octet_length(encode(message)) + 1) AS n FROM lines GROUP BY 1), b AS (SELECT window_id, string_agg(event_type, {nl} ORDER BY event_type) AS t FROM (SELECT DISTINCT window_id, event_type FROM lines) GROUP BY 1) SELECT window_id, round(n / octet_length(encode(t)), 9) AS char_compression FROM a JOIN b USING (window_id)",
        "k3_k4_numbers": f"SELECT event_id, {number} AS number, '[' || {number} || 'ms]' AS one FROM events",
        "k5_k8_texts": LINES + "SELECT line_index, substr(message, 1, 12) AS clipped, format('ID={:<5d} : size={:<10d}: {}', user_id, line_index, event_type) AS shown, printf('%d lines -> %d templates (%.1fx)', line_index, user_id + 1, line_index / (user_id + 1)) AS stats FROM lines",
        "m1_quality": m1,
        "m7_bootstrap": f"""WITH RECURSIVE m AS ({m1}), a AS (SELECT list(purity ORDER BY system) AS v, count(*) AS n FROM m),
            g AS (SELECT 0 AS i, xor(CAST({metrics.MEAN_SEED} AS HUGEINT), CAST((SELECT n FROM a) AS HUGEINT)) AS state UNION ALL SELECT i + 1, (state * {metrics.MULTIPLIER} + 1) % 18446744073709551616 FROM g WHERE i < {metrics.RESAMPLES} * (SELECT n FROM a)),
            d AS (SELECT (i - 1) // n AS b, avg(v[CAST((state // 4294967296) % n AS BIGINT) + 1]) AS mean FROM g, a WHERE i > 0 GROUP BY 1), s AS (SELECT list(mean ORDER BY mean) AS l FROM d)
            SELECT 'arm' AS arm, round(list_avg(v), 9) AS mean, round(l[{int(metrics.RESAMPLES * 0.025)} + 1], 9) AS low, round(l[{int(metrics.RESAMPLES * 0.975)} + 1], 9) AS high FROM a, s""",
        "m9_arms": " UNION ALL ".join(f"SELECT '{arm}' AS arm, system, ga, fga, purity, n_pred FROM (" + mixed_cte(name) + ", p AS (SELECT window_id AS system, event_type AS l, label AS p FROM f)" + quality + ")" for arm, name in (("drain", "drain"), ("online", "drain-stock"))),
        "v1_v3_limits": "SELECT conv_id, max(CASE WHEN turn >= 4 OR length(text) > 1000 THEN 413 END) AS status FROM conversations GROUP BY 1",
        "w1_session_windows": "SELECT conv_id AS window_id, count(*) AS total, count(*) AS original_count FROM conversations GROUP BY 1",
    }
    online = sql["d1_online"]
    sql["m10_base_templates"] = f"SELECT window_id, cluster_id AS group_id, arg_max(template, line_index) AS template FROM ({online}) GROUP BY 1, 2"
    sql["w7_online_stream"] = f"SELECT window_id, line_index, cluster_size, template, update_type FROM ({online})"
    sql["w5_session_templates"] = sql["a13_report"]
    sql["w3_session_totals"] = "SELECT CAST(conv_id AS VARCHAR) AS session_id, count(*) AS ingested, count(*) AS total FROM conversations GROUP BY 1"
    return sql | {k: mixed_cte(name) + groups for k, name in zip((k for k in queries() if k[0] == "g"), SPLITS)}
