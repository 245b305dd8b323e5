"""Text and JSON forms of template groups, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.text import format_number


def slot_text(slot: Column) -> Column:
    unit = slot["unit"]
    one = F.concat(F.lit("["), format_number(slot["min"]), unit, F.lit("]"))
    span = F.concat(F.lit("["), format_number(slot["min"]), F.lit(".."), format_number(slot["max"]), unit, F.lit(" p50="), format_number(slot["median"]), unit, F.lit("]"))
    shown = F.array_join(slot["samples"], ",")
    words = F.when(slot["distinct"] <= F.size(slot["samples"]), F.concat(F.lit("["), shown, F.lit("]"))).otherwise(F.concat(F.lit("["), slot["distinct"].cast("string"), F.lit("x "), shown, F.lit("]")))
    return F.when(slot["numeric"], F.when(slot["min"] == slot["max"], one).otherwise(span)).otherwise(words)


def group_text(count: Column, template: Column, slots: Column, samples: Column) -> Column:
    """[xN] template slots samples: a | b"""
    shown = F.array_join(F.transform(samples, lambda s: F.replace(s["text"], F.lit("\n"), F.lit("\\n"))), " | ")
    return F.concat(
        F.lit("[x"), count.cast("string"), F.lit("] "), template,
        F.array_join(F.transform(slots, lambda s: F.concat(F.lit(" "), slot_text(s))), ""),
        F.when(F.size(samples) > 0, F.concat(F.lit(" samples: "), shown)).otherwise(""),
    )


def group_lines(groups: DataFrame) -> DataFrame:
    """(window_id, id, line): one text line for each group."""
    return groups.select("window_id", "id", group_text(F.col("count"), F.col("template"), F.col("slots"), F.col("samples")).alias("line"))


def render(groups: DataFrame) -> DataFrame:
    """(window_id, text): all lines of a window. A window's report is one value; for windows with very
    many groups write ``group_lines`` instead."""
    lines = group_lines(groups).groupBy("window_id").agg(F.array_sort(F.collect_list(F.struct("id", "line"))).alias("l"))
    return lines.select("window_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def to_json(groups: DataFrame, pretty: bool = False) -> DataFrame:
    """(window_id, json): groups, original_count, template_count, line_compression, in this order."""
    row = F.struct("id", "first_index", "count", "template", "samples", "slots")
    agg = groups.groupBy("window_id").agg(F.array_sort(F.collect_list(row)).alias("groups"), F.sum("count").alias("original_count"), F.count(F.lit(1)).alias("template_count"))
    whole = F.struct("groups", "original_count", "template_count", (F.col("original_count") / F.col("template_count")).alias("line_compression"))
    return agg.select("window_id", F.to_json(whole, {"ignoreNullFields": "false", "pretty": str(pretty).lower()}).alias("json"))


def stats_line(lines: Column, templates: Column) -> Column:
    ratio = F.when(templates > 0, lines / templates).otherwise(0.0)
    # format_number rounds the double itself, ties to the even digit; format_string rounds its decimal text
    shown = F.replace(F.format_number(ratio, 1), F.lit(","), F.lit(""))
    return F.format_string("%d lines -> %d templates (%sx)", lines, templates, shown)


def char_compression(messages: DataFrame, texts: DataFrame) -> DataFrame:
    """(window_id, char_compression): bytes of the messages with line ends over bytes of the text."""
    a = messages.groupBy("window_id").agg(F.sum(F.octet_length("message") + 1).alias("n"))
    b = texts.select(F.col("window_id").alias("w_"), F.octet_length("text").alias("m"))
    return a.join(b, F.col("window_id").eqNullSafe(F.col("w_"))).select("window_id", (F.col("n") / F.col("m")).alias("char_compression"))
