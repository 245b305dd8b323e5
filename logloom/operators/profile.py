"""Templates, slots and samples of groups; everything but the ragged pair template is native.

Positions, slot values and samples are aggregated with map-side partial sums; medians, distinct samples
and raw samples come from windows that sort and spill, so a group may hold any share of the lines.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from logloom.config import PARAM, TemplaterConfig
from logloom.functions import sequences, text
from logloom.operators.fold import pair_template
from logloom.scratch import materialize, spread

KEY = ["window_id", "group_id"]


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> DataFrame:
    """Inner join that also joins null keys; b's keys go."""
    b = b.withColumnsRenamed({n: f"{n}__" for n in names})
    on = None
    for n in names:
        c = F.col(n).eqNullSafe(F.col(f"{n}__"))
        on = c if on is None else on & c
    return a.join(b, on).drop(*(f"{n}__" for n in names))


def first_members(lines: DataFrame, n: int) -> DataFrame:
    """The first n lines of each group, with ``rank`` from 1."""
    order = Window.partitionBy(*KEY).orderBy("line_index")
    return lines.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def group_sizes(lines: DataFrame) -> DataFrame:
    """(window_id, group_id, count, first_index)."""
    return lines.groupBy(*KEY).agg(F.count(F.lit(1)).alias("count"), F.min("line_index").alias("first_index"))


def static_positions(tokens: DataFrame) -> DataFrame:
    """tokens: window_id, group_id, tokens. Per group: ``static`` array<boolean>, true where all members
    have the same token; null where their lengths differ."""
    each = tokens.select(*KEY, F.size("tokens").alias("n"), F.posexplode_outer("tokens").alias("pos", "token"))
    spots = each.groupBy(*KEY, "pos").agg((F.min("token") == F.max("token")).alias("same"), F.min("n").alias("low"), F.max("n").alias("high"))
    static = F.transform(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "same")))), lambda x: x["same"])
    return spots.groupBy(*KEY).agg(F.when(F.min("low") == F.max("high"), static).alias("static"))


def static_against(tokens: DataFrame, first: DataFrame) -> DataFrame:
    """The same as ``static_positions`` from a member of each group: ``first`` has its tokens. Lines are
    compared with it and leave the positions that differ as a word of ones and zeros; of a group's few
    different words the positions are brought together, so tokens themselves never move."""
    both = _same(tokens, first.select(*KEY, F.col("tokens").alias("t0")), KEY)
    bits = F.array_join(F.zip_with("tokens", "t0", lambda x, y: F.when(x == y, "1").otherwise("0")), "")
    words = both.select(*KEY, F.when(F.size("tokens") == F.size("t0"), bits).alias("bits")).groupBy(*KEY, "bits").agg(F.lit(1).alias("one"))
    each = words.select(*KEY, "bits", F.posexplode_outer(F.split("bits", "")).alias("pos", "bit"))
    spots = each.groupBy(*KEY, "pos").agg(F.min("bit").alias("bit"), F.count_if(F.col("bits").isNull()).alias("ragged"))
    # an empty word splits into one empty bit
    known = F.filter(F.array_sort(F.collect_list(F.when(F.col("bit") != "", F.struct("pos", "bit")))), lambda x: x.isNotNull())
    return spots.groupBy(*KEY).agg(F.when(F.sum("ragged") == 0, F.transform(known, lambda x: x["bit"] == "1")).alias("static"))


@F.pandas_udf(StringType())
def _pair(a: pd.Series, b: pd.Series) -> pd.Series:
    # rows of other branches may pass through before their filter, hence the nulls
    return pd.Series([None if x is None or y is None else pair_template(list(x), list(y)) for x, y in zip(a, b)], dtype=object)


def members(lines: DataFrame, n: int) -> DataFrame:
    """(window_id, group_id, members): the first n lines of each group with their metadata, in order."""
    optional = lambda c: (F.col(c) if c in lines.columns else F.lit(None)).cast("string").alias(c)
    sample = F.struct(F.col("line_index").alias("index"), F.col("message").alias("text"), optional("level"), optional("timestamp"))
    return first_members(lines, n).groupBy(*KEY).agg(F.array_sort(F.collect_list(sample)).alias("members"))


def templates(lines: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(window_id, group_id, template): lexical where members have equally many lexical tokens, else by
    words where they have equally many of those, else from the first two members' common words.
    ``groups``: the groups with their count and members, if they are known already."""
    if groups is None:
        groups = _same(group_sizes(lines), members(lines, 2), KEY)
    first = groups.select(*KEY, "count", F.col("members")[0]["text"].alias("m0"), F.get("members", F.lit(1))["text"].alias("m1"))
    # a line alone is its own template, and its tokens needn't be compared
    alone = first.where(F.col("count") == 1).select(*KEY, F.col("m0").alias("template"))
    first = first.where(F.col("count") > 1).drop("count")
    lexical = static_against(lines.select(*KEY, text.lex(F.col("message")).alias("tokens")), first.select(*KEY, text.lex(F.col("m0")).alias("tokens")))
    found = materialize(_same(first, lexical, KEY), "static")
    # columns first: an expression inside a lambda is evaluated for every element
    lexed = found.where("static is not null").withColumn("tokens", text.lex(F.col("m0"))).withColumn("gaps", text.lex_gaps(F.col("m0")))
    plain = lexed.select(*KEY, sequences.lexical_template(F.col("tokens"), F.col("gaps"), F.col("static")).alias("template"))
    ragged = found.where("static is null").select(*KEY, "m0", "m1")
    if not ragged.head(1):
        return alone.union(plain)
    by_word = static_against(lines.select(*KEY, text.words(F.col("message")).alias("tokens")), ragged.select(*KEY, text.words(F.col("m0")).alias("tokens")))
    rest = _same(ragged, by_word, KEY)
    w0, w1 = text.words(F.col("m0")), text.words(F.col("m1"))
    worded = rest.where("static is not null").select(*KEY, sequences.positional_template(w0, F.col("static")).alias("template"))
    paired = rest.where("static is null").select(*KEY, _pair(w0, w1).alias("template"))
    return alone.union(plain).union(worded).union(paired)


def captures(lines: DataFrame, found: DataFrame) -> DataFrame:
    """(window_id, group_id, line_index, slot, value): what each line has at the wildcards of its template;
    value is null where the line doesn't match. found: window_id, group_id, template."""
    # what belongs to a template is made once for a group, and the line once, below the join
    known = found.where(F.contains("template", F.lit(PARAM))).select(*KEY, sequences.literals(F.col("template")).alias("parts"), text.has_static_anchor(F.col("template")).alias("anchor"))
    line = text.trim_ws(F.replace(F.col("message"), F.lit(","), F.lit("")))
    joined = _same(lines.select(*KEY, "line_index", line.alias("line")), known, KEY)
    none = F.array_repeat(F.lit(None).cast("string"), F.size("parts") - 1)
    values = F.coalesce(sequences.capture_between(F.col("parts"), F.col("line"), F.col("anchor")), none)
    return joined.select(*KEY, "line_index", F.posexplode(values).alias("slot", "value"))


def slot_summaries(captured: DataFrame, cap: int) -> DataFrame:
    """(window_id, group_id, slot, summary): numeric if half of the values hold a number, then with minimum,
    maximum and exact median of all; unit of the first value; distinct values, the first ``cap`` of them."""
    slot = [*KEY, "slot"]
    values = captured.groupBy(*slot, "value").agg(F.count(F.lit(1)).alias("n"), F.min("line_index").alias("at"))
    # three aggregations read the distinct values, and the captures below them are the dear part
    values = materialize(values.withColumn("number", text.first_number(F.col("value"))), "values")
    some = F.col("value").isNotNull()
    sums = values.groupBy(*slot).agg(
        F.sum(F.when(some, F.col("n")).otherwise(0)).alias("present"),
        F.sum(F.when(F.col("number").isNotNull(), F.col("n")).otherwise(0)).alias("parsed"),
        F.min("number").alias("low"),
        F.max("number").alias("high"),
        F.count("value").alias("distinct"),
    )
    up_to = Window.partitionBy(*slot).orderBy("number").rangeBetween(Window.unboundedPreceding, 0)
    ranked = values.where("number is not null").select(*slot, "number", F.sum("n").over(up_to).alias("cum"), F.sum("n").over(Window.partitionBy(*slot)).alias("total"))
    middle = lambda k: F.min(F.when(F.col("cum") >= k, F.col("number")))
    medians = ranked.groupBy(*slot).agg(((middle(F.floor((F.col("total") + 1) / 2)) + middle(F.floor(F.col("total") / 2) + 1)) / 2).alias("median"))
    firsts = values.where(some).withColumn("r", F.row_number().over(Window.partitionBy(*slot).orderBy("at", "value"))).where(F.col("r") <= max(cap, 1))
    firsts = firsts.groupBy(*slot).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "value"))), lambda x: x["value"]).alias("samples"))
    keyed = lambda df, p: df.withColumnsRenamed({c: f"{c}{p}" for c in slot})
    on = lambda p: [F.col(c).eqNullSafe(F.col(f"{c}{p}")) for c in slot]
    joined = sums.join(keyed(medians, "_m"), on("_m"), "left").join(keyed(firsts, "_f"), on("_f"), "left")
    numeric = (F.col("parsed") > 0) & (2 * F.col("parsed") >= F.col("present"))
    number = lambda c: F.when(numeric, F.col(c)).otherwise(0.0)
    shown = F.coalesce("samples", F.array().cast("array<string>"))
    summary = F.struct(
        numeric.alias("numeric"),
        number("low").alias("min"),
        number("high").alias("max"),
        number("median").alias("median"),
        F.coalesce(text.trailing_unit(F.get(shown, F.lit(0))), F.lit("")).alias("unit"),
        F.col("distinct").cast("long").alias("distinct"),
        F.slice(shown, 1, cap).alias("samples"),
    )
    return joined.select(*slot, summary.alias("summary"))


def raw_samples(lines: DataFrame, cap: int) -> DataFrame:
    """(window_id, group_id, samples): the first ``cap`` lines with their metadata."""
    return members(lines, cap).withColumnRenamed("members", "samples")


def template_groups(lines: DataFrame, cfg: TemplaterConfig = TemplaterConfig()) -> DataFrame:
    """lines: window_id, line_index, group_id, message, perhaps level and timestamp; groups as the caller
    likes. One row per group: window_id, id, first_index, count, template (clipped), samples, slots."""
    lines = spread(lines, "line_index")
    groups = materialize(_same(group_sizes(lines), members(lines, max(cfg.sample_cap, 2)), KEY), "groups")
    found = materialize(templates(lines, groups), "templates")
    slots = slot_summaries(captures(lines, found), cfg.slot_sample_cap)
    listed = slots.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "summary"))), lambda x: x["summary"]).alias("slots"))
    listed = listed.withColumnsRenamed({c: f"{c}__" for c in KEY})
    joined = _same(groups, found, KEY).join(listed, [F.col(c).eqNullSafe(F.col(f"{c}__")) for c in KEY], "left")
    none = F.array().cast(listed.schema["slots"].dataType)
    return joined.select(
        "window_id", F.col("group_id").alias("id"), "first_index", "count", text.clip(F.col("template"), cfg.template_clip).alias("template"), F.slice("members", 1, cfg.sample_cap).alias("samples"), F.coalesce("slots", none).alias("slots")
    )


def summary(groups: DataFrame) -> DataFrame:
    """(window_id, original_count, template_count, line_compression) of template groups."""
    agg = groups.groupBy("window_id").agg(F.sum("count").alias("original_count"), F.count(F.lit(1)).alias("template_count"))
    return agg.withColumn("line_compression", F.when(F.col("template_count") > 0, F.col("original_count") / F.col("template_count")).otherwise(0.0))


def line_groups(groups: DataFrame) -> Column:
    """Number of groups of all windows, without profiles."""
    return F.countDistinct("window_id", "group_id")
