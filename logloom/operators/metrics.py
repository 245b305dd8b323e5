"""Quality of groups against labels, and bootstrap intervals.

Everything comes from one contingency table of (predicted, labelled) counts: two groups are the same set
of lines exactly if their overlap has the size of both.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.text import normalize_ws


def f1(correct: Column, predicted: Column, labelled: Column) -> Column:
    p, r = correct / predicted, correct / labelled
    return F.when((predicted == 0) | (labelled == 0) | (correct == 0), 0.0).otherwise(2.0 * p * r / (p + r))


def quality(lines: DataFrame, templates: DataFrame | None = None, system: str = "system", pred: str = "group_id", label: str = "label") -> DataFrame:
    """(system, ga, fga, fta, purity, n_lines, n_pred, n_label). lines: a row per line with its system,
    predicted group and label, neither of them null; templates: (system, group, template), for fta."""
    table = lines.groupBy(F.col(system).alias("s"), F.col(pred).alias("p"), F.col(label).alias("l")).agg(F.count(F.lit(1)).alias("n"))
    by_pred = table.groupBy("s", "p").agg(F.sum("n").alias("size"), F.max("n").alias("most"))
    by_label = table.groupBy("s", "l").agg(F.sum("n").alias("size"))
    same = table.alias("t").join(by_pred.alias("a"), ["s", "p"]).join(by_label.alias("b"), ["s", "l"])
    same = same.where("t.n = a.size and t.n = b.size").select("s", "p", "l", "t.n")
    if templates is not None:
        named = templates.select(F.col(system).alias("s"), F.col(pred).alias("p"), normalize_ws(F.col("template")).alias("text"))
        same = same.join(named, ["s", "p"], "left").withColumn("alike", F.coalesce(F.col("text") == normalize_ws(F.col("l").cast("string")), F.lit(False)))
    else:
        same = same.withColumn("alike", F.lit(False))
    exact = same.groupBy("s").agg(F.sum("n").alias("lines"), F.count(F.lit(1)).alias("sets"), F.sum(F.col("alike").cast("long")).alias("alike"))
    preds = by_pred.groupBy("s").agg(F.sum("size").alias("n_lines"), F.count(F.lit(1)).alias("n_pred"), F.sum(F.col("size") - F.col("most")).alias("impure"))
    labels = by_label.groupBy("s").agg(F.count(F.lit(1)).alias("n_label"))
    joined = preds.join(labels, "s").join(exact, "s", "left").fillna(0, ["lines", "sets", "alike"])
    c = F.col
    return joined.select(
        c("s").alias(system),
        (c("lines") / c("n_lines")).alias("ga"),
        f1(c("sets"), c("n_pred"), c("n_label")).alias("fga"),
        f1(c("alike"), c("n_pred"), c("n_label")).alias("fta"),
        (1.0 - c("impure") / c("n_lines")).alias("purity"),
        "n_lines",
        "n_pred",
        "n_label",
    )


def mean(values: Column) -> Column:
    return F.coalesce(F.avg(values), F.lit(0.0))


#: Fixed values of the resampling: multiplier, seeds for means and for paired differences, resamples.
MULTIPLIER, MEAN_SEED, DELTA_SEED, RESAMPLES = 6364136223846793005, 0xC0DA6DAD, 0xC0DA6DE17A, 5000


def _interval(values: list[float], seed: int) -> tuple[float, float]:
    n, state, means = len(values), seed ^ len(values), []
    for _ in range(RESAMPLES):
        total = 0.0
        for _ in range(n):
            state = (state * MULTIPLIER + 1) & (2**64 - 1)
            total += values[(state >> 32) % n]
        means.append(total / n)
    means.sort()
    return means[int(RESAMPLES * 0.025)], means[int(RESAMPLES * 0.975)]


def bootstrap_mean(values: list[float]) -> tuple[float, float]:
    """95% interval of a mean."""
    if len(values) < 2:
        return (values[0], values[0]) if values else (0.0, 0.0)
    return _interval(values, MEAN_SEED)


def bootstrap_delta(candidate: list[float], baseline: list[float]) -> tuple[float, float, float]:
    """Mean of paired differences and its 95% interval; zeros if there are no pairs."""
    if not candidate or len(candidate) != len(baseline):
        return 0.0, 0.0, 0.0
    deltas = [c - b for c, b in zip(candidate, baseline)]
    middle = sum(deltas) / len(deltas)
    return (middle, middle, middle) if len(deltas) == 1 else (middle, *_interval(deltas, DELTA_SEED))


def bootstrap(scores: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """(by, mean, low, high) of a score for each arm, over systems in order. One row per arm and system."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values("o")["v"].tolist()
        low, high = bootstrap_mean(values)
        return pd.DataFrame([[pdf["b"].iloc[0], sum(values) / len(values), low, high]], columns=["b", "mean", "low", "high"])

    rows = scores.select(F.col(by).cast("string").alias("b"), F.col(order).alias("o"), F.col(value).cast("double").alias("v"))
    return rows.groupBy("b").applyInPandas(run, "b string, mean double, low double, high double").withColumnRenamed("b", by)


def last_template(events: DataFrame) -> DataFrame:
    """The base control arm: (window_id, group_id, template) from online events, last seen template."""
    return events.groupBy("window_id", F.col("cluster_id").alias("group_id")).agg(F.max_by("template", "line_index").alias("template"))
