"""Entry points: group, profile and project windows of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.config import TemplaterConfig
from logloom.operators import grouping, profile
from logloom.scratch import materialize
from logloom.ship import ship


def with_groups(lines: DataFrame, cfg: TemplaterConfig = TemplaterConfig()) -> DataFrame:
    """Lines with their group_id, all columns kept."""
    named = grouping.group(grouping.lines_of(lines, window="window_id"), cfg)
    inner = {c: f"__{c}_of_group" for c in ("window_id", "line_index")}
    same = F.col("window_id").eqNullSafe(F.col(inner["window_id"])) & (F.col("line_index") == F.col(inner["line_index"]))
    return lines.join(named.withColumnsRenamed(inner), same).select(*(F.col(f"`{c}`") for c in lines.columns), "group_id")


def template_logs(lines: DataFrame, cfg: TemplaterConfig = TemplaterConfig()) -> DataFrame:
    """Template groups of all windows of lines (window_id, line_index, message, perhaps level, timestamp).
    The fold passes each line on with the first line of its group, so lines aren't joined with groups
    again; its rows, which several aggregations read, are written to the shared folder. Groups get
    their numbers last, when there is one row of each."""
    extra = [c for c in ("level", "timestamp") if c in lines.columns]
    whole = lines.select("window_id", F.col("line_index").cast("long").alias("line_index"), F.coalesce("message", F.lit("")).alias("message"), *extra)
    ship(lines.sparkSession)
    rows = materialize(grouping.clustered(whole, cfg, ("message", *extra)), "grouped")
    groups = profile.template_groups(rows.withColumnRenamed("first_index", "group_id"), cfg).drop("id")
    return grouping.numbered(groups, "id", 0).select("window_id", "id", "first_index", "count", "template", "samples", "slots")


def template_groups(lines: DataFrame, cfg: TemplaterConfig = TemplaterConfig()) -> DataFrame:
    """The same for groups of the caller: lines with a group_id column."""
    return profile.template_groups(lines, cfg)
