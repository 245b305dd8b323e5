"""Checks of what a host lets in: codes as in HTTP (413 too large, 400 bad line), null where all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.config import Limits


def body_status(body: Column, limits: Limits = Limits()) -> Column:
    return F.when(F.octet_length(body) > limits.body_bytes, 413)


def line_status(message: Column, limits: Limits = Limits()) -> Column:
    """400 for a null message (a rejected line), 413 for one that is too long."""
    return F.when(message.isNull(), 400).when(F.length(message) > limits.line_chars, 413)


def request_status(lines: DataFrame, request: str, limits: Limits = Limits()) -> DataFrame:
    """(request, status): by the first bad line, or 413 from the line that is one too many."""
    status = F.coalesce(line_status(F.col("message"), limits), F.when(F.col("line_index") >= limits.lines, 413))
    agg = lines.groupBy(request).agg(F.min(F.when(status.isNotNull(), F.struct("line_index", status.alias("status")))).alias("first"))
    return agg.select(request, F.col("first.status").alias("status"))


def samples_status(samples: int, limits: Limits = Limits()) -> int | None:
    return 413 if samples > limits.samples else None
