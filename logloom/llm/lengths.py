"""Token counts from an exact length histogram (operator 8).

Documents are counted by encoded length; from the histogram alone, sums over all longer lengths give
for every context limit the documents that fit, the tokens kept when longer ones are cut, and quantiles.
The sums run in two levels (within a band of lengths, and over bands), so no task sees all lengths
unless they lie in one band. Null text is empty and has length 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logloom.llm.common import materialize, trimmed
from logloom.llm.packing import encoder

#: Lengths in a band of the two-level sums.
BAND = 1024


def token_lengths(docs: DataFrame, json_path: str, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(json_path, ranks_path)
        for batch in batches:
            counts = np.fromiter((len(model.ids(t.as_py())) if t.as_py() else 0 for t in batch.column(1)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts)], ["id", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(trimmed(run), f"id {kind}, n_tokens long")


def histogram(lengths: DataFrame, column: str = "n_tokens") -> DataFrame:
    """One row per length: limit, n_docs; docs_over, tokens_over (strictly longer ones); total_docs,
    total_tokens; kept_tokens (all documents cut to the limit) and quantile (share not longer)."""
    # written, as two branches read it and texts should be encoded once; a row per different length
    counts = materialize(lengths.groupBy(F.col(column).alias("limit")).agg(F.count(F.lit(1)).alias("n_docs")), "lengths")
    counts = counts.withColumn("band", F.floor(F.col("limit") / BAND)).withColumn("tokens", F.col("limit") * F.col("n_docs"))
    bands = counts.groupBy("band").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    # one row per band of lengths: as many as the longest document has thousands of tokens
    later = Window.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    all_bands = Window.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    bands = bands.select("band", total("d", later).alias("d_over"), total("t", later).alias("t_over"), total("d", all_bands).alias("total_docs"), total("t", all_bands).alias("total_tokens"))
    longer = Window.partitionBy("band").orderBy(F.desc("limit")).rowsBetween(Window.unboundedPreceding, -1)
    out = counts.join(bands, "band").withColumn("docs_over", F.col("d_over") + total("n_docs", longer)).withColumn("tokens_over", F.col("t_over") + total("tokens", longer))
    return out.select(
        "limit",
        "n_docs",
        "docs_over",
        "tokens_over",
        "total_docs",
        "total_tokens",
        (F.col("total_tokens") - F.col("tokens_over") + F.col("docs_over") * F.col("limit")).alias("kept_tokens"),
        ((F.col("total_docs") - F.col("docs_over")) / F.col("total_docs")).alias("quantile"),
    )


def kept_at(table: DataFrame, limit: int) -> Column:
    """For any limit, in the table or not: tokens kept when documents are cut to it, as an aggregate."""
    return F.sum(F.col("n_docs") * F.least(F.col("limit"), F.lit(limit)))
