"""Sessions and online clustering over streams of lines.

Order is that of arrival: rows carry a line_index (an offset, a sequence number) that rises in each
session. State is kept per key in the state store; a session that is idle for its time to live is
forgotten. Windows are projected in batches, from a table that the stream appends to.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logloom.config import Limits, TemplaterConfig
from logloom.functions import text
from logloom.operators.fold import Drain
from logloom.plans import api
from logloom.ship import ship

LINES = "session_id string, line_index long, message string, level string, timestamp string"


def session_totals(stream: DataFrame, ttl_s: int = Limits.ttl_s) -> DataFrame:
    """(session_id, ingested, total) for each session in each micro-batch: lines that came and lines that
    the session has had since it began. Idle sessions end after ``ttl_s`` of processing time."""
    ship(stream.sparkSession)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        came = sum(len(f) for f in frames)
        total = (state.get[0] if state.exists else 0) + came
        state.update((total,))
        state.setTimeoutDuration(ttl_s * 1000)
        yield pd.DataFrame({"session_id": [key[0]], "ingested": [came], "total": [total]})

    # only keys and counts travel
    return stream.select("session_id").groupBy("session_id").applyInPandasWithState(step, "session_id string, ingested long, total long", "total long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def online_drain(stream: DataFrame, cfg: TemplaterConfig = TemplaterConfig(), ttl_s: int = Limits.ttl_s) -> DataFrame:
    """Drain over a stream, one event per line: session_id, n_tokens, line_index, local_id, cluster_size,
    template, update_type. The key is (session, token count), which clusters don't cross; ids count
    within it, and (n_tokens, local_id) names a cluster of a session."""
    ship(stream.sparkSession)
    tokens = stream.select("session_id", "line_index", text.whitespace_tokens(F.coalesce("message", F.lit(""))).alias("tokens")).withColumn("n_tokens", F.size("tokens"))
    depth, sim_th, children = cfg.depth, cfg.sim_th, cfg.max_children

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        drain = pickle.loads(state.get[0]) if state.exists else Drain(depth, sim_th, children)
        rows = pd.concat(list(frames)).sort_values("line_index")
        out = []
        for index, tokens_ in zip(rows["line_index"], rows["tokens"]):
            cluster, update = drain.add(list(tokens_))
            out.append((key[0], key[1], index, cluster.id, cluster.size, cluster.template, update))
        state.update((pickle.dumps(drain),))
        state.setTimeoutDuration(ttl_s * 1000)
        yield pd.DataFrame(out, columns=["session_id", "n_tokens", "line_index", "local_id", "cluster_size", "template", "update_type"])

    schema = "session_id string, n_tokens int, line_index long, local_id long, cluster_size long, template string, update_type string"
    return tokens.groupBy("session_id", "n_tokens").applyInPandasWithState(step, schema, "drain binary", "append", GroupStateTimeout.ProcessingTimeTimeout)


class SessionTable:
    """Lines of sessions in a table partitioned by batch, and projections of their windows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, lines: DataFrame, batch: int) -> None:
        """Add the lines of a batch; a batch that is written again replaces itself."""
        names = [x.split()[0] for x in LINES.split(", ")]
        have = [F.col(n).cast(k).alias(n) if n in lines.columns else F.lit(None).cast(k).alias(n) for n, k in (x.split() for x in LINES.split(", "))]
        assert {"session_id", "line_index", "message"} <= set(lines.columns), names
        lines.select(*have).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def ingest(self, stream: DataFrame, checkpoint: str, then: Callable[[DataFrame], None] | None = None, **trigger) -> StreamingQuery:
        """Append a stream; ``then`` gets the sessions that each micro-batch touched."""

        def batch(df: DataFrame, number: int) -> None:
            self.append(df, number)
            if then is not None:
                then(df.select("session_id").distinct())

        return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def lines(self) -> DataFrame:
        return self.spark.read.schema(LINES).parquet(self.path)

    def sizes(self) -> DataFrame:
        """(session_id, total)."""
        return self.lines().groupBy("session_id").agg(F.count(F.lit(1)).alias("total"))

    def templates(self, cfg: TemplaterConfig = TemplaterConfig(), sessions: DataFrame | None = None) -> DataFrame:
        """Template groups of sessions' whole windows, each time from the lines, with any settings."""
        rows = self.lines()
        if sessions is not None:
            rows = rows.join(sessions.select("session_id"), "session_id", "left_semi")
        return api.template_logs(rows.withColumnRenamed("session_id", "window_id"), cfg)
