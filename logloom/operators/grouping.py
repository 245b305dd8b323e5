"""Groupers: which lines of a window belong together.

Token lists are made by Catalyst expressions; the fold over them depends on order and runs in Python,
once for each key, on rows that Spark has sorted, in a stream of Arrow batches: memory grows with the
clusters of a key and not with its lines. Keys are (window, token count), which no cluster crosses; the
tree groupers also split a token count by first token wherever the tree can't mix them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from logloom.config import PARAM, TemplaterConfig, grouper_name
from logloom.functions import text
from logloom.operators.fold import Drain, FullSearch, Statistical
from logloom.scratch import materialize, parallelism, spread
from logloom.ship import ship

MODES = {"drain": "compact", "drain-stock": "whitespace", "drain-delimited": "delimited", "drain-fullsearch": "whitespace"}


def _keyed(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[bool, tuple]]:
    """Rows of sorted batches, each with whether its first ``keys`` columns differ from the row before."""
    last = None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            now = row[:keys]
            yield now != last, row
            last = now


def is_finer(lines: DataFrame, cfg: TemplaterConfig) -> bool:
    """Whether token counts are split by first token: as configured, else where windows are few."""
    if cfg.finer_keys is not None or cfg.depth < 4:
        return bool(cfg.finer_keys) and cfg.depth >= 4
    tasks = lines.sparkSession.sparkContext.defaultParallelism
    return lines.select("window_id").distinct().limit(tasks).count() < tasks


def split_keys(lines: DataFrame, cfg: TemplaterConfig) -> DataFrame:
    """Adds ``sub``: the first token where (window, token count) can be split by it without changing a
    group (no digit, no literal wildcard, fewer first tokens than children), else empty."""
    first = F.coalesce(F.get("tokens", F.lit(0)), F.lit(""))
    lines = lines.withColumn("first", first)
    plain = F.max((F.col("first").rlike("[0-9]") | (F.col("first") == PARAM)).cast("int")) == 0
    firsts = lines.groupBy("window_id", "n_tokens", "first").agg(F.lit(1).alias("one"))
    # a filter on n_tokens itself would go down to the scan, where all tokens are made once more for it
    long = F.max("n_tokens") >= 2
    safe = firsts.groupBy("window_id", "n_tokens").agg((plain & long & (F.count("one") <= cfg.max_children - 1)).alias("safe"))
    safe = safe.where("safe").select(F.col("window_id").alias("w_"), F.col("n_tokens").alias("n_"))
    joined = lines.join(safe, F.col("window_id").eqNullSafe(F.col("w_")) & (F.col("n_tokens") == F.col("n_")), "left")
    return joined.withColumn("sub", F.when(F.col("n_").isNotNull(), F.col("first")).otherwise("")).drop("first", "w_", "n_")


def _fold(lines: DataFrame, keys: list[str], columns: list[str], make: Callable, schema: str, order: list[str] | None = None) -> DataFrame:
    """Runs ``make()``, a function of a row's ``columns`` that gives output columns, over each key in order."""
    width = len(keys)
    fields = StructType.fromDDL(schema)
    names, kinds = fields.names, [to_arrow_type(f.dataType) for f in fields]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        held: list[tuple] = []
        for new, row in _keyed(batches, width):
            if new:
                step = make()
            held.append(step(row))
            if len(held) >= 20_000:
                yield batch_of(held)
                held = []
        if held:
            yield batch_of(held)

    # a number of its own: rows are few bytes but much work, so partitions aren't joined by their size
    dealt = lines.select(*keys, *columns).repartition(2 * parallelism(lines.sparkSession), *keys)
    return dealt.sortWithinPartitions(*keys, *(order or ["line_index"])).mapInArrow(run, schema)


def lines_of(df: DataFrame, message: str | Column = "message", index: str | Column = "line_index", window: str | Column | None = None) -> DataFrame:
    """A frame with window_id, line_index and message (null: empty) from any frame."""
    ship(df.sparkSession)
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    window_id = F.lit(0).cast("long") if window is None else as_col(window)
    return df.select(window_id.alias("window_id"), as_col(index).cast("long").alias("line_index"), F.coalesce(as_col(message), F.lit("")).alias("message"))


def numbered(firsts: DataFrame, name: str, start: int) -> DataFrame:
    """Rows (window_id, first_index), one a group, with their number in the window in order of first lines."""
    order = Window.partitionBy("window_id").orderBy("first_index")
    return firsts.withColumn(name, F.row_number().over(order).cast("long") + (start - 1))


def with_numbers(rows: DataFrame, firsts: DataFrame, name: str, start: int = 0) -> DataFrame:
    """``rows`` with the number of their group, found by window_id and first_index."""
    found = numbered(firsts.select("window_id", "first_index"), name, start).withColumnsRenamed({"window_id": "w__", "first_index": "f__"})
    return rows.join(found, F.col("window_id").eqNullSafe(F.col("w__")) & (F.col("first_index") == F.col("f__"))).drop("w__", "f__")


def _clustered(lines: DataFrame, keys: list[str], columns: list[str], make: Callable, carry: tuple[str, ...]) -> DataFrame:
    """Output of a fold whose step gives the cluster number of a row: each row's window, index, the first
    line of its cluster, and the columns ``carry``."""
    kind = lines.schema["window_id"].dataType.simpleString()
    at, kinds = len(keys) + len(columns), "".join(f", {c} {lines.schema[c].dataType.simpleString()}" for c in carry)

    def stepper() -> Callable:
        add, firsts = make(), {}

        def step(row: tuple) -> tuple:
            index = row[len(keys)]
            return row[0], index, firsts.setdefault(add(row), index), *row[at:]

        return step

    return _fold(lines, keys, [*columns, *carry], stepper, f"window_id {kind}, line_index long, first_index long{kinds}")


def _tokens(lines: DataFrame, tokens: Column, carry: tuple[str, ...]) -> DataFrame:
    dealt = spread(lines, "line_index").select("window_id", "line_index", tokens.alias("tokens"), *carry)
    return dealt.withColumn("n_tokens", F.size("tokens"))


def tree_groups(lines: DataFrame, cfg: TemplaterConfig, mode: str, carry: tuple[str, ...] = ()) -> DataFrame:
    tokens = _tokens(lines, text.drain_tokens(F.col("message"), mode), carry)
    keyed = split_keys(tokens, cfg) if is_finer(lines, cfg) else tokens.withColumn("sub", F.lit(""))

    def make() -> Callable:
        drain = Drain(cfg.depth, cfg.sim_th, cfg.max_children)
        return lambda row: drain.add_joined(row[4])[0].id

    return _clustered(keyed.withColumn("tokens", F.array_join("tokens", " ")), ["window_id", "n_tokens", "sub"], ["line_index", "tokens"], make, carry)


def full_search_groups(lines: DataFrame, cfg: TemplaterConfig, mode: str = "whitespace", carry: tuple[str, ...] = ()) -> DataFrame:
    tokens = _tokens(lines, text.drain_tokens(F.col("message"), mode), carry)

    def make() -> Callable:
        search = FullSearch(cfg.sim_th)
        return lambda row: search.add_joined(row[3])[0].id

    return _clustered(tokens.withColumn("tokens", F.array_join("tokens", " ")), ["window_id", "n_tokens"], ["line_index", "tokens"], make, carry)


def idf(lines: DataFrame) -> DataFrame:
    """(window_id, token, df, weight): in how many lines of the window an anchor occurs, and its weight."""
    anchors = lines.select("window_id", F.explode(F.array_distinct(F.filter(text.lex(F.col("message")), text.is_anchor))).alias("token"))
    df = anchors.groupBy("window_id", "token").agg(F.count(F.lit(1)).alias("df"))
    n = lines.groupBy("window_id").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("window_id", "w_")
    joined = df.join(n, F.col("window_id").eqNullSafe(F.col("w_")))
    return joined.select("window_id", "token", "df", (F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("weight"))


#: Anchors of all windows up to which their weights go to every task; more are joined token by token.
MAPPED = 100_000


def statistical_groups(lines: DataFrame, cfg: TemplaterConfig, carry: tuple[str, ...] = (), mapped: int = MAPPED) -> DataFrame:
    lines = spread(lines, "line_index")
    lexed = lines.select("window_id", "line_index", text.lex(F.col("message")).alias("tokens"), *carry).withColumn("n_tokens", F.size("tokens"))
    table = materialize(idf(lines).select("window_id", "token", "weight"), "idf")
    few = table.limit(mapped + 1).collect()
    columns, weigh = ["line_index", "tokens"], {}
    if len(few) <= mapped:
        for r in few:
            weigh.setdefault(r.window_id, {})[r.token] = r.weight
    else:
        each = lexed.select("window_id", "line_index", F.explode(F.array_distinct("tokens")).alias("token"))
        named = table.withColumnsRenamed({"window_id": "w__", "token": "t__"})
        each = each.join(named, F.col("window_id").eqNullSafe(F.col("w__")) & (F.col("token") == F.col("t__")))
        lists = each.groupBy(F.col("window_id").alias("w__"), F.col("line_index").alias("l__")).agg(F.map_from_entries(F.collect_list(F.struct("token", "weight"))).alias("weights"))
        lexed = lexed.join(lists, F.col("window_id").eqNullSafe(F.col("w__")) & (F.col("line_index") == F.col("l__")), "left").drop("w__", "l__")
        columns.append("weights")

    def make() -> Callable:
        state = Statistical(static_chars=TemplaterConfig.min_static_chars)
        if len(columns) > 2:
            return lambda row: state.add_joined(row[3], dict(row[4] or ()))
        return lambda row: state.add_joined(row[3], weigh.get(row[0], {}))

    return _clustered(lexed.withColumn("tokens", F.array_join("tokens", " ")), ["window_id", "n_tokens"], columns, make, carry)


def clustered(lines: DataFrame, cfg: TemplaterConfig = TemplaterConfig(), carry: tuple[str, ...] = ()) -> DataFrame:
    """lines: window_id, line_index, message. Rows (window_id, line_index, first_index) and the columns
    ``carry``, from one fold; first_index is the first line of the row's group."""
    name = grouper_name(cfg.grouper)
    if name == "statistical":
        return statistical_groups(lines, cfg, carry)
    if name == "drain-fullsearch":
        return full_search_groups(lines, cfg, carry=carry)
    return tree_groups(lines, cfg, MODES[name], carry)


def group(lines: DataFrame, cfg: TemplaterConfig = TemplaterConfig()) -> DataFrame:
    """lines: window_id, line_index, message. Rows (window_id, line_index, group_id), groups numbered from 0
    in the order of their first lines. The fold's rows are written first, so that it runs once."""
    rows = materialize(clustered(lines, cfg), "clusters")
    return with_numbers(rows, rows.where("first_index = line_index"), "group_id").select("window_id", "line_index", "group_id")


def online(lines: DataFrame, cfg: TemplaterConfig = TemplaterConfig(), masked: bool = True, max_clusters: int | None = None, param: str = PARAM, delimiters: tuple[str, ...] = ()) -> DataFrame:
    """One row per line, in the state just after it: window_id, line_index, cluster_id (1, 2, ... by
    first line), cluster_size, template, update_type. With ``max_clusters`` recency spans all token
    counts, so a whole window is one key."""
    line = text.mask(F.col("message")) if masked else F.col("message")
    tokens = _tokens(lines, text.content_tokens(line, delimiters), ())
    kind = lines.schema["window_id"].dataType.simpleString()
    keys = ["window_id"] if max_clusters is not None else ["window_id", "n_tokens"]
    width = len(keys)

    def make() -> Callable:
        drain, firsts = Drain(cfg.depth, cfg.sim_th, cfg.max_children, max_clusters, param), {}

        def step(row: tuple) -> tuple:
            cluster, update = drain.add_joined(row[width + 1])
            return row[0], row[width], firsts.setdefault(cluster.id, row[width]), cluster.size, cluster.template, update

        return step

    schema = f"window_id {kind}, line_index long, first_index long, cluster_size long, template string, update_type string"
    out = materialize(_fold(tokens.withColumn("tokens", F.array_join("tokens", " ")), keys, ["line_index", "tokens"], make, schema), "events")
    return with_numbers(out, out.where("update_type = 'cluster_created'"), "cluster_id", 1).select("window_id", "line_index", "cluster_id", "cluster_size", "template", "update_type")


def match(trained: DataFrame, queries: DataFrame, cfg: TemplaterConfig = TemplaterConfig(), strategy: str = "never", masked: bool = True) -> DataFrame:
    """Read-only matching of ``queries`` (never masked) with the clusters that ``trained`` leaves: window_id,
    line_index, first_index of the matching cluster and its template, or nulls."""
    line = text.mask(F.col("message")) if masked else F.col("message")
    parts = [df.select("window_id", "line_index", F.lit(k).alias("asks"), text.content_tokens(m).alias("tokens")) for df, k, m in ((trained, 0, line), (queries, 1, F.col("message")))]
    tokens = parts[0].union(parts[1]).withColumn("n_tokens", F.size("tokens"))
    kind = trained.schema["window_id"].dataType.simpleString()

    def make() -> Callable:
        drain, firsts = Drain(cfg.depth, cfg.sim_th, cfg.max_children), {}

        def step(row: tuple) -> tuple:
            _, _, asks, index, tokens_ = row
            if not asks:
                firsts.setdefault(drain.add(tokens_)[0].id, index)
                return None, None, None, None, False
            found = drain.match(tokens_, strategy)
            return row[0], index, firsts[found.id] if found else None, found.template if found else None, True

        return step

    schema = f"window_id {kind}, line_index long, first_index long, template string, asked boolean"
    out = _fold(tokens, ["window_id", "n_tokens"], ["asks", "line_index", "tokens"], make, schema, ["asks", "line_index"])
    return out.where("asked").drop("asked")


def match_all(clusters: DataFrame, queries: DataFrame) -> DataFrame:
    """The ``always`` strategy in expressions alone: clusters (cluster_id, tokens) of one template set, queries
    (line_index, tokens). Joined on token count; all positions agree or are wildcards; most wildcards,
    then smallest id. Rows line_index, cluster_id (null: none)."""
    from logloom.functions.sequences import similarity

    c = clusters.select("cluster_id", F.col("tokens").alias("template"), F.size("tokens").alias("n_"))
    q = queries.select("line_index", "tokens", F.size("tokens").alias("n"))
    joined = q.join(c, F.col("n") == F.col("n_")).withColumn("s", similarity(F.col("template"), F.col("tokens"), include_params=True)).where("s.sim >= 1")
    best = joined.groupBy("line_index").agg(F.max_by("cluster_id", F.struct(F.col("s.params"), -F.col("cluster_id"))).alias("cluster_id"))
    return queries.select("line_index").join(best, "line_index", "left")


def totals(online_rows: DataFrame) -> DataFrame:
    """(window_id, total_size, cluster_count) of unlimited online clustering."""
    return online_rows.groupBy("window_id").agg(F.count(F.lit(1)).alias("total_size"), F.countDistinct("cluster_id").alias("cluster_count"))


def show_cluster(cluster_id: Column, size: Column, template: Column) -> Column:
    return F.format_string("ID=%-5d : size=%-10d: %s", cluster_id, size, template)
