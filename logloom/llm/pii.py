"""Personal data by bootstrapped contextual extraction (operator 2), in DataFrame functions only.

Seeds are base matches of four kinds (email, ip, card, phone). What is like an identifier (a word that
holds a digit or an at sign) is an instance; the two words before it are a lexical pattern. Patterns
and instances form a graph that is scored in rounds: a pattern is as good as the instances it
introduces, an instance as certain as the patterns that introduce it, and certain instances bring in
further patterns like seeds. Patterns of high confidence at last mark instances of their kind's shape that no base match has seen. Base matches always stay.

Null text is empty. Repeated rows are counted as documents of their own. Offsets are code points, ends
exclusive. Patterns can be as common as they like: they are summed before they move, and joins on them
can be split. Very long texts are searched whole; every expression is free of repeated rescans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logloom.llm.common import materialize

KINDS = ("email", "ip", "card", "phone")
#: The base expressions; runs are possessive and begin where a run begins, which finds the same
#: leftmost matches in linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold to be searched at all.
HINT = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: What a discovered instance must look like.
SHAPE = {
    "email": r"[^@]+@[^@]+",
    "ip": r"[0-9A-Fa-f]+([.:][0-9A-Fa-f]*){3,}",
    "card": r"(?:[^0-9]*[0-9]){12,19}[^0-9]*",
    "phone": r"(?:[^0-9A-Za-z]*[0-9]){7,15}",
}
#: Characters of a gap that a context may come from.
TAIL = 64
WORD = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"\A(?:{OCTET}\.){{3}}{OCTET}\z")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _with_gaps(kind: str, pattern: str) -> Column:
    """Matches of a kind in m_<kind>, each with the length and the end of what stands before."""
    hits = F.col(f"m_{kind}")
    before = F.transform(F.slice(F.split("text", pattern, -1), F.lit(1), F.size(hits)), lambda g: F.struct(F.char_length(g).alias("gap"), F.right(g, F.lit(TAIL)).alias("tail")))
    zipped = F.zip_with(before, hits, lambda g, m: F.struct(F.lit(kind).alias("kind"), g["gap"].alias("gap"), g["tail"].alias("tail"), m.alias("match")))
    return F.when(F.size(hits) > 0, zipped)


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rid, id, h, found): the hash of the text and, for each kind and for words, matches in order, each with
    what stands before it since the last one: its length and its end. No text moves."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    df = df.withColumn("digits", F.col("text").rlike("[0-9]"))
    none = F.array().cast("array<string>")
    expressions = BASE | {"word": WORD}
    for kind, pattern in expressions.items():
        hint = F.col("digits") if kind != "email" else F.lit(True)
        if kind == "word":
            hint = F.col("digits") | F.contains("text", F.lit("@"))
        elif HINT[kind]:
            hint &= F.contains(F.col("text"), F.lit(HINT[kind]))
        df = df.withColumn(f"m_{kind}", F.when(hint, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
    items = [_with_gaps(kind, pattern) for kind, pattern in expressions.items()]
    kept = [F.coalesce(x, F.array().cast("array<struct<kind:string,gap:int,tail:string,match:string>>")) for x in items]
    return df.select("rid", "id", "h", F.array(*kept).alias("found"))


def places(scanned: DataFrame) -> DataFrame:
    """(rid, kind, start, end, match, tail) of all matches, before they are tested; tail is the end of the
    text before the match, back to the second match of its kind before it if the gaps are short."""
    one = scanned.select("rid", F.explode("found").alias("list")).select("rid", F.posexplode("list").alias("i", "m"))
    order = Window.partitionBy("rid", "m.kind").orderBy("i")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    # a gap may hold fewer than two words; the words before it are then the matches and gaps before
    before = F.concat(*(F.coalesce(F.lag(f"m.{c}", k).over(order), F.lit("")) for k in (2, 1) for c in ("tail", "match")), F.col("m.tail"))
    tail = F.when(F.col("m.gap") >= TAIL, F.col("m.tail")).otherwise(before)
    end = F.sum(F.col("m.gap").cast("long") + F.char_length("m.match")).over(so_far)
    return one.withColumn("end", end).select("rid", "m.kind", (F.col("end") - F.char_length("m.match")).alias("start"), "end", "m.match", tail.alias("tail"))


def seed_kind(word: Column) -> Column:
    """Kind of the base match that a word is or begins, null if none."""
    core = F.regexp_replace(word, r"^[\"'(<\[]+|[\"')>\].,;:!?]+$", "")
    digits = F.regexp_replace(core, "[^0-9]", "")
    return (
        F.when(core.rlike(r"\A[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+\z"), "email")
        .when(core.rlike(rf"\A(?:{OCTET}\.){{3}}{OCTET}\z"), "ip")
        .when(word.rlike(r"\A\+[0-9]"), "phone")
        .when(core.rlike(r"\A[0-9-]{14,}\z") & F.length(digits).between(14, 19) & F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False), "card")
    )


def shaped(instance: Column, kind: Column) -> Column:
    """Whether an instance looks like one of its kind."""
    out = F.lit(False)
    for k in KINDS:
        out = F.when(kind == k, instance.rlike(rf"\A{SHAPE[k]}\z")).otherwise(out)
    return out


def bootstrap(words: DataFrame, rounds: int = 3, least_seeds: int = 4, confident: float = 0.6, smoothing: float = 1.0, certain: float = 0.6) -> DataFrame:
    """words: pattern, instance, seed (kind or null). Typed patterns of high confidence: (pattern, kind,
    confidence). Confidence is the certainty of a pattern's distinct instances over their number. In each
    round every pattern that introduces ``least_seeds`` instances enters, seeds or such as have the kind's shape
    and are ``certain`` by the patterns held so far."""
    graph = materialize(words.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "graph")
    sizes = graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("instances"))
    known = materialize(graph.where("seed is not null").select("instance", F.col("seed").alias("kind")).distinct(), "known")
    begun = graph.where("seed is not null").groupBy("pattern", F.col("seed").alias("kind")).agg(F.count(F.lit(1)).alias("seeds")).where(F.col("seeds") >= least_seeds)
    begun = begun.join(sizes, "pattern").select("pattern", "kind", "instances", (F.col("seeds") / (F.col("instances") + smoothing)).alias("confidence"))
    patterns = materialize(begun, "patterns")
    for _ in range(rounds):
        if not patterns.head(1):
            break
        typed = graph.join(patterns.select("pattern", "kind", "confidence"), "pattern")
        belief = 1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.99)))))
        # what is a seed of any kind is certain of that and of no other
        found = typed.join(known.select("instance"), "instance", "left_anti").groupBy("instance", "kind").agg(belief.alias("score"))
        scores = materialize(found.where("score > 0").withColumn("firm", (F.col("score") >= certain) & shaped(F.col("instance"), F.col("kind"))).union(known.select("instance", "kind", F.lit(1.0), F.lit(True))), "scores")
        # over the whole graph, so that these instances lead to patterns not held yet
        again = graph.select("pattern", "instance").join(scores, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("score"), F.count_if("firm").alias("firm")).where(F.col("firm") >= least_seeds)
        patterns = materialize(again.join(sizes, "pattern").select("pattern", "kind", "instances", (F.col("score") / (F.col("instances") + smoothing)).alias("confidence")), "patterns")
    best = Window.partitionBy("pattern").orderBy(F.desc("confidence"), "kind")
    good = patterns.where(F.col("confidence") >= confident).withColumn("r", F.row_number().over(best)).where("r = 1")
    return good.select("pattern", "kind", "confidence")


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row per document: id and spans array<struct<start,rank,kind,end,base,match>> in order of
    start and kind; base is false for what the patterns discovered. Contexts are the two words before,
    within the last ``TAIL`` characters."""
    out = _extracted(docs, id_col, text_col, **settings)
    return out.select(F.col("id").alias(id_col), "spans")


def _extracted(docs: DataFrame, id_col: str, text_col: str, **settings) -> DataFrame:
    """(id, h, spans), h the hash of the text."""
    scanned = materialize(scan(docs, id_col, text_col), "scanned")
    found = materialize(places(scanned), "places")
    checks = F.lit(False)
    for kind in KINDS:
        checks = F.when(F.col("kind") == kind, valid(kind, F.col("match"))).otherwise(checks)
    valid_base = found.where(F.col("kind") != "word").where(checks)
    base = valid_base.select("rid", "kind", "start", "end", "match", F.lit(True).alias("base"))
    # trailing punctuation isn't part of an instance
    word = F.regexp_extract("match", r"\A[\"'(<\[]*+(.*?)[\"')>\].,;:!?]*\z", 1)
    lead = F.char_length(F.regexp_extract("match", r"\A[\"'(<\[]*+", 0))
    context = F.lower(F.regexp_replace(F.regexp_extract("tail", r"(?:\S+\s+){1,2}\z", 0), r"\s+", " ")).alias("pattern")
    # words and seeds share contexts: a seed has that of the word it begins, and words in a base match are no instances
    spots = found.where("kind = 'word'").select("rid", (F.col("start") + lead).alias("start"), word.alias("instance"), context, seed_kind(F.col("match")).alias("seed"), F.lit(False).alias("base"), F.lit(None).cast("long").alias("end"))
    spots = spots.union(base.select("rid", "start", F.col("match").alias("instance"), F.lit(None).cast("string"), F.col("kind"), "base", "end"))
    here = Window.partitionBy("rid").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    at = Window.partitionBy("rid", "start")
    spots = materialize(spots.withColumn("reached", F.max("end").over(here)).withColumn("pattern", F.max("pattern").over(at)), "spots")
    seeds = spots.where("base").select("pattern", "instance", "seed")
    words = spots.where("not base and seed is null and (reached is null or reached <= start)").select("rid", "start", "instance", "pattern")
    words = words.where("pattern <> '' and instance <> ''")
    patterns = bootstrap(seeds.where("pattern <> ''").union(words.select("pattern", "instance", F.lit(None).cast("string"))), **settings)
    fresh = words.join(patterns, "pattern").where(shaped(F.col("instance"), F.col("kind")))
    fresh = fresh.select("rid", "kind", "start", (F.col("start") + F.char_length("instance")).alias("end"), F.col("instance").alias("match"), F.lit(False).alias("base"))
    ordered = Window.partitionBy("rid").orderBy("start", F.desc("base"), "end")
    reached = F.max(F.when(F.col("base"), F.col("end"))).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    coming = F.min(F.when(F.col("base"), F.col("start"))).over(ordered.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(reached, F.lit(-1)) <= F.col("start")) & (F.coalesce(coming, F.col("end")) >= F.col("end"))
    every = base.union(fresh).withColumn("free", free).where("base or free")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    spans = every.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end", "base", "match"))).alias("spans"))
    empty = F.array().cast("array<struct<start:bigint,rank:bigint,kind:string,end:bigint,base:boolean,match:string>>")
    return scanned.select("rid", "id", "h").join(spans, "rid", "left").select("id", "h", F.coalesce("spans", empty).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """Text with what ``spans`` (in order of their starts) cover replaced by <KIND>, cut by offsets. Spans that
    overlap become one mark, of the kind that begins first."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("pieces"))

    def step(s: Column, x: Column) -> Column:
        new = F.array(F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">")))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(x["start"] >= s["at"], F.concat(s["pieces"], new)).otherwise(s["pieces"]).alias("pieces"))

    def finish(s: Column) -> Column:
        return F.array_join(F.concat(s["pieces"], F.array(F.substring(text, (s["at"] + 1).cast("int"), F.char_length(text)))), "")

    return F.aggregate(spans, start, step, finish)


def without_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars", **settings) -> DataFrame:
    """The rows of ``docs`` with base matches and discovered instances masked at their places, all columns
    kept. Null texts stay null, rows that repeat id and text are masked alike; ``size_col`` is counted again.
    Rows are found by id and text hash, by a merge at every size, as the spans grow with the corpus."""
    spans = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans")
    held = materialize(_extracted(docs, id_col, text_col, **settings).where(F.size("spans") > 0).dropDuplicates(["id", "h"]).select("id", "h", spans), "spans")
    inner = {c: f"__{c}_of_pii" for c in ("id", "h", "spans")}
    held = held.withColumnsRenamed(inner)
    text = F.col(f"`{text_col}`")
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(inner["id"])) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col(inner["h"]))
    found = F.col(inner["spans"])
    new = {text_col: F.when(found.isNull(), text).otherwise(masked(text, found))}
    joined = docs.join(held.hint("merge"), same, "left").withColumn("__text_of_pii", new[text_col])
    new = {text_col: F.col("__text_of_pii")}
    if size_col in docs.columns:
        new[size_col] = F.when(found.isNull(), F.col(f"`{size_col}`")).otherwise(F.char_length("__text_of_pii")).cast(dict(docs.dtypes)[size_col])
    return joined.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))
