"""Document fingerprints as Merkle trees (operator 4), in DataFrame functions only.

Text is cut, losing no character, into sections (at blank lines), paragraphs (lines) and leaves (four
words). A paragraph's node is the SHA-256 of its text, a section's that of its paragraphs' nodes, and the
root that of the sections' nodes, so equal roots mean equal texts. Below the paragraphs, leaves have
hashes of 32 bits. The fingerprint writes out the root and all leaves in their tree; where roots
differ, ``differing`` goes down the branches and gives the edited paragraphs. Likeness is what two
fingerprints say: 1 for equal roots and otherwise the Dice coefficient of their sets of leaf hashes.

Null text is empty: one section, one paragraph, no leaf; its likeness to any other text is 0. Ids may
be of any type that has an order; null ids come first, in the order of their texts' hashes, and rows
that repeat an id follow each other likewise. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SECTION = r"(?<=\n)(?=[ \t]*\n)"
PARAGRAPH = r"(?<=\n)"
#: Up to four words, of which one longer than 64 characters counts as several, with all white space.
LEAF = r"[^\S\n]*+(?:\S{1,64}+\s*+){1,4}|\s++"
#: Ids in a block of neighbours that are ordered together.
BLOCK = 1024


def tree(text: Column) -> Column:
    """array (sections) of array (paragraphs) of array<long> (leaves)."""
    leaves = lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda x: F.xxhash64(x).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.transform(F.split(text, SECTION, -1), lambda s: F.transform(F.split(s, PARAGRAPH, -1), leaves))


def root(text: Column) -> Column:
    joined = lambda nodes: F.sha2(F.array_join(nodes, ","), 256)
    section = lambda s: joined(F.transform(F.split(s, PARAGRAPH, -1), lambda p: F.sha2(p, 256)))
    return joined(F.transform(F.split(text, SECTION, -1), section))


def fingerprint(nodes: Column, root_hash: Column) -> Column:
    """root:leaf.leaf/leaf.leaf|...: leaves joined by dots, paragraphs by slashes, sections by bars."""
    paragraph = lambda p: F.array_join(F.transform(p, lambda x: F.lower(F.hex(x))), ".")
    section = lambda s: F.array_join(F.transform(s, paragraph), "/")
    return F.concat(root_hash, F.lit(":"), F.array_join(F.transform(nodes, section), "|"))


def leaf_set(nodes: Column) -> Column:
    return F.array_distinct(F.flatten(F.flatten(nodes)))


def likeness(root_a: Column, leaves_a: Column, root_b: Column, leaves_b: Column) -> Column:
    both = F.size(F.array_intersect(leaves_a, leaves_b))
    return F.when(root_a == root_b, 1.0).otherwise(F.coalesce(F.try_divide(2.0 * both, F.size(leaves_a) + F.size(leaves_b)), F.lit(0.0)))


def differing(nodes_a: Column, nodes_b: Column) -> Column:
    """Where two trees differ: array of (section, paragraph) indices of the first tree, whose nodes are
    compared only under sections whose own hashes differ."""
    pairs = F.arrays_zip(nodes_a.alias("a"), nodes_b.alias("b"))

    def paragraphs(s: Column, i: Column) -> Column:
        inner = F.arrays_zip(F.coalesce(s["a"], F.array()).alias("a"), F.coalesce(s["b"], F.array()).alias("b"))
        found = F.transform(inner, lambda p, j: F.when(~p["a"].eqNullSafe(p["b"]), F.struct(i.alias("section"), j.alias("paragraph"))))
        return F.when(F.xxhash64(s["a"]) == F.xxhash64(s["b"]), F.slice(found, 1, 0)).otherwise(F.filter(found, lambda x: x.isNotNull()))

    return F.flatten(F.transform(pairs, paragraphs))


def with_tree(df: DataFrame, text_col: str, prefix: str) -> DataFrame:
    """Adds <prefix>tree, <prefix>root and <prefix>leaves of a text column."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = df.withColumn(f"{prefix}tree", tree(text)).withColumn(f"{prefix}root", root(text))
    return df.withColumn(f"{prefix}leaves", leaf_set(F.col(f"{prefix}tree")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, tree, root, leaves and fingerprint."""
    df = with_tree(docs.select(F.col(id_col), F.col(text_col).alias("_text")), "_text", "")
    return df.drop("_text").withColumn("fingerprint", fingerprint(F.col("tree"), F.col("root")))


def successors(keys: DataFrame, levels: int = 3) -> DataFrame:
    """(k, next_k) for distinct longs k: the next larger one, null at the largest. Ordered in blocks,
    whose first keys are ordered in blocks again, so that one task at last sees few of them."""
    if not levels:
        return keys.select("k", F.lead("k").over(Window.orderBy("k")).alias("next_k"))
    blocks = keys.withColumn("b", F.expr(f"k div {BLOCK}") - (F.col("k") < 0).cast("long"))
    inner = blocks.withColumn("next_k", F.lead("k").over(Window.partitionBy("b").orderBy("k")))
    firsts = blocks.groupBy("b").agg(F.min("k").alias("first"))
    after = successors(firsts.select(F.col("b").alias("k")), levels - 1).join(firsts.withColumnRenamed("b", "next_k"), "next_k", "left").select(F.col("k").alias("b"), "first")
    return inner.join(after, "b").select("k", F.coalesce("next_k", "first").alias("next_k"))


def with_next_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, next_text): the text of the document with the next larger id, of the first after the
    last. Equal ids are ordered by the hash of their texts, null ids come first. Texts move once, to
    their block of ids; only the first text of each block moves to the block before as well."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    if kind in ("bigint", "int", "smallint", "tinyint"):
        block = F.shiftright(F.col(id_col).cast("long"), BLOCK.bit_length() - 1)
    elif kind in ("double", "float") or kind.startswith("decimal"):
        block = F.floor(F.col(id_col) / F.lit(BLOCK)).cast("long")
    else:
        # the first six bytes as a number, in the order of the strings
        block = F.conv(F.rpad(F.left(F.hex(F.encode(F.col(id_col).cast("string"), "utf-8")), F.lit(12)), 12, "0"), 16, 10).cast("long")
    # null ids have blocks below all others, by the leading bits of their hash, which they are ordered by
    block = F.when(F.col(id_col).isNull(), F.shiftright(F.xxhash64(text), 44) - (1 << 60)).otherwise(block)
    rows = docs.select(block.alias("b"), F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    firsts = rows.groupBy("b").agg(F.min(F.struct("id", "h")).alias("at"))
    ring = successors(firsts.select(F.col("b").alias("k")))
    least = firsts.agg(F.min("b").alias("least"))
    ring = ring.crossJoin(F.broadcast(least)).select(F.col("k").alias("b_"), F.coalesce("next_k", "least").alias("next_b"))
    ring = ring.join(firsts.withColumnRenamed("b", "next_b"), "next_b").select("b_", "at")
    edge = ring.join(rows.select("id", "h", "text"), F.col("at.id").eqNullSafe(F.col("id")) & (F.col("at.h") == F.col("h"))).dropDuplicates(["b_"]).select("b_", F.col("text").alias("edge_text"))
    ordered = rows.withColumn("following", F.lead("text").over(Window.partitionBy("b").orderBy("id", "h")))
    joined = ordered.join(edge, (F.col("b") == F.col("b_")) & F.col("following").isNull(), "left")
    return joined.select("id", "text", F.coalesce("following", "edge_text").alias("next_text"))


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints every document, its edited text (second half replaced from the next document) and
    compares: id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next, changed
    (paragraphs of the document that the edit touched)."""
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    df = with_next_text(docs, id_col, text_col).withColumn("edited", edited)
    df = with_tree(with_tree(with_tree(df, "text", ""), "edited", "e_"), "next_text", "n_")
    c = F.col
    return df.select(
        c("id").alias(id_col),
        n.cast("long").alias("n_chars"),
        "edited",
        fingerprint(c("tree"), c("root")).alias("fingerprint"),
        fingerprint(c("e_tree"), c("e_root")).alias("edited_fingerprint"),
        likeness(c("root"), c("leaves"), c("e_root"), c("e_leaves")).alias("near_edited"),
        likeness(c("root"), c("leaves"), c("n_root"), c("n_leaves")).alias("near_next"),
        differing(c("tree"), c("e_tree")).alias("changed"),
    )
