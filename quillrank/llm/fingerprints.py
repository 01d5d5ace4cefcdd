"""Merkle trees over leaves, paragraphs and sections, in DataFrame functions only.

A text's paragraphs are its lines. A paragraph is cut by its content into
leaves of at most 16 code points, restarted after every ``. ! ?`` and line; a
leaf's node is 64 bits of hash. A paragraph's node is the SHA-256 of its
leaves' nodes and its text; a section ends at an empty paragraph or one whose
node starts with "0" (about one in sixteen, so the cut depends on content
alone); a section's node hashes its paragraphs' nodes and the root hashes the
sections' nodes. Equal roots mean equal texts; where roots differ, the
differing section, paragraph and leaf nodes locate the edit.

Two trees' likeness is the weighted Dice share of the nodes, as multisets, that
both have: a leaf weighs its code points, every other node 1. Since the roots
of unequal texts differ, only equal texts have likeness 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import ranked

LEAF = 16
_LEAVES = rf"[^.!?]{{0,{LEAF - 1}}}[.!?]|[^.!?]{{1,{LEAF}}}"
_LONG = (1 << 55) - 1
#: Documents per range whose texts are laid side by side, at least, and the
#: most ranges (their bounds travel with the plan: 24 bytes each).
RANGE_ROWS, MOST_RANGES = 2048, 1 << 19


_EMPTY_NODE = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of no bytes


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def leaf_nodes(text: Column) -> Column:
    """The leaves of every line: structs of ``node`` and ``size`` (code points)."""
    cut = lambda line: F.regexp_extract_all(line, F.lit(_LEAVES), F.lit(0))
    leaf = lambda x: F.struct(F.xxhash64(x).alias("node"), F.char_length(x).alias("size"))
    return F.transform(F.split(text, "\n", -1), lambda line: F.struct(line.alias("text"), F.transform(cut(line), leaf).alias("leaves")))


def paragraph_nodes(lines: Column) -> Column:
    """The node of every line of ``leaf_nodes``; empty lines have the empty text's."""
    named = lambda line: F.concat(F.array_join(F.transform(line["leaves"], lambda x: F.hex(x["node"])), ","), F.lit(":"), line["text"])
    return F.transform(lines, lambda line: F.when(line["text"] == "", F.lit(_EMPTY_NODE)).otherwise(sha256(named(line))))


def section_nodes(paragraphs: Column) -> Column:
    """The node of every section, from its paragraphs' nodes."""
    marked = F.transform(paragraphs, lambda p: F.when(p.startswith("0") | (p == _EMPTY_NODE), F.concat(p, F.lit("|"))).otherwise(p))
    return F.transform(F.filter(F.split(F.array_join(marked, ""), "[|]"), lambda s: s != ""), sha256)


def root_node(sections: Column) -> Column:
    return sha256(F.array_join(sections, ""))


def marks(lines: Column, paragraphs: Column, sections: Column, root: Column) -> Column:
    """All nodes of a tree, sorted, as longs: 55 bits of hash, weight below."""

    def mark(node: Column, weight: Column) -> Column:
        return F.shiftleft(node.bitwiseAND(F.lit(_LONG)), 8).bitwiseOR(weight.cast("long"))

    leaves = F.flatten(F.transform(lines, lambda line: F.transform(line["leaves"], lambda x: mark(x["node"], x["size"]))))
    upper = F.flatten(F.array(F.transform(paragraphs, lambda p: F.xxhash64(p, F.lit(1))), F.transform(sections, lambda p: F.xxhash64(p, F.lit(2))), F.array(F.xxhash64(root, F.lit(3)))))
    return F.sort_array(F.concat(leaves, F.transform(upper, lambda x: mark(x, F.lit(1)))))


def _weight(nodes: Column) -> Column:
    return F.aggregate(nodes, F.lit(0).cast("long"), lambda total, x: total + x.bitwiseAND(F.lit(255).cast("long")))


def likeness(a: Column, b: Column) -> Column:
    """Dice share by weight of the nodes (``marks``) that both trees have.

    Both sides are merged in order; a node of ``b`` counts for one of ``a`` that is
    still open, so repeated nodes count as often as both have them.
    """
    side = lambda x, k: F.transform(x, lambda m: F.shiftleft(m, 1).bitwiseOR(F.lit(k).cast("long")))
    start = F.struct(F.lit(0).cast("long").alias("node"), F.lit(0).alias("open"), F.lit(0).cast("long").alias("shared"))

    def meet(have: Column, x: Column) -> Column:
        node, second, same = F.shiftright(x, 1), x.bitwiseAND(F.lit(1).cast("long")) == 1, F.shiftright(x, 1) == have["node"]
        open_ = F.when(same, have["open"]).otherwise(0)
        hit = second & (open_ > 0)
        return F.struct(node.alias("node"), F.when(hit, open_ - 1).when(second, open_).otherwise(open_ + 1).alias("open"), (have["shared"] + F.when(hit, node.bitwiseAND(F.lit(255).cast("long"))).otherwise(0)).alias("shared"))

    shared = F.aggregate(F.sort_array(F.concat(side(a, 0), side(b, 1))), start, meet)["shared"]
    return 2.0 * shared / (_weight(a) + _weight(b))


def with_tree(docs: DataFrame, text: Column, prefix: str) -> DataFrame:
    """``docs`` with ``<prefix>_lines``, ``_paragraphs``, ``_sections``, ``_root`` and ``_marks``."""
    at = lambda name: F.col(f"{prefix}_{name}")
    made = docs.withColumn(f"{prefix}_lines", leaf_nodes(F.coalesce(text, F.lit("")))).withColumn(f"{prefix}_paragraphs", paragraph_nodes(at("lines")))
    made = made.withColumn(f"{prefix}_sections", section_nodes(at("paragraphs"))).withColumn(f"{prefix}_root", root_node(at("sections")))
    return made.withColumn(f"{prefix}_marks", marks(at("lines"), at("paragraphs"), at("sections"), at("root")))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``tree``: struct of root, sections, paragraphs, leaves, marks.

    A null text counts as empty: one empty paragraph, one section.
    """
    made = with_tree(docs, F.col(text), "__t")
    leaves = F.transform("__t_lines", lambda line: line["leaves"])
    tree = F.struct(F.col("__t_root").alias("root"), F.col("__t_sections").alias("sections"), F.col("__t_paragraphs").alias("paragraphs"), leaves.alias("leaves"), F.col("__t_marks").alias("marks"))
    return made.withColumn("tree", tree).select(*docs.columns, "tree")


def differing(a: Column, b: Column) -> Column:
    """Positions (from 0) of the paragraphs at which tree ``a`` differs from ``b``."""
    at = F.transform(a["paragraphs"], lambda p, i: F.when(F.get(b["paragraphs"], i).eqNullSafe(p), F.lit(-1)).otherwise(i))
    return F.when(a["root"] == b["root"], F.array().cast("array<int>")).otherwise(F.filter(at, lambda i: i >= 0))


def _range_of(key: Column, bounds: list) -> Column:
    """The last range whose bound is not above ``key``, found in two levels."""
    width = max(1, int(len(bounds) ** 0.5))
    one = lambda b: F.struct(F.lit(b[0]).cast("long").alias("k0"), F.lit(b[1]).cast("long").alias("k1"), F.lit(b[2]).cast("long").alias("k2"))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    tops = F.array(*[one(g[0]) for g in groups])
    group = F.greatest(F.size(F.filter(tops, lambda b: b <= key)), F.lit(1))
    inside = F.element_at(F.array(*[F.array(*[one(b) for b in g]) for g in groups]), group)
    return ((group - 1) * width + F.greatest(F.size(F.filter(inside, lambda b: b <= key)), F.lit(1)) - 1).cast("long")


def beside_next(docs: DataFrame) -> DataFrame:
    """Every row of ``docs(doc_id, text)`` with the tree's marks and ``next_*`` of the row after it.

    Rows are ordered by ``doc_id``, nulls first, then by a hash of the text;
    the last row's next is the first. Ranges of equally many rows, told by
    their first rows, are formed without the texts; each range's first row also
    goes to the range before, so the texts move once. Repeated rows (next to
    each other) are told apart by their place in the input, so that they may
    share several ranges.
    """
    keyed = docs.withColumn("__place", F.monotonically_increasing_id())
    key = F.struct(F.col("doc_id").cast("long").alias("k0"), F.xxhash64("text").alias("k1"), F.col("__place").alias("k2"))
    order = ranked(keyed.select(key.alias("key")), [F.asc_nulls_first("key")], "rank")
    rows = order.count()
    each = max(RANGE_ROWS, -(-rows // MOST_RANGES))
    bounds = [(r["key"]["k0"], r["key"]["k1"], r["key"]["k2"]) for r in order.where(F.col("rank") % each == 0).orderBy("rank").select("key").collect()]  # MOST_RANGES at most
    if bounds:
        ranged = keyed.withColumn("__key", key).withColumn("__at", _range_of(F.col("__key"), bounds))
        spark = docs.sparkSession
        heads = spark.createDataFrame([(at, *b) for at, b in enumerate(bounds)], "__own long, k0 long, k1 long, k2 long").select("__own", F.struct("k0", "k1", "k2").alias("__head"))
        ranged = ranged.join(F.broadcast(heads), F.col("__at") == F.col("__own")).withColumn("__first", F.col("__key") == F.col("__head"))
    else:
        ranged = keyed.withColumn("__key", key).withColumn("__at", F.lit(0).cast("long")).withColumn("__first", F.lit(False))
    own = F.struct(F.col("__at").alias("at"), F.lit(False).alias("guest"))
    before = F.struct(F.pmod(F.col("__at") - 1, F.lit(max(1, len(bounds)))).cast("long").alias("at"), F.lit(True).alias("guest"))
    visits = F.when(F.coalesce("__first", F.lit(False)), F.array(own, before)).otherwise(F.array(own))
    dealt = ranged.withColumn("__visit", F.explode(visits)).select("doc_id", "text", "__key", F.col("__visit.at").alias("__at"), F.col("__visit.guest").alias("__guest")).repartition("__at")
    trees = with_tree(dealt, F.col("text"), "own").drop("own_lines", "own_paragraphs", "own_sections")
    window = Window.partitionBy("__at").orderBy("__guest", F.asc_nulls_first("__key"))
    nexts = [F.lead("text").over(window).alias("next_text"), F.lead("own_marks").over(window).alias("next_marks")]
    return trees.select("doc_id", "text", "own_root", "own_marks", "__guest", *nexts).where("not __guest").drop("__guest")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and likenesses.

    ``docs`` needs ``doc_id`` and ``text`` (null: empty); others are ignored.
    The edited text keeps the text but its last floor(n_chars / 2) code points,
    which the first as many of the next document (ascending doc_id, null
    first, equal ids by a hash of the text; after the last: the first) replace.
    Returns per row: ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint`` (roots), ``near_edited``, ``near_next``. A single
    document is its own next; an empty table gives no rows. Repeated rows are
    each other's next.
    """
    placed = beside_next(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    made = placed.select("doc_id", "own_root", "own_marks", "next_marks", n.cast("long").alias("n_chars"), edited.alias("edited"))
    trees = with_tree(made, F.col("edited"), "edited")
    return trees.select(
        "doc_id", "n_chars",
        sha256(F.col("edited")).alias("edited_sha256"),
        F.col("own_root").alias("fingerprint"),
        F.col("edited_root").alias("edited_fingerprint"),
        likeness(F.col("own_marks"), F.col("edited_marks")).alias("near_edited"),
        likeness(F.col("own_marks"), F.col("next_marks")).alias("near_next"),
    )
