"""Balanced label propagation: linked documents gather in shards of equal count.

Documents that share a hub (here: their text) are linked. Each starts in a
random shard. In every round a hub asks for the shard that most of its
documents are in, and documents ask to move there; the numbers that want to
move between two shards meet in a small table, which grants as many moves as
keep every shard within its quota. Who moves is decided by hash, so nothing
is gathered. At the end unlinked documents (then as few others as possible)
move from shards above their exact quota to those below.

Per hub only counts by shard are formed, summed on each executor first. Hubs
of more than a 4096th of all documents number 4096 at most: they are broadcast
and their documents move one by one; smaller ones are joined by shuffle, move
whole and cannot make a hot task. Documents without a hub skip all joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import counted
from .storage import stored

SHARDS, ROUNDS, SLACK = 8, 4, 0.2
#: A hub above this share (and size) is large.
LARGE, LARGE_ROWS = 4096, 256
#: Hash buckets per shard for exact positions; a bucket's rows share a task.
BUCKETS = 1024


def _unit(*columns: Column | str | int) -> Column:
    """A hash of the columns as a number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*[F.lit(c) if isinstance(c, int) else c for c in columns]), 11) / float(2**53)


def granted_moves(wanted: dict[tuple[int, int], int], sizes: list[int], limit: float) -> dict[tuple[int, int], int]:
    """How many of the ``wanted`` moves (from, to) keep all shards within ``limit``.

    Exchanges between two shards are granted whole; further moves fill the
    room that is left, the largest wishes first.
    """
    granted, sizes = {}, list(sizes)
    for (a, b), n in wanted.items():
        granted[a, b] = min(n, wanted.get((b, a), 0))
    for (a, b), n in sorted(wanted.items(), key=lambda x: (-x[1], x[0])):
        more = max(0, min(n - granted[a, b], int(limit - sizes[b])))
        granted[a, b] += more
        sizes[a] -= more
        sizes[b] += more
    return granted


def _by_case(pairs: dict[tuple[int, int], float], a: str, b: str) -> Column:
    table = F.create_map(*[F.lit(x) for (i, j), v in pairs.items() for x in (f"{i}:{j}", float(v))]) if pairs else None
    return F.lit(0.0) if table is None else F.coalesce(F.try_element_at(table, F.concat_ws(":", a, b)), F.lit(0.0))


def numbered(rows: DataFrame, group: str, order: Column, name: str, groups: int) -> DataFrame:
    """Positions from 0 within each of few ``group`` values, by ``order``.

    ``order`` is in [0, 2). Rows are cut into buckets of it; a bucket's offset is
    the number of rows before it, so no task sorts a whole group.
    """
    cut = rows.withColumn("__order", order).withColumn("__bucket", F.floor(F.col("__order") * BUCKETS).cast("int"))
    counts = cut.groupBy(group, "__bucket").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col(group).alias("__g"), F.col("__bucket").alias("__b"), before.alias("__before"))
    joined = cut.join(F.broadcast(offsets), (F.col(group) == F.col("__g")) & (F.col("__bucket") == F.col("__b")))  # groups * 2 * BUCKETS rows at most
    place = F.row_number().over(Window.partitionBy(group, "__bucket").orderBy("__order", "row")) - 1
    return joined.withColumn(name, (F.col("__before") + place).cast("long")).drop("__order", "__bucket", "__g", "__b", "__before")


def propagate(rows: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``rows(row, hub, ...)`` with ``shard``: linked rows together, counts at most one apart.

    ``row`` is unique and orderable; rows of one ``hub`` are linked, a null hub
    links nothing.
    """
    total = rows.count()
    members = stored(rows.where("hub is not null").groupBy(F.col("hub").alias("of")).agg(F.count("*").alias("members")).where("members > 1"), "hubs")
    large = (F.col("members") * LARGE > total) & (F.col("members") > LARGE_ROWS)
    big = F.broadcast(members.where(large).select("of"))  # fewer than LARGE rows
    linked = rows.where("hub is not null")
    few = linked.join(big, F.col("hub") == F.col("of")).drop("of").withColumn("kind", F.lit(2))
    rest = linked.join(big, F.col("hub") == F.col("of"), "left_anti").join(members.where(~large), F.col("hub") == F.col("of"), "left")
    rest = rest.withColumn("kind", F.col("of").isNotNull().cast("int")).drop("of", "members")
    single = rows.where("hub is null").withColumn("kind", F.lit(0))
    start = F.floor(_unit("row", 1) * shards).cast("int")
    now = stored(single.unionByName(few).unionByName(rest).withColumn("shard", start), "shards")
    limit = total / shards * (1 + SLACK)
    for k in range(rounds):
        votes = now.where("kind > 0").groupBy("hub", "shard", "kind").agg(F.count("*").alias("n"))
        best = votes.groupBy("hub", "kind").agg(F.max(F.struct("n", F.xxhash64("hub", "shard").alias("tie"), "shard")).alias("best")).select(F.col("hub").alias("of"), F.col("kind").alias("of_kind"), F.col("best.shard").alias("wish"))
        single = now.where("kind = 0").withColumn("wish", F.col("shard"))
        few = now.where("kind = 2").join(F.broadcast(best.where("of_kind = 2")), F.col("hub") == F.col("of")).drop("of", "of_kind")
        many = now.where("kind = 1").join(best.where("of_kind = 1"), F.col("hub") == F.col("of")).drop("of", "of_kind")
        asked = stored(single.unionByName(few).unionByName(many), "wishes")
        table = asked.groupBy("shard", "wish", "kind").agg(F.count("*").alias("n")).collect()  # 3 * shards**2 rows at most
        sizes = [sum(r["n"] for r in table if r["shard"] == s) for s in range(shards)]
        odds = {}
        for grade in (1, 2):
            wanted = {(r["shard"], r["wish"]): r["n"] for r in table if r["kind"] == grade and r["shard"] != r["wish"]}
            granted = granted_moves(wanted, sizes, limit)
            odds[grade] = {key: n / wanted[key] for key, n in granted.items()}
            for (a, b), n in granted.items():
                sizes[a] -= n
                sizes[b] += n
        chance = F.when(F.col("kind") == 1, _by_case(odds[1], "shard", "wish")).otherwise(_by_case(odds[2], "shard", "wish"))
        draw = F.when(F.col("kind") == 1, _unit("hub", 2 + k)).otherwise(_unit("row", 2 + k))
        moved = F.when((F.col("shard") != F.col("wish")) & (draw < chance), F.col("wish")).otherwise(F.col("shard"))
        now = asked.withColumn("shard", moved).drop("wish")
    now = stored(now, "shards")

    sizes = {r["shard"]: r["count"] for r in now.groupBy("shard").count().collect()}
    quota = [total // shards + (s < total % shards) for s in sorted(range(shards), key=lambda s: (-sizes.get(s, 0), s))]
    quota = dict(zip(sorted(range(shards), key=lambda s: (-sizes.get(s, 0), s)), quota, strict=True))
    leave = F.when(F.col("kind") == 1, F.lit(1.0)).otherwise(0.0) + F.when(F.col("kind") == 1, _unit("hub", 91)).otherwise(_unit("row", 92) * F.when(F.col("kind") == 2, 0.5).otherwise(0.5) + F.when(F.col("kind") == 2, 0.5).otherwise(0.0))
    placed = numbered(now, "shard", leave, "__place", shards)
    index, at, target, given = F.lit(None).cast("long"), 0, F.lit(None).cast("int"), 0
    for s in range(shards):
        over = max(0, sizes.get(s, 0) - quota[s])
        index = F.when((F.col("shard") == s) & (F.col("__place") < over), F.col("__place") + at).otherwise(index)
        at += over
    placed = placed.withColumn("__index", index)
    for s in range(shards):
        under = max(0, quota[s] - sizes.get(s, 0))
        target = F.when((F.col("__index") >= given) & (F.col("__index") < given + under), F.lit(s)).otherwise(target)
        given += under
    return placed.withColumn("shard", F.coalesce(target, F.col("shard"))).drop("__index", "__place", "kind")


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Every document's shard and position in it, equal texts together.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Size is
    the text's UTF-8 bytes (null: none) plus 1. Shards' counts are at most one
    apart (law ``rows``). Null texts are linked with nothing; empty ones with
    each other. Repeated rows are documents of their own. The result depends on
    the rows alone, not on how they are dealt out. Returns ``doc_id``,
    ``size``, ``text_crc32``, ``hub`` (128 bits of the text), ``law``,
    ``shard``, ``slot`` (gapless from 0 within the shard), ``grown_shard`` (null under this law).
    An empty table gives no rows.
    """
    text = F.col("text").cast("string")
    hub = F.when(text.isNotNull(), F.concat_ws(":", F.hex(F.xxhash64(text)), F.hex(F.xxhash64(F.lit(7), text))))
    rows = docs.select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"), hub.alias("hub")
    )
    rows = counted(rows).withColumn("row", F.struct("doc_id", "hub", "copy")).drop("copy")
    made = propagate(stored(rows, "rows"), shards, rounds)
    slotted = numbered(stored(made, "shards"), "shard", _unit("row", 93), "slot", shards)
    return slotted.select("doc_id", "size", "text_crc32", "hub", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
