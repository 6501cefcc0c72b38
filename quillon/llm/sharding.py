"""Sharding, native: minimax contiguous partition of ordered atomic groups.

Rows with equal texts are one atomic group, known by the text's MD5; groups are ordered by it. A map-side aggregate gives
the group sizes. The smallest capacity that n_shards shards can hold is found by binary search with a greedy check, and the
greedy cuts at it are the shards. The search runs over cells: stretches of the order that share leading digits of the hash, with
their total size, so what the driver holds is bounded (16**FIRST_DIGITS cells, and MOST_CELLS after that). A cell of several groups
is known by two bounds: cut nowhere inside, a greedy sweep needs the most capacity and cuts earliest; cut anywhere, it needs
the least and cuts latest. Between these lies the true sweep. Only the cells in which a cut may fall are cut into smaller
ones, by one aggregate over their groups, until both sweeps agree on the capacity and on every cut; each round a cell shrinks
by a factor of 16 or more. Rows find their shard by comparing their own hash with the cuts, so no map is joined.

Slots number a shard's rows without gaps. Rows are dealt to SLOT_BUCKETS buckets per shard by a hash of the id, which a
group of equal texts cannot crowd; bucket counts (n_shards x SLOT_BUCKETS rows) give each bucket its first slot, and
row_number() numbers the rows inside it.

Defined results: a null text is empty; a row's size is its UTF-8 bytes plus 1. All null and empty texts share a shard.
Rows that repeat an id get slots of their own, in an order that a tie between equal rows cannot change. One group larger
than an even share makes a shard of its own size; shards may stay empty. An empty table gives an empty result. Columns
other than the id and the text play no part.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .staging import materialise, release

SLOT_BUCKETS = 1024
#: Digits of the hash in the first round, and cells that a round may make.
FIRST_DIGITS, MOST_CELLS = 4, 1 << 18


@dataclass(frozen=True)
class Cell:
    """Groups whose hash begins with prefix: their total size, and whether there is one only."""

    prefix: str
    size: int
    single: bool


def _cells(groups: DataFrame, parents: list[Cell], digits: int) -> list[Cell]:
    """The groups of parents (all groups if there are none) in cells that are `digits` digits smaller, in order."""
    parts = []
    for length in sorted({len(p.prefix) for p in parents} or {0}):
        own = [p.prefix for p in parents if len(p.prefix) == length]
        within = groups.filter(F.substring("h", 1, length).isin(own)) if own else groups
        parts.append(within.groupBy(F.substring("h", 1, length + digits).alias("prefix")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")))
    return sorted((Cell(r["prefix"], r["size"], r["n"] == 1) for r in reduce(DataFrame.unionByName, parts).collect()), key=lambda c: c.prefix)


def _sweep(ends: list[int], solid: list[bool], capacity: int, n_shards: int, fluid: bool) -> list[int] | None:
    """Where n_shards greedy shards end in running sums, null if they can't hold all. ends: running sums of the cells; fluid: cells that aren't solid may be cut anywhere."""
    cuts: list[int] = []
    for _ in range(n_shards):
        limit = (cuts[-1] if cuts else 0) + capacity
        if limit >= ends[-1]:
            return [*cuts, *[ends[-1]] * (n_shards - len(cuts))]
        at = bisect_right(ends, limit)
        cuts.append(limit if fluid and not solid[at] else ends[at - 1] if at else 0)
    return None


def _least(ends: list[int], solid: list[bool], low: int, n_shards: int, fluid: bool) -> int:
    """The smallest capacity from low on at which the sweep holds all."""
    high = max(low, ends[-1])
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if _sweep(ends, solid, middle, n_shards, fluid) else (middle + 1, high)
    return low


def minimax_cuts(groups: DataFrame, n_shards: int) -> tuple[int, list[str]]:
    """(the smallest capacity at which n_shards greedy shards hold all groups (h, size), for each cut the prefix of the hashes that stand last before it)."""
    largest = groups.agg(F.max("size")).first()[0]
    if largest is None:
        return 0, []
    cells = _cells(groups, [], FIRST_DIGITS)
    while True:
        ends, solid = list(accumulate(c.size for c in cells)), [c.single for c in cells]
        low = _least(ends, solid, max(largest, -(-ends[-1] // n_shards)), n_shards, True)
        high = _least(ends, solid, low, n_shards, False)
        #: Cuts only move to the right as capacity grows, so each true cut lies between these.
        early, late = (_sweep(ends, solid, low, n_shards, False) or _earliest(ends, low, n_shards)), _sweep(ends, solid, high, n_shards, True)
        if low == high and early == late:
            return low, [cells[bisect_left(ends, x)].prefix for x in sorted(set(early) - {ends[-1], 0})]
        open_ = [c for k, c in enumerate(cells) if not c.single and any(a < ends[k] and b > ends[k] - c.size for a, b in zip(early, late, strict=True))]
        digits = 1
        while digits < 4 and len(open_) * 16 ** (digits + 1) <= MOST_CELLS:
            digits += 1
        finer, gone = _cells(groups, open_, digits), {c.prefix for c in open_}
        cells = sorted([*finer, *(c for c in cells if c.prefix not in gone)], key=lambda c: c.prefix)


def _earliest(ends: list[int], capacity: int, n_shards: int) -> list[int]:
    """Where shards end at the earliest if no cell is cut, though the last may not hold what is left; a cell that no shard can hold stays before the cut."""
    cuts: list[int] = []
    for _ in range(n_shards):
        at = bisect_right(ends, (cuts[-1] if cuts else 0) + capacity)
        cuts.append(ends[at - 1] if at else 0)
    return cuts


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, size, text_crc32, shard (0 to n_shards - 1), slot (gapless from 0 in its shard)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = materialise(
        docs.select(F.col(id_col).alias("id"), text.alias("t")).select("id", (F.octet_length("t").cast("long") + 1).alias("size"), F.crc32("t").alias("text_crc32"), F.md5("t").alias("h"), F.pmod(F.xxhash64("id"), F.lit(SLOT_BUCKETS)).cast("int").alias("bucket")),
        "shard-rows",
    )
    groups = materialise(rows.groupBy("h").agg(F.sum("size").alias("size")), "shard-groups")
    _, last = minimax_cuts(groups, n_shards)
    release(groups)
    #: "g" stands behind all digits, so a hash that is larger begins with a later prefix. At most n_shards - 1 cuts.
    shard = sum([(F.col("h") > f"{prefix}g").cast("int") for prefix in last], F.lit(0))
    placed = rows.withColumn("shard", shard)
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "bucket").orderBy("id", "h")
    numbered = placed.withColumn("at", F.row_number().over(inside))
    return numbered.join(F.broadcast(first), ["shard", "bucket"]).select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("first") + F.col("at") - 1).alias("slot"))
