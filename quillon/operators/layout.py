"""Ordered rows: islands by gaps, lines and their text, runs of consecutive keys, carried values, alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# A gap in ems that ends a line, an overlap that does, and a gap that is a space.
LINE_GAP, LINE_OVERLAP, SPACE_GAP = 2.5, -0.5, 0.19
# How far edges may differ, how clearly one must win, and how far page margins may differ.
EDGE_TOLERANCE, DECISION_MARGIN, MARGIN_TOLERANCE = 0.6, 0.5, 2.5


def islands(rows: DataFrame, per: list[str], order: list[str], breaks: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows from 0; a row where `breaks` is true (it may use lag over `w(per, order)`) begins a new one."""
    w = ordered(per, order)
    return rows.withColumn("__break", F.coalesce(breaks, F.lit(False)).cast("int")).withColumn(name, F.sum("__break").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__break")


def ordered(per: list[str], order: list[str]):
    return Window.partitionBy(*per).orderBy(*order)


def gap_islands(rows: DataFrame, per: list[str], order: list[str], value: Column, limit) -> DataFrame:
    """A new island where value is more than limit above the row before."""
    return islands(rows, per, order, value - F.lag(value).over(ordered(per, order)) > limit)


def visual_lines(runs: DataFrame, per: list[str]) -> DataFrame:
    """Text runs (x0, x1, y0, size, run_id) to lines: `baseline` buckets y0 by a quarter of the size, `line_no` numbers what gaps part."""
    size = F.when(F.col("size") == 0, 1.0).otherwise(F.col("size"))
    runs = runs.withColumn("baseline", F.bround(F.col("y0") / F.greatest(F.col("size") * 0.25, F.lit(0.01))).cast("long"))
    per, order = [*per, "baseline"], ["x0", "run_id"]
    w = ordered(per, order)
    gap = (F.col("x0") - F.lag("x1").over(w)) / F.greatest(F.lag(size).over(w), size)
    return islands(runs.withColumn("gap", gap), per, order, (F.col("gap") > LINE_GAP) | (F.col("gap") < LINE_OVERLAP), "line_no")


def line_texts(lines: DataFrame, per: list[str]) -> DataFrame:
    """One text per line; a gap of SPACE_GAP or more before a run is a space unless the text before ends with one."""
    per = [*per, "baseline", "line_no"]
    before = F.lag("text").over(ordered(per, ["x0", "run_id"]))
    spaced = lines.withColumn("piece", F.when(before.isNotNull() & ~F.coalesce(before.endswith(" "), F.lit(False)) & (F.col("gap") >= SPACE_GAP), F.concat(F.lit(" "), "text")).otherwise(F.col("text")))
    return spaced.groupBy(*per).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "run_id", "piece"))), lambda s: s["piece"]), "").alias("text"), *bbox("x0", "y0", "x1", "y1"))


def bbox(x0: str, y0: str, x1: str, y1: str) -> list[Column]:
    return [F.min(x0).alias("x0"), F.min(y0).alias("y0"), F.max(x1).alias("x1"), F.max(y1).alias("y1")]


def ordered_text(rows: DataFrame, per: list[str], order: list[Column], text: Column, between: str) -> DataFrame:
    """The texts of a group in order, joined."""
    parts = F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], text.alias("text"))))
    return rows.groupBy(*per).agg(F.array_join(F.transform(parts, lambda p: p["text"]), between).alias("text"))


def reading_text(runs: DataFrame, per: list[str]) -> DataFrame:
    """The runs' texts from top to bottom and left to right (y1 and x0 to one place, halves to even; ties by run_id), a line each."""
    return ordered_text(runs, per, [-F.bround("y1", 1), F.bround("x0", 1), F.col("run_id")], F.col("text"), "\n")


def line_shifts(widths: DataFrame, per: list[str], line: str, old: str, new: str) -> DataFrame:
    """By how much each line grows where its pieces keep their natural widths: per, line, shift."""
    return widths.groupBy(*per, line).agg(F.sum(F.col(new) - F.col(old)).alias("shift"))


def consecutive(rows: DataFrame, per: list[str], key: str) -> DataFrame:
    """Runs of keys that step by one: first, last, n. Repeated keys count once."""
    once = rows.select(*per, key).distinct()
    rank = F.row_number().over(Window.partitionBy(*per).orderBy(key))
    return once.withColumn("run", F.col(key) - rank).groupBy(*per, "run").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count(F.lit(1)).alias("n")).drop("run")


def carried(value: Column, per: list[str], order: list[str]) -> Column:
    """The last value that isn't null, from this row or before."""
    return F.last(value, ignorenulls=True).over(ordered(per, order).rowsBetween(Window.unboundedPreceding, 0))


def running(rows: DataFrame, per: list[str], at: str, of, value: str, name: str, cell: int = 65_536) -> DataFrame:
    """rows with `name`: `of` (F.max, F.min) over `value` of the group's rows before each, by `at` (a number; equal ones don't see each other).

    Inside cells of `at` row by row, and over the cells' own values before them, so that one group of any length is the work of
    many tasks. Where the places are numbered from 0 and value grows with them, F.max carries the last value that isn't null.
    """
    celled = rows.withColumn("__cell", F.floor(F.col(at) / cell))
    totals = celled.groupBy(*per, "__cell").agg(of(value).alias("__own"))
    before = Window.partitionBy(*per).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*per, "__cell", of("__own").over(before).alias("__base"))
    inside = Window.partitionBy(*per, "__cell").orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    joined = celled.withColumn("__in", of(value).over(inside)).join(base, [*per, "__cell"])
    either = F.greatest("__in", "__base") if of is F.max else F.least("__in", "__base")
    return joined.withColumn(name, either).drop("__cell", "__in", "__base")


def in_effect(rows: DataFrame, per: list[str], at: str, value: str, name: str, cell: int = 65_536) -> DataFrame:
    """rows with `name`: the value of the last row, this one or before, that has one; `carried` for groups too long for one task."""
    said = rows.withColumn("__said", F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("at"), F.col(value).alias("value"))))
    return running(said, per, at, F.max, "__said", "__last", cell).withColumn(name, F.coalesce(F.col(value), F.col("__last.value"))).drop("__said", "__last")


def spread(column: Column) -> Column:
    return F.max(column) - F.min(column)


def block_alignment(lines: DataFrame, per: list[str], x0: str, x1: str) -> DataFrame:
    """A block's alignment by which edge of its lines differs least: left, right, center, or null where no edge wins clearly."""
    centre = (F.col(x0) + F.col(x1)) / 2
    told = lines.groupBy(*per).agg(F.count(F.lit(1)).alias("n"), spread(F.col(x0)).alias("left"), spread(F.col(x1)).alias("right"), spread(centre).alias("center"))
    ranked = F.array_sort(F.array(*[F.struct(F.col(k).alias("spread"), F.lit(i).alias("i"), F.lit(k).alias("name")) for i, k in enumerate(("left", "right", "center"))]))
    best, next_ = F.element_at(ranked, 1), F.element_at(ranked, 2)
    return told.withColumn("alignment", F.when((F.col("n") >= 2) & (best["spread"] <= EDGE_TOLERANCE) & (next_["spread"] - best["spread"] >= DECISION_MARGIN), best["name"]))


def line_alignment(lines: DataFrame, page: list[str], block: str, line: str, page_width: str | None = None) -> DataFrame:
    """Each line's alignment: its block's, else by the column that the page's other lines form, else by the page's mirrored margins, else left.

    The others' edges come from the two smallest and two largest values of the page, so no line meets every other.
    """
    first = lines.groupBy(*page).agg(F.min("x0").alias("l1"), F.max("x1").alias("r1"))
    #: The second value is the first again where two lines have it.
    next_ = lines.join(first, page).groupBy(*page, "l1", "r1").agg(F.count_if(F.col("x0") == F.col("l1")).alias("n_l"), F.min(F.when(F.col("x0") > F.col("l1"), F.col("x0"))).alias("l"), F.count_if(F.col("x1") == F.col("r1")).alias("n_r"), F.max(F.when(F.col("x1") < F.col("r1"), F.col("x1"))).alias("r"))
    ends = next_.select(*page, "l1", F.when(F.col("n_l") > 1, F.col("l1")).otherwise(F.col("l")).alias("l2"), "r1", F.when(F.col("n_r") > 1, F.col("r1")).otherwise(F.col("r")).alias("r2"))
    of_block = block_alignment(lines, [*page, block], "x0", "x1").select(*page, block, F.col("alignment").alias("of_block"))
    both = lines.join(of_block, [*page, block]).join(ends, page)
    left = F.when(F.col("x0") == F.col("l1"), F.col("l2")).otherwise(F.col("l1"))
    right = F.when(F.col("x1") == F.col("r1"), F.col("r2")).otherwise(F.col("r1"))
    at_left, at_right = F.abs(F.col("x0") - left) <= EDGE_TOLERANCE, F.abs(F.col("x1") - right) <= EDGE_TOLERANCE
    centre = (F.col("x0") + F.col("x1")) / 2
    lone = F.when(left.isNull() | (right - left <= 0), "left").when(at_right & ~at_left, "right").when(at_left & ~at_right, "left")
    if page_width:
        free = ~at_left & ~at_right
        lone = lone.when(free & (F.abs(F.col("x1") - (F.col(page_width) - left)) <= MARGIN_TOLERANCE), "right").when(free & (F.abs(centre - F.col(page_width) / 2) <= MARGIN_TOLERANCE), "center")
    lone = lone.when((F.abs(centre - (left + right) / 2) <= EDGE_TOLERANCE) & ~(at_left & at_right), "center").otherwise("left")
    return both.select(*page, block, line, F.coalesce("of_block", lone).alias("alignment"))
