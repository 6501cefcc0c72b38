"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Targets. A source's size is the sum of its documents' word counts. All sizes together are shared out by weight;
a source whose share passes `max_epochs` times its size is clamped there and what it cannot take is shared among
the others by weight, until no share is above its cap. Each round is one small aggregate over the table of
sources (one row each) and clamps a source at least.

Sampling. A source with target / size = whole + fraction takes every document `whole` times, and a fraction of its
documents once more. Those are picked by systematic sampling over documents ordered by size: the k-th document is
taken where floor(k * fraction + u) grows, with a seeded start u. Documents are ordered by size class; the count of
those in lower classes carries on from class to class, so the words taken miss the target by about one document's
size; of STARTS seeded starts, a source has the one that comes nearest. A class with many rows is split into cells of about CELL_ROWS rows by a seeded hash, so a source that holds a
third of all rows is sampled in many tasks. Everything depends on ids, sizes and the seed alone: reruns agree.

Defined results: a null text has size 0; a null source is a source of its own, last in order; documents of size 0
take nothing; a source without words has target 0; repeated rows are separate documents, equal in every way; an
empty table gives an empty result; columns other than id, text and source pass through `mixed` and play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .staging import materialise

WORD = r"[^\x20\x09-\x0D]+"
CELL_ROWS = 256
#: Places where a source's systematic sample may start; the one whose words come nearest to the target is taken.
STARTS = 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, max_epochs: float) -> DataFrame:
    """sources (source, source_size, weight) with `target`: all sizes shared by weight, none above max_epochs times its source's size."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * F.lit(float(max_epochs))
    clamped, n_clamped, level = F.col("source_size") <= 0, -1, 0.0
    while True:
        told = sources.agg(F.count_if(clamped).alias("n"), F.sum(F.when(clamped, cap).otherwise(0.0)).alias("fixed"), F.sum(F.when(~clamped, F.col("weight"))).alias("weight")).first()
        if told["n"] == n_clamped or not told["weight"]:
            break
        #: The level only rises, so what is above its cap at one level stays so.
        n_clamped, level = told["n"], (total - told["fixed"]) / told["weight"]
        clamped = (F.col("source_size") <= 0) | (F.col("weight") * level > cap)
    return sources.withColumn("target", F.when(clamped, cap).otherwise(F.col("weight") * F.lit(level)))


def cycle_weights(sources: DataFrame, weights: list[float]) -> DataFrame:
    """Weights given in turn to sources in code point order, null last. Ranks are counted inside ranges and over the ranges' counts, so sources may be many."""
    order = F.col("source").asc_nulls_last()
    dealt = materialise(sources.repartitionByRange(order).withColumn("range", F.spark_partition_id()), "mix-order")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    #: One row per partition.
    base = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.col("base") + F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    return dealt.join(base, "range").withColumn("weight", turn).drop("range", "base")


def _size_class(size: Column) -> Column:
    """Sizes within a factor of about 1.2 share a class."""
    return F.floor(F.log2(size + 1) * 4).cast("int")


def repetitions(docs: DataFrame, weights: list[float], max_epochs: float = 3.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: id_col, source, size, source_size, target, copies (how often the mix takes it), taken (copies * size)."""
    size = word_count(F.col(text_col).cast("string"))
    rows = materialise(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size")).withColumn("class", _size_class(F.col("size"))), "mix-sizes")
    classes = materialise(rows.groupBy("source", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")), "mix-classes")
    sources = materialise(cycle_weights(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights), "mix-sources")
    filled = water_fill(sources, max_epochs)
    lower = Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    epochs = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_epochs)))).otherwise(0.0)
    start = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    plan = (
        classes.withColumn("before", F.coalesce(F.sum("n").over(lower), F.lit(0)))
        .withColumnRenamed("source", "of")
        .join(filled, F.col("of").eqNullSafe(F.col("source")))
        .select("of", F.col("class").alias("of_class"), "source_size", "target", F.floor(epochs).alias("whole"), (epochs - F.floor(epochs)).alias("fraction"), F.ceil(F.col("n") / CELL_ROWS).alias("cells"), (start + F.col("before") * (epochs - F.floor(epochs))).alias("u"))
    )
    dealt = rows.join(plan, F.col("source").eqNullSafe(F.col("of")) & (F.col("class") == F.col("of_class")))
    draw = F.xxhash64("id", F.lit(seed))
    cell = F.pmod(draw, F.col("cells"))
    #: Later cells of a class start at places of their own.
    turn = F.when(cell == 0, 0.0).otherwise(F.pmod(F.xxhash64("source", "class", cell, F.lit(seed)), F.lit(1 << 20)) / float(1 << 20))
    ordered = dealt.withColumn("cell", cell).withColumn("turn", F.col("u") + turn).withColumn("draw", draw)
    at = F.row_number().over(Window.partitionBy("source", "class", "cell").orderBy("size", "draw", "id"))
    placed = materialise(ordered.withColumn("at", at).select("id", "source", "size", "source_size", "target", "whole", "fraction", "turn", "at"), "mix-places")
    starts = placed.groupBy("source").agg(F.array(*[F.sum(F.col("size") * (F.col("whole") + _extra(F.lit(k / STARTS)))) for k in range(STARTS)]).alias("words"), F.first("target").alias("aim"))
    misses = F.transform("words", lambda words, k: F.struct(F.abs(words - F.col("aim")).alias("miss"), k.alias("k")))
    best = starts.select(F.col("source").alias("of"), (F.array_min(misses)["k"] / STARTS).alias("shift"))
    done = placed.join(best, F.col("source").eqNullSafe(F.col("of"))).withColumn("copies", (F.col("whole") + _extra(F.col("shift"))).cast("int"))
    return done.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _extra(shift: Column) -> Column:
    """1 where the running count of fractions passes a whole number at this row, else 0."""
    f, u = F.col("fraction"), F.pmod(F.col("turn") + shift, F.lit(1.0))
    return F.floor(F.col("at") * f + u) - F.floor((F.col("at") - 1) * f + u)


def mixed(docs: DataFrame, weights: list[float], max_epochs: float = 3.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken, with the columns of docs. Rows that share id, source and size share
    what `repetitions` takes of them all, none more than once more than another; those of the smallest digests are the ones taken more."""
    taken = repetitions(docs, weights, max_epochs, seed, id_col, text_col, source_col)
    #: All rows of a key count, those that the sample left out too, since all are found again below.
    counts = taken.filter("size > 0").groupBy(id_col, source_col, "size").agg(F.count(F.lit(1)).alias("rows"), F.sum("copies").alias("all")).filter("all > 0")
    keys = counts.select(F.struct(F.col(id_col).alias("id"), F.col(source_col).alias("source"), "size").alias("key"), "rows", "all")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    key = F.struct(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size")).alias("key")
    digest = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if not any(x in kind for x in ("map<", "variant", "void"))])
    found = docs.select(row, key, F.md5(F.col(text_col).cast("string")).alias("of_text"), digest.alias("of_row")).join(keys, "key")
    at = F.row_number().over(Window.partitionBy("key").orderBy("of_text", "of_row"))
    copies = F.floor(F.col("all") / F.col("rows")) + F.when(F.col("at") <= F.col("all") % F.col("rows"), 1).otherwise(0)
    return found.withColumn("at", at).withColumn("copies", copies.cast("int")).filter("copies > 0").select(F.explode(F.array_repeat("row", F.col("copies"))).alias("row")).select("row.*")
