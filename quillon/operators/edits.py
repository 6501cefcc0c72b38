"""Edits applied as one plan: resolved, validated, refused together where they depend on each other, spliced, and reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.session import release, written

from .graph import components
from .match import missing_characters

#: Characters of a run whose edits are compared with one another in one place; longer edits are known there by how far they reach.
CELL = 4096


def validated(edits: DataFrame, runs: DataFrame) -> DataFrame:
    """edits with `whole` of their run and `reason`, null for those that nothing speaks against by themselves.

    In turn: no such run, the run can't be edited, the range is outside the run, characters that its font lacks (in the order they
    first appear), or an earlier edit of the run (by start, then id) reaches over its start.
    """
    told = runs.select(F.col("run_id").alias("__run"), F.length("text").alias("__size"), "editable", "whole", "characters")
    found = edits.join(told, F.col("run_id") == F.col("__run"), "left")
    lacks = F.when(F.col("characters").isNotNull(), F.array_join(missing_characters(F.coalesce("new_text", F.lit("")), F.col("characters")), ""))
    outside = F.coalesce((F.col("start") < 0) | (F.col("start") >= F.col("end")) | (F.col("end") > F.col("__size")), F.lit(True))
    reason = (
        F.when(F.col("__run").isNull(), "no such run")
        .when(~F.coalesce("editable", F.lit(True)), "the run can't be edited")
        .when(outside, "range outside the run")
        .when(lacks != "", F.concat(F.lit("no glyphs for: "), lacks))
    )
    first = found.select(*edits.columns, F.coalesce("whole", F.lit(False)).alias("whole"), reason.alias("reason"))
    #: How far the edits before reach: those of the same cell one by one, those of earlier cells by their farthest end.
    good = F.when(F.col("reason").isNull(), F.col("end"))
    celled = first.withColumn("__cell", F.floor(F.col("start") / CELL))
    cells = celled.filter("reason IS NULL").groupBy("run_id", "__cell").agg(F.max("end").alias("__far"))
    before = Window.partitionBy("run_id").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    base = cells.select(F.col("run_id").alias("__r"), F.col("__cell").alias("__c"), F.max("__far").over(before).alias("__base"))
    inside = Window.partitionBy("run_id", "__cell").orderBy("start", "edit_id").rowsBetween(Window.unboundedPreceding, -1)
    reach = celled.withColumn("__reach", F.max(good).over(inside)).join(base, (F.col("run_id") == F.col("__r")) & (F.col("__cell") == F.col("__c")), "left")
    over = F.greatest("__reach", "__base") > F.col("start")
    return reach.withColumn("reason", F.when(F.col("reason").isNull() & over, "overlaps an earlier edit").otherwise(F.col("reason"))).select(*edits.columns, "whole", "reason")


def spread(rows: DataFrame) -> DataFrame:
    """rows (edit_id, run_id, group, whole, reason) with `cause`: the smallest refused edit that takes an edit with it, null if none does.

    A refused edit refuses its group, and in a run that stands or falls as a whole all edits of that run; each of those does the same, until
    nothing more falls. Groups and whole runs are the nodes of a graph, edits that have both its links, and what is refused is each
    component that holds a refused edit, so far chains cost few rounds and no group is ever gathered. Group 0 or null is none.
    """
    grouped = F.coalesce(F.col("group") != 0, F.lit(False))
    of_group, of_run = F.concat(F.lit("g"), F.col("group").cast("string")), F.concat(F.lit("r"), F.col("run_id").cast("string"))
    links = rows.filter(F.col("whole") & grouped).select(of_group.alias("a"), of_run.alias("b")).distinct()
    labels = written(components(links), "edit-groups")
    node = F.when(F.col("whole"), of_run).when(grouped, of_group)
    own = rows.withColumn("__node", node).join(labels.select(F.col("node").alias("__node"), "label"), "__node", "left").withColumn("__label", F.coalesce("label", "__node")).drop("label", "__node")
    causes = written(own.filter("reason IS NOT NULL AND __label IS NOT NULL").groupBy("__label").agg(F.min("edit_id").alias("cause")), "edit-causes")
    told = own.join(causes, "__label", "left").drop("__label")
    return told.withColumn("cause", F.coalesce("cause", F.when(F.col("reason").isNotNull(), F.col("edit_id"))))


def spliced(text: Column, edits: Column) -> Column:
    """text with edits (array<struct<start, end, text>>, not overlapping) made: the stretches between them and their texts, joined once."""
    ordered = F.array_sort(edits)
    after = lambda i: F.coalesce(F.get(ordered, i - 1)["end"], F.lit(0))
    pieces = F.transform(ordered, lambda e, i: F.concat(F.substr(text, after(i) + 1, e["start"] - after(i)), F.coalesce(e["text"], F.lit(""))))
    return F.concat(F.array_join(pieces, ""), F.substr(text, F.element_at(ordered, -1)["end"] + 1, F.length(text)))


def apply_edits(edits: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs that changed: run_id, text, n_applied; the report: edit_id, run_id, applied, reason, cause).

    edits: edit_id (distinct), run_id, start, end, new_text, group; runs: run_id (distinct), text, editable, whole, characters (what its font
    can show, null for all). Every edit has one row in the report: reason says why it was refused itself, cause which edit's
    refusal it fell with (its own id if its own). A run's edits that apply don't overlap, so they are never more than its characters.
    """
    checked = written(validated(edits, runs), "edits")
    told = written(spread(checked), "edits-told")
    release(checked)
    report = told.select("edit_id", "run_id", F.col("cause").isNull().alias("applied"), "reason", "cause")
    good = told.filter("cause IS NULL")
    each = good.groupBy(F.col("run_id").alias("__run")).agg(F.collect_list(F.struct("start", "end", F.col("new_text").alias("text"))).alias("__edits"))
    changed = runs.join(each.hint("merge"), F.col("run_id") == F.col("__run")).select("run_id", spliced(F.col("text"), F.col("__edits")).alias("text"), F.size("__edits").cast("long").alias("n_applied"))
    return changed, report
