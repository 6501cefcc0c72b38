"""Data-quality rules: findings, rules that passed, and summaries that keep their totals."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import written

from .contain import contained
from .search import top_rows


@dataclass(frozen=True)
class Rule:
    """key, severity (trace, divergence or note), the rows that break it, who and where each is, and what to say."""

    key: str
    severity: str
    broken: Callable[[], DataFrame]
    subject: str
    text: str


def findings(rules: list[Rule]) -> DataFrame:
    """(key, severity, subject, text) of all broken rows."""
    out = None
    for r in rules:
        one = r.broken().select(F.lit(r.key).alias("key"), F.lit(r.severity).alias("severity"), F.col(r.subject).cast("string").alias("subject"), F.lit(r.text).alias("text"))
        out = one if out is None else out.unionByName(one)
    return out


def outcome(rules: list[Rule]) -> DataFrame:
    """One row per rule, those that found nothing too: key, severity, n, passed. 'Ran and found nothing' differs from 'did not run'."""
    spark = rules[0].broken().sparkSession
    ran = spark.createDataFrame([(r.key, r.severity) for r in rules], "key string, severity string")
    counts = findings(rules).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return ran.join(F.broadcast(counts), "key", "left").select("key", "severity", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) == 0).alias("passed"))


def checked(rules: list[Rule]) -> DataFrame:
    """findings of rules that may fail: each is run by itself and written, and one that fails, while it is planned or while it
    runs, becomes a note `check-failed` about itself (its key is the subject) and does not stop the others."""
    spark, found = None, []
    for r in rules:
        try:
            found.append(written(findings([r]), "findings"))
            spark = found[-1].sparkSession
        except Exception as e:  # whatever a check raises is its finding
            found.append((r.key, _said(e)))
    failed = [x for x in found if isinstance(x, tuple)]
    tables = [x for x in found if not isinstance(x, tuple)]
    if failed:
        spark = spark or SparkSession.builder.getOrCreate()
        tables.append(spark.createDataFrame([("check-failed", "note", *x) for x in failed], "key string, severity string, subject string, text string"))
    return reduce(DataFrame.unionByName, tables)


def _said(e: Exception) -> str:
    return str(e).splitlines()[0][:200] if str(e) else type(e).__name__


@dataclass(frozen=True)
class Check:
    """key, severity, the condition that a broken row meets (null where it can't be told), and what to say."""

    key: str
    severity: str
    broken: Column
    text: str


def guarded(rows: DataFrame, subject: str, checks: list[Check]) -> DataFrame:
    """Findings (key, severity, subject, text) of many checks in one pass over rows, none of which stops the others.

    A check whose condition can't be planned, and one that can't be told for some rows (its condition, made of try_ functions, is null
    there), becomes a note `check-failed` about itself, with how many rows that were. A condition that fails while it runs would
    stop the pass; then each check is run by itself, and those that fail become notes too.
    """
    planned, failed = [], []
    for c in checks:
        try:
            rows.select(c.broken.cast("boolean")).schema  # noqa: B018  analysed here, not run
            planned.append(c)
        except Exception as e:
            failed.append((c.key, _said(e)))
    own = []
    try:
        if planned:
            own.append(written(_one_pass(rows, subject, planned), "findings"))
    except Exception:
        for c in planned:
            try:
                own.append(written(_one_pass(rows, subject, [c]), "findings"))
            except Exception as e:
                failed.append((c.key, _said(e)))
    if failed or not own:
        own.append(rows.sparkSession.createDataFrame([("check-failed", "note", *x) for x in failed], "key string, severity string, subject string, text string"))
    return reduce(DataFrame.unionByName, own)


def _one_pass(rows: DataFrame, subject: str, checks: list[Check]) -> DataFrame:
    """Every row gives its findings, and a mark for each check that can't be told of it; marks are counted map-side."""
    said = [F.when(F.coalesce(c.broken.cast("boolean"), F.lit(True)), F.struct(c.broken.isNull().alias("lost"), F.lit(c.key).alias("key"), F.lit(c.severity).alias("severity"), F.lit(c.text).alias("text"))) for c in checks]
    each = rows.select(F.col(subject).cast("string").alias("subject"), F.explode(F.array_compact(F.array(*said))).alias("f")).select("subject", "f.*")
    each = each.withColumn("n", F.lit(1).cast("long"))
    #: What can't be told has one subject a check, so a check that fails on every row leaves one row a task.
    of = F.when(F.col("lost"), F.col("key")).otherwise(F.col("subject"))
    found = each.select(F.when(F.col("lost"), "check-failed").otherwise(F.col("key")).alias("key"), F.when(F.col("lost"), "note").otherwise(F.col("severity")).alias("severity"), of.alias("subject"), F.when(~F.col("lost"), F.col("text")).alias("text"), "lost", "n")
    lost = found.filter("lost").groupBy("key", "severity", "subject").agg(F.sum("n").alias("n")).select("key", "severity", "subject", F.format_string("can't be told of %s rows", "n").alias("text"))
    return found.filter("NOT lost").select("key", "severity", "subject", "text").unionByName(lost)


def overall(outcomes: DataFrame) -> DataFrame:
    """One row of outcome's rows: n_rules, n_findings, `valid` (no divergence) and `clean` (nothing found at all)."""
    return outcomes.agg(F.count(F.lit(1)).alias("n_rules"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_findings"), (F.count_if(~F.col("passed") & (F.col("severity") == "divergence")) == 0).alias("valid"), (F.count_if(~F.col("passed")) == 0).alias("clean"))


# Parts of a parser's note that tell of damage.
CRITICAL_NOTES = ["parse error", "EOF while reading", "expected endstream", "unable to find", "attempting to reconstruct", "stream data is invalid", "damaged"]


def note_severity(text: Column) -> Column:
    """error for a note that tells of damage, else warning."""
    return F.when(F.exists(F.array(*[F.lit(x) for x in CRITICAL_NOTES]), lambda x: F.contains(text, x)), "error").otherwise("warning")


def distinct_notes(notes: DataFrame, per: list[str], text: str, order: str) -> DataFrame:
    """Each note of a group once, where it first came."""
    return notes.groupBy(*per, text).agg(F.min(order).alias(order))


def report(found: DataFrame, per_key: int) -> DataFrame:
    """The first per_key findings of each key by subject, each with the key's total."""
    return top_rows(found, ["key"], [F.col("subject"), F.col("text")], per_key)


def stale_copies(copies: DataFrame, copy_id: str, copy_text: str, edits: list[tuple[int, str]], edit_id: str) -> DataFrame:
    """Copies that still hold an edit's old text: copy_id, edit_id. The edit list (id, old text) is an argument, so it is small; copies are scanned map-side."""
    olds = F.array(*[F.struct(F.lit(i).cast("long").alias("id"), F.lit(t).alias("text")) for i, t in edits if t])
    return copies.select(copy_id, F.explode(F.filter(olds, lambda e: F.contains(F.col(copy_text), e["text"]))).alias("e")).select(copy_id, F.col("e.id").alias(edit_id))


def stale_copies_of(copies: DataFrame, copy_id: str, copy_text: str, edits: DataFrame, edit_id: str, old_text: str) -> DataFrame:
    """stale_copies where the edits are a table too, of any size: copies that still hold an edit's old text, as (copy_id, edit_id)."""
    return contained(copies, copy_id, copy_text, edits, edit_id, old_text)


def hidden_copy_mismatch(copy: Column, shown: Column) -> Column:
    """A hidden copy whose trimmed text the shown text does not hold."""
    return (F.length(F.trim(copy)) > 0) & ~F.coalesce(F.contains(shown, F.trim(copy)), F.lit(False))
