"""Exact dedup, native: 128-bit content hash, bytes compared inside each hash group, one stable id kept.

Texts are equal when identical after lower-casing A-Z (other letters keep their case). A group is keyed by
(MD5 of the normalised text, the normalised text itself): the hash deals the rows out, and Spark's hash
aggregate compares the grouping bytes, so two texts that collide on the hash stay two groups. Copies collapse
in the map-side aggregate, so a text that holds a third of all rows sends one row per map task. Rows find their
group again over the two digests (MD5 and SHA-256), without the text; that join has plain shuffles on both
sides, which AQE can split where one group is hot.

Defined results: a null text counts as empty, so nulls and empty texts are one group. Of rows that repeat an id with the
same text one is marked kept when that id stays, and `drop_copies` returns one of them; such rows travel as one with
their number and are made again at the end. A null id stays only where its group has no other id. An empty table gives an empty result; other columns play no part in
`duplicate_groups` and pass through `drop_copies` unchanged, whatever they are called.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


STEP = 10_000


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    norm = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return docs.select(F.col(id_col).alias("id"), norm.alias("norm")).withColumn("h", F.unhex(F.md5("norm")))


def _groups(keyed: DataFrame, keep: str) -> DataFrame:
    pick = {"max": F.max, "min": F.min}[keep]
    return keyed.groupBy("h", "norm").agg(pick("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    keyed = _keyed(docs, id_col, text_col)
    groups = _groups(keyed, keep).select("h", F.sha2("norm", 256).alias("sha"), "keep_id", "group_size")
    rows = keyed.select("id", "h", F.sha2("norm", 256).alias("sha")).groupBy("id", "h", "sha").agg(F.count(F.lit(1)).alias("n"))
    found = rows.join(groups, ["h", "sha"])
    #: Row numbers from 0 in two steps, so that no array is longer than STEP however often a row is repeated.
    found = found.withColumn("high", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / STEP))))
    found = found.withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(STEP - 1), F.col("n") - 1 - F.col("high") * STEP))))
    stays = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("high") == 0) & (F.col("low") == 0)
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", stays.alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows that stay, with the columns of docs. Joined on (hash, id), which no hot group makes heavy."""
    stays = _groups(_keyed(docs, id_col, text_col), keep).select("h", F.struct("keep_id").alias("k"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    norm = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select(row, F.unhex(F.md5(norm)).alias("h"), F.struct(F.col(id_col).alias("keep_id")).alias("k"))
    return rows.join(stays, ["h", "k"], "left_semi").dropDuplicates(["h", "k"]).select("row.*")
