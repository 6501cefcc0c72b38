"""Append-only versions, chains of revisions and reads as of one, metadata merges, routing, and writes that are checked before they count."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import dates, text
from quillon.session import release, written

from .graph import doubled


def latest(rows: DataFrame, keys: list[str], revision: list[str]) -> DataFrame:
    """Each key's newest row by revision columns; combined map-side, so long histories shuffle one row per task."""
    others = [c for c in rows.columns if c not in keys]
    packed = F.struct(*revision, *[c for c in others if c not in revision])
    return rows.groupBy(*keys).agg(F.max(packed).alias("__row")).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in others])


def merge(base: DataFrame, updates: DataFrame, keys: list[str], value: str) -> DataFrame:
    """base with updates: a value replaces or adds, a null value deletes."""
    kept = base.select(*keys, value).join(updates.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(updates.filter(F.col(value).isNotNull()).select(*keys, value))


def routed(rows: DataFrame, refusals: list[tuple[Column, str]], route: str = "in_place", other: str = "deferred") -> DataFrame:
    """rows with (route, reason): the first refusal that holds defers a row and is its reason."""
    reason = F.when(refusals[0][0], refusals[0][1])
    for condition, text in refusals[1:]:
        reason = reason.when(condition, text)
    return rows.withColumn("reason", reason).withColumn("route", F.when(F.col("reason").isNull(), route).otherwise(other))


def append_revision(path: str, current: DataFrame, changes: DataFrame, keys: list[str], revision: int) -> int:
    """Append changes as a revision of a Parquet table, all or nothing. Gives the number of rows.

    The rows are written beside the table and read back there; only if they are those of `changes` do they become the folder
    `revision=N` of the table, by one rename. A revision that is there already is not written again.
    """
    spark = changes.sparkSession
    target, beside = f"{path.rstrip('/')}/revision={revision}", f"{path.rstrip('/')}/_writing-{uuid.uuid4().hex}"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    files = place(path).getFileSystem(conf)
    if files.exists(place(target)):
        raise OSError(f"revision {revision} is there already")
    try:
        changes.write.parquet(beside)
        back = spark.read.schema(changes.schema).parquet(beside)
        wrong = changes.exceptAll(back).count() + back.exceptAll(changes).count()
        if wrong:
            raise OSError(f"{wrong} rows of revision {revision} did not arrive")
        rows = back.count()
        if not files.rename(place(beside), place(target)):
            raise OSError(f"revision {revision} could not take its place")
    finally:
        files.delete(place(beside), True)
    return rows


def chains(revisions: DataFrame, revision: str = "revision", prev: str = "prev") -> DataFrame:
    """Where each revision's chain of `prev` ends: revision, root (the first revision, whose prev is null), depth (steps to it), missing.

    Pointers double every round, so a chain of 10,000 takes some 14. A chain that breaks has in `missing` the revision that it names but that is
    not there, and no root; one that runs in a circle has neither. Revisions are distinct and not null.
    """
    own = revisions.select(F.col(revision).alias("node"), F.col(prev).alias("to"))
    ended = doubled(own.filter("to IS NOT NULL").withColumn("w", F.lit(1).cast("long")), "chains")
    first = own.filter("to IS NULL").select(F.col("node").alias("to"), F.lit(True).alias("__first"))
    told = own.select("node", F.col("to").isNull().alias("__own")).join(ended, "node", "left").join(first, "to", "left")
    root = F.when(F.col("__own"), F.col("node")).when(F.col("__first"), F.col("to"))
    depth = F.when(F.col("__own"), F.lit(0).cast("long")).when(F.col("__first"), F.col("w"))
    there = own.select(F.col("node").alias("to"), F.lit(True).alias("__there"))
    return told.join(there, "to", "left").select(F.col("node").alias(revision), root.alias("root"), depth.alias("depth"), F.when(~F.col("__own") & F.col("__there").isNull(), F.col("to")).alias("missing"))


def history(revisions: DataFrame, tips: DataFrame, revision: str = "revision", prev: str = "prev") -> DataFrame:
    """For each tip the revisions that it stands on, itself too: tip, revision, steps.

    Round k joins jumps of 2**k steps, so what is known of a chain doubles; rounds end when a round finds nothing new.
    """
    jumps = written(revisions.select(F.col(revision).alias("node"), F.col(prev).alias("to")).filter("to IS NOT NULL"), "jumps")
    there = revisions.select(F.col(revision).alias("node"))
    known = written(tips.select(F.col("tip"), F.col("tip").alias("node")).distinct().join(there, "node", "left_semi").select("tip", "node", F.lit(0).cast("long").alias("steps")), "history")
    far, n = 1, known.count()
    while True:
        step = known.join(jumps, "node").select("tip", F.col("to").alias("node"), (F.col("steps") + far).alias("steps")).join(there, "node", "left_semi")
        new = written(known.unionByName(step).groupBy("tip", "node").agg(F.min("steps").alias("steps")), "history")
        release(known)
        known, before, n = new, n, new.count()
        if n == before:
            release(jumps)
            return known.select("tip", F.col("node").alias(revision), "steps")
        on = jumps.select(F.col("node").alias("to"), F.col("to").alias("__on"))
        further = written(jumps.join(on, "to").select("node", F.col("__on").alias("to")), "jumps")
        release(jumps)
        jumps, far = further, far * 2


def as_of(rows: DataFrame, revisions: DataFrame, tips: DataFrame, keys: list[str], revision: str = "revision", prev: str = "prev", deleted: Column | None = None) -> DataFrame:
    """rows (of revisions, distinct by keys in each) as each tip sees them: tip and the columns of rows; of a key the row nearest to the tip on its chain. Where `deleted` holds there, the key is gone."""
    seen = rows.join(history(revisions, tips, revision, prev), revision)
    others = [c for c in rows.columns if c not in keys]
    gone = F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)
    best = seen.groupBy("tip", *keys).agg(F.min_by(F.struct(*others, gone.alias("__gone")), "steps").alias("__row"))
    return best.filter("NOT __row.__gone").select("tip", *keys, *[F.col(f"__row.{c}").alias(c) for c in others])


def _publish(spark: SparkSession, target: str, content: str) -> bool:
    """Create a small file with its content if nobody has, in one step: of several writers one gets True."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(target)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.getScheme() == "file":
        #: Hadoop's local file system looks before it creates; a hard link is made or refused by the system at once.
        local = place.toUri().getPath()
        os.makedirs(os.path.dirname(local), exist_ok=True)
        beside = f"{os.path.dirname(local)}/_{uuid.uuid4().hex}"
        with open(beside, "w") as f:
            f.write(content)
        try:
            os.link(beside, local)
            return True
        except FileExistsError:
            return False
        finally:
            os.remove(beside)
    try:
        out = files.create(place, False)  # refused by the name node if it is there
    except Exception as e:
        if files.exists(place):
            return False
        raise e
    out.write(bytearray(content.encode()))
    out.close()
    return True


def commit_revision(path: str, changes: DataFrame, revision: int, prev: int | None) -> int:
    """Add changes as a revision that follows prev to the table at path, all or nothing. Gives the number of rows.

    Rows go to a folder of this writer's own and are read back there; then the revision's manifest (revision, prev, folder, rows) is
    published in one step, which of several writers of one revision only one can. Readers see what manifests name, so a writer
    that dies or loses leaves nothing to be seen, and one that loses deletes its rows and raises FileExistsError.
    """
    spark = changes.sparkSession
    root, part = path.rstrip("/"), uuid.uuid4().hex
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/rows/part={part}")
    won = False
    try:
        changes.write.parquet(f"{root}/rows/part={part}")
        back = spark.read.schema(changes.schema).parquet(f"{root}/rows/part={part}")
        wrong = changes.exceptAll(back).count() + back.exceptAll(changes).count()
        if wrong:
            raise OSError(f"{wrong} rows of revision {revision} did not arrive")
        n = back.count()
        won = _publish(spark, f"{root}/manifests/{revision:012d}.json", json.dumps({"revision": revision, "prev": prev, "part": part, "n": n}))
        if not won:
            raise FileExistsError(f"revision {revision} is there already")
    finally:
        if not won:
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return n


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """The revisions that were committed: revision, prev, part, n."""
    return spark.read.schema("revision long, prev long, part string, n long").json(f"{path.rstrip('/')}/manifests")


def read_as_of(spark: SparkSession, path: str, revision: int, keys: list[str], schema: str, deleted: Column | None = None) -> DataFrame:
    """The table at path as a revision sees it, without those keys that it deleted. Only folders that manifests on its chain name are read."""
    told = manifests(spark, path)
    seen = history(told, spark.range(1).select(F.lit(revision).cast("long").alias("tip"))).select("revision", "steps")
    parts = told.join(seen, "revision").select("part", "revision", "steps")
    kinds = f"{schema}, part string"
    rows = spark.read.schema(kinds).parquet(f"{path.rstrip('/')}/rows").join(parts, "part")
    others = [c for c in rows.columns if c not in (*keys, "part", "steps")]
    gone = F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*others, gone.alias("__gone")), "steps").alias("__row"))
    return best.filter("NOT __row.__gone").select(*keys, *[F.col(f"__row.{c}").alias(c) for c in others])


def set_metadata(info: DataFrame, changes: DataFrame, subject: list[str], now: Column, mirror: DataFrame | None = None, mode: str = "auto") -> tuple[DataFrame, DataFrame | None]:
    """Metadata (subject, field, value) with changes (subject, field, value) applied, and its mirror (subject, key, value) brought in line.

    A field may be named as people write it (text.metadata_key); a null value deletes; of several changes to a field of one subject the
    last by `at` counts if changes has that column, else one of them must do. Dates (fields that end in Date) may be spelled in any
    way that dates.parse_date reads, or `now`; they are stored packed, in the mirror as ISO; what can't be read stays as it is said. Of
    the mirror only the keys that MIRRORED has change. mode: auto changes mirrors of subjects that have one, always makes them, never leaves
    them alone.
    """
    if mode not in ("auto", "always", "never"):
        raise ValueError(f"no such mode: {mode}")
    order = F.col("at") if "at" in changes.columns else F.lit(0)
    said = changes.select(*subject, text.metadata_key(F.col("field")).alias("field"), F.struct("value").alias("v"), order.alias("at"))
    last = said.groupBy(*subject, "field").agg(F.max_by("v", "at").alias("v")).select(*subject, "field", "v.value")
    moment = dates.parse_date(F.when(F.lower(F.trim("value")) == "now", now).otherwise(F.col("value")))
    is_date = F.col("field").isin(*DATE_FIELDS)
    read = last.withColumn("__d", F.when(is_date, moment))
    packed = F.coalesce(dates.packed_date(F.col("__d.moment"), F.col("__d.offset_min")), F.col("value"))
    read = written(read, "metadata-changes")
    made = read.withColumn("packed", packed).withColumn("iso", F.coalesce(dates.iso_date(F.col("__d.moment"), F.col("__d.offset_min")), F.col("value")))
    new = merge(info, made.select(*subject, "field", F.col("packed").alias("value")), [*subject, "field"], "value")
    if mirror is None or mode == "never":
        return new, mirror
    names = F.create_map(*[F.lit(x) for pair in MIRRORED.items() for x in pair])
    mirrored = made.select(*subject, names[F.col("field")].alias("key"), F.col("iso").alias("value")).filter("key IS NOT NULL")
    if mode == "auto":
        mirrored = mirrored.join(mirror.select(*subject).distinct(), subject, "left_semi")
    return new, merge(mirror, mirrored, [*subject, "key"], "value")


# Metadata fields that hold dates, and the keys under which other fields stand in a mirror.
DATE_FIELDS = ["/CreationDate", "/ModDate"]
MIRRORED = {
    "/Title": "dc:title", "/Author": "dc:creator", "/Subject": "dc:description", "/Keywords": "pdf:Keywords", "/Creator": "xmp:CreatorTool",
    "/Producer": "pdf:Producer", "/CreationDate": "xmp:CreateDate", "/ModDate": "xmp:ModifyDate",
}
