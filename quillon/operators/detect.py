"""Detectors over rows of files, streams, fonts and signatures: what a check finds, as finding rows.

Every detector gives (key, severity, subject, text); severity is trace, divergence or note. Inputs are tables as
quillon.sources makes them, or any others with the columns named; comparisons look only at what both sides have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# By how many thousandths of an em a stated width may differ from the font program's.
WIDTH_TOLERANCE = 1.0


def finding(rows: DataFrame, key: str, severity: str, subject: str | Column, text: Column | str) -> DataFrame:
    said = F.lit(text) if isinstance(text, str) else text
    of = F.col(subject) if isinstance(subject, str) else subject
    return rows.select(F.lit(key).alias("key"), F.lit(severity).alias("severity"), of.cast("string").alias("subject"), said.alias("text"))


def stream_tails(streams: DataFrame) -> DataFrame:
    """Compressed streams (path, num, gen, tail) with bytes after their end."""
    return finding(streams.filter("tail > 0"), "stream-tail", "trace", "path", F.format_string("object %s %s: %s bytes after the end of its data", "num", "gen", "tail"))


def extra_revisions(profiles: DataFrame) -> DataFrame:
    """Files (path, n_eof) that end more than once."""
    return finding(profiles.filter("n_eof > 1"), "revisions", "trace", "path", F.format_string("%s revisions", "n_eof"))


def width_mismatches(glyphs: DataFrame) -> DataFrame:
    """Codes (font, code, program_width, stated_width) whose widths differ by more than WIDTH_TOLERANCE; a glyph emptied to width 0 doesn't count."""
    wrong = glyphs.filter((F.abs(F.col("program_width") - F.col("stated_width")) > WIDTH_TOLERANCE) & (F.col("program_width") != 0))
    return finding(wrong, "width-mismatch", "trace", "font", F.format_string("code %s: stated and own width differ", "code"))


def orphan_glyphs(glyphs: DataFrame, reachable: DataFrame, components: DataFrame) -> DataFrame:
    """Glyphs (font, gid, n_bytes) of subset fonts that hold an outline but that no code (reachable: font, gid) and no reached composite (components: font, gid, part, all levels) leads to. Glyph 0 is no orphan."""
    parts = components.join(reachable.select("font", "gid").distinct(), ["font", "gid"], "left_semi").select("font", F.col("part").alias("gid"))
    reached = reachable.select("font", "gid").unionByName(parts).distinct()
    orphans = glyphs.filter("gid <> 0 AND n_bytes > 0").join(reached, ["font", "gid"], "left_anti")
    return finding(orphans, "orphan-glyph", "trace", "font", F.format_string("glyph %s is reached by nothing", "gid"))


def _both(before: DataFrame, after: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    left = before.select(*key, *[F.col(c).alias(f"before_{c}") for c in columns])
    right = after.select(*key, *[F.col(c).alias(f"after_{c}") for c in columns])
    return left.join(right, key)


def font_changes(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Fonts on both sides (key, modified, tables, hinted): another date, another order of the tables that both have, hinting gone or come."""
    both = _both(before, after, key, ["modified", "tables", "hinted"])
    subject = F.concat_ws(" ", *key)
    common = lambda a, b: F.filter(F.col(a), lambda x: F.array_contains(F.col(b), x))
    dates = finding(both.filter(~F.col("before_modified").eqNullSafe(F.col("after_modified"))), "font-date", "trace", subject, "the font program's date changed")
    order = finding(both.filter(common("before_tables", "after_tables") != common("after_tables", "before_tables")), "table-order", "trace", subject, "the order of the font program's tables changed")
    hints = finding(both.filter(F.col("before_hinted") != F.col("after_hinted")), "hinting", "trace", subject, "the font program's hinting changed")
    return dates.unionByName(order).unionByName(hints)


def recompressed(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Streams on both sides (key, level) with valid headers of different levels; a null level is no valid header."""
    both = _both(before, after, key, ["level"]).filter("before_level <> after_level")
    return finding(both, "compression-level", "trace", F.concat_ws(" ", *key), F.format_string("level %s became %s", "before_level", "after_level"))


def container_changes(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Files on both sides (key, size, version, object_streams): a shorter or longer file, another cross-reference style, another version."""
    both, subject = _both(before, after, key, ["size", "version", "object_streams"]), F.concat_ws(" ", *key)
    size = finding(both.filter("before_size <> after_size"), "file-size", "note", subject, F.format_string("%s bytes became %s", "before_size", "after_size"))
    style = finding(both.filter("before_object_streams <> after_object_streams"), "xref-style", "trace", subject, "the style of the cross-reference table changed")
    version = finding(both.filter(~F.col("before_version").eqNullSafe(F.col("after_version"))), "version", "trace", subject, F.format_string("version %s became %s", "before_version", "after_version"))
    return size.unionByName(style).unionByName(version)


def identity_changes(changes: DataFrame, subject: str, dates: list[str]) -> DataFrame:
    """Of diff.value_diff's rows (subject, key, before, after): dates that changed, and other metadata that did."""
    is_date = F.col("key").isin(*dates)
    said = F.format_string("%s: %s became %s", F.col("key"), F.coalesce("before", F.lit("nothing")), F.coalesce("after", F.lit("nothing")))
    return finding(changes.filter(is_date), "date-changed", "trace", subject, said).unionByName(finding(changes.filter(~is_date), "metadata-changed", "trace", subject, said))


def external_risks(profiles: DataFrame, fonts: DataFrame, states: DataFrame) -> DataFrame:
    """What keeps a file from looking alike elsewhere, one row per file and risk; lists of names have the first five in order and how many more there are.

    profiles: path, encrypted, has_metadata, has_pdfa_id, has_output_intent, has_id, n_eof; fonts: path, font, embedded,
    has_unicode_map; states: path, alpha, soft_mask (of graphics states), group (of pages).
    """
    plain = [("encrypted", "encrypted"), ("no-xmp", "NOT has_metadata"), ("no-pdfaid", "NOT has_pdfa_id"), ("no-output-intent", "NOT has_output_intent"), ("no-id", "NOT has_id"), ("revisions", "n_eof > 1")]
    out = None
    for key, condition in plain:
        one = finding(profiles.filter(condition), key, "divergence", "path", key.replace("-", " "))
        out = one if out is None else out.unionByName(one)
    for key, condition in (("fonts-not-embedded", "NOT embedded"), ("fonts-no-tounicode", "NOT has_unicode_map")):
        names = fonts.filter(condition).select("path", "font").distinct().groupBy("path").agg(F.array_sort(F.collect_list("font")).alias("names"))
        said = F.concat(F.array_join(F.slice("names", 1, 5), ", "), F.when(F.size("names") > 5, F.format_string(" and %s more", F.size("names") - 5)).otherwise(""))
        out = out.unionByName(finding(names, key, "divergence", "path", said))
    seen = states.filter("alpha < 1 OR coalesce(soft_mask, 'None') <> 'None' OR group = 'Transparency'").select("path").distinct()
    return out.unionByName(finding(seen, "transparency", "divergence", "path", "transparency"))


def signature_coverage(signatures: DataFrame) -> DataFrame:
    """signatures (path, field, byte_range, size) with `covers`: the last range ends where the file does."""
    end = F.coalesce(F.get("byte_range", F.lit(2)) + F.get("byte_range", F.lit(3)), F.lit(0))
    return signatures.withColumn("covers", (end > 0) & (end >= F.col("size")))


def uncovered_signatures(signatures: DataFrame) -> DataFrame:
    rows = signature_coverage(signatures).filter("NOT covers")
    return finding(rows, "signature-coverage", "divergence", "path", F.format_string("the signature %s does not cover the whole file", "field"))


def dictionary_changes(before: DataFrame, after: DataFrame, key: list[str], entries: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """Entries (a map) that differ between rows of one key: key, entry, change (vanished, added, changed), before, after. Entries named in skip don't count."""
    long = lambda df, side: df.select(*key, F.explode(entries).alias("entry", side)).filter(~F.col("entry").isin(*skip)) if skip else df.select(*key, F.explode(entries).alias("entry", side))
    left, right = long(before, "before").withColumn("__l", F.lit(True)), long(after, "after").withColumn("__r", F.lit(True))
    both = left.join(right, [*key, "entry"], "full_outer")
    change = F.when(F.col("__r").isNull(), "vanished").when(F.col("__l").isNull(), "added").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return both.withColumn("change", change).filter("change IS NOT NULL").select(*key, "entry", "change", "before", "after")


def same_dictionary(left: Column, right: Column, skip: tuple[str, ...] = ("/Length", "/Filter", "/DecodeParms")) -> Column:
    """Whether two maps are equal but for the entries that say how data are stored."""
    kept = lambda m: F.array_sort(F.map_entries(F.map_filter(m, lambda k, _: ~k.isin(*skip))))
    return kept(left).eqNullSafe(kept(right))
