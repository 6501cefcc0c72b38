"""Normalised search, bounded replacement and edits.

Counting and replacing stay in the JVM; only offsets need Python, in Arrow batches.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions.text import FROM, LIGATURES, TO, normalise
from quillon.session import written


@dataclass(frozen=True)
class Pattern:
    """text: a literal, normalised like what is searched, or a regular expression as it is. whole_word goes with literals and expressions alike."""

    text: str
    regex: bool = False
    ignore_case: bool = False
    whole_word: bool = False

    def source(self) -> str:
        """As a regular expression that Java and Python read alike."""
        body = self.text if self.regex else re.sub(r"([^\w\s])", r"\\\1", plain_normalise(self.text))
        if self.whole_word:
            body = rf"(?<!\w)(?:{body})(?!\w)"
        return ("(?iu)" if self.ignore_case else "") + body

    def java(self) -> str:
        return "(?U)" + self.source()


def plain_normalise(text: str) -> str:
    return "".join(LIGATURES.get(c, c) for c in text.translate(str.maketrans(FROM, TO)))


def match_count(text: Column, pattern: Pattern) -> Column:
    """Leftmost matches that don't overlap; an empty pattern has none."""
    return F.lit(0) if not pattern.text else F.coalesce(F.size(matches(text, pattern)), F.lit(0))


def matches(text: Column, pattern: Pattern) -> Column:
    """The texts matched, those of no length left out."""
    return F.filter(F.regexp_extract_all(normalise(text), F.lit(pattern.java()), F.lit(0)), lambda m: m != "")


def _positions(text: str, plain: str) -> list[int] | range:
    """For each character of the normalised text the place of its source."""
    return range(len(text)) if len(plain) == len(text) else [k for k, c in enumerate(text) for _ in LIGATURES.get(c, c)]


def _hits(compiled: re.Pattern, text: str) -> list[tuple[int, int, re.Match]]:
    """(start, end) in the source text of each match that has a length."""
    plain = plain_normalise(text)
    back = _positions(text, plain)
    return [(back[m.start()], back[m.end() - 1] + 1, m) for m in compiled.finditer(plain) if m.end() > m.start()]


def _expanded(m: re.Match, template: str, regex: bool) -> str:
    """The template for a match; one that the expression can't fill is taken as it is."""
    if not regex:
        return template
    try:
        return m.expand(template)
    except (re.error, IndexError):
        return template


def find_offsets(rows: DataFrame, pattern: Pattern, id_col: str, text_col: str, template: str | None = None) -> DataFrame:
    """One row per match: id, match_no (from 0), start, end (in the source text), matched; with a template also new_text. Offsets go back through the normalisation."""
    source, regex = pattern.source(), pattern.regex
    names = ["id", "match_no", "start", "end", "matched", *(["new_text"] if template is not None else [])]

    def run(batches):
        compiled = re.compile(source) if pattern.text else None
        for batch in batches:
            out: tuple[list, ...] = tuple([] for _ in names)
            for i, text in enumerate(batch.column(1).to_pylist()):
                for no, (start, end, m) in enumerate(_hits(compiled, text) if text and compiled else []):
                    for column, value in zip(out, (i, no, start, end, m[0], *([_expanded(m, template, regex)] if template is not None else [])), strict=True):
                        column.append(value)
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(out[0], pa.int64())), *(pa.array(x, k) for x, k in zip(out[1:], kinds, strict=False))], names)

    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, match_no int, start int, end int, matched string" + (", new_text string" if template is not None else "")
    return rows.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def replacement_plan(rows: DataFrame, pattern: Pattern, template: str, id_col: str, text_col: str, count: int = 0) -> DataFrame:
    """The edits that `replace_first` makes, as find_offsets gives them: a dry run and the real one have the same plan. count > 0 keeps the first of all by (id, match_no)."""
    return first_n(find_offsets(rows, pattern, id_col, text_col, template), count, [F.col(id_col), F.col("match_no")])


def replace_first(rows: DataFrame, pattern: Pattern, template: str, id_col: str, text_col: str, count: int = 0) -> DataFrame:
    """rows with the first count matches replaced (all if it isn't positive) and `n_replaced`; nothing else of a text changes. Ids are distinct."""
    edits = replacement_plan(rows, pattern, template, id_col, text_col, count)
    edit = F.struct("start", "end", F.col("new_text").alias("text"))
    each = edits.groupBy(F.col(id_col).alias("__id")).agg(F.collect_list(edit).alias("__edits"))
    found = rows.join(each, rows[id_col] == F.col("__id"), "left")
    changed = F.when(F.col("__edits").isNotNull(), splice(F.col(text_col), F.col("__edits"))).otherwise(F.col(text_col))
    return found.withColumns({text_col: changed, "n_replaced": F.coalesce(F.size("__edits"), F.lit(0))}).drop("__id", "__edits")


def not_found_hints(rows: DataFrame, pattern: Pattern, id_col: str, text_col: str) -> DataFrame:
    """Texts (id) without a match that would have one if their line ends were spaces: what is sought stands over two lines."""
    joined = F.replace(F.col(text_col), F.lit("\n"), F.lit(" "))
    return rows.filter((match_count(F.col(text_col), pattern) == 0) & (match_count(joined, pattern) > 0)).select(id_col)


def find_grouped(lines: DataFrame, per: list[str], pattern: Pattern, space_gap: float) -> DataFrame:
    """Matches in the text of visual lines, which may stand over several runs, one row per piece.

    lines: `per`, baseline, line_no, x0, run_id, gap and text, as layout.visual_lines gives them; a gap of space_gap or more
    before a run is a space that no run holds. Rows: per, baseline, line_no, match_no (from 0 in its line), matched, piece_no
    (from 0 in its match), run_id, start and end (characters of the run). A match of spaces between runs alone has no piece.
    """
    source, keys = pattern.source(), [*per, "baseline", "line_no"]

    def run(batches):
        compiled = re.compile(source)
        for batch in batches:
            at, rest = [], [[] for _ in range(6)]
            for row, runs in enumerate(batch.column(len(keys)).to_pylist()):
                text, index = "", []
                for r in runs:
                    own = r["text"] or ""
                    if index and r["gap"] is not None and r["gap"] >= space_gap and not text.endswith(" "):
                        text, index = text + " ", [*index, (None, -1)]
                    text += own
                    index.extend((r["run_id"], k) for k in range(len(own)))
                for no, (start, end, m) in enumerate(_hits(compiled, text) if pattern.text else []):
                    spans: dict = {}
                    for run_id, k in index[start:end]:
                        if k >= 0:
                            spans[run_id] = (min(k, spans.get(run_id, (k, k))[0]), k + 1)
                    for piece, (run_id, (low, high)) in enumerate(spans.items()):
                        at.append(row)
                        for column, value in zip(rest, (no, m[0], piece, run_id, low, high), strict=True):
                            column.append(value)
            kinds = (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
            taken = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(taken) for c in batch.columns[: len(keys)]), *(pa.array(x, k) for x, k in zip(rest, kinds, strict=True))], [*keys, "match_no", "matched", "piece_no", "run_id", "start", "end"])

    held = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("x0", F.col("run_id").cast("long").alias("run_id"), "gap", "text"))).alias("runs"))
    kinds = ", ".join(f"`{k}` {held.schema[k].dataType.simpleString()}" for k in keys)
    return held.mapInArrow(run, f"{kinds}, match_no int, matched string, piece_no int, run_id long, start int, end int")


def top_rows(found: DataFrame, per: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group by order, with `total`, how many there were: a cap never loses the count.

    Ranks are cut in every task before rows meet, totals are counted there, so a group that holds most rows stays small. What was
    found is written first, so that it is searched for once, however much that costs, and read twice.
    """
    found = written(found, "found")
    first = found.withColumn("rank", F.row_number().over(Window.partitionBy(*per).orderBy(*order))).filter(F.col("rank") <= k)
    totals = found.groupBy(*[F.col(c).alias(f"__{c}") for c in per]).agg(F.count(F.lit(1)).alias("total"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in per]
    return first.join(totals, same).drop(*[f"__{c}" for c in per])


def first_n(found: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first n rows by a declared order, all if n is not positive. Only n rows of each partition are sorted together."""
    return found.orderBy(*order).limit(n) if n > 0 else found


def java_template(template: str) -> str:
    r"""A replacement with \1 and \g<name> as Java reads it; its own dollar signs are literal."""
    return re.sub(r"\\g<(\w+)>", r"${\1}", re.sub(r"\\(\d)", r"$\1", template.replace("$", r"\$")))


def _widened(literal: str) -> str:
    """A normalised literal as an expression over texts that are not: each character stands for all that normalise to it."""
    same = {to: "".join(f for f, t in zip(FROM, TO, strict=True) if t == to) for to in set(TO)}
    own = lambda c: "\\" + c if not (c.isalnum() or c.isspace() or c == "_") else c
    return "".join(f"[{own(c)}{same[c]}]" if c in same else own(c) for c in literal)


def replace_all(rows: DataFrame, text_col: str, pattern: Pattern, template: str) -> DataFrame:
    """rows with all matches in text_col replaced, as replace_matches does it, but only rows that need Python see a worker.

    The JVM takes texts of a literal that hold no ligature (the literal's characters stand there for all that normalise to
    them) and texts of an expression that normalisation leaves alone; the others are replaced apart and put beside them.
    An expression that may match nothing goes to Python whole, since such matches don't count.
    """
    if not pattern.text:
        return rows
    text, columns = F.col(text_col), rows.columns
    in_python = lambda df: df.withColumn(text_col, replace_matches(text, pattern, template)).select(*columns)
    if re.compile(pattern.source()).search(""):
        return in_python(rows)
    if pattern.regex:
        plain, source, new = normalise(text) == text, pattern.java(), java_template(template)
    else:
        literal = plain_normalise(pattern.text)
        body = _widened(literal)
        source = "(?U)" + ("(?iu)" if pattern.ignore_case else "") + (rf"(?<!\w)(?:{body})(?!\w)" if pattern.whole_word else body)
        plain, new = ~text.rlike("[" + "".join(LIGATURES) + "]"), re.sub(r"([\\$])", r"\\\1", template)
    plain = F.coalesce(plain, F.lit(True))
    done = rows.filter(plain).withColumn(text_col, F.regexp_replace(text, source, new)).select(*columns)
    return done.unionByName(in_python(rows.filter(~plain)))


def replace_matches(text: Column, pattern: Pattern, template: str) -> Column:
    """All matches replaced; what isn't matched stays as it is, also where it is written in characters that the search takes as others.

    Texts that normalisation leaves alone are replaced by the JVM. Only the others, and all under an expression that may
    match nothing (such matches don't count), go to Python.
    """
    source, regex = pattern.source(), pattern.regex
    if not pattern.text:
        return text

    @F.pandas_udf("string")
    def spliced(texts: pd.Series) -> pd.Series:
        compiled = re.compile(source)

        def one(t):
            if t is None:
                return None
            for start, end, m in reversed(_hits(compiled, t)):
                t = t[:start] + _expanded(m, template, regex) + t[end:]
            return t

        return texts.map(one, na_action="ignore")

    if re.compile(source).search(""):
        return spliced(text)
    plain = normalise(text) == text
    replaced = F.regexp_replace(text, pattern.java(), java_template(template) if regex else re.sub(r"([\\$])", r"\\\1", template))
    return F.when(plain, replaced).otherwise(spliced(F.when(~plain, text)))


def glyph_span(char_to_glyph: Column, start: Column, end: Column) -> Column:
    """struct<start, end, expanded> of the glyphs that characters [start, end) stand on; characters without a glyph are below 0. Null if none has one.

    expanded: those glyphs hold other characters, too (a ligature that is cut), so an edit of them changes more than was asked for.
    """
    on = F.filter(F.slice(char_to_glyph, start + 1, F.greatest(end - start, F.lit(0))), lambda g: g >= 0)
    #: As the one element of an array, so that ends and number are told once and not for every glyph.
    ends = F.array(F.struct(F.array_min(on).alias("low"), F.array_max(on).alias("high"), F.size(on).alias("n")))
    held = lambda s: F.size(F.filter(char_to_glyph, lambda g: (g >= s["low"]) & (g <= s["high"])))
    spans = F.transform(ends, lambda s: F.when(s["n"] > 0, F.struct(s["low"].alias("start"), (s["high"] + 1).alias("end"), (held(s) > s["n"]).alias("expanded"))))
    return F.get(spans, F.lit(0))


def pieces(chars: DataFrame, match_cols: list[str], run_col: str, char_col: str, order_col: str) -> DataFrame:
    """Matched characters to one piece per match and run: start, end, piece_no in reading order. Synthetic characters (below 0) fall out."""
    real = chars.filter(F.col(char_col) >= 0)
    spans = real.groupBy(*match_cols, run_col).agg(F.min(char_col).alias("start"), (F.max(char_col) + 1).alias("end"), F.min(order_col).alias("first"))
    return spans.withColumn("piece_no", F.row_number().over(Window.partitionBy(*match_cols).orderBy("first")) - 1).drop("first")


def edits_of(found: DataFrame, match_cols: list[str], new_text: Column, old_text: Column) -> DataFrame:
    """Pieces to edits: the first carries all new and old text, later ones continue it; matches of one piece have group 0."""
    several = F.count(F.lit(1)).over(Window.partitionBy(*match_cols)) > 1
    first = F.col("piece_no") == 0
    group = F.when(several, F.xxhash64(*match_cols)).otherwise(F.lit(0).cast("long"))
    return found.withColumns({"new_text": F.when(first, new_text).otherwise(""), "old_text": F.when(first, old_text).otherwise(""), "continuation": ~first, "group": group})


def atomic(edits: DataFrame, refused: Column, group_col: str) -> DataFrame:
    """Edits with `applied`: one refused member refuses its whole group; group 0 (or null) is none, its edits stand alone.

    Only groups with a refused member are joined, and edits without a group take no part in the join.
    """
    own = F.coalesce(refused, F.lit(False))
    alone = F.coalesce(F.col(group_col) == 0, F.lit(True))
    bad = edits.filter(~alone & own).select(F.col(group_col).alias("__bad")).distinct()
    grouped = edits.filter(~alone).join(bad, F.col(group_col) == F.col("__bad"), "left").withColumn("applied", F.col("__bad").isNull()).drop("__bad")
    return edits.filter(alone).withColumn("applied", ~own).unionByName(grouped)


def refusal(start: Column, end: Column, size: Column, found: Column) -> Column:
    """Why an edit is refused, null if it isn't."""
    return F.when(~found, "no such run").when((start < 0) | (start >= end) | (end > size), "range outside the run")


def splice(text: Column, edits: Column) -> Column:
    """Edits (array<struct<start, end, text>>, not overlapping) applied from the last to the first, so earlier offsets hold."""
    back = F.reverse(F.array_sort(edits))
    return F.aggregate(back, text, lambda t, e: F.concat(F.substr(t, F.lit(1), e["start"]), e["text"], F.substr(t, e["end"] + 1, F.length(t))))
