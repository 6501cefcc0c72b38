"""Fill-in-middle: a text is cut at two unit boundaries and its parts are put in another order, marked by sentinels.

Cuts are found by a sparse checkpoint index. One pass over a text's UTF-8 bytes counts its units (lines or code points) and
writes down, for every STEP-th unit, the byte and the code point where it begins; a text of n units has n / STEP + 1
checkpoints, and the pass holds WINDOW bytes of marks at a time. A cut is a unit's number: a binary search gives the last
checkpoint at or before it, and from there at most STEP units are read again.

Draws depend on the id and the seed alone (the first four 8-digit groups of the hex SHA-256 of "seed:id"), so reruns and
other partitionings agree. Rows never meet: there is no shuffle.

Defined results: a null text is empty; an empty text and one that holds a sentinel stay as they are (form plain, no cuts),
as does the share of rows above fim_percent. A null id draws like an empty one. Cuts may fall together or on the text's ends,
so any part may be empty. Equal rows give equal results; an empty table gives an empty one; columns other than the id and the
text play no part.
"""

from __future__ import annotations

import hashlib
import re
import struct
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import give_back, small_batches

STEP, WINDOW = 64, 1 << 16
LINE, CHARACTER = "line", "character"


def _begins(part: np.ndarray, unit: str, low: int) -> np.ndarray:
    """The bytes of the text where units begin that this window tells of, but for the text's first."""
    at = np.flatnonzero(part == 10) + 1 if unit == LINE else np.flatnonzero((part & 0xC0) != 0x80)
    at += low
    return at[1:] if len(at) and at[0] == 0 else at


class Checkpoints:
    """n units of a text; units, at_byte and at_char say where every step-th begins."""

    def __init__(self, data: bytes, unit: str = LINE, step: int = STEP, window: int = WINDOW):
        self.data, self.unit, self.units, self.at_byte, self.at_char = data, unit, [0], [0], [0]
        begun, chars = 1, 0  # units and code points that begin before the window
        for low in range(0, len(data), window):
            part = np.frombuffer(data, np.uint8, min(window, len(data) - low), low)
            begins = _begins(part, unit, low)
            begins = begins[begins < len(data)]
            marks = begins[-begun % step :: step]
            lead, seen = (part & 0xC0) != 0x80, 0
            self.units += range(begun + -begun % step, begun + len(begins), step)
            for mark in marks.tolist():
                chars += int(np.count_nonzero(lead[seen : mark - low]))
                seen = mark - low
                self.at_byte.append(mark)
                self.at_char.append(chars)
            begun, chars = begun + len(begins), chars + int(np.count_nonzero(lead[seen:]))
        self.n, self.chars = begun if data else 0, chars

    def locate(self, cut: int) -> tuple[int, int]:
        """(byte, code point) where unit number `cut` begins; that of n is the text's end."""
        if cut >= self.n:
            return len(self.data), self.chars
        k = bisect_right(self.units, cut) - 1
        start = at = self.at_byte[k]
        if self.unit == LINE:
            for _ in range(cut - self.units[k]):
                at = self.data.index(b"\n", at) + 1
            return at, self.at_char[k] + len(self.data[start:at].decode("utf-8", "surrogatepass"))
        ahead = self.data[start : start + 4 * (cut - self.units[k])].decode("utf-8", "ignore")[: cut - self.units[k]]
        return start + len(ahead.encode()), cut


@dataclass(frozen=True)
class Plan:
    """What marks prefix, suffix and middle, the unit of cuts, the seed, how many of a hundred rows are cut, and how many of those have the suffix first."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    unit: str = LINE
    seed: int = 7
    fim_percent: int = 100
    spm_percent: int = 50

    def marks(self) -> tuple[bytes, bytes, bytes]:
        return self.prefix.encode(), self.suffix.encode(), self.middle.encode()


def draws(seed: int, row_id: str) -> tuple[int, int, int, int]:
    return struct.unpack(">4I", hashlib.sha256(f"{seed}:{row_id}".encode()).digest()[:16])


def transform(data: bytes, row_id: str, plan: Plan) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of the prefix, of the middle, output) of one text."""
    index = Checkpoints(data, plan.unit)
    a, b, c, d = draws(plan.seed, row_id)
    p, s, m = plan.marks()
    if not data or p in data or s in data or m in data or c % 100 >= plan.fim_percent:
        return index.n, "plain", None, None, data
    first, second = sorted((a % (index.n + 1), b % (index.n + 1)))
    (low, chars), (high, more) = index.locate(first), index.locate(second)
    prefix, middle, suffix = data[:low], data[low:high], data[high:]
    spm = d % 100 < plan.spm_percent
    output = s + suffix + p + prefix + m + middle if spm else p + prefix + s + suffix + m + middle
    return index.n, "spm" if spm else "psm", chars, more - chars, output


def fill_in_middle(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, n (units), form (plain, psm, spm), prefix_chars, middle_chars, output."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            made = [transform(data, row_id, plan) for data, row_id in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            columns = list(zip(*made, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=False)), pa.array(columns[4], pa.binary()).cast(pa.string())], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("draw"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("data"))
    return rows.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("id", id_col)


def restored(output: Column, form: Column, plan: Plan = Plan()) -> Column:
    """The text that an output was made of, by the output and its form alone. No part holds a sentinel, so there are three."""
    parts = F.split(output, "|".join(re.escape(x) for x in (plan.prefix, plan.suffix, plan.middle)), 4)
    one, two, three = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "psm", F.concat(one, three, two)).when(form == "spm", F.concat(two, three, one)).otherwise(output)
