"""Token counts by a map-side two-tier lookup.

Tier one is a compact table from frequent pre-token units (see units.py) to their number of ids. Which HOT units it holds
comes from a sample of about SAMPLE rows, taken by a hash of id and text and counted in one task: no
pre-token of the table is shuffled. The sample has a bound whatever the table holds: rows of more than SAMPLE_BYTES stay out of it, and
of rows that are equal, so that the hash takes all or none, no more than twice SAMPLE are taken. The table is bounded (HOT units of at most HOT_CHARS characters, so under 6 MB) and
broadcast.
Tier two encodes misses with the library and keeps them in a bounded cache of the worker. Counts never depend on
what either tier holds, so they are those of the library for every whole text.

Defined results: a null text is empty (0 bytes, 0 tokens); equal rows give equal results; an empty table gives an
empty one; a text of any length is handled whole; columns other than the id and the text play no part.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .units import _LONG, Generations, UnitEncoder, unit_encoder

HOT, HOT_CHARS = 65_536, 48
#: Rows that the hot units are counted in, and distinct units that are held at most meanwhile.
SAMPLE, SAMPLE_HELD = 20_000, 400_000
#: The longest text of the sample: with 2 * SAMPLE rows, 2.6 GB at most stream through that task.
SAMPLE_BYTES = 65_536


def _most_frequent(hot: int):
    def run(batches):
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update((text or "").split(" ")[1:])
                if len(counts) > SAMPLE_HELD:
                    counts = Counter(dict(counts.most_common(SAMPLE_HELD // 2)))
        usable = [(-n, u) for u, n in counts.items() if u and not u[0].isspace() and len(u) <= HOT_CHARS]
        yield pa.RecordBatch.from_arrays([pa.array([u for _, u in nsmallest(hot, usable)], pa.string())], ["unit"])

    return run


def hot_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, sample: int = SAMPLE) -> list[str]:
    """Frequent units, at most hot of them, by a sample of about `sample` rows."""
    share = min(1.0, sample / max(1, docs.count()))
    text = F.col(text_col).cast("string")
    some = docs.filter((F.octet_length(text) <= SAMPLE_BYTES) & (F.pmod(F.xxhash64(F.col(id_col), text, F.lit(3)), F.lit(1 << 30)) < math.ceil(share * (1 << 30))))
    top = some.select(text.alias("text")).limit(2 * sample).repartition(1).mapInArrow(_most_frequent(hot), "unit string")
    return [r["unit"] for r in top.collect()]


def compact_table(units: list[str], encoder: UnitEncoder) -> tuple[bytes, bytes]:
    """Units and their numbers of ids, packed. Units hold no space, so a space parts them; longer lengths than a byte stay out."""
    sized = [(u, len(encoder.encode_unit(" " + u)) // 4) for u in units]
    sized = [(u, n) for u, n in sized if n < 256]
    return zlib.compress(" ".join(u for u, _ in sized).encode("utf-8", "surrogatepass"), 1), bytes(n for _, n in sized)


class _Counts(dict):
    """Tier one as a dict; what it lacks is asked of tier two."""

    def __init__(self, packed: tuple[bytes, bytes], encoder: UnitEncoder):
        units = zlib.decompress(packed[0]).decode("utf-8", "surrogatepass")
        super().__init__(zip(units.split(" ") if packed[1] else [], packed[1], strict=True))
        self.encoder, self.cold = encoder, Generations(self._count, 250_000)

    def _count(self, key: str) -> int:
        return len(self.encoder.encode_key(key)) // 4

    def __missing__(self, key: str) -> int:
        return self.cold[key] if len(key) < _LONG else self._count(key)

    def of_many(self, texts: pa.Array) -> Iterator[int]:
        """The number of ids of each text; each distinct unit is looked up once for many texts."""
        for _, keys, unit, ends, rest in self.encoder.split(texts):
            if keys is None:
                yield from (len(self.encoder.encode(t)) // 4 for t in rest)
                continue
            upto = np.cumsum(np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))[unit])[ends - 1]
            yield from np.diff(upto, prepend=0).tolist()


@lru_cache(2)
def _worker_counts(packed: tuple[bytes, bytes], path: str, pattern: str) -> _Counts:
    return _Counts(packed, unit_encoder(path, pattern))


def count_tokens(docs: DataFrame, tokenizer_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, hot: int = HOT) -> DataFrame:
    """One row per input row: id_col, n_bytes, n_tokens, over_limit (more than limit tokens)."""
    packed = docs.sparkSession.sparkContext.broadcast(compact_table(hot_units(docs, id_col, text_col, hot), unit_encoder(tokenizer_file, pattern)))

    def run(batches):
        counts = _worker_counts(packed.value, tokenizer_file, pattern)
        for batch in batches:
            n = list(counts.of_many(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
