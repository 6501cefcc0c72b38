"""Quality classifier by co-training: a text view and a page view teach each other, calibrated views score all.

Views. The text view holds the words alone: lower-cased words and word shapes, hashed into 2**TEXT_BITS buckets, as
counts over the whole text. The page view holds what is known of the page without its words: language, source, the
stored length, and facts of layout and character classes (shares of punctuation, digits, capitals, repeated words and
lines, distinct words, words and characters to a line), each in LEVELS steps. Each view's model is a logistic
regression.

Both views are computed once, map-side, and written with a document's id (and its row, where the caller wants rows
back); every later pass reads those few hundred bytes, not the text.

Training takes at most LABELLED labelled rows, chosen by a seeded hash of the id: that bound is a parameter. Three
fifths of them are fitted on, one fifth calibrates (each view, their combination and the threshold), one fifth is only
reported on. In each of ROUNDS rounds both views score every document that has no label; of those where a view is
confident (calibrated probability beyond CONFIDENT on either side), the EACH surest of the whole table on either side
go, with that label, to the other view's training rows. A fit runs in one task of an executor, over the labelled rows
and at most 4 * EACH * ROUNDS more; the driver gets the weights. The two calibrated log-odds are combined by a third
logistic regression.

A document is kept when its score reaches the threshold: the lowest that no more than KEEP_LOSS of the calibrating good
rows miss and that rejects most bad ones.

Defined results: a null or empty text has no words, and page facts of zero; null metadata is a value of its own; of
several labels of a document the lowest counts; null labels and ids do not. Where the rows fitted on show one class
only, or none, all documents get that share as their score and are kept. Rows that repeat an id get scores of their
own (one of them, by its features, is trained on); an empty table gives an empty result; columns missing from `docs`
count as null, others pass through `keep_good` unchanged, whatever they are called.
"""

from __future__ import annotations

import math
import operator
import pickle
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import give_back, materialise, release, small_batches
from .units import Generations

LABELLED = 6_000
TEXT_BITS, META_BITS, LEVELS = 14, 10, 20
ROUNDS, CONFIDENT, EACH = 3, 0.97, 400
KEEP_LOSS = 0.005
MEASURES = 9
META_WIDTH = (1 << META_BITS) + MEASURES * LEVELS + 1
#: Rows whose features are made at once.
SLICE = 250
_SHAPE = str.maketrans({**{c: "x" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "X" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "9" for c in "0123456789"}})
_RUN = re.compile(r"(.)\1+")
_MARKS, _DIGITS, _CAPITALS, _SPACES = b"!\"#$%&()*+/:;<=>?@[\\]^_`{|}~", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" \n\t\r"


def _bucket(text: str, bits: int) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) >> (32 - bits)


def _word_buckets(word: str) -> int:
    """Of the word and of its shape, runs of one kind of letter written once: two buckets in one number."""
    shape = _RUN.sub(r"\1", "".join("x" if c.islower() else "X" if c.isupper() else c for c in word.translate(_SHAPE)))
    return _bucket("w " + word.lower(), TEXT_BITS) << TEXT_BITS | _bucket("s " + shape[:24], TEXT_BITS)


_words = Generations(_word_buckets, 50_000)


def _measures(text: str, words: list[str], kinds: int) -> list[float]:
    """MEASURES shares, 0 to 1 mostly."""
    n, lines = max(1, len(text)), text.split("\n")
    plain = text.encode("ascii", "ignore")
    caps = len(plain) - len(plain.translate(None, _CAPITALS))
    digits = len(plain) - len(plain.translate(None, _DIGITS))
    marks = len(plain) - len(plain.translate(None, _MARKS))
    spaces = len(plain) - len(plain.translate(None, _SPACES))
    count = max(1, len(words))
    repeated = sum(map(operator.eq, words, words[1:]))
    return [4 * marks / n, 4 * digits / n, caps / max(1, n - digits - marks - spaces), spaces / n * 2, kinds / count, repeated / count, 1 - len(set(lines)) / len(lines), math.log2(1 + count / len(lines)) / 10, math.log2(1 + n / len(lines)) / 14]


@lru_cache(20_000)
def _meta_bucket(text: str) -> int:
    return _bucket(text, META_BITS)


def page_places(text: str, words: list[str], kinds: int, lang, source, stored) -> list[int]:
    size = -1 if stored is None or stored < 0 else int(2 * math.log2(1 + stored))
    named = [_meta_bucket(f"l {lang}"), _meta_bucket(f"s {source}"), _meta_bucket(f"n {size}"), META_WIDTH - 1]
    return named + [(1 << META_BITS) + k * LEVELS + min(LEVELS - 1, max(0, int(LEVELS * x))) for k, x in enumerate(_measures(text, words, kinds))]


def text_places(texts_words: list[dict[str, int]]) -> tuple[list[bytes], list[bytes]]:
    """For each text's word counts: its buckets in order (16-bit), and how often each is met (32-bit)."""
    n = len(texts_words)
    packed = np.fromiter((b for counts in texts_words for b in map(_words.__getitem__, counts)), np.int64)
    times = np.fromiter((c for counts in texts_words for c in counts.values()), np.float64, len(packed))
    row = np.repeat(np.arange(n, dtype=np.int64), [len(c) for c in texts_words]) << TEXT_BITS
    keys, where = np.unique(np.concatenate([row | packed >> TEXT_BITS, row | packed & ((1 << TEXT_BITS) - 1)]), return_inverse=True)
    counts = np.bincount(where, np.concatenate([times, times])).astype("<u4") if len(keys) else np.empty(0, "<u4")
    ends = np.searchsorted(keys, np.arange(n + 1, dtype=np.int64) << TEXT_BITS)
    places = (keys & ((1 << TEXT_BITS) - 1)).astype("<u2")
    return [places[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)], [counts[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]


_FEATURES = "places binary, counts binary, page binary"


def _inputs(docs: DataFrame) -> list:
    """text, lang, source, n_chars; null where docs lacks one."""
    kinds = {"text": "string", "lang": "string", "source": "string", "n_chars": "double"}
    return [(F.col(c) if c in docs.columns else F.lit(None)).cast(kind).alias(f"__view_{c}") for c, kind in kinds.items()]


def _featurise(batches):
    """Rows whose last four columns are a view's inputs, to the columns before them and the features."""
    for batch in batches:
        for low in range(0, batch.num_rows, SLICE):
            part = batch.slice(low, SLICE)
            n = part.num_columns - 4
            texts = [t or "" for t in part.column(n).to_pylist()]
            split = [t.split() for t in texts]
            counts = [Counter(w) for w in split]
            places, times = text_places(counts)
            facts = zip(texts, split, map(len, counts), *(part.column(n + k).to_pylist() for k in (1, 2, 3)), strict=True)
            page = [np.array(page_places(*x), "<u2").tobytes() for x in facts]
            yield pa.RecordBatch.from_arrays([*part.columns[:n], *(pa.array(x, pa.binary()) for x in (places, times, page))], [*part.schema.names[:n], "places", "counts", "page"])
    give_back()


class Features:
    """The written features of docs: `table` has id and the features, and the row as c0, c1, ... if it was asked for."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", rows: bool = False):
        small_batches(docs.sparkSession)
        self.docs, self.id_col, self.rows = docs, id_col, rows
        kept = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)] if rows else []
        own = docs.select(F.col(id_col).alias("id"), *kept, *_inputs(docs))
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields[:-4])
        self.table = materialise(own.mapInArrow(_featurise, f"{kinds}, {_FEATURES}"), "features")


class Sparse:
    """Rows of (places, values), for products with weights; made from binary columns without Python lists."""

    def __init__(self, places: pa.Array, counts: pa.Array | None, width: int):
        self.width, self.n = width, len(places)
        self.place, ends = _flat_values(places, "<u2")
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(ends))
        if counts is None:
            self.value = np.ones(len(self.place))
        else:
            self.value = _flat_values(counts, "<u4")[0].astype(np.float64)
            norm = np.sqrt(np.bincount(self.row, self.value**2, minlength=self.n))
            self.value *= 4 / np.maximum(norm, 1e-9)[self.row]

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.place], minlength=self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.place, self.value * g[self.row], minlength=self.width)


def _flat_values(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column without nulls, one row after another, and where rows begin and end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    width = np.dtype(kind).itemsize
    if not len(column):
        return np.empty(0, kind), np.zeros(1, np.int64)
    ends = np.frombuffer(column.buffers()[1], "<i4")[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind) if data is not None and ends[-1] > ends[0] else np.empty(0, kind)
    return flat, (ends - ends[0]) // width


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(x: Sparse, y: np.ndarray, rows: np.ndarray, steps: int = 150, penalty: float = 1e-4, start: np.ndarray | None = None) -> np.ndarray:
    """Logistic regression over the rows given by how often each counts; both classes weigh the same. Adam steps from zero or from earlier weights."""
    share = rows * np.where(y > 0.5, 0.5 / max(1e-9, (rows * (y > 0.5)).sum()), 0.5 / max(1e-9, (rows * (y <= 0.5)).sum()))
    w = np.zeros(x.width) if start is None else start.copy()
    m, v = np.zeros(x.width), np.zeros(x.width)
    for t in range(1, steps + 1):
        g = x.back(share * (_sigmoid(x.dot(w)) - y)) + penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def platt(scores: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(slope..., intercept) so that sigmoid(scores @ slope + intercept) is calibrated on (scores, y). Newton steps with a small ridge."""
    s = np.column_stack([*(np.atleast_2d(scores)), np.ones(len(y))])
    w = np.zeros(s.shape[1])
    for _ in range(40):
        p = _sigmoid(s @ w)
        g = s.T @ (p - y) + 0.05 * w
        h = (s * (p * (1 - p))[:, None]).T @ s + 0.05 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """What scoring needs: two weight vectors, their calibrations, the combination and the threshold; `report` has the accuracy on rows that nothing was fitted to."""

    def __init__(self, text, page, text_scale, page_scale, combine, threshold, report):
        self.text, self.page, self.text_scale, self.page_scale, self.combine, self.threshold, self.report = text, page, text_scale, page_scale, combine, threshold, report

    def odds(self, text: Sparse, page: Sparse) -> tuple[np.ndarray, np.ndarray]:
        return text.dot(self.text) * self.text_scale[0] + self.text_scale[1], page.dot(self.page) * self.page_scale[0] + self.page_scale[1]

    def score(self, t: np.ndarray, p: np.ndarray) -> np.ndarray:
        return _sigmoid(t * self.combine[0] + p * self.combine[1] + self.combine[2])

    def of(self, places: pa.Array, counts: pa.Array, page: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text log-odds, page log-odds, score) of rows of features."""
        t, p = self.odds(Sparse(places, counts, 1 << TEXT_BITS), Sparse(page, None, META_WIDTH))
        return t, p, self.score(t, p)


def threshold_of(scores: np.ndarray, y: np.ndarray, loss: float = KEEP_LOSS) -> float:
    """Between the good rows that may be lost and the next: as high as the loss allows, at the middle of the gap to the bad ones below."""
    good = np.sort(scores[y > 0.5])
    allowed = good[int(loss * len(good))]
    below = scores[(y <= 0.5) & (scores < allowed)]
    return float((allowed + below.max()) / 2) if len(below) else float(allowed)


def _flat(share: float) -> Model:
    return Model(np.zeros(1 << TEXT_BITS), np.zeros(META_WIDTH), [0.0, 0.0], [0.0, 0.0], [0.0, 0.0, math.log((share + 1e-9) / (1 - share + 1e-9))], -1.0, {})


def fit_views(table: pa.Table, before: Model | None = None) -> Model:
    """table: id, label, part (0 fitted on, 1 calibrating, 2 reported on), to_text and to_page (labels that the other view gave), features."""
    table = table.sort_by([("id", "ascending"), ("places", "ascending"), ("page", "ascending")])
    column = lambda name: table[name].to_numpy().astype(float)
    label, part, told = column("label"), column("part"), (column("to_text"), column("to_page"))
    fitted = ~np.isnan(label) & (part == 0)
    if len({*label[fitted]}) < 2:
        known = label[~np.isnan(label)]
        return _flat(float(known.mean()) if len(known) else 1.0)
    xs = Sparse(table["places"], table["counts"], 1 << TEXT_BITS), Sparse(table["page"], None, META_WIDTH)
    split = [~np.isnan(label) & (part == k) for k in (1, 2)]
    calibrating = split[0] if len({*label[split[0]]}) == 2 else fitted
    weights, scales, odds = [], [], []
    for x, other, old in zip(xs, told, (before.text, before.page) if before else (None, None), strict=True):
        y = np.where(fitted, label, other)
        rows = ~np.isnan(y)
        weights.append(fit(x, np.where(rows, y, 0.0), rows.astype(float), 60 if before else 150, start=old))
        raw = x.dot(weights[-1])
        scales.append(platt(raw[calibrating], label[calibrating]))
        odds.append(raw * scales[-1][0] + scales[-1][1])
    combine = platt(np.array([o[calibrating] for o in odds]), label[calibrating])
    model = Model(weights[0], weights[1], scales[0], scales[1], combine, 0.0, {})
    scores = model.score(*odds)
    model.threshold = threshold_of(scores[calibrating], label[calibrating])
    kept, y = scores[split[1]] >= model.threshold, label[split[1]]
    share = lambda x: float(x.mean()) if len(x) else math.nan
    right = [share((o[split[1]] > 0) == (y > 0.5)) for o in odds]
    model.report = {
        "fitted": int(fitted.sum()), "calibrating": int(calibrating.sum()), "reported": int(split[1].sum()), "good_kept": share(kept[y > 0.5]), "bad_rejected": share(~kept[y <= 0.5]),
        "text_right": right[0], "page_right": right[1], "weights": [float(c) for c in combine[:2]], "taught_by_text": int((~np.isnan(told[1])).sum()), "taught_by_page": int((~np.isnan(told[0])).sum()),
    }
    return model


def _fit_in_task(rows: DataFrame, before: Model | None) -> Model:
    """fit_views in one task: rows are the labelled ones and those that views have taught, whose numbers are bounded."""

    def run(batches):
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        model = fit_views(table, before) if table is not None else _flat(1.0)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])
        del table
        give_back()

    found = rows.coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(bytes(found[0])) if found is not None else _flat(1.0)


def _odds(table: DataFrame, model: Model) -> DataFrame:
    """(id, t, p): both views' log-odds of every row."""
    shared = table.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            t, p, _ = shared.value.of(batch.column(1), batch.column(2), batch.column(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(t), pa.array(p)], ["id", "t", "p"])

    return table.select("id", "places", "counts", "page").mapInArrow(run, "id long, t double, p double")


def train(features: Features, labels: DataFrame, label_col: str = "quality", seed: int = 5, labelled: int = LABELLED, rounds: int = ROUNDS, each: int = EACH) -> Model:
    own = features.table.select(F.col("id").cast("long").alias("id"), "places", "counts", "page").filter("id IS NOT NULL")
    named = labels.select(F.col(features.id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("label")).filter("id IS NOT NULL AND label IS NOT NULL")
    named = materialise(named.groupBy("id").agg((F.min("label") > 0).cast("double").alias("label")), "labels")
    draw = F.xxhash64("id", F.lit(seed))
    some = named.join(own.select("id").distinct(), "id", "left_semi").orderBy(draw, "id").limit(labelled)
    fifth = F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(5))
    part = F.when(fifth < 3, 0.0).when(fifth == 3, 1.0).otherwise(2.0)
    some = materialise(some.withColumn("part", part), "some")
    once = lambda rows: rows.groupBy("id").agg(F.min(F.struct(*[c for c in rows.columns if c != "id"])).alias("x")).select("id", "x.*")
    none = F.lit(None).cast("double")
    columns = ["id", "label", "part", "to_text", "to_page", "places", "counts", "page"]
    rows = own.join(F.broadcast(some), "id").withColumns({"to_text": none, "to_page": none}).select(*columns)
    rows = materialise(once(rows).select(*columns), "training")
    model = _fit_in_task(rows, None)
    tables = [rows]
    for _ in range(rounds if model.report else 0):
        taught = rows.filter("label IS NULL").select("id", "to_text", "to_page")
        free = materialise(_odds(own, model).join(named.select("id"), "id", "left_anti").groupBy("id").agg(F.max("t").alias("t"), F.max("p").alias("p")), "free")
        sure = math.log(CONFIDENT / (1 - CONFIDENT))
        chosen = None
        for teacher, pupil in (("t", "to_page"), ("p", "to_text")):
            new = free.join(F.broadcast(taught.filter(F.col(pupil).isNotNull()).select("id")), "id", "left_anti")
            for value, odds in ((1.0, F.col(teacher)), (0.0, -F.col(teacher))):
                top = new.filter(odds >= sure).orderBy(odds.desc(), draw, "id").limit(each)
                top = top.select("id", *[(F.lit(value) if c == pupil else none).alias(c) for c in ("to_text", "to_page")])
                chosen = top if chosen is None else chosen.union(top)
        said = materialise(chosen.union(taught).groupBy("id").agg(F.max("to_text").alias("to_text"), F.max("to_page").alias("to_page")), "taught")
        more = own.join(F.broadcast(said), "id").withColumns({"label": none, "part": F.lit(0.0)}).select(*columns)
        tables += [free, said]
        rows = materialise(rows.filter("label IS NOT NULL").union(once(more).select(*columns)), "training")
        tables.append(rows)
        model = _fit_in_task(rows, model)
    release(named, some, *tables)
    return model


def score(features: Features, model: Model) -> DataFrame:
    """One row per input row: its id, text_score and page_score (calibrated probabilities of each view), score, kept."""
    shared = features.table.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            t, p, total = shared.value.of(batch.column(1), batch.column(2), batch.column(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_sigmoid(t)), pa.array(_sigmoid(p)), pa.array(total), pa.array(total >= shared.value.threshold)], ["id", "text_score", "page_score", "score", "kept"])

    kind = features.docs.schema[features.id_col].dataType.simpleString()
    own = features.table.select("id", "places", "counts", "page")
    return own.mapInArrow(run, f"id {kind}, text_score double, page_score double, score double, kept boolean").withColumnRenamed("id", features.id_col)


def keep_good(features: Features, model: Model) -> DataFrame:
    """The rows that the model keeps, with the columns of docs. features must hold rows."""
    shared, names = features.table.sparkSession.sparkContext.broadcast(model), features.docs.columns

    def run(batches):
        for batch in batches:
            total = shared.value.of(*batch.columns[len(names) :])[2]
            yield pa.RecordBatch.from_arrays(batch.columns[: len(names)], names).filter(pa.array(total >= shared.value.threshold))

    own = features.table.select(*[f"c{k}" for k in range(len(names))], "places", "counts", "page")
    return own.mapInArrow(run, features.docs.schema)
