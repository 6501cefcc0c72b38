"""Ranked lexical search: best-first branch and bound over a hierarchical max tree of document ranges per term.

Index. One pass over the whole texts keeps, of every document, its length and how often it holds each query term; those rows
are written once. The number of documents and terms and each term's document frequency come from them, one row per task and
term.

Search. A task streams its rows into blocks of up to BLOCK documents. Over a block stands a tree: leaves are documents,
and a node is a range of FAN neighbouring nodes below it; each node holds, for every term that occurs under it, the largest
impact there (a document's impact for a term is what the term's weight is multiplied with). A node's bound for a query is the
sum of weight times that largest impact, so no document under it scores higher. Nodes are opened in the order of their bounds,
highest first, until the best bound left is below the score of the query's K-th document; a node whose bound equals it is
opened too, since a document with a smaller id may wait there. The K best of a query go on from block to block, so later blocks
open less. Every task gives K rows a query at most, and those are merged in two steps.

The queries are a stated set that meets all rows in blocks. They are dealt to groups of about ITEMS_AT_ONCE, one search each, so
what is broadcast (the terms of a group) has a bound.

Defined results: a null text has no terms; documents without terms count nowhere. Rows that repeat a document id are documents
of their own; equal scores go by id, null ids last. Rows that repeat an item's id are one item with the terms of all; a null
item id is an item of its own. An item without terms, or whose terms no document holds, has no rows, and so has an empty table.
Scores are 64-bit integers throughout; other columns play no part.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .staging import give_back, materialise, small_batches

BLOCK, FAN = 32_768, 32
ITEMS_AT_ONCE = 5_000
#: Buckets of the first step in which the tasks' best rows of an item are merged.
MERGE = 64
#: Bytes of terms (0-9, A-Z lower-cased, a-z, all beyond ASCII); the others part them.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LAST = float("inf")


def terms_of(data: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return data.translate(_TERM_BYTES).split()


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def impacts(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term's weight is multiplied with, for each occurrence row (tf, the document's length)."""
    m = 50 + (50 * length.astype(np.int64) * n_docs) // n_terms
    return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 20 * m)


class MaxTree:
    """levels[0] are documents, the last has one node. A level: where each node's entries begin, their terms, their largest impacts."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, values: np.ndarray, n_all_terms: int, fan: int = FAN):
        self.levels = [(starts, terms, values)]
        self.fan = fan
        while len(starts) > 2:
            n = -(-(len(starts) - 1) // fan)
            node = np.repeat(np.arange(len(starts) - 1) // fan, np.diff(starts))
            key = node * n_all_terms + terms
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            values = np.maximum.reduceat(values[order], first) if len(first) else values
            node, terms = key[first] // n_all_terms, key[first] % n_all_terms
            starts = np.searchsorted(node, np.arange(n + 1))
            self.levels.append((starts, terms, values))
        #: Nodes opened so far, and documents scored.
        self.opened = self.scored = 0

    def bounds(self, level: int, low: int, high: int, weight: np.ndarray) -> np.ndarray:
        """Of nodes low to high of a level: the sums of weight times largest impact; of documents, their scores."""
        starts, terms, values = self.levels[level]
        begin, end = int(starts[low]), int(starts[high])
        upto = np.concatenate([[0], np.cumsum(weight[terms[begin:end]] * values[begin:end])])
        cut = starts[low : high + 1] - begin
        return upto[cut[1:]] - upto[cut[:-1]]

    def search(self, weight: np.ndarray, best: list, k: int, ids: list) -> None:
        """Puts the documents that belong there into best, a heap of the k best as (score, -id): those with a score above 0."""
        top = len(self.levels) - 1
        if not len(self.levels[0][0]) - 1:
            return
        open_ = [(-int(b), top, node) for node, b in enumerate(self.bounds(top, 0, len(self.levels[top][0]) - 1, weight)) if b > 0]
        heapq.heapify(open_)
        while open_ and (len(best) < k or -open_[0][0] >= best[0][0]):
            bound, level, node = heapq.heappop(open_)
            if level == 0:
                self.scored += 1
                own = (-bound, -_LAST if ids[node] is None else -ids[node])
                if len(best) < k:
                    heapq.heappush(best, own)
                elif own > best[0]:
                    heapq.heapreplace(best, own)
                continue
            self.opened += 1
            low = node * self.fan
            below = self.bounds(level - 1, low, min(low + self.fan, len(self.levels[level - 1][0]) - 1), weight)
            least = max(1, best[0][0]) if len(best) == k else 1
            for child in np.flatnonzero(below >= least).tolist():
                heapq.heappush(open_, (-int(below[child]), level - 1, low + child))


def _index(term_no: dict[bytes, int]):
    """Rows (id, text in UTF-8) to (id, length, terms, tfs), documents without terms left out."""

    def run(batches):
        for batch in batches:
            at, length, cuts, numbers, tfs = [], [], [0], [], []
            for row, data in enumerate(batch.column(1).to_pylist()):
                words = terms_of(data) if data else ()
                if words:
                    held = Counter(words)
                    known = sorted((term_no[t], held[t]) for t in held.keys() & term_no.keys())
                    numbers += [no for no, _ in known]
                    tfs += [tf for _, tf in known]
                    at.append(row), length.append(len(words)), cuts.append(len(numbers))
            lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x, pa.int32())) for x in (numbers, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(length, pa.int64()), *lists], ["id", "length", "terms", "tfs"])
        give_back()

    return run


def _frequencies(n_all_terms: int):
    """Index rows to (term, df), one row a task and term."""

    def run(batches):
        df = np.zeros(n_all_terms, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=n_all_terms)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(df[held], pa.int64())], ["term", "df"])

    return run


def _search(shared, k: int, block: int, fan: int):
    """Index rows to (item, id, score), the k best of a task for each item."""

    def run(batches):
        items, weight_of, n_docs, n_terms = shared.value
        best: list[list] = [[] for _ in items]
        weight = np.zeros(len(weight_of), np.int64)

        def searched(parts):
            ids = [i for p in parts for i in p[0]]
            length, cuts, terms, tfs = (np.concatenate([p[c] for p in parts]) for c in range(1, 5))
            tree = MaxTree(np.concatenate([[0], np.cumsum(cuts)]), terms.astype(np.int64), impacts(tfs, np.repeat(length, cuts), n_docs, n_terms), len(weight_of), fan)
            for own, found in zip(items, best, strict=True):
                weight[own] = weight_of[own]
                tree.search(weight, found, k, ids)
                weight[own] = 0

        parts, held = [], 0
        for batch in batches:
            for low in range(0, batch.num_rows, block):
                part = batch.slice(low, block)
                counts = np.diff(part.column(2).offsets.to_numpy())
                parts.append((part.column(0).to_pylist(), part.column(1).to_numpy(zero_copy_only=False), counts, part.column(2).flatten().to_numpy(zero_copy_only=False), part.column(3).flatten().to_numpy(zero_copy_only=False)))
                held += part.num_rows
                if held >= block:
                    searched(parts)
                    parts, held = [], 0
        if parts:
            searched(parts)
        rows = [(no, None if d == -_LAST else -d, s) for no, found in enumerate(best) for s, d in found]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["item", "id", "score"])
        give_back()

    return run


def _searched(docs: DataFrame, items: list[tuple], k: int, id_col: str, text_col: str, block: int, fan: int) -> DataFrame:
    """(item, the place of its id in items; id; score) of each task's best. items: (id, its terms)."""
    spark = docs.sparkSession
    term_no = {t: no for no, t in enumerate(sorted({t for _, own in items for t in own}))}
    told = spark.sparkContext.broadcast(term_no)

    def indexed(batches):
        yield from _index(told.value)(batches)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("data"))
    index = materialise(rows.mapInArrow(indexed, "id long, length long, terms array<int>, tfs array<int>"), "lexical-index")
    n_docs, n_terms = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    df = np.zeros(len(term_no), np.int64)
    #: One row for each term of the queries at most.
    for r in index.select("terms").mapInArrow(_frequencies(len(term_no)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    numbered = [np.array(sorted(term_no[t] for t in own), np.int64) for _, own in items]
    shared = spark.sparkContext.broadcast((numbered, weights(n_docs, df), n_docs, n_terms))
    return index.mapInArrow(_search(shared, k, block, fan), "item long, id long, score long")


def top_documents(docs: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """For each item its k best documents: item_col, rank (from 1), id_col, score."""
    small_batches(docs.sparkSession)
    asked = queries.select(F.col(item_col).alias("item"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).cast("binary").alias("data"))
    groups = max(1, math.ceil(asked.count() / ITEMS_AT_ONCE))
    kind = asked.schema["item"].dataType.simpleString()
    best = None
    for g in range(groups):
        own: dict = {}
        for r in asked.filter(F.pmod(F.xxhash64("item"), F.lit(groups)) == g).collect():  # about ITEMS_AT_ONCE rows
            own.setdefault(r["item"], set()).update(terms_of(bytes(r["data"])))
        items = sorted(own.items(), key=lambda x: (x[0] is None, x[0]))
        if not any(t for _, t in items):
            continue
        names = docs.sparkSession.createDataFrame([(no, i) for no, (i, _) in enumerate(items)], f"item long, name {kind}")
        found = _searched(docs, items, k, id_col, text_col, block, fan)
        order = [F.desc("score"), F.asc_nulls_last("id")]
        dealt = found.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(MERGE)))
        few = dealt.withColumn("at", F.row_number().over(Window.partitionBy("item", "bucket").orderBy(*order))).filter(F.col("at") <= k)
        ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
        one = ranked.join(F.broadcast(names), "item").select(F.col("name").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
        best = one if best is None else best.unionByName(one)
    return best if best is not None else docs.sparkSession.createDataFrame([], f"`{item_col}` {kind}, rank int, `{id_col}` long, score long")
