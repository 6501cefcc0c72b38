"""Near-duplicate classes from DartMinHash signatures and banded joining, exactly verified.

Signatures. Darts fall on the plane (weight, rank) of every element as a Poisson process of rate 1 that hashes
decide: layer v of an element holds weights from 2**v - 1 to 2**(v + 1) - 1, and its darts arrive at ranks whose
gaps are exponential with rate 2**v. A set keeps the darts below its elements' weights; each dart belongs to one of
COORDINATES coordinates, and of a coordinate the earliest dart stays. Two sets agree in a coordinate with the
probability of their weighted Jaccard similarity. Only ranks below (k ln k + 2k) / total weight are thrown, since
that many darts fill k coordinates; a set that lacks one is thrown again up to twice the rank. The time follows
elements plus darts, not elements times coordinates.

Classes. Words are lower-cased runs of letters, digits and underscores, shingles are SHINGLE words, and two
documents link when the Jaccard similarity of their shingle sets is THRESHOLD or more (so weights are 1 here;
`signatures` takes any). A document of fewer words is one shingle. Steps, all over distributed tables:
 1. Documents with the same shingle set become one row, counted map-side, however many they are. The set's 128-bit
    key stands for it; a number given once, when the table of sets is written, stands for the key.
 2. BANDS hashes of ROWS coordinates put each into buckets; buckets of one are dropped.
 3. In each bucket the hub, the member that shares most bucket places over all bands, is paired with every other.
    Of a group of copies with own changes that is the original, which all are nearest to.
 4. Pairs are verified on the whole shingle sets; links give components.
 5. Members that share a hub are a superset of those that share a bucket. Where such a group still holds several
    components, its members meet in cells of two blocks of about BLOCK members, each with a byte of each of its
    coordinates and no shingles: who agrees with no member of another component in MAYBE coordinates has no link
    there (a pair at the threshold agrees in fewer once in 10**9). The others meet in cells of two blocks of about
    CELL_BYTES of whole shingle sets. Such a cell counts what its sets share through an inverted index and gives a
    link only where it joins components that the cell has not joined yet: fewer links than members, however similar
    all are. Nothing is capped; time in a group that stays apart grows with the square of its members, in signature
    bytes first and in shingles only for what may be linked.
A pair at the threshold meets in a band with probability 1 - (1 - 0.8**6)**32 > 0.9999.

Defined results: a document without words has no shingle; such documents share a class when their texts are equal
(a null text is empty). Rows that repeat an id are in one class each by their texts; the id belongs to that of its
sets with the least key. A class is named by the smallest id that belongs to one of its sets; one without such an id
(all its ids have other texts to which they belong) by a negative number made from its least key. Rows with a null id
are in the class of their text; null alone belongs to no set, so a class of such rows only has a name of the second
kind. Of a class the row with the smallest (id, MD5 of the text) is kept. An empty table gives an empty result; other
columns play no part. Texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .staging import give_back, materialise, release, small_batches
from .units import Generations

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 6
COORDINATES = BANDS * ROWS
BLOCK, CELL_BYTES = 512, 4_000_000
#: Coordinates that agree of a pair that may be at the threshold: 6 standard deviations below what such a pair expects.
MAYBE = math.floor(COORDINATES * THRESHOLD - 6 * math.sqrt(COORDINATES * THRESHOLD * (1 - THRESHOLD)))
#: Documents whose darts are held at once: each needs about k ln k + 2k of them, however short it is.
SKETCHED = 150
_WORD = re.compile(r"\w+")
_U = np.uint64


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of 64-bit values (the splitmix64 finaliser)."""
    z = x + _U(0x9E3779B97F4A7C15 * (2 * salt + 1) % 2**64)
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


def _throw(owner: np.ndarray, elements: np.ndarray, weights: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All darts below weight and rank: (owner, dart, rank)."""
    owners, darts, ranks = [], [], []
    layer = 0
    at = np.arange(len(elements))
    while len(at):
        height, floor = 2.0**layer, 2.0**layer - 1
        seed = mix(elements[at], 2 * layer)
        where, far, rank, turn = at, reach[owner[at]], np.zeros(len(at)), 0
        while len(where):
            dart = mix(seed, 1000 + turn)
            rank = rank - np.log(((dart >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / height
            live = rank < far
            where, seed, far, rank, dart = where[live], seed[live], far[live], rank[live], dart[live]
            if layer:
                height_of = floor + height * ((mix(dart, 3) >> _U(11)).astype(np.float64) * 2.0**-53)
                under = height_of < weights[where]
            else:
                under = (weights[where] >= 1) | ((mix(dart, 3) >> _U(11)).astype(np.float64) * 2.0**-53 < weights[where])
            owners.append(owner[where[under]]), darts.append(dart[under]), ranks.append(rank[under])
            turn += 1
        layer += 1
        at = at[weights[at] > 2.0**layer - 1]
    return np.concatenate(owners), np.concatenate(darts), np.concatenate(ranks)


def signatures(sizes: np.ndarray, elements: np.ndarray, weights: np.ndarray | None = None, k: int = COORDINATES) -> np.ndarray:
    """One row of k 64-bit darts for each set. sizes: elements of each set (1 at least); elements: all sets' distinct 64-bit hashes, one set after another."""
    n = len(sizes)
    weights = np.ones(len(elements)) if weights is None else weights
    owner = np.repeat(np.arange(n), sizes)
    total = np.bincount(owner, weights, minlength=n)
    reach = (k * math.log(k) + 2 * k) / total
    out = np.zeros((n, k), np.uint64)
    todo = np.arange(n)
    while len(todo):
        chosen = np.isin(owner, todo, assume_unique=False) if len(todo) < n else np.ones(len(owner), bool)
        of, dart, rank = _throw(owner[chosen], elements[chosen], weights[chosen], reach)
        place = of * k + (mix(dart, 5) % _U(k)).astype(np.int64)
        first = np.full(n * k, np.inf)
        np.minimum.at(first, place, rank)
        best = rank == first[place]
        out.ravel()[place[best]] = dart[best]
        full = np.isfinite(first.reshape(n, k)[todo]).all(axis=1)
        todo = todo[~full]
        reach = reach * 2
    return out


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of SHINGLE words, given word hashes; of all words if they are fewer."""
    if not len(words):
        return words
    width = min(SHINGLE, len(words))
    h = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        h = (h ^ words[i : len(words) - width + 1 + i]) * _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(29)
    return np.unique(mix(h, width))


_word_hashes = Generations(lambda w: int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"), 100_000)


def shingles_of(text: str) -> np.ndarray:
    words = _WORD.findall(text.lower())
    return shingle_hashes(np.fromiter(map(_word_hashes.__getitem__, words), np.uint64, len(words)))


def _slices(batches, rows: int):
    """Batches in parts of a few rows, so that only those become Python values at once."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def _digest(text: str) -> bytes:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()


def _key(shingles: np.ndarray, text: str) -> bytes:
    """Of a shingle set; of the text where that has no word."""
    return hashlib.blake2b(shingles.tobytes() if len(shingles) else text.encode("utf-8", "surrogatepass"), digest_size=16, person=b"set" if len(shingles) else b"bare").digest()


def _sketch(batches):
    """(id, text) to (id, digest of the text, key of the shingle set, band hashes, a byte of each coordinate)."""
    for part in _slices(batches, SKETCHED):
        ids, texts = part.column(0), [t or "" for t in part.column(1).to_pylist()]
        at = 0
        while at < len(texts):
            first, sets, total = at, [], 0
            while at < len(texts) and total < 50_000:
                sets.append(shingles_of(texts[at]))
                total += len(sets[-1])
                at += 1
            keys = [_key(s, t) for s, t in zip(sets, texts[first:at], strict=True)]
            filled = [i for i, s in enumerate(sets) if len(s)]
            bands: list = [None] * len(sets)
            marks: list = [None] * len(sets)
            if filled:
                darts = signatures(np.array([len(sets[i]) for i in filled]), np.concatenate([sets[i] for i in filled]))
                hashes = np.zeros((len(filled), BANDS), np.uint64)
                for r in range(ROWS):
                    hashes = mix(hashes ^ darts[:, r::ROWS], r)
                small = mix(darts, 7).astype(np.uint8)
                for row, i in enumerate(filled):
                    bands[i], marks[i] = hashes[row].astype(np.int64), small[row].tobytes()
            columns = [pa.array([_digest(t) for t in texts[first:at]], pa.binary()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.binary())]
            yield pa.RecordBatch.from_arrays([ids.slice(first, at - first), *columns], ["id", "digest", "key", "bands", "marks"])
    give_back()


def _shingle_rows(batches):
    for part in _slices(batches, SKETCHED):
        texts = [t or "" for t in part.column(0).to_pylist()]
        sets = [shingles_of(t) for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array([_key(s, t) for s, t in zip(sets, texts, strict=True)], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "shingles"])


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 0.0


def _verify(batches):
    for batch in _slices(batches, 200):
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            keep.append(jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= THRESHOLD)
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(mask)


def joining_links(reps: list[int], labels: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Of members with component labels, links of THRESHOLD or more that join components, none between what is joined already.

    Pairs within a component need no look, so the members of the most frequent one are only looked at from outside.
    """
    parent = {x: x for x in labels}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    values, counts = np.unique(labels, return_counts=True)
    largest = values[counts.argmax()]
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum(np.bincount(codes))]).tolist()
    holders = owner[np.argsort(codes, kind="stable")]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    links = []
    for i in range(len(sets)):
        if labels[i] == largest:
            continue
        shared = np.bincount(np.concatenate([holders[starts[c] : starts[c + 1]] for c in codes[ends[i] : ends[i + 1]].tolist()]), minlength=len(sets))
        for j in np.flatnonzero(shared >= THRESHOLD * (sizes[i] + sizes - shared)).tolist():
            a, b = root(labels[i]), root(labels[j])
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((min(reps[i], reps[j]), max(reps[i], reps[j])))
    return links


def _cells(batches, result, names: list[str], kinds: list):
    """Rows sorted by cell (hub, i, j), then the columns that result takes as lists, to the rows that it gives of each cell."""
    held: list = []
    cell = None

    def made():
        found = result(cell, list(zip(*held, strict=True))) if len(held) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)], names)

    for batch in _slices(batches, 200):
        for hub, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (hub, i, j) != cell:
                if held and (out := made()).num_rows:
                    yield out
                held.clear()
                cell = (hub, i, j)
            held.append(row)
    if held and (out := made()).num_rows:
        yield out


def may_link(sides: list[int], labels: list[int], marks: list[bytes]) -> np.ndarray:
    """Which members agree in MAYBE coordinates or more with a member of another component; of two sides, only across."""
    every, label, side = np.frombuffer(b"".join(marks), np.uint8).reshape(len(marks), -1), np.array(labels), np.array(sides)
    found = np.zeros(len(marks), bool)
    across = len(set(sides)) > 1
    for a in range(len(marks)):
        if across and sides[a] != side.min():
            continue
        other = np.flatnonzero((label != label[a]) & ((side != side[a]) if across else True))
        near = other[(every[other] == every[a]).sum(axis=1) >= MAYBE]
        found[near] = True
        found[a] |= len(near) > 0
    return found


def _sift(batches):
    def of(cell, columns):
        sides, members, labels, marks = columns
        return [(cell[0], members[x]) for x in np.flatnonzero(may_link(list(sides), list(labels), list(marks))).tolist()]

    yield from _cells(batches, of, ["hub", "sid"], [pa.int64(), pa.int64()])


def _compare(batches):
    def of(_, columns):
        return joining_links(list(columns[0]), list(columns[1]), [np.frombuffer(x, np.uint64) for x in columns[2]])

    yield from _cells(batches, of, ["a", "b"], [pa.int64(), pa.int64()])


def _links(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough."""
    left = shingles.select(F.col("sid").alias("a"), F.col("shingles").alias("x"))
    right = shingles.select(F.col("sid").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long")


def _dealt(members: DataFrame, blocks: Column) -> DataFrame:
    """Each member with every cell (hub, i, j) that its block is part of; a cell's rows stand together."""
    dealt = members.withColumn("blocks", blocks.cast("int")).withColumn("side", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return cells.withColumns({"i": F.least("side", "other"), "j": F.greatest("side", "other")}).repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")


def _sets(sketched: DataFrame) -> DataFrame:
    """One row per shingle set: its number sid, key, bands, marks, the first of its rows by (id, digest), and own_id, the smallest id that belongs to it."""
    owned = sketched.filter("id IS NOT NULL").groupBy("id").agg(F.min("key").alias("key")).groupBy("key").agg(F.min("id").alias("own_id"))
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "digest"))).alias("first")
    sets = sketched.groupBy("key").agg(first, F.first("bands").alias("bands"), F.first("marks").alias("marks"))
    return sets.join(owned, "key", "left").withColumn("sid", F.monotonically_increasing_id())


def _joined(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, label): the components of two sets or more."""
    named = sets.filter("bands IS NOT NULL AND first IS NOT NULL")
    members = named.select("sid", F.posexplode("bands").alias("band", "hash"))
    shared = members.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    placed = materialise(members.join(shared, ["band", "hash"]), "members")
    standing = materialise(placed.groupBy("sid").agg(F.sum("n").alias("places")), "standing")
    top = placed.join(standing, "sid").groupBy("band", "hash").agg(F.max(F.struct("places", (-F.col("sid")).alias("minus"))).alias("top"))
    hubs = materialise(top.select("band", "hash", (-F.col("top.minus")).alias("hub")), "hubs")
    tried = materialise(placed.join(hubs, ["band", "hash"]).filter("sid <> hub").select("hub", "sid").distinct(), "tried")
    release(placed, hubs)
    #: Texts are shuffled at any size: a plan that sends the list of members to every task holds for small tables only.
    wanted = materialise(named.join(standing, "sid", "left_semi").select("sid", "key", F.col("first.id").alias("id")), "wanted")
    texts = rows.join(wanted.select("id").hint("merge"), "id", "left_semi").select("text")
    made = texts.mapInArrow(_shingle_rows, "key binary, shingles binary")
    shingles = materialise(made.join(wanted.select("sid", "key"), "key").dropDuplicates(["sid"]).select("sid", "shingles"), "shingles")
    release(wanted, standing)
    links = materialise(_links(tried.select(F.col("hub").alias("a"), F.col("sid").alias("b")), shingles), "links")
    labels = connected_components(links)
    open_ = tried.union(tried.select("hub", F.col("hub").alias("sid")).distinct()).join(labels.withColumnRenamed("node", "sid"), "sid", "left")
    open_ = materialise(open_.select("hub", "sid", F.coalesce("label", "sid").alias("label")), "open")
    several = materialise(open_.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("hub", "n"), "several")
    apart = open_.join(several, "hub").join(sets.select("sid", "marks"), "sid")
    sifted = _dealt(apart, F.ceil(F.col("n") / BLOCK)).select("hub", "i", "j", "side", "sid", "label", "marks").mapInArrow(_sift, "hub long, sid long")
    sifted = materialise(sifted.distinct(), "sifted")
    left = materialise(sifted.join(open_, ["hub", "sid"]).join(shingles, "sid"), "left")
    sized = materialise(left.groupBy("hub").agg(F.sum(F.octet_length("shingles")).alias("bytes")), "sized")
    more = _dealt(left.join(sized, "hub"), F.ceil((F.col("bytes") + 1) / CELL_BYTES)).select("hub", "i", "j", "sid", "label", "shingles")
    more = materialise(more.mapInArrow(_compare, "a long, b long"), "links")
    release(tried, shingles, open_, several, sifted, left, sized)
    if more.limit(1).count():
        labels = connected_components(links.union(more))
    release(links, more)
    return labels


def _classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per input row: id, digest, class_id, set_id, and stays (the row, or one of those equal to it, is kept of its class)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketched = materialise(rows.mapInArrow(_sketch, "id long, digest binary, key binary, bands array<long>, marks binary"), "sketches")
    sets = materialise(_sets(sketched), "sets")
    labelled = sets.select("sid", "key", "own_id", "first").join(_joined(rows, sets).withColumnRenamed("node", "sid"), "sid")
    labelled = materialise(labelled, "labelled")
    heads = materialise(labelled.groupBy("label").agg(F.min("own_id").alias("own_id"), F.min("key").alias("least"), F.min("first").alias("stays")), "heads")
    #: The result is planned later, under the session's own limit; nothing here is small enough to be sent whole.
    of_many = labelled.select("sid", "label").join(heads.hint("merge"), "label").select("sid", F.col("own_id").alias("class_own"), "least", "stays")
    of_sets = sets.select("sid", "key", "own_id", "first").join(of_many.hint("merge"), "sid", "left")
    unowned = F.xxhash64(F.coalesce("least", "key")).bitwiseOR(F.lit(-(2**63)).cast("long"))
    #: least is null for a set that is its class alone.
    class_id = F.coalesce(F.when(F.col("least").isNotNull(), F.col("class_own")).otherwise(F.col("own_id")), unowned)
    named = of_sets.select("key", class_id.alias("class_id"), F.col("first.id").alias("set_id"), F.coalesce("stays", "first").alias("stays"))
    found = sketched.select("id", "digest", "key").join(named.hint("merge"), "key")
    return found.select("id", "digest", "class_id", "set_id", F.struct("id", "digest").eqNullSafe(F.col("stays")).alias("stays"))


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, class_id, set_id (smallest id with the same shingle set), kept (the one row that stays of its class, or its equals)."""
    return _classes(docs, id_col, text_col).select(F.col("id").alias(id_col), "class_id", "set_id", F.col("stays").alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, that with the smallest (id, MD5 of the text), with the columns of docs; equal rows once. Rows with a null id stay."""
    named = docs.filter(F.col(id_col).isNotNull())
    stays = _classes(named, id_col, text_col).filter("stays").select(F.struct("id", "digest").alias("k")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    digest = F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    rows = named.select(row, F.struct(F.col(id_col).cast("long").alias("id"), digest.alias("digest")).alias("k"))
    return rows.join(stays.hint("merge"), "k", "left_semi").dropDuplicates(["k"]).select("row.*").union(docs.filter(F.col(id_col).isNull()))
