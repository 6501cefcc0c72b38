"""Token-ID output: a content-addressed store of chunked id streams.

Each document's ids (its end id included) are cut into chunks where a rolling hash over the last WINDOW ids has
its top MASK_BITS bits zero, at least MIN_IDS and at most MAX_IDS ids apart, so equal passages give equal chunks
wherever they stand. A chunk's address is the 128-bit BLAKE2b hash of its bytes; the Merkle root of a document is
the hash over its chunk addresses, pairwise up to one.

On disk, one store folder holds four Parquet tables:
  objects/kind=chunk    address, payload: ids as unsigned 16-bit (wide = false) or 32-bit little-endian integers
  objects/kind=recipe   what each task found, before it gets its place
  index                 in ascending id order: the id, segment, local_start, n_tokens, addresses, root
  manifest              one row per segment: its documents, their ids, and a checksum over all that the index says of them
`start` of a document is local_start plus the tokens of all earlier segments; segments follow the id order.

Encoding happens once: every task gives its documents' recipes and, once per task, each chunk; one shuffle deals
both out (a chunk by its address, a recipe by an own key), keeps one row per chunk and writes. A passage in a
third of all documents thus reaches a reducer once per map task; payloads that come under one address must agree in
length and in a second hash, or the write fails. Reading verifies the index against the manifest, every chunk against
its address and every document against its root, and fails where an index row or a chunk that a recipe names is gone; only addresses, lengths and checksums are shuffled there, and the checksum
of a document is combined from those of its chunks.

Defined results: a null text is empty and has the end id alone; rows that repeat an id are documents of their own,
in an order fixed by their contents; an empty table gives an empty store and result; very long texts are any
number of chunks; columns other than the id and the text play no part.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .staging import fresh_path
from .units import unit_encoder

WINDOW, MASK_BITS, MIN_IDS, MAX_IDS = 16, 9, 128, 2048
_FACTOR = 0x9E3779B97F4A7C15


def _mixed(ids: np.ndarray) -> np.ndarray:
    """A 64-bit value for each id (the splitmix64 finaliser)."""
    z = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(_FACTOR)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


@lru_cache(1)
def _mixed_small() -> np.ndarray:
    return _mixed(np.arange(1 << 17))


def rolling_hash(ids: np.ndarray) -> np.ndarray:
    """At each place the sum of mixed(id) * FACTOR**age over the last WINDOW ids, modulo 2**64, by doubling the window."""
    h, span = (_mixed_small()[ids] if not ids.size or ids.max() < 1 << 17 else _mixed(ids)), 1
    while span < WINDOW:
        older = h[:-span] * np.uint64(pow(_FACTOR, span, 2**64))
        h[span:] += older
        span *= 2
    return h


def cut_chunks(ids: np.ndarray, hashes: np.ndarray | None = None) -> list[int]:
    """The ends of the chunks of ids."""
    hashes = rolling_hash(ids) if hashes is None else hashes
    ends, start = [], 0
    for at in (np.flatnonzero(hashes >> np.uint64(64 - MASK_BITS) == 0) + 1).tolist():
        while at - start > MAX_IDS:
            start += MAX_IDS
            ends.append(start)
        if at - start >= MIN_IDS:
            ends.append(at)
            start = at
    while len(ids) - start > MAX_IDS:
        start += MAX_IDS
        ends.append(start)
    if start < len(ids):
        ends.append(len(ids))
    return ends


def address(ids: np.ndarray) -> bytes:
    return hashlib.blake2b(ids.astype("<u4").tobytes(), digest_size=16).digest()


def merkle_root(addresses: list[bytes]) -> bytes:
    level = list(addresses)
    while len(level) > 1:
        level = [hashlib.blake2b(b"".join(level[i : i + 2]), digest_size=16).digest() for i in range(0, len(level), 2)]
    return level[0] if level else b"\0" * 16


def pack(ids: np.ndarray) -> tuple[bool, bytes]:
    """(wide, payload)."""
    wide = bool(ids.size and ids.max() > 0xFFFF)
    return wide, ids.astype("<u4" if wide else "<u2").tobytes()


def unpack(wide: bool, payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, "<u4" if wide else "<u2").astype("<u4")


def _objects_schema(kind: str) -> str:
    return f"kind string, route binary, id {kind}, n_tokens long, addresses array<binary>, root binary, wide boolean, payload binary"


_NAMES = ["kind", "route", "id", "n_tokens", "addresses", "root", "wide", "payload"]


def _encoder(tokenizer_file: str, pattern: str, end_id: int, id_type: pa.DataType):
    #: Addresses that a task has given already; beyond this many it may give a chunk again, which the shuffle drops.
    held = 500_000

    def run(batches):
        from pyspark import TaskContext

        encoder, end, seen, row = unit_encoder(tokenizer_file, pattern), np.array([end_id], "<u4"), set(), 0
        task = TaskContext.get().partitionId()
        for batch in batches:
            keys, size, at = batch.column(0), batch.num_rows, 0
            encoded = encoder.encode_many(batch.column(1))
            while at < size:
                parts, total, first = [], 0, at
                while at < size and total < 1_000_000:
                    parts += [next(encoded), end]
                    total += len(parts[-2])
                    at += 1
                kind, route, ids_of, n_tokens, lists, roots, wides, payloads = ([] for _ in range(8))
                stream = np.concatenate(parts)
                hashes, start, blob = rolling_hash(stream), 0, stream.data
                #: Where all ids at hand fit into 16 bits, they are narrowed at once.
                narrow = stream.astype("<u2") if stream.max() <= 0xFFFF else None
                for i, n in enumerate(len(p) + 1 for p in parts[::2]):
                    own = []
                    ids, last = stream[start : start + n], 0
                    for e in cut_chunks(ids, hashes[start : start + n]):
                        a = hashlib.blake2b(blob[start + last : start + e], digest_size=16).digest()
                        own.append(a)
                        if a not in seen:
                            if len(seen) >= held:
                                seen.clear()
                            seen.add(a)
                            wide, payload = pack(ids[last:e]) if narrow is None else (False, narrow[start + last : start + e].tobytes())
                            kind.append("chunk"), route.append(a), ids_of.append(None), n_tokens.append(e - last), lists.append(None), roots.append(None), wides.append(wide), payloads.append(payload)
                        last = e
                    kind.append("recipe"), route.append(b"%d.%d" % (task, row)), ids_of.append(first + i), n_tokens.append(n), lists.append(own), roots.append(merkle_root(own)), wides.append(None), payloads.append(None)
                    start, row = start + n, row + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kind, pa.string()), pa.array(route, pa.binary()), keys.take(pa.array(ids_of, pa.int64())).cast(id_type), pa.array(n_tokens, pa.int64()), pa.array(lists, pa.list_(pa.binary())), pa.array(roots, pa.binary()), pa.array(wides, pa.bool_()), pa.array(payloads, pa.binary())], _NAMES
                )

    return run


def _running(id_type: pa.DataType):
    def run(batches):
        from pyspark import TaskContext

        segment, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(1).to_numpy(zero_copy_only=False)
            ends = total + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(id_type), pa.array(np.full(len(n), segment), pa.int32()), pa.array(ends - n, pa.int64()), *batch.columns[1:]], ["id", "segment", "local_start", "n_tokens", "addresses", "root"])
            total = int(ends[-1]) if len(ends) else total

    return run


def write_store(docs: DataFrame, path: str, tokenizer_file: str, pattern: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode every text, append end_id and write the store; gives its path. Payloads are shuffled once."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark, id_type = docs.sparkSession, docs.schema[id_col].dataType
    kind, arrow = id_type.simpleString(), to_arrow_type(id_type)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    made = rows.mapInArrow(_encoder(tokenizer_file, pattern, end_id, arrow), _objects_schema(kind))
    mark = F.xxhash64("n_tokens", "wide", "payload")
    #: Tasks give a chunk once each, so nothing is combined before the shuffle.
    once = made.repartition("kind", "route").groupBy("kind", "route").agg(*[F.first(c).alias(c) for c in _NAMES[2:]], F.min(mark).alias("low"), F.max(mark).alias("high"))
    clash = F.when(F.col("low") != F.col("high"), F.raise_error(F.lit("two payloads have one address")).cast("long")).otherwise(F.col("n_tokens"))
    once = once.withColumn("n_tokens", clash).drop("low", "high")
    once.write.partitionBy("kind").option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").parquet(f"{path}/objects")
    recipes = _objects(spark, path, kind).filter("kind = 'recipe'").select("id", "n_tokens", "addresses", "root", "route")
    ordered = recipes.repartitionByRange("id").sortWithinPartitions("id", "root", "route").drop("route")
    ordered.mapInArrow(_running(arrow), f"id {kind}, segment int, local_start long, n_tokens long, addresses array<binary>, root binary").write.option("compression", "zstd").parquet(f"{path}/index")
    _manifest(_index_rows(spark, path, kind)).coalesce(1).write.parquet(f"{path}/manifest")
    return path


def _index_rows(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(f"id {kind}, segment int, local_start long, n_tokens long, addresses array<binary>, root binary").parquet(f"{path}/index")


def _manifest(index: DataFrame) -> DataFrame:
    """One row per segment. The checksum doesn't depend on the order of rows, which local_start states."""
    return index.groupBy("segment").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("ids"), F.bit_xor(F.xxhash64("id", "local_start", "n_tokens", "addresses", "root")).alias("mark"))


def verify_index(spark: SparkSession, path: str, id_type: str = "bigint") -> None:
    """Fail unless the index has exactly the segments and rows that the manifest names."""
    stated = spark.read.schema("segment int, documents long, ids long, mark long").parquet(f"{path}/manifest")
    found = _manifest(_index_rows(spark, path, id_type))
    wrong = stated.withColumn("side", F.lit(1)).unionByName(found.withColumn("side", F.lit(-1))).groupBy("segment", "documents", "ids", "mark").agg(F.sum("side").alias("n")).filter("n <> 0")
    if wrong.limit(1).count():
        raise ValueError("the index does not match its manifest")


def _objects(spark: SparkSession, path: str, kind: str) -> DataFrame:
    names = [x for x in _objects_schema(kind).split(", ") if not x.startswith("kind ")]
    return spark.read.schema(", ".join([*names, "kind string"])).parquet(f"{path}/objects")


def _index(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The index with `start`, the ids of all documents before. One row per segment is summed in order."""
    index = _index_rows(spark, path, kind)
    before = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    sums = index.groupBy("segment").agg(F.sum("n_tokens").alias("n")).select("segment", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return index.join(F.broadcast(sums), "segment").withColumn("start", F.col("base") + F.col("local_start"))


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The products of polynomials modulo that of CRC-32, reflected, as 64-bit integers."""
    product = np.zeros(np.broadcast(a, b).shape, np.int64)
    for i in range(31, -1, -1):
        product ^= np.where(a >> i & 1, b, 0)
        b = b >> 1 ^ np.where(b & 1, 0xEDB88320, 0)
    return product


@lru_cache(1)
def _powers() -> np.ndarray:
    """x**(32 * n) modulo the CRC-32 polynomial for n ids, 0 to MAX_IDS."""
    step = np.array(0x00800000)  # x**8, reflected
    step = _times(step, step)
    step = _times(step, step)
    powers = np.full(1, 0x80000000)
    while len(powers) <= MAX_IDS:
        powers = np.concatenate([powers, _times(powers, step)])
        step = _times(step, step)
    return powers


def crc32_of_parts(row: np.ndarray, place: np.ndarray, crc: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows the CRC-32 of its parts one after another; a part is given by its row, place (from 0), CRC-32 and number of 32-bit values, MAX_IDS at most. Parts come in order of place."""
    out = np.zeros(n, np.int64)
    ends = np.searchsorted(place, np.arange(int(place.max(initial=-1)) + 2))
    for low, high in zip(ends, ends[1:], strict=False):
        own = row[low:high]
        out[own] = _times(_powers()[size[low:high]], out[own]) ^ crc[low:high]
    return out


def _verify_chunks(batches):
    for batch in batches:
        route, wide, payload = (batch.column(i).to_pylist() for i in range(3))
        n, crc = [], []
        for a, w, p in zip(route, wide, payload, strict=True):
            ids = unpack(w, p).tobytes()
            if hashlib.blake2b(ids, digest_size=16).digest() != a:
                raise ValueError(f"chunk {a.hex()} does not match its address")
            n.append(len(ids) // 4)
            crc.append(zlib.crc32(ids))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(crc, pa.int64())], ["address", "n", "crc"])


def _verify_documents(batches):
    """(start, n_tokens, root, parts) to (start, n_tokens, ids_crc32)."""
    for batch in batches:
        lists, n = batch.column(3), batch.num_rows
        if lists.values.field(1).null_count:
            raise ValueError("a chunk that a recipe names is not in the store")
        ends = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.slice(int(ends[0]), int(ends[-1] - ends[0]))
        row = np.repeat(np.arange(n), np.diff(ends))
        place, size, crc = (values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
        order = np.lexsort((place, row))
        first = (ends - ends[0])[:-1]
        addresses, roots = values.field(3).take(pa.array(order)).to_pylist(), batch.column(2).to_pylist()
        whole = np.array_equal(place[order], np.arange(len(row)) - first[row]) and np.array_equal(np.bincount(row, size, minlength=n).astype(np.int64), batch.column(1).to_numpy(zero_copy_only=False))
        if not whole or any(merkle_root(addresses[a:b]) != root for a, b, root in zip(first.tolist(), (ends - ends[0])[1:].tolist(), roots, strict=True)):
            raise ValueError("a document's chunks do not match its recipe and root")
        by_place = np.argsort(place, kind="stable")
        crcs = crc32_of_parts(row[by_place], place[by_place], crc[by_place], size[by_place], n)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(crcs, pa.int64())], ["start", "n_tokens", "ids_crc32"])


def read_digests(spark: SparkSession, path: str, id_type: str = "bigint", id_col: str = "doc_id") -> DataFrame:
    """Read the store back, verified: id_col, start, n_tokens, ids_crc32. `start` tells documents apart, since each has an id at least."""
    verify_index(spark, path, id_type)
    chunks = _objects(spark, path, id_type).filter("kind = 'chunk'").select("route", "wide", "payload").mapInArrow(_verify_chunks, "address binary, n int, crc long")
    index = _index(spark, path, id_type)
    links = index.select("id", "start", "n_tokens", "root", F.posexplode("addresses").alias("i", "address"))
    found = links.join(chunks, "address", "left")
    parts = found.groupBy("start").agg(F.first("id").alias("id"), F.first("n_tokens").alias("n_tokens"), F.first("root").alias("root"), F.collect_list(F.struct("i", "n", "crc", "address")).alias("parts"))
    checked = parts.select("id", "start", "n_tokens", "root", "parts").mapInArrow(_with_id(_verify_documents), f"id {id_type}, start long, n_tokens long, ids_crc32 long")
    return checked.withColumnRenamed("id", id_col)


def _with_id(inner):
    """The id column passes by what inner makes of the others."""

    def run(batches):
        for batch in batches:
            for out in inner([pa.RecordBatch.from_arrays(batch.columns[1:], batch.schema.names[1:])]):
                yield pa.RecordBatch.from_arrays([batch.column(0), *out.columns], ["id", *out.schema.names])

    return run


def read_documents(spark: SparkSession, path: str, id_type: str = "bigint", id_col: str = "doc_id") -> DataFrame:
    """The stored documents whole: id_col, start, ids array<long> in order, rebuilt from their chunks."""

    def ids(batches):
        for batch in batches:
            parts = [sorted(p, key=lambda x: x["i"]) for p in batch.column(2).to_pylist()]
            if any(x["payload"] is None for p in parts for x in p):
                raise ValueError("a chunk that a recipe names is not in the store")
            lists = [np.concatenate([unpack(x["wide"], x["payload"]) for x in p]) for p in parts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.int64()))], ["id", "start", "ids"])

    verify_index(spark, path, id_type)
    chunks = _objects(spark, path, id_type).filter("kind = 'chunk'").select(F.col("route").alias("address"), "wide", "payload")
    links = _index(spark, path, id_type).select("id", "start", F.posexplode("addresses").alias("i", "address"))
    parts = links.join(chunks, "address", "left").groupBy("start").agg(F.first("id").alias("id"), F.collect_list(F.struct("i", "wide", "payload")).alias("parts"))
    return parts.select("id", "start", "parts").mapInArrow(ids, f"id {id_type}, start long, ids array<long>").withColumnRenamed("id", id_col)


def store_and_verify(docs: DataFrame, tokenizer_file: str, pattern: str, end_id: int = 2, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """write_store, then read_digests from what it wrote."""
    spark = docs.sparkSession
    path = write_store(docs, path or fresh_path(spark, "id-store"), tokenizer_file, pattern, end_id, id_col, text_col)
    return read_digests(spark, path, docs.schema[id_col].dataType.simpleString(), id_col)
