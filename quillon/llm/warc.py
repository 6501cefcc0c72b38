"""WARC archives: a deterministic sharded writer, and a reader that checks what it reads.

Writing. Digests of all payloads are taken in the JVM and stored (keys, no payloads); over them, groups of equal payloads are
found by their SHA-256, counted map-side first. Records are range-sorted by (id, SHA-256): range bounds are exact quantiles of
a sample by hash, so they depend on the data alone, and a range holds about RANGE_BYTES bytes, at least MIN_RANGES ranges. Payloads are
shuffled once, to their range; with them come the few rows that say which records repeat a payload, so nothing is joined to
payloads. A task regenerates all headers and digests, compresses every record as a gzip member of its own, and rolls to a new
file when one has taken roll_bytes. Neither names nor bytes of the archives depend on the run.

Commit. A task writes under names of its own, and gives a manifest row per file (name, bytes, records, CRC, range). Spark's own
commit of that table picks one attempt of each task. A second job moves those files to their names; a move that was made before
counts as made, so it may be repeated. Then the manifest is written, whose _SUCCESS says that the set is complete, and what lost attempts
left is deleted. Files that the manifest does not name do not exist for the reader.

Reading. A file's CRC and number of records must be the manifest's, a record's length and block digest must be those of its header,
a payload's digest too. A revisit has no payload: its HTTP header states the length, and it is resolved to the response
that it refers to, which must exist and have the same digest; that join has plain shuffles on both sides. Anything else fails.

Defined results: a null payload is empty. Payloads of least_bytes or more that are equal (same SHA-256) are one group: its
response is the record with the largest id; of several rows with that id, the first by URL, null first, of equal rows one. Null
ids come first in order and are the response of a group only if it has no other. Smaller payloads are responses, all of them.
Rows that repeat are records of their own; rows with one id and one payload stand in one range. URLs are percent-encoded where a
header could not hold them. An empty table gives archives of no file and an empty result. Other columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import fresh_path, give_back, materialise, small_batches

RANGE_BYTES, MIN_RANGES, ROLL_BYTES = 1 << 30, 64, 64 << 20
#: Sampled keys for each range; the driver sorts them, 1.6 million at 100 TB.
SAMPLED = 16
#: Fixed values of the format.
VERSION, PROFILE, DATE = b"WARC/1.1", b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"1970-01-01T00:00:00Z"
_NS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_READ = 1 << 18


def _store(root: str) -> tuple[fs.FileSystem, str]:
    """The file system and folder of a URI; any that pyarrow opens."""
    return fs.FileSystem.from_uri(root.replace("s3a://", "s3://", 1))


def _qualified(spark: SparkSession, root: str) -> str:
    """root with the scheme that Spark takes it to have."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + found[5:] if found.startswith("file:/") and not found.startswith("file://") else found


def record_id(page_id: int | None, sha: bytes, copy: int) -> bytes:
    """The same for the same record in every run."""
    return b"<urn:uuid:%s>" % str(uuid.uuid5(_NS, f"{page_id}/{sha.hex()}/{copy}")).encode()


def _sha1(data: bytes) -> bytes:
    return b"sha1:" + base64.b32encode(hashlib.sha1(data).digest())


def _uri(url: str | None, page_id: int | None) -> bytes:
    return b"".join(b"%%%02X" % b if b <= 32 or b == 127 else bytes([b]) for b in (url or f"urn:page:{page_id}").encode())


def _member(kind: bytes, own_id: bytes, fields: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    """One record as a gzip member; its bytes depend on what it holds alone."""
    head = [(b"WARC-Type", kind), (b"WARC-Record-ID", own_id), (b"WARC-Date", DATE), *fields, (b"WARC-Block-Digest", _sha1(block)), (b"Content-Length", b"%d" % len(block))]
    packer = zlib.compressobj(5, zlib.DEFLATED, 31)
    return packer.compress(b"%s\r\n%s\r\n" % (VERSION, b"".join(b"%s: %s\r\n" % x for x in head))) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def page_member(page_id: int | None, url: str | None, payload: bytes, sha: bytes, copy: int, refers_to: bytes | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [(b"WARC-Target-URI", _uri(url, page_id)), (b"WARC-Payload-Digest", _sha1(payload)), (b"Content-Type", b"application/http; msgtype=response")]
    if page_id is not None:
        fields.append((b"X-Page-ID", b"%d" % page_id))
    if refers_to is None:
        return _member(b"response", record_id(page_id, sha, copy), fields, http + payload)
    return _member(b"revisit", record_id(page_id, sha, copy), [*fields, (b"WARC-Profile", PROFILE), (b"WARC-Refers-To", refers_to)], http)


class _Files:
    """The files of one range, rolled by compressed size, under names of this attempt."""

    def __init__(self, root: str, roll_bytes: int):
        self.store, self.root = _store(root)
        self.roll, self.out, self.done = roll_bytes, None, []

    def add(self, at: int, member: bytes) -> None:
        if self.out is not None and (at != self.at or self.size >= self.roll):
            self.close()
        if self.out is None:
            no = self.done[-1][2] + 1 if self.done and self.done[-1][1] == at else 0
            self.at, self.no, self.size, self.records, self.crc = at, no, 0, 0, 0
            self.name = f"pages-{at:06d}-{no:05d}.warc.gz"
            self.beside = f"_temporary/{self.name}.{uuid.uuid4().hex}"
            self.out = self.store.open_output_stream(f"{self.root}/{self.beside}", compression=None)
            said = b"software: quillon\r\nformat: WARC File Format 1.1\r\n"
            self._put(_member(b"warcinfo", b"<urn:uuid:%s>" % str(uuid.uuid5(_NS, self.name)).encode(), [(b"WARC-Filename", self.name.encode()), (b"Content-Type", b"application/warc-fields")], said))
        self._put(member)

    def _put(self, member: bytes) -> None:
        self.out.write(member)
        self.size, self.records, self.crc = self.size + len(member), self.records + 1, zlib.crc32(member, self.crc)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, self.at, self.no, self.size, self.records, self.crc, self.beside))
            self.out = None


_MANIFEST = "name string, range int, no int, bytes long, records long, crc32 long, beside string"


def _manifest_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    columns = list(zip(*rows, strict=True)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["name", "range", "no", "bytes", "records", "crc32", "beside"])


def _write(root: str, roll_bytes: int):
    """Rows (range, id, sha, kind, url, payload, keep) in order, what is told of a payload (kind 0) before its records, to manifest rows."""

    def run(batches):
        files, at, told, copy = _Files(root, roll_bytes), None, None, 0
        for batch in batches:
            ranges, ids, shas, kinds, urls, payloads, keeps = (batch.column(i) for i in range(7))
            for i in range(batch.num_rows):
                own = (ids[i].as_py(), shas[i].as_py())
                if own != at:
                    at, told, copy = own, None, 0
                if kinds[i].as_py() == 0:
                    told = (keeps[i].as_py(),)
                    continue
                #: The first record of the largest id is the response, and the others point there.
                refers_to = None if told is None or (told[0] == own[0] and copy == 0) else record_id(told[0], own[1], 0)
                files.add(ranges[i].as_py(), page_member(own[0], urls[i].as_py(), payloads[i].as_py(), own[1], copy, refers_to))
                copy += 1
        files.close()
        yield _manifest_batch(files.done)
        give_back()

    return run


def _commit(root: str):
    """Moves each file to its name; one that is there already was moved before."""

    def run(batches):
        store, folder = _store(root)
        for batch in batches:
            for name, beside in zip(batch.column("name").to_pylist(), batch.column("beside").to_pylist(), strict=True):
                if store.get_file_info(f"{folder}/{beside}").type == fs.FileType.File:
                    store.move(f"{folder}/{beside}", f"{folder}/{name}")
                elif store.get_file_info(f"{folder}/{name}").type != fs.FileType.File:
                    raise OSError(f"{name} was written but is not there")
            yield batch

    return run


def _range_bounds(keys: DataFrame, n_ranges: int, n_rows: int) -> np.ndarray:
    """At most n_ranges - 1 bounds, 16 bytes each: quantiles of about SAMPLED keys a range, taken by hash."""
    share = min(1.0, n_ranges * SAMPLED / max(1, n_rows))
    some = keys.filter(F.pmod(F.xxhash64("id", "sha", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    rows = some.select(F.coalesce("id", F.lit(-(1 << 63))).alias("id"), F.substring("sha", 1, 8).alias("sha")).toPandas()
    placed = np.sort(_key16(rows["id"], rows["sha"]))
    return np.unique(placed[[len(placed) * k // n_ranges for k in range(1, n_ranges)]]) if len(placed) else placed


def _key16(ids: pd.Series, shas: pd.Series) -> np.ndarray:
    """(id, first 8 bytes of the digest) as one key whose bytes order as the pair does. S32: hex, since NumPy drops zero bytes at the end."""
    unsigned = ids.to_numpy(np.int64).astype(np.uint64) ^ np.uint64(1 << 63)
    return np.array([b"%016x%s" % (i, bytes(s).hex().encode()) for i, s in zip(unsigned.tolist(), shas, strict=True)], "S32")


def write_warc(pages: DataFrame, root: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 1000, range_bytes: int = RANGE_BYTES, min_ranges: int = MIN_RANGES, roll_bytes: int = ROLL_BYTES) -> str:
    """Writes one record per row under root, a new folder that all executors can write to (by default in the shared one). Gives root."""
    spark = pages.sparkSession
    small_batches(spark)
    root = _qualified(spark, root or fresh_path(spark, "warc"))
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("sha", F.unhex(F.sha2("payload", 256)))
    keys = materialise(rows.select("id", "sha", F.octet_length("payload").cast("long").alias("n")), "warc-keys")
    n_rows, n_bytes = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    bounds = spark.sparkContext.broadcast(_range_bounds(keys, max(min_ranges, -(-n_bytes // range_bytes)), n_rows))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series, shas: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds.value, _key16(ids, shas), side="right").astype(np.int32))

    placed = range_of(F.coalesce("id", F.lit(-(1 << 63))), F.substring("sha", 1, 8))
    #: One row per payload that several records share.
    groups = materialise(keys.filter(F.col("n") >= least_bytes).groupBy("sha").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("shared")).filter("shared > 1"), "warc-groups")
    told = keys.select("id", "sha").join(groups, "sha").select("id", "sha", "keep").distinct()
    told = told.select(placed.alias("range"), "id", "sha", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "keep")
    records = rows.select(placed.alias("range"), "id", "sha", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("keep"))
    dealt = told.unionByName(records).repartitionById(len(bounds.value) + 1, "range").sortWithinPartitions("range", "id", "sha", "kind", "url")
    store, folder = _store(root)
    store.create_dir(f"{folder}/_temporary")
    written = materialise(dealt.mapInArrow(_write(root, roll_bytes), _MANIFEST), "warc-written")
    moved = written.mapInArrow(_commit(root), _MANIFEST).drop("beside")
    moved.write.parquet(f"{root}/manifest")
    store.delete_dir(f"{folder}/_temporary")
    return root


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """One row per archive file: name, range, no, bytes, records (with the warcinfo), crc32."""
    return spark.read.parquet(f"{root}/manifest")


def _members(stream, told: dict) -> Iterator[bytes]:
    """The gzip members of a file, one after another."""
    inflate, parts = zlib.decompressobj(31), []
    while data := stream.read(_READ):
        told["bytes"], told["crc32"] = told["bytes"] + len(data), zlib.crc32(data, told["crc32"])
        while data:
            parts.append(inflate.decompress(data))
            data = b""
            if inflate.eof:
                yield b"".join(parts)
                data, inflate, parts = inflate.unused_data, zlib.decompressobj(31), []
    if parts:
        raise ValueError("a record breaks off")


def parse_record(member: bytes) -> tuple[dict[bytes, bytes], bytes]:
    """(header fields, block) of a record; lengths and digests must be right."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    fields = dict(x.split(b": ", 1) for x in lines[1:])
    block = rest[: int(fields[b"Content-Length"])]
    if lines[0] != VERSION or rest[len(block) :] != b"\r\n\r\n" or fields[b"WARC-Block-Digest"] != _sha1(block):
        raise ValueError(f"record {fields.get(b'WARC-Record-ID')!r} is damaged")
    return fields, block


def _read(root: str, payloads: bool):
    """Manifest rows to (record_id, record_type, page_id, refers, url, payload_bytes, payload_digest[, payload])."""
    names = ["record_id", "record_type", "page_id", "refers", "url", "payload_bytes", "payload_digest", *(["payload"] if payloads else [])]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), *([pa.binary()] if payloads else [])]

    def one(fields: dict[bytes, bytes], block: bytes) -> tuple:
        http, _, payload = block.partition(b"\r\n\r\n")
        digest = base64.b32decode(fields[b"WARC-Payload-Digest"].removeprefix(b"sha1:"))
        stated = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
        response = fields[b"WARC-Type"] == b"response"
        if response and (stated != len(payload) or digest != hashlib.sha1(payload).digest()):
            raise ValueError(f"the payload of record {fields[b'WARC-Record-ID']!r} is damaged")
        text = lambda k: fields[k].decode() if k in fields else None
        page = fields.get(b"X-Page-ID")
        row = (text(b"WARC-Record-ID"), text(b"WARC-Type"), None if page is None else int(page), text(b"WARC-Refers-To"), text(b"WARC-Target-URI"), stated, digest.hex())
        return (*row, payload if response else None) if payloads else row

    def run(batches):
        store, folder = _store(root)
        for batch in batches:
            for file in batch.to_pylist():
                rows, held, records, told = [], 0, 0, {"bytes": 0, "crc32": 0}
                with store.open_input_stream(f"{folder}/{file['name']}", compression=None) as stream:
                    for member in _members(stream, told):
                        fields, block = parse_record(member)
                        records += 1
                        if fields[b"WARC-Type"] != b"warcinfo":
                            rows.append(one(fields, block))
                            held += len(block) if payloads else 0
                        if len(rows) >= 1_000 or held >= 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, held = [], 0
                if (told["bytes"], told["crc32"], records) != (file["bytes"], file["crc32"], file["records"]):
                    raise ValueError(f"{file['name']} is not what the manifest says")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        give_back()

    return run


def read_records(spark: SparkSession, root: str, payloads: bool = False) -> DataFrame:
    """The records of all files of the manifest, checked: record_id, record_type, page_id, refers, url, payload_bytes, payload_digest (hex), and with payloads the payload (null for a revisit)."""
    schema = "record_id string, record_type string, page_id long, refers string, url string, payload_bytes long, payload_digest string" + (", payload binary" if payloads else "")
    files = manifest(spark, root)
    n = files.agg(F.coalesce(F.max("range") + 1, F.lit(1))).first()[0]
    return files.repartitionById(n, "range").mapInArrow(_read(root, payloads), schema)


def resolved(records: DataFrame) -> DataFrame:
    """read_records' rows without refers, with refers_to: the page of the response that a revisit stands for. One without a response of its digest fails."""
    kept = materialise(records.drop("payload"), "warc-read")
    revisits = kept.filter("record_type = 'revisit'")
    responses = kept.filter("record_type = 'response'").select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("there"), F.col("payload_bytes").alias("long"))
    found = revisits.join(responses, "refers", "left")
    lost = F.raise_error(F.concat(F.lit("no response for revisit "), F.col("record_id")))
    digest = F.when((F.col("there") == F.col("payload_digest")) & (F.col("long") == F.col("payload_bytes")), F.col("payload_digest")).otherwise(lost)
    columns = ["record_id", "record_type", "page_id", "url", "payload_bytes"]
    own = kept.filter("record_type = 'response'").select(*columns, "payload_digest", F.lit(None).cast("long").alias("refers_to"))
    return own.unionByName(found.select(*columns, digest.alias("payload_digest"), "refers_to"))
