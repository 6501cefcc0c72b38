"""Tables from page-description files, edit lists, and their sinks.

Files come as rows (path, content) of spark.read.format("binaryFile"); everything below runs map-side, file by file.
"""

from __future__ import annotations

import difflib
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import syntax, text_state

# In ems, a gap that ends a run, an overlap that does, and a gap that is a space.
RUN_GAP, RUN_OVERLAP, SPACE_GAP = 2.5, -0.05, 0.19
EDIT_SCHEMA = "page int, run long, glyph_start int, glyph_end int, new_text string, old_text string, continuation boolean, `group` long"
#: Bytes of rows that go on in one batch; what a row counts for besides its texts.
TOGETHER, ROW_BYTES = 1 << 20, 500
_KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}


def read_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def _table(files: DataFrame, schema: str, rows_of, key: str = "path", data: str = "content") -> DataFrame:
    """rows_of(bytes) gives dicts; the result has the key and schema's columns. A file that can't be read gives one row with `error`."""
    fields = [tuple(x.split(" ")) for x in schema.split(", ")]

    def of(content):
        try:
            return list(rows_of(content or b""))
        except Exception as e:  # one damaged file doesn't stop the others
            return [{"error": f"{type(e).__name__}: {e}"}]

    def table(held):
        rows = [r for _, found in held for r in found]
        paths = pa.array([path for path, found in held for _ in found], pa.string())
        return pa.RecordBatch.from_arrays([paths, *(pa.array([r.get(n) for r in rows], _KINDS[k]) for n, k in fields), pa.array([r.get("error") for r in rows], pa.string())], [key, *(n for n, _ in fields), "error"])

    def run(batches):
        #: Rows of up to TOGETHER bytes, and the last file's, give one batch: of small files a batch each costs as much as reading them.
        for batch in batches:
            held, size = [], 0
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if found := of(content):
                    held.append((path, found))
                    size += sum(ROW_BYTES + sum(len(v) for v in r.values() if isinstance(v, bytes | str)) for r in found)
                    if size >= TOGETHER:
                        yield table(held)
                        held, size = [], 0
            if held:
                yield table(held)

    return files.select(F.col(key).cast("string").alias(key), data).mapInArrow(run, f"{key} string, {schema}, error string")


def profiles(files: DataFrame) -> DataFrame:
    """One row per file: size, version, ends (%%EOF), starts (startxref), object streams, linearised, encrypted, has_id, has_metadata."""

    def one(data: bytes):
        version = re.match(rb"%PDF-(\d\.\d)", data)
        yield {
            "size": len(data), "version": version[1].decode() if version else None, "n_eof": data.count(b"%%EOF"), "n_startxref": data.count(b"startxref"), "object_streams": b"/ObjStm" in data,
            "linearised": re.search(rb"obj\s*<<[^>]*/Linearized", data) is not None, "encrypted": re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data) is not None, "has_id": re.search(rb"/ID\s*\[", data) is not None, "has_metadata": b"/Metadata" in data,
        }

    return _table(files, "size long, version string, n_eof long, n_startxref long, object_streams boolean, linearised boolean, encrypted boolean, has_id boolean, has_metadata boolean", one)


def stream_rows(files: DataFrame) -> DataFrame:
    """One row per stream: num, gen, start, length, filters, header (FLEVEL hint), tail (unused bytes), digest, decoded."""

    def every(data: bytes):
        for s in syntax.streams(data):
            payload, chain = data[s.start : s.start + s.length], syntax.filters(s.head)
            decoded, tail = syntax.decoded(payload, chain)
            valid = len(payload) > 1 and payload[0] & 15 == 8 and (payload[0] << 8 | payload[1]) % 31 == 0
            yield {"num": s.num, "gen": s.gen, "start": s.start, "length": s.length, "filters": chain, "level": payload[1] >> 6 if valid else None, "tail": tail if valid else 0, "digest": hashlib.sha256(payload).hexdigest(), "decoded": decoded}

    return _table(files, "num long, gen long, start long, length long, filters array<string>, level int, tail long, digest string, decoded binary", every)


def reference_rows(files: DataFrame) -> DataFrame:
    """Edges between objects, those in compressed object streams too: src and dst as 'num gen'."""
    return _table(files, "src string, dst string", lambda data: ({"src": f"{a} {b}", "dst": f"{c} {d}"} for a, b, c, d in syntax.references(syntax.unpacked(data))))


def object_rows(files: DataFrame) -> DataFrame:
    """One row per object, those in compressed object streams too, with the digests of its dictionary and its data, for record_diff."""

    def every(data: bytes):
        for (num, gen), m in syntax.objects(syntax.unpacked(data)).items():
            head, _, body = m[3].partition(b"stream")
            yield {"num": num, "gen": gen, "head": hashlib.sha256(head).hexdigest(), "body": hashlib.sha256(body).hexdigest()}

    return _table(files, "num long, gen long, head string, body string", every)


def metadata_rows(files: DataFrame) -> DataFrame:
    """(store, key, value) of each file: its information dictionary, its id and its XMP packet."""
    return _table(files, "store string, name string, value string", lambda data: ({"store": s, "name": k, "value": v} for s, k, v in syntax.metadata(syntax.unpacked(data))))


def signature_rows(files: DataFrame) -> DataFrame:
    """One row per signed field, for detect.signature_coverage."""
    return _table(files, "field string, sub_filter string, signed_at string, byte_range array<long>, size long", lambda data: ({"field": n, "sub_filter": f, "signed_at": t, "byte_range": r, "size": len(data)} for n, f, t, r in syntax.signatures(syntax.unpacked(data))))


def actual_text_rows(streams: DataFrame, key: str = "path", data: str = "decoded") -> DataFrame:
    """The texts that content streams give to be read out instead of what is shown, for rules.hidden_copy_mismatch."""
    return _table(streams, "copy string", lambda d: ({"copy": t} for t in syntax.actual_texts(d)), key, data)


def writing_rows(streams: DataFrame, key: str = "path", data: str = "decoded") -> DataFrame:
    """How each content stream writes its strings and numbers."""
    return _table(streams, "n_hex long, n_literal long, upper boolean, decimals int", lambda d: [syntax.string_votes(d)], key, data)


def compare_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two sets of files, compared by path: (path, part, item, change). Parts: object (dictionary, data or both), metadata and container; equal files give no row."""
    from quillon.operators import detect, diff

    objects = diff.record_diff(object_rows(before).drop("error"), object_rows(after).drop("error"), ["path", "num", "gen"], {"head": "head", "body": "body"}).filter("status <> 'identical'")
    changed = objects.select("path", F.lit("object").alias("part"), F.concat_ws(" ", "num", "gen").alias("item"), F.col("status").alias("change"))
    values = diff.value_diff(metadata_rows(before).drop("error"), metadata_rows(after).drop("error"), ["path", "store", "name"], "value")
    told = values.select("path", F.lit("metadata").alias("part"), F.concat_ws(" ", "store", "name").alias("item"), F.concat_ws(" -> ", F.coalesce("before", F.lit("nothing")), F.coalesce("after", F.lit("nothing"))).alias("change"))
    container = detect.container_changes(profiles(before), profiles(after), ["path"])
    return changed.unionByName(told).unionByName(container.select(F.col("subject").alias("path"), F.lit("container").alias("part"), F.col("key").alias("item"), F.col("text").alias("change")))


def instruction_rows(streams: DataFrame, key: str = "path", data: str = "decoded") -> DataFrame:
    """One row per instruction of a content stream: op_index, operator, operands (JSON; strings in hexadecimal), start, end."""
    shown = lambda x: [shown(y) for y in x] if isinstance(x, list) else x.hex() if isinstance(x, bytes) else x
    return _table(streams, "op_index int, operator string, operands string, start long, end long", lambda d: ({"op_index": i, "operator": x.operator, "operands": json.dumps(shown(x.operands)), "start": x.start, "end": x.end} for i, x in enumerate(syntax.instructions(d))), key, data)


def glyph_rows(streams: DataFrame, fonts: dict[str, text_state.Font], key: str = "path", data: str = "decoded") -> DataFrame:
    """One row per glyph shown; fonts by resource name are an argument, since a stream names but doesn't hold them."""
    schema = "op_index int, elem_index int, byte_start int, code int, text string, x0 double, x1 double, y0 double, size double, font string, segment int"
    return _table(streams, schema, lambda d: text_state.glyphs(d, fonts), key, data)


def code_map_rows(streams: DataFrame, key: str = "path", data: str = "decoded") -> DataFrame:
    """(code, text) of a stream that maps codes to Unicode."""
    return _table(streams, "code long, text string", lambda d: ({"code": c, "text": t} for c, t in syntax.unicode_map(d).items()), key, data)


def content_rows(files: DataFrame) -> DataFrame:
    """What pages show, by the page tree: page (from 0), part (page, form or appearance), name, box, matrix, decoded. A page's origin is the lower left corner of its box."""
    return _table(files, "page int, part string, name string, box array<double>, matrix array<double>, decoded binary", syntax.contents)


def structure_error_rows(files: DataFrame) -> DataFrame:
    """(place, problem): what is wrong with each file's structure, for detect.finding."""
    return _table(files, "place string, problem string", lambda data: ({"place": p, "problem": t} for p, t in syntax.structure_errors(data)))


def width_rows(arrays: DataFrame, key: str = "path", data: str = "decoded") -> DataFrame:
    """(code, width) of arrays of widths, written as they stand in files: [first [w ...] first last w ...]."""
    return _table(arrays, "code long, width double", lambda d: ({"code": c, "width": float(w)} for c, w in syntax.widths(syntax.value_of(d) or []).items()), key, data)


def encoding_rows(arrays: DataFrame, base: str, key: str = "path", data: str = "decoded") -> DataFrame:
    """(code, name, text) of a font's encoding: the named base, changed by an array of differences; texts of names that only a list of glyphs knows are empty."""

    def every(d: bytes):
        own = syntax.differences(syntax.value_of(d) or [])
        rows = {c: (syntax.glyph_name(t), t) for c, t in syntax.base_encoding(base).items()} | {c: (n, syntax.glyph_text(n)) for c, n in own.items()}
        return ({"code": c, "name": n, "text": t} for c, (n, t) in rows.items())

    return _table(arrays, "code long, name string, text string", every, key, data)


def written_code_maps(codes: DataFrame, key: str = "path", width: int = 2) -> DataFrame:
    """(key, decoded): one code map, as text, of each key's rows (code, text); it reads back as code_map_rows gives them."""
    maps = codes.groupBy(F.col(key).cast("string").alias(key)).agg(F.map_from_entries(F.collect_list(F.struct("code", "text"))).alias("map"))
    return _table(maps, "decoded binary", lambda m: [{"decoded": syntax.code_map_text(dict(m), width)}], key, "map").drop("error")


def character_id_rows(streams: DataFrame, key: str = "path", data: str = "decoded") -> DataFrame:
    """(code, cid) of a stream that maps codes to character ids."""
    return _table(streams, "code long, cid long", lambda d: ({"code": c, "cid": i} for c, i in syntax.cid_map(d)[1].items()), key, data)


def code_rows(strings: DataFrame, spaces: list[tuple[bytes, bytes]], key: str = "path", data: str = "decoded") -> DataFrame:
    """(at, code) of strings cut into codes by their code spaces; code in hexadecimal."""
    return _table(strings, "at int, code string", lambda d: ({"at": i, "code": c.hex()} for i, c in enumerate(syntax.split_codes(d, spaces))), key, data)


def described_changes(pairs: DataFrame, fonts: dict[str, dict[int, str]], key: str = "path", before: str = "before", after: str = "after", width: int = 1) -> DataFrame:
    """How content streams changed, for people: one row per change, with at (the first instruction, from 0, of the stream before) and text. fonts: code maps by resource name."""

    def every(pair: dict):
        old, new = (list(syntax.readable(pair[side] or b"", fonts, width)) for side in ("before", "after"))
        for op, a, b, c, d in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
            gone, come = "; ".join(old[a:b]), "; ".join(new[c:d])
            if op != "equal":
                yield {"at": a, "text": f"{gone} became {come}" if gone and come else f"{gone} vanished" if gone else f"{come} is new"}

    both = pairs.select(key, F.struct(F.col(before).alias("before"), F.col(after).alias("after")).alias("pair"))
    return _table(both, "at int, text string", every, key, "pair")


def byte_changes(pairs: DataFrame, key: str = "path", before: str = "before", after: str = "after") -> DataFrame:
    """same_bytes of each pair of files."""
    both = pairs.select(key, F.struct(F.coalesce(F.col(before), F.lit(b"")).alias("before"), F.coalesce(F.col(after), F.lit(b"")).alias("after")).alias("pair"))
    return _table(both, "identical boolean, appended boolean, n_changed long, in_place boolean", lambda p: [same_bytes(p["before"], p["after"])], key, "pair")


def runs_of_glyphs(glyphs: DataFrame, per: list[str]) -> DataFrame:
    """Glyphs to runs: a new run at another segment, baseline or size, a gap over 2.5 or under -0.05 of the size; a gap of 0.19 is a space.

    run_id counts the runs of `per` in stream order.
    """
    order = ["op_index", "elem_index", "byte_start"]
    w = Window.partitionBy(*per).orderBy(*order)
    gap = (F.col("x0") - F.lag("x1").over(w)) / F.when(F.col("size") == 0, 1.0).otherwise(F.col("size"))
    starts = F.lag("segment").over(w).isNull() | (F.lag("segment").over(w) != F.col("segment")) | (F.abs(F.lag("y0").over(w) - F.col("y0")) > 0.01) | (F.abs(F.lag("size").over(w) - F.col("size")) > 1e-6) | (gap > RUN_GAP) | (gap < RUN_OVERLAP)
    marked = glyphs.withColumn("gap", gap).withColumn("starts", starts)
    piece = F.when(~F.col("starts") & (F.col("gap") >= SPACE_GAP), F.concat(F.lit(" "), "text")).otherwise(F.col("text"))
    numbered = marked.withColumn("piece", piece).withColumn("run_id", F.sum(F.col("starts").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "piece"))), lambda g: g["piece"]), "")
    return numbered.groupBy(*per, "run_id").agg(joined.alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("size").alias("size"), F.count(F.lit(1)).alias("n_glyphs"))


# Edit lists


def read_edits(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of edits, or one to a line; absent old_text is empty, continuation false, group 0."""
    return spark.read.schema(EDIT_SCHEMA).option("multiLine", "true").json(path).withColumns({"old_text": F.coalesce("old_text", F.lit("")), "continuation": F.coalesce("continuation", F.lit(False)), "group": F.coalesce("group", F.lit(0).cast("long"))})


def write_edits(edits: DataFrame, path: str) -> None:
    edits.select("page", "run", "glyph_start", "glyph_end", "new_text", "old_text", "continuation", "group").write.json(path)


def same_bytes(before: bytes, after: bytes) -> dict:
    """How two files differ: whether after only appends, how many places differ, and whether that counts as in place."""
    changed = sum(a != b for a, b in zip(before, after, strict=False))
    return {"identical": before == after, "appended": len(after) > len(before) and after.startswith(before), "n_changed": changed, "in_place": len(before) == len(after) and 0 < changed < max(64, len(before) / 5)}
