"""Registered queries of the file sources and their detectors: files are made of columns, read back, and compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text
from quillon.operators import detect, diff, rules
from quillon.session import read_table as table
from quillon.sources import files, syntax


def _said(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _parts(spark: SparkSession, sf_dir: str, said: Column, name: str = "decoded") -> DataFrame:
    #: Files take long for their rows' size: they are dealt to all cores, however few splits the table has.
    dealt = table(spark, sf_dir, "part").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    return dealt.select(F.col("p_partkey").cast("string").alias("path"), said.cast("binary").alias(name))


def _page_files(spark: SparkSession, sf_dir: str, title: Column, body: Column) -> DataFrame:
    """A file per part: two pages under one node, a form that shows itself, an annotation with two states, information and a signature."""
    key = F.col("p_partkey")
    said = _said(
        "%PDF-1.5\n1 0 obj << /Type /Catalog /Pages 2 0 R /AcroForm << /Fields [12 0 R] >> >> endobj\n2 0 obj << /Type /Pages /Kids [3 0 R 4 0 R 2 0 R] /MediaBox [0 0 ", F.col("p_size"), " 800] >> endobj\n",
        "3 0 obj << /Type /Page /Contents [5 0 R 6 0 R] /Annots [8 0 R] /Resources << /XObject << /Fm 7 0 R >> >> >> endobj\n4 0 obj << /Type /Pag", F.when(key % 5 == 0, "").otherwise("e"), " /Contents 6 0 R /Annots [<< /T (x) >>] >> endobj\n",
        "5 0 obj << >> stream\n/Fm Do\nendstream endobj\n6 0 obj << >> stream\nBT (", body, ") Tj ET\nendstream endobj\n7 0 obj << /Subtype /Form /BBox [0 0 1 1] /Matrix [1 0 0 1 5 ", F.col("p_size"), "] >> stream\n/Fm Do q Q\nendstream endobj\n",
        "8 0 obj << /Subtype /Widget /AP << /N << /On 9 0 R /Off 10 0 R >> >> >> endobj\n9 0 obj << /BBox [0 0 2 2] >> stream\n(on) Tj\nendstream endobj\n10 0 obj << /BBox [0 0 2 2] >> stream\n(off) Tj\nendstream endobj\n",
        "11 0 obj << /Title (", title, ") /Producer <FEFF0041> >> endobj\n12 0 obj << /FT /Sig /T (mark) /V << /SubFilter /adbe /M (D:2021) /ByteRange [0 10 20 ", key, "] >> >> endobj\ntrailer << /Root 1 0 R /Info 11 0 R /ID [<00> <", F.lpad(F.hex(F.col("p_size")), 4, F.lit("0")), ">] >>\n%%EOF",
    )
    return _parts(spark, sf_dir, said, "content")


def _later_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    brand, key = F.col("p_brand"), F.col("p_partkey")
    return _page_files(spark, sf_dir, brand, F.col("p_type")), _page_files(spark, sf_dir, F.when(key % 3 == 0, F.lit("none")).otherwise(brand), F.when(key % 4 == 0, F.lit("none")).otherwise(F.col("p_type")))


def page_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.content_rows(_page_files(spark, sf_dir, F.col("p_brand"), F.col("p_type")))
    as_text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("int").cast("string")), " ")
    return found.select("path", F.col("page").cast("long").alias("page"), "part", "name", as_text("box").alias("box"), as_text("matrix").alias("matrix"), F.md5("decoded").alias("digest"))


def structure_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.structure_error_rows(_page_files(spark, sf_dir, F.col("p_brand"), F.col("p_type"))).select("path", "place", "problem")


def file_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.metadata_rows(_page_files(spark, sf_dir, F.col("p_brand"), F.col("p_type"))).select("path", "store", "name", "value")


def file_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of files whose last revisions, version and marks differ by part, and those with more than one revision."""
    key = F.col("p_partkey")
    said = _said("%PDF-1.", key % 8, "\n", F.when(key % 3 == 0, "1 0 obj << /Type /ObjStm >> endobj ").otherwise(""), "trailer << ", F.when(key % 4 == 0, "/Encrypt 9 0 R ").otherwise(""), F.when(key % 5 == 0, "/ID [<00> <01>] ").otherwise(""), ">> startxref 0 %%EOF", F.when(key % 6 == 0, "\nstartxref 1 %%EOF").otherwise(""))
    profiles = files.profiles(_parts(spark, sf_dir, said, "content"))
    twice = detect.extra_revisions(profiles).select(F.col("subject").alias("path"), F.col("text").alias("finding"))
    return profiles.join(twice, "path", "left").select("path", "size", "version", "n_eof", "n_startxref", "object_streams", "encrypted", "has_id", "finding")


def file_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.signature_rows(_page_files(spark, sf_dir, F.col("p_brand"), F.col("p_type")))
    return detect.signature_coverage(found).select("path", "field", "sub_filter", "signed_at", F.array_join(F.transform("byte_range", lambda x: x.cast("string")), " ").alias("byte_range"), "covers")


def file_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and contents of some files change: objects, metadata and sizes that differ."""
    return files.compare_files(*_later_files(spark, sf_dir)).select("path", "part", "item", "change")


def file_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.reference_rows(_page_files(spark, sf_dir, F.col("p_brand"), F.col("p_type"))).select("path", "src", "dst")


def byte_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part's name against itself with one character changed, more after it, or another name."""
    key, name = F.col("p_partkey") % 4, F.col("p_name")
    other = F.when(key == 0, name).when(key == 1, F.concat(name, F.lit("!"))).when(key == 2, F.concat(F.lit("#"), F.expr("substring(p_name, 2)"))).otherwise(F.expr("substring(p_name, 2)"))
    pairs = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), name.cast("binary").alias("before"), other.cast("binary").alias("after"))
    return files.byte_changes(pairs).filter("appended OR identical OR in_place").select("path", "identical", "appended", "in_place")


def described_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part's content stream with its shown brand replaced, and an instruction more for some."""
    key = F.col("p_partkey")
    stream = lambda shown, more: _said("BT /F1 ", F.col("p_size"), " Tf (", shown, ") Tj", more, " ET").cast("binary")
    pairs = table(spark, sf_dir, "part").select(key.cast("string").alias("path"), stream(F.col("p_brand"), "").alias("before"), stream(F.when(key % 2 == 0, F.lit("xyz")).otherwise(F.col("p_brand")), F.when(key % 3 == 0, " T*").otherwise("")).alias("after"))
    found = files.described_changes(pairs, {"/F1": {c: chr(c) for c in range(32, 127)}})
    return found.select("path", F.col("at").cast("long").alias("at"), "text")


def code_widths_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _said("[", F.col("p_size"), " [500 600.5] /x 100 ", F.col("p_size") + 100, " 250]")
    return files.width_rows(_parts(spark, sf_dir, said)).select("path", "code", "width")


def font_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each part's font the codes that its differences set and the one after them, which is the base's."""
    first = F.col("p_size") + 40
    found = files.encoding_rows(_parts(spark, sf_dir, _said("[", first, " /uni0416 /space]")), "WinAnsiEncoding")
    return found.join(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), first.alias("first")), "path").filter("code BETWEEN first AND first + 2").select("path", "code", "name", "text")


def character_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = lambda c: F.lpad(F.hex(c), 4, F.lit("0"))
    said = _said("1 begincodespacerange <0000> <FFFF> endcodespacerange 1 begincidchar <", code(F.col("p_size")), "> 7 endcidchar 1 begincidrange <", code(F.col("p_size") + 100), "> <", code(F.col("p_size") + 102), "> 30 endcidrange")
    return files.character_id_rows(_parts(spark, sf_dir, said)).select("path", "code", "cid")


def split_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands cut into codes of one byte for capitals and two for others."""
    found = files.code_rows(_parts(spark, sf_dir, F.col("p_brand")), [(b"A", b"Z"), (b"[\0", b"\xff\xff"), (b"\0\0", b"@\xff")])
    return found.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda x: x["code"]), " ").alias("codes"))


def code_map_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's map of four codes, written as text and read again: what comes back."""
    codes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.explode(F.array(*[F.struct((F.col("p_size") + n).alias("code"), F.lit(t).alias("text")) for n, t in ((0, "A"), (1, "B"), (2, "C"), (9, "\u0416"))])).alias("x"))
    return files.code_map_rows(files.written_code_maps(codes.select("path", "x.*"))).select("path", "code", "text")


def actual_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to be read out that differ from what is shown."""
    key = F.col("p_partkey")
    said = _said("/Span << /ActualText (", F.when(key % 3 == 0, F.lit("other")).otherwise(F.col("p_brand")), ") >> BDC (", F.col("p_brand"), ") Tj EMC")
    found = files.actual_text_rows(_parts(spark, sf_dir, said)).join(table(spark, sf_dir, "part").select(key.cast("string").alias("path"), "p_brand"), "path")
    return found.select("path", "copy", rules.hidden_copy_mismatch(F.col("copy"), F.col("p_brand")).alias("differs"))


def writing_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _said("(", F.col("p_brand"), ") Tj <", F.when(F.col("p_size") % 2 == 0, F.lit("4a4b")).otherwise(F.lit("4A4B")), "> Tj <41> Tj 1.5 2.25 3.75 4.125 0 0 Tm")
    return files.writing_rows(_parts(spark, sf_dir, said)).select("path", "n_hex", "n_literal", "upper", F.col("decimals").cast("long").alias("decimals"))


def stream_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hexadecimal streams under both names of the filter, and one whose filter nobody knows; the chain in full names."""
    key = F.col("p_partkey") % 3
    name = F.when(key == 0, F.lit("/AHx")).when(key == 1, F.lit("[/ASCIIHexDecode]")).otherwise(F.lit("/Other"))
    made = _parts(spark, sf_dir, _said("1 0 obj << /Filter ", name, " >> stream\n", F.hex(F.col("p_name").cast("binary")), ">\nendstream endobj"), "content")
    return files.stream_rows(made).select("path", F.array_join(text.filter_chain(F.col("filters"), syntax.FILTER_NAMES), " ").alias("chain"), F.col("decoded").cast("string").alias("decoded"))


def stream_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed compressed data (an empty stream, stored) with some bytes after its end: findings, and the header's level."""
    data = bytes.fromhex("789c030000000001")
    made = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.concat(F.lit(b"1 0 obj << /Filter /Fl >> stream\n"), F.lit(data), F.repeat(F.lit("x"), (F.col("p_size") % 4).cast("int")).cast("binary"), F.lit(b"\nendstream endobj")).alias("content"))
    streams = files.stream_rows(made)
    header = text.zlib_header(F.lit(data))
    found = detect.stream_tails(streams).select(F.col("subject").alias("path"), F.col("text").alias("finding"))
    return streams.join(found, "path", "left").select("path", header["valid"].alias("valid"), F.col("level").cast("long").alias("level"), header["level"].cast("long").alias("hint"), "tail", "finding")


def font_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as font programs whose dates, tables or hinting change for some."""
    key, part = F.col("p_partkey"), table(spark, sf_dir, "part")
    side = lambda modified, tables, hinted: part.select(key.alias("font"), modified.alias("modified"), tables.alias("tables"), hinted.alias("hinted"))
    names = lambda *x: F.array(*map(F.lit, x))
    before = side(F.col("p_size"), names("cmap", "glyf", "head"), key % 2 == 0)
    after = side(F.when(key % 3 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")), F.when(key % 5 == 0, names("head", "cmap")).otherwise(names("cmap", "name", "head")), key % 4 == 0)
    return detect.font_changes(before, after, ["font"]).select("key", "subject")


def recompressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, part = F.col("p_partkey"), table(spark, sf_dir, "part")
    before = part.select(key, F.when(key % 7 > 0, F.col("p_size") % 4).alias("level"))
    return detect.recompressed(before, part.select(key, F.lit(2).alias("level")), ["p_partkey"]).select("subject", "text")


def identity_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of two sets of files that differs, as findings, and whether anybody declared it."""
    before, after = (files.metadata_rows(x).drop("error").withColumnRenamed("name", "key") for x in _later_files(spark, sf_dir))
    changes = diff.value_diff(before, after, ["path", "store", "key"], "value")
    undeclared = diff.undeclared(changes, spark.createDataFrame([("/Author",)], "field string"))
    return detect.identity_changes(undeclared, "path", ["/CreationDate"]).select("key", "subject", "text")


def opaque_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("/FlateDecode"), F.lit("/DCT"))).when(F.col("p_partkey") % 3 == 1, F.array(F.lit("/FlateDecode")))
    return table(spark, sf_dir, "part").select("p_partkey", text.is_opaque(chain).alias("opaque"))


def utf16_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts from their bytes, one byte of which is missing for some: a zero takes its place."""
    data = F.encode(F.col("text"), "UTF-16BE")
    cut = F.when(F.col("turn") == 0, F.expr("substring(encode(text, 'UTF-16BE'), 1, 2 * length(text) - 1)")).otherwise(data)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"), text.utf16be_text(cut).alias("back"), "text")
    last = F.ascii(F.expr("substring(text, n)"))
    whole = F.ascii(F.expr("substring(back, n)")) == F.when(F.col("turn") == 0, last.bitwiseAND(0xFF00)).otherwise(last)
    return turns.select("conv_id", "turn", F.length("back").alias("n"), ((F.expr("substring(back, 1, n - 1)") == F.expr("substring(text, 1, n - 1)")) & whole).alias("same"))


NAMES = """page_contents structure_errors file_metadata file_profiles file_signatures file_comparison file_references byte_changes described_changes
code_widths_expanded font_encodings character_ids split_codes code_map_written actual_texts writing_styles stream_filters stream_tails font_changes
recompressed identity_changes opaque_filters utf16_texts""".split()
QUERIES = {name: globals()[name] for name in NAMES}
