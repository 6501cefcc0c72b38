"""Files assembled here, read back."""

import json
import zlib

import pyarrow as pa
import pytest

from quillon.operators import detect, graph
from quillon.sources import files, syntax, text_state


def pdf(*objs: bytes, tail: bytes = b"") -> bytes:
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objs, 1)) + b"trailer << /Root 1 0 R >>\nstartxref\n0\n%%EOF\n" + tail


def flate(data: bytes, level: int = 6, extra: bytes = b"") -> bytes:
    body = zlib.compress(data, level) + extra
    return b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(body), body)


CONTENT = b"BT /F1 10 Tf 100 700 Td (Hel\\154o) Tj 0 -12 Td [(W) -50 (orld) -400 (x)] TJ ET BI /W 1 ID ab EI q Q"


@pytest.fixture
def documents(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(pdf(b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Kids [3 0 R] >>", b"<< /Parent 2 0 R /Contents 4 0 R >>", flate(CONTENT), b"<< /Lost 9 0 R >>"))
    (tmp_path / "b.pdf").write_bytes(pdf(b"<< >>", flate(b"x", 9, b"\0\0\0"), tail=b"%%EOF"))
    return files.read_files(spark, str(tmp_path))


def test_streams_and_profiles(documents):
    found = {(r["path"][-5:], r["num"]): r for r in files.stream_rows(documents).collect()}
    assert bytes(found["a.pdf", 4]["decoded"]) == CONTENT and found["a.pdf", 4]["tail"] == 0
    assert found["b.pdf", 2]["tail"] == 3 and found["b.pdf", 2]["level"] == 3
    assert {r["path"][-5:]: r["n_eof"] for r in files.profiles(documents).collect()} == {"a.pdf": 1, "b.pdf": 2}
    assert files.object_rows(documents).count() == 7


def test_what_the_root_reaches(spark, documents):
    edges = files.reference_rows(documents).filter("path LIKE '%a.pdf'")
    reached = graph.reachable(edges, spark.createDataFrame([("1 0",)], "node string"))
    assert {r["node"] for r in reached.collect()} == {"1 0", "2 0", "3 0", "4 0"}


def test_runs_of_a_stream(documents):
    font = text_state.Font(texts={c: chr(c) for c in range(32, 127)}, widths=dict.fromkeys(range(32, 127), 500.0))
    shown = files.glyph_rows(files.stream_rows(documents).filter("num = 4 AND path LIKE '%a.pdf'"), {"/F1": font})
    runs = [(r["text"], round(r["x0"], 3), round(r["y0"], 3)) for r in files.runs_of_glyphs(shown, ["path"]).orderBy("run_id").collect()]
    assert runs == [("Hello", 100.0, 700.0), ("World x", 100.0, 688.0)]


def test_instructions(documents):
    rows = files.instruction_rows(files.stream_rows(documents).filter("num = 4")).collect()
    assert [r["operator"] for r in rows] == ["BT", "Tf", "Td", "Tj", "Td", "TJ", "ET", "BI", "q", "Q"]
    assert json.loads(rows[3]["operands"]) == [b"Hello".hex()]


@pytest.mark.parametrize("data,kinds", [(b"<4", ["hex"]), (b"(a(b)\\)c) /N#41 [1 .5 -2]", ["string", "name", "open", "number", "number", "number", "close"]), (b"((( Tj", ["string"]), (b"% note\nq 1a", ["word", "word"])])
def test_tokens(data, kinds):
    assert [t.kind for t in syntax.tokens(data)] == kinds


def test_code_maps_round_trip():
    mapping = {1: "А", 2: "Б", 3: "В", 100: "ﬁ", 500: "я", 65535: "Ω"}
    assert syntax.unicode_map(syntax.code_map_text(mapping)) == mapping
    letters = {i: chr(65 + i) for i in range(26)}
    assert syntax.code_map_text(letters).count(b"<") == 5 and syntax.unicode_map(syntax.code_map_text(letters)) == letters
    assert syntax.unicode_map(b"1 beginbfrange <01> <03> [<0041> <0042> <0043>] <09> <05> <0041> endbfrange") == {1: "A", 2: "B", 3: "C"}
    assert syntax.cid_map(b"begincodespacerange <00> <7F> <8000> <FFFF> endcodespacerange 1 begincidrange <8000> <8002> 5 endcidrange") == ([(b"\0", b"\x7f"), (b"\x80\0", b"\xff\xff")], {0x8000: 5, 0x8001: 6, 0x8002: 7})
    assert syntax.split_codes(b"A\x80\1B\x81", [(b"\0", b"\x7f"), (b"\x80\0", b"\xff\xff")]) == [b"A", b"\x80\1", b"B", b"\x81"]
    assert syntax.split_codes(b"\x80\1\x81", [(b"\x80\0", b"\xff\xff")]) == [b"\x80\1", b"\x81"]
    assert syntax.split_codes(b"\0\1\2", syntax.TWO_BYTES) == [b"\0\1"]


def test_widths_and_differences():
    assert syntax.widths([1, [10, 20], 5, 7, 30, "x", 9]) == {1: 10.0, 2: 20.0, 5: 30.0, 6: 30.0, 7: 30.0}
    assert syntax.differences([32, "/space", "/A", 65, "/B"]) == {32: "space", 33: "A", 65: "B"}
    assert syntax.base_encoding("/WinAnsiEncoding")[0x80] == "€" and syntax.base_encoding("Other").get(0x80) is None
    standard = syntax.base_encoding("/StandardEncoding")
    assert (standard[0x27], standard[0xA1], standard[0xB7], standard[0xD0], standard[0xFB], standard.get(0xB0)) == ("’", "¡", "•", "—", "ß", None)
    assert syntax.simple_widths(65, [500, "x", 250.5], 9.0) == {65: 500.0, 66: 9.0, 67: 250.5}
    data = b"q 1 w\nBT\nET\nQ"
    spans = [(x.start, x.end) for x in syntax.instructions(data)]
    assert syntax.dominant_separator(data, spans) == b"\n" and syntax.dominant_separator(b"", []) == b"\n"


def test_edit_lists(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps([{"page": 0, "run": 1, "glyph_start": 0, "glyph_end": 2, "new_text": "x"}]))
    read = files.read_edits(spark, str(tmp_path / "e.json"))
    assert tuple(read.first()) == (0, 1, 0, 2, "x", "", False, 0)
    files.write_edits(read, str(tmp_path / "out"))
    assert files.read_edits(spark, str(tmp_path / "out")).collect() == read.collect()
    assert files.same_bytes(b"abc", b"abcd")["appended"] and files.same_bytes(b"abc", b"abd")["in_place"]


def test_objects_in_object_streams_and_chains_of_filters(spark, tmp_path):
    packed = b"5 0 6 12 << /Kid 6 0 R >> << /Name /Kept >>"
    first = packed.index(b"<<")
    packed = b"5 0 6 18 " + packed[first:].replace(b">> <<", b">>  <<")
    head = packed.index(b"<<")
    body = zlib.compress(packed)
    stm = b"<< /Type /ObjStm /N 2 /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (head, len(body), body)
    twice = zlib.compress(b"twice").hex().encode() + b">"
    chain = b"<< /Filter [/AHx /Fl] /Length %d >>\nstream\n%s\nendstream" % (len(twice), twice)
    runs = b"<< /Filter /RunLengthDecode >>\nstream\n\x02abc\xfed\x80\nendstream"
    strange = b"<< /Filter /DCTDecode >>\nstream\nxyz\nendstream"
    (tmp_path / "o.pdf").write_bytes(pdf(b"<< /Type /Catalog /Pages 5 0 R >>", stm, chain, runs) + b"9 0 obj\n" + strange + b"\nendobj\n")
    read = files.read_files(spark, str(tmp_path))
    reached = graph.reachable(files.reference_rows(read), spark.createDataFrame([("1 0",)], "node string"))
    assert {r["node"] for r in reached.collect()} == {"1 0", "5 0", "6 0"}
    found = {r["num"]: r["decoded"] for r in files.stream_rows(read).collect()}
    assert (bytes(found[3]), bytes(found[4]), found[9]) == (b"twice", b"abcddd", None)
    assert {r["num"] for r in files.object_rows(read).collect()} == {1, 2, 3, 4, 5, 6, 9}


XMP = b"""<?xpacket begin='' id='x'?><x:xmpmeta xmlns:x='adobe:ns:meta/'><rdf:RDF xmlns:rdf='http://www.w3.org/1999/02/22-rdf-syntax-ns#'><rdf:Description rdf:about='' xmlns:pdf='http://ns.adobe.com/pdf/1.3/' pdf:Producer='maker' xmlns:dc='http://purl.org/dc/elements/1.1/'><dc:title><rdf:Alt><rdf:li>A title</rdf:li></rdf:Alt></dc:title></rdf:Description></rdf:RDF></x:xmpmeta><?xpacket end='w'?>"""


def signed(title: bytes, content: bytes = b"q Q") -> bytes:
    objs = [
        b"<< /Type /Catalog /AcroForm << /Fields [4 0 R 6 0 R] >> /Metadata 3 0 R >>",
        b"<< /Title (" + title + b") /ModDate (D:20210305) >>",
        b"<< /Type /Metadata /Subtype /XML /Length %d >>\nstream\n%s\nendstream" % (len(XMP), XMP),
        b"<< /T (form) /Kids [5 0 R 4 0 R] >>",
        b"<< /T (sig) /FT /Sig /V << /SubFilter /adbe.x /M (D:2021) /ByteRange [0 100 200 100] >> >>",
        b"<< /T (plain) /FT /Tx /V (x) >>",
        b"<< /Length %d >>\nstream\n%s\nendstream" % (len(content), content),
    ]
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objs, 1)) + b"trailer << /Root 1 0 R /Info 2 0 R /ID [<00ff> <01>] >>\nstartxref\n0\n%%EOF\n"


def test_metadata_signatures_and_comparison(spark, tmp_path):
    for side, title, content in (("a", b"Old", b"/Span << /ActualText (shown) >> BDC <aB> Tj (x) Tj 1.5 2.25 3.75 Td EMC"), ("b", b"\xfe\xff\x04\x1d", b"q Q")):
        (tmp_path / side).mkdir()
        (tmp_path / side / "f.pdf").write_bytes(signed(title, content))
    from pyspark.sql import functions as F

    before, after = (files.read_files(spark, str(tmp_path / side)).withColumn("path", F.lit("f")) for side in "ab")
    found = {(r["store"], r["name"]): r["value"] for r in files.metadata_rows(before).collect()}
    assert found == {("info", "/Title"): "Old", ("info", "/ModDate"): "D:20210305", ("id", "0"): "00ff", ("id", "1"): "01", ("xmp", "{http://ns.adobe.com/pdf/1.3/}Producer"): "maker", ("xmp", "{http://purl.org/dc/elements/1.1/}title"): "A title"}
    rows = files.signature_rows(before)
    assert [(r["field"], r["sub_filter"], r["signed_at"], r["byte_range"]) for r in rows.collect()] == [("form.sig", "/adbe.x", "D:2021", [0, 100, 200, 100])]
    assert [r["key"] for r in detect.uncovered_signatures(rows).collect()] == ["signature-coverage"]
    streams = files.stream_rows(before).filter("num = 7")
    assert [r["copy"] for r in files.actual_text_rows(streams).collect()] == ["shown"]
    assert [(r["n_hex"], r["n_literal"], r["upper"], r["decimals"]) for r in files.writing_rows(streams).collect()] == [(1, 2, True, 2)]
    assert files.compare_files(before, before).count() == 0
    changes = {(r["part"], r["item"]): r["change"] for r in files.compare_files(before, after).collect()}
    assert changes[("metadata", "info /Title")] == "Old -> Н" and changes[("object", "2 0")] == "changed head" and changes[("object", "7 0")] == "changed both"
    assert set(changes) == {("metadata", "info /Title"), ("object", "2 0"), ("object", "7 0"), ("container", "file-size")}


def _file(*objects: bytes, root: bytes = b"1 0 R") -> bytes:
    return b"%PDF-1.4\n" + b"\n".join(objects) + b"\ntrailer << /Root " + root + b" >>\n%%EOF"


def test_pages_inherit_and_cycles_end():
    data = _file(
        b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj",
        b"2 0 obj << /Kids [3 0 R 2 0 R 9 0 R 4 0 R] /MediaBox [0 0 10 20] >> endobj",
        b"3 0 obj << /Type /Page /MediaBox 5 0 R /Contents 6 0 R >> endobj",
        b"4 0 obj << /Type /Page >> endobj",
        b"5 0 obj [1 2 3 4] endobj",
        b"6 0 obj << >> stream\nq Q\nendstream endobj",
    )
    found = list(syntax.contents(data))
    assert [(p["page"], p["box"], p["decoded"]) for p in found] == [(0, [1, 2, 3, 4], b"q Q"), (1, [0, 0, 10, 20], b"")]
    assert list(syntax.contents(b"")) == [] == list(syntax.contents(b"no file"))


def test_forms_show_each_other_once():
    data = _file(
        b"1 0 obj << /Pages 2 0 R >> endobj",
        b"2 0 obj << /Kids [3 0 R] >> endobj",
        b"3 0 obj << /Type /Page /Contents 4 0 R /Resources << /XObject << /A 5 0 R /B 6 0 R >> >> >> endobj",
        b"4 0 obj << >> stream\n/A Do /B Do /A Do\nendstream endobj",
        b"5 0 obj << /Subtype /Form >> stream\n/B Do\nendstream endobj",
        b"6 0 obj << /Subtype /Form /Resources << /XObject << /C 5 0 R >> >> >> stream\n/C Do\nendstream endobj",
    )
    assert [p["name"] for p in syntax.contents(data) if p["part"] == "form"] == ["/A", "/B"]


def test_structure_errors():
    data = b"1 0 obj << /Pages 2 0 R /Lost 77 0 R >> endobj 2 0 obj << /Kids [3 0 R] >> endobj 3 0 obj << /Type /Page /Annots [5 0 R] /Resources << /Font << /F 4 0 R >> >> >> endobj 4 0 obj << /FontDescriptor << /FontFile2 6 0 R >> >> endobj 5 0 obj 7 endobj 6 0 obj << /Filter /FlateDecode >> stream\nxx\nendstream endobj trailer << /Root 1 0 R >>"
    assert set(syntax.structure_errors(data)) == {
        ("file", "no header"), ("object 1 0", "refers to object 77 0, which isn't there"), ("object 6 0", "stream can't be decoded"), ("page 0", "no box"),
        ("page 0, annotation 0", "no dictionary"), ("page 0, font /F", "no subtype"), ("page 0, font /F", "program is empty"),
    }


def test_readable_instructions():
    data = b"/F1 12 Tf (AB) Tj [(A) -20.5 <FF>] TJ /F9 1 Tf (A) Tj"
    assert list(syntax.readable(data, {"/F1": {65: "x", 66: "y"}})) == ["/F1 12 Tf", "(xy) Tj", "[(x) -20.5 <ff>] TJ", "/F9 1 Tf", "<41> Tj"]


class OneBatch:
    """Stands for a table of files: the batches that a worker gives for one batch of them."""

    def __init__(self, rows):
        self.batch = pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows]), pa.array([c for _, c in rows], pa.binary())], ["path", "content"])

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return list(run(iter([self.batch])))


def test_small_files_go_on_together(spark):
    rows = [(str(i), b"1 0 obj << >> endobj 2 0 obj << /A 1 0 R >> endobj") for i in range(500)]
    batches = files.reference_rows(OneBatch(rows))
    assert [b.num_rows for b in batches] == [500] and batches[0].column("path").to_pylist() == [p for p, _ in rows]


def test_objects_are_parsed_once(monkeypatch):
    parsed = []
    monkeypatch.setattr(syntax, "_small_value", lambda body, f=syntax.value_of: parsed.append(body) or f(body))
    doc = syntax.Document(b"1 0 obj << /A 2 0 R >> endobj 2 0 obj [3 4] endobj")
    assert [doc.items(doc.entries("1 0 R")["/A"]) for _ in range(3)] == [[3, 4]] * 3 and len(parsed) == 2
