"""WARC archives: whole round trips against brute force, the same bytes in every run, and damage that must be found."""

import collections
import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from quillon.llm import registry, warc

SCHEMA = "page_id long, url string, html string, sha string, range int, payload string"
LONG = "é long payload " * 80


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, u, t, "x", 1, None) for i, u, t in rows], SCHEMA).repartition(parts)


def odd_rows():
    rows = [(i, f"http://example.net/{i}", f"page {i} " * (i % 9 * 30)) for i in range(120)]
    rows += [(200 + i, f"http://copy/{i}", LONG) for i in range(50)] + [(300, "a", "short"), (301, "b", "short"), (302, None, None), (303, "c", ""), (304, "with space\r\nX: y\x00é", "x" * 400_000)]
    rows += [(249, "http://copy/a", LONG), (249, None, LONG), (249, None, LONG), (7, "again", LONG), (None, "n", LONG), (None, "n", "null id " * 200), (None, None, "null id " * 200), (400, "equal", "y" * 1000), (400, "equal", "y" * 1000), (401, "limit", "z" * 999), (402, "limit", "z" * 999)]
    return rows


def brute(rows, least=1000):
    data = [(i, u, (t or "").encode()) for i, u, t in rows]
    groups = collections.defaultdict(list)
    for at, (i, u, p) in enumerate(data):
        if len(p) >= least:
            groups[p].append(((i is None, -(i or 0)), u is not None, u or "", at))
    out = []
    first = {p: min(g) for p, g in groups.items()}
    for at, (i, _, p) in enumerate(data):
        own = p not in first or first[p][3] == at
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "response" if own else "revisit", None if own else data[first[p][3]][0]))
    return sorted(out, key=repr)


def result(spark, root):
    found = warc.resolved(warc.read_records(spark, root)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted(map(tuple, found.collect()), key=repr)


def files(root):
    folder = root.removeprefix("file://")
    return {f: open(f"{folder}/{f}", "rb").read() for f in os.listdir(folder) if f.endswith(".warc.gz")}


def test_archives_hold_what_was_written_in_the_same_bytes_whatever_the_partitions(spark):
    rows = odd_rows()
    roots = [warc.write_warc(table(spark, rows, n), min_ranges=5, roll_bytes=2_000) for n in (1, 4)]
    assert result(spark, roots[0]) == brute(rows)
    first, second = files(roots[0]), files(roots[1])
    assert first == second and len(first) > 10 and max(f.rsplit("-", 1)[1] for f in first) > "00000.warc.gz"
    assert not os.path.exists(roots[0].removeprefix("file://") + "/_temporary")


def test_records_keep_their_order_and_any_reader_opens_them(spark):
    root = warc.write_warc(table(spark, odd_rows()), min_ranges=4, roll_bytes=50_000)
    pages = []
    for _, data in sorted(files(root).items()):
        text = gzip.decompress(data)
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        pages += [int(x.split(b": ")[1]) for x in text.split(b"\r\n") if x.startswith(b"X-Page-ID: ")]
    assert pages == sorted(pages) and len(pages) == len([i for i, _, _ in odd_rows() if i is not None])


def test_payloads_come_back(spark):
    rows = [(i, u, t) for i, u, t in odd_rows() if i is not None and i < 200 or i == 304]
    root = warc.write_warc(table(spark, rows))
    back = warc.read_records(spark, root, payloads=True).filter("record_type = 'response'").select("page_id", F.decode("payload", "utf-8"))
    expected = {(i, t) for i, u, t in rows}
    assert {tuple(r) for r in back.collect()} <= expected and back.count() >= 119
    urls = {r["page_id"]: r["url"] for r in warc.read_records(spark, root).collect()}
    assert urls[304] == "with%20space%0D%0AX:%20y%00é"


def test_damage_is_found(spark):
    for harm in ("flip", "cut", "gone", "response"):
        rows = [(1, "u", LONG), (2, "u", LONG), (3, "u", "other " * 300)]
        root = warc.write_warc(table(spark, rows), min_ranges=1)
        folder = root.removeprefix("file://")
        name = next(f for f in os.listdir(folder) if f.endswith(".warc.gz"))
        data = open(f"{folder}/{name}", "rb").read()
        if harm == "gone":
            os.remove(f"{folder}/{name}")
        elif harm != "response":
            open(f"{folder}/{name}", "wb").write(data[:-40] if harm == "cut" else data[:400] + bytes([data[400] ^ 1]) + data[401:])
        for f in os.listdir(folder):
            if f.startswith("."):
                os.remove(f"{folder}/{f}")
        with pytest.raises(Exception):
            read = warc.read_records(spark, root)
            warc.resolved(read.filter("page_id <> 2") if harm == "response" else read).collect()


def test_a_repeated_commit_moves_nothing_twice(spark):
    root = warc.write_warc(table(spark, odd_rows()[:20]), min_ranges=2)
    rows = warc.manifest(spark, root).withColumn("beside", F.lit("_temporary/gone"))
    assert rows.mapInArrow(warc._commit(root), warc._MANIFEST).count() == rows.count()


def test_empty_table_and_one_row(spark):
    assert result(spark, warc.write_warc(table(spark, []))) == []
    assert result(spark, warc.write_warc(table(spark, [(None, None, None)]))) == [(None, 0, hashlib.sha1(b"").hexdigest(), "response", None)]


def test_query_equals_its_sql(spark):
    import duckdb

    duck = duckdb.connect()
    duck.sql("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.001/pages.parquet'")
    made = registry.op12_warc(spark, "/root/testdata/sf0.001")
    own = duck.sql(registry.ORACLES["op12_warc"])
    assert sorted(map(tuple, made.collect()), key=repr) == sorted(own.select(*made.columns).fetchall(), key=repr)
