"""The thin queries of this subpackage, opN_<name>, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import read_table as _table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dart_minhash import near_duplicate_classes

    return near_duplicate_classes(_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import repetitions

    return repetitions(_table(spark, sf_dir, "documents"), weights=[1, 2, 3], max_epochs=3.0).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, limit=512)


def op4_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .id_store import store_and_verify

    return store_and_verify(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=2)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import digest, scan

    found = digest(scan(_table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_by_bytes

    out = shard_by_bytes(_table(spark, sf_dir, "documents"), n_shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import duplicate_groups

    return duplicate_groups(_table(spark, sf_dir, "documents"), keep="max")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import Features, score, train

    features = Features(_table(spark, sf_dir, "documents"))
    return score(features, train(features, _table(spark, sf_dir, "labels")))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import encode_digests

    return encode_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical import top_documents

    return top_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_records, resolved, write_warc

    read = resolved(read_records(spark, write_warc(_table(spark, sf_dir, "pages"))))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_middle import fill_in_middle, restored

    made = fill_in_middle(_table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_mixing": op2_mixing,
    "op3_token_counts": op3_token_counts,
    "op4_id_store": op4_id_store,
    "op5_license_scan": op5_license_scan,
    "op6_sharding": op6_sharding,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_ann": op8_ann,
    "op9_quality": op9_quality,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_lexical_search": op11_lexical_search,
    "op12_warc": op12_warc,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLES = {
    "op7_exact_dedup": """
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY norm) AND row_number() OVER (PARTITION BY norm, doc_id) = 1 AS kept, sha256(norm) AS text_sha256
        FROM n""",
    "op11_lexical_search": r"""
        WITH t AS (SELECT doc_id, row_number() OVER () AS row_no, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
        d AS (SELECT * FROM t WHERE len(terms) > 0), s AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        x AS (SELECT row_no, doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
        p AS (SELECT row_no, doc_id, n, term, count(*) AS tf FROM x WHERE term IN (SELECT term FROM q) GROUP BY ALL),
        f AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term),
        i AS (SELECT row_no, doc_id, term, (1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms)) AS impact FROM p, s),
        r AS (SELECT item_id, row_no, doc_id, CAST(sum(w * impact) AS BIGINT) AS score FROM q JOIN f USING (term) JOIN i USING (term) GROUP BY ALL)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= 50""",
    "op12_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages), n AS (SELECT *, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes FROM p),
        r AS (SELECT *, max(page_id) OVER (PARTITION BY t) AS keep, row_number() OVER (PARTITION BY t ORDER BY page_id DESC) = 1 OR payload_bytes < 1000 AS own FROM n)
        SELECT page_id, payload_bytes, sha1(t) AS payload_digest, CASE WHEN own THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN NOT own THEN keep END AS refers_to FROM r""",
    "op13_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
        u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS lines, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
                     CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
        c AS (SELECT *, len(lines) AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS low, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS high FROM u),
        p AS (SELECT *, array_to_string(lines[1:low], '') AS prefix, array_to_string(lines[low + 1:high], '') AS middle, array_to_string(lines[high + 1:], '') AS suffix,
                     CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
        FROM p""",
}
