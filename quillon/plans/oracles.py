"""DuckDB SQL with the rows of the queries of quillon.plans.queries, written apart from them."""

from __future__ import annotations

from .file_oracles import ORACLES as FILE_ORACLES

_ORDERS = """
    bumped AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
                      CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 13 <> 0),
    later AS (SELECT * FROM bumped UNION ALL SELECT o_orderkey + 100000000, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 11 = 0)"""
_MARKS = """
    a AS (SELECT o_orderkey, concat(o_orderstatus, '|', o_custkey) AS head, CAST(trunc(o_totalprice * 100) AS BIGINT) AS body FROM orders),
    b AS (SELECT o_orderkey, concat(o_orderstatus, '|', o_custkey) AS head, CAST(trunc(o_totalprice * 100) AS BIGINT) AS body FROM later)"""
_META = """
    c2 AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 9 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS c_nationkey,
                  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 17 <> 0),
    l AS (SELECT c_custkey, 'c_name' AS key, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer
          UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment FROM customer),
    r AS (SELECT c_custkey, 'c_name' AS key, c_name AS value FROM c2 UNION ALL SELECT c_custkey, 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM c2
          UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment FROM c2),
    d AS (SELECT coalesce(l.c_custkey, r.c_custkey) AS c_custkey, coalesce(l.key, r.key) AS key, l.value AS before, r.value AS after,
                 l.key IS NOT NULL AS in_left, r.key IS NOT NULL AS in_right
          FROM l FULL JOIN r ON l.c_custkey = r.c_custkey AND l.key = r.key
          WHERE l.value IS DISTINCT FROM r.value OR (l.key IS NULL) <> (r.key IS NULL))"""
_RULES = """
    f AS (SELECT 'negative-balance' AS key, 'divergence' AS severity, CAST(c_custkey AS VARCHAR) AS subject, 'balance below zero' AS text FROM customer WHERE c_acctbal < 0
          UNION ALL SELECT 'length-mismatch', 'trace', CAST(doc_id AS VARCHAR), 'stored length differs from the text''s' FROM documents WHERE length(text) <> n_chars
          UNION ALL SELECT 'short-text', 'note', CAST(doc_id AS VARCHAR), 'text of fewer than 100 characters' FROM documents WHERE length(text) < 100
          UNION ALL SELECT 'no-customer', 'divergence', CAST(o_orderkey AS VARCHAR), 'order without a customer' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))"""
_RUNS = """
    runs AS (SELECT conv_id, turn AS run_id, CAST((turn % 4) * 40 AS DOUBLE) AS x0, CAST((turn % 4) * 40 + length(text) % 41 AS DOUBLE) AS x1,
                    CAST(turn // 4 * 20 AS DOUBLE) AS y0, CAST(turn // 4 * 20 + 10 AS DOUBLE) AS y1, text FROM conversations)"""
_NAMED = """
    named AS (SELECT p_partkey, p_size, concat(['ABCDEF+Arial-Bold', 'Times SemiBold Italic', 'Light Sans', 'XYZABC+Georgia Black', 'Plain Oblique', 'Some ExtraLight'][p_partkey % 6 + 1], ' ', p_name) AS name FROM part),
    s AS (SELECT *, regexp_replace(name, '^[A-Z]{6}\\+', '') AS stripped, lower(name) AS low FROM named)"""
_REVISIONS = """
    l AS (SELECT event_id, event_type, lag(event_id) OVER w AS one, lag(event_id, 2) OVER w AS two FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    e AS (SELECT event_id, event_type, CASE WHEN event_id % 997 = 7 THEN -event_id WHEN event_id % 10 = 3 THEN coalesce(two, one) ELSE one END AS prev FROM l)"""
_CIRCULAR = """
    a AS (SELECT o_orderkey AS src, o_orderkey // 10 * 10 + o_custkey % 10 AS dst FROM orders UNION SELECT o_orderkey, o_orderkey // 10 * 10 + CAST(floor(o_totalprice) AS BIGINT) % 10 FROM orders WHERE o_orderkey % 4 = 0),
    r(src, dst) AS (SELECT src, dst FROM a UNION SELECT r.src, a.dst FROM r JOIN a ON a.src = r.dst),
    m AS (SELECT x.src AS node, min(x.dst) AS cycle FROM r x JOIN r y ON y.src = x.dst AND y.dst = x.src GROUP BY x.src)"""

ORACLES = {
    "norm_text": """SELECT doc_id, replace(replace(replace(replace(text, ' ', chr(160)), 'ff', chr(64256)), chr(160), ' '), chr(64256), 'ff') AS plain,
        CAST(length(replace(text, 'ff', chr(64256))) AS INTEGER) AS n_source FROM documents""",
    "find_count": "SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, 'the')), 0) AS BIGINT) AS n FROM documents",
    "find_ignore_case": "SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '(?i)license')), 0) AS BIGINT) AS n FROM documents",
    "find_whole_word": "SELECT doc_id, CAST(coalesce(len(list_filter(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}\\p{Pc}]+'), lambda x: x = 'the')), 0) AS BIGINT) AS n FROM documents",
    "find_page_filter": "SELECT conv_id, turn, CAST(coalesce(len(regexp_extract_all(text, 'th')), 0) AS BIGINT) AS n FROM conversations WHERE turn IN (0, 2)",
    "find_top_docs": """WITH f AS (SELECT lang, doc_id, CAST(len(regexp_extract_all(text, 'e')) AS BIGINT) AS n FROM documents)
        SELECT lang, doc_id, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, doc_id) AS rank, count(*) OVER (PARTITION BY lang) AS total
        FROM f WHERE n > 0 QUALIFY rank <= 10""",
    "replace_swap": "SELECT conv_id, turn, md5(regexp_replace(text, '([a-z]+) ([a-z]+)', '\\2 \\1', 'g')) AS changed FROM conversations",
    "replace_first_n": """WITH n AS (SELECT doc_id, text, coalesce(len(regexp_extract_all(text, 'License')), 0) AS n FROM documents),
        k AS (SELECT *, CAST(greatest(0, least(n, 20 - coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS k FROM n)
        SELECT doc_id, md5(concat(array_to_string(string_split(text, 'License')[:k + 1], 'Licence'), CASE WHEN k < n THEN concat('License', array_to_string(string_split(text, 'License')[k + 2:], 'License')) ELSE '' END)) AS changed, k AS n_replaced FROM k""",
    "replace_marked": """WITH m AS (SELECT doc_id, replace(replace(text, ' ', chr(160)), 'ff', chr(64256)) AS t FROM documents)
        SELECT doc_id, md5(replace(t, concat('of', chr(160), 'the'), 'OF-THE')) AS changed FROM m""",
    "find_grouped": f"""WITH {_RUNS},
        b AS (SELECT *, CAST(round_even(y0 / 2.5, 0) AS BIGINT) AS baseline FROM runs),
        g AS (SELECT *, (x0 - lag(x1) OVER w) / 10.0 AS gap FROM b WINDOW w AS (PARTITION BY conv_id, baseline ORDER BY x0, run_id)),
        i AS (SELECT *, CAST(sum(CASE WHEN gap > 2.5 OR gap < -0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, baseline ORDER BY x0, run_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS line_no FROM g),
        p AS (SELECT *, lag(text) OVER w2 AS before FROM i WINDOW w2 AS (PARTITION BY conv_id, baseline, line_no ORDER BY x0, run_id)),
        t AS (SELECT conv_id, baseline, line_no, string_agg(CASE WHEN before IS NOT NULL AND NOT ends_with(before, ' ') AND gap >= 0.19 THEN ' ' || text ELSE text END, '' ORDER BY x0, run_id) AS text FROM p GROUP BY conv_id, baseline, line_no),
        f AS (SELECT *, regexp_extract_all(text, '\\. ?[A-Z]') AS found FROM t)
        SELECT conv_id, baseline, line_no, CAST(len(found) AS BIGINT) AS n, md5(array_to_string(list_sort(found), '|')) AS matched FROM f WHERE len(found) > 0""",
    "replace_pairs": "SELECT doc_id, md5(nullif(replace(replace(replace(text, 'License', 'Licence'), 'there', 'HERE'), 'the', 'THE'), text)) AS changed FROM documents",
    "splice_edits": "SELECT item_id, concat('<<', substr(text, 2, 3), substr(text, 6)) AS changed FROM benchmark",
    "minimal_edit": """WITH p AS (SELECT a.conv_id, a.turn, a.text AS o, b.text AS n FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 2),
        h AS (SELECT *, length(o) AS lo, length(n) AS ln, len(list_filter(range(1, least(length(o), length(n)) + 1), lambda i: left(o, i) = left(n, i))) AS head FROM p),
        t AS (SELECT *, len(list_filter(range(1, least(lo, ln) - head + 1), lambda i: right(o, i) = right(n, i))) AS tail FROM h),
        e AS (SELECT *, CASE WHEN lo - tail = head AND head > 0 THEN head - 1 ELSE head END AS s, CASE WHEN lo - tail = head AND head = 0 THEN lo - tail + 1 ELSE lo - tail END AS f, CASE WHEN lo - tail = head AND head = 0 THEN tail - 1 ELSE tail END AS k FROM t)
        SELECT conv_id, turn, CASE WHEN o <> n THEN CAST(s AS BIGINT) END AS start, CASE WHEN o <> n THEN CAST(f AS BIGINT) END AS stop, CASE WHEN o <> n THEN md5(substr(n, s + 1, ln - k - s)) END AS replacement FROM e""",
    "glyph_spans": """WITH s AS (SELECT conv_id, turn, length(text) AS n, length(text) % 17 AS a, least(length(text), length(text) % 17 + 4) AS z FROM conversations)
        SELECT conv_id, turn, CASE WHEN z > a THEN CAST(a // 2 AS BIGINT) END AS first, CASE WHEN z > a THEN CAST((z - 1) // 2 + 1 AS BIGINT) END AS after, CASE WHEN z > a THEN a % 2 = 1 OR (z % 2 = 1 AND z < n) END AS expanded FROM s""",
    "greedy_encode": """WITH m AS (SELECT concat(conv_id, ' ', turn) AS "at", unnest(regexp_extract_all(text, '(?s)tion|the|ing|and|th|er|in|.')) AS part FROM conversations)
        SELECT "at", count(*) AS n_parts, count(*) FILTER (WHERE length(part) > 1) AS n_known FROM m GROUP BY "at" """,
    "name_styles": f"""WITH {_NAMED}
        SELECT p_partkey, stripped, regexp_replace(lower(stripped), '[^a-z0-9]', '', 'g') AS name_key, regexp_matches(name, '^[A-Z]{{6}}\\+.') AS subset,
            CAST(CASE WHEN contains(low, 'semibold') THEN 600 WHEN contains(low, 'extralight') THEN 200 WHEN contains(low, 'black') THEN 900 WHEN contains(low, 'bold') THEN 700
                      WHEN contains(low, 'light') THEN 300 ELSE 400 END AS BIGINT) AS weight,
            contains(low, 'bold') OR contains(low, 'black') OR contains(low, 'heavy') AS bold,
            contains(low, 'italic') OR contains(low, 'oblique') OR (p_size & 64) <> 0 AS italic,
            trim(left(regexp_replace(stripped, '[^A-Za-z0-9._-]', '_', 'g'), 60), '_.') AS file_name,
            (p_size & 2) <> 0 OR regexp_matches(regexp_replace(lower(stripped), '[^a-z0-9]', '', 'g'), 'times|serif|georgia|garamond|roman|book|minion|cambria|constantia|palatino|baskerville|caslon|charter|didot|utopia|century|academy') AS serif
        FROM s""",
    "field_names": """SELECT c_custkey, ['/Title', '/ModDate', '/CreationDate', '/Custom', '/Segment', '/Author'][c_custkey % 6 + 1] AS field FROM customer""",
    "page_lists": """WITH p AS (SELECT p_partkey, p_partkey % 7 + 1 AS low, p_partkey % 11 + 1 AS high FROM part),
        x AS (SELECT p_partkey, low - 1 AS page FROM p UNION SELECT p_partkey, unnest(range(high - 1, high + 3)) FROM p UNION SELECT p_partkey, unnest(range(high - 1, low)) FROM p)
        SELECT p_partkey, string_agg(CAST(page AS VARCHAR), ' ' ORDER BY page) AS pages FROM x GROUP BY p_partkey""",
    "assignment_maps": "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN concat('last ', n_name) ELSE n_name END AS title, concat(n_regionkey, '=x') AS changed, CAST(2 AS BIGINT) AS n FROM nation",
    "dates_round_trip": """WITH d AS (SELECT o_orderkey, o_orderkey % 5 AS k, o_orderdate AS t, date_trunc('day', o_orderdate) AS day FROM orders)
        SELECT o_orderkey, CASE k WHEN 0 THEN strftime(t, 'D:%Y%m%d%H%M%S') || '+03''30''' WHEN 1 THEN strftime(t, 'D:%Y%m%d%H%M%S') WHEN 2 THEN strftime(day, 'D:%Y%m%d%H%M%S') WHEN 3 THEN strftime(t, 'D:%Y%m%d%H%M%S') || '+00''00''' END AS packed,
            CASE k WHEN 0 THEN strftime(t, '%Y-%m-%dT%H:%M:%S+03:30') WHEN 1 THEN strftime(t, '%Y-%m-%dT%H:%M:%S') WHEN 2 THEN strftime(day, '%Y-%m-%dT%H:%M:%S') WHEN 3 THEN strftime(t, '%Y-%m-%dT%H:%M:%S+00:00') END AS iso FROM d""",
    "number_scalars": """WITH l AS (SELECT l_orderkey, CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS q, count(*) AS n FROM lineitem GROUP BY l_orderkey)
        SELECT l_orderkey, CAST(20 * q + 2 + n AS BIGINT) AS x, CAST(3 * n + 6 AS BIGINT) AS y, CAST((1 - n % 2) * (1 - q % 2) AS BIGINT) AS red, CAST(0 AS BIGINT) AS blue,
            CASE WHEN abs(q / (n * 25.0) - 1) <= 0.08 THEN 'squeeze' ELSE 'natural' END AS fit, CASE n % 3 WHEN 0 THEN 0 WHEN 1 THEN q ELSE 2 * q END AS shift FROM l""",
    "visual_lines": """WITH g AS (SELECT *, epoch_us(ts) AS "at", coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w > 21600000000, false) AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        i AS (SELECT *, CAST(sum(CAST(brk AS INTEGER)) OVER (PARTITION BY user_id ORDER BY "at", event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM g)
        SELECT user_id, island, count(*) AS n, min("at") AS first_at, max("at") AS last_at, min(event_id) AS first_event FROM i GROUP BY user_id, island""",
    "line_texts": f"""WITH {_RUNS},
        b AS (SELECT *, CAST(round_even(y0 / 2.5, 0) AS BIGINT) AS baseline FROM runs),
        g AS (SELECT *, (x0 - lag(x1) OVER w) / 10.0 AS gap, lag(text) OVER w AS before FROM b WINDOW w AS (PARTITION BY conv_id, baseline ORDER BY x0, run_id)),
        i AS (SELECT *, CAST(sum(CASE WHEN gap > 2.5 OR gap < -0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, baseline ORDER BY x0, run_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS line_no FROM g),
        p AS (SELECT *, lag(text) OVER w2 AS inner_before FROM i WINDOW w2 AS (PARTITION BY conv_id, baseline, line_no ORDER BY x0, run_id))
        SELECT conv_id, baseline, line_no, string_agg(CASE WHEN inner_before IS NOT NULL AND NOT ends_with(inner_before, ' ') AND gap >= 0.19 THEN ' ' || text ELSE text END, '' ORDER BY x0, run_id) AS text,
            CAST(min(x0) AS BIGINT) AS x0, CAST(max(x1) AS BIGINT) AS x1, CAST(min(y0) AS BIGINT) AS y0, CAST(max(y1) AS BIGINT) AS y1 FROM p GROUP BY conv_id, baseline, line_no""",
    "consecutive_ranges": """WITH k AS (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem),
        r AS (SELECT *, l_orderkey - row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS run FROM k)
        SELECT l_suppkey, min(l_orderkey) AS first_key, max(l_orderkey) AS last_key, count(*) AS n FROM r GROUP BY l_suppkey, run""",
    "carry_forward": """SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS last_purchase FROM events""",
    "page_text": """SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn, role, text)) AS digest, CAST(length(string_agg(text, chr(10) ORDER BY turn, role, text)) AS BIGINT) AS n FROM conversations GROUP BY conv_id""",
    "block_alignment": """WITH l AS (SELECT l_partkey, CAST((l_suppkey % 2) * (l_partkey % 3) AS DOUBLE) AS x0, 100.0 + (l_linenumber % 2) * (l_partkey % 2) AS x1 FROM lineitem),
        s AS (SELECT l_partkey, count(*) AS n, max(x0) - min(x0) AS sl, max(x1) - min(x1) AS sr, max((x0 + x1) / 2) - min((x0 + x1) / 2) AS sc FROM l GROUP BY l_partkey)
        SELECT l_partkey, n, CASE WHEN n < 2 THEN NULL WHEN sl <= 0.6 AND sl <= sr AND sl <= sc AND least(sr, sc) - sl >= 0.5 THEN 'left' WHEN sr <= 0.6 AND sr < sl AND sr <= sc AND least(sl, sc) - sr >= 0.5 THEN 'right'
            WHEN sc <= 0.6 AND sc < sl AND sc < sr AND least(sl, sr) - sc >= 0.5 THEN 'center' END AS alignment FROM s""",
    "object_hash_diff": f"""WITH {_ORDERS}, {_MARKS}
        SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'removed' WHEN a.o_orderkey IS NULL THEN 'added' WHEN a.head = b.head AND a.body = b.body THEN 'identical'
            WHEN a.body = b.body THEN 'changed head' WHEN a.head = b.head THEN 'changed body' ELSE 'changed both' END AS status FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey""",
    "changed_objects": f"""WITH {_ORDERS}, {_MARKS}
        SELECT b.o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' ELSE 'rewritten' END AS change FROM b LEFT JOIN a ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR a.body <> b.body""",
    "set_changes": f"""WITH {_ORDERS}
        SELECT o_orderkey, 'vanished' AS side FROM (SELECT o_orderkey FROM orders EXCEPT SELECT o_orderkey FROM later) UNION ALL SELECT o_orderkey, 'new' FROM (SELECT o_orderkey FROM later EXCEPT SELECT o_orderkey FROM orders)""",
    "meta_diff": f"WITH {_META} SELECT * FROM d",
    "expected_partition": f"WITH {_META} SELECT key, key IN ('c_nationkey', 'c_acctbal') AS expected, count(*) AS n FROM d GROUP BY ALL",
    "inherited_introduced": f"""WITH {_ORDERS}, o AS (SELECT DISTINCT o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 200000), n AS (SELECT DISTINCT o_custkey, o_orderstatus FROM later WHERE o_totalprice > 200000)
        SELECT n.*, CASE WHEN o.o_custkey IS NULL THEN 'introduced' ELSE 'inherited' END AS origin FROM n LEFT JOIN o USING (o_custkey, o_orderstatus)""",
    "structure_diff": """WITH p AS (SELECT event_id, json_extract_string(props, '$.k') AS v FROM events WHERE event_id % 10 = 0)
        SELECT event_id, '$.k' AS path, 'vanished' AS status, v AS before, CAST(NULL AS VARCHAR) AS after FROM p UNION ALL SELECT event_id, '$.other', 'added', NULL, v FROM p""",
    "ranked_candidates": """WITH p AS (SELECT *, CAST(round(p_retailprice * 100) AS BIGINT) AS cents FROM part),
        j AS (SELECT a.p_partkey, b.p_partkey AS candidate, CASE WHEN a.p_type = b.p_type AND a.p_size = b.p_size THEN 0 WHEN a.p_type = b.p_type THEN 1 WHEN a.p_size = b.p_size THEN 2 END AS bucket, abs(a.cents - b.cents) AS d
              FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_partkey <> b.p_partkey)
        SELECT p_partkey, candidate, CAST(bucket AS BIGINT) AS bucket FROM j WHERE bucket IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY bucket, d, candidate) = 1""",
    "charset_covers": "SELECT n_nationkey, regexp_full_match(n_name, '[A-Z_0-9]*') AS covered FROM nation",
    "nearest_line": """WITH o AS (SELECT o_custkey, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)
        SELECT a.o_orderkey AS point, b.o_orderkey AS band FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND b.o_orderkey <> a.o_orderkey AND a.cents BETWEEN b.cents - 2000000 AND b.cents + 2000000
        QUALIFY row_number() OVER (PARTITION BY a.o_orderkey ORDER BY abs(a.cents - b.cents), b.o_orderkey) = 1""",
    "majority_style": """WITH c AS (SELECT l_suppkey, l_returnflag, count(*) AS votes FROM lineitem GROUP BY ALL)
        SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY votes DESC, CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END, l_returnflag) = 1""",
    "reverse_map": """SELECT c_nationkey, c_mktsegment, coalesce(min(c_custkey) FILTER (WHERE c_acctbal >= 0), min(c_custkey)) AS c_custkey FROM customer GROUP BY ALL""",
    "free_codes": """WITH u AS (SELECT DISTINCT s_nationkey, s_suppkey % 60 + 32 AS code FROM supplier), w AS (SELECT c_nationkey AS s_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer WHERE c_acctbal < 0),
        f AS (SELECT s_nationkey, code, row_number() OVER (PARTITION BY s_nationkey ORDER BY code) AS k FROM (SELECT DISTINCT s_nationkey, unnest(range(32, 256)) AS code FROM w) x WHERE (s_nationkey, code) NOT IN (SELECT s_nationkey, code FROM u))
        SELECT w.s_nationkey, c_custkey, CAST(code AS BIGINT) AS code FROM w LEFT JOIN f USING (s_nationkey, k)""",
    "minority_rows": """WITH c AS (SELECT o_custkey, o_orderkey, o_orderstatus = 'F' AS kind, count(*) OVER (PARTITION BY o_custkey) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS y FROM orders)
        SELECT o_custkey, o_orderkey FROM c WHERE n >= 4 AND y > 0 AND y < n AND CASE WHEN y < n - y THEN kind ELSE NOT kind END""",
    "top_findings": f"WITH {_RULES} SELECT *, row_number() OVER (PARTITION BY key ORDER BY subject, text) AS rank, count(*) OVER (PARTITION BY key) AS total FROM f QUALIFY rank <= 12",
    "rule_outcomes": f"""WITH {_RULES}, r(key, severity) AS (VALUES ('negative-balance', 'divergence'), ('length-mismatch', 'trace'), ('short-text', 'note'), ('no-customer', 'divergence'))
        SELECT r.key, r.severity, count(f.key) AS n, count(f.key) = 0 AS passed FROM r LEFT JOIN f ON f.key = r.key GROUP BY r.key, r.severity""",
    "atomic_groups": """WITH g AS (SELECT l_orderkey, CASE WHEN l_orderkey % 4 = 0 THEN l_quantity > 45 ELSE bool_or(l_quantity > 45) OVER (PARTITION BY l_orderkey) END AS refused FROM lineitem)
        SELECT l_orderkey, count(*) FILTER (WHERE NOT refused) AS applied, count(*) FILTER (WHERE refused) AS refused FROM g GROUP BY l_orderkey""",
    "edit_reasons": """SELECT CASE WHEN l_suppkey % 50 = 0 THEN 'no such run' WHEN l_linenumber < 0 OR l_linenumber >= l_partkey % 9 OR l_partkey % 9 > 7 THEN 'range outside the run' END AS reason, count(*) AS n FROM lineitem GROUP BY ALL""",
    "edit_pieces": """WITH p AS (SELECT l_orderkey, l_suppkey % 5 AS run, min(l_linenumber - 2) AS s, max(l_linenumber - 2) + 1 AS e FROM lineitem WHERE l_linenumber >= 2 GROUP BY ALL)
        SELECT l_orderkey, count(*) AS n_pieces, min(s) AS first_at, max(e) AS after, count(*) - 1 AS n_later, CAST(CASE WHEN count(*) = 1 THEN 1 ELSE 0 END AS BIGINT) AS n_alone FROM p GROUP BY l_orderkey""",
    "latest_revision": """SELECT user_id, epoch_us(ts) AS "at", event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "merge_metadata": """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new ' || c_mktsegment ELSE c_mktsegment END AS value FROM customer WHERE c_custkey % 3 <> 0 OR (c_custkey % 2 = 0 AND c_mktsegment IS NOT NULL)
        UNION ALL SELECT c_custkey + 1000000, 'added' FROM customer WHERE c_custkey % 50 = 0""",
    "in_place_routes": """SELECT CASE WHEN reason IS NULL THEN 'in_place' ELSE 'deferred' END AS route, reason, count(*) AS n FROM (SELECT CASE WHEN l_returnflag = 'R' THEN 'not in the original' WHEN l_quantity > 40 THEN 'does not fit'
        WHEN l_linestatus = 'F' THEN 'filter not supported' END AS reason FROM lineitem) x GROUP BY ALL""",
    "reachability": """SELECT 'r1' AS node, CAST(0 AS BIGINT) AS depth UNION ALL SELECT concat('n', n_nationkey), 1 FROM nation WHERE n_regionkey = 1
        UNION ALL SELECT concat('s', s_suppkey), 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1""",
    "dangling_edges": "SELECT o_orderkey AS src, o_custkey AS dst FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)",
    "stale_copies": """SELECT doc_id, CAST(e.edit_id AS BIGINT) AS edit_id FROM documents JOIN (VALUES (0, 'License, Version'), (1, 'MIT License'), (2, 'Public License'), (3, 'no such text'), (4, 'the the')) e(edit_id, old) ON contains(text, old)""",
    "hidden_copies": """SELECT a.conv_id, a.turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 2
        WHERE length(trim(b.text)) > 0 AND NOT contains(a.text, trim(b.text))""",
    "planted_copies": """WITH p AS (SELECT conv_id, turn, text, CASE WHEN conv_id % 3 = 0 THEN concat('  ', substr(text, 5, 40), ' ') WHEN conv_id % 5 = 0 THEN upper(substr(text, 5, 40)) ELSE lag(text) OVER (PARTITION BY conv_id ORDER BY turn) END AS copy FROM conversations)
        SELECT conv_id, turn FROM p WHERE length(trim(copy, ' ')) > 0 AND NOT contains(text, trim(copy, ' '))""",
    "page_list_errors": """WITH p AS (SELECT p_partkey, p_partkey % 7 AS k, p_size % 5 AS page FROM part)
        SELECT p_partkey, CASE k WHEN 1 THEN '' WHEN 4 THEN '0 1 2' END AS pages, CASE k WHEN 2 THEN 'no page or range: a' WHEN 3 THEN 'out of range: 99' WHEN 5 THEN 'no page or range: 1-x' END AS error,
            CASE k WHEN 0 THEN true WHEN 4 THEN page < 3 ELSE false END AS asked_for FROM (SELECT p_partkey, CASE WHEN k = 6 THEN 1 ELSE k END AS k, page FROM p) x""",
    "metadata_names": "SELECT c_custkey, ['/Title', '/Author', '/CreationDate', '/Custom', '/Market segment', '/Keywords'][c_custkey % 6 + 1] AS field FROM customer",
    "short_numbers": """WITH t AS (SELECT *, concat(p_name, ' ', p_type, ' ', p_brand) AS s FROM part)
        SELECT p_partkey, CASE WHEN length(s) > 20 THEN concat(left(s, 17), '...') ELSE s END AS note, round_even(p_retailprice / 8, 3) AS clean, CASE WHEN p_partkey % 3 = 0 THEN 0.0 ELSE round_even(p_size * 1000.0::DOUBLE / ((p_partkey % 3) * 1024.0::DOUBLE), 2) END AS width FROM t""",
    "required_characters": """WITH c AS (SELECT DISTINCT lang, unnest(string_split(text, '')) AS c FROM documents)
        SELECT lang, count(*) AS n, count(*) FILTER (WHERE NOT regexp_matches(c, '^[a-zA-Z]$')) AS n_lacking FROM c WHERE c <> '' GROUP BY lang""",
    "code_widths": """WITH l AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey)
        SELECT l_suppkey AS s_suppkey, n, coalesce(CASE WHEN s_acctbal > 5000 THEN CAST(floor(s_acctbal) AS BIGINT) END, CASE WHEN n_regionkey < 3 THEN CAST(n_regionkey AS BIGINT) END, 500) AS width FROM l LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey""",
    "object_roles": """WITH k AS (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders)
        SELECT k.c_custkey, CASE WHEN c_acctbal < 0 THEN 'debtor' WHEN k.c_custkey IN (SELECT o_custkey FROM orders) THEN 'buyer' ELSE 'customer' END AS role FROM k LEFT JOIN customer USING (c_custkey)""",
    "container_changes": f"""WITH {_ORDERS},
        a AS (SELECT o_orderkey, CAST(trunc(o_totalprice * 100) AS BIGINT) AS s, o_orderstatus AS v FROM orders), b AS (SELECT o_orderkey, CAST(trunc(o_totalprice * 100) AS BIGINT) AS s, o_orderstatus AS v FROM later),
        f AS (SELECT 'file-size' AS key, 'note' AS severity, concat(a.s, ' bytes became ', b.s) AS text FROM a JOIN b USING (o_orderkey) WHERE a.s <> b.s
              UNION ALL SELECT 'xref-style', 'trace', 'the style of the cross-reference table changed' FROM a JOIN b USING (o_orderkey) WHERE (a.v = 'F') <> (b.v = 'F')
              UNION ALL SELECT 'version', 'trace', concat('version ', a.v, ' became ', b.v) FROM a JOIN b USING (o_orderkey) WHERE a.v IS DISTINCT FROM b.v)
        SELECT key, severity, count(*) AS n, md5(string_agg(text, '|' ORDER BY text)) AS texts FROM f GROUP BY key, severity""",
    "external_risks": """WITH p AS (SELECT CAST(c_custkey AS VARCHAR) AS path, * FROM customer), o AS (SELECT CAST(o_custkey AS VARCHAR) AS path, * FROM orders),
        r AS (SELECT 'encrypted' AS key, path, 'encrypted' AS text FROM p WHERE c_custkey % 50 = 0 UNION ALL SELECT 'no-xmp', path, 'no xmp' FROM p WHERE c_custkey % 3 = 0 UNION ALL SELECT 'no-pdfaid', path, 'no pdfaid' FROM p WHERE c_custkey % 5 <> 0
              UNION ALL SELECT 'no-output-intent', path, 'no output intent' FROM p WHERE c_custkey % 7 <> 0 UNION ALL SELECT 'no-id', path, 'no id' FROM p WHERE NOT c_acctbal > 0 UNION ALL SELECT 'revisions', path, 'revisions' FROM p WHERE c_nationkey % 3 > 1
              UNION ALL SELECT 'fonts-not-embedded', path, concat(array_to_string(list_sort(list(DISTINCT o_orderpriority))[:5], ', '), CASE WHEN count(DISTINCT o_orderpriority) > 5 THEN concat(' and ', count(DISTINCT o_orderpriority) - 5, ' more') ELSE '' END) FROM o WHERE o_orderstatus = 'P' GROUP BY path
              UNION ALL SELECT 'fonts-no-tounicode', path, array_to_string(list_sort(list(DISTINCT o_orderpriority))[:5], ', ') FROM o WHERE o_orderkey % 4 = 0 GROUP BY path
              UNION ALL SELECT DISTINCT 'transparency', path, 'transparency' FROM o WHERE o_orderkey % 9 = 0)
        SELECT key, 'divergence' AS severity, path AS subject, text FROM r""",
    "signature_coverage": """SELECT CAST(l_orderkey AS VARCHAR) AS subject, count(*) AS n, min(concat('the signature ', l_linenumber, ' does not cover the whole file')) AS first FROM lineitem WHERE l_partkey + l_suppkey < 1500 OR l_partkey + l_suppkey <= 0 GROUP BY l_orderkey""",
    "width_mismatches": "SELECT p_brand AS subject, concat('code ', p_partkey, ': stated and own width differ') AS text FROM part WHERE p_partkey % 4 = 3 AND p_size % 10 <> 0",
    "orphan_glyphs": """WITH r AS (SELECT DISTINCT p_brand, p_partkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity >= 50 AND l_linenumber < 4), x AS (SELECT * FROM r UNION SELECT p_brand, p_partkey + 10 FROM r)
        SELECT p_brand AS subject, concat('glyph ', p_partkey, ' is reached by nothing') AS text FROM part WHERE p_partkey <> 0 AND p_size % 5 > 0 AND (p_brand, p_partkey) NOT IN (SELECT p_brand, p_partkey FROM x)""",
    "dictionary_changes": f"""WITH {_META}, e AS (SELECT c_custkey, replace(replace(replace(key, 'c_name', '/Name'), 'c_nationkey', '/Nation'), 'c_mktsegment', '/Segment') AS entry, before, after FROM d WHERE before IS DISTINCT FROM after)
        SELECT c_custkey, entry, CASE WHEN after IS NULL THEN 'vanished' WHEN before IS NULL THEN 'added' ELSE 'changed' END AS change, before, after FROM e""",
    "code_maps": """WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS path, p_partkey, p_size FROM part)
        SELECT path, CAST(p_size AS BIGINT) AS code, chr(CAST(p_partkey % 26 + 65 AS INTEGER)) AS text FROM p UNION ALL SELECT path, p_size + 100 + i, chr(CAST(65 + i AS INTEGER)) FROM p, range(3) r(i) UNION ALL SELECT path, p_size + 200 + i, chr(CAST(97 + i AS INTEGER)) FROM p, range(2) r(i)""",
    "instructions": """WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS path, p_size, p_brand, length(p_size::VARCHAR) AS w, length(p_brand) AS b FROM part)
        SELECT path, CAST(0 AS BIGINT) AS op_index, 'BT' AS operator, '[]' AS operands, CAST(2 AS BIGINT) AS stop FROM p UNION ALL SELECT path, 1, 'Tf', concat('["/F1", ', p_size, ']'), 7 + w + 3 FROM p
        UNION ALL SELECT path, 2, 'Tj', concat('["6129', lower(hex(p_brand)), '"]'), 7 + w + 3 + 8 + 4 + b + 1 + 3 FROM p UNION ALL SELECT path, 3, 'TJ', '[["78", -20, "41"]]', 7 + w + 3 + 8 + 4 + b + 1 + 3 + 18 FROM p UNION ALL SELECT path, 4, 'ET', '[]', 7 + w + 3 + 8 + 4 + b + 1 + 3 + 18 + 3 FROM p""",
    "raw_streams": """SELECT CAST(p_partkey AS VARCHAR) AS path, CAST(1 AS BIGINT) AS num, CAST(length(p_name) AS BIGINT) AS length, sha256(p_name) AS digest FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 2, length(p_brand), sha256(p_brand) FROM part""",
    "shown_runs": """WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS path, p_size AS x, p_brand FROM part)
        SELECT path, CAST(1 AS BIGINT) AS run_id, p_brand AS text, CAST(x AS BIGINT) AS x0, CAST(x + 5 * length(p_brand) AS BIGINT) AS x1, CAST(700 AS BIGINT) AS y0, CAST(length(p_brand) AS BIGINT) AS n_glyphs FROM p
        UNION ALL SELECT path, 2, 'a b', x, x + 13, 680, 2 FROM p UNION ALL SELECT path, 3, 'c', x + 43, x + 48, 680, 1 FROM p""",
    "norm_positions": """WITH m AS (SELECT item_id, replace(text, 'ff', chr(64256)) AS m FROM benchmark), s AS (SELECT *, string_split(m, chr(64256)) AS parts FROM m)
        SELECT item_id, CAST(length(m) + len(parts) - 1 AS INTEGER) AS n, CAST(length(m) - 1 AS INTEGER) AS last, CAST(length(m) * (length(m) - 1) // 2 + coalesce(list_sum(list_transform(range(1, len(parts)), lambda k: length(array_to_string(parts[1:k], '.')))), 0) AS BIGINT) AS total FROM s""",
    "find_offsets": """WITH s AS (SELECT doc_id, text, string_split(translate(text, 'LICENSE', 'license'), 'license') AS parts FROM documents), k AS (SELECT *, unnest(range(1, len(parts))) AS k FROM s),
        a AS (SELECT *, length(array_to_string(parts[1:k], 'license')) AS pos FROM k)
        SELECT doc_id, CAST(k - 1 AS INTEGER) AS match_no, CAST(pos AS INTEGER) AS start, CAST(pos + 7 AS INTEGER) AS "end", substring(text, pos + 1, 7) AS matched FROM a""",
    "replacement_plan": """WITH s AS (SELECT doc_id, string_split(text, 'License') AS parts FROM documents), k AS (SELECT *, unnest(range(1, len(parts))) AS k FROM s), a AS (SELECT *, length(array_to_string(parts[1:k], 'License')) AS pos FROM k)
        SELECT doc_id, CAST(k - 1 AS INTEGER) AS match_no, CAST(pos AS INTEGER) AS start, CAST(pos + 7 AS INTEGER) AS "end", 'License' AS matched, 'Licence' AS new_text FROM a ORDER BY doc_id, k LIMIT 50""",
    "editable_runs": "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linenumber % 3 > 0 AND l_returnflag <> 'R' GROUP BY l_orderkey",
    "codes_in_use": "SELECT l_suppkey, array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS codes FROM lineitem GROUP BY l_suppkey",
    "known_glyphs": """WITH u AS (SELECT DISTINCT p_brand, p_size FROM part WHERE p_partkey % 3 = 0 AND p_brand NOT LIKE '%5')
        SELECT p_brand AS font, p_partkey AS code, p_partkey % 5 = 0 OR p_brand NOT IN (SELECT p_brand FROM u) OR (p_brand, p_size) IN (SELECT p_brand, p_size FROM u) AS has_glyph FROM part""",
    "missing_characters": """SELECT doc_id, regexp_extract(coalesce(text, ''), '[^a-zA-Z \n]') AS first, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[^a-zA-Z \n]'))), ''), '') AS missing FROM documents""",
    "note_severities": """WITH n AS (SELECT o_custkey, o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'file is damaged' WHEN 1 THEN concat('expected endstream, ', o_orderpriority) ELSE concat('odd spacing ', o_orderstatus) END AS t FROM orders),
        s AS (SELECT o_custkey, o_orderkey, CASE WHEN length(t) > 30 THEN concat(left(t, 27), '...') ELSE t END AS note FROM n)
        SELECT o_custkey, note, min(o_orderkey) AS o_orderkey, CASE WHEN note LIKE 'odd%' THEN 'warning' ELSE 'error' END AS severity FROM s GROUP BY o_custkey, note""",
    "overall_outcome": f"WITH {_RULES} SELECT CAST(4 AS BIGINT) AS n_rules, count(*) AS n_findings, count(*) FILTER (WHERE key IN ('negative-balance', 'no-customer')) = 0 AS valid, count(*) = 0 AS clean FROM f",
    "line_shifts": "SELECT l_suppkey, l_linenumber, CAST(sum(l_partkey % 3) AS DOUBLE) AS shift FROM lineitem GROUP BY l_suppkey, l_linenumber",
    "reading_order": """SELECT l_orderkey, string_agg(l_partkey::VARCHAR, chr(10) ORDER BY -round_even(floor(l_quantity) + l_linenumber * 0.25::DOUBLE, 1), round_even(l_linenumber * 0.25::DOUBLE, 1), l_suppkey, l_partkey::VARCHAR) AS text FROM lineitem GROUP BY l_orderkey""",
    "line_hints": """WITH t AS (SELECT concat(conv_id, ' ', turn) AS pos, regexp_replace(text, '( [^ ]* [^ ]* [^ ]*) ', '\\1' || chr(10), 'g') AS text FROM conversations), j AS (SELECT pos, text, replace(text, chr(10), ' ') AS joined FROM t),
        h AS (SELECT pos, s FROM j, (VALUES ('of the'), ('e s')) v(s) WHERE NOT contains(text, s) AND contains(joined, s))
        SELECT pos AS "at", count(*) AS n FROM h GROUP BY pos""",
    "summary_digests": """WITH d AS (SELECT o_custkey, sha256(concat(o_orderkey, chr(31), o_orderstatus, chr(31), o_orderpriority)) AS d FROM orders) SELECT o_custkey, sha256(string_agg(d, '' ORDER BY d)) AS digest FROM d GROUP BY o_custkey""",
    "common_order": """WITH a AS (SELECT o_custkey, o_orderpriority AS p, min(o_orderkey) FILTER (WHERE o_orderkey % 2 = 0) AS x, min(o_orderkey) FILTER (WHERE o_orderkey % 2 = 1) AS y FROM orders GROUP BY ALL),
        b AS (SELECT o_custkey, count(x) AS nx, count(y) AS ny, coalesce(list(p ORDER BY x) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL), []) = coalesce(list(p ORDER BY y) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL), []) AS same FROM a GROUP BY o_custkey)
        SELECT o_custkey, same FROM b WHERE nx > 0 AND ny > 0""",
    "fallback_choice": """WITH f AS (SELECT p_partkey AS ord, CASE p_brand WHEN 'Brand#7' THEN 1 WHEN 'Brand#3' THEN 2 ELSE 3 END AS rank, p_size % 2 = 0 AS bold, p_partkey % 3 = 0 AS italic, (p_size % 9 + 1) * 100 AS weight FROM part),
        c AS (SELECT * FROM f WHERE NOT (bold AND italic)), s AS (SELECT s_suppkey, s_nationkey % 2 = 0 AS bold, s_suppkey % 3 = 0 AS italic, (s_suppkey % 9 + 1) * 100 AS weight FROM supplier)
        SELECT s_suppkey, coalesce((SELECT c.ord FROM c WHERE c.bold = s.bold AND c.italic = s.italic ORDER BY c.rank, abs(c.weight - s.weight), c.ord LIMIT 1), (SELECT c.ord FROM c ORDER BY c.rank, c.ord LIMIT 1)) AS ord FROM s""",
    "reachable_glyphs": "SELECT p_brand AS font, p_partkey AS gid FROM part WHERE p_size < 10 OR p_partkey % 7 = 0 OR p_brand LIKE '%5'",
    "composite_glyphs": """WITH RECURSIVE r(node, depth) AS (SELECT s_suppkey, CAST(0 AS BIGINT) FROM supplier WHERE s_suppkey IN (1, 7) UNION SELECT s_suppkey, depth + 1 FROM r, (VALUES (2), (3)) v(k), supplier WHERE s_suppkey = node * k)
        SELECT node, min(depth) AS depth FROM r GROUP BY node""",
    "apply_edits": """WITH RECURSIVE runs AS (SELECT o_orderkey AS run_id, concat_ws(' ', o_orderpriority, o_custkey, strftime(o_orderdate, '%Y-%m-%d'), o_orderstatus) AS text, o_orderstatus <> 'P' AS editable, o_orderkey % 6 = 0 AS whole, o_orderkey % 3 = 0 AS poor FROM orders),
        li AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_suppkey) AS s, min(l_quantity) AS q FROM lineitem GROUP BY ALL),
        e AS (SELECT l_orderkey * 10 + l_linenumber AS edit_id, CASE WHEN l_orderkey % 97 = 0 THEN -l_orderkey - 1 ELSE l_orderkey END AS run_id, l_linenumber * 3 + p % 3 - 1 AS a, l_linenumber * 3 + p % 3 + s % 3 AS z,
                     CASE WHEN q > 48 THEN 'Zürich' ELSE concat('n', p % 100) END AS new_text, CASE WHEN p % 4 = 0 THEN p * 10 + l_linenumber ELSE 0 END AS grp FROM li),
        v AS (SELECT e.*, coalesce(whole, false) AS whole, CASE WHEN r.run_id IS NULL THEN 'no such run' WHEN NOT editable THEN 'the run can''t be edited' WHEN a < 0 OR a >= z OR z > length(text) THEN 'range outside the run'
                     WHEN poor AND new_text = 'Zürich' THEN 'no glyphs for: Zü' END AS own FROM e LEFT JOIN runs r ON r.run_id = e.run_id),
        o AS (SELECT *, CASE WHEN own IS NULL AND max(CASE WHEN own IS NULL THEN z END) OVER (PARTITION BY run_id ORDER BY a, edit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > a THEN 'overlaps an earlier edit' ELSE own END AS reason FROM v),
        n AS (SELECT *, CASE WHEN whole THEN 'r' || run_id END AS rn, CASE WHEN grp <> 0 THEN 'g' || grp END AS gn FROM o),
        links AS (SELECT rn AS x, gn AS y FROM n WHERE rn IS NOT NULL AND gn IS NOT NULL UNION SELECT gn, rn FROM n WHERE rn IS NOT NULL AND gn IS NOT NULL),
        bad(edit_id, node) AS (SELECT edit_id, coalesce(rn, gn) FROM n WHERE reason IS NOT NULL AND coalesce(rn, gn) IS NOT NULL UNION SELECT bad.edit_id, y FROM bad JOIN links ON x = bad.node),
        c AS (SELECT node, min(edit_id) AS cause FROM bad GROUP BY node),
        t AS (SELECT n.*, coalesce(c.cause, CASE WHEN reason IS NOT NULL THEN n.edit_id END) AS cause FROM n LEFT JOIN c ON c.node = coalesce(rn, gn)),
        g AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY run_id ORDER BY a), 0) AS before, lead(a) OVER (PARTITION BY run_id ORDER BY a) AS later FROM t WHERE cause IS NULL),
        f AS (SELECT g.run_id, string_agg(concat(substr(text, CAST(before + 1 AS BIGINT), CAST(a - before AS BIGINT)), new_text, CASE WHEN later IS NULL THEN substr(text, CAST(z + 1 AS BIGINT)) ELSE '' END), '' ORDER BY a) AS text, count(*) AS n_applied FROM g JOIN runs ON runs.run_id = g.run_id GROUP BY g.run_id)
        SELECT t.run_id, edit_id, cause IS NULL AS applied, reason, cause, f.text, n_applied FROM t LEFT JOIN f ON f.run_id = t.run_id""",
    "stale_passages": "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE length(b.text) > 0",
    "donor_choice": """WITH f AS (SELECT p_partkey AS ord, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS ps, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS fam, p_size % 2 = 0 AS bold, p_partkey % 3 = 0 AS italic, (p_size % 9 + 1) * 100 AS weight,
                     CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE 1 END AS later, lower(concat(p_name, p_type)) AS has FROM part),
        q AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'smallring' WHEN 1 THEN concat('brand', c_custkey % 25, 'bold') WHEN 2 THEN ['ring', 'widget', 'red', 'zzz', ''][c_custkey % 5 + 1] ELSE concat('thebrand', c_custkey % 30, 'extra') END AS target,
                     CASE c_custkey % 4 WHEN 0 THEN 'small' WHEN 1 THEN concat('brand', c_custkey % 25) WHEN 2 THEN ['ring', 'widget', 'red', 'zzz', ''][c_custkey % 5 + 1] ELSE concat('thebrand', c_custkey % 30, 'extra') END AS stem,
                     c_nationkey % 2 = 0 AS bold, c_custkey % 3 = 0 AS italic, (c_custkey % 9 + 1) * 100 AS weight, lower(left(c_mktsegment, 3)) AS need FROM customer),
        j AS (SELECT c_custkey, ord, later, abs(f.weight - q.weight) AS far, q.bold = f.bold AND q.italic = f.italic AS style, ps = target AS same, fam = stem AS family, contains(ps, target) OR contains(target, fam) AS fuzzy
              FROM q JOIN f ON (ps = target OR fam = stem OR contains(ps, target) OR contains(target, fam)) AND target <> '' AND contains(has, need[1]) AND contains(has, need[2]) AND contains(has, need[3])),
        b AS (SELECT *, CASE WHEN same THEN 0 WHEN family AND style THEN 1 WHEN family THEN 2 WHEN fuzzy AND style THEN 3 ELSE 4 END AS bucket FROM j)
        SELECT c_custkey AS request_id, ord, CAST(bucket AS BIGINT) AS bucket FROM b QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY later, bucket, far, ord) = 1""",
    "revision_chains": f"""WITH RECURSIVE {_REVISIONS},
        r(event_id, root, depth, missing) AS (SELECT event_id, CASE WHEN prev IS NULL THEN event_id END, CASE WHEN prev IS NULL THEN 0 END, CASE WHEN prev < 0 THEN prev END FROM e WHERE prev IS NULL OR prev < 0
            UNION ALL SELECT e.event_id, r.root, r.depth + 1, r.missing FROM e JOIN r ON e.prev = r.event_id)
        SELECT event_id, root, CAST(depth AS BIGINT) AS depth, missing FROM r""",
    "as_of_revision": f"""WITH RECURSIVE {_REVISIONS},
        h(tip, event_id, steps) AS (SELECT event_id, event_id, 0 FROM e WHERE event_id % 100 = 99 UNION ALL SELECT h.tip, e.prev, h.steps + 1 FROM h JOIN e ON e.event_id = h.event_id WHERE e.prev >= 0),
        s AS (SELECT tip, event_type, event_id FROM h JOIN e USING (event_id) QUALIFY row_number() OVER (PARTITION BY tip, event_type ORDER BY steps) = 1)
        SELECT * FROM s WHERE event_id % 9 <> 0""",
    "cycle_members": f"WITH RECURSIVE {_CIRCULAR} SELECT node, cycle, concat(count(*) OVER (PARTITION BY cycle), ' nodes lead back to themselves') AS text FROM m",
    "same_dictionaries": f"WITH {_META} SELECT c.c_custkey, c2.c_custkey IS NOT NULL AND c.c_mktsegment IS NOT DISTINCT FROM c2.c_mktsegment AND c.c_name = c2.c_name AS same FROM customer c LEFT JOIN c2 ON c2.c_custkey = c.c_custkey",
    "expected_additions": f"""WITH {_META}, p AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '/Resources/Font/' ELSE '/Resources/XObject/' END || CASE key WHEN 'c_mktsegment' THEN 'F1' ELSE 'W[0]' END AS path, before AS now, after AS old FROM d WHERE key <> 'c_name')
        SELECT c_custkey, path, CASE WHEN old IS NULL THEN 'added' ELSE 'changed' END AS change, path LIKE '%W[0]' OR (old IS NULL AND path LIKE '%/Font/%') AS expected FROM p WHERE now IS DISTINCT FROM old""",
    "nested_diff": """WITH d AS (SELECT event_id, concat('{"k":', json_extract_string(props, '$.k'), ',"who":{"user":', user_id, ',"type":"') AS head, event_type, '","odd name":[]},"tags":[' AS mid, event_id % 4 AS v FROM events),
        b AS (SELECT *, concat(head, event_type, mid, '"a","b",{"v":', v, '}],"none":null}') AS before FROM d),
        p AS (SELECT *, CASE WHEN event_id % 3 > 0 THEN before ELSE concat(head, CASE WHEN event_id % 2 = 0 THEN 'other' ELSE event_type END, mid, CASE event_id % 7 WHEN 0 THEN '"new","a","b",{"v":"' WHEN 1 THEN '"a","b",{"v":"' ELSE '"a","b",{"w":"' END, v, CASE WHEN event_id % 5 = 0 THEN '"}]}' ELSE '"}],"none":[null]}' END) END AS after FROM b),
        n AS (SELECT event_id, 1 AS side, t.fullkey AS path, t.type AS kind, t.value AS value FROM p, json_tree(p.before) t UNION ALL SELECT event_id, 2, t.fullkey, t.type, t.value FROM p, json_tree(p.after) t),
        f AS (SELECT event_id, side, replace(path, '."odd name"', '["odd name"]') AS path, CASE kind WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'bigint' WHEN 'NULL' THEN 'void' ELSE lower(kind) END AS kind,
                     CASE kind WHEN 'OBJECT' THEN CAST(len(json_keys(value)) AS VARCHAR) WHEN 'ARRAY' THEN CAST(json_array_length(value) AS VARCHAR) WHEN 'NULL' THEN NULL ELSE CAST(value AS VARCHAR) END AS value FROM n),
        j AS (SELECT coalesce(l.event_id, r.event_id) AS event_id, coalesce(l.path, r.path) AS path, CASE WHEN r.path IS NULL THEN 'vanished' WHEN l.path IS NULL THEN 'added' WHEN l.kind <> r.kind THEN 'type' WHEN l.value IS DISTINCT FROM r.value THEN 'value' END AS status, l.value AS before, r.value AS after
              FROM (SELECT * FROM f WHERE side = 1) l FULL JOIN (SELECT * FROM f WHERE side = 2) r ON l.event_id = r.event_id AND l.path = r.path)
        SELECT * FROM j WHERE status IS NOT NULL""",
    "sequence_alignment": """WITH l AS (SELECT o_orderkey // 1000 AS run, concat_ws(' ', o_orderkey, o_custkey) AS item, row_number() OVER (PARTITION BY o_orderkey // 1000 ORDER BY o_orderkey) - 1 AS pos FROM orders),
        s AS (SELECT o_orderkey // 1000 AS run, o_orderkey AS k, 0 AS sub, concat(CASE WHEN o_orderkey % 29 = 0 THEN 'new ' ELSE '' END, concat_ws(' ', o_orderkey, o_custkey)) AS item FROM orders WHERE o_orderkey % 13 > 0
              UNION ALL SELECT o_orderkey // 1000, o_orderkey, 1, concat('put in ', concat_ws(' ', o_orderkey, o_custkey)) FROM orders WHERE o_orderkey % 17 = 0),
        r AS (SELECT run, item, row_number() OVER (PARTITION BY run ORDER BY k, sub) - 1 AS pos FROM s),
        runs AS (SELECT run FROM l UNION SELECT run FROM r),
        m AS (SELECT l.run, l.pos AS a, r.pos AS b FROM l JOIN r ON l.run = r.run AND l.item = r.item UNION ALL SELECT run, -1, -1 FROM runs),
        nl AS (SELECT run, count(*) AS na FROM l GROUP BY run), nr AS (SELECT run, count(*) AS nb FROM r GROUP BY run),
        g AS (SELECT m.run, a + 1 AS os, coalesce(lead(a) OVER w, na, 0) AS oe, b + 1 AS ns, coalesce(lead(b) OVER w, nb, 0) AS ne FROM m LEFT JOIN nl ON nl.run = m.run LEFT JOIN nr ON nr.run = m.run WINDOW w AS (PARTITION BY m.run ORDER BY a))
        SELECT run, CASE WHEN oe > os AND ne > ns THEN 'replace' WHEN oe > os THEN 'delete' ELSE 'insert' END AS op, os AS old_start, oe AS old_end, ns AS new_start, ne AS new_end FROM g WHERE oe > os OR ne > ns""",
    "line_alignment": f"""WITH {_RUNS},
        s AS (SELECT conv_id, run_id // 2 AS block, count(*) AS n, max(x0) - min(x0) AS sl, max(x1) - min(x1) AS sr, max((x0 + x1) / 2) - min((x0 + x1) / 2) AS sc FROM runs GROUP BY ALL),
        o AS (SELECT conv_id, block, CASE WHEN n < 2 THEN NULL WHEN sl <= 0.6 AND sl <= sr AND sl <= sc AND least(sr, sc) - sl >= 0.5 THEN 'left' WHEN sr <= 0.6 AND sr < sl AND sr <= sc AND least(sl, sc) - sr >= 0.5 THEN 'right'
                     WHEN sc <= 0.6 AND sc < sl AND sc < sr AND least(sl, sr) - sc >= 0.5 THEN 'center' END AS own FROM s),
        e AS (SELECT a.conv_id, a.run_id, a.x0, a.x1, min(b.x0) AS l, max(b.x1) AS r FROM runs a LEFT JOIN runs b ON b.conv_id = a.conv_id AND b.run_id <> a.run_id GROUP BY ALL),
        k AS (SELECT *, abs(x0 - l) <= 0.6 AS at_l, abs(x1 - r) <= 0.6 AS at_r, abs((x0 + x1) / 2 - (l + r) / 2) <= 0.6 AS mid FROM e)
        SELECT k.conv_id, run_id // 2 AS block, run_id, coalesce(own, CASE WHEN l IS NULL OR r - l <= 0 THEN 'left' WHEN at_r AND NOT at_l THEN 'right' WHEN at_l AND NOT at_r THEN 'left' WHEN mid AND NOT (at_l AND at_r) THEN 'center' ELSE 'left' END) AS alignment
        FROM k JOIN o ON o.conv_id = k.conv_id AND o.block = run_id // 2""",
    "guarded_rules": """WITH k AS (SELECT 'dear' AS key, 'divergence' AS severity, CAST(o_orderkey AS VARCHAR) AS subject, 'dearer than any' AS text FROM orders WHERE o_totalprice > 490000
        UNION ALL SELECT 'open', 'trace', CAST(o_orderkey AS VARCHAR), 'urgent and not done' FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'
        UNION ALL SELECT 'share', 'note', CAST(o_orderkey AS VARCHAR), 'a share that is too large' FROM orders WHERE o_custkey % 50 > 0 AND o_orderkey > 10000 * (o_custkey % 50)
        UNION ALL SELECT 'check-failed', 'note', 'share', concat('can''t be told of ', count(*), ' rows') FROM orders WHERE o_custkey % 50 = 0 HAVING count(*) > 0
        UNION ALL SELECT 'priority', 'note', CAST(o_orderkey AS VARCHAR), 'low' FROM orders WHERE left(o_orderpriority, 1) = '5'
        UNION ALL SELECT 'check-failed', 'note', 'absent', NULL) SELECT * FROM k""",
    "metadata_update": """WITH c AS (SELECT c_custkey, c_custkey AS k, c_name, c_mktsegment, c_nationkey FROM customer),
        d AS (SELECT *, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 3 = 0 THEN 'D:20210506000000' WHEN k % 3 = 1 THEN 'D:20240203040506+01''00' || chr(39) ELSE 'some day' END AS packed, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 3 = 0 THEN '2021-05-06T00:00:00' WHEN k % 3 = 1 THEN '2024-02-03T04:05:06+01:00' ELSE 'some day' END AS iso FROM c)
        SELECT c_custkey, '/Title' AS name, c_name AS value FROM d UNION ALL SELECT c_custkey, '/Author', CASE WHEN k % 5 = 0 THEN c_mktsegment ELSE 'by ' || c_mktsegment END FROM d WHERE k % 5 = 0 OR k % 4 > 0
        UNION ALL SELECT c_custkey, '/ModDate', coalesce(packed, 'D:20200102030405Z') FROM d UNION ALL SELECT c_custkey, '/Own name', CAST(c_nationkey AS VARCHAR) FROM d WHERE k % 5 > 0
        UNION ALL SELECT c_custkey, 'dc:title', c_name FROM d WHERE k % 2 = 0 UNION ALL SELECT c_custkey, 'xmp:ModifyDate', coalesce(iso, '2020-01-02T03:04:05+00:00') FROM d WHERE k % 2 = 0
        UNION ALL SELECT c_custkey, 'own:key', 'stays' FROM d WHERE k % 2 = 0 UNION ALL SELECT c_custkey, 'dc:creator', 'by ' || c_mktsegment FROM d WHERE k % 2 = 0 AND k % 5 > 0 AND k % 4 > 0""",
    "date_findings": """SELECT 'date-changed' AS key, CAST(c_custkey AS VARCHAR) AS subject, '/ModDate: D:2020 became D:2021' AS text FROM customer WHERE c_custkey % 3 = 0
        UNION ALL SELECT 'metadata-changed', CAST(c_custkey AS VARCHAR), concat('/Title: ', c_name, ' became new') FROM customer WHERE c_custkey % 7 = 0""",
    "deep_reachability": """WITH RECURSIVE k AS (SELECT o_orderkey AS src, o_orderkey + 1 AS dst FROM orders WHERE o_orderkey % 1000 <> 999 UNION ALL SELECT o_orderkey, -o_orderkey - 1 FROM orders WHERE o_orderkey % 7 = 0),
        r(node, depth) AS (SELECT o_orderkey, CAST(0 AS BIGINT) FROM orders WHERE o_orderkey % 1000 = 0 UNION SELECT k.dst, depth + 1 FROM r JOIN k ON k.src = r.node)
        SELECT node, min(depth) AS depth FROM r GROUP BY node""",
} | FILE_ORACLES
