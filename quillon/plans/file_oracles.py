"""DuckDB SQL with the rows of the queries of quillon.plans.file_queries, written apart from them."""

from __future__ import annotations

_KEY = "CAST(p_partkey AS VARCHAR) AS path"

ORACLES = {
    "page_contents": f"""SELECT {_KEY}, CAST(0 AS BIGINT) AS page, 'page' AS part, '' AS name, concat('0 0 ', p_size, ' 800') AS box, CAST(NULL AS VARCHAR) AS matrix, md5(concat('/Fm Do', chr(10), 'BT (', p_type, ') Tj ET')) AS digest FROM part
        UNION ALL SELECT {_KEY}, 0, 'form', '/Fm', '0 0 1 1', concat('1 0 0 1 5 ', p_size), md5('/Fm Do q Q') FROM part
        UNION ALL SELECT {_KEY}, 0, 'appearance', state, '0 0 2 2', NULL, md5(said) FROM part, (VALUES ('0/On', '(on) Tj'), ('0/Off', '(off) Tj')) v(state, said)
        UNION ALL SELECT {_KEY}, 1, 'page', '', concat('0 0 ', p_size, ' 800'), NULL, md5(concat('BT (', p_type, ') Tj ET')) FROM part""",
    "structure_errors": f"""SELECT {_KEY}, 'page 1, annotation 0' AS place, 'no subtype' AS problem FROM part UNION ALL SELECT {_KEY}, 'page 1', 'type isn''t page' FROM part WHERE p_partkey % 5 = 0""",
    "file_metadata": f"""SELECT {_KEY}, 'info' AS store, '/Title' AS name, p_brand AS value FROM part UNION ALL SELECT {_KEY}, 'info', '/Producer', 'A' FROM part
        UNION ALL SELECT {_KEY}, 'id', '0', '00' FROM part UNION ALL SELECT {_KEY}, 'id', '1', printf('%04x', p_size) FROM part""",
    "file_profiles": f"""SELECT {_KEY}, CAST(40 + CASE WHEN p_partkey % 3 = 0 THEN 35 ELSE 0 END + CASE WHEN p_partkey % 4 = 0 THEN 15 ELSE 0 END + CASE WHEN p_partkey % 5 = 0 THEN 16 ELSE 0 END + CASE WHEN p_partkey % 6 = 0 THEN 18 ELSE 0 END AS BIGINT) AS size,
            concat('1.', p_partkey % 8) AS version, CAST(CASE WHEN p_partkey % 6 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_eof, CAST(CASE WHEN p_partkey % 6 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_startxref,
            p_partkey % 3 = 0 AS object_streams, p_partkey % 4 = 0 AS encrypted, p_partkey % 5 = 0 AS has_id, CASE WHEN p_partkey % 6 = 0 THEN '2 revisions' END AS finding FROM part""",
    "file_signatures": f"""SELECT {_KEY}, 'mark' AS field, '/adbe' AS sub_filter, 'D:2021' AS signed_at, concat('0 10 20 ', p_partkey) AS byte_range,
            20 + p_partkey >= 975 + 2 * length(p_size::VARCHAR) + length(p_type) + length(p_brand) + length(p_partkey::VARCHAR) + CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 1 END AS covers FROM part""",
    "file_comparison": f"""SELECT {_KEY}, 'metadata' AS part, 'info /Title' AS item, concat(p_brand, ' -> none') AS change FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT {_KEY}, 'object', '11 0', 'changed head' FROM part WHERE p_partkey % 3 = 0
        UNION ALL SELECT {_KEY}, 'object', '6 0', 'changed body' FROM part WHERE p_partkey % 4 = 0
        UNION ALL SELECT path, 'container', 'file-size', concat(a, ' bytes became ', b) FROM (SELECT {_KEY}, 975 + 2 * length(p_size::VARCHAR) + length(p_type) + length(p_brand) + length(p_partkey::VARCHAR) + CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 1 END AS a,
            975 + 2 * length(p_size::VARCHAR) + CASE WHEN p_partkey % 4 = 0 THEN 4 ELSE length(p_type) END + CASE WHEN p_partkey % 3 = 0 THEN 4 ELSE length(p_brand) END + length(p_partkey::VARCHAR) + CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 1 END AS b FROM part) WHERE a <> b""",
    "file_references": f"""SELECT {_KEY}, src, dst FROM part, (VALUES ('1 0', '2 0'), ('1 0', '12 0'), ('2 0', '3 0'), ('2 0', '4 0'), ('2 0', '2 0'), ('3 0', '5 0'), ('3 0', '6 0'), ('3 0', '7 0'), ('3 0', '8 0'), ('4 0', '6 0'), ('8 0', '9 0'), ('8 0', '10 0')) v(src, dst)""",
    "byte_changes": f"SELECT {_KEY}, p_partkey % 4 = 0 AS identical, p_partkey % 4 = 1 AS appended, p_partkey % 4 = 2 AS in_place FROM part WHERE p_partkey % 4 < 3",
    "described_changes": f"""SELECT {_KEY}, CAST(CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 3 END AS BIGINT) AS at,
            CASE WHEN p_partkey % 2 = 0 THEN concat('(', p_brand, ') Tj became (xyz) Tj', CASE WHEN p_partkey % 3 = 0 THEN '; T*' ELSE '' END) ELSE 'T* is new' END AS text FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0""",
    "code_widths_expanded": f"""SELECT {_KEY}, CAST(p_size AS BIGINT) AS code, CAST(500 AS DOUBLE) AS width FROM part UNION ALL SELECT {_KEY}, p_size + 1, 600.5 FROM part UNION ALL SELECT {_KEY}, 100 + i, 250 FROM part, range(1000) r(i) WHERE i <= p_size""",
    "font_encodings": f"""SELECT {_KEY}, CAST(p_size + 40 AS BIGINT) AS code, 'uni0416' AS name, 'Ж' AS text FROM part UNION ALL SELECT {_KEY}, p_size + 41, 'space', '' FROM part UNION ALL SELECT {_KEY}, p_size + 42, printf('uni%04X', p_size + 42), chr(CAST(p_size + 42 AS INTEGER)) FROM part""",
    "character_ids": f"SELECT {_KEY}, CAST(p_size AS BIGINT) AS code, CAST(7 AS BIGINT) AS cid FROM part UNION ALL SELECT {_KEY}, p_size + 100 + i, 30 + i FROM part, range(3) r(i)",
    "split_codes": f"SELECT {_KEY}, concat('42 7261 6e64 ', lower(hex(p_brand))[11:14], CASE WHEN length(p_brand) > 7 THEN concat(' ', lower(hex(p_brand))[15:16]) ELSE '' END) AS codes FROM part",
    "code_map_written": f"SELECT {_KEY}, CAST(p_size + n AS BIGINT) AS code, t AS text FROM part, (VALUES (0, 'A'), (1, 'B'), (2, 'C'), (9, 'Ж')) v(n, t)",
    "actual_texts": f"SELECT {_KEY}, CASE WHEN p_partkey % 3 = 0 THEN 'other' ELSE p_brand END AS copy, p_partkey % 3 = 0 AS differs FROM part",
    "writing_styles": f"SELECT {_KEY}, CAST(2 AS BIGINT) AS n_hex, CAST(1 AS BIGINT) AS n_literal, p_size % 2 <> 0 AS upper, CAST(2 AS BIGINT) AS decimals FROM part",
    "stream_filters": f"SELECT {_KEY}, CASE WHEN p_partkey % 3 = 2 THEN '/Other' ELSE '/ASCIIHexDecode' END AS chain, CASE WHEN p_partkey % 3 < 2 THEN p_name END AS decoded FROM part",
    "stream_tails": f"SELECT {_KEY}, true AS valid, CAST(2 AS BIGINT) AS level, CAST(2 AS BIGINT) AS hint, CAST(p_size % 4 AS BIGINT) AS tail, CASE WHEN p_size % 4 > 0 THEN concat('object 1 0: ', p_size % 4, ' bytes after the end of its data') END AS finding FROM part",
    "font_changes": """SELECT 'font-date' AS key, CAST(p_partkey AS VARCHAR) AS subject FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'table-order', CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT 'hinting', CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 4 = 2""",
    "recompressed": "SELECT CAST(p_partkey AS VARCHAR) AS subject, concat('level ', p_size % 4, ' became 2') AS text FROM part WHERE p_partkey % 7 > 0 AND p_size % 4 <> 2",
    "identity_changes": "SELECT 'metadata-changed' AS key, CAST(p_partkey AS VARCHAR) AS subject, concat('/Title: ', p_brand, ' became none') AS text FROM part WHERE p_partkey % 3 = 0",
    "opaque_filters": "SELECT p_partkey, p_partkey % 3 = 0 AS opaque FROM part",
    "utf16_texts": "SELECT conv_id, turn, CAST(length(text) AS INTEGER) AS n, true AS same FROM conversations",
}
