"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

from siltstone.llm import licenses, urlfilter

OP5 = r"""
WITH w AS (
    SELECT doc_id, coalesce(text, '') AS t,
           list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
    FROM documents),
windows AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
repeated AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM repeated, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
m AS (
    SELECT w.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
           length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
           len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
           length(t) - length(replace(t, '!', '')) AS n_shouts
    FROM w JOIN lines ON w.doc_id = lines.doc_id LEFT JOIN covered ON w.doc_id = covered.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars > 20 * n_words
            OR 2 * n_shouts > n_words) AS kept
FROM b
"""

OP4 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS digest FROM p),
k AS (SELECT digest, max(page_id) AS keeper FROM d WHERE n >= 1000 GROUP BY digest)
SELECT d.page_id, CAST(n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN keeper IS NOT NULL AND keeper IS DISTINCT FROM d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper IS DISTINCT FROM d.page_id THEN keeper END AS refers_to
FROM d LEFT JOIN k ON d.digest = k.digest
"""


def _canonical(text: str) -> str:
    """The canonical licence form of a text, in SQL."""
    plain = f"regexp_replace(lower({text}), '(?im)^[^\\p{{L}}\\p{{N}}\\n]*(copyright|\\(c\\)|©)[^\\n]*$', '', 'g')"
    out = f"' ' || trim(regexp_replace({plain}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
    for written, meant in licenses.SPELLINGS:
        out = f"replace({out}, ' {written} ', ' {meant} ')"
    return f"trim({out})"


def _rows(rows: list[tuple[str, ...]]) -> str:
    quote = lambda v: "'" + str(v).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


OP7 = f"""
WITH known AS (SELECT license, sha256({_canonical('text')}) AS digest
               FROM (VALUES {_rows(list(licenses.NOTICES.items()))}) AS v(license, text)),
b AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
u AS (SELECT doc_id, 'text' AS kind, t AS unit FROM b
      UNION ALL SELECT doc_id, 'line', unnest(string_split(t, chr(10))) FROM b
      UNION ALL SELECT doc_id, 'paragraph', p FROM (
          SELECT doc_id, unnest(regexp_split_to_array(t, '\\n[\\x20\\x09\\x0B-\\x0D]*\\n')) AS p FROM b)
      WHERE contains(p, chr(10))),
c AS (SELECT doc_id, kind, {_canonical('unit')} AS form FROM u)
SELECT doc_id, license, digest, count(*) FILTER (kind = 'text') > 0 AS whole_text,
       count(*) FILTER (kind = 'paragraph') AS paragraphs, count(*) FILTER (kind = 'line') AS lines
FROM c JOIN known ON sha256(form) = digest WHERE form <> '' GROUP BY doc_id, license, digest
"""

# A rule fits a host that is its own or ends in it after a dot.
OP10 = f"""
WITH r(host, path, verdict, rank) AS (
    SELECT col0, col1, col2, 1 FROM (VALUES {_rows(list(urlfilter.RULES))})
    UNION ALL SELECT col0, col1, col2, 0 FROM (VALUES {_rows(list(urlfilter.LISTED))})),
p AS (SELECT page_id, row_number() OVER () AS row,
             translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), '{urlfilter.UPPER}',
                       '{urlfilter.LOWER}') AS host,
             regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
best AS (SELECT row, max_by(struct_pack(key := r.host || r.path, verdict := verdict, rank := rank),
                            rank * 100000 + length(r.host || r.path)) AS b
         FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
         GROUP BY row)
SELECT page_id, host, path, CASE WHEN b.rank = 1 THEN b.key END AS rule, coalesce(b.verdict, 'allow') AS verdict
FROM p LEFT JOIN best ON p.row = best.row
"""

OP11 = r"""
WITH u AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
           regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS us
    FROM documents),
d AS (SELECT doc_id, t, us, len(us) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(us) + 1) AS a,
             CAST('0x' || h[9:16] AS BIGINT) % (len(us) + 1) AS b,
             CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
                  WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
c AS (SELECT doc_id, t, n, form, array_to_string(us[1:least(a, b)], '') AS p,
             array_to_string(us[least(a, b) + 1:greatest(a, b)], '') AS m,
             array_to_string(us[greatest(a, b) + 1:], '') AS s FROM d)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c
"""

ORACLE = {"op4_warc": OP4, "op5_rules": OP5, "op7_licenses": OP7, "op10_urlfilter": OP10, "op11_fim": OP11}
