"""The queries in SQL for DuckDB, where SQL can express them."""

ORACLE: dict[str, str] = {}

ORACLE["op2_substrings"] = r"""
WITH d AS (
  SELECT doc_id, list_filter(
    string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35
), g AS (
  SELECT s.doc_id, s.i, array_to_string(d.w[s.i : s.i + 34], ' ') AS t
  FROM s JOIN d USING (doc_id)
), again AS (
  SELECT t FROM g GROUP BY t HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, p FROM (
    SELECT doc_id, unnest(range(i, i + 35)) AS p FROM g SEMI JOIN again USING (t))
), marks AS (
  SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(len(ps), 0) AS n_removed,
  sha256(array_to_string(
    list_filter(d.w, lambda x, j: ps IS NULL OR NOT list_contains(ps, j)), ' ')) AS kept_sha256
FROM d LEFT JOIN marks USING (doc_id)
"""

ORACLE["op10_winnowing"] = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), b AS (
  SELECT item_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), bs AS (
  SELECT item_id, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i
  FROM b WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item_id, k, array_to_string(b.w[i : i + k - 1], ' ') AS t
  FROM bs JOIN b USING (item_id)
), ds AS (
  SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i
  FROM d, (SELECT DISTINCT k FROM bs) WHERE len(w) >= k
), dw AS (
  SELECT doc_id, k, i, array_to_string(d.w[i : i + k - 1], ' ') AS t FROM ds JOIN d USING (doc_id)
), o AS (
  SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, t)
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + k)) AS p FROM o) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s
  FROM o GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items,
  sha256(coalesce(its.s, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def _licences() -> str:
    from hushframe.llm.licenses import COVERED, GRAM, NEIGHBOUR, PHRASES, TEMPLATES

    rows = [(p, x, True) for p, x in PHRASES.items()] + [(p, x, False) for p, x in TEMPLATES.items()]
    values = ", ".join(f"({i}, '{p}', '{x}', {b})" for i, (p, x, b) in enumerate(rows))
    return rf"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), p AS (
  SELECT *, string_split(phrase, ' ') AS pw, least(len(string_split(phrase, ' ')), {GRAM}) AS k
  FROM (VALUES {values}) AS v(tid, phrase, label, base)
), g AS (
  SELECT tid, label, base, k, len(pw) AS size, unnest(range(0, len(pw) - k + 1)) AS t, pw FROM p
), gg AS (
  SELECT tid, label, base, k, size, t, array_to_string(pw[t + 1 : t + k], ' ') AS s FROM g
), places AS (
  SELECT doc_id, k, unnest(range(0, len(w) - k + 1)) AS pos
  FROM d, (SELECT DISTINCT k FROM p) WHERE len(w) >= k
), texts AS (
  SELECT doc_id, k, pos, array_to_string(w[pos + 1 : pos + k], ' ') AS s FROM places JOIN d USING (doc_id)
), votes AS (
  SELECT doc_id, pos, tid, label, base, size, t, k FROM texts JOIN gg USING (k, s)
), based AS (
  SELECT doc_id, count(*) AS n, min(pos) AS a, max(pos) AS z, list_sort(list(DISTINCT label)) AS ls
  FROM votes WHERE base GROUP BY doc_id
), diagonals AS (
  SELECT doc_id, tid, label, size, pos - t AS diagonal, list(DISTINCT t) AS ts
  FROM votes WHERE NOT base GROUP BY doc_id, tid, label, size, pos - t
), begins AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, tid ORDER BY diagonal) <= {NEIGHBOUR}
    THEN 0 ELSE 1 END AS b FROM diagonals
), numbered AS (
  SELECT *, sum(b) OVER (PARTITION BY doc_id, tid ORDER BY diagonal) AS span FROM begins
), spans AS (
  SELECT doc_id, tid, label, size, span, count(DISTINCT x) AS n FROM (
    SELECT doc_id, tid, label, size, span, unnest(range(t, t + {GRAM})) AS x
    FROM (SELECT doc_id, tid, label, size, span, unnest(ts) AS t FROM numbered))
  GROUP BY doc_id, tid, label, size, span
), more AS (
  SELECT doc_id, list(DISTINCT label) FILTER (WHERE n / size >= {COVERED}) AS ls, max(n / size) AS most
  FROM spans GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, z AS last_word,
  coalesce(array_to_string(based.ls, ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(based.ls, []), coalesce(more.ls, [])))), ',') AS labels,
  CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(most, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN based USING (doc_id) LEFT JOIN more USING (doc_id)
"""


ORACLE["op8_licenses"] = _licences()

ORACLE["op4_warc"] = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS h FROM pages
), f AS (
  SELECT h, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY h HAVING count(*) > 1
)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (h)
"""

ORACLE["op11_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), o AS (
  SELECT r, lang, source, unnest(w) AS t FROM d
), kept AS (
  SELECT lang, t FROM o GROUP BY lang, t HAVING count(DISTINCT r) >= 3
), v AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, t, count(*) AS n FROM o SEMI JOIN kept USING (lang, t) GROUP BY lang, source, t
), gn AS (
  SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source
), gp AS (
  SELECT gn.lang, gn.source, kept.t, coalesce(n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (total + v) AS p
  FROM gn JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON
    c.lang = gn.lang AND c.source = gn.source AND c.t = kept.t
), lp AS (
  SELECT lang, t, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (any_value(total) + any_value(v)) AS q
  FROM gp JOIN (SELECT lang, sum(total) AS total FROM gn GROUP BY lang) USING (lang) JOIN v USING (lang)
  GROUP BY lang, t
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM gp a JOIN gp b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source
), ranked AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', t, (((p - q) * (p - q)) // q)::BIGINT
  FROM gp JOIN lp USING (lang, t) WHERE n > 0 AND p > q
)
SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM ranked
QUALIFY part = 'pair' OR rank <= 200
"""

ORACLE["op12_fill_middle"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id::VARCHAR) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w
  FROM documents
), c AS (
  SELECT doc_id, text, w, len(w) AS n,
    ('0x' || h[1:8])::BIGINT % (len(w) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(w) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
        OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), parts AS (
  SELECT doc_id, text, n, form, array_to_string(w[1 : least(a, b)], '') AS prefix,
    array_to_string(w[least(a, b) + 1 : greatest(a, b)], '') AS middle,
    array_to_string(w[greatest(a, b) + 1 : n], '') AS suffix
  FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
