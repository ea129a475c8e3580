"""The queries again in SQL, for DuckDB, to compare results.

Written on exploded rows and regular expressions of another engine (RE2, with its
own ASCII word boundaries), independently of the column expressions.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

# --- patterns ---------------------------------------------------------------

_SP = (
    r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}"
    r"\x{3000}\x{FEFF}"
)
_CARD = rf"\b[0-9]{{4}}[{_SP}-]?[0-9]{{4}}[{_SP}-]?[0-9]{{4}}[{_SP}-]?[0-9]{{4}}\b"
_IBAN = r"\b([A-Z]{2}[0-9]{2})[A-Z0-9]{7,26}([A-Z0-9]{4})\b"
_SSN = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
_EMAIL = r"\b([a-zA-Z0-9._%+-])[a-zA-Z0-9._%+-]*@([a-zA-Z0-9.-]+\.[a-zA-Z]{2,})\b"
_PHONE = (
    rf"\+([0-9])(?:([0-9])[0-9]?[{_SP}.-]?[0-9]|[{_SP}.-]?([0-9]))"
    rf"[{_SP}.-]?[0-9]{{3,4}}[{_SP}.-]?[0-9]{{1,2}}([0-9]{{2}})\b"
)
_KINDS = ("credit_card", "iban", "ssn", "email", "phone")
_REPLACE = {
    "iban": (_IBAN, r"\1****\2"),
    "ssn": (_SSN, "***-**-****"),
    "email": (_EMAIL, r"\1***@\2"),
    "phone": (_PHONE, r"+\1\2\3***\4"),
}

_RULES = (
    ("IP_ADDRESS", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"),
    ("PASSWORD", r"\b[0-9a-f]{40}\b"),
    ("NAME", r"\b[A-Z][a-z]{11,}\b"),
)

# --- masks ------------------------------------------------------------------


def _digits(match: str) -> str:
    return f"regexp_replace({match}, '[^0-9]', '', 'g')"


def _luhn(match: str) -> str:
    """Odd places of a 16-digit number, from the left, are doubled."""
    digit = f"CAST(substr({_digits(match)}, p, 1) AS INTEGER)"
    return (
        f"(list_sum(list_transform(range(1, 17), lambda p: CASE WHEN p % 2 = 0 THEN {digit} "
        f"WHEN {digit} >= 5 THEN 2 * {digit} - 9 ELSE 2 * {digit} END)) % 10 = 0)"
    )


def _card_mask(match: str) -> str:
    sep = f"CASE WHEN contains({match}, '-') THEN '-' WHEN contains({match}, ' ') THEN ' ' ELSE '' END"
    stars = f"'****' || {sep} || '****' || {sep} || '****' || {sep} || right({match}, 4)"
    return f"CASE WHEN {_luhn(match)} THEN {stars} ELSE {match} END"


def _one_mask(kind: str, source: str, target: str, text: str, out: str) -> str:
    """CTEs that add ``out`` (masked text) and ``n_out`` (count) to ``source``."""
    if kind != "credit_card":
        pattern, mask = _REPLACE[kind]
        return (
            f"{target} AS (SELECT *, regexp_replace({text}, '{pattern}', '{mask}', 'g') AS {out}, "
            f"coalesce(len(regexp_extract_all({text}, '{pattern}')), 0) AS n_{out} FROM {source})"
        )
    return (
        f"{target}_m AS (SELECT *, regexp_extract_all({text}, '{_CARD}') AS cards, "
        f"string_split_regex({text}, '{_CARD}') AS gaps FROM {source}), "
        f"{target}_k AS (SELECT *, list_transform(cards, lambda m: {_card_mask('m')}) AS masked "
        f"FROM {target}_m), "
        f"{target} AS (SELECT * EXCLUDE (cards, gaps, masked), CASE WHEN len(cards) = 0 THEN {text} "
        f"ELSE array_to_string(list_transform(range(1, len(gaps) + 1), "
        f"lambda i: gaps[i] || coalesce(masked[i], '')), '') END AS {out}, "
        f"coalesce(len(list_filter(range(1, len(cards) + 1), lambda i: cards[i] <> masked[i])), 0) "
        f"AS n_{out} FROM {target}_k)"
    )


def masks(source: str, name: str, text: str = "text") -> str:
    """CTEs that mask ``text`` of ``source`` with all five patterns.

    The result ``name`` has all columns of the source and ``value``, ``n``,
    ``kinds`` and one count per kind; ``value_1`` ... are the texts in between.
    """
    steps = []
    before, column = source, text
    for i, kind in enumerate(_KINDS):
        after = f"{name}_{i}"
        steps.append(_one_mask(kind, before, after, column, f"value_{i + 1}"))
        before, column = after, f"value_{i + 1}"
    counts = [f"n_value_{i + 1}" for i in range(len(_KINDS))]
    each = ", ".join(f"CAST({c} AS BIGINT) AS n_{k}" for c, k in zip(counts, _KINDS))
    named = ", ".join(f"CASE WHEN {c} > 0 THEN '{k}' END" for c, k in zip(counts, _KINDS))
    steps.append(
        f"{name} AS (SELECT *, {column} AS value, CAST({' + '.join(counts)} AS BIGINT) AS n, "
        f"concat_ws(',', {named}) AS kinds, {each} FROM {before})"
    )
    return ", ".join(steps)


# --- views ------------------------------------------------------------------

_CUSTOMERS = """customers AS (
  SELECT *, '4111 1111 1111 ' || last4 AS card,
    'NL91ABNA' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS iban,
    lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || '-'
      || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '-' || last4 AS ssn,
    'customer.' || c_custkey || '@bank' || c_nationkey || '.example.com' AS email,
    '+31 6 ' || last4 || ' 5678' AS phone
  FROM (SELECT *, lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS last4 FROM customer))"""

_TEXTS = (
    _CUSTOMERS
    + """, texts AS (
  SELECT 'documents:' || doc_id AS text_id, text FROM documents
  UNION ALL SELECT 'pages:' || page_id, html FROM pages
  UNION ALL SELECT 'conversations:' || conv_id || ':' || turn, text FROM conversations
  UNION ALL SELECT 'benchmark:' || item_id, text FROM benchmark
  UNION ALL SELECT 'customer:' || c_custkey, c_name || ' card ' || card || ', IBAN ' || iban
    || '; SSN ' || ssn || ' mail ' || email || ' tel ' || phone || '.' FROM customers)"""
)

_CALLS = """calls AS (
  SELECT doc_id AS call_id, source AS tool_name,
    CASE WHEN doc_id % 13 <> 0 THEN '{"query":"user' || doc_id || '@mail' || doc_id % 7
      || '.example.com","ids":"' || repeat('k' || doc_id || '-', doc_id % 120) || '"}' END AS arguments,
    1704067200000 + doc_id * 1000 + doc_id % 997 AS started_ms,
    1704067200000 + doc_id * 1000 + doc_id % 997 + 45 + doc_id % 900 AS finished_ms,
    CASE WHEN doc_id % 23 = 0 THEN 'upstream down for ops' || doc_id || '@example.com' END AS failure,
    ['GDPR', 'DORA', 'PCI_DSS', 'full', 'UNKNOWN'][doc_id % 5 + 1] AS profile,
    CASE WHEN profile = 'UNKNOWN' THEN 'GDPR' ELSE profile END AS profile_name,
    doc_id % 17 = 0 AS is_error,
    doc_id % 29 = 0 OR doc_id % 23 = 0 AS no_content,
    CASE WHEN doc_id % 31 = 0 THEN [] ELSE string_split(text, chr(10)) END AS lines
  FROM documents),
blocks AS (
  SELECT call_id, block_idx - 1 AS block_idx, is_error, profile_name,
    CASE WHEN block_idx % 5 = 0 THEN 'image' ELSE 'text' END AS type,
    CASE WHEN block_idx % 5 <> 0 THEN line END AS text,
    CASE WHEN block_idx % 5 = 0 THEN line END AS data
  FROM (SELECT call_id, is_error, profile_name, unnest(lines) AS line,
      generate_subscripts(lines, 1) AS block_idx FROM calls WHERE NOT no_content))"""

_RESOURCES = """resources AS (
  SELECT page_id, 0 AS item_idx, url AS item_uri, 'text/html' AS mime_type,
    CASE WHEN page_id % 7 <> 0 THEN html END AS text,
    CASE WHEN page_id % 7 = 0 THEN html END AS blob,
    ['GDPR', 'DORA', 'PCI_DSS', 'full', 'GDPR'][page_id % 5 + 1] AS profile_name
  FROM pages
  UNION ALL
  SELECT page_id, 1, url, 'text/plain', 'seen by user' || page_id || '@example.com', NULL,
    ['GDPR', 'DORA', 'PCI_DSS', 'full', 'GDPR'][page_id % 5 + 1]
  FROM pages)"""

# --- entity stage -----------------------------------------------------------


def _chunks(source: str, limit: int = 4500) -> str:
    """CTEs for ``chunks(k, chunk_idx, text, sep, start)`` of ``source(k, text)``.

    Over-long lines are cut by a search for the longest prefix that fits, shortened to its
    last white space if it has any; chunk boundaries come from running byte totals, one chunk per step for all texts.
    """
    lowest = limit // 4
    return f"""lines AS (
  SELECT k, unnest(parts) AS line, generate_subscripts(parts, 1) AS ln
  FROM (SELECT k, string_split(text, chr(10)) AS parts FROM {source} WHERE strlen(text) > {limit})),
cuts AS (
  SELECT k, ln, 0 AS pc, CAST(NULL AS VARCHAR) AS piece, line AS rest FROM lines
    WHERE strlen(line) > {limit}
  UNION ALL
  SELECT k, ln, pc + 1, left(rest, w), substr(rest, w + 1)
  FROM (SELECT *, CASE WHEN fits = length(rest) THEN fits ELSE coalesce(nullif(length(
        regexp_extract(left(rest, fits), '(?s)^.*[ \\t\\x0B\\f\\r]')), 0), fits) END AS w
      FROM (SELECT *, CASE WHEN strlen(rest) <= {limit} THEN length(rest) ELSE
        list_max(list_filter(range({lowest}, {limit} + 1), lambda i: strlen(left(rest, i)) <= {limit})) END AS fits
      FROM cuts WHERE rest <> ''))),
pieces AS (
  SELECT k, ln, 0 AS pc, line AS text, chr(10) AS sep FROM lines WHERE strlen(line) <= {limit}
  UNION ALL
  SELECT k, ln, pc, piece, CASE WHEN rest = '' THEN chr(10) ELSE '' END FROM cuts WHERE pc > 0),
numbered AS (
  SELECT *, row_number() OVER w AS pn,
    CAST(sum(strlen(text) + strlen(sep)) OVER w AS BIGINT) AS bytes_to,
    CAST(sum(length(text) + length(sep)) OVER w AS BIGINT) AS chars_to
  FROM pieces WINDOW w AS (PARTITION BY k ORDER BY ln, pc ROWS UNBOUNDED PRECEDING)),
firsts AS (
  SELECT DISTINCT k, CAST(1 AS BIGINT) AS pn, CAST(0 AS BIGINT) AS base, 0 AS chunk_idx FROM numbered
  UNION ALL
  SELECT f.k, min(p.pn), min(p.bytes_to - strlen(p.text) - strlen(p.sep)), f.chunk_idx + 1
  FROM firsts f JOIN numbered p ON p.k = f.k AND p.pn > f.pn
    AND p.bytes_to - strlen(p.sep) - f.base > {limit}
  GROUP BY f.k, f.chunk_idx),
placed AS (
  SELECT p.*, max(f.chunk_idx) OVER (PARTITION BY p.k ORDER BY p.pn) AS chunk_idx
  FROM numbered p LEFT JOIN firsts f ON p.k = f.k AND p.pn = f.pn),
packed AS (
  SELECT k, chunk_idx, string_agg(text || sep, '' ORDER BY pn) AS joined, arg_max(sep, pn) AS last_sep,
    min(chars_to - length(text) - length(sep)) AS start,
    chunk_idx = max(chunk_idx) OVER (PARTITION BY k) AS is_last
  FROM placed GROUP BY k, chunk_idx),
chunks AS (
  SELECT k, CAST(0 AS BIGINT) AS chunk_idx, text, '' AS sep, CAST(0 AS BIGINT) AS start
    FROM {source} WHERE strlen(text) <= {limit}
  UNION ALL
  SELECT k, CAST(chunk_idx AS BIGINT), left(joined, length(joined) - length(last_sep)),
    CASE WHEN is_last THEN '' ELSE last_sep END, CAST(start AS BIGINT) FROM packed)"""


def _whole(source: str) -> str:
    """CTE ``chunks`` with each text of ``source`` as its one chunk."""
    return (
        "chunks AS (SELECT k, CAST(0 AS BIGINT) AS chunk_idx, text, '' AS sep, CAST(0 AS BIGINT) AS start "
        f"FROM {source} WHERE text IS NOT NULL)"
    )


def _chunks_parity(source: str, limit: int = 4500) -> str:
    """CTEs for ``chunks`` as observed in the original tool, one line per step.

    A chunk that is empty takes the next line without a separator; a line over the limit
    is cut to the longest prefixes that fit only if it meets an empty chunk.
    """
    lowest = limit // 4
    return f"""plines AS (
  SELECT k, unnest(parts) AS line, generate_subscripts(parts, 1) AS ln
  FROM (SELECT k, string_split(text, chr(10)) AS parts FROM {source} WHERE strlen(text) > {limit})),
pcuts AS (
  SELECT k, ln, 0 AS pc, CAST(NULL AS VARCHAR) AS piece, line AS rest FROM plines WHERE strlen(line) > {limit}
  UNION ALL
  SELECT k, ln, pc + 1, left(rest, w), substr(rest, w + 1)
  FROM (SELECT *, CASE WHEN strlen(rest) <= {limit} THEN length(rest) ELSE
      list_max(list_filter(range({lowest}, {limit} + 1), lambda i: strlen(left(rest, i)) <= {limit})) END AS w
    FROM pcuts WHERE rest <> '')),
ppieces AS (SELECT k, ln, list(piece ORDER BY pc) AS ps FROM pcuts WHERE pc > 0 GROUP BY k, ln),
pl AS (SELECT l.*, coalesce(p.ps, [l.line]) AS ps FROM plines l LEFT JOIN ppieces p USING (k, ln)),
walk AS (
  SELECT k, CAST(0 AS BIGINT) AS ln, '' AS cur, CAST([] AS VARCHAR[]) AS done FROM (SELECT DISTINCT k FROM plines)
  UNION ALL
  SELECT w.k, l.ln,
    CASE WHEN cur = '' THEN l.ps[-1] WHEN strlen(cur) + 1 + strlen(l.line) > {limit} THEN l.line
      ELSE cur || chr(10) || l.line END,
    CASE WHEN cur = '' THEN list_concat(done, l.ps[:-2])
      WHEN strlen(cur) + 1 + strlen(l.line) > {limit} THEN list_append(done, cur) ELSE done END
  FROM walk w JOIN pl l ON l.k = w.k AND l.ln = w.ln + 1),
ends AS (
  SELECT k, CASE WHEN cur = '' THEN done ELSE list_append(done, cur) END AS cs FROM walk
  WHERE (k, ln) IN (SELECT (k, max(ln)) FROM plines GROUP BY k)),
chunks AS (
  SELECT k, CAST(0 AS BIGINT) AS chunk_idx, text, '' AS sep FROM {source} WHERE strlen(text) <= {limit}
  UNION ALL
  SELECT k, i - 1, cs[i], CASE WHEN i < len(cs) THEN chr(10) ELSE '' END
  FROM (SELECT k, cs, unnest(range(1, len(cs) + 1)) AS i FROM ends))"""


def _entities(rules=_RULES) -> str:
    """CTEs for ``ents(k, chunk_idx, ordinal, type, b, e)`` of ``chunks``."""
    found = " UNION ALL ".join(
        f"SELECT k, chunk_idx, {i} AS rule, '{kind}' AS type, "
        f"regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS gs "
        f"FROM chunks"
        for i, (kind, pattern) in enumerate(rules)
    )
    return f"""found AS ({found}),
single AS (
  SELECT k, chunk_idx, rule, type, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM found),
offsets AS (
  SELECT k, chunk_idx, rule, type,
    list_sum(list_transform(gs[1:i], lambda x: length(x)))
      + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS b,
    length(ms[i]) AS len FROM single),
ents AS (
  SELECT k, chunk_idx, type, CAST(b AS BIGINT) AS b, CAST(b + len AS BIGINT) AS e,
    row_number() OVER (PARTITION BY k, chunk_idx ORDER BY rule, b) - 1 AS ordinal FROM offsets)"""


def _applied(where: str = "true") -> str:
    """CTEs for ``done(k, chunk_idx, value, sep, n, kinds, wanted...)``.

    Built from the gaps between spans, which do not overlap.
    """
    return f"""wanted AS (SELECT * FROM ents WHERE {where}),
gaps AS (
  SELECT w.*, substr(c.text, lag_e + 1, w.b - lag_e) || '[REDACTED:' || w.type || ']' AS part
  FROM (SELECT *, coalesce(lag(e) OVER (PARTITION BY k, chunk_idx ORDER BY b), 0) AS lag_e
    FROM wanted) w JOIN chunks c USING (k, chunk_idx)),
heads AS (
  SELECT k, chunk_idx, string_agg(part, '' ORDER BY b) AS head, max(e) AS last_e, count(*) AS n
  FROM gaps GROUP BY k, chunk_idx),
done AS (
  SELECT c.k, c.chunk_idx, CASE WHEN n IS NULL THEN c.text
      ELSE head || substr(c.text, last_e + 1) END AS value, c.sep, coalesce(n, 0) AS n
  FROM chunks c LEFT JOIN heads h USING (k, chunk_idx)),
chunk_kinds AS (
  SELECT k, chunk_idx, string_agg(type, ',' ORDER BY b DESC) AS kinds
  FROM (SELECT k, chunk_idx, type, max(b) AS b FROM wanted GROUP BY k, chunk_idx, type)
  GROUP BY k, chunk_idx),
text_kinds AS (
  SELECT k, string_agg(type, ',' ORDER BY first_at) AS kinds
  FROM (SELECT k, type, min(chunk_idx * 1000000 - b) AS first_at FROM wanted GROUP BY k, type) GROUP BY k),
whole AS (
  SELECT d.k, d.value, d.n, coalesce(t.kinds, '') AS kinds
  FROM (SELECT k, string_agg(value || sep, '' ORDER BY chunk_idx) AS value,
      CAST(sum(n) AS BIGINT) AS n FROM done GROUP BY k) d LEFT JOIN text_kinds t USING (k))"""


def _join_kinds(first: str, second: str) -> str:
    """Two disjoint kind lists as one."""
    return f"concat_ws(',', nullif({first}, ''), nullif({second}, ''))"


_DOCS = "docs AS (SELECT doc_id AS k, text FROM documents)"
_DOC_CHUNKS = f"{_DOCS}, {_chunks('docs')}"
_DOC_ENTITIES = f"{_DOC_CHUNKS}, {_entities()}"
_DOC_WHOLE = f"{_DOCS}, {_whole('docs')}, {_entities()}"
_DOC_MASKED = (
    f"raw AS (SELECT doc_id AS k, text FROM documents), {masks('raw', 'm')}, "
    "docs AS (SELECT k, value AS text FROM m)"
)
_DOC_DEEP = f"{_DOC_MASKED}, {_whole('docs')}"


def _deep(rules=_RULES) -> str:
    return f"{_DOC_DEEP}, {_entities(rules)}, {_applied()}"


def _recursive(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes} {select}"


_DEEP_SELECT = (
    "SELECT m.k AS doc_id, w.value AS text, m.n + w.n AS redaction_count, "
    f"{_join_kinds('m.kinds', 'w.kinds')} AS redacted_types FROM m JOIN whole w USING (k)"
)

# --- sources and sinks ------------------------------------------------------

ORACLE["scan_text"] = f"WITH {_TEXTS} SELECT * FROM texts"

_EMPTY_CALLS = (
    "SELECT call_id, CAST(-1 AS BIGINT) AS block_idx, NULL AS type, NULL AS text, NULL AS data{more} "
    "FROM calls WHERE no_content OR len(lines) = 0"
)

ORACLE["call_blocks"] = (
    f"WITH {_CALLS} SELECT call_id, block_idx, type, text, data, "
    "CASE WHEN type = 'image' THEN 'image/png' END AS mime_type FROM blocks "
    f"UNION ALL {_EMPTY_CALLS.format(more=', NULL AS mime_type')}"
)

ORACLE["resource_items"] = (
    f"WITH {_RESOURCES} SELECT page_id, CAST(item_idx AS BIGINT) AS item_idx, item_uri, mime_type, "
    "text, blob FROM resources"
)

ORACLE["redacted_sink"] = (
    f"WITH {masks('documents', 'm')} SELECT doc_id, lang, source, n_chars, value AS text, "
    "n AS redaction_count, kinds AS redacted_types FROM m"
)

# --- calls ------------------------------------------------------------------


def _call_ctes(detect: bool = False, spans=_whole) -> str:
    """``redacted(call_id, block_idx, type, body, n, kinds)`` per block, then
    ``totals(call_id, redaction_count, redacted_types)`` per call."""
    ctes = f"{_CALLS}, {masks('blocks', 'm')}"
    if not detect:
        per_kind = ", ".join(f"CASE WHEN is_error THEN 0 ELSE n_{k} END AS n_{k}" for k in _KINDS)
        shown = f"""redacted AS (
  SELECT call_id, block_idx, is_error, type, data,
    CASE WHEN is_error THEN text ELSE value END AS text,
    CASE WHEN is_error THEN 0 ELSE n END AS n,
    CASE WHEN is_error THEN '' ELSE kinds END AS kinds, {per_kind} FROM m)"""
        ctes = f"{ctes}, {shown}"
    else:
        # The spare part of the key names the block of a call.
        ctes = f"""{ctes},
keyed AS (SELECT call_id * 100000 + block_idx AS k, value AS text, profile_name, is_error FROM m
  WHERE type = 'text'),
{spans('keyed')}, {_entities()},
allowed AS (
  SELECT ents.* FROM ents JOIN keyed USING (k) WHERE NOT is_error
    AND (profile_name = 'full' OR (profile_name = 'GDPR' AND type = 'NAME'))),
{_applied().replace('FROM ents WHERE', 'FROM allowed WHERE', 1)},
redacted AS (
  SELECT m.call_id, m.block_idx, m.is_error, m.type, m.data,
    CASE WHEN m.is_error THEN m.text ELSE coalesce(w.value, m.value) END AS text,
    CASE WHEN m.is_error THEN 0 ELSE m.n + coalesce(w.n, 0) END AS n,
    CASE WHEN m.is_error THEN '' ELSE {_join_kinds('m.kinds', "coalesce(w.kinds, '')")} END AS kinds
  FROM m LEFT JOIN whole w ON w.k = m.call_id * 100000 + m.block_idx)"""
    return f"""{ctes},
kind_rows AS (
  SELECT call_id, block_idx, unnest(string_split(kinds, ',')) AS kind,
    generate_subscripts(string_split(kinds, ','), 1) AS place FROM redacted WHERE kinds <> ''),
call_kinds AS (
  SELECT call_id, string_agg(kind, ',' ORDER BY first_at) AS kinds
  FROM (SELECT call_id, kind, min(block_idx * 100 + place) AS first_at FROM kind_rows GROUP BY call_id, kind)
  GROUP BY call_id),
totals AS (
  SELECT c.call_id, CAST(coalesce(s.n, 0) AS BIGINT) AS redaction_count,
    coalesce(k.kinds, '') AS redacted_types
  FROM calls c LEFT JOIN (SELECT call_id, sum(n) AS n FROM redacted GROUP BY call_id) s USING (call_id)
  LEFT JOIN call_kinds k USING (call_id))"""


_BODIES = """SELECT c.call_id, CASE WHEN no_content THEN CAST(-1 AS BIGINT) ELSE CAST(len(lines) AS BIGINT) END AS n_blocks,
  CASE WHEN no_content THEN NULL ELSE coalesce(b.body, '') END AS body, is_error, redaction_count, redacted_types
FROM calls c JOIN totals t USING (call_id)
LEFT JOIN (SELECT call_id, string_agg(type || ':' || coalesce(text, data), chr(10) ORDER BY block_idx) AS body
  FROM redacted GROUP BY call_id) b USING (call_id)"""

ORACLE["text_blocks_only"] = (
    f"WITH {_call_ctes()} SELECT call_id, block_idx, type, text, data FROM redacted "
    f"UNION ALL {_EMPTY_CALLS.format(more='')}"
)
ORACLE["error_passthrough"] = f"WITH {_call_ctes()} {_BODIES}"
ORACLE["legacy_passthrough"] = (
    f"WITH {_call_ctes()} SELECT call_id, no_content AS legacy, "
    "CASE WHEN no_content THEN CAST(-1 AS BIGINT) ELSE CAST(len(lines) AS BIGINT) END AS n_blocks, "
    "redaction_count, redacted_types FROM calls JOIN totals USING (call_id)"
)
ORACLE["redact_calls"] = _recursive(_call_ctes(detect=True), _BODIES)
ORACLE["redact_calls_joined"] = _recursive(_call_ctes(detect=True, spans=_chunks), _BODIES)
ORACLE["audit_stats_attach"] = (
    f"WITH {_call_ctes()} SELECT call_id, tool_name, redaction_count, redacted_types "
    "FROM calls JOIN totals USING (call_id)"
)
ORACLE["merge_blocks"] = (
    f"WITH {_call_ctes()} SELECT call_id, redaction_count, redacted_types FROM totals "
    "WHERE call_id IN (SELECT call_id FROM blocks WHERE NOT is_error AND type = 'text')"
)

# --- resources --------------------------------------------------------------

ORACLE["blob_passthrough"] = (
    f"WITH {_RESOURCES}, {masks('resources', 'm')} "
    "SELECT page_id, CAST(item_idx AS BIGINT) AS item_idx, value AS text, blob FROM m"
)

ORACLE["redact_resources"] = _recursive(
    f"""{_RESOURCES}, {masks('resources', 'm')},
keyed AS (SELECT page_id * 2 + item_idx AS k, value AS text, profile_name FROM m WHERE text IS NOT NULL),
{_whole('keyed')}, {_entities()},
allowed AS (SELECT ents.* FROM ents JOIN keyed USING (k)
  WHERE profile_name = 'full' OR (profile_name = 'GDPR' AND type = 'NAME')),
{_applied().replace('FROM ents WHERE', 'FROM allowed WHERE', 1)}""",
    "SELECT page_id, CAST(item_idx AS BIGINT) AS item_idx, mime_type, coalesce(w.value, m.value) AS text, "
    "blob FROM m LEFT JOIN whole w ON w.k = page_id * 2 + item_idx",
)

# --- look-ups and profiles --------------------------------------------------

_GDPR_TYPES = "NAME,ADDRESS,DATE_TIME,PASSPORT_NUMBER,DRIVER_ID"
_ALL_TYPES = (
    "NAME,ADDRESS,DATE_TIME,AGE,USERNAME,PASSWORD,IP_ADDRESS,BANK_ACCOUNT_NUMBER,"
    "PASSPORT_NUMBER,DRIVER_ID,AWS_ACCESS_KEY,MAC_ADDRESS"
)
_PROFILES = f"""known AS (SELECT * FROM (VALUES
  ('GDPR', true, true, '{_GDPR_TYPES}'), ('DORA', true, false, '{_ALL_TYPES}'),
  ('PCI_DSS', true, false, '{_ALL_TYPES}'), ('full', true, true, '{_ALL_TYPES}')
) t(name, stage1, stage2, entity_types))"""

ORACLE["profile_lookup"] = (
    f"WITH {_CALLS}, {_PROFILES} SELECT call_id, profile, name AS profile_name, stage1, stage2, "
    "entity_types, profile = 'UNKNOWN' AS profile_fallback "
    "FROM calls JOIN known ON name = profile_name"
)
ORACLE["profiles"] = (
    f"WITH {_CALLS}, {_PROFILES} SELECT name, stage1, stage2, entity_types, "
    "count(call_id) AS n_calls, count(*) FILTER (profile = 'UNKNOWN') AS n_fallback "
    "FROM known LEFT JOIN calls ON name = profile_name GROUP BY ALL"
)


def _profiled(gate: str, rules: tuple, applied: str, chunks=_whole) -> str:
    return f"""{_DOC_MASKED}, {chunks('docs')}, {_entities(rules)},
gate AS (SELECT doc_id AS k, {gate} AS profile FROM documents),
allowed AS (SELECT ents.* FROM ents JOIN gate USING (k) WHERE {applied}),
{_applied().replace('FROM ents WHERE', 'FROM allowed WHERE', 1)}"""


ORACLE["redact_by_profile"] = _recursive(
    _profiled(
        "['GDPR', 'DORA', 'PCI_DSS', 'full', 'GDPR'][doc_id % 5 + 1]",
        _RULES,
        "profile = 'full' OR (profile = 'GDPR' AND type = 'NAME')",
    ),
    f"SELECT k AS doc_id, profile AS profile_name, w.value AS text, m.n + w.n AS redaction_count, "
    f"{_join_kinds('m.kinds', 'w.kinds')} AS redacted_types "
    "FROM m JOIN whole w USING (k) JOIN gate USING (k)",
)
# Observed: a text in which anything is found is joined again from its chunks.
ORACLE["redact_by_profile_parity"] = _recursive(
    _profiled(
        "['GDPR', 'DORA', 'PCI_DSS', 'full', 'GDPR'][doc_id % 5 + 1]",
        _RULES,
        "profile IN ('full', 'GDPR')",
        _chunks_parity,
    ),
    "SELECT m.k AS doc_id, profile AS profile_name, CASE WHEN w.n > 0 THEN w.value ELSE m.value END AS text, "
    f"m.n + w.n AS redaction_count, {_join_kinds('m.kinds', 'w.kinds')} AS redacted_types "
    "FROM m JOIN whole w USING (k) JOIN gate USING (k)",
)
ORACLE["stage_gate"] = _recursive(
    _profiled(
        "['GDPR', 'DORA', 'PCI_DSS', 'full', 'off'][doc_id % 5 + 1]",
        _RULES[:1],
        "profile = 'full'",
    ),
    "SELECT k AS doc_id, profile, CASE WHEN profile = 'off' THEN raw.text ELSE w.value END AS text, "
    "CASE WHEN profile = 'off' THEN 0 ELSE m.n + w.n END AS redaction_count, "
    f"CASE WHEN profile = 'off' THEN '' ELSE {_join_kinds('m.kinds', 'w.kinds')} END AS redacted_types "
    "FROM m JOIN whole w USING (k) JOIN gate USING (k) JOIN raw USING (k)",
)

# --- counts, masks ----------------------------------------------------------

_MASKED_TEXTS = f"WITH {_TEXTS}, {masks('texts', 'm')}"

ORACLE["redaction_count"] = f"{_MASKED_TEXTS} SELECT text_id, n AS redaction_count FROM m"
ORACLE["redacted_types"] = f"{_MASKED_TEXTS} SELECT text_id, kinds AS redacted_types FROM m"
ORACLE["redact_text"] = (
    f"{_MASKED_TEXTS} SELECT text_id, value AS text, n AS redaction_count, kinds AS redacted_types, "
    + ", ".join(f"n_{k}" for k in _KINDS)
    + " FROM m"
)
for _kind in _KINDS:
    ORACLE[f"mask_{_kind}"] = (
        f"WITH {_TEXTS}, {_one_mask(_kind, 'texts', 'm', 'text', 'value')} "
        "SELECT text_id, value AS text, CAST(n_value AS BIGINT) AS redaction_count FROM m"
    )
ORACLE["luhn_valid"] = (
    f"WITH {_TEXTS}, found AS (SELECT text_id, regexp_extract_all(text, '{_CARD}') AS ms FROM texts), "
    "single AS (SELECT text_id, unnest(ms) AS m, generate_subscripts(ms, 1) AS i FROM found) "
    f"SELECT text_id, i - 1 AS ordinal, {_digits('m')} AS digits, {_luhn('m')} AS valid FROM single"
)
ORACLE["iban_min_len"] = (
    f"WITH {_CUSTOMERS}, coded AS (SELECT c_custkey, "
    "left(iban || 'ABCDEFGH12345678', CAST(c_custkey % 27 + 8 AS BIGINT)) AS code FROM customers) "
    "SELECT c_custkey, 'to ' || CASE WHEN length(code) >= 15 THEN left(code, 4) || '****' || right(code, 4) "
    "ELSE code END AS text, CAST(length(code) >= 15 AS BIGINT) AS redaction_count FROM coded"
)
ORACLE["truncate_input"] = (
    f"WITH {_TEXTS} SELECT text_id, CASE WHEN length(text) > 500 "
    "THEN left(text, 500) || '...[truncated]' ELSE text END AS input_parameters FROM texts"
)

# --- nested values ----------------------------------------------------------

_LEAVES = f"""{_CUSTOMERS},
leaves AS (
  SELECT c_custkey AS k, unnest([
    {{'p': 1, 't': email}}, {{'p': 2, 't': ssn}},
    {{'p': 3, 't': email}}, {{'p': 5, 't': 'alt.' || email}},
    {{'p': 6, 't': phone}}, {{'p': 7, 't': iban}},
    {{'p': 8, 't': card}}, {{'p': 9, 't': 'ref ' || ssn || ' ' || email}}, {{'p': 11, 't': c_name}}
  ]) AS leaf FROM customers),
flat AS (SELECT k, leaf.p AS p, leaf.t AS text FROM leaves)"""


def _record(first: int, last: int) -> str:
    """``r``: one row per customer with leaves first..last masked as v1.., totals."""
    values = ", ".join(
        f"max(value) FILTER (p = {p}) AS v{p}" for p in range(first, last + 1)
    )
    return f"""{_LEAVES}, part AS (SELECT * FROM flat WHERE p BETWEEN {first} AND {last}),
{masks('part', 'm')},
kind_rows AS (
  SELECT k, p, unnest(string_split(kinds, ',')) AS kind,
    generate_subscripts(string_split(kinds, ','), 1) AS place FROM m WHERE kinds <> ''),
kind_lists AS (
  SELECT k, string_agg(kind, ',' ORDER BY first_at) AS kinds
  FROM (SELECT k, kind, min(p * 100 + place) AS first_at FROM kind_rows GROUP BY k, kind) GROUP BY k),
r AS (
  SELECT c_custkey, c_custkey AS id, c_acctbal, v.email AS raw_email, x.*, coalesce(kinds, '') AS redacted_types
  FROM customers v JOIN (SELECT k, {values}, CAST(sum(n) AS BIGINT) AS redaction_count
    FROM m GROUP BY k) x ON x.k = c_custkey LEFT JOIN kind_lists l ON l.k = c_custkey)"""


ORACLE["record_totals"] = (
    f"WITH {_record(1, 11)} SELECT c_custkey, redaction_count, redacted_types FROM r"
)
ORACLE["redact_struct"] = (
    f"WITH {_record(1, 2)} SELECT c_custkey, id, v1 AS email, v2 AS ssn, redaction_count, "
    "redacted_types FROM r"
)
ORACLE["redact_array"] = (
    f"WITH {_record(3, 5)} SELECT c_custkey, CAST(3 AS BIGINT) AS n_emails, "
    "v3 || '|null|' || v5 AS emails, redaction_count, redacted_types FROM r"
)
ORACLE["redact_map"] = (
    f"WITH {_record(6, 7)} SELECT c_custkey, raw_email || '|iban' AS attr_names, "
    "v6 || '|' || v7 AS attr_values, redaction_count, redacted_types FROM r"
)
ORACLE["redact_table"] = (
    f"WITH {_record(1, 11)} SELECT c_custkey, c_acctbal AS balance, c_acctbal > 0 AS active, "
    "v1 AS email, v2 AS ssn, v3 || '|null|' || v5 AS emails, raw_email || '|iban' AS attr_names, "
    "v6 || '|' || v7 AS attr_values, v8 || '|null' AS cards, v9 || '|' || v11 AS notes, "
    "c_acctbal AS amount, CAST(NULL AS VARCHAR) AS nothing, redaction_count, redacted_types FROM r"
)
ORACLE["primitive_passthrough"] = (
    "SELECT event_id, ts, user_id, event_type, value, props, value > 10 AS active, 4111111111111111 AS card_number, "
    "CAST(NULL AS VARCHAR) AS nothing, CAST(0 AS BIGINT) AS redaction_count, '' AS redacted_types FROM events"
)
ORACLE["redact_json"] = f"""WITH {_CUSTOMERS},
leaves AS (
  SELECT c_custkey AS k, unnest([{{'p': 1, 't': email}}, {{'p': 2, 't': ssn}}, {{'p': 3, 't': card}},
    {{'p': 4, 't': phone}}]) AS leaf FROM customers),
flat AS (SELECT k, leaf.p AS p, leaf.t AS text FROM leaves), {masks('flat', 'm')},
r AS (
  SELECT k, max(value) FILTER (p = 1) AS email, max(value) FILTER (p = 2) AS ssn,
    max(value) FILTER (p = 3) AS card, max(value) FILTER (p = 4) AS phone,
    CAST(sum(n) AS BIGINT) AS n, string_agg(nullif(kinds, ''), ',' ORDER BY p) AS kinds FROM m GROUP BY k)
SELECT 'customer:' || k AS doc_id, '{{"id": ' || k || ', "user": {{"email": "' || email || '", "ssn": "' || ssn
  || '"}}, "cards": ["' || card || '", null, 4111111111111111], "amount": 1500.0, "x@y.zz": "' || phone || '"}}' AS doc,
  n AS redaction_count, kinds AS redacted_types FROM r
UNION ALL SELECT 'event:' || event_id, props, CAST(0 AS BIGINT), '' FROM events"""

# --- entity stage -----------------------------------------------------------

_ENTITY_SELECT = (
    "SELECT k AS doc_id, chunk_idx, ordinal, type, b AS begin, e AS \"end\" FROM ents"
)
ORACLE["chunk_text"] = _recursive(
    _DOC_CHUNKS, "SELECT k AS doc_id, chunk_idx, text, sep, start FROM chunks"
)
ORACLE["detect_entities"] = _recursive(_DOC_ENTITIES, _ENTITY_SELECT)
ORACLE["custom_detector"] = _recursive(
    f"{_DOC_CHUNKS}, {_entities(_RULES[:1])}", _ENTITY_SELECT
)
ORACLE["entity_filter"] = _recursive(
    _DOC_ENTITIES, f"{_ENTITY_SELECT} WHERE type IN ('IP_ADDRESS', 'NAME')"
)
ORACLE["entities_to_chunks"] = _recursive(
    _DOC_ENTITIES,
    "SELECT c.k AS doc_id, c.chunk_idx, coalesce(string_agg(ordinal || ':' || type || ':' || b || ':' || e, "
    "',' ORDER BY ordinal), '') AS spans FROM chunks c LEFT JOIN ents USING (k, chunk_idx) GROUP BY ALL",
)
ORACLE["spans_desc"] = _recursive(
    _DOC_ENTITIES,
    "SELECT k AS doc_id, chunk_idx, row_number() OVER (PARTITION BY k, chunk_idx ORDER BY b DESC, ordinal) - 1 "
    "AS place, type, b AS begin, e AS \"end\" FROM ents",
)
ORACLE["prefilter_contains"] = _recursive(
    f"{_DOC_CHUNKS}, {_entities(_RULES[:1])}",
    "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT k FROM ents)",
)
ORACLE["apply_spans"] = _recursive(
    f"{_DOC_ENTITIES}, {_applied()}",
    "SELECT d.k AS doc_id, d.chunk_idx, d.value AS text, d.n AS redaction_count, "
    "coalesce(kinds, '') AS redacted_types FROM done d LEFT JOIN chunk_kinds USING (k, chunk_idx)",
)
ORACLE["merge_chunks"] = _recursive(
    f"{_DOC_ENTITIES}, {_applied()}",
    "SELECT k AS doc_id, n AS redaction_count, kinds AS redacted_types FROM whole",
)
ORACLE["reassemble"] = f"WITH {_TEXTS} SELECT * FROM texts"
ORACLE["redact_entities_text"] = _recursive(
    f"{_DOC_WHOLE}, {_applied()}",
    "SELECT k AS doc_id, value AS text, n AS redaction_count, kinds AS redacted_types FROM whole",
)
ORACLE["redact_entities_table"] = _recursive(
    f"""docs AS (
  SELECT doc_id * 1000000 AS k, text FROM documents UNION ALL
  SELECT doc_id * 1000000 + i, line FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i
    FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
{_whole('docs')}, {_entities()}, {_applied()},
parts AS (SELECT k // 1000000 AS doc_id, k % 1000000 AS p, value, n, kinds FROM whole),
kind_rows AS (
  SELECT doc_id, p, unnest(string_split(kinds, ',')) AS kind,
    generate_subscripts(string_split(kinds, ','), 1) AS place FROM parts WHERE kinds <> ''),
kind_lists AS (
  SELECT doc_id, string_agg(kind, ',' ORDER BY first_at) AS kinds
  FROM (SELECT doc_id, kind, min(p * 100 + place) AS first_at FROM kind_rows GROUP BY doc_id, kind) GROUP BY doc_id),
r AS (
  SELECT doc_id, max(value) FILTER (p = 0) AS body, string_agg(value, chr(10) ORDER BY p) FILTER (p > 0) AS lines,
    CAST(sum(n) AS BIGINT) AS n FROM parts GROUP BY doc_id)""",
    "SELECT d.doc_id, r.body, d.lang, r.lines, d.source, r.n AS redaction_count, "
    "coalesce(kinds, '') AS redacted_types FROM documents d JOIN r USING (doc_id) LEFT JOIN kind_lists USING (doc_id)",
)
ORACLE["redact_deep"] = _recursive(_deep(), _DEEP_SELECT)
ORACLE["redact_deep_joined"] = _recursive(
    f"{_DOC_MASKED}, {_chunks('docs')}, {_entities()}, {_applied()}", _DEEP_SELECT
)
ORACLE["redact_deep_long_lines"] = _recursive(
    f"""raw AS (
  SELECT 'pages:' || page_id AS k, html AS text FROM pages
  UNION ALL SELECT 'documents:' || doc_id, replace(text, chr(10), ' ') FROM documents), {masks('raw', 'm')},
docs AS (SELECT k, value AS text FROM m), {_whole('docs')}, {_entities()}, {_applied()}""",
    _DEEP_SELECT.replace("m.k AS doc_id", "m.k AS text_id"),
)
ORACLE["detect_entities_long_lines"] = f"""WITH chunks AS (
  SELECT 'spaces:' || doc_id AS k, 0 AS chunk_idx, replace(text, chr(10), ' ') AS text FROM documents
  UNION ALL SELECT 'none:' || doc_id, 0, replace(replace(text, chr(10), ' '), ' ', '-') FROM documents), {_entities()}
SELECT k AS text_id, type, b AS begin, e AS "end" FROM ents"""
ORACLE["redact_deep_narrow_kinds"] = _recursive(_deep(_RULES[:1]), _DEEP_SELECT)
# Overlapping spans as islands: a span begins one if all before it, by begin and rule, have ended.
ORACLE["apply_spans_overlap"] = _recursive(
    f"""{_DOC_CHUNKS}, {_entities((("NAME", r"\b[A-Z][a-z]+ [a-z]+\b"), ("ADDRESS", "[a-z]+ [a-z]+[.]")))},
led AS (
  SELECT *, coalesce(max(e) OVER (PARTITION BY k, chunk_idx ORDER BY b, ordinal
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ents),
islanded AS (
  SELECT *, sum(CASE WHEN b >= before THEN 1 ELSE 0 END) OVER (PARTITION BY k, chunk_idx ORDER BY b, ordinal
    ROWS UNBOUNDED PRECEDING) AS island FROM led),
islands AS (
  SELECT k, chunk_idx, island, arg_min(type, ordinal) FILTER (WHERE b >= before) AS type, min(b) AS b, max(e) AS e
  FROM islanded GROUP BY k, chunk_idx, island),
parts AS (
  SELECT i.k, i.chunk_idx, i.b, i.e, substr(c.text, lag_e + 1, i.b - lag_e) || '[REDACTED:' || type || ']' AS part
  FROM (SELECT *, coalesce(lag(e) OVER (PARTITION BY k, chunk_idx ORDER BY b), 0) AS lag_e FROM islands) i
    JOIN chunks c USING (k, chunk_idx)),
heads AS (
  SELECT k, chunk_idx, string_agg(part, '' ORDER BY b) AS head, max(e) AS last_e, count(*) AS n
  FROM parts GROUP BY k, chunk_idx)""",
    "SELECT c.k AS doc_id, c.chunk_idx, CASE WHEN n IS NULL THEN c.text ELSE head || substr(c.text, last_e + 1) END AS text, "
    "coalesce(n, 0) AS redaction_count FROM chunks c LEFT JOIN heads h ON h.k = c.k AND h.chunk_idx = c.chunk_idx",
)
ORACLE["redact_json_deep"] = _recursive(
    _deep(),
    "SELECT m.k AS doc_id, w.value AS text, n_chars AS n, true AS key_kept, m.n + w.n AS redaction_count, "
    f"{_join_kinds('m.kinds', 'w.kinds')} AS redacted_types "
    "FROM m JOIN whole w USING (k) JOIN documents d ON d.doc_id = m.k",
)
ORACLE["redact_variant"] = _recursive(
    _deep(),
    "SELECT m.k AS doc_id, w.value AS text, n_chars, source, lang, m.n + w.n AS redaction_count, "
    f"{_join_kinds('m.kinds', 'w.kinds')} AS redacted_types "
    "FROM m JOIN whole w USING (k) JOIN documents d ON d.doc_id = m.k",
)
ORACLE["merge_custom_kinds"] = _recursive(
    f"""{_DOC_CHUNKS}, {_entities((("SHOUT", chr(92) + "b[A-Z]{6,12}" + chr(92) + "b"), ("DIGITS", "[0-9]{3,}")))}, {_applied()}""",
    "SELECT k AS doc_id, n AS redaction_count, kinds AS redacted_types FROM whole",
)
ORACLE["chunk_text_parity"] = _recursive(
    f"{_DOCS}, {_chunks_parity('docs')}", "SELECT k AS doc_id, chunk_idx, text, sep FROM chunks"
)
ORACLE["merge_stages"] = _recursive(
    _deep(),
    "SELECT m.k AS doc_id, m.n + w.n AS redaction_count, "
    f"{_join_kinds('m.kinds', 'w.kinds')} AS redacted_types FROM m JOIN whole w USING (k)",
)
ORACLE["custom_detector_deep"] = _recursive(_deep(_RULES[:1]), _DEEP_SELECT)

# --- audit ------------------------------------------------------------------


def _audit(arguments: str = "arguments", raw: bool = False) -> str:
    """``audit``: one record per call; ``raw`` logs parameters and failures as they are."""
    logged, message = ("pm.text", "fm.text") if raw else ("pm.value", "fm.value")
    return f"""{_call_ctes()},
params AS (SELECT call_id, coalesce({arguments}, '{{}}') AS text FROM calls), {masks('params', 'pm')},
messages AS (SELECT call_id, failure AS text FROM calls), {masks('messages', 'fm')},
sizes AS (
  SELECT call_id, string_agg(CASE WHEN type = 'text' THEN '{{"type":"text","text":' || to_json(text) || '}}'
    ELSE '{{"type":"image","data":' || to_json(data) || ',"mimeType":"image/png"}}' END, ',' ORDER BY block_idx) AS body
  FROM redacted GROUP BY call_id),
audit AS (
  SELECT call_id, strftime(make_timestamp(finished_ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp,
    tool_name AS upstream_tool, profile_name AS compliance_profile,
    CASE WHEN length({logged}) > 500 THEN left({logged}, 500) || '...[truncated]' ELSE {logged} END AS input_parameters,
    finished_ms - started_ms AS execution_time_ms,
    CAST(CASE WHEN failure IS NOT NULL THEN 0 ELSE strlen('{{'
      || CASE WHEN no_content THEN '' ELSE '"content":[' || coalesce(body, '') || '],' END
      || '"isError":' || CASE WHEN is_error THEN 'true' ELSE 'false' END || '}}') END AS BIGINT) AS output_size_bytes,
    redaction_count, redacted_types,
    CASE WHEN failure IS NOT NULL OR is_error THEN 'error' ELSE 'success' END AS status,
    {message} AS error_message
  FROM calls JOIN totals USING (call_id) JOIN pm USING (call_id) JOIN fm USING (call_id)
  LEFT JOIN sizes USING (call_id))"""


_AUDIT_FIELDS = (
    "timestamp, upstream_tool, compliance_profile, input_parameters, execution_time_ms, "
    "output_size_bytes, redaction_count, redacted_types, status, error_message"
)
ORACLE["audit_base"] = (
    f"WITH {_audit()} SELECT call_id, timestamp, upstream_tool, compliance_profile, "
    "input_parameters, execution_time_ms FROM audit"
)
ORACLE["audit_success"] = (
    f"WITH {_audit()} SELECT call_id, output_size_bytes, redaction_count, redacted_types, status FROM audit"
)
ORACLE["audit_failed"] = (
    f"WITH {_audit()} SELECT call_id, status, error_message IS NOT NULL AS failed, "
    "coalesce(error_message, '') AS error_message FROM audit"
)
ORACLE["audit_log"] = f"WITH {_audit()} SELECT call_id, {_AUDIT_FIELDS} FROM audit"
ORACLE["audit_log_parity"] = f"WITH {_audit(raw=True)} SELECT call_id, {_AUDIT_FIELDS} FROM audit"
ORACLE["audit_jsonl"] = (
    f"WITH {_audit()} SELECT '{{\"timestamp\":\"' || timestamp || '\",\"upstream_tool\":' || to_json(upstream_tool) "
    "|| ',\"compliance_profile\":' || to_json(compliance_profile) || ',\"input_parameters\":' || to_json(input_parameters) "
    "|| ',\"execution_time_ms\":' || execution_time_ms || ',\"output_size_bytes\":' || output_size_bytes "
    "|| ',\"redaction_count\":' || redaction_count || ',\"redacted_types\":[' "
    "|| CASE WHEN redacted_types = '' THEN '' ELSE '\"' || replace(redacted_types, ',', '\",\"') || '\"' END "
    "|| '],\"status\":\"' || status || '\"' "
    "|| CASE WHEN error_message IS NULL THEN '' ELSE ',\"error_message\":' || to_json(error_message) END || '}' "
    "AS line FROM audit"
)
ORACLE["audit_enabled"] = (
    "SELECT true AS enabled, count(*) AS n_lines FROM documents UNION ALL SELECT false, 0"
)
# A cached answer for every 19th call; a failure is an error result of one text block.
ORACLE["middleware_chain"] = (
    f"""WITH {_audit("arguments || ' via gate@example.com'")}, sized AS (
  SELECT a.*, CASE WHEN c.failure IS NULL THEN output_size_bytes ELSE CAST(strlen('{{"content":[{{"type":"text","text":'
    || to_json(error_message) || '}}],"isError":true}}') AS BIGINT) END AS bytes
  FROM audit a JOIN calls c USING (call_id)) """
    "SELECT call_id, CASE WHEN call_id % 19 = 0 THEN 'cached' ELSE input_parameters END AS input_parameters, "
    "CASE WHEN call_id % 19 = 0 THEN 0 ELSE redaction_count END AS redaction_count, "
    "CASE WHEN call_id % 19 = 0 THEN 'CACHED' ELSE upper(status) END AS status, "
    "CASE WHEN call_id % 19 = 0 THEN -1 ELSE bytes END AS output_size_bytes, false AS failed FROM sized"
)
ORACLE["custom_writer"] = (
    f"WITH {_audit()} SELECT call_id, upstream_tool, redaction_count, status FROM audit"
)

# --- streams: the batch twin ------------------------------------------------

ORACLE["stream_redact"] = (
    f"WITH {masks('documents', 'm')} SELECT doc_id, value AS text, n AS redaction_count, "
    "kinds AS redacted_types FROM m"
)
ORACLE["stream_audit"] = ORACLE["audit_jsonl"]
ORACLE["stream_audit_once"] = ORACLE["audit_jsonl"]
ORACLE["stream_redact_deep"] = ORACLE["redact_deep"]

# --- reports ----------------------------------------------------------------


def _findings(keys: str = "text_id") -> str:
    """Matches per kind in that kind's input, and their masks from parts of them."""
    parts = []
    shown = {
        "credit_card": _card_mask("m"),
        "iban": "left(m, 4) || '****' || right(m, 4)",
        "ssn": "'***-**-****'",
        "email": "left(m, 1) || '***@' || split_part(m, '@', 2)",
        "phone": f"'+' || left({_digits('m')}, 2) || '***' || right({_digits('m')}, 2)",
    }
    for i, kind in enumerate(_KINDS):
        pattern = _CARD if kind == "credit_card" else _REPLACE[kind][0]
        source = "text" if i == 0 else f"value_{i}"
        found = f"regexp_extract_all({source}, '{pattern}')"
        if kind == "credit_card":
            found = f"list_filter({found}, lambda m: {_luhn('m')})"
        parts.append(
            f"SELECT {keys}, '{kind}' AS type, i - 1 AS ordinal, {shown[kind]} AS masked FROM "
            f"(SELECT {keys}, unnest(ms) AS m, generate_subscripts(ms, 1) AS i FROM "
            f"(SELECT {keys}, {found} AS ms FROM m))"
        )
    return " UNION ALL ".join(parts)


ORACLE["pii_findings"] = f"{_MASKED_TEXTS} {_findings()}"
_LEAVES = """leaves AS (
  SELECT doc_id, 'page.lang' AS path, lang AS text FROM documents
  UNION ALL SELECT doc_id, 'page.body', text FROM documents
  UNION ALL SELECT doc_id, 'lines[' || (i - 1) || ']', line FROM (
    SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (
      SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
  UNION ALL SELECT doc_id, 'tags[source]', source FROM documents)"""
ORACLE["pii_findings_deep"] = (
    f"WITH {_LEAVES}, {masks('leaves', 'm')} {_findings('doc_id, path')}"
)


def _summary(by: str, source: str) -> str:
    """Rows and redactions of each kind by group, from one count per kind."""
    parts = [
        f"SELECT {by}, '{k}' AS type, count(*) AS n_rows, CAST(sum(n_{k}) AS BIGINT) AS n_redactions "
        f"FROM {source} WHERE n_{k} > 0 GROUP BY ALL"
        for k in _KINDS
    ]
    none = " AND ".join(f"coalesce(n_{k}, 0) = 0" for k in _KINDS)
    parts.append(
        f"SELECT {by}, NULL AS type, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_redactions "
        f"FROM {source} WHERE {none} GROUP BY ALL"
    )
    return " UNION ALL ".join(parts)


ORACLE["redaction_summary"] = f"WITH {masks('documents', 'm')} " + _summary("source", "m")
_SUMS = ", ".join(f"sum(n_{k}) AS n_{k}" for k in _KINDS)
ORACLE["audit_summary"] = (
    f"WITH {_audit()}, named AS (SELECT compliance_profile, status, s.* EXCLUDE (call_id) FROM audit "
    f"LEFT JOIN (SELECT call_id, {_SUMS} FROM redacted GROUP BY call_id) s USING (call_id)) "
    + _summary("compliance_profile, status", "named")
)
