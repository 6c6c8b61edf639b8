"""SQL that says what some of the queries return."""

from math import log2

from tidemark.llm import secrets as s

_BLANK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

WARC = """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
    d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
    h AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS holder FROM d)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN holder IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN holder IS DISTINCT FROM page_id THEN holder END AS refers_to
    FROM h
"""

#: Pages without redirects or canonical links have no aliases: the rules alone decide.
URLS = """
    WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                      coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, url, coalesce(html, '') AS html FROM pages),
    rules AS (SELECT * FROM (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')) t(rh, rp, v)),
    fits AS (SELECT u.page_id, host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
             FROM u JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL)
    SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.v, 'allow') AS verdict FROM u LEFT JOIN (SELECT DISTINCT page_id, rule, v FROM fits) f USING (page_id)
"""

EMBEDDINGS = """
    WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
    n AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND list_dot_product(a.v, b.v) >= 0.95),
    reach(a, b) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
    k AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
    SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN k USING (vec_id)
"""

CONTAMINATION = f"""
    WITH docs AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_BLANK}'), lambda w: w <> '') AS w FROM documents),
    items AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_BLANK}'), lambda w: w <> '') AS w FROM benchmark),
    windows AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - least(13, len(w)), 0) + 2)) AS i FROM items WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT k FROM windows),
    grams AS (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, sizes WHERE len(w) >= k)),
    hits AS (SELECT doc_id, i, k, item_id FROM grams JOIN windows USING (k, g)),
    words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hits)) GROUP BY doc_id),
    found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def _secrets() -> str:
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    weights = "[" + ", ".join(str(round(c * log2(c) * s.UNIT) if c else 0) for c in range(s.WINDOW + 1)) + "]"
    limit = lambda kind: round((log2(s.WINDOW) - s.CLASSES[kind][2]) * s.WINDOW * s.UNIT)

    def located(name: str, pattern: str) -> str:
        return f"""{name} AS (
          SELECT doc_id, m[i] AS v, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s
          FROM (SELECT doc_id, p, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, string_split_regex(t, {quote(pattern)}) AS p, regexp_extract_all(t, {quote(pattern)}) AS m FROM d)))"""

    allowed = " OR ".join(f"regexp_matches(v, {quote(p)})" for p in s.ALLOWED)
    ordered = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o, e)"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    {located('assigned', s.ASSIGN)}, {located('accessed', s.ACCESS)}, {located('hexed', s.HEX)}, {located('candidates', s.CANDIDATE)},
    base AS (
      SELECT doc_id, 'assign' AS kind, 0 AS o, s::BIGINT AS s, (s + length(v))::BIGINT AS e FROM assigned WHERE length(regexp_extract(v, {quote(s.ASSIGN)}, 1)) >= 12
      UNION ALL SELECT doc_id, 'access', 1, s::BIGINT, (s + length(v))::BIGINT FROM accessed UNION ALL SELECT doc_id, 'hex', 2, s::BIGINT, (s + length(v))::BIGINT FROM hexed),
    kept AS (SELECT doc_id, s, regexp_matches(v, '^[0-9A-Fa-f-]+$') AS h, CASE WHEN regexp_matches(v, '^[0-9A-Fa-f-]+$') THEN lower(v) ELSE v END AS v FROM candidates
             WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND NOT ({allowed})),
    windows AS (SELECT doc_id, s, h, j, v[j + 1 : j + {s.WINDOW}] AS w FROM (SELECT *, unnest(range(0, length(v) - {s.WINDOW - 1})) AS j FROM kept)),
    chars AS (SELECT doc_id, s, h, j, ch, count(*) AS c FROM (SELECT doc_id, s, h, j, unnest(string_split(w, '')) AS ch FROM windows) GROUP BY ALL),
    hot AS (SELECT doc_id, s, h, j FROM chars GROUP BY ALL HAVING sum({weights}[c + 1]) <= CASE WHEN h THEN {limit('entropy_hex')} ELSE {limit('entropy_text')} END),
    islands AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, s ORDER BY j) AS k FROM (SELECT *, CASE WHEN j - lag(j) OVER (PARTITION BY doc_id, s ORDER BY j) <= {s.WINDOW} THEN 0 ELSE 1 END AS fresh FROM hot)),
    more AS (SELECT doc_id, CASE WHEN h THEN 'entropy_hex' ELSE 'entropy_text' END AS kind, CASE WHEN h THEN 3 ELSE 4 END AS o, (s + min(j))::BIGINT AS s, (s + max(j) + {s.WINDOW})::BIGINT AS e FROM islands GROUP BY doc_id, islands.s, h, k),
    b AS (SELECT doc_id, sum(CAST(o = 0 AS INT))::BIGINT AS n_assign, sum(CAST(o = 1 AS INT))::BIGINT AS n_access, sum(CAST(o = 2 AS INT))::BIGINT AS n_hex, {ordered} AS x FROM base GROUP BY doc_id),
    a AS (SELECT doc_id, {ordered} AS x FROM (SELECT * FROM base UNION ALL SELECT * FROM more) GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b.x, '')) AS base_sha256, coalesce(a.x, '') AS spans
    FROM d LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)
    """


SECRETS = _secrets()


def _crc_table() -> list[int]:
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    return table


def _crc32(text: str) -> str:
    """SQL for the CRC-32 of an ASCII string."""
    step = f"lambda c, x: xor(c >> 8, ({_crc_table()}::BIGINT[])[(xor(c, x) & 255) + 1])"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT), {step}, 4294967295::BIGINT), 4294967295::BIGINT)"


#: A stretch with period q that is long enough holds two equal blocks of q words on end that start
#: at a multiple of q: only texts and lags with such blocks are looked at word by word.
PERIODS = f"""
    WITH w0 AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, {_crc32("doc_id::VARCHAR")} AS h FROM documents),
    w1 AS (SELECT doc_id, w, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, h // 10 AS g FROM w0),
    w2 AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM w1),
    words AS MATERIALIZED (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) END AS w FROM w2),
    ids AS MATERIALIZED (SELECT doc_id, n, list_transform(w, lambda x: hash(x)) AS v FROM words),
    lags AS (SELECT doc_id, n, v, unnest(range(1, n // 3 + 1)) AS q FROM ids),
    likely AS (SELECT doc_id, n, v, q FROM lags WHERE len(list_filter(range(0, n // q - 1), lambda b: v[b * q + 1] = v[(b + 1) * q + 1] AND v[b * q + 1 : (b + 1) * q] = v[(b + 1) * q + 1 : (b + 2) * q])) > 0),
    same AS (SELECT doc_id, q, i FROM (SELECT doc_id, q, v, unnest(range(1, n - q + 1)) AS i FROM likely) WHERE v[i] = v[i + q]),
    found AS (SELECT doc_id, q, min(i) - 1 AS s, count(*) + q AS l FROM (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same) GROUP BY doc_id, q, island
              HAVING count(*) + q >= greatest(24, 3 * q)),
    runs AS MATERIALIZED (SELECT doc_id, s, l, min(q) AS q FROM found GROUP BY doc_id, s, l),
    best AS (SELECT doc_id, s, l, q FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY l::DOUBLE / q DESC, s, q) = 1),
    told AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS x FROM runs GROUP BY doc_id),
    gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
    left_over AS (SELECT doc_id, string_agg(x, ' ' ORDER BY k.i) AS x FROM (SELECT doc_id, w[i + 1] AS x, i FROM (SELECT doc_id, w, unnest(range(0, n)) AS i FROM words)) k ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.s::BIGINT AS start, b.l::BIGINT AS length, b.q::BIGINT AS period, (1000 * b.l // b.q)::BIGINT AS exponent_milli,
           sha256(coalesce(t.x, '')) AS runs_sha256, sha256(coalesce(k.x, '')) AS collapsed_sha256
    FROM words d LEFT JOIN told t USING (doc_id) LEFT JOIN best b USING (doc_id) LEFT JOIN left_over k USING (doc_id)
"""

#: States of the grammar: 0 nothing yet, 1 a system row, 2 a user's row last, 3 an assistant's row last.
#: A step inserts k rows, which leads from a state to the next one, and takes a row.
REPAIR = f"""
    WITH RECURSIVE c0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations),
    c1 AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                  unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c0),
    c2 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
                  right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last FROM c1),
    r AS MATERIALIZED (SELECT coalesce(conv_id::VARCHAR, '') AS c, i, turn, role, text, CASE WHEN last = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
                  lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM c2),
    ins(p, k, q) AS (VALUES (0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 0, 3), (0, 1, 2), (1, 1, 2), (3, 1, 2), (2, 1, 3), (0, 2, 3), (1, 2, 3), (3, 2, 3), (2, 2, 2)),
    takes(q, t, z) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
    steps AS MATERIALIZED (
      SELECT c, i, p, q AS z, 5 * k + 2 AS cost, repeat('I', k) || 'D' AS edits FROM r, ins
      UNION ALL SELECT c, i, p, z, 5 * k + CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END + CASE WHEN left(role, 1) = t THEN 0 ELSE 1 END, repeat('I', k) || CASE WHEN left(role, 1) = t THEN 'K' ELSE 'R' END
      FROM r, ins JOIN takes USING (q) WHERE coalesce(fault, '') NOT IN ('blank', 'duplicate') AND (left(role, 1) = t OR t <> 's')),
    best(c, i, p, v) AS (
      SELECT DISTINCT c, 0::BIGINT, 0, {{'cost': 0, 'audit': ''}} FROM r
      UNION ALL SELECT s.c, s.i, s.z, min({{'cost': b.v.cost + s.cost, 'audit': b.v.audit || s.edits}}) FROM best b JOIN steps s ON s.c = b.c AND s.i = b.i + 1 AND s.p = b.p GROUP BY s.c, s.i, s.z),
    ends AS (SELECT c, max(i) AS n FROM r GROUP BY c),
    chosen AS MATERIALIZED (SELECT c, min({{'cost': v.cost + 5 * k, 'audit': v.audit || repeat('I', k)}}) AS v FROM best JOIN ends USING (c) JOIN ins USING (p) WHERE i = n AND q IN (0, 3) GROUP BY c),
    edits AS (SELECT c, j, substr(v.audit, j::INT, 1) AS e, length(replace(v.audit, 'D', '')) % 2 AS odd FROM (SELECT c, v, unnest(range(1, length(v.audit) + 1)) AS j FROM chosen)),
    placed AS (SELECT *, sum(CASE WHEN e <> 'I' THEN 1 ELSE 0 END) OVER w AS i, sum(CASE WHEN e <> 'D' THEN 1 ELSE 0 END) OVER w - 1 AS o FROM edits WINDOW w AS (PARTITION BY c ORDER BY j)),
    texts AS (SELECT c, string_agg(CASE WHEN e = 'K' THEN role WHEN (o - odd) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY o) AS x
              FROM placed LEFT JOIN r USING (c, i) WHERE e <> 'D' GROUP BY c),
    told AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                    count(*) FILTER (before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY c)
    SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
           coalesce(h.v.cost, 0)::BIGINT AS cost, coalesce(h.v.audit, '') AS audit, sha256(coalesce(x, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, '') AS c FROM conversations) a LEFT JOIN told USING (c) LEFT JOIN chosen h USING (c) LEFT JOIN texts USING (c)
"""
