"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op1_url_filter"] = r"""
WITH parts AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
rules(verdict, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'),
  ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/'))
SELECT page_id, host, path,
  (SELECT rhost || rpath FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
   ORDER BY length(rhost || rpath) DESC LIMIT 1) AS rule,
  coalesce((SELECT verdict FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
   ORDER BY length(rhost || rpath) DESC LIMIT 1), 'allow') AS verdict
FROM parts"""

_ASSIGN = r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)"


def _spans(number: int, kind: str, pattern: str, group: int, least: int) -> str:
    return f"""
  SELECT rid, {number} AS k, '{kind}' AS kind,
    list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda h: length(h))), 0) AS s,
    length(hits[i]) AS n
  FROM (SELECT rid, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (
    SELECT rid, regexp_extract_all(body, '{pattern}') AS hits, string_split_regex(body, '{pattern}') AS gaps FROM texts))
  WHERE length(regexp_extract(hits[i], '{pattern}', {group})) >= {least}"""


SQL["op4_secret_scan"] = (
    "WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents), found AS ("
    + " UNION ALL ".join(_spans(*x) for x in ((0, "assign", _ASSIGN, 2, 6), (1, "access", "AKIA[A-Z0-9]+", 0, 20), (2, "hex", "[0-9a-f]+", 0, 24)))
    + """), joined AS (
  SELECT rid, string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT), ',' ORDER BY s, k) AS spans,
    count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c
  FROM found GROUP BY rid)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN joined USING (rid)"""
)

SQL["op10_mixing"] = r"""
WITH light AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    (CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix'), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0 AS u
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM light GROUP BY source),
weighed AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight, source_size * 2 AS most FROM totals),
levels AS (SELECT *, row_number() OVER o AS place,
    (sum(source_size) OVER () * CAST(1.5 AS DOUBLE) - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW o AS (ORDER BY most / weight, source ASC NULLS LAST)),
firsts AS (SELECT *, min(CASE WHEN most > level * weight THEN place END) OVER () AS first FROM levels),
finals AS (SELECT *, max(CASE WHEN place = first THEN level END) OVER () AS final FROM firsts),
wanted AS (SELECT source, source_size, CASE WHEN place >= first THEN final * weight ELSE CAST(most AS DOUBLE) END AS target FROM finals),
kinds AS (SELECT l.source, kind, held, target, source_size FROM (SELECT source, greatest(64 - 4 * length(bin(size)), 8) AS kind, CAST(sum(size) AS BIGINT) AS held FROM light GROUP BY ALL) l
  JOIN wanted w ON l.source IS NOT DISTINCT FROM w.source),
lifted AS (SELECT *, row_number() OVER o AS place,
    (target - coalesce(sum(held) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2) / nullif(sum(held * kind) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS level
  FROM kinds WINDOW o AS (PARTITION BY source ORDER BY kind DESC)),
opened AS (SELECT *, min(CASE WHEN level * kind <= 2 THEN place END) OVER (PARTITION BY source) AS first FROM lifted),
levelled AS (SELECT *, max(CASE WHEN place = first THEN level END) OVER (PARTITION BY source) AS final FROM opened),
copied AS (SELECT *, CASE WHEN source_size = 0 THEN 0.0::DOUBLE WHEN first IS NULL OR place < first THEN 2.0::DOUBLE ELSE final * kind END AS e FROM levelled),
parts AS (SELECT source, kind, source_size, target, floor(e) AS whole, e - floor(e) AS part, target - sum(floor(e) * held) OVER (PARTITION BY source) AS lack FROM copied),
odds AS (SELECT l.*, p.* EXCLUDE (source), CASE WHEN part > 0 THEN (u / (1 - u)) / (part / (1 - part)) END AS q
  FROM light l JOIN parts p ON l.source IS NOT DISTINCT FROM p.source AND p.kind = greatest(64 - 4 * length(bin(size)), 8)),
mids AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2 AS mid FROM odds)
SELECT doc_id, size, source_size, target,
  CAST((whole + CASE WHEN q IS NOT NULL AND mid <= lack THEN 1 ELSE 0 END) AS BIGINT) * size AS taken,
  CAST((whole + CASE WHEN q IS NOT NULL AND mid <= lack THEN 1 ELSE 0 END) AS BIGINT) AS copies
FROM mids"""

SQL["op3_chat_format"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
sized AS (SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + 24 AS n FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""

SQL["op8_substring_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT rid, i, array_to_string(w[i:i + 34], ' ') AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
repeated AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY k) AS c FROM windows) WHERE c > 1),
gone AS (SELECT DISTINCT rid, i + o AS p FROM repeated, range(0, 35) r(o)),
words AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL["op9_decontamination"] = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS n FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths)),
found AS (SELECT rid, i, n, item_id FROM places JOIN windows USING (n, k)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM found) GROUP BY rid),
listed AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN listed USING (rid)"""


def _codebook_rounds(rounds: int) -> str:
    """CTEs book0 ... book<rounds> (p, e, v): the codebooks before each round and after the last."""
    near = "SELECT rid, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT w.rid, w.p, b.e, list_sum(list_transform(list_zip(w.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts w JOIN book{0} b USING (p)) GROUP BY rid, p"
    out = ["book0 AS (SELECT p, rid - 1 AS e, v FROM parts WHERE rid <= 64)"]
    for i in range(rounds):
        out.append(f"near{i} AS ({near.format(i)})")
        out.append(f"""means{i} AS (SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY j) AS v FROM (
  SELECT p, e, j, sum(x) AS s, count(*) AS n FROM (SELECT w.p, n.e, unnest(w.v) AS x, unnest(range(len(w.v))) AS j FROM parts w JOIN near{i} n USING (rid, p)) GROUP BY p, e, j) GROUP BY p, e)""")
        out.append(f"book{i + 1} AS (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{i} b LEFT JOIN means{i} m USING (p, e))")
    out.append(f"last AS ({near.format(rounds)})")
    return ",\n".join(out)


SQL["op11_vector_codes"] = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT rid, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS v FROM kept, range(16) r(p)),
{_codebook_rounds(2)},
coded AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM book2) AS codebooks_sha256
FROM kept JOIN coded USING (rid)"""


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit: a byte enters at the first of its eight shifts."""
    steps = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: [CAST(ascii(substr({text}, i, 1)) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {steps}), lambda s, x: xor(xor(s, x) >> 1, 3988292384 * (xor(s, x) & 1))), CAST(4294967295 AS BIGINT))"


SQL["op12_conversation_trie"] = f"""
WITH turns AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc32("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
  SELECT c.conv_id, pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND pos <= h
  UNION ALL SELECT c.conv_id, pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND pos > h),
steps AS (
  SELECT conv_id, row_number() OVER o AS depth, string_agg(sha256(length(role) || ':' || role || text), '') OVER o AS path, strlen(text) AS bytes FROM rebuilt WINDOW o AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
lengths AS (SELECT conv_id, max(depth) AS length FROM steps GROUP BY conv_id),
nodes AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = length), '') AS ended
  FROM steps JOIN lengths USING (conv_id) GROUP BY depth, path),
fed AS (SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, 64 * (n.depth - 1))),
children AS (SELECT left(path, 64 * (depth - 1)) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
below AS (
  SELECT left(n.path, 64 * d) AS path, count(*) FILTER (c.path IS NULL) AS n_leaves, sum((n_convs - 1) * bytes) AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM nodes) n LEFT JOIN children c ON c.path = n.path GROUP BY 1)
SELECT conv_id, depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(ended) AS ends_sha256
FROM fed LEFT JOIN children USING (path) JOIN below USING (path)"""
