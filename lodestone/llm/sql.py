"""DuckDB SQL for those of the registered queries that SQL can express, over whole tables.

Written from the definitions, not from the plans: a passage is compared word by word, a window in full, a checksum digit
by digit. SQL lacks tokenizer merges, 64-bit shingle hashes, automata, exchange clustering and guess costs.
"""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

OP5 = rf"""
WITH rows AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
split AS MATERIALIZED (SELECT r, doc_id, t, regexp_extract_all(t, '{WORD}') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM rows),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM split),
windows AS (SELECT r, pos, count(*) OVER win AS n, list(word) OVER win AS seen FROM words
  WINDOW win AS (PARTITION BY r ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
twice AS (SELECT r, pos FROM windows WHERE n = 8 QUALIFY count(*) OVER (PARTITION BY r, seen) > 1),
again AS (SELECT r, count(DISTINCT pos + i) AS n FROM twice, range(8) AS x(i) GROUP BY r),
facts AS (SELECT split.r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines, length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) AS letters
  FROM split LEFT JOIN again ON again.r = split.r),
based AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM facts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars BETWEEN 2 * n_words AND 20 * n_words AND 10 * n_symbols <= 8 * n_words
  AND 10 * n_dup_lines <= 5 * n_lines AND 2 * letters >= word_chars AS kept FROM based
"""

OP7 = rf"""
WITH split AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
words AS MATERIALIZED (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM split),
windows AS (SELECT doc_id, pos, count(*) OVER win AS n, list(word) OVER win AS seen FROM words
  WINDOW win AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
later AS (SELECT doc_id, pos FROM windows WHERE n = 20 QUALIFY row_number() OVER (PARTITION BY seen ORDER BY doc_id, pos) > 1),
gone AS (SELECT DISTINCT doc_id, pos + i AS pos FROM later, range(20) AS x(i)),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.pos) FILTER (WHERE gone.pos IS NULL) AS text, count(gone.pos) AS n
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.pos = words.pos GROUP BY words.doc_id)
SELECT split.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM split LEFT JOIN kept ON kept.doc_id = split.doc_id
"""

_LINE = r"trim(regexp_replace(lower(text), '[\x20\x09-\x0D]+', ' ', 'g'))"
_SHINGLES = "CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END"

OP10 = f"""
WITH docs AS MATERIALIZED (SELECT *, {_SHINGLES} AS s FROM (SELECT row_number() OVER () AS r, doc_id, string_split({_LINE}, ' ') AS w FROM documents WHERE {_LINE} <> '')),
items AS MATERIALIZED (SELECT *, {_SHINGLES} AS s FROM (SELECT row_number() OVER () AS b, item_id, string_split({_LINE}, ' ') AS w FROM benchmark WHERE {_LINE} <> '')),
places AS MATERIALIZED (SELECT r, len(s) AS n, unnest(s) AS shingle, generate_subscripts(s, 1) - 1 AS pos FROM docs),
wanted AS MATERIALIZED (SELECT b, m, shingle, count(*) AS k FROM (SELECT b, len(s) AS m, unnest(s) AS shingle FROM items) GROUP BY ALL),
starts AS (SELECT DISTINCT r, b, m, least(pos, greatest(n - m, 0)) AS start, least(n, m) AS size FROM places JOIN wanted USING (shingle)),
held AS (SELECT starts.r, starts.b, starts.m, start, size, places.shingle, count(*) AS c FROM starts JOIN places
  ON places.r = starts.r AND places.pos BETWEEN start AND start + size - 1 GROUP BY ALL),
common AS (SELECT r, b, held.m, start, size, CAST(sum(least(c, k)) AS BIGINT) AS common FROM held JOIN wanted USING (b, shingle) GROUP BY ALL),
found AS (SELECT doc_id, item_id, common / (m + size - common) AS similarity, r, start FROM common JOIN docs USING (r) JOIN items USING (b))
SELECT doc_id, item_id, max(similarity) AS similarity, count(*) AS n_windows FROM found WHERE similarity >= 0.8 GROUP BY doc_id, item_id
"""


_LUHN = "list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 0 THEN CAST(d[i] AS INT) ELSE 2 * CAST(d[i] AS INT) // 10 + 2 * CAST(d[i] AS INT) % 10 END)) % 10 = 0"
_TURNED = "string_split(a[5:] || a[:4], '')"
_MOD97 = f"list_reduce(list_prepend(0, list_transform(list_filter({_TURNED}, lambda c: c <> ''), lambda c: CASE WHEN c <= '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda n, x: (n * CASE WHEN x < 10 THEN 10 ELSE 100 END + x) % 97) = 1"
#: Name, pattern with what may stand before in a group of its own, and the test of a match ``m``: ``d`` its digits, ``a``
#: its letters and digits, ``near`` what stands before it, ``after`` what stands behind.
_KINDS = (
    ("email", r"()([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)", "true"),
    ("ip", r"()([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)", "len(list_filter(list_transform(string_split(m, '.'), lambda p: ltrim(p, '0')), lambda p: length(p) > 3 OR length(p) = 3 AND p > '255')) = 0"),
    ("card", r"()([0-9](?:[\x20-]?[0-9])+)", f"length(d) BETWEEN 14 AND 19 AND {_LUHN}"),
    ("phone", r"()(\+[0-9][\x20().0-9-]+[0-9])", "length(d) BETWEEN 10 AND 15"),
    ("iban", r"(^|[^A-Za-z0-9])([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)", f"NOT regexp_matches(after, '^[A-Za-z0-9]') AND length(a) BETWEEN 15 AND 34 AND {_MOD97}"),
    (
        "ssn",
        r"(^|[^0-9-])([0-9]{3}-[0-9]{2}-[0-9]{4})",
        "NOT regexp_matches(after, '^[0-9-]') AND NOT regexp_matches(m, '^(000|666|9)|-00-|-0000$')"
        r" AND regexp_matches(lower(right(near, 48) || ' ' || left(after, 48)), 'ssn|social\s+security|tax\s*id|sozialversicherung|seguridad\s+social|s[eé]curit[eé]\s+sociale')",
    ),
)


def _found(order: int, kind: str, pattern: str, passes: str) -> str:
    """Spans of one kind: matches, and what lies between them, give the places."""
    return f"""SELECT r, {order} AS k, '{kind}' AS kind, ends - length(m) AS begins, ends FROM (
  SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS d, regexp_replace(m, '[^0-9A-Za-z]', '', 'g') AS a FROM (
    SELECT r, after, regexp_extract(hit, '{pattern}', 2) AS m, before || regexp_extract(hit, '{pattern}', 1) AS near,
      sum(length(before) + length(hit)) OVER (PARTITION BY r ORDER BY i) AS ends FROM (
      SELECT r, unnest(hits) AS hit, unnest(between_[1:len(hits)]) AS before, unnest(between_[2:]) AS after, generate_subscripts(hits, 1) AS i FROM (
        SELECT r, regexp_extract_all(t, '{pattern}') AS hits, string_split_regex(t, '{pattern}') AS between_ FROM rows WHERE regexp_matches(t, '{pattern}')))))
  WHERE {passes}"""


def _joined(where: str) -> str:
    return f"coalesce(string_agg(kind || ':' || CAST(begins AS BIGINT) || ':' || CAST(ends AS BIGINT), ',' ORDER BY begins, k) FILTER (WHERE {where}), '')"


OP4 = f"""
WITH rows AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(_found(i, *k) for i, k in enumerate(_KINDS))})
SELECT doc_id, {", ".join(f"count(CASE WHEN kind = '{k[0]}' THEN 1 END) AS n_{k[0]}" for k in _KINDS[:4])},
  sha256({_joined("k < 4")}) AS base_sha256, {_joined("k IS NOT NULL")} AS spans
FROM rows LEFT JOIN spans USING (r) GROUP BY r, doc_id
"""


def _crc(crc: str, byte: str) -> str:
    """CRC-32 after one more byte, in two steps of four bits by the polynomial 0xEDB88320."""
    table = []
    for x in range(16):
        for _ in range(4):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        table.append(x)
    entry = lambda x: f"list_extract({table}::BIGINT[], (({x}) & 15) + 1)"
    once = f"xor({crc}, {byte})"
    twice = f"xor(({once}) >> 4, {entry(once)})"
    return f"xor(({twice}) >> 4, {entry(twice)})"


OP11 = rf"""
WITH texts AS (SELECT 0 AS side, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
words AS MATERIALIZED (SELECT side, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts),
spelt AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM words)),
bytes AS (SELECT word, list_transform(range(CAST(length(h) // 2 AS BIGINT)), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT)) AS b FROM spelt),
buckets AS MATERIALIZED (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: {_crc("c", "x")}), 4294967295) % 10000 AS bucket FROM bytes),
counts AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM words JOIN buckets USING (word) GROUP BY bucket),
gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS BIGINT) AS gain FROM counts),
means AS (SELECT r, count(*) AS n, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM words JOIN buckets USING (word) JOIN gains USING (bucket) WHERE side = 0 GROUP BY r),
scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM texts LEFT JOIN means USING (r) WHERE side = 0),
ranked AS (SELECT *, n_features >= 20 AS able, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= (SELECT count(*) // 10 FROM scored WHERE n_features >= 20) THEN place END AS "rank" FROM ranked
"""


def op13(k: int = 16, rounds: int = 3, dim: int = 64) -> str:
    """Every round spelt out: distances to all centroids, the least of them, floored means."""
    nearest = lambda c: f"""(SELECT r, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM
  (SELECT r, cluster, CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM kept, {c}) GROUP BY r)"""  # noqa: E731
    steps = []
    for i in range(rounds):
        steps.append(f"""a{i} AS MATERIALIZED {nearest(f"c{i}")},
m{i} AS (SELECT cluster, pos, CAST(floor(sum(x)::DOUBLE / count(*)) AS BIGINT) AS x FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM kept JOIN a{i} USING (r)) GROUP BY cluster, pos),
c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(new.c, c{i}.c) AS c FROM c{i} LEFT JOIN (SELECT cluster, list(x ORDER BY pos) AS c FROM m{i} GROUP BY cluster) AS new USING (cluster))""")
    return f"""
WITH fine AS (SELECT row_number() OVER () AS r, vec_id, embedding AS e FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: isfinite(x))) = {dim}),
kept AS MATERIALIZED (SELECT r, vec_id, list_transform(e, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS v FROM fine),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v AS c FROM (SELECT sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept) QUALIFY row_number() OVER (ORDER BY h, v) <= {k}),
{", ".join(steps)},
last AS MATERIALIZED {nearest(f"c{rounds}")}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM last JOIN kept USING (r) JOIN c{rounds} USING (cluster)
"""
