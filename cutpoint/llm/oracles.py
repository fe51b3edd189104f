"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from .queries import URL_RULES

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACE_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
ALNUM_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

MIXING = rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, source, coalesce(len({SPACE_WORDS.format('text')}), 0)::BIGINT AS size FROM documents
), w AS MATERIALIZED (
  SELECT source, source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)
), levels AS (
  SELECT 0 AS i, -1.0::DOUBLE AS level
  UNION ALL
  SELECT i + 1, up FROM (
    SELECT l.i, l.level, (SELECT ((SELECT sum(source_size) FROM w)
        - coalesce(sum(CASE WHEN 3 * source_size <= l.level * weight THEN 3 * source_size END), 0))::DOUBLE
      / nullif(sum(CASE WHEN 3 * source_size <= l.level * weight THEN 0 ELSE weight END), 0)::DOUBLE FROM w) AS up
    FROM levels l) WHERE up IS NOT NULL AND up <> level
), t AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, (SELECT arg_max(level, i) FROM levels) * weight) AS target FROM w
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST) - 1 AS rank,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    list_sum(list_transform(range(1, 9), lambda i: (strpos('0123456789abcdef',
      substr(md5('7:' || coalesce(d.source, chr(0))), i, 1)) - 1) * (16 ** (8 - i)))) / 4294967296 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, (floor((rank + 1)::DOUBLE * rate + u) - floor(rank::DOUBLE * rate + u))::BIGINT AS copies FROM r
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
"""

MINHASH = rf"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, coalesce({SPACE_WORDS.format(LOWER.format('text'))}, []) AS words FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(words) > 1
    THEN list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])
    ELSE words END) AS shingles FROM w
), u AS MATERIALIZED (
  SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s
), links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  WHERE 10 * least(a.n, b.n) >= 8 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), both_ways AS MATERIALIZED (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT a, b FROM both_ways UNION SELECT r.a, x.b FROM reach r JOIN both_ways x ON r.b = x.a
), c AS (SELECT a AS doc_id, least(a, min(b)) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, len(shingles)::BIGINT AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id,
  coalesce(c.component_id, s.doc_id) = s.doc_id AS kept FROM s LEFT JOIN c USING (doc_id)
"""

EMBEDDINGS = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), good AS MATERIALIZED (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE e IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
    AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, x.b FROM reach r JOIN links x ON r.b = x.a
), c AS (SELECT a AS vec_id, least(a, min(b)) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, coalesce(c.component_id, v.vec_id) AS component_id,
  coalesce(c.component_id, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""

DECONTAM = rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce({ALNUM_WORDS.format(LOWER.format('text'))}, []) AS words FROM documents
), b AS MATERIALIZED (
  SELECT item_id::VARCHAR AS item, {ALNUM_WORDS.format(LOWER.format('text'))} AS words FROM benchmark
), windows AS MATERIALIZED (
  SELECT DISTINCT item, least(len(words), 10) AS width,
    array_to_string(words[i : i + least(len(words), 10) - 1], ' ') AS run
  FROM (SELECT item, words, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS i FROM b WHERE len(words) > 0)
), places AS (
  SELECT doc_id, words, width, unnest(range(1, len(words) - width + 2)) AS i
  FROM d, (SELECT DISTINCT width FROM windows) WHERE len(words) >= width
), hits AS MATERIALIZED (
  SELECT p.doc_id, p.i, p.width, w.item FROM places p JOIN windows w
    ON p.width = w.width AND array_to_string(p.words[p.i : p.i + p.width - 1], ' ') = w.run
), covered AS (
  SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS i FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id
)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

SUBSTRINGS = rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce({SPACE_WORDS.format('text')}, []) AS words FROM documents
), places AS MATERIALIZED (
  SELECT doc_id, i, array_to_string(words[i : i + 34], ' ') AS run
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM d WHERE len(words) >= 35)
), again AS MATERIALIZED (
  SELECT doc_id, i FROM places WHERE run IN (SELECT run FROM places GROUP BY run HAVING count(*) > 1)
), gone AS (
  SELECT doc_id, list(DISTINCT j) AS gone FROM (SELECT doc_id, unnest(range(i, i + 35)) AS j FROM again) GROUP BY doc_id
), each AS (
  SELECT doc_id, word, j FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS j FROM d)
), kept AS (
  SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.j) AS text, count(*) AS n FROM each e
  ANTI JOIN (SELECT doc_id, unnest(gone) AS j FROM gone) g ON e.doc_id = g.doc_id AND e.j = g.j GROUP BY e.doc_id
)
SELECT d.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(kept.n, 0))::BIGINT AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


LINES = r"""
WITH RECURSIVE t AS MATERIALIZED (
  SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents
), o AS MATERIALIZED (
  SELECT doc_id, i - 1 AS pos, trim(lines[i], ' ' || chr(9) || chr(13)) AS line
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM t)
  WHERE trim(lines[i], ' ' || chr(9) || chr(13)) <> ''
), d AS MATERIALIZED (
  SELECT line, row_number() OVER (ORDER BY line) AS id,
    list_distinct(list_transform(range(1, greatest(1, length(line) - 4) + 1), lambda i: substring(line, i, 5))) AS shingles
  FROM (SELECT DISTINCT line FROM o)
), s AS MATERIALIZED (
  SELECT id, len(shingles) AS n, unnest(shingles) AS shingle FROM d
), prefix AS MATERIALIZED (
  -- two sets of similarity 0.8 share one of the rarest fifth of their shingles, or the next
  SELECT id, n, shingle FROM s JOIN (SELECT shingle, count(*) AS f FROM s GROUP BY shingle) USING (shingle)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY f, shingle) <= n - (4 * n + 4) // 5 + 1
), near AS MATERIALIZED (
  SELECT DISTINCT a.id AS a, b.id AS b FROM prefix a JOIN prefix b ON a.shingle = b.shingle AND a.id < b.id
  WHERE 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
), links AS MATERIALIZED (
  SELECT a, b FROM (SELECT a, b, len(x.shingles) + len(y.shingles) AS both_n, len(list_intersect(x.shingles, y.shingles)) AS common
    FROM near JOIN d x ON a = x.id JOIN d y ON b = y.id) WHERE 100 * common >= 80 * (both_n - common)
), both_ways AS MATERIALIZED (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT a, b FROM both_ways UNION SELECT r.a, x.b FROM reach r JOIN both_ways x ON r.b = x.a
), c AS MATERIALIZED (
  SELECT a AS id, least(a, min(b)) AS part FROM reach GROUP BY a
), p AS MATERIALIZED (
  SELECT doc_id, pos, coalesce(c.part, d.id) AS part FROM o JOIN d USING (line) LEFT JOIN c USING (id)
), gone AS (
  SELECT doc_id, count(*) AS n, string_agg(pos, ',' ORDER BY pos) AS removed
  FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id, pos) AS nth FROM p) WHERE nth > 1 GROUP BY doc_id
)
SELECT doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed
FROM t LEFT JOIN gone USING (doc_id)
"""

LICENSES_BASE = rf"""
WITH w AS MATERIALIZED (
  SELECT doc_id, coalesce({ALNUM_WORDS.format(LOWER.format('text'))}, []) AS words FROM documents
), p AS (
  SELECT doc_id, len(words) AS n,
    list_filter(range(0, len(words)), lambda i: words[i + 1 : i + 4] = ['gnu', 'general', 'public', 'license']) AS gpl,
    list_filter(range(0, len(words)), lambda i: words[i + 1 : i + 2] = ['apache', 'license']) AS apache,
    list_filter(range(0, len(words)), lambda i: words[i + 1 : i + 2] = ['cc', 'by']) AS cc,
    list_filter(range(0, len(words)), lambda i: words[i + 1 : i + 2] = ['mit', 'license']) AS mit
  FROM w
)
SELECT doc_id, n::BIGINT AS n_words, (len(gpl) + len(apache) + len(cc) + len(mit))::BIGINT AS n_base,
  coalesce(list_min(gpl || apache || cc || mit), -1)::BIGINT AS first_word,
  coalesce(list_max(gpl || apache || cc || mit), -1)::BIGINT AS last_word,
  concat_ws(',', CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(cc) > 0 THEN 'cc-by' END,
    CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(mit) > 0 THEN 'mit' END) AS base_labels
FROM p
"""

_EITHER = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
_ASSIGN = (
    "(" + "|".join(map(_EITHER, ("password", "passwd", "secret", "token"))) + f"|{_EITHER('api')}_?{_EITHER('key')})"
    + r"""["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)"""
)


def _matches(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    """Matches, the part of each whose size counts, and what stands between them."""
    return f"""SELECT doc_id, '{kind}' AS kind, {rank} AS k, {least} AS least, regexp_extract_all(text, '{pattern}') AS found,
  regexp_extract_all(text, '{pattern}', {group}) AS part, string_split_regex(text, '{pattern}') AS gaps FROM t"""


SECRETS_BASE = f"""
WITH t AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({_matches("assign", 0, _ASSIGN, 2, 12)} UNION ALL {_matches("access", 1, "AKIA[A-Z0-9]+", 0, 18)}
  UNION ALL {_matches("hex", 2, "[0-9a-f]+", 0, 16)}),
e AS (SELECT doc_id, kind, k, length(found[i]) AS size,
    list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1 : i - 1], lambda f: length(f))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM m) WHERE length(part[i]) >= least),
a AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT, ',' ORDER BY start, k) AS spans FROM e GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
  coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM t LEFT JOIN a USING (doc_id)
"""


_NEAREST = """a{i} AS MATERIALIZED (SELECT vec_id, x, cluster, distance FROM (
    SELECT v.row, any_value(v.vec_id) AS vec_id, any_value(v.x) AS x, min(struct_pack(d := d, k := k)).k AS cluster, min(d) AS distance FROM (
      SELECT v.row, v.vec_id, v.x, k, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
      FROM v, c{i} c) v GROUP BY v.row))"""
_MEANS = """c{j} AS MATERIALIZED (
  SELECT c.k, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (
    SELECT k, list(floor_mean ORDER BY place) AS x FROM (
      SELECT k, place, ((total - ((total % n) + n) % n) // n)::BIGINT AS floor_mean FROM (
        SELECT cluster AS k, place, sum(value)::BIGINT AS total, count(*) AS n
        FROM (SELECT cluster, unnest(x) AS value, unnest(range(1, 65)) AS place FROM a{i}) GROUP BY ALL)) GROUP BY k) m USING (k))"""
CENTROIDS = (
    """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY name) - 1 AS k, x FROM (SELECT sha256('3:' || vec_id) AS name, x FROM v ORDER BY name LIMIT 8)
), """
    + ", ".join(f"{_NEAREST.format(i=i)}, {_MEANS.format(i=i, j=i + 1)}" for i in range(10))
    + f""", {_NEAREST.format(i=10)}
SELECT vec_id, cluster::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
  sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c10.x, ',')) AS centroid_sha256
FROM a10 JOIN c10 ON cluster = k
"""
)

URLS = rf"""
WITH p AS (
  SELECT page_id, coalesce({LOWER.format(r"regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")}, '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
), r(h, p, v) AS (VALUES {", ".join(map(str, URL_RULES))})
SELECT page_id, host, path,
  (SELECT arg_max(h || r.p, len(h || r.p)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(p.path, r.p)) AS rule,
  coalesce((SELECT arg_max(v, len(h || r.p)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(p.path, r.p)), 'allow') AS verdict
FROM p
"""

_CRC32 = """xor(4294967295, list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(doc_id::VARCHAR, ''),
    lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x)
    ELSE xor(crc >> 1, CASE WHEN crc & 1 = 1 THEN 3988292384 ELSE 0 END) END))"""

PERIODIC = rf"""
WITH w AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce({SPACE_WORDS.format("text")}, []) AS words, crc32 AS h, crc32 // 10 AS g
  FROM (SELECT doc_id, text, {_CRC32} AS crc32 FROM documents)
), t AS MATERIALIZED (
  SELECT row, doc_id, CASE WHEN h % 10 = 0 AND len(words) > 0
    THEN list_transform(range(0, len(words)), lambda i: words[1 + CASE WHEN i < g % len(words) THEN i
      ELSE g % len(words) + (i - g % len(words)) % (1 + (len(words) - g % len(words)) // (3 + g % 8)) END])
    ELSE words END AS words FROM w
), f AS MATERIALIZED (
  SELECT row, len(words) AS n, i, array_to_string(words[i + 1 : i + 16], ' ') AS gram, words[i] AS before
  FROM (SELECT row, words, unnest(range(0, len(words) - 15)) AS i FROM t WHERE len(words) >= 24)
), s AS MATERIALIZED (
  SELECT a.row, a.i AS start, b.i - a.i AS period FROM f a JOIN f b ON a.row = b.row AND a.gram = b.gram AND a.i < b.i
  WHERE b.i - a.i <= a.n // 3 AND (a.i = 0 OR a.before <> b.before)
), e AS (
  SELECT row, start, period, period + coalesce(list_position(list_transform(range(start, len(words) - period),
    lambda i: words[i + 1] = words[i + period + 1]), false) - 1, len(words) - period - start) AS length FROM s JOIN t USING (row)
), r AS MATERIALIZED (
  SELECT row, start, length, min(period) AS period FROM e GROUP BY row, start, length HAVING length >= greatest(24, 3 * min(period))
), o AS (
  SELECT row, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs,
    list(struct_pack(a := start + period, b := start + length)) AS gone,
    first(struct_pack(start := start, length := length, period := period) ORDER BY length / period DESC, start, period) AS best
  FROM r GROUP BY row
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, coalesce(best.start, -1)::BIGINT AS start,
  coalesce(best.length, -1)::BIGINT AS length, coalesce(best.period, -1)::BIGINT AS period,
  coalesce(1000 * best.length // best.period, -1)::BIGINT AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE list_transform(list_filter(range(0, len(words)),
    lambda i: len(list_filter(gone, lambda x: i >= x.a AND i < x.b)) = 0), lambda i: words[i + 1]) END, ' ')) AS collapsed_sha256
FROM t LEFT JOIN o USING (row)
"""


def oracle_sql() -> dict[str, str]:
    """Query name to SQL; the other queries are tested against brute force."""
    return {
        "op1_mixing": MIXING,
        "op2_minhash": MINHASH,
        "op4_embeddings": EMBEDDINGS,
        "op7_decontam": DECONTAM,
        "op8_substrings": SUBSTRINGS,
        "op9_lines": LINES,
        "op11_centroids": CENTROIDS,
        "op12_urls": URLS,
        "licenses_base": LICENSES_BASE,
        "secrets_base": SECRETS_BASE,
        "periodic_base": PERIODIC,
    }
