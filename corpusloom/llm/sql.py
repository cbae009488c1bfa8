"""DuckDB SQL of those queries that SQL can express; results equal those of the operators row by row."""

from __future__ import annotations

from . import hard_negatives, line_dedup, prefix_trie, quality_rules, recompression, secret_scan, suffix_array

_WORD = "'[^\\x20\\x09-\\x0D]+'"
_DOCS = "d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, lang, source FROM documents)"


def _quality() -> str:
    q = quality_rules
    bucket = lambda v: f"CASE WHEN {v} < {q.EXACT} THEN {v} ELSE ({v} // CAST(pow(2, length(bin({v})) - {q.EXACT.bit_length() - 1}) AS BIGINT)) * CAST(pow(2, length(bin({v})) - {q.EXACT.bit_length() - 1}) AS BIGINT) END"
    rates = {"word_length": "word_chars", "symbol_rate": "n_symbols", "line_rate": "n_dup_lines * 10", "repeat_rate": "n_repeat_words"}
    tall = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {m} AS v FROM r WHERE NOT base_failed" for m in rates)
    least = "CASE measure " + " ".join(f"WHEN '{m}' THEN {n}" for m, n in q.LEAST_SPREAD.items()) + " END"

    def fences(name: str, source: str, keys: str) -> str:
        over = f"PARTITION BY {keys + ', ' if keys else ''}measure"
        group = f"{keys + ', ' if keys else ''}measure"
        return (
            f"{name}0 AS (SELECT *, sum(n) OVER ({over} ORDER BY bucket) AS upto, sum(n) OVER ({over}) AS total FROM {source}), "
            f"{name}1 AS (SELECT {group}, max(total) AS total, min(CASE WHEN upto * 4 >= total THEN bucket END) AS q1, min(CASE WHEN upto * 4 >= total * 3 THEN bucket END) AS q3 FROM {name}0 GROUP BY {group}), "
            f"{name} AS (SELECT {group}, total, q1 - greatest(q3 - q1, {least}) * {q.FENCE} AS low, q3 + greatest(q3 - q1, {least}) * {q.FENCE} AS high FROM {name}1)"
        )

    beyond = " OR ".join(f"(measure = '{m}' AND (v > high{' OR v < low' if m in q.TWO_SIDED else ''}))" for m in rates)
    return f"""
WITH {_DOCS}, w AS (SELECT rid, doc_id, lang, source, t, regexp_extract_all(t, {_WORD}) AS ws FROM d),
win AS (SELECT rid, unnest(generate_series(1, len(ws) - 2)) AS i, ws FROM w WHERE len(ws) >= 3), k AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s FROM win),
rep AS (SELECT rid, unnest(is_) AS i FROM (SELECT rid, s, list(i) AS is_ FROM k GROUP BY rid, s HAVING count(*) > 1) x),
cov AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, i + j AS at FROM rep, (VALUES (0), (1), (2)) v(j)) x GROUP BY rid),
ln AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) x WHERE regexp_matches(line, {_WORD}) GROUP BY rid),
b AS (SELECT w.rid, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(ln.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
  FROM w LEFT JOIN ln ON ln.rid = w.rid LEFT JOIN cov ON cov.rid = w.rid),
r AS (SELECT *, n_words < {q.MIN_WORDS} OR n_repeat_words * 100 > n_words * {q.MAX_REPEAT_PERCENT} AS base_failed, {", ".join(f"({v}) * 1000 // greatest(n_words, 1) AS {m}" for m, v in rates.items())} FROM b),
tall AS ({tall}), fine AS (SELECT lang, source, measure, {bucket("v")} AS bucket, count(*) AS n FROM tall GROUP BY ALL), bylang AS (SELECT lang, measure, bucket, sum(n) AS n FROM fine GROUP BY ALL), byall AS (SELECT measure, bucket, sum(n) AS n FROM fine GROUP BY ALL),
{fences("fs", "fine", "lang, source")}, {fences("fl", "bylang", "lang")}, {fences("fa", "byall", "")},
e AS ({" UNION ALL ".join(f"SELECT rid, lang, source, '{m}' AS measure, {m} AS v FROM r" for m in rates)}),
o AS (SELECT e.rid, e.measure, e.v, CASE WHEN fs.total >= {q.MIN_GROUP} THEN 'source' WHEN fl.total >= {q.MIN_GROUP} THEN 'lang' ELSE 'all' END AS fence_of,
  CASE WHEN fs.total >= {q.MIN_GROUP} THEN fs.low WHEN fl.total >= {q.MIN_GROUP} THEN fl.low ELSE fa.low END AS low, CASE WHEN fs.total >= {q.MIN_GROUP} THEN fs.high WHEN fl.total >= {q.MIN_GROUP} THEN fl.high ELSE fa.high END AS high
  FROM e LEFT JOIN fs ON fs.lang IS NOT DISTINCT FROM e.lang AND fs.source IS NOT DISTINCT FROM e.source AND fs.measure = e.measure LEFT JOIN fl ON fl.lang IS NOT DISTINCT FROM e.lang AND fl.measure = e.measure LEFT JOIN fa ON fa.measure = e.measure),
x AS (SELECT rid, min(fence_of) AS fence_of, bool_or({beyond}) AS beyond FROM o GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(beyond, false) AS kept, fence_of FROM r JOIN x USING (rid)"""


def _near(n: int, percent: int) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    gram = " || ' ' || ".join(f"ws[i + {j}]" if j else "ws[i]" for j in range(n))
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), {_WORD}) AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, {gram} AS s FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - {n - 1})) AS i FROM w WHERE len(ws) >= {n}) x UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND {n - 1}),
c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE p.n * 100 >= {percent} * (ca.n + cb.n - p.n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, other) AS (SELECT a, b FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other),
m AS (SELECT id, min(other) AS least FROM r GROUP BY id)
SELECT w.doc_id, coalesce(c.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.least, w.doc_id)) AS component_id, least(w.doc_id, coalesce(m.least, w.doc_id)) = w.doc_id AS kept FROM w LEFT JOIN c ON c.doc_id = w.doc_id LEFT JOIN m ON m.id = w.doc_id"""


def _repeats(n: int) -> str:
    return f"""
WITH {_DOCS}, w AS (SELECT rid, doc_id, regexp_extract_all(t, {_WORD}) AS ws FROM d),
win AS (SELECT rid, i, md5(array_to_string(ws[i:i + {n - 1}], ' ')) AS k FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - {n - 1})) AS i FROM w WHERE len(ws) >= {n}) x),
again AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
cov AS (SELECT DISTINCT rid, unnest(generate_series(i, i + {n - 1})) AS pos FROM win SEMI JOIN again USING (k)),
lost AS (SELECT rid, list(pos) AS pos FROM cov GROUP BY rid),
token AS (SELECT w.rid, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS pos FROM w SEMI JOIN lost USING (rid)),
kept AS (SELECT token.rid, string_agg(word, ' ' ORDER BY token.pos) AS t FROM token ANTI JOIN cov ON cov.rid = token.rid AND cov.pos = token.pos GROUP BY token.rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(lost.pos), 0) AS BIGINT) AS n_removed, sha256(CASE WHEN lost.rid IS NULL THEN array_to_string(ws, ' ') ELSE coalesce(kept.t, '') END) AS kept_sha256
FROM w LEFT JOIN lost ON lost.rid = w.rid LEFT JOIN kept ON kept.rid = w.rid"""


def _lines() -> str:
    m, n = line_dedup, line_dedup.SHINGLE
    return f"""
WITH {_DOCS}, l AS (SELECT rid, t, CAST('0x' || substr(md5(t), 1, 15) AS BIGINT) AS key, coalesce(source, chr(0) || 'null') AS site, string_split(t, chr(10)) AS ls FROM d),
e AS (SELECT rid, t, key, site, unnest(generate_series(1, len(ls))) AS i, unnest(ls) AS line FROM l),
spread AS (SELECT line FROM e WHERE regexp_matches(line, {_WORD}) GROUP BY line HAVING count(DISTINCT site) >= {m.MIN_SITES}),
held AS (SELECT DISTINCT line, t, key FROM e SEMI JOIN spread USING (line)),
mixed AS (SELECT t, sum(length(line)) * 100 > length(t) * {m.MOSTLY} AS mostly FROM held GROUP BY t HAVING sum(length(line)) * 100 >= length(t) * {m.MIXED}),
compared AS (SELECT line, t, key FROM held JOIN mixed USING (t) WHERE NOT mostly),
placed AS (SELECT line, t, first_value(t) OVER (PARTITION BY line ORDER BY key) AS c FROM compared),
said AS (SELECT t, false AS whole, regexp_extract_all(string_agg(line, chr(10) ORDER BY i), {_WORD}) AS ws FROM (SELECT DISTINCT t, i, line FROM e SEMI JOIN compared USING (t) ANTI JOIN spread USING (line)) x GROUP BY t
  UNION ALL SELECT DISTINCT c, true, regexp_extract_all(c, {_WORD}) FROM placed),
sh AS (SELECT DISTINCT t, whole, array_to_string(ws[i:i + {n - 1}], ' ') AS s FROM (SELECT t, whole, ws, unnest(generate_series(1, len(ws) - {n - 1})) AS i FROM said WHERE len(ws) >= {n}) x
  UNION ALL SELECT t, whole, array_to_string(ws, ' ') FROM said WHERE len(ws) BETWEEN 1 AND {n - 1}),
sizes AS (SELECT t, count(*) AS n FROM sh WHERE NOT whole GROUP BY t),
common AS (SELECT p.t, p.c, count(*) AS both_ FROM (SELECT DISTINCT t, c FROM placed WHERE t <> c) p JOIN sh a ON a.t = p.t AND NOT a.whole JOIN sh b ON b.t = p.c AND b.whole AND b.s = a.s GROUP BY p.t, p.c),
versions AS (SELECT t, c FROM common JOIN sizes USING (t) WHERE both_ * 100 >= {m.ALIKE} * n),
witness AS (SELECT line FROM held ANTI JOIN mixed USING (t) UNION ALL SELECT line FROM placed SEMI JOIN sizes USING (t) ANTI JOIN versions USING (t, c)),
bad AS (SELECT line FROM witness GROUP BY line HAVING count(*) >= {m.MIN_SITES}),
k AS (SELECT rid, count(*) AS n FROM e SEMI JOIN bad USING (line) GROUP BY rid),
s AS (SELECT rid, string_agg(line, chr(10) ORDER BY i) AS t FROM e ANTI JOIN bad USING (line) GROUP BY rid)
SELECT d.doc_id, CAST(len(string_split(d.t, chr(10))) AS BIGINT) AS n_lines, CAST(coalesce(k.n, 0) AS BIGINT) AS n_lines_removed, sha256(coalesce(s.t, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.rid = d.rid LEFT JOIN s ON s.rid = d.rid"""


def _negatives() -> str:
    h = hard_negatives
    return f"""
WITH r AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, [floor({h.SCALE} * CAST(x AS DOUBLE)) for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label, c.vec_id, c.label AS other, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score FROM r a JOIN r c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = other QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {h.POSITIVES})
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE label <> other AND {h.LOWEST} * positive_score <= 100 * score AND 100 * score <= {h.HIGHEST} * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= {h.NEGATIVES}"""


def _secrets() -> str:
    q = secret_scan
    quoted = lambda s: "'" + s.replace("'", "''") + "'"

    def pieces(name: str, source: str, pattern: str, group: int) -> str:
        """(rid, i, gap, said, value) of the matches, with a last row for what follows them."""
        said, p = f"regexp_extract_all(t, {quoted(pattern)}, 0)", quoted(pattern)
        return (
            f"{name}0 AS (SELECT rid, string_split_regex(t, {p}) AS g, {said} AS s, regexp_extract_all(t, {p}, {group}) AS v FROM {source}), "
            f"{name}1 AS (SELECT rid, unnest(g) AS gap, unnest(s) AS said, unnest(v) AS value, unnest(generate_series(1, len(g))) AS i FROM {name}0), "
            f"{name} AS (SELECT *, sum(length(gap) + coalesce(length(said), 0)) OVER (PARTITION BY rid ORDER BY i) AS upto FROM {name}1)"
        )

    ctes, source = [], "d"
    for k, (pattern, group, least) in q.SHAPES.items():
        ctes.append(pieces(f"m_{k}", "d", pattern, group))
        ctes.append(pieces(f"b_{k}", source, pattern, group))
        ctes.append(f"t_{k} AS (SELECT rid, string_agg(gap || CASE WHEN said IS NULL THEN '' WHEN length(value) >= {least} THEN repeat(' ', length(said)) ELSE said END, '' ORDER BY i) AS t FROM b_{k} GROUP BY rid)")
        source = f"t_{k}"
    ctes.append(pieces("r", source, q.RUN, 0))
    base = " UNION ALL ".join(
        f"SELECT rid, {i} AS rank, '{k}' AS kind, CAST(upto - length(said) AS BIGINT) AS a, CAST(upto AS BIGINT) AS b FROM m_{k} WHERE length(value) >= {least}" for i, (k, (_, _, least)) in enumerate(q.SHAPES.items()))
    encoding = "CASE " + " ".join("WHEN regexp_matches(said, '^[" + s.replace("-", "\\-") + f"]+$') THEN '{e}'" for e, s in q.ENCODINGS.items()) + " END"
    alphabet = "CASE encoding " + " ".join(f"WHEN '{e}' THEN '{s}'" for e, s in q.ENCODINGS.items()) + " END"
    halves = "CASE encoding " + " ".join(f"WHEN '{e}' THEN '{'L' * (len(s) // 2) + 'H' * (len(s) - len(s) // 2)}'" for e, s in q.ENCODINGS.items()) + " END"
    at = "CASE " + " ".join(f"WHEN n >= {c} THEN {c}" for c in reversed(q.CLASSES)) + " END"
    far = f"CAST({q.FAR} AS DOUBLE)"
    cut = "CAST(NULL AS DOUBLE)"
    for i, c in enumerate(q.CUTS):
        cut = f"CASE WHEN ordinary * CAST({c / (q.FAR - q.CUTS[-1])!r} AS DOUBLE) <= n{i} * CAST({q.FALSE_SHARE} AS DOUBLE) THEN CAST({c} AS DOUBLE) ELSE {cut} END"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), {", ".join(ctes)},
base AS ({base}),
e AS (SELECT rid, CAST(upto - length(said) AS BIGINT) AS a, CAST(upto AS BIGINT) AS b, said, {encoding} AS encoding, CAST(length(said) AS DOUBLE) AS n FROM r WHERE said IS NOT NULL),
f AS (SELECT *, {at} AS class, {alphabet} AS symbols, translate(said, {alphabet}, {halves}) AS hl FROM e WHERE encoding IS NOT NULL),
g AS (SELECT *, CAST(length(symbols) AS DOUBLE) AS m, CAST(list_sum([(length(said) - length(replace(said, s, ''))) ** 2 for s in string_split(symbols, '')]) AS BIGINT) AS squares,
  CAST(length(replace(hl, 'L', '')) AS DOUBLE) AS high, CAST((length(hl) - length(replace(hl, 'LH', ''))) // 2 + (length(hl) - length(replace(hl, 'HL', ''))) // 2 AS DOUBLE) AS turns,
  [instr(symbols, c) for c in string_split(said, '')] AS x FROM f),
h AS (SELECT *, 2 * high * (n - high) / n + 1 AS mean, CAST(list_sum(x) AS DOUBLE) AS total, CAST(list_sum([v * v for v in x]) AS DOUBLE) AS own, CAST(list_sum([x[i] * x[i + 1] for i in range(1, len(x))]) AS DOUBLE) AS pairs, CAST(x[1] + x[len(x)] AS DOUBLE) AS ends FROM g),
i AS (SELECT *, (squares * m / n - n - (m - 1)) / sqrt(2 * (m - 1) * (n - 1) / n) AS du, (mean - 1) * (mean - 2) / (n - 1) AS spread, own - total * total / n AS left_, pairs - 2 * (total / n) * total + ends * total / n + (n - 1) * (total / n) * (total / n) AS crossed FROM h),
j AS (SELECT rid, a, b, encoding, class, du, CASE WHEN spread > 0 THEN (turns + 1 - mean) / sqrt(spread) ELSE {far} END AS dr, CASE WHEN left_ > 0 THEN (crossed / left_ + 1 / n) * sqrt(n) ELSE {far} END AS ds FROM i),
k AS (SELECT *, du * du + dr * dr + ds * ds AS distance FROM j),
c AS (SELECT encoding, class, {", ".join(f"count(*) FILTER (distance <= CAST({c} AS DOUBLE)) AS n{i}" for i, c in enumerate(q.CUTS))}, count(*) FILTER (distance > CAST({q.CUTS[-1]} AS DOUBLE) AND distance <= {far}) AS ordinary FROM k GROUP BY ALL),
u AS (SELECT * FROM base UNION ALL SELECT rid, {len(q.SHAPES)}, '{q.RANDOM}', a, b FROM k JOIN (SELECT encoding, class, {cut} AS cut FROM c) USING (encoding, class) WHERE distance <= cut),
o AS (SELECT rid, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in q.SHAPES)}, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (rank < {len(q.SHAPES)}) AS bs, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) AS spans FROM u GROUP BY rid)
SELECT doc_id, {", ".join(f"CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}" for k in q.SHAPES)}, sha256(coalesce(bs, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN o ON o.rid = d.rid"""


def _trie() -> str:
    byte = "list_reduce([xor(crc, CAST(b AS BIGINT)), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], [CAST(ascii(c) AS BIGINT) for c in string_split(CAST(conv_id AS VARCHAR), '')]), lambda crc, b: {byte}), 4294967295)"
    lent = prefix_trie.MOST_SHARED
    return f"""
WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {crc} % {lent + 1} AS h FROM (SELECT DISTINCT conv_id FROM o) x),
told AS (SELECT c.conv_id, place, role, text, 0 AS own FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 100 AND place <= h UNION ALL SELECT conv_id, place, role, text, 1 FROM o JOIN c USING (conv_id) WHERE place > h),
p AS (SELECT conv_id, row_number() OVER w AS depth, list({{'role': role, 'text': text}}) OVER w AS path, text FROM told WINDOW w AS (PARTITION BY conv_id ORDER BY own, place) UNION ALL SELECT conv_id, 0, [], '' FROM c),
e AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(length(text)) AS n FROM p GROUP BY path, depth),
t AS (SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM p JOIN e USING (conv_id, depth) GROUP BY path),
k AS (SELECT n.*, p.path AS parent, p.conv_id AS parent_conv_id FROM n LEFT JOIN n p ON p.depth = n.depth - 1 AND p.path = n.path[:n.depth - 1]),
ch AS (SELECT parent AS path, count(*) AS n_children FROM k WHERE depth > 0 GROUP BY parent),
f AS (SELECT k.*, coalesce(n_children, 0) AS n_children FROM k LEFT JOIN ch USING (path)),
up AS (SELECT path[:j] AS path, CASE WHEN n_children = 0 THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * n AS saved FROM (SELECT *, unnest(generate_series(0, depth)) AS j FROM f) x),
s AS (SELECT path, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM up GROUP BY path)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, CAST(n_convs AS BIGINT) AS n_convs, CAST(n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM f JOIN s USING (path) LEFT JOIN t USING (path)"""


SQL = {
    "op1_quality_rules": _quality(),
    "op2_minhash_dedup": _near(3, 85),
    "op4_substring_dedup": _repeats(recompression.WINDOW),
    "op7_suffix_array_dedup": _repeats(suffix_array.SHORTEST),
    "op10_line_dedup": _lines(),
    "op11_hard_negatives": _negatives(),
    "op12_secret_scan": _secrets(),
    "op13_prefix_trie": _trie(),
}
