"""SQL twins of the queries, for DuckDB over the same tables."""

from __future__ import annotations

from . import quality, secrets, sharding
from .common import P31

_WORDS = r"[^\x20\x09-\x0D]+"


def _spans(rule: secrets.Rule, number: int) -> str:
    """Rows (doc_id, s, o, e, kind) of one rule: lengths of the gaps and matches give the places."""
    pattern = (rule.scan or rule.pattern).replace("'", "''")
    return f"""SELECT doc_id, s, {number} AS o, s + n AS e, '{rule.kind}' AS kind FROM (
SELECT doc_id, n, ok, sum(gap + coalesce(before, 0)) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM (
SELECT doc_id, i, length(g) AS gap, length(m) AS n, length(v) >= {rule.least} AS ok, lag(length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM (
SELECT doc_id, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(vs) AS v, unnest(gs[1:len(ms)]) AS g FROM (
SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, regexp_extract_all(t, '{pattern}', {rule.group}) AS vs, regexp_split_to_array(t, '{pattern}') AS gs FROM d) a) b) c) x WHERE ok"""


def _op1() -> str:
    every = " UNION ALL ".join(_spans(r, i) for i, r in enumerate(secrets.RULES))
    base = ", ".join(f"'{k}'" for k in secrets.BASE)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({every}),
j AS (SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secrets.BASE)},
string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, o) FILTER (kind IN ({base})) AS b, string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, o) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in secrets.BASE)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j ON d.doc_id = j.doc_id"""


def _op4() -> str:
    r = quality.LineRules()
    blanks = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    phrases = " OR ".join(f"contains(lower(x), '{p}')" for p in r.phrases)
    ends = r.ends.replace("'", "''")
    n = f"len(regexp_extract_all(x, '{_WORDS}'))"
    symbols = f"(len(regexp_extract_all(x, '[#*$%&|<>]')) + len(regexp_extract_all(x, '[!?]{{2,}}')))"
    separators = r"len(list_filter(string_split_regex(x, '[\x20\x09]'), lambda y: y IN ('|', '»', '•', '>', '/')))"
    failed = f"""({n} BETWEEN {r.min_words_for_end} AND {r.max_words_for_end} AND NOT contains('{ends}', right(trim(x, {blanks}), 1)) AND NOT coalesce(regexp_matches(l[i + 1], '{quality.GOES_ON}'), false)) OR {symbols} > {n} * {r.max_symbol_share}
OR ({separators} >= {r.min_separators} AND {separators} >= {n} * {r.min_separator_share}) OR {phrases}"""
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{_WORDS}') AS w, string_split(t, chr(10)) AS l FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a) AS c FROM (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS a FROM w) x),
rep AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n FROM g, (SELECT unnest([0, 1, 2]) AS k) z WHERE c > 1 GROUP BY doc_id),
q AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
list_filter(l, lambda x: {n} > 0) AS wl, coalesce(rep.n, 0) AS n_repeat_words, len(list_filter(l, lambda x, i: {n} > 0 AND ({failed})))::BIGINT AS n_lines_removed,
coalesce(list_sum(list_transform(list_filter(l, lambda x, i: NOT ({failed})), lambda x: {n})), 0)::BIGINT AS words_left FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, (len(wl) - len(list_distinct(wl)))::BIGINT AS n_dup_lines, n_repeat_words, base_failed,
NOT base_failed AND 100 * (n_words - words_left) <= {r.max_lost_percent} * n_words AS kept, n_lines_removed, words_left FROM b"""


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        out.append(i)
    return out


def _op5(shards: int = 24, seed: int = 20240613) -> str:
    table = "[" + ", ".join(map(str, _crc_table())) + "]::BIGINT[]"
    octets = "list_transform(range(0, octet_length(encode(t))), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)"
    rounds = "SELECT start, steps, p // b AS l, p % b AS r FROM walk, size WHERE p >= n OR steps = 0"
    for i, (x, y, z) in enumerate(sharding.round_keys(seed)):
        other, own, m = ("r", "l", "a") if i % 2 == 0 else ("l", "r", "b")
        noise = f"((({other} * {x} + {y}) % {P31}) * (({other} * {x} + {y}) % {P31}) + {z}) % {P31}"
        turned = f"({own} + {noise}) % {m} AS {own}"
        rounds = f"SELECT start, steps, {'l, ' + turned if own == 'r' else turned + ', r'} FROM ({rounds}) x{i}, size"
    return f"""WITH RECURSIVE crcs AS (SELECT {table} AS ct),
raw AS (SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h FROM documents),
base AS (SELECT doc_id, octet_length(encode(t)) + 8 AS size, xor(list_reduce({octets}, lambda c, v: xor(c >> 8, ct[(xor(c, v) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)::BIGINT AS text_crc32 FROM raw, crcs),
size AS (SELECT count(*)::BIGINT AS n, ceil(sqrt(count(*)))::BIGINT AS a, ceil(count(*) / ceil(sqrt(count(*))))::BIGINT AS b FROM base),
numbered AS (SELECT *, row_number() OVER (ORDER BY (((coalesce(doc_id, -1) % {P31} + {P31}) % {P31}) * 1103515245 + text_crc32 % {P31}) % {P31} % {sharding.BUCKETS}, doc_id NULLS FIRST, size, text_crc32) - 1 AS number FROM base),
walk AS (SELECT number AS start, 0 AS steps, number AS p FROM numbered UNION ALL SELECT start, steps + 1, l * b + r FROM ({rounds}) z, size),
done AS (SELECT start, max_by(p, steps) AS p FROM walk GROUP BY start)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (p % {shards})::INTEGER AS shard, (p // {shards})::BIGINT AS slot, NULL::INTEGER AS grown_shard, number::BIGINT AS row_number FROM numbered JOIN done ON start = number"""


def _op11(window: int = 10, span: int = 15) -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, {words} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item, w[k:least(k + {window - 1}, len(w))] AS x FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - {window - 1}) + 1)) AS k FROM i WHERE len(w) > 0) z),
pos AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d),
starts AS (SELECT DISTINCT x, len(x) AS n, x[1] AS word FROM iw),
found AS (SELECT DISTINCT r, k, n, s.x FROM pos JOIN starts s ON pos.word = s.word JOIN d USING (r) WHERE k + n - 1 <= len(w) AND w[k:k + n - 1] = s.x),
hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(k, k + n)) AS k FROM found) z GROUP BY r),
pairs AS (SELECT DISTINCT r, item FROM found JOIN iw ON found.x = iw.x),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM pairs GROUP BY r),
often AS (SELECT word, count(*) AS n FROM pos GROUP BY word),
rare AS (SELECT x, min_by(word, (coalesce(n, 0), word)) AS word FROM (SELECT x, unnest(x) AS word FROM starts) z LEFT JOIN often USING (word) GROUP BY x),
near AS (SELECT DISTINCT r, rare.x FROM pos JOIN rare USING (word) JOIN d USING (r) WHERE list_has_all(w[greatest(1, k - {span - 1}):k + {span - 1}], rare.x) AND len(list_filter(range(greatest(1, k - {span - 1}), k + 1), lambda s: list_has_all(w[s:s + {span - 1}], rare.x))) > 0),
around AS (SELECT r, count(DISTINCT item) AS n_near_items FROM near JOIN iw ON near.x = iw.x GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(n_near_items, 0)::BIGINT AS n_near_items
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r) LEFT JOIN around USING (r)"""


def _op12() -> str:
    sound = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    return f"""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND {sound}),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id AS id, a.label = v.label AS same, list_inner_product(a.e, v.e)::BIGINT AS score FROM v AS a, v WHERE a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE same) x WHERE k <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INTEGER AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id WHERE NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT * FROM n WHERE rank <= 10"""


ORACLES: dict[str, str] = {"op1_secret_scan": _op1(), "op4_quality_rules": _op4(), "op5_feistel_shards": _op5(), "op11_positional_index": _op11(), "op12_full_sort_negatives": _op12()}
