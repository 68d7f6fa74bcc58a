"""SQL for the training-data queries that SQL can express on whole tables.

The others (signatures of trained or drawn models, token ids, page parsing, sharding by hashes)
are tested against brute force.
"""

from __future__ import annotations

from . import decontaminate, lm_score, minhash_dedup, rule_ledger, vector_codes

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP1 = rf"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, array_to_string(CASE WHEN len(w) < {minhash_dedup.WORDS} THEN w ELSE w[i : i + {minhash_dedup.WORDS - 1}] END, ' ') AS g
 FROM d, unnest(range(1, greatest(len(w) - {minhash_dedup.WORDS - 2}, 2))) t(i) WHERE len(w) > 0),
c AS (SELECT doc_id, g, count(*) AS n FROM s GROUP BY 1, 2), z AS (SELECT doc_id, sum(n) AS n FROM c GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.n, b.n)) AS m FROM c a JOIN c b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN z a ON a.doc_id = x JOIN z b ON b.doc_id = y WHERE m * 5 >= 4 * (a.n + b.n - m)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
k AS (SELECT x AS doc_id, min(y) AS class_id FROM r GROUP BY 1)
SELECT k.doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles FROM k LEFT JOIN z USING (doc_id)"""

OP3 = rf"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
t AS (SELECT doc_id, i, w[i] AS a, CASE WHEN i > 1 THEN w[i - 1] END AS b FROM d, unnest(range(1, len(w) + 1)) u(i)),
n AS (SELECT count(*) AS total FROM t), l AS (SELECT doc_id, count(*) AS own FROM t GROUP BY 1),
u AS (SELECT a, count(*) AS n FROM t GROUP BY 1), du AS (SELECT doc_id, a, count(*) AS n FROM t GROUP BY 1, 2),
g AS (SELECT b, a, count(*) AS n FROM t WHERE b IS NOT NULL GROUP BY 1, 2), dg AS (SELECT doc_id, b, a, count(*) AS n FROM t WHERE b IS NOT NULL GROUP BY 1, 2, 3),
c AS (SELECT t.doc_id, t.b, total - own AS rest, u.n - du.n AS c1, coalesce(g.n - dg.n, 0) AS c2, coalesce(v.n - dv.n, 0) AS c0
 FROM t JOIN u ON u.a = t.a JOIN du ON du.doc_id = t.doc_id AND du.a = t.a LEFT JOIN g ON g.b = t.b AND g.a = t.a LEFT JOIN dg ON dg.doc_id = t.doc_id AND dg.b = t.b AND dg.a = t.a
 LEFT JOIN u v ON v.a = t.b LEFT JOIN du dv ON dv.doc_id = t.doc_id AND dv.a = t.b JOIN l ON l.doc_id = t.doc_id, n),
s AS (SELECT doc_id, CASE WHEN b IS NOT NULL AND c2 > 0 THEN ln(c2 / c0) ELSE ln(CASE WHEN b IS NULL THEN 1.0 ELSE {lm_score.BACKOFF} END * CASE WHEN c1 > 0 THEN c1 / rest ELSE 1 / (rest + 1.0) END) END AS v,
 CASE WHEN (b IS NOT NULL AND c2 <= 0) OR (b IS NULL AND c1 <= 0) THEN 1 ELSE 0 END AS off FROM c)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(sum(off), 0) AS BIGINT) AS n_backed_off, round(sum(v), 4) AS log_score, round(sum(v) / len(w), 6) AS mean_log_score
 FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id, w"""

OP8 = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + {rule_ledger.WINDOW - 1}], ' ') AS s FROM d, unnest(range(1, len(w) - {rule_ledger.WINDOW - 2})) t(i)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS k FROM g) WHERE k > 1),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, range(0, {rule_ledger.WINDOW}) t(j) GROUP BY 1),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
 CAST(length(regexp_replace(array_to_string(w, ''), '\P{{Lu}}', '', 'g')) AS BIGINT) AS n_capitals, CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS n_exclamations,
 CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct, CAST(coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS longest_word FROM d LEFT JOIN c USING (doc_id)),
b AS (SELECT *, CAST(CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END + CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END
 + CASE WHEN word_chars < 3 * n_words OR word_chars > 10 * n_words THEN 8 ELSE 0 END + CASE WHEN n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines THEN 16 ELSE 0 END
 + CASE WHEN 100 * n_capitals > 30 * word_chars THEN 32 ELSE 0 END + CASE WHEN 100 * n_exclamations > 20 * n_words THEN 64 ELSE 0 END
 + CASE WHEN 100 * n_distinct < CASE WHEN n_words < 100 THEN 30 ELSE 10 END * n_words THEN 128 ELSE 0 END + CASE WHEN longest_word > 1000 THEN 256 ELSE 0 END AS BIGINT) AS fail_bits FROM m)
SELECT *, (fail_bits & {rule_ledger.mask("v1")}) <> 0 AS base_failed, (fail_bits & {rule_ledger.mask("v1") | rule_ledger.mask(rule_ledger.POLICY)}) = 0 AS kept FROM b"""

_OUTER = r"\x00-\x24\x26-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"


def _core(word: str) -> str:
    """A word in lower case without outer ASCII punctuation (a last % stays), one character at least."""
    return f"lower(regexp_extract(regexp_extract({word}, '^((?s:.+?))[{_OUTER}]*$', 1), '^[{_OUTER}%]*((?s:.+))$', 1))"


def _exact(slots: str) -> str:
    """Whether a window is matched with the values of its slots."""
    return f"(2 * len(list_filter({slots}, lambda x: x IS NULL)) < width OR width < {decontaminate.SHORTEST})"


def _key(slots: str) -> str:
    return f"array_to_string(tw, ' ') || CASE WHEN {_exact(slots)} THEN chr(10) || array_to_string(list_transform({slots}, lambda x: coalesce(x, '')), chr(10)) ELSE '' END"


_LISTED = ", ".join(f"'{w}'" for w in decontaminate.NUMBERS)
_UNITS = ", ".join(f"'{w}'" for w in decontaminate.UNITS)

OP7 = rf"""WITH src AS (SELECT DISTINCT 'd' AS k, doc_id AS id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL UNION ALL SELECT DISTINCT 'b', item_id, coalesce(text, '') FROM benchmark WHERE item_id IS NOT NULL),
w AS (SELECT k, id, row_number() OVER () AS rid, {_WORDS} AS w FROM src), t AS (SELECT k, id, rid, i, w[i] AS raw, CASE WHEN i > 1 THEN w[i - 1] END AS prev FROM w, unnest(range(1, len(w) + 1)) u(i)),
c AS (SELECT *, {_core("raw")} AS core, CASE WHEN prev IS NOT NULL THEN {_core("prev")} END AS before FROM t),
n AS (SELECT *, regexp_matches(core, '^[0-9]') OR core IN ({_LISTED}) AS num, coalesce(regexp_matches(before, '^[0-9]') OR before IN ({_LISTED}), false) AS after_num FROM c),
y AS (SELECT *, CASE WHEN num THEN '<num>' WHEN after_num AND core IN ({_UNITS}) THEN '<unit>'
 WHEN prev IS NOT NULL AND NOT regexp_matches(prev, '[.!?:]$') AND regexp_matches(regexp_extract(regexp_extract(raw, '^((?s:.+?))[{_OUTER}]*$', 1), '^[{_OUTER}%]*((?s:.+))$', 1), '^[A-ZÀ-Þ]') THEN '<name>' END AS kind FROM n),
a AS (SELECT k, id, rid, i, core, kind, CASE WHEN kind = lag(kind) OVER (PARTITION BY rid ORDER BY i) THEN 1 ELSE 0 END AS again FROM y),
z AS (SELECT *, sum(1 - again) OVER (PARTITION BY rid ORDER BY i) AS g, sum(again) OVER (PARTITION BY rid) AS runs FROM a),
s AS (SELECT k, id, rid, g, coalesce(min(kind), min(core)) AS tok, CASE WHEN min(kind) IS NOT NULL THEN min(kind) || string_agg(core, ' ' ORDER BY i) END AS slot FROM z WHERE runs > 0 GROUP BY 1, 2, 3, 4),
l AS (SELECT k, id, rid, CASE WHEN max(runs) > 0 THEN 1 ELSE 3 END AS form, list(coalesce(kind, core) ORDER BY i) AS tk, list(CASE WHEN kind IS NOT NULL THEN kind || core END ORDER BY i) AS sl, count(*) AS n FROM z GROUP BY 1, 2, 3
 UNION ALL SELECT k, id, rid, 2, list(tok ORDER BY g), list(slot ORDER BY g), count(*) FROM s GROUP BY 1, 2, 3),
b0 AS (SELECT id AS item_id, rid AS brid, form, i, least(n, {decontaminate.WIDTH}) AS width, n - least(n, {decontaminate.WIDTH}) + 1 AS windows, tk[i : i + least(n, {decontaminate.WIDTH}) - 1] AS tw, sl[i : i + least(n, {decontaminate.WIDTH}) - 1] AS bs
 FROM l, unnest(range(1, n - least(n, {decontaminate.WIDTH}) + 2)) u(i) WHERE k = 'b'),
d0 AS (SELECT id AS doc_id, rid AS drid, form, i, width, tk[i : i + width - 1] AS tw, sl[i : i + width - 1] AS ds FROM l, (SELECT DISTINCT width FROM b0), unnest(range(1, n - width + 2)) u(i) WHERE k = 'd' AND (width >= {decontaminate.SHORTEST} OR n = width)),
b AS (SELECT *, {_exact("bs")} AS exact, {_key("bs")} AS key FROM b0), d AS (SELECT *, {_key("ds")} AS key FROM d0),
o AS (SELECT brid, form, count(*) FILTER (NOT exact) AS n_open FROM b GROUP BY 1, 2),
m AS (SELECT doc_id, drid, item_id, b.brid, d.form & b.form AS form, d.i - b.i AS offs, b.i AS pos, windows, n_open, exact, bs, ds FROM d JOIN b USING (key, width) JOIN o ON o.brid = b.brid AND o.form = b.form WHERE d.form & b.form > 0),
p AS (SELECT doc_id, drid, item_id, brid, form, offs, bs[j] AS x, ds[j] AS y FROM m, unnest(range(1, len(bs) + 1)) u(j) WHERE NOT exact AND bs[j] IS NOT NULL GROUP BY ALL),
q AS (SELECT doc_id, drid, item_id, brid, form, offs, count(*) AS pairs, count(DISTINCT x) AS xs, bool_and(x = y) AS same FROM p GROUP BY 1, 2, 3, 4, 5, 6),
g AS (SELECT doc_id, drid, item_id, brid, form, offs, count(DISTINCT pos) AS matched, count(DISTINCT pos) FILTER (NOT exact) AS open, max(windows) AS windows, max(n_open) AS n_open FROM m GROUP BY 1, 2, 3, 4, 5, 6),
e AS (SELECT doc_id, item_id, form, matched, windows, coalesce(same, true) AS same FROM g LEFT JOIN q USING (doc_id, drid, item_id, brid, form, offs)
 WHERE coalesce(pairs = xs, true) AND (matched >= {decontaminate.SHARE} * windows OR matched >= {decontaminate.ENOUGH} OR (open > 0 AND open >= {decontaminate.SHARE} * n_open)))
SELECT doc_id, item_id, coalesce(max(matched) FILTER (form <> 2), max(matched)) AS matched, coalesce(max(windows) FILTER (form <> 2), max(windows)) AS windows, coalesce(bool_or(same) FILTER (form <> 2), bool_or(same)) AS verbatim FROM e GROUP BY 1, 2"""

OP12 = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT doc_id, text, w, CAST(len(w) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
f AS (SELECT doc_id, text, w, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
 CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
c AS (SELECT doc_id, text, n, form, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:], '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM c"""


def _op13() -> str:
    """Every distance in plain SQL: all parts against all entries of their codebook, in two rounds and once more."""
    parts, entries, scale = vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.SCALE
    near = lambda book: (
        f"SELECT r, part, min_by(e, d * {entries} + e) AS e, min(d) AS d, any_value(x) AS x FROM (SELECT p.r, p.part, b.e, p.x, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN {book} b USING (part)) GROUP BY 1, 2"
    )
    moved = lambda near_, book: (
        f"SELECT b.part, b.e, CASE WHEN s.x IS NULL THEN b.x ELSE s.x END AS x FROM {book} b LEFT JOIN (SELECT part, e, list(CAST(floor(t / n) AS BIGINT) ORDER BY j) AS x FROM (SELECT part, e, j, sum(x[j]) AS t, count(*) AS n FROM {near_}, (SELECT unnest(range(1, len(x) + 1)) AS j FROM (SELECT x FROM {near_} LIMIT 1)) GROUP BY 1, 2, 3) GROUP BY 1, 2) s USING (part, e)"
    )
    return f"""WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS x FROM k, unnest(range({parts})) t(part)),
b0 AS MATERIALIZED (SELECT part, r - 1 AS e, x FROM p WHERE r <= {entries}), n0 AS MATERIALIZED ({near("b0")}), b1 AS MATERIALIZED ({moved("n0", "b0")}),
n1 AS MATERIALIZED ({near("b1")}), b2 AS MATERIALIZED ({moved("n1", "b1")}), n2 AS MATERIALIZED ({near("b2")}),
c AS (SELECT r, string_agg(lpad(lower(hex(e)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM n2 GROUP BY 1),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN c USING (r), h"""


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_dedup": OP1, "op3_lm_score": OP3, "op7_decontaminate": OP7, "op8_rule_ledger": OP8, "op12_fill_middle": OP12, "op13_vector_codes": _op13()}
