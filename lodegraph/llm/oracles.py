"""DuckDB SQL for the queries that SQL can express."""

from lodegraph.llm.license_scan import HOLDER, KNOWN, PUBLISHED, SPELLINGS

OP1 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[p + 1 : p + 13], ' ') AS g FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 13, 0) + 1)) AS p FROM i WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM iw),
dp AS (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS p FROM d, ns WHERE len(w) >= n),
dw AS (SELECT doc_id, n, p, array_to_string(w[p + 1 : p + n], ' ') AS g FROM dp),
h AS (SELECT dw.doc_id, dw.n, dw.p, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, n, p FROM h)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""

OP8 = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
m AS (
 SELECT doc_id, source, 0 AS k, 12 AS least, regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS ms, regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS vs, string_split_regex(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS ps FROM t
 UNION ALL SELECT doc_id, source, 1, 18, regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0), regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0), string_split_regex(t, 'AKIA[A-Z0-9]+') FROM t
 UNION ALL SELECT doc_id, source, 2, 16, regexp_extract_all(t, '[0-9a-f]{16,}', 0), regexp_extract_all(t, '[0-9a-f]{16,}', 0), string_split_regex(t, '[0-9a-f]{16,}') FROM t
 UNION ALL SELECT doc_id, source, 3, 20, regexp_extract_all(t, '[A-Za-z0-9+/_=-]{20,}', 0), regexp_extract_all(t, '[A-Za-z0-9+/_=-]{20,}', 0), string_split_regex(t, '[A-Za-z0-9+/_=-]{20,}') FROM t),
o AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m WHERE len(ms) > 0),
p AS (SELECT doc_id, source, k, least, vs[i] AS v, length(ms[i]) AS n, CAST(coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s FROM o),
c AS (SELECT doc_id, source, k, v, s, s + n AS e FROM p WHERE length(v) >= least AND (k < 3 OR (regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[0-9]')))),
f AS (SELECT v, count(DISTINCT coalesce('=' || source, '')) AS owners, count(DISTINCT doc_id) AS repos FROM c GROUP BY v),
r AS (SELECT doc_id, count_if(k = 0) AS n_assign, count_if(k = 1) AS n_access, count_if(k = 2) AS n_hex,
 string_agg(['assign', 'access', 'hex', 'token'][k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS base,
 string_agg(['assign', 'access', 'hex', 'token'][k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3 OR (owners = 1 AND repos < 10)) AS spans,
 count_if(owners = 1 AND repos < 10) AS n_live, count_if(owners >= 3 OR repos >= 10) AS n_example FROM c JOIN f USING (v) GROUP BY doc_id)
SELECT t.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, CAST(coalesce(n_live, 0) AS BIGINT) AS n_live, CAST(coalesce(n_example, 0) AS BIGINT) AS n_example
FROM t LEFT JOIN r USING (doc_id)
"""

OP5 = r"""
WITH RECURSIVE d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, pos, list_filter(regexp_split_to_array(regexp_replace(line, '[^\s]*[0-9][^\s]*', '<*>', 'g'), '\s+'), lambda w: w <> '') AS ws
 FROM (SELECT doc_id, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM d)),
n AS (SELECT doc_id, pos, array_to_string(ws, ' ') AS h, len(ws) AS nw, len(ws) || ' ' || array_to_string(ws[1:4], ' ') AS leaf FROM l WHERE len(ws) >= 1),
s AS (SELECT leaf, h, any_value(nw) AS nw, count(*) AS c, count(DISTINCT doc_id) AS docs, min(doc_id) AS a, max(doc_id) AS b, min(doc_id * 1000000 + pos) AS f FROM n GROUP BY leaf, h),
v AS (SELECT leaf FROM s GROUP BY leaf HAVING count(*) > 1 AND min(a) <> max(b)),
q(leaf, h, ws, o, rep) AS (
 SELECT s.leaf, s.h, string_split(s.h, ' '), s.c * 1000000000000 - s.f, CAST(NULL AS VARCHAR) FROM s JOIN v ON s.leaf = v.leaf
 UNION ALL
 SELECT r.leaf, r.h, r.ws, r.o, CASE WHEN len(list_filter(range(1, len(r.ws) + 1), lambda i: r.ws[i] = t.ws[i])) >= 0.8 * len(r.ws) THEN t.h END
 FROM (SELECT * FROM q WHERE rep IS NULL) r JOIN (SELECT leaf, arg_max(h, o) AS h, arg_max(ws, o) AS ws FROM q WHERE rep IS NULL GROUP BY leaf) t ON r.leaf = t.leaf),
k AS (SELECT s.*, coalesce(q.rep, s.h) AS t FROM s LEFT JOIN q ON s.leaf = q.leaf AND s.h = q.h AND q.rep IS NOT NULL),
r AS (SELECT leaf, t, min(a) AS keeper FROM k GROUP BY leaf, t HAVING min(a) <> max(b) AND (min(nw) >= 5 OR max(docs) >= 10)),
g AS (SELECT n.doc_id, list(DISTINCT n.pos) AS gone FROM n JOIN k ON n.leaf = k.leaf AND n.h = k.h JOIN r ON k.leaf = r.leaf AND k.t = r.t WHERE n.doc_id <> r.keeper GROUP BY n.doc_id),
o AS (SELECT d.doc_id, len(ls) AS nl, coalesce(len(gone), 0) AS nd, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(gone, i - 1)), lambda i: ls[i]), chr(10)) END AS t FROM d LEFT JOIN g ON d.doc_id = g.doc_id)
SELECT doc_id, CAST(nl AS BIGINT) AS lines_total, CAST(nd AS BIGINT) AS lines_dropped, CAST(length(t) AS BIGINT) AS n_chars, sha256(t) AS text_sha256 FROM o
"""


MEASURED = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, p, array_to_string(w[p : p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM w WHERE len(w) >= 5)),
r AS (SELECT doc_id, p FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
 CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(length(regexp_replace(t, '\P{Lu}', '', 'g')) AS BIGINT) AS n_capitals,
 CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN c USING (doc_id)),
f AS (SELECT *, CAST((n_words < 10)::INT | 2 * (100 * n_repeat_words > 20 * n_words)::INT | 4 * (10 * n_symbols > n_words)::INT | 8 * (10 * n_capitals > 3 * word_chars)::INT
 | 16 * (2 * n_dup_lines > n_lines)::INT | 32 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::INT AS BIGINT) AS failed FROM m)
"""
OP11 = MEASURED + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed & 31 = 0 AS kept, n_capitals, n_lines, failed FROM f"
ABLATIONS = MEASURED + """,
p(policy, mask) AS (VALUES ('base', 3), ('standard', 31), ('strict', 63)),
b(rule, bit) AS (VALUES ('few_words', 1), ('repeated_words', 2), ('symbols', 4), ('capitals', 8), ('repeated_lines', 16), ('word_length', 32))
SELECT policy, CAST(1 AS INTEGER) AS version, rule, count(*) AS n_rows, CAST(count_if(failed & bit <> 0) AS BIGINT) AS n_failed, CAST(count_if(failed & mask = bit) AS BIGINT) AS n_only,
CAST(count_if(failed & mask = 0) AS BIGINT) AS n_kept, CAST(count_if(failed & mask & ~bit = 0) AS BIGINT) AS n_kept_without FROM f, p, b WHERE mask & bit <> 0 GROUP BY policy, rule
"""

OP12 = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
t AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 100),
u AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT u.lang, u.phrase, u.k, u.a, u.cut, l.a AS l, r.a AS r, t.n, (1000::HUGEINT * u.a * t.n) // (l.a::HUGEINT * r.a) AS score FROM u
 JOIN f l ON l.lang = u.lang AND l.phrase = array_to_string(u.w[1 : cut], ' ') JOIN f r ON r.lang = u.lang AND r.phrase = array_to_string(u.w[cut + 1 :], ' ') JOIN t ON t.lang = u.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
h AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c))) GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM b LEFT JOIN h ON b.lang = h.lang AND b.phrase = h.phrase WHERE longer IS NULL OR 100 * longer < 100 * a QUALIFY rank <= 2000
"""


def op2() -> str:
    def canonical(text: str) -> str:
        low = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        low = rf"regexp_replace({low}, '{HOLDER}', '{PUBLISHED}', 'g')"
        bare = rf"regexp_replace({low}, '(?m)^[ \t]*(?:copyright|\(c\)|©)[^\n]*$', '', 'g')"
        words = rf"' ' || regexp_replace({bare}, '[\x00-\x2F\x3A-\x60\x7B-\x7F©]+', '  ', 'g') || ' '"
        for old, new in SPELLINGS:
            words = f"replace({words}, ' {old.replace(' ', '  ')} ', ' {new.replace(' ', '  ')} ')"
        return f"trim(regexp_replace({words}, ' +', ' ', 'g'))"

    known = ", ".join("('" + name + "', '" + body.replace("'", "''") + "')" for name, body in KNOWN)
    return f"""
WITH kt(license, body) AS (VALUES {known}),
kd AS (SELECT sha256({canonical("body")}) AS digest, min(license) AS license FROM kt GROUP BY 1),
t AS (SELECT doc_id, {canonical("text")} AS c FROM documents),
l AS (SELECT doc_id, {canonical("line")} AS c FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
p AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*) AS n FROM l JOIN kd ON sha256(l.c) = kd.digest WHERE l.c <> '' GROUP BY doc_id)
SELECT t.doc_id, CASE WHEN c <> '' THEN sha256(c) END AS text_digest, kd.license, coalesce(notices, '') AS notices, CAST(coalesce(n, 0) AS BIGINT) AS n_notices
FROM t LEFT JOIN kd ON sha256(t.c) = kd.digest AND t.c <> '' LEFT JOIN p ON t.doc_id = p.doc_id
"""
