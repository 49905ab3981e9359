"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from duecast.llm import chat_format, quality_rules, secret_scan


def _listed(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_STOP = _listed(sorted({w for words in quality_rules.STOP_WORDS.values() for w in words}))


def _rule_sql(rule: quality_rules.Rule) -> str:
    figure = f"100 * {rule.figure}" if rule.per else rule.figure
    per = rule.per or "1"
    sides = [f"{figure} >= {rule.least} * {per}"] if rule.least is not None else []
    sides += [f"{figure} <= {rule.most} * {per}"] if rule.most is not None else []
    return f"CASE WHEN {' AND '.join(sides)} THEN NULL ELSE '{rule.name}' END"


OP1 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM s)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
f AS (SELECT s.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             len(list_filter(w, lambda x: lower(x) IN ({_STOP})))::BIGINT AS n_stop_words,
             len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM s LEFT JOIN c USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             concat_ws(',', {', '.join(_rule_sql(r) for r in quality_rules.THRESHOLDS)}) AS failed_rules FROM f)
SELECT *, NOT base_failed AND failed_rules = '' AS kept FROM v
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4 = rf"""
WITH i AS (SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM i)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
k AS (SELECT DISTINCT n FROM iw),
u AS (SELECT doc_id, len(w) AS m, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM d),
dw AS (SELECT doc_id, n, k, g FROM (
    SELECT doc_id, n, k, m, string_agg(x, ' ') OVER (PARTITION BY doc_id, n ORDER BY k ROWS BETWEEN CURRENT ROW AND n - 1 FOLLOWING) AS g FROM u, k) WHERE k + n - 1 <= m),
h AS (SELECT doc_id, item_id, k, n FROM dw JOIN iw USING (n, g)),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT doc_id, k, n FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def _kind_sql(order: int, kind: str) -> str:
    pattern, group, least, shows = secret_scan.KINDS[kind]
    quoted = pattern.replace("'", "''")
    more = "".join(f" AND regexp_matches(v, '{s}')" for s in shows)
    return f"""SELECT doc_id, o, {order} AS kind_no, '{kind}' AS kind, s, e, v FROM (
    SELECT doc_id, o, m[i] AS m, v[i] AS v, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s, s + length(m[i]) AS e
    FROM (SELECT doc_id, o, m, v, g, unnest(range(1, len(m) + 1)) AS i FROM (
        SELECT doc_id, o, regexp_extract_all(t, '{quoted}') AS m, regexp_extract_all(t, '{quoted}', {group}) AS v, string_split_regex(t, '{quoted}') AS g FROM d)))
  WHERE length(v) >= {least}{more}"""


_SPANS = "\nUNION ALL\n".join(_kind_sql(n, k) for n, k in enumerate(secret_scan.KINDS))
_BASE = _listed(list(secret_scan.BASE_KINDS))

OP10 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS o FROM documents),
a AS ({_SPANS}),
w AS (SELECT v, count(DISTINCT o) AS owners FROM a GROUP BY v),
j AS (SELECT a.*, owners, kind || ':' || s::BIGINT || ':' || e::BIGINT AS x FROM a JOIN w USING (v) WHERE kind IN ({_BASE}) OR owners = 1),
p AS (SELECT doc_id, {', '.join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in secret_scan.BASE_KINDS)},
             string_agg(x, ',' ORDER BY s, kind_no) FILTER (WHERE kind IN ({_BASE})) AS base, string_agg(x, ',' ORDER BY s, kind_no) AS spans,
             count(*) FILTER (WHERE owners >= {secret_scan.SHARED_OWNERS}) AS n_shared, count(*) FILTER (WHERE owners = 1) AS n_owner_specific
      FROM j GROUP BY doc_id)
SELECT doc_id, {', '.join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in secret_scan.BASE_KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_shared, 0)::BIGINT AS n_shared, coalesce(n_owner_specific, 0)::BIGINT AS n_owner_specific
FROM d LEFT JOIN p USING (doc_id)
"""

OP5 = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
h AS (SELECT page_id, regexp_extract(r, '^[^/?#]*') AS h0, r FROM u),
p AS (SELECT page_id, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(r, length(h0) + 1), '^[^?#]*') AS path FROM h),
w AS (SELECT *, CASE
    WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM w
"""

OP7 = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
e AS (SELECT *, length(regexp_replace(replace(role, '\', '\\'), '([<\[])(\||/?s>|/?INST\]|</?SYS>>)', '\1\\\2', 'g'))
              + length(regexp_replace(replace(text, '\', '\\'), '([<\[])(\||/?s>|/?INST\]|</?SYS>>)', '\1\\\2', 'g')) + {len(chat_format.TURN + chat_format.SAYS + chat_format.END)} AS n FROM t)
SELECT conv_id::BIGINT AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

OP11 = rf"""
WITH d AS (SELECT doc_id, unnest({_WORDS}) AS term FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM n),
t AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY doc_id, term),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark)),
w AS (SELECT item_id, term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM q JOIN f USING (term), s),
x AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // total)))))::BIGINT AS score
      FROM w JOIN t USING (term) JOIN n USING (doc_id), s GROUP BY item_id, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0) WHERE rank <= 50
"""

OP12 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
l AS (SELECT page_id, h, octet_length(encode(h)) AS n, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN n >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < last THEN last END AS refers_to
FROM l
"""

OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
             + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
             + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > min(doc_id) OVER (PARTITION BY t))::INT AS mask FROM d),
g AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM m LEFT JOIN g USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step, coalesce(list_sum([1 << (ascii(l) - 65) for l in string_split(substr(filter_order, 1, step - 1), '') if l <> '']), 0)::INTEGER AS earlier,
             1 << (ascii(substr(filter_order, step, 1)) - 65) AS own FROM (SELECT filter_order, unnest([1, 2, 3, 4, 5])::INTEGER AS step FROM o)),
r AS (SELECT part, filter_order, step, own,
             coalesce(sum(n) FILTER (WHERE mask & (earlier | own) = 0), 0) AS kept,
             coalesce(sum(n) FILTER (WHERE mask & earlier = 0 AND mask & own > 0), 0) AS removed,
             coalesce(sum(n) FILTER (WHERE mask & earlier > 0 AND mask & own > 0), 0) AS redundant,
             coalesce(sum(n) FILTER (WHERE mask = own), 0) AS unique_fails,
             coalesce(sum(n) FILTER (WHERE mask & earlier = 0 AND mask & own > 0 AND good), 0) AS good_lost,
             coalesce(sum(n) FILTER (WHERE mask & earlier = 0 AND mask & own > 0 AND toxic), 0) AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r
"""
