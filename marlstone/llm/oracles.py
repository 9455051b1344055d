"""DuckDB SQL for the queries of this subpackage that SQL can express; written apart from the operators, to hold them against."""

from __future__ import annotations

OP1 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT text_sha256, count(*) AS group_size, first(doc_id ORDER BY chars DESC, doc_id) AS keep_id
  FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

#: Cosines in double precision; labels part the pairs, so that only vectors of one label are compared.
OP3 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL),
s AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
links AS (
  SELECT a.vec_id AS src, b.vec_id AS dst FROM s a JOIN s b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
reach AS (
  SELECT vec_id AS src, vec_id AS dst FROM embeddings
  UNION
  SELECT r.src, l.dst FROM reach r JOIN links l ON r.dst = l.src),
c AS (SELECT src AS vec_id, min(dst) AS component_id FROM reach GROUP BY src),
n AS (SELECT src AS vec_id, count(*) AS n_links FROM links GROUP BY src)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN n USING (vec_id)
"""

OP2 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html),
s AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS h, first FROM p JOIN f USING (html)),
g AS (
  SELECT *, list_transform(range(4), lambda i: ('0x' || substr(h, (10 * i + 1)::INT, 10))::BIGINT) AS parts FROM s)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((parts[(k // 8 + 1)::INT] >> (35 - 5 * (k % 8))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM g
"""


def _op5(weights: tuple, domains: tuple, max_epochs: int, seed: int) -> str:
    rows = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in w[:3]) + f", {w[3]}::DOUBLE)" for w in weights)
    names = ", ".join(f"'{x}'" for x in domains)

    def level(name: str, source: str, keys: str, parent: str, last: str, budget: str) -> str:
        by = f"PARTITION BY {parent}" if parent else ""
        return f"""
{name}_n AS (SELECT {keys}, sum(cap) AS cap, max(w_{name}) AS w FROM {source} GROUP BY {keys}),
{name}_b AS (SELECT n.*, budget FROM {name}_n n {budget}),
{name}_v AS (
  SELECT *, CASE WHEN w > 0 THEN (budget - coalesce(sum(cap) OVER before, 0)) / nullif(sum(w) OVER ({by}) - coalesce(sum(w) OVER before, 0), 0) END AS lv
  FROM {name}_b WINDOW before AS ({by} ORDER BY cap / nullif(w, 0) NULLS FIRST, {last} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name} AS (SELECT {keys}, CASE WHEN w > 0 THEN least(cap, w * max(lv) OVER ({by})) ELSE 0 END AS budget FROM {name}_v),"""

    return f"""
WITH given(domain, lang, source, weight) AS (VALUES {rows}),
d AS (
  SELECT doc_id, text, lang, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens,
    ([{names}])[((coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT), 0) // 5) % {len(domains)} + 1)::INT] AS domain
  FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
nodes AS (
  SELECT leaf.*, coalesce(g1.weight, 1) AS w_one, coalesce(g2.weight, 1) AS w_two, coalesce(g3.weight, 1) AS w_three, tokens * {max_epochs}::DOUBLE AS cap
  FROM leaf
  LEFT JOIN given g1 ON g1.lang IS NULL AND g1.domain = leaf.domain
  LEFT JOIN given g2 ON g2.source IS NULL AND g2.domain = leaf.domain AND g2.lang = leaf.lang
  LEFT JOIN given g3 ON g3.domain = leaf.domain AND g3.lang = leaf.lang AND g3.source = leaf.source),
root AS (SELECT least(sum(tokens)::DOUBLE, sum(cap)) AS budget FROM nodes),
{level("one", "nodes", "domain", "", "domain", "CROSS JOIN root")}
{level("two", "nodes", "domain, lang", "domain", "lang", "JOIN one USING (domain)")}
{level("three", "nodes", "domain, lang, source", "domain, lang", "source", "JOIN two USING (domain, lang)")}
plan AS (
  SELECT domain, lang, source, tokens, floor(budget + 1e-6)::BIGINT AS budget,
    CASE WHEN tokens > 0 THEN least(floor(budget + 1e-6)::BIGINT // tokens, {max_epochs}) ELSE 0 END AS epochs
  FROM three JOIN leaf USING (domain, lang, source)),
ordered AS (
  SELECT d.*, epochs, CASE WHEN epochs < {max_epochs} THEN budget - epochs * tokens ELSE 0 END AS rest,
    sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{seed}|' || epochs || '|' || doc_id || '|' || md5(coalesce(text, '')))) AS upto
  FROM d JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, (epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM ordered
"""


OP6 = """
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    10 + length(role) + 9 + 4 + length(text) + length(regexp_replace(text, '[^]', '', 'g'))
      + 2 * (length(text) - length(replace(text, '</s>', '123'))) + 2 * (length(text) - length(replace(text, '<s>', '12')))
      + 2 * (length(text) - length(replace(text, '[INST]', '12345'))) + 2 * (length(text) - length(replace(text, '[/INST]', '123456'))) AS chars
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM m)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  coalesce(sum(upto) FILTER (role = 'assistant' OR k = n), 0)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""

OP10 = r"""
WITH u AS (
  SELECT page_id, TIMESTAMP '2024-01-01' + to_seconds((page_id % 366) * 86400 + (page_id * 7919) % 86400) AS fetched,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)', 1)) AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
p AS (SELECT *, list_filter(string_split(host, '.'), lambda x: x <> '') AS hs, list_filter(string_split(path, '/'), lambda x: x <> '') AS ps FROM u),
k AS (
  SELECT DISTINCT page_id, fetched, unnest(list_concat(
    CASE WHEN host LIKE '[%' OR regexp_matches(host, '^[0-9]{1,3}([.][0-9]{1,3}){3}$') THEN ['d:' || host]
      ELSE list_transform(range(1, len(hs)), lambda i: 'd:' || array_to_string(hs[i:], '.')) END,
    list_transform(range(1, len(ps) + 1), lambda i: 'p:' || host || '/' || array_to_string(ps[:i], '/')))) AS key
  FROM p WHERE host <> ''),
n AS (SELECT key, ('0x' || substr(md5(key), 1, 6))::BIGINT AS n FROM (SELECT DISTINCT key FROM k)),
h AS (SELECT key, n, (n // 5) % 200 AS first, CASE WHEN n % 2 = 0 THEN 'malware' ELSE 'adult' END AS list FROM n WHERE n % 5 = 0),
e AS (
  SELECT list, key, first AS a, CASE n % 3 WHEN 0 THEN 100000 WHEN 1 THEN first + 90 ELSE first + 45 END AS b FROM h
  UNION ALL SELECT list, key, first + 120, 100000 FROM h WHERE n % 3 = 2),
m AS (
  SELECT page_id, list || ' ' || key AS rule FROM k JOIN e USING (key)
  WHERE fetched >= TIMESTAMP '2024-01-01' + to_days(a::INT) AND fetched < TIMESTAMP '2024-01-01' + to_days(b::INT))
SELECT page_id, count(rule) > 0 AS blocked, count(rule) AS n_rules, min(rule) AS first_rule
FROM pages LEFT JOIN m USING (page_id) GROUP BY page_id
"""


def crc32(text: str) -> str:
    """The crc32 of a text's UTF-8 bytes, bit by bit: a byte is put in, then shifted out in eight steps."""
    hexed = f"hex(encode({text}))"
    bytes_ = f"flatten(list_transform(range(length({hexed}) // 2), lambda i: [('0x' || substr({hexed}, (2 * i + 1)::INT, 2))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {bytes_}), lambda a, x: {step}), 4294967295)"


def _op11() -> str:
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')".replace("\\\\", "\\")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
b AS (SELECT {words} AS w FROM benchmark),
df AS (SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d),
bf AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM b),
k AS (SELECT f, {crc32("f")} % 10000 AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf)),
dc AS (SELECT r, bucket, count(*) AS n FROM df JOIN k USING (f) GROUP BY ALL),
s AS (SELECT bucket, sum(n)::DOUBLE AS s FROM dc GROUP BY bucket),
t AS (SELECT bucket, count(*)::DOUBLE AS t FROM bf JOIN k USING (f) GROUP BY bucket),
g AS (
  SELECT bucket, floor(1000.0::DOUBLE * ln((coalesce(t, 0) + 1) * ((SELECT sum(s) FROM s) + 10000) / ((s + 1) * (coalesce((SELECT sum(t) FROM t), 0) + 10000)))) AS gain
  FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT r, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM dc JOIN g USING (bucket) GROUP BY r),
h AS (SELECT r, doc_id, len(w) AS words, ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE AS h FROM d),
x AS (
  SELECT r, doc_id, words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM h LEFT JOIN w USING (r)),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS k, count(*) OVER () AS n FROM x WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= 25 * n // 100 THEN k END AS rank FROM x LEFT JOIN o USING (r)
"""


OP12 = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r, a.vec_id AS query_id, b.vec_id, list_dot_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM o WHERE rank <= 5
"""


def _op13() -> str:
    """Turns one after the other, with the cheapest (cost, audit) for each last role: 1 none, 2 system, 3 user, 4 assistant."""
    inserts = {(1, 2): 0, (1, 3): 0, (1, 4): 1, (2, 3): 0, (2, 4): 1, (3, 4): 0, (3, 3): 1, (4, 3): 0, (4, 4): 1}
    deleted = lambda q: f"{{'c': s[{q}].c + 2, 'a': s[{q}].a || 'D'}}"

    def state(r: int) -> str:
        price = f"CASE WHEN t.fault > 1 OR ({r} = 2 AND t.role <> 2) THEN 1000000000 ELSE 5 * t.fault + (t.role <> {r})::INT END"
        letter = f"CASE WHEN t.role = {r} THEN 'K' ELSE 'R' END"
        ways = [f"{{'c': s[{q}].c + {5 * k} + {price}, 'a': s[{q}].a || '{'I' * k}' || {letter}}}" for (q, to), k in inserts.items() if to == r]
        return f"list_min([{', '.join([deleted(r), *ways])}])"

    last = ", ".join(f"{{'c': s[{q}].c + {5 * k}, 'a': s[{q}].a || '{'I' * k}'}}" for q, k in ((1, 0), (2, 2), (3, 1), (4, 0)))
    return f"""
WITH RECURSIVE r AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fate
  FROM conversations),
d AS (
  SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM d),
f AS (
  SELECT conv_id, turn, role AS name, text, k,
    CASE role[1] WHEN 's' THEN 2 WHEN 'u' THEN 3 WHEN 'a' THEN 4 ELSE 5 END AS role,
    CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 3
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 2
      WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 1 ELSE 0 END AS fault
  FROM o),
told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 3) AS blank,
    count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 1) AS truncated, count(*) FILTER (k > 1 AND NOT fits) AS illegal
  FROM (SELECT *, (lag(role) OVER (PARTITION BY conv_id ORDER BY k), role) IN ((2, 3), (3, 4), (4, 3)) AS fits FROM f)
  GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations),
steps AS (
  SELECT conv_id, 0::BIGINT AS k, [{{'c': 0, 'a': ''}}, {{'c': 1000000000, 'a': ''}}, {{'c': 1000000000, 'a': ''}}, {{'c': 1000000000, 'a': ''}}] AS s FROM ids
  UNION ALL
  SELECT t.conv_id, t.k, [{deleted(1)}, {state(2)}, {state(3)}, {state(4)}]
  FROM steps JOIN f t ON t.conv_id IS NOT DISTINCT FROM steps.conv_id AND t.k = steps.k + 1),
ends AS (SELECT conv_id, list_min([{last}]) AS best FROM (SELECT conv_id, arg_max(s, k) AS s FROM steps GROUP BY conv_id)),
letters AS (
  SELECT conv_id, unnest(range(1, length(best.a) + 1)) AS pos, best.a[unnest(range(1, length(best.a) + 1))] AS x FROM ends),
placed AS (
  SELECT *, count(*) FILTER (x <> 'I') OVER w AS k, count(*) FILTER (x <> 'D') OVER w AS place
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
lines AS (
  SELECT p.conv_id, p.pos, p.place, p.x, CASE WHEN x <> 'I' THEN f.role END AS role, CASE WHEN x <> 'I' THEN f.name END AS name, CASE WHEN x = 'I' THEN '' ELSE f.text END AS text
  FROM placed p LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.k = p.k WHERE x <> 'D'),
named AS (
  SELECT *, (place - coalesce(max(CASE WHEN place = 1 AND x = 'K' AND role = 2 THEN 1 END) OVER (PARTITION BY conv_id), 0)) % 2 AS odd FROM lines),
texts AS (
  SELECT conv_id, string_agg(CASE WHEN x = 'K' THEN name WHEN odd = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY pos) AS whole FROM named GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, best.c::BIGINT AS cost, best.a AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM ends e LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN texts ON texts.conv_id IS NOT DISTINCT FROM e.conv_id
"""


def oracle_sql(weights: tuple, domains: tuple, max_epochs: int, seed: int) -> dict[str, str]:
    return {
        "op1_exact_dedup": OP1,
        "op2_warc": OP2,
        "op3_embedding_near_dedup": OP3,
        "op5_mixing": _op5(weights, domains, max_epochs, seed),
        "op6_chat": OP6,
        "op10_url_filters": OP10,
        "op11_importance_resampling": _op11(),
        "op12_top_k_search": OP12,
        "op13_structure_repair": _op13(),
    }
