"""DuckDB SQL for the queries of registry, written apart from the operators to hold them against."""

from __future__ import annotations

from itertools import combinations

OC = "oc AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice, c_mktsegment, c_acctbal, least(floor(o_totalprice / 100000), 4)::INT::VARCHAR AS band FROM orders JOIN customer ON o_custkey = c_custkey)"
DL = "dl AS (SELECT doc_id, lang, source, n_chars::DOUBLE AS n_chars, quality::VARCHAR AS quality, toxic::VARCHAR AS toxic FROM documents JOIN labels USING (doc_id))"
ITEMS = ("c_mktsegment", "o_orderpriority", "o_orderstatus")
LEAST = "(SELECT greatest(1, floor({s} * count(*))) FROM oc)"
COVERS = (
    "(o_orderpriority = '1-URGENT' AND o_totalprice > 250000)",
    "(c_mktsegment <> 'BUILDING' AND o_totalprice <= 120000)",
    "(o_orderpriority = '5-LOW')",
    "(c_acctbal <= 2500)",
)
HEADS = ("F", "O", "P", "F")
BODIES = ("o_orderpriority=1-URGENT & o_totalprice>250000", "c_mktsegment<>BUILDING & o_totalprice<=120000", "o_orderpriority=5-LOW", "c_acctbal<=2500")


def _item(a: str) -> str:
    return f"'{a}=' || {a}"


def _itemsets(attrs: tuple[str, ...], support: float) -> str:
    parts = []
    for n in range(1, len(attrs) + 1):
        for chosen in combinations(attrs, n):
            name = " || ' & ' || ".join(_item(a) for a in chosen)
            keys = ", ".join(chosen)
            parts.append(f"SELECT {name} AS items, {n} AS length, count(*) AS freq FROM oc GROUP BY {keys} HAVING count(*) >= {LEAST.format(s=support)}")
    return "found AS (" + " UNION ALL ".join(parts) + ")"


def _itemset_counts(attrs: tuple[str, str, str], support: float) -> str:
    """Candidates of three columns by length: all items, pairs of frequent items, and triples whose pairs are all frequent."""
    least, (a, b, c) = LEAST.format(s=support), attrs
    one = {x: f"(SELECT {x} FROM oc WHERE {x} IS NOT NULL GROUP BY {x} HAVING count(*) >= {least})" for x in attrs}
    two = {(x, y): f"(SELECT {x}, {y} FROM oc GROUP BY {x}, {y} HAVING count(*) >= {least})" for x, y in ((a, b), (a, c), (b, c))}
    pairs = " + ".join(f"(SELECT count(*) FROM {one[x]}) * (SELECT count(*) FROM {one[y]})" for x, y in two)
    triples = f"(SELECT count(*) FROM {two[a, b]} p JOIN {two[a, c]} q USING ({a}) JOIN {two[b, c]} r ON r.{b} = p.{b} AND r.{c} = q.{c})"
    return f"""WITH {OC}, {_itemsets(attrs, support)},
n AS (SELECT 1 AS length, {' + '.join(f'(SELECT count(DISTINCT {x}) FROM oc)' for x in attrs)} AS candidates UNION ALL SELECT 2, {pairs} UNION ALL SELECT 3, {triples})
SELECT length, candidates::BIGINT AS candidates, (SELECT count(*) FROM found f WHERE f.length = n.length) AS itemsets FROM n WHERE candidates > 0"""


def _rules(attrs: tuple[str, ...], support: float, conf: float) -> str:
    parts = []
    for n in range(2, len(attrs) + 1):
        for chosen in combinations(attrs, n):
            for head in chosen:
                body = [a for a in chosen if a != head]
                text = " || ' & ' || ".join(f"'{a}=' || w.{a}" for a in body)
                on = " AND ".join(f"w.{a} = b.{a}" for a in body)
                parts.append(
                    f"SELECT {text} AS body, "
                    f"'{head}=' || w.{head} AS head, w.n AS pos, b.n - w.n AS neg, b.n AS freq, round(w.n / b.n, 9) AS conf "
                    f"FROM (SELECT {', '.join(chosen)}, count(*) AS n FROM oc GROUP BY ALL) w JOIN (SELECT {', '.join(body)}, count(*) AS n FROM oc GROUP BY ALL) b ON {on} "
                    f"WHERE w.n >= {LEAST.format(s=support)} AND w.n / b.n >= {conf}"
                )
    return " UNION ALL ".join(parts)


def _class_rules(conf: float, support: float, selected: bool) -> str:
    attrs = ("band", "c_mktsegment", "o_orderpriority")
    parts = []
    for n in range(1, 4):
        for chosen in combinations(attrs, n):
            items = "[" + ", ".join(_item(a) for a in chosen) + "]"
            keys = ", ".join(chosen)
            parts.append(
                f"SELECT {items} AS body, 'o_orderstatus=' || o_orderstatus AS head, count(*) AS pos, "
                f"sum(count(*)) OVER (PARTITION BY {keys}) AS freq FROM oc GROUP BY {keys}, o_orderstatus"
            )
    odds = f"""
long AS (SELECT o_orderkey, 'o_orderstatus=' || o_orderstatus AS cls, unnest([{', '.join(_item(a) for a in (*attrs, 'o_orderstatus'))}]) AS item FROM oc),
cls AS (SELECT cls, count(*) AS n1, (SELECT count(*) FROM oc) - count(*) AS n0 FROM (SELECT DISTINCT o_orderkey, cls FROM long) GROUP BY cls),
cnt AS (SELECT item, c.cls, count(*) FILTER (l.cls = c.cls) AS v11, count(*) FILTER (l.cls <> c.cls) AS v01, any_value(n1) AS n1, any_value(n0) AS n0 FROM long l, cls c WHERE item <> c.cls GROUP BY item, c.cls),
e AS (SELECT *, 1 / ((n1 + n0) * (n1 + n0))::DOUBLE AS e FROM cnt),
o AS (SELECT item, cls, log2(
  (CASE WHEN v11 = 0 THEN e / (1 - e) WHEN v11 = n1 THEN (1 - e) / e ELSE (v11 / n1) / (1 - v11 / n1) END) /
  (CASE WHEN v01 = 0 THEN e / (1 - e) WHEN v01 = n0 THEN (1 - e) / e ELSE (v01 / n0) / (1 - v01 / n0) END)) AS score FROM e),
ranked AS (SELECT item, cls, row_number() OVER (PARTITION BY cls ORDER BY score DESC, item) AS k FROM o),
keep AS (SELECT cls, list(item) AS items FROM ranked WHERE k <= floor(0.5 * (SELECT count(DISTINCT item) FROM long) + 0.5) GROUP BY cls),"""
    only = "JOIN keep ON keep.cls = head AND list_has_all(keep.items, body)" if selected else ""
    return f"""WITH {OC},{odds if selected else ''}
c AS ({' UNION ALL '.join(parts)}),
r AS (SELECT body, head, pos, freq, pos / freq AS conf FROM c {only} WHERE pos >= {LEAST.format(s=support)} AND pos / freq >= {conf})
SELECT array_to_string(body, ' & ') AS body, head, pos, (freq - pos)::BIGINT AS neg, freq::BIGINT AS freq, round(conf, 9) AS conf FROM r
WHERE NOT EXISTS (SELECT 1 FROM r s WHERE s.head = r.head AND len(s.body) < len(r.body) AND list_has_all(r.body, s.body))"""


def _gain(lift: bool, source: str, attrs: dict[str, str], class_: str, cte: str) -> str:
    long = " UNION ALL ".join(f"SELECT '{a}' AS attr, {e} AS value, {class_} AS class FROM {source}" for a, e in attrs.items())
    within = "(na / N) * ((n / nc) / (na / N)) * log2((n / nc) / (na / N))" if lift else "(na / N) * (n / na) * log2(n / na)"
    return f"""WITH {cte}, long AS ({long}),
t AS (SELECT attr, value, class, count(*)::DOUBLE AS n FROM long WHERE value IS NOT NULL AND class IS NOT NULL GROUP BY ALL),
m AS (SELECT *, sum(n) OVER (PARTITION BY attr) AS N_, sum(n) OVER (PARTITION BY attr, value) AS na, sum(n) OVER (PARTITION BY attr, class) AS nc FROM t),
h AS (SELECT attr, -sum((nc / N_) * log2(nc / N_)) AS h FROM (SELECT DISTINCT attr, class, nc, N_ FROM m) GROUP BY attr),
w AS (SELECT attr, sum({within.replace('N', 'N_')}) AS w FROM m GROUP BY attr)
SELECT attr, round(h + w, 9) AS gain FROM h JOIN w USING (attr)"""


def _odds() -> str:
    return f"""WITH {OC},
long AS (SELECT o_orderstatus = 'F' AS t, unnest([{', '.join(_item(a) for a in ITEMS)}]) AS item FROM oc),
n AS (SELECT count(*) FILTER (o_orderstatus = 'F') AS n1, count(*) FILTER (o_orderstatus <> 'F') AS n0, 1 / (count(*) * count(*))::DOUBLE AS e FROM oc),
c AS (SELECT item, count(*) FILTER (t) AS v11, count(*) FILTER (NOT t) AS v01 FROM long WHERE item <> 'o_orderstatus=F' GROUP BY item),
o AS (SELECT item, log2(
  (CASE WHEN v11 = 0 THEN e / (1 - e) WHEN v11 = n1 THEN (1 - e) / e ELSE (v11 / n1) / (1 - v11 / n1) END) /
  (CASE WHEN v01 = 0 THEN e / (1 - e) WHEN v01 = n0 THEN (1 - e) / e ELSE (v01 / n0) / (1 - v01 / n0) END)) AS score FROM c, n)"""


def _corr() -> str:
    return f"""WITH {OC},
long AS (SELECT o_orderkey, unnest([{', '.join(_item(a) for a in ITEMS)}]) AS item FROM oc),
n AS (SELECT count(*) AS N FROM oc),
p AS (SELECT item, count(*) / any_value(N) AS p FROM long, n GROUP BY item HAVING count(*) < any_value(N)),
b AS (SELECT x.item AS a, y.item AS b, count(*) AS n11 FROM long x JOIN long y USING (o_orderkey) WHERE x.item < y.item GROUP BY ALL),
corr AS (
  SELECT x.item AS a, y.item AS b, (coalesce(n11, 0) / N - x.p * y.p) / sqrt(x.p * (1 - x.p) * y.p * (1 - y.p)) AS corr
  FROM p x JOIN p y ON x.item < y.item LEFT JOIN b ON b.a = x.item AND b.b = y.item, n)"""


def _greedy(steps: int, most_rows: bool, heads: list[int], default: bool, name: str = "") -> str:
    """CTEs that pick rule after rule on rows that none before covers."""
    flags = ", ".join(f"coalesce({c}, false)" for c in COVERS)
    out = [f"s{name} AS (SELECT [{flags}] AS cov, o_orderstatus AS cls, count(*) AS n FROM oc GROUP BY ALL)"]
    ids = ", ".join(f"({i}, '{HEADS[i]}')" for i in heads)
    for k in range(1, steps + 1):
        prior = " AND ".join([f"NOT cov[(SELECT rule + 1 FROM pick{name}{j})]" for j in range(1, k)]) or "true"
        taken = " AND ".join([f"r.rule <> (SELECT rule FROM pick{name}{j})" for j in range(1, k)]) or "true"
        order = "pos + neg DESC, rule" if most_rows else "pos DESC, neg, rule"
        out.append(
            f"pick{name}{k} AS (SELECT rule, head, coalesce(sum(n) FILTER (cls = head), 0)::BIGINT AS pos, coalesce(sum(n) FILTER (cls <> head), 0)::BIGINT AS neg "
            f"FROM (VALUES {ids}) r(rule, head) LEFT JOIN (SELECT * FROM s{name} WHERE {prior}) ON cov[rule + 1] WHERE {taken} GROUP BY rule, head ORDER BY {order} LIMIT 1)"
        )
    if default:
        prior = " AND ".join([f"NOT cov[(SELECT rule + 1 FROM pick{name}{j})]" for j in range(1, steps + 1)])
        out.append(f"rest{name} AS (SELECT cls FROM s{name} WHERE {prior} GROUP BY cls ORDER BY sum(n) DESC, cls LIMIT 1)")
    return ", ".join(out)


def _picked(steps: int, default: bool, counts: bool = True) -> str:
    bodies = "[" + ", ".join(f"'{b}'" for b in BODIES) + "]"
    pos = "pos, neg" if counts else "0::BIGINT AS pos, 0::BIGINT AS neg"
    parts = [f"SELECT {k - 1}::BIGINT AS place, {bodies}[rule + 1] AS body, 'o_orderstatus=' || head AS head, {pos} FROM pick{k}" for k in range(1, steps + 1)]
    if default:
        parts.append(f"SELECT {steps}, '', 'o_orderstatus=' || coalesce((SELECT cls FROM rest), 'F'), 0, 0")
    return " UNION ALL ".join(parts)


CHAIN = "CASE " + " ".join(f"WHEN {c} THEN '{h}'" for c, h in zip(COVERS, HEADS)) + " END"
#: Squared distances to the fixed centroids.
DISTANCES = (
    "1 - 2 * (CASE c_mktsegment WHEN 'BUILDING' THEN 0.75 WHEN 'FURNITURE' THEN 0.25 ELSE 0 END) + 0.625 + 0.5 * (z + 1) * (z + 1)",
    "1 - 2 * (CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') THEN 0.5 ELSE 0 END) + 0.5 + 0.5 * (z - 0.5) * (z - 0.5)",
    "1 - 2 * (CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 1 ELSE 0 END) + 1 + 0.5 * (z - 1.25) * (z - 1.25)",
)
ASSIGNED = (
    "d AS (SELECT c_custkey, c_mktsegment, z, "
    + ", ".join(f"round({x}, 12) AS d{i}" for i, x in enumerate(DISTANCES))
    + " FROM (SELECT c_custkey, c_mktsegment, (c_acctbal - 4500.0) / 3000.0 AS z FROM customer)), "
    "a AS (SELECT *, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS cluster FROM d)"
)
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def _relief(second: bool) -> str:
    """Nearest hit and miss of rows sampled evenly in the order of a hash, and the steps of each item's weight."""
    target, m, step = "'o_orderstatus=F'", 100, 2 if second else 1
    items = ", ".join(_item(a) for a in ("band", *ITEMS))
    sign = "(CASE WHEN ot THEN 1 ELSE -1 END) * (CASE WHEN o THEN 1 ELSE -1 END)"
    more = " - (CASE WHEN miss IS NOT NULL AND o AND im THEN 1 ELSE 0 END) - (CASE WHEN hit IS NOT NULL AND NOT ot AND o <> ih THEN 1 ELSE 0 END)" if second else ""
    return f"""WITH {OC},
t AS (SELECT [{items}] AS items, count(*) AS w FROM oc GROUP BY ALL),
s AS (SELECT items AS own, w, sum(w) OVER (ORDER BY md5('42|' || array_to_string(items, '|')) ROWS UNBOUNDED PRECEDING)::BIGINT AS upto, (sum(w) OVER ())::BIGINT AS total FROM t),
sampled AS (
  SELECT own, times FROM (
    SELECT own, CASE WHEN total <= {m} THEN w ELSE (2 * {m} * upto + total - 1) // (2 * total) - (2 * {m} * (upto - w) + total - 1) // (2 * total) END AS times FROM s)
  WHERE times > 0),
p AS (
  SELECT own, times, items, list_contains(items, {target}) = list_contains(own, {target}) AS same,
    len(list_filter(items, lambda x: x <> {target} AND NOT list_contains(own, x))) + len(list_filter(own, lambda x: x <> {target} AND NOT list_contains(items, x))) AS d
  FROM sampled, t WHERE items <> own OR w > 1),
n AS (SELECT own, times, first(items ORDER BY d, items) FILTER (same) AS hit, first(items ORDER BY d, items) FILTER (NOT same) AS miss FROM p GROUP BY own, times),
e AS (SELECT item FROM (SELECT DISTINCT unnest(items) AS item FROM t) WHERE item <> {target}),
c AS (
  SELECT item, times, hit, miss, list_contains(own, {target}) AS ot, list_contains(own, item) AS o, list_contains(hit, item) AS ih, list_contains(miss, item) AS im
  FROM n, e)
SELECT item, round(sum(times * ((CASE WHEN hit IS NOT NULL AND o = ih THEN {step} * {sign} ELSE 0 END) + (CASE WHEN miss IS NOT NULL AND o <> im THEN {step} * {sign} ELSE 0 END){more})) / sum(times), 9) + 0.0 AS score
FROM c GROUP BY item"""


def _candidates() -> str:
    lits = "SELECT 0 AS place, lang AS value, quality FROM dl UNION ALL SELECT 1, source, quality FROM dl"
    return f"""WITH {DL}, long AS ({lits}),
tot AS (SELECT quality, count(*) AS t FROM dl GROUP BY quality),
v AS (SELECT place, value, quality, count(*) AS n FROM long GROUP BY ALL),
g AS (
  SELECT place, value, false AS negated, quality, n FROM v
  UNION ALL SELECT p.place, p.value, true, tot.quality, t - coalesce(n, 0) FROM (SELECT DISTINCT place, value FROM v) p CROSS JOIN tot LEFT JOIN v ON v.place = p.place AND v.value = p.value AND v.quality = tot.quality
  UNION ALL SELECT 2, CASE WHEN n_chars <= 1000 THEN '0' ELSE '1' END, n_chars > 1000, quality, count(*) FROM dl GROUP BY ALL),
s AS (SELECT *, sum(n) OVER (PARTITION BY place, value, negated) AS N_ FROM g WHERE n > 0)
SELECT place::BIGINT AS place, value, negated, sum(n)::BIGINT AS n, round(round(-sum((n / N_) * log2(n / N_)), 12), 9) + 0.0 AS entropy FROM s GROUP BY place, value, negated"""


def _cut() -> str:
    return f"""WITH {DL},
o AS (SELECT n_chars AS v, quality AS c, row_number() OVER (ORDER BY n_chars, quality) AS i FROM dl WHERE n_chars IS NOT NULL),
w AS (
  SELECT *, lead(v) OVER (ORDER BY i) AS nv, lead(c) OVER (ORDER BY i) AS nc,
    sum((c = '0')::INT) OVER (ORDER BY i) AS l0, sum((c = '1')::INT) OVER (ORDER BY i) AS l1,
    sum((c = '0')::INT) OVER () AS t0, sum((c = '1')::INT) OVER () AS t1 FROM o),
x AS (SELECT (v + nv) / 2 AS cut, l0, l1, t0 - l0 AS r0, t1 - l1 AS r1 FROM w WHERE nv <> v AND nc <> c),
e AS (
  SELECT cut, -(
    (CASE WHEN l0 > 0 THEN l0 * log2(l0 / (l0 + l1)) ELSE 0 END) + (CASE WHEN l1 > 0 THEN l1 * log2(l1 / (l0 + l1)) ELSE 0 END) +
    (CASE WHEN r0 > 0 THEN r0 * log2(r0 / (r0 + r1)) ELSE 0 END) + (CASE WHEN r1 > 0 THEN r1 * log2(r1 / (r0 + r1)) ELSE 0 END)) / (l0 + l1 + r0 + r1) AS entropy FROM x)
SELECT first(cut ORDER BY round(entropy, 12), cut) AS cut, round(min(entropy), 9) AS entropy FROM e"""


def _mined_classifier(picks: int, conf: float, support: float) -> str:
    """Minimal class rules with bodies of two items at most, then the best on rows not yet covered, again and again; last the default class, at the place after the last pick."""
    attrs, parts = ("band", "c_mktsegment", "o_orderpriority"), []
    for n in (1, 2):
        for chosen in combinations(attrs, n):
            keys = ", ".join(chosen)
            parts.append(
                f"SELECT [{', '.join(_item(a) for a in chosen)}] AS body, 'o_orderstatus=' || o_orderstatus AS head, count(*) AS pos, "
                f"sum(count(*)) OVER (PARTITION BY {keys}) AS freq FROM oc GROUP BY {keys}, o_orderstatus"
            )
    out = f"""WITH {OC}, c AS ({' UNION ALL '.join(parts)}),
r AS (SELECT body, head, pos, freq - pos AS neg FROM c WHERE pos >= {LEAST.format(s=support)} AND pos / freq >= {conf}),
m AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY pos DESC, neg, head, body) AS i FROM r
  WHERE NOT EXISTS (SELECT 1 FROM r s WHERE s.head = r.head AND len(s.body) < len(r.body) AND list_has_all(r.body, s.body))),
x AS (SELECT [{', '.join(_item(a) for a in attrs)}] AS items, 'o_orderstatus=' || o_orderstatus AS cls, count(*) AS n FROM oc GROUP BY ALL),
cov AS MATERIALIZED (SELECT i, items, cls, n FROM m JOIN x ON list_has_all(items, body))"""
    for k in range(1, picks + 1):
        taken = ", ".join(f"(SELECT i FROM pick{j})" for j in range(1, k)) or "0"
        out += f""",
pick{k} AS MATERIALIZED (
  SELECT m.i, body, head, coalesce(sum(n) FILTER (cls = head), 0)::BIGINT AS pos, coalesce(sum(n) FILTER (cls <> head), 0)::BIGINT AS neg
  FROM m LEFT JOIN (SELECT * FROM cov WHERE items NOT IN (SELECT items FROM cov WHERE i IN ({taken}))) o ON o.i = m.i
  WHERE m.i NOT IN ({taken}) GROUP BY m.i, body, head ORDER BY pos DESC, neg, m.i LIMIT 1)"""
    every = ", ".join(f"(SELECT i FROM pick{j})" for j in range(1, picks + 1))
    rows = [f"SELECT {k - 1}::BIGINT AS place, array_to_string(body, ' & ') AS body, head, pos, neg FROM pick{k}" for k in range(1, picks + 1)]
    rest = f"SELECT cls FROM x WHERE items NOT IN (SELECT items FROM cov WHERE i IN ({every})) GROUP BY cls ORDER BY sum(n) DESC, cls LIMIT 1"
    # the default follows the last rule: there are fewer picks than wanted where fewer rules reach the confidence
    rows.append(f"SELECT least({picks}, (SELECT count(*) FROM m)), '', coalesce(({rest}), (SELECT min(cls) FROM x)), 0, 0")
    return out + " " + " UNION ALL ".join(rows)


def _cross_validation(picks: int, support: float, conf: float) -> str:
    """Ten folds at once: rules mined from the other folds, the best picked one by one, and the share of the fold's rows that they and a default class get right."""
    parts = []
    for chosen in (("lang",), ("toxic",), ("lang", "toxic")):
        keys = ", ".join(chosen)
        parts.append(
            f"SELECT f, [{', '.join(_item(a) for a in chosen)}] AS body, 'quality=' || quality AS head, sum(n)::BIGINT AS pos, "
            f"(sum(sum(n)) OVER (PARTITION BY f, {keys}))::BIGINT AS freq FROM tr GROUP BY f, {keys}, quality"
        )
    both = "['lang=' || lang, 'toxic=' || toxic] AS items, 'quality=' || quality AS cls"
    out = f"""WITH {DL},
d AS (SELECT lang, toxic, quality, (row_number() OVER (ORDER BY md5('42|' || lang || '|' || source || '|' || quality || '|' || toxic), lang, source, quality, toxic) - 1) % 10 AS fold FROM dl),
tr AS MATERIALIZED (SELECT f, lang, toxic, quality, count(*) AS n FROM d JOIN range(10) t(f) ON fold <> f GROUP BY ALL),
t AS (SELECT f, greatest(1, floor({support}::DOUBLE * sum(n))) AS least FROM tr GROUP BY f),
c AS ({' UNION ALL '.join(parts)}),
r AS (SELECT f, body, head, pos, freq - pos AS neg FROM c JOIN t USING (f) WHERE pos >= least AND pos / freq >= {conf}),
m AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY f ORDER BY pos DESC, neg, head, body) AS i FROM r
  WHERE NOT EXISTS (SELECT 1 FROM r s WHERE s.f = r.f AND s.head = r.head AND len(s.body) < len(r.body) AND list_has_all(r.body, s.body))),
x AS (SELECT f, {both}, n FROM tr),
cov AS MATERIALIZED (SELECT x.f, i, items, cls, n FROM m JOIN x ON x.f = m.f AND list_has_all(items, body))"""
    for k in range(1, picks + 1):
        taken = " UNION ALL ".join(f"SELECT f, i FROM pick{j}" for j in range(1, k)) or "SELECT -1 AS f, -1 AS i"
        out += f""",
taken{k} AS ({taken}), gone{k} AS (SELECT DISTINCT cov.f, items FROM cov JOIN taken{k} q ON q.f = cov.f AND q.i = cov.i),
open{k} AS (SELECT * FROM cov ANTI JOIN gone{k} g ON g.f = cov.f AND g.items = cov.items),
count{k} AS (
  SELECT m.f, m.i, body, head, coalesce(sum(n) FILTER (cls = head), 0) AS p, coalesce(sum(n) FILTER (cls <> head), 0) AS q
  FROM m LEFT JOIN open{k} o ON o.f = m.f AND o.i = m.i WHERE NOT EXISTS (SELECT 1 FROM taken{k} y WHERE y.f = m.f AND y.i = m.i) GROUP BY m.f, m.i, body, head),
pick{k} AS MATERIALIZED (SELECT f, i, body, head FROM count{k} QUALIFY row_number() OVER (PARTITION BY f ORDER BY p DESC, q, i) = 1)"""
    every = " UNION ALL ".join(f"SELECT f, i FROM pick{j}" for j in range(1, picks + 1))
    joins = " ".join(f"LEFT JOIN pick{k} p{k} ON p{k}.f = e.f AND list_has_all(items, p{k}.body)" for k in range(1, picks + 1))
    return out + f""",
done AS (SELECT DISTINCT cov.f, items FROM cov JOIN ({every}) q ON q.f = cov.f AND q.i = cov.i),
rest AS (SELECT x.f, cls FROM x ANTI JOIN done ON done.f = x.f AND done.items = x.items GROUP BY x.f, cls QUALIFY row_number() OVER (PARTITION BY x.f ORDER BY sum(n) DESC, cls) = 1),
e AS (SELECT fold AS f, {both}, count(*) AS n FROM d GROUP BY ALL)
SELECT e.f AS fold, coalesce(sum(n) FILTER (coalesce({', '.join(f'p{k}.head' for k in range(1, picks + 1))}, rest.cls, (SELECT min(cls) FROM x WHERE x.f = e.f)) = e.cls), 0) / sum(n) AS accuracy
FROM e {joins} LEFT JOIN rest ON rest.f = e.f GROUP BY e.f"""


def _grid(folds: str, support: float, conf: float, most: int) -> str:
    """Every strategy with and without default rule, for the first N picks: rules mined from the rows outside a fold, picked step by step in a recursion for
    all folds (folds: those wanted) and strategies at once, and the share of the fold's rows that the first covering rule gets right."""
    parts = []
    for chosen in (("lang",), ("toxic",), ("lang", "toxic")):
        keys = ", ".join(chosen)
        parts.append(
            f"SELECT f, [{', '.join(_item(a) for a in chosen)}] AS body, 'quality=' || quality AS head, sum(n)::BIGINT AS pos, "
            f"(sum(sum(n)) OVER (PARTITION BY f, {keys}))::BIGINT AS freq FROM tr GROUP BY f, {keys}, quality"
        )
    both = "['lang=' || lang, 'toxic=' || toxic] AS items, 'quality=' || quality AS cls"
    # grp parts the picks of a strategy: each class has its own where N rules are wanted for each
    return f"""
WITH RECURSIVE {DL},
d AS (SELECT lang, toxic, quality, (row_number() OVER (ORDER BY md5('42|' || lang || '|' || source || '|' || quality || '|' || toxic), lang, source, quality, toxic) - 1) % 10 AS fold FROM dl),
tr AS (SELECT f, lang, toxic, quality, count(*) AS n FROM d JOIN (SELECT unnest({folds}) AS f) t ON fold <> f GROUP BY ALL),
t AS (SELECT f, greatest(1, floor({support}::DOUBLE * sum(n))) AS least FROM tr GROUP BY f),
c AS ({' UNION ALL '.join(parts)}),
r AS (SELECT f, body, head, pos, freq - pos AS neg FROM c JOIN t USING (f) WHERE pos >= least AND pos / freq >= {conf}),
m AS (
  SELECT *, row_number() OVER (PARTITION BY f ORDER BY pos DESC, neg, head, body) AS i FROM r
  WHERE NOT EXISTS (SELECT 1 FROM r s WHERE s.f = r.f AND s.head = r.head AND len(s.body) < len(r.body) AND list_has_all(r.body, s.body))),
x AS (SELECT f, {both}, n FROM tr),
s AS (SELECT 'n_all' AS strategy, f, '' AS grp FROM t UNION ALL SELECT 'max_cover', f, '' FROM t UNION ALL SELECT DISTINCT 'n_each', f, cls FROM x),
picks AS (
  SELECT strategy, f, grp, 0 AS k, []::BIGINT[] AS ids, []::VARCHAR[][] AS bodies, NULL::VARCHAR AS head, NULL::VARCHAR[] AS body, 0::BIGINT AS p, 0::BIGINT AS q FROM s
  UNION ALL
  SELECT strategy, f, grp, k + 1, list_append(ids, i), list_append(bodies, body), head, body, p, q FROM (
    SELECT y.strategy, y.f, y.grp, y.k, y.ids, y.bodies, m.i, m.body, m.head,
      coalesce(sum(n) FILTER (cls = m.head), 0)::BIGINT AS p, coalesce(sum(n) FILTER (cls <> m.head), 0)::BIGINT AS q
    FROM picks y JOIN m ON m.f = y.f AND (y.grp = '' OR m.head = y.grp) AND NOT list_contains(y.ids, m.i)
    LEFT JOIN x ON x.f = y.f AND list_has_all(x.items, m.body) AND len(list_filter(y.bodies, lambda b: list_has_all(x.items, b))) = 0
    WHERE y.k < {most} GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY strategy, f, grp ORDER BY CASE WHEN strategy = 'max_cover' THEN p + q ELSE p END DESC, CASE WHEN strategy = 'max_cover' THEN 0 ELSE q END, i) = 1),
cells AS (SELECT f, strategy, default_rule, n_rules FROM (SELECT DISTINCT f, strategy FROM s), (SELECT unnest([true, false]) AS default_rule), (SELECT unnest([1, 2, 5, 10, 15, 20]) AS n_rules)),
lists AS (
  SELECT c.f, c.strategy, c.default_rule, c.n_rules, list({{'body': body, 'head': head}} ORDER BY CASE WHEN c.strategy = 'n_each' THEN p END DESC, CASE WHEN c.strategy = 'n_each' THEN q END, grp, k) FILTER (k > 0) AS made
  FROM cells c JOIN picks p ON p.f = c.f AND p.strategy = c.strategy AND p.k <= c.n_rules GROUP BY ALL),
o AS (
  SELECT l.f, l.strategy, l.default_rule, l.n_rules, cls, sum(n) AS n FROM lists l JOIN x ON x.f = l.f
  WHERE len(list_filter(coalesce(made, []), lambda r: list_has_all(items, r.body))) = 0 GROUP BY ALL),
rest AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY f, strategy, default_rule, n_rules ORDER BY n DESC, cls) = 1),
e AS (SELECT fold AS f, {both}, count(*) AS n FROM d GROUP BY ALL),
said AS (
  SELECT l.f, l.strategy, l.default_rule, l.n_rules, e.cls, e.n,
    coalesce(list_filter(made, lambda r: list_has_all(e.items, r.body))[1].head,
      CASE WHEN l.default_rule AND l.strategy <> 'max_cover' THEN coalesce(rest.cls, (SELECT min(cls) FROM x WHERE x.f = l.f)) END) AS said
  FROM lists l JOIN e ON e.f = l.f LEFT JOIN rest ON rest.f = l.f AND rest.strategy = l.strategy AND rest.default_rule = l.default_rule AND rest.n_rules = l.n_rules)
SELECT f AS fold, strategy, default_rule, n_rules::BIGINT AS n_rules, coalesce(sum(n) FILTER (said = cls), 0) / sum(n) AS accuracy FROM said GROUP BY ALL
"""


def _kmeans(k: int, iterations: int, sparse: bool = False) -> str:
    """Lloyd's iterations one after the other, from the rows with the smallest seeded hashes, which a table of fewer rows repeats; a model that has settled stays as it is.

    A cluster without members starts anew at the row whose hash is smallest under a seed of the cluster's own.
    Copies have one hash, so on a table of copies all first rows are equal, and all clusters but one start anew at once.
    sparse: without values that no member has.
    """
    near = " + ".join(f"(CASE WHEN seg = '{v}' THEN 1 - 2 * p{j} ELSE 0 END) + p{j} * p{j}" for j, v in enumerate(SEGMENTS))
    shares = ", ".join(f"coalesce(avg((seg = '{v}')::INT), 0) AS p{j}" for j, v in enumerate(SEGMENTS))
    first = ", ".join(f"coalesce((seg = '{v}')::INT, 0)::DOUBLE AS p{j}" for j, v in enumerate(SEGMENTS))
    cells = ", ".join(f"coalesce(a.p{j}, e.p{j}) AS p{j}" for j in range(len(SEGMENTS)))
    hashed = lambda seed: f"md5({seed} || '|' || txt)"
    out = f"""WITH s AS (SELECT avg(c_acctbal) AS mean, stddev_samp(c_acctbal) AS dev FROM customer),
u AS MATERIALIZED (
  SELECT c_custkey AS id, c_mktsegment AS seg, CASE WHEN c_acctbal IS NOT NULL THEN coalesce((c_acctbal - mean) / nullif(dev, 0), 0) END AS z,
    coalesce(c_mktsegment, '?') || '|' || coalesce(c_acctbal::VARCHAR, '?') AS txt FROM customer, s),
f AS MATERIALIZED (SELECT seg, z, row_number() OVER (ORDER BY h) - 1 AS i, count(*) OVER () AS m FROM (SELECT seg, z, {hashed(42)} AS h FROM u ORDER BY h LIMIT {k})),
m0 AS MATERIALIZED (SELECT k, {first}, coalesce(z, 0) AS mu, 0 AS n FROM range({k}) t(k) JOIN f ON f.i = t.k % f.m),
e AS MATERIALIZED (
  SELECT k, {first}, coalesce(z, 0) AS mu FROM (
    SELECT k, r.seg AS seg, r.z AS z FROM (SELECT k, arg_min({{'seg': seg, 'z': z}}, {hashed('(43 + k)')}) AS r FROM u, range({k}) t(k) GROUP BY k)))"""
    for i in range(iterations):
        d = f"CASE WHEN seg IS NULL THEN 0 ELSE {near} END + CASE WHEN z IS NULL THEN 0 ELSE (z - mu) * (z - mu) END"
        out += f""",
a{i} AS (SELECT id, seg, z, first(k ORDER BY d, k) AS k FROM (SELECT id, seg, z, k, round({d}, 12) AS d FROM u, m{i}) GROUP BY id, seg, z),
m{i + 1} AS MATERIALIZED (
  SELECT e.k, {cells}, coalesce(a.mu, e.mu) AS mu, coalesce(a.n, 0) AS n
  FROM e LEFT JOIN (SELECT k, {shares}, coalesce(avg(z), 0) AS mu, count(*) AS n FROM a{i} GROUP BY k) a ON a.k = e.k)"""
    last = f"m{iterations}"
    rows = [f"SELECT k AS cluster, 'c_mktsegment' AS attr, '{v}' AS value, round(p{j}, 6) AS weight, n AS members FROM {last}{f' WHERE p{j} > 0' if sparse else ''}" for j, v in enumerate(SEGMENTS)]
    return out + " " + " UNION ALL ".join([*rows, f"SELECT k, 'c_acctbal', '', round(mu, 6) + 0.0::DOUBLE, n FROM {last}"])


def _cuts(table: str, attrs: tuple[str, ...], cls: str) -> str:
    """The best cut of several numbers: sums for each class, below and from each value."""
    long = " UNION ALL ".join(f"SELECT '{a}' AS attr, {a}::DOUBLE AS v, {cls} AS c FROM {table} WHERE {a} IS NOT NULL AND {cls} IS NOT NULL" for a in attrs)
    part = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x}) ELSE 0 END"
    return f"""
WITH long AS ({long}),
v AS (SELECT attr, v, min(c) AS f, max(c) AS l FROM long GROUP BY ALL),
cells AS (SELECT attr, v, c, count(*) AS n FROM long GROUP BY ALL),
g AS (
  SELECT v.attr, v.v, k.c, coalesce(sum(n) OVER (PARTITION BY v.attr, k.c ORDER BY v.v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS b,
    coalesce(sum(n) OVER (PARTITION BY v.attr, k.c), 0)::DOUBLE - b AS a
  FROM v CROSS JOIN (SELECT DISTINCT c FROM long) k LEFT JOIN cells ON cells.attr = v.attr AND cells.v = v.v AND cells.c = k.c),
e AS (SELECT attr, v, ({part("sum(b)")} - sum({part("b")}) + {part("sum(a)")} - sum({part("a")})) / (sum(a) + sum(b)) AS e FROM g GROUP BY attr, v),
p AS (SELECT attr, v, (lag(v) OVER w + v) / 2 AS cut, lag(l) OVER w <> f AS differs FROM v WINDOW w AS (PARTITION BY attr ORDER BY v))
SELECT attr, arg_min(cut, (round(e, 12), cut)) AS cut, round(arg_min(e, (round(e, 12), cut)), 9) AS entropy FROM p JOIN e USING (attr, v) WHERE differs GROUP BY attr
"""


def _bits(a: str, b: str, digits: int = 12) -> str:
    """The entropy of two class counts, to the digits to which entropies are compared; 1000 for none."""
    part = lambda x: f"CASE WHEN {x} > 0 THEN {x} / ({a} + {b}) * log2({x} / ({a} + {b})) ELSE 0 END"
    return f"CASE WHEN {a} + {b} = 0 THEN 1000 ELSE round(-({part(a)}) - ({part(b)}), {digits}) END"


def _induced_rules(least: int) -> str:
    """Sequential covering for two classes over lang, toxic and n_chars: a round of the recursion is a rule, and what is left of the rows goes to the next.

    No body is longer than three, as each text column is used once and a cut that was taken covers all that is left.
    """

    def met(lit: str, cut: str) -> str:
        number = f"CASE {lit}.value WHEN '0' THEN o.n_chars <= {cut} ELSE o.n_chars > {cut} END"
        return f"coalesce(CASE {lit}.place WHEN 0 THEN o.lang = {lit}.value WHEN 1 THEN o.toxic = {lit}.value ELSE {number} END, false)"

    def step(i: int) -> str:
        here = " AND ".join(met(f"b{j}", "cut") for j in range(1, i))
        used = " AND ".join(f"(g.place = 2 OR b{j}.place <> g.place)" for j in range(1, i))
        before = ", ".join(f"b{j}" for j in range(1, i))
        unused = "2 + (cut IS NOT NULL)::INT" + "".join(f" - (b{j}.place < 2)::INT" for j in range(1, i))
        return f"""
l{i} AS (
  SELECT g.*, {_bits("g.c0", "g.c1")} AS e FROM (
    SELECT x.place, x.value, sum(n) FILTER (quality = '0') AS q0, sum(n) FILTER (quality = '1') AS q1, coalesce(q0, 0) AS c0, coalesce(q1, 0) AS c1
    FROM (SELECT o.*, unnest([{{'place': 0, 'value': lang}}, {{'place': 1, 'value': toxic}}, {{'place': 2, 'value': CASE WHEN n_chars <= cut THEN '0' WHEN n_chars > cut THEN '1' END}}]) AS x
          FROM o, cutting{", " + before + " WHERE " + here if i > 1 else ""})
    WHERE x.value IS NOT NULL GROUP BY ALL) g{", " + before + " WHERE " + used if i > 1 else ""}),
n{i} AS (SELECT * FROM l{i} WHERE c0 + c1 >= {least} ORDER BY e, c0 + c1 DESC, place, value LIMIT 1),
b{i} AS (
  SELECT n.* FROM n{i} n, b{i - 1} p, cutting{", " + before if i > 2 else ", b1" if i == 2 else ""}
  WHERE p.c0 > 0 AND p.c1 > 0 {f"AND {unused.replace('b' + str(i - 1) + '.', 'p.')} >= 2" if i > 1 else ""} AND (n.e < p.e OR n.e = p.e AND n.c0 + n.c1 > p.c0 + p.c1)),"""

    steps = "".join(step(i) for i in (1, 2, 3))
    texts = "CASE place WHEN 0 THEN 'lang=' || value WHEN 1 THEN 'toxic=' || value ELSE 'n_chars' || CASE value WHEN '0' THEN '<=' ELSE '>' END || CASE WHEN cut = floor(cut) THEN cut::BIGINT::VARCHAR ELSE cut::VARCHAR END END"
    kept = " AND ".join(f"(NOT s.k[{j}] OR {met(f'body.lits[{j}]', 'body.cut')})" for j in (1, 2, 3))
    final = kept.replace("s.k[", "chosen.k[").replace("body.", "chosen.")
    return f"""
WITH RECURSIVE {DL},
state AS (
  SELECT 0 AS k, lang, toxic, n_chars, quality, count(*) AS n, NULL::VARCHAR AS body, NULL::VARCHAR AS head, NULL::BIGINT AS pos, NULL::BIGINT AS neg
  FROM dl WHERE quality IS NOT NULL GROUP BY ALL
  UNION ALL
  SELECT * FROM (
    WITH o AS (SELECT * FROM state WHERE quality IS NOT NULL),
    v AS (SELECT n_chars AS v, min(quality) AS f, max(quality) AS l, sum(n) FILTER (quality = '0') AS q0, sum(n) FILTER (quality = '1') AS q1 FROM o WHERE n_chars IS NOT NULL GROUP BY n_chars),
    w AS (
      SELECT (lag(v) OVER i + v) / 2 AS cut, lag(l) OVER i AS pl, f, coalesce(sum(q0) OVER b, 0) AS b0, coalesce(sum(q1) OVER b, 0) AS b1,
        coalesce(sum(q0) OVER (), 0) - b0 AS a0, coalesce(sum(q1) OVER (), 0) - b1 AS a1
      FROM v WINDOW i AS (ORDER BY v), b AS (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    cutting AS (SELECT min(cut) AS cut FROM (
      SELECT cut FROM w WHERE pl <> f ORDER BY round(((b0 + b1) * ({_bits("b0", "b1", 16)}) + (a0 + a1) * ({_bits("a0", "a1", 16)})) / (a0 + a1 + b0 + b1), 12), cut LIMIT 1)),
    b0 AS (SELECT *, {_bits("c0", "c1")} AS e FROM (SELECT -1 AS place, '' AS value, coalesce(sum(n) FILTER (quality = '0'), 0) AS c0, coalesce(sum(n) FILTER (quality = '1'), 0) AS c1 FROM o)),
    {steps}
    body AS (
      SELECT list({{'place': place, 'value': value, 'text': {texts}}} ORDER BY i) AS lits, count(*) AS m, any_value(cut) AS cut
      FROM (SELECT 1 AS i, place, value FROM b1 UNION ALL SELECT 2, place, value FROM b2 UNION ALL SELECT 3, place, value FROM b3), cutting),
    subsets AS (SELECT x, [x & 4 > 0, x & 2 > 0, x & 1 > 0] AS k, x = [0, 4, 6, 7][m + 1] AS whole FROM range(8) r(x), body WHERE x & [7, 3, 1, 0][m + 1] = 0),
    tried AS (
      SELECT s.x, s.k, s.whole, coalesce(sum(n) FILTER (quality = '0'), 0) AS c0, coalesce(sum(n) FILTER (quality = '1'), 0) AS c1
      FROM subsets s, body, o WHERE {kept} GROUP BY ALL),
    chosen AS (
      SELECT t.*, body.* FROM tried t, body
      ORDER BY {_bits("t.c0", "t.c1")}, NOT whole, x LIMIT 1)
    SELECT (SELECT max(k) FROM o) + 1 AS k, lang, toxic, n_chars, quality, n, NULL, NULL, NULL, NULL FROM o, chosen WHERE NOT ({final})
    UNION ALL
    SELECT (SELECT max(k) FROM o), NULL, NULL, NULL, NULL, NULL,
      coalesce(array_to_string([lits[j].text FOR j IN range(1, 4) IF k[j]], ' & '), ''), CASE WHEN c0 >= c1 THEN 'quality=0' ELSE 'quality=1' END, greatest(c0, c1), least(c0, c1)
    FROM chosen WHERE c0 + c1 > 0)
)
SELECT k::BIGINT AS place, body, head, pos::BIGINT AS pos, neg::BIGINT AS neg FROM state WHERE pos IS NOT NULL
"""


def oracle_sql() -> dict[str, str]:
    long = ", ".join(_item(a) for a in ITEMS)
    sets = f"WITH {OC}, {_itemsets(ITEMS, 0.01)} SELECT items, freq FROM found"
    split = f"FROM (SELECT quality, n_chars <= 1000 AS side, count(*) AS n FROM dl GROUP BY ALL)"
    assigned_rows = " UNION ALL ".join(
        [f"SELECT cluster, 'c_mktsegment' AS attr, '{s}' AS value, avg((c_mktsegment = '{s}')::INT) AS weight, count(*) AS members FROM a GROUP BY cluster" for s in SEGMENTS]
        + ["SELECT cluster, 'c_acctbal', '', avg(z), count(*) FROM a GROUP BY cluster"]
    )
    each = {"F": [0, 3], "O": [1], "P": [2]}
    each_ctes = ", ".join(_greedy(1, False, ids, False, c) for c, ids in each.items())
    each_rows = " UNION ALL ".join(f"SELECT rule, head, pos, neg FROM pick{c}1" for c in each)
    bodies = "[" + ", ".join(f"'{b}'" for b in BODIES) + "]"
    return {
        "item_support": f"WITH {OC} SELECT item, count(*) AS freq FROM (SELECT unnest([{long}]) AS item FROM oc) GROUP BY item",
        "frequent_itemsets": sets,
        "frequent_itemsets_fpgrowth": sets,
        "itemset_counts": _itemset_counts(ITEMS, 0.01),
        "assoc_rules": f"WITH {OC} {_rules(ITEMS, 0.01, 0.2)}",
        "class_rules_minimal": _class_rules(0.335, 0.001, False),
        "class_rules_selected": _class_rules(0.335, 0.001, True),
        "entropy": f"WITH {DL}, c AS (SELECT lang, quality, count(*) AS n, sum(count(*)) OVER (PARTITION BY lang) AS t FROM dl GROUP BY lang, quality) SELECT lang, round(-sum((n / t) * log2(n / t)), 9) AS entropy FROM c GROUP BY lang",
        "entropy_all": f"WITH {OC}, c AS (SELECT o_orderstatus, count(*) AS n, sum(count(*)) OVER () AS t FROM oc GROUP BY o_orderstatus) SELECT round(-sum((n / t) * log2(n / t)), 9) AS entropy FROM c",
        "info_gain": _gain(False, "dl", {"lang": "lang", "source": "source", "toxic": "toxic"}, "quality", DL),
        "info_gain_lift": _gain(True, "dl", {"lang": "lang", "source": "source", "toxic": "toxic"}, "quality", DL),
        "info_gain_cut": f"SELECT 'standard' AS kind, gain FROM ({_gain(False, 'dl', {'n_chars': 'n_chars <= 1000'}, 'quality', DL)}) UNION ALL SELECT 'lift', gain FROM ({_gain(True, 'dl', {'n_chars': 'n_chars <= 1000'}, 'quality', DL)})",
        "odds_ratio": f"{_odds()} SELECT item, round(score, 9) AS score FROM o",
        "odds_ratio_selection": f"{_odds()}, k AS (SELECT item, row_number() OVER (ORDER BY score DESC, item) AS k FROM o) SELECT item FROM k WHERE k <= floor(0.4 * (SELECT count(DISTINCT item) FROM long) + 0.5) UNION SELECT 'o_orderstatus=F'",
        "item_correlation": f"{_corr()} SELECT a, b, round(corr, 9) AS corr FROM corr",
        "correlation_selection": f"{_corr()} SELECT DISTINCT item FROM long WHERE item = 'o_orderstatus=F' OR item NOT IN (SELECT b FROM corr WHERE corr > 0 AND a <> 'o_orderstatus=F' AND b <> 'o_orderstatus=F')",
        "relief": _relief(False),
        "relief2": _relief(True),
        "best_cut": _cut(),
        "best_cuts": _cuts("lineitem", ("l_quantity", "l_extendedprice", "l_discount", "l_tax"), "l_returnflag"),
        "split_entropy": f"WITH {DL}, c AS (SELECT *, sum(n) OVER (PARTITION BY side) AS ns, sum(n) OVER () AS t {split}) SELECT round(-sum((n / t) * log2(n / ns)), 9) AS entropy FROM c",
        "discretised": f"WITH {DL} SELECT CASE WHEN n_chars <= 1000 THEN '<=1000' WHEN n_chars > 1000 THEN '>1000' END AS size, quality, count(*) AS n FROM dl GROUP BY ALL",
        "z_scores": "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER (), 9) AS z FROM customer",
        "value_dictionary": f"WITH {OC}, v AS ({' UNION '.join(f'SELECT {chr(39)}{a}{chr(39)} AS attr, {a} AS value FROM oc' for a in ITEMS)}) SELECT attr, value, row_number() OVER (PARTITION BY attr ORDER BY value) - 1 AS code FROM v",
        "random_split": "SELECT o_orderkey, o_custkey, ('0x' || substr(md5('42|' || o_orderkey || '|' || o_custkey), 1, 12))::BIGINT < floor(0.9::DOUBLE * 281474976710656) AS first FROM orders",
        "encoded_column": f"WITH {OC} SELECT o_orderkey::VARCHAR AS key, o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS code FROM oc",
        "transactions": f"WITH {OC} SELECT {' || chr(32) || chr(38) || chr(32) || '.join(_item(a) for a in ITEMS)} AS items, count(*) AS weight FROM oc GROUP BY ALL",
        "rule_coverage": f"WITH {OC}, r AS (" + " UNION ALL ".join(f"SELECT {i} AS rule, count(*) FILTER ({c} AND o_orderstatus = '{h}') AS pos, count(*) FILTER ({c} AND o_orderstatus <> '{h}') AS neg FROM oc" for i, (c, h) in enumerate(zip(COVERS, HEADS))) + ") SELECT rule::BIGINT AS rule, pos, neg, pos + neg AS freq, round(CASE WHEN pos + neg > 0 THEN pos / (pos + neg) ELSE 0 END, 9) AS conf FROM r",
        "confusion_matrix": f"WITH {OC} SELECT {CHAIN} AS predicted, o_orderstatus AS real, count(*) AS n FROM oc GROUP BY ALL",
        "classifier_metrics": f"WITH {OC}, p AS (SELECT {CHAIN} AS p, o_orderstatus AS r FROM oc) SELECT count(*) AS rows, count(*) FILTER (p = r) AS correct, count(*) - count(*) FILTER (p = r) AS wrong, count(*) FILTER (p IS NULL) AS unclassified, round(count(*) FILTER (p = r) / count(*), 9) AS accuracy FROM p",
        "first_match_label": f"WITH {OC} SELECT o_orderkey::VARCHAR AS key, {CHAIN} AS label FROM oc",
        "rule_vote": f"WITH {OC} SELECT o_orderkey::VARCHAR AS key, round(({COVERS[0]}::INT + {COVERS[3]}::INT) / 2, 9) AS vote FROM oc",
        "greedy_cover": f"WITH {OC}, {_greedy(4, False, [0, 1, 2, 3], True)} {_picked(4, True)}",
        "n_best_rules": f"WITH {OC}, {_greedy(2, False, [0, 1, 2, 3], True)} {_picked(2, True)}",
        "n_rules_each_class": f"WITH {OC}, {each_ctes}, p AS ({each_rows}), o AS (SELECT *, row_number() OVER (ORDER BY pos DESC, neg, head) - 1 AS place FROM p), rest AS (SELECT o_orderstatus AS cls FROM oc, (SELECT list(rule) AS rules FROM p) WHERE NOT list_bool_or(list_transform(rules, lambda i: [{', '.join(f'coalesce({c}, false)' for c in COVERS)}][i + 1])) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT place, {bodies}[rule + 1] AS body, 'o_orderstatus=' || head AS head, pos, neg FROM o UNION ALL SELECT 3, '', 'o_orderstatus=' || cls, 0, 0 FROM rest",
        "max_cover": f"WITH {OC}, {_greedy(3, True, [0, 1, 2, 3], False)} {_picked(3, False, counts=False)}",
        "default_class": f"WITH {OC} SELECT o_orderstatus AS class, count(*) AS n FROM oc GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1",
        "fold_sizes": "SELECT i AS fold, (SELECT count(*) FROM orders) // 10 + (i < (SELECT count(*) FROM orders) % 10)::INT AS n FROM range(10) t(i)",
        "folds": "SELECT o_orderkey, (row_number() OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey) - 1) % 10 AS fold FROM orders",
        "cross_validation": _cross_validation(3, 0.05, 0.6),
        "classifier_grid": f"SELECT strategy, default_rule, n_rules, accuracy FROM ({_grid('[0]', 0.05, 0.6, 20)})",
        "classifier_grid_folds": _grid("range(10)", 0.05, 0.6, 20),
        "mined_classifier": _mined_classifier(5, 0.335, 0.001),
        "induction_candidates": _candidates(),
        "induced_rules": _induced_rules(20),
        "kmeans_assign": f"WITH {ASSIGNED} SELECT c_custkey::VARCHAR AS key, cluster::VARCHAR AS cluster FROM a",
        "kmeans_update": f"WITH {ASSIGNED}, r AS ({assigned_rows}) SELECT cluster::BIGINT AS cluster, attr, value, round(weight, 6) AS weight, members FROM r",
        "kmeans_fit": _kmeans(5, 10),
        "kmeans_sparse": _kmeans(5, 10, sparse=True),
        "typed_text_round_trip": "SELECT o_orderkey::VARCHAR AS key, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS o_orderstatus, replace(o_orderpriority, ' ', '_') AS o_orderpriority, round(o_totalprice, 9) AS o_totalprice FROM orders",
        "c5_export": "SELECT replace(p_type, ' ', '_') || ', ' || replace(p_brand, ' ', '_') || '.' AS value, count(*) AS n FROM part GROUP BY 1",
        "file_labels": f"WITH {OC} SELECT o_orderkey::VARCHAR AS key, {CHAIN} AS label FROM oc",
        "file_votes": f"WITH {OC} SELECT o_orderkey::VARCHAR AS key, round(({COVERS[0]}::INT + {COVERS[3]}::INT) / 2, 9) AS vote FROM oc",
        "file_test": f"WITH {OC}, p AS (SELECT {CHAIN} AS predicted, o_orderstatus AS real FROM oc) SELECT predicted, real, count(*) AS n, (SELECT count(*) FROM p WHERE predicted = real) AS correct FROM p GROUP BY predicted, real",
        "file_clusters": f"WITH {ASSIGNED} SELECT c_custkey::VARCHAR AS key, cluster::VARCHAR AS cluster FROM a",
        "rule_list_round_trip": _class_rules(0.335, 0.001, False),
        "parquet_round_trip": f"WITH {OC} SELECT o_orderkey::VARCHAR AS key, c_mktsegment, o_orderstatus, round(o_totalprice, 9) AS o_totalprice, 'd,d,d,d,c,c' AS kinds FROM oc",
        "c5_names_lines": """
WITH v AS (
  SELECT 2 AS place, 'p_brand' AS attr, list(DISTINCT replace(p_brand, ' ', '_')) AS vs FROM part
  UNION ALL SELECT 3, 'p_type', list(DISTINCT replace(p_type, ' ', '_')) FROM part)
SELECT 0::BIGINT AS place, 'p_brand.  | Target attribute' AS line
UNION ALL SELECT place, attr || ': ' || array_to_string(list_sort(vs), ',') || '.' FROM v
UNION ALL SELECT 4, 'p_retailprice: continuous.'""",
        "itemset_algebra": """
WITH p AS (SELECT p_partkey, list_sort(list_distinct(string_split(p_name, ' '))) AS a, list_sort(list_distinct(string_split(p_type || ' ' || p_brand, ' '))) AS b FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(a, b))), '|') AS united, array_to_string(list_sort(list_intersect(a, b)), '|') AS common,
  array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), '|') AS rest, list_has_all(a, list_intersect(a, b)) AS inside,
  NOT list_has_any(a, b) AS apart, len(a) AS size, list_min(b) AS first, list_contains(b, 'Brand#11') AS has,
  CASE WHEN len(b) > 1 THEN (1 << len(b)) - 2 ELSE 0 END AS parts FROM p""",
        "text_functions": """
SELECT c_custkey, substr(c_name, 1, 4) AS head, substr(c_name, 3, 4) AS middle, instr(c_name, '#') - 1 AS place,
  length(regexp_extract(c_name, '^[^#0-9]*')) AS digit, length(regexp_extract(c_name, '^[Custome]*')) AS other, upper(c_name) AS upper,
  replace(c_name, '#', '/') AS path, regexp_extract(c_name, '([^#]*)$', 1) AS file,
  len(list_filter(string_split(replace(c_name, '#', ' '), ' '), lambda x: x <> '')) AS words, printf('%.6f', c_acctbal) AS number, c_acctbal AS back,
  c_custkey AS whole, floor(c_acctbal + 0.5)::BIGINT AS rounded, trunc(c_acctbal)::BIGINT AS cut, c_name AS trimmed FROM customer""",
        "extremes": "SELECT max(o_totalprice) AS max, min(o_totalprice) AS min, first(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS max_at, first(o_orderkey ORDER BY o_totalprice, o_orderkey) AS min_at FROM orders",
    }
