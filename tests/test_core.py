import math
import os
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import itemsets, measures, text
from marlstone.operators import classify, cluster, crossval, discretise, induce, mining, rules, selection, tables
from marlstone.operators.classify import ClassifierParameters
from marlstone.operators.mining import MiningParameters
from marlstone.operators.rules import EQ, GT, LE, NEQ, Literal, Rule

# A small table of three categories, 47 rows.
F1 = [("0", "0", "D1")] * 10 + [("0", "0", "D2")] * 10 + [("0", "0", "D3")] * 9 + [("0", "1", "D3")] + [("0", "1", "D4")] * 17
NAMES = ["A33", "A34", "A35"]


@pytest.fixture(scope="module")
def f1(spark):
    return spark.createDataFrame(F1, "A33 string, A34 string, A35 string").cache()


def as_set(df):
    return {(tuple(sorted(r["body"])), r["head"], r["pos"], r["freq"]) for r in df.collect()}


def brute_itemsets(rows, names, least, longest=10):
    found = Counter()
    for r in rows:
        items = [f"{n}={v}" for n, v in zip(names, r) if v is not None]
        for k in range(1, min(longest, len(items)) + 1):
            found.update(frozenset(x) for x in combinations(items, k))
    return {k: v for k, v in found.items() if v >= least}


# mining


def test_known_itemsets_and_rules(f1):
    p = MiningParameters(0.05, 0.7)
    for engine in ("levels", "fpgrowth"):
        found = mining.frequent_itemsets(f1, NAMES, MiningParameters(0.05, 0.7, 10, engine)).collect()
        assert {frozenset(r["items"]): r["freq"] for r in found} == brute_itemsets(F1, NAMES, 2)
        assert len(found) == 21
    got = mining.association_rules(f1, NAMES, p).collect()
    assert len(got) == 20
    below = {(" & ".join(r["body"]), r["head"], r["pos"], r["freq"]) for r in got if r["conf"] < 1}
    assert below == {("A34=1", "A35=D4", 17, 18), ("A33=0 & A34=1", "A35=D4", 17, 18), ("A35=D3", "A34=0", 9, 10), ("A33=0 & A35=D3", "A34=0", 9, 10)}
    assert as_set(mining.class_rules(f1, NAMES, "A35", p)) == {(("A34=1",), "A35=D4", 17, 18)}


@pytest.mark.parametrize("seed", range(6))
def test_mining_against_brute_force(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b", "c", "cls"]
    rows = [tuple(None if rng.random() < 0.1 else rng.choice("xyz"[: 2 + (n == "cls")]) for n in names[:3]) + (rng.choice("pq") if rng.random() < 0.95 else None,) for _ in range(60)]
    df = spark.createDataFrame(rows, "a string, b string, c string, cls string")
    p = MiningParameters(0.04, 0.55, rng.choice([2, 3, 10]))
    sets = brute_itemsets(rows, names, p.least_rows(60), p.length)
    assert {frozenset(r["items"]): r["freq"] for r in mining.frequent_itemsets(df, names, p).collect()} == sets
    every = {(tuple(sorted(s - {h})), h, n, sets[s - {h}]) for s, n in sets.items() if len(s) > 1 for h in s if n / sets[s - {h}] >= 0.55}
    assert as_set(mining.association_rules(df, names, p)) == every
    known = [r for r in rows if r[3] is not None]
    sets = brute_itemsets(known, names, p.least_rows(len(known)), p.length)
    heads = {h for s in sets for h in s if h.startswith("cls=")}
    keep = {h: {i for s in sets for i in s if rng.random() < 0.8} for h in heads} if seed % 2 else None
    good = {}
    for s, n in sets.items():
        for h in heads & s:
            body = s - {h}
            if body and n / sets[body] >= 0.55 and (keep is None or body <= keep[h]):
                good[body, h] = (n, sets[body])
    minimal = {(tuple(sorted(b)), h, *v) for (b, h), v in good.items() if not any(o < b and g == h for o, g in good)}
    chosen = None if keep is None else {h: spark.createDataFrame([(i,) for i in sorted(k)] or [("none",)], "item string") for h, k in keep.items()}
    assert as_set(mining.class_rules(df, names, "cls", p, chosen)) == minimal


def test_mining_checks(spark, f1):
    numbers = spark.createDataFrame([("a", 1.0)], "x string, y double")
    with pytest.raises(ValueError, match="continuous"):
        mining.transactions(numbers, ["x", "y"])
    with pytest.raises(ValueError, match="no rows"):
        mining.frequent_itemsets(f1.filter("false"), NAMES, MiningParameters())
    for bad in ({"min_confidence": 0}, {"min_confidence": 1.1}, {"min_support": -1}, {"engine": "x"}):
        with pytest.raises(ValueError):
            MiningParameters(**bad)
    assert MiningParameters(max_rule_length=1).length == 10 and MiningParameters(0.05).least_rows(47) == 2 and MiningParameters(0.0).least_rows(5) == 1


# measures and selection


def test_measures(spark, f1):
    assert measures.entropy(f1, "A35").first()["entropy"] == pytest.approx(1.9557652102)
    assert measures.entropy(f1.filter("false"), "A35").first()["entropy"] == 1000
    gains = {r.attr: r.gain for r in measures.info_gain(f1, ["A33", "A34"], "A35").collect()}
    assert gains["A33"] == pytest.approx(0) and gains["A34"] > 0.5
    n, lift = 47, 0.0
    counts = Counter((a, c) for _, a, c in F1)
    na, nc = Counter(a for _, a, _ in F1), Counter(c for *_, c in F1)
    for a in na:
        lift += na[a] / n * sum((v / nc[c] / (na[a] / n)) * math.log2(v / nc[c] / (na[a] / n)) for (x, c), v in counts.items() if x == a)
    h = -sum(v / n * math.log2(v / n) for v in nc.values())
    assert {r.attr: r.gain for r in measures.info_gain_lift(f1, ["A34"], "A35").collect()}["A34"] == pytest.approx(h + lift)
    row = measures.extremum(spark.createDataFrame([(3, 1.0), (1, 2.0), (2, 2.0), (4, 1.0)], "i int, v double"), "v", "i").first()
    assert tuple(row) == (2.0, 1.0, 1, 3)


def test_odds_ratio_goldens(f1):
    want = {
        "D1": {"A33=0": 0.0, "A34=0": 11.030522, "A34=1": -11.030522},
        "D3": {"A34=0": 2.935460, "A34=1": -2.935460},
        "D4": {"A34=0": -15.966505, "A34=1": 15.966505},
    }
    for c, scores in want.items():
        got = {r["item"]: r["score"] for r in selection.odds_ratio(f1, NAMES, f"A35={c}").collect()}
        for i, s in scores.items():
            assert got[i] == pytest.approx(s, abs=1e-5)


def test_correlation_and_selection(f1):
    items = [f"{n}={v}" for n, col in zip(NAMES, zip(*F1)) for v in sorted(set(col))]
    cols = {i: [f"{n}={v}" == i for row in F1 for n, v in zip(NAMES, row) if n == i[:3]] for i in items}

    def corr(a, b):
        n = 47
        pa, pb = sum(cols[a]) / n, sum(cols[b]) / n
        return (sum(x and y for x, y in zip(cols[a], cols[b])) / n - pa * pb) / math.sqrt(pa * (1 - pa) * pb * (1 - pb))

    got = {(r["a"], r["b"]): r["corr"] for r in selection.correlations(f1, NAMES).collect()}
    vary = [i for i in items if 0 < sum(cols[i]) < 47]
    assert set(got) == set(combinations(sorted(vary), 2))
    assert all(got[k] == pytest.approx(corr(*k)) for k in got)
    target = "A35=D4"
    gone = {b for (a, b), c in got.items() if c > 0.2 and target not in (a, b)}
    kept = {r["item"] for r in selection.select_items(f1, NAMES, target, selection.SelectionParameters(selection.STAT_CORR, threshold=0.2)).collect()}
    assert kept == (set(items) - gone) | {target}
    best = {r["item"] for r in selection.select_items(f1, NAMES, target, selection.SelectionParameters(selection.ODDS_RATIO, 0.3)).collect()}
    assert len(best) == 3 and {target, "A34=1"} <= best


@pytest.mark.parametrize("second", [False, True])
def test_relief(spark, second):
    rng = random.Random(5)
    rows = [tuple(rng.choice("xy") for _ in range(4)) for _ in range(25)] + [("x", None, "y", "x")]
    df = spark.createDataFrame(rows, "a string, b string, c string, t string")
    names, target, m = ["a", "b", "c", "t"], "t=x", 12
    sample = [(tuple(r["items"]), r["times"]) for r in selection.relief_sample(df, names, m, 42).collect()]
    assert sum(t for _, t in sample) == m
    sets = Counter(tuple(sorted(f"{n}={v}" for n, v in zip(names, r) if v is not None)) for r in rows)
    step, scores = (2 if second else 1), Counter()
    every = {i for s in sets for i in s} - {target}
    for own, times in sample:
        near = {}
        for s, w in sets.items():
            if s == own and w == 1:
                continue
            side = (target in s) == (target in own)
            d = (len((set(s) ^ set(own)) - {target}), list(s))
            near[side] = min(near.get(side, d), d)
        for i in every:
            o, sign = i in own, (1 if target in own else -1) * (1 if i in own else -1)
            if True in near:
                h = i in near[True][1]
                scores[i] += times * ((step * sign if o == h else 0) - (1 if second and target not in own and o != h else 0))
            if False in near:
                x = i in near[False][1]
                scores[i] += times * ((step * sign if o != x else 0) - (1 if second and o and x else 0))
    got = {r["item"]: r["score"] for r in selection.relief(df, names, target, m, 42, second).collect()}
    assert got == pytest.approx({i: scores[i] / m for i in every})


def test_selection_by_relief_samples_rows_of_a_large_table(spark):
    a, b, t = (F.pmod(F.xxhash64(F.lit(i), "id"), F.lit(n)) for i, n in ((1, 2), (2, 10), (3, 2)))
    # t follows a, b is noise; each of the 40 combinations has about 500 rows
    df = spark.range(20_000).select(a.cast("string").alias("a"), b.cast("string").alias("b"), F.when(F.pmod("id", F.lit(50)) == 0, t).otherwise(a).cast("string").alias("t"))
    names = ["a", "b", "t"]
    got = {tuple(r["items"]): r["times"] for r in selection.relief_sample(df, names, 100, 42).collect()}
    assert sum(got.values()) == 100 and len(got) >= 15 and max(got.values()) <= 20
    assert got == {tuple(r["items"]): r["times"] for r in selection.relief_sample(df.repartition(7), names, 100, 42).collect()}
    few = df.limit(30).cache()
    assert sorted((r["items"], r["times"]) for r in selection.relief_sample(few, names, 100, 42).collect()) == sorted((r["items"], r["weight"]) for r in mining.transactions(few, names).collect())
    assert selection.relief_sample(df.limit(0), names, 100, 42).count() == 0
    chosen = selection.select_items(df, names, "t=1", selection.SelectionParameters(selection.RELIEF, 0.2)).collect()
    best = selection.best_share(selection.relief(df, names, "t=1", 100, 42), 0.2, 14).collect()
    assert len(best) == 3 and {r["item"] for r in chosen} == {r["item"] for r in best} | {"t=1"}


# cuts


def brute_cut(pairs):
    rows = sorted((v, c) for v, c in pairs if v is not None and c is not None)
    best = None
    for i in range(len(rows) - 1):
        if rows[i][0] != rows[i + 1][0] and rows[i][1] != rows[i + 1][1]:
            e = 0
            for part in (rows[: i + 1], rows[i + 1 :]):
                e -= sum(k * math.log2(k / len(part)) for k in Counter(c for _, c in part).values())
            e = round(e / len(rows), 12)
            if best is None or e < best[1]:
                best = ((rows[i][0] + rows[i + 1][0]) / 2, e)
    return best


@pytest.mark.parametrize("one_part", [100_000, 3])
def test_best_cut(spark, monkeypatch, one_part):
    monkeypatch.setattr(discretise, "ONE_PART", one_part)
    for seed in range(4):
        rng = random.Random(seed)
        pairs = [(None if rng.random() < 0.1 else float(rng.randrange(20)), rng.choice("abc") if rng.random() < 0.95 else None) for _ in range(60)]
        row = discretise.best_cut(spark.createDataFrame(pairs, "x double, c string"), "x", "c").first()
        want = brute_cut(pairs)
        assert row["cut"] == want[0] and row["entropy"] == pytest.approx(want[1])
    none = discretise.best_cut(spark.createDataFrame([(1.0, "a"), (2.0, "a"), (None, "b")], "x double, c string"), "x", "c").first()
    assert none["cut"] is None
    assert discretise.best_cut(spark.createDataFrame([], "x double, c string"), "x", "c").first()["cut"] is None


def test_z_scores_and_bins(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (None, None)], "x double, y double")
    assert [tuple(r) for r in discretise.z_scores(df, ["x", "y"]).collect()] == [(-1.0, 0.0), (0.0, 0.0), (1.0, 0.0), (None, None)]
    assert [r["b"] for r in discretise.discretise(df, "x", 2.0, "b").collect()] == ["<=2", "<=2", ">2", None]


# rules and classifiers


def test_missing_values_in_literals(spark):
    df = tables.typed(spark.createDataFrame([("a", 1.0), (None, None), ("b", 3.0)], "x string, y double"), ["x"], ["y"])
    met = lambda x: [r[0] for r in df.select(x.column()).collect()]
    assert met(Literal("x", EQ, "a")) == [True, False, False]
    assert met(Literal("x", NEQ, "a")) == [False, True, True]
    assert met(Literal("y", LE, 2)) == [True, False, False]
    assert met(Literal("y", GT, 2)) == [False, False, True]
    assert met(Literal("x", EQ, "unseen")) == [False] * 3 and met(Literal("x", NEQ, "unseen")) == [True] * 3
    assert Literal("y", LE, 2).negated() == Literal("y", GT, 2)
    r = Rule((), Literal("x", EQ, "a"))
    assert df.filter(r.covers()).count() == 3
    assert rules.counted(df, [r])[0].conf == pytest.approx(1 / 3)
    assert [str(x) for x in rules.unknown_values(df, [Rule((Literal("x", EQ, "zz"),), Literal("x", EQ, "a"))])] == ["x=zz"]


def slow_build(rows, rule_list, covers, strategy, n, default):
    """Greedy covering row by row."""
    values = sorted({c for _, c in rows})
    score = lambda i, open_: (sum(c == rule_list[i].head.value for k, (_, c) in enumerate(rows) if k in open_ and covers[i][k]), sum(c != rule_list[i].head.value for k, (_, c) in enumerate(rows) if k in open_ and covers[i][k]))

    def greedy(ids, most):
        open_, left, out = set(range(len(rows))), list(ids), []
        while left and (most is None or len(out) < most):
            best = min(left, key=lambda i: ((-sum(score(i, open_)),) if strategy == "max_cover" else (-score(i, open_)[0], score(i, open_)[1])) + (left.index(i),))
            out.append((best, score(best, open_)))
            open_ -= {k for k in open_ if covers[best][k]}
            left.remove(best)
        return out

    if strategy == "n_each":
        picks = [x for v in values for x in greedy([i for i, r in enumerate(rule_list) if r.head.value == v], n)]
        picks.sort(key=lambda x: (-x[1][0], x[1][1]))
    else:
        picks = greedy(range(len(rule_list)), None if strategy == "all" else n)
    out = [(i, *c) if strategy != "max_cover" else (i, 0, 0) for i, c in picks]
    if default and strategy != "max_cover":
        left = Counter(c for k, (_, c) in enumerate(rows) if not any(covers[i][k] for i, _ in picks))
        out.append(min(left, key=lambda c: (-left[c], c)) if left else values[0])
    return out


@pytest.mark.parametrize("strategy", ["all", "n_all", "n_each", "max_cover"])
def test_strategies(spark, strategy):
    rng = random.Random(3)
    rows = [((rng.choice("xyz"), rng.choice("pq")), rng.choice("AB")) for _ in range(50)]
    df = spark.createDataFrame([(*x, c) for x, c in rows], "a string, b string, c string")
    bodies = [(Literal("a", EQ, v),) for v in "xyz"] + [(Literal("b", EQ, "p"),), (Literal("a", NEQ, "x"), Literal("b", EQ, "q"))]
    made = [Rule(b, Literal("c", EQ, h)) for b in bodies for h in "AB"]
    ok = {"=": lambda v, w: v == w, "<>": lambda v, w: v != w}
    covers = [[all(ok[x.op](dict(zip("ab", r))[x.attr], x.value) for x in m.body) for r, _ in rows] for m in made]
    for n, default in ((1, True), (3, False), (4, True)):
        got = classify.build_classifier(df, made, "c", ClassifierParameters(strategy, n, default))
        want = slow_build(rows, made, covers, strategy, n, default)
        assert [(r.body, r.head.value, r.pos, r.neg) for r in got if r.body] == [(made[i].body, made[i].head.value, p, m) for i, p, m in [x for x in want if isinstance(x, tuple)]]
        assert [r.head.value for r in got if not r.body] == [x for x in want if isinstance(x, str)]
    if strategy == "n_each":
        worst = classify.build_classifier(df, made, "c", ClassifierParameters(strategy, 3, False, reference_order=True))
        assert [(r.pos, -r.neg) for r in worst] == sorted((r.pos, -r.neg) for r in worst)


def test_evaluation_and_labels(spark, f1):
    made = [Rule((Literal("A34", EQ, "1"),), Literal("A35", EQ, "D4"))]
    e = classify.evaluate(f1, made, "A35")
    assert e.rows == 47 and e.correct == 17 and e.unclassified == 29 and e.accuracy == pytest.approx(17 / 47)
    assert sum(map(sum, e.matrix)) == 47 and len(e.matrix) == 5
    m = classify.metrics(classify.confusion(f1, made, "A35")).first()
    assert (m.rows, m.correct, m.wrong, m.unclassified) == (47, 17, 30, 29)
    assert classify.accuracies(f1, [made, []], "A35") == pytest.approx([17 / 47, 0.0])
    assert classify.evaluate(f1, [], "A35").accuracy == 0
    labelled = classify.label(f1, made, "out")
    assert Counter(r["out"] for r in labelled.collect()) == {"D4": 18, None: 29} and tables.kind(labelled, "out") == "d"
    voted = classify.vote(f1, [*made, Rule((), Literal("A35", EQ, "D4"))], "v")
    assert Counter(r["v"] for r in voted.collect()) == {1.0: 18, 0.5: 29}
    many = [Rule((Literal("A34", EQ, "1"), Literal("A33", EQ, str(i))), Literal("A35", EQ, "D4")) for i in range(250)] + made
    assert Counter(r["out"] for r in classify.label(f1, many, "out").collect()) == {"D4": 18, None: 29}
    for bad in (lambda: classify.label(f1, made, "A33"), lambda: classify.vote(f1, [*made, Rule((), Literal("A35", EQ, "D1"))], "v"), lambda: classify.evaluate(f1, [Rule((Literal("no", EQ, "1"),), made[0].head)], "A35"),
                lambda: classify.evaluate(f1, [Rule((Literal("A34", LE, 1),), made[0].head)], "A35")):
        with pytest.raises(ValueError):
            bad()


def test_folds(spark):
    df = spark.range(103)
    got = [r["fold"] for r in crossval.with_folds(df, "id").collect()]
    assert sorted(Counter(got).items()) == [(i, 11 if i < 3 else 10) for i in range(10)]
    assert sorted(r["_number"] for r in crossval.numbered(df, "id", seed=1).collect()) == list(range(103))


def test_cross_validation_and_grid(spark):
    rng = random.Random(1)
    rows = [(str(i), x := rng.choice("xyz"), "A" if x == "x" else "B") for i in range(60)]
    df = spark.createDataFrame(rows, "id string, a string, c string")
    got = crossval.cross_validate(df, ["a"], "c", MiningParameters(0.05, 0.6, 2), ClassifierParameters("all"), key=("id",), folds=3)
    assert got == [1.0] * 3
    cells = [("n_all", True, 1), ("n_all", False, 1), ("max_cover", True, 2)]
    assert [x[:3] for x in crossval.grid(df, df, ["a"], "c", MiningParameters(0.05, 0.6, 2), cells=cells)] == cells
    assert len(crossval.GRID) == 36
    s = selection.SelectionParameters(selection.ODDS_RATIO, 0.5)
    assert crossval.run_classifier(df, ["a"], "c", MiningParameters(0.05, 0.6, 2), ClassifierParameters("all"), s)


# induction


def slow_grow(rows, names, kinds, cls, p):
    """The same search over Python rows."""
    met = lambda lit, r: {EQ: lambda v: v == lit.value, NEQ: lambda v: v != lit.value, LE: lambda v: v is not None and v <= lit.value, GT: lambda v: v is not None and v > lit.value}[lit.op](r[lit.attr])
    open_, out = [r for r in rows if r[cls] is not None], []
    while open_:
        counts = Counter(r[cls] for r in open_)
        cuts = {a: c[0] for a in names if kinds[a] == "c" and (c := brute_cut([(r[a], r[cls]) for r in open_]))}
        unused, body, here = [a for a in names if kinds[a] == "d" or a in cuts], [], open_
        current, n, neg = induce.entropy_of(counts), len(here), len(here) - max(counts.values())
        while neg and len(unused) >= (2 if body else 1):
            cand = []
            for place, a in enumerate(unused):
                if a in cuts:
                    lits = [("0", False, Literal(a, LE, cuts[a])), ("1", True, Literal(a, GT, cuts[a]))]
                else:
                    values = sorted({r[a] for r in here if r[a] is not None})
                    lits = [(v, False, Literal(a, EQ, v)) for v in values] + [(v, True, Literal(a, NEQ, v)) for v in values if p.use_negation]
                for v, neg_, lit in lits:
                    got = Counter(r[cls] for r in here if met(lit, r))
                    if sum(got.values()) >= p.min_support:
                        cand.append((induce.entropy_of(got), -sum(got.values()), place, v, neg_, lit))
            if not cand or not (min(cand)[0] < current or min(cand)[0] == current and -min(cand)[1] > n):
                break
            best = min(cand, key=lambda x: x[:5])
            body.append(best[5])
            if best[5].kind == "d":
                unused.remove(best[5].attr)
            here = [r for r in here if met(best[5], r)]
            current, n = best[0], len(here)
            neg = n - max(Counter(r[cls] for r in here).values())
        keep = tuple(body)
        least = induce.entropy_of(Counter(r[cls] for r in open_ if all(met(x, r) for x in body)))
        for flags in __import__("itertools").product((False, True), repeat=len(body)):
            sub = tuple(x for x, f in zip(body, flags) if f)
            e = induce.entropy_of(Counter(r[cls] for r in open_ if all(met(x, r) for x in sub)))
            if body and e < least:
                keep, least = sub, e
        final = Counter(r[cls] for r in open_ if all(met(x, r) for x in keep))
        head = induce.majority(final)
        out.append((keep, head, final[head], sum(final.values()) - final[head]))
        open_ = [r for r in open_ if not all(met(x, r) for x in keep)]
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_induction(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(60):
        a, x = rng.choice(["u", "v", None]), (None if rng.random() < 0.1 else float(rng.randrange(12)))
        c = "P" if (a == "u" and (x or 0) > 5) or rng.random() < 0.15 else "N"
        rows.append({"a": a, "b": rng.choice("kl"), "x": x, "c": c if rng.random() < 0.97 else None})
    df = tables.typed(spark.createDataFrame([tuple(r.values()) for r in rows], "a string, b string, x double, c string"), ["a", "b", "c"], ["x"]).select("a", "b", "x", "c")
    p = induce.InductionParameters(4, use_negation=bool(seed))
    got = induce.grow_rules(df, "c", p)
    assert [(r.body, r.head.value, r.pos, r.neg) for r in got] == slow_grow(rows, ["a", "b", "x"], {"a": "d", "b": "d", "x": "c"}, "c", p)
    with pytest.raises(ValueError):
        induce.grow_rules(df, "x")


# clustering


def test_kmeans_invariants(spark, f1):
    model = cluster.k_means(f1, 5, 10)
    labelled = cluster.assign(f1, model, "k").groupBy("k", *NAMES).count().collect()
    members = Counter()
    for r in labelled:
        members[int(r["k"])] += r["count"]
    assert sum(c.members for c in model.clusters) == 47
    for k, c in enumerate(model.clusters):
        if c.members:
            assert members[k] == c.members
            for n in NAMES:
                for v, p in c.items[n].items():
                    assert p == pytest.approx(sum(r["count"] for r in labelled if int(r["k"]) == k and r[n] == v) / c.members)
    same = next(c for c in model.clusters if c.members == 29) if any(c.members == 29 for c in model.clusters) else None
    if same:
        assert sorted(same.items["A35"].values()) == pytest.approx([0, 9 / 29, 10 / 29, 10 / 29])


def test_kmeans_mixed_and_missing(spark):
    rows = [("a", 1.0), ("a", 1.2), ("b", 9.0), ("b", None), (None, 9.1), (None, None)]
    df = tables.typed(spark.createDataFrame(rows, "d string, x double"), ["d"], ["x"])
    first = df.filter("x in (1.0, 9.0)").orderBy("x").collect()
    model = cluster.k_means(df, 2, 20, initial=first)
    assert [r["k"] for r in cluster.assign(df, model, "k").collect()] == ["0", "0", "1", "1", "1", "0"]
    a = {x.name: x for x in model.attributes}["x"]
    assert model.clusters[1].items["x"] == pytest.approx(((9.0 - a.mean) + (9.1 - a.mean)) / 2 / a.dev)
    assert model.clusters[1].items["d"]["b"] == 1.0 and model.clusters[0].members == 3
    far = cluster.updated(df, cluster.ClusterModel(model.attributes, [*model.clusters, cluster.Centroid({"d": {"a": 0.0, "b": 0.0}, "x": 99.0})]))[0]
    assert far.clusters[2].members == 0 and abs(far.clusters[2].items["x"]) < 5
    with pytest.raises(ValueError):
        cluster.k_means(df, 0)
    with pytest.raises(ValueError):
        cluster.assign(df, model, "x")


# tables, text, itemsets


def test_tables(spark):
    df = tables.typed(spark.createDataFrame([("10", 1.0), ("1", 2.0), (None, None), ("10", 3.0)], "k string, x double"), ["k"], ["x"])
    assert [tuple(r) for r in tables.dictionary(df).orderBy("code").collect()] == [("k", "1", 0), ("k", "10", 1)]
    assert sorted(r["k_code"] for r in tables.encode(df, "k").collect()) == [-1, 0, 1, 1]
    assert tables.position(df, "x") == 1 and tables.position(df, "no") == -1
    assert tables.empty_like(df).schema == df.schema and tables.append_row(df, df, F.col("k") == "1").count() == 5
    assert tables.unknown_values(df, "k", tables.dictionary(df).filter("value = '1'")).first()[0] == "10"
    a, b = tables.random_split(spark.range(1000), 0.9, 1)
    assert a.count() + b.count() == 1000 and 850 < a.count() < 950
    masks = spark.createDataFrame([(True, False), (False, True), (True, True)], "m boolean, r boolean")
    m, r = F.col("m"), F.col("r")
    found = masks.agg(tables.count_rows(tables.add_rows(m, r)), tables.count_rows(tables.remove_rows(m, r)), tables.count_rows(tables.reset_rows(True)), tables.count_rows(tables.reset_rows(False))).first()
    assert tuple(found) == (3, 1, 3, 0)
    with pytest.raises(ValueError):
        tables.kind(spark.range(1), "id")


def test_text_functions(spark):
    df = spark.createDataFrame([("  a-b.c  ", "/x/y\\z.tar.gz", "12x", " -3 ", "1.5e2", "")], "s string, p string, n string, i string, f string, e string")
    got = df.select(
        text.trim_left(F.col("s")), text.trim_right(F.col("s")), text.find_first_of(F.col("s"), ".-"), text.find_first_not_of(F.col("s"), " "), text.find_char(F.col("s"), "q"), text.file_name(F.col("p")),
        text.file_extension(F.col("p")), text.without_extension(F.col("p")), text.to_integer(F.col("n")), text.to_integer(F.col("i")), text.to_float(F.col("f")), text.to_float(F.col("n")),
        text.split_words(F.col("e")), text.value_text(F.lit(None)), text.bool_text(F.lit(True)), text.is_digit(F.lit("7")), text.is_blank(F.lit("\t")), text.round_half_up(F.lit(2.5)),
        text.date_text(F.to_timestamp(F.lit("2024-03-05 06:07:08"))), text.time_text(F.to_timestamp(F.lit("2024-03-05 06:07:08"))),
    ).first()
    assert tuple(got) == ("a-b.c  ", "  a-b.c", 3, 2, -1, "z.tar.gz", ".gz", "/x/y\\z.tar", None, -3, 150.0, None, [], "?", "1", True, True, 3, "5.3.2024", "06:07:08")


def test_itemset_algebra(spark):
    rng = random.Random(2)
    rows = [([rng.choice("abcd") for _ in range(rng.randrange(4))], [rng.choice("abcd") for _ in range(rng.randrange(4))]) for _ in range(40)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>").select(*[F.array_sort(F.array_distinct(x)).alias(x) for x in "ab"])
    a, b, u = F.col("a"), F.col("b"), itemsets.universe(*"abcd")
    for r in df.select("a", "b", itemsets.union(a, b), itemsets.intersection(a, b), itemsets.difference(a, b), itemsets.complement(a, u), itemsets.is_subset(a, b), itemsets.disjoint(a, b), itemsets.with_item(a, F.lit("b")),
                       itemsets.without_item(a, F.lit("b")), itemsets.is_empty(a), itemsets.proper_subsets(a), itemsets.first_item(a), itemsets.same_set(a, b), itemsets.before(a, b)).collect():
        x, y = set(r[0]), set(r[1])
        assert [set(v) for v in r[2:6]] == [x | y, x & y, x - y, set("abcd") - x]
        assert (r[6], r[7], set(r[8]), set(r[9]), r[10]) == (x <= y, not x & y, x | {"b"}, x - {"b"}, not x)
        assert sorted(map(tuple, r[11])) == sorted(c for k in range(1, len(x)) for c in combinations(sorted(x), k))
        assert (r[12], r[13], r[14]) == (min(x, default=None), x == y, sorted(x) < sorted(y))


# names, labels and sizes


def test_names_may_hold_anything(spark):
    rows = [("x", "u", "p"), ("x", "v", "p"), ("y", "u", "q"), ("y", "v", "q")] * 3
    df = spark.createDataFrame(rows, "`a=b` string, `_n` string, `c=d%` string")
    for p in (MiningParameters(0.1, 0.9), MiningParameters(0.1, 0.9, engine="fpgrowth")):
        found = rules.from_mined(mining.class_rules(df, ["a=b", "_n"], "c=d%", p).collect())
        assert [(str(r.body[0]), str(r.head), r.pos) for r in found] == [("a=b=x", "c=d%=p", 6), ("a=b=y", "c=d%=q", 6)]
    made = crossval.run_classifier(df, ["a=b", "_n"], "c=d%", MiningParameters(0.1, 0.9), ClassifierParameters(classify.N_ALL, 2), selection.SelectionParameters(selection.ODDS_RATIO, 0.9))
    assert classify.evaluate(df, made, "c=d%").accuracy == 1.0
    grown = induce.grow_rules(df, "c=d%", induce.InductionParameters(1), ["_n", "a=b"])
    assert {str(r.body[0]) for r in grown if r.body} <= {"a=b=x", "a=b=y"} and grown
    odd = spark.range(20).selectExpr("cast(id as double) x", "cast(id % 2 as string) cluster", "cast(id % 3 as string) was", "1 _mean_x", "2 _dev_x", "3 _part", "4 _place", "5 _start", "6 _number")
    assert set(discretise.z_scores(odd, ["x"]).columns) == set(odd.columns)
    folds = crossval.with_folds(odd, "x")
    assert set(folds.columns) == {*odd.columns, "fold"} and folds.filter("_part = 3 and _number = 6").count() == 20
    model = cluster.k_means(odd, 2, 5, ["x", "cluster", "was"])
    assert sum(c.members for c in model.clusters) == 20


def test_numbers_keep_their_digits(spark):
    df = spark.createDataFrame([(1234567.2,), (1234567.3,), (None,)], "x double")
    assert [r[0] for r in discretise.discretise(df, "x", 1234567.25).orderBy("x").collect()] in ([None, "<=1234567.25", ">1234567.25"],)
    assert str(Literal("x", LE, 1234567.25)) == "x<=1234567.25" and str(Literal("x", GT, 250000)) == "x>250000"


def test_many_rules_are_picked_in_few_jobs(spark):
    rng = random.Random(2)
    rows = [(str(rng.randrange(40)), str(rng.randrange(25)), rng.choice("pq")) for _ in range(2000)]
    df = spark.createDataFrame(rows, "a string, b string, c string").cache()
    rules = [Rule((Literal("a", EQ, str(i)), Literal("b", EQ, str(j))), Literal("c", EQ, h)) for i in range(40) for j in range(13) for h in "pq"][:1000]
    sc = spark.sparkContext
    sc.setJobGroup("picks", "picks")
    few = classify.build_classifier(df, rules, "c", ClassifierParameters(classify.N_ALL, 150))
    jobs = len(sc.statusTracker().getJobIdsForGroup("picks"))
    sc.setJobGroup("rest", "rest")
    assert jobs < 30 and len(few) == 151
    here, classify.LOCAL_CELLS = classify.LOCAL_CELLS, 0
    try:
        assert classify.build_classifier(df, rules, "c", ClassifierParameters(classify.N_ALL, 3))[:3] == few[:3]
    finally:
        classify.LOCAL_CELLS = here


def test_long_bodies_are_grown_and_pruned(spark):
    # every column holds one more row of class q apart, so a rule needs all of them
    n = 14
    rows = [(*["1"] * n, "p")] * 30 + [(*["0" if k == i else "1" for k in range(n)], "q") for i in range(n)] * 2
    df = spark.createDataFrame(rows, ", ".join(f"a{i} string" for i in range(n)) + ", c string")
    p = induce.InductionParameters(3)
    first = induce.grow_rules(df, "c", p, max_rules=1)[0]
    assert len(first.body) == n - 1 and first.neg == 2 and first.pos == 30
    assert len(induce.grow_rules(df, "c", induce.InductionParameters(3, max_body=3), max_rules=1)[0].body) == 3


@pytest.mark.parametrize("classes", [2, 3, 9])
def test_pruning_is_one_search_for_bodies_of_any_length(classes):
    rng = random.Random(classes)
    for many in (0, 1, 3, 5, 12, 13):
        for _ in range(20 if many < 10 else 3):
            patterns = sorted({tuple(rng.random() < 0.7 for _ in range(many)) for _ in range(rng.randrange(1, 9))} | ({(True,) * many} if rng.random() < 0.8 else set()))
            counts = np.array([[rng.randrange(4) for _ in range(classes)] for _ in patterns])
            of = lambda chosen: sum((c for p, c in zip(patterns, counts) if all(m for m, x in zip(p, chosen) if x)), np.zeros(classes, int))
            best = (True,) * many
            least = induce.entropy_of(dict(enumerate(of(best).tolist())))
            for chosen in __import__("itertools").product((False, True), repeat=many):
                if (e := induce.entropy_of(dict(enumerate(of(chosen).tolist())))) < least:
                    best, least = chosen, e
            got, final = induce._least_subset(np.array(patterns, bool).reshape(len(patterns), many), counts)
            assert got == best and final.tolist() == of(best).tolist()


@pytest.mark.parametrize("one_part", [100_000, 3])
def test_cuts_of_several_columns_are_found_together(spark, monkeypatch, one_part):
    monkeypatch.setattr(discretise, "ONE_PART", one_part)
    rng = random.Random(6)
    rows = [(rng.choice([None, *map(float, range(15))]), float(rng.randrange(4)), 1.0, rng.gauss(0, 1e9), rng.choice(["a", "b", "c", None])) for _ in range(80)]
    df = spark.createDataFrame(rows, "`x.1` double, y double, same double, z double, `c.` string")
    before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    got = {r["attr"]: r for r in discretise.best_cuts(df, ["x.1", "y", "same", "z"], "c.").collect()}
    assert set(got) == {"x.1", "y", "z"} and spark.sparkContext._jsc.sc().getPersistentRDDs().size() == before
    for k, a in ((0, "x.1"), (1, "y"), (3, "z")):
        cut, e = brute_cut([(r[k], r[4]) for r in rows])
        assert got[a]["cut"] == cut and got[a]["entropy"] == pytest.approx(e)
        for side, met in ((got[a]["below"], lambda v: v <= cut), (got[a]["above"], lambda v: v > cut)):
            assert side == [sum(r[4] == c and r[k] is not None and met(r[k]) for r in rows) for c in "abc"]


def test_induction_leaves_nothing_behind_and_rewrites_what_is_open(spark, monkeypatch):
    monkeypatch.setattr(induce, "REWRITE", 1)
    rng = random.Random(4)
    rows = [{"a.b": rng.choice("uvw"), "x": float(rng.randrange(6)), "c": rng.choice("PN")} for _ in range(50)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "`a.b` string, x double, c string")
    before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    p = induce.InductionParameters(5)
    got = induce.grow_rules(df, "c", p)
    assert [(r.body, r.head.value, r.pos, r.neg) for r in got] == slow_grow(rows, ["a.b", "x"], {"a.b": "d", "x": "c"}, "c", p)
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == before


def test_numbers_in_an_order(spark):
    rows = [(i % 3, None if i % 7 == 0 else i * 37 % 50, i) for i in range(100)] + [(1, 5, 200 + i) for i in range(60)]
    df = spark.createDataFrame(rows, "a long, b long, _place long")
    got = tables.numbered_in_order(df, F.desc("a"), F.asc_nulls_first("b"), F.col("_place"), name="n").collect()
    want = sorted(rows, key=lambda r: (-r[0], r[1] is not None, r[1] or 0, r[2]))
    assert [tuple(r)[:3] for r in sorted(got, key=lambda r: r["n"])] == want and sorted(r["n"] for r in got) == list(range(160))


def test_clipped_normal(spark):
    got = [r[0] for r in spark.range(2000).select(text.clipped_normal(3, -1.0, 2.0)).collect()]
    assert min(got) == -1.0 and max(got) <= 2.0 and abs(sum(got) / 2000) < 0.3


def test_empty_sets_and_values(spark):
    row = spark.range(1).select(itemsets.empty_set(), itemsets.item_value(F.lit("a=b=c")), itemsets.item_attribute(F.lit("a%3Db=c"))).first()
    assert tuple(row) == ([], "b=c", "a%3Db") and itemsets.attribute_name(itemsets.item_name("a=b%3D")) == "a=b%3D"


# long lists, folds and selection


def many_rules(rng, n):
    ops = lambda: rng.choice([Literal("a.b", EQ, rng.choice("uvw")), Literal("a.b", NEQ, rng.choice("uvwx")), Literal("y", EQ, rng.choice("kl")), Literal("x", LE, rng.randrange(-1, 9) / 2), Literal("x", GT, rng.randrange(-1, 9) / 2)])
    return [Rule(tuple(ops() for _ in range(rng.randrange(4))) if i % 37 else (), Literal("c", EQ, rng.choice("PQR")), 3, 1) for i in range(n)][::-1]


def rule_rows(spark, rng, n=150):
    rows = [(rng.choice(["u", "v", "w", None]), rng.choice(["k", "l", None]), rng.choice([None, float("nan"), float("-inf"), *[i / 4 for i in range(-4, 20)]]), rng.choice(["P", "Q", "R", None]), i) for i in range(n)]
    return spark.createDataFrame(rows, "`a.b` string, y string, x double, c string, id long")


def test_the_index_finds_the_rules_that_conditions_find(spark, monkeypatch):
    from marlstone.operators import matching

    rng = random.Random(12)
    df, made = rule_rows(spark, rng), many_rules(rng, 90)
    plain = {r["id"]: r["p"] for r in matching.with_places(df, made, "p").collect()}
    labels = {r["id"]: r["l"] for r in classify.label(df, made, "l").collect()}
    matrix = {tuple(r) for r in classify.confusion(df, made, "c").collect()}
    built = classify.build_classifier(df, made, "c", ClassifierParameters(classify.N_EACH, 3))
    monkeypatch.setattr(matching, "LONG_LIST", 0)
    monkeypatch.setattr(classify, "LONG_LIST", 0)
    assert {r["id"]: r["p"] for r in matching.with_places(df, made, "p").collect()} == plain and any(len(p) > 5 for p in plain.values())
    got = classify.label(df, made, "l")
    assert {r["id"]: r["l"] for r in got.collect()} == labels and got.columns == [*df.columns, "l"]
    assert {tuple(r) for r in classify.confusion(df, made, "c").collect()} == matrix
    assert classify.build_classifier(df, made, "c", ClassifierParameters(classify.N_EACH, 3)) == built
    only = [Rule((Literal("x", GT, 1.0),), Literal("c", EQ, "P"))]
    assert {r["id"] for r in matching.with_first_head(df, only, "l").filter("l = 'P'").collect()} == {r["id"] for r in df.filter("x > 1").collect()}


def test_a_hundred_thousand_rules_label_a_table(spark):
    rng = random.Random(1)
    df = spark.range(3000).selectExpr("cast(id % 500 as string) a", "cast(id % 71 as string) b", "cast(id % 1000 as double) x")
    made = [Rule((Literal("a", EQ, str(rng.randrange(500))), Literal("b", EQ, str(rng.randrange(71))), Literal("x", LE, float(rng.randrange(1000)))), Literal("c", EQ, str(i % 9))) for i in range(100_000)]
    got = classify.label(df, made, "l")
    assert len(got._jdf.queryExecution().optimizedPlan().toString()) < 60_000
    first = {}
    for r in made:
        first.setdefault((r.body[0].value, r.body[1].value), []).append((r.body[2].value, r.head.value))
    for r in got.collect():
        assert r["l"] == next((h for t, h in first.get((r["a"], r["b"]), []) if r["x"] <= t), None)


def test_a_long_list_is_covered_in_seconds():
    import time

    rng = np.random.default_rng(2)
    met, classes = rng.random((2000, 10_000)) < 0.01, rng.choice(list("pq"), 10_000).tolist()
    held = classify.Held(met, classes, rng.integers(1, 9, (1, 10_000)), rng.choice(list("pq"), 2000).tolist())
    began = time.perf_counter()
    picks = held.picks(list(range(2000)), None, False)
    assert time.perf_counter() - began < 20 and len(picks) == 2000
    open_, n = np.ones(10_000, bool), held.n[0]
    for i, p, m in picks[:30]:
        right = held.classes == held.heads[i]
        assert (p, m) == (int(n[met[i] & open_ & right].sum()), int(n[met[i] & open_ & ~right].sum()))
        open_ &= ~met[i]


def test_folds_of_few_keys_are_arithmetic(spark):
    rows = [("a", "p")] * 61 + [("b", "q")] * 30 + [("c", None)] * 7 + [(None, "p")] * 5
    df = spark.createDataFrame(rows, "`k.` string, c string")
    table_, weights, total = crossval.weighted_folds(df, ["k.", "c"], "k.", "c", folds=4)
    got = [tuple(r) for r in table_.select("`k.`", "c", *weights, total).collect()]
    assert {r[:2]: r[-1] for r in got} == Counter(rows) and all(sum(r[2:-1]) == r[-1] for r in got)
    assert [sum(r[2 + i] for r in got) for i in range(4)] == [26, 26, 26, 25]
    plain = Counter((r["k."], r["c"], r["fold"]) for r in crossval.with_folds(df.withColumnRenamed("k.", "k"), "k", "c", folds=4).withColumnRenamed("k", "k.").collect())
    assert {(*r[:2], i): r[2 + i] for r in got for i in range(4) if r[2 + i]} == plain


@pytest.mark.parametrize("method", [selection.NONE, selection.ODDS_RATIO])
def test_folds_together_are_folds_one_by_one(spark, monkeypatch, method):
    rng = random.Random(21)
    rows = [(str(i), a := rng.choice("xyz"), rng.choice(["k", "l", None]), ("A" if a == "x" else "B") if rng.random() < 0.8 else rng.choice(["A", "B", None])) for i in range(120)]
    df = spark.createDataFrame(rows, "id string, a string, b string, c string")
    p, s = MiningParameters(0.05, 0.55, 3), selection.SelectionParameters(method, 0.8)
    cells = [("n_all", True, 2), ("n_each", False, 1), ("max_cover", True, 2), ("all", True, 1)]
    got = crossval.grid_folds(df, ["a", "b"], "c", p, s, key=("id",), folds=3, cells=cells)
    rows_ = crossval.with_folds(df.filter("c is not null"), "id", folds=3).cache()
    want = [(i, *x) for i in range(3) for x in crossval.grid(rows_.filter(f"fold <> {i}"), rows_.filter(f"fold = {i}"), ["a", "b"], "c", p, s, cells)]
    assert [x[:4] for x in got] == [x[:4] for x in want] and [x[4] for x in got] == pytest.approx([x[4] for x in want])
    monkeypatch.setattr(classify, "LOCAL_CELLS", 0)
    assert [x[4] for x in crossval.grid_folds(df, ["a", "b"], "c", p, s, key=("id",), folds=3, cells=cells[:2])] == pytest.approx([x[4] for x in got if x[1:4] in cells[:2]])
    before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    crossval.cross_validate(df, ["a", "b"], "c", p, ClassifierParameters("n_all", 2), key=("id",), folds=2)
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == before


def test_correlated_pairs_are_those_of_all_pairs(spark):
    rng = random.Random(8)
    rows = [(a := rng.choice("xyz"), a if rng.random() < 0.9 else "x", rng.choice(["k", "l", None]), "same") for _ in range(70)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    attrs = ["a", "b", "c", "d"]
    every = {(r["a"], r["b"]): r["corr"] for r in selection.correlations(df, attrs).collect()}
    for threshold in (0.0, 0.3, 0.8, 1.0):
        pairs = selection._correlated_pairs(selection.transactions(df, attrs), threshold)
        assert "NestedLoop" not in pairs._jdf.queryExecution().executedPlan().toString().replace("BroadcastNestedLoopJoin BuildRight, Cross", "")
        got = {(r["a"], r["b"]): r["corr"] for r in pairs.collect()}
        assert set(got) == {k for k, x in every.items() if x > threshold + 1e-12} and all(got[k] == pytest.approx(every[k]) for k in got)


def test_candidates_are_sets_whose_subsets_are_frequent(spark):
    from itertools import combinations

    rng = random.Random(17)
    rows = [tuple(rng.choice("xyz"[: 2 + k % 2]) for k in range(5)) for _ in range(60)]
    attrs = [f"a{k}" for k in range(5)]
    df = spark.createDataFrame(rows, ", ".join(f"{a} string" for a in attrs))
    p = MiningParameters(0.2, 0.5, 5)
    frequent = {frozenset(r["items"]) for r in mining.frequent_itemsets(df, attrs, p).collect()}
    every = [f"{a}={v}" for a, vs in zip(attrs, zip(*rows)) for v in sorted(set(vs))]
    want = {}
    for n in range(1, 6):
        made = [c for c in combinations(every, n) if len({x.split("=")[0] for x in c}) == n and (n == 1 or all(frozenset(s) in frequent for s in combinations(c, n - 1)))]
        if made:
            want[n] = len(made), sum(frozenset(c) in frequent for c in made)
    assert {r["length"]: (r["candidates"], r["itemsets"]) for r in mining.candidate_counts(df, attrs, p).collect()} == want and len(want) > 2


def test_dictionaries_and_splits(spark):
    df = spark.createDataFrame([(str(i % 23), None if i % 5 else "v", i) for i in range(100)], "`a.1` string, b string, n long")
    got = {(r["attr"], r["value"]): r["code"] for r in tables.dictionary(df, ["a.1", "b"]).collect()}
    assert got == {("a.1", v): k for k, v in enumerate(sorted({str(i) for i in range(23)}))} | {("b", "v"): 0}
    coded = tables.encode(df.withColumnRenamed("a.1", "a"), "b").collect()
    assert {(r["b"], r["b_code"]) for r in coded} == {(None, -1), ("v", 0)} and len(coded) == 100
    a, b = tables.random_split(df, 0.7, seed=3)
    assert sorted(r["n"] for r in a.union(b).collect()) == list(range(100)) and 50 < a.count() < 90
    assert {r["n"] for r in tables.random_split(df.repartition(7).orderBy(F.desc("n")), 0.7, seed=3)[0].collect()} == {r["n"] for r in a.collect()}
    assert tables.random_split(df, 1.0)[1].count() == 0
    with pytest.raises(ValueError):
        tables.random_split(df, 1.5)


def test_sparse_k_means_is_k_means(spark):
    from marlstone.operators import sparse_cluster

    rng = random.Random(5)
    rows = [(rng.choice(["x", "y", None]), str(rng.randrange(60)), rng.choice([None, *range(12)]), 3.0) for _ in range(80)]
    df = tables.typed(spark.createDataFrame([(a, b, None if n is None else float(n), c) for a, b, n, c in rows], "`a.1` string, b string, n double, same double"), ["a.1", "b"], ["n", "same"])
    initial = [{"a.1": "x", "b": "7", "n": 2.0, "same": 3.0}, {"a.1": None, "b": "8", "n": None, "same": None}, {"a.1": "y", "b": "9", "n": 1e6, "same": 3.0}]
    plain_names = df.withColumnRenamed("a.1", "a1")
    for start, weights in ((None, {"b": 0.5}), (initial, None)):
        got = sparse_cluster.k_means_sparse(df, 3, 4, weights=weights, initial=start)
        want = cluster.k_means(plain_names, 3, 4, weights=weights, initial=start and [{"a1": r["a.1"], **r} for r in start])
        assert got.log == want.log and got.iterations == want.iterations and got.members == [c.members for c in want.clusters]
        table_ = {(r["cluster"], r["attr"], r["value"]): r["weight"] for r in got.centroids().collect()}
        plain = {(k, {"a1": "a.1"}.get(a, a), v): p for k, c in enumerate(want.clusters) for a, x in c.items.items() for v, p in (x.items() if isinstance(x, dict) else [("", x)]) if p or not isinstance(x, dict)}
        assert set(table_) == set(plain) and all(table_[k] == pytest.approx(p) for k, p in plain.items())
        labels = sparse_cluster.assign_sparse(df, got, "k")
        assert labels.count() == 80 and labels.columns == [*df.columns, "k"]
        assert Counter(r["k"] for r in labels.collect()) == Counter(r["k"] for r in cluster.assign(plain_names, want, "k").collect())


def test_scratch_is_let_go(spark):
    from marlstone.sources.files import drop_scratch, written

    held = written(spark.range(5), "probe")
    folder = held.inputFiles()[0].split("/probe-")[0].removeprefix("file://").removeprefix("file:")
    assert held.count() == 5 and os.path.isdir(folder)
    drop_scratch(spark)
    assert not os.path.exists(folder)
