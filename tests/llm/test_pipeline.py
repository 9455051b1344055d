import hashlib
import re
from collections import Counter

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm import mixing, queries, toxicity
from marlstone.llm import pipeline as stages
from marlstone.llm.queries import MODEL
from tests.llm.test_operators import components, slow_budgets, slow_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages_chain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "simhash_near_dedup", "mixing", "sentencepiece"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF).cache()
        assert set(docs.columns) == set(before.columns)
        kept[name] = docs.collect()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    source = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(*toxicity.sample(source, labels, "toxic", toxicity.MAX_SAMPLE))
    want = sorted(r.doc_id for r in source.collect() if model.score(r.text or "") < 0.5)
    assert sorted(r.doc_id for r in kept["toxicity"]) == want
    # of equal texts the longest original stays, of equally long ones the smallest id
    best = {}
    for r in kept["toxicity"]:
        k = re.sub("[\x20\x09-\x0d]", "", r.text)
        best[k] = min(best.get(k, (1, 0)), (-len(r.text), r.doc_id))
    assert sorted(r.doc_id for r in kept["exact_dedup"]) == sorted(i for _, i in best.values())
    assert sorted(r.doc_id for r in kept["simhash_near_dedup"]) == slow_near(kept["exact_dedup"])
    assert sorted(r.doc_id for r in kept["mixing"]) == slow_mix(kept["simhash_near_dedup"])


def slow_near(rows):
    """Smallest id of each component of fingerprints at two bits or fewer."""
    fps = [slow_fingerprint(r.text) for r in rows]
    low = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    return sorted(min(r.doc_id for r, x in zip(rows, low) if x == c) for c in set(low))


def slow_mix(rows):
    """Ids as often as they are taken: whole epochs of a leaf, then a prefix of the next."""
    words = lambda r: len(re.findall("[^\x20\x09-\x0d]+", r.text or ""))
    leaves, out = {}, []
    for r in rows:
        number = re.search("([0-9]+)$", r.source or "")
        domain = queries.DOMAINS[(int(number[1]) if number else 0) // 5 % len(queries.DOMAINS)]
        leaves.setdefault((domain, r.lang or "", r.source or ""), []).append(r)
    tokens = {k: sum(map(words, v)) for k, v in leaves.items()}
    given = {tuple(x for x in w[:3] if x is not None): w[3] for w in queries.WEIGHTS}
    budgets = slow_budgets(list(leaves), given, float(sum(tokens.values())), {k: 4.0 * v for k, v in tokens.items()})
    for leaf, own in leaves.items():
        budget = int(budgets[leaf] + 1e-6)
        epochs = min(4, budget // tokens[leaf]) if tokens[leaf] else 0
        rest = budget - epochs * tokens[leaf] if epochs < 4 else 0
        place = lambda r: hashlib.md5(f"{mixing.SEED}|{epochs}|{r.doc_id}|{hashlib.md5((r.text or '').encode()).hexdigest()}".encode()).hexdigest()  # noqa: B023, E731
        taken = 0
        for r in sorted(own, key=place):
            taken += words(r)
            out += [r.doc_id] * (epochs + (rest > 0 and taken <= rest))
    return sorted(out)


def test_run_is_the_library_on_what_is_left(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))
    assert len(out) > 100
    for r in out:
        ids = sp.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert list(r.ids) == ids


def test_odd_rows_pass_the_stages(spark):
    rows = [(1, "a b c", "en", "src0", 5), (1, "a b c", "en", "src0", 5), (2, None, None, None, None), (None, "x y", "en", "src1", 3), (3, "", "de", "odd", 0), (4, "w " * 100_000, "en", "src2", 200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit(1)).withColumn("_id", F.lit(2))
    for _name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        # every text is left by each stage before mixing, in one row: "" and null are equal, so are the two rows of 1
        if _name != "mixing":
            left = sorted((str(r.doc_id), r.text or "") for r in docs.collect())
            assert left == sorted([("1", "a b c"), ("2", ""), ("None", "x y"), ("4", "w " * 100_000)] + ([("1", "a b c"), ("3", "")] if _name == "toxicity" else []))
    took = Counter(r.doc_id for r in docs.collect())
    got = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert Counter(r.doc_id for r in got) == took and took
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_verdicts_are_for_rows_not_ids(spark):
    one, two, three = ("alpha beta gamma delta epsilon", "one two three four five six", "rot gelb blau grau braun")
    rows = [(3, one), (5, one), (5, two), (None, one), (None, three), (None, three + " "), (None, three + " "), (7, "last words of all are here"), (7, "last words of all are here"), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = sorted([(3, one), (5, two), (None, three + " "), (7, "last words of all are here"), (None, None)], key=str)
    for stage in (stages.exact_dedup_stage, stages.simhash_stage):
        out = stage(spark, docs, SF)
        assert set(out.columns) == set(docs.columns)
        assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == want
    # without ids, near copies are one document and others stay
    near = " ".join(f"w{i}" for i in range(400))
    docs = spark.createDataFrame([(None, t, "en", "src0", len(t)) for t in (near, near + "  ", near.upper(), one, two)], docs.schema)
    assert sorted(r.text for r in stages.simhash_stage(spark, docs, SF).collect()) == sorted([near + "  ", one, two])


def test_queries_are_whole():
    assert {f"op{i}" for i in range(1, 14)} == {k.split("_")[0] for k in queries.queries() if k.startswith("op")}
    assert "pipeline" in queries.queries() and set(queries.oracle_sql()) <= set(queries.queries())


def test_the_driver_gives_memory_back():
    """Small pieces that lie between others in use go back to the system, too."""
    from pathlib import Path

    from marlstone.llm.common import give_back

    held = lambda: int(re.search(r"Pss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024
    pieces = [bytes(3000) for _ in range(30_000)]
    kept = pieces[::50]
    before = held()
    del pieces
    give_back()
    assert len(kept) == 600 and held() < before - 40


def test_the_sample_comes_in_its_form_and_trains_the_same(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    texts, y = toxicity.sample(docs, labels, "toxic", toxicity.MAX_SAMPLE)
    data, same = toxicity.sample(docs, labels, "toxic", toxicity.MAX_SAMPLE, form=toxicity.normal)
    assert data == [toxicity.normal(t) for t in texts] and y.tolist() == same.tolist()
    assert toxicity._parameters(toxicity.learned(docs, labels)) == toxicity._parameters(toxicity.train(texts, y))
