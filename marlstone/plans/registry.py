"""Queries of the mining operators over the driver's tables; each is an operator on whole tables, given production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import itemsets, measures, text
from marlstone.operators import classify, cluster, crossval, discretise, induce, mining, rules, selection, sparse_cluster, tables
from marlstone.operators.classify import ClassifierParameters
from marlstone.operators.cluster import Attribute, Centroid, ClusterModel
from marlstone.operators.mining import MiningParameters
from marlstone.operators.rules import EQ, GT, LE, NEQ, Literal, Rule
from marlstone.plans import oracles, pipelines
from marlstone.sources import models
from marlstone.sources.files import read_text, scratch_path, write_text
from marlstone.sources.tables import c5_names, c5_rows, load_table, read_typed_text, save_table, write_typed_text

DIGITS = 9
#: Confidence that rules over orders and customers reach, whose columns are hardly associated.
SUPPORT, CONFIDENCE, CLASS_CONFIDENCE = 0.01, 0.2, 0.335
ITEMS = ["c_mktsegment", "o_orderpriority", "o_orderstatus"]
PRICE_BAND = 100_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customers' market segment; categories are text."""
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return o.join(c, o["o_custkey"] == c["c_custkey"])


def _mined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.typed(_orders(spark, sf_dir), ITEMS)


def _banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = F.least(F.floor(F.col("o_totalprice") / PRICE_BAND), F.lit(4)).cast("string")
    return tables.typed(_orders(spark, sf_dir).withColumn("band", band), [*ITEMS, "band"])


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    joined = d.join(_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id")
    return tables.typed(joined, ["lang", "source", "quality", "toxic"], ["n_chars"])


def _r(name: str) -> F.Column:
    return F.round(F.col(name).cast("double"), DIGITS).alias(name)


def _text(name: str) -> F.Column:
    return F.array_join(name, " & ").alias(name)


P = MiningParameters(SUPPORT, CONFIDENCE, 10)

# A fixed list of rules over orders and customers, so that SQL can state the same.
RULES = [
    Rule((Literal("o_orderpriority", EQ, "1-URGENT"), Literal("o_totalprice", GT, 250000)), Literal("o_orderstatus", EQ, "F")),
    Rule((Literal("c_mktsegment", NEQ, "BUILDING"), Literal("o_totalprice", LE, 120000)), Literal("o_orderstatus", EQ, "O")),
    Rule((Literal("o_orderpriority", EQ, "5-LOW"),), Literal("o_orderstatus", EQ, "P")),
    Rule((Literal("c_acctbal", LE, 2500),), Literal("o_orderstatus", EQ, "F")),
]
CLASS = "o_orderstatus"


def _ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    keyed = tables.typed(o.withColumn("key", F.col("o_orderkey").cast("string")), ["key", *ITEMS], ["o_totalprice", "c_acctbal"])
    return keyed


def item_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.item_support(_mined(spark, sf_dir), ITEMS)


def frequent_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.frequent_itemsets(_mined(spark, sf_dir), ITEMS, P).select(_text("items"), F.col("freq").cast("long").alias("freq"))


def frequent_itemsets_fpgrowth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.frequent_itemsets(_mined(spark, sf_dir), ITEMS, MiningParameters(SUPPORT, CONFIDENCE, 10, "fpgrowth")).select(_text("items"), "freq")


def itemset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.candidate_counts(_mined(spark, sf_dir), ITEMS, P)


def assoc_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.association_rules(_mined(spark, sf_dir), ITEMS, P).select(_text("body"), "head", "pos", "neg", "freq", _r("conf"))


def class_rules_minimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mining.class_rules(_banded(spark, sf_dir), ["band", "c_mktsegment", "o_orderpriority"], CLASS, MiningParameters(0.001, CLASS_CONFIDENCE, 10))
    return found.select(_text("body"), "head", "pos", "neg", "freq", _r("conf"))


def class_rules_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, attrs = _banded(spark, sf_dir), ["band", "c_mktsegment", "o_orderpriority"]
    s = selection.SelectionParameters(selection.ODDS_RATIO, 0.5)
    chosen = {f"{CLASS}={v}": selection.select_items(df, [*attrs, CLASS], f"{CLASS}={v}", s) for v in classify.class_values(df, CLASS)}
    found = mining.class_rules(df, attrs, CLASS, MiningParameters(0.001, CLASS_CONFIDENCE, 10), chosen)
    return found.select(_text("body"), "head", "pos", "neg", "freq", _r("conf"))


def entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.entropy(_labelled(spark, sf_dir), "quality", "lang").select("lang", _r("entropy"))


def entropy_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.entropy(_mined(spark, sf_dir), CLASS).select(_r("entropy"))


def info_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.info_gain(_labelled(spark, sf_dir), ["lang", "source", "toxic"], "quality").select("attr", _r("gain"))


def info_gain_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.info_gain_lift(_labelled(spark, sf_dir), ["lang", "source", "toxic"], "quality").select("attr", _r("gain"))


def info_gain_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _labelled(spark, sf_dir)
    a = measures.info_gain_cut(df, "n_chars", 1000.0, "quality").select(F.lit("standard").alias("kind"), _r("gain"))
    return a.unionByName(measures.info_gain_cut(df, "n_chars", 1000.0, "quality", lift=True).select(F.lit("lift").alias("kind"), _r("gain")))


TARGET = "o_orderstatus=F"


def odds_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.odds_ratio(_mined(spark, sf_dir), ITEMS, TARGET).select("item", _r("score"))


def odds_ratio_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.select_items(_mined(spark, sf_dir), ITEMS, TARGET, selection.SelectionParameters(selection.ODDS_RATIO, 0.4))


def item_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.correlations(_mined(spark, sf_dir), ITEMS).select("a", "b", _r("corr"))


def correlation_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.select_items(_mined(spark, sf_dir), ITEMS, TARGET, selection.SelectionParameters(selection.STAT_CORR, threshold=0.0))


def relief(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.relief(_banded(spark, sf_dir), [*ITEMS, "band"], TARGET, 100).select("item", _r("score"))


def relief2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.relief(_banded(spark, sf_dir), [*ITEMS, "band"], TARGET, 100, second=True).select("item", _r("score"))


def best_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discretise.best_cut(_labelled(spark, sf_dir), "n_chars", "quality").select("cut", _r("entropy"))


def best_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best cut of every number of lineitem, for its return flag."""
    numbers = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    df = tables.typed(_table(spark, sf_dir, "lineitem"), ["l_returnflag"], numbers)
    return discretise.best_cuts(df, numbers, "l_returnflag").select("attr", "cut", _r("entropy"))


def split_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.split_entropy(_labelled(spark, sf_dir), "n_chars", 1000.0, "quality").select(_r("entropy"))


def discretised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discretise.discretise(_labelled(spark, sf_dir), "n_chars", 1000.0, "size").groupBy("size", "quality").agg(F.count("*").alias("n"))


def z_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("z"))
    return discretise.z_scores(c, ["z"]).select("c_custkey", _r("z"))


def value_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.dictionary(_mined(spark, sf_dir), ITEMS).withColumn("code", F.col("code").cast("long"))


def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    a, b = tables.random_split(o)
    return a.withColumn("first", F.lit(True)).unionByName(b.withColumn("first", F.lit(False)))


def encoded_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.encode(_ruled(spark, sf_dir), "o_orderpriority")
    return e.select("key", "o_orderpriority", F.col("o_orderpriority_code").cast("long").alias("code"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.transactions(_mined(spark, sf_dir), ITEMS).select(_text("items"), "weight")


def rule_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.coverage(_ruled(spark, sf_dir), RULES).select(F.col("rule").cast("long").alias("rule"), "pos", "neg", "freq", _r("conf"))


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.confusion(_ruled(spark, sf_dir), RULES, CLASS)


def classifier_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.metrics(classify.confusion(_ruled(spark, sf_dir), RULES, CLASS)).withColumn("accuracy", F.round("accuracy", DIGITS))


def first_match_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.label(_ruled(spark, sf_dir), RULES, "label").select("key", "label")


def rule_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.vote(_ruled(spark, sf_dir), [RULES[0], RULES[3]], "vote").select("key", _r("vote"))


def _listed(spark: SparkSession, made: list[Rule]) -> DataFrame:
    rows = [(i, " & ".join(map(str, r.body)), str(r.head), r.pos, r.neg) for i, r in enumerate(made)]
    return spark.createDataFrame(rows, "place long, body string, head string, pos long, neg long")


def greedy_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(spark, classify.build_classifier(_ruled(spark, sf_dir), RULES, CLASS, ClassifierParameters(classify.USE_ALL)))


def n_best_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(spark, classify.build_classifier(_ruled(spark, sf_dir), RULES, CLASS, ClassifierParameters(classify.N_ALL, 2)))


def n_rules_each_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(spark, classify.build_classifier(_ruled(spark, sf_dir), RULES, CLASS, ClassifierParameters(classify.N_EACH, 1)))


def max_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(spark, classify.build_classifier(_ruled(spark, sf_dir), RULES, CLASS, ClassifierParameters(classify.MAX_COVER, 3)))


def default_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.most_frequent_class(_mined(spark, sf_dir), CLASS)


def fold_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").select("o_orderkey")
    return crossval.with_folds(o, "o_orderkey").groupBy(F.col("fold").cast("long").alias("fold")).agg(F.count("*").alias("n"))


def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crossval.with_folds(_table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", F.col("fold").cast("long").alias("fold"))


def mined_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = crossval.run_classifier(_banded(spark, sf_dir), ["band", "c_mktsegment", "o_orderpriority"], CLASS, MiningParameters(0.001, CLASS_CONFIDENCE, 3), ClassifierParameters(classify.N_ALL, 5))
    return _listed(spark, made)


def cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _labelled(spark, sf_dir).select("lang", "source", "quality", "toxic")
    c = ClassifierParameters(classify.N_ALL, 3)
    found = crossval.cross_validate(df, ["lang", "toxic"], "quality", MiningParameters(0.05, 0.6, 3), c, key=("lang", "source", "quality", "toxic"))
    return spark.createDataFrame(list(enumerate(found)), "fold long, accuracy double")


def classifier_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = crossval.with_folds(_labelled(spark, sf_dir).drop("n_chars"), "lang", "source", "quality", "toxic")
    train, test = df.filter("fold > 0").drop("fold"), df.filter("fold = 0").drop("fold")
    found = crossval.grid(train, test, ["lang", "toxic"], "quality", MiningParameters(0.05, 0.6, 3))
    return spark.createDataFrame(found, "strategy string, default_rule boolean, n_rules long, accuracy double")


def classifier_grid_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _labelled(spark, sf_dir).select("lang", "source", "quality", "toxic")
    found = crossval.grid_folds(df, ["lang", "toxic"], "quality", MiningParameters(0.05, 0.6, 3), key=("lang", "source", "quality", "toxic"))
    return spark.createDataFrame(found, "fold long, strategy string, default_rule boolean, n_rules long, accuracy double")


def induction_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    attrs = ["lang", "source", "n_chars"]
    rows = tables.distinct_rows(_labelled(spark, sf_dir), [*attrs, "quality"])
    found = induce.candidate_literals(rows, attrs, "quality", {"n_chars": 1000.0}, True)
    return found.select(F.col("place").cast("long").alias("place"), "value", "negated", "n", _r("entropy"))


def induced_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listed(spark, induce.grow_rules(_labelled(spark, sf_dir), "quality", induce.InductionParameters(20), ["lang", "toxic", "n_chars"]))


# Fixed centroids over customers, so that SQL can state the same.
CENTROIDS = ClusterModel(
    [Attribute("c_mktsegment", "d", 1.0, ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")), Attribute("c_acctbal", "c", 0.5, (), 4500.0, 3000.0)],
    [
        Centroid({"c_mktsegment": {"BUILDING": 0.75, "FURNITURE": 0.25}, "c_acctbal": -1.0}),
        Centroid({"c_mktsegment": {"AUTOMOBILE": 0.5, "MACHINERY": 0.5}, "c_acctbal": 0.5}),
        Centroid({"c_mktsegment": {"HOUSEHOLD": 1.0}, "c_acctbal": 1.25}),
    ],
)


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer").withColumn("key", F.col("c_custkey").cast("string"))
    return tables.typed(c, ["key", "c_mktsegment"], ["c_acctbal"])


def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.assign(_customers(spark, sf_dir), CENTROIDS, "cluster").select("key", "cluster")


def _centroids(spark: SparkSession, model: ClusterModel) -> DataFrame:
    rows = []
    for k, c in enumerate(model.clusters):
        for a in model.attributes:
            here = c.items[a.name]
            rows += [(k, a.name, v, here.get(v, 0.0), c.members) for v in a.values] if a.kind == "d" else [(k, a.name, "", here, c.members)]
    return spark.createDataFrame(rows, "cluster long, attr string, value string, weight double, members long").withColumn("weight", F.round("weight", 6))


def kmeans_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _centroids(spark, cluster.updated(_customers(spark, sf_dir), CENTROIDS)[0])


def kmeans_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _customers(spark, sf_dir).drop("key")
    return _centroids(spark, cluster.k_means(df, 5, 10))


def kmeans_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kmeans_fit by a table of probabilities; values that no member of a cluster has are left out."""
    found = sparse_cluster.k_means_sparse(_customers(spark, sf_dir).drop("key"), 5, 10).centroids()
    return found.select(F.col("cluster").cast("long").alias("cluster"), "attr", "value", F.round("weight", 6).alias("weight"), "members")


def _ruled_file(spark: SparkSession, sf_dir: str) -> str:
    """The table that the fixed rules are for, written as Parquet."""
    path = scratch_path(spark, "ruled") + ".parquet"
    save_table(_ruled(spark, sf_dir), path)
    return path


def _written(spark: SparkSession, name: str, content: str) -> str:
    path = scratch_path(spark, name)
    write_text(spark, path, content)
    return path


def file_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a table's file and a rule list's to a labelled table's, and back."""
    out = scratch_path(spark, "labels") + ".parquet"
    pipelines.assign_classes(spark, _ruled_file(spark, sf_dir), _written(spark, "rules", models.rules_xml(RULES)), out, "label")
    return load_table(spark, out).select("key", "label")


def file_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "votes") + ".parquet"
    pipelines.assign_votes(spark, _ruled_file(spark, sf_dir), _written(spark, "rules", models.rules_xml([RULES[0], RULES[3]])), out, "vote")
    return load_table(spark, out).select("key", _r("vote"))


def file_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of testing a rule list's file on a table's, read back."""
    import xml.etree.ElementTree as ET

    out = scratch_path(spark, "report")
    pipelines.test_classifier(spark, _written(spark, "rules", models.rules_xml(RULES)), _ruled_file(spark, sf_dir), out)
    report = ET.fromstring(read_text(spark, out))
    values = [e.text for e in report.find("target_vals")]
    cells = [(p, r, int(d.text)) for p, row in zip([*values, None], report.find("matrix")) for r, d in zip(values, row)]
    rows = [(p, r, n, int(report.findtext("all_corr"))) for p, r, n in cells if n]
    return spark.createDataFrame(rows, "predicted string, real string, n long, correct long")


def file_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a table's file and a clustering's to a table of clusters, and back."""
    data, out = scratch_path(spark, "customers") + ".parquet", scratch_path(spark, "clusters") + ".parquet"
    save_table(_customers(spark, sf_dir), data)
    pipelines.assign_clusters(spark, data, _written(spark, "model", models.cluster_xml(CENTROIDS)), out, "cluster")
    return load_table(spark, out).select("key", "cluster")


def rule_list_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mined class rules, with their counts, written as a rule list and read again."""
    made = crossval.mine_rules(_banded(spark, sf_dir), ["band", "c_mktsegment", "o_orderpriority"], CLASS, MiningParameters(0.001, CLASS_CONFIDENCE, 10))
    back = models.parse_rules(read_text(spark, _written(spark, "rules", models.rules_xml(made, counts=True))))
    rows = [(" & ".join(map(str, r.body)), str(r.head), r.pos, r.neg, r.freq, round(r.conf, DIGITS)) for r in back]
    return spark.createDataFrame(rows, "body string, head string, pos long, neg long, freq long, conf double")


def parquet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written and read by the suffix of its file; kinds of columns are kept."""
    back = load_table(spark, _ruled_file(spark, sf_dir))
    kinds = F.lit(",".join(tables.kind(back, x) for x in back.columns))
    return back.select("key", "c_mktsegment", "o_orderstatus", _r("o_totalprice"), kinds.alias("kinds"))


def c5_names_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a .names file."""
    df = tables.typed(_table(spark, sf_dir, "part"), ["p_brand", "p_type"], ["p_retailprice"])
    lines = c5_names(df, "p_brand").split("\n")
    return spark.createDataFrame([(i, x) for i, x in enumerate(lines) if x], "place long, line string")


def typed_text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "text")
    t = _table(spark, sf_dir, "orders")
    df = tables.typed(t.withColumn("key", F.col("o_orderkey").cast("string")).withColumn("o_orderstatus", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))), ["key", "o_orderstatus", "o_orderpriority"], ["o_totalprice"])
    write_typed_text(df.withColumn("o_orderpriority", F.translate("o_orderpriority", " ", "_").alias("o_orderpriority", metadata={"kind": "d"})), path)
    return read_typed_text(spark, path).select("key", "o_orderstatus", "o_orderpriority", _r("o_totalprice"))


def c5_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tables.typed(_table(spark, sf_dir, "part"), ["p_brand", "p_type"], [])
    return c5_rows(df, "p_brand", class_first=True, ending_dot=True).groupBy("value").agg(F.count("*").alias("n"))


def itemset_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part").select("p_partkey", F.array_sort(F.array_distinct(F.split("p_name", " "))).alias("a"), F.array_sort(F.array_distinct(F.split(F.concat_ws(" ", "p_type", "p_brand"), " "))).alias("b"))
    a, b = F.col("a"), F.col("b")
    j = lambda x: F.array_join(x, "|")
    return p.select(
        "p_partkey",
        j(itemsets.union(a, b)).alias("united"),
        j(itemsets.intersection(a, b)).alias("common"),
        j(itemsets.difference(a, b)).alias("rest"),
        itemsets.is_subset(itemsets.intersection(a, b), a).alias("inside"),
        itemsets.disjoint(a, b).alias("apart"),
        itemsets.count(a).cast("long").alias("size"),
        itemsets.first_item(b).alias("first"),
        itemsets.has_item(b, F.lit("Brand#11")).alias("has"),
        F.size(itemsets.proper_subsets(b)).cast("long").alias("parts"),
    )


def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, x = F.col("c_name"), F.col("c_acctbal")
    return _table(spark, sf_dir, "customer").select(
        "c_custkey",
        text.left(s, 4).alias("head"),
        text.mid(s, 2, 6).alias("middle"),
        text.find_char(s, "#").cast("long").alias("place"),
        text.find_first_of(s, "#0123456789").cast("long").alias("digit"),
        text.find_first_not_of(s, "Custome").cast("long").alias("other"),
        text.to_upper(s).alias("upper"),
        text.replace_char(s, "#", "/").alias("path"),
        text.file_name(text.replace_char(s, "#", "/")).alias("file"),
        F.size(text.split_words(F.concat(F.lit("  "), text.replace_char(s, "#", " "), F.lit(" ")))).cast("long").alias("words"),
        text.float_text(x).alias("number"),
        text.to_float(text.float_text(x)).alias("back"),
        text.to_integer(F.concat(F.lit(" "), F.col("c_custkey").cast("string"))).alias("whole"),
        text.round_half_up(x).cast("long").alias("rounded"),
        text.trunc(x).alias("cut"),
        text.trim(F.concat(F.lit(" \t"), s, F.lit("\t "))).alias("trimmed"),
    )


def extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.extremum(_table(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey")


QUERIES = (
    item_support, frequent_itemsets, frequent_itemsets_fpgrowth, itemset_counts, assoc_rules, class_rules_minimal, class_rules_selected,
    entropy, entropy_all, info_gain, info_gain_lift, info_gain_cut, odds_ratio, odds_ratio_selection, item_correlation, correlation_selection,
    relief, relief2, best_cut, best_cuts, split_entropy, discretised, z_scores, value_dictionary, encoded_column, random_split, transactions, rule_coverage,
    confusion_matrix, classifier_metrics, first_match_label, rule_vote, greedy_cover, n_best_rules, n_rules_each_class, max_cover,
    default_class, fold_sizes, folds, mined_classifier, cross_validation, classifier_grid, classifier_grid_folds, induction_candidates, induced_rules,
    kmeans_assign, kmeans_update, kmeans_fit, kmeans_sparse, typed_text_round_trip, file_labels, file_votes, file_test,
    file_clusters, rule_list_round_trip, parquet_round_trip, c5_names_lines, c5_export, itemset_algebra, text_functions, extremes,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
