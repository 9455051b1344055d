import xml.etree.ElementTree as ET
from datetime import datetime

import pytest
from pyspark.errors import PySparkException

from marlstone.operators import classify, cluster, induce, tables
from marlstone.operators.rules import EQ, GT, LE, NEQ, Literal, Rule, html, plain_text, words
from marlstone.plans import pipelines
from marlstone.sources import models
from marlstone.sources import tables as files
from marlstone.streaming import cluster_stream, label_stream
from tests.test_core import F1, NAMES


def write(path, text):
    path.write_text(text)
    return str(path)


def test_typed_text(spark, tmp_path):
    text = "% a comment\nx(d)\ty(c)\tz(d)\n007 1.5 ?  % more\n  ?\t-2e3\tb\t\n\na ? c"
    df = files.load_table(spark, write(tmp_path / "t.tab", text))
    assert [tuple(r) for r in df.collect()] == [("007", 1.5, None), (None, -2000.0, "b"), ("a", None, "c")]
    assert files.header_of(df) == ["x(d)", "y(c)", "z(d)"]
    for name in ("out.tab", "out.bin", "out.parquet"):
        files.save_table(df, str(tmp_path / name))
        again = files.load_table(spark, str(tmp_path / name))
        assert sorted(map(str, again.collect())) == sorted(map(str, df.collect())) and files.header_of(again) == files.header_of(df)


def test_rows_like_the_header_are_rows(spark, tmp_path):
    path = write(tmp_path / "h.tab", "a(d)\tb(d)\na(d)\tb(d)\nx\ty\na(d)\tb(d)\n")
    df = files.read_typed_text(spark, path)
    assert sorted(map(tuple, df.collect())) == [("a(d)", "b(d)"), ("a(d)", "b(d)"), ("x", "y")]
    files.write_typed_text(df.repartition(2), str(tmp_path / "again"))
    assert sorted(map(tuple, files.read_typed_text(spark, str(tmp_path / "again")).collect())) == sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("text", ["x(d) y(d)\na b c\n", "x(d) y(d)\na\n", "x(c)\nabc\n"])
def test_bad_rows_raise(spark, tmp_path, text):
    with pytest.raises(PySparkException):
        files.load_table(spark, write(tmp_path / "t.csv", text)).collect()


@pytest.mark.parametrize("text", ["x(q)\n1\n", "x\n1\n", "x(d) x(c)\na 1\n", "\n\n"])
def test_bad_headers_raise(spark, tmp_path, text):
    with pytest.raises(ValueError):
        files.load_table(spark, write(tmp_path / "t.csv", text))


def test_values_that_text_cannot_hold_raise(spark, tmp_path):
    with pytest.raises(PySparkException):
        files.save_table(spark.createDataFrame([("a b",)], "x string"), str(tmp_path / "t.tab"))


def test_c5(spark, tmp_path):
    rows = spark.createDataFrame([("a b", 1.5, "yes"), (None, None, "no")], "k string, x double, c string")
    df = tables.typed(rows, ["k", "c"], ["x"]).select("k", "x", "c")
    assert files.c5_names(df, "c", class_first=True) == "no,yes.  | Target attribute\n\nk: a_b.\nx: continuous.\n"
    assert files.c5_names(df, "c") == "c.  | Target attribute\n\nk: a_b.\nx: continuous.\nc: no,yes.\n"
    assert sorted(r[0] for r in files.c5_rows(df, "c", True, True).collect()) == ["?, ?, no.", "a_b, 1.5, yes."]
    files.write_c5(df, str(tmp_path / "t"), "c")
    assert (tmp_path / "t.names").read_text().startswith("c.") and spark.read.text(str(tmp_path / "t.data")).count() == 2
    with pytest.raises(ValueError):
        files.c5_names(df, "x")


RULES = [
    Rule((Literal("a", EQ, "x<&>"), Literal("n", LE, 1.5)), Literal("c", EQ, "p"), 7, 3),
    Rule((Literal("a", NEQ, "y"), Literal("n", GT, -2)), Literal("c", EQ, "q"), 1, 0),
    Rule((), Literal("c", EQ, "p")),
]


def test_rule_texts():
    assert models.parse_rules(models.rules_xml(RULES, counts=True)) == RULES
    assert models.parse_rules(models.rules_xml(RULES)) == [Rule(r.body, r.head) for r in RULES]
    assert plain_text(RULES[0]) == "0.700000 10 a=x<&> & n<=1.5 => c=p"
    assert words(RULES[1], False, False) == "FROM\na<>y\nn>-2\nFOLLOWS\nc=q"
    assert words(RULES[0]) == "FROM\na=x<&>\nn<=1.5\nFOLLOWS\nc=p\n%(pos=7,neg=3)\n%(freq=10,Conf=0.700000)"
    assert html(RULES[0]) == "<p><font color=blue><b>FROM</b></font> a=x&lt;&amp;&gt;, n&lt;=1.5<br><font color=blue><b>FOLLOWS</b></font> c=p</p>"
    also = models.rules_xml(RULES).replace("lwreq", "lwr").replace("grt/", "grteq/")
    assert models.parse_rules(also) == [Rule(r.body, r.head) for r in RULES]
    for bad in ("<r><rule><body/></rule></r>", '<r><rule><body/><att type="d">a<zz/>b</att></rule></r>', '<r><rule><body/><att type="q">a<eq/>b</att></rule></r>', '<r><rule><body/><att type="c">a<eq/>b</att></rule></r>'):
        with pytest.raises(ValueError):
            models.parse_rules(bad)
    assert "[in.tab]" in models.induction_text(RULES, "in.tab", datetime(2024, 1, 2), 3.0)


def test_cluster_text(spark):
    df = tables.typed(spark.createDataFrame(F1, "A33 string, A34 string, A35 string").selectExpr("*", "rand(1) AS x"), NAMES, ["x"])
    model = cluster.k_means(df, 3, 3)
    again = models.parse_clusters(models.cluster_xml(model))
    assert again.attributes == model.attributes and again.clusters == model.clusters
    with pytest.raises(ValueError):
        models.parse_clusters(models.cluster_xml(model).replace("dev>", "no_dev>"))
    with pytest.raises(ValueError):
        models.parse_clusters(models.cluster_xml(model).replace("<values>", "<values>1.0 "))


def test_file_pipelines(spark, tmp_path):
    data = write(tmp_path / "d.tab", "A33(d)\tA34(d)\tA35(d)\n" + "\n".join("\t".join(r) for r in F1))
    made = write(tmp_path / "r.xml", models.rules_xml([Rule((Literal("A34", EQ, "1"),), Literal("A35", EQ, "D4"))]))
    result = pipelines.test_classifier(spark, made, data, str(tmp_path / "res.xml"))
    report = ET.fromstring((tmp_path / "res.xml").read_text())
    assert report.findtext("all_corr") == "17" == str(result.correct) and report.findtext("target_attr") == "A35" and len(report.find("matrix")) == 5
    pipelines.assign_classes(spark, data, made, str(tmp_path / "l.tab"), "out")
    assert files.load_table(spark, str(tmp_path / "l.tab")).filter("out = 'D4'").count() == 18
    pipelines.assign_votes(spark, data, made, str(tmp_path / "v.parquet"), "share")
    assert files.load_table(spark, str(tmp_path / "v.parquet")).selectExpr("sum(share)").first()[0] == 18
    pipelines.cluster_file(spark, data, str(tmp_path / "m.xml"), 10, 5)
    pipelines.assign_clusters(spark, data, str(tmp_path / "m.xml"), str(tmp_path / "k.tab"), "k")
    assert files.load_table(spark, str(tmp_path / "k.tab")).count() == 47
    grown = pipelines.induce_rules(spark, data, "A35", str(tmp_path / "f.xml"), induce.InductionParameters(5))
    assert models.parse_rules((tmp_path / "f.xml").read_text()) == [Rule(r.body, r.head) for r in grown] and (tmp_path / "f.xml.txt").exists()
    mixed = write(tmp_path / "two.xml", models.rules_xml([*RULES, Rule((), Literal("z", EQ, "1"))]))
    with pytest.raises(ValueError):
        pipelines.test_classifier(spark, mixed, data, str(tmp_path / "no.xml"))


def test_streams(spark, tmp_path):
    df = spark.createDataFrame(F1, "A33 string, A34 string, A35 string")
    df.write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    made = [Rule((Literal("A34", EQ, "1"),), Literal("A35", EQ, "D4"))]
    out = cluster_stream(label_stream(rows, made, "out"), cluster.k_means(df, 2, 2), "k")
    q = out.writeStream.format("memory").queryName("labelled_rows").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("labelled_rows").filter("out = 'D4'").count() == 18
    with pytest.raises(ValueError):
        label_stream(df, made, "out")
    assert classify.label(df, made, "out").count() == 47
