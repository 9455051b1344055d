"""From files to files: testing a rule list, labelling with one, and clustering."""

from __future__ import annotations

import logging
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from marlstone.operators import classify, cluster
from marlstone.operators.classify import Evaluation
from marlstone.operators.cluster import ClusterModel
from marlstone.operators.induce import InductionParameters, grow_rules
from marlstone.operators.rules import Rule, unknown_values
from marlstone.sources import models
from marlstone.sources.files import read_text, write_text
from marlstone.sources.tables import load_table, save_table

log = logging.getLogger("marlstone")


def _rules(spark: SparkSession, path: str) -> list[Rule]:
    rules = models.parse_rules(read_text(spark, path))
    if not rules:
        raise ValueError(f"{path} has no rules")
    return rules


def test_classifier(spark: SparkSession, rules_file: str, data_file: str, out_file: str) -> Evaluation:
    """Evaluates a rule list on a table and writes the report; all rules must be for one column."""
    rules, data = _rules(spark, rules_file), load_table(spark, data_file)
    if len({r.head.attr for r in rules}) != 1:
        raise ValueError("the rules must be for one target")
    for x in unknown_values(data, rules):
        log.warning("no row has the value of %s", x)
    target = rules[0].head.attr
    result = classify.evaluate(data, rules, target)
    write_text(spark, out_file, models.results_xml(result, target, rules_file, data_file, datetime.now(UTC)))
    return result


def assign_classes(spark: SparkSession, data_file: str, rules_file: str, out_file: str, name: str) -> None:
    """Writes a table with the predicted class in a new column."""
    save_table(classify.label(load_table(spark, data_file), _rules(spark, rules_file), name), out_file)


def assign_votes(spark: SparkSession, data_file: str, rules_file: str, out_file: str, name: str) -> None:
    """Writes a table with the share of rules that cover a row in a new column."""
    save_table(classify.vote(load_table(spark, data_file), _rules(spark, rules_file), name), out_file)


def cluster_file(spark: SparkSession, data_file: str, out_file: str, iterations: int = 10, k: int = 5, seed: int = 42) -> ClusterModel:
    """Clusters a table and writes the model."""
    model = cluster.k_means(load_table(spark, data_file), k, iterations, seed=seed)
    write_text(spark, out_file, models.cluster_xml(model))
    log.info("%d iterations, rows moved: %s", model.iterations, model.log)
    return model


def assign_clusters(spark: SparkSession, data_file: str, model_file: str, out_file: str, name: str) -> None:
    """Writes a table with the nearest cluster of a written model in a new column."""
    save_table(cluster.assign(load_table(spark, data_file), models.parse_clusters(read_text(spark, model_file)), name), out_file)


def induce_rules(spark: SparkSession, data_file: str, target: str, out_file: str, p: InductionParameters = InductionParameters()) -> list[Rule]:
    """Grows rules for a table's column and writes them as a rule list, and as text beside it."""
    began = datetime.now(UTC)
    rules = grow_rules(load_table(spark, data_file), target, p)
    write_text(spark, out_file, models.rules_xml(rules, models.GROWN))
    write_text(spark, f"{out_file}.txt", models.induction_text(rules, data_file, began, (datetime.now(UTC) - began).total_seconds()))
    return rules
