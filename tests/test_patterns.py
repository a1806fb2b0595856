"""Scores of herbs by patterns of compounds against plain joins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import labels, models


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    contains = [(int(h), int(c)) for h, c in zip(rng.integers(0, 6, 80), rng.integers(0, 20, 80), strict=True)]
    own = [(c, d, int(rng.integers(-1, 2))) for c in range(20) for d in range(3) if rng.random() < 0.9]
    return spark.createDataFrame(contains + contains[:7], "src long, dst long").cache(), spark.createDataFrame(own + own[:5], "compound long, drug int, label int").cache()


def test_scores_by_pattern(data):
    contains, rows = data
    joined = contains.select(F.col("src").alias("herb"), F.col("dst").alias("compound")).join(rows, "compound")
    want = joined.groupBy("herb", "drug").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") >= 0).alias("l"), F.count_distinct("compound").alias("n"), F.avg("label").alias("r"))
    got = labels.herb_drug_scores(rows, contains).join(models.herb_drug_risk(rows.withColumnRenamed("label", "p"), contains).withColumnRenamed("n_compounds", "n2"), ["herb", "drug"])
    out = {(r["herb"], r["drug"]): (r["n_pos"], r["n_labelled"], r["n_compounds"], r["n2"], pytest.approx(r["risk"])) for r in got.collect()}
    assert {(r["herb"], r["drug"]): (r["p"], r["l"], r["n"], r["n"], r["r"]) for r in want.collect()} == out


def test_herbs_are_joined_with_patterns(data):
    """The join of a herb's compounds brings one row each, not one a drug: drugs come after the counts."""
    plan = labels.herb_drug_scores(data[1], data[0])._jdf.queryExecution().optimizedPlan().toString()
    assert "count(distinct" not in plan.lower() and plan.count("Generate inline") == 1
