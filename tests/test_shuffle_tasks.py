"""Tasks of a shuffle grow with the input, not with the session's setting alone."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import compose, models, records, shuffles
from graphloom.operators.retrieval import top_k
from graphloom.plans.adapters import Tables

SF = "/root/testdata/sf0.001"


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def dealt(df, key):
    """Tasks of each explicit repartition by a key in the plan."""
    return [int(n) for n in re.findall(rf"RepartitionByExpression \[{key}#\w+\], (\d+)", joins(df))]


def test_tasks_follow_the_bytes_of_files(spark, tmp_path, monkeypatch):
    spark.range(20000).select(F.col("id").alias("a"), F.rand(1).alias("b")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).where("a > 3").select("b")
    size = sum(p.stat().st_size for p in (tmp_path / "t").glob("*.parquet"))
    assert abs(shuffles.input_bytes(df) - size) < 100
    assert shuffles.tasks(df) == shuffles.tasks(spark.createDataFrame([(1,)], "a int")) == 4
    monkeypatch.setattr(shuffles, "BYTES", 10000)
    assert shuffles.tasks(df) == -(-shuffles.input_bytes(df) // 10000) > 4


def test_formulations_and_lines_are_dealt_by_input(spark, monkeypatch):
    monkeypatch.setattr(shuffles, "BYTES", 3000)
    t = Tables(spark, SF)
    rows = compose.formulation_rows(t.lineitem.select(F.col("l_orderkey").alias("formulation"), F.col("l_suppkey").alias("herb")), t.risk())
    assert min(dealt(rows, "formulation")) > 4
    assert min(dealt(rows, "l_orderkey")) > 4
    assert min(dealt(compose.direction_rows(rows), "herb")) > 4
    plain = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    counts = lambda df: sorted(map(tuple, df.groupBy("l_suppkey", "c_nationkey").count().collect()))
    assert counts(t.lines()) == counts(plain)


@pytest.mark.parametrize("each", [2**22, 3000])
def test_solutions_do_not_depend_on_tasks(spark, monkeypatch, each):
    monkeypatch.setattr(shuffles, "BYTES", each)
    t = Tables(spark, SF)
    rows = compose.formulation_rows(t.lineitem.select(F.col("l_orderkey").alias("formulation"), F.col("l_suppkey").alias("herb")), t.risk())
    got = compose.scenario_rows(rows.withColumn("cells", F.transform("cells", lambda c: F.struct(c["drug"].alias("drug"), c["risk"].alias("risk"), c["risk"].alias("other")))))
    r = got.agg(F.count("*").alias("n"), F.sum(F.col("value")).alias("v"), F.sum("n_herbs").alias("h")).first()
    monkeypatch.setattr(shuffles, "BYTES", 2**30)
    want = compose.solved_rows(rows).agg(F.count_distinct("formulation", "drug").alias("n"), F.sum(F.col("w") * F.col("risk")).alias("v"), F.count("*").alias("h")).first()
    assert (r["n"], r["h"], round(r["v"], 6)) == (want["n"], want["h"], round(want["v"], 6))


def test_records_are_dealt_by_input(spark, monkeypatch):
    from graphloom.plans import studies

    monkeypatch.setattr(shuffles, "BYTES", 3000)
    assert min(dealt(studies._records(Tables(spark, SF)), "formulation")) > 4


def test_messages_are_dealt_by_input_and_not_multiplied(spark, tmp_path, monkeypatch):
    nodes = [("a", "herb", [1.0, 2.0]), ("b", "herb", [3.0, 4.0]), ("c", "herb", None), ("d", "compound", [0.0, 1.0]), ("e", "compound", [5.0, 5.0]), ("f", "compound", [1.0, 1.0])]
    edges = [("r", "a", "d"), ("r", "b", "d"), ("r", "c", "e"), ("r", "zz", "e"), ("r", "a", "zz"), ("s", "d", "a"), ("other", "d", "b")]
    spark.createDataFrame(nodes, "id string, type string, x array<double>").write.parquet(str(tmp_path / "nodes"))
    spark.createDataFrame(edges, "etype string, src string, dst string").write.parquet(str(tmp_path / "edges"))
    monkeypatch.setattr(shuffles, "BYTES", 100)
    eye = [[1.0, 0.0], [0.0, 1.0]]
    got = models.message_passing(spark.read.parquet(str(tmp_path / "nodes")), spark.read.parquet(str(tmp_path / "edges")), {"r": (eye, eye, [0.5, 0.0]), "s": (eye, eye, [0.0, 0.0])})
    assert min(dealt(got, "src")) > 4 and "posexplode" not in joins(got)
    rows = {r["id"]: r["x"] for r in got.collect()}
    assert rows["a"] == [1 + 1 + 0, 2 + 2 + 1] and rows["b"] == [6.0, 8.0]  # b has no message, but its type has
    assert rows["d"] == [2.0 + 0.5, 3.0 + 1 + 1] and rows["e"] == [10.5, 10.0] and rows["f"] == [2.5, 2.0]


def test_scores_reach_herbs_as_lists(spark):
    rng = np.random.default_rng(5)
    contains = spark.createDataFrame([(int(h), int(c)) for h in range(5) for c in rng.integers(0, 30, 25)], "herb int, compound int")
    predicted = spark.createDataFrame([(c, d, None if rng.random() < 0.1 else float(rng.integers(0, 3))) for c in range(30) for d in range(4) if rng.random() < 0.8], "compound int, drug int, p double")
    none = spark.createDataFrame([], "compound int, drug int, label int, enzymes string")
    got = records.explain_pairs(contains, predicted, none, spark.createDataFrame([], "compound int, enzyme string, source string"), spark.createDataFrame([], "drug int, enzyme string, source string"))
    assert dealt(got, "herb")
    want = top_k(contains.distinct().join(predicted, "compound"), ["herb", "drug"], [F.desc("p"), F.col("compound")], 5)
    rows = lambda df: sorted(map(repr, df.select("herb", "drug", "rank", "compound", "p").collect()))
    assert rows(got) == rows(want)


def test_folds_read_kept_pairs(spark):
    pairs = spark.createDataFrame([(c, d, (c + d) % 3 - 1) for c in range(20) for d in range(3)], "compound int, drug int, label int")
    compounds = spark.createDataFrame([(c, [float(c), 1.0]) for c in range(19)], "id int, x array<double>")
    drugs = spark.createDataFrame([(d, [float(d)]) for d in range(3)], "id int, x array<double>")
    learner = lambda train, test: test.crossJoin(train.agg(F.sum(F.col("x")[0] * F.col("label")).alias("t"))).withColumn("p", F.col("t") + F.col("x")[0] * 10 + F.col("x")[2])
    late = models.out_of_fold(pairs, learner, k=3, features=(compounds, drugs))
    assert joins(late).count("InMemoryRelation") >= 3
    folds = {r["compound"]: r["fold"] for r in late.collect()}
    rows = {(r["compound"], r["drug"]): r["p"] for r in late.collect()}
    assert len(rows) == 57 == late.count()  # compound 19 has no features
    for (c, d), p in rows.items():
        assert p == sum(a * ((a + b) % 3 - 1) for a in range(19) for b in range(3) if folds[a] != folds[c] and (a + b) % 3) + 10 * c + d
