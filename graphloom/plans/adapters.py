"""The driver's tables in the shape of the domain: suppliers as herbs, parts as compounds, nations as drugs, segments as enzymes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import shuffles


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def contains_rows(self) -> DataFrame:
        return self.lineitem.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("part"), F.col("l_orderkey").alias("reference"))

    def contains(self) -> DataFrame:
        return self.contains_rows().select("src", "dst").repartition(shuffles.tasks(self.lineitem), "src", "dst").distinct()

    def compounds(self) -> DataFrame:
        return self.part.select(F.col("p_partkey").alias("compound"), (F.col("p_size") > 5).alias("ok"))

    def drugs(self) -> DataFrame:
        return self.nation.select(F.col("n_nationkey").alias("drug"))

    def lines(self) -> DataFrame:
        """lineitem with its order and customer; orders meet customers first, so that lines are shuffled once."""
        n = shuffles.tasks(self.lineitem, self.orders)
        owned = self.orders.repartition(n, "o_custkey").join(self.customer, F.col("o_custkey") == F.col("c_custkey"))
        return self.lineitem.repartition(n, "l_orderkey").join(owned, F.col("l_orderkey") == F.col("o_orderkey"))

    def inhibits(self) -> DataFrame:
        lines = self.lines().where("l_discount >= 0.09")
        return lines.groupBy(F.col("l_partkey").alias("src"), F.col("c_mktsegment").alias("dst")).count().where("count >= 3").select("src", "dst")

    def roles(self, k: int) -> DataFrame:
        """Segments a nation is a substrate (0) or not a substrate (1) of."""
        rows = self.customer.select(F.col("c_nationkey").alias("src"), F.col("c_mktsegment").alias("dst")).distinct()
        return rows.where((F.col("src") * 5 + F.length("dst")) % 3 == k)

    def labels_(self) -> DataFrame:
        from graphloom.operators.labels import silver_labels

        return silver_labels(self.compounds(), self.drugs(), self.inhibits(), self.roles(0), self.roles(1))

    def risk(self) -> DataFrame:
        """herb, drug, risk: mean discount of a supplier's lines that a nation's customers ordered, to nine places."""
        return self.lines().groupBy(F.col("l_suppkey").alias("herb"), F.col("c_nationkey").alias("drug")).agg((F.sum(F.round(F.col("l_discount") * 100).cast("long")) / (F.count("*") * 100)).alias("risk"))
