"""Queries on features, message passing, out-of-fold scores and cases, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import compose, models

from .adapters import Tables
from .catalogue import CONTAINS, FORMS, GOLD, LABELS, R, _solved, query, rounded

LAYER = {"contains": ([[0.5, -0.25], [0.125, 0.75]], [[0.25, 0.0], [0.0, -0.5]], [0.1, -0.2]), "within": ([[1.0, 0.5], [-0.5, 0.25]], [[0.0, 0.5], [0.5, 0.0]], [0.0, 0.3])}


def _sql_layer() -> str:
    rows = [(e, o, i, wn, ws) for e, (nb, own, _) in LAYER.items() for o, (a, b) in enumerate(zip(nb, own, strict=True)) for i, (wn, ws) in enumerate(zip(a, b, strict=True))]
    bias = [(e, o, b) for e, (_, _, bs) in LAYER.items() for o, b in enumerate(bs)]
    return f"w(etype, o, i, wn, ws) as (values {', '.join(map(str, rows))}), bias(etype, o, b) as (values {', '.join(map(str, bias))})"


@query(f"""with {_sql_layer()}, nodes as (select 'h' || s_suppkey id, 'herb' as type, 0 i, (s_suppkey % 7)::double v from supplier union all select 'h' || s_suppkey, 'herb', 1, (s_nationkey % 5)::double from supplier
      union all select 'c' || p_partkey, 'compound', 0, (p_size % 9)::double from part union all select 'c' || p_partkey, 'compound', 1, (p_partkey % 4)::double from part),
   e as (select distinct 'contains' etype, 'h' || l_suppkey src, 'c' || l_partkey dst from lineitem union all select distinct 'within', 'c' || l_partkey, 'h' || l_suppkey from lineitem),
   m as (select etype, dst id, i, avg(v) v from e join nodes on id = src group by 1, 2, 3), into_ as (select distinct etype, n.type from e join nodes n on n.id = e.dst),
   part as (select n.id, n.type, w.etype, w.o, sum(coalesce(w.wn * m.v, 0) + w.ws * n.v) v from nodes n join into_ using (type) join w on w.etype = into_.etype and w.i = n.i left join m on m.etype = w.etype and m.id = n.id and m.i = n.i group by all),
   s as (select id, o, sum(v + b) v from part join bias using (etype, o) group by 1, 2)
   select n.id, n.type, n.i, round(greatest(coalesce(s.v, 0) + n.v, 0), {R}) + 0.0::double v from nodes n left join s on s.id = n.id and s.o = n.i""")
def message_passing(t: Tables) -> DataFrame:
    herb, compound = (lambda c: F.concat(F.lit("h"), F.col(c).cast("string"))), (lambda c: F.concat(F.lit("c"), F.col(c).cast("string")))
    two = lambda a, b: F.array((F.expr(a)).cast("double"), (F.expr(b)).cast("double")).alias("x")
    nodes = t.supplier.select(herb("s_suppkey").alias("id"), F.lit("herb").alias("type"), two("s_suppkey % 7", "s_nationkey % 5"))
    nodes = nodes.unionByName(t.part.select(compound("p_partkey").alias("id"), F.lit("compound").alias("type"), two("p_size % 9", "p_partkey % 4")))
    pairs = t.contains().select(herb("src").alias("a"), compound("dst").alias("b"))
    edges = pairs.select(F.lit("contains").alias("etype"), F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(pairs.select(F.lit("within").alias("etype"), F.col("b").alias("src"), F.col("a").alias("dst")))
    out = models.message_passing(nodes, edges, LAYER).select("id", "type", F.posexplode("x").alias("i", "v"))
    return out.withColumn("v", F.round("v", R) + F.lit(0.0))


@query("""with e as (select distinct 'contains' etype, l_suppkey src, l_partkey dst from lineitem union all select distinct 'supplied', l_partkey, l_suppkey from lineitem where l_quantity > 40),
   tr as (select s_suppkey id from supplier where s_suppkey % 4 <> 0 union select p_partkey from part where p_partkey % 5 <> 0)
   select * from e where etype <> 'contains' or (src in (select id from tr) and dst in (select id from tr))""")
def inductive_subgraph(t: Tables) -> DataFrame:
    far = t.lineitem.where("l_quantity > 40").select(F.lit("supplied").alias("etype"), F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    edges = t.contains().select(F.lit("contains").alias("etype"), "src", "dst").unionByName(far)
    train = t.supplier.where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("id")).unionByName(t.part.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("id")))
    return models.inductive_edges(edges, train, ["contains"])


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(f"""with s(g, k) as (values {', '.join(f"('{g}', {i})" for i, g in enumerate(SEGMENTS))}), r as (select distinct c_nationkey d, c_mktsegment g, (c_nationkey * 5 + length(c_mktsegment)) % 3 k from customer),
   f as (select n_nationkey id, role, s.k, count(r.d) n from nation cross join s cross join (values (0), (1)) x(role) left join r on r.d = n_nationkey and r.g = s.g and r.k = role group by 1, 2, 3)
   select id, string_agg(case when n > 0 then '1' else '0' end, '' order by role, k) x from f group by 1""")
def leaky_flags(t: Tables) -> DataFrame:
    ids = t.nation.select(F.col("n_nationkey").alias("id"))
    out = models.leaky_features(ids, [t.roles(0), t.roles(1)], SEGMENTS)
    return out.select("id", F.array_join(F.transform("x", lambda v: v.cast("int").cast("string")), "").alias("x"))


OOF = """f as (select compound, (row_number() over (order by md5('0|' || compound), compound) - 1) % 5 fold from (select distinct compound from labels)),
   j as (select compound, drug, label, cast(fold as integer) fold from labels join f using (compound)), cnt as (select fold, drug, count(*) filter (label >= 0) n, count(*) filter (label = 1) p from j group by 1, 2),
   own as (select g.fold, drug, sum(p) p, sum(n) n from cnt join (select distinct fold from f) g on cnt.fold <> g.fold group by 1, 2), alls as (select fold, sum(p) p, sum(n) n from own group by 1),
   oof as (select compound, drug, j.fold, coalesce(own.p / nullif(own.n::double, 0), alls.p / nullif(alls.n::double, 0)) p from j join own using (fold, drug) join alls using (fold))"""


@query(f"with {LABELS}, {OOF} select compound, drug, fold, round(p, {R}) p from oof")
def out_of_fold_prior(t: Tables) -> DataFrame:
    return rounded(models.out_of_fold(t.labels_().select("compound", "drug", "label"), models.prior_learner()), "p")


@query(f"""with {LABELS}, {OOF}, {CONTAINS}, risk as (select herb, drug, round(avg(p), 12) risk, count(distinct compound) n_compounds from contains join oof using (compound) group by 1, 2),
   r as (select *, (rank() over (order by risk) + (count(*) over (partition by risk) - 1) / 2.0::double) / count(*) over () pct from risk), gold(herb, drug, gold_label) as (values {', '.join(map(str, GOLD))})
   select cast(gold.herb as bigint) herb, cast(gold.drug as integer) drug, gold_label, round(risk, {R}) risk, coalesce(n_compounds, 0) n_compounds, round(pct, {R}) pct from gold left join r using (herb, drug)""")
def herb_drug_model_scores(t: Tables) -> DataFrame:
    gold = t.spark.createDataFrame(GOLD, "herb long, drug int, gold_label int")
    return rounded(models.model_scores(models.out_of_fold(t.labels_().select("compound", "drug", "label"), models.prior_learner()), t.contains(), gold).fillna(0, ["n_compounds"]), "risk", "pct")


@query()
def out_of_fold_forest(t: Tables) -> DataFrame:
    """Out-of-fold scores of a small forest; a learned model has no SQL, a test holds its ranking against chance."""
    brands = t.part.select(F.col("p_partkey").alias("src"), F.col("p_brand").alias("dst"))
    compounds = models.compound_features(t.part.select(F.col("p_partkey").alias("id")), t.inhibits(), brands.where("dst like '%1'"))
    nations = t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").cast("string").alias("cls"))
    pairs = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("src"), (F.col("o_orderkey") % 25).cast("int").alias("dst"), F.col("o_orderpriority").alias("level"))
    drugs = models.drug_features(nations, t.roles(0), pairs, ["0", "1", "2", "3", "4"], ["1-URGENT", "2-HIGH"])
    return models.out_of_fold(t.labels_().select("compound", "drug", "label"), models.forest_learner(trees=5, depth=5), k=3, features=(compounds, drugs))


@query(f"""with k as (select distinct l_orderkey formulation, l_suppkey herb, seed from lineitem cross join range(3) s(seed)),
   e as (select *, -ln((cast('0x' || md5(seed || '|' || formulation || '|' || herb)[1:12] as bigint) + 0.5::double) / 281474976710656.0::double) e from k)
   select formulation, herb, cast(seed as integer) seed, round(e / sum(e) over (partition by formulation, seed), {R}) share from e""")
def random_shares(t: Tables) -> DataFrame:
    keys = t.lineitem.select(F.col("l_orderkey").alias("formulation"), F.col("l_suppkey").alias("herb"))
    return rounded(models.random_shares(keys, ["formulation"], "herb", 3), "share")


PICKS = [(1, 0, "first"), (2, 1, "second"), (3, 2, "third"), (3, 2, "again"), (10**9, 1, "none")]


@query(f"""with {FORMS}, picks(herb, drug, note) as (values {', '.join(map(str, PICKS))}), sized as (select *, count(*) over (partition by f, drug) n_in_scope from sol)
   select sized.herb, sized.drug, note, f formulation, n_in_scope, round(w0, {R}) share_before, round(w, {R}) share_after from sized join picks using (herb, drug)
   qualify row_number() over (partition by sized.herb, sized.drug, note order by n_in_scope desc, f) <= 3""")
def case_selection(t: Tables) -> DataFrame:
    picks = t.spark.createDataFrame(PICKS, "herb long, drug int, note string")
    return rounded(compose.select_cases(_solved(t), picks), "share_before", "share_after")
