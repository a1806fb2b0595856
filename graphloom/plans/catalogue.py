"""Queries over the driver's tables and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import metrics, text
from graphloom.operators import compose, graph, labels, retrieval, shuffles, triples
from graphloom.sources import files
from graphloom.streaming import log

from .adapters import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str = ""):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


R = 9  # digits that both sides round to
LINES = "lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey"
INH = f"inh as (select l_partkey c, c_mktsegment g from {LINES} where l_discount >= 0.09 group by 1, 2 having count(*) >= 3)"
ST = "st as (select distinct c_nationkey d, c_mktsegment g, (c_nationkey * 5 + length(c_mktsegment)) % 3 k from customer)"
LABELS = f"""{INH}, {ST}, base as (select p_partkey c, p_size > 5 ok, n_nationkey d from part cross join nation),
 e as (select base.c, base.d, ok, string_agg(inh.g, ';' order by inh.g) filter (st.k = 0) hits,
              string_agg(inh.g, ';' order by inh.g) filter (inh.g is not null and coalesce(st.k, 2) = 2) unk
       from base left join inh using (c) left join st on st.d = base.d and st.g = inh.g group by 1, 2, 3),
 labels as (select c compound, d drug, cast(case when not ok then -1 when hits is not null then 1 when unk is not null then -1 else 0 end as integer) label,
                   case when not ok then '' else coalesce(hits, unk, '') end enzymes from e)"""
CONTAINS = "contains as (select distinct l_suppkey herb, l_partkey compound from lineitem)"
SCORES = f"""{LABELS}, {CONTAINS}, scores as (select herb, drug, count(*) filter (label = 1) n_pos, count(*) filter (label >= 0) n_labelled,
 count(distinct compound) n_compounds, count(*) filter (label = 1) / nullif(cast(count(*) filter (label >= 0) as double), 0) frac_pos
 from contains join labels using (compound) group by 1, 2)"""
RISK = f"risk as (select l_suppkey herb, c_nationkey drug, sum(cast(round(l_discount * 100) as bigint)) / (count(*) * 100.0::double) risk from {LINES} group by 1, 2)"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, R) for c in columns})


@query("""select l_suppkey src, l_partkey dst, string_agg(distinct l_returnflag, '; ' order by l_returnflag) parts, count(distinct l_orderkey) n_refs
          from lineitem group by 1, 2""")
def contains_edges(t: Tables) -> DataFrame:
    return graph.contains_edges(t.contains_rows())


@query("""with u as (select c_nationkey src, c_mktsegment dst, 'customer' source from customer union all
          select c_nationkey, c_mktsegment, 'order ' || o_orderstatus from orders join customer on o_custkey = c_custkey)
          select src, dst, string_agg(distinct source, '; ' order by source) source from u group by 1, 2""")
def merged_edge_sources(t: Tables) -> DataFrame:
    a = t.customer.select(F.col("c_nationkey").alias("src"), F.col("c_mktsegment").alias("dst"), F.lit("customer").alias("source"))
    b = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("src"), F.col("c_mktsegment").alias("dst"), F.concat(F.lit("order "), "o_orderstatus").alias("source"))
    return graph.merge_edge_sources(a, b)


PRIORITY = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]


@query("""with p as (select s_nationkey a, c_nationkey b, o_orderpriority level from lineitem join orders on l_orderkey = o_orderkey
          join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey where s_nationkey <> c_nationkey)
          select least(a, b) src, greatest(a, b) dst, min(level) as level from p group by 1, 2""")
def ddi_worst_level(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return graph.worst_level_pairs(rows.select(F.col("s_nationkey").alias("a"), F.col("c_nationkey").alias("b"), F.col("o_orderpriority").alias("level")), PRIORITY)


@query("""with a as (select c_custkey id, upper(trim(x)) alias from (select c_custkey, unnest([c_name, c_mktsegment]) x from customer) where trim(x) <> '')
          select alias, min(id) id from a group by 1 having count(distinct id) = 1""")
def alias_map_unambiguous(t: Tables) -> DataFrame:
    return graph.alias_map(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.array("c_mktsegment").alias("aliases")))


@query("""with n as (select 'herb' as type, 'k' || s_suppkey id from supplier union all select 'compound', 'k' || p_partkey from part where p_size > 2),
          e as (select distinct 'contains' etype, 'k' || l_suppkey src, 'k' || l_partkey dst from lineitem union all select distinct 'odd', 'k' || l_suppkey, 'x' from lineitem where l_linenumber = 1),
          h as (select distinct id, type found from n),
          s as (select e.*, found from e left join h on src = id where etype = 'contains'), d as (select e.*, found from e left join h on dst = id where etype = 'contains')
          select 'id in two types' problem, id subject from n group by 2 having count(distinct type) > 1 union all
          select 'unknown edge type', etype from e where etype = 'odd' group by 2 union all
          select 'dangling src', src || '->' || dst from s where found is null union all select 'src type mismatch', src || '->' || dst from s where found <> 'herb' union all
          select 'dangling dst', src || '->' || dst from d where found is null union all select 'dst type mismatch', src || '->' || dst from d where found <> 'compound'""")
def node_edge_validation(t: Tables) -> DataFrame:
    key = lambda c: F.concat(F.lit("k"), F.col(c).cast("string"))
    nodes = t.supplier.select(F.lit("herb").alias("type"), key("s_suppkey").alias("id")).unionByName(t.part.where("p_size > 2").select(F.lit("compound").alias("type"), key("p_partkey").alias("id")))
    edges = t.lineitem.select(F.lit("contains").alias("etype"), key("l_suppkey").alias("src"), key("l_partkey").alias("dst")).distinct()
    odd = t.lineitem.where("l_linenumber = 1").select(F.lit("odd").alias("etype"), key("l_suppkey").alias("src"), F.lit("x").alias("dst")).distinct()
    return graph.check_nodes(nodes).unionByName(graph.check_edges(nodes, edges.unionByName(odd)))


@query(f"with {LABELS} select compound, drug, label, enzymes from labels")
def silver_labels(t: Tables) -> DataFrame:
    return t.labels_()


@query(f"""with {ST} select d drug, g gene from st where k = 0 intersect select c_nationkey, c_mktsegment from customer where c_acctbal < 0""")
def label_conflicts(t: Tables) -> DataFrame:
    non = t.customer.where("c_acctbal < 0").select(F.col("c_nationkey").alias("src"), F.col("c_mktsegment").alias("dst"))
    return labels.label_conflicts(t.roles(0), non)


@query(f"with {SCORES} select herb, drug, n_pos, n_labelled, n_compounds, round(frac_pos, {R}) frac_pos from scores")
def herb_drug_scores(t: Tables) -> DataFrame:
    return rounded(labels.herb_drug_scores(t.labels_(), t.contains()), "frac_pos")


@query(f"""with {SCORES} select herb, drug, round(frac_pos, {R}) frac_pos,
   round((rank() over (order by frac_pos) + (count(*) over (partition by frac_pos) - 1) / 2.0::double) / count(*) over (), {R}) pct,
   round(cume_dist() over (partition by drug order by frac_pos), {R}) within_drug from scores where n_labelled > 0""")
def herb_drug_percentile(t: Tables) -> DataFrame:
    scored = labels.herb_drug_scores(t.labels_(), t.contains()).where("n_labelled > 0").select("herb", "drug", "frac_pos")
    out = labels.with_percentiles(labels.with_percentiles(scored, "frac_pos", "pct"), "frac_pos", at_most="within_drug", by=["drug"])
    return rounded(out.select("herb", "drug", "frac_pos", "pct", "within_drug"), "frac_pos", "pct", "within_drug")


GOLD = [(1, 3, 1), (2, 7, 0), (5, 11, 1), (9, 24, 0), (10**9, 1, 1)]


@query(f"""with {SCORES}, gold(herb, drug, gold_label) as (values {', '.join(map(str, GOLD))}),
   r as (select herb, drug, frac_pos, (rank() over (order by frac_pos) + (count(*) over (partition by frac_pos) - 1) / 2.0::double) / count(*) over () pct from scores where n_labelled > 0)
   select cast(gold.herb as bigint) herb, cast(gold.drug as integer) drug, gold_label, round(frac_pos, {R}) frac_pos, round(pct, {R}) pct from gold left join r using (herb, drug)""")
def gold_vs_silver(t: Tables) -> DataFrame:
    gold = t.spark.createDataFrame(GOLD, "herb long, drug int, gold_label int")
    return rounded(labels.gold_vs_silver(gold, labels.herb_drug_scores(t.labels_(), t.contains())), "frac_pos", "pct")


EDGES = """edges as (select 'modulates' etype, p_partkey src, c_mktsegment dst from part join customer on p_partkey = c_custkey union all
   select 'substrate_of', c_custkey, c_mktsegment from customer union all select 'contains', s_suppkey, s_name from supplier)"""


@query(f"with {EDGES} select * from edges where etype = 'contains' or (etype = 'modulates' and dst not in ('BUILDING', 'MACHINERY'))")
def masked_edges(t: Tables) -> DataFrame:
    key = t.customer.select(F.col("c_custkey").alias("src"), F.col("c_mktsegment").alias("dst"))
    edges = t.part.select(F.lit("modulates").alias("etype"), F.col("p_partkey").alias("src")).join(key, "src").select("etype", "src", "dst")
    edges = edges.unionByName(key.select(F.lit("substrate_of").alias("etype"), "src", "dst")).unionByName(t.supplier.select(F.lit("contains").alias("etype"), F.col("s_suppkey").alias("src"), F.col("s_name").alias("dst")))
    return labels.mask_label_edges(edges, ["BUILDING", "MACHINERY"])


@query("select p_partkey id, cast((row_number() over (order by md5('0|' || p_partkey), p_partkey) - 1) % 5 as integer) fold from part")
def cold_folds(t: Tables) -> DataFrame:
    return labels.assign_folds(t.part.select(F.col("p_partkey").alias("id")))


@query("""with h as (select distinct l_suppkey s, l_partkey compound from lineitem)
   select compound, case when bool_and(s % 4 = 0) then 'test' when bool_or(s % 4 = 0) then 'shared' else 'train' end as role from h group by 1""")
def cold_herb_holdout(t: Tables) -> DataFrame:
    return labels.herb_holdout(t.contains(), t.supplier.where("s_suppkey % 4 = 0").select(F.col("s_suppkey").alias("herb")))


@query("""with p as (select distinct l_suppkey || '-' || l_partkey id from lineitem)
   select id, cast((row_number() over (order by md5('0|' || id), id) - 1) % 5 as integer) fold from p""")
def random_pair_folds(t: Tables) -> DataFrame:
    return labels.assign_folds(t.contains().select(F.concat_ws("-", F.col("src").cast("string"), F.col("dst").cast("string")).alias("id")))


@query("""with f as (select id, (row_number() over (order by md5('0|' || id), id) - 1) % 5 fold from (select distinct l_suppkey id from lineitem)),
   m as (select distinct l_partkey compound, fold from lineitem join f on l_suppkey = id), n as (select compound, count(*) k from m group by 1),
   r as (select cast(g.fold as integer) fold, case when m.fold is null then 'train' when k = 1 then 'test' else 'shared' end as role from n cross join range(5) g(fold) left join m on m.compound = n.compound and m.fold = g.fold)
   select fold, role, count(*) n from r group by 1, 2""")
def fold_stats(t: Tables) -> DataFrame:
    return labels.herb_group_folds(t.contains()).groupBy("fold", "role").agg(F.count("*").alias("n"))


LABELLED = "rows_ as (select doc_id, quality y, cast(n_chars as double) p, lang, source from documents join labels using (doc_id))"
CURVE = """c as (select {by} p, sum(y)::double pos, count(*)::double n from rows_ group by all),
   w as (select *, sum(pos) over (partition by {part} order by p desc) tp, sum(n) over (partition by {part} order by p desc) seen from c),
   m as (select {by} sum((n - pos) * (tp - pos / 2)) / nullif(sum(pos) * sum(n - pos), 0) auroc,
                case when sum(n - pos) > 0 then sum(pos * tp / seen) / nullif(sum(pos), 0) end auprc, sum(n)::bigint n, sum(pos)::bigint n_pos from w group by all)"""


def _labelled(t: Tables) -> DataFrame:
    return t.documents.join(t.__getattr__("labels"), "doc_id").select("doc_id", F.col("quality").alias("label"), F.col("n_chars").cast("double").alias("p"), "lang", "source")


@query(f"with {LABELLED}, {CURVE.format(by='lang,', part='lang')} select lang, round(auroc, {R}) auroc, round(auprc, {R}) auprc, n, n_pos from m")
def auroc_auprc(t: Tables) -> DataFrame:
    return rounded(metrics.ranking_metrics(_labelled(t), ["lang"]), "auroc", "auprc")


@query(f"with {LABELLED}, {CURVE.format(by='source,', part='source')} select round(avg(auroc), {R}) auroc, count(auroc) n_groups from m")
def grouped_auroc(t: Tables) -> DataFrame:
    return rounded(metrics.grouped_auroc(_labelled(t), "source"), "auroc")


@query(f"with {LABELLED} select round(avg(y), {R}) \"precision\", count(*) k from (select * from rows_ order by p desc, doc_id limit 100)")
def precision_at_k(t: Tables) -> DataFrame:
    return rounded(metrics.precision_at_k(_labelled(t), 100, "doc_id"), "precision")


@query(f"""with {LABELLED}, tr as (select * from rows_ where doc_id % 5 <> 0), r as (select source, avg(y) rate from tr group by 1)
   select doc_id, source, y as label, round(coalesce(rate, (select avg(y) from tr)), {R}) p from rows_ left join r using (source) where doc_id % 5 = 0""")
def prior_model(t: Tables) -> DataFrame:
    rows = _labelled(t).select("doc_id", "source", "label")
    return rounded(labels.prior_scores(rows.where("doc_id % 5 <> 0"), rows.where("doc_id % 5 = 0"), "source"), "p")


@query(f"""with r as (select l_returnflag, l_linenumber fold, l_linestatus, avg(l_quantity) auroc from lineitem group by all),
   f as (select l_returnflag, fold, avg(auroc) v from r group by all)
   select l_returnflag, round(avg(v), {R}) mean, round(stddev_samp(v), 6) std, round(min(v), {R}) least, round(max(v), {R}) most, count(distinct fold) n_folds from f group by 1""")
def seed_fold_summary(t: Tables) -> DataFrame:
    runs = t.lineitem.groupBy("l_returnflag", F.col("l_linenumber").alias("fold"), "l_linestatus").agg(F.avg("l_quantity").alias("auroc"))
    return rounded(metrics.fold_summary(runs, ["l_returnflag"]), "mean", "least", "most").withColumn("std", F.round("std", 6))


@query("""with e as (select distinct l_suppkey src, p_brand g from lineitem join part on l_partkey = p_partkey),
   top as (select g, row_number() over (order by count(*) desc, g) k from e group by g qualify k <= 8)
   select s_suppkey id, string_agg(case when e.src is null then '0' else '1' end, '' order by k) hot from supplier cross join top left join e on e.src = s_suppkey and e.g = top.g group by 1""")
def multi_hot_top_genes(t: Tables) -> DataFrame:
    edges = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("id"), F.col("p_brand").alias("gene")).distinct()
    top = edges.groupBy("gene").count().orderBy(F.desc("count"), "gene").limit(8)
    order = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "gene"))).alias("top"))
    own = edges.join(F.broadcast(top.select("gene")), "gene").groupBy("id").agg(F.collect_set("gene").alias("own"))
    hot = F.array_join(F.transform("top.gene", lambda g: F.when(F.array_contains(F.coalesce("own", F.array().cast("array<string>")), g), "1").otherwise("0")), "")
    return t.supplier.select(F.col("s_suppkey").alias("id")).join(own, "id", "left").crossJoin(F.broadcast(order)).select("id", hot.alias("hot"))


@query("""with p as (select distinct s_nationkey a, c_nationkey b, o_orderpriority level from lineitem join orders on l_orderkey = o_orderkey
   join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey where s_nationkey <> c_nationkey),
   d as (select least(a, b) a, greatest(a, b) b, min(level) as level from p group by all), e as (select a id, level from d union all select b, level from d)
   select id, count(*) filter (level = '1-URGENT') urgent, count(*) filter (level <> '1-URGENT') other, count(*) total from e group by 1""")
def ddi_profile(t: Tables) -> DataFrame:
    pairs = ddi_worst_level(t)
    both = pairs.select(F.col("src").alias("id"), "level").unionByName(pairs.select(F.col("dst").alias("id"), "level"))
    return both.groupBy("id").agg(F.count_if(F.col("level") == "1-URGENT").alias("urgent"), F.count_if(F.col("level") != "1-URGENT").alias("other"), F.count("*").alias("total"))


COS = """s as (select q.vec_id question, v.vec_id id, v.label, q.label qlabel, round(list_cosine_similarity(list_transform(q.embedding, lambda x: x::double), list_transform(v.embedding, lambda x: x::double)), 9) score
   from embeddings q join embeddings v on q.vec_id < 20), r as (select *, cast(row_number() over (partition by question order by score desc, id) as integer) as "rank" from s)"""


def _cosine(t: Tables, k: int) -> DataFrame:
    v = t.embeddings
    return retrieval.cosine_top_k(v.where("vec_id < 20").select(F.col("vec_id").alias("question"), F.col("embedding").alias("q")), v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), k)


@query(f'with {COS} select question, id, score, "rank" from r where "rank" <= 10')
def cosine_topk(t: Tables) -> DataFrame:
    return _cosine(t, 10)


@query(f"""with {COS}, b as (select question, id, "rank" from r where "rank" <= 20 union all
   select question, id, cast(row_number() over (partition by question order by id) as integer) from r where "rank" <= 20 and id % 2 = 0)
   select question, id, round(sum(1.0::double / (60 + "rank")), {R}) score from b group by 1, 2""")
def rrf_fusion(t: Tables) -> DataFrame:
    dense = _cosine(t, 20)
    other = retrieval.top_k(dense.where("id % 2 = 0").select("question", "id"), ["question"], [F.col("id")], 20)
    return rounded(retrieval.reciprocal_rank_fusion([dense, other]), "score")


@query(f"""with {COS}, b as (select question, min(case when label = qlabel and id <> question and "rank" <= 10 then "rank" end) best from r group by 1)
   select round(avg(case when best <= 5 then 1.0::double else 0 end), {R}) recall_5, round(avg(case when best <= 10 then 1.0::double else 0 end), {R}) recall_10, round(avg(coalesce(1.0::double / best, 0)), {R}) mrr, count(*) n from b""")
def recall_mrr(t: Tables) -> DataFrame:
    v = t.embeddings.select("vec_id", "label")
    q = v.where("vec_id < 20").select(F.col("vec_id").alias("question"), "label")
    gold = q.join(v.select(F.col("vec_id").alias("id"), "label"), "label").where("id <> question").select("question", "id")
    return rounded(metrics.recall_and_mrr(_cosine(t, 10), gold), "recall_5", "recall_10", "mrr")


LEXICON = [("the", "herb:the"), ("with", "herb:with"), ("and", "dosha:and"), ("from", "dosha:from"), ("under", "condition:under"), ("of", "herb:of"), ("for", "herb:for"), ("for", "dosha:for")]
MENTIONS = f"""lex(surface, entity) as (values {', '.join(map(str, LEXICON))}),
   ok as (select surface, min(entity) entity from lex where length(surface) >= 3 group by 1 having count(distinct entity) = 1),
   w as (select doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) surface, unnest(range(len(string_split_regex(lower(text), '[^a-z0-9]+')))) place from documents),
   m as (select doc_id, entity, cast(min(place) as integer) "first" from w join ok using (surface) group by 1, 2)"""


def _mentions(t: Tables) -> DataFrame:
    return retrieval.mentions(t.documents.select("doc_id", "text"), t.spark.createDataFrame(LEXICON, "surface string, entity string"))


@query(f'with {MENTIONS} select doc_id, entity, "first" from m')
def entity_mentions(t: Tables) -> DataFrame:
    return _mentions(t)


@query(f"with {MENTIONS} select a.entity a, b.entity b, count(distinct doc_id) n from m a join m b using (doc_id) where a.entity like 'herb:%' and b.entity not like 'herb:%' and b.entity like 'dosha:%' group by 1, 2 having count(distinct doc_id) >= 2")
def cooccurrence(t: Tables) -> DataFrame:
    return retrieval.cooccurrence(_mentions(t), "herb:", "dosha:")


GRAPH = """e as (select s_nationkey a, c_nationkey b, 'co-mentioned' relation, o_orderkey % 97 chunk from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
   union all select s_nationkey, c_nationkey, o_orderpriority, o_orderkey % 97 from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey where l_quantity > 45),
   g as (select a, b, relation, count(distinct chunk) weight from e group by all),
   n as (select a entity, b other, a, b, relation, weight from g union all select b, a, a, b, relation, weight from g where a <> b)"""


@query(f"""with {GRAPH} select entity, other, relation, weight, cast(row_number() over (partition by entity order by weight desc, relation = 'co-mentioned', a, b, relation) as integer) place from n""")
def text_graph_neighbors(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.select(F.col("s_nationkey").alias("a"), F.col("c_nationkey").alias("b"), F.col("o_orderpriority").alias("relation"), (F.col("o_orderkey") % 97).alias("chunk"), "l_quantity")
    return retrieval.neighbours(retrieval.text_graph(rows, rows.where("l_quantity > 45")))


@query(f"""with {RISK} select herb, drug, round(risk, {R}) risk, cast(k as integer) "rank"
   from (select *, row_number() over (partition by herb order by round(risk, {R}) desc, drug) k from risk) where k <= 3""")
def topk_facts(t: Tables) -> DataFrame:
    return retrieval.top_facts(rounded(t.risk(), "risk"), "herb", "drug").select("herb", "drug", "risk", "rank")


@query(f"with {RISK} select herb, round(risk, {R}) risk from risk where drug = 3 order by round(risk, {R}) desc, herb limit 10")
def risk_ranking(t: Tables) -> DataFrame:
    return rounded(t.risk(), "risk").where("drug = 3").orderBy(F.desc("risk"), "herb").limit(10).select("herb", "risk")


@query(f"""with {RISK}, k as (select *, row_number() over (partition by herb order by round(risk, {R}) desc, drug) k from risk)
   select herb, 'Which drugs does herb ' || herb || ' affect most?' question, string_agg(drug, '; ' order by k) gold from k where k <= 3 group by 1, 2""")
def kg_questions(t: Tables) -> DataFrame:
    top = retrieval.top_facts(rounded(t.risk(), "risk"), "herb", "drug")
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("drug").cast("string").alias("d")))), lambda x: x["d"]), "; ")
    return top.groupBy("herb").agg(names.alias("gold")).select("herb", F.concat(F.lit("Which drugs does herb "), F.col("herb").cast("string"), F.lit(" affect most?")).alias("question"), "gold")


@query("""select doc_id, len(list_filter(string_split_regex(text, '\\n\\s*\\n'), lambda p: len(list_filter(string_split_regex(trim(p), '\\s+'), lambda w: w <> '')) >= 5)) n from documents""")
def paragraph_filter(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(text.paragraphs(F.col("text"))).cast("long").alias("n"))


@query(r"""with l as (select doc_id, unnest(string_split(text, chr(10))) line from documents),
   w as (select doc_id, list_filter(string_split_regex(line, '[ \t\n\v\f\r]+'), lambda x: x <> '') ws from l)
   select doc_id, count(*) n_lines, count(*) filter (len(ws) > 0 and len(list_filter(ws, lambda t: not regexp_full_match(t, '[A-Za-z0-9.,;:()''\-—"’“”\[\]?!]+')
     or regexp_matches(t, '[a-z][A-Z]') or (length(t) >= 3 and not regexp_matches(t, '[aeiouyAEIOUY]')))) >= 0.3::double * len(ws)) n_bad from w group by 1""")
def line_quality(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(text.garbage_line(F.col("line"))).alias("n_bad"))


@query("""select o_orderkey id, case o_orderkey % 4 when 0 then 'G1,G2,G3,P7' when 1 then 'P2,K3,K4' when 2 then 'G4' else '' end cites from orders""")
def citation_extract(t: Tables) -> DataFrame:
    said = F.when(F.col("o_orderkey") % 4 == 0, "It helps [G1-G3]. So it is [P7, G2].").when(F.col("o_orderkey") % 4 == 1, "See [P2] and [K3; P2] or [K3, K4].").when(F.col("o_orderkey") % 4 == 2, "Odd [G4-1].").otherwise("None [x].")
    return t.orders.select(F.col("o_orderkey").alias("id"), F.array_join(text.citations(said), ",").alias("cites"))


SUPPORT = "list_distinct(list_transform(list_filter(regexp_extract_all(lower({}), '[a-z]{{4,}}'), lambda w: w not in (" + ", ".join(f"'{w}'" for w in text.STOP) + ")), lambda w: regexp_replace(w, 's+$', '')))"


@query(f"""with b as (select item_id, text, lead(text) over (order by item_id) other from benchmark),
   c as (select item_id, {SUPPORT.format('text')} a, {SUPPORT.format("coalesce(other, '')")} o from b)
   select item_id, round(len(list_intersect(a, o)) / nullif(len(a)::double, 0), {R}) support from c""")
def sentence_support(t: Tables) -> DataFrame:
    b = t.benchmark
    nxt = b.select((F.col("item_id")).alias("item_id"), "text")
    from pyspark.sql import Window

    paired = nxt.withColumn("other", F.lead("text").over(Window.partitionBy(F.lit(1)).orderBy("item_id")))
    return rounded(paired.select("item_id", text.support(F.col("text"), F.coalesce("other", F.lit(""))).alias("support")), "support")


TRIPLES = [
    ("c1", "Harītakī-powder pacifies Vāta and relieves a dry   cough.", '{"triples":[{"subject":"haritaki","relation":"pacifies","object":"vata"},{"subject":" Harītakī ","relation":"Relieves","object":"dry cough"},{"subject":"haritaki","relation":"reduces","object":"VATA"},{"subject":"haritaki","relation":"contains","object":"vata"},{"subject":"ginger","relation":"treats","object":"cough"}]}'),
    ("c2", "Ginger increases pitta; a gingerly walk.", '{"triples":[{"subject":"ginger","relation":"increases","object":"pitta"},{"subject":"ginger","relation":"increases","object":"cough"},{"subject":"ginger"},{"subject":"ginger","relation":7,"object":"pitta"},{"subject":"pitta","relation":"treats","object":"ginger"},{"subject":"inger","relation":"treats","object":"pitta"},{"subject":"ginger","relation":"treats","object":"walk"},{"subject":"","relation":"treats","object":"pitta"}]}'),
    ("c3", "Ginger and pepper.", '{"other":1}'), ("c4", "Ginger and pepper.", "not json"), ("c5", "Pepper treats vata.", '{"triples":[{"subject":"pepper","relation":"treats","object":"vata"}]}'),
    ("c6", "Ginger and pepper.", '{"triples":"none"}'), ("c7", "Warfarin checks cough.", '{"triples":[{"subject":"warfarin","relation":"checks","object":"cough"},{"subject":"warfarin","relation":"checks","object":"cough"}]}'),
]
ENTITIES = [("Haritaki", "herb:h"), ("ginger", "herb:g"), ("vāta", "dosha:v"), ("pitta", "dosha:p"), ("cough", "condition:c"), ("dry cough", "condition:d"), ("warfarin", "drug:w"), ("twice", "herb:a"), ("twice", "herb:b")]


# the rows follow from the rules by hand: verb and kind of object give the relation, and the first failing rule the reason
@query("""select * from (values ('c1', 'herb:h', 'pacifies', 'dosha:v', 'haritaki', 'pacifies', 'vata', null), ('c1', 'herb:h', 'treats', 'condition:d', 'Harītakī', 'relieves', 'dry cough', null),
   ('c1', null, null, null, 'haritaki', 'contains', 'vata', 'relation not allowed'), ('c1', null, null, null, 'ginger', 'treats', 'cough', 'subject not in passage'),
   ('c2', 'herb:g', 'aggravates', 'dosha:p', 'ginger', 'increases', 'pitta', null), ('c2', null, null, null, 'ginger', 'increases', 'cough', 'object not in passage'), ('c2', null, null, null, 'ginger', null, null, 'malformed triple'),
   ('c2', null, null, null, 'ginger', null, 'pitta', 'malformed triple'), ('c2', null, null, null, 'pitta', 'treats', 'ginger', 'subject not a known entity'), ('c2', null, null, null, 'inger', 'treats', 'pitta', 'subject not in passage'),
   ('c2', null, null, null, 'ginger', 'treats', 'walk', 'object not a known entity'), ('c2', null, null, null, '', 'treats', 'pitta', 'subject not in passage'),
   ('c3', null, null, null, null, null, null, 'no triples list'), ('c4', null, null, null, null, null, null, 'malformed output'), ('c5', null, null, null, 'pepper', 'treats', 'vata', 'subject not a known entity'),
   ('c6', null, null, null, null, null, null, 'no triples list'), ('c7', 'drug:w', 'treats', 'condition:c', 'warfarin', 'checks', 'cough', null)) t(chunk, s, r, o, subject, relation_raw, object, reason)""")
def triple_grounding(t: Tables) -> DataFrame:
    return triples.ground_triples(t.spark.createDataFrame(TRIPLES, "chunk string, passage string, raw string"), t.spark.createDataFrame(ENTITIES, "surface string, entity string"))


FORMS = f"""{RISK}, ing as (select l_orderkey f, l_suppkey herb from lineitem ), n as (select f, count(*) n from ing group by 1),
   w as (select f, herb, count(*) / any_value(n)::double w0 from ing join n using (f) group by 1, 2), ok as (select f from w group by 1 having count(*) >= 2),
   x as (select w.*, drug, risk from w join ok using (f) join risk using (herb)),
   full_ as (select f, drug from x group by 1, 2 having count(*) = (select count(*) from w where w.f = x.f)),
   y as (select x.*, sum(w0) over p s from x join full_ using (f, drug) window p as (partition by f, drug)),
   z as (select *, 0.5 * w0 low, greatest(w0, least(s, 2 * w0)) high from y),
   k as (select *, s - sum(low) over (partition by f, drug) - coalesce(sum(high - low) over (partition by f, drug order by risk, herb rows between unbounded preceding and 1 preceding), 0) spare from z),
   sol as (select f, drug, herb, w0, risk, low + least(greatest(spare, 0), high - low) w from k)"""


def _formulations(t: Tables, risk: DataFrame | None = None) -> DataFrame:
    """Herbs of formulations with two and more, each with its vector over the drugs."""
    ing = t.lineitem.select(F.col("l_orderkey").alias("formulation"), F.col("l_suppkey").alias("herb"))
    return compose.formulation_rows(ing, t.risk() if risk is None else risk)


def _solved(t: Tables) -> DataFrame:
    return compose.solved_rows(_formulations(t))


@query(f"with {FORMS} select f formulation, drug, herb, round(w0, {R}) w0, round(w, {R}) w from sol")
def compose_knapsack(t: Tables) -> DataFrame:
    return rounded(_solved(t).select("formulation", "drug", "herb", "w0", "w"), "w0", "w")


REL = "rel as (select f, drug, case when sum(w0 * risk) = 0 then 0 else 1 - sum(w * risk) / sum(w0 * risk) end reduction from sol group by 1, 2)"


def _relative(t: Tables, settings: list[tuple[float, float]]) -> DataFrame:
    """lo, hi, drug, reduction of every formulation; shuffled once, for what reads it twice."""
    lists = compose.reductions(_formulations(t), settings)
    return lists.repartition(shuffles.tasks(lists)).select("lo", "hi", "drug", F.explode("reductions").alias("reduction"))


@query(f"with {FORMS}, {REL} select drug, count(*) n, round(median(reduction), {R}) median, round(avg(reduction), {R}) mean, round(quantile_cont(reduction, 0.9), {R}) p90 from rel group by 1")
def scenario_summary(t: Tables) -> DataFrame:
    out = metrics.large_quantiles(_relative(t, [(0.5, 2.0)]), ["drug"], "reduction", {"median": 0.5, "p90": 0.9})
    return rounded(out.select("drug", "n", "median", "mean", "p90"), "median", "mean", "p90")


@query(f"""with {FORMS} select herb, drug, count(*) n, round(avg(case when w - w0 < -1e-6 then 1.0::double else 0 end), {R}) reduced, round(avg(case when w - w0 > 1e-6 then 1.0::double else 0 end), {R}) increased,
   round(median((w - w0) / w0), {R}) + 0.0::double median_change from sol group by 1, 2""")
def direction_check(t: Tables) -> DataFrame:
    return rounded(compose.direction_rows(_formulations(t)), "reduced", "increased", "median_change").withColumn("median_change", F.col("median_change") + F.lit(0.0))


@query(" union all ".join(f"select * from (with {FORMS.replace('0.5 * w0', f'{lo} * w0').replace('2 * w0', f'{hi} * w0')}, {REL} select {lo}::double lo, {hi}::double hi, count(*) n, round(median(reduction), {R}) median, round(avg(reduction), {R}) mean from rel)" for lo, hi in ((0.8, 1.25), (0.5, 2.0))))
def sweep(t: Tables) -> DataFrame:
    out = metrics.large_quantiles(_relative(t, [(0.8, 1.25), (0.5, 2.0)]), ["lo", "hi"], "reduction", {"median": 0.5})
    return rounded(out.select("lo", "hi", "n", "median", "mean"), "median", "mean")


@query(f"""with {INH}, {ST}, {CONTAINS} select herb, contains.compound, inh.g enzyme, st.d drug from contains join inh on inh.c = contains.compound join st on st.g = inh.g and st.k = 0""")
def explain_paths(t: Tables) -> DataFrame:
    a = t.contains().select(F.col("src").alias("herb"), F.col("dst").alias("compound"))
    b = t.inhibits().select(F.col("src").alias("compound"), F.col("dst").alias("enzyme"))
    return a.join(b, "compound").join(t.roles(0).select(F.col("src").alias("drug"), F.col("dst").alias("enzyme")), "enzyme").select("herb", "compound", "enzyme", "drug")


LONG = "long as (select doc_id item, 'quality' rater, quality as label from labels union all select doc_id, 'toxic', toxic from labels union all select doc_id, 'third', cast(doc_id % 2 as integer) from labels where doc_id % 3 = 0)"


def _long(t: Tables) -> DataFrame:
    rows = t.__getattr__("labels")
    one = lambda rater, label: rows.select(F.col("doc_id").alias("item"), F.lit(rater).alias("rater"), label.alias("label"))
    return one("quality", F.col("quality")).unionByName(one("toxic", F.col("toxic"))).unionByName(one("third", (F.col("doc_id") % 2).cast("int")).where("item % 3 = 0"))


@query(f"""with {LONG}, p as (select a.rater rater_a, b.rater rater_b, a.label la, b.label lb from long a join long b on a.item = b.item and a.rater < b.rater),
   o as (select rater_a, rater_b, count(*)::double n, sum(case when la = lb then 1 else 0 end)::double same, sum(la)::double sa, sum(lb)::double sb from p group by 1, 2),
   e as (select *, same / n po, (sa * sb + (n - sa) * (n - sb)) / (n * n) pe from o)
   select rater_a, rater_b, n::bigint n, round((po - pe) / nullif(1 - pe, 0), {R}) kappa from e""")
def pairwise_kappa(t: Tables) -> DataFrame:
    return rounded(metrics.pairwise_kappa(_long(t)), "kappa")


@query(f"""with {LONG} select 'unknown label' problem, item::varchar subject from long where label = 1 and rater = 'third' union all
   select 'single rater', item::varchar from (select item from long where rater = 'third' group by 1)""")
def annotation_checks(t: Tables) -> DataFrame:
    return metrics.annotation_problems(_long(t).where("rater = 'third'"), ["0"])


@query("select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by event_id desc) = 1")
def last_write_wins(t: Tables) -> DataFrame:
    return files.last_write_wins(t.events, "user_id", "event_id").select("user_id", "event_id", "event_type", "value")


@query("""with e as (select user_id || '-' || strftime(ts, '%Y-%m-%d') k, event_type from events)
   select distinct k from e where k not in (select k from e where event_type <> 'click')""")
def pending_keys(t: Tables) -> DataFrame:
    log_ = t.events.select(F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("k"), (F.col("event_type") == "click").alias("failed"))
    return files.pending_keys(log_, log_, "k", "failed")


@query("""select 'n_herbs' k, count(*)::double v from supplier union all select 'n_compounds', count(*) from part union all select 'n_edges', count(*) from (select distinct l_suppkey, l_partkey from lineitem)""")
def facts_unpivot(t: Tables) -> DataFrame:
    one = lambda k, df: df.agg(F.lit(k).alias("k"), F.count("*").cast("double").alias("v"))
    return one("n_herbs", t.supplier).unionByName(one("n_compounds", t.part)).unionByName(one("n_edges", t.contains()))


@query("select date_trunc('hour', ts) as start, event_type, count(*) n from events group by 1, 2")
def event_windows(t: Tables) -> DataFrame:
    return log.windowed_counts(t.events)


@query("""select distinct page_id id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) link from pages""")
def page_links(t: Tables) -> DataFrame:
    return files.page_links(t.pages.select(F.col("page_id").alias("id"), "html"))


@query()
def chunk_documents(t: Tables) -> DataFrame:
    return text.make_chunks(t.documents.select(F.col("doc_id").alias("key"), "text"))


@query()
def compose_lp(t: Tables) -> DataFrame:
    uses = F.array((F.col("herb") % 3).cast("string"))
    return compose.program_rows(_formulations(t).withColumn("uses", uses))
