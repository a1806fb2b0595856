"""Queries on links, query expansion, hybrid retrieval and question sets, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import metrics
from graphloom.operators import hybrid

from .adapters import Tables
from .catalogue import LINES, R, query, rounded

PHRASES = [("and the", "herb:1"), ("thing", "herb:2"), ("Mente", "herb:1"), ("the", "dosha:v"), ("ering", "condition:e"), ("des", "drug:3"), ("ment", "drug:4"), ("of the", "condition:o"), ("of", "herb:3"), ("und", "dosha:u"), ("und", "herb:9")]
ASKED = [(1, "Thing and the ering?"), (2, "Is thing good with des?"), (3, "Which of ment or des"), (4, "zz unknown"), (5, "mente, thing")]

SQL_FOLD = "' ' || trim(regexp_replace(lower(strip_accents(coalesce({}, ''))), '[^a-z0-9]+', ' ', 'g')) || ' '"
SQL_LEX = f"""lex(raw, entity) as (values {', '.join(map(str, PHRASES))}), ok as (select lower(raw) surface, min(entity) entity from lex where length(raw) >= 3 group by 1 having count(distinct entity) = 1),
   asked(question, text) as (values {', '.join(map(str, ASKED))}), pat as (select string_agg(surface, '|' order by length(surface) desc, surface) p from ok),
   norm as (select doc_id, {SQL_FOLD.format('text')} t from documents), qnorm as (select question, text, {SQL_FOLD.format('text')} t from asked),
   links as (select doc_id, entity from (select doc_id, unnest(regexp_extract_all(t, '\\b(' || p || ')\\b')) surface from norm, pat) join ok using (surface)),
   qhits as (select question, unnest(l) surface, generate_subscripts(l, 1) place from (select question, regexp_extract_all(t, '\\b(' || p || ')\\b') l from qnorm, pat)),
   found as (select question, entity, min(place) place from qhits join ok using (surface) group by 1, 2)"""
SQL_EXPAND = f"""{SQL_LEX}, new as (select q.question, f.entity, place, surface, row_number() over (partition by q.question, f.entity order by len(string_split(surface, ' ')), surface) k
      from found f join qnorm q using (question) join ok using (entity) where f.entity like 'herb:%' and not contains(q.t, surface)),
   extra as (select question, string_agg(surface, ' ' order by place, k) extra from new where k <= 4 group by 1),
   expanded as (select asked.question, concat_ws(' ', text, extra) text from asked left join extra using (question))"""


def _lexicon(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(PHRASES, "surface string, entity string")


def _asked(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(ASKED, "question int, text string")


def _links(t: Tables) -> DataFrame:
    return hybrid.linked_phrases(t.documents.select("doc_id", "text"), _lexicon(t))


def _found(t: Tables) -> DataFrame:
    return hybrid.first_mentions(hybrid.linked_phrases(_asked(t).withColumnRenamed("question", "doc_id"), _lexicon(t)))


@query(f"with {SQL_LEX} select doc_id, entity, count(*) n from links group by 1, 2")
def linked_phrases(t: Tables) -> DataFrame:
    return _links(t).groupBy("doc_id", "entity").agg(F.count("*").alias("n"))


@query(f"with {SQL_EXPAND} select question, text from expanded")
def expanded_queries(t: Tables) -> DataFrame:
    return hybrid.expand_queries(_asked(t), _found(t), _lexicon(t))


SQL_RISK = f"frisk as (select cast(l_suppkey as varchar) herb, cast(c_nationkey as varchar) drug, (sum(cast(round(l_discount * 100) as bigint)) // count(*)) / 100.0::double risk, count(*) n_compounds from {LINES} group by 1, 2)"
CAVEAT = "Research score, not advice."
SQL_FACTS = f"""{SQL_RISK}, fh as (select question, place, entity[6:] herb from found where entity like 'herb:%'), fd as (select question, place, entity[6:] drug from found where entity like 'drug:%'),
   best as (select 'herb' side, herb own, drug other, risk, row_number() over (partition by herb order by risk desc, drug) k from frisk union all select 'drug', drug, herb, risk, row_number() over (partition by drug order by risk desc, herb) from frisk),
   lists as (select side, own, string_agg(other || printf(' %.2f', risk), '; ' order by k) list from best where k <= 3 group by 1, 2),
   alone as (select 'herb' side, question, place, herb own from fh where question not in (select question from fd) union all select 'drug', question, place, drug from fd where question not in (select question from fh)),
   told as (select question, 0 place, -risk o, herb || '|' || drug name, printf('%s with %s: predicted probability %.2f (%d compounds). {CAVEAT}', herb, drug, risk, n_compounds) fact
            from fh join fd using (question) join frisk using (herb, drug)
            union all select question, place, 0, own, 'Highest scores of ' || own || ': ' || list || '. {CAVEAT}' from alone join lists using (side, own)),
   facts as (select question, cast(row_number() over (partition by question order by place, o, name) as integer) as "rank", fact from told qualify row_number() over (partition by question order by place, o, name) <= 4)"""


def _fact_risk(t: Tables) -> DataFrame:
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    keys = [F.col("l_suppkey").cast("string").alias("herb"), F.col("c_nationkey").cast("string").alias("drug")]
    return lines.groupBy(*keys).agg(F.floor(F.sum(F.round(F.col("l_discount") * 100).cast("long")) / F.count("*")).alias("s"), F.count("*").alias("n_compounds")).select("herb", "drug", (F.col("s") / 100).alias("risk"), "n_compounds")


@query(f'with {SQL_LEX}, {SQL_FACTS} select question, "rank", fact from facts')
def score_facts(t: Tables) -> DataFrame:
    return hybrid.score_facts(_found(t), _fact_risk(t))


SQL_GRAPH = f"""graph as (select a.entity a, b.entity b, 'co-mentioned' relation, count(distinct a.doc_id) weight, list_sort(list(distinct a.doc_id)) chunks
      from links a join links b using (doc_id) where a.entity like 'herb:%' and (b.entity like 'dosha:%' or b.entity like 'condition:%') group by 1, 2 having count(distinct a.doc_id) >= 2),
   touched as (select distinct question, a, b, relation, weight, chunks from found join graph on entity = a or entity = b),
   items as (select *, row_number() over (partition by question order by weight desc, a, b) k from touched qualify row_number() over (partition by question order by weight desc, a, b) <= 4),
   gfacts as (select question, cast(k as integer) as "rank", printf('%s is co-mentioned with %s in %d passage(s) (co-occurrence only; neither is said to affect the other).', string_split(a, ':')[-1], string_split(b, ':')[-1], weight) fact from items),
   provp as (select question, k, unnest(chunks) id, generate_subscripts(chunks, 1) p from items),
   prov as (select question, id, row_number() over (partition by question order by min(k * 1000000000 + p)) "rank" from provp group by 1, 2)"""


def _sql_passages(alias: bool, graph: bool, k: int, tag: str) -> str:
    """CTEs that end in best_<tag> (question, id, rank)."""
    return f"""qw_{tag} as (select question, unnest(string_split(trim({SQL_FOLD.format('text')}), ' ')) w from {'expanded' if alias else 'asked'}),
   qs_{tag} as (select question, cast('0x' || md5(w)[1:8] as bigint) % 64 slot, count(*) c from qw_{tag} where w <> '' group by 1, 2),
   dot_{tag} as (select question, id, sum(qs_{tag}.c * ds.c)::double dot from qs_{tag} join ds using (slot) group by 1, 2),
   qn_{tag} as (select question, sqrt(sum(c * c)::double) qn from qs_{tag} group by 1),
   sc_{tag} as (select a.question, d.doc_id id, round(coalesce(dot / nullif(qn * dn, 0), 0), 9) score from asked a cross join documents d left join dot_{tag} x on x.question = a.question and x.id = d.doc_id left join qn_{tag} q on q.question = a.question left join dn on dn.id = d.doc_id),
   dense_{tag} as (select question, id, row_number() over (partition by question order by score desc, id) "rank" from sc_{tag} qualify row_number() over (partition by question order by score desc, id) <= 20),
   fused_{tag} as (select question, id, round(sum(1.0::double / (60 + "rank")), 12) score from (select * from dense_{tag}{' union all select question, id, "rank" from prov' if graph else ''}) group by 1, 2),
   best_{tag} as (select question, id, row_number() over (partition by question order by score desc, id) "rank" from fused_{tag} qualify row_number() over (partition by question order by score desc, id) <= {k})"""


SQL_DOCS = """dw as (select doc_id id, unnest(string_split(trim(t), ' ')) w from norm), ds as (select id, cast('0x' || md5(w)[1:8] as bigint) % 64 slot, count(*) c from dw where w <> '' group by 1, 2),
   dn as (select id, sqrt(sum(c * c)::double) dn from ds group by 1)"""


def _text_graph(t: Tables) -> DataFrame:
    seen = _links(t).select("doc_id", "entity").distinct()
    herbs = seen.where(F.col("entity").startswith("herb:")).select("doc_id", F.col("entity").alias("a"))
    others = seen.where(F.col("entity").startswith("dosha:") | F.col("entity").startswith("condition:")).select("doc_id", F.col("entity").alias("b"))
    pairs = herbs.join(others, "doc_id").groupBy("a", "b").agg(F.array_sort(F.collect_set("doc_id")).alias("chunks"))
    return pairs.select("a", "b", F.lit(hybrid.CO).alias("relation"), "chunks", F.size("chunks").cast("long").alias("weight")).where("weight >= 2")


def _retrieve(t: Tables, **how) -> DataFrame:
    return hybrid.hybrid_retrieve(_asked(t), t.documents.select(F.col("doc_id").alias("id"), "text"), _lexicon(t), _text_graph(t), _fact_risk(t), **how)


@query(f"""with {SQL_EXPAND}, {SQL_FACTS}, {SQL_GRAPH}, {SQL_DOCS}, {_sql_passages(True, True, 5, 'f')}
   select question, 'P' || "rank" item, 'P' kind, cast(id as varchar) chunk, cast(null as varchar) fact from best_f union all select question, 'G' || "rank", 'G', null, fact from gfacts
   union all select question, 'K' || "rank", 'K', null, fact from facts where "rank" <= 3""")
def hybrid_retrieve(t: Tables) -> DataFrame:
    return _retrieve(t).select("question", "item", "kind", F.col("chunk").cast("string").alias("chunk"), F.when(F.col("kind") != "P", F.col("text")).alias("fact"))


CONFIGS = {"plain": (False, False), "alias": (True, False), "graph": (False, True), "alias+graph": (True, True)}


@query(f"""with {SQL_EXPAND}, {SQL_GRAPH}, {SQL_DOCS}, {', '.join(_sql_passages(a, g, 10, f'c{i}') for i, (a, g) in enumerate(CONFIGS.values()))},
   gold as (select distinct question, doc_id id from found join links using (entity) where found.place = 1),
   every as ({' union all '.join(f"select '{name}' config, question, id, cast(rank as bigint) as place from best_c{i}" for i, name in enumerate(CONFIGS))}),
   hit as (select c.config, g.question, min(place) best from gold g cross join (values {', '.join(f"('{n}')" for n in CONFIGS)}) c(config) left join every e on e.config = c.config and e.question = g.question and e.id = g.id group by 1, 2)
   select config, round(avg(case when best <= 5 then 1.0::double else 0 end), {R}) recall_5, round(avg(case when best <= 10 then 1.0::double else 0 end), {R}) recall_10, round(avg(coalesce(1.0::double / best, 0)), {R}) mrr, count(*) n from hit group by 1""")
def retrieval_by_config(t: Tables) -> DataFrame:
    first = _found(t)
    first = first.join(first.groupBy("question").agg(F.min("place").alias("place")), ["question", "place"])
    gold = first.join(_links(t).select("entity", F.col("doc_id").alias("id")).distinct(), "entity").select("question", "id").distinct()
    out = None
    for name, (alias, graph) in CONFIGS.items():
        ranked = _retrieve(t, alias=alias, use_graph=graph, facts=False, k=10).where("kind = 'P'").select("question", F.col("chunk").alias("id"), F.substring("item", 2, 9).cast("int").alias("rank"))
        one = metrics.recall_and_mrr(ranked, gold).withColumn("config", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return rounded(out, "recall_5", "recall_10", "mrr")


NAMES = [("herb:1", "Ering", "latin one"), ("herb:2", "With", "there"), ("herb:3", "Zingo", "none")]


@query(f"""with {SQL_LEX}, names(s, common, latin) as (values {', '.join(map(str, NAMES))}),
   tr as (select distinct doc_id, a.entity s, b.entity o from links a join links b using (doc_id) where a.entity like 'herb:%' and b.entity like 'condition:%'),
   keep as (select tr.*, common from tr join names using (s) join norm using (doc_id) join documents d using (doc_id) where not contains(t, ' ' || lower(common) || ' ') and not contains(lower(d.text), latin)),
   g as (select s, o, common, count(*) n, string_agg(doc_id, ',' order by doc_id) gold from keep group by all)
   select cast(row_number() over (order by n desc, s, o) as integer) place, s, o, 'What does the text say about ' || lower(common) || ' for ' || o[11:] || '?' question, cast(n as integer) n, gold from g""")
def gap_questions(t: Tables) -> DataFrame:
    seen = _links(t).select(F.col("doc_id").alias("chunk"), "entity").distinct()
    triples = seen.select("chunk", F.col("entity").alias("s")).where("s like 'herb:%'").join(seen.select("chunk", F.col("entity").alias("o")).where("o like 'condition:%'"), "chunk").withColumn("r", F.lit("treats"))
    out = hybrid.gap_questions(triples, t.documents.select(F.col("doc_id").alias("id"), "text"), t.spark.createDataFrame(NAMES, "s string, common string, latin string"), "treats")
    return out.withColumn("gold", F.array_join(F.transform("gold", lambda x: x.cast("string")), ","))


@query("""with q as (select r_regionkey question from region), s(system) as (values ('plain'), ('full'), ('none'))
   select question, system from q cross join s where not (question % 2 = 0 and system = 'full')""")
def answer_grid(t: Tables) -> DataFrame:
    asked = t.region.select(F.col("r_regionkey").alias("question"))
    done = asked.where("question % 2 = 0").withColumn("system", F.lit("full"))
    return hybrid.answer_grid(asked, t.spark.createDataFrame([("plain",), ("full",), ("none",)], "system string"), done)
