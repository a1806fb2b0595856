"""Hand-made cases of links, questions, page layouts and pair models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import compose, generation, hybrid, models
from graphloom.sources import pages

LEX = [("Haridra", "herb:turmeric"), ("turmeric", "herb:turmeric"), ("long pepper", "herb:pippali"), ("pepper", "herb:marica"), ("vāta", "dosha:v"), ("shared", "herb:a"), ("shared", "herb:b"), ("ab", "herb:c")]


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(LEX, "surface string, entity string")


def test_longest_phrase_first_without_overlap(spark, lexicon):
    docs = spark.createDataFrame([(1, "Long-pepper, pepper and VATA; shared ab."), (2, None), (3, "peppers")], "doc_id int, text string")
    assert rows(hybrid.linked_phrases(docs, lexicon), "doc_id", "entity", "place", "words") == [(1, "dosha:v", 4, 1), (1, "herb:marica", 2, 1), (1, "herb:pippali", 0, 2)]


def test_expansion_adds_what_the_question_lacks(spark, lexicon):
    asked = spark.createDataFrame([(1, "Is turmeric warm?"), (2, "Nothing")], "question int, text string")
    found = hybrid.first_mentions(hybrid.linked_phrases(asked.withColumnRenamed("question", "doc_id"), lexicon))
    assert rows(hybrid.expand_queries(asked, found, lexicon), "question", "text") == [(1, "Is turmeric warm? haridra"), (2, "Nothing")]


def test_graph_items_and_their_passages(spark):
    graph = spark.createDataFrame([("herb:h", "dosha:v", "co-mentioned", [5, 7], 2), ("herb:h", "dosha:v", "REDUCES", [7, 9], 2), ("herb:x", "dosha:p", "REDUCES", [1], 1)], "a string, b string, relation string, chunks array<int>, weight long")
    found = spark.createDataFrame([(1, "herb:h", 0), (1, "dosha:v", 1)], "question int, entity string, place int")
    items = hybrid.graph_items(found, graph)
    assert rows(items, "rank", "relation") == [(1, "REDUCES"), (2, "co-mentioned")]
    assert rows(hybrid.provenance_ranking(items), "rank", "id") == [(1, 7), (2, 9), (3, 5)]


def test_facts_of_pairs_and_of_one_side(spark):
    risk = spark.createDataFrame([("h", "d", 0.5, 3), ("h", "e", 0.7, 3), ("g", "d", 0.5, 1)], "herb string, drug string, risk double, n_compounds int")
    found = spark.createDataFrame([(1, "herb:h", 0), (1, "drug:d", 1), (2, "drug:d", 0), (3, "dosha:v", 0)], "question int, entity string, place int")
    got = rows(hybrid.score_facts(found, risk), "question", "rank", "fact")
    assert [g[:2] for g in got] == [(1, 1), (2, 1)]
    assert got[0][2].startswith("h with d: predicted probability 0.50 (3 compounds)") and "g 0.50; h 0.50" in got[1][2]


def test_answer_scores(spark):
    df = spark.createDataFrame([("Warfarin and Digoxin [Aspirin 0.9] at 0.52", ["warfarin", "aspirin", "a.b"], 0.5), ("warfarins", ["warfarin"], 0.1), ("", [], 0.1)], "a string, gold array<string>, g double")
    assert [tuple(r) for r in df.select(hybrid.name_recall(F.col("a"), F.col("gold")), hybrid.number_hit(F.col("a"), F.col("g"))).collect()] == [(1 / 3, True), (0.0, False), (None, False)]


def test_question_rules(spark):
    df = spark.createDataFrame([('{"question": " what herb helps with the cough? "}', "p"), ('{"question": "too short"}', "p"), ("junk", "p"), (None, "p")], "raw string, p string")
    assert [r[0] for r in df.select(hybrid.parsed_question(F.col("raw"))).collect()] == ["what herb helps with the cough?", None, None, None]
    df = spark.createDataFrame([("does it say one two three four five six", "One, two: three four five six seven"), ("one two three", "one two three")], "q string, p string")
    assert [r[0] for r in df.select(hybrid.too_verbatim(F.col("q"), F.col("p"))).collect()] == [True, False]


def test_short_paragraphs_merge(spark):
    one = " ".join(["word"] * 13)
    df = spark.createDataFrame([(f"Long pepper.\n\nBlack\npepper too.\n\n{one}\n\nlast two",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(text.merged_paragraphs(F.col("t"))).collect()] == [["Long pepper. Black pepper too.", one], [], None]


def test_page_layouts(spark):
    detail = "<p>IMPPAT Phytochemical identifier: IMPHY1</p>Phytochemical name: <b>Piperine</b> Synonymous chemical names: a, b ,, External chemical identifiers: CID:CID_638024, ChEMBL:CHEMBL43185 Chemical structure information SMILES: CC=O InChI: InChI=1S InChIKey: KEY-X DeepSMILES: z"
    goal = "<table><tr><td>TAR_1</td><td>E1</td><td>CYP3A4</td><td>9</td><td>src</td></tr></table><table><tr><td>CYP3A4 inhibitor</td><td>-</td><td>Yes</td></tr><tr><td>other</td><td>-</td><td>Yes</td></tr></table>"
    form = "<h2>Ingredients of Trikatu</h2><table><tr><th>Formulation name</th><th>Formulation identifier</th><th>Ingredient name</th><th>Plant part</th></tr><tr><td>Trikatu</td><td>AFI7</td><td>Pippali</td><td>fruit</td></tr><tr><td>T</td><td></td><td></td><td>x</td></tr><tr><td>T</td><td>q</td><td>Marica</td></tr></table>"
    uses = "<table><tr><th>Plant</th><th>Therapeutic use</th></tr><tr><td>a</td><td>fever</td></tr><tr><td>a</td><td>cough &amp; cold</td></tr><tr><td>a</td><td>fever</td></tr></table>"
    df = spark.createDataFrame([("d", detail), ("t", goal), ("f", form), ("u", uses), ("e", ""), ("n", None)], "id string, html string")
    got = {r["id"]: r for r in pages.detail_records(df).collect()}
    assert tuple(got["d"])[1:] == ("IMPHY1", "Piperine", ["a", "b"], "638024", "CHEMBL43185", "CC=O", "InChI=1S", "KEY-X") and got["n"]["name"] == ""
    assert rows(pages.target_rows(df), "id", "gene", "entrez") == [("t", "CYP3A4", "9")] and rows(pages.adme_rows(df), "property", "value") == [("CYP3A4 inhibitor", "Yes")]
    made = {r["id"]: r for r in pages.formulation_records(df).collect()}
    assert (made["f"]["formulation"], made["f"]["name"]) == ("AFI7", "Trikatu") and [tuple(x) for x in made["f"]["ingredients"]] == [("Pippali", "fruit"), ("Marica", "")] and made["e"]["ingredients"] == []
    assert {r["id"]: r["uses"] for r in pages.therapeutic_uses(df).collect()}["u"] == ["cough & cold", "fever"]
    home = spark.createDataFrame([(1, '<a href="/imppat/afiformulationdetails/A%20b+&amp;c"></a>' * 2 + "<a href='/imppat/apiformulationdetails/X'>")], "id int, html string")
    assert rows(pages.formulation_links(home), "kind", "name") == [("afi", "A b+&c"), ("api", "X")]


def test_molecule_of_the_parent(spark):
    js = '{"molecules":[{"molecule_chembl_id":"C2","pref_name":"WARFARIN SODIUM","max_phase":4,"molecule_hierarchy":{"parent_chembl_id":"C1"},"molecule_synonyms":[{"molecule_synonym":"Warfarin"}]},{"molecule_chembl_id":"C1","pref_name":"WARFARIN","max_phase":4,"molecule_hierarchy":{"parent_chembl_id":"C1"},"molecule_synonyms":null}]}'
    assert rows(pages.molecule_ids(spark.createDataFrame([("warfarin ", js), ("other", js)], "name string, json string")), "name", "id") == [("warfarin ", "C1")]


def test_features_are_flags_class_and_profile(spark):
    ids = spark.createDataFrame([("a", "x"), ("b", None)], "id string, cls string")
    edge = spark.createDataFrame([("a", "g1"), ("a", "g2"), ("z", "g2")], "src string, dst string")
    pairs = spark.createDataFrame([("a", "b", "Major"), ("a", "z", "Unknown")], "src string, dst string, level string")
    assert models.frequent_targets(edge) == ["g2", "g1"]
    assert rows(models.drug_features(ids, edge, pairs, ["x"]), "id", "x") == [("a", [1, 1, 1, 1, 0, 0, 2]), ("b", [0, 0, 0, 1, 0, 0, 1])]
    listed = spark.createDataFrame([("b",)], "src string")
    assert rows(models.compound_features(ids, edge, listed, 1), "id", "x") == [("a", [1, 0]), ("b", [0, 1])]


def test_message_passing_keeps_nodes_without_edges(spark):
    nodes = spark.createDataFrame([("h", "herb", [1.0]), ("i", "herb", [3.0]), ("c", "compound", [2.0])], "id string, type string, x array<double>")
    edges = spark.createDataFrame([("contains", "h", "c"), ("contains", "i", "c")], "etype string, src string, dst string")
    got = rows(models.message_passing(nodes, edges, {"contains": ([[10.0]], [[1.0]], [0.5])}), "id", "x")
    assert got == [("c", [10 * 2.0 + 2.0 + 0.5 + 2.0]), ("h", [1.0]), ("i", [3.0])]


def test_forest_out_of_fold_beats_chance(spark):
    data = [(c, d, -1 if c % 11 == 0 else int((c % 3) * d > 2), [float(c % 3), float(d), float(c % 7)]) for c in range(60) for d in range(4)]
    pairs = spark.createDataFrame(data, "compound int, drug int, label int, x array<double>")
    got = models.out_of_fold(pairs, models.forest_learner(trees=5, depth=4), k=3).toPandas()
    assert len(got) == len(data) and got.groupby("compound")["fold"].nunique().max() == 1 and got["p"].between(0, 1).all()
    right = [(p >= 0.5) == ((c % 3) * d > 2) for c, d, p in zip(got["compound"], got["drug"], got["p"], strict=True)]
    assert sum(right) / len(right) > 0.9


def test_random_shares_sum_to_one_and_repeat(spark):
    keys = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "f int, h string")
    a = rows(models.random_shares(keys, ["f"], "h", 2), "f", "h", "seed", "share")
    assert a == rows(models.random_shares(keys.unionByName(keys), ["f"], "h", 2), "f", "h", "seed", "share")
    assert sum(x[3] for x in a if x[0] == 1 and x[2] == 0) == pytest.approx(1) and [x[3] for x in a if x[0] == 2] == [1, 1]


def test_suggest_and_its_errors(spark):
    made = spark.createDataFrame([("F", "a"), ("F", "b"), ("S", "a"), ("Q", "a"), ("Q", "c")], "formulation string, herb string")
    risk = spark.createDataFrame([("a", "d", 1.0), ("b", "d", 0.0), ("a", "e", 0.5), ("b", "e", 0.5)], "herb string, drug string, risk double")
    got = compose.suggest(made, risk, "F", ["d", "e"])
    assert got["w"] == pytest.approx([0.25, 0.75]) and got["value"] < got["base"]
    assert [compose.suggest(made, risk, *a).get("error") for a in (("X", ["d"]), ("F", []), ("F", ["zz"]), ("S", ["d"]), ("Q", ["d"]))] == ["unknown formulation", "no drug given", "no risk for zz", "a single herb has nothing to exchange with", "a herb has no risk"]


def test_factors_learn_pairs_and_fall_back(spark):
    rng = np.random.default_rng(3)
    u, v = rng.normal(size=(40, 2)), rng.normal(size=(12, 2))
    y = (u @ v.T > 0).astype(int)
    every = [(c, d, int(y[c, d])) for c in range(40) for d in range(12)]
    held = {(c, d) for c, d, _ in every if (c * 7 + d) % 5 == 0}
    schema = "compound int, drug int, label int"
    train = spark.createDataFrame([r for r in every if r[:2] not in held], schema)
    test = spark.createDataFrame([(c, d) for c, d in sorted(held)] + [(999, 0)], "compound int, drug int")
    got = {(r["compound"], r["drug"]): r["p"] for r in models.factor_learner(rank=2)(train, test).collect()}
    assert len(got) == len(held) + 1
    assert got[999, 0] == pytest.approx(train.where("drug = 0").agg(F.avg("label")).first()[0])
    assert np.mean([(got[k] >= 0.5) == y[k] for k in held]) > 0.85
    with pytest.raises(ValueError):
        models.factor_learner(most_drugs=3)(train, test)


def test_propagated_features_and_a_network(spark):
    nodes = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 0.0]), ("c", [0.0, 0.0])], "id string, x array<double>")
    edges = spark.createDataFrame([("r", "a", "c"), ("r", "b", "c"), ("other", "a", "b")], "etype string, src string, dst string")
    assert rows(models.propagated_features(nodes, edges, 2, ["r"]), "id", "x") == [("a", [1, 2, 0, 0]), ("b", [3, 0, 0, 0]), ("c", [0, 0, 2, 1])]
    data = spark.createDataFrame([(i, 0, int(i % 2 == 0), [float(i % 2), 1.0]) for i in range(40)], "compound int, drug int, label int, x array<double>")
    got = models.perceptron_learner(4, 50)(data, data.drop("label")).toPandas()
    assert ((got["p"] > 0.5) == (got["compound"] % 2 == 0)).all()


ITEMS = [(1, "P1", "P", "Haritaki pacifies vata strongly"), (1, "G1", "G", "haritaki is co-mentioned with vata in 3 passage(s) (co-occurrence only; no effect)."), (1, "K1", "K", "score 0.5")]


def test_prompts_calls_and_checks(spark):
    asked = spark.createDataFrame([(1, "What does haritaki do?"), (2, "Else?")], "question int, text string")
    items = spark.createDataFrame(ITEMS, "question int, item string, kind string, text string")
    prompts = generation.answer_prompts(asked, items, "KGP")
    first = {r["question"]: r["prompt"] for r in prompts.collect()}
    assert first[1].index("[K1]") < first[1].index("[G1]") < first[1].index("[P1] Hari") and "(none)" in first[2]

    def client(prompt):
        if "Else" in prompt:
            raise RuntimeError("down")
        return "Haritaki pacifies vata [P1]. It treats vata disorders [G1]. Moon rocks dance [P9]. Nothing cited."

    got = {r["question"]: r for r in generation.checked_answers(generation.call_client(prompts, client), items).collect()}
    a, b = got[1], got[2]
    assert (a["valid"], a["invalid"], a["n_sentences"], a["n_uncited"], a["n_cocite"], a["n_overclaim"]) == (["P1", "G1"], ["P9"], 4, 1, 1, 1)
    assert a["validity"] == pytest.approx(2 / 3) and a["support"] == pytest.approx(1 / 4) and a["text"].endswith(generation.DISCLAIMER)
    assert b["error"] == "RuntimeError: down" and b["validity"] is None and b["support"] is None and b["text"].startswith("(the model was unavailable)")
    assert "co-occurrence" not in rows(generation.without_caution(items).where("kind = 'G'"), "text")[0][0]
    total = generation.summarise_answers(generation.checked_answers(generation.call_client(prompts, client), items), []).first()
    assert (total["n"], total["over_reading"]) == (2, 1.0)


def test_extraction_goes_on_where_it_stopped(spark):
    chunks = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "id string, text string")
    log = spark.createDataFrame([("a", ""), ("b", "Timeout: slow")], "chunk string, error string")
    assert rows(generation.extract_pending(chunks, log, lambda p: p[-1]), "chunk", "raw") == [("b", "y"), ("c", "z")]
    assert rows(generation.extract_pending(chunks, log, lambda p: p[-1], 1), "chunk") == [("b",)]


def test_templates_refuse_gaps(spark):
    facts = spark.createDataFrame([("a", 0.256), ("n", 12345.6), ("gone", None)], "k string, v double")
    assert generation.render_template("{{a|pct1}} of {{ n|int }}", facts) == "25.6% of 12,346"
    with pytest.raises(KeyError):
        generation.render_template("{{gone}}", facts)
    with pytest.raises(ValueError):
        generation.render_template("{{a|odd}}", facts)


def test_citation_forms(spark):
    df = spark.createDataFrame([("[G1-G3] [P2, K1] [G4-2] [A1; B2] [G5-6]",), ("none",), ("",)], "t string")
    assert [r[0] for r in df.select(text.citations(F.col("t"))).collect()] == [["G1", "G2", "G3", "P2", "K1", "G4", "G5", "G6"], [], []]
