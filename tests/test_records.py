"""Records, scenarios, folds and explanations on small rows worked out by hand."""

from itertools import product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from graphloom.functions import metrics, text
from graphloom.operators import compose, graph, labels, records, triples
from graphloom.sources import files


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_records_keep_order_multiplicity_and_ignore_case(spark):
    lookup = records.herb_lookup(spark.createDataFrame([("Piper", ["Pippali", "long PEPPER"]), ("Zingiber", None)], "herb string, aliases array<string>"))
    got = records.formulation_records(spark.createDataFrame([("f", 2, "PIPPALI"), ("f", 1, "zingiber"), ("f", 3, "Water"), ("f", 4, "piper"), ("g", 1, "Water")], "formulation string, place int, ingredient string"), lookup)
    assert rows(got, "formulation", "n_ingredients", "in_scope", "n_in_scope", "optimisable") == [("f", 4, ["Zingiber", "Piper", "Piper"], 2, True), ("g", 1, [], 0, False)]
    assert rows(records.record_weights(got), "formulation", "herb", "w0") == [("f", "Piper", 0.5), ("f", "Zingiber", 0.25)]
    uses = records.uses_of_herbs(spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "b"), ("c", None)], "herb string, use string"))
    assert rows(uses, "herb", "uses") == [("a", ["b", "x"])]


def test_edges_of_pages_and_assays(spark):
    pages = spark.createDataFrame([("p1", "c"), ("p2", "c")], "page string, compound string")
    targets = spark.createDataFrame([("p1", "A", "s2"), ("p2", "A", "s1"), ("p2", "B", "s1"), ("p9", "B", "s1")], "page string, gene string, source string")
    assert rows(records.modulates_edges(targets, pages), "src", "dst", "sources") == [("c", "gene:A", "s1; s2"), ("c", "gene:B", "s1")]
    adme = spark.createDataFrame([("p1", "CYP2D6 inhibitor", "Yes"), ("p2", "CYP2D6 inhibitor", "Yes"), ("p1", "CYP3A4 inhibitor", "No"), ("p1", "P-glycoprotein substrate", "Yes"), ("p1", "CYP2D6 inhibitors", "Yes"), ("p1", "GI absorption", "Yes")], "page string, key string, value string")
    assert rows(records.adme_edges(adme, pages), "etype", "src", "dst") == [("predicted_cyp_inhibitor", "c", "gene:CYP2D6"), ("predicted_pgp_substrate", "c", "gene:ABCB1")]
    assay = spark.createDataFrame([("G", " warfarin ", 1), ("G", "Other", 1), ("G", "aspirin", 0)], "gene string, name string, y int")
    names = spark.createDataFrame([("WARFARIN", "drug:w"), ("ASPIRIN", "drug:a")], "key string, id string")
    assert rows(records.assay_edges(assay, names), "etype", "src", "dst") == [("non_substrate_of", "drug:a", "gene:G"), ("substrate_of", "drug:w", "gene:G")]


def test_explained_pairs(spark):
    make = spark.createDataFrame
    got = records.explain_pairs(
        make([("h", "c1"), ("h", "c2"), ("h", "c3")], "herb string, compound string"), make([("c1", "d", 0.9), ("c2", "d", 0.9), ("c3", "d", 0.1)], "compound string, drug string, p double"),
        make([("c1", "d", 1, "E1;E2"), ("c2", "d", 0, "")], "compound string, drug string, label int, enzymes string"), make([("c1", "E1", "lab")], "compound string, enzyme string, source string"),
        make([("d", "E1", "list"), ("d", "E2", "list")], "drug string, enzyme string, source string"), top=2,
    )
    assert rows(got.fillna("-"), "rank", "compound", "enzyme", "inhibitor_source", "substrate_source") == [(1, "c1", "E1", "lab", "list"), (1, "c1", "E2", "n/a", "list"), (2, "c2", "-", "-", "-")]
    scored = records.pair_scores(make([("h", "d", 0.5), ("g", "d", 0.2), ("g", "e", 0.9), ("i", "d", 0.2)], "herb string, drug string, risk double"))
    assert rows(scored, "herb", "drug", "percentile_for_drug", "percentile_overall") == [("g", "d", 2 / 3, 0.5), ("g", "e", 1.0, 1.0), ("h", "d", 1.0, 0.75), ("i", "d", 2 / 3, 0.5)]


def test_worst_drug_is_not_weighted():
    got = compose.optimise([[0.9, 0.1], [0.1, 0.6]], [0.5, 0.5], [1, 10], objective="max", lo=0.0)
    assert got["w"] == pytest.approx([5 / 13, 8 / 13]) and got["value"] == pytest.approx(5.3 / 13)
    assert got["drug_risk"].max() == pytest.approx(got["value"])
    with pytest.raises(ValueError):
        compose.optimise([[1.0]], [1.0], objective="least")


def test_programs_against_a_grid_of_weights(spark):
    rng = np.random.default_rng(4)
    problems = {f: (rng.random((3, 2)).round(3), rng.dirichlet(np.ones(3)).round(3), [["u"], ["u", "v"], ["w"]]) for f in range(3)}
    data = [(f, h, d, float(w0[h]), float(risk[h, d]), uses[h]) for f, (risk, w0, uses) in problems.items() for h in range(3) for d in range(2)]
    df = spark.createDataFrame(data, "formulation int, herb int, drug int, w0 double, risk double, uses array<string>")
    for objective in ("sum", "max"):
        got = {r["formulation"]: r for r in compose.optimise_formulations(df, objective=objective).collect()}
        for f, (risk, w0, _) in problems.items():
            least, total = np.inf, w0.sum()
            for a, b in product(np.linspace(0, total, 401), repeat=2):
                w = np.array([a, b, total - a - b])
                ok = (w >= 0.5 * w0 - 1e-9).all() and (w <= np.maximum(w0, np.minimum(total, 2 * w0)) + 1e-9).all()
                ok = ok and w[0] + w[1] >= 0.8 * (w0[0] + w0[1]) - 1e-9 and w[1] >= 0.8 * w0[1] - 1e-9 and w[2] >= 0.8 * w0[2] - 1e-9
                if ok:
                    least = min(least, (w @ risk).sum() if objective == "sum" else (w @ risk).max())
            assert got[f]["feasible"] and got[f]["value"] <= least + 1e-9 and got[f]["value"] >= least - 0.02 and got[f]["coverage"] >= 0.8 - 1e-9


def test_four_splits(spark):
    rng = np.random.default_rng(5)
    own = [(f"c{c}", f"d{d}", int(rng.integers(-1, 2))) for c in range(30) for d in range(6)]
    lab = spark.createDataFrame(own, "compound string, drug string, label int")
    contains = spark.createDataFrame([(f"h{int(rng.integers(0, 8))}", f"c{c}") for c in range(30) for _ in range(2)], "src string, dst string").distinct()
    known = {(c, d) for c, d, x in own if x >= 0}
    for split in labels.SPLITS:
        folds = labels.make_folds(split, lab, contains, 3).toPandas()
        tested = folds[folds.role == "test"]
        for f, part in folds.groupby("fold"):
            train, test = (part[part.role == r] for r in ("train", "test"))
            if split != "random_pair":
                key = "drug" if split == "cold_drug" else "compound"
                assert not set(train[key]) & set(test[key])
            if split != "cold_herb":
                assert set(zip(part.compound, part.drug)) == known and len(part) == len(known)
        if split != "cold_herb":
            assert len(tested) == len(known)
    result = labels.cross_validate(labels.make_folds("cold_compound", lab, contains, 3), labels.prior_by_fold, 5).collect()
    assert len(result) == 3 and all(0 <= r["auroc"] <= 1 and r["n_train"] + r["n"] == len(known) for r in result)
    with pytest.raises(ValueError):
        labels.make_folds("warm", lab, contains)


def test_ranks_and_leaks(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0), (2.0, 1.0), (None, 1.0)], "a double, b double")
    assert rows(labels.with_percentiles(df, "a", "m", "x"), "a", "m", "x") == [(1.0, 1 / 3, 1 / 3), (2.0, 2.5 / 3, 1.0), (2.0, 2.5 / 3, 1.0)]
    assert metrics.spearman(df, "a", "b").first()["spearman"] == pytest.approx(-0.5)
    edges = spark.createDataFrame([("contains", "a", "CYP2D6"), ("targets", "a", "X")], "etype string, src string, dst string")
    labels.assert_no_label_leak(edges)
    with pytest.raises(AssertionError):
        labels.assert_no_label_leak(edges.unionByName(spark.createDataFrame([("targets", "a", "CYP2D6")], edges.schema)))


def test_gold_rows_without_values_are_problems(spark):
    kinds = "herb string, drug string, label int, mechanism string, evidence string, confidence string, pmid string, verification string, citation string"
    told = {r["problem"] for r in graph.gold_problems(spark.createDataFrame([(None,) * 9], kinds), ["H"], ["D"]).collect()}
    assert told >= {"unknown herb", "unknown drug", "label must be 0 or 1", "bad mechanism", "bad evidence", "bad confidence", "pmid must be numeric", "missing verification", "missing citation"}


@pytest.mark.parametrize("raw,want", [("seeds of good carda\u00ac\nmoms are good", "seeds of good cardamoms are good"), ("carda-\nmoms are good", "cardamoms are good"), ("carda--\nmoms are good", "carda--\nmoms are good"), ("seeds of good carda\u00ac-\nmoms are good", "seeds of good cardamoms are good"), ("carda-\nMoms are good", "carda-\nMoms are good"), ("take 9-\nmany of them", "take 9-\nmany of them")])
def test_lines_joined_at_hyphens(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(text.clean_text(F.col("t"))).first()[0] == want


def test_phrases_in_passages(spark):
    cases = [("dry cough", "A dry \n cough.", True), ("cough", "coughing", False), ("Vāta", "vata!", True), ("long-pepper", "Long pepper", True), ("", "x", False), ("a.b", "a b", False), ("a.b", "see a.b", True)]
    got = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, p string, t string").select("i", triples.phrase_in(F.col("p"), F.col("t")).alias("x")).collect()
    assert {r["i"]: r["x"] for r in got} == {i: c[2] for i, c in enumerate(cases)}


def test_saved_graphs_gold_and_predictions_are_found(spark, tmp_path):
    make = spark.createDataFrame
    files.save_graph({"nodes_Herb": make([("h",)], "id string"), "edges_has": make([("h", "c")], "src string, dst string"), "other": make([(1,)], "x int")}, f"{tmp_path}/g")
    assert list(files.load_graph(spark, f"{tmp_path}/g")) == ["edges_has", "nodes_Herb"]
    (tmp_path / "gold.csv").write_text("herb,pmid\nh,0123\ng,\n")
    assert rows(files.read_gold(spark, f"{tmp_path}/gold.csv", ["herb", "pmid"]), "herb", "pmid") == [("g", ""), ("h", "0123")]
    (tmp_path / "p").mkdir()
    for seed, p in ((0, 0.25), (1, 0.75)):
        pd.DataFrame({"compound": ["c"], "drug": ["d"], "label": [1], "p": [p]}).to_parquet(tmp_path / f"p/cold_drug_random_forest_s{seed}_f3.parquet")
    found = files.read_predictions(spark, f"{tmp_path}/p")
    assert rows(found, "split", "model", "seed", "fold", "p") == [("cold_drug", "random_forest", 0, 3, 0.25), ("cold_drug", "random_forest", 1, 3, 0.75)]
    pd.DataFrame({"compound": ["c"], "drug": ["d"], "label": [1], "p": [0.1]}).to_parquet(tmp_path / "p/warm_prior_s0_f0.parquet")
    with pytest.raises(Exception, match="not a prediction file"):
        files.read_predictions(spark, f"{tmp_path}/p").collect()


def test_supplement_knows_every_drug_and_samples_have_strides(spark):
    names = spark.createDataFrame([("WARFARIN", "drug:w")], "key string, id string")
    got = records.supplement_edges(spark.createDataFrame([(" Warfarin", "cyp2c9 ")], "drug string, enzyme string"), names)
    assert rows(got, "src", "dst", "source") == [("drug:w", "gene:CYP2C9", "curated literature")]
    with pytest.raises(Exception, match="out of scope: other"):
        records.supplement_edges(spark.createDataFrame([("other", "x")], "drug string, enzyme string"), names).collect()
    for count, n in ((0, 3), (2, 3), (10, 3), (1000, 7)):
        ids = [7 * i % 1009 for i in range(count)]
        want = sorted(ids)[:: max(1, count // n)][:n]
        assert rows(records.strided_sample(spark.createDataFrame([(i,) for i in ids], "id long"), "id", n), "id") == [(i,) for i in want]
