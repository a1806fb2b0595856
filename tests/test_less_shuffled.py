"""Plans that must not shuffle what they multiply."""

import pytest

from graphloom.operators import hybrid, models


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_runs_of_words_meet_a_broadcast_lexicon(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "dry ginger and pepper"), (2, "Ginger, dry ginger"), (3, None)], "doc_id long, text string")
    lexicon = spark.createDataFrame([("ginger", "herb:g"), ("dry ginger", "herb:d"), ("pepper", "herb:p")], "surface string, entity string")
    small = hybrid.linked_phrases(docs, lexicon)
    assert "strategy=broadcast" in joins(small)
    monkeypatch.setattr(hybrid, "MOST_SURFACES", 2)
    large = hybrid.linked_phrases(docs, lexicon)
    assert "strategy=broadcast" not in joins(large)
    want = [(1, "herb:d", 0, 2), (1, "herb:p", 3, 1), (2, "herb:d", 1, 2), (2, "herb:g", 0, 1)]
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect())) == want


def test_shares_shuffle_keys_once(spark):
    keys = spark.createDataFrame([(f, h) for f in range(9) for h in range(f % 4 + 1)] * 2, "f long, h long")
    got = models.random_shares(keys, ["f"], "h", 3)
    plan = joins(got)
    assert "Join" not in plan and plan.count("RepartitionByExpression") == 1 and plan.index("Generate") < plan.index("RepartitionByExpression")
    rows = got.collect()
    assert len(rows) == 3 * sum(f % 4 + 1 for f in range(9))
    total = {}
    for r in rows:
        total[r["f"], r["seed"]] = total.get((r["f"], r["seed"]), 0) + r["share"]
    assert list(total.values()) == pytest.approx([1.0] * 27)
