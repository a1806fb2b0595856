"""The pipeline's operators against brute force, exact round trips and held-out rows, with odd rows among the usual."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from graphloom.llm import bpe, components, ctw, exact_dedup, langid, minhash, mixing, packing, textkit, tokencount, tokenout, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, kept string, length int"
WORDS = [a + b for a in ("ka", "lo", "mi", "ta", "re", "su") for b in ("n", "ra", "to", "l", "", "di")]


def make_texts(seed=0, n=120):
    rng = np.random.default_rng(seed)
    texts = [" ".join(rng.choice(WORDS, rng.integers(3, 80))) + "." for _ in range(n)]
    for i in range(0, n, 7):  # near copies, chains of them, exact copies
        words = texts[i].split(" ")
        for k in range(1, 4):
            words = [w if rng.random() > 0.015 else "neu" for w in words]
            texts.append(" ".join(words))
        texts.append(texts[i])
    return [*texts, None, None, "", "", " \n\t", "a", "A", "a b", "A  b", "x" * 5000, " ".join(rng.choice(WORDS, 6000)), "don't 'tis it's", "日本語 　 text", "<|endoftext|> !"]


@pytest.fixture(scope="module")
def texts():
    return make_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3, t, None if i % 11 == 0 else ("en", "de")[i % 2], None if i % 13 == 0 else "src0" if i % 3 else f"src{i % 5}", 1, "d", "k", 4) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, none, texts):
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i * 3)
    for counters in (2, 1024):
        got = {r["doc_id"]: tuple(r)[1:] for r in exact_dedup.exact_duplicates(docs, counters=counters).collect()}
        assert got == {i * 3: (max(groups[t or ""]), len(groups[t or ""]), i * 3 == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in enumerate(texts)}
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert exact_dedup.drop_exact_duplicates(docs).columns == docs.columns
    assert exact_dedup.drop_exact_duplicates(docs).count() == len(groups)


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b")], "doc_id long, text string")
    got = sorted(((str(r["doc_id"]), r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(df).collect()), key=str)
    assert got == [("1", 1, 3, True), ("1", 1, 3, True), ("None", 1, 3, False), ("None", None, 1, True)]
    assert minhash.near_duplicates(df.where("doc_id = 1")).count() == 2


def test_misra_gries_bounds():
    rng = np.random.default_rng(0)
    data = np.concatenate([np.repeat(b"hot", 500), rng.integers(0, 5000, 1500).astype("S8")])
    rng.shuffle(data)
    counts: dict = {}
    for part in np.array_split(data, 9):
        exact_dedup.misra_gries(counts, part.astype("S64"), 20)
    true = Counter(data.tolist())
    assert len(counts) <= 20 and 500 - len(data) / 21 <= counts[b"hot"] <= 500
    assert all(c <= true[v] for v, c in counts.items())


def test_ids_equal_the_tokenizers_library(texts):
    ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ref.encode_special_tokens = True
    own = [t or "" for t in texts] + ["  a\n\n b ", " x   y", "\x1c \x85z", "½²3 \t\t", "a\n", "'s", "é'é o'", "ɐx y"]
    data = np.frombuffer("".join(own).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in own])])
    enc = bpe.BatchEncoder()
    for _ in range(2):  # the second time from memory
        ids, at = enc.encode(data, off, 0)
        for i, t in enumerate(own):
            assert ids[at[i] : at[i + 1]].tolist() == [*ref.encode(t, add_special_tokens=False).ids, 0], t[:30]


class Counted:
    """An encoder that notes its calls."""

    def __init__(self, inner, calls: list[str]):
        self.inner, self.calls = inner, calls

    def __getattr__(self, name):
        value = getattr(self.inner, name)
        if name == "_core_bpe":
            return Counted(value, self.calls)
        return lambda *args: (self.calls.append(name), value(*args))[1]


@pytest.mark.parametrize("most", [4, 1 << 18])
def test_new_pieces_are_encoded_together(most):
    """Calls don't grow with the pieces; the memory of pieces grows, is emptied and changes no id."""
    ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ref.encode_special_tokens = True
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcé0ñoz"), 7)) for _ in range(1500)]
    marks = ["".join(rng.choice(list("'!,.a0½"), 4)) for _ in range(300)]
    own = [" ".join(words), "".join(w + m for w, m in zip(words, marks * 5, strict=True)), "a0'a ' 0", "", " \t\n a", *marks[:50], "ɐ'", "a" * 300]
    enc, calls = bpe.BatchEncoder(most=most), []
    enc.enc = Counted(enc.enc, calls)
    off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in own])])
    data = np.frombuffer("".join(own).encode(), np.uint8)
    ids, at = enc.encode(data, off)
    slow = sum("ɐ" in t or any(a == "'" and b.isalpha() for a, b in zip(t, t[1:], strict=False)) for t in own)
    assert len(calls) <= slow + 10
    for k in range(len(own)):  # one by one, then again
        for _ in range(2):
            again, _ = enc.encode(data[off[k] : off[k + 1]], off[k : k + 2] - off[k], 7)
            assert again.tolist() == [*ids[at[k] : at[k + 1]].tolist(), 7]
        assert ids[at[k] : at[k + 1]].tolist() == ref.encode(own[k], add_special_tokens=False).ids, own[k][:30]
    assert len(enc.keys) >= 2 * enc.known


def test_packing(docs, none, texts):
    ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ref.encode_special_tokens = True
    got = packing.best_fit_pack(docs).toPandas()
    ids = {i * 3: [*ref.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    for doc, part in got.groupby("doc_id"):
        part = part.sort_values("piece")
        joined = []
        for r in part.itertuples():
            own = ids[doc][r.start : r.start + r.length]
            assert r.start == len(joined) and zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32
            joined += own
        assert joined == ids[doc]
        assert (part.length[1:] == 2048).all() and (len(part) == 1 or len(ids[doc]) > 2048)
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part.offset.tolist() == [0, *part.length.cumsum()[:-1]] and part.length.sum() <= 2048
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1
    assert set(got.doc_id) == set(ids)
    assert packing.best_fit_pack(none).count() == 0


def test_plan_uses_every_length():
    rng = np.random.default_rng(2)
    for most in (40, 900, 2048):
        n = rng.integers(1, most + 1, 3000)
        packs = packing.plan_packs(Counter(n.tolist()))
        used = Counter()
        for p, c in packs:
            assert sum(p) <= 2048
            for x in p:
                used[x] += c
        assert used == Counter(n.tolist())
        assert sum(c for _, c in packs) <= 1.03 * n.sum() / 2048 + 2 or most == 2048
    assert packing.plan_packs({}) == []


@pytest.mark.parametrize("lengths", [{704: 6000, 672: 12000}, {804: 6000, 612: 12000}, {900: 6000, 600: 6000, 540: 6000}, {800: 6000, 500: 6000, 420: 6000, 320: 6000}])
def test_plan_fills_sequences_with_three_and_four(lengths):
    packs = packing.plan_packs(lengths)
    used = Counter()
    for p, c in packs:
        assert sum(p) <= 2048
        for n in p:
            used[n] += c
    assert used == lengths
    assert sum(c for _, c in packs) <= 6000 * 1.01


def brute_components(texts, k, percent):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())) for t in texts]
    sets = [set(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else {tuple(w)} if w else set() for w in words]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("k,percent,block", [(3, 85, 1024), (5, 80, 3)])
def test_near_duplicates(docs, none, texts, k, percent, block):
    want = {i * 3: (n, 3 * c) for i, (n, c) in enumerate(brute_components(texts, k, percent))}
    got = minhash.near_duplicates(docs, k, percent, block=block).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    if block > 3:
        assert minhash.near_duplicates(none, k, percent).count() == 0
        assert minhash.drop_near_duplicates(docs, k=k, percent=percent).count() == sum(r["kept"] for r in got)


def test_superminhash_is_the_walk_of_each_element():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(1, 1 << 63, n, dtype=np.uint64)) for n in (1, 3, 40, 400, 3000)]
    off = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    together = minhash.superminhash(np.concatenate(sets), off, 32)
    for i, s in enumerate(sets):
        ones = [minhash.superminhash(x[None], np.array([0, 1]), 32)[0] for x in s]
        assert (np.min(ones, axis=0) == together[i]).all()
        assert sorted(int(v) >> 48 for v in ones[0]) == list(range(32))
    a, b = sets[4], np.concatenate([sets[4][:2000], sets[3]])
    sig = minhash.superminhash(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 1024)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((sig[0] == sig[1]).mean() - true) < 0.05


def test_spans_of_one_structure_differ():
    for n in (1024, 2048):
        word = b"a"
        while len(word) < n:
            word += word.translate(bytes.maketrans(b"ab", b"ba"))
        other = word.translate(bytes.maketrans(b"ab", b"ba"))
        data = np.frombuffer(word + other, np.uint8)
        h = textkit.span_hashes(data, np.array([0, n]), np.array([n, 2 * n]))
        assert h[0] != h[1]
        ids, at = bpe.BatchEncoder().encode(data, np.array([0, n, 2 * n]))
        ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        assert [ids[at[i] : at[i + 1]].tolist() for i in (0, 1)] == [ref.encode(x.decode(), add_special_tokens=False).ids for x in (word, other)]
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    s = np.arange(0, 400, 5)
    h = textkit.span_hashes(data, s, s + 5)
    assert len(set(h.tolist())) == len({bytes(data[i : i + 5]) for i in s})


def test_linked_finds_every_component():
    rng = np.random.default_rng(21)
    base = [rng.integers(1, 1 << 62, rng.integers(1, 60), dtype=np.uint64) for _ in range(12)]
    for percent in (50, 80, 85):
        sets = []
        for _ in range(150):
            x = base[rng.integers(0, 12)]
            own = x[rng.random(len(x)) > rng.choice([0.02, 0.1, 0.3])]
            sets.append(np.unique(np.concatenate([own, rng.integers(1, 1 << 62, rng.integers(0, 3), dtype=np.uint64), x[:1]])))
        ids = rng.permutation(5000)[:150].astype(np.int64)
        want = []
        for i, j in combinations(range(150), 2):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                want.append((ids[i], ids[j]))
        found = minhash._linked(sets, ids, percent)
        assert len(found[0]) < 150
        roots = [dict(zip(*(x.tolist() for x in components.union_find(np.array(a), np.array(b))), strict=True)) for a, b in (zip(*want, strict=True), found)]
        assert roots[0] == roots[1]


def test_a_large_group_of_near_copies_takes_little_memory():
    import tracemalloc

    rng = np.random.default_rng(22)
    common = rng.integers(1, 1 << 62, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([common[5:], rng.integers(1, 1 << 62, 3, dtype=np.uint64)])) for _ in range(2048)]
    tracemalloc.start()
    a, b = minhash._linked(sets, np.arange(2048), 85)
    assert len(a) == 2047 and tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, i) for i in range(4000, 4300)]
    a, b = components.union_find(*np.array(edges).T)
    want = dict(zip(a.tolist(), b.tolist(), strict=True))
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(6))
    assert {r["node"]: r["root"] for r in got.collect()} == want
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(0, 0.2, (400, 8))
    v[50:200] = v[50]  # a very common vector: ties
    rows = [(i, [float(x) for x in r], "x") for i, r in enumerate(v)] + [(400, None, "x"), (401, [0.1, None], "x"), (500, [float("nan")], "x"), (600, [0.5, -0.5], "x"), (700, [], "x"), (None, [1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(4)
    ints = {i: [math.floor(1024 * float(np.float32(x))) for x in r] for i, r, _ in rows if i is not None and r is not None and all(x is not None and math.isfinite(x) for x in r)}
    want = {}
    for q in ints:
        if q % 100 == 0:
            s = sorted(((-sum(a * b for a, b in zip(ints[q], ints[c], strict=False)), c) for c in ints if c != q))[:10]
            want[q] = [(k + 1, c, -x) for k, (x, c) in enumerate(s)]
    got = defaultdict(list)
    for r in topk.exact_top_k(df, df.where("vec_id % 100 = 0")).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert {q: sorted(x) for q, x in got.items()} == want
    assert topk.exact_top_k(df.limit(0), df.limit(0)).count() == 0


def test_top_k_of_very_large_components(spark):
    rng = np.random.default_rng(41)
    rows = [(i, [float(x) for x in rng.normal(0, 10.0 ** rng.integers(0, 31), 4)]) for i in range(120)] + [(120, [1e30, -1e30, 1e30, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    ints = {i: [math.floor(1024 * x) for x in r] for i, r in rows}
    got = defaultdict(list)
    for r in topk.exact_top_k(df, df.where("vec_id % 100 = 0")).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for q in (0, 100):
        s = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(ints[q], ints[c], strict=True)))), c) for c in ints if c != q)[:10]
        assert sorted(got[q]) == [(k + 1, c, -x) for k, (x, c) in enumerate(s)]


CLASHES = ("rep", "n", "d1", "bands", "key", "y", "terms", "counts", "digest", "__digest", "__kept_id", "__gone0", "__hot", "__crc", "__tokens", "__topic", "__source", "kept", "length", "number", "before", "salt", "h", "lang_pred", "score", "row", "word", "c", "block", "shard")


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and values, repeated rows, an id with several texts, and columns with the operators' own names."""
    rows = [(None, "null id one two three", None, None), (None, None, "en", "s"), (None, "again again", "en", "s"), (None, "again again", "en", "s"), (5, "a b c d e f g", "en", "s"), (5, "a b c d e f g", "en", "s"), (5, "other text of this id", "de", ""), (6, None, None, None), (7, "", "de", "s"), (8, "A B c d e f g", "de", "t"), (1 << 60, "x " * 3000, "en", "s")]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame([(*r, *["clash"] * len(CLASHES)) for r in rows], schema).repartition(3)


def test_odd_rows_stay_rows(spark, odd):
    n = odd.count()
    labels = spark.createDataFrame([(5, 1, "q"), (7, 0, "q"), (8, 0, "q"), (None, 1, "q"), (8, 1, "q")], "doc_id long, toxic int, text string")
    model = toxicity.train(odd, labels)
    for out in (exact_dedup.exact_duplicates(odd), minhash.near_duplicates(odd), toxicity.toxicity_scores(odd, model), ctw.lm_scores(odd, odd), langid.predict_language(odd, langid.train(odd)), tokencount.document_token_counts(odd), mixing.mix_weights(odd)):
        assert out.count() == n
        assert sum(r["doc_id"] is None for r in out.select("doc_id").collect()) == 4
        assert (1 << 60) in {r["doc_id"] for r in out.select("doc_id").collect()}
    assert packing.best_fit_pack(odd).where("piece = 0").count() == n
    assert sum(len([p for p in r["pieces"] if p == 0]) for r in tokenout.packed_matrices(odd).collect()) == n
    assert {r["n_tokens"] for r in tokencount.document_token_counts(odd).where("doc_id = 7 or doc_id = 6").collect()} == {0}


def test_odd_rows_through_the_filters(spark, odd):
    texts = Counter(r["text"] or "" for r in exact_dedup.drop_exact_duplicates(odd).collect())
    assert set(texts.values()) == {1} and set(texts) == {r["text"] or "" for r in odd.collect()}
    near = minhash.drop_near_duplicates(odd)
    assert near.columns == odd.columns and near.where("doc_id is null").count() == 4
    assert {r["doc_id"] for r in near.where("doc_id is not null").collect()} == {5, 6, 7, 1 << 60}
    assert mixing.mix_documents(odd, budget_share=1.0, powers={"source": 1.0, "lang": 1.0, "topic": 1.0}).columns == odd.columns
    model = toxicity.train(odd, spark.createDataFrame([(5, 1), (7, 0)], "doc_id long, toxic int"))
    assert toxicity.drop_toxic(odd, model).columns == odd.columns


def test_pipeline_stages_on_odd_and_empty_tables(spark, odd, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (odd, odd.limit(0)):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "packing":
                assert out.columns == docs.columns
                docs = out
            else:
                assert out.where("piece = 0").count() == docs.count()
    odd.drop("__digest").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).columns[:2] == ["doc_id", "piece"]


def test_mixing(docs, none):
    rows = mixing.mix_weights(docs, 0.5).collect()
    assert len(rows) == docs.count() and {r["__source"] for r in rows} >= {"(none)", "src0"}
    total = sum(r["__tokens"] for r in rows)
    assert sum(r["__tokens"] * r["__probability"] for r in rows) == pytest.approx(total * 0.5, rel=1e-6)
    other = {r["doc_id"]: r for r in mixing.mix_weights(docs, 0.5, most_cells=0).collect()}
    assert all(abs(r["__probability"] - other[r["doc_id"]]["__probability"]) < 1e-3 for r in rows)
    assert mixing.mix_weights(none).count() == 0
    assert mixing.mix_documents(docs).columns == docs.columns


def test_mixing_is_the_same_for_many_cells(spark):
    rng = np.random.default_rng(14)
    rows = [(i, "w " * int(rng.integers(1, 40)), f"s{i % 4}", f"l{rng.integers(0, 3)}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").coalesce(1)
    for given in ({"source": {"nowhere": 1.0}}, {"source": {"s0": 5, "s1": 1, "s2": -1, "s3": 2}}):
        few, many = ({r["doc_id"]: r["__probability"] for r in mixing.mix_weights(df, 0.3, given=given, most_cells=n).collect()} for n in (200_000, 0))
        assert len(few) == 200 and max(few.values()) > 0
        assert all(abs(p - many[i]) < 1e-6 for i, p in few.items())


def test_mixing_describes_whole_texts(spark):
    texts = ["", None, " \t\n", "a b\x0bc\rd  e", "é ü\xa0ñ 1", "12 34", "w " * 99, "w " * 100, "w " * 1000, "x licensed under y " * 300, "٣ ٤ ٥"]

    def kind(t):
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t))
        many = sum(c in "0123456789" for c in t) * 20 > len(t)
        return n, "notice" if "icensed under" in t else "record" if many else "note" if n < 100 else "article" if n < 1000 else "long"

    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, source string").coalesce(1)
    got = {r["doc_id"]: (r["__tokens"], r["__topic"], r["__crc"]) for r in mixing.described(df, ["doc_id"]).collect()}
    assert got == {i: (*kind(t or ""), zlib.crc32((t or "").encode())) for i, t in enumerate(texts)}


def test_mixing_is_rake_probability_and_draw_from_end_to_end(docs, texts):
    given = {"lang": {"en": 3.0, "de": 1.0, "(none)": 1.0}}
    rows = mixing.mix_weights(docs, 0.4, given=given).collect()
    cells = defaultdict(int)
    for r in rows:
        cells[r["__source"], r["__lang"], r["__topic"]] += r["__tokens"]
    keys, total = sorted(cells), sum(cells.values())
    x = {k: cells[k] / total for k in keys}
    for _ in range(300):
        for axis, power in enumerate((0.7, None, 0.7)):
            share = defaultdict(float)
            have = defaultdict(float)
            for k in keys:
                share[k[axis]] += cells[k] / total
                have[k[axis]] += x[k]
            goal = {v: given["lang"].get(v, 0) if power is None else s**power if s else 0 for v, s in share.items()}
            x = {k: x[k] * goal[k[axis]] / sum(goal.values()) / have[k[axis]] if have[k[axis]] else 0 for k in keys}
    low, high = 0.0, 1e12
    for _ in range(300):
        c = (low + high) / 2
        low, high = (c, high) if sum(min(cells[k], c * x[k]) for k in keys) < 0.4 * total else (low, c)
    for r in rows:
        k = r["__source"], r["__lang"], r["__topic"]
        assert r["__probability"] == pytest.approx(min(1, c * x[k] / cells[k]) if cells[k] else 0, rel=1e-4, abs=1e-9)
        assert r["__sampled"] <= (r["__probability"] > 0)
    assert sorted(r["doc_id"] for r in mixing.mix_documents(docs, budget_share=0.4, given=given).collect()) == sorted(r["doc_id"] for r in rows if r["__sampled"])


def test_rake_meets_both_marginals():
    rng = np.random.default_rng(5)
    tokens, codes = rng.random(24) + 0.1, [np.arange(24) // 6, np.arange(24) % 6]
    targets = [np.array([0.1, 0.2, 0.3, 0.4]), np.full(6, 1 / 6)]
    x = mixing.rake(tokens, codes, targets)
    assert all(np.allclose(np.bincount(c, x), t) for c, t in zip(codes, targets, strict=True))
    p = mixing.probabilities(tokens, x, tokens.sum() * 0.4)
    assert (p * tokens).sum() == pytest.approx(tokens.sum() * 0.4) and p.max() <= 1


def test_lm_scores(docs, none, texts):
    words = {i * 3: re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())) for i, t in enumerate(texts)}
    train = docs.where("doc_id % 2 = 0")
    c = Counter()
    for i, w in words.items():
        if i % 2 == 0:
            c.update([*w, None])
    n, v = sum(c.values()), len(c)
    got = ctw.lm_scores(docs, train).collect()
    assert len(got) == len(texts)
    for r in got:
        w = [*words[r["doc_id"]], None]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert r["score"] < 0
    assert ctw.lm_scores(none, train).count() == 0
    assert all(r["n_known"] == 0 for r in ctw.lm_scores(docs, none).collect())


def test_context_tree_is_a_distribution_and_the_weighted_mixture():
    rng = np.random.default_rng(6)
    data = bytes(rng.choice(list(b"abra"), 400))
    levels = []
    for d in range(3):
        c = Counter()
        for i in range(len(data)):
            c[int.from_bytes(bytes(d - len(data[max(0, i - d) : i])) + data[max(0, i - d) : i], "big") if d else 0, data[i]] += 1
        keys = sorted(c)
        levels.append((np.array([k[0] for k in keys]), np.array([k[1] for k in keys]), np.array([c[k] for k in keys])))
    tree = ctw.build_tree(levels)
    assert np.allclose((10.0 ** tree.logp.astype(float)).sum(1), 1, atol=1e-4)
    # one decision by hand: the first bit after the context "b" of depth 1, with depth 2 below

    def kt(z, o):
        return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - 2 * math.lgamma(0.5)

    for z, o in ((0, 0), (3, 0), (7, 11), (1000, 3)):
        block, p = ctw._kt(np.array([[z if b == 0 else o if b == 128 else 0 for b in range(256)]], float))
        assert block[0, 1] == pytest.approx(kt(z, o), abs=1e-8) and p[0, 1] == pytest.approx((o + 0.5) / (z + o + 1))


def test_the_weighted_mixture_by_brute_force(spark):
    """Block probabilities of a context tree, weighted node by node, against the scores of the same texts."""
    rng = np.random.default_rng(13)
    own = ["".join(rng.choice(list("ab"), rng.integers(1, 7))) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").repartition(2)
    depth = 2
    seen = Counter((bytes(depth) + t.encode() + b"\0")[i : i + depth + 1] for t in own[::2] for i in range(len(t) + 1))

    def kt(z, o):
        return math.exp(math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - 2 * math.lgamma(0.5))

    def weighted(context, prefix, extra):
        """Probability of all decisions after `prefix` bits in the contexts that end in `context`; extra: one more run."""
        runs = [*seen.elements(), *extra]
        bits = [f"{r[-1]:08b}" for r in runs if r[:-1].endswith(context)]
        after = [b[len(prefix)] for b in bits if b.startswith(prefix)]
        block = kt(after.count("0"), after.count("1"))
        if len(context) == depth:
            return block
        deeper = {r[depth - len(context) - 1 : depth] for r in runs if r[:-1].endswith(context)}
        return 0.5 * block + 0.5 * math.prod(weighted(c, prefix, extra) for c in deeper)

    got = {r["doc_id"]: r["score"] for r in ctw.lm_scores(df, df.where("doc_id % 2 = 0"), depth=depth).collect()}
    for i in (0, 2, 4):
        t = own[i]
        want = 0.0
        for j in range(len(t) + 1):
            run = (bytes(depth) + t.encode() + b"\0")[j : j + depth + 1]
            bits = f"{run[-1]:08b}"
            for b in range(8):
                want += math.log10(weighted(b"", bits[:b], [run]) / weighted(b"", bits[:b], []))
        assert got[i] == pytest.approx(want, rel=1e-4)


@pytest.mark.parametrize("head", [1 << 21, 40])
def test_lm_scores_keep_every_context(spark, monkeypatch, head):
    rng = np.random.default_rng(12)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 10))) for _ in range(6000)]
    own = [" ".join(rng.choice(words, 60)) for _ in range(400)] + ["", "zz"]
    df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").repartition(3)
    counts = [Counter() for _ in range(6)]
    runs = lambda t: [(bytes(5) + t.encode() + b"\0")[i : i + 6] for i in range(len(t) + 1)]
    for t in own[::2]:
        for g in runs(t):
            for d in range(6):
                counts[d][int.from_bytes(g[5 - d : 5], "big"), g[5]] += 1
    assert len({k[0] for k in counts[5]}) > 1 << 15  # more contexts than the driver's table once held
    tree = ctw.build_tree([(np.array([k[0] for k in c]), np.array([k[1] for k in c]), np.array(list(c.values()))) for c in counts])

    monkeypatch.setattr(ctw, "HEAD_RUNS", head)
    monkeypatch.setattr(ctw, "CHUNK", 5000)
    got = {r["doc_id"]: r["score"] for r in ctw.lm_scores(df, df.where("doc_id % 2 = 0")).collect()}
    for i, t in enumerate(own):
        codes = np.frombuffer(t.encode() + b"\0", np.uint8)
        want = tree.byte_scores(codes, ctw.before(codes, np.array([0, len(codes)]), 5)).astype(float).sum()
        assert got[i] == pytest.approx(want, rel=1e-5)


def test_token_counts(docs, none, texts):
    ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ref.encode_special_tokens = True
    want = {i * 3: len(ref.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    for block in (64, 1 << 18):
        assert {r["doc_id"]: r["n_tokens"] for r in tokencount.document_token_counts(docs, block=block).collect()} == want
    assert tokencount.document_token_counts(none).count() == 0


def test_separator_scan_of_files(spark, tmp_path):
    ids = [5, 9, 7, 9, 9, 1, 2, 3, 4, 9, 8]
    (tmp_path / "a.bin").write_bytes(np.array(ids, "<u2").tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    blocks = tokencount.file_blocks(spark, str(tmp_path), 2, 3)
    assert {r["shard"].rsplit("/", 1)[1] for r in blocks.collect()} == {"a.bin"} and blocks.count() == 4
    got = sorted((r["ordinal"], r["n_tokens"], r["open"]) for r in tokencount.separator_scan(blocks, 9, 3).collect())
    assert got == [(0, 1, False), (1, 1, False), (2, 0, False), (3, 4, False), (4, 1, True)]


def test_language(spark, none):
    rng = np.random.default_rng(8)
    make = lambda ws: " ".join(rng.choice(ws, 30))
    a, b = ["the", "and", "thing", "with"], ["der", "und", "nicht", "schon"]
    rows = [(i, make(a if i % 2 else b), "en" if i % 2 else "de") for i in range(300)] + [(900, None, "en"), (901, "123 !!", "en"), (902, "", None), (903, "ab", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df.where("doc_id % 5 <> 0"))
    got = {r["doc_id"]: r for r in langid.predict_language(df, model).collect()}
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "de") for i in range(300))
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[903]["lang_pred"] in ("en", "de")
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.predict_language(df, langid.train(none)).where("lang_pred <> 'und'").count() == 0
    assert langid.predict_language(none, model).count() == 0


def test_toxicity_learns_a_pair_whose_terms_tell_little_alone():
    """A mention as frequent in both classes, among more terms that lean to a class by chance than a short list holds."""
    rng, n = np.random.default_rng(1), 6000
    kind = rng.choice(5, n, p=(0.2, 0.2, 0.2, 0.3, 0.1))  # insult and mention, insult alone, another insult, mention alone, neither
    toxic, held = (kind == 0) | (kind == 2), ((1, 2), (1,), (3,), (2,), ())
    terms = [np.unique([*rng.integers(10, 20000, 60), *held[i]]) for i in kind]
    y, half = toxic.astype(float), n // 2
    row, bucket = np.repeat(np.arange(n), [len(x) for x in terms]), np.concatenate(terms)
    learn = row < half
    model = toxicity.fit(row[learn], bucket[learn], np.ones(learn.sum(), int), y[:half], np.full(half, 1 / half), 0.0, 8, 100, 7, 3e-3, 6.0, 24.0)
    on = np.isin(bucket, model.terms)
    got = model.scores(row[on], np.searchsorted(model.terms, bucket[on]), np.ones(on.sum(), int), n) >= 0.5
    assert {1, 2} <= set(model.terms) and (got[half:] != toxic[half:]).mean() < 0.01
    where = np.unique(bucket[learn], return_inverse=True)
    alone, paired = (toxicity.term_evidence(row[learn], where[1], y[:half], len(where[0]), 6.0, joint) for joint in (np.inf, 24.0))
    assert alone[where[0] == 2] == 0 and paired[where[0] == 2] > 20


def test_toxicity_without_terms_that_tell():
    model = toxicity.fit(np.arange(8), np.arange(8), np.ones(8, int), np.array([0, 1] * 4), np.full(8, 0.125), -1.0, 8, 100, 7, 3e-3, 6.0, 24.0)
    assert len(model.terms) == 0 and model.scores(np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), 2) == pytest.approx([1 / (1 + np.e)] * 2)


def test_toxicity(spark, none):
    rng = np.random.default_rng(9)
    rows, labels = [], []
    for i in range(600):
        words, y = list(rng.choice(WORDS, 40)), int(i % 5 == 0)
        if y:
            words[7], words[20] = ("vile" + rng.choice(["", "ly", "ness"])), "groupx"
        elif i % 3 == 0:
            words[5] = "groupx"
        rows.append((i, " ".join(words)))
        labels.append((i, y))
    df = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (1000, None), (5000, 1)], "doc_id long, toxic int")
    model = toxicity.train(df, lab.where("doc_id % 4 <> 0"))
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(df, model).collect()}
    assert np.mean([got[i]["predicted"] == y for i, y in labels if i % 4 == 0]) > 0.98
    assert got[1000]["score"] == got[1001]["score"] and got[1000]["predicted"] == 0
    empty = toxicity.train(df, lab.where("toxic = 0"))
    assert toxicity.toxicity_scores(df, empty).where("predicted = 1").count() == 0
    assert toxicity.toxicity_scores(none, model).count() == 0
    assert toxicity.drop_toxic(df, model).count() == sum(r["predicted"] == 0 for r in got.values())


def test_matrices(docs, none, texts):
    ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ref.encode_special_tokens = True
    parts = defaultdict(dict)
    lines = tokenout.packed_matrices(docs, chunk=20000).collect()
    assert len({r["sequence_id"] for r in lines}) == len(lines)
    for r in lines:
        ids, pos, cu = np.frombuffer(r["input_ids"], "<u4"), np.frombuffer(r["position_ids"], "<u4"), r["cu_seqlens"]
        assert len(ids) == 2048 and cu[0] == 0 and cu[-1] == r["n_tokens"] <= 2048
        for doc, piece, start, a, b in zip(r["doc_ids"], r["pieces"], r["starts"], cu[:-1], cu[1:], strict=True):
            parts[doc][piece] = (start, ids[a:b].tolist())
            assert pos[a:b].tolist() == list(range(b - a))
    for i, t in enumerate(texts):
        own = [parts[i * 3][k] for k in range(len(parts[i * 3]))]
        assert sum((x for _, x in own), []) == [*ref.encode(t or "", add_special_tokens=False).ids, 0]
    assert tokenout.packed_matrices(none).count() == 0


def test_segment_tree_is_best_fit():
    rng = np.random.default_rng(10)
    lengths = rng.integers(1, 101, 300)
    room, want = [], 0
    for n in sorted(lengths.tolist(), reverse=True):
        fit = min((r for r in room if r >= n), default=None)
        if fit is None:
            room.append(100 - n)
        else:
            room[room.index(fit)] = fit - n
    want = len(room)
    lines = tokenout.best_fit_decreasing(lengths, 100)
    assert len(lines) == want and sorted(i for x in lines for i in x) == list(range(300))


def test_pipeline_stages(spark):
    import os

    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for (name, stage), check in zip(corpus_pipeline.STAGES, ("toxic", "exact", "near", "mix", "pack"), strict=True):
        out = stage(spark, docs, sf)
        if check == "pack":
            assert {r[0] for r in out.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.collect()}
            break
        before, after = {r["doc_id"]: r for r in docs.collect()}, {r["doc_id"] for r in out.collect()}
        assert out.columns == docs.columns and after <= set(before), name
        if check == "exact":
            last = {r["text"]: max(i for i, x in before.items() if x["text"] == r["text"]) for r in before.values()}
            assert after == set(last.values())
        if check == "near":
            ids = sorted(before)
            assert after == {ids[c] for _, c in brute_components([before[i]["text"] for i in ids], 5, 80)}
        docs = spark.createDataFrame([before[i] for i in sorted(after)], docs.schema)
