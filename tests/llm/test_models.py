"""Classifiers by held-out accuracy, mixing against a dense solution, packing against a plain search, and the pipeline's parts."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftline.llm import langid, mixing, packing, subword, textnum, toxicity

WORDS = {"aa": "the of and ing tion her".split(), "bb": "der die und ung keit sch".split()}


def prose(rng, lang, n=60):
    return " ".join("".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_languages(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, lang), lang, "x") for i, lang in enumerate(["aa", "bb"] * 60)]
    schema = "doc_id long, text string, lang string, score string"
    model = langid.fit_languages(spark.createDataFrame(rows, schema))
    odd = [(1000, None, None, ""), (1001, "", None, ""), (1002, "123 !?", None, ""), (1003, "ж", None, ""), (None, prose(rng, "aa"), None, ""), (1004, prose(rng, "bb", 20000), None, "")]
    held = [(2000 + i, prose(rng, lang), lang, "") for i, lang in enumerate(["aa", "bb"] * 20)]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(odd + held, schema), model, ["doc_id"]).collect()}
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1000]["score"] == 0
    assert got[1003]["lang_pred"] in ("aa", "bb") and got[None]["lang_pred"] == "aa" and got[1004]["lang_pred"] == "bb"
    assert sum(got[i]["lang_pred"] == lang for i, _, lang, _ in held) >= 38
    assert all(0 <= r["score"] <= 1 for r in got.values())
    empty = spark.createDataFrame([], schema)
    assert langid.fit_languages(empty) is None and langid.identify(empty, model, ["doc_id"]).count() == 0
    assert {r["lang_pred"] for r in langid.identify(spark.createDataFrame(held, schema), None, ["doc_id"]).collect()} == {"und"}


def test_pieces_do_not_change_scores(monkeypatch):
    rng = random.Random(2)
    texts = [prose(rng, "aa", 300), "", prose(rng, "bb", 5)]
    model = subword.Model(["a", "b"], np.random.default_rng(0).standard_normal((1 << 17, 2)).astype(np.float32), np.zeros(2), 17)
    flat = textnum.flat(pa.array(texts))
    before = subword.text_logits(model, *flat), subword.bag_scores(model.table[:, 1].astype(float), *flat, 17)
    monkeypatch.setattr(subword, "PIECE", 97)
    after = subword.text_logits(model, *flat), subword.bag_scores(model.table[:, 1].astype(float), *flat, 17)
    assert all(np.allclose(a, b) for a, b in zip(before, after, strict=True))


def test_toxicity(spark):
    rng = random.Random(3)
    bad = lambda: "grumb" + rng.choice("abcdefgh") + rng.choice("xyz")  # noqa: E731  a family of spellings, many unseen

    def text(toxic, n=120):
        words = prose(rng, rng.choice(["aa", "bb"]), n).split()
        if toxic:
            words[rng.randrange(len(words))] = bad()
        return " ".join(words)

    docs = [(i, text(i % 3 == 0), i % 3 == 0) for i in range(600)]
    frame = spark.createDataFrame([(i, t, 1) for i, t, _ in docs], "doc_id long, text string, predicted int")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in docs if i < 400] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(frame, labels)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(frame, model, ["doc_id"]).collect()}
    assert sum(got[i] == y for i, _, y in docs if i >= 400) >= 196
    kept = toxicity.drop_toxic(frame, model)
    assert kept.columns == frame.columns and kept.count() == 600 - sum(got.values())
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "grumbax " + "the " * 20000), (None, "the")], "doc_id long, text string")
    assert {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(odd, model, ["doc_id"]).collect()} == {1: 0, 2: 0, 3: 1, None: 0}
    assert toxicity.fit_toxicity(frame, labels.where("toxic = 0")) is None
    assert {r["predicted"] for r in toxicity.score_toxicity(odd, None, ["doc_id"]).collect()} == {0}
    assert toxicity.score_toxicity(odd.limit(0), model, ["doc_id"]).count() == 0


def test_pooled_bags_against_a_plain_loop():
    rng = np.random.default_rng(6)
    owner = np.sort(rng.integers(0, 9, 70))
    total, count = rng.standard_normal(70), rng.integers(1, 5, 70).astype(float)
    got = subword.pooled(total, count, owner, 10, 4)
    for t in range(10):
        mine = np.flatnonzero(owner == t)
        if not len(mine):
            assert [g[t] for g in got] == [0, 0, 0]
            continue
        spans = [mine[i : i + 4] for i in range(max(1, len(mine) - 3))]
        want = [max(total[mine] / count[mine]), max(total[s].sum() / count[s].sum() for s in spans), total[mine].sum() / count[mine].sum()]
        assert np.allclose([g[t] for g in got], want)


@pytest.mark.parametrize("sf", ["sf0.1"])
def test_toxicity_on_held_out_rows(spark, sf):
    """Fold 0 of 5 of the test tables, which nothing is learned from."""
    found = toxicity.op4_toxicity(spark, f"/root/testdata/{sf}").where("held_out")
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet").where("toxic is not null").groupBy("doc_id").agg({"toxic": "max"})
    both = [(r["predicted"], r["max(toxic)"]) for r in found.join(labels, "doc_id").collect()]
    right, said, all_ = sum(p and y for p, y in both), sum(p for p, _ in both), sum(y for _, y in both)
    assert right >= 0.85 * said and right >= 0.7 * all_, (right, said, all_)


def test_texts_toxic_only_by_a_combination_of_words(spark):
    """No word tells: each is in as many texts of either label, but two of one kind together mark a text."""
    rng = random.Random(9)
    mild, calm = ["zork", "blip", "quax", "frum"], ["soft", "kind", "nice", "warm"]
    rows = []
    for i in range(900):
        toxic = i % 2
        words = prose(rng, "aa", 10).split()
        words[3:3] = rng.sample(mild, 4) if toxic else [rng.choice(mild), *rng.sample(calm, 3)]
        rows.append((i, " ".join(words), toxic))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit_toxicity(frame, frame.where("doc_id < 700").select("doc_id", "toxic"))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(frame.where("doc_id >= 700"), model, ["doc_id"]).collect()}
    assert sum(got[i] == y for i, _, y in rows[700:]) >= 180


def test_samples_have_a_bound(spark):
    from pyspark.sql import functions as F

    from driftline.llm.classify import pairs, sample_per_class, texts_of

    rows = spark.range(50_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"), F.lit("x").alias("c"))
    assert 3000 < sample_per_class(rows, "doc_id", "c", 4000, "text").count() <= 4000
    same = rows.withColumn("text", F.lit("t")).union(rows.limit(10).withColumn("c", F.lit("y")))
    got = {r["c"]: r["count"] for r in sample_per_class(same, "doc_id", "c", 4000, "text").groupBy("c").count().collect()}
    assert got.get("x", 0) <= 1 and got["y"] == 10
    assert sample_per_class(rows, "doc_id", "c", 4000).count() <= 1  # without texts all these rows are the same
    docs = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"))
    chosen = spark.createDataFrame([(7, "x")], "id long, c string")
    assert pairs(texts_of(docs, chosen, "doc_id", "text"), "id", "text", "c")[1] == ["x"]


def test_letters_are_those_of_unicode():
    texts = ["½²", "123 !?", "ⅷ", "ж", "ª", "a", "", "中", "①"]
    assert langid.has_letter(*textnum.flat(pa.array(texts))).tolist() == [False, False, False, True, True, True, False, True, False]


def test_rejection_is_calibrated(spark):
    rng = random.Random(11)
    rows = [(i, prose(rng, lang), lang) for i, lang in enumerate(["aa", "bb"] * 100)]
    model = langid.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    odd = [(i, " ".join(rng.choice(["qxz", "zzkw", "wqk"]) for _ in range(20))) for i in range(20)] + [(100 + i, t) for i, t, _ in rows[:20]]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(odd, "doc_id long, text string"), model, ["doc_id"]).collect()}
    assert all(r["rejected"] == (r["score"] < model.threshold) for r in got.values())
    assert sum(got[100 + i]["rejected"] for i in range(20)) <= 2
    assert np.mean([got[i]["score"] for i in range(20)]) < np.mean([got[100 + i]["score"] for i in range(20)])


def test_rates_match_a_dense_solution(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.4, 0.4, 0.4], 200)
    tokens = rng.integers(0, 500, 200)
    goal = np.array([0.2, 0.3, 0.5])
    rows = [(i, int(n), [float(x) for x in q]) for i, (n, q) in enumerate(zip(tokens, p, strict=True))]
    frame = spark.createDataFrame(rows, "doc_id long, n_tokens long, p array<double>")
    got = np.array([r["rate"] for r in mixing.fit_rates(frame, goal, ridge=0.01).orderBy("doc_id").collect()])
    share = (tokens / tokens.sum())[:, None] * p
    r = np.ones(200)
    for _ in range(20000):
        r = np.maximum(0, r - 0.5 * (p @ (share.T @ r - goal) + 0.01 * (r - 1)))
    assert (got >= 0).all() and np.abs(share.T @ got - share.T @ r).max() < 2e-3
    assert np.abs(share.T @ got - goal).max() < 0.02
    assert mixing.fit_rates(frame.limit(0), goal).count() == 0


def test_copies(spark):
    docs = spark.createDataFrame([(1, "a", "s"), (2, "b", "s"), (3, "c", "s"), (None, "d", "s")], "doc_id long, text string, copies string")
    mixed = spark.createDataFrame([(1, 0), (2, 2), (3, 1)], "doc_id long, copies long")
    out = mixing.apply_mix(docs, mixed)
    assert out.columns == docs.columns and sorted(r["text"] for r in out.collect()) == ["b", "b", "c", "d"]
    clash = mixing.apply_mix(docs.toDF("doc_id", "__id", "__copy").withColumn("copy", F.lit(1)).withColumn("id", F.lit(2)), mixed)
    assert clash.columns == ["doc_id", "__id", "__copy", "copy", "id"] and clash.count() == 4
    twice = mixing.mix(docs.union(docs), None, {})
    assert twice.count() == 8 and {r["copies"] for r in twice.collect()} == {1}
    whole = mixing.mix(docs, None, {})
    assert sorted((r["n_tokens"], r["domain"]) for r in whole.collect()) == [(1, "all")] * 4
    with_odd = spark.createDataFrame([(1, None), (2, ""), (3, " x\ty ")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in mixing.memberships(with_odd, None, ["doc_id"]).collect()} == {1: 0, 2: 0, 3: 2}


def plain_best_fit(items, capacity):
    bins, out = [], [None] * len(items)
    for i in sorted(range(len(items)), key=lambda i: -items[i][0]):
        size, source, cluster = items[i]
        fit = [b for b in bins if b["room"] >= size and (source is None or source not in b["s"]) and (cluster is None or cluster not in b["c"])]
        if fit:
            b = min(fit, key=lambda b: (b["room"], b["since"]))
        else:
            b = {"room": capacity, "s": set(), "c": set(), "id": len(bins)}
            bins.append(b)
        out[i] = (b["id"], capacity - b["room"])
        b["room"] -= size
        b["since"] = i_order = plain_best_fit.clock = plain_best_fit.clock + 1
        assert i_order
        b["s"].add(source)
        b["c"].add(cluster)
    return out


plain_best_fit.clock = 0


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_is_the_plain_one(seed):
    rng = random.Random(seed)
    items = [(rng.randint(1, 64), rng.choice([None, *"abcdefgh"]), rng.choice([None, 1, 2, 3, 4, 5])) for _ in range(300)]
    assert packing.best_fit(items, 64) == plain_best_fit(items, 64)


def test_packing(spark):
    rng = random.Random(6)
    docs = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 7, 30, 150]))) or None, f"s{rng.randrange(3)}", "x") for i in range(200)] + [(500, "same text", "s0", "x"), (500, "same text", "s0", "x"), (None, "a b", None, "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, bin_id string")
    rows = packing.pack(frame, capacity=64, shard=50).collect()
    total = sum(len((t or "").split()) for _, t, *_ in docs)
    assert sum(r["n_tokens"] for r in rows) == total
    assert len({(r["doc_id"]) for r in rows}) == len({d for d, *_ in docs})
    bins = {}
    for r in rows:
        assert (r["bin_id"] is None) == (r["n_tokens"] == 0)
        if r["bin_id"] is not None:
            bins.setdefault(r["bin_id"], []).append(r)
    for pieces in bins.values():
        pieces.sort(key=lambda r: r["bin_offset"])
        assert [r["bin_offset"] for r in pieces] == [sum(q["n_tokens"] for q in pieces[:k]) for k in range(len(pieces))]
        assert sum(r["n_tokens"] for r in pieces) <= 64
        sources = [r["source"] for r in pieces if r["source"] is not None]
        assert len(sources) == len(set(sources))
    assert packing.pack(frame.limit(0)).count() == 0


def test_mix_by_punctuation_reaches_its_targets(spark):
    rng = random.Random(7)

    def text(low, n=80):
        words = prose(rng, "aa", n).split()
        return " ".join(w + rng.choice(["###", "%%%", "|"]) if low and rng.random() < 0.5 else w for w in words)

    docs = [(i, text(i % 5 == 0), "low" if i % 5 == 0 else "high") for i in range(800)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, quality string")
    model = mixing.fit_domains(frame, frame.where("doc_id < 500"), "quality")
    mixed = mixing.mix(frame, model, mixing.TARGETS)
    held = {r["doc_id"]: r for r in mixed.collect() if r["doc_id"] >= 500}
    assert sum(r["domain"] == docs[i][2] for i, r in held.items()) >= 290
    shares = {r["domain"]: r for r in mixing.reached(mixed, model.labels, mixing.TARGETS).collect()}
    assert all(abs(r["expected"] - r["target"]) < 0.01 and abs(r["copied"] - r["target"]) < 0.05 for r in shares.values())
    low = [r["copies"] for i, r in held.items() if docs[i][2] == "low"]
    assert sum(low) < len(low) / 2  # the mix leaves most of them out


def test_query_targets_are_not_the_natural_shares(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    counts = {r["quality"]: r["count"] for r in labels.groupBy("quality").count().collect()}
    assert abs(counts[0] / (counts[0] + counts[1]) - mixing.TARGETS["low"]) > 0.05
    model = mixing.fit_from_tables(spark, "/root/testdata/sf0.01")
    mixed = mixing.mix(docs, model, mixing.TARGETS)
    assert all(abs(r["expected"] - r["target"]) < 0.01 for r in mixing.reached(mixed, model.labels, mixing.TARGETS).collect())


def test_unattainable_targets_are_told(spark):
    rng = random.Random(12)
    rows = [(i, prose(rng, lang), lang) for i, lang in enumerate(["aa", "bb"] * 60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, d string")
    model = mixing.fit_domains(frame, frame, "d")
    targets = {"aa": 0.5, "bb": 0.3, "cc": 0.2}
    told = {r["domain"]: r for r in mixing.reached(mixing.mix(frame, model, targets), model.labels, targets).collect()}
    assert told["cc"]["target"] == 0.2 and told["cc"]["copied"] == 0.0
    assert abs(told["aa"]["target"] - 0.625) < 1e-9 and abs(told["aa"]["expected"] - 0.625) < 0.02


def test_pieces_of_long_texts_are_spread(spark):
    docs = [(i, "w " * 64 * 500, "s") for i in range(8)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = packing.pack(frame, capacity=64, shard=256).collect()
    assert len(rows) == 4000
    shards = {}
    for r in rows:
        shards.setdefault(r["bin_id"] >> 32, []).append(r)
    assert len(shards) == 16 and max(map(len, shards.values())) < 400
    assert sorted((r["doc_id"], r["piece"]) for r in rows) == [(d, p) for d in range(8) for p in range(500)]


def test_packing_does_not_depend_on_partitions(spark):
    rng = random.Random(3)
    docs = [(i % 90, " ".join("w" for _ in range(rng.choice([3, 30, 90]))), f"s{i % 4}") for i in range(200)]
    frame = spark.createDataFrame(docs + docs[:40], "doc_id long, text string, source string")
    a, b = (sorted(map(str, packing.pack(frame.repartition(n), 64, 50).collect())) for n in (1, 7))
    assert a == b
    assert packing.pack(frame.drop("source"), 64, 50).count() == len(a)


def test_languages_of_held_out_rows(spark):
    """Fold 2 of 4 of the test tables, which nothing is learned from."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("lang is not null").select("doc_id", "lang")
    found = langid.op2_langid(spark, "/root/testdata/sf0.1").where("held_out and lang_pred != 'und'")
    got = [r["lang"] == r["lang_pred"] for r in found.join(docs, "doc_id").collect()]
    assert len(got) > 1000 and np.mean(got) > 0.95, np.mean(got)


def test_a_sample_of_long_texts_has_a_bound_in_bytes(spark):
    from driftline.llm.classify import pairs

    rows = spark.range(400).select(F.col("id"), F.when(F.col("id") < 10, "rare").otherwise("many").alias("c"), F.concat(F.col("id").cast("string"), F.lit(" "), F.repeat(F.lit("ж"), 1000)).alias("text"))
    (text, offsets), classes = pairs(rows, "id", "text", "c", most=100_000)
    assert 97_000 < len(text) <= 100_000 and len(classes) == len(offsets) - 1
    assert classes.count("rare") == 10  # the others make room
    (text, _), classes = pairs(rows, "id", "text", "c", {"rare": 1, "many": 9}, most=100_000)
    assert len(text) <= 100_000 and 3 <= classes.count("rare") <= 6
    assert len(pairs(rows, "id", "text", "c")[1]) == 400
    assert pairs(rows, "id", "text", "c", most=10)[1] == []


def test_training_holds_a_bounded_number_of_ngrams(monkeypatch):
    rng = np.random.default_rng(3)
    size, many = 8000, 800
    drawn = rng.integers(97, 123, size * many).astype(np.uint8)
    drawn[::9] = 32  # few words repeat, so nearly every n-gram of a text is another
    texts, labels = (drawn, np.arange(many + 1) * size), np.arange(many) % 2
    whole = subword.train_texts(texts, labels, ["a", "b"], epochs=1, punctuation=True)
    monkeypatch.setattr(subword, "KEPT", 100_000, raising=False)
    tracemalloc.start()
    model = subword.train_texts(texts, labels, ["a", "b"], epochs=1, punctuation=True)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60e6, most  # over 100 MB with the n-grams of all texts; the embeddings alone take up to 40
    assert np.array_equal(model.table, whole.table) and np.array_equal(model.bias, whole.bias) and model.temperature == whole.temperature
