"""Near duplicates, repeated passages and vectors against brute force, and on unpleasant rows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from driftline.llm import embedding_dedup, minhash, substring_dedup, textnum
from driftline.llm.components import components

LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def words_of(t, lower=True):
    t = t or ""
    return re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER) if lower else t)


def root_of(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def corpus(seed=5, families=12, size=8):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    texts = []
    for f in range(families):
        original = [word() for _ in range(rng.choice([3, 30, 120]))]
        for _ in range(size):
            copy = list(original)
            for _ in range(rng.randint(0, max(1, len(copy) // 40))):
                copy[rng.randrange(len(copy))] = word()
            texts.append((" " if rng.random() < 0.5 else "\n").join(copy))
    texts += [None, "", "   ", "one", "One", "two words", texts[0].upper(), "x " * 5000]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_words_match_a_regular_expression():
    texts = ["a\tb  c", "", " lead", "trail ", "é\x0bü", "x" * 10, "a", "b"]
    text, offsets = textnum.flat(pa.array(texts))
    starts, ends, first = textnum.words(text, offsets)
    raw = text.tobytes()
    got = [[raw[s:e].decode() for s, e in zip(starts[a:b], ends[a:b], strict=True)] for a, b in zip(first[:-1], first[1:], strict=True)]
    assert got == [words_of(t, lower=False) for t in texts]


def test_superminhash_estimates_jaccard():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 300, dtype=np.uint64)
    b = np.concatenate([a[:200], rng.integers(0, 2**63, 100, dtype=np.uint64)])
    signed = minhash.superminhash(np.concatenate([a, b, a[:1]]), np.array([0, 300, 600, 601]), 256)
    assert abs((signed[0] == signed[1]).mean() - 0.5) < 0.12
    assert (signed != np.iinfo(np.uint64).max).all() and len(set((signed[2] >> np.uint64(52)).tolist())) == 256  # one item takes each slot once


def check_near(spark, docs, percent, **options):
    sets = {}
    for i, t in docs:
        w = words_of(t)
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = root_of(links, sets)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r for r in minhash.near_duplicates(frame, percent=percent, **options).collect()}
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_near_duplicates(spark):
    check_near(spark, corpus(), 85)
    check_near(spark, corpus(7), 80, block=3)  # groups spread over pairs of blocks


def test_near_duplicates_odd_rows(spark):
    rows = [(1, "a b c d e f", 0), (1, "a b c d e f", 0), (None, "a b c d e f", 0), (2, "A b c d e f", 1), (3, None, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, component_id long")
    rows = [tuple(r) for r in minhash.near_duplicates(frame).collect()]
    assert (None, 2, None, True) in rows and len(rows) == 4
    got = sorted(r for r in rows if r[0] is not None)
    assert got == [(1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)], got
    assert minhash.near_duplicates(frame.limit(0)).count() == 0
    assert sorted(r["component_id"] for r in minhash.drop_near_duplicates(frame).collect()) == [0, 0, 0, 1]


def brute_passages(docs):
    seen, gone = set(), {}
    for i, t in sorted(docs):
        w = words_of(t, lower=False)
        bad = set()
        for s in range(len(w) - 19):
            window = tuple(w[s : s + 20])
            if window in seen:
                bad |= set(range(s, s + 20))
            seen.add(window)
        gone[i] = (len(w), len(bad), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in bad).encode()).hexdigest())
    return gone


def passages(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4)))
    shared = [[word() for _ in range(n)] for n in (19, 20, 21, 34, 60)]
    docs = []
    for i in range(60):
        w = [word() for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            cut = rng.randint(0, len(p) // 2)
            at = rng.randint(0, len(w))
            w[at:at] = p[cut:] if rng.random() < 0.5 else p
        docs.append((i * 7 % 61, " ".join(w)))
    docs += [(100, docs[5][1]), (101, docs[5][1].replace(" ", "\n")), (102, "z " * 400), (103, None), (104, ""), (105, "y " * 19)]
    return docs


def test_repeated_passages(spark):
    docs = passages()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.repeated_passages(frame).collect()}
    assert got == brute_passages(docs)


def test_repeated_passages_odd_rows(spark):
    text = " ".join(map(str, range(30)))
    frame = spark.createDataFrame([(1, text, "a"), (1, text, "b"), (None, text, "c"), (2, text + " more", "d")], "doc_id long, text string, hs string")
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in substring_dedup.repeated_passages(frame).collect()) == [(0, 0), (1, 0), (2, 30)]
    assert substring_dedup.repeated_passages(frame.limit(0)).count() == 0


def vectors(n=260, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n // 4):
        center = rng.standard_normal(dim)
        label = int(rng.integers(0, 2))
        for k in range(4):
            v = center + rng.standard_normal(dim) * (0.0 if k == 3 else 0.15)
            rows.append((len(rows), [float(np.float32(x)) for x in v], label))
    rows.append((len(rows), rows[0][1], rows[0][2]))
    return rows


def brute_links(rows):
    v = np.array([r[1] for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    close = (v @ v.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(close, False)
    return close


def test_vectors_of_small_labels(spark):
    rows = vectors()
    close = brute_links(rows)
    want = root_of(list(zip(*map(list, np.nonzero(close)), strict=True)), range(len(rows)))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.link_vectors(frame).collect()}
    assert {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == {i: (int(close[i].sum()), want[i]) for i in range(len(rows))}


def test_recall_of_the_shipped_settings(spark):
    """A label of 6000 vectors in families whose members are 0.93 to 0.97 near one another, and one of 3000."""
    rng = np.random.default_rng(4)
    rows = []
    for label, families in ((0, 1500), (1, 750)):
        for _ in range(families):
            center = rng.standard_normal(64)
            noise = rng.uniform(0.12, 0.26)
            rows += [(len(rows) + k, [float(x) for x in center + rng.standard_normal(64) * noise], label) for k in range(4)]
    close = brute_links(rows)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.link_vectors(frame).collect()}
    assert close.sum() > 10_000 and all(got[i] <= close[i].sum() for i in got)
    assert sum(got.values()) >= 0.95 * close.sum(), sum(got.values()) / close.sum()


def test_long_lists_are_spread_over_blocks(spark, monkeypatch):
    rows = vectors(600, 32, 4)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    whole = sorted(tuple(r) for r in embedding_dedup.link_vectors(frame).collect())
    monkeypatch.setattr(embedding_dedup, "BLOCK", 5)
    monkeypatch.setattr(embedding_dedup, "PAIRS", 7)
    assert sorted(tuple(r) for r in embedding_dedup.link_vectors(frame).collect()) == whole


def test_pivots_stand_in_order_of_nearness():
    rng = np.random.default_rng(2)
    v, pivots = rng.standard_normal((50, 8)), embedding_dedup.unit(rng.standard_normal((40, 8))).astype(np.float32)
    got = embedding_dedup.nearest(v, pivots)
    want = np.argsort(-(embedding_dedup.unit(v).astype(np.float32) @ pivots.T), axis=1, kind="stable")[:, : embedding_dedup.NEAREST]
    assert (got == want).all()


def test_huge_components_and_many_lengths(spark):
    rows = [(1, [1e300, 1e300], 0), (2, [2e300, 2e300], 0), (3, [1e-300, 1e-300], 0), (4, [1e300, -1e300], 0)]
    rows += [(100 + 10 * d + i, [1.0] * d, 0) for d in range(3, 40) for i in range(2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.link_vectors(frame).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == [(2, 1), (2, 1), (2, 1), (0, 4)]
    assert all(got[100 + 10 * d + i] == (1, 100 + 10 * d) for d in range(3, 40) for i in range(2))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 1), (3, None, 0), (4, [0.0, 0.0], 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0), (7, [1.0, 0.0], None), (8, [None, 1.0], 0), (9, [1.0, 0.0, 0.0], 0), (10, [], 0), (11, [2.0, -0.0], 0), (None, [1.0, 0.0], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as node")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.link_vectors(frame).collect()}
    assert got.pop(1) == (1, 1, True) and got.pop(11) == (1, 1, False) and got.pop(None) == (0, None, True)
    assert all(v == (0, k, True) for k, v in got.items())
    assert embedding_dedup.link_vectors(frame.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(200, 260)] + [(500, 501 + i) for i in range(30)]
    nodes = {x for e in links if e[0] != e[1] for x in e}
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: c for n, c in root_of(links, {x for e in links for x in e}).items() if n in nodes}


def thue_morse(n, swap=False):
    out = "ba" if swap else "ab"
    turn = str.maketrans("ab", "ba")
    out = out[0]
    while len(out) < n:
        out += out.translate(turn)
    return out


def test_words_that_defeat_polynomials(spark):
    """Thue-Morse words collide under every polynomial modulo 2^64; neither they nor sequences of two such words may here."""
    pairs = [(thue_morse(n), thue_morse(n, True)) for n in (1, 8, 16, 64, 128, 1024, 2048, 4096)]
    text, offsets = textnum.flat(pa.array([x for p in pairs for x in p]))
    starts, ends, _ = textnum.words(text, offsets)
    for seed in (0, 1):
        h = textnum.hash_words(text, starts, ends, seed)
        assert len(set(h.tolist())) == len(h)
    docs = [(i, w) for i, w in enumerate(x for p in pairs[-3:] for x in p)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert all(r["kept"] for r in minhash.near_duplicates(frame).collect())
    sequence = [" ".join(thue_morse(4096, swap)) for swap in (False, True)]
    h = [textnum.hash_grams(textnum.hash_words(*(lambda f: (f[0], *textnum.words(*f)[:2]))(textnum.flat(pa.array([x])))), 4096)[0] for x in sequence]
    assert h[0] != h[1]
    a, b = pairs[-1]
    rows = [(1, " ".join([a] * 20)), (2, " ".join([b] * 20)), (3, " ".join([a] * 20))]
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 20}


def test_fingerprints_are_those_of_words():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "bb", "c" * 9, "d" * 70, "é"]) for _ in range(rng.randint(0, 40))) for _ in range(30)]
    text, offsets = textnum.flat(pa.array(texts))
    starts, ends, first = textnum.words(text, offsets)
    ids = textnum.exact_ids(text, starts, ends)
    hashes = textnum.hash_words(text, starts, ends)
    raw = text.tobytes()
    words = [raw[a:b] for a, b in zip(starts, ends, strict=True)]
    for k in (1, 2, 3, 5, 6, 7, 20):
        want = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
        for got in (textnum.hash_grams(hashes, k), textnum.exact_grams(ids, k)):
            assert len(got) == len(want) and len(set(zip(got.tolist(), want, strict=True))) == len(set(want)) == len(set(got.tolist()))
    items, _, cuts = minhash.shingle_sets(text, offsets)
    exact, exact_cuts = minhash.exact_sets(text, offsets)
    assert cuts.tolist() == exact_cuts.tolist()


def test_a_large_group_visits_its_hub(spark):
    """One base and many copies, some too far from it: parts of a divided group, and the crossing of those left over."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(60):
        w = list(base)
        at = rng.randrange(180)
        w[at : at + i // 3] = [f"x{i}_{j}" for j in range(i // 3)]
        docs.append((i, " ".join(w)))
    check_near(spark, docs, 85, block=7)
    check_near(spark, docs, 80, block=2)


def test_the_automaton_decides(spark, monkeypatch):
    docs = passages()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(substring_dedup, "SHARD", 500)  # many blocks
    with_it = {r["doc_id"]: r["n_removed"] for r in substring_dedup.repeated_passages(frame).collect()}
    assert with_it == {i: x[1] for i, x in brute_passages(docs).items()}
    nothing = lambda ids, first, docs, passages, owners: np.zeros(len(ids), bool)
    monkeypatch.setattr(substring_dedup, "covered", nothing)
    without = {r["doc_id"]: r["n_removed"] for r in substring_dedup.repeated_passages(frame).collect()}
    assert sum(without.values()) < sum(with_it.values())


def test_covered_against_a_plain_search():
    rng = np.random.default_rng(7)
    ids = rng.integers(0, 2, 900)
    first = np.array([0, 300, 300, 900])
    passages = [rng.integers(0, 2, 20) for _ in range(40)] + [ids[100:125], ids[100:122], ids[400:430], ids[400:430]]
    owners = np.array([*rng.integers(0, 9, 40), 4, 1, 8, 3])
    names = np.array([2, 3, 7])
    want = np.zeros(900, bool)
    for d in range(3):
        for p, owner in zip(passages, owners, strict=True):
            for at in range(first[d], first[d + 1] - len(p) + 1):
                if owner < names[d] and (ids[at : at + len(p)] == p).all():
                    want[at : at + len(p)] = True
    assert (substring_dedup.covered(ids, first, names, passages, owners) == want).all() and want.any()


def test_joins_of_hot_keys(spark, monkeypatch):
    from pyspark.sql import functions as F

    from driftline.llm import scale

    monkeypatch.setattr(scale, "HOT_PARTS", 10)
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i}") for i in range(200)] + [(1000, None)], "i int, key string")
    table = rows.where("i < 100 and key is not null").groupBy("key").agg(F.count("i").alias("n"), F.min("i").alias("first"))
    table = table.withColumn("n", F.when(F.col("key") == "hot", 100).otherwise(F.col("n")))
    want = sorted((r["i"], r["key"], r["first"]) for r in rows.join(table, "key").collect())
    got = scale.skew_safe_match(rows, table, ["key"], "n", 201)
    assert got.columns == ["i", "key", "first"] and sorted(tuple(r) for r in got.collect()) == want
    some = scale.likely(rows.where("key is not null"), table.select("key"), "key")
    assert some.columns == rows.columns and sorted((r["i"], r["key"]) for r in some.join(table.select("key"), "key").select("i", "key").collect()) == [(i, k) for i, k, _ in want]
    assert some.count() < 200
