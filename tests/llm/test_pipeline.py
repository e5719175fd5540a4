"""The corpus pipeline: every stage against a plain version on its own input, and the whole."""

import re

import corpus_pipeline
from driftline.llm import mixing, toxicity
from tests.llm.test_dedup import root_of, words_of

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        out.write.parquet(f"{tmp_path}/{i}")
        seen[name] = (rows_of(docs), rows_of(spark.read.parquet(f"{tmp_path}/{i}")))
        docs = spark.read.parquet(f"{tmp_path}/{i}")

    before, after = seen["toxicity"]
    model = toxicity.fit_from_tables(spark, SF)
    bad = {r["doc_id"] for r in toxicity.score_toxicity(spark.read.parquet(f"{SF}/documents.parquet"), model, ["doc_id"]).where("predicted = 1").collect()}
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before if r["doc_id"] not in bad)

    before, after = seen["exact dedup"]
    best = {}
    for r in before:
        key = r["text"] or ""
        best[key] = max(best.get(key, r), r, key=lambda x: x["doc_id"])
    assert sorted(map(str, after)) == sorted(map(str, best.values()))

    before, after = seen["MinHash near-dedup"]
    sets = {}
    for r in before:
        w = words_of(r["text"])
        sets[r["doc_id"]] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = root_of(links, sets)
    assert sorted(map(str, after)) == sorted(str(r) for r in before if root[r["doc_id"]] == r["doc_id"])

    before, after = seen["mixing sources to target weights"]
    mixed = mixing.mix(spark.read.parquet(f"{tmp_path}/2"), mixing.fit_from_tables(spark, SF), mixing.TARGETS)
    copies = {r["doc_id"]: r["copies"] for r in mixed.collect()}
    assert sorted(map(str, after)) == sorted(str(r) for r in before for _ in range(copies[r["doc_id"]]))

    before, after = seen["best-fit packing"]
    total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in before)
    assert sum(r["n_tokens"] for r in after) == total
    bins = {}
    for r in after:
        if r["bin_id"] is not None:
            bins.setdefault(r["bin_id"], []).append(r)
    for pieces in bins.values():
        assert sum(r["n_tokens"] for r in pieces) <= 2048
        sources = [r["source"] for r in pieces if r["source"] is not None]
        ids = [r["doc_id"] for r in pieces]
        assert len(set(sources)) == len(sources) and len(set(ids)) == len(ids)


def test_run_gives_what_the_stages_give(spark, tmp_path):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "source", "piece", "start", "n_tokens", "bin_id", "bin_offset"] and out.count() > 0


def test_an_empty_corpus(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_awkward_rows_pass_all_stages(spark, tmp_path):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, "", "xx", None, 0), (10**9 + 1, "w " * 50_000, None, "s", None), (10**9 + 2, "a b", "en", "s", 3), (10**9 + 2, "a b", "en", "s", 3)], documents.schema)
    documents.limit(60).union(odd).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    got = rows_of(corpus_pipeline.run(spark, str(tmp_path)))
    assert sum(r["n_tokens"] for r in got if r["doc_id"] == 10**9 + 1) % 50_000 == 0
