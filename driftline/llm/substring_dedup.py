"""Removal of repeated passages: recurring phrases nominate them, and sharded Aho-Corasick automata of their words find them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnum
from .scale import cut, likely, lookup, skew_safe_match

#: Words of a window, and of a phrase by which windows are found.
WINDOW, PHRASE = 20, 6
#: Bytes of documents that one automaton reads.
SHARD = 2 << 20
_EMPTY = hashlib.sha256(b"").hexdigest()


def layout(text: np.ndarray, offsets: np.ndarray, window: int = WINDOW, phrase: int = PHRASE) -> tuple:
    """Word starts and ends, each text's first word, word hashes, phrase hashes, window starts, and each window's chosen phrase.

    Of the phrases in a window the one with the least hash is chosen, the leftmost of equals. So equal windows choose
    equal phrases at equal places, wherever they stand, and about one phrase in (window - phrase + 2) / 2 is ever chosen.
    """
    starts, ends, first = textnum.words(text, offsets)
    hashes = textnum.hash_words(text, starts, ends)
    grams = textnum.hash_grams(hashes, phrase)
    n = len(hashes) - window + 1
    if n <= 0:
        return starts, ends, first, hashes, grams, np.zeros(0, np.int64), np.zeros(0, np.int64)
    chosen = np.lib.stride_tricks.sliding_window_view(grams, window - phrase + 1).argmin(axis=1)
    at = np.arange(n)
    last = first[np.searchsorted(first, at, side="right")]
    at = at[at + window <= last]
    return starts, ends, first, hashes, grams, at, at + chosen[at]


def _second(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Word hashes that are independent of those of ``layout``."""
    return textnum.hash_words(text, starts, ends, 1)


def _words_of(raw: bytes, starts: np.ndarray, ends: np.ndarray, first: int, last: int) -> str:
    return b" ".join([raw[s:e] for s, e in zip(starts[first:last].tolist(), ends[first:last].tolist(), strict=True)]).decode()


def _joined(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> str:
    return hashlib.sha256(b" ".join([raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])).hexdigest()


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    cuts = np.searchsorted(owner, np.arange(n + 1)).astype(np.int64)
    return pa.LargeListArray.from_arrays(pa.array(cuts), pa.array(values.view(np.int64))).cast(pa.list_(pa.int64()))


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_words, whole (SHA-256 of the words), phrases (chosen ones), again (those chosen at several places)."""
    for batch in batches:
        text, offsets = textnum.flat(batch.column(1))
        for i, j in textnum.groups(offsets):
            part, cuts = text[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            _, _, first, _, grams, _, chosen = layout(part, cuts)
            place = np.unique(chosen)
            owner, value = np.searchsorted(first, place, side="right") - 1, grams[place]
            order = np.lexsort((value, owner))
            owner, value = owner[order], value[order]
            new = np.ones(len(value), bool)
            new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
            more = ~new
            raw = part.tobytes()
            whole = [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(first).astype(np.int64)), pa.array(whole), _lists(value[new], owner[new], j - i), _lists(value[more], owner[more], j - i)],
                                             names=["doc_id", "n_words", "whole", "phrases", "again"])


def _windows(hashes: np.ndarray, others: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit fingerprints of the windows that start at ``at``, from two independent hashes of each word."""
    return tuple(textnum.hash_grams(h, WINDOW)[at].view(np.int64) for h in (hashes, others))


def _segments(w1: np.ndarray, w2: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that choose the same place: where each begins (with the total last), and its 128-bit fingerprint.

    Such a run is shorter than a window, so its first and last window hold all its words and with the run's length
    tell it from any other.
    """
    cut = np.flatnonzero(np.diff(chosen)) + 1
    begin = np.concatenate([[0], cut, [len(chosen)]]) if len(chosen) else np.zeros(1, np.int64)
    a, b, n = begin[:-1], begin[1:] - 1, np.diff(begin).astype(np.uint64)
    prints = (textnum.mix(textnum.mix(w.view(np.uint64)[a] + n) ^ w.view(np.uint64)[b]).view(np.int64) for w in (w1, w2))
    return begin, *prints


def _once(owner: np.ndarray, *values: np.ndarray) -> np.ndarray:
    """Indices of the first of equal (owner, values)."""
    order = np.lexsort((*values, owner))
    new = np.ones(len(order), bool)
    same = owner[order][1:] == owner[order][:-1]
    for v in values:
        same &= v[order][1:] == v[order][:-1]
    new[1:] = ~same
    return order[new]


def _places(batch: pa.RecordBatch):
    """For blocks of (doc_id, text, hs): ids, first words, windows at places of the phrases ``hs`` (starts, phrases, places, fingerprints)."""
    text, offsets = textnum.flat(batch.column(1))
    for i, j in textnum.groups(offsets):
        part, cuts = text[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, first, hashes, grams, at, chosen = layout(part, cuts)
        wanted = np.unique(batch.column(2).slice(i, j - i).flatten().to_numpy(zero_copy_only=False)).view(np.uint64)
        hit = np.isin(grams[chosen], wanted)
        at, chosen = at[hit], chosen[hit]
        yield batch.column(0).slice(i, j - i).to_numpy(), first, at, grams[chosen].view(np.int64), chosen, *_windows(hashes, _second(part, starts, ends), at)


def _emit_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, k1, k2, doc_id: each document's distinct runs of windows whose chosen phrase recurs."""
    for batch in batches:
        for ids, first, at, phrases, chosen, w1, w2 in _places(batch):
            begin, g1, g2 = _segments(w1, w2, chosen)
            begin = begin[:-1]
            owner = np.searchsorted(first, at[begin], side="right") - 1
            pick = _once(owner, g1, g2)
            yield pa.RecordBatch.from_arrays([pa.array(phrases[begin][pick]), pa.array(g1[pick]), pa.array(g2[pick]), pa.array(ids[owner[pick]])], names=["h", "k1", "k2", "doc_id"])


def _emit_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k1, k2, doc_id: each document's distinct windows at the phrases that are given for it."""
    for batch in batches:
        for ids, first, at, _, _, w1, w2 in _places(batch):
            owner = np.searchsorted(first, at, side="right") - 1
            pick = _once(owner, w1, w2)
            for a in range(0, len(pick), 100_000):
                part = pick[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(w1[part]), pa.array(w2[part]), pa.array(ids[owner[part]])], names=["k1", "k2", "doc_id"])


def _among(a1: np.ndarray, a2: np.ndarray, wanted: list[dict], run: bool) -> np.ndarray:
    """Which of the pairs (a1, a2) are among the wanted keys of runs, or of windows."""
    keys = {(x["k1"], x["k2"]) for x in wanted if x["run"] == run}
    return np.fromiter(((x in keys) for x in zip(a1.tolist(), a2.tolist(), strict=True)), bool, len(a1)) if keys else np.zeros(len(a1), bool)


def _emit_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """run, k1, k2, words: what stands in the wanted runs and windows of (doc_id, text, wanted), joined by blanks."""
    for batch in batches:
        text, offsets = textnum.flat(batch.column(1))
        for i in range(batch.num_rows):
            part = text[offsets[i] : offsets[i + 1]]
            starts, ends, _, hashes, _, at, chosen = layout(part, np.array([0, len(part)]))
            w1, w2 = _windows(hashes, _second(part, starts, ends), at)
            begin, g1, g2 = _segments(w1, w2, chosen)
            raw, wanted = part.tobytes(), batch.column(2)[i].as_py()
            out = []
            for n in _first_of(g1, g2, _among(g1, g2, wanted, True)):
                out.append((True, g1[n], g2[n], _words_of(raw, starts, ends, at[begin[n]], at[begin[n + 1] - 1] + WINDOW)))
            for n in _first_of(w1, w2, _among(w1, w2, wanted, False)):
                out.append((False, w1[n], w2[n], _words_of(raw, starts, ends, at[n], at[n] + WINDOW)))
            if out:
                run, k1, k2, words = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(run), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(words)], names=["run", "k1", "k2", "words"])


def _first_of(a: np.ndarray, b: np.ndarray, some: np.ndarray) -> np.ndarray:
    """The first place of each of the chosen pairs."""
    at = np.flatnonzero(some)
    return at[_once(np.zeros(len(at), np.int64), a[at], b[at])] if len(at) else at


def covered(ids: np.ndarray, first: np.ndarray, docs: np.ndarray, passages: list[np.ndarray], owners: np.ndarray) -> np.ndarray:
    """Which words of the texts stand in a passage that an earlier document has: an automaton of all passages reads every text.

    Letters are numbers of words, equal only for equal words. Of equal passages the smallest owner counts.
    """
    import ahocorasick

    out = np.zeros(len(ids) + 1, np.int64)
    machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for words, owner in sorted(zip(map(tuple, (p.tolist() for p in passages)), owners.tolist(), strict=True), key=lambda x: -x[1]):
        machine.add_word(words, (owner, len(words)))  # the smallest owner comes last and stays
    if not passages:
        return out[:-1] > 0
    machine.make_automaton()
    # a match lies in a run of words that passages have; only such runs are read
    inside = np.zeros(len(ids) + 1, bool)
    inside[:-1] = np.isin(ids, np.unique(np.concatenate(passages)))
    for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside[a:b], [False]]).astype(np.int8)))
        for start, stop in edge.reshape(-1, 2)[np.diff(edge)[::2] >= WINDOW].tolist():
            for end, (owner, n) in machine.iter(tuple(ids[a + start : a + stop].tolist())):
                if owner < docs[d]:
                    out[a + start + end + 1 - n] += 1
                    out[a + start + end + 1] -= 1
    return np.cumsum(out)[:-1] > 0


def _strip(docs: pa.Table, passages: pa.Table) -> pa.Table:
    """doc_id, r, kept_sha256 of a block's documents without the passages that earlier documents have, and without
    windows that stand earlier in their own."""
    text, offsets = textnum.flat(docs["text"])
    words, cuts = textnum.flat(passages["words"])
    starts, ends, first = textnum.words(text, offsets)
    p_starts, p_ends, p_first = textnum.words(words, cuts)
    ids = textnum.exact_ids(np.concatenate([text, words]), np.concatenate([starts, p_starts + len(text)]), np.concatenate([ends, p_ends + len(text)]))
    ids, letters = ids[: len(starts)], ids[len(starts) :]
    names = docs["doc_id"].to_numpy()
    gone = covered(ids, first, names, [letters[a:b] for a, b in zip(p_first[:-1], p_first[1:], strict=True)], passages["lo"].to_numpy())
    windows = textnum.exact_grams(ids, WINDOW)
    raw, counts, kept = text.tobytes(), [], []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        own = windows[a : max(a, b - WINDOW + 1)]
        again = np.ones(len(own), bool)
        again[np.unique(own, return_index=True)[1]] = False
        edges = np.zeros(b - a + 1, np.int64)
        at = np.flatnonzero(again)
        edges[at] += 1
        edges[at + WINDOW] -= 1
        stay = np.flatnonzero(~(gone[a:b] | (np.cumsum(edges)[:-1] > 0))) + a
        counts.append(b - a - len(stay))
        kept.append(_joined(raw, starts[stay], ends[stay]))
    return pa.table({"doc_id": docs["doc_id"], "r": pa.array(counts, pa.int64()), "kept_sha256": pa.array(kept, pa.string())})


def _originals(survey: DataFrame) -> DataFrame:
    """doc_id, whole, n_words, original: the smallest id with the same words."""
    brief = survey.groupBy("doc_id").agg(F.min(F.struct("whole", "n_words")).alias("s")).select("doc_id", "s.*")
    return cut(lookup(cut(brief), brief.groupBy("whole").agg(F.min("doc_id").alias("original")), ["whole"], F.col("doc_id")))


def _recurring(survey: DataFrame, brief: DataFrame) -> DataFrame:
    """doc_id, hs, again: the recurring phrases of each original that has any, and whether one stands twice in it."""
    lone = brief.where((F.col("doc_id") == F.col("original")) & (F.col("n_words") >= WINDOW)).select("doc_id", "whole")
    chosen = cut(survey.select("doc_id", "whole", "phrases", "again").join(lone, ["doc_id", "whole"], "left_semi").select("doc_id", "phrases", "again"))
    placed = chosen.select("doc_id", F.explode("phrases").alias("h"))
    shared = cut(placed.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).where(F.col("lo") < F.col("hi")).select("h", "n"))
    total = chosen.agg(F.coalesce(F.sum(F.size("phrases")), F.lit(0))).first()[0]
    found = skew_safe_match(placed, shared, ["h"], "n", total).select("doc_id", "h", F.lit(False).alias("again"))
    found = found.union(chosen.select("doc_id", F.explode("again").alias("h"), F.lit(True).alias("again")))
    return cut(found.groupBy("doc_id").agg(F.collect_set("h").alias("hs"), F.max("again").alias("again")))


def _known_segments(docs: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, k1, k2, lo): runs of windows that an earlier document has. (doc_id, hs): phrases at which owners of runs differ."""
    segments = cut(docs.join(found, "doc_id").select("doc_id", "text", "hs").mapInArrow(_emit_segments, "h long, k1 long, k2 long, doc_id long"))
    owners = cut(segments.groupBy("h", "k1", "k2").agg(F.min("doc_id").alias("lo"), F.count(F.lit(1)).alias("n")))
    later = skew_safe_match(segments, owners.where(F.col("n") > 1), ["h", "k1", "k2"], "n", segments.count()).where(F.col("lo") < F.col("doc_id"))
    mixed = cut(owners.groupBy("h").agg(F.min("lo").alias("a"), F.max("lo").alias("b"), F.count(F.lit(1)).alias("n")).where(F.col("a") < F.col("b")).select("h", "n"))
    differ = skew_safe_match(owners.select("h", F.col("lo").alias("doc_id")), mixed, ["h"], "n", owners.count())
    return later.select("doc_id", "k1", "k2", "lo"), cut(differ.groupBy("doc_id").agg(F.collect_set("h").alias("hs")))


def _known_windows(docs: DataFrame, differ: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, lo): windows of runs' owners that an earlier owner has."""
    rows = docs.join(differ, "doc_id").select("doc_id", "text", "hs")
    windows = cut(rows.mapInArrow(_emit_windows, "k1 long, k2 long, doc_id long"))
    earliest = windows.groupBy("k1", "k2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).where(F.col("lo") < F.col("hi"))
    return skew_safe_match(windows, cut(earliest.select("k1", "k2", "lo", "n")), ["k1", "k2"], "n", windows.count()).where(F.col("lo") < F.col("doc_id")).select("doc_id", "k1", "k2", "lo")


def _stripped(docs: DataFrame, found: DataFrame, later: DataFrame) -> DataFrame:
    """doc_id, r, kept_sha256 of the documents that may lose words.

    ``later`` (doc_id, run, k1, k2, lo) are the nominated passages; ``found`` tells which documents repeat a phrase themselves. Their owners tell the words, once for each passage;
    documents are dealt evenly into blocks, each with the passages that are nominated for its documents.
    """
    owned = cut(later.select(F.col("lo").alias("doc_id"), "run", "k1", "k2").distinct().groupBy("doc_id").agg(F.collect_list(F.struct("run", "k1", "k2")).alias("wanted")))
    texts = cut(likely(docs, owned, "doc_id").join(owned, "doc_id").select("doc_id", "text", "wanted").mapInArrow(_emit_passages, "run boolean, k1 long, k2 long, words string"))
    touched = cut(later.select("doc_id").union(found.where("again").select("doc_id")).distinct())
    todo = cut(likely(docs, touched, "doc_id").join(touched, "doc_id").select("doc_id", "text"))
    blocks = max(1, -(-todo.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // SHARD))
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block")
    need = cut(later.groupBy(block, "run", "k1", "k2").agg(F.min("lo").alias("lo")))
    passages = lookup(need, texts, ["run", "k1", "k2"], F.col("block")).where(F.col("words").isNotNull()).select("block", "lo", "words")
    return todo.select("doc_id", "text", block).groupBy("block").cogroup(passages.groupBy("block")).applyInArrow(_strip, "doc_id long, r long, kept_sha256 string")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per id of ``docs``: doc_id, n_words, n_removed, kept_sha256.

    A word goes if a window of WINDOW words over it also starts earlier: in a document of smaller id, or earlier in its
    own. All windows of whole texts count, as they are in the input.

    1. Documents of equal words: all but the smallest id go whole, if they hold a window at all.
    2. Each window chooses one phrase by its content; phrases chosen in two documents, or twice in one, recur.
       Anything that repeats has such a phrase, so all else is settled.
    3. Runs of windows that choose a recurring phrase are compared by 128-bit fingerprints over all documents; where
       different runs share a phrase, so are their single windows. This nominates passages, with their first document.
    4. The first documents give the words of the nominated passages. Blocks of documents are shards: each compiles an
       Aho-Corasick automaton of the passages nominated for its documents and streams the documents through it. A word goes
       if the automaton finds it in a passage of an earlier document, compared word by word; windows that repeat in
       one document are compared in the same way.

    A null or empty text has no words. Rows that repeat an id with the same text are one document; with different
    texts, the text of the smallest hash of words counts. Rows without an id have no place in the order: nothing of them
    goes, and nothing goes because of them. Phrases, runs and windows are aggregated before they are shuffled, and hot ones
    are looked up skew-safely.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    every = cut(docs.mapInArrow(_survey, "doc_id long, n_words long, whole string, phrases array<long>, again array<long>"))
    nameless = cut(every.where(F.col("doc_id").isNull()).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("whole").alias("kept_sha256")))
    survey, docs = every.where(F.col("doc_id").isNotNull()), docs.where(F.col("doc_id").isNotNull())
    brief = _originals(survey)
    repeats = survey.count() != brief.count()
    if repeats:
        survey = survey.dropDuplicates(["doc_id", "whole"])
        docs = docs.dropDuplicates()
    found = _recurring(survey, brief)
    if repeats:  # one row for each id, with the text that counts
        words = F.sha2(F.array_join(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != ""), " "), 256)
        docs = cut(docs.withColumn("whole", words).join(brief.select("doc_id", "whole"), ["doc_id", "whole"], "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "text"))
    runs, differ = _known_segments(docs, found)
    runs = cut(runs)
    singles = _known_windows(docs, differ)
    later = cut(runs.select("doc_id", F.lit(True).alias("run"), "k1", "k2", "lo").union(singles.select("doc_id", F.lit(False).alias("run"), "k1", "k2", "lo")))
    del every, survey, runs, singles, differ
    stripped = _stripped(docs, found, later)
    copy = (F.col("doc_id") != F.col("original")) & (F.col("n_words") >= WINDOW)
    out = brief.join(stripped, "doc_id", "left").select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("r", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.lit(_EMPTY)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"))
    return out.union(nameless)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``repeated_passages`` of all documents."""
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM documents),
windows AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20),
ranked AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(ws[s:s + 19], ' ') ORDER BY doc_id, s) AS k FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM ranked WHERE k > 1),
lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
kept AS (SELECT w.doc_id, ws, coalesce(len(ps), 0) AS n_removed,
                CASE WHEN ps IS NULL THEN ws ELSE list_select(ws, list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(ps, i))) END AS ks
         FROM w LEFT JOIN lists USING (doc_id))
SELECT doc_id, len(ws) AS n_words, n_removed, sha256(array_to_string(ks, ' ')) AS kept_sha256 FROM kept
"""
