"""Near-duplicates by SuperMinHash signatures, banding, exact verification and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnum
from .components import components, forest
from .scale import cut, lookup, skew_safe_lookup

#: Words of a shingle; links have 100 * intersection >= PERCENT * union in the query's contract.
WORDS, PERCENT = 5, 85
#: A pair of similarity s shares a band with probability 1 - (1 - s**ROWS)**BANDS: 0.99999 at 0.85, 0.9993 at 0.8.
BANDS, ROWS = 24, 6
#: Documents, and about the shingles, that are compared with one another in one go.
BLOCK, SPAN = 128, 1 << 20
_TOP = np.uint64(52)


def superminhash(items: np.ndarray, first: np.ndarray, m: int = BANDS * ROWS) -> np.ndarray:
    """Signatures (sets x m, uint64) of sets of distinct 64-bit items; set i is items[first[i]:first[i + 1]], not empty.

    Each item draws a random permutation of the m slots, step by step, and in step j puts j plus a random fraction into
    the slot that comes j-th; a slot keeps the least. As step j cannot go below j, a set is done once all its slots
    are under the next step, usually after a few steps. All sets of the batch take a step together.
    """
    n = len(first) - 1
    out = np.full((n, m), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(n), np.diff(first))
    alive, keys, moved = items, [], []
    for j in range(m):
        draw = textnum.mix(alive + np.uint64(((j + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1)))
        value = (np.uint64(j) << _TOP) | (draw >> np.uint64(12))
        k = j + (textnum.mix(draw) >> np.uint64(33)).astype(np.int64) % (m - j)
        slot, here = k.copy(), np.full(len(alive), j)
        for key, was in zip(keys, moved, strict=True):  # earlier swaps, in order: the last one that touched a place counts
            np.copyto(slot, was, where=key == k)
            np.copyto(here, was, where=key == j)
        np.minimum.at(flat, owner * m + slot, value)
        keys.append(k)
        moved.append(here)
        open_ = out.max(axis=1) >= (np.uint64(j + 1) << _TOP)
        if not open_.any():
            break
        some = open_[owner]
        if not some.all():
            alive, owner = alive[some], owner[some]
            keys, moved = [x[some] for x in keys], [x[some] for x in moved]
    return out


def _shingles(text: np.ndarray, offsets: np.ndarray, k: int, grams_of) -> tuple[np.ndarray, ...]:
    """Shingles of lower-cased texts and the text of each, not yet distinct; a text with 1 to k - 1 words is its one shingle.

    ``grams_of(text, starts, ends)`` gives, for a number of words, columns of shingles of so many words.
    """
    starts, ends, first = textnum.words(text, offsets)
    n = np.diff(first)
    of = grams_of(text, starts, ends)
    columns = of(k)
    owner = np.searchsorted(first, np.arange(len(columns[0])), side="right") - 1
    inside = np.arange(len(owner)) < (first[1:] - (k - 1))[owner]  # no shingle may begin later in its text
    parts, owners = [[c[inside] for c in columns]], [owner[inside]]
    for size in range(1, k):
        short = np.flatnonzero(n == size)
        if len(short):
            parts.append([c[first[:-1][short]] for c in of(size)])
            owners.append(short)
    return [np.concatenate(c) for c in zip(*parts, strict=True)], np.concatenate(owners)


def _distinct(columns: list[np.ndarray], owner: np.ndarray, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns with the first column's values once for each of n owners, sorted; and where the owners begin."""
    order = np.lexsort((columns[0], owner))
    columns, owner = [c[order] for c in columns], owner[order]
    new = np.ones(len(owner), bool)
    new[1:] = (columns[0][1:] != columns[0][:-1]) | (owner[1:] != owner[:-1])
    return [c[new] for c in columns], np.searchsorted(owner[new], np.arange(n + 1))


def shingle_sets(text: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text as two independent 64-bit fingerprints, sorted by the first, and where the sets begin.

    A text with fewer than k words has its whole word sequence as its one shingle, one without words none.
    """

    def grams_of(text, starts, ends):
        a, b = (textnum.hash_words(text, starts, ends, seed) for seed in (0, 1))
        return lambda size: [textnum.hash_grams(a, size), textnum.hash_grams(b, size)]

    columns, owner = _shingles(textnum.lower(text), offsets, k, grams_of)
    (items, others), first = _distinct(columns, owner, len(offsets) - 1)
    return items, others, first


def exact_sets(text: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """As ``shingle_sets``, as numbers that are equal only for equal words; they hold among these texts alone."""

    def grams_of(text, starts, ends):
        ids = textnum.exact_ids(text, starts, ends)
        return lambda size: [textnum.exact_grams(ids, size) * k + size - 1]  # sequences of different lengths differ

    columns, owner = _shingles(textnum.lower(text), offsets, k, grams_of)
    (items,), first = _distinct(columns, owner, len(offsets) - 1)
    return items, first


def _lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(first.astype(np.int64)), pa.array(values.view(np.int64))).cast(pa.list_(pa.int64()))


def signatures(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, f1 and f2 (a 128-bit fingerprint of the set), bands (keys; null for empty sets) of (doc_id, text)."""
    salt = np.arange(BANDS, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, offsets = textnum.flat(batch.column(1))
            for i, j in textnum.groups(offsets):
                items, others, first = shingle_sets(text[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                n = np.diff(first)
                sums = np.zeros(len(items) + 1, np.uint64)
                prints = []
                for column, c in ((items, 0x5851F42D4C957F2D), (others, 0x14057B7EF767814F)):
                    np.cumsum(textnum.mix(column ^ np.uint64(c)), out=sums[1:])
                    prints.append((sums[first[1:]] - sums[first[:-1]]).view(np.int64))
                full = n > 0
                bands = np.zeros((len(n), BANDS), np.uint64)
                if full.any():
                    signed = superminhash(items, np.concatenate([first[:-1][full], first[-1:]])).reshape(-1, BANDS, ROWS)
                    key = np.zeros(signed.shape[:2], np.uint64) + salt
                    for r in range(ROWS):
                        key = textnum.mix(key ^ signed[:, :, r])
                    bands[full] = key
                lists = _lists(bands[full].reshape(-1), np.concatenate([[0], np.cumsum(full * BANDS)]))
                lists = pa.array([x if f else None for x, f in zip(lists.to_pylist(), full, strict=True)], pa.list_(pa.int64())) if not full.all() else lists
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), *map(pa.array, prints), lists], names=["doc_id", "n_shingles", "f1", "f2", "bands"])

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_shingles long, f1 long, f2 long, bands array<long>")


def linked_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (a < b) of sets with 100 * intersection >= percent * union; one of the two in ``left``, the other in ``right``.

    Only items that several sets hold are counted, as products of 0/1 matrices of bounded size.
    """
    n = len(sets)
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, item, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[item] > 1
    item, owner = np.unique(item[shared], return_inverse=True)[1], owner[shared]
    order = np.argsort(item, kind="stable")
    item, owner = item[order], owner[order]
    both = np.zeros((n, n), np.float32)
    for a in range(0, int(item[-1]) + 1 if len(item) else 0, 4096):
        lo, hi = np.searchsorted(item, [a, a + 4096])
        held = np.zeros((min(4096, int(item[-1]) + 1 - a), n), np.float32)
        held[item[lo:hi] - a, owner[lo:hi]] = 1
        both += held.T @ held
    union = sizes[:, None] + sizes[None, :] - both
    fine = (100 * both >= percent * union) & ((left[:, None] & right[None, :]) | (right[:, None] & left[None, :]))
    return np.nonzero(np.triu(fine, 1))


def _members(table: pa.Table) -> tuple[pa.Table, list[np.ndarray]]:
    """A group's rows by node, and their exact sets."""
    table = table.combine_chunks().sort_by("node")
    items, first = exact_sets(*textnum.flat(table["text"]))
    return table, [items[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


def _star(percent: int):
    """Compares the documents of a part of a group: all pairs in a group of one part, else all with the hub.

    Returns links (a, b), and with b null the documents of divided groups that are not linked with their hub.
    """

    def compare(table: pa.Table) -> pa.Table:
        table, sets = _members(table)
        node, hub = table["node"].to_numpy(), table["hub"][0].as_py()
        if table["parts"][0].as_py() == 1:
            every = np.ones(len(node), bool)
            a, b = linked_pairs(sets, every, every, percent)
            keep = forest(len(node), a, b)
            return pa.table({"hub": np.full(keep.sum(), hub), "a": node[a[keep]], "b": pa.array(node[b[keep]], pa.int64())})
        centre = sets[int(np.searchsorted(node, hub))]
        size = np.array([len(x) for x in sets])
        both = np.array([len(np.intersect1d(x, centre, assume_unique=True)) for x in sets])
        linked = 100 * both >= percent * (size + len(centre) - both)
        some = node != hub
        return pa.table({"hub": np.full(some.sum(), hub), "a": np.where(linked, hub, node)[some], "b": pa.array(node[some], pa.int64(), mask=~linked[some])})

    return compare


def _cross(percent: int):
    """Links between the documents on either side of a pair of blocks."""

    def compare(table: pa.Table) -> pa.Table:
        table, sets = _members(table)
        node, left = table["node"].to_numpy(), table["left"].to_numpy(zero_copy_only=False)
        a, b = linked_pairs(sets, left, ~left, percent)
        a, b = a[node[a] != node[b]], b[node[a] != node[b]]
        keep = forest(len(node), a, b)
        return pa.table({"a": node[a[keep]], "b": node[b[keep]]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return compare


def _links(met: DataFrame, texts: DataFrame, block: int, percent: int) -> DataFrame:
    """(a, b): enough links of every group in ``met`` (hub, node, n_shingles) to join what any of its pairs join.

    A group of up to ``block`` documents and SPAN shingles is compared pair by pair. A larger one is dealt into parts,
    which its hub visits: one copy of each document. Only documents that are not linked with the hub are then compared
    with all others of their group, in pairs of blocks; nothing is capped or skipped.
    """
    sizes = met.groupBy("hub").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n_shingles") / SPAN)).cast("int").alias("parts"))
    seats = cut(lookup(met, sizes, ["hub"], F.col("node")).select("hub", "node", "parts"))
    own = lambda parts, salt: F.pmod(F.xxhash64("node", F.lit(salt)), parts).cast("int")
    every = lambda parts: F.sequence(F.lit(0), parts - 1)
    part = F.explode(F.when(F.col("hub") == F.col("node"), every(F.col("parts"))).otherwise(F.array(own(F.col("parts"), 1))))
    dealt = _with_text(seats, texts).select("hub", "node", "parts", "text", part.alias("part"))
    found = cut(dealt.groupBy("hub", "part").applyInArrow(_star(percent), "hub long, a long, b long"))
    edges = found.where(F.col("b").isNotNull()).select("a", "b")
    loose = cut(found.where(F.col("b").isNull()).select("hub", F.col("a").alias("node")).distinct())
    if loose.isEmpty():
        return edges
    blocks = loose.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    rest = lookup(seats.where((F.col("parts") > 1) & (F.col("hub") != F.col("node"))), blocks, ["hub"], F.col("node")).where(F.col("blocks").isNotNull())
    rest = rest.join(loose.select(F.col("hub").alias("h"), F.col("node").alias("v"), F.lit(True).alias("loose")), (F.col("hub") == F.col("h")) & (F.col("node") == F.col("v")), "left")
    as_left = F.when(F.col("loose"), F.transform(every(F.col("parts")), lambda p: F.struct(own(F.col("blocks"), 2).alias("q"), p.alias("p"), F.lit(True).alias("left"))))
    as_right = F.transform(every(F.col("blocks")), lambda q: F.struct(q.alias("q"), own(F.col("parts"), 1).alias("p"), F.lit(False).alias("left")))
    none = F.array().cast("array<struct<q:int,p:int,left:boolean>>")
    pairs = _with_text(rest.select("hub", "node", F.concat(F.coalesce(as_left, none), as_right).alias("places")), texts)
    pairs = pairs.select("hub", "node", "text", F.explode("places").alias("x")).select("hub", "node", "text", "x.*")
    return edges.union(pairs.groupBy("hub", "q", "p").applyInArrow(_cross(percent), "a long, b long"))


def _with_text(seats: DataFrame, texts: DataFrame) -> DataFrame:
    """``seats`` with each node's text. The seats of a node, at most one for each band, are one row while they meet it."""
    rest = [c for c in seats.columns if c != "node"]
    lists = seats.groupBy("node").agg(F.collect_list(F.struct(*rest)).alias("seats"))
    return lists.join(texts, F.col("node") == F.col("doc_id")).select("node", "text", F.explode("seats").alias("s")).select("node", "text", "s.*")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """One row per id of ``docs``: doc_id, n_shingles, component_id, kept; and one for each row without an id.

    Sets are the distinct k-word shingles of whole texts, words being runs without ASCII white space, A-Z as a-z.
    Equal sets (by 128-bit fingerprints) are one node. Nodes that share a band of their SuperMinHash signatures meet in
    the group of the band bucket's smallest id, where links are confirmed on the words themselves (see ``_links``).
    component_id is the smallest id that links reach; kept marks it.
    Null and empty texts have no set and are alone. Rows that repeat an id: the smallest text counts. Rows without an
    id cannot name a component and are linked with nothing: component_id null, kept. An empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named = docs.where(F.col("doc_id").isNotNull())
    counts = named.agg(F.count("doc_id"), F.countDistinct("doc_id")).first()
    if counts[0] != counts[1]:
        named = named.groupBy("doc_id").agg(F.min("text").alias("text"))
        docs = named.union(docs.where(F.col("doc_id").isNull()))
    signed = cut(signatures(docs, k))
    full = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    nodes = cut(full.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("node"), F.min("bands").alias("bands")))
    rows = nodes.select("node", "n_shingles", F.posexplode("bands").alias("band", "key"))
    buckets = cut(rows.groupBy("band", "key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))
    met = skew_safe_lookup(rows, buckets, ["band", "key"], "n", nodes.count() * BANDS, F.col("node"))
    met = cut(met.where(F.col("hub").isNotNull()).select("hub", "node", "n_shingles").distinct())
    reached = components(_links(met, named, block, percent))
    roots = nodes.select("n_shingles", "f1", "f2", "node").join(reached, "node", "left").select("n_shingles", "f1", "f2", F.coalesce("component", "node").alias("root"))
    out = lookup(signed.select("doc_id", "n_shingles", "f1", "f2"), roots, ["n_shingles", "f1", "f2"], F.coalesce("doc_id", F.lit(0)))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that are not the first of their group; rows with a null doc_id stay."""
    gone = near_duplicates(docs, percent=percent).where(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), percent=PERCENT)


#: Sets by their words, compared pair by pair. Shingles are joined by line feeds, which no word holds.
ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, chr(10))]
        ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], chr(10)))) END AS gs FROM w),
n AS (SELECT doc_id, len(gs) AS n FROM g),
s AS (SELECT min(doc_id) AS node, n, gs FROM (SELECT doc_id, len(gs) AS n, list_sort(gs) AS gs FROM g) WHERE n > 0 GROUP BY n, gs),
e AS (SELECT node, n, unnest(gs) AS h FROM s),
r AS (SELECT e.node, e.n, e.h, row_number() OVER (PARTITION BY e.node ORDER BY f.f, e.h) AS i FROM e JOIN (SELECT h, count(*) AS f FROM e GROUP BY h) f ON e.h = f.h),
p AS (SELECT node, n, h FROM r WHERE i <= n - (n * 85 + 99) // 100 + 1),
c AS (SELECT DISTINCT a.node AS a, b.node AS b FROM p a JOIN p b ON a.h = b.h AND a.node < b.node AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
o AS (SELECT c.a, c.b, count(*) AS o FROM c JOIN e x ON x.node = c.a JOIN e y ON y.node = c.b AND y.h = x.h GROUP BY c.a, c.b),
l AS (SELECT a, b FROM o JOIN s x ON x.node = a JOIN s y ON y.node = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (WITH RECURSIVE t AS (SELECT node AS a, node AS b FROM s WHERE node IN (SELECT a FROM both_ways) UNION SELECT t.a, x.b FROM t JOIN both_ways x ON x.a = t.b) SELECT a, min(b) AS c FROM t GROUP BY a),
of_set AS (SELECT d.doc_id, d.n, s.node FROM (SELECT doc_id, len(gs) AS n, list_sort(gs) AS gs FROM g) d LEFT JOIN s ON s.gs = d.gs AND s.n = d.n)
SELECT o.doc_id, o.n AS n_shingles, coalesce(r.c, o.node, o.doc_id) AS component_id, o.doc_id = coalesce(r.c, o.node, o.doc_id) AS kept FROM of_set o LEFT JOIN reach r ON r.a = o.node
"""
