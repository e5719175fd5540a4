"""Near-duplicate vectors by a pivot-permutation index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components, forest
from .scale import cut, lookup

#: Nearest pivots that describe a vector; in the lists of how many of them it stands; how many a candidate must share.
NEAREST, POSTED, SHARED = 10, 6, 3
#: Pivots for n vectors: DENSITY * sqrt(n), so that lists and descriptions both grow with the square root; as 32-bit numbers in at most BYTES.
DENSITY, BYTES = 4, 64 << 20
#: Numbers of components that have pivots of their own (the most frequent ones); vectors of others share one list for each label.
DIMS = 16
#: Vectors to either side of one comparison, and pairs whose cosines are computed in one go.
BLOCK, PAIRS = 4096, 50_000


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; first scaled by their largest component, so that no square overflows or vanishes."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _pivots(nodes: DataFrame) -> dict[int, np.ndarray]:
    """Reference points by number of components: the vectors of the lowest hashes, whatever their labels. A bounded sample."""
    counts = nodes.groupBy("dim").count().orderBy(F.col("count").desc(), "dim").limit(DIMS).collect()
    out = {}
    for dim, n in ((r["dim"], r["count"]) for r in counts):
        want = int(min(DENSITY * n**0.5 + 2 * NEAREST, n, max(1, BYTES // (4 * dim * len(counts)))))
        dice = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) / float(1 << 30)
        some = nodes.where((F.col("dim") == dim) & (dice <= min(1.0, (2 * want + 50) / n)))
        rows = some.select("embedding", F.xxhash64("node").alias("h"), "label").orderBy("h", "label").limit(want).toArrow()
        out[dim] = unit(np.array(rows["embedding"].combine_chunks().flatten()).reshape(-1, dim)).astype(np.float32)
    return out


def nearest(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The numbers of the NEAREST pivots of each vector, nearest first; of equally near ones the first."""
    k = min(NEAREST, len(pivots))
    out = np.empty((len(v), k), np.int32)
    step = max(1, (16 << 20) // len(pivots))
    for a in range(0, len(v), step):
        far = -(unit(v[a : a + step]).astype(np.float32) @ pivots.T)
        some = np.argpartition(far, k - 1, axis=1)[:, :k] if k < len(pivots) else np.broadcast_to(np.arange(k), (len(far), k))
        order = np.lexsort((some, np.take_along_axis(far, some, axis=1)), axis=1)
        out[a : a + step] = np.take_along_axis(some, order, axis=1)
    return out


def _members(numbers: np.ndarray) -> np.ndarray:
    """Which of the numbers that occur (but -1) each row has, as 0 and 1."""
    names, column = np.unique(numbers, return_inverse=True)
    out = np.zeros((len(numbers), len(names)), np.float32)
    np.put_along_axis(out, column.reshape(numbers.shape), 1, axis=1)
    return out[:, names >= 0]


def _list_column(matrix: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(matrix.ravel()), matrix.shape[1]).cast(pa.list_(pa.int32()))


def link_vectors(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors link if their labels are equal and not null, their lengths are equal and their cosine (double precision)
    is at least ``least``. Null, zero and non-finite vectors, those with null components, and rows without an id link
    with nothing: n_links 0, alone. Equal vectors of a label are one node with a weight, so copies cost nothing, and count
    as links of one another; rows that repeat an id count like others.

    A node is described by its NEAREST pivots in order of nearness and stands in the inverted lists, by label, of the first
    POSTED of them. Pairs of a list that share at least SHARED of their NEAREST pivots are retrieved, each in the first
    list that both are in, and verified. Lists longer than BLOCK are spread over all pairs of their blocks. A list sends on
    counts and a spanning forest of its links, never the links themselves. Recall is that of the index: near vectors
    that share no list are not found.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).cast("string").alias("label"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(~bad & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.select("vec_id", F.when(fine, F.col("label")).alias("label"), F.when(fine, F.transform("embedding", lambda x: x + 0.0)).alias("embedding"))
    good = rows.where(F.col("embedding").isNotNull())
    nodes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight")).withColumn("dim", F.size("embedding"))
    nodes = cut(nodes)
    pivots = nodes.sparkSession.sparkContext.broadcast(_pivots(nodes))

    def describe(batches):
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                if dim in pivots.value:
                    near = nearest(np.array(part.column(2).flatten()).reshape(-1, dim), pivots.value[dim])
                else:
                    near = np.zeros((part.num_rows, 1), np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, _list_column(near)], names=["label", "dim", "embedding", "node", "weight", "near"])

    described = nodes.select("label", "dim", "embedding", "node", "weight").mapInArrow(describe, "label string, dim int, embedding array<double>, node long, weight long, near array<int>")
    posted = cut(described).withColumn("pivot", F.explode(F.slice("near", 1, POSTED)))
    lengths = posted.groupBy("label", "dim", "pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    posted = lookup(posted, lengths, ["label", "dim", "pivot"], F.col("node")).withColumn("own", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    dealt = posted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("label", "dim", "pivot", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "weight", "near", "embedding")

    def verify(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("node")
        node, weight, own = (table[c].to_numpy() for c in ("node", "weight", "own"))
        pivot, lo, hi = (table[c][0].as_py() for c in ("pivot", "lo", "hi"))
        v = unit(np.array(table["embedding"].combine_chunks().flatten()).reshape(len(node), -1))
        near = np.array(table["near"].combine_chunks().flatten()).reshape(len(node), -1)
        held = _members(near)
        before = _members(np.where(near[:, :POSTED] < pivot, near[:, :POSTED], -1))  # lists that come earlier
        left, right = own == lo, own == hi
        links, edges_a, edges_b = np.zeros(len(node), np.int64), [], []
        need = min(SHARED, near.shape[1])
        for a in range(0, len(node), 512):
            b = min(a + 512, len(node))
            found = held[a:b] @ held.T >= need
            found &= np.arange(a, b)[:, None] < np.arange(len(node))[None, :]
            found &= (left[a:b, None] & right) | (right[a:b, None] & left)
            if before.shape[1]:
                found &= before[a:b] @ before.T == 0
            x, y = np.nonzero(found)
            if len(x) * 16 > found.size:  # most of them: one product is cheaper
                close = (v[a:b] @ v.T)[x, y] >= least
            else:
                parts = [np.einsum("ij,ij->i", v[x[i : i + PAIRS] + a], v[y[i : i + PAIRS]]) for i in range(0, len(x), PAIRS)]
                close = np.concatenate([*parts, np.zeros(0)]) >= least
            x, y = x[close], y[close]
            np.add.at(links, x + a, weight[y])
            np.add.at(links, y, weight[x + a])
            edges_a.append(x + a)
            edges_b.append(y)
        x, y = np.concatenate(edges_a), np.concatenate(edges_b)
        keep = forest(len(node), x, y)
        some = np.flatnonzero(links)
        return pa.table({"a": np.concatenate([node[some], node[x[keep]]]), "n": np.concatenate([links[some], np.zeros(keep.sum(), np.int64)]),
                         "b": pa.array(np.concatenate([np.zeros(len(some), np.int64), node[y[keep]]]), mask=np.arange(len(some) + keep.sum()) < len(some))},
                        schema=pa.schema([("a", pa.int64()), ("n", pa.int64()), ("b", pa.int64())]))

    found = cut(dealt.groupBy("label", "dim", "pivot", "lo", "hi").applyInArrow(verify, "a long, n long, b long"))
    reached = components(found.where(F.col("b").isNotNull()).select("a", "b"))
    counted = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    table = nodes.select("label", "embedding", "node", "weight").join(counted, "node", "left").join(reached, "node", "left")
    table = table.select("label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = lookup(rows, table, ["label", "embedding"], F.coalesce("vec_id", F.lit(0)))
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``link_vectors`` of all embeddings, at cosine 0.93 within labels."""
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All links of each label, pair by pair: what the index finds where its recall is 1.
ORACLE_SQL = """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (WITH RECURSIVE t AS (SELECT DISTINCT a, a AS b FROM l UNION SELECT t.a, l.b FROM t JOIN l ON l.a = t.b) SELECT a, min(b) AS c FROM t GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(c, vec_id) AS component_id, vec_id = coalesce(c, vec_id) AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN reach ON reach.a = vec_id
"""
