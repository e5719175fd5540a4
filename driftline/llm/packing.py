"""Best-fit packing of texts into fixed-size training sequences, with conflicts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scale import cut

#: Tokens a bin holds, and about the pieces that are packed together.
CAPACITY, SHARD = 2048, 4096
_WORD = r"[^\x20\x09-\x0D]+"


def best_fit(items: list[tuple], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset in it) for each (size, source, cluster): largest first, each into the tightest compatible bin.

    Bins lie in lists by the room they have left, and a bitmap tells which lists hold any. A bin also carries
    bitmaps of its sources and duplicate clusters; it is compatible if it has neither that of the item. The search
    goes from the smallest sufficient room upwards until a bin is compatible, oldest first within a list, and opens a
    new bin only after the last. A null source or cluster is in conflict with nothing.
    """
    bits: dict = {}

    def bit(kind: int, key) -> int:
        return 0 if key is None else 1 << bits.setdefault((kind, key), len(bits))

    marks = [bit(0, source) | bit(1, cluster) for _, source, cluster in items]
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r: rooms[r] is not empty
    taken: list[int] = []  # the bitmap of each bin
    out: list[tuple[int, int]] = [(-1, -1)] * len(items)
    for i in sorted(range(len(items)), key=lambda i: -items[i][0]):
        size, mark = items[i][0], marks[i]
        rest, room, found = some >> size, size, -1
        while rest and found < 0:
            step = (rest & -rest).bit_length() - 1
            room, rest = room + step, rest >> step
            for at, b in enumerate(rooms[room]):
                if not taken[b] & mark:
                    found = b
                    del rooms[room][at]
                    if not rooms[room]:
                        some &= ~(1 << room)
                    break
            else:
                room, rest = room + 1, rest >> 1
        if found < 0:
            found, room = len(taken), capacity
            taken.append(0)
        taken[found] |= mark
        out[i] = (found, capacity - room)
        if room > size:
            rooms[room - size].append(found)
            some |= 1 << (room - size)
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = "source", cluster: Column | None = None) -> DataFrame:
    """One row per piece of a row of ``docs``: doc_id, source, piece, start, n_tokens, bin_id, bin_offset.

    Tokens are runs of characters other than blank and \\t to \\r. Texts longer than ``capacity`` are cut into
    pieces of that size, which fill a bin alone, and a rest; ``start`` is the piece's first token in its text.
    No bin holds two pieces of one source, or of one duplicate cluster (by default, of equal texts; rows that repeat,
    such as copies made by mixing, are such a cluster). ``source_col`` None: sources are not in conflict.
    Texts without a token, null ones too, are one row with piece 0, n_tokens 0 and bin_id null.
    Every row is packed, none is cut off. Pieces, not texts, are dealt over shards of about ``shard`` pieces by a hash of id, text,
    place and the number of the copy, so a shard is as large whatever one text, source or group of copies holds, and is
    the same however the input was partitioned. Each shard is packed alone: best fit is among its own bins. ``docs``
    without a column ``source_col`` is as with None. Other columns are ignored.
    """
    cluster = F.xxhash64(F.col(text_col)) if cluster is None else cluster
    source = F.col(source_col).cast("string") if source_col is not None and source_col in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), source.alias("source"), cluster.alias("cluster"), F.coalesce(F.regexp_count(text_col, F.lit(_WORD)), F.lit(0)).cast("long").alias("tokens"))
    # equal rows are numbered by counting them, which no order of rows can change
    rows = cut(rows.groupBy("doc_id", "source", "cluster", "tokens").agg(F.count(F.lit(1)).alias("rows")))
    last = F.greatest(F.ceil(F.col("tokens") / capacity).cast("long") - 1, F.lit(0).cast("long"))
    total = rows.agg(F.coalesce(F.sum((last + 1) * F.col("rows")), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard))
    pieces = rows.select("doc_id", "source", "cluster", "tokens", F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("copy"))
    pieces = pieces.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    pieces = pieces.withColumn("start", F.col("piece") * capacity).withColumn("n_tokens", F.least(F.col("tokens") - F.col("start"), F.lit(capacity).cast("long"))).drop("tokens")
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "piece", "copy"), F.lit(shards)))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([(c, "ascending") for c in ("doc_id", "piece", "source", "cluster", "copy")])  # about ``shard`` rows of numbers
        sizes = table["n_tokens"].to_pylist()
        items = list(zip(sizes, table["source"].to_pylist(), table["cluster"].to_pylist(), strict=True))
        full = [i for i, n in enumerate(sizes) if n > 0]
        first = table["shard"][0].as_py() << 32
        bins, offsets = [None] * len(sizes), [None] * len(sizes)
        for i, (b, at) in zip(full, best_fit([items[i] for i in full], capacity), strict=True):
            bins[i], offsets[i] = first + b, at
        table = table.drop_columns(["cluster", "copy", "shard"]).append_column("bin_id", pa.array(bins, pa.int64())).append_column("bin_offset", pa.array(offsets, pa.int64()))
        return table.select(["doc_id", "source", "piece", "start", "n_tokens", "bin_id", "bin_offset"])

    id_type = dict(rows.dtypes)["doc_id"]
    return pieces.groupBy("shard").applyInArrow(run, f"doc_id {id_type}, source string, piece long, start long, n_tokens long, bin_id long, bin_offset long")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pack`` of all documents; no bin holds two pieces of one source or of one text."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
