"""Fitting text classifiers on bounded samples, and applying them to whole tables by Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import subword, textnum
from .scale import cut

#: At most about so many rows of a table are learned from, all classes together.
SAMPLE = 4000
#: Longer texts are not learned from, and no more classes than this, the most frequent ones.
LONGEST, CLASSES = 100_000, 1000
#: Bytes of text, all classes together, that are brought to the driver to be learned from.
BYTES = 1 << 25


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)), F.lit(0))


def class_counts(rows: DataFrame, class_col: str, classes: int = CLASSES) -> dict:
    """Rows of each class, of the ``classes`` most frequent ones: so many numbers at most reach the driver."""
    counted = rows.where(F.col(class_col).isNotNull()).groupBy(class_col).count().orderBy(F.col("count").desc(), class_col).limit(classes)
    return {r[0]: r[1] for r in counted.collect()}


def sample_per_class(rows: DataFrame, id_col: str, class_col: str, most: int = SAMPLE, text_col: str | None = None, shares: dict | None = None) -> DataFrame:
    """Rows with a class, never more than ``most``, the same in every run: for each class those of the lowest hashes of id and text.

    The rarest classes keep all their rows; what they leave is divided among the others, unless ``shares`` says how many
    rows a class gets. Rows that repeat id, class and text are one. Texts of more than LONGEST characters are not taken,
    and the CLASSES most frequent classes only, so what is collected of a sample has a bound.
    """
    rows = rows.where(F.col(class_col).isNotNull())
    if text_col is not None:
        rows = rows.where(F.length(text_col) <= LONGEST)
    counts, left, rate = class_counts(rows, class_col), most, {}
    for i, (label, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], str(x[0])))):
        take = min(n, left // (len(counts) - i)) if shares is None else min(n, shares.get(label, 0))
        rate[label] = take / n
        left -= take
    if not rate:
        return rows.limit(0)
    rates = F.create_map(*[x for label, s in rate.items() for x in (F.lit(label), F.lit(float(s)))])[F.col(class_col)]
    same = [F.col(id_col).cast("string"), F.col(class_col).cast("string")] + ([F.xxhash64(text_col).cast("string")] if text_col else [])
    dice = (F.pmod(F.xxhash64(*[F.coalesce(x, F.lit("")) for x in same]), F.lit(1 << 30)) + 1) / float(1 << 30)
    chosen = rows.withColumn("__dice", dice / rates).where(F.col("__dice") <= 1)
    chosen = chosen.withColumn("__same", F.xxhash64(*same)).dropDuplicates(["__same", "__dice"])
    return chosen.orderBy("__dice", "__same").limit(most).select(*rows.columns)


def pairs(rows: DataFrame, id_col: str, text_col: str, class_col: str, shares: dict | None = None, most: int = BYTES) -> tuple[tuple[np.ndarray, np.ndarray], list]:
    """Texts (as flat bytes) and classes of a sample, by id and text, so that training repeats exactly.

    Never more than ``most`` bytes of text: a sample with more is thinned to whole texts, see ``_last_keys``.
    """
    rows = cut(rows.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(class_col).alias("c"), F.xxhash64(id_col, text_col).alias("k")))
    last = _last_keys(rows.select("c", "k", F.octet_length("t")).collect(), shares, most)  # numbers of a bounded sample
    if last is not None:
        lasts = F.create_map(*[F.lit(x) for item in last.items() for x in item]) if last else F.lit(None)
        rows = rows.where(F.col("k") <= (lasts[F.col("c")] if last else F.lit(None)))
    table = rows.drop("k").toArrow()
    table = table.sort_by([("i", "ascending"), ("t", "ascending")])
    return textnum.flat(table["t"]), table["c"].to_pylist()


def _last_keys(sizes: list[tuple], shares: dict | None, most: int) -> dict | None:
    """The largest key of each class that is kept, of rows (class, key, bytes); None if all rows have ``most`` bytes at most.

    Classes take turns, each as often as its share (equally without ``shares``), in the order of their keys, until the
    next text would go beyond ``most``. So the rarest classes lose rows last.
    """
    if sum(n or 0 for _, _, n in sizes) <= most:
        return None
    turns, seen = [], {}
    for label, key, n in sorted(sizes, key=lambda x: x[1]):
        seen[label] = seen.get(label, 0) + 1
        turns.append((seen[label] / (shares or {}).get(label, 1), key, label, n or 0))
    last, total = {}, 0
    for _, key, label, n in sorted(turns, key=lambda x: x[:2]):
        total += n
        if total > most:
            break
        last[label] = key
    return last


def texts_of(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, and the columns of ``chosen``) for a sample of ids: one text for each, the smallest that is not null or over LONGEST.

    ``chosen`` is bounded and broadcast; texts are not shuffled but for the chosen ones, combined before that.
    """
    rows = docs.where(F.length(text_col) <= LONGEST).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    rest = [c for c in chosen.columns if c != "id"]
    return rows.groupBy("id", *rest).agg(F.min("text").alias("text"))


def apply_texts(rows: DataFrame, text_col: str, score: Callable, kept: list[str], schema: str) -> DataFrame:
    """``kept`` columns and those that ``score(text bytes, offsets)`` returns (a list of arrays) for each batch of whole texts."""
    names = [x.split()[0] for x in schema.split(",")]
    at = kept.index(text_col) if text_col in kept else len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, offsets = textnum.flat(batch.column(at))
            for i, j in textnum.groups(offsets, 4 * textnum.PIECE):
                found = score(text[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(len(kept))), *map(pa.array, found)], names=[*kept, *names])

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    head = ", ".join(f"`{c}` {types[c]}" for c in kept)
    read = rows.select(*kept) if text_col in kept else rows.select(*kept, F.col(text_col).alias("__text"))
    return read.mapInArrow(run, f"{head}, {schema}")


def posteriors(model: subword.Model) -> Callable:
    """Probabilities (texts x labels) at the model's temperature."""
    return lambda text, offsets: subword.softmax(subword.text_logits(model, text, offsets), model.temperature)
