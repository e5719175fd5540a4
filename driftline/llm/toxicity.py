"""Toxicity by subword bags: n-grams averaged into a linear softmax, learned jointly from the labels of whole texts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .classify import apply_texts, class_counts, fold, pairs, sample_per_class, texts_of
from .scale import cut
from .subword import Detector, train_detector

#: At most so many labelled texts are learned from.
TEXTS = 6000


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = TEXTS) -> Detector | None:
    """Learn from at most ``most`` labelled texts, a quarter of them toxic (many clean ones tell chance from meaning). None without both labels.

    A text that any of its labels calls toxic is. The scores are calibrated to the share of toxic rows among the labels.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("id").isNotNull() & F.col("label").isin(0, 1))
    known = cut(known.groupBy("id").agg(F.max("label").alias("label")))
    counts = class_counts(known, "label")
    if len(counts) < 2:
        return None
    shares = {1: most // 4, 0: most - most // 4}
    chosen = cut(sample_per_class(known, "id", "label", most, shares=shares))
    texts, targets = pairs(texts_of(docs, chosen, id_col, text_col), "id", "text", "label", shares)
    if len(set(targets)) < 2:
        return None
    return train_detector(texts, np.array(targets), counts[1] / (counts[0] + counts[1]))


def _scorer(model: Detector | None) -> Callable:
    def score(text: np.ndarray, offsets: np.ndarray) -> list:
        n = len(offsets) - 1
        z = model.logits(text, offsets) if model is not None else np.full(n, -6.0)
        z = np.where(np.diff(offsets) > 0, z, np.minimum(z, -6.0))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return [p, (p >= 0.5).astype(np.int32)]

    return score


def score_toxicity(docs: DataFrame, model: Detector | None, kept: list[str], text_col: str = "text") -> DataFrame:
    """``kept`` columns of ``docs``, score (0 to 1, higher: likelier toxic) and predicted (1 from 0.5), for whole texts.

    Null and empty texts get a fixed low score (0.0025); so does every text without a model. Rows may repeat; other columns are ignored. No shuffle.
    """
    return apply_texts(docs, text_col, _scorer(model), kept, "score double, predicted int")


def drop_toxic(docs: DataFrame, model: Detector | None, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text is predicted toxic, all columns as they were, whatever their names."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    scored = score_toxicity(plain, model, plain.columns, f"c{names.index(text_col)}")
    return scored.where(F.col("predicted") == 0).select(*plain.columns).toDF(*names)


def fit_from_tables(spark: SparkSession, sf_dir: str) -> Detector | None:
    """A model from the rows of ``labels`` outside fold 0 of 5."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id", 5) != 0)
    return fit_toxicity(docs.select("doc_id", "text"), labels)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``score_toxicity`` of all documents by a model of the labelled rows outside fold 0 of 5."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", (fold("doc_id", 5) == 0).alias("held_out"))
    return score_toxicity(docs, fit_from_tables(spark, sf_dir), ["doc_id", "held_out"])
