"""Language identification by averaged subword embeddings, with calibrated rejection."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .classify import SAMPLE, apply_texts, fold, pairs, posteriors, sample_per_class
from .subword import Model, train_texts

UNKNOWN = "und"


def fit_languages(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = SAMPLE) -> Model | None:
    """Learn from at most ``most`` rows that have a text and a language (fewer for each class if there are many).

    None if there is no such row.
    """
    texts, langs = pairs(sample_per_class(rows.where(F.col(text_col).isNotNull()), id_col, lang_col, most, text_col), id_col, text_col, lang_col)
    if not langs:
        return None
    labels = sorted(set(langs))
    at = {x: i for i, x in enumerate(labels)}
    return train_texts(texts, np.array([at[x] for x in langs]), labels)


def has_letter(text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a character of one of Unicode's letter categories (L*)."""
    ascii_letter = ((text | 32) >= 97) & ((text | 32) <= 122)
    counts = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = np.diff(counts[offsets]) > 0
    for i in np.flatnonzero(~out):  # only texts without an ASCII letter are decoded
        out[i] = any(unicodedata.category(c)[0] == "L" for c in set(text[offsets[i] : offsets[i + 1]].tobytes().decode()))
    return out


def _scorer(model: Model | None) -> Callable:
    def score(text: np.ndarray, offsets: np.ndarray) -> list:
        n = len(offsets) - 1
        if model is None:
            return [[UNKNOWN] * n, np.zeros(n), np.ones(n, bool)]
        p = posteriors(model)(text, offsets)
        best, top, fine = p.argmax(axis=1), p.max(axis=1), has_letter(text, offsets)
        labels = np.array([*model.labels, UNKNOWN], object)
        return [labels[np.where(fine, best, len(model.labels))], np.where(fine, top, 0.0), ~fine | (top < model.threshold)]

    return score


def identify(docs: DataFrame, model: Model | None, kept: list[str], text_col: str = "text") -> DataFrame:
    """``kept`` columns of ``docs``, lang_pred, score (the calibrated probability, 0 to 1) and rejected, for whole texts.

    A null text, or one without any letter, is ``und`` with score 0 and rejected; every text is if ``model`` is None.
    Otherwise rejected means that the probability is under the model's calibrated threshold. Of languages equally
    likely the alphabetically first is taken. Rows may repeat; other columns are ignored. No shuffle.
    """
    return apply_texts(docs, text_col, _scorer(model), kept, "lang_pred string, score double, rejected boolean")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``identify`` for all documents by a model of those outside fold 2 of 4."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", fold("doc_id", 4) == 2)
    model = fit_languages(docs.where(~F.col("held_out")))
    return identify(docs, model, ["doc_id", "held_out"])
