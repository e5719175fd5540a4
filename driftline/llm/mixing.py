"""Mixing to target weights: soft domain memberships, and rates fitted by distributed projected gradients."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .classify import SAMPLE, apply_texts, class_counts, pairs, posteriors, sample_per_class, texts_of
from .scale import cut
from .subword import Model, train_texts

#: Weight of staying near rate 1; it makes the solution unique.
RIDGE = 1e-4
#: Steps after which the rates are written down, so that a row never replays more.
REPLAY = 25


def fit_domains(docs: DataFrame, labelled: DataFrame, domain_col: str, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE) -> Model | None:
    """A classifier of domains from at most ``most`` rows of ``labelled``; ids with several domains take the least.

    N-grams keep punctuation: domains such as quality differ in it. The sampled ids are bounded by ``most`` and
    broadcast; texts are not shuffled. None if no labelled row has a text.
    """
    known = labelled.select(F.col(id_col).alias("id"), F.col(domain_col).cast("string").alias("domain")).where(F.col("id").isNotNull() & F.col("domain").isNotNull())
    known = cut(known.groupBy("id").agg(F.min("domain").alias("domain")))
    counts = class_counts(known, "domain")
    chosen = cut(sample_per_class(known, "id", "domain", most))
    texts, domains = pairs(texts_of(docs, chosen, id_col, text_col), "id", "text", "domain")
    if not domains:
        return None
    labels = sorted(set(domains))
    at = {x: i for i, x in enumerate(labels)}
    model = train_texts(texts, np.array([at[x] for x in domains]), labels, epochs=3, punctuation=True)
    # the sample is balanced; the posteriors should be those of the labelled table
    prior = np.array([counts[x] / domains.count(x) for x in labels])
    model.bias = model.bias + model.temperature * np.log(prior / prior.sum())
    return model


def memberships(docs: DataFrame, model: Model | None, kept: list[str], text_col: str = "text") -> DataFrame:
    """``kept``, n_tokens (words between blanks) and p, the domain posteriors of each whole text. Without a model, one domain."""
    predict = posteriors(model) if model is not None else lambda text, offsets: np.ones((len(offsets) - 1, 1))

    def score(text: np.ndarray, offsets: np.ndarray) -> list:
        blank = (text == 32) | ((text >= 9) & (text <= 13))
        begins = ~blank
        begins[1:] &= blank[:-1]
        begins[offsets[:-1][offsets[:-1] < len(text)]] |= ~blank[offsets[:-1][offsets[:-1] < len(text)]]
        counts = np.concatenate([[0], np.cumsum(begins)])
        p = predict(text, offsets)
        return [np.diff(counts[offsets]).astype(np.int64), pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), p.shape[1]).cast(pa.list_(pa.float64()))]

    return apply_texts(docs, text_col, score, kept, "n_tokens long, p array<double>")


def _replay(p: np.ndarray, r: np.ndarray, before: np.ndarray, slopes: list, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Rates after the projected, accelerated steps whose domain residuals and momenta are ``slopes``; and those before the last."""
    for slope, momentum in slopes:
        y = r + momentum * (r - before)
        r, before = np.maximum(0, y - (p @ slope + ridge * (y - 1)) / (1 + ridge)), r
    return r, before


def fit_rates(members: DataFrame, targets: np.ndarray, ridge: float = RIDGE, steps: int = 75, close: float = 1e-4) -> DataFrame:
    """``members`` (with p and n_tokens) and ``rate`` >= 0, so that rates times tokens times p add up to the targets.

    Minimises, over all rates at once, half the squared distance between the domains' shares of expected tokens and
    ``targets`` (of the corpus' total), plus ``ridge`` / 2 times the token-weighted squared distance from rate 1. A
    step is one pass over the numbers (no text): each task replays the steps so far on its rows, and only the
    sums of a few domains come back. After REPLAY steps rates go to the checkpoint folder.
    Rows without tokens take no part in the sums but get a rate too. An empty table stays empty.
    """
    k = len(targets)
    total = members.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    types = dict(members.dtypes)
    state = members.withColumn("rate", F.lit(1.0)).withColumn("before", F.lit(1.0))
    if not total:
        return state.drop("before")
    names = list(members.columns)
    head = ", ".join(f"`{c}` {types[c]}" for c in names)

    def columns(batch: pa.RecordBatch) -> tuple:
        p = batch.column("p").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
        return p, *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("rate", "before"))

    def advance(state: DataFrame, slopes: list) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                r, before = _replay(*columns(batch), slopes, ridge)
                rest = [batch.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(r), pa.array(before)], names=[*names, "rate", "before"])

        return state.mapInArrow(run, f"{head}, rate double, before double")

    def shares(state: DataFrame, slopes: list, momentum: float) -> np.ndarray:
        """The domains' shares at the point from which the next step goes."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = np.zeros(k)
            for batch in batches:
                p, r, before = columns(batch)
                r, before = _replay(p, r, before, slopes, ridge)
                s += (batch.column("n_tokens").to_numpy(zero_copy_only=False) * (r + momentum * (r - before))) @ p
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in s], names=[f"s{i}" for i in range(k)])

        sums = state.select("n_tokens", "p", "rate", "before").mapInArrow(run, ", ".join(f"s{i} double" for i in range(k)))
        return np.array([x or 0.0 for x in sums.agg(*[F.sum(f"s{i}") for i in range(k)]).first()]) / total

    slopes: list = []
    last, age = None, 1.0
    for _ in range(steps):
        older = (1 + (1 + 4 * age * age) ** 0.5) / 2
        momentum = (age - 1) / older
        slope = shares(state, slopes, momentum) - targets
        if last is not None and np.abs(slope - last).max() < close / 20:
            break
        if last is not None and slope @ (slope - last) > 0:  # going uphill: start the momentum anew
            older = 1.0
        last, age = slope, older
        slopes.append((slope, momentum))
        if len(slopes) == REPLAY:
            state, slopes = cut(advance(state, slopes)), []
    return advance(state, slopes).drop("before")


def goal(labels: list, targets: dict[str, float]) -> np.ndarray:
    """Target shares in the order of ``labels``, summing to 1; uniform if none is positive. Others' targets are left out (``reached`` tells)."""
    out = np.array([max(0.0, targets.get(x, 0.0)) for x in labels])
    return out / out.sum() if out.sum() > 0 else np.full(len(labels), 1 / len(labels))


def mix(docs: DataFrame, model: Model | None, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, domain (the likeliest), p, rate, copies.

    ``copies`` is the rate rounded up or down by a fixed hash of the id, so that its mean is the rate. Null ids are
    rounded by the same hash as one another. Null and empty texts have no tokens and the posteriors of an empty text.
    """
    labels = model.labels if model is not None else ["all"]
    members = cut(memberships(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model, ["doc_id"]))
    rated = fit_rates(members, goal(labels, targets))
    dice = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    domain = F.element_at(F.array(*map(F.lit, labels)), F.array_position("p", F.array_max("p")).cast("int"))
    return rated.select("doc_id", "n_tokens", domain.alias("domain"), "p", "rate", F.floor(F.col("rate") + dice).cast("long").alias("copies"))


def apply_mix(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with each row as often as ``mixed`` has ``copies`` for its id: none, once or more, all columns as they were.

    An id that repeats takes its largest number; rows with a null id stay once.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # no name can clash
    copies = mixed.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max("copies").alias("copies"))
    joined = plain.join(copies, F.col(f"c{names.index(id_col)}") == F.col("id"), "left")
    times = F.coalesce("copies", F.lit(1)).cast("int")
    each = F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>")))
    return joined.select(*plain.columns, each.alias("copy")).select(*plain.columns).toDF(*names)


def reached(mixed: DataFrame, labels: list, targets: dict[str, float]) -> DataFrame:
    """One row per domain: domain, target, and its share of tokens natural (rate 1), expected (rates) and copied (copies).

    A target for a domain of which no text was learned is a row too, with shares of 0: nothing can meet it.
    ``mixed`` is from ``mix``; only the sums reach the driver. Shares are of the corpus' total tokens before mixing.
    """
    sums = []
    for i in range(len(labels)):
        part = F.col("n_tokens") * F.col("p")[i]
        sums += [F.sum(part).alias(f"n{i}"), F.sum(part * F.col("rate")).alias(f"e{i}"), F.sum(part * F.col("copies")).alias(f"c{i}")]
    found = mixed.agg(F.sum("n_tokens").alias("total"), *sums).first()
    total = found["total"] or 1
    rows = [(x, float(t), *((found[f"{s}{i}"] or 0.0) / total for s in "nec")) for i, (x, t) in enumerate(zip(labels, goal(labels, targets), strict=True))]
    rows += [(x, float(t), 0.0, 0.0, 0.0) for x, t in sorted(targets.items()) if t > 0 and x not in labels]
    return mixed.sparkSession.createDataFrame(rows, "domain string, target double, natural double, expected double, copied double")


#: Shares of tokens that the corpus should have by quality, as the table ``labels`` marks it; about 13 % are low before.
TARGETS = {"low": 0.05, "high": 0.95}


def fit_from_tables(spark: SparkSession, sf_dir: str) -> Model | None:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    domain = F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return fit_domains(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), labels.select("doc_id", domain.alias("domain")), "domain")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mix`` of all documents to TARGETS, by qualities learned from the table ``labels``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return mix(docs, fit_from_tables(spark, sf_dir), TARGETS)
