"""License scan: keyword-gated signature rules, resolved by priority and containment."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_signatures import PARTS, REACH, SEPARATORS, rules
from .matches import let, sums_before

# The base phrases and their labels.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
# Characters of words and separators before lower-casing.
_W, _S = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_DETECTION = "array<struct<start:bigint,stop:bigint,value:string,label:string,priority:int,confidence:double>>"
def _phrase(phrase: str) -> str:
    return f"(?<!{_W})" + _S.join(f"(?i:{w})" for w in phrase.split()) + f"(?!{_W})"


#: Characters of a text that are looked at together, and how far beyond them on either side.
CHUNK, SIDE = 4096, 2 * REACH
_WHOLE = f"(?s).{{1,{CHUNK}}}"


def _blanks(x: Column) -> Column:
    return (F.length(x) - F.length(F.replace(x, F.lit(" ")))).cast("long")


def _worded(text: Column, regex: Column) -> Column:
    """Matches of a pattern in a short text: array of (start, stop, before, after), with the blanks before either end.

    There is a match at every place from which the pattern matches, also inside another one, so that what is found does
    not depend on where a search began. The text is split before each of them: pieces add up to their places.
    """
    found = F.regexp_extract_all(text, F.concat(F.lit("(?=("), regex, F.lit("))")), F.lit(1))
    pieces = F.split(text, F.concat(F.lit("(?="), regex, F.lit(")")), F.lit(-1))
    spans = "array<struct<start:bigint,stop:bigint,before:bigint,after:bigint>>"

    def step(done: Column, x: Column) -> Column:
        start, before = done["at"] + F.length(x["piece"]), done["blanks"] + _blanks(x["piece"])
        stop, after = start + F.length(x["value"]), before + _blanks(x["value"])
        return F.struct(start.alias("at"), before.alias("blanks"), F.concat(done["out"], F.array(F.struct(start.alias("start"), stop.alias("stop"), before.alias("before"), after.alias("after")))).alias("out"))

    def paired(x: Column) -> Column:
        # a match at the very beginning has no piece before it
        lead = F.when(F.size(x["pieces"]) == F.size(x["found"]), F.concat(F.array(F.lit("")), x["pieces"])).otherwise(x["pieces"])
        return F.zip_with(F.slice(lead, 1, F.size(x["found"])), x["found"], lambda piece, value: F.struct(piece.alias("piece"), value.alias("value")))

    zero = F.lit(0).cast("long")
    pairs = let(F.struct(found.alias("found"), pieces.alias("pieces")), paired)
    return F.aggregate(pairs, F.struct(zero.alias("at"), zero.alias("blanks"), F.array().cast(spans).alias("out")), step, lambda done: done["out"])


def _chunks(plain: Column) -> Column:
    """A text in parts: array of (text, first, start, blanks).

    ``text`` is a chunk with SIDE characters of its neighbours, ``first`` the place of the chunk, ``start`` that of
    ``text``, and ``blanks`` those before it. A match is shorter than REACH, so one that begins in a chunk, and all that
    could contain it, lie in its part: the work is linear in the text, and what happens inside a part is bounded.
    """

    def numbered(chunks: Column) -> Column:
        before = sums_before(F.transform(chunks, _blanks))

        def part(c: Column, i: Column) -> Column:
            lead = F.when(i > 0, F.right(F.get(chunks, i - 1), F.lit(SIDE))).otherwise("")
            return F.struct(lead.alias("lead"), F.concat(lead, c, F.coalesce(F.left(F.get(chunks, i + 1), F.lit(SIDE)), F.lit(""))).alias("text"), i.alias("i"))

        def placed(x: Column, b: Column) -> Column:
            first = x["i"].cast("long") * CHUNK
            return F.struct(x["text"].alias("text"), first.alias("first"), (first - F.length(x["lead"])).alias("start"), (b - _blanks(x["lead"])).alias("blanks"))

        return F.zip_with(F.transform(chunks, part), before, placed)

    return let(F.regexp_extract_all(plain, F.lit(_WHOLE), F.lit(0)), numbered)


def _matches(plain: Column) -> Column:
    """Resolved spans of all gated rules in a text whose runs of separators are one blank each."""
    by_keyword: dict[str, list] = {}
    for keyword, *rule in rules():
        by_keyword.setdefault(keyword, []).append(rule)
    # one literal: thousands of small ones would take the driver seconds
    kind = "array<struct<keyword:string,rules:array<struct<literal:string,regex:string,priority:int,label:string,confidence:double>>>>"
    names = ("literal", "regex", "priority", "label", "confidence")
    table = F.from_json(F.lit(json.dumps([{"keyword": k, "rules": [dict(zip(names, r, strict=True)) for r in these]} for k, these in by_keyword.items()])), kind)

    def found(part: Column) -> Column:
        def by_rule(r: Column) -> Column:
            at = _worded(part["text"], r["regex"])
            base = lambda x, name, by: (x[name] + part[by]).alias(name)
            return F.transform(at, lambda x: F.struct(base(x, "start", "start"), base(x, "stop", "start"), base(x, "before", "blanks"), base(x, "after", "blanks"), r["label"].alias("label"), r["priority"].alias("priority"), r["confidence"].alias("confidence")))

        some = F.flatten(F.transform(F.filter(table, lambda k: F.contains(part["text"], k["keyword"])), lambda k: k["rules"]))
        spans = F.flatten(F.transform(F.filter(some, lambda r: F.contains(part["text"], r["literal"])), by_rule))
        return F.filter(_resolved(spans), lambda x: (x["start"] >= part["first"]) & (x["start"] < part["first"] + CHUNK))

    return F.flatten(F.transform(_chunks(plain), found))


def _resolved(spans: Column) -> Column:
    """``spans`` without those that lie inside a span of higher priority (or, at the same, a longer one).

    Equal spans of equal priority keep the alphabetically first label. A span is compared with those that begin
    less than REACH before it, cell by cell, so the work does not grow with the square of a text.
    """

    def beaten(x: Column, y: Column) -> Column:
        inside = (y["start"] <= x["start"]) & (x["stop"] <= y["stop"])
        longer = (y["stop"] - y["start"]) > (x["stop"] - x["start"])
        same = (y["start"] == x["start"]) & (x["stop"] == y["stop"])
        equal_rank = (y["priority"] == x["priority"]) & (longer | (same & (y["label"] < x["label"])))
        return inside & ((y["priority"] > x["priority"]) | equal_rank)

    def in_cells(spans: Column) -> Column:
        def near(cell: Column) -> Column:
            first = cell * REACH
            return F.struct(first.alias("first"), F.array_distinct(F.filter(spans, lambda x: (x["start"] >= first - REACH) & (x["start"] < first + REACH))).alias("spans"))

        kept = lambda c: F.filter(c["spans"], lambda x: (x["start"] >= c["first"]) & ~F.exists(c["spans"], lambda y: beaten(x, y)))
        cells = F.array_distinct(F.transform(spans, lambda x: F.floor(x["start"] / REACH)))
        return F.flatten(F.transform(F.transform(cells, near), kept))

    return let(spans, in_cells)


def _detections(text: Column) -> Column:
    """Resolved spans of all gated rules, by start, in code points of ``text`` (lower case); a rule's blank is any run of separators."""
    run = f"{SEPARATORS}++"

    def placed(x: Column) -> Column:
        chunks, longer, spans = x["chunks"], x["longer"], x["spans"]
        moved = lambda place, runs: place + F.get(longer, runs.cast("int"))

        def read(start: Column, stop: Column) -> Column:
            """What stands there; few spans are so long that the whole text must be asked."""
            i = F.floor(start / CHUNK).cast("int")
            near = F.substring(F.concat(F.get(chunks, i), F.coalesce(F.get(chunks, i + 1), F.lit(""))), (start - i * CHUNK + 1).cast("int"), (stop - start).cast("int"))
            return F.when(stop <= (i + 2) * CHUNK, near).otherwise(F.substring(x["text"], start.cast("int") + 1, (stop - start).cast("int")))

        ends = F.transform(spans, lambda s: F.struct(moved(s["start"], s["before"]).alias("start"), moved(s["stop"], s["after"]).alias("stop"), s.alias("s")))
        return F.array_sort(F.transform(ends, lambda e: F.struct(e["start"].alias("start"), e["stop"].alias("stop"), read(e["start"], e["stop"]).alias("value"), *(e["s"][c].alias(c) for c in ("label", "priority", "confidence")))))

    def of(text: Column) -> Column:
        # what the first n runs of separators are longer than their blanks, for each n
        longer = sums_before(F.concat(F.transform(F.regexp_extract_all(text, F.lit(run), F.lit(0)), lambda r: (F.length(r) - 1).cast("long")), F.array(F.lit(0).cast("long"))))
        return F.struct(text.alias("text"), F.regexp_extract_all(text, F.lit(_WHOLE), F.lit(0)).alias("chunks"), longer.alias("longer"), _matches(F.regexp_replace(text, run, " ")).alias("spans"))

    return let(let(text, of), placed)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, detections.

    Words are runs of digits, letters and characters above ASCII, A-Z as a-z. Base phrases are counted at every
    place where their words stand in sequence. ``detections`` are the resolved spans of the signature rules:
    (start, stop, value, label, priority, confidence), in code points of the text, by start.
    Null and empty texts have no words and no labels (first_word and last_word null). Rows may repeat, ids may be
    null, other columns are ignored. Built-in expressions on one row only: no shuffle.
    """
    out = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # words are what lies between separators, without an empty piece at either end
    out = out.withColumn("parts", F.split("text", _S, -1))
    at_ends = F.when(F.element_at("parts", 1) == "", 1).otherwise(0) + F.when((F.size("parts") > 1) & (F.element_at("parts", -1) == ""), 1).otherwise(0)
    out = out.withColumn("n_words", (F.size("parts") - at_ends).cast("long")).drop("parts")
    # cheap searches in every text, and all else in the few that pass them
    out = out.withColumn("folded", F.lower("text"))
    some = F.lit(False)
    for part in PARTS:
        some = some | F.contains("folded", F.lit(part))
    out = out.withColumn("lower", F.when(some, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))).drop("folded")
    out = out.withColumn("spans", F.when(F.col("lower").isNotNull(), _detections(F.col("lower"))))
    for i, (phrase, _) in enumerate(PHRASES):
        out = out.withColumn(f"n{i}", F.when(F.col("lower").isNotNull(), F.regexp_count("text", F.lit(_phrase(phrase)))).otherwise(0))
    firsts, lasts, labels = [], [], []
    for i, (phrase, label) in enumerate(PHRASES):
        parts = F.split("text", _phrase(phrase), -1)
        words = len(phrase.split())
        firsts.append(F.when(F.col(f"n{i}") > 0, F.regexp_count(F.element_at(parts, 1), F.lit(f"{_W}+")).cast("long")))
        lasts.append(F.when(F.col(f"n{i}") > 0, F.col("n_words") - words - F.regexp_count(F.element_at(parts, -1), F.lit(f"{_W}+"))))
        labels.append(F.when(F.col(f"n{i}") > 0, F.lit(label)))
    return out.select(
        "doc_id", "n_words", sum((F.col(f"n{i}") for i in range(len(PHRASES))), F.lit(0)).cast("long").alias("n_base"),
        F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"),
        F.array_compact(F.array(*labels)).alias("base_labels"),
        F.coalesce(F.col("spans"), F.array().cast(_DETECTION)).alias("detections"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    labels = F.concat("base_labels", F.transform("detections", lambda x: x["label"]))
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    base = F.when(F.col("n_base") > 0, 0.9).otherwise(0.0)
    score = F.greatest(base, F.coalesce(F.array_max(F.transform("detections", lambda x: x["confidence"])), F.lit(0.0)))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base_labels")).alias("base_labels"), joined(labels).alias("labels"), score.alias("score"))


def op3_licenses_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op3_licenses`` that the base phrases fix, for comparison with SQL."""
    return op3_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


_STANDS = " UNION ALL ".join(
    f"SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, '{label}' AS label, w, {len(phrase.split())} AS k, [{', '.join(repr(x) for x in phrase.split())}] AS p FROM d" for phrase, label in PHRASES)
BASE_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT doc_id, i - 1 AS i, label FROM ({_STANDS}) WHERE w[i] = p[1] AND w[i:i + k - 1] = p)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, count(s.i) AS n_base, CAST(min(s.i) AS BIGINT) AS first_word, CAST(max(s.i) AS BIGINT) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id, w
"""
