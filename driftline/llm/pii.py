"""Personal data: patterns propose spans, checksums confirm them, context words move the score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .matches import places

# What is searched for. Every quantifier that cannot profit from giving back is possessive, and a run
# cannot be entered in its middle, so no text costs more than a constant number of steps a character.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "key": r"(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|github_pat_[A-Za-z0-9_]{22,}+|glpat-[A-Za-z0-9_-]{20,}+|sk_(?:live|test)_[A-Za-z0-9]{16,}+|sk-[A-Za-z0-9_-]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[A-Za-z0-9_-]{35}|npm_[A-Za-z0-9]{36}|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]++)(?![A-Za-z0-9_])",
    "pem": r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----",
    "secret": r"(?i:(?<![a-z0-9])(?:password|passwd|pwd|passphrase|secret|token|api[_ -]?key|access[_ -]?key|auth[_ -]?token)[\x20\t\"']{0,4}+(?:=|:|:=|=>)[\x20\t\"']{0,4}+)[^\x00-\x20\"',;<>]{6,128}+",
}
BASE = ("email", "ip", "card", "phone")
SECRETS = ("key", "pem", "secret")
# A cheap test that a text must pass before its pattern runs.
GATES = {"email": "@", "ip": ".", "card": r"[0-9][\x20-]?[0-9]", "phone": "+", "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"[0-9]-[0-9]{2}-[0-9]", "key": r"AKIA|ASIA|gh[pousr]_|github_pat|glpat-|sk[_-]|xox|AIza|npm_|eyJ", "pem": r"-----BEGIN", "secret": r"(?i:pass|pwd|secret|token|key)[^\n]{0,12}[=:]"}
# Words that make a kind likelier when they stand within CONTEXT characters of a span, and scores.
WORDS = {
    "email": r"e-?mail|contact|write to|address",
    "ip": r"\bip\b|host|server|address|ping",
    "card": r"card|visa|credit|debit|payment|mastercard|amex",
    "phone": r"tel\b|phone|call|fax|mobile|whatsapp",
    "iban": r"iban|account|bank|transfer|konto|compte|cuenta",
    "ssn": r"\bssn\b|social security|social-security|taxpayer",
    "key": r"key|token|secret|bearer|credential",
    "pem": r"key",
    "secret": r"login|user|account|config|export|env",
}
SCORES = {"email": 0.85, "ip": 0.6, "card": 0.75, "phone": 0.65, "iban": 0.8, "ssn": 0.3, "key": 0.8, "pem": 0.9, "secret": 0.6}
LIFT, CONTEXT, LEAST = 0.25, 40, 0.5
# Fixed value: a number up to 255 with any zeros before it.
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right doubled, digits of the products added, the sum divisible by ten."""
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.struct(c.cast("int").alias("d"), (i % 2).alias("odd")))
    total = F.aggregate(each, F.lit(0), lambda s, x: s + F.when(x["odd"] == 0, x["d"]).otherwise(x["d"] * 2 - F.when(x["d"] > 4, 9).otherwise(0)))
    return total % 10 == 0


def _mod97(value: Column) -> Column:
    """The ISO 7064 check of an IBAN: first four characters to the end, letters as 10 to 35, remainder 1."""
    plain = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    rest = F.aggregate(
        F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0),
        lambda s, c: F.when(c.between("0", "9"), (s * 10 + F.ascii(c) - 48) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97))
    return rest == 1


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":  # compared as text, so no part overflows a number
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.length(_digits(value)).between(13, 19) & _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    if kind == "iban":
        return _mod97(value)
    if kind == "ssn":
        return ~value.rlike("^(000|666|9)")
    return F.lit(True)


def _passes(kind: str):
    return lambda x: _valid(kind, x["value"])


def _is(kind: str):
    return lambda x: x["kind"] == kind


def _scored(kind: str):
    """Adds the kind and the score to a place."""

    def scored(x: Column) -> Column:
        near = F.lower(F.concat(x["before"], F.lit(" "), x["after"]))
        score = F.lit(SCORES[kind]) + F.when(near.rlike(WORDS[kind]), LIFT).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), x["value"].alias("value"), F.least(score, F.lit(1.0)).alias("score"))

    return scored


def _gate(kind: str, text: Column) -> Column:
    return text.contains(GATES[kind]) if len(GATES[kind]) == 1 else text.rlike(GATES[kind])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id and ``spans``, an array of (kind, start, stop, value, score).

    Kinds are those of PATTERNS; passwords, keys and tokens are among them. Spans stand by kind, then start; positions are code points, stop exclusive. Kinds of BASE are kept whenever their
    validator passes; the others need a score of LEAST, to which context words add that stand within CONTEXT characters
    of the span and not behind another match of the kind. A match that fails its
    validator is dropped and not tried again shorter. Kinds are searched independently, so spans of two kinds may
    overlap. Null and empty texts have no spans; rows may repeat, ids may be null, other columns are ignored.
    Everything is built-in expressions on one row, linear in its text: no shuffle.
    """
    out = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    for kind, pattern in PATTERNS.items():
        found = F.when(_gate(kind, F.col("text")), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none)
        out = out.withColumn(f"found_{kind}", found)
    for kind, pattern in PATTERNS.items():
        found = F.col(f"found_{kind}")
        out = out.withColumn(f"at_{kind}", F.when(F.size(found) > 0, F.filter(places(F.split("text", pattern, -1), found, CONTEXT), _passes(kind))))
    spans = []
    for kind in PATTERNS:
        each = F.transform(F.col(f"at_{kind}"), _scored(kind))
        each = each if kind in BASE else F.filter(each, lambda x: x["score"] >= LEAST)
        spans.append(F.coalesce(each, F.array().cast("array<struct<kind:string,start:bigint,stop:bigint,value:string,score:double>>")))
    return out.select("doc_id", F.concat(*spans).alias("spans"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")

    counts = [F.size(F.filter("spans", _is(kind))).cast("long").alias(f"n_{kind}") for kind in BASE]
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    secrets = F.size(F.filter("spans", lambda x: x["kind"].isin(*SECRETS))).cast("long")
    return found.select(
        "doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        secrets.alias("n_secret"), F.size("spans").cast("long").alias("n_spans"), F.array_max(F.transform("spans", lambda x: x["score"])).alias("top_score"))


def _base_sql() -> str:
    """SQL for the base kinds: pieces between matches and matches alternate, so their lengths add up to positions."""
    luhn = "list_sum(list_transform(string_split(reverse(regexp_replace(v, '[^0-9]', '', 'g')), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INTEGER) ELSE CAST(c AS INTEGER) * 2 - CASE WHEN CAST(c AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
    digits = "len(regexp_replace(v, '[^0-9]', '', 'g'))"
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "regexp_full_match(v, '0*(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(\\.0*(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}')".replace("\\\\", "\\")),
        "card": (r"[0-9]([\x20-]?[0-9])+", f"{digits} BETWEEN 13 AND 19 AND {luhn}"),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"{digits} BETWEEN 9 AND 15"),
    }
    parts, each = [], []
    for n, (kind, (pattern, test)) in enumerate(kinds.items()):
        each.append(f"{kind}_m AS (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS ms FROM d)")
        each.append(f"{kind}_r AS (SELECT doc_id, unnest(ms) AS v, unnest(range(1, len(ms) + 1)) AS i, regexp_split_to_array(t, '{pattern}') AS ps, ms FROM {kind}_m)")
        each.append(f"{kind}_p AS (SELECT doc_id, v, list_sum(list_transform(ps[:i], lambda x: len(x))) + coalesce(list_sum(list_transform(ms[:i - 1], lambda x: len(x))), 0) AS a FROM {kind}_r)")
        parts.append(f"SELECT doc_id, {n} AS k, '{kind}' AS kind, CAST(a AS BIGINT) AS a, CAST(a + len(v) AS BIGINT) AS b FROM {kind}_p WHERE {test}")
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in kinds)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {", ".join(each)}, s AS ({" UNION ALL ".join(parts)})
SELECT d.doc_id, {counts}, sha256(coalesce(string_agg(concat_ws(':', kind, a, b), ',' ORDER BY k, a), '')) AS base_sha256 FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id"""


def op7_pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op7_pii`` that the base kinds fix, for comparison with SQL."""
    return op7_pii(spark, sf_dir).select("doc_id", *[f"n_{k}" for k in BASE], "base_sha256")


BASE_SQL = _base_sql()
