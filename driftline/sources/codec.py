"""Text forms of points. A point: datasource, field, tags (map), epoch (seconds), server_rx_epoch, value, series_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.resample import resample_dense
from ..operators.timerange import TimeRange

MISSING, TOMBSTONE = -1.0, -3.0
# What real values equal to a marker are stored as.
STORED = {MISSING: -3.14159, TOMBSTONE: -9.42477}


def series_id(datasource: Column, tags: Column, field: Column) -> Column:
    """datasource|k=v|...|field with the tag keys in order; the version tag of a bundle is not part of it."""
    pairs = F.array_sort(F.map_entries(F.map_filter(tags, lambda k, v: k != "_datapoint_version")))
    return F.concat_ws("|", datasource, F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|"), field)


def parse_series_id(sid: Column) -> Column:
    """(datasource, tags, field) of a series id; a tag splits at its first '='."""
    parts = F.split(sid, r"\|")
    middle = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    tags = F.map_from_entries(F.transform(middle, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.regexp_replace(p, "^[^=]*=", "").alias("value"))))
    return F.struct(F.element_at(parts, 1).alias("datasource"), tags.alias("tags"), F.element_at(parts, -1).alias("field"))


def _epoch(seconds: Column, now: int | None) -> Column:
    """Times of zero or less are the time of arrival."""
    return F.when(seconds > 0, seconds).otherwise(F.lit(now).cast("long") if now is not None else F.unix_timestamp())


def influx_tags(head: Column) -> tuple[Column, Column]:
    """Measurement and tag map of ``m,k=v,...``; the measurement is a tag too."""
    measurement = F.substring_index(head, ",", 1)
    rest = F.split(head, ",")
    pairs = F.filter(F.slice(rest, 2, F.greatest(F.size(rest) - 1, F.lit(0))), lambda p: p.contains("="))
    tags = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_replace(p, "^[^=]*=", "").alias("v"))))
    return measurement, F.map_concat(F.create_map(F.lit("measurement"), measurement), tags)


def _number(text: Column) -> Column:
    """A double; integers may end in i. Anything else (strings, booleans) is null."""
    return F.regexp_replace(text, "i$", "").try_cast("double")


def parse_influx(lines: DataFrame, line: str = "line", now: int | None = None) -> DataFrame:
    """``measurement[,k=v...] field=value[,field=value...] time_ns``: one point for each field.

    Lines that have not exactly three parts, and values that are no numbers, give no points (see ``rejected``).
    """
    parts = F.split(F.trim(F.col(line)), " ")
    rows = lines.where(F.size(parts) == 3).select(parts.alias("p"))
    measurement, tags = influx_tags(F.col("p")[0])
    seconds = F.floor(F.col("p")[2].try_cast("long") / F.lit(1_000_000_000)).cast("long")
    rows = rows.select(measurement.alias("datasource"), tags.alias("tags"), F.explode(F.split(F.col("p")[1], ",")).alias("f"), _epoch(seconds, now).alias("epoch"))
    out = rows.select("datasource", F.substring_index("f", "=", 1).alias("field"), "tags", "epoch", _number(F.substring_index("f", "=", -1)).alias("value"))
    return out.where(F.col("value").isNotNull() & F.col("epoch").isNotNull() & (F.col("field") != ""))


def flat_tags(name: Column) -> tuple[Column, Column]:
    """Tags tkn0, tkn1, ..., tkns and the field (the last token) of a dotted name."""
    tokens = F.split(name, r"\.")
    n = F.size(tokens) - 1
    heads = F.transform(F.slice(tokens, 1, n), lambda t, i: F.struct(F.concat(F.lit("tkn"), i.cast("string")).alias("k"), t.alias("v")))
    return F.map_from_entries(F.concat(heads, F.array(F.struct(F.lit("tkns").alias("k"), (n + 1).cast("string").alias("v"))))), F.element_at(tokens, -1)


def parse_graphite(lines: DataFrame, line: str = "line", datasource: str = "flat", now: int | None = None) -> DataFrame:
    """``dotted.name value time_s``: one point a line; other lines give none."""
    parts = F.split(F.trim(F.col(line)), " ")
    rows = lines.where(F.size(parts) == 3).select(parts.alias("p"))
    tags, field = flat_tags(F.col("p")[0])
    out = rows.select(F.lit(datasource).alias("datasource"), field.alias("field"), tags.alias("tags"), _epoch(F.col("p")[2].try_cast("long"), now).alias("epoch"), _number(F.col("p")[1]).alias("value"))
    return out.where(F.col("value").isNotNull() & F.col("epoch").isNotNull())


def parse_auto(lines: DataFrame, line: str = "line", now: int | None = None) -> DataFrame:
    """Lines that begin with ``clusters`` are dotted names, others tagged measurements."""
    flat = F.col(line).startswith("clusters")
    return parse_influx(lines.where(~flat), line, now).unionByName(parse_graphite(lines.where(flat), line, now=now))


def rejected(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines that no parser takes."""
    parts = F.split(F.trim(F.col(line)), " ")
    return lines.where((F.size(parts) != 3) | F.element_at(parts, -1).try_cast("long").isNull())


BUNDLE = "name string, timestamp long, field string, value double, tags array<struct<key:string,value:string>>"


def read_bundle(spark, path: str) -> DataFrame:
    """Newline JSON of a bundle (plain or gzip)."""
    return spark.read.schema(BUNDLE).json(path)


def bundle_points(rows: DataFrame, cluster: str, version: int, allow: str | None = None, deny: str | None = None) -> DataFrame:
    """Flat series of a bundle as points: no tags, a dotted name, field ``value``; deny and allow are regular expressions."""
    keep = (F.size(F.coalesce("tags", F.array().cast("array<struct<key:string,value:string>>"))) == 0) & F.col("name").contains(".") & (F.col("field") == "value")
    rows = rows.where(keep & allowed(F.col("name"), allow, deny))
    tags, field = flat_tags(F.concat(F.lit(f"clusters.{cluster}."), F.col("name")))
    return rows.select(F.lit("flat").alias("datasource"), field.alias("field"), tags.alias("tags"), F.ceil(F.col("timestamp") / 1e9).cast("long").alias("epoch"), "value", F.lit(version).cast("long").alias("version"))


def dense_bundle(rows: DataFrame, cluster: str, version: int, rng: TimeRange, allow: str | None = None, deny: str | None = None) -> DataFrame:
    """A bundle's flat series on the grid of ``rng``: means of the points in each bucket, empty buckets left out."""
    points = bundle_points(rows, cluster, version, allow, deny)
    named = points.select(series_id(F.col("datasource"), F.col("tags"), F.col("field")).alias("series_id"), "epoch", "value")
    return resample_dense(named, rng, ["series_id"]).where(F.col("value").isNotNull()).withColumn("version", F.lit(version).cast("long"))


def bundle_counts(rows: DataFrame) -> DataFrame:
    """n_flat, n_tagged and n_skipped of a bundle."""
    tagged = F.size(F.coalesce("tags", F.array().cast("array<struct<key:string,value:string>>"))) > 0
    good = ~tagged & F.col("name").contains(".") & (F.col("field") == "value")
    return rows.agg(*[F.count_if(c).alias(n) for n, c in (("n_flat", ~tagged), ("n_tagged", tagged), ("n_skipped", ~good))])


def allowed(name: Column, allow: str | None, deny: str | None) -> Column:
    """Not denied, and allowed if there is a list."""
    out = ~name.rlike(deny) if deny else F.lit(True)
    return out & (name.rlike(allow) if allow else F.lit(True))


def whitelisted(points: DataFrame, cluster: str | None = None, node: str | None = None) -> DataFrame:
    """Points of one cluster and node, as tags of that name or as the second and third token of a flat name; None: any."""
    out = points
    for want, names in ((cluster, ("Cluster", "tkn1")), (node, ("Node", "tkn2"))):
        if want is not None:
            out = out.where(F.coalesce(*[F.col("tags")[n] for n in names]) == want)
    return out


def stored_value(value: Column, marker: Column) -> Column:
    """Markers as reserved numbers, and real values that equal one moved out of the way."""
    plain = F.when(value == MISSING, F.lit(STORED[MISSING])).when(value == TOMBSTONE, F.lit(STORED[TOMBSTONE])).otherwise(value)
    return F.when(marker == "missing", F.lit(MISSING)).when(marker == "tombstone", F.lit(TOMBSTONE)).otherwise(plain)


def loaded_value(stored: Column) -> tuple[Column, Column]:
    """(value, marker) of a stored number."""
    marker = F.when(stored == MISSING, F.lit("missing")).when(stored == TOMBSTONE, F.lit("tombstone"))
    value = F.when(stored == STORED[MISSING], F.lit(MISSING)).when(stored == STORED[TOMBSTONE], F.lit(TOMBSTONE)).when(marker.isNull(), stored)
    return value, marker


def point_json(epoch: Column, value: Column, field: Column, tags: Column) -> Column:
    """A point as one flat JSON object: time, value, field and its tags by name."""
    head = F.to_json(F.struct(epoch.alias("time"), value.alias("value"), field.alias("field")))
    more = F.to_json(tags)
    return F.when(F.size(tags) > 0, F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(","), F.substring(more, 2, 1 << 30))).otherwise(head)


# Name parts that tell what kind of metric a name is, in the order of the tests.
KINDS = [("meter", ("_rate",)), ("histogram", (".p50", ".p75", ".p9", ".mean", ".max", ".min", ".total", ".stddev")), ("counter", (".count",))]


def metric_kind(name: Column) -> Column:
    """meter, histogram, counter or gauge, by parts of the dotted name."""
    out = None
    for kind, parts in KINDS:
        hit = name.contains(parts[0])
        for p in parts[1:]:
            hit = hit | name.contains(p)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("gauge")


def histogram_category(name: Column) -> Column:
    """The last token of a histogram's name, such as p99; null for other kinds."""
    return F.when(metric_kind(name) == "histogram", F.substring_index(name, ".", -1))


def component(name: Column) -> Column:
    """The component of a metric: the second and third token of its name, or the whole name if it has no more than two."""
    tokens = F.split(name, r"\.")
    return F.when(F.size(tokens) > 2, F.concat_ws(".", tokens[1], tokens[2])).otherwise(name)


def template_tags(name: Column, template: str) -> Column:
    """Tags of a dotted name by a template such as ``measurement.measurement.host.field*``; a star takes all that follows."""
    words = template.split(".")
    tokens = F.split(name, r"\.")
    out: dict[str, list[Column]] = {}
    for i, w in enumerate(words):
        if not w:
            continue
        part = F.array_join(F.slice(tokens, i + 1, F.greatest(F.size(tokens) - i, F.lit(0))), ".") if w.endswith("*") else F.get(tokens, F.lit(i))
        out.setdefault(w.rstrip("*"), []).append(part)
    return F.create_map(*[x for k, v in out.items() for x in (F.lit(k), F.concat_ws(".", *v))])
