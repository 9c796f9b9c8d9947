"""Distributed traces and logs as lines of JSON, flattened to one row for each span or record."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seamline.sources.maps import json_texts

#: Composite values come as their JSON text, and are unwrapped by level.
_VALUE = "struct<stringValue:string,intValue:string,boolValue:string,doubleValue:string,arrayValue:string,kvlistValue:string>"
_ATTRS = f"array<struct<key:string,value:{_VALUE}>>"
_SPAN = f"struct<traceId:string,spanId:string,name:string,kind:string,startTimeUnixNano:string,endTimeUnixNano:string,startTimeUnixMicro:string,endTimeUnixMicro:string,startTime:string,endTime:string,attributes:{_ATTRS}>"
_SCOPE = f"array<struct<scope:struct<name:string>,instrumentationLibrary:struct<name:string>,spans:array<{_SPAN}>>>"
_RESOURCE = f"resourceSpans array<struct<resource:struct<attributes:{_ATTRS}>,scopeSpans:{_SCOPE},instrumentationLibrarySpans:{_SCOPE}>>"
#: An envelope, or one span by itself; exporters spell its keys in two ways.
_FLAT = "traceId string, trace_id string, spanId string, span_id string, name string, spanName string, kind string, startTimeUnixNano string, endTimeUnixNano string, start_time_unix_nano string, end_time_unix_nano string"
_FLAT += ", startTimeUnixMicro string, endTimeUnixMicro string, startTime string, endTime string, attributes string"
TRACES = f"{_RESOURCE}, {_FLAT}"
_RECORD = f"struct<traceId:string,spanId:string,severityText:string,body:struct<stringValue:string>,attributes:{_ATTRS}>"
LOGS = f"resourceLogs array<struct<resource:struct<attributes:{_ATTRS}>,scopeLogs:array<struct<scope:struct<name:string>,logRecords:array<{_RECORD}>>>>>"
#: Levels of lists in lists that are unwrapped; what lies deeper stays as it was written.
DEPTH = 3


def _quoted(c: Column) -> Column:
    text = F.to_json(F.array(c))
    return F.substr(text, F.lit(2), F.length(text) - 2)


def _composite(value: Column, depth: int) -> Column:
    """A list or a map of values as JSON text; null for a plain value."""

    def inner(v: Column) -> Column:
        plain = F.when(v["stringValue"].isNotNull(), _quoted(v["stringValue"])).otherwise(F.coalesce(v["intValue"], v["boolValue"], v["doubleValue"]))
        return F.coalesce(plain, _composite(v, depth - 1) if depth > 1 else F.coalesce(v["arrayValue"], v["kvlistValue"]), F.lit("null"))

    listed = F.transform(F.from_json(value["arrayValue"], f"values array<{_VALUE}>")["values"], inner)
    keyed = F.transform(F.from_json(value["kvlistValue"], f"values {_ATTRS}")["values"], lambda e: F.concat(_quoted(e["key"]), F.lit(":"), inner(e["value"])))
    list_text = F.concat(F.lit("["), F.array_join(F.coalesce(listed, F.array().cast("array<string>")), ","), F.lit("]"))
    map_text = F.concat(F.lit("{"), F.array_join(F.coalesce(keyed, F.array().cast("array<string>")), ","), F.lit("}"))
    return F.when(value["arrayValue"].isNotNull(), list_text).when(value["kvlistValue"].isNotNull(), map_text)


def attributes(c: Column) -> Column:
    """An attribute list as a map of strings; of equal keys the last counts. Lists and maps are JSON text."""
    value = lambda a: F.coalesce(a["value"]["stringValue"], a["value"]["intValue"], a["value"]["boolValue"], a["value"]["doubleValue"], _composite(a["value"], DEPTH))
    pairs = F.transform(F.coalesce(c, F.array().cast(_ATTRS)), lambda a: F.struct(a["key"].alias("key"), value(a).alias("value")))
    last = F.filter(pairs, lambda p, i: p["key"].isNotNull() & ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda later: later["key"] == p["key"]))
    return F.map_from_entries(last)


def merged(*maps: Column) -> Column:
    """Maps in one; later ones win."""

    def over(low: Column, high: Column) -> Column:
        return F.map_concat(F.map_filter(low, lambda k, _: ~F.array_contains(F.map_keys(high), k)), high)

    return reduce(over, maps)


def _micros(span: dict[str, Column], side: str) -> Column:
    """A time in microseconds: from nanoseconds, else given as such."""
    whole = lambda *names: F.coalesce(*(span[n].try_cast("long") for n in names if n in span))
    return F.coalesce(F.floor(whole(f"{side}TimeUnixNano", f"{side}_time_unix_nano") / 1000), whole(f"{side}TimeUnixMicro", f"{side}Time"))


def flattened(objects: DataFrame, service: str | None = None) -> DataFrame:
    """The spans of read_spans() from value, the JSON text of envelopes or of single spans."""
    if service:
        objects = objects.where(F.contains("value", F.lit(service)))
    t = objects.select(F.from_json("value", TRACES).alias("t"))
    r = t.select(F.explode("t.resourceSpans").alias("r")).select(attributes(F.col("r.resource.attributes")).alias("ra"), F.explode(F.coalesce("r.scopeSpans", "r.instrumentationLibrarySpans")).alias("s"))
    r = r.select("ra", F.coalesce("s.scope.name", "s.instrumentationLibrary.name").alias("scope"), F.explode("s.spans").alias("s"))
    names = ("startTimeUnixNano", "endTimeUnixNano", "startTimeUnixMicro", "endTimeUnixMicro", "startTime", "endTime")
    times = lambda at, more=(): {n: F.col(f"{at}.{n}") for n in (*names, *more)}
    scope = F.when(F.col("scope").isNotNull(), F.create_map(F.lit("otel.scope.name"), F.col("scope"))).otherwise(F.create_map().cast("map<string,string>"))
    inside = r.select(
        F.col("s.traceId").alias("trace_id"), F.col("s.spanId").alias("span_id"), F.col("s.name").alias("name"), F.col("s.kind").try_cast("int").alias("kind"), _micros(times("s"), "start").alias("start_us"), _micros(times("s"), "end").alias("end_us"),
        F.col("ra")["service.name"].alias("service"), "scope", merged(F.col("ra"), scope, attributes(F.col("s.attributes"))).alias("attrs"),
    )
    flat = t.where("t.resourceSpans is null and (t.startTimeUnixNano is not null or t.endTimeUnixNano is not null or t.traceId is not null)").select("t.*")
    listed = attributes(F.from_json("attributes", _ATTRS))
    own = F.when(F.startswith(F.trim("attributes"), F.lit("[")), listed).otherwise(F.coalesce(F.from_json("attributes", "map<string,string>"), F.create_map().cast("map<string,string>")))
    alone = flat.select(*flat.columns[1:], own.alias("attrs"))
    alone = alone.select(
        F.coalesce("traceId", "trace_id").alias("trace_id"), F.coalesce("spanId", "span_id").alias("span_id"), F.coalesce("name", "spanName").alias("name"), F.col("kind").try_cast("int").alias("kind"),
        *(_micros({n: F.col(n) for n in (*names, "start_time_unix_nano", "end_time_unix_nano")}, side).alias(f"{side}_us") for side in ("start", "end")),
        F.col("attrs")["service.name"].alias("service"), F.col("attrs")["otel.scope.name"].alias("scope"), "attrs",
    )
    out = inside.unionByName(alone).where("start_us > 0 and end_us > 0 and end_us >= start_us")
    return out.where(F.col("service") == service) if service else out


def read_spans(spark: SparkSession, path: str, service: str | None = None) -> DataFrame:
    """trace_id, span_id, name, kind, start_us, end_us, service, scope, attrs (resource, scope and span; the span's win) of envelopes and of single spans.

    Files are arrays, lines or runs of JSON objects. With a service, objects without its name are dropped before they are parsed. Times in nanoseconds or microseconds become
    microseconds; spans without both, or that end before they start, go.
    """
    return flattened(json_texts(spark, path), service)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """trace_id, span_id, severity, body, service, attrs of each log record."""
    r = json_texts(spark, path).select(F.from_json("value", LOGS).alias("t")).select(F.explode("t.resourceLogs").alias("r"))
    r = r.select(attributes(F.col("r.resource.attributes")).alias("ra"), F.explode("r.scopeLogs").alias("s")).select("ra", F.explode("s.logRecords").alias("l"))
    return r.select(F.col("l.traceId").alias("trace_id"), F.col("l.spanId").alias("span_id"), F.col("l.severityText").alias("severity"), F.col("l.body.stringValue").alias("body"), F.col("ra")["service.name"].alias("service"), attributes(F.col("l.attributes")).alias("attrs"))


#: Endings of static files that collectors leave out.
STATIC = r"(?i)\.(css|js|png|jpg|jpeg|gif|ico|svg|woff2?)(\?|$)"


def served(spans: DataFrame) -> DataFrame:
    """Spans of requests that aren't for static files and didn't fail."""
    url = F.coalesce(F.col("attrs")["url.path"], F.col("attrs")["http.route"], F.lit(""))
    status = F.coalesce(F.col("attrs")["http.response.status_code"], F.col("attrs")["http.status_code"]).try_cast("int")
    return spans.where(~url.rlike(STATIC) & (status.isNull() | (status < 400)))


def enveloped(spans: DataFrame) -> DataFrame:
    """service, value: each span as the JSON text of an envelope of its own, which read_spans() takes back. Attributes are strings."""
    attrs = F.transform(F.map_entries("attrs"), lambda e: F.struct(e["key"].alias("key"), F.struct(e["value"].alias("stringValue")).alias("value")))
    nanos = lambda c: (F.col(c) * 1000).cast("string")
    span = F.struct(F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), "name", "kind", nanos("start_us").alias("startTimeUnixNano"), nanos("end_us").alias("endTimeUnixNano"), attrs.alias("attributes"))
    resource = F.struct(F.array(F.struct(F.lit("service.name").alias("key"), F.struct(F.col("service").alias("stringValue")).alias("value"))).alias("attributes"))
    scope = F.struct(F.struct(F.col("scope").alias("name")).alias("scope"), F.array(span).alias("spans"))
    return spans.select("service", F.to_json(F.struct(F.array(F.struct(resource.alias("resource"), F.array(scope).alias("scopeSpans"))).alias("resourceSpans"))).alias("value"))


def write_by_service(spans: DataFrame, path: str, services: tuple[str, ...] = ()) -> None:
    """Spans as lines of JSON envelopes, one folder for each service (of `services`, if any are named)."""
    if services:
        spans = spans.where(F.col("service").isin(*services))
    enveloped(spans).write.mode("append").partitionBy("service").text(path)
