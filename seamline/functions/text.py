"""Column functions on labels, names, signatures, queries and texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def label_key(c: Column) -> Column:
    """A label without case, blanks and punctuation, as mapping tables have it."""
    return F.translate(F.lower(F.trim(c)), " _-/\\:.,()[]{}", "")


def gate_label_key(c: Column, parentheses: bool = False) -> Column:
    """The milder form: without case, blanks, underscores and hyphens (and parentheses)."""
    return F.translate(F.lower(F.trim(c)), " _-()" if parentheses else " _-", "")


def class_key(c: Column) -> Column:
    """A class name without the file ending; whole numbers in their shortest form."""
    name = F.regexp_replace(F.trim(c), r"\.java$", "")
    return F.when(name.rlike(r"^-?[0-9]{1,18}$"), name.try_cast("long").cast("string")).otherwise(name)


def owner(method: Column) -> Column:
    """What stands before the last dot."""
    return F.regexp_replace(method, r"\.[^.]*$", "")


def simple_name(c: Column) -> Column:
    return F.substring_index(c, ".", -1)


def package(c: Column) -> Column:
    return F.when(c.contains("."), F.regexp_replace(c, r"\.[^.]*$", "")).otherwise(F.lit(""))


def leaf_package(c: Column) -> Column:
    return F.substring_index(package(c), ".", -1)


def library_prefix(c: Column) -> Column:
    """The first two dotted parts."""
    return F.substring_index(c, ".", 2)


def signature_class(c: Column, base: str) -> Column:
    """The class of a method signature: no arguments, no return type, no part after the class that starts in lower case."""
    name = F.substring_index(F.substring_index(c, "(", 1), " ", -1)
    name = F.regexp_replace(name, r"(\.[a-z_$][A-Za-z0-9_$]*)+$", "")
    return F.when(name.startswith(base), name)


def plain_name(c: Column) -> Column:
    """A qualified name without type arguments, array brackets and white space."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"<[^<>]*>", ""), r"\[\]", ""), r"\s+", "")


#: Where a name is parted by a blank, in this order; and what a blank takes the place of.
BOUNDARIES = (r"([a-z0-9])([A-Z])", r"([A-Z]+)([A-Z][a-z])")
FILLERS = r"[_\-\d]+"
#: Fixed value: the parts of a name that keeps its numbers. Capitals count only before a word that starts with one.
PARTS = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[0-9]+"


def camel_text(c: Column) -> Column:
    """A camel-case name parted by blanks, which also take the place of digits, underscores and hyphens."""
    for edge in BOUNDARIES:
        c = F.regexp_replace(c, edge, "$1 $2")
    return F.regexp_replace(c, FILLERS, " ")


def camel_words(c: Column) -> Column:
    """Words of a camel-case name, in lower case, without its digits."""
    return F.filter(F.split(F.lower(camel_text(c)), r"\s+"), lambda w: w != "")


def camel_parts(c: Column) -> Column:
    """Words and numbers of a camel-case name, in lower case."""
    return F.transform(F.regexp_extract_all(c, F.lit(PARTS), F.lit(0)), lambda w: F.lower(w))


def ascii_words(c: Column) -> Column:
    """Runs of the letters a-z, in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))


def query_action(query: Column) -> Column:
    """The first key of a query string, or of a JSON object."""
    first = F.regexp_extract(query, r"^\s*\{\s*\"([^\"]*)\"", 1)
    return F.when(query.rlike(r"^\s*\{"), F.nullif(first, F.lit(""))).otherwise(F.nullif(F.substring_index(F.substring_index(query, "&", 1), "=", 1), F.lit("")))


def query_params(query: Column) -> Column:
    """A query string as a map: lower-case keys, the last value of a key, bare keys with an empty value."""
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    entry = lambda p: F.struct(F.lower(F.substring_index(p, "=", 1)).alias("key"), F.when(F.instr(p, "=") > 0, F.substr(p, F.instr(p, "=") + 1)).otherwise(F.lit("")).alias("value"))
    entries = F.transform(pairs, entry)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def action_token(query: Column) -> Column:
    """The value of `action=x`, or what follows `action` at once."""
    return F.nullif(F.regexp_extract(query, r"(?i)(?:^|[?&])action=?([^&#]*)", 1), F.lit(""))


def trace_id(traceparent: Column) -> Column:
    """The trace id of a W3C traceparent; null unless that has four parts and the id 32 characters."""
    parts = F.split(traceparent, "-")
    return F.when((F.size(parts) >= 4) & (F.length(F.trim(parts[1])) == 32), F.trim(parts[1]))


def _first(record: Column, *paths: str) -> Column:
    """The first of a JSON record's values at the paths that isn't empty."""
    return F.coalesce(*(F.nullif(F.get_json_object(record, p), F.lit("")) for p in paths))


#: Where log records keep their trace and their logger.
TRACE_KEYS = ("traceId", "trace_id", "trace_id_hex", "traceid")
LOGGER_KEYS = ("loggerName", "logger", "logger.name", "source", "class", "className")


def record_trace_id(record: Column) -> Column:
    """The trace of a log record (JSON): its own key, one among its attributes, or that of a traceparent in either place."""
    own = _first(record, *(f"$.{k}" for k in (*TRACE_KEYS, "traceID")))
    inner = _first(record, *(f"$.attributes.{k}" for k in TRACE_KEYS))
    return F.coalesce(own, inner, *(trace_id(F.get_json_object(record, p)) for p in ("$.attributes.traceparent", "$.traceparent")))


def logger_hint(record: Column) -> Column:
    """What a log record (JSON) says about its class: the logger's name, else that there is a message at all."""
    named = _first(record, *(f"$['{k}']" for k in LOGGER_KEYS), *(f"$.attributes['{k}']" for k in LOGGER_KEYS))
    body = _first(record, "$.body.stringValue", "$.body.text", "$.body.message")
    said = F.coalesce(F.length(F.trim(F.get_json_object(record, "$.message"))) > 0, F.lit(False))
    return F.coalesce(named, F.when(body.isNotNull() | said, F.lit("<message-present>")))


def request_key(label: Column, url: Column, posted: tuple[str, ...], pages: dict[str, str], paths: tuple[tuple[str, str], ...]) -> Column:
    """method, path, action of a load-test request, as its span has them.

    Labels in `posted` are POST, others GET. A label in `pages` has its own path and is its own action; of others the action is the query's first key, else the label,
    and the path that of the first pair in `paths` whose part the URL contains (an empty part fits all).
    """
    path = F.lit(None).cast("string")
    for part, p in reversed(paths):
        path = F.when(F.contains(url, F.lit(part)), F.lit(p)).otherwise(path)
    page = F.lit(None).cast("string")
    for name, p in pages.items():
        page = F.when(label == name, F.lit(p)).otherwise(page)
    query = F.when(F.contains(url, F.lit("?")), F.substring_index(F.regexp_replace(url, r"^[^?]*\?", ""), "#", 1))
    action = F.when(page.isNotNull(), label).otherwise(F.coalesce(query_action(query), label))
    return F.struct(F.when(label.isin(*posted), "POST").otherwise("GET").alias("method"), F.coalesce(page, path).alias("path"), action.alias("action"))


def rho_name(c: Column) -> Column:
    """0.1 as 0p10."""
    return F.replace(F.format_string("%.2f", c), F.lit("."), F.lit("p"))
