"""Spans to nodes by rules, alignment of spans with samples, call chains."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from seamline.functions.text import action_token, query_action, query_params


#: Bytes of rules that one automaton is made of; more rules make more automata.
RULE_BYTES = 1 << 25


def matches(words: DataFrame, rules: DataFrame, rule_bytes: int = RULE_BYTES) -> DataFrame:
    """field, value, kind, pattern, node: the rules that fit each value (field, value): its beginning (prefix), a part of it (contains), or the longest such part (longest; of equal ones the least). Empty and null patterns fit nothing.

    The patterns of a field are one automaton, which a value passes through once, however many rules there are. Rules are counted before they are sent out: `rule_bytes` at a time.
    """
    kind = rules.schema["node"].dataType.simpleString()
    loose = rules.where("kind in ('prefix', 'contains', 'longest') and pattern <> ''").select("field", "kind", "pattern", "node")
    total = loose.agg(F.sum(F.octet_length("pattern") + F.octet_length(F.col("node").cast("string")) + 64)).first()[0] or 0
    parts, out = max(1, -(-total // rule_bytes)), None

    def through(chosen) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automata = {}
            for field, patterns in chosen.value.items():
                automata[field] = ahocorasick.Automaton()
                for pattern, of in patterns.items():
                    automata[field].add_word(pattern, (pattern, of))
                automata[field].make_automaton()
            for batch in batches:
                found = []
                for field, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    hits, longest = {}, None
                    for end, (pattern, of) in automata[field].iter(value) if field in automata else ():
                        for k, node in of:
                            if k == "longest":
                                longest = min(longest or (0, ""), (-len(pattern), pattern))
                            elif k == "contains" or end + 1 == len(pattern):
                                hits[k, pattern, node] = None
                    found += [(field, value, *h) for h in hits]
                    if longest:
                        found += [(field, value, k, longest[1], node) for k, node in chosen.value[field][longest[1]] if k == "longest"]
                yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], batch.schema.field(0).type if c < 4 else node_type) for c in range(5)], names=["field", "value", "kind", "pattern", "node"])

        return words.select(F.col("field").cast("string"), F.col("value").cast("string")).mapInArrow(run, f"field string, value string, kind string, pattern string, node {kind}")

    node_type = to_arrow_type(rules.schema["node"].dataType)
    for part in range(parts):
        held: dict = {}
        for r in loose.where(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == part).distinct().orderBy("field", "pattern", "kind", "node").collect():
            held.setdefault(r["field"], {}).setdefault(r["pattern"], []).append((r["kind"], r["node"]))
        one = through(words.sparkSession.sparkContext.broadcast(held))  # about rule_bytes
        out = one if out is None else out.unionByName(one)
    if parts == 1:
        return out
    best = F.min(F.when(F.col("kind") == "longest", F.struct((-F.length("pattern")).alias("l"), "pattern"))).over(Window.partitionBy("field", "value"))
    return out.withColumn("best", best["pattern"]).where("kind <> 'longest' or pattern = best").drop("best")


def resolve(values: DataFrame, rules: DataFrame, fold: bool = True, rule_bytes: int = RULE_BYTES) -> DataFrame:
    """id, node: nodes of all rules that fit a span's fields. values: id, field, value. rules: field, kind (exact, prefix, contains, longest), pattern, node.

    Exact rules are an equi-join. The others meet distinct values only; of `longest` rules only the longest pattern of a field counts (then the least). fold: case doesn't count.
    """
    v, r = values.where("value is not null"), rules
    if fold:
        v, r = v.withColumn("value", F.lower("value")), r.withColumn("pattern", F.lower("pattern"))
    exact = v.join(r.where("kind = 'exact'").select("field", F.col("pattern").alias("value"), "node"), ["field", "value"])
    loose = matches(v.select("field", "value").distinct(), r, rule_bytes)
    return exact.select("id", "node").union(v.join(loose.select("field", "value", "node"), ["field", "value"]).select("id", "node")).distinct()


def evidence(spans: DataFrame) -> DataFrame:
    """id, field, value: what a span says about its classes, for resolve(fold=False). spans: id, name, attrs (map), body (of its log record, or null).

    target: route, else path, else URL. page: the path, else target, in lower case. query: the first key of the query, without _ and -, in lower case. action: the query's action, or
    null. hints: name, route and path in lower case, only where there is no action. request: query and path in lower case. name, name_key (lower case), collection, statement (with the body, lower case).
    """
    get = lambda k: F.nullif(F.trim(F.col("attrs")[k]), F.lit(""))
    or_empty = lambda c: F.coalesce(c, F.lit(""))
    bare = lambda c: F.lower(F.translate(c, "_-", ""))
    target = F.coalesce(get("http.route"), get("url.path"), get("url.full"))
    action = F.coalesce(action_token(get("url.query")), F.nullif(query_params(get("url.query"))["action"], F.lit("")))
    fields = {
        "target": target, "page": F.lower(F.coalesce(get("url.path"), target)), "query": bare(query_action(get("url.query"))), "action": bare(action),
        "hints": F.when(action.isNull(), F.lower(F.concat_ws(" ", or_empty(F.col("name")), or_empty(get("http.route")), or_empty(get("url.path"))))),
        "request": F.lower(F.concat(or_empty(get("url.query")), F.lit(" "), or_empty(F.coalesce(get("url.path"), target)))),
        "name": F.col("name"), "name_key": F.lower("name"), "collection": get("db.mongodb.collection"), "statement": F.lower(F.concat(or_empty(get("db.statement")), or_empty(F.col("body")))),
    }
    pairs = F.array(*(F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in fields.items()))
    return spans.select("id", F.explode(pairs).alias("x")).select("id", "x.field", "x.value").where("value is not null and value <> ''")


def span_classes(spans: DataFrame, rules: DataFrame, classes: DataFrame) -> DataFrame:
    """id, node: all classes (n) that a span's evidence points to: the class or service its attributes name, and those of the rules."""
    named = spans.select("id", F.coalesce(F.nullif(F.col("attrs")["code.namespace"], F.lit("")), F.col("attrs")["rpc.service"]).alias("node"))
    return resolve(evidence(spans), rules, fold=False).union(named).join(classes.select(F.col("n").alias("node")), "node", "left_semi").select("id", "node").distinct()


def first_class(found: DataFrame) -> DataFrame:
    """id, node: one class of each span, the least."""
    return found.groupBy("id").agg(F.min("node").alias("node"))


def trace_sets(traces: DataFrame, logs: DataFrame) -> DataFrame:
    """trace_id, node: the classes of a trace by its spans or its log records (trace_id, node), each once."""
    both = traces.select("trace_id", "node").union(logs.select("trace_id", "node"))
    return both.where("trace_id is not null and node is not null").distinct()


def backend_names(spans: DataFrame) -> DataFrame:
    """w, names: what the spans of a window (w, seq, attrs) name at the back: class and method, a class alone, or else scope, route and service; each once, in order."""
    get = lambda k: F.nullif(F.col("attrs")[k], F.lit(""))
    dotted = lambda a, b: F.when(a.isNotNull(), F.concat_ws(".", a, b))
    known = F.coalesce(dotted(get("code.namespace"), get("code.function")), dotted(get("code.class"), get("code.method")))
    rest = F.array_compact(F.array(*(F.concat(F.lit(f"{k}="), get(k)) for k in ("otel.scope.name", "http.route", "service.name"))))
    each = spans.select("w", "seq", F.when(known.isNotNull(), F.array(known)).otherwise(rest).alias("names"))
    whole = each.groupBy("w").agg(F.array_sort(F.collect_list(F.struct("seq", "names"))).alias("x"))
    return whole.select("w", F.array_distinct(F.flatten(F.transform("x", lambda s: s["names"]))).alias("names"))


def longest_rule(values: DataFrame, rules: DataFrame) -> DataFrame:
    """id, node: the node of the longest pattern (then the least) a value contains. values: id, value. rules: pattern, node."""
    words = values.select(F.lit("").alias("field"), "value").where("value is not null").distinct()
    hit = matches(words, rules.select(F.lit("").alias("field"), F.lit("longest").alias("kind"), "pattern", "node")).groupBy("value").agg(F.min("node").alias("node"))
    return values.join(hit, "value").select("id", "node")


def call_chains(spans: DataFrame) -> DataFrame:
    """w, n_spans, services, routes, scopes, code, signature: what each window's spans name, each once, in order of start, end and span_id. spans: w, start, end, span_id, service, route, scope, namespace, function.

    code: namespace.function where both are known; empty names are none. signature: the routes, then the scopes, between bars.
    """
    name = lambda c: F.nullif(F.col(c), F.lit(""))
    code = F.when(name("namespace").isNotNull() & name("function").isNotNull(), F.concat_ws(".", "namespace", "function"))
    rows = F.array_sort(F.collect_list(F.struct("start", "end", "span_id", name("service").alias("service"), name("route").alias("route"), name("scope").alias("scope"), code.alias("code"))))
    x = spans.groupBy("w").agg(F.count("*").alias("n_spans"), rows.alias("r"))
    ordered = lambda c: F.array_distinct(F.array_compact(F.transform("r", lambda s: s[c])))
    out = x.select("w", "n_spans", ordered("service").alias("services"), ordered("route").alias("routes"), ordered("scope").alias("scopes"), ordered("code").alias("code"))
    return out.withColumn("signature", F.array_join(F.concat("routes", "scopes"), "|"))


def alignment(samples: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """samples, aligned, ratio: how many samples have a match."""
    hit = matches.select(key).distinct().withColumn("_m", F.lit(1))
    row = samples.join(hit, key, "left").agg(F.count("*").alias("samples"), F.count("_m").alias("aligned"))
    return row.withColumn("ratio", F.when(F.col("samples") > 0, F.col("aligned") / F.col("samples")).otherwise(F.lit(0.0)))


def best_trace(candidates: DataFrame) -> DataFrame:
    """w, trace_id, spans, hits: of each window's traces that have the route at all, the one with the most spans, then route hits, then the least id; none if no trace has it. candidates: w, trace_id, spans, hits."""
    nth = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("spans"), F.desc("hits"), "trace_id"))
    return candidates.where("hits > 0").withColumn("_k", nth).where("_k = 1").drop("_k")


def _code(k: str):
    return F.nullif(F.col("attrs")[f"code.{k}"], F.lit(""))


def _coded(spans: DataFrame) -> DataFrame:
    sound = spans.where("start_us > 0 and end_us > 0 and end_us >= start_us")
    return sound.withColumn("_any", F.coalesce(*(_code(k) for k in ("namespace", "function", "class", "method"))).isNotNull())


def code_presence(spans: DataFrame) -> DataFrame:
    """One row: spans, and how many name code at all (any, ratio) or a namespace, function, class or method. spans: attrs (map), start_us, end_us; those without sound times don't count."""
    row = _coded(spans).agg(F.count("*").alias("spans"), F.count_if("_any").alias("any"), *(F.count(_code(k)).alias(k) for k in ("namespace", "function", "class", "method")))
    return row.withColumn("ratio", F.when(F.col("spans") > 0, F.col("any") / F.col("spans")).otherwise(F.lit(0.0)))


def code_tops(spans: DataFrame, top: int = 30) -> DataFrame:
    """kind, rank, name, n: where spans name code: the most frequent namespaces, services, scopes and routes of the spans that do, `top` of each, ties by name. Spans without a service, scope or route count as <missing>."""
    get = lambda k: F.coalesce(F.nullif(F.col("attrs")[k], F.lit("")), F.lit("<missing>"))
    kinds = {"code.namespace": _code("namespace"), **{k: get(k) for k in ("service.name", "otel.scope.name", "http.route")}}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("name")) for k, v in kinds.items())))
    counts = _coded(spans).where("_any").select(each.alias("x")).select("x.*").where("name is not null").groupBy("kind", "name").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "name"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= top).select("kind", "rank", "name", "n")
