"""Registered queries on evidence: spans and logs to classes, gates, structural fusion, grids over damping and resolutions, the runner of all settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamline.functions import math, text
from seamline.operators import cluster, diagnose, edl, filters, fusion, metrics, normalize, pairs, ranges, report, sampling, sessions, spans, structure, terms
from seamline.plans.queries import (
    BRANDS, CAMEL, CONT, F1, IDF, MODALITIES, SEM, STOP, STRUCT, TEMP, TRUTH, brand_pred, brand_truth, camel_name, certainty, full, kept, n_brands, nation_deps, query, rounded, sem, struct, table, temp, trimodal, uncertainty, vec_pred, vec_truth,
)

# Spans and logs. A page is a span: its URL has route, path and query, and some have a collection, a namespace or a log record.

PATH, QUERY = r"^https?://[^/?#]+([^?#]*)", r"\?([^#]*)"
PAGE_SPANS = rf"""p AS (SELECT page_id AS id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '{PATH}', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) || CASE WHEN page_id % 5 = 0 THEN '&action=buy_Now' ELSE '' END AS q,
CASE WHEN page_id % 11 = 0 THEN 'customer' ELSE '' END AS coll, CASE WHEN page_id % 13 = 0 THEN 'org.Page' WHEN page_id % 17 = 0 THEN 'org.Unknown' END AS ns, CASE WHEN page_id % 6 = 0 THEN 'select Flight' END AS body, contains(url, '?') AS served FROM pages),
s AS (SELECT *, 'GET ' || path AS name, CASE WHEN path <> '' THEN path END AS target FROM p)"""


def page_spans(spark, d):
    q = F.concat(F.regexp_extract("url", QUERY, 1), F.when(F.col("page_id") % 5 == 0, "&action=buy_Now").otherwise(""))
    path = F.regexp_extract("url", PATH, 1)
    n = F.col("page_id")
    attrs = F.create_map(
        F.lit("url.path"), path, F.lit("url.query"), q, F.lit("db.mongodb.collection"), F.when(n % 11 == 0, "customer").otherwise(""), F.lit("code.namespace"), F.when(n % 13 == 0, "org.Page").when(n % 17 == 0, "org.Unknown"),
        F.lit("code.function"), F.when(n % 26 == 0, "run"), F.lit("service.name"), F.regexp_extract("url", r"^https?://([^/?#]+)", 1), F.lit("thread.id"), n.cast("string"),
    )
    return table(spark, d, "pages").select(n.alias("id"), F.concat(F.lit("GET "), path).alias("name"), attrs.alias("attrs"), F.when(n % 6 == 0, "select Flight").alias("body"), F.when(F.contains("url", F.lit("?")), 2).otherwise(3).alias("kind"))


RULES = [
    ("target", "longest", "/", "org.Root"), ("target", "longest", "/1", "org.One"), ("target", "longest", "/12", "org.Twelve"), ("page", "contains", "/2", "org.Two"), ("query", "exact", "page", "org.Paged"), ("query", "exact", "id", "org.Item"),
    ("action", "exact", "buynow", "org.Buy"), ("hints", "contains", "/3", "org.Three"), ("request", "contains", "=1", "org.Numbered"), ("name", "contains", "GET /a", "org.Alpha"), ("name_key", "contains", "get /b", "org.Beta"),
    ("collection", "exact", "customer", "org.Customer"), ("statement", "contains", "flight", "org.Flight"), ("statement", "contains", "select", "org.Absent"),
]
CLASSES = sorted({r[3] for r in RULES} - {"org.Absent"} | {"org.Page"})
CLASS_ROWS = ", ".join(f"('{c}')" for c in CLASSES)
RESOLVED = rf"""{PAGE_SPANS}, a AS (SELECT *, nullif(lower(replace(replace(CASE WHEN len(list_filter(string_split(q, '&'), lambda t: starts_with(lower(t), 'action'))) > 0 THEN regexp_replace(list_filter(string_split(q, '&'), lambda t: starts_with(lower(t), 'action'))[1], '(?i)^action=?', '') END, '_', ''), '-', '')), '') AS act,
lower(replace(replace(split_part(split_part(q, '&', 1), '=', 1), '_', ''), '-', '')) AS q1 FROM s),
f AS (SELECT id, CASE WHEN contains(target, '/12') THEN 'org.Twelve' WHEN contains(target, '/1') THEN 'org.One' WHEN contains(target, '/') THEN 'org.Root' END AS node FROM a
UNION ALL SELECT id, 'org.Two' FROM a WHERE contains(lower(target), '/2') UNION ALL SELECT id, 'org.Paged' FROM a WHERE q1 = 'page' UNION ALL SELECT id, 'org.Item' FROM a WHERE q1 = 'id' UNION ALL SELECT id, 'org.Buy' FROM a WHERE act = 'buynow'
UNION ALL SELECT id, 'org.Three' FROM a WHERE act IS NULL AND contains(lower(name || '  ' || path), '/3') UNION ALL SELECT id, 'org.Numbered' FROM a WHERE contains(lower(q || ' ' || coalesce(target, '')), '=1') UNION ALL SELECT id, 'org.Alpha' FROM a WHERE contains(name, 'GET /a')
UNION ALL SELECT id, 'org.Beta' FROM a WHERE contains(lower(name), 'get /b') UNION ALL SELECT id, 'org.Customer' FROM a WHERE coll = 'customer' UNION ALL SELECT id, 'org.Flight' FROM a WHERE body IS NOT NULL UNION ALL SELECT id, ns FROM a),
found AS (SELECT DISTINCT id, node FROM f WHERE node IN (SELECT c FROM (VALUES {CLASS_ROWS}) t(c)))"""


def page_classes(spark, d):
    rules = spark.createDataFrame(RULES, "field string, kind string, pattern string, node string")
    return spans.span_classes(page_spans(spark, d), rules, spark.createDataFrame([(c,) for c in CLASSES], "n string"))


@query(f"WITH {RESOLVED} SELECT id, node FROM found")
def span_classes(spark, d):
    return page_classes(spark, d)


@query(f"WITH {RESOLVED} SELECT id, min(node) AS node FROM found GROUP BY id")
def span_class(spark, d):
    return spans.first_class(page_classes(spark, d))


@query(f"WITH {RESOLVED} SELECT DISTINCT trace_id, node FROM (SELECT id % 50 AS trace_id, node FROM found UNION ALL SELECT user_id % 60, 'org.' || event_type FROM events)")
def trace_sets(spark, d):
    logs = table(spark, d, "events").select((F.col("user_id") % 60).alias("trace_id"), F.concat(F.lit("org."), "event_type").alias("node"))
    return spans.trace_sets(page_classes(spark, d).select((F.col("id") % 50).alias("trace_id"), "node"), logs)


@query(f"""WITH {PAGE_SPANS}, n AS (SELECT id % 40 AS w, id, CASE WHEN ns IS NOT NULL AND id % 26 = 0 THEN ns || '.run' WHEN ns IS NOT NULL THEN ns WHEN host <> '' THEN 'service.name=' || host END AS name FROM s),
f AS (SELECT w, name, min(id) AS first FROM n WHERE name IS NOT NULL GROUP BY ALL) SELECT w, list(name ORDER BY first) AS names FROM f GROUP BY w""")
def backend_names(spark, d):
    return spans.backend_names(page_spans(spark, d).select((F.col("id") % 40).alias("w"), F.col("id").alias("seq"), "attrs")).where(F.size("names") > 0)


@query(f"WITH {PAGE_SPANS}, k AS (SELECT id, unnest(['url.path', 'url.query', 'db.mongodb.collection', 'code.namespace', 'code.function']) AS key, unnest([path, q, coll, ns, CASE WHEN id % 26 = 0 THEN 'run' END]) AS value FROM s WHERE served) SELECT * FROM k WHERE key <> 'url.query'")
def telling_attributes(spark, d):
    served = filters.without_attributes(filters.server_spans(page_spans(spark, d)), ("url.query",))
    return served.select("id", F.explode(filters.telling(F.col("attrs"))).alias("key", "value"))


RECORDS = """r AS (SELECT event_id AS id, CASE event_id % 8 WHEN 0 THEN '{"traceId": "t' || event_id || '", "logger.name": "a.B"}' WHEN 1 THEN '{"traceId": "", "attributes": {"trace_id": "a' || event_id || '", "class": "C"}}'
WHEN 2 THEN '{"attributes": {"traceparent": "00-' || lpad(CAST(event_id AS VARCHAR), 32, '0') || '-b-01"}, "body": {"stringValue": "x"}}' WHEN 3 THEN '{"traceparent": "00-12-b-01", "message": " "}' WHEN 4 THEN '{"traceparent": "00-' || lpad(CAST(event_id AS VARCHAR), 32, 'f') || '-b-01", "message": "m"}'
WHEN 5 THEN '{"traceID": "u", "loggerName": "", "logger": "L"}' WHEN 6 THEN '{"body": {"text": ""}}' ELSE '{"attributes": {"className": "K"}, "className": "J"}' END AS j FROM events)"""


def records(spark, d):
    e = F.col("event_id").cast("string")
    made = [
        F.concat(F.lit('{"traceId": "t'), e, F.lit('", "logger.name": "a.B"}')), F.concat(F.lit('{"traceId": "", "attributes": {"trace_id": "a'), e, F.lit('", "class": "C"}}')),
        F.concat(F.lit('{"attributes": {"traceparent": "00-'), F.lpad(e, 32, "0"), F.lit('-b-01"}, "body": {"stringValue": "x"}}')), F.lit('{"traceparent": "00-12-b-01", "message": " "}'),
        F.concat(F.lit('{"traceparent": "00-'), F.lpad(e, 32, "f"), F.lit('-b-01", "message": "m"}')), F.lit('{"traceID": "u", "loggerName": "", "logger": "L"}'), F.lit('{"body": {"text": ""}}'), F.lit('{"attributes": {"className": "K"}, "className": "J"}'),
    ]
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.element_at(F.array(*made), (F.col("event_id") % 8 + 1).cast("int")).alias("record"))


@query(rf"""WITH {RECORDS}, x AS (SELECT id, nullif(j->>'$.traceId', '') AS a, nullif(j->>'$.traceID', '') AS b, nullif(j->>'$.attributes.trace_id', '') AS c, coalesce(j->>'$.attributes.traceparent', j->>'$.traceparent') AS tp,
coalesce(nullif(j->>'$.logger', ''), nullif(json_extract_string(j, '/logger.name'), ''), nullif(j->>'$.className', ''), nullif(j->>'$.attributes.class', ''), nullif(j->>'$.attributes.className', '')) AS l, coalesce(nullif(j->>'$.body.stringValue', ''), nullif(j->>'$.body.text', ''), nullif(trim(j->>'$.message'), '')) AS m FROM r)
SELECT id, coalesce(a, b, c, CASE WHEN length(split_part(tp, '-', 2)) = 32 THEN split_part(tp, '-', 2) END) AS trace_id, coalesce(l, CASE WHEN m IS NOT NULL THEN '<message-present>' END) AS logger FROM x""")
def log_record_keys(spark, d):
    return records(spark, d).select("id", text.record_trace_id(F.col("record")).alias("trace_id"), text.logger_hint(F.col("record")).alias("logger"))


@query(rf"""WITH x AS (SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN 'home' WHEN 1 THEN 'search' WHEN 2 THEN 'view' ELSE 'other' END AS label, nullif(split_part(split_part(regexp_extract(url, '\?([^#]*)', 1), '&', 1), '=', 1), '') AS q FROM pages)
SELECT page_id, CASE WHEN label = 'search' THEN 'POST' ELSE 'GET' END AS method, CASE WHEN label = 'home' THEN '/shop/' WHEN contains(url, '/1') THEN '/shop/one' ELSE '/shop/all' END AS path, CASE WHEN label = 'home' THEN 'home' ELSE coalesce(q, label) END AS action FROM x""")
def request_keys(spark, d):
    label = F.when(F.col("page_id") % 4 == 0, "home").when(F.col("page_id") % 4 == 1, "search").when(F.col("page_id") % 4 == 2, "view").otherwise("other")
    key = text.request_key(label, F.col("url"), ("search",), {"home": "/shop/"}, (("/1", "/shop/one"), ("", "/shop/all")))
    return table(spark, d, "pages").select("page_id", key.alias("k")).select("page_id", "k.method", "k.path", "k.action")


@query(r"SELECT event_type AS label, count(*) AS n FROM events WHERE NOT regexp_matches(event_type, 'err|sign') AND contains(event_type, 'c') AND CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0 GROUP BY ALL")
def labelled_requests(spark, d):
    odd = F.get_json_object("props", "$.k").cast("int") % 2
    rows = table(spark, d, "events").select(F.col("event_type").alias("label"), F.when(odd == 0, "TRUE").otherwise("false").alias("success"))
    return filters.labelled(rows, drop="err|sign", part="c", only_success=True).groupBy("label").agg(F.count("*").alias("n"))


@query("""WITH r(k, nodes) AS (VALUES ('VIEW', ['Catalog', 'Page']), ('pur_chase', ['Order']), ('Error', ['Log'])) SELECT event_id, unnest(nodes) AS node FROM events JOIN r ON lower(event_type) = translate(lower(k), ' _-', '')""")
def gate_mapping(spark, d):
    rules = spark.createDataFrame([("VIEW", ["Catalog", "Page"]), ("pur_chase", ["Order"]), ("Error", ["Log"])], "key string, nodes array<string>")
    return filters.gated(table(spark, d, "events").select("event_id", F.col("event_type").alias("label")), rules, text.gate_label_key).select("event_id", "node")


# Texts and rows.


@query(rf"WITH {CAMEL} SELECT id, list_transform(regexp_extract_all(regexp_replace(s, '([A-Z]+)([A-Z][a-z])', '\1|\2', 'g'), '[A-Z]+\||[A-Z]?[a-z]+|[0-9]+'), lambda w: lower(replace(w, '|', ''))) AS words FROM x")
def camel_parts(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.camel_parts(camel_name()).alias("words"))


@query(f"""WITH {IDF}, toks AS (SELECT doc_id AS d, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents), pos AS (SELECT d, unnest(w) AS word, unnest(generate_series(1, len(w))) AS k FROM toks),
body AS (SELECT d, string_agg(word, ' ' ORDER BY k) AS b FROM pos WHERE word IN (SELECT word FROM idf WHERE idf >= 1.35) GROUP BY d)
SELECT doc_id AS d, trim(source || ' ' || source || ' ' || source || ' ' || lang || ' ' || lang || ' ' || coalesce(b, '')) AS distilled FROM documents LEFT JOIN body ON d = doc_id""")
def distilled_methods(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("d"), "text", "source", "lang")
    return terms.distilled(docs, F.col("source"), methods=F.col("lang"))


@query("SELECT p_partkey, p_brand, p_type, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type, p_size ORDER BY p_partkey) AS k FROM part) WHERE k = 1")
def composite_dedup(spark, d):
    return structure.dedup_first(table(spark, d, "part"), ["p_brand", "p_type", "p_size"], ["p_partkey"]).select("p_partkey", "p_brand", "p_type", "p_size")


@query("WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(4 * CAST(x AS DOUBLE))) AS e FROM embeddings) SELECT min(vec_id) AS vec_id FROM v GROUP BY e")
def vectors_dedup_first(spark, d):
    """Of vectors that are equal in steps of a quarter."""
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(4 * x.cast("double"))).alias("e"))
    return structure.dedup_first(v, ["e"], ["vec_id"]).select("vec_id")


@query("""WITH v AS (SELECT vec_id AS n, label AS pkg, CASE WHEN label > 1 AND embedding[1] > 0 OR label = 1 THEN CAST(embedding AS DOUBLE[]) END AS e FROM embeddings), x AS (SELECT n, pkg, unnest(e) AS x, unnest(generate_series(1, len(e))) AS k FROM v WHERE e IS NOT NULL),
p AS (SELECT pkg, k, avg(x) AS m FROM x GROUP BY ALL), g AS (SELECT k, avg(x) AS m FROM x GROUP BY k), pe AS (SELECT pkg, list(m ORDER BY k) AS e FROM p GROUP BY pkg), ge AS (SELECT list(m ORDER BY k) AS e FROM g)
SELECT n, list_transform(coalesce(v.e, pe.e, ge.e), lambda y: round(y, 6) + 0.0) AS e, CASE WHEN v.e IS NOT NULL THEN 'own' WHEN pe.e IS NOT NULL THEN 'package' ELSE 'all' END AS origin FROM v LEFT JOIN pe USING (pkg), ge""")
def vector_fill(spark, d):
    t = table(spark, d, "embeddings")
    known = t.where("(label > 1 and embedding[0] > 0) or label = 1").select(F.col("vec_id").alias("n"), F.col("embedding").cast("array<double>").alias("e"))
    out = structure.vector_fill(t.select(F.col("vec_id").alias("n"), F.col("label").alias("pkg")), known)
    return out.select("n", F.transform("e", lambda x: F.round(x, 6) + F.lit(0.0)).alias("e"), "origin")


@query(f"WITH {STRUCT}, t AS (SELECT i, j FROM struct ORDER BY round(v, 9) DESC, i, j LIMIT 60), e AS (SELECT unnest([lower(i), lower(j)]) AS n FROM t), k(keyword) AS (VALUES ('brand#1'), ('#25'), ('none'), ('3')) SELECT keyword, count(*) AS n FROM e JOIN k ON contains(n, keyword) GROUP BY ALL")
def pair_keywords(spark, d):
    top = struct(spark, d).orderBy(F.desc(F.round("v", 9)), "i", "j").limit(60)
    return diagnose.keyword_counts(top, ["Brand#1", "#25", "none", "3"])


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), x AS (SELECT vec_id, unnest(e) AS x, unnest(generate_series(1, len(e))) AS k FROM v), s AS (SELECT k, avg(x) AS m, stddev_pop(x) AS s FROM x GROUP BY k)
SELECT vec_id, list(round((x - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 5) + 0.0 ORDER BY k) AS x FROM x JOIN s USING (k) GROUP BY vec_id""")
def standardised_vectors(spark, d):
    t = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return edl.standardised(t).select("vec_id", F.transform("x", lambda v: F.round(v, 5) + F.lit(0.0)).alias("x"))


@query()
def capped_sample(spark, d):
    return sampling.capped(struct(spark, d), 50, "i", "j")


# Figures and gates.


@query(f"WITH {TRUTH}, k AS (SELECT count(DISTINCT pred.c) AS k, count(DISTINCT truth.c) AS gt_k FROM pred JOIN truth USING (n)) SELECT k, gt_k, k - gt_k AS k_diff, abs(k - gt_k) AS k_gap, k <= 2 AND gt_k >= 4 AS collapsed FROM k")
def k_differences(spark, d):
    return metrics.k_report(brand_pred(spark, d), brand_truth(spark, d))


@query(f"""WITH {STRUCT}, {TRUTH}, sz AS (SELECT c, count(*) AS n FROM truth GROUP BY c), x AS (SELECT least(a.c, b.c) AS a, greatest(a.c, b.c) AS b, v FROM struct JOIN truth a ON a.n = i JOIN truth b ON b.n = j), s AS (SELECT a, b, sum(v) AS s FROM x GROUP BY ALL),
allp AS (SELECT x.c AS a, y.c AS b, x.n AS na, y.n AS nb FROM sz x JOIN sz y ON x.c <= y.c), m AS (SELECT p.a, p.b, coalesce(s, 0) / CASE WHEN p.a = p.b THEN na * (na - 1) / 2 ELSE na * nb END AS m FROM allp p LEFT JOIN s ON s.a = p.a AND s.b = p.b WHERE p.a <> p.b OR na > 1),
st AS (SELECT i, j FROM struct WHERE v >= 0.12)
SELECT (SELECT count(*) FROM sz) AS k, round((SELECT avg(m) FROM m WHERE a = b), 6) AS intra, round((SELECT avg(m) FROM m WHERE a <> b), 6) AS inter, (SELECT count(*) FROM st) AS edges, round(2 * (SELECT count(*) FROM st) / ((SELECT count(*) FROM brands) * ((SELECT count(*) FROM brands) - 1)), 6) AS density,
(SELECT count(*) FROM brands WHERE n NOT IN (SELECT i FROM st UNION SELECT j FROM st)) AS isolated""")
def partition_stats(spark, d):
    return rounded(diagnose.partition_stats(kept(spark, struct(spark, d), "struct"), brand_truth(spark, d), 0.12))


@query("""WITH m AS (SELECT p_brand AS system, CAST(count(*) FILTER (WHERE p_size < 10) AS DOUBLE) AS b, CASE WHEN count(*) % 5 > 0 THEN CAST(count(*) FILTER (WHERE p_size > 35) AS DOUBLE) END AS n, count(DISTINCT p_type) AS k FROM part GROUP BY ALL), x AS (SELECT *, least(b, coalesce(n, b)) AS lo, greatest(b, coalesce(n, b)) AS hi FROM m)
SELECT system, round(greatest(0, 1 - abs(k - 5.0) / 3), 6) AS closeness, round(CASE WHEN hi <= lo THEN 0.5 ELSE (b - lo) / (hi - lo) END, 6) AS base_score, round(CASE WHEN hi <= lo THEN 0.5 ELSE coalesce((n - lo) / (hi - lo), 0) END, 6) AS new_score,
round(CASE WHEN n IS NULL THEN 0 ELSE (least(2, greatest(-2, (n - b) / (abs(b) + 1e-9))) + 2) / 4 END, 6) AS gain FROM x""")
def radar_pairs(spark, d):
    size = lambda c: F.count_if(c).cast("double")
    m = table(spark, d, "part").groupBy(F.col("p_brand").alias("system")).agg(size(F.col("p_size") < 10).alias("b"), F.when(F.count("*") % 5 > 0, size(F.col("p_size") > 35)).alias("n"), F.count_distinct("p_type").alias("k"))
    both = math.pair_scores(F.col("b"), F.col("n"))
    return rounded(m.select("system", math.service_closeness(F.col("k"), 2, 8).alias("closeness"), both["base"].alias("base_score"), both["new"].alias("new_score"), math.relative_gain(F.col("b"), F.col("n")).alias("gain")))


def jtl_rows(spark, d):
    """Events as load-test rows: users are threads; some iterations are unknown, and errors name no thread."""
    e, k = table(spark, d, "events"), F.get_json_object("props", "$.k").cast("int")
    thread = F.when(F.col("event_type") == "error", " ").otherwise(F.concat(F.lit("T "), F.col("user_id").cast("string")))
    return e.select(thread.alias("threadName"), F.when(k % 3 == 0, (k % 2).cast("string")).alias("threadIteration"), F.when(F.col("user_id") % 2 == 0, "7").alias("grpThreads"), F.col("event_id").alias("seq"), F.col("event_type").alias("n"))


GATE_SESSIONS = """je AS (SELECT user_id, event_id, event_type AS n, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type <> 'error'), jg AS (SELECT *, CASE WHEN k % 3 = 0 THEN k % 2 WHEN user_id % 2 = 0 THEN 7 END AS it FROM je),
js AS (SELECT 'T ' || user_id || CASE WHEN it IS NULL THEN '' ELSE '::it=' || it END AS g, event_id AS seq, n FROM jg), jk AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY seq) AS k, count(*) OVER (PARTITION BY g) AS c FROM js), jsess AS (SELECT g, seq, n FROM jk WHERE c >= 2 AND k <= 20)"""


@query(f"WITH {GATE_SESSIONS} SELECT g, seq, n FROM jsess")
def gate_sessions(spark, d):
    return sessions.gate_sessions(jtl_rows(spark, d), cap=20, least=2)


def brand_ids(spark, d):
    """Brands as the numbers in their names, for components."""
    return F.regexp_extract("n", "[0-9]+", 0).cast("long")


LINES = "so AS (SELECT no // 10 AS g, no AS n FROM part JOIN brands ON brands.n = p_brand)"


def gate_stats(spark, d):
    s, n = kept(spark, struct(spark, d), "struct"), n_brands(spark, d)
    hits = sessions.gate_sessions(jtl_rows(spark, d), least=2).select("g", "n").distinct().groupBy("g").agg(F.count("*").cast("double").alias("v"))
    q = ranges.quantiles(hits, [0.5, 0.9]).select(F.col("q")[0].alias("p50"), F.col("q")[1].alias("p90"))
    edges = diagnose.density(s, n).select(F.col("edges").alias("offdiag"), "density")
    ratio = normalize.intra_inter(s, brand_truth(spark, d).withColumnRenamed("cluster", "label")).select("intra", "inter", "ratio")
    return edges.join(F.broadcast(ratio)).join(F.broadcast(q)).withColumn("n", F.lit(n))  # one row each


GATE = f"""{STRUCT}, {TRUTH}, {GATE_SESSIONS}, gh AS (SELECT count(DISTINCT n) AS h FROM jsess_all GROUP BY g)"""
GATE = GATE.replace("gh AS", "jsess_all AS (SELECT g, n FROM jk WHERE c >= 2), gh AS")
GATE_ROW = f"""{GATE}, gr AS (SELECT avg(v) FILTER (WHERE a.c = b.c) AS intra, avg(v) FILTER (WHERE a.c <> b.c) AS inter FROM struct JOIN truth a ON a.n = i JOIN truth b ON b.n = j), ge AS (SELECT 2 * count(*) AS offdiag FROM struct WHERE v > 0), gn AS (SELECT count(*) AS n FROM brands),
gq AS (SELECT quantile_cont(CAST(h AS DOUBLE), 0.5) AS p50, quantile_cont(CAST(h AS DOUBLE), 0.9) AS p90 FROM gh), g AS (SELECT n, offdiag, offdiag / (n * (n - 1)) AS density, intra, inter, intra / inter AS ratio, p50, p90 FROM gr, ge, gn, gq)"""


@query(f"""WITH {GATE_ROW}, w AS (SELECT *, concat_ws(',', CASE WHEN offdiag < greatest(50, CAST(floor(0.08 * n * (n - 1)) AS BIGINT)) THEN 'offdiag' END, CASE WHEN density < 0.001 THEN 'density' END, CASE WHEN ratio < 1 THEN 'ratio' END, CASE WHEN p50 < 3 THEN 'session_p50' END, CASE WHEN p90 < 4 THEN 'session_p90' END) AS reasons FROM g)
SELECT n, offdiag, round(density, 6) AS density, round(intra, 6) AS intra, round(inter, 6) AS inter, round(ratio, 6) AS ratio, round(p50, 6) AS p50, round(p90, 6) AS p90, reasons, CASE WHEN reasons = '' THEN 'PASS' ELSE 'FAIL' END AS status FROM w""")
def temporal_gate(spark, d):
    stats = gate_stats(spark, d)
    return rounded(report.temporal_gate(stats, report.least_cells("plants", n_brands(spark, d))))


@query(f"WITH {GATE_ROW} SELECT 'shop' AS system, n, offdiag, round(density, 6) AS density, round(intra, 6) AS intra, round(inter, 6) AS inter, round(ratio, 6) AS ratio FROM g")
def master_table(spark, d):
    """Under limits that the tables meet; a system that fails is refused."""
    stats = kept(spark, gate_stats(spark, d).withColumn("system", F.lit("shop")), "gate")
    gated = report.temporal_gate(stats, 10, least_ratio=0.0, p50=0, p90=0)
    return rounded(report.master_table(gated)).select("system", "n", "offdiag", "density", "intra", "inter", "ratio")


@query(f"""WITH RECURSIVE {STRUCT}, {BRANDS}, {LINES}, lk AS (SELECT DISTINCT a.n AS a, b.n AS b FROM so a JOIN so b USING (g)), nb AS (SELECT DISTINCT no AS n FROM brands), u AS (SELECT a, b FROM lk UNION SELECT n, n FROM nb),
r(k, n, m) AS (SELECT 0, n, n FROM nb UNION ALL SELECT r.k + 1, u.b, min(r.m) FROM r JOIN u ON u.a = r.n WHERE r.k < 30 GROUP BY r.k, u.b), cc AS (SELECT n, m AS c FROM r WHERE k = 30), sz AS (SELECT count(*) AS n FROM cc GROUP BY c),
x AS (SELECT sum(v) FILTER (WHERE a.c = b.c) AS s, sum(v) FILTER (WHERE a.c <> b.c) AS o FROM struct JOIN brands p ON p.n = i JOIN brands q ON q.n = j JOIN cc a ON a.n = p.no JOIN cc b ON b.n = q.no), y AS (SELECT sum(n * (n - 1) / 2) AS same, sum(n) * (sum(n) - 1) / 2 AS total FROM sz)
SELECT round(CASE WHEN same > 0 THEN coalesce(s, 0) / same END, 6) AS intra, round(CASE WHEN total > same THEN coalesce(o, 0) / (total - same) END, 6) AS inter, CASE WHEN total > same AND coalesce(o, 0) > 0 THEN round((CASE WHEN same > 0 THEN coalesce(s, 0) / same END) / (o / (total - same)), 6) ELSE 'Infinity'::DOUBLE END AS ratio FROM x, y""")
def component_ratio(spark, d):
    """Similarities within and between what sessions tie together: brands of one tens digit, as orders tie all brands."""
    no = lambda c: F.regexp_extract(c, "[0-9]+", 0).cast("long")
    sim = struct(spark, d).select(no("i").alias("i"), no("j").alias("j"), "v").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "v")
    sets = table(spark, d, "part").select(F.floor(no("p_brand") / 10).alias("g"), no("p_brand").alias("n"))
    nodes = table(spark, d, "part").select(no("p_brand").alias("n")).distinct()
    return rounded(diagnose.component_ratio(kept(spark, sim, "sim"), sets, nodes))


@query(f"WITH {STRUCT}, {TRUTH} SELECT least(a.c, b.c) AS a, greatest(a.c, b.c) AS b, round(sum(v), 6) AS weight, count(*) AS links FROM struct JOIN truth a ON a.n = i JOIN truth b ON b.n = j WHERE v > 0 GROUP BY ALL")
def chord_links(spark, d):
    return rounded(report.chord(struct(spark, d), brand_truth(spark, d)))


@query(f"WITH {MODALITIES}, {TRUTH}, m AS (SELECT 'struct' AS panel, * FROM struct UNION ALL SELECT 'sem', * FROM sem UNION ALL SELECT 'temp', * FROM temp) SELECT panel, least(a.c, b.c) AS a, greatest(a.c, b.c) AS b, round(avg(v), 6) AS mean, round(max(v), 6) AS most FROM m JOIN truth a ON a.n = i JOIN truth b ON b.n = j GROUP BY ALL")
def panel_data(spark, d):
    return rounded(report.panels({"struct": struct(spark, d), "sem": sem(spark, d), "temp": temp(spark, d)}, brand_truth(spark, d)))


@query()
def violin_data(spark, d):
    ids = F.concat_ws("|", "i", "j")
    return rounded(report.violin(struct(spark, d).select(F.substring("i", 1, 7).alias("g"), ids.alias("id"), "v"), "g", 20))


# Structural fusion and grids.


@query(f"""WITH {MODALITIES}, {BRANDS}, pk AS (SELECT x.n AS i, y.n AS j, CASE WHEN x.no // 10 = y.no // 10 THEN 1.0 ELSE 1.0 / 3 END AS v FROM brands x JOIN brands y ON x.n < y.n),
mx AS (SELECT 'inh' AS m, i, j, 1.0 AS v FROM struct WHERE v > 0.13 UNION ALL SELECT 'dep', i, j, v FROM temp UNION ALL SELECT 'pkg', i, j, v FROM pk),
ind AS (SELECT i, j, v / max(v) OVER () AS v FROM sem), cl AS (SELECT i, j, 0.7 * v AS v FROM struct UNION ALL SELECT i, j, 0.3 * v FROM ind), calls AS (SELECT 'call' AS m, i, j, sum(v) AS v FROM cl GROUP BY ALL), a AS (SELECT * FROM mx UNION ALL SELECT * FROM calls),
hi AS (SELECT m, max(v) AS hi FROM a GROUP BY m), w(m, w) AS (VALUES ('inh', 0.30), ('dep', 0.15), ('call', 0.35), ('pkg', 0.20)) SELECT i, j, round(least(greatest(sum(w * v / hi), 0), 1), 6) AS v FROM a JOIN hi USING (m) JOIN w USING (m) GROUP BY ALL""")
def structural_four(spark, d):
    """All four structural modalities by the weights of one system; a brand's tens digit is its package."""
    s = kept(spark, struct(spark, d), "struct")
    inherits = s.where("v > 0.13").select("i", "j", F.lit(1.0).alias("v"))
    calls = fusion.call_mix(s, sem(spark, d), fusion.DIRECT["daytrader"])
    path = F.concat(F.lit("p"), F.floor(F.regexp_extract("p_brand", "[0-9]+", 0).cast("int") / 10).cast("string"), F.lit("."), "p_brand")
    near = structure.package_similarity(table(spark, d, "part").select(path.alias("n")).distinct())
    brand = lambda c: F.substring_index(c, ".", -1)
    packages = near.select(F.least(brand("i"), brand("j")).alias("i"), F.greatest(brand("i"), brand("j")).alias("j"), "v")
    return rounded(fusion.structural(inherits, temp(spark, d), calls, packages, "daytrader"))


@query(f"WITH {STRUCT}, {SEM}, d AS (SELECT * FROM struct WHERE false), ind AS (SELECT i, j, v / max(v) OVER () AS v FROM sem) SELECT i, j, round(v, 6) AS v FROM ind")
def indirect_calls(spark, d):
    """Without a call that was matched directly only the others count."""
    return rounded(fusion.call_mix(struct(spark, d).where("false"), sem(spark, d)))


@query()
def autotune_grid(spark, d):
    """Every point of the fast grid: mode and its parameter, edge floor, resolution; the best is chosen."""
    s, u = certainty(spark, d)
    graph = kept(spark, cluster.damping_points(s, u, n_brands(spark, d), {"gate": [1.0, 2.0, 4.0], "exp": [2.0, 4.0, 6.0]}, [0.01, 0.005, 0.001]), "grid")
    by = ("mode", "param", "floor")
    parts = kept(spark, cluster.swept(graph, cluster.resolutions(0.05, 12.0, 0.05), by=by), "parts")
    return rounded(cluster.best_resolution(graph, parts, 2, 8, by=by))


@query()
def chosen_partition(spark, d):
    graph = kept(spark, normalize.knn_graph(full(spark, d), 4), "graph")
    return rounded(cluster.chosen_partition(graph, 2, 8, cluster.resolutions(), 3))


@query()
def phase_one(spark, d):
    """Louvain of the strong edges of sem and struct in three mixtures."""
    s, m = kept(spark, struct(spark, d), "struct"), kept(spark, sem(spark, d), "sem")
    grid = None
    for alpha in (0.3, 0.5, 0.7):
        one = fusion.fuse([(m, alpha), (s, 1 - alpha)], renormalise=False).where("v >= 0.3").withColumn("alpha", F.lit(alpha))
        grid = one if grid is None else grid.union(one)
    grid = kept(spark, grid.select("alpha", "i", "j", "v"), "grid")
    return rounded(cluster.scored(grid, kept(spark, cluster.swept(grid, [1.0], by=("alpha",)), "parts"), by=("alpha",)))


def settings(spark, d):
    """The graphs of the runner's settings: each modality alone, the fusion, and the fusion damped by uncertainty in two modes."""
    s, m, t = (kept(spark, f(spark, d), f.__name__) for f in (struct, sem, temp))
    u = kept(spark, uncertainty(spark, d, s, m, t), "uncertainty")
    tri, n = kept(spark, trimodal(s, m, t), "tri"), n_brands(spark, d)
    rows = {"struct": s, "sem": m, "temp": t, "fused": tri, "damped exp": fusion.damped(tri, u, n, "exp"), "damped sigmoid": fusion.damped(tri, u, n, "sigmoid")}
    out = None
    for name, sim in rows.items():
        one = sim.select(F.lit(name).alias("setting"), "i", "j", "v")
        out = one if out is None else out.union(one)
    return kept(spark, out, "settings")


@query()
def table_runner(spark, d):
    """setting, resolution, and all measures of its chosen partition: clusters, modularity, accuracy against the truth, coupling over the structural links. A setting without a solution says so."""
    graphs, truth, by = settings(spark, d), brand_truth(spark, d), ("setting",)
    parts = kept(spark, cluster.swept(graphs, cluster.resolutions(0.1, 8.0, 0.1), by=by), "parts")
    table_ = cluster.scored(graphs, parts, by)
    best = table_.where("k between 2 and 8").groupBy("setting").agg(F.max(F.struct((F.col("q") > 0).alias("positive"), F.round("score", 9).alias("score"), (-F.col("resolution")).alias("r"), "q", "ratio", "k")).alias("b"))
    chosen = kept(spark, best.select("setting", (-F.col("b.r")).alias("resolution"), "b.k", "b.q", "b.ratio"), "best")
    picked = kept(spark, parts.join(F.broadcast(chosen.select("setting", "resolution")), ["setting", "resolution"]), "picked")  # one row for each setting
    deps = graphs.where("setting = 'struct'").select(F.col("i").alias("source"), F.col("j").alias("target"), F.col("v").alias("w"))
    done = chosen.drop("k").join(metrics.measures(picked, truth, deps, by), "setting")
    return rounded(graphs.select("setting").distinct().join(done, "setting", "left").withColumn("status", F.when(F.col("resolution").isNull(), "no solution").otherwise("chosen")))


@query("""WITH RECURSIVE deps AS (SELECT c_nationkey AS s, s_nationkey AS t, count(*) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
pt AS (SELECT m AS setting, n_nationkey AS n, n_nationkey % m AS c FROM nation, (VALUES (2), (3), (4), (5), (7)) v(m)), ce AS (SELECT setting, c AS p, n_regionkey AS t, count(*) AS c FROM pt JOIN nation ON n = n_nationkey GROUP BY ALL),
cp AS (SELECT setting, p, sum(c) AS n FROM ce GROUP BY ALL), cl AS (SELECT setting, t, sum(c) AS n FROM ce GROUP BY ALL),
a AS (SELECT setting, sum(ce.c) AS n, sum(ce.c * ce.c / cp.n) / sum(ce.c) AS bp, sum(ce.c * ce.c / cl.n) / sum(ce.c) AS br, sum(ce.c * (ce.c - 1) / 2) AS tp, count(DISTINCT p) AS k, count(DISTINCT t) AS gt_k FROM ce JOIN cp USING (setting, p) JOIN cl USING (setting, t) GROUP BY setting),
b AS (SELECT a.*, tp / (SELECT sum(cp.n * (cp.n - 1) / 2) FROM cp WHERE cp.setting = a.setting) AS pp, tp / (SELECT sum(cl.n * (cl.n - 1) / 2) FROM cl WHERE cl.setting = a.setting) AS pr FROM a),
o AS (SELECT setting, p, row_number() OVER (PARTITION BY setting ORDER BY n DESC, p) AS o FROM cp), x AS (SELECT setting, o, t, c FROM ce JOIN o USING (setting, p)),
r AS (SELECT setting, CAST(0 AS BIGINT) AS o, CAST([] AS INTEGER[]) AS used, CAST(0 AS HUGEINT) AS kept FROM a UNION ALL
  SELECT r.setting, r.o + 1, list_concat(any_value(used), list_filter([arg_min(t, (-c, t)) FILTER (WHERE NOT list_contains(used, t))], lambda y: y IS NOT NULL)), any_value(kept) + coalesce(max(c) FILTER (WHERE NOT list_contains(used, t)), 0)
  FROM r JOIN x ON x.setting = r.setting AND x.o = r.o + 1 GROUP BY r.setting, r.o), mj AS (SELECT setting, max(kept) AS kept FROM r GROUP BY setting),
cr AS (SELECT p1.setting, p1.c AS cs, p2.c AS ct, s = t AS lp, w FROM deps JOIN pt p1 ON p1.n = s JOIN pt p2 ON p2.n = t AND p2.setting = p1.setting),
cu AS (SELECT setting, CAST(sum(CASE WHEN cs <> ct THEN w ELSE 0 END) AS DOUBLE) AS ifn, count(*) FILTER (WHERE cs <> ct) / count(*) AS icp FROM cr GROUP BY setting), sz AS (SELECT setting, c, count(*) AS z FROM pt GROUP BY ALL),
sp AS (SELECT setting, count(*) AS k, stddev_pop(z) / avg(z) AS ned, sum(z) AS nodes FROM sz GROUP BY setting),
fl AS (SELECT setting, cs AS c, sum(CASE WHEN cs = ct THEN w ELSE 0 END) AS i, sum(CASE WHEN cs <> ct THEN w ELSE 0 END) AS e FROM cr WHERE NOT lp GROUP BY ALL),
sm AS (SELECT setting, avg(CASE WHEN z > 1 THEN coalesce(i, 0) / (z * (z - 1)) ELSE 0 END) - avg(CASE WHEN nodes > z THEN coalesce(e, 0) / (z * (nodes - z)) ELSE 0 END) AS sm FROM sz JOIN sp USING (setting) LEFT JOIN fl USING (setting, c) GROUP BY setting)
SELECT setting, sp.k AS k, gt_k, b.k - gt_k AS k_diff, round(2 * bp * br / (bp + br), 6) AS bcubed, round(CASE WHEN pp + pr > 0 THEN 2 * pp * pr / (pp + pr) ELSE 0 END, 6) AS pairwise, round(CAST(100 * kept / n AS DOUBLE), 6) AS mojosim,
  ifn, round(icp, 6) AS icp, round(ned, 6) AS ned, round(sm, 6) AS sm FROM b JOIN sp USING (setting) JOIN mj USING (setting) JOIN cu USING (setting) JOIN sm USING (setting)""")
def partition_measures(spark, d):
    """All measures of several partitions of the nations at once, against their regions."""
    nations = table(spark, d, "nation")
    settings_ = F.explode(F.array(*map(F.lit, (2, 3, 4, 5, 7))))
    parts = nations.select(settings_.alias("setting"), F.col("n_nationkey").alias("n")).withColumn("cluster", F.col("n") % F.col("setting"))
    return rounded(metrics.measures(parts, nations.select(F.col("n_nationkey").alias("n"), F.col("n_regionkey").cast("int").alias("cluster")), nation_deps(spark, d), ("setting",)))


@query(f"""WITH {CONT}, y AS (SELECT sum(c * c / cp.n) / sum(c) AS p, sum(c * c / cl.n) / sum(c) AS r FROM ct JOIN cp USING (p) JOIN cl USING (t)), a AS (SELECT {F1} AS f1 FROM y),
s AS (SELECT label, count(*) AS n FROM embeddings GROUP BY ALL), m AS (SELECT sum(n * n) / (sum(n) * sum(n)) AS p FROM s), b AS (SELECT 2 * p / (p + 1) AS f1 FROM m)
SELECT round(b.f1, 6) AS base, round(a.f1, 6) AS new, round((a.f1 - b.f1) / abs(b.f1) * 100, 6) AS percent, CASE WHEN a.f1 > b.f1 THEN 'new' ELSE 'base' END AS better FROM a, b""")
def baseline_comparison(spark, d):
    """A given partition against a baseline, as a table of one figure."""
    truth = vec_truth(spark, d)
    base, new = metrics.bcubed(diagnose.monolith(truth), truth).select(F.col("f1").alias("base")), metrics.bcubed(vec_pred(spark, d), truth).select(F.col("f1").alias("new"))
    both = base.join(F.broadcast(new))  # one row each
    return rounded(both.select("base", "new", math.improvement(F.col("new"), F.col("base"), True).alias("percent"), F.when(F.col("new") > F.col("base"), "new").otherwise("base").alias("better")))


@query()
def smoothing_sensitivity(spark, d):
    """How the smoothing of evidence moves the uncertainty of all pairs."""
    s, m, t = struct(spark, d), sem(spark, d), temp(spark, d)
    sims = s.select("i", "j", F.col("v").alias("struct")).join(m.select("i", "j", F.col("v").alias("sem")), ["i", "j"], "full").join(t.select("i", "j", F.col("v").alias("temp")), ["i", "j"], "full").fillna(0.0, ["struct", "sem", "temp"])
    part = table(spark, d, "part").groupBy(F.col("p_brand").alias("n")).agg(F.array(*(F.avg((F.col("p_size") % 7 == k).cast("double")) for k in range(7))).alias("e"))
    x = edl.pair_features(part, sims.withColumn("fused", (F.col("struct") + F.col("sem") + F.col("temp")) / 3))
    truth = brand_truth(spark, d)
    x = x.join(truth.select(F.col("n").alias("i"), F.col("cluster").alias("a")), "i").join(truth.select(F.col("n").alias("j"), F.col("cluster").alias("b")), "j").withColumn("y", (F.col("a") == F.col("b")).cast("int"))
    x = kept(spark, x, "features")
    return rounded(edl.smoothing_sensitivity(x, edl.train_all(x, hard=0.5)), 4)


@query("SELECT event_type AS label, count(*) AS n, event_type IN ('view', 'purchase', 'error') AS hit FROM events GROUP BY ALL")
def mapping_hits(spark, d):
    rules = spark.createDataFrame([("view",), ("purchase",), ("error",), ("never",)], "key string")
    return filters.rule_hits(table(spark, d, "events").select(F.col("event_type").alias("label")), rules, text.label_key)


@query(f"""WITH {STRUCT}, {TRUTH}, g(cap) AS (VALUES (0.05e0), (0.1e0), (0.12e0), (0.14e0)), x AS (SELECT cap, a.c = b.c AS same, v FROM struct JOIN truth a ON a.n = i JOIN truth b ON b.n = j, g WHERE v > cap),
p AS (SELECT cap, count(*) AS edges, round(count(*) FILTER (WHERE same) / count(*), 9) AS purity FROM x GROUP BY cap) SELECT cap, edges, round(purity, 6) AS purity FROM p ORDER BY p.purity DESC, edges DESC, cap LIMIT 1""")
def best_point(spark, d):
    """The point of a sweep over edge floors whose edges lie within true clusters most."""
    truth = brand_truth(spark, d)
    pairs_ = struct(spark, d).join(truth.select(F.col("n").alias("i"), F.col("cluster").alias("a")), "i").join(truth.select(F.col("n").alias("j"), F.col("cluster").alias("b")), "j")
    grid = pairs_.withColumn("cap", F.explode(F.array(*map(F.lit, (0.05, 0.1, 0.12, 0.14))))).where("v > cap")
    points = grid.groupBy("cap").agg(F.count("*").alias("edges"), F.round(F.avg((F.col("a") == F.col("b")).cast("double")), 9).alias("purity"))
    return rounded(report.best(points.withColumn("all", F.lit(1)), ["all"], ["purity", "edges"], "cap").drop("all"))
