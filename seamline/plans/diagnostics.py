"""More registered queries: filters, sets, summaries, baselines, sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamline.functions import text, words
from seamline.operators import code, diagnose, filters, metrics, normalize, pairs, sampling, sessions, spans, terms
from seamline.plans.queries import BRANDS, COSINES, STRUCT, TRUTH, UNCERTAINTY, brand_truth, kept, labelled_vectors, micros, n_brands, query, rounded, sem, struct, table, uncertainty, user_events, vec_truth


def names(spark, d):
    """Qualified names from pages: the host backwards, then the path's parts."""
    host = F.array_join(F.reverse(F.split(F.regexp_extract("url", r"^https?://([^/?#]+)", 1), r"\.")), ".")
    return table(spark, d, "pages").select("page_id", F.concat(host, F.lit("."), F.regexp_extract("url", r"^https?://[^/]+/(\w+)/", 1), F.lit(".Page"), F.regexp_extract("url", r"/([0-9]+)", 1), F.when(F.col("page_id") % 7 == 0, "Model").when(F.col("page_id") % 7 == 1, "ViewHelper").otherwise("")).alias("n"))


NAMES = r"""nm AS (SELECT page_id, array_to_string(list_reverse(string_split(regexp_extract(url, '^https?://([^/?#]+)', 1), '.')), '.') || '.' || regexp_extract(url, '^https?://[^/]+/(\w+)/', 1) || '.Page' || regexp_extract(url, '/([0-9]+)', 1) || CASE WHEN page_id % 7 = 0 THEN 'Model' WHEN page_id % 7 = 1 THEN 'ViewHelper' ELSE '' END AS n FROM pages)"""


def listed(parts) -> str:
    return "[" + ", ".join(f"'{p}'" for p in parts) + "]"


@query(f"WITH {NAMES} SELECT page_id, starts_with(n, 'com.example.') OR NOT (len(list_filter({listed(words.FOREIGN_PREFIXES)}, lambda p: starts_with(lower(n), p))) > 0 OR len(list_filter({listed(words.FOREIGN_PARTS)}, lambda p: contains(lower(n), p))) > 0) AS business FROM nm")
def business_filter(spark, d):
    return names(spark, d).select("page_id", filters.is_business(F.col("n"), ("com.example.",)).alias("business"))


@query(f"WITH {NAMES}, s AS (SELECT *, lower(regexp_extract(n, '[^.]*$')) AS simple, lower(regexp_replace(n, '\\.[^.]*$', '')) AS pkg FROM nm) SELECT page_id, len(list_filter({listed(words.NOISE_PACKAGES)}, lambda p: contains(pkg, p))) > 0 OR regexp_matches(simple, '(dto|vo|po|entity|entities|model)$') OR regexp_matches(simple, 'exception|logger') AS noise FROM s")
def noise_package_filter(spark, d):
    return names(spark, d).select("page_id", filters.is_noise_package(F.col("n")).alias("noise"))


@query(f"WITH {NAMES} SELECT n, count(*) AS c FROM nm WHERE len(list_filter({listed(words.PLUMBING)}, lambda p: contains(lower(n), p))) = 0 GROUP BY n")
def plumbing_filter(spark, d):
    return filters.without_plumbing(names(spark, d)).groupBy("n").agg(F.count("*").alias("c"))


@query(f"WITH {NAMES} SELECT DISTINCT n FROM nm WHERE starts_with(n, 'com.example') AND NOT regexp_matches(lower(n), '\\.em|\\.q|\\.tx|util')")
def candidate_classes(spark, d):
    n = names(spark, d).select("n")
    return filters.candidates(n, n, "com.example")


@query(r"""WITH r(key, nodes) AS (VALUES ('view', ['Catalog', 'Page']), ('purchase', ['Order']), ('error', ['Log'])) SELECT event_id, unnest(nodes) AS node FROM events JOIN r ON translate(lower(trim('  ' || event_type || ' ')), ' _-', '') = key""")
def label_mapping(spark, d):
    rules = spark.createDataFrame([("view", ["Catalog", "Page"]), ("purchase", ["Order"]), ("error", ["Log"])], "key string, nodes array<string>")
    labels = table(spark, d, "events").select("event_id", text.label_key(F.concat(F.lit("  "), "event_type", F.lit(" "))).alias("key"))
    return filters.mapped(labels, rules).select("event_id", "node")


@query("SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def texts_dedup_first(spark, d):
    docs = table(spark, d, "documents")
    first = docs.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"))  # counted before it is dealt out: copies cost nothing
    return docs.join(first, "doc_id", "left_semi").select("doc_id", "text")


@query("WITH f AS (SELECT user_id AS g, event_type AS n, min((ts, event_id)) AS first FROM events GROUP BY ALL) SELECT g, list(n ORDER BY first) AS nodes FROM f GROUP BY g")
def ordered_distinct(spark, d):
    first = user_events(spark, d).groupBy("g", "n").agg(F.min("seq").alias("first"))
    return first.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("first", "n"))).alias("x")).select("g", F.transform("x", lambda y: y["n"]).alias("nodes"))


@query("SELECT o_custkey AS k, o_orderkey AS v FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def last_wins_merge(spark, d):
    return code.last_wins(table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v")), "k", "v")


@query("SELECT DISTINCT s, t FROM (SELECT p_brand AS s, p_type AS t FROM part UNION ALL SELECT p_brand, p_name FROM part UNION ALL SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey)")
def graph_union(spark, d):
    p = table(spark, d, "part")
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return p.select(F.col("p_brand").alias("s"), F.col("p_type").alias("t")).union(p.select("p_brand", "p_name")).union(n.select("r_name", "n_name")).distinct()


@query("SELECT count(*) AS samples, count(l.doc_id) AS aligned, round(count(l.doc_id) / count(*), 6) AS ratio FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id")
def log_trace_coverage(spark, d):
    return rounded(spans.alignment(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id"))


@query(f"WITH {STRUCT}, e AS (SELECT i AS n, v FROM struct UNION ALL SELECT j, v FROM struct) SELECT n, round(sum(v), 6) AS weight, count(*) AS deg FROM e WHERE v > 0 GROUP BY n")
def glue_classes(spark, d):
    return rounded(diagnose.degrees(struct(spark, d)))


@query(f"WITH {STRUCT} SELECT 2 * count(*) AS edges, round(2 * count(*) / max(n * n - n), 6) AS density, round(2 * count(*) / max(n * n), 6) AS ratio FROM struct, (SELECT count(DISTINCT p_brand) AS n FROM part) WHERE v > 0")
def offdiag_density(spark, d):
    return rounded(diagnose.density(struct(spark, d), n_brands(spark, d)))


@query("SELECT event_type AS label, count(*) AS n FROM events GROUP BY ALL ORDER BY n DESC, label LIMIT 3")
def frequency_top(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(3)


@query(r"SELECT round(avg(CASE WHEN contains(url, '?') THEN 1 ELSE 0 END), 6) AS query, round(avg(CASE WHEN contains(url, '#') THEN 1 ELSE 0 END), 6) AS fragment, round(avg(CASE WHEN starts_with(url, 'https') THEN 1 ELSE 0 END), 6) AS tls, count(*) AS n FROM pages")
def attribute_presence(spark, d):
    share = lambda c: F.avg(c.cast("double"))
    return rounded(table(spark, d, "pages").agg(share(F.contains("url", F.lit("?"))).alias("query"), share(F.contains("url", F.lit("#"))).alias("fragment"), share(F.startswith("url", F.lit("https"))).alias("tls"), F.count("*").alias("n")))


@query("SELECT user_id AS trace, min(epoch_us(ts)) AS start_us FROM events GROUP BY ALL")
def earliest_start(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("trace")).agg(F.min(micros()).alias("start_us"))


@query("SELECT p_brand AS pkg, count(*) AS n, list(p_name ORDER BY p_name) AS members FROM (SELECT DISTINCT p_brand, replace(p_name, ' ', '') AS p_name FROM part) GROUP BY ALL")
def package_summary(spark, d):
    return code.package_summary(table(spark, d, "part").select(F.concat("p_brand", F.lit("."), F.replace("p_name", F.lit(" "), F.lit(""))).alias("fqcn")).distinct())


@query("SELECT label AS g, k - 1 AS k, round((avg(x) + max(x)) / 2, 6) + 0.0 AS v FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(generate_series(1, len(embedding))) AS k FROM embeddings) GROUP BY ALL")
def class_embedding(spark, d):
    return rounded(terms.mean_max(table(spark, d, "embeddings").select(F.col("label").alias("g"), F.col("embedding").cast("array<double>").alias("e")))).select("g", F.col("k").cast("long").alias("k"), "v")


@query(f"WITH {STRUCT}, {TRUTH} SELECT least(a.c, b.c) AS a, greatest(a.c, b.c) AS b, round(avg(v), 6) AS mean, count(*) FILTER (WHERE v > 0) AS edges FROM struct JOIN truth a ON a.n = i JOIN truth b ON b.n = j GROUP BY ALL")
def cluster_links(spark, d):
    return rounded(diagnose.cluster_links(struct(spark, d), brand_truth(spark, d)))


@query("WITH s AS (SELECT label, count(*) AS n FROM embeddings GROUP BY ALL), y AS (SELECT sum(n * n) / (sum(n) * sum(n)) AS p FROM s) SELECT round(p, 6) AS precision, 1e0 AS recall, round(2 * p / (p + 1), 6) AS f1 FROM y")
def monolith_baseline(spark, d):
    truth = vec_truth(spark, d)
    return rounded(metrics.bcubed(diagnose.monolith(truth), truth))


@query()
def random_baseline(spark, d):
    truth = vec_truth(spark, d)
    return rounded(metrics.bcubed(diagnose.random_partition(truth, 10), truth))


@query(f"WITH {STRUCT}, {TRUTH}, o AS (SELECT n, c AS cluster, row_number() OVER (ORDER BY c, n) - 1 AS pos FROM truth WHERE n IN (SELECT i FROM struct UNION SELECT j FROM struct)) SELECT n, cluster, pos, coalesce(lag(cluster) OVER (ORDER BY pos) <> cluster, true) AS starts FROM o")
def reordered_matrix(spark, d):
    return diagnose.reordered(struct(spark, d), brand_truth(spark, d))


@query("SELECT w, trace_id, spans, hits FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY spans DESC, hits DESC, trace_id) AS k FROM (SELECT strftime(ts, '%Y-%m-%d') AS w, user_id AS trace_id, count(*) AS spans, count(*) FILTER (WHERE event_type = 'purchase' AND value > 100) AS hits FROM events GROUP BY ALL) WHERE hits > 0) WHERE k = 1")
def best_trace_window(spark, d):
    e = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("w"), F.col("user_id").alias("trace_id")).agg(F.count("*").alias("spans"), F.count_if((F.col("event_type") == "purchase") & (F.col("value") > 100)).alias("hits"))
    return spans.best_trace(e)


@query("""WITH nn AS (SELECT DISTINCT 'x.' || p_type || '.' || p_brand AS n FROM part WHERE p_size > 0), b AS (SELECT a.n AS i, b.n AS j, 0.05 AS v FROM nn a JOIN nn b ON a.n < b.n AND string_split(a.n, '.')[2] = string_split(b.n, '.')[2]),
s AS (SELECT min(n) AS i, max(n) AS j, 0.5 AS v FROM nn) SELECT i, j, round(CAST(sum(v) AS DOUBLE), 6) AS v FROM (SELECT * FROM b UNION ALL SELECT * FROM s) GROUP BY ALL""")
def leaf_smoothing(spark, d):
    n = table(spark, d, "part").where("p_size > 0").select(F.concat(F.lit("x."), "p_type", F.lit("."), "p_brand").alias("n")).distinct()
    one = n.agg(F.min("n").alias("i"), F.max("n").alias("j")).withColumn("v", F.lit(0.5))
    return rounded(diagnose.leaf_smoothing(one, n, 0.05))


@query(f"WITH {UNCERTAINTY} SELECT round(ln(2) / quantile_cont(v, 0.5), 6) AS k FROM u")
def adaptive_k(spark, d):
    return rounded(diagnose.adaptive_k(uncertainty(spark, d)))


@query(f"WITH {STRUCT}, q AS (SELECT quantile_cont(v, 0.7) AS q FROM struct WHERE v > 0), g AS (SELECT cap, least(q, cap) AS tau FROM q, (VALUES (0.05e0), (0.1e0), (0.12e0), (0.14e0), (0.5e0)) t(cap)) SELECT cap, round(tau, 6) AS tau, count(*) FILTER (WHERE v > tau) AS edges, round(avg(CASE WHEN v > tau THEN 1e0 ELSE 0e0 END), 6) AS share FROM struct, g GROUP BY cap, tau")
def threshold_cap_sweep(spark, d):
    return rounded(diagnose.cap_sweep(kept(spark, struct(spark, d), "struct"), [0.05, 0.1, 0.12, 0.14, 0.5]))


@query(f"WITH {COSINES}, t AS (SELECT li, lj FROM cs ORDER BY round(v, 9) DESC, i, j LIMIT 100) SELECT count(*) AS top, count(*) FILTER (WHERE li <> lj) AS crossing, round(avg(CASE WHEN li <> lj THEN 1e0 ELSE 0e0 END), 6) AS share FROM t")
def cross_domain_share(spark, d):
    crossing = ~F.col("same")
    top = pairs.cosine_top(labelled_vectors(spark, d), 100)
    return rounded(top.agg(F.count("*").alias("top"), F.count_if(crossing).alias("crossing"), F.avg(crossing.cast("double")).alias("share")))


@query(f"WITH {BRANDS} SELECT no % 5 AS cluster, count(*) AS size, list(n ORDER BY n) AS members FROM brands GROUP BY ALL")
def cluster_report(spark, d):
    return diagnose.cluster_report(brand_truth(spark, d))


@query("SELECT vec_id AS n, CASE WHEN label IN (1, 3) THEN 1 WHEN label = 2 THEN 0 ELSE label END AS label FROM embeddings")
def merged_labels(spark, d):
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("n"), F.col("label").cast("int").alias("label"))
    return diagnose.merged_labels(labels, "1,3->1; 2->0")


@query("""WITH m AS (SELECT p_brand AS system, p_type AS method, CAST(count(*) AS DOUBLE) AS n, avg(p_retailprice) AS price FROM part GROUP BY ALL), w AS (SELECT *, min(n) OVER s AS a, max(n) OVER s AS b, min(price) OVER s AS c, max(price) OVER s AS d FROM m WINDOW s AS (PARTITION BY system))
SELECT system, method, round(CASE WHEN b - a < 1e-12 THEN 0.5e0 ELSE (n - a) / (b - a) END, 6) + 0.0 AS n_score, round(CASE WHEN d - c < 1e-12 THEN 0.5e0 ELSE 1 - (price - c) / (d - c) END, 6) + 0.0 AS price_score FROM w""")
def radar_scores(spark, d):
    m = table(spark, d, "part").groupBy(F.col("p_brand").alias("system"), F.col("p_type").alias("method")).agg(F.count("*").cast("double").alias("n"), F.avg("p_retailprice").alias("price"))
    return rounded(diagnose.radar(m, {"n": True, "price": False}))


@query("""WITH r AS (SELECT p_brand AS system, count(*) FILTER (WHERE p_size < 5) / count(*) AS nz, CASE WHEN count(*) % 7 > 0 THEN round(avg(p_size) - 25, 0) END AS ifn, round(count(*) FILTER (WHERE p_type = 'SMALL') - count(*) FILTER (WHERE p_type = 'ECONOMY'), 0) AS f1 FROM part GROUP BY ALL)
SELECT system, CASE WHEN nz IS NOT NULL AND nz < 0.05 THEN 'sparse evidence' WHEN ifn > 0 AND f1 < 0 THEN 'trade-off' WHEN ifn > 0 AND f1 > 0 THEN 'consistent gains' WHEN ifn < 0 AND f1 < 0 THEN 'over-suppression' ELSE 'depends on the system' END AS diagnosis FROM r""")
def conflict_diagnosis(spark, d):
    n = lambda c: F.count_if(c)
    gain = F.when(F.count("*") % 7 > 0, F.round(F.avg("p_size") - 25, 0))
    r = table(spark, d, "part").groupBy(F.col("p_brand").alias("system")).agg((n(F.col("p_size") < 5) / F.count("*")).alias("nonzero"), gain.alias("ifn_gain"), (n(F.col("p_type") == "SMALL") - n(F.col("p_type") == "ECONOMY")).alias("f1_gain"))
    return diagnose.diagnosis(r).select("system", "diagnosis")


@query()
def spectral_clusters(spark, d):
    return diagnose.spectral(normalize.minmax(sem(spark, d)), 4)


@query()
def hashed_embeddings(spark, d):
    return terms.hashed_vectors(table(spark, d, "documents").select(F.col("doc_id").alias("d"), "text")).select("d", F.transform("e", lambda x: F.round(x, 6)).alias("e"))


@query("SELECT k, round(avg(c), 6) AS mean, max(c) AS most FROM (SELECT l_orderkey AS g, count(DISTINCT p_brand) AS c, count(*) AS k FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) GROUP BY k")
def hit_sizes(spark, d):
    x = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    per = x.groupBy(F.col("l_orderkey").alias("g")).agg(F.count_distinct("p_brand").alias("c"), F.count("*").alias("k"))
    return rounded(per.groupBy("k").agg(F.avg("c").alias("mean"), F.max("c").alias("most")))


@query()
def learned_embeddings(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("d"), "text")
    return terms.learned_vectors(docs).select("d", F.transform("e", lambda x: F.round(x, 6)).alias("e"))


@query("SELECT DISTINCT l_discount AS rho, replace(printf('%.2f', l_discount), '.', 'p') AS name FROM lineitem UNION SELECT l_tax, replace(printf('%.2f', l_tax), '.', 'p') FROM lineitem")
def rho_names(spark, d):
    lines = table(spark, d, "lineitem")
    return lines.select(F.col("l_discount").alias("rho")).union(lines.select("l_tax")).distinct().select("rho", text.rho_name(F.col("rho")).alias("name"))


@query("""WITH p AS (SELECT l_returnflag = 'R' AS pos, l_discount * 10 >= 0.6 AND l_tax * 10 <= 0.3 AS hard FROM lineitem), n AS (SELECT count(*) FILTER (WHERE pos) AS pos, count(*) FILTER (WHERE NOT pos AND hard) AS hard, count(*) FILTER (WHERE NOT pos AND NOT hard) AS plain FROM p),
k AS (SELECT pos, plain, least(hard, CAST(floor(pos * 0.3) AS BIGINT)) AS hard FROM n) SELECT pos AS positive, hard, least(plain, greatest(0, pos * 2 - hard)) AS plain FROM k""")
def balanced_sample(spark, d):
    """Lines stand for pairs: how many of each kind the balanced sample takes."""
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_linenumber").alias("j"), (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_discount") * 10).alias("static"), (F.col("l_tax") * 10).alias("temp"))
    hard = (F.col("static") >= 0.6) & (F.col("temp") <= 0.3)
    return sampling.balanced_pairs(x).agg(F.count_if(F.col("y") == 1).alias("positive"), F.count_if((F.col("y") == 0) & hard).alias("hard"), F.count_if((F.col("y") == 0) & ~hard).alias("plain"))


@query("""WITH RECURSIVE e AS (SELECT epoch_ms(ts) AS t, event_id FROM events), a AS (SELECT min(t) AS t FROM e UNION ALL SELECT (SELECT min(t) FROM e WHERE e.t > a.t + 86400000) FROM a WHERE a.t IS NOT NULL), s AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS session FROM a WHERE t IS NOT NULL)
SELECT session, count(*) AS n, min(event_id) AS least, max(event_id) AS most FROM e ASOF JOIN s ON e.t >= s.t GROUP BY session""")
def global_sessions(spark, d):
    """All users' events as one stream."""
    e = table(spark, d, "events").select(F.struct("ts", "event_id").alias("seq"), F.floor(micros() / 1000).alias("t"), F.col("event_id").alias("n"))
    return sessions.stream_sessions(e, 86_400_000).groupBy("session").agg(F.count("*").alias("n"), F.min("n").alias("least"), F.max("n").alias("most"))
