"""The registered queries: each operator on the driver's tables, with the same question as DuckDB SQL.

Brands stand for classes: orders are their traces, supplier days their sessions, names and types their vocabulary. Nations stand for services, users for threads.
Values are rounded on both sides, as sums differ in their last digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from seamline.functions import math, text
from seamline.operators import cluster, components, edl, fusion, metrics, normalize, pairs, report, sampling, sessions, spans, structure, terms
from seamline.sources import maps
from seamline.workspace import Workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query by its function's name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without a negative zero."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def micros() -> Column:
    """Microseconds of ts since 1970, whether or not it has a time zone."""
    return F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")


def millis() -> Column:
    return F.floor(micros() / 1000)


# Inputs that several queries share, on both sides.


def order_brands(spark, d):
    """Orders with the brands of their lines, repeats and all."""
    return pairs.members(table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")), F.col("l_orderkey"), F.col("p_brand"))


def order_items(spark, d):
    return order_brands(spark, d).distinct()


def day_brands(spark, d):
    day = F.struct("l_suppkey", F.to_date("l_shipdate").alias("day"))
    day = F.when(F.col("l_suppkey").isNotNull() & F.col("l_shipdate").isNotNull(), day)
    return pairs.members(table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")), day, F.col("p_brand"))


def struct(spark, d):
    return pairs.jaccard(order_brands(spark, d))


def temp(spark, d):
    return pairs.jaccard(day_brands(spark, d))


def sem(spark, d):
    counts = table(spark, d, "part").groupBy(F.col("p_brand").alias("n"), F.col("p_name").alias("k")).agg(F.count("*").alias("c"))
    return pairs.count_cosine(counts).select("i", "j", ((F.col("v") + 1) / 2).alias("v"))


def brands(spark, d):
    return table(spark, d, "part").select(F.col("p_brand").alias("n")).distinct()


def kept(spark, df, name):
    """A matrix that is read several times, as a table: later passes scan it instead of joining again."""
    return Workspace(spark, "queries").keep(df, name)


def uncertainty(spark, d, s=None, m=None, t=None):
    static = fusion.fuse([(struct(spark, d) if s is None else s, 0.5), (sem(spark, d) if m is None else m, 0.5)])
    return normalize.minmax(kept(spark, fusion.disagreement(static, temp(spark, d) if t is None else t), "gap"), least_range=0.0)


def certainty(spark, d):
    """The structural matrix and its uncertainty, both tables."""
    s = kept(spark, struct(spark, d), "struct")
    return s, kept(spark, uncertainty(spark, d, s), "uncertainty")


def full(spark, d):
    diagonal = brands(spark, d).select(F.col("n").alias("i"), F.col("n").alias("j"), F.lit(1.0).alias("v"))
    return pairs.mirrored(kept(spark, struct(spark, d), "struct")).union(diagonal)


def n_brands(spark, d):
    return brands(spark, d).count()


def brand_no():
    return F.regexp_extract("n", "[0-9]+", 0).cast("int")


def brand_truth(spark, d):
    return brands(spark, d).select("n", (brand_no() % 5).alias("cluster"))


def brand_pred(spark, d):
    return brands(spark, d).select("n", F.floor(brand_no() / 7).cast("int").alias("cluster"))


def vec_pred(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("n"), (F.col("vec_id") % 7).cast("int").alias("cluster"))


def vec_truth(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("n"), F.col("label").cast("int").alias("cluster"))


def name_edges(spark, d):
    return table(spark, d, "part").select(F.col("p_brand").alias("source"), F.col("p_name").alias("target"))


def nation_deps(spark, d):
    x = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return x.groupBy(F.col("c_nationkey").alias("source"), F.col("s_nationkey").alias("target")).agg(F.count("*").alias("w"))


def nation_part(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("n"), (F.col("n_nationkey") % 4).alias("cluster"))


def user_events(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("g"), F.struct("ts", "event_id").alias("seq"), millis().alias("t"), F.col("event_type").alias("n"))


CAP_MS = 6 * 3_600_000


def user_sessions(spark, d):
    return sessions.anchored_sessions(user_events(spark, d), CAP_MS)


def jaccard_sql(name: str, items: str) -> str:
    return f"""{name}_occ AS (SELECT n, count(*) AS c FROM {items} GROUP BY n),
{name}_co AS (SELECT a.n AS i, b.n AS j, count(*) AS co FROM {items} a JOIN {items} b ON a.g = b.g AND a.n < b.n GROUP BY a.n, b.n),
{name} AS (SELECT i, j, co / (x.c + y.c - co) AS v FROM {name}_co JOIN {name}_occ x ON x.n = i JOIN {name}_occ y ON y.n = j)"""


ITEMS = "items AS (SELECT DISTINCT l_orderkey AS g, p_brand AS n FROM lineitem JOIN part ON l_partkey = p_partkey)"
DAYS = "days AS (SELECT DISTINCT l_suppkey || ':' || strftime(l_shipdate, '%Y-%m-%d') AS g, p_brand AS n FROM lineitem JOIN part ON l_partkey = p_partkey)"
STRUCT = f"{ITEMS}, {jaccard_sql('struct', 'items')}"
TEMP = f"{DAYS}, {jaccard_sql('temp', 'days')}"
SEM = """sem_c AS (SELECT p_brand AS n, p_name AS k, count(*) AS c FROM part GROUP BY ALL), sem_z AS (SELECT n, sqrt(sum(c * c)) AS z FROM sem_c GROUP BY n),
sem AS (SELECT a.n AS i, b.n AS j, (sum(a.c * b.c) / (x.z * y.z) + 1) / 2 AS v FROM sem_c a JOIN sem_c b ON a.k = b.k AND a.n < b.n JOIN sem_z x ON x.n = a.n JOIN sem_z y ON y.n = b.n GROUP BY a.n, b.n, x.z, y.z)"""
MODALITIES = f"{STRUCT}, {TEMP}, {SEM}"
UNCERTAINTY = f"""{MODALITIES}, static AS (SELECT i, j, least(greatest(sum(v * 0.5), 0), 1) AS v FROM (SELECT * FROM struct UNION ALL SELECT * FROM sem) GROUP BY i, j),
gap AS (SELECT coalesce(a.i, b.i) AS i, coalesce(a.j, b.j) AS j, abs(coalesce(a.v, 0) - coalesce(b.v, 0)) AS v FROM static a FULL JOIN temp b ON a.i = b.i AND a.j = b.j),
u AS (SELECT i, j, CASE WHEN hi = lo THEN 0 ELSE (v - lo) / (hi - lo) END AS v FROM gap, (SELECT min(v) AS lo, max(v) AS hi FROM gap))"""
BRANDS = "brands AS (SELECT DISTINCT p_brand AS n, CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) AS no FROM part)"
FULL = f"{STRUCT}, {BRANDS}, fullm AS (SELECT i, j, v FROM struct UNION ALL SELECT j, i, v FROM struct UNION ALL SELECT n, n, 1.0 FROM brands)"
TRUTH = f"{BRANDS}, truth AS (SELECT n, no % 5 AS c FROM brands), pred AS (SELECT n, no // 7 AS c FROM brands)"
NATIONS = """deps AS (SELECT c_nationkey AS s, s_nationkey AS t, count(*) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
cl AS (SELECT n_nationkey AS n, n_nationkey % 4 AS c FROM nation), x AS (SELECT d.*, a.c AS cs, b.c AS ct FROM deps d JOIN cl a ON a.n = s JOIN cl b ON b.n = t)"""
SESSIONS = f"""e AS (SELECT user_id AS g, ts, event_id, (epoch_us(ts) // 1000) AS t, event_type AS n FROM events),
starts(g, k, s) AS (SELECT g, 0, min(t) FROM e GROUP BY g UNION ALL SELECT r.g, r.k + 1, (SELECT min(t) FROM e WHERE e.g = r.g AND e.t > r.s + {CAP_MS}) FROM starts r WHERE r.s IS NOT NULL),
ss AS (SELECT e.*, (SELECT max(k) FROM starts r WHERE r.g = e.g AND r.s <= e.t) AS session FROM e)"""


# Pairs and sessions.


@query(f"WITH {STRUCT} SELECT i, j, round(v, 6) AS v FROM struct")
def basket_jaccard(spark, d):
    return rounded(struct(spark, d))


@query(f"WITH {STRUCT} SELECT i, j, round(v, 6) AS v FROM struct ORDER BY round(v, 9) DESC, i, j LIMIT 10")
def basket_topk_pairs(spark, d):
    return rounded(struct(spark, d).orderBy(F.desc(F.round("v", 9)), "i", "j").limit(10))


@query(f"WITH {STRUCT} SELECT i, j, co FROM struct_co")
def cooccurrence_counts(spark, d):
    return pairs.cooccurrence(order_brands(spark, d))


@query(f"WITH {SEM} SELECT i, j, round(v, 6) AS v FROM sem")
def vocabulary_cosine(spark, d):
    return rounded(sem(spark, d))


@query("""WITH v AS (SELECT vec_id AS n, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), z AS (SELECT n, e, sqrt(list_dot_product(e, e)) AS z FROM v)
SELECT a.n AS i, b.n AS j, round(list_dot_product(a.e, b.e) / (a.z * b.z), 6) + 0.0 AS v FROM z a JOIN z b ON a.n < b.n""")
def cosine_pairs(spark, d):
    return pairs.dense_cosine(table(spark, d, "embeddings").select(F.col("vec_id").alias("n"), F.col("embedding").alias("e")), digits=6)


@query(f"WITH RECURSIVE {SESSIONS} SELECT event_id, g, session FROM ss")
def session_split_anchored(spark, d):
    return user_sessions(spark, d).select(F.col("seq.event_id").alias("event_id"), "g", F.col("session").cast("int").alias("session"))


@query("""WITH e AS (SELECT user_id AS g, event_id, event_type AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS a FROM events)
SELECT g, w, event_id, n FROM e, generate_series(0, 100000) x(w) WHERE w * 6 <= k AND k < w * 6 + 12 AND w * 6 + 12 <= a""")
def sliding_count_windows(spark, d):
    return sessions.count_windows(user_events(spark, d), 12, 6).select("g", "w", F.col("seq.event_id").alias("event_id"), "n")


@query(f"WITH RECURSIVE {SESSIONS} SELECT n, round(count(DISTINCT (g, session)) / (SELECT count(DISTINCT (g, session)) FROM ss), 6) AS coverage FROM ss GROUP BY n")
def session_coverage(spark, d):
    return rounded(sessions.coverage(user_sessions(spark, d)))


@query(f"WITH RECURSIVE {SESSIONS}, h AS (SELECT count(DISTINCT n) AS h FROM ss GROUP BY g, session) SELECT count(*) AS sessions, round(quantile_cont(h, 0.5), 6) AS p50, round(quantile_cont(h, 0.9), 6) AS p90 FROM h")
def session_hit_percentiles(spark, d):
    return rounded(sessions.hit_percentiles(user_sessions(spark, d)))


@query(f"WITH RECURSIVE {SESSIONS}, sets AS (SELECT DISTINCT g || ':' || session AS g, n FROM ss), {jaccard_sql('jj', 'sets')} SELECT i, j, round(v, 6) AS v FROM jj")
def session_jaccard(spark, d):
    return rounded(pairs.jaccard(pairs.items(user_sessions(spark, d), F.concat_ws(":", "g", "session"), F.col("n"))))


@query(f"WITH RECURSIVE {SESSIONS}, busy AS (SELECT g, session FROM ss GROUP BY ALL HAVING count(*) >= 3) SELECT g, CAST(count(*) AS BIGINT) AS items FROM ss JOIN busy USING (g, session) GROUP BY g")
def session_min_items(spark, d):
    return sessions.with_min_items(user_sessions(spark, d), 3).groupBy("g").agg(F.count("*").alias("items"))


# Joins.


def user_windows(spark, d):
    """A window around each sign-up."""
    e = table(spark, d, "events").where("event_type = 'signup'")
    return e.select(F.col("user_id").alias("g"), F.col("event_id").alias("wid"), millis().alias("ws"), (millis() + 7_200_000).alias("wt"))


def user_spans(spark, d):
    """Each other event as a span of as many minutes as its value has whole units."""
    e = table(spark, d, "events").where("event_type <> 'signup'")
    return e.select(F.col("user_id").alias("g"), F.col("event_id").alias("sid"), millis().alias("s"), (millis() + F.floor("value") * 60_000).alias("t"))


SPANS = """w AS (SELECT user_id AS g, event_id AS wid, (epoch_us(ts) // 1000) AS ws, (epoch_us(ts) // 1000) + 7200000 AS wt FROM events WHERE event_type = 'signup'),
s AS (SELECT user_id AS g, event_id AS sid, (epoch_us(ts) // 1000) AS s, (epoch_us(ts) // 1000) + CAST(floor(value) AS BIGINT) * 60000 AS t FROM events WHERE event_type <> 'signup')"""


@query(f"WITH {SPANS} SELECT sid, wid FROM s JOIN w ON s.g = w.g AND s.s >= ws - 50 AND s.t <= wt + 50")
def interval_join_contain(spark, d):
    return pairs.interval_join(user_spans(spark, d), user_windows(spark, d), ["g"], 50).select("sid", "wid")


@query(f"WITH {SPANS} SELECT sid, wid FROM s JOIN w ON s.g = w.g AND s.s <= wt + 50 AND s.t >= ws - 50")
def interval_join_overlap(spark, d):
    return pairs.interval_join(user_spans(spark, d), user_windows(spark, d), ["g"], 50, contained=False).select("sid", "wid")


@query(f"WITH {SPANS}, m AS (SELECT DISTINCT wid FROM s JOIN w ON s.g = w.g AND s.s >= ws - 50 AND s.t <= wt + 50) SELECT count(*) AS samples, count(m.wid) AS aligned, round(count(m.wid) / count(*), 6) AS ratio FROM w LEFT JOIN m USING (wid)")
def alignment_ratio(spark, d):
    w = user_windows(spark, d)
    return rounded(spans.alignment(w, pairs.interval_join(user_spans(spark, d), w, ["g"], 50), "wid"))


@query("""WITH v AS (SELECT user_id AS g, (epoch_us(ts) // 1000) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'view'),
p AS (SELECT user_id AS g, (epoch_us(ts) // 1000) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'purchase'),
x AS (SELECT p.t - v.t AS dt FROM v JOIN p USING (g, k))
SELECT count(*) AS n, round(avg(dt), 3) AS mean, round(stddev_pop(dt), 3) AS sd, min(dt) AS low, max(dt) AS high FROM x""")
def ordinal_match_delta(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("g"), "event_type", millis().alias("t"), "ts", "event_id")
    side = lambda kind: e.where(F.col("event_type") == kind).drop("event_type")
    x = pairs.ordinal_join(side("view"), side("purchase"), ["g"], ["ts", "event_id"]).select((F.col("r_t") - F.col("t")).alias("dt"))
    return rounded(x.agg(F.count("*").alias("n"), F.avg("dt").alias("mean"), F.stddev_pop("dt").alias("sd"), F.min("dt").alias("low"), F.max("dt").alias("high")), 3)


@query("SELECT p_brand AS n, count(*) AS parts FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY p_brand")
def universe_filter_semi(spark, d):
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R'")
    return table(spark, d, "part").join(returned, F.col("p_partkey") == F.col("l_partkey"), "left_semi").groupBy(F.col("p_brand").alias("n")).agg(F.count("*").alias("parts"))


@query("""WITH a AS (SELECT doc_id AS n FROM documents), b AS (SELECT doc_id AS n FROM labels UNION ALL SELECT doc_id FROM labels WHERE toxic = 1 UNION ALL SELECT -1 - item_id FROM benchmark)
SELECT n, 'missing' AS problem FROM a WHERE n NOT IN (SELECT n FROM b) UNION ALL SELECT DISTINCT n, 'extra' FROM b WHERE n NOT IN (SELECT n FROM a) UNION ALL SELECT n, 'duplicate' FROM b GROUP BY n HAVING count(*) > 1""")
def coverage_anti(spark, d):
    labels = table(spark, d, "labels")
    found = labels.select(F.col("doc_id").alias("n")).union(labels.where("toxic = 1").select("doc_id")).union(table(spark, d, "benchmark").select(-1 - F.col("item_id")))
    return structure.coverage(table(spark, d, "documents").select(F.col("doc_id").alias("n")), found)


@query("""WITH b AS (SELECT DISTINCT o_custkey AS n FROM orders WHERE o_orderstatus = 'P'), own AS (SELECT c_custkey AS n, c_nationkey AS p, CASE WHEN c_custkey IN (SELECT n FROM b) THEN c_acctbal END AS v FROM customer),
pk AS (SELECT p, avg(v) AS pv FROM own GROUP BY p), g AS (SELECT avg(v) AS gv FROM own)
SELECT n, round(coalesce(v, pv, gv), 6) + 0.0 AS v, CASE WHEN v IS NOT NULL THEN 'own' WHEN pv IS NOT NULL THEN 'package' ELSE 'all' END AS origin FROM own JOIN pk USING (p), g""")
def fallback_mean_fill(spark, d):
    c = table(spark, d, "customer")
    some = table(spark, d, "orders").where("o_orderstatus = 'P'")
    values = c.join(some, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(F.col("c_custkey").alias("n"), F.col("c_acctbal").alias("v"))
    return rounded(structure.mean_fill(c.select(F.col("c_custkey").alias("n"), F.col("c_nationkey").alias("pkg")), values))


@query("SELECT n, CAST(pos AS INTEGER) AS node_id FROM (SELECT n, row_number() OVER (ORDER BY n) - 1 AS pos FROM (SELECT DISTINCT p_name AS n FROM part))")
def class_dimension(spark, d):
    return maps.class_dim(table(spark, d, "part").select(F.col("p_name").alias("fqcn"))).select(F.col("fqcn").alias("n"), "node_id")


@query("SELECT l_orderkey AS g, list(DISTINCT n ORDER BY n) AS nodes FROM (SELECT l_orderkey, p_brand AS n FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY g")
def trace_node_sets(spark, d):
    return order_items(spark, d).groupBy("g").agg(F.array_sort(F.collect_set("n")).alias("nodes"))


# Text.


@query("SELECT p_partkey AS id, translate(lower(trim(p_name || ' / ' || p_brand || '_(' || p_type || ')')), ' _-/\\:.,()[]{}', '') AS label FROM part")
def label_normalize(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.label_key(F.concat("p_name", F.lit(" / "), "p_brand", F.lit("_("), "p_type", F.lit(")"))).alias("label"))


def camel_name():
    return F.concat(F.upper(F.substring("p_name", 1, 1)), F.replace(F.expr("substring(p_name, 2)"), F.lit(" "), F.lit("")), "p_type", F.lit("Impl2HTTPServer_"), "p_brand")


CAMEL = """x AS (SELECT p_partkey AS id, upper(p_name[1]) || replace(p_name[2:], ' ', '') || p_type || 'Impl2HTTPServer_' || p_brand AS s FROM part)"""


@query(rf"""WITH {CAMEL}, y AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(s, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[_\-0-9]+', ' ', 'g') AS s FROM x)
SELECT id, list_filter(regexp_split_to_array(lower(s), '\s+'), lambda w: w <> '') AS words FROM y""")
def camel_tokens(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.camel_words(camel_name()).alias("words"))


STOP = ", ".join(f"'{w}'" for w in terms.STOPWORDS)
IDF = f"""tok AS (SELECT doc_id AS d, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents),
idf AS (SELECT word, count(DISTINCT d) AS df, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(DISTINCT d))) + 1 AS idf FROM tok WHERE length(word) >= 3 AND word NOT IN ({STOP}) GROUP BY word)"""


@query(f"WITH {IDF} SELECT word, df, round(idf, 6) AS idf FROM idf")
def doc_freq_idf(spark, d):
    return rounded(terms.document_frequency(table(spark, d, "documents").select(F.col("doc_id").alias("d"), "text")))


@query(f"""WITH {IDF}, toks AS (SELECT doc_id AS d, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents), pos AS (SELECT d, unnest(w) AS word, unnest(generate_series(1, len(w))) AS k FROM toks),
body AS (SELECT d, string_agg(word, ' ' ORDER BY k) AS b FROM pos WHERE word IN (SELECT word FROM idf WHERE idf >= 5) GROUP BY d)
SELECT doc_id AS d, trim(source || ' ' || source || ' ' || source || ' ' || coalesce(b, '')) AS distilled FROM documents LEFT JOIN body ON d = doc_id""")
def distilled_text(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("d"), "text", "source")
    return terms.distilled(docs, F.col("source"), 5.0)


@query(f"""WITH {IDF}, b AS (SELECT source AS g, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents),
t AS (SELECT g, word, count(*) AS weight FROM b WHERE length(word) >= 3 AND word NOT IN ({STOP}) GROUP BY ALL)
SELECT * FROM (SELECT g, word, weight, CAST(row_number() OVER (PARTITION BY g ORDER BY weight DESC, word) AS INTEGER) AS rank FROM t) WHERE rank <= 12""")
def keyword_topk(spark, d):
    words = F.filter(text.ascii_words(F.col("text")), lambda w: (F.length(w) >= 3) & ~w.isin(*terms.STOPWORDS))
    return terms.keywords(table(spark, d, "documents").select(F.col("source").alias("g"), F.explode(words).alias("word")).withColumn("weight", F.lit(1).cast("long")))


@query(r"""WITH q AS (SELECT page_id, nullif(regexp_extract(url, '\?([^#]*)', 1), '') AS q FROM pages) SELECT page_id, nullif(split_part(split_part(q, '&', 1), '=', 1), '') AS action FROM q""")
def url_query_action(spark, d):
    q = F.nullif(F.regexp_extract("url", r"\?([^#]*)", 1), F.lit(""))
    return table(spark, d, "pages").select("page_id", text.query_action(q).alias("action"))


@query(r"""WITH q AS (SELECT page_id, regexp_extract(url, '\?([^#]*)', 1) || '&Page=9&flag' AS q FROM pages), p AS (SELECT page_id, unnest(string_split(q, '&')) AS p, unnest(generate_series(1, len(string_split(q, '&')))) AS k FROM q),
e AS (SELECT page_id, lower(split_part(p, '=', 1)) AS key, CASE WHEN contains(p, '=') THEN p[instr(p, '=') + 1:] ELSE '' END AS value, k FROM p WHERE p <> '')
SELECT page_id, key, arg_max(value, k) AS value FROM e GROUP BY ALL""")
def query_params_map(spark, d):
    q = F.concat(F.regexp_extract("url", r"\?([^#]*)", 1), F.lit("&Page=9&flag"))
    return table(spark, d, "pages").select("page_id", F.explode(text.query_params(q)).alias("key", "value"))


@query("SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY k")
def attribute_counts(spark, d):
    return rounded(table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"), F.sum("value").alias("total")), 4)


@query("""WITH x AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages), y AS (SELECT page_id, string_split(host, '.') AS p FROM x),
z AS (SELECT page_id, p, unnest(generate_series(1, len(p))) AS k FROM y), h AS (SELECT page_id, array_to_string(list_reverse(p)[1:k], '.') AS pre, k FROM z),
c AS (SELECT DISTINCT array_to_string(list_reverse(p)[1:2], '.') AS fqcn FROM y) SELECT page_id, arg_max(pre, k) AS fqcn FROM h JOIN c ON pre = fqcn GROUP BY page_id""")
def longest_prefix_match(spark, d):
    host = F.array_join(F.reverse(F.split(F.regexp_extract("url", r"^https?://([^/?#]+)", 1), r"\.")), ".")
    p = table(spark, d, "pages").select("page_id", host.alias("path"))
    found = structure.longest_prefix(p, p.select(text.library_prefix(F.col("path")).alias("fqcn")))
    return p.join(found, "path").select("page_id", "fqcn")


@query("""WITH v AS (SELECT event_id AS id, event_type AS v FROM events), r(kind, pat, node) AS (VALUES ('exact', 'view', 'Catalog'), ('exact', 'error', 'Fault'), ('prefix', 'pur', 'Order'), ('contains', 'i', 'Any'), ('contains', 'ck', 'Input'))
SELECT DISTINCT id, node FROM v JOIN r ON (kind = 'exact' AND v = pat) OR (kind = 'prefix' AND starts_with(v, pat)) OR (kind = 'contains' AND contains(v, pat))""")
def span_rule_resolve(spark, d):
    rules = [("type", "exact", "view", "Catalog"), ("type", "exact", "error", "Fault"), ("type", "prefix", "pur", "Order"), ("type", "contains", "i", "Any"), ("type", "contains", "ck", "Input")]
    values = table(spark, d, "events").select(F.col("event_id").alias("id"), F.lit("type").alias("field"), F.col("event_type").alias("value"))
    return spans.resolve(values, spark.createDataFrame(rules, "field string, kind string, pattern string, node string"))


@query(rf"""WITH {ITEMS}, {jaccard_sql('struct', 'items')}, p AS (SELECT i AS a, j AS b, string_split(i[1:5] || '.' || i[7:7] || '.' || i[8:], '.') AS x, string_split(j[1:5] || '.' || j[7:7] || '.' || j[8:] || '.x', '.') AS y FROM struct_co)
SELECT a, b, len(x) + len(y) - 2 * (SELECT count(*) FROM generate_series(1, least(len(x), len(y))) g(k) WHERE x[1:k] = y[1:k]) AS dist FROM p""")
def package_distance(spark, d):
    """Of brands that meet in orders, as paths of their letters and digits."""
    path = lambda c: F.concat_ws(".", F.substring(c, 1, 5), F.substring(c, 7, 1), F.substring(c, 8, 9))
    return pairs.cooccurrence(order_brands(spark, d)).select(F.col("i").alias("a"), F.col("j").alias("b"), math.package_distance(path("i"), F.concat(path("j"), F.lit(".x"))).cast("long").alias("dist"))


# Normalisation and summaries.


@query(f"WITH {FULL}, t AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(v, 9) DESC, j) AS k FROM fullm WHERE i <> j) SELECT i, j, round(v, 6) AS v FROM t WHERE k <= 4 UNION ALL SELECT i, j, v FROM fullm WHERE i = j")
def row_topk_sparsify(spark, d):
    return rounded(normalize.row_top_k(full(spark, d).withColumn("v", F.round("v", 9)), 4))


@query(f"WITH {FULL}, t AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(v, 9) DESC, j) AS k FROM fullm WHERE i <> j AND v > 0) SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j, round(v, 6) AS v FROM t WHERE k <= 3")
def knn_graph(spark, d):
    return rounded(normalize.knn_graph(full(spark, d).withColumn("v", F.round("v", 9)), 3))


@query(f"WITH {STRUCT} SELECT i, j, round((v - lo) / (hi - lo), 6) AS v FROM struct, (SELECT least(min(v), 1) AS lo, greatest(max(v), 1) AS hi FROM struct)")
def minmax_normalize(spark, d):
    return rounded(normalize.minmax(struct(spark, d), 1.0))


@query(f"WITH {STRUCT}, r AS (SELECT i, j, round(v, 9) AS v FROM struct) SELECT i, j, round((row_number() OVER (ORDER BY v, i, j) - 1) / (count(*) OVER () - 1), 6) AS v FROM r")
def quantile_normalize(spark, d):
    return rounded(normalize.quantile_ranks(struct(spark, d).withColumn("v", F.round("v", 9))))


@query(f"WITH {STRUCT} SELECT i, j, round(least(greatest((v - a) / (b - a), 0), 1), 6) AS v FROM struct, (SELECT quantile_cont(v, 0.05) AS a, quantile_cont(v, 0.95) AS b FROM struct)")
def robust_normalize(spark, d):
    return rounded(normalize.robust(struct(spark, d)))


REFINED = f"""{FULL}, z AS (SELECT i, j, CASE WHEN i = j THEN 1.0 ELSE 1 / (1 + exp(-(least(greatest(v, 0), 1) - avg(v) FILTER (WHERE i <> j) OVER (PARTITION BY i)) / (stddev_pop(v) FILTER (WHERE i <> j) OVER (PARTITION BY i) + 1e-6))) END AS v FROM fullm),
mm AS (SELECT i, j, (v - lo) / (hi - lo) AS v FROM z, (SELECT min(v) AS lo, max(v) AS hi FROM z)),
mv AS (SELECT i, j, 0.5 * least(greatest(v * (0.5 / m), 0), 1) + 0.5 * v AS v FROM mm, (SELECT avg(v) AS m FROM mm)),
refined AS (SELECT least(i, j) AS i, greatest(i, j) AS j, sum(v) / 2 AS v FROM mv WHERE i <> j GROUP BY ALL)"""


@query(f"WITH {REFINED} SELECT i, j, round(v, 6) AS v FROM refined")
def refiner_rescale(spark, d):
    return rounded(normalize.refine(full(spark, d)))


@query(f"""WITH {STRUCT} SELECT count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, round(min(v), 6) AS q0, round(quantile_cont(v, 0.05), 6) AS q5, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50,
round(quantile_cont(v, 0.75), 6) AS q75, round(quantile_cont(v, 0.95), 6) AS q95, round(max(v), 6) AS q100, avg(CASE WHEN v >= 0.5 THEN 1.0 ELSE 0.0 END) AS share_50, avg(CASE WHEN v >= 0.8 THEN 1.0 ELSE 0.0 END) AS share_80, avg(CASE WHEN v >= 0.9 THEN 1.0 ELSE 0.0 END) AS share_90 FROM struct""")
def matrix_summary(spark, d):
    return rounded(normalize.summary(struct(spark, d)))


COSINES = """v AS (SELECT vec_id AS n, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), z AS (SELECT *, sqrt(list_dot_product(e, e)) AS z FROM v),
cs AS (SELECT a.n AS i, b.n AS j, a.label AS li, b.label AS lj, (list_dot_product(a.e, b.e) / (a.z * b.z) + 1) / 2 AS v FROM z a JOIN z b ON a.n < b.n)"""


@query(f"WITH {COSINES}, x AS (SELECT li = lj AS same, CAST(least(floor(round(v, 9) * 60), 59) AS INTEGER) AS bin FROM cs WHERE round(v, 9) BETWEEN 0 AND 1) SELECT same, bin, count(*) AS n, round(count(*) * 60 / sum(count(*)) OVER (PARTITION BY same), 6) AS density FROM x GROUP BY same, bin")
def similarity_histogram(spark, d):
    counts = pairs.cosine_histogram(labelled_vectors(spark, d))
    return rounded(counts.withColumn("density", F.col("n") * 60 / F.sum("n").over(Window.partitionBy("same"))))


def labelled_vectors(spark, d, out=None):
    """Vectors with their labels; those of label `out` get -1."""
    label = F.col("label").cast("long")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("n"), F.col("embedding").alias("e"), (label if out is None else F.when(label == out, -1).otherwise(label)).alias("label"))


INTRA = "round(avg(v) FILTER (WHERE li = lj), 6) AS intra, round(avg(v) FILTER (WHERE li <> lj), 6) AS inter, count(*) FILTER (WHERE li = lj) AS n_intra, count(*) FILTER (WHERE li <> lj) AS n_inter, round(avg(v) FILTER (WHERE li = lj) / avg(v) FILTER (WHERE li <> lj), 6) AS ratio"


@query(f"WITH {COSINES} SELECT {INTRA} FROM cs WHERE li <> 0 AND lj <> 0")
def intra_inter(spark, d):
    return rounded(pairs.cosine_intra_inter(labelled_vectors(spark, d, 0)))


@query(f"WITH {COSINES}, t AS (SELECT i, j, li, lj, CASE WHEN v > 0.55 THEN v ELSE 0 END AS v FROM cs) SELECT {INTRA} FROM t WHERE li <> 0 AND lj <> 0 AND v > 0")
def intra_inter_nz(spark, d):
    both = pairs.cosine_above(labelled_vectors(spark, d, 0), 0.55)
    of = lambda same, c: F.coalesce(F.sum(F.when(F.col("same") == same, F.col(c))), F.lit(0))
    mean = lambda same: F.when(of(same, "n") > 0, of(same, "total") / of(same, "n"))
    out = both.agg(mean(True).alias("intra"), mean(False).alias("inter"), of(True, "n").alias("n_intra"), of(False, "n").alias("n_inter"))
    return rounded(out.withColumn("ratio", F.col("intra") / F.col("inter")))


@query(f"WITH {COSINES} SELECT i, j, round(least(greatest(v * CASE WHEN li < 3 AND lj < 3 THEN 0.6 WHEN li < 3 OR lj < 3 THEN 0.8 ELSE 1 END, 0), 1), 6) AS v FROM cs")
def semantic_deemphasis(spark, d):
    return pairs.cosine_deemphasised(table(spark, d, "embeddings").select(F.col("vec_id").alias("n"), F.col("embedding").alias("e"), (F.col("label") < 3).alias("entity")), digits=6)


@query(f"WITH {MODALITIES} SELECT count(*) FILTER (WHERE d > 1e-12) AS changed, round(sum(d), 6) AS l1, round(sqrt(sum(d * d)), 6) AS l2, round(max(d), 6) AS linf FROM (SELECT abs(coalesce(a.v, 0) - coalesce(b.v, 0)) AS d FROM struct a FULL JOIN temp b ON a.i = b.i AND a.j = b.j)")
def matrix_diff(spark, d):
    return rounded(normalize.difference(struct(spark, d), temp(spark, d)))


# Structure.


EDGES = "ed AS (SELECT p_brand AS s, p_name AS t FROM part), dg AS (SELECT t, count(DISTINCT s) AS deg FROM ed GROUP BY t), nn AS (SELECT count(*) AS nn FROM (SELECT s FROM ed UNION SELECT t FROM ed)), lv AS (SELECT min(deg) AS level FROM (SELECT deg FROM dg ORDER BY deg DESC LIMIT (SELECT greatest(1, ceil(0.05 * nn)) FROM nn))), hw AS (SELECT t, deg, ln((nn + 1.0) / (deg + 1)) / ln(nn + 1.0) AS idf, deg >= level AS is_hub FROM dg, lv, nn)"


def n_names(spark, d):
    e = name_edges(spark, d)
    return e.select("source").union(e.select("target")).distinct().count()


@query(f"WITH {EDGES} SELECT s AS source, t AS target, count(*) AS w FROM ed GROUP BY ALL")
def dep_counts(spark, d):
    return structure.edge_counts(name_edges(spark, d))


@query(f"WITH {EDGES} SELECT t AS n, deg, round(idf, 6) + 0.0 AS idf, is_hub FROM hw")
def degree_hubs(spark, d):
    return rounded(structure.hub_weights(name_edges(spark, d), n_names(spark, d)))


@query(f"WITH {EDGES} SELECT least(s, e.t) AS i, greatest(s, e.t) AS j, round(max(idf), 6) + 0.0 AS v FROM (SELECT DISTINCT * FROM ed) e JOIN hw USING (t) WHERE idf >= 0.12 AND NOT is_hub GROUP BY ALL")
def hub_idf_edges(spark, d):
    return rounded(structure.denoised(name_edges(spark, d), n_names(spark, d)))


CALLS = "cc AS (SELECT c_nationkey AS s, s_nationkey AS t, count(*) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL)"


def calls(spark, d):
    x = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return x.select(F.col("c_nationkey").alias("source"), F.col("s_nationkey").alias("target"))


@query(f"WITH {CALLS}, cr AS (SELECT t, count(*) AS callers FROM cc GROUP BY t) SELECT a.s AS source, a.t AS target, round(a.w * CASE WHEN b.s IS NULL THEN 1e0 ELSE 2e0 END * CASE WHEN callers >= ceil(0.8 * (SELECT count(*) FROM nation)) THEN 2e-1 ELSE 1e0 END, 6) AS w FROM cc a LEFT JOIN cc b ON a.s = b.t AND a.t = b.s JOIN cr ON cr.t = a.t")
def bidirectional_supernode(spark, d):
    return rounded(structure.weighted_calls(calls(spark, d), table(spark, d, "nation").count(), 0.8))


@query(f"WITH {CALLS} SELECT least(s, t) AS i, greatest(s, t) AS j, CAST(sum(w) AS BIGINT) AS w FROM cc GROUP BY ALL")
def call_pairs(spark, d):
    return structure.call_mix(calls(spark, d))


BRIDGES = """us AS (SELECT DISTINCT s_nationkey AS n, l_partkey AS e FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), bp AS (SELECT a.e, a.n AS i, b.n AS j FROM us a JOIN us b ON a.e = b.e AND a.n < b.n),
bk AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY i, j) AS k FROM bp), br AS (SELECT i, j, count(*) AS n FROM bk WHERE k <= 2000 GROUP BY ALL)"""


def uses(spark, d):
    return table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("n"), F.col("l_partkey").alias("entity"))


@query(f"WITH {BRIDGES} SELECT i, j, n FROM br")
def entity_bridging(spark, d):
    return structure.bridges(uses(spark, d))


@query(f"WITH {MODALITIES}, k AS (SELECT i, j FROM sem WHERE v > 0.9) SELECT s.i, s.j, round(s.v * CASE WHEN k.i IS NOT NULL AND s.v > 0 THEN 1.25 ELSE 1 END, 6) AS v FROM struct s LEFT JOIN k ON k.i = s.i AND k.j = s.j")
def edge_boost(spark, d):
    return rounded(structure.boost(struct(spark, d), sem(spark, d).where("v > 0.9"), 0.25))


@query(f"WITH {MODALITIES}, x AS (SELECT i, j FROM struct WHERE v > 0.15), y AS (SELECT i, j FROM sem WHERE v > 0.9) SELECT count(*) AS either, count(*) FILTER (WHERE x.i IS NULL OR y.i IS NULL) AS differ, round(count(*) FILTER (WHERE x.i IS NULL OR y.i IS NULL) / greatest(count(*), 1), 6) AS rate FROM x FULL JOIN y ON x.i = y.i AND x.j = y.j")
def conflict_rate(spark, d):
    return rounded(structure.conflict_rate(struct(spark, d).where("v > 0.15"), sem(spark, d).where("v > 0.9")))


# Fusion and damping.


@query(f"WITH {MODALITIES}, p AS (SELECT i, j, v * 0.6 AS v FROM struct UNION ALL SELECT i, j, v * 0.4 FROM sem) SELECT i, j, round(least(greatest(sum(v), 0), 1), 6) AS v FROM p GROUP BY ALL")
def structural_fusion(spark, d):
    return rounded(fusion.fuse([(struct(spark, d), 0.3), (sem(spark, d), 0.2)]))


TRI = f"{MODALITIES}, p AS (SELECT i, j, v * 0.4 AS v FROM struct UNION ALL SELECT i, j, v * 0.4 FROM sem UNION ALL SELECT i, j, v * 0.2 FROM temp), tri AS (SELECT i, j, least(greatest(sum(v), 0), 1) AS v FROM p GROUP BY ALL)"


def trimodal(s, m, t):
    return fusion.fuse([(s, 0.4), (m, 0.4), (t, 0.2)])


@query(f"WITH {TRI} SELECT i, j, round(v, 6) AS v FROM tri")
def trimodal_fusion(spark, d):
    return rounded(trimodal(struct(spark, d), sem(spark, d), temp(spark, d)))


@query(f"WITH {MODALITIES}, b AS (SELECT coalesce(x.i, y.i) AS i, coalesce(x.j, y.j) AS j, coalesce(x.v, 0) AS a, coalesce(y.v, 0) AS b FROM struct x FULL JOIN sem y ON x.i = y.i AND x.j = y.j) SELECT round(g.k / 10, 6) AS mu, i, j, round(g.k / 10 * a + (1 - g.k / 10) * b, 6) AS v FROM b, generate_series(0, 10) g(k)")
def mu_sweep(spark, d):
    return rounded(fusion.sweep(struct(spark, d), sem(spark, d)))


@query(f"WITH {UNCERTAINTY} SELECT i, j, round(v, 6) + 0.0 AS v FROM u")
def modality_uncertainty(spark, d):
    return rounded(uncertainty(spark, d))


DAMPED = f"""{UNCERTAINTY}, cells AS (SELECT v FROM u UNION ALL SELECT v FROM u UNION ALL SELECT 0 FROM generate_series(1, (SELECT count(DISTINCT p_brand) * count(DISTINCT p_brand) FROM part) - 2 * (SELECT count(*) FROM u))), md AS (SELECT quantile_cont(v, 0.5) AS m FROM cells),
b AS (SELECT s.i, s.j, s.v AS s, coalesce(u.v, 0) AS u, m FROM struct s LEFT JOIN u ON s.i = u.i AND s.j = u.j, md)"""


@query(f"WITH {DAMPED} SELECT i, j, round(s * exp(-2 * u), 6) AS v FROM b")
def uncertainty_exp(spark, d):
    return rounded(fusion.damped(*certainty(spark, d), n_brands(spark, d), "exp"))


@query(f"WITH {DAMPED} SELECT i, j, round(CASE WHEN u >= m THEN s * pow(1 - u, 2) ELSE s * (1 - u) END, 6) + 0.0 AS v FROM b")
def uncertainty_gate(spark, d):
    return rounded(fusion.damped(*certainty(spark, d), n_brands(spark, d), "gate"))


@query(f"WITH {DAMPED} SELECT i, j, round(s * (1 - 1 / (1 + exp(-15 * (u - m)))), 6) AS v FROM b")
def uncertainty_sigmoid(spark, d):
    return rounded(fusion.damped(*certainty(spark, d), n_brands(spark, d), "sigmoid"))


@query(f"WITH {STRUCT}, c AS (SELECT v FROM struct UNION ALL SELECT v FROM struct UNION ALL SELECT 1 FROM generate_series(1, (SELECT count(DISTINCT p_brand) FROM part))) SELECT round(least(quantile_cont(v, 0.7), 0.5), 6) AS tau FROM c WHERE v > 0")
def dpep_threshold(spark, d):
    return rounded(fusion.edge_threshold(struct(spark, d), 0.7, 0.5, n_brands(spark, d)))


@query(f"WITH {DAMPED} SELECT count(*) FILTER (WHERE s > 0.1) AS strong, count(*) FILTER (WHERE s > 0.1 AND s * (1 - 1 / (1 + exp(-15 * (u - m)))) <= 0.7 * s) AS suppressed FROM b")
def suppressed_edges(spark, d):
    s, u = certainty(spark, d)
    return fusion.suppressed(s, fusion.damped(s, u, n_brands(spark, d), "sigmoid"))


@query(f"WITH {UNCERTAINTY}, {TRUTH} SELECT s.i, s.j, round(s.v, 6) AS v, round(u.v, 6) AS u FROM sem s JOIN u ON s.i = u.i AND s.j = u.j JOIN truth a ON a.n = s.i JOIN truth b ON b.n = s.j WHERE s.v > 0.5 AND u.v < 0.9 AND a.c <> b.c ORDER BY round(s.v, 9) DESC, round(u.v, 9), s.i, s.j LIMIT 10")
def boundary_pairs(spark, d):
    return rounded(fusion.boundary_pairs(sem(spark, d), uncertainty(spark, d), brand_truth(spark, d).withColumnRenamed("cluster", "label"), 0.5, 0.9))


@query(f"""WITH {DAMPED}, {TRUTH} SELECT b.i, b.j, CASE WHEN x.c = y.c THEN 'split' ELSE 'merged' END AS change, round(2 * (s - s * exp(-2 * u)) + s + 0.5 * u, 6) AS score FROM b JOIN u uu ON uu.i = b.i AND uu.j = b.j JOIN truth x ON x.n = b.i JOIN truth y ON y.n = b.j JOIN pred p ON p.n = b.i JOIN pred q ON q.n = b.j
WHERE (x.c = y.c) <> (p.c = q.c) ORDER BY round(2 * (s - s * exp(-2 * u)) + s + 0.5 * u, 9) DESC, b.i, b.j LIMIT 10""")
def case_edge(spark, d):
    s, u = certainty(spark, d)
    return rounded(fusion.case_edges(s, fusion.damped(s, u, n_brands(spark, d), "exp"), u, brand_truth(spark, d), brand_pred(spark, d)))


# Clustering quality.


CONT = "ct AS (SELECT vec_id % 7 AS p, label AS t, count(*) AS c FROM embeddings GROUP BY ALL), cp AS (SELECT p, sum(c) AS n FROM ct GROUP BY p), cl AS (SELECT t, sum(c) AS n FROM ct GROUP BY t)"
F1 = "CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END"


@query(f"WITH {CONT}, x AS (SELECT (SELECT sum(c * (c - 1) / 2) FROM ct) AS tp, (SELECT sum(n * (n - 1) / 2) FROM cp) AS pp, (SELECT sum(n * (n - 1) / 2) FROM cl) AS tt), y AS (SELECT tp / pp AS p, tp / tt AS r FROM x) SELECT round(p, 6) AS precision, round(r, 6) AS recall, round({F1}, 6) AS f1 FROM y")
def pairwise_f1(spark, d):
    return rounded(metrics.pairwise_f1(vec_pred(spark, d), vec_truth(spark, d)))


@query(f"WITH {CONT}, y AS (SELECT sum(c * c / cp.n) / sum(c) AS p, sum(c * c / cl.n) / sum(c) AS r FROM ct JOIN cp USING (p) JOIN cl USING (t)) SELECT round(p, 6) AS precision, round(r, 6) AS recall, round({F1}, 6) AS f1 FROM y")
def bcubed(spark, d):
    return rounded(metrics.bcubed(vec_pred(spark, d), vec_truth(spark, d)))


@query("""WITH RECURSIVE c AS (SELECT vec_id % 7 AS p, label AS t, count(*) AS c FROM embeddings WHERE label IS NOT NULL GROUP BY ALL), o AS (SELECT p, row_number() OVER (ORDER BY sum(c) DESC, p) AS k FROM c GROUP BY p), x AS (SELECT k, t, c FROM c JOIN o USING (p)),
r AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS INTEGER[]) AS used, CAST(0 AS HUGEINT) AS kept UNION ALL
  SELECT r.k + 1, list_concat(any_value(r.used), list_filter([arg_min(x.t, (-x.c, x.t)) FILTER (WHERE NOT list_contains(r.used, x.t))], lambda y: y IS NOT NULL)), any_value(r.kept) + coalesce(max(x.c) FILTER (WHERE NOT list_contains(r.used, x.t)), 0)
  FROM r JOIN x ON x.k = r.k + 1 GROUP BY r.k),
n AS (SELECT sum(c) AS n FROM c) SELECT CAST(n - max(kept) AS BIGINT) AS moves, CAST(n AS BIGINT) AS n, round((1 - (n - max(kept)) / n) * 100, 6) AS mojosim FROM r, n GROUP BY n""")
def mojosim(spark, d):
    return rounded(metrics.mojo(vec_pred(spark, d), vec_truth(spark, d)))


@query(f"WITH {NATIONS} SELECT CAST(sum(CASE WHEN cs <> ct THEN w ELSE 0 END) AS DOUBLE) AS ifn, round(count(*) FILTER (WHERE cs <> ct) / count(*), 6) AS icp FROM x")
def ifn_icp(spark, d):
    return rounded(metrics.coupling(nation_deps(spark, d), nation_part(spark, d)))


@query("WITH s AS (SELECT vec_id % 7 AS c, count(*) AS n FROM embeddings GROUP BY c) SELECT count(*) AS k, round(stddev_pop(n) / avg(n), 6) AS ned FROM s")
def ned(spark, d):
    return rounded(metrics.ned(vec_pred(spark, d)))


@query(f"""WITH {NATIONS}, sz AS (SELECT c, count(*) AS n FROM cl GROUP BY c), fl AS (SELECT cs AS c, sum(CASE WHEN cs = ct THEN w ELSE 0 END) AS a, sum(CASE WHEN cs <> ct THEN w ELSE 0 END) AS b FROM x WHERE s <> t GROUP BY cs),
y AS (SELECT CASE WHEN n > 1 THEN coalesce(a, 0) / (n * (n - 1)) ELSE 0 END AS coh, coalesce(b, 0) / (n * ((SELECT count(*) FROM nation) - n)) AS cou FROM sz LEFT JOIN fl USING (c)) SELECT round(avg(coh), 6) AS cohesion, round(avg(cou), 6) AS coupling, round(avg(coh) - avg(cou), 6) AS sm FROM y""")
def structural_modularity(spark, d):
    return rounded(metrics.structural_modularity(nation_deps(spark, d), nation_part(spark, d)))


@query("WITH s AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT count(*) AS k, min(n) AS smallest, CAST(floor(quantile_cont(n, 0.25)) AS INTEGER) AS p25, CAST(floor(quantile_cont(n, 0.5)) AS INTEGER) AS median, CAST(floor(quantile_cont(n, 0.75)) AS INTEGER) AS p75, max(n) AS largest, count(*) FILTER (WHERE n = 1) AS singletons FROM s")
def cluster_sizes(spark, d):
    return metrics.cluster_sizes(vec_truth(spark, d))


@query(f"""WITH {STRUCT}, {TRUTH}, x AS (SELECT v, a.c AS ci, b.c AS cj FROM struct JOIN truth a ON a.n = i JOIN truth b ON b.n = j), e AS (SELECT ci AS c, v, CASE WHEN ci = cj THEN v ELSE 0 END AS s FROM x UNION ALL SELECT cj, v, 0 FROM x),
k AS (SELECT c, sum(v) AS g, sum(s) AS s FROM e GROUP BY c), m AS (SELECT sum(v) AS m, count(*) FILTER (WHERE ci <> cj) AS crossing, count(*) AS edges FROM x) SELECT round(sum(s / m - pow(g / (2 * m), 2)), 6) AS q, max(crossing) AS crossing, max(edges) AS edges FROM k, m""")
def graph_modularity(spark, d):
    return rounded(metrics.modularity(struct(spark, d), brand_truth(spark, d)))


#: The least node within 40 links, round by round; no component of the tables is as wide.
@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, 10000000 + l_partkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e UNION ALL SELECT DISTINCT a, a FROM e UNION ALL SELECT DISTINCT b, b FROM e),
r(k, n, m) AS (SELECT 0, a, a FROM u WHERE a = b UNION ALL SELECT r.k + 1, u.b, min(r.m) FROM r JOIN u ON u.a = r.n WHERE r.k < 40 GROUP BY r.k, u.b) SELECT n AS node, m AS label FROM r WHERE k = 40 AND m <> n""")
def connected_components(spark, d):
    x = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return components.connected_components(x.select(F.col("o_custkey").alias("a"), (F.lit(10_000_000) + F.col("l_partkey")).alias("b")))


@query()
def louvain(spark, d):
    return cluster.swept(normalize.knn_graph(full(spark, d), 4), [1.0])


#: The lines of an order all belong together, so each order is a cluster, whatever way nodes move.
@query("WITH n AS (SELECT DISTINCT l_orderkey AS o, 8 * l_orderkey + l_linenumber AS n FROM lineitem) SELECT n, min(n) OVER (PARTITION BY o) AS cluster FROM n QUALIFY count(*) OVER (PARTITION BY o) > 1")
def louvain_lines(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), (8 * F.col("l_orderkey") + F.col("l_linenumber")).alias("n")).distinct()
    together = pairs.cooccurrence(lines).select("i", "j", F.col("co").cast("double").alias("v"))
    return cluster.swept(together, [1.0]).select("n", "cluster")


@query()
def merge_tiny(spark, d):
    return cluster.swept(normalize.knn_graph(full(spark, d), 4), [2.0], 3)


@query()
def resolution_sweep(spark, d):
    graph = kept(spark, normalize.knn_graph(full(spark, d), 4), "graph")
    return rounded(cluster.best_resolution(graph, kept(spark, cluster.swept(graph, cluster.resolutions(), 3), "parts"), 2, 8))


@query()
def damping_grid(spark, d):
    s, u = certainty(spark, d)
    out = None
    for mode in ("exp", "gate", "sigmoid"):
        part = metrics.modularity(fusion.damped(s, u, n_brands(spark, d), mode), brand_truth(spark, d)).withColumn("mode", F.lit(mode))
        out = part if out is None else out.union(part)
    return rounded(out)


# Sampling.


@query()
def exact_k_drop(spark, d):
    return sampling.drop_exact(order_items(spark, d), "g", 0.4).groupBy("n").agg(F.count("*").alias("c"))


@query()
def item_drop(spark, d):
    return sampling.drop_items(order_items(spark, d), ["g", "n"], 0.4).groupBy("n").agg(F.count("*").alias("c"))


@query()
def uncertainty_shuffle(spark, d):
    return rounded(sampling.shuffled(uncertainty(spark, d)))


@query()
def cold_start(spark, d):
    items, out = kept(spark, order_items(spark, d), "items"), None
    keys = kept(spark, sampling.hashed(items, "g"), "keys")
    for rate in (0.0, 0.2, 0.4, 0.6, 0.8, 0.9):
        left = pairs.jaccard(sampling.drop_exact(items, "g", rate, keys=keys))
        part = normalize.intra_inter(left, brand_truth(spark, d).withColumnRenamed("cluster", "label")).withColumn("rate", F.lit(rate))
        out = part if out is None else out.union(part)
    return rounded(out)


# Reports.


METRICS = "SELECT p_brand AS system, p_type AS method, sum(p_retailprice) AS total, CAST(count(*) AS DOUBLE) AS n FROM part GROUP BY ALL"


def part_metrics(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("system"), F.col("p_type").alias("method")).agg(F.sum("p_retailprice").alias("total"), F.count("*").cast("double").alias("n"))


@query(f"""WITH m AS ({METRICS}), w AS (SELECT system, 'total' AS metric, max(total) FILTER (WHERE method = 'ECONOMY') AS base, max(total) FILTER (WHERE method = 'SMALL') AS new, 1 AS s FROM m GROUP BY system
UNION ALL SELECT system, 'n', max(n) FILTER (WHERE method = 'ECONOMY'), max(n) FILTER (WHERE method = 'SMALL'), -1 FROM m GROUP BY system)
SELECT system, metric, round(base, 4) AS base, round(new, 4) AS new, round(s * (new - base) / abs(base) * 100, 4) + 0.0 AS percent, abs(base) < 0.05 AS small_base FROM w""")
def improvement_table(spark, d):
    return rounded(report.improvements(part_metrics(spark, d), "system", "method", "ECONOMY", "SMALL", {"total": True, "n": False}), 4)


@query(f"WITH m AS ({METRICS}) SELECT coalesce(system, 'ALL') AS system, count(*) AS n, round(avg(total), 4) AS total_mean, round(coalesce(stddev_samp(total), 0), 4) AS total_sd FROM m GROUP BY ROLLUP (system)")
def mean_std_rollup(spark, d):
    return rounded(report.mean_rows(part_metrics(spark, d).drop("n"), "system", ["total"]), 4)


@query(f"""WITH {STRUCT}, {TRUTH}, nb AS (SELECT count(*) * (count(*) - 1) AS cells FROM brands), r AS (SELECT avg(v) FILTER (WHERE a.c = b.c) / avg(v) FILTER (WHERE a.c <> b.c) AS ratio FROM struct JOIN truth a ON a.n = i JOIN truth b ON b.n = j), s AS (SELECT count(*) FILTER (WHERE v > 0) AS edges FROM struct)
SELECT edges, round(2 * edges / cells, 6) AS density, round(ratio, 6) AS ratio, concat_ws(',', CASE WHEN edges < 10 THEN 'edges' END, CASE WHEN 2 * edges / cells < 0.001 THEN 'density' END, CASE WHEN ratio < 1.2 THEN 'ratio' END) AS reasons, CASE WHEN edges < 10 OR 2 * edges / cells < 0.001 OR ratio < 1.2 THEN 'FAIL' ELSE 'PASS' END AS status FROM r, s, nb""")
def gate_report(spark, d):
    s, n = kept(spark, struct(spark, d), "struct"), n_brands(spark, d)
    ratio = normalize.intra_inter(s, brand_truth(spark, d).withColumnRenamed("cluster", "label")).select("ratio")
    stats = s.agg(F.count_if(F.col("v") > 0).alias("edges")).withColumn("density", 2 * F.col("edges") / (n * (n - 1)))
    return rounded(report.gate(stats.join(ratio)))  # one row each


@query("SELECT system, method, round(total, 4) AS total, n FROM (SELECT *, row_number() OVER (PARTITION BY system ORDER BY n DESC, round(total, 4) DESC, method) AS k FROM (" + METRICS + ")) WHERE k = 1")
def best_row(spark, d):
    return report.best(part_metrics(spark, d).withColumn("total", F.round("total", 4)), ["system"], ["n", "total"], "method")


@query()
def matrix_fingerprint(spark, d):
    return maps.fingerprint(struct(spark, d))


#: A list's values, each where it stands first.
FIRSTS = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


@query(f"""WITH e AS (SELECT user_id || ':' || strftime(ts, '%Y-%m-%d') AS w, epoch_us(ts) AS s, epoch_us(ts) + CAST(floor(value) AS BIGINT) AS t, event_id, event_type, json_extract_string(props, '$.k') AS k FROM events),
n AS (SELECT *, CASE WHEN event_type <> 'error' THEN k END AS route, CASE WHEN event_type <> 'view' THEN left(k, 1) END AS scope, event_type || '.' || nullif(k, '1') AS code FROM e),
l AS (SELECT w, count(*) AS n_spans, list(event_type ORDER BY s, t, event_id) AS sv, coalesce(list(route ORDER BY s, t, event_id) FILTER (WHERE route IS NOT NULL), []) AS ro,
  coalesce(list(scope ORDER BY s, t, event_id) FILTER (WHERE scope IS NOT NULL), []) AS sc, coalesce(list(code ORDER BY s, t, event_id) FILTER (WHERE code IS NOT NULL), []) AS co FROM n GROUP BY w)
SELECT w, n_spans, {FIRSTS.format('sv')} AS services, {FIRSTS.format('ro')} AS routes, {FIRSTS.format('sc')} AS scopes, {FIRSTS.format('co')} AS code,
  array_to_string(list_concat({FIRSTS.format('ro')}, {FIRSTS.format('sc')}), '|') AS signature FROM l""")
def call_chain_summary(spark, d):
    k, kind = F.get_json_object("props", "$.k"), F.col("event_type")
    rows = table(spark, d, "events").select(
        F.concat_ws(":", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("w"), micros().alias("start"), (micros() + F.floor("value")).alias("end"), F.col("event_id").alias("span_id"), kind.alias("service"),
        F.when(kind != "error", k).alias("route"), F.when(kind != "view", F.left(k, F.lit(1))).alias("scope"), kind.alias("namespace"), F.when(k != "1", k).alias("function"),
    )
    return spans.call_chains(rows)


CODE = """c AS (SELECT epoch_us(ts) AS s, epoch_us(ts) + CAST(floor(value) AS BIGINT) - 3 AS t, CASE WHEN event_type = 'view' THEN 'N' || CAST(k AS INT) % 40 END AS ns, CASE WHEN event_type IN ('view', 'click') THEN k END AS fn, CASE WHEN event_type = 'signup' AND CAST(k AS INT) > 90 THEN 'C' END AS cl,
  'u' || user_id % 50 AS sv, CASE WHEN CAST(k AS INT) % 2 = 0 THEN event_type END AS sc, k AS ro FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)), g AS (SELECT *, coalesce(ns, fn, cl) IS NOT NULL AS a FROM c WHERE s > 0 AND t > 0 AND t >= s)"""


def code_spans(spark, d):
    k, kind = F.get_json_object("props", "$.k"), F.col("event_type")
    named = {"code.namespace": F.when(kind == "view", F.concat(F.lit("N"), k.cast("int") % 40)), "code.function": F.when(kind.isin("view", "click"), k), "code.class": F.when((kind == "signup") & (k.cast("int") > 90), "C"), "service.name": F.concat(F.lit("u"), F.col("user_id") % 50), "otel.scope.name": F.when(k.cast("int") % 2 == 0, kind), "http.route": k}
    return table(spark, d, "events").select(F.create_map(*(x for c, v in named.items() for x in (F.lit(c), v))).alias("attrs"), micros().alias("start_us"), (micros() + F.floor("value") - 3).alias("end_us"))


@query(f"WITH {CODE} SELECT count(*) AS spans, count(*) FILTER (WHERE a) AS any, count(ns) AS namespace, count(fn) AS function, count(cl) AS class, CAST(0 AS BIGINT) AS method, round(count(*) FILTER (WHERE a) / count(*), 6) AS ratio FROM g")
def code_presence(spark, d):
    return rounded(spans.code_presence(code_spans(spark, d)))


@query(f"""WITH {CODE}, e AS (SELECT 'code.namespace' AS kind, ns AS name FROM g WHERE a AND ns IS NOT NULL UNION ALL SELECT 'service.name', sv FROM g WHERE a UNION ALL SELECT 'otel.scope.name', coalesce(sc, '<missing>') FROM g WHERE a UNION ALL SELECT 'http.route', ro FROM g WHERE a)
SELECT * FROM (SELECT kind, CAST(row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, name) AS INTEGER) AS rank, name, count(*) AS n FROM e GROUP BY kind, name) WHERE rank <= 30""")
def code_tops(spark, d):
    return spans.code_tops(code_spans(spark, d))


@query()
def edl_infer(spark, d):
    s, m, t = struct(spark, d), sem(spark, d), temp(spark, d)
    both = s.select("i", "j", F.col("v").alias("struct")).join(m.select("i", "j", F.col("v").alias("sem")), ["i", "j"], "full").join(t.select("i", "j", F.col("v").alias("temp")), ["i", "j"], "full").fillna(0.0, ["struct", "sem", "temp"])
    part = table(spark, d, "part").select(F.col("p_brand").alias("n"), "p_type")
    cells = part.select("n").distinct().crossJoin(F.broadcast(part.select("p_type").distinct()))  # a handful of types
    counts = cells.join(part.groupBy("n", "p_type").agg(F.count("*").cast("double").alias("c")), ["n", "p_type"], "left").fillna(0.0, ["c"])
    vectors = counts.groupBy("n").agg(F.array_sort(F.collect_list(F.struct("p_type", "c"))).alias("x")).select("n", F.transform("x", lambda y: y["c"]).alias("e"))
    x = edl.pair_features(vectors, both.withColumn("fused", 0.4 * F.col("struct") + 0.4 * F.col("sem") + 0.2 * F.col("temp")))
    truth = brand_truth(spark, d)
    x = x.join(truth.select(F.col("n").alias("i"), F.col("cluster").alias("a")), "i").join(truth.select(F.col("n").alias("j"), F.col("cluster").alias("b")), "j").withColumn("y", (F.col("a") == F.col("b")).cast("int"))
    x = kept(spark, x, "features")
    return rounded(edl.infer(x, edl.train_all(x)), 4)
