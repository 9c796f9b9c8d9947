"""The registered queries over the corpus tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seamline.llm import audit, chat, line_dedup, mixing, packing, pii, quality, repetition, simhash, substring, toxicity, va_topk, whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> dict:
    """The public tokenizer's files and settings: the same vocabulary for two libraries."""
    import public_tokenizers as public

    return {"json_path": public.path("byte_bpe_50k.json"), "ranks_path": public.path("byte_bpe_50k.tiktoken"), "pattern": public.PATTERN, "special": {"<|endoftext|>": 50256}}


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return va_topk.top_k(vectors, vectors.where("vec_id % 20 = 0"))


OP1 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""


def op2_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(table(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(both).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = chat.read_back(chat.chat_windows(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.array_join("loss", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha256(said).alias("turns_sha256"), F.length(masked).cast("long").alias("loss_chars"), sha256(masked).alias("loss_sha256"), "formatted_chars")


OP3 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS nth,
        '<turn ' || replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</turn>' || chr(10) AS piece FROM c),
a AS (SELECT *, CAST(ceil(strlen(piece) / 4.0) AS BIGINT) AS tokens, nth = 1 AND role = 'system' AS sys FROM e),
b AS (SELECT *, 768 - max(CASE WHEN sys THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id) AS room, greatest(1, (768 - max(CASE WHEN sys THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id)) // 2) AS half,
        sum(CASE WHEN sys THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY nth) AS total FROM a),
d AS (SELECT *, floor((total - 1) / half) AS step, NOT sys AND tokens > half AS big FROM b),
f AS (SELECT *, CASE WHEN NOT sys AND NOT coalesce(lag(sys) OVER o, true) AND (step <> lag(step) OVER o OR big OR lag(big) OVER o) THEN 1 ELSE 0 END AS starts FROM d WINDOW o AS (PARTITION BY conv_id ORDER BY nth)),
f1 AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY conv_id ORDER BY nth) AS BIGINT) AS part FROM f),
f2 AS (SELECT *, CASE WHEN part % 2 = 1 AND sum(CASE WHEN sys THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id, part // 2) <= room THEN 0 ELSE starts END AS st FROM f1),
g AS (SELECT *, sum(st) OVER (PARTITION BY conv_id ORDER BY nth) AS w, 1 + sum(st) OVER (PARTITION BY conv_id) AS ws FROM f2),
h AS (SELECT *, max(total) OVER (PARTITION BY conv_id, w) - total + tokens AS tail FROM g)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(piece) * CASE WHEN sys THEN ws WHEN tail <= 256 AND w + 1 < ws THEN 2 ELSE 1 END) AS BIGINT) AS formatted_chars
FROM h GROUP BY conv_id
"""


#: The key of the registered query, open to all; who publishes pseudonyms sets one of their own in the session.
OPEN_KEY = "an open key for tests"


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), spark.conf.get("spark.seamline.pii.key", OPEN_KEY)).select("doc_id", "text", "n_replaced")


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "n_lines", "n_removed")


#: Windows are compared by their text here. Lines are trimmed of the blanks [ \t\r\v\f].
LINES_CUT = r"""
l AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS line, trim(string_split(text, chr(10))[i], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t
      FROM {docs} d, generate_series(1, len(string_split(text, chr(10)))) g(i)),
w AS (SELECT doc_id, i AS a, lead(i, 2) OVER o AS b, t || chr(10) || lead(t) OVER o || chr(10) || lead(t, 2) OVER o AS k FROM l WHERE t <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, a) AS nth FROM w WHERE b IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(a, b)) AS i FROM r WHERE nth > 1),
cut AS (SELECT l.doc_id, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE gone.i IS NULL), '') AS text,
          CAST(count(*) AS INTEGER) AS n_lines, CAST(count(gone.i) AS INTEGER) AS n_removed FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i GROUP BY l.doc_id)
"""
OP5 = f"""
WITH {LINES_CUT.format(docs="documents")}
SELECT doc_id, cut.text AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed FROM documents LEFT JOIN cut USING (doc_id)
"""


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", sha256(F.col("kept")).alias("kept_sha256"))


OP8 = r"""
WITH d AS (SELECT doc_id, CASE WHEN text IS NULL THEN CAST([] AS VARCHAR[]) ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS w FROM documents),
g AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM g),
low AS (SELECT s, min(doc_id) AS first FROM k GROUP BY s HAVING count(DISTINCT doc_id) > 1),
hit AS (SELECT k.doc_id, k.i FROM k JOIN low ON k.s = low.s AND k.doc_id > low.first),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS p FROM hit),
words AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM d),
kept AS (SELECT words.doc_id, count(gone.p) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY words.p) FILTER (WHERE gone.p IS NULL), '') AS text
         FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, placed = packing.pack_tables(table(spark, sf_dir, "documents"), **tokenizer())
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    whitened = whiten.whitened(table(spark, sf_dir, "embeddings"))
    return whitened.select("vec_id", "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", "identity_error")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13 = r"""
WITH l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
d AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
        100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false) AS e FROM t LEFT JOIN l ON t.doc_id = l.doc_id),
m AS (SELECT part, good, toxic, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n FROM d GROUP BY ALL),
f AS (SELECT chr(CAST(65 + i AS INTEGER)) AS letter, CAST(1 << i AS INTEGER) AS bit FROM range(5) r(i)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, unnest([1, 2, 3, 4, 5]) AS step, unnest([a.bit, b.bit, c.bit, d.bit, e.bit]) AS bit,
        unnest([0, a.bit, a.bit + b.bit, a.bit + b.bit + c.bit, 31 - e.bit]) AS before
      FROM f a JOIN f b ON a.letter <> b.letter JOIN f c ON c.letter NOT IN (a.letter, b.letter) JOIN f d ON d.letter NOT IN (a.letter, b.letter, c.letter) JOIN f e ON e.letter NOT IN (a.letter, b.letter, c.letter, d.letter)),
s AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (bit | before) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN good AND mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN toxic AND mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS toxic_lost
      FROM m CROSS JOIN o GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM s
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_topk, op2_repetition, op3_chat, op4_pii, op5_lines, op6_mix, op7_quality, op8_substring, op9_packing, op10_simhash, op11_whiten, op12_toxicity, op13_audit, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op1_topk": OP1, "op3_chat": OP3, "op5_lines": OP5, "op8_substring": OP8, "op13_audit": OP13}
