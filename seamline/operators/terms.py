"""Terms of texts: frequencies, distillation, keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from seamline.functions.text import ascii_words
from seamline.functions.words import stopwords

STOPWORDS = stopwords()


def document_frequency(docs: DataFrame, least_length: int = 3) -> DataFrame:
    """word, df, idf = ln((1 + N) / (1 + df)) + 1 over docs (d, text): one count a document, short words and stopwords left out."""
    n = docs.agg(F.count("*").alias("total"))
    words = F.filter(F.array_distinct(ascii_words(F.col("text"))), lambda w: (F.length(w) >= least_length) & ~w.isin(*STOPWORDS))
    df = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n)).select("word", "df", (F.log((1.0 + F.col("total")) / (1.0 + F.col("df"))) + 1).alias("idf"))  # one row


def distilled(docs: DataFrame, names: Column, least_idf: float = 1.35, most: int = 20_000, methods: Column | None = None, times: tuple[int, int] = (3, 2)) -> DataFrame:
    """d, distilled: the name's words three times and the method's twice (`times`), then the text's words with an inverse frequency of at least least_idf, in order. docs: d, text.

    The legacy form is times=(1, 1) and least_idf=0.

    A word below the limit stands in a share exp(1 - least_idf) of all documents or more, so there are few such words whatever the corpus: they are known to each task and
    filtered out where the text lies. Only if there are over `most` of them are words and their places joined with the frequencies.
    """
    idf = document_frequency(docs.select("d", "text"))
    title = F.repeat(F.concat(names, F.lit(" ")), F.lit(times[0]))
    if methods is not None:
        title = F.concat(title, F.repeat(F.concat(methods, F.lit(" ")), F.lit(times[1])))
    common = [r["word"] for r in idf.where(F.col("idf") < least_idf).select("word").limit(most + 1).collect()]
    if len(common) <= most:
        rare = lambda w: (F.length(w) >= 3) & ~w.isin(*STOPWORDS, *common)
        return docs.select("d", F.trim(F.concat(title, F.coalesce(F.array_join(F.filter(ascii_words(F.col("text")), rare), " "), F.lit("")))).alias("distilled"))
    idf = idf.where(F.col("idf") >= least_idf).select("word")
    words = docs.select("d", F.posexplode(ascii_words(F.col("text"))).alias("k", "word"))
    kept = words.join(idf, "word").groupBy("d").agg(F.array_sort(F.collect_list(F.struct("k", "word"))).alias("w"))
    body = F.array_join(F.transform("w", lambda x: x["word"]), " ")
    return docs.select("d", title.alias("title")).join(kept, "d", "left").select("d", F.trim(F.concat("title", F.coalesce(body, F.lit("")))).alias("distilled"))


def keywords(bags: DataFrame, k: int = 12) -> DataFrame:
    """g, word, weight, rank: the k heaviest words of each group; ties by word. bags: g, word, weight."""
    total = bags.groupBy("g", "word").agg(F.sum("weight").alias("weight"))
    nth = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("weight"), "word"))
    return total.withColumn("rank", nth).where(F.col("rank") <= k)


def mean_max(vectors: DataFrame) -> DataFrame:
    """g, k, v: (mean + maximum) / 2 of each component over the vectors of a group. vectors: g, e (array)."""
    return vectors.select("g", F.posexplode("e").alias("k", "x")).groupBy("g", "k").agg(((F.avg("x") + F.max("x")) / 2).alias("v"))


def hashed_vectors(docs: DataFrame, dim: int = 64) -> DataFrame:
    """d, e: a text as an array of word counts by hash, of unit length; stands in for a language model's encoder. docs: d, text."""
    cell = F.transform(ascii_words(F.col("text")), lambda w: F.pmod(F.xxhash64(w), F.lit(dim)))
    counts = docs.select("d", F.explode(cell).alias("c")).groupBy("d", "c").agg(F.count("*").alias("n"))
    table = counts.groupBy("d").agg(F.map_from_entries(F.collect_list(F.struct("c", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("z"))
    return table.select("d", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.coalesce(F.col("m")[k.cast("long")], F.lit(0)) / F.col("z")).alias("e"))


def learned_vectors(docs: DataFrame, dim: int = 64, cells: int = 512) -> DataFrame:
    """d, e: a text as its place along the `dim` principal directions of all texts' weighted words, of unit length; an encoder learnt from the corpus. docs: d, text.

    Words (three letters or more, no stopwords) are counted in hashed cells, weighted by inverse document frequency and brought to unit length. What goes to the driver is the cells x cells covariance,
    summed up by partitions. Words that stand together in the corpus point the same way, so texts about one thing are near even without a word in common. Texts without words, and all texts where there are fewer than two, are zero vectors.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    words = F.filter(ascii_words(F.coalesce("text", F.lit(""))), lambda w: (F.length(w) >= 3) & ~w.isin(*STOPWORDS))
    rows = docs.select("d", words.alias("words"))
    zero = F.array_repeat(F.lit(0.0), dim)
    if len(rows.limit(2).collect()) < 2:
        return rows.select("d", zero.alias("e"))
    steps = [HashingTF(numFeatures=cells, inputCol="words", outputCol="counts"), IDF(inputCol="counts", outputCol="weighed"), Normalizer(inputCol="weighed", outputCol="unit"), PCA(k=dim, inputCol="unit", outputCol="place")]
    place = Pipeline(stages=steps).fit(rows).transform(rows).select("d", vector_to_array("place").alias("e"))
    length = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x))
    return place.withColumn("z", length).select("d", F.when(F.col("z") > 1e-12, F.transform("e", lambda x: x / F.col("z"))).otherwise(zero).alias("e"))
