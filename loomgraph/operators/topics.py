"""Topic terms: n-gram document frequencies, rare-first topics, boolean queries, class terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ngrams(text: Column, longest: int = 3) -> Column:
    """All word n-grams of lower-cased words of two or more characters, n from 1 to `longest`.

    Longer ones are made by zipping shorter ones with the words further on: an index into the
    array inside a lambda would have the words extracted anew for every element.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    grams = out = words
    for n in range(2, longest + 1):
        later = F.slice(words, n, F.greatest(F.lit(0), F.size(words) - n + 1))
        grams = F.filter(F.zip_with(grams, later, lambda x, y: F.concat(x, F.lit(" "), y)), lambda g: g.isNotNull())
        out = F.concat(out, grams)
    return out


def term_frequencies(docs: DataFrame, text: str, longest: int = 3, min_df: int = 2, max_df: float = 0.85) -> DataFrame:
    """(term, documents): terms that min_df documents at least and a share max_df of all at most hold."""
    n = docs.count()
    terms = docs.select(F.explode(F.array_distinct(ngrams(F.col(text), longest))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("documents")).where((F.col("documents") >= min_df) & (F.col("documents") <= F.lit(max_df * n)))


def rare_first(df: DataFrame, topic: str = "topic", least: int = 1) -> DataFrame:
    """(topic, count) of real topics (not -1) with `least` rows at least, rarest first."""
    return df.where(F.col(topic) != -1).groupBy(topic).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= least).orderBy("count", topic)


def class_terms(docs: DataFrame, topic: str, text: str, k: int = 15, longest: int = 1) -> DataFrame:
    """(topic, rank, term, weight): each topic's k terms of greatest class-based tf-idf."""
    counts = docs.select(topic, F.explode(ngrams(F.col(text), longest)).alias("term")).groupBy(topic, "term").agg(F.count(F.lit(1)).alias("n"))
    by_term = counts.groupBy("term").agg(F.sum("n").alias("all_n"))
    by_topic = counts.groupBy(topic).agg(F.sum("n").alias("topic_n"))
    mean = by_topic.agg(F.avg("topic_n").alias("mean_n"))
    scored = counts.join(by_term, "term").join(by_topic, topic).join(F.broadcast(mean)).withColumn("weight", F.col("n") / F.col("topic_n") * F.log1p(F.col("mean_n") / F.col("all_n")))
    order = Window.partitionBy(topic).orderBy(F.desc("weight"), "term")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(topic, "rank", "term", "weight")


def boolean_query(terms: Column, k: int = 5, anchor: str = "") -> Column:
    """The first k terms, quoted and joined by OR, with an anchor term joined by AND."""
    joined = F.array_join(F.transform(F.slice(terms, 1, k), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")
    return F.concat(F.lit(f'("{anchor}") AND (' if anchor else "("), joined, F.lit(")"))


def vector_topics(df: DataFrame, vector: str, k: int, seed: int = 42) -> DataFrame:
    """df with `topic`, clusters of its vectors by k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = df.withColumn("__v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    model = KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="topic").fit(data)
    return model.transform(data).drop("__v")
