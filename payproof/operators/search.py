"""TF-IDF search over the written controls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import search_terms


def policy_terms(policies: DataFrame) -> DataFrame:
    """(doc, term): title and tags three times, category twice, text once."""
    three = lambda c: [search_terms(F.col(c))] * 3
    return policies.select(F.col("policy_id").alias("doc"), F.explode(F.concat(*three("title"), *three("tags"), *[search_terms(F.col("category"))] * 2, search_terms(F.col("text")))).alias("term"))


def vectors(terms: DataFrame, idf: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(doc, term, w): (1 + ln tf) * (ln((n + 1) / (df + 1)) + 1), to unit length."""
    tf = terms.groupBy("doc", "term").agg(F.count("*").alias("tf")).join(idf, "term", "left").crossJoin(F.broadcast(n_docs))  # one row
    raw = tf.withColumn("w", (1 + F.log("tf")) * (F.log((F.col("n_docs") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1))
    return raw.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("doc")))).select("doc", "term", "w")


def search(queries: DataFrame, policies: DataFrame, k: int = 3, min_score: float = 0.01) -> DataFrame:
    """(query_id, policy_id, score, place) of the ``k`` best controls per query (query_id, query), ties by id.

    Terms of a query are joined on the terms of controls, of which there are a few hundred.  Queries without a term give no
    row.
    """
    terms = policy_terms(policies)
    idf = terms.distinct().groupBy("term").agg(F.count("*").alias("df"))
    n = policies.agg(F.count("*").alias("n_docs"))
    own = vectors(terms, idf, n)
    asked = vectors(queries.select(F.col("query_id").alias("doc"), F.explode(search_terms(F.col("query"))).alias("term")), idf, n)
    scored = asked.select(F.col("doc").alias("query_id"), "term", F.col("w").alias("q")).join(own, "term").groupBy("query_id", F.col("doc").alias("policy_id")).agg(F.sum(F.col("q") * F.col("w")).alias("score")).where(F.col("score") > min_score)
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "policy_id"))
    return scored.withColumn("place", place).where(F.col("place") <= k)
