"""Line dedup by content-defined chunks: long repeated runs of lines go, wherever they moved to."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import apart, materialize


def chunks(docs: DataFrame, window: int = 2, one_in: int = 3) -> DataFrame:
    """A row per chunk of two or more lines: (id, t, k, lines): document, text hash, number of the first line, lines.

    A chunk ends after line i where the rolling hash over the hashes of the ``window`` lines up to i is the least of
    ``one_in`` neighbours with i in the middle, and less than those before it.  So ends are two or more lines apart, and one in
    ``one_in`` lines is an end.  There is no end after the first line or before the last one: every line of a text of two
    or more lines is in such a chunk.  Boundaries depend on nearby lines alone, so lines put in or taken out elsewhere do not
    move them.
    """
    d = docs.select("id", "t", F.split("text", "\n").alias("lines"))
    d = d.withColumn("h", F.transform("lines", lambda s: F.xxhash64(s)))
    n, near = F.size("lines"), range(1, max(1, one_in // 2) + 1)
    d = d.withColumn("r", F.transform("h", lambda _, i: F.xxhash64(*[F.get("h", i - k) for k in range(window)])))
    before = lambda i, k: F.get("r", i - k).isNull() | (F.get("r", i) < F.get("r", i - k))
    after = lambda i, k: F.get("r", i + k).isNull() | (F.get("r", i) <= F.get("r", i + k))
    least = lambda i: reduce(and_, [f(i, k) for f in (before, after) for k in near])
    last = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == n - 1) | ((i > 0) & (i < n - 2) & least(i)))
    d = d.select("id", "t", "lines", last.alias("last"))
    parts = F.transform("last", lambda e, j: F.struct(F.coalesce(F.get(F.col("last"), j - 1) + 1, F.lit(0)).alias("k"), e.alias("e")))
    d = d.select("id", "t", "lines", F.explode(F.filter(parts, lambda p: p["e"] > p["k"])).alias("p"))
    return d.select("id", "t", F.col("p.k").alias("k"), F.slice("lines", F.col("p.k") + 1, F.col("p.e") - F.col("p.k") + 1).alias("lines"))


def chunk_text(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def repeated_chunks(docs: DataFrame, window: int = 2, one_in: int = 3) -> DataFrame:
    """(id, t, cuts): for documents (id, t, text) with chunks to remove, the first line and number of lines of each.

    A chunk is removed if the same lines, byte by byte, are a chunk of an earlier place: a smaller (id, t, k).  Hashes find
    the candidates and their first places by an aggregate with map-side minima; only candidates' texts, repeated rows
    once, are then shuffled to be compared.  What is joined on a chunk is a written table on both sides, so that Spark may
    split a chunk that very many documents share.
    """
    every = chunks(docs, window, one_in).select("id", "t", "k", F.xxhash64(chunk_text(F.col("lines")), F.size("lines")).alias("h"), F.length(chunk_text(F.col("lines"))).alias("n"))
    every = materialize(every)
    place = F.struct("id", "t", "k")
    first = materialize(every.groupBy("h", "n").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("h", "n", "first"))
    again = every.join(first, ["h", "n"]).groupBy("id", "t").agg(F.collect_set(F.struct("k", "h", "n", "first")).alias("found"))
    texts = chunks(docs.join(again.select("id", "t"), ["id", "t"], "left_semi").dropDuplicates(["id", "t"]), window, one_in)
    held = materialize(texts.withColumn("text", chunk_text(F.col("lines"))).select("id", "t", "k", F.size("lines").alias("m"), "text").join(again.select("id", "t", F.explode("found").alias("f")).select("id", "t", "f.*"), ["id", "t", "k"]))
    origin = held.where(F.struct("id", "t", "k") == F.col("first")).select("h", "n", F.col("text").alias("original"))
    same = held.where(F.struct("id", "t", "k") != F.col("first")).join(origin, ["h", "n"]).where(F.col("text") == F.col("original"))
    return same.select("id", "t", F.struct("k", "m").alias("cut")).groupBy("id", "t").agg(F.collect_set("cut").alias("cuts"))


@apart("doc_id", "text")
def dedup_lines(docs: DataFrame, window: int = 2, one_in: int = 3) -> DataFrame:
    """``docs`` with globally repeated chunks of two or more lines taken out of ``text``; two more columns tell how many
    lines (``n_lines_removed``) and characters (``n_chars_removed``, line ends included) went.

    The first place of a chunk, by doc_id, text hash and line, keeps it.  Rows that agree on doc_id and text are one
    document and keep or lose the same lines.  Null texts stay null, empty ones empty; a null doc_id comes before all
    others; a document may become empty, and stays; other columns are passed through; no rows give no rows.
    """
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    keyed = docs.withColumn("_id", id_).withColumn("_t", F.xxhash64(F.coalesce("text", F.lit(""))))
    texts = keyed.where("text is not null").select(F.col("_id").alias("id"), F.col("_t").alias("t"), "text")
    cuts = repeated_chunks(texts, window, one_in).select(F.col("id").alias("_id"), F.col("t").alias("_t"), "cuts")
    joined = keyed.join(cuts, ["_id", "_t"], "left")
    kept = F.filter(F.split("text", "\n"), lambda s, i: ~F.exists(F.col("cuts"), lambda c: (i >= c["k"]) & (i < c["k"] + c["m"])))
    text = F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    gone = F.coalesce(F.aggregate("cuts", F.lit(0), lambda a, c: a + c["m"]), F.lit(0))
    out = joined.withColumn("_new", text)
    lost = F.coalesce(F.length("text") - F.length("_new"), F.lit(0))
    return out.select(*[F.col("_new").alias("text") if c == "text" else F.col(c) for c in docs.columns], gone.cast("long").alias("n_lines_removed"), lost.cast("long").alias("n_chars_removed"))
