"""Payment documents derived from an order database: the specification by which tables become documents to audit.

Orders are documents, customers their suppliers' names, order lines their arithmetic.  All choices depend on the order key by
modulus, so any engine derives the same rows.  Copies of some orders are added as duplicates, shifted, misspelt
and split payments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DOCUMENT, MONEY, columns

#: Words of supplier names, by customer key modulo 12.
WORDS = ("Alder", "Birch", "Cedar", "Delta", "Ember", "Falcon", "Granite", "Harbor", "Indigo", "Juniper", "Krypton", "Lumen")
CENTS = "decimal(18,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(x: Column) -> Column:
    return F.round(x, 2).cast(CENTS)


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per order."""
    orders, customer, nation, lines = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "lineitem"))
    net = F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    sums = lines.groupBy("l_orderkey").agg(F.sum(cents(net)).cast(CENTS).alias("subtotal"), F.sum(cents(net * F.col("l_tax").cast("decimal(4,2)"))).cast(CENTS).alias("linetax"))
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    named = F.concat("n_name", F.lit(" "), "c_mktsegment", F.lit(" "), F.element_at(F.array(*[F.lit(w) for w in WORDS]), (c % 12 + 1).cast("int")), F.when(c % 2 == 0, " Ltd").otherwise(" Limited"))
    vendor = F.when(k % 97 == 3, None).when(k % 200 == 7, F.concat(F.upper(named), F.lit(" ."))).otherwise(named)
    day = F.col("o_orderdate").cast("date")
    whole = F.col("subtotal") + F.col("linetax")
    tens = F.lit("1.10").cast("decimal(4,2)"), F.lit("1.60").cast("decimal(4,2)")
    total = F.when(k % 101 == 6, None).when(k % 50 == 1, F.round(whole * tens[0], 2)).when(k % 53 == 26, F.round(whole * tens[1], 2)).when(k % 40 == 2, F.round(whole / 1000, 0) * 1000).otherwise(whole)
    code = c % 10
    joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).join(nation, customer["c_nationkey"] == nation["n_nationkey"]).join(sums, k == F.col("l_orderkey"), "left")
    return joined.select(
        k.cast("long").alias("id"),
        vendor.alias("vendor"),
        F.when(k % 89 == 5, None).otherwise(day).alias("date"),
        total.cast(MONEY).alias("total"),
        F.col("subtotal").cast(MONEY).alias("subtotal"),
        F.when(k % 3 == 0, None).otherwise(F.col("linetax")).cast(MONEY).alias("tax"),
        F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False).alias("signature_present"),
        (F.lit(0.5) + (k % 50) / F.lit(100.0)).cast("double").alias("confidence"),
        F.concat(F.lit("INV-"), F.lpad((k % 60).cast("string"), 4, "0")).alias("invoice_number"),
        F.when(code == 0, "JPY").when(code == 1, "INR").when(code == 2, "IDR").otherwise("USD").alias("currency"),
        F.date_add(day, (k % 125 - 4).cast("int")).alias("today"),
        F.when(k % 997 == 1, "rejected").otherwise("accepted").alias("ingestion_status"),
        F.when(k % 997 == 1, "blank page").alias("reject_reason"),
    )


def copies(docs: DataFrame) -> DataFrame:
    """Duplicates, shifted dates, misspelt suppliers with slightly other amounts, and payments split below the limit."""
    k = F.col("id")
    number = lambda end: F.concat("invoice_number", F.lit(end)).alias("invoice_number")
    none = F.lit(None)

    def of(rest: int, offset: int, **new: Column) -> DataFrame:
        return docs.where(k % 60 == rest).withColumns({"_k": k, **new}).withColumn("id", F.col("_k") + offset).drop("_k")

    swapped = F.concat(F.substring("vendor", 1, 2), F.substring("vendor", 4, 1), F.substring("vendor", 3, 1), F.expr("substring(vendor, 5)"))
    exact = of(11, 900_000_000, invoice_number=number("-R"))
    shifted = of(12, 910_000_000, invoice_number=number("-S"), date=F.date_add("date", (1 + k % 5).cast("int")))
    variant = of(13, 920_000_000, invoice_number=number("-V"), vendor=swapped, total=F.round(F.col("total") * F.lit("1.002").cast("decimal(4,3)"), 2).cast(MONEY))
    parts = docs.where(k % 60 == 14).withColumn("g", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    parts = parts.withColumns({"total": (9100 + 300 * F.col("g") + k % 90).cast(MONEY), "date": F.date_add("date", 2 * F.col("g")), "subtotal": none.cast(MONEY), "tax": none.cast(MONEY), "invoice_number": none.cast("string")})
    parts = parts.withColumn("id", k + 930_000_000 + 1_000_000 * F.col("g")).drop("g")
    return exact.unionByName(shifted).unionByName(variant).unionByName(parts)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents to audit, as schema.DOCUMENT; the id is the place in the input too."""
    docs = base(spark, sf_dir)
    every = docs.unionByName(copies(docs)).withColumn("input_idx", F.col("id"))
    made = {c: F.col(c) if c in every.columns else F.lit(None) for c in columns(DOCUMENT)}
    return every.select(*[v.cast(t).alias(c) for (c, t), v in zip(columns(DOCUMENT).items(), made.values())])


DOCUMENTS_SQL = """
sums AS (
  SELECT l_orderkey, sum(CAST(round(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))), 2) AS DECIMAL(18,2))) AS subtotal,
    sum(CAST(round(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) * CAST(l_tax AS DECIMAL(4,2)), 2) AS DECIMAL(18,2))) AS linetax
  FROM lineitem GROUP BY 1
), named AS (
  SELECT o_orderkey AS k, c_custkey AS c, CAST(o_orderdate AS DATE) AS day, o_orderstatus AS status,
    n_name || ' ' || c_mktsegment || ' ' || (['Alder','Birch','Cedar','Delta','Ember','Falcon','Granite','Harbor','Indigo','Juniper','Krypton','Lumen'])[c_custkey % 12 + 1] || CASE WHEN c_custkey % 2 = 0 THEN ' Ltd' ELSE ' Limited' END AS v,
    CAST(subtotal AS DECIMAL(18,2)) AS subtotal, CAST(linetax AS DECIMAL(18,2)) AS linetax, CAST(subtotal + linetax AS DECIMAL(18,2)) AS whole
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN sums ON o_orderkey = l_orderkey
), base AS (
  SELECT CAST(k AS BIGINT) AS id,
    CASE WHEN k % 97 = 3 THEN NULL WHEN k % 200 = 7 THEN upper(v) || ' .' ELSE v END AS vendor,
    CASE WHEN k % 89 = 5 THEN NULL ELSE day END AS date,
    CAST(CASE WHEN k % 101 = 6 THEN NULL WHEN k % 50 = 1 THEN round(whole * CAST(1.10 AS DECIMAL(4,2)), 2) WHEN k % 53 = 26 THEN round(whole * CAST(1.60 AS DECIMAL(4,2)), 2)
      WHEN k % 40 = 2 THEN CAST(((CAST(whole * 100 AS BIGINT) + 50000) // 100000) * 1000 AS DECIMAL(18,2)) ELSE whole END AS DECIMAL(18,4)) AS total,
    CAST(subtotal AS DECIMAL(18,4)) AS subtotal,
    CAST(CASE WHEN k % 3 = 0 THEN NULL ELSE linetax END AS DECIMAL(18,4)) AS tax,
    CASE status WHEN 'F' THEN true WHEN 'O' THEN false END AS signature_present,
    0.5 + (k % 50) / 100.0::DOUBLE AS confidence,
    'INV-' || lpad(CAST(k % 60 AS VARCHAR), 4, '0') AS invoice_number,
    CASE c % 10 WHEN 0 THEN 'JPY' WHEN 1 THEN 'INR' WHEN 2 THEN 'IDR' ELSE 'USD' END AS currency,
    day + CAST(k % 125 - 4 AS INTEGER) AS today,
    CASE WHEN k % 997 = 1 THEN 'rejected' ELSE 'accepted' END AS ingestion_status
  FROM named
), docs AS (
  SELECT * FROM base
  UNION ALL SELECT * REPLACE (id + 900000000 AS id, invoice_number || '-R' AS invoice_number) FROM base WHERE id % 60 = 11
  UNION ALL SELECT * REPLACE (id + 910000000 AS id, invoice_number || '-S' AS invoice_number, date + CAST(1 + id % 5 AS INTEGER) AS date) FROM base WHERE id % 60 = 12
  UNION ALL SELECT * REPLACE (id + 920000000 AS id, invoice_number || '-V' AS invoice_number, substr(vendor, 1, 2) || substr(vendor, 4, 1) || substr(vendor, 3, 1) || substr(vendor, 5) AS vendor,
    CAST(round(total * CAST(1.002 AS DECIMAL(4,3)), 2) AS DECIMAL(18,4)) AS total) FROM base WHERE id % 60 = 13
  UNION ALL SELECT * EXCLUDE (g) REPLACE (id + 930000000 + 1000000 * g AS id, NULL AS invoice_number, CAST(9100 + 300 * g + id % 90 AS DECIMAL(18,4)) AS total, date + CAST(2 * g AS INTEGER) AS date,
    NULL AS subtotal, NULL AS tax) FROM base, (SELECT unnest([0, 1, 2]) AS g) WHERE id % 60 = 14
), keyed AS (
  SELECT *, trim(regexp_replace(lower(coalesce(vendor, '')), '[^a-z0-9]+', ' ', 'g')) AS key,
    nullif(upper(regexp_replace(invoice_number, '[^A-Za-z0-9]', '', 'g')), '') AS ikey, today AS anchor
  FROM docs
)"""
