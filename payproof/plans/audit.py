"""The audit of a batch: every control over all documents, a verdict for each, and summaries."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text as T
from ..functions.similarity import jaro_winkler
from ..operators import history, population
from ..operators.rows import PARTS, narrowed, rank, with_findings
from ..policies import HISTORY_RULES
from ..schema import FINDING, columns


@dataclass
class BatchReport:
    """Results and summaries, all lazy.  ``results`` has a row per document; the rest derives from it."""

    results: DataFrame
    benford: DataFrame
    digits: DataFrame
    kept: DataFrame | None = None

    def release(self) -> None:
        """Let go of the rows that were kept between controls."""
        if self.kept is not None:
            self.kept.unpersist()

    def findings(self) -> DataFrame:
        """A row per finding, the worst of a document first."""
        return self.results.select("id", F.posexplode("findings").alias("position", "f")).select("id", "position", "f.*")

    def summary(self) -> DataFrame:
        """One row: documents and how many pass, need review, are blocked."""
        count = lambda v: F.count_if(F.col("verdict") == v).alias(v)
        return self.results.agg(F.count("*").alias("documents"), count("pass"), count("review"), count("blocked"))

    def by_rule(self) -> DataFrame:
        """(rule_id, scope, n): findings per control; a nonconforming population counts once."""
        docs = self.results.select(F.explode("findings.rule_id").alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("n")).withColumn("scope", F.lit("document"))
        whole = self.benford.where("conformity = 'nonconformity'").select(F.lit("P-015").alias("rule_id"), F.lit(1).cast("long").alias("n"), F.lit("population").alias("scope"))
        return docs.unionByName(whole).select("rule_id", "scope", "n")


def verdict(findings: Column) -> Column:
    has = lambda *levels: F.exists(findings, lambda f: f["severity"].isin(*levels))
    return F.when(has("high"), "blocked").when(has("medium", "low"), "review").otherwise("pass")


def worst(findings: Column) -> Column:
    has = lambda level: F.exists(findings, lambda f: f["severity"] == level)
    out = F.when(has("high"), "high")
    for level in ("medium", "low", "info"):
        out = out.when(has(level), level)
    return out


def history_findings(documents: DataFrame, ledger: DataFrame | None, config: Config, today: dt.date, parts: tuple[str, ...] = PARTS) -> tuple[DataFrame, DataFrame]:
    """(id, finding) of the controls that compare documents, and the rows kept for them."""
    kept, priors = history.keyed(documents, ledger, config, today)
    docs = kept.where("named")
    rules = history.RULES if {"related", "evidence"} & {*parts} else history.RULES | {"P-018": partial(history.sequential_numbers, lists=False)}
    return reduce(DataFrame.unionByName, [rule(docs, priors, config).select("id", narrowed(F.col("finding"), parts).alias("finding")) for rule in rules.values()]), kept


def audit_batch(documents: DataFrame, ledger: DataFrame | None = None, config: Config = Config(), today: dt.date | None = None, parts: tuple[str, ...] = PARTS) -> BatchReport:
    """Audit ``documents`` (see schema.DOCUMENT) against each other and a ledger (schema.LEDGER).

    ``today`` is the audit date of documents without one; the clock is read only if it is not given.  The documents' ids
    are taken to be unique (``sources.documents.require_unique`` checks).  ``parts`` are the fields of a finding that are wanted,
    rule_id and severity among them: wordings, evidence and lists of ids that nobody reads are not made.
    """
    today = today or dt.date.today()
    dated = documents.withColumn("today", F.coalesce("today", F.lit(today)))
    rows = with_findings(dated, config, "own", parts).select("id", "input_idx", "vendor", "total", "date", "source", F.coalesce("ingestion_status", F.lit("accepted")).alias("status"), "own")
    compared, kept = history_findings(documents, ledger, config, today, parts)
    shared = compared.groupBy("id").agg(F.collect_list("finding").alias("shared"))
    types = columns(FINDING[len("struct<") : -1].replace(": ", " "))
    none = F.array().cast(f"array<struct<{', '.join(f'{p}: {types[p]}' for p in parts)}>>")
    joined = rows.join(shared, "id", "left")
    found = F.concat(F.col("own"), F.when(F.col("status") == "accepted", F.coalesce("shared", none)).otherwise(none))
    results = joined.withColumn("findings", sorted_findings(found)).select("id", "input_idx", verdict(F.col("findings")).alias("verdict"), worst(F.col("findings")).alias("worst_severity"), "findings", F.array().cast("array<string>").alias("not_evaluated"), "vendor", "total", "date", "source")
    return BatchReport(results, population.benford(documents, config), population.digits(documents, config), kept)


def sorted_findings(findings: Column) -> Column:
    """Worst severity first, then by control.  Maps do not sort, so positions are sorted and findings fetched by them."""
    order = F.array_sort(F.transform(findings, lambda f, i: F.struct((-rank(f["severity"])).alias("k"), f["rule_id"].alias("r"), i.alias("i"))))
    return F.transform(order, lambda o: F.get(findings, o["i"]))


def request_findings(requests: DataFrame, ledger: DataFrame | None, config: Config, today: dt.date) -> DataFrame:
    """The history controls over each request's own priors.

    Requests are kept apart by a tag on the keys that all these controls join on, so one join serves all requests.
    Everything given counts as history: the lookback is as long as dates go.
    """
    past = None
    given = requests.select(F.col("id").alias("request"), F.posexplode("history").alias("at", "p")).select("request", "at", F.col("p.document_id").alias("document_id"), "p.vendor", "p.total", "p.date", "p.invoice_number")
    if ledger is not None:
        named = requests.select(F.col("id").alias("request"), T.vendor_key(F.col("vendor")).alias("_k"))
        past = history.with_keys(ledger.withColumnRenamed("document_id", "id").withColumn("input_idx", F.lit(LEDGER_AT) + F.col("id")))
        rows = ledger.withColumn("_k", T.vendor_key(F.col("vendor"))).join(named, "_k").withColumn("at", F.lit(LEDGER_AT - (1 << 40)) + F.col("document_id"))
        given = given.unionByName(rows.select(given.columns))
    blank = given.withColumn("id", F.col("document_id")).withColumn("input_idx", F.col("at").cast("long") + (1 << 40)).withColumn("today", F.lit(None).cast("date"))
    every = replace(config, lookback_days=100_000)
    docs, _ = history.keyed(requests, None, every, today)
    named = docs.where("named")
    priors = history.with_keys(blank, "request")
    tag = lambda d, of: d.withColumn("key", F.when(F.col("key") != "", F.concat(F.col("key"), F.lit("\n"), F.col(of).cast("string"))).otherwise(""))
    docs, priors = tag(named, "id"), tag(priors, "request").drop("request")
    rules = {k: v for k, v in history.RULES.items() if k != "P-016"}
    found = [rule(docs, priors.unionByName(docs.select(priors.columns)), every) for rule in rules.values()]
    near = near_in_requests(docs, priors.where(F.col("input_idx") < LEDGER_AT), every)
    if past is not None:
        near = near.unionByName(history.near_hits(named, past, every).select(near.columns))
    return reduce(DataFrame.unionByName, [*found, history.near_findings(near, every)])


#: Where ledger rows stand in the order of a request's priors: after all that it brings.
LEDGER_AT = (1 << 40) + (1 << 30)


def near_in_requests(docs: DataFrame, priors: DataFrame, config: Config) -> DataFrame:
    """The near-duplicates among what requests bring themselves: a join on the request instead of on amounts.

    The ledger, which may hold the payment under another spelling, is searched by ``history.near_hits``.
    """
    own = lambda d: d.where("key <> ''").withColumn("request", F.substring_index("key", "\n", -1)).withColumn("name", F.substring_index("key", "\n", 1))
    left, right = own(docs), history.as_prior(own(priors))
    pairs = history.close_pairs(left.join(right, F.col("request") == F.col("p_request")), config).withColumn("sim", jaro_winkler("name", "p_name"))
    return pairs.where(F.col("sim") >= config.near_dup_vendor_similarity).select("id", "total", "date", "anchor", F.col("name").alias("key"), "p_id", "p_input_idx", F.col("p_name").alias("p_key"), "p_total", "p_date", "sim")


def audit_requests(requests: DataFrame, ledger: DataFrame | None = None, config: Config = Config(), today: dt.date | None = None) -> DataFrame:
    """Audit documents that each bring their own ``history`` (array of schema.PRIOR; null: none known).

    The history controls see the given priors in order, then the ledger; where both are absent they are listed in
    not_evaluated.  An empty history is one that was evaluated.
    """
    today = today or dt.date.today()
    dated = requests.withColumn("today", F.coalesce("today", F.lit(today)))
    own = with_findings(dated, config, "own").select("id", "input_idx", "vendor", "total", "date", "source", F.coalesce("ingestion_status", F.lit("accepted")).alias("status"), F.col("history").isNotNull().alias("given"), "own")
    shared = request_findings(requests, ledger, config, today).groupBy("id").agg(F.collect_list("finding").alias("shared"))
    none = F.array().cast(f"array<{FINDING}>")
    joined = own.join(shared, "id", "left")
    found = F.concat(F.col("own"), F.when(F.col("status") == "accepted", F.coalesce("shared", none)).otherwise(none))
    missing = F.when((F.col("status") == "accepted") & ~F.col("given") & F.lit(ledger is None), F.array(*[F.lit(r) for r in HISTORY_RULES])).otherwise(F.array().cast("array<string>"))
    return joined.withColumn("findings", sorted_findings(found)).select("id", verdict(F.col("findings")).alias("verdict"), worst(F.col("findings")).alias("worst_severity"), "findings", missing.alias("not_evaluated"), "vendor", "total", "date", "source")
