"""Evaluation against ground truth and two simple baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import cer


def common_fields(pairs: DataFrame, fields: DataFrame) -> DataFrame:
    """Fields that both documents of a pair have: ``case_id, doc_a, doc_b, field, raw_a, raw_b``."""
    a = fields.select(F.col("case_id").alias("ca"), F.col("doc_id").alias("da"), F.col("field"), F.col("value_raw").alias("raw_a"))
    b = fields.select(F.col("case_id").alias("cb"), F.col("doc_id").alias("db"), F.col("field").alias("fb"), F.col("value_raw").alias("raw_b"))
    left = pairs.join(a, (pairs.case_id == a.ca) & (pairs.doc_a == a.da))
    return left.join(b, (left.case_id == b.cb) & (left.doc_b == b.db) & (left.field == b.fb)).select("case_id", "doc_a", "doc_b", "field", "raw_a", "raw_b")


def naive_flags(common: DataFrame) -> DataFrame:
    """Any raw difference is an error."""
    return common.filter(F.trim("raw_a") != F.trim("raw_b"))


def edit_flags(common: DataFrame, most: float = 0.15) -> DataFrame:
    """A character error rate above ``most`` is an error."""
    return common.withColumn("cer", cer(F.lower("raw_a"), F.lower("raw_b"))).filter(F.col("cer") > most)


def flags(common: DataFrame, most: float = 0.15) -> DataFrame:
    """``method, case_id, field`` of both baselines in one pass."""
    method = F.array_compact(F.array(F.when(F.trim("raw_a") != F.trim("raw_b"), "naive"), F.when(cer(F.lower("raw_a"), F.lower("raw_b")) > most, "edit")))
    return common.select(F.explode(method).alias("method"), "case_id", "field")


def full_flags(findings: DataFrame) -> DataFrame:
    """What the whole method flags: findings that are real mismatches."""
    return findings.filter("verdict = 'MISMATCH'").select(F.lit("full").alias("method"), "case_id", "field")


def split_degraded(cases: DataFrame, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """Cases without and with degraded scans: ``n_degraded`` below ``least``, or not."""
    bad = F.coalesce(F.col("n_degraded"), F.lit(0)) >= least
    return cases.filter(~bad), cases.filter(bad)


def extraction(truth: DataFrame, fields: DataFrame) -> DataFrame:
    """Truth beside what was extracted, by document id or else file name: ``cer`` and ``exact`` (at most .05)."""
    f = fields.select("case_id", F.col("doc_id").alias("of"), F.col("field").alias("ff"), F.col("value_raw").alias("found"))
    hit = truth.join(f, (truth.case_id == f.case_id) & ((truth.doc_key == f.of)) & (truth.field == f.ff), "left").select(truth["*"], "found")
    by_name = f.select(F.col("case_id").alias("c2"), F.col("of").alias("of2"), F.col("ff").alias("ff2"), F.col("found").alias("found2"))
    both = hit.join(by_name, (hit.case_id == by_name.c2) & (hit.filename == by_name.of2) & (hit.field == by_name.ff2), "left")
    return both.withColumn("found", F.coalesce("found", "found2", F.lit(""))).drop("c2", "of2", "ff2", "found2").withColumn("cer", cer(F.col("value"), F.col("found"))).withColumn("exact", F.col("cer") <= 0.05)


METHODS = ("naive", "edit", "full")


def counts(injected: DataFrame, flagged: DataFrame, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """Per ``method``: errors found and missed, and benign changes that were flagged. ``injected``: case, field, kind."""
    keys = flagged.select("method", "case_id", "field").distinct()
    per = injected.withColumn("method", F.explode(F.array(*map(F.lit, methods))))
    hit = per.join(keys.withColumn("hit", F.lit(1)), ["method", "case_id", "field"], "left")
    e, h = F.col("kind") == "error", F.col("hit").isNotNull()
    return hit.groupBy("method").agg(F.count_if(e & h).alias("tp"), F.count_if(e & ~h).alias("fn"), F.count_if(~e & h).alias("fp"), F.count_if(~e).alias("benign"))


def derived(c: DataFrame) -> DataFrame:
    """Precision, recall, F1 and the benign false-positive rate, with guards against empty sets."""
    at_least = lambda x: F.greatest(F.lit(1), x)
    p, r = F.col("tp") / at_least(F.col("tp") + F.col("fp")), F.col("tp") / at_least(F.col("tp") + F.col("fn"))
    out = c.withColumn("p", p).withColumn("r", r)
    f1: Column = F.col("p") * 2 * F.col("r") / F.greatest(F.lit(0.001), F.col("p") + F.col("r"))
    return out.select("method", "tp", "fp", "fn", "benign", F.round("p", 3).alias("precision"), F.round("r", 3).alias("recall"), F.round(f1, 3).alias("f1"), F.round(F.col("fp") / at_least(F.col("benign")), 3).alias("fpr"))
