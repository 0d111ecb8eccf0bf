"""Case risk: noisy-OR over findings, then the triage rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C


def risk_term(verdict: Column, severity: Column, sim: Column, conf: Column) -> Column:
    """What a finding leaves of the chance that nothing is wrong."""
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in C.RISK_WEIGHT.items() for x in kv]), severity), F.lit(0.3))
    d = F.lit(1.0) - F.least(F.lit(1.0), F.greatest(F.lit(0.0), sim))
    strength = F.when(d > 0, F.least(F.lit(1.0), conf * d)).otherwise(conf * 0.1)
    return (
        F.when(verdict == "MISMATCH", F.greatest(F.lit(0.05), F.lit(1.0) - weight * strength))
        .when(verdict == "LOW_CONFIDENCE", F.greatest(F.lit(0.05), F.lit(1.0) - F.least(F.lit(0.5), conf) * 0.4)).otherwise(F.lit(1.0))
    )


def case_risk(found: DataFrame, cases: DataFrame, cfg: C.Config = C.DEFAULT, **more: Column) -> DataFrame:
    """``case_id, n_findings, risk_score, triage`` for every case of ``cases``; one without findings is GREEN at 0.

    ``found`` may hold matches too, which count for nothing. ``more`` names aggregates over a case's rows of ``found`` to stand beside its
    risk (null for a case without rows), so that what is told of a case needs no second pass.
    """
    v, s = F.col("verdict"), F.col("severity")
    of = lambda c: F.when(v != "MATCH", c)
    per_case = found.groupBy("case_id").agg(
        F.count(of(F.lit(1))).alias("n_findings"), F.product(of(risk_term(v, s, F.col("similarity"), F.col("confidence")))).alias("left"),
        F.bool_or((v == "MISMATCH") & (s == "HIGH") & (F.col("confidence") >= 0.70)).alias("sure_high"), F.bool_or((v == "MISMATCH") & (s == "HIGH")).alias("high"),
        F.bool_or((v == "MISMATCH") & (s == "MEDIUM")).alias("medium"), F.bool_and(of(s.isin("LOW", "INFO") | (v == "MINOR_VARIANT"))).alias("mild"),
        F.bool_and(of(v == "LOW_CONFIDENCE")).alias("unsure"), F.bool_or(v == "MISMATCH").alias("any_mismatch"), *(c.alias(n) for n, c in more.items()),
    )
    base = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(1.0) - F.col("left"))), 3)
    made = lambda risk, triage: F.struct(risk.alias("risk_score"), F.lit(triage).alias("triage"))
    out = (
        F.when(F.col("sure_high"), made(base, "RED")).when(F.col("high"), made(F.greatest(base, F.lit(0.45)), "AMBER")).when(F.col("medium"), made(base, "AMBER"))
        .when(F.col("mild") & ~F.col("any_mismatch"), made(F.least(base, F.lit(0.15)), "GREEN")).when(F.col("unsure"), made(F.greatest(base, F.lit(0.22)), "AMBER"))
        .when(base < cfg.green_max, made(base, "GREEN")).when(base <= cfg.amber_max, made(base, "AMBER")).otherwise(made(base, "RED"))
    )
    scored = per_case.withColumn("o", F.when(F.col("n_findings") > 0, out)).select("case_id", "n_findings", "o.risk_score", "o.triage", *more)
    return cases.select("case_id").distinct().join(scored, "case_id", "left").select("case_id", F.coalesce("n_findings", F.lit(0)).alias("n_findings"), F.coalesce("risk_score", F.lit(0.0)).alias("risk_score"), F.coalesce("triage", F.lit("GREEN")).alias("triage"), *more)


def triage_summary(risks: DataFrame) -> DataFrame:
    return risks.groupBy("triage").agg(F.count(F.lit(1)).alias("n_cases"), F.round(F.avg("risk_score"), 6).alias("avg_risk"), F.max("risk_score").alias("max_risk"), F.sum("n_findings").alias("n_findings"))
