"""What each step did, as trace rows and as metrics of the run itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

TRACE = ("case_id", "step", "doc_id", "tool", "args_summary", "result_summary")


def _step(df: DataFrame, step: int, doc: Column, tool: str, args: Column, result: Column) -> DataFrame:
    return df.select("case_id", F.lit(step).alias("step"), doc.alias("doc_id"), F.lit(tool).alias("tool"), args.alias("args_summary"), result.alias("result_summary"))


def extraction_steps(docs: DataFrame) -> DataFrame:
    """One row a document of ``extract.read_pages``: its tokens and the fields found, in the order in which they were found."""
    names = F.transform("fields", lambda f: f["field"])
    return _step(docs, 1, F.col("doc_id"), "extract_fields", F.format_string("doc_id=%s, tokens=%d", "doc_id", "n_tokens"), F.format_string("Found %d fields (%s)", F.size("fields"), F.array_join(names, ", ")))


def comparison_steps(cases: DataFrame, merged: DataFrame) -> DataFrame:
    """One row a case of ``cases(case_id, n_documents)``: how many documents, pairs and fields were compared, and what came out."""
    of = merged.groupBy("case_id").agg(F.count(F.lit(1)).alias("fields"), F.count_if(F.col("verdict") != "MATCH").alias("found"), F.count_if(F.col("verdict") == "MATCH").alias("same"))
    n = F.col("n_documents")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    return _step(cases.join(of, "case_id", "left"), 2, F.lit(""), "compare_fields", F.format_string("documents=%d, pairs=%d, fields_evaluated=%d", n, (n * (n - 1) / 2).cast("bigint"), zero(F.col("fields"))), F.format_string("%d findings (merged field-level), %d consistent", zero(F.col("found")), zero(F.col("same"))))


def score_steps(risks: DataFrame) -> DataFrame:
    return _step(risks, 3, F.lit(""), "score_case", F.format_string("findings=%d", "n_findings"), F.concat(F.lit("risk_score="), F.col("risk_score").cast("string"), F.lit(", triage="), "triage"))


def retry_steps(retried: DataFrame) -> DataFrame:
    """One row a field of ``extract.retry_rounds``."""
    improved = F.format_string("Confidence improved from %.2f to %.2f", "initial_conf", F.coalesce("ocr_conf", F.lit(0.0)))
    kept = F.format_string("Retries attempted, kept baseline conf (%.2f)", "initial_conf")
    args = F.concat(F.lit("field="), "field", F.coalesce(F.concat(F.lit(", attempt="), F.col("improved_by").cast("string")), F.lit("")))
    return _step(retried, 2, F.col("doc_id"), "retry_critical_field", args, F.when(F.col("improved_by").isNotNull(), improved).otherwise(kept))


def observed(df: DataFrame, name: str, *metrics: Column) -> tuple[DataFrame, Observation]:
    """``df`` and an observation that has its row count, and ``metrics``, once any action on it has run: no job of its own."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *metrics), seen


def verdict_counts() -> list[Column]:
    """Metrics for ``observed`` over verdicts or merged findings: a count a verdict."""
    return [F.count_if(F.col("verdict") == v).alias(v.lower()) for v in ("MISMATCH", "LOW_CONFIDENCE", "MINOR_VARIANT", "MISSING", "MATCH")]


def summary(seen: Observation) -> str:
    """The metrics of an action that has run, as one line; waits for it."""
    got = seen.get
    return ", ".join(f"{k}={got[k]}" for k in got)
