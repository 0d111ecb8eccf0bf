"""Merging pair verdicts to one finding a field, and ranking findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config as C
from ..functions.text import let


def ranked(c: Column, order: dict[str, int]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), c), F.lit(99))


def merge_fields(v: DataFrame) -> DataFrame:
    """One row a case and field: the worst verdict and severity, least similarity, mean confidence, ordered distinct rules
    and reasons, values by document, the action of the first pair that has the worst verdict."""
    rank = ranked(F.col("verdict"), C.VERDICT_RANK)
    base = v.withColumn("rank", rank).withColumn("sev", ranked(F.col("severity"), C.SEVERITY_RANK))
    in_order = lambda name: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pair_ord", name))), lambda x: x[name])))
    merged = base.groupBy("case_id", "field").agg(
        F.min_by("verdict", "rank").alias("verdict"), F.min_by("severity", "sev").alias("severity"), F.round(F.min("similarity"), 3).alias("similarity"),
        F.round(F.sum(F.col("confidence").cast("decimal(20,6)")).cast("double") / F.count(F.lit(1)), 3).alias("confidence"),
        in_order("rule_ids").alias("rule_ids"), in_order("reasons").alias("reasons"),
        F.min_by("suggested_action", F.struct("rank", "pair_ord")).alias("action"), F.count(F.lit(1)).alias("n_pairs"),
        F.collect_list(F.struct("doc_a", "doc_b")).alias("_docs"), *(F.collect_list(F.struct("doc_a", "doc_b", f"{n}_a", f"{n}_b")).alias(f"_{n}") for n in ("raw", "norm")),
    )
    sides = lambda rows, made: F.array_sort(F.array_union(F.transform(rows, lambda x: made(x, "a")), F.transform(rows, lambda x: made(x, "b"))))

    def by_document(n: str) -> Column:
        # a document that lacks the field in one pair and has it in none shows as absent; a value wins over absence
        values = sides(f"_{n}", lambda x, y: F.struct(x[f"doc_{y}"].alias("doc"), x[f"{n}_{y}"].alias("value")))
        return F.map_from_entries(let(values, lambda v: F.filter(v, lambda s, k: F.coalesce(F.get(v, k + 1)["doc"] != s["doc"], F.lit(True)))))

    merged = merged.withColumn("docs", sides("_docs", lambda x, y: x[f"doc_{y}"]))
    return merged.withColumn("values_raw", by_document("raw")).withColumn("values_norm", by_document("norm")).withColumn("finding_id", F.concat_ws("_", "field", F.array_join("docs", "_"))).withColumn("suggested_action", F.when(F.col("verdict") == "MATCH", "Verify manually against original document").otherwise(F.col("action"))).drop("_docs", "_raw", "_norm", "action")


ABSENT = "[NOT PRESENT]"


def with_evidence(merged: DataFrame, documents: DataFrame, fields: DataFrame) -> DataFrame:
    """``evidence`` and ``bboxes`` beside merged findings: for each document of a finding, in their order, where its value was read.

    ``documents``: case_id, doc_id, doc_type and, if known, filename. ``fields`` may have x, y, w, h (the value's box),
    source_text_span, line_x .. line_h, source_line_conf and page; what is not there is null. A document without the field has
    an entry that says so, with confidence 1. One entry a document: the first found, where one with a span comes before
    one without.
    """
    have = set(fields.columns)
    text = lambda c, kind: F.col(c) if c in have else F.lit(None).cast(kind)
    box = lambda *c: F.array(*(F.col(x).cast("int") for x in c)) if set(c) <= have else F.lit(None).cast("array<int>")
    entry = F.struct(
        F.col("doc_id").alias("doc_id"), F.col("value_raw").alias("value_raw"), F.col("value_norm").alias("value_norm"), text("source_text_span", "string").alias("source_text_span"), box("line_x", "line_y", "line_w", "line_h").alias("source_line_bbox"),
        text("source_line_conf", "double").alias("source_line_conf"), F.col("ocr_conf").cast("double").alias("ocr_conf"), F.coalesce(text("page", "int"), F.lit(1)).alias("page"), box("x", "y", "w", "h").alias("bbox"),
    )
    names = documents.select("case_id", F.col("doc_id").alias("_doc"), F.col("filename" if "filename" in documents.columns else "doc_id").alias("doc_name"), "doc_type")
    one = fields.withColumn("_e", entry).groupBy("case_id", "field", F.col("doc_id").alias("_doc")).agg(F.min_by("_e", F.struct(F.col("_e.source_text_span").isNull(), "_e")).alias("_e"))
    wanted = merged.select("case_id", "field", F.posexplode("docs").alias("_at", "_doc"))
    read = wanted.join(one, ["case_id", "field", "_doc"], "left").join(names, ["case_id", "_doc"], "left")
    blank = F.struct(F.col("_doc").alias("doc_id"), F.lit(ABSENT).alias("value_raw"), F.lit(ABSENT).alias("value_norm"), *(F.lit(None).cast(k).alias(n) for n, k in (("source_text_span", "string"), ("source_line_bbox", "array<int>"), ("source_line_conf", "double"))), F.lit(1.0).alias("ocr_conf"), F.lit(1).alias("page"), F.lit(None).cast("array<int>").alias("bbox"))
    full = read.withColumn("_e", F.coalesce("_e", blank)).select("case_id", "field", F.struct("_at", F.struct("doc_name", "doc_type", "_e.*").alias("e")).alias("x"))
    gathered = full.groupBy("case_id", "field").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["e"]).alias("evidence"))
    boxes = F.map_from_entries(F.transform("evidence", lambda e: F.struct(e["doc_id"].alias("k"), e["bbox"].alias("v"))))
    return merged.join(gathered, ["case_id", "field"], "left").withColumn("bboxes", boxes)


def findings(merged: DataFrame) -> DataFrame:
    return merged.filter("verdict <> 'MATCH'")


def consistent_items(merged: DataFrame) -> DataFrame:
    return merged.filter("verdict = 'MATCH'")


def rank_findings(found: DataFrame) -> DataFrame:
    """``rank`` 1, 2, ... in a case by severity, then falling confidence, then field."""
    w = Window.partitionBy("case_id").orderBy(ranked(F.col("severity"), C.SEVERITY_RANK), F.col("confidence").desc(), "field")
    return found.withColumn("rank", F.row_number().over(w))
