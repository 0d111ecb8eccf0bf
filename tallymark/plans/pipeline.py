"""The whole screening as one chain of DataFrames; each stage may be used alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..operators import classify, compare, extract, merge, score


@dataclass
class Screening:
    """Lazy results: nothing runs until one of them is used."""

    documents: DataFrame
    fields: DataFrame
    verdicts: DataFrame
    merged: DataFrame
    cases: DataFrame
    cfg: C.Config = C.DEFAULT

    @property
    def risks(self) -> DataFrame:
        return self.told()

    def told(self, **more: Column) -> DataFrame:
        """``risks`` with aggregates over each case's merged fields beside them, in one pass."""
        return score.case_risk(self.merged, self.cases, self.cfg, **more)

    @property
    def findings(self) -> DataFrame:
        return merge.rank_findings(merge.findings(self.merged))


def screen_fields(documents: DataFrame, fields: DataFrame, cfg: C.Config = C.DEFAULT, kinds: tuple[str, ...] = compare.KINDS) -> Screening:
    """From normalised fields: pairs, verdicts, merge, risk. ``documents``: case_id, idx, doc_id, doc_type."""
    found = compare.verdicts(compare.case_pair_fields(documents, fields), cfg, kinds)
    return Screening(documents, fields, found, merge.merge_fields(found), documents, cfg)


def complete_bundles(documents: DataFrame, least: int = 2, most: int = 6) -> DataFrame:
    """Documents of cases that have from ``least`` to ``most`` of them."""
    good = documents.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(least, most)).select("case_id")
    return documents.join(good, "case_id", "left_semi")


def screen_rows(rows: DataFrame, cases: DataFrame, cfg: C.Config = C.DEFAULT, kinds: tuple[str, ...] = compare.KINDS) -> Screening:
    """From one table of documents with their normalised fields (see ``compare.case_pair_rows``); ``cases`` has every case_id."""
    found = compare.verdicts(compare.case_pair_rows(rows), cfg, kinds)
    documents = rows.select("case_id", "idx", "doc_id", "doc_type").distinct()
    return Screening(documents, rows.filter("field is not null"), found, merge.merge_fields(found), cases, cfg)


def token_rows(tokens: DataFrame, cfg: C.Config = C.DEFAULT) -> DataFrame:
    """Documents with their normalised fields from tokens dealt out by case: classified, read and normalised without another shuffle.

    ``idx``, which orders a case's documents, is the tokens' ``doc_no`` where they have it, else the first number in the document's name.
    """
    number = [F.col("doc_no").alias("idx")] if "doc_no" in tokens.columns else [F.coalesce(F.nullif(F.regexp_extract("doc_id", r"(\d+)", 1), F.lit("")).cast("int"), F.lit(0)).alias("idx")]
    dealt = tokens.drop("doc_type").repartition("case_id")
    docs = extract.read_pages(dealt, cfg.line_gap)
    one = docs.select("case_id", "doc_id", *number, "doc_type", F.explode_outer("fields").alias("f"))
    flat = one.select("case_id", "idx", "doc_id", "doc_type", "f.field", "f.value_raw", "f.ocr_conf", "f.method", F.col("f.context.span").alias("source_text_span"))
    return flat.withColumn("value_norm", extract.value_of(F.col("field"), F.col("value_raw")))


def kept(df: DataFrame) -> DataFrame:
    """A checkpoint where the session has a folder for it, else a cache that Spark's cleaner drops with the last reference."""
    sc = df.sparkSession.sparkContext
    return df.checkpoint() if sc._jsc.sc().getCheckpointDir().isDefined() else df.persist()


def screen_tokens(tokens: DataFrame, cfg: C.Config = C.DEFAULT) -> Screening:
    """From token tables (case, document, position, text, confidence, box, line): classify, read, normalise, screen.

    One shuffle, by case, carries the tokens up to documents and fields; those are kept, since names and streets that differ are scored
    apart and joined back.
    """
    rows = kept(token_rows(tokens, cfg))
    return screen_rows(rows, rows.select("case_id"), cfg)
