"""Cases, reviewer decisions and the audit log as tables: appends, latest by key, and rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config as C
from .merge import ranked

CASES = "case_id string, timestamp timestamp, triage string, risk_score double, report_json string"
DECISIONS = "case_id string, finding_id string, status string, notes string, reviewer_id string, updated_at timestamp"
AUDIT = "case_id string, action string, details string, actor string, at timestamp"


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; hash-partitioned, one pass."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def audit_trail(audit: DataFrame, order: list[str], case_id=None, most: int = 100) -> DataFrame:
    """Newest first: all of a case, or the last ``most`` of all."""
    newest = [F.col(c).desc() for c in order]
    return audit.filter(F.col("case_id") == case_id).orderBy(*newest) if case_id is not None else audit.orderBy(*newest).limit(most)


def with_status(found: DataFrame, decisions: DataFrame) -> DataFrame:
    """Findings with their current decision; none means PENDING. Decisions are keyed by case and finding."""
    return found.join(decisions.select("case_id", "finding_id", "status"), ["case_id", "finding_id"], "left").withColumn("status", F.coalesce("status", F.lit("PENDING")))


class CaseStore:
    """Parquet tables under one path, each in numbered versions. Appends commit whole; a rewrite is a new version, which counts
    once its writer has committed all of it, so a crash leaves the one before in place. No appends while ``compact`` runs."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self, name: str) -> list[int]:
        """Committed versions, oldest first; 0 takes appends from the start."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        here = [x.getPath() for x in fs.listStatus(at)] if fs.exists(at) else []
        made = [int(x.getName()[1:]) for x in here if x.getName()[1:].isdigit() and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
        return sorted({0, *made})

    def _at(self, name: str) -> str:
        return f"{self.path}/{name}/v{self._versions(name)[-1]}"

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(self._at(name))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def _append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self._at(name))

    def log(self, case_id: str, action: str, details: str = "", actor: str = "system") -> None:
        one = self.spark.createDataFrame([(case_id, action, details, actor)], "case_id string, action string, details string, actor string")
        self._append("audit", one.withColumn("at", F.current_timestamp()))

    def save_case(self, case_id: str, triage: str, risk_score: float, report_json: str) -> None:
        self._append("cases", self.spark.createDataFrame([(case_id, triage, float(risk_score), report_json)], "case_id string, triage string, risk_score double, report_json string").withColumn("timestamp", F.current_timestamp()))
        self.log(case_id, "CASE_SCREENED", f"{triage} {risk_score}")

    def save_cases(self, reports: DataFrame) -> None:
        """Many at once: ``case_id, triage, risk_score, report_json``."""
        now = reports.withColumn("timestamp", F.current_timestamp())
        self._append("cases", now)
        self._append("audit", now.select("case_id", F.lit("CASE_SCREENED").alias("action"), F.concat_ws(" ", "triage", "risk_score").alias("details"), F.lit("system").alias("actor"), F.col("timestamp").alias("at")))

    def _live(self, rows: DataFrame, at: str) -> DataFrame:
        gone = self._read("audit", AUDIT).filter("action = 'CASE_DELETED'").groupBy(F.col("case_id").alias("_c")).agg(F.max("at").alias("_at"))
        return rows.join(gone, (F.col("case_id") == F.col("_c")) & (F.col(at) <= F.col("_at")), "left_anti")

    def cases(self) -> DataFrame:
        return latest(self._live(self._read("cases", CASES), "timestamp"), ["case_id"], ["timestamp", "report_json"]).orderBy(F.col("timestamp").desc())

    def case(self, case_id: str) -> DataFrame:
        return self.cases().filter(F.col("case_id") == case_id)

    def decide(self, case_id: str, finding_id: str, status: str, notes: str = "", reviewer_id: str = "reviewer_1") -> None:
        self._append("decisions", self.spark.createDataFrame([(case_id, finding_id, status, notes, reviewer_id)], "case_id string, finding_id string, status string, notes string, reviewer_id string").withColumn("updated_at", F.current_timestamp()))
        self.log(case_id, f"DECISION_{status}", finding_id, reviewer_id)

    def decisions(self, case_id: str | None = None) -> DataFrame:
        now = latest(self._live(self._read("decisions", DECISIONS), "updated_at"), ["case_id", "finding_id"], ["updated_at", "status", "notes"])
        return now if case_id is None else now.filter(F.col("case_id") == case_id)

    def audit(self, case_id: str | None = None) -> DataFrame:
        return audit_trail(self._read("audit", AUDIT), ["at", "action"], case_id)

    def delete_case(self, case_id: str) -> None:
        """A tombstone in the log hides the case and its decisions; ``compact`` removes their rows. Log rows stay."""
        self.log(case_id, "CASE_DELETED")

    def compact(self) -> None:
        """Rewrite cases and decisions without superseded and deleted rows, as a new version; versions before the last two go."""
        for name, rows in (("cases", self.cases()), ("decisions", self.decisions())):
            versions = self._versions(name)
            rows.write.mode("overwrite").parquet(f"{self.path}/{name}/v{versions[-1] + 1}")
            for old in versions[:-1]:
                at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/v{old}")
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def report_items() -> Column:
    """An aggregate over a case's merged fields: what a report says of each."""
    return F.array_sort(F.collect_list(F.struct("field", "verdict", "severity", "similarity", "confidence", "finding_id", "rule_ids", "suggested_action")))


def told_json(told: DataFrame) -> DataFrame:
    """``case_id, triage, risk_score, report_json`` of risks with ``report_items`` as ``items``."""
    split = lambda keep: F.filter(F.coalesce("items", F.array()), lambda x: (x["verdict"] == "MATCH") == F.lit(keep))
    report = F.struct("case_id", "risk_score", "triage", split(False).alias("findings"), split(True).alias("consistent_items"), F.lit(DISCLAIMER).alias("disclaimer"))
    return told.select("case_id", "triage", "risk_score", F.to_json(report).alias("report_json"))


def json_reports(risks: DataFrame, merged: DataFrame) -> DataFrame:
    """``case_id, triage, risk_score, report_json``."""
    return told_json(risks.join(merged.groupBy("case_id").agg(report_items().alias("items")), "case_id", "left"))


# Fixed value.
DISCLAIMER = (
    "This report is an automated pre-screening aid. It flags possible inconsistencies for human review and does not determine authenticity, eligibility, or approval. "
    "Final judgment rests with the human reviewer. Only synthetic sample data is used in this demonstration."
)


def _html_safe(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def html_rows() -> Column:
    """An aggregate over a case's merged fields: the cells of each finding but the rank, in the order of rank."""
    cells = F.concat(*[F.concat(F.lit("<td>"), _html_safe(F.col(c).cast("string")), F.lit("</td>")) for c in ("field", "verdict", "severity", "confidence")])
    row = F.struct(ranked(F.col("severity"), C.SEVERITY_RANK).alias("_s"), (-F.col("confidence")).alias("_c"), F.col("field").alias("_f"), cells.alias("cells"))
    return F.array_sort(F.collect_list(F.when(F.col("verdict") != "MATCH", row)))


def told_html(told: DataFrame) -> DataFrame:
    """``case_id, html`` of risks with ``html_rows`` as ``items``."""
    rows = F.array_join(F.transform("items", lambda x, k: F.concat(F.lit("<tr><td>"), (k + 1).cast("string"), F.lit("</td>"), x["cells"], F.lit("</tr>"))), "")
    return told.select("case_id", F.concat(F.lit("<html><body><h1>Case "), _html_safe(F.col("case_id").cast("string")), F.lit(": "), "triage", F.lit("</h1><table>"), F.coalesce(rows, F.lit("")), F.lit(f"</table><footer>{DISCLAIMER}</footer></body></html>")).alias("html"))


def html_reports(risks: DataFrame, found: DataFrame) -> DataFrame:
    """``case_id, html``: a table of ranked findings and the disclaimer; values are escaped."""
    return told_html(risks.join(found.groupBy("case_id").agg(html_rows().alias("items")), "case_id", "left"))
