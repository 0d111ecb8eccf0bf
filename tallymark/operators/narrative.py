"""Narratives, reviewer questions, masked payloads and their hashes, all from ranked findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import mask_for_model
from .merge import ranked
from .. import config as C

#: What a band of risk means, in one sentence.
OPENING = {
    "GREEN": "The noisy-OR risk lies below the amber limit, and no field of high severity differs.",
    "AMBER": "Some field differs or could not be read well enough; the case waits for a decision on each finding.",
    "RED": "At least one field of high severity differs with a confidence of 0.70 or more; nothing should be approved on these papers.",
}
#: What to ask about a field whose values differ.
QUESTIONS = {
    "dob": "Which of the dates is on the birth register, and can an extract be sent?",
    "name": "Are both names one person by law, and which paper shows the change?",
    "address": "Since when does the person live at the newer address, and what proves it?",
    "id": "Which number is valid today, and can its issuer confirm it?",
}
NO_QUESTION = "Nothing to ask: no field differs."


def _key(field: Column) -> Column:
    return F.when(field.contains("dob") | field.contains("date"), "dob").when(field.contains("name"), "name").when(field.contains("address"), "address").when(field.contains("id"), "id")


def _beside(risks: DataFrame, rows: DataFrame, gathered: Column) -> DataFrame:
    return risks.join(rows.groupBy("case_id").agg(gathered.alias("items")), "case_id", "left")


def _place() -> list[Column]:
    """What orders a case's findings (as ``rank`` does)."""
    return [ranked(F.col("severity"), C.SEVERITY_RANK).alias("_s"), (-F.col("confidence")).alias("_c"), F.col("field").alias("_f")]


def narrative_lines() -> Column:
    """An aggregate over a case's merged fields: a line a finding by verdict, in the order of rank."""
    order = F.when(F.col("verdict") == "MISMATCH", 0).when(F.col("verdict") == "LOW_CONFIDENCE", 1).when(F.col("verdict") == "MINOR_VARIANT", 2)
    line = F.concat(F.lit("- "), F.upper("field"), F.lit(" ("), F.col("verdict"), F.lit(", "), F.col("severity"), F.lit("): "), F.array_join("rule_ids", ", "))
    return F.transform(F.array_sort(F.collect_list(F.when(order.isNotNull(), F.struct(order.alias("_o"), *_place(), line.alias("line"))))), lambda x: x["line"])


def told_narratives(told: DataFrame) -> DataFrame:
    """``case_id, narrative`` of risks with ``narrative_lines`` as ``items``: an opening by triage, then the lines."""
    opening = F.element_at(F.create_map(*[F.lit(x) for kv in OPENING.items() for x in kv]), F.col("triage"))
    body = F.when(F.size("items") > 0, F.concat(F.lit("\n"), F.array_join("items", "\n")))
    return told.select("case_id", F.concat(F.lit("Triage "), "triage", F.lit(": "), opening, F.coalesce(body, F.lit(""))).alias("narrative"))


def narratives(risks: DataFrame, found: DataFrame) -> DataFrame:
    """``case_id, narrative``: an opening by triage, then a line a finding by verdict, in the order of rank."""
    return told_narratives(_beside(risks, found, narrative_lines()))


def asked() -> Column:
    """An aggregate over a case's merged fields: what may be asked, ``key`` and ``question``, severe mismatches first."""
    f, differs = F.col("field"), F.col("verdict") == "MISMATCH"
    question = F.element_at(F.create_map(*[F.lit(x) for kv in QUESTIONS.items() for x in kv]), _key(f))
    scan = F.concat(F.lit("Can a clearer scan of the document containing '"), f, F.lit("' be requested?"))
    key = F.when(differs, _key(f)).otherwise(F.concat(F.lit("lc_"), f))
    o = F.when(differs, ranked(F.col("severity"), C.SEVERITY_RANK)).otherwise(9)
    return F.array_sort(F.collect_list(F.when(F.col("verdict").isin("MISMATCH", "LOW_CONFIDENCE") & key.isNotNull(), F.struct(o.alias("_o"), *_place(), key.alias("key"), F.when(differs, question).otherwise(scan).alias("question")))))


def told_questions(told: DataFrame, most: int = 5) -> DataFrame:
    """``case_id, n, question`` of risks with ``asked`` as ``items``: one a key, ``most`` at most."""
    once = F.filter("items", lambda x, k: ~F.exists(F.slice("items", F.lit(1), k), lambda y: y["key"] == x["key"]))
    said = F.transform(F.slice(once, 1, most), lambda x: x["question"])
    return told.select("case_id", F.posexplode(F.when(F.size("items") > 0, said).otherwise(F.array(F.lit(NO_QUESTION)))).alias("n", "question")).withColumn("n", F.col("n") + 1)


def questions(risks: DataFrame, found: DataFrame, most: int = 5) -> DataFrame:
    """``case_id, n, question``: one a key, severe mismatches first, then a better scan of uncertain fields; five at most."""
    return told_questions(_beside(risks.select("case_id").distinct(), found, asked()), most)


def payload_items() -> Column:
    """An aggregate over a case's merged fields: them with identifiers masked; consistent identifiers are left out."""
    f = F.col("field")
    safe = F.when(f.rlike("id|roll|number"), F.transform_values("values_raw", lambda k, v: mask_for_model(v))).otherwise(F.col("values_raw"))
    item = F.struct("field", "verdict", "severity", "similarity", "confidence", F.array_sort(F.map_entries(safe)).alias("values"), "rule_ids", "reasons")
    return F.array_sort(F.collect_list(F.when(~((F.col("verdict") == "MATCH") & f.contains("id")), item)))


def told_payloads(told: DataFrame) -> DataFrame:
    """``case_id, payload, hash`` of risks with ``payload_items`` as ``items``."""
    body = F.to_json(F.struct("case_id", F.round("risk_score", 3).alias("risk_score"), "triage", F.coalesce("items", F.array()).alias("items")))
    return told.select("case_id", body.alias("payload")).withColumn("hash", F.sha2("payload", 256))


def payloads(risks: DataFrame, merged: DataFrame) -> DataFrame:
    """``case_id, payload, hash``: findings as JSON with identifiers masked, and its SHA-256; consistent identifiers are left out."""
    return told_payloads(_beside(risks, merged, payload_items()))


def split_response(text: Column) -> Column:
    """struct(summary, questions) of a model's answer with a 'Reviewer Questions' section; bullets are stripped, repeats dropped."""
    parts = F.split(text, r"(?i)#*\s*reviewer questions:?\s*\n")
    lines = F.transform(F.split(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)])\s*", "")))
    return F.struct(F.trim(F.regexp_replace(parts[0], r"(?i)#*\s*summary:?\s*\n", "")).alias("summary"), F.array_distinct(F.filter(lines, lambda x: x != "")).alias("questions"))


def cached(payload_rows: DataFrame, cache: DataFrame) -> DataFrame:
    """Payloads with the narrative that the cache has for their hash (null: still to be made)."""
    return payload_rows.join(cache.select("hash", "narrative"), "hash", "left")
