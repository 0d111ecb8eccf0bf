"""Comparing the documents of a case: pairs, fields, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import addresses, dates, ids, similarity


def document_pairs(documents: DataFrame) -> DataFrame:
    """Every unordered pair within a case: ``case_id, doc_a, doc_b, type_a, type_b, pair_ord``; ``idx`` orders documents."""
    a, b = documents.alias("a"), documents.alias("b")
    return a.join(b, (F.col("a.case_id") == F.col("b.case_id")) & (F.col("a.idx") < F.col("b.idx"))).select(
        F.col("a.case_id").alias("case_id"), F.col("a.doc_id").alias("doc_a"), F.col("b.doc_id").alias("doc_b"),
        F.col("a.doc_type").alias("type_a"), F.col("b.doc_type").alias("type_b"), (F.col("a.idx") * 1000 + F.col("b.idx")).alias("pair_ord"),
    )


def pair_fields(pairs: DataFrame, fields: DataFrame) -> DataFrame:
    """Fields of the pair's first document beside the second's (null where it has none), where the registry compares them.

    A field that only the second document has yields nothing; one it lacks stays only if its type is expected to carry it.
    """
    side = lambda x: fields.select(F.col("case_id").alias(f"case_{x}"), F.col("doc_id").alias(f"of_{x}"), F.col("field").alias(f"field_{x}"), F.col("value_raw").alias(f"raw_{x}"), F.col("value_norm").alias(f"norm_{x}"), F.col("ocr_conf").alias(f"conf_{x}"))
    fa, fb = side("a"), side("b")
    left = pairs.join(fa, (pairs.case_id == fa.case_a) & (pairs.doc_a == fa.of_a)).drop("case_a", "of_a")
    both = left.join(fb, (left.case_id == fb.case_b) & (left.doc_b == fb.of_b) & (left.field_a == fb.field_b), "left").drop("case_b", "of_b")
    gate = ids.should_compare(F.col("field_a"), F.col("type_a"), F.col("type_b"), F.coalesce("norm_a", F.lit("")), F.coalesce("norm_b", F.lit("")))
    return both.filter(gate & (F.col("field_b").isNotNull() | ids.expected_on(F.col("field_a"), F.col("type_b")))).withColumnRenamed("field_a", "field").withColumn("missing", F.col("field_b").isNull()).drop("field_b")


def case_pair_fields(documents: DataFrame, fields: DataFrame) -> DataFrame:
    """The rows of ``pair_fields(document_pairs(documents), fields)`` with one shuffle: a case's documents and fields are gathered
    into one row and unfolded there. For cases of a bounded number of documents, as ``pipeline.complete_bundles`` lets pass;
    what follows may group by case without another shuffle."""
    d = documents.select("case_id", F.struct("idx", "doc_id", "doc_type").alias("d"))
    f = fields.select("case_id", F.struct("doc_id", "field", "value_raw", "value_norm", "ocr_conf").alias("f"))
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    both = d.select("case_id", "d", none(f, "f")).unionByName(f.select("case_id", none(d, "d"), "f"))
    return _unfolded(both.groupBy("case_id").agg(F.array_sort(F.collect_list("d")).alias("ds"), F.collect_list("f").alias("fs")))


def case_pair_rows(rows: DataFrame) -> DataFrame:
    """The same from one table of documents with their fields, case_id, idx, doc_id, doc_type, field, value_raw, value_norm, ocr_conf, where a
    document without fields has one row whose field is null. Rows that lie together by case are not shuffled again."""
    f = F.when(F.col("field").isNotNull(), F.struct("doc_id", "field", "value_raw", "value_norm", "ocr_conf"))
    return _unfolded(rows.select("case_id", F.struct("idx", "doc_id", "doc_type").alias("d"), f.alias("f")).groupBy("case_id").agg(F.array_sort(F.collect_set("d")).alias("ds"), F.collect_list("f").alias("fs")))


def _unfolded(case: DataFrame) -> DataFrame:
    """``case_id, ds, fs`` (documents in order, fields) as rows of pairs and fields."""
    pairs = F.flatten(F.transform("ds", lambda a: F.transform(F.filter("ds", lambda b: b["idx"] > a["idx"]), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    unfolded = case.select("case_id", "fs", F.explode(pairs).alias("p"))
    first = unfolded.select("case_id", "fs", "p", F.explode(F.filter("fs", lambda x: x["doc_id"] == F.col("p.a.doc_id"))).alias("fa"))
    rows = first.select("case_id", "p", "fa", F.explode_outer(F.filter("fs", lambda x: (x["doc_id"] == F.col("p.b.doc_id")) & (x["field"] == F.col("fa.field")))).alias("fb"))
    flat = rows.select(
        "case_id", F.col("p.a.doc_id").alias("doc_a"), F.col("p.b.doc_id").alias("doc_b"), F.col("p.a.doc_type").alias("type_a"), F.col("p.b.doc_type").alias("type_b"), (F.col("p.a.idx") * 1000 + F.col("p.b.idx")).alias("pair_ord"),
        F.col("fa.field").alias("field"), *(F.col(f"f{x}.{c}").alias(f"{n}_{x}") for x in "ab" for c, n in (("value_raw", "raw"), ("value_norm", "norm"), ("ocr_conf", "conf"))), F.col("fb").isNull().alias("missing"),
    )
    gate = ids.should_compare(F.col("field"), F.col("type_a"), F.col("type_b"), F.coalesce("norm_a", F.lit("")), F.coalesce("norm_b", F.lit("")))
    return flat.filter(gate & (~F.col("missing") | ids.expected_on(F.col("field"), F.col("type_b"))))


def initial_match(a: Column, b: Column) -> Column:
    """As many words, and each equal or one the other's initial."""
    pairs = F.arrays_zip(F.split(a, " ").alias("x"), F.split(b, " ").alias("y"))
    fits = lambda p: (p["x"] == p["y"]) | ((F.length(p["x"]) == 1) & p["y"].startswith(p["x"])) | ((F.length(p["y"]) == 1) & p["x"].startswith(p["y"]))
    return (a != "") & (b != "") & (F.size(F.split(a, " ")) == F.size(F.split(b, " "))) & F.forall(pairs, lambda p: F.coalesce(fits(p), F.lit(False)))


def initial_rules(a: Column, b: Column) -> Column:
    """A rule id for each word that is the other side's initial, where both names have as many words."""
    pairs = F.arrays_zip(F.split(a, " ").alias("x"), F.split(b, " ").alias("y"))
    fits = lambda p: (p["x"] != p["y"]) & (((F.length(p["x"]) == 1) & p["y"].startswith(p["x"])) | ((F.length(p["y"]) == 1) & p["x"].startswith(p["y"])))
    named = F.transform(F.filter(pairs, lambda p: F.coalesce(fits(p), F.lit(False))), lambda p: F.concat(F.lit("RULE_NAME_INITIAL_EXPAND_"), F.upper(p["x"]), F.lit("_"), F.upper(p["y"])))
    return F.when((a != b) & (F.size(F.split(a, " ")) == F.size(F.split(b, " "))), named).otherwise(F.array().cast("array<string>"))


def _named(cfg: C.Config) -> Column:
    """Verdict of two names, from columns norm_a, norm_b and the scores (null where the names are equal)."""
    a, b = F.col("norm_a"), F.col("norm_b")
    lev = F.lit(1.0) - similarity.lev_distance(a, b)
    tsr, jw, meta = F.col("scores.tsr"), F.col("scores.jw"), F.col("scores.meta")
    blend = F.least(F.lit(1.0), F.greatest(F.lit(0.0), tsr * 0.35 + lev * 0.25 + jw * 0.25 + meta * 0.15))
    initial = F.greatest(F.lit(0.93), tsr * 0.35 + lev * 0.25 + jw * 0.20 + 0.20)
    sim = F.when(initial_match(a, b), initial).otherwise(blend)
    made = lambda v, s, r: F.struct(F.lit(v).alias("verdict"), s.alias("similarity"), F.lit(r).alias("rule"))
    return (
        F.when(a == b, made("MATCH", F.lit(1.0), "RULE_NAME_EXACT_MATCH"))
        .when(sim >= cfg.name_match, made("MATCH", F.round(sim, 3), "RULE_NAME_HIGH_SIMILARITY_MATCH"))
        .when(sim >= cfg.name_variant, made("MINOR_VARIANT", F.round(sim, 3), "RULE_NAME_MINOR_VARIANT"))
        .otherwise(made("MISMATCH", F.round(sim, 3), "RULE_NAME_SUBSTANTIAL_MISMATCH"))
    )


def address_components_of(raw: str) -> Column:
    return addresses.components(addresses.address_value(F.col(raw)))


def _addressed(cfg: C.Config) -> Column:
    a, b = F.col("comp_a"), F.col("comp_b")
    part = lambda x: F.when((a[x] != "") & (a[x] == b[x]), 1.0).when((a[x] == "") | (b[x] == ""), 0.5).otherwise(0.0)
    street = F.when((a["street_locality"] == "") | (b["street_locality"] == ""), 0.5).when(a["street_locality"] == b["street_locality"], 1.0).otherwise(F.col("street_score") / 100)
    sim = part("pincode") * cfg.pin_weight + part("city") * cfg.city_weight + street * cfg.street_weight + part("house_number") * cfg.house_weight
    differ = lambda x: (a[x] != "") & (b[x] != "") & (a[x] != b[x])
    verdict = F.when(sim >= cfg.address_match, "MATCH").when(sim >= cfg.address_variant, "MINOR_VARIANT").otherwise("MISMATCH")
    last = F.when(sim >= cfg.address_match, "RULE_ADDR_HIGH_MATCH").when(sim >= cfg.address_variant, "RULE_ADDR_MINOR_VARIANT").otherwise("RULE_ADDR_MISMATCH")
    same = (F.col("norm_a") == F.col("norm_b")) & (F.col("norm_a") != "")
    rules = F.array_compact(F.array(F.when(differ("pincode"), F.lit("RULE_ADDR_PINCODE_MISMATCH")), F.when(differ("city"), F.lit("RULE_ADDR_CITY_MISMATCH")), last))
    return F.when(same, F.struct(F.lit("MATCH").alias("verdict"), F.lit(1.0).alias("similarity"), F.array(F.lit("RULE_ADDR_EXACT_MATCH")).alias("rules"))).otherwise(F.struct(verdict.alias("verdict"), F.round(sim, 3).alias("similarity"), rules.alias("rules")))


def kind_of(field: Column) -> Column:
    """Which comparator a field gets."""
    f = F.lower(field)
    return (
        F.when(f.contains("name") & ~f.contains("father") & ~f.contains("guardian"), "name").when(f.contains("dob") | f.contains("date"), "date")
        .when(f.contains("address"), "address").when(f.contains("id") | f.contains("number") | f.contains("roll"), "id").otherwise("name")
    )


def gated(verdict: Column, conf_a: Column, conf_b: Column, cfg: C.Config = C.DEFAULT) -> Column:
    return F.when(F.least(conf_a, conf_b) < cfg.min_confidence, F.lit("LOW_CONFIDENCE")).otherwise(verdict)


def pair_confidence(verdict: Column, sim: Column, conf_a: Column, conf_b: Column) -> Column:
    signal = F.when(verdict.isin("MISMATCH", "LOW_CONFIDENCE"), F.lit(1.0) - sim).otherwise(sim)
    return F.round(conf_a * conf_b * F.greatest(F.lit(0.5), signal), 3)


# The sentences that go with each verdict.
def action(verdict: Column, doc_a: Column, doc_b: Column) -> Column:
    return (
        F.when(verdict == "MATCH", "No action required (consistent)")
        .when(verdict == "MINOR_VARIANT", "Review spelling/formatting variation; confirm if acceptable")
        .when(verdict == "LOW_CONFIDENCE", "Inspect source image closely or request clearer document re-upload")
        .otherwise(F.concat(F.lit("Verify discrepancy between "), doc_a, F.lit(" and "), doc_b, F.lit("; require explanation or re-upload")))
    )


KINDS = ("name", "date", "address", "id")


def verdicts(pair_rows: DataFrame, cfg: C.Config = C.DEFAULT, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """One row a compared pair and field: verdict, similarity, severity, confidence, rules, reasons, action.

    ``kinds`` are the comparators the fields need. Dates and ids are compared in place; names and streets that differ get their
    scores from Python, in place too. Missing fields go the same way, so the pairs are worked out once.
    """
    there = pair_rows.withColumn("kind", F.when(~F.col("missing"), kind_of(F.col("field"))))
    one = lambda r: F.struct(r["verdict"].alias("verdict"), r["similarity"].alias("similarity"), F.array(r["rule"]).alias("rules"))
    result = None

    def add(kind, value):
        nonlocal result
        result = F.when(F.col("kind") == kind, value) if result is None else result.when(F.col("kind") == kind, value)

    if "date" in kinds:
        add("date", one(dates.compare_dates(F.col("norm_a"), F.col("norm_b"))))
    if "id" in kinds:
        add("id", one(ids.compare_ids(F.col("norm_a"), F.col("norm_b"))))
    if "name" in kinds:
        for x in "ab":
            there = there.withColumn(f"name_{x}", F.when(F.col("kind") == "name", F.col(f"norm_{x}")))
        there = similarity.with_scores(there, "name_a", "name_b", similarity.name_scores_udf, "scores").drop("name_a", "name_b")
        named = _named(cfg)
        add("name", F.struct(named["verdict"].alias("verdict"), named["similarity"].alias("similarity"), F.concat(initial_rules(F.col("norm_a"), F.col("norm_b")), F.array(named["rule"])).alias("rules")))
    if "address" in kinds:
        for x in "ab":
            there = there.withColumn(f"comp_{x}", F.when(F.col("kind") == "address", address_components_of(f"raw_{x}"))).withColumn(f"street_{x}", F.col(f"comp_{x}.street_locality"))
        there = similarity.with_scores(there, "street_a", "street_b", similarity.token_set_ratio_udf, "street_score")
        add("address", _addressed(cfg))
    judged = there.withColumn("r", result)
    known = F.create_map(*[F.lit(x) for kv in cfg.severity.items() for x in kv])
    base = F.coalesce(F.element_at(known, F.col("field")), F.lit("MEDIUM"))
    pin_only = (F.col("kind") == "address") & (F.col("r.verdict") == "MISMATCH") & F.array_contains("r.rules", "RULE_ADDR_PINCODE_MISMATCH") & ~F.array_contains("r.rules", "RULE_ADDR_CITY_MISMATCH")
    there_or = lambda c, absent: F.when(F.col("missing"), absent).otherwise(c)
    lost = F.lit("[NOT PRESENT]")
    final = judged.withColumn("verdict", there_or(gated(F.col("r.verdict"), F.col("conf_a"), F.col("conf_b"), cfg), F.lit("MISSING")))
    # fixed value: the sentence that goes with a missing field
    expected = F.concat(F.lit("Verify if '"), "field", F.lit("' is expected in "), "doc_b", F.lit(" ("), "type_b", F.lit(")"))
    final = final.select(
        "case_id", "doc_a", "doc_b", "pair_ord", "field", "raw_a", there_or(F.col("raw_b"), lost).alias("raw_b"), "norm_a", there_or(F.col("norm_b"), lost).alias("norm_b"), "conf_a", there_or(F.col("conf_b"), F.lit(1.0)).alias("conf_b"),
        "verdict", there_or(F.col("r.similarity"), F.lit(0.0)).alias("similarity"), there_or(F.when(pin_only, F.lit("LOW")).otherwise(base), F.lit("INFO")).alias("severity"),
        there_or(pair_confidence(F.col("verdict"), F.col("r.similarity"), F.col("conf_a"), F.col("conf_b")), F.col("conf_a")).alias("confidence"),
        there_or(F.concat("r.rules", F.when(F.col("verdict") == "LOW_CONFIDENCE", F.array(F.lit("RULE_OCR_CONFIDENCE_GATED"))).otherwise(F.array().cast("array<string>"))), F.array(F.lit("RULE_FIELD_MISSING"))).alias("rule_ids"),
        there_or(action(F.col("verdict"), F.col("doc_a"), F.col("doc_b")), expected).alias("suggested_action"),
    )
    # reasons name identifiers by their last four characters only
    safe = lambda x: F.when(F.col("field").rlike("id|roll|number|consumer|account"), ids.mask_for_model(F.col(x))).otherwise(F.col(x))
    reason = (
        F.when(F.col("verdict") == "MISSING", F.concat(F.lit("'"), "field", F.lit("' present in "), "doc_a", F.lit(" but absent in "), "doc_b", F.lit(".")))
        .when(F.col("verdict") == "LOW_CONFIDENCE", F.format_string("OCR confidence (%.2f) is below reliable threshold (%.2f).", F.least("conf_a", "conf_b"), F.lit(cfg.min_confidence)))
        .when(F.col("verdict") == "MATCH", F.concat(F.lit("Normalised "), "field", F.lit(" agrees.")))
        .otherwise(F.concat(F.lit("'"), safe("raw_a"), F.lit("' vs '"), safe("raw_b"), F.lit("'.")))
    )
    return final.withColumn("reasons", F.array(reason))
