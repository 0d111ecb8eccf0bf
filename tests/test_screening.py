"""Cases, from fields and from tokens, to risk."""

from pyspark.sql import functions as F

from tallymark.operators import compare, extract, merge, quality, score, store
from tallymark.plans import pipeline


def fields_of(spark, rows):
    return spark.createDataFrame([(c, d, f, r, n, q) for c, d, f, r, n, q in rows], "case_id string, doc_id string, field string, value_raw string, value_norm string, ocr_conf double")


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "case_id string, idx int, doc_id string, doc_type string")


def test_case_with_typo_is_amber(spark):
    docs = docs_of(spark, [("c", 1, "doc_1", "id_card"), ("c", 2, "doc_2", "marksheet"), ("d", 1, "doc_1", "id_card"), ("d", 2, "doc_2", "marksheet")])
    rows = [("c", "doc_1", "dob", "2004-03-12", "2004-03-12", 0.96), ("c", "doc_2", "dob", "2004-03-15", "2004-03-15", 0.96), ("d", "doc_1", "dob", "2004-03-12", "2004-03-12", 0.96), ("d", "doc_2", "dob", "2004-03-12", "2004-03-12", 0.96)]
    s = pipeline.screen_fields(docs, fields_of(spark, rows))
    got = {r.case_id: (r.n_findings, r.risk_score, r.triage) for r in s.risks.collect()}
    assert got == {"c": (1, 0.45, "AMBER"), "d": (0, 0.0, "GREEN")}
    found = s.findings.first()
    assert found.verdict == "MISMATCH" and found.confidence == 0.461 and found.similarity == 0.65


def test_low_confidence_and_missing(spark):
    docs = docs_of(spark, [("c", 1, "doc_1", "id_card"), ("c", 2, "doc_2", "address_proof")])
    rows = [("c", "doc_1", "name", "Asha Rao", "asha rao", 0.52), ("c", "doc_2", "name", "Asha Rao", "asha rao", 0.92), ("c", "doc_1", "address", "No 1, MG Road", "number 1 mg road", 0.9)]
    got = {r.field: r.verdict for r in pipeline.screen_fields(docs, fields_of(spark, rows)).merged.collect()}
    assert got == {"name": "LOW_CONFIDENCE", "address": "MISSING"}


def test_address_pin_only_is_low(spark):
    docs = docs_of(spark, [("c", 1, "doc_1", "id_card"), ("c", 2, "doc_2", "address_proof")])
    a, b = "MG Road, Bengaluru 560001", "MG Road, Bengaluru 560099"
    r = pipeline.screen_fields(docs, fields_of(spark, [("c", "doc_1", "address", a, "mg road bengaluru 560001", 0.95), ("c", "doc_2", "address", b, "mg road bengaluru 560099", 0.95)])).merged.first()
    assert (r.verdict, r.severity, r.similarity) == ("MISMATCH", "LOW", 0.6)


def test_pairs_and_red(spark):
    docs = docs_of(spark, [("c", k, f"doc_{k}", "id_card") for k in range(1, 5)])
    assert compare.document_pairs(docs).count() == 6
    found = spark.createDataFrame([("c", "name", "MISMATCH", "HIGH", 0.0, 0.95)], "case_id string, field string, verdict string, severity string, similarity double, confidence double")
    r = score.case_risk(found, docs).first()
    assert r.triage == "RED" and r.risk_score > 0.6
    assert merge.rank_findings(found).first()["rank"] == 1


def test_marksheet_layout(spark):
    rows, pos = [], 0
    for label, x, y, value in (("Candidate Name:", 45, 115, "Asha Rao"), ("Roll Number:", 340, 115, "ROLL-123456"), ("Father Name:", 45, 147, "Ravi Rao"), ("Date of Birth:", 340, 147, "12/03/2004")):
        for k, w in enumerate([label, *value.split()]):
            rows.append(("c", "doc_1", "marksheet", pos, w, 0.9, x + (0 if k == 0 else 130 + 60 * (k - 1)), y, 50, 18, pos))
            pos += 1
    t = spark.createDataFrame(rows, "case_id string, doc_id string, doc_type string, pos int, text string, conf double, x int, y int, w int, h int, line_id int")
    got = {r.field: r.value_raw for r in extract.extract_fields(t).collect()}
    assert got["name"] == "Asha Rao" and got["guardian_name"] == "Ravi Rao" and got["dob"] == "12/03/2004"


def test_store(spark, tmp_path):
    s = store.CaseStore(spark, str(tmp_path / "store"))
    s.save_case("c1", "AMBER", 0.45, "{}")
    s.decide("c1", "dob", "CONFIRMED")
    s.decide("c1", "dob", "DISMISSED")
    assert s.case("c1").first()["triage"] == "AMBER" and s.decisions("c1").first()["status"] == "DISMISSED"
    assert s.audit("c1").count() == 3
    for k in range(3):
        s.compact()
        assert s.case("c1").count() == 1 and s.decisions("c1").first()["status"] == "DISMISSED"
    spark.range(1).write.parquet(str(tmp_path / "store" / "cases" / "v9"))
    (tmp_path / "store" / "cases" / "v9" / "_SUCCESS").unlink()  # a rewrite that broke off doesn't count
    s.save_case("c2", "GREEN", 0.0, "{}")
    assert s.cases().count() == 2
    s.delete_case("c1")
    assert s.cases().count() == 1 and s.audit("c1").count() == 4


def test_evidence(spark):
    docs = docs_of(spark, [("c", 1, "doc_1", "id_card"), ("c", 2, "doc_2", "address_proof"), ("c", 3, "doc_3", "id_card")])
    rows = [("c", "doc_1", "address", "No 1, MG Road", "number 1 mg road", 0.9), ("c", "doc_3", "address", "No 2, MG Road", "number 2 mg road", 0.8)]
    f = fields_of(spark, rows).withColumns({"x": F.lit(1), "y": F.lit(2), "w": F.lit(3), "h": F.lit(4), "source_text_span": F.when(F.col("doc_id") == "doc_1", "Address No 1, MG Road")})
    twice = f.unionByName(f.filter("doc_id = 'doc_1'").withColumn("source_text_span", F.lit(None).cast("string")))  # the entry with a span wins
    s = pipeline.screen_fields(docs, f)
    r = merge.with_evidence(merge.findings(s.merged), docs, twice).filter("field = 'address'").first()
    assert [(e.doc_id, e.doc_type, e.value_raw, e.value_norm, e.ocr_conf, e.source_text_span, e.page) for e in r.evidence] == [
        ("doc_1", "id_card", "No 1, MG Road", "number 1 mg road", 0.9, "Address No 1, MG Road", 1), ("doc_2", "address_proof", "[NOT PRESENT]", "[NOT PRESENT]", 1.0, None, 1),
        ("doc_3", "id_card", "No 2, MG Road", "number 2 mg road", 0.8, None, 1),
    ]
    assert r.bboxes == {"doc_1": [1, 2, 3, 4], "doc_2": None, "doc_3": [1, 2, 3, 4]} and r.values_norm == {"doc_1": "number 1 mg road", "doc_2": "[NOT PRESENT]", "doc_3": "number 2 mg road"}


def test_case_pairs_are_the_joined_pairs(spark):
    docs = docs_of(spark, [("c", k, f"doc_{k}", t) for k, t in ((1, "id_card"), (2, "marksheet"), (3, "address_proof"))] + [("d", 1, "doc_1", "id_card"), ("d", 2, "doc_2", "marksheet"), ("e", 1, "doc_1", "id_card")])
    rows = [(c, f"doc_{k}", n, f"{n}{k}", f"{n}{k}", 0.5 + k / 10) for c in "cde" for k in (1, 2, 3) for n in ("name", "dob", "address", "guardian_name") if (c, k) != ("d", 3) and (k + len(n)) % 3]
    joined, gathered = compare.pair_fields(compare.document_pairs(docs), fields_of(spark, rows)), compare.case_pair_fields(docs, fields_of(spark, rows))
    assert sorted(map(str, joined.select(*gathered.columns).collect())) == sorted(map(str, gathered.collect())) and joined.count() > 8


def test_initial_rules(spark):
    docs = docs_of(spark, [("c", 1, "doc_1", "id_card"), ("c", 2, "doc_2", "marksheet")])
    r = pipeline.screen_fields(docs, fields_of(spark, [("c", "doc_1", "name", "A. Rao", "a rao", 0.9), ("c", "doc_2", "name", "Asha Rao", "asha rao", 0.9)])).merged.first()
    assert r.rule_ids == ["RULE_NAME_INITIAL_EXPAND_A_ASHA", "RULE_NAME_HIGH_SIMILARITY_MATCH"] and r.verdict == "MATCH"


def test_quality(spark):
    import numpy as np

    flat, sharp = np.full((40, 40), 128.0), np.indices((40, 40)).sum(0) % 2 * 255.0
    assert quality.blur(flat) == 0.0 and quality.blur(sharp) > 100
    images = spark.createDataFrame([("c", "d", quality.as_pgm(sharp)), ("c", "e", b"")], "case_id string, doc_id string, content binary")
    got = {r.doc_id: r.is_blurry for r in quality.flags(quality.measure(images)).select("doc_id", "is_blurry").collect()}
    assert got == {"d": False, "e": True}
    assert F.col("x") is not None


def test_reports_read_the_orders_once_for_cases_and_once_for_fields(spark):
    from tallymark.plans import queries

    for name in ("findings_hash", "json_report", "narrative_text", "html_report", "reviewer_questions"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("o_orderpriority") == 2, name  # one scan of orders a branch
