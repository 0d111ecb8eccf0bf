"""From tokens to triage: sample cases of six kinds, retries, traces, mixes."""

import pytest
from pyspark.sql import functions as F

from tallymark.operators import extract, trace
from tallymark.plans import pipeline
from tallymark.sources import mix

TOKENS = "case_id string, doc_id string, doc_no int, pos int, text string, conf double, x int, y int, w int, h int, line_id int"
CARD = (("Full Name:", "name"), ("Father's Name:", "guardian"), ("Date of Birth:", "dob"), ("ID Number:", "id"), ("Address:", "address"), ("Issue Date:", "issued"))
BILL = (("Consumer Name:", "name"), ("Consumer No:", "id"), ("Service Address:", "address"), ("Bill Date:", "issued"))
SHEET = (("Candidate Name:", "name", 45, 115), ("Roll Number:", "id", 340, 115), ("Father Name:", "guardian", 45, 147), ("Date of Birth:", "dob", 340, 147), ("Institution Code:", "school", 45, 179), ("Exam Year:", "year", 340, 179))


def scanned(case, doc_no, kind, values, conf=0.96):
    """Token rows of a document in the layout of its kind; a label and its value are one line of the recogniser."""
    title = {"card": "Identity Card", "sheet": "Statement of Marks", "bill": "Electricity Bill"}[kind]
    lines = [(title, "", 50, 30)]
    if kind == "sheet":
        lines += [(t, values.get(f, ""), x, y) for t, f, x, y in SHEET]
    else:
        lines += [(t, values[f], 45, 90 + 38 * k) for k, (t, f) in enumerate(CARD if kind == "card" else BILL) if f in values]
    rows = []
    for line, (label, value, x, y) in enumerate(lines):
        for k, w in enumerate([label, *value.split()]):
            rows.append((case, f"doc_{doc_no}", doc_no, len(rows), w, conf, x + (0 if k == 0 else 130 + 55 * (k - 1)), y, max(20, 9 * len(w)), 20, line))
    return rows


PERSON = {"name": "Meera Iyer", "guardian": "Anand Iyer", "dob": "14-08-1999", "id": "IND-48210734", "address": "No 14, Temple Road, Bengaluru - 560004", "issued": "2021-02-02"}
SHEET_OF = PERSON | {"id": "ROLL-771204", "school": "COLL-7", "year": "2017", "dob": "14/08/1999"}
BILL_OF = PERSON | {"id": "CON-5512093", "issued": "2023-03-03"}


def case(spark, name, card=PERSON, sheet=SHEET_OF, bill=BILL_OF, confs=(0.96, 0.96, 0.96)):
    rows = scanned(name, 1, "card", card, confs[0]) + scanned(name, 2, "sheet", sheet, confs[1]) + scanned(name, 3, "bill", bill, confs[2])
    return spark.createDataFrame(rows, TOKENS)


CASES = {
    "consistent": {},
    "benign": {"sheet": SHEET_OF | {"name": "IYER MEERA"}, "bill": BILL_OF | {"name": "M. Iyer", "address": "No. 14 Temple Rd, Blr 560004"}},
    "mismatch": {"sheet": SHEET_OF | {"dob": "17/08/1999"}, "bill": BILL_OF | {"address": "No 14, Temple Road, Bengaluru - 560504"}},
    "degraded": {"confs": (0.75, 0.58, 0.75)},
    "name": {"bill": BILL_OF | {"name": "Rohan Kapoor"}},
    "address": {"bill": BILL_OF | {"address": "Flat 9, Lake View, Mumbai - 400076"}},
}


@pytest.fixture(scope="module")
def outcomes(spark):
    """All sample cases screened at once: risk, findings by field, fields by document."""
    tokens = None
    for name, changes in CASES.items():
        one = case(spark, name, **changes)
        tokens = one if tokens is None else tokens.unionByName(one)
    s = pipeline.screen_tokens(tokens)
    risks, found, fields = s.risks.collect(), s.findings.collect(), s.fields.collect()
    return {n: (next(r for r in risks if r.case_id == n), {f.field: f for f in found if f.case_id == n}, {(f.doc_id, f.field): f for f in fields if f.case_id == n}) for n in CASES}


def test_consistent(outcomes):
    risk, found, fields = outcomes["consistent"]
    assert (risk.triage, risk.n_findings) == ("GREEN", 0) and risk.risk_score == 0 and not found
    assert {d: {f for x, f in fields if x == d} for d in ("doc_1", "doc_2", "doc_3")} == {
        "doc_1": {"name", "guardian_name", "dob", "id_number", "address", "issue_date"}, "doc_2": {"name", "guardian_name", "dob", "id_number"}, "doc_3": {"name", "id_number", "address", "issue_date"},
    }
    assert {r.doc_type for r in fields.values()} == {"id_card", "marksheet", "address_proof"}
    assert {r.method for r in fields.values()} == {"label_proximity"} and fields["doc_2", "dob"].value_norm == "1999-08-14"


def test_benign_spellings(outcomes):
    risk, found, _ = outcomes["benign"]
    assert risk.triage == "GREEN" and not [f for f in found.values() if f.verdict == "MISMATCH"] and set(found) <= {"name", "address"}


def test_two_errors(outcomes):
    risk, found, _ = outcomes["mismatch"]
    assert risk.triage in ("RED", "AMBER") and found["dob"].verdict == "MISMATCH" and found["address"].verdict in ("MISMATCH", "MINOR_VARIANT")
    assert "id_number" not in found and "issue_date" not in found


def test_degraded_scan(outcomes):
    risk, found, _ = outcomes["degraded"]
    assert risk.triage in ("GREEN", "AMBER") and found and {f.verdict for f in found.values()} == {"LOW_CONFIDENCE"}


def test_another_name(outcomes):
    risk, found, _ = outcomes["name"]
    assert risk.triage in ("RED", "AMBER") and found["name"].verdict == "MISMATCH" and found["name"].severity == "HIGH"


def test_another_address(outcomes):
    risk, found, _ = outcomes["address"]
    assert risk.triage in ("RED", "AMBER") and found["address"].verdict == "MISMATCH" and set(found) == {"address"}


def test_document_without_any_field(spark):
    t = case(spark, "odd").unionByName(spark.createDataFrame([("odd", "scan", 4, 0, "illegible", 0.3, 5, 5, 50, 18, 0)], TOKENS))
    s = pipeline.screen_tokens(t)
    assert {r.doc_id: r.doc_type for r in s.documents.collect()}["scan"] == "unknown" and s.risks.count() == 1
    alone = pipeline.screen_tokens(t.filter("doc_id = 'scan'"))
    assert [(r.case_id, r.triage) for r in alone.risks.collect()] == [("odd", "GREEN")]


@pytest.mark.parametrize("until", [False, True])
def test_retry_rounds(spark, until):
    docs = spark.createDataFrame([("c", "d1"), ("c", "d2")], "case_id string, doc_id string")
    schema = "case_id string, doc_id string, field string, value_raw string, ocr_conf double"
    start = [("c", "d1", "name", "A", 0.5), ("c", "d1", "dob", "B", 0.9), ("c", "d1", "address", "C", 0.7), ("c", "d1", "id_number", "D", 0.2)] + [("c", "d2", f, "E", 0.8) for f in ("name", "dob", "address")]
    rounds = {1: [("c", "d1", "name", "A1", 0.5), ("c", "d1", "dob", "B1", 0.99), ("c", "d1", "id_number", "D1", 0.3)], 2: [("c", "d1", "name", "A2", 0.6), ("c", "d1", "id_number", "D2", 0.9), ("c", "d2", "id_number", "F", 0.4)], 3: [("c", "d1", "name", "A3", 0.95), ("c", "d2", "id_number", "G", 0.9)]}
    asked = []

    def attempt(k, open_docs):
        asked.append(open_docs)
        return spark.createDataFrame(rounds[k], schema).join(open_docs, ["case_id", "doc_id"], "left_semi")

    fields = spark.createDataFrame(start, schema)
    out = extract.retry_rounds(docs, fields, attempt, rounds=3, until_confident=until)
    got = {(r.doc_id, r.field): (r.value_raw, r.ocr_conf, r.initial_conf, r.tried, r.improved_by) for r in out.collect()}
    if until:
        assert got == {("d1", "name"): ("A3", 0.95, 0.5, 3, 3), ("d1", "id_number"): ("D2", 0.9, 0.2, 2, 2), ("d2", "id_number"): ("G", 0.9, 0.0, 3, 3)}
    else:
        assert got == {("d1", "name"): ("A2", 0.6, 0.5, 2, 2), ("d1", "id_number"): ("D1", 0.3, 0.2, 1, 1), ("d2", "id_number"): ("F", 0.4, 0.0, 2, 2)}
        assert [sorted(r.doc_id for r in a.collect()) for a in asked] == [["d1", "d2"], ["d1", "d2"], []]
    whole = {(r.doc_id, r.field): r.value_raw for r in extract.with_retries(fields, out).collect()}
    assert len(whole) == 8 and whole["d1", "dob"] == "B" and whole["d2", "id_number"] == got["d2", "id_number"][0]
    said = {r.args_summary: r.result_summary for r in trace.retry_steps(out).collect()}
    assert len(said) == 3 and any(x.startswith("Confidence improved from 0.50 to") for x in said.values())


def test_metrics_of_a_run(spark):
    s = pipeline.screen_tokens(case(spark, "metrics", sheet=SHEET_OF | {"dob": "17/08/1999"}))
    merged, seen = trace.observed(s.merged, "merged", *trace.verdict_counts())
    assert merged.count() == 4  # a field that only one document has, or ids of several kinds, are compared with nothing
    assert seen.get["rows"] == 4 and seen.get["mismatch"] == 1 and "mismatch=1" in trace.summary(seen)


def test_exact_mix_whatever_the_layout(spark):
    kinds = ["consistent", "benign", "error_single", "error_multi", "degraded", "other", None]
    df = spark.createDataFrame([(k, kinds[k % 7], "x") for k in range(600)] + [(7_000 + k, "degraded", "x") for k in range(3)], "case_id bigint, kind string, split_ string")
    got = [sorted(map(tuple, mix.exact_mix(df.repartition(n)).collect())) for n in (1, 7)]
    assert got[0] == got[1] and len({r[0] for r in got[0]}) == len(got[0]) == 58
    for split, m in mix.MIX.items():
        rows = [r for r in got[0] if r[3] == split]
        assert sorted(r[4] for r in rows) == list(range(1, sum(m.values()) + 1)) and {k: sum(r[1] == k for r in rows) for k in m} == m
    few = mix.exact_mix(df.filter("case_id < 10"))
    assert few.count() == 8 and mix.exact_mix(df.limit(0)).count() == 0


def test_order_of_documents_is_the_tokens_own(spark):
    t = case(spark, "order").withColumn("doc_no", 4 - F.col("doc_no"))
    s = pipeline.screen_tokens(t)
    assert {(r.doc_a, r.doc_b) for r in s.verdicts.collect()} <= {("doc_3", "doc_2"), ("doc_3", "doc_1"), ("doc_2", "doc_1")}
