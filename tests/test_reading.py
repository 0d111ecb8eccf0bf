"""Pages read in Arrow batches: the fields are those of the native form, and an odd page reads the same."""

import random

import pytest
from pyspark.sql import functions as F

from tallymark.functions import labels
from tallymark.operators import extract, reading
from tallymark.plans import queries as q
from test_extract import ALL_LABELS, TOKENS, page, spoiled

ODD = ["İstanbul", "é560001", "é 560002", "²12/03/2004", "१२/03/2004", "AB 1234567", "CD\t123456", "12-date-2004", "1.2.004", "Straße", "\x1cName:", "D́OB", "", " ", ":", "-", None, "marksheet", "ΟΔΟΣ"]


def odd_page(r):
    rows = [list(t) for t in page(r)]
    for row in rows:
        if r.random() < 0.15:
            row[0] = r.choice(ODD)
        if r.random() < 0.03:
            row[r.choice((2, 3))] = None
    return rows


@pytest.mark.parametrize("typed", [True, False])
def test_fields_are_those_of_the_native_form(spark, typed):
    r = random.Random(23)
    rows = [(f"c{d % 40}", f"doc_{d}", r.choice(["id_card", "marksheet", None]), p, *t) for d in range(300) for p, t in enumerate(odd_page(r))]
    rows += [("c", "twice", "id_card", 0, w, 0.8125, 10, 20, 9, 9, None) for w in ("Name:", "Asha", "Asha")]  # places that are no order
    t = spark.createDataFrame(rows, TOKENS)
    t = t if typed else t.drop("doc_type")
    kinds = {x.doc_id: x.doc_type for x in extract.pages(t).select("doc_id", "doc_type").collect()}
    t = t if not typed else t.drop("doc_type").join(spark.createDataFrame(list(kinds.items()), "doc_id string, doc_type string"), "doc_id")
    want = extract.found_fields(extract.pages(t)).select("case_id", "doc_id", "doc_type", F.size("read").alias("n_tokens"), "fields").collect()
    got = extract.read_pages(t).select("case_id", "doc_id", "doc_type", "n_tokens", "fields").collect()
    by_doc = lambda rows: {(x.case_id, x.doc_id): x.asDict(True) for x in rows}
    a, b = by_doc(got), by_doc(want)
    assert len(b) > 280 and sum(len(x["fields"]) for x in b.values()) > 500 and {k: (a.get(k), b[k]) for k in b if a.get(k) != b[k]} == {} and len(a) == len(b)


def test_labels_are_those_of_the_native_form(spark):
    r = random.Random(29)
    texts = sorted({labels_clean for labels_clean in (spoiled(r, r.choice(ALL_LABELS)).strip(" ") for _ in range(3000)) if labels_clean})
    match = reading.Matcher(labels.DEFAULT).match
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {x.t: x.f for x in df.select("t", labels.DEFAULT.match_cleaned(F.col("t")).alias("f")).collect()}
    assert {t: match(t) for t in texts} == got and sum(f is not None for f in got.values()) > 500


@pytest.mark.parametrize("name", ["label_proximity", "pattern_fields", "case_trace", "screened_native", "eval_extraction"])
def test_pages_are_read_in_batches(spark, name):
    plan = q.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan


def test_retries_make_the_first_reading_once(spark):
    """And the documents that are read again are chosen before they unfold to tokens."""
    t = q.synthetic_tokens(spark, "/root/testdata/sf0.001")
    plans = []

    def keep(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return df.localCheckpoint()

    def attempt(k, docs):
        return extract.extract_fields(q.synthetic_tokens(spark, "/root/testdata/sf0.001", docs).withColumn("doc_type", F.lit("unknown")))

    docs = t.select("case_id", "doc_id").distinct()
    out = extract.retry_rounds(docs, extract.extract_fields(t), attempt, rounds=1, keep=keep)
    assert plans[0].count("MapInArrow") == 1
    again = out._jdf.queryExecution().optimizedPlan().toString()
    assert again.index("Generate posexplode") < again.index("LeftSemi")  # nearer to the root: later
    few = docs.orderBy("case_id", "doc_id").limit(7).localCheckpoint()
    key = ["case_id", "doc_id", "pos"]
    assert q.synthetic_tokens(spark, "/root/testdata/sf0.001", few).orderBy(*key).collect() == t.join(few, ["case_id", "doc_id"], "left_semi").select(*t.columns).orderBy(*key).collect()
