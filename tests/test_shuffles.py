"""What crosses the network: texts and documents before they unfold to tokens, never the tokens."""

import pytest

from tallymark import config as C
from tallymark.operators import classify
from tallymark.plans import queries as q


def exchanges(df) -> list:
    """For each shuffle of the plan, whether a generator has unfolded rows below it."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-*(0123456789)"))
    out = []
    for k, line in enumerate(plan):
        if "Exchange hashpartitioning" in line:
            below = []
            for x in plan[k + 1 :]:
                if depth(x) <= depth(line):
                    break
                below.append(x)
            out.append(any("Generate posexplode" in x for x in below))
    return out


@pytest.mark.parametrize("name", ["token_lines", "line_boxes", "label_scan", "label_proximity", "pattern_fields"])
def test_tokens_are_not_shuffled(spark, name):
    found = exchanges(q.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert found and not any(found)


def test_words_of_types_are_read_in_one_pass(spark):
    words = sorted({w for kinds in (C.PRIMARY, C.SECONDARY) for ws in kinds.values() for w in ws})
    texts = [*words, "", "xuidaix", "marksheets", "roll no.", "date of birthdate", " ".join(words), "account numberpassbook account", *(a[:-1] + b for a, b in zip(words, words[7:]))]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r["text"]: {e["doc_type"]: e["score"] for e in r["s"]} for r in rows.select("text", classify.type_scores(rows["text"]).alias("s")).collect()}
    for t in texts:
        assert got[t] == {k: sum(5 for w in C.PRIMARY[k] if w in t) + sum(2 if " " in w else 1 for w in C.SECONDARY[k] if w in t) for k in C.PRIMARY}, t
    assert rows.select(classify.type_scores(rows["text"]))._jdf.queryExecution().executedPlan().toString().lower().count("contains(") == 0
