"""Tokens are gathered once and read in place: the lines and labels are those of the windows."""

import random

from pyspark.sql import functions as F

from tallymark.operators import extract
from tallymark.plans import queries as q


def test_a_page_is_read_without_windows(spark):
    for name in ("label_proximity", "pattern_fields"):
        plan = q.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan


def test_lines_in_place_are_those_of_windows(spark):
    draw = random.Random(7)
    words = ["Full", "Name:", "Date", "of", "Birth:", "dob", "Father's", "Roll", "No", "Asha", "", ":", "12/03/2004", "Addres", "Namee", None]
    rows = []
    for case in range(60):
        for pos in range(draw.choice((1, 2, 9, 30))):
            x, y = draw.choice((None, draw.randrange(0, 90, 10))), draw.choice((None, draw.randrange(0, 90, 7)))
            rows.append((f"c{case // 2}", f"doc_{case % 2}", "id_card", pos, draw.choice(words), 0.9, x, y, 20, 18, draw.choice((None, pos))))
    t = spark.createDataFrame(rows, "case_id string, doc_id string, doc_type string, pos int, text string, conf double, x int, y int, w int, h int, line_id int")
    cols = ["case_id", "doc_id", "line_no", "token_no", "pos", "text", "f1", "f2", "f3"]
    want = extract.labelled(t, ["case_id", "doc_id"]).select(*cols).collect()
    unfolded = extract.pages(t).select("case_id", "doc_id", F.explode(F.flatten("lines")).alias("t")).select("case_id", "doc_id", "t.*").select(*cols).collect()
    assert len(want) == len(rows) and sorted(map(repr, map(tuple, unfolded))) == sorted(map(repr, map(tuple, want)))
    assert any(r.f1 for r in want) and any(r.f2 for r in want) and any(r.f3 for r in want)
