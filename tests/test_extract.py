"""Native extraction against the plain reading of ``reading.py``; labels against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

import reading
from tallymark import config as C
from tallymark.functions import labels
from tallymark.functions.similarity import lcs, ratio
from tallymark.operators import classify, extract
from tallymark.sources import tokens as token_source

TOKENS = "case_id string, doc_id string, doc_type string, pos int, text string, conf double, x int, y int, w int, h int, line_id int"
ALL_LABELS = [n for names in C.LABELS.values() for n in names]


def spoiled(r, s):
    s = list(s)
    for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
        at = r.randrange(len(s) + 1)
        kind = r.randrange(3)
        if kind == 0:
            s.insert(at, r.choice("abcdeomn 1é"))
        elif at < len(s):
            s[at : at + 1] = [] if kind == 1 else [r.choice("aeiorn0")]
    return "".join(s)


def page(r):
    """Tokens of an odd page: labels well and badly spelled, separators, values, dates, codes, all in places that nearly make lines."""
    rows, y = [], 20
    for line in range(r.randint(1, 9)):
        x = r.choice([10, 10, 40])
        for _ in range(r.randint(0, 3)):
            label = spoiled(r, r.choice(ALL_LABELS)).title()
            words = [label + r.choice([":", "", " :"])] if r.random() < 0.4 else label.split()
            words += r.choice([[":"], ["-"], []]) + r.choice([
                [], ["Asha", "Rao"], ["12/03/2004"], ["12", "Mar", "2004"], ["45.13.2004", "7-8-99"], ["IND-00123456"], ["AB", "1234567"], ["No", "5,", "MG", "Road", "560001"], ["Roll", "No", "560002"],
                ["pin-560003", "x560004", "560005,", "near", "town"], [": x"], ["--"], ["date"], ["Marks"],
            ])
            for w in words:
                rows.append((w, round(r.uniform(0.4, 1), 2), x, y + r.randint(-4, 4), max(20, len(w) * 9), 18, r.choice([line, line, line, None])))
                x += r.choice([0, 60, 60])
        y += r.choice([6, 16, 18, 26, 40])
    if r.random() < 0.2:
        rows.append(("Marksheet", 0.9, 5, 1, 50, 18, 99))
    r.shuffle(rows) if r.random() < 0.2 else None
    return rows


def test_fields_equal_the_plain_reading(spark):
    r = random.Random(11)
    docs = {f"doc_{k}": (page(r), r.choice(["id_card", "marksheet", "address_proof"])) for k in range(400)}
    rows = [("c", d, kind, p, *t) for d, (ts, kind) in docs.items() for p, t in enumerate(ts)]
    got = extract.extract_fields(spark.createDataFrame(rows, TOKENS))
    seen = {(x.doc_id, x.field): tuple(x)[4:] for x in got.collect()}
    want = {(d, f): v for d, (ts, kind) in docs.items() if ts for f, v in reading.fields(ts, kind).items()}
    assert len(want) > 800 and {v[6 - 1] for v in want.values()} - {None} and {v[6] for v in want.values()} == {"label_proximity", "regex", "regex_pin_context", "regex_id"}
    assert got.columns[4:] == ["value_raw", "ocr_conf", "x", "y", "w", "h", "method", "source_text_span", "line_x", "line_y", "line_w", "line_h", "source_line_conf"]
    rounded = lambda m: {k: tuple(round(x, 2) if isinstance(x, float) else x for x in v) for k, v in m.items()}
    a, b = rounded(seen), rounded(want)
    assert {k: (a.get(k), b.get(k)) for k in a.keys() | b.keys() if a.get(k) != b.get(k) and not all(near(x, y) for x, y in zip(seen.get(k, ()), want.get(k, ()), strict=True))} == {}


def near(x, y):
    return abs(x - y) < 0.0015 if isinstance(x, float) and isinstance(y, float) else x == y


@pytest.mark.parametrize("seed", [1, 2])
def test_labels_equal_brute_force(spark, seed):
    r = random.Random(seed)
    texts = [None, "", " ", "!!", "S/O", "d.o.b.", "D.O.B", "ﬁrst name"] + [spoiled(r, r.choice(ALL_LABELS)) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "gram string")
    want = {t: reading.match_label(t) for t in texts if t}
    assert len([f for f in want.values() if f]) > 400 and len([f for f in want.values() if not f]) > 200
    assert {x.gram: x.f for x in df.select("gram", labels.match_label(F.col("gram")).alias("f")).collect() if x.gram} == want
    joined = labels.fuzzy_join(df, labels.label_table(spark))
    assert joined.columns == ["gram", "field"]
    assert sorted({(x.gram, x.field) for x in joined.collect()}) == sorted((t, f) for t, f in want.items() if f)


def test_fuzzy_join_with_a_dictionary_of_its_own(spark):
    r = random.Random(3)
    names = ["".join(r.choice("abcde ") for _ in range(r.randint(1, 25))).strip() or "a" for _ in range(400)]
    table = spark.createDataFrame([(n, f"f{k % 7}", k % 5) for k, n in enumerate(names)] + [(None, "f", 0), ("", "f", 0), ("x" * 80, "f", 0)], "label string, field string, priority int")
    texts = [spoiled(r, r.choice(names)) for _ in range(300)] + [None, "", "x" * 80]
    got = {(x.gram, x.field) for x in labels.fuzzy_join(spark.createDataFrame([(t,) for t in texts], "gram string"), table, least=80.0).collect()}
    want = set()
    for t in texts:
        clean = (t or "").strip()
        fits = [(k % 5, n, f"f{k % 7}") for k, n in enumerate(names) if clean and ratio(clean, n) >= 80]
        best = min(fits, default=None)
        if best:
            tied = {f for p, n, f in fits if (p, n) == best[:2]}
            want.add((t, next(f for g, f in got if g == t) if any(g == t and f in tied for g, f in got) else best[2]))
    assert got == want and len(want) > 250
    assert labels.fuzzy_join(table.select(F.col("label").alias("gram")), table.limit(0)).collect() == []


def test_common_subsequence_by_bits(spark):
    r = random.Random(4)
    pairs = [("".join(r.choice("abc") for _ in range(r.randint(0, 60))), "".join(r.choice("abc") for _ in range(r.randint(1, 60)))) for _ in range(50)]
    for a, b in pairs:
        places = F.create_map(*[x for k, v in labels.places_of(b).items() for x in (F.lit(k), F.lit(v).cast("long"))])
        df = spark.range(1).select(labels.lcs_length(labels.letters_of(F.lit(a)), places, F.lit((1 << len(b)) - 1).cast("long"), F.lit(len(b))).alias("n"))
        assert df.first().n == lcs(a, b)
        break
    cols = [labels.lcs_length(labels.letters_of(F.lit(a)), F.create_map(*[x for k, v in labels.places_of(b).items() for x in (F.lit(k), F.lit(v).cast("long"))]), F.lit((1 << len(b)) - 1).cast("long"), F.lit(len(b))).alias(f"c{k}") for k, (a, b) in enumerate(pairs)]
    assert list(spark.range(1).select(*cols).first()) == [lcs(a, b) for a, b in pairs]


def test_patterns_in_running_text(spark):
    rows = [("born 45/13/2004 then 12 Mar 2004 and 1.2.03",), ("99-99-9999",), (None,), ("",)]
    got = spark.createDataFrame(rows, "t string").select(extract.first_date(F.col("t")).alias("d"), extract.first_identifier(F.col("t")).alias("i")).collect()
    assert [x.d for x in got] == ["12 Mar 2004", None, None, None] and {x.i for x in got} == {None}


def test_pages_of_many_tokens_and_empty_tables(spark):
    many = [("c", "d", "id_card", k, f"w{k}", 0.9, k * 10, 20, 9, 9, 0) for k in range(3000)] + [("c", "d", "id_card", 3000, "Name:", 0.9, 40_000, 20, 9, 9, 1), ("c", "d", "id_card", 3001, "Asha", 0.8, 40_100, 20, 9, 9, 1)]
    got = extract.extract_fields(spark.createDataFrame(many, TOKENS)).collect()
    assert [(x.field, x.value_raw, x.ocr_conf, x.source_text_span) for x in got] == [("name", "Asha", 0.8, "Name: Asha")]
    assert extract.extract_fields(spark.createDataFrame([], TOKENS)).collect() == []


def test_text_tokens_have_lines(spark):
    docs = spark.createDataFrame([(1, "Name: Asha\nDate of Birth 12/03/2004"), (2, None)], "doc_id bigint, text string")
    t = token_source.text_tokens(docs).select(F.lit("c").alias("case_id"), F.col("doc_id").cast("string").alias("doc_id"), (F.col("row") * 1000 + F.col("col")).alias("pos"), "text", "conf", "x", "y", "w", "h", F.col("row").alias("line_id"))
    assert {(x.field, x.value_raw, x.doc_type) for x in extract.extract_fields(t).collect()} == {("name", "Asha", "unknown"), ("dob", "12/03/2004", "unknown"), ("issue_date", "of Birth 12/03/2004", "unknown")}


def test_label_pattern_keeps_every_label(spark):
    """Labels with letters gone, added and changed: the pattern lets every text pass that is alike enough, and the field is the first alike label's."""
    rnd, entries = random.Random(7), labels.DEFAULT.entries()
    texts = {n for n, _ in entries}
    for n, _ in entries:
        for _ in range(40):
            s = list(n)
            for _ in range(rnd.randint(1, 4)):
                at = rnd.randrange(len(s) + 1)
                if rnd.random() < 0.5 and len(s) > 1:
                    del s[min(at, len(s) - 1)]
                else:
                    s.insert(at, rnd.choice("abenor x7é"))
            texts.add("".join(s))
    texts = sorted({t for t in (re.sub(r"[^\w\s]", "", t).strip(" ") for t in texts) if t})
    want = {t: next((f for n, f in entries if 200 * labels._lcs(t, n) >= 88 * (len(t) + len(n))), None) for t in texts}
    got = {r.t: r.f for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", labels.match_label(F.col("t")).alias("f")).collect()}
    assert got == want and sum(f is not None for f in want.values()) > 500


def test_text_is_lowered_once(spark, capsys):
    """A text's class is worked out once, outside of the branches that use it; its lower case too, not once a word that is looked for."""
    classify.classify(spark.createDataFrame([("identity card",)], "text string")).explain("extended")
    optimised = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert optimised.count("lower(") == 1


def test_codes_are_looked_back_from_only_where_they_stand():
    assert extract.PIN.index("(?=[1-9]") < extract.PIN.index("(?<=(")


def test_pin_windows_of_neighbouring_codes(spark):
    words = "Near Lake Road 560001 560002 Acc 560003 x-560004".split()
    row = spark.createDataFrame([(" ".join(words), [(w,) for w in words])], "whole string, read array<struct<text:string>>")
    assert [t.text for t in row.select(extract.pin_window(F.col("whole"), F.col("read")).alias("w")).first().w] == words[:5]
    codes = row.select(F.regexp_extract_all("whole", F.lit(extract.PIN), F.lit(2)), F.regexp_extract_all("whole", F.lit(extract.PIN), F.lit(1))).first()
    assert list(codes) == [["560001", "560002", "560003"], ["Near Lake Road ", "ke Road 560001 ", "001 560002 Acc "]]
