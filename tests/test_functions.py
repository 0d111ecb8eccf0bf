"""Golden values of the normalisers and comparators."""

import pytest
from pyspark.sql import functions as F

from tallymark.functions import addresses, dates, ids, similarity, text


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{c} string" for c in cols)).select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "raw, value, rule",
    [
        ("Mr. Rohit Sharma", "rohit sharma", "RULE_NAME_STRIP_HONORIFIC_MR"), ("Dr. Priya Patel", "patel priya", "RULE_NAME_TOKEN_ORDER_INDEPENDENT"),
        ("Róhït Shármá", "rohit sharma", "RULE_NAME_UNICODE_NFKD"), ("Md. Irfan", "irfan mohammed", "RULE_NAME_VARIANT_MD_TO_MOHAMMED"),
        ("Rohit Sharma S/O Mohan Sharma", "rohit sharma", "RULE_NAME_STRIP_RELATION_S/O"), ("", "", "RULE_EMPTY_NAME"), ("Groß", "gross", "RULE_NAME_CASEFOLD"),
    ],
)
def test_names(spark, raw, value, rule):
    got = one(spark, text.name_parts(F.col("c")), c=raw)
    assert got["value"] == value and rule in got["rules"]
    assert one(spark, text.name_value(F.col("c")), c=raw) == value


@pytest.mark.parametrize(
    "raw, value",
    [
        ("05/06/2002", "2002-06-05"), ("12-03-04", "2004-03-12"), ("12-03-98", "1998-03-12"), ("DOB: 15/08/2000", "2000-08-15"), ("12 Mar 2004", "2004-03-12"), ("March 12, 2004", "2004-03-12"),
        ("2004-02-31", "2004-02-31"), ("", ""), ("12 Foo 2004", "12 foo 2004"),
    ],
)
def test_dates(spark, raw, value):
    assert one(spark, dates.date_value(F.col("c")), c=raw) == value


def test_date_rules(spark):
    assert "RULE_DATE_AMBIGUOUS_DAY_MONTH" in one(spark, dates.date_parts(F.col("c")), c="05/06/2002")["rules"]
    assert "RULE_DATE_PARSE_FAILED" in one(spark, dates.date_parts(F.col("c")), c="12 Foo 2004")["rules"]


@pytest.mark.parametrize(
    "a, b, sim, rule",
    [("2004-03-12", "2004-12-03", 0.7, "SWAP"), ("2004-03-12", "2004-03-15", 0.65, "TYPO"), ("2004-03-12", "2005-03-12", 0.5, "YEAR_OFF"), ("", "", 0.0, "DIFFERENT"), ("2004-03-12", "2004-03-12", 1.0, "EXACT")],
)
def test_compare_dates(spark, a, b, sim, rule):
    for x, y in ((a, b), (b, a)):
        got = one(spark, dates.compare_dates(F.col("a"), F.col("b")), a=x, b=y)
        assert got["similarity"] == sim and rule in got["rule"]


def test_address(spark):
    got = one(spark, addresses.components(addresses.address_value(F.col("c"))), c="No 45, Brigade Road, Bengaluru - 560025")
    assert (got["house_number"], got["street_locality"], got["city"], got["pincode"]) == ("number 45", "brigade road", "bengaluru", "560025")
    assert one(spark, addresses.address_value(F.col("c")), c="Hno 7, MG Rd, Blr") == "house number 7 mg road bengaluru"
    assert one(spark, addresses.components(addresses.address_value(F.col("c"))), c="")["pincode"] == ""


@pytest.mark.parametrize("raw, value", [("9I45l012", "91451012"), ("98S45S12", "98545512"), ("9B45B012", "98458012")])
def test_id_digits(spark, raw, value):
    assert one(spark, ids.id_value(F.col("c"), True), c=raw) == value


def test_ids(spark):
    assert one(spark, ids.id_value(F.col("c")), c="DL-1420-1100-1234") == "DL142011001234"
    assert one(spark, ids.mask_for_model(F.col("c")), c="12345678") == "****5678"
    assert one(spark, ids.mask_for_model(F.col("c")), c="123") == "****"
    assert one(spark, ids.id_doc_type(F.col("c")), c="ROLL-123") == "marksheet"


def test_similarity():
    assert round(similarity.token_set_ratio("kohli tanvi", "aarav kohli"), 1) == 72.7
    assert similarity.token_set_ratio("k soni", "kala soni") == 80
    assert round(similarity.token_set_ratio("pillay road yamunanagar", "station road 40056"), 2) == 39.02
    assert similarity.ratio("fathers name", "father's name") == 96.0
    assert round(similarity.ratio("consumer no", "consumer name"), 1) == 83.3
    assert round(similarity.jaro_winkler("martha", "marhta"), 4) == 0.9611
    assert similarity.metaphone("thumb") == "0M" and similarity.metaphone("knight")[0] == "N"
    assert similarity.lcs("", "x") == 0


def test_dates_by_spelling(spark):
    from tallymark.functions import dates

    rows = [("2004-03-12",), ("12/03/2004",), ("12-Mar-2004",), ("March 12, 2004",), ("DOB: 12.03.04",), (None,), ("",), ("\u00e9t\u00e9 12 mars 2004 \u00e9",), ("12/03/2004",)]
    df = spark.createDataFrame(rows, "raw string")
    got = dates.with_date_parts(df, "raw", "p").select("raw", "p.value").collect()
    want = {"2004-03-12": "2004-03-12", "12/03/2004": "2004-03-12", "12-Mar-2004": "2004-03-12", "March 12, 2004": "2004-03-12", "DOB: 12.03.04": "2004-03-12", None: "", "": "", "\u00e9t\u00e9 12 mars 2004 \u00e9": "ete 12 mars 2004 e"}
    assert len(got) == len(rows) and {r.raw: r.value for r in got} == want
