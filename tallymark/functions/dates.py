"""Dates: many spellings to ISO text, day first, without a calendar check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from .text import _rule, fold_marks, let

# The four spellings that are read, in this order, and what may stand between their parts.
NAMED = r"\b(\d{1,2})[-/\s.,]+([a-z]{3,9})[-/\s.,]+(\d{2,4})\b"
NAMED_FIRST = r"\b([a-z]{3,9})[-/\s.,]+(\d{1,2})[-/\s.,]+(\d{2,4})\b"
ISO = r"\b(\d{4})[-/. ](\d{1,2})[-/. ](\d{1,2})\b"
SEPARATORS = r"[-/\s.,]+"
DAY_FIRST = r"\b(\d{1,2})[-/. ](\d{1,2})[-/. ](\d{2,4})\b"


def date_cleaned(raw: Column) -> Column:
    def clean(low: Column, flag: str) -> Column:
        bare = F.regexp_replace(low, flag + r"\b(dob|date of birth|birth date|d\.o\.b|date|dt)\b[:\s]*", "")
        return F.regexp_replace(bare, flag + r"^\W+|\W+$", "")

    # most dates are ASCII: marks are folded, and letters beyond it known, only where there are any
    plain = clean(F.lower(F.trim(raw)), "")
    return F.when(raw.rlike(r"[^\x00-\x7F]"), clean(F.lower(fold_marks(F.trim(raw))), "(?U)")).otherwise(plain)


#: The spellings of almost all dates, which need no cleaning: they are cut by place, in generated code.
PLAIN_ISO, PLAIN_DMY, PLAIN_NAMED = r"^\d{4}-\d{2}-\d{2}$", r"^\d{2}/\d{2}/\d{4}$", rf"(?i)^\d{{2}}-({'|'.join(m for m in C.MONTHS if len(m) == 3)})-\d{{4}}$"


def date_parts(raw: Column) -> Column:
    """struct(value, rules): ISO text, or the cleaned text with RULE_DATE_PARSE_FAILED."""
    at = lambda a, n: F.substring(raw, a, n)
    number = lambda c: c.cast("int")
    good = lambda d, m, y: number(m).between(1, 12) & number(d).between(1, 31) & number(y).between(1900, 2035)
    rules = lambda *names: F.array(*[F.lit(f"RULE_DATE_{n}") for n in sorted(names)])
    made = lambda value, trace: F.struct(value.alias("value"), trace.alias("rules"))

    def placed(d: Column, m: Column, y: Column, iso: Column, plain: Column, *names: str) -> Column:
        return F.when(good(d, m, y), made(iso, rules(*names, "ISO8601_CANONICAL"))).otherwise(made(plain, rules(*names, "PARSE_FAILED")))

    y, m, d = at(7, 4), at(4, 2), at(1, 2)
    either = (number(d) <= 12) & (number(m) <= 12) & (number(d) != number(m))
    dashed = F.concat(y, F.lit("-"), m, F.lit("-"), d)
    month = F.lpad(((F.call_function("position", F.lower(at(4, 3)), F.lit("".join(k for k in C.MONTHS if len(k) == 3))) + 2) / 3).cast("int").cast("string"), 2, "0")
    return (
        F.when(raw.rlike(PLAIN_ISO), placed(at(9, 2), at(6, 2), at(1, 4), raw, raw, "ISO_PARSE"))
        .when(raw.rlike(PLAIN_DMY), F.when(either, placed(d, m, y, dashed, raw, "DAY_FIRST_PARSE", "AMBIGUOUS_DAY_MONTH")).otherwise(placed(d, m, y, dashed, raw, "DAY_FIRST_PARSE")))
        .when(raw.rlike(PLAIN_NAMED), placed(d, month, at(8, 4), F.concat(at(8, 4), F.lit("-"), month, F.lit("-"), d), F.lower(raw), "NAMED_MONTH_PARSE"))
        .otherwise(any_date_parts(raw))
    )


def any_date_parts(raw: Column) -> Column:
    """The same by the general rules, for whatever spelling."""
    month_of = F.create_map(*[F.lit(x) for kv in C.MONTHS.items() for x in kv])
    number = lambda c: F.get(c[0], F.lit(c[1])).cast("int")

    def judge(t: Column, k: Column) -> Column:
        kind, p = k["kind"], k["p"]
        day = F.when(kind.isin("named", "dmy"), number((p, 0))).when(kind == "first", number((p, 1))).otherwise(number((p, 2)))
        month = F.when(kind == "named", F.element_at(month_of, F.get(p, F.lit(1)))).when(kind == "first", F.element_at(month_of, F.get(p, F.lit(0)))).otherwise(number((p, 1)))
        year = F.when(kind == "iso", number((p, 0))).otherwise(number((p, 2)))
        return let(F.struct(day.alias("d"), month.alias("m"), year.alias("y0"), F.when((kind != "iso") & (year < 100), F.when(year <= 30, year + 2000).otherwise(year + 1900)).otherwise(year).alias("y")), lambda v: final(t, kind, v))

    def final(t: Column, kind: Column, v: Column) -> Column:
        good = F.coalesce(v["m"].between(1, 12) & v["d"].between(1, 31) & v["y"].between(1900, 2035), F.lit(False))
        rule = lambda cond, name: _rule(cond, f"RULE_DATE_{name}")
        known = v["m"].isNotNull()
        trace = F.concat(
            rule((kind == "named") & known, "NAMED_MONTH_PARSE"), rule((kind == "first") & known, "NAMED_MONTH_PREFIX_PARSE"), rule(kind == "iso", "ISO_PARSE"), rule(kind == "dmy", "DAY_FIRST_PARSE"),
            rule((kind == "dmy") & (v["d"] <= 12) & (v["m"] <= 12) & (v["d"] != v["m"]), "AMBIGUOUS_DAY_MONTH"), rule((v["y0"] != v["y"]) & known, "TWO_DIGIT_YEAR_EXPANDED"),
            rule(good, "ISO8601_CANONICAL"), rule(~good, "PARSE_FAILED"),
        )
        return F.struct(F.when(good, F.format_string("%04d-%02d-%02d", v["y"], v["m"], v["d"])).otherwise(t).alias("value"), F.array_sort(F.array_distinct(trace)).alias("rules"))

    def kinds(t: Column) -> Column:
        letters = t.rlike("[a-z]")
        found = F.struct(*[F.when(letters, F.regexp_extract(t, p, 0)).otherwise("").alias(n) for n, p in (("named", NAMED), ("first", NAMED_FIRST))], *[F.regexp_extract(t, p, 0).alias(n) for n, p in (("iso", ISO), ("dmy", DAY_FIRST))])
        pick = lambda m: F.when(m["named"] != "", F.struct(F.lit("named").alias("kind"), F.split(m["named"], SEPARATORS).alias("p"))).when(m["first"] != "", F.struct(F.lit("first").alias("kind"), F.split(m["first"], SEPARATORS).alias("p"))).when(m["iso"] != "", F.struct(F.lit("iso").alias("kind"), F.split(m["iso"], SEPARATORS).alias("p"))).when(m["dmy"] != "", F.struct(F.lit("dmy").alias("kind"), F.split(m["dmy"], SEPARATORS).alias("p"))).otherwise(F.struct(F.lit("none").alias("kind"), F.array().cast("array<string>").alias("p")))
        return let(let(found, pick), lambda k: judge(t, k))

    empty = raw.isNull() | (F.trim(raw) == "")
    return F.when(empty, F.struct(F.lit("").alias("value"), F.array(F.lit("RULE_DATE_EMPTY")).alias("rules"))).otherwise(let(date_cleaned(raw), kinds))


def with_date_parts(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with ``date_parts`` of a column as ``name``, in place: no shuffle, no join on null dates."""
    return df.withColumn(name, date_parts(F.col(column)))


def date_value(raw: Column) -> Column:
    return date_parts(raw)["value"]


def hamming(a: Column, b: Column) -> Column:
    """Places that differ, up to the shorter length."""
    n = F.least(F.length(a), F.length(b))
    return F.when(n > 0, F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.substring(a, k, F.lit(1)) != F.substring(b, k, F.lit(1))))).otherwise(0)


def compare_dates(a: Column, b: Column) -> Column:
    """struct(verdict, similarity, rule) of two normalised dates."""
    iso = r"^\d{4}-\d{2}-\d{2}$"
    both = a.rlike(iso) & b.rlike(iso)
    y = lambda c: F.substring(c, 1, 4).cast("int")
    m, d = (lambda c: F.substring(c, 6, 2)), (lambda c: F.substring(c, 9, 2))
    made = lambda v, s, r: F.struct(F.lit(v).alias("verdict"), F.lit(s).alias("similarity"), F.lit(f"RULE_DATE_{r}").alias("rule"))
    gap = F.abs(F.when(both, y(a)) - F.when(both, y(b)))
    return (
        F.when((a == b) & (a != ""), made("MATCH", 1.0, "EXACT_MATCH"))
        .when(both & (m(a) == m(b)) & (d(a) == d(b)) & gap.between(1, 5), made("MISMATCH", 0.5, "SUBTYPE_YEAR_OFF"))
        .when(both & (gap == 0) & (m(a) == d(b)) & (d(a) == m(b)), made("MISMATCH", 0.7, "SUBTYPE_DAY_MONTH_SWAP"))
        .when(both & (hamming(a, b) == 1), made("MISMATCH", 0.65, "SUBTYPE_SINGLE_DIGIT_TYPO"))
        .otherwise(made("MISMATCH", 0.0, "SUBTYPE_DIFFERENT"))
    )
