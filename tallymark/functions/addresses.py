"""Addresses: abbreviation expansion and the split into house, street, city and PIN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from .text import NOT_WORD, let, lookup, split_marks, words

PIN = r"\b([1-9][0-9]{5})\b"
#: Abbreviations that change a token.
EXPANSIONS = dict(C.ABBREVIATIONS)


def address_clean(raw: Column) -> Column:
    """Lower case; a combining mark separates, like punctuation, so letters are decomposed before the marks go."""
    return F.regexp_replace(split_marks(F.lower(F.trim(raw))), NOT_WORD, " ")


def address_value(raw: Column) -> Column:
    expand = lookup(EXPANSIONS)
    out = F.array_join(F.transform(words(address_clean(raw)), lambda t: F.coalesce(F.element_at(expand, t), t)), " ")
    return F.when(raw.isNull() | (F.trim(raw) == ""), F.lit("")).otherwise(out)


def address_parts(raw: Column) -> Column:
    """struct(value, rules)."""
    low, expand = F.lower(F.trim(raw)), lookup(EXPANSIONS)
    clean, pin = address_clean(raw), F.regexp_extract(low, PIN, 1)
    rule = lambda cond, c: F.when(cond, F.array(c)).otherwise(F.array().cast("array<string>"))
    trace = F.concat(
        rule(pin != "", F.concat(F.lit("RULE_ADDR_EXTRACTED_PIN_"), pin)),
        rule(clean != low, F.lit("RULE_ADDR_CLEAN_PUNCTUATION")),
        F.transform(F.filter(words(clean), lambda t: t.isin(list(EXPANSIONS))), lambda t: F.concat(F.lit("RULE_ADDR_EXPAND_"), F.upper(t), F.lit("_TO_"), F.upper(F.element_at(expand, t)))),
    )
    empty = raw.isNull() | (F.trim(raw) == "")
    return F.struct(address_value(raw).alias("value"), F.when(empty, F.array(F.lit("RULE_ADDR_EMPTY"))).otherwise(F.array_sort(F.array_distinct(trace))).alias("rules"))


def components(value: Column) -> Column:
    """struct(house_number, street_locality, city, pincode) of a normalised address."""
    cities = F.array(*map(F.lit, C.CITIES))
    empty = F.array().cast("array<string>")

    def without_pin(tokens: Column) -> Column:
        at = F.array_position(F.transform(tokens, lambda t: t.rlike("^[1-9][0-9]{5}$")), True).cast("int")
        return let(F.struct(at.alias("at"), tokens.alias("all")), lambda x: let(F.struct(F.when(x["at"] > 0, F.get(x["all"], x["at"] - 1)).otherwise(F.lit("")).alias("pin"), F.filter(x["all"], lambda t, i: i != x["at"] - 1).alias("rest")), without_city))

    def without_city(x: Column) -> Column:
        city = F.coalesce(F.get(F.filter(cities, lambda c: F.array_contains(x["rest"], c)), F.lit(0)), F.lit(""))
        return let(F.struct(x["pin"].alias("pin"), city.alias("city"), x["rest"].alias("all")), lambda y: let(F.struct(y["pin"].alias("pin"), y["city"].alias("city"), F.filter(y["all"], lambda t: t != y["city"]).alias("rest")), split_house))

    def split_house(y: Column) -> Column:
        rest = y["rest"]
        one, two = F.get(rest, F.lit(0)), F.get(rest, F.lit(1))
        single = F.coalesce(one.rlike(r"\d"), F.lit(False))
        double = F.coalesce(one.isin(list(C.HOUSE_PREFIXES)) & two.rlike(r"\d"), F.lit(False))
        skip = F.when(single, 1).when(double, 2).otherwise(0)
        return let(skip, lambda n: F.struct(F.array_join(F.filter(rest, lambda t, i: i < n), " ").alias("house_number"), F.array_join(F.filter(rest, lambda t, i: i >= n), " ").alias("street_locality"), y["city"].alias("city"), y["pin"].alias("pincode")))

    return let(F.coalesce(words(value), empty), without_pin)
