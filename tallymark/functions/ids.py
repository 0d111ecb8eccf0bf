"""Identifiers: normal form, digit confusions, prefixes, masks and comparability."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from .text import lookup

CONFUSED, DIGITS = "ODQIL|ZSB", "000111258"
MASKED_FIELDS = ("id", "roll", "consumer", "account", "ref", "aadhaar", "pan")


def id_value(raw: Column, numeric_only: bool = False) -> Column:
    bare = F.regexp_replace(F.upper(F.trim(raw)), r"[\s\-_/.]+", "")
    return F.coalesce(F.translate(bare, CONFUSED, DIGITS) if numeric_only else bare, F.lit(""))


def id_parts(raw: Column, numeric_only: bool = False) -> Column:
    """struct(value, rules)."""
    up = F.upper(F.trim(raw))
    bare = F.regexp_replace(up, r"[\s\-_/.]+", "")
    rule = lambda cond, name: F.when(cond, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    trace = rule(bare != up, "RULE_ID_STRIP_SEPARATORS")
    if numeric_only:
        trace = F.concat(rule(F.translate(bare, CONFUSED, DIGITS) != bare, "RULE_ID_OCR_NUMERIC_CONFUSION_FIX"), trace)
    empty = raw.isNull() | (F.trim(raw) == "")
    return F.struct(F.when(empty, F.lit("")).otherwise(id_value(raw, numeric_only)).alias("value"), F.when(empty, F.array(F.lit("RULE_ID_EMPTY"))).otherwise(trace).alias("rules"))


def id_prefix(value: Column) -> Column:
    return F.nullif(F.regexp_extract(F.upper(F.trim(value)), r"^([A-Z]{2,6})[-\s]?[0-9]", 1), F.lit(""))


def id_doc_type(value: Column) -> Column:
    return F.element_at(lookup(C.ID_PREFIXES), id_prefix(value))


def ids_comparable(a: Column, b: Column, type_a: Column, type_b: Column) -> Column:
    """Two ids of one id-carrying type, or of one prefix."""
    return ((type_a == type_b) & type_a.isin(list(C.ID_CARRIERS))) | F.coalesce(id_prefix(a) == id_prefix(b), F.lit(False))


def should_compare(field: Column, type_a: Column, type_b: Column, a: Column, b: Column) -> Column:
    """Is this field compared between documents of these types?"""
    out = F.when(field.isin(list(C.SANITY_ONLY)), False).when(field.isin(list(C.CROSS_COMPARABLE)), True).when(field == "id_number", ids_comparable(a, b, type_a, type_b))
    for name, types in C.TYPED_IDS.items():
        out = out.when(field == name, type_a.isin(list(types)) & type_b.isin(list(types)))
    return out.otherwise(False)


def expected_on(field: Column, doc_type: Column) -> Column:
    """Does a document of this type carry the field? Unknown types carry a name only."""
    held = F.create_map(*[x for t, fs in C.EXPECTED.items() for x in (F.lit(t), F.array(*map(F.lit, fs)))])
    return F.array_contains(F.coalesce(F.element_at(held, doc_type), F.array(F.lit("name"))), field)


def mask_for_screen(value: Column, field: Column, enabled: bool = True) -> Column:
    """``***`` and the last four, where the field is an identifier of more than four characters."""
    if not enabled:
        return value
    clean = F.trim(value)
    return F.when(F.lower(field).rlike("|".join(MASKED_FIELDS)) & (F.length(clean) > 4), F.concat(F.lit("***"), F.right(clean, F.lit(4)))).otherwise(value)


def mask_for_model(value: Column) -> Column:
    """Stars but for the last four; four stars for four or fewer."""
    return F.when(F.length(value) <= 4, F.lit("****")).otherwise(F.concat(F.repeat(F.lit("*"), F.greatest(F.length(value) - 4, F.lit(0))), F.right(value, F.lit(4))))


def compare_ids(a: Column, b: Column) -> Column:
    same = (a == b) & (a != "")
    return F.struct(F.when(same, F.lit("MATCH")).otherwise(F.lit("MISMATCH")).alias("verdict"), F.when(same, F.lit(1.0)).otherwise(F.lit(0.0)).alias("similarity"), F.when(same, F.lit("RULE_ID_EXACT_MATCH")).otherwise(F.lit("RULE_ID_MISMATCH")).alias("rule"))
