"""Names and shared text helpers as native column expressions; every normaliser has a value and a trace of rule ids."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C


#: Neither letters, numbers, underscores nor white space.
NOT_WORD = r"(?U)[^\p{L}\p{N}_\s]"


@lru_cache(1)
def _marked() -> str:
    """The letters whose compatibility form has a combining mark."""
    return "".join(c for c in map(chr, range(0xA0, 0x2C00)) if any(map(unicodedata.combining, unicodedata.normalize("NFKD", c))))


def split_marks(c: Column) -> Column:
    """NFKD with a space in the place of every combining mark."""
    source, target = _fold_table()
    return _beyond_ascii(c, F.regexp_replace(F.translate(F.regexp_replace(c, f"([{_marked()}])", "$1 "), source, target), r"\p{Mn}", " "))


@lru_cache(1)
def _fold_table() -> tuple[str, str]:
    """Letters whose compatibility form without marks is one other character, by rule from the Unicode data."""
    source, target = [], []
    for cp in range(0xA0, 0x2C00):
        c = chr(cp)
        out = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if out != c and len(out) == 1:
            source.append(c)
            target.append(out)
    return "".join(source), "".join(target)


def fold_marks(c: Column) -> Column:
    """NFKD without combining marks, for every letter that becomes a single character (Latin, Greek, Cyrillic, signs)."""
    source, target = _fold_table()
    return _beyond_ascii(c, F.regexp_replace(F.translate(c, source, target), r"\p{Mn}", ""))


def _beyond_ascii(c: Column, folded: Column) -> Column:
    """``folded`` where ``c`` has other than ASCII characters; most values have none, and their folding costs nothing."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), folded).otherwise(c)


@F.pandas_udf(T.StringType())
def nfkd_exact(s: pd.Series) -> pd.Series:
    """The full form, for texts with ligatures or conjoining scripts; Arrow batches."""
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


def casefold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def lookup(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def words(c: Column) -> Column:
    """White-space separated, never an empty string."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it; keeps generated code small."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with new columns that are worked out once a row: a generator stands between them and what uses them, so the optimiser
    doesn't move them into the expressions, and not into lambdas, where they would be worked out for every element."""
    made = df.select(*(c for c in df.columns if c not in columns), F.explode(F.array(F.struct(*(v.alias(n) for n, v in columns.items())))).alias("_once"))
    return made.select(*(c for c in df.columns if c not in columns), "_once.*")


def has_any(c: Column, parts) -> Column:
    """Whether a text contains one of ``parts``: one pattern, not a look for each."""
    return c.rlike("|".join(map(re.escape, parts)))


def _rule(cond: Column, name: Column | str) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), F.array(F.lit(name) if isinstance(name, str) else name)).otherwise(F.array().cast("array<string>"))


def _cut(low: Column) -> Column:
    """struct(t, m): the text before the first marker of the list that it has, and that marker."""
    start = F.struct(F.concat(F.lit(" "), low, F.lit(" ")).alias("t"), F.lit(None).cast("string").alias("m"))
    step = lambda acc, m: F.when(acc["m"].isNull() & F.contains(acc["t"], F.concat(F.lit(" "), m, F.lit(" "))), F.struct(F.get(F.split(acc["t"], F.concat(F.lit(" "), m, F.lit(" "))), F.lit(0)).alias("t"), m.alias("m"))).otherwise(acc)
    done = lambda acc: F.struct(F.when(acc["m"].isNull(), F.substring(acc["t"], F.lit(2), F.length(acc["t"]) - 2)).otherwise(F.trim(acc["t"])).alias("t"), acc["m"].alias("m"))
    return F.aggregate(F.array(*map(F.lit, C.RELATION_CUTS)), start, step, done)


def name_parts(raw: Column) -> Column:
    """struct(value, rules) of a raw name: marks folded, lower case, cut at a relation, honorifics dropped, variants unified, sorted."""
    variant, lit = lookup(VARIANTS), F.lit
    honorifics, relations, dropped = list(C.HONORIFICS), list(C.RELATIONS), [*C.HONORIFICS, *C.RELATIONS]

    def tail(text: Column, folded: Column, low: Column, cut: Column, clean: Column) -> Column:
        def last(tokens: Column) -> Column:
            kept = F.transform(F.filter(tokens, lambda t: ~t.isin(dropped)), lambda t: F.coalesce(F.element_at(variant, t), t))

            def out(kept: Column) -> Column:
                ordered = F.array_sort(kept)
                trace = F.concat(
                    _rule(folded != text, "RULE_NAME_UNICODE_NFKD"), _rule(low != folded, "RULE_NAME_CASEFOLD"),
                    _rule(cut["m"].isNotNull(), F.concat(lit("RULE_NAME_STRIP_RELATION_"), F.upper(F.coalesce(cut["m"], lit(""))))),
                    _rule(clean != cut["t"], "RULE_NAME_REMOVE_PUNCTUATION"),
                    F.transform(F.filter(tokens, lambda t: t.isin(honorifics)), lambda t: F.concat(lit("RULE_NAME_STRIP_HONORIFIC_"), F.upper(t))),
                    F.transform(F.filter(tokens, lambda t: t.isin(relations)), lambda t: F.concat(lit("RULE_NAME_STRIP_RELATION_"), F.upper(t))),
                    F.transform(F.filter(tokens, lambda t: t.isin(list(VARIANTS))), lambda t: F.concat(lit("RULE_NAME_VARIANT_"), F.upper(t), lit("_TO_"), F.upper(F.element_at(variant, t)))),
                    _rule(ordered != kept, "RULE_NAME_TOKEN_ORDER_INDEPENDENT"),
                )
                return F.struct(F.array_join(ordered, " ").alias("value"), F.array_sort(F.array_distinct(trace)).alias("rules"))

            return let(kept, out)

        return let(words(clean), last)

    whole = let(F.trim(raw), lambda text: let(fold_marks(text), lambda folded: let(casefold(folded), lambda low: let(_cut(low), lambda cut: let(F.regexp_replace(cut["t"], NOT_WORD, " "), lambda clean: tail(text, folded, low, cut, clean))))))
    return F.when(raw.isNull() | (F.trim(raw) == ""), F.struct(lit("").alias("value"), F.array(lit("RULE_EMPTY_NAME")).alias("rules"))).otherwise(whole)


def name_value(raw: Column) -> Column:
    """The value alone, without building the trace."""
    variant = lookup(VARIANTS)
    clean = let(casefold(fold_marks(F.trim(raw))), lambda low: F.regexp_replace(_cut(low)["t"], NOT_WORD, " "))
    kept = F.transform(F.filter(words(clean), lambda t: ~t.isin([*C.HONORIFICS, *C.RELATIONS])), lambda t: F.coalesce(F.element_at(variant, t), t))
    return F.when(raw.isNull() | (F.trim(raw) == ""), F.lit("")).otherwise(F.array_join(F.array_sort(kept), " "))


VARIANTS = {v: group[0] for group in C.NAME_VARIANTS for v in group[1:]}
