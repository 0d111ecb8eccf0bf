"""Document types by keywords."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import let, once


def _keywords() -> tuple[list, str]:
    """(type, its words with their weights), no more words than a long has bits; and a pattern that gives at every place of a text the longest word
    that begins there: others that begin there are its beginnings."""
    chunks = []
    for t in C.PRIMARY:
        own = [(w, 5) for w in C.PRIMARY[t]] + [(w, 2 if " " in w else 1) for w in C.SECONDARY[t]]
        chunks += [(t, own[k : k + 60]) for k in range(0, len(own), 60)]
    by_letter: dict[str, list[str]] = {}
    for w in sorted({w for _, own in chunks for w, _ in own}, key=lambda w: (-len(w), w)):
        by_letter.setdefault(w[0], []).append(re.escape(w[1:]))
    return chunks, "(?=(" + "|".join(f"{re.escape(c)}(?:{'|'.join(rest)})" for c, rest in sorted(by_letter.items())) + "))"


def type_scores(low: Column) -> Column:
    """array of struct(score, type_ord, doc_type, confidence), best first; ``low`` is the whole text in lower case. The text is read once for
    the words of all types."""
    chunks, pattern = _keywords()
    words = sorted({w for _, own in chunks for w, _ in own})
    bits = {x: [sum(1 << k for k, (w, _) in enumerate(own) if x.startswith(w)) for _, own in chunks] for x in words}
    q = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    held = F.expr("map(" + ", ".join(f"{q(x)}, array({', '.join(f'{v}L' for v in vs)})" for x, vs in bits.items()) + ")")
    found = F.transform(F.array_distinct(F.regexp_extract_all(low, F.lit(pattern), F.lit(1))), lambda x: F.element_at(held, x))

    def points(found: Column, n: int) -> Column:
        met = F.aggregate(found, F.lit(0).cast("long"), lambda v, x: v.bitwiseOR(F.get(x, F.lit(n))))
        masks = {weight: sum(1 << k for k, (_, w) in enumerate(chunks[n][1]) if w == weight) for weight in (5, 2, 1)}
        return let(met, lambda m: sum((F.bit_count(m.bitwiseAND(F.lit(v).cast("long"))) * w for w, v in masks.items()), F.lit(0)))

    def entry(found: Column, k: int, t: str) -> Column:
        best = 5 * len(C.PRIMARY[t]) + 2 * len(C.SECONDARY[t])
        score = sum((points(found, n) for n, (of, _) in enumerate(chunks) if of == t), F.lit(0))
        return let(score, lambda s: F.struct((-s).alias("neg"), F.lit(k).alias("type_ord"), F.lit(t).alias("doc_type"), s.alias("score"), F.round(F.least(F.lit(1.0), s / F.lit(best)), 3).alias("confidence")))

    return let(found, lambda found: F.sort_array(F.array(*[entry(found, k, t) for k, t in enumerate(C.PRIMARY)])))


def classify(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``doc_type``, ``type_confidence`` and ``top_2``; a best score under 3 is unknown, 0 and none."""
    # the lower case and the scores are worked out once a text: every type looks for a dozen words or more
    s = once(once(docs, _low=F.lower(F.coalesce(F.col(text), F.lit("")))), _s=F.slice(type_scores(F.col("_low")), 1, 2)).drop("_low")
    sure = F.col("_s")[0]["score"] >= 3
    return s.withColumn("doc_type", F.when(sure, F.col("_s")[0]["doc_type"]).otherwise("unknown")).withColumn("type_confidence", F.when(sure, F.col("_s")[0]["confidence"]).otherwise(0.0)).withColumn("top_2", F.when(sure, F.array(F.col("_s")[0]["doc_type"], F.col("_s")[1]["doc_type"])).otherwise(F.array().cast("array<string>"))).drop("_s")


def type_of_filename(name: Column) -> Column:
    low = F.lower(name)
    out = None
    for kind, parts in C.FILENAME_TYPES:
        hit = low.rlike("|".join(parts))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("identity_proof")
