"""Exact mixes of cases: so many of each kind for each split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Cases of each kind a split has.
MIX = {
    "sample": {"consistent": 1, "benign": 1, "error_single": 2, "error_multi": 1, "degraded": 1},
    "dev": {"consistent": 8, "benign": 10, "error_single": 12, "error_multi": 4, "degraded": 6},
    "heldout": {"consistent": 3, "benign": 3, "error_single": 4, "error_multi": 2},
}


def exact_mix(cases: DataFrame, kind: str = "kind", key: str = "case_id", mix: dict = MIX, seed: str = "42") -> DataFrame:
    """``cases`` that the mix takes, with ``split`` and ``number`` in it (kinds in the mix's order, then by draw).

    A kind's cases are drawn in the order of a seeded hash of their key, so the same are drawn however rows lie in files; the first go to
    the first split and so on, none to two. Tasks keep no more a kind than the mix needs before rows are shuffled. Kinds with too few
    cases give what they have; other kinds and null kinds give none. Keys that repeat are drawn as rows.
    """
    most = {k: sum(m.get(k, 0) for m in mix.values()) for m in mix.values() for k in m}
    order = Window.partitionBy(kind).orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), F.col(key))
    drawn = cases.filter(F.col(kind).isin(*most)).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= max(most.values()))
    split: Column = F.lit(None).cast("struct<split:string,number:int>")
    for k in most:
        taken = 0
        for s, m in mix.items():
            before = sum(n for other, n in m.items() if list(m).index(other) < list(m).index(k)) if k in m else 0
            here = (F.col(kind) == k) & F.col("_n").between(taken + 1, taken + m.get(k, 0))
            split = F.when(here, F.struct(F.lit(s).alias("split"), (F.col("_n") - taken + before).cast("int").alias("number"))).otherwise(split)
            taken += m.get(k, 0)
    return drawn.withColumn("_s", split).filter("_s is not null").select(*cases.columns, "_s.split", "_s.number")
