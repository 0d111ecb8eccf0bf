"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

Each source has a mean repetition rate: its target share over its share of the corpus. A document's count is the
inverse of the Poisson distribution with that mean at a uniform number drawn from a hash of seed and ``doc_id``; a mean
above ``LARGEST`` is split into equal ones of at most that, and their independent draws are added, which is the same
distribution. A document is repeated so often, and the copies are put in an order that another hash gives. Nothing depends
on partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused, written

SEED = 17
#: Default target: shares in proportion to a source's size to this power (below 1: small sources gain).
TEMPERATURE = 0.5
BITS = 52
#: The largest mean of one draw: ``exp`` stays in range, and a table holds some 800 numbers.
LARGEST = 500.0
#: Up to so many sources (16 MB of probabilities) their table is broadcast.
MOST_SOURCES = 2000


def uniform(*parts: Column | str, seed: int = SEED) -> Column:
    """A double in (0, 1) from the MD5 of seed and parts (nulls: empty), the middle of one of 2^52 equal steps."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("")) for p in parts))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**BITS))


def poisson_table(rate: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2, ... up to where a uniform of 52 bits can't reach, for means up to ``LARGEST``."""
    far = F.ceil(rate + F.lit(12.0) * F.sqrt(rate) + F.lit(40.0)).cast("int")
    step = lambda s, k: F.struct((s["p"] * rate / k).alias("p"), F.array_append(s["c"], F.element_at(s["c"], -1) + s["p"] * rate / k).alias("c"))
    zero = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))
    return F.aggregate(F.sequence(F.lit(1), far), zero, step, lambda s: s["c"])


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, size: Column | None = None) -> DataFrame:
    """``source, rate``: mean repetitions that bring each source to its target share at an unchanged total.

    ``size`` is what a document counts (default: its code points, 1 for an empty one). Sources without a weight get
    rate 0 where ``weights`` is given; a null source is a source of its own.
    """
    size = size if size is not None else F.greatest(F.coalesce(F.length("text"), F.lit(0)), F.lit(1)).cast("bigint")
    have = docs.select(F.col("source").alias("src"), size.alias("n")).groupBy("src").agg(F.sum("n").alias("n"))
    if weights is None:
        want = F.pow(F.col("n").cast("double"), F.lit(temperature))
    else:
        want = F.coalesce(*(F.when(F.col("src") == k, F.lit(float(v))) for k, v in weights.items()), F.lit(0.0)) if weights else F.lit(0.0)
    total = have.select("src", "n", want.alias("want"))
    total = written(total, "sources")
    # two numbers; decimals, so the order of adding doesn't show
    all_n, all_want = total.agg(F.sum("n"), F.sum(F.col("want").cast("decimal(38,6)")).cast("double")).first()
    if not all_want:
        return total.select("src", F.lit(0.0).alias("rate"))
    return total.select("src", (F.col("want") / F.lit(all_want) * F.lit(float(all_n)) / F.col("n").cast("double")).alias("rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """``docs`` repeated by Poisson counts and globally shuffled, with ``copy`` (1, 2, ...), ``rate`` and ``mix_order``.

    Needs ``doc_id``, ``text`` and ``source``; all other columns stay, and where one has the name of a new one, the new one's is
    lengthened (``_rate``). Null or empty texts count one code point, long ones all of theirs. Rows that repeat a ``doc_id``
    repeat alike (the draw is by id); a null id draws as an empty one. An empty table gives no rows.
    """
    names, taken = docs.columns, {c.lower() for c in docs.columns}
    rate, copy, order = (x if x not in taken else unused(docs, x) for x in ("rate", "copy", "mix_order"))
    src, mean, draws, upto, times = (unused(docs, f"mix_{x}") for x in ("src", "mean", "draws", "upto", "times"))
    parts = F.greatest(F.ceil(F.col("rate") / F.lit(LARGEST)), F.lit(1)).cast("int")
    table = rates(docs, weights, temperature).select("src", "rate", parts.alias("parts")).select(F.col("src").alias(src), F.col("rate").alias(mean), F.col("parts").alias(draws), poisson_table(F.col("rate") / F.col("parts")).alias(upto))
    # one row of at most some 800 numbers a source: its count is checked, and beyond MOST_SOURCES the planner chooses the join
    few = table.limit(MOST_SOURCES + 1).count() <= MOST_SOURCES
    with_rate = docs.join(F.broadcast(table) if few else table, F.col("source").eqNullSafe(F.col(src)), "left")
    drawn = lambda u: F.size(F.filter(upto, lambda c: c <= u))
    more = F.aggregate(F.sequence(F.lit(1), F.col(draws) - 1), F.lit(0), lambda n, k: n + drawn(uniform("doc_id", k, seed=seed)))
    count = drawn(uniform("doc_id", seed=seed)) + F.when(F.col(draws) > 1, more).otherwise(0)
    copies = with_rate.withColumn(times, count).filter(F.col(times) > 0).select(*names, F.col(mean).alias(rate), F.explode(F.sequence(F.lit(1), F.col(times))).alias(copy))
    return copies.withColumn(order, uniform("doc_id", copy, seed=seed + 1)).orderBy(order, "doc_id", copy)


def poisson_count(us: list[float], rate: float) -> int:
    """The same count in plain Python, for tests; ``us`` has the number of each draw."""
    draws = max(1, math.ceil(rate / LARGEST))
    total, rate = 0, rate / draws
    for u in us[:draws]:
        p = c = math.exp(-rate)
        n = 0
        for k in range(1, math.ceil(rate + 12.0 * math.sqrt(rate) + 40.0) + 2):
            if u < c:
                break
            n, p = n + 1, p * rate / k
            c += p
        total += n
    return total
