"""Best-fit packing of documents into training contexts under conflicts.

Documents are dealt into shards of some ``SHARD_DOCS`` by a hash of their id, source, length, cluster and number among equal
rows, so every shard is a random sample of the corpus, and bins don't depend on how rows lie in files.
Within a shard, longest first, a document goes to the open bin with the least room that holds it and has no conflict: bins
are kept in order of residual room and carry a bitmap of duplicate clusters and one of source slots; the search starts at
the least room that suffices and goes on to the successor until a compatible bin is found, else a new bin opens.

A bin never holds two documents of one duplicate cluster. A source has as many slots in a bin as ``SLACK`` times its
expected documents there, and one more, so a source that holds a third of the corpus packs well and still can't fill a bin.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

CAPACITY, SHARD_DOCS, SLACK = 2048, 4096, 2


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def best_fit(lengths: list[int], sources: list[int], clusters: list[int], capacity: int, slots: dict[int, int]) -> list[tuple[int, int]]:
    """(bin, offset) of each piece; pieces come longest first, none above ``capacity``. ``clusters``: -1 conflicts with nothing."""
    first_slot, at = {}, 0
    for s in sorted(slots):
        first_slot[s], at = at, at + slots[s]
    masks = {s: ((1 << slots[s]) - 1) << first_slot[s] for s in slots}
    order: list[tuple[int, int]] = []  # (residual, bin) of the open bins
    held: list[list[int]] = []  # source bitmap, cluster bitmap
    out = []
    for n, s, c in zip(lengths, sources, clusters):
        bit, mask = 1 << c if c >= 0 else 0, masks[s]
        k = bisect_left(order, (n, -1))
        while k < len(order) and (held[order[k][1]][1] & bit or held[order[k][1]][0] & mask == mask):
            k += 1
        if k < len(order):
            room, b = order.pop(k)
        else:
            room, b = capacity, len(held)
            held.append([0, 0])
        own = held[b]
        free = ~own[0] & mask
        own[0] |= free & -free
        own[1] |= bit
        out.append((b, capacity - room))
        if room > n:
            insort(order, (room - n, b))
    return out


PACKED = "doc_id bigint, source string, fragment int, start_token bigint, n_tokens bigint, bin_id bigint, bin_offset bigint, bin_used bigint"


def _shard(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["uid", "n", "cluster"], kind="stable").reset_index(drop=True)
        full = rows.n // capacity
        # whole bins of a long document first, then what is left of it
        owner = np.repeat(np.arange(len(rows)), full + (rows.n % capacity > 0))
        part = np.arange(len(owner)) - np.repeat(np.cumsum(np.bincount(owner, minlength=len(rows))) - np.bincount(owner, minlength=len(rows)), np.bincount(owner, minlength=len(rows)))
        size = np.minimum(capacity, rows.n.to_numpy()[owner] - part * capacity)
        source = pd.factorize(rows.source.fillna("\0null"))[0]
        code, names = pd.factorize(rows.cluster.fillna("\0null"))
        members = np.bincount(code, minlength=len(names))
        number = np.where(members > 1, np.cumsum(members > 1) - 1, -1)
        cluster = np.where(rows.cluster.isna(), -1, number[code])
        share = np.bincount(source) / len(rows)
        expected = capacity / max(1.0, float(size.mean()))
        slots = {k: int(np.ceil(SLACK * x * expected)) + 1 for k, x in enumerate(share)}
        order = np.lexsort((part, owner, -size))
        placed = best_fit(size[order].tolist(), source[owner[order]].tolist(), cluster[owner[order]].tolist(), capacity, slots)
        bins = np.array([b for b, _ in placed], np.int64)
        used = np.bincount(bins, weights=size[order]).astype(np.int64)
        mine = owner[order]
        return pd.DataFrame({"doc_id": rows.doc_id.astype("Int64").to_numpy()[mine], "source": rows.source.to_numpy()[mine], "fragment": part[order].astype(np.int32), "start_token": part[order] * capacity, "n_tokens": size[order], "bin_id": (int(rows.shard.iloc[0]) << 32) + bins, "bin_offset": [x for _, x in placed], "bin_used": used[bins]}).astype({"doc_id": "Int64"})

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, n_tokens: Column | None = None, cluster: Column | None = None) -> DataFrame:
    """One row a fragment: ``doc_id, source, fragment, start_token, n_tokens, bin_id, bin_offset, bin_used``.

    ``docs`` has ``doc_id, text, source``. A document counts its words and one end token (``n_tokens`` overrides), so an empty
    or null text takes one token; longer than ``capacity`` it is cut into whole bins and a rest, and no token is dropped.
    ``cluster`` names the duplicate cluster (default: equal texts, so near copies may share a bin; null conflicts with nothing).
    A null source is a source. Repeated rows are documents of their own, of one cluster. An empty table gives no rows; other
    columns are ignored. The same rows give the same bins however they lie in partitions.
    """
    n = n_tokens if n_tokens is not None else word_count(F.col("text")) + 1
    group = cluster if cluster is not None else F.md5(F.coalesce("text", F.lit("")))
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), n.cast("bigint").alias("n"), group.cast("string").alias("cluster"))
    # equal rows are counted, then numbered: a row's number needs no order among them
    equal = own.groupBy("doc_id", "source", "n", "cluster").agg(F.count(F.lit(1)).alias("times"))
    facts = written(equal.select("doc_id", "source", "n", "cluster", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("nth")).withColumn("uid", F.xxhash64("doc_id", "source", "n", "cluster", "nth")).drop("nth"), "lengths")
    shards = max(1, -(-facts.count() // SHARD_DOCS))
    dealt = facts.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(_shard(capacity), PACKED)
