"""Near-duplicate documents: fast similarity sketching, banding, exact verification, components.

Fast similarity sketching (Dahlgaard, Knudsen, Thorup 2017): in round i every element of a set falls into one hashed
bin with value i + hash; after t such rounds element minima are forced into bins one at a time, so each of t bins
fills. Equal bins of two sets have the chance of their Jaccard similarity, with concentration about it. Bands of bins
give buckets; buckets give candidates; candidates are confirmed on the full sets.

Equal sets are one class from the start. Classes in a bucket are compared with the bucket's leader. Where a bucket still spans
several components, what could join two of them is found by prefix filtering, which is exact: in any one order of all elements, two sets that are alike enough share one of the first few of either. The
order puts elements that many sets have last, so text that a template repeats makes no candidates, and sets that share a
first element and lie in different components are compared, all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix64, rows_of, shingles, small, unused, word_hashes, written
from .components import components

BANDS, ROWS = 24, 4
SALTS = 256
FULL = U64(2**64 - 1)


def sketch(x: np.ndarray, bins: int) -> np.ndarray:
    """One 64-bit coordinate a bin for distinct 64-bit elements ``x`` (at least one)."""
    out = np.zeros(bins, U64)
    empty = np.ones(bins, bool)
    for i in range(2 * bins):
        h = mix64(x + U64((0x632BE59BD9B4E019 * (2 * i + 1)) & (2**64 - 1)))
        low = np.full(bins, FULL)
        if i < bins:
            np.minimum.at(low, ((h >> U64(40)) * U64(bins) >> U64(24)).astype(np.intp), h & U64(2**40 - 1))
        else:
            low[i - bins] = h.min()
        new = empty & (low != FULL)
        out[new] = mix64(low[new] * U64(2 * bins + 1) + U64(i))
        empty &= ~new
        if not empty.any():
            break
    return out


def band_keys(coords: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key a band; the band's number is part of it."""
    keys = np.arange(1, bands + 1, dtype=U64)
    for column in coords.reshape(bands, -1).T:
        keys = mix64(keys * U64(0x9E3779B97F4A7C15) + column)
    return keys.astype(np.int64)


SKETCHED = "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>"


def sketches(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id``, set size, a 128-bit digest of the set, and its band keys, from whole texts."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for part in rows_of(batches):
            n, digests, keys = [], [], []
            for text in part.column(1).to_pylist():
                own = np.unique(shingles(word_hashes(text), width))
                n.append(len(own))
                digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                keys.append(band_keys(sketch(own, bands * rows), bands) if len(own) else [])
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, SKETCHED)


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose sets have 100 * intersection >= percent * union.

    ``a``'s text is sent once to each of up to ``SALTS`` cells, every ``b`` to its cell, and cells are read as a stream,
    so a leader of many is spread and no group is held in memory.
    """
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    asked = salted.select("a", "salt", F.lit(1).alias("role"), F.col("b").alias("doc")).unionByName(salted.select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("doc")).distinct())
    rows = asked.join(texts, asked.doc == texts.node).select("a", "salt", "role", "doc", "text")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        at, leaders = None, []
        for part in rows_of(batches):
            found = []
            for a, salt, role, doc, text in zip(*(part.column(k).to_pylist() for k in range(5))):
                own = np.unique(shingles(word_hashes(text), width))
                if (a, salt) != at:
                    at, leaders = (a, salt), []
                if role == 0:
                    leaders.append(own)
                elif any(near(x, own, percent) for x in leaders):
                    found.append((a, doc))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], schema=schema)

    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "role").mapInArrow(run, "a bigint, b bigint")


def near(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """For sorted distinct arrays."""
    least, most = sorted((len(x), len(y)))
    if not least or 100 * least < percent * most:
        return False
    both = np.concatenate((x, y))
    both.sort()
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * same >= percent * (len(both) - same)


BLOCK = 256
#: Counters of element frequencies: a fixed size, whatever the corpus.
COUNTERS = 1 << 18


def frequencies(texts: DataFrame, width: int) -> np.ndarray:
    """In how many texts the elements of each counter stand."""

    def run(batches):
        total = np.zeros(COUNTERS, np.int64)
        for part in rows_of(batches):
            for text in part.column(0).to_pylist():
                total += np.bincount((np.unique(shingles(word_hashes(text), width)) & U64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    got = texts.select("text").mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # at most COUNTERS rows
    out = np.zeros(COUNTERS, np.int64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out


def prefixes(nodes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """``region, members, node, n, comp``: the documents of several components that have an element in common among their first.

    The first of a text's elements are those in few texts, as many as make ``100 * intersection >= percent * size`` impossible
    without one of them; so of two texts that are alike enough each has one of them in common. Elements that the same
    documents share are one region.
    """
    own = written(texts.join(nodes.select("node", "n", "comp").distinct(), "node").select("node", "n", "comp", "text"), "mixed-texts")
    counted = texts.sparkSession.sparkContext.broadcast(frequencies(own, width))
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("comp", pa.int64())])

    def run(batches):
        many = counted.value
        for part in rows_of(batches):
            keys, sizes = [], []
            for text in part.column(3).to_pylist():
                x = np.unique(shingles(word_hashes(text), width))
                first = len(x) - -(-percent * len(x) // 100) + 1
                keys.append(x[np.lexsort((x, many[(x & U64(COUNTERS - 1)).astype(np.int64)]))[:first]])
                sizes.append(len(keys[-1]))
            again = lambda c: pa.array(np.repeat(c.to_numpy(), sizes))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *(again(part.column(k)) for k in range(3))], schema=schema)

    rows = written(own.mapInArrow(run, "key bigint, node bigint, n bigint, comp bigint"), "prefixes")
    group = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sign"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
    regions = written(group.groupBy("members", "sign").agg(F.min("key").alias("key")).select("key", "members"), "regions")
    return written(rows.join(regions, "key").select(F.col("key").alias("region"), "members", "node", "n", "comp"), "placed")


#: Documents of a region up to which its pairs are listed; larger ones are compared in cells.
FEW = 64


def confirmed_in_regions(placed: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links ``(a, b)`` between documents of different components of a region of ``placed``."""
    few, many = placed.filter(F.col("members") <= FEW), placed.filter(F.col("members") > FEW)
    a, b = few.alias("a"), few.alias("b")
    pairs = a.join(b, (F.col("a.region") == F.col("b.region")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.comp") != F.col("b.comp")) & _compatible("a.n", "b.n", percent))
    listed = written(pairs.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct(), "pairs")
    return confirmed(listed, texts, width, percent).unionByName(confirmed_in_blocks(many, texts, width, percent))


def confirmed_in_blocks(placed: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links ``(a, b)`` between components that meet in a region of ``placed(region, node, comp)``.

    In a region, every document outside its largest component meets every other, in cells of at most about ``BLOCK`` by
    ``BLOCK``: texts are sent once a block, not once a pair, and a cell compares its sets through one sorted list. Only links
    come out.
    """
    sizes = placed.groupBy("region", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("region").agg(F.max_by("comp", F.struct("c", "comp")).alias("most"), F.sum("c").alias("all_n"), F.max("c").alias("most_n"))
    blocks = lambda n: F.greatest(F.ceil(n / F.lit(BLOCK)), F.lit(1)).cast("int")
    set_up = placed.join(sizes.select(F.col("region").alias("_r"), "most", blocks(F.col("all_n")).alias("cols"), blocks(F.col("all_n") - F.col("most_n")).alias("rows")), F.col("region") == F.col("_r"))
    seat = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    # each document of the region as a column, and those outside the largest component as rows
    as_column = set_up.select("region", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("r"), seat(F.col("cols")).alias("c"), F.lit(1).alias("role"), "node", "comp")
    as_row = set_up.filter("comp <> most").select("region", seat(F.col("rows")).alias("r"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("c"), F.lit(0).alias("role"), "node", "comp")
    asked = as_column.unionByName(as_row).withColumnRenamed("node", "doc")
    cells = asked.join(texts, asked.doc == texts.node).select("region", "r", "c", "role", "doc", "comp", "text")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        at, sets, index = None, [], None
        for part in rows_of(batches):
            found = []
            for region, r, c, role, doc, comp, text in zip(*(part.column(k).to_pylist() for k in range(7))):
                own = np.unique(shingles(word_hashes(text), width))
                if (region, r, c) != at:
                    at, sets, index = (region, r, c), [], None
                if role == 0:
                    sets.append((doc, comp, own))
                    continue
                if not sets or not len(own):
                    continue
                if index is None:
                    flat = np.concatenate([x for _, _, x in sets])
                    order = np.argsort(flat, kind="stable")
                    index = flat[order], np.repeat(np.arange(len(sets)), [len(x) for _, _, x in sets])[order], np.array([len(x) for _, _, x in sets])
                values, owner, size = index
                lo, hi = np.searchsorted(values, own), np.searchsorted(values, own, "right")
                n = hi - lo
                hits = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                same = np.bincount(owner[hits], minlength=len(sets))
                good = np.flatnonzero(100 * same >= percent * (size + len(own) - same))
                found += [(sets[k][0], doc) for k in good if sets[k][1] != comp and sets[k][0] != doc]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], schema=schema)

    return cells.repartition("region", "r", "c").sortWithinPartitions("region", "r", "c", "role").mapInArrow(run, "a bigint, b bigint")


def _compatible(x: str, y: str, percent: int):
    """Sets whose sizes alone don't rule the link out."""
    return (F.lit(100) * F.least(x, y) >= F.lit(percent) * F.greatest(x, y))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text, ...)``.

    Null and empty texts have an empty set, link with nothing and are kept. Texts of fewer than ``width`` words are one
    shingle; longer ones are read whole. Rows that repeat a ``doc_id`` are one document, linked by any of its texts. Rows with a
    null id link with nothing, have a null component and are kept. An empty table gives no rows; other columns are ignored. A
    linked pair at exactly the threshold shares no bucket with a chance of ``(1 - 0.8 ** rows) ** bands`` (3 in a million by default).
    """
    own = written(sketches(docs, width, bands, rows), "sketches")
    classes = written(own.filter("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")
    banded = classes.select("node", "n", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("key")
    member = written(banded.join(shared, "key"), "members")
    nodes = small(written(member.select("node").distinct(), "nodes"))
    texts = written(docs.select("doc_id", "text").join(nodes, F.col("doc_id") == F.col("node"), "inner").select("node", "text"), "texts")
    # against one leader a bucket
    lead = member.groupBy("key").agg(F.min_by(F.struct("node", "n"), F.col("node")).alias("lead")).select("key", F.col("lead.node").alias("a"), F.col("lead.n").alias("an"))
    pairs = member.join(lead, "key").filter((F.col("node") != F.col("a")) & _compatible("n", "an", percent)).select("a", F.col("node").alias("b"))
    links = written(confirmed(pairs.distinct(), texts, width, percent), "links")
    labels = written(components(links), "labels")
    now = member.join(labels, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("comp"))
    several = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
    mixed = written(now.join(several, "key"), "mixed")
    if not mixed.isEmpty():  # whatever could still join components
        more = written(confirmed_in_regions(prefixes(mixed, texts, width, percent), texts, width, percent), "links")
        labels = written(components(links.unionByName(more)), "labels")
    belongs = classes.join(labels, "node", "left").select(F.col("digest").alias("cls"), F.coalesce("component", "node").alias("comp"))
    out = own.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    return out.join(belongs, out.digest == belongs.cls, "left").select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"), F.col("doc_id").eqNullSafe(F.coalesce("comp", "doc_id")).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs``, all columns whatever their names, with one document of each group of near duplicates: that of the least ``doc_id``.

    Null and empty texts link with nothing and stay, as do rows with a null id. Rows that repeat a ``doc_id`` stay or go together,
    one of each text. Texts of any length are read whole; an empty table stays empty.
    """
    from pyspark.sql import Window

    id_, nth, text = unused(docs, "kept"), unused(docs, "nth"), unused(docs, "md5")
    kept = near_duplicates(docs.select("doc_id", "text"), width, percent).filter("kept and doc_id is not null").select(F.col("doc_id").alias(id_)).distinct()
    stay = docs.filter("doc_id is not null").join(kept, F.col("doc_id") == F.col(id_), "inner").withColumn(text, F.md5("text"))
    one = stay.withColumn(nth, F.row_number().over(Window.partitionBy(id_, text).orderBy(text))).filter(F.col(nth) == 1).drop(id_, nth, text)
    return one.unionByName(docs.filter("doc_id is null"))
