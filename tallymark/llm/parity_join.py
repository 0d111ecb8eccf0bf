"""N-gram Jaccard join by parity sketches.

A set's sketch has one bit a place; each element flips the bit it hashes to. Where two sketches differ, so do the sets: their Hamming
distance never exceeds the symmetric difference, and a linked pair's is at most ``(100 - percent) * (a + b) / (100 + percent)`` for sizes a and
b. Sizes are cut into bands; a band's sketches have places for its largest sets, and sets that could link with the next band's
are sketched for that one too. With at most T places that differ among K = T // 2 + 1 groups of places, some group has one at most; of
its three words two are equal. So every linked pair shares a signature (a group's number and two of its words), and none is lost.
Taken as a ring, the groups have even a start from which one group has one difference at most and two have three (the pigeonring
principle). So a signature carries the exclusive or of its group's third word and the next group's words: pairs whose values differ in
more than three bits are not the ones for which it stands, which is nearly all that share it by chance.

Equal sets are one class from the start. A signature's sets are first compared with one of them, by whole sketches and then as full
sets. Where those that remain still lie in several components, all pairs across components are held against each other, in cells
of a few hundred sketches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix64, rows_of, shingles, small, word_hashes, written
from .components import components
from .near_dedup import confirmed

#: Bands grow by a quarter; a word of a sketch has 32 places, for some three elements of the largest set.
GROWTH, WORD = 1.25, 32
#: Sets on a side of a cell; sets of a signature up to which all its pairs' carried values are compared (longer ones pass whole).
BLOCK, MOST = 256, 4096


class Bands:
    """How sets of each size are sketched for links of at least ``percent``."""

    def __init__(self, percent: int):
        self.percent = percent
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, int(edges[-1] * GROWTH)))
        self.edges = np.array(edges)

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.edges, n, "right")) - 1

    def most(self, a: int, b: int) -> int:
        """The largest symmetric difference of linked sets of these sizes."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def groups(self, band: int) -> int:
        """0 where only equal sets can link."""
        top = int(self.edges[band + 1]) - 1
        t = self.most(top, top)
        return t // 2 + 1 if t else 0

    def asked(self, n: int) -> list[int]:
        """The bands for which a set of n elements is sketched: its own, then those whose least sets may link with it."""
        out = [self.of(n)]
        while 100 * n >= self.percent * int(self.edges[out[-1] + 1]):
            out.append(out[-1] + 1)
        return out

    def fit(self, a: int, b: int) -> bool:
        return 100 * min(a, b) >= self.percent * max(a, b) > 0


def sketch(x: np.ndarray, groups: int) -> np.ndarray:
    """The parity words of distinct 64-bit elements: three words a group."""
    h = mix64(x)
    place = ((h >> U64(32)) * U64(3 * groups) >> U64(32)).astype(np.int64) * WORD + (h & U64(WORD - 1)).astype(np.int64)
    odd = (np.bincount(place, minlength=3 * groups * WORD) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<u4")


def signatures(words: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Three 63-bit values a group, two of its three words with the numbers of group and pair, and what each carries."""
    w = words.reshape(-1, 3)
    wide = w.astype(U64)
    pairs = np.stack([wide[:, i] | wide[:, j] << U64(32) for i, j in ((0, 1), (0, 2), (1, 2))], 1).ravel()
    number = np.arange(len(pairs), dtype=U64) | U64(band + 1) << U64(40)
    after = np.roll(np.bitwise_xor.reduce(w, 1), -1)
    return (mix64(mix64(pairs) * U64(0x9E3779B97F4A7C15) + number) >> U64(1)).view(np.int64), (w[:, ::-1] ^ after[:, None]).ravel()


def sketched(docs: DataFrame, width: int, bands: Bands) -> DataFrame:
    """``doc_id, n_shingles, digest, band, parts`` of whole texts: the set's own band and its sketches for that and the following ones."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("band", pa.int32()), ("parts", pa.list_(pa.binary()))])

    def run(batches):
        for part in rows_of(batches):
            out = []
            for text in part.column(1).to_pylist():
                own = np.unique(shingles(word_hashes(text), width))
                asked = bands.asked(len(own)) if len(own) else []
                out.append((len(own), xxhash.xxh3_128_digest(own.tobytes()), asked[0] if asked else -1, [sketch(own, g).tobytes() if (g := bands.groups(b)) else b"" for b in asked]))
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(zip(*out), list(schema)[1:]))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, digest binary, band int, parts array<binary>")


def together(sets: DataFrame) -> DataFrame:
    """``key, lead, node``: the sets that share a signature and what it carries with one another, each beside the first of them.

    The first is the least node of the signature's own band; sets that only visit it come after, and don't meet without one. The lowest
    bit of the value sent says which is which. A partition is read in order; of a signature at most ``MOST`` rows are held, and longer
    ones are let through unlooked at.
    """

    def emit(batches):
        for part in rows_of(batches):
            values, carried, sizes = [], [], []
            for band, parts in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                n = 0
                for k, words in enumerate(parts):
                    if words:
                        v, c = signatures(np.frombuffer(words, "<u4"), band + k)
                        values.append(v << 1 | (k > 0))
                        carried.append(c)
                        n += len(v)
                sizes.append(n)
            flat = np.concatenate(values) if values else np.zeros(0, np.int64)
            more = np.concatenate(carried).view(np.int32) if values else np.zeros(0, np.int32)
            node = np.repeat(part.column(0).to_numpy(), sizes)
            for at in range(0, len(flat), 1 << 17):
                cut = slice(at, at + (1 << 17))
                yield pa.RecordBatch.from_arrays([pa.array(flat[cut]), pa.array(node[cut]), pa.array(more[cut])], names=["value", "node", "carried"])

    def alike(value, node, carried):
        """Of whole signatures: the rows that have a partner."""
        key, home = value >> 1, (value & 1) == 0
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(starts, len(key)))
        two = starts[(sizes == 2) & home[starts]]
        two = two[(np.bitwise_count(carried[two] ^ carried[two + 1]) <= 3) & (node[two] != node[two + 1])]
        out = [(key[two], node[two], node[two + 1])]
        for a, n in zip(starts[(sizes > 2) & home[starts]], sizes[(sizes > 2) & home[starts]]):
            own, here, c = node[a : a + n], home[a : a + n], carried[a : a + n]
            some = np.zeros(n, bool)
            for at in range(0, n, BLOCK):
                cut = slice(at, at + BLOCK)
                near = (np.bitwise_count(c[cut, None] ^ c) <= 3) & (here[cut, None] | here) & (own[cut, None] != own)
                some[cut] = near.any(1)
            if some.any():
                kept = own[some]
                lead = own[some & here][0]
                kept = kept[kept != lead]
                out.append((np.full(len(kept), key[a]), np.full(len(kept), lead), kept))
        return [np.concatenate(x) for x in zip(*out)]

    def batch(key, lead, node):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (key, lead, node)], names=["key", "lead", "node"])

    def meet(batches):
        value, node, carried = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        long = None  # a signature with more rows than are held, and its first node
        for part in batches:
            if not part.num_rows:
                continue
            value, node, carried = (np.concatenate(x) for x in ((value, part.column(0).to_numpy()), (node, part.column(1).to_numpy()), (carried, part.column(2).to_numpy().view(np.uint32))))
            if long:
                n = int(np.searchsorted(value >> 1, long[0], "right"))
                rest = node[:n][node[:n] != long[1]] if long[2] else node[:0]
                yield batch(np.full(len(rest), long[0]), np.full(len(rest), long[1]), rest)
                value, node, carried = value[n:], node[n:], carried[n:]
                if not len(value):
                    continue
                long = None
            last = int(np.searchsorted(value >> 1, value[-1] >> 1))
            if last:
                yield batch(*alike(value[:last], node[:last], carried[:last]))
                value, node, carried = value[last:], node[last:], carried[last:]
            if len(value) > MOST:
                long = (int(value[0] >> 1), int(node[0]), (int(value[0]) & 1) == 0)
                rest = node[node != long[1]] if long[2] else node[:0]
                yield batch(np.full(len(rest), long[0]), np.full(len(rest), long[1]), rest)
                value, node, carried = value[:0], node[:0], carried[:0]
        if len(value):
            yield batch(*alike(value, node, carried))

    rows = sets.select("node", "band", "parts").mapInArrow(emit, "value bigint, node bigint, carried int")
    return rows.repartition(F.shiftright("value", 1)).sortWithinPartitions("value", "node").mapInArrow(meet, "key bigint, lead bigint, node bigint")


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def pair_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], schema=PAIR)


def _fit(bands: Bands, n: str, m: str):
    return F.lit(100) * F.least(n, m) >= F.lit(bands.percent) * F.greatest(n, m)


def screened(pairs: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """The pairs ``(a, b)`` whose sizes fit and whose sketches, for the larger one's band, allow a link. A set of many pairs is split by the join."""
    of = lambda x, *c: [F.col(n).alias(f"{n}_{x}") for n in ("node", *c)]
    sizes = small(written(sets.select("node", "n", "band"), "sizes"))
    sized = pairs.join(sizes.select(*of("a", "n", "band")), F.col("a") == F.col("node_a")).join(sizes.select(*of("b", "n", "band")), F.col("b") == F.col("node_b")).filter(_fit(bands, "n_a", "n_b"))
    sized = sized.select("a", "b", "n_a", "n_b", F.greatest("band_a", "band_b").alias("at"))
    part = lambda x: sets.select(F.col("node").alias(f"node_{x}"), F.col("n").alias(f"_n_{x}"), F.col("band").alias(f"band_{x}"), F.col("parts").alias(f"parts_{x}"))
    both = sized
    for x in "ab":
        both = both.join(part(x), (F.col(x) == F.col(f"node_{x}")) & (F.col(f"n_{x}") == F.col(f"_n_{x}"))).withColumn(f"s_{x}", F.get(f"parts_{x}", F.col("at") - F.col(f"band_{x}"))).drop(f"node_{x}", f"parts_{x}", f"band_{x}", f"_n_{x}")
    both = both.select("a", "b", "n_a", "n_b", "s_a", "s_b")

    def run(batches):
        for part in rows_of(batches):
            found = []
            for a, b, n, m, x, y in zip(*(part.column(k).to_pylist() for k in range(6))):
                if int(np.bitwise_count(np.frombuffer(x, "<u4") ^ np.frombuffer(y, "<u4")).sum()) <= bands.most(n, m):
                    found.append((a, b))
            yield pair_batch(found)

    return both.mapInArrow(run, "a bigint, b bigint")


class Held:
    """The sketches of a cell's first block, as rows of one array."""

    def __init__(self, words: int):
        self.n, self.size, self.doc, self.comp, self.home, self.words = 0, np.zeros(64, np.int64), np.zeros(64, np.int64), np.zeros(64, np.int64), np.zeros(64, bool), np.zeros((64, words), np.uint32)

    def add(self, size, doc, comp, home, words):
        if self.n == len(self.size):
            for name in ("size", "doc", "comp", "home", "words"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate((old, np.zeros_like(old))))
        self.size[self.n], self.doc[self.n], self.comp[self.n], self.home[self.n], self.words[self.n] = size, doc, comp, home, words
        self.n += 1

    def near(self, bands, size, doc, comp, home, words):
        """Documents of other components whose sketches allow a link with this one; two that only visit the band are compared elsewhere."""
        s = self.size[: self.n]
        may = np.flatnonzero((self.comp[: self.n] != comp) & (self.doc[: self.n] != doc) & (self.home[: self.n] | home) & (100 * np.minimum(s, size) >= bands.percent * np.maximum(s, size)))
        if not len(may):
            return []
        most = (100 - bands.percent) * (s[may] + size) // (100 + bands.percent)
        part = len(words) // 4  # most pairs that don't fit show it in a quarter
        seen = np.bitwise_count(self.words[may, :part] ^ words[:part]).sum(1, dtype=np.int64)
        still = seen <= most
        may, most, seen = may[still], most[still], seen[still]
        seen += np.bitwise_count(self.words[may, part:] ^ words[part:]).sum(1, dtype=np.int64)
        return self.doc[may[seen <= most]].tolist()


def screened_across(mixed: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """Pairs ``(a, b)`` of different components of a region of ``mixed(region, members, band, node, comp)`` whose sketches allow a link.

    A region's sets are dealt into blocks; a cell is two blocks, so it holds about ``BLOCK`` sketches and reads the second as a stream. Only
    the sketch for the region's band is sent.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("members") / BLOCK)).cast("int")
    dealt = mixed.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumnRenamed("band", "at")
    own = sets.withColumnRenamed("node", "of")
    cut = dealt.join(own, F.col("node") == F.col("of")).withColumn("words", F.get("parts", F.col("at") - F.col("band"))).filter("length(words) > 0")
    cut = cut.select("region", "blocks", "own", F.col("node").alias("doc"), "comp", "n", (F.col("at") == F.col("band")).alias("home"), "words")
    other = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = other.select("region", F.least("own", "other").alias("r"), F.greatest("own", "other").alias("c"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("role"), "doc", "comp", "n", "home", "words")

    def run(batches):
        at, held = None, None
        for part in rows_of(batches):
            found = []
            for region, r, c, role, doc, comp, n, home, words in zip(*(part.column(k).to_pylist() for k in range(9))):
                own = np.frombuffer(words, "<u4")
                if (region, r, c) != at:
                    at, held = (region, r, c), Held(len(own))
                if r == c or role == 1:  # within a block, or a block's sets with those of the one that is held
                    found += [(k, doc) for k in held.near(bands, n, doc, comp, home, own)]
                if role == 0:
                    held.add(n, doc, comp, home, own)
            yield pair_batch(found)

    return rows.repartition("region", "r", "c").sortWithinPartitions("region", "r", "c", "role").mapInArrow(run, "a bigint, b bigint")


def linked(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs(doc_id, text, ...)``: exact components of the links
    ``100 * intersection >= percent * union``.

    Null and empty texts have an empty set and link with nothing. Texts of fewer than ``width`` words are one shingle; longer ones are read
    whole. Rows that repeat a ``doc_id`` are one document, linked by any of its texts; its row for each text has that text's size.
    Rows with a null id link with nothing and have a null component. An empty table gives no rows; other columns are ignored.
    """
    bands = Bands(percent)
    own = written(sketched(docs, width, bands), "parity")
    some = own.filter("n_shingles > 0 and doc_id is not null")
    classes = written(some.groupBy("digest").agg(F.min("doc_id").alias("node"), F.max("n_shingles").alias("n")).select(F.col("digest").alias("cls"), "node", "n"), "classes")
    sets = written(some.join(small(classes), (F.col("doc_id") == F.col("node")) & (F.col("digest") == F.col("cls"))).select("node", "n", "band", "parts").filter(F.exists("parts", lambda p: F.length(p) > 0)).distinct(), "parity-sets")
    shared = written(together(sets), "shared")

    def confirm(pairs):
        pairs = written(pairs, "screened")
        nodes = small(written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "nodes"))
        texts = written(docs.select("doc_id", "text").join(nodes, F.col("doc_id") == F.col("node")).select("node", "text"), "texts")
        return written(confirmed(pairs, texts, width, percent), "links")

    links = confirm(screened(shared.select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct(), sets, bands).distinct())
    labels = written(components(links), "labels")
    # what is left: signatures whose other sets lie in several components
    now = shared.join(small(labels.withColumnRenamed("node", "of")), F.col("node") == F.col("of"), "left").select("key", "lead", "node", F.coalesce("component", "node").alias("comp"))
    several = now.groupBy("key", "lead").agg(F.count(F.lit(1)).alias("members"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sign"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
    home = sets.groupBy("node").agg(F.max("band").alias("band"), F.min("band").alias("least"))
    several = several.join(home, F.col("lead") == F.col("node")).drop("node")
    regions = written(several.groupBy("members", "sign", "band", "least").agg(F.min(F.struct("key", "lead")).alias("x")).select(F.col("x.key").alias("region"), F.col("x.lead").alias("first"), "members", F.explode(F.sequence("least", "band")).alias("band")), "regions")  # the same sets are compared once
    if not regions.isEmpty():
        mixed = written(now.join(regions, (F.col("key") == F.col("region")) & (F.col("lead") == F.col("first"))).select(F.xxhash64("region", "first", "band").alias("region"), "members", "band", "node", "comp").distinct(), "mixed")
        links = links.unionByName(confirm(screened_across(mixed, sets, bands).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))
    placed = own.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    placed = written(placed.join(classes.select("cls", "node"), F.col("digest") == F.col("cls"), "left").select("doc_id", "n_shingles", "node"), "placed")
    # a document of several texts joins their classes
    apart = placed.filter("node is not null").groupBy("doc_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select(F.col("doc_id").alias("id"), "lo")
    joined = placed.join(apart, F.col("doc_id") == F.col("id")).select(F.col("lo").alias("a"), F.col("node").alias("b"))
    found = written(components(links.unionByName(joined)), "labels").select(F.col("node").alias("of"), "component")
    return placed.join(found, F.col("node") == F.col("of"), "left").select("doc_id", "n_shingles", F.coalesce("component", "node", "doc_id").alias("component_id"))
