"""Hard negatives by product quantisation with stored residual norms; results are exact.

Every row x is stored as a code (one of 256 integer entries for each two components, x' in all) and the norm of its residual x - x'.
For an anchor a, tables of the inner products of its parts with all entries give <a, x'> by look-ups, exactly; and since
|<a, x> - <a, x'>| <= |a| |x - x'|, the score lies in a known interval. A row is looked at again, by its integers, only if its
interval reaches what the anchor, or one of its windows, still has room for. So the codebooks decide the speed, never the result.

The stated anchors meet all rows in cells of a few hundred anchors by some thousands of rows: a cell holds its anchors, streams its
rows and gives at most k rows an anchor and window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import rows_of, written
from .vector_codes import block_of, usable, whole_vectors

WIDTH, ENTRIES = 2, 256
#: Rows on which the codebooks are fitted (those with the least hash); all rows are indexed.
SAMPLE, ROUNDS = 4096, 6
#: Anchors and, about, rows of a cell; rows compared at once.
ANCHORS, CELL, STEP = 512, 32_768, 256
LEAST_CELLS = 24
NONE = np.iinfo(np.int64).min


def fit(vectors: DataFrame, dims: int) -> np.ndarray:
    """Codebooks (parts, entries, width) of integers from a bounded sample; an odd last component has a zero beside it."""
    got = vectors.orderBy(F.xxhash64("vec_id", "q"), "q").limit(SAMPLE).select("q").toArrow().column(0).combine_chunks()
    x = split(block_of(got, dims))
    books = []
    for p in range(x.shape[1]):
        own = x[:, p].astype(np.float64)
        c = np.unique(own, axis=0)
        c = c[:: max(1, -(-len(c) // ENTRIES))]
        for _ in range(ROUNDS):
            at = rough(own, c)
            n = np.bincount(at, minlength=len(c))
            mean = np.stack([np.bincount(at, own[:, j], len(c)) for j in range(WIDTH)], 1) / np.maximum(n, 1)[:, None]
            c = np.where(n[:, None] > 0, np.rint(mean), c)
        books.append(np.concatenate([c, np.repeat(c[:1], ENTRIES - len(c), 0)]).astype(np.int64))
    return np.stack(books)


def split(x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, -x.shape[1] % WIDTH))).reshape(len(x), -1, WIDTH)


def rough(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A near entry for each row: the nearest but for rounding, which the residual norms make up for."""
    return ((c * c).sum(1) - 2.0 * (x @ c.T)).argmin(1)


def index(vectors: DataFrame, books: np.ndarray, dims: int) -> DataFrame:
    """The written table ``vec_id, label, q, code, residual``; ``residual`` is never less than the true norm."""
    sent = vectors.sparkSession.sparkContext.broadcast(books)
    label = dict(vectors.dtypes)["label"]

    def run(batches):
        held = sent.value
        for part in rows_of(batches):
            x = split(block_of(part.column(2), dims))
            code = np.stack([rough(x[:, p].astype(np.float64), held[p].astype(np.float64)) for p in range(x.shape[1])], 1)
            gap = np.stack([x[:, p] - held[p][code[:, p]] for p in range(x.shape[1])], 1).astype(np.float64)
            norm = np.sqrt((gap * gap).sum((1, 2))) * (1 + 2.0**-40)
            raw, w = code.astype(np.uint8).tobytes(), x.shape[1]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([raw[k : k + w] for k in range(0, len(raw), w)], pa.binary()), pa.array(norm)], names=["vec_id", "label", "q", "code", "residual"])

    return written(vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", "q").mapInArrow(run, f"vec_id bigint, label {label}, q binary, code binary, residual double"), "pq-index")


def keys_of(labels: pa.Array) -> np.ndarray:
    """Labels as something that numpy compares: numbers as they are, others as objects."""
    return labels.to_numpy(zero_copy_only=False) if pa.types.is_integer(labels.type) else np.array(labels.to_pylist(), object)


class Best:
    """The first ``k`` rows of each slot, by score downwards and id upwards (null ids last)."""

    def __init__(self, slots: int, k: int):
        self.k, self.floor = k, np.full(slots, NONE)
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.lost = np.zeros(0, bool)  # whether the id is null

    def add(self, slot, score, ids, lost):
        if not len(slot):
            return
        slot, score, ids, lost = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, ids), (self.lost, lost)))
        order = np.lexsort((ids, lost, -score, slot))
        slot = slot[order]
        nth = np.arange(len(slot)) - np.searchsorted(slot, slot)
        keep = nth < self.k
        order = order[keep]
        self.slot, self.score, self.id, self.lost = slot[keep], score[order], ids[order], lost[order]
        full = nth == self.k - 1
        self.floor[slot[full]] = score[order][full[keep]]

    def rows(self):
        return self.slot, self.score, pa.array(self.id, pa.int64(), mask=self.lost)


class Cell:
    """The anchors of one cell and what they have found so far. Without windows: the best of the same label; with them, for each
    window ``(low, high)`` of an anchor the best of other labels whose score lies in it."""

    def __init__(self, ids, labels, q, books, k: int, windows=None):
        self.ids, self.labels, self.k = np.array(ids, np.int64), labels, k
        self.q = q
        self.norm = np.sqrt((q.astype(np.float64) ** 2).sum(1)) * (1 + 2.0**-40)
        self.tables = [books[p] @ a.T for p, a in enumerate(split(q).transpose(1, 0, 2))]  # (entries, anchors) a part
        self.windows = windows
        self.width = 1 if windows is None else windows.shape[1]
        self.best = Best(len(ids) * self.width, k)

    def meet(self, ids, lost, labels, q, code, residual):
        score = self.tables[0][code[:, 0]].copy()
        for p in range(1, code.shape[1]):
            score += self.tables[p][code[:, p]]
        off = np.floor(residual[:, None] * self.norm * (1 + 2.0**-40)).astype(np.int64) + 1
        same = labels[:, None] == self.labels
        top = score + off
        floor = self.best.floor.reshape(-1, self.width)
        if self.windows is None:
            may = same & (top >= floor[:, 0]) & ((ids[:, None] != self.ids) | lost[:, None])
        else:
            low, high = self.windows[..., 0], self.windows[..., 1]
            may = np.zeros_like(same)
            for w in range(self.width):
                may |= (top >= np.maximum(low[:, w], floor[:, w])) & (score - off <= high[:, w])
            may &= ~same
        row, a = np.nonzero(may)
        for at in range(0, len(row), 1 << 16):
            i, j = row[at : at + (1 << 16)], a[at : at + (1 << 16)]
            exact = np.einsum("nd,nd->n", q[i], self.q[j])
            if self.windows is None:
                self.best.add(j, exact, ids[i], lost[i])
                continue
            for w in range(self.width):
                fits = (exact >= low[j, w]) & (exact <= high[j, w])
                self.best.add(j[fits] * self.width + w, exact[fits], ids[i][fits], lost[i][fits])


def cells(rows: DataFrame, anchors: DataFrame, blocks: int, columns: int) -> DataFrame:
    """``block, seat, role, id, label, q, code, residual, scores``: each row once a block of anchors, each anchor once a seat, an
    anchor (role 0) before the rows it meets. Seats follow the rows' places, so repeated or null ids don't gather."""
    seat = F.pmod(F.monotonically_increasing_id(), F.lit(columns)).cast("int")
    every = lambda n, c: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(c)
    r = rows.withColumn("seat", seat).select(every(blocks, "block"), "seat", F.lit(1).alias("role"), "vec_id", "label", "q", "code", "residual", F.lit(None).cast("array<bigint>").alias("scores"))
    a = anchors.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), every(columns, "seat"), F.lit(0).alias("role"), "vec_id", "label", "q", "code", "residual", "scores")
    return r.unionByName(a).repartition(max(1, min(blocks * columns, 10_000)), "block", "seat").sortWithinPartitions("block", "seat", "role", "vec_id")


def met(placed: DataFrame, books: np.ndarray, dims: int, k: int, percents: tuple[int, int] | None) -> DataFrame:
    """``anchor_id, slot, other_id, score``: what each cell's anchors found; ``slot`` is the position of the positive."""
    sent = placed.sparkSession.sparkContext.broadcast(books)
    schema = pa.schema([("anchor_id", pa.int64()), ("slot", pa.int32()), ("other_id", pa.int64()), ("score", pa.int64())])

    def bounds(scores, most):
        found = [(-(-percents[0] * s // 100), percents[1] * s // 100) for s in scores]
        return found + [(1, 0)] * (most - len(found))

    def result(cell):
        slot, score, other = cell.best.rows()
        return pa.RecordBatch.from_arrays([pa.array(cell.ids[slot // cell.width]), pa.array(slot % cell.width, pa.int32()), other, pa.array(score)], schema=schema)

    def run(batches):
        held, at, gathered, cell = sent.value, None, [], None
        for part in rows_of(batches, most_rows=STEP):
            keys = np.stack([part.column(c).to_numpy() for c in range(3)], 1)
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(keys)]):
                own, (block, seat, role) = part.slice(lo, hi - lo), keys[lo]
                if (block, seat) != at:
                    if cell is not None:
                        yield result(cell)
                    at, gathered, cell = (block, seat), [], None
                if role == 0:
                    gathered.append(own)
                    continue
                if not gathered and cell is None:
                    continue  # no anchor is in this block
                if cell is None:
                    t = pa.Table.from_batches(gathered).combine_chunks()
                    windows = None
                    if percents:
                        scores = t.column("scores").to_pylist()
                        windows = np.array([bounds(s or [], max(1, max(len(s or []) for s in scores))) for s in scores], np.int64)
                    cell, gathered = Cell(t.column("vec_id").to_numpy(), keys_of(t.column("label").combine_chunks()), block_of(t.column("q").combine_chunks(), dims), held, k, windows), []
                ids = own.column(3)
                code = np.frombuffer(b"".join(own.column(6).to_pylist()), np.uint8).reshape(own.num_rows, -1)
                cell.meet(ids.fill_null(0).to_numpy().astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False), keys_of(own.column(4)), block_of(own.column(5), dims), code, own.column(7).to_numpy())
        if cell is not None:
            yield result(cell)

    return placed.mapInArrow(run, "anchor_id bigint, slot int, other_id bigint, score bigint")


def first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of ``found`` a key, with ``nth`` from 1; cells keep no more than k each, tasks none beyond k before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("other_id").asc_nulls_last())
    return found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k)


OUT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def mine(df: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, percents: tuple[int, int] = (80, 100)) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for ``df(vec_id, embedding, label, ...)``.

    Anchors are the rows whose id ``every`` divides; of rows that repeat such an id the one of the least label and integers. An anchor's
    positives are its first ``positives`` rows of the same label and another id, its negatives for each positive the first ``negatives`` rows of
    other labels with a score between those percents of the positive's: by score downwards, then id upwards. Scores are inner
    products of ``floor(256 * x)``. Repeated rows are rows of their own; rows with a null id are never anchors and come last among ties. Rows with
    a null label, a null vector or a null or non-finite component take no part, nor do empty vectors and those of another length
    than the table's (see ``vector_codes.usable``). Components beyond 65,536 are held there. Empty tables, tables without anchors and
    anchors without positives give no rows; other columns are ignored.
    """
    spark = df.sparkSession
    vectors, dims = usable(whole_vectors(df.filter("label is not null").select("vec_id", "label", "embedding")), 1)
    if not dims:
        return spark.createDataFrame([], OUT)
    books = fit(vectors, dims)
    rows = index(vectors, books, dims)
    whole = F.struct("label", "q", "code", "residual")
    anchors = written(rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(whole).alias("x")).select("vec_id", "x.*"), "anchors")
    n_rows, n_anchors = rows.count(), anchors.count()
    if not n_anchors:
        return spark.createDataFrame([], OUT)
    blocks, columns = -(-n_anchors // ANCHORS), max(LEAST_CELLS, -(-n_rows // CELL))
    near = met(cells(rows, anchors.withColumn("scores", F.lit(None).cast("array<bigint>")), blocks, columns), books, dims, positives, None)
    liked = written(first(near, ["anchor_id"], positives).select("anchor_id", (F.col("nth") - 1).alias("slot"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    scores = liked.groupBy("anchor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))), lambda s: s["positive_score"]).alias("scores"))
    asking = anchors.join(scores, anchors.vec_id == scores.anchor_id).drop("anchor_id")
    found = first(met(cells(rows, asking, blocks, columns), books, dims, negatives, percents), ["anchor_id", "slot"], negatives)
    return found.join(liked, ["anchor_id", "slot"]).select("anchor_id", "positive_id", F.col("nth").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
