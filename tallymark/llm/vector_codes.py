"""Vector code compression: integer product quantisation, exact although most of the work is a float32 matrix product.

A part's squared distance to an entry c is |x|^2 + (|c|^2 - 2 x.c). The bracket is computed for all entries at once in float32. Its
rounding error is at most gamma * (|c|^2 + 2 |x|_1 max|c|) with gamma = k u / (1 - k u), u = 2**-24 and k = part width + 4: a dot
product of w terms in any order, with or without fused steps, errs by gamma_w times the sum of absolute products; the
subtraction and the conversion of |c|^2 add one rounding each (two are spare). So every entry has an interval that holds its true
value. Entries whose interval overlaps that of the best are evaluated again in int64; the least wins, ties go to the lower index.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, small, unused, written

#: Components are held within this bound (|x| <= 65,536), so that sums of squares and products fit int64 up to 4,096 components.
LIMIT = 1 << 24
UNIT = 2.0**-24


def integers(vectors: pa.Array, scale: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(good, lengths, values)`` of a list column: which vectors are whole and finite, how long each is, and the components
    ``floor(scale * x)`` of the good ones, one after the other. Values beyond ``LIMIT`` are held there."""
    n = len(vectors)
    known = vectors.is_valid().to_numpy(zero_copy_only=False)
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten()  # nulls' slots are left out
    x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64)  # a null component becomes NaN
    owner = np.repeat(np.arange(n), lengths)
    bad = np.bincount(owner[~np.isfinite(x)], minlength=n) > 0
    good = known & ~bad
    return good, lengths, np.clip(np.floor(x[good[owner]] * scale), -LIMIT, LIMIT).astype(np.int64)


def whole_vectors(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", extra: tuple[str, ...] = ("label",), what: str = "vectors") -> DataFrame:
    """A written table ``id, *extra, dims, q``: the rows whose vector is whole and finite, ``q`` their integers as little-endian int32."""
    fields = {f.name: f for f in df.schema.fields}
    shape = ", ".join([f"`{id_col}` {fields[id_col].dataType.simpleString()}", *(f"`{c}` {fields[c].dataType.simpleString()}" for c in extra), "dims int", "q binary"])

    def run(batches):
        for part in rows_of(batches):
            good, lengths, values = integers(part.column(part.num_columns - 1))
            keep = part.filter(pa.array(good))
            own, raw = lengths[good], values.astype("<i4").tobytes()
            ends = 4 * np.concatenate(([0], np.cumsum(own)))
            q = pa.array([raw[a:b] for a, b in zip(ends, ends[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*keep.columns[:-1], pa.array(own, pa.int32()), q], names=[*keep.schema.names[:-1], "dims", "q"])

    return written(df.select(id_col, *extra, vector).mapInArrow(run, shape), what)


def block_of(q: pa.Array, dims: int) -> np.ndarray:
    """The integers of a batch, a row a vector."""
    return np.frombuffer(b"".join(q.to_pylist()), "<i4").reshape(len(q), dims).astype(np.int64)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` (n, w) the index of the nearest row of ``entries`` (m, w), ties to the lower, and the squared distance.

    All arrays hold int64 values of at most ``LIMIT``; n may be 0, m is at least 1.
    """
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    squares = (entries * entries).sum(1)
    k = x.shape[1] + 4
    gamma = k * UNIT / (1 - k * UNIT)
    about = squares.astype(np.float32) - np.float32(2) * (x.astype(np.float32) @ entries.astype(np.float32).T)
    slack = gamma * (float(squares.max()) + 2.0 * np.abs(x).sum(1) * float(np.abs(entries).max(initial=0))) * (1 + 2.0**-30)
    about = about.astype(np.float64)
    row, col = np.nonzero(about <= (about.min(1) + 2 * slack)[:, None])
    gap = x[row] - entries[col]
    exact = (gap * gap).sum(1)
    starts = np.searchsorted(row, np.arange(len(x)))
    best = np.minimum.reduceat(exact, starts)
    hit = np.flatnonzero(exact == best[row])  # in order of row, then index
    first = hit[np.searchsorted(row[hit], np.arange(len(x)))]
    return col[first], best


def _moved(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every part goes to its nearest entry, every entry that has parts to the floor of their mean."""
    parts, m, w = books.shape
    sent = vectors.sparkSession.sparkContext.broadcast(books)
    schema = pa.schema([("slot", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def run(batches):
        held = sent.value
        n, sums = np.zeros(parts * m, np.int64), np.zeros((parts * m, w), np.int64)
        for part in rows_of(batches):
            x = block_of(part.column(0), parts * w).reshape(-1, parts, w)
            for p in range(parts):
                slot = p * m + nearest(x[:, p], held[p])[0]
                n += np.bincount(slot, minlength=parts * m)
                np.add.at(sums, slot, x[:, p])
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at]), pa.array(list(sums[at]), pa.list_(pa.int64()))], schema=schema)

    each = [F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(w)]
    got = vectors.select("q").mapInArrow(run, "slot int, n bigint, sums array<bigint>").groupBy("slot").agg(F.sum("n").alias("n"), *each).toArrow()  # a row an entry
    new = books.reshape(parts * m, w).copy()
    if got.num_rows:
        at, n = got.column("slot").to_numpy(), got.column("n").to_numpy()
        new[at] = np.stack([got.column(f"s{j}").to_numpy() for j in range(w)], 1) // n[:, None]
    return new.reshape(parts, m, w)


def train(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, id_col: str = "vec_id") -> np.ndarray | None:
    """Codebooks (parts, entries, width) from a table of ``whole_vectors``; None where it has no usable row.

    They start as the parts of the rows with the least ids (equal ids: the least integers first; null ids last), as many as there are
    where these are fewer than ``entries``. All rows take part in every round; the driver gets one row an entry.
    """
    first = vectors.orderBy(F.col(id_col).asc_nulls_last(), "q").limit(entries).select("q").toArrow().column(0)
    if not len(first):
        return None
    rows = [np.frombuffer(b, "<i4").astype(np.int64) for b in first.to_pylist()]
    books = np.stack(rows).reshape(len(rows), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = _moved(vectors, books)
    return books


def usable(vectors: DataFrame, parts: int, id_col: str = "vec_id") -> tuple[DataFrame, int]:
    """The rows of the table's dimension and that dimension: of the lengths that are positive multiples of ``parts`` it is that of the
    least id. Rows of other lengths take no part. 0 where there are none."""
    fit = vectors.filter((F.col("dims") > 0) & (F.col("dims") % parts == 0))
    first = fit.orderBy(F.col(id_col).asc_nulls_last(), "dims").select("dims").limit(1).collect()
    dims = first[0]["dims"] if first else 0
    return fit.filter(F.col("dims") == dims), dims


def book_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


CODED = "error bigint, code string"


def encode(df: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` for ``df(vec_id, embedding, label, ...)``.

    Rows with a null vector or a null or non-finite component are left out, as are rows whose length is not the table's (see
    ``usable``); empty vectors never fit. ``code`` has two hex digits a part. Repeated rows are coded each; rows with a null id are
    coded too, and null labels are one label. Equal distances go to the lower index. Components beyond 65,536 are held there. An empty table
    gives no rows; other columns are ignored. Vectors may have up to 4,096 components.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    vectors, dims = usable(whole_vectors(df.select("vec_id", "label", "embedding")), parts)
    books = train(vectors, parts, entries, rounds)
    fields = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    shape = f"vec_id {fields['vec_id']}, label {fields['label']}, {CODED}"
    if books is None:
        return df.sparkSession.createDataFrame([], f"vec_id {fields['vec_id']}, code string, error bigint, label_error bigint, codebooks_sha256 string")
    sent = df.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        held = sent.value
        for part in rows_of(batches):
            x = block_of(part.column(2), dims).reshape(-1, parts, dims // parts)
            found = [nearest(x[:, p], held[p]) for p in range(parts)]
            raw = np.stack([c for c, _ in found], 1).astype(np.uint8).tobytes().hex()
            codes = [raw[k : k + 2 * parts] for k in range(0, len(raw), 2 * parts)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sum(d for _, d in found), pa.int64()), pa.array(codes, pa.string())], names=["vec_id", "label", "error", "code"])

    coded = written(vectors.select("vec_id", "label", "q").mapInArrow(run, shape), "codes")
    key = unused(coded, "label")
    sums = small(written(coded.groupBy(F.col("label").alias(key)).agg(F.sum("error").alias("label_error")), "label-errors"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col(key)), "inner").select("vec_id", "code", "error", "label_error", F.lit(book_digest(books)).alias("codebooks_sha256"))
