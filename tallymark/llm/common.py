"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only where it is unset (tests)."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not getattr(spark.sparkContext, "_tallymark_dir", None):
        spark.sparkContext._tallymark_dir = tempfile.mkdtemp(prefix="tallymark-")
        spark.sparkContext.setCheckpointDir(spark.sparkContext._tallymark_dir)
    return f"file://{spark.sparkContext._tallymark_dir}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: lineage ends there, and a lost executor loses none of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallymark/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a few numbers (24 bytes) up to which a table is broadcast; larger ones are joined by a shuffle.
MOST_BROADCAST = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """``df``, a written table of a few numbers a row, marked for a broadcast if its rows are few enough."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any case: Spark's names ignore it."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_of(batches: Iterator[pa.RecordBatch], most_rows: int = 2000, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded size; a single row is never cut."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, min(most_rows, int(n * most_bytes / max(1, batch.nbytes))))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def by_row(f: Callable[..., tuple], names: list[str], schema: pa.Schema) -> Callable:
    """A ``mapInArrow`` function that calls ``f`` with the named columns of each row and gathers the tuples it returns."""

    def run(batches):
        for part in rows_of(batches):
            cols = [part.column(part.schema.get_field_index(n)).to_pylist() for n in names]
            out = [f(*row) for row in zip(*cols)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    return run


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element (public splitmix64 constants)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class WordIds(dict):
    """Word (bytes) to a 64-bit hash, remembered while the memory is bounded."""

    MOST = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def words_of(text: str | bytes | None) -> list[bytes]:
    """UTF-8 words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased (bytes methods touch ASCII only)."""
    return (text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")).lower().split()


def word_hashes(text: str | bytes | None) -> np.ndarray:
    """The 64-bit hash of each word in order, as in ``WordIds``: where words are too many to recur often, memory gains nothing."""
    words = words_of(text)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))


def shingles(ids: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` words in order; a shorter sequence is one shingle, an empty one none."""
    if not len(ids):
        return ids
    width = min(width, len(ids))
    out = np.full(len(ids) - width + 1, width, U64)
    for k in range(width):
        out = mix64(out * U64(0x9E3779B97F4A7C15) + ids[k : len(ids) - width + 1 + k])
    return out
