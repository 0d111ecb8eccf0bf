"""Token ids as bit-plane-shuffled, compressed chunks.

A chunk holds whole documents in ascending ``doc_id`` order. Its ids (unsigned 32 bit) are cut into fixed blocks,
each block is transposed into bit planes (or byte planes), equal planes of all blocks are laid end to end, and every
plane is compressed with zstandard on its own; planes of zeros only are left out. A chunk row is its own index
entry: shard, number, ids before it in the shard, first document, ids, bytes of each plane. Rows live in Parquet, so Spark's writers commit
them whole on any store and a lost task's output is never seen.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rows_of, written

BLOCK = 4096
CHUNK_IDS = 1 << 17
END = 1


def shuffle_planes(ids: np.ndarray, block: int = BLOCK, mode: str = "bit", level: int = 3) -> list[bytes]:
    """One compressed plane per bit (32) or byte (4), lowest first; empty bytes for a plane of zeros."""
    ids = np.ascontiguousarray(ids, "<u4")
    filled = np.zeros(-(-len(ids) // block) * block, "<u4")
    filled[: len(ids)] = ids
    packer = zstandard.ZstdCompressor(level=level)
    out = []
    used = int(filled.max(initial=0)).bit_length()
    for k in range(32 if mode == "bit" else 4):
        if k * (1 if mode == "bit" else 8) >= used:
            out.append(b"")
            continue
        if mode == "bit":
            plane = np.packbits(((filled >> np.uint32(k)) & np.uint32(1)).astype(np.uint8).reshape(-1, block), axis=1, bitorder="little")
        else:
            plane = ((filled >> np.uint32(8 * k)) & np.uint32(255)).astype(np.uint8)
        out.append(packer.compress(plane.tobytes()) if plane.any() else b"")
    return out


def join_planes(planes: list[bytes], n: int, block: int = BLOCK, mode: str = "bit") -> np.ndarray:
    size = -(-n // block) * block
    ids = np.zeros(size, "<u4")
    opener = zstandard.ZstdDecompressor()
    for k, data in enumerate(planes):
        if not data:
            continue
        raw = np.frombuffer(opener.decompress(data), np.uint8)
        if mode == "bit":
            ids |= np.unpackbits(raw.reshape(-1, block // 8), axis=1, bitorder="little").reshape(-1).astype("<u4") << np.uint32(k)
        else:
            ids |= raw.astype("<u4") << np.uint32(8 * k)
    return ids[:n]


CHUNKS = "shard bigint, chunk bigint, inside bigint, n_ids bigint, n_docs bigint, first_doc bigint, doc_ids binary, lengths binary, mode string, block int, plane_bytes array<int>, planes binary"
_CHUNKS = pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), ("inside", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("first_doc", pa.int64()), ("doc_ids", pa.binary()), ("lengths", pa.binary()), ("mode", pa.string()), ("block", pa.int32()), ("plane_bytes", pa.list_(pa.int32())), ("planes", pa.binary())])


def _chunk_row(shard: int, number: int, inside: int, docs: list, ids: list[np.ndarray], mode: str) -> pa.RecordBatch:
    flat = np.concatenate(ids)
    planes = shuffle_planes(flat, BLOCK, mode)
    known = np.array([x for x in docs if x is not None], "<i8")
    row = (shard, number, inside, len(flat), len(docs), docs[0], zlib.compress(np.array([x is None for x in docs], np.uint8).tobytes() + known.tobytes()), zlib.compress(np.array([len(x) for x in ids], "<i8").tobytes()), mode, BLOCK, [len(p) for p in planes], b"".join(planes))
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _CHUNKS)], schema=_CHUNKS)


def unpack(row: dict) -> tuple[list, list[np.ndarray]]:
    """The documents and ids of a chunk row."""
    ends = np.cumsum([0, *row["plane_bytes"]])
    flat = join_planes([row["planes"][a:b] for a, b in zip(ends[:-1], ends[1:])], row["n_ids"], row["block"], row["mode"])
    raw, n = zlib.decompress(row["doc_ids"]), row["n_docs"]
    missing, known = np.frombuffer(raw[:n], np.uint8), iter(np.frombuffer(raw[n:], "<i8").tolist())
    docs = [None if m else next(known) for m in missing]
    return docs, np.split(flat, np.cumsum(np.frombuffer(zlib.decompress(row["lengths"]), "<i8"))[:-1])


# How the vocabulary normalises and cuts text where words can be encoded by themselves.
NORMALISED = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORDS = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class Coder:
    """Ids of whole texts and the end id: those of ``Tokenizer.encode(text, add_special_tokens=False)`` of the unmodified library.

    Where the vocabulary drops white space and no added token holds any (``word_bpe_49k.json``), a text's ids are those of its
    runs between ASCII white space, end to end, and short runs that recur are remembered. ``whole=True`` encodes texts as they
    are, for any other vocabulary.
    """

    #: Runs remembered, and the longest of them in bytes: together a bound in bytes. Longer runs are encoded where they stand.
    MOST, LONGEST = 600_000, 48

    def __init__(self, vocabulary: bytes, whole: bool = False):
        from tokenizers import Tokenizer, pre_tokenizers

        self.coder = Tokenizer.from_buffer(vocabulary)
        added = self.coder.get_added_tokens_decoder().values()
        self.whole, self.known = whole or any(t.lstrip or t.rstrip or t.content.split() != [t.content] for t in added), {}
        # the same model for words that are lower case already, in lines of them; each ends with an id that is marked
        self.light, self.ends = None, None
        make = json.loads(vocabulary)
        if make.get("normalizer") == NORMALISED and make.get("pre_tokenizer") == WORDS and make["model"].get("end_of_word_suffix") == "</w>":
            self.light = Tokenizer(self.coder.model)
            self.light.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.ascii = Tokenizer(self.coder.model)  # the bytes of its letters stand for themselves
            self.ascii.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.ends = np.zeros(self.coder.get_vocab_size(), bool)
            for token, k in self.coder.get_vocab(with_added_tokens=False).items():
                self.ends[k] = token.endswith("</w>")

    def learn(self, runs: list[bytes]) -> None:
        """Remember the ids (four bytes each) of runs that are new."""
        if not self.light:
            return self._whole_runs(runs)
        known, made, letters, others, rest = self.known, [], set(), set(), set()
        known[b""] = b""
        for w in runs:
            core = w.rstrip(b".,;:!?")
            if core.isalpha():  # ASCII letters
                low = core.lower()
                if low not in known:
                    letters.add(low)
            else:
                text = core.decode()
                # letters that are one character in either case and stay under NFC
                if not text.isalpha() or max(text) >= "\u0180" or "\u0130" in text:
                    rest.add(w)
                    continue
                low = text.lower().encode()
                if low not in known:
                    others.add(low)
            if low != w:  # one word and its punctuation
                tail = w[len(core) :]
                made.append((w, low, tail))
                if tail not in known:
                    rest.add(tail)
        for coder, cores in ((self.ascii, list(letters)), (self.light, list(others))):
            for at in range(0, len(cores), 2000):
                some = cores[at : at + 2000]
                ids = np.array(coder.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
                self._keep(some, ids, np.flatnonzero(self.ends[ids]) + 1)
        self._whole_runs(list(rest))
        for w, core, tail in made:
            known[w] = known[core] + known[tail] if tail else known[core]

    def _whole_runs(self, runs: list[bytes]) -> None:
        for at in range(0, len(runs), 2000):
            some = runs[at : at + 2000]
            coded = self.coder.encode([w.decode() for w in some], is_pretokenized=True, add_special_tokens=False)
            self._keep(some, np.array(coded.ids, "<u4"), np.cumsum(np.bincount(np.array(coded.word_ids, np.int64), minlength=len(some))))

    def _keep(self, runs: list[bytes], ids: np.ndarray, ends: np.ndarray) -> None:
        data, at = ids.tobytes(), 0
        for w, end in zip(runs, (ends * 4).tolist(), strict=True):
            self.known[w] = data[at:end]
            at = end

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text and the end id. Arrow cuts texts and numbers their distinct runs; only those meet the memory."""
        if self.whole:
            return [np.array([*x.ids, END], "<u4") for x in self.coder.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
        cut = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = cut.flatten().dictionary_encode()
        runs = coded.dictionary.cast(pa.binary()).to_pylist()
        if len(self.known) > self.MOST:
            self.known.clear()
        self.learn([w for w in runs if w not in self.known and len(w) <= self.LONGEST])
        known = [self.known[w] if len(w) <= self.LONGEST else self._alone(w) for w in runs]
        known.append(END.to_bytes(4, "little"))
        ids, size = np.frombuffer(b"".join(known), "<u4"), np.fromiter(map(len, known), np.int64, len(known)) // 4
        begin = np.cumsum(size) - size
        ends = cut.offsets.to_numpy()[1:] - cut.offsets[0].as_py()
        order = np.insert(coded.indices.to_numpy(), ends, len(runs))  # the end id after each text's last run
        n = size[order]
        upto = np.cumsum(n)
        flat = ids[np.repeat(begin[order] - upto + n, n) + np.arange(upto[-1])]
        return np.split(flat, upto[ends + np.arange(len(ends))][:-1])

    def _alone(self, run: bytes) -> bytes:
        return np.array(self.coder.encode([run.decode()], is_pretokenized=True, add_special_tokens=False).ids, "<u4").tobytes()


def encode(docs: DataFrame, vocabulary: str | bytes, mode: str = "byte", shards: int | None = None) -> DataFrame:
    """Chunk rows of ``docs(doc_id, text)``: ids of each whole text and the end id, ascending ``doc_id`` (null first), then text.

    ``vocabulary`` is a tokenizer file's path or its bytes; the bytes travel with the plan.
    Null and empty texts are the end id alone. Repeated ids are documents of their own, in the order of their texts. A text of
    any length is one document of one chunk, which holds it whole; other columns are ignored.
    """
    spark = docs.sparkSession
    # a file of some MB, whatever the corpus; a worker keeps its tokenizer, and the runs it knows, beside it from task to task
    data = spark.sparkContext.broadcast({"vocabulary": open(vocabulary, "rb").read() if isinstance(vocabulary, str) else vocabulary})
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        if "coder" not in data.value:
            data.value["coder"] = Coder(data.value["vocabulary"])
        coder = data.value["coder"]
        shard, number, held, ids, n, inside = TaskContext.get().partitionId(), 0, [], [], 0, 0
        for part in rows_of(batches, 2000, 4 << 20):
            for doc, own in zip(part.column(0).to_pylist(), coder.encode(part.column(1))):
                held.append(doc)
                ids.append(own)
                n += len(own)
                if n >= CHUNK_IDS:
                    yield _chunk_row(shard, number, inside, held, ids, mode)
                    number, held, ids, n, inside = number + 1, [], [], 0, inside + n
        if held:
            yield _chunk_row(shard, number, inside, held, ids, mode)

    return docs.select("doc_id", "text").repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(run, CHUNKS)


#: Shards up to which their starts (16 bytes each) are broadcast.
MOST_SHARDS = 200_000


def starts(chunks: DataFrame) -> DataFrame:
    """``shard, before``: ids before each shard. One row a shard, and their number is the writer's number of partitions."""
    from pyspark.sql import Window

    totals = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    return totals.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))


DOCS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_back(chunks: DataFrame) -> DataFrame:
    """One row a document from stored chunks alone."""

    def run(batches):
        for part in rows_of(batches, 16):
            for row in part.to_pylist():
                docs, ids = unpack(row)
                n = np.array([len(x) for x in ids], np.int64)
                first = row["before"] + row["inside"] + np.concatenate(([0], np.cumsum(n)[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(first, pa.int64()), pa.array(n), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())], schema=_DOCS)

    first = written(starts(chunks), "starts")
    return chunks.join(F.broadcast(first) if first.count() <= MOST_SHARDS else first, "shard").mapInArrow(run, DOCS)


def token_file(spark: SparkSession, docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encode, write to the shared folder, read back: ``doc_id, start, n_tokens, ids_crc32``. An empty table gives no rows."""
    return read_back(written(encode(docs, vocabulary), "tokens"))
