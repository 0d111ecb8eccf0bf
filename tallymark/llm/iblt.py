"""Document fingerprints: invertible Bloom lookup tables over paragraph cells.

A cell is a paragraph: a line, or a sentence of a line of more than ``LONG`` words. A table has three sub-tables; each cell
digest is added to one place in each: a count, an XOR of digests, an XOR of check sums. Subtracting two versions' tables
leaves their difference, and peeling places that hold one digest recovers it. A difference too large for a table shows as a
rest, and is tried again in a larger one; the likeness is then exact: shared digests over all digests (Dice).

A sub-table has a power of two of places, and a digest's place is the low bits of a hash, so adding the halves of a table
gives just the table of half the size. A fingerprint is the smallest table that its own text's digests can be peeled from.
Two fingerprints are thus compared at any size: folded where it is smaller than theirs, and where it is larger peeled and
laid out anew. What ``compared`` gets from two fingerprints alone is what ``differences`` gets from the texts' digests.

All tables of a batch are laid end to end and peeled together, round by round.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix64, rows_of, unused

#: Places of the smallest table (a power of two in each of the three sub-tables), and words of a line that is one cell.
PLACES, LONG = 12, 40
_SEEDS = [U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB), U64(0x8EBC6AF09C88C6E3)]
_CHECK = U64(0x589965CC75374CC3)


_SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])\s*")


def paragraphs(text: str | None) -> list[str]:
    """The lines of a text that aren't blank, without white space at their ends; longer ones than ``LONG`` words by sentences."""
    out = []
    for line in (text or "").splitlines():
        line = line.strip()
        if line and (len(line) > 2 * LONG and len(line.split(None, LONG)) > LONG):
            out += [x for x in _SENTENCE.split(line) if x]
        elif line:
            out.append(line)
    return out


def paragraph_digests(text: str | None) -> np.ndarray:
    """64-bit digests of the paragraphs, in order; white space between words doesn't count."""
    return np.array([int.from_bytes(hashlib.blake2b(" ".join(x.split()).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for x in paragraphs(text)], U64)


def cells(text: str | None) -> np.ndarray:
    """The distinct digests of a text's paragraphs; an empty text has none."""
    return np.unique(paragraph_digests(text))


def _places(keys: np.ndarray, size: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Where each key goes in the three sub-tables of its table (``size`` places in all, from ``first``)."""
    third = size // 3
    return [first + k * third + (mix64(keys ^ s) & (third - 1).astype(U64)).astype(np.int64) for k, s in enumerate(_SEEDS)]


def tables(keys: np.ndarray, owner: np.ndarray, sizes: np.ndarray, sign: int = 1, into: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, digest XORs and check XORs of all owners' tables, end to end; ``into`` is changed in place."""
    first = np.concatenate(([0], np.cumsum(sizes)))
    count, xor, check = into or (np.zeros(first[-1], np.int64), np.zeros(first[-1], U64), np.zeros(first[-1], U64))
    sums = mix64(keys ^ _CHECK)
    for at in _places(keys, sizes[owner], first[:-1][owner]):
        np.add.at(count, at, sign)
        np.bitwise_xor.at(xor, at, keys)
        np.bitwise_xor.at(check, at, sums)
    return count, xor, check


def peel(table: tuple, sizes: np.ndarray, found: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(added, removed, done) for each owner: digests recovered on either side, and whether nothing is left. ``found`` gets
    the digests themselves: (owner, digest, sign) of each round."""
    count, xor, check = table
    first = np.concatenate(([0], np.cumsum(sizes)))
    owner_of = np.repeat(np.arange(len(sizes)), sizes)
    plus, minus = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    look = np.flatnonzero(np.abs(count) == 1)
    while len(look):
        pure = look[(np.abs(count[look]) == 1) & (check[look] == mix64(xor[look] ^ _CHECK))]
        if not len(pure):
            break
        # a digest may be alone in several of its places: take it once
        pure = pure[np.unique(np.stack((owner_of[pure].astype(U64), xor[pure])), axis=1, return_index=True)[1]]
        keys, own, sign = xor[pure], owner_of[pure], count[pure]
        if found is not None:
            found.append((own, keys, sign))
        np.add.at(plus, own, sign > 0)
        np.add.at(minus, own, sign < 0)
        sums, touched = mix64(keys ^ _CHECK), []
        for at in _places(keys, sizes[own], first[:-1][own]):
            np.add.at(count, at, -sign)
            np.bitwise_xor.at(xor, at, keys)
            np.bitwise_xor.at(check, at, sums)
            touched.append(at)
        look = np.unique(np.concatenate(touched))
    rest = np.add.reduceat(((count != 0) | (xor != 0)).astype(np.int64), first[:-1]) if len(sizes) else np.zeros(0, np.int64)
    return plus, minus, rest == 0


def differences(a: list[np.ndarray], b: list[np.ndarray], places: int = PLACES) -> tuple[np.ndarray, np.ndarray]:
    """How many digests each ``a`` has beyond its ``b``, and the other way round, by tables that grow until peeling ends."""
    more, less = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    sizes = np.full(len(a), places, np.int64)
    while len(open_):
        own = sizes[open_]
        both = tables(np.concatenate([a[k] for k in open_]), np.repeat(np.arange(len(open_)), [len(a[k]) for k in open_]), own)
        both = tables(np.concatenate([b[k] for k in open_]), np.repeat(np.arange(len(open_)), [len(b[k]) for k in open_]), own, -1, both)
        plus, minus, done = peel(both, own)
        more[open_[done]], less[open_[done]] = plus[done], minus[done]
        open_ = open_[~done]
        sizes[open_] *= 2
    return more, less


def recovered(a: np.ndarray, b: np.ndarray, places: int = PLACES) -> tuple[np.ndarray, np.ndarray, int]:
    """The digests that only ``a`` and that only ``b`` has, sorted, from the difference of their tables alone, and the places of
    the table that gave them: one that can't be peeled is tried again with twice as many."""
    a, b = np.unique(a), np.unique(b)
    while True:
        size, found = np.array([places]), []
        both = tables(a, np.zeros(len(a), np.int64), size)
        both = tables(b, np.zeros(len(b), np.int64), size, -1, both)
        if peel(both, size, found)[2][0]:
            keys, sign = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, t) for k, t in ((1, U64), (2, np.int64)))
            return np.sort(keys[sign > 0]), np.sort(keys[sign < 0]), places
        places *= 2


CHANGES = "added array<string>, removed array<string>, places int"


def changed_paragraphs(pairs: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """``pairs`` with ``added`` and ``removed``: the paragraphs, in order, whose digests are recovered from the difference of the two
    versions' tables, and ``places``, the table that sufficed. Null texts are empty; a paragraph that only recurs more often in
    one version is no difference. Texts of any length are read whole; an empty table gives no rows; repeated rows stay. Columns of
    these three names (in any case) give way to the results, whether or not they are the texts."""
    kept = [c for c in pairs.columns if c.lower() not in ("added", "removed", "places")]
    names = [f"c{k}" for k in range(len(kept))]  # positions count; names may differ in case only
    was_, now_ = unused(pairs, "old"), unused(pairs, "new")

    def run(batches):
        for part in rows_of(batches):
            out = []
            for x, y in zip(part.column(len(names)).to_pylist(), part.column(len(names) + 1).to_pylist()):
                was, now = paragraph_digests(x), paragraph_digests(y)
                more, less, places = recovered(now, was)
                held = lambda text, digests, keys: list(dict.fromkeys(p for p, d in zip(paragraphs(text), digests) if d in keys))
                out.append((held(y, now, set(more.tolist())), held(x, was, set(less.tolist())), places))
            cols = [pa.array([r[k] for r in out], t) for k, t in ((0, pa.list_(pa.string())), (1, pa.list_(pa.string())), (2, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(names))), *cols], names=[*kept, "added", "removed", "places"])

    fields = "".join(f"`{pairs.schema[c].name}` {pairs.schema[c].dataType.simpleString()}, " for c in kept)
    return pairs.select(*kept, F.col(old).alias(was_), F.col(new).alias(now_)).mapInArrow(run, f"{fields}{CHANGES}")


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Dice similarity of each pair of sets, from their recovered difference; two empty sets are alike."""
    more, less = differences(a, b)
    n = np.array([len(x) + len(y) for x, y in zip(a, b)], float)
    return np.where(n > 0, 1 - (more + less) / np.maximum(n, 1), 1.0)


def fingerprints(sets: list[np.ndarray]) -> list[str]:
    """Each set's smallest table that its digests can be peeled from, as base64: counts, digest and check XORs."""
    out = [""] * len(sets)
    # a table with less than 1.3 places a digest never opens
    sizes = np.array([PLACES << max(0, int(np.ceil(np.log2(max(1, len(x)) * 1.3 / PLACES)))) for x in sets], np.int64)
    open_ = np.arange(len(sets))
    while len(open_):
        own = sizes[open_]
        table = tables(np.concatenate([sets[k] for k in open_]), np.repeat(np.arange(len(open_)), [len(sets[k]) for k in open_]), own)
        done = peel(tuple(z.copy() for z in table), own)[2]
        first = np.concatenate(([0], np.cumsum(own)))
        for i in np.flatnonzero(done):
            c, x, k = (z[first[i] : first[i + 1]] for z in table)
            out[open_[i]] = base64.b64encode(c.astype("<i4").tobytes() + x.astype("<u8").tobytes() + k.astype("<u8").tobytes()).decode()
        open_ = open_[~done]
        sizes[open_] *= 2
    return out


def opened(fingerprint: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A fingerprint's table: counts, digest XORs, check XORs."""
    raw = base64.b64decode(fingerprint)
    n = len(raw) // 20
    return np.frombuffer(raw, "<i4", n).astype(np.int64), np.frombuffer(raw, "<u8", n, 4 * n).astype(U64), np.frombuffer(raw, "<u8", n, 12 * n).astype(U64)


def resized(table: tuple, places: int) -> tuple:
    """The same digests' table of ``places`` places: folded, or peeled and laid out anew."""
    n = len(table[0])
    while n > places:
        n //= 2
        low, high = zip(*((x[:, : n // 3], x[:, n // 3 :]) for x in (z.reshape(3, -1) for z in table)))
        table = (low[0] + high[0]).ravel(), (low[1] ^ high[1]).ravel(), (low[2] ^ high[2]).ravel()
    if n < places:
        found: list = []
        peel(tuple(z.copy() for z in table), np.array([n]), found)
        keys = np.concatenate([x[1] for x in found]) if found else np.zeros(0, U64)
        table = tables(keys, np.zeros(len(keys), np.int64), np.array([places]))
    return table


def compared(a: str, b: str) -> tuple[np.ndarray, np.ndarray, float]:
    """The digests that only ``a`` and that only ``b`` has, sorted, and the Dice likeness, from two fingerprints alone."""
    one, two, places = opened(a), opened(b), PLACES
    while True:
        x, y = resized(one, places), resized(two, places)
        found: list = []
        if peel((x[0] - y[0], x[1] ^ y[1], x[2] ^ y[2]), np.array([places]), found)[2][0]:
            keys, sign = (np.concatenate([z[k] for z in found]) if found else np.zeros(0, t) for k, t in ((1, U64), (2, np.int64)))
            n = int(one[0].sum() + two[0].sum()) // 3
            return np.sort(keys[sign > 0]), np.sort(keys[sign < 0]), 1 - len(keys) / n if n else 1.0
        places *= 2


PRINTS = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_PRINTS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _made(rows: list[tuple]) -> pa.RecordBatch:
    """The results of (doc_id, text, next text)."""
    texts = [t for _, t, _ in rows]
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for _, t, n in rows]
    own, new, nxt = [cells(t) for t in texts], [cells(t) for t in edited], [cells(n) for _, _, n in rows]
    cols = ([d for d, _, _ in rows], [len(t) for t in texts], [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], fingerprints(own), fingerprints(new), likeness(own, new), likeness(own, nxt))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _PRINTS)], schema=_PRINTS)


def _prints(batches):
    """Rows come by bucket and then in order; a bucket's last row (``tail``) is the first document of the next."""
    before = None
    for part in rows_of(batches, 500, 2 << 20):
        rows = []
        for bucket, tail, doc, text in zip(*(part.column(k).to_pylist() for k in range(4))):
            if before and before[0] == bucket and not before[3]:
                rows.append((before[1], before[2], text or ""))
            before = (bucket, doc, text or "", tail)
        if rows:
            yield _made(rows)


def _alone(batches):
    for part in rows_of(batches, 500, 2 << 20):
        yield _made([(None, t or "", t or "") for t in part.column(0).to_pylist()])


def edit_prints(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited version (its second half replaced by the next document's beginning).

    Null texts are empty; two empty texts are alike (1.0). The order is ``doc_id``, then text for repeated ids (repeated rows
    follow each other); after the last comes the first, which may be the document itself. A row without ``doc_id`` has no
    place in the order and is its own next document. Texts are read whole, and a table grows with its text, so a very long
    one needs memory in proportion. An empty table gives no rows; other columns are ignored.

    Texts move once: rows go to buckets between quantiles of ``doc_id`` and are read there in order; the first document
    of a bucket is also sent behind the one before. The driver holds one number a bucket.
    """
    spark = docs.sparkSession
    buckets = buckets or 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    low, cuts = base.agg(F.min("doc_id"), F.percentile_approx("doc_id", [k / buckets for k in range(1, buckets)], 20 * buckets)).first()
    bounds = sorted(set(cuts or []) - {low})
    last = len(bounds)

    def deal(batches):
        import bisect

        for part in rows_of(batches):
            ids = part.column(0).to_pylist()
            at = [bisect.bisect_right(bounds, d) for d in ids]
            first = [d == low or k > 0 and d == bounds[k - 1] for d, k in zip(ids, at)]
            more = np.flatnonzero(first)
            take = pa.array(np.concatenate((np.arange(len(ids)), more)))
            bucket = [*at, *((at[i] - 1) if at[i] > 0 else last for i in more)]
            tail = [False] * len(ids) + [True] * len(more)
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(tail), part.column(0).take(take), part.column(1).take(take)], names=["bucket", "tail", "doc_id", "text"])

    dealt = base.filter("doc_id is not null").mapInArrow(deal, "bucket bigint, tail boolean, doc_id bigint, text string")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "tail", "doc_id", F.col("text").asc_nulls_first()).mapInArrow(_prints, PRINTS)
    return met.unionByName(base.filter("doc_id is null").select("text").mapInArrow(_alone, PRINTS))
