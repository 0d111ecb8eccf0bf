"""Operators 11 and 12 against brute force on small fixtures, edge rows, clashing columns."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tallymark.llm import hard_negatives, vector_codes

VECS = "vec_id bigint, embedding array<float>, label int, error string, code string, q string, slot string, score string"


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, k, "e", "c", "q", "s", "x") for i, v, k in rows], VECS)


def vectors(seed, n, dims, around=6):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(around, dims))
    x = centres[r.integers(0, around, n)] + 0.4 * r.normal(size=(n, dims))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def edge_rows(seed, n=180, dims=32):
    rnd = random.Random(seed)
    rows = [(k, [float(y) for y in x], rnd.choice([0, 1, 1, 1, 2, None])) for k, x in enumerate(vectors(seed, n, dims))]
    rows[7] = (7, None, 1)
    rows[8] = (8, rows[8][1][:-1] + [None], 1)
    rows[9] = (9, rows[9][1][:-1] + [math.nan], 1)
    rows[10] = (10, [math.inf] + rows[10][1][1:], 1)
    rows[11] = (11, [], 1)
    rows[12] = (12, rows[12][1] * 2, 1)  # another length
    rows += [rows[20], rows[20], (30, rows[31][1], 0), (None, rows[40][1], 1), (None, rows[41][1], 2)]
    return rows


def kept(rows, dims):
    return [(i, [math.floor(256 * float(np.float32(y))) for y in v], k) for i, v, k in rows if v and all(y is not None and math.isfinite(y) for y in v) and len(v) == dims]


# --- 11 ---


@pytest.mark.parametrize(("n", "m", "w", "most"), [(300, 64, 4, 256), (200, 64, 2, 1 << 24), (100, 5, 64, 1 << 24), (300, 40, 3, 2), (50, 1, 1, 1 << 20)])
def test_nearest_is_exact(n, m, w, most):
    r = np.random.default_rng(n + m)
    x, c = r.integers(-most, most + 1, (n, w)), r.integers(-most, most + 1, (m, w))
    c[m // 2 :] = c[: m - m // 2]  # ties
    gap = ((x[:, None] - c) ** 2).sum(2)
    at, d = vector_codes.nearest(x, c)
    assert (at == gap.argmin(1)).all() and (d == gap.min(1)).all()


def test_nearest_where_float32_is_not_enough():
    # entries that differ by one in components of sixteen million: their distances agree in more bits than float32 has
    x = np.full((3, 4), (1 << 24) - 5, np.int64)
    c = np.array([[0, 0, 0, 3], [0, 0, 0, 4], [0, 0, 0, 5], [0, 0, 0, 5]], np.int64)
    assert vector_codes.nearest(x, c)[0].tolist() == [2, 2, 2]
    assert vector_codes.nearest(x[:0], c)[0].tolist() == []


def test_integers_of_a_column():
    good, lengths, values = vector_codes.integers(pa.array([[0.5, -0.001], None, [None], [float("nan")], [], [1e30]], pa.list_(pa.float32())))
    assert good.tolist() == [True, False, False, False, True, True] and lengths.tolist() == [2, 0, 1, 1, 0, 1]
    assert values.tolist() == [128, -1, vector_codes.LIMIT]


def codes_by_hand(rows, parts, entries, rounds, dims):
    own = sorted(kept(rows, dims), key=lambda r: (r[0] is None, r[0] or 0))
    w = dims // parts
    cut = lambda v: [v[p * w : p * w + w] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in own[:entries]] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, x: min((gap(x, c), k) for k, c in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            groups = {}
            for _, v, _ in own:
                groups.setdefault(near(p, cut(v)[p])[1], []).append(cut(v)[p])
            new.append([[sum(c) // len(c) for c in zip(*groups[k])] if k in groups else old for k, old in enumerate(books[p])])
        books = new
    out = []
    for i, v, k in own:
        found = [near(p, x) for p, x in enumerate(cut(v))]
        out.append((i, k, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    total = {}
    for _, k, _, e in out:
        total[k] = total.get(k, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(repr((i, code, e, total[k], digest)) for i, k, code, e in out)


@pytest.mark.parametrize(("entries", "rounds"), [(16, 2), (64, 1), (256, 0)])
def test_codes_equal_brute_force(spark, entries, rounds):
    rows = edge_rows(entries)
    got = vector_codes.encode(table_of(spark, rows).repartition(3), 16, entries, rounds)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == codes_by_hand(rows, 16, entries, rounds, 32)


def test_codes_of_empty_tables(spark):
    for rows in ([], [(1, None, 1)], [(1, [], None)], [(1, [1.0] * 7, 1)]):
        assert vector_codes.encode(table_of(spark, rows)).collect() == []
    with pytest.raises(ValueError, match="1 to 256"):
        vector_codes.encode(table_of(spark, []), entries=257)


# --- 12 ---


def mined_by_hand(rows, every, positives, negatives, percents, dims):
    own = [r for r in kept(rows, dims) if r[2] is not None]
    anchors = {}
    for i, v, k in own:
        if i is not None and i % every == 0:
            anchors[i] = min(anchors.get(i, (k, v)), (k, v))
    out = []
    for a, (label, v) in anchors.items():
        scored = sorted(((-sum(x * y for x, y in zip(v, u)), i is None, i or 0), k, i) for i, u, k in own)
        liked = [(-s[0], i) for s, k, i in scored if k == label and i != a][:positives]
        for ps, p in liked:
            fits = [(-s[0], i) for s, k, i in scored if k != label and percents[0] * ps <= 100 * -s[0] <= percents[1] * ps][:negatives]
            out += [(a, p, n + 1, i, ps, s) for n, (s, i) in enumerate(fits)]
    return sorted(map(repr, out))


@pytest.mark.parametrize(("dims", "every", "k", "percents"), [(32, 10, 5, (80, 100)), (7, 4, 3, (50, 110)), (32, 3, 2, (0, 90))])
def test_mined_rows_equal_brute_force(spark, monkeypatch, dims, every, k, percents):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 16)  # several blocks of anchors
    rows = edge_rows(dims + every, 260, dims)
    rows = [(i, v and [round(y, 1) for y in v if y is not None] if i and i % 2 else v, lab) for i, v, lab in rows]  # ties
    rows[8] = (8, [0.1] * (dims - 1), 1)
    got = hard_negatives.mine(table_of(spark, rows).repartition(3), every, k, k, percents)
    want = mined_by_hand(rows, every, k, k, percents, dims)
    assert want and sorted(repr(tuple(r)) for r in got.collect()) == want


def test_residual_bound_holds_and_filters(spark):
    x = (vectors(5, 600, 32) * 256).astype(np.int64)
    df = spark.createDataFrame([(k, 1, 32, v.astype("<i4").tobytes()) for k, v in enumerate(x)], "vec_id bigint, label int, dims int, q binary")
    books = hard_negatives.fit(df, 32)
    rows = hard_negatives.index(df, books, 32).orderBy("vec_id").toArrow()
    code = np.stack([np.frombuffer(b, np.uint8) for b in rows.column("code").to_pylist()])
    near = np.concatenate([books[p][code[:, p]] for p in range(books.shape[0])], 1)
    norm = rows.column("residual").to_numpy()
    assert (np.linalg.norm(x - near, axis=1) <= norm).all()
    off = np.abs(x @ x.T - near @ x.T)
    assert (off <= norm[:, None] * np.linalg.norm(x, axis=1) + 1).all()
    assert norm.mean() < 0.2 * np.linalg.norm(x, axis=1).mean()


def test_mining_without_rows(spark):
    one = [1.0, 0.0]
    for rows in ([], [(100, None, 1)], [(1, one, 1), (2, one, 2)], [(100, one, 1)], [(100, one, 1), (101, one, 2)], [(None, one, 1), (None, one, 2)]):
        assert hard_negatives.mine(table_of(spark, rows)).collect() == []
