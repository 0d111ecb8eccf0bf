"""Operator 13 against brute force: thresholds, templates, layouts, edge rows."""

import random
from collections import Counter

import numpy as np
import pytest

from tallymark.llm import parity_join
from tallymark.llm.common import shingles, word_hashes

DOCS = "doc_id bigint, text string, node string, key string, words string, n int, a int, region int"


def table_of(spark, rows):
    return spark.createDataFrame([(i, t, "n", "k", "w", 1, 2, 3) for i, t in rows], DOCS)


def by_hand(rows, width, percent):
    """doc_id to the least id reachable; sets of all rows of an id link for it."""
    sets = [(d, set(shingles(word_hashes(t), width).tolist())) for d, t in rows if d is not None]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for k, (_, s) in enumerate(sets):
        for e in s:
            where.setdefault(e, []).append(k)
    for k, (d, s) in enumerate(sets):
        for o, both in Counter(o for e in s for o in where[e] if o < k).items():
            if 100 * both >= percent * (len(s) + len(sets[o][1]) - both):
                lo, hi = sorted((root(d), root(sets[o][0])))
                parent[hi] = lo
    return {d: root(d) for d in parent}


def found(df):
    return {(r.doc_id, r.component_id) for r in df.collect()}


def prose(r, n):
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n)]


def groups(seed):
    """Groups of edited copies of all sizes, many about the threshold, and pages of one template."""
    r, rows = random.Random(seed), []
    for _ in range(30):
        base = prose(r, r.choice([1, 2, 3, 5, 8, 12, 20, 40, 80, 160, 300]))
        for _ in range(r.randint(2, 9)):
            w = base[:]
            for _ in range(r.randint(0, max(1, len(w) // 20))):
                w[r.randrange(len(w))] = prose(r, 1)[0]
            rows.append(" ".join(w + prose(r, r.choice([0, 0, len(base) // 15]))))
    shared = prose(r, 200)
    rows += [" ".join(shared + prose(r, r.choice([20, 28, 31, 33, 36, 45]))) for _ in range(150)]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("parts", "width", "percent"), [(1, 4, 85), (5, 4, 85), (3, 2, 70), (2, 5, 100)])
def test_components_equal_brute_force(spark, parts, width, percent):
    rows = groups(parts)
    want = by_hand(rows, width, percent)
    assert len(set(want.values())) < len(rows)
    assert found(parity_join.linked(table_of(spark, rows).repartition(parts), width, percent)) == set(want.items())


def test_cells_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "BLOCK", 16)
    rows = groups(9)
    assert found(parity_join.linked(table_of(spark, rows))) == set(by_hand(rows, 4, 85).items())


def test_linked_sets_share_a_signature():
    r = np.random.default_rng(3)
    for percent in (70, 85, 95):
        bands = parity_join.Bands(percent)
        for _ in range(200):
            n = int(r.integers(5, 400))
            both = int(n * r.uniform(percent / 100, 1))
            x = r.integers(0, 2**63, n, dtype=np.uint64)
            y = np.concatenate((x[:both], r.integers(0, 2**63, int(r.integers(0, n - both + 2)), dtype=np.uint64)))
            if 100 * both < percent * (len(x) + len(y) - both) or set(x.tolist()) == set(y.tolist()):
                continue
            band = bands.of(max(len(x), len(y)))
            assert band in bands.asked(len(x)) and band in bands.asked(len(y))
            a, b = (parity_join.sketch(s, bands.groups(band)) for s in (x, y))  # the larger one's band
            assert int(np.bitwise_count(a ^ b).sum()) <= len(x) + len(y) - 2 * both <= bands.most(len(x), len(y))
            (va, ca), (vb, cb) = parity_join.signatures(a, band), parity_join.signatures(b, band)
            assert ((va == vb) & (np.bitwise_count(ca ^ cb) <= 3)).any()


def test_edge_rows(spark):
    long = " ".join(prose(random.Random(4), 30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "One"), (5, "One"), (6, "one two"), (None, "one"), (7, long), (8, long + " more"), (9, "é É"), (10, "É é"), (11, "a b c d e"), (12, "a b c d e"), (12, "x y"), (13, "X Y")]
    got = parity_join.linked(table_of(spark, rows))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got.collect()) == [
        (0, 1, 0), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (5, 1, 4), (6, 1, 6), (7, 29_997, 7), (8, 29_998, 7), (9, 1, 9), (10, 1, 10), (11, 2, 11), (12, 1, 11), (12, 2, 11), (13, 1, 11),
    ]
    assert parity_join.linked(table_of(spark, [])).collect() == []
