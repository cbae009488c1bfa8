"""Groups of copies that are too far from one original to be linked with it."""

import random

import numpy as np
import pyarrow as pa

from corpusloom.llm import near_dedup


def _block(sets, marks, roots, blocks, i, j, centre):
    apart = [np.setxor1d(s, centre).view(np.int64) for s in sets]
    return pa.table({"centre": pa.array([0] * len(sets)), "i": pa.array([i] * len(sets)), "j": pa.array([j] * len(sets)), "block": pa.array(blocks), "mark": pa.array(marks), "root": pa.array(roots),
                     "n": pa.array([len(s) for s in sets], pa.int32()), "apart": pa.array(apart, pa.list_(pa.int64()))})


def _reach(nodes, pairs):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in nodes}


def test_blocks_of_a_centre_are_joined_as_by_brute_force(monkeypatch):
    monkeypatch.setattr(near_dedup, "COLUMNS", 7)
    draw = np.random.default_rng(4)
    centre = np.unique(draw.integers(1, 2**63, 90).astype(np.uint64))
    heads = [np.setdiff1d(np.union1d(centre, draw.integers(1, 2**63, 20).astype(np.uint64)), draw.choice(centre, 12)) for _ in range(6)]
    sets = [np.unique(np.concatenate([draw.choice(h := heads[k % 6], len(h) - draw.integers(0, 14), replace=False), draw.integers(1, 2**63, draw.integers(0, 4)).astype(np.uint64)])) for k in range(60)] + [centre]
    marks, roots, blocks = list(range(100, 161)), [int(r) for r in draw.integers(0, 40, 61)], [int(b) for b in draw.integers(0, 2, 61)]
    like = lambda a, b: 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b])) and roots[a] != roots[b]
    for i, j in ((0, 0), (0, 1), (1, 1), (0, 2)):
        part = [k for k in range(61) if blocks[k] in (i, j)]
        want = [(marks[a], marks[b]) for a in part for b in part if a < b and {blocks[a], blocks[b]} == {i, j} and like(a, b)]
        rows = _block([sets[k] for k in part], [marks[k] for k in part], [roots[k] for k in part], [blocks[k] for k in part], i, j, centre)
        out = near_dedup._linked(85)(rows).to_pylist()
        assert len(out) < len(part) and bool(out) == bool(want)
        assert _reach(marks, [(x["a"], x["b"]) for x in out]) == _reach(marks, want)


def test_far_copies_are_compared_by_blocks_and_not_row_by_row(spark, monkeypatch):
    """Copies of copies, far from the first text: their pairs are no rows, and components are those of all pairs."""
    r = random.Random(12)
    vocab = [f"w{i}" for i in range(2000)]
    base = [r.choice(vocab) for _ in range(160)]

    def edited(words, n):
        w = list(words)
        for _ in range(n):
            w[r.randrange(len(w))] = r.choice(vocab)
        return w

    second = [edited(base, 9) for _ in range(5)]
    texts = [" ".join(base), *(" ".join(edited(second[k % 5], r.randint(0, 6))) for k in range(110))]
    sets = [{tuple(w[i:i + 3]) for i in range(len(w) - 2)} for w in map(str.split, texts)]
    links = [(a, b) for b in range(len(sets)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rows = []
    compared = near_dedup._compared
    monkeypatch.setattr(near_dedup, "_compared", lambda *a: rows.append(a) or compared(*a))
    plans = []
    settled = near_dedup.settled
    monkeypatch.setattr(near_dedup, "settled", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or settled(df))
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), n_words=3, similarity=0.85).collect()}
    assert got == _reach(range(len(texts)), links)
    assert 1 < len(set(got.values())) < len(texts)
    assert sum("FlatMapGroupsInArrow" in p for p in plans) == 1 and all("lacks" not in p for p in plans)
    assert any("NOT (centre" in p for p in plans)  # the row-wise join is left to nodes of several centres
