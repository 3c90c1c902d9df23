"""Near copies in buckets that centres don't settle: every pair is compared."""

import numpy as np
import pytest

from tidegrid.llm import shingle_sets

from .test_near_copies import shingles


def family(couples):
    """Couples of a similarity of 0.8 among variants of one text, which share bands but are mostly less alike."""
    rng = np.random.default_rng(1)
    rows = []
    for g in range(couples):
        words = [f"b{i}" for i in range(300)]
        for at in rng.choice(300, 5, replace=False):
            words[at] = f"x{g}_{at}"
        rows.append((2 * g, " ".join(words)))
        for at in rng.choice(np.arange(2, 300, 5), 6, replace=False):
            words[at] = f"y{g}_{at}"
        rows.append((2 * g + 1, " ".join(words)))
    return rows


def by_force(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and root[i] != root[j] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    return root


@pytest.mark.parametrize("couples, block, levels", [(400, shingle_sets.BLOCK, 3), (100, 16, 1)])
def test_no_pair_is_lost_in_large_buckets(spark, monkeypatch, couples, block, levels):
    monkeypatch.setattr(shingle_sets, "BLOCK", block)
    monkeypatch.setattr(shingle_sets, "LEVELS", shingle_sets.LEVELS[:levels])
    rows = family(couples)
    found = {r.doc_id: r.component_id for r in shingle_sets.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = by_force(rows)
    assert {i: found.get(i, i) for i in want} == want
    assert couples / 2 < len(set(want.values())) < 2 * couples


def test_sketches_leave_out_no_similar_pair():
    rng = np.random.default_rng(2)
    sets = [np.array([0], np.uint64)]
    for n in (1, 2, 5, 16, 17, 31, 33, 64, 120, 129, 500, 513, 40_000):
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        sets += [np.unique(np.concatenate([base[: n - n * k // 20], rng.integers(0, 1 << 63, n * e // 20, dtype=np.uint64)])) for k in (0, 1, 2, 4) for e in (0, 1, 2, 5)]
    size, part = np.array([len(s) for s in sets]), np.arange(len(sets)) // 2
    i, j, _ = shingle_sets.candidates(part, size, part % 2, [shingle_sets.sketch(s) for s in sets], True)
    got = {tuple(sorted(x)) for x in zip(i.tolist(), j.tolist(), strict=True)}
    assert len(got) == len(i)
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if part[a] != part[b] and shingle_sets.similar(sets[a], sets[b])}
    assert want <= got and len(got) < 1.2 * len(want)
    i, j, _ = shingle_sets.candidates(part, size, part % 2, [shingle_sets.sketch(s) for s in sets], False)
    assert {tuple(sorted(x)) for x in zip(i.tolist(), j.tolist(), strict=True)} == {(a, b) for a, b in got if part[a] % 2 != part[b] % 2}
