import hashlib
import re

import numpy as np
import pytest
import xxhash

from tidegrid.llm import components, exact_dedup, simhash, suffix_dedup, suffix_sort
from tidegrid.llm.common import FOLD

A = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(400))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, _id string, keep_id string")


def test_exact(spark):
    rows = [(1, "Ab"), (2, "aB"), (3, "Äb"), (4, "äb"), (5, None), (6, ""), (7, "é" * 5000 + "A"), (8, "é" * 5000 + "a"), (9, "é" * 5000 + "b"), (None, "solo"), (10, "ab"), (10, "ab")]
    got = {}
    for r in exact_dedup.exact_duplicates(frame(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append((r.keep_id, r.group_size, r.kept))
        low = re.sub("[A-Z]", lambda m: m[0].lower(), dict(rows)[r.doc_id] or "")
        assert r.text_sha256 == hashlib.sha256(low.encode()).hexdigest()
    assert got[1] == [(10, 4, False)] and got[10] == [(10, 4, True)] * 2 and got[3] == [(3, 1, True)] and got[5] == [(6, 2, False)]
    assert got[7] == [(8, 2, False)] and got[9] == [(9, 1, True)] and got[None] == [(None, 1, True)]
    assert exact_dedup.exact_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_chunks_join_to_the_text(spark):
    text = "\n".join("word" * (i % 40) + ". " + "é" * i for i in range(300))
    d = spark.createDataFrame([(text,), ("",), ("x" * 9000,)], "text string")
    for t, c in d.select("text", exact_dedup.chunks(d["text"])).collect():
        assert "".join(c) == t and all(len(x) <= 4096 for x in c)


def test_chunks_meet_again_after_an_insertion(spark):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghilmnoprstu"), rng.integers(2, 9))) for _ in range(5000)]
    text = " ".join(words)
    d = spark.createDataFrame([(text,), ("inserted here " + text,), (text[:9000] + "more " + text[9000:],)], "text string")
    a, b, c = (set(r[0]) for r in d.select(exact_dedup.chunks(d["text"])).collect())
    assert len(a) > 20 and len(a & b) >= 0.8 * len(a) and len(a & c) >= 0.8 * len(a)


def brute_fingerprint(text, k=3):
    w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(FOLD[b] for b in text.encode()))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), seed=42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints():
    texts = ["", "\t\n", "One", "one two", "A b  c\x0bd", "w" * 40 + " " + "v" * 33 + " é ü", " ".join(str(i) for i in range(500))]
    assert simhash.fingerprints_of([t.encode() for t in texts], 3).tolist() == [brute_fingerprint(t) for t in texts]


def test_blocks_cover_five_of_eight():
    from itertools import combinations

    assert len(simhash.BLOCKS) == 14
    assert all(any(set(b) <= set(c) for b in simhash.BLOCKS) for c in combinations(range(8), 5))


@pytest.mark.parametrize("direct", [4096, 3])
def test_links_equal_brute_force(spark, direct, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        x = int(b)
        for _ in range(12):
            for bit in rng.choice(64, rng.integers(1, 4), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    monkeypatch.setattr(simhash, "DIRECT", direct)
    d = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "_fp long, _rep long")
    pairs = {(r.a, r.b) for r in simhash.links(d).collect()}
    if direct == 3:
        assert simhash.postings(d).where("_b >= 1000").count() > 0  # split twice

    def classes(edges):
        root = list(range(len(fps)))
        def find(v):
            while root[v] != v:
                v = root[v]
            return v
        for p, q in edges:
            p, q = sorted((find(p), find(q)))
            root[q] = p
        return [find(v) for v in range(len(fps))]

    want = classes([(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    assert classes(pairs) == want


def test_tally():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 300, dtype=np.uint64) & rng.integers(0, 1 << 63, 300, dtype=np.uint64) & np.uint64(0x00FF0F00FFF00F01)
    assert simhash.tallied(x).tolist() == [sum(b == 0 for b in int(v).to_bytes(8, "little")) for v in x]


def test_the_count_filter_drops_pairs():
    """Four shared bytes are not enough: such a pair meets in a posting and is dropped by the tally."""
    fp = np.array([0, 0x0101010100000000, 0x0101010000000000], dtype=np.uint64)
    assert simhash.tallied(fp[0] ^ fp[1:]).tolist() == [4, 5]
    i, j = simhash._forest(fp, 3, 5)
    assert (len(i), len(simhash._forest(fp, 4, 5)[0]), len(simhash._forest(fp, 4, 4)[0])) == (2, 2, 2)
    assert len(simhash._forest(fp[:2], 4, 5)[0]) == 0 and len(simhash._forest(fp[:2], 4, 4)[0]) == 1


def test_near_duplicates(spark):
    words = " ".join(f"w{i}" for i in range(3000))
    rows = [(5, words), (3, words + " tail"), (9, None), (8, ""), (7, "other text here"), (None, "other text here"), (11, words)]
    got = {(r.doc_id): (r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    assert got[9] == ("0" * 16, 8) and got[8][1] == 8 and got[None][1] == 7 and got[5][1] == got[11][1] == (3 if got[3][1] == 3 else 5)
    assert got[5][0] == f"{brute_fingerprint(words):016x}"
    assert simhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_components(spark):
    n = 60
    edges = [(i, i + 1) for i in range(n)] + [(100, 200), (200, 100), (7, 7), (500, 500)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(n + 1)}, 100: 100, 200: 100, 500: 500}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("memory", [suffix_sort.MEMORY, 300])
def test_suffixes(memory):
    rng = np.random.default_rng(0)
    for trial in range(40):
        segs = [bytes(rng.integers(97, 97 + rng.integers(1, 4), rng.integers(1, 40)).astype(np.uint8)) for _ in range(rng.integers(1, 10))]
        segs += segs[:2] + [b"a" * 45] * (trial % 3)
        text = np.concatenate([np.append(np.frombuffer(s, np.uint8).astype(np.uint16) + 1, np.uint16(0)) for s in segs])
        depth = int(rng.integers(1, 25))
        batches = list(suffix_sort.Shard(text, depth, memory).suffixes())
        pos, lcp = (np.concatenate(x) for x in zip(*batches, strict=True))
        assert sorted(pos.tolist()) == list(range(len(text)))
        cut = [tuple(text[p : p + depth].tolist()) for p in pos]
        for i in range(1, len(cut)):
            same = next((k for k, (x, y) in enumerate(zip(cut[i - 1], cut[i], strict=False)) if x != y), min(len(cut[i - 1]), len(cut[i])))
            assert cut[i - 1] <= cut[i] and lcp[i] == same


def brute_repeats(rows, span=100):
    seen, out = {}, {}
    for i, b in sorted(((-1 if i is None else i), (t or "").encode()) for i, t in rows):
        cov = bytearray(len(b))
        for p in range(len(b) - span + 1):
            if seen.setdefault(b[p : p + span], (i, p)) < (i, p):
                cov[p : p + span] = b"\1" * span
        kept = bytes(x for x, c in zip(b, cov, strict=True) if not c)
        out[i] = (len(b), sum(cov), len([x for x in bytes(cov).split(b"\0") if x]), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [1024, 2])
def test_repeats(spark, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows = [(1, None), (2, ""), (3, "x" * 350), (4, "x" * 150 + "y" * 99 + "é" * 60), (5, A), (6, "q" + A[100:260] + "z"), (7, A[:100]), (8, A[5:104]), (9, A + A), (None, A[50:170]), (10, "é" * 30 + A[200:330] + "é" * 60)]
    rows += [(20 + i, A[i * 3 : i * 3 + 150]) for i in range(40)] + [(100, A), (100, A)]
    got = {}
    for r in suffix_dedup.remove_repeats(frame(spark, rows).repartition(4)).collect():
        got[-1 if r.doc_id is None else r.doc_id] = (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
    assert got == brute_repeats(rows)
    assert suffix_dedup.remove_repeats(frame(spark, rows).limit(0)).count() == 0


def test_long_texts_are_cut_into_sections(spark, monkeypatch):
    """Sections of a long text lose no window; a text of any length can be cut."""
    from tidegrid.llm import windows

    rng = np.random.default_rng(11)
    text = bytes(rng.integers(97, 101, 5000).astype(np.uint8))
    for size in (150, 1000):
        got = [(at + k, part[k : k + 100]) for _, at, part in windows.sections([text, b"short"], 100, size) if part != b"short" for k in range(len(part) - 99)]
        assert got == [(k, text[k : k + 100]) for k in range(len(text) - 99)]
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    t = text.decode()
    rows = [(1, t), (2, t[300:900] + "z" * 120 + t[2000:4000]), (3, t[::-1] + t[4500:])]
    out, _ = zip(*[(w, None) for w in windows.sections([x.encode() for _, x in rows], 100, 700)], strict=True)
    assert len(out) > 10
    found = suffix_dedup.candidates(frame(spark, rows).coalesce(1), "doc_id", "text", 100, 7)
    places = sorted((int(d), int(f)) for b in found.where("kind = 0").collect() for d, f in zip(suffix_dedup._read(b.v, True)[0], suffix_dedup._read(b.v, True)[2], strict=True))
    assert places[0] == (1, 0)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert got == brute_repeats(rows)
