import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tidegrid.llm import lm_score


@pytest.fixture()
def texts(spark):
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 3000, 60))) for i in range(400)]
    return spark.createDataFrame([*rows, (None, None), (-1, "")], "doc_id long, text string")


def test_bits_grow_with_the_members(spark, texts, monkeypatch):
    monkeypatch.setattr(lm_score, "MIN_BITS", 1 << 15)
    for share in (200, 400):
        data = lm_score.gathered(*lm_score.build_filter(texts.where(f"doc_id < {share}").select(texts["text"].alias("_t")))).data
        assert 0.3 < np.unpackbits(data).mean() < 0.42


def test_n_grams_met_once_are_held(spark):
    train = spark.createDataFrame([("once upon a time",)], "_t string")
    one, two = lm_score.grams(*lm_score.tokens([b"once upon a time"]))
    lm = lm_score.gathered(*lm_score.build_filter(train))
    assert (lm.levels(one) > 0).all() and (lm.levels(two) > 0).all()
    assert (lm.levels(lm_score.grams(*lm_score.tokens([b"never met"]))[0][:2]) == 0).all()


def test_a_buckets_filter():
    """A bucket's own filter: no level too low, and unseen n-grams err as rarely as ``room`` reckons."""
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 1 << 40, 60_000).astype(np.uint64))
    counts = rng.zipf(1.7, len(keys)).clip(max=10**6)
    bits = lm_score.bits_for(lm_score.marks_of(counts), lm_score.FILL)
    lm = lm_score.Filter(lm_score.Filter.segment(keys, counts, bits), bits)
    assert 0.37 < np.unpackbits(lm.data).mean() < 0.42
    assert (lm.levels(keys) >= lm_score.level_of(counts)).all() and (lm.levels(keys) == lm_score.level_of(counts)).mean() > 0.95
    other = rng.integers(1 << 41, 1 << 47, 400_000).astype(np.uint64)
    assert (lm.levels(other) > 0).mean() < 4 * lm_score.FILL**lm_score.PROBES


def model_of(train):
    """The model with a dictionary in place of the filter."""
    one, two = Counter(), Counter()
    for words in train:
        for a, b in zip(["<s>", *words], [*words, "</s>"], strict=True):
            one[b] += 1
            two[a, b] += 1
    one["<s>"] = one["</s>"]
    n, v = sum(one.values()) - one["<s>"], len(one) - 1
    low, high = (lambda c: lm_score.LOW[lm_score.level_of(np.array([c]))[0]]), (lambda c: lm_score.HIGH[lm_score.level_of(np.array([c]))[0]])

    def p(a, b):
        uni = (low(one[b]) + 1) / (n + v + 1)
        return (min(low(two[a, b]), low(one[a]), low(one[b])) + lm_score.MU * uni) / (high(one[a]) + lm_score.room(v))

    return p, one


@pytest.mark.parametrize("sent", [1 << 22, 0])
def test_score_is_the_models_probability(spark, monkeypatch, sent):
    """With a filter too sparse to err, broadcast or in buckets, ``score`` equals a dictionary model of the same quantisation."""
    monkeypatch.setattr(lm_score, "SENT_TOKENS", sent)
    monkeypatch.setattr(lm_score, "TEXT_BLOCK", 5000)
    monkeypatch.setattr(lm_score, "BUCKET_TOKENS", 1 << 5)
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.3, 40) % 500)) for i in range(300)] + [(1000, ""), (1001, None), (1002, "unseen words w1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = [(t or "").split() for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    monkeypatch.setattr(lm_score, "MIN_BITS", 1 << 27)
    monkeypatch.setattr(lm_score, "FILL", 0.01)
    p, _ = model_of(train)
    text = dict(rows)
    got = lm_score.score(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        w = (text[r.doc_id] or "").split()
        assert r.score == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip(["<s>", *w], [*w, "</s>"], strict=True)), rel=1e-9)


def test_probabilities_sum_up_to_one_at_most():
    rng = np.random.default_rng(9)
    p, one = model_of([[f"w{int(x)}" for x in rng.zipf(1.3, 40) % 500] for _ in range(400)])
    words = [w for w in one if w != "<s>"] + ["<never met>"]
    mass = [sum(p(a, b) for b in words) for a in [*[w for w in list(one)[:200] if w != "</s>"], "<s>", "<never met>"]]
    assert 0.6 < min(mass) and max(mass) <= 1 + 1e-9
