import os
import time

import numpy as np
import pytest

from tidegrid.llm import piece_codec as pc

needs_model = pytest.mark.skipif(not os.path.exists(pc.MODEL), reason="needs the tokenizer file")
TEXTS = ["", " ", "   ", "Hello  world\n\tfoo  bar ", "ﬁ ① Å é", "a▁b", "a" * 300, "==== ------ ////", "a\0b", "日本語テキスト 😀🎉 x", "x " * 2000, "Thththththe erererer ionionion"]


@needs_model
@pytest.mark.parametrize("merges", [False, True])
def test_equals_library(merges):
    """The Viterbi equals the library's for the unigram model, the merges equal it for the BPE model."""
    import sentencepiece

    codec = pc.load(merges=merges)
    lib = sentencepiece.SentencePieceProcessor(model_file=pc.MODEL) if merges else sentencepiece.SentencePieceProcessor(model_proto=codec.model.to_bytes())
    rng = np.random.default_rng(5)
    long = "".join(rng.choice(list("etaoinshrdlu"), 3000)) + "日本語" * 200 + "".join(chr(0x4E00 + int(x)) for x in rng.integers(0, 5000, 900))
    texts = [*TEXTS, long, "a b " + long[:700] + " c"]
    for _ in range(2):  # the second time from the word cache
        ids, n = codec.encode([t.encode() for t in texts])
        ends = np.cumsum(n)
        for t, e, k, want in zip(texts, ends, n, lib.encode(texts), strict=True):
            got = ids[e - k : e].tolist()
            if merges:
                assert got == want
            else:  # paths of equal weight may differ
                weigh = lambda x: sum(codec.weight[i] for i in x)
                assert got == want or weigh(got) == pytest.approx(weigh(want), rel=1e-5)
        assert [b.decode() for b in codec.decode(ids, n)] == [lib.decode(x) for x in lib.encode(texts)]


@needs_model
@pytest.mark.parametrize("merges", [False, True])
def test_time_grows_with_the_length(merges):
    """A word of 120,000 characters without a blank; a quadratic method takes minutes."""
    rng = np.random.default_rng(6)
    text = "".join(rng.choice(list("etaoinshrdlu"), 120_000)).encode()
    codec = pc.load(merges=merges)
    began = time.perf_counter()
    ids, n = codec.encode([text, text[:1000] + b" " + text[1000:2000]])
    assert time.perf_counter() - began < 40
    assert codec.decode(ids, n)[0] == text


def test_a_clash_of_keys_is_noticed():
    codec = _unigram({"▁": -1.0, "a": -1.0, "b": -1.0})
    codec.encode([b"a b ab"])
    codec.word_check[:] ^= np.uint64(1)  # as if other words had these keys
    ids, n = codec.encode([b"a b ab"])
    assert codec.decode(ids, n) == [b"a b ab"] and codec.salt > 1


def _unigram(pieces: dict[str, float]) -> pc.Codec:
    model = pc.Model.__new__(pc.Model)
    model.pieces, model.scores, model.kinds = ["<unk>", *pieces], [0.0, *pieces.values()], [pc.UNKNOWN] + [pc.NORMAL] * len(pieces)
    model.rest = []
    model.bpe, model.dummy_prefix, model.squeeze, model.bytes, model.unknown = False, True, False, {}, 0
    return pc.Codec(model)


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(0)
    pieces = {p: float(s) for p, s in zip(["▁", "a", "b", "ab", "ba", "▁a", "aab", "bb", "▁ab", "abab"], -rng.random(10) * 5 - 1, strict=True)}
    codec = _unigram(pieces)

    def best(word):
        if not word:
            return 0.0, []
        found = []
        for k in range(1, len(word) + 1):
            if word[:k] in pieces or k == 1:
                s, rest = best(word[k:])
                found.append((s + pieces.get(word[:k], codec.worst), [word[:k], *rest]))
        return max(found)

    for _ in range(60):
        text = "".join(rng.choice(list("abx"), size=rng.integers(1, 9)))
        ids, n = codec.encode([text.encode()])
        got = sum(pieces[codec.model.pieces[i]] if i else codec.worst for i in ids)
        assert got == pytest.approx(best("▁" + text)[0])


@needs_model
def test_columns_and_edges(spark):
    d = spark.createDataFrame([(1, None, "k"), (2, "", None), (3, "ab ab", "k"), (3, "ab ab", "k")], "doc_id long, text string, ids string")
    out = pc.encode(d).orderBy("doc_id").collect()
    assert [r.ids for r in out[:2]] == [[], []] and out[2].ids == out[3].ids and all(r.round_trip for r in out)
    assert pc.encode(d.limit(0)).count() == 0
