"""Every operator on null, empty, very long and repeated rows, odd ids, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from tidegrid.llm import exact_dedup, license_scan, license_texts, lm_score, media, mixing, piece_codec, quality, secret_scan, simhash, suffix_dedup

LONG = " ".join(f"word{i % 9973} token=abcdefgh{i}" if i % 50 == 0 else f"w{i % 997}" for i in range(40_000))
SOLID = "ab1C" * 15_000
ROWS = [(1, None), (2, ""), (3, " \t\n"), (4, "Same Text here for all"), (5, "same text here for all"), (6, LONG), (7, LONG), (8, SOLID), (9, "é😀 ünïcode"), (10, license_texts.MIT), (11, license_texts.MIT), (12, "x\0y"), (12, "x\0y"), (None, "no id"), (None, None)]
#: Columns that come out; what is the same for equal texts.
CASES = {
    "mix": (lambda d: mixing.mix(d), ["size", "source_size"]),
    "pieces": (lambda d: piece_codec.encode(d, path=piece_codec.MODEL).select("doc_id", "decoded_sha256", "round_trip"), ["decoded_sha256", "round_trip"]),
    "licenses": (lambda d: license_scan.scan(d), ["n_words", "labels", "score"]),
    "scores": (lambda d: lm_score.score(d), ["n_tokens", "n_known", "base_score", "score"]),
    "media": (lambda d: media.media_features(d), ["payload_sha256", "media_sha256", "feature"]),
    "exact": (lambda d: exact_dedup.exact_duplicates(d), ["keep_id", "group_size"]),
    "secrets": (lambda d: secret_scan.scan(d), ["base_sha256", "spans"]),
    "repeats": (lambda d: suffix_dedup.remove_repeats(d), ["n_bytes"]),
    "quality": (lambda d: quality.classify(d, quality.fit(d, d.sparkSession.createDataFrame([(4, 1), (6, 0), (9, 1), (10, 1), (8, 0)], "doc_id long, quality int"))).select("doc_id", "score", "predicted"), ["score"]),
    "simhash": (lambda d: simhash.near_duplicates(d), ["fingerprint", "component_id"]),
}


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame([(i, t, "s" if i and i % 3 else None) for i, t in ROWS], "doc_id long, text string, source string")
    return d.withColumns({c: F.lit(7) for c in ("_id", "_t", "_n", "score", "ids", "member", "_key", "n_words", "keep_id")})


@pytest.mark.parametrize("name", CASES)
def test_edge_rows(spark, docs, name):
    run, same = CASES[name]
    rows = run(docs).collect()
    assert len(rows) == len(ROWS)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(tuple(r[c] for c in same))
    assert len(by_id[12]) == 2 and by_id[12][0] == by_id[12][1]  # repeated rows are alike
    if name not in ("mix",):
        assert by_id[1] == by_id[2] or name in ("exact", "repeats") and by_id[1][0][-1] == by_id[2][0][-1]  # null is empty
        assert by_id[6] == by_id[7] and by_id[10] == by_id[11]  # equal texts
    assert run(docs.limit(0)).count() == 0


def test_ties_of_the_mix(spark):
    """Rows that share an id share a hash: they are taken together or not at all."""
    d = spark.createDataFrame([(5, "a b c", "s")] * 4 + [(i, "a", "s") for i in range(100, 160)] + [(i, "b " * 50, "t") for i in range(200, 240)], "doc_id long, text string, source string")
    got = {}
    for r in mixing.mix(d).collect():
        got.setdefault(r.doc_id, set()).add(r.taken)
    assert all(len(v) == 1 for v in got.values())


def test_a_long_mixed_run_is_one_candidate(spark):
    """60,000 characters of one class: judged as a whole, in time in proportion to its length."""
    r = secret_scan.scan(spark.createDataFrame([(1, SOLID), (2, "Zx9" + SOLID + "Qw8Er7Ty6Ui5Op4As3Df2")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert r[0].n_entropy == 0 and r[1].spans == f"entropy_base64:0:{len(SOLID) + 24}"


def test_many_matches_have_their_places(spark):
    text = "".join(f"{'x' * (i % 5)}token=abcdef{i} " for i in range(3000))
    spans = secret_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    import re

    want = [(m.start(), m.end()) for m in re.finditer(r"token=[A-Za-z0-9]+", text)]
    got = [tuple(map(int, s.split(":")[1:])) for s in spans.spans.split(",") if s.startswith("assign")]
    assert got == want and spans.n_assign == 3000
