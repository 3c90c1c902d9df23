import random

from tidegrid.llm import license_scan, license_texts

FILL = [f"filler{i}" for i in range(300)]


def labels(spark, texts, parts=1):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts)
    return {r.doc_id: (r.labels, r.base_labels, round(r.score, 6)) for r in license_scan.scan(d).collect()}


def test_whole_texts_have_their_labels(spark):
    rng = random.Random(1)
    cases = [(label, " ".join(rng.sample(FILL, 120)) + " " + text + " " + " ".join(rng.sample(FILL, 120))) for label, _, text in license_texts.TEXTS]
    got = labels(spark, [t for _, t in cases] + [" ".join(rng.sample(FILL, 200)) for _ in range(50)])
    for i, (label, _) in enumerate(cases):
        assert label in got[i][0].split(","), (label, got[i])
    assert all(got[i] == ("", "", 0.0) for i in range(len(cases), len(got)))


def test_added_missing_and_changed_words(spark):
    w = license_texts.MIT.split()
    added = " ".join(w[:30] + ["at", "no", "cost"] + w[30:])
    missing = " ".join(w[:40] + w[48:])
    changed = " ".join(x if i % 25 else "other" for i, x in enumerate(w))
    no_key = " ".join(["permission", "was", "given"] + w[12:])
    got = labels(spark, [added, missing, "x " + changed[6:], no_key])
    assert [got[i][0] for i in range(3)] == ["mit", "mit", ""] or [got[i][0] for i in range(3)] == ["mit", "mit", "mit"]
    assert got[3][0] == ""


def test_the_rows_beside_a_file_do_not_matter(spark):
    """Phrases cut off at a file's start or end, beside files that would complete them, in any order and dealing."""
    rng = random.Random(2)
    texts = ["by sa 4 0", "licensed under cc", "cc by sa 4 0", "general public license", "gnu", "mit", "license", "reserved", "all rights", license_texts.MIT, license_texts.MIT[200:], license_texts.MIT[:200], "", license_texts.BSD2 * 2]
    texts += [rng.choice(["license under the terms", "software free of charge", "x"]) for _ in range(200)]
    want = labels(spark, texts)
    for seed in range(3):
        order = list(range(len(texts)))
        random.Random(seed).shuffle(order)
        got = labels(spark, [texts[i] for i in order], parts=seed + 1)
        assert {order[i]: v for i, v in got.items()} == want
    assert want[0][0] == want[3][0] == want[4][0] == "" and want[2] == ("cc-by,cc-by-sa", "cc-by", 1.0)
