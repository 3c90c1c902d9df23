import numpy as np

from tidegrid.llm import shingle_sets


def shingles(text, k=5):
    w = text.split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def test_pipeline_drops_what_is_similar(spark):
    import corpus_pipeline

    rng = np.random.default_rng(3)
    rows, n = [], 0
    for size in (12, 40, 80, 200):
        for _ in range(12):
            words = [f"w{x}" for x in rng.integers(0, 5000, size)]
            for edits in (0, 1, 1, 2, 3):
                w = list(words)
                for at in rng.choice(size, edits, replace=False):
                    w[at] = f"e{n}"
                rows.append((n, " ".join(w), "en", "s", 1))
                n += 1
    rows += [(n, None, "en", "s", 1), (n + 1, " \n", "en", "s", 1), (None, "no id", "en", "s", 1), (None, "no id", "en", "s", 1)]
    sets = {i: shingles(t or "") for i, t, *_ in rows if i is not None}
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect() if r.doc_id is not None)
    assert kept == sorted(set(root.values())) and len(kept) < n
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "").count() == 0
    assert corpus_pipeline.drop_near_copies(spark, docs, "").where("doc_id IS NULL").count() == 1  # the two are copies


def test_similar_is_exact():
    a = np.arange(9, dtype=np.uint64)
    assert shingle_sets.similar(a[:8], a[:8]) and shingle_sets.similar(a[:4], a[:5]) and not shingle_sets.similar(a[:8], a[1:9])
