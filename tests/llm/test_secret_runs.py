from tidegrid.llm import secret_scan

KEY = "Qw3rTy7UiOp9AsDf2GhJk4Lz"
LONG = "/srv/Data/" + "long-folder-name/" * 4
SECRET = [LONG + KEY, "/srv/example/" + KEY, "a" * 70 + "0123456789abcdef9876", "550e8400-e29b-41d4-a716-446655440000-" + KEY]
PLAIN = ["wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "exampleQw3rTy7UiOp9AsDf2", "550e8400-e29b-41d4-a716-446655440000", "a" * 90]


def test_long_runs_are_judged_whole(spark):
    rows = [(i, "see " + t + " ") for i, t in enumerate(SECRET + PLAIN)]
    got = {r.doc_id: r for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in enumerate(SECRET):
        assert f":4:{4 + len(t)}" in got[i].spans, t
    assert all(got[i].n_entropy == 0 for i in range(len(SECRET), len(rows)))


def test_what_follows_does_not_matter(spark):
    run = "some-long-hyphenated-name-2"
    rows = [(1, run + " the"), (2, run + " The")]
    got = {r.doc_id: r.spans for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == got[2]
