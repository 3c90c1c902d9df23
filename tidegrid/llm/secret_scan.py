"""Secret scan in DataFrame operations only: patterns plus sliding-window entropy.

Pattern matches are placed without a Python or Java function of our own: the
text is split at the pattern and the lengths of what stands between matches
and of the matches add up to the positions. The entropy scan looks at candidate
strings: maximal runs of one character class. A window slides over a
candidate's characters; counts change by one character in and one out, and
with them the sum of c log c, so each step costs one update of the class's
count array. A candidate that holds every kind of character of its class
and whose best window reaches the class's limit is a span; windows do not
reach into what the allow list names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of the base kinds, in the order in which ties are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Shortest assigned value, access key and hexadecimal string.
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 6, 20, 24

#: Character classes of the entropy scan: name, candidate pattern, alphabet, window, least bits a character, what a candidate must hold.
CLASSES = (
    ("entropy_hex", r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{20,}", "0123456789abcdefABCDEF", 20, 2.9, ("[0-9]", "[A-Fa-f]")),
    ("entropy_base64", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 20, 3.6, ("[0-9]", "[A-Z]", "[a-z]")),
)
#: Matches whose places are summed up at once.
MATCH_BLOCK = 128
#: Shortest candidate, and shortest rest of one beside what is allowed.
LEAST = 20
#: What is no secret: well-known examples and placeholders, runs of the alphabet. Only the letters and digits around it are left out of a candidate.
ALLOW = r"(?i)example|placeholder|changeme|x{6,}|0{8,}|1234567890|abcdefgh"
ALLOWED = r"(?i)wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY|(?<![A-Za-z0-9])[A-Za-z0-9]*?(?:" + ALLOW.removeprefix("(?i)") + r")[A-Za-z0-9]*"
#: A candidate that is one UUID.
UUID = r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once: inside a lambda an outer expression would be computed at every step."""
    return F.element_at(F.transform(F.array(value), use), 1)


def matches(text: Column, pattern: str) -> Column:
    """Array of structs (start, stop, found): leftmost non-overlapping matches, in code points.

    Positions are running sums, formed within blocks of matches and over the
    blocks' totals, so that many matches cost little more than few.
    """
    empty = F.array().cast("array<struct<start:int,stop:int,found:string>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda s: F.char_length(s))
    pairs = F.zip_with(found, gaps, lambda f, g: F.struct(g.alias("gap"), F.coalesce(F.char_length(f), F.lit(0)).alias("len"), f.alias("found")))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + pair["gap"]
        stop = begin + pair["len"]
        one = F.struct(begin.alias("start"), stop.alias("stop"), pair["found"].alias("found"))
        return F.struct(stop.alias("at"), F.concat(acc["list"], F.array(one)).alias("list"))

    def placed(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), empty.alias("list")), step)["list"]

    def blocks_of(p: Column) -> Column:
        first = F.sequence(F.lit(1), F.greatest(F.size(p), F.lit(1)), F.lit(MATCH_BLOCK))
        return F.transform(first, lambda i: F.slice(p, i, MATCH_BLOCK))

    def offsets(blocks: Column) -> Column:
        total = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + x["gap"] + x["len"]))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("list"))
        return F.aggregate(total, start, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["list"], F.array(acc["at"])).alias("list")))["list"]

    def whole(p: Column) -> Column:
        return _bound(blocks_of(p), lambda blocks: F.flatten(F.zip_with(blocks, offsets(blocks), placed)))

    # The text after the last match is no match; without it, blocks hold matches only.
    return _bound(pairs, lambda p: F.when(F.size(p) > 1, whole(F.slice(p, 1, F.size(p) - 1))).otherwise(empty))


def best_window(candidate: Column, alphabet: str, window: int) -> Column:
    """The highest Shannon entropy, in bits a character, of ``window`` characters in a row.

    A shorter candidate is one window. With S the sum of c log2 c over the
    window's counts, the entropy is log2 w - S / w.
    """
    xlogx = F.array(*[F.lit(0.0 if c == 0 else c * math.log2(c)) for c in range(window + 1)])
    codes = F.transform(F.split(candidate, ""), lambda ch: F.position(ch, F.lit(alphabet)).cast("int"))
    zero = F.struct(F.array_repeat(F.lit(0), len(alphabet) + 1).alias("counts"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))

    def term(c: Column) -> Column:
        return F.element_at(xlogx, c + 1)

    def change(acc: Column, k: Column, by: int) -> Column:
        c = F.element_at(acc["counts"], k + 1)
        counts = F.transform(acc["counts"], lambda x, i: F.when(i == k, x + by).otherwise(x))
        return F.struct(counts.alias("counts"), (acc["s"] + term(c + by) - term(c)).alias("s"), acc["best"].alias("best"))

    def slide(codes: Column) -> Column:
        size = F.size(codes)
        w = F.least(size, F.lit(window))

        def step(acc: Column, i: Column) -> Column:
            out = F.when(i > w, change(acc, F.element_at(codes, F.greatest(i - w, F.lit(1))), -1)).otherwise(acc)
            now = change(out, F.element_at(codes, i), 1)
            entropy = F.log2(w.cast("double")) - now["s"] / w
            return F.struct(now["counts"].alias("counts"), now["s"].alias("s"), F.when(i >= w, F.greatest(now["best"], entropy)).otherwise(now["best"]).alias("best"))

        return F.aggregate(F.sequence(F.lit(1), size), zero, step)["best"]

    return _bound(codes, slide)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of secrets in every row's whole text.

    Returns ``id_col, n_assign, n_access, n_hex, base_sha256, spans, n_entropy``.
    Spans read ``kind:start:end`` (code points, end exclusive), ordered by
    start and then kind as listed. Base matches are found leftmost and without
    overlap for each kind, then those too short are dropped. Entropy spans that
    a base span of any kind covers are left out, as are allowed ones; base
    spans always stay. Null texts count as empty: no spans, the digest of the
    empty string. Repeated rows repeat; other columns are ignored; an empty
    table gives an empty result.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), t.alias("_t"))
    none = F.array().cast("array<struct<start:int,stop:int,found:string>>")
    # The long patterns are placed only where a cheap test finds them.
    kinds = [("assign", ASSIGN, ASSIGN), ("access", ACCESS, r"AKIA[A-Z0-9]{16}"), ("hex", HEX, r"[0-9a-f]{24}")]
    kinds += [(name, pattern, r"[0-9A-Fa-f]{20}" if "hex" in name else r"[A-Za-z0-9+/_-]{20}") for name, pattern, *_ in CLASSES]
    # Hexadecimal matches are long ones of a run: runs are maximal, so only runs of the least length need places.
    shown = {"access": ACCESS.replace("+", f"{{{ACCESS_MIN - 4},}}"), "hex": r"(?<![0-9a-f])" + HEX.replace("+", f"{{{HEX_MIN},}}")}
    for name, pattern, test in kinds:
        rows = rows.withColumn(f"_{name}", F.when(F.col("_t").rlike(test), matches(F.col("_t"), shown.get(name, pattern))).otherwise(none))
    value = lambda m: F.regexp_extract(m["found"], ASSIGN, 2)
    rows = rows.withColumn("_assign", F.filter("_assign", lambda m: F.char_length(value(m)) >= ASSIGN_MIN))
    order = {"assign": 0, "access": 1, "hex": 2}

    def spans(name: str, rank: int) -> Column:
        return F.transform(f"_{name}", lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["stop"].alias("stop"), F.lit(name).alias("kind")))

    rows = rows.select("_id", *[f"_{n}" for n, *_ in kinds], F.concat(*[spans(n, r) for n, r in order.items()]).alias("_base"))
    more = []
    for rank, (name, _, alphabet, window, least, held) in enumerate(CLASSES, len(order)):
        def secret(m: Column) -> Column:
            found = m["found"]
            rest = F.when(found.rlike(ALLOW), F.split(found, ALLOWED, -1)).otherwise(F.array(found))
            shown = F.exists(rest, lambda p: F.when(F.char_length(p) >= LEAST, best_window(p, alphabet, window) >= least).otherwise(False))  # noqa: B023
            ok = ~F.exists("_base", lambda b: (b["start"] <= m["start"]) & (b["stop"] >= m["stop"])) & ~found.rlike(UUID)
            for kind in held:  # noqa: B023
                ok = ok & found.rlike(kind)
            return F.when(ok, shown).otherwise(False)

        good = F.filter(f"_{name}", secret)
        rows = rows.withColumn(f"_{name}", good)
        more.append(spans(name, rank))
    text = lambda a: F.array_join(F.transform(F.array_sort(a), lambda m: F.concat_ws(":", m["kind"], m["start"], m["stop"])), ",")
    count = lambda n: F.size(f"_{n}").cast("long")
    return rows.select(
        F.col("_id").alias(id_col), *[count(n).alias(f"n_{n}") for n in order], F.sha2(text(F.col("_base")), 256).alias("base_sha256"),
        text(F.concat("_base", *more)).alias("spans"), sum((count(n) for n, *_ in CLASSES), F.lit(0).cast("long")).alias("n_entropy"),
    )
