import hashlib
import re

from quadrat.llm import imatch


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def brute(rows):
    """rows: (id, text) with distinct ids -> {id: the other columns}"""
    docs = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    split = lambda t: {w for w in re.split("[ \t-\r]+", t.lower()) if w}
    df = {}
    for _, t in docs:
        for w in split(t):
            df[w] = df.get(w, 0) + 1
    n = len(docs)
    lexicon = {w for w, k in df.items() if max(2, 0.001 * n) <= k <= max(2, 0.1 * n)}

    def subset(w, k):
        return k == 0 or int(hashlib.sha256(f"i-match:{w}".encode()).hexdigest()[2 * k - 1 : 2 * k + 1], 16) < imatch.SUBSETS[k]

    def number(w):
        own = int(hashlib.sha256(f"i-match:{w}".encode()).hexdigest()[48:58], 16) >> 1
        return (own << len(imatch.SUBSETS)) + sum(1 << k for k in range(len(imatch.SUBSETS)) if subset(w, k))

    def fingerprint(t):
        parts = []
        for k in range(len(imatch.SUBSETS)):
            kept = sorted(number(w) for w in split(t) if w in lexicon and subset(w, k))
            parts.append(md5(" ".join(map(str, kept)))[: imatch.DIGEST] if kept else imatch.NONE)
        return parts if set(parts) != {imatch.NONE} else [md5(t)[: imatch.DIGEST]] * len(parts)

    def likeness(a, b):
        some = [(x, y) for x, y in zip(a, b) if x != imatch.NONE or y != imatch.NONE]
        return 1.0 if a == b else sum(x == y for x, y in some) / len(some)

    out = {}
    for at, (i, t) in enumerate(docs):
        after = docs[(at + 1) % n][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        own, changed, other = fingerprint(t), fingerprint(edited), fingerprint(after)
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(own), "".join(changed), likeness(own, changed), likeness(own, other))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, key int, sha string")
    got = imatch.compare_edits(df).collect()
    assert len(got) == len(rows)
    assert {r.id: tuple(r)[1:] for r in got} == brute(rows)


def test_edges(spark):
    rows = [(5, None), (7, ""), (-3, "a"), (2**60, "b c d e f"), (None, "é ü 😀 x"), (9, "Same Text here"), (10, "same text HERE"), (11, " \n a\tb "), (12, "w " * 50_000), (13, "q" * 30_001)]
    check(spark, rows)
    check(spark, [(1, "a b c")])
    check(spark, [(i, f"t{i % 7} u{i % 5} common v{i % 3}") for i in range(60)])


def test_repeats(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c d"), (2, "a b")], "doc_id long, text string")
    got = imatch.compare_edits(df).collect()
    assert sorted(r.id for r in got) == [1, 1, 1, 2]
    assert len({r.fingerprint for r in got if r.edited_sha256 and r.n_chars == 3}) == 2


def test_empty(spark):
    assert imatch.compare_edits(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check(spark, rows)
    alone = {r.id: r.fingerprint for r in imatch.fingerprints(docs).collect()}
    assert alone == {i: v[2] for i, v in brute(rows).items()}
