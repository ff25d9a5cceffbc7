import hashlib

from quadrat.llm import mixing


def brute(rows):
    """rows: (id, text, source) -> {(id, source, size): (source_size, target, copies)}"""
    entries = {}
    for i, text, source in rows:
        k = (i, source, len((text or "").encode().split()))
        entries[k] = entries.get(k, 0) + 1
    sources = sorted({k[1] for k in entries}, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    size = {s: sum(k[2] * n for k, n in entries.items() if k[1] == s) for s in sources}
    budget, full = sum(size.values()) * 1.5, set()
    while True:
        rest, open_weight = budget - sum(2 * size[s] for s in full), sum(w for s, w in weight.items() if s not in full)
        more = {s for s in sources if s not in full and weight[s] * rest / open_weight > 2 * size[s]}
        if not more:
            break
        full |= more
    target = {s: 2.0 * size[s] if s in full else weight[s] * (rest / open_weight) for s in sources}
    key = lambda i: int(hashlib.md5(f"{mixing.SEED}:{'null' if i is None else i}".encode()).hexdigest()[:10], 16)
    passes = []
    for at, s in enumerate(sources):
        if target[s] <= 0:
            continue
        run = 0
        for n in range(2):
            for k in sorted((k for k in entries if k[1] == s), key=lambda k: (key(k[0]), "null" if k[0] is None else str(k[0]), k[2])):
                run += k[2] * entries[k]
                passes.append(((run / target[s], at, key(k[0]), "null" if k[0] is None else str(k[0]), k[2], n), k))
    copies, spent = dict.fromkeys(entries, 0), 0
    for _, k in sorted(passes):
        spent += k[2] * entries[k]
        if spent > budget:
            break
        copies[k] += 1
    return {k: (size[k[1]], target[k[1]], copies[k]) for k in entries}


def check(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, target string")
    got = {(r.id, r.source, r.size): (r.source_size, r.target, r.copies) for r in mixing.plan(df, **more).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][0] == want[k][0] and got[k][2] == want[k][2] and abs(got[k][1] - want[k][1]) <= 1e-9 * max(1, want[k][1]), (k, got[k], want[k])
    out = mixing.mixed(df)
    assert out.columns == df.columns
    counts = {}
    for r in out.collect():
        k = (r.doc_id, r.source, len((r.text or "").encode().split()))
        counts[k] = counts.get(k, 0) + 1
    repeats = {}
    for i, text, s in rows:
        k = (i, s, len((text or "").encode().split()))
        repeats[k] = repeats.get(k, 0) + 1
    assert counts == {k: v[2] * repeats[k] for k, v in want.items() if v[2]}


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "one two", "b"), (4, "x " * 5000, None), (None, "u v w", "c"), (6, "q", None), (3, "one two", "b"), (7, "é x y", "zz")]
    check(spark, rows)


def test_hot_source(spark, monkeypatch):
    monkeypatch.setattr(mixing, "EDGE_ROWS", 5)
    rows = [(i, "w " * (i * 37 % 91), "hot" if i % 3 else f"s{i % 5}") for i in range(400)]
    check(spark, rows, bucket_rows=16)
    monkeypatch.setattr(mixing, "LEVEL_BITS", 2)
    check(spark, rows, bucket_rows=2)


def test_all_equal(spark):
    check(spark, [(i, "a b c", "s") for i in range(50)])


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.plan(df).collect() == [] and mixing.mixed(df).collect() == []
    check(spark, [(1, "", "a"), (2, None, None)])


def test_documents(spark, sf):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(spark, rows)
    want = brute(rows)
    for s in {k[1] for k in want}:
        mine = {k: v for k, v in want.items() if k[1] == s}
        taken, target = sum(k[2] * v[2] for k, v in mine.items()), next(iter(mine.values()))[1]
        assert abs(taken - target) <= max(k[2] for k in mine)
