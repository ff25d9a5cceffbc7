import hashlib

from quadrat.llm import sharding


def brute(rows, limit):
    """rows: (id, text) with distinct ids -> sorted (id, bytes, shard, depth, shard_bytes)"""
    items = [(i, len((t or "").encode()), f"{int(hashlib.md5(('null' if i is None else str(i)).encode()).hexdigest()[:10], 16):040b}") for i, t in rows]
    out = []

    def split(some, prefix):
        total = sum(n for _, n, _ in some)
        if total <= limit or len(some) == 1:
            out.extend((i, n, prefix, len(prefix), total) for i, n, _ in some)
        else:
            for bit in "01":
                part = [x for x in some if x[2][len(prefix)] == bit]
                if part:
                    split(part, prefix + bit)

    if items:
        split(items, "")
    return sorted(out, key=str)


def check(spark, rows, limit):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, shard string")
    assert sorted(map(tuple, sharding.assign(df, limit=limit).collect()), key=str) == brute(rows, limit)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "é" * 10), (4, "x" * 1000), (None, "abc"), (5, "y" * 90), (6, "z" * 90)]
    for limit in (1, 100, 10_000):
        check(spark, rows, limit)


def test_repeats_split(spark):
    df = spark.createDataFrame([(1, "x" * 10)] * 300 + [(2, "y" * 10)], "doc_id long, text string")
    got = sharding.assign(df, limit=200).collect()
    sizes = {}
    for r in got:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.n_bytes
        assert r.shard_bytes <= 200
    assert len(got) == 301 and all(r.shard_bytes == sizes[r.shard] for r in got)


def test_empty(spark):
    assert sharding.assign(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_documents(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check(spark, rows, 20_000)
    sharding.write_shards(docs, f"file://{tmp_path}/s", limit=50_000)
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted(rows)


def test_repeated_and_null_ids_split_and_are_written_once(spark, tmp_path):
    rows = [(7, "a" * 10)] * 40 + [(7, f"b{i}" * 5) for i in range(20)] + [(None, "c" * 10)] * 30 + [(i, "d") for i in range(10)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, shard string")
    got = sharding.assign(df, limit=60)
    assert len(got.collect()) == len(rows) and all(r.shard_bytes <= 60 for r in got.collect())
    assert sorted(map(str, got.collect())) == sorted(map(str, sharding.assign(df.repartition(5), limit=60).collect()))
    sharding.write_shards(df, f"file://{tmp_path}/s", limit=60)
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert sorted(map(str, ((r.doc_id, r.text) for r in back.collect()))) == sorted(map(str, rows))
    sizes = {}
    for r in back.collect():
        sizes[r.shard] = sizes.get(r.shard, 0) + len(r.text)
    assert max(sizes.values()) <= 60
