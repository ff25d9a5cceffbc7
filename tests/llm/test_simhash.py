import random

import numpy as np
import xxhash
from quadrat.llm import simhash


def brute_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lower + " ":
        if c in " \t\n\v\f\r":
            words += [word] * bool(word)
            word = ""
        else:
            word += c
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    """rows: (id, fingerprint) -> smallest id reachable, by row."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 4:
                root[find(i)] = find(j)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(k)
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(rows))]


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, bits string, component_id string")
    got = sorted(simhash.near_duplicates(df).collect(), key=str)
    want = [(r[0], brute_fingerprint(r[1])) for r in rows]
    expected = sorted(((k, f"{p:016x}", c) for (k, p), c in zip(want, brute_components(want))), key=lambda r: str(r))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_edges(spark):
    texts = [None, "", " \n", "a", "A", "a b", "a b c d", "a  b\tc\nd", "a b c d e", "é É x y z", "x" * 100_000, "w " * 30_000, "a b c d"]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(None, "a b c d", None, None), (3, "a", "x", "y"), (3, "a", "x", "y")]
    check(spark, rows)


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_documents(spark, sf):
    rows = [(r.doc_id, r.text, "", "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(spark, rows)


def test_links_lose_nothing(spark):
    """Random flips around hot centres, with blocks so small that most variants are dealt out as pairs."""
    rnd = random.Random(3)
    centres = [rnd.getrandbits(64) for _ in range(6)]
    prints = {c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5))) for c in centres for _ in range(60)} | {0, 2**64 - 1}
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "bits long")
    want = brute_components([(x, p) for x, p in zip(signed, prints)])
    for block in (8, 40, 4096):
        found = {r.node: r.root for r in simhash.components(simhash.links(df, block=block)).collect()}
        assert [found.get(x, x) for x in signed] == want


def test_path_and_star_components(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 4000)]
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 101)} | {1000 + i: 1000 for i in range(1, 50)} | {5000: 4000}


def brute_kept(rows, similarity=0.8):
    """rows: (id, text) -> ids that stay, by the exact Jaccard of five-word shingle sets of all pairs."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = []
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both and both >= similarity * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                pairs.append((i, j))
                root[find(i)] = find(j)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(k)
    return sorted((min(g, key=lambda k: (k is None, k or 0)) for g in groups.values()), key=str), pairs


def kept(spark, rows, **more):
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], "doc_id long, text string, digest string, root int")
    got = simhash.keep_one(df, **more)
    assert got.columns == df.columns and got.dtypes == df.dtypes
    return sorted((r.doc_id for r in got.collect()), key=str)


def edited(rnd, words, share):
    return " ".join(f"new{rnd.randint(0, 9999)}" if rnd.random() < share else w for w in words)


def test_keep_one_row_of_each_group(spark):
    rows = [(1, "a b c d"), (None, "a b c d"), (None, "other"), (None, "other"), (2, "x y z"), (5, "X  y\tz"), (5, "else"), (7, None), (8, ""), (9, " \n"), (5, "else"), (11, "w " * 30_000), (12, "w w w w w w")]
    assert kept(spark, rows) == brute_kept(rows)[0] == sorted([1, None, 2, 5, 7, 11], key=str)
    assert kept(spark, []) == []
    whole = spark.createDataFrame([(2, "a b c"), (2, "a b c"), (3, "A b C"), (4, "z")], "doc_id long, text string")
    assert sorted(map(tuple, simhash.keep_one(whole).collect())) == [(2, "a b c"), (4, "z")]


def test_keep_one_finds_similar_texts(spark):
    """Edited copies at all similarities around 0.8: groups equal those of all pairs, also when dealt out in blocks."""
    rnd = random.Random(5)
    rows = []
    for _ in range(60):
        words = [f"w{rnd.randint(0, 3000)}" for _ in range(rnd.randint(40, 300))]
        rows.append(" ".join(words))
        rows += [edited(rnd, words, s) for s in (0.005, 0.01, 0.02, 0.03, 0.05)]
    hot = [f"h{i}" for i in range(200)]
    rows += [edited(rnd, hot, 0.01) for _ in range(150)]
    rnd.shuffle(rows)
    rows = list(enumerate(rows))
    want, pairs = brute_kept(rows)
    for shingles in (1_000_000, 3000):
        assert kept(spark, rows, shingles=shingles) == want
    # of the pairs themselves, found one by one
    found = 0
    for i, j in pairs[:400]:
        prints = [simhash.wide_print(simhash.shingle_set(rows[k][1].encode())) for k in (i, j)]
        found += any(((prints[0][k] ^ prints[1][k]) >> at & 0xFFFF).bit_count() <= 1 for k, at, _ in simhash.SET_SEGMENTS)
    assert found >= 0.97 * 400


WIDE = ["bits", "bits1", "bits2"]


def wide(spark, prints):
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    return spark.createDataFrame(signed, ", ".join(f"{w} long" for w in WIDE)), [r[0] for r in signed]


def candidates(a, b):
    """Whether two wide prints share a variant and differ in few enough of all their bits."""
    apart = [x ^ y for x, y in zip(a, b)]
    return any(((apart[k] >> at) & (1 << n) - 1).bit_count() <= 1 for k, at, n in simhash.SET_SEGMENTS) and sum(x.bit_count() for x in apart) <= simhash.SET_DISTANCE


def test_set_links_lose_nothing(spark):
    """Prints at all distances around a few centres: groups are those of all pairs, also when halves are dealt out in blocks."""
    rnd = random.Random(7)
    centres = [[rnd.getrandbits(64) for _ in WIDE] for _ in range(5)]
    prints = {tuple(sum(1 << i for i in range(64) if rnd.random() < share) ^ w for w in c) for c in centres for share in (0.01, 0.1, 0.14, 0.2) for _ in range(20)}
    prints |= {(0, 0, 0), (2**64 - 1,) * 3} | {tuple(w ^ 1 << rnd.randrange(64) for w in centres[0]) for _ in range(60)}
    prints = sorted(prints)
    df, names = wide(spark, prints)
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if candidates(prints[i], prints[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, x in enumerate(names):
        groups.setdefault(find(i), []).append(x)
    want = [min(groups[find(i)]) for i in range(len(names))]
    for block in (8, 40, 4096):
        found = {r.node: r.root for r in simhash.components(simhash.set_links(df, WIDE, block=block)).collect()}
        assert [found.get(x, x) for x in names] == want


def test_unrelated_texts_are_no_candidates(spark):
    """Chance alone chains no texts together, and a print is sent twice a segment: what is shuffled grows as the table."""
    rnd = random.Random(9)
    prints = [tuple(rnd.getrandbits(64) for _ in WIDE) for _ in range(12_000)]
    df, _ = wide(spark, prints)
    assert simhash.set_links(df, WIDE).count() == 0
    assert simhash.half_index(df, WIDE).count() == 2 * len(simhash.SET_SEGMENTS) * len(prints)
