"""SimHash near-dedup over deletion-variant signatures.

A 64-bit fingerprint is cut into three segments. Of at most four differing bits, some segment holds at
most one, so two linked fingerprints share a variant of that segment with one bit set aside (a wildcard).
Each distinct fingerprint is indexed under its 64 one-wildcard variants; fingerprints that meet under a
variant are verified by their exact distance, and what survives is reduced to spanning links before it
leaves the task. Components come from alternating star contraction.

For a similarity (Jaccard) of shingle sets, which no number of differing bits stands for, a fingerprint has
three words of 64 bits in twelve segments; what shares a variant is a candidate if the whole fingerprints
agree well enough, and is linked if the sets themselves are similar enough. A wildcard leaves one half of
its segment as it is, so these fingerprints are indexed under the halves, and variants are made in the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, join_hot, written

WIDTH = 4  # words in a shingle
DISTANCE = 4  # differing bits of linked fingerprints
SEED = 42
#: (word, first bit, bits) of each segment
SEGMENTS = ((0, 0, 21), (0, 21, 21), (0, 42, 22))
#: Fingerprints under one variant that a single task compares; more are dealt out as pairs of blocks.
BLOCK = 4096
#: Hot variants that may be broadcast (16 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Prints of a group that are compared by shifts, and all with all at once; larger groups are searched print by print.
SMALL, SQUARE = 24, 1024
#: Of similar texts: words in a shingle, least similarity, words of a fingerprint and their segments. A pair
#: at 0.8 differs in 15% of the bits and shares a variant of some segment with probability 0.98, one at 0.85
#: with 0.996. Longer segments (and more words) suit more documents: one variant holds N / 2**15 of N.
SET_WIDTH, SIMILARITY, WORDS = 5, 0.8, 3
SET_SEGMENTS = tuple((k, at, 16) for k in range(WORDS) for at in range(0, 64, 16))
#: Differing bits of a candidate: 4.7 deviations above the mean at 0.8. Of unrelated texts that share a variant,
#: 3 in 10**8 pass (176 other bits); far fewer than one for each text, or chance would chain most texts together.
SET_DISTANCE = 52
#: A half of a segment is dealt out in blocks if it holds so many times the mean (and over BLOCK).
HOT = 4
#: Shingles of the texts that a task compares with each other, about; larger groups are dealt out as pairs of blocks.
SHINGLES = 200_000
#: Distinct words that a task keeps with their hashes; texts that it looks at together.
SEEN, TEXTS = 100_000, 256


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits; sums of 255 rows fit a byte."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255):
        bits = np.unpackbits(hashes[at : at + 255].view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.uint8)
    return counts


def text_fingerprint(data: bytes, width: int = WIDTH) -> int:
    """The unsigned fingerprint of a UTF-8 text; 0 without words."""
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    n = len(words) - width + 1
    for at in range(0, n, 65536):
        to = min(n, at + 65536)
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at:to].tolist(), ends[at + width - 1 : to + width - 1].tolist())], np.uint64)
        counts += _ones(h)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def _print_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _few(batches):
        texts = batch.column(1).cast(pa.binary()).dictionary_encode()
        prints = np.array([text_fingerprint(x) for x in texts.dictionary.to_pylist()] + [0], np.uint64).view(np.int64)
        at = texts.indices.fill_null(len(prints) - 1).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints[at])], ["id", "bits"])


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, at most TEXTS at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            yield batch.slice(at, TEXTS)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, bits): every row's fingerprint as a signed bigint; a null text counts as empty."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("bits", T.LongType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_print_batches, schema)


def _word(k: int) -> Column:
    return F.col(f"bits{k}" if k else "bits")


def _value(k: int, first: int, bits: int) -> Column:
    return F.shiftrightunsigned(_word(k), first).bitwiseAND(F.lit((1 << bits) - 1))


def _wildcards(value: Column, n: int, segments: tuple) -> list[Column]:
    """The variants of segment n, from its value: the number of the bit set aside, over the other bits."""
    shift, before = max(s[2] for s in segments), sum(s[2] for s in segments[:n])
    return [(value.bitwiseAND(F.lit(~(1 << i))) + F.lit((before + i) << shift)).cast("int") for i in range(segments[n][2])]


def variants(prints: DataFrame, carried: list[str], segments: tuple = SEGMENTS) -> DataFrame:
    """(carried, variant): each fingerprint under its one-wildcard variants, numbered in one int."""
    keys = [v for n, s in enumerate(segments) for v in _wildcards(_value(*s), n, segments)]
    return prints.select(*carried, F.explode(F.array(*keys)).alias("variant"))


def hot_variants(prints: DataFrame, block: int = BLOCK, segments: tuple = SEGMENTS) -> DataFrame:
    """(variant, parts): variants that may hold over block fingerprints.

    A variant's fingerprints are those of two segment values, so counts of the segment values of each
    fingerprint (pre-aggregated) are enough: over block means over block / 2 for one of the two.
    """
    values = [F.struct(F.lit(n).alias("k"), _value(*s).alias("v")) for n, s in enumerate(segments)]
    counted = prints.select(F.explode(F.array(*values)).alias("s")).groupBy("s.k", "s.v").count().filter(F.col("count") > block // 2)
    keys = F.lit(None)
    for n in range(len(segments)):
        keys = F.when(F.col("k") == n, F.array(*_wildcards(F.col("v"), n, segments))).otherwise(keys)
    spread = counted.select(F.explode(keys).alias("variant"), "count")
    half = block // 2
    return spread.groupBy("variant").agg(F.sum("count").alias("n")).select("variant", (F.ceil(F.col("n") / half) + 1).cast("int").alias("parts"))


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints; the words of a row are added."""
    counts = np.bitwise_count(a ^ b)
    return counts if counts.ndim == 1 else counts.sum(axis=1, dtype=np.int64)


def _spanning(prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what distance connects in a group: each found print with the one that reached it, by row."""
    left, a, b = np.arange(len(prints)), [], []
    frontier: list[int] = []
    while len(left):
        if not frontier:
            frontier, left = [left[0]], left[1:]
        here = frontier.pop()
        near = _differ(prints[left], prints[here]) <= distance
        if near.any():
            found = left[near]
            a.append(np.full(len(found), here))
            b.append(found)
            frontier.extend(found)
            left = left[~near]
    empty = np.empty(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as links (a, b), with at most one link for each print: to its component's first."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        after = root.copy()
        np.minimum.at(after, root[x], low)
        np.minimum.at(after, root[y], low)
        after = after[after]
        if (after == root).all():
            break
        root = after
    kept = root != np.arange(len(nodes))
    return nodes[root[kept]], nodes[kept]


def _square(prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """As _spanning, for prints of several words: all pairs at once, unless they are many."""
    counts = np.zeros((len(prints), len(prints)), np.uint8)
    for word in prints.T:
        counts += np.bitwise_count(word[:, None] ^ word)
    near = counts <= distance
    if np.count_nonzero(near) > 8 * len(prints):
        return _spanning(prints, distance)
    x, y = np.nonzero(near)
    return x[x < y], y[x < y]


def _group_links(key: np.ndarray, prints: np.ndarray, distance: int) -> tuple[list, list]:
    """Links inside each run of equal keys, named by the first word of the prints."""
    a, b = [], []
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(starts, len(key)))
    size = np.repeat(sizes, sizes)
    small = np.flatnonzero((size > 1) & (size <= SMALL))
    first = prints if prints.ndim == 1 else prints[:, 0]
    k, p, f = key[small], prints[small], first[small]
    for d in range(1, SMALL):
        if len(k) <= d:
            break
        same = np.flatnonzero(k[d:] == k[:-d])
        same = same[_differ(p[same + d], p[same]) <= distance]
        if len(same):
            a.append(f[same])
            b.append(f[same + d])
    for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        x, y = (_square if prints.ndim > 1 and n <= SQUARE else _spanning)(prints[s : s + n], distance)
        a.append(first[s + x])
        b.append(first[s + y])
    return a, b


def _halves(segments: tuple) -> list[tuple[tuple, tuple]]:
    """Both halves of each segment, each with the other one."""
    pairs = [((k, at, n // 2), (k, at + n // 2, n - n // 2)) for k, at, n in segments]
    return [x for low, high in pairs for x in ((low, high), (high, low))]


def _half_links(key: np.ndarray, prints: np.ndarray, distance: int, segments: tuple) -> tuple[list, list]:
    """Links inside each run of equal keys (halves of segments) among prints that share a variant of the segment."""
    halves = _halves(segments)
    width = max(h[0][2] for h in halves)
    word, first, bits = np.array([other for _, other in halves])[key >> 32 >> width].T
    value = (prints[np.arange(len(prints)), word] >> first.astype(np.uint64)).astype(np.int64) & ((1 << bits) - 1)
    run = np.cumsum(np.concatenate(([0], key[1:] != key[:-1]))) << width
    a, b = [], []
    for i in range(width):
        variant = run | (value & ~(1 << i))
        order = np.argsort(variant, kind="stable")
        x, y = _group_links(variant[order], prints[order], distance)
        a, b = a + x, b + y
    return a, b


def _link_batches(find):
    """find: links inside each run of equal keys of (sorted keys, prints)."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, prints = np.empty(0, np.int64), None
        a, b, held = [], [], 0

        def flush():
            x, y = _stars(np.concatenate(a), np.concatenate(b))
            a[:], b[:] = [x], [y]
            return len(x)

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.concatenate((key, (batch.column(0).to_numpy().astype(np.int64) << 32) | batch.column(1).to_numpy()))
            words = [w.view(f"u{w.dtype.itemsize}").astype(np.uint64) for w in (batch.column(i).to_numpy() for i in range(2, batch.num_columns))]
            new = words[0] if len(words) == 1 else np.stack(words, axis=1)
            prints = new if prints is None else np.concatenate((prints, new))
            whole = int(np.searchsorted(key, key[-1]))  # the last group may go on in the next batch
            x, y = find(key[:whole], prints[:whole]) if whole else ([], [])
            a, b = a + x, b + y
            key, prints = key[whole:], prints[whole:]
            if sum(map(len, a)) > 2 * held + 500_000:
                held = flush()
        if prints is not None:
            x, y = find(key, prints)
            a, b = a + x, b + y
        if sum(map(len, a)):
            flush()
            yield pa.RecordBatch.from_arrays([pa.array(a[0].view(np.int64)), pa.array(b[0].view(np.int64))], ["a", "b"])

    return links


def _pair(own: Column, parts: Column) -> Column:
    """The pairs of blocks, as one int each, that a row of block own meets in."""
    return F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.least(j, own) * F.lit(32768) + F.greatest(j, own))


def _meet(index: DataFrame, hot: DataFrame, key: str, words: list[str], find) -> DataFrame:
    """(a, b): links that find gives for the rows of each key, a hot key's (key, parts) by pairs of blocks."""
    n = hot.count()
    if n:
        side = F.broadcast(hot) if n <= BROADCAST_ROWS else hot
        own = F.pmod(F.xxhash64(*words), F.col("parts")).cast("int")
        pair = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.array_distinct(_pair(own, F.col("parts"))))
        index = index.join(side, key, "left").select(key, *words, F.explode(pair).alias("pair"))
    else:
        index = index.withColumn("pair", F.lit(0))
    ordered = index.select(key, F.col("pair").cast("int").alias("pair"), *words).repartition(key, "pair").sortWithinPartitions(key, "pair")
    return ordered.mapInArrow(_link_batches(find), "a long, b long")


def links(prints: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect all fingerprints that differ in at most distance bits.

    prints has distinct fingerprints (bits). Variants that hold more than block fingerprints are dealt out
    as pairs of blocks, so that a task compares at most about 2 * block of them and no pair is lost.
    """
    if distance > 4:
        raise ValueError("three segments with one wildcard find up to four differing bits")
    hot = cut(hot_variants(prints, block))
    return _meet(variants(prints, ["bits"]), hot, "variant", ["bits"], lambda key, found: _group_links(key, found, distance))


def half_index(prints: DataFrame, words: list[str], segments: tuple = SET_SEGMENTS) -> DataFrame:
    """(words, half): each fingerprint under both halves of each segment, numbered in one int."""
    halves = _halves(segments)
    width = max(own[2] for own, _ in halves)
    keys = [(_value(*own) + F.lit(n << width)).cast("int") for n, (own, _) in enumerate(halves)]
    return prints.select(*words, F.explode(F.array(*keys)).alias("half"))


def set_links(prints: DataFrame, words: list[str], distance: int = SET_DISTANCE, block: int = BLOCK, segments: tuple = SET_SEGMENTS) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints that share a variant of a segment and differ in at most distance bits.

    The first of the words names a fingerprint. One variant's fingerprints share a half of the segment, so
    each fingerprint is sent twice a segment, not once a variant. A half that holds more than block
    fingerprints and HOT times the mean is dealt out as pairs of blocks.
    """
    index = half_index(prints, words, segments)
    held = cut(index.groupBy("half").count())
    most = max(block, HOT * (held.agg(F.avg("count")).first()[0] or 0))
    hot = held.filter(F.col("count") > most).select("half", (F.ceil(F.col("count") / (most / 2)) + 1).cast("int").alias("parts"))
    return _meet(index, hot, "half", words, lambda key, found: _half_links(key, found, distance, segments))


def _star_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a partition as stars, at most one link for each node but their centres."""
    a, b, held = [], [], 0
    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
        if sum(map(len, a)) > 2 * held + 500_000:
            x, y = _stars(np.concatenate(a), np.concatenate(b))
            a, b, held = [x], [y], len(x)
    if sum(map(len, a)):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _stars(np.concatenate(a), np.concatenate(b))], ["a", "b"])


def components(pairs: DataFrame, most: int = 50) -> DataFrame:
    """(node, root): every linked node but the roots, with the smallest node of its component.

    Links that came from different tasks may name a node's group by many centres; partitions by node first
    turn them into stars of common centres, so that a group has about as many links as nodes. Then
    alternating large-star and small-star contraction; each round ends in the shared folder. A node's
    links are only joined and pre-aggregated, never gathered, so a star of any size is split by the
    adaptive skew join.
    """
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    pairs = cut(pairs.repartition("b").mapInArrow(_star_batches, "a long, b long").distinct())
    before = None
    for _ in range(most):
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("a"), F.min("b")).alias("m"))
        large = pairs.join(least, F.col("a") == F.col("u")).select(F.col("m").alias("a"), "b").filter("a < b")
        least = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        small = large.join(least, F.col("b") == F.col("u")).select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), "b"))).alias("e")).select("e.a", "e.b").filter("a < b").distinct()
        pairs = cut(small)
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return pairs.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(id, fingerprint, component_id) for every row of docs.

    component_id is the smallest id reachable over links. Null texts and texts without words have
    fingerprint zero and are linked like any other; fewer words than a shingle count as one shingle;
    repeated rows stay repeated; a null id never names a component unless nothing else is in it; an empty
    table gives no rows. Exact copies meet in one fingerprint and are never paired.
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    first = cut(prints.groupBy("bits").agg(F.min("id").alias("first"), F.count("*").alias("rows")))
    found = components(links(first.select("bits"), distance))
    rooted = cut(first.join(found, F.col("bits") == F.col("node"), "left").select("bits", "first", "rows", F.coalesce("root", "bits").alias("root")))
    names = cut(rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("members")))
    named = cut(join_hot(rooted.select("bits", "rows", "root"), names, "root", "members").select("bits", "rows", "component_id"))
    return join_hot(prints, named, "bits", "rows").select("id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def _word_hashes(words: list[bytes], seen: dict[bytes, int]) -> np.ndarray:
    """XXH64 of each word; words are kept in seen with theirs, a bounded number of them."""
    fresh = {w for w in words if w not in seen}
    if len(seen) + len(fresh) > SEEN:
        seen.clear()
        fresh = set(words)
    seen.update((w, xxhash.xxh64_intdigest(w, SEED)) for w in fresh)
    return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def _remixed(h: np.ndarray, k: int) -> np.ndarray:
    """Other 64 bits of hashes for each k."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB + 2 * k)
    return h ^ (h >> np.uint64(31))


def shingle_set(data: bytes, width: int = SET_WIDTH, seen: dict[bytes, int] | None = None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a UTF-8 text's shingles of lower-case words, made of the words' hashes; empty without words."""
    hashes = _word_hashes(data.lower().split(), {} if seen is None else seen)
    if not len(hashes):
        return hashes
    n = max(1, len(hashes) - width + 1)
    made = np.zeros(n, np.uint64)
    for k in range(min(width, len(hashes))):
        made = made * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    return np.unique(_remixed(made, 0))


def wide_print(hashes: np.ndarray, words: int = WORDS) -> list[int]:
    """The signed words of a set's fingerprint: majorities of the bits of each hash, remixed for each further word."""
    out = []
    for k in range(words):
        counts = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 65536):
            h = hashes[at : at + 65536]
            counts += _ones(_remixed(h, k) if k else h)
        out.append(int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0]))
    return out


def _set_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batch's other columns, and of its last, the text: a digest of the shingle set, its size and its fingerprint."""
    seen: dict[bytes, int] = {}
    for batch in _few(batches):
        texts = batch.column(batch.num_columns - 1).cast(pa.binary()).fill_null(b"").dictionary_encode()
        made = []
        for x in texts.dictionary.to_pylist():
            hashes = shingle_set(x, seen=seen)
            made.append((np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).astype(np.int64), len(hashes), *wide_print(hashes)))
        at = texts.indices.to_numpy()
        columns = [pa.array(np.array(c, np.int64)[at]) for c in zip(*made)] if made else [pa.array([], pa.int64())] * (2 + WORDS)
        names = ["digest", "n", "bits", *(f"bits{k}" for k in range(1, WORDS))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], *names])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batch's other columns and, for its last, the text, the sorted hashes of its shingles; few texts at a time."""
    seen: dict[bytes, int] = {}
    for part in _few(batches):
        made = [shingle_set((x or "").encode(), seen=seen).view(np.int64) for x in part.column(part.num_columns - 1).to_pylist()]
        ends = pa.array(np.cumsum([0, *map(len, made)]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(ends, pa.array(np.concatenate(made)))], [*part.schema.names[:-1], "hashes"])


def _similar(sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Links by row that connect what similarity connects among sets, by the exact Jaccard of each pair looked at."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    left, a, b = np.arange(len(sets)), [], []
    frontier: list[int] = []
    while len(left):
        if not frontier:
            frontier, left = [left[0]], left[1:]
        here = frontier.pop()
        own = sets[here]
        near = left[np.minimum(sizes[left], len(own)) >= similarity * np.maximum(sizes[left], len(own))]
        if not len(near):
            continue
        flat = np.concatenate([sets[i] for i in near])
        at = np.minimum(np.searchsorted(own, flat), max(len(own) - 1, 0))
        hit = own[at] == flat if len(own) else np.zeros(len(flat), bool)
        both = np.bincount(np.repeat(np.arange(len(near)), sizes[near]), hit, len(near))
        found = near[both >= similarity * (sizes[near] + len(own) - both) - 1e-9]
        a += [int(here)] * len(found)
        b += found.tolist()
        frontier.extend(found)
        left = np.setdiff1d(left, found, assume_unique=True)
    return a, b


def _verify_batches(similarity: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digests, sets = None, [], []

        def done():
            a, b = _similar(sets, similarity)
            return pa.RecordBatch.from_arrays([pa.array([digests[i] for i in a], pa.int64()), pa.array([digests[i] for i in b], pa.int64())], ["a", "b"])

        for batch in batches:
            hashes = batch.column(3)
            values, ends = hashes.flatten().to_numpy().view(np.uint64), hashes.offsets.to_numpy() - hashes.offsets[0].as_py()
            for i, (root, pair, digest) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                if (root, pair) != held:
                    if len(sets) > 1:
                        yield done()
                    held, digests, sets = (root, pair), [], []
                digests.append(digest)
                sets.append(values[ends[i] : ends[i + 1]].copy())
        if len(sets) > 1:
            yield done()

    return verify


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingles: int = SHINGLES) -> DataFrame:
    """One row of docs, with its columns, for each group of near copies.

    Near copies are texts whose sets of five-word shingles (lower-case words; fewer words: the whole text)
    have a Jaccard similarity of at least ``similarity``, and what such links connect. Equal sets, and texts
    without words (null among them), are copies of each other. The row with the smallest id stays, a null id
    last, then by a hash of id and text; of rows that repeat id and text, any one. Sets are told apart by 64
    bits. An empty table gives no rows.

    Candidates come from shared variants of a wide fingerprint (recall at ``SET_SEGMENTS``) and each link is
    checked on the sets themselves. Whole texts are shuffled once, by row, and only the candidates' again.
    """
    h1, h2 = F.xxhash64(id_col, text_col, F.col(id_col).isNull()), F.xxhash64(F.lit("row"), F.col(text_col).isNull(), text_col, id_col)
    keyed = docs.withColumns({"__h1": h1, "__h2": h2})
    kinds = [T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("h1", "h2", "digest", "n", "bits", *(f"bits{k}" for k in range(1, WORDS))))]
    rows = keyed.select(F.col(id_col).alias("id"), F.col("__h1").alias("h1"), F.col("__h2").alias("h2"), F.col(text_col).cast("string").alias("text")).mapInArrow(_set_prints, T.StructType(kinds))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "h1", "h2")
    words = ["bits", *(f"bits{k}" for k in range(1, WORDS))]
    sets = cut(rows.groupBy("digest").agg(F.min(order).alias("first"), F.first("n").alias("n"), *(F.first(w).alias(w) for w in words)))
    found = components(set_links(sets.select(*words).dropDuplicates(words), words))
    rooted = cut(sets.join(found, F.col("bits") == F.col("node"), "left").select("digest", "first", "n", F.coalesce("root", "bits").alias("root")))
    total = F.sum(F.col("n") + 1)
    busy = cut(rooted.groupBy("root").agg(F.count("*").alias("members"), F.when(total <= 2 * shingles, 1).otherwise(F.ceil(total / shingles) + 1).cast("int").alias("parts")).filter("members > 1"))
    grouped = join_hot(rooted, busy, "root", "members").select("digest", "parts")
    reps = rooted.join(grouped, "digest", "left").select(F.col("first.h1").alias("__h1"), F.col("first.h2").alias("__h2"), F.col("digest").alias("__digest"), F.when(F.col("parts").isNotNull(), F.col("root")).alias("__root"), F.col("parts").alias("__parts"))
    single = Window.partitionBy("__h1", "__h2").orderBy("__digest")
    kept, _ = written(keyed.join(reps, ["__h1", "__h2"]).withColumn("__n", F.row_number().over(single)).filter("__n = 1").drop("__n", "__h1", "__h2"))
    alone, unsure = kept.filter("__root is null").select(*docs.columns), kept.filter("__root is not null")
    own = F.pmod(F.xxhash64("__digest"), F.col("__parts")).cast("int")
    dealt = unsure.select(F.col("__root").alias("root"), F.explode(F.array_distinct(_pair(own, F.col("__parts")))).alias("pair"), F.col("__digest").alias("digest"), F.col(text_col).cast("string").alias("text"))
    schema = "root long, pair int, digest long, hashes array<long>"
    linked = dealt.mapInArrow(_sets, schema).repartition("root", "pair").sortWithinPartitions("root", "pair").mapInArrow(_verify_batches(similarity), "a long, b long")
    same = components(linked)
    firsts = rooted.select("digest", "first").join(same, F.col("digest") == F.col("node"), "left").select("digest", "first", F.coalesce("root", "digest").alias("group"))
    stay = firsts.groupBy("group").agg(F.min(F.struct("first", "digest")).alias("best")).select(F.col("best.digest").alias("__digest"))
    return alone.unionByName(unsure.join(stay, "__digest", "left_semi").select(*docs.columns))
