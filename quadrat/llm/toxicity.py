"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(bias + sum of w_i + sum over pairs of <v_i, v_j>) over the distinct terms of a text: its
lower-case words and their first characters, hashed to 31 bits. The pair term learns what linear weights
can't: words that count only together. The machine has every term that is frequent enough to be learned
from, whether or not it tells anything alone. It is trained here, on the driver, from a bounded sample of
labelled rows, and sent to the workers as arrays.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled rows that the machine is fitted on at most: those with the smallest hash of the id.
TRAIN_ROWS = 16_000
#: Terms in fewer fitted rows than this share of them, or than LEAST_DF, are left out; labels play no part in it.
#: A row's mean number of distinct terms divided by the share bounds the number of terms.
LEAST_SHARE, LEAST_DF = 0.0025, 3
PREFIXES = (4, 5)
FACTORS = 4
#: Passes over the rows with weights alone and with both: so many batches, within the limits that follow.
PASSES = ((1500, 10, 300), (600, 5, 12))
BATCH = 64
#: Step and pull to zero of weights, the same of factors and their first deviation, and what squared gradients start from.
STEP, LASSO, FACTOR_STEP, DECAY, SPREAD, START = 0.3, 7e-4, 0.05, 1e-4, 0.01, 1e-2
WORD = re.compile(r"[^\W_]+")
CACHE = 100_000
#: Texts that are looked at together.
TEXTS = 512


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 when divided by 5; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


class Terms:
    """Hashed distinct terms of texts, ascending; words seen are kept with theirs, a bounded number of them."""

    def __init__(self) -> None:
        self.seen: dict[str, tuple[int, ...]] = {}

    def of(self, word: str) -> tuple[int, ...]:
        data = [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]
        return tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) >> 1 for x in data)

    def __call__(self, text: str | None) -> np.ndarray:
        found: set[int] = set()
        seen = self.seen
        for word in set(WORD.findall((text or "").lower())):
            terms = seen.get(word)
            if terms is None:
                if len(seen) >= CACHE:
                    seen.clear()
                terms = seen[word] = self.of(word)
            found.update(terms)
        return np.sort(np.fromiter(found, np.int32, len(found)))


class Known(Terms):
    """Rows in a machine of the distinct terms of texts that it has, ascending."""

    def __init__(self, model: dict) -> None:
        super().__init__()
        self.rows = {t: i for i, t in enumerate(model["terms"].tolist())}

    def of(self, word: str) -> tuple[int, ...]:
        return tuple(self.rows[t] for t in super().of(word) if t in self.rows)


def _forward(model: dict, at: np.ndarray, ends: np.ndarray, paired: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Margins of texts whose terms' rows lie one after another in at, with or without pairs; and each text's sum of factors."""
    rows = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    linear = np.bincount(rows, model["w"][at], len(ends))
    if not paired:
        return model["bias"] + linear, None
    v = model["v"][at]
    sums = np.stack([np.bincount(rows, v[:, k], len(ends)) for k in range(v.shape[1])], axis=1)
    squares = np.bincount(rows, np.einsum("ij,ij->i", v, v), len(ends))
    return model["bias"] + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums


def fit(rows: list[np.ndarray], labels: np.ndarray) -> dict:
    """A machine from hashed terms and 0/1 labels; without both labels it scores the share of ones.

    Weights are fitted alone first, with a pull that keeps those of chance terms at zero, and then with
    the factors, which learn what the weights left.
    """
    n = len(rows)
    share = float((labels.sum() + 0.5) / (n + 1)) if n else 0.0
    terms, df = np.unique(np.concatenate(rows), return_counts=True) if n else (np.empty(0, np.int32), np.empty(0, np.int64))
    terms = terms[df >= max(LEAST_DF, LEAST_SHARE * n)]
    rng = np.random.default_rng(7)
    model = {"terms": terms, "w": np.zeros(len(terms)), "v": rng.normal(0, SPREAD, (len(terms), FACTORS)), "bias": float(np.log(share / (1 - share))) if 0 < share < 1 else -20.0}
    if not len(terms) or labels.min() == labels.max():
        model["v"][:] = 0
        return model
    rows = [np.searchsorted(terms, x[np.isin(x, terms, assume_unique=True)]) for x in rows]
    gw, gv = np.full(len(terms), START), np.full((len(terms), FACTORS), START)
    alone, both = (int(np.clip(steps * BATCH / n, low, high)) for steps, low, high in PASSES)
    for epoch in range(alone + both):
        paired = epoch >= alone
        order = rng.permutation(n)
        for b in range(0, n, BATCH):
            mine = order[b : b + BATCH]
            at = np.concatenate([rows[i] for i in mine])
            if not len(at):
                continue
            sizes = np.fromiter((len(rows[i]) for i in mine), np.int64, len(mine))
            margin, sums = _forward(model, at, np.cumsum(sizes), paired)
            error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[mine]
            each = np.repeat(error, sizes)
            used, where = np.unique(at, return_inverse=True)
            w = model["w"][used]
            dw = np.bincount(where, each, len(used)) / len(mine)
            gw[used] += dw * dw
            rate = STEP / np.sqrt(gw[used])
            w = w - rate * dw
            model["w"][used] = np.sign(w) * np.maximum(np.abs(w) - rate * LASSO, 0)
            model["bias"] -= 0.02 * float(error.mean())
            if paired:
                v = model["v"][used]
                pull = each[:, None] * (np.repeat(sums, sizes, axis=0) - v[where])
                dv = np.stack([np.bincount(where, pull[:, k], len(used)) for k in range(FACTORS)], axis=1) / len(mine) + DECAY * v
                gv[used] += dv * dv
                model["v"][used] = v - FACTOR_STEP * dv / np.sqrt(gv[used])
    return model


def scores(model: dict, texts: Iterator[str | None], terms: Known | None = None) -> np.ndarray:
    """Scores of texts, a bounded number of terms at a time; terms are those of the model, kept between calls."""
    terms = terms or Known(model)
    out, held, size = [], [], 0
    for x in texts:
        held.append(terms(x))
        size += len(held[-1])
        if size > 1_000_000:
            out.append(_forward(model, np.concatenate(held), np.cumsum([len(t) for t in held]))[0])
            held, size = [], 0
    if held:
        out.append(_forward(model, np.concatenate(held), np.cumsum([len(t) for t in held]))[0])
    margin = np.concatenate(out) if out else np.empty(0)
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batch's other columns and, for its last, the text, its hashed terms."""
    terms = Terms()
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            part = batch.slice(at, TEXTS)
            made = [terms(x) for x in part.column(part.num_columns - 1).to_pylist()]
            ends = pa.array(np.cumsum([0, *map(len, made)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(ends, pa.array(np.concatenate(made)))], [*part.schema.names[:-1], "terms"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> dict:
    """The machine fitted on at most ``rows`` labelled rows outside the held-out fifth.

    The sample is drawn from the ids alone (smallest hash first), so only its own texts are read into
    terms and sent to the driver. Null labels or ids are not learned from; of an id that several rows
    share, every row counts.
    """
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
    sample = usable.dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "id")
    key = F.xxhash64("id").alias("key")
    data = texts.select(key, "label", "text").mapInArrow(_hash_batches, "key long, label int, terms array<int>").toArrow()
    keys, given, terms = data.column("key").to_numpy(), data.column("label").to_numpy(), []
    for part in data.column("terms").chunks:
        values, ends = part.flatten().to_numpy().copy(), part.offsets.to_numpy() - part.offsets[0].as_py() if len(part) else np.zeros(1, np.int64)
        terms += [values[a:b] for a, b in zip(ends[:-1], ends[1:])]
    del data
    pa.default_memory_pool().release_unused()
    # the same rows in the same order, whatever the partitioning
    order = sorted(range(len(terms)), key=lambda i: (keys[i], len(terms[i]), zlib.crc32(np.ascontiguousarray(terms[i]).tobytes())))
    return fit([terms[i] for i in order], given[order].astype(np.float64))


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row of docs; only the text is looked at. A null text scores as an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Known(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores(shared.value, part.column(1).to_pylist(), terms), pa.float64())], ["id", "score"])

    kind = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, kind)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, held_out, score, predicted) for every row of docs.

    predicted is 1 from a score of 0.5 on. Ids of any type that is in both tables will do. Without usable
    labels every text scores near 0; an empty text, a null one and one without words score by the bias
    alone. Repeated rows stay repeated; equal texts score alike; an empty table gives no rows.
    """
    scored = score(docs, train(docs, labels, id_col, text_col, label_col), id_col, text_col)
    return scored.select("id", held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of docs, with its columns, that score below 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col))

    @F.arrow_udf(T.DoubleType())
    def toxic(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        terms = Known(shared.value)
        for texts in batches:
            parts = [scores(shared.value, texts.slice(at, TEXTS).to_pylist(), terms) for at in range(0, len(texts), TEXTS)]
            yield pa.array(np.concatenate([np.empty(0), *parts]))

    return docs.filter(toxic(F.col(text_col)) < 0.5)
