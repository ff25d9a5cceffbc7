"""Language ID by words first, with backoff to ever shorter character n-grams.

A known word adds its log frequency in each language. An unseen word is scored by its longest character
n-grams; each one that no language has falls back to the n-grams one character shorter.

Words and n-grams are counted on the executors. The model holds what was seen and nothing else: a key's
languages with their counts, in arrays sorted by the key's 64-bit hash; a language that doesn't have a key
has the smoothed frequency of nothing. So every word, n-gram and language of the sample is kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .toxicity import held_out

#: Rows that the model is fitted on at most (smallest hash of the id first).
TRAIN_ROWS = 8_000
LONGEST = 4
SMOOTH = 0.5
#: Runs of letters with the marks that belong to them; digits, numerals, signs and underscores are no letters.
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Scores (words times languages) that a worker keeps; words beyond are scored again when they return.
CACHE = 1_000_000
#: Texts that are scored together.
TEXTS = 256
UNKNOWN = "und"


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def grams(word: str, n: int) -> list[str]:
    """The word's n-grams within its borders, marked by one space on each side."""
    marked = f" {word} "
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def key(text: str) -> int:
    """A signed 64-bit hash; words and n-grams of each length have tables of their own."""
    return int(np.uint64(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))).astype(np.int64))


def keys(texts: list[str]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x.encode("utf-8", "surrogatepass")) for x in texts), np.uint64, len(texts)).view(np.int64)


def build(langs: list[str], k: np.ndarray, hashed: np.ndarray, lang: np.ndarray, n: np.ndarray) -> dict:
    """A model from distinct (k, hash, language number) with their counts; k is 0 for words, else the n-gram's length."""
    tables = []
    for level in range(LONGEST + 1):
        mine = np.flatnonzero(k == level)
        mine = mine[np.lexsort((lang[mine], hashed[mine]))]
        found, start = np.unique(hashed[mine], return_index=True)
        totals = np.bincount(lang[mine], n[mine], len(langs))
        base = np.log(totals + SMOOTH * (len(found) + 1))
        tables.append({"keys": found, "start": np.append(start, len(mine)), "lang": lang[mine].astype(np.int32), "more": np.log(n[mine] + SMOOTH) - np.log(SMOOTH), "none": np.log(SMOOTH) - base})
    return {"langs": langs, "tables": tables}


def lookup(table: dict, hashed: np.ndarray) -> np.ndarray:
    """The row of each key in a table; -1 for a key that it hasn't."""
    if not len(table["keys"]):
        return np.full(len(hashed), -1)
    at = np.minimum(np.searchsorted(table["keys"], hashed), len(table["keys"]) - 1)
    return np.where(table["keys"][at] == hashed, at, -1)


def add_rows(table: dict, at: np.ndarray, owner: np.ndarray, out: np.ndarray) -> None:
    """Adds log frequencies by language of the table's rows at to the owner's rows of out."""
    sizes = table["start"][at + 1] - table["start"][at]
    each = np.repeat(table["start"][at] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
    np.add.at(out, (np.repeat(owner, sizes), table["lang"][each]), table["more"][each])
    out += np.bincount(owner, minlength=len(out))[:, None] * table["none"]


def backoff(model: dict, unseen: list[str]) -> np.ndarray:
    """Log scores by language of words that the model hasn't: the mean of their n-grams', one row a word.

    Each character run is scored by its longest n-grams; where no language has one, by those one character
    shorter that cover what is left.
    """
    total, count = np.zeros((len(unseen), len(model["langs"]))), np.zeros(len(unseen))
    marked = [f" {w} " for w in unseen]
    left = [[True] * len(m) for m in marked]
    rest = range(len(unseen))
    for k in range(LONGEST, 0, -1):
        where = [(n, i) for n in rest for i in range(len(marked[n]) - k + 1) if True in left[n][i : i + k]]
        at = lookup(model["tables"][k], keys([marked[n][i : i + k] for n, i in where]))
        hit = np.flatnonzero(at >= 0)
        owner = np.fromiter((where[h][0] for h in hit.tolist()), np.int64, len(hit))
        if len(hit):
            add_rows(model["tables"][k], at[hit], owner, total)
            count += np.bincount(owner, minlength=len(unseen))
        for h in hit.tolist():
            n, i = where[h]
            left[n][i : i + k] = [False] * k
        rest = [n for n in rest if True in left[n]]
        if not rest:
            break
    return total / np.maximum(count, 1)[:, None]


class Scorer:
    """Scores texts in one process. Rows of words met before are kept, a bounded number of them."""

    def __init__(self, model: dict) -> None:
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.index, self.rows = {}, np.empty((0, len(self.model["langs"])))

    def rows_of(self, some: list[str]) -> np.ndarray:
        """Log scores by language of distinct words, one row a word."""
        out = np.zeros((len(some), len(self.model["langs"])))
        at = lookup(self.model["tables"][0], keys(some))
        known, unseen = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        if len(known):
            mine = np.zeros((len(known), out.shape[1]))
            add_rows(self.model["tables"][0], at[known], np.arange(len(known)), mine)
            out[known] = mine
        if len(unseen):
            out[unseen] = backoff(self.model, [some[i] for i in unseen.tolist()])
        return out

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = []
        for at in range(0, len(texts), TEXTS):
            out += self._score(texts[at : at + TEXTS])
        return out

    def _score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        langs = self.model["langs"]
        counted = [Counter(words(x)) for x in texts]
        if not langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        distinct = set().union(*counted)
        fresh = sorted(w for w in distinct if w not in self.index)
        if fresh:
            if (len(self.index) + len(fresh)) * len(langs) > CACHE:
                self.reset()
                fresh = sorted(distinct)
            self.index.update((w, len(self.rows) + i) for i, w in enumerate(fresh))
            self.rows = np.concatenate((self.rows, self.rows_of(fresh)))
        index, out = self.index, []
        for counts in counted:
            if not counts:
                out.append((UNKNOWN, 0.0))
                continue
            total = np.fromiter(counts.values(), np.float64, len(counts)) @ self.rows[[index[w] for w in counts]]
            best = int(total.argmax())
            out.append((langs[best], float(1 / np.exp(np.maximum(total - total[best], -700)).sum())))
        return out


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counted: Counter = Counter()
        for lang, text in zip(batch["lang"], batch["text"]):
            counted.update((lang, w) for w in words(text))
        yield pd.DataFrame([(x, w, n) for (x, w), n in counted.items()], columns=["lang", "word", "n"])


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, k, hash, n) of the words (k = 0) and all their n-grams, summed within a batch."""
    for batch in batches:
        counted: Counter = Counter()
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            counted[lang, 0, key(word)] += n
            for k in range(1, LONGEST + 1):
                for g in grams(word, k):
                    counted[lang, k, key(g)] += n
        rows = list(counted)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array(list(counted.values()), pa.int64())], ["lang", "k", "hash", "n"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> dict:
    """The model of at most ``rows`` ids that have a language and are outside the held-out fifth.

    The ids of the sample are chosen first, so that only its texts are read again. Of an id that several
    rows share, each row with a language counts. Words are counted first, then the n-grams of distinct
    words; what reaches the driver are sums by language and key, as arrays.
    """
    usable = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id")))
    sample = usable.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = usable.join(F.broadcast(sample), "id")
    counted = texts.mapInPandas(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    seen = counted.mapInArrow(_count_grams, "lang string, k int, hash long, n long").groupBy("lang", "k", "hash").agg(F.sum("n").alias("n")).toArrow()
    lang = seen.column("lang").combine_chunks().dictionary_encode()
    names = lang.dictionary.to_pylist() if seen.num_rows else []
    langs = sorted(names)
    place = np.array([langs.index(x) for x in names] or [0], np.int64)
    at = place[lang.indices.to_numpy(zero_copy_only=False)] if seen.num_rows else np.empty(0, np.int64)
    return build(langs, *(x.astype(np.int64) for x in (seen.column("k").to_numpy(), seen.column("hash").to_numpy(), at, seen.column("n").to_numpy())))


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row of docs; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for part in (batch.slice(at, TEXTS) for batch in batches for at in range(0, batch.num_rows, TEXTS)):
            made = scorer(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], ["id", "lang_pred", "score"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score) for every row of docs.

    score is the share of the best language among all, from 0 to 1. A null text, or one without a letter
    (digits, numerals such as a half or a Roman twelve, and lone marks are none), is ``und`` with score 0,
    as is every text where no language could be learned. Ties go to the first language by code point.
    Repeated rows stay repeated; an empty table gives no rows.
    """
    found = predict(docs, train(docs, id_col, text_col, lang_col), id_col, text_col)
    return found.select("id", held_out(F.col("id")).alias("held_out"), "lang_pred", "score")
