"""Overlap, containment and nearest joins between box tables of the same image."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.functions import geometry as g

from .lineage import cut

#: Bytes of vectors that a kNN bank may have to be sent to every worker, and its rows in one product.
BANK_BYTES, BANK_BLOCK = 32 << 20, 8192
#: Rows of the side that nearest_row looks at as a whole.
NEAREST_ROWS = 10_000
QUERY_BLOCK = 256  # query vectors a worker scores at a time


def overlap_join(left: DataFrame, right: DataFrame, key: str = "image_id", left_box: str = "box", right_box: str = "ref_box", cell: int | None = None, least: tuple[int, int] | None = None) -> DataFrame:
    """All pairs of one key whose boxes overlap, or have an IoU of ``least`` (a fraction) or more; columns of both sides, key once.

    An equality join on the key with the overlap as its residual condition. With ``cell`` each box goes to
    the grid cells it touches and pairs meet by (key, cell); a pair is kept only in the cell of the larger
    of its two low corners, so it comes once. That splits images with very many boxes; pairs that do not
    overlap have IoU 0, below every threshold in use.
    """
    both = g.iou_at_least(left_box, right_box, *least) if least else g.overlaps(left_box, right_box)
    if cell is None:
        return left.join(right, key).filter(both)

    def tiled(df: DataFrame, name: str) -> DataFrame:
        x1, y1, x2, y2 = g.parts(name)
        low_high = [(F.floor(a / cell), F.ceil(b / cell) - 1) for a, b in ((x1, x2), (y1, y2))]
        (xl, xh), (yl, yh) = low_high
        return df.withColumn("__cx", F.explode(F.sequence(xl, F.greatest(xl, xh)))).withColumn("__cy", F.explode(F.sequence(yl, F.greatest(yl, yh))))

    joined = tiled(left, left_box).join(tiled(right, right_box), [key, "__cx", "__cy"]).filter(both)
    lx, ly, _, _ = g.parts(left_box)
    rx, ry, _, _ = g.parts(right_box)
    home = (F.floor(F.greatest(lx, rx) / cell) == F.col("__cx")) & (F.floor(F.greatest(ly, ry) / cell) == F.col("__cy"))
    return joined.filter(home).drop("__cx", "__cy")


def best_overlap(left: DataFrame, right: DataFrame, left_keys: list[str], order: str, threshold: tuple[int, int] = (1, 2), key: str = "image_id", left_box: str = "box", right_box: str = "ref_box", keep: list[str] | None = None) -> DataFrame:
    """Every left row with its best overlapping right row of IoU >= threshold, else nulls.

    left_keys name a left row and hold the key. The best has the highest IoU and, of equal ones, the lowest
    order. Adds ``overlap`` and the kept columns of the right side. One outer join by the key, with the
    overlap as its residual condition; the rows of a left row are then reduced where they are.
    """
    keep = keep or []
    other = right.select(F.col(key).alias("__k"), F.col(right_box).alias("__box"), F.col(order).alias("__order"), F.struct(F.lit(True).alias("__any"), *keep).alias("__keep"))
    joined = left.join(other, (F.col(key) == F.col("__k")) & g.iou_at_least(left_box, "__box", *threshold), "left")
    score = g.iou(left_box, "__box")
    rest = [c for c in left.columns if c not in left_keys]
    best = F.max_by(F.struct(score.alias("overlap"), "__keep"), F.when(F.col("__order").isNotNull(), F.struct(score, -F.col("__order"))))
    rows = joined.groupBy(*left_keys).agg(F.first(F.struct(*rest)).alias("__left"), best.alias("__best"))
    columns = [F.col(c) if c in left_keys else F.col(f"__left.{c}") for c in left.columns]
    return rows.select(*columns, F.col("__best.overlap"), *(F.col(f"__best.__keep.{c}") for c in keep))


def containing_window(boxes: DataFrame, windows: DataFrame, box_keys: list[str], order: str, key: str = "image_id", box: str = "box", window: str = "window", keep: list[str] | None = None) -> DataFrame:
    """Every box with the window that contains it with the widest margin (first window of equal ones), else nulls."""
    keep = keep or [order]
    x1, y1, x2, y2 = g.parts(box)
    wx1, wy1, wx2, wy2 = g.parts(window)
    inside = (wx1 <= x1) & (wy1 <= y1) & (wx2 >= x2) & (wy2 >= y2)
    margin = F.least(x1 - wx1, y1 - wy1, wx2 - x2, wy2 - y2)
    pairs = boxes.select(*box_keys, box).join(windows, key).filter(inside)
    best = pairs.groupBy(*box_keys).agg(F.max_by(F.struct(margin.alias("margin"), *keep), F.struct(margin, -F.col(order))).alias("__best"))
    return boxes.join(best, box_keys, "left").withColumns({c: F.col(f"__best.{c}") for c in ("margin", *keep)}).drop("__best")


def containers(boxes: DataFrame, threshold: tuple[int, int], key: str = "image_id", pos: str = "pos", box: str = "box") -> DataFrame:
    """(key, pos, container): the first other box, by position, that is strictly larger and holds at least threshold of it."""
    a = boxes.select(key, F.col(pos).alias("pos"), F.col(box).alias("__a"))
    b = boxes.select(key, F.col(pos).alias("container"), F.col(box).alias("__b"))
    num, den = threshold
    held = F.lit(den) * g.intersection("__a", "__b") >= F.lit(num) * F.least(g.area("__a"), g.area("__b"))
    pairs = overlap_join(a, b, key, "__a", "__b").filter((F.col("pos") != F.col("container")) & (g.area("__b") > g.area("__a")) & held)
    return pairs.groupBy(key, "pos").agg(F.min("container").alias("container"))


def nearest_row(left: DataFrame, right: DataFrame, value: Column, other: Column, order: str, keep: list[str]) -> DataFrame:
    """Each left row with the right row whose value is nearest (first by order of equal ones).

    right is a small table of operating points, checked to have at most NEAREST_ROWS rows: as one array it
    meets every left row where that is, without a shuffle or a row number.
    """
    if right.limit(NEAREST_ROWS + 1).count() > NEAREST_ROWS:
        raise ValueError("too_many_points")
    points = right.agg(F.collect_list(F.struct(other.cast("double").alias("at"), F.col(order).alias("order"), F.struct(*keep).alias("keep"))).alias("__points")).filter("size(__points) > 0")
    near = F.array_min(F.transform("__points", lambda p: F.struct(F.abs(F.col("__value") - p["at"]).alias("far"), p["order"].alias("order"), p["keep"].alias("keep"))))
    rows = left.withColumn("__value", value.cast("double")).crossJoin(F.broadcast(points))  # one row
    return rows.withColumn("__near", near.getField("keep")).withColumns({c: F.col(f"__near.{c}") for c in keep}).drop("__value", "__points", "__near")


def best_columns(score: np.ndarray, k: int) -> np.ndarray:
    """The columns of each row's k highest, highest first, of equal ones the first."""
    least = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
    row, column = np.nonzero(score >= least)
    order = np.lexsort((column, -score[row, column], row))
    row, column = row[order], column[order]
    return column[np.arange(len(row)) - np.searchsorted(row, row) < k].reshape(len(score), k)


def knn_vote(queries: DataFrame, bank: DataFrame, k: int = 5, id_col: str = "id", vector_col: str = "vector", label_col: str = "label", others: bool = False) -> DataFrame:
    """(id, label, votes, similarity, runner_up): the label with most of the k nearest bank vectors.

    others leaves a query's own id out of its nearest, for a bank that holds the queries.

    Inner product of the given vectors; ties of similarity go to the smaller bank id, ties of votes to the
    higher similarity and then to the later label. Equal vectors of the bank are one, with their smallest
    ids. A bank whose vectors have at most BANK_BYTES (checked) goes to all workers; a larger one is cut into
    parts of that size, one pass each, and the passes' nearest are merged. Workers take products in blocks
    and keep the nearest so far: their memory is a part and a block. All vectors have one length.
    """
    # of equal vectors the k + 1 smallest ids are all that can be among the k nearest, one's own left out
    alike = bank.groupBy(F.col(vector_col).cast("array<double>").alias("vector")).agg(F.sort_array(F.collect_list(F.struct(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label")))).alias("held"))
    alike = cut(alike.select("vector", F.slice("held", 1, k + 1).alias("held")))
    size = alike.agg(F.sum(F.size("vector").cast("long") * 8 + 64)).first()[0] or 0
    parts = max(1, -(-size // BANK_BYTES))
    schema = f"{id_col} {queries.schema[id_col].dataType.simpleString()}, bank_id long, label string, similarity double"
    found = None
    for p in range(parts):
        mine = alike.filter(F.pmod(F.xxhash64("vector"), F.lit(parts)) == p).select("vector", "held", F.col("held")[0]["id"].alias("id")).toArrow().sort_by("id")
        if not mine.num_rows:
            continue
        vectors, held = mine["vector"].combine_chunks(), mine["held"].combine_chunks()
        ids, names = (held.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("id", "label"))
        starts = np.concatenate([[0], np.cumsum(pc.list_value_length(held).to_numpy())])
        shared = queries.sparkSession.sparkContext.broadcast((vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(mine.num_rows, -1), starts, ids, names))
        del mine, vectors, held

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            vectors, starts, ids, names = shared.value
            for batch in (whole[i : i + QUERY_BLOCK] for whole in batches for i in range(0, len(whole), QUERY_BLOCK)):
                product, own = np.stack([np.asarray(v, np.float64) for v in batch[vector_col]]), batch[id_col].to_numpy()
                # the k + 1 best vectors so far, which hold the k best ids, one's own left out; of equal ones those of smaller ids
                top, at = np.full((len(batch), k + 1), -np.inf), np.full((len(batch), k + 1), -1)
                for i in range(0, len(vectors), BANK_BLOCK):
                    score = product @ vectors[i : i + BANK_BLOCK].T
                    rows = np.flatnonzero((score > top[:, -1:]).any(axis=1))
                    some = np.argsort(-score[rows], axis=1, kind="stable")[:, : k + 1] if score.shape[1] <= 4 * (k + 1) else best_columns(score[rows], k + 1)
                    both = np.concatenate([top[rows], np.take_along_axis(score[rows], some, axis=1)], axis=1)
                    place = np.concatenate([at[rows], some + i], axis=1)
                    keep = np.argsort(-both, axis=1, kind="stable")[:, : k + 1]
                    top[rows], at[rows] = np.take_along_axis(both, keep, axis=1), np.take_along_axis(place, keep, axis=1)
                row, column = np.nonzero(at >= 0)
                v, n = at[row, column], starts[at[row, column] + 1] - starts[at[row, column]]
                entry = np.repeat(starts[v] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                row, similarity = np.repeat(row, n), np.repeat(top[row, column], n)
                fine = ids[entry] != own[row] if others else np.ones(len(row), bool)
                row, entry, similarity = row[fine], entry[fine], similarity[fine]
                order = np.lexsort((ids[entry], -similarity, row))
                row, entry, similarity = row[order], entry[order], similarity[order]
                first = np.arange(len(row)) - np.searchsorted(row, row) < k
                yield pd.DataFrame({id_col: own[row[first]], "bank_id": ids[entry[first]], "label": names[entry[first]], "similarity": similarity[first]})

        made = queries.select(id_col, vector_col).mapInPandas(run, schema)
        found = made if found is None else found.unionByName(made)
    if found is None:
        found = queries.sparkSession.createDataFrame([], schema)
    near = Window.partitionBy(id_col).orderBy(F.col("similarity").desc(), "bank_id")
    votes = found.withColumn("n", F.row_number().over(near)).filter(F.col("n") <= k).groupBy(id_col, "label").agg(F.count("*").alias("votes"), F.max("similarity").alias("similarity"))
    place = Window.partitionBy(id_col).orderBy(F.col("votes").desc(), F.col("similarity").desc(), F.col("label").desc())
    ranked = votes.withColumn("place", F.row_number().over(place)).filter("place <= 2")
    return ranked.groupBy(id_col).agg(*(F.max(F.when(F.col("place") == 1, F.col(c))).alias(c) for c in ("label", "votes", "similarity")), F.max(F.when(F.col("place") == 2, F.col("label"))).alias("runner_up"))
