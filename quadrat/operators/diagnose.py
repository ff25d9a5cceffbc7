"""Why references were missed, what geometry was available, and how scores separate matched boxes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.functions import geometry as g
from quadrat.functions.stats import ratio

from .assignment import assign_edges, match, ordered_edges
from .lineage import cut
from .review import global_rank, global_sum
from .runs import by_runs
from .spatial import overlap_join

#: The miss buckets, in the order in which they are tested.
BUCKETS = ("merged_with_neighbour", "localized_below_match", "below_threshold", "merged_away", "retained_unmatched", "never_proposed")
MATCH, NEAR = (1, 2), (3, 10)
#: Thresholds that a sweep may broadcast, a number each.
MOST_THRESHOLDS = 10_000


def _missed(references: DataFrame, retained: DataFrame, pairs: DataFrame) -> DataFrame:
    """References (image_id, ref, ref_box) that no retained box is matched to."""
    close = pairs.filter(g.iou_at_least("box", "ref_box", *MATCH)).select("image_id", "pos", "ref", g.iou("box", "ref_box").alias("iou"))
    hit = match(close, ["image_id"], "pos", "ref").select("image_id", "ref")
    return references.join(hit, ["image_id", "ref"], "left_anti")


def attribute_misses(references: DataFrame, retained: DataFrame, probe: DataFrame, threshold: float) -> DataFrame:
    """(image_id, ref, bucket, size_bin, best_retained, best_probe) for every unmatched reference.

    retained has image_id, pos, box; probe also score and disposition. Evidence of retained boxes
    outranks that of the probe; each reference is one partial aggregate over its overlaps.
    """
    refs = references.select("image_id", "ref", "ref_box")
    near = overlap_join(retained.select("image_id", "pos", "box"), refs)
    seen = overlap_join(probe.select("image_id", "box", "score", "disposition"), refs)
    missed = _missed(refs, retained, near)
    best = near.groupBy("image_id", "ref").agg(F.max(g.iou("box", "ref_box")).alias("best_retained"), F.bool_or(g.iou_at_least("box", "ref_box", *MATCH)).alias("r50"), F.bool_or(g.iou_at_least("box", "ref_box", *NEAR)).alias("r30"))
    reached, above = g.iou_at_least("box", "ref_box", *MATCH), F.col("score") >= threshold
    column = seen.groupBy("image_id", "ref").agg(
        F.max(g.iou("box", "ref_box")).alias("best_probe"),
        F.count_if(reached).alias("reached"),
        F.count_if(reached & above).alias("above"),
        F.count_if(reached & above & (F.col("disposition") == "merged")).alias("merged"),
        F.bool_or(g.iou_at_least("box", "ref_box", *NEAR)).alias("p30"),
    )
    joined = missed.join(best, ["image_id", "ref"], "left").join(column, ["image_id", "ref"], "left").fillna(0, ["reached", "above", "merged"]).fillna(False, ["r50", "r30", "p30"]).fillna(0.0, ["best_retained", "best_probe"])
    bucket = (
        F.when(F.col("r50"), BUCKETS[0])
        .when(F.col("r30"), BUCKETS[1])
        .when((F.col("reached") > 0) & (F.col("above") == 0), BUCKETS[2])
        .when(F.col("merged") > 0, BUCKETS[3])
        .when(F.col("above") > 0, BUCKETS[4])
        .when(F.col("p30"), BUCKETS[1])
        .otherwise(BUCKETS[5])
    )
    return joined.select("image_id", "ref", bucket.alias("bucket"), g.size_bin("ref_box").alias("size_bin"), "best_retained", "best_probe")


def headroom(references: DataFrame, retained: DataFrame, probe: DataFrame) -> DataFrame:
    """(image_id, ref, size_bin, best, verdict, score, job, disposition): what any observation reached for each missed reference.

    Attributes are those of the first observation (by pos) of the highest IoU; null where nothing overlaps.
    """
    refs = references.select("image_id", "ref", "ref_box")
    missed = _missed(refs, retained, overlap_join(retained.select("image_id", "pos", "box"), refs))
    seen = overlap_join(probe.select("image_id", "pos", "box", "score", "job", "disposition"), refs)
    value = g.iou("box", "ref_box")
    best = seen.groupBy("image_id", "ref").agg(F.max_by(F.struct(value.alias("best"), g.iou_at_least("box", "ref_box", *MATCH).alias("b50"), g.iou_at_least("box", "ref_box", *NEAR).alias("b30"), "score", "job", "disposition"), F.struct(value, -F.col("pos"))).alias("o"))
    joined = missed.join(best, ["image_id", "ref"], "left")
    verdict = F.when(F.col("o.b50"), "recoverable_by_selection").when(F.col("o.b30"), "needs_new_geometry").otherwise("not_localized")
    return joined.select("image_id", "ref", g.size_bin("ref_box").alias("size_bin"), F.coalesce("o.best", F.lit(0.0)).alias("best"), verdict.alias("verdict"), "o.score", "o.job", "o.disposition")


def separability(references: DataFrame, records: DataFrame) -> DataFrame:
    """(image_id, ref, case, higher_score, more_magnified, untruncated_over_truncated) for missed references that some record reaches.

    records have image_id, pos, id, box, score, level, view_edge, disposition and merged_into. The best
    clearing record is compared with the representative that took its place.
    """
    refs = references.select("image_id", "ref", "ref_box")
    retained = records.filter("disposition = 'retained'").select("image_id", "pos", "box")
    missed = _missed(refs, retained, overlap_join(retained, refs))
    value = g.iou("box", "ref_box")
    mine = ["score", "level", "view_edge", "disposition", "merged_into"]
    clearing = overlap_join(records.select("image_id", "pos", "box", *mine), missed).filter(g.iou_at_least("box", "ref_box", *MATCH))
    best = clearing.groupBy("image_id", "ref").agg(F.max_by(F.struct(*mine), F.struct(value, -F.col("pos"))).alias("b"))
    lead = records.select("image_id", F.col("id").alias("lead_id"), *(F.col(c).alias(f"lead_{c}") for c in ("score", "level", "view_edge")))
    wanted = F.when(F.col("b.disposition") == "merged", F.col("b.merged_into"))
    joined = best.withColumn("lead_id", wanted).join(lead, ["image_id", "lead_id"], "left")
    found = F.col("lead_score").isNotNull()
    return joined.select(
        "image_id",
        "ref",
        F.when(found, "representative_selection").otherwise("assignment_contention").alias("case"),
        F.when(found, F.col("b.score") > F.col("lead_score")).alias("higher_score"),
        F.when(found, F.col("b.level") > F.col("lead_level")).alias("more_magnified"),
        F.when(found, ~F.col("b.view_edge") & F.col("lead_view_edge")).alias("untruncated_over_truncated"),
    )


def score_quantiles(retained: DataFrame, points: int = 20, score: str = "score") -> DataFrame:
    """(threshold): distinct linear quantiles of the score at evenly spaced shares; null scores are left out.

    Scores are sorted by range and the few rows at the wanted places are picked: no task sees them all.
    """
    scores = retained.select(F.col(score).cast("double").alias("s")).filter("s is not null")
    ranked = global_rank(scores, [F.col("s")], "at").select("at", "s")
    n = ranked.count()
    places = [(n - 1) * (i / (points - 1)) for i in range(points)] if n else []
    wanted = sorted({f(x) + 1 for x in places for f in (math.floor, math.ceil)})
    found = {r["at"]: r.s for r in ranked.filter(F.col("at").isin(wanted)).collect()}  # two rows a point at most
    ends = [(x, math.floor(x), math.ceil(x)) for x in places]
    made = {found[low + 1] if low == high else (high - x) * found[low + 1] + (x - low) * found[high + 1] for x, low, high in ends}
    return retained.sparkSession.createDataFrame([(x,) for x in sorted(made)], "threshold double")


def selectivity(retained: DataFrame, references: DataFrame, thresholds: DataFrame, score: str = "score") -> DataFrame:
    """One row a threshold: kept, removed, matched_kept, removal rates of matched and unmatched boxes, selectivity, recall, precision.

    The matching is solved anew over the survivors of each threshold. thresholds is a short table, checked
    to have at most MOST_THRESHOLDS rows; an overlapping pair meets only the thresholds at or below its score.
    """
    if thresholds.limit(MOST_THRESHOLDS + 1).count() > MOST_THRESHOLDS:
        raise ValueError("too_many_thresholds")
    refs = references.select("image_id", "ref", "ref_box")
    boxes = retained.select("image_id", "pos", "box", F.col(score).alias("score"))
    close = overlap_join(boxes, refs, least=MATCH).select("image_id", "pos", "ref", "score", g.iou("box", "ref_box").alias("iou"))
    # a pair goes to Python once, for all thresholds; the matching of all boxes rides along as a threshold of its own, null
    at = sorted({r[0] for r in thresholds.select(F.col("threshold").cast("double")).distinct().collect() if r[0] is not None})

    def taken(frame: pd.DataFrame) -> pd.DataFrame:
        order, *sides = ordered_edges(frame, ["image_id"], "pos", "ref")
        iou, s = (frame[c].to_numpy(np.float64)[order] for c in ("iou", "score"))
        count = lambda mask: int(assign_edges(*(x[mask] for x in sides), iou[mask]).sum())
        rows, left, last = [(None, count(np.ones(len(s), bool)))], None, 0
        for t in at:
            mask = s >= t
            if (n := int(mask.sum())) != left:  # sets of rising thresholds are nested: as many are the same
                left, last = n, count(mask)
            rows.append((t, last))
        return pd.DataFrame(rows, columns=["threshold", "n"])

    scores = F.when(F.isnan("score"), float("inf")).otherwise(F.col("score").cast("double"))
    found = by_runs(close.withColumn("score", scores), ["image_id"], taken, "threshold double, n long").groupBy("threshold").agg(F.sum("n").alias("matched_kept"))
    found = cut(found)  # used twice, a row a threshold
    matched, whole = found.filter("threshold is not null"), found.filter("threshold is null").select(F.col("matched_kept").alias("matched_total"))
    kept = boxes.join(F.broadcast(thresholds), F.col("score") >= F.col("threshold")).groupBy("threshold").agg(F.count("*").alias("kept"))
    sizes = boxes.agg(F.count("*").alias("total")).join(refs.agg(F.count("*").alias("n_refs"))).join(whole, how="left").fillna(0)
    rows = thresholds.join(kept, "threshold", "left").join(matched, "threshold", "left").fillna(0).join(F.broadcast(sizes))
    gone, unmatched = F.col("matched_total") - F.col("matched_kept"), F.col("total") - F.col("matched_total")
    rows = rows.withColumns({"removed": F.col("total") - F.col("kept"), "matched_removed": gone})
    rows = rows.withColumn("unmatched_removed", F.col("removed") - F.col("matched_removed"))
    rows = rows.withColumns({"matched_removed_rate": ratio("matched_removed", "matched_total"), "unmatched_removed_rate": ratio(F.col("unmatched_removed"), unmatched)})
    return rows.select("threshold", "kept", "removed", "matched_kept", "matched_removed", "unmatched_removed", "matched_removed_rate", "unmatched_removed_rate", (F.col("unmatched_removed_rate") - F.col("matched_removed_rate")).alias("selectivity"), ratio("matched_kept", "n_refs").alias("recall"), ratio("matched_kept", "kept").alias("precision"))


def highest_threshold(rows: DataFrame, targets: list[float], score: str = "score", known: str = "known", least: float = 0.3, by: list[str] | None = None) -> DataFrame:
    """(by..., target, threshold): the highest recorded score at which the share of known positives kept is still >= target.

    rows have a nullable score and whether the row is a known positive. At least ``least``; null without
    positives. Distinct scores are counted before they are summed, and summed by range.
    """
    by = by or []
    every = cut(rows.filter(known).groupBy(*by, F.col(score).alias("s")).agg(F.count("*").alias("n")))  # rows are looked at once
    total, counts = every.groupBy(*by).agg(F.sum("n").alias("positives")), every.filter("s is not null")
    run = global_sum(counts, by, [F.col("s").desc()], "n", "kept")
    aims = F.array(*map(F.lit, targets))
    joined = run.join(total, by) if by else run.join(total)
    ok = joined.select(*by, "s", "kept", "positives", F.explode(aims).alias("target")).filter(F.col("kept") >= F.col("target") * F.col("positives"))
    best = ok.groupBy(*by, "target").agg(F.greatest(F.max("s"), F.lit(least)).alias("threshold"))
    wanted = total.filter("positives > 0").select(*by, F.explode(aims).alias("target"))
    return wanted.join(best, [*by, "target"], "left").withColumn("threshold", F.coalesce("threshold", F.lit(least)))


def sweep(rows: DataFrame, thresholds: list, test: Column, aggregates: list[Column], name: str = "threshold") -> DataFrame:
    """aggregates over the rows that pass ``test`` (which may use ``name``) for each threshold."""
    at = rows.withColumn(name, F.explode(F.array(*map(F.lit, thresholds))))
    return at.filter(test).groupBy(name).agg(*aggregates)
