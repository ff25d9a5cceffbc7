"""Review order, vote rules, samples and label policies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.functions import geometry as g

from .accept import DIMENSIONS
from .lineage import cut


def unresolved(dimensions: tuple[str, ...] = DIMENSIONS) -> Column:
    """How many of the five dimensions are not supported; an absent one counts."""
    return sum((F.when(F.coalesce(F.col(d), F.lit("")) != "supported", 1).otherwise(0) for d in dimensions), F.lit(0))


def difficulty() -> list[Column]:
    """Sort keys, worst first: most unresolved, then unconfirmed (or unknown), then small overlap, score and area."""
    return [F.col("unresolved").desc(), F.when(F.col("verified"), 1).otherwise(0), F.coalesce("verifier_overlap", F.lit(-1.0)), F.coalesce("score", F.lit(-1.0)), g.area("box")]


def queue(objects: DataFrame, by: list[str], limit: int | None = None, pooled: bool = False) -> DataFrame:
    """objects with rank from 1: within each group of ``by``, or over all groups (pooled).

    objects have pos, box, unresolved, verified, verifier_overlap and score; by and pos name a row. limit 0
    or None keeps all.
    """
    if pooled:
        ranked = global_rank(objects, [*difficulty(), *map(F.col, by), F.col("pos")], "rank")
    else:
        ranked = objects.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*difficulty(), "pos")))
    return ranked.filter(F.col("rank") <= limit) if limit else ranked


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with its place in a total order, without a task that sees all rows.

    Rows are partitioned by range and numbered inside their partition; the number of rows before a
    partition comes from one count a partition. The partitioning is written down, so every use agrees.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    placed = ranged.withColumn("__in", inside).join(sizes.select("__part", before.alias("__before")), "__part")
    return placed.withColumn(name, F.col("__before") + F.col("__in")).drop("__part", "__in", "__before")


def global_sum(df: DataFrame, by: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    """df with the running sum of value in a total order within each group of by, without a task that sees a whole group.

    Rows are partitioned by range and summed inside their partition; what comes before a partition is added
    from one sum a group and partition.
    """
    ranged = cut(df.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()))
    sums = ranged.groupBy(*by, "__part").agg(F.sum(value).alias("__n"))
    earlier = Window.partitionBy(*by, F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("__part").alias("__at"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = F.sum(value).over(Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    same = F.col("__part") == F.col("__at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return ranged.withColumn("__in", inside).join(before, same).withColumn(name, F.col("__before") + F.col("__in")).select(*df.columns, name)


def budget_curve(ranked: DataFrame, kind: str, budgets: list[int]) -> DataFrame:
    """(budget, kind, n): rows of each kind within the first ranks."""
    at = ranked.withColumn("budget", F.explode(F.array(*map(F.lit, budgets)))).filter(F.col("rank") <= F.col("budget"))
    return at.groupBy("budget", F.col(kind).alias("kind")).agg(F.count("*").alias("n"))


def vote_rules(votes: DataFrame, keys: list[str], vote: str = "vote") -> DataFrame:
    """(keys, any_agrees, all_agree, voters) from one row a voter; a null vote is a no."""
    v = F.coalesce(F.col(vote), F.lit(False))
    return votes.groupBy(*keys).agg(F.bool_or(v).alias("any_agrees"), F.bool_and(v).alias("all_agree"), F.count("*").alias("voters"))


def difference(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change): recovered (only after) and lost (only before)."""
    gained = after.select(*keys).distinct().join(before.select(*keys), keys, "left_anti").withColumn("change", F.lit("recovered"))
    return gained.unionByName(before.select(*keys).distinct().join(after.select(*keys), keys, "left_anti").withColumn("change", F.lit("lost")))


def seeded_order(seed: int, *keys: str) -> Column:
    """A place in a seeded shuffle that depends on the keys alone (and that any SQL engine can compute)."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def stratified_sample(population: DataFrame, size: int, strata: list[str], keys: list[str], seed: int = 0) -> DataFrame:
    """About size rows: max(1, round half even of the stratum's share) of each stratum, then a seeded trim to size.

    Quotas come from counts of the strata; rows are ranked within their stratum by a seeded hash. Strata may
    be small or hot: only rows whose hash is below a bound are ranked, which is counted to leave each its quota;
    if it does not, all are.
    """
    if size <= 0:
        raise ValueError("invalid_sample_size")
    counts = cut(population.groupBy(*strata).agg(F.count("*").alias("__n")))
    total = counts.agg(F.sum("__n")).first()[0] or 0
    if total <= size:
        return population
    quota = F.greatest(F.lit(1), F.rint(F.lit(float(size)) * F.col("__n") / F.lit(float(total))))
    quotas = counts.select(*strata, "__n", quota.alias("__quota"))
    hashed = population.withColumn("__at", seeded_order(seed, *keys)).join(quotas, strata)
    # of a stratum's hashes, which are spread evenly, those below this bound are its quota at least, all but surely
    share = F.least(F.lit(1.0), (F.col("__quota") + 6 * F.sqrt("__quota") + 20) / F.col("__n"))
    bound = F.when(share < 1, F.lower(F.lpad(F.hex((share * float(1 << 32)).cast("long")), 8, "0"))).otherwise("g")
    low = cut(hashed.filter(F.col("__at") < bound))
    short = quotas.join(low.groupBy(*strata).agg(F.count("*").alias("__low")), strata, "left").filter(F.coalesce("__low", F.lit(0)) < F.least("__quota", "__n"))
    known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in strata))  # the join leaves out null strata, as SQL's does
    rows = low if short.filter(known).isEmpty() else hashed
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*strata).orderBy("__at", *keys)))
    # no quota is above size: as a literal it lets each task keep only the first rows of a stratum
    taken = ranked.filter(F.col("__rank") <= size).filter(F.col("__rank") <= F.col("__quota")).drop("__n", "__quota", "__rank")
    return taken.orderBy(F.md5(F.concat(F.lit("trim|"), "__at")), *keys).limit(size).select(*population.columns)


def capped_bank(rows: DataFrame, label: str, keys: list[str], per_class: int, excluded: DataFrame | None = None, on: str = "sequence", least_side: float = 0.0, box: str | None = None, seed: int = 0) -> DataFrame:
    """At most per_class rows of each class in seeded order, none of an excluded sequence, none smaller than least_side."""
    kept = rows.join(excluded.select(on).distinct(), on, "left_anti") if excluded is not None else rows
    if box and least_side:
        x1, y1, x2, y2 = g.parts(box)
        kept = kept.filter(F.least(x2 - x1, y2 - y1) >= least_side)
    place = F.row_number().over(Window.partitionBy(label).orderBy(seeded_order(seed, *keys), *keys))
    return kept.withColumn("__rank", place).filter(F.col("__rank") <= per_class).drop("__rank")


def arm_label(label: str, mapping: dict[str, int], policy: str, parent: str = "vehicle", modal: str = "car", verifier: str = "verifier_label", retrieved: str = "retrieved") -> Column:
    """struct(class, reason): the export class of an object, or null and why it is dropped.

    A mapped label is its class. Of the others only the parent label falls back, by a policy: 'drop' drops
    it, 'modal' takes the class of the modal label, 'retrieval' and 'verifier_label' that of the retrieved
    or the verifier's label if it is mapped. Any other label is unmapped.
    """
    table = F.create_map(*(F.lit(x) for kv in sorted(mapping.items()) for x in kv))
    own, falls = F.element_at(table, F.col(label)), F.col(label) == parent
    other = {"drop": F.lit(None), "modal": F.lit(mapping[modal]) if policy == "modal" else None, "retrieval": F.element_at(table, F.col(retrieved)), "verifier_label": F.element_at(table, F.col(verifier))}[policy].cast("int")
    gone = {"drop": "parent_fallback_dropped", "modal": None, "retrieval": "parent_fallback_unresolved_by_retrieval", "verifier_label": "parent_fallback_unresolved_by_verifier"}[policy]
    unmapped = F.concat(F.lit("unmapped_class:"), F.coalesce(F.col(label), F.lit("")))
    found = F.when(own.isNotNull(), own).when(falls, other)
    return F.struct(found.alias("class"), F.when(found.isNotNull(), F.lit(None).cast("string")).when(falls, F.lit(gone)).otherwise(unmapped).alias("reason"))


def classify(boxes: DataFrame, taken: DataFrame, keys: list[str]) -> DataFrame:
    """boxes with match_kind: tight, loose or unmatched; taken has the keys and matching (tight or loose) of what each matching took."""
    held = taken.groupBy(*keys).agg(F.bool_or(F.col("matching") == "tight").alias("__t"))
    joined = boxes.join(held, keys, "left")
    return joined.withColumn("match_kind", F.when(F.col("__t"), "tight").when(F.col("__t").isNotNull(), "loose").otherwise("unmatched")).drop("__t")
