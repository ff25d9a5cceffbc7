"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a seeded shuffle and pass twice at most. A pass of a document gets a
virtual finish time: its source's cumulative words divided by the source's target. All passes are taken
in the order of that time until the next one would go over the total budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WEIGHTS = (5, 2, 1)
SHARE = (3, 2)  # the budget: 150% of all words
PASSES = 2
SEED = "mix-1"
KEY_BITS = 40
#: Documents of one source in a window, about; and the buckets of them whose sums a window of the next level sees, in bits.
BUCKET_ROWS, LEVEL_BITS = 256, 12
#: Passes that are sorted together where the budget ends, unless they all tie.
EDGE_ROWS = 50_000
RANGES = 4096


def word_count(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    runs = F.split(text, "[ \t-\r]+")
    edges = F.when(F.get(runs, F.lit(0)) == "", 1).otherwise(0) + F.when(F.element_at(runs, -1) == "", 1).otherwise(0)
    return F.coalesce(F.greatest(F.size(runs) - edges, F.lit(0)), F.lit(0)).cast("long")


def targets(totals: DataFrame) -> DataFrame:
    """(source, source_size, place, target) from (source, source_size), one row a source.

    Sources by code point, null last, weigh 5, 2, 1, repeating. A source is full when its share reaches
    PASSES times its size. Sources fill up in the order of size by weight, so the final level is the
    first one, in that order, that the next source can hold: no loop is needed. These windows see one row
    a source, never documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    ranked = totals.withColumn("place", F.row_number().over(by_name))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.col("place") - 1, F.lit(len(WEIGHTS))) + 1))
    ratio = F.col("most") / F.col("weight")
    order = Window.orderBy(ratio, "place")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.col("budget") - F.coalesce(F.sum("most").over(so_far), F.lit(0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(so_far), F.lit(0))
    levels = (
        ranked.withColumn("most", F.lit(PASSES) * F.col("source_size"))
        .withColumn("budget", F.sum("source_size").over(every) * SHARE[0] / SHARE[1])
        .withColumn("level", rest / open_weight)
        .withColumn("fits", F.col("level") <= ratio)
        .withColumn("final", F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(every))
        .withColumn("open", F.max("fits").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    )
    return levels.select("source", "source_size", "place", F.when(F.col("open"), F.col("weight") * F.col("final")).otherwise(F.col("most").cast("double")).alias("target"))


def shuffle_key(name: Column) -> Column:
    """A seeded 40-bit place in the shuffle that any SQL engine can compute."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), name)), 1, KEY_BITS // 4), 16, 10).cast("long")


def _place(run: DataFrame, n: int) -> Column:
    """Where pass n of a row stands in the order of all passes."""
    finish = (F.lit(n) * F.col("source_size") + F.col("run")) / F.col("target")
    return F.struct(finish.alias("finish"), "place", "key", "name", "size", F.lit(n).alias("pass"))


def _cutoff(run: DataFrame, budget: float) -> tuple | None:
    """The first pass, in order, that would go over the budget; None if all fit.

    Sums over ranges of virtual time (a bounded number, pre-aggregated) find the range in which the budget
    ends; it is cut into ranges again until few enough passes are left to sort.
    """
    passes = run.filter("target > 0").select("words", F.explode(F.array(*(_place(run, n) for n in range(PASSES)))).alias("at"))
    low, high, spent = passes.agg(F.min("at.finish"), F.max("at.finish")).first() + (0,)
    if low is None:
        return None
    while True:
        width = (high - low) / RANGES
        inside = passes.filter(F.col("at.finish").between(low, high))
        part = F.least(F.floor((F.col("at.finish") - low) / width), F.lit(RANGES - 1)) if width > 0 else F.lit(0)
        found = inside.groupBy(part.alias("part")).agg(F.sum("words").alias("words"), F.count("*").alias("n"), F.min("at.finish").alias("low"), F.max("at.finish").alias("high")).orderBy("part").collect()
        for r in found:
            if spent + r.words > budget:
                break
            spent += r.words
        else:
            return None
        low, high = r.low, r.high
        if r.n <= EDGE_ROWS or r.low == r.high:
            break
    order = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    edge = passes.filter(F.col("at.finish").between(low, high)).withColumn("spent", F.sum("words").over(order) + F.lit(spent))
    return edge.filter(F.col("spent") > budget).agg(F.min("at")).first()[0]


def _offsets(sums: DataFrame, bits: int) -> DataFrame:
    """(place, bucket, offset): the sum of all buckets of a place before this one, numbered in so many bits.

    Buckets are summed in groups of 2**LEVEL_BITS neighbours, those in groups of groups, and so on, so that
    no window sees more rows than a group has.
    """
    up = F.shiftright("bucket", LEVEL_BITS)
    before = F.sum("all").over(Window.partitionBy("place", up).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("all")
    if bits <= LEVEL_BITS:
        return sums.select("place", "bucket", before.alias("offset"))
    above = _offsets(sums.groupBy("place", up.alias("bucket")).agg(F.sum("all").alias("all")), bits - LEVEL_BITS)
    here = sums.select("place", "bucket", up.alias("up"), before.alias("own"))
    return here.join(above.withColumnRenamed("bucket", "up"), ["place", "up"]).select("place", "bucket", (F.col("own") + F.col("offset")).alias("offset"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(id, source, size, n, source_size, target, copies): one row for each distinct (id, source, size).

    n rows of docs share it and are decided together; copies is how often the mix takes each, 0 to
    PASSES. Documents of one source stand in buckets of the shuffle key and only pre-aggregated sums of
    buckets meet, so no source gathers in one task. Ties go by source, key, id as text, size and pass;
    passes that tie with the one that would go over the budget stay out. A null source is a source; a
    null id is the text 'null' in the shuffle; a source without words takes nothing; an empty table gives
    no rows.
    """
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    entries = cut(sized.groupBy("id", "source", "size").agg(F.count("*").alias("n")))
    totals = entries.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("entries"))
    goal = cut(targets(totals).join(totals.select(F.col("source").alias("s"), "entries"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumnRenamed("source", "s"))
    most, total, sources = goal.agg(F.max("entries"), F.sum("source_size"), F.count("*")).first()
    side = F.broadcast(goal) if sources <= 100_000 else goal  # a name and four numbers for each of so many
    bits = min(KEY_BITS - 1, ((most or 0) // bucket_rows).bit_length())
    name = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    queued = entries.join(side, F.col("source").eqNullSafe(F.col("s"))).drop("s", "entries")
    queued = queued.withColumn("name", name).withColumn("key", shuffle_key(name)).withColumn("words", F.col("size") * F.col("n")).withColumn("bucket", F.shiftright("key", KEY_BITS - bits))
    offsets = _offsets(queued.groupBy("place", "bucket").agg(F.sum("words").alias("all")), bits)
    inside = Window.partitionBy("place", "bucket").orderBy("key", "name", "size").rowsBetween(Window.unboundedPreceding, 0)
    run = queued.withColumn("run", F.sum("words").over(inside)).join(offsets, ["place", "bucket"])
    run = cut(run.withColumn("run", F.col("run") + F.col("offset")).drop("offset", "bucket"))
    last = _cutoff(run, (total or 0) * SHARE[0] / SHARE[1])
    taken = F.lit(0)
    for n in range(PASSES):
        early = F.lit(1) if last is None else F.when(_place(run, n) < F.struct(*(F.lit(v).cast(t) for v, t in zip(last, ("double", "int", "long", "string", "long", "int")))), 1).otherwise(0)
        taken = taken + F.when(F.col("target") > 0, early).otherwise(0)
    return run.select("id", "source", "size", "n", "source_size", "target", taken.alias("copies"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: docs' rows and columns, each row as often as the mix takes it."""
    made = plan(docs, id_col, text_col, source_col).filter("copies > 0").select(F.col("id").alias("__mix_id"), F.col("source").alias("__mix_source"), F.col("size").alias("__mix_size"), F.col("copies").alias("__mix_copies"))
    same = docs[id_col].eqNullSafe(F.col("__mix_id")) & docs[source_col].eqNullSafe(F.col("__mix_source")) & (word_count(docs[text_col]) == F.col("__mix_size"))
    return docs.join(made, same).withColumn("__mix_copies", F.explode(F.sequence(F.lit(1), "__mix_copies"))).select(*docs.columns)
