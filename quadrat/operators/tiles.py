"""Tile and window plans as generated rows, and exact coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.functions import geometry as g


def grid_shape(width, height, level) -> tuple[Column, Column]:
    """(columns, rows) that keep tiles as square as the image allows for a budget of (level + 1) squared."""
    w, h, n = (g._col(x).cast("double") for x in (width, height, level))
    budget, aspect = (n + 1) * (n + 1), w / h
    one = F.lit(1).cast("bigint")
    return F.greatest(one, g.round_half_up(F.sqrt(budget * aspect))), F.greatest(one, g.round_half_up(F.sqrt(budget / aspect)))


def tile_span(total, count, overlap: float) -> Column:
    """Length of count evenly spaced tiles that cover total and share overlap of their length."""
    total, count = g._col(total), g._col(count)
    return F.when(count <= 1, total.cast("bigint")).otherwise(F.least(total.cast("bigint"), F.ceil(total / (F.lit(1.0) + (count - 1) * F.lit(1.0 - overlap)))))


def origins(total, size, count) -> Column:
    """Evenly spaced origins, the last flush with the far edge, rounded half to even, without repeats."""
    total, size, count = g._col(total), g._col(size), g._col(count)
    step = (total - size) / (count - 1)
    spread = F.array_distinct(F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(count - 1, F.lit(0).cast("bigint"))), lambda i: F.rint(i * step).cast("bigint")))
    return F.when((count <= 1) | (size >= total), F.array(F.lit(0).cast("bigint"))).otherwise(spread)


def plan_tiles(images: DataFrame, levels: int = 1, overlap: float = 0.25, width: str = "width", height: str = "height") -> DataFrame:
    """images' columns with job, level and job_box: the whole frame, then each level's tiles row by row."""
    if levels < 0 or not 0 <= overlap < 1:
        raise ValueError("invalid_tile_plan")
    own = images.columns
    full = images.select(*own, F.lit("full").alias("job"), F.lit(0).alias("level"), g.box(F.lit(0.0), F.lit(0.0), F.col(width).cast("double"), F.col(height).cast("double")).alias("job_box"))
    if not levels:
        return full
    at = images.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(levels))))
    columns, rows = grid_shape(width, height, "level")
    at = at.withColumn("__c", columns).withColumn("__r", rows)
    at = at.withColumn("__w", tile_span(width, "__c", overlap)).withColumn("__h", tile_span(height, "__r", overlap))
    at = at.select("*", F.posexplode(origins(height, "__h", "__r")).alias("__row", "__y"))
    at = at.select("*", F.posexplode(origins(width, "__w", "__c")).alias("__col", "__x"))
    box = g.box(*((F.col(a) + (F.col(b) if b else 0)).cast("double") for a, b in (("__x", None), ("__y", None), ("__x", "__w"), ("__y", "__h"))))
    tiles = at.select(*own, F.format_string("L%d-r%dc%d", F.col("level"), F.col("__row"), F.col("__col")).alias("job"), "level", box.alias("job_box"))
    return full.unionByName(tiles)


def plan_windows(images: DataFrame, side: int, overlap: float = 0.5, width: str = "width", height: str = "height") -> DataFrame:
    """images' columns with job (r{row}c{col}), pos and window: fixed squares, clamped to the far edge."""
    step = max(1, int(side * (1 - overlap)))

    def starts(total: str) -> Column:
        last = F.greatest(F.lit(0), F.col(total) - side).cast("bigint")
        return F.array_distinct(F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col(total).cast("bigint") - 1, F.lit(0).cast("bigint")), F.lit(step).cast("bigint")), lambda s: F.least(s, last)))

    at = images.select("*", starts(width).alias("__xs"), F.posexplode(starts(height)).alias("__row", "__y"))
    at = at.select("*", F.posexplode("__xs").alias("__col", "__x"))
    box = g.box("__x", "__y", F.least(F.col("__x") + side, F.col(width).cast("bigint")), F.least(F.col("__y") + side, F.col(height).cast("bigint")))
    return at.select(*images.columns, F.format_string("r%dc%d", F.col("__row"), F.col("__col")).alias("job"), (F.col("__row") * F.size("__xs") + F.col("__col")).alias("pos"), box.alias("window"))


def covered(jobs: DataFrame, keys: list[str], box: str = "job_box") -> DataFrame:
    """keys and the exact area of the union of each group's boxes, rounded half to even to whole pixels.

    Coordinates are compressed: the distinct edges of a group cut the plane into strips; in each vertical
    strip the covering intervals are merged by a running maximum. Nothing is rasterised.
    """
    x1, y1, x2, y2 = (F.rint(e).cast("bigint") for e in g.parts(box))
    whole = jobs.select(*keys, x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")).filter("x1 < x2 and y1 < y2")
    edges = whole.select(*keys, F.explode(F.array("x1", "x2")).alias("x")).distinct()
    strips = edges.withColumn("to", F.lead("x").over(Window.partitionBy(*keys).orderBy("x"))).filter("to is not null")
    inside = strips.join(whole, keys).filter("x1 <= x and x2 >= to")
    order = Window.partitionBy(*keys, "x").orderBy("y1", "y2")
    reached = F.max("y2").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gain = F.greatest(F.lit(0).cast("bigint"), F.col("y2") - F.greatest(F.col("y1"), F.coalesce(reached, F.col("y1"))))
    return inside.withColumn("gain", gain * (F.col("to") - F.col("x"))).groupBy(*keys).agg(F.sum("gain").alias("covered_area"))


def mask_boxes(cells: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """keys and the tight half-open box of the set cells (x, y) of each group; no row for an empty mask."""
    return cells.groupBy(*keys).agg(g.box(F.min(x), F.min(y), F.max(x) + 1, F.max(y) + 1).alias("box"))
