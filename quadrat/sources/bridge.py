"""Box tables derived from the driver's tables in integer arithmetic.

``obs`` has one box a lineitem row, ``refs`` up to nine an image; images are groups of eight orders. They
exercise the operators; they say nothing about detection quality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrat.functions.geometry import box
from quadrat.functions.labels import Ontology

SIZE = 96  # width and height of every image
LABELS = ("car", "van", "truck", "person")
ONTOLOGY = Ontology(
    "bridge-v1",
    (("entity", None, False), ("unknown_object", "entity", False), ("vehicle", "entity", True), ("person", "entity", True), ("car", "vehicle", True), ("van", "vehicle", True), ("truck", "vehicle", True)),
    frozenset({frozenset({"person", "truck"})}),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table's files whose rows one task takes: some hundred thousand rows of lineitem.
TASK_BYTES = 4 << 20


def tasks(df: DataFrame) -> int:
    """Tasks for a table as read from its files: by their bytes, so that a task's rows don't grow with the table."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, idx, job, box, view_edge, score_milli, label); idx numbers an image's rows from 0."""
    line = table(spark, sf_dir, "lineitem")
    image = F.expr("l_orderkey div 8")
    order = Window.partitionBy("image_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    x1 = F.lit(24) * (F.col("l_partkey") % 3) + F.col("l_suppkey") % 5
    y1 = F.lit(24) * F.expr("(l_partkey % 9) div 3") + F.col("l_partkey") % 4
    used = line.select(image.alias("image_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = used.repartition(tasks(line), "image_id").withColumn("idx", F.row_number().over(order) - 1)
    label = F.element_at(F.array(*map(F.lit, LABELS)), (((F.col("l_partkey") % 9) + (F.col("l_suppkey") % 10 == 0).cast("int")) % 4 + 1).cast("int"))
    return rows.select(
        "image_id",
        "idx",
        F.col("l_linenumber").alias("job"),
        box(x1, y1, x1 + 16 + F.col("l_linenumber") % 3, y1 + 16 + F.col("l_suppkey") % 4).alias("box"),
        (F.col("l_suppkey") % 7 == 0).alias("view_edge"),
        (F.round(F.col("l_extendedprice") * 100).cast("long") % 1000).alias("score_milli"),
        label.alias("label"),
    )


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, ref, box, permitted, eligible): the grid cells that an image has."""
    line = table(spark, sf_dir, "lineitem")
    images = line.select(F.expr("l_orderkey div 8").alias("image_id")).distinct().repartition(tasks(line), "image_id")
    cells = images.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("ref")).filter((F.col("image_id") + F.col("ref")) % 4 != 0)
    x1, y1 = F.lit(24) * (F.col("ref") % 3) + 2, F.lit(24) * F.expr("ref div 3") + 1
    label = F.element_at(F.array(*map(F.lit, LABELS)), (F.col("ref") % 4 + 1).cast("int"))
    permitted = F.when(label == "person", F.array(label)).otherwise(F.array(label, F.lit("vehicle")))
    return cells.select("image_id", "ref", box(x1, y1, x1 + 16, y1 + 17).alias("box"), permitted.alias("permitted"), ((F.col("image_id") + F.col("ref")) % 11 != 0).alias("eligible"))


#: The same tables for the SQL oracles, as common table expressions.
OBS = """obs AS (SELECT l_orderkey // 8 AS image_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey // 8 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS INTEGER) AS idx,
  l_linenumber AS job, 24*(l_partkey%3) + l_suppkey%5 AS x1, 24*((l_partkey%9)//3) + l_partkey%4 AS y1,
  24*(l_partkey%3) + l_suppkey%5 + 16 + l_linenumber%3 AS x2, 24*((l_partkey%9)//3) + l_partkey%4 + 16 + l_suppkey%4 AS y2,
  (l_suppkey%7=0) AS view_edge, CAST(round(l_extendedprice*100) AS BIGINT) % 1000 AS score_milli,
  (['car','van','truck','person'])[1 + ((l_partkey%9)+(l_suppkey%10=0)::int)%4] AS label FROM lineitem)"""
REFS = """imgs AS (SELECT DISTINCT l_orderkey // 8 AS image_id FROM lineitem),
refs AS (SELECT image_id, CAST(k AS INTEGER) AS ref, 24*(k%3)+2 AS x1, 24*(k//3)+1 AS y1, 24*(k%3)+18 AS x2, 24*(k//3)+18 AS y2,
  (['car','van','truck','person'])[1+k%4] AS name, CASE WHEN k%4=3 THEN ['person'] ELSE [(['car','van','truck','person'])[1+k%4], 'vehicle'] END AS permitted,
  (image_id+k)%11<>0 AS eligible FROM imgs, range(0,9) AS r(k) WHERE (image_id+k)%4<>0)"""
PAIRS = """pairs AS (SELECT *, least(ox2,rx2)-greatest(ox1,rx1) AS iw, least(oy2,ry2)-greatest(oy1,ry1) AS ih FROM
  (SELECT o.image_id, o.idx, o.job, o.label, o.score_milli, o.view_edge, o.x1 AS ox1, o.y1 AS oy1, o.x2 AS ox2, o.y2 AS oy2, r.ref, r.permitted, r.eligible, r.x1 AS rx1, r.y1 AS ry1, r.x2 AS rx2, r.y2 AS ry2
   FROM obs o JOIN refs r ON o.image_id = r.image_id AND o.x1 < r.x2 AND r.x1 < o.x2 AND o.y1 < r.y2 AND r.y1 < o.y2)),
ov AS (SELECT *, iw*ih AS i, (ox2-ox1)*(oy2-oy1)+(rx2-rx1)*(ry2-ry1)-iw*ih AS u FROM pairs)"""
