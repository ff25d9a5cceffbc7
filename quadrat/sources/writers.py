"""Sinks: exclusive writes, run artifacts, label exports, and runs that skip what is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.functions import geometry as g
from quadrat.operators import review


def write_once(df: DataFrame, path: str, kind: str = "json", by: list[str] | None = None) -> dict:
    """Writes df where nothing is yet; returns the path, the format and a digest of its rows in any order."""
    writer = df.write.mode("error").format(kind)
    (writer.partitionBy(*by) if by else writer).save(path)
    names = sorted(df.columns)
    row = F.sha2(F.to_json(F.struct(*names)), 256)
    digest = df.agg(F.sha2(F.concat(F.count("*").cast("string"), F.lit(":"), F.coalesce(F.sum(F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(38,0)")).cast("string"), F.lit("0"))), 256)).first()[0]
    return {"path": path, "format": kind, "sha256": digest}


def export_labels(objects: DataFrame, verifications: DataFrame, mapping: dict[str, int], policy: str, arm: str, threshold: float | None = None, retrieval: DataFrame | None = None, parent: str = "vehicle", modal: str = "car") -> tuple[DataFrame, DataFrame]:
    """(lines, drops): one label line per kept object, and counts of what was dropped, by reason.

    objects have image, id, box, label, width, height and boundary; verifications image, id, confirmed,
    verifier_score and verifier_label; retrieval, the sidecar that the retrieval policy needs, image, id and
    label. Only with a threshold are objects held to the verifier: they must be confirmed, and score at
    least that. Then the label decides, by the policy.
    """
    if policy == "retrieval" and retrieval is None:
        raise ValueError("missing_retrieval_sidecar")
    joined = objects.join(verifications, ["image", "id"], "left")
    if policy == "retrieval":
        joined = joined.join(retrieval.select("image", "id", F.col("label").alias("retrieved")), ["image", "id"], "left")
    named = joined.withColumn("__c", review.arm_label("label", mapping, policy, parent, modal))
    weak = F.lit(None).cast("string")
    if threshold is not None:
        weak = F.when(~F.coalesce("confirmed", F.lit(False)), "unconfirmed").when(~F.coalesce(F.col("verifier_score") >= threshold, F.lit(False)), "below_threshold")
    judged = named.withColumn("reason", F.coalesce(weak, F.col("__c.reason")))
    kept = judged.filter("reason is null").select(F.lit(arm).alias("arm"), "image", "id", F.col("__c.class").alias("class"), (F.coalesce("boundary", F.lit("")) != "supported").alias("unresolved_boundary"), g.to_yolo("box", "width", "height", F.col("__c.class")).alias("value"))
    return kept, judged.filter("reason is not null").groupBy(F.lit(arm).alias("arm"), "reason").agg(F.count("*").alias("n"))


def export_report(lines: DataFrame, drops: DataFrame, images: DataFrame, regions: DataFrame) -> DataFrame:
    """(arm, measure, n) of an export: images, written, empty_images, unresolved_boundary, unsearched_regions, class:k and dropped:reason.

    images has one row an image that was exported, regions image and kind of what was not searched or
    resolved: a trainer has no ignore regions, so they are counted.
    """
    arm = lines.select("arm").union(drops.select("arm")).distinct()
    per_image = lines.groupBy("arm", "image").agg(F.count("*").alias("n"), F.count_if("unresolved_boundary").alias("u"))
    total = arm.crossJoin(images.agg(F.count("*").alias("images"))).crossJoin(regions.agg(F.count_if(F.col("kind") == "unsearched").alias("unsearched")))  # one row each
    sums = total.join(per_image.groupBy("arm").agg(F.sum("n").alias("written"), F.sum("u").alias("unresolved"), F.count("*").alias("filled")), "arm", "left").fillna(0)
    fixed = {"images": F.col("images"), "written": F.col("written"), "empty_images": F.col("images") - F.col("filled"), "unresolved_boundary": F.col("unresolved"), "unsearched_regions": F.col("unsearched")}
    flat = sums.select("arm", F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), v.cast("long").alias("n")) for k, v in fixed.items()))).alias("m")).select("arm", "m.measure", "m.n")
    classes = lines.groupBy("arm", F.concat(F.lit("class:"), F.col("class").cast("string")).alias("measure")).agg(F.count("*").alias("n"))
    return flat.unionByName(classes).unionByName(drops.select("arm", F.concat(F.lit("dropped:"), "reason").alias("measure"), "n"))


def write_retrieval(votes: DataFrame, path: str) -> dict:
    """The retrieval sidecar of all images, written once: image, id, the voted label, its votes and the runner-up."""
    return write_once(votes.select("image", "id", "label", "votes", "runner_up"), path)


def write_labels(lines: DataFrame, path: str) -> None:
    """Label lines as text, one folder an arm and image."""
    lines.select("arm", "image", "value").repartition("arm", "image").sortWithinPartitions("arm", "image", "value").write.partitionBy("arm", "image").mode("error").text(path)


def incremental(spark: SparkSession, inputs: DataFrame, done_path: str, keys: list[str], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs only inputs whose keys have no result under done_path yet, appends theirs, and returns all results."""
    try:
        done = spark.read.parquet(done_path)
        todo = inputs.join(done.select(*keys), keys, "left_anti")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        todo = inputs
    run(todo).write.mode("append").parquet(done_path)
    return spark.read.parquet(done_path)
