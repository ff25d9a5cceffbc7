"""Readers of annotation documents, candidate stores, reference tables and panels, with fixed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.functions import geometry as g

BOX = "array<double>"
OBJECT = f"id string, kind string, status string, scene_layer string, bbox_xyxy {BOX}, mask_ref string, alternative_boxes array<{BOX}>, label struct<id:string,name:string>, label_alternatives array<struct<id:string,name:string>>, uncertainty struct<existence:string,class:string,boundary:string,count:string,granularity:string,reasons:array<string>>, evidence_refs array<string>, relations array<struct<type:string,target_id:string,evidence_refs:array<string>>>, occluded boolean, truncated boolean, flag_evidence_refs array<string>, count string, calibrated_estimates array<struct<event:string,probability:double,calibration_ref:string,population:string,localization_threshold:double>>"
CANDIDATE = f"id string, disposition string, object string, job string, level int, bbox_xyxy {BOX}, label string, model_score double, class_scores map<string,double>, view_edge boolean, merged_into string, merged_views array<string>, reason string, verification struct<confirmed:boolean,verifier_label:string,verifier_score:double,overlap:double>"
REFERENCE = f"id string, bbox_xyxy {BOX}, permitted_labels array<string>, eligible boolean"
PREDICTION = f"id string, bbox_xyxy {BOX}, label string, kind string, status string, scene_layer string"


def _struct(fields: str) -> str:
    return "struct<" + ",".join(f"{n}:{t}" for n, t in (x.split(" ", 1) for x in fields.split(", "))) + ">"


IDENTITY = "struct<id:string,version:string,sha256:string,definition:string>"
SUMMARY = "struct<by_status:map<string,bigint>,by_kind:map<string,bigint>,by_class:map<string,bigint>,unresolved_objects:bigint,regions:bigint,unsearched_regions:bigint,coverage:map<string,string>,resources:map<string,string>,calibration:map<string,string>>"
ANNOTATION = f"schema_version string, run_id string, image struct<source_sha256:string,pixel_sha256:string,original_size:array<int>,normalized_size:array<int>,orientation:int,orientation_transform:array<array<double>>>, policy {IDENTITY}, ontology {IDENTITY}, manifest_ref string, qualification struct<id:string,domain:string,status:string>, execution struct<status:string,reason:string,failure_refs:array<string>>, search struct<profile_id:string,status:string,mandatory_planned:int,mandatory_completed:int,mandatory_failed:int,stable_rounds:int,coverage_ref:string,stop_rule:map<string,string>>, objects array<{_struct(OBJECT)}>, regions array<struct<kind:string,bbox_xyxy:{BOX},reason:string,evidence_refs:array<string>>>, summary {SUMMARY}, artifacts map<string,struct<path:string,format:string,sha256:string>>"
BENCHMARK = f"schema_version string, frozen boolean, policy_compatible boolean, reference_provenance string, ontology string, category_scope array<string>, category_scope_reason string, recall_interpretable boolean, images array<struct<id:string,sha256:string,scene_id:string,near_duplicate_group:string,split:string,domain:string,size:array<int>,run_status:string,references:array<{_struct(REFERENCE)}>,predictions:array<{_struct(PREDICTION)}>>>"


def as_box(edges: Column | str) -> Column:
    """A four-number array as a box; null unless it has four."""
    e = F.col(edges) if isinstance(edges, str) else edges
    return F.when(F.size(e) == 4, g.box(*(F.get(e, F.lit(i)) for i in range(4))))


def run_key(path: str = "_metadata.file_path", depth: int = 1):
    """The folder, depth levels above a file, that names its run."""
    return F.element_at(F.split(F.col(path), "/"), -(depth + 1))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """One row a finished run: the annotation document, with run."""
    return spark.read.schema(ANNOTATION).json(path, multiLine=True).withColumn("run", run_key())


def objects(documents: DataFrame) -> DataFrame:
    """(run, pos, fields of an object, box): objects in the order of their document."""
    rows = documents.select("run", F.posexplode("objects").alias("pos", "o")).select("run", "pos", "o.*")
    return rows.withColumn("box", as_box("bbox_xyxy"))


def candidates(spark: SparkSession, path: str, disposition: str | None = None) -> DataFrame:
    """Candidate records of runs, one JSON line each; the disposition filter reaches the reader."""
    rows = spark.read.schema(CANDIDATE).json(path).withColumn("run", run_key(depth=2))
    rows = rows.filter(F.col("disposition") == disposition) if disposition else rows
    return rows.withColumn("box", as_box("bbox_xyxy"))


def reference_csv(spark: SparkSession, path: str, categories: DataFrame, width: int, height: int) -> tuple[DataFrame, DataFrame]:
    """(references, drops) of headerless x,y,w,h,score,category,truncation,occlusion rows.

    Rows of fewer than six fields are skipped; categories (category, name, eligible, permitted_labels,
    reason) is a short dimension; boxes are clipped to the image. drops counts what was left out, by
    reason: short_row, unknown_category, degenerate_box.
    """
    raw = spark.read.text(path).select(run_key(depth=0).alias("file"), F.split("value", ",").alias("f"))
    number = lambda i: F.get("f", F.lit(i)).try_cast("int")
    rows = raw.withColumns({"short": F.size("f") < 6, "category": F.get("f", F.lit(5)), "box": g.clip(g.from_xywh(number(0), number(1), number(2), number(3)), F.lit(width), F.lit(height))})
    rows = rows.join(F.broadcast(categories.withColumn("__known", F.lit(True))), "category", "left")
    fine = (F.col("box.x2") > F.col("box.x1")) & (F.col("box.y2") > F.col("box.y1"))
    fault = F.when(F.col("short"), "short_row").when(F.col("__known").isNull(), "unknown_category").when(~F.coalesce(fine, F.lit(False)), "degenerate_box")
    judged = rows.withColumn("drop", fault)
    kept = judged.filter("drop is null").select("file", "category", "name", "eligible", "permitted_labels", "reason", "box")
    return kept, judged.filter("drop is not null").groupBy("drop").agg(F.count("*").alias("n"))


def benchmark(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(header, images, references, predictions) of benchmark documents, exploded with positions."""
    document = spark.read.schema(BENCHMARK).json(path, multiLine=True)
    header = document.withColumn("n_images", F.coalesce(F.size("images"), F.lit(0))).drop("images")
    rows = document.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), "i.*")
    images = rows.select("image_id", "sha256", "scene_id", "near_duplicate_group", "split", "domain", F.get("size", F.lit(0)).alias("width"), F.get("size", F.lit(1)).alias("height"), F.coalesce("run_status", F.lit("missing")).alias("run_status"))
    refs = rows.select("image_id", F.posexplode("references").alias("ref", "r")).select("image_id", "ref", "r.id", as_box("r.bbox_xyxy").alias("ref_box"), F.col("r.permitted_labels").alias("permitted"), F.coalesce("r.eligible", F.lit(True)).alias("eligible"))
    preds = rows.select("image_id", F.posexplode("predictions").alias("pos", "p")).select("image_id", "pos", "p.id", as_box("p.bbox_xyxy").alias("box"), "p.label", "p.kind", "p.scene_layer", "p.status")
    return header, images, refs, preds


def panel_parquet(spark: SparkSession, path: str, wanted: list[str]) -> tuple[DataFrame, DataFrame]:
    """(boxes, counts) of column-wise annotated Parquet: rows of wanted datasets only, the filter pushed to the scan."""
    rows = spark.read.parquet(path).where(F.col("dataset_name").isin(wanted))
    pairs = F.posexplode(F.arrays_zip(F.col("annotations.bbox").alias("bbox"), F.col("annotations.category_id").alias("category_id")))
    flat = rows.select("dataset_name", "file_name", "width", "height", pairs.alias("pos", "a")).select("dataset_name", "file_name", "width", "height", "pos", g.from_xywh(*(F.get("a.bbox", F.lit(i)) for i in range(4))).alias("box"), "a.category_id")
    return flat, flat.groupBy("dataset_name", "category_id").agg(F.count("*").alias("n"))


def label_lines(spark: SparkSession, path: str) -> DataFrame:
    """(class, n) over label text files of 'class cx cy w h' lines."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.groupBy(F.split(F.trim("value"), r"\s+")[0].cast("int").alias("class")).agg(F.count("*").alias("n"))


def manifest_faults(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(entity, code) of a bundle: listed files that are missing or differ, and files that are not listed.

    manifest has path and sha256. Contents are hashed where they are read.
    """
    root = F.regexp_replace(F.lit(folder), r"^file:/*", "/")
    held = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    held = held.select(F.substr(F.regexp_replace("path", "^file:/*", "/"), F.length(root) + 2, F.lit(1 << 20)).alias("path"), F.sha2("content", 256).alias("found"))
    joined = manifest.select("path", "sha256").join(held, "path", "full_outer")
    code = F.when(F.col("found").isNull(), "missing_asset").when(F.col("sha256").isNull(), "unmanifested_model_assets").when(F.col("found") != F.col("sha256"), "asset_hash_mismatch")
    return joined.select(F.col("path").alias("entity"), code.alias("code")).filter("code is not null")


def documents_by_id(spark: SparkSession, path: str, schema: str, key: str = "id") -> DataFrame:
    """A registry of JSON documents, keyed; a folder scan with a fixed schema."""
    return spark.read.schema(schema).json(path, multiLine=True).withColumn("key", F.col(key))


def lookup(registry: DataFrame, wanted: str, code: str) -> DataFrame:
    """The document of a key; an unknown key is an error that names the code."""
    row = registry.filter(F.col("key") == wanted)
    if row.isEmpty():
        raise ValueError(f"{code}: {wanted}; available {sorted(r.key for r in registry.select('key').limit(100).collect())}")
    return row
