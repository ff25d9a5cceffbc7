"""Constraint queries: each gives (entity, code) rows for what breaks a rule; a violations table is their union."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.functions import geometry as g
from quadrat.functions.text import path_fault

from .lineage import cut

#: Edges of a graph that the driver may finish.
LOCAL_EDGES = 200_000


def violations(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def broken(df: DataFrame, entity: Column, rules: dict[str, Column]) -> DataFrame:
    """(entity, code) for every rule (code: condition that must hold) a row breaks; one pass over df."""
    codes = F.array_compact(F.array(*(F.when(~F.coalesce(test, F.lit(False)), code) for code, test in rules.items())))
    return df.select(entity.cast("string").alias("entity"), F.explode(codes).alias("code"))


def duplicates(df: DataFrame, keys: list[str], code: str) -> DataFrame:
    """(entity, code) for every value of the keys that comes more than once."""
    name = F.concat_ws("/", *(F.col(k).cast("string") for k in keys))
    return df.groupBy(*keys).count().filter("count > 1").select(name.alias("entity"), F.lit(code).alias("code"))


def missing(df: DataFrame, keys: list[str], other: DataFrame, entity: Column, code: str) -> DataFrame:
    """(entity, code) for rows of df without a row of other."""
    return df.join(other.select(*keys).distinct(), keys, "left_anti").select(entity.cast("string").alias("entity"), F.lit(code).alias("code"))


def leakage(images: DataFrame, keys: list[str], split: str = "split") -> DataFrame:
    """(entity, code): identity values (content, scene, near-duplicate group) that stand in more than one split.

    Values of all keys are unpivoted and counted in one pass; splits are reduced to their minimum and
    maximum before the shuffle, so a value that very many images share stays one small row.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys)))
    flat = images.select(split, pairs.alias("p")).filter("p.value is not null")
    split_in_two = flat.groupBy("p.key", "p.value").agg(F.min(split).alias("a"), F.max(split).alias("b")).filter("a <> b")
    return split_in_two.select(F.concat_ws("=", "key", "value").alias("entity"), F.lit("split_leakage").alias("code"))


def cycles(edges: DataFrame, src: str = "src", dst: str = "dst", local: int = LOCAL_EDGES) -> DataFrame:
    """(src): nodes on a cycle of the directed graph, of any length.

    Ends and chains are taken out round by round: nodes without an edge in or out are on no cycle, and a
    node with one edge in and one out stands or falls with the edge that bypasses it (of
    neighbours the least by a salted hash goes, so a third of a chain goes in each round). What remains
    is parted into strongly connected components by the largest ancestor. At most ``local`` remaining
    edges (checked; two ids each) are finished on the driver. Nothing grows beyond the edges.
    """
    left = cut(edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).filter("s is not null and d is not null").distinct())
    kind = left.schema["s"].dataType
    loops = [left.filter("s = d").select(F.col("s").alias("node"))]
    left, bypassed, n = left.filter("s <> d"), [], -1
    components = left.sparkSession.createDataFrame([], T.StructType([T.StructField("node", kind), T.StructField("scc", kind)]))
    for salt in count():
        left = cut(left)
        before, n = n, left.count()
        if n <= local:
            components = components.unionByName(_components_here(left, kind))
            break
        starts, ends = left.groupBy(F.col("s").alias("node")).agg(F.count("*").alias("out"), F.min("d").alias("w")), left.groupBy(F.col("d").alias("node")).agg(F.count("*").alias("into"), F.min("s").alias("u"))
        lot = lambda c: F.xxhash64(F.lit(salt), c)  # noqa: B023, E731
        chain = starts.join(ends, "node").filter((F.col("out") == 1) & (F.col("into") == 1)).select("node", "u", "w")
        chosen = cut(chain.filter((lot("node") < lot("u")) & (lot("node") < lot("w"))))
        if not chosen.isEmpty():
            bypassed.append(chosen)
        elif n == before and chain.isEmpty():
            components = components.unionByName(_components(left))
            break
        both = left.join(starts.select(F.col("node").alias("d")), "d", "left_semi").join(ends.select(F.col("node").alias("s")), "s", "left_semi").select("s", "d")
        gone = chosen.select("node")
        kept = both.join(gone.withColumnRenamed("node", "s"), "s", "left_anti").join(gone.withColumnRenamed("node", "d"), "d", "left_anti").select("s", "d")
        made = cut(kept.unionByName(chosen.select(F.col("u").alias("s"), F.col("w").alias("d"))).distinct())
        loops.append(made.filter("s = d").select(F.col("s").alias("node")).distinct())
        left = made.filter("s <> d")
    components = cut(components)
    for chosen in reversed(bypassed):
        u, w = (components.select(F.col("node").alias(c), F.col("scc").alias(f"{c}_scc")) for c in ("u", "w"))
        ends = chosen.join(u, "u", "left").join(w, "w", "left").withColumns({"u_scc": F.coalesce("u_scc", "u"), "w_scc": F.coalesce("w_scc", "w")})
        same = cut(ends.filter("u_scc = w_scc").select("node", F.col("u_scc").alias("scc"), "u"))
        known = same.select(F.col("u").alias("node"), "scc").distinct().join(components.select("node"), "node", "left_anti")
        components = cut(components.unionByName(same.select("node", "scc")).unionByName(known))
    shared = components.groupBy("scc").agg(F.count("*").alias("n")).filter("n > 1").select("scc")
    found = reduce(DataFrame.unionByName, loops).unionByName(components.join(shared, "scc", "left_semi").select("node"))
    return found.distinct().select(F.col("node").alias(src))


def _components_here(edges: DataFrame, kind: T.DataType) -> DataFrame:
    """(node, scc) of a graph that fits the driver, by Tarjan's algorithm without recursion."""
    after: dict = {}
    for r in edges.collect():
        after.setdefault(r.s, []).append(r.d)
        after.setdefault(r.d, [])
    seen, low, stack, on, rows = {}, {}, [], set(), []
    for first in after:
        if first in seen:
            continue
        walk = [(first, iter(after[first]))]
        seen[first] = low[first] = len(seen)
        stack.append(first)
        on.add(first)
        while walk:
            node, rest = walk[-1]
            for x in rest:
                if x not in seen:
                    seen[x] = low[x] = len(seen)
                    stack.append(x)
                    on.add(x)
                    walk.append((x, iter(after[x])))
                    break
                if x in on:
                    low[node] = min(low[node], seen[x])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[node])
                if low[node] == seen[node]:
                    while True:
                        x = stack.pop()
                        on.discard(x)
                        rows.append((x, node))
                        if x == node:
                            break
    return edges.sparkSession.createDataFrame(rows, T.StructType([T.StructField("node", kind), T.StructField("scc", kind)]))


def _components(edges: DataFrame) -> DataFrame:
    """(node, scc) of any graph: nodes of one largest ancestor that reach it are its component; the rest goes round again."""
    found, left = None, edges
    while not left.isEmpty():
        nodes = left.select(F.col("s").alias("node")).union(left.select("d")).distinct()
        color, size = cut(nodes.withColumn("scc", F.col("node"))), None
        while True:
            passed = left.join(color, F.col("s") == F.col("node")).select(F.col("d").alias("node"), "scc")
            color = cut(color.unionByName(passed).groupBy("node").agg(F.max("scc").alias("scc")))
            now = color.agg(F.sum(F.xxhash64("node", "scc").cast("decimal(38,0)"))).first()[0]
            if now == size:
                break
            size = now
        inside = cut(left.join(color.select(F.col("node").alias("s"), F.col("scc").alias("a")), "s").join(color.select(F.col("node").alias("d"), F.col("scc").alias("b")), "d").filter("a = b").select("s", "d"))
        reached, n = cut(color.filter("node = scc")), -1
        while (m := reached.count()) != n:
            n = m
            more = inside.join(reached.select(F.col("node").alias("d"), "scc"), "d").select(F.col("s").alias("node"), "scc")
            reached = cut(reached.unionByName(more).distinct())
        found = reached if found is None else found.unionByName(reached)
        done = reached.select("node")
        left = cut(left.join(done.withColumnRenamed("node", "s"), "s", "left_anti").join(done.withColumnRenamed("node", "d"), "d", "left_anti").select("s", "d"))
    return found


def ontology_closure(spark: SparkSession, classes: DataFrame, depth: int = 64) -> DataFrame:
    """(class, ancestor, depth) of a class table (class, parent), by a recursive query; a cycle ends at its start."""
    classes.createOrReplaceTempView("__classes")
    return spark.sql(f"""
        WITH RECURSIVE up(class, ancestor, depth, path) AS (
          SELECT class, class, 0, array(class) FROM __classes
          UNION ALL
          SELECT u.class, c.parent, u.depth + 1, array_append(u.path, c.parent)
          FROM up u JOIN __classes c ON c.class = u.ancestor
          WHERE c.parent IS NOT NULL AND NOT array_contains(u.path, c.parent) AND u.depth < {depth})
        SELECT class, ancestor, depth FROM up""")


#: What enumerated fields may hold.
SPLITS = ("development", "calibration", "evaluation")
RUN_STATUS = ("completed", "failed", "interrupted", "missing")
KINDS, LAYERS, STATUS = ("instance", "part", "group", "stuff"), ("physical", "depicted", "reflected"), ("accepted", "uncertain")
STATES, DIMENSIONS = ("supported", "unresolved", "not_assessed"), ("existence", "class", "boundary", "count", "granularity")
PROVENANCES = ("independent", "synthetic_fixture")
RESOLUTIONS, ORIGINS = ("specific", "broad", "unknown"), ("independent", "accepted_prediction", "corrected_prediction")


def benchmark(images: DataFrame, references: DataFrame, predictions: DataFrame, labels: list[str]) -> DataFrame:
    """(entity, code) of a benchmark: identities, splits, leakage, records, mappings and run states.

    images: image_id, split, run_status, sha256, scene_id, near_duplicate_group, width, height; references:
    image_id, id, ref_box, permitted; predictions: image_id, id, box, label, status, kind, scene_layer. All
    rows are checked, of every split.
    """
    identity = ["sha256", "scene_id", "near_duplicate_group"]
    sizes = images.select("image_id", "width", "height", "run_status")
    refs, preds = references.join(sizes, "image_id"), predictions.join(sizes, "image_id")
    name = lambda: F.concat_ws("/", F.col("image_id").cast("string"), F.col("id").cast("string"))
    known = F.size(F.array_except("permitted", F.array(*map(F.lit, labels)))) == 0
    return violations(
        duplicates(images, ["image_id"], "duplicate_image_id"),
        broken(images, F.col("image_id"), {"invalid_split": F.col("split").isin(*SPLITS), "invalid_run_status": F.col("run_status").isin(*RUN_STATUS), **{f"missing_leakage_identity: {c}": F.coalesce(F.col(c), F.lit("")) != "" for c in identity}}),
        leakage(images, identity),
        duplicates(references, ["image_id", "id"], "duplicate_record_id"),
        duplicates(predictions, ["image_id", "id"], "duplicate_record_id"),
        broken(refs, name(), {**box_rules("ref_box", "width", "height"), "invalid_reference_mapping": (F.size("permitted") > 0) & known}),
        broken(
            preds,
            name(),
            {
                **box_rules("box", "width", "height"),
                "invalid_prediction": F.col("label").isin(labels) & F.col("status").isin(*STATUS) & F.col("kind").isin(*KINDS) & F.col("scene_layer").isin(*LAYERS),
                "invalid_accepted_label": ~((F.col("status") == "accepted") & F.col("label").isin("unknown_object", "entity")),
                "failed_run_has_predictions": F.col("run_status") == "completed",
            },
        ),
    )


#: What the summary of an annotation must state, beside what can be counted again.
COVERAGE_FIELDS = ("planned_jobs", "completed_jobs", "failed_jobs", "route_covered_area_fraction")
RESOURCE_FIELDS = ("wall_seconds", "peak_rss_bytes", "artifact_bytes", "model_calls")
CALIBRATION_FIELDS, CALIBRATION_STATES = ("status", "reason"), ("applied", "inapplicable")


def benchmark_header(header: DataFrame, labels: list[str], schema_version: str) -> DataFrame:
    """(entity, code) of benchmark documents themselves: version, freezing, provenance, images and category scope.

    header has a document's fields without its images, and n_images.
    """
    scope = F.col("category_scope")
    return broken(
        header,
        F.lit("benchmark"),
        {
            "invalid_benchmark_schema": F.col("schema_version") == schema_version,
            "incompatible_reference": F.coalesce("frozen", F.lit(False)) & F.coalesce(F.col("reference_provenance").isin(*PROVENANCES), F.lit(False)) & F.coalesce("policy_compatible", F.lit(False)),
            "empty_benchmark": F.col("n_images") > 0,
            "invalid_category_scope": scope.isNull() | ((F.size(scope) > 0) & (F.size(F.array_except(scope, F.array(*map(F.lit, labels)))) == 0)),
            "missing_category_scope_reason": scope.isNull() | (F.coalesce("category_scope_reason", F.lit("")) != ""),
        },
    )


def canonical_json(text: Column) -> Column:
    """JSON text with sorted keys and no spaces; null for what is no JSON."""
    return F.to_json(F.try_parse_json(text))


def _same_identity(own: Column, other: Column) -> Column:
    equal = canonical_json(own.getField("definition")).eqNullSafe(canonical_json(other.getField("definition")))
    for field in ("id", "version", "sha256"):
        equal = equal & own.getField(field).eqNullSafe(other.getField(field))
    return equal


def _counts(values: Column) -> Column:
    """Sorted (value, how often) of an array."""
    return F.array_sort(F.transform(F.array_distinct(values), lambda v: F.struct(v.alias("key"), F.size(F.filter(values, lambda x: x == v)).cast("long").alias("value"))))


def _listed(array: str) -> Column:
    return F.coalesce(F.col(array), F.array())


def annotation(documents: DataFrame, registry: DataFrame, policy: DataFrame, single_pass: tuple[str, ...] = ()) -> DataFrame:
    """(entity, code) of annotation documents: every rule that a document, an object or a region breaks.

    documents: run and the fields of ``readers.ANNOTATION``, one row a run; registry: one row an ontology,
    id, version, sha256, definition (JSON text) and classes (id, name, useful); policy: one row, id, version,
    sha256, definition. single_pass names search profiles that can't saturate. Entities are run,
    run/object, run/region:position and, for a reference that no artifact has, run/reference.

    A document is looked at as a whole in its own row; only repeated object ids and part_of cycles are
    shuffled, as ids.
    """
    known = registry.select(F.struct("id", "version", "sha256", "definition").alias("__ontology"), F.map_from_entries(F.transform("classes", lambda c: F.struct(c.id, F.struct(c["name"].alias("name"), c.useful.alias("useful"))))).alias("__classes"))
    one = policy.select(F.struct("id", "version", "sha256", "definition").alias("__policy"))
    docs = documents.join(known, documents["ontology.id"] == F.col("__ontology.id"), "left").crossJoin(F.broadcast(one.limit(1)))
    w, h = F.get("image.normalized_size", F.lit(0)), F.get("image.normalized_size", F.lit(1))
    sides = [w, h, F.get("image.original_size", F.lit(0)), F.get("image.original_size", F.lit(1))]
    paths = F.transform(F.map_values("artifacts"), lambda a: a.path)
    state = F.element_at("summary.calibration", "status")
    objects, regions = _listed("objects"), _listed("regions")
    m = F.flatten("image.orientation_transform")
    cell = lambda r, c: F.get(m, F.lit(3 * r + c))
    det = sum(cell(0, i) * (cell(1, (i + 1) % 3) * cell(2, (i + 2) % 3) - cell(1, (i + 2) % 3) * cell(2, (i + 1) % 3)) for i in range(3))
    square = (F.size("image.orientation_transform") == 3) & F.forall("image.orientation_transform", lambda r: F.size(r) == 3)
    finite = F.forall(m, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    search, ran = F.col("search.status"), F.col("execution.status")
    planned, completed, failed = (F.col(f"search.mandatory_{x}") for x in ("planned", "completed", "failed"))
    unsearched = F.size(F.filter(regions, lambda r: r.kind == "unsearched"))
    stable = F.coalesce(F.element_at("search.stop_rule", "required_stable_rounds").cast("int"), F.lit(1))
    wrongly = F.col("search.profile_id").isin(*single_pass) if single_pass else F.lit(False)
    wrongly = wrongly | (F.col("search.stable_rounds") < stable) | (unsearched > 0)
    present = lambda block, fields: F.coalesce(F.size(F.array_except(F.array(*map(F.lit, fields)), F.map_keys(f"summary.{block}"))) == 0, F.col(f"summary.{block}").isNull())
    stated = lambda field: F.array_sort(F.transform(F.map_entries(f"summary.{field}"), lambda e: F.struct(e.key.alias("key"), e.value.alias("value"))))
    counted = (
        (stated("by_status") == _counts(F.transform(objects, lambda o: o.status)))
        & (stated("by_kind") == _counts(F.transform(objects, lambda o: o.kind)))
        & (stated("by_class") == _counts(F.transform(objects, lambda o: o.label.id)))
        & (F.col("summary.unresolved_objects") == F.size(F.filter(objects, lambda o: o.status == "uncertain")))
        & (F.col("summary.regions") == F.size(regions))
        & (F.col("summary.unsearched_regions") == unsearched)
    )
    estimates = F.flatten(F.transform(objects, lambda o: F.coalesce(o.calibrated_estimates, F.array())))
    rules = {
        "invalid_image_size": F.least(*sides) > 0,
        "invalid_orientation_transform": square & finite & (F.abs(det) >= 1e-12),
        "incompatible_policy": _same_identity(F.col("policy"), F.col("__policy")),
        "unknown_ontology": F.col("__ontology").isNotNull(),
        "incompatible_ontology": F.col("__ontology").isNull() | _same_identity(F.col("ontology"), F.col("__ontology")),
        "invalid_calibration_status": state.isin(*CALIBRATION_STATES),
        "calibrated_estimate_while_calibration_inapplicable": ~(F.coalesce(state, F.lit("")) == "inapplicable") | (F.size(estimates) == 0),
        "duplicate_artifact_path": F.size(F.array_distinct(paths)) == F.size(paths),
        "unsafe_artifact_path": F.forall(paths, lambda p: path_fault(p).isNull()),
        "invalid_job_counts": completed + failed <= planned,
        "incomplete_search": ~search.isin("saturated", "profile_complete") | ((ran == "completed") & (completed == planned) & (failed == 0)),
        "false_saturation": (search != "saturated") | ~wrongly,
        "saturation_profile_not_implemented": (search != "saturated") | wrongly,
        "invalid_failure_state": ~ran.isin("failed", "interrupted") | ((search == ran) & (F.size(F.coalesce("execution.failure_refs", F.array())) > 0)),
        "qualification_not_implemented": (F.col("qualification.status") != "eligible") & F.col("qualification.id").isNull(),
        "summary_missing_coverage": F.col("summary.coverage").isNotNull(),
        "summary_missing_resources": F.col("summary.resources").isNotNull(),
        "summary_missing_calibration": F.col("summary.calibration").isNotNull(),
        "summary_missing_coverage_field": present("coverage", COVERAGE_FIELDS),
        "summary_missing_resources_field": present("resources", RESOURCE_FIELDS),
        "summary_missing_calibration_field": present("calibration", CALIBRATION_FIELDS),
        "summary_mismatch": counted,
    }
    no_refs = F.array().cast("array<string>")
    refs = F.concat(
        F.array("manifest_ref", "search.coverage_ref"),
        F.coalesce("execution.failure_refs", no_refs),
        F.flatten(F.transform(objects, lambda o: F.concat(F.coalesce(o.evidence_refs, no_refs), F.coalesce(o.flag_evidence_refs, no_refs), F.transform(F.coalesce(o.calibrated_estimates, F.array()), lambda e: e.calibration_ref), F.flatten(F.transform(F.coalesce(o.relations, F.array()), lambda r: F.coalesce(r.evidence_refs, no_refs)))))),
        F.flatten(F.transform(regions, lambda r: F.coalesce(r.evidence_refs, no_refs))),
    )
    dangling = docs.select(F.explode(F.array_except(refs, paths)).alias("ref"), "run").select(F.concat_ws("/", "run", "ref").alias("entity"), F.lit("unknown_artifact_reference").alias("code"))
    ids = F.transform(objects, lambda o: o.id)
    each = docs.select("run", w.alias("w"), h.alias("h"), F.col("__classes").alias("classes"), state.alias("calibration"), ids.alias("ids"), F.explode("objects").alias("o"))
    spots = docs.select("run", w.alias("w"), h.alias("h"), F.posexplode("regions").alias("pos", "r"))
    edges = each.select("run", F.col("o.id").alias("id"), F.explode(F.coalesce("o.relations", F.array())).alias("r")).filter("r.type = 'part_of'")
    edges = edges.select(F.concat_ws("/", "run", "id").alias("src"), F.concat_ws("/", "run", "r.target_id").alias("dst"))
    return violations(
        broken(docs, F.col("run"), rules),
        dangling,
        duplicates(each.select("run", F.col("o.id").alias("id")), ["run", "id"], "duplicate_object_id"),
        broken(each, F.concat_ws("/", "run", "o.id"), _object_rules()),
        broken(spots, F.concat(F.col("run"), F.lit("/region:"), F.col("pos")), {"invalid_box": _inside(F.col("r.bbox_xyxy"))}),
        cycles(edges).select(F.col("src").alias("entity"), F.lit("cyclic_part_of").alias("code")),
    )


def _inside(edges: Column) -> Column:
    """Whether an array of four edges is a box of the image of w by h."""
    return (F.size(edges) == 4) & g.box_fault(g.box(*(F.get(edges, F.lit(i)) for i in range(4))), F.col("w"), F.col("h")).isNull()


def _object_rules() -> dict[str, Column]:
    """What must hold of an object ``o`` of a document with ids, classes, calibration, w and h."""
    o = lambda field: F.col(f"o.{field}")
    some = lambda field: F.coalesce(o(field), F.array())
    useful = F.element_at("classes", o("label.id")).getField("useful")
    states = [o(f"uncertainty.{d}") for d in DIMENSIONS]
    valid, supported = o("kind").isin(*KINDS) & o("status").isin(*STATUS) & o("scene_layer").isin(*LAYERS), F.lit(True)
    for s in states:
        valid, supported = valid & F.coalesce(s.isin(*STATES), F.lit(False)), supported & (s == "supported")
    numbers = F.transform(F.regexp_extract_all(o("count"), F.lit(r"-?\d+"), F.lit(0)), lambda x: x.cast("long"))
    counted, group = o("count").isNotNull(), o("kind") == "group"
    parts = F.filter(some("relations"), lambda r: r.type == "part_of")
    named = lambda x: F.coalesce(F.element_at("classes", x.id).getField("name") == x["name"], F.lit(False))
    return {
        "invalid_state": valid,
        "invalid_box": _inside(o("bbox_xyxy")) & F.forall(some("alternative_boxes"), lambda b: _inside(b)),
        "mask_validation_not_implemented": F.coalesce(o("mask_ref"), F.lit("")) == "",
        "invalid_ontology_label": named(o("label")) & F.forall(some("label_alternatives"), lambda x: named(x)),
        "invalid_acceptance": (o("status") != "accepted") | (supported & F.coalesce(useful, F.lit(False))),
        "unknown_class_supported": ~(F.coalesce(o("label.id") == "unknown_object", F.lit(False)) & (o("uncertainty.class") == "supported")),
        "invalid_calibrated_probability": F.forall(some("calibrated_estimates"), lambda e: F.coalesce(~F.isnan(e.probability) & (F.abs(e.probability) < float("inf")), F.lit(False))),
        "calibrated_estimate_without_applied_calibration": (F.size(some("calibrated_estimates")) == 0) | F.coalesce(F.col("calibration") == "applied", F.lit(False)),
        "unsupported_flag": (o("occluded").isNull() & o("truncated").isNull()) | (F.size(some("flag_evidence_refs")) > 0),
        "count_only_for_groups": group | ~counted,
        "unsupported_group_count": ~counted | ((F.size(numbers) > 0) & (F.array_min(numbers) >= 1) & (F.array_sort(numbers) == numbers) & (o("uncertainty.count") == "supported")),
        "unresolved_group_count": ~group | counted | (o("uncertainty.count") != "supported"),
        "invalid_relation_target": F.forall(some("relations"), lambda r: F.array_contains("ids", r.target_id) & (r.target_id != o("id"))),
        "missing_part_of": (o("kind") != "part") | (F.size(parts) > 0),
    }


def panel(images: DataFrame, annotations: DataFrame, planned: DataFrame, visited: DataFrame, labels: list[str], blind: bool, anchoring: str) -> DataFrame:
    """(entity, code) of a reference panel: sweep, records, content repeats, and how it was anchored.

    images: image_id, sha256; annotations: image_id, id, label, kind, scene_layer, origin, eligible,
    exclusion_reason; planned and visited: image_id, job.
    """
    sweep = sweep_faults(planned, visited, ["image_id"])
    key = F.col("image_id").cast("string")
    name = F.concat_ws("/", key, F.col("id").cast("string"))
    anchored = annotations.filter(F.col("origin") != "independent")
    found = violations(
        sweep.filter("size(unknown) > 0").select(key.alias("entity"), F.lit("unknown_review_tile").alias("code")),
        sweep.filter("size(missing) > 0").select(key.alias("entity"), F.lit("incomplete_sweep").alias("code")),
        duplicates(images, ["sha256"], "duplicate_image_content"),
        duplicates(annotations, ["image_id", "id"], "duplicate_annotation_id"),
        broken(annotations, name, {"unknown_label": F.col("label").isin(labels), "invalid_kind": F.col("kind").isin(*KINDS), "invalid_scene_layer": F.col("scene_layer").isin(*LAYERS), "invalid_origin": F.col("origin").isin(*ORIGINS), "missing_exclusion_reason": F.coalesce("eligible", F.lit(True)) | F.col("exclusion_reason").isNotNull()}),
        anchored.filter(F.lit(anchoring == "blind")).select(name.alias("entity"), F.lit("reference_annotated_against_predictions").alias("code")),
    )
    if blind and anchoring != "blind":
        found = found.unionByName(images.limit(1).select(F.lit("panel").alias("entity"), F.lit("prediction_assisted_panel_cannot_claim_blind").alias("code")))
    return found


def box_rules(box: str, width, height) -> dict[str, Column]:
    return {"invalid_box": g.box_fault(box, width, height).isNull()}


def sweep_faults(planned: DataFrame, visited: DataFrame, keys: list[str], tile: str = "job") -> DataFrame:
    """(keys, unknown, missing): visited tiles that were not planned, and planned ones not visited, sorted."""
    a = planned.groupBy(*keys).agg(F.collect_set(tile).alias("__p"))
    b = visited.groupBy(*keys).agg(F.collect_set(tile).alias("__v"))
    joined = a.join(b, keys, "full_outer")
    empty = F.array().cast("array<string>")
    p, v = F.coalesce("__p", empty), F.coalesce("__v", empty)
    return joined.select(*keys, F.array_sort(F.array_except(v, p)).alias("unknown"), F.array_sort(F.array_except(p, v)).alias("missing")).filter("size(unknown) > 0 or size(missing) > 0")
