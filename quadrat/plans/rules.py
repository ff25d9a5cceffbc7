"""Queries of the label, statistics, text, acceptance and validation operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrat.functions import geometry as g
from quadrat.functions import labels as lb
from quadrat.functions import stats, text
from quadrat.operators import accept, cluster, review, spatial, validate
from quadrat.operators.evaluate import ABSTAIN
from quadrat.sources import writers
from quadrat.sources.bridge import LABELS, OBS, ONTOLOGY, REFS, SIZE, observations, references, table

from .spatial import CONTAIN

QUERIES, SQL = {}, {}
RATIO = 0.6
MAPPING = {"car": 0, "van": 1, "truck": 2}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


#: The class tree for the oracles.
TREE = "tree AS (SELECT * FROM (VALUES ('entity', NULL, false), ('unknown_object', 'entity', false), ('vehicle', 'entity', true), ('person', 'entity', true), ('car', 'vehicle', true), ('van', 'vehicle', true), ('truck', 'vehicle', true)) t(class, parent, useful))"
CLOSURE = f"""{TREE}, up AS (SELECT class, class AS ancestor, 0 AS depth FROM tree UNION ALL SELECT up.class, tree.parent, up.depth + 1 FROM up JOIN tree ON tree.class = up.ancestor WHERE tree.parent IS NOT NULL),
common AS (SELECT a.class AS a, b.class AS b, arg_min(a.ancestor, a.depth) AS c FROM up a JOIN up b ON a.ancestor = b.ancestor GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {CLOSURE} SELECT class, ancestor, depth FROM up")
def label_closure(spark, sf):
    return ONTOLOGY.closure(spark)


@query(SQL["label_closure"])
def label_closure_recursive(spark, sf):
    classes = spark.createDataFrame([(c, p) for c, p, _ in ONTOLOGY.classes], "class string, parent string")
    return validate.ontology_closure(spark, classes)


PAIRS_OF = f"""{OBS}, ab AS (SELECT image_id, idx, label AS a, lead(label) OVER (PARTITION BY image_id ORDER BY idx) AS b FROM obs)"""


@query(f"""WITH RECURSIVE {CLOSURE}, {PAIRS_OF} SELECT image_id, idx, x.a, x.b, c AS ancestor, coalesce((SELECT useful FROM tree WHERE class = c), false) AS useful,
 (least(x.a,x.b) = 'person' AND greatest(x.a,x.b) = 'truck') AS co, CASE WHEN x.a = x.b THEN x.a WHEN c IN ('vehicle','person','car','van','truck') THEN c END AS merged FROM ab x JOIN common ON common.a = x.a AND common.b = x.b""")
def label_pairs(spark, sf):
    from pyspark.sql import Window

    obs = observations(spark, sf).select("image_id", "idx", F.col("label").alias("a"), F.lead("label").over(Window.partitionBy("image_id").orderBy("idx")).alias("b")).filter("b is not null")
    up = lb.common_ancestor(ONTOLOGY, "a", "b")
    return obs.select("image_id", "idx", "a", "b", up.alias("ancestor"), lb.is_useful(ONTOLOGY, up).alias("useful"), lb.co_occurring(ONTOLOGY, "a", "b").alias("co"), lb.mergeable(ONTOLOGY, "a", "b").alias("merged"))


def scored(spark, sf):
    """Observations with a map of class scores in thousandths."""
    n = F.col("score_milli")
    scores = F.create_map(*(x for k, c in enumerate((*LABELS, "vehicle")) for x in (F.lit(c), ((n * (k + 3) + F.col("idx") * 17) % 100 + 1).cast("int"))))
    return observations(spark, sf).withColumn("scores", scores)


RANKED = f"""{OBS}, m AS (SELECT image_id, idx, c, CAST((score_milli*(k+3) + idx*17) % 100 + 1 AS INTEGER) AS s FROM obs, (VALUES (0,'car'),(1,'van'),(2,'truck'),(3,'person'),(4,'vehicle')) v(k, c)),
rk AS (SELECT *, row_number() OVER (PARTITION BY image_id, idx ORDER BY s DESC, c) AS n FROM m),
two AS (SELECT image_id, idx, max(CASE WHEN n=1 THEN c END) AS a, max(CASE WHEN n=1 THEN s END) AS sa, max(CASE WHEN n=2 THEN c END) AS b, max(CASE WHEN n=2 THEN s END) AS sb FROM rk WHERE n <= 2 GROUP BY 1, 2)"""


@query(f"""WITH RECURSIVE {CLOSURE}, {RANKED}, d AS (SELECT two.*, c AS up, CASE WHEN sb / sa < {RATIO} THEN 1 WHEN least(two.a,two.b)='person' AND greatest(two.a,two.b)='truck' THEN 2 WHEN c IN (two.a, two.b) THEN 3 WHEN c IN ('vehicle','person') THEN 4 ELSE 5 END AS k FROM two JOIN common ON common.a = two.a AND common.b = two.b)
SELECT image_id, idx, CASE k WHEN 1 THEN a WHEN 2 THEN a WHEN 3 THEN up WHEN 4 THEN up ELSE 'unknown_object' END AS label, CASE WHEN k = 1 THEN '' ELSE a || ',' || b END AS alternatives,
 CASE k WHEN 1 THEN 'specific_label_clear_of_runner_up' WHEN 2 THEN 'co_occurring_classes_not_competing' WHEN 3 THEN 'broader_of_nested_pair' WHEN 4 THEN 'broader_class_covers_competing_siblings' ELSE 'no_useful_common_ancestor' END AS reason FROM d""")
def label_resolve(spark, sf):
    named = scored(spark, sf).withColumn("named", lb.resolve(ONTOLOGY, "scores", RATIO))
    return named.select("image_id", "idx", "named.label", F.concat_ws(",", "named.alternatives").alias("alternatives"), "named.reason")


@query(f"""WITH {OBS}, {REFS} SELECT CASE WHEN r.permitted IS NULL THEN 'absent' WHEN o.label = r.permitted[1] THEN 'exact' WHEN list_contains(r.permitted, o.label) THEN 'broader' ELSE 'wrong' END AS outcome, count(*) AS n
FROM (SELECT * REPLACE (CASE WHEN idx % 3 = 0 AND label <> 'person' THEN 'vehicle' ELSE label END AS label) FROM obs) o LEFT JOIN refs r ON r.image_id = o.image_id AND r.ref = o.idx % 9 GROUP BY 1""")
def label_score(spark, sf):
    label = F.when((F.col("idx") % 3 == 0) & (F.col("label") != "person"), "vehicle").otherwise(F.col("label"))
    obs = observations(spark, sf).select("image_id", label.alias("label"), (F.col("idx") % 9).alias("ref"))
    joined = obs.join(references(spark, sf).select("image_id", "ref", "permitted"), ["image_id", "ref"], "left")
    return joined.groupBy(lb.score_label("label", "permitted", [c for c, _, _ in ONTOLOGY.classes]).alias("outcome")).agg(F.count("*").alias("n"))


ARM = "CASE {c} WHEN 'car' THEN 0 WHEN 'van' THEN 1 WHEN 'truck' THEN 2 END"
#: Labels as exports see them: the parent on a third of the rows, another label beside.
EXPORTED = "(SELECT *, CASE WHEN idx % 3 = 0 AND label <> 'person' THEN 'vehicle' ELSE label END AS name, (['car','van','truck','person'])[1+idx%4] AS other FROM obs)"
#: What becomes of the parent label: its class, and the reason where that is null.
FALLS = {"drop": ("NULL", "parent_fallback_dropped"), "modal": ("0", ""), "retrieval": (ARM.format(c="other"), "parent_fallback_unresolved_by_retrieval"), "verifier_label": (ARM.format(c="other"), "parent_fallback_unresolved_by_verifier")}


def exported(spark, sf):
    other = F.element_at(F.array(*map(F.lit, LABELS)), F.col("idx") % 4 + 1)
    name = F.when((F.col("idx") % 3 == 0) & (F.col("label") != "person"), "vehicle").otherwise(F.col("label"))
    return observations(spark, sf).withColumns({"name": name, "other": other})


@query(
    f"WITH {OBS}, e AS (SELECT name, other, {ARM.format(c='name')} AS own FROM {EXPORTED})"
    + " UNION ALL ".join(f"""
SELECT '{p}' AS arm, CASE WHEN own IS NOT NULL THEN own WHEN name = 'vehicle' THEN {c} END AS class, CASE WHEN own IS NOT NULL THEN NULL WHEN name <> 'vehicle' THEN 'unmapped_class:' || name WHEN {c} IS NULL THEN '{r}' END AS reason, count(*) AS n FROM e GROUP BY ALL""" for p, (c, r) in FALLS.items())
)
def label_arms(spark, sf):
    rows = exported(spark, sf).select("name", F.col("other").alias("retrieved"), F.col("other").alias("verifier_label"))
    arms = F.array(*(F.struct(F.lit(p).alias("arm"), review.arm_label("name", MAPPING, p).alias("x")) for p in FALLS))
    return rows.select(F.explode(arms).alias("a")).select("a.arm", "a.x.class", "a.x.reason").groupBy("arm", "class", "reason").agg(F.count("*").alias("n"))


#: Verifications: none for every fifth box, else confirmed but for every seventh.
CHECKED = "idx % 5 <> 0 AND idx % 7 <> 0"


@query(f"""WITH {OBS}, e AS (SELECT *, {ARM.format(c='name')} AS own, CASE WHEN name = 'vehicle' AND idx % 2 = 0 THEN {ARM.format(c='other')} END AS voted FROM {EXPORTED}),
j AS (SELECT *, coalesce(own, voted) AS class, CASE WHEN NOT ({CHECKED}) THEN 'unconfirmed' WHEN score_milli < 300 THEN 'below_threshold' WHEN own IS NOT NULL THEN NULL WHEN name <> 'vehicle' THEN 'unmapped_class:' || name WHEN voted IS NULL THEN 'parent_fallback_unresolved_by_retrieval' END AS reason FROM e),
k AS (SELECT * FROM j WHERE reason IS NULL)
SELECT 'images' AS measure, count(DISTINCT image_id) AS n FROM obs UNION ALL SELECT 'written', count(*) FROM k UNION ALL SELECT 'empty_images', (SELECT count(DISTINCT image_id) FROM obs) - (SELECT count(DISTINCT image_id) FROM k)
UNION ALL SELECT 'unresolved_boundary', count(*) FILTER (view_edge) FROM k UNION ALL SELECT 'unsearched_regions', count(*) FILTER (job = 7) FROM obs UNION ALL SELECT 'class:' || class, count(*) FROM k GROUP BY class UNION ALL SELECT 'dropped:' || reason, count(*) FROM j WHERE reason IS NOT NULL GROUP BY reason""")
def export_report(spark, sf):
    """An arm held to the verifier, its parent labels resolved by a retrieval sidecar."""
    rows = exported(spark, sf).withColumnRenamed("image_id", "image").withColumn("id", F.col("idx"))
    objects = rows.select("image", "id", "box", F.col("name").alias("label"), F.lit(SIZE).alias("width"), F.lit(SIZE).alias("height"), F.when(F.col("view_edge"), "unresolved").otherwise("supported").alias("boundary"))
    checks = rows.filter("idx % 5 <> 0").select("image", "id", (F.col("idx") % 7 != 0).alias("confirmed"), (F.col("score_milli") / 1000).alias("verifier_score"), F.col("other").alias("verifier_label"))
    sidecar = rows.filter("idx % 2 = 0").select("image", "id", F.col("other").alias("label"))
    lines, drops = writers.export_labels(objects, checks, MAPPING, "retrieval", "arm", 0.3, sidecar)
    regions = rows.select("image", F.when(F.col("job") == 7, "unsearched").otherwise("unresolved").alias("kind"))
    return writers.export_report(lines, drops, rows.select("image").distinct(), regions).select("measure", "n")


@query(f"""WITH {OBS}, e AS (SELECT label AS a, (['car','van','truck','person'])[1+idx%4] AS b FROM obs), m AS (SELECT {ARM.format(c='a')} AS x, {ARM.format(c='b')} AS y FROM e)
SELECT CASE WHEN x IS NULL AND y IS NULL THEN 'both_outside_schema' WHEN x = y THEN 'agrees' WHEN x IS NULL THEN 'absent_from_export' ELSE 'wrong' END AS outcome, count(*) AS n FROM m GROUP BY 1""")
def label_under_consumer(spark, sf):
    """Agreement of two labels in a coarser schema, by two lookups in its mapping."""
    obs = observations(spark, sf).select(F.col("label").alias("a"), F.element_at(F.array(*map(F.lit, LABELS)), F.col("idx") % 4 + 1).alias("b"))
    schema = spark.createDataFrame(list(MAPPING.items()), "name string, class int")
    both = obs.join(F.broadcast(schema.select(F.col("name").alias("a"), F.col("class").alias("x"))), "a", "left").join(F.broadcast(schema.select(F.col("name").alias("b"), F.col("class").alias("y"))), "b", "left")
    outcome = F.when(F.col("x").isNull() & F.col("y").isNull(), "both_outside_schema").when(F.col("x") == F.col("y"), "agrees").when(F.col("x").isNull(), "absent_from_export").otherwise("wrong")
    return both.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'click') AS k FROM events GROUP BY 1), q AS (SELECT *, k/n AS p, 1 + 1.96*1.96/n AS d FROM p)
SELECT user_id, n, k, CAST(floor(greatest(0.0, (p + 1.96*1.96/(n*2.0))/d - 1.96*sqrt(p*(1.0-p)/n + 1.96*1.96/(n*n*4.0))/d) * 1e9) AS BIGINT) AS low, CAST(floor(least(1.0, (p + 1.96*1.96/(n*2.0))/d + 1.96*sqrt(p*(1.0-p)/n + 1.96*1.96/(n*n*4.0))/d) * 1e9) AS BIGINT) AS high FROM q""")
def math_wilson(spark, sf):
    c = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("k"))
    w = stats.wilson("k", "n")
    return c.select("user_id", "n", "k", F.floor(w["low"] * 1e9).alias("low"), F.floor(w["high"] * 1e9).alias("high"))


@query(f"""WITH {OBS} SELECT CAST(CASE WHEN score_milli < 300 THEN 0.1 WHEN score_milli >= 400 AND score_milli < 700 THEN 0.55 WHEN score_milli >= 700 THEN 0.9 END AS DOUBLE) AS probability, count(*) AS n FROM obs GROUP BY 1""")
def math_calibrated(spark, sf):
    bins = ((0.0, 0.3, 0.1), (0.4, 0.7, 0.55), (0.7, 1.0, 0.9))
    return observations(spark, sf).groupBy(stats.binned(F.col("score_milli") / 1000, bins).alias("probability")).agg(F.count("*").alias("n"))


@query(f"""WITH {OBS}, c AS (SELECT image_id, count(*) AS n, count(*) FILTER (label='car') AS a, count(*) FILTER (view_edge) AS b FROM obs GROUP BY 1)
SELECT image_id, a/n AS car_ratio, CASE WHEN a > 0 AND b > 0 THEN 2.0*(a/n)*(b/n)/((a/n)+(b/n)) ELSE 0.0 END AS harmonic, CASE WHEN b = 0 THEN NULL ELSE a/b END AS per_edge FROM c""")
def math_ratios(spark, sf):
    c = observations(spark, sf).groupBy("image_id").agg(F.count("*").alias("n"), F.count_if(F.col("label") == "car").alias("a"), F.count_if("view_edge").alias("b"))
    return c.select("image_id", stats.ratio("a", "n").alias("car_ratio"), stats.harmonic(stats.ratio("a", "n"), stats.ratio("b", "n")).alias("harmonic"), stats.ratio("a", "b").alias("per_edge"))


@query("""SELECT item_id, sha256(text) AS digest, sha256('{"id":' || item_id || ',"n":' || length(text) || ',"z":null}') AS identity, string_split(replace('s' || item_id || '_x', 's', 'seq'), '_')[1] AS sequence,
 CASE WHEN item_id % 4 = 0 THEN 'unsafe_artifact_path' WHEN item_id % 4 = 1 THEN 'unsafe_artifact_path' END AS fault, CAST(item_id AS VARCHAR) || '.1' AS version FROM benchmark""")
def text_digests(spark, sf):
    b = table(spark, sf, "benchmark")
    path = F.when(F.col("item_id") % 4 == 0, "/abs/x").when(F.col("item_id") % 4 == 1, "a/../b").otherwise("a/b.json")
    made = text.canonical(id=F.col("item_id"), n=F.length("text"), z=F.lit(None).cast("string"))
    return b.select("item_id", text.digest("text").alias("digest"), text.digest(made).alias("identity"), text.stem_sequence(F.concat(F.lit("seq"), F.col("item_id").cast("string"), F.lit("_x"))).alias("sequence"), text.path_fault(path).alias("fault"), text.public_version(F.concat(F.col("item_id").cast("string"), F.lit(".1+local"))).alias("version"))


@query("""SELECT p_partkey, lower(p_type) || '. ' || lower(p_brand) || '.' AS prompt, CASE p_partkey % 5 WHEN 0 THEN 'minibus' WHEN 1 THEN 'motorcycle' WHEN 2 THEN 'bus' WHEN 3 THEN NULL ELSE 'a person' END AS mapped FROM part""")
def text_prompts(spark, sf):
    phrases = F.array(*map(F.lit, ("bus", "minibus", "motorcycle", "a person")))
    span = F.element_at(F.array(*map(F.lit, ("the minibus", "motor", "Bus.", "tree", "person "))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", text.build_prompt(F.array("p_type", F.concat(F.col("p_brand"), F.lit(" .")))).alias("prompt"), text.map_span(span, phrases).alias("mapped")).withColumn("prompt", F.regexp_replace("prompt", " \\.", "."))


def evidence(spark, sf):
    """Objects with evidence, derived from the observations."""
    obs = observations(spark, sf)
    held = spatial.containers(obs, (7, 10), pos="idx")
    x1, y1, x2, y2 = g.parts("box")
    moved = g.box(x1 + F.col("idx") % 5, y1, x2 + F.col("idx") % 5, y2)
    made = obs.join(held.withColumnRenamed("pos", "idx"), ["image_id", "idx"], "left")
    return made.withColumns(
        {
            "id": F.col("idx"),
            "kind": F.when(F.col("idx") % 13 == 0, "group").otherwise("instance"),
            "score": F.col("score_milli") / 1000,
            "views": F.col("job") % 4 + 1,
            "alternatives": F.when(F.col("idx") % 2 == 0, F.array(moved)).otherwise(F.array().cast("array<struct<x1:bigint,y1:bigint,x2:bigint,y2:bigint>>")),
            "useful": F.col("label") != "person",
            "verified": F.when(F.col("idx") % 3 != 0, F.col("idx") % 3 == 1),
            "verifier_overlap": F.when(F.col("idx") % 3 == 1, (F.col("score_milli") % 100) / 100),
        }
    )


#: Deltas of 0 to 4 pixels: IoU (w - d) / (w + d) below 0.8 means 5 (w - d) < 4 (w + d).
ASSESSED = f"""{CONTAIN}, ev AS (SELECT o.*, cn.container, x2-x1 AS w, idx%5 AS d, job%4+1 AS views, score_milli >= 500 AS strong, CASE WHEN idx%3 <> 0 THEN idx%3 = 1 END AS verified, CASE WHEN idx%3 = 1 THEN (score_milli%100)/100 END AS vo FROM obs o LEFT JOIN cn USING (image_id, idx)),
st AS (SELECT *, strong AND views >= 2 AND NOT coalesce(NOT verified, false) AS ex, label <> 'person' AS useful,
 CASE WHEN view_edge THEN 'view_edge_truncation_unresolved' WHEN idx%2=0 AND 5*(w-d) < 4*(w+d) THEN 'multi_view_boundary_disagreement' WHEN coalesce(vo < 0.5, false) THEN 'verifier_extent_disagreement' END AS bd FROM ev)"""


@query(f"""WITH {ASSESSED} SELECT image_id, idx, CASE WHEN ex THEN 'supported' ELSE 'unresolved' END AS existence, CASE WHEN strong AND useful THEN 'supported' ELSE 'unresolved' END AS class, CASE WHEN bd IS NULL THEN 'supported' ELSE 'unresolved' END AS boundary,
 CASE WHEN idx%13=0 THEN 'unresolved' ELSE 'supported' END AS count, CASE WHEN container IS NULL THEN 'supported' ELSE 'unresolved' END AS granularity,
 concat_ws('|', CASE WHEN ex THEN 'reproduced_in_' || views || '_views' WHEN coalesce(NOT verified, false) AND strong AND views >= 2 THEN 'unconfirmed_by_independent_model' WHEN NOT strong THEN 'weak_score' ELSE 'insufficient_view_agreement' END,
  CASE WHEN ex AND coalesce(verified, false) THEN 'confirmed_by_independent_model' END, CASE WHEN NOT useful THEN 'no_useful_class' END, bd, CASE WHEN container IS NULL THEN 'no_competing_containment_in_discovered_set' ELSE 'possible_part_of:' || container END) AS reasons,
 CASE WHEN ex AND useful AND bd IS NULL AND idx%13<>0 AND container IS NULL THEN 'accepted' ELSE 'uncertain' END AS status FROM st""")
def accept_assess(spark, sf):
    done = accept.assess(evidence(spark, sf), 7, {"require_verification": True, "verifier_boundary_iou": 0.5})
    return done.select("image_id", "idx", *accept.DIMENSIONS, F.concat_ws("|", "reasons").alias("reasons"), "status")


@query(f"""WITH {OBS}, p AS (SELECT *, CASE WHEN idx%4=0 THEN NULL ELSE x1 + idx%6 - (CASE WHEN idx%11=0 THEN 500 ELSE 0 END) END AS nx FROM obs), q AS (SELECT *, nx IS NOT NULL AND nx >= 0 AND nx < x2 AS ok, nx IS NOT NULL AS has FROM p)
SELECT image_id, idx, CASE WHEN ok THEN nx ELSE x1 END AS x1, x2, ok AS refined, has AND NOT ok AS rejected, ok AND 10*(x2-nx) < 7*(x2-x1) AS extent_disagreement FROM q""")
def accept_refine(spark, sf):
    obs = observations(spark, sf).withColumn("alternatives", F.array().cast("array<struct<x1:bigint,y1:bigint,x2:bigint,y2:bigint>>"))
    x1, y1, x2, y2 = g.parts("box")
    nx = x1 + F.col("idx") % 6 - F.when(F.col("idx") % 11 == 0, 500).otherwise(0)
    refined = obs.filter("idx % 4 <> 0").select("image_id", "idx", g.box(nx, y1, x2, y2).alias("refined_box"))
    done = accept.refine(obs, refined, ["image_id", "idx"], SIZE, SIZE)
    return done.select("image_id", "idx", "box.x1", "box.x2", "refined", "rejected", "extent_disagreement")


@query()
def accept_alternatives(spark, sf):
    """Alternatives of every lead of the merge, from all members that it absorbed."""
    obs = observations(spark, sf).withColumn("id", F.col("idx").cast("string")).withColumn("score", F.col("score_milli"))
    made = cluster.merge(obs, ios=2.0).select("image_id", F.col("id").cast("int").alias("o"), F.col("lead").cast("int").alias("idx")).filter("o <> idx")
    boxes = obs.select("image_id", "idx", "box", "score")
    absorbed = made.join(boxes.select("image_id", F.col("idx").alias("o"), "box", F.struct(-F.col("score"), F.col("idx").cast("string")).alias("order")), ["image_id", "o"])
    members = absorbed.join(boxes.select("image_id", "idx", F.col("box").alias("kept")), ["image_id", "idx"])
    found = accept.distinct_alternatives(members, ["image_id", "idx"], "box", "kept", "order", SIZE, SIZE)
    return found.select("image_id", "idx", F.array_join(F.transform("alternatives", lambda x: F.concat_ws(":", *(x[e].cast("string") for e in g.EDGES))), ",").alias("alternatives"))


# ---- constraints ----------------------------------------------------------------------------------


@query("""WITH d AS (SELECT doc_id, sha256(text) AS c, source AS s, ['development','calibration','evaluation'][1 + doc_id % 3] AS split FROM documents),
k AS (SELECT 'content=' || c AS entity, split FROM d UNION ALL SELECT 'source=' || s, split FROM d) SELECT entity, 'split_leakage' AS code FROM k GROUP BY 1 HAVING count(DISTINCT split) > 1""")
def validate_leakage(spark, sf):
    split = F.element_at(F.array(*map(F.lit, ("development", "calibration", "evaluation"))), (F.col("doc_id") % 3 + 1).cast("int"))
    images = table(spark, sf, "documents").select(text.digest("text").alias("content"), "source", split.alias("split"))
    return validate.leakage(images, ["content", "source"])


@query(f"""WITH {OBS}, e AS (SELECT image_id || '/' || idx AS entity, * FROM obs)
SELECT entity, 'invalid_box' AS code FROM e WHERE x2 > 64 OR y2 > 64 UNION ALL SELECT entity, 'invalid_accepted_label' FROM e WHERE label = 'person' AND score_milli >= 900
UNION ALL SELECT l_orderkey || '/' || l_linenumber, 'duplicate_record_id' FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'missing_leakage_identity' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def validate_records(spark, sf):
    obs = observations(spark, sf)
    name = F.concat_ws("/", F.col("image_id").cast("string"), F.col("idx").cast("string"))
    line = table(spark, sf, "lineitem")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return validate.violations(
        validate.broken(obs, name, {**validate.box_rules("box", 64, 64), "invalid_accepted_label": ~((F.col("label") == "person") & (F.col("score_milli") >= 900))}),
        validate.duplicates(line, ["l_orderkey", "l_linenumber"], "duplicate_record_id"),
        validate.missing(orders, ["l_orderkey"], line, F.col("l_orderkey"), "missing_leakage_identity"),
    )


@query("""WITH RECURSIVE e AS (SELECT DISTINCT c_custkey AS s, (c_custkey * 7 + 3) % (max(c_custkey) OVER () + 1) AS d FROM customer), w(s, d) AS (SELECT s, d FROM e UNION SELECT w.s, e.d FROM w JOIN e ON w.d = e.s) SELECT DISTINCT s AS src FROM w WHERE s = d""")
def validate_cycles(spark, sf):
    """Customers on a cycle, over one edge of each customer by its own id."""
    customers = table(spark, sf, "customer").select("c_custkey")
    most = customers.agg(F.max("c_custkey").alias("most"))
    return validate.cycles(customers.crossJoin(F.broadcast(most)).select(F.col("c_custkey").alias("src"), ((F.col("c_custkey") * 7 + 3) % (F.col("most") + 1)).alias("dst")))


@query(f"""WITH {OBS}, v AS (SELECT DISTINCT image_id, 'L' || job AS job FROM obs), p AS (SELECT DISTINCT image_id, 'L' || k AS job FROM obs, range(0, 7) AS r(k)),
u AS (SELECT image_id, list(job ORDER BY job) AS l FROM (SELECT * FROM v EXCEPT SELECT * FROM p) GROUP BY 1), m AS (SELECT image_id, list(job ORDER BY job) AS l FROM (SELECT * FROM p EXCEPT SELECT * FROM v) GROUP BY 1)
SELECT image_id, coalesce(array_to_string(u.l, ','), '') AS unknown, coalesce(array_to_string(m.l, ','), '') AS missing FROM u FULL JOIN m USING (image_id)""")
def validate_sweep(spark, sf):
    obs = observations(spark, sf)
    visited = obs.select("image_id", F.concat(F.lit("L"), F.col("job").cast("string")).alias("job"))
    planned = obs.select("image_id").distinct().select("image_id", F.explode(F.array(*(F.lit(f"L{k}") for k in range(7)))).alias("job"))
    found = validate.sweep_faults(planned, visited, ["image_id"])
    return found.select("image_id", F.concat_ws(",", "unknown").alias("unknown"), F.concat_ws(",", "missing").alias("missing"))


@query(f"""WITH {OBS} SELECT count(*) AS final, count(*) FILTER (label IN ('car','person','unknown_object','entity')) AS scored, count(*) FILTER (label NOT IN ('car','person','unknown_object','entity')) AS out_of_scope,
 count(*) FILTER (score_milli > 500) AS strict, count(*) FILTER (score_milli >= 500) AS inclusive FROM obs WHERE idx % 13 <> 0""")
def filter_scope(spark, sf):
    inside = F.col("label").isin("car", "person", *ABSTAIN)
    return observations(spark, sf).filter("idx % 13 <> 0").agg(F.count("*").alias("final"), F.count_if(inside).alias("scored"), F.count_if(~inside).alias("out_of_scope"), F.count_if(F.col("score_milli") > 500).alias("strict"), F.count_if(F.col("score_milli") >= 500).alias("inclusive"))


@query(f"""WITH {OBS}, r AS (SELECT * FROM (VALUES ('car', 400), ('van', 700)) t(label, least)) SELECT label, count(*) AS kept FROM obs LEFT JOIN r USING (label) WHERE idx % 7 <> 0 AND score_milli >= coalesce(least, 550) GROUP BY 1""")
def filter_class_threshold(spark, sf):
    """Per-class thresholds with a global one for the rest; a null score is never kept."""
    rule = spark.createDataFrame([("car", 400), ("van", 700)], "label string, least int")
    score = F.when(F.col("idx") % 7 != 0, F.col("score_milli"))
    kept = observations(spark, sf).join(F.broadcast(rule), "label", "left").filter(score >= F.coalesce("least", F.lit(550)))
    return kept.groupBy("label").agg(F.count("*").alias("kept"))
