"""Known answers, brute force and properties of the box operators."""

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from quadrat.functions import geometry as g
from quadrat.functions import labels as lb
from quadrat.functions import stats, text
from quadrat.operators import accept, adapters, assignment, cluster, diagnose, evaluate, review, search, spatial, tiles, validate, verify
from quadrat.plans import rules
from quadrat.plans import spatial as plans
from quadrat.sources import bridge, readers, writers
from quadrat.sources.bridge import ONTOLOGY
from quadrat.streaming import boxes as stream

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lit(*b):
    return g.box(*(F.lit(float(x)) for x in b))


# ---- expressions ----


def test_iou_and_ios(spark):
    assert value(spark, g.iou(lit(0, 0, 2, 2), lit(1, 1, 3, 3))) == 1 / 7
    assert value(spark, g.iou(lit(0, 0, 0, 0), lit(0, 0, 0, 0))) == 0
    assert value(spark, g.ios(lit(0, 0, 40, 80), lit(10, 10, 30, 40))) == 1
    assert value(spark, g.iou(lit(0, 0, 1, 1), lit(5, 5, 6, 6))) == 0


def test_size_bins_edges(spark):
    assert [value(spark, g.size_bin(lit(0, 0, s, s))) for s in (10, 16, 20, 32, 50, 96, 200)] == ["<16", "16-32", "16-32", "32-96", "32-96", ">=96", ">=96"]


def test_box_faults(spark):
    bad = [(-1, 0, 5, 5), (0, 0, 0, 5), (5, 0, 4, 5), (0, 0, 11, 5), (float("nan"), 0, 5, 5), (0, 0, float("inf"), 5)]
    assert [value(spark, g.box_fault(lit(*b), F.lit(10), F.lit(10))) for b in bad] == ["invalid_box"] * 6
    assert value(spark, g.box_fault(lit(0, 0, 10, 10), F.lit(10), F.lit(10))) is None


def test_transform_rejects_and_turns(spark):
    with pytest.raises(ValueError, match="invalid_transform"):
        g.transform(lit(0, 0, 1, 1), ((1, 0, 0), (2, 0, 0), (0, 0, 1)))
    turned = value(spark, g.transform(lit(1, 2, 3, 4), ((0, -1, 10), (1, 0, 0), (0, 0, 1))))
    assert tuple(turned) == (6, 1, 8, 3)


def test_yolo_line(spark):
    assert value(spark, g.to_yolo(lit(10, 20, 30, 60), F.lit(100), F.lit(200), F.lit(1))) == "1 0.200000 0.200000 0.200000 0.200000"


def test_naming(spark):
    def named(scores, ratio=0.6):
        column = F.create_map(*(F.lit(x) for kv in scores.items() for x in kv))
        return value(spark, lb.resolve(ONTOLOGY, column, ratio)).label

    assert named({"car": 0.40, "van": 0.05}) == "car"
    assert named({"car": 0.40, "van": 0.36}) == "vehicle"
    assert named({"person": 0.30, "car": 0.29}) == "unknown_object"
    assert named({"car": 0.30, "vehicle": 0.29}) == "vehicle"
    assert named({"car": 0.40, "van": 0.36}, 1.0) == "car"
    assert named({"person": 0.30, "truck": 0.29}) == "person"


def test_ancestry():
    assert ONTOLOGY.ancestry("car") == ["car", "vehicle", "entity"]
    with pytest.raises(ValueError, match="unknown_class"):
        ONTOLOGY.ancestry("boat")
    assert lb.Ontology("c", (("a", "b", True), ("b", "a", True))).ancestry("a") == ["a", "b"]


def test_statistics(spark):
    low, high = value(spark, stats.wilson(F.lit(0), F.lit(0)))
    assert (low, high) == (0, 1)
    low, high = value(spark, stats.wilson(F.lit(0), F.lit(10)))
    assert low == 0 and 0.2 < high < 0.35
    assert value(spark, stats.ratio(F.lit(1), F.lit(0))) is None
    assert value(spark, stats.harmonic(F.lit(0.5), F.lit(0.0))) == 0
    bins = [(0, 0.5, 0.2), (0.5, 1, 0.9)]
    assert [value(spark, stats.binned(F.lit(x), bins)) for x in (0.0, 0.5, 1.0, 1.5, -0.1)] == [0.2, 0.9, 0.9, 0.9, None]


def test_text(spark):
    assert value(spark, text.build_prompt(F.array(F.lit(" Car. "), F.lit("a VAN")))) == "car. a van."
    phrases = F.array(*map(F.lit, ("bus", "minibus", "person")))
    spans = ["Minibus.", "a person", "the minibus stop", "tree", ""]
    assert [value(spark, text.map_span(F.lit(s), phrases)) for s in spans] == ["minibus", "person", "minibus", None, None]
    faults = ["", "/a", "a/../b", "..", "a/b"]
    assert [value(spark, text.path_fault(F.lit(p))) is None for p in faults] == [False, False, False, False, True]
    assert value(spark, text.canonical(b=F.lit(1), a=F.lit(None).cast("string"))) == '{"a":null,"b":1}'


# ---- tiles ----


def test_tile_plans(spark):
    images = spark.createDataFrame([(1, 1360, 765), (2, 765, 1360), (3, 1024, 1024), (4, 10, 10)], "image_id long, width long, height long")
    plan = tiles.plan_tiles(images, levels=2)
    counts = {(r.image_id, r.level): r["count"] for r in plan.groupBy("image_id", "level").count().collect()}
    assert counts[(1, 1)] == counts[(2, 1)] == 6 and counts[(3, 1)] == 4 and counts[(3, 2)] == 9
    last = plan.filter("image_id = 1 and level = 1").agg(F.max("job_box.x2"), F.max("job_box.y2"), F.max("job")).first()
    assert tuple(last) == (1360, 765, "L1-r1c2")
    for level in (1, 2):
        covered = {r.image_id: r.covered_area for r in tiles.covered(plan.filter(F.col("level") == level), ["image_id"]).collect()}
        assert covered == {1: 1360 * 765, 2: 1360 * 765, 3: 1024**2, 4: 100}


def test_coverage_by_pixels(spark):
    rnd = random.Random(5)
    rows, want = [], {}
    for image in range(6):
        grid = np.zeros((40, 40), bool)
        for _ in range(rnd.randint(1, 12)):
            x, y, w, h = rnd.randint(0, 30), rnd.randint(0, 30), rnd.randint(1, 10), rnd.randint(1, 10)
            rows.append((image, (float(x), float(y), float(x + w), float(y + h))))
            grid[y : y + h, x : x + w] = True
        want[image] = int(grid.sum())
    df = spark.createDataFrame(rows, f"image_id int, job_box {BOX}")
    assert {r.image_id: r.covered_area for r in tiles.covered(df, ["image_id"]).collect()} == want


def test_windows_cover_and_do_not_repeat(spark):
    images = spark.createDataFrame([(1, 100, 100), (2, 700, 500)], "image_id long, width long, height long")
    rows = tiles.plan_windows(images, 256).collect()
    assert sum(r.image_id == 1 for r in rows) == 1 and len({(r.image_id, tuple(r.window)) for r in rows}) == len(rows)
    assert max(r.window.x2 for r in rows if r.image_id == 2) == 700


# ---- assignment ----


def brute_matching(a, b, w):
    best = (0, 0.0)
    edges = list(zip(a, b, w))
    for size in range(min(len(set(a)), len(set(b))), 0, -1):
        found = [sum(x[2] for x in some) for some in itertools.combinations(edges, size) if len({x[0] for x in some}) == len({x[1] for x in some}) == size]
        if found:
            return size, max(found)
    return best


def test_assignment_is_maximum_then_heaviest():
    rnd = random.Random(6)
    for _ in range(150):
        pairs = rnd.sample([(i, j) for i in range(4) for j in range(4)], rnd.randint(1, 9))
        a, b = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
        w = np.array([rnd.choice([0.5, 0.6, 0.75, rnd.random()]) for _ in pairs])
        taken = assignment.assign_edges(a, b, w)
        assert len(set(a[taken])) == len(set(b[taken])) == taken.sum()
        size, total = brute_matching(a.tolist(), b.tolist(), w.tolist())
        assert taken.sum() == size and abs(w[taken].sum() - total) < 1e-9


def test_greedy_would_lose_a_pair(spark):
    rows = [(1, 0, 0, 0.9), (1, 0, 1, 0.8), (1, 1, 0, 0.7), (2, 5, 5, 0.6)]
    df = spark.createDataFrame(rows, "image_id long, pos int, ref int, iou double")
    got = sorted((r.image_id, r.pos, r.ref) for r in assignment.match(df, ["image_id"], "pos", "ref").collect())
    assert got == [(1, 0, 1), (1, 1, 0), (2, 5, 5)]


def test_runs_survive_small_batches(spark):
    rnd = random.Random(8)
    rows = [(k, i, rnd.randint(0, 3), 0.5 + rnd.random() / 2) for k in range(40) for i in range(rnd.randint(1, 6))]
    df = spark.createDataFrame(rows, "image_id long, pos int, ref int, iou double")
    want = sorted(map(tuple, assignment.match(df, ["image_id"], "pos", "ref").collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(map(tuple, assignment.match(df, ["image_id"], "pos", "ref").collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# ---- clustering ----


def observations(spark, rows):
    return spark.createDataFrame([(1, i, label, s, edge, tuple(map(float, b))) for i, label, s, edge, b in rows], f"image_id long, id string, label string, score double, view_edge boolean, box {BOX}")


def leads(df, **more):
    return {r.id: (r.lead, r.reason, r.label) for r in cluster.merge(df, **more).collect()}


def test_truncation_decides(spark):
    inside = [("a", "car", 0.9, False, (0, 0, 40, 80)), ("b", "car", 0.8, False, (10, 10, 30, 40))]
    assert {x[0] for x in leads(observations(spark, inside)).values()} == {"a", "b"}
    flagged = [inside[0], ("b", "car", 0.8, True, (10, 10, 30, 40))]
    assert leads(observations(spark, flagged))["b"][:2] == ("a", "view_edge_truncation")
    close = [("a", "car", 0.9, False, (0, 0, 50, 50)), ("b", "car", 0.8, False, (3, 3, 52, 52))]
    assert leads(observations(spark, close))["b"][:2] == ("a", "iou_agreement")


def test_broader_class_across_views(spark):
    rows = [("a", "car", 0.9, False, (0, 0, 50, 50)), ("b", "van", 0.8, False, (1, 1, 50, 50)), ("c", "truck", 0.7, False, (0, 0, 50, 49)), ("d", "person", 0.6, False, (0, 0, 50, 50))]
    got = leads(observations(spark, rows), ontology=ONTOLOGY)
    assert got["b"] == ("a", "iou_agreement+broader_class_across_views", "vehicle")
    assert got["c"][0] == "a" and got["d"][0] == "d"
    assert leads(observations(spark, rows))["b"][0] == "b"


def test_ids_order_as_text(spark):
    rows = [("x-2", "car", 0.5, False, (0, 0, 10, 10)), ("x-10", "car", 0.5, False, (0, 0, 10, 10))]
    assert leads(observations(spark, rows))["x-2"][0] == "x-10"


def test_rounds_and_fusion(spark):
    rows = [("a", "car", 0.9, False, (0, 0, 10, 10)), ("b", "car", 0.6, True, (2, 0, 12, 10)), ("c", "car", 0.3, False, (4, 0, 14, 10))]
    once = cluster.merge(observations(spark, rows)).collect()
    assert {r.id: r.lead for r in once} == {"a": "a", "b": "a", "c": "c"}
    fused = cluster.merge(observations(spark, rows), fuse=True, rounds=2).collect()
    assert {r.id: r.lead for r in fused} == {"a": "a", "b": "a", "c": "a"}


# ---- joins ----


def test_grid_join_equals_plain_join(spark):
    rnd = random.Random(9)
    box = lambda: (x := rnd.randint(0, 90), y := rnd.randint(0, 90), x + rnd.randint(1, 30), y + rnd.randint(1, 30))
    kind = "struct<x1:int,y1:int,x2:int,y2:int>"
    a = spark.createDataFrame([(k % 3, k, box()) for k in range(120)], f"image_id int, a int, box {kind}")
    b = spark.createDataFrame([(k % 3, k, box()) for k in range(120)], f"image_id int, b int, ref_box {kind}")
    plain = sorted((r.a, r.b) for r in spatial.overlap_join(a, b).collect())
    assert plain and sorted((r.a, r.b) for r in spatial.overlap_join(a, b, cell=16).collect()) == plain


def test_knn_vote_beats_nearest(spark):
    bank = spark.createDataFrame([(1, [1.0, 0.0], "truck"), (2, [0.9, 0.1], "car"), (3, [0.89, 0.1], "car"), (4, [0.0, 1.0], "van")], "id long, vector array<double>, label string")
    r = spatial.knn_vote(spark.createDataFrame([(9, [1.0, 0.0])], "id long, vector array<double>"), bank, k=3).first()
    assert (r.label, r.votes, r.runner_up) == ("car", 2, "truck")


def test_knn_vote_of_all(spark, sf, monkeypatch):
    """Every vector of the table gets the label its five nearest others vote for, with the bank whole and in parts."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    e = np.array([r.embedding for r in rows], np.float64)
    want = {}
    for i, r in enumerate(rows):
        near = sorted((-float(x), o.vec_id, f"c{o.label}") for x, o in zip(e @ e[i], rows) if o.vec_id != r.vec_id)[:5]
        votes = {c: (sum(n[2] == c for n in near), max(-n[0] for n in near if n[2] == c), c) for _, _, c in near}
        ranked = sorted(votes.values(), reverse=True)
        want[r.vec_id] = (ranked[0][2], ranked[0][0], ranked[1][2] if len(ranked) > 1 else None)
    for bank in (spatial.BANK_BYTES, 100_000):
        monkeypatch.setattr(spatial, "BANK_BYTES", bank)
        got = {r.id: (r.label, r.votes, r.runner_up) for r in plans.QUERIES["join_knn_vote"](spark, sf).collect()}
        assert len(want) == len(rows) and got == want


def test_bank_in_parts(spark, monkeypatch):
    rnd = random.Random(10)
    bank = spark.createDataFrame([(i, [rnd.random(), rnd.random()], f"l{i % 4}") for i in range(50)], "id long, vector array<double>, label string")
    q = spark.createDataFrame([(100 + i, [rnd.random(), rnd.random()]) for i in range(10)], "id long, vector array<double>")
    whole = sorted(map(tuple, spatial.knn_vote(q, bank).collect()))
    monkeypatch.setattr(spatial, "BANK_BYTES", 1000)
    assert sorted(map(tuple, spatial.knn_vote(q, bank).collect())) == whole


# ---- evaluation on a hand-made benchmark ----


def test_benchmark_by_hand(spark, tmp_path):
    size, cup = [100, 100], [10, 10, 50, 50]
    ref = lambda i, b, labels: {"id": i, "bbox_xyxy": b, "permitted_labels": labels, "eligible": True}
    pred = lambda i, b, label, kind="instance", status="accepted": {"id": i, "bbox_xyxy": b, "label": label, "kind": kind, "status": status, "scene_layer": "physical"}
    common = {"split": "evaluation", "domain": "d", "size": size}
    images = [
        {"id": "first", "sha256": "a", "scene_id": "a", "near_duplicate_group": "a", "run_status": "completed", **common, "references": [ref("r1", cup, ["car"]), ref("r2", [60, 60, 90, 90], ["person"])], "predictions": [pred("p1", cup, "car"), pred("p2", cup, "car"), pred("p3", [60, 60, 90, 90], "unknown_object", status="uncertain"), pred("p4", [0, 0, 99, 99], "car", "group", "uncertain")]},
        {"id": "missing", "sha256": "b", "scene_id": "b", "near_duplicate_group": "b", **common, "references": [ref("r3", cup, ["car"])], "predictions": []},
    ]
    path = tmp_path / "b.json"
    path.write_text(json.dumps({"schema_version": "v", "frozen": True, "images": images}, indent=1))
    header, im, refs, preds = readers.benchmark(spark, str(path))
    assert header.first().frozen and {r.image_id: r.run_status for r in im.collect()} == {"first": "completed", "missing": "missing"}
    counts = evaluate.image_counts(im, refs, preds)
    got = {r.metric: (r.numerator, r.denominator) for r in evaluate.metrics(counts).filter("is_total").collect()}
    assert got["localized_instance_recall"] == (2, 3) and got["final_instance_precision"] == (2, 3)
    assert got["accepted_annotation_precision"] == (1, 2) and got["useful_label_coverage"] == (1, 3)
    assert got["classification_accuracy"] == (1, 2) and got["duplicate_rate"] == (1, 3)
    rows = {r["metric"]: r for r in evaluate.bootstrap(counts, 30, 0, anchored=True)}
    assert rows["localized_instance_recall"]["interval_status"] == "not_interpretable_anchored_panel"
    assert rows["final_instance_precision"]["value"] == 2 / 3
    with pytest.raises(ValueError, match="no_evaluation_images"):
        evaluate.bootstrap(counts.limit(0), 1)


# ---- diagnosis, verification, audit ----


def test_miss_buckets(spark):
    refs = spark.createDataFrame([(1, k, (0.0, 100.0 * k, 50.0, 100.0 * k + 50.0)) for k in range(5)], f"image_id long, ref int, ref_box {BOX}")
    rows = [(1, 0, (0.0, 0.0, 50.0, 50.0), 0.9, "retained"), (1, 1, (0.0, 100.0, 50.0, 120.0), 0.9, "retained"), (1, 2, (0.0, 200.0, 50.0, 250.0), 0.1, "retained"), (1, 3, (0.0, 300.0, 50.0, 350.0), 0.9, "merged")]
    probe = spark.createDataFrame(rows, f"image_id long, pos int, box {BOX}, score double, disposition string")
    retained = probe.filter("pos < 2")
    got = {r.ref: r.bucket for r in diagnose.attribute_misses(refs, retained, probe, 0.5).collect()}
    assert got == {1: "localized_below_match", 2: "below_threshold", 3: "merged_away", 4: "never_proposed"}


def test_pruners(spark):
    refs = spark.createDataFrame([(1, k, (0.0, 100.0 * k, 50.0, 100.0 * k + 50.0)) for k in range(4)], f"image_id long, ref int, ref_box {BOX}")
    boxes = [(1, k, (0.0, 100.0 * (k % 4) + (0 if k < 4 else 50), 50.0, 100.0 * (k % 4) + (50 if k < 4 else 100)), 1.0 if k < 4 else 0.0) for k in range(8)]
    df = spark.createDataFrame(boxes, f"image_id long, pos int, box {BOX}, score double")
    at = spark.createDataFrame([(0.5,)], "threshold double")
    assert diagnose.selectivity(df, refs, at).first().selectivity == 1.0
    assert diagnose.selectivity(df.withColumn("score", 1 - F.col("score")), refs, at).first().selectivity == -1.0
    assert diagnose.selectivity(df.withColumn("score", F.lit(1.0)), refs, at).first().selectivity == 0.0


def test_verification_by_hand(spark):
    rows = [("true_positive", i < 8, "car", "<16") for i in range(10)] + [("undecided", i < 20, "van", "<16") for i in range(100)]
    r = verify.summarise(spark.createDataFrame(rows, "known string, confirmed boolean, label string, size_bin string")).first()
    assert r.sensitivity == 0.8 and r.implied_real == 25 and round(r.precision_if_confirmed, 4) == 0.2727


def test_audit_by_hand(spark):
    verdicts = spark.createDataFrame([("false",)] * 50, "verdict string")
    r = verify.estimate_precision(verdicts, 100, 1000).first()
    assert r.corrected_precision == 0.1 and r.low == 0.1 and 0.1 < r.high < 0.2


def test_quantiles_of_a_few_rows(spark):
    rows = spark.createDataFrame([(float(x),) for x in (3, 1, 2, 2)] + [(None,)], "score double")
    got = [r.threshold for r in diagnose.score_quantiles(rows, 4).collect()]
    assert got == [1.0, 2.0, 3.0] and diagnose.score_quantiles(rows.limit(0), 4).collect() == []
    rnd = random.Random(2)
    values = [rnd.random() for _ in range(500)]
    got = [r.threshold for r in diagnose.score_quantiles(spark.createDataFrame([(x,) for x in values], "score double").repartition(6), 20).collect()]
    assert len(got) == 20 and max(abs(a - b) for a, b in zip(got, np.quantile(values, [i / 19 for i in range(20)]))) < 1e-12


def test_running_sum_by_range(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", None]), i, rnd.randint(1, 9)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, o int, n long")
    got = {(r.k, r.o): r.run for r in review.global_sum(df, ["k"], [F.col("o").desc()], "n", "run").collect()}
    assert got == {(k, o): sum(m for j, p, m in rows if j == k and p >= o) for k, o, _ in rows}


def test_highest_threshold(spark):
    rows = spark.createDataFrame([(s / 10, True) for s in range(1, 11)] + [(None, True), (0.99, False)], "score double, known boolean")
    got = {r.target: r.threshold for r in diagnose.highest_threshold(rows, [0.5, 0.9]).collect()}
    assert got[0.5] == 0.5 and got[0.9] == 0.3


# ---- acceptance, review, samples ----


def test_review_order(spark):
    rows = [(1, 0, 2, True, 0.9, 0.9), (1, 1, 3, True, 0.9, 0.9), (1, 2, 3, None, None, 0.9), (2, 0, 3, False, None, 0.1)]
    df = spark.createDataFrame([(*r, (0.0, 0.0, 5.0, 5.0)) for r in rows], f"image_id long, pos int, unresolved int, verified boolean, verifier_overlap double, score double, box {BOX}")
    own = {(r.image_id, r.pos): r.rank for r in review.queue(df, ["image_id"]).collect()}
    assert own == {(1, 2): 1, (1, 1): 2, (1, 0): 3, (2, 0): 1}
    pooled = {(r.image_id, r.pos): r.rank for r in review.queue(df, ["image_id"], pooled=True).collect()}
    assert pooled == {(2, 0): 1, (1, 2): 2, (1, 1): 3, (1, 0): 4}


def test_refinement(spark):
    objects = spark.createDataFrame([(1, (0.0, 0.0, 10.0, 10.0), [])], f"id int, box {BOX}, alternatives array<{BOX}>")
    refined = spark.createDataFrame([(1, (0.0, 0.0, 10.0, 5.0))], f"id int, refined_box {BOX}")
    r = accept.refine(objects, refined, ["id"], 20, 20).first()
    assert r.refined and r.extent_disagreement and tuple(r.box) == (0, 0, 10, 5) and tuple(r.alternatives[0]) == (0, 0, 10, 10)
    r = accept.refine(objects, spark.createDataFrame([(1, (0.0, 0.0, 99.0, 5.0))], f"id int, refined_box {BOX}"), ["id"], 20, 20).first()
    assert r.rejected and not r.refined and tuple(r.box) == (0, 0, 10, 10)


def test_sample_reaches_every_stratum(spark):
    df = spark.createDataFrame([(i, "rare" if i < 2 else "common") for i in range(1000)], "id int, label string")
    a = review.stratified_sample(df, 50, ["label"], ["id"], 1).collect()
    assert len(a) <= 50 + 1 and {r.label for r in a} == {"rare", "common"}
    assert sorted(a) == sorted(review.stratified_sample(df.repartition(5), 50, ["label"], ["id"], 1).collect())
    assert review.stratified_sample(df, 5000, ["label"], ["id"]).count() == 1000
    with pytest.raises(ValueError, match="invalid_sample_size"):
        review.stratified_sample(df, 0, ["label"], ["id"])


def on_cycles(edges):
    """Nodes that reach themselves, by a search from each."""
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    found = set()
    for first in after:
        left, seen = [first], set()
        while left:
            for x in after.get(left.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    left.append(x)
        if first in seen:
            found.add(first)
    return sorted(found)


def test_cycles(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 1), (7, 7), (1, 2), (None, 4), (5, None)]
    df = spark.createDataFrame(edges, "src int, dst int")
    for local in (validate.LOCAL_EDGES, 0):
        assert sorted(r.src for r in validate.cycles(df, local=local).collect()) == [1, 2, 3, 7]
        assert validate.cycles(df.limit(0), local=local).collect() == []


def test_cycles_of_any_length_and_shape(spark):
    """Rings with paths that leave and enter, and a random graph with dense and chained parts, on the driver and distributed."""
    ring = [(i, (i + 1) % 300) for i in range(300)] + [(5, 1000), (1000, 1001), (2000, 2001), (2001, 7), (1001, 1002)]
    df = spark.createDataFrame(ring, "src long, dst long")
    assert sorted(r.src for r in validate.cycles(df).collect()) == list(range(300))
    assert sorted(r.src for r in validate.cycles(df, local=150).collect()) == list(range(300))
    rnd = random.Random(8)
    mixed = [(rnd.randint(0, 9), rnd.randint(0, 9)) for _ in range(16)] + [(40, 41), (41, 42), (42, 40), (41, 3), (60, 61), (61, 60), (62, 60), (70, 70)]
    df = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in mixed], "src string, dst string")
    want = sorted(f"n{i}" for i in on_cycles(mixed))
    for local in (validate.LOCAL_EDGES, 0):
        assert sorted(r.src for r in validate.cycles(df, local=local).collect()) == want


def test_coordinate_ascent():
    calls = []

    def evaluate_(v):
        calls.append(v)
        return {"a": 1, "b": 3, "c": 2}[v["x"]] + {"p": 0, "q": 5}[v["y"]]

    best, trace = search.coordinate_ascent(["x", "y"], {"x": ["a", "b", "c"], "y": ["p", "q"]}, evaluate_, {"x": "a", "y": "p"})
    assert best == {"x": "b", "y": "q"} and len({tuple(sorted(c.items())) for c in calls}) == len(calls) and trace


class Fake:
    def predict(self, content):
        if content == b"bad":
            raise ValueError("no image")
        return [{"bbox_xyxy": [0, 1, 5, 6], "label": "car", "score": 0.5, "class_scores": {"car": 0.5}}]

    def refine(self, content, boxes):
        return [{"bbox_xyxy": [b[0] + 1, b[1], b[2], b[3]], "quality": 0.9} if b[0] else None for b in boxes]


def test_adapters(spark):
    views = spark.createDataFrame([(1, "full", bytearray(b"x"), (10.0, 20.0, 50.0, 60.0)), (2, "full", bytearray(b"bad"), (0.0, 0.0, 9.0, 9.0))], f"image_id long, job string, content binary, job_box {BOX}")
    seen, failed = adapters.discover(views, "fake", Fake)
    r = seen.first()
    assert (r.id, tuple(r.box), r.view_edge) == ("full-0", (10, 21, 15, 26), True) and failed.first().error == "ValueError: no image"
    boxes = spark.createDataFrame([(1, "a", 0, (12.0, 22.0, 14.0, 24.0)), (1, "b", 0, (10.0, 22.0, 14.0, 24.0))], f"image_id long, id string, pos int, box {BOX}")
    windows = spark.createDataFrame([(1, 0, (10.0, 20.0, 50.0, 60.0), bytearray(b"x"))], f"image_id long, pos int, window {BOX}, content binary")
    made = adapters.per_window(boxes, windows, "fake", Fake).collect()
    assert [(r.id, tuple(r.refined_box)) for r in made] == [("a", (13, 22, 14, 24))]
    v = adapters.normalised(spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "vector array<double>")).collect()
    assert [list(r.vector) for r in v] == [[0.6, 0.8], [0.0, 0.0]]
    pairs = spark.createDataFrame([("k", i, float(i)) for i in range(23)], "key string, o int, v double")
    assert adapters.chunked_mean(pairs, ["key"], "v", "o").first()["mean"] == 9.5


# ---- sources and sinks ----


def test_run_documents(spark, tmp_path):
    run = tmp_path / "run1"
    (run / "evidence").mkdir(parents=True)
    obj = {"id": "o1", "kind": "instance", "status": "uncertain", "bbox_xyxy": [0, 0, 5, 5], "label": {"id": "car"}, "uncertainty": {"existence": "supported"}}
    (run / "annotation.json").write_text(json.dumps({"run_id": "r", "objects": [obj, {**obj, "id": "o2"}]}, indent=1))
    lines = [{"id": "a", "disposition": "retained", "bbox_xyxy": [0, 0, 5, 5], "model_score": 0.5}, {"id": "b", "disposition": "merged", "merged_into": "a"}]
    (run / "evidence/candidates.jsonl").write_text("\n".join(map(json.dumps, lines)))
    objects = readers.objects(readers.annotations(spark, f"{tmp_path}/*/annotation.json")).orderBy("pos").collect()
    assert [(r.run, r.id, r.box.x2) for r in objects] == [("run1", "o1", 5), ("run1", "o2", 5)]
    kept = readers.candidates(spark, f"{tmp_path}/*/evidence/candidates.jsonl", "retained").collect()
    assert [(r.run, r.id) for r in kept] == [("run1", "a")]


def test_reference_csv(spark, tmp_path):
    (tmp_path / "i.txt").write_text("1,2,10,10,1,4,0,0\n95,95,50,50,1,4,0,0\n200,2,10,10,1,4,0,0\n1,2\n1,1,5,5,1,99,0,0\n1,1,5,5,1,0,0,0\n")
    dim = spark.createDataFrame([("4", "car", True, ["car"], None), ("0", "ignored", False, [], "region")], "category string, name string, eligible boolean, permitted_labels array<string>, reason string")
    refs, drops = readers.reference_csv(spark, str(tmp_path / "i.txt"), dim, 100, 100)
    assert sorted((r.name, tuple(r.box), r.eligible) for r in refs.collect()) == [("car", (1, 2, 11, 12), True), ("car", (95, 95, 100, 100), True), ("ignored", (1, 1, 6, 6), False)]
    assert {r["drop"]: r.n for r in drops.collect()} == {"short_row": 1, "unknown_category": 1, "degenerate_box": 1}


def test_panel_parquet(spark, tmp_path):
    rows = [("a", "f", 10, 10, ([[0.0, 0.0, 2.0, 3.0], [1.0, 1.0, 1.0, 1.0]], [1, 2])), ("b", "g", 10, 10, ([], []))]
    spark.createDataFrame(rows, "dataset_name string, file_name string, width int, height int, annotations struct<bbox:array<array<double>>,category_id:array<int>>").write.parquet(f"{tmp_path}/p")
    boxes, counts = readers.panel_parquet(spark, f"{tmp_path}/p", ["a"])
    assert [(r.pos, tuple(r.box)) for r in boxes.orderBy("pos").collect()] == [(0, (0, 0, 2, 3)), (1, (1, 1, 2, 2))] and counts.count() == 2


def test_manifest(spark, tmp_path):
    (tmp_path / "m").mkdir()
    for name in ("same", "other", "extra"):
        (tmp_path / "m" / name).write_text(name)
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    manifest = spark.createDataFrame([("same", sha("same")), ("other", sha("x")), ("gone", sha("y"))], "path string, sha256 string")
    got = sorted(map(tuple, readers.manifest_faults(spark, str(tmp_path / "m"), manifest).collect()))
    assert got == [("extra", "unmanifested_model_assets"), ("gone", "missing_asset"), ("other", "asset_hash_mismatch")]


def test_registry_lookup(spark, tmp_path):
    (tmp_path / "v1.json").write_text('{"id": "v1", "adapter": "x"}')
    reg = readers.documents_by_id(spark, f"{tmp_path}/*.json", "id string, adapter string")
    assert readers.lookup(reg, "v1", "unknown_vocabulary").first().adapter == "x"
    with pytest.raises(ValueError, match="unknown_vocabulary: v2"):
        readers.lookup(reg, "v2", "unknown_vocabulary")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    first = writers.write_once(df, f"{tmp_path}/o")
    assert first["sha256"] == writers.write_once(df.orderBy(F.desc("id")), f"{tmp_path}/o2")["sha256"]
    with pytest.raises(Exception, match="(?i)exists"):
        writers.write_once(df, f"{tmp_path}/o")
    objects = spark.createDataFrame([("i", "1", (10.0, 20.0, 30.0, 60.0), "car"), ("i", "2", (0.0, 0.0, 9.0, 9.0), "entity"), ("i", "3", (0.0, 0.0, 9.0, 9.0), "car")], f"image string, id string, box {BOX}, label string").withColumns({"width": F.lit(100), "height": F.lit(200)})
    checks = spark.createDataFrame([("i", "1", True, 0.9, "car"), ("i", "2", True, 0.9, "car")], "image string, id string, confirmed boolean, verifier_score double, verifier_label string")
    objects = objects.withColumn("boundary", F.lit("unresolved"))
    lines, drops = writers.export_labels(objects, checks, {"car": 1}, "drop", "auto", 0.5)
    assert [r.value for r in lines.collect()] == ["1 0.200000 0.200000 0.200000 0.200000"]
    assert {r.reason: r.n for r in drops.collect()} == {"unconfirmed": 1, "unmapped_class:entity": 1}
    writers.write_labels(lines, f"{tmp_path}/labels")
    assert readers.label_lines(spark, f"{tmp_path}/labels/*/*").collect()[0].n == 1


def test_export_arms(spark):
    """Thresholds, parent policies and reasons; an unconfirmed object stays where there is no threshold."""
    rows = [("a", "car", None, None, None), ("b", "van", False, 0.9, "car"), ("c", "van", True, 0.2, "car"), ("d", "vehicle", True, 0.9, "van"), ("e", "vehicle", True, 0.9, "boat"), ("f", "animal", True, 0.9, "car"), ("g", "vehicle", None, None, None)]
    objects = spark.createDataFrame([("i", r[0], (0.0, 0.0, 5.0, 5.0), r[1], 10, 10, "supported" if r[0] != "d" else "unresolved") for r in rows], f"image string, id string, box {BOX}, label string, width int, height int, boundary string")
    checks = spark.createDataFrame([("i", r[0], *r[2:]) for r in rows if r[2] is not None], "image string, id string, confirmed boolean, verifier_score double, verifier_label string")
    sidecar = spark.createDataFrame([("i", "d", "car"), ("i", "e", "boat")], "image string, id string, label string")
    mapping = {"car": 0, "van": 1}

    def arm(policy, threshold=None, retrieval=None):
        lines, drops = writers.export_labels(objects, checks, mapping, policy, "x", threshold, retrieval)
        return {r.id: int(r.value.split()[0]) for r in lines.collect()}, {r.reason: r.n for r in drops.collect()}

    base = {"a": 0, "b": 1, "c": 1}
    assert arm("drop") == (base, {"parent_fallback_dropped": 3, "unmapped_class:animal": 1})
    assert arm("modal") == ({**base, "d": 0, "e": 0, "g": 0}, {"unmapped_class:animal": 1})
    assert arm("verifier_label") == ({**base, "d": 1}, {"parent_fallback_unresolved_by_verifier": 2, "unmapped_class:animal": 1})
    assert arm("retrieval", None, sidecar) == ({**base, "d": 0}, {"parent_fallback_unresolved_by_retrieval": 2, "unmapped_class:animal": 1})
    assert arm("verifier_label", 0.5) == ({"d": 1}, {"unconfirmed": 3, "below_threshold": 1, "parent_fallback_unresolved_by_verifier": 1, "unmapped_class:animal": 1})
    with pytest.raises(ValueError, match="missing_retrieval_sidecar"):
        arm("retrieval")
    lines, drops = writers.export_labels(objects, checks, mapping, "modal", "x")
    images, regions = spark.createDataFrame([("i",), ("j",)], "image string"), spark.createDataFrame([("i", "unsearched"), ("j", "unresolved")], "image string, kind string")
    report = {r.measure: r.n for r in writers.export_report(lines, drops, images, regions).collect()}
    assert report == {"images": 2, "written": 6, "empty_images": 1, "unresolved_boundary": 1, "unsearched_regions": 1, "class:0": 4, "class:1": 2, "dropped:unmapped_class:animal": 1}


def test_incremental_runs_only_what_is_new(spark, tmp_path):
    seen = []

    def run(df):
        seen.append(sorted(r.id for r in df.collect()))
        return df.withColumn("done", F.lit(True))

    for n in (3, 5):
        out = writers.incremental(spark, spark.range(n).withColumn("id", F.col("id")), f"{tmp_path}/done", ["id"], run)
    assert seen == [[0, 1, 2], [3, 4]] and out.count() == 5


def test_stream_sessions_and_repeats(spark, tmp_path):
    rows = [("u", 0), ("u", 60), ("u", 4000), ("v", 10), ("v", 10)]
    df = spark.createDataFrame(rows, "user string, t long").select("user", F.timestamp_seconds(F.col("t") + 1_000_000_000).alias("ts"))
    df.write.parquet(f"{tmp_path}/in")
    for name, mode, made in (("sessions", "complete", lambda s: stream.sessions(s, "ts", ["user"], "10 minutes", "1 second")), ("firsts", "append", lambda s: stream.first_seen(s, "ts", ["user", "ts"], "10 hours"))):
        source = stream.records(spark, f"{tmp_path}/in", df.schema)
        made(source).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.user, r.n) for r in spark.table("sessions").collect()) == [("u", 1), ("u", 2), ("v", 2)]
    assert spark.table("firsts").count() == 4


def test_map_as_canonical_json(spark):
    assert value(spark, text.canonical_map(F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2)))) == '{"a":2,"b":1}'


def test_stream_by_batch(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "image_id int, v string")
    df.write.parquet(f"{tmp_path}/in")
    rows = stream.records(spark, f"{tmp_path}/in", df.schema)
    stream.by_batch(rows, f"{tmp_path}/ck", lambda b: b.groupBy("image_id").count(), f"{tmp_path}/out").awaitTermination()
    assert sorted((r.image_id, r["count"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, 2), (2, 1)]


def a_document():
    """A valid annotation, as a file has it."""
    states = dict.fromkeys(validate.DIMENSIONS, "supported")
    thing = {"kind": "instance", "status": "accepted", "scene_layer": "physical", "bbox_xyxy": [0, 0, 5, 5], "alternative_boxes": [[1, 1, 5, 5]], "label": {"id": "car", "name": "a car"}, "label_alternatives": [], "uncertainty": {**states, "reasons": []}, "evidence_refs": ["c"], "relations": [], "calibrated_estimates": []}
    part = {**thing, "id": "p", "kind": "part", "relations": [{"type": "part_of", "target_id": "o", "evidence_refs": ["c"]}]}
    group = {**thing, "id": "g", "kind": "group", "count": [2, 3]}
    return {
        "schema_version": "1",
        "run_id": "r",
        "image": {"original_size": [20, 10], "normalized_size": [20, 10], "orientation": 1, "orientation_transform": [[1, 0, 0], [0, 1, 0], [0, 0, 1]]},
        "policy": {"id": "p", "version": "1", "sha256": "aa", "definition": {"b": 1, "a": [1, 2]}},
        "ontology": {"id": "o", "version": "1", "sha256": "bb", "definition": {"x": 1}},
        "manifest_ref": "m",
        "qualification": {"id": None, "domain": "d", "status": "unqualified"},
        "execution": {"status": "completed", "reason": "", "failure_refs": []},
        "search": {"profile_id": "once", "status": "profile_complete", "mandatory_planned": 4, "mandatory_completed": 4, "mandatory_failed": 0, "stable_rounds": 0, "coverage_ref": "c", "stop_rule": {}},
        "objects": [{**thing, "id": "o"}, part, group],
        "regions": [{"kind": "unsearched", "bbox_xyxy": [0, 0, 2, 2], "reason": "x", "evidence_refs": ["c"]}],
        "summary": {"by_status": {"accepted": 3}, "by_kind": {"instance": 1, "part": 1, "group": 1}, "by_class": {"car": 3}, "unresolved_objects": 0, "regions": 1, "unsearched_regions": 1, "coverage": dict.fromkeys(validate.COVERAGE_FIELDS, 1), "resources": dict.fromkeys(validate.RESOURCE_FIELDS, None), "calibration": {"status": "applied", "reason": "x"}},
        "artifacts": {"1": {"path": "m", "format": "json", "sha256": "0"}, "2": {"path": "c", "format": "json", "sha256": "0"}},
    }


#: (codes, how a valid document breaks them): a path to a field and what it becomes; DROP takes the field out.
DROP = object()
ESTIMATE = {"event": "the box is right", "probability": 0.5, "calibration_ref": "c", "population": "p"}
FAULTS = [
    ("", []),
    ("invalid_image_size", [("image.original_size", [0, 3])]),
    ("invalid_orientation_transform", [("image.orientation_transform", [[1, 0, 0], [2, 0, 0], [0, 0, 1]])]),
    ("invalid_orientation_transform", [("image.orientation_transform", [[1, 0], [0, 1]])]),
    ("incompatible_policy", [("policy.definition", {"a": [1, 2], "b": 2})]),
    ("unknown_ontology invalid_ontology_label invalid_acceptance", [("ontology.id", "z")]),
    ("incompatible_ontology", [("ontology.sha256", "cc")]),
    ("invalid_calibration_status", [("summary.calibration.status", "maybe")]),
    ("calibrated_estimate_while_calibration_inapplicable calibrated_estimate_without_applied_calibration", [("summary.calibration.status", "inapplicable"), ("objects.0.calibrated_estimates", [ESTIMATE])]),
    ("calibrated_estimate_without_applied_calibration invalid_calibration_status", [("summary.calibration.status", "maybe"), ("objects.0.calibrated_estimates", [ESTIMATE])]),
    ("", [("objects.0.calibrated_estimates", [ESTIMATE])]),
    ("invalid_calibrated_probability", [("objects.0.calibrated_estimates", [{**ESTIMATE, "probability": None}])]),
    ("duplicate_object_id", [("objects.0.id", "g"), ("objects.1.relations.0.target_id", "g")]),
    ("duplicate_artifact_path", [("artifacts.3", {"path": "c", "format": "", "sha256": ""})]),
    ("unsafe_artifact_path", [("artifacts.3", {"path": "../c", "format": "", "sha256": ""})]),
    ("unknown_artifact_reference", [("manifest_ref", "gone")]),
    ("unknown_artifact_reference", [("regions.0.evidence_refs", ["gone"])]),
    ("unknown_artifact_reference", [("objects.1.relations.0.evidence_refs", ["gone"])]),
    ("invalid_box", [("objects.0.bbox_xyxy", [0, 0, 21, 5])]),
    ("invalid_box", [("objects.0.alternative_boxes", [[0, 0, 5]])]),
    ("invalid_box", [("regions.0.bbox_xyxy", [3, 0, 2, 2])]),
    ("mask_validation_not_implemented", [("objects.0.mask_ref", "c")]),
    ("invalid_ontology_label", [("objects.0.label.name", "A car")]),
    ("invalid_ontology_label", [("objects.0.label_alternatives", [{"id": "boat", "name": "boat"}])]),
    ("invalid_acceptance", [("objects.0.uncertainty.boundary", "unresolved")]),
    ("invalid_acceptance unknown_class_supported", [("objects.0.label", {"id": "unknown_object", "name": "thing"}), ("summary.by_class", {"car": 2, "unknown_object": 1})]),
    ("unsupported_flag", [("objects.0.truncated", False)]),
    ("", [("objects.0.occluded", True), ("objects.0.flag_evidence_refs", ["c"])]),
    ("count_only_for_groups", [("objects.0.count", 1)]),
    ("unsupported_group_count", [("objects.2.count", [3, 2])]),
    ("unsupported_group_count", [("objects.2.count", 0)]),
    ("unresolved_group_count", [("objects.2.count", DROP)]),
    ("invalid_relation_target", [("objects.0.relations", [{"type": "worn_by", "target_id": "z", "evidence_refs": ["c"]}])]),
    ("invalid_relation_target", [("objects.0.relations", [{"type": "worn_by", "target_id": "o", "evidence_refs": ["c"]}])]),
    ("missing_part_of", [("objects.1.relations", [])]),
    ("cyclic_part_of", [("objects.0.relations", [{"type": "part_of", "target_id": "p", "evidence_refs": ["c"]}])]),
    ("invalid_job_counts", [("search.mandatory_failed", 1), ("search.status", "budget_exhausted")]),
    ("incomplete_search", [("search.mandatory_completed", 3)]),
    ("false_saturation", [("search.status", "saturated"), ("search.stable_rounds", 1)]),
    ("saturation_profile_not_implemented", [("search.status", "saturated"), ("search.stable_rounds", 1), ("regions.0.kind", "unresolved"), ("summary.unsearched_regions", 0)]),
    ("invalid_failure_state", [("execution.status", "failed"), ("search.status", "failed")]),
    ("", [("execution.status", "failed"), ("search.status", "failed"), ("execution.failure_refs", ["c"])]),
    ("qualification_not_implemented", [("qualification.status", "eligible")]),
    ("qualification_not_implemented", [("qualification.id", "q")]),
    ("summary_missing_coverage", [("summary.coverage", DROP)]),
    ("summary_missing_resources", [("summary.resources", DROP)]),
    ("summary_missing_calibration invalid_calibration_status", [("summary.calibration", DROP)]),
    ("summary_missing_coverage_field", [("summary.coverage.failed_jobs", DROP)]),
    ("summary_missing_resources_field", [("summary.resources.model_calls", DROP)]),
    ("summary_missing_calibration_field", [("summary.calibration.reason", DROP)]),
    ("summary_mismatch", [("summary.by_class.car", 2)]),
    ("summary_mismatch", [("summary.regions", 2)]),
    ("invalid_state", [("objects.0.scene_layer", "painted")]),
]


def changed(document, changes):
    for path, value in changes:
        at, *rest = path.split(".")
        spot = document
        while rest:
            spot, (at, *rest) = spot[int(at) if isinstance(spot, list) else at], rest
        at = int(at) if isinstance(spot, list) else at
        if value is DROP:
            del spot[at]
        else:
            spot[at] = value
    return document


def test_annotation_constraints(spark, tmp_path):
    """Every code, each by a document that breaks it and nothing else unless named."""
    for n, (_, changes) in enumerate(FAULTS):
        (tmp_path / f"run{n}").mkdir()
        (tmp_path / f"run{n}/annotation.json").write_text(json.dumps(changed(a_document(), changes), indent=1))
    documents = readers.annotations(spark, f"{tmp_path}/*/annotation.json")
    registry = spark.createDataFrame([("o", "1", "bb", '{"x":1}', [("car", "a car", True), ("unknown_object", "thing", False)])], "id string, version string, sha256 string, definition string, classes array<struct<id:string,name:string,useful:boolean>>")
    policy = spark.createDataFrame([("p", "1", "aa", '{"a":[1,2],"b":1}')], "id string, version string, sha256 string, definition string")
    found = {}
    for r in validate.annotation(documents, registry, policy, ("never",)).collect():
        found.setdefault(int(r.entity.split("/")[0].removeprefix("run")), set()).add(r.code)
    for n, (codes, changes) in enumerate(FAULTS):
        assert found.get(n, set()) == set(codes.split()), (n, changes)
    assert len({c for codes, _ in FAULTS for c in codes.split()}) >= 37
    assert validate.annotation(documents.limit(0), registry, policy).collect() == []


def test_benchmark_header(spark):
    fine = ("v1", True, True, "independent", ["car"], "why", 3)
    rows = [fine, ("v2", *fine[1:]), ("v1", None, *fine[2:]), (*fine[:3], "made", *fine[4:]), (*fine[:4], ["boat"], *fine[5:]), (*fine[:4], [], *fine[5:]), (*fine[:5], None, 3), (*fine[:4], None, None, 0)]
    header = spark.createDataFrame(rows, "schema_version string, frozen boolean, policy_compatible boolean, reference_provenance string, category_scope array<string>, category_scope_reason string, n_images int")
    assert sorted(r.code for r in validate.benchmark_header(header, ["car"], "v1").collect()) == sorted(["invalid_benchmark_schema", "incompatible_reference", "incompatible_reference", "invalid_category_scope", "invalid_category_scope", "missing_category_scope_reason", "empty_benchmark"])


def test_panel_constraints(spark):
    images = spark.createDataFrame([(1, "a"), (2, "a")], "image_id long, sha256 string")
    notes = spark.createDataFrame([(1, "x", "car", "instance", "physical", "independent", True, None), (1, "y", "boat", "thing", "physical", "accepted_prediction", False, None)], "image_id long, id string, label string, kind string, scene_layer string, origin string, eligible boolean, exclusion_reason string")
    planned = spark.createDataFrame([(1, "r0c0"), (1, "r0c1"), (2, "r0c0")], "image_id long, job string")
    visited = spark.createDataFrame([(1, "r0c0"), (2, "r0c0"), (2, "r9c9")], "image_id long, job string")
    found = sorted(r.code for r in validate.panel(images, notes, planned, visited, ["car"], True, "blind").collect())
    assert found == ["duplicate_image_content", "incomplete_sweep", "invalid_kind", "missing_exclusion_reason", "reference_annotated_against_predictions", "unknown_label", "unknown_review_tile"]
    codes = [r.code for r in validate.panel(images, notes.limit(0), planned, planned, ["car"], True, "assisted").collect()]
    assert "prediction_assisted_panel_cannot_claim_blind" in codes


def test_vocabulary(spark):
    classes = spark.createDataFrame([("car", "car"), ("van", "van")], "class string, name string")
    prompts = spark.createDataFrame([("car", "a car"), ("boat", "x"), ("van", " ")], "class string, prompt string")
    resolved, summary = search.resolve_prompts(classes, prompts)
    assert {r["class"]: r.prompt for r in resolved.collect()} == {"car": "a car", "van": "van"}
    s = summary.first()
    assert list(s.fallbacks) == ["van"] and s.coverage == 0.5 and len(s.identity) == 64
    assert sorted(map(tuple, search.vocabulary_faults(prompts, classes).collect())) == [("boat", "vocabulary_covers_unknown_class"), ("van", "empty_prompt_for_class")]


def test_many_leads_in_one_image(spark):
    """The array shortcut for images of many leads changes nothing."""
    rnd = random.Random(12)
    rows = [(f"o{i}", rnd.choice(["car", "van"]), rnd.random(), rnd.random() < 0.3, (x := rnd.randint(0, 300), y := rnd.randint(0, 300), x + rnd.randint(5, 30), y + rnd.randint(5, 30))) for i in range(400)]
    df = observations(spark, rows)
    fast = leads(df, ontology=ONTOLOGY)
    many, cluster.MANY = cluster.MANY, 10**9
    try:
        assert leads(df, ontology=ONTOLOGY) == fast and len({v[0] for v in fast.values()}) > 100
    finally:
        cluster.MANY = many


def test_alternatives_of_all_leads(spark, sf):
    """All observations lead or are absorbed; alternatives of each lead by brute force over its members."""
    obs = bridge.observations(spark, sf).select("image_id", "idx", "box", "label", "score_milli").collect()
    images = {}
    for r in sorted(obs, key=lambda r: (-r.score_milli, str(r.idx))):
        leads = images.setdefault(r.image_id, [])
        for lead, members in leads:
            w, h = (min(lead.box[k + 2], r.box[k + 2]) - max(lead.box[k], r.box[k]) for k in (0, 1))
            size = sum((x.box[2] - x.box[0]) * (x.box[3] - x.box[1]) for x in (lead, r))
            if lead.label == r.label and w > 0 and h > 0 and 2 * w * h >= size - w * h:
                members.append(tuple(r.box))
                break
        else:
            leads.append((r, []))
    want = {}
    for image, leads in images.items():
        for lead, members in leads:
            others = [b for b in dict.fromkeys(members) if b != tuple(lead.box)][: accept.MOST_ALTERNATIVES]
            if others:
                want[image, lead.idx] = ",".join(":".join(map(str, b)) for b in others)
    got = {(r.image_id, r.idx): r.alternatives for r in rules.QUERIES["accept_alternatives"](spark, sf).collect()}
    assert got == want and any(idx % 10 for _, idx in got)


def test_cycles_of_all_customers(spark, sf):
    ids = [r.c_custkey for r in spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey").collect()]
    after = {i: (i * 7 + 3) % (max(ids) + 1) for i in ids}
    want = set()
    for i in ids:
        at = after[i]
        for _ in ids:
            if at == i or at not in after:
                break
            at = after[at]
        want |= {i} if at == i else set()
    got = [r.src for r in rules.QUERIES["validate_cycles"](spark, sf).collect()]
    assert len(got) > 25 and len(got) == len(set(got)) and set(got) == want
