"""What must not grow with the tables: documents, tasks, calls of Python and generated code."""

import glob

import pytest
from pyspark.sql import functions as F
from quadrat import registry
from quadrat.functions import geometry as g
from quadrat.functions import stats
from quadrat.operators import adapters, cluster, review, spatial
from quadrat.plans import files
from quadrat.sources import bridge, readers


def largest_method(spark, df):
    """Bytes of the largest generated method of a plan; beyond 8000 it is never compiled."""
    parts = df._jdf.queryExecution().debug().codegenToSeq()
    return max(parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size()))


@pytest.fixture
def static(spark):
    old = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    for c, v in old.items():
        spark.conf.set(c, v)


def test_a_run_is_several_documents(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "DOCUMENT_OBJECTS", 200)
    monkeypatch.setattr(files, "folder", lambda spark: str(tmp_path / "runs"))
    rows = files.src_run_documents(spark, sf).count()
    sizes = [r.n for r in readers.annotations(spark, str(tmp_path / "runs")).select(F.size("objects").alias("n")).collect()]
    assert sum(sizes) == rows and max(sizes) < 400


def test_whole_sums_of_ratios_are_whole(spark):
    df = spark.createDataFrame([(7, 10), (1, 10), (2, 10)], "i long, u long").coalesce(1)
    assert df.agg(stats.thousandths(stats.ratio_sum("i", "u"))).first()[0] == 1000


class Once:
    def refine(self, content, boxes):
        assert len(boxes) <= 2
        return [{"bbox_xyxy": b, "quality": float(content)} if b[0] else None for b in boxes]


def test_refiner_is_called_by_batch(spark):
    box = g.box(*(F.lit(float(v)) for v in (5, 6, 9, 9)))
    windows = spark.createDataFrame([(1, 0, b"1"), (1, 1, b"2"), (2, 0, b"3")], "image_id long, pos int, content binary").withColumn("window", box)
    boxes = spark.createDataFrame([(1, "a", 0, 5.0), (1, "b", 0, 6.0), (1, "c", 0, 7.0), (1, "d", 1, 8.0), (2, "e", 0, 5.0)], "image_id long, id string, pos int, x double").withColumn("box", g.box(F.col("x"), F.lit(6.0), F.lit(9.0), F.lit(9.0)))
    made = adapters.per_window(boxes, windows, "once", Once, 2)
    assert sorted((r.image_id, r.id, r.x1, r.y2, r.quality) for r in made.select("image_id", "id", "refined_box.*", "quality").collect()) == [(1, "b", 6, 9, 1), (1, "c", 7, 9, 1), (1, "d", 8, 9, 2)]
    assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().toString()


def test_few_rows_are_ranked_for_a_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(review, "cut", lambda df, cut=review.cut: seen.append(cut(df)) or seen[-1])
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 1000 == 0, "rare").otherwise("common").alias("s"))
    got = review.stratified_sample(rows, 100, ["s"], ["id"], 3)
    want = []
    for s, quota in (("rare", 1), ("common", 100)):
        want += rows.filter(F.col("s") == s).withColumn("h", review.seeded_order(3, "id")).orderBy("h").limit(quota).collect()
    assert {r.id for r in got.collect()} <= {r.id for r in want} and got.count() == 100 and got.columns == ["id", "s"]
    assert max(df.count() for df in seen) < 500


def test_candidates_of_a_run_are_several_files(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "folder", lambda spark: str(tmp_path / "lines"))
    files.src_candidates(spark, sf)
    assert len(glob.glob(f"{tmp_path}/lines/job=1/part=evidence/part-*")) > 1


def test_tasks_follow_the_bytes_of_a_table(spark, sf, monkeypatch):
    monkeypatch.setattr(bridge, "TASK_BYTES", 4096)
    for made in (bridge.observations, bridge.references):
        assert made(spark, sf).rdd.getNumPartitions() > 8


@pytest.mark.parametrize("name", ["match_per_image", "review_classify", "threshold_per_class"])
def test_generated_methods_are_compiled(name, spark, sf, static):
    assert largest_method(spark, registry.queries()[name](spark, sf)) < 6000


def test_equal_vectors_and_blocks(spark, monkeypatch):
    """Repeated vectors, small blocks and parts: the nearest are those of a sort by similarity and id."""
    monkeypatch.setattr(spatial, "BANK_BLOCK", 7)
    monkeypatch.setattr(spatial, "BANK_BYTES", 1000)
    rows = [(i, [float(i % 5), float(i * i % 7)], f"l{i % 3}") for i in range(60)]
    v = spark.createDataFrame(rows, "id long, vector array<double>, label string")
    got = {r.id: (r.label, r.votes) for r in spatial.knn_vote(v, v, others=True).collect()}
    for i, e, _ in rows:
        near = sorted((-(e[0] * o[0] + e[1] * o[1]), j, name) for j, o, name in rows if j != i)[:5]
        votes = {c: (sum(n[2] == c for n in near), max(-n[0] for n in near if n[2] == c), c) for _, _, c in near}
        assert got[i] == (max(votes.values())[2], max(votes.values())[0])


def test_fold_is_by_label(spark):
    box = g.box(*(F.lit(v) for v in (0, 0, 10, 10)))
    rows = spark.createDataFrame([(1, "a", "car", 5), (1, "b", "car", 9), (1, "c", "van", 7), (1, "d", None, 1), (1, "e", None, 2)], "image_id long, id string, label string, score int").withColumn("box", box)
    made = cluster.merge_fold(rows)
    assert sorted((r.lead, r.label, r.members) for r in made.collect()) == [("b", "car", 2), ("c", "van", 1), ("d", None, 1), ("e", None, 1)]
