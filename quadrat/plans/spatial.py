"""Queries of the geometry, tiling and join operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrat.functions import geometry as g
from quadrat.functions.stats import ratio_sum, thousandths
from quadrat.operators import cluster, spatial, tiles
from quadrat.operators.assignment import match
from quadrat.sources.bridge import OBS, PAIRS, REFS, SIZE, observations, references, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def refs_of(spark, sf):
    return references(spark, sf).withColumnRenamed("box", "ref_box")


def flat(b="box"):
    return [F.col(b)[e].alias(e) for e in g.EDGES]


@query(f"WITH {OBS} SELECT image_id, idx, job, x1, y1, x2, y2, view_edge, score_milli, label FROM obs")
def src_observations(spark, sf):
    return observations(spark, sf).select("image_id", "idx", "job", *flat(), "view_edge", "score_milli", "label")


@query(f"WITH {REFS} SELECT image_id, ref, x1, y1, x2, y2, array_to_string(permitted, ',') AS permitted, eligible FROM refs")
def src_references(spark, sf):
    return references(spark, sf).select("image_id", "ref", *flat(), F.concat_ws(",", "permitted").alias("permitted"), "eligible")


@query(f"""WITH {OBS}, {REFS}, {PAIRS} SELECT image_id, idx, ref, i AS inter, u AS union_area, i / u AS iou,
 i / least((ox2-ox1)*(oy2-oy1), (rx2-rx1)*(ry2-ry1)) AS ios FROM ov""")
def geo_iou_pairs(spark, sf):
    pairs = spatial.overlap_join(observations(spark, sf), refs_of(spark, sf).select("image_id", "ref", "ref_box"))
    return pairs.select("image_id", "idx", "ref", g.intersection("box", "ref_box").alias("inter"), g.union_area("box", "ref_box").alias("union_area"), g.iou("box", "ref_box").alias("iou"), g.ios("box", "ref_box").alias("ios"))


@query(SQL["geo_iou_pairs"].replace("SELECT image_id, idx, ref, i AS inter, u AS union_area, i / u AS iou,\n i / least((ox2-ox1)*(oy2-oy1), (rx2-rx1)*(ry2-ry1)) AS ios FROM ov", "SELECT image_id, idx, ref, i AS inter FROM ov"))
def join_overlap_grid(spark, sf):
    """The overlap join by grid cells, for images of very many boxes."""
    pairs = spatial.overlap_join(observations(spark, sf), refs_of(spark, sf).select("image_id", "ref", "ref_box"), cell=32)
    return pairs.select("image_id", "idx", "ref", g.intersection("box", "ref_box").alias("inter"))


@query(f"""WITH {OBS}, b AS (SELECT image_id, idx, (x2-x1)*(1+idx%9)*(y2-y1)*(1+idx%9) AS area FROM obs)
 SELECT CASE WHEN area < 256 THEN '<16' WHEN area < 1024 THEN '16-32' WHEN area < 9216 THEN '32-96' ELSE '>=96' END AS size_bin, count(*) AS n, CAST(sum(area) AS BIGINT) AS area FROM b GROUP BY 1""")
def geo_size_bin(spark, sf):
    k = 1 + F.col("idx") % 9
    x1, y1, x2, y2 = g.parts("box")
    grown = observations(spark, sf).select(g.box(x1, y1, x1 + (x2 - x1) * k, y1 + (y2 - y1) * k).alias("box"))
    return grown.groupBy(g.size_bin("box").alias("size_bin")).agg(F.count("*").alias("n"), F.sum(g.area("box")).alias("area"))


@query(f"""WITH {OBS} SELECT image_id, idx, (x1 <= 1 OR y1 <= 1 OR x2 >= {SIZE - 1} OR y2 >= {SIZE - 1}) AS touches,
 CASE WHEN x1 >= 0 AND x1 < x2 AND x2 <= 64 AND y1 >= 0 AND y1 < y2 AND y2 <= 64 THEN NULL ELSE 'invalid_box' END AS fault FROM obs""")
def geo_edges_and_faults(spark, sf):
    return observations(spark, sf).select("image_id", "idx", g.touches_edge("box", SIZE, SIZE).alias("touches"), g.box_fault("box", 64, 64).alias("fault"))


@query(f"""WITH {OBS} SELECT image_id, idx, CAST(2.0*x1+3.0 AS DOUBLE) AS x1, CAST(0.5*y1-1.0 AS DOUBLE) AS y1, CAST(2.0*x2+3.0 AS DOUBLE) AS x2, CAST(0.5*y2-1.0 AS DOUBLE) AS y2 FROM obs""")
def geo_transform(spark, sf):
    moved = observations(spark, sf).select("image_id", "idx", g.transform("box", ((2, 0, 3), (0, 0.5, -1), (0, 0, 1))).alias("box"))
    return moved.select("image_id", "idx", *flat())


@query(f"""WITH {OBS} SELECT image_id, idx, printf('%d %.6f %.6f %.6f %.6f', job, (x1+x2)/2.0/{SIZE}, (y1+y2)/2.0/{SIZE}, (x2-x1)/{SIZE}, (y2-y1)/{SIZE}) AS line FROM obs""")
def geo_yolo(spark, sf):
    return observations(spark, sf).select("image_id", "idx", g.to_yolo("box", SIZE, SIZE, "job").alias("line"))


@query(f"""WITH {OBS} SELECT image_id, idx, CAST(trunc(greatest(0, x1-(x2-x1)*0.25)) AS INTEGER) AS x1, CAST(trunc(greatest(0, y1-(y2-y1)*0.25)) AS INTEGER) AS y1,
 CAST(trunc(least({SIZE}, x2+(x2-x1)*0.25)) AS INTEGER) AS x2, CAST(trunc(least({SIZE}, y2+(y2-y1)*0.25)) AS INTEGER) AS y2 FROM obs""")
def geo_crop(spark, sf):
    return observations(spark, sf).select("image_id", "idx", g.crop("box", SIZE, SIZE, 0.25).alias("box")).select("image_id", "idx", *flat())


@query(f"""WITH {OBS} SELECT image_id, label, CAST(floor(sum(x1*greatest(score_milli,1)) / sum(greatest(score_milli,1)) * 64) AS BIGINT) AS x1, CAST(floor(sum(y2*greatest(score_milli,1)) / sum(greatest(score_milli,1)) * 64) AS BIGINT) AS y2 FROM obs GROUP BY image_id, label""")
def geo_fused(spark, sf):
    weighted = observations(spark, sf).groupBy("image_id", "label").agg(g.fused("box", F.greatest("score_milli", F.lit(1))).alias("box"))
    return weighted.select("image_id", "label", F.floor(F.col("box.x1") * 64).alias("x1"), F.floor(F.col("box.y2") * 64).alias("y2"))


def sized_images(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("image_id"), (F.lit(320) + F.col("p_partkey") * 37 % 1600).alias("width"), (F.lit(240) + F.col("p_partkey") * 53 % 900).alias("height"))


IMGS = "pi AS (SELECT p_partkey AS image_id, 320 + p_partkey*37%1600 AS width, 240 + p_partkey*53%900 AS height FROM part)"
TILES = f"""{IMGS}, lv AS (SELECT *, CAST(k AS INTEGER) AS level, CAST(greatest(1, floor(sqrt((k+1)*(k+1) * (width/height)) + 0.5)) AS BIGINT) AS c, CAST(greatest(1, floor(sqrt((k+1)*(k+1) / (width/height)) + 0.5)) AS BIGINT) AS r FROM pi, range(1, 3) AS l(k)),
sp AS (SELECT *, CASE WHEN c <= 1 THEN width ELSE least(width, CAST(ceil(width / (1.0 + (c-1)*0.75)) AS BIGINT)) END AS w, CASE WHEN r <= 1 THEN height ELSE least(height, CAST(ceil(height / (1.0 + (r-1)*0.75)) AS BIGINT)) END AS h FROM lv),
xs AS (SELECT *, CASE WHEN c <= 1 OR w >= width THEN 0 ELSE CAST(round_even(i * ((width-w)/(c-1)), 0) AS BIGINT) END AS x FROM sp, range(0, 20) AS q(i) WHERE i < c),
ys AS (SELECT image_id, level, j, CASE WHEN r <= 1 OR h >= height THEN 0 ELSE CAST(round_even(j * ((height-h)/(r-1)), 0) AS BIGINT) END AS y FROM sp, range(0, 20) AS q(j) WHERE j < r),
xd AS (SELECT *, row_number() OVER (PARTITION BY image_id, level ORDER BY x) - 1 AS col FROM (SELECT DISTINCT image_id, width, height, level, w, h, x FROM xs)),
yd AS (SELECT *, row_number() OVER (PARTITION BY image_id, level ORDER BY y) - 1 AS row FROM (SELECT DISTINCT image_id, level, y FROM ys)),
tl AS (SELECT image_id, 'full' AS job, CAST(0 AS INTEGER) AS level, 0.0 AS x1, 0.0 AS y1, CAST(width AS DOUBLE) AS x2, CAST(height AS DOUBLE) AS y2 FROM pi
 UNION ALL SELECT xd.image_id, printf('L%d-r%dc%d', xd.level, row, col), xd.level, x, y, x + w, y + h FROM xd JOIN yd ON xd.image_id = yd.image_id AND xd.level = yd.level)"""


@query(f"WITH {TILES} SELECT image_id, job, level, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2 FROM tl")
def tiles_plan(spark, sf):
    return tiles.plan_tiles(sized_images(spark, sf), levels=2).select("image_id", "job", "level", *flat("job_box"))


@query(f"""WITH {IMGS}, xs AS (SELECT DISTINCT image_id, width, height, least(i*320, greatest(0, width-640)) AS x FROM pi, range(0, 10) AS q(i) WHERE i*320 < width),
ys AS (SELECT DISTINCT image_id, least(j*320, greatest(0, height-640)) AS y FROM pi, range(0, 10) AS q(j) WHERE j*320 < height),
xd AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY x) - 1 AS col FROM xs), yd AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY y) - 1 AS row FROM ys)
SELECT xd.image_id, printf('r%dc%d', row, col) AS job, x AS x1, y AS y1, least(x+640, width) AS x2, least(y+640, height) AS y2 FROM xd JOIN yd USING (image_id)""")
def tiles_windows(spark, sf):
    return tiles.plan_windows(sized_images(spark, sf), 640).select("image_id", "job", *flat("window"))


@query(f"""WITH {OBS}, e AS (SELECT DISTINCT image_id, x1 AS x FROM obs UNION SELECT image_id, x2 FROM obs), f AS (SELECT DISTINCT image_id, y1 AS y FROM obs UNION SELECT image_id, y2 FROM obs),
sx AS (SELECT image_id, x, lead(x) OVER (PARTITION BY image_id ORDER BY x) AS xe FROM e), sy AS (SELECT image_id, y, lead(y) OVER (PARTITION BY image_id ORDER BY y) AS ye FROM f),
c AS (SELECT sx.image_id, x, xe, y, ye FROM sx JOIN sy USING (image_id) WHERE xe IS NOT NULL AND ye IS NOT NULL)
SELECT image_id, CAST(sum((xe-x)*(ye-y)) AS BIGINT) AS covered_area FROM c WHERE EXISTS (SELECT 1 FROM obs o WHERE o.image_id = c.image_id AND o.x1 <= c.x AND o.x2 >= c.xe AND o.y1 <= c.y AND o.y2 >= c.ye) GROUP BY image_id""")
def tiles_coverage(spark, sf):
    return tiles.covered(observations(spark, sf), ["image_id"], "box")


@query(f"WITH {OBS} SELECT image_id, label, min(x1) AS x1, min(y1) AS y1, max(x1)+1 AS x2, max(y1)+1 AS y2 FROM obs GROUP BY image_id, label")
def geo_mask_box(spark, sf):
    cells = observations(spark, sf).select("image_id", "label", "box.x1", "box.y1")
    return tiles.mask_boxes(cells, ["image_id", "label"], "x1", "y1").select("image_id", "label", *flat())


BEST = f"""{OBS}, {REFS}, {PAIRS}, bs AS (SELECT image_id, idx, arg_max({{'ref': ref, 'iou': i/u, 'permitted': permitted}}, {{'a': i/u, 'b': -ref}}) AS m FROM ov WHERE 2*i >= u GROUP BY image_id, idx)"""


@query(f"WITH {BEST} SELECT o.image_id, o.idx, m.iou AS overlap, m.ref AS ref, m.ref IS NOT NULL AS confirmed FROM obs o LEFT JOIN bs USING (image_id, idx)")
def join_best_overlap(spark, sf):
    best = spatial.best_overlap(observations(spark, sf), refs_of(spark, sf), ["image_id", "idx"], "ref", keep=["ref"])
    return best.select("image_id", "idx", "overlap", "ref", F.col("ref").isNotNull().alias("confirmed"))


CONTAIN = f"""{OBS}, cn AS (SELECT a.image_id, a.idx, min(b.idx) AS container FROM obs a JOIN obs b ON a.image_id = b.image_id AND a.idx <> b.idx AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2
 WHERE (b.x2-b.x1)*(b.y2-b.y1) > (a.x2-a.x1)*(a.y2-a.y1) AND 10*(least(a.x2,b.x2)-greatest(a.x1,b.x1))*(least(a.y2,b.y2)-greatest(a.y1,b.y1)) >= 7*least((a.x2-a.x1)*(a.y2-a.y1), (b.x2-b.x1)*(b.y2-b.y1)) GROUP BY 1, 2)"""


@query(f"WITH {CONTAIN} SELECT image_id, idx AS pos, container FROM cn")
def join_container(spark, sf):
    return spatial.containers(observations(spark, sf), (7, 10), pos="idx")


WINDOWS = """wd AS (SELECT CAST(r*3+c AS INTEGER) AS pos, c*24 AS wx1, r*24 AS wy1, c*24+48 AS wx2, r*24+48 AS wy2 FROM range(0,3) AS a(r), range(0,3) AS b(c))"""


@query(f"""WITH {OBS}, {WINDOWS}, p AS (SELECT image_id, idx, pos, least(x1-wx1, y1-wy1, wx2-x2, wy2-y2) AS margin FROM obs, wd WHERE wx1 <= x1 AND wy1 <= y1 AND wx2 >= x2 AND wy2 >= y2),
b AS (SELECT image_id, idx, arg_max({{'m': margin, 'p': pos}}, {{'a': margin, 'b': -pos}}) AS w FROM p GROUP BY 1, 2)
SELECT o.image_id, o.idx, w.m AS margin, w.p AS pos FROM obs o LEFT JOIN b USING (image_id, idx)""")
def join_window(spark, sf):
    obs = observations(spark, sf)
    images = obs.select("image_id").distinct()
    at = images.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(8))))
    x, y = (F.col("pos") % 3) * 24, F.expr("pos div 3") * 24
    windows = at.withColumn("window", g.box(x, y, x + 48, y + 48))
    return spatial.containing_window(obs, windows, ["image_id", "idx"], "pos").select("image_id", "idx", "margin", "pos")


@query(f"""WITH v AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e, 'c' || label AS label FROM embeddings),
s AS (SELECT q.vec_id AS id, b.vec_id AS bid, b.label, list_inner_product(q.e, b.e) AS sim FROM v q JOIN v b ON b.vec_id <> q.vec_id),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, bid) AS n FROM s) WHERE n <= 5),
w AS (SELECT id, label, count(*) AS votes, max(sim) AS sim FROM t GROUP BY 1, 2), z AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY votes DESC, sim DESC, label DESC) AS p FROM w)
SELECT id, max(CASE WHEN p = 1 THEN label END) AS label, max(CASE WHEN p = 1 THEN votes END) AS votes, max(CASE WHEN p = 2 THEN label END) AS runner_up FROM z WHERE p <= 2 GROUP BY id""")
def join_knn_vote(spark, sf):
    """Every vector labelled by the others: all are bank and query, a query's own id left out."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), F.concat(F.lit("c"), F.col("label").cast("string")).alias("label"))
    return spatial.knn_vote(v, v, others=True).drop("similarity")


@query(f"WITH {BEST} SELECT count(*) AS pairs, count(DISTINCT (image_id, ref)) AS hit FROM (SELECT image_id, ref FROM ov WHERE 2*i >= u GROUP BY 1, 2)")
def match_counts(spark, sf):
    """Size of the one-to-one matching; in these tables an observation reaches one reference at most, so distinct references bound it."""
    pairs = spatial.overlap_join(observations(spark, sf), refs_of(spark, sf).select("image_id", "ref", "ref_box"), least=(1, 2))
    taken = match(pairs.select("image_id", "idx", "ref", g.iou("box", "ref_box").alias("iou")), ["image_id"], "idx", "ref")
    return taken.agg(F.count("*").alias("pairs"), F.countDistinct("image_id", "ref").alias("hit"))


@query(f"""WITH {BEST}, r AS (SELECT image_id, ref, max(i/u) AS best FROM ov WHERE 2*i >= u GROUP BY 1, 2) SELECT image_id, count(*) AS matched, CAST(floor(sum(best) * 1000) AS BIGINT) AS total FROM r GROUP BY 1""")
def match_per_image(spark, sf):
    pairs = spatial.overlap_join(observations(spark, sf), refs_of(spark, sf).select("image_id", "ref", "ref_box"), least=(1, 2))
    sides = [g.intersection("box", "ref_box").alias("i"), g.union_area("box", "ref_box").alias("u")]
    taken = match(pairs.select("image_id", "idx", "ref", g.iou("box", "ref_box").alias("iou"), *sides), ["image_id"], "idx", "ref", carry=["i", "u"])
    return taken.groupBy("image_id").agg(F.count("*").alias("matched"), thousandths(ratio_sum("i", "u")).alias("total"))


LEADS = f"""{OBS}, ord AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score_milli DESC, CAST(idx AS VARCHAR)) AS n FROM obs),
s AS (SELECT image_id, 0 AS n, CAST([] AS STRUCT(id INTEGER, label VARCHAR, x1 BIGINT, y1 BIGINT, x2 BIGINT, y2 BIGINT)[]) AS leads FROM (SELECT DISTINCT image_id FROM obs)
 UNION ALL SELECT s.image_id, s.n + 1, CASE WHEN len(list_filter(s.leads, lambda l: l.label = o.label
   AND 2*greatest(0, least(l.x2,o.x2)-greatest(l.x1,o.x1))*greatest(0, least(l.y2,o.y2)-greatest(l.y1,o.y1)) >= (l.x2-l.x1)*(l.y2-l.y1)+(o.x2-o.x1)*(o.y2-o.y1)-greatest(0, least(l.x2,o.x2)-greatest(l.x1,o.x1))*greatest(0, least(l.y2,o.y2)-greatest(l.y1,o.y1)))) > 0
  THEN s.leads ELSE list_append(s.leads, {{'id': o.idx, 'label': o.label, 'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2}}) END FROM s JOIN ord o ON o.image_id = s.image_id AND o.n = s.n + 1)"""


@query(f"WITH RECURSIVE {LEADS}, z AS (SELECT image_id, arg_max(leads, n) AS leads FROM s GROUP BY image_id) SELECT image_id, CAST(l.id AS VARCHAR) AS lead, l.label AS label FROM (SELECT image_id, unnest(leads) AS l FROM z)")
def merge_leads_fold(spark, sf):
    obs = observations(spark, sf).withColumn("id", F.col("idx").cast("string")).withColumn("score", F.col("score_milli"))
    return cluster.merge_fold(obs).select("image_id", "lead", "label")


@query(SQL["merge_leads_fold"])
def merge_leads(spark, sf):
    """The same clustering by the general operator, with truncation and the class tree off."""
    obs = observations(spark, sf).withColumn("id", F.col("idx").cast("string")).withColumn("score", F.col("score_milli"))
    made = cluster.merge(obs, ios=2.0)
    return made.filter("id = lead").select("image_id", "lead", "label")


@query()
def merge_with_ontology(spark, sf):
    """Full merging: truncated views, broader classes across views, fused boxes and a second round."""
    from quadrat.sources.bridge import ONTOLOGY

    obs = observations(spark, sf).withColumn("id", F.col("idx").cast("string")).withColumn("score", F.col("score_milli") / 1000)
    return cluster.merge(obs, ontology=ONTOLOGY, fuse=True, rounds=2)
