"""Queries of the evaluation, diagnosis, verification, audit, review and sampling operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quadrat.functions import geometry as g
from quadrat.functions import labels as lb
from quadrat.functions.stats import ratio, ratio_sum, thousandths
from quadrat.operators import diagnose, evaluate, review, spatial, verify
from quadrat.operators.assignment import match
from quadrat.sources.bridge import LABELS, OBS, ONTOLOGY, PAIRS, REFS, observations, references, table

from .rules import CLOSURE, evidence
from .spatial import BEST, refs_of

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


SIZE_BIN = "CASE WHEN ({x2}-{x1})*({y2}-{y1}) < 256 THEN '<16' WHEN ({x2}-{x1})*({y2}-{y1}) < 1024 THEN '16-32' WHEN ({x2}-{x1})*({y2}-{y1}) < 9216 THEN '32-96' ELSE '>=96' END"

# ---- verification rows: an observation is known where a reference of its cell allows it --------------


def verified(spark, sf):
    best = spatial.best_overlap(observations(spark, sf), refs_of(spark, sf), ["image_id", "idx"], "ref", keep=["ref", "permitted"])
    named = F.element_at(F.array(*map(F.lit, LABELS)), (F.col("ref") % 4 + 1).cast("int"))
    confirmed = F.coalesce(F.col("overlap") >= 0.75, F.lit(False))
    return best.select("image_id", "idx", "label", "box", "score_milli", F.when(F.col("ref").isNotNull() & (F.col("idx") % 5 != 0), "true_positive").otherwise("undecided").alias("known"), confirmed.alias("confirmed"), F.when(confirmed, named).alias("verifier_label"), g.size_bin("box").alias("size_bin"))


VERIFIED = f"""{BEST}, vf AS (SELECT o.image_id, o.idx, o.label, o.score_milli, CASE WHEN m IS NOT NULL AND o.idx % 5 <> 0 THEN 'true_positive' ELSE 'undecided' END AS known, coalesce(m.iou >= 0.75, false) AS confirmed,
 CASE WHEN m.iou >= 0.75 THEN (['car','van','truck','person'])[1 + m.ref % 4] END AS verifier_label, {SIZE_BIN.format(x1='x1', y1='y1', x2='x2', y2='y2')} AS size_bin FROM obs o LEFT JOIN bs USING (image_id, idx))"""
COUNTS = "count(*) AS retained, count(*) FILTER (known = 'true_positive') AS known_positives, count(*) FILTER (known = 'undecided') AS undecided, count(*) FILTER (known = 'true_positive' AND confirmed) AS known_confirmed, count(*) FILTER (known = 'undecided' AND confirmed) AS undecided_confirmed"


@query(f"""WITH {VERIFIED}, c AS (SELECT 'size_bin' AS stratum, size_bin AS value, {COUNTS} FROM vf GROUP BY size_bin UNION ALL SELECT 'label', label, {COUNTS} FROM vf GROUP BY label)
SELECT stratum, value, known_positives, undecided, CASE WHEN known_positives > 0 THEN known_confirmed / known_positives END AS sensitivity, CASE WHEN undecided > 0 THEN undecided_confirmed / undecided END AS confirmation_on_undecided FROM c""")
def verify_strata(spark, sf):
    return verify.by_stratum(verified(spark, sf), ["size_bin", "label"])


@query(f"""WITH {VERIFIED}, c AS (SELECT {COUNTS} FROM vf), s AS (SELECT *, known_confirmed/known_positives AS sensitivity, undecided_confirmed/undecided AS confirmation_on_undecided, known_positives/retained AS uncorrected_precision FROM c),
i AS (SELECT *, least(undecided, undecided_confirmed/sensitivity) AS implied_real FROM s)
SELECT *, (known_positives+undecided_confirmed)/retained AS precision_if_confirmed, (known_positives+implied_real)/retained AS precision_equal_sensitivity FROM i""")
def verify_summary(spark, sf):
    return verify.summarise(verified(spark, sf))


@query(f"""WITH RECURSIVE {CLOSURE}, {VERIFIED}, p AS (SELECT CASE WHEN idx % 4 = 0 AND label <> 'person' THEN 'vehicle' ELSE label END AS emitted, verifier_label AS verifier FROM vf WHERE confirmed)
SELECT CASE WHEN emitted = verifier THEN 'exact' WHEN EXISTS (SELECT 1 FROM up WHERE class = verifier AND ancestor = emitted) THEN 'compatible' ELSE 'conflict' END AS outcome, emitted, verifier, count(*) AS n FROM p GROUP BY ALL""")
def verify_agreement(spark, sf):
    rows = verified(spark, sf).withColumn("label", F.when((F.col("idx") % 4 == 0) & (F.col("label") != "person"), "vehicle").otherwise(F.col("label")))
    return verify.agreement(rows, ONTOLOGY)


@query(SQL["verify_agreement"].replace("SELECT CASE WHEN emitted", ", a AS (SELECT CASE WHEN emitted").replace("FROM vf WHERE confirmed)\n,", "FROM vf WHERE confirmed),\n") + "), z AS (SELECT *, CAST(row_number() OVER (PARTITION BY outcome ORDER BY n DESC, emitted, verifier) AS INTEGER) AS rank FROM a WHERE outcome <> 'exact') SELECT * FROM z WHERE rank <= 8")
def verify_top_pairs(spark, sf):
    return verify.top_pairs(verify_agreement(spark, sf))


@query(f"WITH {VERIFIED} SELECT known, size_bin, label, count(*) AS n FROM vf GROUP BY GROUPING SETS ((known), (size_bin), (label), ())")
def verify_grouping_sets(spark, sf):
    rows = verified(spark, sf)
    k, s, c = F.col("known"), F.col("size_bin"), F.col("label")
    return rows.groupingSets([[k], [s], [c], []], k, s, c).agg(F.count("*").alias("n"))


# ---- evaluation ---------------------------------------------------------------------------------------


def panel(spark, sf):
    """(images, references, predictions) of a benchmark over the derived boxes."""
    refs = refs_of(spark, sf)
    split = F.when(F.col("image_id") % 5 == 0, "development").otherwise("evaluation")
    status = F.when(F.col("image_id") % 17 == 0, "failed").otherwise("completed")
    images = refs.select("image_id").distinct().select("image_id", F.concat(F.lit("d"), (F.col("image_id") % 3).cast("string")).alias("domain"), split.alias("split"), status.alias("run_status"))
    preds = observations(spark, sf).filter("image_id % 17 <> 0").select("image_id", F.col("idx").alias("pos"), "box", F.when(F.col("idx") % 19 == 0, "unknown_object").otherwise(F.col("label")).alias("label"), F.when(F.col("idx") % 13 == 0, "group").otherwise("instance").alias("kind"), F.lit("physical").alias("scene_layer"), F.when((F.col("score_milli") >= 400) & (F.col("idx") % 19 != 0), "accepted").otherwise("uncertain").alias("status"))
    return images, refs, preds


#: An observation reaches at most one reference here, so a matching has as many pairs as there are references reached.
PANEL = f"""{OBS}, {REFS}, {PAIRS}, im AS (SELECT image_id, 'd' || image_id % 3 AS domain, CASE WHEN image_id % 17 = 0 THEN 'failed' ELSE 'completed' END AS run_status FROM (SELECT DISTINCT image_id FROM refs) WHERE image_id % 5 <> 0),
fin AS (SELECT image_id, idx, CASE WHEN idx % 19 = 0 THEN 'unknown_object' ELSE label END AS label, score_milli >= 400 AND idx % 19 <> 0 AS accepted FROM obs WHERE image_id % 5 <> 0 AND image_id % 17 <> 0 AND idx % 13 <> 0),
fs AS (SELECT *, label IN ('car','van','person','unknown_object') AS scored FROM fin),
pr AS (SELECT o.image_id, o.idx, o.ref, o.i, o.u, f.scored, f.scored AND f.accepted AS acc, list_contains(o.permitted, f.label) AS named FROM ov o JOIN fs f ON o.image_id = f.image_id AND o.idx = f.idx WHERE o.eligible AND 2*o.i >= o.u),
mc AS (SELECT image_id, count(DISTINCT ref) AS m50, count(DISTINCT CASE WHEN scored THEN ref END) AS s50, count(DISTINCT CASE WHEN acc AND named THEN ref END) AS a50, count(DISTINCT CASE WHEN acc AND named AND 4*i >= 3*u THEN ref END) AS a75, count(DISTINCT CASE WHEN acc AND named AND 20*i >= 17*u THEN ref END) AS a85,
 count(DISTINCT CASE WHEN scored THEN idx END) AS reach FROM pr GROUP BY 1),
tops AS (SELECT image_id, ref, arg_max(named, {{'a': i/u, 'b': -idx}}) AS named FROM pr GROUP BY 1, 2), cr AS (SELECT image_id, count(*) FILTER (named) AS correct FROM tops GROUP BY 1),
fc AS (SELECT image_id, count(*) AS final, count(*) FILTER (scored) AS scored, count(*) FILTER (scored AND accepted) AS accepted, count(*) FILTER (label = 'unknown_object') AS unknown FROM fs GROUP BY 1),
rc AS (SELECT image_id, count(*) AS eligible FROM refs WHERE eligible GROUP BY 1),
ic AS (SELECT im.*, coalesce(m50,0) AS m50, coalesce(s50,0) AS s50, coalesce(a50,0) AS a50, coalesce(a75,0) AS a75, coalesce(a85,0) AS a85, coalesce(correct,0) AS correct, coalesce(reach,0)-coalesce(s50,0) AS duplicate, coalesce(final,0) AS final, coalesce(scored,0) AS scored, coalesce(accepted,0) AS accepted, coalesce(unknown,0) AS unknown, coalesce(eligible,0) AS eligible
 FROM im LEFT JOIN mc USING (image_id) LEFT JOIN cr USING (image_id) LEFT JOIN fc USING (image_id) LEFT JOIN rc USING (image_id)),
cnt AS (SELECT *, CAST(1 AS BIGINT) AS one, CAST(run_status = 'completed' AND m50 = eligible AS BIGINT) AS complete, CAST(run_status = 'completed' AND a85 = eligible AND a85 = scored AS BIGINT) AS fully FROM ic)"""
SCOPE = ["car", "van", "person"]
IMAGE_COLUMNS = ["image_id", "domain", "run_status", "eligible", "final", "scored", "accepted", "unknown", "m50", "s50", "a50", "a75", "a85", "correct", "duplicate", "complete", "fully"]


@query(f"WITH {PANEL} SELECT {', '.join(IMAGE_COLUMNS)} FROM cnt")
def evaluate_images(spark, sf):
    return evaluate.image_counts(*panel(spark, sf), scope=SCOPE).select(*IMAGE_COLUMNS)


@query(
    f"WITH {PANEL}, g AS (SELECT domain, grouping(domain) = 1 AS is_total, "
    + ", ".join(f"sum({c}) AS {c}" for c in sorted({c for nd in evaluate.METRICS.values() for c in nd}))
    + " FROM cnt GROUP BY GROUPING SETS ((), (domain))) "
    + " UNION ALL ".join(f"SELECT domain, is_total, '{m}' AS metric, CAST({n} AS BIGINT) AS numerator, CAST({d} AS BIGINT) AS denominator, CASE WHEN {d} > 0 THEN {n}/{d} END AS value FROM g" for m, (n, d) in evaluate.METRICS.items())
)
def evaluate_metrics(spark, sf):
    return evaluate.metrics(evaluate.image_counts(*panel(spark, sf), scope=SCOPE))


USED = sorted({c for nd in evaluate.METRICS.values() for c in nd})


@query(
    f"WITH {PANEL}, b AS (SELECT k AS replicate, {' + '.join(f'CAST(u >= {x} AS INTEGER)' for x in evaluate.POISSON)} AS w, c.* FROM (SELECT *, CAST('0x' || substr(md5('0:' || k || ':' || image_id), 1, 8) AS BIGINT) AS u FROM cnt, range(1, 201) AS r(k)) c), "
    + f"s AS (SELECT replicate, {', '.join(f'sum({c} * w) AS {c}' for c in USED)} FROM b WHERE w > 0 GROUP BY 1), t AS (SELECT {', '.join(f'sum({c}) AS {c}' for c in USED)} FROM cnt), "
    + "v AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, CASE WHEN {d} > 0 THEN {n}/{d} END AS value FROM s" for m, (n, d) in evaluate.METRICS.items()) + "), "
    + "z AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST({n} AS BIGINT) AS numerator, CAST({d} AS BIGINT) AS denominator, CASE WHEN {d} > 0 THEN {n}/{d} END AS value FROM t" for m, (n, d) in evaluate.METRICS.items()) + "), "
    + "q AS (SELECT metric, quantile_cont(value, 0.05) AS lower, coalesce(min(value) = max(value), true) AS flat FROM v GROUP BY 1) "
    + "SELECT z.metric, numerator, denominator, CAST(floor(value * 1e9) AS BIGINT) AS value, CASE WHEN NOT flat THEN CAST(round(lower * 1e6) AS BIGINT) END AS lower_95, CASE WHEN flat THEN 'inconclusive_degenerate' ELSE 'descriptive_only' END AS interval_status FROM z JOIN q USING (metric)"
)
def evaluate_bootstrap(spark, sf):
    """Values in billionths and lower bounds in millionths."""
    made = evaluate.bootstrap_distributed(evaluate.image_counts(*panel(spark, sf), scope=SCOPE))
    return made.withColumns({"value": F.floor(F.col("value") * 1e9), "lower_95": F.round(F.col("lower_95") * 1e6).cast("long")})


@query(f"""WITH {PANEL}, a AS (SELECT domain, sum(s50)/sum(scored) AS scoped, sum(m50)/sum(final) AS unscoped FROM cnt GROUP BY 1) SELECT *, scoped - unscoped AS delta FROM a""")
def evaluate_ablation(spark, sf):
    counts = evaluate.image_counts(*panel(spark, sf), scope=SCOPE).groupBy("domain").agg(*(F.sum(c).alias(c) for c in ("s50", "scored", "m50", "final")))
    return counts.select("domain", ratio("s50", "scored").alias("scoped"), ratio("m50", "final").alias("unscoped")).withColumn("delta", F.col("scoped") - F.col("unscoped"))


@query(f"""WITH {OBS}, c AS (SELECT CASE WHEN score_milli >= 500 THEN 'accepted' ELSE 'uncertain' END AS status, CASE WHEN idx%13=0 THEN 'group' ELSE 'instance' END AS kind, label FROM obs)
SELECT status, kind, label, count(*) AS n, count(*) FILTER (status = 'uncertain') AS uncertain FROM c GROUP BY GROUPING SETS ((status), (kind), (label))""")
def summary_counts(spark, sf):
    rows = observations(spark, sf).select(F.when(F.col("score_milli") >= 500, "accepted").otherwise("uncertain").alias("status"), F.when(F.col("idx") % 13 == 0, "group").otherwise("instance").alias("kind"), "label", (F.col("score_milli") < 500).alias("low"))
    s, k, c = F.col("status"), F.col("kind"), F.col("label")
    return rows.groupingSets([[s], [k], [c]], s, k, c).agg(F.count("*").alias("n"), F.count_if("low").alias("uncertain"))


@query(f"""WITH {OBS}, {REFS}, {PAIRS}, b AS (SELECT image_id, ref, max(i/u) AS v FROM ov WHERE 2*i >= u GROUP BY 1, 2) SELECT image_id, grouping(image_id) = 1 AS is_total, count(*) AS matched, CAST(floor(sum(1-v)*1000) AS BIGINT) AS extent_error, count(*) FILTER (v < 0.75) AS loose FROM b GROUP BY ROLLUP (image_id)""")
def per_image_rollup(spark, sf):
    pairs = spatial.overlap_join(observations(spark, sf), refs_of(spark, sf).select("image_id", "ref", "ref_box"), least=(1, 2))
    sides = [g.intersection("box", "ref_box").alias("i"), g.union_area("box", "ref_box").alias("u")]
    taken = match(pairs.select("image_id", "idx", "ref", g.iou("box", "ref_box").alias("iou"), *sides), ["image_id"], "idx", "ref", carry=["i", "u"])
    return taken.rollup("image_id").agg((F.grouping("image_id") == 1).alias("is_total"), F.count("*").alias("matched"), thousandths(ratio_sum(F.col("u") - F.col("i"), "u")).alias("extent_error"), F.count_if(F.col("iou") < 0.75).alias("loose"))


# ---- diagnosis ----------------------------------------------------------------------------------------


def runs(spark, sf):
    """(references, retained, probe): the shipped run keeps scores from 0.7, the probe everything."""
    obs = observations(spark, sf).withColumnRenamed("idx", "pos").withColumn("score", F.col("score_milli") / 1000)
    probe = obs.withColumn("disposition", F.when(F.col("pos") % 3 == 0, "merged").otherwise("retained"))
    return refs_of(spark, sf).filter("eligible"), obs.filter("score_milli >= 700 and pos % 2 = 0"), probe


RUNS = f"""{OBS}, {REFS}, {PAIRS}, near AS (SELECT image_id, ref, max(i/u) AS best_retained, bool_or(2*i >= u) AS r50, bool_or(10*i >= 3*u) AS r30 FROM ov WHERE eligible AND score_milli >= 700 AND idx%2 = 0 GROUP BY 1, 2),
seen AS (SELECT image_id, ref, max(i/u) AS best_probe, count(*) FILTER (2*i >= u) AS reached, count(*) FILTER (2*i >= u AND score_milli >= 700) AS above, count(*) FILTER (2*i >= u AND score_milli >= 700 AND idx%3 = 0) AS merged, bool_or(2*i >= u) AS p50, bool_or(10*i >= 3*u) AS p30 FROM ov WHERE eligible GROUP BY 1, 2),
ms AS (SELECT r.image_id, r.ref, r.x1, r.y1, r.x2, r.y2 FROM refs r LEFT JOIN near n USING (image_id, ref) WHERE r.eligible AND NOT coalesce(n.r50, false))"""


@query(f"""WITH {RUNS} SELECT m.image_id, m.ref, CASE WHEN coalesce(r50,false) THEN 'merged_with_neighbour' WHEN coalesce(r30,false) THEN 'localized_below_match' WHEN coalesce(reached,0) > 0 AND above = 0 THEN 'below_threshold' WHEN coalesce(merged,0) > 0 THEN 'merged_away' WHEN coalesce(above,0) > 0 THEN 'retained_unmatched' WHEN coalesce(p30,false) THEN 'localized_below_match' ELSE 'never_proposed' END AS bucket,
 {SIZE_BIN.format(x1='x1', y1='y1', x2='x2', y2='y2')} AS size_bin, coalesce(best_retained, 0.0) AS best_retained, coalesce(best_probe, 0.0) AS best_probe FROM ms m LEFT JOIN near USING (image_id, ref) LEFT JOIN seen USING (image_id, ref)""")
def diagnose_misses(spark, sf):
    return diagnose.attribute_misses(*runs(spark, sf), 0.7)


@query(SQL["diagnose_misses"].replace("SELECT m.image_id", ", d AS (SELECT m.image_id").replace("ms)\n,", "ms),").replace("GROUP BY 1, 2),\nms", "GROUP BY 1, 2),\nms") + ") SELECT size_bin, " + ", ".join(f"count(*) FILTER (bucket = '{b}') AS {b}" for b in diagnose.BUCKETS) + " FROM d GROUP BY 1")
def diagnose_misses_by_size(spark, sf):
    return diagnose_misses(spark, sf).groupBy("size_bin").pivot("bucket", list(diagnose.BUCKETS)).count().fillna(0)


@query(f"""WITH {RUNS}, o AS (SELECT image_id, ref, arg_max({{'b': i/u, 'h': 2*i >= u, 'n': 10*i >= 3*u, 's': score_milli/1000, 'j': job, 'd': CASE WHEN idx%3=0 THEN 'merged' ELSE 'retained' END}}, {{'a': i/u, 'b': -idx}}) AS o FROM ov WHERE eligible GROUP BY 1, 2)
SELECT m.image_id, m.ref, {SIZE_BIN.format(x1='x1', y1='y1', x2='x2', y2='y2')} AS size_bin, coalesce(o.b, 0.0) AS best, CASE WHEN o.h THEN 'recoverable_by_selection' WHEN o.n THEN 'needs_new_geometry' ELSE 'not_localized' END AS verdict, o.s AS score, o.j AS job, o.d AS disposition FROM ms m LEFT JOIN o USING (image_id, ref)""")
def diagnose_headroom(spark, sf):
    return diagnose.headroom(*runs(spark, sf))


def records(spark, sf):
    """The probe as one run's records: each merged record went into an earlier one of its image."""
    return runs(spark, sf)[2].withColumns({"id": F.col("pos").cast("string"), "level": F.col("job") % 3, "disposition": F.when((F.col("score_milli") >= 700) & (F.col("pos") % 2 == 0), "retained").when(F.col("pos") % 3 == 0, "merged").otherwise("rejected"), "merged_into": F.greatest(F.col("pos") - 1, F.lit(0)).cast("string")})


@query(f"""WITH {RUNS}, o AS (SELECT image_id, ref, arg_max({{'p': idx, 's': score_milli, 'l': job%3, 'e': view_edge}}, {{'a': i/u, 'b': -idx}}) AS o FROM ov JOIN ms USING (image_id, ref) WHERE 2*i >= u GROUP BY 1, 2),
j AS (SELECT o.image_id, o.ref, o.o, l.score_milli AS ls, l.job%3 AS ll, l.view_edge AS le FROM o LEFT JOIN obs l ON l.image_id = o.image_id AND o.o.p%3 = 0 AND l.idx = greatest(o.o.p-1, 0))
SELECT image_id, ref, CASE WHEN ls IS NULL THEN 'assignment_contention' ELSE 'representative_selection' END AS "case", o.s > ls AS higher_score, o.l > ll AS more_magnified, CASE WHEN ls IS NOT NULL THEN (NOT o.e) AND le END AS untruncated_over_truncated FROM j""")
def diagnose_separability(spark, sf):
    refs, _, _ = runs(spark, sf)
    found = diagnose.separability(refs, records(spark, sf))
    return found


THRESHOLDS = (0.0, 0.2, 0.4, 0.5, 0.6, 0.8)


@query(f"""WITH {OBS}, {REFS}, {PAIRS}, t AS (SELECT * FROM (VALUES {', '.join(f'({x}::DOUBLE)' for x in THRESHOLDS)}) t(threshold)), k AS (SELECT threshold, count(*) AS kept FROM obs, t WHERE score_milli/1000 >= threshold GROUP BY 1),
m AS (SELECT threshold, count(DISTINCT (image_id, ref)) AS matched_kept FROM ov, t WHERE eligible AND 2*i >= u AND score_milli/1000 >= threshold GROUP BY 1),
z AS (SELECT (SELECT count(*) FROM obs) AS total, (SELECT count(*) FROM refs WHERE eligible) AS nr, (SELECT count(DISTINCT (image_id, ref)) FROM ov WHERE eligible AND 2*i >= u) AS mt),
r AS (SELECT threshold, coalesce(kept,0) AS kept, total-coalesce(kept,0) AS removed, coalesce(matched_kept,0) AS matched_kept, mt-coalesce(matched_kept,0) AS matched_removed, mt, total, nr FROM t LEFT JOIN k USING (threshold) LEFT JOIN m USING (threshold), z),
q AS (SELECT *, removed-matched_removed AS unmatched_removed, matched_removed/mt AS matched_removed_rate, (removed-matched_removed)/(total-mt) AS unmatched_removed_rate FROM r)
SELECT threshold, kept, removed, matched_kept, matched_removed, unmatched_removed, matched_removed_rate, unmatched_removed_rate, unmatched_removed_rate-matched_removed_rate AS selectivity, matched_kept/nr AS recall, CASE WHEN kept > 0 THEN matched_kept/kept END AS precision FROM q""")
def diagnose_selectivity(spark, sf):
    refs, _, probe = runs(spark, sf)
    return diagnose.selectivity(probe, refs, spark.createDataFrame([(x,) for x in THRESHOLDS], "threshold double"))


@query(f"WITH {OBS} SELECT DISTINCT unnest(quantile_cont(score_milli/1000, [" + ", ".join(f"{i}/19" for i in range(20)) + "])) AS threshold FROM obs")
def score_quantiles(spark, sf):
    return diagnose.score_quantiles(observations(spark, sf).withColumn("score", F.col("score_milli") / 1000))


AIMS = [0.8, 0.9, 0.95]


@query(
    f"""WITH {VERIFIED}, k AS (SELECT label, CASE WHEN idx % 6 <> 0 THEN score_milli/1000 END AS s FROM vf WHERE known = 'true_positive'), n AS (SELECT label, count(*) AS p FROM k GROUP BY 1), d AS (SELECT label, s, sum(count(*)) OVER (PARTITION BY label ORDER BY s DESC) AS kept FROM k WHERE s IS NOT NULL GROUP BY 1, 2),
t AS (SELECT * FROM (VALUES {', '.join(f'({x}::DOUBLE)' for x in AIMS)}) t(target)) SELECT n.label, target, coalesce(greatest(max(s) FILTER (kept >= target*p), 0.3), 0.3) AS threshold FROM n JOIN d USING (label), t GROUP BY n.label, target"""
)
def threshold_per_class(spark, sf):
    rows = verified(spark, sf).select("label", F.when(F.col("idx") % 6 != 0, F.col("score_milli") / 1000).alias("score"), (F.col("known") == "true_positive").alias("known"))
    return diagnose.highest_threshold(rows, AIMS, by=["label"])


@query(f"""WITH {VERIFIED}, t AS (SELECT * FROM (VALUES {', '.join(f'({x}::DOUBLE)' for x in THRESHOLDS)}) t(threshold)) SELECT threshold, count(*) AS kept, count(*) FILTER (known = 'true_positive') AS positives, count(*) FILTER (known = 'true_positive')/count(*) AS precision FROM vf, t WHERE score_milli/1000 >= threshold GROUP BY 1""")
def risk_coverage(spark, sf):
    positive = F.count_if(F.col("known") == "true_positive")
    return diagnose.sweep(verified(spark, sf), list(THRESHOLDS), F.col("score_milli") / 1000 >= F.col("threshold"), [F.count("*").alias("kept"), positive.alias("positives"), ratio(positive, F.count("*")).alias("precision")])


@query("""WITH t AS (SELECT CAST(i AS INTEGER) AS pos, i/20 AS threshold FROM range(0, 20) AS r(i)), s AS (SELECT pos, threshold, (SELECT count(*) FROM events WHERE value >= threshold*100) AS n FROM t), b AS (SELECT user_id, count(*) AS accepted FROM events GROUP BY 1),
r AS (SELECT b.user_id, b.accepted, arg_min({'t': threshold, 'n': n}, {'a': abs(n - accepted*60), 'p': pos}) AS m FROM b, s GROUP BY 1, 2) SELECT user_id, accepted, m.t AS threshold, m.n AS n FROM r""")
def nearest_operating_point(spark, sf):
    """The row of a score sweep whose accepted count is nearest to a count (first of equal ones)."""
    events = table(spark, sf, "events")
    at = spark.range(20).select(F.col("id").cast("int").alias("pos"), (F.col("id") / 20).alias("threshold"))
    counts = events.join(F.broadcast(at), F.col("value") >= F.col("threshold") * 100).groupBy("pos", "threshold").agg(F.count("*").alias("n"))
    points = at.join(counts.select("pos", "n"), "pos", "left").fillna(0, ["n"])
    users = events.groupBy("user_id").agg(F.count("*").alias("accepted"))
    return spatial.nearest_row(users, points, F.col("accepted") * 60, F.col("n"), "pos", ["threshold", "n"]).select("user_id", "accepted", "threshold", "n")


# ---- audit --------------------------------------------------------------------------------------------

VERDICT = "CASE WHEN doc_id%11 = 0 THEN 'undecidable' WHEN quality = 1 THEN 'real' ELSE 'false' END"


def judged(spark, sf):
    labels = table(spark, sf, "labels")
    verdict = F.when(F.col("doc_id") % 11 == 0, "undecidable").when(F.col("quality") == 1, "real").otherwise("false")
    return labels.select(verdict.alias("verdict"), F.element_at(F.array(*map(F.lit, LABELS)), (F.col("doc_id") % 4 + 1).cast("int")).alias("label"), F.when(F.col("doc_id") % 5 != 0, F.element_at(F.array(*map(F.lit, LABELS)), (F.col("doc_id") % 3 + 1).cast("int"))).alias("true_label"))


@query(f"""WITH c AS (SELECT count(*) AS sampled, count(*) FILTER (v = 'real') AS n_real, count(*) FILTER (v = 'false') AS n_false, count(*) FILTER (v = 'undecidable') AS n_undecidable FROM (SELECT {VERDICT} AS v FROM labels)),
d AS (SELECT *, 1000 AS matched, 5000 AS retained, n_real+n_false AS decided, n_real/(n_real+n_false) AS p, 1+1.96*1.96/(n_real+n_false) AS k FROM c),
e AS (SELECT *, greatest(0.0, (p+1.96*1.96/(decided*2.0))/k - 1.96*sqrt(p*(1.0-p)/decided+1.96*1.96/(decided*decided*4.0))/k) AS lo, least(1.0, (p+1.96*1.96/(decided*2.0))/k + 1.96*sqrt(p*(1.0-p)/decided+1.96*1.96/(decided*decided*4.0))/k) AS hi FROM d)
SELECT sampled, n_real, n_false, n_undecidable, matched, retained, decided, n_undecidable/sampled AS undecidable_rate, matched/retained AS uncorrected_precision, p AS real_rate, (matched+p*(retained-matched))/retained AS corrected_precision, floor((matched+lo*(retained-matched))/retained*1e9)/1e9 AS low, floor((matched+hi*(retained-matched))/retained*1e9)/1e9 AS high FROM e""")
def audit_precision(spark, sf):
    made = verify.estimate_precision(judged(spark, sf), 1000, 5000)
    return made.withColumns({c: F.floor(F.col(c) * 1e9) / 1e9 for c in ("low", "high")})


@query(f"""WITH j AS (SELECT {VERDICT} AS v, (['car','van','truck','person'])[1+doc_id%4] AS label, CASE WHEN doc_id%5<>0 THEN (['car','van','truck','person'])[1+doc_id%3] END AS t FROM labels), s AS (SELECT * FROM j WHERE v = 'real' AND t IS NOT NULL)
SELECT count(*) AS scored, count(*) FILTER (label = t) AS correct, count(*) FILTER (label = t)/count(*) AS accuracy, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT label || '>' || t AS x FROM s WHERE label <> t)) AS confusions FROM s""")
def audit_accuracy(spark, sf):
    made = verify.judged_accuracy(judged(spark, sf))
    return made.withColumn("confusions", F.array_join(F.transform("confusions", lambda c: F.concat_ws(">", c["label"], c["true_label"])), ","))


@query("""WITH t AS (SELECT event_type AS stage, CAST(sum(CAST(floor(value) AS BIGINT)) AS DOUBLE) AS seconds FROM events GROUP BY 1), r AS (SELECT * FROM t UNION ALL SELECT 'unattributed', 10000000.0 - sum(seconds) FROM t) SELECT stage, seconds, seconds/10000000.0 AS share, seconds/2311 AS per_object FROM r""")
def stage_cost(spark, sf):
    return verify.stage_cost(table(spark, sf, "events").select("event_type", F.floor("value").cast("double").alias("value")), 10_000_000.0, 2311, "event_type", "value")


@query("""WITH r AS (SELECT CASE event_type WHEN 'click' THEN 'human' ELSE event_type END AS arm, CAST(floor(avg(value)*0 + count(*)) AS DOUBLE) AS value FROM events GROUP BY event_type, user_id % 3), p AS (SELECT arm, count(*) AS seeds, avg(value) AS mean, CASE WHEN count(*) > 1 THEN max(value)-min(value) END AS spread FROM r GROUP BY 1)
SELECT p.*, CASE WHEN b.base > 0 THEN mean/b.base END AS share_of_human FROM p LEFT JOIN (SELECT mean AS base FROM p WHERE arm = 'human') b ON true""")
def student_arms(spark, sf):
    results = table(spark, sf, "events").groupBy("event_type", (F.col("user_id") % 3).alias("seed")).agg(F.count("*").cast("double").alias("value"))
    return verify.arms(results.select(F.when(F.col("event_type") == "click", "human").otherwise(F.col("event_type")).alias("arm"), "value"))


@query(f"""WITH {VERIFIED} SELECT label, {', '.join(f"count(*) FILTER (verifier_label = '{c}') AS as_{c}" for c in LABELS)} FROM vf GROUP BY 1""")
def label_confusion(spark, sf):
    wide = verified(spark, sf).groupBy("label").pivot("verifier_label", list(LABELS)).count().fillna(0)
    return wide.select("label", *(F.col(c).alias(f"as_{c}") for c in LABELS))


@query(f"""WITH {OBS}, n AS (SELECT 'emitted' AS naming, label FROM obs UNION ALL SELECT 'first', (['car','van','truck','person'])[1+idx%4] FROM obs UNION ALL SELECT 'second', (['car','van','truck','person'])[1+job%4] FROM obs), c AS (SELECT naming, label, count(*) AS n FROM n GROUP BY 1, 2)
SELECT naming, label, n, n/sum(n) OVER (PARTITION BY naming) AS share FROM c""")
def naming_shares(spark, sf):
    pick = lambda c: F.element_at(F.array(*map(F.lit, LABELS)), (F.col(c) % 4 + 1).cast("int"))
    rows = observations(spark, sf).select(F.col("label").alias("emitted"), pick("idx").alias("first"), pick("job").alias("second"))
    counts = rows.unpivot([], ["emitted", "first", "second"], "naming", "label").groupBy("naming", "label").agg(F.count("*").alias("n"))
    return counts.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy("naming"))))


@query(f"""WITH {OBS}, v AS (SELECT image_id, idx, ([score_milli, (score_milli*7)%1000, (score_milli*13)%1000]) AS s FROM obs), a AS (SELECT *, list_max(s) AS top, (['car','van','truck'])[list_position(s, list_max(s))] AS class FROM v) SELECT class, count(*) AS n, count(*) FILTER (top >= 800) AS kept FROM a GROUP BY 1""")
def vocabulary_argmax(spark, sf):
    """Argmax class of each box's score vector, and how many clear the threshold."""
    s = F.col("score_milli")
    rows = observations(spark, sf).select(F.array(s, s * 7 % 1000, s * 13 % 1000).alias("s")).withColumn("top", F.array_max("s"))
    named = rows.withColumn("class", F.element_at(F.array(*map(F.lit, LABELS[:3])), F.array_position("s", F.col("top")).cast("int")))
    return named.groupBy("class").agg(F.count("*").alias("n"), F.count_if(F.col("top") >= 800).alias("kept"))


# ---- review, votes, samples -----------------------------------------------------------------------------


def reviewable(spark, sf):
    rows = evidence(spark, sf).withColumnRenamed("idx", "pos")
    return rows.withColumn("unresolved", (F.col("pos") % 6).cast("int"))


REVIEW = f"""{OBS}, rv AS (SELECT image_id, idx AS pos, CAST(idx%6 AS INTEGER) AS unresolved, CASE WHEN idx%3 = 1 THEN 1 ELSE 0 END AS c, CASE WHEN idx%3=1 THEN (score_milli%100)/100 ELSE -1.0 END AS ov, score_milli/1000 AS s, (x2-x1)*(y2-y1) AS area, label FROM obs)"""


@query(f"WITH {REVIEW} SELECT image_id, pos, CAST(row_number() OVER (PARTITION BY image_id ORDER BY unresolved DESC, c, ov, s, area, pos) AS INTEGER) AS rank FROM rv")
def review_queue(spark, sf):
    return review.queue(reviewable(spark, sf), ["image_id"]).select("image_id", "pos", "rank")


@query(f"WITH {REVIEW} SELECT image_id, pos, row_number() OVER (ORDER BY unresolved DESC, c, ov, s, area, image_id, pos) AS rank FROM rv")
def review_queue_pooled(spark, sf):
    return review.queue(reviewable(spark, sf), ["image_id"], pooled=True).select("image_id", "pos", "rank")


@query(f"WITH {REVIEW}, r AS (SELECT label, row_number() OVER (ORDER BY unresolved DESC, c, ov, s, area, image_id, pos) AS rank FROM rv) SELECT CAST(b AS INTEGER) AS budget, label AS kind, count(*) AS n FROM r, (VALUES (100), (400), (1600)) v(b) WHERE rank <= b GROUP BY 1, 2")
def review_curve(spark, sf):
    return review.budget_curve(review.queue(reviewable(spark, sf), ["image_id"], pooled=True), "label", [100, 400, 1600])


@query(f"""WITH {OBS}, v AS (SELECT image_id, label, score_milli >= 300 AS vote FROM obs) SELECT image_id, label, bool_or(vote) AS any_agrees, bool_and(vote) AS all_agree, count(*) AS voters FROM v GROUP BY 1, 2""")
def set_votes(spark, sf):
    return review.vote_rules(observations(spark, sf).select("image_id", "label", (F.col("score_milli") >= 300).alias("vote")), ["image_id", "label"])


@query(f"""WITH {OBS}, b AS (SELECT DISTINCT image_id, label FROM obs WHERE idx%4 = 0), a AS (SELECT DISTINCT image_id, label FROM obs WHERE idx%4 = 1) SELECT *, 'recovered' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'lost' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def set_difference(spark, sf):
    obs = observations(spark, sf)
    return review.difference(obs.filter("idx % 4 = 0"), obs.filter("idx % 4 = 1"), ["image_id", "label"])


@query(f"""WITH {OBS}, p AS (SELECT image_id, idx, label, view_edge, md5('3|' || image_id || '|' || idx) AS h FROM obs), c AS (SELECT label, view_edge, count(*) AS n FROM p GROUP BY 1, 2), t AS (SELECT count(*) AS total FROM p),
r AS (SELECT p.*, row_number() OVER (PARTITION BY p.label, p.view_edge ORDER BY h, image_id, idx) AS k, greatest(1, round_even(500.0*n/total, 0)) AS q FROM p JOIN c USING (label, view_edge), t) SELECT image_id, idx, label, view_edge FROM r WHERE k <= q ORDER BY md5('trim|' || h), image_id, idx LIMIT 500""")
def sample_stratified(spark, sf):
    rows = observations(spark, sf).select("image_id", "idx", "label", "view_edge")
    return review.stratified_sample(rows, 500, ["label", "view_edge"], ["image_id", "idx"], seed=3)


@query(f"""WITH {OBS}, p AS (SELECT *, md5('0|' || image_id || '|' || idx) AS h FROM obs WHERE image_id % 7 <> 0 AND least(x2-x1, y2-y1) >= 17), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, image_id, idx) AS k FROM p) SELECT image_id, idx, label FROM r WHERE k <= 40""")
def sample_bank(spark, sf):
    obs = observations(spark, sf).select("image_id", "idx", "label", "box")
    excluded = obs.filter("image_id % 7 = 0").select("image_id")
    return review.capped_bank(obs, "label", ["image_id", "idx"], 40, excluded, on="image_id", least_side=17, box="box").select("image_id", "idx", "label")


@query(f"""WITH {OBS}, s AS (SELECT DISTINCT image_id, md5('7|' || image_id) AS h FROM obs WHERE image_id NOT IN (SELECT image_id FROM obs WHERE view_edge AND idx < 3)) SELECT image_id FROM s ORDER BY h, image_id LIMIT 18""")
def sample_slice(spark, sf):
    obs = observations(spark, sf)
    pool = obs.select("image_id").distinct().join(obs.filter("view_edge and idx < 3").select("image_id"), "image_id", "left_anti")
    return pool.orderBy(review.seeded_order(7, "image_id"), "image_id").limit(18)


@query(f"""WITH {OBS}, o AS (SELECT image_id, idx, row_number() OVER (PARTITION BY image_id ORDER BY idx) AS p, label FROM obs WHERE idx%2 = 0), c AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY idx) AS p, score_milli FROM obs WHERE idx%2 = 1) SELECT o.image_id, o.idx, o.label, c.score_milli FROM o JOIN c ON o.image_id = c.image_id AND o.p = c.p""")
def join_zip(spark, sf):
    """Positional pairing of two ordered lists of an image."""
    order = Window.partitionBy("image_id").orderBy("idx")
    a = observations(spark, sf).filter("idx % 2 = 0").withColumn("p", F.row_number().over(order)).select("image_id", "p", "idx", "label")
    b = observations(spark, sf).filter("idx % 2 = 1").withColumn("p", F.row_number().over(order)).select("image_id", "p", "score_milli")
    return a.join(b, ["image_id", "p"]).drop("p")


@query(f"""WITH {OBS}, s AS (SELECT image_id, idx, CASE WHEN idx%5 <> 0 THEN score_milli END AS s FROM obs WHERE idx%3 <> 0) SELECT o.label, count(s.s) AS scored, count(*) FILTER (s.s IS NULL) AS removed FROM obs o LEFT JOIN s USING (image_id, idx) GROUP BY 1""")
def join_external_scores(spark, sf):
    """A score looked up by key; rows without one leave the curve and are counted."""
    obs = observations(spark, sf)
    scores = obs.filter("idx % 3 <> 0").select("image_id", "idx", F.when(F.col("idx") % 5 != 0, F.col("score_milli")).alias("s"))
    joined = obs.join(scores, ["image_id", "idx"], "left")
    return joined.groupBy("label").agg(F.count("s").alias("scored"), F.count_if(F.col("s").isNull()).alias("removed"))


@query(f"""WITH {OBS}, {REFS}, {PAIRS}, m AS (SELECT DISTINCT image_id, idx FROM ov WHERE eligible AND 2*i >= u), t AS (SELECT image_id, ref, arg_max(idx, {{'a': i/u, 'b': -idx}}) AS idx FROM ov WHERE eligible AND 2*i >= u GROUP BY 1, 2)
SELECT o.label, count(*) AS n, count(*) FILTER (m.idx IS NOT NULL AND t.idx IS NULL) AS duplicates, count(*) FILTER (t.idx IS NULL) AS unmatched FROM obs o LEFT JOIN m USING (image_id, idx) LEFT JOIN (SELECT DISTINCT image_id, idx FROM t) t USING (image_id, idx) GROUP BY 1""")
def join_duplicates(spark, sf):
    """Unmatched boxes (anti join), and those of them that overlap a reference all the same (semi join)."""
    obs = observations(spark, sf)
    pairs = spatial.overlap_join(obs, refs_of(spark, sf).filter("eligible").select("image_id", "ref", "ref_box"), least=(1, 2)).select("image_id", "idx", "ref", g.iou("box", "ref_box").alias("iou"))
    taken = match(pairs, ["image_id"], "idx", "ref").select("image_id", "idx")
    left = obs.join(taken, ["image_id", "idx"], "left_anti")
    again = left.join(pairs, ["image_id", "idx"], "left_semi")
    sizes = obs.groupBy("label").agg(F.count("*").alias("n"))
    return sizes.join(again.groupBy("label").agg(F.count("*").alias("duplicates")), "label", "left").join(left.groupBy("label").agg(F.count("*").alias("unmatched")), "label", "left").fillna(0)


@query(f"""WITH RECURSIVE {CLOSURE}, {OBS} SELECT ancestor, count(*) AS n, CAST(max(CASE WHEN ancestor IN ('vehicle','person','car','van','truck') THEN 1 ELSE 0 END) AS INTEGER) AS useful FROM obs JOIN up ON up.class = obs.label GROUP BY 1""")
def agreement_ancestors(spark, sf):
    """The closure joined to emitted labels: how often each ancestor is claimed, over all depths."""
    closure = F.broadcast(ONTOLOGY.closure(spark))
    obs = observations(spark, sf).groupBy("label").agg(F.count("*").alias("n"))
    return closure.join(obs, closure["class"] == F.col("label")).groupBy("ancestor").agg(F.sum("n").alias("n"), F.max(lb.is_useful(ONTOLOGY, "ancestor").cast("int")).alias("useful"))


@query(f"""WITH {OBS}, {REFS} SELECT image_id, count(*) AS n_refs, (SELECT count(*) FROM obs o WHERE o.image_id = refs.image_id AND image_id % 17 <> 0) AS n_predictions, CASE WHEN image_id % 17 = 0 THEN 'missing' ELSE 'completed' END AS status FROM refs GROUP BY image_id""")
def src_assemble(spark, sf):
    """Images with their references and, where a run completed, its predictions; an absent run is missing."""
    refs = references(spark, sf).groupBy("image_id").agg(F.collect_list("ref").alias("refs"))
    runs_ = observations(spark, sf).filter("image_id % 17 <> 0").groupBy("image_id").agg(F.collect_list("idx").alias("preds"), F.lit("completed").alias("status"))
    joined = refs.join(runs_, "image_id", "left")
    return joined.select("image_id", F.size("refs").cast("long").alias("n_refs"), F.coalesce(F.size("preds"), F.lit(0)).cast("long").alias("n_predictions"), F.coalesce("status", F.lit("missing")).alias("status"))
