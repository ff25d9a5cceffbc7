"""Verification, audit and agreement reports over verification rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.functions import labels as lb
from quadrat.functions.stats import ratio, wilson

KNOWN, UNDECIDED = "true_positive", "undecided"


def _counts() -> list[Column]:
    known, undecided = F.col("known") == KNOWN, F.col("known") == UNDECIDED
    return [F.count("*").alias("retained"), F.count_if(known).alias("known_positives"), F.count_if(undecided).alias("undecided"), F.count_if(known & F.col("confirmed")).alias("known_confirmed"), F.count_if(undecided & F.col("confirmed")).alias("undecided_confirmed")]


def summarise(rows: DataFrame) -> DataFrame:
    """One row: confirmation rates of known positives and of undecided boxes, and precision under the two readings.

    The implied count and corrected precisions are null unless sensitivity is above 0 and some box is undecided.
    """
    c = rows.agg(*_counts()).withColumn("sensitivity", ratio("known_confirmed", "known_positives"))
    usable = (F.col("sensitivity") > 0) & (F.col("undecided") > 0)
    implied = F.when(usable, F.least(F.col("undecided").cast("double"), F.col("undecided_confirmed") / F.col("sensitivity")))
    return c.withColumns({"confirmation_on_undecided": ratio("undecided_confirmed", "undecided"), "uncorrected_precision": ratio("known_positives", "retained"), "implied_real": implied}).withColumns({"precision_if_confirmed": F.when(usable, ratio(F.col("known_positives") + F.col("undecided_confirmed"), F.col("retained"))), "precision_equal_sensitivity": ratio(F.col("known_positives") + F.col("implied_real"), F.col("retained"))})


def by_stratum(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(stratum, value, counts, rates): the same split for every value of every key, in one pass by grouping sets."""
    sets = rows.groupingSets([[F.col(k)] for k in keys], *map(F.col, keys)).agg(*_counts(), *(F.grouping(k).alias(f"__{k}") for k in keys))
    stratum = value = None
    for k in keys:
        mine = F.col(f"__{k}") == 0
        stratum = F.when(mine, k) if stratum is None else stratum.when(mine, k)
        value = F.when(mine, F.col(k).cast("string")) if value is None else value.when(mine, F.col(k).cast("string"))
    return sets.select(stratum.alias("stratum"), value.alias("value"), "known_positives", "undecided", ratio("known_confirmed", "known_positives").alias("sensitivity"), ratio("undecided_confirmed", "undecided").alias("confirmation_on_undecided"))


def agreement(rows: DataFrame, ontology: lb.Ontology, synonyms: dict[str, str] | None = None) -> DataFrame:
    """(outcome, emitted, verifier, n) of confirmed rows with a verifier label: exact, compatible (emitted is above) or conflict."""

    def norm(c: Column) -> Column:
        return F.coalesce(F.element_at(lb._literal(synonyms), c), c) if synonyms else c

    paired = rows.filter("confirmed and verifier_label is not null").select(norm(F.col("label")).alias("emitted"), norm(F.col("verifier_label")).alias("verifier"))
    outcome = F.when(F.col("emitted") == F.col("verifier"), "exact").when(lb.is_ancestor(ontology, "emitted", "verifier"), "compatible").otherwise("conflict")
    return paired.groupBy(outcome.alias("outcome"), "emitted", "verifier").agg(F.count("*").alias("n"))


def top_pairs(agreed: DataFrame, n: int = 8) -> DataFrame:
    """The n most frequent pairs of each outcome other than exact."""
    order = Window.partitionBy("outcome").orderBy(F.col("n").desc(), "emitted", "verifier")
    return agreed.filter("outcome <> 'exact'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def estimate_precision(verdicts: DataFrame, matched: int | Column, retained: int | Column, z: float = 1.96) -> DataFrame:
    """One row: corrected precision and its Wilson interval from judged unmatched boxes; undecidable ones leave both counts."""
    matched, retained = (x if isinstance(x, Column) else F.lit(x) for x in (matched, retained))
    c = verdicts.agg(F.count("*").alias("sampled"), *(F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("real", "false", "undecidable")))
    c = c.withColumns({"matched": matched, "retained": retained, "decided": F.col("n_real") + F.col("n_false")})
    interval = wilson("n_real", "decided", z)

    def corrected(p: Column) -> Column:
        return F.when(F.col("decided") > 0, (F.col("matched") + p * (F.col("retained") - F.col("matched"))) / F.when(F.col("retained") > 0, F.col("retained")))

    return c.withColumns({"undecidable_rate": ratio("n_undecidable", "sampled"), "uncorrected_precision": ratio("matched", "retained"), "real_rate": ratio("n_real", "decided"), "corrected_precision": corrected(ratio("n_real", "decided")), "low": corrected(interval["low"]), "high": corrected(interval["high"])})


def judged_accuracy(judgements: DataFrame) -> DataFrame:
    """One row: scored, correct, accuracy and the sorted distinct confusions of boxes judged real with a true label."""
    scored = judgements.filter("verdict = 'real' and true_label is not null")
    wrong = F.when(~F.col("true_label").eqNullSafe(F.col("label")), F.struct("label", "true_label"))
    counted = scored.agg(F.count("*").alias("scored"), F.count_if(F.col("true_label") == F.col("label")).alias("correct"), F.sort_array(F.collect_set(wrong)).alias("confusions"))
    return counted.withColumn("accuracy", ratio("correct", "scored"))


def stage_cost(timings: DataFrame, total_seconds: float, retained: int, stage: str = "stage", seconds: str = "seconds") -> DataFrame:
    """(stage, seconds, share, per_object) for the stages that ran, and ``unattributed`` for the rest of the total."""
    spent = timings.groupBy(F.col(stage).alias("stage")).agg(F.sum(seconds).alias("seconds"))
    rest = spent.agg(F.lit("unattributed").alias("stage"), (F.lit(total_seconds) - F.coalesce(F.sum("seconds"), F.lit(0.0))).alias("seconds"))
    rows = spent.unionByName(rest)
    return rows.withColumns({"share": ratio(F.col("seconds"), F.lit(total_seconds)), "per_object": ratio(F.col("seconds"), F.lit(retained))})


def arms(results: DataFrame, human: str = "human") -> DataFrame:
    """(arm, seeds, mean, spread, share_of_human): mean per arm, max - min over more than one seed, share of the human arm."""
    per = results.groupBy("arm").agg(F.count("*").alias("seeds"), F.avg("value").alias("mean"), F.when(F.count("*") > 1, F.max("value") - F.min("value")).alias("spread"))
    base = per.filter(F.col("arm") == human).select(F.col("mean").alias("base"))
    return per.join(F.broadcast(base), how="left").withColumn("share_of_human", ratio("mean", "base")).drop("base")
