"""All queries of the box operators by name, with their SQL."""

from __future__ import annotations

from quadrat.plans import files, pipelines, reports, rules, spatial

PLANS = (spatial, rules, reports, pipelines, files)


def flagship(spark, sf_dir):
    return reports.QUERIES["verify_strata"](spark, sf_dir)


def queries():
    return {k: v for plan in PLANS for k, v in plan.QUERIES.items()}


def oracle_sql():
    return {k: v for plan in PLANS for k, v in plan.SQL.items()}
