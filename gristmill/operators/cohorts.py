"""Scopes and cohorts: who and what a run is about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def primary_category(categories: Column) -> Column:
    """The first of a comma-separated list, trimmed and lower-cased."""
    return F.lower(F.trim(F.get(F.split(categories, r"\s*,\s*"), 0)))


def in_scope(categories: Column, words: tuple[str, ...]) -> Column:
    """Whether the categories name any of the words."""
    return F.lower(F.coalesce(categories, F.lit(""))).rlike("|".join(words))


def cohort_filter(rows: DataFrame, cohort: DataFrame | None) -> DataFrame:
    """The rows of the cohort's users: all without a cohort, none with an empty one."""
    return rows if cohort is None else rows.join(cohort.select("user_id").distinct(), "user_id", "left_semi")


def eval_cohort(candidates: DataFrame, explicit: DataFrame | None, tested: DataFrame | None, top: int) -> DataFrame:
    """Candidates to be evaluated: of an explicit cohort if there is one, else of the model's test users, else of all; ``top`` a user."""
    return cohort_filter(candidates, explicit if explicit is not None else tested).where(F.col("pre_rank") <= top)
