"""Texts of the per-request outcomes, in one place (callers match the codes in
``config``; the texts are for people)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import config


def too_short(ticker: Column, found: Column) -> Column:
    return F.format_string("%s has %d feature rows, fewer than the %d that a model needs", ticker, found,
                           F.lit(config.MIN_FEATURE_ROWS))


def no_training_rows() -> Column:
    return F.lit("no row has all features and a target")


def too_few_for_folds(rows: Column, folds: int) -> Column:
    return F.format_string("%d rows cannot be cut into %d chronological folds", rows, F.lit(folds))


def not_finite() -> Column:
    return F.lit("a feature or the target is NaN or infinite")


def several_rows_a_day(days: Column) -> Column:
    return F.format_string("the price source has more than one row on %d of the series' days", days)


def fresh() -> Column:
    return F.lit("kept: the stored model is still current")


def invalid(violations: Column) -> Column:
    return F.concat(F.lit("rules broken: "), F.array_join(violations, ", "))


def not_listed() -> Column:
    return F.lit("the job does not train this horizon")


def no_model(ticker: Column, days: Column) -> Column:
    return F.format_string("%s has no stored model for %d days ahead", ticker, days)


def unusable_model(version: Column) -> Column:
    return F.format_string("the newest stored model %s is incomplete", version)
