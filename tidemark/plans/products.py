"""The feature products, each one lazy plan over five typed tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, functions as F

from tidemark import presets
from tidemark.functions.clock import SECONDS_PER_HOUR
from tidemark.functions.indicators import (
    age_years,
    category_indicator,
    is_abnormal,
    label_or_event,
    with_missing_flags,
)
from tidemark.functions.measures import MEASURES, bounded_means, feature_measures, trends
from tidemark.operators.align import (
    clip_counts,
    clip_to_interval,
    into_windows,
    on_entity_clock,
    within_first_hours,
)
from tidemark.operators.codes import CodeBook, normalise_events
from tidemark.operators.joins import many_to_one
from tidemark.operators.reference import eligible_start, envelope, first_start, stay_summary
from tidemark.operators.totals import entity_measures

# Called with a name, a table and aggregates; returns the table, whose next full pass also computes them.
Watch = Callable[..., DataFrame]
ENTITY = "hadm_id"
SPINE_COLUMNS = ["hadm_id", "subject_id", "mortality_label", "age", "gender_male"]


@dataclass(frozen=True)
class CohortTables:
    """Typed inputs.

    admissions: subject_id, hadm_id, admittime, deathtime, hospital_expire_flag
    patients:   subject_id, gender, dob
    stays:      hadm_id, icustay_id, intime, outtime, icu_los_days
    events:     hadm_id, itemid, charttime, valuenum
    labs:       hadm_id, charttime, valuenum, flag
    """

    admissions: DataFrame
    patients: DataFrame
    stays: DataFrame
    events: DataFrame
    labs: DataFrame
    # Stored in buckets of the entity: joins on it are left to the layout.
    colocated: bool = False


@dataclass(frozen=True)
class ProductSettings:
    book: CodeBook = presets.VITALS
    apply_ranges: bool = True
    cap_above: float | None = presets.AGE_CAP_ABOVE
    cap_to: float = presets.AGE_CAP_TO
    male: str = "M"
    window_hours: float = presets.WINDOW_HOURS
    clip_windows: bool = True
    early_hours: float = presets.EARLY_WINDOW_HOURS
    early_min_hours: float = presets.EARLY_MIN_HOURS
    mean_hours: Sequence[int] = presets.BOUNDED_MEAN_HOURS
    means_from_reference: bool = False
    trim_flags: bool = False
    tie_columns: Sequence[str] = ()


def _watched(tables: CohortTables, watch: Watch | None) -> CohortTables:
    """Tables whose rows are counted by the pass that reads them."""
    if watch is None:
        return tables
    return replace(tables, **{
        f.name: watch(f.name, getattr(tables, f.name)) for f in fields(tables) if isinstance(getattr(tables, f.name), DataFrame)
    })


def entity_spine(tables: CohortTables, settings: ProductSettings) -> DataFrame:
    """One row per admission: label, age and indicator."""
    admitted = tables.admissions.select(
        "subject_id", "hadm_id", "admittime", "deathtime", "hospital_expire_flag"
    )
    joined = many_to_one(admitted, tables.patients.select("subject_id", "gender", "dob"), "subject_id", "left")
    return joined.select(
        "hadm_id",
        "subject_id",
        label_or_event("hospital_expire_flag", "deathtime").alias("mortality_label"),
        age_years("admittime", "dob", settings.cap_above, settings.cap_to).alias("age"),
        category_indicator("gender", settings.male).alias("gender_male"),
    )


def _normalised(tables: CohortTables, settings: ProductSettings) -> DataFrame:
    columns = [ENTITY, "itemid", "charttime", "valuenum", *settings.tie_columns]
    return normalise_events(
        tables.events.select(*dict.fromkeys(columns)), settings.book, apply_ranges=settings.apply_ranges
    )


def _abnormal_count(settings: ProductSettings) -> Column:
    return F.count_if(is_abnormal("flag", trim_both=settings.trim_flags)).cast("double").alias("lab_abnormal_count")


def lab_summary(
    labs: DataFrame, settings: ProductSettings, wide: bool = False, median_labs: DataFrame | None = None
) -> DataFrame:
    """Mean, std, count and abnormal count per entity; ``wide`` adds min, max and median."""
    known = labs.where(F.col("valuenum").isNotNull())
    summary = known.groupBy(ENTITY).agg(
        *[MEASURES[m](F.col("valuenum")).alias(f"lab_value_{m}") for m in ("mean", "std", "count")],
        _abnormal_count(settings),
    )
    if not wide:
        return summary

    def as_events(rows: DataFrame) -> DataFrame:
        named = (F.lit("lab_value").alias("feature"), F.col("valuenum").cast("double").alias("value"))
        return rows.where(F.col("valuenum").isNotNull()).select(ENTITY, "flag", *named)

    return entity_measures(
        as_events(labs), ENTITY, ["lab_value"], ["mean", "std", "count", "min", "max", "median"], [_abnormal_count(settings)],
        as_events(labs if median_labs is None else median_labs),
    ).select(*summary.columns, "lab_value_min", "lab_value_max", "lab_value_median")


def lab_utilisation(placed: DataFrame, settings: ProductSettings) -> DataFrame:
    """Counts only: values of unlike tests are not averaged."""
    return placed.groupBy(ENTITY).agg(
        F.count("valuenum").cast("double").alias("lab_value_count"), _abnormal_count(settings)
    )


def _with_context(spine: DataFrame, *parts: DataFrame) -> DataFrame:
    for part in parts:
        spine = spine.join(part, ENTITY, "left")
    return spine


def compact_features(
    tables: CohortTables, settings: ProductSettings = ProductSettings(), watch: Watch | None = None
) -> DataFrame:
    """One row per admission: mean and count per feature, stay and lab summary, fixed flags."""
    tables = _watched(tables, watch)
    vitals = _normalised(tables, settings).groupBy(ENTITY).agg(
        *feature_measures(settings.book.features, ["mean", "count"])
    )
    stays = stay_summary(tables.stays)
    labs = lab_summary(tables.labs, settings)
    matrix = _with_context(entity_spine(tables, settings), stays, vitals, labs)
    flagged = [
        *[c for c in stays.columns if c != ENTITY],
        *[f"{f}_mean" for f in settings.book.features],
        *[c for c in labs.columns if c != ENTITY],
    ]
    return with_missing_flags(matrix, flagged)


def wide_features(
    tables: CohortTables, settings: ProductSettings = ProductSettings(), watch: Watch | None = None
) -> DataFrame:
    """One row per admission: six measures, bounded means and trend per feature, all flags.

    The whole-period and the time-bounded measures come from one pass: the reference time
    is attached first (left, so events of entities without intervals still count) and the
    time-bounded measures look only at placed events. Medians need no reference time.
    """
    features, plain = settings.book.features, tables
    tables = _watched(tables, watch)
    placed = on_entity_clock(_normalised(tables, settings), first_start(tables.stays), ENTITY, how="left", colocated=tables.colocated)
    hours = F.col("elapsed_seconds") / F.lit(float(SECONDS_PER_HOUR))
    order = [F.col("charttime"), *[F.col(c) for c in settings.tie_columns], F.col("value")]
    timed: dict[str, Column] = {}
    means = bounded_means(features, settings.mean_hours, hours, settings.means_from_reference)
    slopes = trends(features, order, F.col("elapsed_seconds").isNotNull())
    per_feature = len(settings.mean_hours)
    for i, f in enumerate(features):
        timed[f] = [*means[i * per_feature:(i + 1) * per_feature], slopes[i]]
    vitals = entity_measures(
        placed, ENTITY, features, ["mean", "count", "min", "max", "std", "median"],
        [column for f in features for column in timed[f]], _normalised(plain, settings),
    )
    matrix = _with_context(
        entity_spine(tables, settings), stay_summary(tables.stays), vitals,
        lab_summary(tables.labs, settings, wide=True, median_labs=plain.labs),
    )
    return with_missing_flags(matrix, keys=SPINE_COLUMNS)


def window_features(
    tables: CohortTables, settings: ProductSettings = ProductSettings(), watch: Watch | None = None
) -> DataFrame:
    """One row per admission and fixed-length window that holds an event.

    The one-row-per-admission context is joined once, after the windows are aggregated;
    it is the last step, so adaptive execution may split a hot admission's windows.
    """
    tables = _watched(tables, watch)
    placed = on_entity_clock(_normalised(tables, settings), envelope(tables.stays), ENTITY, colocated=tables.colocated)
    if settings.clip_windows:
        if watch is not None:
            placed = watch("clip", placed, *clip_counts())
        placed = clip_to_interval(placed)
    windows = into_windows(placed, settings.window_hours).groupBy(ENTITY, "window_idx").agg(
        *feature_measures(settings.book.features, ["mean", "min", "max", "std", "count"])
    )
    context = _with_context(
        entity_spine(tables, settings), stay_summary(tables.stays), lab_summary(tables.labs, settings)
    )
    return windows.join(context, ENTITY, "inner")


def early_window_features(
    tables: CohortTables, settings: ProductSettings = ProductSettings(), watch: Watch | None = None
) -> DataFrame:
    """One row per eligible admission, from events in the first hours only.

    Nothing here reads the end or the length of an interval except the eligibility test
    inside ``eligible_start``.
    """

    def early_events(source: CohortTables) -> DataFrame:
        starts = eligible_start(source.stays, settings.early_min_hours)
        placed = on_entity_clock(_normalised(source, settings), starts, ENTITY, colocated=source.colocated)
        return within_first_hours(placed, settings.early_hours)

    plain, tables = tables, _watched(tables, watch)
    cohort = eligible_start(tables.stays, settings.early_min_hours)
    vitals = entity_measures(
        early_events(tables), ENTITY, settings.book.features, ["mean", "min", "max", "std", "median", "count"],
        median_events=early_events(plain),
    )
    drawn = tables.labs.select(ENTITY, "charttime", "valuenum", "flag").where(F.col("valuenum").isNotNull())
    labs = lab_utilisation(
        within_first_hours(on_entity_clock(drawn, cohort, ENTITY, colocated=tables.colocated), settings.early_hours), settings
    )
    members = cohort.select(ENTITY).join(entity_spine(tables, settings), ENTITY, "inner")
    return with_missing_flags(_with_context(members, vitals, labs), keys=SPINE_COLUMNS)


PRODUCTS = {
    "compact": compact_features,
    "wide": wide_features,
    "timeseries": window_features,
    "early_window": early_window_features,
}


def feature_product(
    name: str, tables: CohortTables, settings: ProductSettings = ProductSettings(), watch: Watch | None = None
) -> DataFrame:
    """Product by name; an unknown name is an error. ``watch`` is told of all tables and of the events that are clipped."""
    if name not in PRODUCTS:
        raise ValueError(f"unknown product {name!r}; known: {sorted(PRODUCTS)}")
    return PRODUCTS[name](tables, settings, watch)
