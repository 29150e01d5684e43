"""Code books, the entity clock, intervals and measures on edge rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.helpers import rows, ts
from tidemark import presets
from tidemark.functions.clock import epoch_seconds, window_index
from tidemark.functions.indicators import age_years, category_indicator, is_abnormal, label_or_event
from tidemark.functions.measures import feature_measures, trends
from tidemark.operators.align import clip_audit, clip_to_interval, into_windows, on_entity_clock, within_first_hours
from tidemark.operators.codes import Code, CodeBook, normalise_events
from tidemark.operators.reference import eligible_start, envelope, first_interval, stay_summary

EVENTS = "hadm_id long, itemid int, charttime timestamp, valuenum double"


def test_ranges_are_inclusive_and_apply_after_conversion(spark):
    values = [(1, 211, 20.0), (2, 211, 250.0), (3, 211, 19.999), (4, 211, 250.001), (5, 678, 98.6), (6, 678, 200.0),
              (7, 676, 25.0), (8, 999, 80.0), (9, 211, None)]
    events = spark.createDataFrame([(i, c, None, v) for i, c, v in values], EVENTS)
    kept = {r["hadm_id"]: r for r in rows(normalise_events(events, presets.VITALS), "hadm_id")}
    assert sorted(kept) == [1, 2, 5, 7]
    assert kept[5]["feature"] == "temperature_c" and kept[5]["value"] == pytest.approx(37.0)
    loose = normalise_events(events, presets.VITALS, apply_ranges=False)
    assert sorted(r["hadm_id"] for r in rows(loose, "hadm_id")) == [1, 2, 3, 4, 5, 6, 7]


def test_first_entry_of_a_code_wins():
    book = CodeBook([Code(1, "a"), Code(1, "b"), Code(2, "b")])
    assert [(e.code, e.feature) for e in book.entries] == [(1, "a"), (2, "b")]


def test_code_book_as_columns_and_as_a_table(spark):
    events = spark.createDataFrame(
        [(i, c, None, float(v)) for i, (c, v) in enumerate([(211, 60), (678, 98), (676, 50), (646, 99), (5, 1), (211, 300)])],
        EVENTS,
    )
    book = presets.VITALS
    columns = events.select("hadm_id", "charttime", book.feature_of("itemid").alias("feature"), book.converted("itemid", "valuenum").alias("value"))
    inline = rows(columns.where(F.col("feature").isNotNull() & book.in_range()), "hadm_id")
    assert rows(normalise_events(events, book), "hadm_id") == inline and len(inline) == 3
    free = rows(normalise_events(events, presets.VITALS, apply_ranges=False), "hadm_id")
    assert len(free) == 5


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_epoch_seconds_cut_off_fractions_downwards(spark, kind):
    times = ["1969-12-31 23:59:59.500", "1970-01-01 00:00:00.999", "2024-02-29 12:30:45.250"]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast(kind).alias("t"))
    found = [r[0] for r in df.select(epoch_seconds(df, "t")).collect()]
    assert found == [-1, 0, int(dt.datetime(2024, 2, 29, 12, 30, 45, tzinfo=dt.timezone.utc).timestamp())]


def test_zoneless_clock_does_not_depend_on_the_session_zone(spark):
    df = spark.sql("select timestamp_ntz'2024-03-31 02:30:00' as t")
    before = spark.conf.get("spark.sql.session.timeZone")
    found = []
    for zone in ("UTC", "Europe/Berlin"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        found.append(df.select(epoch_seconds(df, "t")).first()[0])
    spark.conf.set("spark.sql.session.timeZone", before)
    assert found[0] == found[1]


def stays(spark, data):
    return spark.createDataFrame(
        [(h, s, ts(a) if a else None, ts(b) if b else None, d) for h, s, a, b, d in data],
        "hadm_id long, icustay_id long, intime timestamp, outtime timestamp, icu_los_days double",
    )


STAYS = [
    (1, 10, "2024-01-01 00:00:00", "2024-01-01 12:00:00", 0.5),
    (1, 11, "2024-01-05 00:00:00", "2024-01-06 00:00:00", 1.0),
    (2, 20, "2024-01-01 00:00:00", "2024-01-03 00:00:00", 2.0),
    (3, 30, None, "2024-01-03 00:00:00", None),
    (4, 41, "2024-01-01 00:00:00", "2024-01-04 00:00:00", 3.0),
    (4, 40, "2024-01-01 00:00:00", "2024-01-01 01:00:00", 0.04),
    (5, 50, "2024-01-01 00:00:00", None, None),
]


def test_envelope_first_interval_and_eligibility(spark):
    table = stays(spark, STAYS)
    spans = {r["hadm_id"]: r for r in rows(envelope(table), "hadm_id")}
    assert sorted(spans) == [1, 2, 4, 5]
    assert spans[1]["ref_end"] == ts("2024-01-06 00:00:00") and spans[5]["ref_end"] is None
    first = {r["hadm_id"]: r["icustay_id"] for r in rows(first_interval(table), "hadm_id")}
    assert first == {1: 10, 2: 20, 4: 40}
    # Entity 1 reaches 48 h only with the gap between its stays; entity 4's first stay is one hour.
    eligible = eligible_start(table, 48)
    assert [r["hadm_id"] for r in rows(eligible, "hadm_id")] == [2]
    assert eligible.columns == ["hadm_id", "ref_start"]
    summary = {r["hadm_id"]: r for r in rows(stay_summary(table), "hadm_id")}
    assert summary[1]["icu_los_total"] == 1.5 and summary[1]["icu_stay_count"] == 2.0
    assert summary[3]["icu_los_mean"] is None and summary[3]["icu_stay_count"] == 1.0


def placed(spark, how="inner"):
    times = {
        1: "2024-01-01 00:00:00", 2: "2024-01-03 00:00:00", 3: "2023-12-31 23:59:59", 4: "2024-01-03 00:00:01",
        5: "2024-01-02 23:59:59.9", 6: "2024-01-01 06:00:00", 7: "2024-01-01 05:59:59.9", 8: None,
    }
    events = spark.createDataFrame(
        [(2, i, ts(t) if t else None, float(i)) for i, t in times.items()] + [(9, 99, ts("2024-01-01"), 1.0)], EVENTS
    )
    return on_entity_clock(events, envelope(stays(spark, STAYS)), how=how)


def test_interval_edges(spark):
    clock = placed(spark)
    assert {r["itemid"] for r in rows(clock, "itemid")} == {1, 2, 3, 4, 5, 6, 7}
    assert {r["itemid"] for r in rows(clip_to_interval(clock), "itemid")} == {1, 2, 5, 6, 7}
    assert {r["itemid"] for r in rows(within_first_hours(clock, 48), "itemid")} == {1, 5, 6, 7}
    windows = {r["itemid"]: r["window_idx"] for r in rows(into_windows(clock, 6), "itemid")}
    assert windows == {1: 0, 2: 8, 4: 8, 5: 7, 6: 1, 7: 0}
    audit = clip_audit(clock).first()
    assert (audit["candidate_rows"], audit["kept_rows"], audit["clipped_rows"]) == (7, 5, 2)
    left = rows(placed(spark, "left"), "itemid")
    assert len(left) == 9 and [r["elapsed_seconds"] for r in left if r["itemid"] in (8, 99)] == [None, None]


def test_an_open_interval_clips_everything(spark):
    events = spark.createDataFrame([(5, 1, ts("2024-01-01 01:00:00"), 1.0)], EVENTS)
    clock = on_entity_clock(events, envelope(stays(spark, STAYS)))
    assert clip_to_interval(clock).count() == 0 and into_windows(clock, 6).count() == 1


def test_window_index_of_negative_time(spark):
    df = spark.createDataFrame([(-1,), (0,), (21599,), (21600,)], "s long")
    assert [r[0] for r in df.select(window_index(F.col("s"), 6)).collect()] == [-1, 0, 0, 1]


def test_measures_of_sparse_entities(spark):
    data = [(1, "a", 2.0), (1, "a", 4.0), (2, "a", 5.0), (3, "b", 1.0)]
    df = spark.createDataFrame(data, "k long, feature string, value double")
    out = {r["k"]: r for r in rows(df.groupBy("k").agg(*feature_measures(["a", "b"], ["mean", "count", "std"])), "k")}
    assert out[1]["a_mean"] == 3.0 and out[1]["a_std"] == pytest.approx(2 ** 0.5)
    assert out[2]["a_std"] is None
    assert out[3]["a_count"] == 0.0 and out[3]["a_mean"] is None
    with pytest.raises(ValueError):
        feature_measures(["a"], ["mode"])


def test_trend_with_equal_times_uses_the_tie_breaker(spark):
    data = [(1, 1, 10, 5.0), (1, 1, 11, 7.0), (1, 2, 12, 9.0), (1, 2, 13, 20.0), (2, 1, 1, 3.0)]
    df = spark.createDataFrame(data, "k long, t int, id int, value double").withColumn("feature", F.lit("a"))
    for shuffled in (df, df.orderBy(F.desc("id"))):
        out = shuffled.groupBy("k").agg(*trends(["a", "b"], [F.col("t"), F.col("id")]))
        assert [(r["k"], r["a_trend"], r["b_trend"]) for r in rows(out, "k")] == [(1, 15.0, None), (2, 0.0, None)]


def test_abnormal_flags(spark):
    flags = [None, "", " ", "normal", "NORMAL", " normal ", "abnormal", "delta"]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(flags)], "i int, flag string")
    plain = [r[0] for r in df.orderBy("i").select(is_abnormal("flag")).collect()]
    assert plain == [False, False, False, False, False, True, True, True]
    trimmed = [r[0] for r in df.orderBy("i").select(is_abnormal("flag", trim_both=True)).collect()]
    assert trimmed == [False, False, False, False, False, False, True, True]


def test_age_label_and_indicator(spark):
    data = [
        (1, "2000-01-01", "1911-01-01", "m", None, None), (2, "2000-02-01", "1911-01-01", "F", 0, "2000-01-02"),
        (3, "2100-01-01", "1800-01-01", None, None, "2000-01-02"), (4, "2000-01-01", None, "M", 1, None),
    ]
    df = spark.createDataFrame(
        [(i, ts(a), ts(b) if b else None, g, f, ts(d) if d else None) for i, a, b, g, f, d in data],
        "i int, admit timestamp, dob timestamp, gender string, flag int, died timestamp",
    )
    out = rows(df.select("i", age_years("admit", "dob").alias("age"), age_years("admit", "dob", None).alias("free"),
                         category_indicator("gender", "M").alias("male"), label_or_event("flag", "died").alias("label")), "i")
    assert [r["age"] for r in out] == [89.0, 90.0, 90.0, None]
    assert out[2]["free"] == pytest.approx(300.0)
    assert [r["male"] for r in out] == [1.0, 0.0, 0.0, 1.0]
    assert [r["label"] for r in out] == [0, 0, 1, 1]
