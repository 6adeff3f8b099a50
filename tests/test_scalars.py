import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dealtrace.functions import scalars as S
from dealtrace.operators import sweep


def apply(spark, values, build, type_="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
    return [r[1] for r in df.select("i", build("v").alias("r")).orderBy("i").collect()]


def test_domain(spark):
    raw = ["https://www.A.com/", "HTTP://a.com//", "a.com/x/", "None", "nan", "", " ", None, "\tb.com\n"]
    assert apply(spark, raw, S.domain) == ["a.com", "a.com", "a.com/x", None, None, None, None, None, "b.com"]


def test_null_tokens_match_whole_cells_only(spark):
    raw = ["null", "NULL", "None", "-", "", " - ", "Null", "x", None]
    assert apply(spark, raw, S.null_if_token) == [None] * 5 + [" - ", "Null", "x", None]


def test_flags(spark):
    raw = ["True", "false", "1", "no", "TRUE", "yes", None]
    assert apply(spark, raw, S.flag) == [True, False, True, False, None, True, None]
    assert apply(spark, raw, S.strict_flag) == [True, False, None, None, None, None, None]


def test_numbers(spark):
    raw = ["1.5", " 2 ", "-3e2", "bad", "1,234", "nan", "1d", "2F", "-Inf", None]
    assert apply(spark, raw, S.number) == [1.5, 2.0, -300.0, *[None] * 5, -math.inf, None]


def test_timestamps_month_first(spark):
    raw = ["2024-01-05", "1/2/2024", "2024-03-01T10:00:00Z", "2024-03-01 10:00:00.25", "bad", None, "13/2/2024"]
    got = apply(spark, raw, lambda c: F.date_format(S.timestamp(c), "yyyy-MM-dd HH:mm:ss.SS"))
    assert got == [
        "2024-01-05 00:00:00.00",
        "2024-01-02 00:00:00.00",
        "2024-03-01 10:00:00.00",
        "2024-03-01 10:00:00.25",
        None,
        None,
        None,
    ]


def test_country(spark):
    raw = ["usa", " UK ", "cote d'ivoire", "guinea-bissau", "NEW zealand", None]
    assert apply(spark, raw, S.country) == [
        "United States",
        "United Kingdom",
        "Cote D'Ivoire",
        "Guinea-Bissau",
        "New Zealand",
        None,
    ]


def test_lookups(spark):
    assert apply(spark, ["E-Learning", " It Services ", "Mining", None], S.industry) == [
        "Education",
        "IT Services",
        "Mining",
        None,
    ]
    assert apply(spark, ["Marketing: MQA", "Cold Call", "?", None], S.channel_of_source) == [
        "email_mqa",
        "sales",
        "other",
        "other",
    ]
    assert apply(spark, ["event", "sales", None], S.is_marketing) == [True, False, False]
    assert apply(spark, [" MarketingQualifiedLead", "Odd One", None], S.lifecycle_stage) == [
        "MQL",
        "Odd One",
        None,
    ]
    assert apply(spark, ["TBD", None, "A"], S.tier) == ["Unassigned", "Unassigned", "A"]


def test_segment_keywords_first_hit_wins(spark):
    raw = ["Why_MAAS intent", "High INTENT", "named account x", "priority", "zzz", None]
    assert apply(spark, raw, S.segment_category) == [
        "Why MAAS",
        "Intent",
        "Named Accounts",
        "Priority",
        "Other",
        "Unknown",
    ]


def test_revenue_bands_fill_only_missing_segments(spark):
    rows = [("S", 1e9), (None, 5e8), (None, 5e7), (None, 1.0), (None, None)]
    df = spark.createDataFrame(rows, "s string, r double")
    got = [r[0] for r in df.select(S.segment_from_revenue("s", "r")).collect()]
    assert got == ["S", "Enterprise", "Mid-Market", "Commercial", None]


def test_free_mail_keeps_nulls(spark):
    df = spark.createDataFrame([("gmail.com",), ("x.com",), (None,)], "d string")
    assert [r[0] for r in df.where(S.not_free_mail("d")).collect()] == ["x.com", None]


def test_ratios(spark):
    rows = [(0.0, 0.0), (5.0, 0.0), (1.0, 3.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    assert [r[0] for r in df.select(S.click_rate("a", "b")).collect()] == [None, None, 0.333333, None]
    assert [r[0] for r in df.select(S.cost_per_thousand("a", "b")).collect()] == [None, None, 333.3333, None]
    spend = spark.createDataFrame([(4.0, -1.0), (4.0, 0.0), (5.0, 2.0)], "p double, s double")
    assert [r[0] for r in spend.select(S.positive_ratio("p", "s")).collect()] == [None, None, 2.5]


def test_rounding_is_that_of_numpy(spark):
    values = [0.00005, 0.00015, 2.5, -0.33335, 1.00005] + [i / 80_000 for i in range(0, 4_000, 3)]
    got = apply(spark, values, lambda c: S.round_to(c, 4), "double")
    assert got == [float(np.round(v, 4)) for v in values]


def test_days_floor_towards_the_past(spark):
    t = dt.datetime(2024, 1, 2)
    rows = [(t - dt.timedelta(hours=1), t), (t + dt.timedelta(hours=36), t), (None, t)]
    df = spark.createDataFrame(rows, "a timestamp, b timestamp")
    assert [r[0] for r in df.select(S.whole_days_between("a", "b")).collect()] == [-1, 1, None]
    assert [r[0] for r in df.select(S.days_between("a", "b")).collect()] == [-1 / 24, 1.5, None]


def test_periods(spark):
    t = [dt.datetime(2024, 11, 5), None]
    assert apply(spark, t, S.month, "timestamp") == ["2024-11", None]
    assert apply(spark, t, lambda c: S.month(c, "NaT"), "timestamp") == ["2024-11", "NaT"]
    assert apply(spark, t, S.quarter, "timestamp") == ["2024Q4", None]


def test_decay(spark):
    got = apply(spark, [0.0, 30.0, 60.0], lambda c: sweep._power(-F.col(c) * S.MICROS_PER_DAY, 30), "double")
    assert got == [1.0, 0.5, 0.25]


def test_source_flags_and_touch_rules_differ(spark):
    raw = ["6si", "6sense-ads", "HS_Email", "my-email", "LinkedIn_x", " Google", "google", None]
    df = spark.createDataFrame([(v,) for v in raw], "v string")
    f = S.source_flags("v")
    assert [r[0] for r in df.select(f["is_display_traffic"]).collect()] == [True] + [False] * 7
    assert [r[0] for r in df.select(f["is_email_traffic"]).collect()] == [False, False, True] + [False] * 5
    assert [r[0] for r in df.select(f["is_organic"]).collect()] == [False] * 5 + [True, True, False]
    channel, kind = S.web_touch("v")
    assert [r[0] for r in df.select(channel).collect()] == [
        "6sense_display",
        "6sense_display",
        "email_mqa",
        "email_mqa",
        "linkedin",
        "web_inbound",
        "web_inbound",
        "web_inbound",
    ]
    assert [r[0] for r in df.select(kind).collect()][-3:] == [
        "web_visit_other",
        "web_visit_organic",
        "web_visit_other",
    ]


def test_stage_words(spark):
    raw = ["Closed Won", "lost", "Open", "Wonder", None]
    assert apply(spark, raw, S.is_closed_stage) == [True, True, False, True, False]


@pytest.mark.parametrize(
    "value, text",
    [(0.0, "$0"), (None, "$0"), (1_250_000.0, "$1.2M"), (34_500.0, "$34K"), (5.4, "$5"), (25e6, "$25.0M")],
)
def test_compact_money(spark, value, text):
    # Ties follow the double's exact value, as printf does.
    assert apply(spark, [value], S.compact_money, "double") == [text]


def test_percent_text_matches_exact_formatting(spark):
    values = [i / 10_000 for i in range(0, 10_001, 7)] + [0.3315, 0.00049999]
    got = apply(spark, values, S.percent_text, "double")
    assert got == [f"{v:.1%}" for v in values]


def test_report_texts(spark):
    assert apply(spark, [1234.4, None], S.dollar_text, "double") == ["$1,234", "$0"]
    assert apply(spark, [3.14, None], S.multiple_text, "double") == ["3.1x", None]
    assert apply(spark, [5.1, 1.9, 0.0, 3.0, None], S.roi_band, "double") == ["good", "poor", "", "", ""]
    assert apply(spark, ["a\nb\r", " x "], S.single_line) == ["a b", "x"]


def test_best_model(spark):
    rows = [(1.0, 1.0, 1.0, 1.0), (1.0, 2.0, 3.0, 4.0), (1.0, 2.0, 3.0, 3.0), (1.0, 2.0, 2.0, 0.0)]
    df = spark.createDataFrame(rows, "f double, l double, n double, d double")
    got = [r[0] for r in df.select(S.best_model("f", "l", "n", "d")).collect()]
    assert got == ["First-Touch", "Time-Decay", "Linear", "Last-Touch"]


def test_labels_and_prefixes(spark):
    assert apply(spark, ["_copytone", "cta_softness", "design_color"], S.attribute_label) == [
        "Tone",
        "Cta Softness",
        "Color",
    ]
    assert apply(spark, ["abcdef", None], lambda c: S.prefix(c, 3)) == ["abc", None]
    assert apply(spark, [0.25, None], S.percent_or_zero, "double") == [25.0, 0.0]
