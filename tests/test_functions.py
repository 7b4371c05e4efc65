"""Edge cases of the column expressions on hand-made rows."""

import datetime

from pyspark.sql import functions as F

from cashtide.functions import clean, dates, ids, jsonmap, labels, money


def values(spark, rows, schema, column):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(column.alias("out")).collect()]


def test_type_labels(spark):
    rows = [(v,) for v in (" Deposit\n", "IN", "withdrawal", "cashOut", "p2p ", "  ", "", None)]
    got = values(spark, rows, "v string", labels.normalize_type("v"))
    assert got == ["cash_in", "cash_in", "cash_out", "cash_out", "p2p", None, None, None]


def test_direction_precedence(spark):
    rows = [
        ("deposit", "out", -5.0),
        ("p2p", "out", 5.0),
        (None, "refund", -5.0),
        (None, None, 5.0),
        (None, None, None),
        ("", "", -123000.0),
    ]
    got = values(
        spark, rows, "t string, e string, a double", labels.infer_direction("t", "e", "a")
    )
    assert got == ["cash_in", "cash_out", "cash_out", "cash_in", "cash_in", "cash_out"]


def test_inner_label_prefers_type(spark):
    rows = [('{"type":"in","direction":"out"}',), ('{"type":"","direction":"out"}',), ("[1]",),
            ("",), (None,)]
    assert values(spark, rows, "j string", jsonmap.inner_label("j")) == [
        "in", "out", None, None, None,
    ]


def test_amounts(spark):
    rows = [(-10.5, "usd"), (2.0, None), (3.0, ""), (1.0, "XXX"), (None, "JPY"), (1e7, "VND")]
    got = values(spark, rows, "a double, c string", money.amount_vnd("a", "c"))
    assert [None if v is None else float(v) for v in got] == [
        10.5 * 23650, 2.0, 3.0, None, 0.0, 1e7,
    ]


def test_clip_and_coerce(spark):
    rows = [("-1",), ("nan",), (None,), ("2.5",), ("abc",)]
    number = F.col("v").try_cast("double")
    assert values(spark, rows, "v string", clean.clip_non_negative(number)) == [0, 0, 0, 2.5, 0]
    assert values(spark, rows, "v string", clean.to_number("v")) == [-1, None, None, 2.5, None]
    assert values(spark, rows, "v string", clean.to_number("v", 0))[1] == 0.0


def test_dates(spark):
    rows = [
        ("2024-01-02", "2024-05-05T00:00:00"),
        ("bad", "2024-05-05T23:30:00-02:00"),
        (None, "2024-05-05T01:00:00"),
        (None, None),
    ]
    got = values(spark, rows, "d string, t string", dates.event_date("d", "t"))
    day = datetime.date
    assert got == [day(2024, 1, 2), day(2024, 5, 6), day(2024, 5, 5), None]


def test_calendar_flags(spark):
    days = ["2024-02-29", "2024-01-15", "2024-01-25", "2023-01-01"]
    rows = [(datetime.date.fromisoformat(d),) for d in days]

    def flag(fn):
        return values(spark, rows, "d date", fn("d"))

    assert flag(dates.is_month_end) == [1, 0, 0, 0]
    assert flag(dates.is_payday) == [1, 1, 0, 0]
    assert flag(dates.is_month_end_serving) == [1, 0, 1, 0]
    assert flag(dates.is_payday_serving) == [1, 1, 1, 0]
    assert flag(dates.is_weekend) == [0, 0, 0, 1]
    assert values(spark, rows, "d date", F.weekday("d"))[3] == 6


def test_serving_flags_take_the_15th_when_unreadable(spark):
    rows = [(None,)]
    assert values(spark, rows, "d date", dates.is_payday_serving("d")) == [1]
    assert values(spark, rows, "d date", dates.is_month_end_serving("d")) == [0]


def test_json_maps(spark):
    rows = [('{"a":"1","n":null}', '{"a":"2","b":null}'), (None, None), ("{}", '{"c":"3"}')]
    df = spark.createDataFrame(rows, "x string, y string")
    got = df.select(
        jsonmap.merge(jsonmap.decode("x"), jsonmap.decode("y")).alias("m"),
        jsonmap.set_default(jsonmap.decode("x"), jsonmap.decode("y")).alias("d"),
    ).collect()
    assert [plain(r.m) for r in got] == [{"a": "2", "n": None}, None, {"c": "3"}]
    assert [plain(r.d) for r in got] == [{"a": "1", "n": None}, None, {"c": "3"}]


def plain(held):
    """A map of variants as a dict."""
    return held and {k: v.toPython() for k, v in held.items()}


def test_json_values_keep_their_types(spark):
    text = '{"n":5,"o":{"a":[1,2]},"b":true,"z":null,"s":"x"}'
    df = spark.createDataFrame([(text,)], "x string")
    merged = jsonmap.merge(jsonmap.decode("x"), jsonmap.additions(k=F.lit("v")))
    row = df.select(jsonmap.encode(jsonmap.decode("x")), jsonmap.encode(merged)).first()
    assert row[0] == text and row[1] == text[:-1] + ',"k":"v"}'


def test_raw_extra_is_kept(spark):
    rows = [("plain",), ('{"a":"1"}',), ("",), (None,)]
    assert [plain(v) for v in values(spark, rows, "x string", jsonmap.keep_raw("x"))] == [
        {"raw_extra": "plain"}, {"a": "1"}, None, None,
    ]


def test_ids_are_stable_and_shaped(spark):
    rows = [("a", "b"), ("a", "b"), ("a", None)]
    got = values(spark, rows, "x string, y string", ids.hash_id("x", "y"))
    assert got[0] == got[1] != got[2]
    assert [len(part) for part in got[0].split("-")] == [8, 4, 4, 4, 12]


def test_class_label(spark):
    rows = [("p2p",), ("cash_in",), ("cash_out",), ("gift",), (None,)]
    assert values(spark, rows, "t string", labels.class_label("t")) == [
        "customer", "treasury", "treasury", "unknown", "unknown",
    ]
