import datetime as dt
import decimal

import frames
import pytest
from frames import at, rows
from pyspark.sql import functions as F

from orderlens.functions import sizes, text, times
from orderlens.operators import health, quality


@pytest.fixture(scope="module")
def bad_orders(spark):
    return frames.orders(
        spark,
        [
            ("o1", "c1", "p", at(0), 1, 5.0),
            ("o1", "c1", "p", at(1), 1, 0.0),
            ("o1", None, "p", at(2), 1, -1.0),
            (None, "c1", "p", at(3), 1, float("nan")),
            (None, "c1", "p", None, 1, None),
            ("o2", "c1", "p", at(4), 1, 1.0),
        ],
    )


def test_duplicates_count_ids_and_take_missing_as_one(bad_orders):
    assert rows(quality.duplicates(bad_orders)) == [(2,)]


def test_nulls_and_amounts(bad_orders):
    assert rows(quality.nulls(bad_orders)) == [(2, 1)]
    assert rows(quality.invalid_amounts(bad_orders)) == [(2,)]
    assert rows(quality.volume(bad_orders)) == [(6,)]


def test_freshness(spark, bad_orders):
    assert rows(quality.freshness(bad_orders, "2024-01-01 10:09:00")) == [(at(4), 5.0, False)]
    assert rows(quality.freshness(bad_orders, "2024-01-01 10:09:06"))[0][1:] == (5.1, True)
    assert rows(quality.freshness(bad_orders.limit(0), "2024-01-01 10:09:00")) == [
        (None, None, None)
    ]
    assert quality.freshness(bad_orders).first()["is_stale"]


def test_report(bad_orders):
    found = quality.report(bad_orders, "2024-01-01 10:05:00").first().asDict()
    assert found.pop("last_check") == at(5)
    assert found == {
        "duplicate_count": 2,
        "null_orders": 2,
        "null_customers": 1,
        "invalid_amounts": 2,
        "total_orders": 6,
        "issues_count": 4,
    }
    assert quality.report(bad_orders, "2024-01-01 11:00:00").first()["issues_count"] == 5


def test_report_of_nothing(bad_orders):
    found = quality.report(bad_orders.limit(0), "2024-01-01 10:05:00").first()
    assert tuple(found)[:6] == (0, 0, 0, 0, 0, 0)


def test_flow(spark):
    def flow(a, b):
        notes = [(0, {"orders": a}), (1, {"orders": b})]
        progress = spark.createDataFrame(notes, "batch_id bigint, rows map<string,bigint>")
        return rows(health.flow_between(progress, 0, 1))[0]

    assert flow(3, 5) == (3, 5, 2, True)
    assert flow(3, 3) == (3, 3, 0, False)
    assert flow(0, 3) == (0, 3, 3, False)


def test_recent_rate(bad_orders):
    assert rows(health.recent_rate(bad_orders, "2024-01-01 10:05:00")) == [(2, True)]
    assert rows(health.recent_rate(bad_orders, "2024-01-01 10:05:00", low=2)) == [(2, False)]


def test_document_bytes(spark):
    # {_id, s: "xyz", i: int32, d: double, n: null, z: {t: "é"}}, by the BSON layout.
    df = spark.createDataFrame(
        [("xyz", 1, 2.0, None, ("é",))],
        "s string, i int, d double, n string, z struct<t: string>",
    )
    fields = (3 + 4 + 3 + 1) + (3 + 4) + (3 + 8) + 3 + (3 + 4 + (3 + 4 + 2 + 1) + 1)
    assert df.select(sizes.document_bytes(df)).first()[0] == 4 + 17 + fields + 1


def test_size_bands(spark):
    def band(mb):
        size = spark.createDataFrame([(10, int(mb * sizes.MIB))], "rows bigint, bytes bigint")
        return health.size_band(size).first()["band"]

    assert [band(mb) for mb in (250, 251, 300, 301)] == ["ok", "near", "near", "archive"]


def test_size_of_nothing(spark, bad_orders):
    size = health.tier_size([bad_orders.limit(0)])
    assert rows(size) == [(0, 0)]
    assert health.size_band(size).first()["kb_per_row"] is None


def test_gate_is_reached_at_the_threshold(spark):
    size = spark.createDataFrame([(1, 300 * sizes.MIB)], "rows bigint, bytes bigint")
    assert health.archive_gate(size).first()["needs_archiving"]
    assert not health.archive_gate(size, 301).first()["needs_archiving"]


def test_storage_stats(spark, folder):
    spark.range(0, 100, 1, 4).write.parquet(folder + "/t")
    found = health.storage_stats({"t": spark.read.parquet(folder + "/t")}).first()
    assert (found["table_name"], found["row_count"], found["file_count"]) == ("t", 100, 4)
    assert found["size_mb"] > 0


def test_text(spark):
    df = spark.createDataFrame([(7, "Ohio", "Home")], "n bigint, a string, b string")
    found = df.select(
        text.order_key(F.col("n")),
        text.customer_key(F.col("n")),
        text.product_key(F.col("n")),
        text.payment_key(F.col("n")),
        text.pair_label("a", "b"),
        text.shown_time(F.lit("2024-01-01T10:00:00.123456")),
    )
    assert rows(found) == [
        ("ORD_00000007", "CUST_000007", "PROD_00007", "PAY_00000007", "Ohio - Home", "2024-01-01T10:00:00")
    ]
    long = df.select(text.product_key(F.lit(1234567)), text.product_key(F.lit(0)))
    assert rows(long) == [("PROD_1234567", "PROD_00000")]
    assert rows(text.json_rows(df.withColumn("b", F.lit(None).cast("string")))) == [
        ('{"n":7,"a":"Ohio","b":null}',)
    ]


def test_times(spark):
    df = spark.createDataFrame([("2024-01-01T10:00:59.5",), ("soon",)], "t string")
    found = df.select(times.parse_iso("t").alias("p")).select("p", times.minute_label("p"))
    assert rows(found) == [
        (dt.datetime(2024, 1, 1, 10, 0, 59, 500000), "2024-01-01T10:00"),
        (None, None),
    ]


def test_ticks_are_exact_for_four_decimals(spark):
    from orderlens.functions import money

    values = ["0.0001", "1.005", "99999999.9999", "-3.3333", "0.07", "90000000000.0001"]
    df = spark.createDataFrame([(float(v), decimal.Decimal(v)) for v in values], "d double, x decimal(18,4)")
    for d, x in rows(df.select(money.ticks("d"), money.ticks("x"))):
        assert d == x
    assert [r[0] for r in rows(df.select(money.ticks("d")))] == [
        int(decimal.Decimal(v) * 10000) for v in values
    ]
    assert df.select(money.cents(F.lit(10050))).first()[0] == 1.01


def test_shuffle_partitions():
    from orderlens.session import shuffle_partitions_for

    assert shuffle_partitions_for(0, cores=8) == 8
    assert shuffle_partitions_for(1 << 40) == 4096
    assert shuffle_partitions_for(100 << 40) == 40_000


def test_cut_off_keeps_fractions_of_a_minute(spark):
    from orderlens.plans.tiering import cutoff_before

    row = spark.range(1).select(cutoff_before("2024-01-01 00:10:00", 0.5).cast("string").alias("t")).first()
    assert row["t"] == "2024-01-01 00:09:30"
    row = spark.range(1).select(cutoff_before("2024-01-01 00:10:00", 2.9).cast("string").alias("t")).first()
    assert row["t"] == "2024-01-01 00:07:06"
