import datetime as dt

import pytest
from frames import rows
from pyspark.sql import functions as F

from orderlens import schemas
from orderlens.operators.changes import fold, merge
from orderlens.plans import tiering
from orderlens.sources import files
from orderlens.sources.published import (
    publish,
    published_count,
    published_names,
    published_or_compute,
    read_published,
)
from orderlens.sources import store as store_module
from orderlens.sources.store import HotStore

CHANGE = "k string, a string, b int, present array<string>, seq bigint"


def change_frame(spark, values):
    return spark.createDataFrame(values, CHANGE)


def test_fold_keeps_absent_and_takes_null(spark):
    changes = change_frame(
        spark,
        [
            ("x", "one", 1, ["k", "a", "b"], 1),
            ("x", "two", None, ["k", "a"], 2),  # b absent: stays
            ("y", "one", 1, ["k", "a", "b"], 1),
            ("y", None, 2, ["k", "a", "b"], 2),  # a null: overwritten
            ("y", "lost", None, ["k"], 3),  # sets nothing but the key
            ("z", None, None, ["k"], 1),
        ],
    )
    found = {r["k"]: (r["a"], r["b"], sorted(r["present"])) for r in fold(changes, "k", "seq").collect()}
    assert found == {
        "x": ("two", 1, ["a", "b", "k"]),
        "y": (None, 2, ["a", "b", "k"]),
        "z": (None, None, ["k"]),
    }


def test_fold_in_steps_is_fold_at_once(spark):
    values = [
        (f"k{i % 3}", f"a{i}", i, ["k", "a"] if i % 2 else ["k", "b"], i) for i in range(30)
    ]
    every = change_frame(spark, values)
    at_once = fold(every, "k", "seq")
    state = fold(every.where("seq < 10"), "k", "seq")
    late = fold(every.where("seq >= 10"), "k", "seq")
    stepwise = merge(state, late, "k")
    assert sorted(rows(stepwise.select("k", "a", "b"))) == sorted(rows(at_once.select("k", "a", "b")))


def test_merge_passes_on_what_is_not_named(spark):
    state = fold(change_frame(spark, [("x", "1", 1, ["k", "a", "b"], 1), ("y", "1", 1, ["k", "a"], 1)]), "k", "seq")
    late = fold(change_frame(spark, [("y", None, 5, ["k", "b"], 2), ("z", "9", None, ["k", "a"], 2)]), "k", "seq")
    assert sorted(rows(merge(state, late, "k").select("k", "a", "b"))) == [
        ("x", "1", 1),
        ("y", "1", 5),
        ("z", "9", None),
    ]


def test_merge_takes_a_null_key_as_one_key(spark):
    state = fold(change_frame(spark, [(None, "1", 1, ["k", "a", "b"], 1)]), "k", "seq")
    late = fold(change_frame(spark, [(None, "2", None, ["k", "a"], 2)]), "k", "seq")
    assert rows(merge(state, late, "k").select("k", "a", "b")) == [(None, "2", 1)]


def order_frame(spark, numbers):
    return spark.createDataFrame([(n,) for n in numbers], "n int").select(
        F.format_string("o%d", "n").alias("order_id"),
        F.lit("c").alias("customer_id"),
        F.lit("p").alias("product_id"),
        F.when(F.col("n") >= 0, F.timestamp_seconds(F.col("n") * 60)).alias("timestamp"),
        F.lit(1).alias("quantity"),
        F.lit(1.0).alias("unit_price"),
        F.lit(1.0).alias("total_amount"),
        F.lit(1.0).alias("shipping_cost"),
        F.lit(1.0).alias("tax_amount"),
        F.lit("completed").alias("order_status"),
    )


def ids(df):
    return sorted(r[0] for r in df.select("order_id").collect())


def names(numbers):
    return sorted(f"o{n}" for n in numbers)


def test_batches_add_and_replays_replace(spark, folder):
    store = HotStore(spark, folder)
    assert store.committed() == -1 and ids(store.orders()) == []
    store.write_batch(0, {"orders": order_frame(spark, [1, 2])})
    store.write_batch(1, {"orders": order_frame(spark, [2, 3])})
    assert ids(store.orders()) == names([1, 2, 2, 3])
    # The last batch may come again; an earlier one cannot.
    store.write_batch(1, {"orders": order_frame(spark, [2, 3])})
    assert ids(store.orders()) == names([1, 2, 2, 3])
    with pytest.raises(ValueError):
        store.write_batch(0, {"orders": order_frame(spark, [9])})
    assert ids(store.orders()) == names([1, 2, 2, 3])


def test_unfinished_batch_is_not_seen(spark, folder, monkeypatch):
    store = HotStore(spark, folder)
    store.write_batch(0, {"orders": order_frame(spark, [1]), "customers": customer_change(spark, "x", name="Ann")})
    with monkeypatch.context() as patched:
        patched.setattr(files, "write_text", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.write_batch(1, {"orders": order_frame(spark, [7]), "customers": customer_change(spark, "x", name="Bo")})
    assert ids(store.orders()) == names([1]) and store.customers().first()["name"] == "Ann"
    store.write_batch(1, {"orders": order_frame(spark, [7]), "customers": customer_change(spark, "x", state="Ohio")})
    assert ids(store.orders()) == names([1, 7])
    assert rows(store.customers().select("name", "state")) == [("Ann", "Ohio")]


def test_noted_sizes_are_the_sizes(spark, folder):
    from orderlens.operators.health import tier_size

    store = HotStore(spark, folder)

    def same():
        held = store.tables()
        return store.sizes() == {name: rows(tier_size([table]))[0] for name, table in held.items()}

    assert same()
    store.write_batch(0, {"orders": order_frame(spark, [-1, 10, 200, 5000])})
    store.write_batch(1, {"orders": order_frame(spark, [3]), "customers": customer_change(spark, "x", name="Ann")})
    assert same() and store.order_size()[0] == 5
    more = customer_change(spark, "x", name="Annabel").unionByName(customer_change(spark, "y", name="Bo"))
    for _ in range(2):
        store.write_batch(2, {"orders": order_frame(spark, []), "customers": more})
        assert same() and store.sizes()["customers"][0] == 2
    tiering.archive_old_orders(store, folder + "/cold", "1970-01-01 02:00:00", database(folder), "a", 0)
    assert same() and store.order_size()[0] == 3
    store.write_batch(3, {"orders": order_frame(spark, [4])})
    assert same() and rows(store.size())[0][0] == 6


def customer_change(spark, key, **fields):
    given = {"customer_id": key, **fields}
    columns = [
        F.lit(given.get(f.name)).cast(f.dataType).alias(f.name) for f in schemas.CUSTOMERS.fields
    ]
    return spark.range(1).select(*columns, F.array(*map(F.lit, given)).alias("present"))


def versions(store, table="customers"):
    return {bucket: batch for bucket, batch, _ in sorted(store._all_versions(table))}


def test_a_batch_rewrites_the_buckets_it_touches(spark, folder):
    store = HotStore(spark, folder, buckets=16)
    first = [customer_change(spark, f"c{i}", name=f"n{i}") for i in range(40)]
    whole = first[0]
    for more in first[1:]:
        whole = whole.unionByName(more)
    store.write_batch(0, {"customers": whole})
    assert len(versions(store)) > 8
    store.write_batch(1, {"customers": customer_change(spark, "c7", state="Iowa")})
    assert sorted(versions(store).values())[-2:] == [0, 1]
    found = {r["customer_id"]: (r["name"], r["state"]) for r in store.customers().collect()}
    assert found["c7"] == ("n7", "Iowa") and found["c8"] == ("n8", None) and len(found) == 40
    # A store that is opened with another number keeps its own.
    assert rows(HotStore(spark, folder).row("customers", "c7").select("name")) == [("n7",)]
    for batch in range(2, 6):
        store.write_batch(batch, {"customers": customer_change(spark, "c7", city=f"city {batch}")})
    held = [batch for _, batch, _ in store._all_versions("customers") if batch]
    assert sorted(held) == [4, 5]


def test_reading_state_folds_nothing_and_a_key_reads_one_bucket(spark, folder):
    store = HotStore(spark, folder, buckets=16)
    for batch in range(2):
        changes = [customer_change(spark, f"c{i}", name=f"n{batch}") for i in range(20)]
        whole = changes[0]
        for more in changes[1:]:
            whole = whole.unionByName(more)
        store.write_batch(batch, {"customers": whole})
    plan = store.customers()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    one = store.row("customers", "c3")
    assert len(one.inputFiles()) == 1 < len(store.customers().inputFiles())
    assert rows(one.select("customer_id", "name")) == [("c3", "n1")]


DAYS = [0, 5, 1440, 1445, 2880, 2885, 4320, -1]


def test_old_orders_are_looked_for_in_their_days(spark, folder):
    store = HotStore(spark, folder)
    store.write_batch(0, {"orders": order_frame(spark, DAYS)})
    old = tiering.candidates(store.dated_orders(), "1970-01-02 00:02:00")
    plan = old._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "order_date" in plan.split("PartitionFilters")[1].split("]")[0]
    assert ids(old) == names([0, 5, 1440])
    rest = tiering.remainder(store.dated_orders(), "1970-01-02 00:02:00")
    assert ids(rest) == names([1445, 2880, 2885, 4320, -1])


def test_an_archive_rewrites_one_day(spark, folder):
    store = HotStore(spark, folder + "/hot")
    store.write_batch(0, {"orders": order_frame(spark, DAYS)})

    def held():
        return {path.split("/")[-3]: path for path in store.orders().inputFiles()}

    before = held()
    tiering.archive_old_orders(store, folder + "/cold", "1970-01-02 00:02:00", database(folder), "a", 0)
    after = held()
    assert "order_date=1970-01-01" not in after
    assert after["order_date=1970-01-02"] != before["order_date=1970-01-02"]
    same = ["order_date=1970-01-03", "order_date=1970-01-04", "order_date=__HIVE_DEFAULT_PARTITION__"]
    assert all(after[day] == before[day] for day in same)
    assert ids(store.orders()) == names([1445, 2880, 2885, 4320, -1])


def test_a_removal_that_was_cut_short_is_ended_by_the_next_write(spark, folder, monkeypatch):
    store = HotStore(spark, folder + "/hot")
    store.write_batch(0, {"orders": order_frame(spark, DAYS)})
    cold, db = folder + "/cold", database(folder)
    with monkeypatch.context() as patched:
        patched.setattr(HotStore, "_overwrite", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            tiering.archive_old_orders(store, cold, "1970-01-02 00:02:00", db, "a", 0)
    store.write_batch(1, {"orders": order_frame(spark, [1441])})
    assert ids(store.orders()) == names([1441, 1445, 2880, 2885, 4320, -1])
    assert ids(tiering.read_archives(spark, cold)) == names([0, 5, 1440])
    assert store.order_size()[0] == 6


def test_compact_writes_a_day_of_many_batches_as_one(spark, folder, monkeypatch):
    monkeypatch.setattr(store_module, "DAY_BATCHES", 2)
    store = HotStore(spark, folder)
    for batch in range(4):
        store.write_batch(batch, {"orders": order_frame(spark, [batch, 3000])})
    store.write_batch(4, {"orders": order_frame(spark, [9000])})
    wanted = ids(store.orders())
    assert store.compact() == ["1970-01-01", "1970-01-03"] and store.compact() == []
    assert ids(store.orders()) == wanted and store.order_size()[0] == 9
    store.write_batch(4, {"orders": order_frame(spark, [9000])})
    assert ids(store.orders()) == wanted


# -- publishing ------------------------------------------------------------------------


def test_publish_replaces_and_keeps_a_few(spark, folder):
    for n in range(4):
        publish(spark, folder, "numbers", spark.range(n), keep=2)
    assert read_published(spark, folder, "numbers").count() == 3
    assert len(files.names(spark, f"{folder}/numbers/data")) == 2
    assert published_names(spark, folder) == ["numbers"]
    publish(spark, folder, "more", spark.range(1))
    assert rows(published_count(spark, folder)) == [(2,)]


def test_same_version_is_one_publication(spark, folder):
    publish(spark, folder, "numbers", spark.range(1), version=1)
    publish(spark, folder, "numbers", spark.range(2), version=2)
    publish(spark, folder, "numbers", spark.range(2), version=2)
    assert read_published(spark, folder, "numbers").count() == 2
    assert len(files.names(spark, f"{folder}/numbers/_current")) == 2


def test_failed_publish_leaves_the_earlier_version(spark, folder):
    publish(spark, folder, "numbers", spark.range(3))
    with pytest.raises(Exception):
        publish(spark, folder, "numbers", spark.range(1).select(F.raise_error(F.lit("no")).alias("id")))
    assert read_published(spark, folder, "numbers").count() == 3


def test_published_or_compute(spark, folder):
    def either():
        return published_or_compute(spark, folder, "n", lambda: spark.range(1)).first()

    assert read_published(spark, folder, "n") is None
    assert either()["from_cache"] is False
    publish(spark, folder, "n", spark.range(1))
    assert either()["from_cache"] is True


# -- tiering ---------------------------------------------------------------------------

CUTOFF = "1970-01-01 00:05:00"


@pytest.fixture
def store(spark, folder):
    store = HotStore(spark, folder + "/hot")
    store.write_batch(0, {"orders": order_frame(spark, range(-1, 6))})
    store.write_batch(1, {"orders": order_frame(spark, range(4, 9))})
    return store


ALL = [*range(-1, 6), *range(4, 9)]
OLD = [n for n in ALL if 0 <= n < 5]
NEW = [n for n in ALL if not 0 <= n < 5]


def database(folder):
    return "db_" + "".join(c for c in folder if c.isalnum())


def test_archive_splits_the_orders(spark, folder, store):
    cold, db = folder + "/cold", database(folder)
    report = tiering.archive_old_orders(store, cold, CUTOFF, db, "a1", threshold_mb=0).first()
    assert ids(store.orders()) == names(NEW)  # the order without a time stays
    assert ids(tiering.read_archives(spark, cold)) == names(OLD)
    assert (report["archived_orders"], report["remaining_orders"]) == (len(OLD), len(NEW))
    assert report["saved_mb"] > 0
    entry = tiering.manifest(spark, db).first()
    assert (entry["archive_id"], entry["record_count"]) == ("a1", len(OLD))
    assert entry["threshold_date"] == dt.datetime(1970, 1, 1, 0, 5)
    assert entry["storage_location"].endswith("archive_id=a1")
    assert spark.table(f"{db}.archived_orders_a1").count() == len(OLD)
    assert rows(tiering.archive_count(spark, db)) == [(1,)]
    assert spark.read.json(f"{cold}/metadata/a1").first()["record_count"] == len(OLD)


def test_rerun_changes_nothing(spark, folder, store):
    cold, db = folder + "/cold", database(folder)
    tiering.archive_old_orders(store, cold, CUTOFF, db, "a1", threshold_mb=0)
    assert tiering.archive_old_orders(store, cold, CUTOFF, db, "a1", threshold_mb=0) is None
    assert ids(store.orders()) == names(NEW)
    assert ids(tiering.read_archives(spark, cold)) == names(OLD)
    assert rows(tiering.archive_count(spark, db)) == [(1,)]


def test_finished_archive_is_not_replaced(spark, folder, store):
    cold, db = folder + "/cold", database(folder)
    tiering.archive_old_orders(store, cold, CUTOFF, db, "a1", threshold_mb=0)
    store.write_batch(2, {"orders": order_frame(spark, [2])})
    with pytest.raises(ValueError):
        tiering.archive_old_orders(store, cold, CUTOFF, db, "a1", threshold_mb=0)
    assert ids(tiering.read_archives(spark, cold)) == names(OLD)
    assert ids(store.orders()) == names([*NEW, 2])


def test_second_archive_leaves_the_first(spark, folder, store):
    cold, db = folder + "/cold", database(folder)
    tiering.archive_old_orders(store, cold, CUTOFF, db, "a1", threshold_mb=0)
    store.write_batch(2, {"orders": order_frame(spark, [2])})
    later = "1970-01-01 00:07:00"
    tiering.archive_old_orders(store, cold, later, db, "a2", threshold_mb=0)
    everything = [*ids(store.orders()), *ids(tiering.read_archives(spark, cold))]
    assert sorted(everything) == names([*ALL, 2])
    assert rows(tiering.archive_count(spark, db)) == [(2,)]
    assert spark.table(f"{db}.archived_orders_a1").count() == len(OLD)


def test_below_threshold_or_nothing_old(spark, folder, store):
    cold, db = folder + "/cold", database(folder)
    assert tiering.archive_old_orders(store, cold, CUTOFF, db) is None
    assert tiering.archive_old_orders(store, cold, "1960-01-01", db, threshold_mb=0) is None
    assert not files.exists(spark, cold)


@pytest.mark.parametrize("step", ["record_archive", "register_archive", "removal"])
def test_failure_leaves_hot_whole_and_rerun_completes(spark, folder, store, monkeypatch, step):
    cold, db = folder + "/cold", database(folder)

    def fail(*_args, **_kwargs):
        raise OSError("gone")

    with monkeypatch.context() as patched:
        patched.setattr(*((HotStore, "remove_orders") if step == "removal" else (tiering, step)), fail)
        with pytest.raises(OSError):
            tiering.archive_old_orders(store, cold, CUTOFF, db, "a1", threshold_mb=0)
    assert ids(store.orders()) == names(ALL)
    tiering.archive_old_orders(store, cold, CUTOFF, db, "a1", threshold_mb=0)
    assert ids(store.orders()) == names(NEW)
    assert ids(tiering.read_archives(spark, cold)) == names(OLD)
    assert rows(tiering.archive_count(spark, db)) == [(1,)]
    assert spark.table(f"{db}.archived_orders_a1").count() == len(OLD)


def test_cutoff_defaults_to_five_minutes(spark):
    cut = spark.range(1).select(tiering.cutoff_before("2024-01-01 00:05:00")).first()[0]
    assert cut == dt.datetime(2024, 1, 1)
    assert tiering.new_archive_id(spark).startswith("archive_1")


def test_catalog_use(spark, folder):
    db = database(folder)
    before = spark.catalog.currentDatabase()
    try:
        tiering.create_catalog(spark, folder + "/cold", db, use=True)
        tiering.create_catalog(spark, folder + "/cold", db)  # present: nothing to do
        assert spark.catalog.currentDatabase() == db
        assert spark.table(tiering.MANIFEST_TABLE).count() == 0
    finally:
        spark.catalog.setCurrentDatabase(before)


def test_archive_id_is_checked_before_writing(spark, folder, store):
    with pytest.raises(ValueError):
        tiering.archive_old_orders(store, folder + "/cold", CUTOFF, "db", "2024-01-01", 0)
    assert not files.exists(spark, folder + "/cold")


def test_a_cluster_needs_a_shared_folder():
    from orderlens.session import runs_in_one_process

    assert runs_in_one_process("local") and runs_in_one_process("local[8]")
    assert not runs_in_one_process("local-cluster[3,2,1000]")
    assert not runs_in_one_process("yarn") and not runs_in_one_process("spark://host:7077")


def test_a_large_bucket_is_merged_by_several_tasks(spark, folder, monkeypatch):
    monkeypatch.setattr("orderlens.sources.store.TASK_ROWS", 50)
    store = HotStore(spark, folder, buckets=2)

    def names(batch):
        given = {
            "customer_id": F.concat(F.lit("c"), F.col("id").cast("string")),
            "name": F.concat(F.lit(f"n{batch} "), F.col("id").cast("string")),
        }
        columns = [
            given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.CUSTOMERS.fields
        ]
        return spark.range(1000).select(*columns, F.array(*map(F.lit, given)).alias("present"))

    store.write_batch(0, {"customers": names(0)})
    files_of_first = len(store.customers().inputFiles())
    store.write_batch(1, {"customers": names(1).where("customer_id < 'c5'")})
    # 500 rows of a bucket at 50 a task: more than a file and a task for each bucket.
    assert files_of_first > 2 and len(store.customers().inputFiles()) > 2
    found = {r["customer_id"]: r["name"] for r in store.customers().collect()}
    assert len(found) == 1000 == store.sizes()["customers"][0]
    assert all(n == f"n{int(k < 'c5')} {k[1:]}" for k, n in found.items())
