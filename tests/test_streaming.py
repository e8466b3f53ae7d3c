import json

import os

import pytest
from frames import rows
from pyspark.sql import functions as F

from checks import queries, views
from orderlens.operators import kpis
from orderlens.sources import events as sources
from orderlens.sources.published import published_names, read_published
from orderlens.sources import files
from orderlens.sources.store import HotStore
from orderlens.streaming import decode, figures, ingest

ONCE = {"availableNow": True}


def event(number, customer="c1", **changed):
    """One event; `part__field=value` changes a field, `...` removes it."""
    whole = {
        "order": {
            "order_id": f"ORD_{number}",
            "customer_id": customer,
            "product_id": "p1",
            "timestamp": f"2024-01-01T10:{number % 60:02d}:00.5",
            "quantity": 2,
            "unit_price": 5.0,
            "total_amount": 10.0,
            "shipping_cost": 3.0,
            "tax_amount": 0.8,
            "order_status": "completed",
        },
        "customer": {"customer_id": customer, "name": f"name {number}", "state": "Ohio"},
        "product": {"product_id": "p1", "name": "Lamp", "category": "Home"},
        "payment": {
            "payment_id": f"PAY_{number}",
            "order_id": f"ORD_{number}",
            "payment_method": "paypal",
            "status": "success",
            "processing_time": 0.5,
            "timestamp": "2024-01-01T10:00:00",
        },
    }
    for path, value in changed.items():
        part, _, field = path.partition("__")
        if not field:
            whole.pop(part)
        elif value is ...:
            whole[part].pop(field)
        else:
            whole[part][field] = value
    return json.dumps(whole)


def put(folder, name, lines):
    import os

    os.makedirs(folder, exist_ok=True)
    hidden = f"{folder}/.{name}"
    with open(hidden, "w") as out:
        out.write("\n".join(lines) + "\n")
    os.rename(hidden, f"{folder}/{name}")


def run(spark, folder, **options):
    source = {"kind": "files", "path": folder + "/in", **options}
    query = ingest.start_ingest(spark, sources.read_events(spark, source), folder + "/hot", ONCE)
    query.awaitTermination()
    return HotStore(spark, folder + "/hot")


def contents(store):
    return {
        name: sorted(rows(table.select(*sorted(table.columns))), key=repr)
        for name, table in {**store.tables(), "dead": store.dead_letters()}.items()
    }


def test_batches_do_not_matter(spark, folder):
    for n in range(4):
        put(folder + "/in", f"{n}.txt", [event(n * 10 + i, f"c{i % 3}") for i in range(10)])
        put(folder + "/in", f"{n}-bad.txt", ["{", event(n, payment=None)])
    one = run(spark, folder)
    source = {"kind": "files", "path": folder + "/in", "maxFilesPerTrigger": "1"}
    stream = sources.read_events(spark, source)
    ingest.start_ingest(spark, stream, folder + "/many", ONCE).awaitTermination()
    many = HotStore(spark, folder + "/many")
    assert one.committed() == 0 and many.committed() == 7
    left, right = contents(one), contents(many)
    # Which of several changes came last depends on the files' times alone.
    assert left["orders"] == right["orders"] and len(left["orders"]) == 40
    assert left["payments"] == right["payments"] and left["dead"] == right["dead"]
    assert len(left["dead"]) == 8 and len(left["customers"]) == 3


def test_later_events_win_field_by_field(spark, folder):
    put(folder + "/in", "a.txt", [event(1, customer__city="Dayton"), event(2, customer__name="Ann")])
    store = run(spark, folder)
    put(folder + "/in", "b.txt", [event(3, customer__state=None, customer__name=...)])
    store = run(spark, folder)
    found = store.customers().first()
    assert (found["name"], found["city"], found["state"]) == ("Ann", "Dayton", None)
    assert store.orders().count() == 3


def test_restart_reads_only_what_is_new(spark, folder):
    put(folder + "/in", "a.txt", [event(1), event(2)])
    assert run(spark, folder).committed() == 0
    assert run(spark, folder).committed() == 0
    put(folder + "/in", "b.txt", [event(2)])  # a true duplicate is an order of its own
    store = run(spark, folder)
    assert store.committed() == 1
    assert store.orders().count() == 3
    assert store.payments().count() == 2


def test_replayed_batch_adds_nothing(spark, folder):
    lines = spark.createDataFrame([(event(1),), (event(2),)], "value string")
    batch = lines.withColumn("seq", F.struct(F.lit(1).alias("at")))
    store = HotStore(spark, folder)
    ingest.write_star(store, batch, 0)
    ingest.write_star(store, batch, 0)
    assert store.orders().count() == 2


def test_without_its_checkpoint_a_store_is_refused(spark, folder):
    put(f"{folder}/in", "a.txt", [event(1)])
    run(spark, folder)
    os.rename(f"{folder}/hot/_checkpoint", f"{folder}/lost")
    with pytest.raises(ValueError):
        run(spark, folder)
    os.rename(f"{folder}/lost", f"{folder}/hot/_checkpoint")
    put(f"{folder}/in", "b.txt", [event(2)])
    assert run(spark, folder).orders().count() == 2


def test_a_batch_that_fails_after_its_write_is_replayed(spark, folder):
    put(f"{folder}/in", "a.txt", [event(1, "c1", customer__city="Dayton")])
    run(spark, folder)
    put(f"{folder}/in", "b.txt", [event(2, "c1", customer__city="Akron")])
    source = sources.read_events(spark, {"kind": "files", "path": folder + "/in"})

    def fail(_store, _batch):
        raise OSError("gone")

    with pytest.raises(Exception):
        ingest.start_ingest(spark, source, folder + "/hot", ONCE, fail).awaitTermination()
    store = run(spark, folder)
    assert store.committed() == 1 and store.orders().count() == 2
    assert [r["city"] for r in store.customers().collect()] == ["Akron"]
    assert store.order_size()[0] == 2


def test_reasons(spark):
    cases = {
        event(1): None,
        event(2, order__quantity=None): None,
        event(3, customer__unheard_of="x"): None,
        "{": "no order",
        "[]": "no order",
        event(4, payment=None): "no payment",
        event(5, order__quantity="many"): "bad order",
        event(6, order__tax_amount=...): "order lacks a field",
        event(7, customer__customer_id=None): "no customer_id",
        event(8, product__product_id=...): "no product_id",
        event(9, payment__payment_id=...): "no payment_id",
        event(10, order__timestamp="soon"): "bad timestamp",
        event(11, customer__registration_date="once"): "bad registration_date",
        event(12, order__total_amount=float("nan")): "bad total_amount",
        event(13, order__total_amount=1e30): "bad total_amount",
    }
    df = spark.createDataFrame([(text,) for text in cases], "value string")
    decoded = decode.decode(df.withColumn("seq", F.struct(F.lit(1).alias("at"))))
    found = {r["value"]: r["reason"] for r in decoded.select("value", "reason").collect()}
    assert found == cases


def test_kafka_options(spark):
    options = sources.kafka_options("host:9092", "orders", {"maxOffsetsPerTrigger": "10"})
    assert options["startingOffsets"] == "earliest" and options["subscribe"] == "orders"
    assert options["maxOffsetsPerTrigger"] == "10"
    with pytest.raises(ValueError):
        sources.read_events(spark, {"kind": "pigeon"})


def test_refresh_follows_the_stream(spark, folder):
    put(folder + "/in", "a.txt", [event(1), event(2, "c2")])
    source = {"kind": "files", "path": folder + "/in"}

    def follow():
        stream = sources.read_events(spark, source)
        figures.start_ingest_and_refresh(
            spark, stream, folder + "/hot", folder + "/serving", ONCE
        ).awaitTermination()
        return read_published(spark, folder + "/serving", "summary").first()

    assert follow()["total_orders"] == 2
    put(folder + "/in", "b.txt", [event(3)])
    last = follow()
    assert (last["total_orders"], last["unique_customers"], last["total_revenue"]) == (3, 2, 30.0)
    assert last["last_updated"] is not None
    assert len(published_names(spark, folder + "/serving")) == 8


def test_nothing_to_refresh(spark, folder):
    from orderlens.plans.refresh import refresh

    store = HotStore(spark, folder + "/hot")
    tables = (store.orders(), store.customers(), store.products())
    assert refresh(spark, folder + "/serving", *tables) is False
    assert published_names(spark, folder + "/serving") == []


@pytest.mark.parametrize("lateness", [None, "10 minutes"])
def test_running_minutes(spark, folder, lateness):
    schema = "timestamp timestamp, total_amount double"
    data = [
        [("2024-01-01 10:00:10", 1.0), ("2024-01-01 10:01:00", 2.0), (None, 1.0)],
        [("2024-01-01 10:00:50", 4.0), ("2024-01-01 10:02:00", 8.0), (None, 1.0)],
        [("2024-01-01 10:02:50", 1.0)],
    ]
    for i, values in enumerate(data):
        frame = spark.createDataFrame(values, "t string, total_amount double")
        frame.select(F.col("t").cast("timestamp").alias("timestamp"), "total_amount").coalesce(
            1
        ).write.mode("append").parquet(folder + "/in")
        stream = spark.readStream.schema(schema).parquet(folder + "/in")
        running = figures.running_minutes(stream, lateness)
        figures.start_minutes(running, folder + "/minutes", ONCE).awaitTermination()
    found = rows(kpis.revenue_by_minute(figures.read_minutes(spark, folder + "/minutes")))
    assert found[:3] == [
        ("2024-01-01T10:02", 9.0, 2),
        ("2024-01-01T10:01", 2.0, 1),
        ("2024-01-01T10:00", 5.0, 2),
    ]
    # A window needs a time; the plain aggregate keeps orders without one.
    assert found[3:] == ([(None, 2.0, 2)] if lateness is None else [])


def test_a_batch_is_kept_packed_in_the_store_while_it_is_written(spark, folder, monkeypatch):
    store, seen = HotStore(spark, f"{folder}/hot"), []
    lines = spark.createDataFrame([(event(n), n) for n in range(3)], "value string, n int")
    batch = lines.select("value", F.struct(F.col("n").alias("at")).alias("seq"))
    held = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    before, write = held(), HotStore.write_batch

    def watched(self, batch_id, frames):
        write(self, batch_id, frames)
        seen.append((held() - before, files.exists(spark, f"{store.root}/{ingest.DECODED}")))

    monkeypatch.setattr(HotStore, "write_batch", watched)
    ingest.write_star(store, batch, 0)
    assert seen == [(0, True)]
    assert not files.exists(spark, f"{store.root}/{ingest.DECODED}")
    assert store.orders().count() == 3 and store.customers().count() == 1


def test_event_files_are_packed_bounded_and_come_in_two_batches(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(queries, "FILE_EVENTS", (1, 500))
    lines = views.event_lines(spark, sf_dir)
    assert "RoundRobin" not in lines._jdf.queryExecution().executedPlan().toString()
    source = queries.event_files(spark, sf_dir, lines)
    written = spark.read.text(source["path"])
    names = written.inputFiles()
    length = written.agg(F.sum(F.length("value"))).first()[0]
    packed = sum(os.path.getsize(name.removeprefix("file:").replace("///", "/")) for name in names)
    assert packed * 5 < length
    most = written.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    assert most <= 500 and len(names) > 4
    assert int(source["maxFilesPerTrigger"]) == -(-len(names) // 2)
    assert written.exceptAll(lines).isEmpty() and lines.exceptAll(written).isEmpty()


def test_lines_meet_their_heads_and_products_only(spark, sf_dir):
    def joins_with(node, table):
        below = [node.children().apply(i) for i in range(node.children().size())]
        is_one = node.nodeName() == "Join" and f"{table}#" in node.toString()
        return is_one + sum(joins_with(child, table) for child in below)

    plan = views.event_rows(spark, sf_dir)._jdf.queryExecution().optimizedPlan()
    assert joins_with(plan, "l_extendedprice") == 2


def test_a_text_is_not_parsed_again_for_a_filter(spark, folder):
    with open(f"{folder}/a.txt", "w") as out:
        out.write(event(1))
    lines = sources.placed(sources.with_file_order(spark.read.text(f"{folder}/a.txt")))
    found = decode.nested_events(decode.decode(lines))
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    filters = [line for line in plan if "Filter" in line]
    assert filters and not any("from_json" in line for line in filters)
    # All parts at once, and where that is not enough as text, then each of the four.
    assert sum(line.count("from_json(") for line in plan) == 6


def test_parts_parsed_at_once_are_as_parsed_one_by_one(spark):
    def bare(number, field, text):
        return event(number, **{field: "@"}).replace('"@"', text)

    def decoded(texts):
        df = spark.createDataFrame(list(enumerate(texts)), "n int, value string")
        rows = decode.decode(df.select("value", F.struct("n").alias("seq"))).orderBy("seq.n")
        return rows.select("reason", "order", "customer", "customer_fields").collect()

    one = event(1)
    as_text = json.loads(one)
    as_text["order"] = json.dumps(as_text["order"])
    texts = {
        bare(2, "order__order_status", "NaN"): (None, "NaN"),
        bare(3, "order__order_status", "1e400"): (None, "Infinity"),
        bare(4, "order__order_status", "1.50"): (None, "1.5"),
        bare(5, "order__order_status", "null"): (None, None),
        bare(6, "order__order_status", '"\\"q\\""'): (None, '"q"'),
        bare(7, "order__order_status", '{"a": 1.50}'): (None, '{"a":1.5}'),
        json.dumps(as_text): (None, "completed"),
        one[:-1] + ',"order":' + json.dumps(json.loads(event(9))["order"]) + "}": (None, "completed"),
        bare(10, "order__order_status", '"\\ud800"'): (None, "?"),
        one[:-1]: ("no order", None),
        "": ("no order", None),
    }
    rows = decoded(texts)
    assert [(r["reason"], r["order"] and r["order"]["order_status"]) for r in rows] == list(texts.values())
    assert rows[-4]["order"]["order_id"] == "ORD_9"
    whole = {n: "x" for n in ("email", "city", "country", "segment")} | {"registration_date": "2024-01-01"}
    given = [{}, {"city": None}, whole, whole | {"city": None}]
    rows = decoded([event(n, **{f"customer__{k}": v for k, v in c.items()}) for n, c in enumerate(given)])
    assert [sorted(r["customer_fields"]) for r in rows] == [
        sorted({"customer_id", "name", "state"} | c.keys()) for c in given
    ]


def test_parts_that_set_all_fields_are_not_folded_by_field(spark, folder, monkeypatch):
    folded, fold = [], ingest.fold
    monkeypatch.setattr(ingest, "fold", lambda rows, key, order: folded.append(key) or fold(rows, key, order))
    all_set = {f"customer__{n}": "x" for n in ("email", "city", "country", "segment")}
    all_set |= {"customer__registration_date": "2024-01-01", "product__subcategory": "s"}
    all_set |= {"product__brand": "b", "product__cost_price": 1.0, "product__list_price": 2.0}
    store = HotStore(spark, f"{folder}/hot")

    def write(batch_id, lines):
        batch = spark.createDataFrame(list(enumerate(lines)), "n int, value string")
        ingest.write_star(store, batch.select("value", F.struct(F.col("n").alias("at")).alias("seq")), batch_id)
        return sorted(rows(store.customers().select("customer_id", "name", "city", "email", "state")))

    assert write(0, [event(n, f"c{n % 2}", **all_set) for n in range(4)]) == [
        ("c0", "name 2", "x", "x", "Ohio"),
        ("c1", "name 3", "x", "x", "Ohio"),
    ]
    assert folded == []
    later = [event(5, "c1", **all_set), event(6, "c1", customer__city=None), event(7, "c2", customer__state=...)]
    assert write(1, [*later, "{"]) == [
        ("c0", "name 2", "x", "x", "Ohio"),
        ("c1", "name 6", None, "x", "Ohio"),
        ("c2", "name 7", None, None, None),
    ]
    assert sorted(folded) == ["customer_id", "product_id"]
    assert store.dead_letters().count() == 1 and store.orders().count() == 7
