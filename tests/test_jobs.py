"""The whole pipeline through its commands."""

from test_streaming import event, put

from orderlens import jobs
from orderlens.plans import tiering
from orderlens.sources.published import published_names, read_published
from orderlens.sources.store import HotStore


def test_pipeline(spark, folder, capsys):
    root, serving, cold = (f"{folder}/{name}" for name in ("hot", "serving", "cold"))
    database = "db_" + "".join(c for c in folder if c.isalnum())
    put(f"{folder}/in", "a.txt", [event(n, f"c{n % 3}") for n in range(30)])

    def run(job, **options):
        words = [job]
        for name, value in options.items():
            flag = f"--{name.replace('_', '-')}"
            words += [flag] if value is True else [flag, str(value)]
        jobs.main(words)
        return capsys.readouterr().out

    assert "nothing published" in run("refresh", root=root, serving=serving)
    run("ingest", path=f"{folder}/in", root=root, once=True, most=5)
    run("refresh", root=root, serving=serving)
    assert len(published_names(spark, serving)) == 8
    assert '"total_orders":30' in run("show", serving=serving, name="summary")
    assert "not published" in run("show", serving=serving, name="nothing")
    figures = f"{serving}/figures"
    assert len(published_names(spark, figures)) == 5
    assert read_published(spark, figures, "orders_per_minute").first()["orders_per_minute"] == 1
    assert '"minutes":10' in run("show", serving=figures, name="avg_revenue_10min")

    run("quality", root=root, serving=serving, as_of="2024-01-01 10:30:00")
    report = read_published(spark, f"{serving}/checks", "data_quality").first()
    assert (report["total_orders"], report["issues_count"]) == (30, 0)

    when = "2024-01-01 10:15:00"
    assert "nothing archived" in run("archive", root=root, cold=cold, as_of=when)
    run(
        "archive",
        root=root,
        cold=cold,
        as_of=when,
        archive_id="a1",
        database=database,
        threshold_mb=0,
    )
    store = HotStore(spark, root)
    archived = tiering.read_archives(spark, cold).count()
    assert archived == 10 and store.orders().count() == 20

    run("health", root=root, serving=serving, cold=cold, as_of="2024-01-01 10:30:00", wait=0)
    checks = f"{serving}/checks"
    assert read_published(spark, checks, "flow").first()["is_flowing"] is False
    coverage = read_published(spark, checks, "coverage").first()
    assert (coverage["loaded_orders"], coverage["joined_orders"]) == (20, 20)
    assert read_published(spark, checks, "recent_rate").first()["recent_orders"] == 2
    assert read_published(spark, checks, "archives").first()["total_records"] == 10
    sizes = {r["table_name"]: r["row_count"] for r in read_published(spark, checks, "table_sizes").collect()}
    assert sizes == {"orders": 20, "customers": 3, "products": 1, "payments": 30}

    shown = run("cold", path=tiering.archive_path(cold, "a1"), root=root)
    assert "Home" in shown and "100.0" in shown

    query = "SELECT customer_state, count(*) AS n FROM orders_joined GROUP BY customer_state"
    assert "|Ohio          |20 |" in run("sql", root=root, query=query)

    run("sql", root=root, query=query, output=f"{folder}/out")
    assert spark.read.parquet(f"{folder}/out").count() == 1
    run("cold", path=tiering.archive_path(cold, "a1"), root=root, output=f"{folder}/figures")
    assert spark.read.parquet(f"{folder}/figures/category").first()["order_count"] == 10

    run("maintain", root=root)
    assert store.orders().count() == 20 and store.customers().count() == 3
    put(f"{folder}/in", "b.txt", [event(31)])
    run("ingest", path=f"{folder}/in", root=root, serving=serving, once=True)
    assert read_published(spark, serving, "summary").first()["total_orders"] == 21
