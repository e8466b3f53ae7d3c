from checks import queries


def test_an_archive_run_joins_its_orders_once(spark, sf_dir, monkeypatch):
    plans, write = [], queries.tiering.write_archive

    def watched(rows, cold, archive_id):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return write(rows, cold, archive_id)

    monkeypatch.setattr(queries.tiering, "write_archive", watched)
    found = queries.archive_write(spark, sf_dir)
    assert len(plans) == 3 and not any("Join" in plan for plan in plans)
    assert found.where("archive_id = 'archive_1'").count() > 0


def test_the_summary_is_computed_once(spark, sf_dir, monkeypatch):
    calls, summary = [], queries.kpis.summary
    monkeypatch.setattr(queries.kpis, "summary", lambda rows: calls.append(1) or summary(rows))
    found = queries.summary_from_either(spark, sf_dir)
    one, other = sorted(found.collect(), key=lambda row: row["from_cache"])
    assert (one["from_cache"], other["from_cache"]) == (False, True)
    assert one[:-1] == other[:-1] and one["total_orders"] > 0
    assert len(calls) == 1 and "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def joins_above(node, column):
    """How many joins take rows with a column of some scan, counted down a plan."""
    below = [node.children().apply(i) for i in range(node.children().size())]
    is_one = node.nodeName() == "Join" and f"{column}#" in node.toString()
    return is_one + sum(joins_above(child, column) for child in below)


def test_paid_orders_meet_their_heads_and_products_only(spark, sf_dir):
    found = queries.full_rows(spark, sf_dir)
    assert joins_above(found._jdf.queryExecution().optimizedPlan(), "l_extendedprice") == 2
    # The same rows from orders that come in one frame.
    star, payments = queries.views.star(spark, sf_dir), queries.views.pay(spark, sf_dir)
    whole = queries.star.orders_with_payments(*star, payments, "order_ref")
    names = ["total_amount", "shipping_cost", "tax_amount"]
    one, other = queries._double(found, *names), queries._double(whole, *names)
    assert one.count() > 0 and one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()
