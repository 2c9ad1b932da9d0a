"""Golden edge cases for the business rules (hand-made frames, FIXTURES §3)."""

import datetime as dt


from millrace.operators import numbering as G
from millrace.operators import quality as L
from millrace.operators import reports as R
from millrace.operators import rules as I

TS = dt.datetime(2024, 1, 5, 8, 0, 0)


def _orders(spark, rows):
    return spark.createDataFrame(rows, "id long, customer_id long, status string, total_amount double, "
                                       "paid_amount double, due_date date, created_at timestamp_ntz, "
                                       "order_date date, discount double")


def test_payments_replay_overpay_negative_zero(spark):
    o = _orders(spark, [(1, 1, "confirmed", 100.0, 0.0, None, TS, None, 0.0),
                        (2, 1, "cancelled", 50.0, 0.0, None, TS, None, 0.0)])
    att = spark.createDataFrame([(1, 1, 60.0), (2, 1, 60.0), (3, 1, -10.0), (4, 1, 0.0), (5, 1, 50.0),
                                 (6, 2, 10.0)], "seq long, order_id long, amount double")
    r = {x["seq"]: x for x in I.payments_replay(o, att).collect()}
    assert [r[s]["accepted"] for s in (1, 2, 3, 4, 5)] == [True, False, True, False, True]
    assert r[5]["paid"] == 100.0 and r[5]["status"] == "paid"
    assert r[3]["status"] == "confirmed"            # a negative payment passes
    assert r[6]["status"] == "confirmed"            # a payment un-cancels an order


def test_order_lifecycle_double_delivery(spark):
    o = _orders(spark, [(1, 1, "pending", 100.0, 0.0, None, TS, None, 0.0)])
    ev = spark.createDataFrame([
        (1, 1, "delivery_created", None, None, TS),
        (2, 1, "delivery_status", "delivered", None, TS + dt.timedelta(hours=1)),
        (3, 1, "payment", None, 40.0, TS + dt.timedelta(hours=2)),
        (4, 1, "delivery_status", "delivered", None, TS + dt.timedelta(hours=3)),
        (5, 1, "delivery_created", None, None, TS + dt.timedelta(hours=4)),
    ], "seq long, order_id long, kind string, status string, amount double, ts timestamp_ntz")
    r = I.order_lifecycle_replay(o, ev).collect()[0]
    assert r["stock_moves"] == 2 and r["status"] == "delivered" and r["paid"] == 40.0 and r["rejected"] == 1


def test_material_adjust_rejects_below_zero(spark):
    init = spark.createDataFrame([(1, 5.0)], "id long, quantity double")
    adj = spark.createDataFrame([(1, 1, "out", 3.0, TS), (2, 1, "out", 3.0, TS + dt.timedelta(seconds=1)),
                                 (3, 1, "in", 0.0, TS + dt.timedelta(seconds=2)),
                                 (4, 1, "in", 1.0, TS + dt.timedelta(seconds=3))],
                                "id long, material_id long, type string, quantity double, created_at timestamp_ntz")
    r = {x["id"]: (x["accepted"], x["reason"], x["balance"]) for x in I.material_adjust_replay(init, adj).collect()}
    assert r == {1: (True, None, 2.0), 2: (False, "insufficient_stock", 2.0), 3: (False, "bad_quantity", 2.0),
                 4: (True, None, 3.0)}


def test_material_ledger_clamps_bom_use(spark):
    init = spark.createDataFrame([(1, 5.0)], "id long, quantity double")
    mv = spark.createDataFrame([(1, 1, "out", 8.0, TS), (2, 1, "in", 4.0, TS + dt.timedelta(seconds=1)),
                                (3, 1, "out", 1.0, TS + dt.timedelta(seconds=2))],
                               "id long, material_id long, type string, quantity double, created_at timestamp_ntz")
    r = {x["id"]: x["balance"] for x in I.material_ledger(init, mv).collect()}
    assert r == {1: 0.0, 2: 4.0, 3: 3.0}


def test_validate_sales_orders_rules(spark):
    o = _orders(spark, [(1, 1, "pending", 0.0, 0.0, None, TS, dt.date(2024, 1, 5), 0.0),
                        (2, 1, "pending", 0.0, 0.0, None, TS, dt.date(2024, 1, 5), 0.0),
                        (3, 1, "pending", 0.0, 0.0, None, TS, dt.date(2024, 1, 5), 0.0),
                        (4, 2, "pending", 0.0, 0.0, None, TS, dt.date(2024, 1, 5), 0.0),
                        (5, 1, "pending", 0.0, 0.0, None, TS, None, 0.0)])
    items = spark.createDataFrame([(1, 1, 10, 6, 1.0), (1, 2, 10, 6, 1.0),   # two lines, same product: each fits
                                   (2, 1, 10, 1, 0.0),                          # zero price
                                   (3, 1, 99, 1, 1.0),                          # unknown product
                                   (4, 1, 10, 1, 500.0),                        # over credit
                                   (5, 1, 10, 1, 1.0)],
                                  "order_id long, line_no int, product_id long, quantity int, unit_price double")
    c = spark.createDataFrame([(1, 0.0), (2, 100.0)], "id long, credit_limit double")
    p = spark.createDataFrame([(10, 10)], "id long, stock long")
    r = {x["order_id"]: x["reason"] for x in I.validate_sales_orders(o, items, c, p, o.limit(0)).collect()}
    assert r == {1: None, 2: "bad_price", 3: "unknown_product", 4: "credit_limit", 5: "missing_fields"}


def test_credit_replay_only_accepted_raise_outstanding(spark):
    o = _orders(spark, [(1, 1, "pending", 60.0, 0.0, None, TS, None, 0.0),
                        (2, 1, "pending", 60.0, 0.0, None, TS + dt.timedelta(seconds=1), None, 0.0),
                        (3, 1, "pending", 40.0, 0.0, None, TS + dt.timedelta(seconds=2), None, 0.0)])
    c = spark.createDataFrame([(1, 100.0)], "id long, credit_limit double")
    r = {x["id"]: x["accepted"] for x in I.credit_replay(o, c).collect()}
    assert r == {1: True, 2: False, 3: True}


def test_batch_number_repeats_after_cancellation(spark):
    po = spark.createDataFrame([(1, "cancelled", TS), (2, "pending", TS + dt.timedelta(minutes=1)),
                                (3, "pending", TS + dt.timedelta(minutes=2))],
                               "id long, status string, created_at timestamp_ntz")
    b = {x["id"]: x["batch_number"] for x in G.assign_batch_numbers(po).collect()}
    assert b == {1: "B20240105-001", 2: "B20240105-001", 3: "B20240105-002"}
    assert L.duplicate_batches(G.assign_batch_numbers(po)).collect()[0]["n"] == 2


def test_document_number_not_cut_above_99999(spark):
    new = spark.createDataFrame([(1, TS)], "id long, created_at timestamp_ntz")
    assert G.assign_document_numbers(new, "SO", 123455).collect()[0]["doc_number"] == "SO123456"
    assert G.assign_document_numbers(new, "SO", 41).collect()[0]["doc_number"] == "SO00042"


def test_aging_gaps_at_noon_and_midnight(spark):
    days = [0, 29, 30, 31, 60, 61, 90, 91]
    asof = dt.date(2024, 6, 1)
    rows = [(i, 1, "confirmed", 10.0, 0.0, asof - dt.timedelta(days=d), TS, None, 0.0) for i, d in enumerate(days)]
    rows.append((99, 1, "confirmed", 10.0, 0.0, None, TS, None, 0.0))
    o = _orders(spark, rows)
    c = spark.createDataFrame([(1, "a")], "id long, name string")
    mid = R.receivables_aging(o, c, "2024-06-01 00:00:00").collect()[0]
    assert (mid["d30"], mid["d60"], mid["d90"], mid["d90plus"], mid["unbucketed"]) == (30.0, 20.0, 20.0, 10.0, 0.0)
    noon = R.receivables_aging(o, c, "2024-06-01 12:00:00").collect()[0]
    # due 30 and 60 days ago fall into the gaps; due 90 days ago counts as > 90
    assert (noon["d30"], noon["d60"], noon["d90"], noon["d90plus"], noon["unbucketed"]) == (20.0, 10.0, 10.0, 20.0, 20.0)
    strict = R.receivables_aging(o, c, "2024-06-01 12:00:00", strict=True).collect()[0]
    assert strict["unbucketed"] == 0.0


def test_apply_changes_insert_update_delete(spark):
    cur = spark.createDataFrame([(1, "P1", "a", 10.0, 1)], "id long, code string, name string, price double, active int")
    ch = spark.createDataFrame([(1, "P1", "insert", "x", 1.0), (2, "P1", "update", "b", 11.0),
                                (3, "P2", "update", "y", 2.0), (4, "P2", "insert", "c", 5.0),
                                (5, "P2", "insert", "d", 6.0), (6, "P2", "delete", None, None)],
                               "seq long, code string, op string, name string, price double")
    st, rej = I.apply_changes(cur, ch, {"key": "code", "updatable": ["name", "price"], "insert_defaults": {},
                                        "delete": "soft"})
    s = {r["code"]: (r["name"], r["price"], r["active"]) for r in st.collect()}
    assert s == {"P1": ("b", 11.0, 1), "P2": ("c", 5.0, 0)}
    assert {r["seq"]: r["reason"] for r in rej.collect()} == {1: "duplicate_key", 3: "not_found", 5: "duplicate_key"}


def test_qc_zero_becomes_null(spark):
    raw = spark.createDataFrame([(1, 0.0, 5.0, None, dt.date(2024, 1, 1)), (2, 7.0, 0.0, "fail", None)],
                                "id long, ph double, tds double, result string, test_date date")
    ok, bad = I.qc_normalize(raw)
    r = ok.collect()[0]
    assert r["ph"] is None and r["tds"] == 5.0 and r["result"] == "pending" and r["odor"] == "ปกติ"
    assert bad.collect()[0]["reason"] == "missing_test_date"


def test_strict_options_fix_reference_quirks(spark):
    o = _orders(spark, [(1, 1, "pending", 100.0, 0.0, None, TS, None, 0.0)])
    ev = spark.createDataFrame([
        (1, 1, "delivery_created", None, None, TS),
        (2, 1, "delivery_status", "delivered", None, TS + dt.timedelta(hours=1)),
        (3, 1, "payment", None, 40.0, TS + dt.timedelta(hours=2)),
        (4, 1, "delivery_status", "delivered", None, TS + dt.timedelta(hours=3)),
    ], "seq long, order_id long, kind string, status string, amount double, ts timestamp_ntz")
    r = I.order_lifecycle_replay(o, ev, strict=True).collect()[0]
    assert r["stock_moves"] == 1 and r["status"] == "delivered"
    o2 = _orders(spark, [(1, 1, "cancelled", 100.0, 0.0, None, TS, None, 0.0)])
    att = spark.createDataFrame([(1, 1, 10.0), (2, 1, -5.0)], "seq long, order_id long, amount double")
    assert [x["accepted"] for x in I.payments_replay(o2, att, strict=True).orderBy("seq").collect()] == [False, False]
    po = spark.createDataFrame([(1, "cancelled", TS), (2, "pending", TS + dt.timedelta(minutes=1))],
                               "id long, status string, created_at timestamp_ntz")
    b = {x["id"]: x["batch_number"] for x in G.assign_batch_numbers(po, strict=True).collect()}
    assert b == {1: "B20240105-001", 2: "B20240105-002"}


def test_apply_changes_hard_delete_and_defaults(spark):
    cur = spark.createDataFrame([(1, "ann", "Ann", "admin", 1), (2, "bob", "Bob", "staff", 1)],
                                "id long, username string, name string, role string, active int")
    cur = cur.unionByName(spark.createDataFrame([(3, "admin", "Root", "admin", 1)],
                                                "id long, username string, name string, role string, active int"))
    ch = spark.createDataFrame([(1, "bob", "delete", None), (2, "cy", "insert", "Cy"), (3, "ann", "update", "Anna"),
                                (4, "admin", "delete", None)],
                               "seq long, username string, op string, name string")
    st, rej = I.apply_changes(cur, ch, I.CHANGE_SPECS["users"])
    rows = {r["username"]: (r["name"], r["role"], r["active"]) for r in st.collect()}
    assert rows == {"ann": ("Anna", "admin", 1), "cy": ("Cy", "staff", 1), "admin": ("Root", "admin", 1)}
    assert {r["seq"]: r["reason"] for r in rej.collect()} == {4: "protected"}


def test_apply_changes_free_key_after_hard_delete_and_null_keys(spark):
    cur = spark.createDataFrame([(4, "M1", "salt", "kg", 7.0, 1.0, 2.0)],
                                "id long, code string, name string, unit string, quantity double, min_quantity double, cost_per_unit double")
    rows = [(1, "M1", "delete", None, None), (2, "M1", "update", "lost", None), (3, "M1", "insert", "sugar", 50.0),
            (4, "M1", "update", "brown sugar", 99.0), (5, None, "insert", "nothing", 1.0), (6, "M2", "insert", "tea", None),
            (7, "M2", "delete", None, None), (8, "M3", "insert", "milk", 3.0), (9, "M3", None, "x", 3.0)]
    ch = spark.createDataFrame(rows, "seq long, code string, op string, name string, quantity double")
    st, rej = I.apply_changes(cur, ch, "raw_materials")
    assert sorted(tuple(r) for r in st.collect()) == [(5, "M1", "brown sugar", None, 50.0, 0.0, 0.0),
                                                      (7, "M3", "milk", None, 3.0, 0.0, 0.0)]
    assert {r.seq: r.reason for r in rej.collect()} == {2: "not_found", 5: "missing_key", 9: "bad_op"}


def test_apply_changes_ids_from_inserts(spark):
    cur = spark.createDataFrame([(2, "rent", 10.0)], "id long, category string, amount double")
    ch = spark.createDataFrame([(1, None, "insert", "fuel", 5.0), (2, 3, "update", "fuel2", 6.0), (3, 2, "delete", None, None),
                                (4, None, "insert", "water", 7.0), (5, 9, "delete", None, None)],
                               "seq long, id long, op string, category string, amount double")
    st, rej = I.apply_changes(cur, ch, "expenses")
    assert sorted(tuple(r) for r in st.collect()) == [(3, "fuel2", 6.0), (4, "water", 7.0)]
    assert [(r.seq, r.reason) for r in rej.collect()] == [(5, "not_found")]


def test_delivery_changes_stamp_delivered_at(spark):
    cur = spark.createDataFrame([(1, 10, "pending", None), (2, 20, "delivered", TS)], "id long, order_id long, status string, delivered_at timestamp_ntz")
    later = [TS + dt.timedelta(hours=h) for h in range(5)]
    ch = spark.createDataFrame([(1, 10, "update", "in_transit", later[1]), (2, 10, "update", "delivered", later[2]),
                                (3, 10, "update", "failed", later[3]), (4, 30, "insert", "delivered", later[4]), (5, 20, "delete", None, later[4])],
                               "seq long, order_id long, op string, status string, ts timestamp_ntz")
    st, rej = I.apply_changes(cur, ch, "deliveries")
    assert {r.order_id: (r.status, r.delivered_at) for r in st.collect()} == {
        10: ("failed", later[2]), 20: ("delivered", TS), 30: ("delivered", later[4])}
    assert [(r.seq, r.reason) for r in rej.collect()] == [(5, "not_allowed")]


def test_store_valid_counts_while_it_writes(spark, tmp_path):
    """Counts equal the verdicts of ``validate_inputs``; the table holds the accepted rows; an empty input is fine."""
    rows = [(1, "rent", 10.0, TS.date()), (2, None, 5.0, TS.date()), (3, "", 5.0, TS.date()), (4, "water", 0.0, TS.date()), (5, "water", -1.0, TS.date()),
            (6, "water", 2.0, None), (7, "rent", 1.0, TS.date())]
    df = spark.createDataFrame(rows, "id long, category string, amount double, expense_date date")
    path = f"{tmp_path}/expenses"
    got = I.store_valid(df, "expense", path)
    want = {r.reason or "accepted": r["count"] for r in I.validate_inputs(df, "expense").groupBy("reason").count().collect()}
    assert got == want == {"accepted": 2, "missing_category": 2, "missing_amount": 1, "non_positive_amount": 1, "missing_expense_date": 1}
    assert {r.id for r in spark.read.parquet(path).collect()} == {1, 7}
    assert I.store_valid(df.where("id > 100"), "expense", path) == {"accepted": 0}
    bom = spark.createDataFrame([(1, 1, 2, 1.0), (2, 1, 2, 3.0), (3, 1, 3, 1.0)], "id long, product_id long, material_id long, quantity_per_unit double")
    assert I.store_valid(bom, "bom", f"{tmp_path}/bom", unique=["product_id", "material_id"]) == {"accepted": 2, "duplicate_product_id_material_id": 1}
