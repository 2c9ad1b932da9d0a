"""Capacity rounds against a plain loop."""

import datetime as dt
import random

import pytest

import __spark_entry__ as E
from millrace.operators import rules as I
from millrace.plans.rounds import capacity_rounds


def plain(rows, room):
    used, out = dict.fromkeys(room, 0), {}
    for key, _, i, amount in sorted(rows, key=lambda r: (r[1], r[2])):
        ok = used[key] + amount <= room[key]
        used[key] += amount * ok
        out[i] = (ok, used[key])
    return out


@pytest.mark.parametrize("amounts", [(0, 1, 2, 3, 5, 8, 40), (1, 64, 65, 900), (-30, -1, 0, 7, 20, 90), (500,)])
def test_equals_plain_loop(spark, amounts):
    rnd = random.Random(len(amounts))
    room = {k: rnd.choice([0, 1, 63, 64, 500]) for k in range(12)}
    rows = [(rnd.choice([*room, 0, 0, 0]), rnd.randrange(30), i, rnd.choice(amounts)) for i in range(600)]
    df = spark.createDataFrame([(*r, room[r[0]]) for r in rows], "k long, t long, i long, amount long, room long")
    got = capacity_rounds(df, "k", ["t", "i"], "amount", "room")
    assert {r.i: (r.accepted, r.used) for r in got.collect()} == plain(rows, room)


def test_credit_replay_equals_plain_loop(spark):
    """Limits NULL, 0 and positive, NULL totals, a customer with most orders, equal times."""
    rnd = random.Random(8)
    limit = {1: 100.0, 2: 0.0, 3: None, 4: 1000.5, 5: 0.01}
    rows = [(i, rnd.choice([1, 1, 1, 1, 2, 3, 4, 5]), rnd.choice([None, 0.0, 0.5, 12.25, 60.0, 99.99, 400.0, -5.0]), dt.datetime(2024, 1, 1, i % 7)) for i in range(300)]
    orders = spark.createDataFrame(rows, "id long, customer_id long, total_amount double, created_at timestamp_ntz")
    customers = spark.createDataFrame(list(limit.items()), "id long, credit_limit double")
    owed, want = dict.fromkeys(limit, 0.0), {}
    for i, c, total, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        ok = not (limit[c] or 0) > 0 or owed[c] + (total or 0) <= limit[c] + 1e-9
        owed[c] += (total or 0) * ok
        want[i] = (ok, pytest.approx(owed[c]))
    assert {r.id: (r.accepted, r.outstanding_after) for r in I.credit_replay(orders, customers).collect()} == want
    assert I.credit_replay(orders.limit(0), customers).count() == 0


def test_no_python_in_the_plan(spark, sf_dir):
    plan = E.queries()["i3_credit_replay"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan


@pytest.mark.parametrize("short", [0, 40, 1024])
def test_walked_and_hot_keys_agree(spark, short):
    """A hot key, short keys, negative and zero amounts, whichever keys take rounds over the table."""
    rnd = random.Random(5)
    room = {k: rnd.choice([0, 63, 500, 4000]) for k in range(20)}
    rows = [(rnd.choice([*room, 0, 0, 0, 1, 1]), rnd.randrange(30), i, rnd.choice([0, 1, 3, 64, 65, 900, 2500] + [-30] * (i % 50 == 0))) for i in range(500)]
    df = spark.createDataFrame([(*r, room[r[0]]) for r in rows], "k long, t long, i long, amount long, room long")
    got = capacity_rounds(df, "k", ["t", "i"], "amount", "room", short=short)
    assert {r.i: (r.accepted, r.used) for r in got.collect()} == plain(rows, room)


def test_short_keys_take_no_rounds(spark, monkeypatch):
    """However many keys and halvings: the table is not read once per round."""
    from millrace.plans import rounds
    names, write = [], rounds.written
    monkeypatch.setattr(rounds, "written", lambda df, name: names.append(name) or write(df, name))
    df = spark.range(2000).selectExpr("id % 200 AS k", "id AS i", "shiftleft(1L, 12 - cast(id div 200 AS int)) AS amount", "10000L AS room")
    assert capacity_rounds(df, "k", ["i"], "amount", "room").count() == 2000
    assert "round" not in names


def test_rounds_pass_on_only_rows_that_may_fit(spark, monkeypatch):
    from millrace.plans import rounds
    sizes, write = [], rounds.written

    def counted(df, name):
        out = write(df, name)
        if name == "round":
            sizes.append(out.count())
        return out
    monkeypatch.setattr(rounds, "written", counted)
    df = spark.range(3000).selectExpr("0L AS k", "id AS i", "id % 3 * 400 + 1 AS amount", "1000L AS room")
    got = {r.i: (r.accepted, r.used) for r in capacity_rounds(df, "k", ["i"], "amount", "room", short=10).collect()}
    assert got == plain([(0, 0, i, i % 3 * 400 + 1) for i in range(3000)], {0: 1000})
    assert sizes[0] == 3000 and all(x <= 2000 for x in sizes[1:])


@pytest.mark.parametrize("short", [0, 1024])
def test_repeated_rows_are_decided_one_by_one(spark, short):
    """Whole rows that repeat, the first of which passes half of what is left."""
    rows = [(0, 1, 60), (0, 2, 130), (0, 2, 130), (0, 3, 200), (0, 4, 90), (1, 1, 90), (1, 1, 90), (1, 2, 20), (1, 2, 20)]
    df = spark.createDataFrame([(*r, 420 if r[0] == 0 else 110) for r in rows], "k long, i long, amount long, room long")
    got = sorted((r.k, r.i, r.accepted, r.used) for r in capacity_rounds(df, "k", ["i"], "amount", "room", short=short).collect())
    assert got == [(0, 1, True, 60), (0, 2, True, 190), (0, 2, True, 320), (0, 3, False, 320), (0, 4, True, 410),
                   (1, 1, False, 90), (1, 1, True, 90), (1, 2, False, 110), (1, 2, True, 110)]
