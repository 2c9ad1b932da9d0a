"""Conversation repair against exhaustive search, a plain DP and DuckDB."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import repair as R
from tests.duck_oracle import compare, duck

GOAL = re.compile(r"(s?(ua)+)?")


def exhaustive(word, inserts):
    """Least (cost, audit) over every way to delete, keep, rerole and insert."""
    choices = []
    for c in word:
        low, more = c.lower(), 3 * c.isupper()
        choices.append([("D", 4, "")] + ([] if c == "x" else [("R", 3 + more, "u"), ("R", 3 + more, "a")] + ([("K", more, low)] if low != "o" else [])))
    best = None
    for pick in itertools.product(*choices):
        for gaps in itertools.product([x for n in range(inserts + 1) for x in itertools.product("ua", repeat=n)], repeat=len(word) + 1):
            roles, audit, cost = "".join(gaps[0]), "I" * len(gaps[0]), 3 * len(gaps[0])
            for (letter, price, role), gap in zip(pick, gaps[1:]):
                roles, audit, cost = roles + role + "".join(gap), audit + letter + "I" * len(gap), cost + price + 3 * len(gap)
            if GOAL.fullmatch(roles) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def by_matrices(word, rules=()):
    table = R.matrices(list(rules))
    for symbol, pair in rules:
        word = word.replace(pair, symbol)
    m = [[(0, ""), None, None, None]]
    for c in word:
        m = R.product(m, table[c])
    ends = R.product(m, R.INSERTED)[0]
    cost, audit = R._better(ends[R.START], ends[R.ASSISTANT])
    return cost, R.Rope.text(audit)


def test_matrices_equal_exhaustive_search():
    for n in range(3):
        for word in itertools.product("xsuaoSUAO", repeat=n):
            assert by_matrices(word) == exhaustive("".join(word), 2)
    rnd = random.Random(1)
    for _ in range(60):
        word = "".join(rnd.choices("xsuaoSUAO", k=rnd.choice((3, 4))))
        assert by_matrices(word) == exhaustive(word, 1)


def plain_dp(rows):
    """rows: (role, text, gone, cut) -> (cost, audit, repaired) by state after state."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    def put(to, state, way):
        if state not in to or way < to[state]:
            to[state] = way

    def inserted(now):
        for _ in range(3):
            for state, (cost, audit, lines) in list(now.items()):
                role = "a" if state == "u" else "u"
                put(now, role, (cost + 3, audit + "I", lines + (("assistant:" if role == "a" else "user:"),)))
        return now
    now = inserted({"": (0, "", ())})
    for role, text, gone, cut in rows:
        new = {}
        for state, (cost, audit, lines) in now.items():
            put(new, state, (cost + 4, audit + "D", lines))
            if not gone:
                if (state, role[:1]) in after:
                    put(new, after[state, role[:1]], (cost + 3 * cut, audit + "K", lines + (f"{role}:{text}",)))
                full = "assistant" if state == "u" else "user"
                put(new, full[0], (cost + 3 + 3 * cut, audit + "R", lines + (f"{full}:{text}",)))
        now = inserted(new)
    cost, audit, lines = min(now[s] for s in ("", "a") if s in now)
    return cost, audit, "\n".join(lines)


def plain(rows):
    """(conv_id, turn, role, text) before damage -> results by conv_id."""
    text = lambda v: " " if v is None else str(v)
    convs = {}
    for conv, turn, role, body in rows:
        mine = convs.setdefault(conv, [])
        role, body, kind = text(role), text(body), zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20
        if kind == 4:
            role = "user"
        body = "" if kind == 1 else re.sub("[.!?]", "", body) if kind == 2 else body
        mine += [(turn, role, body)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, mine in convs.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()))
        seen, faults, todo = set(), [0, 0, 0], []
        for _, role, body in mine:
            end = body.rstrip(" \t\n\v\f\r")
            fault = 0 if not end else 1 if (role, body) in seen else 2 if end[-1] not in ".!?" else 3
            seen.add((role, body))
            if fault < 3:
                faults[fault] += 1
            todo.append((role, body, fault < 2, fault == 2))
        turns = [t for t, _, _ in mine if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, done = plain_dp(todo)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *faults, illegal, cost, audit, hashlib.sha256(done.encode()).hexdigest())
    return out


def query(spark, folder, rows, schema="conv_id long, turn long, role string, text string, kind int, g int, id int, block int, ways int, rank int"):
    spark.createDataFrame([(*r, 0, 0, 0, 0, 0, 0) for r in rows], schema).repartition(3).write.parquet(f"{folder}/conversations.parquet")
    got = R.op13_conversation_repair(spark, str(folder)).collect()
    assert len(got) == len({r[0] for r in rows})
    return {r[0]: tuple(r)[1:] for r in got}


def made(rnd, conv, n):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "superuser", "Übersetzer"]
    texts = ["Yes.", "No!", "why?", "cut", "cut ", " \t\n", "", None, "Done. \n", "a\nb.", " ", "é?"]
    return [(conv, rnd.choice([i, i, i, max(0, i - 1), i + 2, None]), rnd.choices(roles, [3, 9, 9, 9, 9, 1, 1, 1, 1, 1])[0],
             rnd.choice(texts) if rnd.random() < 0.5 else f"text {i}{rnd.choice(['.', '', '!'])}") for i in range(n)]


def test_query_equals_plain(spark, tmp_path):
    rnd = random.Random(7)
    rows = [r for conv in range(250) for r in made(rnd, conv, rnd.randrange(1, 12))]
    rows += [(None, 0, "user", "x"), (None, None, None, None), (900, 0, "user", "w. " * 400_000), (900, 1, "assistant", "w" * 300_000)]
    rows += [(901, t, "user", "Same text.") for t in range(30)] + [(902, 3, "user", "Twice.")] * 4 + [(903, None, "assistant", "A.")] * 2
    only_dropped = next(i for i in range(10_000, 20_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows.append((only_dropped, 0, "user", "x."))
    want = plain(rows)
    assert want[only_dropped][:7] == (0, 0, 0, 0, 0, 0, "")
    assert query(spark, tmp_path, rows) == want


@pytest.mark.parametrize("block", [1, 3, 256])
def test_long_conversations_in_blocks(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(R, "BLOCK", block)
    rnd = random.Random(block)
    rows = [r for conv, n in ((1, 700), (2, 60), (3, 2), (4, 5)) for r in made(rnd, conv, n)]
    assert query(spark, tmp_path, rows) == plain(rows)


def test_grammar(spark):
    words = ["uauaua", "suauaua", "uaUaua", "xx", "uauauaua", "o", "aaaaaaa", "UAUA"]
    rules = R.grammar(spark.createDataFrame([(w,) for w in words], "seq string"))
    assert rules[0][1] == "ua" and any(pair == rules[0][0] * 2 for _, pair in rules)
    for w in words:
        assert by_matrices(w, rules) == by_matrices(w)
    packed = spark.createDataFrame([(w,) for w in words], "seq string").select("seq", R._packed(rules, F.col("seq")).alias("p"))
    back = dict(rules)
    for r in packed.collect():
        word = r.p
        while any(c in back for c in word):
            word = "".join(back.get(c, c) for c in word)
        assert word == r.seq
    shared = R.matrices(rules)[rules[-1][0]]
    assert any(w is not None for row in shared for w in row)


def test_empty_table_and_string_ids(spark, tmp_path):
    df = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert R.repair(df).count() == 0
    got = R.repair(spark.createDataFrame([("b", 0, "user", "Hi."), ("a", 0, "user", "Hi."), ("a", 1, "assistant", "Ho.")], df.schema))
    assert sorted((r.conv_id, r.audit, r.cost) for r in got.collect()) == [("a", "KK", 0), ("b", "KI", 3)]


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_equals_duckdb(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    assert compare(R.op13_conversation_repair(spark, folder), duck(folder), R.ORACLE) is None
