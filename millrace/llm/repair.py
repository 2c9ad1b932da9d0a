"""Conversation structure repair: the cheapest edits that make roles alternate, by grammar-compressed DP.

A conversation is a sequence of symbols, one per row: its role's initial (s, u, a or another) and its
fault (must be deleted, truncated, none). Repaired initials must read ``(s?(ua)+)?``; the states of a
repair are: nothing yet, after system, after user, after assistant. A symbol is a 4 x 4 min-plus matrix:
the least cost from state to state, with the audit (the edits' initials) that is least in ASCII order.
Two audits of one cost are never one the other's beginning (they hold as many K, R and D, and each I
costs), so the order of two audits stays when both go on alike, and matrices may be multiplied in any
grouping.

Symbols are written as characters, so sequences are strings, and only different ones are worked on.
Re-Pair rounds find the most frequent neighbours over all of them, each pair becomes a rule, and
``replace`` puts the rule's character in. A rule's matrix is the product of its two parts', computed
once, bottom-up, with audits as ropes that share their parts; a sequence's matrix is the product of
what is left of it, and serves every conversation that has this sequence.

Long conversations are cut into blocks of ``BLOCK`` rows by rank; block matrices are applied in order
while a sorted stream of the texts writes the repaired text's digest. That digest runs over one
conversation's whole text, so its rows pass through one task; it holds the audit and a batch of rows.

Defined results: NULL roles and texts are one space, so blank (a NULL or empty role is another role);
NULL turns come first and count for no gap; equal turns are ordered by role and text's hash; a NULL
conv_id is a conversation of its own; repeated rows are duplicates; texts may be of any length; a
conversation without rows gives zeros, an empty audit and the digest of an empty text; an empty table
gives an empty result; other columns are never read, so they may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import SPACES_SQL, crc32_sql, materialize, read_table, register
from millrace.llm.ranks import ranked

#: rows of a conversation that make one sequence
BLOCK = 256
#: rules of the grammar, and rounds that look for them
MAX_RULES = 64
ROUNDS = 16
_PAIRS_A_ROUND = 64
_FIRST_RULE = 0xE000        # characters for private use
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
_ENDS = (START, ASSISTANT)
_AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}


class Rope:
    """A text made of two others, or of letters."""

    __slots__ = ("left", "right")

    def __init__(self, left: "Rope | str", right: "Rope | str"):
        self.left, self.right = left, right

    @staticmethod
    def joined(a: "Rope | str", b: "Rope | str") -> "Rope | str":
        if isinstance(a, str) and isinstance(b, str) and len(a) + len(b) < 32:
            return a + b
        return Rope(a, b) if a and b else a or b

    @staticmethod
    def pieces(rope: "Rope | str") -> Iterator[str]:
        todo = [rope]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                yield x
            else:
                todo += (x.right, x.left)

    @staticmethod
    def text(rope: "Rope | str") -> str:
        return "".join(Rope.pieces(rope))

    @staticmethod
    def less(a: "Rope | str", b: "Rope | str") -> bool:
        if a is b:
            return False
        letters = lambda r: (c for piece in Rope.pieces(r) for c in piece)
        return next((x < y for x, y in zip(letters(a), letters(b)) if x != y), False)


#: (cost, audit), or None where no edits lead from one state to the other
Way = tuple[int, "Rope | str"] | None
Matrix = list[list[Way]]


def _better(a: Way, b: Way) -> Way:
    if a is None or b is None:
        return a or b
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return b if Rope.less(b[1], a[1]) else a


def product(rows: Matrix, m: Matrix) -> Matrix:
    """Min-plus product; the left factor may be some rows only."""
    out = []
    for row in rows:
        line = [None] * 4
        for k, x in enumerate(row):
            if x is not None:
                for j, y in enumerate(m[k]):
                    if y is not None and (line[j] is None or x[0] + y[0] <= line[j][0]):
                        line[j] = _better(line[j], (x[0] + y[0], Rope.joined(x[1], y[1])))
        out.append(line)
    return out


def _matrix(ways: Iterable[tuple[int, int, int, str]]) -> Matrix:
    m: Matrix = [[None] * 4 for _ in range(4)]
    for i, j, cost, audit in ways:
        m[i][j] = _better(m[i][j], (cost, audit))
    return m


#: rows put in between
INSERTED = product(_matrix([(i, i, 0, "") for i in range(4)] + [(i, j, INSERT, "I") for i, j in _AFTER["u"].items()] + [(USER, ASSISTANT, INSERT, "I")]),
                   _matrix([(i, i, 0, "") for i in range(4)] + [(USER, ASSISTANT, INSERT, "I")]))


def terminals() -> dict[str, Matrix]:
    """Matrices of the symbols: x (must be deleted), and by initial: small, or capital if truncated."""
    delete = [(i, i, DELETE, "D") for i in range(4)]
    out = {"x": product(INSERTED, _matrix(delete))}
    for c in "suao":
        kept = [(i, j, KEEP, "K") for i, j in _AFTER.get(c, {}).items()]
        kept += [(i, j, REROLE, "R") for r in "ua" for i, j in _AFTER[r].items()]
        for symbol, more in ((c, 0), (c.upper(), TRUNCATED)):
            out[symbol] = product(INSERTED, _matrix(delete + [(i, j, cost + more, e) for i, j, cost, e in kept]))
    return out


def _neighbours(s: Column) -> Column:
    n = F.char_length(s)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(s, i, F.lit(2)))).otherwise(F.expr("cast(array() as array<string>)"))


def _packed(rules: list[tuple[str, str]], s: Column) -> Column:
    for symbol, pair in rules:
        s = F.replace(s, F.lit(pair), F.lit(symbol))
    return s


def grammar(seqs: DataFrame, max_rules: int = MAX_RULES, rounds: int = ROUNDS) -> list[tuple[str, str]]:
    """Re-Pair over ``seqs(seq)``: (symbol, the two symbols it stands for), in the order they apply.
    A round counts all neighbours and takes the most frequent that share no symbol; only those
    counts come to the driver."""
    rules: list[tuple[str, str]] = []
    for _ in range(rounds):
        pairs = seqs.select(F.explode(_neighbours(_packed(rules, F.col("seq")))).alias("pair")).groupBy("pair").count()
        top = pairs.where("count > 1").orderBy(F.desc("count"), "pair").limit(_PAIRS_A_ROUND).collect()
        taken: set[str] = set()
        for r in top:
            if len(rules) < max_rules and not taken & set(r.pair):
                taken |= set(r.pair)
                rules.append((chr(_FIRST_RULE + len(rules)), r.pair))
        if not top or len(rules) == max_rules:
            break
    return rules


def matrices(rules: list[tuple[str, str]]) -> dict[str, Matrix]:
    """Matrices of all symbols, rules bottom-up."""
    out = terminals()
    for symbol, pair in rules:
        out[symbol] = product(out[pair[0]], out[pair[1]])
    return out


_WAYS = "array<struct<cost:bigint,audit:string>>"


def solved(seqs: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``seqs(seq, inner)`` -> (seq, ways): the sequence's matrix row by row; its first row only where not ``inner``."""
    table = matrices(rules)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))
        for batch in batches:
            out = []
            for inner, packed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                m = [[(0, "") if i == j else None for j in range(4)] for i in range(4 if inner else 1)]
                for symbol in packed:
                    m = product(m, table[symbol])
                out.append([None if w is None else {"cost": w[0], "audit": Rope.text(w[1])} for row in m for w in row])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["seq", "ways"])
    return seqs.select("seq", "inner", _packed(rules, F.col("seq")).alias("packed")).mapInArrow(solve, f"seq string, ways {_WAYS}")


def _group(id_col: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), id_col.cast("string")), F.lit(""))


def _rows(convs: DataFrame) -> DataFrame:
    """(g, id, turn, role, text, h) without NULL roles and texts; h tells (role, text) apart."""
    role, text = F.coalesce(F.col("role"), F.lit(" ")), F.coalesce(F.col("text"), F.lit(" "))
    h = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    return convs.select(_group(F.col("conv_id")).alias("g"), F.col("conv_id").alias("id"), F.col("turn").cast("long").alias("turn"),
                        role.alias("role"), text.alias("text"), h.alias("h"))


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("h").asc()]


def _marked(rows: DataFrame) -> DataFrame:
    """Rows without their texts, with rank, initial, symbol and first fault."""
    tail = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r"))
    first = F.substring("role", 1, 1)
    light = rows.select("g", "id", "turn", "role", "h", F.when(first.isin("s", "u", "a"), first).otherwise("o").alias("initial"),
                        (tail == "").alias("blank"), (~F.right(tail, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    places = ranked(light, "g", _order())
    again = places.groupBy("g", "h").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    out = places.join(again.select("g", "h", "first"), ["g", "h"], "left").withColumn("seen", F.coalesce(F.col("rank") > F.col("first"), F.lit(False)))
    fault = F.when(F.col("blank"), "blank").when(F.col("seen"), "duplicate").when(F.col("cut"), "truncated")
    symbol = F.when(F.col("blank") | F.col("seen"), "x").when(F.col("cut"), F.upper("initial")).otherwise(F.col("initial"))
    return out.select("g", "id", "turn", "rank", "initial", fault.alias("fault"), symbol.alias("symbol"))


def _blocks(marked: DataFrame) -> DataFrame:
    """(g, id, block, seq, counts of faults, illegal neighbours, first and last initial, turns)."""
    per = marked.groupBy("g", "id", F.expr(f"rank div {BLOCK}").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("rank", "symbol", "initial"))).alias("r"),
        *(F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")),
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.size(F.collect_set("turn")).cast("long").alias("turns"))
    word = lambda f: F.array_join(F.transform("r", lambda x: x[f]), "")
    per = per.withColumns({"seq": word("symbol"), "initials": word("initial")}).drop("r")
    illegal = F.size(F.filter(_neighbours(F.col("initials")), lambda p: ~p.isin("su", "ua", "au"))).cast("long")
    return per.withColumns({"illegal": illegal, "first": F.left("initials", F.lit(1)), "last": F.right("initials", F.lit(1))}).drop("initials")


class _Conversation:
    """Takes a conversation's blocks in order, then its rows in order."""

    def __init__(self):
        self.ways: list[Way] = [(0, ""), None, None, None]
        self.counts = [0, 0, 0, 0]                     # blank, duplicate, truncated, illegal
        self.last, self.low, self.high, self.turns = "", None, None, 0
        self.audit, self.at, self.state, self.sha, self.lines = None, 0, START, hashlib.sha256(), 0

    def block(self, ways: list[dict | None], counts: list[int], first: str, last: str, low: int | None, high: int | None, turns: int) -> None:
        m = [[w and (w["cost"], w["audit"]) for w in ways[i:i + 4]] for i in range(0, len(ways), 4)]
        self.ways = product([self.ways], m + [[None] * 4] * (4 - len(m)))[0]
        self.counts = [a + b for a, b in zip(self.counts, counts)]
        self.counts[3] += bool(self.last) and self.last + first not in ("su", "ua", "au")
        self.last = last
        if turns:
            self.turns += turns - (self.high is not None and self.high == low)
            self.low, self.high = low if self.low is None else self.low, high

    def _decide(self) -> None:
        if self.audit is None:
            ends = product([self.ways], INSERTED)[0]
            cost, audit = _better(ends[START], ends[ASSISTANT])
            self.cost, self.audit = cost, Rope.text(audit)

    def _line(self, role: str, text: str) -> None:
        self.sha.update(f"{'' if not self.lines else chr(10)}{role}:{text}".encode())
        self.lines += 1

    def _next(self) -> str:
        """The expected role, which the state then has."""
        self.state = ASSISTANT if self.state == USER else USER
        return "assistant" if self.state == ASSISTANT else "user"

    def _inserts(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            self._line(self._next(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._decide()
        self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = _AFTER[role[0]][self.state]
            self._line(role, text)
        elif edit == "R":
            self._line(self._next(), text)

    def result(self) -> tuple:
        self._decide()
        self._inserts()
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (gaps, *self.counts, self.cost, self.audit, self.sha.hexdigest())


_STREAM = ("id", "g", "kind", "block", "ways", "blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns", "role", "text")
_RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _repaired(stream: DataFrame) -> DataFrame:
    id_type = stream.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, conv, ids, done, kind = None, None, [], [], None

        def out() -> pa.RecordBatch:
            cols = [pa.array(ids, kind), *(pa.array(c, t) for c, t in zip(zip(*done), [pa.int64()] * 6 + [pa.string()] * 2))]
            ids.clear(), done.clear()
            return pa.RecordBatch.from_arrays(cols, ["conv_id", *_RESULT])
        for batch in batches:
            kind = batch.column(0).type
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                r = dict(zip(_STREAM, r))
                if r["g"] != key:
                    if conv:
                        done.append(conv.result())
                    if len(done) >= 1000:
                        yield out()
                    key, conv = r["g"], _Conversation()
                    ids.append(r["id"])
                if r["kind"] == 1:
                    conv.block(r["ways"], [r[f] for f in ("blank", "duplicate", "truncated", "illegal")], *(r[f] for f in ("first", "last", "low", "high", "turns")))
                elif r["kind"] == 2:
                    conv.row(r["role"], r["text"])
            # an id that goes on is kept for the next batch
            if len(done) >= 1000:
                going = ids.pop()
                yield out()
                ids.append(going)
        if conv:
            done.append(conv.result())
            yield out()
    schema = f"conv_id {id_type.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return stream.mapInArrow(run, schema)


def repair(convs: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``convs(conv_id, turn, role, text)`` -> a row per conversation: conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256. ``ids(conv_id)`` may name conversations of which no row is left."""
    rows = _rows(convs)
    blocks = materialize(_blocks(_marked(rows)), "blocks")
    seqs = materialize(blocks.groupBy("seq").agg((F.max("block") > 0).alias("inner")), "sequences")
    ways = materialize(solved(seqs, grammar(seqs)), "ways")
    # only what follows another block needs more than the ways from the start
    parts = blocks.join(ways, "seq").withColumn("ways", F.when(F.col("block") == 0, F.slice("ways", 1, 4)).otherwise(F.col("ways")))
    marks = (rows.select("g", "id") if ids is None else ids.select(_group(F.col("conv_id")).alias("g"), F.col("conv_id").alias("id"))).distinct()
    stream = marks.withColumn("kind", F.lit(0))
    stream = stream.unionByName(parts.drop("seq").withColumn("kind", F.lit(1)), allowMissingColumns=True)
    stream = stream.unionByName(rows.withColumn("kind", F.lit(2)), allowMissingColumns=True)
    stream = stream.repartition("g").sortWithinPartitions("g", "kind", "block", *_order())
    return _repaired(stream.select(*_STREAM))


def damage(convs: DataFrame) -> DataFrame:
    """Rows of ``conversations`` damaged by crc32 of ``conv_id:turn`` modulo 20."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    role, text = F.coalesce(F.col("role"), F.lit(" ")), F.coalesce(F.col("text"), F.lit(" "))
    rows = convs.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


def _sql_edit(way: str, cost: str, letter: str, line: str | None = None) -> str:
    text = f"{way}.t" if line is None else f"{way}.t || CASE WHEN {way}.t = '' THEN '' ELSE chr(10) END || {line}"
    return f"CASE WHEN {way} IS NOT NULL THEN {{'c': {way}.c + {cost}, 'w': {way}.w || '{letter}', 't': {text}}} END"


def _sql_inserted(source: str) -> str:
    """DuckDB SQL: the ways e0..e3 with rows put in, of ``source``'s q0..q3."""
    user = ", ".join(_sql_edit(q, "3", "I", "'user:'") for q in ("q0", "q1", "q3"))
    return f"""SELECT *, list_min([q3, {_sql_edit('e2', '3', 'I', "'assistant:'")}]) AS e3
      FROM (SELECT *, q0 AS e0, q1 AS e1, list_min([q2, {user}]) AS e2 FROM {source})"""


def _sql_step() -> str:
    kept = "CASE WHEN cut THEN 3 ELSE 0 END"
    line = "role || ':' || text"

    def moved(role: str, states: tuple[str, ...]) -> str:
        full = {"u": "user", "a": "assistant"}[role]
        return ", ".join(f"CASE WHEN gone THEN NULL WHEN initial = '{role}' THEN {_sql_edit(q, kept, 'K', line)} "
                         f"ELSE {_sql_edit(q, '3 + ' + kept, 'R', repr(full + ':') + ' || text')} END" for q in states)
    gone = lambda q: _sql_edit(q, "4", "D")
    return f"""{gone('e0')}, list_min([{gone('e1')}, CASE WHEN NOT gone AND initial = 's' THEN {_sql_edit('e0', kept, 'K', line)} END]),
      list_min([{gone('e2')}, {moved('u', ('e0', 'e1', 'e3'))}]), list_min([{gone('e3')}, {moved('a', ('e2',))}])"""


_SQL_WAY = "STRUCT(c BIGINT, w VARCHAR, t VARCHAR)"
ORACLE = f"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations),
dm AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE kind WHEN 3 THEN [1, 2] ELSE [1] END) AS k FROM c WHERE kind <> 0),
tail AS (
  SELECT *, left(role, 1) AS initial, rtrim(text, {SPACES_SQL}) AS tail,
         sha256(octet_length(encode(role)) || ':' || role || text) AS h FROM dm),
r AS (
  SELECT *, tail = '' AS blank, row_number() OVER (PARTITION BY conv_id, h ORDER BY turn NULLS FIRST, k) > 1 AS seen,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, h, k) AS i,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, h, k) AS before FROM tail),
f AS (
  SELECT *, blank OR seen AS gone, NOT blank AND NOT seen AND right(tail, 1) NOT IN ('.', '!', '?') AS cut FROM r),
n AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (seen AND NOT blank) AS duplicate, count(*) FILTER (cut) AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
dp(conv_id, i, q0, q1, q2, q3) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, {{'c': 0, 'w': '', 't': ''}}::{_SQL_WAY}, NULL::{_SQL_WAY}, NULL::{_SQL_WAY}, NULL::{_SQL_WAY} FROM conversations
  UNION ALL
  SELECT x.conv_id, f.i, {_sql_step()}
  FROM ({_sql_inserted('dp')}) x JOIN f ON f.conv_id IS NOT DISTINCT FROM x.conv_id AND f.i = x.i + 1),
best AS (
  SELECT conv_id, i, list_min([e0, e3]) AS w FROM ({_sql_inserted('dp')}))
SELECT best.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, w.c AS cost, w.w AS audit, sha256(w.t) AS repaired_sha256
FROM best LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM best.conv_id WHERE i = coalesce(n.n, 0)
"""


@register("op13_conversation_repair", ORACLE)
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and the repaired text's digest of every damaged conversation."""
    convs = read_table(spark, sf_dir, "conversations")
    return repair(damage(convs), convs.select("conv_id"))
