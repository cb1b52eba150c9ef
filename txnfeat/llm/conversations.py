"""Conversation structure repair by a min-plus matrix scan.

A conversation should be nothing, or an optional system turn and then pairs of user and assistant turns. An automaton of four
states (start, after system, after user, after assistant) accepts these. Each turn is a 4x4 matrix: its entry (i, j) is the
cheapest way, as (cost, audit), from state i to state j by inserting turns and then keeping, rerolling or deleting this one. A
product adds costs, joins audits, and takes the least; equal costs go by the audit's bytes. Two audits of the same turns with
one cost are never a prefix of one another (what the longer has in excess would be insertions, and cost), so the order
survives joining and the product is associative: conversations may be cut anywhere and multiplied in any grouping.

Turns are placed by ranges of (conversation, turn), so a conversation of any length is spread over tasks. A conversation that
lies within a task and RUN_BYTES is judged there. Others, that a border between tasks cuts or that are longer, leave pieces:
turns that repeat across pieces are found in a shuffle, each piece gets its matrix, matrices are multiplied in a tree
whose levels join eight tasks each, and the audit is applied to the pieces as a stream. SHA-256 can't be computed in
parts, so the bytes of one repaired conversation pass through one task, piece by piece."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .common import session_of, table, trimmed, written

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: A conversation with more text or turns is cut into pieces.
RUN_BYTES, RUN_ROWS = 4 << 20, 16_384
#: Text of a range, and the most ranges, whose places the driver keeps.
RANGE_BYTES, MOST_RANGES = 8 << 20, 50_000
#: Tasks whose products are joined at each level of the tree, as a power of two.
FAN = 3
SPACE = " \t\n\x0b\x0c\r"
STATES, START, ENDS = 4, 0, (0, 3)
OK, CUT, BLANK, REPEATED = 0, 4, 8, 12

Element = tuple[int, str]
Matrix = tuple[Element | None, ...]


def follows(state: int, initial: str) -> int | None:
    """The state after a turn whose role has that initial; None where none may follow."""
    return {"s": 1 if state == START else None, "u": None if state == 2 else 2, "a": 3 if state == 2 else None}.get(initial)


def role_after(state: int) -> str:
    """Of a turn that is inserted or rerolled here; there is never a choice."""
    return "assistant" if state == 2 else "user"


def _best(ways: list[Element | None]) -> Element | None:
    return min((w for w in ways if w is not None), default=None)


def product(a: Matrix, b: Matrix) -> Matrix:
    out = []
    for i in range(0, STATES * STATES, STATES):
        for j in range(STATES):
            ways = [(a[i + k][0] + b[k * STATES + j][0], k) for k in range(STATES) if a[i + k] is not None and b[k * STATES + j] is not None]
            if not ways:
                out.append(None)
                continue
            least = min(ways)[0]
            out.append((least, min(a[i + k][1] + b[k * STATES + j][1] for c, k in ways if c == least)))
    return tuple(out)


def _matrix(way) -> Matrix:
    return tuple(way(i, j) for i in range(STATES) for j in range(STATES))


IDENTITY = _matrix(lambda i, j: (0, "") if i == j else None)
_INSERTED = _matrix(lambda i, j: _best([(0, "") if i == j else None, (INSERT, "I") if follows(i, role_after(i)[0]) == j else None]))
#: Any number of insertions. From no state to another are more than two needed.
CLOSURE = product(_INSERTED, _INSERTED)


def _turn(code: int) -> Matrix:
    """Of a turn, by the place of its initial in 'sua' (3: none of these) plus its fault."""
    initial, fault = "sua "[code % 4], code - code % 4
    more = TRUNCATED if fault == CUT else 0

    def way(i: int, j: int) -> Element | None:
        ways = [(DELETE, "D") if i == j else None]
        if fault in (OK, CUT):
            ways += [(more, "K") if follows(i, initial) == j else None, (REROLE + more, "R") if follows(i, role_after(i)[0]) == j else None]
        return _best(ways)

    return product(CLOSURE, _matrix(way))


TURNS = [_turn(code) for code in range(16)]


@lru_cache(maxsize=65_536)
def _few(codes: bytes) -> Matrix:
    return TURNS[codes[0]] if len(codes) == 1 else product(_few(codes[: len(codes) // 2]), _few(codes[len(codes) // 2 :]))


def fold(codes: bytes) -> Matrix:
    """The product of the turns' matrices, as a balanced tree."""
    if not codes:
        return IDENTITY
    if len(codes) <= 4:
        return _few(codes)
    half = len(codes) // 2
    return product(fold(codes[:half]), fold(codes[half:]))


@dataclass
class Part:
    """What is known of turns in a row; parts of one conversation join."""

    rows: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first: int = 3  # initials, by their places
    last: int = 3
    low: int | None = None  # turns
    high: int | None = None
    turns: int = 0
    ways: Matrix = field(default=IDENTITY)

    def then(self, other: Part) -> Part:
        if not self.rows or not other.rows:
            return other if not self.rows else self
        low, high = self.low if self.low is not None else other.low, other.high if other.high is not None else self.high
        border = _illegal(self.last, other.first)
        turns = self.turns + other.turns - (self.high is not None and self.high == other.low)
        sums = (getattr(self, c) + getattr(other, c) for c in ("rows", "blank", "duplicate", "truncated"))
        return Part(*sums, self.illegal + other.illegal + border, self.first, other.last, low, high, turns, product(self.ways, other.ways))

    def result(self) -> dict:
        total = product(self.ways, CLOSURE)
        cost, audit = min(w for j in ENDS if (w := total[START * STATES + j]) is not None)
        gaps = self.high - self.low + 1 - self.turns if self.low is not None else 0
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": cost, "audit": audit}


def _illegal(a: int, b: int) -> int:
    return int((a, b) not in ((0, 1), (1, 2), (2, 1)))


def part_of(codes: bytes, low: int | None, high: int | None, turns: int) -> Part:
    if not codes:
        return Part()
    faults = [c - c % 4 for c in codes]
    bad = sum(_illegal(a % 4, b % 4) for a, b in zip(codes, codes[1:]))
    return Part(len(codes), faults.count(BLANK), faults.count(REPEATED), faults.count(CUT), bad, codes[0] % 4, codes[-1] % 4, low, high, turns, fold(codes))


def code_of(role: str, text: str) -> int:
    """Of a turn by itself: the place of its initial, and whether it is blank or truncated."""
    end = text.rstrip(SPACE)[-1:]
    return {"s": 0, "u": 1, "a": 2}.get(role[:1], 3) + (BLANK if not end else OK if end in ".!?" else CUT)


def walk(turns: Iterator[tuple[str, str]], audit: str, at: int = 0, state: int = START) -> Iterator[tuple[str, str, str, int, int]]:
    """(role, text, edit) of the repaired turns, and how far the audit is read and the state after them, with all insertions before a turn."""
    for role, text in turns:
        while audit[at] == "I":
            made = role_after(state)
            at, state = at + 1, follows(state, made[0])
            yield made, "", "I", at, state
        edit = audit[at]
        at += 1
        if edit != "D":
            role = role_after(state) if edit == "R" else role
            state = follows(state, role[0])
            yield role, text, edit, at, state
        else:
            yield role, text, edit, at, state


class Digest:
    """SHA-256 of role:text of the repaired turns, joined by newlines."""

    def __init__(self) -> None:
        self.hash, self.any, self.at, self.state = hashlib.sha256(), False, 0, START

    def add(self, turns: Iterator[tuple[str, str]], audit: str) -> None:
        for role, text, edit, self.at, self.state in walk(turns, audit, self.at, self.state):
            if edit != "D":
                self._put(f"{role}:{text}")

    def end(self, audit: str) -> str:
        for _ in audit[self.at :]:
            made = role_after(self.state)
            self.state = follows(self.state, made[0])
            self._put(f"{made}:")
        return self.hash.hexdigest()

    def _put(self, line: str) -> None:
        self.hash.update(("\n" + line if self.any else line).encode())
        self.any = True


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_PIECE = "codes binary, low long, high long, turns long, roles array<string>, texts array<string>, first_at array<int>, first_key array<binary>"
_PART = "rows long, blank long, duplicate long, truncated long, illegal long, first int, last int, low long, high long, turns long, costs array<long>, audits array<string>"


class _Run:
    """Turns of one conversation that have come so far, since the last piece was cut off."""

    def __init__(self, conv) -> None:
        self.conv, self.cut = conv, False
        self.clear()

    def clear(self) -> None:
        self.roles, self.texts, self.codes, self.seen = [], [], bytearray(), {}
        self.low = self.high = None
        self.turns = self.size = 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        code = code_of(role, text)
        if code < BLANK and self.seen.setdefault((role, text), len(self.codes)) != len(self.codes):
            code = code % 4 + REPEATED
        self.roles.append(role)
        self.texts.append(text)
        self.codes.append(code)
        self.size += len(role) + len(text)
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn

    def whole(self) -> dict:
        out = part_of(bytes(self.codes), self.low, self.high, self.turns).result()
        digest = Digest()
        digest.add(zip(self.roles, self.texts), out["audit"])
        return out | {"repaired_sha256": digest.end(out["audit"])}

    def piece(self) -> dict:
        keys = [hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest() for r, t in self.seen]
        out = {"codes": bytes(self.codes), "low": self.low, "high": self.high, "turns": self.turns, "roles": self.roles, "texts": self.texts, "first_at": list(self.seen.values()), "first_key": keys}
        self.clear()
        self.cut = True
        return out


def _judge(run_bytes: int, run_rows: int, schema: pa.Schema):
    """Results of the conversations that lie within the task, pieces of others. The first and the last may go on in other tasks."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, size, run, rows, first = TaskContext.get().partitionId(), 0, 0, None, [], True

        def piece() -> dict:
            nonlocal n, size
            n += 1
            size += run.size
            return {"conv_id": run.conv, "part": task, "no": n, "piece": run.piece()}

        for b in batches:
            for conv, turn, role, text, gone in zip(*(c.to_pylist() for c in b.columns)):
                if run is None or conv != run.conv:
                    if run is not None:
                        rows.append(piece() if first or run.cut else {"conv_id": run.conv, "result": run.whole()})
                        first = False
                    run = _Run(conv)
                if not gone:
                    run.add(turn, role, text)
                    if run.size >= run_bytes or len(run.codes) >= run_rows:
                        rows.append(piece())
                if len(rows) >= 512 or size >= 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
        if run is not None:
            rows.append(piece())
            yield pa.RecordBatch.from_pylist(rows, schema)

    return trimmed(f)


def _packed(p: Part) -> dict:
    # A cost of -1: no way.
    return {c: getattr(p, c) for c in ("rows", "blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns")} | {"costs": [w[0] if w else -1 for w in p.ways], "audits": [w[1] if w else "" for w in p.ways]}


def _unpacked(r: dict) -> Part:
    ways = tuple((c, a) if c >= 0 else None for c, a in zip(r["costs"], r["audits"]))
    return Part(*(r[c] for c in ("rows", "blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns")), ways)


def _measure(schema: pa.Schema):
    """The part of each piece; turns that repeat those of other pieces come as their places."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                codes = bytearray(r["codes"])
                for i in r["again"] or ():
                    codes[i] = codes[i] % 4 + REPEATED
                out.append({"conv_id": r["conv_id"], "part": r["part"], "no": r["no"]} | _packed(part_of(bytes(codes), r["low"], r["high"], r["turns"])))
            yield pa.RecordBatch.from_pylist(out, schema)

    return trimmed(f)


def _join(schema: pa.Schema):
    """Rows of one (conv_id, block), which come in order, as one row with their product."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, so_far = None, None, None
        for b in batches:
            for r in b.to_pylist():
                if (k := (r["conv_id"], r["block"])) != key or so_far is None:
                    if so_far is not None:
                        yield pa.RecordBatch.from_pylist([at | _packed(so_far)], schema)
                    key, at, so_far = k, {c: r[c] for c in ("conv_id", "part", "no")}, _unpacked(r)
                else:
                    so_far = so_far.then(_unpacked(r))
        if so_far is not None:
            yield pa.RecordBatch.from_pylist([at | _packed(so_far)], schema)

    return trimmed(f)


def _finish(schema: pa.Schema):
    """Results of conversations in pieces: their product comes first, then the pieces in order."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, result, digest = None, None, None
        for b in batches:
            for r in b.to_pylist():
                if r["part"] < 0:
                    if digest is not None:
                        yield pa.RecordBatch.from_pylist([{"conv_id": conv} | result | {"repaired_sha256": digest.end(result["audit"])}], schema)
                    conv, result, digest = r["conv_id"], _unpacked(r["total"]).result(), Digest()
                else:
                    digest.add(zip(r["roles"], r["texts"]), result["audit"])
        if digest is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": conv} | result | {"repaired_sha256": digest.end(result["audit"])}], schema)

    return trimmed(f)


def repair(rows: DataFrame, gone: str | None = None, run_bytes: int = RUN_BYTES, run_rows: int = RUN_ROWS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation.

    rows: conv_id, turn, role, text; other columns are left out. Turns are in order of `turn`, nulls first, those with one
    turn by role and then by the text's SHA-256. A null role or text counts as one space; a null conv_id is a conversation
    of its own. Rows where the boolean column `gone` is true only name their conversation, which may so be without turns:
    it has zeros, an empty audit and the hash of nothing. Rows that repeat are duplicates of the first of them. A text of any
    length is one value of one row. An empty table gives an empty one."""
    spark = session_of(rows)
    key = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}"
    types = {name: StructType.fromDDL(f"{key}, {ddl}") for name, ddl in (("run", f"part int, no int, piece struct<{_struct(_PIECE)}>, result struct<{_struct(_RESULT)}>"), ("part", f"part int, no int, {_PART}"), ("result", _RESULT))}
    arrow = {name: to_arrow_schema(t) for name, t in types.items()}
    none = F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False)
    text = lambda c: F.when(none, "").otherwise(F.coalesce(c, F.lit(" ")))
    clean = rows.select("conv_id", F.when(~none, F.col("turn").cast("long")).alias("turn"), text("role").alias("role"), text("text").alias("text"), none.alias("gone"))
    n = min((clean.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // range_bytes + 1, MOST_RANGES)
    # Equal rows may go to different tasks: any order of them is right.
    order = ("conv_id", "turn", "role", "digest", "place")
    placed = clean.withColumns({"digest": F.sha2("text", 256), "place": F.monotonically_increasing_id()}).repartitionByRange(n, *order).sortWithinPartitions(*order)
    runs = written(placed.select("conv_id", "turn", "role", "text", "gone").mapInArrow(_judge(run_bytes, run_rows, arrow["run"]), types["run"]), "conversation-runs")
    done = runs.where("result is not null").select("conv_id", "result.*")
    pieces = runs.where("piece is not null").select("conv_id", "part", "no", "piece")

    firsts = pieces.select("conv_id", "part", "no", F.explode(F.arrays_zip("piece.first_at", "piece.first_key")).alias("f")).select("conv_id", "part", "no", "f.*")
    earlier = Window.partitionBy("conv_id", "first_key").orderBy("part", "no", "first_at")
    again = firsts.withColumn("n", F.row_number().over(earlier)).where("n > 1").groupBy("part", "no").agg(F.collect_list("first_at").alias("again"))
    slim = pieces.select("conv_id", "part", "no", "piece.codes", "piece.low", "piece.high", "piece.turns")
    parts = slim.join(again, ["part", "no"], "left").mapInArrow(_measure(arrow["part"]), types["part"])
    tasks, shift = (runs.agg(F.max("part")).first()[0] or 0), 0
    while True:
        blocks = parts.withColumn("block", F.shiftright("part", shift)).repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "part", "no")
        parts = blocks.mapInArrow(_join(arrow["part"]), types["part"])
        if not tasks >> shift:
            break
        shift += FAN

    total = F.struct(*(c for c in parts.columns if c not in ("conv_id", "part", "no")))
    nothing = F.lit(None).cast("array<string>")
    heads = parts.select("conv_id", F.lit(-1).alias("part"), F.lit(-1).alias("no"), total.alias("total"), nothing.alias("roles"), nothing.alias("texts"))
    bodies = pieces.select("conv_id", "part", "no", F.lit(None).cast(heads.schema["total"].dataType).alias("total"), "piece.roles", "piece.texts")
    in_order = heads.union(bodies).repartition("conv_id").sortWithinPartitions("conv_id", "part", "no")
    return done.union(in_order.mapInArrow(_finish(arrow["result"]), types["result"]))


def _struct(ddl: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (f.split(" ") for f in ddl.split(", ")))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: the rows, a fifth of them damaged by CRC-32 of conv_id:turn; dropped ones are gone, not absent."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    rows = conversations.withColumn("kind", kind).select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(part("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), "kind")
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", "role", "text", "gone", copies.alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")), "gone")


#: The automaton as a recursion over turns: each state keeps its least (cost, audit, repaired text). CRC-32 is made of its table.
ORACLE = r"""
with recursive bits as (
  select n, list_reduce([n::bigint] || range(8), lambda c, i: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from range(256) t(n)
), crc_table as (select list(v order by n) as tab from bits),
keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations
), kinds as (
  select *, xor(list_reduce([4294967295::bigint] || list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::bigint), lambda c, b: xor(c >> 8, tab[xor(c, b) % 256 + 1])), 4294967295) % 20 as kind
  from keyed, crc_table
), damaged as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
         case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when kind = 3 then 2 else 1 end)) as copy
  from kinds where kind <> 0
), placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as i, coalesce(substr(role, 1, 1), '') as c from damaged
), faults as (
  select *, case when not regexp_matches(text, '[^ 	-
]') then 'blank'
                 when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
                 when not regexp_matches(text, '[.!?][ 	-
]*$') then 'truncated' end as fault,
            lag(c) over (partition by conv_id order by i) || c as two
  from placed
), facts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
         count(*) filter (fault = 'truncated') as truncated, count(*) filter (two is not null and two not in ('su', 'ua', 'au')) as illegal, count(*) as n
  from faults group by conv_id
), ways as (
  select conv_id, 0::bigint as i, {'c': 0::bigint, 'a': '', 't': ''} as s0, null::struct(c bigint, a varchar, t varchar) as s1, null::struct(c bigint, a varchar, t varchar) as s2, null::struct(c bigint, a varchar, t varchar) as s3 from facts
  union all
  select conv_id, i, s0, s1,
         list_min(list_filter([d2, case when k = 'u' then {'c': m.c + e, 'a': m.a || 'K', 't': m.t || chr(10) || role || ':' || text} end, case when live then {'c': m.c + e + 2, 'a': m.a || 'R', 't': m.t || chr(10) || 'user:' || text} end], lambda x: x.c is not null)),
         list_min(list_filter([d3, case when k = 'a' then {'c': u2.c + e, 'a': u2.a || 'K', 't': u2.t || chr(10) || role || ':' || text} end, case when live then {'c': u2.c + e + 2, 'a': u2.a || 'R', 't': u2.t || chr(10) || 'assistant:' || text} end], lambda x: x.c is not null))
  from (
    select conv_id, i, role, text, k, live, e, u2, list_min(list_filter([o0, o1, o3], lambda x: x.c is not null)) as m,
           {'c': o0.c + 3, 'a': o0.a || 'D', 't': o0.t} as s0,
           list_min(list_filter([{'c': o1.c + 3, 'a': o1.a || 'D', 't': o1.t}, case when k = 's' then {'c': o0.c + e, 'a': o0.a || 'K', 't': o0.t || chr(10) || role || ':' || text} end], lambda x: x.c is not null)) as s1,
           {'c': u2.c + 3, 'a': u2.a || 'D', 't': u2.t} as d2, {'c': o3.c + 3, 'a': o3.a || 'D', 't': o3.t} as d3
    from (
      select conv_id, i, role, text, k, live, e, o0, o1, u2, list_min(list_filter([s3, {'c': u2.c + 2, 'a': u2.a || 'I', 't': u2.t || chr(10) || 'assistant:'}], lambda x: x.c is not null)) as o3
      from (
        select w.conv_id, f.i, role, text, case when fault in ('blank', 'duplicate') then '' else f.c end as k, coalesce(fault not in ('blank', 'duplicate'), true) as live, case when fault = 'truncated' then 1 else 0 end as e,
               s0 as o0, s1 as o1, s3, list_min(list_filter([s2] || list_transform(list_filter([s0, s1, s3], lambda x: x.c is not null), lambda x: {'c': x.c + 2, 'a': x.a || 'I', 't': x.t || chr(10) || 'user:'}), lambda x: x.c is not null)) as u2
        from ways w join faults f on f.conv_id is not distinct from w.conv_id and f.i = w.i + 1
      )
    )
  )
), ends as (
  select w.conv_id, list_min(list_filter([s0, s3, {'c': s2.c + 2, 'a': s2.a || 'I', 't': s2.t || chr(10) || 'assistant:'}] || list_transform(list_filter([s0, s1], lambda x: x.c is not null), lambda x: {'c': x.c + 4, 'a': x.a || 'II', 't': x.t || chr(10) || 'user:' || chr(10) || 'assistant:'}), lambda x: x.c is not null)) as z
  from ways w join facts f on f.conv_id is not distinct from w.conv_id and w.i = f.n
)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
       coalesce(illegal, 0)::bigint as illegal, coalesce(z.c, 0)::bigint as cost, coalesce(z.a, '') as audit, sha256(coalesce(substr(z.t, 2), '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join facts f on f.conv_id is not distinct from c.conv_id left join ends e on e.conv_id is not distinct from c.conv_id
"""
