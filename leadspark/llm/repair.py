"""Conversation repair: turns are aligned with the alternating grammar by Wagner-Fischer."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from leadspark.llm.common import Scratch, portions
from leadspark.operators.skew import join_by_key

DELETE, INSERT, REROLE, UNFINISHED = 3, 2, 2, 1
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
#: Marks of a row.
DROPPED, BLANK, CUT = 1, 2, 4
#: States between two rows: nothing written yet, after s, after u, after a.
START, S, U, A = range(4)
#: What is left to insert at the end in each state.
TAILS = {START: "", S: "II", U: "I", A: ""}
#: Rows of one alignment; longer conversations are chained from pieces of it.
PIECE = 32
#: A conversation with more text than this goes row by row instead of through memory.
BUFFER = 16 << 20
SPACE = " \t\n\x0b\x0c\r"

COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
RESULT = f"{COUNTS}, audit string, repaired_sha256 string"


def align(symbols: str, target: str, bound: int, tail: bool) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits that turn `symbols` into `target`, or None above `bound`.

    Of equally cheap ones the ASCII-least audit. A symbol is the initial of a row's role
    (o: any other), in upper case if the text is unfinished, or x if it must go. Only the
    diagonals that a path of cost `bound` can reach are filled. Without `tail` nothing is
    inserted behind the last row.
    """
    m, n = len(symbols), len(target)
    shift = n - m

    def least(offset: int) -> int:
        rest = shift - offset
        return (INSERT * offset if offset > 0 else -DELETE * offset) + (INSERT * rest if rest > 0 else -DELETE * rest)

    band = [o for o in range(-m, n + 1) if least(o) <= bound]
    if not band:
        return None
    low, high, far = band[0], band[-1], bound + 1
    cost = [[far] * (n + 2) for _ in range(m + 1)]
    cost[m][n] = 0

    def step(symbol: str, aim: str) -> tuple[int, str]:
        if symbol == "x":
            return far, ""
        extra = UNFINISHED if symbol.isupper() else 0
        if symbol.lower() == aim:
            return extra, "K"
        return (REROLE + extra, "R") if aim in ROLES else (far, "")

    for i in range(m, -1, -1):
        here, below = cost[i], cost[i + 1] if i < m else None
        for j in range(min(n, i + high), max(0, i + low) - 1, -1):
            best = here[j]
            if below is not None:
                best = min(best, below[j] + DELETE)
                if j < n:
                    best = min(best, below[j + 1] + step(symbols[i], target[j])[0])
            if j < n and target[j] in ROLES and (i < m or tail):
                best = min(best, here[j + 1] + INSERT)
            here[j] = min(best, far)
    if cost[0][0] > bound:
        return None
    audit, i, j = [], 0, 0
    while i < m or j < n:
        left = cost[i][j]
        if i < m and cost[i + 1][j] + DELETE == left:
            audit.append("D")
            i += 1
        elif j < n and target[j] in ROLES and (i < m or tail) and cost[i][j + 1] + INSERT == left:
            audit.append("I")
            j += 1
        else:
            audit.append(step(symbols[i], target[j])[1])
            i, j = i + 1, j + 1
    return cost[0][0], "".join(audit)


def cheapest(symbols: str, targets: list[str], tail: bool) -> tuple[int, str] | None:
    """The best alignment over `targets`, nearest lengths first; the best so far bounds the next."""
    found, m = None, len(symbols)
    for target in sorted(targets, key=lambda t: (abs(len(t) - m), t)):
        shift = len(target) - m
        bound = found[0] if found else DELETE * m + INSERT * len(target)
        if (INSERT * shift if shift > 0 else -DELETE * shift) <= bound:
            found = min(filter(None, (found, align(symbols, target, bound, tail))), default=None)
    return found


def alternating(first: str, length: int) -> str:
    return ("uaua" if first == "u" else "auau")[:2] * (length // 2) + first * (length % 2)


@lru_cache(50_000)
def spans(symbols: str) -> dict[tuple[int, int], tuple[int, str]]:
    """(entry state, exit state) -> (cost, audit) of a piece; nothing is inserted behind its last row."""
    longest = 5 * len(symbols) // 2 + 1
    targets: dict[tuple[int, int], list[str]] = {}
    for k in range(longest + 1):
        plain, after_u = alternating("u", k), alternating("a", k)
        odd = k % 2
        for entry in (START, S, A):
            targets.setdefault((entry, entry if not k else U if odd else A), []).append(plain)
        targets.setdefault((U, A if odd else U), []).append(after_u)
        targets.setdefault((START, S if not k else U if odd else A), []).append("s" + plain)
    found = {key: cheapest(symbols, aims, False) for key, aims in targets.items()}
    return {key: best for key, best in found.items() if best}


def chain(pieces: list[dict[tuple[int, int], tuple]], start: int = START, end: int | None = None) -> list[tuple[int, int]]:
    """(entry, exit) of every piece on the cheapest way through all of them.

    A piece holds (cost, order) per entry and exit. Audits of one piece and entry all use up
    its rows and end with one, so none is the beginning of another, and the least audit at
    the first difference decides equal costs. The way leads from `start` to `end`, or to
    wherever it is cheapest to stop; it is empty if there is none.
    """
    far = float("inf")
    rest = [INSERT * len(TAILS[s]) if end is None else 0 if s == end else far for s in range(4)]
    behind = [rest]
    for piece in reversed(pieces):
        here = [far] * 4
        for (p, q), c in piece.items():
            here[p] = min(here[p], c[0] + rest[q])
        rest = here
        behind.append(rest)
    if rest[start] == far:
        return []
    behind.reverse()
    way, state = [], start
    for piece, here, after in zip(pieces, behind, behind[1:]):
        _, out = min((c[1], q) for (p, q), c in piece.items() if p == state and c[0] + after[q] == here[state])
        way.append((state, out))
        state = out
    return way


@lru_cache(200_000)
def repair(symbols: str) -> tuple[int, str]:
    """(cost, audit) of a whole conversation: roles that read `(s?(ua)+)?`.

    The roles of every feasible length are one string. Above PIECE rows pieces are aligned
    with every part of it and chained; the result is the same.
    """
    m = len(symbols)
    if m <= PIECE:
        lengths = range(5 * m // 2 + 4)
        return cheapest(symbols, [alternating("u", k) if k % 2 == 0 else "s" + alternating("u", k - 1) for k in lengths if k != 1], True)
    pieces = [spans(symbols[k : k + PIECE]) for k in range(0, m, PIECE)]
    way = chain(pieces)
    tail, taken = TAILS[way[-1][1]], [piece[at] for piece, at in zip(pieces, way)]
    return sum(t[0] for t in taken) + INSERT * len(tail), "".join(t[1] for t in taken) + tail


def through(symbols: str) -> dict[tuple[int, int], tuple[int, str]]:
    """`spans` of any number of rows, by way of pieces."""
    pieces, found = [spans(symbols[k : k + PIECE]) for k in range(0, len(symbols), PIECE)], {}
    if not pieces:
        return {(s, s): (0, "") for s in range(4)}
    for p in range(4):
        for q in range(4):
            if way := chain(pieces, p, q):
                taken = [piece[at] for piece, at in zip(pieces, way)]
                found[p, q] = sum(t[0] for t in taken), "".join(t[1] for t in taken)
    return found


def symbol(role: str, mark: int, repeated: bool) -> str:
    if mark & BLANK or repeated:
        return "x"
    kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return kind.upper() if mark & CUT else kind


class Repaired:
    """The result of one conversation, fed row by row in order; memory does not grow with its text."""

    def __init__(self):
        self.low = self.high = self.turn = self.initial = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.written = 0
        self.aim, self.hash = "", hashlib.sha256()

    def count(self, turn, role: str, mark: int, repeated: bool) -> None:
        if turn is not None:
            if self.turn is None or turn != self.turn:
                self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
        self.blank += bool(mark & BLANK)
        self.duplicate += not mark & BLANK and repeated
        self.truncated += not mark & BLANK and not repeated and bool(mark & CUT)
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in LEGAL
        self.initial = role[:1]

    def put(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.written else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.written, self.aim = self.written + 1, role[:1]

    def edit(self, op: str, role: str | None = None, text: str | None = None) -> None:
        if op in "IR":
            role = ROLES["a" if self.aim == "u" else "u"]
        if op != "D":
            self.put(role, "" if op == "I" else text)

    def row(self, cost: int, audit: str) -> tuple:
        gaps = 0 if self.low is None else (self.high - self.low + 1 - self.turns + 2**63) % 2**64 - 2**63
        counts = (gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost)
        return (*counts, audit, self.hash.hexdigest())


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, mark) after the damage; a dropped row stays, marked.

    By crc32(`conv_id:turn`) % 20: 0 drops a row, 1 empties its text, 2 removes `.!?`, 3
    repeats it, 4 makes its role user. A null counts as one space; a null turn stays null.
    """

    def part(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), part("role").alias("role"), part("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") <= 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "fault",
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.select("conv_id", "turn", "role", "text", marked("text", F.col("fault") == 0).alias("mark"))


def marked(text: str, dropped) -> F.Column:
    rest = F.rtrim(F.col(text), F.lit(SPACE))
    blank = rest == ""
    cut = ~blank & ~F.substring(rest, -1, 1).isin(".", "!", "?")
    return (F.when(dropped, DROPPED).otherwise(F.when(blank, BLANK).otherwise(0) + F.when(cut, CUT).otherwise(0))).cast("int")


def whole(rows: list[tuple]) -> tuple:
    """The result of a conversation held in memory; rows are (turn, role, text, mark)."""
    rows, seen, signs, out = [r for r in rows if not r[3] & DROPPED], set(), [], Repaired()
    for turn, role, text, mark in rows:
        repeated = (role, text) in seen
        seen.add((role, text))
        out.count(turn, role, mark, repeated)
        signs.append(symbol(role, mark, repeated))
    cost, audit = repair("".join(signs))
    left = iter(rows)
    for op in audit:
        _, role, text, _ = (None,) * 4 if op == "I" else next(left)
        out.edit(op, role, text)
    return out.row(cost, audit)


def in_order(batches: Iterator[pa.RecordBatch], names: list[str], heavy: str) -> Iterator[tuple]:
    for batch in batches:
        for part in portions(batch, batch.schema.get_field_index(heavy)):
            yield from zip(*(part.column(n).to_pylist() for n in names))


def repaired(conversations: DataFrame, buffer: int = BUFFER) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    One row per conv_id of the input (null is one too), after `damaged`. Rows stand by turn,
    nulls first, and those of one turn by md5(`role:text`); columns of other names do not matter. A conversation
    whose rows were all dropped has zeros, an empty audit and the hash of an empty string. An
    empty table gives no rows; very long texts only pass through a running hash.

    Rows are range-partitioned by conversation and turn, so a conversation of any size spreads
    over as many partitions as it fills. One that lies inside a partition is finished there.
    The first and last of a partition, which may go on next door, and those with more text than
    `buffer`, go as rows: repeats are found by a salted join, each part of a partition is
    aligned for itself for all states it may begin and end with, the parts (at most one per
    partition) are chained by cost, and one stream per conversation counts and hashes.
    """
    spark, scratch = conversations.sparkSession, Scratch(conversations.sparkSession, "repair")
    key = StructField("conv_id", conversations.schema["conv_id"].dataType)
    # bounds are drawn from samples of these columns, so they must be short; equal rows may change places
    tie = F.md5(F.concat_ws(":", "role", "text").cast("binary"))
    rows = damaged(conversations).withColumn("tie", tie).withColumn("id", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "tie", "id"]
    result = StructType.fromDDL(RESULT)
    both = StructType([key, *result, *StructType.fromDDL("pid int, seq long, turn long, role string, text string, mark int")])
    names = ["conv_id", "turn", "role", "text", "mark"]

    def run(batches):
        pid = TaskContext.get().partitionId()
        schema = pa.schema([(f.name, t) for f, t in zip(both, arrow_types(both))])
        ready: list[tuple] = []
        held: list[tuple] = []
        now, size, seq, rowwise, first = None, 0, 0, False, True

        def as_rows(items):
            nonlocal seq
            for item in items:
                ready.append((now, *[None] * len(result), pid, seq, *item))
                seq += 1
            items.clear()

        def out(force=False):
            if ready and (force or len(ready) >= 2000):
                columns = [pa.array(c, t) for c, t in zip(zip(*ready), schema.types)]
                ready.clear()
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

        for conv, *item in in_order(batches, names, "text"):
            if first:
                now, first, rowwise = conv, False, True
            elif conv != now:
                if rowwise:
                    as_rows(held)
                else:
                    ready.append((now, *whole(held), *[None] * 6))
                    held.clear()
                now, size, rowwise = conv, 0, False
            held.append(tuple(item))
            size += len(item[2]) + 100
            if rowwise or size > buffer:
                rowwise = True
                as_rows(held)
            yield from out()
        as_rows(held)
        yield from out(True)

    table = scratch.write(rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*names).mapInArrow(run, both))
    done = table.filter("pid IS NULL").select("conv_id", *result.names)
    return done.unionByName(by_rows(table.filter("pid IS NOT NULL").drop(*result.names), key, result))


def arrow_types(schema: StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema]


def by_rows(rows: DataFrame, key: StructField, result: StructType) -> DataFrame:
    """The conversations in `rows` (conv_id, pid, seq, turn, role, text, mark), in pieces."""
    spark = rows.sparkSession
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    rows = rows.withColumn("digest", F.when(F.col("mark").bitwiseAND(DROPPED) == 0, digest))
    firsts = rows.filter("digest IS NOT NULL").groupBy("conv_id", "digest").agg(
        F.min(F.struct("pid", "seq")).alias("first"), F.count(F.lit(1)).alias("n")
    )
    rows = join_by_key(rows, firsts.drop("n"), ["conv_id", "digest"], "seq", counts=firsts.select("conv_id", "digest", "n"), null_safe=True)
    repeated = F.coalesce(F.col("first") < F.struct("pid", "seq"), F.lit(False))
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o")
    sign = F.when(F.col("mark").bitwiseAND(DROPPED) != 0, "").when(repeated | (F.col("mark").bitwiseAND(BLANK) != 0), "x")
    sign = sign.when(F.col("mark").bitwiseAND(CUT) != 0, F.upper(initial)).otherwise(initial)
    rows = Scratch(spark, "repair").write(rows.select("conv_id", "pid", "seq", "turn", "role", "text", "mark", repeated.alias("again"), sign.alias("sign")))

    # a part: the rows of one conversation in one partition, as a string of symbols
    parts = rows.groupBy("conv_id", "pid").agg(F.array_sort(F.collect_list(F.struct("seq", "sign"))).alias("signs"), F.min("seq").alias("seq"))
    parts = parts.select("conv_id", "pid", "seq", F.concat_ws("", "signs.sign").alias("signs"))
    table = StructType([key, *StructType.fromDDL("pid int, seq long, entry int, leave int, cost long, place int, audit string")])

    def ways(batches):
        for conv, pid, seq, signs in in_order(batches, ["conv_id", "pid", "seq", "signs"], "signs"):
            found = [(p, q, c, a) for (p, q), (c, a) in through(signs).items()]
            places = {a: n for n, a in enumerate(sorted({f[3] for f in found}))}
            lines = [(conv, pid, seq, p, q, c, places[a], a) for p, q, c, a in found]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines), arrow_types(table))], names=table.names)

    ways_table = Scratch(spark, "repair").write(parts.mapInArrow(ways, table))

    def chained(pdf):
        import pandas as pd

        pids, pieces = [], []
        for pid, part in pdf.sort_values("pid").groupby("pid", sort=True):
            pids.append(pid)
            pieces.append({(p, q): (c, n) for p, q, c, n in zip(part["entry"], part["leave"], part["cost"], part["place"])})
        way = chain(pieces)
        tails = [""] * (len(way) - 1) + [TAILS[way[-1][1]]]
        out = pd.DataFrame({"pid": pids, "entry": [w[0] for w in way], "leave": [w[1] for w in way], "tail": tails})
        out.insert(0, "conv_id", pdf["conv_id"].iloc[0])
        return out

    chosen = StructType([key, *StructType.fromDDL("pid int, entry int, leave int, tail string")])
    way = ways_table.drop("audit").groupBy("conv_id").applyInPandas(chained, chosen)
    picked = ways_table.alias("w").join(
        way.alias("c"),
        F.col("w.conv_id").eqNullSafe(F.col("c.conv_id")) & (F.col("w.pid") == F.col("c.pid")) & (F.col("w.entry") == F.col("c.entry")) & (F.col("w.leave") == F.col("c.leave")),
    ).select("w.conv_id", "w.pid", "w.seq", "w.cost", F.concat("w.audit", "c.tail").alias("audit"), (F.length("c.tail") * INSERT).alias("more"))
    picked = picked.withColumn("cost", F.col("cost") + F.col("more")).drop("more")
    # the audit of a part stands on its first row
    rows = rows.alias("r").join(
        picked.alias("p"),
        F.col("r.conv_id").eqNullSafe(F.col("p.conv_id")) & (F.col("r.pid") == F.col("p.pid")) & (F.col("r.seq") == F.col("p.seq")),
        "left",
    ).select("r.*", "p.cost", "p.audit")
    out_schema = StructType([key, *result])
    names = ["conv_id", "turn", "role", "text", "mark", "again", "cost", "audit"]

    def stream(batches):
        fields = arrow_types(out_schema)
        now, made, cost, audits, ops, any_row = None, None, 0, [], iter(""), False

        def finished():
            for op in ops:
                made.edit(op)
            line = (now, *made.row(cost, "".join(audits)))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(line, fields)], names=out_schema.names)

        for conv, turn, role, text, mark, again, part_cost, audit in in_order(batches, names, "text"):
            if not any_row or conv != now:
                if any_row:
                    yield finished()
                now, made, cost, audits, ops, any_row = conv, Repaired(), 0, [], iter(""), True
            if audit is not None:
                for op in ops:
                    made.edit(op)
                ops, cost = iter(audit), cost + part_cost
                audits.append(audit)
            if mark & DROPPED:
                continue
            made.count(turn, role, mark, again)
            for op in ops:
                made.edit(op, role, text)
                if op != "I":
                    break
        if any_row:
            yield finished()

    place = ["conv_id", "pid", "seq"]
    return rows.repartition("conv_id").sortWithinPartitions(*place).mapInArrow(stream, out_schema)
