"""Call budgets: admission under a day and a month cap, settlement, and state.

Reserve events ask for calls, settle events hand back what was not spent. The
month is a UTC month, the day is the calendar day where the quota resets.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions.clock import day_key, month_key, next_day_reset, next_month_reset
from ..sources.stage import staged
from .skew import ROWS_PER_TASK


def with_calendar(events: DataFrame) -> DataFrame:
    return events.select(
        "*", month_key(F.col("ts")).alias("month"), day_key(F.col("ts")).alias("day")
    )


def budget_grant(
    requests: DataFrame,
    month_cap: int = V.MONTH_CAP,
    day_cap: int = V.DAY_CAP,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """What each request is granted when requests are admitted in time order."""
    none = F.lit(0).cast("long")
    asked = requests.select(
        "account", "event_id", "ts", F.lit("reserve").alias("kind"), "want", none.alias("reserved"), none.alias("actual")
    )
    steps = _steps(asked, month_cap, day_cap, rows_per_task)
    return steps.select(
        "account", "event_id", "ts", F.col("want").cast(requests.schema["want"].dataType).alias("want"), "month", "day",
        "granted", "limited_by", "used",
        F.greatest(F.lit(month_cap) - F.col("used"), F.lit(0)).alias("remaining"),
        "day_used",
        F.greatest(F.lit(day_cap) - F.col("day_used"), F.lit(0)).alias("day_remaining"),
        next_month_reset(F.col("ts")).alias("resets_at"),
        next_day_reset(F.col("ts")).alias("day_resets_at"),
    )


def budget_settle(
    events: DataFrame,
    month_cap: int = V.MONTH_CAP,
    day_cap: int = V.DAY_CAP,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """The ledger after every reserve and settle event, per account in time order.

    Events are put in order of account and time and cut into ranges of about
    `rows_per_task` rows. Accounts that lie inside a range are finished there. The first
    and the last account of a range may go on next door: each of their parts is reduced
    to the functions it applies to whatever ledger it starts from (`Pieces`), the
    functions of an account are put one after the other, at most a few per range and
    month, and then every part is worked out from its true start.
    """
    return _steps(events, month_cap, day_cap, rows_per_task).drop("want")


# ---------------------------------------------------------------- one account as functions
#
# Inside a month, and from the first reserve of a day to its last event, the ledger is
# moved by shifts and clamps only. Let u be the calls used in the month, d those of the
# day, and e = u - d what was used before the day. A reserve of w calls and a settlement of
# c calls do
#
#     reserve  u' = min(u + w, e + day_cap, month_cap)   e' = e
#     settle   u' = max(0, u - c)                        e' = max(0, min(e, u - c))
#
# and a new day sets e = u. Without the 0 both are least values of (u, e, 1) plus numbers,
# and such maps stay of that kind when one follows the other. The 0 adds one pair of
# numbers: the ledger is never below the one that started empty, equals it from the first
# time it reaches 0, and equals the map without 0 until then. So any run of events is
#
#     u' = max(L1, min(u + p1, e + q1, r1))     e' = max(L2, min(u + p2, e + q2, r2))
#
# for eight numbers, whatever the caps are. A day that goes on into a new month starts
# with u = 0 below d; there u and d, and the two caps, change places.

NUMBERS = ["p1", "q1", "r1", "p2", "q2", "r2", "l1", "l2"]
#: How a piece starts: as the ledger was left; empty; with the day going on into a new
#: month; or with that day over.
GOES_ON, EMPTY, NEW_MONTH, DAY_OVER = range(4)


def after(f: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The functions that apply f and then g; columns are NUMBERS."""
    p1, q1, r1, p2, q2, r2, l1, l2 = f
    out = np.empty_like(f)
    for row, (p, q, r, low, floor) in enumerate(((g[0], g[1], g[2], 6, g[6]), (g[3], g[4], g[5], 7, g[7]))):
        at = 3 * row
        out[at] = np.minimum(p + p1, q + p2)
        out[at + 1] = np.minimum(p + q1, q + q2)
        out[at + 2] = np.minimum(np.minimum(p + r1, q + r2), r)
        out[low] = np.maximum(floor, np.minimum(np.minimum(p + l1, q + l2), r))
    return out


def value(f: np.ndarray, x1, x2) -> tuple[np.ndarray, np.ndarray]:
    p1, q1, r1, p2, q2, r2, l1, l2 = f
    return (
        np.maximum(l1, np.minimum(np.minimum(x1 + p1, x2 + q1), r1)),
        np.maximum(l2, np.minimum(np.minimum(x1 + p2, x2 + q2), r2)),
    )


@dataclass
class Carry:
    """How an account was left: labels of its last reserve, counts, and whether that day began in the month before."""

    month: str | None = None
    day: str | None = None
    over: bool = False
    used: int = 0
    day_used: int = 0


class Pieces:
    """Ordered events of accounts, cut into pieces that are one function each.

    `events` has account, kind, want, reserved, actual, month and day, sorted by account
    and time. `carry` says how the first account was left; its counts are not needed until
    `steps`. All work is on whole arrays: functions of all beginnings of all pieces are
    made by doubling.
    """

    def __init__(self, events: pd.DataFrame, month_cap: int, day_cap: int, carry: Carry | None = None):
        self.month_cap, self.day_cap, self.carry = month_cap, day_cap, carry or Carry()
        n = len(events)
        at = np.arange(n)
        account = pd.factorize(events["account"], use_na_sentinel=False)[0]
        month, day = (
            pd.factorize(np.append(events[c].to_numpy(object), [getattr(self.carry, c) or ""]), use_na_sentinel=False)[0] for c in ("month", "day")
        )
        (month, month0), (day, day0) = (month[:-1], month[-1]), (day[:-1], day[-1])
        self.reserve = events["kind"].to_numpy(object) == "reserve"
        self.want = np.maximum(events["want"].fillna(0).to_numpy(np.float64), 0)
        actual = np.maximum(events["actual"].fillna(0).to_numpy(np.float64), 0)
        credit = np.maximum(events["reserved"].fillna(0).to_numpy(np.float64) - actual, 0)

        first = np.append(True, account[1:] != account[:-1]) if n else np.zeros(0, bool)
        self.begin = np.maximum.accumulate(np.where(first, at, 0)) if n else at
        fresh = self.begin > 0 if self.carry.month is not None else np.ones(n, bool)

        def latest(marked: np.ndarray, before: bool) -> np.ndarray:
            """Place of the last marked event of the account, up to or before each event; -1 if there is none."""
            found = np.maximum.accumulate(np.where(marked, at, -1)) if n else at
            found = np.append(-1, found[:-1]) if before and n else found
            return np.where(found >= self.begin, found, -1)

        last = latest(self.reserve, True)
        known = last >= 0
        label_month = np.where(known, month[last], np.where(fresh, -1, month0)) if n else month
        label_day = np.where(known, day[last], np.where(fresh, -1, day0)) if n else day
        self.same_month, self.same_day = label_month == month, label_day == day
        change = self.reserve & ~self.same_month
        over = change & self.same_day
        turn = latest(change, False)
        swapped = np.where(turn >= 0, over[turn] & (day == day[turn]), ~fresh & self.carry.over & (day == day0)) if n else first
        left = np.append(False, swapped[:-1]) & ~swapped & ~first if n else first
        if n and not fresh[0] and self.carry.over and not swapped[0] and not change[0]:
            left[0] = True
        start = first | change | left
        self.swapped, self.start = swapped, start
        self.piece = np.cumsum(start) - 1
        self.first = np.flatnonzero(start)
        self.final = np.append(self.first[1:], n) - 1 if n else self.first
        kind = np.where(over, NEW_MONTH, np.where(change, EMPTY, np.where(left, DAY_OVER, np.where(fresh, EMPTY, GOES_ON))))
        self.kind = kind[self.first]
        #: Events that may still move the day's count, up to which it is known.
        self.live = self.reserve | self.same_day
        self.last_live = latest(self.live, False)
        self.functions = self._beginnings(self._single(credit))
        self.end = Carry()
        if n:
            j = latest(self.reserve, False)[-1]
            if j >= 0:
                mine = turn[j] >= 0
                still = over[turn[j]] and day[j] == day[turn[j]] if mine else not fresh[-1] and self.carry.over and day[j] == day0
                self.end = Carry(events["month"].iloc[j], events["day"].iloc[j], bool(still))
            elif not fresh[-1]:
                self.end = Carry(self.carry.month, self.carry.day, self.carry.over)

    def _single(self, credit: np.ndarray) -> np.ndarray:
        """One column of NUMBERS per event."""
        n, inf = len(credit), np.inf
        f = np.empty((8, n))
        f[0], f[1], f[2], f[3], f[4], f[5], f[6], f[7] = 0, inf, inf, inf, 0, inf, 0, 0
        own = np.where(self.swapped, self.day_cap, self.month_cap)
        other = np.where(self.swapped, self.month_cap, self.day_cap)
        r = self.reserve
        f[0, r], f[1, r], f[2, r] = self.want[r], other[r], own[r]
        new_day = r & ~self.same_day & self.same_month
        f[0, new_day], f[1, new_day] = np.minimum(self.want, self.day_cap)[new_day], inf
        f[3, new_day], f[4, new_day] = 0, inf
        s = ~r & self.same_month
        f[0, s] = f[3, s] = -credit[s]
        f[6] = np.maximum(0, np.minimum(np.minimum(f[0], f[1]), f[2]))
        f[7] = np.maximum(0, np.minimum(np.minimum(f[3], f[4]), f[5]))
        return f

    def _beginnings(self, f: np.ndarray) -> np.ndarray:
        """Per event the function of its piece up to and with it."""
        place = np.arange(f.shape[1]) - self.first[self.piece] if f.shape[1] else np.zeros(0, int)
        k = 1
        while k <= place.max(initial=0):
            late = np.flatnonzero(place >= k)
            f[:, late] = after(f[:, late - k], f[:, late])
            k *= 2
        return f

    def starts(self, used, day_used, kind: np.ndarray, swapped: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start of pieces whose account stands at (used, day_used)."""
        x1 = np.where(kind == EMPTY, 0, np.where(swapped, day_used, used))
        x2 = np.where(swapped, np.maximum(day_used - used, 0), np.maximum(used - day_used, 0))
        x2 = np.where(kind == NEW_MONTH, day_used, np.where(kind == DAY_OVER, used, np.where(kind == EMPTY, 0, x2)))
        return x1.astype(np.float64), x2.astype(np.float64)

    @staticmethod
    def counts(x1, x2, swapped) -> tuple[np.ndarray, np.ndarray]:
        return np.where(swapped, x1 - x2, x1), np.where(swapped, x1, x1 - x2)

    def steps(self, used: int, day_used: int) -> dict[str, np.ndarray]:
        """granted, limited_by, used and day_used after every event; the first account starts at these counts."""
        n, pieces = len(self.reserve), len(self.first)
        x1, x2 = np.zeros(pieces), np.zeros(pieces)
        swapped = self.swapped[self.first] if pieces else np.zeros(0, bool)
        opens = self.begin[self.first] == self.first if pieces else swapped
        rank = np.arange(pieces) - np.maximum.accumulate(np.where(opens, np.arange(pieces), 0)) if pieces else np.zeros(0, int)
        u, d = np.zeros(pieces), np.zeros(pieces)
        for k in range(rank.max(initial=-1) + 1):
            now = np.flatnonzero(rank == k)
            if k:
                u0, d0 = u[now - 1], d[now - 1]
            else:
                u0, d0 = np.where(now == 0, used, 0), np.where(now == 0, day_used, 0)
            x1[now], x2[now] = self.starts(u0, d0, self.kind[now], swapped[now])
            end = value(self.functions[:, self.final[now]], x1[now], x2[now])
            u[now], d[now] = self.counts(*end, swapped[now])
        after_u, after_d = self.counts(*value(self.functions, x1[self.piece], x2[self.piece]), self.swapped)
        after_d = np.where(self.last_live >= 0, after_d[self.last_live], np.where(self.begin == 0, day_used, 0)) if n else after_d
        opened = np.arange(n) == self.begin
        before_u = np.where(opened, np.where(self.begin == 0, used, 0), np.append(0, after_u[:-1]))
        before_d = np.where(opened, np.where(self.begin == 0, day_used, 0), np.append(0, after_d[:-1]))
        month_left = np.maximum(self.month_cap - np.where(self.same_month, before_u, 0), 0)
        day_left = np.maximum(self.day_cap - np.where(self.same_day, before_d, 0), 0)
        granted = np.minimum(self.want, np.minimum(month_left, day_left))
        short = self.reserve & (granted < self.want)
        return {
            "granted": np.where(self.reserve, granted, np.nan),
            "limited_by": np.where(short, np.where(day_left <= month_left, "day", "month"), None),
            "used": after_u, "day_used": after_d,
        }


def played(events: pd.DataFrame, month_cap: int, day_cap: int, carry: Carry | None = None) -> tuple[pd.DataFrame, Carry]:
    """Ordered events beside what they did, and how their last account was left."""
    pieces = Pieces(events, month_cap, day_cap, carry)
    found = pieces.steps(pieces.carry.used, pieces.carry.day_used)
    out = events[["account", "event_id", "ts", "kind", "want", "month", "day"]].assign(
        granted=pd.array(found["granted"], dtype="Float64").astype("Int64") if len(events) else pd.array([], dtype="Int64"),
        limited_by=found["limited_by"], used=found["used"].astype(np.int64), day_used=found["day_used"].astype(np.int64),
    )
    out["granted"] = out["granted"].where(pieces.reserve, pd.NA)
    if not len(events):
        return out, pieces.carry
    end = pieces.end
    end.used, end.day_used = int(found["used"][-1]), int(found["day_used"][-1])
    return out, end


# ---------------------------------------------------------------- on the cluster

STEP_SCHEMA = (
    "account string, event_id long, ts timestamp, kind string, want long, month string, day string, "
    "granted long, limited_by string, used long, day_used long"
)
_STEPS = [c.split()[0] for c in STEP_SCHEMA.split(", ")]
_RAW = ["account", "event_id", "ts", "kind", "want", "reserved", "actual", "month", "day"]
_ORDER = ["account", "ts", "event_id"]
#: Rows worked out at a time inside a range.
CHUNK = 200_000


def _steps(events: DataFrame, month_cap: int, day_cap: int, rows_per_task: int) -> DataFrame:
    spark = events.sparkSession
    numbers = [F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("want", "reserved", "actual")]
    rows = with_calendar(events).select("account", F.col("event_id").cast("long").alias("event_id"), "ts", "kind", *numbers, "month", "day")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // rows_per_task))

    def inside(batches):
        held, opened, here = [], False, TaskContext.get().partitionId()

        def edge(pdf):
            return pdf[_RAW].assign(range=here)

        def done(pdf):
            return played(pdf, month_cap, day_cap)[0]

        last = None
        for pdf in batches:
            if not len(pdf):
                continue
            held.append(pdf)
            if sum(map(len, held)) < CHUNK:
                continue
            whole = pd.concat(held, ignore_index=True)
            account = pd.factorize(whole["account"], use_na_sentinel=False)[0]
            cuts = np.flatnonzero(account[1:] != account[:-1]) + 1
            if not opened and len(cuts):
                yield edge(whole.iloc[: cuts[0]])
                opened, whole, cuts = True, whole.iloc[cuts[0] :], cuts[1:] - cuts[0]
            if opened and len(cuts):
                yield done(whole.iloc[: cuts[-1]].reset_index(drop=True))
                whole = whole.iloc[cuts[-1] :]
            elif not opened:
                yield edge(whole)
                whole = whole.iloc[:0]
            held = [whole]
        if held:
            last = pd.concat(held, ignore_index=True)
            account = pd.factorize(last["account"], use_na_sentinel=False)[0]
            cuts = np.flatnonzero(account[1:] != account[:-1]) + 1
            if not opened and len(cuts):
                yield edge(last.iloc[: cuts[0]])
                last, cuts = last.iloc[cuts[0] :], cuts[1:] - cuts[0]
            if len(cuts):
                yield done(last.iloc[: cuts[-1]].reset_index(drop=True))
                last = last.iloc[cuts[-1] :]
            yield edge(last)

    def shaped(batches):
        for pdf in inside(batches):
            missing = [c for c in [*_STEPS, "reserved", "actual", "range"] if c not in pdf]
            yield pdf.assign(**{c: pd.Series([None] * len(pdf), dtype=object, index=pdf.index) for c in missing})[
                [*_STEPS, "reserved", "actual", "range"]
            ]

    schema = f"{STEP_SCHEMA}, reserved long, actual long, range int"
    ordered = rows.repartitionByRange(ranges, *_ORDER).sortWithinPartitions(*_ORDER)
    table = staged(ordered.mapInPandas(shaped, schema), "ledger")
    done = table.filter("range IS NULL").select(*_STEPS)
    return done.unionByName(_edges(table.filter("range IS NOT NULL").select(*_RAW, "range"), month_cap, day_cap))


def _edges(rows: DataFrame, month_cap: int, day_cap: int) -> DataFrame:
    """The accounts at the edges of ranges, at most two per range, part by part."""
    reserve = F.when(F.col("kind") == "reserve", F.struct("ts", "event_id"))
    last_of_month = (F.col("kind") == "reserve") & (F.col("day") == F.date_format(F.last_day("day"), "yyyy-MM-dd")) & F.col("day").startswith(F.col("month"))
    parts = rows.groupBy("account", "range").agg(
        F.max_by(F.struct("month", "day"), reserve).alias("label"), F.collect_set(F.when(last_of_month, F.col("day"))).alias("month_ends")
    )
    carried = staged(parts.select("account", "range", "label.month", "label.day", "month_ends").groupBy("account").applyInPandas(
        _labels, "account string, range int, c_month string, c_day string, c_over boolean"
    ), "ledger-labels")
    # one row per part, at most two parts per range
    marked = rows.join(F.broadcast(carried), rows["account"].eqNullSafe(carried["account"]) & (rows["range"] == carried["range"])).select(
        *[rows[c] for c in [*_RAW, "range"]], "c_month", "c_day", "c_over"
    )

    def ordered(pdf):
        pdf = pdf.sort_values(["ts", "event_id"], kind="stable").reset_index(drop=True)
        month, day = pdf["c_month"].iloc[0], pdf["c_day"].iloc[0]
        carry = Carry(None if pd.isna(month) else month, None if pd.isna(day) else day, bool(pdf["c_over"].iloc[0]))
        return pdf, carry

    def functions(pdf):
        pdf, carry = ordered(pdf)
        pieces = Pieces(pdf, month_cap, day_cap, carry)
        ends = [*pieces.final, *([pieces.last_live[-1]] if pieces.last_live[-1] >= 0 else [])]
        out = pd.DataFrame(pieces.functions[:, ends].T, columns=NUMBERS)
        out.insert(0, "swapped", pieces.swapped[ends])
        out.insert(0, "start", pieces.kind[pieces.piece[ends]])
        out.insert(0, "piece", pieces.piece[ends])
        out.insert(0, "live", np.arange(len(ends)) >= len(pieces.final))
        out.insert(0, "range", pdf["range"].iloc[0])
        out.insert(0, "account", pdf["account"].iloc[0])
        return out

    shape = "account string, range int, live boolean, piece int, start int, swapped boolean, " + ", ".join(f"{c} double" for c in NUMBERS)
    found = marked.groupBy("account", "range").applyInPandas(functions, shape)
    starts = staged(found.groupBy("account").applyInPandas(_chained, "account string, range int, c_used long, c_day_used long"), "ledger-starts")
    begun = marked.join(F.broadcast(starts), marked["account"].eqNullSafe(starts["account"]) & (marked["range"] == starts["range"])).select(
        *[marked[c] for c in marked.columns], "c_used", "c_day_used"
    )

    def replay(pdf):
        pdf, carry = ordered(pdf)
        carry.used, carry.day_used = int(pdf["c_used"].iloc[0]), int(pdf["c_day_used"].iloc[0])
        return played(pdf, month_cap, day_cap, carry)[0]

    return begun.groupBy("account", "range").applyInPandas(replay, STEP_SCHEMA)


def _labels(parts: pd.DataFrame) -> pd.DataFrame:
    """How the labels stand where each part of one account begins."""
    out, month, day, ends = [], None, None, set()
    for _, row in parts.sort_values("range").iterrows():
        out.append((row["account"], row["range"], month, day, bool(month is not None and day in ends and not day.startswith(month))))
        if isinstance(row["month"], str):
            month, day = row["month"], row["day"]
        ends.update(row["month_ends"])
    return pd.DataFrame(out, columns=["account", "range", "c_month", "c_day", "c_over"])


def _chained(pieces: pd.DataFrame) -> pd.DataFrame:
    """The counts that each part of one account starts from, piece after piece."""
    out, used, day_used = [], 0.0, 0.0
    blank = object.__new__(Pieces)
    for part, rows in pieces.sort_values(["range", "piece", "live"]).groupby("range", sort=True):
        out.append((rows["account"].iloc[0], part, int(used), int(day_used)))
        live_day = None
        for row in rows.itertuples(index=False):
            f = np.array([[getattr(row, c)] for c in NUMBERS])
            if not row.live:
                begin = used, day_used
            x = blank.starts(np.array([begin[0]]), np.array([begin[1]]), np.array([row.start]), np.array([row.swapped]))
            u, d = Pieces.counts(*value(f, *x), np.array([row.swapped]))
            if row.live:
                live_day = float(d[0])
            else:
                used, day_used = float(u[0]), float(d[0])
        day_used = out[-1][3] if live_day is None else live_day
    return pd.DataFrame(out, columns=["account", "range", "c_used", "c_day_used"])


def budget_peek(
    steps: DataFrame, now: Column, month_cap: int = V.MONTH_CAP, day_cap: int = V.DAY_CAP
) -> DataFrame:
    """What each account has left at `now`, claiming nothing.

    `steps` is the ledger after every event; its last reserve names the calendar.
    """
    at = F.struct("ts", "event_id")
    last = steps.groupBy("account").agg(
        F.max_by(F.struct("used", "day_used"), at).alias("state"),
        F.max_by(
            F.when(F.col("kind") == "reserve", F.struct("month", "day")),
            F.when(F.col("kind") == "reserve", at),
        ).alias("label"),
    )
    same_month = F.col("label.month").eqNullSafe(month_key(now))
    same_day = F.col("label.day").eqNullSafe(day_key(now))
    used = F.when(same_month, F.col("state.used")).otherwise(0)
    day_used = F.when(same_day, F.col("state.day_used")).otherwise(0)
    remaining = F.greatest(F.lit(month_cap) - used, F.lit(0))
    day_remaining = F.greatest(F.lit(day_cap) - day_used, F.lit(0))
    return last.select(
        "account",
        used.alias("used"),
        remaining.alias("remaining"),
        day_used.alias("day_used"),
        day_remaining.alias("day_remaining"),
        next_month_reset(now).alias("resets_at"),
        next_day_reset(now).alias("day_resets_at"),
        ((remaining > 0) & (day_remaining > 0)).alias("can_search"),
    )
