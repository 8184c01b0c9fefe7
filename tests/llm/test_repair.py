"""Conversation repair: alignments against exhaustive search, damage and repair against a plain loop."""

import hashlib
import random
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from leadspark.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def exhaustive(symbols):
    """The least (cost, audit) over every sequence of edits, by states of the grammar."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @lru_cache(None)
    def best(i, state, inserted):
        ways = [(0, "")] if i == len(symbols) and state in ("", "a") else []
        for kind, then in after[state].items():
            if kind != "s" and inserted < 3:
                c, a = best(i, then, inserted + 1)
                ways.append((c + 2, "I" + a))
        if i < len(symbols):
            c, a = best(i + 1, state, 0)
            ways.append((c + 3, "D" + a))
            sign = symbols[i]
            for kind, then in after[state].items() if sign != "x" else ():
                c, a = best(i + 1, then, 0)
                c += sign.isupper()
                if sign.lower() == kind:
                    ways.append((c, "K" + a))
                if kind != "s":
                    ways.append((c + 2, "R" + a))
        return min(ways, default=(10**9, ""))

    return best(0, "", 0)


@pytest.mark.parametrize("piece", [2, 5, 32])
def test_alignment_is_the_cheapest_and_least(monkeypatch, piece):
    monkeypatch.setattr(repair, "PIECE", piece)
    repair.repair.cache_clear(), repair.spans.cache_clear()
    rng = random.Random(piece)
    for k in range(400):
        symbols = "".join(rng.choices("suaouaUASOx", k=k % 13))
        assert repair.repair(symbols) == exhaustive(symbols), symbols
    repair.repair.cache_clear(), repair.spans.cache_clear()


def test_a_bound_only_cuts_what_costs_more():
    assert repair.align("uua", "ua", 3, True) == (3, "DKK") and repair.align("uua", "ua", 2, True) is None
    assert repair.align("u", "ua", 2, False) is None and repair.align("u", "ua", 2, True) == (2, "KI")


def plain(rows):
    """conv_id -> result, by one loop per conversation."""
    groups = {}
    for conv, turn, role, text in rows:
        out = groups.setdefault(conv, [])
        show = lambda v: " " if v is None else str(v)
        fault = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if fault == 1:
            text = ""
        if fault == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        if fault == 4:
            role = "user"
        out += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    result = {}
    for conv, items in groups.items():
        items.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{r[1]}:{r[2]}".encode()).hexdigest()))
        seen, signs, counts = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in items:
            rest = text.rstrip(SPACE)
            flaw = "blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else ""
            seen.add((role, text))
            if flaw:
                counts[flaw] += 1
            sign = role[:1] if role[:1] in ("s", "u", "a") else "o"
            signs += "x" if flaw in ("blank", "duplicate") else sign.upper() if flaw else sign
        cost, audit = exhaustive(signs)
        left, lines = iter(items), []
        for op in audit:
            role, text = ("", "") if op == "I" else next(left)[1:]
            if op in "IR":
                role = "assistant" if lines and lines[-1][0][:1] == "u" else "user"
            if op != "D":
                lines.append((role, text))
        turns = {r[0] for r in items if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(items, items[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        result[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest)
    return result


def some_rows(seed):
    rng = random.Random(seed)
    texts = ["Yes.", "No?", "well", "", " \t", "naïve !\n", None, "日本。", "Ends here.\x0b"]
    roles = ["user", "assistant", "system", "tool", None, "", "User"]
    rows = []
    for conv in [None, *range(40)]:
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(roles) if rng.random() < 0.2 else ("user", "assistant")[turn % 2]
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 3]), role, rng.choice(texts)))
    rows += rows[:5] * 2 + [(50, t, "user", "again." if t % 3 else f"{t}") for t in range(70)] + [(51, 10**6, "user", "x" * 200_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("partitions, buffer", [(1, 1 << 20), (9, 1 << 20), (3, 300)])
def test_equals_a_plain_loop(spark, partitions, buffer):
    rows = some_rows(partitions)
    want, old = plain(rows), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, SCHEMA).withColumn("cost", F.lit("clash")).withColumn("pid", F.lit(1)).withColumn("audit", F.lit(2.0))
        got = repair.repaired(df.repartition(4), buffer).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(want) and {r[0]: tuple(r)[1:] for r in got} == want


def test_empty_dropped_and_other_ids(spark):
    assert repair.repaired(spark.createDataFrame([], SCHEMA)).count() == 0
    lost = next(k for k in range(1000) if zlib.crc32(f"c{k}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(f"c{lost}", 0, "user", "Gone.")], "conv_id string, turn int, role string, text string")
    assert [tuple(r) for r in repair.repaired(df).collect()] == [(f"c{lost}", 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
