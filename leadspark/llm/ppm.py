"""Language-model scoring by prediction by partial matching over bytes.

A trie of byte contexts up to ORDER holds how often each symbol followed. A symbol is
coded in the longest context known; one that never followed there costs an escape to
the next shorter context, in which the symbols of the longer one are excluded. Escapes
weigh as many counts as the context has distinct symbols. Symbol END (256) ends a text
and stands before its start.

The counts stay in Spark, all of them. What a symbol costs depends on its longest gram
alone, so each distinct gram is valued once by joins over the orders; texts add up the
values of their grams, the frequent ones from a broadcast cache and the others by a join.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspark.llm.common import Scratch, fold, portions, raw

END = 256
SYMBOLS = 257
BITS = np.uint64(9)
ORDER = 5
#: Grams whose values are sent to the executors, the most frequent ones; all others are
#: joined by a shuffle.
MAX_ENTRIES = 2_000_000
#: Symbols whose grams are sorted and counted at a time.
SORTED = 1 << 23
#: Words whose counts are sent to the executors; all others are joined by a shuffle.
TOP_WORDS = 150_000
HELD_FOLDS, HELD = 7, 2
FLUSH = 300_000
LN10 = math.log(10)


def lowered(data: bytes) -> bytes:
    return data.lower()


def symbols(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stream, positions, owners): all texts in a row, each after `order` END symbols
    and closed by one; positions are those of the symbols to be coded."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes + 1 + order)
    stream = np.full(int(ends[-1]) if len(ends) else 0, END, np.uint64)
    coded = np.ones(len(stream), bool)
    starts = ends - sizes - 1
    for k in range(order):
        coded[starts - order + k] = False
    inner = coded.copy()
    inner[ends - 1] = False
    stream[inner] = np.frombuffer(b"".join(texts), np.uint8)
    return stream, np.flatnonzero(coded), np.repeat(np.arange(len(texts)), sizes + 1)


def grams(stream: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """The last order + 1 symbols up to each position, packed; the symbol is lowest."""
    code = stream.copy()
    for k in range(1, order + 1):
        code[k:] |= stream[:-k] << (BITS * np.uint64(k))
    return code[at]


def low(code: np.ndarray, n: int) -> np.ndarray:
    """The last n symbols of packed symbols."""
    return code & np.uint64((1 << (9 * n)) - 1)


class Table:
    """Positions of sorted distinct keys, found by a directory on their hash."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys)).bit_length())
        slot = self.slot(keys)
        self.order = np.argsort(slot, kind="stable").astype(np.int32)
        self.keys = keys[self.order]
        self.starts = np.searchsorted(slot[self.order], np.arange((1 << self.bits) + 1)).astype(np.int32)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position in the table's own order of each key, -1 where it is missing."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        slot = self.slot(keys).astype(np.int64)
        at = self.starts[slot]
        # the first key of a slot; a later slot's key, met where the slot is empty, is not equal
        out = np.where(self.keys[np.minimum(at, len(self.keys) - 1)] == keys, at, np.int32(-1))
        live = np.flatnonzero(out < 0)
        at, end = at[live] + 1, self.starts[slot[live] + 1]
        go = at < end
        live, at, end = live[go], at[go], end[go]
        while len(live):
            hit = self.keys[at] == keys[live]
            out[live[hit]] = at[hit]
            at += 1
            go = ~hit & (at < end)
            live, at, end = live[go], at[go], end[go]
        return out


class Trie:
    """Counts of contexts by order, with all logarithms that scoring needs.

    `levels[j]` is (packed symbols, counts) of all contexts of length j with their next
    symbol, and every level's suffixes are in the level below.
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.order = len(levels) - 1
        self.grams, self.contexts = [], []
        self.own, self.count = [], []  # log10 of p in the longest context; of the count
        self.escape_own, self.escape_after, self.after = [], [], []
        below = None
        for j, (codes, counts) in enumerate(levels):
            sort = np.argsort(codes)
            codes, counts = codes[sort], counts[sort].astype(np.float64)
            contexts, first = np.unique(codes >> BITS, return_index=True)
            total = np.add.reduceat(counts, first) if len(first) else np.zeros(0)
            kinds = np.diff(np.append(first, len(codes))).astype(np.float64)
            owner = np.repeat(np.arange(len(first)), kinds.astype(np.int64))
            gram, context = Table(codes), Table(contexts)
            self.grams.append(gram)
            self.contexts.append(context)
            self.own.append(np.log10(counts / (total + kinds)[owner]).astype(np.float32)[gram.order])
            self.count.append(np.log10(counts).astype(np.float32)[gram.order])
            self.escape_own.append(np.log10(kinds / (total + kinds)).astype(np.float32)[context.order])
            if j:  # what is left in the suffix context once this context's symbols are excluded
                codes_below, counts_below, contexts_below, total_below, kinds_below = below
                at = np.searchsorted(codes_below, low(codes, j))
                excluded = np.add.reduceat(counts_below[at], first) if len(first) else np.zeros(0)
                parent = np.searchsorted(contexts_below, low(contexts, j - 1))
                left, fresh = total_below[parent] - excluded, kinds_below[parent] - kinds
                weight = left + fresh
                with np.errstate(divide="ignore", invalid="ignore"):
                    after = np.where(weight > 0, np.log10(weight), 0)
                    escape = np.where(weight > 0, np.log10(fresh) - after, 0)
                self.after.append(after.astype(np.float32)[context.order])
                self.escape_after.append(escape.astype(np.float32)[context.order])
            else:
                self.after.append(None)
                self.escape_after.append(None)
                self.rest = math.log10(SYMBOLS - len(codes)) if len(codes) < SYMBOLS else 0.0
            below = codes, counts, contexts, total, kinds
        for t in (*self.grams, *self.contexts):
            del t.order

    def logs(self, code: np.ndarray) -> np.ndarray:
        """log10 probability of each packed context and symbol."""
        out = np.zeros(len(code))
        live = np.arange(len(code))
        came = np.full(len(code), -1, np.int32)  # the context escaped from, one order up
        for j in range(self.order, -1, -1):
            here = code[live]
            spot = self.grams[j].find(low(here, j + 1))
            seen = spot >= 0
            fresh = came < 0
            whole = seen & fresh
            out[live[whole]] += self.own[j][spot[whole]]
            part = seen & ~fresh
            if part.any():
                out[live[part]] += self.count[j][spot[part]] - self.after[j + 1][came[part]]
            miss = ~seen
            live, came, here = live[miss], came[miss], here[miss]
            if not len(live):
                return out
            node = self.contexts[j].find(low(here >> BITS, j) if j else np.zeros(len(here), np.uint64))
            known, fresh = node >= 0, came < 0
            first = known & fresh
            out[live[first]] += self.escape_own[j][node[first]]
            later = known & ~fresh
            if later.any():
                out[live[later]] += self.escape_after[j + 1][came[later]]
            came = node
        out[live] -= self.rest
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text and its end; long batches are coded in slices."""
        stream, at, owner = symbols(texts, self.order)
        code = grams(stream, at, self.order)
        out = np.zeros(len(texts))
        for a in range(0, len(code), 1 << 20):
            out += np.bincount(owner[a : a + (1 << 20)], weights=self.logs(code[a : a + (1 << 20)]), minlength=len(texts))
        return out


class Adaptive:
    """The same model learned while it codes one text: a trie that starts empty."""

    def __init__(self, order: int = ORDER):
        self.order = order
        self.nodes: dict[tuple[int, ...], dict[int, int]] = {}

    def log(self, context: tuple[int, ...], symbol: int) -> float:
        out, excluded = 0.0, frozenset()
        for j in range(self.order, -1, -1):
            node = self.nodes.get(context[self.order - j :])
            if not node:
                continue
            left = {s: c for s, c in node.items() if s not in excluded}
            if not left:
                continue
            weight = sum(left.values()) + len(left)
            if symbol in left:
                return out + math.log10(left[symbol] / weight)
            out += math.log10(len(left) / weight)
            excluded = node.keys()
        return out - math.log10(SYMBOLS - len(excluded))

    def learn(self, context: tuple[int, ...], symbol: int) -> None:
        for j in range(self.order + 1):
            node = self.nodes.setdefault(context[self.order - j :], {})
            node[symbol] = node.get(symbol, 0) + 1

    def score(self, text: bytes, learn: bool = True) -> float:
        context, out = (END,) * self.order, 0.0
        for symbol in [*text, END]:
            out += self.log(context, symbol)
            if learn:
                self.learn(context, symbol)
            context = (*context, symbol)[1:]
        return out


def count_grams(docs: DataFrame, order: int) -> DataFrame:
    """(gram, times, n) over the column `text` (bytes): partial counts per task, then a sum.

    times counts all rows, n those that are learned from: the column `held_out`, where
    there is one, is false in them.
    """
    held_out = F.col("held_out") if "held_out" in docs.columns else F.lit(False)

    def run(batches):
        held: list[np.ndarray] = []
        for batch in batches:
            for part in portions(batch, 0):
                stream, at, owner = symbols([lowered(t) for t in part.column(0).to_pylist()], order)
                out = part.column(1).to_numpy(zero_copy_only=False).astype(np.uint64)
                held.append(grams(stream, at, order) << np.uint64(1) | out[owner])
                if sum(map(len, held)) > SORTED:
                    yield counted(held)
                    held = []
        if held:
            yield counted(held)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        """`held` has a gram and, in the lowest bit, whether it is of a held-out text."""
        marked = np.concatenate(held)
        marked.sort()
        gram, out = (marked >> np.uint64(1)).view(np.int64), (marked & np.uint64(1)).view(np.int64)
        first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
        times = np.diff(np.append(first, len(gram)))
        learned = times - np.add.reduceat(out, first)
        return pa.RecordBatch.from_arrays([pa.array(gram[first]), pa.array(times), pa.array(learned)], ["gram", "times", "n"])

    found = docs.select("text", held_out.alias("held_out")).mapInArrow(run, "gram long, times long, n long")
    return found.groupBy("gram").agg(F.sum("times").alias("times"), F.sum("n").alias("n"))


def tail(gram: str, n: int) -> Column:
    """The last n symbols of packed symbols."""
    return F.col(gram).bitwiseAND(F.lit((1 << (9 * n)) - 1))


def value_grams(longest: DataFrame, scratch: Scratch, order: int) -> DataFrame:
    """(gram, times, value): log10 probability of the last symbol of each distinct gram.

    `longest` is the written result of `count_grams`. From order 0 up, a gram learns from
    its suffix one order below what its symbol costs there, at first hand and once this
    order's symbols are excluded. A suffix or context has at most SYMBOLS grams, so no
    key of a join or window is large, and no count is left out.
    """
    levels = [longest.select("gram", "n")]
    for j in range(order - 1, -1, -1):
        shorter = levels[0].groupBy(tail("gram", j + 1).alias("gram")).agg(F.sum("n").alias("n"))
        levels.insert(0, scratch.write(shorter))
    below = None
    for j, level in enumerate(levels):
        if j:
            level = level.withColumn("suffix", tail("gram", j)).join(below, "suffix")
        else:
            level = level.select("*", *[F.lit(0).cast("long").alias(c) for c in ("n_below", "total_below", "kinds_below")])
        context = Window.partitionBy(F.shiftright("gram", 9))
        seen = F.col("n") > 0
        level = level.withColumns({
            "total": F.sum("n").over(context),
            "kinds": F.sum(seen.cast("long")).over(context),
            "excluded": F.sum(F.when(seen, F.col("n_below")).otherwise(F.lit(0))).over(context),
        })
        weight = F.col("total") + F.col("kinds")
        own = F.log10(F.col("n") / weight)
        if j:  # what is left in the suffix context once this context's symbols are excluded
            fresh = F.col("kinds_below") - F.col("kinds")
            left = F.col("total_below") - F.col("excluded") + fresh
            after = F.when(left > 0, F.log10(left)).otherwise(F.lit(0.0))
            escape = F.when(left > 0, F.log10(fresh / left)).otherwise(F.lit(0.0))
            later = F.when(F.col("n_below") > 0, F.log10("n_below") - after).otherwise(escape + F.col("later_below"))
            unknown = F.col("first_below")
        else:
            unknown = later = -F.log10(F.greatest(F.lit(SYMBOLS) - F.col("kinds"), F.lit(1)))
        level = level.withColumn("later", later)
        first = F.when(F.col("total") == 0, unknown).when(seen, own).otherwise(F.log10(F.col("kinds") / weight) + F.col("later"))
        level = level.withColumn("first", first)
        kept = ("n", "total", "kinds", "first", "later")
        below = level.select(F.col("gram").alias("suffix"), *[F.col(c).alias(f"{c}_below") for c in kept])
    return longest.select("gram", "times").join(level.select("gram", F.col("first").alias("value")), "gram")


def within(counts: DataFrame, column: str, most: int) -> int:
    """The smallest power of two that at most `most` rows reach in a column of counts."""
    spread = counts.groupBy(F.floor(F.log2(F.col(column))).cast("int").alias("power")).count().collect()
    sizes = {r["power"]: r["count"] for r in spread}
    least = 0
    while sum(c for p, c in sizes.items() if p >= least) > most:
        least += 1
    return 1 << least


class Values:
    """Values of the frequent grams; what texts need besides is returned as counts."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        self.table = Table(codes)
        self.values = values[self.table.order]
        del self.table.order

    def scores(self, texts: list[bytes], order: int) -> tuple[np.ndarray, pa.Array]:
        """(sum of the known values, distinct other grams with counts) of each text."""
        stream, at, owner = symbols(texts, order)
        code = grams(stream, at, order)
        out, codes, owners = np.zeros(len(texts)), [], []
        for a in range(0, len(code), 1 << 20):
            here, whose = code[a : a + (1 << 20)], owner[a : a + (1 << 20)]
            spot = self.table.find(here)
            known = spot >= 0
            out += np.bincount(whose[known], weights=self.values[spot[known]], minlength=len(texts))
            codes.append(here[~known])
            owners.append(whose[~known])
        codes = np.concatenate([np.zeros(0, np.uint64), *codes])
        owners = np.concatenate([np.zeros(0, np.int64), *owners])
        sort = np.argsort(codes)
        # few owners fit 16 bits, which are sorted by radix
        sort = sort[np.argsort(owners[sort].astype(np.uint16 if len(texts) <= 1 << 16 else np.int64), kind="stable")]
        codes, owners = codes[sort], owners[sort]
        first = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (owners[1:] != owners[:-1]))[: len(codes)])
        n = np.diff(np.append(first, len(codes)))
        rare = pa.StructArray.from_arrays([pa.array(codes[first].view(np.int64)), pa.array(n.astype(np.int64))], ["gram", "n"])
        starts = np.searchsorted(owners[first], np.arange(len(texts) + 1))
        return out, pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), rare)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of the words of the column `text` (bytes), A-Z lowered."""

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for part in portions(batch, 0):
                for text in part.column(0).to_pylist():
                    held.update(lowered(text).split())
                if len(held) > FLUSH:
                    yield counted(held)
                    held = Counter()
        yield counted(held)

    def counted(held: Counter) -> pa.RecordBatch:
        cols = [pa.array(list(held.keys()), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(cols, ["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Both models learn from all rows whose crc32 of the id as text modulo 7 is not 2 (a
    null id is not held out); texts have A-Z lowered, null counts as empty. score is the
    model's log10 probability of the text's bytes and its end. base_score sums
    log10((c + 1) / (N + V + 1)) over words and one end token; n_known counts the tokens
    seen in training; train_tokens is N. Repeated rows are learned and scored each. With
    no row to learn from, every symbol is equally likely.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ppm")
    held = fold("doc_id", HELD_FOLDS) == HELD
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), raw().alias("text"))
    training = rows.filter(~F.col("held_out"))
    words = scratch.write(count_words(training))
    counted = words.agg(F.count(F.lit(1)), F.sum("n")).first()
    texts = training.count()
    n_all, n_kinds = (counted[1] or 0) + texts, counted[0] + (texts > 0)
    top = words.orderBy(F.desc("n"), "word").limit(TOP_WORDS).toArrow()
    logs = np.log10(top.column(1).to_numpy() + 1.0).tolist()
    frequent = dict(zip(top.column(0).cast(pa.binary()).to_pylist(), logs))
    valued = scratch.write(value_grams(scratch.write(count_grams(rows, order)), scratch, order))
    least = within(valued, "times", MAX_ENTRIES)
    often = valued.filter(F.col("times") >= least).select("gram", "value").toArrow()
    cache = Values(often.column(0).to_numpy().view(np.uint64), often.column(1).to_numpy())
    shared = spark.sparkContext.broadcast((cache, frequent))
    per_token = math.log10(n_all + n_kinds + 1)

    def run(batches):
        cache, gain = shared.value
        for batch in batches:
            for part in portions(batch, 2):
                lines = [lowered(t) for t in part.column(2).to_pylist()]
                total, known, base = [], [], []
                words, times, ends = [], [], [0]
                for text in lines:
                    found = text.split()
                    seen = list(filter(None, map(gain.get, found)))  # no gain is 0
                    total.append(len(found) + 1)
                    known.append(len(seen) + (texts > 0))
                    base.append(math.fsum(seen) + math.log10(texts + 1) - (len(found) + 1) * per_token)
                    more = Counter([w for w in found if w not in gain]) if len(seen) < len(found) else {}
                    words.extend(more.keys())
                    times.extend(more.values())
                    ends.append(len(words))
                rare = pa.StructArray.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())], ["word", "n"])
                score, seldom = cache.scores(lines, order)
                cols = [
                    part.column(0), part.column(1), pa.array(total, pa.int64()), pa.array(known, pa.int64()),
                    pa.array(base, pa.float64()), pa.array(score),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rare), seldom,
                ]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "known", "base", "score", "rare", "seldom"])

    kind = (
        "doc_id long, held_out boolean, n_tokens long, known long, base double, score double, "
        "rare array<struct<word: string, n: long>>, seldom array<struct<gram: long, n: long>>"
    )
    found = rows.mapInArrow(run, kind).withColumn("row", F.monotonically_increasing_id())
    found = scratch.write(found)
    rare = (
        found.select("row", F.explode("rare").alias("r"))
        .select("row", "r.word", F.col("r.n").alias("times"))
        .join(words, "word")
        .select("row", F.col("times").alias("more"), (F.col("times") * F.log10(F.col("n") + 1)).alias("gain"), F.lit(0.0).alias("value"))
    )
    seldom = (
        found.select("row", F.explode("seldom").alias("g"))
        .select("row", "g.gram", "g.n")
        .join(valued.filter(F.col("times") < least).select("gram", "value"), "gram")
        .select("row", F.lit(0).cast("long").alias("more"), F.lit(0.0).alias("gain"), (F.col("n") * F.col("value")).alias("value"))
    )
    more = rare.unionByName(seldom).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("more", "gain", "value")])
    out = found.drop("rare", "seldom").join(more, "row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("gain", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("value", F.lit(0.0))).alias("score"),
    )
