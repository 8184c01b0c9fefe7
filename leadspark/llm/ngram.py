"""Document rules and perplexity bands of a modified Kneser-Ney model of byte n-grams."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspark.llm.common import Scratch, portions, raw
from leadspark.llm.ppm import within

#: Bytes of a gram; at most 7, so that gram and order fit a long.
ORDER = 5
#: Markers of a word's ends: white space, which no word holds.
BEGIN, END = b" ", b"\n"
SYMBOLS = [b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">"]
#: Entries of the model that every worker holds (16 bytes each); others are met by a join.
MAX_ENTRIES = 3_000_000
#: Words a worker remembers, in counting and in scoring.
BOOK = 400_000
PIECE = 4 << 20
#: Bands: so many quartile distances beyond the quartiles of log10 perplexity, counted in steps.
WIDTH, LEAST_DISTANCE, STEP = 3.0, 0.05, 0.001


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, of some megabytes at a time."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        if end < len(text):
            cuts = [text.rfind(bytes([c]), at, end) for c in b" \t\n\x0b\x0c\r"]
            # a word longer than a piece is kept whole
            end = max(cuts) if max(cuts) > at else min((c for c in (text.find(bytes([c]), end) for c in b" \t\n\x0b\x0c\r") if c >= 0), default=len(text))
        yield text[at:end].split()
        at = end


def key(code, size):
    return code | (size << 56)


def top_grams(words: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(grams, starts): per symbol of every word, its end included, the longest gram that ends there.

    A gram is its bytes in a long with its size in the top byte; the first grams of a word
    begin with BEGIN and are shorter.
    """
    flat = np.frombuffer(b"".join(BEGIN + w + END for w in words), np.uint8).astype(np.int64)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    ends = np.cumsum(sizes)
    place = np.arange(len(flat)) - np.repeat(ends - sizes, sizes)
    code, size = flat.copy(), np.minimum(place + 1, order)
    for k in range(1, order):
        code[k:] |= np.where(place[k:] >= k, flat[:-k] << (8 * k), 0)
    grams = key(code, size)[place > 0]
    return grams, np.concatenate([[0], np.cumsum(sizes - 1)])


def text_columns(docs: DataFrame, lang: str) -> tuple[Column, Column]:
    return F.coalesce(F.col(lang).cast("string"), F.lit("")), raw()


def gram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n): how often each longest gram stands in the words of all documents."""
    language, text = text_columns(docs, "lang")

    def run(batches):
        books: dict[str, Counter] = {}

        def out():
            for name, book in books.items():
                words = list(book)
                for k in range(0, len(words), 50_000):
                    some = words[k : k + 50_000]
                    grams, starts = top_grams(some, order)
                    times = np.repeat([book[w] for w in some], np.diff(starts))
                    found, where = np.unique(grams, return_inverse=True)
                    n = np.bincount(where, weights=times).astype(np.int64)
                    held.setdefault(name, []).append((found, n))
            books.clear()

        def merged(name, parts):
            found, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(where, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found), pa.array(n)], names=["lang", "gram", "n"])

        held: dict[str, list] = {}
        for batch in batches:
            for part in portions(batch, 1):
                for name, body in zip(part.column(0).to_pylist(), part.column(1)):
                    for words in words_of(body.as_py()):
                        books.setdefault(name, Counter()).update(words)
                if sum(map(len, books.values())) > BOOK:
                    out()
                if sum(len(p[0]) for parts in held.values() for p in parts) > 4 * BOOK:
                    for name, parts in held.items():
                        yield merged(name, parts)
                    held.clear()
        out()
        for name, parts in held.items():
            yield merged(name, parts)

    counts = docs.select(language.alias("lang"), text.alias("text")).mapInArrow(run, "lang string, gram long, n long")
    return counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def code_of(gram: str) -> Column:
    return F.col(gram).bitwiseAND((1 << 56) - 1)


def sized(code: Column, size: int) -> Column:
    return code.bitwiseOR(F.lit(size << 56)) if size else F.lit(0).cast("long")


def context(gram: str, size: int) -> Column:
    return sized(F.shiftright(code_of(gram), 8), size - 1)


def suffix(gram: str, size: int) -> Column:
    return sized(F.col(gram).bitwiseAND((1 << (8 * (size - 1))) - 1), size - 1)


def kneser_ney(counts: DataFrame, scratch: Scratch, order: int = ORDER) -> DataFrame:
    """(lang, gram, n, p, b): interpolated modified Kneser-Ney estimates in log10.

    `p` of a gram is the probability of its last byte after the others; `b` the weight that
    the gram, as a context, leaves to shorter ones (null where the gram is not that). Counts
    of the longest grams and of those at a word's beginning are as counted; a shorter gram
    counts the bytes that stand before it. The three discounts come from the numbers of
    grams counted one to four times, per language and order, and are 0.5, 1 and 1.5 where
    these are too few. Gram 0 is the empty context: its `b` is that of an unseen byte,
    shared over 256 values. A context has at most 256 successors, so no group is large.
    """
    counts = counts.withColumn("size", F.shiftright("gram", 56).cast("int"))
    adjusted = {order: counts.filter(F.col("size") == order).drop("size")}
    for k in range(order - 1, 0, -1):
        before = adjusted[k + 1].groupBy("lang", suffix("gram", k + 1).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        adjusted[k] = scratch.write(counts.filter(F.col("size") == k).drop("size").unionByName(before))
    lower, rows = None, []
    for k in range(1, order + 1):
        grams = adjusted[k]
        seen = [F.count_if(F.col("n") == j).alias(f"n{j}") for j in (1, 2, 3, 4)]
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        cut = [F.lit(j + 1.0) - (j + 1) * y * F.col(f"n{j + 2}") / F.col(f"n{j + 1}") for j in range(3)]
        fine = reduce(Column.__and__, [F.col(f"n{j}") > 0 for j in (1, 2, 3)])
        fine = F.when(fine, reduce(Column.__and__, [(c > 0) & (c < j + 1) for j, c in enumerate(cut)])).otherwise(False)
        discounts = grams.groupBy("lang").agg(*seen).select("lang", *(F.when(fine, c).otherwise((j + 1) / 2).alias(f"d{j + 1}") for j, c in enumerate(cut)))
        ctx = Window.partitionBy("lang", "ctx")
        kinds = [F.sum((F.least("n", F.lit(3)) == j).cast("int")).over(ctx) for j in (1, 2, 3)]
        # by context first: what is dealt out by language alone stays with few tasks
        grams = grams.withColumn("ctx", context("gram", k))
        grams = grams.select("*", F.sum("n").over(ctx).alias("all"), *(c.alias(f"c{j + 1}") for j, c in enumerate(kinds)))
        grams = grams.join(discounts, "lang")
        left = sum((F.col(f"c{j}") * F.col(f"d{j}") for j in (1, 2, 3)), F.lit(0.0))
        cost = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        grams = grams.withColumn("left", left / F.col("all"))
        grams = grams.select("lang", "gram", "n", "ctx", "all", "left", ((F.col("n") - cost) / F.col("all")).alias("own"))
        if lower is None:
            grams = grams.withColumn("p", F.col("own") + F.col("left") / 256)
        else:
            short = lower.select("lang", F.col("gram").alias("tail"), F.col("p").alias("shorter"))
            grams = grams.withColumn("tail", suffix("gram", k)).join(short, ["lang", "tail"])
            grams = grams.withColumn("p", F.col("own") + F.col("left") * F.col("shorter"))
        lower = grams = scratch.write(grams.select("lang", "gram", "n", "p", "ctx", "all", "left"))
        nothing = F.lit(None).cast("double")
        rows.append(grams.select("lang", "gram", "n", F.log10("p").alias("p"), nothing.alias("b")))
        weights = grams.groupBy("lang", F.col("ctx").alias("gram")).agg(F.max("all").alias("n"), F.log10(F.max("left")).alias("b"))
        rows.append(weights.select("lang", "gram", "n", nothing.alias("p"), "b"))
    return reduce(DataFrame.unionByName, rows).groupBy("lang", "gram").agg(F.max("n").alias("n"), F.max("p").alias("p"), F.max("b").alias("b"))


class Arrays:
    """The model as sorted hash arrays: p and b of a gram by binary search for its hash."""

    def __init__(self, names: list[str], lang: np.ndarray, grams: np.ndarray, p: np.ndarray, b: np.ndarray, whole: bool):
        self.names = {name: k for k, name in enumerate(names)}
        hashes = self.hashed(lang, grams)
        order = np.argsort(hashes)
        self.hashes, self.p, self.b, self.whole = hashes[order], p[order].astype(np.float32), b[order].astype(np.float32), whole

    @staticmethod
    def hashed(lang, grams: np.ndarray) -> np.ndarray:
        """A bijection of gram and language number, mixed so that neighbours part."""
        with np.errstate(over="ignore"):
            x = grams.astype(np.uint64) ^ (np.asarray(lang, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return x ^ (x >> np.uint64(31))

    def find(self, lang: int, grams: np.ndarray) -> np.ndarray:
        """Places of the grams, or -1."""
        if not len(self.hashes):
            return np.full(len(grams), -1)
        wanted = self.hashed(lang, grams)
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        return np.where(self.hashes[at] == wanted, at, -1)

    def log10(self, lang: str, grams: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's last byte; NaN where the arrays cannot tell."""
        name = self.names.get(lang)
        if name is None:
            return np.full(len(grams), -np.log10(256) if self.whole else np.nan)
        out, open_, weight = np.full(len(grams), np.nan), np.arange(len(grams)), np.zeros(len(grams))
        code, size = grams & ((1 << 56) - 1), grams >> 56
        while len(open_):
            at = self.find(name, key(code, size))
            p = np.where(at >= 0, self.p[at], np.nan) if len(self.p) else np.full(len(code), np.nan)
            known = ~np.isnan(p)
            out[open_[known]] = p[known] + weight[known]
            if not self.whole:
                break
            open_, weight, size, code = open_[~known], weight[~known], size[~known], code[~known]
            if not len(open_):
                break
            before = self.find(name, key(code >> 8, size - 1) * (size > 1))
            b = np.where(before >= 0, self.b[before], 0)
            weight = weight + np.where(np.isnan(b), 0, b)
            last = size == 1
            out[open_[last]] = weight[last] - np.log10(256)
            open_, weight, size = open_[~last], weight[~last], size[~last] - 1
            code = code[~last] & ((np.int64(1) << (8 * size)) - 1)
        return out


def loaded(model: DataFrame, limit: int) -> Arrays:
    """The most frequent entries, at most `limit`; all of them if there are no more."""
    n = model.count()
    some = model if n <= limit else model.filter(F.col("n") >= within(model, "n", limit))
    table = some.select("lang", "gram", F.col("p").cast("float").alias("p"), F.col("b").cast("float").alias("b")).toArrow()
    langs = table.column("lang").combine_chunks().dictionary_encode()
    p, b = (table.column(c).to_numpy() for c in ("p", "b"))
    return Arrays(langs.dictionary.to_pylist(), langs.indices.to_numpy(), table.column("gram").to_numpy(), p, b, n <= limit)


def mixed(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of the rows of some columns."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def repeated_windows(ids: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Per owner its words in three-word windows that stand at least twice with it.

    `ids` are word numbers in order, `owner` numbers 0 to n - 1 in rising order. Windows
    meet by a hash, and are compared where hashes are equal.
    """
    if len(ids) < 3:
        return np.zeros(n, np.int64)
    at = np.flatnonzero(owner[2:] == owner[:-2])
    columns = [owner[at], ids[at], ids[at + 1], ids[at + 2]]
    h = mixed(columns)
    order = np.argsort(h, kind="stable")
    equal = h[order[1:]] == h[order[:-1]]
    alike = np.all([c[order[1:]] == c[order[:-1]] for c in columns], axis=0)
    if (equal & ~alike).any():  # two windows of one hash: put equal ones side by side
        order = np.lexsort(columns)
        alike = np.all([c[order[1:]] == c[order[:-1]] for c in columns], axis=0)
    twice = np.zeros(len(at), bool)
    twice[order[1:]] |= alike
    twice[order[:-1]] |= alike
    marked = np.zeros(len(ids), bool)
    for k in range(3):
        marked[at[twice] + k] = True
    return np.bincount(owner[marked], minlength=n)


class Book:
    """Words of one language with the model's log10 probability of each, numbered as they come."""

    def __init__(self, arrays: Arrays, lang: str, order: int):
        self.arrays, self.lang, self.order = arrays, lang, order
        self.ids: dict[bytes, int] = {}
        self.scores = np.zeros(1024)
        #: Grams of a word that the arrays cannot tell.
        self.missing: dict[int, np.ndarray] = {}

    def learn(self, words: set[bytes]) -> None:
        fresh = [w for w in words if w not in self.ids]
        for k in range(0, len(fresh), 20_000):
            some, n = fresh[k : k + 20_000], len(self.ids)
            grams, starts = top_grams(some, self.order)
            found = self.arrays.log10(self.lang, grams)
            unknown = np.isnan(found)
            if unknown.any():
                for w in np.unique(np.searchsorted(starts, np.flatnonzero(unknown), "right") - 1):
                    part = slice(starts[w], starts[w + 1])
                    self.missing[n + int(w)] = grams[part][unknown[part]]
            while n + len(some) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros(len(self.scores))])
            self.scores[n : n + len(some)] = np.add.reduceat(np.where(unknown, 0, found), starts[:-1])
            self.ids.update(zip(some, range(n, n + len(some))))

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))


class Reader:
    """Counts and the model's log10 probability of texts, from bounded books of words."""

    def __init__(self, arrays: Arrays, order: int):
        self.arrays, self.order, self.books = arrays, order, {}

    def read(self, lang: str, texts: list[bytes]) -> list[tuple]:
        """Per text n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, open grams."""
        if sum(len(b.ids) for b in self.books.values()) > BOOK:
            self.books.clear()
        if lang not in self.books:
            self.books[lang] = Book(self.arrays, lang, self.order)
        book, n = self.books[lang], len(texts)
        if sum(map(len, texts)) <= PIECE:
            split = [text.split() for text in texts]
            book.learn(set().union(*split))
            ids = [book.numbers(words) for words in split]
            sizes = [sum(map(len, words)) for words in split]
        else:
            ids, sizes = [], []
            for text in texts:
                parts, size = [np.zeros(0, np.int64)], 0
                for words in words_of(text):
                    book.learn(set(words))
                    parts.append(book.numbers(words))
                    size += sum(map(len, words))
                ids.append(np.concatenate(parts))
                sizes.append(size)
        counts = np.array([len(i) for i in ids], np.int64)
        flat = np.concatenate([np.zeros(0, np.int64), *ids])
        owner = np.repeat(np.arange(n), counts)
        repeats = repeated_windows(flat, owner, n)
        scores, some = np.zeros(n), np.flatnonzero(counts)
        if len(some):
            scores[some] = np.add.reduceat(book.scores[flat], (np.cumsum(counts) - counts)[some])
        return [
            (int(counts[k]), sizes[k] - later(text), sum(map(text.count, SYMBOLS)), repeated_lines(text), int(repeats[k]), float(scores[k]), unknown(book, ids[k]))
            for k, text in enumerate(texts)
        ]


def later(text: bytes) -> int:
    """Bytes that continue a character."""
    return 0 if text.isascii() else int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) == 0x80))


def repeated_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def unknown(book: Book, ids: np.ndarray) -> list[tuple[int, int]]:
    """(gram, n) of the grams in a text that only the whole model can tell."""
    found: Counter = Counter()
    if book.missing:
        for w, n in zip(*np.unique(ids, return_counts=True)):
            for gram in book.missing.get(int(w), ()):
                found[int(gram)] += int(n)
    return list(found.items())


FACTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"


def read_all(docs: DataFrame, model: DataFrame, scratch: Scratch, order: int, limit: int) -> DataFrame:
    """`docs` (doc_id, lang) with FACTS; grams that the broadcast arrays lack are met by a join."""
    spark = docs.sparkSession
    arrays = loaded(model, limit)
    shared = spark.sparkContext.broadcast(arrays)
    language, text = text_columns(docs, "lang")
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, lang string, {FACTS}, open array<struct<gram: long, n: long>>"

    def run(batches):
        reader = Reader(shared.value, order)
        for batch in batches:
            for part in portions(batch, 2):
                langs, bodies, rows = part.column(1).to_pylist(), part.column(2).to_pylist(), [()] * part.num_rows
                for name in dict.fromkeys(langs):
                    mine = [k for k, other in enumerate(langs) if other == name]
                    for k, row in zip(mine, reader.read(name, [bodies[k] for k in mine])):
                        rows[k] = row
                columns = list(zip(*rows))
                facts = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(columns[5], pa.float64())]
                lists = pa.array([[{"gram": g, "n": n} for g, n in c] for c in columns[6]], pa.list_(pa.struct([("gram", pa.int64()), ("n", pa.int64())])))
                names = ["doc_id", "lang", *(f.split()[0] for f in FACTS.split(", ")), "open"]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *facts, lists], names=names)

    facts = scratch.write(docs.select("doc_id", language.alias("lang"), text.alias("text")).mapInArrow(run, shape).withColumn("row", F.monotonically_increasing_id()))
    if arrays.whole:
        return facts.drop("open", "row")
    wanted = facts.select("row", "lang", F.explode("open").alias("o")).select("row", "lang", "o.gram", "o.n")
    values = backed_off(wanted.select("lang", "gram").distinct(), model, order)
    more = wanted.join(values, ["lang", "gram"]).groupBy("row").agg(F.sum(F.col("n") * F.col("value")).alias("more"))
    return facts.join(more, "row", "left").withColumn("score", F.col("score") + F.coalesce("more", F.lit(0.0))).drop("open", "row", "more")


def backed_off(grams: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """(lang, gram, value): `Arrays.log10` for a table of grams, by joins from the shortest suffix up."""
    size = F.shiftright("gram", 56).cast("int")
    entries = model.select("lang", F.col("gram").alias("entry"), "p", "b")
    out = grams.withColumn("size", size).withColumn("value", F.lit(None).cast("double"))
    for k in range(1, order + 1):
        here = F.when(F.col("size") >= k, sized(F.col("gram").bitwiseAND((1 << (8 * k)) - 1), k))
        out = out.withColumn("here", here).withColumn("before", F.when(F.col("here").isNotNull(), context("here", k)))
        p = entries.select("lang", F.col("entry").alias("here"), "p")
        b = entries.select("lang", F.col("entry").alias("before"), "b")
        out = out.join(p, ["lang", "here"], "left").join(b, ["lang", "before"], "left")
        shorter = F.lit(-float(np.log10(256))) if k == 1 else F.col("value")
        value = F.coalesce(F.col("p"), shorter + F.coalesce("b", F.lit(0.0)))
        out = out.withColumn("value", F.when(F.col("here").isNotNull(), value).otherwise(F.col("value"))).drop("here", "before", "p", "b")
    return out.select("lang", "gram", "value")


def bands(rows: DataFrame, width: float = WIDTH) -> DataFrame:
    """(lang, low, high) in steps of log10 perplexity: `width` quartile distances beyond the quartiles.

    Exact for the steps: documents are counted per language and step, and only these few
    counts are put in order.
    """
    counts = rows.groupBy("lang", "step").agg(F.count(F.lit(1)).alias("n"))
    upto, all_ = Window.partitionBy("lang").orderBy("step"), Window.partitionBy("lang")
    counts = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(all_))
    quartile = [F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("step"))) for q in (0.25, 0.75)]
    least = round(LEAST_DISTANCE / STEP)
    spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(least)) * width
    return counts.groupBy("lang").agg(quartile[0].alias("q1"), quartile[1].alias("q3")).select(
        "lang", (F.col("q1") - spread).alias("low"), (F.col("q3") + spread).alias("high")
    )


def rules(docs: DataFrame, order: int = ORDER, limit: int = MAX_ENTRIES, width: float = WIDTH) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, log10_perplexity).

    A document fails the base rules with fewer than 50 words or more than half its words in
    repeated three-word windows. It is kept if it passes them and its perplexity lies within
    the band of its language. The model spells words: each byte of a word, and its end, after
    up to `order` - 1 bytes before it in the word. It is counted over all documents, one model
    per language (a null language is the empty one). Perplexity is per word.

    Null and empty texts have no words, fail, and have a null perplexity; ties and repeated
    rows count and are judged as rows; very long texts pass in pieces of some megabytes; an
    empty table gives no rows; other columns do not matter.
    """
    scratch = Scratch(docs.sparkSession, "ngram")
    model = scratch.write(kneser_ney(scratch.write(gram_counts(docs, order)), scratch, order))
    facts = read_all(docs, model, scratch, order, limit)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    mean = F.when(F.col("n_words") > 0, -F.col("score") / F.col("n_words"))
    facts = scratch.write(facts.withColumns({"base_failed": failed, "log10_perplexity": mean, "step": F.round(mean / STEP).cast("long")}))
    scratch.drop(facts)
    band = bands(facts.filter("NOT base_failed AND step IS NOT NULL"), width)
    kept = ~F.col("base_failed") & F.coalesce(F.col("step").between(F.col("low"), F.col("high")), F.lit(False))
    return facts.join(band, "lang", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "log10_perplexity"
    )
