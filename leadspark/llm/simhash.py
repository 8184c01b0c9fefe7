"""SimHash near-duplicates by a segment-popcount embedding and a grid range join."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.llm.common import Scratch, free_name, raw
from leadspark.llm.components import components

#: Bits of the six bands. Two prints with at most four differing bits agree on two bands.
BANDS = (12, 12, 10, 10, 10, 10)
#: Values of a signature; the first BANDED * ROWS of them make up the join keys.
SIGNATURE, BANDED, ROWS = 512, 20, 4
FACTORS = np.random.default_rng(17).integers(0, 1 << 63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: What the estimate of a candidate may fall short of the similarity asked for: over four
#: standard errors at 0.8. Candidates are then judged by their shingle sets.
SLACK = 0.08
#: The low bit of each two-bit segment.
LOW_BITS = 0x5555555555555555


def shingles(data: bytes, size: int = 4) -> np.ndarray:
    """XXH64 of the word shingles of a text, repeats included.

    Words are runs of bytes other than space and 0x09-0x0D after lowering A-Z. A text
    of fewer words than `size` is one shingle; one without words has none.
    """
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[min(size, len(words)) - 1 :].tolist()
    hash64 = xxhash.xxh64_intdigest
    return np.array([hash64(joined[a:b], 42) for a, b in zip(starts[: len(last)].tolist(), last)], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """64-bit SimHash: a bit is set if it is in over half of the hashes; 0 without any."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype(">u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big") if len(hashes) else 0


def fingerprint(data: bytes, size: int = 4) -> int:
    """64-bit SimHash of the word shingles of a text."""
    return simhash(shingles(data, size))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Smallest value of each of SIGNATURE mixing functions over a set of hashes."""
    out = np.full(SIGNATURE, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 128):
        mixed = hashes[at : at + 128, None] * FACTORS[None, :]
        out = np.minimum(out, (mixed ^ (mixed >> np.uint64(32))).min(axis=0))
    return out


def fingerprints(docs: DataFrame, size: int = 4, signed_too: bool = False) -> DataFrame:
    """(doc_id, print) of every row; a null text has no words.

    With `signed_too` also keys, the join keys of BANDED groups of signature values,
    signature, one byte of each value, and digest, which names the text; a text without
    words has no keys.
    """

    def run(batches):
        for batch in batches:
            prints, keys, signatures = [], [], []
            for text in batch.column(1).to_pylist():
                hashes = shingles(text, size)
                prints.append(simhash(hashes))
                if signed_too:
                    least = signature(hashes)
                    folded = (least[: BANDED * ROWS].reshape(BANDED, ROWS) * FACTORS[:ROWS]).sum(axis=1, dtype=np.uint64)
                    keys.append((folded + FACTORS[:BANDED]).view(np.int64).tolist() if len(hashes) else [])
                    signatures.append((least >> np.uint64(7)).astype(np.uint8).tobytes())
            cols = [batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))]
            if signed_too:
                cols += [pa.array(keys, pa.list_(pa.int64())), pa.array(signatures, pa.binary()), batch.column(2)]
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = "doc_id long, print long" + (", keys array<long>, signature binary, digest binary" if signed_too else "")
    names = ["doc_id", "print", "keys", "signature", "digest"][: 2 + 3 * signed_too]
    columns = [F.col("doc_id").cast("long").alias("doc_id"), raw().alias("text"), digest()][: 2 + signed_too]
    return docs.select(*columns).mapInArrow(run, kind)


def digest() -> Column:
    """128 bits that name a text."""
    return F.unhex(F.md5(raw())).alias("digest")


def grids() -> list[int]:
    """Bit masks of the grids: every pair of bands."""
    masks, at = [], 0
    for bits in BANDS:
        masks.append(((1 << bits) - 1) << at)
        at += bits
    return [a | b for a, b in combinations(masks, 2)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cells(prints: DataFrame) -> DataFrame:
    """(print, cell): the grid cells of the segment-popcount embedding of each print.

    The embedding counts the bits of each of 32 two-bit segments; the counts stay packed
    in one word. The Manhattan distance of two embeddings is at most the Hamming
    distance, and where two bands hold no differing bit their counts are equal, so links
    share the cell of at least one grid.
    """
    # of the bits p, q of a segment, the count is q xor p in its low and q and p in its high bit
    x, half, low = F.col("print"), F.shiftrightunsigned("print", 1), F.lit(LOW_BITS)
    counts = x.bitwiseXOR(half).bitwiseAND(low).bitwiseOR(F.shiftleft(x.bitwiseAND(half).bitwiseAND(low), 1))
    return prints.withColumn("counts", counts).select(
        "print",
        F.explode(
            F.array(*[F.xxhash64(F.lit(g), F.col("counts").bitwiseAND(F.lit(signed(m)))) for g, m in enumerate(grids())])
        ).alias("cell"),
    )


def link_cell(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the prints of one cell exactly as all pairs within `radius` would.

    A breadth-first walk compares each print only with those not reached yet and whose
    total bit count lies within the radius (a projection of the embedding), so a dense
    group costs a few passes and yields one link per print.
    """
    count = np.bitwise_count(x).astype(np.int16)
    order = np.argsort(count, kind="stable")
    rest, count = x[order], count[order]
    heads, tails = [], []
    while len(rest):
        root, todo = rest[0], [rest[0]]
        rest, count = rest[1:], count[1:]
        while todo and len(rest):
            y = todo.pop()
            bits = int(np.bitwise_count(y))
            lo, hi = np.searchsorted(count, (bits - radius, bits + radius + 1))
            near = np.flatnonzero(np.bitwise_count(rest[lo:hi] ^ y) <= radius) + lo
            if len(near):
                hit = rest[near]
                heads.append(np.full(len(hit), root, np.uint64))
                tails.append(hit)
                todo.extend(hit)
                rest, count = np.delete(rest, near), np.delete(count, near)
    if not heads:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(heads), np.concatenate(tails)


def link_sorted(keys: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of rows sorted by cell: small cells all at once, larger ones by `link_cell`."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(starts, len(keys)))
    group = np.repeat(np.arange(len(starts)), sizes)
    small = sizes[group] <= 8
    heads, tails = [], []
    for step in range(1, 8):
        here = np.flatnonzero(small[:-step] & (group[step:] == group[:-step])) if step < len(keys) else np.zeros(0, int)
        here = here[np.bitwise_count(prints[here] ^ prints[here + step]) <= radius]
        heads.append(prints[here])
        tails.append(prints[here + step])
    for at in np.flatnonzero(sizes > 8):
        a, b = link_cell(np.unique(prints[starts[at] : starts[at] + sizes[at]]), radius)
        heads.append(a)
        tails.append(b)
    return np.concatenate(heads), np.concatenate(tails)


def blocked(entries: DataFrame, block: int) -> DataFrame:
    """(cell, print) without lone prints; a cell of more than `block` prints is cut into
    blocks and every pair of blocks becomes a cell of its own."""
    sizes = entries.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return (
        entries.join(sizes, "cell")
        .withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("print"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            F.when(F.col("parts") == 1, F.col("cell"))
            .otherwise(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")))
            .alias("cell"),
            "print",
        )
    )


def links(prints: DataFrame, scratch: Scratch, radius: int = 4, block: int = 50_000) -> DataFrame:
    """(a, b): links that connect distinct prints as all pairs within `radius` bits do.

    Cells of one print are dropped by a count. A cell of more than `block` prints is
    cut into blocks and every pair of blocks becomes a cell of its own, so no task holds
    more than two blocks of a cell and no pair is lost.
    """
    shared = blocked(scratch.write(cells(prints)), block)

    def run(batches):
        keys, prints_ = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(k, p):
            a, b = link_sorted(k, p, radius)
            a, b = pa.array(a.view(np.int64)), pa.array(b.view(np.int64))
            return pa.RecordBatch.from_arrays([a, b], ["a", "b"])

        for batch in batches:
            keys = np.concatenate((keys, batch.column(0).to_numpy()))
            prints_ = np.concatenate((prints_, batch.column(1).to_numpy().view(np.uint64)))
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if cut:
                yield out(keys[:cut], prints_[:cut])
                keys, prints_ = keys[cut:], prints_[cut:]
        if len(keys):
            yield out(keys, prints_)

    return shared.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long").distinct()


def link_similar(prints: np.ndarray, signatures: np.ndarray, least: float) -> tuple[list, list]:
    """Links that connect the rows of one cell as all pairs of estimated similarity
    `least` or more would; the same shrinking walk as `link_cell`."""
    heads, tails = [], []
    rest = np.arange(1, len(prints))
    todo, root = [0], 0
    while len(rest):
        if not todo:
            root, rest = int(rest[0]), rest[1:]
            todo = [root]
            continue
        same = (signatures[rest] == signatures[todo.pop()]).mean(axis=1)
        near = (same * 256 - 1) / 255 >= least
        hit = rest[near]
        heads += [prints[root]] * len(hit)
        tails += prints[hit].tolist()
        todo.extend(hit.tolist())
        rest = rest[~near]
    return heads, tails


def similar_links(rows: DataFrame, scratch: Scratch, least: float, block: int = 20_000) -> DataFrame:
    """(a, b): links that connect texts whose shingle sets may have a similarity of `least`.

    `rows` names each text by the column `print`. Prints of texts at similarity 0.8 differ
    by some ten bits, too many for grids of bits, so candidates are texts that share a key
    of ROWS least values (at 0.8, all but 3 in 100,000 pairs share one of the BANDED keys)
    and whose whole signatures agree but for SLACK.
    """
    entries = scratch.write(rows.select("print", F.explode("keys").alias("cell")).distinct())
    shared = scratch.write(blocked(entries, block))
    wanted = shared.select("print").distinct()
    signatures = rows.join(wanted, "print").groupBy("print").agg(F.min("signature").alias("signature"))
    joined = shared.join(signatures, "print").select("cell", "print", "signature")

    def run(batches):
        held: list = []

        def out(keys, prints, signatures):
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            heads, tails = [], []
            for a, b in zip(starts, np.append(starts[1:], len(keys))):
                if b - a > 1:
                    h, t = link_similar(prints[a:b], signatures[a:b], least - SLACK)
                    heads += h
                    tails += t
            cols = [pa.array(np.array(c, np.int64)) for c in (heads, tails)]
            return pa.RecordBatch.from_arrays(cols, ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            flat = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, SIGNATURE)
            part = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), flat]
            held = [np.concatenate(pair) for pair in zip(held, part)] if held else part
            cut = int(np.searchsorted(held[0], held[0][-1]))
            if cut:
                yield out(*(h[:cut] for h in held))
                held = [h[cut:] for h in held]
        if held:
            yield out(*held)

    return joined.repartition("cell").sortWithinPartitions("cell", "print").mapInArrow(run, "a long, b long").distinct()


def link_exact(ids: np.ndarray, sets: list[np.ndarray], least: float) -> tuple[list, list]:
    """Links that connect sets as all pairs of Jaccard similarity `least` or more would;
    the same shrinking walk as `link_cell`. Two empty sets are equal."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    ends = np.cumsum(sizes)
    values = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mark = np.zeros(len(values) + 1, bool)
    heads, tails = [], []
    rest = np.arange(1, len(sets))
    todo, root = [0], 0
    base = rest[:0]
    while len(rest):
        if not todo:
            root, rest = int(rest[0]), rest[1:]
            todo = [root]
            continue
        if 2 * len(rest) <= len(base) or not len(base):  # lay out the values of what is left
            base = rest
            flat = np.concatenate([values[ends[i] - sizes[i] : ends[i]] for i in base])
            upto = np.append(0, np.cumsum(sizes[base]))
        y = todo.pop()
        own = values[ends[y] - sizes[y] : ends[y]]
        mark[own] = True
        sums = np.append(0, np.cumsum(mark[flat]))[upto]
        mark[own] = False
        both = np.diff(sums)[np.searchsorted(base, rest)]
        union = sizes[y] + sizes[rest] - both
        near = (both / np.maximum(union, 1) >= least) | (union == 0)
        hit = rest[near]
        heads += [ids[root]] * len(hit)
        tails += ids[hit].tolist()
        todo.extend(hit.tolist())
        rest = rest[~near]
    return heads, tails


def exact_links(docs: DataFrame, candidates: DataFrame, scratch: Scratch, least: float, size: int, block: int = 4_000) -> DataFrame:
    """(a, b): links between texts whose shingle sets have a similarity of `least` or more.

    `candidates` is (id, digest, cell); texts of one cell are compared by their sets, which
    travel once per text. A cell of more than `block` texts is cut as in `blocked`.
    """

    def sets(batches):
        for batch in batches:
            found = [np.unique(shingles(t, size)).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["id", "shingles"])

    def run(batches):
        held: list = []

        def out(cells, ids, found):
            starts = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
            heads, tails = [], []
            for a, b in zip(starts, np.append(starts[1:], len(cells))):
                if b - a > 1:
                    h, t = link_exact(ids[a:b], [np.frombuffer(x, np.uint64) for x in found[a:b]], least)
                    heads += h
                    tails += t
            return pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in (heads, tails)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()]
            held = [np.concatenate((held[0], part[0])), np.concatenate((held[1], part[1])), held[2] + part[2]] if held else part
            cut = int(np.searchsorted(held[0], held[0][-1], "left"))
            if cut:
                yield out(*(h[:cut] for h in held))
                held = [h[cut:] for h in held]
        if held:
            yield out(*held)

    shared = scratch.write(blocked(candidates.select("cell", F.col("id").alias("print")), block))
    wanted = candidates.select("id", "digest").join(shared.select(F.col("print").alias("id")).distinct(), "id")
    texts = docs.select(digest(), raw().alias("text")).join(wanted, "digest").dropDuplicates(["id"]).select("id", "text")
    found = scratch.write(texts.mapInArrow(sets, "id long, shingles binary"))
    joined = shared.select("cell", F.col("print").alias("id")).join(found, "id").select("cell", "id", "shingles")
    return joined.repartition("cell").sortWithinPartitions("cell", "id").mapInArrow(run, "a long, b long").distinct()


def similar_groups(docs: DataFrame, scratch: Scratch, radius: int, size: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The rows of `fingerprints`, and (digest, component_id, first, kept) of each distinct text.

    first is the smallest doc_id of the text, kept whether it is the least of its component.

    Candidates are texts of close prints or signatures; those connected by candidate links
    are compared by their shingle sets, and only what that confirms is a link.
    """
    rows = scratch.write(fingerprints(docs, size, True))
    texts = rows.groupBy("digest").agg(
        F.min("doc_id").alias("first"), *[F.first(c).alias(c) for c in ("print", "keys", "signature")]
    )
    texts = scratch.write(texts.withColumn("id", F.monotonically_increasing_id()))
    named = scratch.write(texts.groupBy("print").agg(F.min("id").alias("name")))
    a, b = (named.select(F.col("print").alias(c), F.col("name").alias(f"name_{c}")) for c in "ab")
    close = links(named.select("print"), scratch, radius).join(a, "a").join(b, "b").select(F.col("name_a").alias("a"), F.col("name_b").alias("b"))
    same = texts.select("id", "print").join(named, "print").filter("id <> name").select(F.col("name").alias("a"), F.col("id").alias("b"))
    signed_texts = texts.select(F.col("id").alias("print"), "keys", "signature")
    maybe = components(close.unionByName(same).unionByName(similar_links(signed_texts, scratch, similarity)), scratch)
    candidates = texts.select("id", "digest").join(maybe.select(F.col("node").alias("id"), F.col("root").alias("cell")), "id")
    roots = components(exact_links(docs, scratch.write(candidates), scratch, similarity, size), scratch)
    rooted = texts.select("id", "digest", "first").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn(
        "root", F.coalesce("root", "id")
    )
    least = rooted.groupBy("root").agg(
        F.min("first").alias("component_id"), F.min(F.struct(F.col("first").isNull().alias("none"), "first", "digest")).alias("least")
    )
    kept = F.col("digest") == F.col("least.digest")
    return rows, scratch.write(rooted.join(least, "root").select("digest", "component_id", "first", kept.alias("kept")))


def groups(docs: DataFrame, radius: int = 4, size: int = 4, similarity: float | None = None) -> DataFrame:
    """(doc_id, print, component_id) of every row.

    Prints are linked at `radius` or fewer differing bits; component_id is the smallest
    doc_id reachable, the row's own included. Copies share a print, so only distinct
    prints are joined. With `similarity`, texts are linked instead if their shingle sets
    have a Jaccard similarity of that or more, which is computed exactly for candidates by
    close prints or signatures (`similar_groups`). Null and empty texts have print zero
    and are linked like any other. A row with a null doc_id is linked but never names a component; where no
    row of a component has an id, component_id is null. Repeated rows are returned
    as often as they come. Other columns of `docs` are not read.
    """
    if radius != 4:
        raise ValueError("the band layout is made for a radius of 4 bits")
    scratch = Scratch(docs.sparkSession, "simhash")
    if similarity is not None:
        rows, named = similar_groups(docs, scratch, radius, size, similarity)
        scratch.drop(rows, named)
        return rows.join(named, "digest").select("doc_id", "print", "component_id")
    rows = scratch.write(fingerprints(docs, size))
    distinct = scratch.write(rows.groupBy("print").agg(F.min("doc_id").alias("first")))
    found = links(distinct.select("print"), scratch, radius)
    roots = components(found, scratch)
    rooted = distinct.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn(
        "root", F.coalesce("root", "print")
    )
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select(
        "print", "component_id"
    )
    named = scratch.write(named)
    scratch.drop(rows, named)
    return rows.join(named, "print").select("doc_id", "print", "component_id")


def keep_one(docs: DataFrame, radius: int = 4, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """`docs` with one row per component of `groups`: the least by doc_id, then by the hash of its text.

    A row without a doc_id comes after those that have one. Rows that repeat a doc_id with
    another text are judged by their texts like any other rows, so different documents under
    one id all stay; of rows equal in both one stays. Each component keeps exactly one row.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    _, named = similar_groups(docs, scratch, radius, size, similarity)
    scratch.drop(named)
    # one row per component: the text that stays and the id it stays under
    names = [free_name(docs, n) for n in ("digest", "first")]
    keep = named.filter("kept").select(F.col("digest").alias(names[0]), F.col("first").alias(names[1]))
    marked = docs.withColumn(names[0], digest())
    same = (F.col(f"d.{names[0]}") == F.col(f"k.{names[0]}")) & F.col("d.doc_id").eqNullSafe(F.col(f"k.{names[1]}"))
    return marked.alias("d").join(keep.alias("k"), same, "left_semi").dropDuplicates([names[0]]).select(*docs.columns)
