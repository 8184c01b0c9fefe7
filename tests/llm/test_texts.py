"""WARC, mixing, token counts, string tiling and the pipeline: round trips and brute force."""

import gzip
import hashlib
import io
import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from leadspark.llm import mixing, quality, rlz, simhash, tiling, token_counts, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


def test_warc_round_trip(spark):
    big, other = "é" * 600, "b" * 1000
    rows = [(1, "http://a/1", big), (9, "http://a/9", big), (4, None, big), (5, "u", other), (6, "u\r\nX: y", other[:-1]), (7, "u", other[:-1])]
    rows += [(8, "u", None), (10, "u", ""), (9, "http://a/9", big), (None, "u", big), (11, "u", "x\r\n\r\nWARC/1.1\r\n\r\n" * 70)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    got = sorted((tuple(r) for r in warc.round_trip(spark, df.repartition(3)).collect()), key=str)
    keeper = {hashlib.sha1(t.encode()).hexdigest(): k for k, t in ((9, big), (5, other))}
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        sha = hashlib.sha1(data).hexdigest()
        refers = keeper.get(sha) if i is not None and len(data) >= 1000 and keeper.get(sha) != i else None
        want.append((i, len(data), sha, "response" if refers is None else "revisit", refers))
    assert got == sorted(want, key=str)
    assert warc.round_trip(spark, df.limit(0)).count() == 0


def test_normaliser_cuts_one_stream_into_members(spark, tmp_path):
    whole = [warc.record(k, f"u{k}", bytes([97 + k]) * (k * 40000), "d", None) for k in range(5)]
    path = tmp_path / "x.warc.gz"
    path.write_bytes(gzip.compress(b"".join(whole)))
    index = warc.normalise(spark.createDataFrame([(str(path),)], "archive string")).collect()
    data = (tmp_path / "x.members.warc.gz").read_bytes()
    assert [gzip.decompress(data[r["offset"] : r["offset"] + r["length"]]) for r in index] == whole
    lines = (tmp_path / "x.members.idx").read_text().splitlines()
    assert [tuple(map(int, line.split("\t")[:3])) for line in lines] == [(r["offset"], r["length"], r["page_id"]) for r in index]
    path.write_bytes(data)
    assert [r["length"] for r in warc.normalise(spark.createDataFrame([(str(path),)], "archive string")).collect()] == [r["length"] for r in index]


def test_broken_archives_are_refused():
    whole = warc.record(1, "u", b"payload", "d", None)
    list(warc.records(iter([whole[:10], whole[10:]])))
    with pytest.raises(ValueError):
        list(warc.records(iter([whole[:-12]])))
    with pytest.raises(ValueError):
        list(warc.records(warc.inflated(io.BytesIO(gzip.compress(whole * 50)[:-60]))))


def test_cut_streams_are_refused_and_padding_is_skipped(monkeypatch):
    whole = warc.record(1, "u", b"payload", "d", None)
    codec = zlib.compressobj(6, wbits=31)
    flushed = codec.compress(whole * 25) + codec.flush(zlib.Z_FULL_FLUSH)
    stream = flushed + codec.compress(whole * 25) + codec.flush()
    for size in (1 << 16, 7):
        monkeypatch.setattr(warc, "CHUNK", size)
        for cut in (flushed, stream[:-1], stream[:-8], stream[:5], stream + stream[:30]):
            with pytest.raises(ValueError):
                list(warc.inflated(io.BytesIO(cut)))
        for padded, n in ((stream + b"\0" * 600, 50), (stream + b"\0" * 9 + stream, 100), (stream * 2, 100), (b"", 0)):
            assert b"".join(warc.inflated(io.BytesIO(padded))) == whole * n
        assert len(list(warc.records(warc.inflated(io.BytesIO(stream))))) == 50
    monkeypatch.setattr(warc, "CHUNK", 1 << 16)
    zeros = gzip.compress(b"a" * (1 << 22))
    assert sum(map(len, warc.inflated(io.BytesIO(zeros)))) == 1 << 22


def quantile(mean, u):
    n, p = 0, math.exp(-mean)
    reached = p
    while u >= reached and n < 5000:
        n += 1
        p *= mean / n
        reached += p
    return n


def test_poisson_counts_equal_the_quantile(spark):
    rows = [(i, f"t{i}", s) for i, s in enumerate(["big"] * 300 + ["small"] * 20 + [None] * 5 + ["one"])]
    weights = spark.createDataFrame([("big", 1.0), ("small", 1.0), (None, 0.5), ("absent", 9.0)], "source string, weight double")
    got = mixing.mix(docs_of(spark, rows).withColumn("copy", F.lit("c")), weights, seed=3)
    assert got.columns[-4:] == ["rate", "copies", "_copy", "shuffle_key"]
    out = {}
    for r in got.collect():
        assert r["_copy"] < r["copies"] and r["copy"] == "c"
        out.setdefault(r["doc_id"], []).append(r["_copy"])
    for i, _, s in rows:
        rate = {"big": 326 / 2.5 / 300, "small": 326 / 2.5 / 20, None: 326 * 0.5 / 2.5 / 5}.get(s, 0)
        u = int(hashlib.md5(f"3|{i}|1".encode()).hexdigest()[:13], 16) / 2**52
        assert sorted(out.get(i, [])) == list(range(quantile(rate, u) if rate else 0))


def test_large_means_are_drawn_in_parts(spark):
    base = spark.createDataFrame([(i, 2000.0) for i in range(400)], "id long, m double")
    n = np.array([r[0] for r in base.select(mixing.poisson("m", F.col("id").cast("string"))).collect()])
    assert abs(n.mean() - 2000) < 10 and 0.8 < n.var() / 2000 < 1.25


def test_mix_keeps_shares_and_empty_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "source")
    rates = {r["source"]: r["rate"] * r["n"] for r in mixing.rates(docs).collect()}
    got = {r["source"]: r["count"] for r in mixing.mix(docs).groupBy("source").count().collect()}
    assert all(abs(got[s] - x) < 5 * math.sqrt(x) for s, x in rates.items())
    assert mixing.mix(docs.limit(0)).count() == 0
    twice = mixing.mix(docs.limit(5).union(docs.limit(5)).withColumn("doc_id", F.lit(None).cast("long")))
    assert twice.select("copies").distinct().count() <= 5


def test_token_counts_equal_the_library(spark):
    rng = random.Random(7)
    marks = ["a", "bc", " ", "  ", "\n", "\t", "'s", "12", "!", "é", "<|endoftext|>", "\x1c", "\x85", "\xa0", "　", "漢字", "' ", "\x00", "​", "é"]
    texts = ["".join(rng.choices(marks, k=rng.randint(0, 40))) for _ in range(3000)] + ["", "x" * 5000, "word " * 3000, " lead", "tail ", None]
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    df = docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)]).withColumn("n_tokens", F.lit("x"))
    got = {r["doc_id"]: tuple(r)[1:] for r in token_counts.token_counts(df, path).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False))
        assert got[i] == (len((t or "").encode()), n, n > 1024)
    assert token_counts.token_counts(df.limit(0), path).count() == 0


def test_token_cache_may_be_emptied(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHED_PIECES", 50)
    monkeypatch.setattr(token_counts, "BATCH_BYTES", 200)
    counter = token_counts.Counter(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(90)}" for _ in range(rng.randint(0, 60))) for _ in range(200)]
    assert counter.counts(texts) == [len(counter.tokenizer.encode(t, add_special_tokens=False)) for t in texts]


def brute_tiles(text, item, size):
    """Greedy string tiling by trying every pair of places again and again."""
    used_t, used_i, out = set(), set(), []
    while True:
        best = None
        for p, q in itertools.product(range(len(text)), range(len(item))):
            n = 0
            while (
                p + n < len(text) and q + n < len(item) and text[p + n] == item[q + n] and p + n not in used_t and q + n not in used_i
            ):
                n += 1
            if n >= size and (best is None or (-n, p, q) < best):
                best = (-n, p, q)
        if best is None:
            return out
        n, p, q = best
        out.append((p, q, -n))
        used_t.update(range(p, p - n))
        used_i.update(range(q, q - n))


@pytest.mark.parametrize("seed", range(6))
def test_tiles_equal_exhaustive_tiling(seed):
    rng = random.Random(seed)
    for _ in range(30):
        item = [rng.choice("abcd") for _ in range(rng.randint(3, 18))]
        text = [rng.choice("abcd") for _ in range(rng.randint(0, 12))] + item[5:] + [rng.choice("abcde")] + item[:5]
        items = tiling.Items([(1, " ".join(item).encode())], 3)
        ids = items.ids(" ".join(text).encode())
        found = tiling.tiles(ids, items.items[0][1], items.seeds(ids).get(0, []), 3)
        assert found == brute_tiles(text, item, 3)


def test_reordered_passages_are_caught(spark):
    words = [f"word{k}" for k in range(40)]
    other = [f"other{k}" for k in range(30)]
    bench = spark.createDataFrame(
        [(5, " ".join(words)), (3, " ".join(words)), (8, " ".join(other)), (9, "a b"), (10, None), (5, " ".join(words))], "item_id long, text string"
    )
    moved = " ".join(["Intro,", *words[25:], "middle", *words[8:25], "gap", *words[:8], "end"]).replace("word30", "(WORD30).")
    few = " ".join(["x"] * 10 + words[:12] + ["y"] * 10)
    rows = [(1, moved, "s"), (2, few, "s"), (3, None, "s"), (4, "", "s"), (5, " ".join(other[:16]), "s"), (6, "a b c", "s"), (1, moved, "s")]
    df = docs_of(spark, rows).withColumn("coverage", F.lit("x"))
    for size in (tiling.BLOCK_BYTES, 300):
        got = {r["doc_id"]: tuple(r)[1:] for r in tiling.contamination(df, bench, block_bytes=size).collect()}
        assert got[1] == (True, 2, 3, 1.0, 3, 17)
        assert got[2] == (False, 0, 3, pytest.approx(0.3), 1, 12)
        assert got[3] == got[4] == (False, 0, None, 0.0, 0, 0)
        assert got[6] == (True, 1, 9, 1.0, 1, 2)
        assert got[5][:3] == (True, 1, 8)
        kept = tiling.clean(df, bench, block_bytes=size)
        assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4]
    assert tiling.contamination(df.limit(0), bench).count() == 0
    assert tiling.contamination(df, bench.limit(0)).filter("contaminated").count() == 0


def test_short_items_match_whole(spark):
    items = [(1, "What?"), (2, "the cat sat"), (3, "日本語"), (4, "..."), (5, ""), (6, "one two three four five six"), (7, "cat sat"), (8, "the")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, "what is it"), (2, "The cat (sat) down"), (3, "the dog, cat cat"), (4, "日本語"), (5, "... "), (6, "one two three four nothing"), (7, "sat cat")]
    got = {r["doc_id"]: tuple(r)[1:] for r in tiling.contamination(docs_of(spark, [(*r, "s") for r in rows]), bench).collect()}
    assert got[1] == (True, 1, 1, 1.0, 1, 1) and got[2] == (True, 3, 2, 1.0, 1, 3) and got[3] == (True, 1, 8, 1.0, 1, 1)
    assert got[4] == (True, 1, 3, 1.0, 1, 1) and not got[5][0] and not got[6][0] and not got[7][0]
    long = tiling.Items([(1, b"a b")], 5)
    assert tiling.best(long, b"x " * 1000 + b"a b", 0.5) == (1, 1.0, 1, 1, 2) and tiling.best(long, b"a", 0.5) == (0, 0.0, None, 0, 0)


def test_benchmark_passages_of_the_documents_table(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    verbatim = {d for d, t in texts.items() if any(i in t for i in items.values())}
    got = {r["doc_id"]: r["contaminated"] for r in tiling.contamination(docs, bench).collect()}
    assert verbatim and all(got[d] for d in verbatim) and sum(got.values()) < len(verbatim) + 0.02 * len(texts)


def test_pipeline_stage_by_stage(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, docs
    for (name, stage), n in zip(corpus_pipeline.STAGES, range(5)):
        out = stage(spark, seen, folder).cache()
        before, after = ({r["doc_id"]: r["text"] for r in x.select("doc_id", "text").collect()} for x in (seen, out))
        assert out.columns[:5] == columns and (n == 4 or out.columns == columns) and set(after) <= set(before), name
        if n == 0:
            labels = spark.read.parquet(f"{folder}/labels.parquet")
            assert set(after) == {r["doc_id"] for r in quality.scores(docs, labels).filter("predicted = 1").collect()}
        if n == 1:
            groups = simhash.groups(seen, size=5, similarity=0.8).collect()
            assert set(after) == {r["component_id"] for r in groups} and out.count() == len(after)
        if n == 2:
            assert set(after) == set(before)
            cut = {r["doc_id"]: r["n_removed"] for r in rlz.digest(seen).collect()}
            assert all((before[d] == after[d]) if not cut[d] else len(after[d].split()) == len(before[d].split()) - cut[d] for d in after)
        if n == 3:
            bad = tiling.contamination(seen, spark.read.parquet(f"{folder}/benchmark.parquet")).filter("contaminated").collect()
            assert set(after) == set(before) - {r["doc_id"] for r in bad}
        seen = out
    got = sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()), key=str)
    assert got == sorted(map(tuple, seen.collect()), key=str)


def test_pipeline_of_nulls_repeats_and_extra_columns(spark, tmp_path):
    text = "The quick brown fox jumps over the lazy dog while it rains in spring. " * 6
    rows = [(1, text, "a"), (1, text, "a"), (2, text, None), (None, text, "a"), (3, None, "a"), (4, "", "b")]
    for name, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = docs_of(spark, rows).withColumn("rate", F.lit("r")).withColumn("mark", F.lit(None).cast("int"))
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = out.cache()
    assert sorted(r["doc_id"] for r in docs.collect()) == [1, 3]  # the copy without an id falls to that of 1
    assert stage_count(spark, docs, tmp_path) >= 0
    empty = docs.limit(0)
    assert all(stage(spark, empty, str(tmp_path)).count() == 0 for _, stage in corpus_pipeline.STAGES)


def stage_count(spark, docs, folder):
    return corpus_pipeline.mixing_stage(spark, docs, str(folder)).count()
