"""Token counts: lengths only, from batches of pieces cut at safe boundaries."""

from __future__ import annotations

import os
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN_LIMIT = 1024
BATCH_BYTES = 1_000_000
CACHED_PIECES = 400_000
#: A single space between two characters that are no white space. Byte-level pieces that
#: hold a space start with it, and nothing before it can join what follows, so the text
#: may be cut in front of it.
SAFE = re.compile(r"(?<=[^\s\x1c-\x1f\x85]) (?=[^\s\x1c-\x1f\x85])")
#: A text without these has no other spaces than safe ones.
UNSAFE = re.compile(r"[\s\x1c-\x1f\x85]{2}|^ | \Z")

_loaded: dict = {}


def pieces(text: str) -> list[str]:
    """The text cut in front of every safe space."""
    if UNSAFE.search(text):
        return SAFE.sub("\x00 ", text).split("\x00") if "\x00" not in text else [text]
    first, *rest = text.split(" ")
    return [first, *[" " + p for p in rest]]


class Counter:
    """Counts tokens of texts with a vocabulary file of the `tokenizers` library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        #: Lengths of pieces met lately, and of those met before the last emptying.
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def learn(self, pieces: list[str]) -> None:
        """Encode new pieces in batches of about BATCH_BYTES; keep their lengths only."""
        batch, size = [], 0
        for piece in [*pieces, None]:
            if batch and (piece is None or size + len(piece) > BATCH_BYTES):
                found = self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)
                self.known.update(zip(batch, map(len, found)))
                batch, size = [], 0
            if piece is not None:
                batch.append(piece)
                size += len(piece)

    def counts(self, texts: list[str]) -> list[int]:
        """Token counts of texts, taken together in groups of about BATCH_BYTES."""
        out, group, size = [], [], 0
        for text in [*texts, None]:
            if group and (text is None or size + len(text) > BATCH_BYTES):
                out += self.group(group)
                group, size = [], 0
            if text is not None:
                group.append(text)
                size += len(text)
        return out

    def group(self, texts: list[str]) -> list[int]:
        cut = [pieces(t) for t in texts]
        new = set().union(*cut).difference(self.known)
        if len(self.known) + len(new) > CACHED_PIECES:
            self.known, self.older = {}, self.known
            new = set().union(*cut)
        for piece in new & self.older.keys():
            self.known[piece] = self.older[piece]
        self.learn([p for p in new if p not in self.known])
        get = self.known.__getitem__
        return [sum(map(get, c)) for c in cut]


def counter(path: str) -> Counter:
    """One tokenizer per Python worker."""
    if path not in _loaded:
        _loaded[path] = Counter(path)
    return _loaded[path]


def token_counts(docs: DataFrame, path: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of `docs`.

    Counts equal those of the `tokenizers` library for the vocabulary file `path` on
    whole texts: no added special tokens, special strings in a text as the library takes
    them by default, no truncation. The file must be of the byte-level kind without a
    normaliser, for which cutting before a single space is safe, and must exist on
    every executor. A null text counts as empty: 0 bytes, 0 tokens. Repeated rows are
    counted each.
    """

    @F.pandas_udf("long")
    def count(text: pd.Series) -> pd.Series:
        return pd.Series(counter(path).counts(text.tolist()), dtype="int64")

    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(whole).cast("long").alias("n_bytes"),
        count(whole).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
