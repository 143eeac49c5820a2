"""Token counts of a byte-level BPE vocabulary by rank-synchronous array merging.

Texts are cut into pre-tokens; the distinct ones of a batch that are not known yet are merged together as ragged
arrays (see ``merges``), and what is left of each is counted. Counts of pre-tokens are kept for later batches of the
same Python worker, up to a bound.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basaltine.llm.merges import MergeTable, merged
from basaltine.llm.ship import ship
from basaltine.llm.words import whole

#: How this vocabulary family splits text before its merges. Fixed value of the public format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LIMIT = 1024
#: Pre-tokens that a worker remembers, pre-tokens cut at a time from a long text, bytes of pre-tokens merged at a time.
REMEMBERED, AT_A_TIME, MERGED_BYTES = 800_000, 200_000, 1 << 22
_known: dict[str, dict[str, int]] = {}


def byte_symbols() -> dict[int, str]:
    """The character that stands for each byte: itself where it prints, else the next unused from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class ByteBpe:
    """The tables of a byte-level BPE file (tokenizers' JSON): small arrays that travel with a task."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        plain = pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and spec["normalizer"] is None
        if not plain or model["type"] != "BPE" or model.get("ignore_merges") or model.get("byte_fallback"):
            raise ValueError(f"not a plain byte-level BPE file: {path}")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings are not supported")
        vocab = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, made = (np.array([vocab[f(p)] for p in pairs]) for f in (lambda p: p[0], lambda p: p[1], lambda p: p[0] + p[1]))
        self.name = path
        self.table = MergeTable(left, right, np.arange(len(pairs)), made, max(vocab.values()) + 1)
        self.of_byte = np.array([vocab[c] for _, c in sorted(byte_symbols().items())], np.int32)
        self.added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)

    def count_pieces(self, pieces: list[str]) -> np.ndarray:
        """The number of tokens of each pre-token."""
        data = [p.encode("utf-8", "replace") for p in pieces]
        lengths = np.array([len(d) for d in data], np.int64)
        symbols = self.of_byte[np.frombuffer(b"".join(data), np.uint8)]
        return merged(self.table, symbols, lengths)[1]

    def learn(self, known: dict[str, int], pieces: set[str]) -> None:
        if len(known) + len(pieces) > REMEMBERED:
            known.clear()
        todo, size = [], 0
        for p in pieces:
            todo.append(p)
            size += len(p)
            if size > MERGED_BYTES:
                known.update(zip(todo, self.count_pieces(todo).tolist(), strict=True))
                todo, size = [], 0
        if todo:
            known.update(zip(todo, self.count_pieces(todo).tolist(), strict=True))

    def count_all(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        known, pattern = _known.setdefault(self.name, {}), regex.compile(PATTERN)
        special = regex.compile("|".join(map(regex.escape, self.added))) if self.added else None
        counts = [0] * len(texts)

        def add(parts: list[tuple[int, list[str]]]) -> None:
            new = set().union(*(p for _, p in parts))
            unknown = new.difference(known)
            if unknown:
                self.learn(known, unknown)
                if not new <= known.keys():  # the memory was emptied meanwhile
                    self.learn(known, new.difference(known))
            for k, p in parts:
                counts[k] += sum(map(known.__getitem__, p))

        waiting, size = [], 0
        for k, text in enumerate(texts):
            segments = [text]
            if special is not None and special.search(text):
                segments = special.split(text)
                counts[k] += len(segments) - 1
            for s in segments:
                if len(s) > 4 * AT_A_TIME:
                    found = (m.group() for m in pattern.finditer(s))
                    while part := list(islice(found, AT_A_TIME)):
                        add([(k, part)])
                    continue
                waiting.append((k, pattern.findall(s)))
                size += len(s)
                if size > 4 * AT_A_TIME:
                    add(waiting)
                    waiting, size = [], 0
        if waiting:
            add(waiting)
        return counts


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    Tokens are those of the file at ``path`` (read by the driver), without begin or end tokens; strings of its added
    tokens inside a text are one token each. Null and empty texts have none. Other columns are not read.
    """
    ship(docs.sparkSession)
    bpe = ByteBpe(path)

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(bpe.count_all(texts.tolist()), dtype="int64")

    counted = F.pandas_udf(count, "long")
    out = docs.select(F.col(doc_id).alias("doc_id"), F.octet_length(whole(text)).cast("long").alias("n_bytes"), counted(whole(text)).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
