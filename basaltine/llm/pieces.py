"""SentencePiece encoding and decoding by batched Viterbi on numpy arrays.

A text is cut into words at places that no piece crosses. The distinct words that a worker does not know yet are
encoded together: words of equal length form a matrix and advance together, one character at a time. At each end
position every piece length is tried at once: the rolling hash of the substring is looked up among the sorted hashes of
the pieces (and the characters compared), a path's score is that of its prefix plus the piece's, and the maximum leaves
a backpointer.

Two kinds of models. In a unigram model a piece adds its score. In a BPE model the sum of scores would choose other
pieces than the merges do; there the transition decides: a piece may follow another only if the two, joined, encode to
just these two, and a path whose neighbours all agree is the one the merges lead to. Which pairs agree is found by
merging them (see ``merges``) and remembered.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basaltine.llm.merges import MergeTable, merged
from basaltine.llm.ship import ship
from basaltine.llm.words import whole

SPACE = "▁"
#: Kinds of pieces and models: fixed values of the public file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: What an unknown character costs below the lowest score of a unigram model. Fixed value of the public library.
UNKNOWN_PENALTY = 10.0
#: Words that a worker remembers; characters of words in one matrix; characters of texts that are encoded together.
REMEMBERED, MATRIX, TOGETHER = 200_000, 1 << 18, 1 << 20
#: Odd factors: of the rolling hash, and of a bijection that spreads short strings over the buckets.
_HASH, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Pairs that a worker remembers; leading bits of a hash that find its bucket; texts that leave a task together.
PAIRS, BUCKET_BITS, ROWS = 2_000_000, 17, 256
_known: dict[str, tuple[dict[str, bytes], dict[str, bytes]]] = {}
_agree: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            yield number, varint()
        elif kind == 5:
            yield number, struct.unpack("<f", data[at : at + 4])[0]
            at += 4
        elif kind == 1:
            at += 8
        else:
            n = varint()
            yield number, data[at : at + n]
            at += n


class PieceModel:
    """The tables of a SentencePiece model: small arrays that travel with a task.

    Models that normalise, have user-defined or unused pieces, or treat spaces in another way are refused.
    """

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int, byte_fallback: bool, dummy_prefix: bool = True, name: str = ""):
        self.name, self.kind, self.dummy_prefix = name or str(hash(tuple(pieces))), kind, dummy_prefix
        text, score, sort = (list(c) for c in zip(*pieces, strict=True))
        if kind not in (UNIGRAM, BPE) or {USER_DEFINED, UNUSED} & set(sort):
            raise ValueError("only unigram and BPE models of normal pieces are supported")
        self.size = len(pieces)
        self.unknown = sort.index(UNKNOWN)
        self.byte_ids = [text.index(f"<0x{b:02X}>") for b in range(256)] if byte_fallback else None
        normal = [k for k in range(self.size) if sort[k] == NORMAL]
        if any(re.search(f"[^{SPACE}]{SPACE}", text[k]) for k in normal):
            raise ValueError("pieces with a space after other characters are not supported")
        self.of_text = {text[k]: k for k in normal}
        self.decoded = [bytes([self.byte_ids.index(k)]) if sort[k] == BYTE and byte_fallback else b"" if sort[k] == CONTROL else " ⁇ ".encode() if k == self.unknown else text[k].replace(SPACE, " ").encode() for k in range(self.size)]
        self.score = np.r_[np.array(score), min((score[k] for k in normal), default=0.0) - UNKNOWN_PENALTY]
        usable = normal
        if kind == BPE:
            self.table = self._merge_table(normal, score)
            singles = [k for k in normal if len(text[k]) == 1]
            self.of_char = {text[k]: k for k in singles}
            # a piece that its own characters do not merge to is never made
            chars = [[self.of_char.get(c, self.size) for c in text[k]] if sort[k] == NORMAL else [] for k in range(self.size)]
            self.char_size = np.array([len(c) for c in chars], np.int64)
            self.char_start = np.cumsum(self.char_size) - self.char_size
            self.char_flat = np.array(list(chain.from_iterable(chars)), np.int32)
            several = [k for k in normal if len(text[k]) > 1]
            flat = np.array(list(chain.from_iterable(chars[k] for k in several)), np.int32)
            left, n = merged(self.table, flat, np.array([len(chars[k]) for k in several]), first_only=True)
            ends = np.cumsum(n)
            usable = singles + [k for k, one, e in zip(several, n == 1, ends, strict=True) if one and left[e - 1] == k]
        self.longest = max((len(text[k]) for k in usable), default=1)
        codes = np.zeros((len(usable), self.longest), np.uint32)
        for row, k in enumerate(usable):
            codes[row, : len(text[k])] = [ord(c) for c in text[k]]
        length = np.array([len(text[k]) for k in usable])
        keys = np.array([self._hash(codes[r : r + 1, : length[r]])[0] for r in range(len(usable))], np.uint64)
        order = np.argsort(keys)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces have one hash")
        self.keys, self.length, self.ids = keys[order], length[order], np.array(usable)[order]
        self.bucket = np.searchsorted(self.keys >> np.uint64(64 - BUCKET_BITS), np.arange((1 << BUCKET_BITS) + 1, dtype=np.uint64))
        self.text_size = np.array([len(t) for t in text], np.int64)
        self.text_start = np.cumsum(self.text_size) - self.text_size
        self.text_flat = np.frombuffer("".join(text).encode("utf-32-le"), np.uint32)
        self.cut = self._cut([text[k] for k in usable if len(text[k]) > 1])

    @staticmethod
    def _cut(pieces: list[str]) -> str:
        """The pattern of words, between which no piece stands: the spaces before them and runs of letters or of marks.

        A mark that follows a letter in some piece counts as a letter; one that only precedes letters in pieces may
        begin a word. Characters that occur in no longer piece stand alone.
        """
        pairs = {p for t in pieces for p in zip(t, t[1:], strict=False) if SPACE not in p}
        joined = {c for t in pieces for c in t} - {SPACE}
        if not joined:
            return f"(?s:{SPACE}+|.)"
        letters = {c for c in joined if c.isalnum()}
        while more := {b for a, b in pairs if a in letters} - letters:
            letters |= more
        marks = joined - letters
        first = {a for a, b in pairs if a in marks and b in letters}

        def of(chars: set[str]) -> str:
            return "".join(map(re.escape, sorted(chars)))

        begin = f"(?:[{of(marks)}]*[{of(first)}])?" if first else ""
        options = ([f"{SPACE}*{begin}[{of(letters)}]+"] if letters else []) + ([f"{SPACE}*[{of(marks)}]+"] if marks else [])
        return "|".join([*options, f"{SPACE}+", f"[^{of(joined)}{SPACE}]"])

    @classmethod
    def load(cls, path: str) -> PieceModel:
        """The model in a file."""
        with open(path, "rb") as f:
            fields = list(_fields(f.read()))
        trainer, normaliser = ({n: v for m, d in fields if m == k for n, v in _fields(d)} for k in (2, 3))
        if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(5, 1) or trainer.get(24):
            raise ValueError("models that normalise text are not supported")
        pieces = []
        for number, data in fields:
            if number == 1:
                p = dict(_fields(data))
                pieces.append((p[1].decode(), p.get(2, 0.0), p.get(3, NORMAL)))
        return cls(pieces, trainer.get(3, UNIGRAM), bool(trainer.get(35)), bool(normaliser.get(3, 1)), path)

    def _merge_table(self, normal: list[int], score: list[float]) -> MergeTable:
        """Any two pieces that join to a piece merge; the higher the score, the earlier."""
        rank = {k: r for r, k in enumerate(sorted(normal, key=lambda k: -score[k]))}
        rows = []
        for t, k in self.of_text.items():
            for cut in range(1, len(t)):
                a, b = self.of_text.get(t[:cut]), self.of_text.get(t[cut:])
                if a is not None and b is not None:
                    rows.append((a, b, rank[k], k))
        left, right, ranks, made = np.array(rows or [(0, 0, 0, 0)]).T
        return MergeTable(left, right, ranks, made, self.size + 1)

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        h = np.zeros(codes.shape[0], np.uint64)
        for c in range(codes.shape[1]):
            h = h * _HASH + codes[:, c].astype(np.uint64) + np.uint64(1)
        return h * _SPREAD

    def _pairs_agree(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of pieces, joined, encodes to just these two. -1 as ``a``: nothing before."""
        good = np.ones(len(a), bool)
        asked = np.flatnonzero((a >= 0) & (a < self.size) & (b < self.size))
        if not len(asked):
            return good
        wanted, back = np.unique(a[asked] * self.size + b[asked], return_inverse=True)
        keys, known = _agree.get(self.name, (np.zeros(0, np.int64), np.zeros(0, bool)))
        at = np.searchsorted(keys, wanted)
        missing = np.ones(len(wanted), bool)
        inside = at < len(keys)
        missing[inside] = keys[at[inside]] != wanted[inside]
        answer = np.zeros(len(wanted), bool)
        answer[~missing] = known[at[~missing]]
        new = wanted[missing]
        if len(new):
            answer[missing] = found = self._join_and_merge(new // self.size, new % self.size)
            if len(keys) + len(new) > PAIRS:
                keys, known = new, found
            else:
                keys, known = np.insert(keys, at[missing], new), np.insert(known, at[missing], found)
            _agree[self.name] = keys, known
        good[asked] = answer[back]
        return good

    def _join_and_merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What the merges of two pieces' characters, joined, say of each pair."""
        out = []
        for k in range(0, len(a), MATRIX // 8):
            x, y = a[k : k + MATRIX // 8], b[k : k + MATRIX // 8]
            sizes = self.char_size[x] + self.char_size[y]
            two = np.stack([x, y], axis=1).ravel()
            n = self.char_size[two]
            flat = self.char_flat[np.repeat(self.char_start[two] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            left, n = merged(self.table, flat, sizes, first_only=True)
            end = np.cumsum(n)
            out.append((n == 2) & (left[end - 2] == x) & (left[end - 1] == y))
        return np.concatenate(out)

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are pieces', and the pieces' places among the sorted keys."""
        bucket = (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        at = self.bucket[bucket]
        stop = self.bucket[bucket + 1]
        open_ = np.flatnonzero(at < stop)
        where, found = [], []
        while len(open_):
            same = self.keys[at[open_]] == h[open_]
            where.append(open_[same])
            found.append(at[open_[same]])
            open_ = open_[~same]
            at[open_] += 1
            open_ = open_[at[open_] < stop[open_]]
        return (np.concatenate(where), np.concatenate(found)) if where else (at[:0], at[:0])

    def _viterbi(self, codes: np.ndarray) -> list[bytes]:
        """The ids (int32) of each row of a matrix of words of one length; unknown characters have the id ``size``."""
        n, length = codes.shape
        prefix = np.zeros((length + 1, n), np.uint64)
        power = np.ones((self.longest + 1, 1), np.uint64)
        for e in range(length):
            prefix[e + 1] = prefix[e] * _HASH + codes[:, e].astype(np.uint64) + np.uint64(1)
        for k in range(self.longest):
            power[k + 1] = power[k] * _HASH
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0.0
        piece = np.full((length + 1, n), -1, np.int64)
        back = np.zeros((length + 1, n), np.int64)
        for e in range(1, length + 1):
            spans = np.arange(min(e, self.longest), 0, -1)
            h = prefix[e] - prefix[e - spans] * power[spans]
            where, at = self._find(h.ravel() * _SPREAD)
            s, w = np.divmod(where, n)
            fits = self.length[at] == spans[s]
            ids = np.full(h.shape, -1, np.int64)
            ids[s[fits], w[fits]] = self.ids[at[fits]]
            lone = ids[-1] < 0  # a character that is no piece
            ids[-1, lone] = self.size
            if self.kind == UNIGRAM:
                gain = np.where(ids >= 0, best[e - spans] + self.score[ids], -np.inf)
                top = np.argmax(gain, axis=0)
            else:
                # just one piece agrees with what is before it
                gain = np.where(ids >= 0, best[e - spans], -np.inf)
                s, w = np.nonzero(gain == 0.0)
                gain[s, w] = np.where(self._pairs_agree(piece[e - spans[s], w], ids[s, w]), 0.0, -np.inf)
                top = np.argmax(gain, axis=0)
            row = np.arange(n)
            best[e], piece[e], back[e] = gain[top, row], ids[top, row], e - spans[top]
        steps, end = [], np.full(n, length)
        row = np.arange(n)
        while end.any():
            steps.append(np.where(end > 0, piece[end, row], -1))
            end = np.where(end > 0, back[end, row], 0)
        path = np.array(steps[::-1], np.int32).reshape(-1, n).T
        used = path >= 0
        self._check(codes, path, used)
        flat, ends = path[used], np.cumsum(used.sum(axis=1)).tolist()
        data = flat.tobytes()
        return [data[4 * a : 4 * b] for a, b in zip([0, *ends], ends, strict=False)]

    def _check(self, codes: np.ndarray, path: np.ndarray, used: np.ndarray) -> None:
        """That the pieces of each path spell its word: hashes alone decide nothing."""
        ids = path[used]
        sizes = np.where(ids < self.size, self.text_size[np.minimum(ids, self.size - 1)], 1)
        total = np.bincount(np.nonzero(used)[0], sizes, len(codes))
        spelled = self.text_flat[np.repeat(self.text_start[np.minimum(ids, self.size - 1)] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
        known = np.repeat(ids < self.size, sizes)
        if (total != codes.shape[1]).any() or (spelled[known] != codes.ravel()[known]).any():
            raise ValueError("the hash of a piece met that of another string")

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids (int32) of each word, unknown characters as their bytes (or the unknown piece)."""
        out: list[bytes] = [b""] * len(words)
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w), []).append(k)
        other = np.int32(self.size).tobytes()
        for length, group in by_length.items():
            step = max(1, MATRIX // max(1, length))
            for at in range(0, len(group), step):
                part = group[at : at + step]
                codes = np.frombuffer("".join(words[k] for k in part).encode("utf-32-le", "replace"), np.uint32).reshape(len(part), length)
                for k, ids in zip(part, self._viterbi(codes), strict=True):
                    out[k] = self._unknown(words[k], ids) if other in ids else ids
        return out

    def _unknown(self, word: str, ids: bytes) -> bytes:
        at, out = 0, []
        for k in np.frombuffer(ids, np.int32).tolist():
            if k < self.size:
                out.append(k)
                at += int(self.text_size[k])
            else:
                out += [self.byte_ids[b] for b in word[at].encode()] if self.byte_ids else [self.unknown]
                at += 1
        return np.array(out, np.int32).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; new words of many texts are encoded together."""
        out: list[np.ndarray] = []
        cut, prefix = re.compile(self.cut), SPACE if self.dummy_prefix else ""
        waiting: list[list[str]] = []
        size = 0
        for text in texts:
            waiting.append(cut.findall(prefix + text.replace(" ", SPACE)) if text else [])
            size += len(text)
            if size > TOGETHER:
                out += self._ids(waiting)
                waiting, size = [], 0
        return out + self._ids(waiting)

    def _ids(self, texts: list[list[str]]) -> list[np.ndarray]:
        known, older = _known.get(self.name, ({}, {}))
        every = set(chain.from_iterable(texts))
        new = every.difference(known)
        if len(known) + len(new) > REMEMBERED // 2:
            # what has not been met since the last time goes
            known, older, new = {}, known, every
        known.update((w, older[w]) for w in new if w in older)
        todo = [w for w in new if w not in older]
        known.update(zip(todo, self.encode_words(todo), strict=True))
        _known[self.name] = known, older
        return [np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32) for words in texts]

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids; bytes that are no UTF-8 become U+FFFD."""
        return _decode(self.decoded, self.dummy_prefix, ids)


def _decode(pieces: list[bytes], dummy_prefix: bool, ids: np.ndarray) -> str:
    text = b"".join(map(pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")
    return text[1:] if dummy_prefix and text.startswith(" ") else text


def encoded(model: PieceModel, text: Column) -> Column:
    """array<int>: the ids of a text; none of a null or empty text."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            for at in range(0, len(texts), ROWS):
                yield pd.Series(model.encode(texts.iloc[at : at + ROWS].tolist()), dtype=object)

    return F.pandas_udf(run, "array<int>")(whole(text))


def decoded(model: PieceModel, ids: Column) -> Column:
    """The text of an array of ids."""

    pieces, dummy_prefix = model.decoded, model.dummy_prefix

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for arrays in batches:
            for at in range(0, len(arrays), ROWS):
                yield pd.Series([_decode(pieces, dummy_prefix, np.asarray(a)) for a in arrays.iloc[at : at + ROWS]], dtype=object)

    return F.pandas_udf(run, "string")(ids)


def encode_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids``, the pieces of each whole text; a column of that name is replaced."""
    ship(docs.sparkSession)
    model = PieceModel.load(path)
    return docs.withColumn("ids", encoded(model, docs[text]))


def decode_documents(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text that the ids stand for."""
    ship(docs.sparkSession)
    model = PieceModel.load(path)
    return docs.withColumn(text, decoded(model, docs[ids]))
