"""Toxic spans and document scores by a linear-chain conditional random field.

Labels are given per document. From a bounded sample of labelled documents, words and word beginnings that come in far
more toxic than clean documents label the tokens of the toxic ones; a two-state chain over hashed word features is
fitted to these tokens, and a logistic function of its marginals to the documents. Scoring runs forward-backward over
all tokens of a text, whatever its length: the chains of a batch advance together, one token at a time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basaltine.llm.scratch import saved
from basaltine.llm.ship import ship
from basaltine.llm.words import whole

#: Bounds of the sample that the model is fitted on: toxic and clean documents, and bytes of their texts in all.
TOXIC, CLEAN, SAMPLE_BYTES = 1500, 3000, 64 << 20
#: Hashed features, lengths of word beginnings, tokens in a training chain, training rounds.
FEATURES, BEGINNINGS, CHAIN, ROUNDS = 1 << 18, (3, 4, 5, 6), 64, 80
#: A word or beginning labels tokens where its likelihood ratio is at least this, and it is this much likelier in toxic documents.
LIKELIHOOD, LIFT = 14.0, 8.0
#: Words that a worker remembers, tokens that are scored together, texts that leave a task together.
REMEMBERED, TOGETHER, ROWS = 300_000, 1 << 20, 512
TOKEN = re.compile(r"\w+")
_known: dict[str, dict[str, float]] = {}


def _marks(word: str) -> list[str]:
    """A word and its beginnings."""
    low = word.lower()
    return ["=" + low] + ["^" + low[:n] for n in BEGINNINGS if len(low) >= n]


def _features(word: str) -> list[int]:
    marks = _marks(word)
    marks += [""] * (len(BEGINNINGS) + 1 - len(marks)) + ["$" + word.lower()[-3:]]
    return [xxhash.xxh32_intdigest(m) % FEATURES for m in marks]


def chains(emit: np.ndarray, lengths: np.ndarray, start: float, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log odds of the second state at every token of some chains.

    ``emit``: log odds of each token, one chain after another; ``trans``: 2 x 2 log weights of moves.
    """
    (a00, a01), (a10, a11) = np.exp(trans)
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    size = lengths[order]
    alive = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")  # chains longer than t
    ahead, behind = np.empty(len(emit)), np.zeros(len(emit))
    for t, n in enumerate(alive):
        at = first[:n] + t
        if t:
            r = np.exp(ahead[at - 1])
            ahead[at] = np.clip(emit[at] + np.log((a01 + a11 * r) / (a00 + a10 * r)), -60, 60)
        else:
            ahead[at] = np.clip(emit[at] + start, -60, 60)
    for t in range(len(alive) - 2, -1, -1):
        at = first[: alive[t + 1]] + t
        r = np.exp(np.clip(emit[at + 1] + behind[at + 1], -60, 60))
        behind[at] = np.log((a10 + a11 * r) / (a00 + a01 * r))
    return ahead, behind


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class ToxicModel:
    """The fitted chain and document function; its arrays have a fixed size and travel with a task."""

    def __init__(self, weights: np.ndarray, start: float, trans: np.ndarray, document: np.ndarray):
        self.weights, self.start, self.trans, self.document = weights, start, trans, document
        #: What a worker remembers of words follows from the weights, so their digest names it.
        self.name = xxhash.xxh3_128_hexdigest(weights.tobytes())

    def emission(self, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        if self.name not in _known:
            _known.clear()  # of an earlier model
        known = _known.setdefault(self.name, {})
        every = set().union(*words) if words else set()
        new = every.difference(known)
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = every
        if new:
            todo = list(new)
            ids = np.array([_features(w) for w in todo])
            known.update(zip(todo, self.weights[ids].sum(axis=1).tolist(), strict=True))
        lengths = np.array([len(w) for w in words], np.int64)
        return np.fromiter((known[w] for ws in words for w in ws), np.float64, int(lengths.sum())), lengths

    def marginals(self, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The probability that each token is toxic, and the tokens of each text."""
        emit, lengths = self.emission(words)
        ahead, behind = chains(emit, lengths, self.start, self.trans)
        return _sigmoid(ahead + behind), lengths

    def score(self, texts: list[str]) -> tuple[list[float], list[list[tuple[int, int]]]]:
        """For each text its score and the places (start, end) of runs of toxic tokens."""
        scores: list[float] = []
        spans: list[list[tuple[int, int]]] = []
        waiting: list[list[str]] = []
        size = 0
        for text in texts:
            waiting.append(TOKEN.findall(text))
            size += len(waiting[-1])
            if size > TOGETHER:
                self._add(texts, waiting, scores, spans)
                waiting, size = [], 0
        self._add(texts, waiting, scores, spans)
        return scores, spans

    def _add(self, texts: list[str], words: list[list[str]], scores: list, spans: list) -> None:
        p, lengths = self.marginals(words)
        ends = np.cumsum(lengths)
        value = _sigmoid(_summary(p, lengths) @ self.document)
        for k, (n, e) in enumerate(zip(lengths.tolist(), ends.tolist(), strict=True)):
            hot = np.flatnonzero(p[e - n : e] >= 0.5)
            found: list[tuple[int, int]] = []
            if len(hot):
                places = [m.span() for m in TOKEN.finditer(texts[len(scores)])]
                last = -2
                for h in hot.tolist():
                    if h == last + 1:
                        found[-1] = (found[-1][0], places[h][1])
                    else:
                        found.append(places[h])
                    last = h
            scores.append(float(value[k]))
            spans.append(found)


def _summary(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What a document's score depends on: the largest marginal, their sum, the length."""
    most, total = np.full(len(lengths), 1e-6), np.zeros(len(lengths))
    some = lengths > 0
    if some.any():
        at = (np.cumsum(lengths) - lengths)[some]
        most[some], total[some] = np.maximum.reduceat(p, at), np.add.reduceat(p, at)
    most = np.clip(most, 1e-6, 1 - 1e-6)
    return np.c_[np.ones(len(lengths)), np.log(most / (1 - most)) / 4, np.log(1e-3 + total), np.log1p(lengths) / 4]


def _toxic_marks(texts: list[str], toxic: np.ndarray) -> set[str]:
    """Words and beginnings that are far likelier in toxic documents; texts are read one at a time."""

    def of(text: str) -> set[str]:
        return {m for w in set(TOKEN.findall(text)) for m in _marks(w)}

    counts: Counter = Counter()
    for t in np.flatnonzero(toxic):
        counts.update(of(texts[t]))
    # rarer ones cannot reach the likelihood ratio
    counts = Counter({m: n for m, n in counts.items() if n >= 3})
    clean: Counter = Counter()
    for t in np.flatnonzero(~toxic):
        clean.update(of(texts[t]) & counts.keys())
    n1, n0 = toxic.sum(), (~toxic).sum()
    marks = list(counts)
    k1 = np.array([counts[m] for m in marks], float)
    k0 = np.array([clean[m] for m in marks], float)

    def part(k: np.ndarray, n: float, q: np.ndarray) -> np.ndarray:
        return k * np.log(np.maximum(k / n, 1e-12) / q) + (n - k) * np.log(np.maximum(1 - k / n, 1e-12) / np.maximum(1 - q, 1e-12))

    q = (k1 + k0) / (n1 + n0)
    ratio = 2 * (part(k1, n1, q) + part(k0, n0, q))
    lift = ((k1 + 0.1) / n1) / ((k0 + 0.1) / n0)
    return {m for m, r, x in zip(marks, ratio, lift, strict=True) if r >= LIKELIHOOD and x >= LIFT}


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Newton's method with a small ridge."""
    beta = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [1e-2] * (x.shape[1] - 1)) * weight.sum() / len(y)
    for _ in range(30):
        p = _sigmoid(x @ beta)
        g = x.T @ (weight * (y - p)) - ridge @ beta
        h = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + ridge
        step = np.linalg.solve(h, g)
        beta += step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
    return beta


def fit(texts: list[str], labels: list[int], weight: tuple[float, float] = (1.0, 1.0), rounds: int = ROUNDS) -> ToxicModel:
    """A model from texts labelled 0 or 1; ``weight``: what a clean and a toxic text stand for in the corpus."""
    toxic = np.array(labels, bool)
    trans0, start0 = np.array([[0.0, -3.0], [-0.5, -1.0]]), -3.0
    weights = np.zeros(FEATURES)
    document = np.array([-3.0, 0, 0, 0])
    if toxic.all() or not toxic.any():
        return ToxicModel(weights, start0, trans0, np.array([4.0 if len(labels) and toxic.all() else -4.0, 0, 0, 0]))
    marks = _toxic_marks(texts, toxic)
    ids: dict[str, int] = {}
    flat = [np.array([ids.setdefault(w, len(ids)) for w in TOKEN.findall(t)], np.int32) for t in texts]
    feats = np.array([_features(w) for w in ids], np.int32).reshape(len(ids), len(BEGINNINGS) + 2)
    is_toxic = np.array([not marks.isdisjoint(_marks(w)) for w in ids], bool)
    tokens, tags, lengths = [], [], []
    for x, t, text in zip(flat, toxic, texts, strict=True):
        # every chain with a toxic token, and one of each text by a hash of the whole text
        drawn = xxhash.xxh32_intdigest(text) % max(1, -(-len(x) // CHAIN)) * CHAIN
        for at in range(0, len(x), CHAIN):
            part = x[at : at + CHAIN]
            tag = is_toxic[part] & t
            if tag.any() or at == drawn:
                tokens.append(part)
                tags.append(tag)
                lengths.append(len(part))
    token, tag, length = np.concatenate(tokens), np.concatenate(tags), np.array(lengths)
    del ids, tokens, tags
    first = np.zeros(len(token), bool)
    first[np.cumsum(length) - length] = True
    inner = np.flatnonzero(~first)
    seen_moves = np.array([[(~tag[inner - 1] & ~tag[inner]).sum(), (~tag[inner - 1] & tag[inner]).sum()], [(tag[inner - 1] & ~tag[inner]).sum(), (tag[inner - 1] & tag[inner]).sum()]], float)
    start, trans = start0, trans0.copy()
    m, v = np.zeros(FEATURES + 5), np.zeros(FEATURES + 5)
    for k in range(1, rounds + 1):
        per_word = weights[feats].sum(axis=1)
        emit = per_word[token]
        ahead, behind = chains(emit, length, start, trans)
        p = _sigmoid(ahead + behind)
        off = tag - p
        by_word = np.bincount(token, off, len(feats))
        g_w = np.bincount(feats.ravel(), np.repeat(by_word, feats.shape[1]), FEATURES) - 0.02 * weights
        before, after = ahead[inner - 1], emit[inner] + behind[inner]
        logs = np.stack([np.zeros(len(inner)) + trans[0, 0], trans[0, 1] + after, trans[1, 0] + before, trans[1, 1] + before + after])
        e = np.exp(logs - logs.max(axis=0))
        moves = (e / e.sum(axis=0)).sum(axis=1).reshape(2, 2)
        g_t = (seen_moves - moves).ravel() - 0.02 * trans.ravel()
        g_t[0] = 0.0
        g = np.r_[g_w, g_t, off[first].sum() - 0.02 * start]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.25 * (1 - k / (rounds + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        weights += step[:FEATURES]
        trans += step[FEATURES : FEATURES + 4].reshape(2, 2)
        start += step[-1]
    model = ToxicModel(weights.astype(np.float32), float(start), trans, document)
    per_word, seen = model.weights[feats].sum(axis=1, dtype=np.float64), []
    for at in range(0, len(flat), 500):
        part = flat[at : at + 500]
        sizes = np.array([len(x) for x in part])
        ahead, behind = chains(per_word[np.concatenate(part)], sizes, model.start, model.trans)
        seen.append(_summary(_sigmoid(ahead + behind), sizes))
    model.document = _logistic(np.concatenate(seen), toxic.astype(float), np.where(toxic, weight[1], weight[0]))
    return model


def labelled_sample(
    docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN, most_bytes: int = SAMPLE_BYTES, doc_id: str = "doc_id", text: str = "text"
) -> tuple[list[str], list[int], tuple[float, float]]:
    """Texts, labels and the weights of the classes: at most ``toxic`` and ``clean`` documents, by a hash of the id.

    Of these, in the order of the hash, as many whole texts as ``most_bytes`` hold go to the driver (always the first).
    Null labels are left out; of several labels of a document the largest counts.
    """
    marked = labels.where("toxic is not null").groupBy(F.col("doc_id").alias("i")).agg((F.max("toxic") > 0).alias("t")).withColumn("h", F.xxhash64("i"))
    count = {r["t"]: r["count"] for r in marked.groupBy("t").count().collect()}
    parts = [marked.where(F.col("t") if t else ~F.col("t")).orderBy("h", "i").limit(n) for t, n in ((True, toxic), (False, clean))]
    chosen = parts[0].unionAll(parts[1]).select("i", "t", "h")
    # at most toxic + clean ids
    found = docs.select(F.col(doc_id).alias("doc"), whole(text).alias("text")).join(F.broadcast(chosen), F.col("doc") == F.col("i"))
    # of rows that share an id, the least text
    found = saved(found.groupBy("i", "t", "h").agg(F.min("text").alias("text")).select("*", F.octet_length("text").cast("long").alias("bytes")))
    order = Window.orderBy("h", "i").rowsBetween(Window.unboundedPreceding, -1)
    upto = found.select("i", "bytes", F.coalesce(F.sum("bytes").over(order), F.lit(0)).alias("before"))
    fit_in = upto.where((F.col("before") == 0) | (F.col("before") + F.col("bytes") <= most_bytes)).select("i")
    rows = found.join(F.broadcast(fit_in), "i").select("i", "t", "text").toPandas().sort_values("i")
    y = rows["t"].astype(int).tolist()
    weight = tuple(count.get(bool(t), 0) / max(1, y.count(t)) for t in (0, 1))
    return rows["text"].tolist(), y, weight


def scored(model: ToxicModel, text: Column) -> Column:
    """struct<score double, spans array<struct<start long, end long>>> of a text; null counts as empty."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            for at in range(0, len(texts), ROWS):
                scores, spans = model.score(texts.iloc[at : at + ROWS].tolist())
                yield pd.DataFrame({"score": scores, "spans": [[{"start": a, "end": b} for a, b in s] for s in spans]})

    kind = "struct<score: double, spans: array<struct<start: bigint, end: bigint>>>"
    return F.pandas_udf(run, kind)(whole(text))


def toxicity(docs: DataFrame, model: ToxicModel, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``spans`` (places of toxic words, in code points); such columns are replaced.

    Empty texts and texts without words get the score of no evidence. An empty table stays empty.
    """
    ship(docs.sparkSession)
    own = [F.col("d").getField(c).alias(c) for c in docs.columns if c not in ("score", "spans")]
    return docs.select(F.struct("*").alias("d"), scored(model, docs[text]).alias("s")).select(*own, "s.score", "s.spans")
