"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE_WORDS words, all of them, to the end of the text. Each passage is encoded:
shares of character classes, shapes of its words, how much of it repeats within itself and within the document so far,
and hashed words. A small network maps the code to a hidden vector, gated attention (a tanh branch times a sigmoid
branch) weighs the passages of the document, and the score is a logistic function of the weighted sum. Only document
labels are known; the attention learns which passages they hang on.

Fitting uses a bounded sample of labelled documents, FIT_DOCS of them drawn by a hash of the id. The sampled labels are
few, by that bound, and are broadcast to pick the texts; passages are encoded in tasks, and only the sample's codes, one
text for each id, come to the driver, where the network is trained. Scoring has no shuffle: each text is encoded and scored in Arrow batches.

Cases: a text that is null or empty is one empty passage and gets a score like any other. Documents with a null label,
or a null id, don't train; an id with several labels trains with each, one with several texts with the first by hash. If no label is there, or only one kind, the score
is the share of label 1 (0.5 without any). Each row is scored for itself, so ties and repeats don't matter. Extra columns
pass through untouched unless they bear the name of an output column, which then replaces them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PASSAGE_WORDS = 64
FIT_DOCS = 6000
HIDDEN = 24
GATE = 12
HASHED = 16

#: Characters and rows encoded at once; bounds the memory of a task.
BLOCK_CHARS, BLOCK_ROWS = 1 << 19, 256

SPACE, LOWER, UPPER, LETTER, DIGIT, POINT, QUOTE, SYMBOL = range(8)
CLASSES = 8


def _classes() -> np.ndarray:
    out = np.full(1 << 16, SYMBOL, np.uint8)
    for c in range(1 << 16):
        ch = chr(c)
        if ch.isspace():
            out[c] = SPACE
        elif ch.islower():
            out[c] = LOWER
        elif ch.isupper():
            out[c] = UPPER
        elif ch.isalpha():
            out[c] = LETTER
        elif ch.isdigit():
            out[c] = DIGIT
        elif ch in ".,;:?-":
            out[c] = POINT
        elif ch in "'\"()":
            out[c] = QUOTE
    return out


_CLASS = _classes()
_MARK = np.uint64(0x9E3779B97F4A7C15)


def _blocks(texts: Iterable[str]) -> Iterator[list[str]]:
    block, chars = [], 0
    for t in texts:
        if block and (chars + len(t) > BLOCK_CHARS or len(block) == BLOCK_ROWS):
            yield block
            block, chars = [], 0
        block.append(t)
        chars += len(t)
    if block:
        yield block


def _first_seen(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether each place is the first with its (group, key)."""
    order = np.lexsort((np.arange(len(key)), key, group))
    new = np.ones(len(key), bool)
    new[1:] = (group[order][1:] != group[order][:-1]) | (key[order][1:] != key[order][:-1])
    out = np.empty(len(key), bool)
    out[order] = new
    return out


def encode(block: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the passages of a block of texts, and the text that each belongs to."""
    size = np.array([len(t) + 1 for t in block])
    doc = np.repeat(np.arange(len(block)), size)
    code = np.frombuffer(("\n".join(block) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _CLASS[np.minimum(code, 0xFFFF)]
    inside = kind != SPACE
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    word_at = np.flatnonzero(starts)
    word_doc = doc[word_at]
    words = np.bincount(word_doc, minlength=len(block))
    passages = np.maximum(1, -(-words // PASSAGE_WORDS))
    first_passage = np.cumsum(passages) - passages
    first_word = np.cumsum(words) - words
    word_passage = first_passage[word_doc] + (np.arange(len(word_at)) - first_word[word_doc]) // PASSAGE_WORDS
    n = int(passages.sum())
    char_word = np.cumsum(starts) - 1
    # white space before a document's first word belongs to its first passage
    own = (char_word >= 0) & (doc == (word_doc[np.maximum(char_word, 0)] if len(word_at) else -1))
    char_passage = np.where(own, word_passage[np.maximum(char_word, 0)] if len(word_at) else 0, first_passage[doc])
    counts = np.bincount(char_passage * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES).astype(np.float64)
    lines = np.bincount(char_passage[code == 10], minlength=n)
    bangs = np.bincount(char_passage[code == 33], minlength=n)
    out = np.zeros((n, 20 + HASHED), np.float32)
    chars = np.maximum(counts.sum(axis=1), 1)
    letters = np.maximum(counts[:, LOWER] + counts[:, UPPER] + counts[:, LETTER], 1)
    out[:, 0] = counts[:, UPPER] / letters
    out[:, 1] = counts[:, DIGIT] / chars * 5
    out[:, 2] = counts[:, POINT] / chars * 10
    out[:, 3] = counts[:, SYMBOL] / chars * 5
    out[:, 4] = bangs / chars * 10
    out[:, 5] = counts[:, QUOTE] / chars * 10
    out[:, 6] = lines / chars * 20
    out[:, 7] = counts[:, LETTER] / chars
    out[:, 8] = letters / chars
    out[:, 19] = np.log1p(words)[np.repeat(np.arange(len(block)), passages)] / 8
    if len(word_at):
        in_word, w = np.flatnonzero(inside), char_word[inside]
        step = (in_word - word_at[w]).astype(np.uint64)
        low = np.where(kind[in_word] == UPPER, code[in_word] + 32, code[in_word]).astype(np.uint64)
        mixed = (low + np.uint64(1)) * (_MARK * (np.uint64(2) * step + np.uint64(1)))
        mixed ^= mixed >> np.uint64(29)
        edge = np.searchsorted(w, np.arange(len(word_at)))
        key = np.add.reduceat(mixed, edge) * _MARK
        length = np.bincount(w, minlength=len(word_at))
        of = lambda what: np.bincount(w[kind[in_word] == what], minlength=len(word_at))
        upper, symbols = of(UPPER), of(SYMBOL)
        held = np.bincount(word_passage, minlength=n)
        per = np.maximum(held, 1)
        mean = lambda x: np.bincount(word_passage, weights=x.astype(float), minlength=n) / per
        out[:, 9] = mean(length) / 10
        out[:, 10] = np.sqrt(np.maximum(mean(length.astype(float) ** 2) - mean(length) ** 2, 0)) / 10
        out[:, 11] = mean((upper >= 2) & (upper >= 0.7 * length))
        out[:, 12] = mean(symbols >= 1)
        out[:, 13] = mean(symbols >= 2)
        out[:, 14] = mean(_first_seen(word_passage, key))
        out[:, 15] = mean(_first_seen(word_doc, key))
        line = np.cumsum(code == 10)
        word_line = line[word_at]
        edge_line = np.flatnonzero(np.r_[True, word_line[1:] != word_line[:-1]])
        rank = (np.arange(len(word_at)) - edge_line[np.cumsum(np.r_[False, word_line[1:] != word_line[:-1]])]).astype(np.uint64)
        line_key = np.add.reduceat(key * (np.uint64(2) * rank + np.uint64(1)), edge_line)
        new_line = _first_seen(word_doc[edge_line], line_key)
        spread = np.cumsum(np.r_[False, word_line[1:] != word_line[:-1]])
        out[:, 16] = mean(new_line[spread])
        pair = key[:-1] * np.uint64(3) + key[1:] if len(key) > 1 else key[:0]
        new_pair = np.ones(len(key), bool)
        if len(pair):
            new_pair[1:] = _first_seen(word_doc[1:], pair) | (word_doc[1:] != word_doc[:-1])
        out[:, 17] = mean(new_pair)
        out[:, 18] = held / PASSAGE_WORDS
        hashed = np.bincount(word_passage * HASHED + (key >> np.uint64(60)).astype(np.int64) % HASHED, minlength=n * HASHED)
        out[:, 20:] = hashed.reshape(n, HASHED) / per[:, None]
    return out, np.repeat(np.arange(len(block)), passages)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None

    def forward(self, codes: np.ndarray, bag: np.ndarray) -> dict[str, np.ndarray]:
        """bag: the document of each passage, in ascending order without gaps."""
        p = self.weights
        x = np.clip((codes - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ p["w"] + p["b"])
        v, u = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        e = (v * u) @ p["a"]
        edge = np.flatnonzero(np.r_[True, bag[1:] != bag[:-1]])
        e = np.exp(e - np.maximum.reduceat(e, edge)[bag])
        attention = e / np.add.reduceat(e, edge)[bag]
        z = np.add.reduceat(attention[:, None] * h, edge)
        return {"x": x, "h": h, "v": v, "u": u, "attention": attention, "z": z, "score": _sigmoid(z @ p["c"] + p["c0"])}

    def score(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        for block in _blocks(texts):
            if self.constant is not None:
                yield np.full(len(block), self.constant)
            else:
                yield self.forward(*encode(block))["score"]


def train(codes: np.ndarray, bag: np.ndarray, labels: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 0.01, decay: float = 1e-4) -> Model:
    """Adam on the log loss of whole bags. bag: ascending document numbers from 0, one for each passage."""
    if len(labels) == 0 or labels.min() == labels.max():
        return Model(np.zeros(1), np.ones(1), {}, float(labels.mean()) if len(labels) else 0.5)
    rng = np.random.default_rng(7)
    d = codes.shape[1]
    draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    share = labels.mean()
    p = {"w": draw(d, HIDDEN), "b": np.zeros(HIDDEN), "v": draw(HIDDEN, GATE), "u": draw(HIDDEN, GATE), "a": np.zeros(GATE) + draw(GATE), "c": draw(HIDDEN), "c0": np.array(np.log(share / (1 - share)))}
    model = Model(codes.mean(axis=0), codes.std(axis=0) + 0.02, p)
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    edge = np.searchsorted(bag, np.arange(len(labels) + 1))
    t = 0
    for epoch in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            docs = order[at : at + batch]
            rows = np.concatenate([np.arange(edge[i], edge[i + 1]) for i in docs])
            own = np.repeat(np.arange(len(docs)), edge[docs + 1] - edge[docs])
            f = model.forward(codes[rows], own)
            delta = (f["score"] - labels[docs]) / len(docs)
            g = {"c": f["z"].T @ delta, "c0": delta.sum()}
            dz = delta[:, None] * p["c"]
            da = (dz[own] * f["h"]).sum(axis=1)
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            de = f["attention"] * (da - np.add.reduceat(f["attention"] * da, starts)[own])
            g["a"] = (f["v"] * f["u"]).T @ de
            dgate = de[:, None] * p["a"]
            dv, du = dgate * f["u"] * (1 - f["v"] ** 2), dgate * f["v"] * f["u"] * (1 - f["u"])
            g["v"], g["u"] = f["h"].T @ dv, f["h"].T @ du
            dh = (f["attention"][:, None] * dz[own] + dv @ p["v"].T + du @ p["u"].T) * (1 - f["h"] ** 2)
            g["w"], g["b"] = f["x"].T @ dh, dh.sum(axis=0)
            t += 1
            step = rate * (1 - epoch / epochs)
            for k in p:
                grad = g[k] + decay * p[k]
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad**2
                p[k] = p[k] - step * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return model


def _encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        at = 0
        for block in _blocks(t or "" for t in batch["text"]):
            codes, bag = encode(block)
            edge = np.searchsorted(bag, np.arange(len(block) + 1))
            yield pd.DataFrame({"label": batch["label"].to_numpy()[at : at + len(block)], "codes": [codes[a:b].tobytes() for a, b in zip(edge, edge[1:])]})
            at += len(block)


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """The model of at most about fit_docs labelled documents."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("label")).distinct()
    share = min(1.0, fit_docs / max(1, known.count()))
    draw = F.pmod(F.xxhash64("_id", F.lit("quality fit")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.where(draw < share)
    rows = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
        .join(F.broadcast(sample.select("_id").distinct()), "_id")
        .groupBy("_id")
        .agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # an id that documents repeat counts once
        .join(F.broadcast(sample), "_id")
        .select("label", "text")
        .mapInPandas(_encoded, "label double, codes binary")
        .collect()
    )
    rows.sort(key=lambda r: (bytes(r["codes"]), r["label"]))
    bags = [np.frombuffer(r["codes"], np.float32).reshape(-1, 20 + HASHED) for r in rows]
    labels_of = np.array([r["label"] for r in rows])
    if not bags:
        return train(np.zeros((0, 20 + HASHED)), np.zeros(0, int), labels_of)
    return train(np.concatenate(bags).astype(np.float64), np.repeat(np.arange(len(bags)), [len(b) for b in bags]), labels_of)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with score, the probability of label 1."""
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = list(shared.value.score(t or "" for t in texts))
            yield pd.Series(np.concatenate(parts) if parts else [], dtype=float)

    return docs.withColumn("score", scored(F.col(text_col)))
