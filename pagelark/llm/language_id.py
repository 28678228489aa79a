"""Language identification by the nearest of several centroids for each language.

A text becomes a vector of hashed character n-grams (one to three characters, letters in lower case, all else one
space), weighted log(1 + tf) x idf and scaled to length one. The document frequencies come from all training documents.
Spherical k-means then makes a few centroids for each language from a bounded sample of that language's training texts
(`FIT_ROWS` for each language at most, those first in order of a hash of key and text), one task for each language. Texts
become vectors where they are read, so what that task gets has a fixed size whatever the texts' lengths. A text gets the language of the centroid
with the highest cosine. A centroid also carries the cosine below which hardly any of its own members fall; a text
farther away than that is marked as not accepted.

The frequencies (one number for each of DIM features) and the centroids (languages x CENTROIDS x DIM numbers) are of
fixed size for a given set of languages; they alone pass through the driver. Scoring has no shuffle.

Cases: a text that is null or has no letter gets `und` with score 0. Texts are read whole. Training skips null
languages; with no training rows at all every text gets `und`. Each row stands for itself, so null or repeated ids don't
matter. Extra columns pass through untouched unless they bear the name of an output column, which then replaces them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIM = 1 << 13
CENTROIDS = 4
FIT_ROWS = 1200
UNKNOWN = "und"

#: Characters and rows of one block of vectors; bounds the memory of a task.
BLOCK_CHARS, BLOCK_ROWS = 1 << 20, 256

_LETTER = np.array([chr(c).isalpha() for c in range(1 << 16)])
_MIX = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


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


def counts(block: list[str]) -> np.ndarray:
    """Hashed n-gram counts, one row for each text."""
    low = [f" {t.lower()} " for t in block]
    row = np.repeat(np.arange(len(low), dtype=np.int32), [len(t) for t in low])
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTER[np.minimum(code, 0xFFFF)]
    if (high := code > 0xFFFF).any():
        values, where = np.unique(code[high], return_inverse=True)
        letter[high] = np.array([chr(c).isalpha() for c in values])[where]
    code = np.where(letter, code, np.uint32(32))
    stay = np.ones(len(code), bool)
    stay[1:] = letter[1:] | letter[:-1] | (row[1:] != row[:-1])
    code, row, letter = code[stay], row[stay], letter[stay]
    flat = row.astype(np.int64) * DIM
    out = np.zeros(len(low) * DIM, np.int64)
    gram = np.zeros(len(code), np.uint32)
    for n, mix in enumerate(_MIX):
        # the last character's share is added to the hash of the n - 1 before it
        gram = (gram[: len(code) - n] if n == 0 else gram[:-1]) * np.uint32(31337) + code[n:] * mix
        gram ^= gram >> np.uint32(15)
        inside = row[n:] == row[: len(row) - n] if n else letter
        out += np.bincount(flat[n:][inside] + (gram[inside] * np.uint32(2654435769) >> np.uint32(19)), minlength=len(out))
    return out.reshape(len(low), DIM)


def vectors(texts: Iterable[str], idf: np.ndarray) -> Iterator[np.ndarray]:
    """TF-IDF rows of length one, a block at a time."""
    for block in _blocks(texts):
        v = np.log1p(counts(block)).astype(np.float32) * idf
        yield v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents for each feature, and at -1 the number of documents, of one partition."""
    total, rows = np.zeros(DIM, np.int64), 0
    for batch in batches:
        for block in _blocks(t or "" for t in batch["text"]):
            total += (counts(block) > 0).sum(axis=0)
            rows += len(block)
    there = np.flatnonzero(total)
    yield pd.DataFrame({"feature": np.append(there, -1), "n": np.append(total[there], rows)})


def clusters(v: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of spherical k-means and the cosine that nearly all of each one's members reach."""
    start = [int((v @ v.mean(axis=0)).argmax())]
    while len(start) < min(k, len(v)):
        start.append(int((v @ v[start].T).max(axis=1).argmin()))
    c = v[start]
    for _ in range(rounds):
        own = (v @ c.T).argmax(axis=1)
        c = np.stack([v[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    near = v @ c.T
    own = near.argmax(axis=1)
    floor = [np.quantile(near[own == i, i], 0.01) if (own == i).any() else 1.0 for i in range(len(c))]
    return c, np.array(floor, np.float32)


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    floors: np.ndarray
    idf: np.ndarray

    def predict(self, texts: Iterable[str]) -> Iterator[pd.DataFrame]:
        for v in vectors(texts, self.idf):
            near = v @ self.centroids.T
            best = near.argmax(axis=1)
            score = near[np.arange(len(v)), best]
            yield pd.DataFrame(
                {"lang_pred": [self.languages[i] for i in best], "score": np.clip(score, 0, 1).astype(float), "accepted": score >= self.floors[best]}
            )


def fit(training: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", centroids: int = CENTROIDS, fit_rows: int = FIT_ROWS) -> Model | None:
    """The model of the training rows; None if there are none with a language and a letter."""
    spark = training.sparkSession
    rows = training.where(F.col(lang_col).isNotNull() & has_letter(F.col(text_col)))
    order = F.xxhash64(F.col(key_col), F.col(text_col), F.lit("language fit"))
    keyed = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), order.alias("order"))
    first = Window.partitionBy("lang").orderBy("order")

    def lowest(some: DataFrame) -> dict[str, int]:
        """The order of the last row that is still in the sample, for each language."""
        few = some.select("lang", "order").withColumn("place", F.row_number().over(first)).where(F.col("place") <= fit_rows)
        return {r[0]: r[1] for r in few.groupBy("lang").agg(F.max("order")).collect()}

    # only the lowest hashes are ranked; a language of so few different rows that none is among them is ranked whole
    known = {r[0]: r[1] for r in keyed.groupBy("lang").count().collect()}
    top = {lang: int(min(1.0, (4 * fit_rows + 64) / n) * (2**64 - 1)) - 2**63 if n > 4 * fit_rows + 64 else 2**63 - 1 for lang, n in known.items()}
    limits = lowest(keyed.where(F.col("order") <= F.create_map(*[x for pair in top.items() for x in map(F.lit, pair)])[F.col("lang")])) if known else {}
    if left := sorted(set(known) - set(limits)):
        limits |= lowest(keyed.where(F.col("lang").isin(left)))
    if not limits:
        return None
    found = rows.select(F.col(text_col).alias("text")).mapInPandas(_frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    n = dict(found)
    df = np.array([n.get(i, 0) for i in range(DIM)], np.float64)
    idf = (np.log((1 + n.get(-1, 0)) / (1 + df)) + 1).astype(np.float32)
    limit = F.create_map(*[x for pair in limits.items() for x in map(F.lit, pair)])[F.col("lang")]
    # rows that repeat key and text are one
    sample = keyed.where(F.col("order") <= limit).dropDuplicates(["lang", "order"])

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = 0
            for v in vectors(batch["text"], idf):
                part = batch.iloc[at : at + len(v)]
                yield pd.DataFrame({"lang": part["lang"], "order": part["order"], "vector": [x.tobytes() for x in v]})
                at += len(v)

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("order")
        c, floor = clusters(np.stack([np.frombuffer(x, np.float32) for x in group["vector"]]), centroids)
        return pd.DataFrame({"lang": group["lang"].iloc[0], "at": range(len(c)), "centroid": [x.tobytes() for x in c], "floor": floor})

    coded = sample.mapInPandas(encode, "lang string, order long, vector binary")
    made = coded.groupBy("lang").applyInPandas(cluster, "lang string, at int, centroid binary, floor float").collect()
    made.sort(key=lambda r: (r["lang"], r["at"]))
    if not made:
        return None
    return Model([r["lang"] for r in made], np.stack([np.frombuffer(r["centroid"], np.float32) for r in made]), np.array([r["floor"] for r in made], np.float32), idf)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score (the cosine) and accepted."""
    docs = docs.drop("lang_pred", "score", "accepted", "_found")
    keep = docs.columns
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "accepted": F.lit(False)})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            parts = list(shared.value.predict(t or "" for t in texts))
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"lang_pred": [], "score": [], "accepted": []})

    readable = has_letter(F.col(text_col))
    found = docs.withColumn("_found", nearest(F.col(text_col)))
    return found.select(
        *keep,
        F.when(readable, F.col("_found.lang_pred")).otherwise(F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(readable, F.col("_found.score")).otherwise(F.lit(0.0)).alias("score"),
        (readable & F.col("_found.accepted")).alias("accepted"),
    )
