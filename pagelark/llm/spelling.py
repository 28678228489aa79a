"""Grouping of spelling variants by rolling-hash deletions.

Two words are near if one results from the other by inserting, deleting or replacing exactly one code point. A word's form
is the most frequent near word that is at least `ratio` times as frequent, its root the end of the chain of forms.

Plan
----
1. Runs of letters are counted for each batch of texts, then over all of them with map-side combine; words that are too
   short or too rare go.
2. A word and each of its one-deletion neighbours get a 64-bit key. The words of a batch lie in one NumPy buffer; running
   sums of a polynomial hash give the prefix before each place and the suffix behind it, and a suffix moves one place up by
   a product with the inverse of the base. So all deletion keys of a batch come from a few array operations, no
   neighbour is ever spelled out.
3. Keys are radix-partitioned by their top bits into groups of about GROUP keys and sorted within. Only where a key occurs
   again are strings built, and rows belong together only if those agree, so that collisions of keys are told apart.
4. Words whose deletion at the same place gives the same string differ by a replacement there, all with one another; a word
   that is the deletion of others is one insertion apart from each. So a group of keys is counted and ranked without listing
   its pairs: each row needs the group's size and its first two rows by frequency. A group has at most as many words as
   there are letters for each place, whatever the size of the corpus.
5. Outcomes are summed by word. Roots are found by pointer jumping; a form is `ratio` times as frequent as its word, so
   chains have at most log(largest count) links and rounds the logarithm of that.

Cases: null texts have no words; a null id counts as empty text; repeated rows count as often as they occur. Words are
compared by code points. Columns other than id and text are ignored. An empty table gives no words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Workspace
from .ngram_join import finalised

LETTERS = "[A-Za-zÀ-ÿ]"

#: Keys of a radix group, about; bounds the memory of a task.
GROUP = 1 << 18

#: Words counted before they go on.
HELD = 300_000

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _counted(shortest: int, damage: int | None):
    # a run as long as the shortest word at least; greedy matching from the left gives maximal runs
    runs = re.compile(f"{LETTERS}{{{shortest},}}")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[str] = Counter()
        for batch in batches:
            for doc, text in zip(batch["id"], batch["text"]):
                if not text:
                    continue
                before = zlib.crc32(f"{doc or ''}:".encode())
                for run, n in Counter(runs.findall(text)).items():
                    data = run.encode().lower()  # of bytes, lower() changes A-Z only
                    word = data.decode()
                    if damage and (h := zlib.crc32(data, before)) % damage == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= shortest:
                        held[word] += n
                if len(held) > HELD:
                    yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                    held.clear()
        if held:
            yield pd.DataFrame({"word": list(held), "n": list(held.values())})

    return count


def words_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 7, least: int = 2, damage: int | None = None) -> DataFrame:
    """word and n, its occurrences, of the lower-cased runs of letters in all texts.

    damage: where this number divides the crc32 of "id:run", the run's code point at that crc32 modulo its length is left
    out, which plants misspellings to be found.
    """
    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    counts = texts.mapInPandas(_counted(shortest, damage), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row of the word, place) of each word, with place -1, and of its deletion at each place."""
    sizes = np.array([len(w) for w in words], np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(words)), sizes)
    start = np.cumsum(sizes) - sizes
    place = np.arange(len(letters)) - start[row]
    powers = np.cumprod(np.concatenate(([U(1)], np.full(int(sizes.max(initial=0)), U(_BASE)))), dtype=np.uint64)
    terms = finalised(letters + U(1)) * powers[place]
    through = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
    opening, closing = through[start], through[start + sizes]
    prefix, suffix = through[:-1] - opening[row], closing[row] - through[1:]
    keys = np.concatenate((closing - opening, prefix + suffix * U(_INVERSE)))
    return finalised(keys), np.concatenate((np.arange(len(words)), row)), np.concatenate((np.full(len(words), -1), place))


def _keyed(bits: int):
    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words, n = batch["word"].to_numpy(object), batch["n"].to_numpy(np.int64)
            keys, row, place = deletion_keys(words.tolist())
            radix = (keys >> U(64 - bits)).astype(np.int32) if bits else np.zeros(len(keys), np.int32)
            yield pd.DataFrame({"radix": radix, "key": keys.view(np.int64), "place": place.astype(np.int32), "word": words[row], "n": n[row]})

    return key


def _ranked(clique: np.ndarray, n: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, how many others, the first other by frequency, then code points) of the rows that share their clique."""
    order = np.lexsort((rank, -n, clique))
    edge = np.flatnonzero(np.concatenate(([True], clique[order][1:] != clique[order][:-1])))
    size = np.diff(np.concatenate((edge, [len(order)])))
    of, first = np.repeat(size, size), np.repeat(edge, size)
    at = np.arange(len(order))
    several = of > 1
    best = np.where(at == first, first + 1, first)[several]
    return order[several], of[several] - 1, order[best]


def _matched(group: pd.DataFrame) -> pd.DataFrame:
    """(word, near, best, best_n) of the words of a radix group that have near words in it."""
    group = group.iloc[np.argsort(group["key"].to_numpy(), kind="stable")]
    key = group["key"].to_numpy()
    same = np.concatenate(([False], key[1:] == key[:-1], [False]))
    group = group[same[1:] | same[:-1]]  # keys that occur again
    if not len(group):
        return pd.DataFrame({c: pd.Series(dtype=object) for c in ("word", "near", "best", "best_n")})
    words, place, n = group["word"].to_numpy(object), group["place"].to_numpy(), group["n"].to_numpy()
    spelled = [w if i < 0 else w[:i] + w[i + 1 :] for w, i in zip(words, place.tolist())]
    string = pd.factorize(np.array(spelled, object))[0]
    rank = np.unique(words.astype(str), return_inverse=True)[1]
    # in a stretch of equal letters each deletion gives the same string; the first place counts
    fresh = np.array([i < 1 or w[i] != w[i - 1] for w, i in zip(words, place.tolist())])
    out = []

    gone = np.flatnonzero(place >= 0)
    clique = string[gone] * (int(place.max(initial=0)) + 1) + place[gone]
    rows, near, best = _ranked(clique, n[gone], rank[gone])
    out.append((gone[rows], near, gone[best]))

    whole = np.full(string.max() + 1, -1)
    mine = np.flatnonzero(place < 0)
    whole[string[mine]] = mine
    longer = np.flatnonzero((place >= 0) & fresh)
    longer = longer[whole[string[longer]] >= 0]
    if len(longer):
        shorter = whole[string[longer]]
        out.append((longer, np.ones(len(longer), np.int64), shorter))
        order = np.lexsort((rank[longer], -n[longer], shorter))
        edge = np.flatnonzero(np.concatenate(([True], shorter[order][1:] != shorter[order][:-1])))
        out.append((shorter[order][edge], np.diff(np.concatenate((edge, [len(order)]))), longer[order][edge]))
    rows, near, best = (np.concatenate(x) for x in zip(*out))
    found = pd.DataFrame({"word": words[rows], "near": near, "best": words[best], "best_n": n[best]})
    return found.astype(object)


def variants(words: DataFrame, ratio: int = 10, group: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near and form_n of each distinct word of `words` (word, n)."""
    scratch = Workspace(words.sparkSession)
    words = scratch.keep(words.select("word", F.col("n").cast("long").alias("n")), "words")
    keys = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    bits = max(0, int(keys // group).bit_length())
    keyed = words.mapInPandas(_keyed(bits), "radix int, key long, place int, word string, n long")
    found = keyed.groupBy("radix").applyInPandas(_matched, "word string, near long, best string, best_n long")
    near = found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("first"))
    often = -F.col("first.less") >= ratio * F.col("n")
    formed = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(often, F.col("first.best")).alias("form"), F.when(often, -F.col("first.less")).alias("form_n")
    )
    formed = scratch.keep(formed, "forms")
    ends = scratch.keep(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = scratch.keep(ends.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        scratch.drop(ends)
        ends = moved
        if moved.where("moved").isEmpty():
            break
    scratch.drop(words)
    out = formed.join(ends.select("word", "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
