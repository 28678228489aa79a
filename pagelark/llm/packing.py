"""Packing documents into windows by Karmarkar-Karp multiway differencing.

A document is its token ids and one closing id. What fills a window alone is cut off as such. The rests, cut into pieces
of at most PIECE ids, gather in a block until they fill about BLOCK windows with SLACK free places in each; then
multiway differencing deals them out. Every piece starts as a partial partition (its size, 0, ..., 0). The two partial
partitions with the largest spread are merged again and again, the largest window of one with the smallest of the
other, so opposing imbalances cancel and the windows end up near equal. If the largest is above capacity, the block is
dealt again with one window more, until all fit.

The work is done where the documents are read: a block holds BLOCK windows of ids at most, no row is shuffled, and
neither a hot source nor a very long document concentrates in a task. A lost executor repeats its tasks with the same
outcome, as sequence numbers come from the partition and a count within it.

The ids are those of the byte-level BPE whose file `tokenizers` reads. They are computed from the same vocabulary in
rank form, which takes a quarter of the time; a test holds both against each other. The rank form gives up on runs of
white space of about a million characters; such a text goes to `tokenizers` itself.

Cases: a null or empty text is the closing id alone. Rows that repeat an id are packed one by one. A text of any length
is tokenised whole. No documents give no rows. Of extra columns, those named in `carry` come along with each piece, with
their own types; null values stay null.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAPACITY = 1024
PIECE = 512
BLOCK = 128
SLACK = 14
CLOSING = 0
SPECIAL = "<|endoftext|>"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """The tokenizer whose file stands beside the rank file."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(f"{path.removesuffix('.tiktoken')}.json")


def token_ids(text: str | None, path: str) -> np.ndarray:
    """Ids of a text with the closing id, little-endian unsigned 32-bit."""
    if not text:
        return np.array([CLOSING], "<u4")
    encoding = _encoding(path)
    try:
        if SPECIAL in text:
            ids = encoding.encode(text, allowed_special="all")
        else:
            ids = encoding.encode_to_numpy(text, disallowed_special=())
    except ValueError:  # its regular expression ran out of stack on a run of white space
        ids = _tokenizer(path).encode(text, add_special_tokens=False).ids
    return np.append(np.asarray(ids, "<u4"), np.uint32(CLOSING))


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Places of sizes dealt to the given number of windows with near-equal sums."""
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    base = len(sizes)
    heap = []
    for i, s in enumerate(sizes):
        sums, nodes = np.zeros(windows, np.int64), np.full(windows, -1, np.int64)
        sums[-1], nodes[-1] = s, i
        heap.append((-s, i, sums, nodes))  # sums ascend
    heapq.heapify(heap)
    made, count = base, base
    while len(heap) > 1:
        _, _, a, na = heapq.heappop(heap)
        _, _, b, nb = heapq.heappop(heap)
        b, nb = b[::-1], nb[::-1]
        sums = a + b
        both = (na >= 0) & (nb >= 0)
        nodes = np.maximum(na, nb)
        new = int(both.sum())
        if new:
            left.append(na[both])
            right.append(nb[both])
            nodes[both] = np.arange(made, made + new)
            made += new
        order = np.argsort(sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        sums = sums - sums[0]
        count += 1
        heapq.heappush(heap, (-int(sums[-1]), count, sums, nodes))
    lefts = np.concatenate(left).tolist() if left else []
    rights = np.concatenate(right).tolist() if right else []
    out = []
    for node in heap[0][3].tolist() if heap else []:
        pieces, stack = [], [node]
        while stack:
            x = stack.pop()
            if x >= base:
                stack += [lefts[x - base], rights[x - base]]
            elif x >= 0:
                pieces.append(x)
        out.append(pieces)
    return out


def windows_of(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Places of sizes (none above capacity) in windows within capacity, as few as differencing needs."""
    count = max(1, -(-sum(sizes) // capacity))
    while True:
        dealt = differencing(sizes, count)
        if all(sum(sizes[i] for i in w) <= capacity for w in dealt):
            return [w for w in dealt if w]
        count += 1


def _packer(path: str, capacity: int, piece: int, block: int, slack: int, carry: list[str]):
    goal = block * max(1, capacity - slack)

    def pack_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 32
        rests: list[tuple] = []  # (carried, start, ids, tokens of the document)
        held = 0
        rows: list[tuple] = []
        kinds: list[pa.DataType] = []  # of the carried columns

        def put(carried: tuple, start: int, ids: np.ndarray, tokens: int, offset: int) -> None:
            rows.append((*carried, start, len(ids), ids.tobytes(), tokens, sequence, offset))

        def deal() -> None:
            nonlocal sequence, held
            for window in windows_of([len(r[2]) for r in rests], capacity):
                offset = 0
                for i in sorted(window):
                    carried, start, ids, tokens = rests[i]
                    put(carried, start, ids, tokens, offset)
                    offset += len(ids)
                sequence += 1
            rests.clear()
            held = 0

        def made() -> pa.RecordBatch:
            types = [*kinds, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(column, kind) for column, kind in zip(zip(*rows), types, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, [*carry, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            kinds = [batch.schema.field(1 + i).type for i in range(len(carry))]
            columns = [batch.column(i).to_pylist() for i in range(1 + len(carry))]
            for text, *values in zip(*columns):
                carried = tuple(values)
                ids = token_ids(text, path)
                at = 0
                while len(ids) - at >= capacity:
                    put(carried, at, ids[at : at + capacity], len(ids), 0)
                    sequence += 1
                    at += capacity
                while at < len(ids):
                    cut = min(piece, len(ids) - at, goal - held)
                    rests.append((carried, at, ids[at : at + cut], len(ids)))
                    held += cut
                    at += cut
                    if held == goal:
                        deal()
                if len(rows) >= 2000:
                    yield made()
        if rests:
            deal()
        if rows:
            yield made()

    return pack_partition


def pack(
    docs: DataFrame,
    vocabulary: str | None = None,
    capacity: int = CAPACITY,
    piece: int = PIECE,
    block: int = BLOCK,
    slack: int = SLACK,
    text_col: str = "text",
    carry: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """One row for each piece: the carried columns, start, length, ids (binary, little-endian unsigned 32-bit),
    doc_tokens, sequence_id and offset. vocabulary: path of the rank file, the same on every executor."""
    if not 0 < piece <= capacity:
        raise ValueError("piece must be from 1 to capacity")
    number = [T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")]
    number.insert(2, T.StructField("ids", T.BinaryType()))
    schema = T.StructType([*docs.select(*carry).schema.fields, *number])
    packer = _packer(vocabulary or default_vocabulary(), capacity, piece, block, slack, list(carry))
    return docs.select(F.col(text_col).alias("_text"), *carry).mapInArrow(packer, schema)
