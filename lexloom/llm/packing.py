"""Filling containers of fixed capacity with texts, along a space-filling curve.

Each text becomes a point: the mean of hashed projections of its tokens. Texts are range-sorted by
the Hilbert key of their points and packed along the curve: a window of a few containers' worth of
neighbours at a time, best fit by size inside it; a container left open closes soon after. What
stays underfilled is packed once more along the curve, where it meets its next neighbours, and the
little that is left then in hashed order.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.session import materialize

CAPACITY = 2048
#: Dimensions of the points and bits of each on the curve.
DIMS, BITS = 3, 10
#: Containers' worth of neighbours that are packed together, containers kept open for the next windows, and for how many.
WINDOW, OPEN, AGE = 32, 32, 2
#: Rows of one range of the curve, and ranges at most: rows are streamed, so a range may be longer.
RANGE_ROWS, MAX_RANGES = 8_000, 20_000
#: Containers filled to less than this share are packed once more.
FULL = 0.98
#: Largest vocabulary file that is shipped to the workers.
MAX_VOCABULARY = 64 << 20


@lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def read_ranks(path: str) -> bytes:
    """The vocabulary file, read where the job is declared; workers need no copy of it."""
    with open(path, "rb") as f:
        ranks = f.read(MAX_VOCABULARY + 1)
    if len(ranks) > MAX_VOCABULARY:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY} bytes")
    return ranks


def _projection(vocabulary: int) -> np.ndarray:
    return np.random.default_rng(20_240_601).standard_normal((vocabulary, DIMS)).astype(np.float32)


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of integer points (rows) with coordinates below 2**bits."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        mask = q - 1
        for i in range(dims):
            up = (x[i] & q) > 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & mask)
            x[0] ^= np.where(up, mask, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[dims - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _measure(batches: Iterator[pd.DataFrame], ranks: bytes, pattern: str) -> Iterator[pd.DataFrame]:
    """(doc_id, n_tokens, curve) of each text."""
    encoding = _encoding(ranks, pattern)
    directions = _projection(encoding.n_vocab + 1)
    for pdf in batches:
        counts, points = np.zeros(len(pdf), np.int64), np.zeros((len(pdf), DIMS))
        for r, text in enumerate(pdf["text"]):
            ids = np.array(encoding.encode_ordinary(text), np.int64)
            counts[r] = len(ids)
            points[r] = directions[ids].sum(axis=0)
        # the sum of n directions has variance n in each dimension
        scaled = points / np.sqrt(np.maximum(counts, 1))[:, None]
        grid = np.clip(((np.tanh(scaled / 4) + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": counts, "curve": hilbert_keys(grid)})


class _Bins:
    """Open containers by room, best fit first."""

    def __init__(self, capacity: int):
        self.capacity, self.rooms, self.items, self.born, self.window = capacity, [], [], [], 0

    def put(self, size: int, item) -> None:
        at = bisect_left(self.rooms, (size, -1))
        if at < len(self.rooms):
            room, k = self.rooms.pop(at)
        else:
            room, k = self.capacity, len(self.items)
            self.items.append([])
            self.born.append(self.window)
        self.items[k].append(item)
        if room > size:
            insort(self.rooms, (room - size, k))

    def close(self, keep: int, age: int) -> list[list]:
        """Containers that are full, older than ``age`` windows or beyond the ``keep`` roomiest; the others stay open."""
        young = [(room, k) for room, k in self.rooms if self.window - self.born[k] < age]
        stay = young[len(young) - keep :] if 0 < keep < len(young) else young if keep else []
        held = {k for _, k in stay}
        done = [x for k, x in enumerate(self.items) if k not in held]
        self.items, self.born = [self.items[k] for _, k in stay], [self.born[k] for _, k in stay]
        self.rooms = [(room, i) for i, (room, _) in enumerate(stay)]
        self.window += 1
        return done


def _pack(batches: Iterator[pd.DataFrame], capacity: int, stage: int) -> Iterator[pd.DataFrame]:
    """Pack the pieces of a range of the curve, in order; container ids name stage, range and number."""
    from pyspark import TaskContext

    bins, number = _Bins(capacity), 0
    part = TaskContext.get().partitionId()

    def out(done: list[list]) -> pd.DataFrame:
        nonlocal number
        rows = []
        for items in done:
            fill = sum(x[3] for x in items)
            rows.extend((f"{stage}-{part}-{number}", *x, fill) for x in items)
            number += 1
        return pd.DataFrame(rows, columns=["container_id", "doc_id", "piece", "token_start", "n_tokens", "curve", "filled"])

    window, tokens = [], 0
    for pdf in batches:
        done = []
        for item in pdf[["doc_id", "piece", "token_start", "n_tokens", "curve"]].itertuples(index=False, name=None):
            window.append(item)
            tokens += item[3]
            if tokens >= WINDOW * capacity:
                for x in sorted(window, key=lambda x: -x[3]):
                    bins.put(x[3], x)
                window, tokens = [], 0
                done += bins.close(OPEN, AGE)
        yield out(done)
    for x in sorted(window, key=lambda x: -x[3]):
        bins.put(x[3], x)
    yield out(bins.close(0, 0))


def pack_texts(docs: DataFrame, vocabulary: str, pattern: str, capacity: int = CAPACITY, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Containers of at most ``capacity`` tokens that hold every non-blank text exactly once.

    ``docs`` has (doc_id, text); other columns are ignored. Sizes are tokens of the byte-level BPE
    whose ranks lie at the path ``vocabulary``, split by ``pattern``; the file is read by the driver
    and sent along (MAX_VOCABULARY bytes at most). Returns (container_id, doc_id, piece, token_start,
    n_tokens, curve), with the Hilbert key of the text: a text is one piece, or, if longer than a
    container, full containers' pieces and a rest, packed like any other. Null or blank texts give no row; repeated
    rows are packed each; an empty table gives no containers.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.where(F.col("text").rlike(r"(?U)\S")).select("doc_id", "text")
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    sized = texts.mapInPandas(lambda it: _measure(it, ranks.value, pattern), f"doc_id {kind}, n_tokens long, curve long")
    piece = F.explode(F.sequence(F.lit(0), ((F.col("n_tokens") - 1) / capacity).cast("int")))
    pieces = sized.where("n_tokens > 0").select("doc_id", "n_tokens", "curve", piece.alias("piece"))
    pieces = materialize(pieces.select("doc_id", "piece", (F.col("piece") * capacity).cast("long").alias("token_start"), F.least(F.col("n_tokens") - F.col("piece") * capacity, F.lit(capacity)).cast("long").alias("n_tokens"), "curve"))
    schema = f"container_id string, doc_id {kind}, piece int, token_start long, n_tokens long, curve long, filled long"
    columns = ["doc_id", "piece", "token_start", "n_tokens", "curve"]

    def along_curve(df: DataFrame, stage: int, order: Column | None = None) -> DataFrame:
        parts = max(1, min(MAX_RANGES, -(-df.count() // range_rows)))
        keyed = df.select(*columns, (F.col("curve") if order is None else order).alias("_at"))
        ranged = keyed.repartitionByRange(parts, "_at", "doc_id", "piece").sortWithinPartitions("_at", "doc_id", "piece")
        return ranged.mapInPandas(lambda it: _pack(it, capacity, stage), schema)

    first = materialize(along_curve(pieces, 1))
    loose = F.col("filled") < FULL * capacity
    # what didn't fit its window meets its next neighbours among what is left; where neighbours are alike in
    # size as well, what then is left meets others in hashed order
    second = materialize(along_curve(first.where(loose), 2))
    third = along_curve(second.where(loose), 3, F.xxhash64("doc_id", "piece"))
    result = first.where(~loose).unionByName(second.where(~loose)).unionByName(third)
    return result.select("container_id", *columns)
