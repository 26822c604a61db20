"""Evaluation texts that leak into a corpus, found by greedy string tiling.

Documents and test items share seeds: runs of ``SEED_WORDS`` words. A join of the seeds gives pairs
of a document and an item that share enough of them. The parts of the document around a pair's seeds
are tiled together: the longest common run outside earlier tiles is marked again and again, found
with running Karp-Rabin hashes. Two thresholds on what the tiles cover of the item decide: its longest
passage that reads on, with at most one in ``EDIT_RATE`` words changed, and the share of its words
that stand in tiles in any order, which catches reordered passages.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.session import materialize

#: Words in a seed. A passage of 40 words or more with one in 15 changed keeps MIN_SEEDS of them.
SEED_WORDS, MIN_SEEDS, SEED_SPAN = 10, 4, 64
MIN_WORDS, EDIT_RATE = 40, 15
#: Shortest tile, and the widest gap between two tiles of one passage.
MIN_TILE, MAX_GAP = 3, 24
#: Items with more seeds than this (16 MB) are not broadcast to filter the documents' seeds.
MAX_BROADCAST_SEEDS = 2_000_000
#: Cells of pairs of a document and an item that are sent to the documents' words (some 8 MB); more meet them by a shuffle.
MAX_BROADCAST_CELLS = 100_000
#: Width of a band of diagonals: two neighbouring cells.
BAND = 32
#: Reordered passages: at least this share of the item's words stands in tiles of so many words; blocks of BLOCK words or more are found.
COVERED, COVER_TILE, BLOCK = 0.5, 8, 12

_BASE = np.uint64(0x9E3779B97F4A7C15)
_OTHER = re.compile(r"[^\x00-\x7f\u0300-\u036f]")
_BROKEN = re.compile(rb"-(?<=[a-z0-9]-)[ \t]*[\r\n]\s*(?=[a-z])")
_SPECIAL = {"ß": "ss", "œ": "o", "æ": "a", "ø": "o", "ł": "l", "đ": "d", "\u00ad": "", "\u200b": "", "\u200c": "", "\u200d": "", "\u2060": "", "\ufeff": "", "\u2010": "-", "\u2011": "-"}
_TABLE = bytes(c if chr(c).isalnum() and c < 128 or c == 45 else 32 for c in range(256))


def _spell(match: re.Match) -> str:
    """What stands for a character that isn't ASCII: a base letter, a blank, or its number for other scripts."""
    ch = match.group()
    return _SPECIAL[ch] if ch in _SPECIAL else f"x{ord(ch):x}x" if ch.isalnum() else " "


def fold(text: str) -> list[bytes]:
    """The words of a text, spelled alike: lower case, no accents, umlauts however written.

    Words are runs of letters or digits; paragraph marks in superscript don't count and line breaks
    inside a word are mended. Parts joined by a hyphen stay one word, hyphen included.
    """
    text = text.lower()
    if not text.isascii():
        for mark in "¹²³⁴⁵⁶⁷⁸⁹⁰":
            text = text.replace(mark, " ")
        text = _OTHER.sub(_spell, unicodedata.normalize("NFKD", text).lower())
    flat = text.encode("ascii", "ignore")  # what is left beside ASCII are accents
    if b"-" in flat:
        flat = _BROKEN.sub(b"", flat).translate(_TABLE).replace(b"--", b" ").replace(b" -", b" ").replace(b"- ", b" ").strip(b"-")
    else:
        flat = flat.translate(_TABLE)
    return flat.replace(b"ae", b"a").replace(b"oe", b"o").replace(b"ue", b"u").split()


class WordCodes(dict):
    """64-bit codes of words. A hyphen doesn't count; the cache is emptied when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        code = xxhash.xxh64_intdigest(word.replace(b"-", b"")) | 1
        self[word] = code
        return code


def _rolling(codes: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``size`` words."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * _BASE + codes[j : j + n]
    return out


def in_slices(batches: Iterator[pd.DataFrame], rows: int = 2000) -> Iterator[pd.DataFrame]:
    """Batches cut into slices, so that what is derived from a batch stays small."""
    for pdf in batches:
        for i in range(0, len(pdf), rows):
            yield pdf.iloc[i : i + rows]


def _codes(texts, cache: WordCodes) -> tuple[np.ndarray, np.ndarray]:
    """All words' codes of a batch of texts, and where each text begins."""
    parts, starts = [np.empty(0, np.uint64)], [0]
    for text in texts:
        words = fold(text) if text else []
        parts.append(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)))
        starts.append(starts[-1] + len(words))
    return np.concatenate(parts), np.array(starts)


class Known:
    """Which hashes are seeds of an item: a table of their low bits first, then a search."""

    BITS = 24

    def __init__(self, seeds: np.ndarray):
        self.sorted = np.unique(seeds)
        self.low = np.zeros(1 << self.BITS, bool)
        self.low[self.sorted & np.uint64((1 << self.BITS) - 1)] = True

    def positions(self, hashes: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.low[(hashes & np.uint64((1 << self.BITS) - 1)).astype(np.int64)])
        at = np.searchsorted(self.sorted, hashes[maybe])
        at[at == len(self.sorted)] = 0
        return maybe[self.sorted[at] == hashes[maybe]]


def _doc_seeds(batches: Iterator[pd.DataFrame], seeds: np.ndarray | None, scattered: bool) -> Iterator[pd.DataFrame]:
    """Documents with enough seeds, close together unless they may be ``scattered``: their words' codes and their seeds."""
    cache, known = WordCodes(), Known(seeds) if seeds is not None else None
    for pdf in in_slices(batches):
        codes, starts = _codes(pdf["text"], cache)
        hashes = _rolling(codes, SEED_WORDS)
        hit = known.positions(hashes) if known else np.arange(len(hashes))
        doc = np.searchsorted(starts, hit, side="right") - 1
        inside = hit + SEED_WORDS <= starts[doc + 1]
        hit, doc = hit[inside], doc[inside]
        k = MIN_SEEDS - 1
        near = np.zeros(len(hit), bool)
        if len(hit) > k:
            near[: len(hit) - k] = (scattered | (hit[k:] - hit[:-k] < SEED_SPAN)) & (doc[k:] == doc[:-k])
        out = []
        bounds = np.searchsorted(doc, np.arange(len(pdf) + 1))
        ids = pdf["doc_id"].to_numpy()
        for d in np.unique(doc[near]):
            mine = hit[bounds[d] : bounds[d + 1]]
            out.append((ids[d], codes[starts[d] : starts[d + 1]].view(np.int64), hashes[mine].view(np.int64), (mine - starts[d]).astype(np.int32)))
        yield pd.DataFrame(out, columns=["doc_id", "words", "seeds", "positions"])


def _item_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Items with their words' codes, the number of words that each stands for, and their seeds."""
    cache = WordCodes()
    for pdf in batches:
        rows = []
        for item, text in zip(pdf["item_id"], pdf["text"], strict=True):
            words = fold(text)
            codes = np.array([cache[w] for w in words], np.uint64)
            rows.append((item, codes.view(np.int64), np.array([1 + w.count(b"-") for w in words], np.int32), _rolling(codes, SEED_WORDS).view(np.int64)))
        yield pd.DataFrame(rows, columns=["item_id", "words", "weights", "seeds"])


def tiles(item: np.ndarray, doc: np.ndarray, shortest: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in item, start in doc, length) of non-overlapping common runs, longest first.

    Search lengths halve down to ``shortest``. For each, running Karp-Rabin hashes of the unmarked
    runs of both texts are matched; matches extend as far as they go, and the longest are marked
    first. Equal lengths go by position.
    """
    free_a, free_b = np.ones(len(item), bool), np.ones(len(doc), bool)
    found: list[tuple[int, int, int]] = []
    size = max(shortest, 1 << max(0, min(len(item), len(doc)).bit_length() - 1))
    while True:
        matches = []
        a_at, b_at = _open_runs(free_a, size), _open_runs(free_b, size)
        a_hash, b_hash = _rolling(item, size)[a_at], _rolling(doc, size)[b_at]
        order = np.argsort(b_hash, kind="stable")
        low, high = np.searchsorted(b_hash[order], a_hash), np.searchsorted(b_hash[order], a_hash, side="right")
        for i, lo, hi in zip(a_at[high > low].tolist(), low[high > low], high[high > low], strict=True):
            for j in b_at[order[lo:hi]].tolist():
                if i and j and free_a[i - 1] and free_b[j - 1] and item[i - 1] == doc[j - 1]:
                    continue  # the match that begins one word earlier holds this one
                n = min(len(item) - i, len(doc) - j)
                same = (item[i : i + n] == doc[j : j + n]) & free_a[i : i + n] & free_b[j : j + n]
                n = n if same.all() else int(np.argmin(same))
                if n >= size:
                    matches.append((-n, i, j))
        again = False
        for neg, i, j in sorted(matches):
            n = -neg
            if free_a[i : i + n].all() and free_b[j : j + n].all():
                free_a[i : i + n] = free_b[j : j + n] = False
                found.append((i, j, n))
            else:
                again = True  # what an earlier tile left of this match may still be long enough
        if again:
            continue
        if size <= shortest:
            return found
        size = max(shortest, size // 2)


def _open_runs(free: np.ndarray, size: int) -> np.ndarray:
    """Where ``size`` unmarked words begin."""
    if len(free) < size:
        return np.empty(0, np.int64)
    sums = np.concatenate([[0], np.cumsum(free)])
    return np.flatnonzero(sums[size:] - sums[:-size] == size)


def _edits(a: np.ndarray, b: np.ndarray) -> int:
    """Words replaced, left out or added between two short runs."""
    if not len(a) or not len(b):
        return max(len(a), len(b))
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def longest_passage(item: np.ndarray, weights: np.ndarray, doc: np.ndarray) -> int:
    """Words of the longest run of the item that the document holds with at most one in EDIT_RATE changed."""
    return passage_of(tiles(item, doc), item, weights, doc)


def passage_of(found: list[tuple[int, int, int]], item: np.ndarray, weights: np.ndarray, doc: np.ndarray) -> int:
    """:func:`longest_passage` from the tiles.

    Tiles that follow each other in both texts are chained; what lies between two of them counts as
    changed words. Changed words at either end count as long as the rate allows.
    """
    parts = sorted(found)
    at = np.concatenate([[0], np.cumsum(weights)])
    best = 0
    for s, (i0, _, n0) in enumerate(parts):
        cost = {s: 0}
        for t in range(s, len(parts)):
            if t not in cost:
                continue
            i, j, n = parts[t]
            words = int(at[i + n] - at[i0])
            spare = (words - EDIT_RATE * cost[t]) // (EDIT_RATE - 1) if words >= EDIT_RATE * cost[t] else -1
            if spare >= 0:
                best = max(best, words + min(spare, int(at[-1]) - words))
            for u in range(t + 1, len(parts)):
                i2, j2, n2 = parts[u]
                da, db = i2 - i - n, j2 - j - n
                if da > MAX_GAP:
                    break
                if 0 <= da and 0 <= db <= MAX_GAP:
                    c = cost[t] + _edits(item[i + n : i2], doc[j + n : j2])
                    if c < cost.get(u, 1 << 30):
                        cost[u] = c
    return best


def least_tokens(weights: np.ndarray) -> int:
    """The fewest tokens of the item, of which some stand for several words, that make MIN_WORDS; one more than it has if none do."""
    at = np.concatenate([[0], np.cumsum(weights)])
    ends = np.searchsorted(at, at + MIN_WORDS)
    return int((ends - np.arange(len(at)))[ends < len(at)].min(initial=len(at)))


def _dense(item: np.ndarray, weights: np.ndarray, doc: np.ndarray, low: int, high: int) -> bool:
    """Whether some passage could stand near the diagonals low to high: a bound that is quick to take.

    A passage holds a stretch of MIN_WORDS words that has 3 changed ones at most; its words are
    equal on diagonals that differ by as much.
    """
    size = least_tokens(weights)
    if size > len(item):
        return False
    slack = MIN_WORDS // EDIT_RATE + 2
    first = low - slack
    same = np.zeros((high - low + 2 * slack + 1, len(item)), np.int32)
    for r in range(len(same)):
        off = first + r
        a, b = max(0, -off), min(len(item), len(doc) - off)
        if a < b:
            same[r, a:b] = item[a:b] == doc[a + off : b + off]
    width = 2 * slack - 1
    sums = np.cumsum(np.vstack([np.zeros((1, len(item)), np.int32), same]), axis=0)
    near = np.cumsum((sums[width:] - sums[:-width]) > 0, axis=1)
    window = near[:, size - 1 :].copy()
    window[:, 1:] -= near[:, : -size]
    return int(window.max()) >= size - MIN_WORDS // EDIT_RATE - 1


def _regions(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans merged where they overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _judge(batches: Iterator[pd.DataFrame], reordered: bool) -> Iterator[pd.DataFrame]:
    """The longest passage and the covered words of each pair of which a bound says that either may reach its threshold."""
    for pdf in batches:
        out = []
        for doc_id, item_id, item, weights, doc, start, cells in zip(pdf["doc_id"], pdf["item_id"], pdf["item_words"], pdf["weights"], pdf["doc_words"], pdf["start"], pdf["cells"], strict=True):
            cells = [(c["cell"], c["n"], c["low"] - start, c["high"] - start) for c in cells]
            near = [(a, b) for a, b in zip(cells, cells[1:] + [(None, 0, 0, 0)], strict=True)]
            bands = [(a[2], b[3] if b[0] == a[0] + 1 else a[3]) for a, b in near if a[1] + (b[1] if b[0] == a[0] + 1 else 0) >= MIN_SEEDS]
            spread = reordered and sum(c[1] for c in cells) >= _spread_seeds(len(item))
            if not spread and not any(_dense(item, weights, doc, low, high) for low, high in bands):
                continue
            spans = [(max(0, low - BAND), min(len(doc), high + len(item) + BAND)) for _, _, low, high in cells]
            # regions lie apart, with a word of no text between two: no tile or gap of a passage leads across
            apart = np.zeros(MAX_GAP + 1, np.uint64)
            text = np.concatenate([x for a, b in _regions(spans) for x in (doc[a:b].view(np.uint64), apart)])
            found = tiles(item.view(np.uint64), text)
            covered = np.zeros(len(item), bool)
            for i, _, n in found:
                covered[i : i + n] |= n >= COVER_TILE
            total = int(weights.sum())
            out.append((doc_id, item_id, passage_of(found, item.view(np.uint64), weights, text), int(weights[covered].sum()), total))
        yield pd.DataFrame(out, columns=["doc_id", "item_id", "passage_words", "covered_words", "item_words"])


def _spread_seeds(words: int) -> int:
    """Seeds that an item of so many words shares at least if COVERED of it stands in blocks of BLOCK words."""
    return max(MIN_SEEDS, int(COVERED * words / BLOCK) * (BLOCK - SEED_WORDS + 1))


def tiled_pairs(docs: DataFrame, items: DataFrame, reordered: bool = True) -> DataFrame:
    """(doc_id, item_id, passage_words, covered_words, item_words) of documents and items that may share a passage.

    ``passage_words`` is the longest passage of successive words of the item, with at most one in
    EDIT_RATE replaced, left out or added; ``covered_words`` are the item's words in tiles of
    COVER_TILE words or more, in any order. Pairs of which a bound says that the passage stays below
    MIN_WORDS and, if ``reordered``, the cover below COVERED in blocks of BLOCK words, are left out.
    Letter case, accents, umlauts however written, punctuation, superscript paragraph marks, blanks
    and line breaks don't count. ``docs`` has (doc_id, text), ``items`` (item_id, text); other
    columns are ignored. Null or blank texts and texts that are too short give no row; each copy of
    a document counts. Repeated ids count once, by their best. Empty tables give no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    item_kind = items.schema["item_id"].dataType.simpleString()
    result = f"doc_id {kind}, item_id {item_kind}, passage_words int, covered_words int, item_words int"
    texts = items.where("text is not null and item_id is not null").select("item_id", "text").mapInPandas(_item_words, f"item_id {item_kind}, words array<long>, weights array<int>, seeds array<long>")
    texts = materialize(texts.dropDuplicates(["item_id", "seeds", "words"]))
    item_seeds = texts.select("item_id", F.posexplode("seeds").alias("item_at", "seed"))
    n_seeds = texts.agg(F.coalesce(F.sum(F.size("seeds")), F.lit(0))).head()[0]
    if n_seeds == 0:
        return docs.sparkSession.createDataFrame([], result)
    shared = None
    if n_seeds <= MAX_BROADCAST_SEEDS:
        distinct = [r[0] for r in item_seeds.select("seed").distinct().toLocalIterator()]
        shared = docs.sparkSession.sparkContext.broadcast(np.array(distinct, np.int64).view(np.uint64))
    run = lambda it: _doc_seeds(it, shared.value if shared else None, reordered)
    rows = docs.where("text is not null and doc_id is not null").select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, words array<long>, seeds array<long>, positions array<int>")
    rows = materialize(rows)

    doc_seeds = rows.select("doc_id", F.explode(F.arrays_zip("seeds", "positions")).alias("s")).select("doc_id", F.col("s.seeds").alias("seed"), F.col("s.positions").alias("doc_at"))
    # few seeds of items: joined where the documents' seeds are, so that no stock phrase becomes a hot key of a shuffle
    hits = doc_seeds.join(F.broadcast(item_seeds) if shared else item_seeds, "seed").withColumn("shift", F.col("doc_at") - F.col("item_at"))
    cells = hits.groupBy("doc_id", "item_id", F.floor(F.col("shift") / (BAND // 2)).cast("int").alias("cell")).agg(F.count(F.lit(1)).cast("int").alias("n"), F.min("shift").alias("low"), F.max("shift").alias("high"))
    pairs = cells.groupBy("doc_id", "item_id").agg(F.array_sort(F.collect_list(F.struct("cell", "n", "low", "high"))).alias("cells"))
    enough = F.aggregate("cells", F.lit(0), lambda n, c: n + c["n"]) >= MIN_SEEDS
    if not reordered:
        two = F.zip_with("cells", F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0))), lambda a, b: a["n"] + F.when(b["cell"] == a["cell"] + 1, b["n"]).otherwise(0))
        enough = enough & F.exists(two, lambda n: n >= MIN_SEEDS)
    pairs = pairs.where(enough)
    known_words = texts.select("item_id", F.col("words").alias("item_words"), "weights")
    if shared:
        known_words = F.broadcast(known_words)
    start = F.greatest(F.array_min(F.transform("cells", lambda c: c["low"])) - BAND, F.lit(0))
    length = F.greatest(F.array_max(F.transform("cells", lambda c: c["high"])) + F.size("item_words") + BAND - start, F.lit(0))
    pairs = materialize(pairs)
    if (pairs.agg(F.sum(F.size("cells"))).head()[0] or 0) <= MAX_BROADCAST_CELLS:  # few: sent to the words, which then need no shuffle
        pairs = F.broadcast(pairs)
    cut = rows.select("doc_id", "words").join(pairs, "doc_id").join(known_words, "item_id").select("doc_id", "item_id", "item_words", "weights", F.slice("words", start + 1, length).alias("doc_words"), start.alias("start"), "cells")
    told = cut.mapInPandas(lambda it: _judge(it, reordered), result)
    return told.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("passage_words", "covered_words", "item_words")])


def leaked_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of documents that hold a passage of MIN_WORDS words of an item, fully or nearly word for word; see :func:`tiled_pairs`."""
    return tiled_pairs(docs, items, reordered=False).where(F.col("passage_words") >= MIN_WORDS).select("doc_id", "item_id")


def covered_items(docs: DataFrame, items: DataFrame, share: float = COVERED) -> DataFrame:
    """Pairs with a passage of MIN_WORDS words, or with at least ``share`` of the item's words in tiles in any order, and their cover."""
    pairs = tiled_pairs(docs, items)
    cover = F.col("covered_words") / F.col("item_words")
    return pairs.withColumn("coverage", cover).where((F.col("passage_words") >= MIN_WORDS) | ((F.col("coverage") >= share) & (F.col("covered_words") >= MIN_WORDS)))
