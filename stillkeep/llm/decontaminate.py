"""Benchmark decontamination by CGK embeddings.

Symbols are words. The CGK random walk reads a window from the left; at each step it writes the current
symbol and moves on or stays by a random bit of symbol and step, so windows at a small edit distance walk in
step again after an edit and agree in most places of the output. Keys sampled from those places (bit-sampling
LSH) are looked up in the items' keys; as many walks are made as a simulation needs for the target recall at the
largest distance. Every candidate is confirmed by its exact edit distance.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillkeep.llm.common import hashed_words, mixed, table, text_hash, text_slices

STRIDE = 4  # windows start at every fourth word of a document, items at their first four words; short items have fewer of both
TABLES = 6  # keys taken from one walk
PLACES = 4  # places of the output in a key
MOST_WALKS = 200  # where more were needed, shared word sequences give the candidates, all of them
CELLS = 4_000_000  # words of text that are walked or compared at once


def walks(words: np.ndarray, length: int, walk: int) -> np.ndarray:
    """CGK output of the given walk for each row of words (rows x width; 0 stands after the end): rows x length symbols."""
    at = np.zeros(len(words), dtype=np.int64)
    rows = np.arange(len(words))
    out = np.zeros((len(words), length), dtype=np.uint64)
    for step in range(length):
        own = out[:, step] = words[rows, at]
        move = mixed(own, (walk << 24) + step) & np.uint64(1)
        at = np.minimum(at + move.astype(np.int64), words.shape[1] - 1)
    return out


def sampled_keys(out: np.ndarray, walk: int, table_no: int, places: int) -> np.ndarray:
    """A key of each row from ``places`` random places of its CGK output."""
    chosen = np.random.default_rng([walk, table_no, out.shape[1]]).choice(out.shape[1], min(places, out.shape[1]), replace=False)
    key = np.zeros(len(out), dtype=np.uint64)
    for place in chosen:
        key = mixed(key ^ out[:, place], int(place) + 1)
    return key


def _edited(rng: np.random.Generator, words: np.ndarray, edits: int) -> np.ndarray:
    row = list(words)
    for _ in range(edits):
        at, kind = int(rng.integers(len(row))), int(rng.integers(3))
        if kind == 0:
            row[at] = rng.integers(1 << 63)
        elif kind == 1:
            del row[at]
        else:
            row.insert(at, rng.integers(1 << 63))
    return np.array(row, dtype=np.uint64)


def edits_of(words: int, num: int, den: int) -> int:
    """The largest edit distance at which ``words`` words still have a similarity of num / den."""
    return (den - num) * words // den


def walks_needed(words: int, distance: int, steps: int, stride: int, places: int, recall: float, trials: int = 400) -> int | None:
    """Walks for which the tables find an item at this distance with the target probability, by simulation; None if MOST_WALKS do not.

    As in a document, the passage stands among other words and starts anywhere on the grid; the windows before
    it and at its first grid place meet the item at all of its first places.
    """
    rng = np.random.default_rng([words, distance, steps])
    item = rng.integers(1, 1 << 63, (trials, words)).astype(np.uint64)
    lefts = [np.pad(item[:, s:], ((0, 0), (0, steps + 1))) for s in range(stride)]
    rights = np.zeros((2, trials, steps + 1), dtype=np.uint64)
    for k in range(trials):
        around = rng.integers(1, 1 << 63, stride + steps + 1).astype(np.uint64)
        row = np.concatenate([around[:stride], _edited(rng, item[k], distance), around[stride:]])
        first = stride + int(rng.integers(stride))
        rights[0, k], rights[1, k] = row[first - stride :][: steps + 1], np.resize(row[first : first + steps + 1], steps + 1)
    missed = np.ones(trials, dtype=bool)
    for walk in range(MOST_WALKS):
        outs = [walks(x, steps, walk) for x in lefts], [walks(x, steps, walk) for x in rights]
        for t in range(TABLES):
            own, seen = ([sampled_keys(x, walk, t, places) for x in side] for side in outs)
            for a in own:
                for b in seen:
                    missed &= a != b
        if missed.mean() <= 1 - recall:
            return walk + 1
    return None


@dataclass
class Length:
    """Items of about one length: what their windows hold and which keys they have."""

    least: int
    most: int
    stride: int  # windows start at each so many words, items at that many first words
    steps: int
    walks: int
    gram: int  # words in a row that a match within the distance must share with its item
    grams: np.ndarray  # the items' word sequences of that length, sorted
    gram_items: tuple[np.ndarray, np.ndarray, np.ndarray] | None  # without walks: the sequences again, each with its item and its place there
    keys: list[np.ndarray]  # for each walk and table, sorted
    owners: list[np.ndarray]  # the item of each key
    plain: int  # words of the window that the last key takes as they are, so that a passage without an edit is found


@dataclass
class Index:
    ids: list[int]
    items: list[np.ndarray]
    vocabulary: np.ndarray
    lengths: list[Length]
    num: int
    den: int


def grams_of(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of the ``size`` words from each place on."""
    n = max(0, len(words) - size + 1)
    out = mixed(words[:n], size)
    for k in range(1, size):
        out = mixed(out ^ words[k : k + n], size + k)
    return out


def build_index(items: list[tuple[int, str]], num: int, den: int, recall: float, places: int = PLACES) -> Index:
    ids, words = [], []
    for item_id, text in items:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        h = hashed_words(raw, np.array([0, len(raw)]))[0]
        if len(h):
            ids.append(item_id)
            words.append(h)
    lengths = []
    low = min((len(w) for w in words), default=1)
    while low <= max((len(w) for w in words), default=0):
        high = max(low + 1, int(low * 1.3))
        own = [k for k, w in enumerate(words) if low <= len(w) < high]
        if own:
            shifts = range(min(STRIDE, max(1, low // 4)) if low > STRIDE else 1)
            steps = max(1, int(1.8 * (low - len(shifts) + 1)))
            width = high + 1
            rows = np.zeros((len(own) * len(shifts), width), dtype=np.uint64)
            for r, (k, shift) in enumerate((k, s) for k in own for s in shifts):
                part = words[k][shift:]
                rows[r, : len(part)] = part
            owner = np.repeat(np.array(own), len(shifts))
            # the hardest length is the least one with the most edits
            edits = edits_of(high - 1, num, den)
            hardest = next(k for k in range(low, high) if edits_of(k, num, den) == edits)
            n = walks_needed(hardest, edits, steps, len(shifts), places, recall)
            keys, owners = [], []
            for walk in range(n or 0):
                out = walks(rows, steps, walk)
                for t in range(TABLES):
                    key = sampled_keys(out, walk, t, places)
                    order = np.argsort(key, kind="stable")
                    keys.append(key[order])
                    owners.append(owner[order])
            plain = low - len(shifts) + 1
            key = grams_of(rows[:, :plain].reshape(-1), plain)[::plain]
            order = np.argsort(key, kind="stable")
            keys.append(key[order])
            owners.append(owner[order])
            # that many edits cut an item into at most one piece more, and one of the pieces has this length
            gram = max(1, low // (edits + 1))
            parts = [grams_of(words[k], gram) for k in own]
            grams = np.concatenate(parts)
            order = np.argsort(grams, kind="stable")
            of = np.repeat(np.array(own), [len(x) for x in parts])[order], np.concatenate([np.arange(len(x)) for x in parts])[order]
            found = None if n else (grams[order], *of)
            lengths.append(Length(low, high - 1, len(shifts), steps, n or 0, gram, np.unique(grams), found, keys, owners, plain))
        low = high
    vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
    return Index(ids, words, vocabulary, lengths, num, den)


def edit_places(text: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of text words: the least edit distance of the item to any stretch of the row, and where that ends.

    Exact dynamic programming over all rows at once; a stretch may start and end anywhere.
    """
    width = text.shape[1]
    place = np.arange(width + 1)
    last = np.zeros((len(text), width + 1), dtype=np.int32)
    for i, symbol in enumerate(item):
        new = np.empty_like(last)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(last[:, 1:] + 1, last[:, :-1] + (text != symbol))
        last = np.minimum.accumulate(new - place, axis=1) + place
    return last.min(axis=1), last.argmin(axis=1)


def _candidates(w: np.ndarray, first: np.ndarray, count: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(window start, item) pairs whose keys meet, for texts with words w[first[d] : first[d] + count[d]]."""

    def counted(values: np.ndarray, among: np.ndarray) -> np.ndarray:
        """How many of the values before each place are among the sorted ones."""
        out = np.zeros(len(w) + 1, dtype=np.int64)
        if len(among):
            some = np.zeros(1 << 20, dtype=bool)  # by the top bits, so that few values need a search
            some[among >> np.uint64(44)] = True
            found = some[values >> np.uint64(44)]
            near = np.flatnonzero(found)
            at = np.minimum(np.searchsorted(among, values[near]), len(among) - 1)
            found[near] = among[at] == values[near]
            np.cumsum(found, out=out[1 : len(values) + 1])
            out[len(values) + 1 :] = out[len(values)]
        return out

    known = counted(w, index.vocabulary)
    sizes = {own.gram: grams_of(w, own.gram) for own in index.lengths}
    grids = {}
    for stride in {own.stride for own in index.lengths}:
        grid = np.concatenate([np.arange(a, a + n, stride) for a, n in zip(first, count, strict=True)]) if len(first) else first
        grids[stride] = grid, np.repeat(first + count, -(-count // stride))
    starts, items = [], []

    def look_up(q: np.ndarray, key: np.ndarray, keys: np.ndarray, owners: np.ndarray, places: np.ndarray | None = None, least: np.ndarray | None = None) -> None:
        """Notes where keys of the text meet keys of items; with places, where the item would start, not before ``least``."""
        lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
        hit = np.flatnonzero(hi > lo)
        for k in range(int((hi - lo)[hit].max(initial=0))):
            some = hit[(hi - lo)[hit] > k]
            starts.append(q[some] if places is None else np.maximum(q[some] - places[lo[some] + k], least[some]))
            items.append(owners[lo[some] + k])

    whose = np.repeat(np.arange(len(first)), count)

    for own in index.lengths:
        if own.gram_items:
            keys, owners, places = own.gram_items
            here = np.arange(max(0, len(w) - own.gram + 1))
            here = here[whose[here] == whose[here + own.gram - 1]] if len(here) else here
            look_up(here, sizes[own.gram][here], keys, owners, places, first[whose[here]])
            continue
        # a stretch that matches has at most `reach` words, of which all but the edits are words of the item
        grid, end_of = grids[own.stride]
        reach = own.most + edits_of(own.most, index.num, index.den)
        need = own.least - edits_of(own.least, index.num, index.den) - own.stride
        stop = np.minimum(grid + reach, end_of)
        seeds = counted(sizes[own.gram], own.grams)
        live = (known[stop] - known[grid] >= max(1, need)) & (seeds[stop] > seeds[np.maximum(grid - STRIDE, 0)])
        p, e = grid[live], end_of[live]
        some = max(1, CELLS // (3 * own.steps))
        for a in range(0, len(p), some):
            q, f = p[a : a + some], e[a : a + some]
            cells = q[:, None] + np.arange(own.steps + 1)
            rows = np.where(cells < f[:, None], w[np.minimum(cells, len(w) - 1)], np.uint64(0))
            for walk in range(own.walks):
                out = walks(rows, own.steps, walk)
                for t in range(TABLES):
                    at = walk * TABLES + t
                    look_up(q, sampled_keys(out, walk, t, PLACES), own.keys[at], own.owners[at])
            whole = q + own.plain <= f
            key = grams_of(rows[whole][:, : own.plain].reshape(-1), own.plain)[:: own.plain]
            look_up(q[whole], key, own.keys[-1], own.owners[-1])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique(np.stack([np.concatenate(items), np.concatenate(starts)], axis=1), axis=0)
    return both[:, 1], both[:, 0]


def contaminated_spans(w: np.ndarray, first: np.ndarray, count: np.ndarray, index: Index) -> list[tuple[int, int, int, int]]:
    """(text number, item number, distance, end word in the text) of the best stretch for each pair within the distance."""
    starts, items = _candidates(w, first, count, index)
    best: dict[tuple[int, int], tuple[int, int]] = {}
    doc = np.searchsorted(first, starts, side="right") - 1 if len(starts) else starts
    # texts without words share their first place with the next text, which then comes last at that place
    for item in np.unique(items):
        words = index.items[item]
        most = edits_of(len(words), index.num, index.den)
        own = np.flatnonzero(items == item)
        width = 2 * (len(words) + most) + STRIDE
        at_once = max(1, CELLS // (2 * width))
        for a in range(0, len(own), at_once):
            some = own[a : a + at_once]
            d = doc[some]
            left = np.maximum(first[d], starts[some] - most - STRIDE)
            cells = left[:, None] + np.arange(width)
            text = np.where(cells < (first[d] + count[d])[:, None], w[np.minimum(cells, len(w) - 1)], np.uint64(0))
            distance, end = edit_places(text, words)
            for k in np.flatnonzero(distance <= most):
                pair = (int(d[k]), int(item))
                found = (int(distance[k]), int(left[k] + end[k] - first[d[k]]))
                if pair not in best or found < best[pair]:
                    best[pair] = found
    return [(d, i, distance, end) for (d, i), (distance, end) in sorted(best.items())]


SCHEMA = "doc_id bigint, item_id bigint, distance int, item_words int, end_word bigint, text_hash bigint"


def _search(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        names = ("doc_id", "item_id", "distance", "item_words", "end_word", "text_hash")
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        for batch in batches:
            ids, hashes = batch.column(0), batch.column(2)
            rows: list[tuple] = []
            for a, b, data, starts in text_slices(batch.column(1)):
                w, doc, _, _ = hashed_words(data, starts)
                count = np.bincount(doc, minlength=b - a)
                first = np.cumsum(count) - count
                for d, item, distance, end in contaminated_spans(w, first, count, index):
                    rows.append((ids[a + d].as_py(), index.ids[item], distance, len(index.items[item]), end, hashes[a + d].as_py()))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return search


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, num: int = 80, den: int = 100, recall: float = 0.98, block_words: int = 500_000
) -> DataFrame:
    """Documents that hold a stretch within edit distance ``(den - num) * words // den`` of a benchmark item, in words.

    Returns one row per (doc_id, item_id) found: the distance of the best stretch, the item's number of words, the
    word of the document at which the stretch ends (from 0, exclusive), and text_hash (``common.text_hash``). Case of A-Z and
    white space do not count. ``recall`` is for windows at the largest distance; items that occur without an edit are always
    found. Where walks cannot reach the recall, all stretches that share a word sequence with an item, which a match must, are compared.
    The benchmark is broadcast in blocks of about ``block_words`` words; a larger one takes a scan for each block.
    Null and empty texts on either side match nothing, null ids stay null, repeated documents give rows each, repeated
    items too; other columns are not read. An empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    named = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    words = named.agg(F.sum(F.size(F.split(F.trim("text"), r"\s+")).cast("bigint"))).first()[0] or 0
    blocks = max(1, math.ceil(words / block_words))
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), text_hash(text).alias("text_hash"))
    out = None
    for block in range(blocks):
        own = named.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        index = build_index([(r["item_id"], r["text"]) for r in own.collect()], num, den, recall, PLACES)
        found = texts.mapInArrow(_search(spark.sparkContext.broadcast(index)), SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")
