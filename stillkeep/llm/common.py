"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillkeep.storage import dropped, stored, table

__all__ = ["KeyFilter", "components", "dropped", "hashed_words", "lowered", "mixed", "stored", "table", "text_slices", "without", "word_ids"]

MASK = (1 << 64) - 1

# ---------------------------------------------------------------- membership filter of bounded size

_WORD = 1 << 15  # bits in a bitmap of Spark's bitmap_* functions


def _as_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps as 64-bit integers, the first bit the lowest; Spark leaves out zero bytes at a bitmap's end."""
    for batch in batches:
        whole = [b.ljust(_WORD // 8, b"\0") for b in batch.column("_bitmap").to_pylist()]
        words = pa.FixedSizeListArray.from_arrays(pa.array(np.frombuffer(b"".join(whole), "<i8")), _WORD // 64)
        yield pa.RecordBatch.from_arrays([batch.column("_part"), words.cast(pa.list_(pa.int64()))], ["_part", "_words"])


class KeyFilter:
    """A one-hash Bloom filter over a long column: 16 to 32 bits a key, so that some 5 % of other rows pass.

    Spark builds it with its bitmap aggregates as a table of bitmaps of 4 KB, as 512 integers each, which is broadcast;
    ``max_bits`` (128 MB) bounds it. From 2**26 keys on more other rows pass. The filter only saves work, the exact steps after it decide.
    """

    def __init__(self, keys: DataFrame, column: str, max_bits: int = 1 << 30):
        bits, wanted = _WORD, 16 * keys.count()
        while bits < min(max_bits, wanted):
            bits *= 2
        self.bits = bits
        at = keys.select(F.pmod(F.xxhash64(F.col(column)), F.lit(bits)).alias("at"))
        parts = at.groupBy(F.expr(f"at div {_WORD}").alias("_part")).agg(F.expr(f"bitmap_construct_agg(at % {_WORD})").alias("_bitmap"))
        self.parts = stored(parts.mapInArrow(_as_words, "_part bigint, _words array<bigint>"), "filter")

    def marked(self, df: DataFrame, key: Column, name: str) -> DataFrame:
        """``df`` with a boolean column ``name``: false where ``key`` is certainly none of the keys."""
        at = df.select("*", F.pmod(F.xxhash64(key), F.lit(self.bits)).alias("_at"))
        place = (F.col("_at") % _WORD).cast("int")
        hit = F.coalesce(F.getbit(F.get("_words", F.shiftright(place, 6)), place % 64) == 1, F.lit(False))
        return at.join(F.broadcast(self.parts), F.expr(f"_at div {_WORD}") == F.col("_part"), "left").select(*(F.col(f"`{c}`") for c in df.columns), hit.alias(name))

    def matching(self, df: DataFrame, key: Column) -> DataFrame:
        """The rows of ``df`` that may have one of the keys."""
        return self.marked(df, key, "_may").where("_may").drop("_may")


# ---------------------------------------------------------------- hashing in NumPy


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift) of an array."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & MASK)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mixed(np.arange(256, dtype=np.uint64), 77)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


class _Tables:
    """Powers of the base and of its inverse, as long as the longest slice so far."""

    up = down = np.ones(1, dtype=np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n < 1 << 22:  # a longer text gets tables of its own, which then go
            if len(cls.up) < n:
                cls.up, cls.down = _powers(_BASE, n), _powers(_INVERSE, n)
            return cls.up, cls.down
        return _powers(_BASE, n), _powers(_INVERSE, n)


def hashed_words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of several texts at once: A-Z lower-cased, split at bytes 0x20 and 0x09-0x0D.

    data: the UTF-8 bytes of the texts one after the other; starts: each text's first byte and, last,
    the end. Returns each word's 64-bit hash, its text's number, its first byte and its end.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(n + 1, dtype=bool)
    edge[starts] = True
    before = np.concatenate(([False], word[:-1]))
    first = np.flatnonzero(word & (~before | edge[:n]))
    after = np.concatenate((word[1:], [False]))
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    up, down = _Tables.to(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[low] * up[:n], out=total[1:])
        hashes = mixed((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64))
    return hashes, np.searchsorted(starts, first, side="right") - 1, first, end


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def word_ids(data: np.ndarray, word: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Maximal runs of the bytes that ``word`` marks, within texts: no hash decides which are equal.

    Returns each run's number in the dictionary, its text's number, its first byte and its end, and the dictionary (binary).
    """
    n = len(data)
    none = np.zeros(0, dtype=np.int64)
    if not n:
        return none, none, none, none, pa.array([], pa.binary())
    edge = np.zeros(n + 1, dtype=bool)
    edge[starts] = True
    first = np.flatnonzero(word & (~np.concatenate(([False], word[:-1])) | edge[:n]))
    end = np.flatnonzero(word & (~np.concatenate((word[1:], [False])) | edge[1:])) + 1
    offsets = np.concatenate(([0], np.cumsum(end - first))).astype(np.int32)
    runs = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data[word])])
    coded = runs.dictionary_encode()
    texts = np.searchsorted(starts, first, side="right") - 1
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), texts, first, end, coded.dictionary


def text_slices(texts: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """A string array as (first row, end row, bytes, starts), about ``most`` bytes or one text at a time; null is empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    if not len(texts):
        return
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, side="right")) - 1)
        yield row, end, whole[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """The connected components of an edge table (u, v): rows (node, component), component the smallest node.

    Rounds of contraction: every node points to the neighbour (or itself) of smallest rank, edges move to the nodes two such
    steps away, loops go. The rank is the node itself and a random priority in turn. By the first a star around its smallest node goes
    in one round; the second leaves at most a constant share of the nodes in expectation, on chains too, so the rounds grow with
    the logarithm of the component size. Each round is joins and partial aggregates on slim rows, written to the shared folder.
    Null ends and loops are left out; an empty edge table gives an empty result.
    """
    live = stored(
        edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .where(F.col("u") < F.col("v"))
        .distinct(),
        tag,
    )
    nodes, turn = None, 0
    while not live.isEmpty():
        turn += 1
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        by = lambda c: F.col(c) if turn % 2 else F.xxhash64(F.col(c), F.lit(turn))  # noqa: B023, E731
        rank = lambda c: F.struct(by(c).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        step = (
            both.groupBy("u")
            .agg(F.min(rank("v")).alias("best"))
            .select("u", F.least("best", rank("u"))["n"].alias("p"))
        )
        step = stored(step, tag)
        parent = stored(step.join(step.select(F.col("u").alias("p"), F.col("p").alias("q")), "p").select("u", F.col("q").alias("p")), tag)
        moved = stored(
            live.join(parent.withColumnRenamed("p", "pu"), "u")
            .join(parent.select(F.col("u").alias("v"), F.col("p").alias("pv")), "v")
            .where(F.col("pu") != F.col("pv"))
            .select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v"))
            .distinct(),
            tag,
        )
        old = [live, step]
        if nodes is None:
            nodes = parent.select(F.col("u").alias("node"), F.col("p").alias("at"))
        else:
            old += [nodes, parent]
            nodes = stored(
                nodes.join(parent.select(F.col("u").alias("at"), "p"), "at", "left").select(
                    "node", F.coalesce("p", "at").alias("at")
                ),
                tag,
            )
        for gone in old:
            dropped(gone)
        live = moved
    if nodes is None:
        return live.select(F.col("u").alias("node"), F.col("v").alias("component"))
    least = nodes.groupBy("at").agg(F.min("node").alias("component"))
    return nodes.join(least, "at").select("node", "component")


def text_hash(text: Column) -> Column:
    """What tells rows of one id apart; a null text counts as empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) less the rows whose doc_id and text are in ``gone`` (doc_id, text_hash); null ids are equal here.

    Another text under a repeated id stays. Only rows that the filter lets through are joined.
    """
    key = lambda doc_id: F.xxhash64(doc_id.cast("bigint"))
    gone = stored(gone.select("doc_id", "text_hash", key(F.col("doc_id")).alias("key")).distinct(), "gone")
    whole = docs.select(F.struct("*").alias("row"))  # so that no name of docs can clash
    marked = KeyFilter(gone, "key").marked(whole, key(F.col("row.doc_id")), "may")
    rest = marked.where("may").withColumn("hash", text_hash(F.col("row.text")))
    same = rest["row.doc_id"].eqNullSafe(gone["doc_id"]) & (rest["hash"] == gone["text_hash"])
    return marked.where("NOT may").select("row").unionByName(rest.join(gone, same, "left_anti").select("row")).select("row.*")
