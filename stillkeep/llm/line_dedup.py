"""Fuzzy line dedup by MinHash over character shingles.

Equal lines meet by a 64-bit hash. A distinct line's shingles are dealt to bins by hash and each bin keeps its
minimum; empty bins borrow from the next filled one. Bands of bins give candidates, exact Jaccard similarity of the
shingle sets confirms them, distributed union-find makes components, and the first line of each component stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stillkeep.llm.common import KeyFilter, mixed, stored, table, text_slices
from stillkeep.llm.near_dedup import linked_components

SHINGLE = 8  # characters (code points)
ROWS, BANDS = 5, 16


def _eights(units: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros stand after the end."""
    wide = np.zeros(len(units) + SHINGLE, dtype=np.uint8)
    wide[: len(units)] = units
    return np.ndarray((len(units),), "<u8", wide, strides=(1,)).copy()


def line_shingles(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line number, hash) of every shingle of several lines at once; a shorter line is one shingle. Not distinct.

    Characters up to U+00FF fill a byte each; the upper bits of others are mixed in for the shingles that hold them.
    """
    upper = None
    if len(data) and data.max() >= 0x80:
        begins = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        starts = begins[starts]
        data = points.astype(np.uint8)
        if points.max() > 0xFF:
            upper = _eights((points >> 8).astype(np.uint8)), _eights((points >> 16).astype(np.uint8))
    size = np.diff(starts)
    packed = _eights(data)  # the eight characters from each place on
    line = np.repeat(np.arange(len(size)), size)
    left = starts[1:][line] - np.arange(len(data))  # characters from here to the line's end
    whole = left >= SHINGLE

    def hashed(at: np.ndarray, keep: np.uint64 | np.ndarray, seed: int) -> np.ndarray:
        h = mixed(packed[at] & keep, seed)
        if upper is not None:
            for k, part in enumerate(upper):
                own = part[at] & keep
                h = np.where(own != 0, mixed(h ^ mixed(own, 20 + k), 30 + k), h)
        return h

    line_of, hashes = [line[whole]], [hashed(whole, np.uint64(0xFFFFFFFFFFFFFFFF), 0) if upper is not None else mixed(packed[whole])]
    short = np.flatnonzero((size > 0) & (size < SHINGLE))
    if len(short):
        keep = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (np.uint64(SHINGLE) - size[short].astype(np.uint64)))
        line_of.append(short)
        hashes.append(hashed(starts[short], keep, 9))
    return np.concatenate(line_of), np.concatenate(hashes)


def minhash(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Band keys (lines x BANDS, 32 bits) of one-permutation MinHash signatures."""
    bins, lines = ROWS * BANDS, len(starts) - 1
    line, h = line_shingles(data, starts)
    least = np.full(lines * bins, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(least, line * bins + (h % np.uint64(bins)).astype(np.int64), h)
    least = least.reshape(lines, bins)
    # an empty bin takes the value of the next filled one, around the end, marked by the distance
    own = np.arange(2 * bins)
    filled = np.where(np.tile(least == np.iinfo(np.uint64).max, 2), 2 * bins, own)
    nearest = np.minimum.accumulate(filled[:, ::-1], axis=1)[:, ::-1][:, :bins]
    away = (nearest - own[:bins]).astype(np.uint64)
    least = np.take_along_axis(least, nearest % bins, axis=1)
    values = mixed(least ^ (away * np.uint64(0x9E3779B97F4A7C15))).reshape(lines, BANDS, ROWS)
    key = np.zeros((lines, BANDS), dtype=np.uint64)
    for k in range(ROWS):
        key = mixed(key ^ values[:, :, k])
    return (key >> np.uint64(32)).astype(np.uint32)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node = batch.column(0).to_numpy()
        once = np.unique(node, return_index=True)[1]  # a line that the batch repeats is signed once
        batch = batch.take(pa.array(np.sort(once))) if len(once) < len(node) else batch
        for a, b, data, starts in text_slices(batch.column(1), 1 << 20):
            keys = minhash(data, starts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array([k.tobytes() for k in keys], pa.binary())], ["node", "keys"]
            )


def line_sets(lines: pa.Array) -> list[np.ndarray]:
    """The distinct shingle hashes of each line, sorted."""
    out = []
    for a, b, data, starts in text_slices(lines, 1 << 20):
        line, h = line_shingles(data, starts)
        h = h[np.argsort(line, kind="stable")].view(np.int64)  # two ascending runs, so this only merges
        ends = np.cumsum(np.bincount(line, minlength=b - a))
        for one in np.split(h, ends[:-1]):
            one.sort()
            out.append(one[np.concatenate(([True], one[1:] != one[:-1]))] if len(one) else one)
    return out


def _confirm(num: int, den: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = line_sets(batch.column("su")), line_sets(batch.column("sv"))
            common = [len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(left, right, strict=True)]
            keep = pa.array([den * c >= num * (len(a) + len(b) - c) for a, b, c in zip(left, right, common, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(keep), batch.column("v").filter(keep)], ["u", "v"])

    return confirm


def lines_of(text: Column) -> Column:
    return F.posexplode(F.split(F.coalesce(text.cast("string"), F.lit("")), "\n"))


def line_dedup(docs: DataFrame, num: int = 80, den: int = 100, name_bits: int = 64) -> DataFrame:
    """Lines whose sets of shingles of 8 characters have a Jaccard similarity of num / den or more, and their components.

    Returns one row per line: doc_id, line_no (from 0), line_class (the component's smallest line hash; its own
    where the line is alone), kept (the first line of the component by doc_id and line_no). Lines end at \\n;
    one that is blank has class null and is always kept. A null or empty text has one blank line. Rows repeated
    with one doc_id: of equal first lines both are kept. A null doc_id comes before all others. Other columns
    are not read. An empty table gives no rows.

    Pairs at the threshold are found with a chance of about 0.998, closer ones with more. A line's place in the work is
    named by ``name_bits`` bits of xxhash64, lines are told apart by that and a second, independent 64-bit hash: of different lines with one
    name only that of the smaller second hash is linked, the others are kept with all their copies, their class being that hash.
    """
    lines = docs.select("doc_id", lines_of(F.col("text")).alias("line_no", "line"))
    blank = ~F.col("line").rlike(r"\S")  # looks no further than the first visible character
    node, check = F.shiftright(F.xxhash64("line"), 64 - name_bits), F.xxhash64(F.lit(1), "line")
    # ids and hashes are written once; texts are read again where a set is wanted
    hashes = (F.when(~blank, node).alias("node"), F.when(~blank, check).alias("check"))
    places = stored(lines.select("doc_id", "line_no", *hashes), "lines")
    real = lines.where(~blank).select(node.alias("node"), "line")
    signed = stored(real.mapInArrow(_sign, "node bigint, keys binary").distinct(), "signatures")
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")
    bands = signed.select("node", "keys", band).select(
        "node",
        F.xxhash64("band", F.substring("keys", F.col("band") * 4 + 1, F.lit(4))).alias("key"),
    )

    def texts_of(wanted: DataFrame) -> DataFrame:
        near = KeyFilter(wanted, "node").matching(real, F.col("node"))
        one = near.groupBy("node").agg(F.min(F.struct(check.alias("check"), "line")).alias("l"))
        return one.join(wanted, "node", "left_semi").select("node", F.col("l.line").alias("items"), F.length("l.line").cast("bigint").alias("n"))

    confirm = lambda pairs: pairs.mapInArrow(_confirm(num, den), "u bigint, v bigint")
    found = linked_components(bands, texts_of, num, den, confirm=confirm, as_sets=lambda x: line_sets(pa.array(x)))
    first = (
        places.where("node IS NOT NULL")
        .groupBy("node")
        .agg(F.min(F.struct("check", "doc_id", "line_no")).alias("first"))
        .join(stored(found, "components"), "node", "left")
        .select("node", "first.check", F.struct("first.doc_id", "first.line_no").alias("first"), F.coalesce("component", "node").alias("line_class"))
    )
    least = first.groupBy("line_class").agg(F.min("first").alias("first"))
    classes = first.select("node", F.col("check").alias("linked"), "line_class").join(least, "line_class")
    other = F.col("check") != F.col("linked")
    return places.join(classes, "node", "left").select(
        "doc_id",
        "line_no",
        F.when(other, F.col("check")).otherwise(F.col("line_class")).alias("line_class"),
        (F.col("node").isNull() | other | F.col("first").eqNullSafe(F.struct("doc_id", "line_no"))).alias("kept"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"))
