"""Exact dedup by a Golomb-coded fingerprint exchange.

Every scan partition sorts the distinct fingerprints of its texts and sends them, Golomb-Rice
coded, to the owners of the fingerprint ranges. An owner answers each partition with one bitmap:
which of the fingerprints it sent occur elsewhere too. Only rows with such a fingerprint (or with one
repeated inside the partition) are suspects; a filter of 16 bits or more for each marked fingerprint picks them in
the second scan, and their texts are shuffled and compared byte by byte.
Fingerprints cross the network at about ``fp_bits - log2(fingerprints in the range)`` bits each.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillkeep.llm.common import KeyFilter, stored, table, text_hash


def golomb_encode(values: np.ndarray) -> bytes:
    """Sorted distinct unsigned values as a Golomb-Rice code of their gaps.

    Layout: count (8 bytes), Rice parameter (1 byte), length of the unary part (8 bytes), the
    quotients in unary (zeros, then a one), the remainders in fixed width.
    """
    n = len(values)
    if not n:
        return (0).to_bytes(8, "little") + bytes(9)
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    k = max(0, int(math.log2(max(1.0, float(values[-1]) / n * math.log(2)))))
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    stops = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(stops[-1]) + 1, dtype=np.uint8)
    unary[stops] = 1
    rest = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    head = np.packbits(unary).tobytes()
    return n.to_bytes(8, "little") + bytes([k]) + len(head).to_bytes(8, "little") + head + np.packbits(rest).tobytes()


def golomb_decode(blob: bytes) -> np.ndarray:
    """The values that ``golomb_encode`` coded."""
    n, k, head = int.from_bytes(blob[:8], "little"), blob[8], int.from_bytes(blob[9:17], "little")
    if not n:
        return np.zeros(0, dtype=np.uint64)
    stops = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, head, 17)))[:n]
    quotients = np.diff(stops, prepend=-1) - 1
    rest = np.unpackbits(np.frombuffer(blob, np.uint8, -1, 17 + head), count=n * k).reshape(n, k) if k else np.zeros((n, 0), np.uint8)
    low = (rest.astype(np.uint64) << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum((quotients.astype(np.uint64) << np.uint64(k)) + low, dtype=np.uint64)


def _sender(owners: int, fp_bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).to_numpy(zero_copy_only=False).astype(np.uint64) for b in batches]
        if not parts:
            return
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        cuts = np.searchsorted(values, (np.arange(1, owners, dtype=object) << fp_bits) // owners)
        out: dict[str, list] = {"part": [], "owner": [], "codes": [], "local": []}
        for owner, (own, n) in enumerate(zip(np.split(values, cuts), np.split(counts, cuts), strict=True)):
            if len(own):
                out["part"].append(TaskContext.get().partitionId())
                out["owner"].append(owner)
                out["codes"].append(golomb_encode(own))
                out["local"].append(np.packbits(n > 1).tobytes())
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("part", pa.int32()), ("owner", pa.int32()), ("codes", pa.binary()), ("local", pa.binary())]))

    return send


def _answer(own: pd.DataFrame) -> pd.DataFrame:
    """An owner: for each partition's fingerprints, a bitmap of those that another partition sent too."""
    lists = [golomb_decode(x) for x in own["codes"]]
    values, inverse, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    bits = np.split(counts[inverse] > 1, np.cumsum([len(x) for x in lists])[:-1])
    return pd.DataFrame({"part": own["part"], "owner": own["owner"], "bitmap": [np.packbits(b).tobytes() for b in bits]})


def _flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition: the fingerprints that its own counts or the owner's bitmap mark."""
    for batch in batches:
        found = [np.zeros(0, np.uint64)]
        for codes, local, bitmap in zip(*(batch.column(c).to_pylist() for c in ("codes", "local", "bitmap")), strict=True):
            values = golomb_decode(codes)
            marks = np.frombuffer(local, np.uint8) | np.frombuffer(bitmap, np.uint8)
            found.append(values[np.unpackbits(marks, count=len(values)).astype(bool)])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).astype(np.int64))], ["fp"])


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fp_bits: int = 48, per_owner: int = 200_000
) -> DataFrame:
    """Groups of byte-equal texts.

    Returns one row per input row: ``id_col``, keep_id (the group's largest id), group_size, kept,
    text_sha256, text_hash (``common.text_hash``); the other columns of ``docs`` are neither read nor returned, so their names cannot clash.
    A null text counts as empty, and empty texts are equal to each other. Rows repeated with the same id
    each count in group_size and are each kept if their id is the largest. A null id is smaller than any other;
    in a group of null ids only, keep_id is null and the rows are kept. An empty table gives no rows.

    fp_bits: bits of a fingerprint, at most 60; equal fingerprints only make suspects, so few bits cost
    time, never correctness. per_owner: rows for each range owner, which bounds an owner's memory.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("body"), F.sha2(text, 256).alias("sha"))
    fp = F.shiftright(F.conv(F.substring("sha", 1, 15), 16, 10).cast("bigint"), 60 - fp_bits)
    owners = max(4, math.ceil(docs.count() / per_owner))
    sent = stored(
        rows.select(fp.alias("fp")).mapInArrow(_sender(owners, fp_bits), "part int, owner int, codes binary, local binary"),
        "fingerprints",
    )
    answers = sent.select("part", "owner", "codes").groupBy("owner").applyInPandas(_answer, "part int, owner int, bitmap binary")
    flagged = sent.join(answers, ["part", "owner"]).mapInArrow(_flagged, "fp bigint").distinct()
    suspects = KeyFilter(stored(flagged, "flagged"), "fp").matching(rows, fp)
    # grouping on the text itself compares bytes; copies meet in the partial aggregate before the shuffle
    groups = (
        suspects.groupBy("sha", "body")
        .agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("sha", "keep", "n")
    )
    return rows.select("id", "sha", text_hash(F.col("body")).alias("text_hash")).join(groups, "sha", "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("bigint")).alias("group_size"),
        F.when(F.col("n").isNull(), F.lit(True)).otherwise(F.col("id").eqNullSafe(F.col("keep"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "text_hash",
    )


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("text_hash")


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
