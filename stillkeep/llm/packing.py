"""Best-fit packing of token sequences by exact-complement hashing.

Lengths are integers up to the capacity, so what has to be packed is a histogram of at most
``capacity`` numbers, whatever the corpus. The plan is made on that histogram: sums of one, two
and three available lengths are indexed, combinations that fill a gap exactly are consumed as
often as their counts allow, and what remains is placed best-fit. Spark does all that grows with the
corpus: tokenising, counting, ranking the pieces of a length (in salted groups, then added up) and
placing each piece by its rank.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stillkeep.llm.common import stored, table

CAPACITY = 1024
END_ID = 2


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _encoder(path: str) -> Callable[[str], list[int]]:
    """Texts to ids of a byte-level BPE file, its added tokens too.

    The rank file of the same vocabulary beside it gives equal ids faster, where added tokens are plain literals.
    """
    ranks = path.removesuffix(".json") + ".tiktoken"
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens") or []
    plain = not any(x.get(flag) for x in added for flag in ("single_word", "lstrip", "rstrip", "normalized"))
    if plain and os.path.exists(ranks):
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            pieces = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = {x["content"]: x["id"] for x in added}
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pieces, special_tokens=special)
        # a text without an added token has the same ids by the quicker call
        return lambda text: own.encode(text, allowed_special="all") if any(x in text for x in special) else own.encode_ordinary(text)
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    return lambda text: whole.encode(text, add_special_tokens=False).ids


PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
)


def _cutter(path: str, capacity: int, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "")
                ids.append(end_id)
                raw = struct.pack(f"<{len(ids)}I", *ids)
                ends = range(len(ids) % capacity or capacity, len(ids) + 1, capacity)
                for piece, end in enumerate(ends):
                    start = max(0, end - capacity)
                    out.append((doc_id, piece, start, end - start, zlib.crc32(raw[4 * start : 4 * end])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), PIECES.types, strict=True)] if out else [pa.array([], t) for t in PIECES.types], schema=PIECES)

    return cut


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every document's ids and the end id, cut into pieces of ``capacity`` where longer; the first piece takes the odd rest."""
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        _cutter(path or tokenizer_path(), capacity, end_id),
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint",
    )


def pack_plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths that share a sequence) and how often each is used; every length is used exactly as often as it occurs.

    Exact complements of one length are consumed first, then those of two and of three, even ones before uneven ones, so that small pieces
    are left for gaps that nothing else fills. Where stopping at two, one or none (plain best fit) needs fewer sequences, as few
    pieces of many lengths may, that plan is taken.
    """
    plans = (_plan(histogram, capacity, most) for most in (3, 2, 1, 0))
    return min(plans, key=lambda plan: sum(times for _, times in plan))


def _plan(histogram: dict[int, int], capacity: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    plan: list[tuple[tuple[int, ...], int]] = []

    def use(pattern: tuple[int, ...]) -> bool:
        """Consume a pattern as often as the counts allow."""
        need: dict[int, int] = {}
        for x in pattern:
            need[x] = need.get(x, 0) + 1
        times = min(int(left[x]) // k for x, k in need.items())
        if times > 0:
            plan.append((pattern, times))
            for x, k in need.items():
                left[x] -= times * k
        return times > 0

    def pairs(gap: int) -> list[tuple[int, int]]:
        """Available a >= b with a + b = gap, the most even first: the index of pair sums, read at one sum."""
        b = np.arange(gap // 2, 0, -1)
        b = b[(left[b] > 0) & (left[gap - b] > 0)] if len(b) else b
        return [(gap - int(x), int(x)) for x in b]

    for size in range(capacity, 0, -1):
        if left[size] and size == capacity:
            use((size,))
        elif left[size] and most > 0:
            use((size, capacity - size))
    for size in range(capacity - 1, 0, -1) if most > 1 else ():
        for a, b in pairs(capacity - size) if left[size] else ():
            if not left[size]:
                break
            use((size, a, b))
    for size in range(capacity - 1, 0, -1) if most > 2 else ():
        gap = capacity - size
        for a in sorted(range(1, min(size, gap - 2) + 1), key=lambda x: (abs(3 * x - gap), x)) if left[size] else ():
            if not left[size]:
                break
            for b, c in pairs(gap - a) if left[a] else ():
                if b <= a and left[a] and left[size]:
                    use((size, a, b, c))
    # best fit on what remains: longest first into the open sequences of smallest sufficient gap
    open_by_gap: dict[int, list[list]] = {}
    for size in range(capacity, 0, -1):
        n = int(left[size])
        while n:
            gap = min((g for g in open_by_gap if g >= size), default=0)
            if not gap:
                each, bins, pattern = capacity // size, 0, ()
                bins = max(1, n // each)
            else:
                pattern, bins = open_by_gap[gap].pop()
                if not open_by_gap[gap]:
                    del open_by_gap[gap]
                each = gap // size
            each = min(each, n)
            used = min(bins, n // each)
            if gap and used < bins:
                open_by_gap.setdefault(gap, []).append([pattern, bins - used])
            open_by_gap.setdefault((gap or capacity) - each * size, []).append([(*pattern, *[size] * each), used])
            n -= used * each
    plan += [(tuple(pattern), n) for group in open_by_gap.values() for pattern, n in group]
    return plan


def _segments(plan: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, first sequence and offset of each slot that the plan gives to it."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    taken = [0] * (capacity + 1)
    base = 0
    for pattern, times in plan:
        offset = 0
        for size in pattern:
            slots.setdefault(size, []).append((taken[size], base, offset))
            taken[size] += times
            offset += size
        base += times
    return {size: tuple(np.array(c, dtype=np.int64) for c in zip(*own, strict=True)) for size, own in slots.items()}


def best_fit_packing(pieces: DataFrame, capacity: int = CAPACITY, salt_rows: int = 20_000) -> DataFrame:
    """Pieces with 1 <= length <= capacity get sequence_id and offset; the other columns stay.

    Sequences are gapless from offset 0 and hold at most ``capacity``. Rows that are equal in all columns
    are separate pieces and spread like others. An empty table gives no rows. A length that a third of all rows share is ranked in
    groups of about ``salt_rows`` rows. The plan holds a few patterns for each length; its size is bounded
    by the capacity, not by the corpus.
    """
    spark, columns = pieces.sparkSession, pieces.columns
    numbered = stored(pieces.withColumn("_at", F.monotonically_increasing_id()), "pieces")  # written, so that every scan sees the same numbers
    pieces = numbered.select(columns)
    counts = {int(r[0]): r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    salts = max(1, sum(counts.values()) // salt_rows)
    salted = numbered.withColumn("_salt", F.pmod(F.xxhash64("_at"), F.lit(salts)))
    before = (
        salted.groupBy("length", "_salt")
        .count()
        .withColumn(
            "_before",
            F.sum("count").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)),
        )
        .select("length", "_salt", F.coalesce("_before", F.lit(0)).alias("_before"))
    )
    own = Window.partitionBy("length", "_salt").orderBy("_at")
    ranked = salted.withColumn("_own", F.row_number().over(own) - 1).join(before, ["length", "_salt"])
    ranked = ranked.select(*pieces.columns, (F.col("_before") + F.col("_own")).alias("_rank"))
    slots = spark.sparkContext.broadcast(_segments(pack_plan(counts, capacity), capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False).astype(np.int64)
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                first, base, place_in = slots.value[int(s)]
                k = np.searchsorted(first, rank[at], side="right") - 1
                sequence[at], offset[at] = base[k] + rank[at] - first[k], place_in[k]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in batch.schema.names if c != "_rank"), pa.array(sequence), pa.array(offset)],
                [*(c for c in batch.schema.names if c != "_rank"), "sequence_id", "offset"],
            )

    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, schema)


def packed_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut and pack documents.

    A null text is empty and becomes the end id alone; a null doc_id stays null; repeated rows are packed each.
    Other columns are not read.
    """
    return best_fit_packing(token_pieces(docs, path, capacity), capacity)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))
