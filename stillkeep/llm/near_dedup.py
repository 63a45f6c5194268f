"""Near-duplicate documents by SetSketch registers.

A document's word-shingle set becomes 256 registers: each holds the smallest point that any shingle throws
on it, on a logarithmic scale and truncated, so registers of a union are the maxima of the parts' registers and
equal registers are as likely as sets are alike. Runs of registers are hashed into bands. Documents that
share a band are candidates; the likelihood of the joint register comparisons discards those that cannot
reach the threshold, and full sets confirm the rest.

Large buckets never become pair lists. Their members are dealt to chunks of bounded size and compared with their chunk and with a few
pivots that stand in every chunk, which links a group of near copies at once. What is left is compared exactly in blocks of bounded
size, between components and cells that a link can join, and a block gives out only a spanning forest of its links.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stillkeep.llm.common import KeyFilter, components, hashed_words, mixed, stored, table, text_hash, text_slices

REGISTERS = 256
BASE = 1.01  # ratio of neighbouring register values
_OFFSET = 400  # register value of a point at 1.0
_SLACK = 10.0  # a register stays empty with probability e**-10 for a document
BLOCK = 192  # members of a group in a block, about
ELEMENTS = 8_000_000  # set elements in a block, about: its memory
SALTS = 8  # parts of a group where it meets its size


def shingle_sets(data: np.ndarray, starts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle hash), distinct and sorted, of texts given as in ``hashed_words``.

    A text with fewer words than a shingle has its whole word sequence as one shingle; one without words has none.
    """
    w, doc, _, _ = hashed_words(data, starts)
    texts = len(starts) - 1
    n = np.bincount(doc, minlength=texts)

    def joined(first: np.ndarray, length: int) -> np.ndarray:
        h = mixed(w[first], length)
        for k in range(1, length):
            h = mixed(h ^ w[first + k], length + 1000 * k)
        return h

    first = np.arange(max(0, len(w) - words + 1))
    first = first[doc[first] == doc[first + words - 1]]
    docs, hashes = [doc[first]], [joined(first, words)]
    begin = np.concatenate(([0], np.cumsum(n)[:-1]))
    for length in range(1, words):
        short = np.flatnonzero(n == length)
        docs.append(short)
        hashes.append(joined(begin[short], length))
    doc, h = np.concatenate(docs).astype(np.int64), np.concatenate(hashes)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def setsketch(doc: np.ndarray, h: np.ndarray, sizes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Registers (texts x 256, uint16) of the sets of the wanted texts; zeros for the others.

    An element throws points in ascending order at exponential distances on registers drawn at random, all
    by its hash alone. Only points below a bound that leaves no register empty are generated, so a set
    costs some thousand points whatever its size.
    """
    m, texts = REGISTERS, len(sizes)
    least = np.full(texts * m, np.inf)
    live = np.flatnonzero(wanted[doc])
    bound = (math.log(m) + _SLACK) / np.maximum(sizes, 1)
    at = np.zeros(len(live))
    step, width = 0, 4
    while len(live):
        seeds = mixed(np.arange(step, step + width, dtype=np.uint64), 5)
        u = mixed(h[live][:, None] ^ seeds[None, :])
        points = at[:, None] + np.cumsum(-np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53), axis=1) / m
        ok = points <= bound[doc[live]][:, None]
        cells = doc[live][:, None] * m + (u & np.uint64(m - 1)).astype(np.int64)
        np.minimum.at(least, cells[ok], points[ok])
        more = ok[:, -1]
        at, live = points[more, -1], live[more]
        step += width
        width = 32 if len(live) < 20_000 else 4
    with np.errstate(divide="ignore"):
        values = np.floor(_OFFSET - np.log(least) / math.log(BASE))
    return np.clip(np.nan_to_num(values, neginf=0.0), 0, 65535).astype("<u2").reshape(texts, m)


def bands_for(threshold: float, misses: float = 5e-6) -> tuple[int, int]:
    """(registers in a band, bands): the longest bands by which a pair at the threshold is missed with at most this chance."""
    for rows in range(12, 0, -1):
        if (1 - threshold**rows) ** (REGISTERS // rows) <= misses:
            return rows, REGISTERS // rows
    return 1, REGISTERS


def _signer(words: int, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, starts in text_slices(batch.column(1)):
                doc, h = shingle_sets(data, starts, words)
                sizes = np.bincount(doc, minlength=b - a)
                # a smaller set can be linked with equal sets only, which its identity finds
                regs = setsketch(doc, h, sizes, sizes / (sizes + 1) >= threshold)
                h1, h2 = np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
                np.add.at(h1, doc, mixed(h, 1))
                np.add.at(h2, doc, mixed(h, 2))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(2).slice(a, b - a),
                        pa.array(sizes.astype(np.int64)),
                        pa.array(h1.view(np.int64)),
                        pa.array(h2.view(np.int64)),
                        pa.array([r.tobytes() if r.any() else None for r in regs], pa.binary()),
                    ],
                    ["id", "text_hash", "n", "h1", "h2", "regs"],
                )

    return sign


def _sets(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, starts in text_slices(batch.column(1)):
                doc, h = shingle_sets(data, starts, words)
                n = np.bincount(doc, minlength=b - a).astype(np.int64)
                lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n)))), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists.cast(pa.list_(pa.int64())), pa.array(n)], ["node", "items", "n"])

    return make


def _may_reach(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs whose registers do not speak against the threshold.

    With sizes known, P(register of u larger) = p(x - yJ) and P(of v larger) = p(y - xJ), where x and y are
    the shares of u and v in the sum of sizes and p(z) = -log_b(1 - z(b-1)/b). A pair goes if the likelihood at the
    threshold is e**-12 of the best one or less, and the best lies below it.
    """
    grid = np.linspace(0, 1, 101)

    def p(z: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-np.clip(z, 0, 1) * (BASE - 1) / BASE) / math.log(BASE), 1e-9, 1)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ru, rv = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(n, REGISTERS) for c in ("ru", "rv"))
            nu, nv = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("nu", "nv"))
            up, down = (ru > rv).sum(axis=1), (ru < rv).sum(axis=1)
            x = nu / (nu + nv)

            def likelihood(j: np.ndarray, x: np.ndarray = x, up: np.ndarray = up, down: np.ndarray = down) -> np.ndarray:
                a, b = p(x[:, None] - (1 - x)[:, None] * j), p((1 - x)[:, None] - x[:, None] * j)
                same = np.clip(1 - a - b, 1e-9, 1)
                return up[:, None] * np.log(a) + down[:, None] * np.log(b) + (REGISTERS - up - down)[:, None] * np.log(same)

            most = np.minimum(nu, nv) / np.maximum(nu, nv)
            all_j = np.where(grid[None, :] <= most[:, None], likelihood(grid[None, :]), -np.inf)
            best = grid[all_j.argmax(axis=1)]
            at = likelihood(np.full((1, 1), threshold))[:, 0]
            keep = (most >= threshold) & ((best >= threshold) | (at > all_j.max(axis=1) - 12))
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(pa.array(keep)), batch.column("v").filter(pa.array(keep))], ["u", "v"])

    return weigh


Sets = Callable[[pd.Series], list[np.ndarray]]


def _plain_sets(items: pd.Series) -> list[np.ndarray]:
    return [np.asarray(s, dtype=np.int64) for s in items]


def _forest(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """For each set the first one of its component, by exact intersection sizes."""
    k = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(k), size)
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[code] > 1
    owner, code = owner[shared], code[shared]
    _, code = np.unique(code, return_inverse=True)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    inter = np.zeros((k, k), dtype=np.float32)
    codes = int(code[-1]) + 1 if len(code) else 0
    wide = max(1, min(codes, (1 << 22) // k))
    for first in range(0, codes, wide):
        a, b = np.searchsorted(code, [first, first + wide])
        rows = np.zeros((k, wide), dtype=np.float32)
        rows[owner[a:b], code[a:b] - first] = 1
        inter += rows @ rows.T
    common = np.rint(inter).astype(np.int64)
    linked = den * common >= num * (size[:, None] + size[None, :] - common)
    np.fill_diagonal(linked, True)
    label = np.arange(k)
    while True:
        new = np.where(linked, label[None, :], k).min(axis=1)
        if (new == label).all():
            return label
        label = new


def _block_links(num: int, den: int, as_sets: Sets) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (block, node, items) in the order of blocks -> a spanning forest of the links among the sets of each block."""

    def links(nodes: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        label = _forest(sets, num, den)
        own = np.flatnonzero(label != np.arange(len(nodes)))
        return nodes[own], nodes[label[own]]

    def all_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last block, which may go on
        for batch in chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            rows = pa.Table.from_batches(held + ([batch] if batch is not None else [])).combine_chunks() if held or batch is not None else None
            if rows is None:
                return
            block = rows.column("block").to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]))
            last = len(cuts) - 1 if batch is None else len(cuts) - 2
            held = rows.slice(int(cuts[last])).to_batches()
            whole = rows.slice(0, int(cuts[last]))
            if not whole.num_rows:
                continue
            nodes, sets = whole.column("node").to_numpy(), as_sets(whole.column("items").to_pandas())
            found = [links(nodes[a:b], sets[a:b]) for a, b in zip(cuts[:last], cuts[1 : last + 1], strict=True) if b - a > 1]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["u", "v"])

    return all_blocks


def _met(num: int, den: int, as_sets: Sets) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Compares the members of a chunk with each other and with their group's pivots, which are in every chunk.

    Gives each member r, the smallest one of its component in the chunk, and its cell: d, how many threshold distances it lies from the
    group's smallest node (0: linked with it), and s, its size in steps of the threshold. The Jaccard distance is a metric, so linked
    members are at most one step apart in d, and in s likewise.
    """
    reach = (den - num) / den * (1 + 1e-9) or 1.0
    step = math.log(den / num) * (1 + 1e-9) or 1.0

    def met(chunk: pd.DataFrame) -> pd.DataFrame:
        chunk = chunk.sort_values("node")
        sets, node = as_sets(chunk["items"]), chunk["node"].to_numpy()
        of = int(np.flatnonzero(node == chunk["a"].to_numpy())[0])
        size = np.array([len(x) for x in sets], dtype=np.int64)
        common = np.array([len(np.intersect1d(x, sets[of], assume_unique=True)) for x in sets], dtype=np.int64)
        union = size + size[of] - common
        d = np.where(den * common >= num * union, 0, np.maximum(1, np.floor((1 - common / np.maximum(union, 1)) / reach)))
        s = np.floor(np.log(np.maximum(size, 1)) / step)
        r = node[_forest(sets, num, den)]
        return pd.DataFrame({"a": chunk["a"], "node": node, "pivot": chunk["pivot"], "d": d.astype(np.int32), "s": s.astype(np.int32), "n": size, "r": r})

    return met


def _blocks(rows: DataFrame, keys: list[str], block: int, elements: int) -> DataFrame:
    """(keys, blocks): in how many blocks of about ``block`` members and ``elements`` set elements at most a group goes."""
    most = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / elements))
    return rows.groupBy(*keys).agg(most.cast("int").alias("blocks"))


def _salted(rows: DataFrame, facts: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined with the facts of their group a. A group may hold a third of all rows: it meets its facts in parts."""
    parts = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return rows.withColumn("salt", _salt()).join(parts, ["a", "salt"], how).drop("salt")


def _salt() -> Column:
    return F.pmod(F.xxhash64("node", F.lit(5)), F.lit(SALTS))


def _compared(groups: DataFrame, sets: DataFrame, num: int, den: int, as_sets: Sets, block: int, elements: int) -> DataFrame:
    """The links (u, v), as spanning forests, within each group (a, node); a, the smallest node, is a member.

    A group of one block is compared whole. The members of a larger one are dealt to chunks of a block, and each is compared with its chunk and with
    the group's pivots, a among them, which stand in every chunk and tie the chunks together. That makes components of
    what is near each other, in work that grows with the members. Only members of different components need more: those in components of
    less than a block are compared with all others; members of larger ones only with other components, between cells (see ``_met``)
    that a link can join. All of it goes in blocks of bounded size.
    """
    members = groups.join(sets.select("node", "n"), "node")
    parts = stored(members.groupBy("a", _salt().alias("salt")).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.min("node").alias("node")), "parts")
    most = F.greatest(F.ceil(F.sum("k") / block), F.ceil(F.sum("n") / elements)).cast("int")
    sizes = stored(parts.groupBy("a").agg(most.alias("blocks")).where("blocks > 1"), "sizes")
    none = F.lit(0)
    in_blocks = lambda placed: _block_rows(placed, sets).mapInArrow(_block_links(num, den, as_sets), "u bigint, v bigint")
    one = F.xxhash64(none, "a").alias("block")
    if sizes.isEmpty():
        return in_blocks(groups.select("node", one))
    sized = stored(_salted(groups, sizes, "left"), "sized")
    upto = lambda n: F.explode(F.sequence(none, F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("node", F.lit(7)), n).cast("int")
    whole = sized.where("blocks IS NULL").select("node", one)
    pivots = parts.join(sizes, "a").select("a", "node", "blocks", F.lit(True).alias("pivot"))
    spread = pivots.select("a", "node", "pivot", upto("blocks").alias("chunk"))
    dealt = sized.where("blocks IS NOT NULL").join(pivots.select("a", "node"), ["a", "node"], "left_anti")
    dealt = dealt.select("a", "node", F.lit(False).alias("pivot"), F.pmod(F.xxhash64("node", F.lit(3)), "blocks").cast("int").alias("chunk"))
    # written first, so that sets are not shuffled for a few members
    chunks = stored(dealt.unionByName(spread), "chunks").join(sets.select("node", "items"), "node")
    shape = "a bigint, node bigint, pivot boolean, d int, s int, n bigint, r bigint"
    met = stored(chunks.groupBy("a", "chunk").applyInPandas(_met(num, den, as_sets), shape), "met")
    links = met.where("node <> r").select(F.col("r").alias("u"), F.col("node").alias("v"))
    joined = stored(components(links, "chunk_links"), "chunk_components")
    # a pivot has met its whole group
    rest = met.where("NOT pivot").join(joined, "node", "left").select("a", "node", "d", "s", "n", F.coalesce("component", "node").alias("c"))
    rest = stored(rest, "rest")
    counts = rest.groupBy("a", "c").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    small = F.col("k") < block  # a component of its own from a block on
    counts = stored(counts.withColumn("small", small), "counts")
    sums = F.sum(F.when(small, F.col("k"))).alias("k"), F.sum(F.when(small, F.col("n"))).alias("n"), F.sum("k").alias("all_k"), F.sum("n").alias("all_n"), F.count_if(~small).alias("large"), F.count(F.lit(1)).alias("parts")
    ceil = lambda k, n: F.greatest(F.ceil(F.col(k) / block), F.ceil(F.col(n) / elements)).cast("int")
    facts = counts.groupBy("a").agg(*sums).where("parts > 1")  # one component: nothing is left to compare
    facts = stored(facts.select("a", "large", F.coalesce(ceil("k", "n"), none).alias("few"), ceil("all_k", "all_n").alias("chunks")), "facts")
    large = counts.where("NOT small").select("a", "c", F.lit(True).alias("big"))
    rest = stored(_salted(rest, facts).join(large, ["a", "c"], "left").withColumn("big", F.coalesce("big", F.lit(False))), "open")
    # few members in small components: one block of them meets every chunk
    alone = rest.where("few = 1")
    dealt = F.when(F.col("big"), F.array(F.pmod(F.xxhash64("node", F.lit(3)), "chunks").cast("int"))).otherwise(F.sequence(none, F.col("chunks") - 1))
    strays = alone.select("node", "a", F.explode(dealt).alias("i")).select("node", F.xxhash64(F.lit(1), "a", "i").alias("block"))
    # others by component (all small ones as one) and cell; a pair of cells is met once, one large component not with itself
    rest = rest.where("few > 1 OR big AND large > 1").withColumn("c", F.when(F.col("big"), F.col("c")).otherwise(none))
    cell = ["a", "big", "c", "d", "s"]
    cells = stored(_blocks(rest, cell, block, elements), "cells")
    steps = F.array(*(F.struct(F.lit(d).alias("d"), F.lit(s).alias("s")) for d, s in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))))
    near = cells.withColumnRenamed("blocks", "k").withColumn("step", F.explode(steps))
    near = near.withColumn("e", F.col("d") + F.col("step.d")).withColumn("t", F.col("s") + F.col("step.s")).drop("step")
    to = {"big": "to_big", "c": "to_c", "d": "e", "s": "t"}
    near = near.join(cells.withColumnsRenamed(to | {"blocks": "l"}), ["a", "e", "t"])
    alike = (F.col("d") == F.col("e")) & (F.col("s") == F.col("t"))
    same = alike & (F.col("big") == F.col("to_big")) & (F.col("c") == F.col("to_c"))
    near = near.where("NOT (big AND to_big AND c = to_c)").where(~alike | (F.struct("big", "c") <= F.struct("to_big", "to_c")))
    near = stored(near, "near_cells")
    rest = rest.select("node", *cell)
    left = rest.join(near, cell).withColumn("i", own("k")).withColumn("j", upto("l"))
    left = left.withColumns({"i": F.when(same, F.least("i", "j")).otherwise(F.col("i")), "j": F.when(same, F.greatest("i", "j")).otherwise(F.col("j"))})
    right = rest.withColumnsRenamed(to).join(near.where(~same), ["a", *to.values()]).withColumn("j", own("l")).withColumn("i", upto("k"))
    ends = F.xxhash64(F.lit(2), *cell, *to.values(), "i", "j").alias("block")
    placed = whole.unionByName(strays).unionByName(left.select("node", ends)).unionByName(right.select("node", ends))
    return in_blocks(placed).unionByName(joined.select(F.col("component").alias("u"), F.col("node").alias("v")))


def _block_rows(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """(block, node, items) in the order of blocks and nodes, each block in one task."""
    # two blocks under one hash are compared as one, which loses nothing; small blocks share a batch
    rows = placed.join(sets.select("node", "items"), "node").select("block", "node", "items")
    return rows.repartition("block").sortWithinPartitions("block", "node")


def linked_components(
    bands: DataFrame,
    sets_of: Callable[[DataFrame], DataFrame],
    num: int,
    den: int,
    weigh: Callable[[DataFrame], DataFrame] | None = None,
    confirm: Callable[[DataFrame], DataFrame] | None = None,
    as_sets: Sets = _plain_sets,
    block: int = BLOCK,
    elements: int = ELEMENTS,
) -> DataFrame:
    """Components (node, component) of nodes that share a band key and whose sets are alike by num / den; single nodes are left out.

    bands: distinct (node, key). sets_of: (node, items, n) for a table of wanted nodes, one row for each, n the elements of a set or
    an upper bound. weigh: discards candidate pairs (u, v) before their sets are read. confirm: keeps the linked of pairs with items su
    and sv; as_sets: makes sets of items; both where items are not yet sets of integers. Buckets of more than three nodes that have one
    smallest node are compared as one group.
    """
    buckets = stored(
        bands.groupBy("key")
        .agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("a"), F.max("node").alias("b"), F.bit_xor("node").alias("x"))
        .where("k > 1"),
        "buckets",
    )
    # buckets of two and three: all pairs, weighed by likelihood
    third = F.col("a").bitwiseXOR(F.col("b")).bitwiseXOR(F.col("x"))
    pair = lambda u, v: F.struct(u.alias("u"), v.alias("v"))
    pairs = (
        buckets.where("k <= 3")
        .select(
            F.explode(
                F.when(F.col("k") == 2, F.array(pair(F.col("a"), F.col("b")))).otherwise(
                    F.array(pair(F.col("a"), F.col("b")), pair(F.col("a"), third), pair(third, F.col("b")))
                )
            ).alias("p")
        )
        .select("p.u", "p.v")
        .distinct()
    )
    pairs = stored(weigh(pairs) if weigh else pairs, "pairs")
    large = stored(buckets.where("k > 3").select("key", "a"), "large")
    near = KeyFilter(large, "key").matching(bands, F.col("key"))  # most keys are in no large bucket
    groups = stored(near.join(large, "key").select("a", "node").distinct(), "groups")
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).unionByName(groups.select("node")).distinct()
    sets = stored(sets_of(stored(wanted, "wanted")), "sets")
    of = lambda end: sets.select(F.col("node").alias(end), F.col("items").alias(f"s{end}"))
    joined = pairs.join(of("u"), "u").join(of("v"), "v")
    if confirm:
        confirmed = confirm(joined)
    else:
        common = F.size(F.array_intersect("su", "sv"))
        sizes = joined.select("u", "v", common.alias("c"), (F.size("su") + F.size("sv") - common).alias("all"))
        confirmed = sizes.where(F.col("c") * den >= F.col("all") * num).select("u", "v")
    return components(confirmed.unionByName(_compared(groups, sets, num, den, as_sets, block, elements)), "links")


def near_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100
) -> DataFrame:
    """Documents linked by den * |A & B| >= num * |A | B| on sets of ``words``-word shingles, and their components.

    Returns one row per input row: ``id_col``, n_shingles, component_id (the smallest id reachable, itself
    included), kept (its id is the component's), text_hash (``common.text_hash``). Other columns are neither read nor returned. A null or
    empty text, or one of white space, has no shingle and is linked with nothing. Equal sets are always linked. A repeated
    id with several texts: each text has its own links and component. A row without id belongs to the component of rows with
    its set, or to none (null). An empty table gives no rows.

    The candidate search misses a pair at the threshold with a chance below 5e-6 and a closer pair with less.
    """
    threshold = num / den
    text = F.col(text_col).cast("string")
    body = docs.select(F.col(id_col).alias("id"), text.alias("body"), text_hash(text).alias("text_hash"))
    shape = f"id {dict(body.dtypes)['id']}, text_hash bigint, n bigint, h1 bigint, h2 bigint, regs binary"
    signed = stored(body.mapInArrow(_signer(words, threshold), shape), "sketches")
    row = F.when(F.col("id").isNotNull(), F.struct(F.col("id").cast("bigint").alias("id"), "text_hash"))
    kinds = signed.where("n > 0").groupBy("n", "h1", "h2").agg(F.min(row).alias("row"), F.first("regs").alias("regs"))
    kinds = _numbered(stored(kinds.select("n", "h1", "h2", "row.id", "row.text_hash", "regs"), "kinds"))
    rows, count = bands_for(threshold)
    band = F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("band")
    bands = (
        kinds.where("node IS NOT NULL AND regs IS NOT NULL")
        .select("node", "regs", band)
        .select("node", F.xxhash64("band", F.substring("regs", F.col("band") * (2 * rows) + 1, F.lit(2 * rows))).alias("key"))
    )
    sketch = lambda end: kinds.select(F.col("node").alias(end), F.col("n").alias(f"n{end}"), F.col("regs").alias(f"r{end}"))

    def weigh(pairs: DataFrame) -> DataFrame:
        return pairs.join(sketch("u"), "u").join(sketch("v"), "v").mapInArrow(_may_reach(threshold), "u bigint, v bigint")

    def sets_of(wanted: DataFrame) -> DataFrame:
        own = stored(kinds.select("node", "id", "text_hash").join(wanted, "node"), "wanted_rows")
        near = KeyFilter(own, "id").matching(body, F.col("id").cast("bigint"))
        texts = near.join(own, ["id", "text_hash"]).select("node", "body").dropDuplicates(["node"])
        return texts.mapInArrow(_sets(words), "node bigint, items array<bigint>, n bigint")

    found = linked_components(bands, sets_of, num, den, weigh).join(kinds.select("node", "id"), "node")
    least = found.groupBy("component").agg(F.min("id").alias("least"))
    found = found.join(least, "component").select("node", "least")
    classes = kinds.join(found, "node", "left").select("n", "h1", "h2", F.coalesce("least", "id").alias("component_id"))
    return signed.join(classes, ["n", "h1", "h2"], "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("n") == 0, F.lit(True)).otherwise(F.col("id").eqNullSafe(F.col("component_id"))).alias("kept"),
        "text_hash",
    )


def _numbered(kinds: DataFrame) -> DataFrame:
    """With node: the id, but a new number above all ids where several sets have the same id."""
    kinds = kinds.withColumn("node", F.col("id"))
    several = stored(kinds.where("id IS NOT NULL").groupBy("id").count().where("count > 1").select("id"), "several")
    if several.isEmpty():
        return kinds
    top = kinds.agg(F.max("id")).first()[0]
    new = kinds.join(several, "id", "left_semi").withColumn("node", F.monotonically_increasing_id() + F.lit(top + 1))
    rest = kinds.join(several, "id", "left_anti")
    return stored(rest.unionByName(new.select(rest.columns)), "numbered")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), words=3, num=85, den=100).drop("text_hash")
