"""Phrase collocations by SON partitioning.

A shard is a bounded share of the text in one task. A phrase that occurs ``support`` times overall occurs, in one shard
at least, in proportion to the shard's share of all bytes or more often (else the sum over the shards would fall short). So each shard is mined
completely at that lowered support, level by level, and sends what is frequent there; the union, as a filter of bounded size, goes back
to the shards, and what passes is counted in all of them and summed exactly. The filter may let
more pass, which the sums then drop; it never holds a candidate back.

The more shards, the lower the local support, until every phrase is frequent in its shard. So words and pairs, of which everything
longer is made, are summed before: shards send them as sorted compressed hashes with counts to owners of hash ranges, and
shards are mined for phrases of frequent words and pairs alone, which keeps the union small at any number of shards.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stillkeep.llm.common import lowered, mixed, stored, table, text_slices, word_ids
from stillkeep.llm.lm_scoring import packed, packed_keys, unpacked, unpacked_keys

_PIECE_END = np.zeros(256, dtype=bool)
_PIECE_END[list(b".,;:!?\n\x0b\x0c\r")] = True
_ENDS = re.compile(rb"[.,;:!?\x0a-\x0d]")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BITMAP = 1 << 15  # bits in a bitmap of Spark's bitmap_* functions


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct keys in order: a place of each, each place's number, and the counts; 32 bits wherever they do."""
    by = np.argsort(keys).astype(np.int32)
    keys = keys[by]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    del keys
    heads = np.flatnonzero(new)
    number = np.empty(len(by), dtype=np.int32)
    number[by] = np.cumsum(new, dtype=np.int32) - 1
    return by[heads], number, np.diff(heads, append=len(by))


class Shard:
    """The words of some texts as numbers, and their phrases level by level."""

    def __init__(self, langs: list[str], texts: pa.Array):
        self.lang_names = sorted(set(langs))
        place = {name: k for k, name in enumerate(self.lang_names)}
        lang_of = np.array([place[x] for x in langs], dtype=np.int32)
        known: dict[bytes, int] = {}
        self.bytes = 0
        codes, joined, spoken = [np.zeros(0, np.int32)], [np.zeros(0, bool)], [np.zeros(0, np.int32)]
        for row, stop, data, starts in text_slices(texts, 1 << 22):  # what is held at once is a few bytes for each word, not for each byte
            self.bytes += len(data)
            end, low = _PIECE_END[data], lowered(data)
            word, text, first, _, words = word_ids(low, ~(end | (low == 32) | (low == 9)), starts)
            if len(word):
                pieces = np.cumsum(end, dtype=np.int32)[first]
                codes.append(np.array([known.setdefault(w, len(known)) for w in words.to_pylist()], dtype=np.int32)[word])
                joined.append(np.concatenate(([False], (text[1:] == text[:-1]) & (pieces[1:] == pieces[:-1]))))
                spoken.append(lang_of[row:stop][text])
        self.words = pa.array(list(known), pa.binary())
        del known
        self.joined = np.concatenate(joined)  # with the word before, in one piece
        lang, word = np.concatenate(spoken), np.concatenate(codes)
        del codes, joined, spoken
        self.n_words = np.bincount(lang, minlength=len(self.lang_names))
        # a word of a language is a number; those that occur are counted and renumbered without a sort
        word = word + lang * np.int64(max(1, len(self.words)))
        del lang
        all_n = np.bincount(word, minlength=len(self.lang_names) * max(1, len(self.words)))
        own = np.flatnonzero(all_n)
        self.n = all_n[own]
        number = np.zeros(len(all_n), dtype=np.int32)
        number[own] = np.arange(len(own), dtype=np.int32)
        self.ids = number[word]
        del word, number, all_n
        self.lang_of, self.word_of = np.divmod(own, max(1, len(self.words)))
        seeds = [xxhash.xxh64_intdigest(x.encode()) for x in self.lang_names]
        spelt = self.words.to_pylist()
        self.hashes = np.array([xxhash.xxh64_intdigest(spelt[w], seeds[k]) for k, w in zip(self.lang_of.tolist(), self.word_of.tolist(), strict=True)], dtype=np.uint64)

    def levels(self, longest: int, kept: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(words, places, counts, hashes) of the distinct phrases of each length that ``kept`` (hashes, counts) keeps.

        A phrase is only looked at where both of its parts that are one word shorter are kept.
        """
        ids, hashes = self.ids, self.hashes
        keep = kept(hashes, self.n)
        where = np.arange(len(ids), dtype=np.int32)  # places that ids belong to
        first = np.full(len(self.n), -1, dtype=np.int32)
        first[ids[::-1]] = where[::-1]
        yield 1, first[keep], self.n[keep], hashes[keep]
        for size in range(2, longest + 1):
            good = keep[ids]
            # two places in a row, both kept, and the last word in the same piece
            pair = np.flatnonzero(good[:-1] & good[1:] & (where[1:] == where[:-1] + 1))
            pair = pair[self.joined[where[pair] + size - 1]]
            if not len(pair):
                return
            where, before = where[pair], ids[pair]
            del pair, good, ids
            last = self.ids[where + size - 1]
            at, ids, n = _numbered(before * np.int64(len(self.n)) + last)
            with np.errstate(over="ignore"):
                hashes = mixed(hashes[before[at]] * _STEP + self.hashes[last[at]])
            del before, last
            keep = kept(hashes, n)
            yield size, where[at][keep], n[keep], hashes[keep]

    def spelt(self, size: int, places: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Languages and phrases, the words joined by a blank, of the ``size`` words from each place on."""
        words = [self.words.take(pa.array(self.word_of[self.ids[places + k]])) for k in range(size)]
        joined = pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.binary())) if size > 1 else words[0]
        return pa.array(self.lang_names, pa.string()).take(pa.array(self.lang_of[self.ids[places]])), joined.cast(pa.string())


def _cut(text: str | None, most: int) -> Iterator[str]:
    """A very long text in parts, cut where a piece ends, so that no phrase is cut."""
    if text is None or len(text) <= most:
        yield text or ""
        return
    data, at = text.encode(), 0
    while len(data) - at > most and (end := _ENDS.search(data, at + most)):
        yield data[at : end.start()].decode()
        at = end.end()
    yield data[at:].decode()


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Shard]:
    langs: list[str] = []
    texts: list[str] = []
    held = 0

    def shard() -> Shard:
        nonlocal langs, texts, held
        own, whole = langs, pa.array(texts, pa.large_string())
        langs, texts, held = [], [], 0
        return Shard(own, whole)

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for part in _cut(text.as_py(), most):
                langs.append("und" if lang is None else lang)
                texts.append(part)
                held += len(part)
                if held >= most:
                    yield shard()
    if texts:
        yield shard()


def _sender(owners: int, longest: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each shard's words and pairs: sorted hashes and counts, packed for the owner of each hash range."""
    cuts = np.array([(k << 64) // owners for k in range(1, owners)], dtype=np.uint64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, most):
            found = [(hashes, n) for _, _, n, hashes in shard.levels(min(2, longest), lambda _, n: np.ones(len(n), dtype=bool))]
            hashes, n = (np.concatenate(x) for x in zip(*found, strict=True))
            by = np.argsort(hashes)
            hashes, n = hashes[by], n[by]
            at = np.searchsorted(hashes, cuts)
            own = [(k, packed_keys(h), packed(c, 4)) for k, (h, c) in enumerate(zip(np.split(hashes, at), np.split(n, at), strict=True)) if len(h)]
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*own, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["owner", "keys", "counts"])

    return send


def _summed(support: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """An owner: the hashes that reach the support. Two phrases of one hash are summed together, which may let more pass, never less."""

    def add(own: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([unpacked_keys(x) for x in own["keys"]])
        n = np.concatenate([unpacked(x, 4) for x in own["counts"]]).astype(np.int64)
        by = np.argsort(keys)
        keys, n = keys[by], n[by]
        heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return pd.DataFrame({"hash": keys[heads][np.add.reduceat(n, heads) >= support].view(np.int64)})

    return add


Kept = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _passes(bits: np.ndarray) -> Kept:
    mask = np.uint64(len(bits) * 8 - 1)

    def passes(hashes: np.ndarray, _: np.ndarray) -> np.ndarray:
        at = hashes & mask
        return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

    return passes


def _mined(bits: np.ndarray, total: int, support: int, longest: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The hashes of the phrases of three words and more that are locally frequent: count * total >= support * bytes of the shard."""
    passes = _passes(bits)

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, most):
            least = -(-support * shard.bytes // max(1, total))
            level = iter(range(1, longest + 1))

            def kept(hashes: np.ndarray, n: np.ndarray, level: Iterator[int] = level, least: int = least) -> np.ndarray:
                return passes(hashes, n) if next(level) <= 2 else n >= least

            for size, _, _, hashes in shard.levels(longest, kept):
                if size > 2:
                    yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], ["hash"])

    return mine


def _counted(bits: np.ndarray, longest: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The counts in each shard of the phrases that pass the filter; of length 0, all words of a language."""
    passes = _passes(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "size", "phrase", "n"]
        for shard in _shards(batches, most):
            langs = shard.lang_names
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([0] * len(langs), pa.int32()), pa.array([""] * len(langs), pa.string()), pa.array(shard.n_words, pa.int64())], names)
            for size, places, n, _ in shard.levels(longest, passes):
                for a in range(0, len(places), 50_000):
                    lang, phrase = shard.spelt(size, places[a : a + 50_000])
                    yield pa.RecordBatch.from_arrays([lang, pa.array(np.full(len(phrase), size, np.int32)), phrase, pa.array(n[a : a + 50_000].astype(np.int64))], names)

    return count


def _filter_bits(hashes: DataFrame, max_bits: int) -> np.ndarray:
    """A one-hash filter of 16 to 32 bits a key, at most ``max_bits``, as bytes: it is small whatever the number of keys."""
    keys = hashes.distinct()
    bits, wanted = _BITMAP, 16 * keys.count()
    while bits < min(max_bits, wanted):
        bits *= 2
    at = keys.select(F.col("hash").bitwiseAND(F.lit(bits - 1)).alias("at"))
    parts = at.groupBy(F.expr(f"at div {_BITMAP}").cast("int").alias("part")).agg(F.expr(f"bitmap_construct_agg(at % {_BITMAP})").alias("bitmap"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in parts.toLocalIterator():  # of max_bits together at most
        own = np.frombuffer(bytes(row["bitmap"]), np.uint8)
        out[row["part"] * (_BITMAP // 8) :][: len(own)] = own
    return out


def frequent_phrases(docs: DataFrame, support: int = 100, longest: int = 5, shard_chars: int = 1 << 25, max_bits: int = 1 << 28) -> DataFrame:
    """All phrases of up to ``longest`` words that occur ``support`` times or more in a language: lang, size, phrase, n.

    Rows of size 0 have the count of all words of a language. Texts are lower-cased (A-Z), split into pieces at . , ; : ! ? and line
    ends (0x0A to 0x0D), and pieces into words at blanks and tabs; overlapping occurrences count each. A null language is `und`, a null text
    is empty, repeated rows count each, an empty table gives no rows; other columns are not read.
    shard_chars bounds a task's memory, max_bits (32 MB) the broadcast filter; results depend on neither.
    """
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sent = rows.mapInArrow(_sender(max(1, math.ceil(total / shard_chars)), longest, shard_chars), "owner int, keys binary, counts binary")
    short = stored(sent.groupBy("owner").applyInPandas(_summed(support), "hash long"), "frequent-pairs")
    local = stored(rows.mapInArrow(_mined(_filter_bits(short, max_bits), total, support, longest, shard_chars), "hash long"), "locally-frequent")
    bits = _filter_bits(short.unionByName(local), max_bits)
    counts = rows.mapInArrow(_counted(bits, longest, shard_chars), "lang string, size int, phrase string, n long")
    return counts.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).where((F.col("size") == 0) | (F.col("n") >= support))


def collocations(docs: DataFrame, support: int = 100, longest: int = 5, top: int = 2000, shard_chars: int = 1 << 25, salts: int = 64) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score.

    Candidates are the frequent phrases of two words and more; a is a phrase's count, n that of all words of its language, and l and r those of its parts at
    the cut with the lowest score floor(1000 a n / (l r)), of equal ones the earliest. Candidates inside a longer candidate of the same count go.
    As a part occurs at least as often as the whole, it is enough to look at candidates one word longer.
    Ranks go by score, then a, both descending, then phrase ascending by its UTF-8 bytes. Decimals of 38 digits keep products exact. Nulls as in ``frequent_phrases``.
    """
    counts = stored(frequent_phrases(docs, support, longest, shard_chars), "frequent")
    words = counts.where("size = 0").select("lang", F.col("n").alias("total"))
    known = counts.where("size > 0").select("lang", "phrase", "n")
    candidates = counts.where("size > 1").select("lang", "phrase", F.col("n").alias("a"), "size", F.split("phrase", " ").alias("words"))
    part = lambda start, size: F.concat_ws(" ", F.slice("words", start, size))
    inside = (
        candidates.where("size > 2")
        .select("lang", "a", F.explode(F.array(part(F.lit(1), F.col("size") - 1), part(F.lit(2), F.col("size") - 1))).alias("phrase"))
        .distinct()
    )
    left = candidates.join(inside, ["lang", "phrase", "a"], "left_anti")
    cuts = left.select("lang", "phrase", "a", "size", "words", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    cuts = cuts.join(words, "lang")
    exact = lambda name: f"CAST({name} AS DECIMAL(18, 0))"
    score = F.expr(f"(CAST(1000 AS DECIMAL(4, 0)) * {exact('a')} * {exact('total')}) div ({exact('l')} * {exact('r')})")
    worst = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase").agg(worst, F.first("a").alias("a"), F.first("total").alias("n")).select("lang", "phrase", "a", "n", "cut.score", "cut.l", "cut.r")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # a language may have most of the candidates: the best of each salt first
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "salt")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, piece_no, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM (
    SELECT doc_id, lang, generate_subscripts(parts, 1) AS piece_no, unnest(parts) AS piece FROM (
      SELECT doc_id, lang, regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS parts
      FROM documents))),
places AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM pieces WHERE len(words) > 0),
phrases AS (
  SELECT lang, k AS size, array_to_string(words[i : i + k - 1], ' ') AS phrase, count(*) AS n
  FROM places, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(words) GROUP BY ALL HAVING count(*) >= 100),
totals AS (SELECT lang, count(*) AS n FROM places GROUP BY lang),
cand AS (SELECT lang, phrase, n AS a, size, string_split(phrase, ' ') AS words FROM phrases WHERE size > 1),
inside AS (
  SELECT lang, a, array_to_string(words[s : s + k - 1], ' ') AS phrase
  FROM cand, (SELECT unnest(range(1, 5)) AS s), (SELECT unnest(range(2, 5)) AS k) WHERE k < size AND s + k - 1 <= size),
kept AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.a >= 100 * c.a)),
cuts AS (SELECT lang, phrase, a, k, array_to_string(words[1:k], ' ') AS head, array_to_string(words[k + 1 :], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM kept)),
scored AS (
  SELECT c.lang, c.phrase, a, x.n AS l, y.n AS r, t.n, k,
    ((1000::HUGEINT * a * t.n) // (x.n::HUGEINT * y.n))::BIGINT AS score
  FROM cuts c JOIN phrases x ON x.lang = c.lang AND x.phrase = c.head JOIN phrases y ON y.lang = c.lang AND y.phrase = c.rest JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000
"""
