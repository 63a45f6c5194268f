"""Language-model scores by a weighted backoff automaton.

The corpus is coded in batches of texts. A batch sends its distinct n-grams, as sorted compressed hashes with their counts in training
texts, to the owners of the hash ranges; an owner adds up and answers with the total of each n-gram that was sent. So a
batch holds its part of the model and no more: all n-grams that its own texts can ask for. From the totals it builds the automaton, whose
states are the n-grams seen in training, whose arcs carry smoothed probabilities, and whose failure arcs lead to the n-gram
without its first word. One traversal from left to right scores all texts of a batch side by side.

Smoothing is by a Dirichlet prior: P(w | h) = (c(hw) + k P(w | shorter h)) / (c(h) + k), so an n-gram that was not seen costs a
failure arc of weight k / (c(h) + k). Single words have (c + 1) / (N + V + 1). As each text is closed by an end token, which is
never a context, c(h) is the count of h itself.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillkeep.llm.common import lowered, mixed, stored, table, text_slices, word_ids
from stillkeep.llm.spelling import CRC_TABLE, crc32_sql

END = np.uint64(xxhash.xxh64_intdigest(b"end of text", 1))  # words are hashed with seed 0
_STEP = np.uint64(0x9E3779B97F4A7C15)
GRAM_BITS = 56  # n-grams of two words and more are told apart by so many bits, words by 64


def packed(values: np.ndarray, width: int) -> bytes:
    """Unsigned integers as compressed byte planes, the lowest bytes of all first."""
    planes = values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpacked(blob: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct hashes by their gaps."""
    return packed(np.diff(keys, prepend=np.uint64(0)), 8)


def unpacked_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(unpacked(blob, 8), dtype=np.uint64)


# ---------------------------------------------------------------- texts as numbers

_CODED = pa.schema([("batch", pa.int64()), ("ids", pa.list_(pa.string())), ("sizes", pa.list_(pa.int64())), ("words", pa.binary()), ("codes", pa.binary()), ("n", pa.int64())])


def _coder(batch_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of texts: the words' hashes, and each text's words by number, closed by the end token."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32

        def flush(ids: list, texts: list[str]) -> pa.RecordBatch:
            nonlocal number
            number += 1
            ((_, _, data, starts),) = text_slices(pa.array(texts, pa.large_string()), 1 << 62)
            low = lowered(data)
            word, text, _, _, words = word_ids(low, ~((low == 32) | ((low >= 9) & (low <= 13))), starts)
            hashes = np.array([*map(xxhash.xxh64_intdigest, words.to_pylist()), int(END)], dtype=np.uint64)
            n = np.bincount(text, minlength=len(texts))
            codes = np.insert(word, np.cumsum(n), len(words))
            by = np.argsort(-np.bincount(codes, minlength=len(hashes)), kind="stable")  # frequent words have small numbers
            rank = np.empty(len(by), dtype=np.uint32)
            rank[by] = np.arange(len(by))
            hashes, codes = hashes[by], rank[codes]
            row = ([number], [ids], [(n + 1).tolist()], [hashes.tobytes()], [packed(codes, 4)], [len(codes)])
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, _CODED.types, strict=True)], schema=_CODED)

        ids, texts, chars = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(None if doc_id is None else str(doc_id))
                texts.append(text or "")
                chars += len(texts[-1])
                if chars >= batch_chars:
                    yield flush(ids, texts)
                    ids, texts, chars = [], [], 0
        if ids:
            yield flush(ids, texts)

    return code


def _held_out(doc_id: str | None) -> bool:
    return doc_id is not None and zlib.crc32(doc_id.encode()) % 7 == 2


class Grams:
    """The distinct n-grams of a batch, by length: sorted hashes, and for each place the number of the n-gram that ends there."""

    def __init__(self, row: dict, order: int):
        self.ids: list[str | None] = list(row["ids"])
        self.sizes = np.asarray(row["sizes"], dtype=np.int64)
        self.held = np.array([_held_out(x) for x in self.ids], dtype=bool)
        self.starts = np.cumsum(self.sizes) - self.sizes
        codes = unpacked(row["codes"], 4)
        own = np.frombuffer(row["words"], dtype=np.uint64)[codes]
        into = np.arange(len(codes)) - np.repeat(self.starts, self.sizes)  # words before in the same text
        self.keys: list[np.ndarray] = []
        self.at: list[np.ndarray] = []  # -1 where a text has fewer words so far
        self.first: list[np.ndarray] = []  # a place of each n-gram
        hashes = own
        for size in range(1, order + 1):
            if size > 1:
                before = np.concatenate((np.zeros(1, np.uint64), hashes[:-1]))
                with np.errstate(over="ignore"):
                    hashes = mixed(before * _STEP + own, size) >> np.uint64(64 - GRAM_BITS)
            there = np.flatnonzero(into >= size - 1)
            keys, first, inverse = np.unique(hashes[there], return_index=True, return_inverse=True)
            at = np.full(len(codes), -1, dtype=np.int64)
            at[there] = inverse
            self.keys.append(keys)
            self.at.append(at)
            self.first.append(there[first])

    def training_counts(self) -> list[np.ndarray]:
        learnt = np.repeat(~self.held, self.sizes)
        return [np.bincount(at[learnt & (at >= 0)], minlength=len(keys)) for at, keys in zip(self.at, self.keys, strict=True)]


_SENT = pa.schema([("batch", pa.int64()), ("owner", pa.int32()), ("keys", pa.list_(pa.binary())), ("counts", pa.list_(pa.binary()))])


def _sender(owners: int, order: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    cuts = [np.array([(k << bits) // owners for k in range(1, owners)], dtype=np.uint64) for bits in (64, *[GRAM_BITS] * (order - 1))]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            grams = Grams(row, order)
            split = []
            for keys, counts, cut in zip(grams.keys, grams.training_counts(), cuts, strict=True):
                at = np.searchsorted(keys, cut)
                split.append((np.split(keys, at), np.split(counts, at)))
            for owner in range(owners):
                own = [(k[owner], c[owner]) for k, c in split]
                if any(len(k) for k, _ in own):
                    columns = [[row["batch"]], [owner], [[packed_keys(k) for k, _ in own]], [[packed(c, 4) for _, c in own]]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _SENT.types, strict=True)], schema=_SENT)

    return send


_ANSWER = "batch long, owner int, totals array<binary>, tokens long, types long"


def _answer(own: pd.DataFrame) -> pd.DataFrame:
    """An owner: the totals of the n-grams that each batch sent, in the order sent; with the first, how many words and distinct words it knows."""
    totals: list[list[bytes]] = [[] for _ in range(len(own))]
    tokens = types = 0
    for size in range(len(own["keys"].iloc[0])):
        keys = [unpacked_keys(x[size]) for x in own["keys"]]
        counts = np.concatenate([unpacked(x[size], 4) for x in own["counts"]])
        known, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, weights=counts, minlength=len(known)).astype(np.int64)
        if not size:
            tokens, types = int(total.sum()), int((total > 0).sum())
        for out, part in zip(totals, np.split(total[inverse], np.cumsum([len(k) for k in keys])[:-1]), strict=True):
            out.append(packed(part, 8))
    first = np.arange(len(own)) == 0
    return pd.DataFrame({"batch": own["batch"], "owner": own["owner"], "totals": totals, "tokens": np.where(first, tokens, 0), "types": np.where(first, types, 0)})


# ---------------------------------------------------------------- the automaton


class Automaton:
    """States, arcs and failure arcs of the n-grams of a batch that occur in training. State 0 knows no word.

    grams: the batch's n-grams; totals: their training counts by length; tokens, types: N and V; priors: k for each length from 2 on.
    """

    def __init__(self, grams: Grams, totals: list[np.ndarray], tokens: int, types: int, priors: tuple[float, ...]):
        order = len(totals)
        self.order, self.words = order, max(1, len(totals[0]))
        sizes = [len(t) for t in totals[:-1]] if order > 1 else []
        base = [1, *(1 + np.cumsum(sizes)).tolist()]  # number of the first state of each length
        states = base[-1]
        self.known = totals[0] > 0
        p = (totals[0] + 1) / (tokens + types + 1)
        self.base_log = np.log10(p)
        self.word_next = np.where(self.known, base[0] + np.arange(len(totals[0])), 0) if order > 1 else np.zeros(len(totals[0]), np.int64)
        self.fail = np.zeros(states, dtype=np.int64)
        self.fail_log = np.zeros(states)
        keys, logs, nexts = [], [], []
        for size in range(1, order):  # n-grams of size + 1 words
            here, prior = grams.first[size], priors[size - 1]
            context, rest, last = grams.at[size - 1][here - 1], grams.at[size - 1][here], grams.at[0][here]
            seen = totals[size] > 0
            p = (totals[size] + prior * p[rest]) / (totals[size - 1][context] + prior)
            state = np.arange(len(totals[size - 1])) + base[size - 1]
            self.fail_log[state] = np.log10(prior / (totals[size - 1] + prior))
            keys.append((base[size - 1] + context[seen]) * self.words + last[seen])
            logs.append(np.log10(p[seen]))
            nexts.append(base[size] + np.flatnonzero(seen) if size < order - 1 else base[size - 1] + rest[seen])
            if size < order - 1:
                self.fail[base[size] + np.arange(len(totals[size]))] = base[size - 1] + rest
        keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        by = np.argsort(keys)
        self.arc = np.append(keys[by], np.iinfo(np.int64).max)
        self.arc_log = np.append(np.concatenate(logs)[by] if logs else [], 0.0)
        self.arc_next = np.append(np.concatenate(nexts)[by] if nexts else [], 0).astype(np.int64)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each lane reads a word: the next states, and the log10 probabilities with all failure arcs that were taken."""
        log = np.zeros(len(word))
        after = np.zeros(len(word), dtype=np.int64)
        lanes = np.arange(len(word))
        for _ in range(self.order):
            at_root = state[lanes] == 0
            ends = lanes[at_root]
            log[ends] += self.base_log[word[ends]]
            after[ends] = self.word_next[word[ends]]
            lanes = lanes[~at_root]
            if not len(lanes):
                break
            key = state[lanes] * self.words + word[lanes]
            arc = np.searchsorted(self.arc, key)
            found = self.arc[arc] == key
            hit = lanes[found]
            log[hit] += self.arc_log[arc[found]]
            after[hit] = self.arc_next[arc[found]]
            lanes = lanes[~found]
            log[lanes] += self.fail_log[state[lanes]]
            state[lanes] = self.fail[state[lanes]]
        return after, log

    def traverse(self, words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, stretch: int = 512) -> np.ndarray:
        """The log10 probability of each token of texts that lie one after the other.

        A long text is read in stretches at once: one that begins order - 1 tokens early is in the state of the whole traversal by then,
        as no state knows more words.
        """
        cut = -(-sizes // stretch)
        text = np.repeat(np.arange(len(sizes)), cut)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(cut) - cut, cut)
        begin = starts[text] + nth * stretch
        end = np.minimum(begin + stretch, starts[text] + sizes[text])
        early = np.maximum(starts[text], begin - (self.order - 1))
        by = np.argsort(early - end, kind="stable")  # the longest first
        begin, end, early = begin[by], end[by], early[by]
        length = end - early
        out = np.zeros(len(words))
        state = np.zeros(len(by), dtype=np.int64)
        for t in range(int(length[0]) if len(by) else 0):
            live = int(np.searchsorted(-length, -t))  # lanes with more than t tokens
            place = early[:live] + t
            state = state[:live]
            state, log = self.step(state, words[place])
            counts = place >= begin[:live]
            out[place[counts]] = log[counts]
        return out


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scorer(order: int, priors: tuple[float, ...], tokens: int, types: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def score(coded: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        grams = Grams(coded.iloc[0].to_dict(), order)
        parts = answers.sort_values("owner")["totals"]
        totals = [np.concatenate([unpacked(x[size], 8) for x in parts]).astype(np.int64) for size in range(order)]
        automaton = Automaton(grams, totals, tokens, types, priors)
        words = grams.at[0]
        sums = lambda values: np.add.reduceat(values, grams.starts)  # noqa: E731  a text has one token at least
        return pd.DataFrame(
            {
                "doc_id": pd.array([None if x is None else int(x) for x in grams.ids], dtype="Int64"),
                "held_out": grams.held,
                "n_tokens": grams.sizes,
                "n_known": sums(automaton.known[words].astype(np.int64)),
                "train_tokens": tokens,
                "base_score": sums(automaton.base_log[words]),
                "score": sums(automaton.traverse(words, grams.starts, grams.sizes)),
            }
        )

    return score


def lm_scores(docs: DataFrame, order: int = 3, priors: tuple[float, ...] = (1000.0, 2.0), batch_chars: int = 6_000_000, per_owner: int = 3_000_000) -> DataFrame:
    """Scores of all texts by a model of up to ``order`` words, learnt from those that are not held out.

    Per row: doc_id, held_out (crc32 of the id as text is 2 modulo 7), n_tokens (words and one end), n_known (tokens seen in training), train_tokens,
    base_score (log10 by single words, add one), score (log10 by the model). Words are split at blanks and 0x09-0x0D, A-Z lower-cased.
    A null or empty text is an end token alone; a row without an id is not held out; repeated rows are learnt from and scored each;
    an empty table gives no rows; other columns are not read. Without training texts every token has probability 1.
    priors: k for n-grams of 2, 3, ... words (on held-out texts, large ones do best for pairs and small ones for longer n-grams). batch_chars and per_owner bound a task's memory, results do not depend on them
    (but for the order in which scores are added up).
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    coded = stored(rows.mapInArrow(_coder(batch_chars), "batch long, ids array<string>, sizes array<long>, words binary, codes binary, n long"), "coded")
    owners = max(1, math.ceil((coded.agg(F.sum("n")).first()[0] or 0) * order / per_owner))
    sent = coded.mapInArrow(_sender(owners, order), "batch long, owner int, keys array<binary>, counts array<binary>")
    answers = stored(sent.groupBy("owner").applyInPandas(_answer, _ANSWER), "answers")
    known = answers.agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).first()
    score = _scorer(order, tuple(priors), known["tokens"] or 0, known["types"] or 0)
    return coded.drop("n").groupBy("batch").cogroup(answers.select("batch", "owner", "totals").groupBy("batch")).applyInPandas(score, _SCORES)


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH {CRC_TABLE},
docs AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce({crc32_sql("doc_id::VARCHAR")} % 7 = 2, FALSE) AS held_out,
    list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS words
  FROM documents, crc),
places AS (SELECT row_no, doc_id, held_out, unnest(words) AS w1, generate_subscripts(words, 1) AS i FROM docs),
asked AS (SELECT *, h1 || ' ' || w1 AS w2, h0 || ' ' || h1 || ' ' || w1 AS w3, h0 || ' ' || h1 AS h2
  FROM (SELECT *, lag(w1) OVER w AS h1, lag(w1, 2) OVER w AS h0 FROM places WINDOW w AS (PARTITION BY row_no ORDER BY i))),
c1 AS (SELECT w1, count(*) AS n FROM asked WHERE NOT held_out GROUP BY w1),
c2 AS (SELECT w2, count(*) AS n FROM asked WHERE NOT held_out AND w2 IS NOT NULL GROUP BY w2),
c3 AS (SELECT w3, count(*) AS n FROM asked WHERE NOT held_out AND w3 IS NOT NULL GROUP BY w3),
totals AS (SELECT coalesce(sum(n), 0)::BIGINT AS tokens, count(*) AS types FROM c1),
single AS (
  SELECT a.*, tokens, a1.n IS NOT NULL AS known, (coalesce(a1.n, 0) + 1)::DOUBLE / (tokens + types + 1) AS p1, coalesce(a2.n, 0) AS n2, coalesce(a3.n, 0) AS n3,
    coalesce(b1.n, 0) AS m1, coalesce(b2.n, 0) AS m2
  FROM asked a LEFT JOIN c1 a1 USING (w1) LEFT JOIN c2 a2 USING (w2) LEFT JOIN c3 a3 USING (w3)
  LEFT JOIN c1 b1 ON a.h1 = b1.w1 LEFT JOIN c2 b2 ON a.h2 = b2.w2, totals),
pairs AS (SELECT *, CASE WHEN i > 1 THEN (n2 + 1000 * p1) / (m1 + 1000) ELSE p1 END AS p2 FROM single),
triples AS (SELECT *, CASE WHEN i > 2 THEN (n3 + 2 * p2) / (m2 + 2) ELSE p2 END AS p3 FROM pairs)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(*) FILTER (WHERE known) AS n_known, any_value(tokens) AS train_tokens,
  sum(log10(p1)) AS base_score, sum(log10(p3)) AS score
FROM triples GROUP BY row_no, doc_id
"""
