"""Token counts under a unigram model by dynamic programming over a trie.

The distinct pre-tokens of a batch of texts are put in a trie of bytes. A trie node's forward score, that of the
best segmentation of the bytes that lead to it, follows from its ancestors alone, so it is computed once for all
pre-tokens that share the prefix; all nodes of one depth are computed together, and few long words one after the other.
At a terminal, the number of tokens of the best segmentation is stored, and a text's count is the sum over its pre-tokens.
"""

from __future__ import annotations

import base64
import functools
import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillkeep.llm.common import mixed, table

PRE_TOKEN = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def unigram_scores(path: str, offset: int = 2000) -> dict[bytes, float]:
    """Log-probabilities of a public vocabulary's pieces by rank: Zipf-Mandelbrot, 1 / (rank + offset), normalised."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    total = math.log(sum(1 / (r + offset) for r in ranks.values()))
    return {piece: -math.log(r + offset) - total for piece, r in ranks.items()}


_BASE = np.uint64(0x100000001B3)


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    out = []
    for base in (_BASE, inverse):
        own = np.full(n, base, dtype=np.uint64)
        own[:1] = 1
        out.append(np.cumprod(own, dtype=np.uint64))
    return out[0], out[1]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    up, down = _powers(1 << max(10, (n - 1).bit_length()))
    return up[:n], down[:n]


class PieceTable:
    """Scores by a 64-bit hash of the bytes, read for many substrings at once."""

    def __init__(self, scores: dict[bytes, float]):
        self.longest = max(map(len, scores))
        self.worst = min(scores.values()) * 4 - 40
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(self.longest, _BASE)]), dtype=np.uint64)
        keys = np.zeros(len(scores), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k, piece in enumerate(scores):
                h = np.uint64(0)
                for b in piece:
                    h = h * _BASE + np.uint64(b + 1)
                keys[k] = h
        keys = mixed(keys)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.array(list(scores.values()))[order]
        if len(np.unique(self.keys)) != len(scores):
            raise ValueError("two pieces have one hash")
        self.some = np.zeros(1 << 22, dtype=bool)
        self.some[self.keys >> np.uint64(42)] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -np.inf)
        h = mixed(hashes)
        near = np.flatnonzero(self.some[h >> np.uint64(42)])
        at = np.minimum(np.searchsorted(self.keys, h[near]), len(self.keys) - 1)
        found = self.keys[at] == h[near]
        out[near[found]] = self.values[at[found]]
        return out


FEW = 24  # words that are still longer are walked one by one, those that are more together


def trie_counts(words: list[bytes], pieces: PieceTable, few: int = FEW) -> np.ndarray:
    """Tokens of the best segmentation of each distinct word; of equal scores the one with the longer last piece wins.

    A byte that is no piece counts as one token at a score below all others. Where only ``few`` words go deeper, the rest of
    each is walked by itself, from the scores that the trie has for it: time and memory grow with the bytes of the words.
    """
    out = np.zeros(len(words), dtype=np.int64)
    if not words:
        return out
    words = sorted((w, k) for k, w in enumerate(words))
    place = np.array([k for _, k in words])
    size = np.array([len(w) for w, _ in words])
    flat = np.frombuffer(b"".join(w for w, _ in words), np.uint8).astype(np.uint64)
    first = np.cumsum(size) - size
    # per depth: node of each word still long enough; sorted words with one prefix lie together
    live = np.arange(len(words))
    node_of = np.zeros(len(words), dtype=np.int64)  # node at the previous depth
    hashes = [np.zeros(1, np.uint64)]
    score, tokens = [np.zeros(1)], [np.zeros(1, np.int64)]
    ups: list[np.ndarray] = [np.zeros(1, np.int64)]  # parent node, one depth up
    depth = 0
    with np.errstate(over="ignore"):
        while True:
            done = live[size[live] == depth]
            out[place[done]] = tokens[depth][node_of[done]]
            live = live[size[live] > depth]
            if len(live) <= few:
                for k in live:
                    above = [(score[depth][node_of[k]], tokens[depth][node_of[k]])]
                    node = ups[depth][node_of[k]]
                    for d in range(depth - 1, max(-1, depth - pieces.longest), -1):
                        above.append((score[d][node], tokens[d][node]))
                        node = ups[d][node]
                    out[place[k]] = _rest_of(words[k][0], depth, above[::-1], pieces)
                return out
            byte = flat[first[live] + depth]
            parent = node_of[live]
            new = np.ones(len(live), dtype=bool)
            new[1:] = (byte[1:] != byte[:-1]) | (parent[1:] != parent[:-1])
            number = np.cumsum(new) - 1
            node_of[live] = number
            up, last = parent[new], byte[new]
            own = hashes[depth][up] * _BASE + last + np.uint64(1)
            best = np.full(len(own), -np.inf)
            count = np.zeros(len(own), dtype=np.int64)
            ancestor = up
            for length in range(1, min(depth + 1, pieces.longest) + 1):
                start = depth + 1 - length
                value = pieces(own - hashes[start][ancestor] * pieces.powers[length]) + score[start][ancestor]
                if length == 1:
                    value = np.where(np.isfinite(value), value, score[start][ancestor] + pieces.worst)
                better = value >= best
                best = np.where(better, value, best)
                count = np.where(better, tokens[start][ancestor] + 1, count)
                if start:
                    ancestor = ups[start][ancestor]
            depth += 1
            hashes.append(own)
            score.append(best)
            tokens.append(count)
            ups.append(up)
            if depth > pieces.longest:  # older depths are out of reach
                gone = depth - pieces.longest - 1
                hashes[gone] = score[gone] = tokens[gone] = ups[gone] = None


def _rest_of(word: bytes, depth: int, above: list[tuple[float, int]], pieces: PieceTable, at_once: int = 1 << 14) -> int:
    """The tokens of a word whose best segmentations up to ``depth`` are given; ``above`` are (score, tokens), the last for ``depth``."""
    longest = pieces.longest
    score, tokens = [float(x) for x, _ in above], [int(n) for _, n in above]
    low = depth - len(above) + 1  # the place of score[0]
    with np.errstate(over="ignore"):
        for a in range(depth, len(word), at_once):
            left = max(0, a - longest)
            b = min(len(word), a + at_once)
            text = np.frombuffer(word, np.uint8, b - left, left).astype(np.uint64) + np.uint64(1)
            up, down = _tables(len(text))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(text * down)])
            ends, lengths, values = [], [], []
            for length in range(1, longest + 1):
                end = np.arange(max(a + 1, left + length), b + 1)
                if not len(end):
                    continue
                e = end - left
                found = pieces((sums[e] - sums[e - length]) * up[e - 1])
                near = np.flatnonzero(np.isfinite(found))
                ends.append(end[near])
                lengths.append(np.full(len(near), length))
                values.append(found[near])
            end, length, value = (np.concatenate(x) for x in (ends, lengths, values))
            order = np.argsort(end, kind="stable")  # by end, shorter pieces first
            end, length, value = end[order], length[order].tolist(), value[order].tolist()
            cut = np.searchsorted(end, np.arange(a + 1, b + 2))
            for k in range(a + 1, b + 1):
                lo, hi = int(cut[k - a - 1]), int(cut[k - a])
                best, n = -math.inf, 0
                if lo == hi or length[lo] > 1:
                    best, n = score[k - 1 - low] + pieces.worst, tokens[k - 1 - low] + 1
                for x in range(lo, hi):
                    own = value[x] + score[k - length[x] - low]
                    if own >= best:
                        best, n = own, tokens[k - length[x] - low] + 1
                score.append(best)
                tokens.append(n)
            drop = max(0, len(score) - longest)
            score, tokens, low = score[drop:], tokens[drop:], low + drop
    return tokens[-1]


def _counter(path: str, batch_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split, pieces = regex.compile(PRE_TOKEN), PieceTable(unigram_scores(path))

        def flush(ids: list, texts: list[str]) -> pa.RecordBatch:
            owns = [Counter(split.findall(t)) for t in texts]
            words = list(dict.fromkeys(w for own in owns for w in own))
            n = dict(zip(words, trie_counts([w.encode() for w in words], pieces).tolist(), strict=True))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([own.total() for own in owns], pa.int64()),
                    pa.array([sum(n[w] * k for w, k in own.items()) for own in owns], pa.int64()),
                ],
                ["doc_id", "n_pretokens", "n_tokens"],
            )

        ids, texts, chars = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc_id)
                texts.append(text.as_py() or "")
                chars += len(texts[-1])
                if chars >= batch_chars:
                    yield flush(ids, texts)
                    ids, texts, chars = [], [], 0
        if ids:
            yield flush(ids, texts)

    return count


def token_counts(docs: DataFrame, path: str | None = None, batch_chars: int = 6_000_000) -> DataFrame:
    """Per document: doc_id, n_pretokens, n_tokens under the unigram model, over the whole text.

    One pass without a shuffle; a trie holds the distinct pre-tokens of about ``batch_chars`` characters of texts, which
    bounds memory and does not change results. Null and empty texts have 0 tokens, a null doc_id stays null, repeated
    rows give a row each, other columns are not read.
    """
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        _counter(path or vocabulary_path(), batch_chars), "doc_id bigint, n_pretokens bigint, n_tokens bigint"
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
