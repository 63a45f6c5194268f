"""Token counts against a plain dynamic program, for words of every length."""

import random
import time

from stillkeep.llm import token_counts

PIECES = {b"a": -1.0, b"b": -1.2, b"ab": -1.5, b"abc": -9.0, b"c": -2.0, b" ": -1.0, b"ba": -1.1, b"aaaa": -3.0}


def _brute(w, pieces):
    worst = min(pieces.values()) * 4 - 40
    best = [(0.0, 0)]
    for e in range(1, len(w) + 1):
        options = [(best[e - n][0] + pieces[w[e - n : e]], n) for n in range(1, e + 1) if w[e - n : e] in pieces]
        score, n = max(options + ([] if w[e - 1 : e] in pieces else [(best[e - 1][0] + worst, 1)]))
        best.append((score, best[e - n][1] + 1))
    return best[-1][1]


def test_long_and_short_words_together():
    table, rng = token_counts.PieceTable(PIECES), random.Random(1)
    words = list({bytes(rng.choices(b"abc d\xc3", k=rng.randint(1, 40))) for _ in range(200)} | {b"a" * n for n in range(1, 30)} | {b"ab" * 90, b"d" * 50})
    want = [_brute(w, PIECES) for w in words]
    for few in (0, 3, 24, 10_000):
        assert token_counts.trie_counts(words, table, few).tolist() == want


def test_rest_in_stretches():
    table, rng = token_counts.PieceTable(PIECES), random.Random(2)
    for n in (1, 5, 40, 333):
        w = bytes(rng.choices(b"abcd ", k=n))
        assert token_counts._rest_of(w, 0, [(0.0, 0)], table, at_once=7) == _brute(w, PIECES)


def test_a_megabyte_without_a_space():
    table = token_counts.PieceTable(token_counts.unigram_scores(token_counts.vocabulary_path()))
    began = time.process_time()
    n = token_counts.trie_counts([b"=" * 1_000_000, b"=" * 500_000], table).tolist()
    assert n[0] == 2 * n[1] or abs(n[0] - 2 * n[1]) <= 2
    assert time.process_time() - began < 120


def test_nulls_empty_repeats_and_clashing_columns(spark):
    rows = [(1, "a b", 9), (1, "a b", 9), (2, None, 9), (3, "", 9), (None, "a  b\n", 9)]
    out = token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")).collect()
    assert len(out) == 5 and [r["n_tokens"] for r in out if r["doc_id"] in (2, 3)] == [0, 0]
    assert len({tuple(r) for r in out if r["doc_id"] == 1}) == 1
    assert token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n int").where("false")).count() == 0
