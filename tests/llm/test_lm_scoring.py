"""The automaton against the recursive formula over plain counts, and its probabilities as a distribution."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from stillkeep.llm import lm_scoring


def tokens_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0d]+", low), None]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


class Plain:
    def __init__(self, docs, order, priors):
        self.order, self.priors, self.c = order, priors, Counter()
        for doc_id, text in docs:
            if not held(doc_id):
                t = tokens_of(text)
                self.c.update(tuple(t[i : i + k]) for k in range(1, order + 1) for i in range(len(t) - k + 1))
        own = {g: n for g, n in self.c.items() if len(g) == 1}
        self.n, self.v = sum(own.values()), len(own)

    def p(self, history, word):
        if not history:
            return (self.c[word,] + 1) / (self.n + self.v + 1)
        k = self.priors[len(history) - 1]
        return (self.c[*history, word] + k * self.p(history[1:], word)) / (self.c[history] + k)

    def score(self, text):
        t = tokens_of(text)
        return sum(math.log10(self.p(tuple(t[max(0, i - self.order + 1) : i]), w)) for i, w in enumerate(t))


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(1)
    words = ["a", "A", "b", "É", "é", "ab", "a.b", "zß", "\x1f", "the", "of"]
    out = [(k, "".join(rng.choice(words) + rng.choice([" ", "\n", "\t ", " "]) for _ in range(rng.randint(0, 30)))) for k in range(120)]
    out += [(9, None), (16, ""), (None, "a b a b ab the"), (2**62 + 1, "a b a b ab new"), (5, out[5][1]), (5, out[5][1])]
    return out


@pytest.mark.parametrize("order,priors,chars,owner", [(3, (4.0, 1.0), 1 << 23, 1 << 22), (3, (0.5, 2.0), 200, 150), (1, (), 500, 1000), (4, (4.0, 1.0, 0.3), 900, 300)])
def test_scores(spark, docs, order, priors, chars, owner):
    table = spark.createDataFrame([(i, t, 1, "w") for i, t in docs], "doc_id long, text string, n int, words string")
    got = lm_scoring.lm_scores(table, order, priors, batch_chars=chars, per_owner=owner).collect()
    model = Plain(docs, order, priors)
    want = []
    for doc_id, text in docs:
        t = tokens_of(text)
        base = sum(math.log10((model.c[w,] + 1) / (model.n + model.v + 1)) for w in t)
        want.append((doc_id, held(doc_id), len(t), sum(model.c[w,] > 0 for w in t), model.n, base, model.score(text)))
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[6], 6))
    assert any(r[1] for r in want) and len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-9) and a[6] == pytest.approx(b[6], abs=1e-9)


def test_each_state_is_a_distribution(docs):
    """Over all known words and one unknown one, the probabilities after any history sum to 1."""
    model = Plain(docs, 3, (4.0, 1.0))
    words = [g[0] for g in model.c if len(g) == 1] + ["never seen"]
    for history in [(), ("a",), ("a", "b"), ("never seen",), ("the", "of")]:
        assert sum(model.p(history, w) for w in words) == pytest.approx(1)


def test_a_long_text_is_read_in_stretches(docs):
    rng = np.random.default_rng(2)
    words = rng.integers(0, 12, 5000).astype(np.uint32)
    row = {"ids": ["1", "3"], "sizes": [4000, 1000], "words": lm_scoring.mixed(np.arange(12, dtype=np.uint64)).tobytes(), "codes": lm_scoring.packed(words, 4)}
    grams = lm_scoring.Grams(row, 3)
    totals = grams.training_counts()
    automaton = lm_scoring.Automaton(grams, totals, int(totals[0].sum()), len(totals[0]), (4.0, 1.0))
    whole = automaton.traverse(grams.at[0], grams.starts, grams.sizes, stretch=1 << 30)
    for stretch in (2, 7, 512):
        assert np.array_equal(automaton.traverse(grams.at[0], grams.starts, grams.sizes, stretch=stretch), whole)


def test_empty_table(spark):
    assert not lm_scoring.lm_scores(spark.createDataFrame([], "doc_id long, text string")).collect()


def test_packing_round_trip():
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 64, 999, dtype=np.uint64))
    for own in (keys, keys[:1], keys[:0]):
        assert np.array_equal(lm_scoring.unpacked_keys(lm_scoring.packed_keys(own)), own)
