"""Benchmark passages against brute force over all pairs of document and item."""

import random

import numpy as np
import pytest

from stillkeep.llm import common, decontaminate
from tests.llm.test_operators import WORDS


def _least_distance(text, item):
    """Edit distance of the item to the nearest stretch of the text, one cell after the other."""
    last = [0] * (len(text) + 1)
    for i, symbol in enumerate(item):
        new = [i + 1]
        for k, word in enumerate(text):
            new.append(min(last[k] + (word != symbol), last[k + 1] + 1, new[k] + 1))
        last = new
    return min(last)


def _edited(rng, words, edits):
    """Edits on places of their own, so that the distance is as large as their number."""
    words = list(words)
    for at in sorted(rng.sample(range(len(words)), edits), reverse=True):
        kind = rng.choice("sid")
        if kind == "s":
            words[at] = "other"
        elif kind == "i":
            words.insert(at, "extra")
        else:
            del words[at]
    return words


def _found(texts, items, num=80, most=None):
    index = decontaminate.build_index(list(enumerate(items)), num, 100, 0.98)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    w, doc, _, _ = common.hashed_words(data, np.cumsum([0, *map(len, texts)]))
    count = np.bincount(doc, minlength=len(texts))
    return {(d, i): distance for d, i, distance, _ in decontaminate.contaminated_spans(w, np.cumsum(count) - count, count, index)}


def _planted(rng, lengths, num, copies):
    items = [rng.choices([f"i{k}" for k in range(150)], k=n) for n in lengths]
    texts = []
    for item in items:
        for before in range(copies):
            edits = decontaminate.edits_of(len(item), num, 100)
            inner = _edited(rng, item, edits if before >= 8 else 0)
            texts.append([*rng.choices(WORDS, k=before), *inner, *rng.choices(WORDS, k=6)])
    return items, texts


@pytest.mark.parametrize("lengths", [(1, 2, 3, 4, 5, 6, 7, 8), (9, 10, 12, 15, 18, 20), (25, 30, 40), (60, 80, 100)])
def test_all_pairs(lengths):
    rng = random.Random(sum(lengths))
    items, texts = _planted(rng, lengths, 80, 28)
    want = {}
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            distance = _least_distance(text, item)
            if distance <= len(item) // 5:
                want[d, i] = distance
    got = _found([" ".join(t) for t in texts], [" ".join(x) for x in items])
    assert set(got) <= set(want)
    assert {k for k, v in want.items() if v == 0} <= set(got)
    assert len(got) >= 0.97 * len(want)
    assert all(got[k] >= want[k] for k in got)


def test_shared_sequences_where_walks_do_not_reach_the_recall(monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_WALKS", 0)
    items, texts = _planted(random.Random(2), (3, 5, 10, 21, 40), 60, 20)
    got = _found([" ".join(t) for t in texts], [" ".join(x) for x in items], 60)
    want = {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if _least_distance(t, x) <= decontaminate.edits_of(len(x), 60, 100)}
    assert set(got) == want


def test_long_items_and_texts_in_small_pieces(monkeypatch):
    monkeypatch.setattr(decontaminate, "CELLS", 5000)
    rng = random.Random(9)
    item = rng.choices(WORDS, k=1500)
    texts = [[*rng.choices(WORDS, k=3000), *_edited(rng, item, 100), *rng.choices(WORDS, k=2000)], rng.choices(WORDS, k=6000)]
    assert set(_found([" ".join(t) for t in texts], [" ".join(item)])) == {(0, 0)}


def test_documents_nulls_and_repeats(spark):
    item = "the quick brown fox jumps over the lazy dog again and again"
    docs = spark.createDataFrame([(1, f"x {item.upper()}\n y", 5), (1, f"x {item} y", 5), (2, None, 5), (None, item, 5), (3, "", 5)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(7, item, "z"), (7, item, "z"), (8, None, "z"), (None, "", "z")], "item_id long, text string, doc_id string")
    rows = decontaminate.decontaminate(docs, bench).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"], r["distance"], r["item_words"]) for r in rows) == [(0, 7, 0, 12)] * 2 + [(1, 7, 0, 12)] * 4
    left = common.without(docs, decontaminate.decontaminate(docs, bench)).collect()
    assert sorted(map(tuple, left)) == [(2, None, 5), (3, "", 5)]  # the row without an id goes too: ids are compared null-safe
    assert decontaminate.decontaminate(docs.where("false"), bench).count() == 0
