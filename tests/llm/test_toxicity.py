"""The label model on votes of known accuracy, the classifier on held-out rows."""

import random
import zlib

import numpy as np
import pytest

from stillkeep.llm import toxicity
from tests.llm.test_operators import WORDS


def test_label_model_recovers_rates_from_agreement_alone():
    rng = np.random.default_rng(1)
    n, balance = 60_000, 0.12
    truth = rng.random(n) < balance
    hit, false = np.array([0.6, 0.5, 0.4, 0.7, 0.3, 0.5]), np.array([0.01, 0.02, 0.005, 0.03, 0.01, 0.02])
    votes = (rng.random((n, 6)) < np.where(truth[:, None], hit, false)).astype(float)
    model = toxicity.fit_label_model(n, votes.T @ votes, balance)
    assert np.abs(model.toxic_rate - hit).max() < 0.08 and np.abs(model.other_rate - false).max() < 0.02
    assert ((model.posterior(votes) >= 0.5) == truth).mean() > 0.97


def test_copies_of_a_voter_share_their_weight():
    rng = np.random.default_rng(2)
    n = 40_000
    truth = rng.random(n) < 0.1
    votes = (rng.random((n, 4)) < np.where(truth[:, None], 0.5, 0.02)).astype(float)
    twice = np.hstack([votes, votes[:, :1]])
    alone = toxicity.fit_label_model(n, votes.T @ votes, 0.1)
    both = toxicity.fit_label_model(n, twice.T @ twice, 0.1)
    assert both.correlation[0, 4] > 0.3
    assert both.weight[0] < 0.8 * alone.weight[0]


def test_hits_are_the_features_of_a_text():
    features = ["idiot", "abc*", "abc*2", "abc*3", "!shouting", "zz*"]
    find = toxicity.Hits(features)
    for text in ("", "Idiot abcd", "abcd abce ABCD", "abcd abce abcf!!!", "zzz idiots"):
        own = toxicity._features(text) | {n for n, p in toxicity.PATTERNS.items() if p.search(text)}
        assert [features[k] for k in find(text)] == [f for f in features if f in own]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    bad = ["idiot", "scum", "trash", "loser", "grobnik", "grobnal", "grobner"]
    rows, labels = [], []
    for k in range(900):
        toxic = k % 5 == 0
        words = rng.choices(WORDS, k=40) + (rng.choices(bad, k=3) if toxic else [])
        rng.shuffle(words)
        rows.append((k, " ".join(words), 7))
        if k < 500:
            labels.append((k, 1, int(toxic)))
    rows += [(900, None, 7), (901, "", 7), (None, "idiot scum trash", 7), (5, "a b c", 7), (5, "a b c", 7)]
    labels += [(None, 1, 1), (7, 1, None), (3, 1, 0), (3, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, score int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_rows(spark, tables):
    docs, labels = tables
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == docs.count()
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] < 900 and r["doc_id"] != 5]
    assert len(held) > 100 and sum(r["predicted"] == (r["doc_id"] % 5 == 0) for r in held) >= 0.97 * len(held)
    empty = {r["score"] for r in out if r["doc_id"] in (900, 901)}
    assert len(empty) == 1 and max(empty) < 0.3
    assert len({(r["score"], r["predicted"]) for r in out if r["doc_id"] == 5}) == 2  # repeated rows alike, the toxic text apart


def test_no_document_is_trained_on_its_own_label(spark, tables):
    """Labels of rows without any mark change nothing: they name no voter."""
    docs, labels = tables
    model, hits = toxicity.fit_toxicity(docs, labels)
    assert {"idiot", "scum", "trash", "loser"} <= set(model.voters) and any(v.startswith("gro") for v in model.voters)
    both = {(r["a"] > 0.3) for r in hits.join(docs.where("doc_id < 900"), "doc_id").select(model.of_hits(hits["hits"]).alias("a")).collect()}
    assert both == {True, False}


def test_score_of_text_equals_score_of_hits(spark, tables):
    docs, labels = tables
    model, hits = toxicity.fit_toxicity(docs, labels)
    own = docs.select("doc_id", "text", model.score()(docs["text"]).alias("a")).where("doc_id IS NOT NULL AND doc_id <> 5")
    rows = own.join(hits.select("doc_id", model.of_hits(hits["hits"]).alias("b")), "doc_id").collect()
    assert len(rows) > 800 and all(abs(r["a"] - r["b"]) < 1e-9 for r in rows)


def test_without_labels_and_empty_tables(spark, tables):
    docs, labels = tables
    out = toxicity.toxicity(docs, labels.where("false")).collect()
    assert {r["predicted"] for r in out} <= {0, 1} and len(out) == docs.count()
    assert toxicity.toxicity(docs.where("false"), labels).count() == 0
