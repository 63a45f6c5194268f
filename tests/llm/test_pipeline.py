"""Each stage of the pipeline and the whole of it against brute force on small tables."""

import random
from collections import defaultdict

import pytest

import corpus_pipeline
from stillkeep.llm import packing
from tests.llm.test_dedup import _sets
from tests.llm.test_operators import WORDS, _components

BAD = ["idiot", "scum", "trash", "loser"]
ITEM = "in which year did the old bridge over the river fall and who built the new one after that"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, text_hash string, row string, may int"


def _documents():
    """(doc_id, text) with toxic texts, copies, near copies, passages, nulls, repeated rows and repeated ids."""
    rng = random.Random(12)
    prose = lambda n: " ".join(rng.choices(WORDS, k=n))
    rows, labels = [], []
    for k in range(300):
        toxic = k % 6 == 0
        words = (prose(50) + (" " + " ".join(rng.choices(BAD, k=3)) if toxic else "")).split()
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    clean = [(k, t) for k, t in rows if k % 6]
    rows += [(400 + k, t) for k, (_, t) in enumerate(clean[:12])]  # exact copies
    rows += [(430 + k, t + " w1 w2") for k, (_, t) in enumerate(clean[20:32])]  # near copies
    rows += [(460 + k, f"{prose(20)} {ITEM.upper()} {prose(20)}") for k in range(6)]
    rows += [(470, None), (471, ""), (472, "  \n"), (None, prose(30)), (None, ITEM), (480, prose(30)), (480, prose(31)), (480, ITEM)]
    same = prose(25)
    rows += [(490, same), (490, same)]
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    rows, labels = _documents()
    wide = [(i, t, "en", "web", len(t or ""), "x", "y", 1) for i, t in rows]
    spark.createDataFrame(wide, SCHEMA).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows


def _left(df):
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in df.collect()))


def _as(rows):
    return sorted((i is None, i or 0, t or "") for i, t in rows)


def _run(spark, tables, name, rows=None):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, tables[0])
    assert out.columns == docs.columns
    return out


def _toxic(text):
    return any(w in BAD for w in (text or "").split())


def _without_copies(rows):
    keep = defaultdict(lambda: -1)
    for i, t in rows:
        keep[t or ""] = max(keep[t or ""], -1 if i is None else i)
    return [(i, t) for i, t in rows if (-1 if i is None else i) == keep[t or ""]]


def _without_near(rows):
    sets = {k: _sets(t, 5) for k, (_, t) in enumerate(rows)}
    group = _components(sets, 80, 100)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[group[k]] = min(least.get(group[k], i), i)
    return [(i, t) for k, (i, t) in enumerate(rows) if not sets[k] or least.get(group[k]) == i]


def _without_passages(rows):
    return [(i, t) for i, t in rows if ITEM not in (t or "").lower()]


def test_toxic_documents_go(spark, tables):
    assert _left(_run(spark, tables, "toxicity")) == _as([(i, t) for i, t in tables[1] if not _toxic(t)])


def test_one_of_each_group_of_copies_stays(spark, tables):
    assert _left(_run(spark, tables, "exact_dedup")) == _as(_without_copies(tables[1]))


def test_one_of_each_group_of_near_copies_stays(spark, tables):
    assert _left(_run(spark, tables, "near_dedup")) == _as(_without_near(tables[1]))


def test_documents_with_passages_go(spark, tables):
    assert _left(_run(spark, tables, "decontamination")) == _as(_without_passages(tables[1]))


def test_the_whole_pipeline(spark, tables):
    want = _without_passages(_without_near(_without_copies([(i, t) for i, t in tables[1] if not _toxic(t)])))
    encode = packing._encoder(packing.tokenizer_path())
    tokens = sorted((i is None, i or 0, len(encode(t or "")) + 1) for i, t in want)
    out = corpus_pipeline.run(spark, tables[0]).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["length"]) for r in out) == tokens
    ends = defaultdict(list)
    for r in out:
        ends[r["sequence_id"]].append((r["offset"], r["offset"] + r["length"]))
    for own in ends.values():
        own.sort()
        assert own[0][0] == 0 and own[-1][1] <= packing.CAPACITY and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False))


def test_empty_tables(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0
