"""Dedup at the edges: large groups, repeated ids, names that collide, full filters."""

import random
import uuid
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stillkeep.llm import common, exact_dedup, line_dedup, near_dedup
from tests.llm.test_operators import WORDS, _components


def _texts(seed, groups=3, size=40):
    """Families of near copies, some far from their first member, and texts of other lengths."""
    rng = random.Random(seed)
    texts = []
    for _ in range(groups):
        base = rng.choices(WORDS, k=60)
        for _ in range(size):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, 5, 9, 14])):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            texts.append(" ".join(words[: rng.choice([60, 60, 60, 52, 45])]))
    return texts


def _sets(text, size=3):
    w = (text or "").lower().split()
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("block, elements", [(4, 10**9), (1000, 150), (192, 10**9)])
def test_large_groups_in_blocks(spark, monkeypatch, block, elements):
    monkeypatch.setattr(near_dedup.linked_components, "__defaults__", (None, None, near_dedup._plain_sets, block, elements))
    texts = _texts(5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = _components({k: _sets(t) for k, t in enumerate(texts)}, 85, 100)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(docs, words=3, num=85).collect()}
    assert got == want and len(set(want.values())) < len(texts)


def test_repeated_ids_keep_their_own_texts(spark):
    rng = random.Random(3)
    a, b, c = (" ".join(rng.choices(WORDS, k=40)) for _ in range(3))
    rows = [(1, a), (7, a + " more"), (7, b), (7, b), (9, c), (9, None), (None, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = near_dedup.near_dedup(docs, words=3, num=85).collect()
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in out)
    assert got == sorted([(1, 38, 1, True), (7, 39, 1, False), (7, 38, 7, True), (7, 38, 7, True), (9, 38, 9, True), (9, 0, 9, True), (0, 38, 9, False)])
    left = common.without(docs, near_dedup.near_dedup(docs, words=3, num=85).where("NOT kept"))
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left.collect()) == sorted((i or 0, t or "") for i, t in rows if t != a + " more" and (i, t) != (None, c))


def test_without_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a", 1, 2), (1, "b", 1, 2), (2, None, 1, 2), (None, "a", 1, 2)], "doc_id long, text string, _may int, row int")
    gone = docs.where("doc_id = 1 AND text = 'a' OR doc_id = 2 OR doc_id IS NULL").select("doc_id", common.text_hash(F.col("text")).alias("text_hash"))
    left = common.without(docs, gone)
    assert left.columns == docs.columns and sorted((r["doc_id"] or 0, r["text"]) for r in left.collect()) == [(1, "b")]
    assert common.without(docs, gone.where("false")).count() == 4 and common.without(docs.where("false"), gone).count() == 0


def test_filter_passes_all_keys_and_few_others(spark):
    keys = spark.range(0, 50_000, 5)
    own = common.KeyFilter(keys, "id")
    passed = {r["id"] for r in own.matching(spark.range(50_000), F.col("id")).collect()}
    assert set(range(0, 50_000, 5)) <= passed and len(passed) < 10_000 + 4_000
    full = common.KeyFilter(keys, "id", max_bits=1 << 15)
    assert {r["id"] for r in full.matching(spark.range(50_000), F.col("id")).collect()} >= set(range(0, 50_000, 5))
    assert common.KeyFilter(keys.where("false"), "id").matching(spark.range(9), F.col("id")).count() == 0


def test_full_filter_changes_no_result(spark, monkeypatch):
    """Whatever the filter lets through, only wanted texts become sets, and results stay."""
    texts = [*_texts(6, 2, 12), *(" ".join(random.Random(k).choices(WORDS, k=30)) for k in range(40))]
    docs = spark.createDataFrame([*enumerate(texts), (900, texts[0])], "doc_id long, text string").repartition(3)
    results = lambda: [{tuple(r) for r in f(docs).collect()} for f in (exact_dedup.exact_dedup, near_dedup.near_dedup, line_dedup.line_dedup)]
    before = results()
    monkeypatch.setattr(common.KeyFilter, "matching", lambda self, df, key: df)
    seen = []
    inner = near_dedup._sets
    monkeypatch.setattr(near_dedup, "stored", lambda df, tag: seen.append((tag, df)) or common.stored(df, tag))
    assert results() == before and inner
    made = [df.count() for tag, df in seen if tag == "sets"]
    assert made[0] < len(texts)  # the sets of near_dedup: of candidates only


@pytest.mark.parametrize("bits", [64, 4])
def test_lines_with_one_name_are_not_dropped_for_each_other(spark, bits):
    rng = random.Random(8)
    lines = [" ".join(rng.choices(WORDS, k=12)) for _ in range(60)]
    rows = [(k, "\n".join([x, lines[(k + 1) % 60]])) for k, x in enumerate(lines)]
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), name_bits=bits).collect()
    kept = defaultdict(int)
    for r in out:
        kept[rows[r["doc_id"]][1].split("\n")[r["line_no"]]] += r["kept"]
    assert all(kept[x] >= 1 for x in lines)
    if bits == 64:
        assert all(kept[x] == 1 for x in lines)


def test_a_large_group_of_near_copies_is_not_compared_by_all_pairs_of_blocks(spark, monkeypatch, tmp_path):
    """The groups' smallest members are unlike the others, which are all linked: those that met in chunks need no more."""
    rng = random.Random(11)
    base = rng.choices(WORDS, k=80)
    texts = [" ".join(rng.choice(WORDS) if k in gone else w for k, w in enumerate(base)) for gone in (rng.sample(range(80), 3 if n < 6 else 1) for n in range(400))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(near_dedup.linked_components, "__defaults__", (None, None, near_dedup._plain_sets, 20, 10**9))
    inner = near_dedup._block_links

    def counting(*args):
        work = inner(*args)

        def counted(batches):
            def seen():
                for batch in batches:
                    with open(f"{tmp_path}/{uuid.uuid4().hex}", "w") as f:
                        f.write(str(batch.num_rows))
                    yield batch

            yield from work(seen())

        return counted

    monkeypatch.setattr(near_dedup, "_block_links", counting)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(docs, words=3, num=85).collect()}
    assert got == _components({k: _sets(t) for k, t in enumerate(texts)}, 85, 100)
    rows = sum(int(f.read_text()) for f in tmp_path.iterdir())
    assert rows < 25 * len(texts), rows


def test_overlapping_stars_take_few_rounds(spark, monkeypatch):
    """What large groups give out: stars around small nodes, which share members. Tables written stand for rounds."""
    rng = random.Random(2)
    edges = [(a, v) for a in range(10) for v in rng.sample(range(100, 700), 300)] + [(800, v) for v in range(801, 1200)]
    seen = []
    monkeypatch.setattr(common, "stored", lambda df, tag, write=common.stored: seen.append(tag) or write(df, tag))
    out = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {x: 800 if x >= 800 else 0 for e in edges for x in e}
    assert len(seen) < 15, len(seen)


def test_groups_of_one_block_write_no_tables_of_chunks(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(near_dedup, "stored", lambda df, tag: seen.append(tag) or common.stored(df, tag))
    docs = spark.createDataFrame(list(enumerate(_texts(7))), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(docs, words=3, num=85).collect()}
    assert got == _components({k: _sets(t) for k, t in enumerate(_texts(7))}, 85, 100)
    assert "groups" in seen and not {"met", "cells"} & set(seen)
