"""Collocations against plain counting, at shards of any size."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stillkeep.llm import phrases


def plain_counts(docs, longest=5):
    n, f = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    return n, f


def plain(docs, support, top, longest=5):
    n, f = plain_counts(docs, longest)
    candidates = {p: a for p, a in f.items() if a >= support and len(p[1]) > 1}
    out = []
    for (lang, words), a in candidates.items():
        own = f" {' '.join(words)} "
        if any(g == lang and len(x) > len(words) and own in f" {' '.join(x)} " and b >= a for (g, x), b in candidates.items()):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = f[lang, words[:k]], f[lang, words[k:]]
            cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((lang, -score, -a, " ".join(words).encode(), left, right))
    rows = []
    for lang in n:
        for rank, (_, score, a, phrase, left, right) in enumerate(sorted(r for r in out if r[0] == lang)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(rows)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(1)
    words = ["a", "A", "b", "é", "ab", " x", "zß", "\x1f", "of", "the"]
    made = []
    for _ in range(150):
        parts = [rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ". ", "\n", ",", "!?"]) for _ in range(rng.randint(0, 60))]
        made.append((rng.choice(["en", "en", "de", None]), "".join(parts)))
    return made + [("en", "the the the the the the the"), ("fr", None), ("fr", ""), (None, " . "), ("de", made[0][1]), ("de", made[0][1])]


@pytest.mark.parametrize("shard", [40, 700, 1 << 25])
def test_collocations(spark, docs, shard):
    table = spark.createDataFrame([(k, g, t, "n", 1) for k, (g, t) in enumerate(docs)], "doc_id long, lang string, text string, phrase string, n int")
    for support, top in ((4, 2000), (9, 7)):
        got = sorted(map(tuple, phrases.collocations(table, support=support, top=top, shard_chars=shard, salts=3).collect()))
        assert got == plain(docs, support, top) and len(got) > 10


def test_counts_and_a_full_filter(spark, docs):
    """A filter in which every bit is set only costs time."""
    table = spark.createDataFrame(docs, "lang string, text string")
    n, f = plain_counts(docs)
    want = {(g, len(p), " ".join(p), a) for (g, p), a in f.items() if a >= 5} | {(g, 0, "", k) for g, k in n.items()} | {("fr", 0, "", 0)}
    for bits in (1 << 15, 1 << 28):
        assert {tuple(r) for r in phrases.frequent_phrases(table, support=5, max_bits=bits, shard_chars=900).collect()} == want
    assert not phrases.collocations(table.where("lang = 'none'")).collect()


def test_a_text_of_a_megabyte_is_cut_between_pieces(spark):
    one = "to be or not to be, that is; "
    table = spark.range(1).select(F.lit("en").alias("lang"), F.repeat(F.lit(one), 40_000).alias("text"))
    got = {r["phrase"]: r["a"] for r in phrases.collocations(table, shard_chars=10_000).collect()}
    assert got == {"to be": 80_000, "to be or not to": 40_000, "be or not to be": 40_000, "that is": 40_000}


def test_products_beyond_64_bits(spark):
    """a, n, l and r of 10**12: 1000 a n is 10**27."""
    row = spark.range(1).select(*(F.expr(f"{10**12 + k}L").alias(c) for k, c in enumerate(("a", "n", "l", "r"))))
    score = row.selectExpr("(CAST(1000 AS DECIMAL(4, 0)) * CAST(a AS DECIMAL(18, 0)) * CAST(n AS DECIMAL(18, 0))) div (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0))) AS s").first()["s"]
    assert score == 1000 * 10**12 * (10**12 + 1) // ((10**12 + 2) * (10**12 + 3))
