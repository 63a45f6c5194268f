"""Texts of a megabyte, columns with the operators' inner names, empty tables: nothing is cut and nothing crashes."""

import hashlib
import random

import pytest

from stillkeep.llm import exact_dedup, licenses, line_dedup, near_dedup, packing, toxicity
from tests.llm.test_operators import WORDS

NAMES = "doc_id long, text string, node long, check long, line string, body string, unit string, salt int, hits string, _at int, path string"


@pytest.fixture(scope="module")
def long(spark):
    rng = random.Random(1)
    words = rng.choices(WORDS, k=250_000)
    prose = " ".join(words)
    changed = list(words)
    changed[1000] = "changed"
    lines = "\n".join(" ".join(words[a : a + 20]) for a in range(0, 40_000, 20))
    one = "x" * 1_000_000
    rows = [(1, prose), (2, prose), (3, " ".join(changed)), (4, lines), (5, lines + "\nlast line of the text"), (6, one), (7, one + "y"), (8, None), (9, ""), (None, prose)]
    wide = [(i, t, 1, 2, "l", "b", "u", 3, "h", 4, f"/d{i}/f.txt") for i, t in rows]
    return spark.createDataFrame(wide, NAMES).repartition(3).cache(), rows


def test_exact_dedup(long):
    docs, rows = long
    out = {(r["doc_id"], r["text_sha256"]): (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(docs).collect()}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert out[1, sha(rows[0][1])] == (2, 3) and out[6, sha(rows[5][1])] == (6, 1) and out[8, sha("")] == (9, 2)


def test_near_dedup(long):
    docs, rows = long
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_dedup(docs, words=3, num=85).collect()}
    w = rows[0][1].split()
    assert out[1] == (len({tuple(w[k : k + 3]) for k in range(len(w) - 2)}), 1)
    assert [out[k][1] for k in (2, 3, 4, 5, 6, 7, 8, None)] == [1, 1, 4, 4, 6, 7, 8, 1]


def test_line_dedup(long):
    docs, rows = long
    out = {(r["doc_id"], r["line_no"]): r["kept"] for r in line_dedup.line_dedup(docs).collect() if r["doc_id"] in (4, 5, 6, 7)}
    assert all(out[4, k] for k in range(2000)) and not any(out[5, k] for k in range(2000)) and out[5, 2000]
    assert out[6, 0] and out[7, 0]  # one shingle of 8 equal letters against that and one more: alike by half
    assert len(out) == 4003


def test_packing(long):
    docs, rows = long
    encode = packing._encoder(packing.tokenizer_path())
    out = packing.packed_documents(docs).collect()
    for doc_id in (4, 6, 8, 9):
        own = sorted((r["piece"], r["start"], r["length"]) for r in out if r["doc_id"] == doc_id)
        assert own[0][1] == 0 and all(a[1] + a[2] == b[1] for a, b in zip(own, own[1:], strict=False))
        assert own[-1][1] + own[-1][2] == len(encode(dict(rows)[doc_id] or "")) + 1


def test_licenses_and_toxicity(spark, long):
    docs, rows = long
    out = licenses.license_scan(docs).collect()
    assert len(out) == len(rows) and all(r["license"] is None for r in out)
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    assert len(toxicity.toxicity(docs, labels).collect()) == len(rows)
