"""Small fixtures against brute force, with nulls, empty and repeated texts, empty tables and clashing columns."""

import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import urllib.parse
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard

from stillkeep.llm import common, decontaminate, exact_dedup, line_dedup, near_dedup, packing, secrets, token_counts, toxicity

WORDS = [f"w{k}" for k in range(400)]
SCHEMA = "doc_id long, text string, keep_id string, n long, sha string"  # the last three clash with inner names


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(1, 80))) for _ in range(n)]
    texts += [texts[0]] * 7 + [texts[1].upper()] * 2
    for base in texts[:6]:
        for _ in range(6):
            words = base.split()
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            texts.append(" ".join(words))
    rows = [(k, t, "x", 1, "y") for k, t in enumerate([*texts, None, "", "  \n", "one", "one two", "é ñ 中 𝄞"])]
    return [*rows, rows[3], rows[3], (None, texts[2], "x", 1, "y")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_golomb_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 3000):
        values = np.unique(rng.integers(0, 1 << 48, n).astype(np.uint64))
        assert (exact_dedup.golomb_decode(exact_dedup.golomb_encode(values)) == values).all()


@pytest.mark.parametrize("bits", [48, 4])
def test_exact_dedup(docs, bits):
    groups = defaultdict(list)
    for i, t, *_ in corpus():
        groups[t or ""].append(i)
    out = exact_dedup.exact_dedup(docs, fp_bits=bits).drop("text_hash").collect()
    assert len(out) == len(corpus())
    want = set()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want |= {(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids}
    assert {tuple(r) for r in out} == want


def test_empty_tables(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert near_dedup.near_dedup(empty).count() == 0
    assert packing.packed_documents(empty).count() == 0
    assert line_dedup.line_dedup(empty).count() == 0


def _components(sets, num, den):
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = list(sets)
    for a in range(len(keys)):
        for b in range(a):
            x, y = sets[keys[a]], sets[keys[b]]
            if x and y and den * len(x & y) >= num * len(x | y):
                i, j = sorted((find(keys[a]), find(keys[b])))
                parent[j] = i
    return {k: find(k) for k in sets}


def test_near_dedup(docs):
    sets = {}
    for i, t, *_ in corpus():
        if i is not None:
            w = (t or "").lower().split()
            sets[i] = frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])
    want = _components(sets, 85, 100)
    out = [r for r in near_dedup.near_dedup(docs, words=3, num=85).collect() if r["doc_id"] is not None]
    assert {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out} == {(i, len(sets[i]), want[i], i == want[i]) for i in sets}


def test_components(spark):
    chain = [(k, k + 1) for k in range(200)] + [(1000, 1001), (5, 5)]
    out = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert out == {k: 0 for k in range(201)} | {1000: 1000, 1001: 1000}


def test_line_dedup(spark):
    rng = random.Random(4)
    line = lambda: " ".join(rng.choices(WORDS, k=20))
    shared = [line() for _ in range(4)]
    rows = []
    for i in range(30):
        own = [line(), rng.choice(shared), rng.choice(shared) + "!", "", "ab"]
        rows.append((i, "\n".join(own)))
    rows += [(30, None), (31, "")]
    flat = [(i, k, x) for i, t in rows for k, x in enumerate((t or "").split("\n"))]
    sets = {}
    for _, _, x in flat:
        if x.strip():
            b = x.encode()
            sets[x] = frozenset(b[k : k + 8] for k in range(len(b) - 7)) or frozenset([b])
    classes, seen, want = _components(sets, 80, 100), set(), {}
    for i, k, x in flat:
        want[i, k] = not x.strip() or classes[x] not in seen
        if x.strip():
            seen.add(classes[x])
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(r["doc_id"], r["line_no"]): r["kept"] for r in out} == want


def test_line_shingles_are_of_characters():
    lines = ["plain ascii line", "größere Straße über Öl", "中文字符一二三四五六七八九十", "短い", "𝄞𝄞 mixed é中 𝄞 text 𝄞𝄞", "", "abc", "größere Straße uber Öl"]
    sets = [frozenset(x[k : k + 8] for k in range(len(x) - 7)) or frozenset([x] if x else []) for x in lines]
    got = [set(x.tolist()) for x in line_dedup.line_sets(common.pa.array(lines))]
    assert [len(x) for x in got] == [len(x) for x in sets]
    for a in range(len(lines)):
        assert got[a] == set(line_dedup.line_sets(common.pa.array([lines[a]]))[0].tolist())  # whatever lines stand around
        for b in range(a):
            assert len(got[a] & got[b]) == len(sets[a] & sets[b])



def test_combinations_of_three_win_where_lengths_are_many():
    """Many pieces of all lengths: the plan that is taken fills gaps by pairs and triples too, and needs no more sequences than best fit."""
    rng = random.Random(21)
    lengths = [1024] * 500 + [min(1024, max(1, int(rng.lognormvariate(5.2, 1.1)))) for _ in range(12_000)]
    histogram = dict(Counter(lengths))
    plan = packing.pack_plan(histogram, 1024)
    used = Counter()
    for pattern, times in plan:
        assert sum(pattern) <= 1024
        for x in pattern:
            used[x] += times
    assert used == Counter(lengths)
    total = lambda p: sum(n for _, n in p)
    assert total(plan) <= total(packing._plan(histogram, 1024, 0)) and total(plan) <= -(-sum(lengths) // 1024) + 2
    full = packing._plan(histogram, 1024, 3)
    assert total(plan) == total(full) and any(len(p) == 4 and sum(p) == 1024 for p, _ in full)


def test_packing(docs):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.tokenizer_path())
    out = packing.packed_documents(docs, capacity=64).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in out}) == len(out)
    sequences = defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
    open_gaps: list[int] = []
    for length in sorted((r["length"] for r in out), reverse=True):  # first fit decreasing is not beaten by much, nor beats
        at = next((k for k, gap in enumerate(open_gaps) if gap >= length), None)
        if at is None:
            open_gaps.append(64 - length)
        else:
            open_gaps[at] -= length
    assert len(sequences) <= len(open_gaps)
    texts = {i: t for i, t, *_ in corpus()}
    for r in out:
        if r["doc_id"] is not None:
            ids = own.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [2]
            piece = ids[r["start"] : r["start"] + r["length"]]
            assert len(piece) == r["length"]
            assert zlib.crc32(b"".join(x.to_bytes(4, "little") for x in piece)) == r["ids_crc32"]
    assert Counter(r["doc_id"] for r in out if r["piece"] == 0) == Counter(i for i, *_ in corpus())


def test_packing_takes_added_tokens_as_the_tokenizer_does(tmp_path):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    alone = tmp_path / "alone.json"  # without a rank file beside it
    alone.write_bytes(open(path, "rb").read())
    own = Tokenizer.from_file(path)
    for encode in (packing._encoder(path), packing._encoder(str(alone))):
        for text in ("a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|><|endoftext|> é\n<|endoftext|", "plain", ""):
            assert encode(text) == own.encode(text, add_special_tokens=False).ids
        assert encode("a<|endoftext|>b") == [64, 50256, 65]


def test_plan_uses_each_length_as_often_as_it_occurs():
    rng = random.Random(8)
    for n in (1, 7, 300, 20000):
        have = Counter(rng.randint(1, 1024) for _ in range(n))
        used = Counter()
        for pattern, times in packing.pack_plan(have, 1024):
            assert sum(pattern) <= 1024
            for x in pattern:
                used[x] += times
        assert used == have


SECRET = "zz password=hunter22 zz"


@pytest.mark.parametrize(
    "wrap",
    [
        lambda s: urllib.parse.quote(s, safe=""),
        lambda s: base64.b64encode(s.encode()).decode(),
        lambda s: base64.b64encode(gzip.compress(s.encode(), mtime=0)).decode(),
        lambda s: urllib.parse.quote(base64.b64encode(b"zz " + base64.b64encode(s.encode())).decode(), safe=""),
        lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
    ],
)
def test_secrets_in_layers(wrap):
    text = "é before " + wrap(SECRET) + " after"
    base, spans = secrets.all_spans(text)
    assert not base and [k for k, *_ in spans] == ["assign"]
    assert text.index(wrap(SECRET)[:4]) <= spans[0][1] < spans[0][2] <= len(text) - len(" after")


@pytest.mark.parametrize(
    "raw",
    [
        b"\xef\xbb\xbf" + SECRET.encode(),
        ("a\u00a0b\u200b\x1b[1m " + SECRET).encode(),
        b"\x00\x0c " + SECRET.encode(),
        SECRET.encode("utf-16"),
        SECRET.encode("utf-16-le"),
        SECRET.encode("utf-16-be"),
        gzip.compress(SECRET.encode("utf-16-le")),
    ],
)
def test_secrets_in_layers_of_any_characters(raw):
    assert [k for k, *_ in secrets.all_spans("before " + base64.b64encode(raw).decode() + " after")[1]] == ["assign"]


@pytest.mark.parametrize("pack", [lambda x: gzip.compress(x, mtime=0), zlib.compress, bz2.compress, lzma.compress, lambda x: zstandard.ZstdCompressor().compress(x)])
def test_secrets_in_packed_members(pack):
    secret, filler = SECRET.encode(), b"nothing here. " * 40
    kinds = lambda text, most=1 << 26: [k for k, *_ in secrets.all_spans(text, most)[1]]
    in_base64 = lambda raw: base64.b64encode(raw).decode()
    assert kinds(in_base64(pack(filler) + pack(secret))) == ["assign"]
    assert kinds(in_base64(pack(pack(filler) + pack(secret)))) == ["assign"]
    assert kinds(in_base64(pack("é".encode() * 5000 + secret + "é".encode() * 5000)), 1001) == ["assign"]  # content beyond `most`
    random_text = random.Random(7).randbytes(300).hex(" ").encode()
    both = pack(random_text + b" " + secret)
    assert kinds("see " + urllib.parse.quote(both) + " end") == ["assign"]
    assert kinds("".join(f"\\x{b:02x}" for b in both)) == ["assign"]
    assert kinds("x = " + repr(both) + " # end") == ["assign"]
    for text in (base64.encodebytes(both).decode(), base64.encodebytes(both).decode().replace("\n", "\r\n")):
        assert kinds("begin\n" + text + "end") == ["assign"]


def test_secret_over_a_line_break_of_base64():
    text = "key:\n" + base64.encodebytes(b"x" * 50 + b" password=hunter22 " + b"y" * 60).decode() + "done"
    (kind, start, end), *more = secrets.all_spans(text)[1]
    assert kind == "assign" and not more
    held = "".join(text[start:end].split())
    assert base64.b64decode(held + "A" * (-len(held) % 4)).strip(b"\0").startswith(b"password") or b"assword=hunter2" in base64.b64decode("A" * (-len(held) % 4) + held)


def test_base_spans():
    text = 'api_key: "abcdef" TOKEN=short secret = x/y+zzzz AKIA' + "A" * 16 + " AKIA123 " + "0a" * 12 + " ſecret=abcdefg"
    assert [text[a:b] for k, a, b in secrets.all_spans(text)[0] if k == "assign"] == ['api_key: "abcdef', "secret = x/y+zzzz"]
    assert Counter(k for k, *_ in secrets.all_spans(text)[0]) == {"assign": 2, "access": 1, "hex": 1}
    assert secrets.all_spans("") == ([], [])


def test_decontaminate(spark):
    rng = random.Random(6)
    items = [" ".join(rng.choices(WORDS, k=n)) for n in (15, 22, 40, 70)]
    rows, want = [(90, None), (91, ""), (92, " ".join(WORDS[:60]))], set()
    for k, item in enumerate(items):
        for e in range(12):
            words = item.split()
            for _ in range(int(0.1 * len(words)) if e else 0):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            rows.append((k * 20 + e, " ".join(rng.choices(WORDS, k=rng.randint(0, 30)) + words + rng.choices(WORDS, k=rng.randint(0, 30))).upper()))
            want.add((k * 20 + e, k))
    bench = spark.createDataFrame([*enumerate(items), (8, None), (9, "")], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = decontaminate.decontaminate(docs, bench).collect()
    got = {(r["doc_id"], r["item_id"]) for r in out}
    assert got <= want and len(got) >= 0.97 * len(want) and {(k * 20, k) for k in range(4)} <= got
    assert decontaminate.decontaminate(docs, bench, block_words=40).count() >= 0.97 * len(want)
    assert decontaminate.decontaminate(docs, bench.where("false")).count() == 0


def _spans(texts, items):
    index = decontaminate.build_index(list(enumerate(items)), 80, 100, 0.98)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    w, doc, _, _ = common.hashed_words(data, np.cumsum([0, *map(len, texts)]))
    count = np.bincount(doc, minlength=len(texts))
    return decontaminate.contaminated_spans(w, np.cumsum(count) - count, count, index)


def test_decontaminate_finds_short_items_at_every_place():
    rng = random.Random(11)
    for n in range(1, 18):
        items = [" ".join(rng.choices(WORDS[:300], k=n)) for _ in range(3)]
        texts, want = [], set()
        for k, item in enumerate(items):
            for before in range(8):
                want.add((len(texts), k))
                around = rng.choices(WORDS[300:], k=before + 9)
                texts.append(" ".join([*around[:before], item, *around[before:]]))
        got = {(d, i) for d, i, distance, _ in _spans(texts, items) if distance == 0}
        assert want <= got, n


def test_decontaminate_counts_a_fifth_of_the_words():
    rng = random.Random(12)
    for n, most in ((5, 1), (10, 2), (20, 4), (25, 5), (40, 8)):
        item = " ".join(f"i{k}" for k in range(n))
        texts = []
        for edits in [most] * 60 + [most + 1] * 20:
            words = item.split()
            for at in rng.sample(range(n), edits):
                words[at] = "other"
            texts.append(" ".join(rng.choices(WORDS, k=rng.randint(0, 9)) + words + rng.choices(WORDS, k=9)))
        found = {d for d, *_ in _spans(texts, [item])}
        assert found <= set(range(60)) and len(found) >= 55, n


def test_edit_places():
    assert decontaminate.edit_places(np.array([[9, 1, 2, 4, 5, 9]], np.uint64), np.array([1, 2, 3, 4, 5], np.uint64))[0][0] == 1


def test_token_counts(docs):
    pieces = {b"a": -1.0, b"b": -1.2, b"ab": -1.5, b"abc": -9.0, b"c": -2.0, b" ": -1.0, b"ba": -1.1}
    table = token_counts.PieceTable(pieces)

    def brute(w):
        best = [(0.0, 0)]
        for e in range(1, len(w) + 1):
            options = [(best[e - n][0] + pieces[w[e - n : e]], n) for n in range(1, e + 1) if w[e - n : e] in pieces]
            score, n = max(options)
            best.append((score, best[e - n][1] + 1))
        return best[-1][1]

    rng = random.Random(1)
    words = list({bytes(rng.choices(b"abc ", k=rng.randint(1, 9))) for _ in range(300)})
    assert token_counts.trie_counts(words, table).tolist() == [brute(w) for w in words]
    a, b = ({(r[0], r[1], r[2]) for r in token_counts.token_counts(docs, batch_chars=n).collect()} for n in (50, 10**7))
    assert a == b and len(a) >= 100
