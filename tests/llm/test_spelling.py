"""Near words against all pairs of small vocabularies, the digest against plain loops."""

import random
import re
import zlib

from stillkeep.llm import spelling


def near(a: str, b: str) -> bool:
    """Exactly one code point inserted, deleted or replaced, by trying all of them."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def words(seed: int, n: int, letters: str = "abé", sizes: tuple[int, int] = (1, 7)) -> list[str]:
    rng = random.Random(seed)
    return sorted({"".join(rng.choices(letters, k=rng.randint(*sizes))) for _ in range(n)})


def test_acceptor_is_minimal_and_exact():
    machine = spelling.Machine()
    own = words(1, 300)
    start = machine.acceptor(own)
    assert sorted(machine._rest(start, start, set())) == own
    languages = []
    for q in range(len(machine.arcs)):
        languages.append(tuple(sorted(machine._rest(q, q, set()))))
    assert len(set(languages)) == len(languages)  # no two states accept the same


def test_composition_finds_each_pair_once():
    own = words(2, 400)
    machine = spelling.Machine()
    by_size = {k: [w for w in own if len(w) == k] for k in range(9)}
    found = []
    for k in range(1, 8):
        start = machine.acceptor(by_size[k])
        found += machine.one_edit(start, start, inserted=False)
        found += machine.one_edit(start, machine.acceptor(by_size[k + 1]), inserted=True)
    assert len(found) == len(set(found))
    assert {frozenset(p) for p in found} == {frozenset((a, b)) for a in own for b in own if near(a, b)}


def test_near_words_do_not_depend_on_the_partitions(spark):
    own = words(3, 500) + ["tail" * 30 + x for x in ("a", "b", "ab", "")]
    table = spark.createDataFrame([(w, k) for k, w in enumerate(own)] + [], "word string, n long")
    want = sorted((a, own.index(a), b, own.index(b)) for a in own for b in own if near(a, b))
    for most in (1, 12, 4000):
        assert sorted(map(tuple, spelling.near_words(table, most=most).collect())) == want


def test_a_word_of_a_megabyte_and_empty_tables(spark):
    long = "ab" * 500_000
    table = spark.createDataFrame([(long, 1), (long + "c", 9), (long[:-1], 3), (None, 5)], "word string, n long")
    rows = {(len(r["word"]), len(r["near"])) for r in spelling.near_words(table).collect()}
    assert rows == {(1_000_000, 1_000_001), (1_000_001, 1_000_000), (1_000_000, 999_999), (999_999, 1_000_000)}
    assert not spelling.spelling_variants(table.where("n > 100")).collect()
    docs = spark.createDataFrame([], "doc_id long, text string, n int")
    assert not spelling.spelling_variants(spelling.vocabulary(docs)).collect()


def plain_vocabulary(docs):
    n = {}
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] = n.get(run, 0) + 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def test_variants_of_documents(spark):
    rng = random.Random(4)
    some = words(5, 60, "abcÉÈz", (4, 6))
    docs = [(k, " ".join(rng.choices(some, weights=range(1, len(some) + 1), k=80)) + rng.choice(["", "!", "\n", " x-", "Ÿ", "ß÷"])) for k in range(60)]
    docs += [(None, "Abcab abcab, abcab"), (7, None), (8, ""), (3, docs[3][1]), (3, docs[3][1])]
    table = spark.createDataFrame([(i, t, "w", 1) for i, t in docs], "doc_id long, text string, word string, n int")
    n = plain_vocabulary(docs)
    got = {r["word"]: r for r in spelling.spelling_variants(spelling.vocabulary(table)).collect()}
    assert set(got) == set(n) and len(n) > 30
    form = {}
    for w in n:
        own = sorted((x for x in n if near(w, x)), key=lambda x: (-n[x], x))
        form[w] = own[0] if own and n[own[0]] >= 2 * n[w] else None
        assert (got[w]["n"], got[w]["n_near"], got[w]["form"]) == (n[w], len(own), form[w])
        assert got[w]["form_n"] == (n[form[w]] if form[w] else None)
    assert any(form.values())
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        assert got[w]["root"] == root
