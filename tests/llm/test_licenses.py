"""Licence scans against every template and against plain TF-IDF over all units."""

import math
import random
import re
from collections import Counter, defaultdict

from stillkeep.llm import licenses
from tests.llm.test_operators import WORDS


def test_licenses(spark):
    rows = [
        (1, "/a/LICENSE", "Released under the MIT License."),
        (2, "/a/b/x.py", "code"),
        (3, "/a/b/y.py", "# Licensed under the Apache License, Version 2.0\n" + "code " * 40),
        (4, "/c/z.py", None),
        (5, None, "code"),
        (6, "/a/b/d/q.py", ""),
    ]
    out = {r["doc_id"]: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert [out[k]["license"] for k in (1, 2, 3, 4, 5, 6)] == ["MIT", "MIT", "Apache-2.0", None, None, "MIT"]
    assert out[6]["inherited_from"] == "/a" and out[3]["inherited_from"] is None


def test_licenses_of_every_template(spark):
    own = {**licenses.TEMPLATES, **licenses.NAMES}
    rows = [(k, f"/d{k}/x.py", "some code here\n" * 5 + line + "\n" + "more code\n" * 5) for k, line in enumerate([*own.values(), "All rights reserved."])]
    rows += [(100 + k, f"/f{k}/x.py", "\n".join(" ".join(random.Random(k).choices(WORDS, k=12)) for _ in range(40))) for k in range(60)]
    out = {r["doc_id"]: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    want = [re.sub("-(text|name|full)$", "", x) for x in own] + ["All-Rights-Reserved"]
    assert [out[k]["own_license"] for k in range(len(want))] == want
    assert all(out[100 + k]["own_license"] is None for k in range(60))


def test_licenses_over_lines_and_inside_paragraphs(spark):
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */\n"
    prose = lambda k: " ".join(random.Random(k).choices(WORDS, k=60))
    rows = [
        (1, "/a/x.c", mpl + "int x;\n" * 30),
        (2, "/b/x.txt", f"{prose(1)} Released under the MIT License {prose(2)}"),
        (3, "/c/x.txt", f"{prose(3)}. Licensed under the Apache\nLicense, Version 2.0. {prose(4)}"),
        (4, "/d/x.txt", prose(5)),
    ]
    out = {r["doc_id"]: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert [out[k]["own_license"] for k in (1, 2, 3, 4)] == ["MPL-2.0", "MIT", "Apache-2.0", None]
    assert not any(out[k]["is_license_file"] for k in (1, 2, 3, 4))


def _brute(files, threshold=0.6, cover=0.5):
    """Every unit and stretch against every template, nothing left out before; directories one step up at a time."""
    every = {**licenses.TEMPLATES, **licenses.NAMES}
    df, total = Counter(), 0
    for _, _, text in files:
        for line in (text or "").split("\n"):
            own = set(licenses.tokens(line))
            df.update(own)
            total += bool(own)
    idf = lambda t: math.log((1 + total) / (1 + df[t])) + 1

    def vector(words):
        tf = Counter(words)
        norm = math.sqrt(sum((n * idf(t)) ** 2 for t, n in tf.items()))
        return {t: n * idf(t) / norm for t, n in tf.items()}

    vectors = {n: vector(licenses.tokens(x)) for n, x in every.items()}

    def scores(words):
        # tokens that no line has cannot be in a text
        own = vector(words)
        return sorted((-round(sum(w * own.get(t, 0) for t, w in v.items()), 9), n) for n, v in vectors.items())

    found = {}
    for k, (_, path, text) in enumerate(files):
        words, spans = licenses.units(text or "")
        by_word = [licenses.tokens(w) for w in words]
        hits = []
        for a, b in spans:
            own = [t for x in by_word[a:b] for t in x]
            if own and -(best := scores(own)[0])[0] >= threshold:
                hits.append((best, a, b))
        flat = [(t, w) for w, own in enumerate(by_word) for t in own]
        for size in {len(licenses.tokens(x)) for x in licenses.TEMPLATES.values()}:
            for at in range(len(flat) - size + 1):
                ranked = scores([t for t, _ in flat[at : at + size]])
                if any(-score >= licenses.INSIDE and n in licenses.TEMPLATES and len(licenses.tokens(every[n])) == size for score, n in ranked):
                    hits.append((ranked[0], flat[at][1], flat[at + size - 1][1] + 1))
        if hits:
            (score, name), *_ = min(hits)
            covered = len({w for _, a, b in hits for w in range(a, b)})
            base = (path or "").rpartition("/")[2]
            named = bool(re.match(r"(LICEN[CS]E|COPYING)([.-].*)?$", base.upper()))
            found[k] = (re.sub("-(text|name|full)$", "", name), -score, named or covered >= cover * len(words))
    votes = defaultdict(Counter)
    for k, (name, _, is_file) in found.items():
        if is_file and files[k][1] is not None:
            votes[files[k][1].rpartition("/")[0]][name] += 1
    out = []
    for k, (doc_id, path, _) in enumerate(files):
        own = found.get(k)
        name, near = own and own[0], None
        at = path.rpartition("/")[0] if path is not None else None
        while own is None and at is not None:
            if at in votes:
                name, near = min(votes[at].items(), key=lambda x: (-x[1], x[0]))[0], at or "/"
                break
            at = at.rpartition("/")[0] if at else None
        out.append((doc_id, path, own and own[0], own and round(own[1], 6), bool(own and own[2]), name, near))
    return out


def test_against_all_units_and_templates(spark):
    rng = random.Random(7)
    prose = lambda n: " ".join(rng.choices(WORDS, k=n))
    texts = list({**licenses.TEMPLATES, **licenses.NAMES}.values())
    files = []
    for k in range(60):
        parts = [prose(rng.randint(0, 25)) for _ in range(3)]
        kind = k % 6
        if kind == 1:
            parts.insert(1, rng.choice(texts))
        elif kind == 2:
            words = rng.choice(texts).split()
            parts.insert(1, " ".join(w for w in words if rng.random() > 0.25))
        elif kind == 3:
            words = "/* " + rng.choice(texts)
            parts = ["\n * ".join(words[a : a + 60] for a in range(0, len(words), 60)) + " */", *parts]
        elif kind == 4:
            parts = [f"{parts[0]} {rng.choice(texts)} {parts[1]}"]
        name = rng.choice(["LICENSE", "COPYING.txt", "a.py", "b.c", "licence-mit"])
        files.append((k, "/" + "/".join(rng.choices("xyz", k=rng.randint(0, 3))) + f"/{k}/{name}"[rng.randint(0, 1) * len(f"/{k}") :], "\n".join(parts)))
    files += [(100, None, "Released under the MIT License"), (101, "/x/q.py", None), (102, "/x/q.py", ""), (103, "/LICENSE", texts[1]), files[7], files[7]]
    df = spark.createDataFrame(files, "doc_id long, path string, text string")
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    got = sorted(((r["doc_id"], r["path"], r["own_license"], r["own_score"] and round(r["own_score"], 6), r["is_license_file"], r["license"], r["inherited_from"]) for r in licenses.license_scan(df).collect()), key=key)
    assert got == sorted(_brute(files), key=key)
    assert sum(r[2] is not None for r in got) > 20 and sum(r[6] is not None for r in got) > 5


def test_whole_licences(spark):
    from stillkeep.llm.license_texts import FULL_TEXTS

    wrap = lambda text: "\n".join(text[a : a + 70] for a in range(0, len(text), 70))
    rows = [(k, f"/p{k}/LICENSE", f"Copyright (c) 2020 Some One\n\n{wrap(text)}\n", 1) for k, text in enumerate(FULL_TEXTS.values())]
    out = {r["doc_id"]: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string, unit int")).collect()}
    assert [out[k]["own_license"] for k in range(len(rows))] == [n.removesuffix("-full") for n in FULL_TEXTS]
    assert all(r["is_license_file"] for r in out.values())
    assert licenses.license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string, unit int").where("false")).count() == 0


def test_no_table_that_grows_goes_through_the_driver(spark, capsys):
    """Whatever Spark guesses of their sizes, only the templates are broadcast."""

    def broadcasts(df):
        df.explain()
        return capsys.readouterr().out.count("BroadcastExchange")

    files = [(k, f"/a/{k % 3}/x.py", "Released under the MIT License\ncode") for k in range(9)]
    out = licenses.license_scan(spark.createDataFrame(files, "doc_id long, path string, text string"))
    assert broadcasts(out) == 0
    units = spark.createDataFrame([("released under the mit license",), ("under the mit",)], "unit string")
    df = spark.createDataFrame([(t, 1) for t in "released under the mit license".split()], "token string, df long")
    template = spark.createDataFrame([("MIT", t, 0.45) for t in "released under the mit license".split()], "template string, token string, tw double")
    scores = licenses.scored_units(units, df, 9, template)
    assert broadcasts(scores) == 1
    assert {r["unit"] for r in scores.collect()} == {"released under the mit license", "under the mit"}
    assert {r["license"] for r in out.collect()} == {"MIT"}
