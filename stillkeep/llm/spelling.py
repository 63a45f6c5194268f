"""Spelling variants of a vocabulary by finite-state composition.

Two words are near if one edit (a code point inserted, deleted or replaced) makes one of the other. Near pairs are the
accepted paths of the composition of the vocabulary's minimal acceptor, a transducer of exactly one edit, and the acceptor again.
The composed machine is cut by its initial states: a pair whose edit lies in a window of places agrees on all that is
before and after the window, so words of one window, prefix and suffix are a partition of their own, whose
residues get a minimal acceptor and are composed in one task. Each pair has one place of edit, hence one window.
Windows start as halves of a word and are halved again where a partition holds too many words.
"""

from __future__ import annotations

import itertools
import os.path
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillkeep.llm.common import dropped, lowered, stored, table, text_slices, word_ids

# ---------------------------------------------------------------- the automaton


class Machine:
    """Minimal acyclic acceptors that share their states: equal residual languages are one state."""

    def __init__(self) -> None:
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self._known: dict[tuple, int] = {}

    def _state(self, arcs: dict[str, int], final: bool) -> int:
        key = (final, *arcs.items())
        at = self._known.get(key)
        if at is None:
            at = self._known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
        return at

    def acceptor(self, words: list[str]) -> int:
        """The start state of the minimal acceptor of sorted distinct words; time and memory grow with their letters."""
        open_: list[tuple[dict[str, int], bool]] = [({}, False)]
        last = ""

        def close(depth: int) -> None:
            while len(open_) > depth + 1:
                at = self._state(*open_.pop())
                open_[-1][0][last[len(open_) - 1]] = at

        for word in words:
            shared = len(os.path.commonprefix((last, word)))
            close(shared)
            last = word
            open_.extend(({}, False) for _ in word[shared:])
            open_[-1] = (open_[-1][0], True)
        close(0)
        return self._state(*open_[0])

    def _both(self, q: int, r: int, but: str | None = None) -> Iterator[tuple[str, int, int]]:
        a, b = self.arcs[q], self.arcs[r]
        for c in a if len(a) <= len(b) else b:
            if c in a and c in b and c != but:
                yield c, a[c], b[c]

    def _rest(self, q: int, r: int, dead: set[tuple[int, int]], but: str | None = None) -> Iterator[str]:
        """After the edit: what both copies of the acceptor read to their ends, not beginning with ``but``."""
        if self.final[q] and self.final[r]:
            yield ""
        path: list[str] = []
        frames = [(q, r, self._both(q, r, but))]
        alive = [True]  # the first frame may leave out an arc, so nothing is learnt from it
        while frames:
            for c, q2, r2 in frames[-1][2]:
                if (q2, r2) in dead:
                    continue
                path.append(c)
                frames.append((q2, r2, self._both(q2, r2)))
                alive.append(self.final[q2] and self.final[r2])
                if alive[-1]:
                    yield "".join(path)
                break
            else:
                q2, r2, _ = frames.pop()
                if not alive.pop():
                    dead.add((q2, r2))
                elif alive:
                    alive[-1] = True
                if path:
                    path.pop()

    def one_edit(self, first: int, second: int, inserted: bool, at_end: bool = True) -> Iterator[tuple[str, str]]:
        """The composition's accepted pairs, each once: the second word has one letter replaced (by a later one) or one more.

        The edit is at the first place where the words differ; without ``at_end`` nothing is inserted after the first word's last letter.
        """
        dead: set[tuple[int, int]] = set()
        path: list[str] = []
        frames = [(first, second, self._both(first, second))]
        fresh = True
        while frames:
            q, r, below = frames[-1]
            if fresh:
                if not inserted:
                    for (a, q2), (b, r2) in itertools.combinations(self.arcs[q].items(), 2):
                        for rest in self._rest(q2, r2, dead):
                            here = "".join(path)
                            yield here + a + rest, here + b + rest
                elif at_end or self.arcs[q]:
                    for b, r2 in self.arcs[r].items():
                        if b in self.arcs[q] and len(self.arcs[q]) == 1 and not self.final[q]:
                            continue  # the first word goes on with this letter: the place of the edit is later
                        for rest in self._rest(q, r2, dead, but=b):
                            here = "".join(path)
                            yield here + rest, here + b + rest
            fresh = False
            for c, q2, r2 in below:
                path.append(c)
                frames.append((q2, r2, self._both(q2, r2)))
                fresh = True
                break
            else:
                frames.pop()
                if path:
                    path.pop()


def _pairs_of(prefix: str, suffix: str, at_end: bool, short: list[str], long: list[str]) -> Iterator[tuple[str, str]]:
    """Near pairs of one partition; ``long`` words have one letter more, and a pair of two of them belongs elsewhere.

    at_end: whether the place after a short word's last letter is in the window.
    """
    middle = lambda words: sorted(w[len(prefix) : len(w) - len(suffix)] for w in words)
    machine = Machine()
    start = machine.acceptor(middle(short))
    found = [machine.one_edit(start, start, inserted=False)]
    if long:
        found.append(machine.one_edit(start, machine.acceptor(middle(long)), inserted=True, at_end=at_end))
    for a, b in itertools.chain(*found):
        yield prefix + a + suffix, prefix + b + suffix


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by partition: the near pairs of each partition, both ways."""
    columns = ("state", "word", "n", "longer", "before", "after", "at_end")
    rows = itertools.chain.from_iterable(zip(*(b.column(c).to_pylist() for c in columns), strict=True) for b in batches)
    out: tuple[list, ...] = ([], [], [], [])
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])
    for _, own in itertools.groupby(rows, key=lambda r: r[0]):
        own = list(own)
        if len(own) < 2:
            continue
        n = {r[1]: r[2] for r in own}
        short, long = [r[1] for r in own if not r[3]], [r[1] for r in own if r[3]]
        if short:
            _, word, _, _, before, after, at_end = own[0]
            prefix, suffix = word[:before], word[len(word) - after :]
            for a, b in _pairs_of(prefix, suffix, at_end, short, long):
                for x, y in ((a, b), (b, a)):
                    for column, value in zip(out, (x, n[x], y, n[y]), strict=True):
                        column.append(value)
        if len(out[0]) >= 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types, strict=True)], schema=schema)
            out = ([], [], [], [])
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types, strict=True)], schema=schema)


def near_words(vocabulary: DataFrame, least: int = 1, most: int = 4000) -> DataFrame:
    """All near pairs of a vocabulary (word, n) of distinct words: word, n, near, near_n, each pair both ways.

    Null words and words of fewer than ``least`` code points have no pairs. A partition of more than ``most`` words is cut in two by the place of the
    edit, and again, down to one place, where a partition holds at most one word for each letter; results do not depend on ``most``.
    """
    size = F.length("word")
    kinds = F.array(
        F.struct(size.alias("m"), F.lit(False).alias("longer")),  # the shorter word of a pair, or one of two equally long ones
        F.struct((size - 1).alias("m"), F.lit(True).alias("longer")),
    )
    rows = (
        vocabulary.where(size >= least)
        .select("word", "n", F.explode(kinds).alias("k"))
        .select("word", "n", "k.*")
        .where(F.col("m") >= least)
        .withColumns({"lo": F.lit(0), "hi": F.col("m") + 1})
    )

    def halved(rows: DataFrame) -> DataFrame:
        """Windows [lo, hi) of places cut in two, and with them the states that words are in before and after."""
        middle = F.expr("(lo + hi) div 2").cast("int")
        windows = F.array(F.struct("lo", middle.alias("hi")), F.struct(middle.alias("lo"), "hi"))
        cut = rows.select("word", "n", "m", "longer", F.explode(F.filter(windows, lambda w: w["lo"] < w["hi"])).alias("w")).select("word", "n", "m", "longer", "w.*")
        after = F.greatest(F.lit(0), F.col("m") - F.col("hi"))
        cut = cut.withColumns({"before": F.col("lo"), "after": after})
        state = F.concat_ws(":", "m", "lo", "hi", F.expr("left(word, before)"), F.expr("right(word, after)"))
        return cut.withColumn("state", state)

    done, rows = [], stored(halved(rows), "windows")
    while True:
        large = rows.where("hi - lo > 1").groupBy(F.xxhash64("state").alias("key")).count().where(F.col("count") > most).select("key")
        large = stored(large, "large")
        if large.isEmpty():
            done.append(rows)
            break
        keyed = rows.withColumn("key", F.xxhash64("state"))
        done.append(keyed.join(large, "key", "left_anti").drop("key").unionByName(keyed.join(large, "key", "left_semi").where("hi - lo <= 1").drop("key")))
        rows = stored(halved(keyed.join(large, "key", "left_semi").where("hi - lo > 1")), "windows")
    parts = done[0]
    for more in done[1:]:
        parts = parts.unionByName(more)
    return (
        parts.select("state", "word", "n", "longer", "before", "after", (F.col("hi") > F.col("m")).alias("at_end"))
        .repartition("state")
        .sortWithinPartitions("state")
        .mapInArrow(_composed, "word string, n long, near string, near_n long")
    )


# ---------------------------------------------------------------- the vocabulary of a corpus


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of texts: (word, n) summed over some rows. U+00C0 to U+00FF are the byte 0xC3 and one more."""
    for batch in batches:
        ids = ["" if x is None else str(x) for x in batch.column(0).to_pylist()]
        for row, _, data, starts in text_slices(batch.column(1), 1 << 23):
            low = lowered(data)
            lead = data == 0xC3
            letter = ((low >= 97) & (low <= 122)) | lead
            letter[1:] |= lead[:-1]
            word, texts, _, _, words = word_ids(low, letter, starts)
            if not len(word):
                continue
            pairs, n = np.unique(texts * len(words) + word, return_counts=True)
            text, word = np.divmod(pairs, len(words))
            spelt = words.to_pylist()
            begun = [zlib.crc32(f"{ids[row + k]}:".encode()) for k in range(len(starts) - 1)]
            hashes = np.array([zlib.crc32(spelt[w], begun[t]) for w, t in zip(word.tolist(), text.tolist(), strict=True)], dtype=np.int64)
            hit = hashes % 97 == 0
            total = np.bincount(word[~hit], weights=n[~hit], minlength=len(words)).astype(np.int64)
            changed = []
            for w, h, k in zip(word[hit].tolist(), hashes[hit].tolist(), n[hit].tolist(), strict=True):
                run = spelt[w].decode()
                at = h % len(run)
                changed.append((run[:at] + run[at + 1 :], k))
            there = np.flatnonzero(total)
            out = pa.concat_arrays([words.take(pa.array(there)).cast(pa.string()), pa.array([w for w, _ in changed], pa.string())])
            counts = pa.array(np.concatenate([total[there], np.array([k for _, k in changed], dtype=np.int64)]))
            longer = pc.greater(pc.utf8_length(out), 0)
            yield pa.RecordBatch.from_arrays([out.filter(longer), counts.filter(longer)], ["word", "n"])


def vocabulary(docs: DataFrame, least: int = 5, times: int = 3) -> DataFrame:
    """The words of all texts: word, n, of at least ``least`` code points and ``times`` occurrences overall.

    Words are maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF), A-Z lower-cased; where 97 divides the crc32 of "doc_id:run", the run's code point at
    crc32 modulo its length is deleted first (typing errors, as the table's contract plants them). A null text has no words, a null
    doc_id counts as empty, repeated rows count each.
    """
    runs = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(_runs, "word string, n long")
    return runs.where(F.length("word") >= least).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def spelling_variants(words: DataFrame, least: int = 5, ratio: int = 2, most: int = 4000) -> DataFrame:
    """Of a vocabulary (word, n): word, form, root, n, n_near, form_n.

    form: the near word of largest n (ties: the smallest in code-point order) if that n is at least ``ratio`` times the word's own, else
    null. root: the last of the forms that follow from the word, the word itself without a form. As n at
    least doubles from form to form, chains are short; they are followed by pointer doubling. An empty vocabulary gives no rows.
    """
    words = stored(words.select("word", "n"), "vocabulary")
    near = near_words(words, least, most)
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near")))
    own = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    all_ = words.join(own, "word", "left")
    strong = -F.col("best.minus") >= ratio * F.col("n")
    out = stored(
        all_.select(
            "word",
            F.when(strong, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(strong, -F.col("best.minus")).alias("form_n"),
        ),
        "forms",
    )
    to = stored(out.where("form IS NOT NULL").select("word", F.col("form").alias("to")), "roots")
    while True:
        further = to.select(F.col("word").alias("to"), F.col("to").alias("next"))
        moved = stored(to.join(further, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "roots")
        dropped(to)
        to = moved.select("word", "to")
        if moved.where("moved").isEmpty():
            break
    return out.join(to, "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(vocabulary(table(spark, sf_dir, "documents")))


#: The crc32 of a text by its table; code points up to U+00FF are one or two bytes.
CRC_TABLE = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS steps)"""


def crc32_sql(text: str) -> str:
    """DuckDB SQL of the unsigned crc32 of a text expression, beside the table ``crc``."""
    points = f"list_transform(string_split({text}, ''), lambda s: unicode(s))"
    data = f"flatten(list_transform({points}, lambda u: CASE WHEN u < 128 THEN [u] ELSE [192 + u // 64, 128 + u % 64] END))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: xor(c // 256, steps[1 + xor(c % 256, b::BIGINT)])), 4294967295)"


ORACLE_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT run, n, {crc32_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM counted, crc),
spelt AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
less AS (SELECT word, n, i, left(word, (i - 1)::INT) || substr(word, (i + 1)::INT) AS rest FROM places),
links AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS top, arg_min(near, (-near_n, near)) AS near FROM links GROUP BY word),
forms AS (SELECT w.word, CASE WHEN top >= 2 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * n THEN top END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS place, form AS next FROM forms
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.next)
SELECT f.word, form, place AS root, n, n_near, form_n FROM forms f JOIN chain c ON c.word = f.word AND c.next IS NULL
"""
