"""Secret scans with a recursive decoding worklist.

The text itself is the first layer. A layer is scanned for secrets, then unwrapped: URL escapes,
Unicode escapes, base64 runs and compressed bytes inside it, which may begin anywhere in a run, become layers of
their own, until no layer is left. A layer that was seen at the same place is not taken again, which ends cycles. Spans
of a deeper layer are mapped back, step by step, to the characters of the text they came from.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillkeep.llm.common import table

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_HINT = re.compile(r"[:=]")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_WORDS = ("passw", "secret", "token", "api")

Span = tuple[str, int, int]
Mapping = Callable[[int, int], tuple[int, int]]


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the three kinds in one layer, leftmost and non-overlapping for each kind."""
    found: list[Span] = []
    if _ASSIGN_HINT.search(text):
        low = text.lower()
        if any(w in low for w in _WORDS) or not text.isascii():
            found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return found


class _Pieces:
    """An unwrapped layer made of kept stretches and decoded characters, with the way back."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.at: list[int] = []  # where a stretch starts in the new layer
        self.src: list[tuple[int, int, bool]] = []  # its span in the old layer; whether characters map one to one
        self.n = 0

    def add(self, text: str, start: int, end: int, same: bool) -> None:
        if text:
            self.at.append(self.n)
            self.src.append((start, end, same))
            self.out.append(text)
            self.n += len(text)

    def back(self, start: int, end: int) -> tuple[int, int]:
        a, b = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        (s, _, same_s), (t, e, same_e) = self.src[a], self.src[b]
        return (s + start - self.at[a] if same_s else s), (t + end - self.at[b] if same_e else e)


_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE_ONE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|\\u\{([0-9A-Fa-f]{1,6})\}|%u([0-9A-Fa-f]{4})|\\([0-3][0-7]{2})")
_UNICODE = re.compile(rf"(?:{re.sub(r'(?<!\\)\((?!\?)', '(?:', _UNICODE_ONE.pattern)})+")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_BREAK = re.compile(r"\r?\n[ \t]*")
_BROKEN = re.compile(r"[A-Za-z0-9+/_-]{16}\r?\n[ \t]*[A-Za-z0-9+/_-]")  # what runs over lines begin with
_RUN = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
_URL_RUN = re.compile(r"(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~+/-])+")
_URL_ONE = re.compile(r"%([0-9A-Fa-f]{2})|.", re.S)
_ESCAPE = r"""\\x[0-9A-Fa-f]{2}|\\[abfnrtv0\\'"]|[ !#-&(-\[\]-~]"""  # printable ASCII stands for itself up to a quote
_BYTES_RUN = re.compile(rf"""(?<=b')(?:{_ESCAPE}|")+|(?<=b")(?:{_ESCAPE}|')+|(?:{_ESCAPE})+""")
_BYTES_ONE = re.compile(r"""\\x([0-9A-Fa-f]{2})|\\([abfnrtv0\\'"])|.""", re.S)
_SHORT = {"a": 7, "b": 8, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11, "0": 0, "\\": 92, "'": 39, '"': 34}


def _url(text: str) -> tuple[str, Mapping] | None:
    """The layer with its %XX escapes decoded as UTF-8; runs that are not UTF-8 keep all but their ASCII escapes."""
    made, last = _Pieces(), 0
    for m in _PERCENT.finditer(text):
        made.add(text[last : m.start()], last, m.start(), True)
        raw, at = bytes.fromhex(m[0].replace("%", "")), m.start()
        k = 0
        while k < len(raw):
            wide = 1 if raw[k] < 0x80 else 2 if raw[k] >> 5 == 6 else 3 if raw[k] >> 4 == 14 else 4 if raw[k] >> 3 == 30 else 1
            try:
                made.add(raw[k : k + wide].decode(), at + 3 * k, at + 3 * (k + wide), False)
            except UnicodeDecodeError:
                wide = 1
                made.add(text[at + 3 * k : at + 3 * k + 3], at + 3 * k, at + 3 * k + 3, True)
            k += wide
        last = m.end()
    if not last:
        return None
    made.add(text[last:], last, len(text), True)
    return "".join(made.out), made.back


def _unicode(text: str) -> tuple[str, Mapping] | None:
    r"""The layer with \uXXXX, \u{X}, %uXXXX, \UXXXXXXXX, \xXX and octal \OOO decoded; surrogate pairs join, lone surrogates stay as they are."""
    made, last = _Pieces(), 0
    for run in _UNICODE.finditer(text):
        made.add(text[last : run.start()], last, run.start(), True)
        high = None
        for m in _UNICODE_ONE.finditer(text, run.start(), run.end()):
            code = int(m[6], 8) if m[6] else int(m[1] or m[2] or m[3] or m[4] or m[5], 16)
            if high is not None:
                if 0xDC00 <= code < 0xE000:
                    made.add(chr(0x10000 + (high[0] - 0xD800) * 1024 + code - 0xDC00), high[1], m.end(), False)
                    high = None
                    continue
                made.add(text[high[1] : high[2]], high[1], high[2], True)
                high = None
            if 0xD800 <= code < 0xDC00:
                high = (code, m.start(), m.end())
            elif 0xDC00 <= code < 0xE000 or code > 0x10FFFF:
                made.add(m[0], m.start(), m.end(), True)
            else:
                made.add(chr(code), m.start(), m.end(), False)
        if high is not None:
            made.add(text[high[1] : high[2]], high[1], high[2], True)
        last = run.end()
    if not last:
        return None
    made.add(text[last:], last, len(text), True)
    return "".join(made.out), made.back


PIECE = 1 << 20
_MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd|\x78[\x01\x5e\x9c\xda]")


def _decoder(head: bytes):  # noqa: ANN202
    """A new decompressor for bytes that begin like gzip, bzip2, xz, zstd or zlib; None if they do not."""
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    if head[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj()
    if len(head) > 1 and head[0] % 16 == 8 and head[0] < 0x80 and not head[1] & 32 and (head[0] * 256 + head[1]) % 31 == 0:
        return zlib.decompressobj()  # of any window
    return None


def _member(d, buf: bytes, src: Iterator[bytes]) -> Iterator[bytes]:  # noqa: ANN001
    """The content of one member or frame in small pieces; returns the bytes read beyond it."""
    bounded = hasattr(d, "needs_input")
    inflate = not bounded and hasattr(d, "copy")
    while True:
        if not buf and (not bounded or d.needs_input) and not (buf := next(src, b"")):
            if inflate and (out := d.flush()):
                yield out
            return b""
        if inflate:
            out = d.decompress(buf, PIECE)
            buf = d.unconsumed_tail
        elif bounded:
            out, buf = d.decompress(buf, PIECE), b""
        else:  # zstd has no limit on what comes out, so little goes in
            out, buf = d.decompress(buf[:1024]), buf[1024:]
        if out:
            yield out
        if d.eof:
            return d.unused_data + buf


def _headed(src: Iterator[bytes], buf: bytes = b"") -> bytes:
    """The first bytes, enough to tell a format by, as far as there are any."""
    while len(buf) < 6 and (more := next(src, b"")):
        buf += more
    return buf


def _members(buf: bytes, src: Iterator[bytes], rest: bool) -> Iterator[bytes]:
    """The content of all members one after the other. Damaged data gives what precedes the damage; with ``rest``, bytes after the last member follow."""
    while (d := _decoder(buf)) is not None:
        try:
            buf = yield from _member(d, buf, src)
        except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
            return
        except Exception as e:  # zstandard has its own class of errors
            if type(e).__name__ == "ZstdError":
                return
            raise
        buf = _headed(src, buf.lstrip(b"\0"))  # padding between members
    if rest and buf:
        yield buf
        yield from src


def _unpacked(raw: bytes, rest: bool = True) -> Iterator[bytes] | None:
    """The content of compressed bytes, unpacked as often as they are compressed, in pieces; None if they are not compressed."""
    buf, src, seen = raw, iter(()), set()
    while _decoder(buf) is not None and (key := hashlib.sha256(buf).digest()) not in seen:
        seen.add(key)
        inner = _members(buf, src, rest)
        first = _headed(inner)
        if not first:
            break
        buf, src = first, inner
    return chain([buf], src) if seen and buf is not raw else None


_OPEN = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-%\\"
_ALIKE = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"0123456789abcdef")


def _open_run(whole: bytes) -> int:
    """Where the encoded run begins that goes on at the end of a stretch; the end, if none does. Letters or digits of one kind encode nothing.

    Lines of one length, as encoders write them, are one run.
    """
    lines = whole[-4096:].split(b"\n")
    wrapped = len(lines) > 3 and len(lines[-2]) == len(lines[-3]) >= 16
    start = len(whole.rstrip(_OPEN + b"\r\n" if wrapped else _OPEN))
    run = whole[start:]
    return len(whole) if any(not run.translate(None, kind) for kind in _ALIKE) else start


def _chunks(pieces: Iterator[bytes], most: int) -> Iterator[bytes]:
    """Stretches of about ``most`` bytes, each of which repeats the end of the one before, from a blank where there is one.

    An encoded run that is open at a stretch's end is repeated as a whole, however long it is, so that none is cut: what is held grows with
    the longest run, not with what is unpacked.
    """
    held: list[bytes] = []
    n, limit = 0, most
    for piece in pieces:
        held.append(piece)
        n += len(piece)
        if n >= limit:
            whole = b"".join(held)
            start = _open_run(whole)
            at = len(whole) - min(PIECE, most // 2)
            if start == 0:  # nothing but one run so far
                held, limit = [whole], 2 * n
                continue
            yield whole
            if start < at:
                near = whole[start:]
            else:
                near = whole[at:]
                near = near[1 + near.find(b"\n") :] if b"\n" in near[: len(near) // 2] else near
                while near and near[0] >> 6 == 2:  # not from the middle of a UTF-8 character
                    near = near[1:]
            held, n = [near], len(near)
            limit = max(most, 2 * n)
    if n:
        yield b"".join(held)


def _texts(raw: bytes, packed: bool) -> Iterator[tuple[str, bool]]:
    """The texts that bytes may stand for, and whether a character is a byte: UTF-8, and UTF-16 where there is a mark or a NUL."""
    try:
        text = raw.decode()
        yield text, text.isascii()
    except UnicodeDecodeError:
        if packed:  # no chance bytes, so other encodings keep their ASCII
            yield raw.decode("utf-8", "replace"), False
    if b"\0" in raw or raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        for k in (0, 1):  # a stretch may start at an odd byte
            for codec in ("utf-16-le", "utf-16-be") if k == 0 or packed else ():
                yield raw[k : len(raw) - (len(raw) - k) % 2].decode(codec, "replace"), False


def _layers(raw: bytes, most: int) -> Iterator[tuple[str, bool]]:
    """(text, whether its characters are the bytes of ``raw``) for each layer that decoded bytes give."""
    pieces = _unpacked(raw)
    if pieces is None:
        yield from _texts(raw, False)
    else:
        for chunk in _chunks(pieces, most):
            for text, _ in _texts(chunk, True):
                yield text, False


def _broken_runs(text: str) -> Iterator[list[re.Match[str]]]:
    """Runs of base64 letters with nothing but a line break between each and the next, the first of 16 letters or more.

    Each run is found once and its neighbours joined by their places, so the time grows with the text.
    """
    lines: list[re.Match[str]] = []
    first = _BROKEN.search(text)
    if not first:
        return
    for m in _RUN.finditer(text):
        follows = lines and (len(lines) > 1 or "=" not in lines[0][0]) and _BREAK.fullmatch(text, lines[-1].end(), m.start())
        if follows and (m.end() == len(text) or text[m.end()].isspace()):
            lines.append(m)
            continue
        if len(lines) > 1:
            yield lines
        lines = [m] if len(m[0].rstrip("=")) >= 16 else []
    if len(lines) > 1:
        yield lines


def _wrapped(text: str) -> Iterator[tuple[int, str]]:
    """Base64 over several lines, as (start, the lines with their breaks): equal lines and a last one that may be shorter.

    Whether the last line belongs to it is not known, so it comes with and, after that, without.
    """
    for lines in _broken_runs(text):
        k = 0
        while k < len(lines) - 1:
            size = len(lines[k + 1][0])
            e = k + 1
            while e < len(lines) and len(lines[e][0]) == size and "=" not in lines[e - 1][0]:
                e += 1
            if e < len(lines) and len(lines[e][0]) < size and "=" not in lines[e - 1][0]:
                yield lines[k].start(), text[lines[k].start() : lines[e].end()]
            if e > k + 1:
                yield lines[k].start(), text[lines[k].start() : lines[e - 1].end()]
            if e > k + 2:
                yield lines[k].start(), text[lines[k].start() : lines[e - 2].end()]
            k = max(e - 1, k + 1)


def _sound(raw: bytes) -> bool:
    try:
        return _decoder(raw) is not None or bool(raw.decode())
    except UnicodeDecodeError:
        return False


def _base64s(text: str, most: int) -> Iterator[tuple[str, Mapping]]:
    """The layers of each base64 run, which may go over line breaks."""
    whole = -1  # start of the last run over lines that is sound: shorter ones from there are parts of it
    runs = ((m.start(), m[0]) for m in _BASE64.finditer(text))
    for start, run in chain(runs, _wrapped(text)) if "\n" in text else runs:
        broken = "\n" in run
        body = ("".join(run.split()) if broken else run).rstrip("=")
        if _plain(body) or broken and start == whole:
            continue
        if not broken:
            yield from _shifted(body, start, most)
        if len(body) % 4 == 1:
            continue
        raw = _decoded(body)
        at = [start + k for k, c in enumerate(run) if not c.isspace() and c != "="] if broken else range(start, start + len(body))
        end = start + len(run)
        if broken and _sound(raw):
            whole = start
        for layer, exact in _layers(raw, most):
            if exact:
                yield layer, lambda a, b, at=at: (at[a // 3 * 4 + a % 3], at[min(len(at), (b - 1) // 3 * 4 + (b - 1) % 3 + 2) - 1] + 1)
            elif layer:
                yield layer, lambda a, b, s=start, e=end: (s, e)


#: What bytes hold that may be or hide a secret; every encoding here is written in ASCII.
_HINT = re.compile(rb"(?i:passw|secret|token|api_?key)|AKIA|[0-9a-f]{24}|%[0-9A-Fa-f]{2}|\\[uUx]|[A-Za-z0-9+/_-]{16}")


def _decoded(body: str) -> bytes:
    return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4))


def _shifted(body: str, start: int, most: int) -> Iterator[tuple[str, Mapping]]:
    """The layers of base64 that begins inside a run, after a path or a name, or is not UTF-8 for what stands around it.

    A byte is a character here, which keeps ASCII; compressed bytes may begin at any byte.
    """
    for off in range(4):
        own = body[off : len(body) - ((len(body) - off) % 4 == 1)]
        raw = _decoded(own)
        if off == 0 and _sound(raw):
            continue  # read from the run's start as it is
        at, end = range(start + off, start + off + len(own)), start + len(body)
        if _HINT.search(raw):
            yield raw.decode("latin-1"), lambda a, b, at=at: (at[a // 3 * 4 + a % 3], at[min(len(at), (b - 1) // 3 * 4 + (b - 1) % 3 + 2) - 1] + 1)
        for m in _MAGIC.finditer(raw):
            pieces = _unpacked(raw[m.start() :], rest=False)
            for chunk in _chunks(pieces, most) if pieces else ():
                for layer, _ in _texts(chunk, True):
                    yield layer, lambda a, b, s=at[m.start() // 3 * 4], e=end: (s, e)


def _url_bytes(text: str) -> Iterator[tuple[bytes, list[int], int]]:
    for m in _URL_RUN.finditer(text):
        if "%" not in m[0]:
            continue
        parts = [(x.start(), int(x[1], 16) if x[1] else 32 if x[0] == "+" else ord(x[0])) for x in _URL_ONE.finditer(m[0])]
        yield bytes(b for _, b in parts), [m.start() + k for k, _ in parts], m.end()


def _escaped_bytes(text: str) -> Iterator[tuple[bytes, list[int], int]]:
    for m in _BYTES_RUN.finditer(text):
        if "\\x" not in m[0]:
            continue
        parts = []
        for x in _BYTES_ONE.finditer(m[0]):
            code = int(x[1], 16) if x[1] else _SHORT[x[2]] if x[2] else ord(x[0])
            parts.append((m.start() + x.start(), code))
        yield bytes(b for _, b in parts), [k for k, _ in parts], m.end()


def _packed_escapes(text: str, most: int) -> Iterator[tuple[str, Mapping]]:
    r"""The layers of compressed bytes that are written with %XX or \xXX escapes, other bytes as they are."""
    for runs in (_url_bytes(text) if "%" in text else (), _escaped_bytes(text) if "\\x" in text else ()):
        for raw, at, end in runs:
            for m in _MAGIC.finditer(raw):
                pieces = _unpacked(raw[m.start() :], rest=False)
                for chunk in _chunks(pieces, most) if pieces else ():
                    for layer, _ in _texts(chunk, True):
                        yield layer, lambda a, b, s=at[m.start()], e=end: (s, e)


def _plain(body: str) -> bool:
    """Runs of lower-case letters, of upper-case letters or of digits alone are words and numbers, hex digits are hex; base64 of 12 bytes is neither."""
    return body.isdigit() or body.isalpha() and (body.islower() or body.isupper() or body.istitle()) or not set(body) - set("0123456789abcdef")


def all_spans(text: str, most: int = 1 << 26) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a text in code points of that text, each sorted by start, kind, end."""
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = sorted(base_spans(text), key=order)
    found = set(base)
    seen: set[tuple[int, int, bytes]] = set()

    def inner_layers(layer: str, back: list[Mapping]) -> Iterator[tuple[str, list[Mapping]]]:
        made: list[tuple[str, Mapping]] = []
        if "%" in layer and (x := _url(layer)):
            made.append(x)
        if ("\\" in layer or "%u" in layer) and (x := _unicode(layer)):
            made.append(x)
        for inner, step in chain(made, _packed_escapes(layer, most), _base64s(layer, most)):
            yield inner, [step, *back]

    # depth first: a layer, or a stretch of one, is done with before the next is unpacked, so only one way down is held
    work = [inner_layers(text, [])]
    while work:
        inner, way = next(work[-1], (None, None))
        if inner is None:
            work.pop()
            continue

        def to_text(a: int, b: int, way: list[Mapping] = way) -> tuple[int, int]:
            for f in way:
                a, b = f(a, b)
            return a, b

        key = (*to_text(0, len(inner)), hashlib.sha256(inner.encode("utf-8", "surrogatepass")).digest()) if inner else None
        if key is None or key in seen:
            continue
        seen.add(key)
        found.update((kind, *to_text(a, b)) for kind, a, b in base_spans(inner))
        work.append(inner_layers(inner, way))
    return base, sorted(found, key=order)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SPANS = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base string, spans string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base", pa.string()), ("spans", pa.string())]
    for batch in batches:
        out: dict[str, list] = {name: [] for name, _ in types}
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            base, spans = all_spans(text.as_py() or "")
            out["doc_id"].append(doc_id)
            for k in KINDS:
                out[f"n_{k}"].append(sum(s[0] == k for s in base))
            out["base"].append(_joined(base))
            out["spans"].append(_joined(spans))
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema(types))


def secret_scan(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base spans by kind, base and all spans as kind:start:end, comma-joined.

    One pass without a shuffle; a text is scanned whole. A null text counts as empty and has no spans, a null doc_id
    stays null, repeated rows give a row each, other columns are not read. A compressed layer
    is unpacked whole; of more than 64 MB, stretches of that size that overlap by up to 1 MB are scanned in turn.
    """
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_scan, SPANS)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secret_scan(table(spark, sf_dir, "documents"))
    return scanned.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans"
    )
