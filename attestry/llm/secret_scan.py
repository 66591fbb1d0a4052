"""Secrets in texts and in every layer that can be decoded out of them."""

from __future__ import annotations

import base64
import binascii
import bz2
import html
import lzma
import re
import zlib
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry.llm.columns import bounded_batches

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_ASSIGNED, LEAST_ACCESS = 6, 20
# A layer that would unpack to more characters is not built; it is counted instead.
MOST_LAYER = 32 << 20

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(
    r"\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|%u[0-9A-Fa-f]{4}"
    r"|U\+[0-9A-Fa-f]{4,6}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};"
)
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
STANDARD = re.compile(r"[A-Za-z0-9+/]{16,}={0,2}")
# a run goes on in the next line; a run too short for BASE64 ends the line before
NEXT_LINE = re.compile(r"[ \t]*\r?\n[ \t]*([A-Za-z0-9+/_-]+={0,2})")
LINE_BEFORE = re.compile(r"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{1,15})[ \t]*\r?\n[ \t]*\Z")
DIGITS = re.compile(r"[0-9A-Fa-f]+")

SPAN = "struct<kind:string,start:bigint,end:bigint,depth:int>"
FOUND = f"struct<spans:array<{SPAN}>,n_layers:int,n_refused:int>"


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the secrets that stand in a text as it is.

    Of each kind the leftmost matches that do not overlap; a match too short is dropped.
    """
    out = []
    low = text.lower()
    if any(name in low for name in NAMES):
        out += [
            ("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED
        ]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


class Layer:
    """A decoded text and where each of its characters came from, down to the original.

    `steps` are (start, end, source start, source end) of the pieces of the text that were
    decoded as one; between them characters moved without change.  `run` is the original range
    of the innermost base64 run the layer descends from, None if there is none.
    """

    def __init__(self, text: str, parent: Layer | None, steps: list[tuple[int, int, int, int]], depth: int):
        self.text, self.parent, self.steps, self.depth = text, parent, steps, depth
        self.starts = [s[0] for s in steps]
        self.run: tuple[int, int] | None = parent.run if parent else None

    def _edge(self, at: int, right: bool) -> int:
        """Where in the parent the character at `at` begins, or ends."""
        k = bisect_right(self.starts, at) - 1
        if k < 0:
            return at + right
        start, end, source, source_end = self.steps[k]
        if at < end:
            return source_end if right else source
        return source_end + (at - end) + right

    def original(self, start: int, end: int) -> tuple[int, int]:
        """The range of the original text that range start:end of this layer was made from."""
        layer = self
        while layer.parent is not None:
            start, end = layer._edge(start, False), layer._edge(end - 1, True)
            layer = layer.parent
        return start, end


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every match that decodes put in its place."""
    out, steps, at, made = [], [], 0, 0
    for m in pattern.finditer(layer.text):
        got = decode(m.group())
        if got is None:
            continue
        out.append(layer.text[at : m.start()])
        made += m.start() - at
        steps += [(made + a, made + b, m.start() + c, m.start() + d) for a, b, c, d in got[1]]
        out.append(got[0])
        made, at = made + len(got[0]), m.end()
    if not steps:
        return None
    out.append(layer.text[at:])
    return Layer("".join(out), layer, steps, layer.depth + 1)


def _percent(run: str) -> tuple[str, list] | None:
    raw = bytes.fromhex(run.replace("%", ""))
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        text = raw.decode("latin-1")
        return text, [(k, k + 1, 3 * k, 3 * k + 3) for k in range(len(text))]
    steps, at = [], 0
    for k, c in enumerate(text):
        size = 3 * len(c.encode())
        steps.append((k, k + 1, at, at + size))
        at += size
    return text, steps


def _escape(run: str) -> tuple[str, list] | None:
    if run[0] == "&":
        text = html.unescape(run)
    else:
        # the prefix is one of \u \U \x %u U+, and none of its marks is a digit of the number
        code = int(DIGITS.search(run, 2).group(), 16)
        if code > 0x10FFFF or 0xD800 <= code < 0xE000:
            return None
        text = chr(code)
    return text, [(0, len(text), 0, len(run))]


class TooLarge(Exception):
    pass


def _stream(raw: bytes):
    """A decompressor for the stream that `raw` begins with, or None."""
    if raw[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if len(raw) > 2 and raw[0] == 0x78 and (raw[0] * 256 + raw[1]) % 31 == 0:
        return zlib.decompressobj()
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if raw[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


def _unpacked(raw: bytes, most: int) -> bytes | None:
    """What the streams that follow each other in `raw` hold, or None; never more than `most` bytes.

    Streams before a faulty one stay.
    """
    out, size = [], 0
    while (stream := _stream(raw)) is not None:
        try:
            got = stream.decompress(raw, most + 1 - size)
        except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
            break
        out.append(got)
        size += len(got)
        if size > most:
            raise TooLarge
        if not stream.eof:
            break
        # streams may be padded with zeros
        raw = stream.unused_data.lstrip(b"\0")
    return b"".join(out) if out else None


def _readable(raw: bytes) -> str:
    """Bytes as text: UTF-16 by its mark, UTF-8, or else a character for each byte."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return raw.decode("utf-16", "replace")
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _opened(run: str, most: int) -> str | None:
    """The text in a base64 run, unpacked as often as it is compressed."""
    body = run.rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        raw = base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None
    # an archive may hold itself, or one that holds it
    seen = {raw}
    while (inner := _unpacked(raw, most)) is not None and inner not in seen:
        seen.add(inner)
        raw = inner
    return _readable(raw) or None


def _wrapped(text: str, m: re.Match) -> tuple[list[tuple[int, str]], int]:
    """The runs that go on from a match over line ends, as (start, run), and where the last ends.

    Lines after the first have one width; a shorter one, padding or other text ends the run.
    The first may follow other text in its line, and a shorter run that ends the line before
    may belong to it.
    """
    parts = [(m.start(), m.group())]
    at, width = m.end(), 0
    while not parts[-1][1].endswith("=") and (n := NEXT_LINE.match(text, at)):
        size = len(n[1].rstrip("="))
        if width and size > width:
            break
        parts.append((n.start(1), n[1]))
        at, more, width = n.end(), size == (width or size), width or size
        if not more:
            break
    if (n := LINE_BEFORE.search(text, max(0, m.start() - 64), m.start())) and len(parts) + len(n[1]) > 1:
        parts.insert(0, (n.start(1), n[1]))
    return parts, at


def _runs(text: str):
    """(start, end, run) of what may be base64.

    Whole runs of both alphabets, the parts between - and _, and runs that are wrapped over
    lines: with and without a first and a last piece of another width, as these may be other
    words.  The lines of a wrapped run are runs of their own, too.
    """
    upto = 0
    for m in BASE64.finditer(text):
        run = m.group()
        yield m.start(), m.end(), run
        if "-" in run or "_" in run:
            for part in STANDARD.finditer(run):
                yield m.start() + part.start(), m.start() + part.end(), part.group()
        if m.start() < upto:
            continue
        parts, upto = _wrapped(text, m)
        count, padded = len(parts), parts[-1][1].endswith("=")
        firsts = (0, 1) if count > 2 and len(parts[0][1]) != len(parts[1][1]) else (0,)
        lasts = (count, count - 1) if not padded and len(parts[-1][1]) != len(parts[-2:][0][1]) else (count,)
        for first in firsts:
            for last in lasts:
                if last - first > 1:
                    end = parts[last - 1][0] + len(parts[last - 1][1])
                    yield parts[first][0], end, "".join(p[1] for p in parts[first:last])


def find_secrets(text: str, most: int = MOST_LAYER) -> tuple[list[tuple[str, int, int, int]], int, int]:
    """((kind, start, end, depth) of all secrets, layers decoded, layers refused).

    A worklist holds the layers still to scan.  Each is scanned as a text, then decoded: the
    URL escapes of the whole layer, its Unicode escapes, and each base64 run by itself, which
    may be compressed.  A layer whose text was seen before in the same run of the original is
    not taken again, so the list ends even where layers decode into each other.  Spans are
    mapped back to the original.
    """
    spans: dict[tuple[str, int, int], int] = {}
    work, seen, refused = [Layer(text, None, [], 0)], {(None, text)}, 0
    layers = -1
    while work:
        layer = work.pop()
        layers += 1
        for kind, start, end in plain_spans(layer.text):
            key = (kind, *layer.original(start, end))
            spans[key] = min(spans.get(key, layer.depth), layer.depth)
        made = []
        if "%" in layer.text:
            made.append(_replaced(layer, PERCENT, _percent))
        if "\\" in layer.text or "&#" in layer.text or "U+" in layer.text or "%u" in layer.text:
            made.append(_replaced(layer, ESCAPE, _escape))
        for start, end, run in _runs(layer.text):
            try:
                inner = _opened(run, most)
            except TooLarge:
                refused += 1
                continue
            if inner is not None:
                new = Layer(inner, layer, [(0, len(inner), start, end)], layer.depth + 1)
                new.run = new.original(0, len(inner))
                made.append(new)
        for new in made:
            # a layer is its text and its run: equal runs elsewhere are layers of their own
            if new is not None and (new.run, new.text) not in seen:
                seen.add((new.run, new.text))
                work.append(new)
    order = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return [(*s, spans[s]) for s in order], layers, refused


def secrets_in(text: Column, most: int = MOST_LAYER) -> Column:
    """struct<spans, n_layers, n_refused> of a text column.

    Spans have kind, start, end (code points, end exclusive) and the depth of the layer they
    were found in: 0 is the text itself.  They are sorted by start and kind.  Null is empty.
    A layer that would unpack to more than `most` bytes is counted in n_refused.
    """

    bounded_batches()

    @F.arrow_udf(FOUND)
    def scan(texts: pa.Array) -> pa.Array:
        out = []
        for k in range(len(texts)):
            spans, layers, refused = find_secrets(texts[k].as_py() or "", most)
            rows = [{"kind": a, "start": b, "end": c, "depth": d} for a, b, c, d in spans]
            out.append({"spans": rows, "n_layers": layers, "n_refused": refused})
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("depth", pa.int32())])
        return pa.array(out, pa.struct([("spans", pa.list_(span)), ("n_layers", pa.int32()), ("n_refused", pa.int32())]))

    return scan(text.cast("string"))


def joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
