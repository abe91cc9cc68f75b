r"""Secrets in texts, also below layers of URL, Unicode, base64 and compressed encoding.

Every text starts a worklist. A layer is scanned for secrets, then every encoded part in it
becomes a further layer, until no layer has anything left to decode. Decoded bytes are a step of
their own: what is compressed in them is unpacked to bytes, which may be compressed again. A layer
that was seen at the same place with the same content is not entered again, which ends cycles (an
archive that holds itself). Every character of a layer knows which characters of the original text it came from, so
a secret found in any layer is reported by its place in the original.

Escapes of escapes are entered layer by layer to a depth of :data:`DEEP`; what is nested deeper at
one place is decoded in one pass, so that the cost grows with the length of the text alone.

How places are mapped: escapes character by character; base64 by the characters that hold the
bits of the secret; compressed data has no finer place than the whole compressed part.

Defined results: null counts as empty and has no spans. Rows are scanned one by one: repeated
rows give repeated results, a null id stays null, other columns are not read. A kind found twice
at one place (also by two ways of decoding) is one span. One limit guards against decompression
bombs: ``max_layer_chars`` for one decoded layer; ``n_unopened`` counts the parts beyond it, and
redaction removes each such part as a whole.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from dripline.llm.support import ship, strings

# The kinds of secret, in the order in which spans of one start are listed.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
ASSIGN_VALUE_CHARS = 8
# The least length is part of these two: a shorter run has no longer match inside it.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex")
# Of a part that was not opened, in redacted texts.
UNOPENED = "unopened"

MAX_LAYER_CHARS = 1 << 24

# ASCII-only spelling of the keywords, to leave most texts after one look.
_KEYWORD = re.compile(r"pass|secret|token|api_?key", re.IGNORECASE | re.ASCII)

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the secrets that stand in a text itself."""
    found = []
    if _KEYWORD.search(text):
        for match in ASSIGN.finditer(text):
            if match.end(2) - match.start(2) >= ASSIGN_VALUE_CHARS:
                found.append((match.start(), 0, match.end()))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


# ------------------------------------------------------------------ layers


@dataclass
class Layer:
    """A text and, for each of its characters, the range of the original it came from."""

    text: str
    low: np.ndarray | None
    high: np.ndarray | None
    path: tuple[str, ...] = ()

    def range(self, start: int, end: int) -> tuple[int, int]:
        """The range of the original that characters start to end of this layer came from."""
        if self.low is None:
            return start, end
        return int(self.low[start:end].min()), int(self.high[start:end].max())

    def ranges(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        if self.low is None:
            own = np.arange(start, end, dtype=np.int64)
            return own, own + 1
        return self.low[start:end], self.high[start:end]


@dataclass
class Data:
    """Decoded bytes and, for each of them, the range of the original it came from."""

    data: bytes
    low: np.ndarray
    high: np.ndarray
    path: tuple[str, ...]

    @classmethod
    def at_one_place(cls, data: bytes, place: tuple[int, int], path: tuple[str, ...]) -> Data:
        low, high = (np.broadcast_to(np.int64(x), len(data)) for x in place)
        return cls(data, low, high, path)

    def range(self, start: int, end: int) -> tuple[int, int]:
        return int(self.low[start:end].min()), int(self.high[start:end].max())


def _text_of(data: bytes, low: np.ndarray, high: np.ndarray, path: tuple[str, ...]) -> Layer:
    """Bytes with the range of each, as a text: UTF-8, or one character a byte if it isn't that."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return Layer(data.decode("latin-1"), low, high, path)
    if len(text) == len(data):
        return Layer(text, low, high, path)
    values = np.frombuffer(data, dtype=np.uint8)
    first = np.flatnonzero((values & 0xC0) != 0x80)
    return Layer(
        text, np.minimum.reduceat(low, first), np.maximum.reduceat(high, first), path
    )


class Unopened(Exception):
    """A part whose content is longer than the limit."""


@dataclass
class TooLong:
    """The range of the original of a part that was not opened."""

    low: int
    high: int


@dataclass(frozen=True)
class Format:
    """A compressed format: how its data begins, and a reader of one member (stream or frame).

    ``block`` is how many bytes a reader is given at once. A reader that cannot bound what it
    returns gets few, so that a bomb fills no memory.
    """

    name: str
    starts: tuple[bytes, ...]
    reader: Callable[[], object]
    block: int = 1 << 16
    bounded: bool = True


# The first bytes of compressed data, by format.
COMPRESSED = (
    Format("gzip", (b"\x1f\x8b\x08",), lambda: zlib.decompressobj(31)),
    Format(
        "zlib",
        (b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda"),
        lambda: zlib.decompressobj(15),
    ),
    Format("bzip2", (b"BZh",), bz2.BZ2Decompressor),
    Format("xz", (b"\xfd7zXZ\x00",), lzma.LZMADecompressor),
    Format(
        "zstd",
        (b"\x28\xb5\x2f\xfd",),
        lambda: zstandard.ZstdDecompressor().decompressobj(),
        256,
        False,
    ),
)
# What the libraries raise for damaged data. Anything else is a fault of the installation.
DAMAGED = (zlib.error, lzma.LZMAError, zstandard.ZstdError, OSError, EOFError, ValueError)

_FORMATS = {start: form for form in COMPRESSED for start in form.starts}
_PACKED = re.compile(b"|".join(re.escape(start) for start in _FORMATS))
_ZEROS = re.compile(rb"\x00*")
_SKIPPED_FRAME = re.compile(rb"[\x50-\x5f]\x2a\x4d\x18(....)", re.DOTALL)


def _member(form: Format, data: memoryview, at: int, room: int) -> tuple[bytes, int, bool]:
    """Content of the member that begins at a place, where it ends, and whether it is whole.

    Of a damaged or cut member it is what came before that.
    """
    stream = form.reader()
    out, size = [], 0
    while not stream.eof and at < len(data):
        block = data[at : at + form.block]
        at += len(block)
        try:
            more = (room + 1 - size,) if form.bounded else ()
            out.append(stream.decompress(block, *more))
        except DAMAGED:
            return b"".join(out), at, False
        size += len(out[-1])
        if size > room:
            raise Unopened
    return b"".join(out), at - len(stream.unused_data), stream.eof


def _next_member(form: Format, data: bytes, at: int) -> int | None:
    """Where a further member of the same format begins: at once, or behind what may stand
    between members (zeros as padding, frames that zstd readers skip)."""
    while form.name == "zstd" and (frame := _SKIPPED_FRAME.match(data, at)):
        at = frame.end() + int.from_bytes(frame[1], "little")
    if form.name in ("gzip", "xz"):
        at = _ZEROS.match(data, at).end() if at < len(data) else at
    return at if data.startswith(form.starts, at) else None


def decompressed(data: bytes, form: Format, at: int, limit: int) -> tuple[bytes, int, bool]:
    """Content of the compressed bytes that begin at a place, all members joined; where they end,
    and whether the last member is whole."""
    view, out, size, end, whole = memoryview(data), [], 0, at, True
    while at is not None:
        content, end, whole = _member(form, view, at, limit - size)
        out.append(content)
        size += len(content)
        at = _next_member(form, data, end) if whole else None
    return b"".join(out), end, whole


PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(
    r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})"
    r"|&\#([0-9]{1,7});|&\#[xX]([0-9A-Fa-f]{1,6});"
)
# Base64 goes on over line breaks (also written as escapes), with the indentation, quote marks and
# signs of continuation, citation or comment around them. Lines may have any width: whatever does
# not belong to the data only stands before or behind it, as letters in front of a run do.
_DIGIT = "[A-Za-z0-9+/_-]"
_BREAK = (
    r"""(?:["'`]?[\x20\t]*[,.\\]?|["'`][\x20\t]*\+|[\x20\t]\+)[\x20\t]*"""
    r"""(?:\r?\n|(?:\\r)?\\n)[\x20\t>\#*|]*(?:(?://|--?)[\x20\t]+)?["'`]?"""
)
BASE64_BREAK = re.compile(_BREAK)
BASE64 = re.compile(
    rf"(?<!{_DIGIT})(?:{_DIGIT}{{16,}}+(?:(?>{_BREAK}){_DIGIT}++)*+"
    rf"|{_DIGIT}++(?:(?>{_BREAK}){_DIGIT}++)++)={{0,2}}"
)
_URL_SAFE = str.maketrans("-_", "+/")


def unpacked(part: Data, limit: int) -> Iterator[Data | TooLong]:
    """The contents of what is compressed in some bytes, wherever it begins.

    Where a part that is too long ends is not known, so it counts to the end of the bytes.

    The search goes on behind what was unpacked whole. Bytes that only look like a beginning, and
    damaged or cut data, may hide a further beginning.
    """
    at = 0
    while found := _PACKED.search(part.data, at):
        form, start = _FORMATS[found[0]], found.start()
        at = start + 1
        try:
            content, end, whole = decompressed(part.data, form, start, limit)
        except Unopened:
            yield TooLong(*part.range(start, len(part.data)))
            continue
        if whole:
            at = end
        if content:
            yield Data.at_one_place(content, part.range(start, end), (*part.path, form.name))


def _replaced(
    layer: Layer, name: str, parts: list[tuple[int, int, str, np.ndarray, np.ndarray]]
) -> Layer:
    """The layer with its parts (start, end, new text, ranges of its characters) put in."""
    texts, lows, highs, at = [], [], [], 0
    for start, end, text, low, high in parts:
        texts += [layer.text[at:start], text]
        a, b = layer.ranges(at, start)
        lows += [a, low]
        highs += [b, high]
        at = end
    texts.append(layer.text[at:])
    a, b = layer.ranges(at, len(layer.text))
    return Layer(
        "".join(texts), np.concatenate([*lows, a]), np.concatenate([*highs, b]), (*layer.path, name)
    )


# Escaped bytes leave many characters as they are: a run of them is read together with its escapes.
_URL_RUN = re.compile(r"[\x21-\x7e]+")
_PRINTED_RUN = re.compile(r"[\x20-\x7e]+")
_URL_BYTE = re.compile(r"%([0-9A-Fa-f]{2})")
_SHORT = {"a": 7, "b": 8, "t": 9, "n": 10, "v": 11, "f": 12, "r": 13, "0": 0}
_UNICODE_BYTE = re.compile(ESCAPE.pattern + r"|\\([abtnvfr0\\'\"/])")


def _url_bytes(run: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, byte) of each escape of a run."""
    for match in _URL_BYTE.finditer(run):
        yield match.start(), match.end(), int(match[1], 16)


def _unicode_bytes(run: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, byte) of each escape of a run, short ones like \\n too; -1 for no byte."""
    for match in _UNICODE_BYTE.finditer(run):
        group = match.lastindex
        if group == 7:
            code = _SHORT.get(match[7], ord(match[7]))
        else:
            code = int(match[group], 10 if group == 5 else 16)
        yield match.start(), match.end(), code if code < 256 else -1


def _escaped_bytes(
    layer: Layer,
    name: str,
    runs: re.Pattern,
    mark: str,
    escapes: Callable[[str], Iterator[tuple[int, int, int]]],
) -> Iterator[Data]:
    """The bytes of each run of plain characters and escapes that may hold compressed data."""
    for match in runs.finditer(layer.text):
        run = match[0]
        if mark not in run:
            continue
        data = np.frombuffer(run.encode("ascii"), dtype=np.uint8).astype(np.int16)
        kept = np.ones(len(data), dtype=bool)
        last = np.arange(1, len(data) + 1)
        for start, end, byte in escapes(run):
            data[start], last[start] = byte, end
            kept[start + 1 : end] = False
        first = np.flatnonzero(kept)
        data, last = data[first], last[first]
        low, high = layer.ranges(match.start(), match.end())
        # A range of the original for each byte, of all characters that its escape has.
        low, high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
        # What is no byte ends a piece.
        edges = [-1, *np.flatnonzero(data < 0).tolist(), len(data)]
        for a, b in zip(edges, edges[1:]):
            piece = data[a + 1 : b].astype(np.uint8)
            contents = [piece]
            if name == "url":
                # Forms write a space as a bare plus sign.
                bare = last[a + 1 : b] - first[a + 1 : b] == 1
                contents.append(np.where(bare & (piece == ord("+")), np.uint8(32), piece))
            for content in {x.tobytes() for x in contents}:
                if _PACKED.search(content):
                    yield Data(content, low[a + 1 : b], high[a + 1 : b], (*layer.path, name))


def percent_layers(layer: Layer) -> Iterator[Layer | Data]:
    if "%" not in layer.text:
        return
    parts = []
    for match in PERCENT.finditer(layer.text):
        data = bytes.fromhex(match[0].replace("%", ""))
        low, high = layer.ranges(match.start(), match.end())
        low, high = low.reshape(-1, 3).min(axis=1), high.reshape(-1, 3).max(axis=1)
        inner = _text_of(data, low, high, ())
        parts.append((match.start(), match.end(), inner.text, inner.low, inner.high))
    if parts:
        yield _replaced(layer, "url", parts)
        yield from _escaped_bytes(layer, "url", _URL_RUN, "%", _url_bytes)


def unicode_layers(layer: Layer) -> Iterator[Layer | Data]:
    if "\\" not in layer.text and "&#" not in layer.text:
        return
    parts = []
    for match in ESCAPE.finditer(layer.text):
        group = match.lastindex
        code = int(match[group], 10 if group == 5 else 16)
        if code > 0x10FFFF:
            continue
        low, high = layer.range(match.start(), match.end())
        parts.append((match.start(), match.end(), code, low, high))
    joined, i = [], 0
    while i < len(parts):
        start, end, code, low, high = parts[i]
        if 0xD800 <= code < 0xDC00 and i + 1 < len(parts):
            _, next_end, low_code, next_low, next_high = parts[i + 1]
            if parts[i + 1][0] == end and 0xDC00 <= low_code < 0xE000:
                code = 0x10000 + ((code - 0xD800) << 10) + (low_code - 0xDC00)
                end, low, high = next_end, min(low, next_low), max(high, next_high)
                i += 1
        joined.append((start, end, chr(code), np.array([low]), np.array([high])))
        i += 1
    if joined:
        yield _replaced(layer, "unicode", joined)
        for mark in ("\\", "&#"):
            yield from _escaped_bytes(layer, "unicode", _PRINTED_RUN, mark, _unicode_bytes)


def base64_layers(layer: Layer) -> Iterator[Data]:
    """Layers of each base64-like run. Letters before it may hide where it begins, so the run is
    read from its first four characters on; what gives neither text nor data finds nothing."""
    for match in BASE64.finditer(layer.text):
        run = match[0].rstrip("=")
        if len(run) < 16:
            continue
        # Where the parts between line breaks are.
        edges = [0]
        for gap in BASE64_BREAK.finditer(run):
            edges += gap.span()
        edges.append(len(run))
        parts = list(zip(edges[::2], edges[1::2]))
        letters = "".join(run[a:b] for a, b in parts).translate(_URL_SAFE)
        place = np.concatenate([np.arange(a, b) for a, b in parts])
        low, high = layer.ranges(match.start(), match.end())
        for skip in range(4):
            body = letters[skip:]
            body = body[: len(body) - (len(body) % 4 == 1)]
            if len(body) < 16:
                break
            try:
                data = base64.b64decode(body + "=" * (-len(body) % 4))
            except binascii.Error:
                continue
            if not _worth(data):
                continue
            bits = np.arange(len(data), dtype=np.int64) * 8
            first = place[skip + bits // 6]
            last = place[skip + (bits + 7) // 6]
            yield Data(data, low[first], high[last], (*layer.path, "base64"))


def _worth(data: bytes) -> bool:
    """Whether decoded bytes can be a layer: with something compressed in them, or with a run of
    plain characters that is long enough for the shortest secret or a further layer."""
    return _PACKED.search(data) is not None or _PLAIN_RUN.search(data) is not None


_PLAIN_RUN = re.compile(rb"[\x20-\x7e\t\r\n]{12,}")

DECODERS = (percent_layers, unicode_layers, base64_layers)

# Layers of escapes in a row after which the rest of them is decoded in one step. Each layer costs
# the length of its text, so that chains such as %2525...41 would cost the square of theirs.
DEEP = 8
_ESCAPES = {"url", "unicode", "escapes"}
_ENDS_ESCAPE = set("0123456789ABCDEFabcdef};")
_ASCII_ESCAPE = re.compile(
    r"(?:%|\\x|\\u00|\\U000000|\\u\{0{0,4})([0-7][0-9A-Fa-f])\}?\Z"
    r"|\\u\{0{0,5}([0-9A-Fa-f])\}\Z|&\#[xX]0{0,5}([0-7]?[0-9A-Fa-f]);\Z"
    r"|&\#(0{0,6}[0-9]|0{0,5}[0-9]{2}|0{0,4}1[0-2][0-9]);\Z"
)


def flattened(layer: Layer) -> Layer | None:
    """The layer with every escape of an ASCII character decoded, also those that arise by that;
    None if there are none. One pass: what is decoded joins what stands before it."""
    low, high = (x.tolist() for x in layer.ranges(0, len(layer.text)))
    out: list[str] = []
    lows: list[int] = []
    highs: list[int] = []
    changed = False
    for character, first, last in zip(layer.text, low, high, strict=True):
        out.append(character)
        lows.append(first)
        highs.append(last)
        while out[-1] in _ENDS_ESCAPE:
            tail = "".join(out[-12:])
            match = _ASCII_ESCAPE.search(tail)
            if match is None or ("{" in match[0]) != match[0].endswith("}"):
                break
            n = len(match[0])
            digits = match[match.lastindex]
            lows[-n:] = [min(lows[-n:])]
            highs[-n:] = [max(highs[-n:])]
            out[-n:] = [chr(int(digits, 10 if match.lastindex == 4 else 16))]
            changed = True
    if not changed:
        return None
    return Layer("".join(out), np.array(lows), np.array(highs), (*layer.path, "escapes"))


def _inner(item: Layer | Data, limit: int) -> Iterator[Layer | Data | TooLong]:
    """What one step of decoding makes of a layer or of decoded bytes."""
    if isinstance(item, Layer):
        flat = None
        if len(item.path) >= DEEP and _ESCAPES.issuperset(item.path[-DEEP:]):
            flat = flattened(item)
        if flat is not None:
            yield flat
        for decoder in DECODERS if flat is None else (base64_layers,):
            yield from decoder(item)
        return
    yield from unpacked(item, limit)
    if _PLAIN_RUN.search(item.data):
        yield _text_of(item.data, item.low, item.high, item.path)


def scan(text: str, limit: int = MAX_LAYER_CHARS) -> tuple[list[Span], list[Span], dict, int]:
    """Spans of the text itself, all spans, the path of each added one, parts not opened."""
    base, spans, paths, unopened = scan_places(text, limit)
    return base, spans, paths, len(unopened)


def scan_places(
    text: str, limit: int = MAX_LAYER_CHARS
) -> tuple[list[Span], list[Span], dict, list[tuple[int, int]]]:
    """What :func:`scan` gives, with the places of the parts not opened instead of their number."""
    base = base_spans(text)
    paths: dict[Span, tuple[str, ...]] = {span: () for span in base}
    unopened: list[tuple[int, int]] = []
    worklist: list[Layer | Data] = [Layer(text, None, None)]
    seen: set[tuple[type, int, int, bytes]] = set()
    while worklist:
        item = worklist.pop()
        for inner in _inner(item, limit):
            if isinstance(inner, TooLong):
                unopened.append((inner.low, inner.high))
                continue
            is_text = isinstance(inner, Layer)
            content = inner.text.encode("utf-8", "surrogatepass") if is_text else inner.data
            if not content:
                continue
            low, high = int(inner.low.min()), int(inner.high.max())
            key = (type(inner), low, high, hashlib.sha256(content).digest())
            if key in seen:
                continue
            seen.add(key)
            if is_text:
                for start, kind, end in base_spans(inner.text):
                    first, last = inner.range(start, end)
                    paths.setdefault((first, kind, last), inner.path)
            worklist.append(inner)
    return base, sorted(paths), paths, unopened


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _scan_batches(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: dict[str, list] = {name: [] for name in _COLUMNS}
        for text in strings(batch.column("text")):
            base, spans, paths, unopened = scan(text, limit)
            counts = [0, 0, 0]
            for _, kind, _ in base:
                counts[kind] += 1
            columns["n_assign"].append(counts[0])
            columns["n_access"].append(counts[1])
            columns["n_hex"].append(counts[2])
            columns["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
            columns["spans"].append(written(spans))
            columns["found"].append(
                [
                    {
                        "kind": KINDS[kind],
                        "start": start,
                        "end": end,
                        "layers": ">".join(paths[start, kind, end]),
                    }
                    for start, kind, end in spans
                ]
            )
            columns["n_unopened"].append(unopened)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(columns[n], t) for n, t in _COLUMNS.items())],
            names=["doc_id", *_COLUMNS],
        )


_FOUND = pa.struct(
    [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("layers", pa.string())]
)
_COLUMNS = {
    "n_assign": pa.int64(),
    "n_access": pa.int64(),
    "n_hex": pa.int64(),
    "base_sha256": pa.string(),
    "spans": pa.string(),
    "found": pa.list_(_FOUND),
    "n_unopened": pa.int64(),
}
_SCHEMA = (
    "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
    "found array<struct<kind: string, start: long, end: long, layers: string>>, n_unopened long"
)


def find_secrets(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    max_layer_chars: int = MAX_LAYER_CHARS,
) -> DataFrame:
    """One row per document: counts, spans and digests as the module says.

    ``found`` has every span with the layers it lay under, ``spans`` the same as text.
    """
    ship(documents.sparkSession)
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(
        lambda batches: _scan_batches(batches, max_layer_chars), f"doc_id {id_type}, {_SCHEMA}"
    )


def redacted(text: str, mark: str = "[{kind}]", limit: int = MAX_LAYER_CHARS) -> str:
    """A text with every secret replaced by a mark that names its kind.

    Where spans touch or overlap, their union becomes one mark, named after the first of them. A
    part that was too long to be opened may hold secrets: the whole of it becomes a mark, of the
    kind :data:`UNOPENED`.
    """
    _, spans, _, unopened = scan_places(text, limit)
    places = [(start, KINDS[kind], end) for start, kind, end in spans]
    if unopened:
        places = sorted([*places, *((low, UNOPENED, high) for low, high in unopened)])
    out, at, union = [], 0, []
    for start, kind, end in places:
        if union and start < union[-1][2]:
            union[-1] = (union[-1][0], union[-1][1], max(end, union[-1][2]))
        else:
            union.append((start, kind, end))
    for start, kind, end in union:
        out += [text[at:start], mark.format(kind=kind)]
        at = end
    return "".join([*out, text[at:]])


def redact(documents: DataFrame, text: str = "text") -> DataFrame:
    """The documents with all secrets in one column replaced; null stays null.

    Works row by row on all columns, whatever their names. Rows are never dropped.
    """
    ship(documents.sparkSession)

    @F.pandas_udf("string")
    def without_secrets(texts):
        return texts.map(lambda x: None if x is None else redacted(x))

    return documents.withColumn(text, without_secrets(F.col(text)))
