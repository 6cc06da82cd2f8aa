"""Secrets in texts and in what texts encode: a worklist of decoded layers.

Every text is the first layer. Each layer is scanned, then searched for URL escapes,
Unicode and character escapes, base64 and compressed data; what decodes becomes a layer of
its own, until nothing new appears. A layer seen before at the same place is not entered
again, which ends cycles (also of data that unpacks to itself) but leaves repeated data its
findings at every place. Every layer knows which code points of the
text each of its own came from, so what is found deep inside is reported where it lies in
the text.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import html
import lzma
import re
import zlib
from bisect import bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate, chain
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex")
# The patterns of the three kinds of secret.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")

ESCAPED = re.compile(r"[^\s%]*%[0-9A-Fa-f]{2}\S*")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&(?:quot|apos|amp|lt|gt|equals|colon);")
UNICODE_TOKEN = re.compile(r"\S*(?:\\[ux]|&[#a-z])\S*")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
BREAK = re.compile(r"\r?\n[ \t]*")
PIECE = re.compile(r"[A-Za-z0-9+]{16,}={0,2}")
# How the streams of PACKERS begin in base64.
PACKED = re.compile(r"H4sI|Qlpo|/Td6WF|e(?:A[E-H]|F[4-7]|J[w-z]|N[o-r])")
NOT_TEXT = re.compile(r"[^\t\n\r\x20-\x7e\x80-\U0010ffff]")
SOME_TEXT = re.compile(rb"[\t\n\r\x20-\x7e]{14}")  # no secret and nothing that encodes one is shorter
TO_STANDARD = str.maketrans("-_", "+/")
MAX_LAYER = 64 << 20  # unpacked bytes worked on at a time; larger data is scanned in pieces
STEP = 1 << 20
# Characters that no secret and nothing that encodes one can hold: where pieces are cut.
STOP = re.compile(rb"[\x00-\x08\x0b\x0c\x0e-\x1f!$()*,<>?@\[\]^`|~\x7f]")
OVERLAP = 1 << 20  # of pieces without any of these

FINDINGS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("layers", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("value", T.StringType()),
        ]
    )
)
ARROW_FINDINGS = pa.list_(
    pa.struct([("kind", pa.string()), ("layers", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])
)


class Segment(NamedTuple):
    """Code points from ``at`` on: either each comes from one of the range, or all from the whole range."""

    at: int
    start: int
    end: int
    each: bool


def located(segments: list[Segment], start: int, end: int) -> tuple[int, int]:
    first = segments[bisect_right(segments, start, key=lambda s: s.at) - 1]
    last = segments[bisect_right(segments, end - 1, key=lambda s: s.at) - 1]
    return first.start + (start - first.at) * first.each, last.start + end - last.at if last.each else last.end


class Layer(NamedTuple):
    text: str
    names: tuple[str, ...]
    origin: list[Segment] | None  # of its code points in the document; None: the whole range
    range: tuple[int, int]
    steps: list[Segment] | None = None  # of a respelled layer: its code points in the layer it comes from,
    known: frozenset = frozenset()  # and the matches (start, end, kind) there

    def place(self, start: int, end: int) -> tuple[int, int]:
        if not self.names:
            return start, end
        return self.range if self.origin is None else located(self.origin, start, end)


def base_matches(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the plain secrets of a text, per kind leftmost and not overlapping."""
    found = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(w in low for w in WORDS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return found + [(*m.span(), "hex") for m in HEX.finditer(text)]


def scan_text(text: str) -> list[dict]:
    """All findings of one text, by start, then kind, then layer; ``layers`` is empty for plain ones."""
    found: dict[tuple, dict] = {}
    times: Counter = Counter()  # how often each is in one layer
    first = Layer(text, (), None, (0, len(text)))
    # Depth first, each layer made when its turn comes: pieces of large data are not held together.
    work, seen = [iter((first,))], set()
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        name = (hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), layer.range)
        if name in seen:
            continue
        seen.add(name)
        hits = base_matches(layer.text)
        path = ".".join(layer.names)
        here: Counter = Counter()
        for start, end, kind in hits:
            if layer.steps is not None and (*located(layer.steps, start, end), kind) in layer.known:
                continue  # the same without this decoding, which changed other code points only
            at = layer.place(start, end)
            value = layer.text[start:end]
            key = (at[0], kind, path, at[1], value)
            here[key] += 1
            found.setdefault(key, {"kind": kind, "layers": path, "start": at[0], "end": at[1], "value": value})
        for key, n in here.items():
            times[key] = max(times[key], n)
        work.append(_decoded(layer, frozenset(hits)))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(_narrowest(found, times), key=lambda f: (f["start"], order.get(f["kind"], 9), f["layers"], f["end"], f["value"]))


def _narrowest(found: dict[tuple, dict], times: Counter) -> Iterator[dict]:
    """Findings without those that equal ones inside account for: the same read from a part and from more than that."""
    equal: dict[tuple, list[tuple]] = defaultdict(list)
    for key, f in found.items():
        equal[f["kind"], f["layers"], f["value"]].append(key)
    for keys in equal.values():
        ends: list[int] = []  # of those given out, which start no earlier
        for key in sorted(keys, key=lambda k: (-k[0], k[3])):
            if bisect_right(ends, key[3]) < max(times[key], 1):
                insort(ends, key[3])
                yield found[key]


def _decoded(layer: Layer, hits: frozenset) -> Iterator[Layer]:
    text = layer.text
    # What is read as it stands comes first, so that nothing is named after a decoding it did not need.
    opened: set[int] = set()  # where a stream begins that is read already
    if "\n" in text:
        for m in WRAPPED.finditer(text):
            parts, at = [], m.start()
            for gap in (*BREAK.finditer(text, *m.span()), None):
                end = gap.start() if gap else m.end()
                parts.append((at, end))
                at = gap.end() if gap else end
            yield from _unbased(layer, parts, opened)
    for m in BASE64.finditer(text):
        yield from _unbased(layer, [m.span()], opened)
    # Each token, as a match of the whole layer may begin before one of its own; then the whole, as a secret may be part escaped and part not.
    if ("\\" in text or "&" in text) and UNICODE.search(text):
        for span in (*(m.span() for m in UNICODE_TOKEN.finditer(text) if UNICODE.search(m[0])), (0, len(text))):
            yield _respelled(layer, span, UNICODE, "unicode", _character, hits)
    if "%" in text and PERCENT.search(text):
        for span in (*(m.span() for m in ESCAPED.finditer(text)), (0, len(text))):
            yield _respelled(layer, span, PERCENT, "url", lambda s: bytes.fromhex(s.replace("%", "")).decode("utf-8", "replace"), hits)


def _unbased(layer: Layer, parts: list[tuple[int, int]], opened: set[int]) -> Iterator[Layer]:
    """What a run of base64 may stand for, given as the parts of its lines.

    A run that is text as a whole is taken as that. Else it may begin before its base64 or end
    after it: compressed streams are looked for at every place, text in the pieces
    between / - _ and at all four alignments.
    """
    run = "".join(layer.text[s:e] for s, e in parts).rstrip("=")
    if len(run) < 16:
        return
    firsts = list(accumulate((e - s for s, e in parts), initial=0))

    def at(i: int) -> int:
        """Place in the layer of a character of the run."""
        k = bisect_right(firsts, i, hi=len(parts)) - 1
        return parts[k][0] + i - firsts[k]

    end = parts[-1][1]
    base = run.translate(TO_STANDARD)

    def inner(body: bytes, start: int, stop: int, names: tuple[str, ...] = ()) -> Layer:
        try:
            text = body.decode("utf-8")
        except UnicodeDecodeError:
            text = body.decode("latin-1")
        return Layer(text, (*layer.names, "base64", *names), None, layer.place(start, stop))

    # Streams first: the first one of a run that can be read holds those that seem to begin inside of it.
    for m in PACKED.finditer(base):
        start = at(m.start())
        if start in opened or not _opens(base[m.start() : m.start() + 4096]):
            continue
        for names, body in _unpacked(_plain_bytes(base[m.start() :])):
            opened.add(start)
            yield inner(body, start, end, tuple(names))
    body = _plain_bytes(base)
    try:
        if not NOT_TEXT.search(body.decode("utf-8")):
            yield inner(body, parts[0][0], end)
            return
    except UnicodeDecodeError:
        pass
    if len(parts) == 1 and len(run) > 16:
        for m in PIECE.finditer(layer.text, *parts[0]):
            if m.end() - m.start() < end - parts[0][0]:
                piece = _plain_bytes(m[0].rstrip("="))
                if SOME_TEXT.search(piece):
                    yield inner(piece, *m.span())
    for skip in range(4):
        body = _plain_bytes(base[skip:])
        if SOME_TEXT.search(body):
            yield inner(body, parts[0][0], end)


def _respelled(layer: Layer, span: tuple[int, int], escapes: re.Pattern, name: str, decode, hits: frozenset) -> Layer:
    """A part of a layer with its escapes replaced, and the origin of each of its code points."""
    parts, steps, size, at = [], [], 0, span[0]

    def add(piece: str, start: int, end: int, each: bool) -> None:
        nonlocal size
        if piece:
            parts.append(piece)
            steps.append(Segment(size, start, end, each))
            size += len(piece)

    for e in escapes.finditer(layer.text, *span):
        add(layer.text[at : e.start()], at, e.start(), True)
        add(decode(e[0]), *e.span(), False)
        at = e.end()
    add(layer.text[at : span[1]], at, span[1], True)
    origin = steps if not layer.names else layer.origin and list(_composed(steps, layer))
    return Layer("".join(parts), (*layer.names, name), origin, layer.place(*span), steps, hits)


def _composed(steps: list[Segment], layer: Layer) -> Iterator[Segment]:
    """The segments of a respelled layer in the document instead of in the layer it comes from."""
    for s in steps:
        if not s.each:
            yield Segment(s.at, *layer.place(s.start, s.end), False)
            continue
        i = bisect_right(layer.origin, s.start, key=lambda o: o.at) - 1
        while i < len(layer.origin) and layer.origin[i].at < s.end:
            o = layer.origin[i]
            skipped = max(s.start - o.at, 0)
            yield Segment(s.at + o.at + skipped - s.start, o.start + skipped * o.each, o.end, o.each)
            i += 1


def _character(escape: str) -> str:
    if escape.startswith("&"):
        return html.unescape(escape)
    code = int(escape.strip("\\ux{}"), 16) if escape[1] == "u" else int(escape[2:], 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"


def _plain_bytes(base: str) -> bytes:
    """The whole bytes of unpadded standard base64; a last character alone holds none."""
    base = base.translate(TO_STANDARD)
    base = base[: len(base) - (len(base) % 4 == 1)]
    return base64.b64decode(base + "=" * (-len(base) % 4))


def _opens(base: str) -> bool:
    """Whether the beginning of a run can be that of a compressed stream."""
    body = _plain_bytes(base)
    for _, magic, opener in PACKERS:
        if body.startswith(magic):
            try:
                opener().decompress(body, 1 << 16)
            except BROKEN:
                return False
            return True
    return False


def _unpacked(body: bytes) -> Iterator[tuple[list[str], bytes]]:
    """Compression undone, layer by layer, as long as the bytes begin like a compressed stream: the names and the data, in pieces if it is large."""
    names: list[str] = []
    seen = set()
    parts: Iterator[bytes] = iter((body,))
    while True:
        first, second = next(parts, b""), next(parts, None)
        if second is None:
            if first in seen:  # it unpacks to itself
                break
            seen.add(first)
        parts = chain((first,), () if second is None else (second,), parts)
        for name, magic, opener in PACKERS:
            if first.startswith(magic):
                inner = _inflated(opener, magic, iter((first,)) if second is None else parts)
                begin = next(inner, None)
                if begin is not None:
                    names, parts = [*names, name], chain((begin,), inner)
                    break
        else:
            break
    if names:
        for piece in _cut(parts) if second is not None else (first,):
            yield names, piece


def _inflated(opener, magic: bytes, chunks: Iterator[bytes]) -> Iterator[bytes]:
    """All members of a stream up to the first that cannot be read, ``MAX_LAYER`` bytes at a time; nothing if that is the first one."""
    done: list[bytes] = []  # of whole members
    held: list[bytes] = []  # of the one that is read
    stream, rest, sure, ended = None, b"", False, False
    try:
        for data in chunks:
            data, rest = rest + data, b""
            while data:
                if stream is None:
                    # Null bytes may stand between members.
                    data = data.lstrip(b"\0") if done or sure else data
                    if len(data) < len(magic):
                        rest = data
                        break
                    if not data.startswith(magic):
                        ended = True
                        break
                    stream = opener()
                for out in _read(stream, data):
                    held.append(out)
                    if sum(map(len, held)) + sum(map(len, done)) >= MAX_LAYER:
                        yield b"".join([*done, *held])
                        done, held, sure = [], [], True
                data = b""
                if stream.eof:
                    data, stream = stream.unused_data, None
                    done, held = [*done, *held], []
            if ended:
                break
    except BROKEN:
        held = []
    if done or held:
        yield b"".join([*done, *held])


def _read(stream, data: bytes) -> Iterator[bytes]:
    """What one decompressor makes of its input, a step at a time."""
    out = stream.decompress(data, STEP)
    while True:
        yield out
        tail = getattr(stream, "unconsumed_tail", None)
        if stream.eof or (stream.needs_input if tail is None else not tail):
            return
        out = stream.decompress(b"" if tail is None else tail, STEP)


def _cut(parts: Iterator[bytes]) -> Iterator[bytes]:
    """The parts cut anew where nothing that is looked for goes on; if there is no such place, with an overlap."""
    held = b""
    for part in parts:
        held += part
        if len(held) < MAX_LAYER:
            continue
        stops = [m.end() for m in STOP.finditer(held, max(0, len(held) - OVERLAP))]
        at = stops[-1] if stops else len(held)
        yield held[:at]
        held = held[at if stops else max(0, len(held) - OVERLAP) :]
    if held:
        yield held


BROKEN = (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError)
PACKERS = (
    ("gzip", b"\x1f\x8b", lambda: zlib.decompressobj(31)),
    ("zlib", b"\x78", lambda: zlib.decompressobj(15)),
    ("bz2", b"BZh", bz2.BZ2Decompressor),
    ("xz", b"\xfd7zXZ", lzma.LZMADecompressor),
)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, findings) for every row of ``docs``; no shuffle.

    A finding is (kind, layers, start, end, value): ``layers`` is empty for plain ones,
    else the decodings from the outside in, such as ``base64.gzip``; start and end are code
    points of the text. A null or empty text has none, repeated rows each have their own.
    Data of more than 64 MB unpacked is scanned in pieces of that size, cut at characters that end
    any match. Only what goes on for more than such a piece without one of these is cut inside: a
    match is then given in parts, a run of base64 read from its first 64 MB.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = rows.schema["id"].dataType

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan_text(t) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, ARROW_FINDINGS)], ["id", "findings"])

    out = T.StructType([T.StructField("id", kind), T.StructField("findings", FINDINGS)])
    return rows.mapInArrow(scan, out).withColumnRenamed("id", id_col)
