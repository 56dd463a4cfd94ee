"""Secrets in texts, also inside nested encodings.

Each text is the first layer of a worklist. A layer is scanned for secrets, then
unwrapped in every way that applies: percent escapes, Unicode escapes, base64 runs, and
compressed data inside these. What comes out is a new layer unless the same text has been
seen for the same characters of this document, so the list ends even where layers decode
into each other, and each copy of an encoded secret has its own span. Decoded bytes need
not be clean text: they are read byte by byte, and as UTF-16 where they look like it.
Base64 is read from each of its first four characters, line by line and over line ends;
where a line alone and the joined lines both show a secret, both spans are listed.
Compressed data (gzip, zlib, bzip2, xz, zstandard) is unpacked to its end, all members, as a
stream in pieces, at any place of a layer; its findings have the range of the data as span.
Every character of a layer knows the characters of the original it came from, so a
finding in any layer is a span of the original text.

Null and empty texts have no findings. Equal rows give equal rows. Extra columns stay,
``secrets`` replaces a column of that name.
"""

from __future__ import annotations

import binascii
import bisect
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.shared import blocks

# Kinds in the order that breaks ties between spans (fixed values).
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
# A run that is too short fails as a whole, so the length can stand in the pattern.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(
    r"((?:\\u[0-9A-Fa-f]{4})+)|\\u\{([0-9A-Fa-f]{1,6})\}|\\x([0-9A-Fa-f]{2})|&\#([0-9]{1,7});|&\#[xX]([0-9A-Fa-f]{1,6});"
)
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
# A secret, plain or encoded, has at least this many ASCII characters in a row, the second
# in UTF-16 of either order.
_NARROW = re.compile(rb"[\t\n\r -~]{12}")
_WIDE = re.compile(rb"(?:[\t\n\r -~]\0){12,}|(?:\0[\t\n\r -~]){12,}")
# Lines of base64, cut by line ends (also escaped ones) and indentation only.
_LINE_END = re.compile(r"(?:\r?\n|(?:\\r)?\\n)[ \t]*")
_WRAPPED = re.compile(
    r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:(?:\r?\n|(?:\\r)?\\n)[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}"
)
_STANDARD = str.maketrans("-_", "+/")
# How compressed data begins, as characters and as bytes.
_PACKED = re.compile(
    "\x1f\x8b\x08|x[\x01^\x9c\xda]|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\\x00|\\(\xb5/\xfd|[P-_]\\*M\x18"
)
_PACKED_BYTES = re.compile(_PACKED.pattern.encode("latin-1"))
# The escapes above, and the short ones of strings.
_STRING = re.compile(_ESCAPE.pattern + r"""|\\([nrtbfav0'"\\/])""")
_SHORT = dict(zip("nrtbfav0", "\n\r\t\b\f\a\v\0", strict=True))
# Places between bytes that no secret and no encoding of one has inside, unless there are escapes around.
_BORDER = re.compile(
    rb"[,()<>\[\]!?*~^|$@;\x80-\xff](?=[^\0&])|[A-Za-z0-9.] (?=[A-Za-z0-9])|\n(?=\r?\n)|[.:}\"']\r?\n(?=[^\0])|\0\0(?=\0)"
)
_ESCAPED = re.compile(rb"\\[xu]|%[0-9A-Fa-f]{2}|&#")
# Bytes unpacked in one step, bytes put in for zstandard, and bytes of unpacked text scanned at once.
STEP, STEP_IN, PIECE = 1 << 16, 1 << 10, 1 << 20

SPAN = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("layer", T.StringType()),
    ]
)
_ARROW_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("layer", pa.string())])


class Layer:
    """A text, how it was unwrapped, and the original characters behind each of its own.

    ``outer`` is the range of the whole layer. Without ``start`` and ``end`` all of an
    unwrapped layer comes from there. The compressed data of a ``cut`` layer is read elsewhere.
    """

    def __init__(self, text: str, path: str = "", start=None, end=None, outer=None, depth: int = 0, cut: bool = False):
        self.text, self.path, self.start, self.end = text, path, start, end
        self.outer, self.depth, self.cut = outer, depth, cut

    def original(self, start: int, end: int) -> tuple[int, int]:
        if self.start is not None:
            return int(self.start[start]), int(self.end[end - 1])
        return self.outer or (start, end)

    def child(self, text: str, how: str, start: np.ndarray, end: np.ndarray, outer=None, cut: bool = False) -> Layer:
        """A layer whose characters come from the ranges [start, end) of this one, all of them from ``outer``."""
        if self.start is not None:
            start, end = self.start[start], self.end[end - 1]
        elif self.outer:
            start = end = None
        outer = self.original(*outer) if outer else self.outer
        return Layer(text, self.way(how), start, end, outer, self.depth + 1, cut)

    def way(self, how: str) -> str:
        return f"{self.path}/{how}" if self.path else how

    def key(self) -> bytes:
        """Equal for layers of equal text from the same characters."""
        out = hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"))
        if self.start is not None:
            out.update(self.start.tobytes() + self.end.tobytes())
        out.update(repr((self.outer, self.cut)).encode())
        return out.digest()


def scan(text: str) -> Iterator[tuple[str, int, int]]:
    """The findings in one layer."""
    for m in _ASSIGN.finditer(text):
        if len(m[2]) >= 6:
            yield "assign", m.start(), m.end()
    for m in _ACCESS.finditer(text):
        yield "access", m.start(), m.end()
    for m in _HEX.finditer(text):
        yield "hex", m.start(), m.end()


def _rewritten(layer: Layer, how: str, changes: list[tuple[int, int, str, list[int]]]) -> Layer:
    """The layer with ranges replaced; each new character knows where in its range it begins."""
    text, parts, starts, ends, at = layer.text, [], [], [], 0
    for begin, finish, new, marks in changes:
        parts += [text[at:begin], new]
        plain = np.arange(at, begin)
        marked = np.array(marks, np.int64) + begin
        starts += [plain, marked]
        ends += [plain + 1, np.append(marked[1:], finish) if len(marked) else marked]
        at = finish
    plain = np.arange(at, len(text))
    return layer.child(
        "".join([*parts, text[at:]]), how, np.concatenate([*starts, plain]), np.concatenate([*ends, plain + 1])
    )


def _percent(layer: Layer) -> Iterator[Layer]:
    """Escapes as bytes, like those of base64; data that is packed also with + as a blank."""
    changes = []
    for m in _PERCENT.finditer(layer.text):
        new = bytes.fromhex(m[0].replace("%", "")).decode("latin-1")
        changes.append((m.start(), m.end(), new, list(range(0, 3 * len(new), 3))))
    if changes:
        yield (new := _rewritten(layer, "url", changes))
        if "+" in layer.text and _PACKED.search(new.text):
            blanks = [(m.start(), m.end(), " ", [0]) for m in re.finditer(r"\+", layer.text)]
            yield _rewritten(layer, "url", sorted(changes + blanks))


def _unicode(layer: Layer) -> Iterator[Layer]:
    """Escapes as characters; data that is packed also with the short escapes of strings."""
    if changes := _unescaped(_ESCAPE, layer.text):
        yield (new := _rewritten(layer, "unicode", changes))
        if _PACKED.search(new.text) or "\x1f\x8b" in new.text:
            yield _rewritten(layer, "unicode", _unescaped(_STRING, layer.text))


def _unescaped(pattern: re.Pattern, text: str) -> list[tuple[int, int, str, list[int]]]:
    changes = []
    for m in pattern.finditer(text):
        if pattern is _STRING and m[6]:
            changes.append((m.start(), m.end(), _SHORT.get(m[6], m[6]), [0]))
            continue
        if m[1]:
            units = bytes.fromhex(m[1].replace("\\u", ""))
            new = units.decode("utf-16-be", "replace")
            marks, at = [], 0
            for c in new:
                marks.append(6 * at)
                at += 2 if ord(c) > 0xFFFF else 1
            changes.append((m.start(), m.end(), new, marks))
            continue
        point = int(m[2] or m[3] or m[5], 16) if m[4] is None else int(m[4])
        if point < 0x110000 and not 0xD800 <= point < 0xE000:
            changes.append((m.start(), m.end(), chr(point), [0]))
    return changes


class _Zstandard:
    """A frame, unpacked from so little at a time that no step is large."""

    def __init__(self):
        self.tool, self.eof, self.unused_data, self.unconsumed_tail = zstandard.ZstdDecompressor().decompressobj(), False, b"", b""

    def decompress(self, data: bytes, _: int) -> bytes:
        out = self.tool.decompress(data[:STEP_IN]) if data else b""
        self.eof, self.unconsumed_tail = self.tool.eof, data[STEP_IN:]
        if self.eof:
            self.unused_data = self.tool.unused_data + data[STEP_IN:]
        return out


def _tool(data: bytes):
    """What unpacks data that begins like this, and its name, or None."""
    if data[:3] == b"\x1f\x8b\x08" or data[:1] == b"\x78" and int.from_bytes(data[:2]) % 31 == 0:
        return zlib.decompressobj(47), "zlib"
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor(), "bz2"
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor(), "xz"
    if data[:4] == b"\x28\xb5\x2f\xfd" or data[1:4] == b"*M\x18" and 0x50 <= data[0] < 0x60:
        return _Zstandard(), "zstd"
    return None


class _Unpacked:
    """The content of all members or frames that follow each other, in chunks.

    Afterwards ``used`` is the number of bytes they took and ``whole`` the number of
    members that ended. ``open`` means that the data ended before the last member.
    """

    def __init__(self, source: Iterator[bytes]):
        self.source, self.used, self.whole, self.open = iter(source), 0, 0, False

    def __iter__(self) -> Iterator[bytes]:
        data, taken = b"", 0
        try:
            while True:
                while len(data) < 6 and (more := next(self.source, b"")):
                    data, taken = data + more, taken + len(more)
                if (found := _tool(data)) is None:
                    # Members may be padded with zeros.
                    if self.whole and data[:1] == b"\0":
                        data = data.lstrip(b"\0")
                        continue
                    return
                tool = found[0]
                while not tool.eof:
                    out = tool.decompress(data, STEP)
                    data = getattr(tool, "unconsumed_tail", b"")
                    if out:
                        yield out
                    elif not data and not tool.eof:
                        if not (data := next(self.source, b"")):
                            self.open, self.used = True, taken
                            return
                        taken += len(data)
                data, self.whole = tool.unused_data, self.whole + 1
                self.used = taken - len(data)
        except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError):
            self.used = self.used if self.whole else taken


def _after(text: str, at: int) -> Iterator[bytes]:
    """The bytes that the characters from a place on stand for."""
    for k in range(at, len(text), STEP):
        part = text[k : k + STEP]
        try:
            yield part.encode("latin-1")
        except UnicodeEncodeError as e:
            yield part[: e.start].encode("latin-1")
            return


def _pieces(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Chunks joined and cut where no secret and no encoded data goes on.

    Where there is no such place the piece grows, so memory holds the longest unbroken run.
    """
    held, size, least = [], 0, PIECE
    for chunk in chunks:
        held.append(chunk)
        size += len(chunk)
        if size < least:
            continue
        cut = 0
        for start in (max(0, len(chunk) - 4096), 0):
            for m in _BORDER.finditer(chunk, start, max(start, len(chunk) - 8)):
                if not _ESCAPED.search(chunk, max(0, m.end() - 64), m.end() + 64):
                    cut = m.end()
            if cut:
                break
        if not cut:
            continue
        piece = b"".join(held)
        cut += size - len(chunk)
        at = 0
        while (m := _PACKED_BYTES.search(piece, at)) and m.start() < cut:
            # Packed data that goes on after the cut stays together.
            inner, at = _Unpacked(iter([piece[m.start() :]])), m.start() + 1
            for _ in inner:
                pass
            if inner.open or inner.whole and m.start() + inner.used > cut:
                cut = m.start()
            elif inner.whole:
                at = m.start() + inner.used
        if cut:
            yield piece[:cut]
        held, size = [piece[cut:]], len(piece) - cut
        least = max(PIECE, 2 * size)
    if size:
        yield b"".join(held)


def _packed(layer: Layer) -> Iterator[Layer]:
    """What compressed data in the layer unfolds to, piece by piece, all from its one range."""
    text, at = layer.text, 0
    while not layer.cut and (m := _PACKED.search(text, at)):
        begin, at = m.start(), m.start() + 1
        how, seen, size = [], set(), 0

        def source(begin=begin):
            return _after(text, begin)

        while (found := _tool(b"".join(itertools.islice(_sized(source()), 1)))) is not None:
            # Once through for the end and for data that unfolds to itself.
            inner, digest, some = _Unpacked(source()), hashlib.blake2b(), False
            for chunk in inner:
                digest.update(chunk)
                some = True
            if not size:
                size = inner.used
                at = begin + size if inner.whole else at
            if not some or digest.digest() in seen:
                break
            seen.add(digest.digest())
            how.append(found[1])
            whole = begin == 0 and size == len(text) and layer.outer
            outer = layer.outer if whole else layer.original(begin, begin + size)

            def source(before=source):
                return iter(_Unpacked(before()))

            for piece in _pieces(source()):
                for new, _, _ in _readings(piece):
                    yield Layer(new, layer.way("/".join(how)), outer=outer, depth=layer.depth + 1)


def _sized(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The first bytes of a stream, enough to know its format."""
    head = b""
    for chunk in chunks:
        head += chunk
        if len(head) >= 6:
            break
    yield head


def _readings(raw: bytes) -> Iterator[tuple[str, int, int]]:
    """Texts that bytes can stand for: text, its first byte, bytes of a character.

    Patterns and encodings are ASCII, so Latin-1 reads UTF-8 and everything else that
    keeps ASCII, controls and marks included. Bytes that can hold no finding have no reading.
    """
    if _NARROW.search(raw) or _PACKED_BYTES.search(raw):
        yield raw.decode("latin-1"), 0, 1
    if b"\0" not in raw:
        return
    for order, first in sorted({("<u2" if m[0][1] == 0 else ">u2", m.start() % 2) for m in _WIDE.finditer(raw)}):
        units = np.frombuffer(raw, order, (len(raw) - first) // 2, first).astype("<u2")
        units[units >> 11 == 27] = 0xFFFD
        yield units.tobytes().decode("utf-16-le"), first, 2


def _places(text: str, begin: int, finish: int) -> np.ndarray:
    """Where the characters of a run over several lines stand."""
    parts, at = [], begin
    for m in _LINE_END.finditer(text, begin, finish):
        parts.append(np.arange(at, m.start()))
        at = m.end()
    return np.concatenate([*parts, np.arange(at, finish)])


def _base64(layer: Layer) -> Iterator[Layer]:
    """Runs within a line, and runs over lines, each from its first four characters on.

    A piece of a run, as after a path or a name, is read in full by the reading that begins
    in step with it: / and - and _ before or after it do not become part of a secret.
    """
    joined = list(_WRAPPED.finditer(layer.text))
    ends = [m.end() for m in joined]
    for m in itertools.chain(_BASE64.finditer(layer.text), joined):
        begin, finish = m.start(), m.end()
        wrapped = m.re is _WRAPPED
        k = bisect.bisect_left(ends, finish)
        cut = not wrapped and k < len(joined) and joined[k].start() <= begin
        packed = _LINE_END.sub("", m[0]) if wrapped else m[0]
        packed = packed.rstrip("=").translate(_STANDARD)
        places = None
        for skip in range(min(4, len(packed) - 15)):
            size = len(packed) - skip
            size -= size % 4 == 1
            raw = binascii.a2b_base64(packed[skip : skip + size] + "=" * (-size % 4))
            for text, first, width in _readings(raw):
                if places is None:
                    places = _places(layer.text, begin, begin + len(m[0].rstrip("="))) if wrapped else np.arange(begin, finish)
                marks = first + width * np.arange(len(text))
                last = np.minimum(skip - (-(marks + width) * 4 // 3), skip + size) - 1
                yield layer.child(text, "base64", places[skip + marks * 4 // 3], places[last] + 1, (places[skip], finish), cut)


def findings(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, layer) of every secret, by start, kind and end.

    Positions are code points of ``text``. ``layer`` is empty for findings in the text
    itself, else the ways it was unwrapped. A span found in several layers
    is listed once, with the outermost.
    """
    found: dict[tuple[int, int, int], tuple[int, str]] = {}
    _collect(Layer(text), found, set())
    return [(KINDS[k], a, b, found[a, k, b][1]) for a, k, b in sorted(found)]


def _collect(first: Layer, found: dict, seen: set) -> None:
    work = deque([first])
    while work:
        layer = work.popleft()
        for kind, start, end in scan(layer.text):
            a, b = layer.original(start, end)
            key = a, KINDS.index(kind), b
            if key not in found or layer.depth < found[key][0]:
                found[key] = layer.depth, layer.path
        for unwrap in (_percent, _unicode, _base64, _packed):
            for new in unwrap(layer):
                if (key := new.key()) in seen:
                    continue
                seen.add(key)
                # Pieces of a stream are settled one by one, so that it need not fit in memory.
                if unwrap is _packed:
                    _collect(new, found, seen)
                else:
                    work.append(new)


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row with ``secrets``: kind, start, end (code points, end exclusive) and layer."""
    kept = [f for f in docs.schema if f.name != "secrets"]
    names = [f.name for f in kept]

    def run(batches):
        for block in blocks(batches, text):
            column = block.rows.schema.get_field_index(text)
            spans = [
                [dict(zip(("kind", "start", "end", "layer"), x, strict=True)) for x in findings(t)] if t else []
                for t in block.rows.column(column).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [block.rows.column(block.rows.schema.get_field_index(n)) for n in names]
                + [pa.array(spans, pa.list_(_ARROW_SPAN))],
                names=[*names, "secrets"],
            )

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField("secrets", T.ArrayType(SPAN))]))


def _masked(text: str, spans: list[dict]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its kind."""
    parts, at = [], 0
    for span in spans:
        if span["start"] >= at:
            parts += [text[at : span["start"]], f"[{span['kind']}]"]
        at = max(at, span["end"])
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with every secret in ``text`` replaced by its kind in brackets.

    Texts without a secret, null among them, are unchanged.
    """
    names = docs.columns

    def run(batches):
        for block in blocks(batches, text):
            rows = block.rows
            column = rows.schema.get_field_index(text)
            new = []
            for t in rows.column(column).to_pylist():
                spans = findings(t) if t else []
                keys = [dict(zip(("kind", "start", "end"), x, strict=False)) for x in spans]
                new.append(_masked(t, keys) if spans else t)
            columns = [rows.column(rows.schema.get_field_index(n)) for n in names]
            columns[names.index(text)] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def joined(spans: str) -> F.Column:
    """kind:start:end of spans, joined by commas."""
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')")


def digests(docs: DataFrame) -> DataFrame:
    """Per document the number of base findings by kind, their digest, and all spans."""
    found = find_secrets(docs.select("doc_id", "text")).select(
        "doc_id", "secrets", F.expr("filter(secrets, s -> s.layer = '')").alias("base")
    )
    return found.select(
        "doc_id",
        *[F.expr(f"size(filter(base, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("secrets").alias("spans"),
    )
