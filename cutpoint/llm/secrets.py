"""Secret scans of texts and of what is encoded in them, layer by layer."""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import session

#: Kinds in their order, with least lengths (of group 2 for assign).
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex")
LEAST = {"assign": 12, "access": 18}

ESCAPED = re.compile(r"%[0-9A-Fa-f]{2}")
UNICODE = re.compile(r"\\u[0-9A-Fa-f]{4}")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: Base64 in lines: all but the last of 20 characters or more, perhaps indented.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{20,}+\r?\n[ \t]*+)+[A-Za-z0-9+/_-]+={0,2}")
#: Shortest text that a secret, or what encodes one, can be.
READABLE = re.compile(rb"[\t\n\r\x20-\x7e]{12}")
BASE64_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: Bytes that a compressed layer may unpack to at once; a larger one is counted, and
#: scanned in blocks. Bytes unpacked in a step; characters that blocks share at most
#: where there is no better place to cut.
MOST_UNPACKED, PIECE, OVERLAP = 64 << 20, 1 << 20, 4096

Span = tuple[str, int, int]
#: Start and end, in the text outside, of each character of a layer.
Places = tuple[np.ndarray, np.ndarray]


def scan(text: str) -> list[Span]:
    """Secrets that stand in ``text`` itself: ``(kind, start, end)``."""
    out: list[Span] = []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "api")):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def _byte_widths(made: str) -> np.ndarray:
    """Bytes that each character was decoded from."""
    c = np.frombuffer(made.encode("utf-32-le", "surrogatepass"), np.uint32)
    width = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000).astype(np.int64)
    return np.where((c >= 0xDC80) & (c <= 0xDCFF), 1, width)


def _is_packed(data: bytes) -> int:
    """The window parameter of the gzip or zlib stream that ``data`` begins; 0 for other bytes."""
    if data[:2] == b"\x1f\x8b":
        return 31
    known = len(data) > 1 and data[0] & 15 == 8 and data[0] >> 4 <= 7 and int.from_bytes(data[:2], "big") % 31 == 0
    return 15 if known and not data[1] & 32 else 0


def _inflated(data: bytes) -> Iterator[bytes]:
    """What the gzip or zlib streams at the start of ``data`` hold, up to the first fault."""
    while wbits := _is_packed(data):
        engine = zlib.decompressobj(wbits)
        while not engine.eof:
            try:
                out = engine.decompress(data, min(PIECE, MOST_UNPACKED))
            except zlib.error:
                return
            data = engine.unconsumed_tail
            if not (out or data or engine.eof):
                return
            yield out
        data = engine.unused_data.lstrip(b"\0")


def _carried(block: str) -> int:
    """From where on a block is read again with what follows, so that nothing is cut: from
    its last line, or from before the last blank and a keyword. Half a block without
    either is cut between groups of base64."""
    half = len(block) // 2
    if (at := block.rfind("\n") + 1) > half:
        return at
    if (at := len(block[: max(0, block.rfind(" "))].rstrip(" \"':=")) - 16) > half:
        return at
    at = len(block) - min(OVERLAP, half)
    return at - max(0, at - len(block.rstrip(BASE64_CHARS))) % 4


def _unpacked(data: bytes) -> Iterator[str | None]:
    """Text of a compressed layer; beyond MOST_UNPACKED bytes, None and overlapping blocks."""
    decoder = codecs.getincrementaldecoder("utf-8")("surrogateescape")
    parts: list[str] = []
    total = held = fresh = 0
    for out in _inflated(data):
        if total <= MOST_UNPACKED < total + len(out):
            yield None
        total += len(out)
        parts.append(decoder.decode(out))
        held += len(parts[-1])
        fresh += len(out)
        if held > MOST_UNPACKED:
            block = "".join(parts)
            yield block
            parts = [block[_carried(block) :]]
            held, fresh = len(parts[0]), 0
    if fresh:
        yield "".join([*parts, decoder.decode(b"", True)])


def _one(start: int, end: int, n: int) -> Places:
    """``n`` characters that all stand for one span; no memory for each."""
    return np.broadcast_to(np.int64(start), n), np.broadcast_to(np.int64(end), n)


def _through(step: Places, outer: Places | None) -> Places:
    """Places of a layer in the whole text, by those of the layer that it stands in."""
    if outer is None:
        return step
    (a, b), (lo, hi) = step, outer
    if not a.strides[0] or not lo.strides[0]:  # one span
        return _one(lo[a[0]], hi[b[-1] - 1], len(a))
    return lo[a], hi[b - 1]


def _key(made: str, places: Places) -> bytes:
    """Names a layer by its text and places."""
    out = hashlib.blake2b(made.encode("utf-8", "surrogatepass"), digest_size=32)
    for x in places:
        out.update(b"|" + (x if x.strides[0] else x[:1]).tobytes())
    return out.digest()


def _unescaped(text: str, escape: re.Pattern, decode: Callable[[str], tuple[str, np.ndarray]], flat: bool) -> Iterator[tuple[str, Places]]:
    """The whole text with its escapes decoded; other characters stay."""
    out: list[str] = []
    widths: list[np.ndarray] = []
    at = 0
    for run in re.finditer(f"(?:{escape.pattern})+", text):
        made, width = decode(run[0])
        out += [text[at : run.start()], made]
        widths += [np.ones(run.start() - at, np.int64), width]
        at = run.end()
    out.append(text[at:])
    if flat:
        made = "".join(out)
        yield made, _one(0, len(text), len(made))
        return
    width = np.concatenate([*widths, np.ones(len(text) - at, np.int64)])
    ends = np.cumsum(width)
    yield "".join(out), (ends - width, ends)


def _from_url(run: str) -> tuple[str, np.ndarray]:
    """What a run of URL escapes stands for, and how many characters each one takes."""
    made = unquote_to_bytes(run).decode("utf-8", "surrogateescape")
    return made, 3 * _byte_widths(made)


def _from_unicode(run: str) -> tuple[str, np.ndarray]:
    """What a run of Unicode escapes stands for, and how many characters each one takes."""
    units = b"".join(int(run[i + 2 : i + 6], 16).to_bytes(2, "big") for i in range(0, len(run), 6))
    made = units.decode("utf-16-be", "surrogatepass")
    return made, np.array([12 if ord(c) > 0xFFFF else 6 for c in made], np.int64)


def layers(text: str, flat: bool = False) -> Iterator[tuple[str | None, Places | None]]:
    """What is encoded in ``text`` one layer down, with the way back to its characters.
    Escapes are decoded in the whole text, so what stands before and after them stays.

    Bytes that are no UTF-8 stay as lone surrogates. Base64 may be wrapped in lines and stand
    after other characters of its alphabet. None stands before the blocks of a
    layer too large to unpack at once. If ``flat``, all of ``text`` stands for one span, and
    no character needs its own.
    """
    if "%" in text and ESCAPED.search(text):
        yield from _unescaped(text, ESCAPED, _from_url, flat)
    if "\\u" in text and UNICODE.search(text):
        yield from _unescaped(text, UNICODE, _from_unicode, flat)
    for places, body in _base64_runs(text):
        yield from _from_base64(places, body, flat)


def _base64_runs(text: str) -> Iterator[tuple[np.ndarray, str]]:
    """Runs of base64 characters, and those that line feeds part joined: the place of each
    character, and the characters in the usual alphabet."""
    for m in BASE64.finditer(text):
        yield np.arange(*m.span()), m[0].rstrip("=").replace("-", "+").replace("_", "/")
    if "\n" in text:
        for m in WRAPPED.finditer(text):
            chars = np.frombuffer(m[0].encode(), np.uint8)
            places = np.flatnonzero((chars > 0x20) & (chars != 0x3D))
            yield places + m.start(), "".join(m[0].split()).rstrip("=").replace("-", "+").replace("_", "/")


def _from_base64(places: np.ndarray, body: str, flat: bool) -> Iterator[tuple[str | None, Places | None]]:
    """What a run encodes from each of four alignments, since other characters of the alphabet
    (a path, a name) may stand before it; and what is compressed in it from its start, from
    after a separator, or from a gzip header on. Bytes without readable text are no layer."""
    whole = (int(places[0]), int(places[-1]) + 1)
    starts = [0, *(m.end() for m in re.finditer("[+/]", body))]
    for align in range(4):
        part = body[align:]
        part = part[: len(part) - (len(part) % 4 == 1)]
        data = base64.b64decode(part + "=" * (-len(part) % 4))
        if READABLE.search(data):
            made = data.decode("utf-8", "surrogateescape")
            if flat:
                yield made, _one(*whole, len(made))
            else:
                width = _byte_widths(made)
                at = np.cumsum(width)
                yield made, (places[align + (at - width) * 4 // 3], places[align - (-at * 4 // 3) - 1] + 1)
        heads = {(s - align) // 4 * 3 for s in starts if s >= align and (s - align) % 4 == 0}
        heads |= {m.start() for m in re.finditer(b"\x1f\x8b\x08", data) if m.start() % 3 == 0}
        for head in sorted(heads):
            if _is_packed(data[head : head + 2]):
                first = int(places[align + head // 3 * 4])
                for block in _unpacked(data[head:]):
                    yield block, None if block is None else _one(first, whole[1], len(block))


def scan_deep(text: str) -> tuple[list[Span], list[Span], int]:
    """Secrets of the text, those of its decoded layers (spans in the text), oversize layers.

    A layer is left out if one of the same text at the same places was met, which loses no
    place and ends every cycle.
    """
    base = scan(text)
    deep: set[Span] = set()
    seen: set[bytes] = set()
    oversize = 0
    work: list[tuple[Iterator[tuple[str | None, Places | None]], Places | None]] = [(layers(text), None)]
    while work:
        inside, outer = work[-1]
        made, step = next(inside, ("", None))
        if made is None:
            oversize += 1
        elif step is None:
            work.pop()
        elif (key := _key(made, places := _through(step, outer))) not in seen:
            seen.add(key)
            lo, hi = places
            # what stands in the layer outside as it is was found there
            found = [m for m in scan(made) if (step[1][m[1] : m[2]] - step[0][m[1] : m[2]] > 1).any()]
            deep |= {(f"decoded-{kind}", int(lo[a]), int(hi[b - 1])) for kind, a, b in found}
            work.append((layers(made, not places[0].strides[0]), places))
    return base, sorted(deep, key=lambda s: (s[1], s[0], s[2])), oversize


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets in whole texts and in what URL escapes, Unicode escapes, base64 and
    compression hide in them, unwrapped until nothing new appears.

    Returns per input row: doc_id, spans and decoded (arrays of kind, start, end in
    characters of the text, end exclusive; decoded ones name what their layer held and
    span what encodes it) and n_oversize, compressed layers beyond ``MOST_UNPACKED``
    bytes, which are scanned in overlapping blocks; there, what is encoded in a run of over
    half a block without blanks and line feeds is read in parts. Null texts are empty; other columns are not read;
    repeated rows are scanned each.
    """
    session(docs)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], []]
            for text in batch.column(1):
                base, deep, skipped = scan_deep(text.as_py() or "")
                base.sort(key=lambda s: (s[1], KINDS.index(s[0])))
                for c, found in zip(cols, (base, deep), strict=False):
                    c.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
                cols[2].append(skipped)
            kinds = [pa.list_(span), pa.list_(span), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))],
                ["doc_id", "spans", "decoded", "n_oversize"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    one = "array<struct<kind:string,start:int,end:int>>"
    return rows.mapInArrow(run, f"doc_id {kind}, spans {one}, decoded {one}, n_oversize long")
