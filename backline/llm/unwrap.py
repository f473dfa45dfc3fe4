"""Secret scans through nested encodings.

A worklist starts with the text itself.  Each layer is scanned for secrets, then unwrapped in every way that applies:
percent escapes, Unicode escapes, base64 that begins anywhere in a run of its letters, and gzip, zlib, bzip2 or zstandard data
inside base64.  What comes out
is a new layer, until no layer is new (a layer seen before at the same place ends there, so data that unpacks to
itself cannot loop).  Every character of a layer knows the characters of the text it came from, so a secret found
five layers down is reported as a span of the text.

Defined cases: null and empty texts have no spans; whole texts are read; repeated rows are scanned row by row;
bytes that are not printable UTF-8 end a layer, and what stands between them is one of at least six characters; base64 broken
over lines of any equal width from four is joined; all members of compressed data are read; a packed layer that unfolds to more than ``MAX_LAYER`` bytes is scanned to its end in overlapping windows and counted
in ``n_oversize`` (a secret or word inside it longer than an eighth of a window may be seen in part); empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

KINDS = ("assign", "access", "hex")
MAX_LAYER, PIECE = 32 << 20, 1 << 10
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I)
_ASSIGN_CUES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so shorter ones can be skipped at once
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(
    r"\\u([dD][89abAB][0-9a-fA-F]{2})\\u([dD][c-fC-F][0-9a-fA-F]{2})|\\u\{([0-9a-fA-F]{1,6})\}|\\u([0-9a-fA-F]{4})|\\U([0-9a-fA-F]{8})|\\x([0-9a-fA-F]{2})|&#x([0-9a-fA-F]{1,6});|&#([0-9]{1,7});"
)
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
_BROKEN = re.compile(r"[A-Za-z0-9+/_-]{4,}(?:\r?\n[\x20\t]*[A-Za-z0-9+/_-]{4,})*\r?\n[\x20\t]*[A-Za-z0-9+/_-]+={0,2}")
_SHORTEST = 16
_RUN = re.compile("x{6,}")
# Where compressed data may begin among decoded bytes.
_PACKED = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\x28\xb5\x2f\xfd|\x78[\x01\x5e\x9c\xda]", re.S)
_URL_SAFE = bytes.maketrans(b"-_", b"+/")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the secrets that stand in ``text`` as it is."""
    found = []
    low = text.lower()
    if any(c in low for c in _ASSIGN_CUES):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return found


class _Layer:
    """Text with the span of the source text that each character came from."""

    def __init__(self, text: str, first: np.ndarray, after: np.ndarray, path: str):
        self.text, self.first, self.after, self.path = text, first, after, path

    def span(self, start: int, end: int) -> tuple[int, int]:
        return int(self.first[start:end].min()), int(self.after[start:end].max())


def _replaced(layer: _Layer, cuts: list[tuple[int, int, str, list[int]]], name: str) -> _Layer | None:
    """The layer with parts (start, end, new text, where each new character begins in the part) put in."""
    if not cuts:
        return None
    texts, first, after, at = [], [], [], 0
    for start, end, new, begins in cuts:
        texts += [layer.text[at:start], new]
        b = np.array([*begins, end - start]) + start
        first += [layer.first[at:start], layer.first[b[:-1]]]
        after += [layer.after[at:start], layer.after[b[1:] - 1]]
        at = end
    texts.append(layer.text[at:])
    return _Layer("".join(texts), np.concatenate([*first, layer.first[at:]]), np.concatenate([*after, layer.after[at:]]), f"{layer.path}>{name}".lstrip(">"))


def _percent(layer: _Layer) -> _Layer | None:
    cuts = []
    for m in _PERCENT.finditer(layer.text) if "%" in layer.text else ():
        chars = bytes.fromhex(m[0].replace("%", "")).decode(errors="surrogateescape")
        at = m.start()
        for stray, part in groupby(chars, lambda c: "\udc80" <= c <= "\udcff"):  # bytes that are not UTF-8 stay as they are
            new = "".join(part)
            widths = [3 if stray else 3 * len(c.encode()) for c in new]
            if not stray:
                cuts.append((at, at + sum(widths), new, list(np.cumsum([0, *widths[:-1]]))))
            at += sum(widths)
    return _replaced(layer, cuts, "url")


def _escapes(layer: _Layer) -> _Layer | None:
    cuts = []
    for m in _ESCAPE.finditer(layer.text) if "\\" in layer.text or "&#" in layer.text else ():
        if m[1]:
            code = 0x10000 + ((int(m[1], 16) - 0xD800) << 10) + int(m[2], 16) - 0xDC00
        elif m[8]:
            code = int(m[8])
        else:
            code = int(next(g for g in m.groups()[2:7] if g), 16)
        if 0 < code < 0xD800 or 0xE000 <= code < 0x110000:
            cuts.append((m.start(), m.end(), chr(code), [0]))
    return _replaced(layer, cuts, "unicode")


def _codec(head: bytes) -> Callable | None:
    """Maker of decoders for compressed data that begins so."""
    if head[:2] == b"\x1f\x8b":
        return lambda: zlib.decompressobj(31)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor
    if head[:4] == b"\x28\xb5\x2f\xfd":
        return lambda: zstandard.ZstdDecompressor().decompressobj()
    if len(head) > 2 and head[0] & 0x0F == 8 and (head[0] << 8 | head[1]) % 31 == 0:
        return zlib.decompressobj
    return None


def _content(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """Content of all compressed members that follow each other, up to bytes that are none.

    Decoders are fed ``PIECE`` bytes at a time, so that even the densest data unfolds to bounded chunks.
    """
    pieces = (c[k : k + PIECE] for c in chunks for k in range(0, len(c), PIECE))
    decoder, rest = None, b""
    try:
        for piece in chain(pieces, [b""]):
            last, rest = not piece, rest + piece
            while rest:
                if decoder is None:
                    rest = rest.lstrip(b"\0")
                    if len(rest) < 4 and not last:
                        break
                    make = _codec(rest)
                    if make is None:
                        return
                    decoder = make()
                out = decoder.decompress(rest)
                rest = decoder.unused_data if decoder.eof else b""
                if decoder.eof:
                    decoder = None
                if out:
                    yield out
    except (zlib.error, OSError, zstandard.ZstdError, EOFError, ValueError):
        return


def _unpack(data: bytes) -> tuple[bytes, bool] | None:
    """(content, oversize) of compressed data, None if it is not compressed."""
    if _codec(data) is None:
        return None
    parts, size = [], 0
    for out in _content([data]):
        parts.append(out)
        size += len(out)
        if size > MAX_LAYER:
            break
    return (b"".join(parts)[:MAX_LAYER], size > MAX_LAYER) if parts else None


def _windows(data: bytes) -> Iterator[bytes]:
    """What stands below all compression of ``data``, in windows of ``MAX_LAYER`` bytes that overlap by an eighth."""
    stream, heads = _content([data]), set()
    while True:
        head = b""
        for out in stream:
            head += out
            if len(head) >= 4 * PIECE:
                break
        stream = chain([head], stream)
        if head in heads or not _unpack(head):
            break
        heads.add(head)
        stream = _content(stream)
    held = bytearray()
    for out in stream:
        held += out
        at = 0
        while len(held) - at > MAX_LAYER:
            yield bytes(held[at : at + MAX_LAYER])
            at += MAX_LAYER - MAX_LAYER // 8
        del held[:at]
    yield bytes(held)


def _stretches(data: bytes) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(text, first byte, byte after) by character of each printable part of at least six characters."""
    text = data.decode(errors="surrogateescape")
    shown = text.translate({9: 32, 10: 32, 13: 32})
    if shown.isprintable():
        cuts = [(0, len(text))] if len(text) >= 6 else []
    else:
        cuts = [m.span() for m in _RUN.finditer("".join(["x" if c.isprintable() else "-" for c in shown]))]
    if not cuts:
        return
    widths = np.ones(len(text), np.int64) if len(text) == len(data) else np.array([1 if "\udc80" <= c <= "\udcff" else len(c.encode()) for c in text])
    ends = np.cumsum(widths)
    for a, b in cuts:
        yield text[a:b], ends[a:b] - widths[a:b], ends[a:b]


def _words(text: str) -> Iterator[list[tuple[int, int]]]:
    """Spans of the lines of each base64 word: single lines, then words broken over lines.

    Lines of a broken word have one length, but the first may begin, and the last may end, earlier.
    """
    for m in _BASE64.finditer(text):
        yield [m.span()]
    for m in _BROKEN.finditer(text):
        lines = [(m.start() + x.start(), m.start() + x.end()) for x in _LINE.finditer(m[0])]
        size = [b - a for a, b in lines]
        for k in range(len(lines) - 1):
            if k and size[k] == size[k - 1]:
                continue
            j = k + 1
            while j + 1 < len(lines) and size[j + 1] == size[k + 1]:
                j += 1
            yield lines[k : j + 1]
            if j + 1 < len(lines) and size[j + 1] < size[j]:
                yield lines[k : j + 2]


def _unpacked(packed: bytes) -> tuple[Iterable[bytes], int, bool]:
    """(content below all compression in one or more windows, number of compressions, is it oversize)."""
    data, cut, seen, depth = packed, False, set(), 0
    while not cut and (more := _unpack(data)) and more[0] not in seen:
        seen.add(data)
        packed = data
        data, cut = more
        depth += 1
    return (_windows(packed) if cut else (data,)), depth, cut


def _base64_layers(layer: _Layer) -> Iterator[tuple[_Layer, bool]]:
    """The printable layers of all base64 runs, through all compression inside; True for the first window of an oversize one.

    Base64 may begin anywhere in a run of its letters (behind a path, a dash, a name), so every run is decoded at its four
    alignments; what was before the beginning comes out as a few other bytes.
    """
    for lines in _words(layer.text):
        word = "".join(layer.text[a:b] for a, b in lines).rstrip("=")
        if len(word) < _SHORTEST:
            continue
        core = word.encode().translate(_URL_SAFE)
        place = np.concatenate([np.arange(a, b) for a, b in lines])[: len(word)]
        for shift in range(4):
            whole = core[shift : len(core) - ((len(core) - shift) % 4 == 1)]  # a single last letter holds no byte
            data = base64.b64decode(whole + b"=" * (-len(whole) % 4))
            at = place[shift:]
            for text, first, after in _stretches(data):
                low, high = layer.first[at[first * 4 // 3]], layer.after[at[np.minimum((after * 8 + 5) // 6, len(at)) - 1]]
                yield _Layer(text, low, high, f"{layer.path}>base64".lstrip(">")), False
            for m in _PACKED.finditer(data):
                windows, depth, cut = _unpacked(data[m.start() :])
                if not depth:
                    continue
                low, high = int(layer.first[at[m.start() * 4 // 3]]), int(layer.after[at[-1]])
                counted = False
                for window in windows:
                    for text, *_ in _stretches(window):
                        first, after = (np.broadcast_to(np.int64(x), (len(text),)) for x in (low, high))
                        yield _Layer(text, first, after, f"{layer.path}>base64{'>packed' * depth}".lstrip(">")), cut and not counted
                        counted = True


def _children(layer: _Layer) -> Iterator[tuple[_Layer, bool]]:
    for decode in (_percent, _escapes):
        if (child := decode(layer)) is not None:
            yield child, False
    yield from _base64_layers(layer)


def unwrap_scan(text: str) -> dict:
    """{'base': spans, 'all': spans, 'paths': {span: layers}, 'layers': n, 'oversize': n} of one text."""
    base = sorted(base_spans(text))
    every, paths = set(base), {}
    layers, oversize = 0, 0
    seen = {(hashlib.blake2b(text.encode(), digest_size=16).digest(), 0)}
    if not ("%" in text or "\\" in text or "&#" in text or _BASE64.search(text) or _BROKEN.search(text)):
        return {"base": base, "all": base, "paths": paths, "layers": 0, "oversize": 0}
    place = np.arange(len(text))
    # one layer, or one window of it, is held per depth
    todo = [_children(_Layer(text, place, place + 1, ""))]
    while todo:
        layer, cut = next(todo[-1], (None, False))
        if layer is None:
            todo.pop()
            continue
        oversize += cut
        mark = (hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), int(layer.first[0]) if len(layer.first) else 0)
        if mark in seen:
            continue
        seen.add(mark)
        layers += 1
        for start, kind, end in base_spans(layer.text):
            low, high = layer.span(start, end)
            if (low, kind, high) not in every:
                every.add((low, kind, high))
                paths[low, kind, high] = layer.path
        todo.append(_children(layer))
    return {"base": base, "all": sorted(every), "paths": paths, "layers": layers, "oversize": oversize}


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_spans(docs: DataFrame) -> DataFrame:
    """One row per document: (doc_id, n_assign, n_access, n_hex, base_spans, spans, found_in, n_layers, n_oversize).

    Spans are kind:start:end in characters, by start, then kind; ``found_in`` lists, in their order, the
    layers of the spans that only unwrapping shows.
    """
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    names = ["n_assign", "n_access", "n_hex", "base_spans", "spans", "found_in", "n_layers", "n_oversize"]
    types = [pa.int64()] * 3 + [pa.string()] * 3 + [pa.int64()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for text in batch.column(1):
                r = unwrap_scan(text.as_py())
                kinds = [k for _, k, _ in r["base"]]
                row = [*(kinds.count(k) for k in range(3)), _joined(r["base"]), _joined(r["all"]), ",".join(r["paths"][s] for s in r["all"] if s in r["paths"]), r["layers"], r["oversize"]]
                for c, v in zip(columns, row):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=["doc_id", *names])

    return source.mapInArrow(run, f"doc_id {id_type}, n_assign long, n_access long, n_hex long, base_spans string, spans string, found_in string, n_layers long, n_oversize long")
