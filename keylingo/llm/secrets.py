"""Secret scans by a recursive decoding worklist.

A text is scanned as it is. Then its layers are: whatever URL escapes, Unicode
escapes, base64 runs, wrapped at line ends or not, and compressed data inside them unwrap to goes on a
worklist (compressed data once it isn't compressed any more), is scanned, and
is unwrapped again until nothing new turns up. A text seen before at the same
places is not put on the list again, so layers that decode into each other
end. Every character of a layer knows the span of the original text that it
comes from, so what is found inside maps back to code points of the text.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small

#: Kinds in their order, with the patterns and least lengths of the contract.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal either way
LEAST_VALUE, LEAST_ACCESS = 8, 16
KEYS = ("password", "passwd", "secret", "token", "api")

#: So many unpacked bytes are worked on at once; larger layers are a stream of windows of that size, which overlap by OVERLAP.
UNPACKED, OVERLAP = 64 << 20, 1 << 20
#: Bytes that a decompressor gives at a time; compressed bytes that zstd, which has no bound for its output, gets at a time.
PIECE, ZSTD_STEP = 1 << 20, 256

# an escape whose own first character is escaped, and that one's again, is unwrapped to its end in one step
_URL_ONE = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
_URL = re.compile(r"(?:%(?:25)*[0-9A-Fa-f]{2})+")
_BACK, _AND = r"\\(?:u005[cC]|x5[cC]|u\{0{0,4}5[cC]\})*", r"&(?:#0{0,4}38;|#[xX]0{0,4}26;)*"
_UNICODE = re.compile(rf"(?:{_BACK}(?:u[0-9A-Fa-f]{{4}}|u\{{[0-9A-Fa-f]{{1,6}}\}}|x[0-9A-Fa-f]{{2}})|{_AND}#(?:[0-9]{{1,7}}|[xX][0-9A-Fa-f]{{1,6}});)+")
_ONE = re.compile(rf"{_BACK}(?:u\{{([0-9A-Fa-f]+)\}}|u([0-9A-Fa-f]{{4}})|x([0-9A-Fa-f]{{2}}))|{_AND}#(?:[xX]([0-9A-Fa-f]+)|([0-9]+));")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{12,}={0,2}")
_ALIKE = str.maketrans("-_", "+/")
# a line end inside a base64 run, also a written-out one, with indentation and quoting; one of the lines is at least that long
_WRAP = r"[ \t]{0,64}(?:\r\n?|\n|\\r\\n|\\n|\\r)[ \t>|*#]{0,64}"
_WRAPPED = re.compile(rf"(?<=[A-Za-z0-9+/_-]{{20}}){_WRAP}(?=[A-Za-z0-9+/_-])|(?<=[A-Za-z0-9+/_-]){_WRAP}(?=[A-Za-z0-9+/_-]{{20}})")
#: Stretches of readable bytes that are taken out of others: UTF-8, and ASCII in two bytes a character. No secret and no code is shorter.
_UTF8 = re.compile(rb"(?:[\t\n\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){12,}")
_WIDE = re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){12,}|(?:\x00[\t\n\r\x20-\x7e]){12,}")
_MAGIC = re.compile(rb"\x1f\x8b\x08|x[\x01\x5e\x9c\xda]|BZh[1-9]|\x28\xb5\x2f\xfd")
_NONE = np.zeros(0, int)
_ZLIB = type(zlib.decompressobj())
_ODD = bytes({*range(32)} - {*b"\t\n\r"})


def _coded(byte: int, style: str) -> str:
    """A pattern of a byte of compressed data in a style of escapes."""
    plain = re.escape(chr(byte)) if 0x20 < byte < 0x7F else "(?!)"
    hexed = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in f"{byte:02x}")
    coded = {"%": rf"%{hexed}", "\\": rf"\\x{hexed}|\\u00{hexed}|\\u\{{0{{0,4}}{hexed.removeprefix('0')}\}}", "&#": rf"&#0{{0,4}}{byte};|&#[xX]0{{0,4}}{hexed.removeprefix('0')};"}
    return f"(?:{plain}|{coded[style]})"


#: By style of escapes: how compressed data begins in it, and the pieces that stand for a byte each (the others end the data).
_STYLES = {
    style: (re.compile("|".join("".join(_coded(b, style) for b in m) for m in (b"\x1f\x8b", b"x\x01", b"x\x5e", b"x\x9c", b"x\xda", b"BZh", b"\x28\xb5\x2f\xfd"))), re.compile(piece))
    for style, piece in (
        ("%", r"%([0-9A-Fa-f]{2})|[\x20-\x24\x26-\x7e]"),
        ("\\", r"\\(?:x|u00)([0-9A-Fa-f]{2})|\\u\{0{0,4}([0-9A-Fa-f]{1,2})\}|\\([abfnrtv0\\'\"/])|[\x20-\x5b\x5d-\x7e]"),
        ("&#", r"&#[xX]0{0,4}([0-9A-Fa-f]{1,2});|&#0{0,4}(2[0-4][0-9]|25[0-5]|1?[0-9]{1,2});|(?!&#)[\x20-\x7e]"),
    )
}
_SHORT = dict(zip("abfnrtv0", b"\a\b\f\n\r\t\v\0", strict=True))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the secrets that stand openly in a text."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


@dataclass
class Layer:
    """A decoded text; for each of its characters where it starts and ends in the original, and whether it was decoded.

    Compressed data has no place for each character: of what it holds, every
    character has the place of all the data, ``whole``, and the arrays are empty.
    """

    text: str
    start: np.ndarray
    end: np.ndarray
    changed: np.ndarray
    whole: tuple[int, int] | None = None

    def key(self) -> tuple:
        """What tells layers apart: equal texts at other places are other layers."""
        digest = hashlib.sha256(self.text.encode("utf-8", "surrogatepass"))
        for places in (self.start, self.end, self.changed):
            digest.update(places.tobytes())
        return len(self.text), digest.digest(), self.whole

    def place(self, a: int, b: int) -> tuple[int, int]:
        """Where a part of the layer stands in the original."""
        return self.whole or (int(self.start[a:b].min()), int(self.end[a:b].max()))


def _inside(text: str, place: tuple[int, int]) -> Layer:
    return Layer(text, _NONE, _NONE, _NONE, place)


def _readable(raw: bytes) -> str | None:
    """Decoded bytes as text, if they are: valid UTF-8 with hardly any control characters."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    odd = len(raw) - len(raw.translate(None, _ODD))
    return text if text and odd * 20 <= len(text) else None


def _stretches(raw: bytes) -> Iterator[tuple[str, np.ndarray]]:
    """Readable stretches in bytes that aren't text as a whole: each with the byte where every character begins, and the end."""
    for m in _UTF8.finditer(raw):
        try:
            text = m[0].decode()
        except UnicodeDecodeError:  # overlong forms and surrogates
            text = m[0].decode("latin-1")
        size = [len(c.encode()) for c in text] if len(text) < len(m[0]) else [1] * len(text)
        yield text, m.start() + np.concatenate([[0], np.cumsum(size)])
    for m in _WIDE.finditer(raw):
        text = m[0].replace(b"\0", b"").decode()
        yield text, m.start() + 2 * np.arange(len(text) + 1)


class _Tape:
    """Bytes that come in pieces, with a look ahead."""

    def __init__(self, pieces: Iterable[bytes]):
        self.pieces, self.held = iter(pieces), b""

    def head(self, n: int) -> bytes:
        """The next n bytes, or all that are left; they stay."""
        if len(self.held) < n:
            got, size = [self.held], len(self.held)
            while size < n and (piece := next(self.pieces, None)) is not None:
                got.append(piece)
                size += len(piece)
            self.held = b"".join(got)
        return self.held[:n]

    def take(self) -> bytes:
        held, self.held = self.held, b""
        return held or next(self.pieces, b"")


def _reader(head: bytes):
    """A decompressor for bytes that begin like this; None if they aren't compressed."""
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if head[:1] == b"\x78" and len(head) > 2 and int.from_bytes(head[:2], "big") % 31 == 0:
        return zlib.decompressobj()
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:4] == b"\x28\xb5\x2f\xfd":
        return zstandard.ZstdDecompressor().decompressobj()
    return None


def _pieces(reader, data: bytes, tape: _Tape) -> Iterator[bytes]:
    """What a decompressor makes of data, about PIECE bytes at a time; what it leaves goes back on the tape."""
    if isinstance(reader, bz2.BZ2Decompressor):
        while not reader.eof:
            yield reader.decompress(data, PIECE)
            data = b""
            if reader.needs_input:
                return
        tape.held = reader.unused_data + tape.held
    elif isinstance(reader, _ZLIB):
        while not reader.eof:
            out = reader.decompress(data, PIECE)
            yield out
            data = reader.unconsumed_tail
            if not reader.eof and not data and len(out) < PIECE:
                return
        tape.held = reader.unused_data + tape.held
    else:
        for at in range(0, len(data), ZSTD_STEP):
            yield reader.decompress(data[at : at + ZSTD_STEP])
            if reader.eof:
                tape.held = reader.unused_data + data[at + ZSTD_STEP :] + tape.held
                return


def _members(tape: _Tape, ends: list[int]) -> Iterator[bytes]:
    """The unpacked members (streams, frames) at the head of a tape, one after the other; ends gets where each one ends.

    Leaves the tape at what follows them, or where it was if that isn't
    compressed after all. A member that is cut off counts as far as it goes.
    """
    size = 0
    while (reader := _reader(tape.head(4))) is not None:
        taken, begun = [], False
        try:
            while not reader.eof:
                data = tape.take()
                if not data:
                    return
                if not begun:
                    taken.append(data)
                for piece in _pieces(reader, data, tape):
                    if piece:
                        begun = True
                        size += len(piece)
                        yield piece
        except (zlib.error, OSError, EOFError, zstandard.ZstdError, ValueError):
            if not begun:
                tape.held = b"".join(taken) + tape.held
            return
        ends.append(size)


def _windows(tape: _Tape) -> Iterator[str]:
    """The bytes of a tape as texts: as one if it has up to UNPACKED bytes, else in windows.

    A window ends after a control character that no secret and no code holds;
    where there is none in its second half, windows overlap by OVERLAP bytes.
    """
    while block := tape.head(UNPACKED + 1):
        if len(block) <= UNPACKED:
            end = after = len(block)
        else:
            end = after = 1 + max(block.rfind(c, UNPACKED // 2, UNPACKED) for c in (b"\n", b"\r", b"\t", b"\0"))
            if not end:
                end = _boundary(block, UNPACKED)
                after = _boundary(block, end - OVERLAP)
        tape.held = tape.held[after:]
        text = _readable(block[:end])
        if text is None:  # another charset, or text among other bytes
            text = "\n".join(t for t, _ in _stretches(block[:end]))
        if text:
            yield text


def _boundary(raw: bytes, at: int) -> int:
    """The last beginning of a UTF-8 character up to a place."""
    return next((n for n in range(at, at - 4, -1) if raw[n] & 0xC0 != 0x80), at)


def _unpacked(tape: _Tape, above: frozenset) -> Iterator:
    """Texts in bytes and, for what they unpack to, iterators like this one. Ends where bytes hold themselves.

    Up to UNPACKED bytes of members are read together and each alone, more as
    one stream in windows.
    """
    key = hashlib.sha256(tape.head(UNPACKED)).digest()
    if key in above:
        return
    ends = []
    inner = _Tape(_members(tape, ends))
    whole = inner.head(UNPACKED + 1)
    if len(whole) > UNPACKED:
        yield _unpacked(inner, above | {key})
    elif whole:
        cuts = sorted({0, *ends, len(whole)})
        for part in [whole] + [whole[a:b] for a, b in pairwise(cuts) if len(cuts) > 2]:
            yield _unpacked(_Tape([part]), above | {key})
    yield from _windows(tape)


def _texts(raw: bytes) -> Iterator[str]:
    """All texts in bytes, which are unpacked as often as they are compressed."""
    work = [_unpacked(_Tape([raw]), frozenset())]
    while work:
        got = next(work[-1], None)
        if got is None:
            work.pop()
        elif isinstance(got, str):
            yield got
        else:
            work.append(got)


def _spliced(layer: Layer, pieces: list[tuple[int, int, str, list[int]]]) -> Layer:
    """The layer with pieces (from, to, new text, places of its characters in the piece) put in."""
    if layer.whole:
        cuts = [0, *(n for a, b, *_ in pieces for n in (a, b)), len(layer.text)]
        kept = [layer.text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
        return _inside("".join(t for pair in zip(kept, [p[2] for p in pieces] + [""], strict=True) for t in pair), layer.whole)
    text, start, end, changed, at = [], [], [], [], 0
    for a, b, new, places in pieces:
        text += [layer.text[at:a], new]
        start += [layer.start[at:a], layer.start[[a + p for p in places[:-1]]]]
        end += [layer.end[at:a], layer.end[[a + p - 1 for p in places[1:]]]]
        changed += [layer.changed[at:a], np.ones(len(new), bool)]
        at = b
    text.append(layer.text[at:])
    start.append(layer.start[at:])
    end.append(layer.end[at:])
    changed.append(layer.changed[at:])
    return Layer("".join(text), np.concatenate(start), np.concatenate(end), np.concatenate(changed))


def _url(layer: Layer) -> Layer | None:
    pieces = []
    for m in _URL.finditer(layer.text):
        each = [(int(one[1], 16), one.end()) for one in _URL_ONE.finditer(m[0])]
        raw, ends = bytes(b for b, _ in each), [0, *(e for _, e in each)]
        new, at, places = [], 0, [0]
        while at < len(raw):
            try:
                good, bad, end = raw[at:].decode(), len(raw), len(raw)
            except UnicodeDecodeError as e:  # what can't be decoded is one character, as long as it is
                good, bad, end = raw[at : at + e.start].decode(), at + e.start, at + e.end
            for c in good:
                at += len(c.encode())
                places.append(ends[at])
            new.append(good)
            if bad < len(raw):
                new.append("\ufffd")
                at = end
                places.append(ends[at])
        pieces.append((m.start(), m.end(), "".join(new), places))
    return _spliced(layer, pieces) if pieces else None


def _escapes(layer: Layer) -> Layer | None:
    pieces = []
    for m in _UNICODE.finditer(layer.text):
        new, places = [], [0]
        for one in _ONE.finditer(m[0]):
            code = int(one[5]) if one[5] else int(one[1] or one[2] or one[3] or one[4], 16)
            if new and 0xD800 <= ord(new[-1]) < 0xDC00 <= code < 0xE000:
                new[-1] = chr(0x10000 + ((ord(new[-1]) - 0xD800) << 10) + code - 0xDC00)
                places[-1] = one.end()
            else:
                new.append(chr(code) if code < 0x110000 else "�")
                places.append(one.end())
        pieces.append((m.start(), m.end(), "".join(new), places))
    return _spliced(layer, pieces) if pieces else None


def _base64(layer: Layer) -> Iterator[Layer]:
    """Base64 runs at each of the four places where a group may begin, as what comes before a code may look like one."""
    for m in _BASE64.finditer(layer.text):
        run = m[0].rstrip("=").translate(_ALIKE)
        for skip in range(4):
            part = run[skip : len(run) - ((len(run) - skip) % 4 == 1)]
            raw = base64.b64decode(part + "=" * (-len(part) % 4))
            whole = _readable(raw) if skip == 0 else None
            packed = len(raw)  # where compressed data begins: what is readable inside it is part of it
            for magic in _MAGIC.finditer(raw):
                data, before = raw[magic.start() :], packed
                if (magic.start() == 0 and skip == 0) or _opens(data[:64]):
                    place = layer.place(m.start() + skip + magic.start() * 4 // 3, m.end())
                    for inner in _texts(data):
                        if inner != whole:
                            packed = magic.start()
                            yield _inside(inner, place)
                if packed < before:
                    break
            found = [(whole, np.cumsum([0, *(len(c.encode()) for c in whole)]))] if whole else _stretches(raw[:packed])
            for text, places in found:
                if layer.whole:
                    yield _inside(text, layer.whole)
                    continue
                first = m.start() + skip + places[:-1] * 4 // 3
                last = np.minimum(m.start() + skip + (places[1:] * 4 + 2) // 3, m.end())
                yield Layer(text, layer.start[first], layer.end[last - 1], np.ones(len(text), bool))


def _joined(layer: Layer) -> Layer | None:
    """The layer without the line ends inside base64 runs."""
    pieces = [(m.start(), m.end(), "", [0]) for m in _WRAPPED.finditer(layer.text)]
    return _spliced(layer, pieces) if pieces else None


def _form(layer: Layer) -> Layer | None:
    """The layer with plus as space wherever words hold URL escapes too, as forms are encoded."""
    pieces = []
    for m in re.finditer(r"\S+", layer.text):
        if "+" in m[0] and _URL_ONE.search(m[0]):
            pieces += [(m.start() + n, m.start() + n + 1, " ", [0, 1]) for n, c in enumerate(m[0]) if c == "+"]
    return _spliced(layer, pieces) if pieces else None


def _opens(head: bytes) -> bool:
    """Whether bytes begin as compressed data does, beyond its first mark."""
    try:
        reader = _reader(head)
        return reader is not None and reader.decompress(head) is not None
    except (zlib.error, OSError, EOFError, zstandard.ZstdError, ValueError):
        return False


def _escaped(text: str, style: str, at: int, space: str) -> Iterator[tuple[int, int]]:
    """(byte, end of its piece) of compressed data in a style of escapes, from a place on."""
    piece = _STYLES[style][1]
    while m := piece.match(text, at):
        at = m.end()
        if style == "\\" and m[3]:
            yield _SHORT.get(m[3], ord(m[3])), at
        elif style == "&#" and m[2]:
            yield int(m[2]), at
        else:
            code = next((g for g in m.groups() if g), None)
            yield int(code, 16) if code else ord(space if m[0] == "+" else m[0]), at


def _packed(layer: Layer) -> Iterator[Layer]:
    """Compressed data whose bytes are written as escapes; in URLs a plus may stand for a space."""
    for style, (magic, _) in _STYLES.items():
        for space in ("+ " if style == "%" and "+" in layer.text else "+") if style in layer.text else ():
            done = 0
            for m in magic.finditer(layer.text):
                if m.start() < done:
                    continue
                coded = _escaped(layer.text, style, m.start(), space)
                head = list(islice(coded, 64))
                try:
                    _reader(bytes(b for b, _ in head)).decompress(bytes(b for b, _ in head))
                except (AttributeError, zlib.error, OSError, EOFError, zstandard.ZstdError, ValueError):
                    continue
                head += coded
                raw = bytes(b for b, _ in head)
                tape = _Tape([raw])
                for _ in _members(tape, []):
                    pass
                used = len(raw) - len(tape.held)
                if used:
                    done = head[used - 1][1]
                    place = layer.place(m.start(), done)
                    yield from (_inside(inner, place) for inner in _texts(raw[:used]))


def _inner(layer: Layer) -> Iterator[Layer]:
    """The layers right below one; those as long as itself come last, when it isn't held any more."""
    yield from _packed(layer)
    yield from _base64(layer)
    ways = ((_url, "%"), (_form, "%"), (_escapes, "\\", "&#"), (_joined, "\n", "\r", "\\n", "\\r"))
    last = [way(layer) for way, *marks in ways if any(mark in layer.text for mark in marks)]
    del layer
    while last:
        if new := last.pop():
            yield new


def all_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of secrets in the text and in all of its layers, in order and once each."""
    base = base_spans(text)
    if not ("%" in text or "\\" in text or "&#" in text or _BASE64.search(text)):
        return base
    root = Layer(text, np.arange(len(text)), np.arange(1, len(text) + 1), np.zeros(len(text), bool))
    work, seen, found = [_inner(root)], {root.key()}, set(base)
    del root
    while work:
        new = next(work[-1], None)
        if new is None:
            work.pop()
            continue
        if (key := new.key()) in seen:
            continue
        seen.add(key)
        work.append(_inner(new))
        for a, kind, b in base_spans(new.text):
            if new.whole or new.changed[a:b].any():
                start, end = new.place(a, b)
                found.add((start, kind, end))
        del new
    return sorted(found)


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    The counts and the digest are of secrets that stand openly; ``spans`` adds
    those in decoded layers. Null counts as empty, which has none. Texts are
    scanned whole; rows with repeated or null ids stay as they are; an empty
    table gives an empty result; other columns are ignored.
    """

    def run(batches):
        for batch in small(batches):
            rows = []
            for value in batch.column("text"):
                text = value.as_py() or ""
                base = base_spans(text)
                n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                rows.append((*n, hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(all_spans(text))))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
