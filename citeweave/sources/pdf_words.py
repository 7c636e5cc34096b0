"""Positioned words of PDF pages, from their text layer, with the standard library alone.

A file is read by its objects, wherever they lie, so damaged cross-reference tables do not
matter; streams are inflated up to a bound. Page content is run for its text operators only:
every glyph gets the place that the text and graphics matrices give it, and glyphs that touch
become words. Codes turn into text by a font's ToUnicode map, else by its encoding. Scanned
pages have no text layer and give no words; encrypted files are refused.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

#: Bytes that a file's streams may inflate to.
MOST_BYTES = 200 << 20
_TOKEN = re.compile(
    rb"(?P<space>[\0\t\n\f\r ]+|%[^\r\n]*)|(?P<open><<|\[)|(?P<close>>>|\])|(?P<hex><[0-9A-Fa-f\s]*>)|(?P<string>\()|/(?P<name>[^\0\t\n\f\r ()<>\[\]{}/%]*)"
    rb"|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+))(?=[\0\t\n\f\r ()<>\[\]{}/%]|$)|(?P<word>[^\0\t\n\f\r ()<>\[\]{}/%]+)|(?P<other>.)",
    re.DOTALL,
)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    """A name, as against a string (bytes)."""


class Word(bytes):
    """An operator or keyword."""


class Ref(int):
    """The number of another object."""


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in brackets whose opening one lies before ``at``, and where it ends."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        at += 1
        if c == b"\\":
            octal = re.match(rb"[0-7]{1,3}", data[at : at + 3])
            if octal:
                out.append(int(octal[0], 8) & 255)
                at += len(octal[0])
            elif data[at : at + 2] == b"\r\n":
                at += 2
            else:
                d = data[at : at + 1]
                out += b"" if d in (b"\n", b"\r") else _ESCAPES.get(d, d)
                at += 1
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            break
        out += c
    return bytes(out), at


def tokens(data: bytes, at: int = 0) -> Iterator[tuple[object, int]]:
    """Values and operators with where each ends; arrays and dictionaries are put together."""
    stack: list[tuple[bytes, list]] = []
    while at < len(data):
        m = _TOKEN.match(data, at)
        at = m.end()
        kind = m.lastgroup
        if kind == "space" or kind == "other":
            continue
        if kind == "open":
            stack.append((m[0], []))
            continue
        if kind == "close":
            if not stack:
                continue
            opened, items = stack.pop()
            value: object = items if opened == b"[" else {k: v for k, v in zip(items[::2], items[1::2], strict=False) if isinstance(k, Name)}
        elif kind == "string":
            value, at = _literal(data, at)
        elif kind == "hex":
            digits = re.sub(rb"\s", b"", m[0][1:-1])
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif kind == "name":
            value = Name(re.sub(r"#([0-9A-Fa-f]{2})", lambda h: chr(int(h[1], 16)), m["name"].decode("latin-1")))
        elif kind == "number":
            value = float(m[0]) if b"." in m[0] else int(m[0])
        else:
            value = Word(m[0])
            if value == b"R" and stack and len(stack[-1][1]) > 1:  # two numbers before it name an object
                del stack[-1][1][-1]
                value = Ref(stack[-1][1].pop())
        if stack:
            stack[-1][1].append(value)
        else:
            yield value, at


class Pdf:
    def __init__(self, content: bytes):
        self.left = MOST_BYTES
        self.objects: dict[int, tuple[object, bytes | None]] = {}
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", content):
            raise ValueError("pdf_encrypted")
        for m in re.finditer(rb"(?<!\d)(\d{1,9})\s+\d{1,5}\s+obj\b", content):
            value, end = next(tokens(content, m.end()), (None, m.end()))
            stream = re.match(rb"\s*stream\r?\n", content[end : end + 20])
            body = None
            if isinstance(value, dict) and stream:
                first = end + stream.end()
                size = value.get("Length")
                stop = first + size if isinstance(size, int) and not isinstance(size, Ref) and content[first + size : first + size + 20].lstrip().startswith(b"endstream") else content.find(b"endstream", first)
                body = content[first : stop if stop >= 0 else len(content)]
            self.objects[int(m[1])] = (value, body)
        for value, body in list(self.objects.values()):
            if body is not None and isinstance(value, dict) and value.get("Type") == "ObjStm":
                self._unpack(value, body)

    def _unpack(self, about: dict, body: bytes) -> None:
        data = self.inflate(about, body)
        first = about.get("First", 0)
        head = [x for x, _ in tokens(data[:first]) if isinstance(x, int)]
        for number, offset in zip(head[::2], head[1::2], strict=False):
            self.objects.setdefault(number, (next(tokens(data, first + offset), (None, 0))[0], None))

    def inflate(self, about: dict, body: bytes) -> bytes:
        filters = self.get(about.get("Filter")) or []
        for name in filters if isinstance(filters, list) else [filters]:
            if self.get(name) != "FlateDecode":
                return b""
            unpack = zlib.decompressobj()
            try:
                body = unpack.decompress(body, self.left + 1)
            except zlib.error:
                return b""
            self.left -= len(body)
            if self.left < 0:
                raise ValueError("pdf_unpacked_too_large")
        return body

    def get(self, value: object) -> object:
        for _ in range(8):
            if not isinstance(value, Ref):
                break
            value = self.objects.get(int(value), (None, None))[0]
        return value

    def stream(self, value: object) -> bytes:
        if isinstance(self.get(value), list):
            return b"\n".join(self.stream(x) for x in self.get(value))
        about, body = self.objects.get(int(value), (None, None)) if isinstance(value, Ref) else (None, None)
        return self.inflate(about, body) if body is not None and isinstance(about, dict) else b""

    def pages(self) -> Iterator[dict]:
        """Pages in order, with what they inherit."""
        catalog = next((v for v, _ in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Catalog"), {})
        stack, seen = [(catalog.get("Pages"), {})], set()
        while stack:
            ref, above = stack.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or id(node) in seen:
                continue
            seen.add(id(node))
            own = {**above, **{k: node[k] for k in ("Resources", "MediaBox") if k in node}}
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                stack += [(k, own) for k in reversed(kids)]
            else:
                yield {**own, **node}


class Font:
    """Codes of a font to (text, width in thousandths of the size)."""

    def __init__(self, pdf: Pdf, about: dict):
        self.wide = about.get("Subtype") == "Type0"
        self.text: dict[int, str] = {}
        self.widths: dict[int, float] = {}
        self.usual = 500.0
        if self.wide:
            below = pdf.get((pdf.get(about.get("DescendantFonts")) or [None])[0]) or {}
            self.usual = float(pdf.get(below.get("DW", 1000)))
            listed = pdf.get(below.get("W")) or []
            k = 0
            while k + 1 < len(listed):
                first, then = listed[k], pdf.get(listed[k + 1])
                if isinstance(then, list):
                    self.widths.update({first + n: float(w) for n, w in enumerate(then)})
                    k += 2
                elif k + 2 < len(listed):
                    self.widths.update(dict.fromkeys(range(first, min(then, first + 65535) + 1), float(listed[k + 2])))
                    k += 3
                else:
                    break
        else:
            first = pdf.get(about.get("FirstChar")) or 0
            self.widths = {first + n: float(w) for n, w in enumerate(map(pdf.get, pdf.get(about.get("Widths")) or [])) if isinstance(w, (int, float))}
            coding = pdf.get(about.get("Encoding"))
            named = "mac_roman" if "MacRomanEncoding" in (coding, coding.get("BaseEncoding") if isinstance(coding, dict) else None) else "cp1252"
            self.text = {c: bytes([c]).decode(named, "replace") for c in range(32, 256)}
            code = 0
            for x in (pdf.get(coding.get("Differences")) or []) if isinstance(coding, dict) else []:
                if isinstance(x, Name):
                    shown = x if len(x) == 1 else chr(int(x[3:], 16)) if re.fullmatch(r"uni[0-9A-F]{4}", x) else {"space": " ", "hyphen": "-", "period": ".", "comma": ",", "fi": "fi", "fl": "fl", "endash": "–", "emdash": "—", "quoteright": "’", "quoteleft": "‘", "parenleft": "(", "parenright": ")"}.get(x)
                    if shown:
                        self.text[code] = shown
                    code += 1
                elif isinstance(x, int):
                    code = x
        if isinstance(about.get("ToUnicode"), Ref):
            self._map(pdf.stream(about["ToUnicode"]))

    def _map(self, cmap: bytes) -> None:
        shown = lambda b: b.decode("utf-16-be", "replace")
        held: list = []
        for value, _ in tokens(cmap):
            if not isinstance(value, Word):
                held.append(value)
                continue
            if value == b"endbfchar":
                pairs = [x for x in held if isinstance(x, bytes)]
                self.text.update({int.from_bytes(a): shown(b) for a, b in zip(pairs[::2], pairs[1::2], strict=False)})
            elif value == b"endbfrange":
                for low, high, to in zip(held[::3], held[1::3], held[2::3], strict=False):
                    if isinstance(low, bytes) and isinstance(high, bytes):
                        codes = range(int.from_bytes(low), min(int.from_bytes(high), int.from_bytes(low) + 65535) + 1)
                        if isinstance(to, list):
                            self.text.update({c: shown(b) for c, b in zip(codes, to, strict=False) if isinstance(b, bytes)})
                        elif isinstance(to, bytes) and to:
                            base = int.from_bytes(to[-2:])
                            self.text.update({c: shown(to[:-2] + ((base + n) & 0xFFFF).to_bytes(min(2, len(to)))) for n, c in enumerate(codes)})
            held = []

    def glyphs(self, data: bytes) -> Iterator[tuple[str, float, bool]]:
        """(text, width, whether it is a one-byte space) of each code."""
        step = 2 if self.wide else 1
        for k in range(0, len(data) - step + 1, step):
            code = int.from_bytes(data[k : k + step])
            yield self.text.get(code, ""), self.widths.get(code, self.usual) / 1000, step == 1 and code == 32


def _times(a: tuple, b: tuple) -> tuple:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


_UNIT = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def _glyphs(pdf: Pdf, content: bytes, resources: dict, matrix: tuple, depth: int = 0) -> Iterator[tuple[str, float, float, float, float]]:
    """(text, x0, x1, baseline, size) of each glyph in the order of the content."""
    fonts = {k: Font(pdf, v) for k, v in ((k, pdf.get(v)) for k, v in (pdf.get(resources.get("Font")) or {}).items()) if isinstance(v, dict)}
    saved: list[tuple] = []
    state = {"font": None, "size": 1.0, "char": 0.0, "word": 0.0, "scale": 1.0, "lead": 0.0, "rise": 0.0}
    text = line = _UNIT
    held: list = []

    def shown(data: bytes) -> Iterator[tuple[str, float, float, float, float]]:
        nonlocal text
        font = state["font"]
        if font is None:
            return
        for glyph, width, space in font.glyphs(data):
            at = _times((state["size"] * state["scale"], 0, 0, state["size"], 0, state["rise"]), _times(text, matrix))
            yield glyph, at[4], at[4] + at[0] * width, at[5], abs(at[3]) or abs(at[1])
            move = (width * state["size"] + state["char"] + (state["word"] if space else 0)) * state["scale"]
            text = _times((1, 0, 0, 1, move, 0), text)

    def next_line(x: float, y: float) -> None:
        nonlocal text, line
        text = line = _times((1, 0, 0, 1, x, y), line)

    for value, _ in tokens(content):
        if not isinstance(value, Word):
            held.append(value)
            continue
        n = [x for x in held if isinstance(x, (int, float))]
        last = held[-1] if held else None
        named = next((x for x in reversed(held) if isinstance(x, Name)), None)
        held = []
        if value == b"q":
            saved.append((matrix, dict(state)))
        elif value == b"Q" and saved:
            matrix, state = saved.pop()
        elif value == b"cm" and len(n) == 6:
            matrix = _times(tuple(n), matrix)
        elif value == b"BT":
            text = line = _UNIT
        elif value == b"Tf" and n:
            state["font"], state["size"] = fonts.get(named), float(n[-1])
        elif value in (b"Tc", b"Tw", b"TL", b"Ts", b"Tz") and n:
            state[{b"Tc": "char", b"Tw": "word", b"TL": "lead", b"Ts": "rise", b"Tz": "scale"}[value]] = n[-1] / (100 if value == b"Tz" else 1)
        elif value in (b"Td", b"TD") and len(n) == 2:
            if value == b"TD":
                state["lead"] = -n[1]
            next_line(*n)
        elif value == b"Tm" and len(n) == 6:
            text = line = tuple(n)
        elif value in (b"T*", b"'", b'"'):
            next_line(0, -state["lead"])
        if value in (b"Tj", b"'", b'"') and isinstance(last, bytes):
            yield from shown(last)
        elif value == b"TJ" and isinstance(last, list):
            for part in last:
                if isinstance(part, bytes):
                    yield from shown(part)
                elif isinstance(part, (int, float)):
                    text = _times((1, 0, 0, 1, -part / 1000 * state["size"] * state["scale"], 0), text)
        elif value == b"Do" and isinstance(last, Name) and depth < 8:
            ref = (pdf.get(resources.get("XObject")) or {}).get(last)
            about = pdf.get(ref)
            if isinstance(about, dict) and about.get("Subtype") == "Form":
                inner = tuple(pdf.get(about.get("Matrix")) or _UNIT)
                yield from _glyphs(pdf, pdf.stream(ref), pdf.get(about.get("Resources")) or resources, _times(inner, matrix), depth + 1)


def _words(glyphs: Iterator[tuple[str, float, float, float, float]], height: float) -> list[dict]:
    """Glyphs that follow each other on one baseline without a gap, as words with tops counted from the page's top."""
    words: list[dict] = []
    now: list | None = None  # text, x0, x1, baseline, size

    def close() -> None:
        if now is not None and now[0].strip():
            words.append({"text": now[0].strip(), "x0": now[1], "x1": now[2], "top": height - now[3] - 0.8 * now[4], "bottom": height - now[3] + 0.2 * now[4]})

    for text, x0, x1, base, size in glyphs:
        joins = now is not None and abs(base - now[3]) <= 0.3 * size and -0.5 * size <= x0 - now[2] <= 0.15 * size
        if not text.strip() or not joins:
            close()
            now = [text, x0, x1, base, size] if text.strip() else None
        else:
            now[0], now[2], now[4] = now[0] + text, x1, max(now[4], size)
    close()
    return words


def read_words(content: bytes) -> list[list[dict]]:
    """For each page its words: text, x0, x1, top, bottom."""
    pdf = Pdf(content)
    found = []
    for page in pdf.pages():
        box = [float(x) for x in map(pdf.get, pdf.get(page.get("MediaBox")) or []) if isinstance(x, (int, float))]
        top = box[3] if len(box) == 4 else 842.0
        resources = pdf.get(page.get("Resources")) or {}
        found.append(_words(_glyphs(pdf, pdf.stream(page.get("Contents")), resources, _UNIT), top))
    return found
