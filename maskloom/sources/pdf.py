"""Text of PDF files by the standard library: pages in order, text in blocks by place.

Reads plain and Flate streams, object streams, simple fonts and those with a ToUnicode table. It does
not read encrypted files, and it does not recognise letters in pictures: a page with little text and a
picture gives a warning instead.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

#: A page with fewer characters than this and a picture needs its letters recognised.
LEAST_TEXT = 50
#: Lines whose distance is up to so many times their letters' size are one block.
LEADING = 1.8
_REF = rb"(\d+)\s+\d+\s+R"
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\](){}%]+|[-+]?(?:\d+\.?\d*|\.\d+)|[A-Za-z'\"*]+[0-9*]?", re.DOTALL)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class PdfError(ValueError):
    pass


def _stream(body: bytes) -> bytes | None:
    """The decoded stream of an object, or null."""
    at = re.search(rb"stream\r?\n", body)
    if not at:
        return None
    head, data = body[: at.start()], body[at.end() : body.rfind(b"endstream")]
    if b"FlateDecode" in head:
        return zlib.decompressobj().decompress(data)
    return None if b"/Filter" in head else data


class Document:
    """The objects of a file by number."""

    def __init__(self, body: bytes):
        if not body.startswith(b"%PDF"):
            raise PdfError("no PDF")
        if re.search(rb"/Encrypt\s", body):
            raise PdfError("encrypted")
        self.objects = {int(m[1]): m[2] for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", body, re.DOTALL)}
        for held in [o for o in self.objects.values() if re.search(rb"/Type\s*/ObjStm", o)]:
            data = _stream(held) or b""
            first = int(re.search(rb"/First\s+(\d+)", held)[1])
            pairs = [int(x) for x in data[:first].split()]
            ends = [*pairs[3::2], len(data) - first]
            for number, start, end in zip(pairs[::2], pairs[1::2], ends, strict=False):
                self.objects.setdefault(number, data[first + start : first + end])

    def at(self, body: bytes, key: bytes) -> bytes:
        """What ``key`` holds in a dictionary: an object, an array or a dictionary as written; empty if it has none."""
        m = re.search(rb"/" + key + rb"\b\s*", body)
        if not m:
            return b""
        rest = body[m.end() :]
        if ref := re.match(_REF, rest):
            return self.objects.get(int(ref[1]), b"")
        if rest[:1] == b"[":
            return rest[: rest.find(b"]") + 1]
        if rest[:2] != b"<<":
            return rest
        depth = 0
        for t in re.finditer(rb"<<|>>", rest):
            depth += 1 if t[0] == b"<<" else -1
            if not depth:
                return rest[: t.end()]
        return rest

    def pages(self) -> Iterator[tuple[bytes, bytes]]:
        """(page, resources) in reading order; resources may come from the page's ancestors."""
        catalog = next((o for o in self.objects.values() if re.search(rb"/Type\s*/Catalog", o)), b"")
        todo = [(self.at(catalog, b"Pages"), b"", 0)]
        while todo:
            node, above, depth = todo.pop(0)
            own = self.at(node, b"Resources") or above
            if b"/Kids" in node and depth < 50:
                todo = [(self.objects.get(int(r), b""), own, depth + 1) for r in re.findall(_REF, self.at(node, b"Kids"))] + todo
            elif re.search(rb"/Type\s*/Page\b", node):
                yield node, own

    def content(self, page: bytes) -> bytes:
        m = re.search(rb"/Contents\s*(\[[^\]]*\]|" + _REF + rb")", page)
        return b"\n".join(_stream(self.objects.get(int(r), b"")) or b"" for r in re.findall(_REF, m[1])) if m else b""

    def fonts(self, resources: bytes) -> dict[bytes, dict[bytes, str] | None]:
        """By name, the table of codes of each font; null for fonts without one."""
        out = {}
        for name, number in re.findall(rb"/([^\s/<>\[\]()]+)\s+" + _REF, self.at(resources, b"Font")):
            table = _stream(self.at(self.objects.get(int(number), b""), b"ToUnicode")) if b"/ToUnicode" in self.objects.get(int(number), b"") else None
            out[name] = _code_table(table) if table else None
        return out


def _wide(code: bytes) -> str:
    return bytes.fromhex(code.decode()).decode("utf-16-be", "replace")


def _code_table(cmap: bytes) -> dict[bytes, str]:
    out: dict[bytes, str] = {}
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.DOTALL):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            out[bytes.fromhex(a.decode())] = _wide(b)
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.DOTALL):
        for a, z, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            for i in range(min(int(z, 16) - int(a, 16), 65535) + 1):
                out[(int(a, 16) + i).to_bytes(len(a) // 2, "big")] = chr(int(b, 16) + i)
    return out


def _raw(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    out = re.sub(rb"\\([0-7]{1,3})", lambda m: bytes([int(m[1], 8) & 255]), token[1:-1])
    return re.sub(rb"\\(\r?\n|.)", lambda m: b"" if m[1][-1:] == b"\n" else _ESCAPES.get(m[1], m[1]), out, flags=re.DOTALL)


def _said(token: bytes, table: dict[bytes, str] | None) -> str:
    raw = _raw(token)
    if not table:
        return raw.decode("cp1252", "replace")
    n = max(map(len, table))
    return "".join(table.get(raw[i : i + n], table.get(raw[i : i + 1], "")) for i in range(0, len(raw), n))


def shown(content: bytes, fonts: dict[bytes, dict[bytes, str] | None]) -> Iterator[tuple[float, float, float, str]]:
    """(y, x, size, text) of every string that a page shows."""
    stack: list[bytes] = []
    x = y = leading = 0.0
    size, scale, table = 12.0, 1.0, None
    number = lambda k: float(stack[k]) if len(stack) >= -k and re.match(rb"[-+.\d]", stack[k]) else 0.0
    for token in _TOKEN.findall(content):
        if token[:1] in b"(<[]/" or re.match(rb"[-+.\d]", token):
            stack.append(token)
            continue
        if token == b"BT":
            x = y = 0.0
            scale = 1.0
        elif token == b"Tf" and len(stack) > 1:
            size, table = number(-1), fonts.get(stack[-2][1:])
        elif token == b"Tm":
            scale, x, y = abs(number(-3)) or 1.0, number(-2), number(-1)
        elif token in (b"Td", b"TD"):
            x, y = x + number(-2) * scale, y + number(-1) * scale
            leading = -number(-1) if token == b"TD" else leading
        elif token == b"TL":
            leading = number(-1)
        elif token in (b"T*", b"'", b'"'):
            y -= (leading or size * 1.2) * scale
        if token in (b"Tj", b"TJ", b"'", b'"'):
            parts = []
            for t in stack:
                if t[:1] in b"(<":
                    parts.append(_said(t, table))
                elif parts and token == b"TJ" and re.match(rb"[-+.\d]", t) and float(t) < -180:
                    parts.append(" ")  # a gap as wide as a blank
            if text := "".join(parts):
                yield y, x, size * scale, text
                x += len(text) * size * scale * 0.5
        stack.clear()


def pdf_blocks(body: bytes) -> Iterator[tuple]:
    """(type, text, cells, id) of the blocks of a file: page by page, from top to bottom and left to right."""
    doc = Document(body)
    for n, (page, resources) in enumerate(doc.pages(), 1):
        lines: dict[float, list[tuple[float, float, str]]] = {}
        for y, x, size, text in shown(doc.content(page), doc.fonts(resources)):
            lines.setdefault(round(y, 1), []).append((x, size, text))
        blocks: list[tuple[float, list[str]]] = []
        total = 0
        for y in sorted(lines, reverse=True):
            parts = sorted(lines[y], key=lambda p: p[0])
            text = " ".join(t.strip() for _, _, t in parts if t.strip())
            total += len(text)
            if not text:
                continue
            if blocks and blocks[-1][0] - y <= LEADING * max(s for _, s, _ in parts):
                blocks[-1] = (y, [*blocks[-1][1], text])
            else:
                blocks.append((y, [text]))
        for k, (_, rows) in enumerate(blocks):
            yield "paragraph", "\n".join(rows), [], f"p{n}-b{k}"
        if total < LEAST_TEXT and re.search(rb"/Subtype\s*/Image", b"".join(doc.objects.get(int(r), b"") for r in re.findall(_REF, doc.at(resources, b"XObject")))):
            yield "warning", f"ocr:page {n}", []
