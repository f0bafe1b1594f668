"""Text of PDF files without a library: objects, page tree, Flate streams, text operators and Unicode maps of fonts.

Files that are encrypted, or compressed in another way, raise ``ValueError``. Text stands in the order of the page's
commands; a move to another line is a line break, a wide gap a blank. Pictures of text have no text.
"""

from __future__ import annotations

import re
import zlib

OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R\b")
TOKEN = re.compile(rb"\((?:[^\\()]|\\.|\((?:[^\\()]|\\.|\([^()]*\))*\))*\)|<<|>>|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>{}%]*|%[^\r\n]*|[^\s/\[\]()<>{}%]+", re.S)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}
GAP = 200  # thousandths of a letter's width from which a step back in a row of strings is a blank


def _stream(body: bytes) -> bytes:
    """The decoded stream of an object; without one it is empty."""
    m = re.search(rb"stream\r?\n", body)
    if not m:
        return b""
    head, raw = body[: m.start()], body[m.end() : body.rindex(b"endstream")]
    names = re.search(rb"/Filter\s*(\[[^\]]*\]|/\w+)", head)
    for name in re.findall(rb"/(\w+)", names.group(1)) if names else ():
        if name not in (b"FlateDecode", b"Fl"):
            raise ValueError(f"a stream is packed with {name.decode()}")
        raw = zlib.decompressobj().decompress(raw)
    return raw


def _objects(content: bytes) -> dict[int, bytes]:
    found = {int(m.group(1)): m.group(2) for m in OBJECT.finditer(content)}
    for body in list(found.values()):
        if re.search(rb"/Type\s*/ObjStm\b", body):
            n, first = (int(re.search(rb"/" + k + rb"\s+(\d+)", body).group(1)) for k in (b"N", b"First"))
            data = _stream(body)
            numbers = list(map(int, data[:first].split()))[: 2 * n]
            ends = [*numbers[3::2], len(data) - first]
            found |= {k: data[first + a : first + b] for k, a, b in zip(numbers[::2], numbers[1::2], ends)}
    return found


def _value(body: bytes, key: bytes, objects: dict[int, bytes]) -> bytes | None:
    """What stands after a key of an object: a reference's object, an array, a dictionary or a name."""
    m = re.search(rb"/" + key + rb"\s*(\d+\s+\d+\s+R\b|\[[^\]]*\]|<<.*?>>(?:\s*>>)*|/\w+|\d+)", body, re.S)
    if not m:
        return None
    ref = REFERENCE.fullmatch(m.group(1))
    return objects.get(int(ref.group(1)), b"") if ref else m.group(1)


def _pages(node: int, objects: dict[int, bytes], inherited: bytes | None, seen: set[int]) -> list[tuple[bytes, bytes | None]]:
    """(page, its resources) below a node of the page tree."""
    body = objects.get(node, b"")
    own = _value(body, b"Resources", objects) or inherited
    if node in seen:
        return []
    seen.add(node)
    kids = re.search(rb"/Kids\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
    if not kids:
        return [(body, own)] if body else []
    listed = kids.group(1) if kids.group(1).startswith(b"[") else objects.get(int(kids.group(1).split()[0]), b"")
    return [p for k in REFERENCE.findall(listed) for p in _pages(int(k), objects, own, seen)]


def _unicode_map(body: bytes) -> tuple[int, dict[int, str]]:
    """(bytes of a code, text of each code) of a font's map to Unicode."""
    data, out, size = _stream(body), {}, 1
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out[int(a, 16)], size = text(b), max(size, len(a) // 2)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
        for a, b, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(<[0-9A-Fa-f]+>|\[[^\]]*\])", block):
            lo, hi, size = int(a, 16), int(b, 16), max(size, len(a) // 2)
            if to.startswith(b"["):
                out |= {lo + k: text(h) for k, h in enumerate(re.findall(rb"<([0-9A-Fa-f]+)>", to)[: hi - lo + 1])}
            else:
                start = text(to[1:-1])
                out |= {lo + k: start[:-1] + chr(ord(start[-1]) + k) for k in range(min(hi - lo, 0xFFFF) + 1)}
    return size, out


def _string(token: bytes) -> bytes:
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    plain = lambda m: ESCAPES.get(m.group(1), bytes([int(m.group(1), 8) & 255]) if m.group(1)[:1].isdigit() else m.group(1))
    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", plain, token[1:-1], flags=re.S)


def page_text(commands: bytes, fonts: dict[bytes, tuple[int, dict[int, str]]]) -> str:
    """The text that a page's commands show."""
    out: list[str] = []
    font: tuple[int, dict[int, str]] = (1, {})
    operands: list[bytes] = []
    row = None

    def show(token: bytes) -> None:
        raw, (size, known) = _string(token), font
        codes = [int.from_bytes(raw[k : k + size], "big") for k in range(0, len(raw), size)]
        out.append("".join(known.get(c, "") for c in codes) if known else raw.decode("cp1252", "replace"))

    def break_line() -> None:
        if out and not out[-1].endswith("\n"):
            out.append("\n")

    for token in TOKEN.findall(commands):
        if token[:1] in b"(</[]" or re.fullmatch(rb"[+-]?\d*\.?\d*", token):
            operands.append(token)
            continue
        if token == b"Tf" and len(operands) > 1:
            font = fonts.get(operands[-2], (1, {}))
        elif token in (b"Td", b"TD") and operands:
            if float(operands[-1] or 0):
                break_line()
        elif token == b"Tm" and operands:
            if row is not None and operands[-1] != row:
                break_line()
            row = operands[-1]
        elif token in (b"T*", b"ET"):
            break_line()
        elif token in (b"Tj", b"'", b'"') and operands:
            if token != b"Tj":
                break_line()
            show(operands[-1])
        elif token == b"TJ":
            for x in operands:
                if x[:1] in b"(<" and x != b"<<":
                    show(x)
                elif x[:1] not in b"[]/" and x and float(x) < -GAP:
                    out.append(" ")
        operands = []
    return re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(out)).strip()


def pages(content: bytes) -> list[tuple[int, int, str]]:
    """(page, total_pages, text); pages without text are left out, numbers keep their gaps."""
    if not content.lstrip()[:5] == b"%PDF-":
        raise ValueError("no PDF file")
    if re.search(rb"/Encrypt\s+\d", content):
        raise ValueError("the file is encrypted")
    objects = _objects(content)
    root = next((k for k, v in objects.items() if re.search(rb"/Type\s*/Catalog\b", v)), None)
    tree = re.search(rb"/Pages\s+(\d+)", objects[root]) if root is not None else None
    if not tree:
        raise ValueError("the file has no pages")
    found = _pages(int(tree.group(1)), objects, None, set())
    texts = []
    for page, resources in found:
        fonts = {}
        named = _value(resources or b"", b"Font", objects) or b""
        for name, number in re.findall(rb"(/[^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", named):
            to = re.search(rb"/ToUnicode\s+(\d+)", objects.get(int(number), b""))
            fonts[name] = _unicode_map(objects.get(int(to.group(1)), b"")) if to else (1, {})
        at = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", page)
        parts = [_stream(objects.get(int(k), b"")) for k in REFERENCE.findall(at.group(1))] if at else []
        texts.append(page_text(b"\n".join(parts), fonts))
    return [(i + 1, len(texts), t) for i, t in enumerate(texts) if t]
