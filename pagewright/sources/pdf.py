"""PDF files as tables: characters, rules, images, text pieces and information.

A small reader of the format in plain Python, for files with simple or two-byte fonts, flate streams and object streams; it
draws nothing and decodes no pictures. Files come as one row each (binaryFile); pages are told apart before they are read, and a
range of pages is read alone. An encrypted file raises PermissionError.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright import schemas
from pagewright.functions import style

TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|\[|\]|\((?:\\.|[^()\\])*\)|<[0-9A-Fa-f\s]*>|/[^\s<>\[\](){}/%]*|[+-]?\d*\.?\d+|[A-Za-z'\"*][A-Za-z0-9'\"*]*", re.S)
OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: Part of the size that parts words, and that a line's next piece may be away; width of a letter of a font that tells none.
WORD, LINE, MEAN = 0.2, 1.5, 0.5
#: Shape of a rule, in points.
RULE_HIGH, RULE_WIDE = 2, 20


class Ref(int):
    """A reference to an object."""


class Name(str):
    __slots__ = ()


class Operator(str):
    __slots__ = ()


def text_bytes(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1] in (b"\n", b"\r", b"\r\n") else ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)


def values(data: bytes) -> list:
    """All values of a stretch of syntax, operators among them."""
    stack: list[list] = [[]]
    for m in TOKEN.finditer(data):
        t = m[0]
        if t in (b"<<", b"["):
            stack.append([])
        elif t == b"]" and len(stack) > 1:
            done = stack.pop()
            stack[-1].append(done)
        elif t == b">>" and len(stack) > 1:
            done = stack.pop()
            stack[-1].append({k: v for k, v in zip(done[::2], done[1::2], strict=False) if isinstance(k, str)})
        elif t[:1] == b"/":
            stack[-1].append(Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), t[1:]).decode("latin-1")))
        elif t[:1] in b"(<" and t != b"<<":
            stack[-1].append(text_bytes(t))
        elif re.fullmatch(rb"[+-]?\d*\.?\d+", t):
            stack[-1].append(float(t) if b"." in t else int(t))
        elif t == b"R" and len(stack[-1]) >= 2 and all(isinstance(x, int) for x in stack[-1][-2:]):
            number = stack[-1][-2]
            stack[-1][-2:] = [Ref(number)]
        elif t[:1] != b"%":
            stack[-1].append({b"true": True, b"false": False, b"null": None}.get(t, Operator(t.decode("latin-1"))))
    return stack[0]


class Document:
    def __init__(self, data: bytes):
        self.objects: dict[int, tuple] = {}
        for m in OBJECT.finditer(data):
            body, _, rest = m[2].partition(b"stream")
            raw = rest.lstrip(b"\r\n" if rest[:2] == b"\r\n" else b"\n").rpartition(b"endstream")[0] if rest else None
            self.objects[int(m[1])] = (next(iter(values(body)), None), raw)
        for n in list(self.objects):
            head = self.objects[n][0]
            if isinstance(head, dict) and head.get("Type") == "ObjStm":
                inner = self.stream(Ref(n))
                index = values(inner[: head["First"]])
                places = list(zip(index[::2], index[1::2], strict=True))
                for (number, at), end in zip(places, [*(p for _, p in places[1:]), len(inner)], strict=True):
                    self.objects.setdefault(number, (next(iter(values(inner[head["First"] + at : head["First"] + end])), None), None))
        trailers = [v for m in re.finditer(rb"trailer(.*?)startxref", data, re.S) for v in values(m[1]) if isinstance(v, dict)]
        trailers += [h for h, _ in self.objects.values() if isinstance(h, dict) and h.get("Type") == "XRef"]
        self.trailer = {k: v for t in trailers for k, v in t.items()}
        if "Encrypt" in self.trailer:
            raise PermissionError("the file is encrypted")

    def get(self, v):
        while isinstance(v, Ref):
            v = self.objects.get(int(v), (None, None))[0]
        return v

    def stream(self, ref) -> bytes:
        head, raw = self.objects.get(int(ref), ({}, b""))
        filters = self.get((head or {}).get("Filter"))
        for f in filters if isinstance(filters, list) else [filters]:
            if f == "FlateDecode":
                raw = zlib.decompressobj().decompress(raw)
        parms = self.get((head or {}).get("DecodeParms")) or {}
        if isinstance(parms, dict) and parms.get("Predictor", 1) >= 10:
            wide = parms.get("Columns", 1)
            rows, last = np.frombuffer(raw, "u1").reshape(-1, wide + 1), np.zeros(wide, "u1")
            out = []
            for r in rows:
                last = r[1:] + last if r[0] == 2 else r[1:]
                out.append(last)
            raw = np.concatenate(out).tobytes() if out else b""
        return raw or b""

    def pages(self) -> list[dict]:
        def walk(ref, held):
            node = self.get(ref) or {}
            held = {**held, **{k: node[k] for k in ("MediaBox", "Resources", "Rotate") if k in node}}
            if "Kids" in node:
                return [p for kid in self.get(node["Kids"]) for p in walk(kid, held)]
            return [{**held, **node}]

        root = self.get(self.trailer.get("Root")) or {}
        return walk(root["Pages"], {}) if "Pages" in root else []

    def content(self, page: dict) -> bytes:
        parts = page.get("Contents")
        parts = parts if isinstance(parts, list) else self.get(parts) if isinstance(self.get(parts), list) else [parts]
        return b"\n".join(self.stream(p) for p in parts if isinstance(p, Ref))


class Font:
    def __init__(self, doc: Document, head: dict):
        self.name = str(head.get("BaseFont", ""))
        self.wide = head.get("Subtype") == "Type0"
        inner = doc.get((doc.get(head.get("DescendantFonts")) or [None])[0]) if self.wide else head
        told = doc.get((inner or {}).get("FontDescriptor")) or {}
        self.flags, self.angle, self.weight = int(told.get("Flags", 0)), float(told.get("ItalicAngle", 0)), int(told.get("FontWeight", 0) or 0)
        self.widths: dict[int, float] = {}
        if self.wide:
            w, i = doc.get((inner or {}).get("W")) or [], 0
            while i + 1 < len(w):
                if isinstance(w[i + 1], list):
                    self.widths.update({w[i] + k: x for k, x in enumerate(w[i + 1])})
                    i += 2
                else:
                    self.widths.update(dict.fromkeys(range(w[i], w[i + 1] + 1), w[i + 2]))
                    i += 3
        else:
            first = int(head.get("FirstChar", 0))
            self.widths = {first + k: doc.get(x) for k, x in enumerate(doc.get(head.get("Widths")) or [])}
        self.letters = self.unicode(doc.stream(head["ToUnicode"])) if isinstance(head.get("ToUnicode"), Ref) else {}

    @staticmethod
    def unicode(data: bytes) -> dict[int, str]:
        out, number, letter = {}, lambda b: int.from_bytes(b, "big"), lambda b: b.decode("utf-16-be", "replace")
        for block in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
            v = values(block)
            out.update({number(a): letter(b) for a, b in zip(v[::2], v[1::2], strict=False)})
        for block in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
            v = values(block)
            for lo, hi, to in zip(v[::3], v[1::3], v[2::3], strict=False):
                for k in range(number(hi) - number(lo) + 1):
                    out[number(lo) + k] = letter(to[k]) if isinstance(to, list) else letter(to[:-2]) + chr(number(to[-2:]) + k)
        return out

    def codes(self, s: bytes) -> Iterator[tuple[str, float, bool]]:
        """Letter, width in sizes, and whether it is the word space."""
        for k in range(0, len(s), 2 if self.wide else 1):
            code = int.from_bytes(s[k : k + 2], "big") if self.wide else s[k]
            letter = self.letters.get(code) or (f"(cid:{code})" if self.wide else bytes([code]).decode("cp1252", "replace"))
            yield letter, (self.widths.get(code) or 1000 * MEAN) / 1000, not self.wide and code == 32


def drawn(doc: Document, page: dict) -> dict:
    """What a page shows: pieces (text, x, y), characters, rules and images."""
    resources = doc.get(page.get("Resources")) or {}
    fonts, shapes = doc.get(resources.get("Font")) or {}, doc.get(resources.get("XObject")) or {}
    known: dict = {}
    out: dict = {"pieces": [], "chars": [], "rules": [], "images": []}
    ctm, saved = np.eye(3), []
    tm = tlm = np.eye(3)
    s = {"size": 0.0, "font": None, "stretch": 1.0, "char": 0.0, "word": 0.0, "lead": 0.0, "rise": 0.0, "mode": 0}
    matrix = lambda v: np.array([[v[0], v[1], 0], [v[2], v[3], 0], [v[4], v[5], 1]], float)
    args: list = []
    pen = np.zeros(3)

    def show(text: bytes):
        nonlocal tm
        if s["font"] is None:
            return
        piece, start = "", tm @ ctm
        for letter, width, space in s["font"].codes(text):
            at = np.array([[s["size"] * s["stretch"], 0, 0], [0, s["size"], 0], [0, s["rise"], 1]]) @ tm @ ctm
            tx = (width * s["size"] + s["char"] + s["word"] * space) * s["stretch"]
            out["chars"].append({"text": letter, "x0": at[2, 0], "x1": at[2, 0] + width * at[0, 0], "y0": at[2, 1], "size": float(np.hypot(at[1, 0], at[1, 1])), "upright": bool(abs(at[0, 1]) < 1e-6 * max(1.0, abs(at[0, 0])) and at[0, 0] > 0), "invisible": s["mode"] == 3, "font": s["font"], "matrix": [float(tm[0, 0]), float(tm[0, 1]), float(tm[1, 0]), float(tm[1, 1])]})
            piece += letter
            tm = np.array([[1, 0, 0], [0, 1, 0], [tx, 0, 1]]) @ tm
        if piece.strip():
            out["pieces"].append((piece, float(start[2, 0]), float(start[2, 1])))

    for v in values(doc.content(page)):
        if not isinstance(v, Operator):
            args.append(v)
            continue
        op = str(v)
        if op == "q":
            saved.append((ctm, dict(s)))
        elif op == "Q" and saved:
            ctm, s = saved.pop()
        elif op == "cm":
            ctm = matrix(args[-6:]) @ ctm
        elif op == "BT":
            tm = tlm = np.eye(3)
        elif op == "Tf":
            name = args[-2]
            if name not in known:
                known[name] = Font(doc, doc.get(fonts.get(name)) or {})
            s["font"], s["size"] = known[name], float(args[-1])
        elif op in ("Td", "TD"):
            s["lead"] = -float(args[-1]) if op == "TD" else s["lead"]
            tm = tlm = np.array([[1, 0, 0], [0, 1, 0], [args[-2], args[-1], 1]], float) @ tlm
        elif op == "Tm":
            tm = tlm = matrix(args[-6:])
        elif op in ("T*", "'", '"'):
            tm = tlm = np.array([[1, 0, 0], [0, 1, 0], [0, -s["lead"], 1]], float) @ tlm
            if op != "T*":
                show(args[-1])
        elif op == "Tj":
            show(args[-1])
        elif op == "TJ":
            for x in args[-1]:
                if isinstance(x, bytes):
                    show(x)
                else:
                    tm = np.array([[1, 0, 0], [0, 1, 0], [-x / 1000 * s["size"] * s["stretch"], 0, 1]]) @ tm
        elif op in SETTERS:
            key, scale = SETTERS[op]
            s[key] = args[-1] * scale
        elif op == "re":
            x, y, w, h = map(float, args[-4:])
            (x0, y0, _), (x1, y1, _) = (np.array([a, b, 1]) @ ctm for a, b in ((x, y), (x + w, y + h)))
            if abs(y1 - y0) <= RULE_HIGH and abs(x1 - x0) >= RULE_WIDE:
                out["rules"].append((min(x0, x1), max(x0, x1), (y0 + y1) / 2))
        elif op in ("m", "l"):
            at = np.array([*map(float, args[-2:]), 1]) @ ctm
            if op == "l" and abs(at[1] - pen[1]) <= RULE_HIGH and abs(at[0] - pen[0]) >= RULE_WIDE:
                out["rules"].append((min(at[0], pen[0]), max(at[0], pen[0]), (at[1] + pen[1]) / 2))
            pen = at
        elif op == "Do" and (doc.get(shapes.get(args[-1])) or {}).get("Subtype") == "Image":
            (x0, y0, _), (x1, y1, _) = (np.array([a, a, 1]) @ ctm for a in (0, 1))
            out["images"].append((min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1)))
        args = []
    return out


SETTERS = {"Tc": ("char", 1), "Tw": ("word", 1), "Tz": ("stretch", 0.01), "TL": ("lead", 1), "Ts": ("rise", 1), "Tr": ("mode", 1)}


def files(spark: SparkSession, path: str) -> DataFrame:
    """doc (a path) and content of the files, one row each."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc"), "content")


def _pages_of(content: bytes, wanted) -> Iterator[tuple[int, Document, dict]]:
    doc = Document(content)
    for n, page in enumerate(doc.pages(), 1):
        if wanted is None or n in wanted:
            yield n, doc, page


def page_counts(pdfs: DataFrame) -> DataFrame:
    """doc_id, pages, title and author of the information (binary), of pdfs (doc_id, content)."""

    @F.pandas_udf("pages int, title binary, author binary")
    def told(content: pd.Series) -> pd.DataFrame:
        out = []
        for c in content:
            doc = Document(c)
            info = doc.get(doc.trailer.get("Info")) or {}
            out.append((len(doc.pages()), *[v if isinstance(v := doc.get(info.get(k)), bytes) else None for k in ("Title", "Author")]))
        return pd.DataFrame(out, columns=["pages", "title", "author"])

    return pdfs.select("doc_id", told("content").alias("t")).select("doc_id", "t.*")


def text_shows(pdfs: DataFrame, wanted: set[int] | None = None) -> DataFrame:
    """doc_id, page (from 0), seq, text, x, y: the text pieces of pdfs (doc_id, content) in the order in which they are drawn."""

    def run(batches):
        for pdf in batches:
            for d, c in zip(pdf.doc_id, pdf.content, strict=True):
                rows = [(d, n - 1, k, *p) for n, doc, page in _pages_of(c, wanted) for k, p in enumerate(drawn(doc, page)["pieces"])]
                yield pd.DataFrame(rows, columns=["doc_id", "page", "seq", "text", "x", "y"])

    return pdfs.select("doc_id", "content").mapInPandas(run, "doc_id long, page long, seq int, text string, x double, y double")


def pdf_pages(pdfs: DataFrame, wanted: set[int] | None = None) -> DataFrame:
    """doc_id, page, width, height, rules, images, glyphs and invisible (numbers of characters)."""

    def run(batches):
        for pdf in batches:
            for d, c in zip(pdf.doc_id, pdf.content, strict=True):
                rows = []
                for n, doc, page in _pages_of(c, wanted):
                    x0, y0, x1, y1 = map(float, doc.get(page.get("MediaBox")) or [0, 0, 612, 792])
                    shown = drawn(doc, page)
                    rows.append((d, n, x1 - x0, y1 - y0, [dict(zip(("x0", "x1", "y"), r, strict=True)) for r in shown["rules"]], [dict(zip(("x0", "y0", "x1", "y1"), r, strict=True)) for r in shown["images"]], len(shown["chars"]), sum(x["invisible"] for x in shown["chars"])))
                yield pd.DataFrame(rows, columns=["doc_id", "page", "width", "height", "rules", "images", "glyphs", "invisible"])

    return pdfs.select("doc_id", "content").mapInPandas(run, f"doc_id long, page int, width double, height double, rules array<{schemas.RULE}>, images array<struct<x0:double,y0:double,x1:double,y1:double>>, glyphs int, invisible int")


def lines_of(chars: list[dict]) -> Iterator[tuple[int, dict]]:
    """Characters with the number of their line, and spaces where words stand apart: a line goes on where it is drawn on."""
    line, last = -1, None
    for c in chars:
        near = last is not None and abs(c["y0"] - last["y0"]) < 0.5 * max(c["size"], 1) and -0.5 * c["size"] < c["x0"] - last["x1"] < LINE * max(c["size"], 1) and c["upright"] == last["upright"]
        if not near:
            line += 1
        elif c["x0"] - last["x1"] > WORD * c["size"] and c["text"] != " " and last["text"] != " ":
            yield line, {**c, "text": " ", "anno": True}
        yield line, {**c, "anno": False}
        last = c


def pdf_characters(pdfs: DataFrame, wanted: set[int] | None = None) -> DataFrame:
    """schemas.CHAR of pdfs (doc_id, content): what is drawn on the pages wanted (numbers from 1; all, if none are named)."""
    schema = "doc_id long, page int, line_no int, glyph_no int, text string, upright boolean, anno boolean, font string, flags int, angle double, weight int, matrix array<double>, size double, x0 double, x1 double, y0 double, invisible boolean"

    def run(batches):
        for pdf in batches:
            for d, c in zip(pdf.doc_id, pdf.content, strict=True):
                rows = [(d, n, line, k, x["text"], x["upright"], x["anno"], x["font"].name, x["font"].flags, x["font"].angle, x["font"].weight, x["matrix"], x["size"], x["x0"], x["x1"], x["y0"], x["invisible"]) for n, doc, page in _pages_of(c, wanted) for k, (line, x) in enumerate(lines_of(drawn(doc, page)["chars"]))]
                yield pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")])

    told = pdfs.select("doc_id", "content").mapInPandas(run, schema)
    kind = style.font_style(F.col("font"), F.col("flags"), F.col("angle"), F.col("weight"), F.col("matrix"))
    return told.withColumn("_s", kind).select("doc_id", "page", "line_no", "glyph_no", "text", "upright", "anno", F.col("_s.italic").alias("italic"), F.col("_s.bold").alias("bold"), "size", "x0", "x1", "y0")
