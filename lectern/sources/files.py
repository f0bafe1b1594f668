"""Files of any supported type as documents, in batch.

Files are read with the binary source and parsed next to the data, a file at a time. A file that cannot be parsed gives
one row with an ``error`` and no content, so that one bad file never ends a job.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources import docx, html, json_docs, pdf

#: Extensions of each kind of file (fixed values), in order of precedence.
EXTENSIONS = {
    "pdf": (".pdf",),
    "docx": (".docx",),
    "html": (".html", ".htm"),
    "json": (".json",),
    "image": (".png", ".jpg", ".jpeg", ".tiff", ".tif", ".bmp", ".gif"),
}
#: Names of unfinished downloads (fixed values).
UNFINISHED = (".tmp", ".part", ".crdownload", ".download")
SCHEMA = "page_content string, source string, source_path string, page int, total_pages int, file_type string, section_title string, ocr_lang string, error string"


def pdf_pages(content: bytes) -> list[tuple[int, int, str]]:
    """(page, total_pages, text) with the pypdf library where it is installed, else with ``pdf.pages``. Pages without text
    are left out; numbers keep their gaps."""
    try:
        import pypdf
    except ImportError:
        return pdf.pages(content)
    found = pypdf.PdfReader(io.BytesIO(content)).pages
    texts = [(page.extract_text() or "").strip() for page in found]
    return [(i + 1, len(texts), t) for i, t in enumerate(texts) if t]


def image_pages(content: bytes, language: str = "eng") -> list[tuple[int, int, str]]:
    """(frame, frames, text) by optical recognition where Pillow and pytesseract are installed."""
    try:
        import pytesseract
        from PIL import Image, ImageSequence
    except ImportError as e:
        raise ValueError("no text recognition is installed") from e
    frames = [f.convert("RGB") for f in ImageSequence.Iterator(Image.open(io.BytesIO(content)))]
    out = []
    for i, frame in enumerate(frames):
        try:
            text = pytesseract.image_to_string(frame, lang=language, config="--psm 3").strip()
        except pytesseract.TesseractNotFoundError:
            raise
        except Exception:  # noqa: BLE001, S112 - a frame that cannot be read is left out
            continue
        if text:
            out.append((i + 1, len(frames), text))
    return out


@dataclass(frozen=True)
class Parsers:
    """Replaceable parsers of binary formats: ``bytes -> [(page, total_pages, text)]``."""

    pdf: Callable[[bytes], list[tuple[int, int, str]]] = pdf_pages
    image: Callable[[bytes, str], list[tuple[int, int, str]]] = image_pages
    docx_page_chars: int = 3000
    ocr_language: str = "eng"
    extra: dict[str, Callable[[bytes], list[tuple[int, int, str]]]] = field(default_factory=dict)


def file_kind(path: Column) -> Column:
    """The kind of file by its extension in any case; null where it is not supported."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)\z", 1))
    out = F.lit(None).cast("string")
    for kind, suffixes in reversed(EXTENSIONS.items()):
        out = F.when(suffix.isin(*suffixes), kind).otherwise(out)
    return out


def unfinished(path: Column) -> Column:
    """Whether a file is hidden or a download under way."""
    name = F.lower(F.regexp_extract(path, r"[^/]*\z", 0))
    test = name.startswith(".")
    for suffix in UNFINISHED:
        test = test | name.endswith(suffix)
    return test


def parse_file(kind: str, name: str, content: bytes, parsers: Parsers) -> list[tuple[int, int, str | None, str, str | None]]:
    """(page, total_pages, section_title, text, ocr_lang) of one file."""
    if kind == "html":
        stem = name.rsplit(".", 1)[0]
        return [(p, n, title, text, None) for p, n, title, text in html.sections(content.decode("utf-8", errors="replace"), stem)]
    if kind == "json":
        return [(p, n, None, text, None) for p, n, text in json_docs.documents(content.decode("utf-8"))]
    if kind == "docx":
        return [(p, n, None, text, None) for p, n, text in docx.pages(content, parsers.docx_page_chars)]
    if kind == "image":
        return [(p, n, None, text, parsers.ocr_language) for p, n, text in parsers.image(content, parsers.ocr_language)]
    return [(p, n, None, text, None) for p, n, text in parsers.pdf(content)]


def parse_files(files: DataFrame, parsers: Parsers = Parsers()) -> DataFrame:
    """Documents of ``files(path, content)``. Unsupported files give no row."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, kind, content in zip(pdf["path"], pdf["kind"], pdf["content"]):
                plain = path.split(":", 1)[1] if path.startswith("file:") else path
                name = plain.rsplit("/", 1)[-1]
                try:
                    found = parse_file(kind, name, bytes(content), parsers)
                    rows += [(text, name, plain, page, total, kind, title, lang, None) for page, total, title, text, lang in found]
                    if not found:
                        rows.append((None, name, plain, None, None, kind, None, None, "no text"))
                except Exception as e:  # noqa: BLE001 - any bad file becomes a row
                    rows.append((None, name, plain, None, None, kind, None, None, f"{type(e).__name__}: {e}"[:500]))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            yield out.astype({"page": "Int32", "total_pages": "Int32"})

    known = files.select("path", file_kind(F.col("path")).alias("kind"), "content").filter("kind is not null")
    return known.mapInPandas(parse, SCHEMA)


def _opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(content=[Path(urlparse(p).path).read_bytes() for p in pdf["path"]])


def load(spark: SparkSession, path: str, parsers: Parsers = Parsers(), strict: bool = False) -> DataFrame:
    """Documents of a file, or of all supported files below a folder; hidden ones are included on file: paths.

    A single file of an unsupported type is an error, as is a folder without supported files. With ``strict`` a file
    that cannot be parsed ends the job when its row is read.
    """
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise FileNotFoundError(path)
    suffixes = tuple(s for own in EXTENSIONS.values() for s in own)
    if fs.getFileStatus(at).isFile():
        if not path.lower().endswith(suffixes):
            raise ValueError(f"unsupported file type: {path}")
        files = spark.read.format("binaryFile").load(path)
    else:
        listed, paths = fs.listFiles(at, True), []
        while listed.hasNext():
            p = listed.next().getPath().toString()
            if p.lower().endswith(suffixes):
                paths.append(p)
        if not paths:
            raise FileNotFoundError(f"no supported file below {path}")
        hidden = [p for p in paths if any(part[:1] in "._" for part in p[len(fs.makeQualified(at).toString()) :].split("/") if part)]
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
        if hidden and all(p.startswith("file:") for p in hidden):  # the binary source leaves hidden names out, named or not
            files = files.unionByName(spark.createDataFrame([(p,) for p in hidden], "path string").mapInPandas(_opened, "path string, content binary"))
    out = parse_files(files.select("path", "content"), parsers)
    if strict:
        out = out.filter(F.when(F.col("error").isNotNull() & (F.col("error") != "no text"), F.raise_error(F.concat("source_path", F.lit(": "), "error"))).otherwise(True).cast("boolean"))
    return out
