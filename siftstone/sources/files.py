"""Document trees to sections: one scan of bytes, text extraction by format in Arrow batches, bad files set aside.

A file that cannot be read never fails the job: its row goes to the quarantine with the error.  UTF-8 is read with bad
bytes left out.  PDF needs the optional package pypdf where the executors run; without it PDF files are quarantined.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.functions import text as T

#: Elements whose content is no text of a page.  Fixed values.
HIDDEN = ("script", "style", "nav", "footer")

Section = tuple[int | None, str | None, str]


class _Visible(HTMLParser):
    """Visible text, one piece a line, and the title."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.title: list[str] = []
        self.hidden = 0
        self.in_title = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.hidden += tag in HIDDEN
        self.in_title |= tag == "title"

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN and self.hidden:
            self.hidden -= 1
        if tag == "title":
            self.in_title = False

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title.append(data)
        if not self.hidden and data.strip():
            self.pieces.append(data.strip())


def read_html(content: bytes) -> list[Section]:
    page = _Visible()
    page.feed(content.decode("utf-8", "ignore"))
    page.close()
    return [(None, "".join(page.title).strip() or None, "\n".join(page.pieces))]


def read_plain(content: bytes) -> list[Section]:
    return [(None, None, content.decode("utf-8", "ignore"))]


def read_docx(content: bytes) -> list[Section]:
    """Paragraph texts, one a line."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml"))
    paragraphs = ("".join(t.text or "" for t in p.iter(f"{space}t")) for p in body.iter(f"{space}p"))
    return [(None, None, "\n".join(paragraphs))]


def read_pdf(content: bytes) -> list[Section]:
    """A section a page that has text; a page that fails is left out."""
    import pypdf

    reader = pypdf.PdfReader(io.BytesIO(content))
    title, found = (reader.metadata or {}).get("/Title") or None, []
    for number, page in enumerate(reader.pages, 1):
        try:
            found.append((number, title, page.extract_text() or ""))
        except Exception:  # noqa: BLE001, PERF203  one bad page
            continue
    return found


READERS: dict[str, Callable[[bytes], list[Section]]] = {".pdf": read_pdf, ".html": read_html, ".htm": read_html, ".docx": read_docx}


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(source, suffix, content) of all supported files below ``root``; none at all is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    named = files.select(T.relative_path(F.col("path"), root).alias("source"), T.suffix(F.col("path")).alias("suffix"), "content")
    found = named.where(F.col("suffix").isin(*T.SUFFIXES))
    if found.select("source").isEmpty():
        raise FileNotFoundError(f"no supported file below {root}")
    return found


def extract(files: DataFrame, readers: dict[str, Callable[[bytes], list[Section]]] | None = None) -> DataFrame:
    """(source, page, title, text, error) from (source, suffix, content); suffixes without a reader of their own are plain text.

    ``readers``: by suffix, beside or instead of READERS.
    """
    known = READERS | (readers or {})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for source, suffix, content in frame.itertuples(index=False):
                try:
                    rows += [(source, page, title, text, None) for page, title, text in known.get(suffix, read_plain)(bytes(content or b""))]
                except Exception as error:  # noqa: BLE001  the file goes to quarantine
                    rows.append((source, None, None, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["source", "page", "title", "text", "error"]).astype({"page": "Int32"})

    return files.mapInPandas(run, "source string, page int, title string, text string, error string")


def load_directory(spark: SparkSession, root: str, readers: dict[str, Callable[[bytes], list[Section]]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Sections (source, page, title, text) with cleaned, non-empty text, and the quarantine (source, error)."""
    return sections_of(extract(scan(spark, root), readers))


def sections_of(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    title = F.coalesce(T.blank_to_null(F.col("title")), T.title_from_path(F.col("source")))
    sections = read.where("error is null").select("source", "page", title.alias("title"), T.clean_text(F.col("text")).alias("text")).where("text <> ''")
    return sections, read.where("error is not null").select("source", "error")


def golden_set(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Questions as a table; ``question`` and ``relevant_sources`` are required of each."""
    for number, row in enumerate(rows):
        if not row.get("question") or not row.get("relevant_sources"):
            raise ValueError(f"golden question {number} needs question and relevant_sources")
    data = [(n, r["question"], list(r["relevant_sources"]), list(r["must_contain"]) if r.get("must_contain") else None, list(r.get("tags") or [])) for n, r in enumerate(rows)]
    return spark.createDataFrame(data, "qid bigint, question string, relevant_sources array<string>, must_contain array<string>, tags array<string>")


def read_golden_set(spark: SparkSession, path: str) -> DataFrame:
    """A golden set from a JSON or YAML file of this machine; an empty file has no questions."""
    import json

    with open(path, encoding="utf-8") as file:
        text = file.read()
    if path.endswith(".json"):
        rows = json.loads(text) if text.strip() else []
    else:
        import yaml

        rows = yaml.safe_load(text) or []
    return golden_set(spark, rows)
