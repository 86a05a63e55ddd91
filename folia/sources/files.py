"""Files of several formats as pages, one row each, with failures as rows.

``read_documents`` lists files with Spark's binaryFile source and parses each in an
Arrow task. Parsers are looked up by extension in PARSERS; more can be registered.
Word (.docx) and Excel (.xlsx) files are read from their XML with the standard
library. PDF, HWP, .doc and .xls need a parser that isn't installed here; until one
is registered such files come back with status ``error``.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.functions.keys import document_id

#: A parsed page: number, title, text, and its tables as rows of cells.
Page = tuple[int, str, str, list[list[list[str]]]]
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PARSER_VERSION = "folia-1"


def parse_docx(content: bytes) -> list[Page]:
    """Paragraphs and tables of a Word document, in order, as one page."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    lines, tables = [], []
    for part in body if body is not None else []:
        if part.tag == f"{_W}p":
            lines.append(words(part))
        elif part.tag == f"{_W}tbl":
            rows = [[" ".join(words(p) for p in cell.iter(f"{_W}p")).strip() for cell in row.iter(f"{_W}tc")] for row in part.iter(f"{_W}tr")]
            tables.append(rows)
            lines += [" | ".join(r) for r in rows]
    text = "\n".join(x for x in lines if x.strip())
    return [(1, text.split("\n")[0][:200], text, tables)]


def _cell(cell: ElementTree.Element, strings: list[str], dates: set[int]) -> str:
    kind, value = cell.get("t"), cell.findtext(f"{_S}v") or ""
    if kind == "s":
        return strings[int(value)] if value else ""
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_S}t"))
    if kind == "b":
        return "TRUE" if value == "1" else "FALSE"
    if value and kind in (None, "n"):
        if int(cell.get("s") or -1) in dates:
            day = datetime(1899, 12, 30) + timedelta(days=float(value))
            return day.date().isoformat() if float(value).is_integer() else day.isoformat(timespec="seconds")
        number = float(value)
        return str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)
    return value


def parse_xlsx(content: bytes) -> list[Page]:
    """Each sheet as a page; rows without text are dropped, date cells become ISO dates."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        load = lambda name: ElementTree.fromstring(z.read(name)) if name in names else None
        shared = load("xl/sharedStrings.xml")
        strings = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in shared] if shared is not None else []
        styles, dates = load("xl/styles.xml"), set()
        if styles is not None:
            custom = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{_S}numFmt")}
            formats = styles.find(f"{_S}cellXfs")
            for i, xf in enumerate(formats if formats is not None else []):
                n = int(xf.get("numFmtId") or 0)
                if 14 <= n <= 22 or re.search(r"[dyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", custom.get(n, "")), re.IGNORECASE):
                    dates.add(i)
        links = {r.get("Id"): r.get("Target") for r in (load("xl/_rels/workbook.xml.rels") or [])}
        pages: list[Page] = []
        for i, sheet in enumerate(load("xl/workbook.xml").iter(f"{_S}sheet"), start=1):
            target = links.get(sheet.get(f"{_R}id"), f"worksheets/sheet{i}.xml").lstrip("/")
            data = load(target if target.startswith("xl/") else f"xl/{target}")
            rows = []
            for row in data.iter(f"{_S}row") if data is not None else []:
                cells: list[str] = []
                for cell in row.iter(f"{_S}c"):
                    letters = re.match(r"[A-Z]+", cell.get("r") or "")
                    at = sum((ord(c) - 64) * 26**k for k, c in enumerate(reversed(letters[0]))) - 1 if letters else len(cells)
                    cells += [""] * (at - len(cells)) + [_cell(cell, strings, dates)]
                if any(c.strip() for c in cells):
                    rows.append(cells)
            pages.append((i, sheet.get("name") or "", "\n".join(" | ".join(r) for r in rows), [rows] if rows else []))
    return pages


def parse_text(content: bytes) -> list[Page]:
    text = content.decode("utf-8", "replace").replace("\r\n", "\n")
    return [(i, p.strip().split("\n")[0][:200], p, []) for i, p in enumerate(text.split("\f"), start=1)]


PARSERS: dict[str, Callable[[bytes], list[Page]]] = {"docx": parse_docx, "xlsx": parse_xlsx, "txt": parse_text, "md": parse_text}

_SCHEMA = (
    "doc_id string, filename string, filepath string, file_type string, file_size bigint, status string, error string, parser_version string, "
    "page_num int, page_title string, text string, tables array<array<array<string>>>"
)


def register_parser(extension: str, parse: Callable[[bytes], list[Page]]) -> None:
    """Read files of ``extension`` (without dot) with ``parse``."""
    PARSERS[extension.lower()] = parse


def first_success(*attempts: Callable[[bytes], list[Page]]) -> Callable[[bytes], list[Page]]:
    """A parser that tries several, in order, and fails with all their errors."""

    def parse(content: bytes) -> list[Page]:
        errors = []
        for attempt in attempts:
            try:
                return attempt(content)
            except Exception as e:  # noqa: BLE001  any parser's failure leads to the next
                errors.append(f"{getattr(attempt, '__name__', 'parser')}: {e}")
        raise ValueError("; ".join(errors))

    return parse


def read_documents(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """A row per page of the files below ``path``. A file that can't be parsed is one row with status ``error``; one without text is ``partial``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    parsers = dict(PARSERS)
    named = files.select(document_id(F.col("path")).alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("path").alias("filepath"), "length", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            *((n, pa.string()) for n in ("doc_id", "filename", "filepath", "file_type")), ("file_size", pa.int64()), *((n, pa.string()) for n in ("status", "error", "parser_version")),
            ("page_num", pa.int32()), ("page_title", pa.string()), ("text", pa.string()), ("tables", pa.list_(pa.list_(pa.list_(pa.string())))),
        ])
        for batch in batches:
            for doc, name, where, size, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kind = name.rpartition(".")[2].lower()
                head = (doc, name, where, kind, size)
                try:
                    if kind not in parsers:
                        raise ValueError(f"no parser for .{kind}")
                    pages = parsers[kind](content)
                    status = "success" if any(p[2].strip() for p in pages) else "partial"
                    rows = [(*head, status, None, PARSER_VERSION, *p) for p in pages] or [(*head, "partial", None, PARSER_VERSION, None, None, "", [])]
                except Exception as e:  # noqa: BLE001  a bad file must not end the job
                    rows = [(*head, "error", f"{type(e).__name__}: {e}"[:500], PARSER_VERSION, None, None, None, None)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return named.mapInArrow(run, _SCHEMA)


def read_json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Cached JSON results, a file each; a file that isn't the schema's JSON is a row with ``status`` error. The id is the payload's or the file's stem."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    return rows.withColumn("doc_id", F.coalesce(F.nullif("doc_id", F.lit("")), stem)).withColumn("status", F.when(F.col("_corrupt_record").isNotNull(), "error").otherwise("success"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON objects; empty lines are skipped, any other line that isn't one fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def latest_per_name(*sidecars: DataFrame, name: str = "filename") -> DataFrame:
    """The union of sidecar tables in which a later table's row replaces an earlier one's of the same name."""
    from pyspark.sql import Window

    rows = None
    for order, one in enumerate(sidecars):
        one = one.withColumn("__order", F.lit(order))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    last = F.row_number().over(Window.partitionBy(name).orderBy(F.desc("__order")))
    return rows.withColumn("__row", last).filter("__row = 1").drop("__row", "__order")


def valid_cache(cached: DataFrame, version: str = PARSER_VERSION, required: tuple[str, ...] = ("text",)) -> DataFrame:
    """Cached rows of the current version that have all required columns."""
    keep = F.col("parser_version") == version
    for c in required:
        keep = keep & F.col(c).isNotNull()
    return cached.filter(keep)


def listing(files: DataFrame, cached: DataFrame) -> DataFrame:
    """Files with their cache's status; ``pending`` where nothing is cached."""
    known = cached.select("doc_id", F.col("status").alias("cached")).distinct()
    return files.join(known, "doc_id", "left").select(files["*"], F.coalesce("cached", F.lit("pending")).alias("status"))


def base_records(files: DataFrame) -> DataFrame:
    """id, filename, filepath, file_type, file_size of files (path, length): what every parsed document begins with."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.select(F.md5(F.col("path").cast("binary")).alias("id"), name.alias("filename"), F.col("path").alias("filepath"), F.lower(F.regexp_extract(name, r"[^.]\.([^.]*)$", 1)).alias("file_type"), F.col("length").alias("file_size"))


def settings(spark: SparkSession, path: str) -> DataFrame:
    """name, value of a small file of ``name=value`` lines; comments and lines without ``=`` passed over, quotes taken off, the last of equal names counts.

    Spark's readers pass over files whose names begin with a dot, so it is opened through Hadoop's file system.
    """
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).open(target)
    try:
        whole = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    text = spark.createDataFrame([(whole,)], "whole string").select(F.posexplode(F.split("whole", "\\r?\\n")).alias("n", "value"))
    lines = text.select(F.trim("value").alias("line"), "n").filter(F.col("line").contains("=") & ~F.col("line").startswith("#"))
    value = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_extract("line", r"^[^=]*=(.*)$", 1)), '^"+|"+$', ""), "^'+|'+$", "")
    rows = lines.select(F.trim(F.regexp_extract("line", r"^([^=]*)=", 1)).alias("name"), value.alias("value"), "n")
    return rows.groupBy("name").agg(F.max_by("value", "n").alias("value"))


def write_cache(documents: DataFrame, root: str) -> None:
    """Parsed documents (doc_id and more) as JSON lines for ``read_cached`` readers; a run replaces the one before it."""
    documents.write.mode("overwrite").option("ignoreNullFields", "false").json(root)
