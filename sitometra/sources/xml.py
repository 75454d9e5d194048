"""Marked-up editions and their metadata: from files to rows.

Mixed content is what needs Python here, in one pass over each file.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TEI = "{http://www.tei-c.org/ns/1.0}"
#: Elements that are blocks; elements that become marks in a block's values.
BLOCKS, MARKS = ("ab", "p", "seg", "l"), ("lb", "cb", "pb")
BLOCK_SCHEMA = "path string, ddb_id string, div_idx int, block_idx int, block_tag string, raw_text string, value_text string, num_values array<string>, num_texts array<string>, num_tag_count int"
META_SCHEMA = "path string, ddb_id string, Title string, Place string, Date_Text string, Date_When string, Date_NotBefore string, Date_NotAfter string"
#: Files whose rows are held at once by a task.
_FILES = 500
_TYPES = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def _rows_of(files: DataFrame, rows_of, schema: str) -> DataFrame:
    """The rows that rows_of gives for each path and content, a few files at a time. ParseError and TypeError give none."""
    fields = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in schema.split(", ")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _FILES):
                part, out = batch.slice(at, _FILES), []
                for path, content in zip(part["path"], part["content"], strict=True):
                    try:
                        out += rows_of(path.as_py(), content.as_py())
                    except (ET.ParseError, TypeError):
                        continue
                columns = zip(*out, strict=True) if out else [()] * len(fields)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    return files.select("path", "content").mapInArrow(work, schema)


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """path and content of every *.xml below folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").load(folder)
    return files.select("path", "content")


def relative_path(path, root: str):
    """Path below root, with slashes."""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "^.*?" + root.strip("/").replace(".", r"\.") + "/", "")


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _text(e: ET.Element | None) -> str:
    return "".join(e.itertext()).strip() if e is not None else ""


def document_id(root: ET.Element) -> str:
    """The first idno of type ddb-hybrid that says something, else the first idno."""
    every = list(root.iter(f"{TEI}idno"))
    typed = [_text(e) for e in every if e.get("type") == "ddb-hybrid"]
    return next((t for t in typed[:1] if t), _text(every[0]) if every else "")


def value_text(block: ET.Element, join_inline: bool = False) -> str:
    """The block's text with numbers for their words and marks for breaks; a blank at every edge of an element, unless join_inline."""
    pieces: list[str] = [block.text or ""]

    def walk(e: ET.Element) -> None:
        name = _local(e)
        if name == "num" and (e.get("value") or "").strip():
            pieces.append(f" {e.get('value').strip()} ")
        elif name == "num":
            pieces.append(_text(e))
        elif name in MARKS:
            pieces.append(f" __{name.upper()}__ ")
        elif name:
            pieces.append(e.text or "")
            for child in e:
                walk(child)
        pieces.append(e.tail or "")

    for child in block:
        walk(child)
    return " ".join(("" if join_inline else " ").join(pieces).split())


def document_blocks(content: bytes, scan_commentary: bool = False, join_inline: bool = False) -> tuple[str, list[tuple]]:
    """Id and blocks of a document: nested blocks are blocks too. Raises ParseError."""
    root = ET.fromstring(content)
    kinds = ("edition", "commentary") if scan_commentary else ("edition",)
    rows = []
    divs = [d for d in root.iter(f"{TEI}div") if d.get("type") in kinds]
    for i, div in enumerate(divs):
        blocks = [e for e in div.iter() if e is not div and _local(e) in BLOCKS and e.tag.startswith(TEI)]
        for j, block in enumerate(blocks):
            nums = [e for e in block.iter(f"{TEI}num") if e.get("value") is not None and e is not block]
            values = [v for e in nums if (v := e.get("value").strip())]
            texts = [t for e in nums if (t := _text(e))]
            rows.append((i, j, _local(block), _text(block), value_text(block, join_inline), values, texts, len(nums)))
    return document_id(root), rows


def parse_blocks(files: DataFrame, scan_commentary: bool = False, join_inline: bool = False) -> DataFrame:
    """One row per block that has text (BLOCK_SCHEMA). Files that are not well formed have none."""

    def rows_of(path: str, content: bytes) -> list[tuple]:
        name, rows = document_blocks(content, scan_commentary, join_inline)
        return [(path, name, *r) for r in rows if r[3]]

    return _rows_of(files, rows_of, BLOCK_SCHEMA)


def parse_status(files: DataFrame) -> DataFrame:
    """path and parsed: whether the file is well formed."""

    def rows_of(path: str, content: bytes) -> list[tuple]:
        try:
            ET.fromstring(content)
        except (ET.ParseError, TypeError):
            return [(path, False)]
        return [(path, True)]

    return _rows_of(files, rows_of, "path string, parsed boolean")


def parse_metadata(files: DataFrame) -> DataFrame:
    """One row per metadata file that has an id (META_SCHEMA); what is missing is empty."""

    def rows_of(path: str, content: bytes) -> list[tuple]:
        root = ET.fromstring(content)
        first = lambda p: root.find(f".//{TEI}{p}")
        date = first("origDate")
        of = lambda a: (date.get(a) or "").strip() if date is not None else ""
        row = (path, document_id(root), _text(root.find(f".//{TEI}titleStmt/{TEI}title")), _text(first("origPlace")), _text(date), of("when"), of("notBefore"), of("notAfter"))
        return [row] if row[1] else []

    return _rows_of(files, rows_of, META_SCHEMA)


def latest_metadata(meta: DataFrame) -> DataFrame:
    """One row per id: that of the last path."""
    last = Window.partitionBy("ddb_id").orderBy(F.desc("path"))
    return meta.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "path")


def with_metadata(docs: DataFrame, meta: DataFrame) -> DataFrame:
    """docs (ddb_id) with metadata, empty where there is none. Spark sends meta to all tasks if it is small enough."""
    names = [c for c in meta.columns if c != "ddb_id"]
    return docs.join(meta, "ddb_id", "left").na.fill("", names)
