"""Evidence files into numbered text segments, by extension; what cannot be read gives a FAILED row.

A file is one row of (path, content) and is parsed in one piece by the task that holds it, so files, not
their rows, are what is spread over the cluster. Defined results: content without segments gives one OK row
with number 0 (the file source passes over files of no bytes); rows of blank cells only are passed over and not counted; undecodable bytes are replaced.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Formats by extension (fixed values).
FORMATS = {
    ".pdf": "PDF",
    ".txt": "TEXT",
    ".csv": "CSV",
    ".xlsx": "XLSX",
    ".xls": "XLSX",
    ".json": "JSON",
    ".jpg": "IMAGE",
    ".jpeg": "IMAGE",
    ".png": "IMAGE",
}
SCHEMA = "path string, file_type string, status string, segment_no int, text string, error string"


def text_lines(content: str) -> Iterator[tuple[int, str]]:
    """Non-blank lines, trimmed, with their number from 1."""
    for n, line in enumerate(content.splitlines(), 1):
        if line.strip():
            yield n, line.strip()


def csv_rows(content: str) -> Iterator[tuple[int, str]]:
    """Rows below the header from 1: ``name: cell`` of non-blank cells, or all cells where the width differs from the header's."""
    rows = csv.reader(io.StringIO(content.removeprefix("﻿"), newline=""))
    names, n = next(rows, None), 0
    for cells in rows:
        if not any(c.strip() for c in cells):
            continue
        n += 1
        if names and len(names) == len(cells):
            yield n, "; ".join(f"{k}: {v}" for k, v in zip(names, cells) if v.strip())
        else:
            yield n, ", ".join(cells)


def _flat(item: object) -> str:
    if not isinstance(item, dict):
        return str(item)
    return "; ".join(f"{k}: {v}" for k, v in item.items() if v is not None and str(v).strip())


def json_items(content: str) -> Iterator[tuple[int, str]]:
    """Items of a list from 1; of an object, the items of each list under ``[key]`` and every other value as item 1."""
    data = json.loads(content)
    if isinstance(data, list):
        yield from ((n, t) for n, t in enumerate(map(_flat, data), 1) if t)
    elif isinstance(data, dict):
        for key, value in data.items():
            if isinstance(value, list):
                yield from ((n, f"[{key}] {_flat(x)}") for n, x in enumerate(value, 1))
            else:
                yield 1, f"{key}: {value}"
    else:
        yield 1, str(data)


READERS = {"TEXT": text_lines, "CSV": csv_rows, "JSON": json_items}


def _read(path: str, content: bytes | None) -> list[tuple]:
    dot = path.rfind(".", path.rfind("/") + 1)
    ext = path[dot:].lower() if dot >= 0 else ""
    kind = FORMATS.get(ext)
    if content is None:
        return [(path, kind, "FAILED", 0, None, "no content")]
    if kind is None:
        return [(path, None, "FAILED", 0, None, f"unsupported extension: {ext}")]
    if kind not in READERS:
        return [(path, kind, "FAILED", 0, None, f"no reader for {kind} here")]
    try:
        rows = [(path, kind, "OK", n, t, None) for n, t in READERS[kind](bytes(content).decode("utf-8", "replace"))]
    except (ValueError, csv.Error, RecursionError) as e:
        return [(path, kind, "FAILED", 0, None, f"parsing: {type(e).__name__}")]
    return rows or [(path, kind, "OK", 0, None, None)]


def segments(files: DataFrame) -> DataFrame:
    """(path, file_type, status, segment_no, text, error) of rows (path, content); a failing file fails alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in batches:
            rows: list[tuple] = []
            for path, content in zip(b["path"], b["content"]):
                rows += _read(path, content)
                if len(rows) >= 10_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    return files.where("path is not null").select("path", "content").mapInPandas(run, SCHEMA)


def read_files(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """``segments`` of all files under a folder."""
    return segments(spark.read.format("binaryFile").options(recursiveFileLookup="true", **options).load(path))
