"""Digital PDF files: text blocks as units.  Needs the optional library ``fitz``; without it, reading raises ImportError."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..shared import ship

SCHEMA = "path string, ord int, unit_id string, segments array<string>, page int, block int, bbox array<double>, font string, size double, color int, error string"


def blocks_of(data: bytes) -> list[tuple]:
    """Text blocks with the style of their first span: lines joined by a line break, blank ones left out."""
    import fitz

    rows = []
    with fitz.open(stream=data, filetype="pdf") as doc:
        if doc.needs_pass:
            raise ValueError("password needed")
        for p, page in enumerate(doc):
            for b, block in enumerate(page.get_text("dict")["blocks"]):
                if block.get("type") != 0:
                    continue
                spans = [s for line in block["lines"] for s in line["spans"]]
                text = "\n".join(t for line in block["lines"] if (t := "".join(s["text"] for s in line["spans"])))
                if text.strip():
                    rows.append((f"pdf-{p}-{b}", [text], p, b, [float(x) for x in block["bbox"]], spans[0]["font"], float(spans[0]["size"]), int(spans[0]["color"])))
    if not rows:
        raise ValueError("no text")
    return rows


def scan_pdf(spark: SparkSession, path: str) -> DataFrame:
    """Units of all files under a path; a file that cannot be read gives one row with the reason in ``error``."""
    import fitz  # noqa: F401

    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, data in zip(b["path"], b["content"]):
                try:
                    rows += [(path, i, *r, None) for i, r in enumerate(blocks_of(bytes(data)))]
                except Exception as e:  # noqa: BLE001 - a bad file is a row, not a failed job
                    rows.append((path, 0, None, None, None, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)
