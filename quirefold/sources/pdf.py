"""PDF pages, where a PDF library is installed on the executors (an optional extra; PyMuPDF)."""

from __future__ import annotations

import hashlib
import importlib.util

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

PAGES = "document_id string, page_number int, text string, image_count int, status string"


def available() -> bool:
    return importlib.util.find_spec("fitz") is not None


def read_pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row a page: its text, images and status; a page that cannot be read stays, as ``unresolved``."""
    if not available():
        raise ImportError("reading PDF needs PyMuPDF (fitz), which is not installed; give pages as text instead")

    def scan(batches):
        import fitz

        for pdf in batches:
            rows = []
            for raw in pdf["content"]:
                key = hashlib.sha256(raw).hexdigest()[:16]
                with fitz.open(stream=raw, filetype="pdf") as file:
                    for k in range(file.page_count):
                        try:
                            page = file.load_page(k)
                            text, images = page.get_text(), len(page.get_images())
                            size = len(text.strip())
                            rows.append((key, k + 1, text, images, "no_text" if not size else "low_text" if size < 50 else "ok"))
                        except Exception:  # a broken page must not lose its document
                            rows.append((key, k + 1, "", 0, "unresolved"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PAGES.split(", ")])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("content").mapInPandas(scan, PAGES)
