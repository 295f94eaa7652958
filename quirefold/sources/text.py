"""Paged text, questions and evaluation items as DataFrames."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

VIRTUAL_PAGE, LEAST_PAGE = 8_000, 500
ENCODINGS = ("utf-8-sig", "cp949", "euc-kr", "latin-1")


def decode_bytes(raw: bytes) -> str:
    """Text of a file: UTF-16 if its mark says so, else (or where that fails) the first encoding that fits."""
    marked = ("utf-16",) if raw[:2] in (b"\xff\xfe", b"\xfe\xff") else ()
    for name in (*marked, *ENCODINGS):
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    raise AssertionError("latin-1 reads anything")


def unescaped(text: Column) -> Column:
    """Serialised exports hold ``\\n`` as two characters; they become line ends only where they dominate.  Line ends are levelled."""
    count = lambda part: (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)
    escaped, real = count("\\n"), count("\n")
    marked = F.contains(F.lower(text), F.lit("page-start-marker-"))
    dominate = (marked & (real == 0) & (escaped >= 2)) | ((escaped >= 10) & (escaped > F.greatest(4 * real, F.lit(20))))
    plain = text
    for code, mark in (("\\r\\n", "\n"), ("\\n", "\n"), ("\\r", "\n"), ('\\"', '"')):
        plain = F.replace(plain, F.lit(code), F.lit(mark))
    levelled = F.when(dominate, plain).otherwise(text)
    return F.replace(F.replace(levelled, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def virtual_pages(text: str, target: int = VIRTUAL_PAGE) -> list[str]:
    """Pages of about ``target`` characters: form feeds end one, paragraphs stay whole where they fit, then lines, then slices."""
    if target < LEAST_PAGE:
        raise ValueError(f"a virtual page holds at least {LEAST_PAGE} characters")

    def pieces(block: str):
        if len(block) <= target:
            yield block
            return
        held = ""
        for line in block.split("\n"):
            for k in range(0, max(len(line), 1), target):
                part = line[k : k + target]
                if held and len(held) + 1 + len(part) > target:
                    yield held
                    held = part
                else:
                    held = f"{held}\n{part}" if held else part
        if held:
            yield held

    out: list[str] = []
    for sheet in text.split("\f"):
        held = ""
        for block in re.split(r"\n\s*\n", sheet):
            for part in pieces(block.strip("\n")) if block.strip() else ():
                if held and len(held) + 2 + len(part) > target:
                    out.append(held)
                    held = part
                else:
                    held = f"{held}\n\n{part}" if held else part
        if held.strip():
            out.append(held)
    return out


def split_pages(documents: DataFrame, target: int = VIRTUAL_PAGE) -> DataFrame:
    """``(document_id, text)`` as ``(document_id, page_number, text)``: by page markers (the first of a number counts), else virtual pages."""
    mark = r"(?i)<!--\s*page-start-marker-(\d+)\s*-->"
    clean = documents.select("document_id", unescaped(F.coalesce("text", F.lit(""))).alias("text"))
    numbers = F.transform(F.regexp_extract_all("text", F.lit(mark), 1), lambda n: n.cast("int"))
    bodies = F.transform(F.slice(F.split("text", mark), 2, 1 << 30), lambda t: F.regexp_replace(t, r"^\s+|\s+$", ""))
    marked = clean.where(F.col("text").rlike(mark)).select("document_id", F.posexplode(F.arrays_zip(numbers.alias("n"), bodies.alias("t"))).alias("at", "p"))
    first = marked.select("document_id", "at", F.col("p.n").alias("page_number"), F.col("p.t").alias("text")).withColumn("k", F.row_number().over(W.partitionBy("document_id", "page_number").orderBy("at"))).where("k = 1")

    def cut(batches):
        for pdf in batches:
            rows = [(i, k, p) for i, t in zip(pdf["document_id"], pdf["text"], strict=True) for k, p in enumerate(virtual_pages(t, target), 1)]
            yield pd.DataFrame(rows, columns=["document_id", "page_number", "text"])

    virtual = clean.where(~F.col("text").rlike(mark)).mapInPandas(cut, "document_id string, page_number int, text string")
    return first.select("document_id", "page_number", "text").unionByName(virtual)


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(document_id, file_hash, filename, text)`` of text files; others, and empty ones, are an error."""

    @F.pandas_udf("string")
    def decoded(raw: pd.Series) -> pd.Series:
        return raw.map(decode_bytes)

    files = spark.read.format("binaryFile").load(path)
    read = files.select(F.substring(F.sha2("content", 256), 1, 16).alias("document_id"), F.substring(F.sha2("content", 256), 1, 32).alias("file_hash"), F.element_at(F.split("path", "/"), -1).alias("filename"), decoded("content").alias("text"))
    wrong = (~F.lower("filename").endswith(".txt")) | (F.trim("text") == "")
    return read.withColumn("text", F.when(wrong, F.raise_error(F.concat(F.lit("no text file, or an empty one: "), "filename")).cast("string")).otherwise(F.col("text")))


def questions_from_text(lines: list[str]) -> list[tuple[str, str]]:
    """(id, question) of lines ``q07: ...``, tab- or bar-separated, or plain; a plain line is numbered by its place."""
    out = []
    for k, line in enumerate(lines, 1):
        if text := line.strip():
            m = re.match(r"^([qQ]\w*\d\w*)\s*[:\t|]\s*(.+)$", text)
            out.append((m[1], m[2].strip()) if m else (f"q{k:02d}", text))
    return _unique(out)


def question_categories(data: list | dict) -> dict[str, str]:
    """Category by question id, of those that state one."""
    items = data if isinstance(data, list) else data.get("questions", [])
    return {i: q["category"] for (i, _), q in zip(questions_from_json(data), items, strict=True) if q.get("category")}


def parsed_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages that were parsed before: JSON documents, each an array of pages or an object with ``pages``, or Parquet."""
    page = "array<struct<document_id:string,page_number:int,text:string>>"
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path).select("document_id", F.col("page_number").cast("int").alias("page_number"), "text")
    whole = spark.read.text(path, wholetext=True).select(F.when(F.col("value").rlike(r"^\s*\["), F.col("value")).otherwise(F.get_json_object("value", "$.pages")).alias("json"))
    return whole.select(F.explode(F.from_json("json", page)).alias("p")).select("p.*")


def unresolved_pages(quality: DataFrame) -> DataFrame:
    """Pages whose text is missing, or was marked unresolved."""
    return quality.where(F.col("status").isin("no_text", "unresolved"))


def questions_from_json(data: list | dict) -> list[tuple[str, str]]:
    items = data if isinstance(data, list) else data.get("questions", [])
    return _unique([(str(q.get("id") or q.get("question_id") or f"q{k:02d}"), q.get("question") or q.get("text") or "") for k, q in enumerate(items, 1)])


def _unique(rows: list[tuple[str, str]]) -> list[tuple[str, str]]:
    ids = [i for i, _ in rows]
    if twice := sorted({i for i in ids if ids.count(i) > 1}):
        raise ValueError(f"question ids repeat: {', '.join(twice)}")
    return rows


def evaluation_items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("question_id string, question string, question_type string, reference_answer string, required_key_points array<string>").json(path)
