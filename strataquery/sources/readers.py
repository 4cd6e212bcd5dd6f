"""Sources and sinks: text files, office and image extractors, transcripts, backups."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataquery.functions.text import guess_file_type

#: An image's text needs so many letters or digits; a journal record has at most so many bytes.
OCR_LEAST, RECORD_BYTES = 8, 1024 * 1024

TRANSCRIPT = "type string, version int, sessionId string, createdAt string, turnId string, messageId string, clientMessageId string, text string, timestamp string, status string, attempts int, errorCode string, operationId string, delivery struct<key:string,scopeKey:string,contentHash:string>"


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, file_type, text): whole files as UTF-8; CSV files are text too."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.select("path", guess_file_type(F.col("path")).alias("file_type"), "text")


def _pdf(raw: bytes) -> str:
    from pypdf import PdfReader

    pages = [(p.extract_text() or "").strip() for p in PdfReader(io.BytesIO(raw)).pages]
    return "\n\n".join(p for p in pages if p)


def _docx(raw: bytes) -> str:
    from docx import Document

    return "\n\n".join(p.text for p in Document(io.BytesIO(raw)).paragraphs if p.text.strip())


def _pptx(raw: bytes) -> str:
    from pptx import Presentation

    slides = []
    for number, slide in enumerate(Presentation(io.BytesIO(raw)).slides, 1):
        lines = [line for shape in slide.shapes if shape.has_text_frame for line in shape.text_frame.text.splitlines() if line.strip()]
        if lines:
            slides.append("\n".join([f"[Slide {number}]", *lines]))
    return "\n\n".join(slides)


def _image(raw: bytes) -> str:
    import pytesseract
    from PIL import Image

    return pytesseract.image_to_string(Image.open(io.BytesIO(raw)))


#: Needs the libraries of each type on the executors; a missing one gives its files an error, not the job.
EXTRACTORS: dict[str, Callable[[bytes], str]] = {"markdown": lambda raw: raw.decode("utf-8"), "csv": lambda raw: raw.decode("utf-8"), "pdf": _pdf, "docx": _docx, "pptx": _pptx, "image": _image}


def extract_files(spark: SparkSession, path: str, extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(path, file_type, text, error) of binary files; an unsupported type or a failed extractor gives an error row."""
    table = extractors or EXTRACTORS
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", guess_file_type(F.col("path")).alias("file_type"), "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            texts, errors = [], []
            for kind, raw in zip(pdf["file_type"], pdf["content"]):
                try:
                    if kind not in table:
                        raise ValueError(f"unsupported file type {kind}")
                    texts.append(table[kind](raw))
                    errors.append(None)
                except Exception as e:  # one bad file must not end the job
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"path": pdf["path"], "file_type": pdf["file_type"], "text": texts, "error": errors})

    found = files.mapInPandas(run, "path string, file_type string, text string, error string")
    weak = (F.col("file_type") == "image") & F.col("error").isNull() & ~ocr_passes(F.col("text"))
    return found.select("path", "file_type", F.when(~F.coalesce(weak, F.lit(False)), F.col("text")).alias("text"), F.when(weak, "too little text in the image").otherwise(F.col("error")).alias("error"))


def ocr_passes(text):
    """Quality gate of image text."""
    return F.size(F.regexp_extract_all(text, F.lit("[0-9A-Za-z一-鿿]"), F.lit(0))) >= OCR_LEAST


def parse_journal(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, diagnostics) of journal lines (path, line_no, value): each file counts up to its first bad or oversize record."""
    parsed = lines.select("path", "line_no", "value", F.from_json("value", TRANSCRIPT, {"mode": "PERMISSIVE"}).alias("e"))
    good = F.coalesce((F.octet_length("value") <= RECORD_BYTES) & F.try_parse_json("value").isNotNull() & F.col("e.type").isNotNull(), F.lit(False))
    first = F.min(F.when(~good, F.col("line_no"))).over(W.partitionBy("path"))
    rows = parsed.withColumn("bad", first)
    events = rows.where("bad IS NULL OR line_no < bad").select("path", "line_no", "e.*")
    return events, rows.where("line_no = bad").select("path", "line_no", F.when(F.octet_length("value") > RECORD_BYTES, "oversize record").otherwise("malformed record").alias("diagnostic"))


def read_journals(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Journal files; a journal is one session's file, read whole to number its lines."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
    return parse_journal(whole.where("value <> ''"))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunk sink: only the documents in chunks are replaced; others keep their folders."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").parquet(path)


def write_backup(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """JSON export with a manifest (table, n, fingerprint)."""
    from strataquery.operators.observations import set_fingerprint

    manifest = None
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
        row = set_fingerprint(df, df.columns).select(F.lit(name).alias("table"), F.coalesce("n", F.lit(0)).alias("n"), "fingerprint")
        manifest = row if manifest is None else manifest.unionByName(row)
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def restore_backup(spark: SparkSession, path: str, schemas: dict[str, object]) -> dict[str, DataFrame]:
    """Tables of an export; a table that differs from the manifest raises."""
    from strataquery.operators.observations import set_fingerprint

    told = {r["table"]: (r["n"], r["fingerprint"]) for r in spark.read.json(f"{path}/manifest").collect()}  # one row a table
    out = {}
    for name, schema in schemas.items():
        df = spark.read.schema(schema).json(f"{path}/{name}")
        got = set_fingerprint(df, df.columns).first()
        if (got["n"] or 0, got["fingerprint"]) != told[name]:
            raise ValueError(f"backup of {name} does not match its manifest")
        out[name] = df
    return out
