"""MIME type of a file from its bytes, its declaration or its name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailspark.functions.text import file_extension

DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
FALLBACK = "application/octet-stream"

# Types by extension, for files whose bytes tell nothing.
BY_EXTENSION = {
    ".txt": "text/plain", ".log": "text/plain", ".csv": "text/csv", ".json": "application/json",
    ".html": "text/html", ".htm": "text/html", ".eml": "message/rfc822", ".docx": DOCX,
    ".pdf": "application/pdf", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg",
    ".zip": "application/zip",
}

# Leading bytes.
SIGNATURES = {
    "25504446": "application/pdf",
    "89504E470D0A1A0A": "image/png",
    "FFD8FF": "image/jpeg",
    "504B0304": "application/zip",
    "504B0506": "application/zip",
}

_HTML = r"(?is)^\s*(<!--.*?-->\s*)?<(!doctype html|html|head|body|title)\b"
_MAIL = r"^(Return-Path|Received|From|Message-ID|Delivered-To|MIME-Version|Date|Subject|To): "


# How many lines decide on CSV, as the common file-type tools do it.
CSV_LINES = 10


def _is_csv(text: Column, lines: int = CSV_LINES) -> Column:
    """At least two lines that are not empty, and the first ``lines`` of them agree on
    a positive comma count. Nothing after them is read."""
    head = F.regexp_extract(text, rf"^(?:[\r\n]*+[^\n]+){{1,{lines}}}", 0)
    found = F.filter(F.split(head, "\r?\n"), lambda line: line != "")
    commas = F.transform(found, lambda line: F.regexp_count(line, F.lit(",")))
    return (F.size(found) >= 2) & (F.array_min(commas) > 0) & (F.array_min(commas) == F.array_max(commas))


def _text_type(content: Column) -> Column:
    text = content.cast("string")
    readable = F.is_valid_utf8(text) & ~text.contains("\0") & (F.length(content) > 0)
    is_json = text.rlike(r"^\s*[\[{]") & F.try_parse_json(text).isNotNull()
    kind = (
        F.when(text.rlike(_HTML), "text/html")
        .when(is_json, "application/json")
        .when(text.rlike(_MAIL), "message/rfc822")
        .when(_is_csv(text), "text/csv")
        .otherwise("text/plain")
    )
    return F.when(readable, kind)


def magic_type(content: Column) -> Column:
    """The type the bytes reveal, or NULL."""
    head = F.hex(F.substring(content, 1, 8))
    found = F.lit(None).cast("string")
    for signature, mime in SIGNATURES.items():
        found = F.when(head.startswith(signature), mime).otherwise(found)
    # Word files are zip archives with a word/ folder.
    found = F.when((found == "application/zip") & F.contains(content, F.lit(b"word/")), DOCX).otherwise(found)
    return F.coalesce(found, _text_type(content))


def detect_mime(content: Column, declared: Column, filename: Column) -> Column:
    by_name = F.element_at(
        F.create_map(*[F.lit(v) for pair in BY_EXTENSION.items() for v in pair]), file_extension(filename),
    )
    return F.coalesce(magic_type(content), F.nullif(declared, F.lit("")), by_name, F.lit(FALLBACK))
