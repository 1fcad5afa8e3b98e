"""Text of attachments, in Arrow batches, routed by MIME type."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable
from email import message_from_bytes, policy
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailspark.functions.html import strip_tags
from mailspark.functions.mime import DOCX
from mailspark.functions.text import drop_nul, normalize_text, strip

# Types read as plain text, and archive members worth reading.
PLAIN_TYPES = ("text/csv", "text/plain", "application/x-wine-extension-ini")
MEMBER_ENDINGS = (".txt", ".log", ".md", ".csv", ".json", ".yaml", ".yml")
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

ARCHIVE = "application/zip"
_MEMBERS = T.ArrayType(
    T.StructType().add("name", T.StringType()).add("data", T.BinaryType()).add("failure", T.StringType()))

Extractor = Callable[[bytes], str]


def _quietly(read: Callable, content, otherwise=None):
    try:
        return read(bytes(content))
    except Exception:
        return otherwise


def _plain(content: bytes) -> str:
    return content.decode("utf-8", errors="ignore")


def _json(content: bytes) -> str:
    return json.dumps(json.loads(content.decode("utf-8")), indent=2)


def _html(content: bytes) -> str:
    return strip_tags(_plain(content))


def _docx(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_WORD}body")
    written = {f"{_WORD}t": None, f"{_WORD}tab": "\t", f"{_WORD}br": "\n", f"{_WORD}cr": "\n"}
    return "\n".join(
        "".join((node.text or "") if written[node.tag] is None else written[node.tag]
                for node in paragraph.iter() if node.tag in written)
        for paragraph in body.findall(f"{_WORD}p")
    )


def _mail(content: bytes) -> str:
    message = message_from_bytes(content, policy=policy.default)
    texts = [
        part for part in message.walk()
        if part.get_content_type() == "text/plain" and not part.get_content_disposition()
    ] if message.is_multipart() else [message]
    body = texts[0].get_content().strip() if texts else ""
    return f"From: {message.get('From')}\nTo: {message.get('To')}\nSubject: {message.get('Subject')}\n\n{body}"


def _unpacked(content: bytes) -> list[dict] | None:
    """The members of an archive worth reading; None if it is no archive."""
    def member(archive: zipfile.ZipFile, entry: zipfile.ZipInfo) -> dict:
        try:
            return {"name": entry.filename, "data": archive.read(entry), "failure": None}
        except Exception as error:
            return {"name": entry.filename, "data": None, "failure": str(error)}

    if not zipfile.is_zipfile(io.BytesIO(content)):
        return None
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        return [member(archive, e) for e in archive.infolist() if e.filename.lower().endswith(MEMBER_ENDINGS)]


@F.pandas_udf(_MEMBERS)
def unpack(contents: pd.Series) -> pd.Series:
    """The readable members of archives, as rows of name and bytes."""
    return pd.Series([None if c is None else _quietly(_unpacked, c) for c in contents], dtype="object")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _cleaned(contents: pd.Series) -> pd.Series:
    return pd.Series(
        [None if cs is None else [None if c is None else _plain(c) for c in cs] for cs in contents], dtype="object")


def decoded(contents: Column) -> Column:
    """An array of binaries as texts, without bytes that are not UTF-8.

    Only binaries that have such bytes leave the JVM.
    """
    damaged = lambda c: ~F.is_valid_utf8(c.cast("string"))
    asked = F.when(F.exists(contents, damaged), F.transform(contents, lambda c: F.when(damaged(c), c)))
    repaired = F.coalesce(_cleaned(asked), F.array().cast("array<string>"))
    return F.zip_with(contents, repaired, lambda c, r: F.coalesce(r, c.cast("string")))


# How an archive member is introduced, and one that cannot be read.
MEMBER_HEAD = "===== %s =====\n%s"
MEMBER_FAILED = "[Could not read file: %s]"


def archive_text(content: Column) -> Column:
    """The texts of an archive's members, each below its name."""
    members = unpack(content)
    texts = decoded(F.transform(members, lambda m: m["data"]))
    shown = F.zip_with(members, texts, lambda m, text: F.format_string(
        MEMBER_HEAD, m["name"], F.coalesce(text, F.format_string(MEMBER_FAILED, m["failure"]))))
    return F.coalesce(strip(F.array_join(shown, "\n\n")), F.lit(""))


EXTRACTORS: dict[str, Extractor] = {
    **dict.fromkeys(PLAIN_TYPES, _plain),
    "application/json": _json,
    "text/html": _html,
    DOCX: _docx,
    "message/rfc822": _mail,
}


def attachment_text(mime: Column, content: Column, extra: dict[str, Extractor] | None = None) -> Column:
    """Text of a file, empty when its type is unknown or it cannot be read.

    ``extra`` adds extractors by MIME type, for example for PDF or images. Files reach
    Python in batches; ``session.small_batches`` bounds them.
    """
    extractors = {**EXTRACTORS, **(extra or {})}

    @F.pandas_udf("string")
    def extract(kinds: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([
            "" if data is None or kind not in extractors else _quietly(extractors[kind], data, "")
            for kind, data in zip(kinds, contents)
        ], dtype="object")

    # Types nobody reads never leave the JVM, nor do plain texts that are valid UTF-8.
    plain = mime.isin([kind for kind in PLAIN_TYPES if extractors[kind] is _plain])
    packed = (mime == ARCHIVE) if ARCHIVE not in extractors else F.lit(False)
    read = mime.isin(list(extractors)) & ~plain
    text = (
        F.when(plain, F.coalesce(decoded(F.array(F.when(plain, content)))[0], F.lit("")))
        .when(packed, archive_text(F.when(packed, content)))
        .otherwise(extract(F.when(read, mime), F.when(read, content)))
    )
    return drop_nul(F.when(mime == "text/html", normalize_text(text)).otherwise(text))
