"""Raw messages to parsed rows: the one step that needs a mail library.

It runs over Arrow batches where the scan put the rows and moves nothing between
tasks. Dates, references, MIME types, HTML and body choice are left to Spark.
"""

from __future__ import annotations

import base64
import binascii
import json
from collections.abc import Callable, Iterator
from email import message_from_bytes
from email.header import decode_header, make_header
from email.message import Message
from email.utils import getaddresses

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from mailspark.schemas import PARSED
from mailspark.session import small_batches

_EMPTY = {field.name: None for field in PARSED.fields}
# Rows turned into Python objects at once, and bytes handed back at once.
_ROWS = 64
_BATCH_BYTES = 4 << 20


def decoded_header(value) -> str:
    """RFC 2047 decoding; what cannot be decoded stays as it is."""
    try:
        return str(make_header(decode_header(value)))
    except Exception:
        return str(value)


def _part_text(part: Message) -> str:
    payload = part.get_payload(decode=True)
    if not payload:
        return ""
    try:
        return payload.decode(part.get_content_charset() or "utf-8", errors="ignore")
    except LookupError:
        return ""


def _leaves(message: Message) -> Iterator[Message]:
    """Parts in document order; an enclosed message counts as one part."""
    if message.get_content_type() == "message/rfc822" or not message.is_multipart():
        yield message
        return
    for part in message.get_payload():
        yield from _leaves(part)


def _is_attachment(part: Message) -> bool:
    return "attachment" in str(part.get("Content-Disposition", "")).lower()


def _content(part: Message) -> bytes:
    if part.get_content_type() == "message/rfc822":
        inner = part.get_payload()
        return b"".join(m.as_bytes() for m in inner) if isinstance(inner, list) else b""
    return part.get_payload(decode=True) or b""


def parse_mail(raw: bytes) -> dict:
    """One RFC 822 message as a parsed row."""
    message = message_from_bytes(raw)
    texts = {"text/plain": "", "text/html": ""}
    files = []
    if message.is_multipart() and message.get_content_type() != "message/rfc822":
        for number, part in enumerate(_leaves(message)):
            enclosed = part.get_content_type() == "message/rfc822"
            try:
                if _is_attachment(part) or enclosed:
                    name = part.get_filename() or ("message.eml" if enclosed else None)
                    if name:
                        files.append({
                            "part_no": number, "filename": decoded_header(name),
                            "declared_type": part.get_content_type(), "content": _content(part),
                        })
                elif part.get_content_type() in texts:
                    texts[part.get_content_type()] += _part_text(part)
            except Exception:
                # A part that cannot be read is lost alone, not with its message.
                continue
    elif message.get_content_type() in texts:
        texts[message.get_content_type()] = _part_text(message)
    to = [decoded_header(value) for value in message.get_all("To", [])]
    parent = message.get("In-Reply-To")
    message_id = message.get("Message-ID")
    return {
        **_EMPTY,
        "message_id": None if message_id is None else str(message_id).strip(),
        "subject": decoded_header(message.get("Subject", "")),
        "sender": decoded_header(message.get("From", "")),
        "recipients": [address for _, address in getaddresses(to) if address],
        "date_header": None if message.get("Date") is None else str(message.get("Date")),
        "references_header": None if message.get("References") is None else str(message.get("References")),
        "in_reply_to": None if parent is None else decoded_header(parent).strip(),
        "plain": texts["text/plain"],
        "html": texts["text/html"],
        "files": files,
    }


def _from_base64url(data: str | None) -> bytes:
    if not data:
        return b""
    try:
        return base64.urlsafe_b64decode(data + "=" * (-len(data) % 4))
    except (binascii.Error, ValueError):
        return b""


def parse_resource(raw: str | bytes) -> dict:
    """One mail-API message resource (JSON) as a parsed row.

    Parts nest to any depth, which no fixed schema can describe. Attachment
    bytes are expected inline, as ``body.data`` next to ``body.attachmentId``.
    """
    resource = json.loads(raw)
    payload = resource.get("payload") or {}
    headers = {h["name"].lower(): h["value"] for h in payload.get("headers") or []}
    texts = {"text/plain": "", "text/html": ""}
    files = []

    def visit(parts):
        for part in parts:
            body, kind = part.get("body") or {}, part.get("mimeType", "")
            if part.get("filename") and body.get("attachmentId"):
                files.append({
                    "part_no": len(files), "filename": part["filename"],
                    "declared_type": kind, "content": _from_base64url(body.get("data")),
                })
            elif body.get("data") and kind in texts:
                texts[kind] += "\n" + _from_base64url(body["data"]).decode("utf-8", errors="ignore")
            visit(part.get("parts") or [])

    if "parts" in payload:
        visit(payload["parts"] or [])
    elif payload.get("mimeType") in texts:
        data = (payload.get("body") or {}).get("data")
        texts[payload["mimeType"]] = _from_base64url(data).decode("utf-8", errors="ignore")
    return {
        **_EMPTY,
        "message_id": headers.get("message-id"),
        "thread_key": resource.get("threadId"),
        "subject": headers.get("subject", ""),
        "sender": headers.get("from", ""),
        "recipients": [address for _, address in getaddresses([headers.get("to", "")]) if address],
        "date_header": headers.get("date"),
        "references_header": headers.get("references"),
        "in_reply_to": headers.get("in-reply-to"),
        "plain": texts["text/plain"],
        "html": texts["text/html"],
        "files": files,
    }


def _clean(value):
    """Lone surrogates cannot be written as UTF-8; they become '?'."""
    if isinstance(value, str):
        return value.encode("utf-8", "replace").decode("utf-8")
    if isinstance(value, list):
        return [_clean(item) for item in value]
    if isinstance(value, dict):
        return {key: _clean(item) for key, item in value.items()}
    return value


def parse_messages(
    df: DataFrame, columns: tuple[str, ...], make_parser: Callable[[], Callable[[dict], dict | None]],
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``keep`` columns plus the parsed fields of each row.

    ``make_parser`` is called once per task and returns a function of a row as a
    dict; rows for which that gives None are left out. A message that cannot be
    read becomes a row with ``error`` set, never a failed task.
    """
    small_batches(df.sparkSession)
    schema = df.select(*keep).schema
    for field in PARSED.fields:
        schema = schema.add(field)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse = make_parser()
        for batch in batches:
            rows, size = [], 0
            for start in range(0, batch.num_rows, _ROWS):
                for record in batch.slice(start, _ROWS).to_pylist():
                    try:
                        parsed = parse(record)
                        if parsed is None:
                            continue
                        parsed = _clean(parsed)
                    except Exception as error:
                        parsed = {**_EMPTY, "error": f"{type(error).__name__}: {error}"}
                    rows.append({**{name: record[name] for name in keep}, **parsed})
                    size += sum(len(record[name] or b"") for name in columns)
                    if size >= _BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return df.mapInArrow(run, schema)
