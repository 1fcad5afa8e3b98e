"""Text expressions: all Spark columns in, Spark columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a Python str.strip() removes.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a Java regex class body; (?U) makes \s Unicode-aware.
SPACE = r"\s\x1c-\x1f"

# What counts as a link, and the three clean-up steps after HTML.
LINKS = rf"(?U)https?://[^{SPACE}]+|www\.[^{SPACE}]+|ftp://[^{SPACE}]+"
INVISIBLE = r"[\u200c\u200d\u200e\u200f\u202a-\u202e\u2060-\u206f\u00ad\u00a0]"
BLANKS = r"[ \t]+"
BLANK_LINES = rf"(?U)\n[{SPACE}]*\n+"


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def drop_nul(text: Column) -> Column:
    return F.replace(text, F.lit("\0"), F.lit(""))


def remove_links(text: Column) -> Column:
    return F.regexp_replace(text, LINKS, "")


def normalize_text(text: Column) -> Column:
    """Invisible characters to blanks, blank runs to one, empty lines to one."""
    text = F.regexp_replace(text, INVISIBLE, " ")
    text = F.regexp_replace(text, BLANKS, " ")
    return strip(F.regexp_replace(text, BLANK_LINES, "\n\n"))


def split_references(header: Column) -> Column:
    parts = F.split(F.coalesce(header, F.lit("")), rf"(?U)[{SPACE}]+")
    return F.filter(parts, lambda part: part != "")


def thread_root(references: Column, in_reply_to: Column, message_id: Column) -> Column:
    """First reference, else the parent, else the message itself."""
    return F.coalesce(F.get(references, F.lit(0)), F.nullif(in_reply_to, F.lit("")), message_id)


def plain_addresses(header: Column) -> Column:
    """Bare addresses of an address list without quoted display names."""
    return F.regexp_extract_all(header, F.lit(r"[^\s<>,;:\"()]+@[^\s<>,;:\"()]+"), F.lit(0))


def choose_body(html_text: Column, plain: Column) -> Column:
    """Converted HTML when there is any, else the plain text."""
    return strip(drop_nul(F.coalesce(F.nullif(html_text, F.lit("")), plain, F.lit(""))))


def file_extension(filename: Column) -> Column:
    """Lower-case extension with its dot; leading dots do not start one."""
    return F.lower(F.regexp_extract(filename, r"[^/.][^/]*(\.[^./]*)\z", 1))


def base64url_decode(data: Column) -> Column:
    return F.unbase64(F.translate(data, "-_", "+/"))


def indent_block(text: Column, width: int = 9) -> Column:
    """Indent lines that hold something; empty the others."""
    lines = F.split(strip(text), r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]")
    padded = F.transform(lines, lambda line: F.when(is_blank(line), "").otherwise(F.concat(F.lit(" " * width), line)))
    return F.array_join(padded, "\n")


def datetime_text(moment: Column) -> Column:
    """A timestamp as Python prints it: a fraction only when there is one."""
    text = moment.cast("timestamp_ntz").cast("string")
    return F.when(text.contains("."), F.rpad(text, 26, "0")).otherwise(text)


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
