"""Message ids from raw mail without a mail library.

``header_id`` reads the header block in the JVM and gives the id only where there is no
doubt about it: all lines up to the first empty one are printable ASCII headers or
their continuations, and the id stands on one line, be it the one after its name. All
else gives NULL and is left to the parser.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailspark.functions.text import strip

_NAME = "message-id:"
_LINE = r"^(?:[!-9;-~]+:|[ \t])[ -~\t]*$"


@dataclass(frozen=True)
class Source:
    """How records of a kind are read: ``scan`` gives ``(input_order, message_id)`` from
    headers alone, ``parse`` the whole messages; ``order`` names the columns of records
    that make up ``input_order``."""

    scan: Callable[[DataFrame], DataFrame]
    parse: Callable[[DataFrame], DataFrame]
    order: tuple[str, ...]

    def place(self) -> Column:
        return F.struct(*self.order)


def header_id(raw: Column) -> Column:
    """The Message-ID of a mail whose first line is an envelope line, or NULL."""
    head = F.substring_index(F.substring_index(raw, "\n\n", 1), "\n\r\n", 1)
    lines = F.transform(F.split(head, "\n", -1), lambda line: F.regexp_replace(line, r"\r\z", ""))
    lines = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))

    def continues(line: Column) -> Column:
        return F.coalesce(line.startswith(" ") | line.startswith("\t"), F.lit(False))

    def found(lines: Column) -> Column:
        plain = F.forall(lines, lambda line: line.rlike(_LINE)) & ~continues(F.get(lines, 0))
        at = F.array_position(F.transform(lines, lambda line: F.lower(F.substring(line, 1, len(_NAME))) == _NAME), True).cast("int")
        own, following = strip(F.substring(F.get(lines, at - 1), len(_NAME) + 1, 1 << 30)), F.get(lines, at)
        folded = F.when((own == "") & ~continues(F.get(lines, at + 1)), strip(following))
        value = F.when(continues(following), folded).otherwise(own)
        return F.when(plain & (at > 0) & (value != ""), value)

    return F.transform(F.array(lines), found)[0]
