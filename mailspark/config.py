"""Options of a run, as one immutable value."""

from __future__ import annotations

from dataclasses import dataclass

# Separators of the thread document, tried in this order.
SEPARATORS = (
    "===== End Email Thread =====",
    "===== Begin Email Thread =====",
    "--- End Email ---",
    "--- Email",
    "--- Begin Attachment",
    "\n\n",
    "\n",
    " ",
    "",
)

# Default separators of the plain document splitter.
PLAIN_SEPARATORS = ("\n\n", "\n", " ", "")

# Quote introductions, tried in this order, ignoring case.
QUOTE_PATTERNS = (
    r"On .+?wrote:",
    r"From: .+",
    r"Sent: .+",
    r"To: .+",
    r"Subject: .+",
    r"---+ ?Forwarded message ?---+",
    r"----+ Original Message ----+",
)

CHARS_PER_TOKEN = 3.5


@dataclass(frozen=True)
class MailConfig:
    """Every knob of the thread jobs.

    ``heavy_chars`` and ``heavy_rows`` say when a thread stops being handled
    inside one task: beyond them it is ranked by range and cut into segments of
    about ``heavy_chars`` characters. ``small_keys`` bounds every key list that
    is broadcast.
    """

    embed_model: str = "bge-large-en-v1.5"
    chunk_size: int | None = None
    max_chunks: int = 3
    similarity: float = 0.8
    separators: tuple[str, ...] = SEPARATORS
    autojunk: bool = True
    strip_quote_prefix: bool = False
    context_tokens: int = 131072
    summary_sentences: int = 5
    heavy_chars: int = 8_000_000
    heavy_rows: int = 1_000_000
    small_keys: int = 20_000
    # Left empty, the collection is named after the embedding model.
    collection: str = ""

    @property
    def collection_name(self) -> str:
        return self.collection or f"email_threads_{self.embed_model}"
