"""Language identification by averaged hashed subword embeddings.

The subwords of a text are its n-grams of 1 to ``ORDERS`` letters, words being padded
with a space on both sides, lower-cased, with everything but letters taken as space.
Each is hashed to a bucket, every bucket has a small vector, and the average of the
vectors over the whole text goes through a linear softmax. Vectors and softmax are
trained together by stochastic gradient descent in numpy, on bags of the training
documents and on short windows of them, so that short texts are seen as well.
Since the average is linear, training leaves one score per bucket and language,
and a text costs a count of its subwords and one product.

Probabilities are calibrated on documents the training left out: one temperature is
chosen by their likelihood, and a text is ``rejected`` if its best probability is
below the level that only ``MISSES`` of those documents fall under. A rejected text
keeps its best language.

The model is fitted on about ``SAMPLE`` documents (at most twice that), chosen by a
hash of their ids; each language has the same share of that if it has so many.

Cases: a text without a letter, and a null text, are ``und`` with score 0. Without any
labelled document nothing can be learned, and all texts are ``und``.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailspark.llm.common import sized

ORDERS = 3
BUCKETS = 1 << 14
DIMENSIONS = 16
SAMPLE = 4000
WINDOW = 60
MISSES = 0.001
UNDETERMINED = "und"

_SPACE = 0x20


def _letter_table() -> np.ndarray:
    """For code points below 0x10000: the lower-case letter, or a space."""
    table = np.full(0x10000, _SPACE, dtype=np.uint32)
    for code in range(0x10000):
        c = chr(code)
        if c.isalpha():
            low = c.lower()
            table[code] = ord(low) if len(low) == 1 else code
        elif unicodedata.category(c)[0] == "M":
            table[code] = code
    return table


_LETTERS: list[np.ndarray] = []


def letters(text: str) -> np.ndarray:
    """The code points of a text, lower-case, with spaces for all but letters."""
    if not _LETTERS:
        _LETTERS.append(_letter_table())
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = _LETTERS[0][np.minimum(codes, 0xFFFF)]
    high = codes > 0xFFFF
    if high.any():
        out = out.copy()
        out[high] = [ord(c.lower()[0]) if c.isalpha() else _SPACE for c in map(chr, codes[high])]
    # One space between words, and one at both ends.
    padded = np.concatenate([[_SPACE], out, [_SPACE]]).astype(np.uint32)
    keep = np.ones(len(padded), dtype=bool)
    keep[1:] = (padded[1:] != _SPACE) | (padded[:-1] != _SPACE)
    return padded[keep]


def subwords(codes: np.ndarray) -> np.ndarray:
    """Bucket numbers of all n-grams that do not span words."""
    found = []
    value = np.zeros(len(codes), dtype=np.uint64)
    inner_space = codes == _SPACE
    for n in range(1, ORDERS + 1):
        rows = len(codes) - n + 1
        if rows <= 0:
            break
        value = value[:rows] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1:n - 1 + rows].astype(np.uint64) + np.uint64(1)
        mixed = value ^ (value >> np.uint64(29))
        mixed = mixed * np.uint64(0xBF58476D1CE4E5B9)
        bucket = (mixed >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)
        if n == 1:
            found.append(bucket[~inner_space])
        else:
            ok = np.ones(rows, dtype=bool)
            for k in range(1, n - 1):
                ok &= ~inner_space[k:k + rows]
            if n == 2:
                ok &= ~(inner_space[:rows] & inner_space[1:1 + rows])
            found.append(bucket[ok])
    return np.concatenate(found) if found else np.empty(0, dtype=np.int64)


@dataclass(frozen=True)
class LanguageModel:
    """Scores per bucket and language, with the calibration."""

    languages: tuple[str, ...]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    level: float

    def probabilities(self, text: str | None) -> np.ndarray | None:
        """One per language; nothing for a text without a letter."""
        if not text or not self.languages or not any(c.isalpha() for c in text):
            return None
        buckets = subwords(letters(text))
        if len(buckets) == 0:
            return None
        counts = np.bincount(buckets, minlength=BUCKETS)
        hit = np.flatnonzero(counts)
        logits = (counts[hit] @ self.scores[hit] / len(buckets) + self.bias) / self.temperature
        e = np.exp(logits - logits.max())
        return e / e.sum()


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _bags(texts: list[str], rng: np.random.Generator) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Per text its whole bag and that of one short window."""
    out = []
    for i, text in enumerate(texts):
        codes = letters(text)
        whole = subwords(codes)
        if len(whole) == 0:
            continue
        at = int(rng.integers(0, max(1, len(codes) - WINDOW)))
        for buckets in (whole, subwords(codes[at:at + WINDOW])):
            if len(buckets):
                hit, counts = np.unique(buckets, return_counts=True)
                out.append((i, hit, (counts / len(buckets)).astype(np.float32)))
    return out


def train(texts: list[str], labels: list[str], epochs: int = 12, rate: float = 0.5, seed: int = 3) -> LanguageModel:
    """Fits the model on labelled texts; a tenth of them is kept for calibration."""
    rng = np.random.default_rng(seed)
    languages = tuple(sorted(set(labels)))
    if not languages:
        return LanguageModel((), np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    target = np.array([languages.index(x) for x in labels])
    vectors = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights = rng.normal(0, 0.1, (DIMENSIONS, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), dtype=np.float32)
    bags = _bags(texts, rng)
    held = rng.random(len(texts)) < 0.1 if len(texts) >= 50 else np.zeros(len(texts), dtype=bool)
    fit, check = [b for b in bags if not held[b[0]]], [b for b in bags if held[b[0]]]
    steps, step = max(1, epochs * len(fit)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(fit)):
            i, hit, share = fit[k]
            average = share @ vectors[hit]
            logits = average @ weights + bias
            e = np.exp(logits - logits.max())
            error = e / e.sum()
            error[target[i]] -= 1
            now = rate * (1 - step / steps)
            back = weights @ error
            weights -= now * np.outer(average, error)
            bias -= now * 0.1 * error
            # Shares are small numbers; the step is scaled so that buckets move.
            vectors[hit] -= (now * 10) * np.outer(share, back)
            step += 1
    scores = (vectors @ weights).astype(np.float64)
    logits = np.array([b[2] @ scores[b[1]] + bias for b in (check or fit)])
    truth = target[[b[0] for b in (check or fit)]]
    best, temperature = -np.inf, 1.0
    for candidate in np.exp(np.linspace(np.log(0.05), np.log(5), 40)):
        likelihood = np.log(_softmax(logits / candidate)[np.arange(len(truth)), truth] + 1e-12).mean()
        if likelihood > best:
            best, temperature = likelihood, float(candidate)
    confidence = _softmax(logits / temperature).max(axis=1)
    level = float(np.quantile(confidence, MISSES))
    return LanguageModel(languages, scores, bias.astype(np.float64), temperature, level)


def held_out(doc_id: Column) -> Column:
    """Every fifth document by checksum of its id is never learned from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """A model from the ``text`` and ``lang`` of documents that are not held out."""
    usable = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    usable = usable.select("lang", F.col("text").cast("string"), F.xxhash64(F.col("doc_id").cast("string")).alias("mark"))
    rows = bounded_sample(usable, "lang", sample).orderBy("mark").collect()
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def bounded_sample(rows: DataFrame, label: str, sample: int) -> DataFrame:
    """About ``sample`` rows, as many of each label as there are, by their ``mark``.

    Marks are even, so a share of them is a share of the rows. Rows with one mark,
    copies of one id, come together; twice the number asked for is never exceeded.
    """
    counts = rows.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("n"))
    share = F.least(F.lit(1.0), F.lit(float(sample)) / F.count("*").over(Window.partitionBy()) / F.col("n"))
    shares = counts.select("_label", share.alias("share"))
    part = F.pmod("mark", F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = rows.join(sized(shares, 10_000), F.col(label) == F.col("_label")).where(part < F.col("share"))
    return chosen.select(*rows.columns).limit(2 * sample)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model_ = shared.value
        for batch in batches:
            names, scores, rejected = [], [], []
            for text in batch.column(2).to_pylist():
                found = model_.probabilities(text)
                if found is None:
                    names.append(UNDETERMINED)
                    scores.append(0.0)
                    rejected.append(True)
                else:
                    k = int(found.argmax())
                    names.append(model_.languages[k])
                    scores.append(float(found[k]))
                    rejected.append(bool(found[k] < model_.level))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    columns = docs.select(F.col("doc_id").cast("bigint"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return columns.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean")
