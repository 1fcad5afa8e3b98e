"""Toxicity by a weighted grammar of finite-state transducers.

Words are classes: insult, threat, target (who is addressed), negation, report (verbs of
saying) and quotation marks; all others are one class. Small transducers rewrite
the classes of a clause: one marks what is reported or quoted, one marks what a
negation reaches, one pairs insults with targets and one threats with theirs. They
are composed into a single one, which reads a clause once and says which patterns
it matches, with the weight of the insults in it. A document's score is a logistic
function of its matched clauses; words outside of a match count nothing.

Lexicon and weights are learned from labelled documents: a word, or a stem that
several words share, is an insult if it occurs in so many different toxic documents,
and in so few clean ones, that chance would not do it. Near copies count once, since
all words of a copied toxic document would pass otherwise. A short list of insults and threats is there from the start, and how
much negated, reported or undirected matches count is up to the fitted weights.

The model is fitted on about ``SAMPLE`` labelled documents (at most twice that).

Cases: a null or empty text matches nothing and gets the score of a clean one. Without
labels of both kinds the prior weights stand.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailspark.llm.language import bounded_sample, held_out
from mailspark.llm.textbytes import mix, shingle_set

SAMPLE = 4000
# How unlikely chance must be for a word to become an insult.
CHANCE = 1e-7
STEMS = range(4, 9)
LEXICON = 2000

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE = range(7)
_CLASSES = 7
_NEGATED, _REPORTED = 8, 16

_SEED = {
    INSULT: "idiot idiots moron morons imbecile stupid dumbass loser losers scum scumbag trash worthless pathetic disgusting clown "
            "filth vermin bastard bitch asshole retard degenerate idiota imbécil estúpido basura idiote imbécile connard "
            "ordure salaud dummkopf arschloch abschaum trottel",
    THREAT: "kill killing murder strangle shoot stab hang burn töten umbringen erschießen tuer égorger matar degollar",
}
_FUNCTION = {
    TARGET: "you your yours yourself u him her them they he she these those du dich dir euch ihr ihn sie ihnen tu toi te vous lui "
            "eux elle ils tú ti usted ustedes él ella ellos",
    NEGATION: "not no never none nobody isn't aren't wasn't don't nicht kein keine niemals nie pas jamais aucun nunca jamás ningún",
    REPORT: "said says saying told called calls quoted wrote claimed accused sagte sagt schrieb nannte dit disait écrit appelé dijo "
            "dice escribió llamó",
}
_QUOTES = frozenset("\"«»“”„")
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[\"«»“”„]")
_CLAUSE = re.compile(r"[^.!?;\n]+")


@dataclass(frozen=True)
class Transducer:
    """``next[state][symbol]`` and ``out[state][symbol]``, from state 0."""

    next: tuple[tuple[int, ...], ...]
    out: tuple[tuple[int, ...], ...]

    def then(self, other: Transducer) -> Transducer:
        """The transducer that feeds this one's output to ``other``; only states
        that can be reached are built."""
        index, rows = {(0, 0): 0}, []
        queue = [(0, 0)]
        for a, b in queue:
            to, put = [], []
            for symbol in range(len(self.next[a])):
                mid = self.out[a][symbol]
                pair = (self.next[a][symbol], other.next[b][mid])
                if pair not in index:
                    index[pair] = len(index)
                    queue.append(pair)
                to.append(index[pair])
                put.append(other.out[b][mid])
            rows.append((tuple(to), tuple(put)))
        return Transducer(tuple(r[0] for r in rows), tuple(r[1] for r in rows))


def _build(states: int, symbols: int, rule) -> Transducer:
    cells = [[rule(state, symbol) for symbol in range(symbols)] for state in range(states)]
    return Transducer(tuple(tuple(c[0] for c in row) for row in cells), tuple(tuple(c[1] for c in row) for row in cells))


def _reported(state: int, symbol: int) -> tuple[int, int]:
    """State 1 after a verb of saying, 2 inside quotation marks."""
    if symbol == QUOTE:
        return (0 if state == 2 else 2), symbol
    out = symbol + _REPORTED if state else symbol
    return (1 if symbol == REPORT and state != 2 else state), out


def _negated(state: int, symbol: int) -> tuple[int, int]:
    """A negation reaches the next four words."""
    kind = symbol & 7
    out = symbol + _NEGATED if state else symbol
    return (4 if kind == NEGATION else max(0, state - 1)), out


# What a clause can match.
PATTERNS = ("insult", "directed", "negated", "reported", "threat", "mock threat")
_NONE = len(PATTERNS)
_FEATURES = len(PATTERNS) + 3


def _matched(state: int, symbol: int) -> tuple[int, int]:
    """State: 3 * (words since a target, 0 none, up to 4) + (0 none, 1 insult, 2 threat
    waiting for a target). An insult matches at once, a threat with its target."""
    near, waiting = divmod(state, 3)
    kind, weak = symbol & 7, symbol & (_NEGATED | _REPORTED)
    later = (near + 1 if 0 < near < 4 else 0)
    if kind == INSULT:
        found = 2 if symbol & _NEGATED else 3 if symbol & _REPORTED else 1 if near else 0
        return 3 * later + (0 if near else 1), found
    if kind == THREAT:
        return 3 * later + 2, _NONE
    if kind == TARGET:
        if waiting == 2:
            return 3, 5 if weak else 4
        return 3, _NONE
    return 3 * later + (waiting if kind == OTHER else 0), _NONE


def grammar() -> Transducer:
    """The composed transducer from word classes to patterns."""
    marked = _build(3, _CLASSES, _reported).then(_build(5, 32, _negated))
    return marked.then(_build(15, 32, _matched))


@dataclass
class ToxicityModel:
    """Lexicon and weights; the automaton is built where it is used."""

    words: dict[str, tuple[int, float]]
    stems: dict[str, tuple[int, float]]
    weights: np.ndarray
    _ready: tuple | None = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {"words": self.words, "stems": self.stems, "weights": self.weights, "_ready": None}

    def _tools(self):
        if self._ready is None:
            import ahocorasick

            finder = ahocorasick.Automaton()
            for word in {*self.words, *self.stems}:
                finder.add_word(word, len(word))
            finder.make_automaton()
            function = {w: c for c, listed in _FUNCTION.items() for w in listed.split()}
            self._ready = (finder, function, grammar())
        return self._ready

    def _class(self, token: str, function: dict[str, int]) -> tuple[int, float]:
        found = self.words.get(token)
        if found is None:
            for n in STEMS:
                found = self.stems.get(token[:n]) if n <= len(token) else None
                if found is not None:
                    break
        if found is not None:
            return found
        return (QUOTE if token in _QUOTES else function.get(token, OTHER)), 0.0

    def matches(self, text: str) -> list[tuple[int, int, list[tuple[int, float]]]]:
        """Per matched clause its start, end and patterns with their weights."""
        finder, function, machine = self._tools()
        low = text.lower()
        # Places of insults and threats; clauses without one are not read at all.
        starts = [end + 1 - size for end, size in finder.iter(low)] if len(finder) else []
        starts = sorted({s for s in starts if s == 0 or not (low[s - 1].isalnum() or low[s - 1] == "_")})
        found, k = [], 0
        for clause in _CLAUSE.finditer(low) if starts else ():
            while k < len(starts) and starts[k] < clause.start():
                k += 1
            if k == len(starts):
                break
            if starts[k] >= clause.end():
                continue
            state, patterns = 0, []
            for token in _TOKEN.findall(clause[0]):
                kind, weight = self._class(token, function)
                pattern = machine.out[state][kind]
                state = machine.next[state][kind]
                if pattern != _NONE:
                    patterns.append((pattern, weight if kind == INSULT else 1.0))
            if patterns:
                found.append((clause.start(), clause.end(), patterns))
        return found

    def features(self, text: str | None) -> np.ndarray:
        """Sums of weights per pattern (each damped), whether there are two matches
        or more, matched clauses, and 1."""
        out = np.zeros(_FEATURES)
        out[-1] = 1.0
        found = self.matches(text) if text else []
        out[-3] = float(sum(len(patterns) for _, _, patterns in found) > 1)
        for _, _, patterns in found:
            for pattern, weight in patterns:
                out[pattern] += weight
        out[:len(PATTERNS)] = np.log1p(out[:len(PATTERNS)])
        out[-2] = math.log1p(len(found))
        return out

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.features(text) @ self.weights, -30, 30))))


def _prior() -> ToxicityModel:
    words = {w: (c, 1.0) for c, listed in _SEED.items() for w in listed.split()}
    return ToxicityModel(words, {}, np.array([3.0, 4.0, 0.5, 0.5, 3.0, 0.5, 0.5, 1.0, -3.0]))


def _tail(toxic: int, total: int, share: float) -> float:
    """An upper bound for the chance of ``toxic`` or more out of ``total``."""
    rate = toxic / total
    if rate <= share:
        return 1.0
    divergence = rate * math.log(rate / share)
    if rate < 1:
        divergence += (1 - rate) * math.log((1 - rate) / (1 - share))
    return math.exp(-total * divergence)


def _families(texts: list[str]) -> list[int]:
    """A number for each text, the same for near copies: texts that share one of
    eight MinHash values of their three-word shingles."""
    parent = list(range(len(texts)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    first: dict[tuple[int, int], int] = {}
    for number, text in enumerate(texts):
        shingles = shingle_set(text.encode("utf-8", "surrogatepass"), 3)
        for coordinate in range(8 if len(shingles) else 0):
            least = int(mix(shingles ^ np.uint64(coordinate * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)).min())
            other = first.setdefault((coordinate, least), number)
            parent[root(number)] = root(other)
    return [root(k) for k in range(len(texts))]


def learn_lexicon(texts: list[str], labels: list[int]) -> tuple[dict, dict]:
    """Words and stems that mark toxic texts, with weights."""
    toxic = [t for t, y in zip(texts, labels) if y == 1]
    clean = [t for t, y in zip(texts, labels) if y == 0]
    if not toxic or not clean:
        return {}, {}
    share = len(toxic) / (len(toxic) + len(clean))
    families: dict[int, list[str]] = defaultdict(list)
    for text, family in zip(toxic, _families(toxic)):
        families[family].append(text)
    # In how many families an entry occurs; a stem counts with three forms or more.
    holders: Counter = Counter()
    for texts_ in families.values():
        entries = set()
        for word in {w for text in texts_ for w in _TOKEN.findall(text.lower())} - _QUOTES:
            if len(word) >= 3:
                entries.add(word)
                entries.update(word[:n] + "*" for n in STEMS if n < len(word))
        holders.update(entries)
    able = {w: n for w, n in holders.items() if share ** n < CHANCE}
    del holders
    forms: dict[str, set] = {w: set() for w in able if w.endswith("*")}
    for text in toxic:
        for word in set(_TOKEN.findall(text.lower())):
            for n in STEMS:
                if n < len(word) and word[:n] + "*" in forms:
                    forms[word[:n] + "*"].add(word)
    able = {w: n for w, n in able.items() if w not in forms or len(forms[w]) >= 3}
    in_clean: Counter = Counter()
    for text in dict.fromkeys(clean):
        seen = set()
        for word in set(_TOKEN.findall(text.lower())):
            if word in able:
                seen.add(word)
            for n in STEMS:
                if n < len(word) and (stem := word[:n] + "*") in able:
                    seen.add(stem)
        in_clean.update(seen)
    ranked = []
    for entry in able:
        a, b = able[entry], in_clean[entry]
        odds = math.log((a + 0.5) / len(toxic)) - math.log((b + 0.5) / len(clean))
        if _tail(a, a + b, share) < CHANCE and odds > 2.5 and b <= 0.05 * a:
            ranked.append((odds, entry))
    ranked.sort(key=lambda x: (-x[0], x[1]))
    words, stems = {}, {}
    for odds, entry in ranked[:LEXICON]:
        weight = min(odds, 6.0) / 4.0
        if entry.endswith("*"):
            stems[entry[:-1]] = (INSULT, weight)
        else:
            words[entry] = (INSULT, weight)
    return words, stems


def _logistic(x: np.ndarray, y: np.ndarray, start: np.ndarray, share: float, steps: int = 3000) -> np.ndarray:
    """Weights by gradient descent, held near ``start`` where data say nothing. Toxic
    rows weigh ``share`` together."""
    weights = start.copy()
    balance = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum()))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        weights -= 0.5 * (x.T @ (balance * (p - y)) + 2e-4 * (weights - start))
    return weights


def train(texts: list[str], labels: list[int], share: float | None = None) -> ToxicityModel:
    """A model from labelled texts; ``share`` of all documents are toxic.

    The weights are fitted on matches with a lexicon that other texts gave: what a
    word is worth on the texts it was chosen by would be too much.
    """
    prior = _prior()
    if len(set(labels)) < 2:
        return prior
    y = np.array(labels, dtype=float)
    # Near copies are in one part.
    part = np.array([zlib.crc32(str(f).encode()) % 3 for f in _families(texts)])
    x = np.zeros((len(texts), _FEATURES))
    for k in range(3):
        others = [i for i in range(len(texts)) if part[i] != k]
        words, stems = learn_lexicon([texts[i] for i in others], [labels[i] for i in others])
        model = ToxicityModel({**prior.words, **words}, stems, prior.weights)
        for i in np.flatnonzero(part == k):
            x[i] = model.features(texts[i])
    weights = _logistic(x, y, prior.weights, float(y.mean()) if share is None else share)
    words, stems = learn_lexicon(texts, labels)
    return ToxicityModel({**prior.words, **words}, stems, weights)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """A model from the labelled documents that are not held out."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("_id"))).withColumn("mark", F.xxhash64(F.col("_id").cast("string")))
    counts = dict(known.groupBy("toxic").count().collect())
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    chosen = bounded_sample(known, "toxic", sample)
    texts = docs.where("text IS NOT NULL").select("doc_id", F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("mark", "text", "toxic")
    rows = rows.limit(2 * sample).orderBy("mark").collect()
    return train([r["text"] for r in rows], [r["toxic"] for r in rows], share)


def score_documents(docs: DataFrame, model: ToxicityModel, *keep: str) -> DataFrame:
    """``doc_id, held_out, score, predicted, clauses`` and the columns ``keep``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model_ = shared.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            features = np.stack([model_.features(t) for t in texts]) if texts else np.zeros((0, _FEATURES))
            scores = 1 / (1 + np.exp(-np.clip(features @ model_.weights, -30, 30)))
            clauses = np.rint(np.expm1(features[:, -2])).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(clauses),
                 *batch.columns[3:]],
                ["doc_id", "held_out", "score", "predicted", "clauses", *keep])

    columns = docs.select(F.col("doc_id").cast("bigint"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"), *keep)
    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return columns.mapInArrow(run, f"doc_id bigint, held_out boolean, score double, predicted int, clauses bigint{kept}")


def without_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` without the rows that the model predicts to be toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series([shared.value.score(t) for t in texts])

    return docs.where(score(F.col("text").cast("string")) < 0.5)
