"""Benchmark decontamination by spaced-seed hashing.

Texts are sequences of words (runs of letters, digits and underscores, lower case).
A seed is a mask over a window of words that looks at some places and ignores the
others; the words it looks at are hashed. Documents and benchmark items are joined on
the hashes of all their windows, so a hit survives substitutions at ignored places.
Around every hit, the item is laid along the document at the hit's distance and
compared word by word: equal words count 1, others -1, and the best-scoring stretch is
the overlap. An item is found in a document if the overlap reaches ``MIN_SCORE``, or
``MIN_PART`` of the item if that is less, but never with less than a seed's window.

Items with fewer words than the seeds' window are searched as a whole, by a mask of
their own length, from ``MIN_WORDS`` words on; an item below that is no passage and is
found nowhere.

Only built-in functions run on the main path. The hashes of the benchmark are
broadcast when counted small; else the join is a shuffle.

Cases: null and empty texts hold nothing. Rows that share a doc_id are compared each
for itself, by doc_id and text. A row without doc_id is found, and returned with a null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailspark.llm.common import fits_broadcast, own_names
from mailspark.session import stored

# Ones are looked at. Two masks of weight 5 over 7 words that ignore different places,
# so a substitution that hides one window may spare another.
SEEDS = ("1101011", "1011101")
MIN_WORDS = 5
MIN_SCORE = 10
MIN_PART = 0.6
SMALL_SEEDS = 500_000


def word_list(text: Column) -> Column:
    """Lower-case words; null for a null text."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}_]+"), lambda w: w != "")


def _window(words: str, at: Column, mask: str) -> Column:
    """The hash of the words that ``mask`` looks at from ``at`` (0-based) on."""
    looked = [i for i, bit in enumerate(mask) if bit == "1"]
    return F.xxhash64(F.lit(mask), *[F.get(F.col(words), at + i) for i in looked])


def _windows(texts: DataFrame, masks: list[str], names: list[str], words: str = "hashes") -> DataFrame:
    """``names, at, seed`` of all windows of the column ``words`` under all masks."""
    placed = texts.select(*names, words, F.posexplode(words).alias("at", "_"))
    size = F.size(words)
    seeds = [F.when(F.col("at") + len(m) <= size, _window(words, F.col("at"), m)) for m in masks]
    return placed.select(*names, "at", F.explode(F.array(*seeds)).alias("seed")).where("seed IS NOT NULL")


def _hashed(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*names, F.transform(word_list(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"))


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """Items with the hashes of their words."""
    return _hashed(benchmark.withColumn("item_id", F.col("item_id").cast("bigint")), "item_id").where(F.size("hashes") >= MIN_WORDS)


def _item_seeds(items: DataFrame) -> tuple[DataFrame, list[str]]:
    """Seeds of the items, and the masks in use."""
    width = len(SEEDS[0])
    short = items.where(F.size("hashes") < width)
    lengths = sorted(r[0] for r in short.select(F.size("hashes")).distinct().collect())  # below the window's
    masks = list(SEEDS)
    seeds = _windows(items, masks, ["item_id"])
    for n in lengths:
        whole = "1" * n
        masks.append(whole)
        seeds = seeds.unionByName(_windows(short.where(F.size("hashes") == n), [whole], ["item_id"]))
    return seeds.withColumnsRenamed({"at": "item_at"}), masks


def _best_stretch(doc: Column, item: Column, shift: Column) -> Column:
    """Score, first and last place (in the item) of the best stretch at ``shift``."""
    start = F.struct(*[F.lit(v).alias(n) for n, v in (("run", 0), ("from", 0), ("best", 0), ("first", 0), ("last", -1), ("at", 0))])

    def step(a: Column, word: Column) -> Column:
        at = a["at"]
        point = F.when((shift + at >= 0) & F.coalesce(F.get(doc, shift + at) == word, F.lit(False)), 1).otherwise(-1)
        fresh = a["run"] <= 0
        run, begin = F.when(fresh, point).otherwise(a["run"] + point), F.when(fresh, at).otherwise(a["from"])
        better = run > a["best"]
        return F.struct(
            run.alias("run"), begin.alias("from"), F.when(better, run).otherwise(a["best"]).alias("best"),
            F.when(better, begin).otherwise(a["first"]).alias("first"), F.when(better, at).otherwise(a["last"]).alias("last"),
            (at + 1).alias("at"))

    return F.aggregate(item, start, step, lambda a: F.struct(a["best"].alias("score"), a["first"].alias("first"), a["last"].alias("last")))


def _best_place(doc: Column, item: Column, shifts: Column) -> Column:
    """The best stretch over all ``shifts``; of equal scores the first in the document."""
    def place(shift: Column) -> Column:
        stretch = F.transform(F.array(_best_stretch(doc, item, shift)), lambda s: F.struct(
            s["score"].alias("score"), (-(shift + s["first"])).alias("before"), (shift + s["last"] + 1).alias("doc_end")))
        return stretch[0]

    return F.array_max(F.transform(shifts, place))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, mark, item_id, score, item_words, doc_start, doc_end`` of every item
    found in a document; places are word numbers, ``mark`` is a hash of the text."""
    items = stored(benchmark_items(benchmark), "items")
    seeds, masks = _item_seeds(items)
    seeds = stored(seeds, "seeds")
    texts = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("mark"), F.col("text").cast("string"))
    windows = _windows(_hashed(texts, "doc_id", "mark"), masks, ["doc_id", "mark"])
    small = fits_broadcast(seeds, SMALL_SEEDS)
    hits = windows.join(F.broadcast(seeds) if small else seeds, "seed")
    # Where an item may lie, each once, however many windows hit; no more places than the
    # document and the item have words.
    shift = F.col("at") - F.col("item_at")
    places = stored(hits.groupBy("doc_id", "mark", "item_id").agg(F.collect_set(shift).alias("shifts")), "hits")

    found = places.select(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark")).distinct()
    if fits_broadcast(found):
        found = F.broadcast(found)
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark"))
    hit_docs = _hashed(texts.join(found, same, "left_semi"), "doc_id", "mark").dropDuplicates(["doc_id", "mark"])
    hit_docs = hit_docs.select(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark"), F.col("hashes").alias("doc_words"))
    laid = places.join(hit_docs, same).drop("_doc", "_mark")
    laid = laid.join(F.broadcast(items) if small else items, "item_id")
    # The best place of each item, written down before it is judged, so that the search
    # runs once and the words end here.
    best = stored(laid.select(
        "doc_id", "mark", "item_id", F.size("hashes").alias("item_words"),
        _best_place(F.col("doc_words"), F.col("hashes"), F.col("shifts")).alias("best")), "best")
    words = F.col("item_words")
    part = F.greatest(F.ceil(words * MIN_PART).cast("int"), F.least(words, F.lit(len(SEEDS[0]))))
    return best.where(F.col("best.score") >= F.least(F.lit(MIN_SCORE), part)).select(
        "doc_id", "mark", "item_id", "best.score", "item_words", (-F.col("best.before")).alias("doc_start"), "best.doc_end")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id`` with the overlap, for documents that hold an item."""
    return overlaps(docs, benchmark).drop("mark").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold a benchmark item."""
    doc, mark = own_names("doc", "mark")
    bad = stored(overlaps(docs, benchmark).select(F.col("doc_id").alias(doc), F.col("mark").alias(mark)).distinct(), "leaks")
    if fits_broadcast(bad):
        bad = F.broadcast(bad)
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(mark))
    return docs.join(bad, same, "left_anti")
