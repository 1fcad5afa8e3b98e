import zlib

from pyspark.sql import functions as F

from mailspark.llm.sharding import DIMENSIONS, shard_documents, shards_for, with_shard

from .conftest import CLASHING

LOWEST = -(1 << 63)


def category(text):
    if text is None:
        return -1
    return HASHES[text]


HASHES = {}


def hashed(spark, rows):
    values = sorted({v for r in rows for v in r[2:4] if v is not None})
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    HASHES.update({r.v: r.h & ((1 << 52) - 1) for r in frame.select("v", F.xxhash64("v").alias("h")).collect()})


def by_brute_force(rows, shards):
    """Row numbers of each shard, by sorting every node."""
    points = []
    for i, (doc, text, lang, source, *_) in enumerate(rows):
        size = len((text or "").encode()) + 1
        points.append({"row": i, "place": LOWEST if doc is None else doc, "source": category(source), "lang": category(lang), "length": size})
    whole = {n: float(max(p[n] for p in points)) - float(min(p[n] for p in points)) for n in DIMENSIONS}

    def split(part, first, count):
        if count == 1:
            return {p["row"]: first for p in part}
        if not part:
            return {}
        width = [
            (float(max(p[n] for p in part)) - float(min(p[n] for p in part))) / whole[n] if whole[n] else 0.0 for n in DIMENSIONS]
        dim = DIMENSIONS[width.index(max(width))]
        # Enough where doc_id is unique.
        key = lambda p: (p[dim], p["place"], p["length"])
        total, half = sum(p["length"] for p in part), count // 2
        want = max(1, (2 * total * half + count) // (2 * count))
        before, cut = 0, None
        for k in sorted({key(p) for p in part}):
            weight = sum(p["length"] for p in part if key(p) == k)
            if before + weight >= want:
                left = before + weight - want <= want - before
                cut = (k, left)
                break
            before += weight
        k, left = cut
        low = [p for p in part if key(p) < k or (left and key(p) == k)]
        high = [p for p in part if p not in low]
        return {**split(low, first, half), **split(high, first + half, count - half)}

    return split(points, 0, shards)


def rows_of(n):
    return [
        (i * 7 % n, "x" * ((i * i * 31) % 400), ["de", "en", None, "fr"][i % 4], "src0" if i % 3 == 0 else f"src{i % 11}") for i in range(n)]


def test_against_sorted_nodes(spark, documents):
    rows = rows_of(300)
    hashed(spark, rows)
    for shards in (8, 5, 1):
        want = by_brute_force(rows, shards)
        got = {r["doc_id"]: r for r in shard_documents(documents(rows), shards).collect()}
        assert {rows[i][0]: s for i, s in want.items()} == {d: r["shard"] for d, r in got.items()}


def test_columns_and_slots(documents):
    rows = rows_of(500)
    got = shard_documents(documents(rows, CLASHING), 8).collect()
    texts = {r[0]: r[1] for r in rows}
    by_shard = {}
    for r in got:
        assert r["size"] == len(texts[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
        assert r["law"] == "bytes" and r["grown_shard"] is None
        by_shard.setdefault(r["shard"], []).append(r)
    assert sorted(by_shard) == list(range(8))
    sizes = [sum(r["size"] for r in rs) for rs in by_shard.values()]
    assert max(sizes) - min(sizes) <= 3 * 401
    assert all(sorted(r["slot"] for r in rs) == list(range(len(rs))) for rs in by_shard.values())


def test_one_value_for_all(documents):
    """A source that all rows share, equal lengths: the place splits."""
    got = shard_documents(documents([(i, "abc", "en", "one") for i in range(800)]), 8).collect()
    assert {r["shard"]: 0 for r in got} == dict.fromkeys(range(8), 0)
    assert {sum(1 for r in got if r["shard"] == s) for s in range(8)} == {100}


def test_cases(documents):
    assert shard_documents(documents([])).collect() == []
    rows = [(None, None), (None, None), (1, ""), (2, "é" * 100_000, "en", "日本"), (1, ""), (3, "b", None, None)]
    got = shard_documents(documents(rows), 8).collect()
    assert sorted(r["size"] for r in got) == [1, 1, 1, 1, 2, 200_001]
    assert {r["text_crc32"] for r in got if r["size"] == 1} == {0}
    assert all(0 <= r["shard"] < 8 for r in got)


def test_documents_with_shards(documents):
    rows = rows_of(300)
    docs = documents(rows)
    got = {r["doc_id"]: r["shard"] for r in with_shard(docs).collect()}
    assert got == {r["doc_id"]: r["shard"] for r in shard_documents(docs).collect()}
    assert with_shard(docs).columns == [*docs.columns, "size", "shard"]
    total = sum(len(r[1]) + 1 for r in rows)
    assert shards_for(docs, total // 4) in (4, 5) and shards_for(documents([]), 10) == 1


def even(rows, shards=8):
    """Whether the bytes of shards differ by no more than two rows."""
    sizes = [0] * shards
    for r in rows:
        sizes[r["shard"]] += r["size"]
    return max(sizes) - min(sizes) <= 2 * max(r["size"] for r in rows)


def test_rows_that_share_their_id(documents):
    """Null ids, one id for all, equal sizes, equal rows, values that share a prefix."""
    tables = {
        "no id": [(None, "%04d" % i) for i in range(1600)],
        "no id, equal texts": [(None, "same text", "en", "one")] * 1600,
        "one id": [(7, "%04d" % i, "en", f"a/common/path/{i % 8}") for i in range(1600)],
        "two ids, equal texts": [(i % 2, "same text", "en", f"a/common/path/{i % 3}") for i in range(1600)],
    }
    for name, rows in tables.items():
        got = shard_documents(documents(rows)).collect()
        assert len(got) == len(rows) and even(got), name
        assert sorted(r["slot"] for r in got if r["shard"] == 3) == list(range(sum(r["shard"] == 3 for r in got)))
        assert even(with_shard(documents(rows)).collect()), name


def test_values_that_share_a_prefix_are_told_apart(documents):
    """Two sources of equal bytes: the first cut lies between them."""
    rows = [(i, "t" * 9, "en", "a/common/path/" + "xy"[i % 2]) for i in range(400)]
    shard = {r["doc_id"]: r["shard"] for r in shard_documents(documents(rows), 2).collect()}
    assert len({shard[i] for i in range(0, 400, 2)}) == 1 and len({shard[i] for i in range(1, 400, 2)}) == 1
