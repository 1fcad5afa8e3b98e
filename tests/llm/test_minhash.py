import re

import pytest

from mailspark.llm.components import components
from mailspark.llm.minhash import _tile_links, near_duplicates, without_near_duplicates
from mailspark.llm.textbytes import shingle_set, word_hashes

from .conftest import CLASHING


def word_list(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x20\x09-\x0d]+", low)


def shingles(text, width):
    found = word_list(text or "")
    if not found:
        return frozenset()
    n = min(width, len(found))
    return frozenset(tuple(found[i:i + n]) for i in range(len(found) - n + 1))


def by_brute_force(rows, width, percent):
    """doc_id to component over all pairs."""
    sets = {i: shingles(t, width) for i, t in rows}
    name = {i: i for i in sets}
    changed = True
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and sets[a] & sets[b]]
    while changed:
        changed = False
        for a, b in links:
            low = min(name[a], name[b])
            if name[a] != low or name[b] != low:
                name[a] = name[b] = low
                changed = True
    return name


def varied(number):
    """Families of texts that differ from their base in 0 to 9 of 40 words."""
    rows = []
    for family in range(number):
        base = [f"f{family}x{i}" for i in range(40)]
        for copy in range(10):
            text = list(base)
            for k in range(copy):
                text[(7 * k + family) % 40] = f"c{copy}k{k}"
            rows.append((len(rows), " ".join(text)))
    return rows


@pytest.mark.parametrize("width", [2, 5])
def test_against_all_pairs(documents, width):
    rows = varied(12)
    got = {r["doc_id"]: r for r in near_duplicates(documents(rows), width).collect()}
    want = by_brute_force(rows, width, 80)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (i == want[i]) for i, r in got.items())
    assert all(got[i]["n_shingles"] == len(shingles(t, width)) for i, t in rows)


def test_chain_of_copies(documents):
    """Neighbours in a chain are close, its ends are not; all are one component."""
    words = [f"w{i}" for i in range(130)]
    rows = [(i, " ".join(words[i * 2:i * 2 + 60])) for i in range(30)]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(documents(rows), 2).collect()}
    assert got == by_brute_force(rows, 2, 80) == {i: 0 for i in range(30)}


def test_large_group(documents):
    """Many near copies with outliers among them, more than one tile holds."""
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(700):
        text = list(base)
        for k in range(i % 12):
            text[(11 * k + i) % 60] = f"u{i}k{k}"
        rows.append((i, " ".join(text)))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(documents(rows), 2).collect()}
    assert got == by_brute_force(rows, 2, 80)


def test_cases(documents, long_text):
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "One two"), (7, "one\ttwo"), (8, long_text), (9, long_text),
        (None, "one two"), (None, None), (7, "one\ttwo"), (12, "ÄÖ ü"), (13, "äö ü"),
    ]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(documents(rows), 2).collect()]
    assert sorted(got, key=str) == sorted([
        (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 6, False),
        (7, 1, 6, False), (8, 199_999, 8, True), (9, 199_999, 8, False), (None, 1, 6, False), (None, 0, None, True),
        (12, 1, 12, True), (13, 1, 13, True)], key=str)


def test_empty_and_extra_columns(documents):
    assert near_duplicates(documents([]), 5).collect() == []
    rows = [(1, "a b c d e f"), (2, "A B C D E F"), (2, "A B C D E F"), (3, "x y z u v w")]
    docs = documents(rows, CLASHING)
    kept = without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_repeated_rows_stay_once(documents):
    docs = documents([(1, "a b c d e f"), (1, "a b c d e f"), (None, "q r s t u v"), (None, "q r s t u v"), (4, None), (5, None)])
    assert sorted((r["doc_id"] or 0) for r in without_near_duplicates(docs).collect()) == [0, 1, 4, 5]


def test_shared_and_missing_ids(documents):
    """Different texts under one doc_id or none are compared on their own."""
    def pair(name):
        words = [f"{name}{i}" for i in range(60)]
        return " ".join(words), " ".join(words[:-1] + ["z"])

    (a, a2), (c, c2), (e, e2) = pair("a"), pair("c"), pair("e")
    b, d = pair("b")[0], pair("d")[0]
    rows = [(7, a), (7, b), (3, a2), (None, c), (None, c2), (None, c2), (None, d), (9, e), (9, e2), (11, e2)]
    docs = documents(rows)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(docs).collect()}
    assert got == {(7, 56, 3), (7, 56, 7), (3, 56, 3), (None, 56, None), (9, 56, 9), (11, 56, 9)}
    left = sorted((r["doc_id"] or 0, r["text"]) for r in without_near_duplicates(docs).collect())
    assert [i for i, _ in left] == [0, 0, 3, 7, 9]
    assert left[0][1] in (c, c2) and left[1:4] == [(0, d), (3, a2), (7, b)] and left[4][1] in (e, e2)


@pytest.mark.parametrize("n", [50, 200])
def test_a_tile_leaves_a_forest(spark, n):
    """Singletons that are all alike: fewer links than members, and one component."""
    members = spark.createDataFrame(
        [(1, 0, 0, i, i, 0) for i in range(n)], "token bigint, i int, j int, node bigint, component bigint, block int")
    sets = spark.createDataFrame(
        [(i, shingle_set(f"{' '.join(map(str, range(60)))} own{i}".encode(), 2).tobytes()) for i in range(n)], "node bigint, shingles binary")
    links = _tile_links(members, sets, 80)
    assert links.count() == n - 1
    assert {r["component"] for r in components(links).collect()} == {0}


def test_words():
    assert len(word_hashes("a  bb c\nA".encode())) == 3
    a, b = word_hashes("Ab aB".encode())
    assert a == b
    long_word = "x" * 10_000
    assert len({int(h) for h in word_hashes(f"{long_word}a {long_word}b {long_word}".encode())}) == 3
    assert len(shingle_set(b"a b a b a b", 2)) == 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(200, 230)] + [(5, 5), (229, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{k: 3 for k in [3, 7, *range(200, 230)]}}
