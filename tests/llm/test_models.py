"""The two learned operators, by held-out accuracy and by what their rules say."""

import zlib

import numpy as np

from mailspark.llm import language, toxicity
from mailspark.llm.queries import QUERIES

from .conftest import CLASHING


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = QUERIES["op9_toxicity"](spark, folder).collect()
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) >= 0.97


def test_language_held_out(spark):
    folder = "/root/testdata/sf0.01"
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op10_language_id"](spark, folder).collect()
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 for r in got)
    held = [(langs[r["doc_id"]], r["lang_pred"]) for r in got if r["held_out"] and langs[r["doc_id"]]]
    assert len(held) > 150 and sum(a == b for a, b in held) / len(held) >= 0.97


def test_grammar_of_clauses():
    model = toxicity._prior()

    def found(text):
        return [toxicity.PATTERNS[p] for _, _, patterns in model.matches(text) for p, _ in patterns]

    assert found("what an idiot") == ["insult"]
    assert found("you are an idiot, you moron") == ["directed", "directed"]
    assert found("they are not an idiot") == ["negated"]
    assert found("he said you are an idiot") == ["reported"]
    assert found('the word "idiot" is old') == ["reported"]
    assert found("i will kill you") == ["threat"] and found("never kill him") == ["mock threat"]
    assert found("kill the process") == [] and found("you never. idiot") == ["insult"]
    assert found("idiotic and unstupid") == [] and found("") == []


def test_composition_is_running_in_turn():
    rng = np.random.default_rng(0)
    first, second = toxicity._build(3, 7, toxicity._reported), toxicity._build(5, 32, toxicity._negated)
    both = first.then(second)
    for _ in range(50):
        symbols = rng.integers(0, 7, 30)
        a = b = c = 0
        for s in symbols:
            mid = first.out[a][s]
            a, want, b = first.next[a][s], second.out[b][mid], second.next[b][mid]
            assert both.out[c][s] == want
            c = both.next[c][s]


def test_lexicon_is_learned():
    """A new word of many toxic texts is learned, and a stem of several; words of a
    copied toxic text are not."""
    rng = np.random.default_rng(1)
    fill = lambda: " ".join(f"v{n}" for n in rng.integers(0, 3000, 30))
    toxic = [f"{fill()} zork {fill()} grumbel{'abcdefgh'[i % 8]} {fill()}" for i in range(150)]
    one = f"{fill()} copied words of one text {fill()}"
    copied = [one.replace(" copied", f" copied c{i}") for i in range(100)]
    clean = [f"{fill()} {fill()}" for _ in range(600)]
    words, stems = toxicity.learn_lexicon(toxic + copied + clean, [1] * 250 + [0] * 600)
    assert "zork" in words and any("grumbela".startswith(s) for s in stems) and "copied" not in words
    assert not any(w.startswith("v") for w in words)
    model = toxicity.train(toxic + copied + clean, [1] * 250 + [0] * 600)
    assert model.score(f"{fill()} zork grumbelz zork") > 0.5 > model.score(fill())


def test_toxicity_cases(spark, documents, long_text):
    model = toxicity._prior()
    rows = [(1, None), (2, ""), (3, long_text), (None, "you idiot moron"), (5, "you idiot moron"), (5, "you idiot moron")]
    docs = documents(rows, CLASHING)
    got = toxicity.score_documents(docs, model).collect()
    assert [r["predicted"] for r in got] == [0, 0, 0, 1, 1, 1] and len({r["score"] for r in got[:3]}) == 1
    left = toxicity.without_toxic(docs, model)
    assert left.columns == docs.columns and [r["doc_id"] for r in left.collect()] == [1, 2, 3]
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert toxicity.score_documents(documents([]), toxicity.fit(documents([]), none)).collect() == []
    odd = spark.createDataFrame([(None, 1, 1), (3, 1, None), (3, 1, 7), (99, 0, 1)], "doc_id bigint, quality int, toxic int")
    assert toxicity.fit(docs, odd).weights.tolist() == model.weights.tolist()


def test_language_cases(documents, long_text):
    texts = ["the house and the garden " * 4, "das haus und der garten " * 4, "la maison et le jardin " * 4] * 40
    model = language.train(texts, ["en", "de", "fr"] * 40)
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !?", "en"), (4, "THE HOUSE", None), (5, long_text, "xx"), (None, "der garten", "de"), (7, "日本語 𝔘𝔫", "de")]
    got = {r["doc_id"]: r for r in language.identify(documents(rows, CLASHING), model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[1]["score"] == 0
    assert got[4]["lang_pred"] == "en" and got[None]["lang_pred"] == "de" and got[7]["lang_pred"] in ("en", "de", "fr")
    assert not got[None]["held_out"]
    empty = language.fit(documents([]))
    assert language.identify(documents([(1, "text")]), empty).first()["lang_pred"] == "und"
    assert language.identify(documents([]), model).collect() == []


def test_subwords():
    codes = language.letters("Ab, c")
    assert "".join(map(chr, codes)) == " ab c "
    # a b c, " a" ab "b " " c" "c ", " ab" "ab " " c ": nothing spans two words.
    assert len(language.subwords(codes)) == 3 + 5 + 3
    assert len(language.subwords(language.letters(""))) == 0


def test_calibration():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abcde" if i % 2 else "defgh"), 30)) for i in range(400)]
    model = language.train(texts, ["x" if i % 2 else "y" for i in range(400)])
    assert 0.05 <= model.temperature <= 5 and 0.5 <= model.level <= 1
