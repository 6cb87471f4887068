import random

import numpy as np

from lodegraph.llm.reading import Tongue, Words, fit_cuts, reading_levels, train, train_language
from lodegraph.llm.tokens import count_tokens

RNG = random.Random(9)
VOCAB = {lv: [f"{w}{lv}".replace(str(lv), "abcdef"[lv]) for w in ("lamo", "tiro", "pelu", "sano", "kirda", "vopen", "mudil", "rosan")] for lv in range(1, 6)}
COMMON = "the of and in is to that with for as".split()


def document(level, n=60):
    pick = lambda: RNG.choice(COMMON) if RNG.random() < 0.4 else RNG.choice(VOCAB[min(5, max(1, level + RNG.choice([0, 0, 0, 0, 1, -1])))])
    return " ".join(pick() for _ in range(n)) + "."


def test_cuts():
    x = np.array([1.0, 1.2, 2.0, 2.2, 2.2, 3.0])
    errors, gap, cuts = fit_cuts(x, np.array([1, 1, 2, 2, 2, 3]), 3)
    assert errors == 0 and np.allclose(cuts, [1.6, 2.6]) and abs(gap - 0.8) < 1e-9
    assert fit_cuts(x, np.array([1, 1, 1, 1, 1, 1]), 3)[0] == 0
    assert fit_cuts(np.array([1.0, 1.0]), np.array([1, 2]), 2)[0] == 1


def test_words():
    assert Words().of('A "late-phase" cell, 4.2 (mM)!') == ["a", "late-phase", "cell", "", "mm"]


def test_language(spark):
    """The language is learned from labels in several spellings and holds for texts with a wrong or no label."""
    german = [f"die zelle der niere ist nicht {RNG.choice(['gross', 'klein', 'rot'])} und das {RNG.choice(['blut', 'herz'])} " * 4 for _ in range(60)]
    english = [document(1 + i % 5) for i in range(200)]
    rows = [(i, t, RNG.choice(["en", "EN", "en-XX", " english"])) for i, t in enumerate(english)]
    rows += [(1000 + i, t, RNG.choice(["de", "DE-XX"])) for i, t in enumerate(german)] + [(2000, english[0], None), (2001, None, "en"), (None, "x", "en"), (2002, german[0], "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tongue, words = train_language(docs, "doc_id", "text", "lang"), Words()
    assert all(tongue.is_english(words.of(t)) for t in english) and not any(tongue.is_english(words.of(t)) for t in german)
    assert tongue.is_english(words.of("the lamoa of the vopenc")) and not tongue.is_english(["zelle"] * 50)
    assert train_language(docs.filter("lang is null"), "doc_id", "text", "lang") == Tongue({}, 1.0)
    assert train_language(docs.limit(0), "doc_id", "text", "lang") == Tongue({}, 1.0)
    assert not train_language(docs.filter("lang like '%de%'"), "doc_id", "text", "lang").is_english(["the"])


def test_held_out_accuracy(spark):
    rows = [(i, document(1 + i % 5)) for i in range(400)]
    labels = [(i, 1 + i % 5) for i in range(0, 200)] + [(3, 4), (9999, 1), (7, None), (8, 77)]
    extra = [(1000, None), (1001, ""), (1002, "the of and"), (1003, "der die das und ist nicht " * 20), (1004, "the " * 50), (5, rows[5][1]), (None, rows[6][1])]
    foreign = [(3000 + i, "der die das und ist nicht " * 20, "de") for i in range(20)]
    docs = spark.createDataFrame([(*r, "en" if r[0] in range(300) else None) for r in rows + extra] + foreign, "doc_id long, text string, lang string")
    model = train(docs, spark.createDataFrame(labels, "doc_id long, lv int"), "doc_id", "text", "lv", "lang")
    got = {r.doc_id: r.reading_level for r in reading_levels(docs, "doc_id", "text", model).collect()}
    assert set(got) == set(range(400)) | {1004}
    held = [got[i] == 1 + i % 5 for i in range(200, 400)]
    assert np.mean(held) >= 0.95


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, document(2))], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, lv int")
    model = train(docs, none, "doc_id", "text", "lv")
    assert [r.reading_level for r in reading_levels(docs, "doc_id", "text", model).collect()] == [3]


def test_token_counts():
    assert count_tokens(None) == count_tokens("") == 0
    text = "The cell  of 3 mice,\n\nand   a test. " * 3000
    from lodegraph.llm.tokens import DEFAULT_VOCABULARY, encoder

    assert count_tokens(text) == len(encoder(DEFAULT_VOCABULARY).encode_ordinary(text))
    assert count_tokens("x" * 50_000) > 0
