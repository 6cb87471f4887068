import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lodegraph.llm import lookalikes, spelling
from lodegraph.llm.lookalikes import clean, kinds


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", ""),
        ("plain text", "plain text"),
        ("ｆｕｌｌ ｗｉｄｔｈ１２", "full width12"),
        ("ac⁠іdе", "acide"),
        ("kopéique", "kopéique"),
        ("kope​́ique", "kopéique"),
        ("a b c　d", "a b c d"),
        ("β‑silate", "β-silate"),
        ("µ-oxide", "μ-oxide"),
        ("3 Å sieve", "3 Å sieve"),
        ("ﬂokate ﬁb", "flokate fib"),
        ("quk2γ protein", "quk2γ protein"),
        ("ΜΟΑL1", "MOAL1"),
        ("пиролизат", "пиролизат"),
        ("каризoлин", "каризолин"),
        ("vemiɡa", "vemiga"),
        ("x­y﻿", "xy"),
        ("x²", "x²"),
    ],
)
def test_clean(text, want):
    assert clean(text) == want


@pytest.fixture
def whole_table():
    lookalikes.use(lookalikes.confusables())
    yield lookalikes.TO_LATIN
    lookalikes.use({})


def test_unicode_table(whole_table):
    """Letters beyond the fixed ones: Lisu, Coptic, Cyrillic; Greek symbols and whole foreign words stay."""
    assert len(whole_table) > 250 and not any("GREEK SMALL" in unicodedata.name(c, "") for c in lookalikes.confusables())
    assert [clean(t) for t in ("ꓐeta", "ⲟxide", "gluсose", "pгoxy", "Іlan")] == ["Beta", "oxide", "glucose", "proxy", "Ilan"]
    assert [clean(t) for t in ("α-tocopherol", "кислота", "ꓐꓠꓢ")] == ["α-tocopherol", "кислота", "ꓐꓠꓢ"]
    assert lookalikes.confusables("/nowhere") == {}


@given(st.text(max_size=60))
def test_idempotent_with_the_unicode_table(text):
    lookalikes.use(lookalikes.confusables())
    once = clean(text)
    assert clean(once) == once
    lookalikes.use({})


def test_kinds():
    assert kinds("сор mіx latin") == ["whole", "mixed", "single"]


@given(st.text(max_size=60))
def test_idempotent(text):
    once = clean(text)
    assert clean(once) == once
    assert unicodedata.is_normalized("NFC", once)


def test_frame(spark):
    rows = [("a", "mіx", None, ["ok", None, "ｗ"]), ("a", "mіx", None, ["ok", None, "ｗ"]), ("b", "​", "plain", []), ("c", None, "", None)]
    df = spark.createDataFrame(rows, "k string, s string, t string, l array<string>")
    got = {tuple(r) for r in spelling.inconsistent_texts(df, "k", ("s", "t"), ("l",), "x").drop("text").collect()}
    assert got == {("x", "a", "s", 1, "mix"), ("x", "b", "s", 1, ""), ("x", "a", "l", 3, "w")}
    assert spelling.inconsistent_texts(df.limit(0), "k", ("s",), ("l",)).count() == 0
    long = spark.createDataFrame([("і" + "x" * 300_000,)], "s string").select(spelling.consistent(spelling.F.col("s")).alias("c")).head()[0]
    assert long == "i" + "x" * 300_000
