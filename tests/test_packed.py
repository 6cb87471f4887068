import pytest

from lodegraph.operators.packed import unpack, unpack_fields


def values(text, symbols=False):
    return [v for v, _ in unpack(text, symbols)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, []),
        ("", []),
        (" ; ;", []),
        ("[]", []),
        ("one", ["one"]),
        ("a b; c ;; d", ["a b", "c", "d"]),
        ("late phase of x, type II; y", ["late phase of x, type II", "y"]),
        ("x one, y two", ["x one", "y two"]),
        ("3,4-bis, five", ["3,4-bis", "five"]),
        ("a/b cycle | c", ["a/b cycle", "c"]),
        ("a / b / c, d", ["a", "b", "c, d"]),
        ('"a; b"; c', ["a; b", "c"]),
        ("'a, b', c", ["a, b", "c"]),
        ('x, "a; b",c', ["x", "a; b", "c"]),
        (r"a\; b; c", ["a; b", "c"]),
        ('"""a"" part"; b', ['"a" part', "b"]),
        (r'["\"a\" part", "b, c"]', ['"a" part', "b, c"]),
        ("{a b,c , 'd'}", ["a b", "c", "d"]),
        ("u'-phosphate; v", ["u'-phosphate", "v"]),
        ("'u'-phosphate'; v", ["u'-phosphate", "v"]),
        ('"a; b', ["a", "b"]),
        ("a\tb\nc", ["a", "b", "c"]),
        ("a;a", ["a", "a"]),
    ],
)
def test_terms(text, want):
    assert values(text) == want


def test_symbols():
    assert values("A1 B2;C3/D4|E5,F6\tG7", True) == ["A1", "B2", "C3", "D4", "E5", "F6", "G7"]
    assert values('["A1","B2"]', True) == ["A1", "B2"]


def test_flags():
    assert unpack('"a; b') == [("a", "broken_quote"), ("b", "bare")]
    assert unpack("{a, b}") == [("a", "bracketed"), ("b", "bracketed")]


def test_frame(spark):
    rows = [(1, "a;b", "X Y", 5), (1, "a;b", "X Y", 5), (2, None, " ", 6), (None, "c", None, 7)]
    df = spark.createDataFrame(rows, "id int, t string, s string, item_pos int")
    got = {tuple(r) for r in unpack_fields(df, "id", ["t"], ["s"]).drop("item_flag").collect()}
    assert got == {(1, "s", 1, "X"), (1, "s", 2, "Y"), (1, "t", 1, "a"), (1, "t", 2, "b"), (None, "t", 1, "c")}
    assert unpack_fields(df.limit(0), "id", ["t"], ["s"]).count() == 0


def test_long_text():
    assert len(unpack("x, " * 200_000)) == 200_000
    assert unpack('"' * 2001)


def test_hostile_quotes():
    assert unpack('"' + '""' * 60 + "x")
    assert unpack("'" + "''" * 60 + "x;y")[-1][0] == "y"
    assert len(unpack('"a;' * 50_000)) == 50_000
    assert len(unpack('"a" x;' * 20_000)) == 20_000
