"""Several values packed in one field: one row for each value, with its place.

The notation of a field is described by a parsing expression grammar; its
alternatives are tried in the order written, and a failed alternative gives its
input back::

    Field   <- '[' Packed ']' / '{' Packed '}' / Packed        brackets around the whole field
    Packed  <- Value (Delim Value)*
    Value   <- Quoted('"') / Quoted("'") / Broken / Bare
    Quoted  <- Blank* q (q q / '\\' . / !(q Blank* End) .)* q Blank* &End
    Broken  <- Blank* q Bare                                   a quote that is never closed
    Bare    <- ('\\' . / !Delim .)*
    End     <- Delim / !.
    Delim   <- Strong / Comma                                  term fields, see below
    Delim   <- [;,|/] / Blank                                  symbol fields
    Strong  <- ';' / '|' / tab / newline / blank '/' blank
    Comma   <- ',' but not between two digits

In a term field a comma delimits only where no strong delimiter occurs outside
quotes and escapes, so Packed is tried with Strong alone and then with Comma.
Every terminal is a compiled regular expression, so that a value costs a few
matches and not a step for each character.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRONG = r"(?:[;|\t\n\r]|(?<=\s)/(?=\s))"
COMMA = r"(?:(?<!\d),|,(?!\d))"
SYMBOL = r"[;,|/\s]"
ITEMS = T.ArrayType(
    T.StructType().add("item_pos", T.IntegerType()).add("item_value", T.StringType()).add("item_flag", T.StringType())
)
_ITEM_TYPE = pa.list_(pa.struct([("item_pos", pa.int32()), ("item_value", pa.string()), ("item_flag", pa.string())]))
_ESCAPED = re.compile(r"\\([;,|/\s\\\"'\[\]{}])")
_BRACKETS = {"[": "]", "{": "}"}


class Grammar:
    """The grammar above for one set of delimiters."""

    def __init__(self, delim: str):
        end = rf"(?=\s*(?:{delim}|\Z))"
        self.delim = re.compile(delim)
        self.quoted = [
            (
                q,
                # possessive: a quote that isn't closed fails at once and isn't tried in other ways
                re.compile(rf"\s*{q}((?:{q}{q}|\\.|[^{q}\\]|{q}(?!{q})(?!\s*(?:{delim}|\Z)))*+){q}\s*?{end}", re.S),
                re.compile(q + end),
            )
            for q in "\"'"
        ]
        self.bare = re.compile(rf"(?:\\.|(?!{delim}).)*", re.S)
        self.opening = re.compile(r"\s*[\"']")
        self.rest = re.compile(r"\s*?(?=" + delim + r"|\Z)")

    def values(self, text: str) -> tuple[list[tuple[str, str]], set[str]]:
        """([(value, flag)], delimiters met outside quotes); blank values are kept."""
        out, met, at = [], set(), 0
        # no quote that starts behind the last closing one can be closed
        last = {q: max((m.start() for m in closing.finditer(text)), default=-1) if q in text else -1 for q, _, closing in self.quoted}
        while True:
            for q, pattern, _ in self.quoted:
                if at < last[q] and (m := pattern.match(text, at)):
                    value, flag = _ESCAPED.sub(r"\1", m.group(1).replace(q + q, q)), "quoted"
                    break
            else:
                m = self.bare.match(text, at)
                value, flag = m.group(), "bare"
                if opening := self.opening.match(value):
                    value, flag = value[opening.end() :], "broken_quote"
                elif "\\" in value:
                    flag = "escaped"
                value = _ESCAPED.sub(r"\1", value)
            out.append((value.strip(), flag))
            at = self.rest.match(text, m.end()).end() if flag == "quoted" else m.end()
            if at >= len(text):
                return out, met
            m = self.delim.match(text, at)
            met.add(m.group())
            at = m.end()


@lru_cache(maxsize=8)
def grammar(delim: str) -> Grammar:
    return Grammar(delim)


def unpack(text: str | None, symbols: bool = False) -> list[tuple[str, str]]:
    """[(value, flag)] of the non-blank values of a field, in order."""
    if text is None:
        return []
    text = text.strip()
    enclosed = len(text) > 1 and _BRACKETS.get(text[0]) == text[-1]
    if enclosed:
        text = text[1:-1]
    if not text.strip():
        return []
    if symbols:
        found, _ = grammar(SYMBOL).values(text)
    else:
        found, met = grammar(f"(?:{STRONG}|{COMMA})").values(text)
        strong = met - {","}
        if strong and "," in met:
            found, _ = grammar(STRONG).values(text)
    flags = {"bare": "bracketed"} if enclosed else {}
    return [(v, flags.get(f, f)) for v, f in found if v]


def _unpack_batch(values: Sequence[str | None], symbols: bool) -> list[list[dict]]:
    return [
        [{"item_pos": k, "item_value": v, "item_flag": f} for k, (v, f) in enumerate(unpack(x, symbols), 1)] for x in values
    ]


@F.arrow_udf(ITEMS)
def _unpack_terms(x: pa.Array) -> pa.Array:
    return pa.array(_unpack_batch(x.to_pylist(), False), _ITEM_TYPE)


@F.arrow_udf(ITEMS)
def _unpack_symbols(x: pa.Array) -> pa.Array:
    return pa.array(_unpack_batch(x.to_pylist(), True), _ITEM_TYPE)


def unpack_fields(df: DataFrame, key: str, term_fields: Sequence[str], symbol_fields: Sequence[str] = ()) -> DataFrame:
    """One row for each value packed in the given fields.

    Result: key, field_name, item_pos (from 1 over the non-blank values),
    item_value, item_flag (``bare``, ``quoted``, ``escaped``, ``bracketed``, or
    ``broken_quote`` for a quote that is never closed, which is read as a bare
    value without the quote).

    Null, blank and delimiter-only fields give no row; a value that occurs twice
    gives two.  Rows sent again under the same key count once; a null key counts
    as one key.  Other columns are ignored, whatever their names.
    """
    rows = df.select(key, *term_fields, *symbol_fields).dropDuplicates([key])
    cells = [F.struct(F.lit(n).alias("field_name"), F.lit(n in symbol_fields).alias("of_symbols"), F.col(n).alias("packed")) for n in (*term_fields, *symbol_fields)]
    long = rows.select(key, F.inline(F.array(*cells))).filter(F.trim("packed") != "")
    # each parser gets null for the other one's fields
    terms = _unpack_terms(F.when(~F.col("of_symbols"), F.col("packed")))
    symbols = _unpack_symbols(F.when(F.col("of_symbols"), F.col("packed")))
    return long.select(key, "field_name", F.inline(F.concat(terms, symbols)))
