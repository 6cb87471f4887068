"""SQL text that folds a name as ``functions.keys.folded_key`` does, from the character data of Python's Unicode tables."""

from __future__ import annotations

import unicodedata


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _cases() -> tuple[dict[str, str], dict[str, str]]:
    """(compatibility forms, case folds) of the characters of the first two planes; canonical forms are left to the database."""
    plain, folds = {}, {}
    for code in range(128, 0x20000):
        c = chr(code)
        if 0xD800 <= code <= 0xDFFF or 0xF900 <= code <= 0xFAFF:
            continue
        if unicodedata.decomposition(c).startswith("<"):
            plain[c] = unicodedata.normalize("NFKD", c)
        if c.casefold() != c and c.casefold() != c.lower():
            folds[c] = c.casefold()
    return plain, folds


_PLAIN, _FOLDS = _cases()
_ONE = {k: v for k, v in _PLAIN.items() if len(v) == 1}
_MORE = {k: v for k, v in _PLAIN.items() if len(v) != 1}
_BLANKS = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _mapped(x: str, table: dict[str, str]) -> str:
    """Every character of x by its entry in a table of characters and texts."""
    keys, values = ", ".join(map(_quoted, table)), ", ".join(map(_quoted, table.values()))
    return f"array_to_string(list_transform(string_split({x}, ''), lambda c: coalesce(map([{keys}], [{values}])[c], c)), '')"


def folded(x: str) -> str:
    """NFKC, case-folded, blanks collapsed and trimmed; texts in printable ASCII take the short way."""
    one = f"translate({x}, {_quoted(''.join(_ONE))}, {_quoted(''.join(_ONE.values()))})"
    rare = "[" + "".join(_MORE) + "]"
    many = f"case when regexp_matches({x}, {_quoted(rare)}) then {_mapped(one, _MORE)} else {one} end"
    low = f"lower(nfc_normalize({many}))"
    for k, v in _FOLDS.items():
        if len(v) <= 2 and ord(k) < 0x500:
            low = f"replace({low}, {_quoted(k)}, {_quoted(v)})"
    whole = f"trim(regexp_replace({low}, {_quoted(_BLANKS)}, ' ', 'g'), ' ')"
    return f"case when regexp_matches({x}, '[^ -~]') then {whole} else lower(trim(regexp_replace({x}, '\\s+', ' ', 'g'))) end"
