"""The parts of a freely typed compound name: kind, marker and stem.

A name is read as remarks, a form marker (`l`, `d`, `alpha`, `beta`), a chain
(as in `18:1`) and a stem.  Two names of one compound have the same kind, stem
and marks up to misspelling; what the reader can't explain stays in the stem, so
that an added chemical group keeps it far from the entry without it.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

from lodegraph.llm.bktree import distance
from lodegraph.llm.lookalikes import clean

# Words that remark on a sample and don't name a compound.
SALT = "sodium|potassium|calcium|magnesium|lithium|ammonium|zinc|disodium|dipotassium"
TRAILING = re.compile(
    rf"(?:^|[\s,])(?:(?:{SALT})\s+salt|salt|free acid|free base|(?:mono|di|tri|hemi)?hydrate|anhydrous|hcl|hydrochloride"
    r"|std|standard|stnd|species|lipid|checked|pure|purified|grade|(?:stock|batch|lot|no\.?)\s*\d+|\d+(?:\.\d+)?\s*%(?:\s*pure)?"
    r"|[<>~≥]\s*\d+(?:\.\d+)?\s*%|\d+(?:\.\d+)?\s*(?:[munpk]?[mgl]|ppm|ug|mg/ml|ng/ml)|[.*?!,;-]+)$"
)
LEADING = re.compile(r"^(?:total|crude|free|pure|purified|[.*?!,;]+)\s+")
SQUARE, CURLY = re.compile(r"\[[^\]]*\]"), re.compile(r"\{[^}]*\}")
_VENDOR = re.compile(r",(?!\d)")
PARENTHESES = re.compile(r"\(([^()]*)\)")
AMOUNT = re.compile(r"\s[-–]\s*\d+(?:\.\d+)?\s*\S+$")
AFTER = re.compile(r"\s*;.*$")
CHAIN = re.compile(r"(?<![a-z0-9])c?(\d{1,2}:\d{1,2})(?![0-9])")
# Groups that make another compound of the one they are added to.
GROUPS = re.compile(
    r"methyl|ethyl|acetyl|hydroxy|oxo|carbamoyl|phospho|phosphate|coa\b|glucuronide|dimer|sulfate|sulphate|amino|nitro|chloro|glycoside|ester"
)
LETTERS = {"α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta"}
FORMS = {"l": "l", "d": "d", "a": "alpha", "b": "beta", "alpha": "alpha", "beta": "beta"}
_PREFIX = re.compile(r"^\(?([ld])\)?\s*[-\s]\s*(?=[a-z0-9]{4})|^\(?([ab])\)?-(?=[a-z0-9]{4})")
_SUFFIX = re.compile(r",\s*([ldab])\s*-?$|,\s*(alpha|beta)\s*-?$")
_FORM = re.compile(r"^([ldab]|alpha|beta)(?:\s*-\s*\w{0,5})?$")
_WORDS = re.compile(r"[a-z0-9]+")


_WORDS_BACK = 6  # a remark at the end of a name has fewer words than this


class Name(NamedTuple):
    kind: str  # acid, chain or plain
    marker: str
    chain: str
    stem: str
    code: str  # the whole name as a short code


@lru_cache(maxsize=65536)
def near(a: str, b: str, most: int = 1) -> bool:
    """Whether a is b up to so many edits, under the metric of the trees; for short words."""
    return abs(len(a) - len(b)) <= most and distance(a, b) <= most


def _tail(s: str) -> int:
    """Where the last words of s begin, before the blank that precedes them."""
    at = len(s)
    for _ in range(_WORDS_BACK):
        at = s.rfind(" ", 0, at)
        if at < 0:
            return 0
    return at


def _without_brackets(s: str) -> str:
    for close, pattern in (("]", SQUARE), ("}", CURLY)):
        # only in front of the last closing bracket, where every opening one has an end
        end = s.rfind(close) + 1
        s = pattern.sub(" ", s[:end]) + s[end:]
    return s


def _without_remarks(s: str) -> tuple[str, str]:
    """(what is left of s without remarks before and after the name, marker found on the way)."""
    marker, before = "", None
    while before != s:
        before = s
        at = _tail(s)
        s = s[:at] + TRAILING.sub("", AMOUNT.sub("", s[at:]))
        if m := LEADING.match(s):
            s = s[m.end() :]
        s = s.strip(" \"'`")
        at = _tail(s)
        if m := _SUFFIX.search(s, at):
            marker, s = FORMS[m.group(1) or m.group(2)], s[: m.start()]
        elif "," in s and not s.startswith("ac") and (m := _VENDOR.search(s)):
            s = s[: m.start()]
    return s, marker


def read(text: str) -> Name:
    """The parts of a name that isn't blank."""
    s = re.sub(r"\s+", " ", clean(text)).strip().casefold()
    code = re.sub(r"[^a-z0-9]", "", s)
    for k, v in LETTERS.items():
        s = s.replace(k, v)
    s = s.strip("\"'` ")
    s = AFTER.sub("", _without_brackets(s)).strip()
    marker = ""
    chain = ""

    def inner(m: re.Match) -> str:
        nonlocal marker
        content = m.group(1).strip()
        if f := _FORM.match(content):
            marker = FORMS[f.group(1)]
            return " "
        return f" {content} " if CHAIN.search(content) or GROUPS.search(content) else " "

    s = PARENTHESES.sub(inner, s).strip()
    s, found = _without_remarks(s)
    marker = found or marker
    if m := _PREFIX.match(s):
        marker, s = FORMS[m.group(1) or m.group(2)], s[m.end() :]
    elif m := re.match(r"^([a-z0-9]{3,6})[-\s](?=[a-z0-9]{4})", s):
        for word in ("alpha", "beta"):
            if near(m.group(1), word, 2 if len(m.group(1)) > 4 else 1):
                marker, s = word, s[m.end() :]
                break
    elif m := re.match(r"^(alpha|beta)(?=[a-z0-9]{6})", s):
        marker, s = m.group(1), s[m.end() :]
    if m := CHAIN.search(s):
        chain, s = m.group(1), s[: m.start()] + " " + s[m.end() :]
        return Name("chain", marker, chain, "".join(_WORDS.findall(s)), code)
    words = _WORDS.findall(s)
    acid = [i for i, w in enumerate(words) if w == "ac" or (len(w) <= 5 and near(w, "acid"))]
    if acid and len(words) > 1:
        at = acid[0] if acid[0] == 0 else acid[-1]
        return Name("acid", marker, "", "".join(w for i, w in enumerate(words) if i != at), code)
    stem = "".join(words)
    for k in (4, 5, 3):
        if len(stem) > k + 5 and near(stem[-k:], "acid", k != 4) and stem[:-k].endswith(("c", "i")):
            return Name("acid", marker, "", stem[:-k], code)
    return Name("acid" if stem.endswith("lic") else "plain", marker, "", stem, code)


def entries(label: str) -> list[tuple[str, str, str, str]]:
    """(kind, marker, chain, stem) under which a reference label is found."""
    n = read(label)
    out = {(n.kind, n.marker, n.chain, n.stem)}
    if n.kind == "acid" and n.stem.endswith("ic"):
        out.add(("plain", n.marker, "", n.stem[:-2] + "ate"))
    elif n.kind == "plain" and n.stem.endswith("ate"):
        out.add(("acid", n.marker, "", n.stem[:-3] + "ic"))
    elif n.kind == "chain":
        out.add(("plain", n.marker, n.chain, n.stem))
    return sorted(out)
