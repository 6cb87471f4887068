"""One consistent spelling for texts that look the same (pure Python kernel).

A text is brought to its form in four steps, all of them per token (a token is a
maximal run without blanks):

1. invisible characters are dropped and blanks, hyphens, wide and ligature forms
   are made plain, on the decomposed text, so that an accent cut off from its
   letter by an invisible character still composes;
2. the script sets of the token's letters are intersected (characters of the
   scripts ``Common`` and ``Inherited`` stand for every script);
3. an empty intersection means a mixed-script token.  The candidate scripts are
   tried in a fixed order: a script is consistent when every letter of the token
   either belongs to it or has a look-alike in it.  Latin wins when the token
   has Latin letters; Greek letters that are not look-alikes (alpha, beta, kappa
   as symbols) never decide and are never replaced;
4. accents are composed again (NFC).

A token wholly in one foreign script is a *whole-script* token: it is reported
as confusable when it has a complete Latin spelling, but its spelling stays.

Look-alikes of Latin letters come from the public Unicode table of confusables,
which Spark's own libraries hold (:func:`confusables`); :func:`use` puts it to use
in a process.  The fixed letters below go before it, and are all there is without
it.
"""

from __future__ import annotations

import glob
import os
import struct
import unicodedata
import zipfile
from functools import lru_cache

import regex

# Letters of other scripts that are drawn like Latin letters.
CYRILLIC_LATIN = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХҮԌԚԜаеѕіјорсухһԁԛԝѵүӏ",
        "ABESIJKMHOPCTYXYGQWaesijopcyxhdqwvyl",
        strict=True,
    )
)
GREEK_LATIN = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳ", "ABEZHIKMNOPTYXocj", strict=True))
ARMENIAN_LATIN = dict(zip("օսոցհՕՍԼ", "ounghOUL", strict=True))
CHEROKEE_LATIN = dict(zip("ᎪᎬᎫᎻᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "AEJHKLMPRSTVWZ", strict=True))
# Latin letters that are drawn like plain ones: they are replaced in every word.
LATIN_PLAIN = {"ɡ": "g", "ɑ": "a", "ꞵ": "β", "ƽ": "s"}
#: Marks drawn like the plain hyphen.
HYPHENS = "\u2010\u2011\u2012\u2013\u2043\u2212\ufe58\ufe63\uff0d\u02d7"
#: Signs without a visible form that are not of the category Cf.
INVISIBLE_MARKS = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180f\u3164\uffa0"
#: Compatibility forms that look different from their plain letters and stay.
VISIBLE_FORMS = ("<super>", "<sub>", "<fraction>", "<square>", "<circle>", "<vertical>")

SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian", "Cherokee")
# Other scripts with letters that are drawn like Latin ones.
OTHER_SCRIPTS = (
    "Coptic", "Lisu", "Georgian", "Deseret", "Hebrew", "Arabic", "Devanagari", "Bengali", "Gujarati", "Gurmukhi", "Kannada", "Malayalam", "Tamil", "Telugu", "Oriya", "Sinhala",
    "Thai", "Lao", "Myanmar", "Ethiopic", "Canadian_Aboriginal", "Runic", "Ogham", "Tifinagh", "Nko", "Vai", "Bamum", "Miao", "Osage", "Warang_Citi", "Carian", "Lycian", "Lydian",
    "Old_Italic", "Gothic", "Elbasan", "Glagolitic", "Han", "Hangul", "Hiragana", "Katakana", "Bopomofo",
)
FIXED_LATIN = CYRILLIC_LATIN | GREEK_LATIN | ARMENIAN_LATIN | CHEROKEE_LATIN
TO_LATIN = dict(FIXED_LATIN)
#: Look-alikes by target script; the foreign targets are the tables read backwards.
TO_SCRIPT = {
    "Latin": TO_LATIN,
    "Cyrillic": {v: k for k, v in reversed(list(CYRILLIC_LATIN.items()))},
    "Greek": {v: k for k, v in reversed(list(GREEK_LATIN.items()))},
    "Armenian": {v: k for k, v in reversed(list(ARMENIAN_LATIN.items()))},
    "Cherokee": {v: k for k, v in reversed(list(CHEROKEE_LATIN.items()))},
}
_SCRIPT_TESTS = [(s, regex.compile(rf"\p{{scx={s}}}")) for s in (*SCRIPTS, *OTHER_SCRIPTS)]
_COMMON = regex.compile(r"[\p{sc=Common}\p{sc=Inherited}]")
_BLANKS = regex.compile(r"\s")
_TOKEN = regex.compile(r"[^ ]+")


@lru_cache(maxsize=2)
def confusables(spark_home: str | None = None) -> dict[str, str]:
    """Letters of other scripts than Latin and Greek that the Unicode table gives a single Latin letter; {} without the table.

    The table gives every sign the plainest one that is drawn like it, without
    regard to case: capitals that are drawn like `l` are `I` here.  Greek letters
    are left out, since most are used as Greek.
    """
    if spark_home is None:
        from pyspark.find_spark_home import _find_spark_home

        spark_home = _find_spark_home()
    jars = sorted(glob.glob(os.path.join(spark_home, "jars", "icu4j-*.jar")))
    if not jars:
        return {}
    with zipfile.ZipFile(jars[-1]) as z:
        names = [n for n in z.namelist() if n.endswith("/confusables.cfu")]
        data = z.read(names[0]) if names else b""
    if not data:
        return {}
    # a header whose size comes first, then places and lengths of keys, values and texts, all big-endian
    body = data[struct.unpack(">H", data[:2])[0] :]
    keys_at, n_keys, values_at, n_values, texts_at, n_texts = struct.unpack(">6i", body[12:36])
    keys = struct.unpack(f">{n_keys}i", body[keys_at : keys_at + 4 * n_keys])
    values = struct.unpack(f">{n_values}H", body[values_at : values_at + 2 * n_values])
    out = {}
    for key, value in zip(keys, values, strict=True):
        ch, length = chr(key & 0xFFFFFF), (key >> 24 & 0xFF) + 1
        if length != 1 or not chr(value).isascii() or not chr(value).isalpha() or not unicodedata.category(ch).startswith("L"):
            continue
        scripts = scripts_of(ch)
        if scripts and not scripts & {"Latin", "Greek"}:
            capital = unicodedata.category(ch) == "Lu" or "Lisu" in scripts
            out[ch] = "I" if value == ord("l") and capital else chr(value)
    return out


def use(table: dict[str, str]) -> None:
    """Take these look-alikes of Latin letters beside the fixed ones, in this process."""
    latin = table | FIXED_LATIN
    if latin != TO_LATIN:
        TO_LATIN.clear()
        TO_LATIN.update(latin)
        _token.cache_clear()


@lru_cache(maxsize=65536)
def plain(ch: str) -> str:
    """The decomposed plain form of one character; '' for an invisible one."""
    code = ord(ch)
    if 32 < code < 127:
        return ch
    if _BLANKS.match(ch) or ch == "\u2800":
        return " "
    kind = unicodedata.category(ch)
    if kind in ("Cf", "Cc") or ch in INVISIBLE_MARKS or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF:
        return ""
    if ch in HYPHENS:
        return "-"
    if ch in LATIN_PLAIN:
        return LATIN_PLAIN[ch]
    form = unicodedata.decomposition(ch)
    if form.startswith(VISIBLE_FORMS):
        return ch
    if kind[0] not in "LNMPSZ":
        return ch
    out = unicodedata.normalize("NFKD", ch)
    if out == ch or kind[0] == "Z":
        return " " if kind[0] == "Z" else ch
    return "".join(plain(c) if c != ch else c for c in out)


@lru_cache(maxsize=65536)
def scripts_of(ch: str) -> frozenset[str]:
    """The script set of a character; empty for one that stands for all scripts."""
    if _COMMON.match(ch):
        return frozenset()
    return frozenset(s for s, test in _SCRIPT_TESTS if test.match(ch)) or frozenset(["Other"])


def resolve(token: str) -> tuple[str, str]:
    """(kind, spelling) of a decomposed token.

    kind: ``single`` (one script), ``whole`` (one foreign script and wholly
    writable in Latin), ``mixed`` (replaced), ``unresolved`` (mixed without a
    consistent spelling; foreign look-alikes beside Latin letters still become
    Latin).
    """
    sets = [s for s in map(scripts_of, token) if s]
    if not sets:
        return "single", token
    common = frozenset.intersection(*sets)
    if common:
        if "Latin" not in common and all(c in TO_LATIN for c in token if scripts_of(c)):
            return "whole", token
        return "single", token
    #: Greek symbols beside Latin letters are Greek used as Greek.
    letters = [c for c in token if scripts_of(c)]
    for script in SCRIPTS:
        table = TO_SCRIPT[script]
        free = [c for c in letters if script not in scripts_of(c)]
        own = len(letters) - len(free)
        if script == "Latin":
            free = [c for c in free if c in table or "Greek" not in scripts_of(c)]
        if own and all(c in table for c in free):
            return "mixed", "".join(table.get(c, c) if scripts_of(c) and script not in scripts_of(c) else c for c in token)
    if any("Latin" in scripts_of(c) for c in letters):
        return "unresolved", "".join(TO_LATIN.get(c, c) for c in token)
    return "unresolved", token


@lru_cache(maxsize=262144)
def _token(token: str) -> str:
    return unicodedata.normalize("NFC", resolve(token)[1])


def clean(text: str) -> str:
    """The consistent form of a text. Blank runs and outer blanks stay in number."""
    if text.isascii() and text.isprintable():
        return text
    flat = unicodedata.normalize("NFD", "".join(map(plain, text)))
    return _TOKEN.sub(lambda m: _token(m.group()), flat)


def kinds(text: str) -> list[str]:
    """The kinds found by :func:`resolve`, one for each token of the text."""
    flat = unicodedata.normalize("NFD", "".join(map(plain, text)))
    return [resolve(t)[0] for t in _TOKEN.findall(flat)]
