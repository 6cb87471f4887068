"""Identifiers, buckets and normal forms, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spellings of identifier sources and their canonical names; other names are put in upper case.
SOURCE_NAMES = {
    "pubchem.compound": "PUBCHEM.COMPOUND", "pubchem": "PUBCHEM.COMPOUND", "inchi.key": "INCHIKEY",
    "comptox": "EPA.COMPTOX", "guide.to.pharmacology": "GUIDE_TO_PHARMACOLOGY", "nci": "NCIT", "umls.cui": "UMLS",
    "ncbigene": "NCBI.GENE", "cell.ontology": "CL", "cellontology": "CL",
}
# Prefixes that are written with `_` before an identifier.
UNDERSCORE_PREFIXES = ("MONDO", "DOID", "EFO", "HP", "GO", "CHEBI", "NCIT", "ORPHANET", "CL", "UBERON")


def _payload(parts: tuple[Column, ...]) -> Column:
    # concat_ws leaves nulls out, as the rule for empty parts wants
    return F.concat_ws("|", *[F.nullif(F.trim(p.cast("string")), F.lit("")) for p in parts])


def stable_uid_sha1(prefix: str, *parts: Column) -> Column:
    """prefix_ + 20 hex digits of the SHA-1 of the trimmed non-empty parts joined by `|`."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha1(_payload(parts)), 1, 20))


def stable_uid_sha256(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(_payload(parts), 256), 1, 20))


def hash_bucket(c: Column, digits: int, modulus: int) -> Column:
    """The first hex digits of the SHA-256, modulo; (12, 100), (8, 5) and (8, 10) are the variants in use."""
    return F.conv(F.substring(F.sha2(c, 256), 1, digits), 16, 10).cast("long") % modulus


def text_key(c: Column) -> Column:
    """Lower case, trimmed, blanks collapsed; for texts in ASCII or already composed."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


@F.arrow_udf(T.StringType())
def _folded(x: pa.Array) -> pa.Array:
    import unicodedata

    coded = x.dictionary_encode()
    fold = lambda v: None if v is None else " ".join(unicodedata.normalize("NFKC", v).casefold().split())
    return pa.array([fold(v) for v in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


def folded_key(c: Column) -> Column:
    """NFKC, case-folded, trimmed, blanks collapsed; texts in ASCII stay in the JVM."""
    return F.coalesce(_folded(F.when(c.rlike(r"[^\x00-\x7f]"), c)), text_key(c))


def id_token(c: Column) -> Column:
    """The text key with `_` as `:` and without blanks."""
    return F.regexp_replace(F.replace(text_key(c), F.lit("_"), F.lit(":")), r"\s+", "")


def name_key(c: Column) -> Column:
    """The text key with runs of other signs than letters and digits as one blank."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def source_name(c: Column, names: Mapping[str, str] = SOURCE_NAMES) -> Column:
    bare = F.trim(F.regexp_replace(F.trim(c), '^"|"$', ""))
    low = F.replace(F.lower(bare), F.lit("_"), F.lit("."))
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.element_at(known, low), F.upper(bare))


def parse_xref(c: Column) -> Column:
    """Struct (source, id, key) of `SOURCE:id`, with the remarks of an ontology file cut off; null if it isn't one."""
    token = F.trim(F.regexp_replace(F.trim(c), r" [{!].*$", ""))
    source = source_name(F.regexp_extract(token, "^([^:]+):", 1))
    ident = F.trim(F.regexp_extract(token, "^[^:]+:(.*)$", 1))
    made = F.struct(source.alias("source"), ident.alias("id"), F.concat(source, F.lit(":"), ident).alias("key"))
    return F.when(ident != "", made)


def prefixed_id(c: Column) -> Column:
    """`SOURCE:id` of an identifier that carries its source as prefix, else null."""
    s = F.trim(c)
    marked = rf"(?i)^({'|'.join(UNDERSCORE_PREFIXES)})_(.+)$"
    return (
        F.when(s.contains(":"), parse_xref(s)["key"])
        .when(s.rlike(marked), F.concat(F.upper(F.regexp_extract(s, marked, 1)), F.lit(":"), F.regexp_extract(s, marked, 2)))
        .when(s.startswith("ENSG"), F.concat(F.lit("ENSEMBL:"), F.substring_index(s, ".", 1)))
        .when(s.startswith("WP"), F.concat(F.lit("WIKIPATHWAYS:"), s))
        .when(s.startswith("R-HSA-"), F.concat(F.lit("REACTOME:"), s))
    )


def distinct_nonblank(c: Column) -> Column:
    """The trimmed elements of a list in their first order, without blanks, `-` and repeats."""
    return F.array_distinct(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: (x != "") & (x != "-")))


def hill_formula(c: Column) -> Column:
    """A formula in Hill order (C, H, then by letter) with equal elements added up; others stay as they are."""
    raw = F.regexp_replace(c, r"\s+", "")
    tokens = F.regexp_extract_all(raw, F.lit("([A-Z][a-z]?[0-9]*)"), 1)
    element = lambda t: F.regexp_extract(t, "^[A-Z][a-z]?", 0)
    count = lambda t: F.coalesce(F.nullif(F.regexp_extract(t, "[0-9]+$", 0), F.lit("")).cast("long"), F.lit(1).cast("long"))
    place = lambda e: F.when(e == "C", F.lit("0")).when(e == "H", F.lit("1")).otherwise(F.concat(F.lit("2"), e))
    elements = F.array_sort(F.array_distinct(F.transform(tokens, lambda t: place(element(t)))))
    name = lambda p: F.when(p == "0", F.lit("C")).when(p == "1", F.lit("H")).otherwise(F.substring(p, 2, 2))
    total = lambda e: F.aggregate(F.filter(tokens, lambda t: element(t) == e), F.lit(0).cast("long"), lambda a, t: a + count(t))
    part = lambda p: F.concat(name(p), F.when(total(name(p)) != 1, total(name(p)).cast("string")).otherwise(""))
    hill = F.array_join(F.transform(elements, part), "")
    return F.when(F.array_join(tokens, "") == raw, hill).otherwise(raw)


def inchikey_block(c: Column) -> Column:
    """The connectivity block of an InChIKey."""
    key = F.upper(id_token(c))
    return F.when(key.contains("-"), F.substring_index(key, "-", 1)).otherwise(F.substring(key, 1, 14))


def canonical_json(fields: Mapping[str, Column]) -> Column:
    """A JSON object of strings with sorted keys and without nulls."""
    return F.to_json(F.struct(*[fields[k].cast("string").alias(k) for k in sorted(fields)]))


def to_float(c: Column) -> Column:
    """Double; null for blanks, `-`, NaN and what isn't a number."""
    x = F.trim(c).try_cast("double")
    return F.when(~F.isnan(x), x)


def to_int(c: Column) -> Column:
    """Long of a whole number, also one written with a decimal part; null otherwise."""
    return F.coalesce(F.trim(c).try_cast("long"), to_float(c).try_cast("long"))


def publication_year(c: Column) -> Column:
    """The first year from 1800 to 2100 in a date text."""
    return F.nullif(F.regexp_extract(c, r"\b(18[0-9]{2}|19[0-9]{2}|20[0-9]{2}|2100)\b", 1), F.lit("")).cast("int")
