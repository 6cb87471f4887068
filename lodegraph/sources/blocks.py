"""Text formats of records in blocks: OBO, MSP, flat files with two-letter keys, GTF and GMT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_blocks(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """lines (list of the trimmed non-blank lines) of each block. Blocks are cut by the reader, so a file is split over tasks."""
    text = spark.read.text(path, lineSep=separator)
    lines = F.filter(F.transform(F.split(F.regexp_replace("value", "\r", ""), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return text.select(lines.alias("lines")).filter(F.size("lines") > 0)


def tagged(lines: str, tag: str, separator: str = ":") -> Column:
    """The values of all lines `tag: value`, in order."""
    head = f"{tag}{separator}"
    return F.transform(F.filter(lines, lambda x: x.startswith(head)), lambda x: F.trim(F.substring(x, F.lit(len(head) + 1), F.length(x))))


def first_tag(lines: str, tag: str, separator: str = ":") -> Column:
    return F.get(tagged(lines, tag, separator), 0)


def quoted(c: Column) -> Column:
    """The text between the first pair of quotes, else the whole."""
    q = F.regexp_extract(c, r'"((?:[^"\\]|\\.)*)"', 1)
    return F.when(q != "", q).otherwise(F.when(c.startswith('""'), F.lit("")).otherwise(c))


def read_obo(spark: SparkSession, path: str, keep_obsolete: bool = False) -> DataFrame:
    """id, name, definition, synonyms, xrefs, alt_ids, parents, subsets, is_obsolete of the [Term] blocks of an OBO file.

    Parents and xrefs are without the remarks after ` !` and ` {`.
    """
    b = read_blocks(spark, path, "\n\n").filter(F.array_contains("lines", "[Term]"))
    bare = lambda c: F.transform(c, lambda x: F.trim(F.regexp_replace(x, r" [!{].*$", "")))
    out = b.select(
        first_tag("lines", "id").alias("id"), first_tag("lines", "name").alias("name"), quoted(first_tag("lines", "def")).alias("definition"),
        F.transform(tagged("lines", "synonym"), lambda x: F.regexp_extract(x, '"([^"]*)"', 1)).alias("synonyms"), bare(tagged("lines", "xref")).alias("xrefs"),
        bare(tagged("lines", "alt_id")).alias("alt_ids"), bare(tagged("lines", "is_a")).alias("parents"), tagged("lines", "subset").alias("subsets"),
        F.coalesce(first_tag("lines", "is_obsolete") == "true", F.lit(False)).alias("is_obsolete"),
    ).filter("id is not null")
    return out if keep_obsolete else out.filter(~F.col("is_obsolete"))


# What the keys of a spectral library are also called.
MSP_ALIASES = {"precursormz": "precursor_mz", "precursor_type": "adduct", "precursortype": "adduct", "ionmode": "ion_mode", "db": "source_record_id", "database_id": "source_record_id", "hmdb": "hmdb_id", "chebi": "chebi_id", "pubchem": "pubchem_cid", "kegg": "kegg_id"}


def parse_peaks(text: Column) -> Column:
    """[(mz, intensity)] of `mz:intensity` or `mz|intensity` tokens parted by blanks, `;` or `,`; intensity 1 where it is missing or not positive."""
    tokens = F.filter(F.split(F.regexp_replace(text, "[;,]", " "), r"\s+"), lambda t: t != "")
    pair = lambda t: F.struct(F.get(F.split(t, "[:|]"), 0).try_cast("double").alias("mz"), F.get(F.split(t, "[:|]"), 1).try_cast("double").alias("i"))
    fixed = F.transform(F.transform(tokens, pair), lambda p: F.struct(p["mz"].alias("mz"), F.when(p["i"] > 0, p["i"]).otherwise(1.0).alias("intensity")))
    return F.filter(fixed, lambda p: p["mz"] > 0)


def read_msp(spark: SparkSession, path: str) -> DataFrame:
    """fields (map, keys in snake case with their usual names) and peaks of the blocks of an MSP library."""
    b = read_blocks(spark, path, "\n\n")
    is_field = lambda x: x.rlike(r"^[A-Za-z][^0-9:]*[A-Za-z0-9_ /-]*:")
    key = lambda x: F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.substring_index(x, ":", 1))), "[^a-z0-9]+", "_"), "^_|_$", "")
    alias = F.create_map(*[F.lit(x) for kv in MSP_ALIASES.items() for x in kv])
    entry = lambda x: F.struct(F.coalesce(F.element_at(alias, key(x)), key(x)).alias("key"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value"))
    fields = F.transform(F.filter("lines", is_field), entry)
    # the last of equal keys would break a map: the first one stays
    firsts = F.aggregate(fields, F.filter(fields, lambda f: F.lit(False)), lambda acc, f: F.when(F.exists(acc, lambda y: y["key"] == f["key"]), acc).otherwise(F.array_append(acc, f)))
    numbers = F.filter("lines", lambda x: x.rlike(r"^[0-9.]+[\s;,]+[0-9.]+"))
    peak = lambda x: F.get(parse_peaks(F.regexp_replace(x, r"^([0-9.]+)[\s;,]+([0-9.eE+-]+).*$", "$1:$2")), 0)
    return b.select(F.map_from_entries(firsts).alias("fields"), F.filter(F.transform(numbers, peak), lambda p: p.isNotNull()).alias("peaks"))


def read_flat_records(spark: SparkSession, path: str, end: str = "//\n") -> DataFrame:
    """fields (map of two-letter keys to their values) of records that end in `//`, as in cell-line catalogues."""
    b = read_blocks(spark, path, end)
    pairs = F.transform(F.filter("lines", lambda x: x.rlike("^[A-Z]{2} ")), lambda x: F.struct(F.substring(x, 1, 2).alias("k"), F.trim(F.substring(x, F.lit(3), F.length(x))).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    grouped = F.transform(keys, lambda k: F.struct(k.alias("k"), F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"]).alias("v")))
    return b.select(F.map_from_entries(grouped).alias("fields")).filter(F.size("fields") > 0)


def read_gtf_genes(spark: SparkSession, path: str) -> DataFrame:
    """chromosome, start_pos, end_pos, strand, gene_id, gene_name, biotype of the gene lines of a GTF file."""
    schema = "chromosome string, origin string, feature string, start_pos long, end_pos long, score string, strand string, frame string, attributes string"
    rows = spark.read.schema(schema).option("sep", "\t").option("quote", "").option("comment", "#").csv(path).filter("feature = 'gene'")
    attr = lambda k: F.nullif(F.regexp_extract("attributes", f'{k} "([^"]*)"', 1), F.lit(""))
    return rows.select("chromosome", "start_pos", "end_pos", "strand", attr("gene_id").alias("gene_id"), attr("gene_name").alias("gene_name"), F.coalesce(attr("gene_biotype"), attr("gene_type")).alias("biotype"))


def read_gmt(spark: SparkSession, path: str, species: str | None = None) -> DataFrame:
    """name, release, pathway_id, species, description, member: one row for each member of the sets of a GMT file."""
    cells = F.split("value", "\t")
    head = F.split(F.get(cells, 0), "%")
    out = spark.read.text(path).filter(F.trim("value") != "").select(
        F.get(head, 0).alias("name"), F.get(head, 1).alias("release"), F.get(head, 2).alias("pathway_id"), F.get(head, 3).alias("species"), F.get(cells, 1).alias("description"),
        F.explode(F.filter(F.slice(cells, F.lit(3), F.size(cells)), lambda x: F.trim(x) != "")).alias("member"),
    )
    return out if species is None else out.filter(F.col("species") == species)


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """file, title, pmid, pub_date, abstract, body of local article texts: header lines, the title after `Subjects:`, the abstract before `Introduction`."""
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "\r", "").alias("t"))
    get = lambda p: F.nullif(F.regexp_replace(F.regexp_extract("t", p, 1), r"^\s+|\s+$", ""), F.lit(""))
    body = get(r"(?is)\n\s*introduction\s*\n(.*)$")
    return t.select(
        "file", F.coalesce(get(r"(?im)^subjects?:[^\n]*\n+([^\n]+)"), get(r"(?im)^title:\s*([^\n]+)")).alias("title"), get(r"(?im)^pmid:\s*([0-9]+)").alias("pmid"),
        get(r"(?im)^(?:date|published):\s*([^\n]+)").alias("pub_date"), get(r"(?is)\n\s*abstract\s*:?\s*\n?(.*?)\n\s*introduction\s*\n").alias("abstract"), body.alias("body"),
    )
