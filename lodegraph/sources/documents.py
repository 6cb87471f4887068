"""XML, RDF, archives and nested JSON: parsed once to flat rows, then joined."""

from __future__ import annotations

import io
import json
import tarfile
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RDF = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"


def local(tag: str) -> str:
    """A tag or attribute without its namespace."""
    return tag.rsplit("}", 1)[-1]


def read_xml_rows(spark: SparkSession, path: str, row: str, schema: str | None = None) -> DataFrame:
    """The elements `row` of XML files; Spark's reader splits a file at them."""
    reader = spark.read.format("xml").option("rowTag", row).option("ignoreNamespace", True)
    return (reader.schema(schema) if schema else reader).load(path)


def triples_of(text: bytes) -> Iterator[tuple[str, str, str, str, bool]]:
    """(subject, type, predicate, object, object is a resource) of RDF/XML; nested nodes get names of their own."""
    made = 0

    def node(e: ET.Element) -> Iterator[tuple]:
        nonlocal made
        name = e.get(f"{_RDF}about") or e.get(f"{_RDF}ID") or e.get(f"{_RDF}nodeID")
        if name is None:
            made += 1
            name = f"_:{made}"
        name, kind = name.lstrip("#"), local(e.tag)
        if not len(e):
            yield name, kind, "", "", False
        for prop in e:
            ref = prop.get(f"{_RDF}resource") or prop.get(f"{_RDF}nodeID")
            if ref is not None:
                yield name, kind, local(prop.tag), ref.lstrip("#"), True
            elif len(prop):
                for inner in prop:
                    rows = list(node(inner))
                    yield name, kind, local(prop.tag), rows[0][0] if rows else "", True
                    yield from rows
            else:
                yield name, kind, local(prop.tag), (prop.text or "").strip(), False

    for child in ET.fromstring(text):
        yield from node(child)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """file, subject, type, predicate, object, is_resource, error of RDF/XML files.

    A file is parsed by one task.  A file that can't be parsed gives one row with
    its error, so that it is noticed.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows = [(name, *t, None) for t in triples_of(content)]
                except ET.ParseError as e:
                    rows = [(name, None, None, None, None, None, str(e))]
                kinds = [pa.string()] * 5 + [pa.bool_(), pa.string()]
                names = ["file", "subject", "type", "predicate", "object", "is_resource", "error"]
                columns = zip(*rows, strict=True) if rows else [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return files.mapInArrow(parse, "file string, subject string, type string, predicate string, object string, is_resource boolean, error string")


def reaction_sides(triples: DataFrame) -> DataFrame:
    """reaction, participant, role, direction of BioPAX triples.

    The physical side decides the role (left substrate, right product), whatever
    the direction is.
    """
    t = triples.filter("error is null")
    sides = t.filter("predicate in ('left', 'right') and is_resource").select(
        F.col("subject").alias("reaction"), F.col("object").alias("participant"), F.when(F.col("predicate") == "left", "substrate").otherwise("product").alias("role")
    )
    direction = t.filter("predicate = 'conversionDirection'").groupBy(F.col("subject").alias("reaction")).agg(F.min("object").alias("raw"))
    return sides.join(direction, "reaction", "left").select("reaction", "participant", "role", direction_code(F.col("raw")).alias("direction")).distinct()


# What a conversion's direction is called.
DIRECTIONS = {
    "LEFT-TO-RIGHT": "LR", "LEFT_TO_RIGHT": "LR", "RIGHT-TO-LEFT": "RL", "RIGHT_TO_LEFT": "RL", "REVERSIBLE": "BI", "BIDIRECTIONAL": "BI", "BIDIRECTIONAL-REACTION": "BI",
}


def direction_code(raw: Column) -> Column:
    """LR, RL or BI; another direction stays as it is, none is `unknown`."""
    code = F.element_at(F.create_map(*[F.lit(x) for kv in DIRECTIONS.items() for x in kv]), raw)
    return F.coalesce(code, F.nullif(raw, F.lit("")), F.lit("unknown"))


def participant_xrefs(triples: DataFrame) -> DataFrame:
    """participant, key (`DB:id`): what participants refer to, directly or through their entity reference."""
    t = triples.filter("error is null")
    db = t.filter("predicate = 'db'").select(F.col("subject").alias("xref"), F.upper("object").alias("db"))
    ident = t.filter("predicate = 'id'").select(F.col("subject").alias("xref"), F.col("object").alias("id"))
    keys = db.join(ident, "xref").select("xref", F.concat_ws(":", "db", "id").alias("key"))
    direct = t.filter("predicate = 'xref'").select(F.col("subject").alias("participant"), F.col("object").alias("xref"))
    through = t.filter("predicate = 'entityReference'").select(F.col("subject").alias("p"), F.col("object").alias("participant")).join(direct, "participant").select(F.col("p").alias("participant"), "xref")
    return direct.unionByName(through).join(keys, "xref").select("participant", "key").distinct()


def sbml_sides(spark: SparkSession, path: str) -> DataFrame:
    """reaction, participant, role, direction (BI if reversible, else LR), stoichiometry of SBML reactions."""
    species = "array<struct<_species:string,_stoichiometry:double>>"
    schema = f"_id string, _reversible string, listOfReactants struct<speciesReference:{species}>, listOfProducts struct<speciesReference:{species}>"
    r = read_xml_rows(spark, path, "reaction", schema)
    direction = F.when(F.col("_reversible") == "true", "BI").otherwise("LR")
    side = lambda c, role: r.select(F.col("_id").alias("reaction"), direction.alias("direction"), F.inline(f"{c}.speciesReference")).select(
        "reaction", F.col("_species").alias("participant"), F.lit(role).alias("role"), "direction", F.coalesce("_stoichiometry", F.lit(1.0)).alias("stoichiometry")
    )
    return side("listOfReactants", "substrate").unionByName(side("listOfProducts", "product"))


def read_tar_tables(spark: SparkSession, path: str, member: str, columns: list[str]) -> DataFrame:
    """Rows of the tab-separated members of .tar.gz archives whose name ends in `member`; columns by header, missing ones null."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0).to_pylist():
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for info in tar:
                        if not info.name.endswith(member):
                            continue
                        lines = io.TextIOWrapper(tar.extractfile(info), encoding="utf-8")
                        head = next(lines, "").rstrip("\n").split("\t")
                        at = [head.index(c) if c in head else None for c in columns]
                        rows = [line.rstrip("\n").split("\t") for line in lines if line.strip()]
                        cell = lambda r, i: r[i] if i is not None and i < len(r) else None
                        yield pa.RecordBatch.from_arrays([pa.array([cell(r, i) for r in rows], pa.string()) for i in at], names=columns)

    return files.mapInArrow(parse, ", ".join(f"`{c}` string" for c in columns))


def flatten_tree(value, parent: str | None = None, depth: int = 0) -> Iterator[tuple[str, str | None, str, int]]:
    """(code, parent code, name, depth) of a tree of objects with `code`, `name` and `children` (a list or an object)."""
    items = value if isinstance(value, list) else list(value.values()) if isinstance(value, dict) and "code" not in value else [value]
    for item in items:
        if isinstance(item, dict) and item.get("code"):
            yield item["code"], parent, item.get("name") or item["code"], depth
            if item.get("children"):
                yield from flatten_tree(item["children"], item["code"], depth + 1)


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """code, parent, name, depth of the nodes of JSON trees."""
    files = spark.read.text(path, wholetext=True)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for t in b.column(0).to_pylist() for r in flatten_tree(json.loads(t))]
            kinds = [pa.string(), pa.string(), pa.string(), pa.int32()]
            columns = zip(*rows, strict=True) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["code", "parent", "name", "depth"])

    return files.mapInArrow(parse, "code string, parent string, name string, depth int")


def find_objects(value, wanted: frozenset[str]) -> Iterator[dict]:
    """Objects at any depth that have all of the wanted keys."""
    if isinstance(value, dict):
        if wanted <= value.keys():
            yield value
        for v in value.values():
            yield from find_objects(v, wanted)
    elif isinstance(value, list):
        for v in value:
            yield from find_objects(v, wanted)


def read_nested_objects(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    """file, object (canonical JSON): the objects with all wanted keys at any depth of JSON files; broken files give no row."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    keys = frozenset(wanted)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    out += [(name, json.dumps(o, sort_keys=True, separators=(",", ":"), ensure_ascii=False)) for o in find_objects(json.loads(text), keys)]
                except ValueError:
                    continue
            columns = zip(*out, strict=True) if out else [()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["file", "object"])

    return files.mapInArrow(parse, "file string, object string")
