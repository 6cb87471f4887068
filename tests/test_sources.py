import gzip
import io
import json
import tarfile

from pyspark.sql import functions as F

from lodegraph.sources import blocks as B
from lodegraph.sources import documents as D
from lodegraph.sources import sinks as S
from lodegraph.sources import tables as T


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(p)


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_delimited(spark, tmp_path):
    p = put(tmp_path, "a.csv", '﻿Input ID,Name (raw),Name (raw)\n1,"a, b",x\n2,,y\n')
    df = T.read_delimited(spark, p, fill=True)
    assert df.columns == ["input_id", "name_raw_1", "name_raw_2"]
    assert rows(df)[0] == {"input_id": "1", "name_raw_1": "a, b", "name_raw_2": "x"}
    assert rows(df)[1]["name_raw_1"] == ""
    gz = put(tmp_path, "t.tsv.gz", gzip.compress(b"1\tone\n2\n"))
    assert rows(T.read_headerless(spark, gz, ["cid", "title"])) == [{"cid": "1", "title": "one"}, {"cid": "2", "title": None}]


def test_json_lines(spark, tmp_path):
    p = put(tmp_path, "a.jsonl", '{"A b": 1, "c": "x"}\n[1,2]\nnot json\n{"A b": 2}\n{broken\n')
    got = rows(T.read_json_lines(spark, p))
    assert sorted(r["a_b"] for r in got) == [1, 2]


def test_parquet(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    spark.range(3).write.parquet(str(tmp_path / "u"))
    put(tmp_path / "t", "bad.parquet", "not parquet at all")
    assert T.read_parquet_tolerant(spark, str(tmp_path / "t"), "id long").count() == 3
    assert T.unreadable_files(spark, str(tmp_path / "t")).count() == 1
    assert T.read_optional(spark, str(tmp_path / "none"), "a string, b int").dtypes == [("a", "string"), ("b", "int")]
    assert T.read_optional(spark, str(tmp_path / "u"), "id string, b int").dtypes == [("id", "string"), ("b", "int")]
    assert T.infer_input_mode(["MZ", "RT"]) == "feature" and T.infer_input_mode(["Trait", "hmdb_id"]) == "trait"


OBO = """format-version: 1.2

[Term]
id: X:1
name: first
def: "A \\"thing\\"." [r:1]
synonym: "uno" EXACT []
synonym: "eins" RELATED []
xref: MESH:D1 {source="a"}
is_a: X:0 ! root
alt_id: X:9
subset: S1

[Term]
id: X:2
name: gone
is_obsolete: true

[Typedef]
id: part_of
"""


def test_obo(spark, tmp_path):
    p = put(tmp_path, "a.obo", OBO)
    (r,) = rows(B.read_obo(spark, p))
    assert (r["id"], r["name"], r["synonyms"], r["xrefs"], r["parents"], r["alt_ids"]) == ("X:1", "first", ["uno", "eins"], ["MESH:D1"], ["X:0"], ["X:9"])
    assert B.read_obo(spark, p, keep_obsolete=True).count() == 2


MSP = "Name: A\nPrecursorMZ: 101.5\nPrecursor_type: [M+H]+\nNum Peaks: 2\n50.1 10\n60.2\t0\n\nName: B\nDB: 7\nNum Peaks: 1\n70; 5\n"


def test_msp_and_peaks(spark, tmp_path):
    got = {r["fields"]["name"]: r for r in rows(B.read_msp(spark, put(tmp_path, "a.msp", MSP)))}
    assert got["A"]["fields"]["precursor_mz"] == "101.5" and got["A"]["fields"]["adduct"] == "[M+H]+"
    assert got["A"]["peaks"] == [{"mz": 50.1, "intensity": 10.0}, {"mz": 60.2, "intensity": 1.0}]
    assert got["B"]["fields"]["source_record_id"] == "7" and got["B"]["peaks"] == [{"mz": 70.0, "intensity": 5.0}]
    p = spark.createDataFrame([("50:10 60|5;70,x 0:3",)], "t string").select(B.parse_peaks(F.col("t")).alias("p"))
    assert [(x["mz"], x["intensity"]) for x in p.head()["p"]] == [(50.0, 10.0), (60.0, 5.0), (70.0, 1.0)]


def test_flat_gtf_gmt(spark, tmp_path):
    flat = put(tmp_path, "c.txt", "ID   L1\nSY   a; b\nDI   NCIt; C1; X\nDI   NCIt; C2; Y\n//\nID   L2\n//\n")
    got = rows(B.read_flat_records(spark, flat))
    assert got[0]["fields"] == {"ID": ["L1"], "SY": ["a; b"], "DI": ["NCIt; C1; X", "NCIt; C2; Y"]} and len(got) == 2
    gtf = put(tmp_path, "g.gtf", '#x\n1\th\tgene\t5\t9\t.\t+\t.\tgene_id "E1"; gene_name "A"; gene_biotype "pc";\n1\th\texon\t5\t6\t.\t+\t.\tgene_id "E1";\n')
    assert rows(B.read_gtf_genes(spark, gtf)) == [{"chromosome": "1", "start_pos": 5, "end_pos": 9, "strand": "+", "gene_id": "E1", "gene_name": "A", "biotype": "pc"}]
    gmt = put(tmp_path, "p.gmt", "P%r1%WP1%Homo sapiens\thttp://x\t11\t12\nQ%r1%WP2%Mus musculus\t\t13\n")
    assert [r["member"] for r in rows(B.read_gmt(spark, gmt, "Homo sapiens"))] == ["11", "12"]


def test_article(spark, tmp_path):
    t = "PMID: 123\nDate: 2020 May\nSubjects: x; y\nA Title Here\n\nAbstract\nShort text.\n\nIntroduction\nBody text.\n"
    (r,) = rows(B.read_articles(spark, put(tmp_path, "a.txt", t)))
    assert (r["title"], r["pmid"], r["pub_date"], r["abstract"], r["body"]) == ("A Title Here", "123", "2020 May", "Short text.", "Body text.")


RDF = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:bp="http://b#">
<bp:BiochemicalReaction rdf:ID="R1"><bp:left rdf:resource="#M1"/><bp:right rdf:resource="#M2"/><bp:conversionDirection>RIGHT-TO-LEFT</bp:conversionDirection></bp:BiochemicalReaction>
<bp:SmallMolecule rdf:ID="M1"><bp:entityReference rdf:resource="#S1"/></bp:SmallMolecule>
<bp:SmallMolecule rdf:ID="M2"><bp:xref><bp:UnificationXref><bp:db>ChEBI</bp:db><bp:id>2</bp:id></bp:UnificationXref></bp:xref></bp:SmallMolecule>
<bp:SmallMoleculeReference rdf:ID="S1"><bp:xref rdf:resource="#X1"/></bp:SmallMoleculeReference>
<bp:UnificationXref rdf:ID="X1"><bp:db>ChEBI</bp:db><bp:id>1</bp:id></bp:UnificationXref>
</rdf:RDF>"""
SBML = """<sbml><model><listOfReactions><reaction id="r1" reversible="true"><listOfReactants><speciesReference species="a" stoichiometry="2"/></listOfReactants>
<listOfProducts><speciesReference species="b"/><speciesReference species="c"/></listOfProducts></reaction></listOfReactions></model></sbml>"""


def test_reactions(spark, tmp_path):
    put(tmp_path / ".", "a.owl", RDF)
    t = D.read_triples(spark, str(tmp_path / "a.owl"))
    assert {tuple(r) for r in D.reaction_sides(t).collect()} == {("R1", "M1", "substrate", "RL"), ("R1", "M2", "product", "RL")}
    assert {tuple(r) for r in D.participant_xrefs(t).filter("participant like 'M%'").collect()} == {("M1", "CHEBI:1"), ("M2", "CHEBI:2")}
    bad = D.read_triples(spark, put(tmp_path, "bad.owl", "<a><b></a>"))
    assert bad.filter("error is not null").count() == 1
    got = {tuple(r) for r in D.sbml_sides(spark, put(tmp_path, "m.xml", SBML)).collect()}
    assert got == {("r1", "a", "substrate", "BI", 2.0), ("r1", "b", "product", "BI", 1.0), ("r1", "c", "product", "BI", 1.0)}


def test_archive_tree_objects(spark, tmp_path):
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w:gz") as tar:
        data = b"A\tB\n1\t2\n3\n"
        info = tarfile.TarInfo("x/rhea.tsv")
        info.size = len(data)
        tar.addfile(info, io.BytesIO(data))
    got = rows(D.read_tar_tables(spark, put(tmp_path, "a.tar.gz", buf.getvalue()), "rhea.tsv", ["B", "A", "C"]))
    assert got == [{"B": "2", "A": "1", "C": None}, {"B": None, "A": "3", "C": None}]
    tree = {"T": {"code": "T", "name": "Tissue", "children": {"L": {"code": "L", "children": [{"code": "K", "name": "k"}]}}}}
    got = {tuple(r) for r in D.read_tree(spark, put(tmp_path, "t.json", json.dumps(tree))).collect()}
    assert got == {("T", None, "Tissue", 0), ("L", "T", "L", 1), ("K", "L", "k", 2)}
    nested = put(tmp_path, "n.json", json.dumps({"a": [{"pack": 1, "id": 2, "z": {"pack": 3, "id": 4}}, {"id": 1}]}))
    assert [json.loads(r.object)["id"] for r in D.read_nested_objects(spark, nested, ["pack", "id"]).collect()] == [2, 4]
    hmdb = put(tmp_path, "h.xml", "<hmdb><metabolite><accession>H1</accession><synonyms><synonym>a</synonym><synonym>b</synonym></synonyms></metabolite></hmdb>")
    (r,) = rows(D.read_xml_rows(spark, hmdb, "metabolite", "accession string, synonyms struct<synonym:array<string>>"))
    assert r["accession"] == "H1" and r["synonyms"]["synonym"] == ["a", "b"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", ["a", "b"]), (2, None, [])], "id int, name string, tags array<string>")
    schema = "id long, name string, score double"
    m = rows(S.write_table(df, str(tmp_path / "t"), schema))[0]
    assert m["rows"] == 2 and m["files"] >= 1 and m["bytes"] > 0
    again = rows(S.write_table(df.orderBy(F.desc("id")), str(tmp_path / "t2"), schema))[0]
    assert again["digest"] == m["digest"]
    assert rows(S.write_table(df.limit(0), str(tmp_path / "e"), schema))[0]["rows"] == 0
    assert spark.read.parquet(str(tmp_path / "e")).dtypes == [("id", "bigint"), ("name", "string"), ("score", "double")]
    S.write_csv(df, str(tmp_path / "c"), ["name", "tags", "id"])
    assert rows(T.read_delimited(spark, str(tmp_path / "c")))[0]["tags"] == "a|b"
    assert S.markdown(df.select("id", "name"), [F.asc("id")]).splitlines()[2] == "| 1 | x |"
    man = spark.createDataFrame([("listed.txt",)], "file string")
    (tmp_path / "f").mkdir()
    put(tmp_path / "f", "listed.txt", "a")
    put(tmp_path / "f", "new.txt", "ab")
    assert [tuple(r) for r in S.unlisted_files(spark, str(tmp_path / "f"), man).collect()] == [("new.txt", 2)]
