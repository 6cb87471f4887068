from pyspark.sql import functions as F

from lodegraph.operators import literature as L
from lodegraph.plans.evidence import build_evidence
from lodegraph.plans.learning import run_learning
from lodegraph.plans.release import build_graph_release, verify_release
from lodegraph.queries.graph import EDGES, NODES, TABLES
from lodegraph.runtime import table
from lodegraph.sources.sinks import write_bucketed
from lodegraph.streaming.mentions import read_growing, run_available, windowed_counts

SF = "/root/testdata/sf0.001"


def test_graph_release(spark, tmp_path):
    tables = {t: table(spark, SF, t) for t in TABLES}
    m = {r.table: r for r in build_graph_release(spark, tables, NODES, EDGES, str(tmp_path / "r1")).collect()}
    again = {r.table: r for r in build_graph_release(spark, tables, NODES, EDGES, str(tmp_path / "r2")).collect()}
    assert {t: r.digest for t, r in m.items()} == {t: r.digest for t, r in again.items()}
    assert m["edges"].rows > m["sparse_edges"].rows > 0
    assert all(r.passed for r in verify_release(spark, str(tmp_path / "r1")).collect())


def test_stream(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    rows = [(1, "2024-01-01 01:00:00", "a", 1.0), (1, "2024-01-01 01:00:00", "a", 1.0), (2, "2024-01-01 05:00:00", "b", 2.0), (3, "2024-01-09 00:00:00", "a", 4.0)]
    schema = "event_id long, ts string, kind string, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    df = windowed_counts(read_growing(spark, src, schema), "ts", "event_id", "kind", "value")
    run_available(df, out, ck)
    spark.createDataFrame([(4, "2024-01-01 02:00:00", "a", 9.0), (5, "2024-01-20 00:00:00", "a", 1.0)], schema).coalesce(1).write.mode("append").parquet(src)
    run_available(df, out, ck)
    got = {(str(r.window_start)[:10], r.kind, r.n, r.total) for r in spark.read.parquet(out).collect()}
    assert {("2024-01-01", "a", 1, 1.0), ("2024-01-01", "b", 1, 2.0)} <= got
    assert not any(t == 9.0 for *_, t in got)


def test_evidence_run(spark, tmp_path):
    docs = spark.createDataFrame(
        [
            (1, "Alphol increased in lung carcinoma compared with controls. Alphol was measured."),
            (2, "Alphol did not show any change in lung carcinoma; it was reduced."),
            (3, "Betate activates GENX strongly in tumours. Nothing else here."),
            (4, None),
        ],
        "doc_id long, text string",
    )
    surfaces = [("alphol", "m1", "metabolite", "name", 0.93), ("betate", "m2", "metabolite", "name", 0.93), ("lung carcinoma", "d1", "disease", "name", 0.91), ("GENX", "g1", "gene", "symbol", 0.94)]
    lexicon = L.build_lexicon(spark.createDataFrame(surfaces, "surface string, entity_uid string, entity_type string, field string, confidence double"))
    pairs = spark.createDataFrame([("metabolite", "disease", "changed_in"), ("metabolite", "gene", "regulates")], "subject_type string, object_type string, predicate string")
    known = spark.createDataFrame([("m2", "regulates", "g1")], "subject_uid string, predicate string, object_uid string")
    m = build_evidence(spark, docs, lexicon, pairs, {"changed_in": "change", "regulates": "regulation"}, known, str(tmp_path / "e"))
    assert {r.table: r.rows for r in m.collect()} == {"sentences": 5, "mentions": 7, "relations": 3, "support": 2}
    got = {(r.subject_uid, r.support_class) for r in spark.read.parquet(str(tmp_path / "e" / "support")).collect()}
    assert got == {("m1", "conflict_candidate"), ("m2", "support_direction")}


def test_learning_run(spark, tmp_path):
    c = spark.range(600).select(
        F.concat(F.lit("u"), "id").alias("uid"), F.concat(F.lit("g"), (F.col("id") % 200).cast("string")).alias("group"), F.when(F.col("id") % 3 == 0, "refute").otherwise("confirm").alias("support_class"),
        F.when(F.col("id") % 3 == 0, 0.5).otherwise(0.9).alias("p"), (F.col("id") % 4).alias("articles"), (F.col("id") % 5).alias("sentences"), (F.col("id") % 2 == 0).alias("is_known"),
    )
    got = run_learning(spark, c, ["p", "articles", "sentences"], ["support_class"], str(tmp_path / "l"), 10)
    assert got["auc"] > 0.9 and 0 <= got["ece"] <= 1
    assert spark.read.parquet(str(tmp_path / "l" / "ranking")).count() == 600


def test_bucketed_tables_join_without_shuffle(spark):
    for name in ("bucket_a", "bucket_b"):
        write_bucketed(spark.range(1000).withColumn(f"{name}_v", F.col("id") * 2), name, ["id"], 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("bucket_a").join(spark.table("bucket_b"), "id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("bucket_a", "bucket_b"):
            spark.sql(f"drop table {name}")
