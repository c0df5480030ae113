import json

from pyspark.sql import functions as F

from skerry.sources import readers, sinks
from skerry.streaming import feeds


def test_registry_csv_flags_shifted_rows_only(spark, tmp_path):
    (tmp_path / "r.csv").write_text("organisasjonsnummer;navn;organisasjonsform.kode\n1;A;AS\n2;B;AS;;\n3;C;AS;x\n4;D\n", "utf-8")
    got = {r[0]: r["csv_row_misaligned"] for r in readers.registry_csv(spark, str(tmp_path / "r.csv")).collect()}
    assert got == {"1": False, "2": False, "3": True, "4": True}


def test_registry_json_nested_and_wrapped(spark, tmp_path):
    rows = [{"organisasjonsnummer": "1", "organisasjonsform": {"kode": "AS"}, "links": [], "mal": ["a", "b"]}]
    (tmp_path / "a.json").write_text(json.dumps({"_embedded": {"enheter": rows}}))
    r = readers.registry_json(spark, str(tmp_path / "a.json")).first()
    assert r["organisasjonsform_kode"] == "AS" and r["mal"] == "a\nb" and "links" not in r


def test_manifest(spark, tmp_path):
    (tmp_path / "m.txt").write_text("993 578 843\n{\"orgnr\": \"985589003\"}\n993578843\n12\n")
    got = [(r["organisation_number"], r["valid"], r["repeated"]) for r in readers.manifest(spark, str(tmp_path / "m.txt")).orderBy("input_ordinal").collect()]
    assert got == [("993578843", True, False), ("985589003", True, False), ("993578843", True, True), ("12", False, False)]


def test_json_lines(spark, tmp_path):
    sinks.write_json_lines(spark.range(1).select(F.lit(None).cast("string").alias("b"), "id"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == '{"b": null, "id": 0}'


def test_upsert_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (2, 2, "c"), (2, 1, "d")], "k int, seq int, v string")
    rows.limit(2).write.parquet(str(tmp_path / "in/1"))
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    feeds.upsert_stream(stream, ["k"], "seq", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    rows.write.parquet(str(tmp_path / "in/2"))
    feeds.upsert_stream(stream, ["k"], "seq", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(tuple(r) for r in feeds.upserted_rows(spark, str(tmp_path / "out")).collect()) == [(1, 3, "b"), (2, 2, "c")]


def test_latest_states_of_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (2, 2, "c")], "k int, seq int, v string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    feeds.latest_states(stream, "k", "seq").writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(tuple(r) for r in spark.table("latest").collect()) == [(1, 3, "b"), (2, 2, "c")]
