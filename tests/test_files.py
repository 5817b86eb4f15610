"""Sources, sinks and the stream on files."""

from pyspark.sql import functions as F

from billweave.operators import detect, export
from billweave.sources import files
from billweave.streaming.filedrop import run_available, text_stream


def test_admission(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF" + b"x" * 200)
    (tmp_path / "b.png").write_bytes(b"x" * 200)
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.exe").write_bytes(b"MZ" * 100)
    ok, bad = files.admitted(files.scan_files(spark, str(tmp_path)))
    assert [r.path.rsplit("/", 1)[1] for r in ok.collect()] == ["a.pdf"]
    assert {r.path.rsplit("/", 1)[1]: r.problem for r in bad.collect()} == {"b.png": "content does not match type", "c.pdf": "file too small", "d.exe": "unsupported type"}
    assert files.directory_sizes(files.scan_files(spark, str(tmp_path))).first().bytes == 204 + 200 + 4 + 200


def test_engine_keeps_failures(spark):
    pages = spark.createDataFrame([(1, 0, bytearray(b"ab")), (1, 1, bytearray(b""))], "doc_id long, page_no int, content binary")

    def engine():
        def read(content):
            if not content:
                raise ValueError("empty")
            return content.decode(), 0.9

        return read

    got = {r.page_no: (r.text, r.confidence, r.error) for r in files.read_images(pages, engine, "fake").collect()}
    assert got == {0: ("ab", 0.9, None), 1: ("", 0.0, "ValueError: empty")}


def test_service_answers(spark):
    rows = [('{"full_text": "a"}',), ('{"text_blocks": [{"text": "b"}, {"text": "c"}]}',), ('{"result": [{"prediction": [{"ocr_text": "d", "score": 0.4}]}]}',), ("broken",)]
    got = spark.createDataFrame(rows, "j string").select(files.service_text(F.col("j")).alias("t"), files.service_confidence(F.col("j")).alias("c")).collect()
    assert [(r.t, r.c) for r in got] == [("a", 0.85), ("b\nc", 0.85), ("d", 0.4), ("", 0.85)]


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    for kind in ("csv", "json", "xml", "parquet", "other"):
        export.write(df, str(tmp_path / kind), kind)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    assert spark.read.json(str(tmp_path / "other")).count() == 2
    assert spark.read.option("rowTag", "patient").format("xml").load(str(tmp_path / "xml")).count() == 2


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("code 99213 here")
    stream = text_stream(spark, str(tmp_path / "in"))
    for _ in range(2):  # each file once
        run_available(stream, detect.procedures, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert [r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["99213"]


def test_result_text_and_page_order(spark):
    from pyspark.sql import functions as F

    from billweave.sources import files

    rows = ['{"raw_text": "a"}', '{"text_blocks": [{"text": "b"}, "c", 1]}', '{"raw_output": "d"}', '{"z": "f", "error": "x", "e": "e", "n": 1}', '"g"', "{}", None]
    got = spark.createDataFrame([(r,) for r in rows], "j string").select(files.result_text(F.parse_json("j")).alias("t")).collect()
    assert [r.t for r in got] == ["a", "b\nc", "d", "e\nf", "g", "", ""]
    pages = spark.createDataFrame([(2, 1), (1, 2), (1, 1)], "doc_id long, page_no int")
    read = spark.createDataFrame([(1, 2, "t", 0.9, None, "m")], "doc_id long, page_no int, text string, confidence double, error string, model string")
    assert [(r.doc_id, r.page_no, r.text, r.confidence, r.error) for r in files.in_page_order(pages, read).collect()] == [(1, 1, "", 0.0, "no reading"), (1, 2, "t", 0.9, None), (2, 1, "", 0.0, "no reading")]
