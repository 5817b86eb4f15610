"""Operators on small texts with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from billweave.functions import constants as C
from billweave.functions import dates, privacy, scores
from billweave.functions.text import matches, redact
from billweave.operators import detect, ensemble, export, extract, report, resolve, segment, validate
from billweave.sources.config import Config

ONE = "\n".join([
    "PATIENT NAME: Ada Stone", "DOB: 02/03/1970", "Patient ID: P-100", "Date of Service: 05/06/2024", "Provider NPI: 1234567893", "PROCEDURE CODES:", "99213 - Office visit - $150.00",
    "93000 - Electrocardiogram - $75.50", "DIAGNOSIS CODES:", "I10 - Hypertension", "E11.9 - Type 2 diabetes", "Total Charges: $1,225.50", "",
])
IDS = "Ship to 12 Elm Street, Salem, OR 97301\nCall 555-123-4567 or mail billing@clinic.example\nAccount 1234567890\nRef 123-45-6789\n"
THREE = ONE + "-" * 40 + "\n" + ONE.replace("Ada Stone", "Ben Hill").replace("02/03/1970", "07/08/1985").replace("P-100", "P-200").replace("99213", "36415")
def today():
    return F.lit("2024-06-30").cast("date")



@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(1, ONE), (2, IDS), (3, THREE), (4, ""), (5, None)], "doc_id long, text string").cache()


def at(df, doc, kind=None):
    return sorted(f"{r.value}@{r.start}" for r in df.collect() if r.doc_id == doc and (kind is None or r.field_type == kind))


def test_detectors(texts):
    cpt = detect.procedures(texts)
    assert at(cpt, 1) == ["93000@159", "99213@128"]
    assert at(cpt, 2) == ["97301@33"]
    assert at(cpt, 3) == ["36415@447", "93000@159", "93000@478", "99213@128"]
    assert at(detect.diagnoses(texts), 3) == ["E11.9@230", "E11.9@549", "I10@211", "I10@530"]
    assert at(detect.provider_numbers(texts), 1) == ["1234567893@100"]
    assert at(detect.provider_numbers(texts), 2) == []
    ids = detect.identifiers(texts)
    assert at(ids, 2, "phone") == ["1234567890@96", "555-123-4567@44"]
    assert at(ids, 2, "ssn") == ["123-45-6789@111"]
    assert at(ids, 2, "email") == ["billing@clinic.example@65"]
    assert at(detect.dates(texts, today()), 1) == ["1970-02-03@29", "2024-05-06@75"]
    assert len(at(detect.amounts(texts), 1)) == 8
    address = detect.addresses(texts).collect()
    assert [(r.value, r.start) for r in address] == [("12 Elm Street, Salem, OR 97301", 8)]
    every = detect.detections(texts, today())
    assert {r.confidence <= 1 for r in every.collect()} == {True}
    assert detect.best_matches(every, 1).where("field_type = 'cpt_code'").count() == 3


def test_native_plans(texts):
    plan = detect.detections(texts, today())._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_matches_edges(spark):
    got = spark.createDataFrame([("12ab12", 0), ("", 1), (None, 2), ("1212", 3), ("x", 4)], "t string, k int").select("k", matches(F.col("t"), "12").alias("m")).collect()
    assert {r.k: [(x.start, x.end) for x in r.m] for r in got} == {0: [(0, 2), (4, 6)], 1: [], 2: [], 3: [(0, 2), (2, 4)], 4: []}


def test_dates(spark):
    rows = [("02/03/1970", "1970-02-03"), ("13/45/2024", None), ("2024-05-06", "2024-05-06"), ("01/15/80", "1980-01-15"), ("01/15/24", "2024-01-15"), ("05/06/1899", None), ("Sept 5, 2024", None), ("Sep 5, 2024", "2024-09-05"), ("01/01/2026", None)]
    got = spark.createDataFrame(rows, "t string, want string").select("t", "want", dates.standard_date(F.col("t"), today()).cast("string").alias("got")).collect()
    assert [(r.t, r.got) for r in got] == [(r.t, r.want) for r in got]


def test_validation(spark):
    codes = spark.createDataFrame([("99213",), ("00099",), ("00100",), ("90210",), ("9921",)], "code string")
    got = {r.code: (r.is_valid, r.category) for r in validate.validate_cpt(codes, validate.cpt_table(spark)).collect()}
    assert got == {"99213": (True, "evaluation_management"), "00099": (False, None), "00100": (True, "anesthesia"), "90210": (False, None), "9921": (False, None)}
    codes = spark.createDataFrame([(" i10 ",), ("E119",), ("B20",)], "code string")
    got = {r.code: r.message for r in validate.validate_icd(codes, validate.icd_table(spark)).collect()}
    assert got[" i10 "] == "Valid ICD-10 code" and got["E119"] == "Invalid ICD-10 code format" and "infectious" in got["B20"]
    row = spark.range(1).select(validate.mixed_record_issues(F.lit("A; B"), F.lit("C"), F.lit("male"), F.lit("1950-01-01").cast("date"), F.array(F.lit("58410"), F.lit("99381")), F.array(F.lit("I10")), today()).alias("x")).first().x
    assert len(row) == 3


def test_segments(texts):
    kept = segment.sifted(segment.boundaries(texts))
    found = segment.segments(texts, kept).collect()
    whole = {r.doc_id: r.text for r in texts.collect()}
    assert all(whole[r.doc_id][r.start : r.end] == r.text for r in found)
    starts = sorted(r.start for r in kept.collect() if r.doc_id == 3)
    assert all(b - a >= 100 for a, b in zip(starts, starts[1:]))
    assert any(300 <= s <= 360 for s in starts)


def test_extraction(texts):
    got = {(r.doc_id, r.patient_index): r for r in extract.records(texts).collect()}
    one = got[1, 0]
    assert (one.first_name, one.last_name, str(one.date_of_birth), str(one.date_of_service)) == ("Ada", "Stone", "1970-02-03", "2024-05-06")
    assert one.cpt_codes == ["99213", "93000"] and one.icd10_codes == ["I10", "E11.9"] and float(one.total_charge) == 150
    assert got[3, 1].first_name == "Ben"
    assert got[4, 0].first_name == "Unknown" and got[5, 0].last_name == "Patient"


def test_json_recovery(spark):
    raws = [(1, '{"a": 1, "b": "x"}'), (2, "Sure: {'a': 2, 'b': True,} ok"), (3, "none"), (4, "{a: 3}")]
    got = {r.doc_id: r for r in extract.recovered(spark.createDataFrame(raws, "doc_id long, raw string")).select("doc_id", "ok", F.try_variant_get("data", "$.a", "int").alias("a")).collect()}
    assert [got[k].a for k in (1, 2, 3, 4)] == [1, 2, None, 3] and not got[3].ok


def test_similarity_and_groups(spark):
    rows = [(1, 0, 0, "Ann", "Lee", None, "P1"), (1, 0, 1, "Ann", "Lee", None, "P1"), (1, 0, 2, "Bob", "Ray", None, "P2")]
    r = spark.createDataFrame(rows, "doc_id long, page_no int, idx int, first_name string, last_name string, date_of_birth date, patient_id string")
    assert [(x.a, x.b) for x in resolve.page_duplicates(r).collect()] == [(0, 1)]
    assert resolve.page_duplicates(r, literal=True).count() == 0  # divided by the number of fields, no pair reaches the threshold
    pairs = spark.createDataFrame([(1, 1, 2, 0), (1, 3, 4, 1), (1, 2, 3, 2)], "doc_id long, a int, b int, ord int")
    assert {x.node: x.group for x in resolve.groups(pairs).collect()} == {1: 1, 2: 1, 3: 1, 4: 1}
    greedy = {}
    for x in resolve.greedy_groups(pairs).collect():
        greedy.setdefault(x.group, set()).add(x.node)
    assert list(greedy.values()) == [{1, 2, 3}, {3, 4}]
    sim = spark.range(1).select(resolve.code_similarity(F.array(F.lit("99213"), F.lit("93000")), F.array(F.lit("36415"), F.lit("93000")), F.array(F.lit("I10")), F.array(F.lit("I10"))).alias("s")).first().s
    assert sim == pytest.approx(0.6)
    ratio = spark.createDataFrame([("abcd", "bcde"), (None, None)], "a string, b string").select(resolve.matching_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert [x.r for x in ratio] == [0.75, 1.0]


def test_exports(spark):
    kind = "node int, cpt_codes array<struct<code:string,description:string,charge:decimal(12,2),confidence:double>>, icd10_codes array<struct<code:string,description:string,confidence:double>>"
    r = spark.createDataFrame([(1, [], []), (2, [("a", "A", None, 0.5), ("b", "B", None, 0.5)], [("x", "X", 0.5)])], kind)
    rows = {(x.node, x.row): (x.cpt_code, x.icd10_code) for x in export.zipped_rows(r, ["node"]).collect()}
    assert rows == {(1, 0): ("", ""), (2, 0): ("a", "x"), (2, 1): ("b", "")}
    assert export.code_rows(r, ["node"]).count() == 4
    assert export.procedure_rows(r, ["node"]).count() == 3
    with pytest.raises(ValueError):
        export.checked_path("../../etc/x")


def test_privacy(spark):
    row = spark.range(1).select(privacy.mask_phone(F.lit("555-123-4567")).alias("a"), privacy.mask_phone(F.lit("1234567")).alias("b"), privacy.mask_address(F.lit("12 Elm Street, Salem")).alias("c"), redact(F.lit("call 555-123-4567 or a@b.example"), [C.PHONE, C.EMAIL]).alias("d")).first()
    assert tuple(row) == ("(555) XXX-XXXX", "XXX-XXXX", "XXX Elm Str*** Sal***", "call [REDACTED] or [REDACTED]")


def test_readings(spark):
    rows = [(1, 0, "a", "hello world", 0.9, 1.0), (1, 1, "b", "hello world", 0.5, 1.0), (1, 2, "c", "zzz", 0.95, 1.0), (2, 0, "a", "", 0.0, 1.0)]
    r = spark.createDataFrame(rows, "image_id int, ord int, model string, text string, confidence double, seconds double")
    assert {x.image_id: x.model for x in ensemble.consensus(r).collect()} == {1: "a", 2: "a"}
    assert {x.image_id: x.status for x in ensemble.with_minimum(r).collect()} == {1: "consensus", 2: "ensemble_failed"}


def test_reports(spark):
    empty = spark.createDataFrame([], "model string, file int, seconds double, confidence double, patients int, ord int")
    row = report.batch_summary(empty).first()
    assert (row.total, row.success_rate, row.avg_confidence) == (0, 0.0, 0.0)
    box = F.struct(F.lit(0).alias("x1"), F.lit(0).alias("y1"), F.lit(2).alias("x2"), F.lit(2).alias("y2"))
    assert spark.range(1).select(scores.iou(box, box).alias("i")).first().i == 1.0


def test_config():
    c = Config({"ocr": {"key": "${KEY:none}", "url": "${URL}"}}, {"URL": "u"})
    assert c.get("ocr.key") == "none" and c.get("ocr.url") == "u" and c.get("a.b", 1) == 1
    c.set("export.format", "csv")
    assert c.get("export.format") == "csv" and c.missing() == ["extraction"]


def test_boundaries_sift(spark):
    kind = "doc_id int, start int, end int, kind string, confidence double, method int, ord int"
    rows = [(1, 50, None, "k", 0.7, 0, 0), (1, 100, None, "k", 0.9, 0, 1), (1, 200, None, "k", 0.8, 0, 2), (1, 250, None, "k", 0.8, 0, 3)]
    got = sorted((x.start, x.confidence) for x in segment.sifted(spark.createDataFrame(rows, kind)).collect())
    assert got == [(100, 0.9), (200, 0.8)]


def test_validation_report(spark):
    from billweave.operators.validate import validation_report

    rows = [(1, "Ann", None, "2030-01-01", "2024-01-01", ["99213", "00001", "x"], ["J45.909", "bad"]), (2, None, "", None, None, [], []), (3, "Bo", "Li", "1980-05-05", "2024-02-02", None, None)]
    schema = "k int, first_name string, last_name string, date_of_birth string, date_of_service string, cpt_codes array<string>, icd10_codes array<string>"
    df = spark.createDataFrame(rows, schema).withColumns({c: F.col(c).cast("date") for c in ("date_of_birth", "date_of_service")})
    got = {r.k: r for r in validation_report(df, F.lit("2024-06-30").cast("date")).collect()}
    assert got[1].errors == ["Invalid CPT code: 00001 - CPT code out of valid range", "Invalid CPT code: x - Invalid CPT code format (must be 5 digits)", "Invalid ICD-10 code: bad - Invalid ICD-10 code format", "Date of birth validation failed: Date of birth cannot be in the future", "Service date validation failed: Service date cannot be before date of birth"]
    assert got[2].warnings == ["No medical codes (CPT or ICD-10) found", "No patient name found"] and got[2].overall_valid
    assert got[3].warnings == ["No medical codes (CPT or ICD-10) found"] and not got[1].overall_valid


def test_extraction_falls_back(spark):
    from billweave.operators import detect, extract

    as_of = F.lit("2024-06-30").cast("date")
    texts = spark.createDataFrame([(1, "PATIENT NAME: Ann Lee\nDOB: 01/02/1980\n99213 visit $10.00"), (2, "seen on 2024-02-03"), (3, "nothing"), (4, None)], "doc_id long, text string")
    found = detect.dates(texts, as_of).unionByName(detect.procedures(texts)).unionByName(detect.names(texts))
    got = {r.doc_id: r for r in extract.extracted(texts, found, as_of).collect()}
    assert set(got) == {1, 2}
    assert (got[1].first_name, got[1].last_name, got[1].date_of_birth, got[1].cpt_codes, got[1].source, got[1].phi_detected) == ("Ann", "Lee", "1980-01-02", ["99213"], "primary", True)
    assert (got[2].first_name, got[2].date_of_birth, got[2].source, got[2].consistent) == ("Unknown", "2024-02-03", "fallback", True)


def test_different_people(spark):
    from billweave.operators.segment import different_people

    rows = [("Name: Ann Lee", "Name: Ann Lee"), ("Name: Ann Lee", "Name: Robert Moss"), ("x", "New  Patient"), ("MRN: 123456", "MRN: 123457"), (None, None), ("", "")]
    got = spark.createDataFrame(rows, "a string, b string").select(different_people(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r.d for r in got] == [False, True, True, False, False, False]


def test_dates_are_listed_once_in_order(spark):
    from billweave.operators.extract import listed_dates

    texts = spark.createDataFrame([(1, "2020-03-04 then 1/2/2021, 01/02/2021 and 31/12/2019"), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.dates for r in listed_dates(texts, F.lit("2024-06-30").cast("date")).collect()}
    assert got == {1: ["2021-01-02", "2020-03-04"], 2: [], 3: []}


def test_optimised_needs_more_by_codes(spark):
    from billweave.operators.resolve import optimised

    schema = "doc_id long, page_no int, idx int, first_name string, last_name string, date_of_birth date, patient_id string, cpt_codes array<string>, icd10_codes array<string>, confidence double"
    codes = (["99213", "99214"], ["J45"])
    rows = [(1, 0, 0, "Ann", "Lee", None, None, *codes, 0.9), (1, 1, 0, "Bob", "Moss", None, "P", *codes, 0.5), (2, 0, 0, "Ann", "Lee", None, None, ["1"], [], 0.9), (2, 1, 0, "Ann", "Lee", None, None, ["2"], [], 0.8)]
    got = sorted((r.doc_id, r.page_no, r.patient_id, r.page_numbers, r.spans_multiple_pages) for r in optimised(spark.createDataFrame(rows, schema)).collect())
    assert got == [(1, 0, "P", [0, 1], True), (2, 0, None, [0], False), (2, 1, None, [1], False)]


def test_codes_before_a_word_about_codes(spark):
    from billweave.operators.segment import labelled_codes

    texts = spark.createDataFrame([(1, "99213 then billing\n99214 end"), (2, "j45.1 for the diagnosis"), (3, "99213 – Visit"), (4, None), (5, "billing 99213")], "doc_id long, text string")
    assert sorted((r.doc_id, r.start) for r in labelled_codes(texts).distinct().collect()) == [(1, 0), (2, 0), (3, 0)]


def test_names_are_found_in_very_long_texts(spark):
    from billweave.operators.segment import identifier_boundaries

    head = "Sex: F DOB: x "
    texts = spark.createDataFrame([(1, head + "first: " + "ann lee " * 100_000), (2, head + "last: ann b lee DOB"), (3, ""), (4, None)], "doc_id long, text string")
    got = {(r.doc_id, r.start, r.confidence) for r in identifier_boundaries(texts).where("ord > 2").collect()}
    assert got == {(1, len(head), 0.8), (2, len(head), 0.8)}


def test_a_second_look_is_for_unsure_texts(spark):
    from billweave.operators.segment import enhanced

    page = "Name: Ann Lee\nDOB: 1/2/1980\nMRN: A1\n"
    texts = spark.createDataFrame([(1, page + "x " * 60 + "\n--- PAGE BREAK ---\nName: Robert Moss\n"), (2, page), (3, "no one"), (4, page), (5, None)], "doc_id long, text string")
    kept = spark.createDataFrame([(4, 0, 3, "keyword_separator", 0.9), (2, 0, 150, "form_structure", 0.6)], "doc_id long, idx int, start int, kind string, confidence double")
    got = sorted((r.doc_id, r.idx, r.start, r.kind) for r in enhanced(texts, kept).collect())
    assert got == [(1, 0, 0, "text_block"), (1, 1, len(page) + 121, "page_break"), (2, 0, 0, "text_block"), (2, 1, 150, "form_structure"), (4, 0, 3, "keyword_separator")]


def test_layout_packs_blocks(spark):
    from billweave.operators.segment import layout_chunks

    rows = [(1, 0, 0, 50, 10, 60, 100, 200), (1, 0, 20, 50, 10, 40, 100, 200), (1, 5, 40, 50, 10, 1, 100, 200), (1, 0, 60, 40, 20, 200, 100, 200), (1, 0, 90, 95, 10, 7, 100, 200)]
    blocks = spark.createDataFrame(rows, "page_id long, x int, y int, w int, h int, tokens int, width int, height int")
    got = [tuple(r) for r in layout_chunks(blocks, 40, 20, 100).orderBy("chunk_index").collect()]
    assert got[:2] == [(1, 0, 0, 0, 60, 40, 100, True), (1, 1, 0, 30, 65, 60, 1, True)]
    assert [r[2:] for r in got[2:6]] == [(0, 60, 22, 71, 200, False), (18, 60, 40, 71, 200, False), (0, 69, 22, 80, 200, False), (18, 69, 40, 80, 200, False)]
    assert got[6][2:] == (0, 80, 100, 110, 7, True)
    assert layout_chunks(blocks.limit(0), 40, 20, 100).count() == 0


def test_literal_records(spark):
    import re

    from billweave.operators import extract

    texts = ["PATIENT: John Doe\nDOB: 01/15/1980\nJANE ROE DOB 2/3/90 99213", "Ann Lee\nseen 2020-01-02", "", "x", "name = mary ann smith 3/4"]
    got = {}
    for r in extract.records(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), literal=True).collect():
        got.setdefault(r.doc_id, []).append((r.patient_index, f"{r.first_name} {r.last_name}" if r.first_name else None))
    for k, text in enumerate(texts):
        names = [re.sub(r"\s+", " ", m.strip()) for p in extract.NAMES_LITERAL for m in re.findall(p, text) if len(m.strip()) > 2]
        dates = re.findall(extract.ANY_DATE, text) + re.findall(extract.YEAR_FIRST, text)
        want = names or ([None] if dates or re.findall(extract.FIVE_DIGITS, text) else ["Unknown Patient"])
        assert sorted(got[k]) == [(i, n if n is None or " " in n else n + " Patient") for i, n in enumerate(want)]


def test_result_xml(spark):
    from billweave.operators.export import result_xml

    schema = "file string, overall_confidence double, data struct<name:string,phone:string,codes:array<string>,people:array<struct<id:int,note:string>>>"
    row = ("a.pdf", 0.5, ("Ann", None, ["1", None], [(7, None)]))
    xml = result_xml(spark.createDataFrame([row], schema), ["file"], ["overall_confidence"], "data").first().xml
    flat = "".join(line.strip() for line in xml.splitlines())
    assert flat == (
        "<ExtractionResults><Metadata><file>a.pdf</file></Metadata><Confidences><overall_confidence>0.5</overall_confidence></Confidences><StructuredData><name>Ann</name><phone>null</phone>"
        '<codes><item index="0">1</item><item index="1">null</item></codes><people><item index="0"><id>7</id><note>null</note></item></people></StructuredData></ExtractionResults>'
    )


def test_protected(spark):
    from billweave.operators.anonymize import protected

    r = spark.createDataFrame([("Ann", "P1", None), (None, "P1", "555 123 4567")], "first_name string, patient_id string, phone string")
    assert [tuple(x) for x in protected(r, "Redaction").collect()] == [("[REDACTED]", "[REDACTED]", None), (None, "[REDACTED]", "[REDACTED]")]
    tokens = protected(r, "Tokenization").collect()
    assert tokens[0].patient_id == tokens[1].patient_id and tokens[0].patient_id.startswith("ID_") and tokens[1].first_name is None
    with pytest.raises(ValueError):
        protected(r, "none")


def test_templates(spark):
    from billweave.operators.extract import templated

    answers = spark.createDataFrame([(1, 0, "no"), (1, 1, '{"patients": [{"patient_info": {"first_name": "Ann"}}]}'), (2, 0, None), (3, 0, '{"a": 1}')], "doc_id long, attempt int, raw string")
    got = {r.doc_id: r for r in templated(answers).collect()}
    assert got[1].data.patients[0].patient_info.first_name == "Ann" and (got[2].ok, got[3].ok, got[3].data.patients) == (False, True, None)
    assert {r.doc_id: r.data and r.data.a for r in templated(answers, schema="struct<a:int>").collect()} == {1: None, 2: None, 3: 1}
    with pytest.raises(ValueError):
        templated(answers, "other")


def test_searched_once(spark):
    """A pattern with too few matches has none, in one pass with others; words that a pattern needs are asked for first."""
    texts = spark.createDataFrame([(1, "Name: Ann\nDOB: 1/2/1980\nDOB: 3/4/1981"), (2, None), (3, "last Ab Account #: 7 account #: 8")], "doc_id long, text string")
    got = detect.searched(texts, {"a": C.REPEATED_FIELDS, "b": [C.EMAIL, r"\d"]}, {"a": 2}, first={"b": 10}, on={"b": F.col("doc_id") == 3})
    rows = {r.doc_id: r for r in got.collect()}
    assert [(x.k, x.start) for x in rows[1].a] == [(1, 10), (1, 24)] and rows[1].b == [] and rows[2].a == [] and rows[2].b == []
    assert [(x.k, x.start) for x in rows[3].a] == [(3, 8), (3, 21)] and [(x.k, x.start) for x in rows[3].b] == [(11, 19), (11, 32)]
    places = sorted((r.start, r.end) for r in segment.repeated_boundaries(texts).collect())
    assert places == [(8, None), (10, None), (21, None), (24, None)]


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(")


def test_one_search(texts):
    """Each pattern is searched once: no filter and no second branch repeats a search."""
    assert scans(detect.procedures(texts)) == 1
    assert scans(detect.detected(texts, detect.PROCEDURES, detect.DIAGNOSES, detect.AMOUNTS)) == 5


def test_cluster_gate(spark):
    """A gap is found also where only codes of the rarer patterns lie beyond it, and where nothing else does."""
    code, idle = "A10 - x\nB20 - y\n", "nothing of note " * 25
    texts = spark.createDataFrame([(1, "CPT 12345 CPT 54321 " + idle + code), (2, code + idle + "DX A10 DX B20"), (3, code * 2), (4, "CPT 12345 CPT 54321 " + idle + "CPT 12345 CPT 54321")], "doc_id long, text string")
    assert sorted(r.doc_id for r in segment.cluster_boundaries(texts).collect()) == [1, 2, 4]
    assert scans(segment.cluster_boundaries(texts)) == 6 and scans(segment.keyword_boundaries(texts)) == 1
    assert [(r.doc_id, r.cluster, r.codes) for r in segment.code_clusters(texts).where("doc_id = 2").orderBy("cluster").collect()] == [(2, 0, 2), (2, 1, 2)]
