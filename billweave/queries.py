"""Queries over whole tables, one for each operator, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billweave.functions import constants as C
from billweave.functions import dates, privacy, scores
from billweave.functions.text import redact, trimmed_lines
from billweave.operators import anonymize, detect, ensemble, export, extract, report, resolve, segment, validate
from billweave.plans.records import CODED_SQL, PATIENT_SQL, READING_SQL, RUN_SQL, coded, patients, readings, runs
from billweave.plans.superbill import DOC_SQL, billing_texts
from billweave.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: The day that dates are judged on.
AS_OF = "2024-06-30"


def as_of() -> Column:
    return F.lit(AS_OF).cast("date")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- pieces of DuckDB SQL ---------------------------------------------------------------------------------------------


def hits(pattern: str, source: str = "doc") -> str:
    """doc_id, text, value, start and stop of every match."""
    p = pattern.replace("'", "''")
    return f"""(select doc_id, text, value, start, start + cast(length(value) as integer) as stop from (select doc_id, text, h[i] as value, cast(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0)
      + coalesce(list_sum(list_transform(h[1:i-1], lambda x: length(x))), 0) as integer) as start
      from (select doc_id, text, h, g, unnest(range(1, len(h) + 1)) as i from (select doc_id, text, regexp_extract_all(text, '{p}') as h, string_split_regex(text, '{p}') as g from {source}))))"""


def around(width: int) -> str:
    return f"substr(text, greatest(start - {width}, 0) + 1, least(length(text), stop + {width}) - greatest(start - {width}, 0))"


def any_of(text: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({text}, '{w}')" for w in words) + ")"


def count_in(text: str, words: list[str]) -> str:
    return "(" + " + ".join(f"cast(contains({text}, '{w}') as integer)" for w in words) + ")"


def plus(condition: str, amount: float) -> str:
    return f"case when {condition} then {amount} else 0.0 end"


def detected(source: str, kind: str, score: str, width: int = 50, value: str = "value") -> str:
    return f"select doc_id, '{kind}' as field_type, {value} as value, round(cast({score} as double), 4) as confidence, start, stop as \"end\", {around(width)} as context from {source}"


CPT_SCORE = f"least(1.0, 0.8 + {plus(any_of('lower(' + around(50) + ')', C.PROCEDURE_WORDS), 0.1)} + case when cast(value as integer) between 99200 and 99499 then 0.1 when cast(value as integer) between 10000 and 69999 then 0.05 else 0.0 end)"
ICD_SCORE = f"least(1.0, 0.8 + {plus(any_of('lower(' + around(50) + ')', C.DIAGNOSIS_WORDS), 0.1)} + {plus('contains(value, $$.$$)', 0.05)})"
MONEY_SCORE = f"least(1.0, 0.7 + {plus(any_of('lower(' + around(30) + ')', C.MONEY_WORDS), 0.2)} + {plus('contains(value, chr(36)) and contains(value, chr(46))', 0.1)})"
LUHN = "list_sum(list_transform(range(1, 16), lambda i: case when i % 2 = 0 then case when 2 * cast(substr('80840' || value, i, 1) as integer) > 9 then 2 * cast(substr('80840' || value, i, 1) as integer) - 9 else 2 * cast(substr('80840' || value, i, 1) as integer) end else cast(substr('80840' || value, i, 1) as integer) end)) % 10 = 0"
NPI_SCORE = f"least(1.0, 0.6 + {plus(any_of('lower(' + around(50) + ')', C.PROVIDER_WORDS), 0.3)} + 0.1)"
CPT_SQL = detected(f"{hits(C.CPT)} where cast(value as integer) between 100 and 99999", "cpt_code", CPT_SCORE)
ICD_SQL = detected(hits(C.ICD), "icd10_code", ICD_SCORE)
MONEY_SQL = " union all ".join(detected(hits(p), "monetary_amount", MONEY_SCORE, 30) for p in C.MONEY)
NPI_SQL = detected(f"{hits(C.NPI)} where {LUHN}", "npi", NPI_SCORE)
ID_SQL = " union all ".join((detected(hits(C.SSN), "ssn", "0.9"), detected(hits(C.PHONE), "phone", "0.8"), detected(hits(C.EMAIL), "email", "0.85")))
DATE_SCORE = f"least(1.0, 0.7 + {plus(any_of('lower(' + around(30) + ')', C.DATE_WORDS), 0.2)} + {plus(any_of('lower(substr(text, greatest(start - 20, 0) + 1, start - greatest(start - 20, 0)))', C.DATE_LABELS), 0.15)} + 0.1 + 0.05 - {plus(any_of('lower(' + around(30) + ')', ['$', 'amount']), 0.1)} + {plus('start < length(text) * 0.2', 0.05)})"
DATE_SQL = f"""select doc_id, field_type, strftime(day, '%Y-%m-%d') as value, confidence, start, "end", context from (select *, try_strptime(value, '%m/%d/%Y') as day from ({detected(hits(r'\b\d{1,2}/\d{1,2}/\d{4}\b'), 'date', DATE_SCORE, 30)})) where year(day) between 1900 and 2025"""
WORDS = "string_split_regex(value, '\\s+')"
NAME_SCORE = f"least(1.0, 0.5 + {plus(any_of('lower(' + around(30) + ')', C.NAME_PREFIXES), 0.3)} + {plus(any_of('lower(value)', C.NAME_SUFFIXES), 0.2)} + case when len({WORDS}) = 2 then 0.1 when len({WORDS}) >= 3 then 0.05 else 0.0 end)"
NAME_TEST = f"case when len({WORDS}) < 2 then {any_of('lower(' + around(20) + ')', C.NAME_PREFIXES)} else not list_has_any(list_transform({WORDS}, lambda w: lower(w)), {C.NOT_NAMES!r}) and length(value) <= 50 end"
NAME_SQL = detected(f"{hits(C.NAME)} where {NAME_TEST}", "name", NAME_SCORE)


# --- detectors -----------------------------------------------------------------------------------------------------------


@query(f"with {DOC_SQL} {CPT_SQL}")
def detect_cpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.procedures(billing_texts(spark, sf_dir))


@query(f"with {DOC_SQL} {ICD_SQL}")
def detect_icd10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.diagnoses(billing_texts(spark, sf_dir))


@query(f"with {DOC_SQL} {DATE_SQL}")
def detect_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.dates(billing_texts(spark, sf_dir), as_of())


@query(f"with {DOC_SQL} {ID_SQL}")
def detect_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.identifiers(billing_texts(spark, sf_dir))


@query(f"with {DOC_SQL} {MONEY_SQL}")
def detect_money_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.amounts(billing_texts(spark, sf_dir))


@query(f"with {DOC_SQL} {NPI_SQL}")
def detect_npi_luhn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.provider_numbers(billing_texts(spark, sf_dir))


@query(f"with {DOC_SQL} {NAME_SQL}")
def detect_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.names(billing_texts(spark, sf_dir))


ADDRESS_SCORE = f"least(1.0, 0.6 + {plus(any_of('upper(found)', C.STATES), 0.2)} + {plus('regexp_matches(found, $$[0-9]{5}$$)', 0.1)} + {plus(any_of('lower(found)', C.STREETS), 0.1)})"


@query(f"""with {DOC_SQL}, doc2 as (select doc_id, text || chr(10) || 'Ship to ' || (doc_id % 900 + 1) || ' Elm Street, Salem, OR 97301' as text from doc),
  h as (select doc_id, text, start, regexp_extract(substr(text, start + 1, 200), '{detect.TOWN}', 0) as found from {hits(detect.STREET, 'doc2')}), k as (select *, start + cast(length(found) as integer) as stop from h where found <> '')
  select doc_id, 'address' as field_type, found as value, round(cast({ADDRESS_SCORE} as double), 4) as confidence, start, stop as "end", {around(30)} as context from k""")
def detect_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over billing texts with an address line made from the customer."""
    texts = billing_texts(spark, sf_dir)
    line = F.concat(F.lit("\nShip to "), (F.col("doc_id") % 900 + 1).cast("string"), F.lit(" Elm Street, Salem, OR 97301"))
    return detect.addresses(texts.withColumn("text", F.concat("text", line)))


@query(f"with {DOC_SQL}, d as ({CPT_SQL} union all {ICD_SQL} union all {MONEY_SQL}) select doc_id, field_type, value, confidence, start, \"end\", cast(rank as integer) as rank from (select *, row_number() over (partition by doc_id, field_type order by confidence desc, start, \"end\", value) as rank from d) where rank <= 5")
def best_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = billing_texts(spark, sf_dir)
    every = detect.detected(texts, detect.PROCEDURES, detect.DIAGNOSES, detect.AMOUNTS)
    return detect.best_matches(every).drop("context")


@query(f"with {DOC_SQL}, d as ({CPT_SQL} union all {ICD_SQL}) select doc_id, field_type, string_agg(value, ',' order by confidence desc, start, \"end\", value) as listed from d group by all")
def detections_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = billing_texts(spark, sf_dir)
    return detect.by_type(detect.detected(texts, detect.PROCEDURES, detect.DIAGNOSES)).select("doc_id", "field_type", F.array_join("values", ",").alias("listed"))


@query(f"with {DOC_SQL}, d as ({ID_SQL} union all {CPT_SQL}) select doc_id, bool_or(field_type in ('ssn', 'phone', 'email', 'name')) as phi_detected from d group by doc_id")
def personal_data_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = billing_texts(spark, sf_dir)
    return detect.holds_personal_data(detect.detected(texts, detect.IDENTIFIERS, detect.PROCEDURES))


REDACTED = "text"
for _p in (C.SSN, C.PHONE, C.EMAIL, C.CARD, C.SLASH_DATE):
    REDACTED = f"regexp_replace({REDACTED}, '{_p}', '[REDACTED]', 'g')"


@query(f"with {DOC_SQL} select doc_id, {REDACTED} as text from doc")
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return billing_texts(spark, sf_dir).select("doc_id", redact(F.col("text"), [C.SSN, C.PHONE, C.EMAIL, C.CARD, C.SLASH_DATE]).alias("text"))


CATEGORY_SQL = "case " + " ".join(f"when cast(code as integer) between {a} and {b} then '{n}'" for n, a, b in C.CPT_RANGES) + " end"
CPT_DIM = "(values " + ", ".join(f"('{k}', '{d}', '{c}')" for k, (d, c) in C.CPT_CODES.items()) + ") as dim(known, known_description, known_category)"
ICD_DIM = "(values " + ", ".join(f"('{k}', '{d}', '{c}')" for k, (d, c) in C.ICD_CODES.items()) + ") as dim(known, known_description, known_category)"
CHAPTER_SQL = "case " + " ".join(f"when contains('{k}', substr(code, 1, 1)) then '{v}'" for k, v in C.ICD_CHAPTERS.items()) + " end"


@query(f"""with {DOC_SQL} select doc_id, code, category, case when known is not null then 'Valid CPT code' when category is not null then 'Valid CPT code format (category: ' || category || ')' else 'Unknown CPT code' end as message,
  known is not null or category is not null as is_valid, case when known is not null then known_description when category is not null then 'Description not available' end as description
  from (select doc_id, code, known, known_description, case when known is not null then known_category else {CATEGORY_SQL} end as category from (select doc_id, value as code from ({CPT_SQL})) left join {CPT_DIM} on code = known)""")
def cpt_validate_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = detect.procedures(billing_texts(spark, sf_dir)).select("doc_id", F.col("value").alias("code"))
    return validate.validate_cpt(codes, validate.cpt_table(spark))


@query(f"""with {DOC_SQL} select doc_id, code, category, case when known is not null then 'Valid ICD-10 code' when category is not null then 'Valid ICD-10 code format (category: ' || category || ')' else 'Unknown ICD-10 code format' end as message,
  known is not null or category is not null as is_valid, case when known is not null then known_description when category is not null then 'Description not available' end as description
  from (select doc_id, code, known, known_description, case when known is not null then known_category else {CHAPTER_SQL} end as category from (select doc_id, value as code from ({ICD_SQL})) left join {ICD_DIM} on code = known)""")
def icd_chapter_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = detect.diagnoses(billing_texts(spark, sf_dir)).select("doc_id", F.col("value").alias("code"))
    return validate.validate_icd(codes, validate.icd_table(spark))


CATEGORY_COUNT_SQL = f"with {DOC_SQL} select coalesce(category, 'none') as category, count(*) as codes, count(distinct doc_id) as documents from (select doc_id, {CATEGORY_SQL} as category from (select doc_id, value as code from ({CPT_SQL}))) group by 1"


@query(CATEGORY_COUNT_SQL)
def codes_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: billing texts, procedures, their categories, counts."""
    found = detect.procedures(billing_texts(spark, sf_dir))
    return found.groupBy(F.coalesce(validate.cpt_category(F.col("value")), F.lit("none")).alias("category")).agg(F.count("*").alias("codes"), F.count_distinct("doc_id").alias("documents"))


# --- validation --------------------------------------------------------------------------------------------------------------


@query(f"""with {PATIENT_SQL} select node, case when date_of_birth > date '{AS_OF}' then 'Date of birth cannot be in the future' when year(date_of_birth) < 1900 then 'Date of birth too far in the past' when (date '{AS_OF}' - date_of_birth) / 365.25 > 150 then 'Age exceeds reasonable limit' end as birth_problem,
  case when date_of_service > date '{AS_OF}' + interval 12 month then 'Service date too far in the future' when date_of_service < date '{AS_OF}' - interval 120 month then 'Service date too far in the past' when date_of_service < date_of_birth then 'Service date cannot be before date of birth' end as service_problem,
  case when date_of_birth > date_of_service then 'Start date must be before end date' when date_of_service - date_of_birth > 365 then 'Date range exceeds one year' end as range_problem from pat""")
def date_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = patients(spark, sf_dir)
    birth, service = F.col("date_of_birth"), F.col("date_of_service")
    return p.select("node", validate.birth_date_problem(birth, as_of()).alias("birth_problem"), validate.service_date_problem(service, birth, as_of()).alias("service_problem"), validate.date_range_problem(birth, service).alias("range_problem"))


@query(f"""with {PATIENT_SQL} select node, date_of_birth < date '{AS_OF}' as birth_before_now, date_of_service <= date '{AS_OF}' as service_not_after_now, date_of_service + cast(node % 30 as integer) - 10 >= date_of_service as claim_not_before_service,
  date_of_service + cast(node % 30 as integer) - 10 <= date '{AS_OF}' as claim_not_after_now, false as appointment_given, date_of_birth > date '{AS_OF}' - 43830 as birth_within_120_years from pat""")
def date_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = patients(spark, sf_dir).withColumn("claim", F.date_add("date_of_service", (F.col("node") % 30 - 10).cast("int")))
    found = validate.date_consistency(F.col("date_of_birth"), F.col("date_of_service"), F.col("claim"), F.lit(None).cast("date"), as_of())
    return p.select("node", found.alias("c")).select("node", "c.*")


@query(f"""with {PATIENT_SQL} select node, array_to_string(list_concat(list_filter([case when coalesce(first_name, '') = '' and coalesce(last_name, '') = '' then 'Missing patient name' end, case when date_of_birth > date '{AS_OF}' then 'Date of birth in the future' end,
  case when (date_of_service - date_of_birth) / 365.25 < 0 or (date_of_service - date_of_birth) / 365.25 > 150 then 'Invalid age at service date' end], lambda x: x is not null),
  list_concat(list_transform(list_filter(cpt_codes, lambda c: not regexp_full_match(c, '\\d{{5}}') or cast(c as integer) < 100), lambda c: 'Invalid CPT code: ' || c), list_transform(list_filter(icd10_codes, lambda c: not regexp_full_match(c, '[A-Z]\\d{{2}}(\\.[A-Z0-9]{{1,3}})?')), lambda c: 'Invalid ICD-10 code: ' || c))), '; ') as errors from pat""")
def patient_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = patients(spark, sf_dir)
    found = validate.record_errors(F.col("first_name"), F.col("last_name"), F.col("date_of_birth"), F.col("date_of_service"), F.col("cpt_codes"), F.col("icd10_codes"), as_of())
    return p.select("node", F.array_join(found, "; ").alias("errors"))


def _listed(prefixes: list[str], kind: str, tail: str, on: str) -> str:
    test = " or ".join(f"starts_with(c, '{p}')" for p in prefixes)
    return f"list_transform(list_filter(cpt_codes, lambda c: ({on}) and ({test})), lambda c: 'Found {kind} procedure code ' || c || ' for {tail}')"


AGE_SQL = f"date_diff('year', date_of_birth, date '{AS_OF}') - cast(month(date '{AS_OF}') * 100 + day(date '{AS_OF}') < month(date_of_birth) * 100 + day(date_of_birth) as integer)"
MIXED_SQL = [
    "list_filter([case when len(icd10_codes) > 12 then 'Unusually high number of ICD-10 codes: ' || len(icd10_codes) end, case when len(cpt_codes) > 15 then 'Unusually high number of CPT codes: ' || len(cpt_codes) end], lambda x: x is not null)",
    _listed(C.FEMALE_PREFIXES, "female-specific", "male patient", "gender = 'male'"), _listed(C.MALE_PREFIXES, "male-specific", "female patient", "gender = 'female'"),
    _listed(C.PEDIATRIC, "pediatric", "elderly patient", f"{AGE_SQL} > 65"), _listed(C.GERIATRIC, "geriatric", "young patient", f"{AGE_SQL} < 18"),
    "list_filter([case when first_name <> '' and last_name <> '' and (contains(first_name, ';') or contains(last_name, ';')) then 'Multiple names detected in name fields' end, case when first_name <> '' and last_name <> '' and (contains(first_name, ' and ') or contains(first_name, ' & ')) then 'Possible multiple patients in first name field' end, case when first_name <> '' and last_name <> '' and (contains(last_name, ' and ') or contains(last_name, ' & ')) then 'Possible multiple patients in last name field' end], lambda x: x is not null)",
]


@query(f"with {PATIENT_SQL} select node, array_to_string(flatten([{', '.join(MIXED_SQL)}]), '; ') as issues from pat")
def mixed_patient_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = patients(spark, sf_dir)
    found = validate.mixed_record_issues(F.col("first_name"), F.col("last_name"), F.col("gender"), F.col("date_of_birth"), F.col("cpt_codes"), F.col("icd10_codes"), as_of())
    return p.select("node", F.array_join(found, "; ").alias("issues"))


# --- exports -----------------------------------------------------------------------------------------------------------------


@query(f"""with {CODED_SQL}, e as (select node, cpt as c, icd as d from cod),
  r as (select node, unnest(list_concat(list_transform(c, lambda x: {{'t': 'CPT', 'c': x, 'd': 'CPT ' || x, 'f': 0.8::double}}), list_transform(d, lambda x: {{'t': 'ICD-10', 'c': x, 'd': 'ICD-10 ' || x, 'f': 0.7::double}}))) as x, unnest(range(len(c) + len(d))) as pos from e where len(c) + len(d) > 0)
  select node, cast(pos as integer) as pos, x.t as code_type, x.c as medical_code, x.d as code_description, x.f as code_confidence from r union all select node, null, null, null, null, null from e where len(c) + len(d) = 0""")
def csv_code_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.code_rows(coded(spark, sf_dir), ["node"])


@query(f"with {CODED_SQL} select node, array_to_string(cpt, '; ') as cpt_codes, array_to_string(icd, '; ') as icd10_codes from cod")
def csv_summary_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.code_summary(coded(spark, sf_dir), ["node"])


@query(f"with {CODED_SQL}, e as (select node, unnest(range(greatest(len(cpt), len(icd), 1))) as row, cpt, icd, charge from cod) select node, cast(row as integer) as row, coalesce(cpt[row + 1], '') as cpt_code, charge[row + 1] as cpt_charge, coalesce(icd[row + 1], '') as icd10_code, coalesce('ICD-10 ' || icd[row + 1], '') as icd10_description from e")
def csv_zip_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.zipped_rows(coded(spark, sf_dir), ["node"])


@query(f"with {CODED_SQL}, e as (select node, unnest(case when len(cpt) = 0 then [1] else range(1, len(cpt) + 1) end) as i, cpt, charge from cod) select node, coalesce(cpt[i], '') as cpt_code, coalesce('CPT ' || cpt[i], '') as cpt_description, charge[i] as charge from e")
def csv_procedure_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.procedure_rows(coded(spark, sf_dir), ["node"])


@query(f"with {CODED_SQL} select node, 'CPT' as kind, unnest(cpt) as code, cast(unnest(charge) as varchar) as charge from cod union all select node, 'ICD-10', unnest(icd), '' from cod")
def code_detail_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.code_details(coded(spark, sf_dir), ["node"])


@query(f"with {CODED_SQL}, e as (select node, unnest(case when len(cpt) = 0 then [1] else range(1, len(cpt) + 1) end) as i, cpt, icd from cod)" + " select node, cpt[i] as cpt_code, icd[1] as diagnosis_code_1, icd[2] as diagnosis_code_2, icd[3] as diagnosis_code_3, icd[4] as diagnosis_code_4, " + ", ".join(f"'ICD-10 ' || icd[{k}] as diagnosis_desc_{k}" for k in range(1, 5)) + " from e")
def diagnosis_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.with_four_diagnoses(coded(spark, sf_dir), ["node"])


@query(f"with {CODED_SQL} select node, array_to_string(cpt, ', ') as cpt_codes, array_to_string(icd, ', ') as icd10_codes, total_charge, printf('%.2f', confidence) as confidence from cod")
def patient_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.patient_summary(coded(spark, sf_dir), ["node"])


@query(f"with {PATIENT_SQL} select node, coalesce(first_name, '') as first_name, last_name, coalesce(patient_id, '') as patient_id, total_charge, strftime(date_of_birth, '%Y-%m-%d') as date_of_birth, strftime(date_of_service, '%Y-%m-%d') as date_of_service from pat")
def base_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.base_row(patients(spark, sf_dir).select("node", "first_name", "last_name", "patient_id", "total_charge", "date_of_birth", "date_of_service"))


@query(f"with {PATIENT_SQL} select node, first_name as person_first_name, last_name as person_last_name, patient_id as person_ids_patient_id, total_charge as money_total, '[\"' || array_to_string(cpt_codes, '\",\"') || '\"]' as codes from pat")
def flatten_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = patients(spark, sf_dir).select("node", F.struct("first_name", "last_name", F.struct("patient_id").alias("ids")).alias("person"), F.struct(F.col("total_charge").alias("total")).alias("money"), F.col("cpt_codes").alias("codes"))
    return export.flattened(nested)


@query(f"with {PATIENT_SQL} select node, array_to_string(cpt_codes[1:3], ',') as items, cast(greatest(len(cpt_codes) - 3, 0) as integer) as more from pat")
def nested_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patients(spark, sf_dir).select("node", export.preview("cpt_codes").alias("p")).select("node", F.array_join("p.items", ",").alias("items"), F.col("p.more").alias("more"))


@query(f"with {PATIENT_SQL} select '{{\"metadata\":{{\"version\":\"1\"}},\"data\":{{\"node\":' || node || ',\"last_name\":\"' || last_name || '\",\"cpt_codes\":[\"' || array_to_string(cpt_codes, '\",\"') || '\"]}}}}' as json from pat")
def json_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.as_json(patients(spark, sf_dir).select("node", "last_name", "cpt_codes"), {"version": "1"})


@query()
def xml_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.as_xml(patients(spark, sf_dir).select("node", "last_name", "cpt_codes"))


@query()
def text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.text_report(patients(spark, sf_dir).select("node", F.struct("first_name", "last_name").alias("person"), "cpt_codes"))


# --- segmentation ----------------------------------------------------------------------------------------------------------


def _keyword(k: int, word: str) -> str:
    score = f"least(1.0, 0.7 + {0.2 if word in C.STRONG_KEYWORDS else 0.0} + least(0.2, 0.05 * {count_in('lower(' + around(50) + ')', C.PATIENT_TERMS)}))"
    return f"select doc_id, start, cast(null as integer) as \"end\", 'keyword_separator' as kind, round(cast({score} as double), 4) as confidence, 0 as method, {k} as ord from {hits(rf'(?i)\b{word}\b')}"


KEYWORD_SQL = "select * from (" + " union all ".join(_keyword(k, w) for k, w in enumerate(C.BOUNDARY_KEYWORDS)) + ") where confidence >= 0.8"


@query(f"with {DOC_SQL} {KEYWORD_SQL}")
def boundary_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.keyword_boundaries(billing_texts(spark, sf_dir))


@query(f"""with {DOC_SQL}, l as (select doc_id, list_transform(string_split(text, chr(10)), lambda x: x) as ls from doc), e as (select doc_id, unnest(range(1, len(ls) + 1)) as i, ls from l),
  x as (select doc_id, cast(i - 1 as integer) as ord, trim(ls[i]) as line, cast(coalesce(list_sum(list_transform(ls[1:i-1], lambda y: length(y) + 1)), 0) as integer) as start from e)
  select doc_id, start, cast(null as integer) as "end", 'text_block' as kind, confidence, 4 as method, ord from (select *, round(cast(least(1.0, 0.5 + case when contains(line, ':') then 0.2 else 0.0 end + case when upper(line) = line and lower(line) <> line then 0.1 else 0.0 end + case when regexp_matches(line, '{C.LINE_FIELDS}') then 0.15 else 0.0 end) as double), 4) as confidence from x where {any_of('lower(line)', C.LINE_INDICATORS)}) where confidence >= 0.5""")
def boundary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.line_boundaries(billing_texts(spark, sf_dir))


@query(f"with {DOC_SQL} select doc_id, start, start + 40 as \"end\", 'form_structure' as kind, 0.6::double as confidence, 3 as method, 0 as ord from {hits('-{10,}')}")
def boundary_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.rule_boundaries(billing_texts(spark, sf_dir))


REPEATED_SQL = " union all ".join(f"select doc_id, start, cast(null as integer) as \"end\", 'pattern_repeat' as kind, 0.7::double as confidence, 2 as method, {k} as ord from (select *, count(*) over (partition by doc_id) as many from {hits(p)}) where many > 1" for k, p in enumerate(C.REPEATED_FIELDS))


@query(f"with {DOC_SQL} {REPEATED_SQL}")
def boundary_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.repeated_boundaries(billing_texts(spark, sf_dir))


#: The second pattern of names without looking around, which this dialect lacks.
LATER_NAMES = r"(?i)(?:LAST|FIRST)[:.\s]+((?:[A-Z][a-z]+\s*)+)"
NEAR_SQL = "(" + " + ".join(f"cast(regexp_matches({around(50)}, '(?i){p}') as integer)" for p in C.DEMOGRAPHIC) + ") >= 2"


@query(f"with {DOC_SQL} " + " union all ".join(f"select doc_id, start, cast(null as integer) as \"end\", 'form_structure' as kind, {0.85 if k < len(C.PATIENT_IDS) else 0.8}::double as confidence, 1 as method, {k} as ord from {hits(p)} where {NEAR_SQL}" for k, p in enumerate(C.PATIENT_IDS + [C.PATIENT_NAMES[0], LATER_NAMES])))
def boundary_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.identifier_boundaries(billing_texts(spark, sf_dir))




def labelled_sql(source: str = "doc") -> str:
    after = "regexp_extract(substr(text, stop + 1), '^[^\\n]*')"
    followed = [f"select doc_id, start from {hits(p, source)} where regexp_matches({after}, '(?i){words}')" for p, words in segment.FOLLOWED]
    return " union ".join([f"select doc_id, start from {hits(p, source)}" for p in segment.LABELLED] + followed)


LABELLED_SQL = labelled_sql()


@query(f"""with {DOC_SQL}, c as ({LABELLED_SQL}), m as (select *, case when start - lag(start) over w > 300 then 1 else 0 end as fresh, count(*) over (partition by doc_id) as many from c window w as (partition by doc_id order by start)),
  i as (select *, cast(sum(fresh) over (partition by doc_id order by start) as integer) as cluster from m where many >= 4) select doc_id, cluster, min(start) as first, max(start) as last, count(*) as codes from i group by doc_id, cluster having count(*) >= 2""")
def code_cluster_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.code_clusters(billing_texts(spark, sf_dir))


GAP_TEXT = " and nothing of note"
LABELLED_TWICE = labelled_sql("doc2")


@query(f"""with {DOC_SQL}, doc2 as (select doc_id, text || chr(10) || repeat('{GAP_TEXT}', cast(10 + doc_id % 30 as integer)) || chr(10) || text as text from doc), c as ({LABELLED_TWICE}),
  m as (select *, case when start - lag(start) over w > 300 then 1 else 0 end as fresh, count(*) over (partition by doc_id) as many from c window w as (partition by doc_id order by start)),
  i as (select *, cast(sum(fresh) over (partition by doc_id order by start) as integer) as cluster from m where many >= 4), s as (select doc_id, cluster, min(start) as first, max(start) as last from i group by doc_id, cluster having count(*) >= 2),
  g as (select *, lag(last) over (partition by doc_id order by first) as prior from s), t as (select g.*, lower(substr(text, prior + 1, first - prior)) as between_them, length(regexp_extract(substr(text, greatest(first - 100, 0) + 1, least(first, 100)), '(?s)^.*\n', 0)) as line from g join doc2 on doc2.doc_id = g.doc_id where first - prior > 200)
  select doc_id, cast(case when line > 0 then greatest(first - 100, 0) + line else first end as integer) as start, cast(null as integer) as "end", 'text_block' as kind, round(cast(least(1.0, 0.7 + {plus(any_of('between_them', [w.lower() for w in C.BOUNDARY_KEYWORDS]), 0.2)} + {plus('first - prior > 500', 0.1)}) as double), 4) as confidence, 5 as method, cluster as ord from t""")
def boundary_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over billing texts said twice, with idle words between."""
    filler = F.repeat(F.lit(GAP_TEXT), (F.col("doc_id") % 30 + 10).cast("int"))
    return segment.cluster_boundaries(billing_texts(spark, sf_dir).withColumn("text", F.concat("text", F.lit("\n"), filler, F.lit("\n"), "text")))


#: All boundaries of the billing texts (which have no gap between clusters), in the order of the detectors.
BOUNDS_SQL = " union all ".join(f'select doc_id, start, method, ord, confidence, kind from ({ORACLES[n]})' for n in ("boundary_keyword", "boundary_identifiers", "boundary_repeated", "boundary_rules", "boundary_lines"))


def folded_sql(near: str, source: str) -> str:
    """doc_id, idx and b: the boundaries that a fold keeps, of which only the last kept can be in conflict."""
    return f"""(select doc_id, unnest(kept) as b, unnest(range(len(kept))) as idx from (select doc_id, list_reduce(list([{{'start': start, 'method': method, 'ord': ord, 'confidence': confidence, 'kind': kind}}] order by start, method, ord, confidence, kind),
      lambda acc, b: case when {near} then case when b[1].confidence > acc[-1].confidence then list_append(acc[:-2], b[1]) else acc end else list_concat(acc, b) end) as kept from ({source}) group by doc_id))"""


SIFTED_SQL = f"select doc_id, cast(idx as integer) as idx, b.start as start, b.kind as kind, b.confidence as confidence from {folded_sql('b[1].start - acc[-1].start < 100', BOUNDS_SQL)} where idx < 9"


@query(SIFTED_SQL)
def boundary_sifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.sifted(segment.boundaries(billing_texts(spark, sf_dir)))


@query(f"""with {DOC_SQL}, k as (select doc_id, list({{'at': start, 'c': confidence}} order by start) as bs from ({SIFTED_SQL}) group by doc_id),
  s as (select doc.doc_id, text, case when bs is null then [{{'at': 0, 'c': 1.0::double}}] when bs[1].at > 0 then list_concat([{{'at': 0, 'c': 0.8::double}}], bs) else bs end as ss from doc left join k on k.doc_id = doc.doc_id),
  e as (select doc_id, text, ss, unnest(range(1, len(ss) + 1)) as i from s), c as (select doc_id, ss[i].at as start, coalesce(ss[i + 1].at, length(text)) as stop, text, ss[i].c as confidence, len(ss) = 1 as alone, i from e),
  t as (select doc_id, start, stop, substr(text, start + 1, stop - start) as text, confidence, alone, i from c) select doc_id, cast(row_number() over (partition by doc_id order by start, i) - 1 as integer) as seg_idx, cast(start as integer) as start, cast(stop as integer) as "end", text, confidence from t where length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 50 or (alone and confidence = 1.0)""")
def text_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = billing_texts(spark, sf_dir)
    return segment.segments(texts, segment.sifted(segment.boundaries(texts)))


@query("select conv_id as doc_id, string_agg(text, chr(10) || chr(10) || '--- PAGE BREAK ---' || chr(10) || chr(10) order by turn, text) as text from conversations group by conv_id")
def page_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.joined_pages(read_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text"))


@query("select conv_id as doc_id, cast(row_number() over (partition by conv_id order by turn, text) - 1 as integer) as page_no, text from conversations")
def page_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.split_pages(page_join(spark, sf_dir))


def grid_sql(source: str, keys: str, width: int, height: int, tokens: int) -> str:
    """keys, chunk_index and box of source(keys, width, height, tokens)."""
    return f"""(with n as (select *, ceil(width / {width}) as nx0, ceil(height / {height}) as ny0 from {source}), e as (select *, greatest(1.0, sqrt(tokens / (nx0 * ny0) / {tokens})) as excess from n),
  g as (select *, cast(ceil(nx0 * excess) as bigint) as nx, cast(ceil(ny0 * excess) as bigint) as ny from e), c as (select *, unnest(range(nx)) as col from g), r as (select *, unnest(range(ny)) as "row" from c),
  s as (select *, width / nx as cw, height / ny as ch from r), t as (select *, floor(cw * 0.1::double) as dx, floor(ch * 0.1::double) as dy from s)
  select {keys}, cast("row" * nx + col as integer) as chunk_index, cast(case when col > 0 then floor(col * cw) - dx else 0 end as integer) as x1, cast(case when "row" > 0 then floor("row" * ch) - dy else 0 end as integer) as y1,
    cast(case when col < nx - 1 then floor((col + 1) * cw) + dx else width end as integer) as x2, cast(case when "row" < ny - 1 then floor(("row" + 1) * ch) + dy else height end as integer) as y2 from t)"""


@query(f"select * from {grid_sql('(select page_id, 500 + page_id % 4000 as width, 700 + page_id % 5000 as height, page_id % 9 * 7000 as tokens from pages)', 'page_id', 1000, 1200, 1500)}")
def chunk_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id")
    pages = read_table(spark, sf_dir, "pages").select("page_id", (500 + key % 4000).alias("width"), (700 + key % 5000).alias("height"), (key % 9 * 7000).alias("tokens"))
    return segment.grid_chunks(pages, 1000, 1200, most_tokens=1500)


#: Blocks of pages made from the turns of conversations.
BLOCK_SQL = "select conv_id as page_id, cast(turn * 90 as integer) as y, cast(turn % 2 * 400 as integer) as x, cast(300 + turn % 3 * 50 as integer) as w, 80 as h, cast((conv_id * 7 + turn * 1310) % 2500 as integer) as tokens from conversations"
PACKED_SQL = f"""select page_id, unnest(bs) as b from (select page_id, list_reduce(list([{{'y': y, 'x': x, 'w': w, 'h': h, 'tokens': tokens, 'pack': 0, 'total': tokens}}] order by y, x, w, h, tokens), lambda acc, b:
    list_concat(acc, [{{'y': b[1].y, 'x': b[1].x, 'w': b[1].w, 'h': b[1].h, 'tokens': b[1].tokens, 'pack': acc[-1].pack + case when b[1].tokens > 1500 or acc[-1].tokens > 1500 or acc[-1].total + b[1].tokens > 1500 then 1 else 0 end,
      'total': case when b[1].tokens > 1500 or acc[-1].tokens > 1500 or acc[-1].total + b[1].tokens > 1500 then b[1].tokens else acc[-1].total + b[1].tokens end}}])) as bs from ({BLOCK_SQL}) group by page_id)"""


@query(f"""with k as (select page_id, b.pack as pack, min(b.x) as x, min(b.y) as y, max(b.x + b.w) as "right", max(b.y + b.h) as below, cast(sum(b.tokens) as integer) as tokens, max(b.tokens) as largest from ({PACKED_SQL}) group by all),
  large as (select page_id, pack, x, y, tokens, "right" - x as width, below - y as height from k where largest > 1500), u as (
  select page_id, pack, 0 as cell, greatest(x - 10, 0) as x1, greatest(y - 10, 0) as y1, least("right" + 10, 1000) as x2, least(below + 10, 4000) as y2, tokens, true as whole from k where largest <= 1500
  union all select page_id, pack, chunk_index, x1 + x, y1 + y, x2 + x, y2 + y, tokens, false from {grid_sql('large', 'page_id, pack, x, y, tokens', 200, 60, 1500)})
  select page_id, cast(row_number() over (partition by page_id order by pack, cell) - 1 as integer) as chunk_index, x1, y1, x2, y2, tokens, whole from u""")
def chunk_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn")
    numbers = {"y": turn * 90, "x": turn % 2 * 400, "w": 300 + turn % 3 * 50, "h": F.lit(80), "tokens": (F.col("conv_id") * 7 + turn * 1310) % 2500, "width": F.lit(1000), "height": F.lit(4000)}
    blocks = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page_id"), *(c.cast("int").alias(n) for n, c in numbers.items()))
    return segment.layout_chunks(blocks, 200, 60, 1500)


CHUNK_SQL = "ch as (select conv_id as page_id, cast(turn % 2 * 500 as integer) as x1, cast(turn // 2 * 130 as integer) as y1, cast(turn // 2 * 130 + 100 + turn % 2 * 20 as integer) as y2, role || chr(10) || '  ' || turn || '  ' || chr(10) as text from conversations)"


@query(f"with {CHUNK_SQL}, o as (select *, row_number() over w as k, lead(y1) over w - y2 > 20 as far from ch window w as (partition by page_id order by y1, x1)) select page_id, string_agg(replace(replace(trim(text, chr(10) || ' '), '  ', ''), chr(10) || ' ', chr(10)) || case when far then chr(10) else '' end, chr(10) order by k) as text from o group by page_id")
def chunk_text_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations")
    turn = F.col("turn")
    chunks = c.select(F.col("conv_id").alias("page_id"), (turn % 2 * 500).cast("int").alias("x1"), F.expr("cast(turn div 2 * 130 as int)").alias("y1"), F.expr("cast(turn div 2 * 130 + 100 + turn % 2 * 20 as int)").alias("y2"), F.concat("role", F.lit("\n  "), turn.cast("string"), F.lit("  \n")).alias("text"))
    return segment.combined_chunks(chunks)


@query()
def box_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read_table(spark, sf_dir, "events")
    k = F.col("event_id")
    boxes = v.select(F.col("user_id").alias("page_id"), k.cast("int").alias("ord"), (k % 300).cast("int").alias("x1"), (k % 500).cast("int").alias("y1"), (k % 300 + 100 + k % 90).cast("int").alias("x2"), (k % 500 + 40 + k % 70).cast("int").alias("y2"), F.lit(1000).alias("width"), F.lit(1000).alias("height"))
    return segment.kept_boxes(boxes)


# --- extraction -----------------------------------------------------------------------------------------------------------


@query(f"""with {DOC_SQL}, x as (select doc_id, regexp_extract_all(text, '{extract.NAME_FIELD}', 1) as names, regexp_extract_all(text, '{extract.ANY_DATE}', 1) as ds, regexp_extract_all(text, '{extract.FIVE_DIGITS}', 1) as cpt, regexp_extract_all(text, '{extract.ICD_WHOLE}', 1) as icd,
  regexp_extract_all(text, '{extract.AMOUNT.replace(chr(92) + '$', '[$]')}', 1) as am from doc), e as (select *, unnest(names) as name, unnest(range(len(names))) as patient_index from x)
  select doc_id, cast(patient_index as integer) as patient_index, string_split(name, ' ')[1] as first_name, case when len(string_split(trim(name), ' ')) >= 2 then array_to_string(string_split(trim(name), ' ')[2:], ' ') else 'Patient' end as last_name, cast(strptime(ds[1], '%m/%d/%Y') as date) as date_of_birth, cast(strptime(ds[2], '%m/%d/%Y') as date) as date_of_service, array_to_string(cpt, ',') as cpt_codes, array_to_string(icd, ',') as icd10_codes, cast(replace(am[1], ',', '') as decimal(14,2)) as total_charge from e""")
def superbill_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = extract.records(billing_texts(spark, sf_dir))
    return got.withColumn("cpt_codes", F.array_join("cpt_codes", ",")).withColumn("icd10_codes", F.array_join("icd10_codes", ","))


@query(f"""with {DOC_SQL}, d as ({DATE_SQL}), c as ({CPT_SQL}), i as ({ICD_SQL}),
  dd as (select doc_id, arg_min(value, start) filter (regexp_matches(lower(context), 'birth|dob|born')) as birth, arg_min(value, start) filter (regexp_matches(lower(context), 'service|visit|appointment|exam')) as service, list(value order by start, value) as ds from d group by doc_id),
  cc as (select doc_id, string_agg(value, ',' order by start, value) as codes from c group by doc_id), ii as (select doc_id, string_agg(value, ',' order by start, value) as codes from i group by doc_id)
  select doc.doc_id, 'Unknown' as first_name, 'Patient' as last_name, cast(coalesce(birth, ds[1]) as date) as date_of_birth, cast(coalesce(service, ds[2]) as date) as date_of_service, coalesce(cc.codes, '') as cpt_codes, coalesce(ii.codes, '') as icd10_codes, 0.6::double as extraction_confidence
  from doc left join dd on dd.doc_id = doc.doc_id left join cc on cc.doc_id = doc.doc_id left join ii on ii.doc_id = doc.doc_id where cc.codes is not null or ds is not null""")
def fallback_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = billing_texts(spark, sf_dir)
    found = detect.detected(texts, detect.PROCEDURES, detect.DIAGNOSES, detect.DATES, as_of=as_of())
    return _codes_joined(extract.fallback_records(texts, found))


def _codes_joined(records: DataFrame) -> DataFrame:
    return records.withColumn("cpt_codes", F.array_join("cpt_codes", ",")).withColumn("icd10_codes", F.array_join("icd10_codes", ","))


@query(f"""with {DOC_SQL}, x as (select doc_id, regexp_extract_all(text, '{extract.NAME_FIELD}', 1) as names, regexp_extract_all(text, '{extract.ANY_DATE}', 1) as ds, regexp_extract_all(text, '{extract.ICD_WHOLE}', 1) as icd from doc), e as (select *, unnest(names) as name, unnest(range(len(names))) as patient_index from x),
  c as (select doc_id, string_agg(value, ',' order by start, value) as codes from ({CPT_SQL}) group by doc_id), m as (select doc_id, arg_min(value, (start, value)) as amount from ({MONEY_SQL}) group by doc_id), p as (select doc_id, count(*) as n from ({ID_SQL}) group by doc_id)
  select e.doc_id, cast(patient_index as integer) as patient_index, string_split(name, ' ')[1] as first_name, case when len(string_split(trim(name), ' ')) >= 2 then array_to_string(string_split(trim(name), ' ')[2:], ' ') else 'Patient' end as last_name, cast(strptime(ds[1], '%m/%d/%Y') as date) as date_of_birth, cast(strptime(ds[2], '%m/%d/%Y') as date) as date_of_service,
  coalesce(c.codes, '') as cpt_codes, array_to_string(icd, ',') as icd10_codes, cast(regexp_replace(amount, '[$,]', '', 'g') as decimal(14,2)) as total_charge, coalesce(p.n, 0) > 0 as phi_detected from e left join c on c.doc_id = e.doc_id left join m on m.doc_id = e.doc_id left join p on p.doc_id = e.doc_id""")
def enriched_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = billing_texts(spark, sf_dir)
    found = detect.detected(texts, detect.PROCEDURES, detect.DIAGNOSES, detect.AMOUNTS, detect.IDENTIFIERS)
    bare = extract.records(texts).withColumn("cpt_codes", F.array().cast("array<string>")).withColumn("total_charge", F.lit(None).cast("decimal(14,2)"))
    return _codes_joined(extract.enriched(bare, found))


@query("select event_id as doc_id, true as ok, cast(json_extract_string(props, '$.k') as double) as k, 'a' || event_id as name, cast(event_id % 2 = 0 as boolean) as flag, array_to_string(['x', 'y'], '|') as tags from events")
def json_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    inner = F.regexp_extract("props", r"\d+", 0)
    raw = F.concat(F.lit("Here it is: {'k': "), inner, F.lit(", name: 'a"), F.col("event_id").cast("string"), F.lit("', 'flag': "), F.when(F.col("event_id") % 2 == 0, "True").otherwise("False"), F.lit(", 'tags': 'x, y',} done"))
    got = extract.recovered(e.select(F.col("event_id").alias("doc_id"), raw.alias("raw")))
    data = extract.projected(F.col("data"), {"k": "number", "name": "string", "flag": "boolean", "tags": "list"})
    return got.select("doc_id", "ok", data.alias("d")).select("doc_id", "ok", "d.k", "d.name", "d.flag", F.array_join("d.tags", "|").alias("tags"))


@query(f"with {DOC_SQL} select doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) as text from doc")
def text_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return billing_texts(spark, sf_dir).select("doc_id", trimmed_lines(F.col("text")).alias("text"))


@query("select o_orderkey, cast(case when o_orderkey % 3 = 0 then o_orderdate when o_orderkey % 3 = 1 then o_orderdate end as date) as day from orders")
def date_standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(day, "MM/dd/yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format(day, "yyyy-MM-dd")).otherwise("13/45/2024")
    return read_table(spark, sf_dir, "orders").select("o_orderkey", dates.standard_date(text, as_of()).alias("day"))


# --- similarity and merging -----------------------------------------------------------------------------------------------


def _ratio(a: str, b: str) -> str:
    return f"case when greatest(length(coalesce({a}, '')), length(coalesce({b}, ''))) = 0 then 1.0 else 1.0 - levenshtein(lower(coalesce({a}, '')), lower(coalesce({b}, ''))) / greatest(length(coalesce({a}, '')), length(coalesce({b}, '')))::double end"


def _page_similarity(literal: bool = False) -> str:
    x, y = ("concat_ws(' ', x.first_name, x.last_name)", "concat_ws(' ', y.first_name, y.last_name)")
    parts = [(0.4, f"{x} <> '' and {y} <> ''", _ratio(x, y)), (0.3, "x.date_of_birth is not null and y.date_of_birth is not null", "cast(x.date_of_birth = y.date_of_birth as integer)"), (0.3, "x.patient_id is not null and y.patient_id is not null", "cast(x.patient_id = y.patient_id as integer)")]
    top = " + ".join(f"case when {on} then {w}::double * ({s}) else 0.0::double end" for w, on, s in parts)
    base = " + ".join(f"case when {on} then {1.0 if literal else w}::double else 0.0::double end" for w, on, _ in parts)
    return f"round(({top}) / ({base}), 4)"


@query(f"with {PATIENT_SQL} select * from (select x.doc_id, x.page_no, x.idx as a, y.idx as b, {_page_similarity()} as similarity from pat x join pat y on x.doc_id = y.doc_id and x.page_no = y.page_no and x.idx < y.idx) where similarity > 0.8")
def dup_pairs_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.page_duplicates(patients(spark, sf_dir))


@query(f"with {PATIENT_SQL} select * from (select x.doc_id, x.page_no, x.idx as a, y.idx as b, {_page_similarity(True)} as similarity from pat x join pat y on x.doc_id = y.doc_id and x.page_no = y.page_no and x.idx < y.idx) where similarity > 0.3")
def dup_pairs_page_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.page_duplicates(patients(spark, sf_dir), 0.3, literal=True)


CROSS_SQL = f"select * from (select x.doc_id, x.page_no as page_a, x.idx as a, y.page_no as page_b, y.idx as b, {_page_similarity()} as similarity from pat x join pat y on x.doc_id = y.doc_id and x.page_no = y.page_no - 1) where similarity > 0.7"


@query(f"with {PATIENT_SQL} {CROSS_SQL}")
def dup_pairs_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.cross_page_pairs(patients(spark, sf_dir))


def _jaccard(a: str, b: str) -> str:
    return f"len(list_intersect(list_distinct({a}), list_distinct({b}))) / len(list_distinct(list_concat({a}, {b})))::double"


CODES_SQL = f"select * from (select x.doc_id, x.page_no as page_a, x.idx as a, y.page_no as page_b, y.idx as b, round(0.6::double * {_jaccard('x.cpt_codes', 'y.cpt_codes')} + 0.4::double * {_jaccard('x.icd10_codes', 'y.icd10_codes')}, 4) as similarity from pat x join pat y on x.doc_id = y.doc_id and x.page_no = y.page_no - 1) where similarity > 0.01"


@query(f"with {PATIENT_SQL} {CODES_SQL}")
def jaccard_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.code_pairs(patients(spark, sf_dir), 0.01)


@query(f"with {PATIENT_SQL}, c as ({CROSS_SQL}), j as ({CODES_SQL}) select * from c union all select * from j where not exists (select 1 from c where c.doc_id = j.doc_id and c.page_a = j.page_a and c.a = j.a and c.page_b = j.page_b and c.b = j.b)")
def pair_anti_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = patients(spark, sf_dir)
    return resolve.pair_union(resolve.cross_page_pairs(p), resolve.code_pairs(p, 0.01))


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = patients(spark, sf_dir)
    return resolve.cross_page_pairs(p).select("doc_id", (F.col("page_a") * 2 + F.col("a")).alias("a"), (F.col("page_b") * 2 + F.col("b")).alias("b"))


GROUP_SQL = f"""link as (select doc_id, page_a * 2 + a as a, page_b * 2 + b as b from ({CROSS_SQL})), both_ways as (select doc_id, a, b from link union select doc_id, b, a from link),
  reach as (select distinct doc_id, a as node, a as seen from both_ways union select r.doc_id, l.b, r.seen from reach r join both_ways l on l.doc_id = r.doc_id and l.a = r.node), grp as (select doc_id, node, min(seen) as "group" from reach group by doc_id, node)"""


@query(f"with recursive {PATIENT_SQL}, {GROUP_SQL} select * from grp")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.groups(_linked(spark, sf_dir))


@query()
def greedy_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.greedy_groups(_linked(spark, sf_dir))


@query(f"""with recursive {PATIENT_SQL}, {GROUP_SQL}, m as (select p.* exclude (node, charges), page_no * 2 + idx as node, g."group" from pat p join grp g on g.doc_id = p.doc_id and g.node = p.page_no * 2 + p.idx)
  select doc_id, "group", arg_min(node, (-confidence, node)) as node, first(first_name order by confidence desc, node) filter (first_name is not null) as first_name, first(last_name order by confidence desc, node) as last_name, first(patient_id order by confidence desc, node) filter (patient_id is not null) as patient_id,
  array_to_string(list_sort(list_distinct(flatten(list(cpt_codes)))), ',') as cpt_codes, array_to_string(list_sort(list_distinct(list(page_no))), ',') as pages, round(max(confidence), 4) as confidence from m group by doc_id, "group" """)
def merge_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = patients(spark, sf_dir).withColumn("node", F.col("page_no") * 2 + F.col("idx"))
    got = resolve.merged(p, resolve.groups(_linked(spark, sf_dir)))
    return got.select("doc_id", "group", "node", "first_name", "last_name", "patient_id", F.array_join(F.array_sort("cpt_codes"), ",").alias("cpt_codes"), F.array_join(F.transform("page_numbers", lambda x: x.cast("string")), ",").alias("pages"), F.round("confidence", 4).alias("confidence"))


@query()
def leader_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = patients(spark, sf_dir).withColumn("idx", F.col("page_no") * 2 + F.col("idx"))
    return resolve.merged_by_completeness(p, resolve.leaders(p))


@query()
def matching_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matching-blocks ratio of neighbouring readings."""
    r = readings(spark, sf_dir)
    x, y = r.where("ord = 0").alias("x"), r.where("ord = 1").alias("y")
    return x.join(y, "image_id").select("image_id", F.round(resolve.matching_ratio(F.col("x.text"), F.col("y.text")), 6).alias("ratio"))


# --- readings --------------------------------------------------------------------------------------------------------------


@query(f"with {READING_SQL} select image_id, ord, model, round(confidence / sum(confidence) over (partition by image_id), 6) as weight from reading")
def ensemble_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble.weights(readings(spark, sf_dir)).select("image_id", "ord", "model", F.round("weight", 6).alias("weight"))


@query(f"""with {READING_SQL}, w as (select *, confidence / sum(confidence) over (partition by image_id) as weight from reading), s as (select x.image_id, x.ord, x.model, x.text, round(sum(({_ratio('x.text', 'y.text')}) * y.weight), 6) as score from w x join w y on x.image_id = y.image_id group by all),
  b as (select *, row_number() over (partition by image_id order by score desc, ord) as r from s) select b.image_id, model, text, round(score, 4) as score, c.confidence, c.seconds from b join (select image_id, round(sum(confidence * weight), 4) as confidence, round(avg(seconds), 4) as seconds from w group by 1) c on c.image_id = b.image_id where r = 1""")
def consensus_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble.consensus(readings(spark, sf_dir)).withColumn("score", F.round("score", 4))


@query(f"with {READING_SQL}, v as (select *, avg(confidence) over (partition by image_id, text) as key from reading) select image_id, ord, model, text, round(confidence, 4) as confidence from (select *, row_number() over (partition by image_id order by key desc, ord) as r from v) where r = 1")
def ensemble_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble.best_reading(readings(spark, sf_dir), "vote").select("image_id", "ord", "model", "text", F.round("confidence", 4).alias("confidence"))


@query(f"with {READING_SQL} select image_id, ord, model, text from (select *, row_number() over (partition by image_id order by length(text) desc, ord) as r from reading) where r = 1")
def ensemble_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble.best_reading(readings(spark, sf_dir), "length").select("image_id", "ord", "model", "text")


@query()
def reading_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble.passed(ensemble.scored(readings(spark, sf_dir)), 0.3).select("image_id", "ord", F.round("quality.total", 4).alias("total"), "needs_retry")


@query(f"with {READING_SQL} select image_id, count(*) filter (length(text) > 0) as n, case when count(*) filter (length(text) > 0) >= 2 then 'consensus' when count(*) filter (length(text) > 0) > 0 then 'best' else 'ensemble_failed' end as status from reading group by image_id")
def ensemble_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble.with_minimum(readings(spark, sf_dir))


@query(f"with {DOC_SQL} select doc_id, round(cast(least(0.95, (0.7 + least(0.2, 0.03 * {count_in('lower(text)', C.OCR_INDICATORS)})) * case when length(trim(text)) < 50 then 0.8 else 1.0 end) as double), 4) as indicators, round(cast(least(0.95, 0.6 + least(0.3, length(text) / 1000) + least(0.1, 0.02 * (cast(contains(text, chr(10)) as integer) + cast(contains(text, chr(9)) as integer) + {count_in('text', C.LAYOUT_INDICATORS[2:])}))) as double), 4) as layout from doc")
def reading_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return billing_texts(spark, sf_dir).select("doc_id", F.round(scores.ocr_indicators(F.col("text")), 4).alias("indicators"), F.round(scores.ocr_length(F.col("text")), 4).alias("layout"))


# --- reports ---------------------------------------------------------------------------------------------------------------

METRICS_SQL = "select model, count(*) as files_processed, round(avg(case when patients > 0 then 100.0::double else 0.0 end), 1) as success_rate, round(avg(seconds), 3) as avg_time, round(min(seconds), 3) as min_time, round(max(seconds), 3) as max_time, round(avg(confidence), 3) as avg_confidence, cast(sum(patients) as bigint) as total_patients, round(sum(patients) / count(*), 2) as patients_per_file from run group by model"


@query(f"with {RUN_SQL} {METRICS_SQL}")
def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.model_metrics(runs(spark, sf_dir))


@query(f"with {RUN_SQL} select model, round(avg(cpt_codes), 2) as avg_cpt_codes, round(avg(completeness), 1) as avg_completeness, round(avg(with_names) / greatest(avg(patients), 1.0) * 100, 1) as name_rate, round(avg(with_financial) / greatest(avg(patients), 1.0) * 100, 1) as financial_rate from run where patients > 0 group by model")
def success_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.success_metrics(runs(spark, sf_dir))


@query(f"with {RUN_SQL}, m as ({METRICS_SQL}) select model, cast(row_number() over (order by avg_time, model) as integer) as speed_rank, cast(row_number() over (order by avg_confidence desc, model) as integer) as confidence_rank, cast(row_number() over (order by total_patients desc, model) as integer) as patients_rank from m")
def model_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.rankings(report.model_metrics(runs(spark, sf_dir)))


@query(f"with {RUN_SQL}, m as ({METRICS_SQL}), a as (select model, round(avg(completeness), 1) as avg_completeness from run where patients > 0 group by model), s as (select m.model, round(0.2 * greatest(0.0, 100 - 10 * avg_time) + 30 * avg_confidence + 0.2 * success_rate + 0.15 * least(100.0, 10.0 * total_patients) + 0.15 * avg_completeness, 4) as score from m join a on a.model = m.model) select model, round(score, 2) as score, cast(row_number() over (order by score desc, model) as integer) as rank from s")
def model_rank_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir)
    both = report.model_metrics(r).join(report.success_metrics(r).select("model", "avg_completeness"), "model")
    return report.composite(both).withColumn("score", F.round("score", 2))


@query(f"with {RUN_SQL}, m as ({METRICS_SQL}) select arg_min(model, (avg_time, model)) as speed, arg_min(model, (-avg_confidence, model)) as accuracy, arg_min(model, (-total_patients, model)) as extraction from m")
def model_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.recommendations(report.model_metrics(runs(spark, sf_dir)))


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query(f"with {RUN_SQL} select file, " + ", ".join(f"arg_min(seconds, ord) filter (model = '{m}') as \"{m}\"" for m in EVENT_TYPES) + " from run group by file")
def file_model_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.file_model_matrix(runs(spark, sf_dir), EVENT_TYPES)


@query(f"with {RUN_SQL} select count(*) as total, count(*) filter (patients > 0) as successful, round(avg(cast(patients > 0 as integer)) * 100, 2) as success_rate, round(avg(seconds), 4) as avg_time, round(avg(confidence) filter (patients > 0), 4) as avg_confidence, cast(sum(patients) as bigint) as patients, count(distinct file) as files, count(distinct model) as models from run")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.batch_summary(runs(spark, sf_dir))


COMPLETE = "(cast(coalesce(first_name, '') <> '' as integer) + cast(coalesce(last_name, '') <> '' as integer) + cast(coalesce(patient_id, '') <> '' as integer) + 3 + cast(len(cpt_codes) > 0 as integer) + cast(len(icd10_codes) > 0 as integer)) * 12.5"


@query(f"with {PATIENT_SQL} select doc_id, count(*) as patients, cast(sum(len(cpt_codes)) as bigint) as total_cpt_codes, cast(sum(len(icd10_codes)) as bigint) as total_icd10_codes, count(*) as patients_with_names, count(*) as patients_with_dob, count(patient_id) as patients_with_id, count(*) as patients_with_service, count(*) as patients_with_financial, round(avg({COMPLETE}), 2) as completeness from pat group by doc_id")
def file_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.file_metrics(patients(spark, sf_dir))


@query(f"with {CODED_SQL}, d as (select distinct o_orderkey // 8 as doc_id from orders union select -1) select d.doc_id, coalesce(idx + 1, 0) as patient_index, coalesce(first_name is not null or last_name is not null, false) and c.doc_id is not null as has_name, date_of_birth is not null as has_dob, coalesce(len(cpt) > 0, false) as has_cpt_codes, coalesce(len(icd) > 0, false) as has_icd10_codes from d left join cod c on c.doc_id = d.doc_id")
def summary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "orders").select(F.expr("o_orderkey div 8").alias("doc_id")).distinct().union(spark.range(1).selectExpr("cast(-1 as bigint)"))
    return report.summary_rows(documents, coded(spark, sf_dir).withColumnRenamed("idx", "patient_index"))


@query("select event_type as engine, cast(json_extract(props, '$.k') as integer) % 7 as error_type, count(*) as errors from events group by all")
def error_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").select(F.col("event_type").alias("engine"), (F.get_json_object("props", "$.k").cast("int") % 7).alias("error_type"))
    return report.error_counts(e)


@query("select user_id as host, round(case when s > 0 then (l - f) / s else 0.0 end, 4) as mb_per_second, case when s > 0 then round((l - f) / s, 4) else 0.0 end > 10 as growing from (select user_id, arg_min(value, ts) as f, arg_max(value, ts) as l, epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))) as s from events group by 1)")
def memory_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.memory_growth(read_table(spark, sf_dir, "events").select(F.col("user_id").alias("host"), F.col("value").alias("mb"), "ts"))


@query("select c.c_custkey as file, m.model from customer c cross join (values ('alpha'), ('beta'), ('gamma')) m(model)")
def files_by_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file"))
    return report.all_runs(files, spark.createDataFrame([("alpha",), ("beta",), ("gamma",)], "model string"))


# --- privacy and arithmetic ---------------------------------------------------------------------------------------------------


def _token(x: str, size: int, digits: int, head: str) -> str:
    return f"'{head}' || lpad(cast(('0x' || substr(md5({x}), 1, 8))::bigint % {size} as varchar), {digits}, '0')"


@query(f"""with {PATIENT_SQL} select node, {_token('first_name', 10000, 4, 'Patient_')} as first_name, 'Anonymous' as last_name, {_token('patient_id', 100000, 5, 'ID_')} as patient_id,
  case when patient_id is not null then date_of_birth + cast(('0x' || substr(md5(patient_id), 1, 8))::bigint % 61 - 30 as integer) end as date_of_birth, true as is_anonymized from pat""")
def anonymize_patient(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = patients(spark, sf_dir).select("node", "first_name", "last_name", "patient_id", "date_of_birth")
    return anonymize.anonymized(p, dates=True)


@query("select c_custkey, '(' || substr(d, 1, 3) || ') XXX-XXXX' as phone, 'XXX ' || substr(c_mktsegment, 1, 3) || '*** St' as address from (select *, cast(5550000000 + c_custkey as varchar) as d from customer)")
def mask_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    return c.select("c_custkey", privacy.mask_phone((F.lit(5550000000) + F.col("c_custkey")).cast("string")).alias("phone"), privacy.mask_address(F.concat(F.col("c_custkey").cast("string"), F.lit("a "), F.col("c_mktsegment"), F.lit(" St"))).alias("address"))


@query("select event_id, round(0.3 * value / 100 + 0.7 * (event_id % 10) / 10, 6) as overall, greatest(100, cast(floor((event_id % 900) * 700 * 0.0013 * 0.5) as integer)) as tokens from events")
def overall_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    k = F.col("event_id")
    return e.select("event_id", F.round(scores.overall(F.col("value") / 100, (k % 10) / 10), 6).alias("overall"), scores.estimated_tokens(k % 900, F.lit(700), 0.0013, F.lit(None).cast("double")).alias("tokens"))


@query("""with b as (select event_id, event_id % 50 as x1, event_id % 40 as y1, event_id % 50 + 30 as x2, event_id % 40 + 30 as y2 from events), i as (select *, greatest(0, least(x2, 60) - greatest(x1, 20)) * greatest(0, least(y2, 50) - greatest(y1, 10)) as s from b)
  select event_id, round(s / (900 + 1600 - s), 6) as iou from i""")
def iou_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    box = F.struct((k % 50).alias("x1"), (k % 40).alias("y1"), (k % 50 + 30).alias("x2"), (k % 40 + 30).alias("y2"))
    fixed = F.struct(F.lit(20).alias("x1"), F.lit(10).alias("y1"), F.lit(60).alias("x2"), F.lit(50).alias("y2"))
    return read_table(spark, sf_dir, "events").select("event_id", F.round(scores.iou(box, fixed), 6).alias("iou"))


@query(f"with {PATIENT_SQL} select node, round((1 + cast(first_name is not null as integer) + cast(patient_id is not null as integer) + 2) / 5 * 0.75, 6) as coverage from pat")
def schema_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [F.col(c) for c in ("first_name", "last_name", "patient_id", "date_of_birth", "total_charge")]
    return patients(spark, sf_dir).select("node", F.round(scores.schema_coverage(fields, 5), 6).alias("coverage"))


# --- composed operators ---------------------------------------------------------------------------------------------------------


def _mixed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Billing texts, of which every seventh has only dates that the record extractor does not read."""
    plain = F.concat(F.lit("birth on 19"), (50 + F.col("doc_id") % 40).cast("string"), F.lit("-03-04"), F.repeat(F.lit(" x"), 60), F.lit(" visit on 2020-01-05"))
    return billing_texts(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 7 == 0, plain).otherwise(F.col("text")))


RECORD_SQL = f"""x as (select doc_id, regexp_extract_all(text, '{extract.NAME_FIELD}', 1) as names, regexp_extract_all(text, '{extract.ANY_DATE}', 1) as ds, regexp_extract_all(text, '{extract.FIVE_DIGITS}', 1) as cpt, regexp_extract_all(text, '{extract.ICD_WHOLE}', 1) as icd,
  regexp_extract_all(text, '{extract.AMOUNT.replace(chr(92) + '$', '[$]')}', 1) as am from doc where doc_id % 7 <> 0)"""


@query(f"""with {DOC_SQL}, {RECORD_SQL}, f as (select doc_id, bool_or(field_type in ('ssn', 'phone', 'email', 'name')) as phi from ({ID_SQL} union all {NAME_SQL}) group by doc_id)
  select x.doc_id, string_split(names[1], ' ')[1] as first_name, case when len(string_split(names[1], ' ')) >= 2 then array_to_string(string_split(names[1], ' ')[2:], ' ') else 'Patient' end as last_name, strftime(strptime(ds[1], '%m/%d/%Y'), '%Y-%m-%d') as date_of_birth, strftime(strptime(ds[2], '%m/%d/%Y'), '%Y-%m-%d') as date_of_service,
  strptime(ds[1], '%m/%d/%Y') <= strptime(ds[2], '%m/%d/%Y') and strptime(ds[1], '%m/%d/%Y') <= date '{AS_OF}' and strptime(ds[2], '%m/%d/%Y') <= date '{AS_OF}' as consistent, array_to_string(cpt, ',') as cpt_codes, array_to_string(icd, ',') as icd10_codes, cast(replace(am[1], ',', '') as decimal(14,2)) as total_charge, coalesce(phi, false) as phi_detected, 0.8::double as extraction_confidence, 'primary' as source from x left join f on f.doc_id = x.doc_id
  union all select doc_id, 'Unknown', 'Patient', '19' || (50 + doc_id % 40) || '-03-04', '2020-01-05', true, '', '', null, false, 0.6::double, 'fallback' from doc where doc_id % 7 = 0""")
def extracted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _mixed_texts(spark, sf_dir)
    found = detect.detected(texts, detect.PROCEDURES, detect.DIAGNOSES, detect.DATES, detect.AMOUNTS, detect.IDENTIFIERS, detect.NAMES, as_of=as_of())
    got = extract.extracted(texts, found, as_of())
    return got.withColumn("cpt_codes", F.array_join("cpt_codes", ",")).withColumn("icd10_codes", F.array_join("icd10_codes", ","))


@query(f"""with {DOC_SQL}, h as (select * from {hits(extract.LISTED_DATES[0])}), d as (select doc_id, strftime(try_strptime(value, '%m/%d/%Y'), '%Y-%m-%d') as iso, min(start) as spot from h where try_strptime(value, '%m/%d/%Y') is not null group by 1, 2)
  select doc.doc_id, coalesce(string_agg(iso, ',' order by spot), '') as dates from doc left join d on d.doc_id = doc.doc_id group by doc.doc_id""")
def date_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.listed_dates(billing_texts(spark, sf_dir), as_of()).withColumn("dates", F.array_join("dates", ","))


@query("""select c_custkey as doc_id, c_name as first_name, '' as last_name, 'P-' || c_custkey as patient_id, case when c_custkey % 4 = 0 then null else 'Street ' || c_custkey || ', Town' || case when c_custkey % 3 = 0 then ', OR 97301' else ',  97301' end end as address, c_mktsegment as insurance_provider,
  case when c_custkey % 5 = 0 then 'S' || c_custkey else 'N' || c_custkey end as insurance_id, 0.8::double as extraction_confidence from customer""")
def structured_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    key, some = F.col("c_custkey"), F.col("c_custkey") % 4 != 0
    state = F.when(key % 3 == 0, "OR")
    address = F.struct(*(F.when(some, x).alias(n) for n, x in (("street", F.concat(F.lit("Street "), key.cast("string"))), ("city", F.lit("Town")), ("state", state), ("zip_code", F.lit("97301")))))
    person = F.struct(F.col("c_name").alias("first_name"), F.lit(None).cast("string").alias("last_name"), F.concat(F.lit("P-"), key.cast("string")).alias("patient_id"), address.alias("address"))
    insurance = F.struct(F.col("c_mktsegment").alias("insurance_company"), F.when(key % 5 == 0, "").otherwise(F.concat(F.lit("N"), key.cast("string"))).alias("policy_number"), F.concat(F.lit("S"), key.cast("string")).alias("subscriber_id"))
    return extract.structured_patient(c.select(key.alias("doc_id"), person.alias("patient_info"), insurance.alias("insurance_info")))


CPT_PROBLEM = "case when not regexp_full_match(code, '[0-9]{5}') then 'Invalid CPT code format (must be 5 digits)' when cast(code as integer) < 100 then 'CPT code out of valid range' when code not in (" + ", ".join(f"'{k}'" for k in C.CPT_CODES) + f") and {CATEGORY_SQL} is null then 'Unknown CPT code' end"
ICD_PROBLEM = "case when code not in (" + ", ".join(f"'{k}'" for k in C.ICD_CODES) + f") and {CHAPTER_SQL} is null then 'Unknown ICD-10 code format' end"


@query(f"""with {PATIENT_SQL}, p as (select *, case when node % 9 = 0 then [] else cpt_codes end as cpt, case when node % 9 = 0 then [] else icd10_codes end as icd, case when date_of_birth > date '{AS_OF}' then 'Date of birth cannot be in the future' when year(date_of_birth) < 1900 then 'Date of birth too far in the past' end as bp,
  case when date_of_service < date '{AS_OF}' - interval 120 month then 'Service date too far in the past' when date_of_service < date_of_birth then 'Service date cannot be before date of birth' end as sp from pat),
  e as (select node, cpt, icd, list_concat(list_filter(list_transform(cpt, lambda code: 'Invalid CPT code: ' || code || ' - ' || {CPT_PROBLEM}), lambda x: x is not null), list_concat(list_filter(list_transform(icd, lambda code: 'Invalid ICD-10 code: ' || code || ' - ' || {ICD_PROBLEM}), lambda x: x is not null),
  list_filter(['Date of birth validation failed: ' || bp, 'Service date validation failed: ' || sp], lambda x: x is not null))) as errors from p)
  select node, array_to_string(errors, '; ') as errors, case when len(cpt) = 0 and len(icd) = 0 then 'No medical codes (CPT or ICD-10) found' else '' end as warnings, len(errors) = 0 as overall_valid from e""")
def validation_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = patients(spark, sf_dir)
    p = reduce(lambda df, c: df.withColumn(c, F.when(F.col("node") % 9 == 0, F.slice(c, 1, 0)).otherwise(F.col(c))), ["cpt_codes", "icd10_codes"], p)
    return validate.validation_report(p, as_of()).select("node", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"), "overall_valid")


OPT_PAIRS = f"""c as ({CROSS_SQL}), j as ({CODES_SQL.replace('similarity > 0.01', 'similarity > 0.02')}), extra as (select * from j where not exists (select 1 from c where c.doc_id = j.doc_id and c.page_a = j.page_a and c.a = j.a and c.page_b = j.page_b and c.b = j.b)),
  link as (select doc_id, page_a * 65536 + a as a, page_b * 65536 + b as b from (select * from c union all select * from extra) where doc_id in (select doc_id from extra)), both_ways as (select doc_id, a, b from link union select doc_id, b, a from link),
  reach as (select distinct doc_id, a as node, a as seen from both_ways union select r.doc_id, l.b, r.seen from reach r join both_ways l on l.doc_id = r.doc_id and l.a = r.node), grp as (select doc_id, node, min(seen) as g from reach group by doc_id, node)"""


@query(f"""with recursive {PATIENT_SQL}, {OPT_PAIRS}, p as (select pat.* exclude (node), pat.page_no * 65536 + pat.idx as node from pat), m as (select p.*, coalesce(grp.g, p.node) as g from p left join grp on grp.doc_id = p.doc_id and grp.node = p.node)
  select doc_id, cast(arg_min(node, (-confidence, node)) // 65536 as integer) as page_no, cast(arg_min(node, (-confidence, node)) % 65536 as integer) as idx, first(first_name order by confidence desc, node) filter (first_name is not null) as first_name, first(last_name order by confidence desc, node) as last_name,
  array_to_string(list_sort(list_distinct(flatten(list(cpt_codes)))), ',') as cpt_codes, array_to_string(list_sort(list_distinct(list(page_no))), ',') as pages, round(max(confidence), 4) as confidence, count(distinct page_no) > 1 as spans_multiple_pages from m group by doc_id, g""")
def optimised_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = resolve.optimised(patients(spark, sf_dir), least_codes=0.02)
    pages = F.array_join(F.transform("page_numbers", lambda x: x.cast("string")), ",").alias("pages")
    return got.select("doc_id", "page_no", "idx", "first_name", "last_name", F.array_join(F.array_distinct(F.array_sort("cpt_codes")), ",").alias("cpt_codes"), pages, F.round("confidence", 4).alias("confidence"), "spans_multiple_pages")


def _values(text: str) -> str:
    return "list_filter(list_transform(" + "list_concat(" * 3 + f"regexp_extract_all({text}, '{segment.PERSON_VALUES[0]}', 1)" + "".join(f", regexp_extract_all({text}, '{p}', 1))" for p in segment.PERSON_VALUES[1:]) + ", lambda x: trim(x)), lambda x: x <> '')"


@query(f"""with {DOC_SQL}, h as (select doc_id, start, substr(text, greatest(start - 200, 0) + 1, least(start, 200)) as b, substr(text, stop + 1, 200) as a from {hits('-{40}')}), v as (select doc_id, start, {_values('b')} as bs, {_values('a')} as vs, a from h)
  select doc_id, start, len(list_filter(bs, lambda x: len(list_filter(vs, lambda y: 1.0 - levenshtein(x, y) / greatest(length(x), length(y))::double < 0.7)) > 0)) > 0 or """ + " or ".join(f"regexp_matches(a, '{p}')" for p in segment.NEW_PERSON) + " as other_person from v")
def context_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.found(billing_texts(spark, sf_dir), "-{40}")
    text, start = F.col("text"), F.col("start")
    before = F.substring(text, F.greatest(start - 200, F.lit(0)) + 1, F.least(start, F.lit(200)))
    return found.select("doc_id", "start", segment.different_people(before, F.substring(text, F.col("end") + 1, F.lit(200))).alias("other_person"))


@query(f"""with {DOC_SQL}, k as (select f.doc_id, b, text from {folded_sql('b[1].start - acc[-1].start <= 100', BOUNDS_SQL)} f join doc on doc.doc_id = f.doc_id),
  w as (select doc_id, b.start as start, b.kind as kind, b.confidence as confidence from k where not (regexp_matches(substr(text, greatest(b.start - 50, 0) + 1, least(b.start, 50)), ':\\s*$') and regexp_matches(substr(text, b.start + 1, 50), '^\\s*[A-Za-z0-9]'))),
  t as (select *, row_number() over (partition by doc_id order by confidence desc, start) as rank from w) select doc_id, cast(row_number() over (partition by doc_id order by start) - 1 as integer) as idx, start, kind, confidence from t where rank <= 10""")
def boundary_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = billing_texts(spark, sf_dir)
    return segment.sifted_again(segment.boundaries(texts), texts)


@query(f"with {RUN_SQL} select model as model_name, file as file_name, seconds as extraction_time, confidence, patients as patient_count, text_length, cpt_codes as cpt_codes_extracted, completeness as data_completeness_score, ts as timestamp from run")
def dashboard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.dashboard_rows(runs(spark, sf_dir))


@query(f"with {PATIENT_SQL}, d as (select distinct doc_id from pat union select -1), r as (select doc_id, avg(case when doc_id % 6 = 0 then null else confidence end) as mean from pat group by doc_id) select d.doc_id, round(case when r.doc_id is null then 0.0 else coalesce(mean, 0.5) end, 4) as confidence from d left join r on r.doc_id = d.doc_id")
def document_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = patients(spark, sf_dir).withColumn("confidence", F.when(F.col("doc_id") % 6 != 0, F.col("confidence")))
    documents = p.select("doc_id").distinct().union(spark.range(1).selectExpr("cast(-1 as bigint)"))
    return report.document_confidence(documents, p).withColumn("confidence", F.round("confidence", 4))


@query(f"with {PATIENT_SQL} select count(*) as patients, cast(sum(len(cpt_codes)) as bigint) as total_cpt_codes, cast(sum(len(icd10_codes)) as bigint) as total_icd10_codes, cast(sum(total_charge) as double) as total_charges, count(*) filter (node % 3 = 0) as multi_page_patients from pat")
def export_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = F.when(F.col("node") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return report.export_counts(patients(spark, sf_dir).withColumn("page_numbers", pages)).withColumn("total_charges", F.col("total_charges").cast("double"))


@query(f"with {PATIENT_SQL} select doc_id, page_no, string_agg(cast(node as varchar), ',' order by idx, node) as nodes from pat group by all")
def patients_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.patients_by_page(patients(spark, sf_dir)).withColumn("nodes", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ","))


@query(f"with {READING_SQL} select image_id, arg_min(text, (-confidence, ord)) as text, round(max(confidence), 4) as confidence, 'weighted_combination' as model from reading group by image_id")
def ensemble_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble.combined(readings(spark, sf_dir)).withColumn("confidence", F.round("confidence", 4))


@query(f"with {PATIENT_SQL} select doc_id, cast(row_number() over (partition by doc_id order by page_no, idx, node) - 1 as integer) as patient_index, node, last_name from pat where doc_id % 4 <> 0")
def exported_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("page_no", "idx", "node", "last_name")))
    results = patients(spark, sf_dir).groupBy("doc_id").agg(F.transform(listed, lambda x: F.struct(x["node"].alias("node"), x["last_name"].alias("last_name"))).alias("patients"))
    return export.patients_only(results.withColumn("success", F.col("doc_id") % 4 != 0))


@query(f"with {PATIENT_SQL} select node, round((cast(coalesce(first_name, '') <> '' as integer) + 3 + cast(patient_id is not null as integer) + cast(len(cpt_codes) > 0 as integer) + cast(len(icd10_codes) > 0 as integer) + case when node % 2 = 0 then 1 + cast(node % 4 = 0 as integer) else 0 end) / (7 + case when node % 2 = 0 then 2 else 0 end)::double, 4) as share from pat")
def filled_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = F.struct(F.col("date_of_service").alias("service_date"), F.when(F.col("node") % 4 == 0, "office").alias("place"))
    p = patients(spark, sf_dir).withColumn("service_info", F.when(F.col("node") % 2 == 0, inner))
    share = report.filled_share(["first_name", "last_name", "date_of_birth", "gender", "patient_id"], ["cpt_codes", "icd10_codes"], ["service_info"], p.schema)
    return p.select("node", F.round(share, 4).alias("share"))


@query("select o_orderkey, case when o_orderkey % 6 = 5 then 'type not allowed' when o_orderkey % 150 > 100 then 'too many pages' when greatest(o_orderkey % 5000, 500) > 4096 then 'image too large' when o_totalprice > 10 * (o_orderkey % 5000) * 500 then 'more bytes than pixels allow' end as problem from orders")
def upload_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    from billweave.sources.files import upload_problem

    o, key = read_table(spark, sf_dir, "orders"), F.col("o_orderkey")
    mime = F.when(key % 6 == 5, "text/html").otherwise("image/png")
    return o.select("o_orderkey", upload_problem(mime, key % 150, key % 5000, F.lit(500), F.col("o_totalprice")).alias("problem"))


#: Forms of two pages about customers: none, one or two lines of dashes, so that some texts have sure boundaries.
FORM_SQL = """(select c_custkey as doc_id, 'PATIENT INFORMATION' || chr(10) || 'Name: ' || c_mktsegment || chr(10) || 'DOB: 01/02/1980' || chr(10) || 'MRN: M' || c_custkey || chr(10)
  || repeat(repeat('-', 12) || chr(10) || repeat('x ', 80) || chr(10), cast(c_custkey % 3 as integer)) || '--- PAGE BREAK ---' || chr(10) || case when c_custkey % 4 = 0 then 'Patient Information' else 'Continued' end || chr(10)
  || repeat('of no note ', cast(c_custkey % 30 as integer)) || 'MRN: M' || (c_custkey + c_custkey % 2 * 5000) || chr(10) || 'Sex: F' || chr(10) || 'Phone: 555-1234' as text from customer)"""
EXTRA_SQL = f"""select doc_id, start, 6 as method, start as ord, 0.7::double as confidence, 'page_break' as kind from (select doc_id, start, substr(text, greatest(start - 200, 0) + 1, least(start, 200)) as b, substr(text, stop + 1, 200) as a from {hits(C.BROKEN_PAGE, "weak")})
  where len(list_filter({_values("b")}, lambda x: len(list_filter({_values("a")}, lambda y: 1.0 - levenshtein(x, y) / greatest(length(x), length(y))::double < 0.7)) > 0)) > 0 or """ + " or ".join(f"regexp_matches(a, '{p}')" for p in segment.NEW_PERSON)
EXTRA_SQL += "".join(f" union all select doc_id, start, 7, {k}, case when regexp_matches({around(100)}, '(?i)\\b(?:{'|'.join(C.BOUNDARY_KEYWORDS)})\\b') then 0.85 else 0.7 end, 'form_structure' from (select *, count(*) over (partition by doc_id) as many from {hits(p, 'weak')}) where many > 1" for k, p in enumerate(C.FORM_HEADERS))
FIELD_SQL = " union all ".join(f"select doc_id, {k} as k, start, stop from {hits(p, 'weak')}" for k, p in enumerate(C.PERSON_FIELDS))
EXTRA_SQL += f""" union all select doc_id, min(start), 8, min(start), 0.8, 'text_block' from (select *, sum(fresh) over (partition by doc_id order by start, stop, k) as block
  from (select *, case when start - lag(stop) over (partition by doc_id order by start, stop, k) >= 200 then 1 else 0 end as fresh from ({FIELD_SQL}))) group by doc_id, block having count(*) >= 3"""


@query(f"""with doc as {FORM_SQL}, rules as (select doc_id, cast(row_number() over (partition by doc_id order by start) - 1 as integer) as idx, start, 'form_structure' as kind, 0.6::double as confidence from {hits('-{10,}')}),
  sure as (select doc_id from rules group by doc_id having count(*) > 1), weak as (select doc_id, text from doc where doc_id not in (select doc_id from sure)),
  every as (select doc_id, start, -1 as method, idx as ord, confidence, kind from rules where doc_id not in (select doc_id from sure) union all {EXTRA_SQL}), k as (select f.doc_id, b, text from {folded_sql('b[1].start - acc[-1].start <= 100', 'select * from every')} f join doc on doc.doc_id = f.doc_id),
  w as (select doc_id, b.start as start, b.kind as kind, b.confidence as confidence from k where not (regexp_matches(substr(text, greatest(b.start - 50, 0) + 1, least(b.start, 50)), ':\\s*$') and regexp_matches(substr(text, b.start + 1, 50), '^\\s*[A-Za-z0-9]'))),
  t as (select *, row_number() over (partition by doc_id order by confidence desc, start) as rank from w)
  select * from rules where doc_id in (select doc_id from sure) union all select doc_id, cast(row_number() over (partition by doc_id order by start) - 1 as integer) as idx, start, kind, confidence from t where rank <= 10""")
def boundary_enhanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over forms made from customers; the first look finds their lines of dashes."""
    key = F.col("c_custkey")
    rules = F.repeat(F.lit("-" * 12 + "\n" + "x " * 80 + "\n"), (key % 3).cast("int"))
    again = F.when(key % 4 == 0, "Patient Information").otherwise("Continued")
    other = F.concat(F.repeat(F.lit("of no note "), (key % 30).cast("int")), F.lit("MRN: M"), (key + key % 2 * 5000).cast("string"), F.lit("\nSex: F\nPhone: 555-1234"))
    text = F.concat(F.lit("PATIENT INFORMATION\nName: "), "c_mktsegment", F.lit("\nDOB: 01/02/1980\nMRN: M"), key.cast("string"), F.lit("\n"), rules, F.lit("--- PAGE BREAK ---\n"), again, F.lit("\n"), other)
    texts = read_table(spark, sf_dir, "customer").select(key.alias("doc_id"), text.alias("text"))
    return segment.enhanced(texts, segment.sifted(segment.rule_boundaries(texts)))


@query(f"""with {DOC_SQL}, c as (select doc_id, value as code, confidence as original_confidence from ({CPT_SQL})), k as (select doc_id, code, original_confidence, known, known_description, case when known is not null then known_category else {CATEGORY_SQL} end as category from c left join {CPT_DIM} on code = known)
  select doc_id, code, known is not null or category is not null as is_valid, case when known is not null then 'Valid CPT code' when category is not null then 'Valid CPT code format (category: ' || category || ')' else 'Unknown CPT code' end as message,
    case when known is not null or category is not null then code || '|' || case when known is not null then known_description else 'Description not available' end || '|' || category end as info, original_confidence from k""")
def code_validations(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.collect_list(F.struct(F.col("value").alias("code"), "confidence"))
    records = detect.procedures(billing_texts(spark, sf_dir)).groupBy("doc_id").agg(codes.alias("cpt_codes"))
    got = validate.code_validations(records, ("doc_id",), validate.cpt_table(spark))
    return got.select("doc_id", "code", "is_valid", "message", F.concat_ws("|", "code_info.code", "code_info.description", "code_info.category").alias("joined"), "code_info", "original_confidence").select("doc_id", "code", "is_valid", "message", F.when(F.col("code_info").isNotNull(), F.col("joined")).alias("info"), "original_confidence")


@query("""select c_custkey as doc_id, case when c_custkey % 7 <> 0 then c_name end as patient_name, case when c_custkey % 7 <> 0 and c_custkey % 3 = 0 then c_mktsegment end as phone, c_custkey % 7 <> 0 as ok from customer""")
def templated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first answer that is broken for some customers, and a second one that is for fewer."""
    c = read_table(spark, sf_dir, "customer")
    body = F.concat(F.lit("Here: {'patient_name': '"), "c_name", F.lit("', 'phone': "), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("'"), "c_mktsegment", F.lit("'"))).otherwise("None"), F.lit(", }"))
    tries = F.array(F.struct(F.lit(0).alias("attempt"), F.when(F.col("c_custkey") % 2 == 0, body).otherwise("{'patient_name': ").alias("raw")), F.struct(F.lit(1).alias("attempt"), F.when(F.col("c_custkey") % 7 != 0, body).otherwise("none").alias("raw")))
    broken = F.transform(tries, lambda t: F.struct(t["attempt"].alias("attempt"), F.when(F.col("c_custkey") % 7 == 0, "none").otherwise(t["raw"]).alias("raw")))
    answers = c.select(F.col("c_custkey").alias("doc_id"), F.inline(broken))
    return extract.templated(answers, "patient_demographics").select("doc_id", "data.patient_name", "data.phone", "ok")


@query(f"with {READING_SQL} select image_id, ord, model, text from reading where model <> 'beta'")
def available_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    engines = spark.createDataFrame([("alpha", True), ("beta", False), ("gamma", True)], "model string, loaded boolean")
    return ensemble.available(engines, readings(spark, sf_dir)).select("image_id", "ord", "model", "text")


@query("select c_custkey, case when c_name is not null then '[REDACTED]' end as first_name, case when c_mktsegment is not null then '[REDACTED]' end as phone from customer")
def redacted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("first_name"), F.col("c_mktsegment").alias("phone"))
    return anonymize.protected(records, "Redaction")
