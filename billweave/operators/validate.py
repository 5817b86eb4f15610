"""Validation: codes against tables and ranges, dates against each other, records against rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billweave.functions import constants as C
from billweave.functions.dates import age_years, full_years


def cpt_table(spark: SparkSession) -> DataFrame:
    """The built-in procedure table: code, description, category, active. Ten rows."""
    return spark.createDataFrame([(k, d, c, True) for k, (d, c) in C.CPT_CODES.items()], "code string, description string, category string, active boolean")


def icd_table(spark: SparkSession) -> DataFrame:
    """The built-in diagnosis table, eight rows."""
    return spark.createDataFrame([(k, d, c, True) for k, (d, c) in C.ICD_CODES.items()], "code string, description string, category string, active boolean")


def cpt_category(code: Column) -> Column:
    out, n = None, code.try_cast("int")
    for name, low, high in C.CPT_RANGES:
        test = n.between(low, high)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def icd_chapter(code: Column) -> Column:
    out, letter = None, F.substring(code, 1, 1)
    for letters, name in C.ICD_CHAPTERS.items():
        test = letter.isin(*letters)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def _known(codes: DataFrame, table: DataFrame, key: Column) -> DataFrame:
    names = table.select(F.col("code").alias("known_code"), F.col("description").alias("known_description"), F.col("category").alias("known_category"), F.col("active").alias("known_active"))
    return codes.withColumn("checked", key).join(F.broadcast(names) if table.count() <= 100_000 else names, F.col("checked") == F.col("known_code"), "left")


def validate_cpt(codes: DataFrame, table: DataFrame) -> DataFrame:
    """codes(code, ...) with is_valid, message, category and description."""
    got = _known(codes, table, F.col("code"))
    bad = ~F.coalesce(F.col("code").rlike(r"^\d{5}$"), F.lit(False))
    off = F.col("code").try_cast("int") < 100
    category = cpt_category(F.col("code"))
    known = F.col("known_code").isNotNull()
    message = F.when(bad, "Invalid CPT code format (must be 5 digits)").when(off, "CPT code out of valid range").when(known & ~F.col("known_active"), "CPT code is inactive/deprecated").when(known, "Valid CPT code").when(category.isNotNull(), F.concat(F.lit("Valid CPT code format (category: "), category, F.lit(")"))).otherwise("Unknown CPT code")
    return _validated(got, message, bad | off, known, category)


def validate_icd(codes: DataFrame, table: DataFrame) -> DataFrame:
    """The same for diagnosis codes, trimmed and in upper case."""
    code = F.upper(F.trim("code"))
    got = _known(codes, table, code)
    bad = ~F.coalesce(F.col("checked").rlike(r"^[A-Z]\d{2}(\.[A-Z0-9]{1,3})?$"), F.lit(False))
    chapter = icd_chapter(F.col("checked"))
    known = F.col("known_code").isNotNull()
    message = F.when(bad, "Invalid ICD-10 code format").when(known & ~F.col("known_active"), "ICD-10 code is inactive/deprecated").when(known, "Valid ICD-10 code").when(chapter.isNotNull(), F.concat(F.lit("Valid ICD-10 code format (category: "), chapter, F.lit(")"))).otherwise("Unknown ICD-10 code format")
    return _validated(got, message, bad, known, chapter)


def _validated(got: DataFrame, message: Column, bad: Column, known: Column, category: Column) -> DataFrame:
    description = F.when(bad, None).when(known, F.col("known_description")).when(category.isNotNull(), "Description not available")
    kind = F.when(bad, None).when(known, F.col("known_category")).otherwise(category)
    out = got.withColumn("message", message).withColumn("is_valid", F.col("message").startswith("Valid")).withColumn("category", kind).withColumn("description", description)
    return out.drop("checked", "known_code", "known_description", "known_category", "known_active")


def birth_date_problem(birth: Column, as_of: Column) -> Column:
    """A message, or null for a fine date of birth."""
    return F.when(birth > as_of, "Date of birth cannot be in the future").when(F.year(birth) < 1900, "Date of birth too far in the past").when(age_years(birth, as_of) > 150, "Age exceeds reasonable limit")


def service_date_problem(service: Column, birth: Column, as_of: Column) -> Column:
    return F.when(service > F.add_months(as_of, 12), "Service date too far in the future").when(service < F.add_months(as_of, -120), "Service date too far in the past").when(service < birth, "Service date cannot be before date of birth")


def date_range_problem(start: Column, end: Column) -> Column:
    return F.when(start > end, "Start date must be before end date").when(F.datediff(end, start) > 365, "Date range exceeds one year")


def date_consistency(birth: Column, service: Column, claim: Column, appointment: Column, as_of: Column) -> Column:
    """struct of booleans, null where a date is missing."""
    return F.struct(
        (birth < as_of).alias("birth_before_now"), (service <= as_of).alias("service_not_after_now"), (claim >= service).alias("claim_not_before_service"),
        (claim <= as_of).alias("claim_not_after_now"), appointment.isNotNull().alias("appointment_given"), (birth > F.date_sub(as_of, int(120 * 365.25))).alias("birth_within_120_years"),
    )


def valid_age(age: Column) -> Column:
    return F.coalesce(age.try_cast("int").between(0, 120), F.lit(False))


def record_errors(first: Column, last: Column, birth: Column, service: Column, cpt: Column, icd: Column, as_of: Column) -> Column:
    """Messages for a record: names, codes (arrays of strings), dates."""
    bad_cpt = F.filter(cpt, lambda c: ~(c.rlike(r"^\d{5}$") & F.coalesce(c.try_cast("int") >= 100, F.lit(False))))
    bad_icd = F.filter(icd, lambda c: ~c.rlike(r"^[A-Z]\d{2}(\.[A-Z0-9]{1,3})?$"))
    age = age_years(birth, service)
    checks = F.array(
        F.when((F.coalesce(first, F.lit("")) == "") & (F.coalesce(last, F.lit("")) == ""), "Missing patient name"),
        F.when(birth > as_of, "Date of birth in the future"),
        F.when((age < 0) | (age > 150), "Invalid age at service date"),
    )
    named = F.concat(F.transform(bad_cpt, lambda c: F.concat(F.lit("Invalid CPT code: "), c)), F.transform(bad_icd, lambda c: F.concat(F.lit("Invalid ICD-10 code: "), c)))
    return F.concat(F.filter(checks, lambda x: x.isNotNull()), named)


def mixed_record_issues(first: Column, last: Column, gender: Column, birth: Column, cpt: Column, icd: Column, as_of: Column) -> Column:
    """Signs that a record mixes several people."""

    def listed(prefixes: list[str], text: str, tail: str, on: Column) -> Column:
        hit = F.filter(cpt, lambda c: F.coalesce(on, F.lit(False)) & F.exists(F.array(*map(F.lit, prefixes)), lambda p: c.startswith(p)))
        return F.transform(hit, lambda c: F.concat(F.lit(f"Found {text} procedure code "), c, F.lit(f" for {tail}")))

    age = full_years(birth, as_of)
    counts = F.array(
        F.when(F.size(icd) > 12, F.concat(F.lit("Unusually high number of ICD-10 codes: "), F.size(icd).cast("string"))),
        F.when(F.size(cpt) > 15, F.concat(F.lit("Unusually high number of CPT codes: "), F.size(cpt).cast("string"))),
    )
    both = (F.coalesce(first, F.lit("")) != "") & (F.coalesce(last, F.lit("")) != "")
    people = F.array(
        F.when(both & (first.contains(";") | last.contains(";")), "Multiple names detected in name fields"),
        F.when(both & (first.contains(" and ") | first.contains(" & ")), "Possible multiple patients in first name field"),
        F.when(both & (last.contains(" and ") | last.contains(" & ")), "Possible multiple patients in last name field"),
    )
    present = [F.filter(x, lambda m: m.isNotNull()) for x in (counts, people)]
    sex = F.lower(gender)
    found = [
        listed(C.FEMALE_PREFIXES, "female-specific", "male patient", sex == "male"),
        listed(C.MALE_PREFIXES, "male-specific", "female patient", sex == "female"),
        listed(C.PEDIATRIC, "pediatric", "elderly patient", age > 65),
        listed(C.GERIATRIC, "geriatric", "young patient", age < 18),
    ]
    return F.concat(present[0], *found, present[1])


def cpt_problem(code: Column) -> Column:
    """What is wrong with a procedure code by its form and range, or null."""
    n = code.try_cast("int")
    return F.when(~F.coalesce(code.rlike(r"^\d{5}$"), F.lit(False)), "Invalid CPT code format (must be 5 digits)").when(n < 100, "CPT code out of valid range").when(~code.isin(*C.CPT_CODES) & cpt_category(code).isNull(), "Unknown CPT code")


def icd_problem(code: Column) -> Column:
    """The same for a diagnosis code, trimmed and in upper case."""
    plain = F.upper(F.trim(code))
    return F.when(~F.coalesce(plain.rlike(r"^[A-Z]\d{2}(\.[A-Z0-9]{1,3})?$"), F.lit(False)), "Invalid ICD-10 code format").when(~plain.isin(*C.ICD_CODES) & icd_chapter(plain).isNull(), "Unknown ICD-10 code format")


def validation_report(records: DataFrame, as_of: Column) -> DataFrame:
    """The records' other columns with errors, warnings (arrays) and overall_valid: codes one by one, both dates, and what
    is missing."""

    def wrong(kind: str, codes: str, problem) -> Column:
        named = F.transform(codes, lambda c: F.concat(F.lit(f"Invalid {kind} code: "), c, F.lit(" - "), problem(c)))
        return F.filter(F.coalesce(named, F.array().cast("array<string>")), lambda x: x.isNotNull())

    birth, service = F.col("date_of_birth"), F.col("date_of_service")
    dates = F.array(F.concat(F.lit("Date of birth validation failed: "), birth_date_problem(birth, as_of)), F.concat(F.lit("Service date validation failed: "), service_date_problem(service, birth, as_of)))
    errors = F.concat(wrong("CPT", "cpt_codes", cpt_problem), wrong("ICD-10", "icd10_codes", icd_problem), F.filter(dates, lambda x: x.isNotNull()))
    bare = (F.coalesce(F.size("cpt_codes"), F.lit(0)) <= 0) & (F.coalesce(F.size("icd10_codes"), F.lit(0)) <= 0)
    unnamed = (F.coalesce("first_name", F.lit("")) == "") & (F.coalesce("last_name", F.lit("")) == "")
    warnings = F.filter(F.array(F.when(bare, "No medical codes (CPT or ICD-10) found"), F.when(unnamed, "No patient name found")), lambda x: x.isNotNull())
    return records.withColumn("errors", errors).withColumn("warnings", warnings).withColumn("overall_valid", F.size("errors") == 0)


def code_validations(records: DataFrame, keys: tuple[str, ...], table: DataFrame, kind: str = "cpt") -> DataFrame:
    """keys, code, is_valid, message, code_info and original_confidence of every code of records: cpt_codes or icd10_codes,
    arrays of struct<code,confidence,...>. code_info is null for invalid codes."""
    check = validate_cpt if kind == "cpt" else validate_icd
    codes = records.select(*keys, F.explode("cpt_codes" if kind == "cpt" else "icd10_codes").alias("c")).select(*keys, F.col("c.code").alias("code"), F.col("c.confidence").alias("original_confidence"))
    info = F.when(F.col("is_valid"), F.struct("code", "description", "category"))
    return check(codes, table).select(*keys, "code", "is_valid", "message", info.alias("code_info"), "original_confidence")
