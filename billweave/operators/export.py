"""Exports: records flattened to rows, nested as JSON or XML, and written under a checked path.

Records have cpt_codes and icd10_codes as arrays of struct<code,description,charge,confidence> (diagnoses without charge).
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

BASE_TEXT = ["first_name", "last_name", "patient_id", "phone", "email", "address"]


def base_row(records: DataFrame) -> DataFrame:
    """Text fields with '' for null; dates as ISO strings; money stays null."""
    text = [F.coalesce(F.col(c), F.lit("")).alias(c) if c in BASE_TEXT else F.col(c) for c in records.columns if not c.startswith("date_")]
    days = [F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("")).alias(c) for c in records.columns if c.startswith("date_")]
    return records.select(*text, *days)


def _codes(kind: str, column: str) -> Column:
    return F.transform(column, lambda c: F.struct(F.lit(kind).alias("code_type"), c["code"].alias("medical_code"), c["description"].alias("code_description"), c["confidence"].alias("code_confidence")))


def code_rows(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row for each code, procedures first; a record without codes has one row."""
    return records.select(*keys, F.posexplode_outer(F.concat(_codes("CPT", "cpt_codes"), _codes("ICD-10", "icd10_codes"))).alias("pos", "c")).select(*keys, "pos", "c.*")


def code_summary(records: DataFrame, keys: Sequence[str], by: str = "; ") -> DataFrame:
    """A row for each record with its codes joined."""
    return records.select(*keys, *(F.array_join(F.transform(c, lambda x: x["code"]), by).alias(c) for c in ("cpt_codes", "icd10_codes")))


def procedure_rows(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row for each procedure, or one."""
    return records.select(*keys, F.explode_outer("cpt_codes").alias("c")).select(*keys, F.coalesce("c.code", F.lit("")).alias("cpt_code"), F.coalesce("c.description", F.lit("")).alias("cpt_description"), F.col("c.charge").alias("charge"))


def zipped_rows(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Procedures beside diagnoses, by place; the shorter list ends in '' and null; without codes one row."""
    longest = F.greatest(F.size("cpt_codes"), F.size("icd10_codes"), F.lit(1))
    each = records.select(*keys, "cpt_codes", "icd10_codes", F.explode(F.sequence(F.lit(0), longest - 1)).alias("row"))
    cpt, icd = F.get("cpt_codes", F.col("row")), F.get("icd10_codes", F.col("row"))
    return each.select(*keys, "row", F.coalesce(cpt["code"], F.lit("")).alias("cpt_code"), cpt["charge"].alias("cpt_charge"), F.coalesce(icd["code"], F.lit("")).alias("icd10_code"), F.coalesce(icd["description"], F.lit("")).alias("icd10_description"))


def patient_summary(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    return records.select(*keys, *(F.array_join(F.transform(c, lambda x: x["code"]), ", ").alias(c) for c in ("cpt_codes", "icd10_codes")), "total_charge", F.format_string("%.2f", F.coalesce("confidence", F.lit(0.0))).alias("confidence"))


def code_details(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Procedures with their charge or 0, diagnoses with ''."""
    cpt = records.select(*keys, F.inline(F.transform("cpt_codes", lambda c: F.struct(F.lit("CPT").alias("kind"), c["code"].alias("code"), F.coalesce(c["charge"].cast("string"), F.lit("0")).alias("charge")))))
    icd = records.select(*keys, F.inline(F.transform("icd10_codes", lambda c: F.struct(F.lit("ICD-10").alias("kind"), c["code"].alias("code"), F.lit("").alias("charge")))))
    return cpt.unionByName(icd)


def with_four_diagnoses(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row for each procedure, with the first four diagnoses in columns."""
    columns = [F.get(F.col("icd10_codes"), F.lit(k))[f].alias(f"diagnosis_{n}_{k + 1}") for n, f in (("code", "code"), ("desc", "description")) for k in range(4)]
    return records.select(*keys, F.explode_outer("cpt_codes").alias("c"), *columns).select(*keys, F.col("c.code").alias("cpt_code"), *(f"diagnosis_{n}_{k + 1}" for n in ("code", "desc") for k in range(4)))


def as_json(df: DataFrame, metadata: dict[str, str] | None = None) -> DataFrame:
    """One column, json; with metadata an envelope around the record."""
    body = F.struct(*df.columns)
    if metadata:
        body = F.struct(F.struct(*(F.lit(v).alias(k) for k, v in metadata.items())).alias("metadata"), body.alias("data"))
    return df.select(F.to_json(body).alias("json"))


def as_xml(df: DataFrame, row: str = "patient") -> DataFrame:
    return df.select(F.to_xml(F.struct(*df.columns), {"rowTag": row}).alias("xml"))


def result_xml(results: DataFrame, metadata: Sequence[str], confidences: Sequence[str], data: str) -> DataFrame:
    """One column, xml: Metadata, Confidences and StructuredData of each result; items of lists have their index, members
    that are null say null."""

    def told(c: Column, kind: DataType) -> Column:
        if isinstance(kind, StructType):
            return F.struct(*(told(c[f.name], f.dataType).alias(f.name) for f in kind.fields))
        if isinstance(kind, ArrayType):
            inner = kind.elementType

            def item(x: Column, i: Column) -> Column:
                index = i.cast("string").alias("_index")
                if isinstance(inner, StructType):
                    return F.struct(index, *(told(x[f.name], f.dataType).alias(f.name) for f in inner.fields))
                return F.struct(index, F.coalesce(x.cast("string"), F.lit("null")).alias("_VALUE"))

            return F.struct(F.transform(c, item).alias("item"))
        return F.coalesce(c.cast("string"), F.lit("null"))

    body = F.struct(
        F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("null")).alias(c) for c in metadata)).alias("Metadata"),
        F.struct(*(F.col(c).cast("string").alias(c) for c in confidences)).alias("Confidences"),
        told(F.col(data), results.schema[data].dataType).alias("StructuredData"),
    )
    return results.select(F.to_xml(body, {"rowTag": "ExtractionResults"}).alias("xml"))


def flattened(df: DataFrame, by: str = "_") -> DataFrame:
    """Leaves of nested structs as columns named by their path; arrays as JSON text."""

    def leaves(schema: StructType, path: tuple[str, ...]) -> list[Column]:
        out = []
        for f in schema.fields:
            here = (*path, f.name)
            column = F.col(".".join(f"`{p}`" for p in here))
            if isinstance(f.dataType, StructType):
                out += leaves(f.dataType, here)
            else:
                out.append((F.to_json(column) if isinstance(f.dataType, ArrayType) else column).alias(by.join(here)))
        return out

    return df.select(*leaves(df.schema, ()))


def text_report(df: DataFrame) -> DataFrame:
    """One column, report: a line for each leaf, list items by index, indented by depth."""

    def lines(schema: StructType, path: tuple[str, ...], depth: int) -> list[Column]:
        out = []
        for f in schema.fields:
            here, indent = (*path, f.name), "  " * depth
            column = F.col(".".join(f"`{p}`" for p in here))
            if isinstance(f.dataType, StructType):
                out += [F.lit(f"{indent}{f.name}:"), *lines(f.dataType, here, depth + 1)]
            elif isinstance(f.dataType, ArrayType):
                items = F.transform(column, lambda x, i: F.concat(F.lit(indent + "  ["), i.cast("string"), F.lit("]: "), x.cast("string") if not isinstance(f.dataType.elementType, StructType) else F.to_json(x)))
                out += [F.lit(f"{indent}{f.name}:"), F.when(F.size(items) > 0, F.array_join(items, "\n"))]
            else:
                out.append(F.concat(F.lit(f"{indent}{f.name}: "), F.coalesce(column.cast("string"), F.lit("null"))))
        return out

    return df.select(F.concat_ws("\n", *lines(df.schema, (), 0)).alias("report"))


def preview(column: str, most: int = 3) -> Column:
    """The first items of a list and how many more there are."""
    return F.struct(F.slice(column, 1, most).alias("items"), F.greatest(F.size(column) - most, F.lit(0)).alias("more"))


def pages_report(results: DataFrame) -> DataFrame:
    """doc_id, pages (ordered) and mean confidence of results(doc_id, page_no, text, confidence, model)."""
    return results.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "text", "confidence", "model"))).alias("pages"), F.round(F.avg("confidence"), 4).alias("avg_confidence"))


def patients_only(results: DataFrame) -> DataFrame:
    """The records inside results(doc_id, success, patients array<struct>), one a row; failed results give none."""
    return results.where("success").select("doc_id", F.posexplode("patients").alias("patient_index", "p")).select("doc_id", "patient_index", "p.*")


def successful(results: DataFrame) -> DataFrame:
    return results.where("success")


def checked_path(path: str, root: str | None = None) -> str:
    """The absolute path, if it stays under root (the working directory)."""
    base = os.path.realpath(root or os.getcwd())
    full = os.path.realpath(os.path.join(base, path))
    if os.path.commonpath([base, full]) != base:
        raise ValueError(f"{path} leaves {base}")
    return full


def write(df: DataFrame, path: str, kind: str = "json", partition_by: Sequence[str] = (), root: str | None = None) -> None:
    """Writes rows as csv, json, xml, text or parquet; an unknown kind counts as json. With root, a path that leaves it
    is refused."""
    path = checked_path(path, root) if root is not None else path
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    kind = kind if kind in ("csv", "json", "xml", "text", "parquet") else "json"
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind == "xml":
        writer.option("rowTag", "patient").format("xml").save(path)
    else:
        writer.format(kind).save(path)


def write_sheets(sheets: dict[str, DataFrame], path: str) -> None:
    """Several tables beside each other, one folder with a header for each sheet of a workbook."""
    for name, df in sheets.items():
        write(df, os.path.join(path, name), "csv")


def audit_rows(df: DataFrame, action: str, at: Column) -> DataFrame:
    """event rows for an append-only audit table."""
    return df.select(F.lit(action).alias("action"), F.col("doc_id"), at.alias("at"))
