"""Run analytics: runs(model, file, seconds, confidence, patients, text_length, ord) and summaries of records."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


def record_completeness() -> Column:
    """Percent of eight fields that a record has: names, birth, id, both kinds of codes, service date, charge."""
    parts = [F.coalesce(c, F.lit("")) != "" for c in ("first_name", "last_name", "patient_id")]
    parts += [F.col(c).isNotNull() for c in ("date_of_birth", "date_of_service", "total_charge")]
    parts += [F.size(c) > 0 for c in ("cpt_codes", "icd10_codes")]
    return reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(False)).cast("int") for p in parts]) * 12.5


def file_metrics(records: DataFrame) -> DataFrame:
    """Codes, and records with name, birth, id, service date and charge, of every document."""
    return records.groupBy("doc_id").agg(
        F.count("*").alias("patients"), F.sum(F.size("cpt_codes")).alias("total_cpt_codes"), F.sum(F.size("icd10_codes")).alias("total_icd10_codes"),
        F.count_if(F.col("first_name").isNotNull() | F.col("last_name").isNotNull()).alias("patients_with_names"), F.count_if(F.col("date_of_birth").isNotNull()).alias("patients_with_dob"),
        F.count_if(F.col("patient_id").isNotNull()).alias("patients_with_id"), F.count_if(F.col("date_of_service").isNotNull()).alias("patients_with_service"),
        F.count_if(F.col("total_charge").isNotNull()).alias("patients_with_financial"), F.round(F.avg(record_completeness()), 2).alias("completeness"),
    )


def model_metrics(runs: DataFrame) -> DataFrame:
    """Counts, success rate, times and means of every model."""
    return runs.groupBy("model").agg(
        F.count("*").alias("files_processed"), F.round(F.avg(F.when(F.col("patients") > 0, 100.0).otherwise(0.0)), 1).alias("success_rate"),
        F.round(F.avg("seconds"), 3).alias("avg_time"), F.round(F.min("seconds"), 3).alias("min_time"), F.round(F.max("seconds"), 3).alias("max_time"),
        F.round(F.avg("confidence"), 3).alias("avg_confidence"), F.sum("patients").alias("total_patients"), F.round(F.sum("patients") / F.count("*"), 2).alias("patients_per_file"),
    )


def success_metrics(runs: DataFrame) -> DataFrame:
    """Means over runs that found someone, and rates over the mean count of people (1 at least)."""
    people = F.greatest(F.avg("patients"), F.lit(1.0))
    return runs.where("patients > 0").groupBy("model").agg(
        F.round(F.avg("cpt_codes"), 2).alias("avg_cpt_codes"), F.round(F.avg("completeness"), 1).alias("avg_completeness"),
        F.round(F.avg("with_names") / people * 100, 1).alias("name_rate"), F.round(F.avg("with_financial") / people * 100, 1).alias("financial_rate"),
    )


def rankings(metrics: DataFrame) -> DataFrame:
    """Ranks of models by speed, confidence and people found, names breaking ties."""
    orders = {"speed": "avg_time", "confidence": "avg_confidence", "patients": "total_patients"}
    out = []
    for name, c in orders.items():
        by = F.col(c) if name == "speed" else F.desc(c)
        out.append(F.row_number().over(Window.orderBy(by, "model")).alias(f"{name}_rank"))  # a row for each model
    return metrics.select("model", *out)


def composite(metrics: DataFrame) -> DataFrame:
    """The weighted score of every model, and its rank."""
    speed = F.greatest(F.lit(0.0), 100 - 10 * F.col("avg_time"))
    people = F.least(F.lit(100.0), 10.0 * F.col("total_patients"))
    score = F.round(0.2 * speed + 0.3 * 100 * F.col("avg_confidence") + 0.2 * F.col("success_rate") + 0.15 * people + 0.15 * F.coalesce(F.col("avg_completeness"), F.lit(0.0)), 4)
    scored = metrics.select("model", score.alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "model")))


def recommendations(metrics: DataFrame) -> DataFrame:
    """The best model for speed, confidence and people found."""
    return metrics.agg(F.min_by("model", F.struct("avg_time", "model")).alias("speed"), F.min_by("model", F.struct(-F.col("avg_confidence"), "model")).alias("accuracy"), F.min_by("model", F.struct(-F.col("total_patients"), "model")).alias("extraction"))


def file_model_matrix(runs: DataFrame, models: list[str], value: str = "seconds") -> DataFrame:
    """The first run's value of every file and model."""
    return runs.groupBy("file").pivot("model", models).agg(F.min_by(value, "ord"))


def batch_summary(runs: DataFrame) -> DataFrame:
    """Totals, success rate, mean time over all runs and mean confidence over those that succeeded; 0 without any."""
    ok = F.col("patients") > 0
    return runs.agg(
        F.count("*").alias("total"), F.count_if(ok).alias("successful"), F.round(F.coalesce(F.avg(ok.cast("int")), F.lit(0.0)) * 100, 2).alias("success_rate"),
        F.round(F.coalesce(F.avg("seconds"), F.lit(0.0)), 4).alias("avg_time"), F.round(F.coalesce(F.avg(F.when(ok, F.col("confidence"))), F.lit(0.0)), 4).alias("avg_confidence"),
        F.sum("patients").alias("patients"), F.count_distinct("file").alias("files"), F.count_distinct("model").alias("models"),
    )


def summary_rows(documents: DataFrame, records: DataFrame) -> DataFrame:
    """A row for each record with flags, and one with index 0 for a document without any."""
    flags = [F.coalesce(F.size(c) > 0, F.lit(False)).alias(f"has_{c}") for c in ("cpt_codes", "icd10_codes")]
    joined = documents.select("doc_id").join(records, "doc_id", "left")
    name = F.coalesce(F.col("first_name").isNotNull() | F.col("last_name").isNotNull(), F.lit(False)).alias("has_name")
    return joined.select("doc_id", F.coalesce(F.col("patient_index") + 1, F.lit(0)).alias("patient_index"), name, F.col("date_of_birth").isNotNull().alias("has_dob"), *flags)


def error_counts(errors: DataFrame) -> DataFrame:
    return errors.groupBy("engine", "error_type").agg(F.count("*").alias("errors"))


def memory_growth(samples: DataFrame) -> DataFrame:
    """host, growth a second from the first sample to the last, and whether it is above 10."""
    got = samples.groupBy("host").agg(F.min_by("mb", "ts").alias("first"), F.max_by("mb", "ts").alias("last"), (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("seconds"))
    rate = F.round(F.when(F.col("seconds") > 0, (F.col("last") - F.col("first")) / F.col("seconds")).otherwise(0.0), 4)
    return got.select("host", rate.alias("mb_per_second"), (rate > 10).alias("growing"))


def eviction_order(models: DataFrame, most: int = 3) -> DataFrame:
    """The models to unload first: idle time .5, low priority .3, size .2."""
    score = F.round(0.5 * F.col("idle_seconds") + 0.3 * (3 - F.col("priority")) + 0.2 * F.col("mb"), 4)
    return models.select("model", score.alias("score")).orderBy(F.desc("score"), "model").limit(most)


def all_runs(files: DataFrame, models: DataFrame) -> DataFrame:
    """Every file with every model; models is a handful of rows."""
    return files.crossJoin(F.broadcast(models))


def dashboard_rows(runs: DataFrame) -> DataFrame:
    """One row a run, by the dashboard's names."""
    return runs.select(F.col("model").alias("model_name"), F.col("file").alias("file_name"), F.col("seconds").alias("extraction_time"), "confidence", F.col("patients").alias("patient_count"), "text_length", F.col("cpt_codes").alias("cpt_codes_extracted"), F.col("completeness").alias("data_completeness_score"), F.col("ts").alias("timestamp"))


def document_confidence(documents: DataFrame, records: DataFrame) -> DataFrame:
    """doc_id and the mean confidence of its records: 0 without records, one half where none has a confidence."""
    by_doc = records.groupBy("doc_id").agg(F.coalesce(F.avg("confidence"), F.lit(0.5)).alias("mean"))
    return documents.select("doc_id").join(by_doc, "doc_id", "left").select("doc_id", F.coalesce("mean", F.lit(0.0)).alias("confidence"))


def export_counts(records: DataFrame) -> DataFrame:
    """Counts that the exports and pages show, in one row: records, codes, charges, records on several pages."""
    many = F.size("page_numbers") > 1
    return records.agg(F.count("*").alias("patients"), F.sum(F.size("cpt_codes")).alias("total_cpt_codes"), F.sum(F.size("icd10_codes")).alias("total_icd10_codes"), F.sum("total_charge").alias("total_charges"), F.count_if(many).alias("multi_page_patients"))


def patients_by_page(records: DataFrame) -> DataFrame:
    """doc_id, page_no and nodes: the records of a page in order."""
    return records.groupBy("doc_id", "page_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "node"))), lambda x: x["node"]).alias("nodes"))


def append_runs(runs: DataFrame, path: str) -> None:
    """The runs of one session added to the fact table, a folder for each day."""
    runs.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def filled_share(fields: Sequence[str], lists: Sequence[str], nested: Sequence[str], schema: StructType) -> Column:
    """Share of filled fields of a record: plain ones, lists, and the members of nested structs that are there."""

    def filled(c: Column) -> Column:
        return (F.coalesce(c.cast("string"), F.lit("")) != "").cast("int")

    total, have = F.lit(len(fields) + len(lists)), F.lit(0)
    for c in fields:
        have = have + filled(F.col(c))
    for c in lists:
        have = have + (F.coalesce(F.size(c), F.lit(0)) > 0).cast("int")
    for c in nested:
        inner = schema[c].dataType.fieldNames()
        there = F.col(c).isNotNull()
        total = total + F.when(there, len(inner)).otherwise(0)
        for k in inner:
            have = have + F.when(there, filled(F.col(f"{c}.{k}"))).otherwise(0)
    return have / total
