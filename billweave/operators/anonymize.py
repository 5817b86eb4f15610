"""Anonymised records: deterministic tokens and masks, by switches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billweave.functions import privacy


def anonymized(records: DataFrame, names: bool = True, addresses: bool = True, phones: bool = True, ids: bool = True, dates: bool = False) -> DataFrame:
    """Records with tokens for names and ids and masks for addresses and phones; dates shift by a person's own days."""
    out = records
    if dates:
        for c in [c for c in records.columns if c.startswith("date_")]:
            out = out.withColumn(c, privacy.shift_date(F.col(c), F.col("patient_id")))
    if names:
        out = out.withColumn("first_name", privacy.name_token(F.col("first_name"))).withColumn("last_name", F.when(F.col("last_name").isNotNull(), "Anonymous"))
    if addresses and "address" in records.columns:
        out = out.withColumn("address", privacy.mask_address(F.col("address")))
    if phones and "phone" in records.columns:
        out = out.withColumn("phone", privacy.mask_phone(F.col("phone")))
    if ids:
        out = out.withColumn("patient_id", privacy.id_token(F.col("patient_id")))
    return out.withColumn("is_anonymized", F.lit(True))


def protected(records: DataFrame, method: str, columns: Sequence[str] = ("first_name", "last_name", "patient_id", "address", "phone")) -> DataFrame:
    """Records whose personal columns are replaced by the chosen method: Redaction puts a mark, Replacement the masks of
    anonymized(), Tokenization a token that is the same for the same value. Null stays null."""
    here = [c for c in columns if c in records.columns]
    if method == "Redaction":
        return records.withColumns({c: F.when(F.col(c).isNotNull(), "[REDACTED]") for c in here})
    if method == "Replacement":
        return anonymized(records, names="first_name" in here, addresses="address" in here, phones="phone" in here, ids="patient_id" in here).drop("is_anonymized")
    if method == "Tokenization":
        return records.withColumns({c: privacy.id_token(F.col(c)) for c in here})
    raise ValueError(f"unknown method {method}")
