"""Record-shaped relations derived from the order tables, each with the same relation as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billweave.sources.tables import read_table


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each order with lines; eight orders make a document of four pages with two records each."""
    lines = read_table(spark, sf_dir, "lineitem")
    cpt = (10000 + F.col("l_partkey") % 300 * 299).cast("string")
    letter = F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (F.col("l_suppkey") % 26).cast("int") + 1, F.lit(1))
    icd = F.concat(letter, F.lpad((F.col("l_suppkey") % 100).cast("string"), 2, "0"), F.when(F.col("l_suppkey") % 3 == 0, "").otherwise(F.concat(F.lit("."), (F.col("l_suppkey") % 10).cast("string"))))
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    listed = lines.select("l_orderkey", price.alias("price"), F.struct(F.col("l_linenumber").alias("k"), cpt.alias("code"), price.alias("charge")).alias("c"), F.struct(F.col("l_linenumber").alias("k"), icd.alias("code")).alias("d"))
    by_order = listed.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("c")).alias("c"), F.sort_array(F.collect_list("d")).alias("d"), F.sum("price").alias("total_charge"))
    orders = read_table(spark, sf_dir, "orders")
    joined = by_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    person = F.col("o_custkey") % 40
    return joined.select(
        F.expr("o_orderkey div 8").alias("doc_id"),
        F.expr("cast(o_orderkey % 8 div 2 as int)").alias("page_no"),
        (F.col("o_orderkey") % 2).cast("int").alias("idx"),
        F.col("o_orderkey").alias("node"),
        F.when(person % 13 == 0, None).otherwise(F.concat(F.lit("First"), person.cast("string"))).alias("first_name"),
        F.concat(F.lit("Last"), (person % 20).cast("string"), F.when(person % 17 == 0, " and Other").otherwise("")).alias("last_name"),
        F.date_add(F.lit("1920-01-01").cast("date"), (person * 1100).cast("int")).alias("date_of_birth"),
        F.when(person % 7 == 0, None).otherwise(F.concat(F.lit("P-"), person.cast("string"))).alias("patient_id"),
        F.when(person % 2 == 0, "male").otherwise("female").alias("gender"),
        F.transform("c", lambda x: x["code"]).alias("cpt_codes"),
        F.transform("d", lambda x: x["code"]).alias("icd10_codes"),
        F.transform("c", lambda x: x["charge"]).alias("charges"),
        F.col("o_orderdate").cast("date").alias("date_of_service"),
        F.col("total_charge").cast("decimal(14,2)").alias("total_charge"),
        (0.5 + F.col("o_orderkey") % 50 / 100).alias("confidence"),
    )


PATIENT_SQL = """pat as (select o.o_orderkey // 8 as doc_id, cast(o.o_orderkey % 8 // 2 as integer) as page_no, cast(o.o_orderkey % 2 as integer) as idx, o.o_orderkey as node,
    case when o.o_custkey % 40 % 13 = 0 then null else 'First' || (o.o_custkey % 40) end as first_name,
    'Last' || (o.o_custkey % 40 % 20) || case when o.o_custkey % 40 % 17 = 0 then ' and Other' else '' end as last_name,
    date '1920-01-01' + cast(o.o_custkey % 40 * 1100 as integer) as date_of_birth,
    case when o.o_custkey % 40 % 7 = 0 then null else 'P-' || (o.o_custkey % 40) end as patient_id,
    case when o.o_custkey % 40 % 2 = 0 then 'male' else 'female' end as gender,
    l.c as cpt_codes, l.d as icd10_codes, l.charges, cast(o.o_orderdate as date) as date_of_service, cast(l.total as decimal(14,2)) as total_charge, 0.5 + (o.o_orderkey % 50) / 100 as confidence
  from (select l_orderkey, sum(price) as total, list(code order by k, code, price) as c, list(price order by k, code, price) as charges, list(icd order by k, icd) as d from
      (select l_orderkey, l_linenumber as k, cast(10000 + l_partkey % 300 * 299 as varchar) as code, cast(l_extendedprice as decimal(12,2)) as price,
        chr(cast(65 + l_suppkey % 26 as integer)) || lpad(cast(l_suppkey % 100 as varchar), 2, '0') || case when l_suppkey % 3 = 0 then '' else '.' || (l_suppkey % 10) end as icd from lineitem) group by l_orderkey) l
  join orders o on o.o_orderkey = l.l_orderkey)"""


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """patients() with codes as structs, as the exports take them."""
    cpt = F.transform(F.arrays_zip("cpt_codes", "charges"), lambda x: F.struct(x["cpt_codes"].alias("code"), F.concat(F.lit("CPT "), x["cpt_codes"]).alias("description"), x["charges"].alias("charge"), F.lit(0.8).alias("confidence")))
    icd = F.transform("icd10_codes", lambda x: F.struct(x.alias("code"), F.concat(F.lit("ICD-10 "), x).alias("description"), F.lit(0.7).alias("confidence")))
    got = patients(spark, sf_dir)
    # every fifth record has no codes, every seventh no diagnoses
    none_cpt, none_icd = F.slice(cpt, 1, 0), F.slice(icd, 1, 0)
    return got.withColumn("cpt", F.when(F.col("node") % 5 == 0, none_cpt).otherwise(cpt)).withColumn("icd", F.when((F.col("node") % 5 == 0) | (F.col("node") % 7 == 0), none_icd).otherwise(icd)).drop("cpt_codes", "icd10_codes", "charges").withColumnsRenamed({"cpt": "cpt_codes", "icd": "icd10_codes"})


CODED_SQL = PATIENT_SQL + """, cod as (select * exclude (cpt_codes, icd10_codes, charges),
    case when node % 5 = 0 then [] else cpt_codes end as cpt, case when node % 5 = 0 then [] else charges end as charge,
    case when node % 5 = 0 or node % 7 = 0 then [] else icd10_codes end as icd from pat)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as runs of models on files."""
    e = read_table(spark, sf_dir, "events")
    key = F.col("event_id")
    return e.select(
        F.col("event_type").alias("model"), F.col("user_id").alias("file"), F.col("value").alias("seconds"), ((key % 37) / 37).alias("confidence"), (key % 4).alias("patients"),
        (key % 1000).alias("text_length"), key.alias("ord"), (key % 5).alias("cpt_codes"), (key % 8 * 12.5).alias("completeness"), F.least(key % 4, key % 3).alias("with_names"), (key % 2).alias("with_financial"), F.col("ts"),
    )


RUN_SQL = """run as (select event_type as model, user_id as file, value as seconds, (event_id % 37) / 37 as confidence, event_id % 4 as patients, event_id % 1000 as text_length, event_id as ord,
    event_id % 5 as cpt_codes, event_id % 8 * 12.5 as completeness, least(event_id % 4, event_id % 3) as with_names, event_id % 2 as with_financial, ts from events)"""


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three readings of the names of customers by models that err in their own way."""
    c = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("image_id"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("name"))
    models = [("alpha", F.col("name"), 0.9), ("beta", F.regexp_replace("name", "0", "O"), 0.8), ("gamma", F.when(F.col("image_id") % 3 == 0, F.col("name")).otherwise(F.substring("name", 1, 12)), 0.7)]
    each = F.array(*(F.struct(F.lit(k).alias("ord"), F.lit(m).alias("model"), t.alias("text"), (F.lit(w) - (F.col("image_id") % 5) / 20).alias("confidence"), (F.lit(1.0) + k).alias("seconds")) for k, (m, t, w) in enumerate(models)))
    return c.select("image_id", F.inline(each))


READING_SQL = """reading as (select image_id, unnest(rs, recursive := true) from (select c_custkey as image_id, c_name || ' ' || c_mktsegment as name,
    [{'ord': 0, 'model': 'alpha', 'text': name, 'confidence': 0.9::double - (c_custkey % 5) / 20, 'seconds': 1.0::double},
     {'ord': 1, 'model': 'beta', 'text': replace(name, '0', 'O'), 'confidence': 0.8::double - (c_custkey % 5) / 20, 'seconds': 2.0::double},
     {'ord': 2, 'model': 'gamma', 'text': case when c_custkey % 3 = 0 then name else substr(name, 1, 12) end, 'confidence': 0.7::double - (c_custkey % 5) / 20, 'seconds': 3.0::double}] as rs from customer))"""
