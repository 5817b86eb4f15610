"""Billing texts derived from the order tables: input for the text operators, and the same text in SQL.

One text stands for two orders (o_orderkey div 2), joined by a line of dashes. Each order prints the customer as a
person, a service date, a provider number, its lines as procedures and diagnoses, and a total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billweave.functions.text import bound
from billweave.sources.tables import read_table

RULE = "-" * 40


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey and line (order, number, procedure, diagnosis, supplier, price) of every line of an order."""
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(12,2)").alias("price"))
    code = (10000 + F.col("l_partkey") % 89999).cast("string")
    procedure = F.concat(code, F.lit(" - Service "), F.col("l_linenumber").cast("string"), F.lit(" - $"), F.col("price").cast("string"))
    decimal = F.when(F.col("l_suppkey") % 3 == 0, "").otherwise(F.concat(F.lit("."), (F.col("l_partkey") % 10).cast("string")))
    letter = F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (F.col("l_suppkey") % 26).cast("int") + 1, F.lit(1))
    diagnosis = F.concat(letter, F.lpad((F.col("l_suppkey") % 100).cast("string"), 2, "0"), decimal, F.lit(" - Condition"))
    line = F.struct(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("k"), procedure.alias("p"), diagnosis.alias("d"), F.col("l_suppkey").alias("supp"), "price")
    return lines.select(F.col("l_orderkey").alias("o_orderkey"), line.alias("line"))


def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey and head (order, text) of every order with a customer."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    people = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    birth = F.date_add(F.lit("1940-01-01").cast("date"), (F.col("c_custkey") % 20000).cast("int"))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("PATIENT NAME: "), F.regexp_replace("c_name", "#0*", " ")),
        F.concat(F.lit("DOB: "), F.date_format(birth, "MM/dd/yyyy")),
        F.concat(F.lit("Patient ID: P-"), F.col("c_custkey").cast("string")),
        F.concat(F.lit("Date of Service: "), F.date_format("day", "MM/dd/yyyy")),
    )
    return orders.join(people, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.struct(F.col("o_orderkey").alias("o"), text.alias("text")).alias("head"))


def _text(head: Column, lines: Column) -> Column:
    """The text of an order and its lines."""

    def listed(name: str) -> Column:
        ordered = F.sort_array(F.transform(lines, lambda x: F.struct(x["k"].alias("k"), x[name].alias("line"))))
        return F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")

    prices = F.filter(F.transform(lines, lambda x: x["price"]), lambda x: x.isNotNull())
    total = bound(prices, lambda ps: F.when(F.size(ps) > 0, F.aggregate(ps, F.lit(0).cast("decimal(18,2)"), lambda t, x: (t + x).cast("decimal(18,2)"))))
    return F.concat_ws(
        "\n",
        head["text"],
        F.concat(F.lit("Provider NPI: "), (1000000000 + F.array_max(F.transform(lines, lambda x: x["supp"])) * 7919).cast("string")),
        F.lit("PROCEDURE CODES:"),
        listed("p"),
        F.lit("DIAGNOSIS CODES:"),
        listed("d"),
        F.concat(F.lit("Total Charges: $"), total.cast("decimal(14,2)").cast("string")),
    )


def billing_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text: two orders in a text.

    Orders and lines are dealt once, by text, as rows of one union, so that neither texts nor lists are dealt anew.
    """
    doc = F.expr("o_orderkey div 2").alias("doc_id")
    lines, heads = _lines(spark, sf_dir).select(doc, "line"), _heads(spark, sf_dir).select(doc, "head")
    met = lines.unionByName(heads, allowMissingColumns=True).groupBy("doc_id").agg(F.collect_list("head").alias("heads"), F.collect_list("line").alias("lines"))
    with_lines = F.filter("heads", lambda h: F.exists("lines", lambda x: x["o"] == h["o"]))
    each = F.transform("whole", lambda h: F.struct(h["o"].alias("o"), bound(F.filter("lines", lambda x: x["o"] == h["o"]), lambda own: _text(h, own)).alias("text")))
    joined = F.array_join(F.transform(F.sort_array(each), lambda x: x["text"]), f"\n{RULE}\n")
    return met.select("doc_id", with_lines.alias("whole"), "lines").where(F.size("whole") > 0).select("doc_id", joined.alias("text"))


#: The same texts in DuckDB's SQL, as common table expressions order_text(o_orderkey, text) and doc(doc_id, text).
DOC_SQL = f"""order_text as (
  select o.o_orderkey, 'PATIENT NAME: ' || regexp_replace(c.c_name, '#0*', ' ', 'g') || chr(10)
    || 'DOB: ' || strftime(date '1940-01-01' + cast(c.c_custkey % 20000 as integer), '%m/%d/%Y') || chr(10)
    || 'Patient ID: P-' || c.c_custkey || chr(10)
    || 'Date of Service: ' || strftime(o.o_orderdate, '%m/%d/%Y') || chr(10)
    || 'Provider NPI: ' || (1000000000 + l.supp * 7919) || chr(10)
    || 'PROCEDURE CODES:' || chr(10) || l.p || chr(10) || 'DIAGNOSIS CODES:' || chr(10) || l.d || chr(10)
    || 'Total Charges: $' || cast(l.total as decimal(14,2)) as text
  from (select l_orderkey, max(l_suppkey) as supp, sum(cast(l_extendedprice as decimal(12,2))) as total,
      string_agg((10000 + l_partkey % 89999) || ' - Service ' || l_linenumber || ' - $' || cast(l_extendedprice as decimal(12,2)), chr(10)
        order by l_linenumber, (10000 + l_partkey % 89999) || ' - Service ' || l_linenumber || ' - $' || cast(l_extendedprice as decimal(12,2))) as p,
      string_agg(chr(cast(65 + l_suppkey % 26 as integer)) || lpad(cast(l_suppkey % 100 as varchar), 2, '0') || case when l_suppkey % 3 = 0 then '' else '.' || (l_partkey % 10) end || ' - Condition', chr(10)
        order by l_linenumber, chr(cast(65 + l_suppkey % 26 as integer)) || lpad(cast(l_suppkey % 100 as varchar), 2, '0') || case when l_suppkey % 3 = 0 then '' else '.' || (l_partkey % 10) end || ' - Condition') as d
    from lineitem group by l_orderkey) l
  join orders o on o.o_orderkey = l.l_orderkey join customer c on c.c_custkey = o.o_custkey),
doc as (select o_orderkey // 2 as doc_id, string_agg(text, chr(10) || '{RULE}' || chr(10) order by o_orderkey, text) as text from order_text group by 1)"""
