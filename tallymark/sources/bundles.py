"""Cases of three documents derived from the star-schema tables, by key arithmetic only.

Case = order; documents: identity card, marksheet, address proof. Names and streets come from ``part`` (joined on the
customer's number), birth dates from the order date, identifiers from the customer. Variants and errors follow from the
key, so an SQL engine can restate every value (``BUNDLE_SQL``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = ("id_card", "marksheet", "address_proof")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``case_id, idx, doc_id, doc_type, name, dob, address, id_number, guardian, ocr_conf``; one row a document."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderdate").alias("d"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"), F.col("p_name").alias("n"))
    rows = orders.join(part, orders.c == part.p).withColumn("idx", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    k, i, n = F.col("k"), F.col("idx"), F.col("n")
    first, last = F.split_part(n, F.lit(" "), F.lit(1)), F.split_part(n, F.lit(" "), F.lit(2))
    name = (
        F.when(i == 1, F.concat(F.lit("Mr. "), F.initcap(n))).when((i == 2) & (k % 5 == 0), F.concat(F.upper(F.left(first, F.lit(1))), F.lit(". "), F.initcap(last)))
        .when((i == 3) & (k % 5 == 1), F.concat(F.initcap(last), F.lit(" "), F.initcap(first))).when((i == 3) & (k % 5 == 2), F.concat(F.initcap(first), F.lit(" Kr S/O "), F.initcap(last)))
        .otherwise(F.initcap(n))
    )
    d = F.col("d").cast("date")
    d = F.when((i == 2) & (k % 7 == 0), F.date_add(d, 3)).when((i == 2) & (k % 13 == 0), F.add_months(d, 12)).otherwise(d)
    dob = F.when(i == 1, F.date_format(d, "yyyy-MM-dd")).when((i == 2) & (k % 11 == 0), F.date_format(d, "MM/dd/yyyy")).when(i == 2, F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "dd-MMM-yyyy"))
    address = F.when(i != 2, F.concat(F.lit("No "), (k % 180).cast("string"), F.lit(", "), n, F.when(i == 3, F.lit(" Rd, Blr - ")).otherwise(F.lit(" Road, Bengaluru - ")), (F.lit(560001) + k % 99 + F.when((i == 3) & (k % 17 == 0), 1).otherwise(0)).cast("string")))
    number = F.concat(F.when(i == 1, F.lit("IND-")).when(i == 2, F.lit("ROLL-")).otherwise(F.when(k % 3 == 0, F.lit("IND ")).otherwise(F.lit("CON-"))), F.lpad((F.col("c") + F.when((i == 3) & (k % 9 == 0), 1).otherwise(0)).cast("string"), 8, "0"))
    guardian = F.when((i == 1) | ((i == 2) & (k % 6 != 0)), F.concat(F.lit("Shri "), F.initcap(last)))
    conf = (F.lit(55) + (k * 37 + i * 11) % 45).cast("double") / 100
    return rows.select(k.alias("case_id"), i.alias("idx"), F.concat(F.lit("doc_"), i.cast("string")).alias("doc_id"), F.element_at(F.array(*map(F.lit, TYPES)), i).alias("doc_type"), name.alias("name"), dob.alias("dob"), address.alias("address"), number.alias("id_number"), guardian.alias("guardian_name"), conf.alias("ocr_conf"))


def raw_fields(b: DataFrame, names=("name", "dob", "address", "id_number", "guardian_name")) -> DataFrame:
    """Long form: one row a document and field that it has."""
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("value_raw")) for n in names])
    return b.select("case_id", "idx", "doc_id", "doc_type", "ocr_conf", F.explode(pairs).alias("f")).select("case_id", "idx", "doc_id", "doc_type", "ocr_conf", "f.field", "f.value_raw").filter("value_raw is not null")


def documents_of(b: DataFrame) -> DataFrame:
    return b.select("case_id", "idx", "doc_id", "doc_type")


BUNDLE_SQL = """
b0 AS (
  SELECT o_orderkey AS k, o_custkey AS c, o_orderdate::DATE AS d0, p_name AS n, idx,
         upper(substr(split_part(p_name, ' ', 1), 1, 1)) || substr(split_part(p_name, ' ', 1), 2) AS f, upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) AS l
  FROM orders JOIN part ON o_custkey = p_partkey, (VALUES (1), (2), (3)) v(idx)
), b1 AS (
  SELECT *, CASE WHEN idx = 2 AND k % 7 = 0 THEN d0 + 3 WHEN idx = 2 AND k % 13 = 0 THEN (d0 + INTERVAL 12 MONTH)::DATE ELSE d0 END AS d FROM b0
), bundles AS (
  SELECT k AS case_id, idx, 'doc_' || idx AS doc_id, CASE idx WHEN 1 THEN 'id_card' WHEN 2 THEN 'marksheet' ELSE 'address_proof' END AS doc_type,
    CASE WHEN idx = 1 THEN 'Mr. ' || f || ' ' || l WHEN idx = 2 AND k % 5 = 0 THEN substr(f, 1, 1) || '. ' || l WHEN idx = 3 AND k % 5 = 1 THEN l || ' ' || f
         WHEN idx = 3 AND k % 5 = 2 THEN f || ' Kr S/O ' || l ELSE f || ' ' || l END AS name,
    CASE WHEN idx = 1 THEN strftime(d, '%Y-%m-%d') WHEN idx = 2 AND k % 11 = 0 THEN strftime(d, '%m/%d/%Y') WHEN idx = 2 THEN strftime(d, '%d/%m/%Y') ELSE strftime(d, '%d-%b-%Y') END AS dob,
    CASE WHEN idx <> 2 THEN 'No ' || (k % 180) || ', ' || n || CASE WHEN idx = 3 THEN ' Rd, Blr - ' ELSE ' Road, Bengaluru - ' END || (560001 + k % 99 + CASE WHEN idx = 3 AND k % 17 = 0 THEN 1 ELSE 0 END) END AS address,
    CASE WHEN idx = 1 THEN 'IND-' WHEN idx = 2 THEN 'ROLL-' WHEN k % 3 = 0 THEN 'IND ' ELSE 'CON-' END || lpad((c + CASE WHEN idx = 3 AND k % 9 = 0 THEN 1 ELSE 0 END)::VARCHAR, 8, '0') AS id_number,
    CASE WHEN idx = 1 OR (idx = 2 AND k % 6 <> 0) THEN 'Shri ' || l END AS guardian_name,
    (55 + (k * 37 + idx * 11) % 45)::DOUBLE / 100 AS ocr_conf
  FROM b1
)
"""
