"""A code corpus made from the driver's tables, so that every fact has a closed form in their columns.

One procedure for each ``part``, a package for each ``supplier`` (every fourth without a body), one file of tables and
one of joins. All text is made by column expressions; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INV, STOCK = 5, 3


def ddl() -> str:
    out = [f"CREATE TABLE inv_{i} (\n  id NUMBER(10) PRIMARY KEY,\n  qty NUMBER NOT NULL\n);" for i in range(INV)]
    out += [f"CREATE TABLE stock_{i} (\n  id NUMBER(10) NOT NULL,\n  inv_ref NUMBER NOT NULL,\n  qty NUMBER,\n  CONSTRAINT stock_{i}_pk PRIMARY KEY (id),\n  CONSTRAINT stock_{i}_fk FOREIGN KEY (inv_ref) REFERENCES inv_{i} (id)\n);" for i in range(STOCK)]
    return "\n".join(out) + "\n"


def join_procedures() -> str:
    return "".join(f"CREATE OR REPLACE PROCEDURE join_{i} IS\n  v_q NUMBER;\nBEGIN\n  SELECT max(s.qty) INTO v_q FROM ship h, stock_{i} s WHERE h.stock_ref = s.id;\nEND join_{i};\n/\n" for i in range(STOCK))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (file, text)."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("z"))
    n = part.count()
    s = lambda c: c.cast("string")
    k, z = F.col("k"), F.col("z")
    on = lambda m, *parts: F.when(z % m == 0, F.concat(*(p if isinstance(p, F.Column) else F.lit(p) for p in parts))).otherwise("")
    ifs = F.array_join(F.transform(F.when(z % 4 > 0, F.sequence(F.lit(1), z % 4)).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.lit("  IF p_id > "), i.cast("string"), F.lit(" THEN\n    UPDATE inv_"), s(z % INV), F.lit(" SET qty = qty + 1 WHERE id = p_id;\n  END IF;\n"))), "")
    text = F.concat(
        F.lit("CREATE OR REPLACE PROCEDURE part_"), s(k), F.lit(" (p_id IN NUMBER) IS\n  v_n NUMBER := 0;\nBEGIN\n  v_n := v_n + 1;\n"), ifs,
        on(2, "  FOR r IN 1 .. 3 LOOP\n    SELECT count(id) INTO v_n FROM stock_", s(z % STOCK), " WHERE id = p_id;\n  END LOOP;\n"),
        on(3, "  part_", s((k * 7 + 1) % n), "(p_id);\n"), on(13, "  ext_pkg.do_it(p_id);\n"), on(11, "  EXECUTE IMMEDIATE 'DELETE FROM tmp_t WHERE id = ' || p_id;\n"),
        on(5, "  COMMIT;\n"), on(7, "EXCEPTION\n  WHEN OTHERS THEN\n    NULL;\n"), F.lit("END part_"), s(k), F.lit(";\n/\n"),
    )
    procedures = part.select(F.concat(F.lit("src/part_"), s(k), F.lit(".prc")).alias("file"), text.alias("text"))
    sup = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k"))
    head = F.concat(F.lit("pkg_"), s(k))
    spec = F.concat(F.lit("CREATE OR REPLACE PACKAGE "), head, F.lit(" AS\n  PROCEDURE run(p_a IN NUMBER);\n  PROCEDURE run(p_a IN NUMBER, p_b IN NUMBER);\n  FUNCTION total(p_a IN NUMBER) RETURN NUMBER;\nEND "), head, F.lit(";\n/\n"))
    body = F.concat(
        F.lit("CREATE OR REPLACE PACKAGE BODY "), head,
        F.lit(" AS\n  g_n NUMBER := 0;\n  PROCEDURE helper(p_a IN NUMBER);\n  PROCEDURE run(p_a IN NUMBER) IS\n  BEGIN\n    run(p_a, 1);\n  END run;\n  PROCEDURE run(p_a IN NUMBER, p_b IN NUMBER) IS\n  BEGIN\n    g_n := g_n + total(p_a);\n  END run;\n  FUNCTION total(p_a IN NUMBER) RETURN NUMBER IS\n  BEGIN\n    helper(p_a);\n    RETURN p_a;\n  END total;\n  PROCEDURE helper(p_a IN NUMBER) IS\n  BEGIN\n    part_"),
        s(k % n), F.lit("(p_a);\n  END helper;\nEND "), head, F.lit(";\n/\n"),
    )
    specs = sup.select(F.concat(F.lit("src/"), head, F.lit(".pks")).alias("file"), spec.alias("text"))
    bodies = sup.where(k % 4 != 0).select(F.concat(F.lit("src/"), head, F.lit(".pkb")).alias("file"), body.alias("text"))
    fixed = spark.createDataFrame([("ddl/tables.sql", ddl()), ("src/joins.sql", join_procedures())], "file string, text string")
    return procedures.unionByName(specs).unionByName(bodies).unionByName(fixed)
