"""A second look at what was written: ten checks over the folder and the analysis, and a verdict."""

from __future__ import annotations

import json
import os

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import is_subsequence, squeezed
from codeloom.plans.docs import cards, grid
from codeloom.plans.engine import Analysis

VERDICTS = ("VERIFIED", "VERIFIED_WITH_WARNINGS", "NOT_VERIFIED")


def listing(folder: str, spark) -> DataFrame:
    """(path, content) of all files of a folder that every executor mounts. Spark's own file sources pass over names
    that begin with an underscore; the driver lists names only, the executors read."""
    names = [os.path.relpath(os.path.join(d, n), folder) for d, _, found in os.walk(folder) for n in found]

    def read(batches):
        for b in batches:
            out = []
            for n in b["path"]:
                with open(os.path.join(folder, n), "rb") as f:
                    out.append((n, f.read()))
            yield pd.DataFrame(out, columns=["path", "content"])

    return spark.createDataFrame([(n,) for n in sorted(names)], "path string").mapInPandas(read, "path string, content binary")


def links(folder: str, spark) -> DataFrame:
    """Links of a folder's Markdown files that lead nowhere."""
    return broken_links(listing(folder, spark))


def broken_links(read: DataFrame) -> DataFrame:
    """Links of Markdown files (path, content) that lead to none of them: (path, target). Fenced code, code spans,
    anchors and addresses do not count; a path may climb to the folder above."""
    rel = F.col("path")
    known = read.select(F.col("path").alias("target")).distinct()
    line = read.withColumn("rel", rel).where("rel like '%.md'").select("rel", F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("k", "text"))
    w = Window.partitionBy("rel").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumn("mark", F.col("text").rlike(r"^\s*```").cast("int")).withColumn("open", F.sum("mark").over(w) % 2).where("open = 0 and mark = 0")
    text = F.regexp_replace("text", r"`[^`]*`", "")
    found = line.select("rel", F.explode(F.regexp_extract_all(text, F.lit(r"\]\(([^)#\s]+)[^)]*\)"), F.lit(1))).alias("to")).where("to not like '%://%'")
    found = found.withColumn("target", F.concat(F.regexp_extract("rel", r"^(.*/)?[^/]*$", 1), "to"))
    return found.join(known, "target", "left_anti").select(F.col("rel").alias("path"), "target")


def roundtrip(a: Analysis) -> DataFrame:
    """One row: spans that are identical, a subsequence of the original lines, or neither, white space aside."""
    original = a.files.select("file", F.col("text").alias("raw"))
    s = a.source.join(original, "file").withColumn("lines", F.array_join(F.slice(F.split("raw", r"\r?\n", -1), F.col("line"), F.greatest(F.col("end_line") - F.col("line") + 1, F.lit(0))), "\n"))
    s = s.select(squeezed(F.col("source")).alias("x"), squeezed(F.col("lines")).alias("y"))
    same = F.col("x") == F.col("y")
    part = F.when(same, False).otherwise(is_subsequence(F.col("x"), F.col("y")))
    return s.agg(F.sum(same.cast("long")).alias("identical"), F.sum(part.cast("long")).alias("subsequence"), F.sum((~same & ~part).cast("long")).alias("different"))


def checks(a: Analysis, folder: str) -> DataFrame:
    """(id, title, status, evidence), in order."""
    spark = a.spark
    one = lambda df: (df.first() or [0])[0] or 0
    p = a.file.where("variant = 'primary'")
    n_files, n_read = a.files.count(), p.count()
    errors = one(p.agg(F.sum("n_errors")))
    lost, code = one(a.file_coverage.agg(F.sum("unaccounted"))), one(a.file_coverage.agg(F.sum("code_lines")))
    odd = a.outline_mismatch.count()
    trip = roundtrip(a).first().asDict()
    expected = cards(a).select(F.explode(F.array(F.concat("path", F.lit(".md")), F.concat("path", F.lit(".json")))).alias("path"))
    have = listing(folder, spark).select("path", F.sha2("content", 256).alias("digest"))
    absent = expected.join(have, "path", "left_anti").count()
    broken = links(folder, spark).count()
    content = F.col("content") if "content" in a.files.columns else F.encode("text", "UTF-8")
    source = a.files.select(F.concat(F.lit("source/"), "file").alias("path"), F.sha2(content, 256).alias("want")).join(have, "path", "left").where("digest is null or digest <> want").count()
    dangling = a.file_need.join(p.select(F.col("file").alias("dst")), "dst", "left_anti").count()
    conf = a.confidence.first()["overall"]
    miss = a.missing.where("severity = 'HIGH'").count()
    say = lambda ok, warn=False: "PASS" if ok else "WARN" if warn else "FAIL"
    rows = [
        ("files", "every file was read", say(n_files == n_read), f"{n_read} of {n_files}"), ("syntax", "no syntax errors", say(errors == 0), f"{errors} errors"),
        ("coverage", "every code line belongs to something", say(lost == 0, lost * 100 < code), f"{lost} of {code} lines unaccounted for"), ("statements", "no statement was lost", say(odd == 0, True), f"{odd} routines differ"),
        ("roundtrip", "sources match the files", say((trip["different"] or 0) == 0), f"{trip['identical']} identical, {trip['subsequence']} in part, {trip['different']} different"), ("cards", "every routine has its card", say(absent == 0), f"{absent} missing"),
        ("links", "every link leads somewhere", say(broken == 0), f"{broken} broken"), ("source", "copies equal the files", say(source == 0), f"{source} differ"),
        ("crossfile", "what other files provide is here", say(dangling == 0 and miss == 0, dangling == 0), f"{miss} missing, {dangling} dangling"), ("confidence", "confidence", say(conf >= 90, conf >= 60), f"{conf} of 100"),
    ]
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "no int, id string, title string, status string, evidence string")


def verdict(check: DataFrame) -> str:
    rank = F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "WARN", 1).otherwise(0)
    return VERDICTS[check.agg(F.max(rank)).first()[0] or 0]


def write(a: Analysis, folder: str) -> str:
    """Check a written folder, add the report to it, and give the verdict."""
    check = checks(a, folder)
    said = verdict(check)
    rows = [r.asDict() for r in check.orderBy("no").collect()]
    os.makedirs(f"{folder}/analysis", exist_ok=True)
    with open(f"{folder}/analysis/verification.json", "w") as f:
        json.dump({"verdict": said, "checks": rows}, f, indent=1)
    with open(f"{folder}/analysis/verification.md", "w") as f:
        f.write("\n".join(["# Verification", "", said, "", grid(["check", "status", "evidence"], [[r["title"], r["status"], r["evidence"]] for r in rows])]) + "\n")
    return said
