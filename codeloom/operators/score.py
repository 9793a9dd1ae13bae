"""Coverage of code lines, confidence scores and what is missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import grade, severity_rank

CAP, INFERRED_AT_MOST = 40, 4
CALL_PENALTY = {"UNRESOLVED": 8, "UNRESOLVED_IN_PACKAGE": 8, "EXTERNAL": 6}
DICTIONARY = r"^(DUAL$|ALL_|USER_|DBA_|V\$|GV\$|SYS\.|SYSTEM\.)"


def islands(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Runs of consecutive integers: (keys, from, to)."""
    w = Window.partitionBy(*keys).orderBy(value)
    g = rows.select(*keys, value).distinct().withColumn("run", F.col(value) - F.row_number().over(w))
    return g.groupBy(*keys, "run").agg(F.min(value).alias("from"), F.max(value).alias("to")).drop("run")


def interval_first(points: DataFrame, spans: DataFrame, keys: list[str], at: str, order: list[str]) -> DataFrame:
    """Each point to the first span (by ``order``) of its key that holds it; points outside all spans are kept."""
    hit = points.join(spans, keys, "left").where(F.col(at).between(F.col("line"), F.col("end_line")))
    w = Window.partitionBy(*keys, at).orderBy(*order)
    return hit.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def merged(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans (keys, line, end_line) put together where they touch or overlap."""
    w = Window.partitionBy(*keys).orderBy("line", "end_line")
    before = F.max("end_line").over(w.rowsBetween(Window.unboundedPreceding, -1))
    run = spans.withColumn("fresh", F.coalesce((F.col("line") > before + 1).cast("int"), F.lit(1))).withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(*keys, "run").agg(F.min("line").alias("line"), F.max("end_line").alias("end_line")).drop("run")


def coverage(file: DataFrame, source: DataFrame, unit: DataFrame, skipped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file_coverage, gaps). A code line is one that is not blank when masked; it belongs to a unit, else to a skipped
    item, else it is a terminator alone on its line, else it is unaccounted for."""
    p = file.where("variant = 'primary'")
    line = source.where("variant = 'primary'").select("file", F.posexplode(F.split("masked", r"\r?\n", -1)).alias("k", "text")).where("trim(text) <> ''").select("file", (F.col("k") + 1).alias("no"), F.trim("text").alias("text"))
    spans = unit.where("variant = 'primary'").select("file", "line", "end_line", F.lit(0).alias("bucket")).unionByName(skipped.where("variant = 'primary'").select("file", "line", "end_line", F.lit(1).alias("bucket")))
    # the lines of merged spans, so that a line is met once by each bucket, and by no span that it is not in
    lines = merged(spans.where("end_line >= line"), ["file", "bucket"]).select("file", F.explode(F.sequence("line", "end_line")).alias("no"), "bucket")
    covered = lines.groupBy("file", "no").agg(F.min("bucket").alias("bucket"))
    marked = line.join(covered, ["file", "no"], "left").withColumn("end", F.col("text").isin("/", ";"))
    total = p.select("file", F.col("n_lines").cast("long").alias("total_lines"))
    c = marked.groupBy("file").agg(
        F.count("*").alias("code_lines"), F.sum((F.col("bucket") == 0).cast("long")).alias("in_units"), F.sum((F.col("bucket") == 1).cast("long")).alias("in_skipped"),
        F.sum((F.col("bucket").isNull() & F.col("end")).cast("long")).alias("terminators"), F.sum((F.col("bucket").isNull() & ~F.col("end")).cast("long")).alias("unaccounted"),
    )
    zero = [k for k in c.columns if k != "file"]
    out = total.join(c, "file", "left").select("file", "total_lines", *(F.coalesce(k, F.lit(0)).alias(k) for k in zero))
    out = out.withColumn("percent", percent(F.col("code_lines"), F.col("unaccounted")))
    gaps = islands(marked.where("bucket is null and not end").select("file", F.col("no").alias("line")), ["file"], "line")
    return out, gaps


def percent(total: Column, lost: Column) -> Column:
    return F.when(total == 0, F.lit(100.0)).otherwise(100.0 * (total - lost) / total)


def running_cap(rows: DataFrame, keys: list[str], order: list[str], value: str, cap: int) -> DataFrame:
    """Rows whose running sum does not exceed the cap: the first that does, and all after it, go."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(value).over(w)).where(F.col("running") <= cap).drop("running")


def findings(population: DataFrame, call: DataFrame, sql: DataFrame, ref: DataFrame, step: DataFrame, file: DataFrame) -> DataFrame:
    """What lowers a routine's score: (owner_id, code, penalty, line)."""
    penalty = F.when(F.col("resolution").isin("UNRESOLVED", "UNRESOLVED_IN_PACKAGE"), 8).when(F.col("resolution") == "EXTERNAL", 6).when(F.size("targets") > 1, 4)
    code = F.when(F.col("resolution") == "EXTERNAL", "EXTERNAL_CALL").when(F.col("resolution").startswith("UNRESOLVED"), "UNRESOLVED_CALL").otherwise("AMBIGUOUS_OVERLOAD")
    calls = running_cap(call.withColumn("penalty", penalty).where("penalty is not null").select("owner_id", code.alias("code"), "penalty", "line", "offset"), ["owner_id"], ["offset"], "penalty", CAP).drop("offset")
    dynamic = sql.where("dynamic").select("owner_id", F.concat(F.lit("DYNAMIC_SQL_"), "dynamic_confidence").alias("code"), F.when(F.col("dynamic_confidence") == "UNKNOWN", 12).when(F.col("dynamic_confidence") == "PARTIAL", 6).otherwise(1).alias("penalty"), "line")
    inferred = ref.where("confidence = 'INFERRED'").join(sql.select("file", "variant", "unit", "routine", "stmt", "line"), ["file", "variant", "unit", "routine", "stmt"])
    w = Window.partitionBy("owner_id").orderBy("stmt", "ref")
    inferred = inferred.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= INFERRED_AT_MOST).select("owner_id", F.lit("INFERRED_TABLE").alias("code"), F.lit(3).alias("penalty"), "line")
    unknown = step.where("kind = 'UNKNOWN'").select("owner_id", F.lit("UNKNOWN_STEP").alias("code"), F.lit(10).alias("penalty"), "line")
    at = lambda df, code, points: df.select("owner_id", F.lit(code).alias("code"), F.lit(points).alias("penalty"), "line")
    files = file.where("variant = 'primary'").select("file", "n_errors", F.exists("conditions", lambda c: ~c["decided"]).alias("undecided"))
    p = population.join(files, "file", "left")
    parts = [calls, dynamic, inferred, unknown, at(p.where("variant = 'alternate'"), "ALTERNATE_VARIANT_ONLY", 5), at(p.where("undecided"), "UNDECIDED_IF", 3), at(p.where("visibility = 'UNKNOWN'"), "SPEC_NOT_SCANNED", 3), at(p.where("n_errors > 0"), "FILE_SYNTAX_ERRORS", 15)]
    known = population.select("owner_id")
    return reduce(DataFrame.unionByName, (x.withColumn("penalty", F.col("penalty").cast("long")) for x in parts)).join(known, "owner_id", "left_semi")


def scores(population: DataFrame, finding: DataFrame) -> DataFrame:
    total = finding.groupBy("owner_id").agg(F.sum("penalty").alias("penalty"))
    s = F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - F.coalesce("penalty", F.lit(0)))).cast("long")
    out = population.join(total, "owner_id", "left").withColumn("score", s)
    return out.select("owner_id", "file", "lines", "score", grade(F.col("score")).alias("grade"))


def file_scores(file: DataFrame, cover: DataFrame) -> DataFrame:
    f = file.where("variant = 'primary'").select("file", "n_errors", F.size(F.filter("conditions", lambda c: ~c["decided"])).alias("undecided"))
    penalty = 25 * F.least("n_errors", F.lit(3)) + F.ceil(100 - F.col("percent")) + F.least(F.lit(10), 2 * F.col("undecided"))
    out = f.join(cover.select("file", "percent"), "file").withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), 100 - penalty)).cast("long"))
    return out.select("file", "score", grade(F.col("score")).alias("grade"))


def overall(score: DataFrame, file_score: DataFrame) -> DataFrame:
    """One row: the routines' mean weighted by lines, the files' plain mean, and three quarters of one with a quarter of
    the other; without routines the files' mean."""
    r = score.agg(F.round(F.sum(F.col("lines") * F.col("score")) / F.sum("lines")).cast("long").alias("routine_score"), F.count("*").alias("routines"))
    f = file_score.agg(F.round(F.avg("score")).cast("long").alias("file_score"), F.count("*").alias("files"))
    both = r.join(f)  # two single rows
    whole = F.when(F.col("routines") > 0, F.round(0.75 * F.col("routine_score") + 0.25 * F.col("file_score"))).otherwise(F.col("file_score")).cast("long")
    return both.withColumn("overall", whole).withColumn("grade", grade(F.col("overall")))


def missing(tables: dict[str, DataFrame]) -> DataFrame:
    """What would have to be added: (kind, severity, name, used_by, file, line).

    ``tables`` has call, sql, ref, table_def, skipped, unit, file, gaps, issue, routine.
    """
    row = lambda df, kind, severity, name, user, file="file", line="line": df.groupBy(F.lit(kind).alias("kind"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), name.alias("name")).agg(F.sort_array(F.collect_set(user)).alias("used_by"), F.min_by(file, F.struct(file, line)).alias("file"), F.min_by(line, F.struct(file, line)).alias("line"))
    none = F.lit(None).cast("string")
    call, sql = tables["call"], tables["sql"]
    dotted = F.upper(F.array_join("parts", "."))
    known = tables["table_def"].select(F.upper("name").alias("bare"), F.upper("schema").alias("d_schema"))
    views = tables["skipped"].where("kind in ('create_view', 'create_materialized') and object <> ''").select(F.upper(F.element_at(F.split("object", r"\."), -1)).alias("bare"), F.when(F.instr("object", ".") > 0, F.upper(F.substring_index("object", ".", 1))).alias("d_schema"))
    known = known.unionByName(views).distinct()
    refs = tables["ref"].where("link is null").withColumn("bare", F.upper("table")).where(~F.upper("table_key").rlike(DICTIONARY))
    # a definition answers a name if one is the other's end: same bare name, and no two different schemas
    answered = refs.join(known, "bare").where("schema is null or d_schema is null or upper(schema) = d_schema").select("table_key").distinct()
    refs = refs.join(answered, "table_key", "left_anti").join(sql.select("file", "variant", "unit", "routine", "stmt", "line"), ["file", "variant", "unit", "routine", "stmt"])
    p = tables["unit"].where("variant = 'primary'")
    spec, body = p.where("kind = 'PACKAGE_SPEC'"), p.where("kind = 'PACKAGE_BODY'")
    parts = [
        row(call.where("resolution = 'EXTERNAL'"), "EXTERNAL_PACKAGE", "MEDIUM", F.upper(F.when(F.size("parts") > 1, F.array_join(F.slice("parts", 1, F.size("parts") - 1), ".")).otherwise(dotted)), F.col("owner_id")),
        row(call.where("resolution like 'UNRESOLVED%'"), "UNRESOLVED_CALL", "HIGH", dotted, F.col("owner_id")),
        row(sql.where("dynamic and dynamic_confidence = 'UNKNOWN'"), "DYNAMIC_SQL_OPAQUE", "HIGH", F.concat("owner_id", F.lit(":"), F.col("line").cast("string")), F.col("owner_id")),
        row(refs, "TABLE_DDL_MISSING", "LOW", F.upper("table_key"), F.col("owner_id")),
        row(tables["skipped"].where("variant = 'primary' and kind not in ('sqlplus', 'create_table', 'alter_table', 'create_view', 'create_materialized')"), "NOT_DECOMPOSED", F.when(F.col("kind").isin("create_type", "create_other"), "MEDIUM").otherwise("INFO"), F.col("name"), none),
        row(spec.join(body.select("ukey"), "ukey", "left_anti"), "BODY_NOT_SCANNED", "HIGH", F.upper("name"), none),
        row(body.join(spec.select("ukey"), "ukey", "left_anti"), "SPEC_NOT_SCANNED", "LOW", F.upper("name"), none),
        row(tables["issue"].where("code = 'syntax-error'"), "SYNTAX_ERRORS", "HIGH", F.col("file"), none),
        row(tables["issue"].where("code = 'undecided-conditional-compilation'"), "UNDECIDED_IF", "LOW", F.col("file"), none),
        row(tables["gaps"].withColumnRenamed("from", "line"), "UNACCOUNTED_LINES", "HIGH", F.col("file"), none),
        row(tables["routine"].where("variant = 'alternate'"), "ALTERNATE_VARIANT_ONLY", "LOW", F.col("id"), none),
    ]
    return reduce(DataFrame.unionByName, parts)


def missing_ordered(miss: DataFrame) -> DataFrame:
    """As it is shown: by severity, kind and name."""
    return miss.orderBy(severity_rank(F.col("severity")), "kind", "name")


def missing_counts(miss: DataFrame) -> DataFrame:
    return miss.groupBy("kind").agg(F.count("*").alias("n"))
