"""Outline, exception contract, side effects and metrics: all aggregates and joins over the flat steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import builtins
from codeloom.operators.resolve import OWNER, owned
from codeloom.sources.files import Facts, stash

#: Kinds of steps by their part in metrics, and the verbs of DDL.
COMPOUND = ("IF", "CASE", "LOOP", "WHILE_LOOP", "FOR_LOOP", "CURSOR_FOR_LOOP", "BLOCK")
LOOPS = ("LOOP", "WHILE_LOOP", "FOR_LOOP", "CURSOR_FOR_LOOP", "FORALL")
DECISIONS = ("IF", "ELSIF", "WHEN", "LOOP", "WHILE_LOOP", "FOR_LOOP", "CURSOR_FOR_LOOP", "FORALL", "HANDLER", "GOTO")
DDL = ("TRUNCATE", "DROP", "ALTER", "CREATE", "COMMENT", "GRANT", "REVOKE", "ANALYZE", "RENAME")


def steps(facts: Facts, owner: DataFrame) -> DataFrame:
    """The outline, flat: path, its number 1.2.3, its parent's path and its depth."""
    s = owned(facts.table("step"), owner)
    text = lambda p: F.array_join(F.transform(p, lambda x: x.cast("string")), ".")
    return s.withColumn("depth", F.size("path")).withColumn("number", text(F.col("path"))).withColumn("parent_path", text(F.slice("path", 1, F.size("path") - 1)))


def claim(item: DataFrame, key: list[str]) -> DataFrame:
    """Each statement or call to the step that holds it, as the parser has found."""
    return item.where("step is not null").select(*OWNER, *key, F.col("step").alias("path"))


def above(path: Column) -> Column:
    """The paths of all steps around one."""
    return F.when(F.size(path) > 1, F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda k: F.slice(path, F.lit(1), k))).otherwise(F.array().cast("array<array<int>>"))


def counted(facts: Facts) -> DataFrame:
    """Statements of each owner as the parser met them (expected), and as there are steps of them (found)."""
    met = facts.table("count").withColumnRenamed("statements", "expected")
    got = facts.table("step").where("counts").groupBy(*OWNER).agg(F.count("*").alias("found"))
    return met.join(got, OWNER, "left").withColumn("found", F.coalesce("found", F.lit(0)))


def lossless(facts: Facts) -> DataFrame:
    """Owners, of either variant, whose counted statements differ from their steps."""
    return counted(facts).where("expected <> found")


def raises(step: DataFrame) -> DataFrame:
    how = F.when(F.col("exception") == "RAISE_APPLICATION_ERROR", "RAISE_APPLICATION_ERROR").when(F.col("exception").isNull(), "RE_RAISE").otherwise("RAISE")
    return step.where("kind = 'RAISE'").select("owner_id", *OWNER, "path", "exception", how.alias("how"), F.col("code").alias("error_code"), F.col("code_text").alias("code_expression"), "line")


def handlers(step: DataFrame) -> DataFrame:
    """Handlers with what the steps below them do."""
    h = step.where("kind = 'HANDLER'").select("owner_id", *OWNER, F.col("path").alias("h"), "exceptions", "line")
    # a step meets the handlers among the steps around it: one row for each, joined on equality
    d = step.where("kind <> 'HANDLER'").select(*OWNER, F.explode(above(F.col("path"))).alias("h"), "kind", "target")
    both = h.join(d, [*OWNER, "h"], "left")
    some = lambda cond: F.coalesce(F.max(F.coalesce(cond, F.lit(False))), F.lit(False))
    out = both.groupBy("owner_id", *OWNER, "h", "exceptions", "line").agg(
        some(F.col("kind") == "RAISE").alias("reraises"),
        (some(F.col("kind").isNotNull()) & ~some(F.col("kind") != "NULL")).alias("only_null"),
        some(F.col("kind").isin("CALL", "SQL", "DYNAMIC_SQL")).alias("calls_routines"),
        some((F.col("kind") == "RETURN") & (F.col("target") == "value")).alias("returns_value"),
        some(F.col("kind").isin("COMMIT", "ROLLBACK")).alias("ends_transaction"),
    )
    return out.withColumnRenamed("h", "path").withColumn("others", F.array_contains("exceptions", "OTHERS")).withColumn("swallows", ~F.col("reraises"))


def implicit_exceptions(sql: DataFrame) -> DataFrame:
    hit = sql.where("size(into) > 0 and not bulk_into and not dynamic and kind = 'SELECT'")
    return hit.select("owner_id", *OWNER, F.explode(F.array(F.lit("NO_DATA_FOUND"), F.lit("TOO_MANY_ROWS"))).alias("exception"), "line")


def effects(facts: Facts, unit: DataFrame, owner: DataFrame, sql: DataFrame, ref: DataFrame, call: DataFrame, names: DataFrame, chain: DataFrame) -> DataFrame:
    """Side effects, long: (owner_id, effect_kind, detail, line)."""
    cols = lambda df, kind, detail: df.select("owner_id", (F.lit(kind) if isinstance(kind, str) else kind).alias("effect_kind"), detail.alias("detail"), "line")
    own = owned(facts.table("effect"), owner)
    auto = owned(facts.table("decl").where("kind = 'PRAGMA' and name = 'AUTONOMOUS_TRANSACTION'"), owner)
    at = ref.join(sql.select(*OWNER, "stmt", "line"), [*OWNER, "stmt"])
    out = cols(own.where("kind <> 'AUTONOMOUS'"), F.col("kind"), F.col("detail"))
    for more in (
        cols(auto, "AUTONOMOUS", F.lit("")),
        cols(sql.where("dynamic"), "DYNAMIC_SQL", F.coalesce("dynamic_confidence", F.lit("UNKNOWN"))),
        cols(sql.where(F.col("dynamic") & F.col("dynamic_kind").isin(*DDL)), "DDL", F.col("dynamic_kind")),
        cols(sql.where("for_update"), "LOCK", F.lit("FOR UPDATE")),
        cols(at.where("array_contains(access, 'LOCK')"), "LOCK", F.concat(F.lit("LOCK TABLE "), "table_key")),
        cols(at.where("link is not null"), "DB_LINK", F.concat("table_key", F.lit("@"), F.upper("link"))),
        cols(call.where("link is not null"), "DB_LINK", F.concat(F.upper(F.array_join("parts", ".")), F.lit("@"), F.upper("link"))),
        cols(call.where("builtin_package is not null"), F.concat(F.lit("IO:"), builtins.category(F.col("builtin_package"))), F.concat("builtin_package", F.lit("."), F.upper("last"))),
        *package_state(facts, unit, owner, names),
    ):
        out = out.unionByName(more)
    return out


def package_state(facts: Facts, unit: DataFrame, owner: DataFrame, names: DataFrame) -> list[DataFrame]:
    """Reads and writes of package variables: a name that the nearest declaration puts at package level, not constant."""
    kinds = unit.select(F.col("file").alias("file"), "variant", "unit", F.col("kind").alias("unit_kind"))
    w = Window.partitionBy(*OWNER, "name").orderBy("dist", F.when(F.col("what") == "VARIABLE", 0).otherwise(1))
    nearest = names.join(kinds, ["file", "variant", "unit"]).withColumn("nth", F.row_number().over(w)).where("nth = 1 and what = 'VARIABLE' and level = 'PACKAGE' and not is_const and unit_kind like 'PACKAGE%'").select(*OWNER, F.col("name").alias("first"))
    nearest = stash(nearest, "nearest")
    target = facts.table("target")
    own = unit.select("file", "variant", "unit", "ukey")
    qualified = lambda df: df.where("second is not null").join(own, ["file", "variant", "unit"]).where("first = ukey").drop("ukey").withColumn("first", F.col("second"))
    writes = target.unionByName(qualified(target)).join(nearest, [*OWNER, "first"])
    reads = facts.table("call").where("not in_sql and not parens").select(*OWNER, F.lower(F.get("parts", F.lit(0))).alias("first"), F.lower(F.get("parts", F.lit(1))).alias("second"), "line")
    reads = reads.unionByName(qualified(reads)).join(nearest, [*OWNER, "first"])
    binds = facts.table("use").where("qualifier is null and role <> 'write'").select(*OWNER, "first", F.col("stmt")).join(nearest, [*OWNER, "first"]).join(facts.table("sql").select(*OWNER, F.col("seq").alias("stmt"), "line"), [*OWNER, "stmt"])
    shape = lambda df, kind: owned(df, owner).select("owner_id", F.lit(kind).alias("effect_kind"), F.upper("first").alias("detail"), "line")
    return [shape(writes, "STATE_WRITE"), shape(reads, "STATE_READ").unionByName(shape(binds, "STATE_READ"))]


def metrics(step: DataFrame, sql: DataFrame, call: DataFrame, routine: DataFrame) -> DataFrame:
    """Per owner: cyclomatic, statements, decision_points, loops, max_nesting, sql_statements, calls, lines_of_code."""
    s = step.groupBy("owner_id").agg(
        F.sum(F.col("kind").isin(*DECISIONS).cast("long")).alias("decision_points"), F.sum(F.col("counts").cast("long")).alias("statements"),
        F.sum(F.col("kind").isin(*LOOPS).cast("long")).alias("loops"),
    )
    # nesting: a compound step counts one for itself and each compound ancestor
    c = step.where(F.col("kind").isin(*COMPOUND)).select("owner_id", *OWNER, "path")
    around = c.select("owner_id", *OWNER, "path", F.explode(F.concat(above(F.col("path")), F.array("path"))).alias("around"))
    depth = around.join(c.select(*OWNER, F.col("path").alias("around")), [*OWNER, "around"]).groupBy("owner_id", *OWNER, "path").agg(F.count("*").alias("d"))
    nesting = depth.groupBy("owner_id").agg(F.max("d").alias("max_nesting"))
    q = sql.groupBy("owner_id").agg(F.count("*").alias("sql_statements"))
    k = call.groupBy("owner_id").agg(F.count("*").alias("calls"))
    loc = routine.groupBy(F.col("id").alias("owner_id")).agg(F.max(F.col("end_line") - F.col("line") + 1).cast("long").alias("lines_of_code"))
    out = loc.join(s, "owner_id", "full_outer").join(nesting, "owner_id", "left").join(q, "owner_id", "left").join(k, "owner_id", "left")
    zero = [c for c in out.columns if c != "owner_id"]
    return out.select("owner_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in zero), (F.coalesce("decision_points", F.lit(0)) + 1).cast("long").alias("cyclomatic"))


def touched(ref: DataFrame) -> DataFrame:
    """Tables read and written by each owner: READ and LOCK are reads, everything else writes."""
    write = F.size(F.array_except("access", F.array(F.lit("READ"), F.lit("LOCK")))) > 0
    read = F.arrays_overlap("access", F.array(F.lit("READ"), F.lit("LOCK")))
    return ref.groupBy("owner_id").agg(F.sort_array(F.collect_set(F.when(read, F.upper("table_key")))).alias("tables_read"), F.sort_array(F.collect_set(F.when(write, F.upper("table_key")))).alias("tables_written"))
