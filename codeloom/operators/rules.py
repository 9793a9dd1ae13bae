"""Rule tables: hazards of routines and notes on the database's semantics. A rule is a row, evaluation a union of filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import SEVERITIES, severity_rank

#: (code, severity, table, condition, line, message) in SQL expressions; the first of the handler rules that fits wins.
HANDLER_RULES = [
    ("WHEN_OTHERS_NULL", "HIGH", "only_null", "every error is dropped without a trace"),
    ("WHEN_OTHERS_RETURNS_DEFAULT", "MEDIUM", "returns_value and not calls_routines", "every error becomes a default result"),
    ("WHEN_OTHERS_SWALLOWED", "HIGH", "not calls_routines", "every error is swallowed"),
    ("WHEN_OTHERS_NO_RERAISE", "MEDIUM", "true", "every error is handled without being raised again"),
]
RULES = [
    ("APP_ERROR_CODE_OUT_OF_RANGE", "'MEDIUM'", "raise", "error_code is not null and error_code not between -20999 and -20000", "concat('error number ', error_code, ' is not one for applications')"),
    ("AUTONOMOUS_TRANSACTION", "'MEDIUM'", "effect", "effect_kind = 'AUTONOMOUS'", "'commits on its own, apart from its caller'"),
    ("DDL_IN_PLSQL", "'MEDIUM'", "effect", "effect_kind = 'DDL'", "concat(detail, ' ends the transaction and changes objects')"),
    ("ROW_LOCKING", "'INFO'", "effect", "effect_kind = 'LOCK'", "concat('locks: ', detail)"),
    ("DB_LINK", "'INFO'", "effect", "effect_kind = 'DB_LINK'", "concat('another database: ', detail)"),
    ("ROW_BY_ROW_DML", "'MEDIUM'", "sql", "in_loop and not bulk and kind in ('INSERT', 'UPDATE', 'DELETE', 'MERGE')", "concat(kind, ' for one row after another')"),
    ("SQL_IN_LOOP", "'LOW'", "sql", "in_loop and kind = 'SELECT'", "'a query in a loop'"),
    ("DYNAMIC_SQL_CONCATENATION", "if(asserted, 'LOW', 'HIGH')", "sql", "dynamic and dynamic_confidence <> 'LITERAL' and concatenated", "'statement text is put together from values'"),
    ("DYNAMIC_SQL_OPAQUE", "'MEDIUM'", "sql", "dynamic and dynamic_confidence = 'UNKNOWN' and not concatenated", "'statement text is not known here'"),
    ("UNBOUNDED_BULK_COLLECT", "'MEDIUM'", "sql", "kind = 'SELECT' and bulk_into and size(into) > 0", "'a query is read into memory as a whole'"),
    ("OPTIMIZER_HINT", "'INFO'", "sql", "hint", "'a hint for the optimizer'"),
    ("UNBOUNDED_BULK_COLLECT", "'MEDIUM'", "step", "kind = 'FETCH' and bulk and not limit", "'a cursor is read into memory without a limit'"),
    ("GOTO_USED", "'LOW'", "step", "kind = 'GOTO'", "concat('jump to ', text)"),
    ("UNRESOLVED_CALL", "'INFO'", "call", "resolution in ('UNRESOLVED', 'EXTERNAL', 'UNRESOLVED_IN_PACKAGE')", "concat('not found here: ', array_join(parts, '.'))"),
    ("AMBIGUOUS_OVERLOAD", "'INFO'", "call", "size(targets) > 1", "concat('may be any of: ', array_join(targets, ', '))"),
    ("HIGH_COMPLEXITY", "if(cyclomatic > 50, 'HIGH', 'MEDIUM')", "metric", "cyclomatic > 20", "concat('cyclomatic complexity ', cyclomatic)"),
    ("LONG_ROUTINE", "'LOW'", "metric", "lines_of_code > 300", "concat(lines_of_code, ' lines')"),
    ("DEEP_NESTING", "'LOW'", "metric", "max_nesting >= 6", "concat('nested ', max_nesting, ' deep')"),
]
RISKY_IO = ("NETWORK", "FILE_IO", "SCHEDULER")
QUIET_IO = ("CONSOLE", "OTHER_BUILTIN", "LOB", "XML", "CRYPTO_RANDOM", "ADMIN")


def risks(tables: dict[str, DataFrame], places: DataFrame) -> DataFrame:
    """All risks: (code, severity, message, owner_id, file, line).

    ``tables`` has raise, handler, implicit, effect, sql, step, call, metric, each with owner_id; ``places`` has
    owner_id, file and first line. A risk without a line stands at the first line of its owner.
    """
    out = []
    for code, severity, name, condition, message in RULES:
        t = tables[name]
        line = F.col("line") if "line" in t.columns else F.lit(0)
        out.append(t.where(condition).select(F.lit(code).alias("code"), F.expr(severity).alias("severity"), F.expr(message).alias("message"), "owner_id", line.alias("line")))
    h = tables["handler"].where("others and swallows")
    pick = lambda k: reduce(lambda acc, rule: F.when(F.expr(rule[2]), rule[k]).otherwise(acc), reversed(HANDLER_RULES[:-1]), F.lit(HANDLER_RULES[-1][k]))
    out.append(h.select(pick(0).alias("code"), pick(1).alias("severity"), pick(3).alias("message"), "owner_id", "line"))
    covered = tables["handler"].where("others or array_contains(exceptions, 'NO_DATA_FOUND')").select("owner_id").distinct()
    open_ = tables["implicit"].where("exception = 'NO_DATA_FOUND'").join(covered, "owner_id", "left_anti").groupBy("owner_id").agg(F.min("line").alias("line"))
    out.append(open_.select(F.lit("SELECT_INTO_NO_HANDLER").alias("code"), F.lit("LOW").alias("severity"), F.lit("a query for one row, and no handler for none").alias("message"), "owner_id", "line"))
    e = tables["effect"]
    alone = e.where("effect_kind = 'AUTONOMOUS'").select("owner_id").distinct()
    commit = F.when(F.col("effect_kind") == "COMMIT", F.col("line"))
    ends = e.where("effect_kind in ('COMMIT', 'ROLLBACK')").join(alone, "owner_id", "left_anti").groupBy("owner_id").agg(F.coalesce(F.min(commit), F.min("line")).alias("line"))
    out.append(ends.select(F.lit("COMMIT_IN_ROUTINE").alias("code"), F.lit("MEDIUM").alias("severity"), F.lit("ends its caller's transaction").alias("message"), "owner_id", "line"))
    state = e.where("effect_kind = 'STATE_WRITE'").groupBy("owner_id").agg(F.array_join(F.sort_array(F.collect_set("detail")), ", ").alias("what"))
    out.append(state.select(F.lit("PACKAGE_STATE_WRITE").alias("code"), F.lit("INFO").alias("severity"), F.concat(F.lit("changes the package's state: "), "what").alias("message"), "owner_id", F.lit(0).alias("line")))
    io = e.where("effect_kind like 'IO:%'").withColumn("category", F.substr("effect_kind", F.lit(4))).where(~F.col("category").isin(*QUIET_IO))
    io = io.groupBy("owner_id", "category").agg(F.array_join(F.sort_array(F.collect_set("detail")), ", ").alias("what"))
    out.append(io.select(F.lit("EXTERNAL_SIDE_EFFECT").alias("code"), F.when(F.col("category").isin(*RISKY_IO), "MEDIUM").otherwise("INFO").alias("severity"), F.concat("category", F.lit(": "), "what").alias("message"), "owner_id", F.lit(0).alias("line")))
    every = reduce(DataFrame.unionByName, out)
    placed = every.join(places.select("owner_id", "file", F.col("line").alias("start")), "owner_id", "left")
    return placed.select("code", "severity", "message", "owner_id", "file", F.when(F.coalesce("line", F.lit(0)) == 0, F.col("start")).otherwise(F.col("line")).alias("line"))


def ordered(risk: DataFrame) -> DataFrame:
    """Risks as they are shown: the gravest first, then by code, owner and line."""
    return risk.orderBy(severity_rank(F.col("severity")), "code", F.asc_nulls_first("owner_id"), "line", "message")


def risk_counts(risk: DataFrame) -> DataFrame:
    return risk.groupBy("severity", "code").agg(F.count("*").alias("n"))


def at_least(risk: DataFrame, severity: str) -> DataFrame:
    return risk.where(severity_rank(F.col("severity")) <= SEVERITIES.index(severity))


def risk_pivot(risk: DataFrame, by: str | Column) -> DataFrame:
    return risk.groupBy(by).agg(*(F.sum((F.col("severity") == s).cast("long")).alias(s.lower()) for s in SEVERITIES))


#: Fixed values: (topic, pattern on masked source, note).
NOTES = [
    ("null functions", r"(?i)\b(nvl2?|coalesce|nullif|decode)\s*\(|\bis\s+(not\s+)?null\b", "Null handling: decode treats two nulls as equal."),
    ("row numbers", r"(?i)\brownum\b", "ROWNUM is given before sorting."),
    ("row addresses", r"(?i)\browid\b", "ROWID is a physical address."),
    ("server clock", r"(?i)\b(sysdate|systimestamp|current_date|current_timestamp)\b", "The clock of the server or the session is read."),
    ("conversions", r"(?i)\bto_(char|date|number|timestamp)\s*\(", "Conversions depend on the session's formats."),
    ("session context", r"(?i)\b(sys_context|userenv)\s*\(|\buser\b", "The session's identity is read."),
    ("anchored types", r"(?i)%\s*(row)?type\b", "Types follow columns that are defined elsewhere."),
    ("index-by tables", r"(?i)\bindex\s+by\b", "Sparse arrays: keys need not be dense."),
    ("collections", r"(?i)\.(count|first|last|next|prior|extend|trim|exists)\b|\bvarray\b|\bnested\s+table\b|\btable\s+of\b", "Collections start at 1."),
    ("bulk work", r"(?i)\b(bulk\s+collect|forall)\b", "Rows move in bulk between engines."),
    ("cursor attributes", r"(?i)%\s*(found|notfound|rowcount|isopen|bulk_rowcount)\b", "Attributes speak of the last statement."),
    ("error numbers", r"(?i)\b(sqlcode|sqlerrm)\b", "Error number and text of the session."),
    ("trigger rows", r"(?i):\s*(new|old)\b", "Values of the row before and after a change."),
    ("row locks", r"(?i)\bfor\s+update\b", "Rows are locked until the transaction ends."),
    ("hierarchies", r"(?i)\bconnect\s+by\b|\bstart\s+with\b", "Hierarchical query."),
    ("merging", r"(?i)\bmerge\s+into\b", "Rows are updated or inserted in one statement."),
    ("pipelines", r"(?i)\bpipe\s+row\b", "Rows are returned one after another while it runs."),
    ("application errors", r"(?i)\braise_application_error\b", "Numbers -20000 to -20999 are the application's."),
    ("console", r"(?i)\bdbms_output\b", "Console output is seen after the call, if at all."),
]
ATTRIBUTE_NOTES = [
    ("PIPELINED", "array_contains(attributes, 'PIPELINED')", "Its rows are read like a table."), ("DETERMINISTIC", "array_contains(attributes, 'DETERMINISTIC')", "Results may be kept for equal arguments."),
    ("RESULT_CACHE", "array_contains(attributes, 'RESULT_CACHE')", "Results are cached across sessions."), ("AUTONOMOUS_TRANSACTION", "array_contains(attributes, 'AUTONOMOUS_TRANSACTION')", "It has a transaction of its own."),
    ("CURRENT_USER", "array_contains(attributes, 'INVOKER_RIGHTS')", "It runs with the caller's rights."), ("NOCOPY", "exists(params, p -> contains(p.mode, 'NOCOPY'))", "Arguments may be passed by reference."),
    ("OUT", "exists(params, p -> contains(p.mode, 'OUT'))", "Results leave through parameters."), ("variants", "variant = 'alternate'", "Only one branch of conditional compilation has it."),
]


def notes(rows: DataFrame) -> DataFrame:
    """Notes of routines: rows (id, masked, source, attributes, params, variant) to (id, topic, note)."""
    hits = [F.when(F.col("masked").rlike(p), F.struct(F.lit(t).alias("topic"), F.lit(n).alias("note"))) for t, p, n in NOTES]
    hits.append(F.when(F.col("source").rlike(r"(?<!')''(?!')"), F.struct(F.lit("empty text").alias("topic"), F.lit("An empty text is null.").alias("note"))))
    hits += [F.when(F.expr(c), F.struct(F.lit(t).alias("topic"), F.lit(n).alias("note"))) for t, c, n in ATTRIBUTE_NOTES]
    return rows.select("id", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("n")).select("id", "n.topic", "n.note")
