"""Registered queries over the corpus of samples, each with the SQL that must give the same rows.

The SQL is the list of what a reader of the sample texts expects, for each ``nation``; it never sees a program. In it, ~
stands for the number of the nation, as in the texts, and ^ for ~.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import effects, graph, rules, score
from codeloom.plans import docs, verify, views
from codeloom.plans.catalog import query
from codeloom.plans.engine import Analysis, of_samples
from codeloom.sources.samples import CONSTRUCTS, EVERY_STEPS, RISKY

TEXT, INT, LONG, BOOL = "varchar", "integer", "bigint", "boolean"


def lit(x: object) -> str:
    if x is None:
        return "null"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, int | float):
        return str(x)
    text = "'" + str(x).replace("'", "''") + "'"
    text = f"replace({text}, '~', cast(n_nationkey as varchar))" if "~" in text else text
    return f"replace({text}, '^', '~')" if "^" in text else text


def each(columns: dict[str, str], rows: Iterable[tuple]) -> str:
    """SQL of the rows for each nation; ``columns`` are names with their types."""
    one = lambda row: "select " + ", ".join(f'cast({lit(v)} as {t}) as "{c}"' for v, (c, t) in zip(row, columns.items(), strict=True)) + " from nation"
    return " union all ".join(one(r) for r in rows)


def sampled(sql: str | None):
    """A query of the analysis of the samples."""

    def put(f: Callable[[Analysis], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(of_samples(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        return query(sql)(run)

    return put


def joined(c: str):
    return F.array_join(c, ",")


_OUTLINE = [("EVERY_~", n, k) for n, k in EVERY_STEPS]
_OUTLINE += [("ROWS_~", "1", "CURSOR_FOR_LOOP"), ("ROWS_~", "1.1", "PIPE_ROW"), ("ROWS_~", "2", "RETURN"), ("TRIGGER:STAFF_BI_~", "1", "IF"), ("TRIGGER:STAFF_BI_~", "1.1", "THEN"), ("TRIGGER:STAFF_BI_~", "1.1.1", "SQL"), ("TRIGGER:STAFF_BI_~", "2", "SQL")]


@sampled(each({"owner_id": TEXT, "number": TEXT, "kind": TEXT, "depth": INT}, [(*r, r[1].count(".") + 1) for r in _OUTLINE]))
def sample_outline(a):
    return a.step.where("owner_id like 'EVERY%' or owner_id like 'ROWS%' or owner_id like 'TRIGGER%'").select("owner_id", "number", "kind", "depth")


_RISKS = [(f"{name.upper()}_~", code, severity, line) for name, _, found in RISKY for code, severity, line in found] + [
    ("<anonymous@1>:n~/once.sql", "AMBIGUOUS_OVERLOAD", "INFO", 4), ("EVERY_~", "COMMIT_IN_ROUTINE", "MEDIUM", 57), ("EVERY_~", "GOTO_USED", "LOW", 55), ("GIVES_DEFAULT_~", "WHEN_OTHERS_RETURNS_DEFAULT", "MEDIUM", 5),
    ("OVER_~.<init>", "AMBIGUOUS_OVERLOAD", "INFO", 28), ("OVER_~.PUT#1", "PACKAGE_STATE_WRITE", "INFO", 4), ("OVER_~.PUT#1>INNER_P", "PACKAGE_STATE_WRITE", "INFO", 5), ("TRIGGER:STAFF_BI_~", "SELECT_INTO_NO_HANDLER", "LOW", 4),
]


@sampled(each({"owner_id": TEXT, "code": TEXT, "severity": TEXT, "line": INT}, _RISKS))
def sample_risks(a):
    return a.risk.where("file not like '%/sql\\\\_%'").select("owner_id", "code", "severity", "line")


@sampled(each({"construct": TEXT, "table_key": TEXT, "access": TEXT}, [(name, (t if t.startswith("OTHER") else t) + "_~", how) for name, _, tables in CONSTRUCTS for t, how in tables]))
def sample_constructs(a):
    r = a.ref.where("file like '%/sql\\\\_%'")
    return r.select(F.regexp_extract("file", "/sql_(.*)[.]sql$", 1).alias("construct"), "table_key", joined(F.sort_array("access")).alias("access"))


@sampled(each({"owner_id": TEXT, "kind": TEXT, "n": LONG}, [(f"C_{name.upper()}_~", ("SELECT" if text.split()[0] == "WITH" else text.split()[0]), 1) for name, text, _ in CONSTRUCTS]))
def sample_statements(a):
    """No construct is an error, an unknown step or a call."""
    bad = a.step.where("kind = 'UNKNOWN'").select("file").union(a.fact("error").select("file")).union(a.call.where("resolution like 'UNRESOLVED%'").select("file")).distinct()
    return a.sql.where("file like '%/sql\\\\_%'").join(bad, "file", "left_anti").groupBy("owner_id", "kind").agg(F.count("*").alias("n"))


@sampled(each({"file": TEXT, "variant": TEXT, "kind": TEXT, "name": TEXT, "authid": TEXT, "has_init": BOOL, "trigger_header": TEXT}, [
    ("n~/broken.sql", "primary", "PROCEDURE", "broken_~", None, False, None), ("n~/cycle.sql", "primary", "PROCEDURE", "ping_~", None, False, None), ("n~/cycle.sql", "primary", "PROCEDURE", "pong_~", None, False, None),
    ("n~/default.sql", "primary", "FUNCTION", "gives_default_~", None, False, None), ("n~/every.sql", "primary", "PROCEDURE", "every_~", None, False, None), ("n~/every.sql", "primary", "FUNCTION", "rows_~", None, False, None),
    ("n~/hidden.pkb", "primary", "PACKAGE_BODY", "hidden_~", None, False, None), ("n~/lone.pks", "primary", "PACKAGE_SPEC", "lone_~", None, False, None), ("n~/once.sql", "primary", "ANONYMOUS_BLOCK", "<anonymous@1>", None, False, None),
    ("n~/over.pkb", "primary", "PACKAGE_BODY", "over_~", None, True, None), ("n~/over.pks", "primary", "PACKAGE_SPEC", "over_~", "CURRENT_USER", False, None),
    ("n~/staff.trg", "primary", "TRIGGER", "staff_bi_~", None, False, "BEFORE INSERT ON staff_~ FOR EACH ROW"),
    ("n~/variants.sql", "primary", "PROCEDURE", "both_~", None, False, None), ("n~/variants.sql", "primary", "PROCEDURE", "other_~", None, False, None), ("n~/variants.sql", "alternate", "PROCEDURE", "both_~", None, False, None), ("n~/variants.sql", "alternate", "PROCEDURE", "third_~", None, False, None),
]))
def sample_units(a):
    return a.unit.where("file not like '%/sql\\\\_%' and file not like '%/risk\\\\_%'").select("file", "variant", "kind", "name", "authid", "has_init", "trigger_header")


@sampled(each({"id": TEXT, "visibility": TEXT, "has_body": BOOL, "attributes": TEXT, "spec_file": TEXT, "file": TEXT}, [
    ("HIDDEN_~.RUN", "UNKNOWN", True, "", None, "n~/hidden.pkb"), ("LONE_~.RUN", "PUBLIC", False, "", None, "n~/lone.pks"), ("OVER_~.LATER", "PRIVATE", True, "", None, "n~/over.pkb"),
    ("OVER_~.MADE", "PUBLIC", True, "RESULT_CACHE", "n~/over.pks", "n~/over.pkb"), ("OVER_~.MISSING_BODY", "PUBLIC", False, "", None, "n~/over.pks"), ("OVER_~.PUT#1", "PUBLIC", True, "", "n~/over.pks", "n~/over.pkb"),
    ("OVER_~.PUT#1>INNER_P", "LOCAL", True, "", None, "n~/over.pkb"), ("OVER_~.PUT#2", "PUBLIC", True, "", "n~/over.pks", "n~/over.pkb"),
    ("ROWS_~", "STANDALONE", True, "PIPELINED,DETERMINISTIC", None, "n~/every.sql"), ("THIRD_~^ALT", "STANDALONE", True, "", None, "n~/variants.sql"),
]))
def sample_routines(a):
    """Overloads, nested and forward routines, bodies without a specification and the other way round."""
    return a.routine.where("owner is not null or size(attributes) > 0 and id like 'ROWS%' or variant = 'alternate'").select("id", "visibility", "has_body", joined("attributes").alias("attributes"), "spec_file", "file")


@sampled(each({"owner_id": TEXT, "name": TEXT, "mode": TEXT, "type": TEXT, "default_text": TEXT}, [
    ("EVERY_~", "p_in", "IN", "NUMBER", None), ("EVERY_~", "p_out", "OUT NOCOPY", "NUMBER", None), ("EVERY_~", "p_io", "IN OUT", "VARCHAR2", None), ("OVER_~.LATER", "p_a", "IN", "NUMBER", None), ("OVER_~.MADE", "p_a", "IN", "NUMBER", None), ("OVER_~.MADE", "p_b", "IN", "NUMBER", "1"),
    ("OVER_~.MISSING_BODY", "p_a", "IN", "NUMBER", None), ("OVER_~.PUT#1", "p_a", "IN", "NUMBER", None), ("OVER_~.PUT#2", "p_b", "IN", "VARCHAR2", None),
]))
def sample_parameters(a):
    p = a.routine.where("id like 'EVERY%' or id like 'OVER%'").select(F.col("id").alias("owner_id"), F.explode("params").alias("p"))
    return p.select("owner_id", "p.name", "p.mode", "p.type", "p.default_text")


@sampled(each({"kind": TEXT, "name": TEXT, "type": TEXT, "is_const": BOOL, "not_null": BOOL, "default_text": TEXT, "type_kind": TEXT, "error_code": INT}, [
    ("VARIABLE", "c_max", "PLS_INTEGER", True, False, "10", None, 0), ("VARIABLE", "v_n", "NUMBER", False, True, "0", None, 0), ("VARIABLE", "v_t", "staff_~.name%TYPE", False, False, None, None, 0),
    ("TYPE", "t_rec", None, False, False, None, "RECORD", 0), ("TYPE", "t_tab", None, False, False, None, "TABLE", 0), ("TYPE", "t_small", None, False, False, None, "SUBTYPE", 0), ("VARIABLE", "l_tab", "t_tab", False, False, None, None, 0),
    ("EXCEPTION", "e_bad", None, False, False, None, None, -20010), ("PRAGMA", "EXCEPTION_INIT", None, False, False, None, None, 0), ("VARIABLE", "rc", "SYS_REFCURSOR", False, False, None, None, 0), ("CURSOR", "c_all", None, False, False, None, None, 0),
    ("LOOP_VARIABLE", "i", None, False, False, None, None, 0), ("LOOP_VARIABLE", "i", None, False, False, None, None, 0), ("LOOP_VARIABLE", "r", None, False, False, None, None, 0), ("VARIABLE", "x", "NUMBER", False, False, None, None, 0),
]))
def sample_declarations(a):
    return a.declaration.where("owner_id like 'EVERY%'").select("kind", "name", "type", "is_const", "not_null", "default_text", "type_kind", F.coalesce("error_code", F.lit(0)).alias("error_code"))


@sampled(each({"severity": TEXT, "code": TEXT, "file": TEXT, "line": INT}, [
    ("ERROR", "syntax-error", "n~/broken.sql", 5), ("ERROR", "syntax-error", "n~/broken.sql", 6), ("ERROR", "spec-routine-without-body", "n~/over.pks", 8), ("WARN", "spec-without-body", "n~/lone.pks", 1), ("WARN", "body-without-spec", "n~/hidden.pkb", 1),
    ("INFO", "undecided-conditional-compilation", "n~/variants.sql", 3), ("INFO", "undecided-conditional-compilation", "n~/variants.sql", 10),
]))
def sample_issues(a):
    return a.issue.select("severity", "code", "file", "line")


_MISSING = [
    ("DYNAMIC_SQL_OPAQUE", "HIGH", "OPAQUE_~:3"), ("EXTERNAL_PACKAGE", "MEDIUM", "ELSEWHERE_~"), ("UNRESOLVED_CALL", "HIGH", "NOWHERE_~"), ("NOT_DECOMPOSED", "INFO", "CREATE SEQUENCE seq_~"), ("BODY_NOT_SCANNED", "HIGH", "LONE_~"), ("SPEC_NOT_SCANNED", "LOW", "HIDDEN_~"),
    ("SYNTAX_ERRORS", "HIGH", "n~/broken.sql"), ("UNDECIDED_IF", "LOW", "n~/variants.sql"), ("UNACCOUNTED_LINES", "HIGH", "n~/broken.sql"), ("ALTERNATE_VARIANT_ONLY", "LOW", "THIRD_~^ALT"), *(("TABLE_DDL_MISSING", "LOW", t) for t in ("T1_~", "T2_~", "T3_~", "T4_~", "OTHER.T1_~")),
]


@sampled(each({"kind": TEXT, "severity": TEXT, "name": TEXT}, _MISSING) + " union all select * from (values ('NOT_DECOMPOSED', 'INFO', 'stray words here'), ('NOT_DECOMPOSED', 'MEDIUM', 'CREATE OR REPLACE TYPE t_list AS TABLE OF NUMBER;')) v")
def sample_missing(a):
    return a.missing.select("kind", "severity", "name")


@sampled(each({"kind": TEXT, "used_by": TEXT}, [("DYNAMIC_SQL_OPAQUE", "OPAQUE_~"), ("EXTERNAL_PACKAGE", "UNKNOWN_~"), ("UNRESOLVED_CALL", "UNKNOWN_~"), ("TABLE_DDL_MISSING", "C_SCHEMA_NAMES_~")]))
def sample_missing_users(a):
    return a.missing.where("size(used_by) = 1").select("kind", joined("used_by").alias("used_by"))


@sampled(each({"component": TEXT, "members": TEXT}, [("OVER_~.MADE", "OVER_~.MADE"), ("PING_~", "PING_~,PONG_~")]))
def sample_recursion(a):
    return a.recursion.select("component", joined("members").alias("members"))


@sampled(each({"node": TEXT, "component": TEXT, "batch": INT}, [
    ("OVER_~.MADE", "OVER_~.MADE", 0), ("OVER_~.MISSING_BODY", "OVER_~.MISSING_BODY", 0), ("OVER_~.PUT#1>INNER_P", "OVER_~.PUT#1>INNER_P", 0), ("PING_~", "PING_~", 0), ("PONG_~", "PING_~", 0), ("OVER_~.LATER", "OVER_~.LATER", 1), ("OVER_~.PUT#1", "OVER_~.PUT#1", 1), ("OVER_~.PUT#2", "OVER_~.PUT#2", 2),
    ("AMBIGUOUS_~", "AMBIGUOUS_~", 3), ("OTHERS_CALL_~", "OTHERS_CALL_~", 1), ("OTHERS_NULL_~", "OTHERS_NULL_~", 0),
]))
def sample_batches(a):
    """Batches where routines call each other in a circle."""
    return a.batch.where("node like 'P%' or node like 'OVER%' or node like 'AMBIGUOUS%' or node like 'OTHERS~_CALL%' escape '~' or node like 'OTHERS~_NULL%' escape '~'").select("node", "component", "batch")


@sampled(each({"node": TEXT, "what": TEXT}, [("HIDDEN_~.RUN", "ENTRY_POINT"), ("LONE_~.RUN", "ENTRY_POINT"), ("OVER_~.MISSING_BODY", "ENTRY_POINT"), ("ROWS_~", "ENTRY_POINT"), ("EVERY_~", "ENTRY_POINT"), ("THIRD_~^ALT", "ENTRY_POINT")]))
def sample_uncalled(a):
    return a.uncalled.where("node like '%.%' or node like 'ROWS%' or node like 'EVERY%' or node like 'THIRD%'").select("node", "what")


@sampled(each({"owner_id": TEXT, "effect_kind": TEXT, "detail": TEXT, "line": INT}, [
    ("ALONE_~", "AUTONOMOUS", "", 2), ("ALONE_~", "COMMIT", "", 4), ("ASSERTED_~", "DDL", "DROP", 3), ("ASSERTED_~", "DYNAMIC_SQL", "PARTIAL", 3), ("ASSERTED_~", "IO:OTHER_BUILTIN", "DBMS_ASSERT.SIMPLE_SQL_NAME", 3), ("COMMITS_~", "COMMIT", "", 4), ("COMMITS_~", "ROLLBACK", "", 5),
    ("C_FOR_UPDATE_~", "LOCK", "FOR UPDATE", 3), ("C_LOCK_~", "LOCK", "LOCK TABLE T1_~", 3), ("C_LOCK_~", "LOCK", "LOCK TABLE T2_~", 3), ("DDL_~", "DDL", "TRUNCATE", 3), ("DDL_~", "DYNAMIC_SQL", "LITERAL", 3),
    ("EVERY_~", "COMMIT", "", 57), ("EVERY_~", "DYNAMIC_SQL", "LITERAL", 48), ("EVERY_~", "ROLLBACK", "TO sp", 56), ("EVERY_~", "ROLLBACK", "", 67), ("EVERY_~", "SAVEPOINT", "sp", 16), ("EVERY_~", "SET_TRANSACTION", "READ ONLY", 54),
    ("FAR_~", "DB_LINK", "LOG_~@ELSEWHERE", 3), ("JOINED_TEXT_~", "DYNAMIC_SQL", "PARTIAL", 3), ("LOCKS_~", "LOCK", "FOR UPDATE", 4), ("LOCKS_~", "LOCK", "LOCK TABLE LOG_~", 3), ("NETWORK_~", "IO:CONSOLE", "DBMS_OUTPUT.PUT_LINE", 4), ("NETWORK_~", "IO:NETWORK", "UTL_HTTP.REQUEST", 3),
    ("OPAQUE_~", "DYNAMIC_SQL", "UNKNOWN", 3), ("OVER_~.PUT#1", "SEQUENCE", "SEQ_~", 11), ("OVER_~.PUT#1", "STATE_WRITE", "G_STATE", 11), ("OVER_~.PUT#1>INNER_P", "STATE_READ", "G_STATE", 7), ("OVER_~.PUT#1>INNER_P", "STATE_WRITE", "V_HIDDEN", 7),
    ("SESSION_~", "IO:SESSION", "DBMS_SESSION.SET_ROLE", 3), ("TRIGGER:STAFF_BI_~", "SEQUENCE", "SEQ_~", 4),
]))
def sample_effects(a):
    return a.effect.select("owner_id", "effect_kind", "detail", "line")


_HANDLERS = {"owner_id": TEXT, "exceptions": TEXT, "reraises": BOOL, "only_null": BOOL, "calls_routines": BOOL, "returns_value": BOOL, "ends_transaction": BOOL, "swallows": BOOL, "line": INT}


@sampled(each(_HANDLERS, [
    ("EVERY_~", "E_BAD", True, False, False, False, False, False, 62), ("EVERY_~", "NO_DATA_FOUND,TOO_MANY_ROWS", False, False, False, False, False, True, 64), ("EVERY_~", "OTHERS", True, False, False, False, True, False, 66),
    ("GIVES_DEFAULT_~", "OTHERS", False, False, False, True, False, True, 5), ("HANDLED_~", "NO_DATA_FOUND", True, False, False, False, False, False, 5), ("IN_LOOP_~", "NO_DATA_FOUND", True, False, False, False, False, False, 7), ("LOCKS_~", "NO_DATA_FOUND", True, False, False, False, False, False, 6),
    ("OTHERS_CALL_~", "OTHERS", False, False, True, False, False, True, 5), ("OTHERS_DEFAULT_~", "OTHERS", False, False, False, False, False, True, 5), ("OTHERS_NULL_~", "OTHERS", False, True, False, False, False, True, 5),
]))
def sample_handlers(a):
    return a.handler.select(*(joined(c).alias(c) if c == "exceptions" else c for c in _HANDLERS))


@sampled(each({"owner_id": TEXT, "how": TEXT, "exception": TEXT, "error_code": INT, "line": INT}, [
    ("BAD_CODE_~", "RAISE_APPLICATION_ERROR", "RAISE_APPLICATION_ERROR", -30000, 3), ("EVERY_~", "RAISE", "E_BAD", 0, 58), ("EVERY_~", "RAISE_APPLICATION_ERROR", "RAISE_APPLICATION_ERROR", -20001, 59), ("EVERY_~", "RE_RAISE", None, 0, 63), ("EVERY_~", "RE_RAISE", None, 0, 68),
    ("HANDLED_~", "RE_RAISE", None, 0, 6), ("IN_LOOP_~", "RE_RAISE", None, 0, 8), ("LOCKS_~", "RE_RAISE", None, 0, 7),
]))
def sample_raises(a):
    return a.raises.select("owner_id", "how", "exception", F.coalesce("error_code", F.lit(0)).alias("error_code"), "line")


@sampled(each({"owner_id": TEXT, "callee": TEXT, "resolution": TEXT, "targets": TEXT, "builtin_package": TEXT}, [
    ("<anonymous@1>:n~/once.sql", "over_~.put", "INTERNAL", "OVER_~.PUT#1,OVER_~.PUT#2", None), ("AMBIGUOUS_~", "over_~.put", "INTERNAL", "OVER_~.PUT#1,OVER_~.PUT#2", None), ("OVER_~.<init>", "put", "INTERNAL", "OVER_~.PUT#1,OVER_~.PUT#2", None),
    ("ASSERTED_~", "dbms_assert.simple_sql_name", "BUILTIN", None, "DBMS_ASSERT"), ("BAD_CODE_~", "RAISE_APPLICATION_ERROR", "BUILTIN", None, None), ("EVERY_~", "RAISE_APPLICATION_ERROR", "BUILTIN", None, None), ("NETWORK_~", "utl_http.request", "BUILTIN", None, "UTL_HTTP"), ("NETWORK_~", "dbms_output.put_line", "BUILTIN", None, "DBMS_OUTPUT"),
    ("SESSION_~", "dbms_session.set_role", "BUILTIN", None, "DBMS_SESSION"), ("OTHERS_CALL_~", "others_null_~", "INTERNAL", "OTHERS_NULL_~", None), ("OVER_~.LATER", "ping_~", "INTERNAL", "PING_~", None), ("OVER_~.MADE", "over_~.made", "INTERNAL", "OVER_~.MADE", None), ("OVER_~.PUT#1", "inner_p", "INTERNAL", "OVER_~.PUT#1>INNER_P", None),
    ("OVER_~.PUT#2", "made", "INTERNAL", "OVER_~.MADE", None), ("OVER_~.PUT#2", "later", "INTERNAL", "OVER_~.LATER", None), ("PING_~", "pong_~", "INTERNAL", "PONG_~", None), ("PONG_~", "ping_~", "INTERNAL", "PING_~", None), ("UNKNOWN_~", "nowhere_~", "UNRESOLVED", None, None), ("UNKNOWN_~", "elsewhere_~.do_it", "EXTERNAL", None, None),
]))
def sample_calls(a):
    return a.call.where("file not like '%/sql\\\\_%'").select("owner_id", F.array_join("parts", ".").alias("callee"), "resolution", joined("targets").alias("targets"), "builtin_package")


@sampled(each({"owner_id": TEXT, "confidence": TEXT, "kind": TEXT, "concatenated": BOOL, "asserted": BOOL, "whole": BOOL}, [("OPAQUE_~", "UNKNOWN", None, False, False, True), ("EVERY_~", "LITERAL", "DELETE", False, False, True), ("DDL_~", "LITERAL", "TRUNCATE", False, False, True), ("ASSERTED_~", "PARTIAL", "DROP", True, True, True), ("JOINED_TEXT_~", "PARTIAL", "x", True, False, True)]))
def sample_dynamic(a):
    """Dynamic statements; the text of a long one is kept whole, with what is joined to its end."""
    whole = (F.col("owner_id").startswith("JOINED") & F.endswith(F.col("dynamic_expression"), F.lit("|| p_x"))) | ~F.col("owner_id").startswith("JOINED")
    kind = F.when(F.length("dynamic_kind") > 100, F.lower(F.substring("dynamic_kind", 1, 1))).otherwise(F.col("dynamic_kind"))
    return a.sql.where("dynamic").select("owner_id", F.col("dynamic_confidence").alias("confidence"), kind.alias("kind"), "concatenated", "asserted", whole.alias("whole"))


@sampled(each({"file": TEXT, "total_lines": LONG, "code_lines": LONG, "in_units": LONG, "in_skipped": LONG, "terminators": LONG, "unaccounted": LONG}, [("n~/broken.sql", 7, 7, 0, 1, 1, 5), ("n~/types.sql", 5, 5, 0, 4, 1, 0), ("n~/tables.sql", 17, 17, 0, 17, 0, 0), ("n~/hidden.pkb", 7, 7, 6, 0, 1, 0)]))
def sample_coverage(a):
    return a.file_coverage.where("unaccounted > 0 or in_skipped > 0 or file like '%hidden%'").select("file", "total_lines", "code_lines", "in_units", "in_skipped", "terminators", "unaccounted")


@sampled(each({"file": TEXT, "from": LONG, "to": LONG}, [("n~/broken.sql", 1, 5)]))
def sample_gaps(a):
    return a.gaps.select("file", F.col("from").cast("long").alias("from"), F.col("to").cast("long").alias("to"))


@sampled(each({"owner_id": TEXT, "code": TEXT, "penalty": LONG}, [
    ("<anonymous@1>:n~/once.sql", "AMBIGUOUS_OVERLOAD", 4), ("AMBIGUOUS_~", "AMBIGUOUS_OVERLOAD", 4), ("ASSERTED_~", "DYNAMIC_SQL_PARTIAL", 6), ("BOTH_~", "UNDECIDED_IF", 3), ("BROKEN_~", "FILE_SYNTAX_ERRORS", 15), ("DDL_~", "DYNAMIC_SQL_LITERAL", 1), ("DDL_~", "INFERRED_TABLE", 3), ("EVERY_~", "DYNAMIC_SQL_LITERAL", 1),
    ("HIDDEN_~.RUN", "SPEC_NOT_SCANNED", 3), ("JOINED_TEXT_~", "DYNAMIC_SQL_PARTIAL", 6), ("OPAQUE_~", "DYNAMIC_SQL_UNKNOWN", 12), ("OTHER_~", "UNDECIDED_IF", 3), ("OVER_~.<init>", "AMBIGUOUS_OVERLOAD", 4), ("UNKNOWN_~", "EXTERNAL_CALL", 6), ("UNKNOWN_~", "UNRESOLVED_CALL", 8), ("THIRD_~^ALT", "ALTERNATE_VARIANT_ONLY", 5), ("THIRD_~^ALT", "UNDECIDED_IF", 3),
]))
def sample_findings(a):
    return a.finding.select("owner_id", "code", "penalty")


@sampled(each({"owner_id": TEXT, "score": LONG, "grade": TEXT}, [("UNKNOWN_~", 86, "B"), ("OPAQUE_~", 88, "B"), ("BROKEN_~", 85, "B"), ("THIRD_~^ALT", 92, "A"), ("DDL_~", 96, "A")]))
def sample_scores(a):
    return a.score.where("owner_id like 'UNKNOWN%' or owner_id like 'OPAQUE%' or owner_id like 'BROKEN%' or owner_id like 'THIRD%' or owner_id like 'DDL%'").select("owner_id", "score", "grade")


@sampled(each({"file": TEXT, "score": LONG, "grade": TEXT}, [("n~/broken.sql", 0, "D"), ("n~/variants.sql", 96, "A")]))
def sample_file_scores(a):
    return a.file_score.where("score < 100").select("file", "score", "grade")


@sampled(each({"src": TEXT, "dst": TEXT, "cols": TEXT, "to_cols": TEXT, "origin": TEXT, "cardinality": TEXT, "required": BOOL}, [("BADGE_~", "STAFF_~", "STAFF", "ID", "DECLARED", "ONE_TO_ONE", True), ("STAFF_~", "DEPT_~", "DEPT", "ID", "DECLARED", "MANY_TO_ONE", True), ("T1_~", "T2_~", "A", "A", "INFERRED", "UNKNOWN", False)]))
def sample_relations(a):
    return a.er["relation"].select("src", "dst", joined("cols").alias("cols"), joined("to_cols").alias("to_cols"), "origin", "cardinality", "required")


@sampled(each({"table_key": TEXT, "name": TEXT, "type": TEXT, "not_null": BOOL, "is_pk": BOOL, "is_fk": BOOL, "is_unique": BOOL, "is_read": BOOL, "is_written": BOOL}, [
    ("BADGE_~", "CODE", "VARCHAR2(8)", False, False, False, False, False, False), ("BADGE_~", "STAFF", "NUMBER", False, True, True, False, False, False), ("DEPT_~", "ID", "NUMBER", False, True, False, False, False, False), ("DEPT_~", "TITLE", "VARCHAR2(80)", True, False, False, False, False, False),
    ("STAFF_~", "DEPT", "NUMBER", True, False, True, False, True, False), ("STAFF_~", "ID", "NUMBER(10)", False, True, False, False, True, False), ("STAFF_~", "NAME", "VARCHAR2(30)", False, False, False, True, True, False), ("LOG_~", "ID", "NUMBER", False, False, False, False, True, True), ("LOG_~", "NOTE", "VARCHAR2(4000)", False, False, False, False, False, True),
]))
def sample_columns(a):
    return a.er["col"].where("table_key like 'BADGE%' or table_key like 'DEPT%' or table_key like 'STAFF%' or table_key like 'LOG%'").select("table_key", "name", "type", "not_null", "is_pk", "is_fk", "is_unique", "is_read", "is_written")


@sampled(each({"name": TEXT, "entity": TEXT}, [("OTHER.T1_~", "OTHER.T1_~"), ("T1_~", "T1_~"), ("STAFF_~", "STAFF_~"), ("LOG_~", "LOG_~")]))
def sample_names(a):
    """Names of tables to the entities that they mean."""
    from codeloom.operators import er

    defs = er.definitions(*(a.fact(t) for t in ("table_def", "table_col", "table_key", "table_fk")))
    names = a.ref.where("link is null").select(F.upper("table_key").alias("name")).where("name like 'OTHER%' or name like 'T1%' or name like 'STAFF%' or name like 'LOG%'")
    return er.resolve_names(names, defs["entity"])


_NOTES = [
    ("ALONE_~", "AUTONOMOUS_TRANSACTION"), ("BULK_~", "bulk work"), ("BULK_~", "collections"), ("BAD_CODE_~", "application errors"), ("EVERY_~", "NOCOPY"), ("EVERY_~", "OUT"), ("EVERY_~", "anchored types"), ("EVERY_~", "application errors"), ("EVERY_~", "bulk work"), ("EVERY_~", "collections"), ("EVERY_~", "index-by tables"),
    ("LOCKS_~", "row locks"), ("NETWORK_~", "console"), ("OVER_~.MADE", "RESULT_CACHE"), ("ROWS_~", "DETERMINISTIC"), ("ROWS_~", "PIPELINED"), ("ROWS_~", "pipelines"), ("THIRD_~^ALT", "variants"),
    ("C_FLASHBACK_~", "server clock"), ("C_HIERARCHY_~", "hierarchies"), ("C_HIERARCHY_~", "null functions"), ("C_MERGE_~", "merging"), ("C_FOR_UPDATE_~", "row locks"), ("C_PREDICATES_~", "null functions"),
]


@sampled(each({"id": TEXT, "topic": TEXT}, _NOTES))
def sample_notes(a):
    """Notes on semantics, but the one that nearly all samples have: a parameter that is OUT."""
    return a.note.where("topic <> 'OUT' or id like 'EVERY%'").select("id", "topic")


@sampled(each({"id": TEXT, "line": INT, "question": TEXT}, [
    ("UNKNOWN_~", 3, "What is nowhere_~?"), ("<anonymous@1>:n~/once.sql", 4, "Which of OVER_~.PUT#1, OVER_~.PUT#2 is called?"), ("OVER_~.<init>", 28, "Which of OVER_~.PUT#1, OVER_~.PUT#2 is called?"), ("AMBIGUOUS_~", 3, "Which of OVER_~.PUT#1, OVER_~.PUT#2 is called?"),
    ("JOINED_TEXT_~", 3, "Which statements can this text become?"), ("OPAQUE_~", 3, "Which statements can this text become?"), ("ASSERTED_~", 3, "Which statements can this text become?"), ("BOTH_~", 3, "Is this true where it runs: $$switch_~"),
]))
def sample_questions(a):
    return docs.questions(a).where("id not like 'C\\\\_%'")


@sampled(each({"src": TEXT, "dst": TEXT, "type": TEXT, "n": LONG}, [
    ("n~/once.sql", "n~/over.pkb", "CALLS", 2), ("n~/over.pkb", "n~/cycle.sql", "CALLS", 1), ("n~/over.pkb", "n~/over.pks", "SPEC_BODY", 1), ("n~/risk_ambiguous.sql", "n~/over.pkb", "CALLS", 2), ("n~/risk_others_call.sql", "n~/risk_others_null.sql", "CALLS", 1), ("n~/every.sql", "n~/tables.sql", "NEEDS_DDL", 2),
    *((f"n~/risk_{x}.sql", "n~/tables.sql", "NEEDS_DDL", n) for x, n in (("bulk", 1), ("ddl", 1), ("handled", 1), ("hint", 2), ("in_loop", 1), ("locks", 2), ("no_handler", 1), ("row_by_row", 1))), ("n~/staff.trg", "n~/tables.sql", "NEEDS_DDL", 1), ("n~/variants.sql", "n~/tables.sql", "NEEDS_DDL", 1),
]))
def sample_file_edges(a):
    return a.file_need.where("src not like '%/sql\\\\_%'").select("src", "dst", "type", F.col("count").cast("long").alias("n"))


@sampled(each({"file": TEXT, "units": TEXT, "routines": LONG, "depends_on": TEXT, "used_by": TEXT}, [("n~/over.pkb", "PACKAGE_BODY OVER_~", 5, "n~/cycle.sql,n~/over.pks", "n~/once.sql,n~/risk_ambiguous.sql"), ("n~/over.pks", "PACKAGE_SPEC OVER_~", 1, "", "n~/over.pkb"), ("n~/cycle.sql", "PROCEDURE PING_~,PROCEDURE PONG_~", 2, "", "n~/over.pkb")]))
def sample_file_nodes(a):
    return a.file_node.where("file like '%/over%' or file like '%/cycle%'").select("file", joined("units").alias("units"), "routines", joined("depends_on").alias("depends_on"), joined("used_by").alias("used_by"))


@sampled(each({"table_key": TEXT, "role": TEXT, "node": TEXT}, [("STAFF_~", "READER", x) for x in ("EVERY_~", "ROWS_~", "BULK_~", "HANDLED_~", "HINT_~", "LOCKS_~", "NO_HANDLER_~")]))
def sample_impact(a):
    return a.impact.where("table_key like 'STAFF%'")


@sampled(each({"owner_id": TEXT, "builtin_package": TEXT, "category": TEXT}, [("ASSERTED_~", "DBMS_ASSERT", "OTHER_BUILTIN"), ("NETWORK_~", "UTL_HTTP", "NETWORK"), ("NETWORK_~", "DBMS_OUTPUT", "CONSOLE"), ("SESSION_~", "DBMS_SESSION", "SESSION")]))
def sample_io(a):
    return a.io_category


@sampled(each({"owner_id": TEXT, "tables_read": TEXT, "tables_written": TEXT}, [("EVERY_~", "STAFF_~", "LOG_~"), ("LOCKS_~", "LOG_~,STAFF_~", ""), ("C_MERGE_~", "T2_~", "T1_~"), ("C_INSERT_ALL_~", "T4_~", "T1_~,T2_~,T3_~"), ("TRIGGER:STAFF_BI_~", "", "LOG_~")]))
def sample_touched(a):
    t = a.touched.where("owner_id like 'EVERY%' or owner_id like 'LOCKS%' or owner_id like 'C~_MERGE%' escape '~' or owner_id like 'C~_INSERT~_ALL%' escape '~' or owner_id like 'TRIGGER%'")
    return t.select("owner_id", joined("tables_read").alias("tables_read"), joined("tables_written").alias("tables_written"))


@sampled(each({"owner_id": TEXT, "cyclomatic": LONG, "max_nesting": LONG, "loops": LONG, "lines_of_code": LONG}, [("COMPLEX_~", 21, 1, 0, 24), ("VERY_COMPLEX_~", 51, 1, 0, 54), ("DEEP_~", 7, 6, 0, 16), ("LONG_~", 1, 0, 0, 304), ("EVERY_~", 13, 1, 5, 69)]))
def sample_metrics(a):
    return a.metric.where("owner_id like 'COMPLEX%' or owner_id like 'VERY%' or owner_id like 'DEEP%' or owner_id like 'LONG%' or owner_id like 'EVERY%'").select("owner_id", "cyclomatic", "max_nesting", "loops", "lines_of_code")


@sampled(each({"file": TEXT, "variant": TEXT, "statements": LONG, "lost": LONG}, [("n~/every.sql", "primary", 42, 0), ("n~/variants.sql", "primary", 2, 0), ("n~/variants.sql", "alternate", 2, 0), ("n~/risk_long.sql", "primary", 301, 0)]))
def sample_lossless(a):
    """Statements as the parser met them, and how many of them have no step."""
    c = effects.counted(a.facts).where("file like '%/every%' or file like '%/variants%' or file like '%~_long%' escape '~'")
    return c.groupBy("file", "variant").agg(F.sum("expected").alias("statements"), F.sum(F.abs(F.col("expected") - F.col("found"))).alias("lost"))


@sampled(each({"file": TEXT, "kind": TEXT, "object": TEXT, "line": INT}, [("n~/types.sql", "create_type", "T_LIST", 1), ("n~/types.sql", "create_sequence", "SEQ_~", 3), ("n~/types.sql", "create_view", "STAFF_V_~", 4), ("n~/types.sql", "sqlplus", "", 5), ("n~/tables.sql", "alter_table", "STAFF_~", 17), ("n~/broken.sql", "stray", "", 7)]))
def sample_skipped(a):
    return a.fact("skipped").where("kind <> 'create_table'").select("file", "kind", "object", "line")


@sampled(each({"owner_id": TEXT, "kind": TEXT, "into": TEXT, "binds": TEXT, "bulk": BOOL, "bulk_into": BOOL, "in_loop": BOOL, "for_update": BOOL, "context": TEXT}, [
    ("EVERY_~", "CURSOR_DECL", "", "p_x", False, False, False, False, "BODY"), ("EVERY_~", "INSERT", "", "i", True, False, False, False, "BODY"), ("EVERY_~", "OPEN_FOR", "", "", False, False, False, False, "BODY"), ("EVERY_~", "EXECUTE_IMMEDIATE", "", "", False, False, False, False, "DYNAMIC"),
    ("LOCKS_~", "LOCK", "", "", False, False, False, False, "BODY"), ("LOCKS_~", "SELECT", "p_y", "", False, False, False, True, "BODY"), ("IN_LOOP_~", "SELECT", "p_y", "", False, False, True, False, "BODY"), ("TRIGGER:STAFF_BI_~", "SELECT", ":new.id", ":new", False, False, False, False, "TRIGGER"), ("TRIGGER:STAFF_BI_~", "INSERT", "", ":new", False, False, False, False, "TRIGGER"),
]))
def sample_sql(a):
    s = a.sql.where("owner_id like 'EVERY%' or owner_id like 'LOCKS%' or owner_id like 'IN~_LOOP%' escape '~' or owner_id like 'TRIGGER%'")
    return s.select("owner_id", "kind", joined("into").alias("into"), joined(F.sort_array("binds")).alias("binds"), "bulk", "bulk_into", "in_loop", "for_update", "context")


_CARD = """# JUMPS_~

PROCEDURE in `n~/risk_jumps.sql`, lines 1 to 6.

## What it is for

Jumps ~

## Interface

```sql
PROCEDURE jumps_~ (p_x IN NUMBER, p_y OUT NUMBER)
```

| parameter | mode | type | default |
| --- | --- | --- | --- |
| p_x | IN | NUMBER |  |
| p_y | OUT | NUMBER |  |

## Steps

- 1 **GOTO** done (line 3)
- 2 **LABEL** done (line 4)
- 3 **NULL**  (line 5)

## Semantics

- Results leave through parameters.

## Hazards

| severity | code | line | why |
| --- | --- | --- | --- |
| LOW | GOTO_USED | 3 | jump to done |

## Source

```sql
CREATE OR REPLACE PROCEDURE jumps_~ (p_x IN NUMBER, p_y OUT NUMBER) IS
BEGIN
  GOTO done;
  <<done>>
  NULL;
END;
```
"""


@sampled(each({"path": TEXT, "content": TEXT}, [("objects/_standalone/jumps_~.md", _CARD)]))
def sample_cards(a):
    """The whole card of a routine, as it is written."""
    return docs.card_pages(docs.cards(a).where("id like 'JUMPS%'")).where("path like '%.md'")


@sampled(each({"path": TEXT, "kind": TEXT, "id": TEXT, "steps": INT}, [("objects/_triggers/staff_bi_~.json", "TRIGGER", "TRIGGER:STAFF_BI_~", 4), ("objects/over_~/_init.json", "PACKAGE_BODY", "OVER_~.<init>", 1), ("objects/over_~/put-1.json", "PROCEDURE", "OVER_~.PUT#1", 2)]))
def sample_card_json(a):
    """Cards as JSON, read again."""
    pages = docs.card_pages(docs.cards(a).where("id like 'TRIGGER%' or id like 'OVER%.<init>' or id like 'OVER%.PUT#1'")).where("path like '%.json'")
    c = F.from_json("content", "id string, kind string, outline array<struct<number: string>>")
    return pages.select("path", c.alias("c")).select("path", "c.kind", "c.id", F.size("c.outline").alias("steps"))


@sampled("select 'md/' || n_nationkey || '/a.md' as path, 'md/' || n_nationkey || '/' || t as target from nation, (values ('gone.md'), ('../none.md')) v(t)")
def sample_links(a):
    """Broken links of Markdown pages; fenced code, code spans, anchors and addresses do not count."""
    text = "[x](b.md) [y](gone.md#part) `[z](never.md)`\n```\n[c](code.md)\n```\n[w](https://e.org/x.md) [v](../none.md) [u](#here)\n"
    nation = a.spark.createDataFrame([(i,) for i in range(25)], "k int")
    root = F.concat(F.lit("md/"), F.col("k").cast("string"), F.lit("/"))
    page = lambda name, body: nation.select(F.concat(root, F.lit(name)).alias("path"), F.encode(F.lit(body), "UTF-8").alias("content"))
    return verify.broken_links(page("a.md", text).unionByName(page("b.md", "[back](a.md)\n")))


@sampled(each({"id": TEXT}, [("OVER_~.PUT#1",), ("OVER_~.PUT#1>INNER_P",)]))
def sample_search(a):
    return views.search(a.routine, "put#1 OVER", "id", "signature").select("id")


@sampled(each({"owner_id": TEXT, "score": LONG}, [("OPAQUE_~", 88), ("UNKNOWN_~", 86), ("BROKEN_~", 85)]))
def sample_uncertain(a):
    return views.uncertain(a.score, 90).select("owner_id", "score")


@sampled(each({"id": TEXT, "worst": TEXT}, [("OTHERS_NULL_~", "HIGH"), ("VERY_COMPLEX_~", "HIGH"), ("EVERY_~", "MEDIUM"), ("HANDLED_~", None), ("OVER_~.PUT#1", "INFO")]))
def sample_top_risk(a):
    return views.top_risk(a.routine, a.risk).where("id like 'OTHERS~_NULL%' escape '~' or id like 'VERY%' or id like 'EVERY%' or id like 'HANDLED%' or id like '%.PUT#1'").select("id", "worst")


@sampled("select '4.2.1' as number, 'ASSIGN' as kind")
def sample_step_at(a):
    return views.step_at(a.step, "EVERY_7", 20).select("number", "kind")


@sampled("select * from (values ('OVER_7.LATER', 0), ('OVER_7.PUT#2', 1), ('PING_7', 1), ('OVER_7.MADE', 2), ('PONG_7', 2)) v(id, distance)")
def sample_prompt_pack(a):
    pages = a.routine.select("id", F.col("signature").alias("content"))
    return views.prompt_pack(pages, a.calls.where("not ambiguous"), "OVER_7.LATER", 2, 10_000).where("fits").select("id", "distance")


@sampled("select 'OVER_7.PUT#2' as start, x as node from (values ('OVER_7.MADE'), ('OVER_7.LATER'), ('PING_7'), ('PONG_7')) v(x)")
def sample_reachable(a):
    return graph.reachable(a.calls, "OVER_7.PUT#2").select(F.lit("OVER_7.PUT#2").alias("start"), "node")


@sampled("select count(*) * 18 as risks, count(*) * 4 as high from nation")
def sample_at_least(a):
    """Hazards from MEDIUM on, of the samples outside the constructs."""
    r = rules.at_least(a.risk.where("file not like '%/sql\\\\_%'"), "MEDIUM")
    return r.agg(F.count("*").alias("risks"), F.sum((F.col("severity") == "HIGH").cast("long")).alias("high"))


@query("select round(sum(cast(round(o_totalprice) as bigint) % 101 * (o_orderkey % 7 + 1)) / sum(o_orderkey % 7 + 1)) as routine_score, count(*) as routines, (select round(avg(c_custkey % 101)) from customer) as file_score, (select count(*) from customer) as files, round(0.75 * round(sum(cast(round(o_totalprice) as bigint) % 101 * (o_orderkey % 7 + 1)) / sum(o_orderkey % 7 + 1)) + 0.25 * (select round(avg(c_custkey % 101)) from customer)) as overall from orders")
def weighted_overall(spark, sf_dir):
    """The overall confidence, of scores and lines made of orders and customers."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.round("o_totalprice").cast("long") % 101).alias("score"), (F.col("o_orderkey") % 7 + 1).alias("lines"))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select((F.col("c_custkey") % 101).alias("score"))
    return score.overall(o, c).select("routine_score", "routines", "file_score", "files", "overall").select(*(F.col(x).cast("double" if x in ("routine_score", "file_score", "overall") else "long").alias(x) for x in ("routine_score", "routines", "file_score", "files", "overall")))
