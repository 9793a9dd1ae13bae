"""A second code corpus: for each ``nation`` one set of files that holds every kind of statement, hazard, gap and link.

The texts are fixed but for the number of the nation, written ``~``, so that every fact has a closed form. All texts are
made by column expressions; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVERY = """CREATE OR REPLACE PROCEDURE every_~ (p_in IN NUMBER, p_out OUT NOCOPY NUMBER, p_io IN OUT VARCHAR2) IS
  c_max CONSTANT PLS_INTEGER := 10;
  v_n NUMBER NOT NULL := 0;
  v_t staff_~.name%TYPE;
  TYPE t_rec IS RECORD (id NUMBER, name VARCHAR2(30));
  TYPE t_tab IS TABLE OF NUMBER INDEX BY PLS_INTEGER;
  SUBTYPE t_small IS NUMBER(3);
  l_tab t_tab;
  e_bad EXCEPTION;
  PRAGMA EXCEPTION_INIT(e_bad, -20010);
  rc SYS_REFCURSOR;
  CURSOR c_all (p_x NUMBER) IS SELECT id, name FROM staff_~ WHERE dept = p_x;
BEGIN
  <<top>>
  NULL;
  SAVEPOINT sp;
  IF p_in > 1 THEN
    v_n := 1;
  ELSIF p_in = 0 THEN
    v_n := 2;
  ELSE
    v_n := 3;
  END IF;
  CASE
    WHEN v_n = 1 THEN NULL;
    ELSE v_n := 0;
  END CASE;
  LOOP
    EXIT WHEN v_n > 3;
    CONTINUE;
  END LOOP;
  WHILE v_n < 9 LOOP
    v_n := v_n + 1;
  END LOOP;
  FOR i IN REVERSE 1 .. 3 LOOP
    l_tab(i) := i;
  END LOOP;
  FOR r IN c_all(p_in) LOOP
    NULL;
  END LOOP;
  FORALL i IN 1 .. 3
    INSERT INTO log_~ (id) VALUES (l_tab(i));
  OPEN c_all(1);
  FETCH c_all INTO v_n, v_t;
  CLOSE c_all;
  OPEN rc FOR SELECT id FROM staff_~;
  l_tab.DELETE;
  EXECUTE IMMEDIATE 'DELETE FROM log_~';
  DECLARE
    x NUMBER;
  BEGIN
    x := 1;
  END;
  SET TRANSACTION READ ONLY;
  GOTO top;
  ROLLBACK TO sp;
  COMMIT;
  RAISE e_bad;
  RAISE_APPLICATION_ERROR(-20001, 'no');
  RETURN;
EXCEPTION
  WHEN e_bad THEN
    RAISE;
  WHEN NO_DATA_FOUND OR TOO_MANY_ROWS THEN
    p_out := 0;
  WHEN OTHERS THEN
    ROLLBACK;
    RAISE;
END every_~;
/
CREATE OR REPLACE FUNCTION rows_~ RETURN t_list PIPELINED DETERMINISTIC IS
BEGIN
  FOR r IN (SELECT id FROM staff_~) LOOP
    PIPE ROW (r.id);
  END LOOP;
  RETURN;
END rows_~;
/
"""
#: (number, kind, depth is the number of parts) of the steps of EVERY's procedure, in order.
EVERY_STEPS = [
    ("1", "LABEL"), ("2", "NULL"), ("3", "SAVEPOINT"), ("4", "IF"), ("4.1", "THEN"), ("4.1.1", "ASSIGN"), ("4.2", "ELSIF"), ("4.2.1", "ASSIGN"), ("4.3", "ELSE"), ("4.3.1", "ASSIGN"),
    ("5", "CASE"), ("5.1", "WHEN"), ("5.1.1", "NULL"), ("5.2", "ELSE"), ("5.2.1", "ASSIGN"), ("6", "LOOP"), ("6.1", "EXIT"), ("6.2", "CONTINUE"), ("7", "WHILE_LOOP"), ("7.1", "ASSIGN"),
    ("8", "FOR_LOOP"), ("8.1", "ASSIGN"), ("9", "CURSOR_FOR_LOOP"), ("9.1", "NULL"), ("10", "FORALL"), ("10.1", "SQL"), ("11", "OPEN_CURSOR"), ("12", "FETCH"), ("13", "CLOSE_CURSOR"), ("14", "OPEN_FOR"),
    ("15", "COLLECTION_OP"), ("16", "DYNAMIC_SQL"), ("17", "BLOCK"), ("17.1", "ASSIGN"), ("18", "SET_TRANSACTION"), ("19", "GOTO"), ("20", "ROLLBACK"), ("21", "COMMIT"), ("22", "RAISE"), ("23", "RAISE"), ("24", "RETURN"),
    ("25", "EXCEPTION_SECTION"), ("25.1", "HANDLER"), ("25.1.1", "RAISE"), ("25.2", "HANDLER"), ("25.2.1", "ASSIGN"), ("25.3", "HANDLER"), ("25.3.1", "ROLLBACK"), ("25.3.2", "RAISE"),
]

LONG = "'" + "x" * 1200 + "'"
#: (name of the routine, its text between the parameters and END, hazards as (code, severity, line within the routine)).
RISKY: list[tuple[str, str, list[tuple[str, str, int]]]] = [
    ("others_null", "IS\nBEGIN\n  NULL;\nEXCEPTION\n  WHEN OTHERS THEN\n    NULL;", [("WHEN_OTHERS_NULL", "HIGH", 5)]),
    ("others_default", "IS\nBEGIN\n  NULL;\nEXCEPTION\n  WHEN OTHERS THEN\n    p_y := 0;\n    RETURN;", [("WHEN_OTHERS_SWALLOWED", "HIGH", 5)]),
    ("others_call", "IS\nBEGIN\n  NULL;\nEXCEPTION\n  WHEN OTHERS THEN\n    others_null_~(1, p_y);", [("WHEN_OTHERS_NO_RERAISE", "MEDIUM", 5)]),
    ("bad_code", "IS\nBEGIN\n  RAISE_APPLICATION_ERROR(-30000, 'far off');", [("APP_ERROR_CODE_OUT_OF_RANGE", "MEDIUM", 3)]),
    ("no_handler", "IS\nBEGIN\n  SELECT id INTO p_y FROM staff_~ WHERE id = p_x;", [("SELECT_INTO_NO_HANDLER", "LOW", 3)]),
    ("handled", "IS\nBEGIN\n  SELECT id INTO p_y FROM staff_~ WHERE id = p_x;\nEXCEPTION\n  WHEN NO_DATA_FOUND THEN\n    RAISE;", []),
    ("commits", "IS\nBEGIN\n  NULL;\n  COMMIT;\n  ROLLBACK;", [("COMMIT_IN_ROUTINE", "MEDIUM", 4)]),
    ("alone", "IS\n  PRAGMA AUTONOMOUS_TRANSACTION;\nBEGIN\n  COMMIT;", [("AUTONOMOUS_TRANSACTION", "MEDIUM", 2)]),
    ("ddl", "IS\nBEGIN\n  EXECUTE IMMEDIATE 'TRUNCATE TABLE log_~';", [("DDL_IN_PLSQL", "MEDIUM", 3)]),
    ("locks", "IS\nBEGIN\n  LOCK TABLE log_~ IN EXCLUSIVE MODE;\n  SELECT id INTO p_y FROM staff_~ FOR UPDATE;\nEXCEPTION\n  WHEN NO_DATA_FOUND THEN\n    RAISE;", [("ROW_LOCKING", "INFO", 3), ("ROW_LOCKING", "INFO", 4)]),
    ("far", "IS\nBEGIN\n  DELETE FROM log_~@elsewhere;", [("DB_LINK", "INFO", 3)]),
    ("network", "IS\nBEGIN\n  p_y := utl_http.request('x');\n  dbms_output.put_line('quiet');", [("EXTERNAL_SIDE_EFFECT", "MEDIUM", 1)]),
    ("session", "IS\nBEGIN\n  dbms_session.set_role('x');", [("EXTERNAL_SIDE_EFFECT", "INFO", 1)]),
    ("row_by_row", "IS\nBEGIN\n  FOR i IN 1 .. 9 LOOP\n    DELETE FROM log_~ WHERE id = i;\n  END LOOP;", [("ROW_BY_ROW_DML", "MEDIUM", 4)]),
    ("in_loop", "IS\nBEGIN\n  FOR i IN 1 .. 9 LOOP\n    SELECT max(id) INTO p_y FROM log_~;\n  END LOOP;\nEXCEPTION\n  WHEN NO_DATA_FOUND THEN\n    RAISE;", [("SQL_IN_LOOP", "LOW", 4)]),
    ("joined_text", f"IS\nBEGIN\n  EXECUTE IMMEDIATE {LONG} || p_x;", [("DYNAMIC_SQL_CONCATENATION", "HIGH", 3)]),
    ("asserted", "IS\nBEGIN\n  EXECUTE IMMEDIATE 'DROP TABLE ' || dbms_assert.simple_sql_name(p_x);", [("DDL_IN_PLSQL", "MEDIUM", 3), ("DYNAMIC_SQL_CONCATENATION", "LOW", 3)]),
    ("opaque", "IS\nBEGIN\n  EXECUTE IMMEDIATE p_x;", [("DYNAMIC_SQL_OPAQUE", "MEDIUM", 3)]),
    ("bulk", "IS\n  TYPE t IS TABLE OF NUMBER;\n  l t;\n  CURSOR c IS SELECT id FROM staff_~;\nBEGIN\n  SELECT id BULK COLLECT INTO l FROM staff_~;\n  OPEN c;\n  FETCH c BULK COLLECT INTO l;\n  FETCH c BULK COLLECT INTO l LIMIT 10;\n  CLOSE c;", [("UNBOUNDED_BULK_COLLECT", "MEDIUM", 6), ("UNBOUNDED_BULK_COLLECT", "MEDIUM", 8)]),
    ("hint", f"IS\nBEGIN\n  UPDATE log_~ SET note = {LONG + ' || ' + LONG + ' || ' + LONG + ' || ' + LONG}, id = (SELECT /*+ full(s) */ max(s.id) FROM staff_~ s);", [("OPTIMIZER_HINT", "INFO", 3)]),
    ("jumps", "IS\nBEGIN\n  GOTO done;\n  <<done>>\n  NULL;", [("GOTO_USED", "LOW", 3)]),
    ("unknown", "IS\nBEGIN\n  nowhere_~(p_x);\n  elsewhere_~.do_it(p_x);", [("UNRESOLVED_CALL", "INFO", 3), ("UNRESOLVED_CALL", "INFO", 4)]),
    ("ambiguous", "IS\nBEGIN\n  over_~.put(p_x);", [("AMBIGUOUS_OVERLOAD", "INFO", 3)]),
    ("complex", "IS\nBEGIN\n" + "  IF p_x = 1 THEN p_y := 1; END IF;\n" * 20 + "  NULL;", [("HIGH_COMPLEXITY", "MEDIUM", 1)]),
    ("very_complex", "IS\nBEGIN\n" + "  IF p_x = 1 THEN p_y := 1; END IF;\n" * 50 + "  NULL;", [("HIGH_COMPLEXITY", "HIGH", 1)]),
    ("long", "IS\nBEGIN\n" + "  p_y := 1;\n" * 300 + "  NULL;", [("LONG_ROUTINE", "LOW", 1)]),
    ("deep", "IS\nBEGIN\n" + "  IF p_x = 1 THEN\n" * 6 + "  NULL;\n" + "  END IF;\n" * 5 + "  END IF;", [("DEEP_NESTING", "LOW", 1)]),
]
#: A function whose handler gives a value.
DEFAULTS = "CREATE OR REPLACE FUNCTION gives_default_~ RETURN NUMBER IS\nBEGIN\n  RETURN 1;\nEXCEPTION\n  WHEN OTHERS THEN\n    RETURN 0;\nEND;\n/\n"

OVER_SPEC = """CREATE OR REPLACE PACKAGE over_~ AUTHID CURRENT_USER AS
  -- Purpose: puts things away
  g_state NUMBER := 0;
  c_top CONSTANT NUMBER := 9;
  PROCEDURE put(p_a NUMBER);
  PROCEDURE put(p_b VARCHAR2);
  FUNCTION made(p_a NUMBER, p_b NUMBER DEFAULT 1) RETURN NUMBER RESULT_CACHE;
  PROCEDURE missing_body(p_a NUMBER);
END over_~;
/
"""
OVER_BODY = """CREATE OR REPLACE PACKAGE BODY over_~ AS
  v_hidden NUMBER;
  PROCEDURE later(p_a NUMBER);
  PROCEDURE put(p_a NUMBER) IS
    PROCEDURE inner_p IS
    BEGIN
      v_hidden := g_state;
    END inner_p;
  BEGIN
    inner_p;
    g_state := seq_~.NEXTVAL;
  END put;
  PROCEDURE put(p_b VARCHAR2) IS
    g_state NUMBER;
  BEGIN
    g_state := made(p_a => 1);
    later(c_top);
  END put;
  FUNCTION made(p_a NUMBER, p_b NUMBER DEFAULT 1) RETURN NUMBER RESULT_CACHE IS
  BEGIN
    RETURN over_~.made(p_a, p_b);
  END made;
  PROCEDURE later(p_a NUMBER) IS
  BEGIN
    ping_~(p_a);
  END later;
BEGIN
  put(1);
END over_~;
/
"""
CYCLE = """CREATE OR REPLACE PROCEDURE ping_~ (p NUMBER) IS
BEGIN
  pong_~(p);
END;
/
CREATE OR REPLACE PROCEDURE pong_~ (p NUMBER) IS
BEGIN
  ping_~(p);
END;
/
"""
TRIGGER = """CREATE OR REPLACE TRIGGER staff_bi_~ BEFORE INSERT ON staff_~ FOR EACH ROW
BEGIN
  IF :new.id IS NULL THEN
    SELECT seq_~.NEXTVAL INTO :new.id FROM dual;
  END IF;
  INSERT INTO log_~ (id) VALUES (:new.id);
END;
/
"""
ANONYMOUS = "DECLARE\n  v NUMBER;\nBEGIN\n  over_~.put(v);\nEND;\n/\n"
VARIANTS = "CREATE OR REPLACE PROCEDURE both_~ IS\nBEGIN\n$IF $$switch_~ $THEN\n  INSERT INTO log_~ (id) VALUES (1);\n$ELSE\n  DELETE FROM log_~;\n$END\nEND;\n/\n$IF $$switch_~ $THEN\nCREATE OR REPLACE PROCEDURE third_~ IS\nBEGIN\n  NULL;\nEND;\n/\n$ELSE\nCREATE OR REPLACE PROCEDURE other_~ IS\nBEGIN\n  NULL;\nEND;\n/\n$END\n"
BROKEN = "CREATE OR REPLACE PROCEDURE broken_~ IS\nBEGIN\n  IF 1 = THEN THEN\n    NULL;\nEND;\n/\nstray words here\n"
TYPES = "CREATE OR REPLACE TYPE t_list AS TABLE OF NUMBER;\n/\nCREATE SEQUENCE seq_~;\nCREATE OR REPLACE VIEW staff_v_~ AS SELECT id FROM staff_~;\nPROMPT done\n"
SPEC_ONLY = "CREATE OR REPLACE PACKAGE lone_~ AS\n  PROCEDURE run(p_a NUMBER);\nEND lone_~;\n/\n"
BODY_ONLY = "CREATE OR REPLACE PACKAGE BODY hidden_~ AS\n  PROCEDURE run IS\n  BEGIN\n    NULL;\n  END run;\nEND hidden_~;\n/\n"
DDL = """CREATE TABLE dept_~ (
  id NUMBER PRIMARY KEY,
  title VARCHAR2(80) DEFAULT 'none' NOT NULL
);
CREATE TABLE staff_~ (
  id NUMBER(10),
  dept NUMBER NOT NULL,
  name VARCHAR2(30),
  CONSTRAINT staff_pk_~ PRIMARY KEY (id),
  CONSTRAINT staff_uk_~ UNIQUE (name)
);
CREATE TABLE badge_~ (
  staff NUMBER PRIMARY KEY REFERENCES staff_~ (id) ON DELETE CASCADE,
  code VARCHAR2(8)
);
CREATE TABLE log_~ (id NUMBER, note VARCHAR2(4000));
ALTER TABLE staff_~ ADD CONSTRAINT staff_fk_~ FOREIGN KEY (dept) REFERENCES dept_~ (id);
"""

#: One statement of each construct of the grammar: (construct, statement, tables with the accesses to them). The
#: statement stands in a routine of parameters p_x and p_y.
CONSTRUCTS: list[tuple[str, str, list[tuple[str, str]]]] = [
    ("distinct", "SELECT DISTINCT a INTO p_y FROM t1_~", [("T1", "READ")]),
    ("with", "WITH q AS (SELECT a FROM t1_~), w(a) AS (SELECT a FROM t2_~ UNION ALL SELECT a + 1 FROM w) SEARCH DEPTH FIRST BY a SET o CYCLE a SET c TO 1 DEFAULT 0 SELECT max(q.a) INTO p_y FROM q, w", [("T1", "READ"), ("T2", "READ")]),
    ("set_operators", "SELECT a INTO p_y FROM t1_~ UNION SELECT a FROM t2_~ INTERSECT SELECT a FROM t3_~ MINUS SELECT a FROM t4_~", [("T1", "READ"), ("T2", "READ"), ("T3", "READ"), ("T4", "READ")]),
    ("joins", "SELECT x.a INTO p_y FROM t1_~ x LEFT OUTER JOIN t2_~ y USING (a) NATURAL JOIN t3_~ CROSS JOIN t4_~", [("T1", "READ"), ("T2", "READ"), ("T3", "READ"), ("T4", "READ")]),
    ("old_outer_join", "SELECT x.a INTO p_y FROM t1_~ x, t2_~ y WHERE x.a = y.a (+)", [("T1", "READ"), ("T2", "READ")]),
    ("partitioned_outer_join", "SELECT x.a INTO p_y FROM t1_~ x PARTITION BY (x.b) RIGHT OUTER JOIN t2_~ y ON x.a = y.a", [("T1", "READ"), ("T2", "READ")]),
    ("apply", "SELECT x.a INTO p_y FROM t1_~ x CROSS APPLY (SELECT a FROM t2_~ z WHERE z.a = x.a) v OUTER APPLY (SELECT a FROM t3_~) w", [("T1", "READ"), ("T2", "READ"), ("T3", "READ")]),
    ("lateral", "SELECT x.a INTO p_y FROM t1_~ x, LATERAL (SELECT a FROM t2_~ z WHERE z.a = x.a) v", [("T1", "READ"), ("T2", "READ")]),
    ("flashback", "SELECT a INTO p_y FROM t1_~ AS OF TIMESTAMP (SYSTIMESTAMP - INTERVAL '1' HOUR)", [("T1", "READ")]),
    ("versions", "SELECT a INTO p_y FROM t1_~ VERSIONS BETWEEN SCN MINVALUE AND MAXVALUE", [("T1", "READ")]),
    ("pivot", "SELECT * INTO p_y FROM (SELECT a, b FROM t1_~) PIVOT (max(a) FOR b IN (1 AS one, 2 AS two))", [("T1", "READ")]),
    ("unpivot", "SELECT a INTO p_y FROM t1_~ UNPIVOT (a FOR b IN (c, d))", [("T1", "READ")]),
    ("hierarchy", "SELECT LEVEL INTO p_y FROM t1_~ START WITH b IS NULL CONNECT BY NOCYCLE PRIOR a = b ORDER SIBLINGS BY a", [("T1", "READ")]),
    ("grouping", "SELECT a INTO p_y FROM t1_~ GROUP BY GROUPING SETS ((a), ROLLUP (a, b), CUBE (b)) HAVING count(*) > 1", [("T1", "READ")]),
    ("model", "SELECT a INTO p_y FROM t1_~ MODEL DIMENSION BY (b) MEASURES (a) RULES (a[1] = a[0] + 1)", [("T1", "READ")]),
    ("order_nulls", "SELECT a INTO p_y FROM t1_~ ORDER BY a DESC NULLS LAST", [("T1", "READ")]),
    ("offset_fetch", "SELECT a INTO p_y FROM t1_~ OFFSET 5 ROWS FETCH NEXT 10 PERCENT ROWS WITH TIES", [("T1", "READ")]),
    ("for_update", "SELECT a INTO p_y FROM t1_~ FOR UPDATE OF a SKIP LOCKED", [("T1", "READ")]),
    ("insert_select", "INSERT INTO t1_~ (a) SELECT a FROM t2_~", [("T1", "INSERT"), ("T2", "READ")]),
    ("insert_all", "INSERT ALL WHEN a > 1 THEN INTO t1_~ (a) VALUES (a) WHEN a > 0 THEN INTO t2_~ (a) VALUES (a) ELSE INTO t3_~ (a) VALUES (a) SELECT a FROM t4_~", [("T1", "INSERT"), ("T2", "INSERT"), ("T3", "INSERT"), ("T4", "READ")]),
    ("insert_first", "INSERT FIRST WHEN a > 1 THEN INTO t1_~ VALUES (a) ELSE INTO t2_~ VALUES (a) SELECT a FROM t3_~", [("T1", "INSERT"), ("T2", "INSERT"), ("T3", "READ")]),
    ("update_returning", "UPDATE t1_~ x SET x.a = (SELECT max(b) FROM t2_~), (b, c) = (SELECT b, c FROM t3_~) WHERE x.a = 1 RETURNING a INTO p_y LOG ERRORS REJECT LIMIT UNLIMITED", [("T1", "UPDATE"), ("T2", "READ"), ("T3", "READ")]),
    ("delete", "DELETE FROM t1_~ WHERE a IN (SELECT a FROM t2_~)", [("T1", "DELETE"), ("T2", "READ")]),
    ("merge", "MERGE INTO t1_~ x USING (SELECT a, b FROM t2_~) y ON (x.a = y.a) WHEN MATCHED THEN UPDATE SET x.b = y.b WHEN NOT MATCHED THEN INSERT (a) VALUES (y.a)", [("T1", "INSERT,UPDATE"), ("T2", "READ")]),
    ("lock", "LOCK TABLE t1_~, t2_~ IN SHARE MODE NOWAIT", [("T1", "LOCK"), ("T2", "LOCK")]),
    ("sample", "SELECT a INTO p_y FROM t1_~ SAMPLE (10) SEED (3)", [("T1", "READ")]),
    ("table_function", "SELECT column_value INTO p_y FROM TABLE (p_x), t1_~", [("T1", "READ")]),
    ("json_table", "SELECT j.a INTO p_y FROM t1_~, JSON_TABLE (t1_~.b, '$' COLUMNS (a NUMBER PATH '$.a')) j", [("T1", "READ")]),
    ("xmltable", "SELECT j.a INTO p_y FROM t1_~, XMLTABLE ('/r' PASSING t1_~.b COLUMNS a NUMBER PATH 'a') j", [("T1", "READ")]),
    ("predicates", "SELECT a INTO p_y FROM t1_~ WHERE a BETWEEN 1 AND 2 AND b LIKE 'x%' ESCAPE '!' AND c IS NOT NULL AND EXISTS (SELECT 1 FROM t2_~) AND a = ANY (SELECT a FROM t3_~)", [("T1", "READ"), ("T2", "READ"), ("T3", "READ")]),
    ("multiset", "SELECT a INTO p_y FROM t1_~ WHERE p_x MEMBER OF b AND b SUBMULTISET OF c", [("T1", "READ")]),
    ("arithmetic", "SELECT a ** 2 + a AT TIME ZONE 'UTC' INTO p_y FROM t1_~", [("T1", "READ")]),
    ("case", "SELECT CASE a WHEN 1 THEN b ELSE CASE WHEN c > 0 THEN d END END INTO p_y FROM t1_~", [("T1", "READ")]),
    ("strings", "SELECT trim(BOTH 'x' FROM a) || substr(b, 1, 2) INTO p_y FROM t1_~", [("T1", "READ")]),
    ("json", "SELECT json_value(a, '$.x' RETURNING NUMBER) INTO p_y FROM t1_~ WHERE b IS JSON", [("T1", "READ")]),
    ("keep", "SELECT max(a) KEEP (DENSE_RANK FIRST ORDER BY b) INTO p_y FROM t1_~", [("T1", "READ")]),
    ("analytic", "SELECT sum(a) OVER (PARTITION BY b ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) INTO p_y FROM t1_~", [("T1", "READ")]),
    ("within_group", "SELECT percentile_cont(0.5) WITHIN GROUP (ORDER BY a) INTO p_y FROM t1_~", [("T1", "READ")]),
    ("first_value", "SELECT first_value(a IGNORE NULLS) OVER (ORDER BY b RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) INTO p_y FROM t1_~", [("T1", "READ")]),
    ("listagg", "SELECT listagg(a, ',' ON OVERFLOW TRUNCATE) WITHIN GROUP (ORDER BY a) INTO p_y FROM t1_~", [("T1", "READ")]),
    ("cast", "SELECT cast(a AS NUMBER DEFAULT 0 ON CONVERSION ERROR) INTO p_y FROM t1_~", [("T1", "READ")]),
    ("extract", "SELECT extract(YEAR FROM a), translate(b USING NCHAR_CS), treat(c AS t_list) INTO p_y FROM t1_~", [("T1", "READ")]),
    ("xml", "SELECT xmlelement(NAME \"e\", xmlattributes(a AS \"i\")) INTO p_y FROM t1_~ WHERE prediction(m USING *) = 1", [("T1", "READ")]),
    ("schema_names", "SELECT a INTO p_y FROM other.t1_~ PARTITION (p1), \"t2_~\"", [("OTHER.T1", "READ"), ("T2", "READ")]),
]


def routine(name: str, text: str) -> str:
    return f"CREATE OR REPLACE PROCEDURE {name}_~ (p_x IN NUMBER, p_y OUT NUMBER) {text}\nEND;\n/\n"


def files() -> dict[str, str]:
    """Path to text, with ~ for the number."""
    out = {"every": EVERY, "over.pks": OVER_SPEC, "over.pkb": OVER_BODY, "cycle": CYCLE, "staff.trg": TRIGGER, "once": ANONYMOUS, "variants": VARIANTS, "broken": BROKEN, "types": TYPES, "hidden.pkb": BODY_ONLY, "lone.pks": SPEC_ONLY, "tables": DDL, "default": DEFAULTS}
    out |= {f"risk_{name}": routine(f"{name}", text) for name, text, _ in RISKY}
    out |= {f"sql_{name}": routine(f"c_{name}", f"IS\nBEGIN\n  {text};") for name, text, _ in CONSTRUCTS}
    return {f"n~/{name if '.' in name else name + '.sql'}": text for name, text in out.items()}


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (file, text)."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("k"))
    forms = F.explode(F.array(*(F.struct(F.lit(path).alias("path"), F.lit(text).alias("text")) for path, text in files().items())))
    fill = lambda c: F.replace(c, F.lit("~"), F.col("k"))
    return nation.select("k", forms.alias("f")).select(fill(F.col("f.path")).alias("file"), fill(F.col("f.text")).alias("text"))
