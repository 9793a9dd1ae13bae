"""Registered queries of the engine's own operators, each with the SQL that must give the same rows.

Family A analyses the synthetic code corpus; its SQL never sees a program, it computes the facts from the columns of
``part`` and ``supplier`` that the program text was made of. Families B and C run the generic operators over the tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import filedeps, graph, link, rules, score
from codeloom.plans.engine import Analysis, of_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

P = "p as (select p_partkey k, p_size z, (select count(*) from part) n from part), s as (select s_suppkey k, (select count(*) from part) n from supplier)"
CALLS = """c as (
  select 'PART_' || k src, 'PART_' || ((7 * k + 1) % n) dst, 'INTERNAL' how from p where z % 3 = 0
  union all select 'PART_' || k, 'EXT_PKG.DO_IT', 'EXTERNAL' from p where z % 13 = 0
  union all select 'PKG_' || k || '.RUN#1', 'PKG_' || k || '.RUN#2', 'INTERNAL' from s where k % 4 <> 0
  union all select 'PKG_' || k || '.RUN#2', 'PKG_' || k || '.TOTAL', 'INTERNAL' from s where k % 4 <> 0
  union all select 'PKG_' || k || '.TOTAL', 'PKG_' || k || '.HELPER', 'INTERNAL' from s where k % 4 <> 0
  union all select 'PKG_' || k || '.HELPER', 'PART_' || (k % n), 'INTERNAL' from s where k % 4 <> 0)"""
J3 = "range(3) j(i)"
NODES = "nodes as (select 'PART_' || k node from p union all select 'JOIN_' || i from range(3) j(i) union all select 'PKG_' || k || x from s, (values ('.RUN#1'), ('.RUN#2'), ('.TOTAL')) v(x) union all select 'PKG_' || k || '.HELPER' from s where k % 4 <> 0)"
READS = f"r as (select 'PART_' || k src, 'STOCK_' || (z % 3) dst from p where z % 2 = 0 union all select 'JOIN_' || i, 'STOCK_' || i from {J3} union all select 'JOIN_' || i, 'SHIP' from {J3})"
WRITES = "w as (select 'PART_' || k src, 'INV_' || (z % 5) dst, z % 4 n, 'UPDATE' how from p where z % 4 > 0 union all select 'PART_' || k, 'TMP_T', 1, 'DELETE (inferred)' from p where z % 11 = 0)"
LOC = "5 + 3 * (z % 4) + 3 * (z % 2 = 0)::int + (z % 3 = 0)::int + (z % 13 = 0)::int + (z % 11 = 0)::int + (z % 5 = 0)::int + 3 * (z % 7 = 0)::int"
RISKS = """k as (
  select 'PART_' || k owner_id, 'WHEN_OTHERS_NULL' code, 'HIGH' severity from p where z % 7 = 0
  union all select 'PART_' || k, 'SQL_IN_LOOP', 'LOW' from p where z % 2 = 0
  union all select 'PART_' || k, 'DYNAMIC_SQL_CONCATENATION', 'HIGH' from p where z % 11 = 0
  union all select 'PART_' || k, 'COMMIT_IN_ROUTINE', 'MEDIUM' from p where z % 5 = 0
  union all select 'PART_' || k, 'UNRESOLVED_CALL', 'INFO' from p where z % 13 = 0
  union all select 'PART_' || k, 'SELECT_INTO_NO_HANDLER', 'LOW' from p where z % 2 = 0 and z % 7 <> 0
  union all select 'JOIN_' || i, 'SELECT_INTO_NO_HANDLER', 'LOW' from range(3) j(i)
  union all select 'PKG_' || k || '.RUN#2', 'PACKAGE_STATE_WRITE', 'INFO' from s where k % 4 <> 0)"""


def query(sql: str | None = None, name: str | None = None):
    def put(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return put


def coded(sql: str | None):
    """A query of the analysis of the synthetic corpus."""

    def put(f: Callable[[Analysis], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(of_tables(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        return query(sql)(run)

    return put


# --- A: the corpus

@coded(f"with {P}, {CALLS} select src, dst, how as detail, count(*) as n from c group by all")
def edges_calls(a):
    return a.edge.where("type = 'CALLS'").select("src", "dst", F.array_join("detail", ",").alias("detail"), F.col("count").alias("n"))


@coded(f"with {P}, {READS} select src, dst, count(*) as n from r group by all")
def edges_reads(a):
    return a.edge.where("type = 'READS'").select("src", "dst", F.col("count").alias("n"))


@coded(f"with {P}, {WRITES} select src, dst, how as detail, cast(n as bigint) as n from w")
def edges_writes(a):
    return a.edge.where("type = 'WRITES'").select("src", "dst", F.array_join("detail", ",").alias("detail"), F.col("count").alias("n"))


@coded(f"""with {P} select 'PART_' || k as owner_id, cast(1 + z % 4 + (z % 2 = 0)::int + (z % 7 = 0)::int as bigint) as cyclomatic,
  cast(1 + 2 * (z % 4) + 2 * (z % 2 = 0)::int + (z % 3 = 0)::int + (z % 13 = 0)::int + (z % 11 = 0)::int + (z % 5 = 0)::int + (z % 7 = 0)::int as bigint) as statements,
  cast((z % 2 = 0)::int as bigint) as loops, cast((z % 4 > 0 or z % 2 = 0)::int as bigint) as max_nesting,
  cast(z % 4 + (z % 2 = 0)::int + (z % 11 = 0)::int as bigint) as sql_statements, cast((z % 3 = 0)::int + (z % 13 = 0)::int as bigint) as calls, cast({LOC} as bigint) as lines_of_code from p
  union all select 'JOIN_' || i, 1, 1, 0, 0, 1, 0, 5 from {J3}
  union all select 'PKG_' || k || x, 1, st, 0, 0, 0, 1, l from s, (values ('.RUN#1', 1, 4), ('.RUN#2', 1, 4), ('.TOTAL', 2, 5), ('.HELPER', 1, 4)) v(x, st, l) where k % 4 <> 0
  union all select 'PKG_' || k || x, 1, 0, 0, 0, 0, 0, 1 from s, (values ('.RUN#1'), ('.RUN#2'), ('.TOTAL')) v(x) where k % 4 = 0""")
def metrics_routines(a):
    return a.metric.select("owner_id", "cyclomatic", "statements", "loops", "max_nesting", "sql_statements", "calls", "lines_of_code")


@coded(f"with {P}, {RISKS} select severity, code, count(*) as n from k group by all")
def risk_counts(a):
    return rules.risk_counts(a.risk)


@coded(f"with {P}, {RISKS} select owner_id, cast(sum((severity = 'HIGH')::int) as bigint) as high, cast(sum((severity = 'MEDIUM')::int) as bigint) as medium, cast(sum((severity = 'LOW')::int) as bigint) as low, cast(sum((severity = 'INFO')::int) as bigint) as info from k group by owner_id")
def risk_pivot(a):
    return rules.risk_pivot(a.risk, "owner_id")


@coded(f"with {P}, {RISKS} select owner_id, code, severity from k where severity in ('HIGH', 'MEDIUM')")
def risk_min_severity(a):
    return rules.at_least(a.risk, "MEDIUM").select("owner_id", "code", "severity")


@coded(f"with {P} select 'PART_' || k as owner_id, true as others, true as swallows, true as only_null, false as calls_routines, cast({LOC} - 2 as integer) as line from p where z % 7 = 0")
def handlers(a):
    return a.handler.select("owner_id", "others", "swallows", "only_null", "calls_routines", "line")


@coded(f"with {P} select 'PART_' || k as owner_id, cast(5 + 3 * (z % 4) + 3 * (z % 2 = 0)::int + (z % 3 = 0)::int + (z % 13 = 0)::int + (z % 11 = 0)::int as integer) as line from p where z % 5 = 0")
def commits(a):
    return a.effect.where("effect_kind = 'COMMIT'").select("owner_id", "line")


@coded(f"with {P} select 'PKG_' || k || '.RUN#2' as owner_id, x as effect_kind, 'G_N' as detail from s, (values ('STATE_READ'), ('STATE_WRITE')) v(x) where k % 4 <> 0")
def package_state(a):
    return a.effect.where("effect_kind like 'STATE%'").select("owner_id", "effect_kind", "detail")


@coded(f"with {P} select 'PART_' || k as owner_id, 'PARTIAL' as confidence, 'DELETE' as kind, 'TMP_T' as table_key from p where z % 11 = 0")
def dynamic_sql(a):
    key = ["file", "variant", "unit", "routine", "stmt"]
    return a.sql.where("dynamic").join(a.ref.select(*key, "table_key"), key).select("owner_id", F.col("dynamic_confidence").alias("confidence"), F.col("dynamic_kind").alias("kind"), "table_key")


@coded(f"with {P} select 'PART_' || k as owner_id, x as exception from p, (values ('NO_DATA_FOUND'), ('TOO_MANY_ROWS')) v(x) where z % 2 = 0 union all select 'JOIN_' || i, x from {J3}, (values ('NO_DATA_FOUND'), ('TOO_MANY_ROWS')) v(x)")
def implicit_exceptions(a):
    return a.implicit.select("owner_id", "exception")


@coded(f"with {P}, {CALLS}, {NODES} select node, case when node like '%.HELPER' then 'DEAD' else 'ENTRY_POINT' end as what from nodes where node not in (select dst from c where src <> dst)")
def uncalled(a):
    return a.uncalled.select("node", "what")


@coded(f"with {P}, {CALLS} select dst as name, how as kind, count(distinct src) as callers from c where how = 'EXTERNAL' group by all")
def external_calls(a):
    e = a.edge.join(a.node.where("type = 'EXTERNAL'").select(F.col("id").alias("dst"), F.col("type").alias("kind")), "dst")
    return e.groupBy(F.col("dst").alias("name"), "kind").agg(F.countDistinct("src").alias("callers"))


@coded(f"with {P}, m as (select 'EXTERNAL_PACKAGE' as kind, 'EXT_PKG' as name from p where z % 13 = 0 union select 'TABLE_DDL_MISSING', 'TMP_T' from p where z % 11 = 0 union select 'TABLE_DDL_MISSING', 'SHIP' union select 'BODY_NOT_SCANNED', 'PKG_' || k from s where k % 4 = 0) select kind, count(*) as n from m group by kind")
def missing_kinds(a):
    return score.missing_counts(a.missing)


@coded(f"with recursive {P}, {CALLS}, e as (select src, dst from c where how = 'INTERNAL'), r as (select src as start, dst as node from e union select r.start, e.dst from r join e on r.node = e.src) select start, node from r")
def reachable(a):
    return graph.closure(a.calls, a.routine_nodes.select(F.col("node").alias("start")))


@coded(f"with recursive {P}, {CALLS}, {READS}, {WRITES}, e as (select distinct src, dst from c where how = 'INTERNAL'), b as (select w.dst t, e.src node from w join e on e.dst = w.src union select b.t, e.src from b join e on e.dst = b.node) select distinct dst as table_key, 'READER' as role, src as node from r union all select distinct dst, 'WRITER', src from w union all select t, 'CALLER', node from b where not exists (select 1 from w where w.dst = b.t and w.src = b.node)")
def table_impact(a):
    return a.impact


_CYCLE = "e as (select k a, (7 * k + 1) % n b from p where z % 3 = 0), t as (select a, b from e union select t.a, e.b from t join e on t.b = e.a), cyc as (select distinct a from t where a = b)"


@coded(f"with recursive {P}, {_CYCLE}, g as (select x.a, min('PART_' || y.b) c from t x join t y on x.a = y.a and exists (select 1 from t z where z.a = y.b and z.b = x.a) where x.a = x.b group by x.a) select c as component, string_agg('PART_' || a, ',' order by 'PART_' || a) as members from g group by c")
def recursion_groups(a):
    return a.recursion.select("component", F.array_join("members", ",").alias("members"))


_BATCH = f"""{_CYCLE}, b as (
  select k, 0 d from p where z % 3 <> 0 or k in (select a from cyc)
  union all select e.a, b.d + 1 from b join e on e.b = b.k and e.a not in (select a from cyc)
), f as (
  select 'PART_' || k node, d batch from b union all select 'JOIN_' || i, 0 from range(3) j(i)
  union all select 'PKG_' || s.k || x, 0 from s, (values ('.RUN#1'), ('.RUN#2'), ('.TOTAL')) v(x) where s.k % 4 = 0
  union all select 'PKG_' || s.k || x, b.d + y from s join b on b.k = s.k % s.n, (values ('.HELPER', 1), ('.TOTAL', 2), ('.RUN#2', 3), ('.RUN#1', 4)) v(x, y) where s.k % 4 <> 0
)"""


@coded(f"with recursive {P}, {_BATCH} select node, cast(batch as integer) as batch from f")
def batches(a):
    return a.batch.select("node", "batch")


@coded(f"with recursive {P}, {_BATCH} select node, row_number() over (order by batch, node) as rank from f")
def ranks(a):
    return a.rank.select("node", "rank")


_SCORE = "100 - 6 * (z % 13 = 0)::int - 9 * (z % 11 = 0)::int"


@coded(f"with {P} select 'PART_' || k as owner_id, cast({_SCORE} as bigint) as score from p union all select 'JOIN_' || i, 100 from {J3} union all select 'PKG_' || k || x, 100 from s, (values ('.RUN#1'), ('.RUN#2'), ('.TOTAL'), ('.HELPER')) v(x) where k % 4 <> 0")
def confidence_scores(a):
    return a.score.select("owner_id", "score")


@coded(f"""with {P}, x as (select {LOC} l, {_SCORE} s from p union all select 5, 100 from {J3} union all select y, 100 from s, (values (4), (4), (5), (4)) v(y) where k % 4 <> 0),
  r as (select cast(round(sum(l * s) / sum(l)) as bigint) as routine_score, count(*) as routines from x)
  select routine_score, routines, cast(100 as bigint) as file_score, (select count(*) from part) + (select count(*) from supplier) + (select count(*) from supplier where s_suppkey % 4 <> 0) + 2 as files, cast(round(0.75 * routine_score + 25) as bigint) as overall from r""")
def confidence_overall(a):
    return a.confidence.select("routine_score", "routines", "file_score", "files", "overall")


@coded(f"""with {P} select 'src/part_' || k || '.prc' as file, cast({LOC} + 1 as bigint) as total_lines, cast({LOC} + 1 as bigint) as code_lines, cast({LOC} as bigint) as in_units, cast(1 as bigint) as terminators, cast(0 as bigint) as unaccounted, cast(100.0 as double) as percent from p
  union all select 'src/pkg_' || k || '.pks', 6, 6, 5, 1, 0, 100 from s union all select 'src/pkg_' || k || '.pkb', 22, 22, 21, 1, 0, 100 from s where k % 4 <> 0
  union all select * from (values ('ddl/tables.sql', 41, 41, 0, 0, 0, 100), ('src/joins.sql', 18, 18, 15, 3, 0, 100)) v""")
def line_coverage(a):
    return a.file_coverage.select("file", "total_lines", "code_lines", "in_units", "terminators", "unaccounted", "percent")


@coded(f"with {P}, {CALLS} select src as owner_id, dst as targets, cast(case when dst like '%.RUN#2' then 2 else 1 end as integer) as argc from c where how = 'INTERNAL'")
def overload_narrowing(a):
    return a.call.where("targets is not null").select("owner_id", F.array_join("targets", ",").alias("targets"), "argc")


@coded(f"with {P} select 'PKG_' || k as owner, cast(3 + (k % 4 <> 0)::int as bigint) as routines, cast(3 as bigint) as public, cast(case when k % 4 <> 0 then 17 else 3 end as bigint) as lines, cast(1 as bigint) as max_cyclomatic, cast(0 as bigint) as high_risks from s")
def package_rollup(a):
    return a.package_overview.select("owner", "routines", "public", "lines", "max_cyclomatic", "high_risks")


@coded(f"with {P}, {CALLS}, {READS}, {WRITES}, g as (select split_part(src, '.', 1) f, 'CALLS' as type, case when dst like 'PKG%' then split_part(dst, '.', 1) else dst end t, 1 n from c union all select src, 'READS', dst, 1 from r union all select src, 'WRITES', dst, n from w) select f as from_group, type, t as to_group, cast(sum(n) as bigint) as n from g where f <> t group by all")
def package_edges(a):
    return a.package_edge.select("from_group", "type", "to_group", F.col("count").alias("n"))


@coded(f"""with {P} select 'PKG_' || k || x as id, case when x = '.HELPER' then 'PRIVATE' else 'PUBLIC' end as visibility, k % 4 <> 0 as has_body,
  case when k % 4 = 0 or x = '.HELPER' then null else 'src/pkg_' || k || '.pks' end as spec_file, 'src/pkg_' || k || case when k % 4 = 0 then '.pks' else '.pkb' end as file
  from s, (values ('.RUN#1'), ('.RUN#2'), ('.TOTAL'), ('.HELPER')) v(x) where k % 4 <> 0 or x <> '.HELPER'
  union all select 'PART_' || k, 'STANDALONE', true, null, 'src/part_' || k || '.prc' from p union all select 'JOIN_' || i, 'STANDALONE', true, null, 'src/joins.sql' from {J3}""")
def spec_body_link(a):
    return a.routine.select("id", "visibility", "has_body", "spec_file", "file")


@coded(f"with {P} select 'WARN' as severity, 'spec-without-body' as code, 'src/pkg_' || k || '.pks' as file from s where k % 4 = 0")
def link_issues(a):
    return a.issue.select("severity", "code", "file")


@coded("select 'STOCK_' || i as src, 'INV_' || i as dst, 'INV_REF' as cols, 'ID' as to_cols, 'MANY_TO_ONE' as cardinality, true as required from range(3) t(i)")
def er_declared(a):
    return a.er["relation"].where("origin = 'DECLARED'").select("src", "dst", F.array_join("cols", ",").alias("cols"), F.array_join("to_cols", ",").alias("to_cols"), "cardinality", "required")


@coded("select 'SHIP' as src, 'STOCK_' || i as dst, 'STOCK_REF' as cols, 'ID' as to_cols, 'MANY_TO_ONE' as cardinality, cast(1 as bigint) as weight from range(3) t(i)")
def er_inferred(a):
    return a.er["relation"].where("origin = 'INFERRED'").select("src", "dst", F.array_join("cols", ",").alias("cols"), F.array_join("to_cols", ",").alias("to_cols"), "cardinality", "weight")


@coded("select * from (values ('INV_0', 'INV_0,INV_1,INV_2,SHIP,STOCK_0,STOCK_1,STOCK_2', cast(7 as bigint)), ('INV_3', 'INV_3', 1), ('INV_4', 'INV_4', 1), ('TMP_T', 'TMP_T', 1)) v(cluster, members, size) where cluster <> 'TMP_T' or exists (select 1 from part where p_size % 11 = 0)")
def er_clusters(a):
    return a.er_cluster.select("cluster", F.array_join("members", ",").alias("members"), "size")


@coded("select 'INV_' || i as table_key, c as name, t as type, true as not_null_or_key, c = 'ID' as is_pk from range(5) r(i), (values ('ID', 'NUMBER(10)'), ('QTY', 'NUMBER')) v(c, t) union all select 'STOCK_' || i, c, t, c <> 'QTY', c = 'ID' from range(3) r(i), (values ('ID', 'NUMBER(10)'), ('INV_REF', 'NUMBER'), ('QTY', 'NUMBER')) v(c, t)")
def table_columns(a):
    return a.er["col"].where("in_ddl").select("table_key", "name", "type", (F.col("not_null") | F.col("is_pk")).alias("not_null_or_key"), "is_pk")


@coded(f"""with {P}, {CALLS}, f as (select distinct src, dst from c where how = 'INTERNAL'),
  h as (select f.*, case when src like 'PKG%' then 'src/' || lower(split_part(src, '.', 1)) || '.pkb' else 'src/' || lower(src) || '.prc' end sf, case when dst like 'PKG%' then 'src/' || lower(split_part(dst, '.', 1)) || '.pkb' else 'src/' || lower(dst) || '.prc' end df from f)
  select sf as src, df as dst, 'CALLS' as type, count(*) as n from h where sf <> df group by sf, df
  union all select 'src/pkg_' || k || '.pkb', 'src/pkg_' || k || '.pks', 'SPEC_BODY', 1 from s where k % 4 <> 0
  union all select 'src/part_' || k || '.prc', 'ddl/tables.sql', 'NEEDS_DDL', (z % 4 > 0)::int + (z % 2 = 0)::int from p where z % 4 > 0 or z % 2 = 0
  union all select 'src/joins.sql', 'ddl/tables.sql', 'NEEDS_DDL', 3""")
def file_edges(a):
    return a.file_need.select("src", "dst", "type", F.col("count").cast("long").alias("n"))


@coded(f"""with {P}, {WRITES}, u as (select distinct 'src/' || lower(src) || '.prc' f, dst t from w)
  select x.f as src, y.f as dst, count(*) as n from u x join u y on x.t = y.t and x.f < y.f group by all""")
def shared_tables(a):
    return a.shared_table.select("src", "dst", F.col("count").alias("n"))


@coded(None)
def reading_order(a):
    """Depth-first post-order of the file graph: sequential, so there is no SQL for it."""
    return filedeps.reading_order(a.file_node, a.file_need)[0]


@coded(f"with {P}, {CALLS}, b as (select src x, dst y from c union select dst, src from c), h0 as (select 'EXT_PKG.DO_IT' node, 0 d), h1 as (select y node, 1 d from b join h0 on b.x = h0.node union select * from h0), h2 as (select y node, 2 d from b join h1 on b.x = h1.node union select * from h1) select node, cast(min(d) as integer) as distance from h2 group by node")
def khop_neighbourhood(a):
    return graph.neighbourhood(a.edge.where("type = 'CALLS'"), "EXT_PKG.DO_IT", 2)


@coded(f"""with {P} select 'PART_' || k as owner_id, 'INV_' || (z % 5) as table_key, 'UPDATE' as access, 'ID,QTY' as reads, 'QTY' as writes, cast(z % 4 as bigint) as n from p where z % 4 > 0
  union all select 'PART_' || k, 'STOCK_' || (z % 3), 'READ', 'ID', '', 1 from p where z % 2 = 0 union all select 'PART_' || k, 'TMP_T', 'DELETE', '', '', 1 from p where z % 11 = 0
  union all select 'JOIN_' || i, 'SHIP', 'READ', 'STOCK_REF', '', 1 from {J3} union all select 'JOIN_' || i, 'STOCK_' || i, 'READ', 'ID,QTY', '', 1 from {J3}""")
def column_access(a):
    r = a.ref.select("owner_id", "table_key", F.array_join("access", ",").alias("access"), F.array_join("read_cols", ",").alias("reads"), F.array_join("write_cols", ",").alias("writes"))
    return r.groupBy("owner_id", "table_key", "access", "reads", "writes").agg(F.count("*").alias("n"))


@coded(f"""with {P}, o as (select 'ASSIGN' kind, count(*) n from p union all select x, sum(z % 4) from p, (values ('IF'), ('THEN'), ('SQL')) v(x) group by x union all select x, sum((z % 2 = 0)::int) from p, (values ('FOR_LOOP'), ('SQL')) v(x) group by x
  union all select 'CALL', sum((z % 3 = 0)::int + (z % 13 = 0)::int) from p union all select 'DYNAMIC_SQL', sum((z % 11 = 0)::int) from p union all select 'COMMIT', sum((z % 5 = 0)::int) from p union all select x, sum((z % 7 = 0)::int) from p, (values ('EXCEPTION_SECTION'), ('HANDLER'), ('NULL')) v(x) group by x
  union all select 'SQL', 3 union all select x, y * count(*) from s, (values ('CALL', 3), ('ASSIGN', 1), ('RETURN', 1)) v(x, y) where k % 4 <> 0 group by x, y)
  select kind, cast(sum(n) as bigint) as n from o group by kind having sum(n) > 0""")
def outline_kinds(a):
    return a.step.groupBy("kind").agg(F.count("*").alias("n"))


@coded(f"""with {P} select 'PART_' || k as owner_id, cast(z % 4 + (z % 2 = 0)::int + (z % 11 = 0)::int as bigint) as sqls, cast((z % 3 = 0)::int + (z % 13 = 0)::int as bigint) as calls from p where z % 4 > 0 or z % 2 = 0 or z % 11 = 0 or z % 3 = 0 or z % 13 = 0
  union all select 'JOIN_' || i, 1, 0 from {J3} union all select 'PKG_' || k || x, 0, 1 from s, (values ('.RUN#1'), ('.RUN#2'), ('.TOTAL'), ('.HELPER')) v(x) where k % 4 <> 0""")
def step_links(a):
    own = a.step.select("file", "variant", "unit", "routine", "path", "owner_id")
    j = a.step_ref.join(own, ["file", "variant", "unit", "routine", "path"])
    return j.groupBy("owner_id").agg(F.sum((F.col("what") == "sql").cast("long")).alias("sqls"), F.sum((F.col("what") == "call").cast("long")).alias("calls"))


@coded(f"""with {P} select 'PART_' || k as id, 'PROCEDURE part_' || k || ' (p_id IN NUMBER)' as signature, 'STANDALONE' as visibility from p union all select 'JOIN_' || i, 'PROCEDURE join_' || i, 'STANDALONE' from {J3}
  union all select 'PKG_' || k || x, y, 'PUBLIC' from s, (values ('.RUN#1', 'PROCEDURE run (p_a IN NUMBER)'), ('.RUN#2', 'PROCEDURE run (p_a IN NUMBER, p_b IN NUMBER)'), ('.TOTAL', 'FUNCTION total (p_a IN NUMBER) RETURN NUMBER')) v(x, y)
  union all select 'PKG_' || k || '.HELPER', 'PROCEDURE helper (p_a IN NUMBER)', 'PRIVATE' from s where k % 4 <> 0""")
def routine_signatures(a):
    return a.routine.select("id", "signature", "visibility")


@query("""with t as (select p_partkey k, p_size % 3 m from part) select k, 'primary' as variant, case when m = 0 then 'one' else 'two' end as kept from t union all select k, 'alternate', 'one' from t where m = 2""")
def ifdef_variants(spark, sf_dir):
    """Conditional compilation: flag 0 is true, 1 false, 2 unknown."""
    import pandas as pd

    from codeloom.functions.scan import variants

    def run(batches):
        for b in batches:
            out = [(k, v.name, v.text.split()[0]) for k, text in zip(b["k"], b["text"], strict=True) for v in variants(text, {"f_0": True, "f_1": False})]
            yield pd.DataFrame(out, columns=["k", "variant", "kept"])

    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    text = F.concat(F.lit("$if $$f_"), (F.col("p_size") % 3).cast("string"), F.lit(" $then one $else two $end"))
    return part.select(F.col("p_partkey").alias("k"), text.alias("text")).mapInPandas(run, "k long, variant string, kept string")


# --- B: generic operators over the driver's tables

@query("""with n as (select 'n' || lpad(cast(n_nationkey as varchar), 9, '0') node, n_regionkey r from nation union all select 'r' || lpad(cast(r_regionkey as varchar), 9, '0'), r_regionkey from region
  union all select 'c' || lpad(cast(c_custkey as varchar), 9, '0'), n_regionkey from customer join nation on c_nationkey = n_nationkey) select node, min(node) over (partition by r) as component from n""")
def components_regions(spark, sf_dir):
    """Components of customers, nations and regions: those of a region hold together."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    key = lambda kind, c: F.concat(F.lit(kind), F.lpad(F.col(c).cast("string"), 9, "0"))
    nation = read("nation")
    e = read("customer").select(key("c", "c_custkey").alias("src"), key("n", "c_nationkey").alias("dst")).unionByName(nation.select(key("n", "n_nationkey").alias("src"), key("r", "n_regionkey").alias("dst")))
    return graph.components(e, e.select(F.col("src").alias("node")).union(read("region").select(key("r", "r_regionkey"))))


@query()
def components_all_lines(spark, sf_dir):
    """Components over all pairs of part and supplier, with whole keys. A recursive SQL has a row for each pair of
    connected nodes, so there is none; a test compares with union-find."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_partkey is not null and l_suppkey is not null")
    key = lambda kind, c: F.concat(F.lit(kind), F.lpad(F.col(c).cast("string"), 19, "0"))
    e = li.select(key("p", "l_partkey").alias("src"), key("s", "l_suppkey").alias("dst")).distinct()
    return graph.components(e, e.select(F.col("src").alias("node")))


@query("with d as (select distinct user_id, cast(floor(epoch(ts) / 3600) as bigint) h from events), g as (select *, h - row_number() over (partition by user_id order by h) r from d) select user_id, min(h) as \"from\", max(h) as \"to\" from g group by user_id, r")
def islands_event_gaps(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.floor(F.unix_timestamp("ts") / 3600).alias("h"))
    return score.islands(e, ["user_id"], "h")


@query("select l_orderkey, l_linenumber, cast(running as bigint) as running from (select l_orderkey, l_linenumber, sum(cast(l_quantity as bigint)) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity rows unbounded preceding) running from lineitem) where running <= 40")
def running_cap(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"))
    order = ["l_linenumber", "l_partkey", "l_suppkey", "q"]
    kept = score.running_cap(li, ["l_orderkey"], order, "q", 40)
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return kept.select("l_orderkey", "l_linenumber", F.sum("q").over(w).alias("running"))


@query("select o_orderpriority, round(sum(cast(round(o_totalprice) as bigint) * (o_orderkey % 7 + 1)) / sum(o_orderkey % 7 + 1), 4) as mean from orders group by 1")
def weighted_mean(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderpriority", F.round("o_totalprice").cast("long").alias("v"), (F.col("o_orderkey") % 7 + 1).alias("w"))
    return o.groupBy("o_orderpriority").agg(F.round(F.sum(F.col("v") * F.col("w")) / F.sum("w"), 4).alias("mean"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")
def topk_orders(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("with u as (select distinct l_orderkey o, l_suppkey s, max(l_returnflag = 'R') over (partition by l_orderkey, l_suppkey) w from lineitem) select 's' || lpad(cast(least(x.s, y.s) as varchar), 9, '0') as src, 's' || lpad(cast(greatest(x.s, y.s) as varchar), 9, '0') as dst, count(distinct x.o) as n from u x join u y on x.o = y.o and x.s <> y.s and x.w group by all")
def pairs_shared_order(spark, sf_dir):
    """Pairs of suppliers with a common order of which one had a return: the operator of files that share a table."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    use = li.groupBy(F.col("l_orderkey").cast("string").alias("key"), F.concat(F.lit("s"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")).alias("file")).agg(F.max(F.col("l_returnflag") == "R").alias("w"))
    return filedeps.shared_tables(use).select("src", "dst", F.col("count").alias("n"))


@query("""with b as (select o_custkey c, o_orderkey k, cast(floor(epoch(o_orderdate) / 86400) as bigint) f, cast(floor(epoch(o_orderdate) / 86400) as bigint) + 30 t from orders), p as (select distinct c, f + 10 as "at" from b)
  select c, "at", k from (select p.c, p."at", b.k, row_number() over (partition by p.c, p."at" order by b.f, b.k) r from p join b on p.c = b.c and p."at" between b.f and b.t) where r = 1""")
def interval_claim(spark, sf_dir):
    """Points to the first interval that holds them, always with an equality on the key."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("k"), F.floor(F.unix_timestamp("o_orderdate") / 86400).alias("line"))
    spans = o.withColumn("end_line", F.col("line") + 30)
    points = o.select("c", (F.col("line") + 10).alias("at")).distinct()
    return score.interval_first(points, spans, ["c"], "at", ["line", "k"]).select("c", "at", "k")


@query("select c_nationkey, c_custkey, nth from (select c_nationkey, c_custkey, cast(row_number() over (partition by c_nationkey order by c_acctbal, c_custkey) as integer) nth from customer)")
def first_wins(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return link.first_wins(c, ["c_nationkey"], ["c_acctbal", "c_custkey"]).select("c_nationkey", "c_custkey", "nth")


@query("(select l_partkey k from lineitem where l_returnflag = 'A' union select l_partkey from lineitem where l_returnflag = 'R') except select p_partkey from part where p_size > 25")
def set_union_except(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_partkey").alias("k"), "l_returnflag")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_size > 25").select(F.col("p_partkey").alias("k"))
    return li.where("l_returnflag = 'A'").select("k").union(li.where("l_returnflag = 'R'").select("k")).distinct().join(part, "k", "left_anti")


@query("with b as (select distinct o_custkey k from orders), c as (select c_custkey k from customer where c_acctbal > 0) select coalesce(b.k, c.k) as k, b.k is not null as ordered, c.k is not null as in_credit from b full join c on b.k = c.k")
def full_outer_flags(spark, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("k")).distinct().withColumn("ordered", F.lit(True))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.lit(True).alias("in_credit"))
    return b.join(c, "k", "full_outer").select("k", F.coalesce("ordered", F.lit(False)).alias("ordered"), F.coalesce("in_credit", F.lit(False)).alias("in_credit"))


# --- C: text operators over the driver's tables

@query("select doc_id, cast(i - 1 as integer) as no, l[i] as line from (select doc_id, string_split_regex(\"text\", '\\r?\\n') l from documents), unnest(range(1, len(l) + 1)) u(i)")
def doc_lines(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("no", "line"))


@query("select p_partkey, trim(regexp_replace('  ' || p_name || '   x ', '\\s+', ' ', 'g')) as norm, case when length(p_name) > 8 then substr(p_name, 1, 8) || '...' else p_name end as clip, lower(replace(trim(' \"' || p_name || '\" '), '\"', '')) as ident, upper(replace(trim(regexp_replace('\"' || p_name || '\"', '\\s+', ' ', 'g')), '\"', '')) as unquote, cast(ceil(length(p_name) / 4.0) as bigint) as tokens from part")
def text_norm(spark, sf_dir):
    n = F.col("p_name")
    quoted = F.concat(F.lit('"'), n, F.lit('"'))
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", T.norm(F.concat(F.lit("  "), n, F.lit("   x "))).alias("norm"), T.clip(n, 8).alias("clip"), T.ident(F.concat(F.lit(" "), quoted, F.lit(" "))).alias("ident"), T.unquote(quoted).alias("unquote"), T.token_estimate(n).alias("tokens"))


@query("with l as (select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) target from pages) select page_id, target, count(*) as n from l where not exists (select 1 from pages p where p.url = l.target) group by all")
def link_check(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    links = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
    return links.join(p.select(F.col("url").alias("target")).distinct(), "target", "left_anti").groupBy("page_id", "target").agg(F.count("*").alias("n"))


@query("select sha256(\"text\") as digest, count(*) as n, min(doc_id) as first from documents group by 1 having count(*) > 1")
def sha_dupes(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("digest"))
    return d.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query("select source, cast(sum(cast(ceil(length(\"text\") / 4.0) as bigint)) as bigint) as tokens, sum(cast(ceil(length(\"text\") / 4.0) as bigint)) > 100000 as over from documents group by source")
def token_budget(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy("source").agg(F.sum(T.token_estimate(F.col("text"))).alias("tokens"))
    return d.select("source", "tokens", (F.col("tokens") > 100000).alias("over"))


@query("select doc_id from documents where contains(lower(\"text\"), 'the') and contains(lower(\"text\"), 'and') and contains(lower(\"text\"), 'license')")
def search_all_words(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    low = F.lower("text")
    words = "the and license".split()
    return d.where(F.forall(F.lit(words), lambda w: F.contains(low, w))).select("doc_id")


@query("select doc_id, 'license' as topic from documents where regexp_matches(\"text\", '(?i)licen[sc]e') union all select doc_id, 'mail' from documents where regexp_matches(\"text\", '[a-z0-9.]+@[a-z0-9.]+') union all select doc_id, 'number' from documents where regexp_matches(\"text\", '[0-9]{4,}')")
def rule_notes(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    table = [("license", "(?i)licen[sc]e"), ("mail", "[a-z0-9.]+@[a-z0-9.]+"), ("number", "[0-9]{4,}")]
    hits = F.filter(F.array(*(F.when(F.col("text").rlike(p), F.lit(t)) for t, p in table)), lambda x: x.isNotNull())
    return d.select("doc_id", F.explode(hits).alias("topic"))


@query("select doc_id, 'x := ''' || regexp_replace(replace(\"text\", '''', ''''''), '[^\\r\\n]', ' ', 'g') || '''; ' || '    ' as masked from documents")
def mask_documents(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    code = F.concat(F.lit("x := '"), F.replace("text", F.lit("'"), F.lit("''")), F.lit("'; -- c"))
    return d.select("doc_id", T.mask_sql(code).alias("masked"))


@query("select p_partkey, regexp_matches(p_name, array_to_string(string_split(p_type, ''), '.*')) as type_in_name, true as name_in_itself from part")
def subsequence(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", T.is_subsequence(F.col("p_type"), F.col("p_name")).alias("type_in_name"), T.is_subsequence(F.regexp_replace("p_name", "[aeiou]", ""), F.col("p_name")).alias("name_in_itself"))


@coded(f"with {P}, {CALLS}, e as (select distinct src, dst from c where how = 'INTERNAL'), n as (select src node from e union select dst from e), i as (select dst node, string_agg(src, ',' order by src) x from e group by 1), o as (select src node, string_agg(dst, ',' order by dst) x from e group by 1) select n.node as node, coalesce(i.x, '') as callers, coalesce(o.x, '') as callees from n left join i on n.node = i.node left join o on n.node = o.node")
def callers_callees(a):
    return a.adjacency.select("node", F.array_join("callers", ",").alias("callers"), F.array_join("callees", ",").alias("callees"))


@coded(f"with {P} select 'PKG_' || k as owner, 'PART_' || (k % n) as calls, '' as reads, '' as unresolved from s where k % 4 <> 0")
def package_dependencies(a):
    return a.package_dependency.select("owner", *(F.array_join(c, ",").alias(c) for c in ("calls", "reads", "unresolved")))


@coded(f"""with {P}, x as (select k, {LOC} l, 1 + 2 * (z % 4) + 2 * (z % 2 = 0)::int + (z % 3 = 0)::int + (z % 13 = 0)::int + (z % 11 = 0)::int + (z % 5 = 0)::int + (z % 7 = 0)::int st, (z % 2 = 0)::int lo, z % 4 + (z % 2 = 0)::int + (z % 11 = 0)::int q, (z % 3 = 0)::int + (z % 13 = 0)::int c, z from p)
  select 'PART_' || k as owner_id, concat_ws('; ', l || ' lines', st || case when st = 1 then ' statement' else ' statements' end, case when lo > 0 then '1 loop' end, case when q > 0 then q || case when q = 1 then ' SQL statement' else ' SQL statements' end end, case when c > 0 then c || case when c = 1 then ' call' else ' calls' end end,
    case when z % 2 = 0 then 'reads STOCK_' || (z % 3) end, case when z % 4 > 0 and z % 11 = 0 then 'writes INV_' || (z % 5) || ', TMP_T' when z % 4 > 0 then 'writes INV_' || (z % 5) when z % 11 = 0 then 'writes TMP_T' end) as sentence from x
  union all select 'JOIN_' || i, '5 lines; 1 statement; 1 SQL statement; reads SHIP, STOCK_' || i from {J3}
  union all select 'PKG_' || k || x, case when k % 4 = 0 then '1 line' else y end from s, (values ('.RUN#1', '4 lines; 1 statement; 1 call'), ('.RUN#2', '4 lines; 1 statement; 1 call'), ('.TOTAL', '5 lines; 2 statements; 1 call'), ('.HELPER', '4 lines; 1 statement; 1 call')) v(x, y) where k % 4 <> 0 or x <> '.HELPER'""")
def fact_sentences(a):
    return a.sentence


@coded(f"with {P} select 'PART_' || k as owner_id, 'VARIABLE' as kind, 'v_n' as name, 'NUMBER' as type, '0' as default_text from p union all select 'JOIN_' || i, 'VARIABLE', 'v_q', 'NUMBER', null from {J3} union all select 'PKG_' || k || '.<init>', 'VARIABLE', 'g_n', 'NUMBER', '0' from s where k % 4 <> 0 union all select 'PART_' || k, 'LOOP_VARIABLE', 'r', null, null from p where z % 2 = 0")
def declarations(a):
    return a.declaration.select("owner_id", "kind", "name", "type", "default_text")


@coded(f"with {P}, {CALLS} select src as owner_id, case when how = 'EXTERNAL' then dst || ' (not found here)' else dst end as said from c")
def described_calls(a):
    return a.described_call.select("owner_id", "said")


@coded(f"with {P} select cast((select count(*) from p) + 3 + (select sum(3 + (k % 4 <> 0)::int) from s) as bigint) as identical, cast(0 as bigint) as subsequence, cast(0 as bigint) as different")
def source_roundtrip(a):
    from codeloom.plans.verify import roundtrip

    return roundtrip(a)


@coded(f"with {P} select 'PART_' || k as id, 'objects/_standalone/part_' || k as path from p union all select 'JOIN_' || i, 'objects/_standalone/join_' || i from {J3} union all select 'PKG_' || k || x, 'objects/pkg_' || k || y from s, (values ('.RUN#1', '/run-1'), ('.RUN#2', '/run-2'), ('.TOTAL', '/total'), ('.HELPER', '/helper')) v(x, y) where k % 4 <> 0 or x <> '.HELPER'")
def card_paths(a):
    from codeloom.plans.docs import cards

    return cards(a).select("id", "path")


@query("select p_partkey, p_name as q_quoted, p_name || '''s' as doubled, 'N' || p_name as national from part")
def literal_decode(spark, sf_dir):
    n = F.col("p_name")
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", T.literal(F.concat(F.lit("q'["), n, F.lit("]'"))).alias("q_quoted"), T.literal(F.concat(F.lit("'"), n, F.lit("''s'"))).alias("doubled"), T.literal(F.concat(F.lit("n'N"), n, F.lit("'"))).alias("national"))


@query("select doc_id, cast(length(h) - length(replace(h, chr(10), '')) + 1 as integer) as line from (select doc_id, substr(\"text\", 1, length(\"text\") // 2) h from documents)")
def line_numbers(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", T.line_of(F.col("text"), F.floor(F.char_length("text") / 2)).alias("line"))


@query("select p_partkey, p_name || ' -> ... >= \"x\"' as folded from part")
def ascii_folding(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", T.fold_ascii(F.concat("p_name", F.lit(" → … ≥ “x”"))).alias("folded"))


@query("select doc_id, case when doc_id % 101 >= 90 then 'A' when doc_id % 101 >= 75 then 'B' when doc_id % 101 >= 60 then 'C' else 'D' end as grade from labels")
def grades(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", T.grade(F.col("doc_id") % 101).alias("grade"))


@query("select doc_id, array_to_string(list_transform(range(1, len(l) + 1), lambda i: lpad(cast(i as varchar), cast(length(cast(len(l) as varchar)) as integer), ' ') || '  ' || l[i]), chr(10)) as slice from (select doc_id, string_split_regex(\"text\", '\\r?\\n') l from documents)")
def numbered_slices(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", T.numbered_slice(F.col("text"), F.lit(1), F.size(T.lines(F.col("text")))).alias("slice"))


@query("""with o as (select p_partkey k, p_size z from part where p_size < 40), n as (select p_partkey k, p_size + (p_partkey % 3 = 0)::int z from part where p_size > 10)
  select 'f' || coalesce(o.k, n.k) as path, case when o.k is null then 'ADDED' when n.k is null then 'REMOVED' else 'CHANGED' end as change from o full join n on o.k = n.k where o.k is null or n.k is null or o.z <> n.z""")
def watch_diff(spark, sf_dir):
    from codeloom.streaming.watch import diff

    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    path, when = F.concat(F.lit("f"), F.col("p_partkey").cast("string")), F.lit("2020-01-01").cast("timestamp")
    old = part.where("p_size < 40").select(path.alias("path"), F.col("p_size").cast("long").alias("size"), when.alias("modified"))
    new = part.where("p_size > 10").select(path.alias("path"), (F.col("p_size") + (F.col("p_partkey") % 3 == 0).cast("int")).cast("long").alias("size"), when.alias("modified"))
    return diff(old, new)


@query(None)
def status_fold(spark, sf_dir):
    """The fold of build events over the events table, a build for each user; a state machine, so there is no SQL."""
    import pandas as pd

    from codeloom.streaming.watch import EMPTY, fold

    kinds = {"signup": "start", "view": "stage", "click": "file", "error": "log", "purchase": "finished"}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        now, pdf = EMPTY, pdf.sort_values("event_id")
        for i, t in zip(pdf["event_id"].tolist(), pdf["event_type"].tolist(), strict=True):
            now = fold(now, {"kind": kinds[t], "text": f"e{i}", "done": i % 100, "total": 100})
        return pd.DataFrame([(pdf["user_id"].iloc[0], now["state"], now["done"], len(now["log"]))], columns=["build", "state", "done", "n_log"])

    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").applyInPandas(run, "build long, state string, done long, n_log int")
