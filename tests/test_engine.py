import json
import os
import re

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from codeloom.operators import rules
from codeloom.plans import docs, verify, views
from codeloom.plans.engine import Analysis

FILES = {
    "orders.pks": "create or replace package orders_api as\n  -- Purpose: place an order\n  procedure place(p_id in number, p_qty in number default 1);\n  procedure log(p varchar2);\n  procedure log(p varchar2, q number);\n  procedure gone(p number);\nend;\n/\n",
    "orders.pkb": "create or replace package body orders_api as\n  g_last number;\n  procedure place(p_id in number, p_qty in number default 1) is\n    v number;\n  begin\n    select max(o.qty) into v from orders o, shipments s where s.order_ref = o.id;\n    update orders set qty = p_qty where id = p_id;\n    log('x', 1);\n    audit_api.write(p_id);\n    g_last := p_id;\n    dbms_output.put_line('x');\n  end;\n  procedure log(p varchar2) is begin null; end;\n  procedure log(p varchar2, q number) is begin log(p); exception when others then null; end;\n  procedure unused is begin unused; end;\nend;\n/\n",
    "ddl/tables.sql": "create table customers (id number primary key);\ncreate table orders (id number primary key, customer_id number not null, qty number);\nalter table orders add constraint o_c foreign key (customer_id) references customers (id);\n",
    "trg.trg": "create or replace trigger orders_bi before insert on orders for each row\nbegin\n  orders_api.place(:new.id);\nend;\n/\n",
}


@pytest.fixture(scope="module")
def a(spark):
    return Analysis(spark.createDataFrame(list(FILES.items()), "file string, text string"))


def ids(df, *cols):
    return {tuple(r) if len(cols) > 1 else r[0] for r in df.select(*cols).collect()}


def test_linking(a):
    assert ids(a.routine, "id", "visibility") == {("ORDERS_API.PLACE", "PUBLIC"), ("ORDERS_API.LOG#1", "PUBLIC"), ("ORDERS_API.LOG#2", "PUBLIC"), ("ORDERS_API.GONE", "PUBLIC"), ("ORDERS_API.UNUSED", "PRIVATE")}
    assert "spec-routine-without-body" in ids(a.issue, "code")


def test_calls(a):
    got = {(r["owner_id"], ".".join(r["parts"]).lower()): (r["resolution"], r["targets"]) for r in a.call.collect()}
    assert got["ORDERS_API.PLACE", "log"] == ("INTERNAL", ["ORDERS_API.LOG#2"])
    assert got["ORDERS_API.PLACE", "audit_api.write"] == ("EXTERNAL", None)
    assert got["ORDERS_API.PLACE", "dbms_output.put_line"][0] == "BUILTIN"
    assert got["TRIGGER:ORDERS_BI", "orders_api.place"] == ("INTERNAL", ["ORDERS_API.PLACE"])


def test_columns_joins_and_relations(a):
    assert {(r["table_key"], tuple(r["access"]), tuple(r["read_cols"]), tuple(r["write_cols"])) for r in a.ref.collect()} == {("ORDERS", ("READ",), ("ID", "QTY"), ()), ("SHIPMENTS", ("READ",), ("ORDER_REF",), ()), ("ORDERS", ("UPDATE",), ("ID",), ("QTY",))}
    rel = {(r["src"], r["dst"], r["origin"], r["cardinality"], r["required"]) for r in a.er["relation"].collect()}
    assert rel == {("ORDERS", "CUSTOMERS", "DECLARED", "MANY_TO_ONE", True), ("SHIPMENTS", "ORDERS", "INFERRED", "MANY_TO_ONE", False)}


def test_effects_risks_graph(a):
    assert ("ORDERS_API.PLACE", "STATE_WRITE", "G_LAST") in ids(a.effect, "owner_id", "effect_kind", "detail")
    assert {"WHEN_OTHERS_NULL", "PACKAGE_STATE_WRITE", "UNRESOLVED_CALL", "SELECT_INTO_NO_HANDLER"} <= ids(a.risk, "code")
    assert rules.ordered(a.risk).first()["severity"] == "HIGH"
    assert ids(a.recursion, "component") == {"ORDERS_API.UNUSED"}
    assert ("ORDERS_API.UNUSED", "DEAD") in ids(a.uncalled, "node", "what")
    batch = dict(ids(a.batch, "node", "batch"))
    assert batch["ORDERS_API.PLACE"] == 2 and batch["ORDERS_API.LOG#2"] == 1 and batch["ORDERS_API.LOG#1"] == 0


def test_files_and_missing(a):
    edges = ids(a.file_edge, "src", "dst", "type")
    assert {("trg.trg", "orders.pkb", "CALLS"), ("orders.pkb", "orders.pks", "SPEC_BODY"), ("orders.pkb", "ddl/tables.sql", "NEEDS_DDL")} <= edges
    assert {("EXTERNAL_PACKAGE", "AUDIT_API"), ("TABLE_DDL_MISSING", "SHIPMENTS")} <= ids(a.missing, "kind", "name")
    assert a.gaps.isEmpty() and a.outline_mismatch.isEmpty()


def test_documents_are_deterministic_and_verified(a, spark, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    docs.write(a, one)
    verdict = verify.write(a, one)
    assert verdict in ("VERIFIED", "VERIFIED_WITH_WARNINGS", "NOT_VERIFIED")
    check = {c["id"]: c["status"] for c in json.load(open(f"{one}/analysis/verification.json"))["checks"]}
    assert all(check[k] == "PASS" for k in ("files", "syntax", "coverage", "statements", "roundtrip", "cards", "links", "source"))
    docs.write(Analysis(spark.createDataFrame(list(FILES.items())[::-1], "file string, text string")), two)
    for d, _, names in os.walk(two):
        for n in names:
            p = os.path.join(d, n)
            assert open(p, "rb").read() == open(p.replace(two, one), "rb").read(), p
    card = json.load(open(f"{one}/objects/orders_api/place.json"))
    assert card["purpose"] == "place an order" and "spec_file" in card
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "x").write_text("keep")
    with pytest.raises(FileExistsError):
        docs.guard(str(tmp_path / "other"))


def test_views(a):
    assert ids(views.search(a.routine, "ORDERS place", "id"), "id") == {"ORDERS_API.PLACE"}
    assert views.step_at(a.step, "ORDERS_API.PLACE", 7).first()["kind"] == "SQL"
    pack = views.prompt_pack(a.routine.select("id", F.col("signature").alias("content")), a.calls, "ORDERS_API.PLACE", 1, 30)
    assert pack.first()["id"] == "ORDERS_API.PLACE"


def test_alternate_only_routines(spark):
    b = Analysis(spark.createDataFrame([("x.sql", "$if $$extra $then\ncreate procedure only_alt is begin null; end;\n/\n$end\ncreate procedure always is begin null; end;\n/\n")], "file string, text string"))
    assert ids(b.routine, "id") == {"ONLY_ALT~ALT", "ALWAYS"}
    assert "ALTERNATE_VARIANT_ONLY" in ids(b.finding, "code")


def test_bad_syntax_is_not_verified_and_nothing_is_lost(spark, tmp_path):
    b = Analysis(spark.createDataFrame([("bad.sql", "create procedure p is begin if x then null; end;\n/\n"), ("ok.sql", "create procedure q is begin null; end;\n/\n")], "file string, text string"))
    docs.write(b, str(tmp_path / "d"))
    assert verify.write(b, str(tmp_path / "d")) == "NOT_VERIFIED"
    assert ids(b.routine, "id") >= {"Q"}


def test_facts_are_typed_and_pruned(a):
    """A query of two columns of one table reads these columns of this table's files."""
    plan = a.fact("sql").select("file", "kind")._jdf.queryExecution().executedPlan().toString()
    assert "from_json" not in plan and "f_sql:struct<kind:string>" in plan and "tbl" in plan and "f_step" not in plan.split("ReadSchema")[1]
    assert a.fact("sql").schema["step"].dataType.simpleString() == "array<int>"


def test_long_lists_become_files_of_lines(a, tmp_path, monkeypatch):
    monkeypatch.setattr(docs, "REPORT_ROWS", 3)
    out = str(tmp_path / "long")
    docs.write(a, out)
    lines = [json.loads(x) for d, _, names in os.walk(f"{out}/analysis/nodes") for n in sorted(names) for x in open(f"{d}/{n}")]
    assert {x["id"] for x in lines} == ids(a.node, "id") and len(lines) == a.node.count()
    assert json.load(open(f"{out}/analysis/graph.json"))["nodes"] == [{"lines_in": "analysis/nodes/"}]
    assert verify.links(out, a.spark).isEmpty()


def test_known_names():
    from codeloom.functions import builtins

    for name in ("ora_hash", "xmltype", "cume_dist", "percent_rank", "sys_connect_by_path", "nls_upper", "existsnode", "sys_extract_utc"):
        assert name in builtins.FUNCTIONS
    import re

    for name in ("ora_x", "xmldom", "xslprocessor", "wpg_docload", "anytype", "diutil", "ku$_job", "sa_user", "json_object_t", "dbms_sql"):
        assert re.match(builtins.PACKAGE, name)
    assert not re.match(builtins.PACKAGE, "orders_api")


def test_plans_stay_small(spark, monkeypatch):
    """What the driver plans at once is bounded: a scan has the columns of one fact table, a kept table few joins."""
    plans, write = {}, DataFrameWriter.parquet

    def put(self, path, *args, **named):
        plans[re.sub(r"-[0-9a-f]{32}$", "", path.rsplit("/", 1)[-1])] = self._df._jdf.queryExecution().optimizedPlan().toString()
        return write(self, path, *args, **named)

    monkeypatch.setattr(DataFrameWriter, "parquet", put)
    a = Analysis(spark.createDataFrame(list(FILES.items()), "file string, text string"))
    for name in ("er_cluster", "effect", "missing", "confidence", "rank", "adjacency", "sentence", "step_ref", "package_overview", "uncalled", "impact"):
        getattr(a, name)
    scans = [s for p in plans.values() for s in re.findall(r"Relation \[([^\]]*)\]", p)]
    assert max(len(set(re.findall(r"\bf_\w+", s))) for s in scans) == 1
    joins = {k: len(re.findall(r"\bJoin (?:Inner|Left|Right|Full|Cross)", p)) for k, p in plans.items()}
    assert max(joins.values()) <= 30, joins
