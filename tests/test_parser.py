from codeloom.functions.parser import parse


def rows(text, table):
    return parse(text).get(table, [])


BODY = """create or replace package body shop as
  g_total number := 0;
  e_low exception; pragma exception_init(e_low, -20007);
  type t_line is record (sku varchar2(9), qty number);
  cursor c_open(p number) is select id from orders where id = p;
  procedure later(p number);
  function twice(p number) return number deterministic is begin return p * 2; end;
  procedure later(p number) is
    procedure inside is begin null; end;
  begin
    inside;
  end later;
begin
  g_total := 1;
end shop;
/
"""

EVERYTHING = """create or replace procedure all_kinds(p in number, o out varchar2) is
  v number; l t_list; c sys_refcursor;
begin
  v := 1;
  if p = 1 then null; elsif p = 2 then return; else v := 2; end if;
  case p when 1 then null; else null; end case;
  <<outer>> loop exit outer when v > 3; continue; end loop outer;
  while v < 5 loop v := v + 1; end loop;
  for i in 1 .. 3 loop null; end loop;
  for r in (select a from t) loop insert into u (a) values (r.a); end loop;
  forall i in 1 .. 3 update t set a = i;
  declare x number; begin null; exception when no_data_found then raise; end;
  goto done;
  open c for select a from t; fetch c into v; close c;
  open c for 'select 1 from dual';
  execute immediate 'drop table z';
  l.extend; pipe row (v); grant_it(1);
  savepoint s; rollback; commit; set transaction read only;
  raise_application_error(-20001, 'bad');
  <<done>> null;
exception
  when others then raise;
end;
/
"""


def test_declarations_and_nesting():
    r = parse(BODY)
    assert "error" not in r
    assert [(x["name"], x["forward"], x["depth"]) for x in r["routine"]] == [("later", True, 0), ("twice", False, 0), ("later", False, 0), ("inside", False, 1)]
    assert r["routine"][1]["attributes"] == ["DETERMINISTIC"] and r["unit"][0]["has_init"]
    kinds = {(d["kind"], d["name"]) for d in r["decl"]}
    assert {("VARIABLE", "g_total"), ("EXCEPTION", "e_low"), ("TYPE", "t_line"), ("CURSOR", "c_open")} <= kinds
    assert r["exception_init"] == [{"unit": 0, "routine": -1, "name": "e_low", "code": -20007}]


def test_every_statement_kind_and_no_loss():
    r = parse(EVERYTHING)
    assert "error" not in r
    kinds = [s["kind"] for s in r["step"]]
    want = "ASSIGN IF THEN ELSIF ELSE CASE WHEN LOOP WHILE_LOOP FOR_LOOP CURSOR_FOR_LOOP FORALL BLOCK EXIT CONTINUE GOTO LABEL NULL RAISE RETURN CALL PIPE_ROW SQL DYNAMIC_SQL COLLECTION_OP OPEN_FOR FETCH CLOSE_CURSOR COMMIT ROLLBACK SAVEPOINT SET_TRANSACTION EXCEPTION_SECTION HANDLER".split()
    assert set(want) <= set(kinds) and "UNKNOWN" not in kinds
    assert sum(s["counts"] for s in r["step"]) == sum(c["statements"] for c in r["count"])
    assert sum(k in ("LOOP", "WHILE_LOOP", "FOR_LOOP", "CURSOR_FOR_LOOP", "FORALL") for k in kinds) == 5


def test_paths_are_a_tree():
    paths = {tuple(s["path"]) for s in parse(EVERYTHING)["step"]}
    assert all(p[:-1] in paths or len(p) == 1 for p in paths)


def access(text):
    return {(x["table"], tuple(x["access"]), tuple(x["writes"])) for x in rows(f"begin {text}; end;", "ref")}


def test_table_access():
    assert access("insert into a (x, y) select p, q from b") == {("A", ("INSERT",), ("X", "Y")), ("B", ("READ",), ())}
    assert access("update a set x = (select max(z) from c) where y = 1") == {("A", ("UPDATE",), ()), ("C", ("READ",), ())}
    assert access("delete from s.a where x in (select 1 from dual)") == {("A", ("DELETE",), ())}
    assert access("merge into a t using b s on (t.i = s.i) when matched then update set t.v = s.v when not matched then insert (i, v) values (s.i, s.v)") == {("A", ("INSERT", "UPDATE"), ("I", "V")), ("B", ("READ",), ())}
    assert access("lock table a in exclusive mode") == {("A", ("LOCK",), ())}
    assert access("with w as (select 1 x from a) select x into v from w, b join c on b.i = c.i") == {(t, ("READ",), ()) for t in "ABC"}
    assert access("select extract(year from d) into v from a") == {("A", ("READ",), ())}


def test_dynamic_sql():
    s = rows("begin execute immediate 'select 1 from t where a = b'; execute immediate 'truncate table x' || p; execute immediate p; open c for 'delete from ' || 'y'; end;", "sql")
    assert [x["dynamic_confidence"] for x in s] == ["LITERAL", "PARTIAL", "UNKNOWN", "LITERAL"]
    assert [x["dynamic_kind"] for x in s] == ["SELECT", "TRUNCATE", None, "DELETE"]


def test_joins_and_outer_marks():
    j = rows("begin select 1 into v from a, b x, s.c where a.i = x.j(+) and c.k = s.a.i; end;", "join")
    assert [(x["lq"], x["lc"], x["rq"], x["rc"]) for x in j] == [("a", "I", "x", "J"), ("c", "K", "a", "I")]


def test_ddl():
    r = parse("create table o (id number(10) primary key, c number not null references p(id) on delete cascade, s varchar2(9) default 'x', constraint u unique (s, c));\nalter table o add constraint f foreign key (s) references q (k);\n")
    assert [(c["name"], c["type"], c["not_null"]) for c in r["table_col"]] == [("ID", "number(10)", False), ("C", "number", True), ("S", "varchar2(9)", False)]
    assert [(k["kind"], k["cols"]) for k in r["table_key"]] == [("PRIMARY", ["ID"]), ("UNIQUE", ["S", "C"])]
    assert [(f["cols"], f["parent"], f["parent_cols"], f["on_delete"]) for f in r["table_fk"]] == [(["C"], "P", ["ID"], "CASCADE"), (["S"], "Q", ["K"], None)]


def test_triggers_scripts_and_skipped():
    r = parse("set serveroutput on\ncreate or replace trigger tr before insert on t for each row begin :new.id := s.nextval; end;\n/\ncreate view v as select 1 x from dual;\nprompt done\nselect 1 from dual;\n")
    assert [u["kind"] for u in r["unit"]] == ["TRIGGER"] and "on t" in r["unit"][0]["trigger_header"]
    assert [s["kind"] for s in r["skipped"]] == ["sqlplus", "create_view", "sqlplus", "select"]
    assert ("SEQUENCE", "S") in {(e["kind"], e["detail"]) for e in r["effect"]}


def test_errors_do_not_lose_the_rest():
    r = parse("create procedure a is begin if x then null; end;\n/\ncreate procedure b is begin null; end;\n/\n")
    assert r["error"] and [x["name"] for x in r["routine"]][-1] == "b"
    assert parse("") == {} or "error" not in parse("")


def test_long_texts_are_kept_whole():
    """What stands past the first thousands of characters of a statement counts."""
    wide = "x" * 5_000
    body = f"begin\n execute immediate '{wide}' || p;\n update t set a = '{wide}', b = (select /*+ full(u) */ 1 from u);\n execute immediate 'drop table ' || sys.dbms_assert.simple_sql_name(p);\nend;"
    r = parse(f"create procedure q(p varchar2) is\n{body}\n/")
    first, update, third = r["sql"]
    assert first["concatenated"] and not first["asserted"] and first["dynamic_expression"].endswith("|| p") and len(first["text"]) > 5_000
    assert update["hint"] and len(update["text"]) > 5_000 and third["asserted"] and not first["hint"]


def test_targets_of_multi_table_inserts():
    for text, want in (
        ("insert all when a > 1 then into t (a) values (a) else into u (a) values (a) select a from w", [("T", "INSERT"), ("U", "INSERT"), ("W", "READ")]),
        ("insert first into t values (a) into u values (b) select a, b from w", [("T", "INSERT"), ("U", "INSERT"), ("W", "READ")]),
        ("insert into t (a) select a into_ from w", [("T", "INSERT"), ("W", "READ")]),
    ):
        r = parse(f"begin\n {text};\nend;\n/")
        assert [(x["table"], x["access"][0]) for x in r["ref"]] == want


def test_steps_claim_their_statements():
    """The narrowest step that holds a statement or call, by brute force over all spans."""
    text = "create procedure q is\nbegin\n if f(1) = g(2) then\n  for r in (select a from t where b = h(1)) loop\n   k(m(3));\n   update t set a = n(1);\n  end loop;\n end if;\n case when f(4) = 1 then null; end case;\n forall i in 1 .. f(5) insert into t values (g(i));\nend;\n/"
    r = parse(text)
    for x in [*r["sql"], *r["call"]]:
        held = [s for s in r["step"] if s["from_off"] is not None and s["from_off"] <= x["offset"] < s["to_off"]]
        want = min(held, key=lambda s: (s["to_off"] - s["from_off"], s["link_seq"]), default=None)
        assert x["step"] == (want and want["path"])
    assert len(r["call"]) >= 8


def test_a_cursors_parameters_are_no_columns():
    r = parse("create procedure q is\n cursor c (p_x number) is select a from t where b = p_x;\nbegin\n null;\nend;\n/")
    assert {u["column"] for u in r["use"]} == {"A", "B"} and r["sql"][0]["binds"] == ["p_x"]
