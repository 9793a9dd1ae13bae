"""One file of PL/SQL to flat fact rows, without Spark. Everything that needs a second file is left to joins.

A recursive-descent parser for units, declarations and statements; expressions and SQL are scanned as balanced runs of
tokens, of which names, calls, tables and columns are kept as *candidates*. A syntax error is recorded and the parser
goes on at the next statement or unit.
"""

from __future__ import annotations

import bisect
import heapq
import re
from collections import defaultdict
from typing import Any

from codeloom.functions.scan import Token, literal, tokens

UNIT_WORDS = {"PROCEDURE", "FUNCTION", "PACKAGE", "TRIGGER", "TYPE"}
SQL_HEADS = {"SELECT", "INSERT", "UPDATE", "DELETE", "MERGE", "LOCK", "WITH"}
#: Words after a table that are no alias.
NO_ALIAS = set("WHERE GROUP ORDER CONNECT START HAVING UNION MINUS INTERSECT FOR FETCH OFFSET SET VALUES SELECT ON USING JOIN INNER LEFT RIGHT FULL CROSS NATURAL OUTER PARTITION SUBPARTITION SAMPLE WHEN RETURNING LOG INTO MODEL PIVOT UNPIVOT IN AND OR NOT IS BETWEEN LIKE MINUS LOOP FROM LIMIT BULK SEED VERSIONS THE END".split())
#: Words of SQL and PL/SQL that are never columns or variables.
WORDS = set("SELECT DISTINCT UNIQUE ALL FROM WHERE GROUP BY HAVING ORDER SIBLINGS ASC DESC NULLS FIRST LAST CONNECT START WITH PRIOR NOCYCLE UNION MINUS INTERSECT AND OR NOT IN EXISTS BETWEEN LIKE ESCAPE IS NULL CASE WHEN THEN ELSE END AS ON USING JOIN INNER LEFT RIGHT FULL CROSS NATURAL OUTER INSERT INTO VALUES UPDATE SET DELETE MERGE MATCHED RETURNING RETURN BULK COLLECT FOR OF NOWAIT WAIT SKIP LOCKED LOCK TABLE MODE EXCLUSIVE SHARE OVER PARTITION ROWS RANGE UNBOUNDED PRECEDING FOLLOWING CURRENT ROW KEEP DENSE_RANK WITHIN FETCH NEXT ONLY OFFSET PERCENT TIES ANY SOME DATE TIMESTAMP INTERVAL DAY MONTH YEAR HOUR MINUTE SECOND TO LIMIT SAVE EXCEPTIONS INDICES SAMPLE MULTISET MEMBER SUBMULTISET EMPTY TRUE FALSE DEFAULT RECORD LOG ERRORS REJECT UNLIMITED BOTH LEADING TRAILING LATERAL APPLY PIVOT UNPIVOT MODEL WHILE LOOP REVERSE AT ZONE TIME LOCAL CAST SEARCH CYCLE DEPTH BREADTH IMMEDIATE".split())
PSEUDO = set("ROWNUM ROWID LEVEL SYSDATE SYSTIMESTAMP USER NULL SQLCODE SQLERRM TRUE FALSE CONNECT_BY_ISLEAF CONNECT_BY_ISCYCLE".split())
COLLECTION = set("COUNT FIRST LAST NEXT PRIOR EXISTS DELETE EXTEND TRIM LIMIT".split())
SQLPLUS = set("SET PROMPT SHOW WHENEVER EXIT QUIT SPOOL DEFINE UNDEFINE COLUMN START REMARK ACCEPT VARIABLE PRINT CONNECT DISCONNECT TTITLE".split())
#: Words of SQL that take parentheses and are no function.
FORMS = set("EXISTS DATE TIMESTAMP ROW CUBE ROLLUP GROUPING SETS COLUMNS SEED SAMPLE XMLTABLE JSON_TABLE XMLATTRIBUTES XMLNAMESPACES PREDICTION PREDICTION_PROBABILITY PREDICTION_SET CLUSTER_ID CLUSTER_PROBABILITY PERCENTILE_CONT PERCENTILE_DISC DIMENSION MEASURES RULES PASSING PATH NESTED ORDINALITY LATERAL TABLE THE".split())
DDL_VERBS = set("TRUNCATE DROP ALTER CREATE COMMENT GRANT REVOKE ANALYZE RENAME".split())
DYNAMIC_STOP = set("SELECT DUAL TABLE SET WHERE VALUES ONLY LATERAL".split())
_DYNAMIC = re.compile(r"\b(from|join|into|update|table)\s+((?:\w+\.)?[a-z_][\w$#]*)", re.I)


class Bad(Exception):
    pass


def norm(s: str) -> str:
    return " ".join(s.split())


class Parser:
    def __init__(self, text: str):
        self.src = text
        self.t, self.comments = tokens(text)
        self.i, self.n = 0, len(self.t)
        self.rows: dict[str, list[dict[str, Any]]] = defaultdict(list)
        self.unit = -1
        self.routine = -1  # -1: the block of the unit itself
        self.routines = 0
        self.depth = 0
        self.link = self.loops = 0
        self.counts: dict[tuple[str, int, int], int] = defaultdict(int)
        self.stated: dict[tuple[int, int], int] = defaultdict(int)  # statements met, by owner

    # --- tokens
    def up(self, k: int = 0) -> str:
        j = self.i + k
        return self.t[j].up if j < self.n else ""

    def tok(self, k: int = 0) -> Token:
        j = self.i + k
        return self.t[j] if j < self.n else Token("end", "", "", len(self.src), len(self.src), self.src.count("\n") + 1)

    def take(self, *words: str) -> bool:
        if self.i < self.n and self.t[self.i].up in words:
            self.i += 1
            return True
        return False

    def need(self, *words: str) -> Token:
        if self.i < self.n and self.t[self.i].up in words:
            self.i += 1
            return self.t[self.i - 1]
        raise Bad(f"{' or '.join(words)} expected")

    def name(self) -> str:
        t = self.tok()
        if t.kind not in ("id", "quoted"):
            raise Bad("a name expected")
        self.i += 1
        return t.text.replace('"', "")

    def dotted(self) -> list[str]:
        parts = [self.name()]
        while self.up() == "." and self.tok(1).kind in ("id", "quoted"):
            self.i += 1
            parts.append(self.name())
        return parts

    def text(self, a: int, b: int) -> str:
        return norm(self.src[self.t[a].start : self.t[b - 1].end]) if a < b <= self.n and a < self.n else ""

    def line(self, k: int) -> int:
        return self.t[min(k, self.n - 1)].line if self.n else 1

    def end_line(self, k: int) -> int:
        """The last line of what ends before token k."""
        t = self.t[max(0, min(k, self.n) - 1)]
        return t.line + t.text.count("\n")

    def error(self, message: str) -> None:
        t = self.tok()
        start = self.src.rfind("\n", 0, t.start) + 1
        self.rows["error"].append({"line": t.line, "col": t.start - start + 1, "message": message[:300]})

    def until(self, *stops: str) -> int:
        """Skip to one of the stops outside parentheses and CASE; the place before is returned."""
        begin, level, cases = self.i, 0, 0
        while self.i < self.n:
            u = self.t[self.i].up
            if level == 0 and cases == 0 and u in stops:
                break
            if u == "(":
                level += 1
            elif u == ")":
                if level == 0:
                    break
                level -= 1
            elif u == "CASE":
                cases += 1
            elif u == "END" and cases:
                cases -= 1
            elif u == ";" and level == 0:
                break
            self.i += 1
        return begin

    # --- owners
    def add(self, table: str, /, **row: Any) -> dict[str, Any]:
        row = {"unit": self.unit, "routine": self.routine, **row}
        self.rows[table].append(row)
        return row

    def seq(self, table: str) -> int:
        key = (table, self.unit, self.routine)
        self.counts[key] += 1
        return self.counts[key] - 1

    def between(self, start: int, end: int) -> list[Token]:
        """Comments that begin in a span of the source, found by bisection."""
        lo, hi = (bisect.bisect_left(self.comments, at, key=lambda c: c.start) for at in (start, end))
        return self.comments[lo:hi]

    def docs_left(self, k: int) -> list[str]:
        """Comments that stand right above token k: nothing but blank lines, fewer than two, between them and it."""
        before = self.t[k - 1].end if k else 0
        at = self.t[k].start if k < self.n else len(self.src)
        out = []
        for c in reversed(self.between(before, at)):
            gap = self.src[c.end : at]
            if gap.count("\n") > 2 or (k and "\n" not in self.src[before : c.start]):
                break
            out.append(c.text)
            at = c.start
        return out[::-1]

    def docs_right(self, k: int) -> list[str]:
        stop = self.t[k + 1].start if k + 1 < self.n else len(self.src)
        return [c.text for c in self.between(self.t[k].end, stop)] if k < self.n else []

    # --- script
    def parse(self) -> dict[str, list[dict[str, Any]]]:
        while self.i < self.n:
            begin = self.i
            try:
                self.script_unit()
            except (Bad, RecursionError) as e:
                self.error(str(e) or "nested too deeply")
                self.skip_unit(begin)
            if self.i == begin:
                self.i += 1
        self.rows["count"] = [{"unit": u, "routine": r, "statements": n} for (u, r), n in sorted(self.stated.items())]
        self.claim()
        return {k: v for k, v in self.rows.items() if v}

    def claim(self) -> None:
        """Each statement and call to the step whose span holds it: the narrowest, and of these the first linked."""
        spans: dict[tuple[int, int], list[dict[str, Any]]] = defaultdict(list)
        for s in self.rows["step"]:
            if s["from_off"] is not None:
                spans[s["unit"], s["routine"]].append(s)
        for many in spans.values():
            many.sort(key=lambda s: s["from_off"], reverse=True)
        now: tuple[int, int] | None = None
        live: list[tuple] = []
        for row in sorted([*self.rows["sql"], *self.rows["call"]], key=lambda r: (r["unit"], r["routine"], r["offset"])):
            key = row["unit"], row["routine"]
            if key != now:
                now, live = key, []
            waiting = spans[key]
            while waiting and waiting[-1]["from_off"] <= row["offset"]:
                s = waiting.pop()
                heapq.heappush(live, (s["to_off"] - s["from_off"], s["link_seq"], s["to_off"], s["path"]))
            while live and live[0][2] <= row["offset"]:
                heapq.heappop(live)
            row["step"] = live[0][3] if live else None

    def alone(self, k: int) -> bool:
        t = self.t[k]
        a = self.src.rfind("\n", 0, t.start) + 1
        b = self.src.find("\n", t.end)
        return self.src[a : len(self.src) if b < 0 else b].strip() == "/"

    def skip_unit(self, begin: int) -> None:
        self.i = max(self.i, begin + 1)
        while self.i < self.n:
            t = self.t[self.i]
            if t.up == "/" and self.alone(self.i):
                self.i += 1
                return
            if t.up == "CREATE" and not self.src[self.src.rfind("\n", 0, t.start) + 1 : t.start].strip():
                return
            self.i += 1

    def script_unit(self) -> None:
        if self.take("/", ";"):
            return
        begin, u = self.i, self.up()
        if u == "CREATE":
            self.i += 1
            if self.take("OR"):
                self.need("REPLACE")
            self.take("EDITIONABLE", "NONEDITIONABLE")
            while self.up() in ("GLOBAL", "TEMPORARY", "PRIVATE", "FORCE", "SHARDED", "BLOCKCHAIN", "NO"):
                self.i += 1
            kind = self.up()
            if kind in ("PROCEDURE", "FUNCTION"):
                return self.standalone(begin)
            if kind == "PACKAGE":
                return self.package(begin)
            if kind == "TRIGGER":
                return self.trigger(begin)
            if kind == "TABLE":
                self.i += 1
                return self.create_table(begin)
            name = ""
            if kind in ("VIEW", "MATERIALIZED", "TYPE", "SEQUENCE", "INDEX", "SYNONYM"):
                self.i += 1
                self.take("VIEW", "BODY")
                if self.tok().kind in ("id", "quoted"):
                    name = ".".join(self.dotted()).upper()
            self.i = begin
            return self.skipped(begin, f"create_{kind.lower() or 'other'}", name, plsql=kind == "TYPE")
        if u == "ALTER" and self.up(1) == "TABLE":
            self.i += 2
            return self.alter_table(begin)
        if u in ("DECLARE", "BEGIN") or u == "<<":
            return self.anonymous(begin)
        if u in ("PROCEDURE", "FUNCTION"):
            return self.standalone(begin)
        if u == "PACKAGE":
            return self.package(begin)
        first = not self.src[self.src.rfind("\n", 0, self.tok().start) + 1 : self.tok().start].strip()
        if first and (u in ("@",) or (u in SQLPLUS and u not in ("SET", "CONNECT", "START"))) or (u in ("SET", "START", "CONNECT") and first):
            end = self.src.find("\n", self.tok().start)
            end = len(self.src) if end < 0 else end
            line = self.tok().line
            while self.i < self.n and self.t[self.i].start < end:
                self.i += 1
            self.rows["skipped"].append({"kind": "sqlplus", "name": self.src[self.t[begin].start : end].strip()[:80], "object": "", "line": line, "end_line": line, "reason": "a command of the client"})
            return None
        return self.skipped(begin, u.lower() or self.tok().kind, "", plsql=False)

    def skipped(self, begin: int, kind: str, name: str, plsql: bool) -> None:
        """Everything that is not decomposed, up to its end: a lone slash, or a semicolon for SQL."""
        while self.i < self.n:
            t = self.t[self.i]
            if t.up == "/" and self.alone(self.i) or (t.up == ";" and not plsql):
                break
            self.i += 1
        said = norm(self.src[self.t[begin].start : self.t[max(begin, self.i - 1)].end])[:80]
        self.rows["skipped"].append({"kind": kind, "name": said, "object": name, "line": self.line(begin), "end_line": self.end_line(self.i), "reason": "listed, not decomposed"})
        if self.i < self.n:
            self.i += 1

    # --- units
    def open_unit(self, kind: str, begin: int, name: list[str]) -> dict[str, Any]:
        self.unit = len(self.rows["unit"])
        self.routine = -1
        row = {"unit": self.unit, "kind": kind, "schema": name[-2] if len(name) > 1 else None, "name": name[-1], "line": self.line(begin), "end_line": None, "authid": None, "trigger_header": None, "docs": self.docs_left(begin), "has_init": False, "init_line": None}
        self.rows["unit"].append(row)
        return row

    def close_unit(self, row: dict[str, Any]) -> None:
        self.take(";")
        row["end_line"] = self.end_line(self.i)
        self.unit = self.routine = -1

    def authid(self) -> str | None:
        said = None
        while self.up() not in ("IS", "AS", "") and self.up() != ";":
            if self.take("AUTHID"):
                said = self.name().upper()
            elif self.up() == "(":
                self.i += 1
                self.until(")")
                self.take(")")
            else:
                self.i += 1
        return said

    def package(self, begin: int) -> None:
        self.need("PACKAGE")
        body = self.take("BODY")
        unit = self.open_unit("PACKAGE_BODY" if body else "PACKAGE_SPEC", begin, self.dotted())
        unit["authid"] = self.authid()
        self.need("IS", "AS")
        self.declarations()
        if body and self.up() == "BEGIN":
            unit["has_init"], unit["init_line"] = True, self.line(self.i)
            self.block_body([])
        else:
            self.need("END")
            if self.tok().kind in ("id", "quoted"):
                self.i += 1
        self.close_unit(unit)

    def standalone(self, begin: int) -> None:
        kind = self.up()
        mark = self.i
        self.i += 1
        unit = self.open_unit(kind, begin, self.dotted())
        self.i = mark
        row = self.routine_decl(docs=unit["docs"], begin=begin)
        unit["authid"] = "CURRENT_USER" if "INVOKER_RIGHTS" in row["attributes"] else "DEFINER" if "DEFINER_RIGHTS" in row["attributes"] else None
        self.close_unit(unit)

    def trigger(self, begin: int) -> None:
        self.i += 1
        unit = self.open_unit("TRIGGER", begin, self.dotted())
        head = self.i
        while self.i < self.n and self.up() not in ("DECLARE", "BEGIN", "<<", "COMPOUND", "CALL"):
            self.i += 1
        unit["trigger_header"] = self.text(head, self.i)
        if self.up() == "COMPOUND":
            while self.i < self.n and not (self.up() == "/" and self.alone(self.i)):
                self.i += 1
        elif self.up() == "CALL":
            self.until(";")
        else:
            while self.take("<<"):
                self.name()
                self.need(">>")
            if self.take("DECLARE"):
                self.declarations()
            unit["init_line"] = self.line(self.i)
            self.block_body([])
        self.close_unit(unit)

    def anonymous(self, begin: int) -> None:
        unit = self.open_unit("ANONYMOUS_BLOCK", begin, [f"<anonymous@{self.line(begin)}>"])
        while self.take("<<"):
            self.name()
            self.need(">>")
        if self.take("DECLARE"):
            self.declarations()
        unit["init_line"] = self.line(self.i)
        self.block_body([])
        self.close_unit(unit)

    # --- declarations
    def params(self) -> list[dict[str, Any]]:
        out: list[dict[str, Any]] = []
        if not self.take("("):
            return out
        while self.up() not in (")", ""):
            line, name, mode = self.tok().line, self.name(), "IN"
            if self.take("IN"):
                mode = "IN OUT" if self.take("OUT") else "IN"
            elif self.take("OUT"):
                mode = "OUT"
            if self.take("NOCOPY"):
                mode += " NOCOPY"
            a = self.until(",", ":=", "DEFAULT")
            kind, default = self.text(a, self.i), None
            if self.take(":=", "DEFAULT"):
                a = self.until(",")
                default = self.text(a, self.i)
            out.append({"name": name, "mode": mode, "type": kind, "default_text": default, "line": line})
            if not self.take(","):
                break
        self.need(")")
        return out

    def routine_decl(self, docs: list[str] | None = None, begin: int | None = None) -> dict[str, Any]:
        start = self.i if begin is None else begin
        docs = self.docs_left(self.i) if docs is None else docs
        kind = self.t[self.i].up
        self.i += 1
        name = self.dotted()[-1]
        params = self.params()
        returns = None
        if self.take("RETURN"):
            a = self.i
            while self.up() not in ("IS", "AS", ";", "", "DETERMINISTIC", "PIPELINED", "RESULT_CACHE", "PARALLEL_ENABLE", "AGGREGATE", "AUTHID", "ACCESSIBLE"):
                self.i += 1
            returns = self.text(a, self.i)
        attributes = []
        while self.up() not in ("IS", "AS", ";", ""):
            u = self.up()
            if u in ("DETERMINISTIC", "PIPELINED", "RESULT_CACHE", "PARALLEL_ENABLE", "AGGREGATE", "STREAMING"):
                attributes.append(u)
            elif u == "AUTHID":
                attributes.append("INVOKER_RIGHTS" if self.up(1) == "CURRENT_USER" else "DEFINER_RIGHTS")
            elif u == "ACCESSIBLE":
                attributes.append("ACCESSIBLE_BY")
            if u == "(":
                self.i += 1
                self.until(")")
            self.i += 1
        head = norm(f"{kind} {name}" + (f" ({', '.join(p['name'] + ' ' + p['mode'] + ' ' + p['type'] + (' DEFAULT ' + p['default_text'] if p['default_text'] else '') for p in params)})" if params else "") + (f" RETURN {returns}" if returns else ""))
        outer, self.routine = self.routine, self.routines
        self.routines += 1
        row = {"unit": self.unit, "rid": self.routine, "parent": outer, "depth": self.depth, "kind": kind, "name": name, "forward": False, "has_body": False, "call_spec": False, "params": params, "return_type": returns, "attributes": attributes, "line": self.line(start), "end_line": None, "body_line": None, "signature": head, "docs": docs, "header_docs": []}
        self.rows["routine"].append(row)
        try:
            if self.up() == ";":
                row["forward"] = True
            else:
                self.need("IS", "AS")
                if self.up() in ("LANGUAGE", "EXTERNAL", "MLE"):
                    row["call_spec"] = True
                    self.until(";")
                else:
                    self.depth += 1
                    row["has_body"] = True
                    saved, self.loops = self.loops, 0
                    self.declarations(row)
                    row["body_line"] = self.line(self.i)
                    row["header_docs"] = self.docs_right(self.i)
                    self.block_body([])
                    self.loops = saved
                    self.depth -= 1
            row["end_line"] = self.end_line(self.i + (self.up() == ";"))
        finally:
            self.routine = outer
        return row

    def declare(self, kind: str, name: str, begin: int, **more: Any) -> None:
        base = {"type": None, "is_const": False, "not_null": False, "default_text": None, "type_kind": None, "definition": None, "fields": [], "params": [], "query": None, "error_code": None}
        self.add("decl", kind=kind, name=name, line=self.line(begin), end_line=self.end_line(self.i), **(base | more))

    def declarations(self, routine: dict[str, Any] | None = None) -> None:
        while self.i < self.n and self.up() not in ("BEGIN", "END"):
            begin, u = self.i, self.up()
            try:
                if u in ("PROCEDURE", "FUNCTION"):
                    self.routine_decl()
                    self.need(";")
                elif u == "PRAGMA":
                    self.i += 1
                    name = self.name().upper()
                    a = self.until(";")
                    said = self.text(a, self.i)
                    self.declare("PRAGMA", name, begin, definition=said)
                    if name == "AUTONOMOUS_TRANSACTION" and routine is not None:
                        routine["attributes"].append(name)
                    if name == "AUTONOMOUS_TRANSACTION" and routine is None:
                        self.add("effect", kind="AUTONOMOUS", detail="", line=self.line(begin))
                    if name == "EXCEPTION_INIT" and (m := re.match(r"\(\s*\"?([\w$#]+)\"?\s*,\s*'?(-?\s*\d+)'?\s*\)", said)):
                        self.add("exception_init", name=m[1].lower(), code=int(m[2].replace(" ", "")))
                    self.need(";")
                elif u == "TYPE":
                    self.type_decl(begin)
                elif u == "SUBTYPE":
                    self.i += 1
                    name = self.name()
                    self.need("IS")
                    a = self.until(";")
                    self.declare("TYPE", name, begin, type_kind="SUBTYPE", definition=self.text(a, self.i))
                    self.need(";")
                elif u == "CURSOR":
                    self.i += 1
                    name, params = self.name(), self.params()
                    if self.take("RETURN"):
                        self.until("IS", ";")
                    query = None
                    if self.take("IS"):
                        a = self.until(";")
                        query = self.text(a, self.i)
                        self.sql(a, self.i, "CURSOR_DECL", own=frozenset(x["name"].lower() for x in params))
                    self.declare("CURSOR", name, begin, params=params, query=query)
                    self.need(";")
                elif self.tok().kind == "directive":
                    self.declare("CONDITIONAL_COMPILATION", self.tok().text, begin)
                    self.i += 1
                else:
                    name = self.name()
                    const = self.take("CONSTANT")
                    if self.take("EXCEPTION"):
                        self.declare("EXCEPTION", name, begin)
                    else:
                        a = self.until(":=", "DEFAULT", "NOT")
                        kind, default, not_null = self.text(a, self.i), None, False
                        if self.up() == "NOT" and self.up(1) == "NULL":
                            self.i += 2
                            not_null = True
                        if self.take(":=", "DEFAULT"):
                            a = self.until(";")
                            default = self.text(a, self.i)
                            self.expression(a, self.i)
                        self.declare("VARIABLE", name, begin, type=kind, is_const=const, not_null=not_null, default_text=default)
                    self.need(";")
            except Bad as e:
                self.error(str(e))
                self.resync(begin)

    def resync(self, begin: int) -> None:
        self.i = max(self.i, begin)
        while self.i < self.n and self.up() not in (";", "BEGIN", "END", "CREATE") and not (self.up() == "/" and self.alone(self.i)):
            self.i += 1
        if self.up() == ";":
            self.i += 1
        elif self.i == begin:
            self.i += 1

    def type_decl(self, begin: int) -> None:
        self.i += 1
        name = self.name()
        self.need("IS")
        a = self.i
        fields, kind = [], "OTHER"
        if self.take("RECORD"):
            kind = "RECORD"
            self.need("(")
            while self.up() not in (")", ""):
                field = self.name()
                b = self.until(",", ":=", "DEFAULT", "NOT")
                fields.append({"name": field, "type": self.text(b, self.i)})
                self.until(",")
                if not self.take(","):
                    break
            self.need(")")
        elif self.up() == "TABLE":
            kind = "TABLE"
        elif self.up() in ("VARRAY", "VARYING"):
            kind = "VARRAY"
        elif self.up() == "REF":
            kind = "REF_CURSOR"
        self.until(";")
        self.declare("TYPE", name, begin, type_kind=kind, fields=fields, definition=self.text(a, self.i))
        self.need(";")

    # --- statements
    def step(self, path: list[int], kind: str, begin: int, text: str = "", label: str | None = None, span: tuple[int, int] | None = None, **more: Any) -> dict[str, Any]:
        """A step of the outline; ``span`` is the run of tokens whose SQL and calls belong to it."""
        a, b = span or (0, 0)
        self.link += 1
        row = {"exception": None, "code": None, "code_text": None, "exceptions": [], "counts": True, "bulk": False, "limit": False, "target": None} | more
        return self.add("step", path=list(path), kind=kind, text=text, label=label, line=self.line(begin), end_line=self.end_line(self.i), from_off=self.t[a].start if a < b else None, to_off=self.t[b - 1].end if a < b else None, link_seq=self.link, **row)

    def block_body(self, path: list[int]) -> None:
        """BEGIN … [EXCEPTION …] END [name]; the place is BEGIN."""
        self.need("BEGIN")
        k = self.statement_list(path, 0, ("END", "EXCEPTION"))
        if self.up() == "EXCEPTION":
            begin = self.i
            self.i += 1
            at = [*path, k + 1]
            row = self.step(at, "EXCEPTION_SECTION", begin, counts=False)
            n = 0
            while self.up() == "WHEN":
                n += 1
                self.handler([*at, n])
            row["end_line"] = self.end_line(self.i)
        self.need("END")
        if self.tok().kind in ("id", "quoted") and self.up() not in ("IF", "LOOP", "CASE"):
            self.i += 1

    def handler(self, path: list[int]) -> None:
        begin = self.i
        self.need("WHEN")
        names = []
        while self.up() not in ("THEN", ""):
            if self.tok().kind in ("id", "quoted") and self.up() != "OR":
                names.append(".".join(self.dotted()).upper())
            else:
                self.i += 1
        self.need("THEN")
        row = self.step(path, "HANDLER", begin, " or ".join(names), exceptions=names, counts=False)
        self.statement_list(path, 0, ("WHEN", "END"))
        row["end_line"] = self.end_line(self.i)

    def statement_list(self, path: list[int], k: int, stops: tuple[str, ...]) -> int:
        label = None
        while self.i < self.n:
            u = self.up()
            if u in stops:
                break
            if u == "/" and self.alone(self.i):
                raise Bad("END expected")
            begin = self.i
            try:
                if self.take("<<"):
                    label = self.name()
                    self.need(">>")
                    k += 1
                    self.step([*path, k], "LABEL", begin, label, label=label, counts=False)
                    continue
                k += 1
                self.stated[self.unit, self.routine] += self.tok().kind != "directive" and self.up() != "PRAGMA"
                self.statement([*path, k], label)
                label = None
            except Bad as e:
                self.error(str(e))
                self.resync(begin)
                if self.i >= self.n or self.up() in ("CREATE",):
                    raise Bad("END expected") from None
        return k

    def semicolon(self) -> None:
        self.need(";")

    def nested(self, path: list[int], begin: int, kind: str, text: str, span: tuple[int, int] | None, stops: tuple[str, ...]) -> None:
        row = self.step(path, kind, begin, text, span=span, counts=False)
        self.statement_list(path, 0, stops)
        row["end_line"] = self.end_line(self.i)

    def statement(self, path: list[int], label: str | None) -> None:
        begin, u = self.i, self.up()
        t = self.tok()
        if t.kind == "directive":
            self.i += 1
            self.step(path, "CONDITIONAL_COMPILATION", begin, t.text, counts=False)
            return
        if t.kind == "bind":
            return self.assignment(path, begin)
        if u == "IF":
            return self.if_(path, begin)
        if u == "CASE":
            return self.case(path, begin)
        if u in ("LOOP", "WHILE", "FOR"):
            return self.loop(path, begin, label)
        if u == "FORALL":
            return self.forall(path, begin)
        if u in ("BEGIN", "DECLARE"):
            row = self.step(path, "BLOCK", begin, label or "", label=label)
            if self.take("DECLARE"):
                self.declarations()
            self.block_body(path)
            self.semicolon()
            row["end_line"] = self.end_line(self.i)
            return None
        if u == "NULL" and self.up(1) == ";":
            self.i += 1
            self.step(path, "NULL", begin)
        elif u in ("EXIT", "CONTINUE"):
            self.i += 1
            target = self.name() if self.tok().kind in ("id", "quoted") and self.up() != "WHEN" else None
            span = None
            if self.take("WHEN"):
                a = self.until(";")
                span = (a, self.i)
                self.expression(a, self.i)
            self.step(path, u, begin, self.text(begin, self.i), label=target, span=span)
        elif u == "GOTO":
            self.i += 1
            self.step(path, "GOTO", begin, self.name())
        elif u == "RAISE":
            self.i += 1
            name = ".".join(self.dotted()).upper() if self.tok().kind in ("id", "quoted") else None
            self.step(path, "RAISE", begin, name or "", exception=name)
        elif u == "RETURN":
            self.i += 1
            a = self.until(";")
            self.expression(a, self.i)
            self.step(path, "RETURN", begin, self.text(a, self.i), span=(a, self.i), target="value" if a < self.i else None)
        elif u == "PIPE" and self.up(1) == "ROW":
            a = self.until(";")
            self.expression(a + 2, self.i)
            self.step(path, "PIPE_ROW", begin, self.text(a + 2, self.i), span=(a + 2, self.i))
        elif u in ("COMMIT", "ROLLBACK", "SAVEPOINT") and self.up(1) not in (":=", "(", "."):
            a = self.until(";")
            said = self.text(a + 1, self.i)
            self.step(path, u, begin, said)
            self.add("effect", kind=u, detail=said, line=t.line)
        elif u == "SET" and self.up(1) == "TRANSACTION":
            a = self.until(";")
            self.step(path, "SET_TRANSACTION", begin, self.text(a + 2, self.i))
            self.add("effect", kind="SET_TRANSACTION", detail=self.text(a + 2, self.i), line=t.line)
        elif u in ("GRANT", "REVOKE") and self.tok(1).kind == "id":
            a = self.until(";")
            self.step(path, "GRANT", begin, self.text(a, self.i))
            self.add("effect", kind="DDL", detail=u, line=t.line)
        elif u == "OPEN":
            return self.open(path, begin)
        elif u == "FETCH":
            self.i += 1
            a = self.until(";")
            words = [x.up for x in self.t[a : self.i]]
            cursor = self.text(a, next((k for k in range(a, self.i) if self.t[k].up in ("INTO", "BULK")), self.i))
            self.targets(a, self.i)
            self.step(path, "FETCH", begin, self.text(a, self.i), span=(a, self.i), bulk="BULK" in words, limit="LIMIT" in words, target=cursor)
        elif u == "CLOSE":
            a = self.until(";")
            self.step(path, "CLOSE_CURSOR", begin, self.text(a + 1, self.i))
        elif u == "EXECUTE" and self.up(1) == "IMMEDIATE":
            self.i += 2
            a = self.until(";")
            self.dynamic(a, self.i, "EXECUTE_IMMEDIATE", begin)
            self.step(path, "DYNAMIC_SQL", begin, self.text(a, self.i), span=(begin, self.i))
        elif u == "PRAGMA":
            a = self.until(";")
            self.step(path, "PRAGMA", begin, self.text(a + 1, self.i), counts=False)
        elif u in SQL_HEADS and not (self.up(1) in (".", ":=", "(") and u in ("DELETE", "LOCK")):
            a = self.until(";")
            kind = "SELECT" if u == "WITH" else u
            self.sql(a, self.i, kind)
            self.step(path, "SQL", begin, self.text(a, self.i), span=(a, self.i), target=kind)
        elif t.kind in ("id", "quoted"):
            return self.call_or_assignment(path, begin)
        else:
            a = self.until(";")
            self.step(path, "UNKNOWN", begin, self.text(a, self.i), span=(a, self.i))
        self.semicolon()
        return None

    def call_or_assignment(self, path: list[int], begin: int) -> None:
        j, level = self.i, 0
        while j < self.n:
            x = self.t[j].up
            level += (x == "(") - (x == ")")
            if level == 0 and x == ":=":
                return self.assignment(path, begin)
            if level == 0 and x == ";":
                break
            j += 1
        a = self.until(";")
        parts = [x for x in self.t[a : self.i]]
        self.expression(a, self.i, statement=True)
        text = self.text(a, self.i)
        up = [x.up for x in parts]
        method = next((up[k + 1] for k in range(len(up) - 1) if up[k] == "." and (k + 2 == len(up) or up[k + 2] == "(")), "")
        first = up[0]
        if method in ("EXTEND", "DELETE", "TRIM") and first != "SYS":
            self.step(path, "COLLECTION_OP", begin, text, span=(a, self.i), target=method)
        elif first == "RAISE_APPLICATION_ERROR" or up[:3] == ["DBMS_STANDARD", ".", "RAISE_APPLICATION_ERROR"]:
            k = up.index("(") + 1 if "(" in up else len(up)
            e = next((m for m in range(k, len(up)) if up[m] == ","), len(up))
            said = self.text(a + k, a + e)
            code = int(said.replace(" ", "")) if re.fullmatch(r"-\s*\d+", said) else None
            self.step(path, "RAISE", begin, text, span=(a, self.i), exception="RAISE_APPLICATION_ERROR", code=code, code_text=said)
        else:
            self.step(path, "CALL", begin, text, span=(a, self.i))
        self.semicolon()
        return None

    def assignment(self, path: list[int], begin: int) -> None:
        level = 0
        a = self.i
        while self.i < self.n and not (level == 0 and self.up() in (":=", ";")):
            level += (self.up() == "(") - (self.up() == ")")
            self.i += 1
        eq = self.i
        self.need(":=")
        self.until(";")
        target = self.t[a]
        if target.kind != "bind":
            self.add("target", name=".".join(x.text for x in self.t[a:eq] if x.kind in ("id", "quoted")).lower().replace('"', ""), first=target.text.lower().replace('"', ""), second=self.t[a + 2].text.lower() if a + 2 < eq and self.t[a + 1].up == "." else None, how="ASSIGN", line=target.line)
        p = next((k for k in range(a, eq) if self.t[k].up == "("), eq)
        self.expression(p, eq)
        self.expression(eq + 1, self.i)
        self.step(path, "ASSIGN", begin, self.text(a, self.i), span=(a, self.i), target=self.text(a, eq))
        self.semicolon()

    def if_(self, path: list[int], begin: int) -> None:
        self.need("IF")
        a = self.until("THEN")
        self.expression(a, self.i)
        row = self.step(path, "IF", begin, self.text(a, self.i), span=(a, self.i))
        at = self.i
        self.need("THEN")
        k = 1
        self.nested([*path, k], at, "THEN", "", None, ("ELSIF", "ELSE", "END"))
        while self.up() == "ELSIF":
            at = self.i
            self.i += 1
            a = self.until("THEN")
            self.expression(a, self.i)
            span = (a, self.i)
            self.need("THEN")
            k += 1
            self.nested([*path, k], at, "ELSIF", self.text(*span), span, ("ELSIF", "ELSE", "END"))
        if self.up() == "ELSE":
            at = self.i
            self.i += 1
            k += 1
            self.nested([*path, k], at, "ELSE", "", None, ("END",))
        self.need("END")
        self.need("IF")
        self.semicolon()
        row["end_line"] = self.end_line(self.i)

    def case(self, path: list[int], begin: int) -> None:
        self.need("CASE")
        a = self.until("WHEN")
        self.expression(a, self.i)
        row = self.step(path, "CASE", begin, self.text(a, self.i), span=(a, self.i))
        k = 0
        while self.up() == "WHEN":
            at = self.i
            self.i += 1
            a = self.until("THEN")
            self.expression(a, self.i)
            span = (a, self.i)
            self.need("THEN")
            k += 1
            self.nested([*path, k], at, "WHEN", self.text(*span), span, ("WHEN", "ELSE", "END"))
        if self.up() == "ELSE":
            at = self.i
            self.i += 1
            self.nested([*path, k + 1], at, "ELSE", "", None, ("END",))
        self.need("END")
        self.need("CASE")
        if self.tok().kind in ("id", "quoted"):
            self.i += 1
        self.semicolon()
        row["end_line"] = self.end_line(self.i)

    def loop(self, path: list[int], begin: int, label: str | None) -> None:
        u, kind, text, span = self.up(), "LOOP", "", None
        self.i += 1
        if u == "WHILE":
            kind = "WHILE_LOOP"
            a = self.until("LOOP")
            self.expression(a, self.i)
            span, text = (a, self.i), self.text(a, self.i)
        elif u == "FOR":
            head = self.i
            variable = self.name()
            self.need("IN")
            a = self.i
            self.take("REVERSE")
            b = self.until("LOOP")
            words = {x.up for x in self.t[b : self.i]}
            query = self.up() and self.t[b].up == "(" and self.t[b + 1].up in ("SELECT", "WITH", "(") if b < self.i else False
            if query:
                kind = "CURSOR_FOR_LOOP"
                self.sql(b, self.i, "CURSOR_LOOP")
            elif ".." in words:
                kind = "FOR_LOOP"
                self.expression(b, self.i)
            else:
                kind = "CURSOR_FOR_LOOP"
                self.expression(b, self.i)
            self.declare("LOOP_VARIABLE", variable, head)
            span, text = (a, self.i), self.text(head, self.i)
        if u != "LOOP":
            self.need("LOOP")
        row = self.step(path, kind, begin, text, label=label, span=span)
        self.loops += 1
        try:
            self.statement_list(path, 0, ("END",))
        finally:
            self.loops -= 1
        self.need("END")
        self.need("LOOP")
        if self.tok().kind in ("id", "quoted"):
            self.i += 1
        self.semicolon()
        row["end_line"] = self.end_line(self.i)

    def forall(self, path: list[int], begin: int) -> None:
        self.i += 1
        head = self.i
        self.declare("LOOP_VARIABLE", self.name(), head)
        self.until("INSERT", "UPDATE", "DELETE", "MERGE", "EXECUTE")
        text = self.text(head, self.i)
        self.expression(head + 2, self.i)
        row = self.step(path, "FORALL", begin, text, span=(head, self.i))
        a, u = self.i, self.up()
        self.stated[self.unit, self.routine] += 1
        if u == "EXECUTE":
            self.i += 2
            b = self.until(";")
            self.dynamic(b, self.i, "EXECUTE_IMMEDIATE", a, bulk=True)
            self.step([*path, 1], "DYNAMIC_SQL", a, self.text(b, self.i), span=(a, self.i))
        else:
            self.until(";")
            self.sql(a, self.i, u, bulk=True)
            self.step([*path, 1], "SQL", a, self.text(a, self.i), span=(a, self.i), target=u)
        self.semicolon()
        row["end_line"] = self.end_line(self.i)

    def open(self, path: list[int], begin: int) -> None:
        self.i += 1
        a = self.i
        self.until("FOR")
        name = self.text(a, self.i)
        if self.take("FOR"):
            b = self.until(";")
            if self.t[b].up in ("SELECT", "WITH", "("):
                self.sql(b, self.i, "OPEN_FOR")
            else:
                self.dynamic(b, self.i, "OPEN_FOR", begin)
            self.step(path, "OPEN_FOR", begin, self.text(a, self.i), span=(begin, self.i), target=name)
        else:
            self.expression(a, self.i)
            self.step(path, "OPEN_CURSOR", begin, name, span=(a, self.i), target=name)
        self.semicolon()

    # --- expressions
    def expression(self, a: int, b: int, statement: bool = False, sql: bool = False, skip: set[int] | None = None) -> None:
        """Names and calls of the tokens a..b as candidates; embedded queries become statements. In SQL only what has
        arguments can be a call: other names are columns."""
        k = a
        while k < b:
            t = self.t[k]
            if not sql and t.up == "(" and k + 1 < b and self.t[k + 1].up in ("SELECT", "WITH"):
                e = self.close(k, b)
                self.sql(k + 1, e, "SELECT")
                k = e + 1
                continue
            if t.kind in ("id", "quoted") and not (k and self.t[k - 1].up in (".", "%")) and not (skip and k in skip):
                k = self.chain(k, b, statement and k == a, sql)
                continue
            k += 1

    def close(self, k: int, b: int) -> int:
        level = 0
        while k < b:
            level += (self.t[k].up == "(") - (self.t[k].up == ")")
            if level == 0:
                return k
            k += 1
        return b

    def chain(self, k: int, b: int, statement: bool, sql: bool) -> int:
        begin = k
        parts, kinds = [self.t[k].text.replace('"', "")], [self.t[k].kind]
        k += 1
        while k + 1 < b and self.t[k].up == "." and self.t[k + 1].kind in ("id", "quoted"):
            parts.append(self.t[k + 1].text.replace('"', ""))
            kinds.append(self.t[k + 1].kind)
            k += 2
        first = self.t[begin]
        link = None
        if k + 1 < b and self.t[k].up == "@" and self.t[k + 1].kind in ("id", "quoted"):
            link = self.t[k + 1].text
            k += 2
            while k + 1 < b and self.t[k].up == "." and self.t[k + 1].kind == "id":
                link += "." + self.t[k + 1].text
                k += 2
        if k < b and self.t[k].up == "%" and k + 1 < b:
            return k + 2  # an attribute
        if k < b and self.t[k].up == "=>":
            return k + 1  # the name of an argument
        paren = k < b and self.t[k].up == "("
        if k < b and self.t[k].up == "(+)":
            paren = False
        if len(parts) == 1 and kinds[0] == "id" and first.up in WORDS and not (paren and first.up in ("COUNT", "FIRST", "LAST", "CAST", "EXISTS", "ROW", "DATE", "TIMESTAMP")):
            if not (statement and (paren or k >= b)):
                return k
        if sql and len(parts) == 1 and kinds[0] == "id" and first.up in FORMS:
            return k
        argc, named, end = 0, [], k - 1
        if sql and not paren:
            if len(parts) > 1 and parts[-1].upper() in ("NEXTVAL", "CURRVAL"):
                self.add("effect", kind="SEQUENCE", detail=".".join(parts[:-1]).upper(), line=first.line)
            return k
        if paren:
            end = self.close(k, b)
            argc, named = self.arguments(k, end)
        last = parts[-1].upper()
        if len(parts) > 1 and last in ("NEXTVAL", "CURRVAL"):
            self.add("effect", kind="SEQUENCE", detail=".".join(parts[:-1]).upper(), line=first.line)
        self.add("call", seq=self.seq("call"), parts=parts, link=link, line=first.line, offset=first.start, argc=argc, named=named, statement=statement, parens=paren, in_loop=self.loops > 0, in_sql=sql, text=norm(self.src[first.start : self.t[min(end, b - 1)].end]))
        return k

    def arguments(self, k: int, e: int) -> tuple[int, list[str]]:
        level, count, named, some = 0, 1, [], False
        for j in range(k + 1, e):
            x = self.t[j]
            some = True
            if x.up == "(":
                level += 1
            elif x.up == ")":
                level -= 1
            elif x.up == "," and level == 0:
                count += 1
            elif x.up == "=>" and level == 0 and j > k + 1:
                named.append(self.t[j - 1].text.lower().replace('"', ""))
        return (count if some else 0), named

    def targets(self, a: int, b: int) -> list[str]:
        """Names after INTO, each an assignment."""
        out, k = [], a
        while k < b and self.t[k].up != "INTO":
            k += 1
        k += 1
        while k < b and self.t[k].kind in ("id", "quoted", "bind") and self.t[k].up not in ("FROM", "USING", "LIMIT"):
            s, first = k, self.t[k]
            while k + 1 < b and self.t[k + 1].up == "." and k + 2 < b:
                k += 2
            if k + 1 < b and self.t[k + 1].up == "(":
                k = self.close(k + 1, b)
            said = self.text(s, k + 1).lower().replace('"', "")
            out.append(said)
            if first.kind != "bind":
                self.add("target", name=said, first=first.text.lower().replace('"', ""), second=self.t[s + 2].text.lower() if s + 2 <= k and self.t[s + 1].up == "." else None, how="INTO", line=first.line)
            k += 1
            if k < b and self.t[k].up == ",":
                k += 1
            else:
                break
        return out

    # --- SQL
    def comments_in(self, a: int, b: int) -> list[Token]:
        """Comments among the tokens a..b."""
        return self.between(self.t[a].start, self.t[b - 1].end) if a < b <= self.n else []

    def statement_row(self, a: int, b: int, kind: str, **more: Any) -> dict[str, Any]:
        base = {"binds": [], "into": [], "for_update": False, "bulk": False, "bulk_into": False, "dynamic": False, "dynamic_confidence": None, "dynamic_expression": None, "dynamic_kind": None, "concatenated": False, "asserted": False, "ctes": [], "aliases": [], "context": None}
        hint = any(self.src.startswith("/*+", c.start) for c in self.comments_in(a, b))
        return self.add("sql", seq=self.seq("sql"), kind=kind, line=self.line(a), end_line=self.end_line(b), offset=self.t[a].start if a < self.n else 0, text=self.text(a, b), hint=hint, in_loop=self.loops > 0, **(base | more))

    def sql(self, a: int, b: int, kind: str, bulk: bool = False, own: frozenset[str] = frozenset()) -> None:
        """A statement; ``own`` are names that only it sees, such as a cursor's parameters."""
        row = self.statement_row(a, b, kind, bulk=bulk)
        if bulk:
            row["in_loop"] = False
        Sql(self, a, b, row, own).run()

    def dynamic(self, a: int, b: int, kind: str, begin: int, bulk: bool = False) -> None:
        """EXECUTE IMMEDIATE or OPEN FOR with text: LITERAL if it is all literals and parses, PARTIAL if some, else UNKNOWN."""
        e, level = a, 0
        while e < b and not (level == 0 and self.t[e].up in ("INTO", "BULK", "USING", "RETURNING", "RETURN")):
            level += (self.t[e].up == "(") - (self.t[e].up == ")")
            e += 1
        pieces, only = [], True
        for k in range(a, e):
            x = self.t[k]
            if x.kind == "string":
                # literals next to each other are one text; others leave a gap
                near = k >= 2 and self.t[k - 1].up == "||" and self.t[k - 2].kind == "string"
                pieces.append(("" if near or not pieces else " ") + literal(x.text))
            elif x.up not in ("||", "(", ")"):
                only = False
        text = "".join(pieces)
        binds = []
        u = next((k for k in range(e, b) if self.t[k].up == "USING"), None)
        if u is not None:
            binds = [s.strip() for s in self.src[self.t[u].end : self.t[b - 1].end].split(",")]
            self.expression(u + 1, b)
        self.expression(a, e)
        row = self.statement_row(begin, b, kind, bulk=bulk, dynamic=True, dynamic_expression=self.text(a, e), concatenated=any(x.up == "||" for x in self.t[a:e]), asserted=any(x.up == "DBMS_ASSERT" for x in self.t[a:e]), binds=binds, bulk_into=any(self.t[k].up == "BULK" for k in range(e, b)))
        row["into"] = self.targets(e, b)
        verb = re.match(r"\s*([A-Za-z]+)", text)
        row["dynamic_kind"] = verb[1].upper() if verb else None
        confidence = "UNKNOWN" if not text.strip() else "PARTIAL"
        if only and text.strip():
            inner = self.nested_sql(text)
            if inner is not None:
                confidence = "LITERAL"
                for ref in inner.get("ref", []):
                    self.add("ref", **{k: v for k, v in ref.items() if k not in ("unit", "routine")} | {"stmt": row["seq"], "confidence": "EXACT"})
                for use in inner.get("join", []):
                    self.add("join", **{k: v for k, v in use.items() if k not in ("unit", "routine")} | {"stmt": row["seq"], "dynamic": True})
                row["binds"] = sorted({*row["binds"], *(x for s in inner.get("sql", []) for x in s["binds"])})
                if inner.get("sql"):
                    row["dynamic_kind"] = inner["sql"][0]["kind"]
        row["dynamic_confidence"] = confidence
        if confidence == "PARTIAL" or (confidence == "LITERAL" and row["dynamic_kind"] in DDL_VERBS):
            access = row["dynamic_kind"] if row["dynamic_kind"] in ("INSERT", "UPDATE", "DELETE", "MERGE") else "DDL" if row["dynamic_kind"] in DDL_VERBS else "READ"
            seen = set()
            for m in _DYNAMIC.finditer(text):
                name = m[2].upper()
                if name in DYNAMIC_STOP or name in seen or name.rsplit(".")[-1] in DYNAMIC_STOP:
                    continue
                seen.add(name)
                schema, _, table = name.rpartition(".")
                first = m[1].upper() in ("INTO", "UPDATE", "TABLE") or access == "DELETE"
                self.add("ref", stmt=row["seq"], ref=len(seen) - 1, schema=schema or None, table=table, link=None, alias=None, access=[access if first or access in ("READ", "DDL") else "READ"], writes=[], scope="0", confidence="INFERRED")

    def nested_sql(self, text: str) -> dict[str, list[dict[str, Any]]] | None:
        inner = Parser(text if text.rstrip().endswith(";") or text.rstrip().lower().endswith("end") else text + ";")
        inner.unit = 0
        u = inner.up()
        try:
            if u in ("BEGIN", "DECLARE"):
                inner.anonymous(0)
            elif u in SQL_HEADS:
                inner.until(";")
                inner.sql(0, inner.i, "SELECT" if u == "WITH" else u)
            elif u not in DDL_VERBS and u != "SET":
                return None
        except Bad:
            return None
        return None if inner.rows.get("error") else dict(inner.rows)


class Sql:
    """Tables, columns, binds and joins of one static statement, as candidates with the path of their query block."""

    def __init__(self, p: Parser, a: int, b: int, row: dict[str, Any], own: frozenset[str] = frozenset()):
        self.p, self.a, self.b, self.row, self.own = p, a, b, row, own
        self.t = p.t
        self.refs: list[dict[str, Any]] = []
        self.skip: set[int] = set()  # tokens that are no columns
        self.writes: dict[int, str] = {}
        self.scope_at: dict[int, str] = {}

    def run(self) -> None:
        p, row = self.p, self.row
        words = [x.up for x in self.t[self.a : self.b]]
        row["for_update"] = any(words[k] == "FOR" and words[k + 1 : k + 2] == ["UPDATE"] for k in range(len(words)))
        row["bulk_into"] = "BULK" in words
        row["binds"] = sorted({x.text.replace(" ", "").lower() for x in self.t[self.a : self.b] if x.kind == "bind"})
        self.blocks()
        self.columns()
        for n, ref in enumerate(self.refs):
            p.add("ref", stmt=row["seq"], ref=n, confidence="EXACT", **ref)
        self.joins()
        p.expression(self.a, self.b, sql=True, skip=self.skip)

    def table(self, k: int, access: str, scope: str, columns: list[str] | None = None) -> int:
        """A table name at token k with its alias; the place after it."""
        t = self.t
        parts = [t[k].text.replace('"', "") if t[k].kind == "quoted" else t[k].up]
        self.skip.add(k)
        k += 1
        while k + 1 < self.b and t[k].up == "." and t[k + 1].kind in ("id", "quoted"):
            parts.append(t[k + 1].text.replace('"', "").upper())
            self.skip |= {k, k + 1}
            k += 2
        link = None
        if k + 1 < self.b and t[k].up == "@":
            link = t[k + 1].text
            self.skip.add(k + 1)
            k += 2
        while k < self.b and t[k].up in ("PARTITION", "SUBPARTITION", "SAMPLE") and k + 1 < self.b and t[k + 1].up == "(":
            e = self.p.close(k + 1, self.b)
            self.skip |= set(range(k, e + 1))
            k = e + 1
        alias = None
        if k < self.b and t[k].up == "AS" and access == "READ":
            k += 1
        if k < self.b and t[k].kind in ("id", "quoted") and t[k].up not in NO_ALIAS:
            alias = t[k].text.replace('"', "")
            self.skip.add(k)
            k += 1
        name = parts[-1].upper()
        if len(parts) == 1 and (name == "DUAL" or (name in self.ctes and access == "READ")):
            self.ghosts.append((alias or name, scope))
            return k
        self.refs.append({"schema": parts[-2].upper() if len(parts) > 1 else None, "table": name, "link": link, "alias": alias, "access": [access], "writes": columns or [], "scope": scope})
        return k

    def blocks(self) -> None:
        t, k, b = self.t, self.a, self.b
        stack = ["0"]
        has_from, clause = [False], [""]
        made = 0
        self.ctes: set[str] = set()
        self.ghosts: list[tuple[str, str]] = []
        self.several = [x.up for x in t[k : k + 2]] in (["INSERT", "ALL"], ["INSERT", "FIRST"])
        # names of common table expressions first: they may be used before their text ends
        for j in range(self.a, b - 2):
            if t[j].kind in ("id", "quoted") and t[j + 1].up == "AS" and t[j + 2].up == "(" and j + 3 < b and t[j + 3].up in ("SELECT", "WITH", "("):
                self.ctes.add(t[j].text.replace('"', "").upper())
                self.skip.add(j)
            elif t[j].kind in ("id", "quoted") and t[j + 1].up == "(" and j > self.a and t[j - 1].up in ("WITH", ","):
                e = self.p.close(j + 1, b)
                if e + 2 < b and t[e + 1].up == "AS" and t[e + 2].up == "(":
                    self.ctes.add(t[j].text.replace('"', "").upper())
                    self.skip |= set(range(j, e + 1))
        self.row["ctes"] = sorted(self.ctes)
        while k < b:
            x = t[k]
            u = x.up
            self.scope_at[k] = stack[-1]
            c = clause[-1]
            if u == "(":
                made += 1
                inner = t[k + 1].up in ("SELECT", "WITH") if k + 1 < b else False
                expect = c == "from" and not inner and k + 1 < b and t[k - 1].up in ("FROM", ",", "JOIN", "(")
                stack.append(f"{stack[-1]}.{made}" if inner else stack[-1])
                has_from.append(inner)
                clause.append("from" if expect else "")
                if expect and t[k + 1].kind in ("id", "quoted") and t[k + 1].up not in ("SELECT", "WITH"):
                    k = self.table(k + 1, "READ", stack[-1])
                    continue
            elif u == ")":
                if len(stack) > 1:
                    stack.pop()
                    has_from.pop()
                    clause.pop()
                if clause[-1] == "from" and k + 1 < b and t[k + 1].kind in ("id", "quoted") and t[k + 1].up not in NO_ALIAS and t[k + 1].up not in WORDS:
                    self.ghosts.append((t[k + 1].text.replace('"', ""), stack[-1]))
                    self.skip.add(k + 1)
                    k += 2
                    continue
            elif x.kind == "id" and (k == self.a or t[k - 1].up != "."):
                if u == "SELECT":
                    has_from[-1], clause[-1] = True, "select"
                elif u == "WITH":
                    has_from[-1] = True
                elif u == "INSERT":
                    clause[-1] = "insert"
                elif u == "INTO" and c == "insert":
                    k = self.insert(k + 1, stack[-1])
                    # INSERT ALL and INSERT FIRST go on with further targets
                    clause[-1] = "insert" if self.several else ""
                    continue
                elif u == "INTO" and c == "select":
                    self.row["into"] += self.p.targets(k, b)
                    j = k + 1
                    while j < b and t[j].up not in ("FROM", "VALUES"):
                        self.skip.add(j)
                        j += 1
                    k = j
                    continue
                elif u == "RETURNING" or (u == "RETURN" and self.row["kind"] != "SELECT"):
                    clause[-1] = "select"
                elif u == "UPDATE" and not (k and t[k - 1].up == "FOR") and clause[-1] != "merge":
                    j = k + 1
                    if j < b and t[j].kind in ("id", "quoted"):
                        k = self.table(j, "UPDATE", stack[-1])
                        clause[-1] = "update"
                        continue
                elif u == "UPDATE" and clause[-1] == "merge":
                    if self.refs:
                        self.refs[0]["access"] = sorted({*self.refs[0]["access"], "UPDATE"})
                elif u == "SET" and c in ("update", "merge"):
                    self.set_columns(k + 1)
                elif u == "DELETE" and clause[-1] != "merge":
                    j = k + 1 + (k + 1 < b and t[k + 1].up == "FROM")
                    if j < b and t[j].kind in ("id", "quoted") and t[j].up != "WHERE":
                        k = self.table(j, "DELETE", stack[-1])
                        clause[-1] = "delete"
                        continue
                elif u == "MERGE":
                    j = k + 1 + (k + 1 < b and t[k + 1].up == "INTO")
                    k = self.table(j, "MERGE", stack[-1])
                    clause[-1] = "merge"
                    continue
                elif u == "USING" and c == "merge" and k + 1 < b and t[k + 1].kind in ("id", "quoted"):
                    k = self.table(k + 1, "READ", stack[-1])
                    continue
                elif u == "USING" and c == "merge":
                    clause[-1] = "from"
                    self.scope_at[k] = stack[-1]
                    k += 1
                    made += 1
                    e = self.p.close(k, b)
                    # the source query, then merge goes on
                    self.merge_source(k, e, f"{stack[-1]}.{made}")
                    k = e + 1
                    if k < b and t[k].kind in ("id", "quoted") and t[k].up != "ON":
                        self.ghosts.append((t[k].text, stack[-1]))
                        self.skip.add(k)
                        k += 1
                    clause[-1] = "merge"
                    continue
                elif u == "INSERT" and c == "merge":
                    pass
                elif u == "LOCK":
                    j = k + 2
                    while j < b and t[j].kind in ("id", "quoted"):
                        j = self.table(j, "LOCK", stack[-1])
                        if j < b and t[j].up == ",":
                            j += 1
                        else:
                            break
                    k = b
                    continue
                elif u == "FROM" and has_from[-1]:
                    clause[-1] = "from"
                    if k + 1 < b and t[k + 1].kind in ("id", "quoted") and t[k + 1].up not in ("TABLE", "LATERAL", "ONLY", "THE"):
                        k = self.table(k + 1, "READ", stack[-1])
                        continue
                elif u == "JOIN" and k + 1 < b and t[k + 1].kind in ("id", "quoted") and t[k + 1].up not in ("TABLE", "LATERAL"):
                    clause[-1] = "from"
                    k = self.table(k + 1, "READ", stack[-1])
                    continue
                elif u in ("WHERE", "GROUP", "ORDER", "CONNECT", "START", "HAVING", "ON", "SET") and c == "from":
                    clause[-1] = "where" if u != "ON" else "from_on"
                elif u in ("UNION", "MINUS", "INTERSECT"):
                    clause[-1] = ""
            elif u == "," and c in ("from", "from_on"):
                clause[-1] = "from"
                if k + 1 < b and t[k + 1].kind in ("id", "quoted") and t[k + 1].up not in ("TABLE", "LATERAL", "XMLTABLE", "JSON_TABLE") and c == "from":
                    k = self.table(k + 1, "READ", stack[-1])
                    continue
            k += 1
        if self.row["kind"] == "MERGE" and self.refs:
            words = [x.up for x in t[self.a : b]]
            if any(words[j : j + 2] == ["THEN", "INSERT"] for j in range(len(words))):
                self.refs[0]["access"] = sorted({*self.refs[0]["access"], "INSERT"})
                self.merge_insert()
            if "MERGE" in self.refs[0]["access"] and len(self.refs[0]["access"]) > 1:
                self.refs[0]["access"] = [x for x in self.refs[0]["access"] if x != "MERGE"]

    def merge_source(self, k: int, e: int, scope: str) -> None:
        t = self.t
        j, inside = k, False
        while j < e:
            self.scope_at[j] = scope
            if t[j].up in ("FROM", "JOIN") or (t[j].up == "," and inside):
                inside = True
                if j + 1 < e and t[j + 1].kind in ("id", "quoted"):
                    j = self.table(j + 1, "READ", scope)
                    continue
            elif t[j].up in ("WHERE", "GROUP", "ORDER"):
                inside = False
            j += 1

    def merge_insert(self) -> None:
        t = self.t
        for k in range(self.a, self.b - 1):
            if t[k].up == "INSERT" and t[k + 1].up == "(":
                e = self.p.close(k + 1, self.b)
                names = [x.text.replace('"', "").upper() for x in t[k + 2 : e] if x.kind in ("id", "quoted")]
                self.refs[0]["writes"] = sorted({*self.refs[0]["writes"], *names})
                self.skip |= set(range(k + 2, e))

    def insert(self, k: int, scope: str) -> int:
        t = self.t
        if k >= self.b or t[k].kind not in ("id", "quoted"):
            return k
        k = self.table(k, "INSERT", scope)
        columns = ["*"]
        if k < self.b and t[k].up == "(" and t[k + 1].up not in ("SELECT", "WITH"):
            e = self.p.close(k, self.b)
            columns = [x.text.replace('"', "").upper() for x in t[k + 1 : e] if x.kind in ("id", "quoted")]
            self.skip |= set(range(k, e + 1))
            k = e + 1
        if self.refs:
            self.refs[-1]["writes"] = columns
        if k < self.b and t[k].up == "VALUES":
            e = self.p.close(k + 1, self.b)
            for j in range(k + 1, e):
                if j not in self.skip:
                    self.writes[j] = "value"
        return k

    def set_columns(self, k: int) -> None:
        t, level, expect = self.t, 0, True
        while k < self.b:
            u = t[k].up
            if level == 0 and u in ("WHERE", "WHEN", "RETURNING", "RETURN", "LOG", "DELETE"):
                return
            if u == "(":
                if expect:  # several columns at once
                    e = self.p.close(k, self.b)
                    for j in range(k + 1, e):
                        if t[j].kind in ("id", "quoted"):
                            self.writes[j] = "write"
                    k = e
                    expect = False
                else:
                    level += 1
            elif u == ")":
                level -= 1
                if level < 0:
                    return
            elif u == "," and level == 0:
                expect = True
            elif expect and level == 0 and t[k].kind in ("id", "quoted"):
                j = k
                while j + 2 < self.b and t[j + 1].up == ".":
                    j += 2
                self.writes[j] = "write"
                k = j
                expect = False
            k += 1

    def columns(self) -> None:
        """Every other name: (qualifier, column) with its part: read, write or value."""
        t, k, n = self.t, self.a, 0
        ghosts = {g.lower() for g, _ in self.ghosts}
        while k < self.b:
            x = t[k]
            if x.kind not in ("id", "quoted") or k in self.skip or (k > self.a and t[k - 1].up in (".", "@", ":", "%")):
                k += 1
                continue
            if x.kind == "id" and (x.up in WORDS or x.up in PSEUDO) and not (k + 1 < self.b and t[k + 1].up == "."):
                k += 1
                continue
            if k > self.a and t[k - 1].up == "AS" and t[k - 2].up != "(":
                self.row["aliases"].append(x.text.lower().replace('"', ""))
                k += 1
                continue
            if k > self.a and (t[k - 1].kind in ("id", "quoted", "number", "string") and t[k - 1].up not in WORDS or t[k - 1].up == ")") and k not in self.writes:
                self.row["aliases"].append(x.text.lower().replace('"', ""))  # a column alias without AS
                k += 1
                continue
            parts, j = [x.text.replace('"', "")], k + 1
            star = False
            while j + 1 < self.b and t[j].up == "." and (t[j + 1].kind in ("id", "quoted") or t[j + 1].up == "*"):
                star = t[j + 1].up == "*"
                if not star:
                    parts.append(t[j + 1].text.replace('"', ""))
                j += 2
            if not star and not (j < self.b and t[j].up in ("(", "@", "=>")) and parts[-1].upper() not in ("NEXTVAL", "CURRVAL"):
                role = self.writes.get(j - 1) or self.writes.get(k) or "read"
                qualifier = parts[-2].lower() if len(parts) > 1 else None
                if qualifier is None and parts[0].lower() in self.own:
                    self.row["binds"] = sorted({*self.row["binds"], parts[0].lower()})
                elif qualifier not in ghosts or qualifier is None:
                    self.p.add("use", stmt=self.row["seq"], seq=n, qualifier=qualifier, column=parts[-1].upper(), first=parts[0].lower(), role=role, scope=self.scope_at.get(k, "0"))
                    n += 1
            k = j

    def joins(self) -> None:
        """a.x = b.y, with (+) on either side, three-part names included."""
        t = self.t
        if len(self.refs) < 2:
            return
        for k in range(self.a + 1, self.b - 1):
            if t[k].up != "=":
                continue
            left, right = self.side(k - 1, -1), self.side(k + 1, 1)
            if left and right:
                self.p.add("join", stmt=self.row["seq"], lq=left[0], lc=left[1], rq=right[0], rc=right[1], scope=self.scope_at.get(k, "0"), dynamic=False)

    def side(self, k: int, way: int) -> tuple[str, str] | None:
        t, parts = self.t, []
        if way < 0:
            if t[k].up == "(+)":
                k -= 1
            while k >= self.a and t[k].kind in ("id", "quoted"):
                parts.insert(0, t[k].text.replace('"', ""))
                if k - 1 >= self.a and t[k - 1].up == ".":
                    k -= 2
                else:
                    break
        else:
            while k < self.b and t[k].kind in ("id", "quoted"):
                parts.append(t[k].text.replace('"', ""))
                if k + 2 < self.b and t[k + 1].up == ".":
                    k += 2
                else:
                    break
            if k + 1 < self.b and t[k + 1].up == "(":
                return None
        return (parts[-2].lower(), parts[-1].upper()) if len(parts) > 1 else None


def parse(text: str) -> dict[str, list[dict[str, Any]]]:
    """All fact rows of one text. Tables of DDL are added by the mixin below."""
    return DdlParser(text).parse()


class DdlParser(Parser):
    """CREATE TABLE and ALTER TABLE … ADD CONSTRAINT."""

    def table_row(self, begin: int, name: list[str], alter: bool) -> int:
        n = len(self.rows["table_def"])
        self.rows["table_def"].append({"def": n, "schema": name[-2].upper() if len(name) > 1 else None, "name": name[-1].upper(), "line": self.line(begin), "end_line": None, "alter_only": alter})
        return n

    def names(self) -> list[str]:
        self.need("(")
        a = self.until(")")
        self.need(")")
        return [x.text.replace('"', "").upper() for x in self.t[a : self.i - 1] if x.kind in ("id", "quoted")]

    def references(self, n: int, columns: list[str], name: str | None) -> None:
        self.need("REFERENCES")
        parent = self.dotted()
        to = self.names() if self.up() == "(" else []
        rule = None
        if self.up() == "ON" and self.up(1) == "DELETE":
            self.i += 2
            rule = "CASCADE" if self.take("CASCADE") else "SET NULL" if self.take("SET") and self.take("NULL") else None
        self.rows["table_fk"].append({"def": n, "fk": len(self.rows["table_fk"]), "name": name, "cols": columns, "parent": ".".join(parent[-2:]).upper(), "parent_cols": to, "on_delete": rule})

    def key(self, n: int, kind: str, columns: list[str]) -> None:
        self.rows["table_key"].append({"def": n, "kind": kind, "key": len(self.rows["table_key"]), "cols": columns})

    def constraint(self, n: int) -> bool:
        name = None
        if self.take("CONSTRAINT"):
            name = self.name()
        if self.take("PRIMARY"):
            self.need("KEY")
            self.key(n, "PRIMARY", self.names())
        elif self.up() == "UNIQUE" and self.up(1) == "(":
            self.i += 1
            self.key(n, "UNIQUE", self.names())
        elif self.take("FOREIGN"):
            self.need("KEY")
            self.references(n, self.names(), name)
        elif self.up() == "CHECK":
            pass
        else:
            return name is not None
        return True

    def create_table(self, begin: int) -> None:
        self.take("IF") and (self.need("NOT"), self.need("EXISTS"))
        name = self.dotted()
        n = self.table_row(begin, name, False)
        if self.take("("):
            seq = 0
            while self.up() not in (")", ""):
                if self.up() in ("CONSTRAINT", "PRIMARY", "FOREIGN", "CHECK") or (self.up() == "UNIQUE" and self.up(1) == "("):
                    self.constraint(n)
                    self.until(",")
                else:
                    self.column(n, seq)
                    seq += 1
                if not self.take(","):
                    break
            self.need(")")
        self.finish(n, begin)

    def column(self, n: int, seq: int) -> None:
        name = self.name().upper()
        stops = (",", "DEFAULT", "NOT", "NULL", "CONSTRAINT", "PRIMARY", "UNIQUE", "REFERENCES", "CHECK", "GENERATED", "ENABLE", "DISABLE")
        a = self.until(*stops)
        row = {"def": n, "seq": seq, "name": name, "type": self.text(a, self.i), "not_null": False, "default_text": None}
        self.rows["table_col"].append(row)
        constraint = None
        while self.up() not in (",", ")", ""):
            if self.take("CONSTRAINT"):
                constraint = self.name()
            elif self.take("DEFAULT"):
                if self.take("ON"):
                    self.take("NULL")
                a = self.until(*[s for s in stops if s not in ("NULL", "DEFAULT")], "NULL") if self.up() != "NULL" else self.i
                self.i += a == self.i
                row["default_text"] = self.text(a, self.i)
            elif self.take("NOT"):
                row["not_null"] = self.take("NULL") or row["not_null"]
            elif self.take("PRIMARY"):
                self.need("KEY")
                self.key(n, "PRIMARY", [name])
            elif self.take("UNIQUE"):
                self.key(n, "UNIQUE", [name])
            elif self.up() == "REFERENCES":
                self.references(n, [name], constraint)
            elif self.up() == "(":
                self.i += 1
                self.until(")")
                self.need(")")
            else:
                self.i += 1

    def alter_table(self, begin: int) -> None:
        name = self.dotted()
        if self.up() == "ADD":
            self.i += 1
            paren = self.take("(")
            if self.up() in ("CONSTRAINT", "PRIMARY", "FOREIGN", "UNIQUE"):
                n = self.table_row(begin, name, True)
                self.constraint(n)
                while self.take(",") or self.take("ADD"):
                    self.constraint(n)
                if paren:
                    self.until(")")
                    self.take(")")
                return self.finish(n, begin)
        self.i = begin
        return self.skipped(begin, "alter_table", ".".join(name).upper(), plsql=False)

    def finish(self, n: int, begin: int) -> None:
        while self.i < self.n and self.up() != ";" and not (self.up() == "/" and self.alone(self.i)):
            self.i += 1
        if self.i < self.n:
            self.i += 1
        self.rows["table_def"][n]["end_line"] = self.end_line(self.i)
        self.rows["skipped"].append({"kind": "alter_table" if self.rows["table_def"][n]["alter_only"] else "create_table", "name": self.text(begin, self.i)[:80], "object": self.rows["table_def"][n]["name"], "line": self.line(begin), "end_line": self.end_line(self.i), "reason": "its columns and keys are kept as a table definition"})
