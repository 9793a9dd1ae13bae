"""One corpus analysed: every fact and derived table as a lazily planned DataFrame."""

from __future__ import annotations

from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import builtins
from codeloom.operators import effects, er, filedeps, graph, link, resolve, rules, score
from codeloom.sources.files import Facts, stash


class Analysis:
    """Files (file, text[, content]) to tables. Tables that several others need are kept in the shared folder."""

    def __init__(self, files: DataFrame, flags: dict[str, Any] | None = None):
        self.spark, self.files = files.sparkSession, files
        self.facts = Facts(files, flags)

    def fact(self, name: str) -> DataFrame:
        return self.facts.table(name)

    @cached_property
    def file(self) -> DataFrame:
        return self.fact("file")

    @cached_property
    def unit(self) -> DataFrame:
        return stash(link.units(self.facts), "unit")

    @cached_property
    def _routines(self) -> tuple[DataFrame, DataFrame]:
        return link.routines(self.facts, self.unit)

    @cached_property
    def alternate(self) -> DataFrame:
        return stash(link.alternates(self._routines[0]), "alternate")

    @cached_property
    def routine(self) -> DataFrame:
        """Primary routines and those that only the alternate variant has."""
        return stash(self._routines[0].where("variant = 'primary'").unionByName(self.alternate), "routine")

    @cached_property
    def owner_of(self) -> DataFrame:
        """Parsed routine to id, for primary code and alternate-only routines; the rest of the alternate is left out."""
        primary = self._routines[1].where("variant = 'primary'")
        return stash(primary.unionByName(self.alternate.select("file", "variant", "unit", "rid", "id")), "owner")

    @cached_property
    def owner(self) -> DataFrame:
        """All that owns code, with its id; kept, since every fact table meets it."""
        return stash(resolve.owners(self.owner_unit, self.owner_of), "owners")

    @cached_property
    def owner_unit(self) -> DataFrame:
        return self.unit.where("variant = 'primary'")

    @cached_property
    def issue(self) -> DataFrame:
        return link.issues(self.facts, self.unit, self._routines[0], self._routines[1])

    @cached_property
    def chain(self) -> DataFrame:
        return resolve.chains(self.facts, self.unit)

    @cached_property
    def names(self) -> DataFrame:
        return resolve.scope_names(self.facts, self.chain)

    @cached_property
    def call(self) -> DataFrame:
        return stash(resolve.calls(self.facts, self.owner_unit_all, self.routine, self.owner, self.chain, self.names), "call")

    @cached_property
    def owner_unit_all(self) -> DataFrame:
        """Units whose blocks own code: those of the primary variant; others are only looked up."""
        return self.unit.withColumn("block_id", F.when(F.col("variant") == "primary", F.col("block_id"))).where("block_id is not null")

    @cached_property
    def _columns(self) -> tuple[DataFrame, DataFrame]:
        ref, sql = resolve.columns(self.facts, self.owner_unit, self.owner, self.names)
        return stash(ref, "ref"), stash(sql, "sql")

    @cached_property
    def ref(self) -> DataFrame:
        return self._columns[0]

    @cached_property
    def sql(self) -> DataFrame:
        return self._columns[1]

    @cached_property
    def join(self) -> DataFrame:
        return stash(resolve.joins(self.facts, self.ref, self.owner), "join")

    @cached_property
    def step(self) -> DataFrame:
        return stash(effects.steps(self.facts, self.owner), "step")

    @cached_property
    def step_ref(self) -> DataFrame:
        """SQL and calls of each step."""
        key = resolve.OWNER
        s = effects.claim(self.sql, ["stmt"]).join(self.sql.select(*key, "stmt", "kind"), [*key, "stmt"]).select(*key, "path", F.lit("sql").alias("what"), F.col("kind").alias("ref"))
        c = effects.claim(self.call, ["seq"]).join(self.call.select(*key, "seq", F.array_join("parts", ".").alias("ref")), [*key, "seq"]).select(*key, "path", F.lit("call").alias("what"), "ref")
        return s.unionByName(c)

    @cached_property
    def outline_mismatch(self) -> DataFrame:
        return effects.lossless(self.facts)

    @cached_property
    def raises(self) -> DataFrame:
        return effects.raises(self.step)

    @cached_property
    def handler(self) -> DataFrame:
        return stash(effects.handlers(self.step), "handler")

    @cached_property
    def implicit(self) -> DataFrame:
        return effects.implicit_exceptions(self.sql)

    @cached_property
    def effect(self) -> DataFrame:
        return stash(effects.effects(self.facts, self.owner_unit, self.owner, self.sql, self.ref, self.call, self.names, self.chain), "effect")

    @cached_property
    def touched(self) -> DataFrame:
        return effects.touched(self.ref)

    @cached_property
    def metric(self) -> DataFrame:
        return stash(effects.metrics(self.step, self.sql, self.call, self.routine), "metric")

    @cached_property
    def place(self) -> DataFrame:
        """Where each owner of code stands: routines and unit blocks."""
        r = self.routine.select(F.col("id").alias("owner_id"), "file", "line")
        b = self.owner_unit.select(F.col("block_id").alias("owner_id"), "file", F.coalesce("init_line", "line").alias("line"))
        return r.unionByName(b).groupBy("owner_id").agg(F.min(F.struct("file", "line")).alias("p")).select("owner_id", "p.file", "p.line")

    @cached_property
    def risk(self) -> DataFrame:
        tables = {"raise": self.raises, "handler": self.handler, "implicit": self.implicit, "effect": self.effect, "sql": self.sql, "step": self.step, "call": self.call, "metric": self.metric}
        return stash(rules.risks(tables, self.place), "risk")

    @cached_property
    def block(self) -> DataFrame:
        """Unit blocks that do something."""
        busy = self.step.select("owner_id").union(self.sql.select("owner_id")).union(self.call.select("owner_id")).distinct()
        return self.owner_unit.where("kind in ('TRIGGER', 'ANONYMOUS_BLOCK') or has_init").join(busy.withColumnRenamed("owner_id", "block_id"), "block_id", "left_semi")

    @cached_property
    def node(self) -> DataFrame:
        """Graph nodes; of equal ids the first by type wins."""
        cols = ["id", "type", "label", "owner", "file", "line", "visibility"]
        null = lambda t="string": F.lit(None).cast(t)
        r = self.routine.select("id", F.lit("ROUTINE").alias("type"), F.col("name").alias("label"), "owner", "file", "line", "visibility", F.lit(0).alias("rank"))
        b = self.block.select(F.col("block_id").alias("id"), F.lit("UNIT_BLOCK").alias("type"), F.col("name").alias("label"), F.upper("name").alias("owner"), "file", "line", null().alias("visibility"), F.lit(1).alias("rank"))
        t = self.ref.select(F.upper("table_key").alias("id")).distinct().select("id", F.lit("TABLE").alias("type"), F.col("id").alias("label"), null().alias("owner"), null().alias("file"), null("int").alias("line"), null().alias("visibility"), F.lit(2).alias("rank"))
        dotted = F.upper(F.array_join("parts", "."))
        kind = F.when(F.col("builtin_package").isNotNull(), "BUILTIN_PACKAGE").when(F.col("resolution") == "EXTERNAL", "EXTERNAL").otherwise("UNRESOLVED")
        other = self.call.where("targets is null and (resolution <> 'BUILTIN' or builtin_package is not null)").select(F.coalesce("builtin_package", dotted).alias("id"), kind.alias("type")).distinct()
        x = other.select("id", "type", F.col("id").alias("label"), null().alias("owner"), null().alias("file"), null("int").alias("line"), null().alias("visibility"), F.lit(3).alias("rank"))
        every = r.unionByName(b).unionByName(t).unionByName(x)
        return stash(link.first_wins(every, ["id"], ["rank", "type", "file", "line"]).where("nth = 1").select(*cols), "node")

    @cached_property
    def edge(self) -> DataFrame:
        """Edges by (src, dst, type): how often, whether one of several overloads, whether in a loop, and details."""
        dotted = F.upper(F.array_join("parts", "."))
        c = self.call.where("targets is not null or resolution <> 'BUILTIN' or builtin_package is not null").withColumn("to", F.coalesce("targets", F.array(F.coalesce("builtin_package", dotted))))
        c = c.select(F.col("owner_id").alias("src"), F.explode("to").alias("dst"), F.lit("CALLS").alias("type"), (F.size("to") > 1).alias("ambiguous"), "in_loop", F.col("resolution").alias("detail"))
        r = self.ref.join(self.sql.select(*resolve.OWNER, "stmt", "in_loop"), [*resolve.OWNER, "stmt"])
        r = r.select(F.col("owner_id").alias("src"), F.upper("table_key").alias("dst"), F.explode("access").alias("access"), "in_loop", "confidence")
        r = r.select("src", "dst", F.when(F.col("access").isin("READ", "LOCK"), "READS").otherwise("WRITES").alias("type"), F.lit(False).alias("ambiguous"), "in_loop", F.concat("access", F.when(F.col("confidence") == "INFERRED", " (inferred)").otherwise("")).alias("detail"))
        g = c.unionByName(r).groupBy("src", "dst", "type").agg(F.count("*").alias("count"), F.max("ambiguous").alias("ambiguous"), F.max("in_loop").alias("in_loop"), F.sort_array(F.collect_set("detail")).alias("detail"))
        return stash(g, "edge")

    @cached_property
    def calls(self) -> DataFrame:
        """Edges between routines and blocks only: (src, dst, ambiguous)."""
        inside = self.node.where("type in ('ROUTINE', 'UNIT_BLOCK')").select(F.col("id").alias("dst"))
        return self.edge.where("type = 'CALLS'").join(inside, "dst", "left_semi").select("src", "dst", "ambiguous", "count", "in_loop")

    @cached_property
    def routine_nodes(self) -> DataFrame:
        return self.node.where("type = 'ROUTINE'").select(F.col("id").alias("node"))

    @cached_property
    def recursion(self) -> DataFrame:
        return graph.recursion_groups(self.calls.where("not ambiguous").select("src", "dst"), self.routine_nodes)

    @cached_property
    def batch(self) -> DataFrame:
        return stash(graph.batches(self.calls.select("src", "dst").join(self.routine_nodes.toDF("src"), "src", "left_semi").join(self.routine_nodes.toDF("dst"), "dst", "left_semi"), self.routine_nodes), "batch")

    @cached_property
    def rank(self) -> DataFrame:
        return graph.ranks(self.batch)

    @cached_property
    def uncalled(self) -> DataFrame:
        """Routines nobody calls: entry points if they can be called from outside, else dead."""
        r = self.routine.where("not forward or visibility = 'PUBLIC'").select(F.col("id").alias("node"), "visibility")
        return graph.uncalled(r, self.calls).withColumn("what", F.when(F.col("visibility").isin("PUBLIC", "STANDALONE", "UNKNOWN"), "ENTRY_POINT").otherwise("DEAD"))

    @cached_property
    def impact(self) -> DataFrame:
        e = self.edge
        return graph.table_impact(e.where("type = 'READS'").select(F.col("dst").alias("table_key"), F.col("src").alias("node")), e.where("type = 'WRITES'").select(F.col("dst").alias("table_key"), F.col("src").alias("node")), self.calls.select("src", "dst"))

    @cached_property
    def package_edge(self) -> DataFrame:
        """The graph between packages (or single routines, tables): counts added up, no edges to oneself."""
        group = self.node.select("id", F.coalesce("owner", "id").alias("g"))
        e = self.edge.join(group.toDF("src", "from_group"), "src").join(group.toDF("dst", "to_group"), "dst").where("from_group <> to_group")
        return e.groupBy("from_group", "type", "to_group").agg(F.sum("count").alias("count"), F.max("in_loop").alias("in_loop"))

    @cached_property
    def _coverage(self) -> tuple[DataFrame, DataFrame]:
        return score.coverage(self.file, self.fact("source"), self.owner_unit, self.fact("skipped"))

    @cached_property
    def file_coverage(self) -> DataFrame:
        return stash(self._coverage[0], "coverage")

    @cached_property
    def gaps(self) -> DataFrame:
        return self._coverage[1]

    @cached_property
    def population(self) -> DataFrame:
        r = self.routine.where("has_body").select(F.col("id").alias("owner_id"), "file", "variant", "visibility", "line", (F.col("end_line") - F.col("line") + 1).alias("lines"))
        b = self.block.select(F.col("block_id").alias("owner_id"), "file", "variant", F.lit("BLOCK").alias("visibility"), "line", (F.col("end_line") - F.col("line") + 1).alias("lines"))
        return r.unionByName(b)

    @cached_property
    def finding(self) -> DataFrame:
        return stash(score.findings(self.population, self.call, self.sql, self.ref, self.step, self.file), "finding")

    @cached_property
    def score(self) -> DataFrame:
        return stash(score.scores(self.population, self.finding), "score")

    @cached_property
    def file_score(self) -> DataFrame:
        return score.file_scores(self.file, self.file_coverage)

    @cached_property
    def confidence(self) -> DataFrame:
        return score.overall(self.score, self.file_score)

    @cached_property
    def missing(self) -> DataFrame:
        return score.missing({"call": self.call, "sql": self.sql, "ref": self.ref, "table_def": self.fact("table_def"), "skipped": self.fact("skipped"), "unit": self.unit, "file": self.file, "gaps": self.gaps, "issue": self.issue, "routine": self.routine})

    @cached_property
    def file_need(self) -> DataFrame:
        """Edges of need between files: calls, specifications, definitions."""
        return stash(filedeps.file_edges(self.edge, self.node, self.unit, self.ref, self.fact("table_def")), "fileedge")

    @cached_property
    def shared_table(self) -> DataFrame:
        return filedeps.shared_tables(filedeps.table_use(self.ref))

    @cached_property
    def file_edge(self) -> DataFrame:
        """All file edges, shared tables included."""
        return self.file_need.unionByName(self.shared_table.select(self.file_need.columns))

    @cached_property
    def file_node(self) -> DataFrame:
        return filedeps.file_nodes(self.file, self.unit, self.routine, self.file_need)

    @cached_property
    def er(self) -> dict[str, DataFrame]:
        defs = er.definitions(*(self.fact(t) for t in ("table_def", "table_col", "table_key", "table_fk")))
        return er.model(defs, self.ref, self.join)

    @cached_property
    def er_cluster(self) -> DataFrame:
        return er.clusters(self.er["entity"], self.er["relation"])

    @cached_property
    def source(self) -> DataFrame:
        """Each routine's lines as they stand in the file, and masked."""
        cut = lambda c: F.array_join(F.slice(F.split(c, r"\r?\n", -1), F.col("line"), F.greatest(F.col("end_line") - F.col("line") + 1, F.lit(0))), "\n")
        return self.routine.join(self.fact("source").select("file", "variant", "text", F.col("masked").alias("m")), ["file", "variant"]).select("id", "file", "variant", "line", "end_line", "attributes", "params", cut("text").alias("source"), cut("m").alias("masked"))

    @cached_property
    def note(self) -> DataFrame:
        return rules.notes(self.source)

    @cached_property
    def package_overview(self) -> DataFrame:
        """One row per package: routines, public ones, lines, highest complexity, tables read and written, high risks."""
        r = self.routine.where("owner is not null and variant = 'primary'").select(F.col("id").alias("owner_id"), "owner", "visibility", (F.col("end_line") - F.col("line") + 1).alias("loc"))
        m = r.join(self.metric.select("owner_id", "cyclomatic"), "owner_id", "left")
        a = m.groupBy("owner").agg(F.count("*").alias("routines"), F.sum((F.col("visibility") == "PUBLIC").cast("long")).alias("public"), F.sum("loc").alias("lines"), F.max("cyclomatic").alias("max_cyclomatic"))
        own = r.select("owner_id", "owner")
        t = own.join(self.touched, "owner_id")
        read = t.select("owner", F.explode("tables_read").alias("t")).groupBy("owner").agg(F.countDistinct("t").alias("tables_read"))
        wrote = t.select("owner", F.explode("tables_written").alias("t")).groupBy("owner").agg(F.countDistinct("t").alias("tables_written"))
        high = self.risk.where("severity = 'HIGH'").join(own, "owner_id").groupBy("owner").agg(F.count("*").alias("high_risks"))
        out = a.join(read, "owner", "left").join(wrote, "owner", "left").join(high, "owner", "left")
        return out.select("owner", "routines", "public", "lines", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("max_cyclomatic", "tables_read", "tables_written", "high_risks")))

    @cached_property
    def declaration(self) -> DataFrame:
        """Declarations with their owner; an exception has the number that a pragma of its scope gives it."""
        scope = ["file", "variant", "unit", "routine"]
        codes = self.fact("exception_init").groupBy(*scope, "name").agg(F.min("code").alias("code")).withColumnRenamed("name", "low")
        d = self.fact("decl").withColumn("low", F.lower("name")).join(codes, [*scope, "low"], "left")
        d = d.withColumn("error_code", F.when(F.col("kind") == "EXCEPTION", F.col("code")).otherwise(F.col("error_code"))).drop("low", "code")
        return resolve.owned(d, self.owner)

    @cached_property
    def adjacency(self) -> DataFrame:
        """(node, callers, callees) over routines and blocks."""
        into = self.calls.groupBy(F.col("dst").alias("node")).agg(F.sort_array(F.collect_set("src")).alias("callers"))
        out = self.calls.groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_set("dst")).alias("callees"))
        none = F.array().cast("array<string>")
        return into.join(out, "node", "full_outer").select("node", F.coalesce("callers", none).alias("callers"), F.coalesce("callees", none).alias("callees"))

    @cached_property
    def package_dependency(self) -> DataFrame:
        """Per package: tables read and written, built-ins, other packages and routines called, what is unresolved, and
        who calls it from outside."""
        group = self.node.select("id", "type", F.coalesce("owner", "id").alias("g"), "owner")
        e = self.edge.withColumnRenamed("type", "edge_type").join(group.select(F.col("id").alias("src"), F.col("owner").alias("from_owner"), F.col("g").alias("from_group")), "src").join(group.select(F.col("id").alias("dst"), F.col("type").alias("dst_type"), F.col("owner").alias("to_owner"), F.col("g").alias("to_group")), "dst")
        pick = lambda cond, c: F.sort_array(F.collect_set(F.when(cond, F.col(c))))
        called = (F.col("edge_type") == "CALLS") & (F.col("from_group") != F.col("to_group"))
        out = e.where("from_owner is not null").groupBy(F.col("from_owner").alias("owner")).agg(pick(F.col("edge_type") == "READS", "dst").alias("reads"), pick(F.col("edge_type") == "WRITES", "dst").alias("writes"), pick(called & (F.col("dst_type") == "BUILTIN_PACKAGE"), "dst").alias("builtins"), pick(called & F.col("dst_type").isin("ROUTINE", "UNIT_BLOCK"), "to_group").alias("calls"), pick(called & F.col("dst_type").isin("EXTERNAL", "UNRESOLVED"), "dst").alias("unresolved"))
        into = e.where(called & F.col("to_owner").isNotNull()).groupBy(F.col("to_owner").alias("owner")).agg(F.sort_array(F.collect_set("src")).alias("callers"))
        return out.join(into, "owner", "full_outer")

    @cached_property
    def sentence(self) -> DataFrame:
        """One sentence of facts for each owner."""
        m = self.metric.join(self.touched, "owner_id", "left")
        count = lambda c, one, many: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.when(F.col(c) == 1, f" {one}").otherwise(f" {many}")))
        names = lambda c, label: F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(c, ", ")))
        parts = [count("lines_of_code", "line", "lines"), count("statements", "statement", "statements"), count("loops", "loop", "loops"), count("sql_statements", "SQL statement", "SQL statements"), count("calls", "call", "calls"), names("tables_read", "reads "), names("tables_written", "writes ")]
        return m.select("owner_id", F.concat_ws("; ", *parts).alias("sentence"))

    @cached_property
    def described_call(self) -> DataFrame:
        """How a call is spoken of in the outline."""
        name = F.upper(F.array_join("parts", "."))
        said = F.when(F.size("targets") == 1, F.element_at("targets", 1)).when(F.size("targets") > 1, F.concat(F.lit("one of "), F.array_join("targets", ", "))).when(F.col("resolution") == "BUILTIN", F.concat(name, F.lit(" (built in)"))).otherwise(F.concat(name, F.lit(" (not found here)")))
        return self.call.select("owner_id", "offset", "line", said.alias("said"))

    @cached_property
    def io_category(self) -> DataFrame:
        return self.call.where("builtin_package is not null").select("owner_id", "builtin_package", builtins.category(F.col("builtin_package")).alias("category")).distinct()


_KNOWN: dict[tuple[str, str, str], Analysis] = {}


def known(spark, sf_dir: str, make) -> Analysis:
    """The analysis of a corpus made of a table folder, parsed once in a session."""
    key = (spark.sparkContext.applicationId, make.__module__, sf_dir)
    if key not in _KNOWN:
        _KNOWN[key] = Analysis(make(spark, sf_dir))
    return _KNOWN[key]


def of_tables(spark, sf_dir: str) -> Analysis:
    from codeloom.sources import synth

    return known(spark, sf_dir, synth.corpus)


def of_samples(spark, sf_dir: str) -> Analysis:
    from codeloom.sources import samples

    return known(spark, sf_dir, samples.corpus)
