"""Name resolution: scopes, calls with overloads, columns of tables. All candidates are joins, the best tier wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import builtins
from codeloom.sources.files import Facts, stash

OWNER = ["file", "variant", "unit", "routine"]


def chains(facts: Facts, unit: DataFrame) -> DataFrame:
    """For every owner of code, the places whose declarations it sees: (file, variant, unit, routine, s_file, s_unit,
    s_routine, dist); itself at 0, enclosing routines, its unit, and for a body the package's specification."""
    r = facts.table("routine").select("file", "variant", "unit", F.col("rid").alias("routine"), "parent", "depth")
    blocks = unit.select("file", "variant", "unit", F.lit(-1).alias("routine"))
    self_ = r.select(*OWNER).unionByName(blocks)
    seen = self_.select(*OWNER, F.col("routine").alias("at"), F.lit(0).alias("dist"))
    frontier = seen
    for _ in range((r.agg(F.max("depth")).first()[0] or 0) + 1):
        frontier = frontier.where("at >= 0").join(r.select("file", "variant", "unit", F.col("routine").alias("at"), "parent"), ["file", "variant", "unit", "at"]).select(*OWNER, F.col("parent").alias("at"), (F.col("dist") + 1).alias("dist"))
        seen = seen.unionByName(frontier)
    seen = seen.withColumn("s_file", F.col("file")).withColumn("s_unit", F.col("unit"))
    links = unit.where("kind = 'PACKAGE_BODY'").select("file", "variant", "unit", "ukey").join(unit.where("kind = 'PACKAGE_SPEC' and nth = 1").select("variant", "ukey", F.col("file").alias("s_file"), F.col("unit").alias("s_unit")), ["variant", "ukey"]).drop("ukey")
    outer = seen.where("at = -1").drop("s_file", "s_unit").join(links, ["file", "variant", "unit"]).withColumn("dist", F.col("dist") + 1)
    return stash(seen.unionByName(outer.select(seen.columns)).withColumnRenamed("at", "s_routine"), "chains")


def scope_names(facts: Facts, chain: DataFrame) -> DataFrame:
    """Names each owner sees: (owner, name, what, const, dist, level); what is VARIABLE, TYPE, CURSOR, …; level is
    PACKAGE for what a unit declares."""
    d = facts.table("decl").where("kind <> 'PRAGMA'").select("file", "variant", "unit", "routine", F.lower("name").alias("name"), F.col("kind").alias("what"), "is_const")
    p = facts.table("routine").select("file", "variant", "unit", F.col("rid").alias("routine"), F.explode("params").alias("p")).select("file", "variant", "unit", "routine", F.lower("p.name").alias("name"), F.lit("PARAMETER").alias("what"), F.lit(False).alias("is_const"))
    every = d.unionByName(p).toDF("s_file", "variant", "s_unit", "s_routine", "name", "what", "is_const")
    out = chain.join(every, ["s_file", "variant", "s_unit", "s_routine"]).select(*OWNER, "name", "what", "is_const", "dist", F.when(F.col("s_routine") == -1, "PACKAGE").otherwise("LOCAL").alias("level"), "s_unit")
    return stash(out, "scope")


VARIABLES = ("VARIABLE", "PARAMETER", "CURSOR", "EXCEPTION", "LOOP_VARIABLE")


def calls(facts: Facts, unit: DataFrame, routine: DataFrame, owner: DataFrame, chain: DataFrame, names: DataFrame) -> DataFrame:
    """Resolved calls: the call's columns, owner_id, resolution, targets (ids), target_id (if one), builtin_package.

    Resolutions: INTERNAL, BUILTIN, CONSTRUCTOR, EXTERNAL, UNRESOLVED_IN_PACKAGE, UNRESOLVED.
    """
    c = facts.table("call").where(F.size("parts") > 0).withColumn("call", F.xxhash64("file", "variant", "unit", "routine", "seq"))
    c = c.withColumn("low", F.transform("parts", lambda x: F.lower(x))).withColumn("first", F.element_at("low", 1)).withColumn("last", F.element_at("low", -1)).withColumn("n", F.size("parts")).withColumn("owner_part", F.when(F.col("n") > 1, F.element_at("low", -2)))
    variables = names.where(F.col("what").isin(*VARIABLES)).select(*OWNER, F.col("name").alias("first")).distinct()
    c = stash(c.join(variables, [*OWNER, "first"], "left_anti"), "named")
    # candidates by tier: the innermost routines first
    overload = routine.select("id", "variant", "low", F.size("params").alias("total"), F.size(F.filter("params", lambda p: p["default_text"].isNull())).alias("required"), F.transform("params", lambda p: F.lower(p["name"])).alias("arg_names"), "file", "unit", "rid", "parent", "owner", "ukey", "visibility", "depth")
    local = overload.where("parent >= 0 or visibility = 'LOCAL'").select(F.col("file").alias("s_file"), "variant", F.col("unit").alias("s_unit"), F.col("parent").alias("s_routine"), F.col("low").alias("last"), F.col("id").alias("target"), "total", "required", "arg_names")
    pick = ["target", "total", "required", "arg_names"]
    single, qualified = c.where("n = 1"), c.where("n > 1")
    tier_local = single.join(chain, OWNER).join(local, ["s_file", "variant", "s_unit", "s_routine", "last"]).select("call", F.col("dist").alias("tier"), *pick)
    u = unit.select("file", "variant", "unit", F.col("kind").alias("own_kind"), F.col("ukey").alias("own_key"))
    top = overload.where("depth = 0 and owner is not null").select("variant", F.col("ukey").alias("pkg"), F.col("low").alias("last"), F.col("id").alias("target"), "total", "required", "arg_names", "visibility")
    # what the alternate variant alone has may call into the primary one
    top, tops = top.where("variant = 'primary'").drop("variant"), top
    tier_own = single.join(u, ["file", "variant", "unit"]).where(F.col("own_kind").startswith("PACKAGE")).withColumn("pkg", F.col("own_key")).join(top, ["pkg", "last"]).select("call", F.lit(1000).alias("tier"), *pick)
    alone = overload.where("owner is null and depth = 0 and visibility = 'STANDALONE' and variant = 'primary'").select(F.col("low").alias("last"), F.col("id").alias("target"), "total", "required", "arg_names")
    tier_alone = single.join(alone, "last").select("call", F.lit(2000).alias("tier"), *pick)
    q = qualified.join(u, ["file", "variant", "unit"], "left").withColumn("pkg", F.col("owner_part"))
    spec_known = unit.where("kind = 'PACKAGE_SPEC'").select(F.col("ukey").alias("pkg")).distinct().withColumn("has_spec", F.lit(True))
    tier_pkg = q.join(top, ["pkg", "last"]).join(spec_known, "pkg", "left").where((F.col("own_key") == F.col("pkg")) | (F.col("visibility") == "PUBLIC") | F.col("has_spec").isNull()).where("link is null").select("call", F.lit(1000).alias("tier"), *pick)
    tier_schema = qualified.where("n = 2 and link is null").join(alone, "last").join(unit.where("kind like 'PACKAGE%'").select(F.col("ukey").alias("owner_part")).distinct(), "owner_part", "left_anti").where(~builtins.is_package(F.col("owner_part"))).select("call", F.lit(3000).alias("tier"), *pick)
    found = tier_local.unionByName(tier_own).unionByName(tier_alone).unionByName(tier_pkg).unionByName(tier_schema)
    best = found.withColumn("best", F.min("tier").over(Window.partitionBy("call"))).where("tier = best").drop("best", "tier").distinct()
    fits = stash(narrow(best.join(c.select("call", "argc", "named"), "call")), "fits")
    packages = unit.where("kind like 'PACKAGE%'").select(F.col("ukey").alias("owner_part")).distinct().withColumn("pkg_known", F.lit(True))
    types = names.where("what = 'TYPE'").select(*OWNER, F.col("name").alias("first")).distinct().withColumn("is_type", F.lit(True))
    out = c.join(fits, "call", "left").join(packages, "owner_part", "left").join(types, [*OWNER, "first"], "left")
    internal = F.col("targets").isNotNull()
    builtin_pkg = F.when((F.col("n") > 1) & builtins.is_package(F.col("owner_part")), F.col("owner_part"))
    resolution = (
        F.when(F.col("link").isNotNull(), "EXTERNAL").when(internal, "INTERNAL").when((F.col("n") == 1) & builtins.is_function(F.col("first")), "BUILTIN").when((F.col("n") == 1) & F.col("is_type"), "CONSTRUCTOR")
        .when((F.col("n") > 1) & F.col("pkg_known"), "UNRESOLVED_IN_PACKAGE").when(builtin_pkg.isNotNull() | ((F.col("n") > 1) & (F.col("first") == "sys")), "BUILTIN").when(F.col("n") > 1, "EXTERNAL").otherwise("UNRESOLVED")
    )
    out = out.withColumn("resolution", resolution).withColumn("builtin_package", F.when(F.col("resolution") == "BUILTIN", F.upper(F.coalesce(builtin_pkg, F.col("owner_part")))))
    # what is no call after all: names without arguments that resolved to nothing, collection methods, built-in functions
    called = F.col("statement") | F.col("parens") | internal | F.col("link").isNotNull() | builtin_pkg.isNotNull()
    noise = (F.col("n") == 1) & (F.col("resolution").isin("BUILTIN")) & (F.col("first") != "raise_application_error")
    method = (F.col("n") > 1) & builtins.is_method(F.col("last")) & ~internal & F.col("pkg_known").isNull() & builtin_pkg.isNull()
    sequence = (F.col("n") > 1) & F.col("last").isin("nextval", "currval")
    out = out.where(called & ~noise & ~method & ~sequence & ~(F.col("is_type").isNotNull() & (F.col("n") == 1) & ~internal))
    out = owned(out, owner.where("routine >= 0 or owner_id is not null"))
    return out.drop("low", "owner_part", "pkg_known", "is_type", "n").withColumn("target_id", F.when(F.size("targets") == 1, F.element_at("targets", 1)))


def narrow(rows: DataFrame) -> DataFrame:
    """Overloads of each call that fit: enough arguments, not too many, all named ones known; if none fits, all stay.
    Rows (call, target, total, required, arg_names, argc, named) to (call, targets)."""
    ok = F.col("argc").between(F.col("required"), F.col("total")) & F.forall("named", lambda a: F.array_contains(F.col("arg_names"), a))
    rows = rows.withColumn("ok", ok).withColumn("some", F.max("ok").over(Window.partitionBy("call")))
    return rows.where("ok or not some").groupBy("call").agg(F.sort_array(F.collect_set("target")).alias("targets"))


def owners(unit: DataFrame, owner_of: DataFrame) -> DataFrame:
    """(file, variant, unit, routine, owner_id) of all that owns code: the routine's id, or for routine -1 the unit's block."""
    ids = owner_of.select("file", "variant", "unit", F.col("rid").alias("routine"), F.col("id").alias("owner_id"))
    blocks = unit.select("file", "variant", "unit", F.lit(-1).alias("routine"), F.col("block_id").alias("owner_id"))
    return ids.unionByName(blocks).dropDuplicates(OWNER)


def owned(rows: DataFrame, owner: DataFrame) -> DataFrame:
    """Adds owner_id, from the table of owners."""
    return rows.join(owner, OWNER)


def columns(facts: Facts, unit: DataFrame, owner: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table_ref, sql): references with the columns read and written, statements with binds and what stays unattributed.

    A qualified column belongs to the reference with that alias, or that name, of the nearest enclosing query block; an
    unqualified one is a bind if a variable has the name, else it belongs to the statement's only table.
    """
    stmt = [*OWNER, "stmt"]
    ref = facts.table("ref").withColumn("tname", F.lower("table"))
    use = facts.table("use")
    variables = names.where(F.col("what").isin(*VARIABLES)).select(*OWNER, F.col("name").alias("first")).distinct().withColumn("is_var", F.lit(True))
    use = use.join(variables, [*OWNER, "first"], "left")
    aliases = facts.table("sql").select(*OWNER, F.col("seq").alias("stmt"), "aliases")
    use = use.join(aliases, stmt, "left").where(~F.coalesce(F.col("qualifier").isNull() & F.array_contains("aliases", F.lower("column")) & F.col("is_var").isNull(), F.lit(False))).drop("aliases")
    use = stash(use, "use")
    q = use.where("qualifier is not null")
    r = ref.select(*stmt, "ref", F.col("scope").alias("r_scope"), F.lower("alias").alias("r_alias"), "tname")
    hit = q.join(r, stmt).where(F.startswith(F.col("scope"), F.col("r_scope")))
    rank = F.when(F.col("r_alias") == F.col("qualifier"), 0).when(F.col("r_alias").isNull() & (F.col("tname") == F.col("qualifier")), 1).when(F.col("tname") == F.col("qualifier"), 2)
    w = Window.partitionBy(*stmt, "seq").orderBy("rank", F.desc(F.length("r_scope")), "ref")
    hit = hit.withColumn("rank", rank).where("rank is not null").withColumn("nth", F.row_number().over(w)).where("nth = 1")
    hit = stash(hit.select(*stmt, "seq", "ref", "column", "role"), "hit")
    counted = ref.groupBy(*stmt).agg(F.count("*").alias("n_refs"), F.min("ref").alias("only"))
    plain = use.where("qualifier is null").join(counted, stmt)
    bind = plain.where("is_var or role = 'value'").union(q.join(hit.select(*stmt, "seq"), [*stmt, "seq"], "left_anti").join(counted, stmt).where("is_var").select(plain.columns))
    single = plain.where("is_var is null and role <> 'value' and n_refs = 1")
    lost = plain.where("is_var is null and role <> 'value' and n_refs > 1")
    # a column that is set belongs to the table that is changed, whatever else the statement names
    target = ref.where(F.arrays_overlap("access", F.array(F.lit("UPDATE"), F.lit("INSERT")))).groupBy(*stmt).agg(F.min("ref").alias("target"))
    kept = lost.join(target, stmt, "left")
    written = kept.where("role = 'write' and target is not null")
    unattributed = kept.where("not (role = 'write' and target is not null)")
    at = hit.select(*stmt, "ref", "column", "role").unionByName(single.select(*stmt, F.col("only").alias("ref"), "column", "role")).unionByName(written.select(*stmt, F.col("target").alias("ref"), "column", "role"))
    cols = at.groupBy(*stmt, "ref").agg(F.sort_array(F.collect_set(F.when(F.col("role") == "read", F.col("column")))).alias("read_cols"), F.sort_array(F.collect_set(F.when(F.col("role") == "write", F.col("column")))).alias("more_writes"))
    empty = F.array().cast("array<string>")
    out = ref.join(cols, [*stmt, "ref"], "left").withColumn("read_cols", F.coalesce("read_cols", empty)).withColumn("write_cols", F.sort_array(F.array_union(F.coalesce("writes", empty), F.coalesce("more_writes", empty)))).drop("writes", "more_writes", "tname")
    out = out.withColumn("table_key", F.concat_ws(".", "schema", "table"))
    extra = bind.groupBy(*stmt).agg(F.sort_array(F.collect_set(F.lower(F.concat_ws(".", "qualifier", "column")))).alias("more_binds"))
    open_ = unattributed.groupBy(*stmt).agg(F.sort_array(F.collect_set("column")).alias("unresolved_columns"))
    sql = facts.table("sql").withColumnRenamed("seq", "stmt").join(extra, stmt, "left").join(open_, stmt, "left")
    sql = sql.withColumn("binds", F.array_distinct(F.concat(F.coalesce("binds", empty), F.coalesce("more_binds", empty)))).drop("more_binds").withColumn("unresolved_columns", F.coalesce("unresolved_columns", empty))
    kinds = unit.select("file", "variant", "unit", F.col("kind").alias("unit_kind"))
    context = F.when(F.col("dynamic"), "DYNAMIC").when(F.col("routine") >= 0, "BODY").when(F.col("unit_kind") == "TRIGGER", "TRIGGER").when(F.col("unit_kind") == "ANONYMOUS_BLOCK", "ANONYMOUS_BLOCK").otherwise("PACKAGE_LEVEL")
    sql = sql.join(kinds, ["file", "variant", "unit"]).withColumn("context", context).drop("unit_kind")
    return owned(out, owner), owned(sql, owner)


def joins(facts: Facts, refs: DataFrame, owner: DataFrame) -> DataFrame:
    """Equalities between columns of two tables of one statement: (owner_id, stmt, left_table, left_column, right_table,
    right_column), each once. Natural joins, USING and joins of a table with itself give none."""
    stmt = [*OWNER, "stmt"]
    j = facts.table("join").withColumn("n", F.monotonically_increasing_id())
    names = refs.select(*stmt, F.col("scope").alias("r_scope"), F.lower("alias").alias("r_alias"), F.lower("table").alias("tname"), "table_key")

    def side(rows: DataFrame, q: str, out: str) -> DataFrame:
        hit = rows.join(names, stmt).where(F.startswith(F.col("scope"), F.col("r_scope")) & ((F.col("r_alias") == F.col(q)) | (F.col("tname") == F.col(q))))
        w = Window.partitionBy("n").orderBy(F.when(F.col("r_alias") == F.col(q), 0).otherwise(1), F.desc(F.length("r_scope")), "table_key")
        return hit.withColumn("nth", F.row_number().over(w)).where("nth = 1").withColumn(out, F.upper("table_key")).drop("r_scope", "r_alias", "tname", "table_key", "nth")

    j = stash(j, "joins")  # the number of a row must stay
    both = side(side(j, "lq", "left_table"), "rq", "right_table").where("left_table <> right_table")
    return owned(both, owner).select("owner_id", *stmt, "left_table", F.upper("lc").alias("left_column"), "right_table", F.upper("rc").alias("right_column"), "dynamic").distinct()
