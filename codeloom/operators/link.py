"""Linking of specifications and bodies, and the names by which everything is known afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import ident
from codeloom.sources.files import Facts, stash

KEY = ["file", "variant", "unit", "rid"]


def signature_key(prefix: str = "") -> F.Column:
    """Kind, name and parameter types; spaces and case do not count."""
    types = F.transform(F.col(prefix + "params"), lambda p: F.regexp_replace(F.lower(F.concat_ws(" ", p["mode"], p["type"])), r"\s+", ""))
    return F.concat_ws("|", F.lower(prefix + "kind"), ident(F.col(prefix + "name")), F.array_join(types, ","), F.regexp_replace(F.lower(F.coalesce(prefix + "return_type", F.lit(""))), r"\s+", ""))


def arity_key() -> F.Column:
    return F.concat_ws("|", F.lower("kind"), ident(F.col("name")), F.size("params"))


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with ``nth``: 1 for the first of each key in the given order."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def units(facts: Facts) -> DataFrame:
    """Units with their key, their id as an owner of code, and ``nth`` among units of one kind and key."""
    u = facts.table("unit").withColumn("ukey", F.lower("name"))
    u = first_wins(u, ["variant", "kind", "ukey"], ["file", "unit"])
    up = F.upper("name")
    owner = F.when(F.col("kind") == "TRIGGER", F.concat(F.lit("TRIGGER:"), up)).when(F.col("kind") == "ANONYMOUS_BLOCK", F.concat(F.col("name"), F.lit(":"), F.col("file"))).when(F.col("kind").startswith("PACKAGE"), F.concat(up, F.lit(".<init>"))).otherwise(up)
    return u.withColumn("block_id", owner)


def match(spec: DataFrame, body: DataFrame) -> DataFrame:
    """Pairs (spec key, body key) of the routines of one package: by exact signature, then by name and number of
    parameters where just one body is left."""
    w = Window.partitionBy("ukey", "sig").orderBy("rid")
    s, b = (x.withColumn("nth", F.row_number().over(w)) for x in (spec, body))
    left = s.select("ukey", "sig", "nth", *(F.col(k).alias(f"s_{k}") for k in KEY))
    right = b.select("ukey", "sig", "nth", *(F.col(k).alias(f"b_{k}") for k in KEY))
    exact = left.join(right, ["ukey", "sig", "nth"]).select(*(f"s_{k}" for k in KEY), *(f"b_{k}" for k in KEY), F.lit("signature").alias("by"))
    exact = stash(exact, "match")
    rest_s = spec.join(exact.select(*(F.col(f"s_{k}").alias(k) for k in KEY)), KEY, "left_anti")
    rest_b = body.join(exact.select(*(F.col(f"b_{k}").alias(k) for k in KEY)), KEY, "left_anti")
    v = Window.partitionBy("ukey", "arity")
    rest_s = rest_s.withColumn("nth", F.row_number().over(v.orderBy("rid"))).where("nth = 1")
    rest_b = rest_b.withColumn("n", F.count("*").over(v)).where("n = 1")
    loose = rest_s.select("ukey", "arity", *(F.col(k).alias(f"s_{k}") for k in KEY)).join(rest_b.select("ukey", "arity", *(F.col(k).alias(f"b_{k}") for k in KEY)), ["ukey", "arity"])
    return exact.unionByName(loose.select(*(f"s_{k}" for k in KEY), *(f"b_{k}" for k in KEY), F.lit("name and number of parameters").alias("by")))


def routines(facts: Facts, unit: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(routine, owner_of): routines with ids, one row for specification and body together; and for every parsed
    routine, forward declarations and merged specifications included, the id that stands for it."""
    u = unit.select("file", "variant", "unit", F.col("kind").alias("unit_kind"), "ukey", F.upper("name").alias("unit_name"), "block_id", F.col("nth").alias("unit_nth"), F.col("line").alias("unit_line"))
    r = facts.table("routine").join(u, ["file", "variant", "unit"]).withColumn("sig", signature_key()).withColumn("arity", arity_key())
    r = stash(r.withColumn("low", ident(F.col("name"))), "parsed")
    top = r.where("parent = -1 and variant = 'primary'")
    spec = top.where("unit_kind = 'PACKAGE_SPEC' and unit_nth = 1")
    body = top.where("unit_kind = 'PACKAGE_BODY' and not forward and unit_nth = 1")
    pairs = stash(match(spec, body), "pairs")
    matched_spec = pairs.select(*(F.col(f"s_{k}").alias(k) for k in KEY), *(f"b_{k}" for k in KEY))
    to_body = pairs.select(*(F.col(f"b_{k}").alias(k) for k in KEY), F.col("s_file").alias("spec_file"), F.col("s_rid").alias("spec_rid"), F.col("s_unit").alias("spec_unit"), "by")
    spec_lines = spec.select(F.col("file").alias("spec_file"), F.col("unit").alias("spec_unit"), F.col("rid").alias("spec_rid"), F.col("line").alias("spec_line"), F.col("docs").alias("spec_docs"))
    has_spec = spec.select("ukey").union(unit.where("kind = 'PACKAGE_SPEC' and variant = 'primary'").select("ukey")).distinct().withColumn("spec_known", F.lit(True))
    has_body = unit.where("kind = 'PACKAGE_BODY' and variant = 'primary'").select("ukey").distinct().withColumn("body_known", F.lit(True))
    own = r.where("not forward or unit_kind = 'PACKAGE_SPEC'").join(matched_spec.select(*KEY), KEY, "left_anti")
    own = own.join(to_body, KEY, "left").join(spec_lines, ["spec_file", "spec_unit", "spec_rid"], "left").join(has_spec, "ukey", "left").join(has_body, "ukey", "left")
    # ids from the outside in; the depth of nesting is small
    own = own.withColumn("container", F.when(F.col("unit_kind").startswith("PACKAGE"), F.col("unit_name")).when(F.col("unit_kind").isin("TRIGGER", "ANONYMOUS_BLOCK"), F.col("block_id")))
    own = stash(own, "routines")
    deepest = own.agg(F.max("depth")).first()[0] or 0
    numbered = Window.partitionBy("variant", "prefix", "low")
    ids = None
    for d in range(deepest + 1):
        level = own.where(F.col("depth") == d)
        if d == 0:
            level = level.withColumn("prefix", F.when(F.col("container").isNull(), F.lit("")).when(F.col("unit_kind").startswith("PACKAGE"), F.concat("container", F.lit("."))).otherwise(F.concat("container", F.lit(">"))))
        else:
            above = ids.select("file", "variant", "unit", F.col("rid").alias("parent"), F.concat("id", F.lit(">")).alias("prefix"))
            level = level.join(above, ["file", "variant", "unit", "parent"])
        n = F.row_number().over(numbered.orderBy(F.when(F.col("has_body"), 0).otherwise(1), "file", "unit", "rid"))
        level = level.withColumn("id", F.concat("prefix", F.upper("low"), F.when(F.count("*").over(numbered) > 1, F.concat(F.lit("#"), n.cast("string"))).otherwise("")))
        ids = level if ids is None else ids.unionByName(level)
    ids = ids.withColumn("owner", F.when(F.col("unit_kind").startswith("PACKAGE"), F.col("unit_name")))
    visibility = (
        F.when(F.col("depth") > 0, "LOCAL").when(F.col("unit_kind").isin("TRIGGER", "ANONYMOUS_BLOCK"), "LOCAL").when(F.col("container").isNull(), "STANDALONE")
        .when(F.col("unit_kind") == "PACKAGE_SPEC", "PUBLIC").when(F.col("spec_rid").isNotNull(), "PUBLIC").when(F.col("spec_known"), "PRIVATE").otherwise("UNKNOWN")
    )
    note = F.when(F.col("by") == "name and number of parameters", "linked by name and number of parameters").when((F.col("unit_kind") == "PACKAGE_SPEC") & F.col("body_known") & ~F.col("call_spec"), "declared, not implemented").when(F.col("unit_kind") == "PACKAGE_SPEC", "declared only")
    out = stash(ids.withColumn("visibility", visibility).withColumn("link_note", note), "ids")
    known = out.select(*KEY, "id")
    merged = matched_spec.join(known.toDF(*(f"b_{k}" for k in KEY), "id"), [f"b_{k}" for k in KEY]).select(*KEY, "id")
    # a forward declaration stands for the definition of the same parent with the same signature
    forward = r.where("forward and unit_kind <> 'PACKAGE_SPEC'").select(*KEY, "parent", "sig")
    defined = out.select("file", "variant", "unit", "parent", "sig", "id").groupBy("file", "variant", "unit", "parent", "sig").agg(F.min("id").alias("id"))
    forwarded = forward.join(defined, ["file", "variant", "unit", "parent", "sig"]).select(*KEY, "id")
    return out, stash(known.unionByName(merged).unionByName(forwarded), "owners")


def alternates(routine: DataFrame) -> DataFrame:
    """Routines that only the alternate variant has, with ``~ALT`` ids (numbered where several share one)."""
    keys = ["file", "unit_kind", "ukey", "depth", "sig"]
    only = routine.where("variant = 'alternate'").join(routine.where("variant = 'primary'").select(*keys).distinct(), keys, "left_anti")
    w = Window.partitionBy("id0")
    only = only.withColumn("id0", F.concat(F.regexp_replace("id", r"#\d+$", ""), F.lit("~ALT")))
    n = F.row_number().over(w.orderBy("file", "unit", "rid"))
    return only.withColumn("id", F.concat("id0", F.when(F.count("*").over(w) > 1, F.concat(F.lit("#"), n.cast("string"))).otherwise(""))).drop("id0")


def issues(facts: Facts, unit: DataFrame, routine: DataFrame, owner_of: DataFrame) -> DataFrame:
    """Rows (severity, code, message, file, line) of linking, parsing and conditions."""
    row = lambda df, severity, code, message: df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), message.alias("message"), "file", "line")
    p = unit.where("variant = 'primary'")
    spec, body = p.where("kind = 'PACKAGE_SPEC' and nth = 1"), p.where("kind = 'PACKAGE_BODY' and nth = 1")
    errors = first_wins(facts.table("error").where("variant = 'primary'"), ["file"], ["line", "col"]).where("nth <= 10")
    both = spec.select("ukey", F.col("file").alias("sf"), F.col("line").alias("sl"), F.col("name").alias("sn")).join(body.select("ukey", F.col("file").alias("bf"), F.col("line").alias("bl"), F.col("name").alias("bn")), "ukey", "full_outer")
    forward = facts.table("routine").where("forward and variant = 'primary'").join(unit.where("kind <> 'PACKAGE_SPEC'").select("file", "variant", "unit"), ["file", "variant", "unit"]).join(owner_of.select(*KEY), KEY, "left_anti")
    undecided = facts.table("file").where("variant = 'primary'").select("file", F.explode(F.filter("conditions", lambda c: ~c["decided"])).alias("c")).select("file", "c.line", "c.text")
    out = row(errors, "ERROR", "syntax-error", F.concat_ws(": ", F.concat(F.lit("column "), "col"), "message"))
    for more in (
        row(undecided, "INFO", "undecided-conditional-compilation", F.concat(F.lit("both branches are analysed: "), "text")),
        row(facts.table("condition_issue").where("variant = 'primary'"), "WARN", "conditional-compilation", F.col("message")),
        row(p.where("kind = 'PACKAGE_SPEC' and nth > 1"), "WARN", "duplicate-package-spec", F.concat(F.col("name"), F.lit(" is specified again"))),
        row(p.where("kind = 'PACKAGE_BODY' and nth > 1"), "WARN", "duplicate-package-body", F.concat(F.col("name"), F.lit(" has another body"))),
        both.where("bf is null and sf is not null").select(F.lit("WARN").alias("severity"), F.lit("spec-without-body").alias("code"), F.concat("sn", F.lit(" has no body here")).alias("message"), F.col("sf").alias("file"), F.col("sl").alias("line")),
        both.where("sf is null").select(F.lit("WARN").alias("severity"), F.lit("body-without-spec").alias("code"), F.concat("bn", F.lit(" has no specification here")).alias("message"), F.col("bf").alias("file"), F.col("bl").alias("line")),
        row(forward, "WARN", "forward-without-definition", F.concat("name", F.lit(" is declared ahead and never defined"))),
        row(routine.where("variant = 'primary' and unit_kind = 'PACKAGE_SPEC' and body_known and not call_spec"), "ERROR", "spec-routine-without-body", F.concat("id", F.lit(" is not in the body"))),
    ):
        out = out.unionByName(more)
    return out
