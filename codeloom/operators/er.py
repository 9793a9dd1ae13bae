"""Entities and relations: declared by DDL, or inferred from joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators import graph
from codeloom.operators.resolve import OWNER
from codeloom.sources.files import stash


def definitions(table_def: DataFrame, table_col: DataFrame, table_key: DataFrame, table_fk: DataFrame) -> dict[str, DataFrame]:
    """Definitions of one table put together: columns, one primary key (the first), unique and foreign keys."""
    d = table_def.where("variant = 'primary'").select("file", "def", F.upper(F.concat_ws(".", "schema", "name")).alias("table_key"), F.upper("name").alias("bare"), "line", "alter_only")
    key = ["file", "def"]
    drop = lambda df: df.where("variant = 'primary'").drop("variant")
    cols = drop(table_col).join(d.select(*key, "table_key"), key).groupBy("table_key", "name").agg(F.min_by("type", F.struct("file", "def", "seq")).alias("type"), F.max("not_null").alias("not_null"), F.min(F.struct("file", "def", "seq")).alias("at"))
    keys = drop(table_key).join(d.select(*key, "table_key", "alter_only"), key)
    pk = keys.where("kind = 'PRIMARY'").groupBy("table_key").agg(F.min_by("cols", F.struct("alter_only", "file", "def", "key")).alias("pk"))
    uk = keys.where("kind = 'UNIQUE'").groupBy("table_key").agg(F.collect_set("cols").alias("uniques"))
    fk = drop(table_fk).join(d.select(*key, "table_key"), key).select("table_key", "name", "cols", "parent", "parent_cols", "on_delete").dropDuplicates(["table_key", "cols", "parent"])
    return {"entity": d.groupBy("table_key", "bare").agg(F.min("file").alias("file"), F.min("line").alias("line")), "col": cols, "pk": pk, "uk": uk, "fk": fk}


def resolve_names(names: DataFrame, entities: DataFrame) -> DataFrame:
    """(name, entity): the entity of that key, else the only one with that bare name, else the name itself."""
    n = names.select("name").distinct().withColumn("bare", F.element_at(F.split("name", r"\."), -1))
    one = entities.groupBy("bare").agg(F.count("*").alias("m"), F.min("table_key").alias("only")).where("m = 1").select("bare", "only")
    exact = entities.select(F.col("table_key").alias("name"), F.col("table_key").alias("exact"))
    hit = n.join(exact, "name", "left").join(one, "bare", "left")
    # a name with a schema answers to a bare definition, and a bare name to a definition with one; two schemas differ
    fits = (F.instr("name", ".") == 0) | (F.instr("only", ".") == 0)
    return hit.select("name", F.coalesce("exact", F.when(fits, F.col("only")), "name").alias("entity"))


def model(defs: dict[str, DataFrame], ref: DataFrame, join: DataFrame) -> dict[str, DataFrame]:
    """entity, col, relation and cluster tables.

    A foreign key is one-to-one if its columns are, as a set, the child's primary or a unique key; required if all are
    NOT NULL or in the primary key. Joins of one statement between two tables are one inferred relation, from the table
    whose columns are no key to the one whose are; it is left out where a declared one links the two in either direction.
    """
    use = ref.where("link is null").withColumn("name", F.upper("table_key"))
    names = use.select("name").union(defs["fk"].select(F.col("parent").alias("name"))).union(join.select(F.col("left_table").alias("name"))).union(join.select(F.col("right_table").alias("name")))
    # each step is kept as a table: in one plan the parts below a relation would be planned again for each of its joins
    defs = {k: stash(v, f"def-{k}") for k, v in defs.items()}
    resolved = stash(resolve_names(names, defs["entity"]), "resolved")
    use = use.join(resolved, "name")
    write = F.size(F.array_except("access", F.array(F.lit("READ"), F.lit("LOCK")))) > 0
    usage = use.groupBy(F.col("entity").alias("table_key")).agg(F.sort_array(F.collect_set(F.when(F.arrays_overlap("access", F.array(F.lit("READ"), F.lit("LOCK"))), F.col("owner_id")))).alias("read_by"), F.sort_array(F.collect_set(F.when(write, F.col("owner_id")))).alias("written_by"))
    keys = defs["entity"].select("table_key", F.lit(True).alias("in_ddl")).join(defs["pk"], "table_key", "left").join(defs["uk"], "table_key", "left")
    seen = resolved.select(F.col("entity").alias("table_key")).distinct()
    none = F.array().cast("array<string>")
    entity = keys.join(seen, "table_key", "full_outer").join(usage, "table_key", "left").select("table_key", F.coalesce("in_ddl", F.lit(False)).alias("in_ddl"), F.coalesce("pk", none).alias("pk"), F.coalesce("uniques", F.array().cast("array<array<string>>")).alias("uniques"), F.coalesce("read_by", none).alias("read_by"), F.coalesce("written_by", none).alias("written_by"))
    entity = stash(entity, "entity")
    read = use.select(F.col("entity").alias("table_key"), F.explode("read_cols").alias("name")).distinct().withColumn("is_read", F.lit(True))
    written = use.select(F.col("entity").alias("table_key"), F.explode("write_cols").alias("name")).where("name <> '*'").distinct().withColumn("is_written", F.lit(True))
    fk_cols = defs["fk"].select("table_key", F.explode("cols").alias("name")).distinct().withColumn("is_fk", F.lit(True))
    declared_cols = defs["col"].withColumn("in_ddl", F.lit(True))
    col = declared_cols.join(read, ["table_key", "name"], "full_outer").join(written, ["table_key", "name"], "full_outer").join(fk_cols, ["table_key", "name"], "left").join(entity.select("table_key", "pk", "uniques"), "table_key", "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    col = col.select("table_key", "name", "type", flag(F.col("not_null")).alias("not_null"), flag(F.array_contains("pk", F.col("name"))).alias("is_pk"), flag(F.col("is_fk")).alias("is_fk"), flag(F.exists("uniques", lambda u: F.array_contains(u, F.col("name")))).alias("is_unique"), flag(F.col("in_ddl")).alias("in_ddl"), flag(F.col("is_read")).alias("is_read"), flag(F.col("is_written")).alias("is_written"), "at")
    col = stash(col, "col")
    # declared
    child_keys = entity.select("table_key", F.col("pk").alias("c_pk"), F.col("uniques").alias("c_uniques"))
    parent_keys = entity.select(F.col("table_key").alias("to"), F.col("pk").alias("p_pk"))
    required = defs["fk"].select("table_key", "cols", "parent", F.explode("cols").alias("name")).join(col.select("table_key", "name", (F.col("not_null") | F.col("is_pk")).alias("must")), ["table_key", "name"], "left").groupBy("table_key", "cols", "parent").agg(F.min(flag(F.col("must"))).alias("required"))
    d = defs["fk"].join(required, ["table_key", "cols", "parent"], "left").join(resolved.toDF("parent", "to"), "parent").join(child_keys, "table_key", "left").join(parent_keys, "to", "left")
    same = lambda a, b: F.sort_array(a) == F.sort_array(b)
    one = same(F.col("cols"), F.col("c_pk")) | F.exists("c_uniques", lambda u: same(u, F.col("cols")))
    declared = d.select(F.col("table_key").alias("src"), F.col("to").alias("dst"), "cols", F.when(F.size("parent_cols") > 0, F.col("parent_cols")).otherwise(F.coalesce("p_pk", none)).alias("to_cols"), F.lit("DECLARED").alias("origin"), F.when(flag(one), "ONE_TO_ONE").otherwise("MANY_TO_ONE").alias("cardinality"), "required", F.lit(1).cast("long").alias("weight"), F.array(F.coalesce("name", F.lit("foreign key"))).alias("evidence"))
    declared = stash(declared, "declared")
    # inferred
    j = join.join(resolved.toDF("left_table", "l"), "left_table").join(resolved.toDF("right_table", "r"), "right_table").where("l <> r")
    flip = F.col("l") > F.col("r")
    j = j.select("owner_id", *OWNER, "stmt", F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b"), F.when(flip, F.col("right_column")).otherwise(F.col("left_column")).alias("ca"), F.when(flip, F.col("left_column")).otherwise(F.col("right_column")).alias("cb")).distinct()
    g = j.groupBy("owner_id", *OWNER, "stmt", "a", "b").agg(F.sort_array(F.collect_set(F.struct("ca", "cb"))).alias("on"))
    ka, kb = entity.select(F.col("table_key").alias("a"), F.col("pk").alias("a_pk"), F.col("uniques").alias("a_uk")), entity.select(F.col("table_key").alias("b"), F.col("pk").alias("b_pk"), F.col("uniques").alias("b_uk"))
    g = g.join(ka, "a").join(kb, "b").withColumn("cols_a", F.transform("on", lambda x: x["ca"])).withColumn("cols_b", F.transform("on", lambda x: x["cb"]))
    is_key = lambda cols, pk, uk: flag(same(F.col(cols), F.col(pk)) & (F.size(pk) > 0)) | F.exists(uk, lambda u: same(u, F.col(cols)))
    g = g.withColumn("a_key", is_key("cols_a", "a_pk", "a_uk")).withColumn("b_key", is_key("cols_b", "b_pk", "b_uk"))
    up = F.col("b_key") | ~F.col("a_key")  # the child is a
    out = g.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("src"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("dst"), F.when(up, F.col("cols_a")).otherwise(F.col("cols_b")).alias("cols"), F.when(up, F.col("cols_b")).otherwise(F.col("cols_a")).alias("to_cols"), F.when(F.col("a_key") & F.col("b_key"), "ONE_TO_ONE").when(F.col("a_key") | F.col("b_key"), "MANY_TO_ONE").otherwise("UNKNOWN").alias("cardinality"), F.concat("owner_id", F.lit(" statement "), F.col("stmt").cast("string")).alias("seen"))
    inferred = out.groupBy("src", "dst", "cols", "to_cols", "cardinality").agg(F.countDistinct("seen").alias("weight"), F.slice(F.sort_array(F.collect_set("seen")), 1, 6).alias("evidence"))
    linked = declared.select("src", "dst").union(declared.select("dst", "src")).distinct()
    inferred = inferred.join(linked, ["src", "dst"], "left_anti").select("src", "dst", "cols", "to_cols", F.lit("INFERRED").alias("origin"), "cardinality", F.lit(False).alias("required"), "weight", "evidence")
    relation = stash(declared.unionByName(inferred), "relation")
    return {"entity": entity, "col": col, "relation": relation}


def clusters(entity: DataFrame, relation: DataFrame) -> DataFrame:
    """(cluster, members, size): connected components of entities and relations."""
    c = graph.components(relation.select("src", "dst"), entity.select(F.col("table_key").alias("node")))
    g = c.groupBy("component").agg(F.sort_array(F.collect_list("node")).alias("members"), F.count("*").alias("size"))
    return g.select(F.col("component").alias("cluster"), "members", "size")


def explanations(m: dict[str, DataFrame]) -> list[str]:
    """Sentences about the model, from counts."""
    e = m["entity"].agg(F.count("*").alias("n"), F.sum((~F.col("in_ddl")).cast("int")).alias("unknown"), F.sum((F.size("pk") == 0).cast("int")).alias("keyless")).first()
    r = {x["origin"]: x["n"] for x in m["relation"].groupBy("origin").agg(F.count("*").alias("n")).collect()}
    out = []
    if e["unknown"]:
        out.append(f"{e['unknown']} of {e['n']} tables are known from their use only.")
    if e["keyless"]:
        out.append(f"{e['keyless']} tables have no primary key here, so relations to them cannot be told apart by key.")
    if r.get("INFERRED"):
        out.append(f"{r['INFERRED']} relations are inferred from joins and not declared.")
    return out


GLYPHS = {"MANY_TO_ONE": "}o--||", "ONE_TO_ONE": "|o--||", "UNKNOWN": "}o--o{"}


def mermaid(m: dict[str, DataFrame], most_columns: int = 30) -> str:
    """The diagram as text; names are made safe and unique. A diagram is for reading, so it is made on the driver."""
    from codeloom.functions.text import mermaid_name

    w = Window.partitionBy("safe").orderBy("table_key")
    names = m["entity"].select("table_key", mermaid_name(F.col("table_key")).alias("safe")).withColumn("nth", F.row_number().over(w))
    names = names.select("table_key", F.concat("safe", F.when(F.col("nth") > 1, F.concat(F.lit("_"), F.col("nth").cast("string"))).otherwise("")).alias("safe"))
    by = Window.partitionBy("table_key").orderBy(F.col("at").isNull(), "at", "name")
    cols = m["col"].withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= most_columns).orderBy("table_key", "nth")
    at = {r["table_key"]: r["safe"] for r in names.orderBy("table_key").collect()}
    out, inside = ["erDiagram"], {}
    for r in cols.collect():
        kind = "".join(ch if ch.isalnum() else "_" for ch in (r["type"] or "unknown")).strip("_") or "unknown"
        marks = ",".join(k for k, on in (("PK", r["is_pk"]), ("FK", r["is_fk"]), ("UK", r["is_unique"] and not r["is_pk"])) if on)
        inside.setdefault(r["table_key"], []).append(f"    {kind} {''.join(ch if ch.isalnum() or ch == '_' else '_' for ch in r['name'])} {marks}".rstrip())
    for key, safe in at.items():
        out += [f"  {safe} {{", *inside.get(key, []), "  }"]
    for r in m["relation"].orderBy("src", "dst", "cols").collect():
        out.append(f'  {at[r["src"]]} {GLYPHS[r["cardinality"]]} {at[r["dst"]]} : "{", ".join(r["cols"])}{"" if r["origin"] == "DECLARED" else " (inferred)"}"')
    return "\n".join(out) + "\n"
