"""Dependencies between files, and the order to read them in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.graph import batches, dfs_order, ranks, recursion_groups

EVIDENCE = 6
#: Files whose order is found on the driver; beyond it the order is by batches (see ``reading_order``).
DRIVER_FILES = 200_000


def evidence(c: F.Column) -> F.Column:
    return F.slice(F.sort_array(F.collect_set(c)), 1, EVIDENCE)


def file_edges(edge: DataFrame, node: DataFrame, unit: DataFrame, ref: DataFrame, table_def: DataFrame) -> DataFrame:
    """(src, dst, type, count, evidence) of files that need others.

    CALLS: a routine of src calls one of dst. SPEC_BODY: a body needs its specification. NEEDS_DDL: src uses a table
    that dst creates. Files that merely share a table are in ``shared_tables``: pairs, of which there are far more.
    """
    place = node.where("type in ('ROUTINE', 'UNIT_BLOCK')").select("id", "file")
    c = edge.where("type = 'CALLS'").join(place.toDF("src", "sf"), "src").join(place.toDF("dst", "df"), "dst").where("sf <> df")
    calls = c.groupBy(F.col("sf").alias("src"), F.col("df").alias("dst")).agg(F.lit("CALLS").alias("type"), F.sum(F.greatest("count", F.lit(1))).alias("count"), evidence(F.concat("src", F.lit(" -> "), "dst")).alias("evidence"))
    p = unit.where("variant = 'primary'")
    s, b = p.where("kind = 'PACKAGE_SPEC'"), p.where("kind = 'PACKAGE_BODY'")
    sb = b.select("ukey", F.col("file").alias("src"), F.upper("name").alias("what")).join(s.select("ukey", F.col("file").alias("dst")), "ukey").where("src <> dst")
    spec_body = sb.groupBy("src", "dst").agg(F.lit("SPEC_BODY").alias("type"), F.countDistinct("what").alias("count"), evidence(F.col("what")).alias("evidence"))
    use = table_use(ref)
    defs = table_def.where("not alter_only").select(F.upper(F.concat_ws(".", "schema", "name")).alias("d_key"), F.upper("name").alias("bare"), F.col("file").alias("dst")).distinct()
    exact = use.join(defs.select("d_key", "dst"), use["key"] == F.col("d_key")).select("file", "key", "dst")
    loose = use.join(exact.select("key").distinct(), "key", "left_anti").join(defs.select("bare", "dst"), "bare").select("file", "key", "dst")
    needs = exact.unionByName(loose).where("file <> dst").groupBy(F.col("file").alias("src"), "dst").agg(F.lit("NEEDS_DDL").alias("type"), F.countDistinct("key").alias("count"), evidence(F.col("key")).alias("evidence"))
    return calls.unionByName(spec_body).unionByName(needs)


def table_use(ref: DataFrame) -> DataFrame:
    """Tables that files touch: (file, key, bare, w), w if one of its statements writes."""
    write = F.size(F.array_except("access", F.array(F.lit("READ"), F.lit("LOCK")))) > 0
    use = ref.where("link is null").select("file", F.upper("table_key").alias("key"), F.upper("table").alias("bare"), write.alias("w"))
    return use.groupBy("file", "key", "bare").agg(F.max("w").alias("w"))


def shared_tables(use: DataFrame) -> DataFrame:
    """SHARED_TABLE edges: pairs of files over each table that at least one of them writes, from rows (file, key, w);
    src is the lesser name, count the number of tables. The result is pairs by definition, so it is made only when asked
    for."""
    written = use.where("w").select("key").distinct()
    u = use.join(written, "key", "left_semi")
    # a pair needs a writer, so one side is always taken from the writers, which are few
    w = u.where("w").select("key", F.col("file").alias("a"))
    pair = w.join(u.select("key", F.col("file").alias("b")), "key").where("a <> b").select("key", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()
    return pair.groupBy("src", "dst").agg(F.lit("SHARED_TABLE").alias("type"), F.count("*").alias("count"), evidence(F.col("key")).alias("evidence"))


def shared_with(use: DataFrame, file: str) -> DataFrame:
    """SHARED_TABLE edges of one file: (file, count, evidence) of the others that use its tables, at least one writing."""
    own = use.where(F.col("file") == file).select("key", F.col("w").alias("own_w"))
    other = use.where(F.col("file") != file).join(F.broadcast(own), "key").where("w or own_w")  # the tables of one file
    return other.groupBy("file").agg(F.count("*").alias("count"), evidence(F.col("key")).alias("evidence"))


def file_nodes(file: DataFrame, unit: DataFrame, routine: DataFrame, edges: DataFrame) -> DataFrame:
    p = file.where("variant = 'primary'").select("file")
    units = unit.where("variant = 'primary'").groupBy("file").agg(F.sort_array(F.collect_set(F.concat("kind", F.lit(" "), F.upper("name")))).alias("units"))
    count = routine.where("variant = 'primary'").groupBy("file").agg(F.count("*").alias("routines"))
    needed = edges.where("type <> 'SHARED_TABLE'")
    out = needed.groupBy(F.col("src").alias("file")).agg(F.sort_array(F.collect_set("dst")).alias("depends_on"))
    into = needed.groupBy(F.col("dst").alias("file")).agg(F.sort_array(F.collect_set("src")).alias("used_by"))
    none = F.array().cast("array<string>")
    joined = p.join(units, "file", "left").join(count, "file", "left").join(out, "file", "left").join(into, "file", "left")
    return joined.select("file", F.coalesce("units", none).alias("units"), F.coalesce("routines", F.lit(0)).cast("long").alias("routines"), F.coalesce("depends_on", none).alias("depends_on"), F.coalesce("used_by", none).alias("used_by"))


def reading_order(nodes: DataFrame, edges: DataFrame, driver_files: int = DRIVER_FILES) -> tuple[DataFrame, DataFrame]:
    """((position, file), (members)): files so that what a file needs comes before it, and the cycles among them.

    A depth-first order is sequential by nature, so a *file* graph of up to ``driver_files`` files and ten times as many
    edges is ordered on the driver, names deciding ties, and its cycles are those met on the way. A larger one is ordered
    by batches: first the files that need nothing outside their own cycle, by name, then those that need these only.
    """
    spark = nodes.sparkSession
    pairs = edges.where("type <> 'SHARED_TABLE'").select("src", "dst").distinct()
    files = [r["file"] for r in nodes.select("file").orderBy("file").limit(driver_files + 1).collect()]
    if len(files) <= driver_files:
        found = [(r["src"], r["dst"]) for r in pairs.limit(10 * driver_files + 1).collect()]
        if len(found) <= 10 * driver_files:
            order, cycles = dfs_order(files, found)
            return spark.createDataFrame([(k, f) for k, f in enumerate(order, 1)], "position long, file string"), spark.createDataFrame([(c,) for c in cycles], "members array<string>")
    known = nodes.select(F.col("file").alias("node"))
    inside = pairs.join(known.toDF("src"), "src", "left_semi").join(known.toDF("dst"), "dst", "left_semi")
    order = ranks(batches(inside, known))
    return order.select(F.col("rank").cast("long").alias("position"), F.col("node").alias("file")), recursion_groups(inside, known).where("size(members) > 1").select("members")
