"""Program files as a DataFrame (file, content, text), and the facts that parsing gives."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from codeloom.functions import text as T

#: Extensions of program files, and folders that hold none.
EXTENSIONS = ("sql", "pks", "pkb", "pkg", "fnc", "prc", "trg", "vw", "typ", "tps", "tpb", "plsql")
LEFT_OUT = (".agentdocs", ".git", "node_modules", "target", "corpus-out")


def scan(spark: SparkSession, root: str, left_out: Sequence[str] = LEFT_OUT) -> DataFrame:
    """A folder, recursively: files of known extensions, none below a left-out folder. A file: itself, whatever its name."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.col("path")
    single = F.regexp_replace(path, r"^file:/*", "/") == F.regexp_replace(F.lit(root), r"^file:/*", "/")
    kept = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*EXTENSIONS) & ~F.arrays_overlap(F.split(path, "/"), F.lit(list(left_out)))
    return found.where(single | kept)


def read(spark: SparkSession, roots: Sequence[str], left_out: Sequence[str] = LEFT_OUT) -> DataFrame:
    """Rows (file, content, size, modified, text) of all inputs, each file once. Without any file: an error."""
    if not roots:
        raise ValueError("no input")
    every = scan(spark, roots[0], left_out)
    for root in roots[1:]:
        every = every.unionByName(scan(spark, root, left_out))
    every = every.dropDuplicates(["path"])
    if every.isEmpty():
        raise FileNotFoundError(f"no program files in {', '.join(roots)}; looked for {', '.join(EXTENSIONS)}")
    base = roots[0].rstrip("/") if len(roots) == 1 else ""
    name = F.regexp_replace(F.col("path"), r"^file:/*", "/")
    if base:
        start = "/" + base.split(":", 1)[-1].lstrip("/") + "/"
        name = F.when(F.startswith(name, F.lit(start)), F.substr(name, F.lit(len(start) + 1))).otherwise(F.regexp_extract(name, r"([^/]+)$", 1))
    return every.select(name.alias("file"), "content", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), T.decode(F.col("content")).alias("text"))


PARAMS = "array<struct<name:string,mode:string,type:string,default_text:string,line:int>>"
#: Fact tables and their columns; (file, variant) come first in each.
TABLES = {
    "file": "n_lines int, n_errors int, conditions array<struct<line:int,text:string,decided:boolean,value:boolean>>",
    "source": "text string, masked string",
    "error": "line int, col int, message string",
    "condition_issue": "line int, message string",
    "unit": "unit int, kind string, schema string, name string, line int, end_line int, authid string, trigger_header string, docs array<string>, has_init boolean, init_line int",
    "routine": f"unit int, rid int, parent int, depth int, kind string, name string, forward boolean, has_body boolean, call_spec boolean, params {PARAMS}, return_type string, attributes array<string>, line int, end_line int, body_line int, signature string, docs array<string>, header_docs array<string>",
    "decl": f"unit int, routine int, kind string, name string, type string, is_const boolean, not_null boolean, default_text string, type_kind string, definition string, fields array<struct<name:string,type:string>>, params {PARAMS}, query string, error_code int, line int, end_line int",
    "exception_init": "unit int, routine int, name string, code int",
    "sql": "unit int, routine int, seq int, kind string, context string, line int, end_line int, offset int, text string, binds array<string>, into array<string>, for_update boolean, bulk boolean, bulk_into boolean, in_loop boolean, dynamic boolean, dynamic_confidence string, dynamic_expression string, dynamic_kind string, concatenated boolean, asserted boolean, hint boolean, step array<int>, ctes array<string>, aliases array<string>",
    "ref": "unit int, routine int, stmt int, ref int, schema string, table string, link string, alias string, access array<string>, writes array<string>, scope string, confidence string",
    "use": "unit int, routine int, stmt int, seq int, qualifier string, column string, first string, role string, scope string",
    "join": "unit int, routine int, stmt int, lq string, lc string, rq string, rc string, scope string, dynamic boolean",
    "call": "unit int, routine int, seq int, parts array<string>, link string, line int, offset int, argc int, named array<string>, statement boolean, parens boolean, in_loop boolean, in_sql boolean, text string, step array<int>",
    "step": "unit int, routine int, path array<int>, kind string, text string, label string, line int, end_line int, from_off int, to_off int, link_seq int, exception string, code int, code_text string, exceptions array<string>, counts boolean, bulk boolean, limit boolean, target string",
    "target": "unit int, routine int, name string, first string, second string, how string, line int",
    "effect": "unit int, routine int, kind string, detail string, line int",
    "count": "unit int, routine int, statements int",
    "skipped": "kind string, name string, object string, line int, end_line int, reason string",
    "table_def": "def int, schema string, name string, line int, end_line int, alter_only boolean",
    "table_col": "def int, seq int, name string, type string, not_null boolean, default_text string",
    "table_key": "def int, kind string, key int, cols array<string>",
    "table_fk": "def int, fk int, name string, cols array<string>, parent string, parent_cols array<string>, on_delete string",
}


def parse_rows(file: str, text: str | None, flags: dict[str, Any]) -> Iterator[tuple[str, str, str, dict[str, Any]]]:
    """(file, variant, table, row) of one file. A failure inside the parser is an error row, never a lost file."""
    from codeloom.functions.parser import parse
    from codeloom.functions.scan import mask, variants

    for v in variants(text or "", flags):
        try:
            rows = parse(v.text)
        except Exception as e:  # noqa: BLE001  one file must not end the job
            rows = {"error": [{"line": 1, "col": 1, "message": f"analysis failed: {e!r}"[:300]}]}
        yield file, v.name, "file", {"n_lines": v.text.count("\n") + (not v.text.endswith("\n") and bool(v.text)), "n_errors": len(rows.get("error", [])), "conditions": [vars(c) for c in v.conditions]}
        yield file, v.name, "source", {"text": v.text, "masked": mask(v.text)}
        for line, message in v.issues:
            yield file, v.name, "condition_issue", {"line": line, "message": message}
        for name, many in rows.items():
            for row in many:
                yield file, v.name, name, row


class Facts:
    """Fact tables of a corpus, parsed once and kept in the shared folder.

    All are written in one pass as Parquet partitioned by table, each in a typed struct column of its own, so a query
    reads only the files of its tables and of these only the columns that it uses. Texts are a table of their own.
    """

    def __init__(self, files: DataFrame, flags: dict[str, Any] | None = None, where: str | None = None):
        spark = files.sparkSession
        flags = dict(flags or {})
        types = {name: to_arrow_type(StructType.fromDDL(ddl)) for name, ddl in TABLES.items()}
        schema = pa.schema([("file", pa.string()), ("variant", pa.string()), *((f"f_{k}", t) for k, t in types.items()), ("tbl", pa.string())])

        def batches_of(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            held: dict[str, list[tuple]] = {}
            for r in rows:
                held.setdefault(r[2], []).append(r)
            for name, many in held.items():
                n = len(many)
                facts = [pa.array([r[3] for r in many], type=t) if k == name else pa.nulls(n, t) for k, t in types.items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in many]), pa.array([r[1] for r in many]), *facts, pa.array([name] * n)], schema=schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: list[tuple[str, str, str, dict[str, Any]]] = []
            for b in batches:
                for file, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    out += parse_rows(file, text, flags)
                    if len(out) > 20_000:
                        yield from batches_of(out)
                        out = []
            yield from batches_of(out)

        self.spark, self.files = spark, files
        self.path = where or f"{shared_dir(spark)}/facts-{uuid.uuid4().hex}"
        whole = "file string, variant string, " + ", ".join(f"f_{name} struct<{_struct(ddl)}>" for name, ddl in TABLES.items()) + ", tbl string"
        # parsing costs far more than moving a file, so files are spread evenly, whatever partitions they come in
        tasks = max(2 * spark.sparkContext.defaultParallelism, files.rdd.getNumPartitions())
        rows = files.select("file", "text").repartition(tasks, F.xxhash64("file")).mapInArrow(run, whole)
        rows.write.partitionBy("tbl").parquet(self.path)
        _gone_at_exit(spark, self.path)
        self._read: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """One table, read from its own folder with its own columns: a scan that names the columns of all tables makes plans
        many times as large on the driver, and its size is estimated from the files of all of them."""
        if name not in self._read:
            schema, folder = f"file string, variant string, f_{name} struct<{_struct(TABLES[name])}>, tbl string", f"{self.path}/tbl={name}"
            found = self.spark.read.schema(schema).option("basePath", self.path).parquet(folder) if _exists(self.spark, folder) else self.spark.createDataFrame([], schema)
            self._read[name] = found.where(F.col("tbl") == name).select("file", "variant", f"f_{name}.*")
        return self._read[name]


def _struct(ddl: str) -> str:
    """Fields of a table as fields of a struct."""
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in StructType.fromDDL(ddl))


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which every executor shares. Where it is unset, a temporary folder on a single machine,
    and an error on a cluster, whose executors would each write to a disk of their own."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="codeloom-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _gone_at_exit(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def stash(df: DataFrame, tag: str = "t") -> DataFrame:
    """Write as a Parquet table in the shared folder and read back: cuts the plan, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _gone_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)
