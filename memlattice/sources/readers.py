"""Sources of memories: JSON lines, text files, sections, conversations, source trees, sidecars."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from memlattice.functions.text import corpus_id, header_id, memory_text
from memlattice.shipping import ship

# Folders that hold no sources, suffixes of source files, and names of source files without such a suffix; and
# what is added to each where a whole repository is indexed.
SKIPPED = (
    ".git", ".hg", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".svn", ".tox", ".venv", "__pycache__", "build", "dist", "node_modules", "venv",
)
SUFFIXES = (
    ".bash", ".c", ".cc", ".cmake", ".cpp", ".cs", ".css", ".cts", ".cxx", ".ex", ".exs", ".go", ".h", ".hh", ".hpp", ".hs", ".htm", ".html", ".hxx", ".java", ".js", ".jsx", ".kt", ".kts",
    ".less", ".lhs", ".lua", ".mjs", ".mts", ".php", ".py", ".pyi", ".rb", ".rs", ".sass", ".sc", ".scala", ".scss", ".sh", ".svelte", ".swift", ".ts", ".tsx", ".vue", ".zig",
)
NAMES = ("CMakeLists.txt",)
REPOSITORY_SKIPPED = ("site-packages",)
REPOSITORY_SUFFIXES = (".pxd", ".pxi", ".pyx")
REPOSITORY_NAMES = ("BUILD", "BUILD.bazel", "WORKSPACE")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_lines(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """Strict: a bad line is an error. Tolerant: blank and bad lines, and those that hold no object, are skipped, whatever columns are read."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    row = F.from_json("value", StructType([*kind.fields, StructField("_bad", StringType())]), {"columnNameOfCorruptRecord": "_bad"})
    lines = spark.read.text(path).where(F.json_object_keys("value").isNotNull()).select(row.alias("row"))
    return lines.where(F.col("row._bad").isNull()).select(*[F.col(f"row.{f.name}").alias(f.name) for f in kind.fields])


def whole_texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(text): a memory for each file."""
    return spark.read.text(paths, wholetext=True).select(F.col("value").alias("text"))


def json_memories(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of a JSON list, or of the list `memories` of a JSON object."""
    one = "array<struct<id:string,text:string>>"
    raw = spark.read.text(path, wholetext=True)
    keyed = F.json_object_keys("value").isNotNull()
    listed = F.when(keyed, F.from_json("value", f"struct<memories:{one}>")["memories"]).otherwise(F.from_json("value", one))
    return raw.select(F.explode(listed).alias("m")).select("m.*")


def source_files(spark: SparkSession, root: str, repository: bool = False) -> DataFrame:
    """(path, text) of source files below root, in order of path; skipped folders and other names are left out, and other names are not even read."""
    suffixes, names, skipped = (x + (y if repository else ()) for x, y in ((SUFFIXES, REPOSITORY_SUFFIXES), (NAMES, REPOSITORY_NAMES), (SKIPPED, REPOSITORY_SKIPPED)))
    either = lambda x: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in x)
    glob = "{" + ",".join([*(f"*{either(x)}" for x in suffixes), *names]) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    inside = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    below = F.substring(inside, F.lit(len(re.sub(r"^[a-z]+:/*", "/", root).rstrip("/")) + 1), F.length(inside))
    folders = "|".join(x.replace(".", r"\.") for x in skipped)
    return files.where(~below.rlike(f"/({folders})/")).select(inside.alias("path"), F.decode("content", "utf-8").alias("text")).orderBy("path")


def sectioned(lines: DataFrame, by: list[str], position: str = "pos", line: str = "line") -> DataFrame:
    """(by, section, line_no, text): [Header] lines name the section of those that follow; numbers count non-blank lines, headers included."""
    w = Window.partitionBy(*by).orderBy(position)
    rows = lines.where(F.trim(line) != "").withColumn("line_no", F.row_number().over(w).cast("bigint"))
    head = F.regexp_extract(F.trim(line), r"^\[(.+)\]$", 1)
    rows = rows.withColumn("head", F.when(head != "", head)).withColumn("section", F.last("head", ignorenulls=True).over(w))
    return rows.where(F.col("head").isNull()).select(*by, "section", "line_no", F.trim(line).alias("text"))


def conversation_memories(turns: DataFrame) -> DataFrame:
    """(session_id, memory_idx, id, text): a header without id, then a memory for each turn. turns: conv_id, turn, role, text[, has_answer]."""
    session = F.col("conv_id").cast("string")
    answer = F.col("has_answer") if "has_answer" in turns.columns else F.lit(True)
    body = turns.select(session.alias("session_id"), F.col("turn").cast("bigint").alias("turn"), corpus_id(session, F.col("turn") + 1, answer).alias("id"), memory_text(F.col("role"), F.col("text")).alias("text"))
    heads = turns.groupBy(session.alias("session_id")).agg(F.lit(-1).cast("bigint").alias("turn")).select("session_id", "turn", F.lit(None).cast("string").alias("id"), F.concat(F.lit("session "), "session_id").alias("text"))
    both = heads.unionByName(body)
    idx = F.row_number().over(Window.partitionBy("session_id").orderBy("turn")) - 1
    return both.select("session_id", idx.cast("bigint").alias("memory_idx"), "id", "text")


def with_headers(messages: DataFrame, by: list[str], position: str, session: str, header: str) -> DataFrame:
    """(by, pos, is_header, text): a header before each run of messages of one session, also where a session comes back; pos from 0. messages: by, position, session, header, text."""
    w = Window.partitionBy(*by).orderBy(position)
    before = F.lag(F.struct(session)).over(w)
    opens = messages.withColumn("_opens", before.isNull() | ~before[session].eqNullSafe(F.col(session)))
    heads = opens.where("_opens").select(*by, F.col(position).alias("_p"), F.lit(True).alias("is_header"), F.col(header).alias("text"))
    both = heads.unionByName(opens.select(*by, F.col(position).alias("_p"), F.lit(False).alias("is_header"), "text"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("_p", F.desc("is_header"))) - 1
    return both.select(*by, place.cast("bigint").alias("pos"), "is_header", "text")


def context_text(messages: DataFrame, selected: DataFrame, by: list[str], position: str, session: str, header: str, item: str = "id") -> DataFrame:
    """(by, context): the selected messages in their order, a block for each run of one session, led by its header. selected: by, item."""
    w = Window.partitionBy(*by).orderBy(position)
    before = F.lag(F.struct(session)).over(w)
    runs = messages.withColumn("_run", F.sum(F.when(before.isNull() | ~before[session].eqNullSafe(F.col(session)), 1).otherwise(0)).over(w))
    chosen = runs.join(selected.select(*by, item).distinct(), [*by, item], "left_semi")
    lines = lambda order, text: F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"])
    heads = runs.groupBy(*by, "_run").agg(F.min_by(header, position).alias("_head"))
    blocks = chosen.groupBy(*by, "_run").agg(F.array_join(lines(position, "text"), "\n").alias("_body")).join(heads, [*by, "_run"])
    blocks = blocks.withColumn("_block", F.concat_ws("\n", "_head", "_body"))
    return blocks.groupBy(*by).agg(F.array_join(lines("_run", "_block"), "\n\n").alias("context"))


def haystack(entries: DataFrame) -> DataFrame:
    """(question_id, session_pos, turn_pos, id, text) of evaluation entries with sessions of turns, headers first (turn_pos -1)."""
    s = entries.select("question_id", F.posexplode(F.arrays_zip("haystack_session_ids", "haystack_dates", "haystack_sessions")).alias("session_pos", "s"))
    s = s.select("question_id", "session_pos", F.col("s.haystack_session_ids").alias("sid"), F.col("s.haystack_dates").alias("date"), F.col("s.haystack_sessions").alias("turns"))
    head = s.select("question_id", "session_pos", F.lit(-1).alias("turn_pos"), header_id(F.col("sid")).alias("id"), F.concat(F.lit("Session "), F.col("date")).alias("text"))
    t = s.select("question_id", "session_pos", "sid", F.posexplode("turns").alias("turn_pos", "t"))
    body = t.select("question_id", "session_pos", "turn_pos", corpus_id(F.col("sid"), F.col("turn_pos") + 1, F.col("t.has_answer")).alias("id"), memory_text(F.col("t.role"), F.col("t.content")).alias("text"))
    return head.unionByName(body)


def answerable(entries: DataFrame) -> DataFrame:
    """Entries that can be judged: no abstention (_abs) and at least one labelled turn."""
    has = F.exists("haystack_sessions", lambda s: F.exists(s, lambda t: F.coalesce(t["has_answer"], F.lit(False))))
    return entries.where(~F.contains("question_id", F.lit("_abs")) & has)


def write_sidecar(chunks: DataFrame, path: str) -> None:
    """chunks.jsonl and an index with their number."""
    chunks.write.mode("overwrite").json(f"{path}/chunks.jsonl")
    chunks.agg(F.count("*").alias("chunk_count")).write.mode("overwrite").json(f"{path}/index.json")


def read_sidecar(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The chunks; an error if they aren't as many as the index says."""
    chunks = json_lines(spark, f"{path}/chunks.jsonl", schema)
    said = spark.read.json(f"{path}/index.json").first()["chunk_count"]
    if chunks.count() != said:
        raise ValueError(f"{path} holds another number of chunks than its index says")
    return chunks
