"""File sources and sinks: preferred sources, inventories, logs, XML events, caches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalgrid.operators.textops import new_by_message, valid_pairs


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return bool(fs.exists(p))


def any_match(spark: SparkSession, pattern: str) -> bool:
    fs, p = file_system(spark, pattern)
    found = fs.globStatus(p)
    return found is not None and len(found) > 0


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Headered CSV with a declared schema; unparsable cells become null."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def preferred_source(spark: SparkSession, root: str, names: Sequence[str]) -> str:
    """First of the named sources that exists below the root."""
    for name in names:
        path = f"{root.rstrip('/')}/{name}"
        if path_exists(spark, path):
            return path
    raise FileNotFoundError(f"none of {list(names)} under {root}")


def recording_format(spark: SparkSession, root: str) -> tuple[str, int] | None:
    """(glob, sampling rate) of a recording folder: the 100 Hz export wins over the 64 Hz one."""
    # Recording file patterns and their rates.
    for pattern, rate in (("*_PSG_df_updated.csv", 100), ("S00*_whole_df.csv", 64)):
        if any_match(spark, f"{root.rstrip('/')}/{pattern}"):
            return pattern, rate
    return None


# Name endings of recordings and their sampling rates, the preferred one first.
RECORDINGS = (("_PSG_df_updated", 100), ("_whole_df", 64))
RECORDING_COLUMNS = ("BVP", "Sleep_Stage")


def chosen_recordings(spark: SparkSession, root: str, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """One file set per subject of a folder: sid, rate, cols, paths.

    The 100 Hz export of a subject wins over its 64 Hz one; files without the required columns are skipped, so a subject
    whose export lacks them falls back. Ids outside the range drop, those without digits pass.
    """
    ends = "|".join(e for e, _ in RECORDINGS)
    inv = header_inventory(spark, root, "*.csv")
    sid, end = (F.regexp_extract("path", rf"([^/=]+?)({ends})\.csv(?:/|$)", i) for i in (1, 2))
    rate = F.coalesce(*[F.when(end == e, r) for e, r in RECORDINGS])
    rows = inv.select(F.split(sid, "_")[0].alias("sid"), rate.alias("rate"), "cols", "path").where("rate is not null")
    rows = rows.where(F.array_contains("cols", RECORDING_COLUMNS[0]) & F.array_contains("cols", RECORDING_COLUMNS[1]))
    if lo is not None:
        rows = rows.where(in_subject_range(F.col("sid"), lo, hi))
    best = rows.groupBy("sid").agg(F.max("rate").alias("rate"))
    return rows.join(best, ["sid", "rate"]).groupBy("sid", "rate", "cols").agg(F.collect_list("path").alias("paths"))


def recordings(spark: SparkSession, root: str, columns: Sequence[str], lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Samples of the chosen recordings: sid, rate, Sleep_Stage and the columns as doubles, null where a file has none.

    Files of one header are read together; the driver lists files, as every read does, and no rows.
    """
    files = chosen_recordings(spark, root, lo, hi).collect()  # a row per subject
    out = None
    names = {c: T.StringType() for c in ("sid", "Sleep_Stage")} | {"rate": T.IntegerType()} | {c: T.DoubleType() for c in columns}
    for rate, cols in sorted({(r["rate"], tuple(r["cols"])) for r in files}):
        paths = [p for r in files if r["rate"] == rate and tuple(r["cols"]) == cols for p in r["paths"]]
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(cols))])
        raw = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(paths)
        ends = "|".join(e for e, _ in RECORDINGS)
        sid = F.split(F.regexp_extract("_metadata.file_path", rf"([^/=]+?)({ends})\.csv(?:/|$)", 1), "_")[0]
        at = {c: F.col(f"c{cols.index(c)}") if c in cols else F.lit(None) for c in ("Sleep_Stage", *columns)}
        part = raw.select(
            sid.alias("sid"),
            F.lit(rate).alias("rate"),
            at["Sleep_Stage"].cast("string").alias("Sleep_Stage"),
            *[at[c].try_cast("double").alias(c) for c in columns],
        )
        out = part if out is None else out.unionByName(part)
    order = ["sid", "rate", "Sleep_Stage", *columns]
    if out is None:
        return spark.createDataFrame([], T.StructType([T.StructField(c, names[c]) for c in order]))
    return out.select(*order)


def header_inventory(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    """Path and header columns of every table file below the root; lock files are skipped.

    Only the first block of a file takes part; the header is its first line, found by an aggregate
    with map-side combine.
    """
    lines = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .text(root)
        .select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
        .where("start = 0")
    )
    first = lines.withColumn("__o", F.monotonically_increasing_id()).groupBy("path").agg(F.min_by("value", "__o").alias("header"))
    name = F.element_at(F.split("path", "/"), -1)
    return first.where(~name.startswith("~$")).select(
        "path", F.transform(F.split("header", ","), lambda c: F.trim(F.regexp_replace(c, '^"|"$', ""))).alias("cols")
    )


def write_partitioned(df: DataFrame, path: str, key: str, spread: str, files_per_folder: int = 4, folders: int = 256) -> None:
    """Store partitioned by ranges of a whole-number key; the key itself stays as the column ``sid``.

    A folder is named by the first key of its range. Up to ``folders`` keys have one each, more keys share them, so the
    number of files does not grow with the keys. A hot range is spread over several files by a second column.
    """
    low, high = df.agg(F.min(key), F.max(key)).first()
    width = 1 if low is None else -(-(high - low + 1) // folders)
    first = F.col(key) - F.pmod(F.col(key), F.lit(width))
    placed = df.withColumn("sid", F.col(key).cast("string")).withColumn(key, first)
    salt = F.pmod(F.xxhash64(spread), F.lit(files_per_folder))
    placed.repartition(F.col(key), salt).write.partitionBy(key).parquet(path)


def subject_from_path(path_col):
    """Digits of the subject folder or file name."""
    name = F.regexp_extract(path_col, r"subject=([^/]*)", 1)
    return F.regexp_replace(name, r"\D", "")


def in_subject_range(sid, lo: int, hi: int):
    """Numeric ids must lie in the range; ids without digits pass."""
    digits = F.regexp_replace(sid, r"\D", "")
    return (digits == "") | digits.cast("bigint").between(lo, hi)


def scored_events(spark: SparkSession, path: str) -> DataFrame:
    """Scored-event XML rows whose concept names a stage."""
    schema = "EventConcept string, Duration double"
    return (
        spark.read.format("xml").option("rowTag", "ScoredEvent").schema(schema).load(path).where(F.col("EventConcept").contains("Stage"))
    )


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and malformed lines drop."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


LOG_PATTERN = r"(?s)rating=(\w+).*?response_preview='(.*?)'"


def parse_feedback(lines: DataFrame, column: str = "value") -> DataFrame:
    """Preview and label of rated log lines; short previews and other ratings drop."""
    rating = F.regexp_extract(column, LOG_PATTERN, 1)
    preview = F.trim(F.regexp_extract(column, LOG_PATTERN, 2))
    return (
        lines.withColumn("rating", rating)
        .withColumn("preview", preview)
        .where(F.col("rating").isin("up", "down") & (F.length("preview") > 15))
        .withColumn("label", F.when(F.col("rating") == "up", 1).otherwise(0))
    )


def cached_table(spark: SparkSession, path: str, source: str, build, columns: int) -> tuple[DataFrame, bool]:
    """A stored feature table, rebuilt when its source or column count differs.

    Returns the table and whether the stored copy was used. A reader during a rebuild sees the old version.
    """
    from vitalgrid.sources.store import Store

    store, notes = Store(spark, path), {"source": source, "columns": columns}
    manifest = store.manifest()
    if manifest and manifest["notes"] == notes:
        return store.read(), True
    version = store.replace(build(), notes)
    return store.read(version=version), False


def append_new_pairs(spark: SparkSession, path: str, fresh: DataFrame, order: Sequence[str]) -> None:
    """Append the valid pairs whose normalized message is not stored yet, as JSON lines, in one new version."""
    from vitalgrid.sources.store import Store

    store = Store(spark, path)
    seen = (store.versions() or [0])[-1]
    existing = store.read("message string, title string", seen) if seen else None
    new = new_by_message(valid_pairs(fresh), existing, order)
    store.append(new.select("message", "title"), form="json", seen=seen)


def stored_pairs(spark: SparkSession, path: str) -> DataFrame:
    from vitalgrid.sources.store import Store

    return Store(spark, path).read("message string, title string")
