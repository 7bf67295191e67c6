"""Readers and writers: decoder records, interval files, utterance files, CSV and Markdown."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORDS = "array<struct<start:double,end:double,word:string,probability:double>>"
RECORD = (
    "unit_id string, text string, audio_s double, decode_s double, segments array<struct<start:double,end:double,text:string,avg_logprob:double,n_tokens:int,no_speech_prob:double,compression_ratio:double,temperature:double>>, "
    f"words {WORDS}"
)
# Fixed value: the interval format's fields.
INTERVAL = r'intervals \[\d+\]:\s*xmin = ([-\d.eE]+)\s*xmax = ([-\d.eE]+)\s*text = "((?:[^"]|"")*)"'


def read_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Decoder records from JSON lines: malformed lines are skipped, the last record of a unit wins."""
    raw = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    numbered = raw.withColumn("line", F.monotonically_increasing_id())
    parsed = numbered.withColumn("r", F.from_json("value", RECORD, {"mode": "PERMISSIVE"})).filter(F.col("r.unit_id").isNotNull() & F.rtrim("value").endswith("}"))
    last = F.row_number().over(Window.partitionBy("r.unit_id").orderBy(F.col("file").desc(), F.col("block").desc(), F.col("line").desc()))
    return parsed.withColumn("n", last).filter("n = 1").select("r.*")


def read_shards(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Chosen columns of Parquet shards, with the shard and the row's place in it."""
    return spark.read.parquet(path).select(*columns, F.col("_metadata.file_name").alias("shard"), F.col("_metadata.row_index").alias("row"))


def parse_intervals(files: DataFrame) -> DataFrame:
    """(file, text of an interval file) to (file, idx, start, end, text); doubled quotes become one, empty intervals stay."""
    part = lambda k: F.regexp_extract_all("value", F.lit(INTERVAL), k)
    rows = files.select("file", F.posexplode(F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("t"))).alias("idx", "x"))
    return rows.select("file", "idx", F.col("x.a").cast("double").alias("start"), F.col("x.b").cast("double").alias("end"), F.trim(F.replace(F.col("x.t"), F.lit('""'), F.lit('"'))).alias("text"))


def read_utterances(spark: SparkSession, path: str, name: str = r"(.+)_(doctor|patient)\.TextGrid$") -> DataFrame:
    """Utterances of interval files whose names say consultation and role; other files and empty intervals are skipped."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    keyed = parse_intervals(files.filter(F.col("file").rlike(name))).filter("text <> ''")
    out = keyed.withColumns({"consultation": F.regexp_extract("file", name, 1), "role": F.regexp_extract("file", name, 2)})
    return out.select("consultation", "role", "idx", "start", "end", "text").orderBy("consultation", "start", "role")


def read_csv_or_parquet(spark: SparkSession, csv: str, schema: str, parquet: str) -> DataFrame:
    """A committed (compressed) CSV, or the Parquet file where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(csv)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.read.csv(csv, schema=schema, header=True)
    return spark.read.parquet(parquet)


def write_csv(df: DataFrame, path: str, digits: int = 5) -> None:
    """One CSV file with doubles in `digits` significant digits; an empty table writes nothing."""
    if not df.isEmpty():
        fmt = lambda c, t: F.when(F.isnan(c), F.lit("")).otherwise(F.format_string(f"%.{digits}g", F.col(c))).alias(c) if t in ("double", "float") else F.col(c)
        df.select(*(fmt(c, t) for c, t in df.dtypes)).coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_splits(df: DataFrame, path: str, split: str = "split", digits: int = 3) -> None:
    """CSV files with a header in a folder a split, doubles rounded to `digits` places; each task writes its own rows, null and empty splits share a folder."""
    show = lambda c, t: F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c)
    df.select(*(show(c, t) for c, t in df.dtypes)).write.partitionBy(split).mode("overwrite").csv(path, header=True)


def read_csv_columns(spark: SparkSession, path: str, schema: str, columns: Sequence[str]) -> DataFrame:
    """Chosen columns of CSV files with a header; the others are not parsed. A name that the schema lacks is an error."""
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False).select(*columns)


def write_words(df: DataFrame, path: str) -> None:
    """The compact word table: narrow types, zstd."""
    df.withColumns({"p": F.col("p").cast("float"), "correct": F.col("correct").cast("byte")}).write.mode("overwrite").parquet(path, compression="zstd")


def without_private(df: DataFrame, private: tuple[str, ...] = ("speaker", "session_id", "file_name")) -> DataFrame:
    return df.drop(*private)


def markdown(df: DataFrame, percent: tuple[str, ...] = ()) -> str:
    """A result table, small by then, as Markdown."""
    show = lambda c, v: "" if v is None else f"{100 * v:.1f}%" if c in percent else f"{v:.3f}" if isinstance(v, float) else str(v)
    rows = [[show(c, r[c]) for c in df.columns] for r in df.collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["---"] * len(df.columns), *rows])


def markdown_report(df: DataFrame, order: Sequence[str], percent: Sequence[str] = (), digits: int = 3) -> DataFrame:
    """(report): one row, the table as Markdown, its lines made and ordered by `order` on the executors. Doubles get `digits` places, those of `percent` become
    percents with one; nulls and NaN are empty, a `|` in a text is escaped. An empty table is its two head lines. The lines of one report meet in one row: it is for small tables."""

    def show(c: str, t: str) -> Column:
        if t not in ("double", "float"):
            return F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
        text = F.format_string("%.1f%%", F.round(100 * F.col(c), 1)) if c in percent else F.format_string(f"%.{digits}f", F.round(c, digits))
        return F.when(F.isnan(c) | F.col(c).isNull(), F.lit("")).otherwise(text)

    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(show(c, t) for c, t in df.dtypes)), F.lit(" |"))
    head = f"| {' | '.join(df.columns)} |\n| {' | '.join('---' for _ in df.columns)} |"
    lines = df.select(F.struct(*order, line.alias("__line")).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return lines.select(F.array_join(F.concat(F.array(F.lit(head)), F.transform("x", lambda x: x["__line"])), "\n").alias("report"))


def scratch_folder(spark: SparkSession) -> str:
    """A new path in the folder that spark.checkpoint.dir names, which driver and executors share; where it is unset and all run in one
    process, as in tests, below a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="triagelake-")
    return f"{folder.rstrip('/')}/triagelake/sink-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The table, written below the shared folder and read again: it is computed once, and a lost executor costs nothing that is done."""
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def read_jsonl(spark: SparkSession, path: str, schema: str, id_col: str) -> DataFrame:
    """Rows of JSON lines, one an id: torn and malformed lines, and those without an id, are skipped; an empty table where there is no file."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.text(path).select("value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"))
    return rows.filter(F.rtrim("value").endswith("}") & F.col(f"r.{id_col}").isNotNull()).select("r.*").dropDuplicates([id_col])


def append_jsonl(rows: DataFrame, path: str, id_col: str) -> None:
    """Appends rows as JSON lines, those whose id is not there yet: a job that broke off goes on where it was. Files are only added, and
    a task's file appears when it is whole."""
    done = read_jsonl(rows.sparkSession, path, f"{id_col} {dict(rows.dtypes)[id_col]}", id_col)
    rows.join(done, id_col, "left_anti").write.mode("append").json(path)


def validated(rows: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Adds verdict: the name of the first check that a row doesn't pass (an unknown answer is none), or ok."""
    verdict = F.lit("ok")
    for name, passed in reversed(checks.items()):
        verdict = F.when(F.coalesce(passed, F.lit(False)), verdict).otherwise(F.lit(name))
    return rows.withColumn("verdict", verdict)


def content_key(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, key): a key of each group's content, by which results that were computed from it can be kept; the order of rows doesn't matter.

    It is the MD5 of the number of rows and the sum of 48 bits of each row's own MD5, so it is aggregated like any sum.
    """
    own = F.conv(F.substring(F.md5(F.concat_ws("|", *columns)), 1, 12), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(*keys).agg(F.md5(F.concat_ws(":", F.count(F.lit(1)), F.sum(own))).alias("key"))
