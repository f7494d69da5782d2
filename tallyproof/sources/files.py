"""Files: scanning, sniffing, guards; and the tables that results are kept in."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallyproof.functions.text import stripped
from tallyproof.operators.lines import split_lines, text_lines

MAX_BYTES, MIN_CHARS = 10 * 1024 * 1024, 50


def listed(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, name, size) of the files under a path, from the file system itself:
    files of no bytes too, which Spark's readers pass over. Names alone are held."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    rows, todo = [], list(fs.globStatus(at) or [])
    top = True
    while todo:
        below = []
        for status in todo:
            if status.isDirectory():
                below += list(fs.listStatus(status.getPath())) if top or recursive else []
            else:
                rows.append((status.getPath().toString(), status.getPath().getName(), status.getLen()))
        todo, top = below, False
    return spark.createDataFrame(rows, "path string, name string, size long").where(~F.startswith(F.col("name"), F.lit(".")))


def scan(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, name, content) of a file or of a folder's files that aren't hidden, empty
    ones included."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    full = files.select("path", name.alias("name"), "content").where(~F.startswith(F.col("name"), F.lit(".")) & (F.octet_length("content") > 0))
    empty = listed(spark, path, recursive).where("size = 0").select("path", "name", F.lit(b"").alias("content"))
    return full.unionByName(empty)


def received(spark: SparkSession, uploads: list[tuple[str, bytes]]) -> DataFrame:
    """(path, name, content) of files that come with a request, a few at a time; paths in
    their names are cut off."""
    rows = [(name, name.replace("\\", "/").rpartition("/")[2], bytearray(raw)) for name, raw in uploads]
    return spark.createDataFrame(rows, "path string, name string, content binary")


def content_key(content: Column) -> Column:
    return F.sha2(content, 256)


@F.pandas_udf(StringType())
def zip_kind(content: pd.Series) -> pd.Series:
    """docx, odt, pages, archive (something else) or damaged."""

    def kind(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        try:
            names = set(zipfile.ZipFile(io.BytesIO(raw)).namelist())
        except zipfile.BadZipFile:
            return "damaged"
        if "word/document.xml" in names:
            return "docx"
        if names & {"content.xml", "mimetype"}:
            return "odt"
        return "pages" if any(n.startswith("Index/") or n.endswith(".iwa") for n in names) else "archive"

    return content.map(kind)


def sniff(content: Column) -> Column:
    """pdf, ole2, rtf, zip, txt or unknown, by the first bytes, never by name."""
    head = lambda n: F.hex(F.substring(content, 1, n))
    return (
        F.when(head(4) == "25504446", "pdf")
        .when(head(4) == "D0CF11E0", "ole2")
        .when(head(5) == "7B5C727466", "rtf")
        .when(head(4) == "504B0304", "zip")
        .when(F.is_valid_utf8(content.cast("string")), "txt")
        .otherwise("unknown")
    )


def visible_length(text: Column) -> Column:
    """Characters of all lines, each stripped."""
    return F.aggregate(split_lines(text), F.lit(0), lambda n, line: n + F.length(stripped(line)))


def classify(files: DataFrame) -> DataFrame:
    """`files(name, content)` with kind and reject_code; errors are values. Size
    comes first, then emptiness, then the format; archives alone are opened."""
    rows = files.withColumn("sniffed", sniff(F.col("content")))
    is_zip = F.col("sniffed") == "zip"
    opened = rows.where(is_zip).withColumn("inside", zip_kind("content"))
    rows = rows.where(~is_zip).withColumn("inside", F.lit(None).cast("string")).unionByName(opened)
    suffix = F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1))
    kind = F.when(F.col("inside") == "docx", "docx").when(F.col("sniffed") == "pdf", "pdf").when(F.col("sniffed") == "txt", F.when(suffix == ".md", "md").otherwise("txt"))
    short = F.col("sniffed").eqNullSafe("txt") & (visible_length(F.col("content").cast("string")) < MIN_CHARS)
    code = (
        F.when(F.octet_length("content") > MAX_BYTES, "file_too_large")
        .when(F.octet_length("content") == 0, "empty_document")
        .when(kind.isNull(), "unsupported_format")
        .when(short, "empty_document")
    )
    return rows.withColumn("kind", F.when(code.isNull() | (code != "unsupported_format"), kind)).withColumn("reject_code", code).drop("sniffed", "inside")


def plain_blocks(files: DataFrame) -> DataFrame:
    """Lines of text files as blocks: what isn't UTF-8 is replaced."""
    text = F.decode(F.col("content"), "UTF-8")
    return text_lines(files.withColumn("text", text), "sha").withColumnRenamed("no", "seq").withColumn("page", F.lit(1)).withColumn("zone", F.lit("body")).withColumn("column", F.lit(None).cast("int"))


def tally(classified: DataFrame) -> DataFrame:
    verdict = F.coalesce("reject_code", "kind")
    return classified.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "verdict")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only where that isn't set and the session is
    a local one, a temporary one of this machine."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder and sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc._jsc.sc().getCheckpointDir().get()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tallyproof-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """`df`, computed once and kept in the shared checkpoint folder: what follows
    neither repeats its work (or a model's answers) nor depends on lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame, key: str) -> DataFrame:
    """`df` dealt out by `key` where its scan has fewer tasks than the session has cores, as a
    single file of one row group has: what is done to each text then runs on all of them.
    A scan of more tasks, like that of any large table, stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def few(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """`df`, to be broadcast if a count shows that it has `rows` rows at most; a plain join side beyond."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def save(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Tables keyed by sha; readers see a whole version or none."""
    df.write.mode(mode).parquet(path)


def save_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def save_keyed(df: DataFrame, path: str, key: str = "sha") -> None:
    """A folder for each key, replaced as a whole where the key comes again; other
    keys stay as they are."""
    df.withColumn("__key", F.col(key)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__key").parquet(path)


def load_keyed(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """All that `save_keyed` kept, or one key's own: only its folder is read."""
    rows = spark.read.parquet(path)
    return (rows if key is None else rows.where(F.col("__key") == key)).drop("__key")


def copies(classified: DataFrame, folder: str) -> DataFrame:
    """(path, target): where accepted files go if they are sorted into a folder for
    each kind; equal names get a number, in order of their paths."""
    good = classified.where("reject_code is null").select("path", "name", "kind")
    nr = F.row_number().over(Window.partitionBy("kind", "name").orderBy("path"))
    stem, end = F.regexp_extract("name", r"^(.+?)(\.[^.]*)?$", 1), F.regexp_extract("name", r"^.+?(\.[^.]*)?$", 1)
    name = F.when(nr == 1, F.col("name")).otherwise(F.concat(stem, F.lit("-"), nr.cast("string"), end))
    return good.select("path", F.concat_ws("/", F.lit(folder.rstrip("/")), "kind", name).alias("target"))


def copy_sorted(spark: SparkSession, classified: DataFrame, folder: str) -> DataFrame:
    """Copies accepted files as `copies` says, on the executors by pyarrow; gives what was copied."""
    from pyarrow import fs

    def run(batches):
        for batch in batches:
            for target, content in zip(batch["target"], batch["content"], strict=True):
                at, path = fs.FileSystem.from_uri(target)
                at.create_dir(path.rpartition("/")[0], recursive=True)
                with at.open_output_stream(path, compression=None) as out:
                    out.write(bytes(content))
            yield batch[["path", "target"]]

    root = folder if "://" in folder else f"file://{os.path.abspath(folder)}"
    return settled(copies(classified, root).join(classified.select("path", "content"), "path").mapInPandas(run, "path string, target string"))


def cached(spark: SparkSession, path: str, sha: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("sha") == sha)


def missing(corpus: DataFrame, parsed: DataFrame, key: str = "sha") -> DataFrame:
    return corpus.join(parsed.select(key).distinct(), key, "left_anti")
