"""Readers for reads, labels, result tables, logs and catalogs. Files are read line by line by Spark's text source, so
their size has no bound and plain ones are split."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.ids import is_host, norm_id
from ..functions.scalars import field_pattern, group, number, seconds, strip_ansi
from ..session import scratch
from . import fastq as ranges


def lines(spark: SparkSession, paths: str | list[str], **options) -> DataFrame:
    """path, line_no (from 0 in each file) and value (bytes) of all lines. Rows are numbered within their part of a file as
    they are read; the numbers of rows of the parts before it, summed over a table of parts, make that a line's number."""
    raw = spark.read.options(**options).text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("id"), F.col("value").cast("binary").alias("value"))
    parts = raw.groupBy("path", "part").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("path", "part", (F.coalesce(F.sum("n").over(upto), F.lit(0)) - F.col("first")).alias("shift"))
    # A part that the other scan didn't have would mean that both were cut differently: no line may go for that.
    number = F.col("id") + F.coalesce("shift", F.raise_error(F.lit("a file was cut differently while it was read")).cast("bigint"))
    return raw.join(parts, ["path", "part"], "left").select("path", number.alias("line_no"), "value")


def fastq(spark: SparkSession, paths: str | list[str], ids_only: bool = True, strict: bool = False, glob: str | None = None, index: bool = True) -> DataFrame:
    """path, index (of the record in its file, from 0) and header of FASTQ records, and with ``ids_only`` off seq, plus and
    qual. What a file is, its first bytes tell and not its name (``strict``: one named ``.gz`` that isn't gzip raises). Plain
    files and gzip files of blocks are read in ranges, by many tasks. Empty files are skipped, bytes that don't decode are
    left out, blank lines at the end are no record; of a record that ends early what lacks is NULL.

    One scan; only for the ``index`` of files of several ranges their line feeds are counted before, and the driver gets a
    row for each such range. Stores that Arrow doesn't know are read by Spark's text source instead, which goes by names and
    scans twice."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not all(map(ranges.readable, paths)):
        return _fastq_lines(spark, paths, ids_only, glob)
    ranges.register(spark)
    step = min(ranges.STEP, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    files = _sized(spark, paths, glob)
    read = spark.read.format(ranges.NAME).option("files", json.dumps(files)).option("step", step).option("idsOnly", ids_only).option("strict", strict)
    if index and any(size > step for _, size in files):
        counts = read.option("counting", True).load().collect()
        read = read.option("counting", False).option("counts", json.dumps([tuple(r) for r in counts]))
    out = read.load()
    return out if index else out.drop("index")


def _sized(spark: SparkSession, paths: list[str], glob: str | None) -> list[tuple[str, int]]:
    """Files of more than no bytes and their sizes, in whole folders too."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        files = files.option("pathGlobFilter", glob)
    return sorted((r.path, r.length) for r in files.load(paths).filter("length > 0").select("path", "length").collect())


def _fastq_lines(spark: SparkSession, paths: list[str], ids_only: bool, glob: str | None) -> DataFrame:
    listed = [p for p, _ in _sized(spark, paths, glob)]
    kind = "path string, index long, header string" + ("" if ids_only else ", seq string, plus string, qual string")
    if not listed:
        return spark.createDataFrame([], kind)
    rows = lines(spark, listed)
    if ids_only:
        return _decoded(rows.filter("line_no % 4 = 0").select("path", F.expr("line_no DIV 4").alias("index"), F.col("value").alias("header")), kind).filter("header <> ''")
    found = rows.mapInArrow(_records, "path string, index long, header binary, seq binary, plus binary, qual binary, whole boolean")
    cut = found.filter("NOT whole").groupBy("path", "index").agg(*[F.max(c).alias(c) for c in ("header", "seq", "plus", "qual")])
    return _decoded(found.filter("whole").drop("whole").unionByName(cut), kind).filter("header <> ''")


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records whose lines come one after the other; lines of others alone, as parts of a record."""
    names = ["path", "index", "header", "seq", "plus", "qual", "whole"]
    kinds = [pa.string(), pa.int64(), *[pa.binary()] * 4, pa.bool_()]
    path, start, held = None, 0, []

    def parts() -> list[tuple]:
        return [(path, (start + k) // 4, *[v if (start + k) % 4 == j else None for j in range(4)], False) for k, v in enumerate(held)]

    for b in batches:
        out: list[tuple] = []
        for p, n, v in zip(*(b.column(c).to_pylist() for c in ("path", "line_no", "value")), strict=True):
            if held and (p != path or n != start + len(held)):
                out += parts()
                held = []
            if not held:
                path, start = p, n
            held.append(v)
            if n % 4 == 3:
                out += [(path, n // 4, *held, True)] if len(held) == 4 else parts()
                held = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in parts()], t) for k, t in enumerate(kinds)], names=names)


def _decoded(df: DataFrame, kind: str) -> DataFrame:
    """Bytes as text, without a carriage return at the end and without what isn't UTF-8."""
    names = [x.split()[0] for x in kind.split(", ")]
    bad = r"(?s)[^\x00-\x7F\x{80}-\x{10FFFF}]|\x{FFFD}"
    text = lambda c: F.regexp_replace(F.rtrim(F.make_valid_utf8(F.col(c).cast("string")), F.lit("\r")), bad, "")
    return df.select(*[c if c in ("path", "index") else text(c).alias(c) for c in names])


def kept_ids(spark: SparkSession, paths: str | list[str], rule: str = "n1", **options) -> DataFrame:
    """path and read_id of all records; both mates of a pair are the same id under rules that cut their marks."""
    return fastq(spark, paths, index=False, **options).select("path", norm_id(F.col("header"), rule).alias("read_id"))


def labels(spark: SparkSession, path: str, rule: str | None = "n1", label_rule: str = "exact", first_tab_only: bool = False) -> DataFrame:
    """read_id, label, is_host, line_no of ``id<TAB>label`` lines. Lines of other than two fields are dropped, or
    with ``first_tab_only`` all after the first tab is the label."""
    rows = lines(spark, path).withColumn("value", F.col("value").cast("string"))
    p = F.split("value", "\t", 2 if first_tab_only else -1)
    rows = rows.withColumn("p", p).filter(F.size("p") == 2).select(F.col("p")[0].alias("id"), F.col("p")[1].alias("label"), "line_no")
    read = F.col("id") if rule is None else norm_id(F.col("id"), rule, header=False)
    return rows.select(read.alias("read_id"), "label", F.coalesce(is_host(F.col("label"), label_rule), F.lit(False)).alias("is_host"), "line_no")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at))


def table(spark: SparkSession, path: str, schema: str, optional: bool = False, header: bool = True, sep: str = ",") -> DataFrame:
    """A CSV table under a schema; an optional one that isn't there is empty."""
    if optional and not exists(spark, path):
        return spark.createDataFrame([], StructType.fromDDL(schema))
    return spark.read.schema(schema).option("header", header).option("sep", sep).option("enforceSchema", "true").csv(path)


def first_table(spark: SparkSession, paths: list[str], schema: str) -> DataFrame | None:
    """The first of several that is there and has rows."""
    for p in paths:
        df = table(spark, p, schema, optional=True)
        if not df.isEmpty():
            return df
    return None


#: The fields of a performance row.
PERFORMANCE = ("tool", "dataset", "rep", "runtime_seconds", "max_memory_kb", "timestamp")


def performance(spark: SparkSession, path: str) -> DataFrame:
    """Performance rows repaired by their number of fields: six as they stand; five lack ``rep``, which is 1; seven
    have an empty field after memory; three or four are failures. Numbers that aren't are NULL, and ``status`` is
    ``FAILED`` where the runtime says so."""
    rows = spark.read.text(path).filter("trim(value) <> ''").withColumn("p", F.split("value", ",")).filter(F.trim(F.col("p")[0]) != "tool")
    n = F.size("p")
    at = lambda k: F.get(F.col("p"), F.lit(k))
    rep_known = number(at(2)).isNotNull() & ((n != 5) | (F.upper(at(3)) == "FAILED"))
    shift = F.when(rep_known, 0).otherwise(1)
    get = lambda k: F.get(F.col("p"), F.lit(k) - shift)
    return rows.select(
        at(0).alias("tool"), at(1).alias("dataset"), F.when(rep_known, number(at(2)).cast("int")).otherwise(1).alias("rep"), seconds(get(3)).alias("runtime_seconds"), number(get(4)).cast("bigint").alias("max_memory_kb"),
        F.try_to_timestamp(F.when(n == 7, at(6)).otherwise(F.when(n >= 5, F.element_at("p", -1)))).alias("timestamp"), F.when(F.upper(get(3)) == "FAILED", "FAILED").otherwise("OK").alias("status"),
    )


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Rows of tool, dataset, rep, metric, value; a header line among them is dropped."""
    return table(spark, path, "tool string, dataset string, rep string, metric string, value string", header=False).filter("tool <> 'tool'").withColumns({"rep": number(F.col("rep")).cast("int"), "value": number(F.col("value"))})


def time_log(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, runtime_seconds and max_memory_kb of resource logs."""
    text = spark.read.text(paths, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    return text.select("path", seconds(group(F.col("value"), r"Elapsed \(wall clock\) time.*?: ([0-9:.]+)\s")).alias("runtime_seconds"), group(F.col("value"), r"Maximum resident set size \(kbytes\): (\d+)").try_cast("bigint").alias("max_memory_kb"))


def tool_log(spark: SparkSession, paths: str | list[str], fields: list[str], last: bool = True) -> DataFrame:
    """path and the last (or first) value of each field in a log's lines, quoted as ``name="value"``, without colours; NULL
    if none."""
    text = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), strip_ansi(F.col("value")).alias("v"))
    find = lambda f: F.regexp_extract_all("v", F.lit(field_pattern(f)), F.lit(1))
    return text.select("path", *[F.try_element_at(find(f), F.lit(-1 if last else 1)).alias(f) for f in fields])


def profile(spark: SparkSession, path: str) -> DataFrame:
    """name and fraction_total_reads of a tab-separated profile; empty if it lacks them."""
    df = spark.read.option("header", True).option("sep", "\t").csv(path)
    if not {"name", "fraction_total_reads"} <= set(df.columns):
        return spark.createDataFrame([], "name string, fraction_total_reads double")
    return df.select("name", number(F.col("fraction_total_reads")).alias("fraction_total_reads"))


def metadata(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """JSON objects or arrays of them, one or more a file; keys that are missing are NULL."""
    return spark.read.schema(schema).option("multiLine", True).json(paths)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lengths of what lies between headers, of lines that come in order within each part of a file: ``place`` is 0 for a part's
    lines before its first header, 1 for its last contig, which may go on in the next part, and NULL for all others."""
    names, held = ["path", "part", "place", "contig_id", "length"], None
    for b in batches:
        if not b.num_rows:
            continue
        path, part, contig, n = (b.column(c) for c in ("path", "part", "contig_id", "n"))
        head, at = contig.is_valid().to_numpy(zero_copy_only=False), part.to_numpy()
        new = np.ones(len(at), bool)
        new[0] = held is None or held[:2] != [path[0].as_py(), at[0]]
        new[1:] = (at[1:] != at[:-1]) | pc.not_equal(path.slice(1), path.slice(0, len(at) - 1)).to_numpy(zero_copy_only=False)
        n, starts = np.where(head, 0, n.to_numpy()).astype(np.int64), np.flatnonzero(new | head)
        if held is not None:
            held[3] += int(n[: starts[0] if len(starts) else len(n)].sum())
        if not len(starts):
            continue
        over, length, taken = new[starts], np.add.reduceat(n, starts), pa.array(starts)
        columns = [path.take(taken), part.take(taken), contig.take(taken), pa.array(length)]
        if held is not None:
            columns = [pa.concat_arrays([pa.array([x], c.type), c]) for x, c in zip(held, columns, strict=True)]
        else:
            over = over[1:]
        held = [c[-1].as_py() for c in columns]
        path, part, contig, length = (c.slice(0, len(c) - 1) for c in columns)
        place = np.where(contig.is_valid().to_numpy(zero_copy_only=False), 1, 0)
        yield pa.RecordBatch.from_arrays([path, part, pa.array(place, pa.int32(), mask=(place == 1) & ~over), contig, length], names=names)
    if held is not None:
        path, part, contig, length = ([x] for x in held)
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((path, part, [int(contig != [None])], contig, length), kinds, strict=True)], names=names)


def fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, contig_id and length of each record, in whatever part of a file its lines are. A line belongs to the last
    header before it. Each part is summed where it is read, in one scan, and a row for each record in it is written; only
    what lies at the parts' ends, two rows each at most, is put together across them."""
    value = F.trim(F.col("value"))
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("part"), F.when(value.startswith(">"), F.regexp_extract(value, r"^>(\S*)", 1)).alias("contig_id"), F.length(value).alias("n"))
    kind, at = "path string, part long, place int, contig_id string, length long", scratch(spark)
    lines.mapInArrow(_spans, kind).write.parquet(at)
    spans = spark.read.schema(kind).parquet(at)
    upto = Window.partitionBy("path").orderBy("part", "place").rowsBetween(Window.unboundedPreceding, 0)
    ends = spans.filter("place IS NOT NULL").withColumn("head", F.count("contig_id").over(upto)).filter("head > 0")
    joined = ends.groupBy("path", "head").agg(F.max("contig_id").alias("contig_id"), F.sum("length").alias("length"))
    return spans.filter("place IS NULL").select("path", "contig_id", "length").unionByName(joined.drop("head"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no, sample, r1, r2 of lines split at white space; comments and blank lines are skipped; r2 may be missing."""
    p = F.split(F.trim("value"), r"\s+")
    return lines(spark, path).withColumn("value", F.col("value").cast("string")).filter("trim(value) <> '' AND NOT startswith(trim(value), '#')").select("path", "line_no", p[0].alias("sample"), F.get(p, F.lit(1)).alias("r1"), F.get(p, F.lit(2)).alias("r2"))


def catalog(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """path, name, parent, rep, size and changed of all files under ``root``; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        files = files.option("pathGlobFilter", glob)
    p = F.split("path", "/")
    return files.load(root).select("path", F.element_at(p, -1).alias("name"), F.element_at(p, -2).alias("parent"), group(F.col("path"), r"rep_(\d+)").try_cast("int").alias("rep"), F.col("length").alias("size"), F.col("modificationTime").alias("changed"))


def completed(files: DataFrame, flag: str = "completed.flag") -> DataFrame:
    """Files of folders that have the flag."""
    return files.join(files.filter(F.col("name") == flag).select("parent").distinct(), "parent", "left_semi")


def tools(files: DataFrame) -> DataFrame:
    """Folder names that stand for tools."""
    return files.select("parent").distinct().filter("NOT startswith(parent, '.') AND parent NOT IN ('metrics', 'logs')")


def paired(files: DataFrame) -> DataFrame:
    """parent and whether it has files of both mates."""
    return files.groupBy("parent").agg((F.bool_or(F.col("name").rlike(r"_R?1\.f")) & F.bool_or(F.col("name").rlike(r"_R?2\.f"))).alias("paired"))


def two_row_header(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A table whose header has two rows, as one of flat names ``upper_lower``: an empty upper cell repeats the one before it,
    an empty lower one adds nothing. Values are text; the header is all that reaches the driver."""
    rows = lines(spark, path).withColumn("value", F.col("value").cast("string"))
    upper, lower = ([x.strip() for x in r.value.split(sep)] for r in rows.filter("line_no < 2").orderBy("line_no").collect())
    names, over = [], ""
    for a, b in zip(upper, lower, strict=True):
        over = a or over
        names.append(f"{over}_{b}" if b else over)
    p = F.split("value", sep, -1)
    return rows.filter("line_no > 1 AND trim(value) <> ''").select(*[F.nullif(F.trim(F.get(p, F.lit(k))), F.lit("")).alias(n) for k, n in enumerate(names)])


def artifacts(files: DataFrame, extensions: tuple[str, ...] = (".png", ".svg", ".pdf", ".tiff")) -> DataFrame:
    """Names of files with one of the extensions, in any case of letters, sorted."""
    name = F.lower("name")
    return files.filter(reduce(lambda a, b: a | b, [name.endswith(e) for e in extensions])).select("name").orderBy("name")


def run_sizes(files: DataFrame, by: list[str]) -> DataFrame:
    """Files and bytes of each run."""
    return files.groupBy(*by).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
