"""Sources: delimited files in several encodings and header spellings, line lists, rule and cooldown files, run summaries.

Paths are paths of any Hadoop file system: files, folders or patterns.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import jst_time, pick
from ..functions.urls import clean_domain, is_web_url, strip

ENCODINGS = ("utf-8", "cp932", "shift_jis")
FILE = "_source_file"


def listed(spark: SparkSession, path: str) -> list[str]:
    """The files behind a path, in order: a file, a folder with all below it, or a pattern; names that begin with _ or . don't count."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    out: list[str] = []
    for status in fs.globStatus(at) or []:
        found = fs.listFiles(status.getPath(), True) if status.isDirectory() else None
        while found is not None and found.hasNext():
            file = found.next().getPath()
            inside = file.toString()[len(status.getPath().toString()) :].split("/")
            if not any(x.startswith(("_", ".")) for x in inside):
                out.append(file.toString())
        if found is None and not status.getPath().getName().startswith(("_", ".")):
            out.append(status.getPath().toString())
    return sorted(set(out))


def _literal(path: str) -> str:
    """A path without the meaning of pattern signs."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def _hadoop_path(spark: SparkSession, uri: str) -> str:
    return spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(uri)).toString()


def encodings_of(spark: SparkSession, files: Sequence[str], encodings: Sequence[str] = ENCODINGS) -> dict[str, str]:
    """The first of ``encodings`` in which the whole of each file is valid text; ValueError names files for which there is none.

    Executors check line by line: bytes of line ends stand for themselves in all these encodings.
    """
    if not files:
        return {}
    lines = spark.read.text([_literal(f) for f in files]).select(F.col("_metadata.file_path").alias("file"), "value")
    sound = {_hadoop_path(spark, r.file): r.ok for r in lines.groupBy("file").agg(F.min(F.is_valid_utf8("value")).alias("ok")).collect()}  # one row for each file
    out = {f: "utf-8" for f in files if sound.get(f, True)}
    others, rest = [f for f in files if f not in out], [e for e in encodings if not e.startswith("utf-8")]
    if not others:
        return out

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            failed: set[tuple[str, str]] = set()
            for file, line in zip(b.column("file").to_pylist(), b.column("value").to_pylist()):
                for e in rest:
                    try:
                        (line or b"").decode(e)
                    except UnicodeDecodeError:
                        failed.add((file, e))
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in failed], pa.string()), pa.array([e for _, e in failed], pa.string())], names=["file", "encoding"])

    lines = spark.read.text([_literal(f) for f in others]).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    failed = {(_hadoop_path(spark, r.file), r.encoding) for r in lines.mapInArrow(check, "file string, encoding string").distinct().collect()}  # files x encodings
    for f in others:
        fit = next((e for e in rest if (f, e) not in failed), None)
        if fit is None:
            raise ValueError(f"{f} is not valid text in any of {', '.join(encodings)}")
        out[f] = fit
    return out


def header_of(spark: SparkSession, file: str, encoding: str, delimiter: str = ",") -> list[str]:
    """Column names of a file: its first record without BOM; blank names are numbered, repeated ones get a number."""
    at = spark._jvm.org.apache.hadoop.fs.Path(file)
    stream = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).open(at)
    try:
        data = ""
        while (line := stream.readLine()) is not None:  # a letter for each byte
            data += line + "\n"
            if data.count('"') % 2 == 0 and data.strip():
                break
    finally:
        stream.close()
    text = data.encode("latin-1").decode(encoding).replace("\ufeff", "")
    names: list[str] = []
    for i, n in enumerate(next(csv.reader(io.StringIO(text.lstrip("\n"), newline=""), delimiter=delimiter), [])):
        name = n or f"column_{i + 1}"
        names.append(name if name not in names else f"{name}_{i + 1}")
    return names


def _read(spark: SparkSession, files: Sequence[str], delimiter: str) -> DataFrame | None:
    """The rows of all files with ``_source_file``; files with equal encoding and header are one scan; columns are united by name."""
    groups: dict[tuple[str, tuple[str, ...]], list[str]] = {}
    for f, encoding in encodings_of(spark, files).items():
        if header := tuple(header_of(spark, f, encoding, delimiter)):
            groups.setdefault((encoding, header), []).append(f)
    out = None
    for (encoding, header), members in sorted(groups.items(), key=lambda x: x[1][0]):
        paths = [_literal(f) for f in members]
        if encoding == "utf-8":
            raw = spark.read.schema(", ".join(f"_c{i} string" for i in range(len(header)))).option("header", True).option("multiLine", True).option("escape", '"').option("delimiter", delimiter).csv(paths)
            one = raw.select(F.col("_metadata.file_path").alias(FILE), *raw.columns).toDF(FILE, *header)
        else:
            one = _decoded_csv(spark, paths, encoding, header, delimiter)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] = (), delimiter: str = ",") -> DataFrame:
    """Delimited text files as strings: the encoding of each whole file is told by itself, BOMs leave the header, and files with different columns are united by name.

    A missing path, or one without any record, is an empty table with ``columns``; a file that is
    no valid text raises ValueError instead of losing characters.
    """
    out = _read(spark, listed(spark, path), delimiter)
    if out is None:
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns) or "`value` string")
    return out.drop(FILE)


def _decoded_csv(spark: SparkSession, paths: list[str], encoding: str, header: Sequence[str], delimiter: str) -> DataFrame:
    """Files in an encoding that the reader of Spark refuses: the task that reads one decodes and parses it, record by record."""
    names = [FILE, *header]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(file: str, rows: list[list]) -> pa.RecordBatch:
            columns = [[file] * len(rows), *zip(*rows)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=names)

        for b in batches:
            for file, content in zip(b.column("path").to_pylist(), b.column("content")):
                records = csv.reader(io.TextIOWrapper(io.BytesIO(content.as_py()), encoding=encoding, newline=""), delimiter=delimiter)
                held: list[list] = []
                head = False
                for r in records:
                    if not r:
                        continue
                    if not head:
                        head = True
                        continue
                    held.append([v or None for v in (r + [""] * len(header))[: len(header)]])
                    if len(held) == 10_000:
                        yield batch(file, held)
                        held = []
                if held:
                    yield batch(file, held)

    kinds = ", ".join(f"`{c.replace('`', '``')}` string" for c in names)
    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, kinds)


def read_many(spark: SparkSession, paths: Sequence[str], delimiter: str = ",") -> DataFrame:
    """Union of files (or folders, or patterns) with different columns; ``file_no`` is a file's place by name and orders later files after earlier ones."""
    files = sorted({f for p in paths for f in listed(spark, p)}, key=lambda f: (f.rsplit("/", 1)[-1], f))
    out = _read(spark, files, delimiter)
    if out is None:
        return spark.createDataFrame([], "file_no int")
    bare = lambda c: F.regexp_replace(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), r"^([a-z0-9+.\-]+):/+", "$1:/")
    place = spark.createDataFrame([(re.sub(r"^([a-z0-9+.\-]+):/+", r"\1:/", f), i) for i, f in enumerate(files)], "_file string, file_no int")
    return out.withColumn("_file", bare(F.col(FILE))).join(place, "_file", "left").drop("_file", FILE)


def read_manifest(spark: SparkSession, path: str, column: str) -> list[str]:
    """The different values of a column of a tab-separated manifest, which is kept by hand, in order."""
    held = read_csv(spark, path, [column], delimiter="\t")
    return list(dict.fromkeys(v for (v,) in held.select(column).collect() if v and v.strip()))


def newest(spark: SparkSession, pattern: str, k: int) -> list[str]:
    """The last ``k`` files of a pattern by name, the newest first, as names carry their time."""
    return sorted(listed(spark, pattern), key=lambda f: (f.rsplit("/", 1)[-1], f), reverse=True)[:k]


def existing(spark: SparkSession, named: Sequence[str], more: str | None = None) -> tuple[list[str], list[str]]:
    """(inputs that exist, those that are missing) of named ones and of a list file, each once, in order."""
    every = [*named, *([r.value for r in read_lines(spark, more).collect()] if more and listed(spark, more) else [])]
    every = list(dict.fromkeys(x for x in every if x.strip()))
    held = [x for x in every if listed(spark, x)]
    return held, [x for x in every if x not in held]


def dimension(spark: SparkSession, groups: dict[str, Sequence[str]], group: str, member: str) -> DataFrame:
    """A dimension table ``group, member, ord`` of named lists, such as categories of businesses or cities of prefectures."""
    rows = [(g, m, i) for g, ms in groups.items() for i, m in enumerate(ms)]
    return spark.createDataFrame(rows, f"`{group}` string, `{member}` string, ord int")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a list without blank ones and comments: ``value``."""
    lines = spark.read.text(path).select(strip(F.col("value")).alias("value"))
    return lines.where("value <> '' and not startswith(value, '#')")


def read_blocklist(spark: SparkSession, path: str) -> DataFrame:
    """Domains of a list with comments: ``domain``."""
    domains = spark.read.text(path).select(clean_domain(F.substring_index("value", "#", 1)).alias("domain"))
    return domains.where("domain <> ''").distinct()


def read_cooldowns(spark: SparkSession, path: str, now: Column) -> DataFrame:
    """Domains still on hold by a JSON map ``domain -> {until, reason}``; without a valid time they are."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,struct<until:string,reason:string>>")).alias("domain", "hold"))
    until = F.coalesce(F.try_to_timestamp(F.col("hold.until")), jst_time(F.col("hold.until")))
    return whole.where(F.coalesce(until >= now, F.lit(True))).select(clean_domain(F.col("domain")).alias("domain"), until.alias("until"), "hold.reason")


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Blocks ``## name`` with lines ``- key: value`` of text reports: ``name, metrics``."""
    blocks = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"(?m)^## ")).alias("block"))
    pairs = F.transform(F.regexp_extract_all("block", F.lit(r"(?m)^[-*] ([^:\n]+: *[^\n]*)$"), F.lit(1)), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    named = blocks.select(F.trim(F.substring_index("block", "\n", 1)).alias("name"), pairs.alias("pairs")).where(F.size("pairs") > 0)
    return named.select("name", F.map_from_entries(F.transform(F.array_distinct(F.transform("pairs", lambda x: x["k"])), lambda k: F.struct(k, F.element_at(F.filter("pairs", lambda p: p["k"] == k), 1)["v"]))).alias("metrics"))


def urls_of(df: DataFrame, names: Sequence[str] = ("URL", "url", "website", "final_url", "最終URL")) -> DataFrame:
    """Web addresses of a table whose header is unknown: the named columns, else the first cell of a row that is one."""
    picked = pick(df, names)
    cells = F.filter(F.array(*[strip(F.col(f"`{c}`").cast("string")) for c in df.columns]), is_web_url)
    return df.select(F.coalesce(F.when(is_web_url(picked), picked), F.try_element_at(cells, F.lit(1))).alias("url")).where("url is not null")


def load_config(path: str) -> dict:
    """A search configuration: either a list of queries or layers of templates; raises ValueError for neither."""
    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    if not config.get("queries") and not config.get("layers"):
        raise ValueError("a configuration needs queries or layers")
    return config
