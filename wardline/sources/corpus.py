"""Source trees and archives as rows."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks, text

# Fixed values.
PYTHON_EXTENSIONS = (".py",)
SCRIPT_EXTENSIONS = (".js", ".jsx", ".ts", ".tsx", ".mjs")
MEMBERS = "archive string, name string, size bigint, compressed bigint, depth int, content binary, error string"
ARROW_MEMBERS = pa.schema(
    [
        ("archive", pa.string()),
        ("name", pa.string()),
        ("size", pa.int64()),
        ("compressed", pa.int64()),
        ("depth", pa.int32()),
        ("content", pa.binary()),
        ("error", pa.string()),
    ]
)
#: What a damaged, encrypted or oversized archive or member raises.
BROKEN = (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError, ValueError, OSError)
BATCH_BYTES = 8 << 20
BATCH_ROWS = 5000


def load_corpus(
    spark: SparkSession, root: str, extensions: Sequence[str] = PYTHON_EXTENSIONS + SCRIPT_EXTENSIONS
) -> DataFrame:
    """Files below a folder by extension; bytes that are not UTF-8 are replaced.

    Script files below dot folders or ``node_modules`` are left out. Names are
    filtered before the contents are read. Spark's reader passes over names that
    start with a dot or an underscore, which source trees are full of
    (``__init__.py``); these few are listed and read apart. Name the scheme in
    ``root`` unless it is a local path.
    """
    patterns = [_glob(ext) for ext in extensions]
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "{" + ",".join(patterns) + "}" if len(patterns) > 1 else patterns[0])
        .load(root)
    )
    seen = files.withColumn("_root", F.lit(root.rstrip("/"))).select(
        F.regexp_replace(F.expr("substring(path, instr(path, _root) + length(_root))"), "^/+", "").alias("rel"),
        "content",
    )
    rows = seen.unionByName(_passed_over(spark, root, patterns))
    folder = F.regexp_extract("rel", r"^(.*)/[^/]*$", 1)
    hidden = folder.rlike(r"(?:^|/)(?:\.[^/]*|node_modules)(?:/|$)")
    script = F.col("rel").rlike(r"(?i)\.(?:js|jsx|ts|tsx|mjs)$")
    return rows.where(~(script & hidden)).select(F.col("rel").alias("file_path"), decode(F.col("content")).alias("content"))


def _glob(extension: str) -> str:
    """Script extensions count in any case, others as written."""
    if extension not in SCRIPT_EXTENSIONS:
        return f"*{extension}"
    return "*" + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in extension)


def _is_passed_over(name: str) -> bool:
    """Spark's rule for names it does not list."""
    kept = name.startswith(("_metadata", "_common_metadata"))
    return not kept and (name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name))


def _passed_over(spark: SparkSession, root: str, patterns: Sequence[str]) -> DataFrame:
    system, base = fs.FileSystem.from_uri(root)
    found = []
    for info in system.get_file_info(fs.FileSelector(base, recursive=True)):
        rel = info.path[len(base.rstrip("/")) + 1 :]
        wanted = info.is_file and any(fnmatchcase(info.base_name, p) for p in patterns)
        if wanted and any(map(_is_passed_over, rel.split("/"))):
            found.append((rel,))
    names = spark.createDataFrame(found, "rel string")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, folder = fs.FileSystem.from_uri(root)
        for batch in batches:
            for rel in batch.column(0).to_pylist():
                with source.open_input_stream(f"{folder.rstrip('/')}/{rel}") as stream:
                    yield pa.RecordBatch.from_pydict({"rel": [rel], "content": [stream.read()]})

    return names.mapInArrow(read, "rel string, content binary")


def spread(files: DataFrame) -> DataFrame:
    """At least one partition per core for a detector that is bound by computing.

    Only a scan with fewer partitions than cores is redistributed, that is one
    of a few files; a corpus of many files is never shuffled. Meant for plain
    scans, whose partitions are known without running anything.
    """
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(cores) if files.rdd.getNumPartitions() < cores else files


def decode(content: Column) -> Column:
    """UTF-8 text with invalid bytes replaced."""
    return F.make_valid_utf8(content.cast("string"))


def derive_code_files(raw: DataFrame, language: str | None = None) -> DataFrame:
    """Name, extension, language, size and line count from path and content."""
    name = F.substring_index("file_path", "/", -1)
    ext = checks.suffix_of(F.col("file_name"))
    return raw.withColumns({"file_name": name}).withColumns(
        {
            "file_extension": ext,
            "language": F.lit(language) if language else F.regexp_replace(ext, r"^\.", ""),
            "file_size": F.octet_length("content"),
            "line_count": text.line_count(F.col("content")),
        }
    )


def _members_of(archive: str, blob: bytes) -> Iterator[dict]:
    try:
        with zipfile.ZipFile(io.BytesIO(blob)) as box:
            for info in box.infolist():
                row = {
                    "archive": archive,
                    "name": info.filename,
                    "size": info.file_size,
                    "compressed": info.compress_size,
                    "depth": info.filename.count("/"),
                }
                try:
                    if info.file_size > checks.MAX_ARCHIVE_BYTES:
                        raise ValueError(f"member of {info.file_size} bytes is beyond the limit of an archive")
                    row["content"] = None if info.is_dir() else box.read(info)
                except BROKEN as exc:
                    row["error"] = str(exc)
                yield row
    except BROKEN as exc:
        yield {"archive": archive, "error": str(exc)}


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[dict] = []
    held = 0
    for batch in batches:
        for archive, blob in zip(*(column.to_pylist() for column in batch.columns)):
            for row in _members_of(archive, blob):
                rows.append(row)
                held += row.get("size") or 0
                if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=ARROW_MEMBERS)
                    rows, held = [], 0
    yield pa.RecordBatch.from_pylist(rows, schema=ARROW_MEMBERS)


def archive_members(archives: DataFrame) -> DataFrame:
    """One row per member of every zip in ``archive, content``; a broken zip gives an error row.

    A damaged, encrypted or oversized member has its error instead of content, and
    the other members of its archive are read.
    """
    return archives.select("archive", "content").mapInArrow(_members, MEMBERS)


def expand_archives(archives: DataFrame) -> DataFrame:
    """Code files of the archives: unsafe and disallowed names and unreadable members are dropped.

    ``archive_members`` reports what could not be read.
    """
    members = archive_members(archives).where(F.col("name").isNotNull() & F.col("error").isNull() & ~F.col("name").endswith("/"))
    allowed = checks.suffix_of(F.col("name")).isin(checks.ALLOWED_EXTENSIONS)
    safe = ~(F.col("name").startswith("/") | F.col("name").contains(".."))
    return members.where(safe & allowed).select(
        "archive", F.col("name").alias("file_path"), decode(F.col("content")).alias("content")
    )


def load_archives(spark: SparkSession, root: str) -> DataFrame:
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.zip")
        .load(root)
    )
    return files.select(F.col("path").alias("archive"), "content")
