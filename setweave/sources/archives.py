"""ZIP archives: member lists, JSON members, and extraction of the members that are referenced.

An archive of any size is read by ranges of its bytes: a task opens it, reads its directory from the tail, and
unpacks the members that begin in its range, so tasks share an archive and none holds it. Paths are opened by
pyarrow's file systems (local and mounted folders, S3, GCS, HDFS); in another store that only Spark reads, an archive
is a row of `binaryFile`, of 2 GB at most. Folders, `__MACOSX` and `._` members are skipped. Files that are no ZIP
archive raise; damaged members are rows with a `problem`.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of an archive whose members one task unpacks.
RANGE_BYTES = 64 << 20
BATCH_BYTES = 32 << 20
MEMBER = "archive string, entry string, basename string, crc32 long, size long"
CONTENT = MEMBER + ", content binary, problem string"


def _listed(zf: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    names = [(i, i.filename.rpartition("/")[2]) for i in zf.infolist() if not i.is_dir()]
    return [i for i, base in names if not base.startswith("._") and "__MACOSX" not in i.filename.split("/")]


def _row(archive: str, i: zipfile.ZipInfo) -> tuple:
    return archive, i.filename, i.filename.rpartition("/")[2], i.CRC, i.file_size


DAMAGED = (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError)


def _read(zf: zipfile.ZipFile, i: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
    """(content, problem) of a member."""
    try:
        return zf.read(i), None
    except DAMAGED as e:
        return None, f"unreadable member: {type(e).__name__}"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system of a path, and the path in it; a store that it does not know raises."""
    return fs.FileSystem.from_uri(path)


class Range(InputPartition):
    """The members of an archive that begin at lo or later, and before hi."""

    def __init__(self, path: str, lo: int, hi: int):
        self.path, self.lo, self.hi = path, lo, hi


class ZipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.suffix, self.unpack, self.step = options["path"], options.get("suffix", ""), options.get("unpack", "true") == "true", int(options.get("range", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        store, at = opened(self.path)
        info = store.get_file_info(at)
        if info.type == fs.FileType.Directory:
            found = sorted((x for x in store.get_file_info(fs.FileSelector(at)) if x.is_file and not x.base_name.startswith(("_", "."))), key=lambda x: x.path)
        elif info.type == fs.FileType.File:
            found = [info]
        else:
            raise FileNotFoundError(self.path)
        return [Range(x.path, lo, lo + self.step) for x in found for lo in range(0, max(1, x.size), self.step)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        names = ["archive", "entry", "basename", "crc32", "size", "content", "problem"][: 7 if self.unpack else 5]
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        told = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        rows, held = [], 0
        with opened(self.path)[0].open_input_file(part.path) as f, zipfile.ZipFile(f) as zf:
            for i in _listed(zf):
                if not part.lo <= i.header_offset < part.hi or not i.filename.lower().endswith(self.suffix):
                    continue
                content, problem = _read(zf, i) if self.unpack else (None, None)
                rows.append((*_row(part.path, i), content, problem)[: len(names)])
                held += len(content or b"")
                if held >= BATCH_BYTES or len(rows) >= 10_000:
                    yield told(rows)
                    rows, held = [], 0
        if rows:
            yield told(rows)


class ZipMembers(DataSource):
    """spark.read.format("zip_members").load(path); options suffix (lower case), unpack (false: the list alone), range (bytes a task)."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return CONTENT if self.options.get("unpack", "true") == "true" else MEMBER

    def reader(self, schema) -> ZipReader:
        return ZipReader(dict(self.options))


def _whole(suffix: str, unpack: bool):
    """The members of archives that come whole, as rows of binaryFile."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["archive", "entry", "basename", "crc32", "size", "content", "problem"][: 7 if unpack else 5]
        for b in batches:
            for path, data in zip(b["path"], b["content"]):
                rows, held = [], 0
                with zipfile.ZipFile(io.BytesIO(data)) as zf:
                    for i in _listed(zf):
                        if i.filename.lower().endswith(suffix):
                            content, problem = _read(zf, i) if unpack else (None, None)
                            rows.append((*_row(path, i), content, problem)[: len(names)])
                            held += len(content or b"")
                        if held >= BATCH_BYTES:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return read


def _scan(spark: SparkSession, path: str, suffix: str, unpack: bool, range_bytes: int) -> DataFrame:
    try:
        opened(path)
    except (pa.ArrowException, OSError):
        return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_whole(suffix, unpack), CONTENT if unpack else MEMBER)
    spark.dataSource.register(ZipMembers)
    return spark.read.format("zip_members").option("suffix", suffix).option("unpack", str(unpack).lower()).option("range", range_bytes).load(path)


def members(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(archive, entry, basename, crc32, size) from the archives' directories; nothing is unpacked."""
    return _scan(spark, path, "", False, range_bytes)


def contents(spark: SparkSession, path: str, suffix: str = "", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """members() with content and problem (null, or why content is null) of the entries that end in suffix (lower case)."""
    return _scan(spark, path, suffix, True, range_bytes)


def json_members(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(archive, entry, data, problem) of the .json members; what is not JSON of the schema is kept with its problem."""
    raw = contents(spark, path, ".json").withColumn("text", F.decode("content", "UTF-8"))
    data = F.from_json("text", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    raw = raw.withColumn("data", data)
    bad = F.col("problem").isNull() & (F.col("data").isNull() | F.col("data._corrupt").isNotNull())
    problem = F.when(bad, "malformed JSON").otherwise(F.col("problem"))
    return raw.select("archive", "entry", F.when(problem.isNull(), F.col("data").dropFields("_corrupt")).alias("data"), problem.alias("problem"))


def extract(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(basename, crc32, size, content, sha256) of the members named in wanted (basename); missing, unreadable or ambiguous ones raise."""
    names = wanted.select("basename").distinct()
    got = contents(spark, path).join(names, "basename", "left_semi")
    one = got.groupBy("basename").agg(F.count("*").alias("n"), F.max_by(F.struct("crc32", "size", "content", "problem"), "entry").alias("m"))
    j = names.join(one, "basename", "left")
    why = F.when(F.col("n").isNull(), "missing member ").when(F.col("n") > 1, "ambiguous member ").when(F.col("m.problem").isNotNull(), "unreadable member ")
    # the check is part of content, so that no plan that reads content can skip it
    content = F.when(why.isNotNull(), F.raise_error(F.concat(why, "basename")).cast("binary")).otherwise(F.col("m.content"))
    j = j.select("basename", "m.crc32", "m.size", content.alias("content"))
    return j.withColumn("sha256", F.sha2("content", 256))


def unchanged(extracted: DataFrame, held: DataFrame) -> DataFrame:
    """The rows of extracted whose sha256 is that in held (basename, sha256); a differing or unknown one raises."""
    h = held.select("basename", F.col("sha256").alias("held"))
    j = extracted.join(h, "basename", "left")
    same = F.col("held").eqNullSafe(F.col("sha256"))
    return j.withColumn("content", F.when(same, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("changed member "), "basename")).cast("binary"))).drop("held")
