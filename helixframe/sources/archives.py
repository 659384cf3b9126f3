"""Members of zip archives as rows, and cases out of archives of phenotype packets with the reasons of those left out."""

from __future__ import annotations

import zipfile
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from helixframe.sources import landed

PARTITION_BYTES = 32 << 20  #: compressed bytes of the members that one task reads
SCHEMA = "archive string, member string, value string, why string"


class Members(InputPartition):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names


def opened(path: str):
    """The archive, on any file system that Arrow knows; only its directory is read before a member is asked for."""
    import pyarrow.fs as fs

    system, where = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return zipfile.ZipFile(system.open_input_file(where))


def dealt(sizes: list[tuple[str, int]], most: int) -> list[list[str]]:
    """Names in runs of about `most` bytes, in the archive's order; a larger member is a run of its own."""
    out: list[list[str]] = []
    held = 0
    for name, size in sizes:
        if not out or held + size > most:
            out.append([])
            held = 0
        out[-1].append(name)
        held += size
    return out


class ZipReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.most = int(options.get("partitionBytes", PARTITION_BYTES))

    def partitions(self) -> list[Members]:
        with opened(self.path) as z:
            sizes = [(i.filename, i.compress_size) for i in z.infolist() if not i.is_dir() and i.filename.endswith(self.suffix)]
        return [Members(self.path, names) for names in dealt(sizes, self.most)]

    def read(self, partition: Members) -> Iterator[tuple]:
        """One member after the other; a member that can't be read gives its name and why."""
        with opened(partition.path) as z:
            for name in partition.names:
                try:
                    yield partition.path, name, z.read(name).decode("utf-8"), None
                except UnicodeDecodeError:
                    yield partition.path, name, None, "not UTF-8"
                except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError):
                    yield partition.path, name, None, "broken member"


class ZipMembers(DataSource):
    """`spark.read.format("zip_members").load(path)`: (archive, member, value, why).

    Options: `suffix` of the members to read, `partitionBytes`. Partitions are runs of members, so one archive is read by many
    tasks, and a task holds one member at a time.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZipReader:
        return ZipReader(self.options)


def read_members(spark: SparkSession, path: str, suffix: str = "", partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    spark.dataSource.register(ZipMembers)
    return spark.read.format("zip_members").option("suffix", suffix).option("partitionBytes", partition_bytes).load(path)


def cases(members: DataFrame) -> DataFrame:
    """(case, disease, diseases, present, excluded, n_present, why) of packets: `why` one isn't a case (null: it is).

    A case has a diagnosis and a present term; the first diagnosis is its disease. A case is called by its path below the archive's top folder.
    """
    p = landed.phenopackets(members.withColumnRenamed("why", "unread"))
    # Text that is no JSON object has no field at all; the parser can't tell it from a packet without content.
    spoiled = F.col("value").isNotNull() & F.try_parse_json("value").isNull()
    why = (
        F.when(F.col("unread").isNotNull(), F.col("unread")).when(spoiled, "not JSON").when(F.col("why").isNotNull(), F.col("why"))
        .when(F.size("diseases") == 0, "no diagnosis").when(F.size("present") == 0, "no present term")
    )
    name = F.regexp_replace("member", "^[^/]*/", "")
    return p.select(name.alias("case"), F.get("diseases", 0).alias("disease"), "diseases", "present", "excluded", F.size("present").alias("n_present"), why.alias("why"))


def skipped(found: DataFrame) -> DataFrame:
    """(why, n): packets left out, by reason."""
    return found.where("why IS NOT NULL").groupBy("why").agg(F.count("*").alias("n"))
