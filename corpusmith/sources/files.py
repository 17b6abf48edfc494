"""JSON-lines sources and sinks with explicit schemas, in file order, resumable by batch."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import socket
import stat
import tarfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from operator import or_
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..errors import SetupError


def _file_name():
    """A file's name after that of its block's folder, if it is in one."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"((?:block=\d+/)?[^/]+)$", 1)


def read_jsonl(spark: SparkSession, path: str, schema: str, numbered: bool = False) -> DataFrame:
    """Records of one file or folder with blocks (plain or gzip), and file_name, the lexicographic order in which later
    records replace earlier ones. Blank lines, lines that are not JSON and records without any of the fields are dropped.

    ``numbered`` gives ``line`` too, a record's place in its file, the same on every reading. Files are then read whole,
    one to a task at a time: it is for batches such as a fetch writes."""
    if numbered:
        whole = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).withColumn("file_name", _file_name())
        lines = whole.select("file_name", F.posexplode(F.split("value", "\n")).alias("line", "value")).filter(F.trim("value") != "")
        rows = lines.select(F.from_json("value", schema).alias("_r"), "file_name", "line").select("_r.*", "file_name", "line")
    else:
        rows = spark.read.option("recursiveFileLookup", True).schema(schema).json(path).withColumn("file_name", _file_name())
    some = reduce(or_, [F.col(c).isNotNull() for c in rows.columns if c not in ("file_name", "line")])
    return rows.filter(some)


def write_block(df: DataFrame, out: str, first: int = 0, last: int = 99_999) -> int:
    """Write records as the next block of a range of blocks under ``out`` and give its number. Blocks are read in order,
    so what a later range of numbers holds replaces what earlier ones do."""
    spark = df.sparkSession
    place, system = hadoop(spark, out)
    names = [str(s.getPath().getName()) for s in system.listStatus(place)] if system.exists(place) else []
    there = [n for n in (int(x[6:]) for x in names if x.startswith("block=") and x[6:].isdigit()) if first <= n <= last]
    number = max(there, default=first - 1) + 1
    if number > last:
        raise SetupError(f"blocks {first} to {last} of {out} are full")
    df.write.option("compression", "gzip").json(f"{out}/block={number:05d}")
    return number


def write_jsonl(df: DataFrame, path: str, compression: str | None = None, mode: str = "overwrite") -> int:
    """Write records and give their number. The commit protocol shows files only when all are written."""
    counted = Observation("rows")
    writer = df.observe(counted, F.count("*").alias("n")).write.mode(mode)
    (writer.option("compression", compression) if compression else writer).json(path)
    return counted.get["n"]


def page_text(revisions="revisions"):
    """The wikitext of a raw page, null at any gap on the way."""
    return F.get(F.col(revisions), 0)["slots"]["main"]["content"]


def require_input(df: DataFrame | None, what: str, fix: str) -> DataFrame:
    """The input, or SetupError if it is missing or empty; to be called before anything is overwritten."""
    if df is None or df.isEmpty():
        raise SetupError(f"{what} is missing or empty; {fix}")
    return df


def read_table(spark: SparkSession, path: str, schema: str, what: str, fix: str) -> DataFrame:
    """A Parquet table that a builder must have made; readers never create one."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        raise SetupError(f"{what} was not found at {path}; {fix}") from error


def hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


@contextmanager
def replacing(spark: SparkSession, path: str) -> Iterator[str]:
    """A fresh folder beside ``path`` to write to. If the block ends well it takes the place of what is at ``path``, by
    renames; if it fails, what is there stays and the fresh folder goes."""
    fresh, old = (f"{path.rstrip('/')}.{kind}-{uuid.uuid4().hex[:8]}" for kind in ("new", "old"))
    (target, system), (new, _), (aside, _) = (hadoop(spark, p) for p in (path, fresh, old))
    try:
        yield fresh
        had = system.exists(target)
        if had and not system.rename(target, aside):
            raise SetupError(f"{path} could not be moved aside")
        if not system.rename(new, target):
            if had:
                system.rename(aside, target)
            raise SetupError(f"{path} could not be put in place; what was there stays")
        system.delete(aside, True)
    finally:
        system.delete(new, True)


def _owner_is_gone(system, place) -> bool:
    """Whether the lock's owner ran on this machine and has ended; of other machines' owners nothing is known."""
    try:
        stream = system.open(place)
        owner = json.loads(bytes(stream.readAllBytes()).decode() or "{}")
        stream.close()
    except Exception:  # gone meanwhile, or half written: its owner is at work
        return False
    if owner.get("host") != socket.gethostname() or not isinstance(owner.get("pid"), int):
        return False
    try:
        os.kill(owner["pid"], 0)
    except ProcessLookupError:
        return True
    except PermissionError:
        return False
    return False


@contextmanager
def run_lock(spark: SparkSession, path: str) -> Iterator[None]:
    """One run at a time over the tables under ``path``: SetupError while another holds the lock file, which is made in
    one step that fails if it is there and names its owner. The lock of an owner that ended on this machine without
    removing it is put aside, by a rename that only one of several runs can do, and taken."""
    place, system = hadoop(spark, f"{path.rstrip('/')}/.lock")

    def take() -> None:
        out = system.create(place, False)
        out.write(bytearray(json.dumps({"host": socket.gethostname(), "pid": os.getpid()}).encode()))
        out.close()

    try:
        take()
    except Exception as error:  # Hadoop's own FileAlreadyExistsException, by way of the gateway
        if not system.exists(place):
            raise
        aside, _ = hadoop(spark, f"{path.rstrip('/')}/.lock-{uuid.uuid4().hex[:8]}")
        if not _owner_is_gone(system, place) or not system.rename(place, aside):
            raise SetupError(f"another run is at work in {path} (or ended elsewhere without removing {place})") from error
        system.delete(aside, False)
        take()
    try:
        yield
    finally:
        system.delete(place, False)


def _members(archive: tarfile.TarFile | zipfile.ZipFile) -> Iterator[tuple[str, bool, bool]]:
    """(name, is a file, is a file or folder) of everything in a tar or zip archive."""
    if isinstance(archive, tarfile.TarFile):
        yield from ((m.name, m.isfile(), m.isfile() or m.isdir()) for m in archive.getmembers())
        return
    for m in archive.infolist():
        kind = stat.S_IFMT(m.external_attr >> 16)
        yield m.filename, not m.is_dir(), kind in (0, stat.S_IFREG, stat.S_IFDIR)


def extract_archive(archive: str, folder: str, sha256: str | None = None) -> int:
    """Unpack a local zip or tar archive and give the number of files, after its checksum, where one is given, was found
    right. Members that would be written outside the folder, and all that are neither files nor folders, are refused
    before anything is written; the folder appears whole or not at all."""
    source, target = Path(archive), Path(folder)
    with source.open("rb") as data:
        if sha256 is not None and hashlib.file_digest(data, "sha256").hexdigest() != sha256.lower():
            raise SetupError(f"{archive} does not have the checksum that it should have")
    with tarfile.open(source) if tarfile.is_tarfile(source) else zipfile.ZipFile(source) as opened:
        members = list(_members(opened))
        for name, _, plain in members:
            if not plain or not (target / name).resolve().is_relative_to(target.resolve()):
                raise SetupError(f"{name!r} of {archive} has no place in {folder}")
        part = target.with_name(f"{target.name}.part-{uuid.uuid4().hex[:8]}")
        try:
            opened.extractall(part, **({"filter": "data"} if isinstance(opened, tarfile.TarFile) else {}))
            part.rename(target)
        finally:
            shutil.rmtree(part, ignore_errors=True)
    return sum(is_file for _, is_file, _ in members)


def missing_batches(n_titles: int, size: int, last_done: int) -> int:
    """Batches that a fetch has still to do; last_done is -1 before the first."""
    return max(0, -(-n_titles // size) - (last_done + 1))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """path and SHA-256 of every file, for release checks."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
