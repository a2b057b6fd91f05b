"""A directory tree as a table of files: a Python data source, registered as "filetree".

Every regular file counts, hidden and empty ones too, whatever its name; one that can't be read is left out. seq ascends with the sorted
path (with gaps), so a scan's order doesn't depend on the file system. The driver opens the upper folders only, until there are enough
parts; what lies below is listed on the executors, folder by folder. Content is hashed on the executors up to 5,000,000 bytes, and text
read up to 3,000,000, in one pass over the file; content itself is never a column.
"""

from __future__ import annotations

import hashlib
import mimetypes
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from shelfwright.functions import text as tx
from shelfwright.functions.fingerprint import with_phash
from shelfwright.session import ship
from shelfwright.sources import extract

HASH_LIMIT = 5_000_000
SCHEMA = "seq long, id string, path string, size long, mtime double, type string, hash string, text string"
PER_PARTITION = 512
PARTS = 256  # folders and blocks of files after which the driver opens no further level
#: One copy of the standard table of types, so that results don't depend on the host's files.
TYPES = mimetypes.MimeTypes(filenames=())


def mime_of(path: str) -> str:
    return TYPES.guess_type(path)[0] or "application/octet-stream"


def sha256_of(path: str, limit: int = HASH_LIMIT) -> str | None:
    """SHA-256 of a file's content; none over the limit or where it can't be read."""
    try:
        if os.path.getsize(path) > limit:
            return None
        digest = hashlib.sha256()
        with open(path, "rb") as f:
            while part := f.read(1 << 20):
                digest.update(part)
        return digest.hexdigest()
    except OSError:
        return None


def entries(folder: str) -> list[tuple[str, bool]]:
    """(path, whether it is a folder) of what a folder holds, so ordered that all paths below come in order; links to folders are left out."""
    out = []
    try:
        with os.scandir(folder) as found:
            for e in found:
                if e.is_dir(follow_symlinks=False):
                    out.append((e.path + os.sep, True))
                elif os.path.isfile(e.path):
                    out.append((e.path, False))
    except OSError:
        pass
    return sorted(out)


def below(path: str, folder: bool) -> Iterator[str]:
    """The files of a part in order, one folder's entries in memory a level."""
    if not folder:
        yield path
        return
    for p, is_folder in entries(path):
        yield from below(p, is_folder)


class Parts(InputPartition):
    """Some entries of the tree, next to each other in order."""

    def __init__(self, number: int, parts: list[tuple[str, bool]]):
        super().__init__((number, parts))
        self.number, self.parts = number, parts


class TreeReader(DataSourceReader):
    def __init__(self, root: str, with_text: bool):
        self.root, self.with_text = root, with_text

    def partitions(self) -> list[Parts]:
        parts = entries(self.root)
        while len(parts) < PARTS and any(folder for _, folder in parts):
            parts = [x for p, folder in parts for x in (entries(p) if folder else [(p, False)])]
        blocks: list[list[tuple[str, bool]]] = []
        for p in parts:  # a folder for itself, files in blocks
            if p[1] or not blocks or blocks[-1][0][1] or len(blocks[-1]) == PER_PARTITION:
                blocks.append([])
            blocks[-1].append(p)
        return [Parts(n, b) for n, b in enumerate(blocks)] or [Parts(0, [])]

    def read(self, partition: Parts) -> Iterator[tuple]:
        paths = (os.path.normpath(p) for part in partition.parts for p in below(*part))
        for i, p in enumerate(paths):
            try:
                st = os.stat(p)
            except OSError:
                continue
            mime = mime_of(p)
            text = extract.text_of(p, mime) if self.with_text else None
            yield ((partition.number << 40) + i, hashlib.md5(p.encode("utf-8", "surrogateescape")).hexdigest(), p, st.st_size, st.st_mtime, mime, sha256_of(p), text)


class FileTree(DataSource):
    """Options: path (the root), text ("true" to extract texts)."""

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["path"], self.options.get("text", "true").lower() == "true")


def image_fingerprints(files: DataFrame) -> DataFrame:
    """(seq, id, fp) of the images among files that can be read; paths are opened on the executors."""
    ship(files.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            pdf = pdf.assign(pixels=[extract.luma(p) for p in pdf["path"]])
            yield pdf[pdf["pixels"].notna()][["seq", "id", "pixels"]]

    images = files.where(tx.suffix(tx.basename("path")).isin(*tx.IMAGE_EXTENSIONS)).select("seq", "id", "path")
    return with_phash(images.mapInPandas(run, "seq long, id string, pixels array<double>"), "pixels").select("seq", "id", "fp")


def scan(spark: SparkSession, root: str, text: bool = True) -> DataFrame:
    """(seq, id, path, size, mtime, type, hash, text) of a tree that all executors see."""
    ship(spark)
    spark.dataSource.register(FileTree)
    return spark.read.format("filetree").option("text", str(text).lower()).load(root)
