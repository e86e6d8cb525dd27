"""Files read in blocks: digests of files of any size, lines of block-compressed files, and files written from rows."""

from __future__ import annotations

import gzip
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

BLOCK = 8 << 20  # bytes held at a time
SPLIT = 32 << 20  # bytes of a file in a partition of lines, and of files in a partition of digests
LINES = 1 << 16  # lines in a batch
# fixed values of the block-compressed gzip format: first bytes, name of the field that holds a block's size
MAGIC, FIELD = b"\x1f\x8b\x08\x04", b"BC"
HEADER = 12


def _system(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a qualified path."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def listed_files(path: str) -> list[tuple[str, str, int]]:
    """Path, path below the root, bytes of every file that a table reader would see, in order of paths."""
    system, root = _system(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(info.path, info.base_name, info.size)]
    base = root.rstrip("/") + "/"
    found = ((f.path, f.path.removeprefix(base), f.size) for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File)
    seen = [(p, r, n) for p, r, n in found if not any(x.startswith(".") or x.startswith("_") and "=" not in x for x in r.split("/"))]
    return sorted(seen)


def open_file(root: str, path: str) -> pa.NativeFile:
    """A file that ``listed_files(root)`` gave, for reading at any place."""
    return _system(root)[0].open_input_file(path)


@dataclass
class _Group(InputPartition):
    files: list[tuple[str, str, int]]


@dataclass
class _Range(InputPartition):
    path: str
    kind: str  # blocks, gzip or plain
    start: int
    end: int


class _DigestReader(DataSourceReader):
    def __init__(self, root: str, split: int, block: int, opened: bool) -> None:
        self.root, self.split, self.block, self.opened = root, split, block, opened

    def partitions(self) -> list[_Group]:
        out: list[_Group] = []
        held = 0
        for f in listed_files(self.root):
            if not out or held + f[2] > self.split:
                out.append(_Group([]))
                held = 0
            out[-1].files.append(f)
            held += f[2]
        return out or [_Group([])]

    def read(self, partition: _Group) -> Iterator[tuple]:
        system, _ = _system(self.root)
        for path, relative, listed in partition.files:
            if not self.opened:
                yield relative, listed, None
                continue
            digest, size = hashlib.sha256(), 0
            with system.open_input_stream(path) as stream:
                while piece := stream.read(self.block):
                    digest.update(piece)
                    size += len(piece)
            yield relative, size, digest.hexdigest()


class FileDigests(DataSource):
    """Rows (relative_path, bytes, sha256); a file passes through its task in blocks and is never held whole."""

    @classmethod
    def name(cls) -> str:
        return "file_digests"

    def schema(self) -> str:
        return "relative_path string, bytes long, sha256 string"

    def reader(self, schema) -> _DigestReader:
        return _DigestReader(self.options["path"], int(self.options.get("split", SPLIT)), int(self.options.get("block", BLOCK)), self.options.get("opened", "true") == "true")


def block_size(head: bytes) -> int | None:
    """Bytes of the compressed block that begins here, or None if none does."""
    if len(head) < HEADER or not head.startswith(MAGIC):
        return None
    extra = head[HEADER:HEADER + struct.unpack_from("<H", head, 10)[0]]
    at = 0
    while at + 4 <= len(extra):
        size = struct.unpack_from("<H", extra, at + 2)[0]
        if extra[at:at + 2] == FIELD and size == 2 and at + 6 <= len(extra):
            return struct.unpack_from("<H", extra, at + 4)[0] + 1
        at += 4 + size
    return None


def _head(source: pa.NativeFile, at: int, size: int) -> bytes:
    return source.read_at(min(64, size - at), at) if at < size else b""


def first_block(source: pa.NativeFile, start: int, size: int) -> int:
    """Where the first block at or behind ``start`` begins: one that another block or the end follows."""
    window = 1 << 17  # no block is longer than half of it
    while start < size:
        piece = source.read_at(min(window, size - start), start)
        at = piece.find(MAGIC)
        while at >= 0:
            here = start + at
            length = block_size(_head(source, here, size))
            if length and (here + length == size or here + length < size and block_size(_head(source, here + length, size))):
                return here
            at = piece.find(MAGIC, at + 1)
        start += max(1, len(piece) - len(MAGIC) + 1)
    return size


def _pieces(system: fs.FileSystem, p: _Range, block: int) -> Iterator[tuple[bool, bytes]]:
    """Text from the range's first block on, past its end: whether a piece begins in the range, and its bytes."""
    if p.kind == "gzip":
        with system.open_input_stream(p.path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
            while piece := stream.read(block):
                yield True, piece
        return
    with system.open_input_file(p.path) as source:
        size = source.size()
        if p.kind == "plain":
            at = p.start
            while at < size:
                piece = source.read_at(min(block, p.end - at if at < p.end else block, size - at), at)
                yield at < p.end, piece
                at += len(piece)
            return
        at = first_block(source, p.start, size)
        while at < size:
            length = block_size(_head(source, at, size))
            raw = source.read_at(length, at) if length else b""
            if not length or len(raw) < length:
                raise ValueError(f"{p.path}: no whole block at byte {at}")
            skip = HEADER + struct.unpack_from("<H", raw, 10)[0]
            yield at < p.end, zlib.decompress(raw[skip:-8], -15)
            at += length


def range_lines(pieces: Iterator[tuple[bool, bytes]], first: bool) -> Iterator[bytes]:
    """Runs of whole lines that belong to a range: those that begin in it, and the first behind it.

    All but a file's first range leave out what comes before their first line end, as the range before has it.
    """
    skipping, open_line, started = not first, [], False
    for inside, text in pieces:
        if not inside and (not started or skipping):
            return  # no block begins here, or all of it lies in one line of an earlier range
        started = True
        if not inside:
            cut = text.find(b"\n")
            open_line.append(text if cut < 0 else text[:cut])
            if cut >= 0:
                yield b"".join(open_line)
                return
            continue
        if skipping:
            cut = text.find(b"\n")
            if cut < 0:
                continue
            text, skipping = text[cut + 1:], False
        cut = text.rfind(b"\n")
        if cut < 0:
            open_line.append(text)
            continue
        yield b"".join([*open_line, text[:cut]])
        open_line = [text[cut + 1:]]
    rest = b"".join(open_line)
    if rest:
        yield rest


class _LineReader(DataSourceReader):
    def __init__(self, root: str, split: int, block: int) -> None:
        self.root, self.split, self.block = root, split, block

    def partitions(self) -> list[_Range]:
        system, _ = _system(self.root)
        out = []
        for path, _, size in listed_files(self.root):
            kind = "plain"
            if path.lower().endswith((".gz", ".bgz")):
                with system.open_input_file(path) as source:
                    kind = "blocks" if block_size(_head(source, 0, size)) else "gzip"
            step = size if kind == "gzip" else self.split
            out += [_Range(path, kind, s, min(s + step, size)) for s in range(0, size, max(1, step))]
        return out or [_Range("", "none", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if partition.kind == "none":
            return
        system, _ = _system(self.root)
        n = 0
        for run in range_lines(_pieces(system, partition, self.block), partition.start == 0):
            lines = run.decode("utf-8", "replace").split("\n")
            for at in range(0, len(lines), LINES):
                some = [x.removesuffix("\r") for x in lines[at:at + LINES]]
                k = len(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.string()), pa.array([partition.path] * k, pa.string()), pa.array([partition.start] * k, pa.int64()), pa.array(range(n, n + k), pa.int64())],
                    ["value", "file_path", "block", "line"])
                n += k


class BlockLines(DataSource):
    """Rows (value, file_path, block, line): lines of text files, where block-compressed gzip files are split as plain ones are.

    (block, line) is the order within a file. A gzip file of one stream is one partition.
    """

    @classmethod
    def name(cls) -> str:
        return "block_lines"

    def schema(self) -> str:
        return "value string, file_path string, block long, line long"

    def reader(self, schema) -> _LineReader:
        return _LineReader(self.options["path"], int(self.options.get("split", SPLIT)), int(self.options.get("block", BLOCK)))


class _FileWriter(DataSourceWriter):
    def __init__(self, root: str) -> None:
        self.root = root

    def write(self, iterator) -> WriterCommitMessage:
        system, root = _system(self.root)
        system.create_dir(root, recursive=True)
        for row in iterator:
            target = f"{root.rstrip('/')}/{row['name']}"
            system.create_dir(target.rsplit("/", 1)[0], recursive=True)
            part = f"{target.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
            with system.open_output_stream(part, compression=None) as out:
                out.write(bytes(row["content"] or b""))
            system.move(part, target)  # a task that runs again puts the same file in its place
        return WriterCommitMessage()


class RowFiles(DataSource):
    """Sink of rows (name, content): each is one file below the path."""

    @classmethod
    def name(cls) -> str:
        return "row_files"

    def writer(self, schema, overwrite: bool) -> _FileWriter:
        return _FileWriter(self.options["path"])


def qualified(spark: SparkSession, path: str) -> str:
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hpath).toString()


def file_digests(spark: SparkSession, root: str, split: int = SPLIT, block: int = BLOCK) -> DataFrame:
    """(relative_path, bytes, sha256) of every file below ``root``; files of ``split`` bytes together are one partition."""
    spark.dataSource.register(FileDigests)
    return spark.read.format("file_digests").option("split", split).option("block", block).load(qualified(spark, root))


def file_listing(spark: SparkSession, root: str) -> DataFrame:
    """(relative_path, bytes) of every file below ``root``, empty ones too; no file is opened."""
    spark.dataSource.register(FileDigests)
    return spark.read.format("file_digests").option("opened", "false").load(qualified(spark, root)).select("relative_path", "bytes")


def block_lines(spark: SparkSession, root: str, split: int = SPLIT, block: int = BLOCK) -> DataFrame:
    """A4: (value, file_path, block, line) of every line below ``root``, in partitions of ``split`` bytes of a file."""
    spark.dataSource.register(BlockLines)
    return spark.read.format("block_lines").option("split", split).option("block", block).load(qualified(spark, root))


def write_files(rows: DataFrame, root: str) -> None:
    """One file a row of (name, content); rows of one name leave one of their files."""
    spark = rows.sparkSession
    spark.dataSource.register(RowFiles)
    rows.select(F.col("name").cast("string").alias("name"), F.col("content").cast("binary").alias("content")).write.format("row_files").mode("append").save(qualified(spark, root))


def compressed_blocks(text: bytes, size: int = 0xFF00) -> bytes:
    """Text as block-compressed gzip, with the empty block that ends such a file."""
    out = []
    for at in [*range(0, len(text), size), None]:
        piece = b"" if at is None else text[at:at + size]
        deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = deflate.compress(piece) + deflate.flush()
        extra = FIELD + struct.pack("<HH", 2, HEADER + 6 + len(body) + 8 - 1)
        out.append(MAGIC + struct.pack("<IBBH", 0, 0, 255, len(extra)) + extra + body + struct.pack("<II", zlib.crc32(piece), len(piece)))
    return b"".join(out)
