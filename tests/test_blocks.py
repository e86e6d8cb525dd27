"""Files read in blocks against plain readers."""

import gzip
import hashlib
import random

import pytest

from pairgrammar.sources import blocks, genomics, tables


def _lines(draw, n):
    return ["".join(draw.choices("abcdefgé\t", k=draw.choice([0, 1, 5, 200, 3000]))) for _ in range(n)]


@pytest.mark.parametrize("end", ["\n", ""])
def test_ranges_share_out_every_line_once(tmp_path, end):
    draw = random.Random(5)
    for size in (50, 700, 0xFF00):
        lines = _lines(draw, 120) + ["x" * 9000, "last"]
        text = ("\n".join(lines) + end).encode()
        (tmp_path / "a.gz").write_bytes(blocks.compressed_blocks(text, size))
        (tmp_path / "a.txt").write_bytes(text)
        assert gzip.decompress((tmp_path / "a.gz").read_bytes()) == text
        for name in ("a.gz", "a.txt"):
            whole = tmp_path / name
            for split in (60, 997, 40000, 1 << 20):
                reader = blocks._LineReader(f"file:{whole}", split, 333)
                got = [x for p in reader.partitions() for b in reader.read(p) for x in b.column(0).to_pylist()]
                assert got == lines, (size, name, split)


def test_block_compressed_file_gives_several_partitions(spark, tmp_path):
    rows = [f"chr{i % 3}\t{i}\t{i + 5}" for i in range(20000)]
    text = ("\n".join(rows) + "\n").encode()
    (tmp_path / "f.tsv.gz").write_bytes(blocks.compressed_blocks(text))
    (tmp_path / "one.tsv.gz").write_bytes(gzip.compress(text))
    lines = blocks.block_lines(spark, str(tmp_path), split=20000)
    per_file = {r["f"]: r["n"] for r in lines.selectExpr("substring_index(file_path, '/', -1) f", "spark_partition_id() p").distinct().groupBy("f").count().withColumnRenamed("count", "n").collect()}
    assert per_file["f.tsv.gz"] >= 3 and per_file["one.tsv.gz"] == 1
    # the budget keeps the order of the file over its ranges
    got = genomics.read_fragments(spark, str(tmp_path / "f.tsv.gz"), max_lines=7000, blocks=True)
    assert sorted(r["start"] for r in got.select("start").collect()) == list(range(7000))
    plain = genomics.read_fragments(spark, str(tmp_path), max_lines=7000)
    assert plain.count() == 14000


def test_broken_block_is_an_error(tmp_path):
    data = blocks.compressed_blocks(b"some lines\n" * 1000, 500)
    (tmp_path / "a.gz").write_bytes(data[:-40])
    reader = blocks._LineReader(f"file:{tmp_path}/a.gz", 1 << 20, 100)
    with pytest.raises(ValueError, match="no whole block"):
        [b for p in reader.partitions() for b in reader.read(p)]


def test_digest_of_a_file_above_two_gigabytes(spark, tmp_path):
    size = (2 << 30) + 12345
    with open(tmp_path / "large.bin", "wb") as out:
        out.truncate(size)  # a hole: it takes no disk
    (tmp_path / "small.bin").write_bytes(b"abc")
    (tmp_path / "empty.bin").write_bytes(b"")
    (tmp_path / "_hidden").write_bytes(b"x")
    want, zero = hashlib.sha256(), bytes(1 << 20)
    for _ in range(size >> 20):
        want.update(zero)
    want.update(bytes(size & ((1 << 20) - 1)))
    got = {r["relative_path"]: (r["bytes"], r["sha256"]) for r in tables.checksum_inventory(spark, str(tmp_path)).collect()}
    assert got == {"large.bin": (size, want.hexdigest()), "small.bin": (3, hashlib.sha256(b"abc").hexdigest()), "empty.bin": (0, hashlib.sha256().hexdigest())}


def test_files_written_from_rows(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.bin", b"\x00\x01"), ("y.bin", None), ("y.bin", None)], "name string, content binary")
    blocks.write_files(rows, str(tmp_path / "out"))
    assert (tmp_path / "out/a/x.bin").read_bytes() == b"\x00\x01" and (tmp_path / "out/y.bin").read_bytes() == b""
    assert {r["relative_path"]: r["bytes"] for r in tables.file_inventory(spark, str(tmp_path / "out")).collect()} == {"a/x.bin": 2, "y.bin": 0}
