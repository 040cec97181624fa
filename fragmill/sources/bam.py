"""BAM input: blocks are inflated and records turned into SAM lines in Arrow batches; columns are cut by ``parse_sam``.

A file is the unit of work, and is at most 2 GB, as Spark's binary files are; a data set of any size is read from many
files. A truncated file, or one without the magic number, raises.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from fragmill.sources.formats import parse_sam

#: Fixed values of the format: letters of operations and of bases, and tag types with their struct codes.
OPERATIONS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
LINES_AT_ONCE = 5_000
_PAIRS = [BASES[k >> 4] + BASES[k & 15] for k in range(256)]
_SHIFTED = bytes(min(k + 33, 126) for k in range(256))


def inflated(content: bytes) -> Iterator[bytes]:
    """The blocks of a block-gzipped file, each found by the size that its header states."""
    view, at = memoryview(content), 0
    while at < len(view):
        if bytes(view[at : at + 4]) != b"\x1f\x8b\x08\x04":
            raise ValueError("not a block-gzipped file")
        (extra,) = struct.unpack_from("<H", view, at + 10)
        field, size = at + 12, 0
        while field < at + 12 + extra:
            kind, length = bytes(view[field : field + 2]), struct.unpack_from("<H", view, field + 2)[0]
            if kind == b"BC":
                size = struct.unpack_from("<H", view, field + 4)[0] + 1
            field += 4 + length
        if not size or at + size > len(view):
            raise ValueError("truncated block")
        yield zlib.decompress(view[at + 12 + extra : at + size - 8], wbits=-15)
        at += size


class _Stream:
    """Bytes of the blocks, by the piece."""

    def __init__(self, blocks: Iterator[bytes]) -> None:
        self.blocks, self.held, self.at = blocks, b"", 0

    def take(self, n: int, may_end: bool = False) -> bytes:
        while len(self.held) - self.at < n:
            block = next(self.blocks, None)
            if block is None:
                if may_end and self.at == len(self.held):
                    return b""
                raise ValueError("truncated file")
            self.held, self.at = self.held[self.at :] + block, 0
        self.at += n
        return self.held[self.at - n : self.at]

    def number(self) -> int:
        return struct.unpack("<i", self.take(4))[0]


def _number(kind: str, value: float) -> str:
    return f"{value:g}" if kind == "f" else str(value)


def _tags(data: bytes) -> Iterator[str]:
    at = 0
    while at < len(data):
        name, kind = data[at : at + 2].decode("ascii"), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(0, at)
            yield f"{name}:{kind}:{data[at:end].decode('utf-8', 'replace')}"
            at = end + 1
        elif kind == "A":
            yield f"{name}:A:{chr(data[at])}"
            at += 1
        elif kind == "B":
            of, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            values = struct.unpack_from(f"<{n}{NUMBERS[of]}", data, at + 5)
            yield f"{name}:B:" + ",".join([of, *(_number(of, x) for x in values)])
            at += 5 + struct.calcsize(f"<{n}{NUMBERS[of]}")
        else:
            (value,) = struct.unpack_from("<" + NUMBERS[kind], data, at)
            yield f"{name}:{'f' if kind == 'f' else 'i'}:{_number(kind, value)}"
            at += struct.calcsize("<" + NUMBERS[kind])


def sam_lines(content: bytes) -> Iterator[str]:
    """SAM lines of a BAM file's records, in their order, without the header."""
    stream = _Stream(inflated(content))
    if stream.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    stream.take(stream.number())
    contigs = []
    for _ in range(stream.number()):
        contigs.append(stream.take(stream.number())[:-1].decode("ascii"))
        stream.take(4)
    name_of = lambda k: contigs[k] if k >= 0 else "*"
    while head := stream.take(4, may_end=True):
        record = stream.take(struct.unpack("<i", head)[0])
        ref, pos, n_name, mapq, _, n_ops, flag, n, mate, mate_pos, tlen = struct.unpack_from("<iiBBHHHiiii", record)
        at = 32 + n_name
        name = record[32 : at - 1].decode("ascii")
        ops = struct.unpack_from(f"<{n_ops}I", record, at)
        cigar = "".join(f"{x >> 4}{OPERATIONS[x & 15]}" for x in ops) or "*"
        at += 4 * n_ops
        bases = "".join(map(_PAIRS.__getitem__, record[at : at + (n + 1) // 2]))[:n] or "*"
        at += (n + 1) // 2
        quals = record[at : at + n]
        quals = "*" if not n or quals[0] == 0xFF else quals.translate(_SHIFTED).decode("ascii")
        rnext = "=" if mate == ref and mate >= 0 else name_of(mate)
        fields = (name, flag, name_of(ref), pos + 1, mapq, cigar, rnext, mate_pos + 1, tlen, bases, quals)
        yield "\t".join([*map(str, fields), *_tags(record[at + n :])])


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            lines: list[str] = []
            for line in sam_lines(content.as_py()):
                lines.append(line)
                if len(lines) == LINES_AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
                    lines = []
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])


def read_bam(spark: SparkSession, path: str | list[str], mode: str = "fail") -> DataFrame:
    """SAM rows of BAM files, as ``read_sam`` gives them; coordinates are 1-based."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return parse_sam(files.mapInArrow(_batches, "value string"), mode)
