import struct
import zlib

import pytest
from pyspark.errors import PySparkException

from fragmill.sources import bam
from fragmill.sources import formats as S


def block(data):
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, 12 + 6 + len(body) + 8 - 1)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def record(name, flag, ref, pos, mapq, ops, mate, mate_pos, tlen, bases, quals, tags=b""):
    packed = [bam.BASES.index(b) for b in bases] + [0] * (len(bases) % 2)
    seq = bytes(packed[k] << 4 | packed[k + 1] for k in range(0, len(packed), 2))
    cigar = b"".join(struct.pack("<I", n << 4 | bam.OPERATIONS.index(o)) for n, o in ops)
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, len(ops), flag, len(bases), mate, mate_pos, tlen) + name.encode() + b"\0" + cigar + seq + quals + tags
    return struct.pack("<i", len(body)) + body


HEADER = b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", 2) + b"".join(struct.pack("<i", 3) + n + b"\0" + struct.pack("<i", 500) for n in (b"c1", b"c2"))
RECORDS = [
    record("r/1", 99, 0, 9, 255, [(2, "S"), (3, "M")], 0, 49, 60, "ACGTN", bytes([40, 2, 0, 1, 30]), b"RGZone\0NMC\x03XBBs" + struct.pack("<i2h", 2, -1, 5) + b"XFf" + struct.pack("<f", 0.5) + b"XAAq"),
    record("s", 4, -1, -1, 0, [], -1, -1, 0, "ACG", b"\xff\xff\xff"),
    record("t", 65, 0, 1, 7, [(1, "M")], 1, 4, 0, "T", b"\x05"),
]
LINES = [
    "r/1\t99\tc1\t10\t255\t2S3M\t=\t50\t60\tACGTN\tI#!\"?\tRG:Z:one\tNM:i:3\tXB:B:s,-1,5\tXF:f:0.5\tXA:A:q",
    "s\t4\t*\t0\t0\t*\t*\t0\t0\tACG\t*",
    "t\t65\tc1\t2\t7\t1M\tc2\t5\t0\tT\t&",
]
DATA = HEADER + b"".join(RECORDS)


def write(path, data, size=50):
    path.write_bytes(b"".join(block(data[k : k + size]) for k in range(0, len(data), size)) + block(b""))


def test_bam(spark, tmp_path):
    write(tmp_path / "a.bam", DATA)
    write(tmp_path / "empty.bam", HEADER)
    assert list(bam.sam_lines((tmp_path / "a.bam").read_bytes())) == LINES
    (tmp_path / "a.sam").write_text("\n".join(LINES) + "\n")
    got = S.read(spark, "bam", [str(tmp_path / "a.bam"), str(tmp_path / "empty.bam")])
    assert sorted(got.collect()) == sorted(S.read(spark, "sam", str(tmp_path / "a.sam")).collect())
    assert got.where(S.tag("NM", "int") == 3).count() == 1


@pytest.mark.parametrize("cut", [1, 40, 120])
def test_truncated(tmp_path, cut):
    write(tmp_path / "a.bam", DATA)
    with pytest.raises((ValueError, struct.error)):
        list(bam.sam_lines((tmp_path / "a.bam").read_bytes()[:-cut]))


def test_no_bam(spark, tmp_path):
    write(tmp_path / "a.bam", b"text" * 20)
    with pytest.raises(PySparkException):
        S.read(spark, "bam", str(tmp_path / "a.bam")).collect()
