import gzip
import struct

from conftest import rows

from locusmill.sources import bam, chunks


def record(name, flag, ref, pos, mapq, ops, seq, tags=b""):
    packed = bytes((bam.BASES.index(a) << 4) | bam.BASES.index(b) for a, b in zip(seq[::2], (seq + "=")[1::2]))
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, len(ops), flag, len(seq), -1, -1, 0) + name.encode() + b"\0"
    body += b"".join(struct.pack("<I", (n << 4) | bam.OPS.index(o)) for n, o in ops) + packed + b"\xff" * len(seq) + tags
    return struct.pack("<i", len(body)) + body


def test_bam(spark, tmp_path):
    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"ctg1\0" + struct.pack("<i", 100)
    tags = b"csZ:5\0" + b"NMC\x03" + b"def" + struct.pack("<f", 0.5) + b"xxBs" + struct.pack("<Ihh", 2, 1, 2) + b"MDZ5\0"
    p = tmp_path / "a.bam"
    with open(p, "wb") as f:
        f.write(gzip.compress(head))
        f.write(gzip.compress(record("r1", 16, 0, 10, 60, [(3, "H"), (5, "S"), (5, "M"), (2, "D"), (4, "=")], "ACGTACGTACGTAC", tags)))
        f.write(gzip.compress(record("r2", 4, -1, -1, 0, [], "ACG")) + gzip.compress(b""))
    df = bam.read(spark, str(p))
    assert rows(df, "read", "contig", "start", "end", "l_clip", "strand", "unmapped", "seq", "cs", "md", "de") == [("r1", "ctg1", 10, 21, 8, "-", False, "ACGTACGTACGTAC", ":5", "5", 0.5), ("r2", "*", -1, -1, 0, "+", True, "ACG", "", "", None)]


def test_chunks(spark, tmp_path):
    w = spark.createDataFrame([("a", 0, 1), ("b", 0, 2)], "contig string, win int, cov int")
    chunks.write(w, str(tmp_path / "c"))
    assert rows(chunks.read(spark, str(tmp_path / "c"), ["b"]), "contig", "win", "cov") == [("b", 0, 2)]
