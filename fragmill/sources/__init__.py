"""Readers and writers of the text, Parquet and BAM formats, with a registry by name."""

from fragmill.sources.bam import read_bam
from fragmill.sources.formats import READERS, WRITERS, read, write

READERS["bam"] = read_bam

__all__ = ["READERS", "WRITERS", "read", "write"]
