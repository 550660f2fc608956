"""Names of sources, provenance columns and sample keys."""

from __future__ import annotations

import posixpath
import re
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

PROV_PREFIX = "__prov_"
POS_PREFIX = "__pos_"
SAMPLE_ID = "sample_id"


def normalise_path(path: str) -> str:
    """One spelling per path, so that ``./a//b`` and ``a/b`` are the same source."""
    scheme = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", path)
    head = scheme.group(0) if scheme else ""
    return head + posixpath.normpath(path[len(head):])


def source_name(path: str) -> str:
    """Identity of a source: the CRC-32 of its path, written as ``0x…``."""
    return hex(zlib.crc32(normalise_path(path).encode()))


def source_name_of(path: Column) -> Column:
    """``source_name`` as a column expression (the path is taken as it is)."""
    return F.concat(F.lit("0x"), F.lower(F.hex(F.crc32(path.cast("binary")))))


def prov_column(alias: str) -> str:
    return PROV_PREFIX + alias


def sample_id(keys) -> Column:
    """Key of a row: the md5 of the source rows (and explode ordinals) it stems from."""
    return F.md5(F.concat_ws(":", *[F.col(f"`{k}`").cast("string") for k in keys]).cast("binary"))


def split_key(sample: Column, seed: int) -> Column:
    """Seeded pseudo-random rank of a sample; uniform over 128 bits."""
    return F.md5(F.concat(F.lit(f"{seed}:"), sample).cast("binary"))
