"""ZIP archives: member listing. Contents are never unpacked."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MEMBERS = "array<struct<pos int, filename string, external_attr long, file_size long, compress_size long, archive_error string>>"


def _listing(body) -> list[tuple]:
    """Members of one archive."""
    try:
        with zipfile.ZipFile(io.BytesIO(bytes(body))) as z:
            members = z.infolist()
    except (zipfile.BadZipFile, OSError):
        return [(-1, None, None, None, None, "invalid zip archive")]
    if not members:
        return [(-1, None, None, None, None, None)]
    return [(i, m.filename, m.external_attr, m.file_size, m.compress_size, None) for i, m in enumerate(members)]


def archive_manifest(archives: DataFrame) -> DataFrame:
    """Members of ``archives(archive_id, content binary)``.

    An archive without members, or one that cannot be read, gives one row with
    ``pos`` -1; ``archive_error`` tells the two apart.

    Rows go to Python a hundred at a time, not in Arrow batches of ten thousand, which would hold as many archives.
    """
    listing = F.udf(_listing, _MEMBERS, useArrow=False)
    return archives.select("archive_id", F.inline(listing("content")))
