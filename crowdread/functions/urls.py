"""Video ids and watch addresses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

VIDEO_ID = "([A-Za-z0-9_-]{11})"
# Address forms, tried in this order: short link, query parameter, path. Fixed values.
ID_PATTERNS = (
    rf"youtu\.be/{VIDEO_ID}",
    rf"[?&]v={VIDEO_ID}",
    rf"/(?:shorts|embed|live|v)/{VIDEO_ID}",
)


def video_id_from_url(url: Column) -> Column:
    """The 11-character id, or NULL for an address that has none."""
    found = [F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in ID_PATTERNS]
    return F.coalesce(*found)


def canonical_url(url: Column) -> Column:
    """The plain watch address; unchanged where there is no id."""
    return F.coalesce(
        F.concat(F.lit("https://www.youtube.com/watch?v="), video_id_from_url(url)), url
    )
