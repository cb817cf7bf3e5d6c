"""Share links: a safe id as an address and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .parse import SAFE_ID


def share_link(id_: Column, base: str, own_prefix: str = "custom_") -> Column:
    """base/id for a safe id that isn't one of a user's own; null for any other."""
    return F.when(id_.rlike(SAFE_ID) & ~F.startswith(id_, F.lit(own_prefix)), F.concat(F.lit(base + "/"), id_))


def shared_id(link: Column, base: str, own_prefix: str = "custom_") -> Column:
    """The id of a share link, whatever its query and fragment; null for any other address."""
    rest = F.when(F.startswith(link, F.lit(base + "/")), F.substring(link, len(base) + 2, 1 << 20))
    id_ = F.regexp_replace(F.regexp_replace(rest, r"[?#].*$", ""), "/$", "")
    return F.when(id_.rlike(SAFE_ID) & ~F.startswith(id_, F.lit(own_prefix)), id_)


def media_identity(url: Column) -> Column:
    """What an address shows: the video of any of a video site's addresses, else host and path without size suffix and query."""
    video = F.regexp_extract(url, r"(?i)^https?://(?:(?:www\.|m\.)?youtube(?:-nocookie)?\.com/(?:watch\?(?:[^#]*&)?v=|embed/|shorts/)|youtu\.be/)([A-Za-z0-9_-]{11})", 1)
    plain = F.lower(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"(?i)^https?://(www\.)?", ""))
    return F.when(video != "", F.concat(F.lit("video:"), video)).otherwise(F.concat(F.lit("image:"), F.regexp_replace(plain, r"-\d+x\d+(\.[a-z]+)$", "$1")))
