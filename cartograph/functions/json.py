"""SRC-3: image lists stored as JSON text ``[{"url": .., "alt": ..}, ..]``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGE_LIST = "array<map<string,string>>"


def parse_images(c) -> Column:
    """JSON text to ``array<map<string,string>>`` (null text stays null)."""
    return F.from_json(F.col(c) if isinstance(c, str) else c, IMAGE_LIST)


def first_image_url(c) -> Column:
    """URL of the first image; null when the list is null or empty.

    ``get`` returns null past the end, where ``arr[0]`` would raise under ANSI.
    """
    first = F.get(parse_images(c), 0)
    return F.when(first.isNull(), F.lit(None).cast("string")).otherwise(first.getItem("url"))
