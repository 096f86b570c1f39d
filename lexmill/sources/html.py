"""Plain text of web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as t


def plain_pages(pages: DataFrame) -> DataFrame:
    """pages(page_id, html) -> page_id, text."""
    return pages.select("page_id", t.plain_html(F.col("html")).alias("text"))
