"""Conversion of streams: the same stateless pass, so stream and batch give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.convert import convert_table
from papyrine.options import Options


def convert_requests(requests: DataFrame, o: Options | None = None) -> DataFrame:
    """JSON requests ``{"html": ...}`` in ``value`` to JSON responses in ``value``, without empty fields."""
    html = F.get_json_object("value", "$.html")
    done = convert_table(requests.select(html.alias("html")), o)
    r = F.col("result")
    diagnostics = F.when(F.size(r["diagnostics"]) > 0, r["diagnostics"])
    answer = F.struct(r["markdown"].alias("markdown"), r["title"].alias("title"), r["description"].alias("description"), r["canonical_url"].alias("canonical_url"), diagnostics.alias("diagnostics"), r["error"].alias("error"))
    return done.select(F.to_json(answer, {"ignoreNullFields": "true"}).alias("value"))
