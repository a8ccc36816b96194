"""Source registry: a small table from JSON configuration."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE_COLUMNS = ("id string, name string, priority int, adapter string, url string, domain string, color string, enabled boolean, "
                  "imageRewrite struct<pattern:string,replacement:string>, logo string, notes string")
ADAPTERS = ("rss", "atom", "googlenews", "html")


def parse_registry(text: str) -> list[tuple]:
    """Rows of the configuration; malformed JSON or an entry of the wrong shape gives none.  Bad image patterns are dropped."""
    try:
        out = []
        for s in json.loads(text)["sources"]:
            rewrite = s.get("imageRewrite")
            if rewrite is not None:
                try:
                    re.compile(rewrite["pattern"])
                    rewrite = (rewrite["pattern"], rewrite["replacement"])
                except re.error:
                    rewrite = None
            if s["adapter"] not in ADAPTERS:
                raise ValueError(s["adapter"])
            out.append((s["id"], s["name"], int(s["priority"]), s["adapter"], s["url"], s["domain"], s.get("color", "#71767B"), bool(s.get("enabled", True)),
                        rewrite, s.get("logo"), s.get("notes")))
        return out
    except (ValueError, KeyError, TypeError):
        return []


def load_registry(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(parse_registry(text), SOURCE_COLUMNS)


def enabled(sources: DataFrame) -> DataFrame:
    return sources.where("enabled")


def by_id(sources: DataFrame, id_: str) -> DataFrame:
    return sources.where(F.col("id") == id_).limit(1)
