"""Pluggable parts by name: datasets and encoders register a factory, and configurations name it."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession


class Dataset(Protocol):
    """What a dataset offers: interactions (user, item, ts, ord) and item texts (item, sentence)."""

    def interactions(self, spark: SparkSession) -> DataFrame: ...

    def texts(self, spark: SparkSession) -> DataFrame: ...


_FOUND: dict[tuple[str, str], Callable] = {}


def register(kind: str, name: str) -> Callable:
    def keep(factory: Callable) -> Callable:
        if (kind, name) in _FOUND:
            raise ValueError(f"{kind} {name} is registered already")
        _FOUND[kind, name] = factory
        return factory

    return keep


def find(kind: str, name: str) -> Callable:
    if (kind, name) not in _FOUND:
        raise KeyError(f"no {kind} named {name}; there are {sorted(n for k, n in _FOUND if k == kind)}")
    return _FOUND[kind, name]


# The categories that review files come in.
CATEGORIES = (
    "Books", "Electronics", "Movies_and_TV", "CDs_and_Vinyl", "Clothing_Shoes_and_Jewelry", "Home_and_Kitchen", "Kindle_Store", "Sports_and_Outdoors",
    "Cell_Phones_and_Accessories", "Health_and_Personal_Care", "Toys_and_Games", "Video_Games", "Tools_and_Home_Improvement", "Beauty", "Apps_for_Android",
    "Office_Products", "Pet_Supplies", "Automotive", "Grocery_and_Gourmet_Food", "Patio_Lawn_and_Garden", "Baby", "Digital_Music", "Musical_Instruments", "Amazon_Instant_Video",
)


def categories_of(wanted: str | list[str], known: tuple[str, ...] = CATEGORIES) -> list[str]:
    """Names as a list, from a list or a text with commas; empty ones go, unknown ones and none at all are errors."""
    names = [c.strip() for c in wanted.split(",")] if isinstance(wanted, str) else list(wanted)
    names = [c for c in names if c]
    unknown = [c for c in names if c not in known]
    if unknown or not names:
        raise ValueError(f"unknown categories {unknown}; there are {list(known)}" if unknown else "a category is needed")
    return names


@register("dataset", "reviews")
class Reviews:
    """Review files, one per category, with metadata files."""

    def __init__(self, reviews: dict[str, str], metadata: dict[str, str]):
        self.reviews, self.metadata = reviews, metadata

    def interactions(self, spark: SparkSession) -> DataFrame:
        from strandline.operators.interactions import merge_categories
        from strandline.sources import records

        if len(self.reviews) == 1:
            return records.reviews(spark, next(iter(self.reviews.values())))
        return merge_categories({name: records.reviews(spark, path) for name, path in self.reviews.items()})[0]

    def texts(self, spark: SparkSession) -> DataFrame:
        from strandline.functions.text import item_sentence
        from strandline.operators.interactions import known_items
        from strandline.sources import records

        meta = records.metadata(spark, list(self.metadata.values()))
        fields = [("title", "text"), ("price", "text"), ("brand", "text"), ("feature", "text"), ("categories", "list"), ("description", "text")]
        from pyspark.sql import functions as F

        kept = known_items(meta, self.interactions(spark)).withColumn("feature", F.array_join("feature", ", "))
        return kept.select("item", item_sentence(fields).alias("sentence"))


@register("dataset", "behaviours")
class Behaviours:
    """A behaviour file of user sequences and a bilingual item table."""

    def __init__(self, behaviours: str, texts: str, language: str = "both"):
        self.path, self.text_path, self.language = behaviours, texts, language

    def interactions(self, spark: SparkSession) -> DataFrame:
        from strandline.sources import records

        rows = records.behaviours(spark, self.path)
        records.require_empty(records.behaviour_violations(rows), self.path)
        return records.behaviour_log(rows)

    def texts(self, spark: SparkSession) -> DataFrame:
        from strandline.functions.text import bilingual_text
        from strandline.sources import records

        rows = records.item_texts(spark, self.text_path)
        records.require_empty(records.item_text_violations(rows), self.text_path)
        return rows.select("item", bilingual_text("zh", "en", self.language).alias("sentence"))
