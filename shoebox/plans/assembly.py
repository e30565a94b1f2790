"""What a search and a classification need, put together from the tables."""

from __future__ import annotations

from datetime import UTC, date, tzinfo

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import vectors
from ..params import Params
from . import parser


def known_names(tags: DataFrame, places: DataFrame) -> tuple[list[str], list[str]]:
    """(labels, names and aliases of places) that a parser is to know, each in order: vocabularies, not libraries."""
    labels = sorted(r.label for r in tags.select("label").distinct().collect())
    names = places.select(F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")).distinct()
    return labels, sorted(r.name for r in names.collect())


def parsed(text: str, now: date, tags: DataFrame, places: DataFrame, disabled: set[str] | None = None, zone: tzinfo = UTC) -> parser.Query:
    """A text read with the labels and places that the tables have."""
    labels, names = known_names(tags, places)
    return parser.parse(text, now, labels, names, disabled, zone)


def personal_prompts(prompts: DataFrame, feedback: DataFrame, media: DataFrame, params: Params) -> DataFrame:
    """prompts(family, parent, label, vector) after the user's confirmations; kinds and attributes stay as they are."""
    categories = prompts.where("family = 'category'")
    moved = vectors.personalised(categories.select("label", "vector"), vectors.confirmed(feedback, media), params.personalise_alpha, params.personalise_min)
    known = categories.select("family", "parent", "label").join(moved, "label").select("family", "parent", "label", "vector")
    return known.unionByName(prompts.where("family <> 'category'").select("family", "parent", "label", "vector"))


def classified(media: DataFrame, prompts: DataFrame, feedback: DataFrame, params: Params | None = None, primary_only: tuple[str, ...] = (), thresholds: dict[str, float] | None = None) -> DataFrame:
    """vectors.classify with the prompts that the user's feedback has moved."""
    p = params or Params()
    return vectors.classify(media, personal_prompts(prompts, feedback, media, p), p, primary_only, thresholds)
