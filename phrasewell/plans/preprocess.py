"""Preprocessing job: join the splits, keep the first rows, resolve the entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from phrasewell.operators.entities import resolve_entities
from phrasewell.operators.rows import head_n
from phrasewell.sources.tables import union_splits


def preprocess(
    splits: list[DataFrame],
    labels: DataFrame,
    key: str = "row_id",
    text: str = "sparql_wikidata",
    limit: int | None = None,
) -> DataFrame:
    """Source columns with ``sparql_wikidata_translated`` and ``descriptions``."""
    rows = union_splits(*splits)
    if limit is not None:
        rows = head_n(rows, limit, key)
    others = tuple(c for c in rows.columns if c != key)
    resolved = resolve_entities(rows.where(F.col(key).isNotNull()), key, text, labels, keep=others)
    return resolved.select(
        key, *others, F.col("translated").alias("sparql_wikidata_translated"), "descriptions"
    )
