"""Schemas of the library's records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

EVIDENCE = "evidence_id string, article_id string, source_id string, publisher_group_id string, provenance_group_key string, source_role string, source_type string, authority string, locator string, title string, passage string"
POST = (
    "title string, one_line_summary struct<sentence_id string, text string, claim_ids array<string>>, body array<struct<sentences array<struct<sentence_id string, text string, claim_ids array<string>>>>>, "
    "questions array<string>, claims array<struct<claim_id string, text string, kind string, importance string, display_citation boolean, evidence_refs array<struct<evidence_id string, support string>>>>, used_evidence_ids array<string>"
)
ARTICLE = "source_id string, external_id string, original_url string, title string, excerpt string, author string, publisher string, published_at timestamp, published_at_precision string, discovered_at timestamp"


def strict(df: DataFrame, ddl: str) -> DataFrame:
    """The columns of a declared schema, in its order; an unknown or missing column is an error, never inferred."""
    want = StructType.fromDDL(ddl)
    extra, missing = sorted(set(df.columns) - set(want.names)), sorted(set(want.names) - set(df.columns))
    if extra or missing:
        raise ValueError(f"unknown columns {extra}, missing columns {missing}")
    return df.select(*(df[f.name].cast(f.dataType) for f in want))
