"""Propagation of tag changes to chunks: only what a change concerns is looked at and written.

Two states of the links of three levels, and of the tags' names, are compared; what differs
names entities, those name documents, and only the effective tags of these are made anew. Of
their chunks, those whose tags come out different are the delta that a commit writes.
A tag that only changed its colour concerns nothing.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators.catalog import active
from orrery.operators.tags import effective_tags

#: The column of a document that an entity of each level is named in.
LEVELS = {"workspace": "workspace_id", "collection": "collection_id", "document": "document_id"}


@dataclass
class TagState:
    """Tags (tag_id, name) and the links (entity_id, tag_id) of each level."""

    tags: DataFrame
    links: Mapping[str, DataFrame]


def changed_entities(old: TagState, new: TagState) -> dict[str, DataFrame]:
    """(entity_id) of each level whose own tags are others than before, by link or by name."""
    named = old.tags.select("tag_id", F.col("name").alias("was")).join(new.tags.select("tag_id", F.col("name").alias("is")), "tag_id", "full")
    renamed = named.where(~F.col("was").eqNullSafe(F.col("is"))).select("tag_id")
    out = {}
    for level in LEVELS:
        before, after = (s.links[level].select("entity_id", "tag_id") for s in (old, new))
        moved = before.unionByName(after).distinct().join(before.intersect(after), ["entity_id", "tag_id"], "left_anti")
        touched = before.unionByName(after).join(renamed, "tag_id", "left_semi")
        out[level] = moved.unionByName(touched).select("entity_id").distinct()
    return out


def affected_documents(documents: DataFrame, changed: Mapping[str, DataFrame]) -> DataFrame:
    """The active documents that an entity of ``changed`` reaches."""
    reached = None
    for level, column in LEVELS.items():
        ids = documents.where(active()).join(changed[level].withColumnRenamed("entity_id", column), column, "left_semi").select("document_id")
        reached = ids if reached is None else reached.unionByName(ids)
    return documents.join(reached.distinct(), "document_id", "left_semi")


def synced(chunks: DataFrame, documents: DataFrame, old: TagState, new: TagState) -> DataFrame:
    """The chunks to be written again, with their new tags: a delta by chunk_id."""
    some = affected_documents(documents, changed_entities(old, new))
    effective = effective_tags(some, new.tags, new.links["workspace"], new.links["collection"], new.links["document"])
    joined = chunks.join(effective.select("document_id", F.col("tags").alias("_tags")), "document_id")
    return joined.where(~F.col("tags").eqNullSafe(F.col("_tags"))).withColumn("tags", F.col("_tags")).select(*chunks.columns)
