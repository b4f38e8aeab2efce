"""Changes of tables as functions from the old rows to the new ones.

Parquet has no update in place: a change is a join whose result is written as the
next snapshot (:mod:`orrery.sources.snapshots`). Deletions are anti-joins, so none
of them gathers ids anywhere.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _winners(new: DataFrame, keys: Sequence[str], order: Sequence[str] | None, pick) -> DataFrame:
    """One row of each key: by ``order``, then by all other columns, so that reruns agree."""
    rest = [c for c in new.columns if c not in keys]
    by = F.struct(*[F.col(c) for c in [*(order or []), *rest]], F.lit(0))
    return new.groupBy(*keys).agg(pick(F.struct(*new.columns), by).alias("_row")).select("_row.*") if rest else new.distinct()


def upsert(rows: DataFrame, new: DataFrame, key: str | Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """New rows replace old ones of equal key; of new rows of one key the last by ``order``, then by all columns, counts.

    Columns have to be of kinds that can be compared, so no maps.
    """
    keys = [key] if isinstance(key, str) else list(key)
    fresh = _winners(new, keys, order, F.max_by)
    return rows.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def with_vectors(chunks: DataFrame, vectors: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks joined one to one with their vectors; a chunk without one, or the reverse, is an error."""
    joined = chunks.withColumn("_c", F.lit(1)).join(vectors.withColumn("_v", F.lit(1)), key, "full")
    whole = F.col("_c").isNotNull() & F.col("_v").isNotNull()
    checked = F.when(whole, F.col(key)).otherwise(F.raise_error(F.concat(F.lit("no counterpart for "), F.col(key).cast("string"))))
    return joined.withColumn(key, checked).drop("_c", "_v")


def insert_unique(rows: DataFrame, new: DataFrame, unique: Sequence[str], order: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(table with what could be inserted, rows that conflict, with ``conflict``: "exists" or "repeated").

    Of new rows that clash with each other the first by ``order``, then by all columns, is inserted;
    equal rows count as one and the rest of them as repeated.
    """
    keys = list(unique)
    free = new.join(rows.select(*keys), keys, "left_anti")
    taken = new.join(rows.select(*keys), keys, "left_semi").withColumn("conflict", F.lit("exists"))
    first = _winners(free, keys, order, F.min_by)
    again = free.exceptAll(first).withColumn("conflict", F.lit("repeated"))
    return rows.unionByName(first, allowMissingColumns=True), taken.unionByName(again)


def update(rows: DataFrame, key: str, changes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-null values of ``changes`` (one row for a key at most) replace the old ones."""
    renamed = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = rows.join(renamed, key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def delete(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def delete_cascading(tables: Mapping[str, DataFrame], gone: DataFrame, key: str, links: Sequence[tuple[str, str, str, str]]) -> dict[str, DataFrame]:
    """Deletes the keys ``gone`` and, along ``links`` (parent, parent key, child, child key), what hangs on them.

    The first link's parent is the table that ``gone`` belongs to.
    """
    out, lost = dict(tables), {links[0][0]: gone.select(key)}
    out[links[0][0]] = delete(out[links[0][0]], gone, key)
    for parent, parent_key, child, child_key in links:
        if parent in lost:
            ids = lost[parent].select(F.col(parent_key).alias(child_key)).distinct()
            dropped = out[child].join(ids, child_key, "left_semi")
            out[child] = out[child].join(ids, child_key, "left_anti")
            lost[child] = dropped
    return out


def assign(links: DataFrame, new: DataFrame) -> DataFrame:
    """Assigning twice is the same as once."""
    return links.unionByName(new).dropDuplicates(["entity_id", "tag_id"])


def unassign(links: DataFrame, gone: DataFrame) -> DataFrame:
    return links.join(gone, ["entity_id", "tag_id"], "left_anti")


def get_or_create(tags: DataFrame, wanted: DataFrame) -> DataFrame:
    """The table of tags with those of ``wanted`` (workspace_id, name) that were missing."""
    keys = ["workspace_id", "name"]
    new = wanted.select(*keys).distinct().join(tags.select(*keys), keys, "left_anti")
    return tags.unionByName(new.withColumn("tag_id", F.concat(F.lit("tag_"), F.substring(F.sha2(F.concat_ws(":", *keys), 256), 1, 12))), allowMissingColumns=True)


def soft_delete(documents: DataFrame, gone: Column) -> DataFrame:
    return documents.withColumn("status", F.when(gone, F.lit("deleting")).otherwise(F.col("status")))


def hard_delete(documents: DataFrame, chunks: DataFrame, corpus: DataFrame, jobs: DataFrame) -> dict[str, DataFrame]:
    """Removes soft-deleted documents from every table."""
    gone = documents.where(F.col("status") == "deleting").select("document_id")
    return {
        "documents": delete(documents, gone, "document_id"),
        "chunks": delete(chunks, gone, "document_id"),
        "corpus": delete(corpus, gone, "document_id"),
        "jobs": delete(jobs, gone, "document_id"),
    }


def emptied(collections: DataFrame, documents: DataFrame, gone: DataFrame) -> DataFrame:
    """The collections that lost their last document when ``gone`` (document_id, collection_id) went; ``documents`` are those that are left.

    Their vectors are dropped as a whole, so that the next ingestion may use another width.
    """
    hit = collections.join(gone.select("collection_id").distinct(), "collection_id", "left_semi")
    return hit.join(documents.select("collection_id").distinct(), "collection_id", "left_anti")


def merge_tag(tags: DataFrame, links: Mapping[str, DataFrame], source: str, target: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(tags without ``source``, every table of links with ``source`` turned into ``target`` and no link twice)."""
    if source == target:
        raise ValueError("a tag can't be merged into itself")
    moved = F.when(F.col("tag_id") == source, F.lit(target)).otherwise(F.col("tag_id"))
    return tags.where(F.col("tag_id") != source), {k: v.withColumn("tag_id", moved).dropDuplicates(["entity_id", "tag_id"]) for k, v in links.items()}


def reindex_document(corpus: DataFrame, chunks: DataFrame, document_id: str) -> DataFrame:
    """The corpus rows of one document made anew from its stored chunks."""
    return corpus.where(F.col("document_id") != document_id).unionByName(chunks.where(F.col("document_id") == document_id).select(*corpus.columns))


def reindex(corpus: DataFrame, chunks: DataFrame, documents: DataFrame, collections: DataFrame) -> DataFrame:
    """The corpora of ``collections`` made anew from the chunks of active documents; others stay."""
    ids = collections.select("collection_id").distinct()
    alive = documents.where(F.col("status").isNull()).select("document_id")
    return corpus.join(ids, "collection_id", "left_anti").unionByName(chunks.join(ids, "collection_id", "left_semi").join(alive, "document_id", "left_semi").select(*corpus.columns))


def set_document_tags(chunks: DataFrame, effective: DataFrame) -> DataFrame:
    """Chunks with the tags column of ``effective`` (document_id, tags); documents not in it keep theirs."""
    joined = chunks.join(effective.select("document_id", F.col("tags").alias("_tags")), "document_id", "left")
    return joined.withColumn("tags", F.coalesce("_tags", "tags")).drop("_tags")


def set_job_status(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    return update(jobs, "job_id", changes, [c for c in changes.columns if c != "job_id"])
