"""Tags: inheritance, matching, usage, suggestions, and the file-tag graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.text import clamped, confidence_of_rank, heat_share, normalize_tag
from orrery.operators.catalog import active


def effective_tags(documents: DataFrame, tags: DataFrame, workspace_tags: DataFrame, collection_tags: DataFrame, document_tags: DataFrame) -> DataFrame:
    """(document_id, tags): the sorted distinct names a document has itself or from above."""

    def level(links: DataFrame, key: str) -> DataFrame:
        return documents.select("document_id", F.col(key).alias("entity_id")).join(links, "entity_id").select("document_id", "tag_id")

    all_ = level(workspace_tags, "workspace_id").unionByName(level(collection_tags, "collection_id")).unionByName(level(document_tags, "document_id"))
    named = all_.join(tags.select("tag_id", "name"), "tag_id").groupBy("document_id").agg(F.sort_array(F.collect_set("name")).alias("tags"))
    return documents.select("document_id").join(named, "document_id", "left").select("document_id", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def with_all_tags(links: DataFrame, tags: DataFrame, names: Sequence[str]) -> DataFrame:
    """(entity_id) of those that carry every one of the names, which are normalised first."""
    wanted = sorted({" ".join(n.lower().split()) for n in names})
    named = links.join(tags.where(F.col("name").isin(wanted)), "tag_id")
    return named.groupBy("entity_id").agg(F.count_distinct("name").alias("n")).where(F.col("n") == len(wanted)).select("entity_id")


def usage_counts(tags: DataFrame, workspace_tags: DataFrame, collection_tags: DataFrame, document_tags: DataFrame) -> DataFrame:
    """Each tag with the entities of each level that carry it; each side is counted before it is joined."""
    out = tags
    for name, links in (("workspace_count", workspace_tags), ("collection_count", collection_tags), ("document_count", document_tags)):
        out = out.join(links.groupBy("tag_id").agg(F.count_distinct("entity_id").alias(name)), "tag_id", "left").fillna(0, [name])
    return out


def tag_items(tag_id: str, collections: DataFrame, documents: DataFrame, collection_tags: DataFrame, document_tags: DataFrame) -> DataFrame:
    """(kind, id) of the collections and active documents that carry a tag."""

    def of(links: DataFrame) -> DataFrame:
        return links.where(F.col("tag_id") == tag_id).select("entity_id").distinct()

    cols = collections.join(of(collection_tags), F.col("collection_id") == F.col("entity_id"), "left_semi").select(F.lit("collection").alias("kind"), F.col("collection_id").alias("id"))
    docs = documents.where(active()).join(of(document_tags), F.col("document_id") == F.col("entity_id"), "left_semi").select(F.lit("document").alias("kind"), F.col("document_id").alias("id"))
    return cols.unionByName(docs)


def tags_by_entity(links: DataFrame, tags: DataFrame) -> DataFrame:
    """(entity_id, tags): the tags of each entity, by name."""
    rows = links.join(tags, "tag_id")
    return rows.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("name", "tag_id", "color"))).alias("tags"))


def merge_tags(links: DataFrame, source: str, target: str) -> DataFrame:
    """Links of ``source`` become links of ``target``, without doubling."""
    return links.withColumn("tag_id", F.when(F.col("tag_id") == source, F.lit(target)).otherwise(F.col("tag_id"))).dropDuplicates(["entity_id", "tag_id"])


def parse_suggestions(replies: DataFrame, limit: int = 8) -> DataFrame:
    """(id, name, confidence, position) from model replies (id, reply).

    A JSON array of objects gives its own confidences; an array of names or a list
    with commas or line feeds gives confidences by place. The first of equal names counts.
    """
    inner = F.regexp_extract("reply", r"(?s)(\[.*\])", 1)
    objects = F.from_json(inner, "array<struct<name:string,confidence:string>>")
    names = F.from_json(inner, "array<string>")
    plain = F.split("reply", r"[,\n]")
    first = F.regexp_extract("reply", r"(?s)\[\s*(.)", 1)
    listed = F.when((first == "{") & objects.isNotNull(), F.transform(objects, lambda o, i: F.struct(normalize_tag(o["name"]).alias("name"), clamped(o["confidence"]).alias("confidence"), i.alias("position"))))
    listed = listed.otherwise(
        F.transform(F.when((inner != "") & names.isNotNull() & (first != "{"), names).otherwise(plain), lambda n, i: F.struct(normalize_tag(n).alias("name"), confidence_of_rank(i).alias("confidence"), i.alias("position")))
    )
    rows = replies.select("id", F.explode(listed).alias("s")).select("id", "s.*").where(F.col("name").isNotNull())
    once = rows.groupBy("id", "name").agg(F.min_by("confidence", "position").alias("confidence"), F.min("position").alias("position"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("position"))).where(F.col("place") <= limit).drop("place")


def rank_suggestions(suggestions: DataFrame, existing: DataFrame, least: float) -> DataFrame:
    """Suggestions (id, name, confidence, position) from ``least`` on, that the entity lacks, best first."""
    key = normalize_tag(F.col("name"))
    blocked = existing.select("id", key.alias("key")).distinct()
    good = suggestions.withColumn("key", key).where(F.col("key").isNotNull() & (F.col("confidence") >= least)).join(blocked, ["id", "key"], "left_anti")
    order = Window.partitionBy("id").orderBy(F.desc("confidence"), "position")
    first = good.withColumn("rn", F.row_number().over(Window.partitionBy("id", "key").orderBy(F.desc("confidence"), "position"))).where("rn = 1").drop("rn")
    return first.withColumn("rank", F.row_number().over(order)).drop("key")


def graph_edges(documents: DataFrame, document_tags: DataFrame) -> DataFrame:
    """(source, target): file to tag, for active documents."""
    files = documents.where(active()).select(F.col("document_id").alias("entity_id"))
    return document_tags.join(files, "entity_id", "left_semi").select(F.col("entity_id").alias("source"), F.col("tag_id").alias("target"))


def graph_nodes(documents: DataFrame, tags: DataFrame, document_tags: DataFrame, link_types: Sequence[str] = ("tags",)) -> DataFrame:
    """(id, label, kind, heat, heat_pct, degree): files, and each tag that a file carries."""
    edges = graph_edges(documents, document_tags)
    degrees = edges.groupBy("source").agg(F.count("*").alias("degree"))
    files = documents.where(active()).join(degrees, F.col("document_id") == F.col("source"), "left")
    file_nodes = files.select(
        F.col("document_id").alias("id"), F.col("filename").alias("label"), F.lit("file").alias("kind"), F.lit(0).cast("long").alias("heat"), F.lit(0.0).alias("heat_pct"), F.coalesce("degree", F.lit(0)).cast("long").alias("degree")
    )
    if "tags" not in link_types:
        return file_nodes
    heats = edges.groupBy("target").agg(F.count_distinct("source").alias("heat"))
    top = heats.agg(F.max("heat").alias("top"))
    tag_nodes = (
        heats.join(F.broadcast(top), how="cross")  # one row
        .join(tags, F.col("target") == F.col("tag_id"))
        .select(F.col("target").alias("id"), F.col("name").alias("label"), F.lit("tag").alias("kind"), "heat", heat_share(F.col("heat"), F.col("top")).alias("heat_pct"), F.col("heat").alias("degree"))
    )
    return file_nodes.unionByName(tag_nodes)


def tag_counts(edges: DataFrame, tags: DataFrame) -> DataFrame:
    """(workspace_id, name, heat, max_heat): how many files carry a tag of a name, and the most that any tag of the workspace has."""
    heats = edges.groupBy(F.col("target").alias("tag_id")).agg(F.count_distinct("source").alias("heat")).join(tags, "tag_id")
    named = heats.groupBy("workspace_id", "name").agg(F.max_by("heat", "tag_id").alias("heat"))  # the last of equal names counts
    top = heats.groupBy("workspace_id").agg(F.max("heat").alias("max_heat"))
    return named.join(F.broadcast(top), "workspace_id")  # a row for each workspace


def tag_count_map(counts: DataFrame) -> DataFrame:
    """(workspace_id, tag_counts map<name, heat>, max_heat) of :func:`tag_counts`: one row a workspace, as many entries as it has tags."""
    pairs = F.array_sort(F.collect_list(F.struct("name", "heat")))
    return counts.groupBy("workspace_id").agg(F.map_from_entries(pairs).alias("tag_counts"), F.max("max_heat").alias("max_heat"))


def neighbours(edges: DataFrame) -> DataFrame:
    """(id, neighbours) of each node of either kind: how many nodes it is linked with."""
    both = edges.select(F.col("source").alias("id"), F.col("target").alias("other")).unionByName(edges.select(F.col("target").alias("id"), F.col("source").alias("other")))
    return both.groupBy("id").agg(F.count_distinct("other").alias("neighbours"))
