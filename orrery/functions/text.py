"""Scalar functions on names, chunks and texts, as Spark expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The language of each source file extension.
EXTENSION_LANGUAGE = {
    ".py": "python",
    ".js": "javascript",
    ".mjs": "javascript",
    ".ts": "typescript",
    ".tsx": "tsx",
    ".go": "go",
    ".rs": "rust",
    ".java": "java",
}


#: A symbol is a method, or else a class, if the name of its syntax node has one of these parts; anything else is a function.
METHOD_PARTS = ("method", "constructor")
CLASS_PARTS = ("class", "struct", "enum", "trait", "interface", "impl", "type")


def normalize_tag(name: Column) -> Column:
    """Lower-case, trimmed, inner blanks collapsed; a blank name gives null."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(F.lower(name), r"\s+", " ")), " +", " ")
    return F.when(bare != "", bare)


def chunk_id(document_id: Column, chunk_index: Column) -> Column:
    return F.sha2(F.concat_ws(":", document_id.cast("string"), chunk_index.cast("string")), 256)


def serialize_row(columns: Sequence[str]) -> Column:
    """``a=1; b=2``; a missing value is empty."""
    return F.concat_ws("; ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])


def tokens(text: Column) -> Column:
    """Lower-cased words between blanks."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != "")


def clamped(value: Column) -> Column:
    """A confidence in 0..1; what isn't a number counts as 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_to_number(value, F.lit("9.999999")).cast("double"), value.try_cast("double"), F.lit(0.0))))


def confidence_of_rank(position: Column) -> Column:
    """Confidence of the i-th name of a plain list, from 0."""
    return F.round(F.greatest(F.lit(0.3), F.lit(0.95) - position * 0.07), 3)


def progress_percent(current: Column, total: Column) -> Column:
    """Whole percent, halves to even; null without a total."""
    return F.when(total != 0, F.bround(100 * current / total, 0).cast("int"))


def heat_share(heat: Column, top: Column) -> Column:
    return F.when(top > 0, heat / top).otherwise(F.lit(0.0))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def language_of(path: Column, languages: Mapping[str, str] = EXTENSION_LANGUAGE) -> Column:
    known = F.create_map(*[F.lit(x) for pair in languages.items() for x in pair])
    return F.element_at(known, extension(path))


def symbol_kind(node_type: Column) -> Column:
    """method, class or function, from the name of a syntax node."""
    t = F.lower(node_type)

    def has(*words: str) -> Column:
        return F.rlike(t, F.lit("|".join(words)))

    return F.when(has(*METHOD_PARTS), "method").when(has(*CLASS_PARTS), "class").otherwise("function")


def topic_parts(topic: Column) -> Column:
    """``name:collection`` as a struct; without a colon the collection is null."""
    parts = F.split(topic, ":", 2)
    return F.struct(F.get(parts, F.lit(0)).alias("name"), F.get(parts, F.lit(1)).alias("collection"))


def breadcrumb(titles: Column) -> Column:
    return F.array_join(titles, " > ")


def highlighted(text: Column, query: str, before: str = "<mark>", after: str = "</mark>") -> Column:
    """The words of the query (longer than one character) marked wherever they stand."""
    words = sorted({w for w in query.split() if len(w) > 1}, key=lambda w: (-len(w), w))
    if not words:
        return text
    escaped = ["".join("\\" + c if not c.isalnum() else c for c in w) for w in words]
    return F.regexp_replace(text, "(?i)(" + "|".join(escaped) + ")", f"{before}$1{after}")


def masked(value: Column) -> Column:
    """A secret is shown as eight stars, a missing one as it is."""
    return F.when(value.isNotNull() & (value != ""), F.lit("*" * 8)).otherwise(value)


def unmasked(new: Column, old: Column) -> Column:
    """The old secret where the mask came back unchanged."""
    return F.when(new == "*" * 8, old).otherwise(new)


def prompt_text(text: Column, limit: int = 6000) -> Column:
    return F.substring(text, 1, limit)


def stale(started: Column, now: Column, limit_seconds: int) -> Column:
    """Whether processing began longer ago than the limit; a missing start isn't stale."""
    return F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(started) >= limit_seconds, F.lit(False))


#: Fixed value: the namespace of object identifiers, from which point ids are made.
OID_NAMESPACE = "6ba7b8129dad11d180b400c04fd430c8"


def point_id(name: Column) -> Column:
    """The version 5 UUID of a name in the namespace of object identifiers."""
    h = F.sha1(F.concat(F.unhex(F.lit(OID_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3) + 8).cast("long")))
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat_ws("-", *parts)


def encoded_metadata(metadata: Column) -> Column:
    """A struct as JSON, without its null fields."""
    return F.to_json(metadata, {"ignoreNullFields": "true"})


def decoded_metadata(text: Column, schema: str) -> Column:
    """The struct again; fields that were null are null."""
    return F.from_json(text, schema)
