"""Canonical JSON and the digests made of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalized


def canonical_json(c: Column) -> Column:
    """A struct (fields declared in sorted order) or array as compact JSON; nulls are kept and control characters are
    written in lower case."""
    j = F.to_json(c, {"ignoreNullFields": "false"})
    for code in [*range(0x0A, 0x10), *range(0x1A, 0x20)]:
        if code not in (0x0A, 0x0C, 0x0D):
            j = F.replace(j, F.lit(f"\\u00{code:02X}"), F.lit(f"\\u00{code:02x}"))
    return j


def digest(c: Column) -> Column:
    return F.sha2(canonical_json(c), 256)


def book_key(system: Column, book: Column) -> Column:
    """16 hex digits of the digest of both identifiers."""
    return F.substring(digest(F.array(normalized(system), normalized(book))), 1, 16)


def sorted_items(items: Column) -> Column:
    """An array of structs (with id) in the order of id, then of canonical JSON."""
    keyed = F.transform(items, lambda x: F.struct(x["id"].alias("id"), canonical_json(x).alias("j"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda x: x["x"])


def source_payload(title: Column, content: Column, **items: Column) -> Column:
    """What an analysis may read of a chapter. items: annotations, highlights, reflections, user_notes (arrays)."""
    chapter = F.struct(normalized(content).alias("content"), normalized(title).alias("title"))
    found = {"chapter": chapter} | {k: sorted_items(v) for k, v in items.items()}
    return F.struct(*(found[k].alias(k) for k in sorted(found)))


def input_fingerprint(source: Column, config: dict[str, str], schema_digest: str) -> Column:
    """The digest of configuration, result schema and source; books' metadata and identity don't count."""
    settings = F.struct(*(F.lit(config[k]).alias(k) for k in sorted(config)))
    return digest(F.struct(settings.alias("analysis_config"), F.lit(schema_digest).alias("chapter_analysis_schema_sha256"), source.alias("source")))


def card_id(book: Column, chapter: Column, kind: Column, content: Column, ordinal: Column) -> Column:
    """16 hex digits that stay the same as long as a card's content does."""
    return F.substring(digest(F.struct(book.alias("book_key"), chapter.alias("chapter_index"), content.alias("content"), kind.alias("kind"), ordinal.alias("ordinal"))), 1, 16)
