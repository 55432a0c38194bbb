"""Scalar operators on text, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarryline import config

_NAME = r"[a-z_][a-z0-9_]*"
#: The edges are spelt out: Java's own word boundary changed between versions.
_IDENTIFIER = r"(?<![\p{L}\p{N}_])[a-zA-Z_][a-zA-Z0-9_]*(?:\.[a-zA-Z_][a-zA-Z0-9_]*)*(?![\p{L}\p{N}_])"


def strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _pieces(name: Column) -> Column:
    return F.array_remove(F.split(name, "_"), "")


def tokenize(text: Column) -> Column:
    """Lower-case names in order; one with underscores is followed by its pieces. Duplicates stay."""
    names = F.regexp_extract_all(F.lower(text), F.lit(_NAME), F.lit(0))
    return F.flatten(F.transform(names, lambda x: F.when(F.contains(x, F.lit("_")), F.concat(F.array(x), _pieces(x))).otherwise(F.array(x))))


def lexical_text(qualified_name="qualified_name", name="name", file="file", kind="type", text="text") -> Column:
    return F.concat_ws(" ", qualified_name, name, file, kind, text)


def vector_text(qualified_name="qualified_name", name="name", kind="type", file="file", text="text") -> Column:
    return F.concat_ws(" ", qualified_name, name, kind, file, text)


def query_tokens(query: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit(_NAME), F.lit(0)))


def name_tokens(name: Column) -> Column:
    """Dotted parts of a name and the pieces of each between underscores."""
    parts = F.filter(F.split(F.lower(name), r"\."), lambda x: x != "")
    return F.array_distinct(F.flatten(F.transform(parts, lambda x: F.concat(F.array(x), _pieces(x)))))


def identifiers(text: Column) -> Column:
    """Names in a text that have an underscore or a dot, each once, in order."""
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(_IDENTIFIER), F.lit(0)), lambda x: F.contains(x, F.lit("_")) | F.contains(x, F.lit("."))))


def identifier_score(found: Column, name: Column) -> Column:
    """1 if one of the identifiers is the name or a dotted part of it, 0.5 if it lies within, else 0."""
    low, parts = F.lower(name), F.split(F.lower(name), r"\.")
    one = lambda x: F.when(F.array_contains(parts, F.lower(x)) | (F.lower(x) == low), 1.0).when(F.contains(low, F.lower(x)), 0.5).otherwise(0.0)
    return F.coalesce(F.array_max(F.transform(found, one)), F.lit(0.0))


def name_score(query: Column, name: Column, stop_words: Sequence[str] = config.STOP_WORDS) -> Column:
    """The share of the query's meaningful tokens that the name has; both are token arrays."""
    wanted = F.array_except(query, strings(stop_words))
    return F.when((F.size(wanted) > 0) & (F.size(name) > 0), F.size(F.array_intersect(wanted, name)) / F.size(wanted)).otherwise(0.0)


def entity_score(query: Column, name: Column) -> Column:
    return F.array_contains(query, F.lower(F.split(name, r"\.")[0])).cast("double")


def normalized(query: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(query)), r"\s+", " ")


def expand(query: Column, expansions=config.EXPANSIONS) -> Column:
    """The query followed by the terms of every phrase that it contains, each term once."""
    low = F.regexp_replace(F.regexp_replace(F.lower(query), r"^\s+|\s+$", ""), r"\s+", " ")
    terms = F.array_distinct(F.flatten(F.array(*[F.when(F.contains(low, F.lit(p)), strings(t)).otherwise(F.array().cast("array<string>")) for p, t in expansions])))
    return F.when(F.size(terms) > 0, F.concat(query, F.lit(" "), F.array_join(terms, " "))).otherwise(query)


def last_part(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def first_part(name: Column) -> Column:
    return F.split(name, r"\.")[0]


def action(name: Column) -> Column:
    """The words of a name's last part."""
    return F.array_join(_pieces(last_part(name)), " ")


def top_folder(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, parts[0]).otherwise("[root]")


def distinct_lines(items: Column) -> Column:
    """Stripped items without the empty ones, each once, in order."""
    return F.array_distinct(F.array_remove(F.transform(items, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), ""))


def operation(code: Column, operations=config.OPERATIONS) -> Column:
    """What a piece of code does, by the tokens it contains; null if none of them."""
    found = F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(code, F.lit(t)), F.lit(p)) for t, p in operations])))
    return F.when(F.size(found) > 0, F.array_join(found, " and "))


def relationship_type(value: Column) -> Column:
    """Upper-case type of a relationship given as ``TYPE`` or ``TYPE: detail``; empty for null."""
    return F.upper(F.trim(F.coalesce(F.split(value, ":", 2)[0], F.lit(""))))


def relationship_line(kind: Column, source: Column, target: Column) -> Column:
    """A sentence on an edge; empty for DEFINES and for edges without both ends."""
    tick = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    low = F.upper(F.coalesce(kind, F.lit("")))
    verb = (
        F.when(low == "CALLS", " calls ")
        .when(low == "INHERITS", " inherits from ")
        .when(low == "INHERITS_METHOD", " inherits the method ")
        .when(low == "IMPORTS", " imports ")
        .otherwise(F.concat(F.lit(" — "), low, F.lit(" → ")))
    )
    whole = (F.coalesce(source, F.lit("")) != "") & (F.coalesce(target, F.lit("")) != "") & (low != "DEFINES")
    return F.when(whole, F.concat(tick(source), verb, tick(target))).otherwise("")


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty, else the empty text."""
    return F.coalesce(*[F.when(c != "", c) for c in columns], F.lit(""))


def first_paragraph(doc: Column, most: int = 300) -> Column:
    """The first paragraph on one line, cut to ``most`` characters with an ellipsis."""
    lines = F.split(F.split(F.trim(doc), "\n\n", 2)[0], "\n")
    flat = F.array_join(F.transform(lines, lambda x: F.trim(x)), " ")
    return F.when(F.length(flat) > most, F.concat(F.left(flat, F.lit(most - 3)), F.lit("..."))).otherwise(flat)
