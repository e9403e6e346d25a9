"""Scalars over paths, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodegraph.functions.dictionaries import CONFIG_NAMES, ENTRYPOINTS, EXTENSION_LANGUAGE, SOURCE_EXTENSIONS


def extension(path: Column) -> Column:
    """The text after the path's last dot, lower-cased; the whole path without a dot."""
    return F.lower(F.substring_index(path, ".", -1))


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in EXTENSION_LANGUAGE.items() for x in kv])
    return F.element_at(table, extension(path))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_source(path: Column) -> Column:
    return extension(path).isin(*SOURCE_EXTENSIONS)


def is_config(path: Column) -> Column:
    return F.lower(basename(path)).isin(*CONFIG_NAMES)


def is_entrypoint(path: Column) -> Column:
    return reduce(lambda a, b: a | b, [path.rlike(p) for p in ENTRYPOINTS])


def node_kind(path: Column) -> Column:
    return F.when(is_config(path), "config").otherwise("file")


def default_module(path: Column) -> Column:
    """Where no workspace root holds the path: src/<x> below src, else the first segment, else root."""
    parts = F.split(path, "/")
    return F.when((parts[0] == "src") & (F.size(parts) > 2), F.concat(F.lit("src/"), parts[1])).when(F.size(parts) > 1, parts[0]).otherwise("root")


def normalise(path: Column) -> Column:
    """Without empty segments and dots; two dots drop the segment before, if any."""

    def step(stack: Column, p: Column) -> Column:
        shorter = F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))
        return F.when((p == "") | (p == "."), stack).when(p == "..", shorter).otherwise(F.concat(stack, F.array(p)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def directory(path: Column) -> Column:
    """All segments but the last, empty for a file at the root."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def external_package(spec: Column) -> Column:
    """The first segment, or the first two of a scoped package."""
    return F.when(spec.startswith("@"), F.substring_index(spec, "/", 2)).otherwise(F.substring_index(spec, "/", 1))


def is_relative_spec(spec: Column) -> Column:
    """How syntax trees tell relative specs; lists of patterns have predicates of their own."""
    return spec.startswith("./") | spec.startswith("../") | spec.startswith("/")


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))
