"""The data model: a graph is a bundle of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of entities and edges in their order (fixed values).
ENTITY_KINDS = ["function", "class", "method", "page", "layout", "component", "hook", "store", "module", "controller", "model", "service", "middleware", "route", "test"]
EDGE_KINDS = ["imports", "invokes", "inherits", "composes", "renders", "reads_state", "writes_state", "dispatches", "data_flow", "contains"]
DEPENDENCY_KINDS = EDGE_KINDS[:-1]

ENTITIES = (
    "id string, kind string, name string, file string, line_start int, line_end int, parent_class string, semantic_features array<string>, feature_source string, hierarchy_path string,"
    " signature struct<parameters: array<struct<name: string, type_annotation: string>>, return_type: string>"
)
EDGES = "source string, target string, kind string"
REFERENCES = "source string, file string, name string, kind string"


@dataclass
class CodeGraph:
    """Entities, edges, and if known the references by name that edges are resolved from, so that they can
    be resolved again after changes."""

    entities: DataFrame
    edges: DataFrame
    references: DataFrame | None = None


def kind_ord(kind: Column) -> Column:
    """An edge kind's place in EDGE_KINDS; unknown kinds come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, EDGE_KINDS)), kind), F.lit(0)), F.lit(99)).cast("int")


def check_kinds(kinds: list[str] | None, known: list[str]) -> list[str] | None:
    """The kinds of a filter; an unknown one is an error."""
    unknown = sorted(set(kinds or []) - set(known))
    if unknown:
        raise ValueError(f"unknown kinds: {unknown}")
    return kinds


def migrate(df: DataFrame, columns: list[str]) -> DataFrame:
    """Forward slashes in ids and paths."""
    return df.withColumns({c: F.translate(c, "\\", "/") for c in columns})
