"""From source files to a graph: entities, modules, paths, references,
edges, data flow, containment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evolve, graph, hierarchy
from ..schema import CodeGraph
from ..sources.extract import extract


def parsed(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities without modules, raw references) of files, each parsed once."""
    entities, raw = extract(files)
    return entities.withColumns({"semantic_features": F.array().cast("array<string>"), "feature_source": F.lit(None).cast("string"), "hierarchy_path": hierarchy.structural_path(F.col("file"))}), raw


def build(files: DataFrame, old: CodeGraph | None = None) -> CodeGraph:
    entities, raw = parsed(files)
    modules = graph.module_entities(entities).withColumns({"semantic_features": F.array().cast("array<string>"), "hierarchy_path": hierarchy.structural_path(F.col("file"))})
    entities = entities.unionByName(modules, allowMissingColumns=True)
    if old is not None:
        entities, _ = evolve.merge_features(entities, old.entities)
    references = graph.populate_dependencies(entities, raw)
    return CodeGraph(entities, graph.edges_of(entities, references), references)
