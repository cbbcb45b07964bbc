"""Ranked search: lexical, vector, hybrid, and boosts by nearness to changes."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cosine, glob_regex, normalised_levenshtein, tokens
from ..schema import ENTITY_KINDS
from .hierarchy import in_scope

#: Weights of the lexical score and cuts (fixed values).
OVERLAP, PHRASE, EDIT, CLOSE, LEAST = 0.4, 0.2, 0.4, 0.6, 0.05
SEMANTIC, LEXICAL = 0.6, 0.4
FILE_KINDS = ["file", "module", "directory"]


def query_terms(query: str) -> list[str]:
    return query.lower().split()


def filtered(entities: DataFrame, scope: str = "", file_glob: str | None = None, lines: tuple[int, int] | None = None, kinds: str | None = None) -> DataFrame:
    """The candidates: in scope, by file glob (one that can't be read filters nothing), lines that
    overlap, kinds (unknown ones are dropped, and if all are, nothing is filtered)."""
    out = entities.filter(in_scope(F.col("hierarchy_path"), scope))
    regex = glob_regex(file_glob) if file_glob else None
    if regex:
        out = out.filter(F.col("file").rlike(regex))
    if lines:
        out = out.filter((F.col("line_end") >= lines[0]) & (F.col("line_start") <= lines[1]))
    if kinds:
        asked = {"module" if k in FILE_KINDS else k for k in (x.strip().lower() for x in kinds.split(","))} & set(ENTITY_KINDS)
        if asked:
            out = out.filter(F.col("kind").isin(sorted(asked)))
    return out


def idf(entities: DataFrame) -> DataFrame:
    """(token, df, idf): max(0, ln(N / (1 + df))), df over entities."""
    rows = entities.select("id", F.explode("semantic_features").alias("f")).select("id", F.explode(tokens(F.col("f"))).alias("token")).distinct()
    n = entities.agg(F.count(F.lit(1)).alias("n"))  # one row
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(n)).select("token", "df", F.greatest(F.lit(0.0), F.log(F.col("n") / (1 + F.col("df")))).alias("idf"))


def _nearness(term: str):
    return lambda x: normalised_levenshtein(x, F.lit(term))


def lexical_score(text: Column, terms: list[str], weights: dict[str, float]) -> Column:
    """0.4 of the weighted overlap, 0.1 if the query stands in the text, 0.4 of the mean of each
    term's best edit similarity above 0.6.  Terms without a weight weigh 1."""
    own = tokens(text)
    once = list(dict.fromkeys(terms))
    weight = {t: weights.get(t, 1.0) for t in once}
    total = sum(weight.values())
    overlap = F.lit(0.0)
    for t in once:
        overlap = overlap + F.when(F.array_contains(own, t), F.lit(weight[t])).otherwise(F.lit(0.0))
    overlap = overlap / total if total else F.lit(0.0)
    phrase = F.when(F.contains(F.lower(text), F.lit(" ".join(terms))), F.lit(0.5)).otherwise(F.lit(0.0))
    edit = F.lit(0.0)
    for t in terms:
        best = F.coalesce(F.array_max(F.transform(own, _nearness(t))), F.lit(0.0))
        edit = edit + F.when(best > CLOSE, best).otherwise(F.lit(0.0))
    return OVERLAP * overlap + PHRASE * phrase + EDIT * edit / len(terms)


def _weights(entities: DataFrame, terms: list[str]) -> dict[str, float]:
    """The query terms' weights: at most as many rows as terms."""
    return {r.token: r.idf for r in idf(entities).filter(F.col("token").isin(terms)).collect()}


def top(scored: DataFrame, k: int) -> DataFrame:
    """The first k by score, to nine decimals, then id."""
    return scored.orderBy(F.round("score", 9).desc(), "id").limit(k)


def search_features(entities: DataFrame, query: str, k: int) -> DataFrame:
    """(id, score, matched): each distinct feature is scored once, then summed by entity."""
    terms = query_terms(query)
    if not terms:
        return entities.select("id", F.lit(0.0).alias("score"), F.lit("").alias("matched")).limit(0)
    rows = entities.select("id", F.explode("semantic_features").alias("f"))
    scored = rows.select("f").distinct().withColumn("s", lexical_score(F.col("f"), terms, _weights(entities, terms))).filter(F.col("s") > LEAST)
    hits = rows.join(scored, "f").groupBy("id").agg(F.sum("s").alias("score"), F.array_join(F.sort_array(F.collect_list("f")), ",").alias("matched"))
    return top(hits.filter("score > 0"), k)


def search_snippets(entities: DataFrame, query: str, k: int) -> DataFrame:
    """(id, score): twice the name's score, the file's and half the path's, without weights."""
    terms = query_terms(query)
    if not terms:
        return entities.select("id", F.lit(0.0).alias("score")).limit(0)
    # Files and paths are few: each is scored once.
    by = lambda c: entities.select(c).distinct().withColumn(f"{c}_score", lexical_score(F.col(c), terms, {}))
    rows = entities.select("id", "name", "file", "hierarchy_path").join(by("file"), "file").join(by("hierarchy_path"), "hierarchy_path")
    score = 2 * lexical_score(F.col("name"), terms, {}) + F.col("file_score") + 0.5 * F.col("hierarchy_path_score")
    return top(rows.select("id", score.alias("score")).filter(F.col("score") > LEAST), k)


def search_auto(entities: DataFrame, query: str, k: int) -> DataFrame:
    """Both modes' first 2k, added up with half the snippets' score."""
    f = search_features(entities, query, 2 * k).select("id", F.col("score").alias("f"))
    s = search_snippets(entities, query, 2 * k).select("id", F.col("score").alias("s"))
    both = f.join(s, "id", "full")
    return top(both.select("id", (F.coalesce("f", F.lit(0.0)) + 0.5 * F.coalesce("s", F.lit(0.0))).alias("score")), k)


def rank_normalised(scored: DataFrame) -> DataFrame:
    """(id, rank_score): 1 - rank / N.  For lists already cut to a top k."""
    w = Window.orderBy(F.round("score", 9).desc(), "id")
    return scored.select("id", (1 - (F.row_number().over(w) - 1) / F.count(F.lit(1)).over(Window.partitionBy())).alias("rank_score"))


def hybrid(lexical: DataFrame, semantic: DataFrame, k: int) -> DataFrame:
    """0.6 of the semantic and 0.4 of the lexical rank score."""
    a = rank_normalised(semantic).withColumnRenamed("rank_score", "a")
    b = rank_normalised(lexical).withColumnRenamed("rank_score", "b")
    both = a.join(b, "id", "full")
    return top(both.select("id", (SEMANTIC * F.coalesce("a", F.lit(0.0)) + LEXICAL * F.coalesce("b", F.lit(0.0))).alias("score")), k)


def vector_scores(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """(id, score): an entity's best cosine over its vectors (id, vector), if above 0."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return top(vectors.groupBy("id").agg(F.max(cosine(F.col("vector"), q)).alias("score")).filter("score > 0"), k)


def embedding_status(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, status) from (id, features): kept, changed, added or pruned, by a hash of the features
    in their order, trimmed and lower-case."""
    mark = F.sha2(F.concat_ws("\n", F.transform("features", lambda f: F.lower(F.trim(f)))), 256)
    both = old.select("id", mark.alias("o")).join(new.select("id", mark.alias("n")), "id", "full")
    return both.select("id", F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "pruned").when(F.col("o") == F.col("n"), "kept").otherwise("changed").alias("status"))


def change_nearness(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(id, hops): 0 for changed entities, 1 and 2 for their neighbours over any edge either way."""
    ways = edges.select(F.explode(F.array(F.struct(F.col("source").alias("a"), F.col("target").alias("b")), F.struct(F.col("target").alias("a"), F.col("source").alias("b")))).alias("w")).select("w.a", "w.b")
    seen = changed.select("id").distinct().withColumn("hops", F.lit(0))
    for hop in (1, 2):
        front = seen.filter(F.col("hops") == hop - 1).select(F.col("id").alias("a"))
        near = ways.join(front, "a", "left_semi").select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti")
        seen = seen.unionByName(near.withColumn("hops", F.lit(hop)))
    return seen


def boosted(scored: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """Scores times 3, 2 and 1.5 by nearness to a change; ``scored`` holds ten times as many rows as
    are asked for."""
    factor = F.when(F.col("hops") == 0, 3.0).when(F.col("hops") == 1, 2.0).when(F.col("hops") == 2, 1.5).otherwise(1.0)
    return top(scored.join(near, "id", "left").select("id", (F.col("score") * factor).alias("score")), k)


def retrieval_metrics(ranks: DataFrame) -> DataFrame:
    """Acc@1, 3, 5, 10 and MRR of (rank), 0 a miss."""
    at = lambda k: F.avg(F.when(F.col("rank").between(1, k), 1.0).otherwise(0.0)).alias(f"acc_{k}")
    return ranks.agg(at(1), at(3), at(5), at(10), F.avg(F.when(F.col("rank") > 0, 1.0 / F.nullif(F.col("rank"), F.lit(0))).otherwise(0.0)).alias("mrr"))


def bootstrap_interval(ranks: list[int], rounds: int = 1000, seed: int = 42) -> tuple[float, float]:
    """The 95 % interval of the mean reciprocal rank; queries are few."""
    import random

    rng, values = random.Random(seed), [1 / r if r else 0.0 for r in ranks]
    means = sorted(sum(rng.choices(values, k=len(values))) / len(values) for _ in range(rounds))
    return means[int(0.025 * rounds)], means[min(rounds - 1, int(0.975 * rounds))]


def search(entities: DataFrame, query: str, k: int = 10, mode: str = "auto", scope: str = "", file_glob: str | None = None, lines: tuple[int, int] | None = None, kinds: str | None = None, semantic: DataFrame | None = None, edges: DataFrame | None = None, changed: DataFrame | None = None) -> DataFrame:
    """(id, score) of the best ``k``: the filters, then the mode (features, snippets or auto), then, with the
    scores ``semantic`` (id, score), both ranks together, and with ``changed`` (id) the boost by nearness over
    ``edges``, for which ten times as many are looked at.  An empty query finds nothing; an unknown mode is an error."""
    modes = {"features": search_features, "snippets": search_snippets, "auto": search_auto}
    if mode not in modes:
        raise ValueError(f"unknown mode {mode}, known are {sorted(modes)}")
    rows = filtered(entities, scope, file_glob, lines, kinds)
    wide = 10 * k if changed is not None else k
    found = modes[mode](rows, query, wide).select("id", "score")
    if not query_terms(query):
        return found
    if semantic is not None:
        found = hybrid(found, top(semantic.join(rows.select("id"), "id", "left_semi").select("id", "score"), wide), wide)
    if changed is not None:
        if edges is None:
            raise ValueError("changes need the edges")
        found = boosted(found, change_nearness(edges, changed), k)
    return top(found, k)


def hashing_embedder(dim: int = 384, model=None):
    """A vectorised function from texts to unit vectors: ``model``, from a list of texts to an array of vectors
    a text, else signed counts of hashed words.  Null texts have none of either: zeros."""

    def hashed(texts: list[str]) -> np.ndarray:
        words = [t.lower().split() for t in texts]
        names = sorted(set().union(*words)) if words else []
        place = {w: i for i, w in enumerate(names)}
        crc = np.array([zlib.crc32(w.encode()) for w in names], dtype=np.int64)  # each word once
        flat = np.fromiter((place[w] for t in words for w in t), dtype=np.int64, count=sum(map(len, words)))
        rows = np.repeat(np.arange(len(words)), [len(t) for t in words])
        signs = np.where(crc >> 31, 1.0, -1.0)
        return np.bincount(rows * dim + crc[flat] % dim, weights=signs[flat], minlength=len(words) * dim).reshape(-1, dim) if len(flat) else np.zeros((len(words), dim))

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        found = np.asarray((model or hashed)([t or "" for t in texts]), dtype=float)
        norm = np.linalg.norm(found, axis=1, keepdims=True)
        return pd.Series(list(found / np.where(norm == 0, 1.0, norm)))

    return embed
