"""Benchmark decontamination by greedy string tiling with running Karp-Rabin matching.

Words (runs of letters and digits, lower-cased) are the tokens.  A document and a benchmark
item that share a run of ``SEED`` words are joined; the pair is tiled: matches are looked for
from long to short by rolling hashes of windows of unmarked words, the longest are marked
first, and no word is marked twice.  The share of the item's words under tiles is its
coverage, so that a passage whose sentences were moved around is covered all the same.

Items of at most ``SEEDS`` words and ``SEED_BYTES`` bytes are sent to the workers, and a document is
tiled where it is read; more items are joined with the documents' seeds by a shuffle.  There, texts
stand for rows by their digests, so that both ways judge each row by its own text and give the same
rows.  For a coverage c, a document must hold a fifth of c of an item's seeds: as many of the item's
most common seeds are therefore not needed to find it, and common wording makes few candidates.

Defined results: null or empty texts, and items of fewer than ``SEED`` words that a document
does not contain whole, match nothing; an item shorter than ``SEED`` words has one seed, all
its words.  Repeated items and rows are matched each, whatever their ids, and null ids are carried like
others: a row goes if its own text is contaminated, and only then.  Empty tables give no matches;
extra columns are ignored by ``matches`` and kept by ``decontaminate``.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, by_ids, keep_rows, map_columns, scratch

#: Shortest tile in words, coverage from which a document counts as contaminated, and the
#: bound of the seeds that are sent to every worker.
SEED, COVERAGE, SEEDS = 5, 0.5, 1_000_000
#: The same bound in bytes of the items' texts.
SEED_BYTES = 32 << 20
_WORD = re.compile(r"[^\W_]+")
BASE, MODULUS = 1_000_003, (1 << 61) - 1


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _windows(tokens: list[int], size: int) -> Iterator[tuple[int, int]]:
    """(start, rolling hash) of the windows of ``size`` tokens; a token under 0 (marked, or of
    no interest) breaks windows."""
    lead, value, run = pow(BASE, size, MODULUS), 0, 0
    for i, t in enumerate(tokens):
        if t < 0:
            value = run = 0
            continue
        value = (value * BASE + t + 1) % MODULUS
        run += 1
        if run > size:
            value = (value - (tokens[i - size] + 1) * lead) % MODULUS
        if run >= size:
            yield i - size + 1, value


def tile(item: list[int], text: list[int], least: int = SEED) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in text, length), longest first.  Tokens under 0 in ``text``
    match nothing."""
    item, text, tiles = list(item), list(text), []
    length = 4 * least
    while True:
        table = defaultdict(list)
        for j, h in _windows(text, length):
            table[h].append(j)
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        longest = 0
        for i, h in _windows(item, length):
            for j in table.get(h, ()):
                if item[i : i + length] != text[j : j + length]:
                    continue
                if i and j and item[i - 1] == text[j - 1] >= 0:
                    continue  # part of the match that begins before
                k = length
                while i + k < len(item) and j + k < len(text) and item[i + k] == text[j + k] >= 0:
                    k += 1
                found[k].append((i, j))
                longest = max(longest, k)
        if longest > 2 * length:
            length = longest  # very long matches come first
            continue
        late = False
        for k in sorted(found, reverse=True):
            for i, j in found[k]:
                if min(item[i : i + k]) < 0 or min(text[j : j + k]) < 0:
                    late = True  # a longer tile took part of it; the rest is looked for again
                    continue
                tiles.append((i, j, k))
                for x in range(k):
                    item[i + x], text[j + x] = -1, -2
        if late:
            continue
        if length == least:
            return tiles
        length = max(least, length // 2)


class Items:
    """Benchmark items by their seeds."""

    def __init__(self, rows: list[tuple], seed: int):
        self.seed, self.vocabulary = seed, {}
        self.items: list[tuple[int, list[int]]] = []
        self.seeds: dict[tuple, list[int]] = defaultdict(list)
        for item_id, text in rows:
            tokens = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            if tokens:
                self.items.append((item_id, tokens))
                for i in range(max(1, len(tokens) - seed + 1)):
                    self.seeds[tuple(tokens[i : i + seed])].append(len(self.items) - 1)
        self.short = sorted({len(s) for s in self.seeds if len(s) < seed})
        get = [s for s in self.seeds if len(s) == seed]
        self.hashes = np.unique(self._hash(np.array(get, dtype=np.uint64).reshape(-1, seed).T))

    @staticmethod
    def _hash(columns: np.ndarray | list) -> np.ndarray:
        value = np.zeros(columns[0].shape, dtype=np.uint64)
        for c in columns:
            value = (value ^ c) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
        return value

    def seeded(self, tokens: list[int]) -> dict[int, list[tuple[int, int]]]:
        """For each item that shares seeds with the text: the seeds' places (start, length)."""
        n, hit = self.seed, defaultdict(list)
        if len(tokens) >= n and len(self.hashes):
            ids = np.array(tokens, dtype=np.int64)
            known = ids >= 0
            ok = known[: len(ids) - n + 1].copy()
            for k in range(1, n):
                ok &= known[k : len(ids) - n + 1 + k]
            at = np.flatnonzero(ok)
            if len(at):
                own = ids.astype(np.uint64)
                value = self._hash([own[at + k] for k in range(n)])
                place = np.minimum(np.searchsorted(self.hashes, value), len(self.hashes) - 1)
                for i in at[self.hashes[place] == value].tolist():
                    for item in set(self.seeds.get(tuple(tokens[i : i + n]), ())):
                        hit[item].append((i, n))
        for n in self.short:
            for i in range(len(tokens) - n + 1):
                for item in set(self.seeds.get(tuple(tokens[i : i + n]), ())):
                    hit[item].append((i, n))
        return hit

    def matches(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item_id, coverage, tiles, longest tile) of each item that shares a seed."""
        get = self.vocabulary.get
        tokens = [get(w, -1) for w in words_of(text)]
        out = []
        for item, places in self.seeded(tokens).items():
            # Every match of at least a seed's length is made of seeds: other words can't be in tiles.
            near, last = [], 0
            for i, n in places:
                if i > last:
                    near.append(-1)
                near += tokens[max(i, last) : i + n]
                last = max(last, i + n)
            item_id, own = self.items[item]
            tiles = tile(own, near, min(self.seed, len(own)))
            if tiles:
                out.append((item_id, sum(k for _, _, k in tiles) / len(own), len(tiles), max(k for _, _, k in tiles)))
        return sorted(out, key=lambda x: (x[0] is None, x[0], x[1]))


def _fits(items: DataFrame, most: int) -> bool:
    """Whether the items are small enough to be sent to every worker."""
    words = F.size(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    row = items.agg(F.sum(F.greatest(words, F.lit(1))).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    return (row.n or 0) <= most and (row.b or 0) <= SEED_BYTES


_TILES = "coverage double, tiles long, longest long"
MATCHES = f"doc_id long, item_id long, {_TILES}"


def matches(docs: DataFrame, items: DataFrame, seed: int = SEED, most: int = SEEDS, coverage: float = 0.0) -> DataFrame:
    """(doc_id, item_id, coverage, tiles, longest) of every document and item that share a tile, with
    at least ``coverage``."""
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text")
    if not _fits(items, most):
        with scratch():
            found = _joined(docs, items, seed, coverage)
            digested = Stored(docs.select("doc_id", _digest().alias("doc")), "digests").df
            # A text's rows times its matches are the result's own rows.
            rows = digested.join(found, "doc").join(items.select("item_id", _digest().alias("item")), "item")
            return Stored(rows.select("doc_id", "item_id", "coverage", "tiles", "longest"), "matches").keep().df
    shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in items.collect()])  # at most ``most`` words

    def run(columns: Iterator[dict]) -> Iterator[dict]:
        own = Items(shared.value, seed)
        for c in columns:
            rows = [(d, *m) for d, t in zip(c["doc_id"], c["text"], strict=True) for m in own.matches(t) if m[1] >= coverage]
            yield dict(zip(("doc_id", "item_id", "coverage", "tiles", "longest"), map(list, zip(*rows, strict=True)) if rows else ([] for _ in range(5)), strict=True))

    return map_columns(docs, run, MATCHES)


def _digest() -> F.Column:
    """What stands for a text: equal texts, and null and empty ones, have the same."""
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def _seeds_of(seed: int, sizes: list[int] | None):
    """Rows (own, seed, places) from (own, text): the text's distinct seeds of the given sizes, or those of an
    item, and how often it has each."""

    def run(columns: Iterator[dict]) -> Iterator[dict]:
        for c in columns:
            ids, seeds, places = [], [], []
            for i, t in zip(c["own"], c["text"], strict=True):
                words = words_of(t)
                own = Counter(" ".join(words[k : k + n]) for n in (sizes or [min(seed, len(words))]) if n for k in range(len(words) - n + 1))
                ids += [i] * len(own)
                seeds += own.keys()
                places += own.values()
            yield {"own": ids, "seed": seeds, "places": places}

    return run


def _joined(docs: DataFrame, items: DataFrame, seed: int, coverage: float) -> DataFrame:
    """(doc, item, coverage, tiles, longest) of the digests of texts that match, for any number of items:
    both sides' seeds are shuffled, and the texts of the pairs found are brought together."""
    schema = "own string, seed string, places long"
    doc_texts, item_texts = (Stored(x.filter("text IS NOT NULL").groupBy(_digest().alias("own")).agg(F.first("text").alias("text")), "texts").df for x in (docs, items))
    of_items = Stored(map_columns(item_texts, _seeds_of(seed, None), schema), "item-seeds").df
    length = F.size(F.split("seed", " "))
    sizes = sorted(r[0] for r in of_items.select(length.alias("n")).distinct().collect())  # at most ``seed`` numbers
    of_docs = Stored(map_columns(doc_texts, _seeds_of(seed, sizes), schema).select(F.col("own").alias("doc"), "seed"), "doc-seeds").df
    # An item's seeds from rare to common; those that only come after enough others are not looked for.
    often = of_docs.join(of_items.select("seed").distinct(), "seed", "left_semi").groupBy("seed").agg(F.count(F.lit(1)).alias("n"))
    ranked = of_items.join(often, "seed").select(F.col("own").alias("item"), "seed", "places", "n")
    by_item = Window.partitionBy("item")
    words = F.sum("places").over(Window.partitionBy("own")) + length - 1  # of the item
    need = F.greatest(F.lit(1), F.ceil(words * coverage / seed - 1e-9))
    needed = of_items.select(F.col("own").alias("item"), "seed", need.alias("need"))
    commoner = F.coalesce(F.sum("places").over(by_item.orderBy(F.desc("n"), "seed").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    asked = ranked.join(needed, ["item", "seed"]).withColumn("commoner", commoner).filter("commoner >= need").select("item", "seed")
    pairs = Stored(of_docs.join(asked, "seed").select("doc", "item").distinct(), "pairs").df
    pairs = pairs.join(item_texts.select(F.col("own").alias("item"), F.col("text").alias("item_text")), "item").join(doc_texts.withColumnRenamed("own", "doc"), "doc")

    def run(columns: Iterator[dict]) -> Iterator[dict]:
        for c in columns:
            rows = []
            for d, i, item, text in zip(c["doc"], c["item"], c["item_text"], c["text"], strict=True):
                rows += [(d, *m) for m in Items([(i, item)], seed).matches(text) if m[1] >= coverage]
            yield dict(zip(("doc", "item", "coverage", "tiles", "longest"), map(list, zip(*rows, strict=True)) if rows else ([] for _ in range(5)), strict=True))

    return Stored(map_columns(pairs.select("doc", "item", "item_text", "text"), run, f"doc string, item string, {_TILES}"), "tiled").df


def contaminated(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The matches whose coverage reaches the threshold."""
    return matches(docs, items, coverage=coverage)


def decontaminate(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, most: int = SEEDS) -> DataFrame:
    """The rows of ``docs`` without those whose text covers an item to the threshold."""
    items = items.select("item_id", "text")
    if not _fits(items, most):
        with scratch():
            gone = Stored(_joined(docs.select("text"), items, SEED, coverage).select(F.col("doc").alias("_digest")).distinct(), "leaks").keep().df
        return by_ids(docs.withColumn("_digest", _digest()), gone, "_digest", "left_anti").select(docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in items.collect()])

    def decide(texts: list) -> list[bool]:
        own = decide.__dict__.setdefault("own", None) or decide.__dict__.update(own=Items(shared.value, SEED)) or decide.__dict__["own"]
        return [all(m[1] < coverage for m in own.matches(t)) for t in texts]

    return keep_rows(docs, decide)
