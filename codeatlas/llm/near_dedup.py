"""MinHash near-duplicates with sequential Bayesian verification.

Documents are sets of distinct five-word shingles (A-Z lowered, words between ASCII white
space).  Every document gets a MinHash signature; equal sets are collapsed to their
smallest id; the signatures' bands give candidates; a candidate's signatures are compared
batch by batch, and it is dropped as soon as the posterior probability that its similarity
reaches the threshold falls under ``MISS``; survivors are verified on their full sets.  Pairs that
are rows are compared by native expressions: small partitions need no Python task each.

Candidates come in two steps, so that a bucket of n documents never gives n^2 rows.  First
each document meets one document, the busiest of its buckets (that in most buckets), which
joins families of copies into components.  Then only buckets that still hold several
components count, and only pairs across components.  Such a bucket of at most ``SMALL``
documents gives its pairs as rows.  A larger one is cut into blocks of ``BLOCK`` documents, or, beyond
``BLOCKS`` of these, into larger ones of up to ``BLOCK_MOST``; a task
holds the ids and signatures of two blocks and returns the documents that have a partner the
posterior does not rule out; only these are met again with their sets, in blocks of about ``SHINGLES``
shingles, and a task returns the links that join components, at most one a document.  No candidate
is dropped: at the end two documents that share a bucket are in one component, or were compared.
Comparisons of signatures are quadratic in a bucket's documents of different components, never rows.

Buckets and hubs that hold many documents are looked up by broadcast (``common.look_up``).

Defined results: null or empty texts and texts without words have an empty set, link with
nothing and are kept.  Fewer than five words are one shingle.  Rows with a null id link
with nothing (component null, kept true).  Repeated rows of one id are one document, and
each row gets a result.  An empty table gives an empty result.  Extra columns are ignored
by ``near_duplicates`` and kept by ``near_dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import Stored, by_ids, components, hot_above, look_up, map_columns, scratch
from .hashing import U, mix, shingle_sets

WORDS, SIMILARITY = 5, 0.75
#: Bands of rows: a pair at the threshold shares no band with probability (1 - 0.75^4)^32 = 5e-6.
BANDS, ROWS = 32, 4
#: Signature values compared at once, and the posterior probability under which a pair is dropped.
BATCH, MISS = 16, 1e-7
#: Documents of a bucket whose pairs are rows.
SMALL = 64
#: Documents of a block of signatures, blocks of a bucket beyond which they grow, and the most they grow to;
#: shingles of a block of sets.
BLOCK, BLOCKS, BLOCK_MOST, SHINGLES = 1 << 8, 64, 1 << 12, 1 << 18


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """MinHash signatures, one row of ``n`` 32-bit values a set; empty sets get zeros."""
    out = np.zeros((len(sets), n), dtype=np.uint32)
    factors = mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
    some = [k for k, s in enumerate(sets) if len(s)]
    lo = 0
    while lo < len(some):
        hi, total = lo, 0
        while hi < len(some) and (total == 0 or total + len(sets[some[hi]]) <= 1 << 14):
            total += len(sets[some[hi]])
            hi += 1
        part = some[lo:hi]
        values = np.concatenate([sets[k] for k in part])
        starts = np.cumsum([0, *(len(sets[k]) for k in part[:-1])])
        for j, f in enumerate(factors):
            out[part, j] = np.minimum.reduceat(((values * f) >> U(32)).astype(np.uint32), starts)
        lo = hi
    return out


def least_matches(n_max: int, batch: int, similarity: float, miss: float) -> list[int]:
    """For 1, 2, ... batches: the fewest equal values with which a pair stays.  With m of n
    equal and a uniform prior the similarity is Beta(m + 1, n - m + 1), and the probability
    that it reaches ``similarity`` is that of at most m successes in n + 1 trials."""
    out = []
    for n in range(batch, n_max + 1, batch):
        tail = 0.0
        for m in range(n + 1):
            tail += comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
            if tail >= miss:
                out.append(m)
                break
    return out


def _signed(docs: DataFrame, words: int, n: int) -> DataFrame:
    def run(columns: Iterator[dict]) -> Iterator[dict]:
        for c in columns:
            sets = shingle_sets([(t or "").encode() for t in c["text"]], words)
            rows = signatures(sets, n)
            yield {
                "doc_id": c["doc_id"],
                "n_shingles": [len(s) for s in sets],
                "set_hash": [_set_hash(s) for s in sets],
                "sig": [r.tobytes() for r in rows],
            }

    return map_columns(docs.select("doc_id", "text"), run, "doc_id long, n_shingles long, set_hash binary, sig binary")


def _set_hash(s: np.ndarray) -> bytes:
    one = mix(s ^ U(0xA0761D6478BD642F)).sum(dtype=U)
    two = mix(s + U(0xE7037ED1A0B428DB)).sum(dtype=U)
    return int(one).to_bytes(8, "big") + int(two).to_bytes(8, "big") + len(s).to_bytes(8, "big")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    def run(columns: Iterator[dict]) -> Iterator[dict]:
        for c in columns:
            sets = shingle_sets([(t or "").encode() for t in c["text"]], words)
            yield {"doc_id": c["doc_id"], "shingles": [s.view(np.int64) for s in sets]}

    return map_columns(docs.select("doc_id", "text"), run, "doc_id long, shingles array<long>")


def _posterior(pairs: DataFrame, n: int, similarity: float, batch: int, miss: float) -> DataFrame:
    """Pairs (a, b, sig_a, sig_b) that no batch of the ``n`` signature values rules out: (a, b)."""
    least = least_matches(n, batch, similarity, miss)
    if not least:
        return pairs.select("a", "b")
    same = f"size(filter(sequence(k * {batch}, k * {batch} + {batch - 1}), i -> substring(sig_a, 4 * i + 1, 4) = substring(sig_b, 4 * i + 1, 4)))"
    step = f"transform(array(equal + {same}), e -> if(e >= array({', '.join(map(str, least))})[k], e, -1))[0]"  # -1: ruled out, no further batch is compared
    return pairs.filter(f"aggregate(sequence(0, {len(least) - 1}), 0, (equal, k) -> if(equal < 0, -1, {step})) >= 0").select("a", "b")


def _exact(pairs: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b, set_a, set_b) whose full sets reach the similarity: (a, b)."""
    percent, one, two = round(similarity * 100), "CAST(size(set_a) AS BIGINT)", "CAST(size(set_b) AS BIGINT)"
    fits = f"100 * least({one}, {two}) >= {percent} * greatest({one}, {two})"
    reaches = f"{100 + percent} * CAST(size(array_intersect(set_a, set_b)) AS BIGINT) >= {percent} * ({one} + {two})"
    return pairs.filter(f"CASE WHEN {fits} THEN {reaches} ELSE false END").select("a", "b")


def _reaches(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    if 100 * min(len(one), len(two)) < percent * max(len(one), len(two)):
        return False
    at = np.searchsorted(two, one)
    both = int((two[np.minimum(at, len(two) - 1)] == one).sum())
    return 100 * both >= percent * (len(one) + len(two) - both)


def _partners(i: int, among: np.ndarray, sigs: np.ndarray, band: int, rows: int, batch: int, least: list[int]) -> np.ndarray:
    """Of the rows ``among``, those that share no earlier band with row ``i`` and that no batch of signature values rules out."""
    if band and len(among):
        before = (sigs[among, : band * rows] == sigs[i, : band * rows]).reshape(len(among), band, rows).all(axis=2).any(axis=1)
        among = among[~before]
    equal = np.zeros(len(among), dtype=np.int64)
    for k, m in enumerate(least):
        cut = slice(k * batch, (k + 1) * batch)
        equal += (sigs[among, cut] == sigs[i, cut]).sum(axis=1)
        stays = equal >= m
        among, equal = among[stays], equal[stays]
    return among


def _others(i: int, part: np.ndarray, block: np.ndarray, size: np.ndarray, two: bool, percent: int) -> np.ndarray:
    """Later rows in another component, and in the other of two blocks, whose sizes allow the similarity."""
    rest = np.arange(i + 1, len(part))
    rest = rest[(part[rest] != part[i]) & (100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i]))]
    return rest[block[rest] != block[i]] if two else rest


def likely(parts: list[int], blocks: list[int], sizes: list[int], sigs: np.ndarray, band: int, rows: int, similarity: float, batch: int, miss: float) -> np.ndarray:
    """Which documents of a bucket have a partner by their signatures."""
    least, percent = least_matches(sigs.shape[1], batch, similarity, miss), round(similarity * 100)
    part, block, size, two = np.array(parts), np.array(blocks), np.array(sizes), len(set(blocks)) > 1
    out = np.zeros(len(parts), dtype=bool)
    for i in range(len(parts) - 1):
        found = _partners(i, _others(i, part, block, size, two, percent), sigs, band, rows, batch, least)
        if len(found):
            out[i] = True
            out[found] = True
    return out


def join_block(ids: list[int], parts: list[int], blocks: list[int], sigs: np.ndarray, sets: list[np.ndarray], band: int, rows: int, similarity: float, batch: int, miss: float) -> list[tuple[int, int]]:
    """Links that join the components ``parts`` of documents that share band ``band``: pairs of
    the two blocks, or of the only one, that no earlier band has, by posterior and full sets."""
    least, percent = least_matches(sigs.shape[1], batch, similarity, miss), round(similarity * 100)
    root = {p: p for p in parts}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    part, block, two = np.array(parts), np.array(blocks), len(set(blocks)) > 1
    size = np.array([len(s) for s in sets])
    out = []
    for i in range(len(ids) - 1):
        for j in _partners(i, _others(i, part, block, size, two, percent), sigs, band, rows, batch, least).tolist():
            x, y = find(parts[i]), find(parts[j])
            if x != y and _reaches(sets[i], sets[j], percent):
                root[max(x, y)] = min(x, y)
                out.append((ids[i], ids[j]))
    return out


def _in_pairs(members: DataFrame, count: Column) -> DataFrame:
    """``members`` (key, band, d, n, c) dealt into ``count`` blocks a key, a row for each pair of blocks."""
    dealt = members.withColumn("blocks", F.greatest(count, F.lit(1)).cast("int")).withColumn("block", F.pmod(F.xxhash64("d"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    return dealt.select("key", "band", "d", "n", "c", "block", F.explode(pairs).alias("p")).select("key", "band", "d", "n", "c", "block", "p.i", "p.j")


def _in_blocks(apart: DataFrame, own_sig: DataFrame, own_set: DataFrame, rows: int, similarity: float, miss: float) -> DataFrame:
    """Links across components of large buckets (key, band, d, n, c, size)."""
    ship(apart.sparkSession)
    sig = own_sig.withColumnRenamed("doc_id", "d")

    def signs(t: pa.Table) -> np.ndarray:
        return np.frombuffer(b"".join(t["sig"].to_pylist()), dtype=np.uint32).reshape(t.num_rows, -1)

    def keep(t: pa.Table) -> pa.Table:
        some = likely(t["c"].to_pylist(), t["block"].to_pylist(), t["n"].to_pylist(), signs(t), t["band"][0].as_py(), rows, similarity, BATCH, miss)
        return t.select(["key", "band", "d", "n", "c"]).filter(pa.array(some))

    def link(t: pa.Table) -> pa.Table:
        sets = [s.values.to_numpy().view(U) for s in t["shingles"]]
        found = join_block(t["d"].to_pylist(), t["c"].to_pylist(), t["block"].to_pylist(), signs(t), sets, t["band"][0].as_py(), rows, similarity, BATCH, miss)
        return pa.table({"a": pa.array([min(x) for x in found], pa.int64()), "b": pa.array([max(x) for x in found], pa.int64())})

    blocks = F.greatest(F.least(F.ceil(F.col("size") / BLOCK), F.lit(BLOCKS)), F.ceil(F.col("size") / BLOCK_MOST))
    dealt = _in_pairs(apart, blocks).join(sig, "d")
    some = dealt.groupBy("key", "i", "j").applyInArrow(keep, "key long, band int, d long, n long, c long")
    some = Stored(some.distinct(), "likely").df
    total = some.groupBy("key").agg(F.sum("n").alias("total"))
    dealt = _in_pairs(look_up(some, total, "key", "inner"), F.ceil(F.col("total") / SHINGLES)).join(sig, "d").join(own_set.withColumnRenamed("doc_id", "d"), "d")
    return dealt.groupBy("key", "i", "j").applyInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    with scratch():
        return _near_duplicates(docs, similarity, words, bands, rows, miss).keep().df


def _near_duplicates(docs: DataFrame, similarity: float, words: int, bands: int, rows: int, miss: float) -> Stored:
    signed = Stored(_signed(docs, words, bands * rows), "signed").df
    some = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    first = Stored(some.groupBy("set_hash").agg(F.min(F.struct("doc_id", "n_shingles", "sig")).alias("r")).select("set_hash", "r.*"), "first").df

    key = "transform(sequence(0, {0}), i -> struct(i AS band, xxhash64(i, substring(sig, i * {1} + 1, {1})) AS key))".format(bands - 1, rows * 4)
    banded = first.select(F.col("doc_id").alias("d"), F.col("n_shingles").alias("n"), F.explode(F.expr(key)).alias("b")).select("d", "n", "b.key", "b.band")
    shared = banded.groupBy("key").agg(F.min("d").alias("x"), F.max("d").alias("y")).filter("x < y").select("key")
    alike = Stored(banded.join(shared, "key"), "members")
    busy = Stored(alike.df.groupBy("d").agg(F.count(F.lit(1)).alias("busy")), "busy").df  # at most ``bands`` rows a document
    member = Stored(alike.df.join(busy, "d"), "members")
    alike.drop()
    pivot = Stored(member.df.groupBy("key").agg(F.max(F.struct("busy", (-F.col("d")).alias("m"))).alias("p"), F.count(F.lit(1)).alias("size")), "pivot").df
    hot = Stored(pivot.filter(F.col("size") > hot_above(member.df)).select("key"), "hot").df
    met = Stored(look_up(member.df, pivot, "key", "inner", hot), "met").df
    member.drop()

    meeting = busy.select(F.col("d").alias("doc_id"))
    own_sig = Stored(by_ids(first.select("doc_id", "sig"), meeting, "doc_id", "left_semi"), "candidates").df
    own_set = Stored(_sets(by_ids(docs.select("doc_id", "text"), meeting, "doc_id", "left_semi"), words).dropDuplicates(["doc_id", "shingles"]), "sets").df

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(own_sig.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b")), "b")
        pairs = pairs.join(own_sig.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a")), "a")
        left = Stored(_posterior(pairs, bands * rows, similarity, BATCH, miss), "survivors").df
        left = left.join(own_set.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b")), "b")
        left = left.join(own_set.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a")), "a")
        return Stored(_exact(left, similarity).distinct(), "links").df

    star = met.groupBy("d").agg(F.max("p").alias("p")).select("d", (-F.col("p.m")).alias("hub")).filter("d <> hub")
    links = verified(star.select(F.least("d", "hub").alias("a"), F.greatest("d", "hub").alias("b")).distinct())

    part = components(links)
    named = part.df.withColumnsRenamed({"v": "d", "c": "cc"})
    parted = Stored(met.join(named, "d", "left").withColumn("c", F.coalesce("cc", "d")).drop("cc", "p", "busy"), "parted")
    part.drop()
    several = parted.df.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y")).filter("x < y").select("key")
    apart = Stored(look_up(parted.df, several, "key", "left_semi", hot), "apart").df
    parted.drop()
    small = apart.filter(F.col("size") <= SMALL)
    other = small.select("key", F.col("d").alias("d2"), F.col("n").alias("n2"), F.col("c").alias("c2"))
    near = "c < c2 AND 100 * least(n, n2) >= {0} * greatest(n, n2)".format(round(similarity * 100))
    across = small.join(other, "key").filter(near).select(F.least("d", "d2").alias("a"), F.greatest("d", "d2").alias("b")).distinct()
    large = _in_blocks(apart.filter(F.col("size") > SMALL).select("key", "band", "d", "n", "c", "size"), own_sig, own_set, rows, similarity, miss)
    links = links.unionByName(verified(across)).unionByName(Stored(large, "joined").df)

    part = components(links).df.withColumnsRenamed({"v": "first_id", "c": "cc"})
    class_of = first.select("set_hash", F.col("doc_id").alias("first_id")).join(part, "first_id", "left")
    class_of = class_of.select("set_hash", F.coalesce("cc", "first_id").alias("cc"))
    some = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "n_shingles", "set_hash")
    some = look_up(some, class_of, "set_hash", "inner").select("doc_id", "n_shingles", F.col("cc").alias("component_id"))
    alone = signed.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return Stored(some.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "near-duplicates")


def near_dedup(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without all but the smallest id of each group of near-duplicates."""
    with scratch():
        found = near_duplicates(docs, **options)
        gone = Stored(found.filter("NOT kept").select("doc_id").distinct(), "gone").keep().df
    return by_ids(docs, gone, "doc_id", "left_anti")
