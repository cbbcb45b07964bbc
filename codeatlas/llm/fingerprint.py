"""Document fingerprints by locally consistent parsing.

A text's code points are the first level's symbols.  At each level runs of one symbol are
folded into one; deterministic coin tossing turns neighbours' differing bits into labels of
less than eight values, three times; blocks begin at local maxima of the labels; and a
block's name is a hash of its symbols, the next level's symbol.  Where a block begins depends
on a few neighbours only, so that equal substrings get equal names but near their ends,
whatever stands before them.  The names of level 2 and above, down to one, are the text's
signatures; a fingerprint keeps the least signature of each of ``BINS`` residue classes.

Defined results: null text is empty, its fingerprint is the empty string; two empty
fingerprints have likeness 1, an empty and another 0.  ``fingerprint_neighbours`` orders rows
by (doc_id, text), nulls first, so that repeated ids have a fixed order; the only row of a
table is its own neighbour; rows of one id share a range, so a task; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_columns
from .hashing import U, mix
from .order import id_bounds, partitions, range_of

BINS = 64
#: Code points parsed at once.
CHUNK = 1 << 18
_LOWEST = np.array([0, *((int(x) & -int(x)).bit_length() - 1 for x in range(1, 256))], dtype=np.uint8)
#: Random odd factors of a block's places: a block's name is a multilinear hash of its symbols.
_PLACE = mix(np.arange(1, 257, dtype=U)) | U(1)


def _toss(labels: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round of coin tossing: twice the lowest bit at which a label differs from the one
    before, plus that bit; a text's first symbol takes bit 0."""
    differ = np.empty_like(labels)
    np.bitwise_xor(labels[1:], labels[:-1], out=differ[1:])
    differ[first] = 1
    if labels.dtype == np.uint8:
        low = _LOWEST[differ]
        return low * np.uint8(2) + ((labels >> low) & np.uint8(1))
    low = np.bitwise_count((differ - U(1)) & ~differ)
    return low * np.uint8(2) + ((labels >> low.astype(U)) & U(1)).astype(np.uint8)


def _sizes(starts: np.ndarray, n: int) -> np.ndarray:
    out = np.empty(len(starts), dtype=np.int64)
    np.subtract(starts[1:], starts[:-1], out=out[:-1])
    out[-1] = n - starts[-1]
    return out


def _level(symbols: np.ndarray, starts: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The next level of all texts' symbols; ``starts`` is where each text (none is empty) begins."""
    new = np.empty(len(symbols), dtype=bool)
    np.not_equal(symbols[1:], symbols[:-1], out=new[1:])
    new[starts] = True
    at = np.flatnonzero(new)
    lengths = None
    if len(at) < len(symbols):
        lengths = _sizes(at, len(symbols))
        starts = np.searchsorted(at, starts)
        symbols = symbols[at]
    # Symbols of one byte, as most code points are, toss alike in a narrower type.
    narrow = level == 1 and symbols.max() < 256
    labels = _toss(_toss(_toss(symbols.astype(np.uint8) if narrow else symbols, starts), starts), starts)
    if lengths is not None:
        many = np.flatnonzero(lengths > 1)
        symbols[many] = mix(symbols[many] + lengths[many].astype(U) * U(0x8CB92BA72F3D8DD7))
    cut = np.zeros(len(symbols), dtype=bool)
    up = labels[1:] > labels[:-1]
    cut[1:-1] = up[:-1] & (labels[1:-1] > labels[2:])
    cut[starts[1:] - 1] = False  # a text's last symbol has no neighbour after it
    cut[starts] = True
    begins = np.flatnonzero(cut)
    place = np.arange(len(symbols)) - np.repeat(begins, _sizes(begins, len(symbols)))
    coded = (symbols + U(1)) * _PLACE[np.minimum(place, 255, out=place)]
    return mix(np.add.reduceat(coded, begins) + U(level)), np.searchsorted(begins, starts)


def phrase_names(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each level from 1: the names of all phrases, where each text's begin, and the
    numbers of those texts, which are the ones that had several names one level below."""
    some = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    symbols = np.frombuffer(b"".join(some), dtype=np.uint32).astype(U)
    starts = np.cumsum([0, *(len(s) // 4 for s in some[:-1])])
    which = np.arange(len(texts))
    for level in count(1):  # until every text is one name: a level has at most half the names of the one below
        symbols, starts = _level(symbols, starts, level)
        yield symbols, starts, which
        if level > 1:
            sizes = _sizes(starts, len(symbols))
            going = sizes > 1
            if not going.any():
                return
            if not going.all():
                symbols, which, sizes = symbols[np.repeat(going, sizes)], which[going], sizes[going]
                starts = np.cumsum(sizes) - sizes


def _fingerprints(texts: list[str], bins: int) -> list[str]:
    keys = []
    for level, (names, starts, which) in enumerate(phrase_names(texts), 1):
        if level > 1:
            sizes = _sizes(starts, len(names))
            slot = np.repeat(which.astype(U) * U(bins), sizes) + names % U(bins)
            keys.append(slot << U(40) | mix(names) >> U(24))
    keys = np.sort(np.concatenate(keys))
    slot = (keys >> U(40)).astype(np.int64)
    first = np.flatnonzero(np.diff(slot, prepend=-1))
    kept = np.zeros(len(texts) * bins, dtype=">u2")
    kept[slot[first]] = np.maximum(mix(keys[first] & U((1 << 40) - 1)) >> U(48), U(1)).astype(np.uint16)
    data, width = kept.tobytes().hex(), 4 * bins
    return [data[i * width : (i + 1) * width] for i in range(len(texts))]


def fingerprints(texts: list[str | None], bins: int = BINS) -> list[str]:
    """Fingerprints, four hex digits for each bin (0000: empty bin)."""
    out = [""] * len(texts)
    part: list[int] = []
    size = 0
    for k in range(len(texts) + 1):
        t = texts[k] if k < len(texts) else None
        if part and (k == len(texts) or size + len(t or "") > CHUNK):
            for i, f in zip(part, _fingerprints([texts[i] for i in part], bins), strict=True):
                out[i] = f
            part, size = [], 0
        if t:
            part.append(k)
            size += len(t)
    return out


def likeness(one: list[str], two: list[str], bins: int = BINS) -> list[float]:
    """Share of the bins, of those that either fingerprint fills, in which both agree."""
    out = []
    for a, b in zip(one, two, strict=True):
        if a == b:
            out.append(1.0)
        elif not a or not b:
            out.append(0.0)
        else:
            x, y = np.frombuffer(bytes.fromhex(a), dtype=">u2"), np.frombuffer(bytes.fromhex(b), dtype=">u2")
            out.append(float(((x == y) & (x > 0)).sum()) / float(((x > 0) | (y > 0)).sum()))
    return out


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every text."""

    def run(columns: Iterator[dict]) -> Iterator[dict]:
        for c in columns:
            yield {"doc_id": c["doc_id"], "n_chars": [len(t or "") for t in c["text"]], "fingerprint": fingerprints(c["text"])}

    return map_columns(docs.select("doc_id", "text"), run, "doc_id long, n_chars long, fingerprint string")


def _with_neighbours(docs: DataFrame) -> DataFrame:
    """Rows (bucket, own, doc_id, text) dealt by ranges of ids and sorted within them; at the
    end of a range stands a copy (own false) of the row that follows it, and after the last
    range the first row.  Texts are moved once.  Which rows are copied is looked up in a broadcast table
    of a row a range."""
    n = partitions(docs)
    bucket = range_of(F.col("doc_id"), id_bounds(docs.select("doc_id"), "doc_id", n)).cast("int")
    heads = docs.select("doc_id", bucket.alias("b")).groupBy("b").agg(F.min("doc_id").alias("head"), F.max(F.col("doc_id").isNull()).alias("null_first"))
    heads = sorted(heads.collect())  # a row for each range
    copies = [(None if h.null_first else h.head, heads[i - 1].b) for i, h in enumerate(heads)]
    copies = F.broadcast(docs.sparkSession.createDataFrame(copies, "head long, copy_to int"))
    own = F.struct(bucket.alias("bucket"), F.lit(True).alias("own"))
    copied = F.struct(F.col("copy_to").alias("bucket"), F.lit(False).alias("own"))
    places = F.when(F.col("copy_to").isNotNull(), F.array(own, copied)).otherwise(F.array(own))
    dealt = docs.select("doc_id", "text").join(copies, F.col("doc_id").eqNullSafe(F.col("head")), "left").select("doc_id", "text", F.explode(places).alias("p"))
    return dealt.select("p.bucket", "p.own", "doc_id", "text").repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", F.desc("own"), "doc_id", "text")


def fingerprint_neighbours(docs: DataFrame) -> DataFrame:
    """For each row: its fingerprint, that of its text with the last quarter replaced by the
    next row's beginning, and the likeness of its fingerprint to that and to the next row's."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(columns: Iterator[dict]) -> Iterator[dict]:
        waiting: list[tuple] = []  # rows of one bucket, the last without its next
        size = 0
        for c in columns:
            for row in zip(c["bucket"], c["own"], c["doc_id"], (t or "" for t in c["text"]), strict=True):
                if waiting and row[0] != waiting[-1][0]:
                    yield _compare(waiting)
                    waiting, size = [], 0
                if waiting and not waiting[-1][1]:
                    continue  # further rows that share the next row's id
                waiting.append(row)
                size += len(row[3])
                if size > CHUNK and len(waiting) > 1:
                    yield _compare(waiting)
                    waiting, size = waiting[-1:], len(waiting[-1][3])
        if waiting:
            yield _compare(waiting)

    return map_columns(_with_neighbours(docs.select("doc_id", "text")), run, schema)


def _compare(rows: list[tuple]) -> dict:
    """Results of all rows but the last, which only follows."""
    ids, texts = [r[2] for r in rows[:-1]], [r[3] for r in rows]
    edited = []
    for text, after in zip(texts[:-1], texts[1:], strict=True):
        n = len(text) // 4
        edited.append(text[: len(text) - n] + after[:n])
    own, changed = fingerprints(texts), fingerprints(edited)
    return {
        "doc_id": ids,
        "n_chars": [len(t) for t in texts[:-1]],
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
        "fingerprint": own[:-1],
        "edited_fingerprint": changed,
        "near_edited": likeness(own[:-1], changed),
        "near_next": likeness(own[:-1], own[1:]),
    }
