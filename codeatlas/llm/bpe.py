"""Byte-level BPE by segment trees over byte positions.

A piece's byte positions are the leaves of a segment tree that keeps, at each inner node,
the leftmost position with the least pair rank below it.  A merge reads the root, joins the
live neighbours there and updates three leaves, each in a logarithmic number of steps.
Pieces of up to ``SHORT`` bytes are encoded many at a time, as rows of one array of trees;
longer ones one at a time, in flat arrays of some 45 bytes a byte.  Short pieces that occurred before
come from a bounded cache.

Defined results: null text is empty; empty text has no ids and decodes to nothing;
any text round-trips; rows are independent, so ties, repeated rows and empty tables need
no rule.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import map_columns

SHORT = 64
#: Pieces kept by a worker, each of at most SHORT characters; above it the cache starts again.
CACHE = 300_000
#: Pieces encoded at once.
TOGETHER = 1 << 12
#: No pair: above every rank.
NONE = 1 << 20
#: Letters, digits and marks of ASCII and Latin-1 that both pattern engines class alike.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf"[{_LETTERS}0-9 \n\t!-/:-@\[-`{{-~]*")


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from a file of lines "base64 rank"."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def plain_pattern(pattern: str) -> re.Pattern:
    """The same pattern for the standard library's faster engine, right for texts of
    ``_PLAIN`` characters: letter and digit classes written out."""
    own = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{_LETTERS}0-9]")
    own = own.replace(r"\p{L}", f"[{_LETTERS}]").replace(r"\p{N}", "[0-9]")
    return re.compile(own)


class Bpe:
    """Encodes by the ranks of a vocabulary, as the public libraries do for ordinary text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.plain = plain_pattern(pattern)
        self.words = {rank: word for word, rank in ranks.items()}
        self.decimal = {rank: str(rank) for rank in ranks.values()}
        self.texts = {str(rank): word for word, rank in ranks.items()}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for word, rank in ranks.items():
            for cut in range(1, len(word)):
                left, right = ranks.get(word[:cut]), ranks.get(word[cut:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = rank
        self.pairs = pairs
        self.bits = max(4, (len(pairs) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, NONE, dtype=np.int64)
        left = np.fromiter(pairs.keys(), dtype=np.int64, count=len(pairs))
        rank = np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs))
        at = self._slot(left)
        while len(left):  # open addressing: the first of those that want a free slot takes it
            free = self.keys[at] == -1
            _, first = np.unique(at[free], return_index=True)
            take = np.flatnonzero(free)[first]
            self.keys[at[take]], self.values[at[take]] = left[take], rank[take]
            rest = np.ones(len(left), dtype=bool)
            rest[take] = False
            left, rank, at = left[rest], rank[rest], (at[rest] + 1) & (len(self.keys) - 1)
        self.cache: dict[str, str] = {}

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, NONE where they don't merge or a side is missing (under 0)."""
        key = np.where((left < 0) | (right < 0), -2, left << 20 | right)
        at = self._slot(key)
        out, found = np.full(len(key), NONE, dtype=np.int64), self.keys[at]
        hit = found == key
        out[hit] = self.values[at[hit]]
        open_ = np.flatnonzero(~hit & (found != -1) & (key != -2))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def encode_short(self, pieces: list[bytes], width: int) -> list[str]:
        """Ids, as text, of pieces of 2 to ``width`` bytes (a power of two), a tree in each row.
        All arrays are flat; a row of the token arrays has a missing token at either end."""
        n, shift = len(pieces), width.bit_length()
        raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), dtype=np.uint8).reshape(n, width)
        size = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
        place, row, tall = np.arange(width), width + 2, 2 * width
        live = np.full((n, row), -1, dtype=np.int64)
        live[:, 1:-1] = np.where(place < size[:, None], self.byte[raw], -1)
        tree = np.empty((n, tall), dtype=np.int32)
        tree[:, width:] = self.pair_ranks(live[:, 1:-1].ravel(), live[:, 2:].ravel()).reshape(n, width) << shift | place
        at = width
        while at > 1:
            np.minimum(tree[:, at : 2 * at : 2], tree[:, at + 1 : 2 * at : 2], out=tree[:, at // 2 : at])
            at //= 2
        right_of = np.tile(np.arange(1, row + 1), (n, 1)).ravel()
        left_of = np.tile(np.arange(-1, row - 1), (n, 1)).ravel()
        live, tree = live.ravel(), tree.ravel()
        rows, mask, none = np.arange(n), (1 << shift) - 1, NONE << shift
        while True:
            top = tree[rows * tall + 1].astype(np.int64)
            going = top < none
            rows, top = rows[going], top[going]
            if not len(rows):
                break
            base, here = rows * row, (top & mask) + 1
            gone = right_of[base + here]
            following, before = right_of[base + gone], left_of[base + here]
            rank = top >> shift
            live[base + here], live[base + gone] = rank, -1
            right_of[base + here] = following
            left_of[base + following] = here
            both = self.pair_ranks(np.concatenate([rank, live[base + before]]), np.concatenate([live[base + following], rank]))
            leaf = np.concatenate([gone, here, before]) - 1
            value = np.concatenate([np.full(len(rows), none, dtype=np.int64), both << shift]) | np.maximum(leaf, 0)
            root = np.concatenate([rows, rows, rows]) * tall
            if (before < 1).any():
                some = leaf >= 0
                leaf, value, root = leaf[some], value[some], root[some]
            at = leaf + width
            tree[root + at] = value
            wide = width
            while wide > 1:
                at >>= 1
                below = root + 2 * at
                tree[root + at] = np.minimum(tree[below], tree[below + 1])
                wide >>= 1
        kept = live >= 0
        counts = kept.reshape(n, row).sum(axis=1)
        flat = list(map(self.decimal.__getitem__, live[kept].tolist()))
        ends = np.cumsum(counts)
        return [",".join(flat[lo:hi]) for lo, hi in zip((ends - counts).tolist(), ends.tolist(), strict=True)]

    def encode_long(self, piece: bytes) -> list[int]:
        """Ids of one piece of any length.  A leaf of the tree is rank and position in one number; a
        change goes up only as far as it changes the least."""
        n = len(piece)
        ids = self.byte[np.frombuffer(piece, dtype=np.uint8)]
        width = 1 << max(1, (n - 1).bit_length())
        whole = np.full(2 * width, NONE << 40, dtype=np.int64)
        whole[width : width + n - 1] = self.pair_ranks(ids[:-1], ids[1:]) << 40 | np.arange(n - 1)
        at = width
        while at > 1:
            np.minimum(whole[at : 2 * at : 2], whole[at + 1 : 2 * at : 2], out=whole[at // 2 : at])
            at //= 2
        token, tree = array("i", ids.astype(np.int32).tobytes()), array("q", whole.tobytes())
        right, left = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        get, none, place = self.pairs.get, NONE << 40, (1 << 40) - 1

        def put(i: int, rank: int | None) -> None:
            at, value = width + i, none if rank is None else rank << 40 | i
            tree[at] = value
            while at > 1:
                beside = tree[at ^ 1]
                if beside < value:
                    value = beside
                at >>= 1
                if tree[at] == value:
                    return
                tree[at] = value

        while (top := tree[1]) < none:
            rank, i = top >> 40, top & place
            gone = right[i]
            following, before = right[gone], left[i]
            token[i], token[gone], right[i] = rank, -1, following
            put(gone, None)
            if following < n:
                left[following] = i
                put(i, get(rank << 20 | token[following]))
            else:
                put(i, None)
            if before >= 0:
                put(before, get(token[before] << 20 | rank))
        return [t for t in token if t >= 0]

    def encode_pieces(self, pieces: list[str]) -> list[str]:
        """Ids of each piece, as text; a piece that is a word of the vocabulary is that word."""
        raws = [p.encode("utf-8", "surrogatepass") for p in pieces]
        out: list = [None if rank is None else self.decimal[rank] for rank in map(self.ranks.get, raws)]
        by_width: dict[int, list[int]] = {}
        for k, raw in enumerate(raws):
            if out[k] is None:
                by_width.setdefault((len(raw) - 1).bit_length(), []).append(k)
        for bits, some in by_width.items():
            if 1 << bits > SHORT:
                for k in some:
                    out[k] = ",".join(map(self.decimal.__getitem__, self.encode_long(raws[k])))
                continue
            for lo in range(0, len(some), TOGETHER):
                part = some[lo : lo + TOGETHER]
                for k, ids in zip(part, self.encode_short([raws[k] for k in part], 1 << bits), strict=True):
                    out[k] = ids
        return out

    def split(self, text: str) -> list[str]:
        return (self.plain if _PLAIN.fullmatch(text) else self.pattern).findall(text)

    def encode_texts(self, texts: list[str]) -> list[str]:
        """Each text's ids in decimal, joined by commas."""
        cache, split = self.cache, [self.split(t) for t in texts]
        new = {p for p in set().union(*split) if p not in cache}
        if len(cache) + len(new) > CACHE:
            cache.clear()
            new = set().union(*split)
        fresh = list(new)
        cache.update(zip(fresh, self.encode_pieces(fresh), strict=True))
        get = cache.__getitem__
        out = [",".join(map(get, pieces)) for pieces in split]
        for piece in fresh:
            if len(piece) > SHORT:
                del cache[piece]
        return out

    def decode(self, ids: str) -> bytes:
        """The bytes of ids in decimal, joined by commas."""
        return b"".join(map(self.texts.__getitem__, ids.split(","))) if ids else b""


_built: dict[tuple[int, str], Bpe] = {}


def _worker(data: bytes, pattern: str) -> Bpe:
    """A worker's encoder, built once for each vocabulary."""
    key = (hash(data), pattern)
    if key not in _built:
        _built.clear()
        _built[key] = Bpe(read_ranks(data), pattern)
    return _built[key]


def _texts_at_once(c: dict, chars: int = 1 << 21) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for i, t in zip(c["doc_id"], c["text"], strict=True):
        ids.append(i)
        texts.append(t or "")
        size += len(texts[-1])
        if size >= chars:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) of every text, by the rank file ``vocabulary``, a path on the
    driver; a vocabulary file is a few MB and goes to the workers by broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(open(vocabulary, "rb").read())

    def run(columns: Iterator[dict]) -> Iterator[dict]:
        own = _worker(shared.value, pattern)
        for c in columns:
            for ids, texts in _texts_at_once(c):
                yield {"doc_id": ids, "ids": [list(map(int, x.split(","))) if x else [] for x in own.encode_texts(texts)]}

    return map_columns(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, raw binary) of every row of ids; null ids are none."""
    shared = encoded.sparkSession.sparkContext.broadcast(open(vocabulary, "rb").read())

    def run(columns: Iterator[dict]) -> Iterator[dict]:
        own = _worker(shared.value, pattern)
        for c in columns:
            yield {"doc_id": c["doc_id"], "raw": [b"".join(own.words[i] for i in ids or []) for ids in c["ids"]]}

    return map_columns(encoded.select("doc_id", "ids"), run, "doc_id long, raw binary")


def round_trip(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Encodes every text, decodes its ids, and returns digests of both in one pass:
    doc_id, n_tokens, ids_sha256, decoded_sha256."""
    shared = docs.sparkSession.sparkContext.broadcast(open(vocabulary, "rb").read())

    def run(columns: Iterator[dict]) -> Iterator[dict]:
        own = _worker(shared.value, pattern)
        for c in columns:
            for ids, texts in _texts_at_once(c):
                joined = own.encode_texts(texts)
                yield {
                    "doc_id": ids,
                    "n_tokens": [x.count(",") + 1 if x else 0 for x in joined],
                    "ids_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in joined],
                    "decoded_sha256": [hashlib.sha256(own.decode(x)).hexdigest() for x in joined],
                }

    return map_columns(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
