"""Language identification: script ranges, per-word scores and Viterbi spans.

A model holds, for each language, log-probabilities of character n-grams (2 and 3, with
word edges) and of frequent words, and the scripts its training words use.  A word's script
narrows its candidates; the word's scores are its n-grams' log-probabilities, centred over
the candidates.  Viterbi over the words, with a penalty for every switch, labels spans.

A text is first tried as a single span: if no run of words gains more than one penalty over
the best single language, that span is Viterbi's answer, and only other texts run through
it word by word.

A language that does not use a word's script is no candidate for it: it loses ``EXCLUDED`` nats
there, more than two switches and all a word can give, so no best path labels the word with it.

A word is recognised if a learned language uses its script and the model scores the word
itself or at least half of its n-grams.  The score of a text is the share of its letters that are in
recognised words of the spans of its language, times the chance of that language by the sums of
the words' scores, which are damped by ``DAMP`` as words are not independent; words without evidence follow their
neighbours' span and lower the score.

Defined results: null texts and texts without a letter are ``und`` with score 0 and no
spans; texts without a recognised word get the most frequent language, with score 0.
Ties go to the language that comes first in the alphabet.  With no labelled rows the model
has no languages and everything is ``und``.  Repeated rows get equal results; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, chain, pairwise

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, map_columns

#: Bounds of the training sample: documents a language, and n-grams and words kept.
SAMPLE, NGRAMS, FREQUENT = 400, 40_000, 5_000
#: Nats lost by a switch of language, most nats a word may give, and weight of n-grams.
SWITCH, MOST, WEIGHT = 12.0, 6.0, 0.5
#: Nats lost by a language that does not use a word's script, and the divisor of summed scores in chances.
EXCLUDED, DAMP = 100.0, 4.0
#: Bytes of text that training collects at most on average, and of a training text.
SAMPLE_BYTES, LONGEST = 64 << 20, 1 << 20
#: Least share of letters in the text's language for which the pipeline keeps a text.
LEAST = 0.5
#: Words whose scores a worker keeps.
CACHE = 400_000
#: First code points of ranges and the scripts that begin there (fixed values, Unicode).
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"), (0x0E00, "thai"),
    (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1400, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"),
    (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
    (0x20000, "han"),
]
_FIRST = [a for a, _ in SCRIPTS]
_LETTERS = re.compile(r"[^\W\d_]+")


def _marks() -> str:
    """A character class of all combining marks, from the Unicode tables."""
    own = [i for i in range(0x300, 0x20000) if unicodedata.category(chr(i)) in ("Mn", "Mc")]
    cut = [0, *(k for k in range(1, len(own)) if own[k] != own[k - 1] + 1), len(own)]
    return "[" + "".join(f"{chr(own[a])}-{chr(own[b - 1])}" for a, b in pairwise(cut)) + "]"


_MARK = re.compile(_marks())
_MARKED = re.compile(rf"[^\W\d_](?:[^\W\d_]|{_MARK.pattern})*")


def _pattern(text: str) -> re.Pattern:
    """The pattern of words: runs of letters, and of the combining marks after a letter."""
    try:
        text.encode("latin-1")  # has no marks, and is soon told
    except UnicodeEncodeError:
        return _MARKED if _MARK.search(text) else _LETTERS
    return _LETTERS


def words_at(text: str) -> Iterator[re.Match]:
    return _pattern(text).finditer(text)


def words_of(text: str) -> list[str]:
    text = text.lower()
    return _pattern(text).findall(text)


def _script_at(c: str) -> str:
    return SCRIPTS[bisect_right(_FIRST, ord(c)) - 1][1]


def script(word: str) -> str:
    """The script of most of a word's letters, of the first among equals."""
    if word.isascii():
        return "latin"
    seen = Counter(_script_at(c) for c in word if c.isalpha())
    return max(seen, key=seen.__getitem__) if seen else _script_at(word[-1])


def any_letter(words: list[str]) -> bool:
    """Whether the words hold a letter; numerals such as \u00b2 and \u2167 make words but are none."""
    return any(c.isalpha() for w in words for c in w)


def grams(word: str) -> list[str]:
    edged = f"<{word}>"
    return [edged[i : i + 2] for i in range(len(edged) - 1)] + [edged[i : i + 3] for i in range(len(edged) - 2)]


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, label: str = "lang", sample: int = SAMPLE) -> dict:
    """A model from at most about ``sample`` documents and SAMPLE_BYTES of text, chosen by a hash of their
    ids; texts longer than LONGEST are not in the sample.  Whole texts of the sample are counted;
    ``docs`` holds training rows only."""
    some = docs.filter(F.col(label).isNotNull())
    long_ = F.octet_length(F.coalesce("text", F.lit(""))) > LONGEST
    size = F.sum(F.when(long_, 0).otherwise(F.octet_length(F.coalesce("text", F.lit(""))))).alias("b")
    seen = some.groupBy(label).agg(F.count(F.lit(1)).alias("n"), size).collect()  # a row a language
    counts, sizes = {r[0]: r.n for r in seen}, {r[0]: r.b for r in seen}
    if not counts:
        return {"langs": [], "grams": {}, "words": {}, "scripts": {}, "first": None}
    chosen, some = F.lit(False), some.filter(~long_)
    for lang, n in counts.items():
        share = min(1.0, sample / n, SAMPLE_BYTES / len(counts) / max(sizes[lang], 1))
        chosen = chosen | ((F.col(label) == lang) & (F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1))
    langs = sorted(counts)
    words: dict[str, Counter] = {x: Counter() for x in langs}
    for lang, text in some.filter(chosen).select(label, "text").limit(2 * sample * len(langs)).collect():
        words[lang].update(words_of(text or ""))
    n_grams: dict[str, Counter] = {x: Counter() for x in langs}
    scripts: dict[str, set[str]] = {}
    for lang, own in words.items():
        seen: Counter = Counter()
        for w, n in own.items():
            seen[script(w)] += n
            for g in grams(w):
                n_grams[lang][g] += n
        for s, n in seen.items():
            if n * 1000 >= sum(seen.values()):
                scripts.setdefault(s, set()).add(lang)

    def logs(counted: dict[str, Counter], most: int) -> dict[str, list[float]]:
        total: Counter = Counter()
        for c in counted.values():
            total.update(c)
        keep = [g for g, n in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:most] if n > 1]
        sums = [sum(counted[x].values()) + 0.5 * len(total) for x in langs]
        return {g: [float(np.log((counted[x][g] + 0.5) / s)) for x, s in zip(langs, sums, strict=True)] for g in keep}

    first = max(langs, key=lambda x: (counts[x], [-ord(c) for c in x]))
    return {"langs": langs, "grams": logs(n_grams, NGRAMS), "words": logs(words, FREQUENT), "scripts": {s: sorted(x) for s, x in scripts.items()}, "first": first}


class Scorer:
    """Per-word scores by a model, kept for words that come again."""

    def __init__(self, model: dict):
        self.langs = model["langs"]
        k = len(self.langs)
        table = [*model["grams"].values(), *model["words"].values()]
        self.table = np.array(table, dtype=np.float32).reshape(-1, k)
        self.table -= self.table.mean(axis=1, keepdims=True)
        self.grams = {g: i for i, g in enumerate(model["grams"])}
        self.words = {w: i + len(self.grams) for i, w in enumerate(model["words"])}
        self.masks = {s: np.array([x in own for x in self.langs]) for s, own in model["scripts"].items()}
        self.first = self.langs.index(model["first"])
        self.cache: dict[str, int] = {}
        self.scores = np.zeros((CACHE, k), dtype=np.float32)
        #: Letters of the kept words, and of those that are recognised.
        self.letters = np.zeros((CACHE, 2), dtype=np.int64)

    def add(self, words: list[str]) -> None:
        rows, lengths, seen, get = [], [], [], self.grams.get
        for w in words:
            of = grams(w)
            own = [i for i in map(get, of) if i is not None]
            i = self.words.get(w)
            seen.append(i is not None or 2 * len(own) >= len(of))
            if i is not None:
                own += [i, i]
            rows += own
            lengths.append(len(own))
        sums = np.zeros((len(rows) + 1, self.table.shape[1]), dtype=np.float64)
        np.cumsum(self.table[rows], axis=0, out=sums[1:])
        ends = np.array(list(accumulate(lengths)), dtype=np.int64)
        scores = WEIGHT * (sums[ends] - sums[ends - np.array(lengths, dtype=np.int64)])
        scripts = [script(w) for w in words]
        for s in set(scripts):
            mask = self.masks.get(s)
            at = [i for i, x in enumerate(scripts) if x == s]
            if mask is None:
                scores[at] = 0
            elif not mask.all():
                scores[np.ix_(at, np.flatnonzero(~mask))] = -np.inf
        scores -= scores.max(axis=1, keepdims=True)
        scores = np.where(np.isneginf(scores), -EXCLUDED, np.maximum(scores, -MOST))
        base = len(self.cache)
        letters = np.array([sum(map(str.isalpha, w)) for w in words], dtype=np.int64)
        own = letters * np.array([x and s in self.masks for x, s in zip(seen, scripts, strict=True)])
        self.letters[base : base + len(words)] = np.stack([letters, own], axis=1)
        self.scores[base : base + len(words)] = scores
        self.cache.update(zip(words, range(base, base + len(words)), strict=True))

    def rows(self, texts: list[list[str]]) -> np.ndarray:
        new = {w for w in set().union(*texts) if w not in self.cache}
        if len(self.cache) + len(new) > len(self.scores):
            self.cache.clear()
            new = set().union(*texts)
            if len(new) > len(self.scores):
                self.scores = np.zeros((2 * len(new), len(self.langs)), dtype=np.float32)
                self.letters = np.zeros((2 * len(new), 2), dtype=np.int64)
        if new:
            self.add(sorted(new))
        return np.fromiter(map(self.cache.__getitem__, chain.from_iterable(texts)), dtype=np.int64, count=sum(map(len, texts)))

    def label(self, texts: list[list[str]]) -> list[list[tuple[int, int, int]]]:
        """For each text with words: spans (language, first word, end)."""
        return self.spans(texts, self.rows(texts))

    def recognise(self, texts: list[list[str]]) -> list[tuple[list[tuple[int, int, int]], int, float]]:
        """For each text with a letter: its spans, its language, and its score: the share of its letters that are
        in recognised words of that language's spans, times the language's chance."""
        rows = self.rows(texts)
        sums = np.zeros((len(rows) + 1, 2), dtype=np.int64)
        np.cumsum(self.letters[rows], axis=0, out=sums[1:])
        starts = np.cumsum([0, *(len(t) for t in texts[:-1])])
        weighed = np.where(self.letters[rows, 1:] > 0, self.scores[rows], 0).astype(np.float64)
        total = np.add.reduceat(weighed, starts, axis=0) / DAMP if len(rows) else np.zeros((0, len(self.langs)))
        chances = np.exp(total - total.max(axis=1, keepdims=True))
        chances /= chances.sum(axis=1, keepdims=True)
        out, at = [], 0
        for k, (text, found) in enumerate(zip(texts, self.spans(texts, rows), strict=True)):
            own = [0] * len(self.langs)
            for lang, lo, hi in found:
                own[lang] += int(sums[at + hi, 1] - sums[at + lo, 1])
            most = max(own)
            lang, letters = own.index(most) if most else self.first, int(sums[at + len(text), 0] - sums[at, 0])
            mixed = len({x for x, _, _ in found}) > 1  # spans of several languages each have their own words
            out.append((found, lang, most / letters * (1.0 if mixed else float(chances[k, lang]))))
            at += len(text)
        return out

    def spans(self, texts: list[list[str]], rows: np.ndarray) -> list[list[tuple[int, int, int]]]:
        scores = self.scores[rows].astype(np.float64)
        sizes = np.array([len(t) for t in texts])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        best = np.add.reduceat(scores, starts, axis=0).argmax(axis=1)
        per_word = np.repeat(best, sizes)
        rest = scores.copy()
        own = rest[np.arange(len(rest)), per_word]
        rest[np.arange(len(rest)), per_word] = -np.inf
        gain = rest.max(axis=1) - own if scores.shape[1] > 1 else np.full(len(own), -1.0)
        # Sums from each text's start, lowered from text to text so that the running least starts anew.
        drop = np.repeat(np.arange(len(texts)) * 2.0 * EXCLUDED * (sizes.max() + 1), sizes)
        total = np.cumsum(gain)
        before = total - gain
        origin = np.repeat(before[starts], sizes)
        least = np.minimum.accumulate(before - origin - drop)
        most = np.maximum.reduceat(total - origin - drop - least, starts)
        out = []
        for k, (b, m, lo, n) in enumerate(zip(best.tolist(), most.tolist(), starts.tolist(), sizes.tolist(), strict=True)):
            out.append([(b, 0, len(texts[k]))] if m <= SWITCH else viterbi(scores[lo : lo + n]))
        return out


def viterbi(scores: np.ndarray) -> list[tuple[int, int, int]]:
    """Spans (language, first word, end) of the best path; SWITCH is paid at each change."""
    now, backs = scores[0].tolist(), []
    for row in scores[1:].tolist():
        top = max(now)
        at = now.index(top)
        come = top - SWITCH
        back, new = [], []
        for j, (v, s) in enumerate(zip(now, row, strict=True)):
            if v >= come:
                back.append(j)
                new.append(v + s)
            else:
                back.append(at)
                new.append(come + s)
        backs.append(back)
        now = new
    state, path = now.index(max(now)), []
    for back in reversed(backs):
        path.append(state)
        state = back[state]
    path.append(state)
    path.reverse()
    spans, lo = [], 0
    for i in range(1, len(path) + 1):
        if i == len(path) or path[i] != path[lo]:
            spans.append((path[lo], lo, i))
            lo = i
    return spans


def _at_once(ids: list, texts: list, chars: int = 1 << 20) -> Iterator[tuple[list, list[str]]]:
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars or i == len(texts) - 1:
            yield ids[lo : i + 1], [x or "" for x in texts[lo : i + 1]]
            lo, size = i + 1, 0


def identify(docs: DataFrame, model: dict, spans: bool = True) -> DataFrame:
    """(doc_id, lang_pred, score) of every text, and with ``spans`` its spans: (lang, first
    and end character)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, lang_pred string, score double"
    if spans:
        schema += ", spans array<struct<lang: string, start: int, stop: int>>"

    def run(columns: Iterator[dict]) -> Iterator[dict]:
        own = Scorer(shared.value) if shared.value["langs"] else None
        for c in columns:
            for ids, texts in _at_once(c["doc_id"], c["text"]):
                split = [words_of(t) for t in texts]
                some = [k for k, w in enumerate(split) if any_letter(w)] if own else []
                pred, score, out = ["und"] * len(ids), [0.0] * len(ids), [[] for _ in ids]
                for k, (found, top, share) in zip(some, own.recognise([split[k] for k in some]) if some else [], strict=True):
                    pred[k], score[k] = own.langs[top], share
                    if spans:
                        at = [m.span() for m in words_at(texts[k])]
                        if len(at) == len(split[k]):  # else lower-casing changed the words' number: one span
                            out[k] = [(own.langs[lang], at[lo][0], at[hi - 1][1]) for lang, lo, hi in found]
                        else:
                            out[k] = [(own.langs[top], 0, len(texts[k]))]
                yield {"doc_id": ids, "lang_pred": pred, "score": score} | ({"spans": out} if spans else {})

    return map_columns(docs.select("doc_id", "text"), run, schema)


def train(docs: DataFrame) -> dict:
    """The model of the training fold: rows that aren't held out, with a known language."""
    return fit(docs.filter(~held_out()))


def predict_language(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, by a model of the training fold."""
    found = identify(docs.select("doc_id", "text"), train(docs), spans=False)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` whose language was recognised with a score of at least ``least``:
    evenly mixed texts, texts in other scripts and texts without evidence go.  The decision is made
    beside the row's text, so that no join is needed."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))

    def decide(texts: list) -> list[bool]:
        own = decide.__dict__.get("own")
        if own is None:
            own = decide.__dict__["own"] = Scorer(shared.value) if shared.value["langs"] else False
        out = [False] * len(texts)
        if own:
            split = [words_of(t or "") for t in texts]
            some = [k for k, w in enumerate(split) if any_letter(w)]
            for k, (_, _, share) in zip(some, own.recognise([split[k] for k in some]) if some else [], strict=True):
                out[k] = share >= least
        return out

    return keep_rows(docs, decide)
