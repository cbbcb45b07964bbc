"""Operators for training text against plain Python, with nulls, empty and odd rows."""

import hashlib
import random
import re
import zlib

import public_tokenizers
import pytest
from conftest import SF, rows_of
from pyspark.sql import functions as F

from codeatlas.llm import bpe, chat, common, fingerprint, language, licences, near_dedup, queries, reputation, sharding, tiling, toxicity
from codeatlas.llm.hashing import shingle_sets

WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(random.Random(9).choices(WORDS, k=3000))
DOC = "doc_id long, text string, lang string, source string, bucket int, key string, d long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns with clashing names."""
    base = " ".join(random.Random(4).choices(WORDS, k=60))
    near = base.replace(base.split()[30], "changed", 1)
    texts = [None, "", " \n\t", "one", "a b c d e", "A b C d e", base, base, near, LONG, LONG, "日本語 ééé \U0001f642 ſ", "x" * 5000, "the cat <|im_start|>", base.upper()]
    rows = [(i, t, "en", "s", 1, "k", 2) for i, t in enumerate(texts)] + [(3, "one", "en", "s", 1, "k", 2), (None, base, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOC).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def word_sets(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(lower))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def groups(rows):
    sets = {i: word_sets(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates(spark, odd, none):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    want = groups([(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None])
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert near_dedup.near_duplicates(none).count() == 0
    kept = near_dedup.near_dedup(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept}


def test_near_duplicates_of_a_large_family(spark, monkeypatch):
    """More copies than a bucket's pairs are rows for: blocks of few shingles."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "BLOCKS", 3)
    monkeypatch.setattr(near_dedup, "BLOCK_MOST", 24)
    monkeypatch.setattr(near_dedup, "SHINGLES", 2000)
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(near_dedup, "SMALL", 8)
    rng = random.Random(1)
    base = rng.choices(WORDS, k=90)
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(rng.randrange(8)):
            own[rng.randrange(90)] = rng.choice(WORDS)
        rows.append((i, " ".join(own)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == groups(rows)


def test_near_duplicates_pairs_checked_without_python(spark):
    rng = random.Random(7)
    sets = [sorted(rng.sample(range(-60, 60), k)) for k in (1, 3, 40, 90, 90, 110, 112, 115)] + [list(range(-60, 60)), list(range(-60, 30))]
    words = [near_dedup.U(0x9E3779B97F4A7C15) * near_dedup.np.array(s, dtype=near_dedup.np.int64).view(near_dedup.U) for s in sets]
    sigs = near_dedup.signatures(words, 128)
    rows = [(a, b, sigs[a].tobytes(), sigs[b].tobytes(), sets[a], sets[b]) for a in range(10) for b in range(a + 1, 10)]
    pairs = spark.createDataFrame(rows, "a long, b long, sig_a binary, sig_b binary, set_a array<long>, set_b array<long>")
    least = near_dedup.least_matches(128, 16, 0.75, 1e-7)
    stay = {(a, b) for a, b, *_ in rows if all((sigs[a, : 16 * k + 16] == sigs[b, : 16 * k + 16]).sum() >= m for k, m in enumerate(least))}
    reach = {(a, b) for a, b, *_ in rows if 100 * len(set(sets[a]) & set(sets[b])) >= 75 * len(set(sets[a]) | set(sets[b]))}
    likely, exact = near_dedup._posterior(pairs.drop("set_a", "set_b"), 128, 0.75, 16, 1e-7), near_dedup._exact(pairs.drop("sig_a", "sig_b"), 0.75)
    assert {(r.a, r.b) for r in likely.collect()} == stay and {(r.a, r.b) for r in exact.collect()} == reach
    assert (8, 9) in reach and 0 < len(reach) <= len(stay) < len(rows)
    assert not [d for d in (likely, exact) if "Arrow" in d._jdf.queryExecution().toString()]


def test_near_duplicates_over_many_partitions(spark):
    """Few tasks where partitions are small and many: every stage has one a partition."""
    rng, base = random.Random(3), random.Random(2).choices(WORDS, k=80)
    texts = [" ".join(base[:k] + [f"v{i % 40}"] + base[k + 1 :]) for i, k in enumerate(rng.choices(range(80), k=120))] + [" ".join(rng.choices(WORDS, k=50)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    settings = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    spark.sparkContext.setJobGroup("near-duplicates", "tasks counted")
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = near_dedup.near_duplicates(docs).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        for k in ("spark.jobGroup.id", "spark.job.description"):
            spark.sparkContext.setLocalProperty(k, None)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == groups(enumerate(texts))
    status = spark.sparkContext.statusTracker()
    stages = {i for j in status.getJobIdsForGroup("near-duplicates") for i in status.getJobInfo(j).stageIds}
    assert sum(s.numCompletedTasks for s in map(status.getStageInfo, stages) if s) <= 1750


def test_posterior_keeps_the_threshold():
    least = near_dedup.least_matches(128, 16, 0.75, 1e-7)
    assert least == sorted(least) and least[-1] < 0.75 * 128
    one, two = shingle_sets([LONG.encode(), LONG.encode() + b" more words at the end of it"], 5)
    sig = near_dedup.signatures([one, two], 128)
    assert (sig[0] == sig[1]).mean() > 0.9


def test_components(spark, monkeypatch):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102)]
    want = {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    for least in (1000, 1):
        monkeypatch.setattr(common, "HOT_ROWS", least)
        assert {r.v: r.c for r in common.components(spark.createDataFrame(links, "a long, b long")).df.collect()} == want


def test_stored_tables_are_dropped(spark, odd):
    """Of all tables only those of results stay."""
    import os

    folder = os.path.join(common.shared_dir(spark).removeprefix("file://"), "codeatlas")
    seen = lambda: set(os.listdir(folder)) if os.path.isdir(folder) else set()
    before = seen()
    result = near_dedup.near_duplicates(odd)
    assert len(seen() - before) == 1 and result.count() == odd.count()
    before = seen()
    sharding.shards(odd).count(), chat.conversations(odd.select(F.col("d").alias("conv_id"), F.col("doc_id").alias("turn"), "lang", "text").withColumn("role", F.lit("user"))).count()
    assert len(seen() - before) == 2


def test_batches_are_bounded_by_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"t": ["x" * 1000] * 64 + ["y" * 100_000] + ["z"] * 5})
    cut = list(common.parts(batch, 20_000))
    assert pa.Table.from_batches(cut).equals(pa.Table.from_batches([batch])) and all(b.nbytes <= 20_000 or b.num_rows == 1 for b in cut)


def test_bpe(spark, odd, none):
    import tiktoken

    ranks = bpe.read_ranks(open(queries.VOCABULARY, "rb").read())
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.Bpe(ranks, public_tokenizers.PATTERN)
    rng = random.Random(2)
    pools = [range(32, 127), range(0xA0, 0x250), range(0x400, 0x3000), [10, 32, 32, 9, 0x1C, 0x1F642]]
    texts = ["", "aaaa" * 300, "it's 'VE ²³ ªº ٣ 日本 <|endoftext|>", " \n\n x "] + ["".join(chr(rng.choice(rng.choice(pools))) for _ in range(rng.randrange(120))) for _ in range(200)]
    for t, x in zip(texts, own.encode_texts(texts), strict=True):
        assert x == ",".join(map(str, known.encode_ordinary(t))) and own.decode(x) == t.encode()
    for r in bpe.round_trip(odd, queries.VOCABULARY, public_tokenizers.PATTERN).join(odd, "doc_id").collect():
        ids = known.encode_ordinary(r.text or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    long_piece = "".join(rng.choices("abcdefgh", k=30_000))
    assert own.encode_texts([long_piece, long_piece])[0] == ",".join(map(str, known.encode_ordinary(long_piece))) and long_piece not in own.cache
    encoded = bpe.encode(odd.filter("doc_id = 11"), queries.VOCABULARY, public_tokenizers.PATTERN)
    assert bytes(bpe.decode(encoded, queries.VOCABULARY, public_tokenizers.PATTERN).first().raw).decode() == odd.filter("doc_id = 11").first().text
    assert bpe.round_trip(none, queries.VOCABULARY, public_tokenizers.PATTERN).count() == 0


def test_fingerprints(spark, odd, none):
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in odd.collect()), key=lambda r: r)
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.edited_sha256, r.n_chars) for r in fingerprint.fingerprint_neighbours(odd).collect()))
    want = []
    for k, (some, i, text) in enumerate(rows):
        after, n = rows[(k + 1) % len(rows)][2], len(text) // 4
        want.append((some, i, hashlib.sha256((text[: len(text) - n] + after[:n]).encode()).hexdigest(), len(text)))
    assert got == sorted(want)
    assert fingerprint.fingerprint_neighbours(none).count() == 0
    a, b, c = fingerprint.fingerprints([LONG, "Some words before. " + LONG, " ".join(random.Random(8).choices(WORDS, k=3000))])
    assert fingerprint.likeness([a], [b])[0] > 0.9 > 0.2 > fingerprint.likeness([a], [c])[0]
    assert fingerprint.likeness(["", ""], ["", a]) == [1.0, 0.0]
    assert fingerprint.fingerprints([LONG, None, LONG]) == [a, "", a]


def test_shards(spark, odd, none):
    got = sharding.shards(odd).collect()
    assert len(got) == odd.count()
    by_id = {r.doc_id: r.text for r in odd.collect()}
    for r in got:
        raw = (by_id[r.doc_id] or "").encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
    many = spark.range(5000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"))
    rows = sharding.shards(many).collect()
    sizes, slots = {}, {}
    for r in rows:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * 98 and len(sizes) == 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    order = sorted(rows, key=lambda r: r.doc_id)
    assert [r.shard for r in order] == sorted(r.shard for r in rows)
    assert sharding.shards(none).count() == 0


def test_write_shards(spark, none, tmp_path):
    """Rows of one id and without an id are each written once."""
    rows = [(3, "a"), (3, "b"), (3, "b"), (None, "x"), (None, None), (1, ""), (2, "long " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit("clash")).withColumn("bucket", F.lit(1))
    sharding.write_shards(docs, str(tmp_path / "s"), 3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(map(str, rows)) == sorted(str((r.doc_id, r.text)) for r in back.collect()) and set(back.columns) == {*docs.columns, "shard"}
    many = spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"))
    sharding.write_shards(many, str(tmp_path / "m"))
    written = {r.doc_id: r.shard for r in spark.read.parquet(str(tmp_path / "m")).select("doc_id", "shard").collect()}
    assert written == {r.doc_id: r.shard for r in sharding.shards(many).collect()}
    sharding.write_shards(none, str(tmp_path / "n"))
    with pytest.raises(ValueError):
        sharding.write_shards(docs.withColumn("shard", F.lit(1)), str(tmp_path / "e"))


def test_any_number_of_partitions(spark):
    """Plans and results at 4,000 shuffle partitions are those at 4."""
    docs = spark.range(700).select((F.col("id") * 7 - 1000).alias("doc_id"), F.concat_ws(" ", F.col("id") % 13, F.col("id"), F.lit("some more words here")).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(None, "null id"), (-1000, "second of an id")], "doc_id long, text string")).cache()
    got = []
    for n in ("4", "4000"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append((sorted(map(str, fingerprint.fingerprint_neighbours(docs).coalesce(8).collect())), sorted(map(str, sharding.shards(docs).collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1]


def test_language(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.predict_language(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) and all(0 <= r.score <= 1 for r in got)
    model = language.train(docs)
    assert {r.doc_id: r.lang_pred for r in language.identify(odd, model).collect()}[0] == "und"
    assert language.identify(none, model).count() == 0
    assert language.predict_language(none).count() == 0
    numerals = spark.createDataFrame([(1, "\u00b2\u00bd \u2167 12"), (2, "\u00b2 das Haus und die Katze")], "doc_id long, text string")
    assert {r.doc_id: (r.lang_pred, r.score) for r in language.identify(numerals, model).collect()}[1] == ("und", 0.0)
    assert {r.doc_id for r in language.identify(numerals, model).filter("lang_pred <> 'und'").collect()} == {2}
    text = docs.filter("lang = 'de'").first().text[:600] + "\n" + docs.filter("lang = 'fr'").first().text[:600]
    spans = language.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first().spans
    assert [s.lang for s in spans] == ["de", "fr"] and abs(spans[0].stop - 600) < 40
    # The test of single spans agrees with Viterbi.
    scorer = language.Scorer(model)
    for row in docs.limit(60).collect() + [None]:
        words = language.words_of(row.text if row else text)
        if words:
            assert scorer.label([words])[0] == language.viterbi(scorer.scores[scorer.rows([words])].astype(float))


def plain_language(model, text):
    """(language, score) by plain dynamic programming over all words."""
    import math

    words, langs = language.words_of(text or ""), model["langs"]
    if not any(c.isalpha() for w in words for c in w):
        return "und", 0.0
    scores, letters = [], []
    for w in words:
        own = [model["grams"][g] for g in language.grams(w) if g in model["grams"]]
        known = w in model["words"] or 2 * len(own) >= len(language.grams(w))
        own += [model["words"][w]] * 2 if w in model["words"] else []
        uses = model["scripts"].get(language.script(w))
        raw = [language.WEIGHT * sum(x[k] - sum(x) / len(x) for x in own) if uses else 0.0 for k in range(len(langs))]
        top = max(v for v, x in zip(raw, langs, strict=True) if not uses or x in uses)
        scores.append([max(v - top, -language.MOST) if not uses or x in uses else -language.EXCLUDED for v, x in zip(raw, langs, strict=True)])
        letters.append((sum(map(str.isalpha, w)), bool(known and uses)))
    best, back = list(scores[0]), []
    for row in scores[1:]:
        come = [max(range(len(langs)), key=lambda j: (best[j] - (j != k) * language.SWITCH, j == k)) for k in range(len(langs))]
        best = [best[j] - (j != k) * language.SWITCH + row[k] for k, j in enumerate(come)]
        back.append(come)
    path = [best.index(max(best))]
    for come in reversed(back):
        path.append(come[path[-1]])
    path.reverse()
    own = [sum(n for (n, ok), p in zip(letters, path, strict=True) if ok and p == k) for k in range(len(langs))]
    if not max(own):
        return model["first"], 0.0
    k = own.index(max(own))
    total = [sum(s[j] for s, (_, ok) in zip(scores, letters, strict=True) if ok) / language.DAMP for j in range(len(langs))]
    chance = 1.0 if len(set(path)) > 1 else 1 / sum(math.exp(t - total[k]) for t in total)
    return langs[k], max(own) / sum(n for n, _ in letters) * chance


def test_language_by_brute_force(spark, odd):
    """The whole query against a plain search over every word."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").unionByName(odd.select((F.col("doc_id") + 10**6).alias("doc_id"), "text", F.lit(None).cast("string").alias("lang")))
    model = language.train(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in language.predict_language(docs).filter("doc_id IS NOT NULL").collect():
        lang, score = plain_language(model, texts[r.doc_id])
        assert r.lang_pred == lang and abs(r.score - score) < 1e-4, r
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_language_scripts_exclude(spark):
    """A language without a word's script never labels it, whatever the words around."""
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("der Hund und die Katze sind im Haus " * 3, "de"), ("это дом и кошка это собака " * 3, "ru"), ("यह एक घर है और हिन्दी भाषा " * 3, "hi")] * 5)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    text = "der Hund und die Katze sind im кошка Haus और die Katze sind im Haus"
    assert len(language.words_of("हिन्दी भाषा")) == 2
    spans = language.Scorer(model).label([language.words_of(text)])[0]
    assert [(model["langs"][k], b - a) for k, a, b in spans] == [("de", 7), ("ru", 1), ("de", 1), ("hi", 1), ("de", 5)]


def test_language_needs_evidence(spark):
    """Texts in other scripts, without evidence or evenly mixed are rejected; clean ones and a text of
    two languages, three to one, are kept."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs)
    own = {x: " ".join(r.text for r in docs.filter(F.col("lang") == x).orderBy("doc_id").limit(20).collect()).split() for x in model["langs"]}
    assert len(own) == 4
    foreign = ["Это проверка текста на русском языке", "Αυτό είναι ένα κείμενο στα ελληνικά", "这是一个测试文本", "qxzj wkvq zxqk jjxq vvkz"]
    mixed = " ".join(w for words in own.values() for w in words[:200])
    clean = [" ".join(words[:200]) for words in own.values()]
    most = " ".join(own["en"][:300] + own["de"][:100])
    drowned = clean[0][:100] + " " + " ".join(foreign[:1] * 20)
    rows = [*foreign, mixed, drowned, *clean, most]
    table = spark.createDataFrame([(i, t, None) for i, t in enumerate(rows)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(table, model).collect()}
    first = max(model["langs"], key=lambda x: docs.filter(F.col("lang") == x).count())
    assert all((got[i].lang_pred, got[i].score) == (first, 0.0) for i in range(3)) and got[3].score < 0.5
    assert 0.2 < got[4].score < 0.4 and got[5].score < 0.5
    assert [got[6 + i].lang_pred for i in range(4)] == list(own) and all(got[6 + i].score > 0.9 for i in range(4))
    assert got[10].lang_pred == "en" and 0.6 < got[10].score < 0.9
    planted = table.select((F.col("doc_id") - 100).alias("doc_id"), "text", "lang")
    kept = language.keep_identified(docs.select("doc_id", "text", "lang").unionByName(planted)).filter("doc_id < 0").collect()
    assert {r.doc_id + 100 for r in kept} == set(range(6, 11))


def brute_tiles(item, text, least):
    item, text, covered = list(item), list(text), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                k = 0
                while i + k < len(item) and j + k < len(text) and item[i + k] == text[j + k] >= 0:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < least:
            return covered
        k, i, j = best
        covered += k
        item[i : i + k], text[j : j + k] = [-1] * k, [-2] * k


def test_tiling(spark, odd, none):
    rng = random.Random(6)
    for _ in range(200):
        whole = rng.sample(range(200), 60)
        cut = rng.randrange(10, 50)
        text = [-1] * 3 + whole[cut:] + [-1] + whole[:cut] + [-1]
        for _ in range(rng.randrange(4)):
            text[rng.randrange(len(text))] = -1
        assert sum(k for _, _, k in tiling.tile(whole, text, 5)) == brute_tiles(whole, text, 5)
    words = LONG.split()
    items = spark.createDataFrame([(1, " ".join(words[100:140])), (2, " ".join(words[200:215] + words[180:200])), (3, None), (4, "one"), (5, "never seen anywhere at all here")], "item_id long, text string")
    plain = sorted(map(tuple, tiling.matches(odd, items).collect()))
    assert plain == sorted(map(tuple, tiling.matches(odd, items, most=0).collect()))
    full = {(d, i) for d, i, c, _, _ in plain if c == 1.0}
    assert {(9, 1), (10, 1), (9, 2), (10, 2), (3, 4)} <= full
    kept = tiling.decontaminate(odd, items)
    assert kept.columns == odd.columns and {r.doc_id for r in odd.collect()} - {r.doc_id for r in kept.collect()} == {3, 9, 10}
    assert tiling.decontaminate(odd, items, most=0).count() == kept.count()
    assert tiling.matches(none, items).count() == 0 and tiling.matches(odd, items.limit(0)).count() == 0


def test_tiling_judges_rows(spark):
    """Both ways judge each row by its own text: rows of one id, of none, copies, and common wording."""
    words = LONG.split()
    common_part = " ".join(words[:30])
    leak, half, clean = " ".join(words[100:140]), " ".join(words[100:125]) + " other", " ".join(words[900:960])
    rows = [(1, leak), (1, clean), (2, clean), (None, leak), (None, clean), (None, None), (3, ""), (4, half), (5, leak), (5, leak), (6, common_part + " " + clean), *((i, common_part) for i in range(10, 30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item", F.lit(1)).withColumn("doc", F.lit("clash"))
    items = spark.createDataFrame([(1, leak), (None, leak), (2, common_part + " " + " ".join(words[200:260])), (3, leak), (4, "")], "item_id long, text string")
    as_rows = lambda x: sorted(str(tuple(r)) for r in x.collect())
    for coverage in (0.0, 0.3, 0.5, 1.0):
        got = as_rows(tiling.matches(docs, items, coverage=coverage))
        assert got == as_rows(tiling.matches(docs, items, most=0, coverage=coverage))
        assert sum("None" in g.split(",")[0] for g in got) == 3
    small, large = tiling.decontaminate(docs, items), tiling.decontaminate(docs, items, most=0)
    assert small.columns == large.columns == docs.columns and as_rows(small) == as_rows(large)
    assert sorted(str((r.doc_id, r.text)) for r in large.collect()) == sorted(str(r) for r in rows if r[1] not in (leak, half))


def test_licences(spark, odd, none):
    texts = ["x\nLicensed under the Apache License, Version 2.0.\nmore", "Released under the MIT License. All rights reserved.", None, "no licence here"]
    grant = " ".join(licences.SENTENCES[k][0] for k in ("mit-grant", "mit-keep", "as-is"))
    rows = spark.createDataFrame(list(enumerate([*texts, grant, "The Software is provided \"AS IS\", without warranty of any kind, express or implied."])), "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan(rows).collect()}
    assert [got[i].licences for i in range(5)] == [["Apache-2.0"], ["MIT", "Proprietary"], [], [], ["MIT"]]
    assert got[5].licences == [] and got[5].unmatched == ["as-is"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    table = licences.known(licences.SENTENCES)
    want = {r.doc_id: [table[s] for s in map(licences.normalise, re.split(r"\n|(?<=[.!?:])\s", r.text)) if s in table] for r in docs.collect()}
    assert {r.doc_id: r.sentence_ids for r in licences.scan(docs).collect()} == want
    assert licences.scan(none).count() == 0 and licences.scan(odd).count() == odd.count()


def test_licences_behind_marks():
    """Whatever stands before its first letter, a known sentence is found as by plain look-up."""
    table = licences.known(licences.SENTENCES)
    first = licences.beginnings(table)
    for mark in ["> ", "% ", "<!-- ", "[", "\u2022 ", "\u201c", "\u00a0", "__", " " * 77, "-" * 200, "x ", "\u0130 ", ""]:
        for sentence in ["Licensed under the MIT License.", "Licensed under the Apache License, Version 2.0.", "All rights reserved.", "Other words."]:
            want = [table[x] for x in [licences.normalise(mark + sentence)] if x in table]
            assert licences.identifiers(mark + sentence, table, first) == want, (mark, sentence)


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD2 = re.sub(r"(?s)3\. Neither.*?permission\.\n\n", "", BSD)
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
GPL2 = """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS."""
WHOLE = [("MIT", MIT), ("BSD-3-Clause", BSD), ("BSD-2-Clause", BSD2), ("Apache-2.0", APACHE), ("GPL-3.0-or-later", GPL), ("GPL-2.0-or-later", GPL2), ("MPL-2.0", MPL), ("ISC", ISC)]
WHOLE += [("AGPL-3.0-or-later", GPL.replace("GNU General", "GNU Affero General")), ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\n    Version 3, 29 June 2007"), ("Unlicense", "This is free and unencumbered software released into the public domain.")]


@pytest.mark.parametrize("lead", ["", "# ", " * ", "// ", "> ", "   "])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_licences_wrapped(lead, end):
    table = licences.known(licences.SENTENCES)
    begins = licences.beginnings(table)
    for name, text in WHOLE:
        for whole in (text, " ".join(text.split())):
            wrapped = end.join(lead + x for x in ["Copyright (c) 2020 A. Person. All rights reserved." if "BSD" in name else "Copyright (c) 2020 A. Person", "", *whole.split("\n"), "", "rest"])
            assert licences.recognise(licences.identifiers(wrapped, table, begins), licences.RULES) == ([name], []), (name, lead)
    # Beside lines without a full stop a notice is a sentence of its own.
    assert licences.identifiers("a title\nReleased under the MIT License\nfree words\nAll rights reserved", table, begins) == ["mit-notice", "all-rights"]


def test_licence_rules():
    """Identifiers of a rule stand next to one another; every licence of the table is found by its tag."""
    got = licences.recognise(["gpl-free", "apache-2-notice", "cc-by-4-notice", "no-warranty"], licences.RULES)
    assert got == (["GPL-3.0-or-later", "Apache-2.0", "CC-BY-4.0"], ["no-warranty"])
    assert licences.recognise(["mit-grant", "apache-2-notice", "mit-keep", "as-is"], licences.RULES) == (["Apache-2.0"], ["mit-grant", "mit-keep", "as-is"])
    assert licences.recognise(["mit-notice", "mit-notice"], licences.RULES) == (["MIT", "MIT"], [])
    table = licences.known(licences.SENTENCES)
    assert all(p.rstrip("?") in licences.SENTENCES for _, need in licences.RULES for p in need)
    names = {n for n, _ in licences.RULES} - {"Proprietary"}
    assert len(names) > 40
    for name in names:
        assert licences.recognise(licences.identifiers(f"# SPDX-License-Identifier: {name}\nx = 1", table, licences.beginnings(table)), licences.RULES) == ([name], [])


def test_toxicity(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels.filter("doc_id % 2 = 0"))
    got = toxicity.severity(docs, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    clean, bad = [r for r in got if not r.toxic], [r for r in got if r.toxic]
    assert sum(r.grade == 0 for r in clean) >= 0.98 * len(clean) and sum(r.grade > 0 for r in bad) >= 0.6 * len(bad)
    assert all(0 <= r.severity <= 3 for r in got) and model["theta"] == sorted(model["theta"])
    assert toxicity.severity(odd, model).count() == odd.count() and toxicity.severity(none, model).count() == 0
    assert toxicity.train(none, labels)["index"] == {} and toxicity.severity(odd, toxicity.train(odd, labels.limit(0))).first().severity == 0
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() < docs.count()
    # Every severity by the plain formula: the sum over thresholds of the chance to be above.
    import math
    from collections import Counter

    texts = [r.text for r in docs.limit(200).collect() + odd.collect()]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.severity(table, model).collect():
        seen = Counter(f for w in re.findall(r"[^\W\d_]+", (texts[r.doc_id] or "").lower()) for f in set(toxicity.features_of(w)) if f in model["index"])
        score = sum(model["weights"][model["index"][f]] * math.log1p(n) for f, n in seen.items())
        above = [1 - 1 / (1 + math.exp(-max(-40, min(40, t - score)))) for t in model["theta"]]
        assert abs(r.severity - sum(above)) < 1e-9 and r.grade == sum(a >= 0.5 for a in above)


def test_graded_labels(spark):
    """Grades above 1 are taken as they are; negative and null ones are none."""
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        grade = i % 4
        rows.append((i, " ".join(rng.choices(WORDS, k=30) + ["awful"] * (3 ** grade - 1))))
        labels.append((i, grade if i < 380 else None if i < 390 else -1))
    docs, given = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, given)
    assert len(model["theta"]) == 3
    got = {r.doc_id: r for r in toxicity.severity(docs, model).collect()}
    assert sum(got[i].grade == i % 4 for i in got) >= 0.95 * len(got)
    assert toxicity.train(docs, given.filter("toxic = 0"))["index"] == {}


def test_ordinal_gradient():
    """Grades by how often one feature occurs are found again."""
    from collections import Counter

    import numpy as np

    counts = [Counter({0: i % 12}) + Counter({1 + i % 3: 1}) for i in range(240)]
    grades = np.array([0 if i % 12 < 3 else 1 if i % 12 < 8 else 2 for i in range(240)])
    w, theta = toxicity.fit_ordinal(counts, grades, 4)
    score = np.array([w[0] * np.log1p(c[0]) + sum(w[k] * np.log1p(c[k]) for k in (1, 2, 3)) for c in counts])
    assert ((score[:, None] > theta).sum(axis=1) == grades).mean() > 0.95


def test_url_filter(spark, duck):
    rows = [(1, "HTTP://Sub.Example.ORG/es/x?y"), (2, "https://example.org/en/12"), (3, None), (4, "no scheme"), (5, "http://a.com/de/"), (6, "http://a.com/fr/#x"), (7, "http://borg/x"), (8, "http://Ä.net?x=/y"), (1, "HTTP://Sub.Example.ORG/es/x?y")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("clash"))
    outcomes = spark.createDataFrame([(7, 0)] * 30 + [(8, 1), (5, None)], "page_id long, good int")
    got = {r.page_id: r for r in reputation.judge(pages, outcomes, reputation.parse_rules(queries.URL_RULES)).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("sub.example.org", "/es/x", "example.org/es/", "block")
    assert (got[2].rule, got[5].rule, got[6].rule) == ("example.org/en/1", "com/de/", "com/fr/")
    assert (got[3].host, got[3].path, got[4].host, got[4].rule) == ("", "", "", None)
    odd_hosts = ["user@Shop.co.uk:8080", "a.b.shop.co.uk.", "192.168.0.1:80", "[::1]:9", "me.github.io", "x.s3.amazonaws.com", "com", ""]
    name = reputation.bare(F.col("host"))
    parts = spark.createDataFrame([(h.lower(),) for h in odd_hosts], "host string").withColumn("s", reputation.suffix_of(name, reputation.SUFFIXES)).withColumn("d", reputation.domain_of(name, F.col("s"))).collect()
    assert [(r.s, r.d) for r in parts] == [("co.uk", "shop.co.uk"), ("co.uk", "shop.co.uk"), ("address", "192.168.0.1"), ("address", "[::1]"), ("github.io", "me.github.io"), ("s3.amazonaws.com", "x.s3.amazonaws.com"), ("com", "com"), ("", "")]
    assert got[7].rule is None and got[7].verdict == "block" and got[8].host == "Ä.net" and got[8].verdict == "allow"
    assert reputation.judge(pages.limit(0), outcomes, []).count() == 0 and reputation.judge(pages, outcomes.limit(0), []).count() == 9
    assert reputation.allowed(pages, outcomes, reputation.parse_rules(queries.URL_RULES)).columns == pages.columns


def test_chat_trees(spark):
    says = "<|im_end|>\n<|im_start|>assistant <\\| <\\\\| |>"
    rows = [(1, 1, None, "user", says, 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", None, 0.9), (1, 4, 3, "us\ner%0A<", "x", 0.5), (2, 1, None, "system", "", 0.0), (3, 1, 2, "user", "loop", 0.0), (3, 2, 1, "user", "loop", 0.0), (4, 5, 99, "assistant", "tail <", 1.0)]
    messages = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    messages = chat.once(messages)
    out = chat.format_paths(messages, chat.paths(messages)).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans")))
    got = {r.tree: r for r in out.collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", says), ("assistant", ""), ("us\ner%0A<", "x")]
    assert got[1].leaf == 4 and got[1].loss == "" and got[4].loss == "tail <" and [t.role for t in got[2].turns] == ["system"]
    assert 3 not in got
    assert chat.paths(messages, best=5).select("tree", "leaf").distinct().count() == 4
    chain = spark.range(1, 101).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    row = chat.conversations(chain).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans"))).first()
    assert row.loss == "".join(map(str, range(1, 101)))
    assert chat.conversations(chain.limit(0)).count() == 0


def test_chat_branches_by_brute_force(spark):
    """Random trees with repeated nodes and clashing columns: paths, ranks and texts of the best branches."""
    rng = random.Random(12)
    rows = []
    for tree in range(12):
        for node in range(1, rng.randrange(2, 40)):
            rows.append((tree, node, rng.randrange(1, node) if node > 1 and rng.random() < 0.95 else None, rng.choice(["user", "assistant"]), f"t{tree}n{node} <|x|>", round(rng.random(), 1)))
            if rng.random() < 0.1:
                rows.append((tree, node, rng.randrange(1, node) if node > 1 else None, "user", f"again {node}", 0.0))
    messages = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double").withColumn("leaf", F.lit("x")).withColumn("depth", F.lit(1))
    own = {}
    for r in rows:
        key = lambda x: (x[2] is not None, x[2] or 0, x[3], x[4], x[5])
        if (r[0], r[1]) not in own or key(r) < key(own[r[0], r[1]]):
            own[r[0], r[1]] = r
    want = {}
    for tree in range(12):
        nodes = {n: r for (t, n), r in own.items() if t == tree}
        branches = []
        for leaf in set(nodes) - {r[2] for r in nodes.values()}:
            path = [leaf]
            while nodes[path[-1]][2] is not None:
                path.append(nodes[path[-1]][2])
            branches.append((-sum(nodes[n][5] for n in path) / len(path), leaf, path[::-1]))
        for _, leaf, path in sorted(branches, key=lambda b: (round(b[0], 12), b[1]))[:3]:
            want[tree, leaf] = [(nodes[n][3], nodes[n][4]) for n in path]
    once = chat.once(messages)
    out = chat.format_paths(once, chat.paths(once, best=3)).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans"))).collect()
    assert {(r.tree, r.leaf): [tuple(t) for t in r.turns] for r in out} == want
    assert all(r.loss == "".join(t for role, t in want[r.tree, r.leaf] if role == "assistant") for r in out)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, duck, name):
    assert rows_of(queries.QUERIES[name](spark, SF).toPandas()) == rows_of(duck.sql(queries.ORACLES[name]).df())


def test_pipeline(spark):
    """The stages one by one against plain rules on the smallest tables."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(common.Stored(stage(spark, seen[-1], SF), "test").df)
        assert seen[-1].columns == docs.columns
    rows = [{r.doc_id: r.text for r in x.collect()} for x in seen]
    assert set(rows[0]) - set(rows[1]) <= {i for i, t in rows[0].items() if not re.search(r"[^\W\d_]", t or "")}
    gone = set(rows[1]) - set(rows[2])
    assert all(labels.get(i, 1) for i in gone) and not [i for i in rows[2] if labels.get(i)]
    want = groups(list(rows[2].items()))
    assert set(rows[3]) == {i for i, (_, c) in want.items() if i == c}
    words = {i: " ".join(tiling.words_of(t)) for i, t in rows[3].items()}
    leaks = {i for i, t in words.items() if any(" ".join(tiling.words_of(x)) in t for _, x in items)}
    assert leaks <= set(rows[3]) - set(rows[4]) and len(rows[4]) >= 0.9 * len(rows[3])
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == set(rows[4])
    assert all(r.decoded_sha256 == hashlib.sha256(rows[4][r.doc_id].encode()).hexdigest() for r in out)


def test_pipeline_on_odd_tables(spark, odd, none, tmp_path):
    """Nulls, repeated ids, clashing and extra columns, and empty tables go through all stages."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = odd.withColumnsRenamed({"bucket": "_digest", "key": "_n", "d": "severity"}).withColumn("n_chars", F.lit(None).cast("long"))
    whole = docs.withColumns({"_digest": F.lit(1), "_n": F.lit("k"), "severity": F.lit(2).cast("long")}).select(extra.columns).unionByName(extra.withColumn("doc_id", F.col("doc_id") + 10**6))
    whole = whole.unionByName(whole.filter("doc_id < 3"))  # ids twice
    labels, items = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    for name, tables in {"odd": (whole, labels, items), "empty": (whole.limit(0), labels.limit(0), items.limit(0)), "bare": (whole, labels.limit(0), items.limit(0))}.items():
        for table, df in zip(("documents", "labels", "benchmark"), tables, strict=True):
            df.write.parquet(str(tmp_path / name / f"{table}.parquet"))
    seen = spark.read.parquet(str(tmp_path / "odd" / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen = common.Stored(stage(spark, seen, str(tmp_path / "odd")), "test").df
        assert seen.columns == whole.columns
    kept = seen.collect()
    assert kept and all(re.search(r"[^\W\d_]", r.text) for r in kept)
    got = sorted(str((r.doc_id, r.decoded_sha256)) for r in corpus_pipeline.run(spark, str(tmp_path / "odd")).collect())
    assert got == sorted(str((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest())) for r in kept)
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path / "bare")).count() > 0


def test_clashing_columns(spark, odd):
    """Columns named as an operator's own do not change its result."""
    names = ["host", "rule", "m", "tree", "node", "leaf", "depth", "own", "head", "copy_to", "shard", "slot", "c", "v", "_n", "_digest", "item"]
    wide = odd.withColumns({n: F.lit("clash") for n in names})
    items = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    rows = lambda df: sorted(map(str, df.collect()))
    for f in (near_dedup.near_duplicates, sharding.shards, fingerprint.fingerprint_neighbours, licences.scan, language.predict_language, lambda d: tiling.matches(d, items), lambda d: tiling.matches(d, items, most=0)):
        assert rows(f(wide)) == rows(f(odd))
    assert tiling.decontaminate(wide, items, most=0).columns == wide.columns
