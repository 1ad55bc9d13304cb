"""Operators over texts against brute force, with nulls, ties, empty tables and odd columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rolemesh.llm import contamination, disclosure, fingerprints, languages, mixing, near_duplicates, queries, store, wavelet
from rolemesh.llm.words import hash_words, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, score double"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def make(spark, rows, schema=SCHEMA):
    """Rows (doc_id, text, lang, source) with extra columns whose names clash with inner ones."""
    full = [(*r, len(r[1]) if r[1] is not None else None, 1, 0.5) for r in rows]
    return spark.createDataFrame(full, schema)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(400)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 5, 9, 30, 80, 300]))) for _ in range(60)]
    for t in list(texts[:30]):
        own = t.split(" ")
        for _ in range(rng.randrange(1, 4)):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        texts += [" ".join(own), t.upper(), t]
    texts += [None, "", " \n\t", "x" * 50_000, "lone"]
    out = [(i, t, "en", f"s{i % 3}" if i % 7 else None) for i, t in enumerate(texts)]
    return [*out, out[0], (None, texts[1], None, "s1")]


def test_word_hashes_are_the_words():
    texts = ["Ab cd\nab", None, "", "é x\x0bY  ", "A" * 10]
    hashes, begins = hash_words(pa.array(texts))
    own = [w for t in texts for w in words(t)]
    assert np.diff(begins).tolist() == [len(words(t)) for t in texts]
    assert len({*zip(own, hashes.tolist())}) == len({*own}) == len({*hashes.tolist()})
    assert len(shingles(hashes[:3], 4)) == 1 and len(shingles(hashes[:0], 4)) == 0


def components(rows, size, num, den):
    sets = []
    for _, t, *_ in rows:
        w = words(t)
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if sets[i] and den * same >= num * (len(sets[i]) + len(sets[j]) - same):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], len(sets[i]), least.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("size,num", [(4, 85), (5, 80), (1, 50)])
def test_near_duplicates_equal_brute_force(spark, rows, size, num):
    got = near_duplicates.near_duplicate_classes(make(spark, rows), size, num, 100).collect()
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, got), key=key) == sorted(components(rows, size, num, 100), key=key)


def test_block_keys_lose_no_link():
    rng = np.random.default_rng(1)
    for num in (80, 85):
        for n in [*range(1, 40), 100, 333]:
            one = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            for gone in range(n // 3 + 1):
                two = np.unique(np.concatenate((one[gone:], rng.integers(0, 1 << 63, gone // 2).astype(np.uint64))))
                same = len(np.intersect1d(one, two))
                if len(two) and 100 * same >= num * (len(one) + len(two) - same):
                    assert np.intersect1d(*(near_duplicates.block_keys(x, num, 100) for x in (one, two))).size


def test_blocks_of_unrelated_sets_hold_one_set():
    """Sets of all sizes, then with a common passage: no block meets on empty parts, hardly one on the passage."""
    rng = np.random.default_rng(3)
    draw = lambda n: np.unique(rng.integers(0, (1 << 64) - 1, n, np.uint64))
    common = draw(60)
    for passage in (common[:0], common):
        sets = [np.union1d(draw(n), passage) for n in range(200, 1200, 5)]
        keys = np.concatenate([np.unique(near_duplicates.block_keys(x, 80, 100)) for x in sets])
        shared = np.unique(keys, return_counts=True)[1]
        assert (shared > 1).sum() <= (20 if len(passage) else 0)


def test_block_keys_lose_no_link_at_the_threshold():
    """Pairs that just link, of neighbouring classes too, with what differs dealt to as many parts as can be."""
    rng = np.random.default_rng(4)
    for num in (80, 85):
        for n in range(50, 700, 13):
            one = np.unique(rng.integers(0, (1 << 64) - 1, n, np.uint64))
            least = -(-num * n // 100)
            for same in {least, (least + n) // 2, n}:
                more = min(same * 100 // num - n, n // 3)
                kept = rng.permutation(one)[:same]
                for extra in {0, max(more, 0)}:
                    two = np.union1d(kept, rng.integers(0, (1 << 64) - 1, extra, np.uint64))
                    both = len(np.intersect1d(one, two))
                    assert 100 * both >= num * (len(one) + len(two) - both)
                    assert np.intersect1d(*(near_duplicates.block_keys(x, num, 100) for x in (one, two))).size


def test_tree_finds_all_bounded_pairs():
    rng = np.random.default_rng(2)
    points = rng.integers(0, 6, (90, 64))
    points[40:60] = points[:20] + rng.integers(0, 2, (20, 64))
    sizes = points.sum(axis=1)
    left, right = (near_duplicates.CountTree(points[s], sizes[s]) for s in (slice(0, 50), slice(50, 90)))
    found = {(int(a), int(b) + 50) for a, b in left.pairs(right, 85, 100)}
    want = {
        (a, b) for a in range(50) for b in range(50, 90)
        if np.minimum(points[a], points[b]).sum() * 185 >= (sizes[a] + sizes[b]) * 85
    }
    assert found == want and want


@pytest.mark.parametrize("strip", [512, 7])
def test_links_of_tiles_join_what_links(monkeypatch, strip):
    """Families of near copies, some pairs just below the threshold: the links of two tiles join the same components."""
    monkeypatch.setattr(near_duplicates, "STRIP", strip)
    rng = np.random.default_rng(9)
    sets = []
    for _ in range(6):
        base = rng.integers(0, 1 << 63, int(rng.integers(60, 400))).astype(np.uint64)
        for _ in range(25):
            own = base.copy()
            at = rng.choice(len(own), int(len(own) * rng.uniform(0.02, 0.12)), replace=False)
            own[at] = rng.integers(0, 1 << 63, len(at)).astype(np.uint64)
            sets.append(np.unique(own))
    order = rng.permutation(len(sets))
    members = [(i, i, sets[j]) for i, j in enumerate(order)]
    left, right = members[:80], members[80:]

    def parts(pairs):
        up = list(range(len(members)))
        for a, b in pairs:
            while up[a] != a:
                a = up[a]
            while up[b] != b:
                b = up[b]
            up[max(a, b)] = min(a, b)
        out = []
        for i in range(len(members)):
            while up[i] != i:
                i = up[i]
            out.append(i)
        return out

    for one, two in ((left, right), (left, left)):
        links = near_duplicates.tile_links(one, two, 85, 100)
        want = [(a[0], b[0]) for a in one for b in two if a[0] != b[0] and near_duplicates.linked(a[2], b[2], 85, 100)]
        assert want and parts(links) == parts(want) and len(links) < len(one) + len(two)
        assert all(near_duplicates.linked(members[a][2], members[b][2], 85, 100) for a, b in links)
    assert not near_duplicates.tile_links([], left, 85, 100)


def test_halves_of_hashes_miss_no_link():
    """Members may share a half, within a set or between two: what links by whole hashes links by halves."""
    rng = np.random.default_rng(4)
    for _ in range(300):
        pool = (rng.integers(0, 1 << 31, 60).astype(np.uint64) << np.uint64(32)) + rng.integers(0, 40, 60).astype(np.uint64)
        one, two = (np.unique(rng.choice(pool, int(rng.integers(1, 50)))) for _ in range(2))
        a, b = near_duplicates.half(one), near_duplicates.half(two)
        assert len(a) == len(one) and a.dtype == np.uint32
        for num in (20, 50, 85):
            assert near_duplicates.linked(a, b, num, 100) or not near_duplicates.linked(one, two, num, 100)
        both = near_duplicates.tile_links([(1, 1, a)], [(2, 2, b)], 20, 100)
        assert both or not near_duplicates.tile_links([(1, 1, one)], [(2, 2, two)], 20, 100)


def test_tiles_are_met_again_when_a_link_of_halves_is_none(spark):
    """The pairs of halves and, if verifying refuses one, those of whole hashes: both join what links."""
    texts = [f"{' '.join(f'w{i}' for i in range(40))} x{k}" for k in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found, clashed = near_duplicates._scan(docs, 4, 85, 100)
    nodes = found.select("node").distinct()
    rows = nodes.selectExpr("0L as cluster", "0 as tile", "0 as i", "0 as j", "node", "node as root")
    sound = near_duplicates._Verifier(docs, found, 4, 85, 100, clashed)

    class Strict(near_duplicates._Verifier):
        def links(self, pairs):
            return super().links(pairs).limit(1)

    strict = Strict(docs, found, 4, 85, 100, clashed)
    for verify in (sound, strict):
        assert near_duplicates._tile_links(rows, nodes, verify).count() == 5


def test_stored_tables_leave_no_shuffle(spark, monkeypatch):
    """The write drops its shuffles itself; the setting of the session is as before."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, seen = spark.conf.get(name), []
    write = type(spark.range(1).write).parquet
    monkeypatch.setattr(type(spark.range(1).write), "parquet", lambda w, path: (seen.append(spark.conf.get(name)), write(w, path))[1])
    assert store.stored(spark.range(9).groupBy("id").count(), "x").count() == 9
    assert seen == ["true"] and spark.conf.get(name) == before


def test_wavelet_matrix_answers_like_the_sequence():
    ids = np.random.default_rng(3).integers(0, 50, 5000).astype(np.uint16)
    matrix = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids, 16).to_bytes())
    assert (matrix.decode() == ids).all()
    at = [0, 1, 511, 512, 513, 4999]
    assert matrix.access(at).tolist() == ids[at].tolist()
    for symbol in (0, 7, 49, 60, 1 << 20):
        places = np.flatnonzero(ids == symbol)
        assert matrix.count(symbol) == len(places) and matrix.count(symbol, 700) == (places < 700).sum()
        if symbol < 60:
            assert matrix.positions(symbol).tolist() == places.tolist()
            assert matrix.select(symbol, 3) == places[3]


def test_shards_round_trip(spark, rows):
    path = queries.TOKENIZER
    shards = wavelet.write_shards(make(spark, rows), lambda: wavelet.word_encoder(path), 2, 16, shard_tokens=500)
    tokenizer = wavelet.WordEncoder(path).tokenizer
    got = sorted(map(tuple, wavelet.read_shards(shards).collect()), key=lambda r: r[1])
    start = 0
    for (doc_id, text, *_), row in zip(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), got, strict=True):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        assert row == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_encoder_equals_the_tokenizer():
    encoder, rng = wavelet.WordEncoder(queries.TOKENIZER), random.Random(4)
    signs = [*"aBcé ÉÀß.,!_'s0 1²½ª\n\t́İΣς中 ", "<|endoftext|>", "'ll", "."]
    texts = ["".join(rng.choices(signs, k=rng.randrange(30))) for _ in range(5000)]
    want = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode(texts)] == [w.ids for w in want]


def test_fingerprints_edit_and_estimate(spark, rows):
    got = fingerprints.edited_fingerprints(make(spark, rows)).collect()
    assert len(got) == len(rows)
    order = sorted({(r[0] is not None, r[0] or 0, r[1] or "") for r in rows})
    by = {(r.doc_id, r.n_chars): r for r in got}
    for i, (known, doc_id, text) in enumerate(order):
        after = order[(i + 1) % len(order)][2]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        r = by[doc_id if known else None, len(text)]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        one, two = (Counter(WORD.findall(t.lower())) for t in (text, edited))
        union = sum((one | two).values())
        exact = sum((one & two).values()) / union if union else 1.0
        assert abs(r.near_edited - exact) <= 4.5 / 2 / fingerprints.SAMPLES**0.5
        assert (text == edited) <= (r.fingerprint == r.edited_fingerprint)
    prints = {}
    for r in rows:
        p = by[r[0], len(r[1] or "")].fingerprint
        assert prints.setdefault(r[1] or "", p) == p
    single = fingerprints.fingerprints(make(spark, rows)).collect()
    assert {(r.doc_id, r.fingerprint) for r in single} == {(r.doc_id, r.fingerprint) for r in got}


def test_languages(spark):
    rng = random.Random(6)
    sound = {"aa": ["ba", "na", "ta", "ra"], "bb": ["oki", "umi", "esu"], "cc": ["schn", "ackt", "urz"]}
    rows = []
    for i in range(150):
        lang = rng.choice(list(sound))
        rows.append((i, " ".join("".join(rng.choices(sound[lang], k=3)) for _ in range(rng.randrange(1, 40))), lang, "s"))
    rows += [(150, None, "aa", "s"), (151, "12 !!", "aa", "s"), (152, "", None, "s"), (153, "bana", None, "s")]
    docs = make(spark, rows)
    profiles = languages.train(docs.where("doc_id % 5 <> 0"))
    got = {r.doc_id: r for r in languages.identify(docs, profiles).collect()}
    assert all(got[r[0]].lang_pred == r[2] for r in rows[:150])
    assert [got[i].lang_pred for i in (150, 151, 152, 153)] == ["und", "und", "und", "aa"]
    assert all(0 <= r.score <= 1 for r in got.values())
    none = docs.where("doc_id < 0")
    assert languages.train(none) == {} and languages.identify(none, profiles).count() == 0
    assert {r.lang_pred for r in languages.identify(docs, {}).collect()} == {"und"}


def test_leaks_and_wand(spark):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 6))) for _ in range(500)]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, say(rng.randrange(15, 60))) for i in range(40)] + [(40, None), (41, ""), (42, "word")]
    rows = [(i, say(200), "en", "s") for i in range(30)] + [(90, None, "en", "s"), (91, "", "en", "s")]
    for i in range(30, 60):
        own = say(150).split(" ")
        cut = rng.randrange(len(own))
        rows.append((i, " ".join(own[:cut]) + " " + items[i - 30][1].upper() + ". " + " ".join(own[cut:]), "en", "s"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for shard in (1 << 16, 300):
        got = contamination.find_leaks(make(spark, rows), benchmark, shard_bytes=shard).collect()
        assert {(r.doc_id, r.item_id) for r in got} == {(i, i - 30) for i in range(30, 60)}
    assert contamination.find_leaks(make(spark, rows), benchmark.where("item_id > 99")).count() == 0
    hashes, at = contamination._words(pa.array([t for _, t in items[:40]]))
    df = Counter(int(t) for i in range(40) for t in np.unique(hashes[at[i] : at[i + 1]]).view(np.int64))
    index = contamination.Index.build(list(range(40)), [t for _, t in items[:40]], df, 40, len(hashes) / 40)
    for _ in range(60):
        query = np.unique([rng.randrange(len(index.terms)) for _ in range(40)])
        scores = np.zeros(40)
        for t in query:
            own = slice(index.begins[t], index.begins[t + 1])
            scores[index.item[own]] += index.score[own]
        assert {i for i, _ in index.search(query, 0.15)} == set(np.flatnonzero(scores >= 0.15))
    short = spark.createDataFrame([(1, "w x y"), (2, "some four word item")], "item_id long, text string")
    texts = make(spark, [(1, "z w x y z", "en", "s"), (2, "with some four word item inside", "en", "s")])
    assert [(r.doc_id, r.item_id) for r in contamination.find_leaks(texts, short).collect()] == [(2, 2)]


def test_leaks_equal_brute_force(spark):
    """Every passage against every item by its own formula, without an index."""
    rng = random.Random(77)
    vocabulary = [f"v{i}" for i in range(90)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(6, 30)))) for i in range(25)]
    rows = []
    for i in range(60):
        own = rng.choices(vocabulary, k=rng.randrange(5, 200))
        if rng.random() < 0.7:
            item = items[rng.randrange(25)][1].split(" ")
            cut = rng.randrange(len(own))
            own[cut:cut] = item[: len(item) - rng.choice([0, 0, 0, 1, 2, 6])]
        rows.append((i, " ".join(own), "en", "s"))
    words_of = {i: t.split(" ") for i, t in items}
    df = Counter(w for own in words_of.values() for w in set(own))
    mean = sum(map(len, words_of.values())) / len(items)

    def weight(w, own):
        idf = np.log(1 + (len(items) - df[w] + 0.5) / (df[w] + 0.5))
        tf = own.count(w)
        return idf * tf * (contamination.K1 + 1) / (tf + contamination.K1 * (1 - contamination.B + contamination.B * len(own) / mean))

    def share(part, text):
        k = min(contamination.NGRAM, len(part))
        grams = lambda x: {tuple(x[j : j + k]) for j in range(len(x) - k + 1)}
        return len(grams(part) & grams(text)) / len(grams(part))

    longest = max(map(len, words_of.values()))
    want = {}
    for doc, text, *_ in rows:
        own = text.split(" ")
        starts = range(0, max(1, len(own) - contamination.PASSAGE + contamination.STEP), contamination.STEP)
        for item, words in words_of.items():
            total = sum(weight(w, words) for w in set(words))
            for first in starts:
                passage = own[first : first + contamination.PASSAGE]
                score = sum(weight(w, words) for w in set(words) & set(passage)) / total
                around = own[max(0, first - longest) : first + len(passage) + longest]
                cut = len(words) - max(1, len(words) // 4)
                if score >= contamination.SCORE and min(share(words[:cut], around), share(words[cut:], around)) >= contamination.OVERLAP:
                    want[doc, item] = max(want.get((doc, item), 0), score)
    got = {(r.doc_id, r.item_id): r.score for r in contamination.find_leaks(make(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got.keys() == want.keys() and len(want) > 10
    assert all(got[k] == pytest.approx(v, abs=1e-5) for k, v in want.items())


def test_long_items_leak_at_every_offset(spark):
    rng = random.Random(17)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randrange(3, 7))) for _ in range(3000)]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    # The last item has its rare words at both ends, and no passage holds both ends at every offset.
    items = [(n, say(n)) for n in (110, 200, 1000)] + [(64, " ".join([say(14), *["common"] * 36, say(14)]))]
    rows = [(1000 * k + i, f"{say(i)} {t} {say(150)}", "en", "s") for k, (_, t) in enumerate(items) for i in range(64)]
    rows += [(9000 + i, say(1200), "en", "s") for i in range(10)]
    # Half a question is no leak, though whole pieces of the item are there.
    rows += [(9100, " ".join(items[1][1].split(" ")[:70]), "en", "s")]
    got = contamination.find_leaks(make(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {(1000 * k + i, n) for k, (n, _) in enumerate(items) for i in range(64)}
    assert len(got) == len(want) and {(r.doc_id, r.item_id) for r in got} == want
    assert all(r.score >= contamination.SCORE and r.question_overlap == r.answer_overlap == 1 for r in got)


def test_mix_meets_targets_and_caps(spark, rows):
    docs = make(spark, rows)
    plan = mixing.plan_mix(docs, block_words=8)
    got = mixing.taken_words(*plan).collect()
    assert sorted(r["size"] for r in got) == sorted(len(WORD.findall(r[1] or "")) for r in rows)
    assert all(r.taken <= 3 * r["size"] for r in got)
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.02 * own[0].target + 8
    assert sorted(map(str, got)) == sorted(map(str, mixing.taken_words(*mixing.plan_mix(docs, block_words=8)).collect()))
    mixed = mixing.mixed_documents(docs, block_words=8)
    assert mixed.columns == docs.columns
    taken = Counter()
    for r in got:
        taken[r.doc_id] += r.taken
    count = Counter()
    for r in mixed.collect():
        count[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert +count == +taken
    blocks = mixing.mixed_blocks(docs, plan[1], plan[2]).collect()
    assert sum(len(WORD.findall(r.text)) for r in blocks) == sum(taken.values())
    empty = docs.where("doc_id < 0")
    assert mixing.taken_words(*mixing.plan_mix(empty)).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_targets_by_hand():
    got = mixing.targets({"a": 100, "b": 100, None: 700, "c": 0})
    # 900 words by weights 5, 2, 1, 5 for a, b, c, null: a would get 346.2 and stops at 300, c has
    # nothing; b and null share the other 600 by 2 and 5.
    assert {k: float(v) for k, v in got.items()} == {"a": 300.0, "b": 1200 / 7, "c": 0.0, None: 3000 / 7}


def test_mix_equals_a_deal_by_hand(spark, rows):
    """Words laid out, slots dealt and blocks counted one by one, with the same permutations."""
    block = 8
    docs = make(spark, rows)
    documents, pieces, slots = mixing.plan_mix(docs, block_words=block)
    laid = {(r.source, r.first): r for r in documents.where("size > 0").collect()}
    sizes = Counter()
    for r in laid.values():
        assert len(WORD.findall(next(t for i, t, _, s in rows if (i, s) == (r.doc_id, r.source) and len(WORD.findall(t or "")) == r["size"]) or "")) == r["size"]
        sizes[r.source] += r["size"]
    due = mixing.targets(sizes)
    names = list(due)
    counts = [-(-sizes[s] // block) for s in names]
    draws = [round(due[s] * c / sizes[s]) if sizes[s] else 0 for s, c in zip(names, counts)]
    times = Counter()
    for slot in range(sum(draws)):
        place = int(mixing.permuted(np.array([slot]), sum(draws), mixing.SEED)[0])
        number = next(i for i in range(len(draws)) if place < sum(draws[: i + 1]))
        draw = place - sum(draws[:number])
        seed = mixing.SEED + 1 + number * (mixing.CAP + 1) + draw // counts[number]
        times[names[number], int(mixing.permuted(np.array([draw % counts[number]]), counts[number], seed)[0])] += 1
    want = Counter()
    for (source, first), r in laid.items():
        for w in range(first, first + r["size"]):
            want[r.doc_id, r.h, r.row, source] += times[source, w // block]
    got = {(r.doc_id, r.h, r.row, r.source): r.taken for r in mixing.taken_words(documents, pieces, slots).collect()}
    assert {k: v for k, v in got.items() if v} == +want and sum(got.values()) > 100
    # Every word of a source stands at one place.
    for s in names:
        spans = sorted((r.first, r["size"]) for (source, _), r in laid.items() if source == s and r["size"])
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and (not spans or spans[0][0] == 0)


def test_mixed_documents_keep_clashing_columns(spark, rows):
    docs = make(spark, rows).withColumns({c: F.lit(c) for c in ("s", "n", "spans", "source_number", "times", "id", "of", "doc")})
    mixed = mixing.mixed_documents(docs, block_words=8)
    assert mixed.columns == docs.columns
    assert {(r.h, r.s, r.n, r.spans, r.id, r.doc) for r in mixed.collect()} == {(1, "s", "n", "spans", "id", "doc")}


def test_shards_of_text_ids(spark):
    docs = spark.createDataFrame([("b", "two words"), ("a", None), (None, "x"), ("a", "")], "doc_id string, text string")
    path = queries.TOKENIZER
    shards = wavelet.write_shards(docs, lambda: wavelet.word_encoder(path), 2, 16)
    got = wavelet.read_shards(shards, "string").collect()
    assert sorted((r.doc_id or "", r.start) for r in got)[0][1] == 0 and [r.n_tokens for r in got if r.doc_id == "a"] == [1, 1]
    file = shards.where("n_tokens > 0").first().file
    doc_ids, lengths, matrix = wavelet.unpack_shard(file)
    assert len(doc_ids) == len(lengths) and matrix.n == lengths.sum() and matrix.count(2) == len(lengths)
    assert wavelet.read_shards(wavelet.write_shards(docs.limit(0), lambda: wavelet.word_encoder(path), 2, 16), "string").count() == 0


def test_fingerprints_of_text_ids(spark):
    docs = spark.createDataFrame([("b", "one two three"), ("a", "one two four"), (None, "")], "doc_id string, text string")
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect()}
    assert set(got) == {"a", "b", None} and got[None].near_next == 0.0 and 0 < got["a"].near_next < 1


def test_fingerprints_estimate_similarity(spark):
    """The mean error over many pairs is that of as many samples, and single ones stay within a few of it."""
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(80):
        own = rng.choices(vocabulary, k=rng.randrange(20, 200))
        texts += [" ".join(own), " ".join(own[: rng.randrange(1, len(own))] + rng.choices(vocabulary, k=rng.randrange(60)))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect()}
    errors = []
    for i, text in enumerate(texts):
        one, two = Counter(text.split()), Counter(texts[(i + 1) % len(texts)].split())
        exact = sum((one & two).values()) / sum((one | two).values())
        errors.append((got[i].near_next - exact, (exact * (1 - exact) / fingerprints.SAMPLES) ** 0.5 + 1e-3))
    assert all(abs(e) <= 4.5 * s for e, s in errors)
    assert np.std([e for e, _ in errors]) < 0.06 and abs(np.mean([e for e, _ in errors])) < 0.02


def test_languages_equal_dense_bundles(spark):
    """Predictions and cosines against bundles built vector by vector."""
    rng = random.Random(21)
    alphabets = {"aa": "abcde", "bb": "defgh", "cc": "äöüéfg"}
    texts = [(i, " ".join("".join(rng.choices(alphabets[x], k=rng.randrange(1, 7))) for _ in range(20)), x, "s") for i, x in enumerate(list(alphabets) * 12)]
    docs = make(spark, texts)
    prototypes = languages.train(docs.where("doc_id < 30"))
    vectors = languages.Vectors(languages.DIMENSIONS)
    got = {r.doc_id: r for r in languages.identify(docs, prototypes).collect()}
    for i, text, _, _ in texts:
        codes, _ = languages.ngram_codes([text])
        bundle = vectors.bind(codes).astype(float).sum(axis=0)
        cosine = {k: float(bundle @ v / np.linalg.norm(bundle) / np.linalg.norm(v)) for k, v in prototypes.items()}
        best = max(cosine, key=cosine.get)
        # The length of a bundle is taken from its counts: a few hundredths off.
        assert got[i].lang_pred == best and got[i].score == pytest.approx(cosine[best], abs=0.06)


def test_added_spans_equal_counts_by_hand(spark):
    """The words that give an entity away, from counts over all texts."""
    rng = random.Random(31)
    names = [f"name{i}" for i in range(12)]
    common = [f"c{i}" for i in range(40)]
    texts = []
    for _ in range(160):
        k = rng.randrange(12)
        own = rng.choices(common, k=rng.randrange(3, 30)) + [names[k]] * (rng.random() < 0.8) + [rng.choice(names)] * (rng.random() < 0.15)
        rng.shuffle(own)
        if rng.random() < 0.6:
            own.insert(rng.randrange(len(own)), f"person{k}@host{k % 3}.org")
        texts.append(" ".join(own))
    texts += texts[:9] + [None, ""]
    docs = make(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in disclosure.find_spans(docs).collect()}
    spans = [disclosure.base_spans(t or "") for t in texts]
    entities = [{e for s in own for e in disclosure.entities_of(s[3])} for own in spans]
    words_of = [set(re.findall("[0-9a-z]+", (t or ""))) for t in texts]
    free = [set(re.findall("[0-9a-z]+", disclosure.free_words(t or "", own))) for t, own in zip(texts, spans)]
    n = len(texts)
    ne, df = Counter(e for own in entities for e in own), Counter(w for own in words_of for w in own)
    both, apart = Counter(), {}
    for t, own, terms in zip(texts, entities, free):
        for e in own:
            for w in terms:
                both[e, w] += 1
                apart.setdefault((e, w), set()).add(t)
    risky = {}
    for (e, w), k in both.items():
        share = np.log(n * k / (ne[e] * df[w])) / np.log(n / ne[e])
        if len(apart[e, w]) >= disclosure.SUPPORT and round(share, 6) >= disclosure.GENERALISE:
            risky[e, w] = "removed" if round(share, 6) >= disclosure.REMOVE else "generalised"
    added = 0
    for i, t in enumerate(texts):
        own = set()
        if spans[i]:
            for m in re.finditer("[0-9a-z]+", disclosure.free_words(t, spans[i])):
                actions = {risky[e, m.group()] for e in entities[i] if (e, m.group()) in risky}
                if actions:
                    own.add((max(actions), *m.span()))
        added += len(own)
        want = [f"{k}:{a}:{b}" for k, a, b, _ in spans[i]] + [f"{k}:{a}:{b}" for k, a, b in sorted(own)]
        assert got[i].spans == ",".join(want)
    assert added > 20


def test_sanitised_keeps_clashing_columns(spark):
    docs = make(spark, [(i, f"Berlin {1980 + i} a@b.org x", "en", "s") for i in range(4)] + [(9, None, "en", "s")])
    docs = docs.withColumns({c: F.lit(c) for c in ("spans", "of_id", "of_h", "of_spans", "my_id", "my_h", "d")})
    clean = disclosure.sanitised(docs)
    assert clean.columns == docs.columns
    assert {(r.spans, r.of_h, r.my_id, r.d, r.h) for r in clean.collect()} == {("spans", "of_h", "my_id", "d", 1)}
    assert [disclosure.general_form(w) for w in ("1987", "007", "0", "Berlin", "word", "ż1")] == ["1000+", "7+", "0", "[Name]", "[word]", "[word]"]


def test_permutation_is_one():
    for n in (1, 2, 3, 17, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 9).tolist()) == list(range(n))


PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and disclosure.luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(8)
    for _ in range(8000):
        text = "".join(rng.choices("ab1.2@-+ 3_(%é\n", k=rng.randrange(40)))
        assert [s[:3] for s in disclosure.base_spans(text)] == plain_spans(text), text


def test_words_that_reveal_a_value(spark):
    filler = ["one two three four five six seven eight nine ten %d" % i for i in range(60)]
    told = [f"zebra writes from a.b@mail.example.org about {filler[i]}" for i in range(5)]
    rows = [(i, t, "en", "s") for i, t in enumerate([*told, *filler, None, "", told[0]])]
    docs = make(spark, rows)
    got = {r.doc_id: r for r in disclosure.find_spans(docs).collect()}
    assert len(got) == len(rows) and got[0].base == "email:18:38"
    assert "removed:0:5" in got[0].spans and got[10].spans == "" and got[65].spans == ""
    clean = {r.doc_id: r.text for r in disclosure.sanitised(docs).collect()}
    assert "zebra" not in clean[0] and "[EMAIL]" in clean[0] and clean[10] == rows[10][1] and clean[65] is None
    assert disclosure.find_spans(docs.where("doc_id < 0")).count() == 0


def test_words_far_from_a_value_reveal_it(spark):
    filler = [" ".join(f"w{(i * k) % 97}" for k in range(1, 30)) for i in range(60)]
    told = [f"Zebra {filler[i]} a.b@mail.example.org {filler[i + 9]} é zebra {filler[i + 5]} ZEBRA" for i in range(5)]
    near = "zebra " + filler[3]
    rows = [(i, t, "en", "s") for i, t in enumerate([*told, *filler, near, told[1]])]
    got = {r.doc_id: r for r in disclosure.find_spans(make(spark, rows)).collect()}
    for i in (0, 1, 2, 3, 4, 66):
        text = rows[i][1]
        want = {f"removed:{m.start()}:{m.end()}" for m in re.finditer("(?i)zebra", text)}
        want |= {f"removed:{m.start()}:{m.end()}" for m in re.finditer("é", text)}
        spans = got[i].spans.split(",")
        assert len(want) == 4 and want <= set(spans) and spans[0] == got[i].base
    # Without the value the word discloses nothing.
    assert got[65].spans == "" and all(got[i].spans == "" for i in range(5, 65))
    # Two texts are not enough, however often they are repeated.
    few = [(i, told[i % 2], "en", "s") for i in range(6)] + rows[5:65]
    assert all(r.spans == r.base for r in disclosure.find_spans(make(spark, few)).collect())


def test_words_that_touch_a_value_are_not_free():
    text = "éa@b.cd x1.2.3.4y next +49 170 1234567 end"
    spans = disclosure.base_spans(text)
    free = disclosure.free_words(text, spans)
    assert len(free) == len(text) and free.split() == ["next", "end"]
