"""Operators over the whole corpus, against brute force: duplicates, mixing, top-k, language model, pieces, pipeline."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from weft.llm import common, components, eliasfano, exact, lm, mixing, pieces, registry, simhash, topk


def test_exact_duplicates(monkeypatch, docs, empty, rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r[0])
    want = collections.Counter()
    for text, ids in groups.items():
        least = min((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, least, len(ids), i == least, hashlib.sha256(text.encode()).hexdigest()] += 1
    def found(df, *row):
        return collections.Counter((r.id, r.keep_id, r.group_size, r.kept, r.digest) for r in exact.duplicates(df, *row).collect())

    assert found(docs) == want
    monkeypatch.setattr(exact, "LANE_ROWS", 3)  # some seventy lanes, three rounds
    assert found(docs) == want
    assert exact.duplicates(empty).count() == 0
    # rows with a key of their own: one row of each group stays
    kept = [r for r in exact.duplicates(docs.withColumn("key", F.monotonically_increasing_id()).cache(), "key").collect() if r.kept]
    assert sorted(r.digest for r in kept) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in groups)
    assert all(r.id == r.keep_id for r in kept)


def brute_fingerprint(text):
    found = text.encode().lower().split()
    shingles = [b" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))] if found else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def test_fingerprints(docs, rows):
    want = collections.Counter((r[0], brute_fingerprint(r[1] or "")) for r in rows)
    assert collections.Counter((r.id, r.fp % (1 << 64)) for r in simhash.fingerprints(docs).collect()) == want


def brute_components(values, radius=2):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("bucket", [2048, 8])
def test_links_against_all_pairs(spark, monkeypatch, bucket):
    """With a tiny bucket bound the second dealing does the work; the components stay the same."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(3)
    values = {0, 1, 3, (1 << 64) - 1}
    for seed in rng.integers(0, 1 << 63, 25).tolist():
        for _ in range(14):
            seed ^= 1 << int(rng.integers(64)) ^ (1 << int(rng.integers(64)))
            values.add(seed)
    for _ in range(120):  # one dense bucket: the last 16 bits alone differ
        values.add((0xABCDEF << 40) + int(rng.integers(1 << 16)))
    values = sorted(values)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    roots = brute_components(values)
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = {r.id: r.root for r in components.components(simhash.links(fps)).collect()}
    least = collections.defaultdict(lambda: 1 << 70)
    for v, r in zip(signed, roots, strict=True):
        least[r] = min(least[r], v)
    sizes = collections.Counter(roots)
    for v, r in zip(signed, roots, strict=True):
        assert found.get(v, v) == (least[r] if sizes[r] > 1 else v)


@pytest.mark.parametrize(("longs", "radius"), [(1, 0), (1, 1), (1, 2), (1, 9), (2, 31)])
def test_bit_sliced_comparison_against_all_pairs(monkeypatch, longs, radius):
    """Many buckets at once, from one value to hundreds, against plain xors; and their spanning forests."""
    monkeypatch.setattr(simhash, "PAIRS", 500)
    rng = np.random.default_rng(longs + radius)
    values, bucket = [], []
    for b in range(30):
        seed = rng.integers(0, 1 << 63, longs).astype(np.uint64)
        for _ in range(int(rng.integers(1, 150))):
            v = seed.copy()
            for at in rng.integers(0, 64 * longs, int(rng.integers(0, 2 * radius + 2))).tolist():
                v[at >> 6] ^= np.uint64(1 << (at & 63))
            values.append(v)
            bucket.append(b)
    values, cuts = np.stack(values), np.flatnonzero(np.diff(bucket, prepend=-1))
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if bucket[i] == bucket[j] and np.bitwise_count(values[i] ^ values[j]).sum() <= radius}
    found = [p for i, j in simhash.neighbours(values, cuts, radius) for p in zip(i.tolist(), j.tolist(), strict=True)]
    assert len(found) == len(set(found)) and set(found) == want
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in simhash.forests(values, cuts, radius).tolist():
        assert (i, j) in want and find(i) != find(j)
        root[find(i)] = find(j)
    assert all(find(i) == find(j) for i, j in want)


def test_comparison_abandons_blocks():
    """Words whose 64 lanes are all too far leave early: far values cost no more than their first planes."""
    rng = np.random.default_rng(9)
    planes = simhash.bit_planes(rng.integers(0, 1 << 63, (6400, 1)).astype(np.uint64))
    seen = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            seen.append(len(key[1]))
            return np.asarray(self)[key]

    flags = simhash.within(planes.view(Watched), np.arange(100), np.zeros((100, 1), np.uint64), 2)
    assert not flags.any() and seen[0] == 100 and len(seen) < 64


def near_texts(rng):
    """Texts with copies that differ in a word or a few, boilerplate that many share, and short and empty ones."""
    vocabulary = [a + b + c for a in "bdfgklm" for b in "aeiou" for c in "nrst"]
    texts = {}
    for group in range(25):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(40, 200))]
        for _ in range(rng.randrange(1, 7)):
            own = list(words)
            for _ in range(rng.randrange(0, 5)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts[len(texts)] = " ".join(own)
        if group % 5 == 0:
            texts[len(texts)] = " ".join(words[: len(words) // 2])  # a half is no near copy
    for _ in range(60):  # one large group around one text
        own = words[:]
        own[rng.randrange(len(own))] = rng.choice(vocabulary)
        texts[len(texts)] = " ".join(own)
    for t in ("", None, " \t", "one two", "ONE  two", "one two three"):
        texts[len(texts)] = t
    return texts


def brute_groups(texts):
    """Smallest key of each text's component under a Jaccard similarity of 0.8 on word 5-shingles."""
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    sets = {k: shingles(t) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(texts)
    for n, i in enumerate(keys):
        for j in keys[:n]:
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


@pytest.mark.parametrize("block", [4096, 8])
def test_similar_texts_against_all_pairs(spark, monkeypatch, block):
    """With tiny blocks large buckets are cut and later rounds have to join what the first left apart."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    texts = near_texts(random.Random(11))
    want = brute_groups(texts)
    docs = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "row long, text string, label int").repartition(4)
    found = {r.row: r.label for r in simhash.similar(docs).collect()}
    groups = collections.defaultdict(set)
    for k in texts:
        groups[found.get(k, -1 - k)].add(k)
    for group in groups.values():  # never together what isn't
        assert len({want[k] for k in group}) == 1
    linked = sum(len(g) - 1 for g in groups.values())
    assert linked >= 0.97 * (len(want) - len(set(want.values())))
    assert simhash.similar(docs.limit(0)).count() == 0


def test_a_group_below_the_similarity_is_not_verified_pair_by_pair(spark, monkeypatch):
    """Copies of one text that differ in two words each are candidates, but no sets that a sketch proves too different."""
    rng, m = random.Random(5), 120
    base = [f"w{k}x{rng.randrange(1000)}" for k in range(100)]
    texts = []
    for n in range(m):
        own = list(base)
        for k in rng.sample(range(6, 94), 2):
            own[k] = f"own{n}x{k}"
        texts.append(" ".join(own))
    asked, verified = [], simhash._verified

    def counted(pairs, texts):
        asked.append(pairs.count())
        return verified(pairs, texts)

    monkeypatch.setattr(simhash, "_verified", counted)
    want = brute_groups(dict(enumerate(texts)))
    found = {r.row: r.label for r in simhash.similar(spark.createDataFrame(list(enumerate(texts)), "row long, text string")).collect()}
    assert all(want[a] == want[b] for a in found for b in found if found[a] == found[b])
    assert sum(asked) < 5 * m  # of 7,140 pairs


def test_sketches_drop_no_similar_pair_and_leave_each_pair_one_table():
    rng = random.Random(3)
    texts = [(t or "").encode() for t in near_texts(rng).values()]
    wide, parity, sizes = simhash.wide_fingerprint(texts)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
    kept = simhash.may_be_similar(parity, sizes, i, j)
    assert all(k or simhash.jaccard(texts[a], texts[b]) < simhash.SIMILARITY for k, a, b in zip(kept.tolist(), i.tolist(), j.tolist(), strict=True))
    assert kept.mean() < 0.5
    same = simhash.table_keys(wide)[i] == simhash.table_keys(wide)[j]
    tables = np.arange(simhash.TABLES)
    pair, table = np.nonzero(same)
    first = np.where(same.any(1), same.argmax(1), -1)
    assert (simhash.in_first_table(wide[i[pair]] ^ wide[j[pair]], tables[table]) == (table == first[pair])).all()


def test_near_duplicates_of_messy_rows(docs, empty, rows):
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    fps = sorted({brute_fingerprint(r[1] or "") for r in rows})
    root = dict(zip(fps, brute_components(fps), strict=True))
    least = {}
    for r in rows:
        k = root[brute_fingerprint(r[1] or "")]
        if r[0] is not None:
            least[k] = min(least.get(k, r[0]), r[0])
    for r in found:
        assert r.component_id == least.get(root[r.fp % (1 << 64)])
    assert simhash.near_duplicates(empty).count() == 0


def test_chain_and_hub_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 400)] + [(5, 5)]
    found = {r.id: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 100 for i in range(100, 161)) and all(found[i] == 7 for i in range(200, 400)) and 5 not in found


def brute_targets(sizes, rows=()):
    """Each source's share of all words by weight, capped at three times its own, the excess reshared."""
    for source, n in rows:
        sizes[source] += n
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, free = sum(sizes.values()), set(sizes)
    while free:
        level = (total - sum(3 * sizes[s] for s in sizes if s not in free)) / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] > 3 * sizes[s]}
        if not over:
            break
        free -= over
    return {s: level * weights[s] if s in free else 3.0 * sizes[s] for s in sizes}


def test_targets_fill_to_their_caps(spark):
    sizes = collections.Counter({"a": 10, "b": 1000, "c": 500, "d": 0, None: 20})
    found = {r.source: r for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    want = brute_targets(sizes)
    assert all(math.isclose(found[s].target, want[s]) for s in sizes)


def test_mix_of_messy_rows(docs, empty, rows):
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    by_target = collections.defaultdict(int)
    for r in found:
        assert 0 <= r.taken <= 3 * r["size"]
        by_target[r.target] += r.taken
    for target, taken in by_target.items():
        assert abs(taken - target) <= 2
    assert mixing.mix(empty).count() == 0
    nothing = docs.withColumn("text", F.lit(" "))
    assert {r.taken for r in mixing.mix(nothing).collect()} == {0}


def test_schedule_is_spread_evenly(spark):
    """Any run of slots holds each source about as often as its share says."""
    sources = mixing.targets(spark.createDataFrame([("a", 40_000), ("b", 90_000), ("c", 70_000)], "source string, size long"))
    slots = mixing.schedule(spark, sources, 200_000, 3).where("slot IS NOT NULL").orderBy("slot").collect()
    shares = {r.source_no: r.high - r.low for r in sources.collect()}
    half = collections.Counter(s.source_no for s in slots[: len(slots) // 2])
    for no, share in shares.items():
        assert abs(half[no] - share * len(slots) / 2) < 10


def test_top_k_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "ROWS", 64)
    rng = np.random.default_rng(2)
    data = [(i, [float(x) for x in rng.normal(size=9).round(2)]) for i in range(400)]
    data += [(i, data[50][1]) for i in range(400, 460)]  # ties
    data += [(450, None), (500, [1.0, None]), (550, [float("nan")] * 9), (600, [float("inf")] * 9), (650, [0.5, 0.25]), (None, [1.0] * 9), (700, [])]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(6)
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, a in usable:
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in usable if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in topk.top_k(vectors.withColumns({"id": F.lit(1), "score": F.lit(2), "block": F.lit(3)})).collect()) == sorted(want)
    assert topk.top_k(vectors.limit(0)).count() == 0


def test_top_k_skips_products_that_cannot_count(spark, monkeypatch):
    """Clustered vectors: few candidates can reach the cutoff, so most local scores are never formed."""
    monkeypatch.setattr(topk, "ROWS", 256)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 32)) * np.linspace(3, 0.1, 32)
    vectors = np.array([centres[i % 40] + rng.normal(size=32) * 0.02 for i in range(4000)])
    data = list(enumerate((vectors / np.linalg.norm(vectors, axis=1)[:, None]).tolist()))
    counts = topk.Counts(spark)
    found = topk.top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(4), counts=counts).collect()
    whole = np.floor(256 * np.array([v for _, v in data])).astype(np.int64)
    want = set()
    for q in range(0, 4000, 50):
        best = sorted((-int(s), i) for i, s in enumerate(whole @ whole[q]) if i != q)[:5]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(r) for r in found} == want
    assert counts.pairs.value == 80 * 4000 and counts.formed.value < 0.5 * topk.LISTS * counts.pairs.value


def test_top_k_of_huge_components(spark):
    """Sums beyond 2^53 are whole numbers still; beyond 64 bits they are the nearest long."""
    data = [(0, [2.0**27, 1.0]), (1, [2.0**27, 1.0 / 256]), (2, [2.0**27, 2.0 / 256]), (3, [1e17, 1.0]), (4, [-1e308, 2.0]), (5, [1e308, 0.0]), (6, [0.0, 0.5])]
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    whole = [[int(x) * 256 if abs(x) >= 2**45 else math.floor(256 * x) for x in v] for _, v in data]
    scores = [max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(whole[0], v, strict=True)))) for v in whole]
    want = sorted((-s, i) for i, s in enumerate(scores) if i)[:5]
    assert [found[0, k + 1] for k in range(5)] == [(i, -s) for s, i in want]


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((0, 9), (1, 1), (5, 3), (3000, 10**6), (3000, 2**62), (2000, 900)):
        values = np.sort(rng.integers(0, top, n).astype(np.uint64))
        coded = eliasfano.unpack(np.frombuffer(eliasfano.pack({"x": eliasfano.EliasFano.build(values)}), np.uint8))["x"]
        assert (coded.get(np.arange(n)) == values).all()
        if n > 1:
            some = rng.integers(0, n - 1, 500)
            assert all((x == values[some + k]).all() for k, x in enumerate(coded.get_two(some)))
        asked = np.concatenate([values, rng.integers(0, 2 * top, 200).astype(np.uint64)])
        found = coded.find(asked)
        assert all((p >= 0 and values[p] == q) or (p < 0 and q not in values) for p, q in zip(found.tolist(), asked, strict=True))


def test_language_model_against_dictionaries(docs, empty, rows):
    model = lm.fit(docs)
    found = lm.score(docs, model).collect()
    assert len(found) == len(rows)
    seqs = [(r[0], [*(r[1] or "").encode().lower().split(), None]) for r in rows]
    c1, c2, c3 = collections.Counter(), collections.Counter(), collections.Counter()
    for _, s in seqs:
        c1.update(s)
        c2.update(zip([None, *s], s, strict=False))
        c3.update(zip([None, *s], s, s[1:], strict=False))
    n, v = sum(c1.values()), len(c1)
    assert model.tokens == n and model.n_words == v
    base = collections.Counter((i, len(s), round(sum(math.log10((c1[w] + 1) / (n + v + 1)) for w in s), 4)) for i, s in seqs)
    assert collections.Counter((r.id, r.n_tokens, round(r.base_score, 4)) for r in found) == base
    assert all(r.n_known == r.n_tokens for r in found) and lm.fit(docs).pair_sizes.sum() == len(c2)
    assert sum(r.score for r in found) > sum(r.base_score for r in found)
    nothing = lm.fit(empty)
    assert {r.score for r in lm.score(docs, nothing).collect()} == {0.0}


def brute_language_model(seqs):
    """The same smoothing in plain dictionaries: the log10 probability of a sequence that begins with None."""
    c1, c2, c3 = collections.Counter(), collections.Counter(), collections.Counter()
    for s in seqs:
        c1.update(s[1:])
        c2.update(zip(s, s[1:], strict=False))
        c3.update(zip(s, s[1:], s[2:], strict=False))

    def discount(counts):
        of = collections.Counter(counts.values())
        return min(max(of[1] / (of[1] + 2 * of[2]), 0.1), 0.95) if of[1] else 0.5

    d2, d3 = discount(c2), discount(c3)
    left2, left3 = collections.defaultdict(lambda: 1.0), collections.defaultdict(lambda: 1.0)
    for (u, _), n in c2.items():
        left2[u] -= (n - d2) / c1[u]
    for (u, v, _), n in c3.items():
        left3[u, v] -= (n - d3) / c2[u, v]

    def p1(w):
        return (c1[w] + 1) / (sum(c1.values()) + len(c1) + 1)

    def p2(u, w):
        return (c2[u, w] - d2 if c2[u, w] else 0) / max(c1[u], 1) + left2[u] * p1(w)

    def p3(u, v, w):
        return (c3[u, v, w] - d3 if c3[u, v, w] else 0) / max(c2[u, v], 1) + left3[u, v] * p2(v, w)

    def logp(s):
        return math.log10(p2(None, s[1])) + sum(math.log10(p3(*x)) for x in zip(s, s[1:], s[2:], strict=False))

    return logp, p3, (c1, c2, c3)


def test_language_model_smoothing_is_the_same_for_any_shards(spark):
    """Scores against plain dictionaries; only rounding lies between, and none between different cuts."""
    texts = ["a b c a b c a b d", "a b c", "b c a b", "c c a a b b", "a b e", "b d a b c d f"] * 3 + ["x y z", "a", "", " ".join(f"a w{i} a b v{i}" for i in range(40))]
    logp, p3, (c1, c2, c3) = brute_language_model([[None, *t.split(), None] for t in texts])
    assert math.isclose(sum(p3("a", "b", w) for w in [*c1, "unseen"]), 1)
    probes = [*texts[:6], "a b unseen", "f f f", "", "unseen a b", "a w3 a b v7", "a w39 a"]
    before = None
    for shard_tokens in (10**6, 40, 7):
        model = lm.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), shard_tokens=shard_tokens)
        assert model.pair_sizes.sum() == len(c2) and model.triple_sizes.sum() == len(c3)
        found = {r.id: r.score for r in lm.score(spark.createDataFrame(list(enumerate(probes)), "doc_id long, text string"), model).collect()}
        assert before in (None, found)
        before = found
        for i, t in enumerate(probes):
            s = [None, *t.split(), None]
            assert abs(found[i] - logp(s)) < 0.0006 * len(s), (t, found[i], logp(s))
    assert len(model.pair_sizes) > 16  # the last cut has words whose successors lie in several shards
    assert (model.pair_skip > 0).any()


def test_language_model_query(spark, sf, rows):
    """The query's every column, over messy rows, against plain dictionaries."""
    seqs = [(r[0], [None, *(r[1] or "").encode().lower().split(), None]) for r in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in seqs]
    logp, _, (c1, _, _) = brute_language_model([s for (_, s), h in zip(seqs, held, strict=True) if not h])
    n, v = sum(c1.values()), len(c1)
    result = registry.queries()["op3_lm"](spark, sf)
    assert [t for _, t in result.dtypes] == ["bigint", "boolean", "bigint", "bigint", "bigint", "double", "double"]
    found = collections.defaultdict(list)
    for r in result.collect():
        found[r.doc_id, r.n_tokens].append(r)
    for (i, s), h in zip(seqs, held, strict=True):
        options = found[i, len(s) - 1]
        assert options
        base = sum(math.log10((c1[w] + 1) / (n + v + 1)) for w in s[1:])
        known = sum(c1[w] > 0 for w in s[1:])
        assert any(r.held_out == h and r.train_tokens == n and r.n_known == known and math.isclose(r.base_score, base, abs_tol=1e-6) and abs(r.score - logp(s)) < 0.0006 * len(s) for r in options)


def test_words_that_share_a_hash_are_told_apart(spark, monkeypatch):
    """With a first hash of four bits: an unseen word isn't taken for a known one, and a corpus whose words collide is refused."""
    whole = common.hash_words
    monkeypatch.setattr(lm.common, "hash_words", lambda d, s, e, seed=1: whole(d, s, e, seed) & np.uint64(0xF) if seed < 1000 else whole(d, s, e, seed))
    model = lm.Model("file:///nowhere", 10, 0, 1)
    data = np.frombuffer(b"red green blue pink", np.uint8)
    assert len(lm._Block(model, data, np.array([0, 19])).distinct) <= 17
    with pytest.raises(ValueError, match="another seed"):
        lm._merged([[np.array([5, 5], np.uint64), np.array([1, 1]), np.array([1, 2], np.uint32)]], 1)


def test_pieces_against_the_library(spark, docs, rows):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    model = pieces.default_model()
    codec = pieces.Codec(model)
    texts = [r[1] or "" for r in rows] + ["  a", "a ", " " * 40, "▁a▁▁b", "<s>x</s>", "日本語 ﬁ", "=" * 99, "\n\n\tq", "x\x00y", "the" * 900]
    rng = np.random.default_rng(4)
    texts += ["".join(rng.choice(list(" \naeioth▁é日-=.0"), 40)) for _ in range(300)]
    for text in texts:
        ids = codec.encode(text)
        assert ids == library.encode(text)
        assert codec.decode(ids) == library.decode(ids)
        n, of_ids, of_text = codec.digests(text)
        assert (n, of_ids) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert of_text == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    back = {r.id: r.text for r in pieces.decode(pieces.encode(docs, model), model).collect()}
    assert back[205] == "one" and back[200] == ""


def test_pair_test_against_plain_encoding():
    codec = pieces.Codec(pieces.default_model())
    rng = np.random.default_rng(6)
    ids = sorted(codec.id.values())[:5000]
    for a, b in rng.choice(ids, (4000, 2)).tolist():
        left, right = codec.model.pieces[a], codec.model.pieces[b]
        assert codec.compatible(a, b) == (pieces.merged(list(left + right), codec.rank) == [left, right])


def test_long_text_is_cut_between_chunks(monkeypatch):
    codec = pieces.Codec(pieces.default_model())
    text = "ein langer text ohne ende " * 40
    whole = codec.encode(text)
    monkeypatch.setattr(pieces, "PART_CHARS", 37)
    assert codec.encode(text) == whole and codec.digests(text)[0] == len(whole)


def test_pipeline_stage_by_stage(spark, sf, docs, rows):
    """Each stage against brute force over whole rows, null and repeated ids among them."""
    sf_docs = spark.read.parquet(f"{sf}/documents.parquet")
    state = [tuple(r) for r in sf_docs.select(*corpus_pipeline.COLUMNS).collect()]
    state += [(5, state[0][1], "en", "src9", 1), (5, "wholly unique other words for an id that repeats", "en", "src9", 1), (None, "null id but toxic trash idiot loser trash idiot", "en", "src9", 1)]
    for name, stage in corpus_pipeline.STAGES:
        before = state
        result = stage(spark, spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long"), sf)
        state = [tuple(r) for r in result.collect()]
        if name != "pieces":
            assert result.columns == corpus_pipeline.COLUMNS
            assert not set(state) - set(before)
        texts = collections.Counter(r[1] for r in state)
        if name == "toxicity":
            clean = [r for r in before if "trash" not in (r[1] or "")]
            assert not any("null id but toxic" in (r[1] or "") for r in state)
            assert len(clean) - sum("trash" not in (r[1] or "") for r in state) <= 0.05 * len(clean)
        elif name == "exact_dedup":
            want = {}
            for r in before:
                key = re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")
                if key not in want or (r[0] is None, r[0] or 0) < (want[key] is None, want[key] or 0):
                    want[key] = r[0]
            assert sorted((re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), str(r[0])) for r in state) == sorted((k, str(v)) for k, v in want.items())
            assert texts["wholly unique other words for an id that repeats"] == 1
        elif name == "near_dedup":
            groups = brute_groups({k: r[1] for k, r in enumerate(before)})
            first = {}
            for k, r in enumerate(before):
                first[groups[k]] = min(first.get(groups[k], (True, 0)), (r[0] is None, r[0] or 0))
            want = collections.Counter((first[g][0], first[g][1]) for g in set(groups.values()))
            found = collections.Counter((r[0] is None, r[0] or 0) for r in state)
            assert not want - found  # every group's first document stays
            assert (found - want).total() <= 0.03 * len(before)  # and hardly another
        elif name == "mixing":
            sizes = [len((r[1] or "").split()) for r in before]
            targets = brute_targets(collections.Counter(), [(r[3], n) for r, n in zip(before, sizes, strict=True)])
            taken = collections.Counter()
            for r in state:
                taken[r[3]] += len((r[1] or "").split())
            largest = max(sizes)
            assert all(abs(taken[source] - target) <= 2 * largest for source, target in targets.items())
            copies = collections.Counter(state)
            assert all(n <= 3 * before.count(r) for r, n in copies.items())
            assert all(r in copies for r, n in zip(before, sizes, strict=True) if not n)
        else:
            assert len(state) == len(before)
            library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            want = collections.Counter((r[0], len(library.encode(r[1] or ""))) for r in before)
            found = result.select("doc_id", "n_tokens").collect()
            assert collections.Counter((r.doc_id, r.n_tokens) for r in found) == want
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_rows_of_files_keep_their_key(spark, sf, docs):
    """Rows of files are keyed by their place, the same in every scan; other rows are written with a key."""
    columns = ["doc_id", "text"]
    scanned = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    rows = common.keyed(scanned, columns, "rows")
    n = scanned.count()
    assert rows.columns == [*columns, "row"] and rows.select("row").distinct().count() == n
    again = common.keyed(spark.read.parquet(f"{sf}/documents.parquet"), columns, "rows").withColumnsRenamed({"doc_id": "id2", "text": "text2"})
    same = rows.join(again, "row").where(F.col("doc_id").eqNullSafe(F.col("id2")) & F.col("text").eqNullSafe(F.col("text2")))
    assert same.count() == n
    made = common.keyed(docs.where("doc_id IS NULL OR doc_id >= 0"), columns, "rows")
    assert made.select("row").distinct().count() == made.count() > 0


def test_pipeline_on_empty_tables(spark, empty_sf):
    assert corpus_pipeline.run(spark, empty_sf).count() == 0


#: The columns that the contracts name, with their types.
CONTRACT = {
    "op1_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op2_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op3_lm": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op4_pieces": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op5_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op6_topk": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op7_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op8_secrets": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op9_exact": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op10_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
}


def test_every_query_on_messy_and_empty_tables(spark, sf, empty_sf, rows):
    assert set(CONTRACT) == set(registry.queries())
    for name, query in registry.queries().items():
        result = query(spark, sf)
        kinds = dict(result.dtypes)
        assert {c: kinds.get(c) for c in CONTRACT[name]} == CONTRACT[name], name
        found = result.collect()
        if name == "op6_topk":
            assert {r.query_id for r in found} == {0, 50, 100, 250} and len(found) == 20
        else:
            assert collections.Counter(r.doc_id for r in found) == collections.Counter(r[0] for r in rows), name
        assert query(spark, empty_sf).collect() == [], name
