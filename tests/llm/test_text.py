"""Operators that score or read each text: toxicity, quality, language, secrets."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weft.llm import common, language, quality, registry, secrets, toxicity


def test_hash_of_a_word_depends_on_its_letters_alone():
    column = pa.array(["Ab c", None, "", "c  aB", "x" * 9000 + " ab"])
    for _, _, data, bounds in common.blocks(column):
        starts, ends, rows = common.find_words(data, bounds)
        found = common.hash_words(data, starts, ends)
        assert rows.tolist() == [0, 2, 2, 2, 4, 6]
        assert found[0] == found[3] == found[5] and found[1] == found[2] and found[4] not in found[:4]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-3, 3), max_size=14))
def test_segments_against_brute_force(values):
    """Recursive definition: the best segment (shortest of equals), then the same on either side."""

    def brute(a, b):
        best = max(((sum(values[i:j]), -(j - i), -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        i = -best[2]
        j = i - best[1]
        return [*brute(a, i), (i, j - 1, best[0]), *brute(j, b)]

    # ties between segments make the definition ambiguous; scores are made distinct
    values = [v + 0.001 * k * (-1) ** k for k, v in enumerate(values)]
    found = toxicity.maximal_segments(np.array(values, float))
    want = brute(0, len(values))
    assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in want]
    assert np.allclose([s for *_, s in found], [s for *_, s in want])


def test_toxicity_finds_passages(docs, labels, rows):
    model = toxicity.fit(docs, labels)
    found = {(r.id, r.n_words): r for r in toxicity.score(docs, model).collect()}
    assert toxicity.score(docs, model).count() == len(rows)
    assert all(0 <= r.score <= 1 for r in found.values())
    toxic = [r.score for r in found.values() if r.id is not None and r.id < 160 and r.id % 9 == 0 and r.id % 11]
    clean = [r.score for r in found.values() if r.id is not None and r.id < 160 and r.id % 9]
    assert np.mean(toxic) > 0.6 > 0.2 > np.mean(clean)
    assert found[200, 0].segments == [] and found[204, 60_000].score < 0.7


@pytest.mark.parametrize(("clean", "toxic"), [(1, 1), (2, 2), (3, 1), (12, 12)])
def test_toxicity_of_a_handful_of_labels(spark, clean, toxic):
    """However the ids fall into the calibration quarter, both classes teach and no score runs to an end."""
    for base in (0, 1000, 2000):
        texts = [(base + i, f"plain words of a good text number {i} " * 3) for i in range(clean)]
        texts += [(base + 500 + i, "idiot loser trash scum " * 6 + f"tail {i}") for i in range(toxic)]
        docs = spark.createDataFrame(texts, "doc_id long, text string")
        labels = spark.createDataFrame([(i, int("idiot" in t)) for i, t in texts], "doc_id long, toxic int")
        found = {r.id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
        assert all(1e-4 < v < 1 - 1e-4 for v in found.values())
        assert min(found[base + 500 + i] for i in range(toxic)) >= max(found[base + i] for i in range(clean))


def test_toxicity_of_one_class(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(8)], "doc_id long, text string")
    for flag, share in ((1, 9 / 10), (0, 1 / 10)):
        labels = spark.createDataFrame([(i, flag) for i in range(8)], "doc_id long, toxic int")
        assert {round(r.score, 9) for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()} == {share}


def test_toxicity_carries_rows(docs, labels, rows):
    found = toxicity.score(docs, toxicity.fit(docs, labels), ["doc_id", "text", "id", "source"])
    want = collections.Counter((r[0], r[1], r[3]) for r in rows)
    assert found.columns.count("id") == 2  # the operator's own and the carried one
    renamed = found.toDF(*[f"c{k}" for k in range(len(found.columns))]).collect()
    assert collections.Counter((r[5], r[6], r[8]) for r in renamed) == want


def test_documents_that_repeat_an_id_teach_once(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (1, 1)], "doc_id long, toxic int")
    found = common.labelled(docs, labels, "toxic", common.F.lit(True), 10, "t").collect()
    assert sorted(tuple(r) for r in found) == [(1, "text 0", 1), (2, "b", 0)]


@pytest.mark.parametrize("module", [toxicity, quality])
def test_nothing_to_learn_from(module, docs, no_labels, empty, rows):
    model = module.fit(docs, no_labels)
    assert module.score(docs, model).where("score between 0 and 1").count() == len(rows)
    assert module.score(empty, model).count() == 0
    assert module.fit(empty, no_labels) is not None


def test_quality_learns_the_junk(docs, labels, rows):
    model = quality.fit(docs, labels)
    found = quality.score(docs, model).collect()
    assert len(found) == len(rows)
    known = [r for r in found if r.id is not None and r.id < 160]
    right = sum((r.score >= 0.5) == (r.id % 11 != 0) for r in known)
    assert right >= 0.95 * len(known)


def test_passages_do_not_depend_on_neighbours():
    texts = ["", "  \n", "A b. c", "x " * 500, "", " ", "é|é|é", " lead and trail  ", "w" * 70]
    data, bounds = common.utf8(pa.array(texts))
    together, first = quality.passages(data, bounds)
    for k, text in enumerate(texts):
        alone, _ = quality.passages(*common.utf8(pa.array([text])))
        assert np.allclose(together[first[k] : first[k + 1]], alone)


def test_attention_against_plain_loops():
    """The forward pass bag by bag and passage by passage, and its derivatives against small steps."""
    rng = np.random.default_rng(3)
    n, f, h = 9, 6, 4
    w = {"encode": rng.normal(size=(f, h)), "encode0": rng.normal(size=h), "v": rng.normal(size=(h, h)), "u": rng.normal(size=(h, h)), "a": rng.normal(size=h), "c": rng.normal(size=h), "c0": np.array(0.3)}
    x, first, y = rng.normal(size=(n, f)), np.array([0, 3, 4, 9]), np.array([1.0, 0.0, 1.0])
    found = quality._forward(w, x, first)
    for bag, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        codes = [np.tanh(row @ w["encode"] + w["encode0"]) for row in x[a:b]]
        energy = [float((np.tanh(c @ w["v"]) / (1 + np.exp(-(c @ w["u"])))) @ w["a"]) for c in codes]
        weight = np.exp(energy) / np.exp(energy).sum()
        z = sum(k * c for k, c in zip(weight, codes, strict=True))
        assert np.allclose(found["a"][a:b], weight) and np.isclose(found["p"][bag], 1 / (1 + np.exp(-(z @ w["c"] + w["c0"]))))

    def loss(weights):
        p = quality._forward(weights, x, first)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    slopes = quality._slopes(w, x, first, y, found)
    for name, value in w.items():
        for place in np.ndindex(value.shape):
            step = np.zeros(value.shape)
            step[place] = 1e-6
            by_steps = (loss(w | {name: value + step}) - loss(w | {name: value - step})) / 2e-6
            assert np.isclose(slopes[name][place], by_steps, atol=1e-6)


def test_languages(docs, empty, rows):
    model = language.fit(docs)
    found = language.predict(docs, model).collect()
    assert len(found) == len(rows)
    assert {r.lang_pred for r in found if r.id in (200, 201, 202, 203)} == {"und"}
    known = [r for r in found if r.id is not None and r.id < 160 and r.id % 11]
    assert sum(r.lang_pred == ("en" if r.id % 2 else "de") for r in known) > 0.95 * len(known)
    nothing = language.fit(empty)
    assert {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"}


def test_letters_are_letters():
    for text, want in {"½": False, "²": False, "Ⅷ": False, "_1 2": False, "": False, "日": True, "a": True, "ª": True, "é": True, "٣": False}.items():
        assert language.has_letter(text) == want == any(c.isalpha() for c in text)


def test_language_against_a_plain_naive_bayes(spark):
    """Counts, probabilities and sums of every n-gram in plain loops."""
    teach = [("a", "Ein Satz, 1 2"), ("b", "une phrase été"), ("a", "noch ein Satz"), ("b", "x")]
    model = language.fit(spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(teach)], "doc_id long, text string, lang string"))

    def grams(text):
        """Cells of the runs of one to three characters, by the same hash, one character at a time."""
        letters = [ord(c) if c.isalpha() else 32 for c in text.lower() + "  "]
        out = []
        for k, c in enumerate(letters):
            after = [*letters[k + 1 :], 32, 32]
            if k + 1 == len(letters) or (c == 32 and after[0] == 32):
                continue
            one = c * 0x9E3779B1 % 2**32
            two = (one ^ after[0] * 0x85EBCA6B % 2**32) * 0xC2B2AE35 % 2**32
            three = (two ^ after[1] * 0x27D4EB2F % 2**32) * 0x165667B1 % 2**32
            out += [v >> 16 for v in (one, two, three) if v >> 16]
        return out

    counts = {k: collections.Counter(g for lang, t in teach if lang == k for g in grams(t)) for k in "ab"}
    total = {k: sum(c.values()) + language.SMOOTHING * (language.BUCKETS - 1) for k, c in counts.items()}
    for text in ("Ein Satz", "été!", "x", "Satz phrase 99", "zzz"):
        logs = [np.log(total[k] / sum(total.values())) + sum(np.log((counts[k][g] + language.SMOOTHING) / total[k]) for g in grams(text)) for k in "ab"]
        want = np.exp(np.array(logs) - max(logs))
        assert np.allclose(language.posteriors(model, [text])[0], want / want.sum())


def held_out(i, modulus, rest):
    return i is not None and zlib.crc32(str(i).encode()) % modulus == rest


@pytest.mark.parametrize(("name", "limit"), [("op1_toxicity", 0.7), ("op2_quality", 0.5)])
def test_scoring_queries(spark, sf, rows, labels, name, limit):
    """Every column of the queries: ids, folds, scores as the operator gives them, and the cut."""
    result = registry.queries()[name](spark, sf)
    assert result.dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    found = result.collect()
    assert collections.Counter(r.doc_id for r in found) == collections.Counter(r[0] for r in rows)
    assert all(r.held_out == held_out(r.doc_id, 3, 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= limit) for r in found)
    module = toxicity if name.startswith("op1") else quality
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    taught = labels.where(common.fold("doc_id", 3) != 1)  # labels of the held-out fold don't teach: without them all stays
    again = module.score(docs, module.fit(docs, taught)).collect()
    assert collections.Counter((r.id, round(r.score, 6)) for r in again) == collections.Counter((r.doc_id, round(r.score, 6)) for r in found)


def test_language_query(spark, sf, rows):
    result = registry.queries()["op10_language"](spark, sf)
    assert result.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    found = result.collect()
    assert collections.Counter(r.doc_id for r in found) == collections.Counter(r[0] for r in rows)
    blank = {r[0] for r in rows if not any(c.isalpha() for c in r[1] or "")}
    assert all(r.held_out == held_out(r.doc_id, 4, 2) and 0 <= r.score <= 1 for r in found)
    assert all((r.lang_pred == "und") == (r.doc_id in blank) and r.lang_pred in ("de", "en", "und") for r in found)


def test_secrets_query(spark, sf, rows):
    """Counts, hashes and spans of whole texts against the plain patterns."""
    result = registry.queries()["op8_secrets"](spark, sf)
    assert result.dtypes == [("doc_id", "bigint"), ("n_assign", "bigint"), ("n_access", "bigint"), ("n_hex", "bigint"), ("base_sha256", "string"), ("spans", "string")]
    found = collections.Counter(tuple(r)[:5] for r in result.collect())
    want = collections.Counter()
    for r in rows:
        text = r[1] or ""
        spans = [(m.start(), 0, "assign", m.end()) for m in BASE.finditer(text) if len(m[2]) >= 6]
        spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        kinds = [s[2] for s in spans]
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))
        want[r[0], kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(joined.encode()).hexdigest()] += 1
    assert found == want
    assert any(r.spans for r in result.collect())


BASE = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["token", "secret", "=", ":", " ", '"', "abc", "AKIA", "ABCDEFGH12345678", "0a" * 12, "api_key", "é", "."]), max_size=12))
def test_base_spans_against_the_plain_patterns(parts):
    text = "".join(parts)
    want = [(m.start(), "assign", m.end()) for m in BASE.finditer(text) if len(m[2]) >= 6]
    want += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    want += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    assert sorted(want) == sorted(s[:3] for s in secrets.base_spans(text))


def test_grammar_accepts_its_own_kind():
    hexes = [hashlib.sha1(str(i).encode()).hexdigest().translate(secrets._CLASSES) for i in range(300)]
    automaton = secrets.Automaton(hexes)
    assert len(automaton.states) < 60
    fresh = hashlib.sha1(b"fresh").hexdigest().translate(secrets._CLASSES)
    assert automaton.score(fresh) > automaton.score("g" * 40) + 20


def test_secrets_of_messy_rows(docs, empty, rows):
    model = secrets.fit(docs)
    found = secrets.scan(docs, model).collect()
    assert len(found) == len(rows)
    spans = next(r.spans for r in found if r.id == 207)
    assert [(s.kind, s.start, s.end) for s in spans] == [("assign", 0, 41), ("hex", 9, 41)]
    assert all(s.score is not None for s in spans)  # base credentials are scored like any candidate
    assert all(not r.spans for r in found if r.id in (200, 201, 202, 203))
    assert secrets.scan(empty, secrets.fit(empty)).count() == 0


@pytest.mark.parametrize("n, rows", [(60, secrets.FIT_ROWS), (6000, 4000)])
def test_bare_tokens_are_reported(spark, n, rows):
    """On a table that is its own sample, and on one larger than the sample with many ordinary candidates."""
    rng = np.random.default_rng(n)
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    parts = ["heit", "keit", "an", "ber", "sch", "Der", "ung", "ein", "lich", "the", "ist", "re"]
    texts, want = [], {}
    for i in range(n):
        lead = " ".join("".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(30)) + f" in {1900 + i % 120}. "
        token = "".join(rng.choice(letters, 24))
        long = ["".join(rng.choice(parts, 7)), "www." + "".join(rng.choice(parts, 4)) + ".example/" + "".join(rng.choice(parts, 2)), str(rng.integers(10**15, 10**16))]
        said = f'token = "{token}"' if i % 4 == 0 else token if i % 4 == 1 else long[i % 3]
        texts.append((i, f"{lead}{said} end"))
        want[i] = [(len(lead), len(lead) + 24)] if i % 4 == 1 else []
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = {r.id: [(s.start, s.end) for s in r.spans if s.kind == secrets.ADDED] for r in secrets.scan(docs, secrets.fit(docs, rows)).collect()}
    bare = [i for i in want if want[i]]
    assert sum(found[i] == want[i] for i in bare) >= 0.95 * len(bare)
    assert all(not found[i] for i in want if not want[i])


def test_candidates_are_what_base_spans_leave():
    text = "x token=abcdef12; AAAABBBBCCCCDDDD1111" + "0123456789abcdef01234567" + "ZZZZYYYYXXXXWWWWVVVV tiny"
    spans = secrets.base_spans(text)
    assert [text[a:b] for a, b, _ in secrets.candidates(text, spans)] == ["AAAABBBBCCCCDDDD", "ZZZZYYYYXXXXWWWWVVVV"]
    assert "tiny" in [text[a:b] for a, b, _ in secrets.candidates(text, spans, True)]


def test_every_format_is_learnt_from(monkeypatch):
    from collections import Counter

    monkeypatch.setattr(secrets, "FIT_DRAWS", 40)
    counts = Counter({f"{c}0": 50 for c in "abcdefgh"} | {"z": 1, "y": 20})
    drawn = Counter(secrets._drawn(counts, 10))
    assert set(drawn) == set(counts) and drawn.total() <= 40 and drawn["z"] == 1 and len({drawn[f"{c}0"] for c in "abcdefgh"}) == 1
    assert Counter(secrets._drawn(Counter(a=3, b=1), 10)) == Counter(a=3, b=1)
