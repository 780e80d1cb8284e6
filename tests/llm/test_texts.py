"""Language profiles, personal data, fingerprints and quality rules."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.common import awkward, key, none, prose
from tidemark.llm import fingerprint, hashing, langid, pii, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ------------------------------------------------------------------ language


def plain_grams(text):
    """1- to 3-grams of letters of padded words, by plain counting."""
    counts = Counter()
    words = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text).split()
    for word in words:
        padded = f"_{word}_"
        for n in (1, 2, 3):
            for k in range(len(padded) - n + 1):
                gram = padded[k : k + n]
                if n == 1 and gram == "_":
                    continue
                counts[gram] += 1
    return counts


def test_ngrams():
    text = "Ab, abc é; x1y"
    codes = langid.ngram_codes(langid.padded_letters(text))
    counts = plain_grams(text)
    # marks between words are shared, so boundary bigrams and trigrams are as many
    assert sorted(np.unique(codes, return_counts=True)[1]) == sorted(counts.values())


def test_prediction_matches_plain_distance():
    profiles = langid.Profiles({"a": langid.top_ngrams(langid.ngram_codes(langid.padded_letters(prose(1, 200))), 50).tolist(), "b": langid.top_ngrams(langid.ngram_codes(langid.padded_letters("xyz zyx xxz " * 40)), 50).tolist()}, 50)
    for text in (prose(3, 30), "xyz xyz the zyx", "é"):
        own = langid.top_ngrams(langid.ngram_codes(langid.padded_letters(text)), 50).tolist()
        ranked = {lang: [int(profiles.grams[k]) for k in np.argsort(np.where(profiles.ranks[i] < 0, 10**6, profiles.ranks[i])) if profiles.ranks[i][k] >= 0] for i, lang in enumerate(profiles.languages)}
        distance = {lang: sum(abs(r.index(g) - k) if g in r else 50 for k, g in enumerate(own)) for lang, r in ranked.items()}
        best = min(distance, key=lambda lang: (distance[lang], lang))
        assert profiles.predict(text) == (best, pytest.approx(1 - distance[best] / (50 * len(own))))


def test_held_out_accuracy(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    found = langid.identify(docs, langid.fit_profiles(docs)).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = found[found.held_out]
    assert (found.held_out == found.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert (held.lang_pred == held.lang).mean() > 0.97 and found.score.between(0, 1).all()


def test_profiles_match_plain_counts(spark):
    """Profiles rank the n-grams of all learned documents, counted plainly."""

    def code(gram):
        out = 0
        for c in gram:
            out = out << 20 | (0 if c == "_" else ord(c))
        return out | {1: 0, 2: 1 << 60, 3: 1 << 61}[len(gram)]

    rows = [(k, prose(k, 20) if k % 2 else "xyz zyx " * (k % 5 + 1), ["b", "a"][k % 2] if k % 7 else None) for k in range(60)] + [(None, "never learned", "a"), (77, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    profiles = langid.fit_profiles(docs, limit=50)
    for row, lang in enumerate(profiles.languages):
        counts = Counter()
        for doc_id, text, own in rows:
            if own == lang and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5:
                counts.update(plain_grams(text or ""))
        expected = sorted((-n, code(g)) for g, n in counts.items())[:50]
        found = sorted((rank, gram) for gram, rank in zip(profiles.grams.tolist(), profiles.ranks[row].tolist()) if rank >= 0)
        assert [g for _, g in found] == [g for _, g in expected]


def test_language_edges(spark):
    docs, rows = awkward(spark)
    found = langid.identify(docs, langid.fit_profiles(docs)).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    assert {by_id[i].lang_pred for i in (3, 4, 5)} == {"und"} and by_id[6].lang_pred != "und"
    assert not by_id[None].held_out
    kept = langid.keep_identified(docs, langid.fit_profiles(docs))
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()}.isdisjoint({3, 4, 5}) and kept.where("lang is null").count() == 0
    assert langid.identify(none(spark), langid.fit_profiles(none(spark))).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.Profiles({}, 10)).collect()} == {"und"}


# -------------------------------------------------------------- personal data


def plain_spans(text):
    spans = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(digits[::-1])) % 10 == 0:
            spans.append((m.start(), m.end(), 2))
    spans += [(m.start(), m.end(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(spans, key=lambda s: (s[0], s[2]))


def test_base_spans():
    rng = random.Random(8)
    pool = ["@", "a", "B", ".", "_", "-", "+", "%", "é", "1", "2", "25", "4", " ", "(", ")", "1.2.3.4", "a@b.c", "4111 1111 1111 1111", "+1 555", "٣"]
    for _ in range(20_000):
        text = "".join(rng.choices(pool, k=rng.randrange(16)))
        assert pii.base_spans(text) == plain_spans(text)
    assert pii.base_spans("a" * 200_000 + "@") == [] and pii.base_spans("1" * 100_000 + ".") == []


@pytest.fixture(scope="module")
def net():
    return pii.train([prose(k, 120) for k in range(40)])


def test_gradients():
    rng = np.random.default_rng(0)
    own = pii.Network.fresh(rng)
    own.weights = {k: v.astype(np.float64) for k, v in own.weights.items()}
    chars, tags = pii.training_windows([], 3, rng)
    _, grads = own.gradients(chars, tags)
    for name in ("out", "rec_f", "in_b", "move", "bias_b"):
        at = tuple(rng.integers(0, n) for n in own.weights[name].shape)
        values = []
        for shift in (1e-3, -2e-3):
            own.weights[name][at] += shift
            values.append(own.gradients(chars, tags)[0])
        own.weights[name][at] += 1e-3
        assert grads[name][at] == pytest.approx((values[0] - values[1]) / 2e-3, rel=0.05, abs=0.02)


def test_learned_spans(net):
    chars, tags = pii.training_windows([prose(k, 120) for k in range(50, 70)], 800, np.random.default_rng(77))
    found = pii.viterbi(net.scores(chars), net.weights["move"] + pii.ALLOWED)
    assert (found == tags)[tags > 0].mean() > 0.93 and (found > 0)[tags == 0].mean() < 0.02
    text = prose(5, 30) + " reach me at (743) 555-3824 or kim.lee @ mail.example.com. " + prose(6, 60)
    (base, every), = pii.all_spans([text], net)
    assert base == [] and {text[a:b] for a, b, _ in every} >= {"(743) 555-3824"}
    assert "555" not in pii.redacted(text, every)


def test_windows_agree(net):
    """A span is found alike wherever the window grid falls."""
    for shift in range(0, 80, 7):
        text = "x" * shift + " call 743-555-3824 now " + "y" * 100
        (_, every), = pii.all_spans([text], net)
        assert [(text[a:b], k) for a, b, k in every] == [("743-555-3824", 3)]


class Plain:
    """A network that sees a character and the one before it: stretches of
    digits are phone numbers."""

    weights = {"move": np.zeros((pii.TAGS, pii.TAGS), np.float32)}

    def scores(self, chars):
        inside = np.isin(chars, pii.symbols("0123456789")).T
        out = np.zeros((*inside.shape, pii.TAGS), np.float32)
        begins = inside & ~np.concatenate((np.zeros_like(inside[:1]), inside[:-1]))
        out[..., 8] = np.where(inside, 1, -1)
        out[..., 7] = np.where(begins, 3, -3)
        return out


def test_seams_lose_nothing(monkeypatch):
    """At every offset, spans shorter and longer than windows are found as in
    one window that holds the whole text."""
    monkeypatch.setattr(pii, "_valid", lambda value, kind: True)
    texts = ["x" * offset + " " + "1" * length + " tail" * 40 for offset in range(0, 2 * pii.STRIDE) for length in (10, 38, 41, 57, 79, 80, 81, 120, 159, 160, 161, 250, 700)]
    found = pii.learned_spans(texts, Plain())
    monkeypatch.setattr(pii, "WINDOW", max(map(len, texts)))
    assert found == pii.learned_spans(texts, Plain(), 64)
    assert all(len(x) == 1 for x in found)


def test_long_addresses(net):
    """Loose addresses are found alike at all offsets, whatever their length."""
    for value in ("kim.lee @ mail.example.com", "kimberley.alexandra @ mail.department . example.com"):
        there = sum(any(text[a:b] == value for a, b, _ in every) for shift in range(0, 80, 4) for text in ["word " * (shift // 4 + 20) + value + " and more words that follow it" * 4] for _, every in pii.all_spans([text], net))
        assert there in (0, 20) or there >= 18


def test_viterbi_is_best():
    """Against every sequence of tags of a short window."""
    import itertools

    rng = np.random.default_rng(5)
    for _ in range(20):
        scores, move = rng.standard_normal((4, 1, pii.TAGS)).astype(np.float32) * 2, (rng.standard_normal((pii.TAGS, pii.TAGS)) + pii.ALLOWED).astype(np.float32)
        found = pii.viterbi(scores, move)[0]
        starts = [t for t in range(pii.TAGS) if t == 0 or t % 2 == 1]
        best = max((t for t in itertools.product(range(pii.TAGS), repeat=4) if t[0] in starts), key=lambda t: sum(scores[i, 0, x] for i, x in enumerate(t)) + sum(move[a, b] for a, b in zip(t, t[1:])))
        assert tuple(found) == best


def test_reconcile():
    assert pii.reconcile([(1.0, (0, 5, 0)), (3.0, (4, 8, 1)), (1.5, (8, 9, 2)), (0.5, (8, 9, 2))]) == [(4, 8, 1), (8, 9, 2)]
    assert pii.reconcile([]) == []


def test_personal_data_edges(spark, net):
    docs, rows = awkward(spark, [(20, "a@b.co +1 (743) 555-3824 4111 1111 1111 1111 10.0.0.1 end")])
    found = sorted((tuple(r)[:6] for r in pii.find_personal_data(docs, net).collect()), key=key)
    expected = []
    for r in rows:
        base = plain_spans(r[1] or "")
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in base)
        expected.append((r[0], *(sum(k == kind for *_, k in base) for kind in range(4)), hashlib.sha256(joined.encode()).hexdigest()))
    assert found == sorted(expected, key=key)
    clean = pii.redact(docs, net)
    assert clean.schema == docs.schema and clean.where("doc_id = 20").first().text == "[EMAIL] [PHONE] [CARD] [IP] end"
    assert clean.where("text is null").count() == 2
    assert pii.train_on(none(spark)) is not None and pii.find_personal_data(none(spark), net).count() == 0


# --------------------------------------------------------------- fingerprints


def five(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_word_hashes():
    import pyarrow as pa

    texts = ["The cat  sat", "cat", None, "", "\tsat\x0bTHE cat ", "é É 漢 x", "a b c d e f g"]
    found = hashing.words(pa.array(texts))
    words = [w.lower() if w.isascii() else w for t in texts for w in WORD.findall(t or "")]
    assert len({*zip(words, found.hashes.tolist())}) == len({*words}) == len({*found.hashes.tolist()})
    assert np.diff(found.bounds).tolist() == [len(WORD.findall(t or "")) for t in texts]
    assert [len(x) for x in hashing.distinct_shingles(pa.array(texts), 3)] == [1, 1, 0, 0, 1, 2, 5]
    again = pa.array(["x", *texts]).slice(1)
    assert hashing.words(again).hashes.tolist() == found.hashes.tolist()


def test_densification():
    rng = np.random.default_rng(3)
    hashes = np.sort(hashing.mix(rng.integers(0, 2**62, 900).astype(np.uint64)))
    minima = fingerprint.bin_minima(hashes)
    for b in range(fingerprint.BINS):
        own = hashes[hashes >> np.uint64(56) == b]
        assert minima[b] == own[0] if len(own) else minima[b] in hashes
    assert len(set(fingerprint.bin_minima(hashes[:1]).tolist())) == 1


@pytest.mark.parametrize("bucket_rows", [2, 1024])
def test_neighbours(spark, bucket_rows):
    extra = [(100 + k, prose(k // 2, 120) + prose(k, 40)) for k in range(20)]
    extra += [(one_id, prose(k, 50)) for k in range(30) for one_id in (None, 50)] + [(51, prose(3, 60))] * 25
    docs, rows = awkward(spark, extra)
    from pyspark.sql import functions as F

    marks = {r.text: r.mark for r in docs.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, marks[r[1]]), reverse=True)
    found = fingerprint.compare_neighbours(docs, bucket_rows).collect()
    assert len(found) == len(rows)
    expected = Counter()
    likeness = {}
    for k, r in enumerate(order):
        text, after = r[1] or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 3
        new = text[: len(text) - cut] + after[:cut]
        digest = hashlib.sha256(new.encode()).hexdigest()
        expected[r[0], len(text), digest] += 1
        a, b, c = five(text), five(new), five(after)
        likeness[r[0], len(text), digest] = [len(a & x) / len(a | x) if a or x else 1.0 for x in (b, c)]
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in found) == expected
    errors = [abs(v - w) for r in found for v, w in zip((r.near_edited, r.near_next), likeness[r.doc_id, r.n_chars, r.edited_sha256])]
    assert max(errors) < 0.2 and sum(errors) / len(errors) < 0.03
    assert fingerprint.compare_neighbours(none(spark)).count() == 0


def test_one_id_spreads(spark):
    """One doc_id on every row, or none, still is dealt to many buckets."""
    for doc_id in (None, 7):
        docs = spark.createDataFrame([(doc_id, prose(k, 20)) for k in range(400)], "doc_id bigint, text string")
        found = {r.bucket: r["count"] for r in fingerprint._following(docs, 16).where("extra = 0").groupBy("bucket").count().collect()}
        assert len(found) > 12 and max(found.values()) < 100 and sum(found.values()) == 400


def test_only_document(spark):
    docs = spark.createDataFrame([(1, "one two three four five six")], "doc_id bigint, text string")
    row = fingerprint.compare_neighbours(docs).first()
    assert row.near_next == 1.0 and row.n_chars == 27


# -------------------------------------------------------------------- quality


def plain_counts(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts(spark):
    extra = [(30, "a b c a b c a b"), (31, "x\nx\n \nx\ny"), (32, "# * | <a>"), (33, prose(4, 40) * 3), (34, " ".join(f"w{k % 120}" for k in range(400)))]
    docs, rows = awkward(spark, extra)
    found = sorted((tuple(r)[:6] for r in quality.judge(docs).collect()), key=key)
    assert found == sorted(((r[0], *plain_counts(r[1] or "")) for r in rows), key=key)
    assert quality.judge(none(spark)).count() == 0


def test_inverse(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    half = rng.standard_normal((6, 9))
    matrix = half @ half.T
    row = spark.createDataFrame([([float(x) for x in matrix.ravel()],)], "m array<double>").select(quality.inverse(F.col("m"), 6)).first()[0]
    assert np.allclose(np.array(row.cells).reshape(6, 6), np.linalg.inv(matrix))
    assert row.log_det == pytest.approx(np.linalg.slogdet(matrix)[1])


def test_outliers(spark):
    """Symbol-ridden documents go; clean ones stay, though a third is junk."""
    rows = [(k, prose(k, 60 + k % 90), "en", "s", None, 0, "", "", 0, "") for k in range(300)]
    rows += [(1000 + k, " | ".join(prose(k, 70).split()), "en", "s", None, 0, "", "", 0, "") for k in range(90)]
    from tests.llm.common import DOCUMENTS

    found = quality.judge(spark.createDataFrame(rows, DOCUMENTS)).collect()
    assert all(r.kept for r in found if r.doc_id < 1000)
    assert not any(r.kept for r in found if r.doc_id >= 1000)
    assert abs(quality.chi_square(0.95, 6) - 12.592) < 0.05


def test_outliers_without_symbols(spark):
    """Texts all in capitals, and of one-letter words, go as well."""
    rows = [(k, prose(k, 60 + k % 90), "en", "s") for k in range(300)]
    rows += [(1000, prose(7, 80).upper(), "en", "s"), (1001, " ".join(x[0] for x in prose(8, 200).split()), "en", "s")]
    found = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert all(found[k].kept for k in range(300))
    assert not found[1000].kept and not found[1001].kept and found[1000].n_symbols == 0


def plain_mcd(x):
    """Centre and precision by numpy, from the same three starts."""
    floors, p = np.array(list(quality.FLOORS.values())), x.shape[1]

    def floored(c):
        return c + np.diag(np.maximum(floors**2 - np.diag(c), 0))

    def median(values):
        steps = np.sort(np.floor(values * 16 * quality.STEPS_A_UNIT), axis=0)
        return (steps[int(np.ceil(len(values) / 2)) - 1] + 0.5) / (16 * quality.STEPS_A_UNIT)

    def steps(center, precision):
        d = np.einsum("ni,ij,nj->n", x - center, precision, x - center)
        return np.floor(np.log(d + 1e-9) * quality.STEPS_A_UNIT)

    middle = median(x)
    scale = np.maximum(1.4826 * median(np.abs(x - middle)), floors)
    z = (x - middle) / scale
    t, u = np.tanh(z), z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    ends = []
    for scatter in (np.eye(p), np.cov(t.T, bias=True) / 0.394, u.T @ u / len(u) * p):
        center, cov, last = middle, floored(scatter * np.outer(scale, scale)), np.inf
        for _ in range(quality.MOST_STEPS):
            at = steps(center, np.linalg.inv(cov))
            own = x[at <= np.sort(at)[int(np.ceil(quality.HELD * len(x))) - 1]]
            new = own.mean(axis=0), floored(np.cov(own.T, bias=True))
            now = np.linalg.slogdet(new[1])[1]
            if now >= last - 1e-6:
                break
            (center, cov), last = new, now
        ends.append((round(last, 6), len(ends), center, cov))
    _, _, center, cov = min(ends, key=lambda e: e[:2])
    raw = floored(cov * quality.concentration(quality.HELD, p))
    own = x[steps(center, np.linalg.inv(raw)) <= np.floor(np.log(quality.chi_square(quality.REWEIGHT, p)) * quality.STEPS_A_UNIT)]
    return own.mean(axis=0), np.linalg.inv(floored(np.cov(own.T, bias=True) * quality.concentration(quality.REWEIGHT, p)))


@pytest.mark.parametrize("limit", [24_000_000, 0])
def test_estimates_match_numpy(spark, monkeypatch, limit):
    """Groups, centres, precisions and verdicts are those of numpy."""
    from tidemark.llm import storage

    monkeypatch.setattr(quality, "fits", lambda df, items=0: storage.fits(df, limit, items) if limit else False)
    rng = random.Random(3)
    rows = []
    for k in range(900):
        words = prose(k, rng.randrange(55, 200)).split()
        if k % 5 == 0:
            words = [w + " |" if rng.random() < 0.2 else w.upper() if rng.random() < 0.3 else w for w in words]
        rows.append((k, " ".join(words), ["en", "fr", None][k % 7 % 3], ["a", "b", "c", None][k % 11 % 4] if k % 3 else f"rare{k % 40}"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    stats = quality.with_groups(quality.vector(quality.base_statistics(docs)), 60).toPandas()
    assert stats["group"].nunique() > 4
    judged = {r.doc_id: r for r in quality.judge(docs, least_group=60).collect()}
    cut = quality.chi_square(1 - quality.REJECT, 6)
    for _, own in stats[~stats.base_failed].groupby("group"):
        x = own[list(quality.STATISTICS)].to_numpy()
        center, precision = plain_mcd(x)
        away = np.einsum("ni,ij,nj->n", x - center, precision, x - center)
        assert np.allclose([judged[i].distance for i in own.doc_id], away, rtol=1e-4)
        assert [judged[i].kept for i in own.doc_id] == list(away <= cut)
    small = stats.groupby(["lang", "source"], dropna=False).doc_id.transform("size") < 60
    assert stats[small].group.nunique() < 4 and not set(stats[small].group.dropna()) & set(stats[~small].group)
