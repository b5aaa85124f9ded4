import math
import random
from collections import Counter

import numpy as np
import pytest

from lexiloom.llm import quality_rules, quality_score, textstats
from tests.llm.conftest import SCHEMA, worded


def brute(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    inside = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_counts_equal_brute_force(odd):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "b", " ", " ", "\n", "#", "é", "\x0b", "\x1c", "😀"]) for _ in range(rng.randint(0, 200))) for _ in range(500)]
    texts += [" ".join(rng.choice("ab") for _ in range(300)), worded(1, 9000) + " " + worded(1, 5000)]
    assert [textstats.counts(x)[:5] for x in texts] == [brute(x) for x in texts]


def test_windows_over_many_words_are_exact(monkeypatch):
    rng = random.Random(3)
    words = [str(rng.randrange(20_000)).encode() for _ in range(30_000)]
    words += words[100:140]
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    inside = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
    assert textstats.repeated_words(words) == (len(inside), len(set(words)))


@pytest.mark.parametrize("n,k,p", [(10, 0, 0.1), (50, 3, 0.05), (400, 2, 0.02), (1000, 30, 0.02), (5, 5, 0.3)])
def test_binomial_tail(n, k, p):
    assert quality_rules.binomial_below(k, n, p) == pytest.approx(sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)), rel=1e-9)


def labelled(spark, n=3000):
    rng = random.Random(5)
    docs, labels = [], []
    for k in range(n):
        bad = k % 6 == 0
        text = worded(k, 60)
        docs.append((k, text.replace(" ", "### ") if bad else text, ["en", "de", None][k % 3], "s", len(text)))
        if rng.random() < 0.8:
            labels.append((k, 0 if bad else 1, 0))
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels + [(None, 1, 0), (3, None, 0), (10**9, 1, 0)], "doc_id long, quality int, toxic int")


def test_cutoffs_catch_bad_and_keep_good(spark):
    docs, labels = labelled(spark)
    rows = quality_rules.judged(docs, labels).collect()
    assert all(r.kept == (r.doc_id % 6 != 0) for r in rows if not r.base_failed) and not any(r.base_failed for r in rows)
    # Without enough labels nothing is rejected but by the base rules.
    assert all(r.kept for r in quality_rules.judged(docs, labels.limit(50)).collect())


def test_chosen_cutoff_obeys_the_bound():
    import pandas as pd

    hist = pd.DataFrame({"bin": [0, 20, 40], "good": [1000, 30, 2], "bad": [0, 100, 100]})
    assert quality_rules.chosen_cutoff(hist, 0.02, 0.01) > quality_rules.CUTOFFS[19]  # the 32 of 1,032 are too many
    assert quality_rules.chosen_cutoff(hist, 0.10, 0.01) <= quality_rules.CUTOFFS[19]
    assert quality_rules.chosen_cutoff(hist, 0.0001, 0.01) == math.inf


def test_classifier_tells_held_out_documents(spark):
    docs, labels = labelled(spark)
    rows = quality_score.scored(docs, labels).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {k for k in range(3000) if __import__("zlib").crc32(str(k).encode()) % 5 == 0}
    assert np.mean([(r.score >= 0.3) == (r.doc_id % 6 != 0) for r in held]) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


@pytest.mark.parametrize("added", [64, 1])
def test_scores_equal_a_direct_ridge_solve_and_isotonic_map(spark, added, monkeypatch):
    """All by numpy in one place: statistics, features, ridge, and the isotonic map by the min-max formula."""
    import zlib

    import pandas as pd

    monkeypatch.setattr(quality_score, "ADDED", added)
    rng = random.Random(23)
    docs = [(k, worded(k, rng.randint(1, 80)) + "### " * rng.randint(0, 9), "en", "s", 0) for k in range(400)]
    labels = [(k, int(t.count("#") < 12 if rng.random() < 0.9 else rng.random() < 0.5), 0) for k, t, *_ in docs if rng.random() < 0.8]
    found = {r.doc_id: r.score for r in quality_score.scored(spark.createDataFrame(docs, SCHEMA).repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}

    frame = pd.DataFrame([textstats.counts(t) for _, t, *_ in docs], columns=quality_score.STATISTICS, index=[k for k, *_ in docs])
    x = quality_score.inputs(frame)
    model = quality_score.Model(x.mean(0), x.std(0))
    z = pd.DataFrame(model.features(frame), index=frame.index)
    fold = {k: zlib.crc32(str(k).encode()) % 5 for k, *_ in docs}
    learn, calm = ([(k, y) for k, y, _ in labels if fold[k] in some] for some in ((2, 3, 4), (1,)))
    a, y = z.loc[[k for k, _ in learn]].to_numpy(), np.array([y for _, y in learn], dtype=float)
    solution = np.linalg.solve(a.T @ a / len(y) + 1e-3 / quality_score.FEATURES * np.eye(a.shape[1]), a.T @ y / len(y))
    raw = z.to_numpy() @ solution
    at = dict(zip(frame.index, raw, strict=True))
    bins = sorted({(b := int(min(max((at[k] + 0.5) / 2 * 2000, 0), 1999))): None for k, _ in calm})
    mean = {b: [y for k, y in calm if int(min(max((at[k] + 0.5) / 2 * 2000, 0), 1999)) == b] for b in bins}
    flat = [sum(mean[b]) / len(mean[b]) for b in bins]
    w = [len(mean[b]) for b in bins]
    average = lambda i, j: sum(f * n for f, n in zip(flat[i : j + 1], w[i : j + 1], strict=True)) / sum(w[i : j + 1])
    rising = [max(min(average(i, j) for j in range(k, len(bins))) for i in range(k + 1)) for k in range(len(bins))]
    told = np.interp(raw, [-0.5 + (b + 0.5) * 2 / 2000 for b in bins], rising)
    assert max(abs(found[k] - v) for k, v in zip(frame.index, told, strict=True)) < 1e-6


def test_verdicts_equal_plain_enumeration(spark):
    """Cutoffs by trying all of them with exact fractions, for each stratum; null and empty strata are apart."""
    from fractions import Fraction

    rng = random.Random(29)
    rows, labels = [], []
    for k in range(5000):
        lang = ["en", "", None][k % 3]
        bad = rng.random() < (0.15 if lang == "en" else 0.3)
        text = worded(k, 40).split()
        for _ in range(rng.randint(6, 30) if bad else rng.choice([0, 0, 0, 0, 0, 0, 0, 1, 2])):
            text[rng.randrange(40)] += "#" if lang is not None else "|*"
        rows.append((k, " ".join(text), lang, "s", 0))
        labels.append((k, int(not bad), 0))
    found = {r.doc_id: r.kept for r in quality_rules.judged(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    stats = {k: dict(zip(textstats.COUNTS, textstats.counts(t), strict=True)) for k, t, *_ in rows}
    good, cut = dict((k, y) for k, y, _ in labels), {}
    below = lambda k, n, p: sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
    for lang in ("en", "", None):
        own = [k for k, _, x, *_ in rows if x == lang]
        for rule, (over, under) in quality_rules.RULES.items():
            value = {k: stats[k][over] / stats[k][under] if stats[k][under] else 0.0 for k in own}
            n, bad_n = sum(good[k] for k in own), sum(1 - good[k] for k in own)
            gains = {}
            for c in sorted(quality_rules.CUTOFFS, reverse=True):
                wrong = sum(good[k] for k in own if value[k] >= c)
                if below(wrong, n, Fraction(quality_rules.LIMIT * quality_rules.SHARES[rule]).limit_denominator(10_000)) > Fraction(5, 100) / 9:
                    break
                gains[c] = Fraction(sum(1 - good[k] for k in own if value[k] >= c), bad_n) - Fraction(wrong, n)
            best = [c for c, g in gains.items() if g == max(gains.values()) > 0]
            cut[lang, rule] = best[len(best) // 2] if best else math.inf
    assert sum(c < math.inf for c in cut.values()) >= 2
    for k, _, lang, *_ in rows:
        passes = all((stats[k][a] / stats[k][b] if stats[k][b] else 0.0) < cut[lang, rule] for rule, (a, b) in quality_rules.RULES.items())
        base = stats[k]["n_words"] < 10 or 100 * stats[k]["n_repeat_words"] > 20 * stats[k]["n_words"]
        assert found[k] == (passes and not base)


def test_isotonic_is_the_nearest_rising_sequence():
    assert quality_score.isotonic(np.array([1.0, 3, 2, 2, 5, 4]), np.ones(6)).tolist() == pytest.approx([1, 7 / 3, 7 / 3, 7 / 3, 4.5, 4.5])


def test_odd_rows(spark, odd, none, clashing):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int")
    empty = labels.limit(0)
    for docs in (odd, clashing):
        for told in (labels, empty):
            assert quality_rules.judged(docs, told).count() == odd.count()
            scores = quality_score.scored(docs, told).collect()
            assert len(scores) == odd.count() and all(0 <= r.score <= 1 for r in scores)
    assert quality_rules.judged(none, labels).count() == 0 and quality_score.scored(none, labels).count() == 0
    judged = quality_rules.judged(odd, labels)
    assert all(r.base_failed and not r.kept for r in judged.collect() if r.doc_id in (1, 2, 3))
