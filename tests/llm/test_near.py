import hashlib
import random
from collections import Counter, defaultdict

import pytest

from lexiloom.llm import ngram_join, spotsigs
from lexiloom.llm.components import components, grouped
from lexiloom.operators import ordering
from tests.llm.conftest import SCHEMA, worded


def near_docs():
    """Groups of copies and of near copies with growing edits, a passage that many share, and loners."""
    rng, rows = random.Random(8), []
    for group in range(25):
        words = worded(group, 80 + 10 * (group % 7)).split()
        for copy in range(1 + group % 9):
            new = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4])):
                new[rng.randrange(len(new))] = f"w{rng.randrange(10**6)}"
            rows.append(" ".join(new))
    passage = worded(777, 60)
    rows += [worded(1000 + k, 30) + " " + passage for k in range(60)] + [worded(2000 + k, 50) for k in range(40)] + ["a b c", "a b c", "a b", "", None]
    rng.shuffle(rows)
    return [(k, t, "en", "s", 0) for k, t in enumerate(rows)]


def brute(rows, similarity=0.8):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        if w:
            sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    parent, links = {i: i for i, *_ in rows}, Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (root(i), links[i]) for i, *_ in rows}


@pytest.mark.parametrize("cut", [{}, {"block": 250}, {"work": 2000}])
def test_links_and_classes_equal_brute_force(spark, cut):
    rows = near_docs()
    found = ngram_join.linked(spark.createDataFrame(rows, SCHEMA), **cut).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in found} == brute(rows)


def test_one_document_of_each_class_stays(spark):
    rows = near_docs()
    docs = spark.createDataFrame(rows + rows[:40], SCHEMA)
    assert sorted(r.doc_id for r in ngram_join.one_of_each(docs).collect()) == sorted({c for c, _ in brute(rows).values()})
    assert ngram_join.one_of_each(docs).columns == docs.columns


def test_one_document_stays_where_ids_are_null_or_repeated(spark):
    def near(seed):
        words = worded(seed, 100).split()
        return [" ".join(words), " ".join([*words, "one"]), " ".join(["two", *words])]

    rows = [(i, t, "en", "s", 0) for ids, texts in (((None, None, None), near(1)), ((5, 5, 9), near(2)), ((None, 7, 7), near(3))) for i, t in zip(ids, texts, strict=True)]
    rows += [(None, worded(4, 60), "en", "s", 0), (5, worded(5, 60), "en", "s", 0)] + rows[:1]
    stay = ngram_join.one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()
    texts = [{r[1] for r in rows[k : k + 3]} for k in (0, 3, 6)]
    assert [sorted((r.doc_id or -1) for r in stay if r.text in x) for x in texts] == [[-1], [5], [7]]
    assert sorted((r.doc_id or -1) for r in stay) == [-1, -1, 5, 5, 7]


def test_prefixes_are_shortened_until_the_recall_is_reached():
    for n in (1, 5, 9, 20, 64, 500):
        lowest = ngram_join.weakest(n)
        assert 0.8 <= lowest <= 1
        for recall in (0.9, 0.9998, 0.9999999):
            times = ngram_join.shortening(n, recall=recall)
            assert ngram_join.expected_recall(times, lowest) >= recall
            assert times == 0 or ngram_join.expected_recall(times - 1, lowest) < recall
    assert ngram_join.shortening(500) > ngram_join.shortening(6) >= ngram_join.shortening(1) == 0
    assert ngram_join.weakest(3) == 1 and ngram_join.weakest(6) == 5 / 6


def test_stars_join_the_runs_that_share_matched_prefixes():
    import numpy as np

    rng = random.Random(21)
    for _ in range(300):
        n, least = rng.randint(1, 40), rng.randint(5, 8)
        rows = sorted(tuple(rng.choice([0, 0, 0, 1]) for _ in range(8)) for _ in range(n))
        wanted = [rng.randint(least, 8) for _ in rows]
        keys = np.array([[rng.randrange(256) for _ in range(16)] for _ in rows], dtype=np.uint8)
        shared = [0] + [next((k for k in range(8) if x[k] != y[k]), 8) for x, y in zip(rows, rows[1:], strict=False)]
        leader = ngram_join.stars(np.array(shared), np.array(wanted), keys, least)
        parent = list(range(n))
        for i in range(n):
            for j in range(n):
                if i != j and rows[i][: wanted[i]] == rows[j][: wanted[i]]:
                    a, b = sorted((parent[i], parent[j]))
                    parent = [a if p == b else p for p in parent]
        same = lambda label: {(i, j) for i in range(n) for j in range(n) if label[i] == label[j]}
        assert same(leader.tolist()) == same(parent)
        assert all(keys[k].tobytes() >= keys[x].tobytes() for k, x in enumerate(leader))


def test_recall_of_links_at_the_threshold(spark):
    """Pairs of similarity 0.80 to 0.85: none of some hundred may be missed by the forest."""
    rng, rows, pairs = random.Random(31), [], 0
    for group in range(400):
        n = rng.randint(40, 200)
        words, lost = [f"g{group}w{k}" for k in range(n + 4)], 0
        new = list(words)
        while True:  # words changed at places 5 apart take five shingles each
            at = 5 * lost + 4
            if at >= n or (n - 5 * (lost + 1)) / (n + 5 * (lost + 1)) < 0.8:
                break
            new[at] = f"x{group}y{lost}"
            lost += 1
        a, b = ({tuple(t[k : k + 5]) for k in range(n)} for t in (words, new))
        pairs += 0.8 <= len(a & b) / len(a | b) <= 0.85
        rows += [(2 * group, " ".join(words), "en", "s", 0), (2 * group + 1, " ".join(new), "en", "s", 0)]
    found = ngram_join.linked(spark.createDataFrame(rows, SCHEMA)).collect()
    assert pairs > 250 and all(r.n_links == 1 and r.class_id == r.doc_id // 2 * 2 for r in found)


def test_ids_of_text(spark):
    rows = [("b", worded(1, 30)), ("a", worded(1, 30)), (None, worded(1, 30)), ("c", worded(2, 30))]
    found = ngram_join.linked(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((r.doc_id or "", r.class_id, r.n_links) for r in found) == [("", "a", 2), ("a", "a", 2), ("b", "a", 2), ("c", "c", 0)]


def test_groups_of_stars_with_many_leaders(spark):
    rng, edges = random.Random(41), []
    for group in range(30):
        own = [group * 100 + k for k in range(60)]
        edges += [(x, y) for x in own[1:] for y in rng.sample(own[:5], 3) if x != y]
    edges += [(10_000 + k, 10_001 + k) for k in range(50)]
    found = {r.node: r.label for r in grouped(spark.createDataFrame(edges, "a long, b long")).collect()}
    told = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found.keys() == told.keys() and len(set(zip(found.values(), told.values(), strict=False))) >= len(set(told.values()))
    assert len({(found[k], told[k]) for k in found}) == len(set(found.values())) == len(set(told.values()))


def test_components_of_long_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(100)] + [(500, k) for k in range(501, 700)] + [(900, 900), (None, 3)]
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(101)}, **{k: 500 for k in range(500, 700)}}


def test_components_of_chains_longer_than_any_fixed_count_of_rounds(spark):
    names = list(range(3000))
    random.Random(11).shuffle(names)
    shuffled = list(zip(names, names[1:], strict=False))
    rising = [(k, k + 1) for k in range(10_000, 12_000)]
    # Small names alternate with great ones.
    comb = [(20_000 + k // 2 if k % 2 else 29_999 - k // 2, 29_999 - (k + 1) // 2 if k % 2 else 20_000 + (k + 1) // 2) for k in range(1500)]
    found = {r.node: r.label for r in components(spark.createDataFrame(shuffled + rising + comb, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(3000)}, **{k: 10_000 for k in range(10_000, 12_001)}, **{x: 20_000 for e in comb for x in e}}


def test_odd_rows_of_the_join(odd, none, clashing):
    found = ngram_join.linked(clashing).collect()
    assert len(found) == odd.count()
    by = defaultdict(list)
    for r in found:
        by[r.doc_id].append((r.class_id, r.n_links))
    assert by[1] == [(1, 0)] and by[2] == [(2, 0)] and by[3] == [(3, 0)]
    assert sorted(by[4]) == [(4, 0), (4, 2), (4, 2)] and by[5] == [(4, 2)]
    assert ngram_join.linked(none).count() == 0 and ngram_join.one_of_each(none).count() == 0
    assert ngram_join.one_of_each(clashing).columns == clashing.columns
    assert {r._key for r in ngram_join.one_of_each(clashing).collect()} == {"taken"}


@pytest.mark.parametrize("step", [512, 2])
def test_fingerprints_of_edited_texts(spark, monkeypatch, step):
    monkeypatch.setattr(spotsigs, "RANGE_ROWS", 20)
    monkeypatch.setattr(ordering, "STEP", step)
    rows = [(k * 3, (worded(k, 5 + k) + " the " + worded(k + 500, 40) + ". Of 😀 " + worded(k + 900, 30)) if k % 11 else None, "en", "s", 0) for k in range(150)]
    found = {r.doc_id: r for r in spotsigs.edited(spark.createDataFrame(rows, SCHEMA)).collect()}
    text = {i: t or "" for i, t, *_ in rows}
    ids = sorted(text, reverse=True)
    for k, i in enumerate(ids):
        after = ids[(k + 1) % len(ids)]
        half = len(text[i]) // 2
        assert found[i].edited == text[i][: len(text[i]) - half] + text[after][:half]
        assert found[i].next_signs == found[after].signs


def brute_signatures(text):
    import regex

    anchors = {*spotsigs.ANCHORS, spotsigs.STOP}
    flat = text.lower().replace("¶", " ")
    for mark in ".!?\n":
        flat = flat.replace(mark, " ¶ ")
    words = regex.sub(r"[^\p{L}\p{N}¶]+", " ", " ¶ " + flat).split()
    found = set()
    for k, w in enumerate(words):
        content = [x for x in words[k + 1 :] if x not in anchors][: spotsigs.CHAIN]
        if w in anchors and content:
            found.add((w, *content))
    return found


def test_printed_likeness_and_signatures_of_the_query(spark, tmp_path):
    """Against plain Python, over whole texts: signatures by the chains they stand for, likenesses from these."""
    texts = {k: None if k == 7 else " ".join(worded(100 + k + j, 6) + [" the ", ". ", " of ", "\n"][j % 4] for j in range(2 + k % 9)) for k in range(40)}
    texts[41] = texts[40] = texts[3]
    spark.createDataFrame([(k, t, "en", "s", 0) for k, t in texts.items()], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in spotsigs.query(spark, str(tmp_path)).collect()}
    ids = sorted(texts, reverse=True)
    chain: dict[int, tuple] = {}
    for k, i in enumerate(ids):
        own, after = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        new = own[: len(own) - len(own) // 2] + after[: len(own) // 2]
        sets = [brute_signatures(x) for x in (own, new, after)]
        assert [len([x for x in p.split(",") if x]) for p in (found[i].fingerprint, found[i].edited_fingerprint)] == [len(x) for x in sets[:2]]
        assert (found[i].near_edited, found[i].near_next) == (jaccard(sets[0], sets[1]), jaccard(sets[0], sets[2]))
        assert found[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest() and found[i].n_chars == len(own)
        chain.setdefault(found[i].fingerprint, frozenset(sets[0]))
        assert chain[found[i].fingerprint] == frozenset(sets[0])  # equal prints stand for equal chains
    assert found[41].fingerprint == found[40].fingerprint == found[3].fingerprint


def test_signatures_equal_brute_force(spark):
    rng = random.Random(9)
    words = ["the", "of", "tho", "re", "an", "la", "Thé", "x1", ".", "!\n", "...", "de", "soka", "###", "¶"]
    texts = ["", " ", "the", "the of", "a"] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").withColumn("s", spotsigs.signatures(__import__("pyspark").sql.functions.col("text"))).collect()
    assert [len(r.s) for r in rows] == [len(brute_signatures(r.text)) for r in rows]


def jaccard(a, b):
    return len({*a} & {*b}) / len({*a, *b}) if a or b else 1.0


def test_likeness_is_exact_for_sets_of_any_lengths(spark):
    rng = random.Random(51)
    F = pytest.importorskip("pyspark.sql.functions")
    sets = [([], []), ([], [1]), ([1], list(range(1000))), ([1, 2, 3], [3, 4]), ([5], [5]), ([1], [2])]
    sets += [tuple(sorted(rng.sample(range(-m, m), rng.randint(0, m))) for _ in "ab") for m in (3, 10, 40) for _ in range(60)]
    rows = spark.createDataFrame(sets, "a array<int>, b array<int>").select("a", "b", spotsigs.likeness(F.col("a"), F.col("b")).alias("x"), spotsigs.likeness(F.col("a"), F.col("b"), 0.5).alias("y"), spotsigs.most_alike(F.col("a"), F.col("b")).alias("bound")).collect()
    for r in rows:
        exact = jaccard(r.a, r.b)
        assert r.x == exact <= r.bound + 1e-12 and r.y == (exact if r.bound >= 0.5 else 0.0)


def test_length_partitions_hold_near_sets_in_neighbours(spark):
    F = pytest.importorskip("pyspark.sql.functions")
    part = {r.id: r.p for r in spark.range(1, 400).select("id", spotsigs.length_partition(F.col("id")).alias("p")).collect()}
    assert all(abs(part[a] - part[b]) <= 1 for a in part for b in part if min(a, b) >= 0.8 * max(a, b))
    assert part[399] > part[100] > part[20] > part[1]


def test_search_for_near_fingerprints_equals_brute_force(spark):
    rows = [(i, t and t.replace(" ", " the ", 40)) for i, t, *_ in near_docs()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs, members = spotsigs.near(docs.where("doc_id % 5 = 0"), docs)
    key = {r.doc_id: r.fingerprint_key for r in members.collect()}
    sets = {r.doc_id: [int(x) for x in r.fingerprint.split(",") if x] for r in spotsigs.fingerprinted(docs).collect()}
    wanted = {(key[a], key[b]): jaccard(sets[a], sets[b]) for a in sets for b in sets if a % 5 == 0 and sets[a] and sets[b] and key[a] != key[b] and jaccard(sets[a], sets[b]) >= 0.8}
    found = pairs.collect()
    assert len(found) == len(wanted) > 20 and {(r.fingerprint_key, r.near_key): r.likeness for r in found} == wanted
    assert len(key) == len(rows)


def test_odd_rows_of_fingerprints(odd, none, clashing):
    found = spotsigs.edited(clashing).collect()
    assert len(found) == odd.count()
    again = sorted((r.doc_id or -1, hashlib.md5(r.edited.encode()).hexdigest()) for r in spotsigs.edited(odd.repartition(5)).collect())
    assert again == sorted((r.doc_id or -1, hashlib.md5(r.edited.encode()).hexdigest()) for r in found)
    assert spotsigs.edited(none).count() == 0
    assert spotsigs.fingerprinted(clashing).count() == odd.count()
