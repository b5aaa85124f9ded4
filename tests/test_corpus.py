import random

import duckdb
import pytest

from lexiloom.operators import corpus as c
from lexiloom.plans import catalog

NAMES = "tokens_per_document vocabulary adjacency terminators sentence_ends sentence_lengths transitions openings corpus_rates associations passage_sentences".split()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with words that are always written with a full stop, some of which end a document whose follower opens with one."""
    rng, rows = random.Random(61), []
    said = ["Dr. Hall walks home.", "The lamp of Dr. Moss burns!", "He said so, No. 5 is lit.", "What now? Nobody knows.", "it goes on", "A b C.", "É ÖL ß.", "x_1 don't stop. Then it does."]
    for k in range(240):
        text = " ".join(rng.choice(said) for _ in range(rng.randint(1, 6)))
        if k % 9 == 0:
            text += " Dr"
        if k % 9 == 1:
            text = ". Then " + text
        rows.append((k * 2, {7: None, 8: "", 11: " \n ", 12: ".", 13: "Dr", 14: "."}.get(k, text), ["en", "de", None][k % 3], "ab"[k % 2], 0))
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    return path, con


@pytest.mark.parametrize("literal", [10_000, 0])
def test_abbreviations_and_seams_equal_the_sql(spark, tables, monkeypatch, literal):
    """Also with more abbreviations than an expression may hold, so that they are joined."""
    monkeypatch.setattr(c, "LITERAL_WORDS", literal)
    path, con = tables
    own = c.Corpus(spark.read.parquet(f"{path}/documents.parquet"))
    assert {"dr", "no"} <= {r.word for r in own.spelt.collect()} and (own._spelt_pairs is None) == (not literal)
    rounded = lambda v: round(v, 6) if isinstance(v, float) else v
    for name in NAMES if literal else ("sentence_ends", "sentence_lengths", "transitions", "passage_sentences"):
        found, told = catalog.QUERIES[name](spark, path), con.sql(catalog.ORACLES[name])
        columns = sorted(found.columns)
        at = [told.columns.index(x) for x in columns]
        assert sorted(str([rounded(r[x]) for x in columns]) for r in found.collect()) == sorted(str([rounded(r[k]) for k in at]) for r in told.fetchall()), name


def test_all_sentences_of_a_part_are_candidates(spark):
    """The only readable sentence of a part stands behind 450 that are too long."""
    from lexiloom.operators.describe import leading

    long = "The plain" + " thing stays here the plain" * 10 + " thing. "
    rows = [(0, long * 450, "a"), (1, "Kilns fire the plain thing. Kilns stay here.", "a"), (2, "The plain thing stays here. " * 450, "b")]
    own = c.Corpus(spark.createDataFrame(rows, "doc_id long, text string, part string"), features=("part",))
    found = {r.feature: (r.doc, r.number, r.text) for r in leading(own, "part").collect()}
    assert found == {"a": (1, 0, "Kilns fire the plain thing."), "b": (2, 0, "The plain thing stays here.")}
    assert {r.feature for r in leading(own, "part", considered=400).collect()} == {"b"}


def test_sentences_of_a_long_document_take_time_in_proportion(spark):
    """No part is cut by a slice inside a lambda, which unpacks the whole document for each sentence."""
    docs = spark.createDataFrame([(0, "The lamp burns. Burns the lamp. " * 25)], "doc_id long, text string")
    own = c.Corpus(docs, features=())
    plan = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" in plan(own.passage_sentences()) and all("slice(words" not in plan(rows) and "slice(low" not in plan(rows) for rows in (own.passage_sentences(), own.openings, own.lengths))
    assert [(r.number, r.first_pos, r.length) for r in own.passage_sentences().orderBy("number").collect()] == [(k, 4 * k, 4) for k in range(50)]
    assert {(r.w1, r.w2): r.n for r in own.transitions.collect()} == {("the", "lamp"): 50, ("lamp", "burns"): 25, ("burns", "."): 25, ("burns", "the"): 25, ("lamp", "."): 25}


def test_costs_count_only_what_follows_words_of_their_sentences(spark, monkeypatch):
    """No table of all the corpus's transitions is made, and the costs are those that it gives."""
    from lexiloom.operators.describe import clause_cost, leading

    rows = [(k, "The lamp burns. Kilns fire the lamp. The kilns burn. Lamps fire.", "ab"[k % 2]) for k in range(6)]
    costs = {}
    for whole in (False, True):
        own = c.Corpus(spark.createDataFrame(rows, "doc_id long, text string, part string"), features=("part",))
        if whole:
            monkeypatch.setattr(c.Corpus, "transitions_of", lambda self, words: self.transitions)
        costs[whole] = {r.feature: round(r.cost, 9) for r in clause_cost(own, "part", leading(own, "part")).collect()}
        assert ("transitions" in own.__dict__) == whole
    assert set(costs[False]) == {"a", "b"} and costs[False] == costs[True]


def test_counts_are_taken_from_blocks_and_equal_what_joins_give(spark, monkeypatch):
    """No row of a token is made for a count; and what a kernel gives is what the general way gives, where too much would be sent with each task."""
    from lexiloom.operators.describe import leading

    rng, said = random.Random(7), ["The lamp burns.", "Kilns fire the old lamp.", "We met Dr. Moss there.", "Nobody knows, it seems.", "Lamps."]
    rows = [(k, (". Then " if k % 9 == 1 else "") + " ".join(rng.choice(said) for _ in range(rng.randint(1, 6))) + (" with Dr" if k % 9 == 0 else " it goes on" if k % 7 == 0 else ""), ["en", "de", None][k % 3]) for k in range(60)]
    docs, found = spark.createDataFrame(rows, "doc_id long, text string, lang string"), {}
    told = lambda rows: sorted(map(str, rows.collect()))
    for way in ("blocks", "joins"):
        if way == "joins":
            monkeypatch.setattr(c, "KERNEL_WORDS", 0)
        own = c.Corpus(docs)
        assert (own.told is None) == (way == "joins")
        found[way] = [told(x) for x in (own.length_counts, own.openings, own.readable(3, 40), leading(own, "lang", 5).select("feature", "doc", "number", "first_pos", "text"))]
        if way == "blocks":
            plan = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString()
            assert not any("Generate explode" in plan(x) or "posexplode" in plan(x) for x in (own.adjacency, own.vocabulary, own.counted_transitions(), own.openings, own.length_counts, own.feature_words("lang"), own.words, own.sentence_ends))
    assert all(found["blocks"]) and found["blocks"] == found["joins"]


def test_blocks_hold_the_engines_characters(spark):
    """Gaps, cases and marks as the engine's expressions have them, also of characters that Python's tables know and the engine's may not."""
    from lexiloom.operators import coded

    text = "İstanbul ΣΑΣ ǅ Ⅷ ½ x y a_b's -- 'z \U0001e900\U0001e922 \U00010d50\U00010d70 Ꟛ Ᲊ \U00016ea0 Ⱟ ́e"
    own = c.Corpus(spark.createDataFrame([(1, text), (2, text + " end")], "doc_id long, text string"), features=())
    rows = own.stream.selectExpr("doc", "pos", "spelling", "folded", "attached", "capital", "marking").collect()
    batch, found = own.coded.toArrow().to_batches(), []
    for b in (coded.Block(x, k) for x in batch for k in range(x.num_rows)):
        words, at = b.words.to_pylist(), 0
        for doc, n in zip(b.doc.to_pylist(), b.n.tolist(), strict=True):
            found += [(doc, k - at, words[b.codes[k]], b.low[b.folded[k]], bool(b.attached[k]), bool(b.has(coded.CAPITAL)[k]), bool(b.has(coded.MARK)[k])) for k in range(at, at + n)]
            at += n
    assert sorted(found) == sorted(map(tuple, rows))
