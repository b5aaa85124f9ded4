import itertools
import random

import numpy as np
import pytest

from lexiloom.functions import markup
from lexiloom.operators import describe as d
from lexiloom.operators import prose
from lexiloom.sources import trees
from lexiloom.streaming import applied, corpus_batches, tallied

RUST = '''//! Keeps the store.

/// Opens the store. It reads every shelf.
///
/// A missing shelf is an error.
pub fn open_store(path: &str) -> Result<Store, Error> { assert!(!path.is_empty()); todo() }

pub struct ShelfList { pub names: Vec<String> }
'''
SCRIPT = """// The ledger of the shop. It holds every sale.

"use strict";

/** Adds a sale to the ledger. The total is kept. */
export function addSale(amount) {}
const x = 1;
"""


@pytest.fixture
def tree(tmp_path):
    for name, text in (("src/lib.rs", RUST), ("src/shop/ledger.ts", SCRIPT), ("target/x.rs", RUST), (".git/y.rs", RUST), ("notes.txt", "no")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def test_trees(spark, tree):
    found = trees.files(spark, tree)
    assert [r.path.rsplit("/", 1)[1] for r in trees.in_order(found).collect()] == ["lib.rs", "ledger.ts"]
    items = {(r.kind, r.name): r for r in trees.items(found).collect()}
    assert items["fn", "open store"].doc == ["Opens the store. It reads every shelf.", "A missing shelf is an error."]
    assert "MayFail" in items["fn", "open store"].shapes and "Halts" in items["fn", "open store"].shapes
    assert items["file", ""].documented and items["export", "function add sale"].doc == ["Adds a sale to the ledger. The total is kept."]
    assert trees.stop_census(found).where("documented").first().n_stop == 1
    told = trees.passages(found).collect()
    assert {r.text for r in told} >= {"open store", "A missing shelf is an error.", "shelf list"}


def test_tree_descriptions(spark, tree, tmp_path):
    told = d.describe_tree(spark, tree).collect()
    assert told and all(r.refusal or r.sentence for r in told)
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.txt").write_text("no")
    assert d.describe_tree(spark, str(tmp_path / "none")).first().refusal == "no source was found to read"
    assert {r.part.rsplit("/", 1)[1]: (r.weight, r.spoken) for r in trees.parts(trees.files(spark, tree)).collect()} == {"lib": (3, 2), "ledger": (3, 2)}


def test_line_readers():
    assert [trees.uncommented(x) for x in ("/// a", "# b", "* c", "*d", "/* e */", "<!-- f -->", "@x", "// @param y the z", "-- g", "//")] == ["a", "b", "c", None, "e", "f", None, "y the z", "g", ""]
    assert trees.declared("pub fn add_one(x) {") == ["pub", "fn", "add_one"] and trees.declared("(x)") == []
    assert [trees.split_name(x) for x in ("addSale", "add_one", "HTTPServer", "a-b2C")] == ["add sale", "add one", "httpserver", "a b2 c"]
    assert trees.paragraphs(["a", "b", "", "", "c"]) == ["a b", "c"]


def test_blocks():
    source = "# T\n\nOne line.\n  two\n| x |\n\n```\ncode\n```\nend"
    assert markup.markdown_blocks(source) == [[(5, "One line."), (17, "two")], [(source.index("end"), "end")]]
    assert markup.joined(markup.markdown_blocks(source)) == "One line. two \nend \n"
    assert markup.comment_blocks("/// a\n///\n/// b\ncode\n/// ```\n/// x\ncode\n/// y") == [[(4, "a")], [(14, "b")], [(44, "y")]]
    for at, line in itertools.chain.from_iterable(markup.markdown_blocks(source)):
        assert source[at:].startswith(line)


def test_reports_keep_columns_and_take_odd_texts(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "The dogs runs.\nhey", None), (None, "é😀 \"x\" ~~ …", "c"), (3, "The dogs runs.\nhey", None)], "k int, text string, tags string")
    for operator in (prose.unit_tokens, prose.unit_reports, prose.passage_reports, prose.passage_registers, prose.assessments, prose.condensed, prose.rewritten, prose.proposals, prose.noted, prose.single_sentences):
        found = operator(rows)
        found.collect()
        assert operator(rows.limit(0)).count() == 0 and "k" in found.columns
    told = prose.passage_reports(rows).where("k = 3 AND unit_no = 0").collect()
    assert len(told) == 2 and told[0].repaired in ("The dogs run.", "The dog runs.") and told[0].faults[0].rule == "SubjectVerb"
    assert {r.rule: r.n for r in prose.tally(prose.unit_reports(rows)).collect()}["SubjectVerb"] == 2


def test_best_subset_is_exact_and_the_beam_is_near(monkeypatch):
    rng = np.random.default_rng(2)
    for most in (0, 3):
        for _ in range(30):
            n = int(rng.integers(1, 9))
            worth, pair = rng.random(n), np.triu(-rng.random((n, n)), 1)
            value = lambda s: worth[list(s)].sum() + sum(pair[a, b] for a, b in itertools.combinations(s, 2))  # noqa: E731, B023
            best = max(value(s) for k in range(1, (most or n) + 1) for s in itertools.combinations(range(n), k))
            assert value(d.best_subset(worth, pair, most)) == pytest.approx(best)
    monkeypatch.setattr(d, "EXACT", 0)
    assert d.best_subset(np.array([1.0, 0.9, 0.1]), np.array([[0, -0.95, 0], [0, 0, 0], [0, 0, 0]]), 2) == [0, 2]


def test_descriptions(spark):
    rng, common = random.Random(3), "shop year night end sale clay".split()
    own = {"a": "ledger total price owner book".split(), "b": "kiln glaze pot fire brick".split()}

    def sentence(part):
        words = [rng.choice(own[part]), *(rng.choice(own[part] + common) for _ in range(rng.randint(4, 9)))]
        rng.shuffle(words)
        return f"The {' '.join(words)}."

    rows = [(k, " ".join(sentence("ab"[k % 2]) for _ in range(4)), "ab"[k % 2]) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string")
    found = d.describe(docs, "part").collect()
    assert found and all(r.refusal is None for r in found)
    for r in found:
        assert any(r.sentence in t for _, t, p in rows if p == r.feature)
    assert len(d.describe(docs, "part", most=1).collect()) == 1
    assert d.describe(docs.limit(0), "part").first().refusal
    assert d.describe(spark.createDataFrame([(1, "no end here", "a")], docs.schema), "part").first().refusal == "the input never finishes a sentence"
    text = "\n\n".join(t for _, t, _ in rows)
    told = d.describe_prose(spark.createDataFrame([(0, text)], "doc_id long, text string")).collect()
    assert told and all(r.sentence in text for r in told)


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "the dogs runs."), (2, "He walk.")], "k int, text string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = applied(stream, "unit_reports").writeStream.format("memory").queryName("reports").option("checkpointLocation", str(tmp_path / "c1")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("reports").count() == 2
    query = tallied(stream).writeStream.outputMode("complete").format("memory").queryName("tally").option("checkpointLocation", str(tmp_path / "c2")).start()
    query.processAllAvailable()
    query.stop()
    assert {r.rule: r.n for r in spark.table("tally").collect()}["SubjectVerb"] == 2
    seen = []
    query = corpus_batches(stream, str(tmp_path / "all"), lambda s, t: seen.append(t.count())).option("checkpointLocation", str(tmp_path / "c3")).start()
    query.processAllAvailable()
    query.stop()
    assert seen[-1] == 2


def test_dimensions(spark):
    from lexiloom.operators import dims

    assert dims.tags(spark).count() == 36 and dims.rules(spark).count() == 14 and dims.frames(spark).count() == len(dims.grammar.frames()[0])
    assert dims.pairs(spark).where("left = 'det.s' AND right = 'noun.p'").first().rule == "DeterminerNumber"
    assert dims.registers(spark).where("register = 0").first().waived == [] and dims.flaws(spark).count() == 7
    assert dims.words(spark).where("word = 'the'").first().tags == ["det.s", "det.p"] and dims.phrases(spark).where("phrase = 'in order to'").first().instead == "to"
    assert dims.likeliest("the") == "det.s"


def test_counts_equal_the_reports_they_count(spark):
    """Texts are prepared several at once; a text without units has no row of counts."""
    said = ["The dogs runs. He walk home!", None, "", "Xq zzk wrt\nqwrt pfk", "There is a a very very good thing.\n" * 40, "dont stop"]
    rows = spark.createDataFrame(list(enumerate(said * 3)), "k int, text string")
    reports = prose.unit_reports(rows)
    count = {(r.k, r.unit_no): (r.n_tokens, len(r.tags), len(r.faults), len(r.unknown), len(r.notes)) for r in reports.collect()}
    assert {(r.k, r.unit_no): tuple(r)[2:] for r in prose.unit_counts(rows).collect()} == count
    for r in prose.text_counts(rows).collect():
        own = [v for (k, _), v in count.items() if k == r.k]
        assert tuple(r)[1:] == (len(own), *(sum(v[i] for v in own) for i in (0, 2, 3, 4)))
    assert {r.k for r in prose.text_counts(rows).collect()} == {k for k, _ in count}
    assert {r.rule: r.n for r in prose.audit(rows).collect()} == {r.rule: r.n for r in prose.tally(reports).collect()}


def test_texts_are_dealt_by_their_characters(spark, monkeypatch):
    from lexiloom import session

    monkeypatch.setattr(session, "TASK_CHARACTERS", 1_000)
    rows = spark.range(0, 64, 1, 2).selectExpr("id", "repeat('a b. ', 40) AS text")
    assert session.dealt(rows).rdd.getNumPartitions() == 12 and session.dealt(rows.limit(2)).rdd.getNumPartitions() == 1
