"""Labelled inputs of the operators that read no table: code, source trees, clause costs, cuts, descriptions, dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.functions import judge
from lexiloom.operators import dims, prose
from lexiloom.operators.describe import describe_prose
from lexiloom.plans import fixtures
from lexiloom.plans.prose_queries import BAD, _values
from lexiloom.session import shared_path
from lexiloom.sources import trees

# Sources, with what their signatures and bodies prove.
CODE = {
    "lamp": "/// Lights a lamp.\npub fn light(lamp: &mut Lamp, hours: u32) -> Result<(), Dark> { assert!(hours > 0); burn(lamp, hours) }",
    "hall": "impl Hall { pub fn doors(&self) -> Vec<Door> { vec![] } fn shut(&mut self) {} pub fn is_dark(&self) -> bool { true } }",
    "key": 'fn key(ring: &Ring) -> Option<Key> { ring.first() }\nfn count(ring: &Ring) -> usize { ring.keys.expect("a ring holds keys") }',
    "row": 'struct Row { seat: Vec<Seat>, names: Vec<String> }\nfn even(rows: &[Row], side: usize) { assert_eq!(rows.len(), side * side); }\nfn night() -> Lamp { panic!("no lamp is lit") }',
}
FACTS = [
    ("lamp", "light", True, "Halts", "Unless; hours > 0"), ("lamp", "light", True, "Takes", "lamp; hours"), ("lamp", "light", True, "MayFail", ""), ("lamp", "light", True, "Answers", "Result"),
    ("hall", "doors", True, "Reads", ""), ("hall", "doors", True, "Many", ""), ("hall", "doors", True, "Answers", "Vec"), ("hall", "shut", False, "Alters", ""), ("hall", "shut", False, "Silent", ""),
    ("hall", "is_dark", True, "Reads", ""), ("hall", "is_dark", True, "YesOrNo", ""), ("hall", "is_dark", True, "Answers", "bool"),
    ("key", "key", False, "Takes", "ring"), ("key", "key", False, "MayBeAbsent", ""), ("key", "key", False, "Answers", "Option"),
    ("key", "count", False, "Halts", "Expects; a ring holds keys"), ("key", "count", False, "Takes", "ring"), ("key", "count", False, "Number", ""), ("key", "count", False, "Answers", "usize"),
    ("row", "Row", False, "Misnumbered", "seat; singular; plural"), ("row", "even", False, "Halts", "Equal; rows.len(); side * side"), ("row", "even", False, "Takes", "rows; side"), ("row", "even", False, "Silent", ""),
    ("row", "night", False, "Halts", "Says; no lamp is lit"), ("row", "night", False, "Answers", "Lamp"),
]
# A source tree, its items, and the passages that a description reads, in order.
TREE = {
    "src/lib.rs": "//! Keeps the hall.\n\n/// Opens a door. It holds.\n///\n/// A lost key is an error.\npub fn open_door(key: &str) -> Result<Door, Lost> { find(key) }\n",
    "src/shop/ledger.ts": '// The ledger of the shop.\n\n"use strict";\n\n/** Adds a sale. */\nexport function addSale(amount) {}\nconst x = 1;\n',
    "target/built.rs": "/// Never read.\npub fn built() {}\n",
    ".hidden/secret.rs": "/// Never read.\npub fn secret() {}\n",
    "notes.txt": "never read",
}
ITEMS = [
    ("src/lib.rs", 0, "file", "", True, "Keeps the hall."), ("src/lib.rs", 1, "fn", "open door", True, "Opens a door. It holds. / A lost key is an error."),
    ("src/shop/ledger.ts", 0, "file", "", True, "The ledger of the shop."), ("src/shop/ledger.ts", 1, "export", "function add sale", True, "Adds a sale."), ("src/shop/ledger.ts", 2, "const", "x", False, ""),
]
PASSAGES = [
    (0, "src/lib", "Keeps the hall."), (1, "src/lib", "open door"), (2, "src/lib", "Opens a door. It holds."), (3, "src/lib", "A lost key is an error."),
    (4, "src/shop/ledger", "The ledger of the shop."), (5, "src/shop/ledger", "function add sale"), (6, "src/shop/ledger", "Adds a sale."), (7, "src/shop/ledger", "x"),
]
# Nouns and finite verbs between a subject and its verb, in all and at most.
COSTS = [(0, "the dog runs", 0, 0), (1, "the key to the cabinets is missing", 1, 1), (2, "the keys to the doors of the hall are missing", 2, 2), (3, "the teacher of the students was late", 1, 1), (4, "she walks to the store", 0, 0), (5, "the analysis of the data is complete", 1, 1)]
# Two subjects in paragraphs of their own.
LEDGER = ("The ledger holds every sale of the year. The ledger names the owner of each book.", "A total closes the ledger. The owner reads the total every night.")
KILN = ("The kiln burns the clay. The kiln keeps its fire until the glaze is hard.", "A pot leaves the kiln at dawn. The glaze of the pot shines.")


def code_facts(spark: SparkSession, d: str) -> DataFrame:
    found = trees.code_findings(spark.createDataFrame(list(CODE.items()), "source string, text string"))
    return found.select("source", "name", "public", F.explode("facts").alias("f")).select("source", "name", "public", "f.fact", F.array_join("f.args", "; ").alias("args"))


def _tree(spark: SparkSession) -> tuple[str, DataFrame]:
    """The labelled tree, written to the shared folder, and its readable files."""
    root = shared_path(spark, "tree")
    jvm = spark._jvm
    for name, text in TREE.items():
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        file = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
        file.write(bytearray(text.encode()))
        file.close()
    return root, trees.files(spark, root)


def _below(path: str) -> Column:
    return F.regexp_extract(path, r"(src/.*)$", 1)


def tree_items(spark: SparkSession, d: str) -> DataFrame:
    found = trees.items(_tree(spark)[1])
    return found.select(_below("path").alias("path"), "item_no", "kind", "name", "documented", F.array_join("doc", " / ").alias("doc"))


def tree_passages(spark: SparkSession, d: str) -> DataFrame:
    found = trees.passages(_tree(spark)[1])
    by = Window.orderBy("place")  # the eight passages of the labelled tree
    return found.select((F.row_number().over(by) - 1).alias("n"), _below("part").alias("part"), "text")


def integration_costs(spark: SparkSession, d: str) -> DataFrame:
    found = prose.assessments(spark.createDataFrame(COSTS, "id int, text string, c int, w int").select("id", F.col("text").alias("sentence"), "text"))
    return found.select("id", F.col("sentence").alias("text"), "cost", "worst")


def shorter_passages(spark: SparkSession, d: str) -> DataFrame:
    """What the padded passages come down to, where that is fewer words."""
    return prose.proposals(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(fixtures.CONDENSED)], "id int, text string")).select("id", F.col("at").alias("place"), "now")


def labelled_audit(spark: SparkSession, d: str) -> DataFrame:
    """The tally over the faulty sentences: whether each rule is counted as often as it is labelled."""
    found = prose.tally(prose.assessments(spark.createDataFrame([(k, t) for k, t, _ in BAD], "id int, text string")))
    wanted = spark.createDataFrame([(r, sum(x == r for *_, x in BAD)) for r in sorted({r for *_, r in BAD})], "rule string, wanted int")
    return wanted.join(found, "rule", "left").select("rule", (F.coalesce("n", F.lit(0)) >= F.col("wanted")).alias("counted"))


def described_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions of one subject and of two: every line is written in the input, and in paragraphs of its own part."""
    told = []
    for name, paragraphs in (("ledger", LEDGER), ("kiln", KILN), ("both", LEDGER + KILN)):
        text = "\n\n".join(paragraphs)
        found = describe_prose(spark.createDataFrame([(0, text)], "doc_id long, text string"))
        own = F.element_at(F.split(F.lit(text), "\n\n"), F.col("feature").cast("int") + 1)
        told.append(found.select(F.lit(name).alias("name"), F.col("refusal").isNull().alias("said"), F.contains(own, F.col("sentence")).alias("verbatim")))
    rows = told[0].unionByName(told[1]).unionByName(told[2])
    return rows.groupBy("name").agg(F.min("said").alias("said"), F.min("verbatim").alias("verbatim"), (F.count("*") <= 4).alias("short"))


def dimension_sizes(spark: SparkSession, d: str) -> DataFrame:
    tables = {"tags": dims.tags, "rules": dims.rules, "flaws": dims.flaws, "registers": dims.registers, "pairs": dims.pairs}
    rows = [f(spark).select(F.lit(n).alias("dimension")) for n, f in tables.items()]
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    return every.groupBy("dimension").agg(F.count("*").alias("n"))


def register_conventions(spark: SparkSession, d: str) -> DataFrame:
    return dims.registers(spark).select("register", F.array_join("waived", " ").alias("waived"), F.array_join("held", " ").alias("held"))


QUERIES = {f.__name__: f for f in (code_facts, tree_items, tree_passages, integration_costs, shorter_passages, labelled_audit, described_paragraphs, dimension_sizes, register_conventions)}
_NAMES = "[" + ", ".join(f"'{c}'" for c in judge.CONVENTIONS) + "]"
_BITS = f"array_to_string(list_filter({_NAMES}, lambda c: ((r >> (list_position({_NAMES}, c) - 1)) & 1) = B), ' ')"
ORACLES = {
    "code_facts": _values(FACTS, "source, name, public, fact, args"),
    "tree_items": _values(ITEMS, "path, item_no, kind, name, documented, doc"),
    "tree_passages": _values(PASSAGES, "n, part, text"),
    "integration_costs": _values(COSTS, "id, text, cost, worst"),
    "shorter_passages": _values([(k, 0, c) for k, (t, c) in enumerate(fixtures.CONDENSED) if len(c.split()) < len(t.split())], "id, place, now"),
    "labelled_audit": _values([(r, True) for r in sorted({r for *_, r in BAD})], "rule, counted"),
    "described_paragraphs": _values([(n, True, True, True) for n in ("ledger", "kiln", "both")], "name, said, verbatim, short"),
    "dimension_sizes": _values([("tags", 36), ("rules", 14), ("flaws", 7), ("registers", 32), ("pairs", 36 * 36)], "dimension, n").replace("SELECT *", "SELECT dimension, n::BIGINT AS n"),
    "register_conventions": f"SELECT r::INT AS register, {_BITS.replace('B)', '1)')} AS waived, {_BITS.replace('B)', '0)')} AS held FROM range(32) AS t(r)",
}
