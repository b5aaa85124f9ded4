"""Source trees as tables: files, their items with notes, and the passages a description is made from."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import code
from lexiloom.operators.kernels import each_text

#: Extensions of files that are read, and folders that aren't.
READABLE = ("rs", "ts", "tsx", "js", "jsx", "mjs", "go", "py", "java", "c", "h", "cpp", "cs", "swift")
SKIPPED = ("target", "node_modules")
LEADING = ("lib", "main", "mod", "index")
#: Comment openers, tried in order.
OPENERS = ("///", "//!", "//", "/**", "/*", "*/", "#", "<!--", "--")
ITEMS = "item_no int, kind string, name string, documented boolean, doc array<string>, shapes array<string>"


def files(spark: SparkSession, root: str) -> DataFrame:
    """path, text of readable files below root (any file system that Spark reads), hidden and built ones left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(READABLE) + "}").load(root)
    inside = F.replace(F.col("path"), F.lit(root.rstrip("/")), F.lit(""))
    return found.where(~inside.rlike(r"/(\.|(" + "|".join(SKIPPED) + ")/)")).select("path", F.col("content").cast("string").alias("text"))


def in_order(found: DataFrame) -> DataFrame:
    """files with parent, stem and own (0 for the file that speaks for its folder): the order they are read in."""
    stem = F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)
    return found.withColumns({"parent": F.regexp_extract("path", "^(.*)/[^/]*$", 1), "stem": stem, "own": (~stem.isin(*LEADING)).cast("int")}).orderBy("parent", "own", "stem")


def split_name(name: str) -> str:
    """An identifier's words."""
    return " ".join(w for w in re.split(r"[_-]+", re.sub(r"(?<=[^\W\d_A-Z]|[0-9])(?=[A-Z])", "_", name)) if w).lower()


def paragraphs(lines: list[str]) -> list[str]:
    found: list[list[str]] = [[]]
    for line in lines:
        if line.strip():
            found[-1].append(line)
        elif found[-1]:
            found.append([])
    return [" ".join(p) for p in found if p]


def uncommented(line: str) -> str | None:
    """What a comment line says; None if it is none."""
    opener = next((o for o in OPENERS if line.startswith(o)), None)
    if opener is None and not re.match(r"\*( |$)", line):
        return None
    rest = line[len(opener or "*") :]
    while rest.endswith("-->"):
        rest = rest[:-3]
    while rest.endswith("*/"):
        rest = rest[:-2]
    rest = rest.strip()
    if rest.startswith("@"):
        parts = re.split(r"\s", rest, maxsplit=1)
        rest = parts[1] if len(parts) > 1 else ""
    return rest.strip()


def declared(line: str) -> list[str]:
    return re.findall(r"[\w$]+", re.match(r"[\w$\s]*", line)[0])


def commented_items(source: str) -> Iterator[tuple]:
    """Declarations of any language with the comment above each, and the file's own note if a blank line follows it."""
    note: list[str] = []
    opened = broke = False
    number = 0
    for line in source.split("\n"):
        line = line.strip()
        if (said := uncommented(line)) is not None:
            note.append(said)
            continue
        if not line:
            broke = bool(note)
            continue
        if not opened:
            opened = True
            if broke and (doc := paragraphs(note)):
                yield number, "file", "", True, doc, []
                number, note = number + 1, []
        words = declared(line)
        if len(words) > 1:
            doc = paragraphs(note)
            yield number, words[0], " ".join(map(split_name, words[1:])), bool(doc), doc, []
            number += 1
        note = []


def rust_items(source: str) -> Iterator[tuple]:
    for k, p in enumerate(code.findings(source)):
        yield k, p.kind, split_name(p.name), p.documented, paragraphs(p.doc), [f[0] for f in p.facts]


def items(found: DataFrame) -> DataFrame:
    """Items of each file: its kind, name in words, note in paragraphs, and the shapes of what its code proves."""
    rust = F.col("path").endswith(".rs")
    return each_text(found.where(rust), ITEMS, rust_items).unionByName(each_text(found.where(~rust), ITEMS, commented_items))


def code_findings(found: DataFrame) -> DataFrame:
    """name, kind, public, line, indent, documented, doc, facts of every item of Rust files (path, text)."""
    facts = "facts array<struct<fact:string,args:array<string>,price:double>>"

    def rows(source: str) -> Iterator[tuple]:
        for p in code.findings(source):
            yield p.name, p.kind, p.public, p.line, p.indent, p.documented, p.doc, [{"fact": f, "args": a, "price": c} for f, a, c in p.facts]

    return each_text(found, f"name string, kind string, public boolean, line int, indent int, documented boolean, doc array<string>, {facts}", rows)


def stop_census(found: DataFrame) -> DataFrame:
    """How many public functions can stop, by whether they carry a note."""
    halts = F.exists("facts", lambda f: f["fact"] == "Halts")
    return code_findings(found).where("public AND kind = 'fn'").groupBy("documented").agg(F.count("*").alias("n"), F.sum(halts.cast("long")).alias("n_stop"))


def placed_items(found: DataFrame) -> DataFrame:
    """items with part: the file's own module if it describes itself or has a folder of its name, else its folder."""
    told = items(found).withColumns({"parent": F.regexp_extract("path", "^(.*)/[^/]*$", 1), "stem": F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)})
    itself = told.groupBy(F.col("path").alias("p")).agg(F.max((F.col("item_no") == 0) & (F.col("kind") == "file") & F.col("documented")).alias("itself"))
    folders = found.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).distinct()
    bare = F.regexp_replace("path", r"\.[^./]*$", "")
    told = told.withColumn("bare", bare).join(itself, F.col("path") == F.col("p")).join(folders, F.col("bare") == F.col("folder"), "left")
    part = F.when(F.col("itself") | F.col("folder").isNotNull(), F.col("bare")).otherwise(F.col("parent"))
    return told.withColumn("part", part).drop("p", "folder", "bare")


def parts(found: DataFrame) -> DataFrame:
    """part, weight (items), spoken (items with a note), itself, depth."""
    told = placed_items(found).groupBy("part").agg(F.count("*").alias("weight"), F.sum(F.col("documented").cast("long")).alias("spoken"), F.max("itself").alias("itself"))
    return told.withColumn("depth", F.size(F.split("part", "/")) - 1)


def passages(found: DataFrame) -> DataFrame:
    """place (sorts in reading order), part, text: names and note paragraphs, as a corpus is attached."""
    told = placed_items(found)
    texts = F.concat(F.array(F.struct(F.lit(0).alias("k"), F.col("name").alias("text"))), F.transform("doc", lambda p, k: F.struct((k + 1).alias("k"), p.alias("text"))))
    rows = told.select("part", "parent", (~F.col("stem").isin(*LEADING)).cast("int").alias("own"), "stem", "item_no", F.explode(texts).alias("t"))
    key = F.concat_ws("\x01", "parent", "own", "stem", F.lpad(F.col("item_no").cast("string"), 8, "0"), F.lpad(F.col("t.k").cast("string"), 6, "0"))
    return rows.where("t.text <> ''").select(key.alias("place"), "part", F.col("t.text").alias("text"))
