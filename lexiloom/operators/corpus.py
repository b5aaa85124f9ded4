"""Corpus statistics: what a body of text shows of its own conventions, by plain aggregations.

Documents are passages, in the order of their key, and their tokens form one stream. Texts are cut into
tokens once, and kept in the shared folder as blocks of numbers (``coded``), from which kernels take counts, the
ends of sentences and what stands at a passage's edges. Where the sentences themselves are asked for, tokens are
kept as an array for each document instead (``docs``). What reaches across documents (the stream's seams) comes
from a table of one row per document. So no join, window or exchange takes rows of tokens: only counts and one
slim row per document are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lexiloom.operators import coded
from lexiloom.operators.ordering import with_neighbours, with_running_sum
from lexiloom.session import cut, dealt, few, staged

#: A word (letters, digits, apostrophes, underscores) or any one other character, after the gap before it.
TOKEN = r"(?s)\s*(?:[\p{L}\p{N}][\p{L}\p{N}'_]*|[^\s])"
WHITE = coded.WHITE
SMOOTHING = 0.5
#: A vocabulary of so many words at most is broadcast, or written into an expression.
BROADCAST_WORDS, LITERAL_WORDS = 200_000, 10_000
#: Rows of one value of a feature each, that are broadcast.
BROADCAST_FEATURES = 100_000
#: Words, or pairs of them, that are sent with each task of a kernel.
KERNEL_WORDS = 200_000
SPAN = 2**31


def is_capital(word: Column) -> Column:
    return word.rlike(r"^\p{Lu}")


def is_mark(word: Column) -> Column:
    return ~word.rlike(r"[\p{L}\p{N}]")


def discount(joint: Column, left: Column, right: Column) -> Column:
    rarer = F.least(left, right)
    return (joint / (joint + 1.0)) * (rarer / (rarer + 1.0))


def folded(words: Column) -> Column:
    """All words of an array in lower case; they hold no space."""
    return F.split(F.lower(F.array_join(words, " ")), " ")


def _singles(words: Column) -> Column:
    """How many words of an array are one character: marks and lone letters."""
    return F.size(F.filter(words, lambda w: F.char_length(w) == 1)).cast("long")


class Corpus:
    """docs: key, text, and the columns that serve as features of a passage."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", features: tuple[str, ...] = ("lang",)):
        self.key, self.features = key, features
        said = docs.where(F.col("text").rlike(r"\S"))
        self.raw = dealt(said).select(F.col(key).alias("doc"), *features, F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)).alias("raw"))

    @cached_property
    def docs(self) -> DataFrame:
        """A row per passage that has tokens: doc, its features, n, words, low (in lower case), attached (to the token before)."""
        words = F.transform("raw", lambda x: F.ltrim(x, F.lit(WHITE)))
        attached = F.transform("raw", lambda x, k: (k > 0) & (F.ltrim(F.left(x, F.lit(1)), F.lit(WHITE)) != ""))
        rows = self.raw.select("doc", *self.features, F.size("raw").alias("n"), words.alias("words"), attached.alias("attached"))
        return staged(rows.select("doc", *self.features, "n", "words", folded(F.col("words")).alias("low"), "attached"), "tokens")

    @cached_property
    def coded(self) -> DataFrame:
        """A row per block: passages and their features, and their tokens as numbers of the block's words."""
        kinds = dict(self.raw.dtypes)
        features = {f: kinds[f] for f in self.features}
        return staged(self.raw.mapInArrow(coded.encoded(list(features), coded.odd(self.raw.sparkSession)), coded.block_schema(kinds["doc"], features)), "coded")

    def _by_blocks(self, kernel: Callable, schema: str, *columns: str) -> DataFrame:
        """What a kernel tells of the blocks; {key} in the schema is the key's type."""
        return self.coded.select("doc", "n", "codes", "fold", "flags", "low", *columns).mapInArrow(kernel, schema.format(key=dict(self.raw.dtypes)["doc"]))

    def _summed(self, tell: Callable, names: dict[str, str], counts: tuple[str, ...], *columns: str) -> DataFrame:
        """Counts by key of all blocks."""
        schema = ", ".join([*(f"`{n}` {t}" for n, t in names.items()), *(f"{c} long" for c in counts)])
        kinds = {n: to_arrow_type(f.dataType) for n, f in zip(names, self.raw.sparkSession.createDataFrame([], schema).schema.fields, strict=False)}
        found = self._by_blocks(coded.summed(tell, tuple(names), counts, kinds), schema, *columns)
        return found.groupBy(*names).agg(*(F.sum(c).alias(c) for c in counts))

    @cached_property
    def passages(self) -> DataFrame:
        """A row per passage: its first and last token, and those of its neighbours."""
        ends = self._by_blocks(coded.over(coded.passages), "doc {key}, n int, first string, last string, inner string, close boolean, capitals long", "words", "attached")
        return cut(with_neighbours(cut(ends), "doc", ["first", "last"]))

    @property
    def stream(self) -> DataFrame:
        """A row per token: doc, features, pos, spelling, folded, capital, marking, attached."""
        each = F.arrays_zip(F.col("words").alias("w"), F.col("low").alias("l"), F.col("attached").alias("a"))
        rows = self.docs.select("doc", *self.features, F.posexplode(each).alias("pos", "x")).select("doc", *self.features, "pos", F.col("x.w").alias("spelling"), F.col("x.l").alias("folded"), F.col("x.a").alias("attached"))
        return rows.withColumns({"capital": is_capital(F.col("spelling")), "marking": is_mark(F.col("spelling"))})

    @property
    def tallies(self) -> DataFrame:
        """doc, n_tokens, n_marks, n_capitals, straight from the texts."""
        said = F.array_join(F.transform("raw", lambda x: F.ltrim(x, F.lit(WHITE))), " ")
        rows = self.raw.select("doc", F.size("raw").cast("long").alias("n_tokens"), said.alias("said"))
        count = lambda begins: F.regexp_count("said", F.lit(f"(?<![^ ]){begins}")).cast("long")
        return rows.select("doc", "n_tokens", (F.col("n_tokens") - count(r"[\p{L}\p{N}]")).alias("n_marks"), count(r"\p{Lu}").alias("n_capitals"))

    @cached_property
    def totals(self) -> tuple[int, int, int]:
        """Tokens, capitals and passages of the corpus."""
        row = self.passages.agg(F.sum("n"), F.sum("capitals"), F.count("*")).first()
        return row[0] or 0, row[1] or 0, row[2]

    @cached_property
    def seen(self) -> DataFrame:
        """folded, seen: how often each word is written."""
        return cut(self._seen)

    @property
    def _seen(self) -> DataFrame:
        return self._summed(coded.seen, {"folded": "string"}, ("seen",))

    @property
    def words(self) -> DataFrame:
        """folded: each different word that is no mark."""
        return self._seen.select("folded").where(~is_mark(F.col("folded")))

    @cached_property
    def vocabulary(self) -> DataFrame:
        """folded, seen, marking, attached, spelling (the first plain one, else the first), first_doc, first_pos."""
        rows = self._by_blocks(coded.over(coded.vocabulary), "spelling string, n long, close long, doc {key}, pos int", "words", "attached")
        place, back = F.struct("doc", "pos"), lambda p: p
        if dict(rows.dtypes)["doc"] in ("int", "bigint"):
            # One number for a place where the keys' range allows it: such a minimum is kept in a hash table.
            low, high = self.passages.agg(F.min("doc"), F.max("doc")).first()
            if low is not None and high - low < SPAN:
                place = (F.col("doc") - low).cast("long") * SPAN + F.col("pos")
                kind = dict(rows.dtypes)["doc"]
                back = lambda p: F.struct((F.floor(p / SPAN) + low).cast(kind).alias("doc"), (p % SPAN).cast("int").alias("pos"))
        each = rows.select("spelling", "n", "close", place.alias("place")).groupBy("spelling").agg(F.sum("n").alias("n"), F.sum("close").alias("close"), F.min("place").alias("place"))
        each = each.withColumn("folded", F.lower("spelling"))
        plain = F.when(~is_capital(F.col("spelling")), F.col("place"))
        found = each.groupBy("folded").agg(F.sum("n").alias("seen"), F.max(is_mark(F.col("spelling"))).alias("marking"), F.sum("close").alias("attached"), F.min_by("spelling", plain).alias("plain"), F.min_by("spelling", "place").alias("any"), F.min("place").alias("first"))
        found = found.withColumn("first", back(F.col("first")))
        return cut(found.select("folded", "seen", "marking", "attached", F.coalesce("plain", "any").alias("spelling"), F.col("first.doc").alias("first_doc"), F.col("first.pos").alias("first_pos")))

    @property
    def adjacency(self) -> DataFrame:
        """w1, w2, n: pairs of neighbours in the stream, across passages."""
        inside = self._by_blocks(coded.pairs(None), "w1 string, w2 string, n long")
        return inside.unionByName(self._seams).groupBy("w1", "w2").agg(F.sum("n").alias("n"))

    @property
    def _seams(self) -> DataFrame:
        return self.passages.where("next_first IS NOT NULL").select(F.lower("last").alias("w1"), F.lower("next_first").alias("w2"), F.lit(1).cast("long").alias("n"))

    @cached_property
    def terminators(self) -> DataFrame:
        """mark, share (capital after it), total: marks that end sentences, by what the corpus shows."""
        tokens, capitals, passages = self.totals
        inside = self._summed(coded.marks, {"mark": "string"}, ("total", "capital", "close", "final"), "attached")
        one = lambda c: c.cast("long")
        ends = self.passages.where(is_mark(F.col("last"))).select(F.lower("last").alias("mark"), F.lit(1).cast("long").alias("total"), one(F.coalesce(is_capital(F.col("next_first")), F.lit(True))).alias("capital"), one(F.col("close")).alias("close"), F.lit(1).cast("long").alias("final"))
        marks = inside.unionByName(ends).groupBy("mark").agg(*(F.sum(c).alias(c) for c in ("total", "capital", "close", "final")))
        rate, closing = capitals / tokens if tokens else 1.0, passages / tokens if tokens else 0.0
        share = F.col("capital") / F.col("total")
        kept = marks.where((F.col("total") >= 2) & (F.col("close") * 2 > F.col("total")) & (share > rate) & (F.col("final") / F.col("total") > closing))
        return cut(kept.select("mark", share.alias("share"), "total"))

    @cached_property
    def _marks(self) -> list[str]:
        """The terminators; single characters, so there are few."""
        return [r["mark"] for r in self.terminators.select("mark").collect()]

    @cached_property
    def spelt(self) -> DataFrame:
        """word, mark: words that are always written with a terminator, too often for chance."""
        tokens = max(self.totals[0], 1)
        base = F.broadcast(self.terminators.select("mark", (F.col("total") / tokens).alias("base")))  # a row per terminator
        inside = self._summed(coded.before(self._marks), {"w1": "string", "w2": "string"}, ("n",))
        pairs = inside.unionByName(self._seams.where(F.col("w2").isin(self._marks))).groupBy("w1", "w2").agg(F.sum("n").alias("n")).join(base, F.col("w2") == F.col("mark"))
        # A word that is always written with a mark is written as often as both are.
        pairs = cut(pairs.where(F.pow("base", "n") * tokens < 1).select("w1", "mark", "n", "base"))
        told = pairs.select("w1").distinct().limit(KERNEL_WORDS + 1).collect()
        seen = self._summed(coded.seen_of([r["w1"] for r in told]), {"folded": "string"}, ("seen",)) if len(told) <= KERNEL_WORDS else self.seen
        words = pairs.join(seen, F.col("w1") == F.col("folded"))
        return cut(words.where((F.col("n") >= F.col("seen")) & (F.pow("base", "seen") * tokens < 1)).select(F.col("folded").alias("word"), "mark"))

    @cached_property
    def _spelt_pairs(self) -> list[str] | None:
        """The spelt words with their marks, if they are few enough to be written into an expression."""
        told = self.spelt.limit(LITERAL_WORDS + 1).collect()
        return [f"{r['word']} {r['mark']}" for r in told] if len(told) <= LITERAL_WORDS else None

    def _with_spelt(self, rows: DataFrame, before: Column, mark: Column) -> DataFrame:
        """rows with _spelt: whether the word before a mark is always written with it."""
        if self._spelt_pairs is not None:
            return rows.withColumn("_spelt", F.coalesce(F.concat(before, F.lit(" "), mark).isin(self._spelt_pairs), F.lit(False)))
        held = self.spelt.select(F.col("word").alias("_w"), F.col("mark").alias("_m"))
        return rows.join(few(held, BROADCAST_WORDS), (before == F.col("_w")) & (mark == F.col("_m")), "left").withColumn("_spelt", F.col("_w").isNotNull()).drop("_w", "_m")

    @cached_property
    def _opening(self) -> DataFrame:
        """o: passages whose opening mark belongs to the last word of the passage before, which is always written with it."""
        found = self.passages.where((F.col("n") > 1) & F.lower("first").isin(self._marks) & F.col("prev_last").isNotNull())
        return cut(self._with_spelt(found, F.lower("prev_last"), F.lower("first")).where("_spelt").select(F.col("doc").alias("o")))

    @cached_property
    def told(self) -> coded.Marks | None:
        """What finishes sentences, for kernels; None if it is too much to be sent to each of them, so that it is joined."""
        spelt, opening = self.spelt.limit(KERNEL_WORDS + 1).collect(), self._opening.limit(BROADCAST_FEATURES + 1).collect()
        if len(spelt) > KERNEL_WORDS or len(opening) > BROADCAST_FEATURES:
            return None
        return coded.Marks(self._marks, [(r["word"], r["mark"]) for r in spelt], frozenset(r["o"] for r in opening))

    @cached_property
    def ended(self) -> DataFrame:
        """docs with ends: the places, before the last, of tokens that finish a sentence."""
        marks = self._marks
        rows = self.docs
        here = F.transform("low", lambda w, k: F.when(w.isin(marks), k)) if marks else F.array().cast("array<int>")
        here = F.filter(F.filter(here, lambda k: k.isNotNull() & (k < F.col("n") - 1)), lambda k: is_capital(F.get("words", k + 1)))
        rows = rows.withColumn("ends", here)
        if self._spelt_pairs is None:  # too many for an expression: the marks are joined, and only they
            marked = rows.select("doc", F.explode("ends").alias("k"), "low").select("doc", "k", F.get("low", F.col("k") - 1).alias("b"), F.get("low", F.col("k")).alias("m"))
            gone = self._with_spelt(marked.where("k > 0"), F.col("b"), F.col("m")).where("_spelt").groupBy(F.col("doc").alias("d")).agg(F.collect_set("k").alias("gone"))
            rows = rows.join(few(gone, BROADCAST_FEATURES), F.col("doc") == F.col("d"), "left").withColumn("ends", F.when(F.col("gone").isNull(), F.col("ends")).otherwise(F.array_except("ends", "gone"))).drop("d", "gone")
        elif pairs := self._spelt_pairs:
            rows = rows.withColumn("ends", F.filter("ends", lambda k: (k == 0) | ~F.concat(F.get("low", k - 1), F.lit(" "), F.get("low", k)).isin(pairs)))
        # A mark that opens its passage has its word in the passage before.
        if not self._opening.isEmpty():
            rows = rows.join(few(self._opening, BROADCAST_FEATURES), F.col("doc") == F.col("o"), "left").withColumn("ends", F.when(F.col("o").isNull(), F.col("ends")).otherwise(F.array_remove("ends", 0))).drop("o")
        return rows

    @cached_property
    def edges(self) -> DataFrame:
        """A row per passage: doc, inner (its finished sentences before the last token); length, marks and single (its last token is one character) of its first part cut after these, and of its last."""
        kept = ", ".join(f"length{k} long, marks{k} long, single{k} boolean" for k in (1, 2))
        return cut(self._by_blocks(coded.over(coded.edges(self.told)), f"doc {{key}}, inner long, {kept}"))

    @cached_property
    def closed(self) -> DataFrame:
        """A row per passage: doc, inner (its finished sentences before the last token), shut (the last token finishes one), final (the stream's last token), prev_shut, offset (sentences finished before it)."""
        rows = self.passages.select("doc", "n", F.lower("last").alias("_last"), F.when(F.col("n") > 1, F.col("inner")).otherwise(F.lower("prev_last")).alias("_before"), is_capital(F.col("next_first")).alias("_after"))
        rows = self._with_spelt(rows, F.col("_before"), F.col("_last"))
        shut = F.col("_last").isin(self._marks) & F.coalesce("_after", F.lit(True)) & ~F.col("_spelt")
        rows = rows.select("doc", shut.alias("shut"), F.col("_after").isNull().alias("final"))
        counts = self.edges.select(F.col("doc").alias("d"), "inner") if self.told else self.ended.select(F.col("doc").alias("d"), F.size("ends").cast("long").alias("inner"))
        rows = cut(rows.join(counts, F.col("doc") == F.col("d")).select("doc", "inner", "shut", "final", (F.col("inner") + F.col("shut").cast("long")).alias("k")))
        sums = with_running_sum(rows.select("doc", "k", "shut", "final"), "doc", "k", "offset")
        return cut(with_neighbours(sums.select("doc", "offset", "shut", "final"), "doc", ["shut"]).select("doc", "shut", "final", "offset", F.coalesce("prev_shut", F.lit(True)).alias("prev_shut")))

    @property
    def sentence_ends(self) -> DataFrame:
        """doc, n_ends: sentences that each passage finishes."""
        shut = self.closed.select(F.col("doc").alias("d"), "shut")
        if self.told:
            return self.edges.join(shut, F.col("doc") == F.col("d")).select("doc", (F.col("inner") + F.col("shut").cast("long")).alias("n_ends"))
        return self.ended.select("doc", F.size("ends").cast("long").alias("n")).join(shut, F.col("doc") == F.col("d")).select("doc", (F.col("n") + F.col("shut").cast("long")).alias("n_ends"))

    @property
    def lengths(self) -> DataFrame:
        """sentence, length (its terminator included), ended, marks, ending (its terminator is one character)."""
        single = lambda k: F.char_length(F.get("words", k)) == 1
        slim = self.ended.select("doc", _parts(F.col("ends"), F.col("n"), lambda a, b: F.struct((b - a + 1).cast("long").alias("length"), F.size(F.filter(F.sequence(a, b), single)).cast("long").alias("marks"), single(b).alias("single"))).alias("parts"))
        whole = slim.join(self.closed.withColumnRenamed("doc", "d"), F.col("doc") == F.col("d"))
        rows = whole.select("offset", "shut", F.size("parts").alias("many"), F.posexplode("parts").alias("k", "p"))
        rows = rows.select((F.col("offset") + F.col("k")).alias("sentence"), "p.length", "p.marks", ((F.col("k") < F.col("many") - 1) | F.col("shut")).alias("ended"), "p.single")
        return rows.groupBy("sentence").agg(F.sum("length").alias("length"), F.max("ended").alias("ended"), F.sum("marks").alias("marks"), F.max((F.col("ended") & F.col("single")).cast("long")).alias("ending"))

    @property
    def length_counts(self) -> DataFrame:
        """length, ended, marks, ending, c: how many sentences are so; only those at the edges of passages are rows of their own before they are counted."""
        names = ["length", "ended", "marks", "ending"]
        if not self.told:
            return self.lengths.groupBy(*names).agg(F.count("*").alias("c"))
        inner = self._summed(coded.lengths(self.told), {"length": "long", "marks": "long", "ending": "long"}, ("c",)).select("length", F.lit(True).alias("ended"), "marks", "ending", "c")
        whole = self.edges.join(self.closed.withColumnRenamed("doc", "d"), F.col("doc") == F.col("d"))
        part = lambda k, at, ended: F.struct(at.alias("sentence"), F.col(f"length{k}").alias("length"), F.col(f"marks{k}").alias("marks"), ended.alias("ended"), F.col(f"single{k}").alias("single"))
        both = F.array(part(1, F.col("offset"), F.lit(True)), part(2, F.col("offset") + F.col("inner"), F.col("shut")))
        parts = whole.select(F.inline(F.when(F.col("inner") > 0, both).otherwise(F.array(part(1, F.col("offset"), F.col("shut"))))))
        outer = parts.groupBy("sentence").agg(F.sum("length").alias("length"), F.max("ended").alias("ended"), F.sum("marks").alias("marks"), F.max((F.col("ended") & F.col("single")).cast("long")).alias("ending"))
        return inner.unionByName(outer.groupBy(*names).agg(F.count("*").alias("c"))).groupBy(*names).agg(F.sum("c").alias("c"))

    def marking_rate(self) -> float:
        """The upper median, over finished sentences, of the share of symbols that aren't the terminator."""
        return self._medians[0]

    def typical_length(self) -> int:
        return self._medians[1]

    @cached_property
    def _medians(self) -> tuple[float, int]:
        # By the few numbers that both medians need: a row for each combination of them.
        rows = cut(self.length_counts)
        body = F.greatest(F.col("length") - F.col("ending"), F.lit(1))
        shares = rows.where("ended").select((F.greatest(F.col("marks") - F.col("ending"), F.lit(0)) / body).alias("share"), "c")
        return upper_median(shares, "share", 1.0, "c"), int(upper_median(rows.where("length > 1 OR NOT ended"), "length", 0, "c"))

    @cached_property
    def transitions(self) -> DataFrame:
        """w1, w2, n: pairs of neighbours inside a sentence."""
        return staged(self.counted_transitions(), "transitions")

    def counted_transitions(self) -> DataFrame:
        """transitions that are read only once."""
        return self._neighbours().groupBy("w1", "w2").agg(F.sum("n").alias("n"))

    def transitions_of(self, words: DataFrame) -> DataFrame:
        """The transitions whose first word is one of words (h): no others are counted or shuffled."""
        told = words.limit(KERNEL_WORDS + 1).collect()
        firsts = frozenset(r["h"] for r in told) if len(told) <= KERNEL_WORDS else None
        return cut(self._neighbours(firsts).join(words, F.col("w1") == F.col("h"), "left_semi").groupBy("w1", "w2").agg(F.sum("n").alias("n")))

    def _neighbours(self, firsts: frozenset | None = None) -> DataFrame:
        """w1, w2, n: neighbours inside a sentence, not yet summed."""
        if self.told:
            parts = self._by_blocks(coded.pairs(self.told, firsts), "w1 string, w2 string, n long")
        else:
            pair = lambda k: F.struct(F.get("low", k - 1).alias("w1"), F.get("low", k).alias("w2"))
            inner = lambda a, b: F.transform(F.when(b > a, F.sequence(a + 1, b)).otherwise(F.array().cast("array<int>")), pair)
            parts = self.ended.select(F.explode(F.flatten(_parts(F.col("ends"), F.col("n"), inner))).alias("p")).select("p.w1", "p.w2", F.lit(1).cast("long").alias("n"))
        seams = self.passages.select(F.col("doc").alias("d"), F.lower("prev_last").alias("w1"), F.lower("first").alias("w2")).join(self.closed.where("NOT prev_shut"), F.col("doc") == F.col("d")).where("w1 IS NOT NULL").select("w1", "w2", F.lit(1).cast("long").alias("n"))
        return parts.unionByName(seams)

    @property
    def varied(self) -> DataFrame:
        """word, varied: how many different words follow it inside a sentence."""
        return self.transitions.groupBy(F.col("w1").alias("word")).agg(F.count("*").alias("varied"))

    @property
    def openings(self) -> DataFrame:
        """word, opened, closed: first words of sentences, and terminators (or the stream's last token)."""
        if self.told:
            return self._openings
        each = self.ended.select("doc", _parts(F.col("ends"), F.col("n"), lambda a, b: F.struct(F.get("low", a).alias("first"), F.get("low", b).alias("last"), (a == b).alias("lone"))).alias("parts"))
        whole = each.join(self.closed.withColumnRenamed("doc", "d"), F.col("doc") == F.col("d"))
        rows = whole.select("shut", "final", "prev_shut", F.size("parts").alias("many"), F.posexplode("parts").alias("k", "p")).withColumn("done", (F.col("k") < F.col("many") - 1) | F.col("shut"))
        opened = ((F.col("k") > 0) | F.col("prev_shut")) & ~(F.col("p.lone") & F.col("done"))
        shut = F.col("done") | F.col("final")
        said = F.array(F.struct(F.col("p.first").alias("word"), opened.cast("long").alias("opened"), F.lit(0).cast("long").alias("closed")), F.struct(F.col("p.last").alias("word"), F.lit(0).cast("long").alias("opened"), shut.cast("long").alias("closed")))
        return rows.select(F.inline(said)).groupBy("word").agg(F.sum("opened").alias("opened"), F.sum("closed").alias("closed"))

    @property
    def _openings(self) -> DataFrame:
        """openings by kernels: only the first and the last token of a passage need what its neighbours say."""
        inner = self._by_blocks(coded.summed(coded.openings(self.told), ("word",), ("opened", "closed"), {"word": to_arrow_type(T.StringType())}), "word string, opened long, closed long")
        whole = self.edges.join(self.closed.select(F.col("doc").alias("d"), "shut", "final", "prev_shut"), F.col("doc") == F.col("d"))
        whole = whole.join(self.passages.select(F.col("doc").alias("p"), "first", "last"), F.col("doc") == F.col("p"))
        said = lambda word, opened, closed: F.struct(F.lower(word).alias("word"), opened.cast("long").alias("opened"), closed.cast("long").alias("closed"))
        opened = F.col("prev_shut") & ~((F.col("length1") == 1) & ((F.col("inner") > 0) | F.col("shut")))
        alone = (F.col("inner") > 0) & (F.col("length2") == 1) & ~F.col("shut")
        edges = whole.select(F.inline(F.array(said("first", opened, F.lit(False)), said("last", alone, F.col("shut") | F.col("final")))))
        return inner.unionByName(edges).groupBy("word").agg(F.sum("opened").alias("opened"), F.sum("closed").alias("closed"))

    def feature_words(self, feature: str) -> DataFrame:
        """feature, word, n: words (no marks) of the passages with each value of a feature."""
        kind = dict(self.raw.dtypes)[feature]
        return self._summed(coded.feature_words(feature), {"feature": kind, "word": "string"}, ("n",), feature).where(~is_mark(F.col("word")))

    def affinity(self, feature: str) -> DataFrame:
        """feature, word, n, affinity: how much more often a word is written under a feature than anywhere."""
        tokens = max(self.totals[0], 1)
        words = self.feature_words(feature)
        total = words.groupBy(F.col("feature").alias("f")).agg(F.sum("n").alias("weight"))
        seen = self.vocabulary.select(F.col("folded").alias("w"), "seen", "first_doc", "first_pos")
        rows = words.join(few(total, BROADCAST_FEATURES), F.col("feature").eqNullSafe(F.col("f"))).join(seen, F.col("word") == F.col("w"))
        ratio = (F.col("n") / F.col("weight")) / (F.col("seen") / tokens)
        return rows.withColumn("affinity", F.pow(ratio, discount(F.col("n"), F.col("seen"), F.col("weight")))).drop("f", "w")

    def characteristic(self, feature: str, most: int) -> DataFrame:
        """The most characteristic words of each value of a feature (a top-k report)."""
        by = Window.partitionBy("feature").orderBy(F.col("affinity").desc(), "first_doc", "first_pos")
        return self.affinity(feature).where("affinity > 1").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)

    def connective(self, most: int) -> DataFrame:
        """The commonest words (a top-k report)."""
        tokens = max(self.totals[0], 1)
        return self.vocabulary.where("NOT marking").orderBy(F.col("seen").desc(), "first_doc", "first_pos").limit(most).select(F.col("folded").alias("word"), "seen", (F.col("seen") / tokens).alias("commonness"))

    @property
    def associations(self) -> DataFrame:
        """w1, w2, n, follows, association of pairs inside sentences."""
        tokens = max(self.totals[0], 1)
        left = self.seen.select(F.col("folded").alias("l"), F.col("seen").alias("seen1"))
        right = self.seen.select(F.col("folded").alias("r"), F.col("seen").alias("seen2"))
        pairs = self.transitions
        varied = pairs.groupBy(F.col("w1").alias("v")).agg(F.count("*").alias("varied"))
        words = left.join(varied, F.col("l") == F.col("v"))
        rows = pairs.join(words, F.col("w1") == F.col("l")).join(right, F.col("w2") == F.col("r"))
        common = F.col("seen2") / tokens
        follows = (F.col("n") + F.col("varied") * common) / (F.col("seen1") + F.col("varied"))
        rows = rows.withColumn("follows", follows)
        return rows.withColumn("association", F.pow(F.col("follows") / common, discount(F.col("n"), F.col("seen1"), F.col("seen2")))).select("w1", "w2", "n", "follows", "association")

    def opening_chances(self) -> DataFrame:
        """word, opens, closes: smoothed chances that a word opens or closes a sentence."""
        seen = self.seen.select(F.col("folded").alias("w"), "seen")
        rows = seen.join(self.openings, F.col("word") == F.col("w"), "left").select(F.col("w").alias("word"), "seen", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("opened", "closed")))
        smooth = lambda c: (F.col(c) + SMOOTHING) / (F.col("seen") + 2 * SMOOTHING)
        return rows.select("word", "seen", smooth("opened").alias("opens"), smooth("closed").alias("closes"))

    def places(self, words: DataFrame, most: int) -> DataFrame:
        """Occurrences of words (word, rank; smaller ranks first) in the stream: the first most of each, in order."""
        rows = self.stream.join(words, F.col("folded") == F.col("word"))
        by = Window.partitionBy("word").orderBy("doc", "pos")
        return rows.withColumn("occurrence", F.row_number().over(by)).where(F.col("occurrence") <= most).select("word", "rank", "occurrence", "doc", "pos", "spelling", "attached")

    def places_in(self, feature: str, most: int) -> DataFrame:
        """Occurrences, in the passages of each value of a feature, of its most characteristic words."""
        words = cut(self.characteristic(feature, most).select(F.col("feature").alias("f"), "word", "rank"))
        told = words.limit(KERNEL_WORDS + 1).collect()
        if len(told) <= KERNEL_WORDS:
            ranks: dict = {}
            for r in told:
                ranks.setdefault(r["f"], {})[r["word"]] = r["rank"]
            kind = dict(self.raw.dtypes)[feature]
            return self._by_blocks(coded.over(coded.places(feature, ranks)), f"feature {kind}, word string, rank int, doc {{key}}, pos int, spelling string, attached boolean", "words", "attached", feature)
        rows = self.stream.join(words, F.col(feature).eqNullSafe(F.col("f")) & (F.col("folded") == F.col("word")))
        return rows.select(F.col("f").alias("feature"), "word", "rank", "doc", "pos", "spelling", "attached")

    def writes(self, pairs: DataFrame) -> DataFrame:
        """The pairs (w1, w2) that the corpus ever wrote one after the other inside a sentence."""
        return pairs.join(self.transitions.select("w1", "w2"), ["w1", "w2"], "left_semi")

    def shared_vocabulary(self, feature: str, most: int) -> DataFrame:
        """left, right, share: characteristic words in common, of the smaller set, for each two values of a feature."""
        words = self.characteristic(feature, most).select("feature", "word")
        size = words.groupBy("feature").agg(F.count("*").alias("n"))
        a, b = (words.select(F.col("feature").alias(f), "word") for f in ("left", "right"))
        common = a.join(b, "word").where("left < right").groupBy("left", "right").agg(F.count("*").alias("common"))
        common = common.join(size.select(F.col("feature").alias("left"), F.col("n").alias("n1")), "left").join(size.select(F.col("feature").alias("right"), F.col("n").alias("n2")), "right")
        return common.select("left", "right", (F.col("common") / F.least("n1", "n2")).alias("share"))

    def readable(self, shortest: int, longest: int) -> DataFrame:
        """doc, n_readable, first_pos: passages with finished sentences of such lengths that are no more marked than the corpus is."""
        rate = self.marking_rate()
        if self.told:
            return self._by_blocks(coded.over(coded.readable(self.told, shortest, longest, rate)), "doc {key}, n_readable long, first_pos int")
        found = self.passage_sentences().withColumn("_end", (F.char_length(F.element_at("tokens", -1)["spelling"]) == 1).cast("long"))
        share = (F.col("marks") - F.col("_end")) / F.greatest(F.col("length") - F.col("_end"), F.lit(1))
        kept = found.where(F.col("length").between(shortest, longest) & (share <= rate))
        return kept.groupBy("doc").agg(F.count("*").alias("n_readable"), F.min("first_pos").alias("first_pos"))

    def best_sentences(self, feature: str, words: DataFrame, shortest: int, longest: int, considered: int | None) -> DataFrame | None:
        """feature, doc, number, first_pos, tokens of the first of the best sentences of each value of a feature (words: f, words), by kernels; None if they would be sent too much."""
        if not self.told:
            return None
        rate, kind = self.marking_rate(), dict(self.raw.dtypes)[feature]
        told = words.select("f", F.explode("words").alias("word")).limit(KERNEL_WORDS + 1).collect()
        limits, held = None, {}
        for r in told:
            held.setdefault(r["f"], set()).add(r["word"])
        if considered:
            many = self._by_blocks(coded.over(coded.first_passages(self.told, feature, considered)), f"feature {kind}, doc {{key}}, many long", feature)
            by = Window.partitionBy("feature").orderBy("doc").rowsBetween(Window.unboundedPreceding, -1)
            many = many.withColumn("ahead", F.coalesce(F.sum("many").over(by), F.lit(0))).where(F.col("ahead") < considered).limit(KERNEL_WORDS + 1)
            limits = {r["doc"]: considered - r["ahead"] for r in many.collect()}
        if len(told) > KERNEL_WORDS or len(limits or ()) > KERNEL_WORDS:
            return None
        schema = f"feature {kind}, place int, doc {{key}}, number long, first_pos int, tokens array<struct<spelling:string,attached:boolean>>"
        rows = self._by_blocks(coded.over(coded.leading(self.told, feature, held, shortest, longest, rate, limits)), schema, "words", "attached", feature)
        best = rows.groupBy("feature").agg(F.min_by(F.struct("doc", "number", "first_pos", "tokens"), F.struct("place", "doc", "number")).alias("x"))
        return cut(best.select("feature", "x.*"))

    def passage_sentences(self, most: int | None = None) -> DataFrame:
        """doc, features, number, first_pos, length, marks, tokens (spelling, attached) of finished sentences of each passage; its unfinished tail is none.

        A terminator that ends a passage finishes a sentence whatever comes next in the stream.
        """
        last = F.element_at("low", -1)
        rows = self._with_spelt(self.ended.where(last.isin(self._marks)), F.try_element_at("low", F.lit(-2)), last)
        rows = rows.withColumn("tail", (F.col("n") == 1) | ~F.col("_spelt")).unionByName(self.ended.where(~last.isin(self._marks)).withColumns({"_spelt": F.lit(False), "tail": F.lit(False)}))
        lasts = F.when(F.col("tail"), F.concat("ends", F.array(F.col("n") - 1))).otherwise(F.col("ends"))
        firsts = F.slice(F.concat(F.array(F.lit(0)), F.transform("ends", lambda k: k + 1)), F.lit(1), F.size("ends") + F.col("tail").cast("int"))
        token = lambda k: F.struct(F.get("words", k).alias("spelling"), F.get("attached", k).alias("attached"))
        rows = rows.select("doc", *self.features, F.posexplode(F.zip_with(firsts, lasts, lambda a, b: F.struct(F.transform(F.sequence(a, b), token).alias("tokens"), a.alias("first_pos")))).alias("k", "x"))
        found = rows.select("doc", *self.features, F.col("k").cast("long").alias("number"), "x.first_pos", F.size("x.tokens").cast("long").alias("length"), _singles(F.col("x.tokens.spelling")).alias("marks"), "x.tokens")
        return found.where(F.col("number") < most) if most else found


def _parts(ends: Column, n: Column, told: Callable[[Column, Column], Column]) -> Column:
    """What is told of each part of n tokens cut after each of the ends, by its first and last place.

    Tokens are taken by their places: a slice inside a lambda unpacks its whole array, which for each sentence
    would be the whole document.
    """
    firsts, lasts = F.concat(F.array(F.lit(0)), F.transform(ends, lambda k: k + 1)), F.concat(ends, F.array(n - 1))
    return F.zip_with(firsts, lasts, told)


def upper_median(rows: DataFrame, value: str, empty: float, weight: str | None = None) -> float:
    """sorted[n // 2] without sorting all rows in one place: counts per distinct value, then a running sum of these."""
    counts = cut(rows.groupBy(F.col(value).alias("v")).agg((F.sum(weight) if weight else F.count("*")).alias("c")))
    total = counts.agg(F.sum("c")).first()[0]
    if not total:
        return empty
    sums = with_running_sum(counts, "v", "c", "below")
    return sums.where((F.col("below") <= total // 2) & (F.col("below") + F.col("c") > total // 2)).first()["v"]


def written(tokens: Column) -> Column:
    """Text of an array of (spelling, attached): attached tokens join what stands before them."""
    parts = F.transform(tokens, lambda t, k: F.when(t["attached"] | (k == 0), t["spelling"]).otherwise(F.concat(F.lit(" "), t["spelling"])))
    return F.array_join(parts, "")
