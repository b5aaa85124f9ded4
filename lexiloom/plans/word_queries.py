"""Words and lines by column expressions over whole tables, and the SQL each is held against."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexiloom.functions import columns
from lexiloom.functions.lexicon import FILLERS
from lexiloom.functions.style import PHRASES
from lexiloom.operators.blocks import markdown_blocks
from lexiloom.operators.phrases import phrase_notes
from lexiloom.plans import fixtures
from lexiloom.plans.corpus_queries import _TOK, corpus
from lexiloom.session import table


def lexicon_coverage(spark, d):
    """Per language: words of the stream, how many are listed, closed-class, and without any reading."""
    listed = F.broadcast(spark.createDataFrame(columns.lexicon_rows(), "w string, tags array<string>, closed boolean"))  # some 500 rows, fixed
    # Each word of a language is looked up once, and counts as often as it is written.
    stream = corpus(spark, d).stream.where("NOT marking").groupBy("lang", "folded").agg(F.count("*").alias("n")).join(listed, F.col("folded") == F.col("w"), "left")
    unknown = F.col("w").isNull() & ~F.col("folded").rlike("^[0-9]+$") & (F.size(columns.readings_by_ending(F.col("folded"), F.lit(False))) == 0)
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return stream.groupBy("lang").agg(F.sum("n").alias("n_words"), count(F.col("w").isNotNull()).alias("n_listed"), count(F.coalesce("closed", F.lit(False))).alias("n_closed"), count(unknown).alias("n_unknown"))


def ending_readings(spark, d):
    words = corpus(spark, d).words
    return words.select(F.col("folded").alias("word"), *(F.array_join(columns.readings_by_ending(F.col("folded"), F.lit(c)), " ").alias(n) for c, n in ((False, "readings"), (True, "as_name"))))


def word_forms(spark, d):
    words = corpus(spark, d).words
    w = F.col("folded")
    return words.select(w.alias("word"), columns.stem(w).alias("stem"), columns.is_abstract(w).alias("abstract"), columns.marked(w).alias("marked"), columns.unmarked(w).alias("unmarked"), columns.bare(w).alias("bare"))


def document_terms(spark, d):
    """Stems of content words that a document comes back to (weight 2 or more), the 12 heaviest."""
    c = corpus(spark, d)
    key = F.col("folded")
    words = c.docs.select(F.col("doc").alias("doc_id"), F.explode("low").alias("folded")).groupBy("doc_id", "folded").agg(F.count("*").alias("n"))
    stems = words.where(columns.bears_content(key)).groupBy("doc_id", columns.stem(key).alias("term")).agg(F.sum("n").alias("n"))
    weight = F.when(columns.is_abstract(F.col("term")), F.col("n") * 0.25).otherwise(F.col("n").cast("double"))
    by = Window.partitionBy("doc_id").orderBy(F.col("weight").desc(), "term")
    return stems.withColumn("weight", weight).where("weight >= 2").withColumn("rank", F.row_number().over(by)).where("rank <= 12").select("doc_id", "term", "weight", "rank")


def prose_blocks(spark, d):
    return markdown_blocks(table(spark, d, "documents"))


def _wasteful(spark):
    """The labelled wasteful sentences, under ids below 0: no table of its own holds such a phrase."""
    lines = [x.split(" | ")[0] for x in fixtures.WASTEFUL.strip().split("\n")]
    return spark.createDataFrame([(-1 - k, x) for k, x in enumerate(lines)], "doc_id long, text string")


def wasteful_phrases(spark, d):
    return phrase_notes(table(spark, d, "documents").select("doc_id", "text"))


def labelled_phrases(spark, d):
    return phrase_notes(_wasteful(spark))


def name_words(spark, d):
    """Words of the last path segment of page addresses."""
    name = F.regexp_extract("url", r"([^/?#]*)(?:[?#].*)?$", 1)
    return table(spark, d, "pages").select("page_id", columns.identifier_words(name).alias("words"), F.array_join(columns.declared_words(F.col("url")), " ").alias("declared"), columns.uncommented(F.regexp_replace("url", "^https?:", "")).alias("said"))


_LISTED = ", ".join("('" + w.replace("'", "''") + "', " + str(closed).upper() + ")" for w, _, closed in columns.lexicon_rows())
_NOT_CONTENT = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted({w for w, _, c in columns.lexicon_rows() if c} | FILLERS))
_ABSTRACT = " OR ".join(f"(ends_with(W, '{e}') AND strlen(W) > {len(e) + 2})" for e in columns.ABSTRACT)
_STEM = "CASE WHEN ends_with(W, 'ing') AND strlen(W) >= 6 THEN left(W, length(W) - 3) WHEN ends_with(W, 'ed') AND strlen(W) >= 5 THEN left(W, length(W) - 2) WHEN ends_with(W, 'es') AND strlen(W) >= 5 THEN left(W, length(W) - 2) WHEN ends_with(W, 's') AND strlen(W) >= 4 THEN left(W, length(W) - 1) ELSE W END"
_MARKED = "CASE WHEN regexp_matches(W, '(s|x|z|ch|sh)$') THEN W || 'es' WHEN regexp_matches(W, '[^aeiou]y$') THEN left(W, length(W) - 1) || 'ies' WHEN regexp_matches(W, '[^aeiou]o$') THEN W || 'es' ELSE W || 's' END"
_OF = lambda sql, w: re.sub(r"\bW\b", lambda _: w, sql)
_BARE = "CASE WHEN ends_with(w, 'ed') AND length(w) > 2 AND NOT (length(w) > 3 AND substr(w, length(w) - 2, 1) = substr(w, length(w) - 3, 1) AND substr(w, length(w) - 2, 1) NOT IN ('a', 'e', 'i', 'o', 'u')) THEN left(w, length(w) - 2) END"


def _unmarked() -> str:
    tried = [f"CASE WHEN ends_with(w, '{e}') AND length(w) > {len(e) - len(t)} AND ({_OF(_MARKED, s)}) = w THEN {s} END" for e, t in (("ies", "y"), ("es", ""), ("s", "")) for s in [f"(left(w, length(w) - {len(e)}) || '{t}')"]]
    return f"coalesce({', '.join(tried)})"


def _ending_sql(cap: bool) -> str:
    keep = lambda sql: "''" if cap else sql  # noqa: E731  a name keeps no noun reading of its own
    noun = keep("CASE WHEN regexp_matches(w, '(ness|tion|ment|ity)$') THEN ' noun.s' ELSE '' END")
    plural = "regexp_matches(w, '[^s]s$') AND strlen(w) >= 3"
    first = (
        ("' name.s' || " if cap else "") + "CASE WHEN ends_with(w, 'ing') AND strlen(w) >= 6 THEN ' verb.ger' ELSE '' END || CASE WHEN ends_with(w, 'ed') AND strlen(w) >= 4 THEN ' verb.past verb.part' ELSE '' END || CASE WHEN ends_with(w, 'ly') AND strlen(w) >= 5 THEN ' adv' ELSE '' END || "
        + noun + " || CASE WHEN regexp_matches(w, '(ous|ful|ive|able|ic|less)$') OR ends_with(w, 'er') AND strlen(w) >= 5 OR ends_with(w, 'est') AND strlen(w) >= 6 THEN ' adj' ELSE '' END || CASE WHEN ends_with(w, 'wise') AND strlen(w) >= 7 THEN ' adv' ELSE '' END || "
        + f"CASE WHEN {plural} THEN '{'' if cap else ' noun.p'} verb.third' ELSE '' END || " + keep(f"CASE WHEN {plural} AND regexp_matches(w, '[ui]s$') THEN ' noun.s' ELSE '' END")
    )
    placed = f"(ends_with(w, 'ing') AND strlen(w) >= 6 OR ends_with(w, 'ed') AND strlen(w) >= 4 OR {plural}) AND NOT (ends_with(w, 'eed') AND strlen(w) >= 4)"
    base = f"CASE WHEN strlen(w) >= 2 AND NOT ({placed}) THEN CASE WHEN {'FALSE' if cap else chr(40) + 'regexp_matches(w, ' + repr('(ness|tion|ment|ity)$') + ')' + chr(41)} THEN ' verb.base' ELSE ' noun.s verb.base' END ELSE '' END"
    return f"CASE WHEN regexp_matches(w, '[aeiouy]') THEN trim({first} || {base}) ELSE '' END"


_WORDS = f"WITH {_TOK}, v AS (SELECT DISTINCT folded AS w FROM tok WHERE NOT marking)"
QUERIES = {f.__name__: f for f in (lexicon_coverage, ending_readings, word_forms, document_terms, prose_blocks, wasteful_phrases, labelled_phrases, name_words)}
_LINES = ", ".join(f"({-1 - k}, '{x.split(' | ')[0]}')" for k, x in enumerate(fixtures.WASTEFUL.strip().split("\n")))
_PHRASES = ", ".join(f"('{' '.join(p)}', {len(p)}, '{f}', {'NULL' if i is None else repr(i)})" for p, (i, f) in PHRASES.items())
#: Words are joined by the first word of a phrase before any longer string is made.
_NEXT = ", ".join(f"lead(w, {k}) OVER l AS w{k}" for k in range(1, max(map(len, PHRASES))))
_SAID = "concat_ws(' ', w, " + ", ".join(f"CASE WHEN n > {k} THEN w{k} END" for k in range(1, max(map(len, PHRASES)))) + ")"
_PHRASE_SQL = rf"""WITH ph(phrase, n, flaw, instead) AS (VALUES {_PHRASES}),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::INT AS line_no FROM D),
a AS (SELECT doc_id, line_no, regexp_extract_all(lower(line), '[\p{{L}}\p{{N}}''-]+|[^\s*\\#~|]') AS words FROM l),
p AS (SELECT doc_id, line_no, unnest(words) AS w, unnest(range(len(words)))::INT AS start FROM a),
x AS (SELECT *, {_NEXT} FROM p WINDOW l AS (PARTITION BY doc_id, line_no ORDER BY start))
SELECT doc_id, line_no, start, phrase, flaw, instead FROM x JOIN ph ON w = string_split(phrase, ' ')[1] WHERE {_SAID} = phrase"""
ORACLES = {
    "wasteful_phrases": _PHRASE_SQL.replace("FROM D", "FROM documents"),
    "labelled_phrases": _PHRASE_SQL.replace("FROM D", f"FROM (VALUES {_LINES}) AS t(doc_id, text)"),
    "lexicon_coverage": f"WITH {_TOK}, lex(w, closed) AS (VALUES {_LISTED}) SELECT lang, count(*) AS n_words, sum((lex.w IS NOT NULL)::INT)::BIGINT AS n_listed, sum(coalesce(closed, false)::INT)::BIGINT AS n_closed, sum((lex.w IS NULL AND NOT regexp_matches(folded, '^[0-9]+$') AND (NOT regexp_matches(folded, '[aeiouy]') OR strlen(folded) < 2))::INT)::BIGINT AS n_unknown FROM tok LEFT JOIN lex ON folded = lex.w WHERE NOT marking GROUP BY lang",
    "ending_readings": f"{_WORDS} SELECT w AS word, {_ending_sql(False)} AS readings, {_ending_sql(True)} AS as_name FROM v",
    "word_forms": f"{_WORDS} SELECT w AS word, {_OF(_STEM, 'w')} AS stem, ({_OF(_ABSTRACT, 'w')}) AS abstract, {_OF(_MARKED, 'w')} AS marked, {_unmarked()} AS unmarked, {_BARE} AS bare FROM v",
    "document_terms": f"WITH {_TOK}, c AS (SELECT doc_id, {_OF(_STEM, 'folded')} AS term, count(*) AS n FROM tok WHERE strlen(folded) >= 3 AND regexp_matches(folded, '^\\p{{L}}+$') AND folded NOT IN ({_NOT_CONTENT}) GROUP BY 1, 2), s AS (SELECT doc_id, term, CASE WHEN {_OF(_ABSTRACT, 'term')} THEN n * 0.25::DOUBLE ELSE n::DOUBLE END AS weight FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS rank FROM s WHERE weight >= 2) SELECT doc_id, term, weight, rank::INT AS rank FROM r WHERE rank <= 12",
    "prose_blocks": r"""WITH l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents),
l1 AS (SELECT doc_id, n, rtrim(raw, chr(13)) AS raw, trim(regexp_replace(raw, '^\s+|\s+$', '', 'g')) AS line, coalesce(sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM l0),
l2 AS (SELECT *, starts_with(line, '```') AS fence, sum(starts_with(line, '```')::INT) OVER (PARTITION BY doc_id ORDER BY n) % 2 = 1 AS fenced FROM l1),
l3 AS (SELECT *, sum((fence OR (NOT fenced AND line = ''))::INT) OVER (PARTITION BY doc_id ORDER BY n) AS block FROM l2),
l4 AS (SELECT *, pos + length(raw) - length(regexp_replace(raw, '^\s+', '')) AS start FROM l3 WHERE NOT fence AND NOT fenced AND line <> '' AND NOT starts_with(line, '#') AND NOT starts_with(line, '|'))
SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY block)::INT AS block_no, min(start)::BIGINT AS start, count(*) AS n_lines, string_agg(line, ' ' ORDER BY n) AS prose FROM l4 GROUP BY doc_id, block""",
    "name_words": r"""SELECT page_id, trim(translate(regexp_replace(regexp_replace(regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1), '([\p{Ll}\p{N}])(\p{Lu})', '\1 \2', 'g'), '[_-]+', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS words,
array_to_string(regexp_extract_all(regexp_extract(url, '^([\p{L}\p{N}_$\s]*)', 1), '[\p{L}\p{N}_$]+'), ' ') AS declared, trim(regexp_replace(regexp_replace(url, '^https?:', ''), '^//', '')) AS said FROM pages""",
}
