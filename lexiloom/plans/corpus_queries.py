"""Corpus statistics over documents, and the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.operators.corpus import Corpus, written
from lexiloom.operators.describe import clause_cost, describe, leading
from lexiloom.session import table


def corpus(spark, sf_dir, features=("lang",)) -> Corpus:
    return Corpus(table(spark, sf_dir, "documents"), features=features)


def tokens_per_document(spark, d):
    c = corpus(spark, d)
    return c.tallies.select(F.col("doc").alias("doc_id"), "n_tokens", "n_marks", "n_capitals")


def vocabulary(spark, d):
    return corpus(spark, d).vocabulary.select("folded", "seen", "marking", "attached", "spelling")


def adjacency(spark, d):
    return corpus(spark, d).adjacency


def terminators(spark, d):
    return corpus(spark, d).terminators


def corpus_rates(spark, d):
    c = corpus(spark, d)
    tokens, capitals, passages = c.totals
    return spark.createDataFrame([(tokens, capitals / tokens if tokens else 1.0, passages, c.marking_rate(), c.typical_length())], "tokens long, capital_rate double, passages long, marking_rate double, typical_length int")


def sentence_ends(spark, d):
    return corpus(spark, d).sentence_ends.select(F.col("doc").alias("doc_id"), "n_ends")


def sentence_lengths(spark, d):
    return corpus(spark, d).length_counts.where("length > 1 OR NOT ended").groupBy("length").agg(F.sum("c").alias("n"))


def transitions(spark, d):
    return corpus(spark, d).counted_transitions()


def openings(spark, d):
    return corpus(spark, d).opening_chances()


def associations(spark, d):
    return corpus(spark, d).associations


def feature_words(spark, d):
    return corpus(spark, d, ("source",)).feature_words("source")


def affinities(spark, d):
    return corpus(spark, d).affinity("lang").select("feature", "word", "n", "affinity")


def characteristic_words(spark, d):
    return corpus(spark, d).characteristic("lang", 24).select(F.col("feature").alias("lang"), "rank", "word", "n", "affinity")


def connectives(spark, d):
    return corpus(spark, d).connective(50)


def passage_sentences(spark, d):
    found = corpus(spark, d).passage_sentences()
    return found.select(F.col("doc").alias("doc_id"), "number", "first_pos", "length", written(F.col("tokens")).alias("text"))


def readable_sentences(spark, d):
    """Sentences of 3 to 40 tokens that are no more marked than the corpus is."""
    return corpus(spark, d).readable(3, 40).withColumnRenamed("doc", "doc_id")


def leading_sentences(spark, d):
    """The sentence that speaks for each language, of the first 400 that its SQL considers."""
    return leading(corpus(spark, d), "lang", considered=400).select(F.col("feature").alias("lang"), F.col("doc").alias("doc_id"), "number", "text")


def leading_costs(spark, d):
    c = corpus(spark, d)
    return clause_cost(c, "lang", leading(c, "lang")).select(F.col("feature").alias("lang"), F.col("doc").alias("doc_id"), "number", "cost")


def shared_vocabulary(spark, d):
    return corpus(spark, d, ("source",)).shared_vocabulary("source", 24)


def characteristic_places(spark, d):
    """Where each language's eight most characteristic words stand."""
    return corpus(spark, d).places_in("lang", 8).select(F.col("feature").alias("lang"), "word", "rank", F.col("doc").alias("doc_id"), "pos", "spelling")


def described_sources(spark, d):
    """The corpus described by sentences of its sources."""
    return describe(table(spark, d, "documents"), "source", most=12)


_P = r"(\s*)([\p{L}\p{N}][\p{L}\p{N}''_]*|[^\s])"
_TOK = rf"""
t0 AS (SELECT doc_id, lang, source, regexp_extract_all(coalesce(text, ''), '{_P}', 1, 's') AS g, regexp_extract_all(coalesce(text, ''), '{_P}', 2, 's') AS w FROM documents),
t1 AS (SELECT doc_id, lang, source, unnest(range(len(w))) AS pos, unnest(w) AS spelling, unnest(g) AS gap, len(w) AS n FROM t0 WHERE len(w) > 0),
t2 AS (SELECT *, lower(spelling) AS folded, regexp_matches(spelling, '^\p{{Lu}}') AS capital, pos > 0 AND gap = '' AS attached, NOT regexp_matches(spelling, '[\p{{L}}\p{{N}}]') AS marking FROM t1),
tok AS MATERIALIZED (SELECT *, lead(capital) OVER w AS capital_after, lead(folded) OVER w AS after, lag(folded) OVER w AS before, marking OR length(spelling) = 1 AS symbolic FROM t2 WINDOW w AS (ORDER BY doc_id, pos)),
tot AS (SELECT count(*) AS tokens, sum(capital::INT) AS capitals, count(DISTINCT doc_id) AS passages FROM tok)"""
_TERM = _TOK + """,
term AS MATERIALIZED (SELECT folded AS mark, avg(coalesce(capital_after, true)::INT) AS share, count(*) AS total FROM tok WHERE marking GROUP BY folded
  HAVING count(*) >= 2 AND 2 * sum(attached::INT) > count(*) AND sum(coalesce(capital_after, true)::INT)::DOUBLE / count(*) > (SELECT capitals::DOUBLE / tokens FROM tot)
  AND sum((pos = n - 1)::INT)::DOUBLE / count(*) > (SELECT passages::DOUBLE / tokens FROM tot))"""
_ENDS = _TERM + """,
seen AS MATERIALIZED (SELECT folded, count(*) AS seen FROM tok GROUP BY folded),
adj AS (SELECT folded AS w1, after AS w2, count(*) AS n FROM tok WHERE after IS NOT NULL GROUP BY 1, 2),
spelt AS MATERIALIZED (SELECT w1 AS word, w2 AS mark FROM adj JOIN term ON w2 = mark JOIN seen a ON a.folded = w1 JOIN seen b ON b.folded = w2, tot WHERE n >= a.seen AND pow(b.seen::DOUBLE / tokens, a.seen) * tokens < 1),
ends AS MATERIALIZED (SELECT tok.*, term.mark IS NOT NULL AND coalesce(capital_after, true) AND spelt.word IS NULL AS ends, term.mark IS NOT NULL AS is_term, spelt.word IS NOT NULL AS is_spelt
  FROM tok LEFT JOIN term ON folded = term.mark LEFT JOIN spelt ON spelt.word = before AND spelt.mark = folded)"""
_SENT = _ENDS + """,
sent AS MATERIALIZED (SELECT *, coalesce(sum(ends::INT) OVER (ORDER BY doc_id, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence,
  coalesce(lag(ends) OVER (ORDER BY doc_id, pos), true) AS opens FROM ends),
len AS (SELECT sentence, count(*) AS length, bool_or(ends) AS ended, sum(symbolic::INT) AS marks, max((ends AND symbolic)::INT) AS ending FROM sent GROUP BY sentence),
rate AS (SELECT coalesce((SELECT list_sort(list(greatest(marks - ending, 0)::DOUBLE / greatest(length - ending, 1)))[(count(*) // 2 + 1)::INT] FROM len WHERE ended), 1.0) AS marking_rate)"""
_PASS = _SENT + """,
fin AS (SELECT *, ends OR (pos = n - 1 AND is_term AND (NOT is_spelt OR pos = 0)) AS done FROM ends),
num AS (SELECT *, coalesce(sum(done::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS number FROM fin),
pass AS (SELECT doc_id, number, min(pos)::INT AS first_pos, count(*) AS length, sum(symbolic::INT) AS marks, arg_max((length(spelling) = 1)::INT, pos) AS ending,
  string_agg(CASE WHEN attached THEN spelling ELSE ' ' || spelling END, '' ORDER BY pos) AS body, arg_min(attached, pos) AS glued FROM num GROUP BY doc_id, number HAVING bool_or(done))"""
_AFF = _TOK + """,
voc AS (SELECT folded, count(*) AS seen, min((doc_id, pos)) AS first FROM tok GROUP BY folded),
fw AS (SELECT lang AS feature, folded AS word, count(*) AS n FROM tok WHERE NOT marking GROUP BY 1, 2),
wt AS (SELECT feature, sum(n) AS weight FROM fw GROUP BY 1),
aff AS (SELECT fw.feature, fw.word, fw.n, voc.first, pow((n::DOUBLE / weight) / (seen::DOUBLE / tokens), (n / (n + 1.0::DOUBLE)) * (least(seen, weight) / (least(seen, weight) + 1.0::DOUBLE))) AS affinity
  FROM fw JOIN wt ON fw.feature IS NOT DISTINCT FROM wt.feature JOIN voc ON voc.folded = fw.word, tot)"""
_TRANS = _SENT + """,
tr AS MATERIALIZED (SELECT before AS w1, folded AS w2, count(*) AS n FROM sent WHERE NOT opens AND before IS NOT NULL GROUP BY 1, 2)"""

_LEAD = _PASS + """,
voc AS (SELECT folded, count(*) AS seen, min((doc_id, pos)) AS first FROM tok GROUP BY folded),
fw AS (SELECT lang AS feature, folded AS word, count(*) AS n FROM tok WHERE NOT marking GROUP BY 1, 2),
wt AS (SELECT feature, sum(n) AS weight FROM fw GROUP BY 1),
aff AS (SELECT fw.feature, fw.word, fw.n, voc.first, pow((n::DOUBLE / weight) / (seen::DOUBLE / tokens), (n / (n + 1.0::DOUBLE)) * (least(seen, weight) / (least(seen, weight) + 1.0::DOUBLE))) AS affinity
  FROM fw JOIN wt ON fw.feature IS NOT DISTINCT FROM wt.feature JOIN voc ON voc.folded = fw.word, tot),
chr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY affinity DESC, first) AS rank FROM aff WHERE affinity > 1) WHERE rank <= 24),
cand AS (SELECT p.*, d.lang, row_number() OVER (PARTITION BY d.lang ORDER BY p.doc_id, number) AS k FROM pass p JOIN (SELECT DISTINCT doc_id, lang FROM tok) d ON d.doc_id = p.doc_id),
good AS (SELECT cand.*, (SELECT count(*) FROM num JOIN chr ON chr.word = num.folded WHERE num.doc_id = cand.doc_id AND num.number = cand.number AND chr.feature IS NOT DISTINCT FROM cand.lang) > 0 OR NOT EXISTS (SELECT 1 FROM chr WHERE chr.feature IS NOT DISTINCT FROM cand.lang) AS about
  FROM cand, rate WHERE k <= 400 AND length BETWEEN 3 AND 40 AND (marks - ending)::DOUBLE / greatest(length - ending, 1) <= marking_rate),
lead AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY CASE WHEN about AND first_pos = 0 THEN 0 WHEN about THEN 1 ELSE 2 END, doc_id, number) AS place FROM good) WHERE place = 1)"""

QUERIES = {
    "tokens_per_document": tokens_per_document, "vocabulary": vocabulary, "adjacency": adjacency, "terminators": terminators, "corpus_rates": corpus_rates, "sentence_ends": sentence_ends, "sentence_lengths": sentence_lengths,
    "transitions": transitions, "openings": openings, "associations": associations, "feature_words": feature_words, "affinities": affinities, "characteristic_words": characteristic_words, "connectives": connectives,
    "passage_sentences": passage_sentences, "readable_sentences": readable_sentences, "leading_sentences": leading_sentences, "leading_costs": leading_costs, "described_sources": described_sources,
    "shared_vocabulary": shared_vocabulary, "characteristic_places": characteristic_places,
}
ORACLES = {
    "tokens_per_document": f"WITH {_TOK} SELECT doc_id, count(*) AS n_tokens, sum(marking::INT)::BIGINT AS n_marks, sum(capital::INT)::BIGINT AS n_capitals FROM tok GROUP BY doc_id",
    "vocabulary": f"WITH {_TOK} SELECT folded, count(*) AS seen, bool_or(marking) AS marking, sum(attached::INT)::BIGINT AS attached, coalesce(arg_min(spelling, (doc_id, pos)) FILTER (WHERE NOT capital), arg_min(spelling, (doc_id, pos))) AS spelling FROM tok GROUP BY folded",
    "adjacency": f"WITH {_TOK} SELECT folded AS w1, after AS w2, count(*) AS n FROM tok WHERE after IS NOT NULL GROUP BY 1, 2",
    "terminators": f"WITH {_TERM} SELECT mark, share, total FROM term",
    "corpus_rates": f"WITH {_SENT} SELECT tokens, capitals::DOUBLE / tokens AS capital_rate, passages, marking_rate, (SELECT list_sort(list(length))[(count(*) // 2 + 1)::INT] FROM len WHERE length > 1 OR NOT ended)::INT AS typical_length FROM tot, rate",
    "sentence_ends": f"WITH {_ENDS} SELECT doc_id, sum(ends::INT)::BIGINT AS n_ends FROM ends GROUP BY doc_id",
    "sentence_lengths": f"WITH {_SENT} SELECT length, count(*) AS n FROM len WHERE length > 1 OR NOT ended GROUP BY length",
    "transitions": f"WITH {_TRANS} SELECT w1, w2, n FROM tr",
    "openings": f"WITH {_SENT}, o AS (SELECT folded AS word, count(*) AS seen, sum((opens AND NOT ends)::INT) AS opened, sum((ends OR after IS NULL)::INT) AS closed FROM sent GROUP BY 1) SELECT word, seen, (opened + 0.5::DOUBLE) / (seen + 1.0::DOUBLE) AS opens, (closed + 0.5::DOUBLE) / (seen + 1.0::DOUBLE) AS closes FROM o",
    "associations": f"WITH {_TRANS}, v AS (SELECT w1, count(*) AS varied FROM tr GROUP BY 1), x AS (SELECT tr.w1, tr.w2, tr.n, a.seen AS s1, b.seen AS s2, b.seen::DOUBLE / tokens AS common, (tr.n + v.varied * (b.seen::DOUBLE / tokens)) / (a.seen + v.varied)::DOUBLE AS follows FROM tr JOIN v ON v.w1 = tr.w1 JOIN seen a ON a.folded = tr.w1 JOIN seen b ON b.folded = tr.w2, tot) SELECT w1, w2, n, follows, pow(follows / common, (n / (n + 1.0::DOUBLE)) * (least(s1, s2) / (least(s1, s2) + 1.0::DOUBLE))) AS association FROM x",
    "feature_words": f"WITH {_TOK} SELECT source AS feature, folded AS word, count(*) AS n FROM tok WHERE NOT marking GROUP BY 1, 2",
    "affinities": f"WITH {_AFF} SELECT feature, word, n, affinity FROM aff",
    "characteristic_words": f"WITH {_AFF}, r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY affinity DESC, first) AS rank FROM aff WHERE affinity > 1) SELECT feature AS lang, rank::INT AS rank, word, n, affinity FROM r WHERE rank <= 24",
    "connectives": f"WITH {_TOK}, v AS (SELECT folded AS word, count(*) AS seen, min((doc_id, pos)) AS first FROM tok WHERE NOT marking GROUP BY 1) SELECT word, seen, seen::DOUBLE / tokens AS commonness FROM v, tot ORDER BY seen DESC, first LIMIT 50",
    "passage_sentences": f"WITH {_PASS} SELECT doc_id, number, first_pos, length, CASE WHEN glued THEN body ELSE substr(body, 2) END AS text FROM pass",
    "readable_sentences": f"WITH {_PASS} SELECT doc_id, count(*) AS n_readable, min(first_pos) AS first_pos FROM pass, rate WHERE length BETWEEN 3 AND 40 AND (marks - ending)::DOUBLE / greatest(length - ending, 1) <= marking_rate GROUP BY doc_id",
    "leading_sentences": f"WITH {_LEAD} SELECT lang, doc_id, number, CASE WHEN glued THEN body ELSE substr(body, 2) END AS text FROM lead",
    "leading_costs": f"WITH {_LEAD.replace('k <= 400 AND ', '')}, tr AS MATERIALIZED (SELECT before AS w1, folded AS w2, count(*) AS n FROM sent WHERE NOT opens AND before IS NOT NULL GROUP BY 1, 2), v AS (SELECT w1, count(*) AS varied FROM tr GROUP BY 1), x AS (SELECT lead.lang, lead.doc_id, lead.number, num.pos, num.folded AS w, lead(num.folded) OVER (PARTITION BY num.doc_id, num.number ORDER BY num.pos) AS a FROM lead JOIN num ON num.doc_id = lead.doc_id AND num.number = lead.number), y AS (SELECT x.*, ln(greatest(coalesce(aff.affinity, 1), 1)) AS gain, coalesce(tr.n, 0) AS n, coalesce(v.varied, 0) AS varied, s1.seen AS s1, s2.seen AS s2, s2.seen::DOUBLE / tokens AS common FROM x LEFT JOIN aff ON aff.feature IS NOT DISTINCT FROM x.lang AND aff.word = x.w LEFT JOIN tr ON tr.w1 = x.w AND tr.w2 = x.a LEFT JOIN v ON v.w1 = x.w LEFT JOIN seen s1 ON s1.folded = x.w LEFT JOIN seen s2 ON s2.folded = x.a, tot) SELECT lang, doc_id, number, -sum(gain) - coalesce(sum(ln(pow(((n + varied * common) / (s1 + varied)::DOUBLE) / common, (n / (n + 1.0::DOUBLE)) * (least(s1, s2) / (least(s1, s2) + 1.0::DOUBLE))))), 0) AS cost FROM y GROUP BY 1, 2, 3",
    "shared_vocabulary": f"WITH {_AFF.replace('SELECT lang AS feature', 'SELECT source AS feature')}, c AS (SELECT feature, word FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY affinity DESC, first) AS rank FROM aff WHERE affinity > 1) WHERE rank <= 24), z AS (SELECT feature, count(*) AS n FROM c GROUP BY 1) SELECT a.feature AS left, b.feature AS right, count(*)::DOUBLE / min(least(x.n, y.n)) AS share FROM c a JOIN c b ON a.word = b.word AND a.feature < b.feature JOIN z x ON x.feature = a.feature JOIN z y ON y.feature = b.feature GROUP BY 1, 2",
    "characteristic_places": f"WITH {_AFF}, c AS (SELECT feature, word, rank FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY affinity DESC, first) AS rank FROM aff WHERE affinity > 1) WHERE rank <= 8) SELECT lang, word, rank::INT AS rank, doc_id, pos::INT AS pos, spelling FROM tok JOIN c ON c.word = folded AND c.feature IS NOT DISTINCT FROM lang",
}
