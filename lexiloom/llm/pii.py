"""Personal data: fixed patterns, and a semi-Markov conditional random field for what they miss.

Base spans (email, ip, card, phone) come from fixed patterns, leftmost and non-overlapping per kind. The
field then reads the zones that hold digits, groups of hex digits or spelled-out addresses: it scores whole
candidate segments (their shape, digits, checksums, words before them), and a dynamic program over a zone's
tokens chooses boundaries and kinds jointly; an entity has at most ``LONGEST`` tokens, so the work grows
with the text alone. Its spans are added where no base span stands; base spans always stay.

The field is trained here, by stochastic gradient on the conditional likelihood, over sentences composed
from ``TRAINING`` seeds of entities and look-alikes (dates, prices, versions, plain numbers). There are no
labels of personal data in the tables.

Defined results: a null text counts as empty and has no spans; repeated rows have equal spans; spans of
different kinds may overlap if both are base; equal starts are ordered by kind as listed; very long texts
and runs of one character are read whole, in linear time; empty tables give no rows; other columns are
kept, and a column named as a result is replaced.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.llm.merges import portions
from lexiloom.session import table

NAME = "op6_pii"
KINDS = ("email", "ip", "card", "phone")
LONGEST = 16
TRAINING, EPOCHS, RATE, PENALTY, SEED = 700, 6, 0.3, 1e-4, 5
SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]), False)

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A run of digits that gives no match from its first digit gives none from a later one.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in LOCAL:
            begin -= 1
        domain = DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            found.append(("email", begin, domain.end()))
        free = domain.end() if domain else at + 1
        at = text.find("@", free)
    if DIGIT.search(text):
        found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


# The field ------------------------------------------------------------------------------------------

AT, DOT = r"(?i:\[at\]|\(at\)|\{at\}|at)", r"(?i:\[dot\]|\(dot\)|\{dot\}|dot)"
SPELLED = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}} ?{AT} ?[A-Za-z0-9-]{{1,63}}(?: ?(?:{DOT}|\.) ?[A-Za-z0-9-]{{2,24}}){{1,3}}(?![A-Za-z0-9])")
#: Eight groups, or fewer with one double colon.
GROUP = "[0-9A-Fa-f]{1,4}"
HEXES = re.compile(rf"(?<![0-9A-Za-z:])(?:(?:{GROUP}:){{7}}{GROUP}|(?=(?::*{GROUP}){{1,7}}+(?:::)?(?![0-9A-Za-z:]))(?:{GROUP}(?::{GROUP}){{0,6}})?::(?:{GROUP}(?::{GROUP}){{0,6}})?)(?![0-9A-Za-z:])")
MARKED = re.compile(r"(?i)[\[({](?:at|dot)")
NUMBERS = re.compile(r"(?<![0-9])[(+]?[0-9][0-9 ().\-/]{5,}+")
TOKEN = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")
BEFORE = {
    "phone": "phone tel telephone call mobile cell fax dial ring whatsapp text telefon telefono".split(),
    "email": "mail email e contact write reach correo".split(),
    "card": "card visa mastercard amex credit debit payment pay karte tarjeta carte".split(),
    "ip": "ip host server address addr node from ping".split(),
}
WORD_OF = {w: k for k, words in BEFORE.items() for w in words}
SHAPES = re.compile(r"[0-9]+|[A-Za-z]+")


def plausible(piece: str) -> bool:
    digits = sum(c in "0123456789" for c in piece)
    return digits >= 7 or ":" in piece and bool(HEXES.fullmatch(piece)) or bool(SPELLED.fullmatch(piece))


def features(text: str, begin: int, end: int, hint: str) -> list[str]:
    """Of the whole span: all are read from it together with what stands beside it."""
    piece = text[begin:end]
    digits = "".join(c for c in piece if c in "0123456789")
    n = len(digits)
    shape = SHAPES.sub(lambda m: ("9" if m[0][0] in "0123456789" else "a") + (str(len(m[0])) if len(m[0]) < 7 else "+"), piece)[:40]
    found = ["one", f"n{min(n, 20)}", f"s{shape}", f"h{hint}", f"h{hint}n{min(n, 20)}", f"g{len(SHAPES.findall(piece))}"]
    if "(" in piece and piece.count("(") == piece.count(")"):
        found.append("pair")
    if piece.count("(") != piece.count(")"):
        found.append("odd")
    if 12 <= n <= 19:
        found.append("sum" if luhn(digits) else "nosum")
    if HEXES.fullmatch(piece):
        found.append("hexes" if piece.count(":") == 7 and "::" not in piece else "fewhexes" + ("digits" if n else "letters"))
    if SPELLED.fullmatch(piece):
        found.append("spelled" + ("mark" if MARKED.search(piece) else "dot" if " dot " in piece.lower() else "plain"))
    left, right = text[max(0, begin - 2) : begin], text[end : end + 2]
    if left[-1:] and left[-1] in "0123456789.-/" or len(left) == 2 and left[1] in " (" and left[0] in "0123456789":
        found.append("cutleft")
    if right[:1] and right[0] in "0123456789-/" or len(right) == 2 and right[0] in ".,) " and right[1] in "0123456789":
        found.append("cutright")
    return found


def zones(text: str) -> list[tuple[int, int]]:
    found = [m.span() for m in NUMBERS.finditer(text)] if DIGIT.search(text) else []
    if "::" in text or text.count(":") > 6:
        found += [m.span() for m in HEXES.finditer(text)]
    low = text.lower()
    if "at" in low and ("dot" in low or "at]" in low or "at)" in low or "at}" in low):
        found += [m.span() for m in SPELLED.finditer(text)]
    merged: list[tuple[int, int]] = []
    for begin, end in sorted(found):
        if merged and begin < merged[-1][1]:
            merged[-1] = merged[-1][0], max(end, merged[-1][1])
        else:
            merged.append((begin, end))
    return merged


def hint_at(text: str, begin: int) -> str:
    words = re.findall(r"[A-Za-z]+", text[max(0, begin - 40) : begin])[-3:]
    return next((WORD_OF[w.lower()] for w in reversed(words) if w.lower() in WORD_OF), "none")


def covered(base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """The parts of a text that base spans (in order of their starts) cover, in order and apart."""
    found: list[tuple[int, int]] = []
    for _, begin, end in base:
        if found and begin < found[-1][1]:
            found[-1] = found[-1][0], max(end, found[-1][1])
        else:
            found.append((begin, end))
    return found


def lattice(text: str, begin: int, end: int, taken: list[tuple[int, int]], block: int = 0) -> tuple[list[tuple[int, int]], list[tuple[int, int, list[str]]]]:
    """Tokens of a zone, and its candidate segments (first token, token after the last, features).

    taken: what base spans cover; those before number block end before the zone.
    """
    tokens = [m.span() for m in TOKEN.finditer(text, begin, end)]
    hint, edges = hint_at(text, begin), []
    for i, (a, _) in enumerate(tokens):
        while block < len(taken) and taken[block][1] <= a:
            block += 1
        for j in range(i + 1, min(i + LONGEST, len(tokens)) + 1):
            b = tokens[j - 1][1]
            if block < len(taken) and taken[block][0] < b:
                break
            if text[b - 1] in "(-/+." or b - a > 120:
                continue
            if ":" in text[a:b] and ":" in (text[a - 1 : a], text[b : b + 1]):  # a part of an address
                continue
            if plausible(text[a:b]):
                edges.append((i, j, features(text, a, b, hint)))
    return tokens, edges


Weights = dict[str, tuple[float, ...]]


def edge_scores(weights, edges) -> list[list[float]]:
    zero = (0.0,) * len(KINDS)
    return [[sum(weights.get(f, zero)[k] for f in found) for k in range(len(KINDS))] for _, _, found in edges]


def best_path(n: int, edges, scores) -> list[tuple[int, int, str]]:
    """Segments of the best reading; a token outside of any scores 0, and wins ties."""
    into = defaultdict(list)
    for (i, j, _), row in zip(edges, scores, strict=True):
        k = max(range(len(KINDS)), key=row.__getitem__)
        into[j].append((i, row[k], k))
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for i, score, k in into[j]:
            if best[i] + score > best[j] + 1e-12:
                best[j], back[j] = best[i] + score, (i, k)
    found, j = [], n
    while j > 0:
        if back[j]:
            found.append((back[j][0], j, KINDS[back[j][1]]))
            j = back[j][0]
        else:
            j -= 1
    return found[::-1]


def posteriors(n: int, edges, scores) -> list[list[float]]:
    """Probability of each segment and kind under the field (forward and backward sums)."""
    out, into = defaultdict(list), defaultdict(list)
    for e, (i, j, _) in enumerate(edges):
        out[i].append(e)
        into[j].append(e)
    plus = lambda x: (m := max(x)) + math.log(sum(math.exp(y - m) for y in x))
    whole = [plus(row) for row in scores]
    ahead, behind = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):
        ahead[j] = plus([ahead[j - 1], *(ahead[edges[e][0]] + whole[e] for e in into[j])])
    for i in range(n - 1, -1, -1):
        behind[i] = plus([behind[i + 1], *(behind[edges[e][1]] + whole[e] for e in out[i])])
    return [[math.exp(min(0.0, ahead[i] + s + behind[j] - ahead[n])) for s in row] for (i, j, _), row in zip(edges, scores, strict=True)]


def composed(rng: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A sentence with entities that the base patterns miss, or with look-alikes, and its entities."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(["on", "er", "la", "ti", "mo", "sen", "ka", "re"]) for _ in range(rng.randint(1, 3)))
    filler = lambda: " ".join(word() for _ in range(rng.randint(1, 5)))
    area = lambda: rng.choice("23456789") + digits(2)

    def entity() -> tuple[str, str, str]:
        kind = rng.choice(["phone", "phone", "phone", "email", "ip", "card"])
        if kind == "phone":
            made = rng.choice([f"({area()}) {area()}-{digits(4)}", f"{area()}-{area()}-{digits(4)}", f"{area()}.{area()}.{digits(4)}", f"1-{area()}-{area()}-{digits(4)}", f"0{digits(3)} {digits(6)}", f"({area()}){area()}-{digits(4)}", f"0{digits(2)}/{digits(7)}"])
            hinted = made[0] == "0" or rng.random() < 0.4
        elif kind == "email":
            at, dot = rng.choice([(" [at] ", " [dot] "), (" (at) ", " (dot) "), (" at ", " dot "), ("[at]", "."), ("[at]", "[dot]"), (" {at} ", " {dot} ")])
            made, hinted = f"{word()}{rng.choice(['', '.', '_'])}{word()}{at}{word()}{dot}{rng.choice(['com', 'org', 'net', 'de'])}", rng.random() < 0.4
            made = rng.choice([made, made, made, made.upper(), made.replace("at", "AT").replace("dot", "DOT") if "at]" in at or "at)" in at or "at}" in at else made])
        elif kind == "ip":
            groups = [f"{rng.randrange(65536):x}" for _ in range(8)]
            if rng.random() < 0.5:  # a run of zeros left out
                head, tail = rng.choice([(["fe80"], groups[: rng.randint(1, 4)]), (["2001", "db8", *groups[: rng.randint(0, 2)]], [f"{rng.randint(1, 15):x}"]), (groups[: rng.randint(2, 4)], groups[4 : 4 + rng.randint(0, 2)]), (["fe80"], [str(rng.randint(1, 9))])])
                made = ":".join(head) + "::" + ":".join(tail)
            else:
                made = ":".join(groups)
            made, hinted = rng.choice([made, made, made.upper()]), rng.random() < 0.4
        else:
            body = "4" + digits(14)
            made = body + next(d for d in "0123456789" if luhn(body + d))
            sep = rng.choice([".", "/", "  "])
            made, hinted = sep.join(made[k : k + 4] for k in range(0, 16, 4)), rng.random() < 0.7
        return made, kind, rng.choice(BEFORE[kind]) if hinted else word()

    def other() -> tuple[str, str, str]:
        year = f"{rng.choice(['19', '20'])}{digits(2)}"
        made = rng.choice([
            f"{year}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{year}", f"{rng.randint(1, 12)}/{rng.randint(1, 28)}/{year}", digits(rng.randint(7, 20)),
            f"{year}-{year[:2]}{digits(2)}", f"{rng.randint(1, 9)}.{digits(2)}.{digits(3)}.{digits(1)}", f"978-{digits(1)}-{digits(3)}-{digits(5)}-{digits(1)}", f"{digits(3)}.{digits(6)}", f"{digits(4)} {digits(4)} {digits(4)} {digits(3)}",
            f"{digits(1)} {digits(2)} {digits(3)} {digits(1)} {digits(2)}", f"{digits(5)}-{digits(4)}", f"{digits(4)}-{digits(4)}-{digits(4)}-{digits(4)}", f"{word()} at {word()}. {word()}", f"{word()} AT {word()}. {word()}".upper(), f"{rng.choice(['add', 'bad', 'cafe', 'face', 'dec', 'Ada', 'beef'])}::{rng.choice(['add', 'bed', 'fade', 'abc', ''])}", f"{rng.randint(10, 99)} {rng.randint(100, 999)} {rng.randint(100, 999)}", f"{digits(3)}-{digits(2)}-{digits(4)}", f"({year}) {digits(2)}-{digits(2)}",
        ])
        return made, "", rng.choice([word(), word(), "on", "in", "number", "page", "version", "order"])

    text, spans = filler(), []
    for _ in range(rng.randint(1, 3)):
        made, kind, before = entity() if rng.random() < 0.5 else other()
        text += f" {before}{rng.choice([' ', ' ', ': '])}"
        if kind:
            spans.append((kind, len(text), len(text) + len(made)))
        text += made + rng.choice([" ", ". ", ", "]) + filler()
    return text, spans


@functools.lru_cache(maxsize=1)
def trained() -> Weights:
    """Weights of the field, by stochastic gradient with averaging; a second or two, the same each time."""
    rng = random.Random(SEED)
    examples = []
    for _ in range(TRAINING):
        text, spans = composed(rng)
        taken = covered(base_spans(text))
        wanted = {(a, b): k for k, a, b in spans}
        for begin, end in zones(text):
            tokens, edges = lattice(text, begin, end, taken)
            if edges:
                gold = [wanted.get((tokens[i][0], tokens[j - 1][1])) for i, j, _ in edges]
                examples.append((len(tokens), edges, gold))
    weights: dict[str, list[float]] = defaultdict(lambda: [0.0] * len(KINDS))
    total: dict[str, list[float]] = defaultdict(lambda: [0.0] * len(KINDS))
    steps = 0
    for epoch in range(EPOCHS):
        rng.shuffle(examples)
        rate = RATE / (1 + epoch)
        for n, edges, gold in examples:
            scores = edge_scores(weights, edges)
            for (_, _, found), row, kind in zip(edges, posteriors(n, edges, scores), gold, strict=True):
                for k, p in enumerate(row):
                    if abs(slope := (KINDS[k] == kind) - p) > 1e-4:
                        for f in found:
                            weights[f][k] += rate * (slope - PENALTY * weights[f][k])
        steps += 1
        if epoch >= EPOCHS // 2:
            for f, row in weights.items():
                total[f] = [a + b for a, b in zip(total[f], row, strict=True)]
    count = EPOCHS - EPOCHS // 2
    return {f: tuple(round(x / count, 6) for x in row) for f, row in total.items()}


def spans_of(text: str, weights: Weights) -> list[tuple[str, int, int, bool]]:
    base = base_spans(text)
    found, taken, block = [(*x, True) for x in base], covered(base), 0
    for begin, end in zones(text):  # in order, as what is taken
        while block < len(taken) and taken[block][1] <= begin:
            block += 1
        tokens, edges = lattice(text, begin, end, taken, block)
        if edges:
            chosen = best_path(len(tokens), edges, edge_scores(weights, edges))
            found += [(k, tokens[i][0], tokens[j - 1][1], False) for i, j, k in chosen]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


# DataFrames -----------------------------------------------------------------------------------------


def _mapped(docs: DataFrame, names: list[str], field: T.StructField, make) -> DataFrame:
    """names of docs and one more column, made from each text and its spans."""
    weights = trained()
    source = docs.select(*dict.fromkeys([*names, "text"]))
    at = [source.columns.index(x) for x in names]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])) if field.name == "spans" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in portions(batch, "text"):
                made = [make(x, spans_of(x, weights)) for x in texts]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in at), pa.array(made, kind)], names=[*names, field.name])

    return source.mapInArrow(run, T.StructType([*(source.schema.fields[k] for k in at), field]))


def with_spans(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns keep) with spans: kind, start, end (code points, end exclusive), base."""
    names = keep or [x for x in docs.columns if x != "spans"]
    return _mapped(docs, names, T.StructField("spans", SPAN, False), lambda _, spans: [dict(zip(("kind", "start", "end", "base"), x, strict=True)) for x in spans])


def mask(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """text with each span, or run of overlapping ones, replaced by the name of its first kind."""
    parts, at, covered = [], 0, -1
    for kind, begin, end, _ in spans:
        if begin >= covered:
            parts += [text[at:begin], f"[{kind.upper()}]"]
        covered = max(covered, end)
        at = covered
    return "".join(parts) + text[at:]


def masked(docs: DataFrame) -> DataFrame:
    """docs with personal data masked in text, and n_chars (if there) as the new text has."""
    names = docs.columns
    null = "_null" + "_" * max(map(len, names))  # a name of no other column
    found = _mapped(docs.withColumn(null, F.col("text").isNull()), [*(x for x in names if x != "text"), null], T.StructField("text", T.StringType()), mask)
    found = found.withColumn("text", F.when(~F.col(null), F.col("text")))
    if "n_chars" in names:
        found = found.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return found.select(*names)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    base = F.filter("spans", lambda x: x["base"])
    number = lambda k: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == k))).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *map(number, KINDS), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
