import math
import random
import re
import time

from lexiloom.llm import pii


def brute(text):
    """The patterns as they are told, by the plain regular expressions."""
    luhn = lambda d: sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(d[::-1])) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(found, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(4)
    parts = ["a", "@", ".", "b.c", "-", " ", "+", "1", "25", "255", "300", "(", ")", "4111111111111111", "4111 1111-1111 1111", "é", "😀", "@@", "x@y.z", "10.0.0.1", "+1 (375) 555-4393", "\n"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(text) == brute(text), text


def test_dynamic_program_finds_the_best_reading():
    """Against all readings of small lattices."""
    rng = random.Random(6)

    def every(at, n, edges, scores):
        if at == n:
            return 0.0
        best = every(at + 1, n, edges, scores)
        for (i, j, _), row in zip(edges, scores, strict=True):
            if i == at:
                best = max(best, max(row) + every(j, n, edges, scores))
        return best

    for _ in range(200):
        n = rng.randint(1, 7)
        edges = [(i, j, []) for i in range(n) for j in range(i + 1, n + 1) if rng.random() < 0.5]
        scores = [[rng.uniform(-2, 2) for _ in pii.KINDS] for _ in edges]
        worth = {(i, j): max(row) for (i, j, _), row in zip(edges, scores, strict=True)}
        assert abs(sum(worth[i, j] for i, j, _ in pii.best_path(n, edges, scores)) - every(0, n, edges, scores)) < 1e-9


def test_posteriors_equal_the_sum_over_all_readings():
    rng = random.Random(16)

    def readings(at, n, edges):
        if at == n:
            yield ()
            return
        yield from readings(at + 1, n, edges)
        for e, (i, j, _) in enumerate(edges):
            if i == at:
                yield from (((e, k), *rest) for k in range(len(pii.KINDS)) for rest in readings(j, n, edges))

    for _ in range(60):
        n = rng.randint(1, 4)
        edges = [(i, j, []) for i in range(n) for j in range(i + 1, n + 1) if rng.random() < 0.5]
        scores = [[rng.uniform(-2, 2) for _ in pii.KINDS] for _ in edges]
        worth = {r: math.exp(sum(scores[e][k] for e, k in r)) for r in readings(0, n, edges)}
        total = sum(worth.values())
        for e, row in enumerate(pii.posteriors(n, edges, scores)):
            for k, p in enumerate(row):
                assert abs(p - sum(w for r, w in worth.items() if (e, k) in r) / total) < 1e-9


def test_field_finds_what_patterns_miss_and_spares_look_alikes():
    weights, rng = pii.trained(), random.Random(99)
    right = wrong = missed = 0
    for _ in range(400):
        text, spans = pii.composed(rng)
        base = pii.base_spans(text)
        wanted = {x for x in spans if not any(y[1] < x[2] and x[1] < y[2] for y in base)}
        found = {x[:3] for x in pii.spans_of(text, weights) if not x[3]}
        right, wrong, missed = right + len(found & wanted), wrong + len(found - wanted), missed + len(wanted - found)
    assert right / (right + wrong) > 0.93 and right / (right + missed) > 0.93


def test_field_reads_compressed_addresses_and_either_case():
    weights = pii.trained()
    found = lambda text: [(k, text[a:b]) for k, a, b, base in pii.spans_of(text, weights) if not base]
    for made in ("2001:db8::1", "fe80::1", "fe80::1ff:fe23:4567:890a", "2001:DB8:85A3::8A2E:370", "2001:db8::"):
        assert found(f"the server {made} is down") == [("ip", made)], made
    for made in ("john [AT] example [DOT] com", "JOHN AT EXAMPLE DOT COM", "john (At) example (Dot) org", "JOHN [AT] EXAMPLE.COM"):
        assert found(f"write to {made} now") == [("email", made)], made
    for text in ("std::vector and cafe::bed", "see add::abc here", "LOOK AT THIS. NEXT", "1::2::3", "1:2:3:4:5:6:7:8::9", "::"):
        assert found(text) == [], text


def test_long_texts_take_linear_time():
    weights = pii.trained()
    spell = lambda text: min(_seconds(text, weights) for _ in range(2))
    units = ("a", "1", "1.", "+1", "a@", "1:", "host 10.0.0.1 or a.b@c.de, call (212) 555-0199 or +1 (375) 555-4393\n", "4111 1111-1111 1111 ", "fe80::1 ")
    for unit in units:
        short, long = spell(unit * (50_000 // len(unit))), spell(unit * (400_000 // len(unit)))
        assert long < 24 * short + 0.5, unit  # eight times the length; 64 times if it were squared
    assert _seconds(units[6] * (2_000_000 // len(units[6])), weights) < 60


def _seconds(text, weights):
    began = time.process_time()
    pii.spans_of(text, weights)
    return time.process_time() - began


def test_covered_parts_and_field_spans_stay_apart_from_base_spans():
    assert pii.covered([("a", 0, 4), ("b", 2, 9), ("c", 9, 10), ("d", 12, 13)]) == [(0, 9), (9, 10), (12, 13)]
    weights, rng = pii.trained(), random.Random(7)
    parts = ["(212) 555-0199", "10.0.0.1", "4111 1111 1111 1111", "+1 (375) 555-4393", "fe80::1", "x@y.z", " ", ", ", "call ", "212.555.0199", "john [at] doe [dot] com"]
    for _ in range(500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 30)))
        spans = pii.spans_of(text, weights)
        base = [x for x in spans if x[3]]
        assert [x[:3] for x in base] == pii.base_spans(text)
        assert not any(a[1] < b[2] and b[1] < a[2] for a in spans if not a[3] for b in spans if b is not a)


def test_masking_and_odd_rows(spark, odd, none, clashing):
    rows = spark.createDataFrame([(1, "😀 mail a.b@c.de now +1 (375) 555-4393.", 5, "x")], "doc_id long, text string, n_chars long, spans string")
    found = pii.masked(rows).first()
    assert found.text == "😀 mail [EMAIL] now [PHONE]." and found.n_chars == len(found.text) and found.spans == "x"
    assert [(x.kind, x.base) for x in pii.with_spans(rows).first().spans] == [("email", True), ("phone", True)]
    assert pii.with_spans(clashing).count() == odd.count() == pii.masked(clashing).count()
    assert pii.masked(odd).columns == odd.columns and pii.masked(odd).where("doc_id = 1").first().text is None
    assert pii.with_spans(none).count() == 0 and pii.masked(none).count() == 0
