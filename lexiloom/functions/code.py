"""What source code proves: items of a Rust file with the facts of their signatures and bodies.

There is no public parser at hand, so files are cut into token trees here and read item by item. A file
whose brackets don't pair, or with a function that can't be read, yields nothing.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from lexiloom.functions import lexicon, revise
from lexiloom.functions.lexicon import TAG

#: What it costs to be sure of a finding.
SIGNED, ALWAYS, SOMETIMES = 1.0, 2.0, 4.0
OPEN = {"(": ")", "[": "]", "{": "}"}
LEX = re.compile(
    r'(?P<doc>///(?!/)[^\n]*|//![^\n]*|/\*\*(?![*/]).*?\*/|/\*!.*?\*/)|(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<str>b?r(?P<h>#*)".*?"(?P=h)|b?"(?:[^"\\]|\\.)*"|b?\'(?:[^\'\\]|\\.[^\']*)\')'
    r"|(?P<life>'[A-Za-z_]\w*)|(?P<num>[0-9][\w]*(?:\.[0-9][\w]*)?)|(?P<word>(?:r#)?[A-Za-z_]\w*)|(?P<mark>.)",
    re.DOTALL,
)


class Tree(NamedTuple):
    kind: str  # word, str, num, life, doc, mark, or an opening bracket
    text: str
    line: int
    column: int
    inner: tuple = ()
    joint: bool = False  # a mark that the next mark follows without a space


class Piece(NamedTuple):
    name: str
    kind: str
    public: bool
    line: int
    indent: int
    documented: bool
    doc: list[str]
    facts: list[tuple[str, list[str], float]]


def trees(source: str) -> tuple[Tree, ...] | None:
    """Token trees; None if the brackets don't pair."""
    stack: list[tuple[Tree | None, list[Tree]]] = [(None, [])]
    line, begin = 1, 0
    for m in LEX.finditer(source):
        kind, text = m.lastgroup if m.lastgroup != "h" else "str", m[0]
        column = m.start() - begin
        if kind == "mark" and text in OPEN:
            stack.append((Tree(text, text, line, column), []))
        elif kind == "mark" and text in ")]}":
            head, inner = stack.pop()
            if head is None or OPEN[head.text] != text:
                return None
            stack[-1][1].append(head._replace(inner=tuple(inner)))
        elif kind != "skip":
            after = source[m.end() : m.end() + 1]
            joint = kind == "mark" and bool(after) and not after.isspace() and after not in "()[]{}\"'" and not after.isalnum() and after != "_" and not source.startswith(("//", "/*"), m.end())
            stack[-1][1].append(Tree(kind, text, line, column, (), joint))
        if "\n" in text:
            line += text.count("\n")
            begin = m.start() + text.rfind("\n") + 1
    return tuple(stack[0][1]) if len(stack) == 1 else None


def _doc_lines(tree: Tree) -> list[str]:
    text = tree.text
    if text.startswith(("///", "//!")):
        return [text[3:].strip()]
    return ["\n".join(x.strip() for x in text[3:-2].split("\n")).strip()]


def _trim(lines: list[str]) -> list[str]:
    while lines and not lines[0]:
        lines = lines[1:]
    while lines and not lines[-1]:
        lines = lines[:-1]
    return lines


def _outer(kind: tuple[Tree, ...]) -> str:
    """The name of a type's outermost part, references left out."""
    kind = tuple(t for t in kind if t.kind not in ("life",) and t.text not in ("&", "mut", "dyn"))
    if not kind:
        return ""
    if kind[0].kind == "[":
        return "" if any(t.text == ";" for t in kind[0].inner) else "slice"
    if kind[0].kind == "(":
        return "nothing" if not kind[0].inner else ""
    if kind[0].text == "impl":
        return ""
    name, deep = "", 0
    for t in kind:
        if t.text == "<":
            deep += 1
        elif t.text == ">":
            deep -= 1
        elif deep == 0 and t.kind == "word":
            name = t.text
    return name


_MANY = frozenset("Vec VecDeque HashMap BTreeMap HashSet BTreeSet Iterator".split())
_COUNTS = frozenset("u8 u16 u32 u64 usize i8 i16 i32 i64 isize f32 f64".split())


def number_of(kind: tuple[Tree, ...]) -> str | None:
    """Whether a type holds one or many; None if it may be either (a count reads both ways)."""
    bare = tuple(t for t in kind if t.kind != "life" and t.text not in ("&", "mut"))
    if bare and bare[0].kind == "[":
        return "plural"
    head = _outer(kind)
    if head in _MANY or head.endswith(("Map", "Set", "List")):
        return "plural"
    return "singular" if head in ("bool", "char") else None


def reads_as(name: str) -> str | None:
    """The number that a name's last word carries."""
    last = name.rsplit("_", 1)[-1]
    if len(last) < 2 or not last.isalpha():
        return None
    one, many = lexicon.offers(last, TAG["noun.s"]), lexicon.offers(last, TAG["noun.p"])
    if one and many:
        return None
    return "singular" if one else "plural" if many or revise.is_plural(last) else "singular"


def _misnumbered(name: str, kind: tuple[Tree, ...]) -> list[tuple[str, list[str], float]]:
    asks, has = number_of(kind), reads_as(name)
    return [("Misnumbered", [name, has, asks], SIGNED)] if asks and has and asks != has else []


def _parts(inner: tuple[Tree, ...]) -> list[tuple[Tree, ...]]:
    """What stands between commas, those inside angle brackets left alone."""
    found: list[list[Tree]] = [[]]
    deep = 0
    for k, t in enumerate(inner):
        if t.text == "<":
            deep += 1
        elif t.text == ">" and not (k and inner[k - 1].text in "-=" and inner[k - 1].joint):
            deep = max(0, deep - 1)
        if t.text == "," and deep == 0:
            found.append([])
        else:
            found[-1].append(t)
    return [tuple(x) for x in found if x]


def signature_facts(inputs: tuple[Tree, ...], output: tuple[Tree, ...] | None) -> list[tuple[str, list[str], float]]:
    facts, takes = [], []
    for part in _parts(inputs):
        part = tuple(t for t in part if t.kind not in ("doc", "life"))
        words = [t.text for t in part]
        colon = next((k for k, t in enumerate(part) if t.text == ":"), None)
        if "self" in words[: colon if colon is not None else len(words)]:
            facts.append(("Alters" if words[:2] == ["&", "mut"] else "Reads", [], SIGNED))
        elif colon is not None:
            names = [w for w in words[:colon] if w not in ("mut", "ref")]
            if len(names) == 1 and part[colon - 1].kind == "word":
                facts += _misnumbered(names[0], part[colon + 1 :])
                takes.append(names[0])
    if takes:
        facts.append(("Takes", takes, SIGNED))
    if output is None:
        return [*facts, ("Silent", [], SIGNED)]
    head = _outer(output)
    if named := {"Option": "MayBeAbsent", "Result": "MayFail", "bool": "YesOrNo"}.get(head):
        facts.append((named, [], SIGNED))
    if number_of(output) == "plural":
        facts.append(("Many", [], SIGNED))
    if head in _COUNTS:
        facts.append(("Number", [], SIGNED))
    return [*facts, ("Answers", [head], SIGNED)]


def tight(some: tuple[Tree, ...]) -> str:
    """Tokens spaced as they would be written."""
    out, joined, operand, run_operand, running = "", True, False, False, False
    for t in some:
        if t.kind in OPEN:
            out += (" " if not operand and not joined and out else "") + t.text + tight(t.inner) + OPEN[t.text]
            joined, operand, running = False, True, False
        elif t.kind == "mark":
            calls = t.text == "!" and not t.joint and (out[-1:].isalnum() or out[-1:] == "_")
            run_operand = run_operand if running else operand
            if not (calls or t.text in ".,;?:") and not joined and out and out[-1] not in "([{":
                out += " "
            out += t.text
            joined = calls or t.text in ".:" or t.joint or not run_operand
            if t.text in ",;":
                out, joined = out + " ", True
            operand, running = False, t.joint
        elif t.kind != "doc":
            out += (" " if not joined and out else "") + t.text
            joined, operand, running = False, True, False
    return out


def _quotable(text: str) -> str | None:
    return text if text and "`" not in text else None


def halt(body: tuple[Tree, ...]) -> list[str] | None:
    """The first cause for which a body stops: its kind, and what the code gives for it."""
    for k, t in enumerate(body):
        after = body[k + 1] if k + 1 < len(body) else None
        if t.kind == "word" and after is not None and after.text == "!" and k + 2 < len(body) and body[k + 2].kind in OPEN:
            parts = [p for p in _flat(body[k + 2].inner) if p]
            if t.text == "assert" and parts:
                return ["Unless", tight(parts[0])]
            if t.text in ("assert_eq", "assert_ne") and len(parts) > 1:
                return ["Equal" if t.text == "assert_eq" else "Differ", tight(parts[0]), tight(parts[1])]
            if t.text in ("panic", "unreachable") and parts and parts[0][0].kind == "str" and parts[0][0].text.startswith('"'):
                words = parts[0][0].text[1:-1].split("{")[0].strip().rstrip(":,-;").strip()
                if _quotable(words):
                    return ["Says", words]
        if t.text == "." and after is not None and after.text == "expect" and k + 2 < len(body) and body[k + 2].kind == "(":
            inner = body[k + 2].inner
            if inner and inner[0].kind == "str" and _quotable(inner[0].text.strip('"').strip()):
                return ["Expects", inner[0].text.strip('"').strip()]
        if t.kind in OPEN and not (k > 1 and body[k - 1].text == "!" and body[k - 2].kind == "word") and (found := halt(t.inner)):
            return found
    return None


def _flat(inner: tuple[Tree, ...]) -> list[tuple[Tree, ...]]:
    found: list[list[Tree]] = [[]]
    for t in inner:
        if t.text == "," and t.kind == "mark":
            found.append([])
        else:
            found[-1].append(t)
    return [tuple(x) for x in found]


class _Unreadable(Exception):
    pass


_SKIPPED = frozenset("unsafe async extern default const".split())


def _items(body: tuple[Tree, ...], inside_impl: bool = False) -> list[Piece]:
    found: list[Piece] = []
    doc: list[str] = []
    public, start, k = False, None, 0

    def reset() -> None:
        nonlocal doc, public, start
        doc, public, start = [], False, None

    def piece(name: str, kind: str, facts: list) -> None:
        lines = _trim(doc)
        found.append(Piece(name, kind, public, start.line, start.column, bool(lines), lines, facts))

    while k < len(body):
        t = body[k]
        if t.kind == "doc":
            if not t.text.startswith(("//!", "/*!")):
                start = start or t
                doc += _doc_lines(t)
            k += 1
            continue
        if t.text == "#" and k + 1 < len(body):
            start = start or t
            k += 2 if body[k + 1].kind == "[" else 3
            continue
        start = start or t
        if t.text == "pub":
            public = not (k + 1 < len(body) and body[k + 1].kind == "(")
            k += 1 if public else 2
            continue
        name = body[k + 1].text if k + 1 < len(body) and body[k + 1].kind == "word" else None
        if t.text in _SKIPPED and not (t.text == "const" and name not in (None, "fn", "unsafe", "async", "extern")):
            k += 1
            continue
        stop = next((j for j in range(k, len(body)) if body[j].kind == "{" or body[j].text == ";"), len(body))
        if t.text == "fn":
            given = next((j for j in range(k, stop) if body[j].kind == "("), None)
            if name is None or given is None:
                raise _Unreadable
            tail = body[given + 1 : stop]
            arrow = next((j for j in range(len(tail) - 1) if tail[j].text == "-" and tail[j + 1].text == ">"), None)
            where = next((j for j, x in enumerate(tail) if x.text == "where"), len(tail))
            facts = signature_facts(body[given].inner, tail[arrow + 2 : where] if arrow is not None else None)
            cause = halt(body[stop].inner) if stop < len(body) and body[stop].kind == "{" else None
            piece(name, "fn", ([("Halts", cause, SOMETIMES)] if cause else []) + facts)
        elif t.text == "struct" and name:
            facts = []
            if stop < len(body) and body[stop].kind == "{":
                for part in _parts(body[stop].inner):
                    part = tuple(x for x in part if x.kind != "doc")
                    colon = next((j for j, x in enumerate(part) if x.text == ":"), None)
                    if colon and part[colon - 1].kind == "word":
                        facts += _misnumbered(part[colon - 1].text, part[colon + 1 :])
            piece(name, "struct", facts)
        elif t.text in ("enum", "trait", "const", "static", "type") and name and not (inside_impl and t.text == "type"):
            piece(body[k + 2].text if name == "mut" and k + 2 < len(body) else name, t.text, [])
            if t.text in ("const", "static", "type"):
                stop = next((j for j in range(k, len(body)) if body[j].text == ";"), len(body))
        elif t.text in ("impl", "mod") and stop < len(body) and body[stop].kind == "{":
            found += _items(body[stop].inner, t.text == "impl")
        k = stop + 1
        reset()
    return found


def findings(source: str) -> list[Piece]:
    """Items of a file in order, its own note first; nothing if it can't be read."""
    body = trees(source)
    if body is None:
        return []
    about = _trim([x for t in body if t.kind == "doc" and t.text.startswith(("//!", "/*!")) for x in _doc_lines(t)])
    try:
        items = _items(body)
    except _Unreadable:
        return []
    return ([Piece("", "file", True, 0, 0, True, about, [])] if about else []) + items
