import pytest

from lexiloom.functions import code


def facts(source):
    return [(f, a) for p in code.findings(source) for f, a, _ in p.facts]


@pytest.mark.parametrize(
    "source,fact,args",
    [
        ("fn oldest(shelf: &[Book]) -> Option<Book> { None }", "MayBeAbsent", []), ("impl Shelf { fn empty(&mut self) {} }", "Alters", []), ("impl Shelf { fn weight(&self) -> u64 { 7 } }", "Number", []),
        ("fn sort(title: Vec<Book>) {}", "Misnumbered", ["title", "singular", "plural"]), ("fn open() -> Result<Door, Stuck> { todo() }", "MayFail", []), ("fn keys() -> Vec<Key> { vec![] }", "Many", []), ("fn ring() {}", "Silent", []), ("fn lend(book: Book, reader: &str) {}", "Takes", ["book", "reader"]),
        ("struct Hall { door: Vec<Door>, windows: Vec<Pane> }", "Misnumbered", ["door", "singular", "plural"]), ("mod hall { pub fn dark() -> bool { false } }", "YesOrNo", []), ('fn key() -> Key { ring.expect("a ring") }', "Halts", ["Expects", "a ring"]),
        ("fn tile(floor: &[Tile], side: usize) { assert_eq!(floor.len(), side * side); }", "Halts", ["Equal", "floor.len()", "side * side"]), ('fn lamp() -> Lamp { hall.pop().unwrap_or_else(|| panic!("too dark: {}", 3)) }', "Halts", ["Says", "too dark"]),
    ],
)
def test_facts(source, fact, args):
    assert (fact, args) in facts(source)


@pytest.mark.parametrize("source", ["fn top(pile: &[Card]) -> Card { *pile.last().unwrap() }", "fn top(pile: Option<Card>) -> Card { pile.expect() }", 'fn top() -> Card { panic!("the `pile` fell") }', "fn deal(pile: &[Card]) { debug_assert!(pile.len() > 3); }"])
def test_no_cause_is_no_stop(source):
    assert "Halts" not in [f for f, _ in facts(source)]


@pytest.mark.parametrize("check", ["left != right", "!pile.is_full()", "rows < crate::LIMIT", "matches!(card, 3 | 4)", "depth == -7", "(wide + high) * deep", "open && lit || !locked", "row[2] <= row[5]", "cards as u16 == 9", "&old == &new", "hall.door().lock(key, hand)", "turn(-4, 9)", "2.5_f32 / 4.0", "*lamp == 3"])
def test_checks_are_written_back_as_they_were(check):
    assert code.tight(code.trees(check)) == check


def test_items_and_notes():
    found = code.findings("//! The hall.\n\n/// Lights a lamp.\n///\n/// It stays lit.\npub fn light(lamp: u8) -> u8 { lamp }\n\nenum Door { Shut }\npub(crate) const DOORS: u8 = 4;\n// aside\ntype Key = u8;\n")
    assert [(p.name, p.kind, p.public, p.line, p.documented) for p in found] == [("", "file", True, 0, True), ("light", "fn", True, 3, True), ("Door", "enum", False, 8, False), ("DOORS", "const", False, 9, False), ("Key", "type", False, 11, False)]
    assert found[1].doc == ["Lights a lamp.", "", "It stays lit."]
    assert code.findings("fn (((") == [] and code.findings("") == []
