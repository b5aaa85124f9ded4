import random

import pytest

from lexiloom.llm import bpe, token_counts

P = pytest.importorskip("public_tokenizers")
LETTERS = "abcde  \n\t'.,0123456789éß中文\x1c\x85\xa0᠎ 　😀’▁<>|ＡⅧ²aaaaa   \n\n"


def odd_texts():
    rng = random.Random(1)
    return ["", " ", "x<|endoftext|>y", "a" * 3000, " " * 300, "aaaaabababab" * 99, "it's don't I'LL", "\x00a", "<s> </s> <unk> <0x0A>"] + ["".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 90))) for _ in range(1500)]


def test_ids_and_decoding_equal_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    library, own, texts = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json")), bpe.codec("byte_bpe_50k.json"), odd_texts()
    ids, at = own.encode(texts)
    for text, a, b, told in zip(texts, at[:-1], at[1:], library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids[a:b].tolist() == told.ids, text
        assert own.decode(told.ids) == library.decode(told.ids, skip_special_tokens=False)


def test_counts_equal_the_library_even_when_words_are_forgotten(monkeypatch):
    sentencepiece = pytest.importorskip("sentencepiece")
    from lexiloom.llm import merges

    monkeypatch.setattr(merges, "REMEMBERED", 50)
    library, own, texts = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")), token_counts.Counter(P.path("piece_bpe_32k.model")), odd_texts()
    assert [x for k in range(0, len(texts), 100) for x in own.counts(texts[k : k + 100])] == [len(library.encode(x)) for x in texts]


def test_vocabularies_of_another_kind_are_refused(tmp_path):
    import json

    told = json.load(open(P.path("byte_bpe_50k.json"), encoding="utf-8"))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": told["pre_tokenizer"] | {"add_prefix_space": True}}):
        (tmp_path / "x.json").write_text(json.dumps(told | change))
        with pytest.raises(ValueError, match="byte-level"):
            bpe.Codec(str(tmp_path / "x.json"))


def test_models_that_prepare_texts_are_refused(monkeypatch):
    monkeypatch.setattr(token_counts.Counter, "counts", lambda self, texts: [len(x) for x in texts])
    with pytest.raises(ValueError, match="prepares"):
        token_counts.Counter(P.path("piece_bpe_32k.model"))


def test_whole_tokens_are_proved_one_by_one():
    sentencepiece = pytest.importorskip("sentencepiece")
    library, own = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")), token_counts.counter("piece_bpe_32k.model")
    marked = [x for x in own.whole if x.startswith("▁") and not x.startswith("▁▁")][:2000]
    assert all(len(library.encode(x[1:])) == 1 for x in marked if len(x) > 1)


def test_invalid_ids_decode_with_replacement(spark):
    own = bpe.codec("byte_bpe_50k.json")
    first = own.encode(["é"])[0].tolist()
    raw = own.merges and [own.symbol[0xC3].item()]
    rows = spark.createDataFrame([(1, first), (2, raw), (3, None), (4, [])], "k int, ids array<int>")
    assert {r.k: r.text for r in bpe.decode(rows).collect()} == {1: "é", 2: "�", 3: None, 4: ""}


def test_odd_rows(odd, none, clashing):
    rows = bpe.digests(odd).collect()
    assert len(rows) == odd.count() and {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {0}
    assert bpe.digests(none).count() == 0 and token_counts.count_tokens(none).count() == 0
    assert len(bpe.encode(clashing).columns) == len(clashing.columns)
    counted = token_counts.count_tokens(clashing).collect()
    assert len(counted) == odd.count() and {(r.n_bytes, r.n_tokens, r.over_limit) for r in counted if r.doc_id in (1, 2)} == {(0, 0, False)}
    assert all(r.over_limit for r in counted if r.doc_id == 7)
