import random

import pytest

from hrefwarden.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")

ODD = [
    "", "   ", "İstanbul ΣΑΣ ſ K Å", "<|endoftext|>a<|startoftext|> <|EndOfText|>", "'S it's 're'll", "日本語テキスト 123 ٣", "a" * 3000,
    "ab" * 500 + "1" * 50, "é é ²½\x1c\x85 x", "naïve ŉ ĳ ß ẞ ÿ Ÿ", "🙂🙂👍🏽", "\x00\x01a\x7f", "...!!!???" * 40, "a\xa0b", "ªº µ", "<|endoftext|", "Σς",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, encoding="utf-8") as file:
        return bpe.Vocabulary(file.read())


def random_texts(n):
    rng = random.Random(3)
    letters = [chr(c) for c in (*range(32, 127), *range(0xA0, 0x250), 0x301, 0x3A3, 0x1E9E, 0x4E00, 0x1F600, 9, 10, 0x2028, 0x85, 0x1D)]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(n)]


def test_same_ids_and_texts_as_the_library(library, vocabulary):
    for text in ODD + random_texts(3000):
        ids = library.encode(text, add_special_tokens=False).ids
        assert vocabulary.encode(text) == ids, text
        assert vocabulary.decode(ids) == library.decode(ids, skip_special_tokens=False), text


def test_no_token_reaches_across_a_cut(vocabulary):
    for piece in ("thblelyou", "xqzjvk", "ÃªÃ©zz", "qqqq"):
        parts = vocabulary.fragments(piece)
        assert "".join(parts) == piece
        for a, b in zip(parts, parts[1:]):
            assert not any(a[-1] + b[0] in token for token in vocabulary.ids)


def test_heap_and_scan_merge_alike(vocabulary):
    rng = random.Random(9)
    for _ in range(300):
        units = [rng.choice("abcdeinort") for _ in range(rng.randint(1, 60))]
        assert vocabulary._by_heap(list(units)) == vocabulary._by_scanning(list(units))


def test_columns_and_edges(spark, library):
    rows = [(1, "The cat", "x"), (1, "The cat", "x"), (2, None, None), (None, "", "y"), (4, "a " * 5000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    done = bpe.decoded(bpe.encoded(docs, PATH), PATH)
    assert done.columns == ["doc_id", "text", "ids", "decoded"]
    found = [(r.doc_id, r.ids, r.decoded) for r in done.collect()]
    cat = library.encode("The cat", add_special_tokens=False).ids
    many = library.encode("a " * 5000, add_special_tokens=False).ids
    assert found == [(1, cat, "the</w> cat</w>")] * 2 + [(2, None, None), (None, [], ""), (4, many, library.decode(many))]
    assert bpe.encoded(docs.limit(0), PATH).collect() == []
