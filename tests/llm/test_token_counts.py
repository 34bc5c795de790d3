import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from graphloom.llm import registry, token_counts as tc

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a b", "'", "r", "e", "s", "'re", "'ll", "ll", "v", " ", "  ", "\n", "\t", "\r\n", "1", "23", "!", "--", "<|endoftext|>", "<|endof", "text|>", "é", "ß", "漢字", "😀", " ", "\xa0", "the", " The", " international", "izing", "\x1c", "́", "²", "Ⅷ", "aaaa", "ing", "​", "\x85", "''", "'s", "'d", "'T", "-----"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def machine():
    with open(PATH, encoding="utf-8") as file:
        definition = file.read()
    return tc.Compiled(definition, tc.code_point_kinds(definition), 1 << 16)


def counted(machine, texts):
    pieces = [t.encode() for t in texts]
    edges = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
    return machine.count(np.frombuffer(b"".join(pieces), np.uint8), edges).tolist()


def expected(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(PARTS), max_size=20).map("".join)), min_size=1, max_size=8))
def test_counts_are_the_librarys(machine, library, texts):
    assert counted(machine, texts) == expected(library, texts)


def test_every_code_point_has_the_librarys_class(machine, library):
    rng = random.Random(3)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(x for c in rng.sample(points, 400) for x in (rng.choice("a1! "), c, rng.choice("a1! "))) for _ in range(40)]
    assert counted(machine, texts) == expected(library, texts)


def test_long_words_and_few_states(library):
    with open(PATH, encoding="utf-8") as file:
        definition = file.read()
    small = tc.Compiled(definition, tc.code_point_kinds(definition), 50)
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (300, 5000, 200_000)]
    texts = ["a" * 100_001, *words, "-" * 777, " " * 1000 + "x", "'ll " * 500]
    assert counted(small, texts) == expected(library, texts)


def test_scan_equals_one_walk():
    cutter, rng = tc.Cutter(), np.random.default_rng(1)
    assert cutter.reset == 4
    symbols = rng.integers(0, 2 * tc.N_CLASSES, 5000).astype(np.uint8)
    symbols[0] = tc.N_CLASSES
    walked, state = np.zeros(5000, bool), tc.BEGIN
    for i, s in enumerate(symbols):
        says = cutter.says[state, s]
        walked[i] |= bool(says & tc.HERE)
        if i and says & tc.BEFORE:
            walked[i - 1] = True
        state = cutter.next[state, s]
    for width in (1, 2, 3, 7, 64, 5000, 9999):
        found = cutter.starts(symbols, width)
        assert (found[:-1] == walked[:-1]).all()


def test_table_of_odd_rows(spark, library):
    texts = ["", None, "it's <|endoftext|> we'll", "same", "same", "x" * 3_000_000, " ", "\n\n", "word " * 100_000]
    rows = [(i if i else None, t, 7) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)
    got = sorted(((r["doc_id"] or 0), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tc.token_counts(docs).collect())
    plain = [t or "" for t in texts]
    assert got == [(i, len(t.encode()), n, n > 512) for i, (t, n) in enumerate(zip(plain, expected(library, plain), strict=True))]
    assert tc.token_counts(docs.where("false")).count() == 0


def test_other_tokenizers_are_refused(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        tc.token_counts(docs, public_tokenizers.path("word_bpe_49k.json"))


def test_query_on_whole_documents(spark, library):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").toPandas()
    got = registry.QUERIES["op11_token_counts"](spark, d).toPandas().set_index("doc_id").loc[docs["doc_id"]]
    plain = docs["text"].fillna("").tolist()
    assert got["n_tokens"].tolist() == expected(library, plain)
    assert got["n_bytes"].tolist() == [len(t.encode()) for t in plain]
