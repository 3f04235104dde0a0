"""Cuts and classes against the tokenizer library."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from folioscope.llm import pretokens, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def table():
    return pretokens.classes()


def spans(library, text):
    return [list(span) for _, span in library.pre_tokenizer.pre_tokenize_str(text)]


def cut(texts, table):
    found = pretokens.Cut(texts, np.frombuffer(table, np.uint8))
    at, out = 0, []
    for i, t in enumerate(texts):
        some = slice(found.first[i], found.first[i + 1])
        out.append([[int(a) - at, int(b) - at] for a, b in zip(found.starts[some], found.ends[some])])
        at += len(t)
    return out


def test_classes_agree_with_the_library(library, table):
    """All code points that both know, in contexts that tell the classes apart."""
    codes = [c for c in range(0x30000) if table[c] != pretokens.UNASSIGNED]
    for i in range(0, len(codes), 3000):
        some = codes[i:i + 3000]
        text = "".join(f"a{chr(c)}a1{chr(c)}1!{chr(c)}!\n" for c in some)
        starts = {a for a, _ in spans(library, text)}
        for k, c in enumerate(some):
            at = 10 * k
            kind = 1 if at + 1 not in starts else 2 if at + 4 not in starts else 0 if at + 7 not in starts else 3
            assert kind == table[c], hex(c)


def test_cuts(library, table):
    draw = random.Random(5)
    pieces = ["a", "b", "s", "t", "re", "ve", "ll", "m", "d", "'", "''", " ", "  ", "\n", "\t", " ", "　", "1", "2²", "!", ".", "é", "ß", "日", "\U0001F600", "\x00", "\x1c", "\x85", "’"]
    texts = ["", "'", "'s", " 's", "x's", "x''s", "don't 've'll", "'stop", "'S", "' s", " ", "  ", "\n", " \n a", "a\n\nb", "a \n", "a's's t'll", "'re're're", "!'t", "1'd2"]
    texts += ["".join(draw.choice(pieces) for _ in range(draw.randrange(30))) for _ in range(3000)]
    assert cut(texts, table) == [spans(library, t) for t in texts]


def test_ids_equal_the_library(library, table):
    draw = random.Random(6)
    words = ["the", " the", "Zwölf", "naïve", "don't", "  \n", "x" * 40, "日本語の文章", "<|endoftext|>", "\U0001F600\U0001F600", "͸", " 12345", "‘q’"]
    texts = ["".join(draw.choice(words) for _ in range(draw.randrange(20))) for _ in range(400)] + ["", "y" * 5000, "͸"]
    encode = token_files._Encoder(PATH, table)
    assert encode.memory is not None
    encode.memory.limit, encode.memory.FRESH = 200, 20
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for first in range(0, len(texts), 50):
        assert [x.tolist() for x in encode(texts[first:first + 50])] == want[first:first + 50]


def test_another_tokenizer_is_asked_whole(table):
    path = public_tokenizers.path("word_bpe_49k.json")
    encode, texts = token_files._Encoder(path, table), ["Hello  World's", "", "a<|startoftext|>b"]
    assert encode.memory is None
    assert [x.tolist() for x in encode(texts)] == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
