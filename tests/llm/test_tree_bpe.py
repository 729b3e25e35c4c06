import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from paperloom.llm import tree_bpe
from tests.llm import fixtures


@pytest.fixture(scope="module")
def codec():
    return tree_bpe.Codec(tree_bpe.read_ranks(tree_bpe.default_path()))


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_the_root_is_the_leftmost_least():
    r = random.Random(0)
    for n in (1, 2, 3, 7, 64, 65):
        values = [r.randrange(5) << 40 | i for i in range(n)]
        tree = tree_bpe.Tree([*values])
        for _ in range(200):
            assert tree.least() == min(values)
            i = r.randrange(n)
            values[i] = r.choice([tree_bpe.NONE, r.randrange(5) << 40 | i])
            tree.put(i, values[i])


def test_digest_is_the_library(spark, library):
    want = {}
    for i, text, *_ in fixtures.rows():
        ids = library.encode_ordinary(text or "")
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest())
    assert {r[0]: tuple(r[1:]) for r in tree_bpe.digest(fixtures.frame(spark)).collect()} == want
    assert tree_bpe.digest(fixtures.empty(spark)).count() == 0


def test_words_of_all_widths(codec, library):
    r = random.Random(1)
    texts = ["".join(r.choice("abcdeéñ日😀 \n1.'st\x1c\x85") for _ in range(r.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * n for n in range(1, 140)] + ["ab" * 3000 + " " * 700, "x\x00" * 50, "<|endoftext|> it's 12", "new" * 21 + "é"]
    assert codec.encode(texts) == [",".join(map(str, library.encode_ordinary(t))) for t in texts]
    for word in ("thequick" * 7, "ñandú" * 8, "z" * 63):
        assert codec.merged_many([word.encode()], 64)[0] == codec.merged(word.encode())


def test_many_distinct_words_are_forgotten_and_learnt_again(library, monkeypatch):
    monkeypatch.setattr(tree_bpe, "KEPT", 20)
    monkeypatch.setattr(tree_bpe, "SHORT", 9)
    monkeypatch.setattr(tree_bpe, "MANY", 3)
    codec = tree_bpe.Codec(tree_bpe.read_ranks(tree_bpe.default_path()))
    r = random.Random(2)
    for _ in range(8):
        texts = [" ".join("".join(r.choice("abcdefg") for _ in range(r.randint(2, 14))) for _ in range(15)) for _ in range(3)]
        assert codec.encode(texts) == [",".join(map(str, library.encode_ordinary(t))) for t in texts]


def test_round_trip_nulls_and_repeated_rows(spark):
    docs = fixtures.frame(spark, [(None, "hé 😀\n\n x", "en", "s", 1, "x"), (1, None, "en", "s", 1, "x"), (1, None, "en", "s", 1, "x")])
    back = tree_bpe.decode(tree_bpe.encode(docs)).collect()
    assert sorted(r["text"] for r in back) == ["", "", "hé 😀\n\n x"]
