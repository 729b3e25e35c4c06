import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from paperloom.llm import bpe, token_files
from tests.llm import fixtures

sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


def test_bpe_is_the_library(spark):
    library = Tokenizer.from_file(bpe.default_path())
    want = {}
    for i, text, *_ in fixtures.rows():
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[i] = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    assert {r[0]: tuple(r[1:]) for r in bpe.digest(fixtures.frame(spark)).collect()} == want
    assert bpe.digest(fixtures.empty(spark)).count() == 0


def test_bpe_round_trip_and_nulls(spark):
    docs = fixtures.frame(spark, [(None, "hé 😀\n\n x", "en", "s", 1, "x"), (1, None, "en", "s", 1, "x"), (1, None, "en", "s", 1, "x")])
    back = bpe.decode(bpe.encode(docs)).collect()
    assert sorted(r["text"] for r in back) == ["", "", "hé 😀\n\n x"]


def test_long_words_take_the_same_merges():
    codec = bpe.Codec(bpe.read_vocabulary(bpe.default_path()))
    for word in ("ab" * 100, "x" * 200, "thequickbrownfox" * 12):
        assert codec.merge_long(word.encode()) == codec.merge_equal(np.frombuffer(word.encode(), np.uint8).reshape(1, -1))[0].tolist()


def test_token_files(spark):
    library = Tokenizer.from_file(token_files.default_path())
    start, want = 0, []
    for i, text, *_ in sorted(fixtures.rows(), key=lambda r: r[0]):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_files.digest(fixtures.frame(spark)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want
    assert token_files.digest(fixtures.empty(spark)).count() == 0


def test_token_files_of_repeated_rows_and_null_ids(spark):
    data = [(3, "a b", "en", "s", 1, "x"), (3, "a b", "en", "s", 1, "x"), (None, "c", "en", "s", 1, "x"), (1, None, "en", "s", 1, "x")]
    got = sorted(map(tuple, token_files.digest(fixtures.frame(spark, data)).select("start", "n_tokens", "doc_id").collect()))
    assert got == [(0, 1, 1), (1, 3, 3), (4, 3, 3), (7, 2, None)]


def test_blocks_round_trip_and_damage(spark, tmp_path):
    rng = np.random.default_rng(0)
    n = 40_000
    steady = np.tile(np.repeat([5, 6], 30), n // 60 + 1)[:n]
    blocks = {
        "any": rng.integers(0, 49408, n),
        "one": np.full(n, 7),
        "low": rng.geometric(0.01, n),
        "cycle": np.tile([1, 2, 3, 40000], n // 4),
        "zero": np.zeros(n, int),
        "pairs": np.array([(j * 7) % 300 if j % 17 else rng.integers(0, 300) for j in range(n)]),
        "now and then": np.where(rng.random(n) < 0.002, 9, steady),  # sure predictions that fail
        "large ids": rng.integers(0, 1 << 20, n),
        "short": np.array([3, 3, 3]),
        "single": np.array([49407]),
    }
    size = {}
    for name, ids in blocks.items():
        coded = token_files.encode_block(ids.astype("<u4"))
        assert (token_files.decode_block(coded) == ids).all(), name
        size[name] = len(coded) / len(ids)
    assert size["cycle"] < 0.4 and size["one"] < 0.4  # what repeats costs little
    assert size["low"] < 1.6 < 2.0 < size["any"] < 2.7  # order 0 learns the shares of ids
    to = str(tmp_path / "files")
    token_files.write(fixtures.frame(spark), to)
    rows = spark.read.parquet(to).toArrow().to_batches()[0].slice(0, 1).to_pydict()
    rows["blocks"][0][0] = rows["blocks"][0][0][:-40] + b"\1" * 40
    with pytest.raises(ValueError, match="damaged"):
        list(token_files.decoded(True)(iter([pa.RecordBatch.from_pydict(rows)])))


def test_word_merges_equal_the_library():
    encoder = token_files.Encoder(token_files.default_path())
    marks = "İ ñandú café Ünï×a naïve's don't 'tis <|endoftext|> x<|startoftext|>y 3.5% a b ÀÖ... ÿ!? ẞß ß. ''' é é"
    texts = ["", " ", marks, "a" * 39 + " " + "b" * 41 + " " + "Zz" * 200, "\x1c a\x1db \x85x\xa0y　z", None, "new new; NEW (new) new)"]
    for _ in range(2):  # learnt, then remembered
        ids, n = encoder.encode(pa.array(texts), 1)
        ends = np.cumsum(n)
        for t, a, b in zip(texts, ends - n, ends, strict=True):
            assert ids[a:b].tolist() == [*encoder.library.encode(t or "", add_special_tokens=False).ids, 1], t
