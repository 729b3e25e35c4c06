"""Small tables with nulls, empty and long texts, ties, repeated rows, copies, shared passages and a column of a clashing name."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string"


def sentence(r: random.Random, n: int, words: list[str]) -> str:
    return " ".join(r.choice(words) for _ in range(n))


def rows(n: int = 60, seed: int = 3) -> list[tuple]:
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgäé") for _ in range(r.randint(2, 7))) for _ in range(400)]
    passage = sentence(r, 40, words)
    out = []
    for i in range(n):
        text = ". ".join(sentence(r, r.randint(5, 60), words) for _ in range(r.randint(1, 6)))
        if i % 5 == 0:
            text += "\n" + passage
        if i % 7 == 3 and out:
            text = out[r.randrange(len(out))][1] or ""
            if i % 2 and text:  # a near copy
                w = text.split(" ")
                w[len(w) // 2] = "changed"
                text = " ".join(w) + " tail"
        out.append((i, text, ["en", "de", None][i % 3], ["a", "a", "b", None][i % 4], len(text), "x"))
    big = sentence(r, 6000, words)
    out += [
        (n, None, None, None, None, "x"), (n + 1, "", "en", "a", 0, None), (n + 2, " \t\n", "en", "a", 3, "x"), (n + 3, "One", "en", "b", 3, "x"), (n + 4, "one two Three four", "en", "b", 18, "x"),
        (n + 5, big, "en", "c", len(big), "x"), (n + 6, big.upper() + " ", "en", "c", len(big) + 1, "x"), (n + 7, "a" * 5000 + "<|endoftext|> it's 12", "en", "c", 5021, "x"), (n + 8, big, "en", "c", len(big), "x"),
        (n + 9, "日本語 テスト 😀 αβγ x\x1cy 12,5", "ja", "d", 20, "x"),
    ]
    return out


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
