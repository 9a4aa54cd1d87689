"""Rows that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k_id string, k_text string, row string, tokens string, copies string, key string, part string, n string"
_EN = "the of and to in that was with for this from which have were been their time people water house would about other".split()
_FR = "le la les des est dans pour que une qui sur avec pas sont elle leur nous vous tout cette être même après maison".split()


def sentence(rng: random.Random, words: list[str], n: int) -> str:
    return " ".join(rng.choice(words) + rng.choice(("", "", "s", "ed", "ing")) for _ in range(n)).capitalize() + "."


def rows(n: int = 40, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang, words = ("en", _EN) if i % 3 else ("fr", _FR)
        text = "\n".join(sentence(rng, words, rng.randint(5, 30)) for _ in range(rng.randint(1, 6)))
        out.append((i, text, lang, f"src{i % 4}", len(text)))
    base = out[5][1]
    out += [
        (100, base, "en", "src0", len(base)),  # exact copy
        (101, base + " extra", "en", "src1", len(base) + 6),  # near copy
        (101, base + " extra", "en", "src1", len(base) + 6),  # repeated row
        (None, "A text whose number is missing.", "en", "src0", 31),
        (None, "A text whose number is missing.", "en", "src0", 31),
        (102, None, None, None, None),
        (103, "", "en", "src2", 0),
        (103, "", "en", "src2", 0),
        (104, " \n\t \n", "en", None, 5),
        (105, "!!! 123 $$$", "en", "src1", 11),
        (106, " ".join(sentence(rng, _EN, 40) for _ in range(4000)), "en", "src3", 1),  # very long, one line
        (107, "word", "en", "src0", 4),
        (None, None, None, None, None),
        (108, "Ünïcödé ｗｉｄｅ ﬁ \U0001f600 the water of the house", "fr", "src1", 40),
    ]
    return [r + ("x",) * 8 for r in out]


def docs(spark, data: list[tuple] | None = None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)
