"""Small documents with the awkward cases, and brute force beside each operator."""

from __future__ import annotations

import random

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, size long, copies int, key long, block int"


def rows(texts: list[tuple[int | None, str | None]], sources=("a", "b", None, "c")):
    return [(d, t, "en", sources[i % len(sources)], len(t or ""), -1, -1, -1, -1) for i, (d, t) in enumerate(texts)]


def frame(spark, texts, **how):
    """A table of documents; its last columns have names that operators use inside."""
    return spark.createDataFrame(rows(texts, **how), SHAPE)


def prose(seed: int, n: int, words: int = 60) -> list[str]:
    r = random.Random(seed)
    stock = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(400)]
    return [" ".join(r.choice(stock) for _ in range(r.randint(1, words))) for _ in range(n)]


def awkward(seed: int = 1) -> list[tuple[int | None, str | None]]:
    """Nulls, empty and blank texts, copies, shared passages, one long text, repeated rows, no order."""
    r, base = random.Random(seed), prose(seed, 60)
    passage = " ".join(prose(seed + 1, 3, 40)) + " this passage is in several of the texts, word for word, and is long enough"
    texts: list[str | None] = [None, "", " \t\n", "é", "é " * 40, "\x00\x01", "a" * 300, "ab " * 200, *base, *base[:5], base[7], base[7]]
    texts += [x + " " + passage + "\n" + y for x, y in zip(base[10:20], base[20:30])]
    texts += ["shared line of text\nother " + x + "\n  SHARED line of text \n" for x in base[30:35]]
    texts.append("\n".join(prose(seed + 2, 400)))
    ids: list[int | None] = list(range(len(texts)))
    r.shuffle(ids)
    out = list(zip(ids, texts))
    return [*out, out[12], out[12], (out[13][0], out[14][1]), (None, base[3]), (None, None), (-5, base[4])]
