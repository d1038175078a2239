"""Texts that hold every hard case."""

import random

WORDS = "amber birch cedar dune ember frost glade heath inlet jetty knoll larch marsh north ochre plain quartz ridge slate thorn umber vale wharf yield zephyr".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, n int, text_a string, first int, _text string, score double, h1 long, size int, word string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def changed(text: str, seed: int, n: int) -> str:
    r, words = random.Random(seed), text.split(" ")
    for i in r.sample(range(len(words)), n):
        words[i] = "changed" + str(r.randrange(1000))
    return " ".join(words)


def texts() -> list:
    """Nulls, blanks, short, long, exact and near copies, chains of near copies, shared passages, odd characters."""
    base, passage = prose(1, 200), prose(2, 60)
    out = [None, "", " \t\n ", "one", "One", "two words", "TWO  words", base, base, base.upper(), changed(base, 3, 3), changed(base, 4, 8)]
    chain = prose(5, 120)
    for i in range(6):
        out.append(chain)
        chain = changed(chain, 10 + i, 4)
    out += [prose(20, 30) + " " + passage + " " + prose(21, 30), passage, prose(22, 10) + "\n" + passage.replace(" ", "  "), passage + " " + passage, prose(23, 49), prose(23, 49), prose(24, 50), prose(24, 50)]
    out += [prose(30, 4000), prose(30, 3990), "a" * 300_000, "x " * 3000, " café naïve 你好 \U0001f600 MIT License, apache-license; GENERAL public\nlicense", "line one\nline one\n\n\nline one \n#*$%&|<>", "%5 \x0b\x0c\x1c\x85   x"]
    out += [prose(40 + i, 80) for i in range(8)]
    return out


def by_id(df, key: str = "doc_id") -> dict:
    return {r[key]: r for r in df.collect()}
