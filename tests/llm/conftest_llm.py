"""Texts that the tests share."""


def words(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))


#: Null, empty, white, one word, ties, a repeated row and a very long text.
ODD = [None, "", " \n\t", "word", "word", words(1, 60), words(1, 60), words(2, 30_000), "ÄÖ 漢字 \U0001f600 x", "a " * 300]
