"""Invented texts."""

import random


def pseudo_words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choices("aeioklmnrst", k=r.randint(2, 7))) for _ in range(n)]


def sentence(n, seed):
    return " ".join(pseudo_words(n, seed)).capitalize() + "."
