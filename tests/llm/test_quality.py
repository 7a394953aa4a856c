import random

import regex
from helpers_llm import sentence

from ledgerloom.llm import quality


def results(df):
    return {r["row"]["doc_id"]: r for r in quality.judged(df).collect()}


def brute_repeats(words):
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    return len(covered)


def test_figures_of_odd_texts(documents):
    looped = " ".join(["a b c d e f g h"] * 3 + ["x"] * 12)
    got = results(documents([
        (1, None), (2, ""), (3, " \t\n "), (4, "a|b # $x\n\na|b # $x\n"), (5, looped), (None, "one two"),
    ], clashes=True))
    assert [(got[i].n_words, got[i].word_chars, got[i].kept) for i in (1, 2, 3)] == [(0, 0, False)] * 3
    assert (got[4].n_symbols, got[4].n_dup_lines, got[4].n_words) == (6, 1, 6)
    assert got[5].n_repeat_words == brute_repeats(looped.split())
    assert got[None].n_words == 2 and got[1].cleaned is None


def test_failed_lines_go_and_texts_that_lose_too_much(documents):
    good = [sentence(15, i) for i in range(4)]
    bad = ["Home | News | Shop | Help | About", "Enable cookies, and do it soon.", "BUY THE BEST PHONES NOW!",
           "this line just stops", "No%%% way*** out### of$$$ here&&&."]
    got = results(documents([(1, "\n".join([good[0], *bad, *good[1:]])), (2, "\n".join([good[0], *bad]) + " x y"),
                             (3, "\n".join(good))]))
    assert got[1].cleaned == "\n".join(good) and got[1].kept
    assert not got[2].kept and not got[2].base_failed
    assert got[3].kept and got[3].n_lost == 0


def test_long_text_and_repeated_rows(documents):
    long = "\n".join(sentence(20, i) for i in range(5000))
    got = quality.judged(documents([(1, long), (1, long)])).collect()
    assert [(r.n_words, r.kept, r.n_repeat_words) for r in got] == [(100_000, True, 0)] * 2


def test_stage_keeps_columns(spark, documents):
    df = documents([(1, sentence(30, 1) + "\nno end"), (2, "short.")], clashes=True)
    rows = quality.stage(spark, df, "").collect()
    assert [r.doc_id for r in rows] == [1] and rows[0].text == sentence(30, 1) and rows[0].n_chars == len(rows[0].text)
    assert quality.stage(spark, df, "").columns == df.columns and rows[0]["words"] == "own words"


def brute_fails(line):
    bare = line.strip(" \t\n\v\f\r")
    words = regex.findall(r"[^\x20\x09-\x0D]+", bare)
    separators = sum(c in quality.SEPARATORS for c in bare)
    symbols = sum(c in quality.SYMBOLS for c in bare)
    capitals, letters = len(regex.findall(r"\p{Lu}", bare)), len(regex.findall(r"\p{L}", bare))
    phrases = ["cookie", "javascript", "all rights reserved", "terms of use", "terms of service", "privacy policy", "click here",
               "sign in", "log in", "sign up", "subscribe", "lorem ipsum"]
    return (bare[-1] not in quality.CLOSING or separators > 0 and 3 * separators >= len(words)
            or 10 * symbols >= sum(map(len, words)) or len(words) >= 3 and letters > 0 and 10 * capitals >= 7 * letters
            or any(regex.search(p, bare, regex.I | regex.ASCII) for p in phrases))


def test_line_rules_against_brute_force(documents):
    r = random.Random(11)
    parts = ["A", "b", "É", "é", "ǅ", "中", "ß", "İ", "\u212a", "7", "-", "#", "|", "»", "•", "&", "LOG", "in", "Log In", "cooKIE",
             "coo\u212aIE", "terms of Use", "Sign", "up", "\x85", "\u2028", "\U0001d400", "word", "Word", "WORD", "aB", "AB."]
    lines = [" \t"[:r.randrange(3)] + "".join(r.choice(parts) + r.choice(["", " ", " ", "\t"]) for _ in range(r.randrange(1, 9)))
             + r.choice([".", ".", ".", "!", "”", "", " .\r"]) for _ in range(4000)]
    texts = ["\n".join(lines[i:i + 1 + i // 4 % 4]) for i in range(0, 4000, 4)]
    got = results(documents(list(enumerate(texts))))
    failed = 0
    for i, text in enumerate(texts):
        bad = [brute_fails(line) for line in text.split("\n")]
        lost = sum(len(regex.findall(r"[^\x20\x09-\x0D]+", x)) for x, b in zip(text.split("\n"), bad) if b)
        assert got[i].n_lost == lost, text
        assert got[i].cleaned == (text if not any(bad) else "\n".join(x for x, b in zip(text.split("\n"), bad) if not b))
        failed += sum(bad)
    assert 500 < failed < 2400
