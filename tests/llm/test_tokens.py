import random
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers_llm import pseudo_words
from hypothesis import given, settings, strategies as st
from tokenizers import Regex, Tokenizer, pre_tokenizers

from ledgerloom.llm import tokens
from ledgerloom.llm.encoder import Encoder
from ledgerloom.llm.wavelet import TokenFile, write

PATH = public_tokenizers.path(tokens.VOCABULARY)
PARTS = [" ", "\n", "a", "b.", "é", "'s", "1", "\t", "\xa0", "  ", "!!", "<|endoftext|>", "　", "\x1d", "word", "\r\n", "\x85", "😀"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=14).map("".join), min_size=1, max_size=6))
def test_ids_are_the_librarys(texts):
    encode = Encoder(PATH)
    for _ in range(2):  # unknown words, then known ones
        assert [e.tolist() for e in encode.encode(texts)] == [
            encode.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_come_without_the_places_of_tokens(library):
    encode = Encoder(PATH)
    encode.tokenizer = SimpleNamespace(encode_batch_fast=library.encode_batch_fast)  # nothing else is called
    texts = [" ".join(pseudo_words(300, 3)), "a  b\tc", "x <|endoftext|> y\n\nz", "", None, "é 😀\nword's"]
    for _ in range(2):
        assert [e.tolist() for e in encode.encode(texts)] == [
            library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_new_words_cost_only_their_new_pieces(library):
    asked, encode = [], Encoder(PATH)

    def encode_batch_fast(texts, **options):
        asked.extend(texts)
        return library.encode_batch_fast(texts, **options)

    encode.tokenizer = SimpleNamespace(encode_batch_fast=encode_batch_fast)
    words = pseudo_words(300, 5)
    encode.encode(["\n".join(words), " ".join(["a", *words]), "( , .\n(\n)\n,\n.\n!!\n7"])
    asked.clear()
    texts = [" ".join(f"({w})" for w in words), "\n".join(f"{w}, {w}!!{w} {w}7." for w in words)]
    assert [e.tolist() for e in encode.encode(texts)] == [library.encode(x, add_special_tokens=False).ids for x in texts]
    assert len("".join(asked)) < 20  # most of it: " (", the line breaks


def test_pieces_are_cut_where_the_library_cuts(library):
    # letters, numbers, marks, signs and spaces of many scripts, and what no version of Unicode knows
    r = random.Random(4)
    signs = "aZ09.,'!_-()#äßñ²½Ⅷ٣\u0301\u200b\u200d\xa0\u2009\x1f\0中ーกำ한𝒜😀👍🏽\ue000\U000e0001\U0001fbf0\u0378\U0002ebf0" + "".join(
        chr(c) for c in (r.randrange(0x21, 0x30000) for _ in range(3000)) if not 0xD800 <= c < 0xE000)
    added = ["'s", "'ll", "<|endoftext|>", "endoftext", "x'"]
    encode = Encoder(PATH)
    for _ in range(30):
        words = ["".join(r.choices([*r.choices(signs, k=12), *signs[:20], *added], k=r.randint(1, 9))) for _ in range(200)]
        texts = ["".join(w + r.choice(" \n") for w in words[i:i + 10]).strip() for i in range(0, 200, 10)]
        for text, found in zip(texts, encode.encode(texts)):
            assert found.tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("c", ["\x1c", "\x1f", "\x85", "\xa0", "\u2009", "\u3000"])
def test_odd_spaces_alone_and_within_words(library, c):
    encode = Encoder(PATH)
    for text in (f"x {c} y\n{c}\nz", f"a{c}b c{c}{c}", f"a{c}b\na{c}!b {c}", f"a{c}b c"):
        assert encode.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("limit", ["MOST_KNOWN", "MOST_IDS", "AT_ONCE"])
def test_ids_stay_the_same_when_words_are_forgotten_or_taken_up_in_parts(library, monkeypatch, limit):
    monkeypatch.setattr(f"ledgerloom.llm.encoder.{limit}", 40)
    encode = Encoder(PATH)
    for seed in range(12):
        text = "\n".join(f"{w}, ({w}) {w}" for w in pseudo_words(50, seed // 2))
        assert encode.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_words_stay_whole_for_tokenizers_with_other_pieces(library, tmp_path):
    library = Tokenizer.from_str(library.to_str())
    library.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(r"[^\s\p{L}\p{N}]?\p{L}+|\p{N}| ?[^\s\p{L}\p{N}]+|\s"), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    library.save(f"{tmp_path}/other.json")
    encode, text = Encoder(f"{tmp_path}/other.json"), "\n".join(f"({w}).{w}7\n!{w}" for w in pseudo_words(50, 6))
    assert encode.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def brute(library, docs):
    at, out = 0, []
    for d, text in docs:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_files_hold_all_documents_in_order(spark, documents, library, folder):
    r = random.Random(1)
    docs = [(i, " ".join(pseudo_words(r.randrange(60), i))) for i in range(200)] + [(-5, None), (1000, ""), (1001, "x y " * 30_000)]
    shuffled = random.Random(2).sample(docs, len(docs))
    shards = tokens.encode_shards(documents(shuffled, clashes=True), PATH, folder, shard=500)
    assert shards.count() > 10
    assert sorted(map(tuple, tokens.read_documents(shards).collect()), key=lambda r: r[1]) == brute(library, sorted(docs))


def test_null_and_repeated_ids(spark, documents):
    docs = documents([(2, "a"), (None, "b"), (2, "c c"), (2, "a"), (None, None)])
    rows = sorted((tuple(r) for r in tokens.stage(spark, docs, "").collect()), key=lambda r: r[1])
    assert [r[0] for r in rows] == [None, None, 2, 2, 2] and sum(r[2] for r in rows) == rows[-1][1] + rows[-1][2]


def test_empty_table(spark, documents):
    assert tokens.stage(spark, documents([]), "").count() == 0


@pytest.mark.parametrize("n,top", [(0, 5), (1, 1), (70_000, 300), (140_000, 50_257)])
def test_wavelet_answers_like_the_plain_ids(tmp_path, n, top):
    ids = np.random.default_rng(n).zipf(1.4, n).astype(np.int64) % top
    ids = ids.astype(np.uint16)
    write(f"{tmp_path}/x.tokens", ids, pa.array([1]), [n])
    file = TokenFile(f"{tmp_path}/x.tokens")
    assert (file.tokens() == ids).all() and file.documents().to_pydict() == {"doc_id": [1], "n_tokens": [n]}
    for i in {0, 1, n // 2, 65_535, 65_536, n - 1}:
        if 0 <= i < n:
            assert file.token(i) == ids[i]
    for token in {0, 1, 7, int(ids[n // 2]) if n else 3, top - 1, 1 << 17}:
        places = np.flatnonzero(ids == token)
        assert file.count(token) == len(places) and file.count(token, n // 3, n // 2) == ((places >= n // 3) & (places < n // 2)).sum()
        for k in {0, len(places) // 2, len(places) - 1}:
            if 0 <= k < len(places):
                assert file.find(token, k) == places[k]
        with pytest.raises(IndexError):
            file.find(token, len(places))
    file.close()
