"""The token encoder against the library, and the codec's size and damage."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from corpusloom.llm import codec, token_output, words

LETTERS = list("abcXYZéÉßœŒÿŸİıſςΣσЖжñÑµªº²½Ⅷǅ")
OTHERS = [*".,;:!?'\"-_()#$*<|>&%", "’", "'s", "'T", "'re", "́", "̇", "‍", "0", "7", "٣", "中", "😀", " ", "\t", "\n", " ", "　", "\x1c", "\x85", "\x0b", "<|endoftext|>"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(token_output.default_tokenizer())


def _differ(encoder, library, texts):
    ids, sizes = encoder.encode(pa.array(texts, pa.string()), 2)
    got = np.split(ids, np.cumsum(sizes)[:-1])
    return [t for t, own in zip(texts, got, strict=True) if own.tolist() != [*library.encode(t, add_special_tokens=False).ids, 2]]


def test_dotted_capitals_and_marks(library):
    texts = ["ŞİRKETİ.", "ŞİRKETİ, A", "BURSA ALİ!", "é. É!", "a.b. c'.", "<|startoftext|>.", "ÀÖØÞ.ÿ", "x" * 3000 + "!", "ab" * 70000]
    assert _differ(token_output.Encoder(token_output.default_tokenizer()), library, texts) == []


def test_random_texts_equal_the_library(library):
    rng = random.Random(5)
    encoder = token_output.Encoder(token_output.default_tokenizer())
    assert encoder.pieces is not None  # the shorter way is the one under test
    texts = ["".join(rng.choice(LETTERS if rng.random() < 0.6 else OTHERS) for _ in range(rng.randrange(14))) for _ in range(30000)]
    for k in range(0, len(texts), 3000):
        assert _differ(encoder, library, texts[k : k + 3000]) == []


def test_words_are_forgotten_and_met_again(library, monkeypatch):
    monkeypatch.setattr(token_output, "_CACHED", 50)
    rng = random.Random(6)
    encoder = token_output.Encoder(token_output.default_tokenizer())
    for _ in range(40):
        assert _differ(encoder, library, [" ".join(rng.choice("abcde") * rng.randrange(1, 9) + rng.choice(["", ".", "'s", "0"]) for _ in range(rng.randrange(60)))]) == []
    assert _differ(encoder, library, [""]) == _differ(encoder, library, [" \n "]) == []


def test_words_of_one_hash_stay_apart(library, monkeypatch):
    monkeypatch.setattr(words.WordIndex, "hash", classmethod(lambda cls, some: np.array([len(w) % 3 for w in some.to_pylist()], np.uint64)))
    encoder = token_output.Encoder(token_output.default_tokenizer())
    for _ in range(2):
        assert _differ(encoder, library, ["one two three four five six seven", "two six. ten! one's four"]) == []


def test_codec_beats_zlib_on_the_same_blocks(library):
    rng = random.Random(7)
    parts = [rng.choice("bcdfglmnprst") + rng.choice("aeiou") + rng.choice(["", "n", "st"]) for _ in range(150)]
    weights = [1 / (k + 1) for k in range(150)]
    text = " ".join("".join(rng.choices(parts, weights, k=rng.randrange(1, 4))) for _ in range(60000))
    ids = np.array(library.encode(text, add_special_tokens=False).ids, "<u4")
    coded = codec.encode_blocks(ids)
    assert np.array_equal(np.concatenate(codec.decode_blocks(coded)), ids)
    other = sum(len(zlib.compress(ids[i : i + codec.BLOCK_IDS].astype("<u2").tobytes(), 9)) for i in range(0, len(ids), codec.BLOCK_IDS))
    assert sum(map(len, coded)) < 0.9 * other


@pytest.mark.parametrize("block", [1, 17, codec.MAX_BLOCK])
def test_codec_of_odd_ids(block):
    rng = np.random.default_rng(block)
    for ids in (rng.integers(0, 1 << 29, 300), np.minimum(rng.zipf(1.3, 9000), 1 << 28), np.zeros(500, int), np.arange(9000), rng.integers(0, 2, 9000)):
        ids = ids.astype("<u4")[: 60 * block]
        blocks = codec.encode_blocks(ids, block, lanes=13)
        assert np.array_equal(np.concatenate(codec.decode_blocks(blocks, lanes=5)), ids)
        assert np.array_equal(codec.decode_blocks(blocks[1:2] or blocks)[0], ids[block : 2 * block] if len(blocks) > 1 else ids)
    with pytest.raises(ValueError):
        codec.encode_blocks(np.array([1 << 29]))


def test_damage_is_found():
    rng = np.random.default_rng(3)
    ids = np.minimum(rng.zipf(1.4, 4000), 40000).astype("<u4")
    blocks = codec.encode_blocks(ids)
    for _ in range(60):
        k = int(rng.integers(len(blocks)))
        bad = bytearray(blocks[k])
        bad[int(rng.integers(len(bad)))] ^= 1 << int(rng.integers(8))
        with pytest.raises(codec.CorruptBlock):
            codec.decode_blocks([bytes(bad)])


def test_long_texts_go_in_parts(library, monkeypatch):
    rng = random.Random(8)
    text = "  ".join(rng.choice(["Ab", "cd.", "éf", "İ!", "x" * 90, "\t9"]) for _ in range(3000))
    texts = [text, "y" * 5000, f" {text}\n", "z" * 900 + " " + "w" * 900]
    whole = token_output.Encoder(token_output.default_tokenizer())
    monkeypatch.setattr(token_output, "TEXT_BYTES", 200)
    parts = token_output.Encoder(token_output.default_tokenizer())
    for t in texts:
        assert _differ(parts, library, [t]) == []
        assert np.array_equal(parts.encode(pa.array([t]), 2)[0], whole.encode(pa.array([t, ""]), 2)[0][:-1])
