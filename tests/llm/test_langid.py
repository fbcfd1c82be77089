"""Language identification against a plain dictionary model, on whole vocabularies and long words."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import langid


class Plain:
    """The definition, word by word and character by character."""

    def __init__(self, counts):
        self.languages = sorted({c[0] for c in counts})
        self.seen, self.grams, self.context = {}, {}, Counter()
        for language, word, n in counts:
            k = self.languages.index(language)
            self.seen.setdefault(word, [0] * len(self.languages))[k] += n
            padded = f"<{word}>"
            for end in range(1, len(padded)):
                for order in range(1, min(4, end + 1) + 1):
                    self.grams.setdefault(padded[end + 1 - order : end + 1], [0] * len(self.languages))[k] += n
        for g, v in self.grams.items():
            for k, n in enumerate(v):
                self.context[g[:-1], k] += n
        self.letters = sum(len(g) == 1 for g in self.grams)
        self.total = [sum(v[k] for v in self.seen.values()) for k in range(len(self.languages))]

    def score(self, word):
        ks = range(len(self.languages))
        if word in self.seen:
            return [math.log((self.seen[word][k] + 0.5) / (self.total[k] + 0.5 * len(self.seen))) for k in ks]
        padded, out = f"<{word}>", [0.0 for _ in ks]
        for end in range(1, len(padded)):
            for order in range(min(4, end + 1), 0, -1):
                g = padded[end + 1 - order : end + 1]
                if g in self.grams:
                    out = [out[k] + math.log((self.grams[g][k] + 0.1) / (self.context[g[:-1], k] + 0.1 * self.letters)) + math.log(0.4) * (4 - order) for k in ks]
                    break
        return out

    def predict(self, text):
        words = [w for w in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()]
        if not words:
            return "und", 0.0
        sums = [sum(x) for x in zip(*map(self.score, words), strict=True)]
        best = max(range(len(sums)), key=lambda k: (sums[k], -k))
        return self.languages[best], 1 / sum(math.exp(s - sums[best]) for s in sums)


def made(rng, n):
    alphabets = {"aa": "bdfgé", "bb": "klmn", "cc": "prstж中"}
    word = lambda x: "".join(rng.choice(alphabets[x]) + rng.choice("aeiou") for _ in range(rng.randrange(1, 4)))
    rows = []
    for i in range(n):
        x = rng.choice(list(alphabets))
        y = rng.choice(list(alphabets))
        rows.append((i, " ".join(word(x if rng.random() < 0.7 else y) for _ in range(rng.randrange(0, 9))).title() + rng.choice(["", ".", " 12", "\n"]), x if rng.random() < 0.9 else None))
    return rows


def test_equals_the_plain_model(spark):
    rows = [*made(random.Random(2), 400), (900, "x" * 3000 + " babo", "aa"), (901, None, "aa"), (902, "", None), (903, "ababab" * 500, "bb"), (904, "ζζζ ωω", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    counts = Counter()
    for i, text, lang in rows:
        if lang and text is not None and not held(i):
            for w in "".join(c if c.isalpha() else " " for c in text.lower()).split():
                counts[lang, w] += 1
    plain = Plain([(x, w, n) for (x, w), n in counts.items()])
    model = langid.train(docs)
    assert model.languages == plain.languages and len(model.words) == len(plain.seen) and len(model.grams) == len(plain.grams)
    for w in ["ba", "zzz", "xxxx", "kakiko", "prabo", "中", "<b", "é" * 40]:
        assert np.allclose(model.score(w), plain.score(w))
    texts = {i: t for i, t, _ in rows}
    for r in langid.identify(docs, model).collect():
        want = plain.predict(texts[r["doc_id"]])
        assert r["lang_pred"] == want[0] and abs(r["score"] - want[1]) < 1e-9 and r["held_out"] == held(r["doc_id"])


def test_no_word_is_dropped(spark):
    rows = [(3 * k, f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyzabcd'[k // 100 % 10]}{'efghijklmn'[k // 1000 % 10]}" * 12, "aa") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").where(langid.remainder(langid.F.col("doc_id")) != 1)
    assert len(langid.train(docs, docs_per_language=1 << 30).words) == docs.count()  # also of words over 40 letters


@pytest.mark.parametrize("order", [1, -1])
def test_fit_does_not_depend_on_the_order_of_rows(order):
    counts = [("aa", "banana", 5), ("bb", "kiklop", 5), ("aa", "kiklop", 1), ("bb", "ab", 2)][::order]
    m = langid.Model.fit(counts)
    want = Plain(counts)
    for w in ("kiklop", "banan", "q", "ab"):
        assert np.allclose(m.score(w), want.score(w))


def test_a_model_beyond_its_bound_is_an_error(spark):
    docs = spark.createDataFrame([(i, "".join(chr(97 + int(d)) for d in str(1000 + i)), "ab"[i % 2]) for i in range(40)], "doc_id long, text string, lang string")
    assert langid.train(docs, most_numbers=10_000).languages == ["a", "b"]
    with pytest.raises(ValueError, match="fewer documents"):
        langid.train(docs, most_numbers=20)
