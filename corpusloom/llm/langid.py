"""Language identification by words first, character n-grams for the rest.

Known words score by their log frequency in each language. Unseen words are read character by character:
each takes the longest known n-gram that ends there, and backs off to a shorter one, at a price, where it is unknown.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, table, text_slices
from .words import WordIndex

#: Bound of the sample of labelled rows that the model is fitted on: documents a language on average.
DOCS_PER_LANGUAGE = 2_000
#: Numbers that a model of words and languages may have: its largest table.
MODEL_NUMBERS = 30_000_000
MAX_ORDER = 4
#: What a step to the next shorter n-gram costs; alike for all languages.
BACKOFF = math.log(0.4)
_SPLIT = r"[^\p{L}\p{M}]+"
#: Unseen words that are read at a time.
_CALL_WORDS = 50_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _characters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of words, each between ``<`` and ``>``, one word after the other, and where each word begins."""
    marked = pc.binary_join_element_wise(*(pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in ("<", words.cast(pa.large_string()), ">", "")))
    sizes = pc.utf8_length(marked).to_numpy(zero_copy_only=False).astype(np.int64)
    text = marked.buffers()[2].to_pybytes()[: int(pc.sum(pc.binary_length(marked)).as_py() or 0)] if len(marked) else b""
    return np.frombuffer(text.decode().encode("utf-32-le"), "<u4").astype(np.uint64), np.cumsum(sizes) - sizes


def _grams(points: np.ndarray, inside: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of ``order`` characters that end at each place: where, its 64-bit name, and the name of all but its last one."""
    at = np.flatnonzero(inside >= max(1, order - 1))  # the first character alone tells nothing
    name = np.full(len(at), order, np.uint64)
    before = name - np.uint64(1)
    for k in range(order - 1, -1, -1):
        before = name if k == 0 else before
        name = (name ^ points[at - k]) * _ODD
        name ^= name >> np.uint64(31)
    return at, name, before if order > 1 else np.zeros(len(at), np.uint64)


def _inside(starts: np.ndarray, total: int) -> np.ndarray:
    return np.arange(total) - np.repeat(starts, np.diff(np.append(starts, total)))


@dataclass
class Model:
    """Log frequencies by language of ``words``, and log probabilities of n-grams, by the sorted names of these."""

    languages: list[str]
    words: WordIndex
    word_logs: np.ndarray
    grams: np.ndarray
    gram_logs: np.ndarray

    @classmethod
    def fit(cls, counts: list[tuple[str, str, int]] | pa.Table) -> Model:
        """From (language, word, count) rows, in any order."""
        rows = counts if isinstance(counts, pa.Table) else pa.table(dict(zip(("lang", "word", "n"), map(list, zip(*counts, strict=True)), strict=True))) if counts else pa.table({"lang": pa.array([], pa.string()), "word": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
        languages = sorted(pc.unique(rows["lang"]).to_pylist())
        width = len(languages)
        if not width:
            return cls([], WordIndex(), np.zeros((0, 0)), np.zeros(0, np.uint64), np.zeros((0, 0)))
        of = pc.index_in(rows["lang"], pa.array(languages)).to_numpy().astype(np.int64)
        n = rows["n"].to_numpy().astype(np.float64)
        coded = rows["word"].combine_chunks().cast(pa.large_string()).dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        order = pc.array_sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        code = place[coded.indices.to_numpy()]
        words = coded.dictionary.take(pa.array(order))
        seen = np.bincount(code * width + of, n, len(words) * width).reshape(-1, width)
        index = WordIndex()
        index.add(words, index.hash(words))
        points, starts = _characters(words)
        inside = _inside(starts, len(points))
        word_of = np.repeat(np.arange(len(words), dtype=np.int32), np.diff(np.append(starts, len(points))))
        names, befores, sums = [], [], []
        for k in range(1, MAX_ORDER + 1):
            at, name, before = _grams(points, inside, k)
            own, first, inverse = np.unique(name, return_index=True, return_inverse=True)
            names.append(own)
            befores.append(before[first])
            sums.append(np.stack([np.bincount(inverse, seen[:, j].take(word_of[at]), len(own)) for j in range(width)], axis=1))
            del at, name, before, inverse  # the driver holds one order at a time
        letters = max(1, len(names[0]))
        grams, before, got = np.concatenate(names), np.concatenate(befores), np.concatenate(sums)
        _, context = np.unique(before, return_inverse=True)
        all_after = np.stack([np.bincount(context, got[:, j]) for j in range(width)], axis=1)[context]
        order = np.argsort(grams)
        logs = np.log((got + 0.1) / (all_after + 0.1 * letters))
        return cls(languages, index, np.log((seen + 0.5) / (seen.sum(axis=0) + 0.5 * max(1, len(words)))), grams[order], logs[order])

    def unseen(self, words: pa.Array) -> np.ndarray:
        """A row of each word's log probabilities by language, from its n-grams."""
        points, starts = _characters(words)
        inside = _inside(starts, len(points))
        out = np.zeros((len(points), len(self.languages)))
        open_ = np.ones(len(points), bool)
        for order in range(MAX_ORDER, 0, -1):
            at, name, _ = _grams(points, inside, order)
            left = open_[at]
            at, name = at[left], name[left]
            place = np.minimum(np.searchsorted(self.grams, name), max(0, len(self.grams) - 1))
            known = self.grams[place] == name if len(self.grams) else np.zeros(len(name), bool)
            at = at[known]
            out[at] = self.gram_logs[place[known]] + BACKOFF * (MAX_ORDER - order)
            open_[at] = False
        return np.add.reduceat(out, starts, axis=0) if len(starts) else np.zeros((0, len(self.languages)))

    def scores(self, words: pa.Array) -> np.ndarray:
        """A row of each word's log probabilities by language."""
        words = words.cast(pa.large_string())
        at, _ = self.words.find(words)
        out = np.zeros((len(words), len(self.languages)))
        out[at >= 0] = self.word_logs[at[at >= 0]]
        new = np.flatnonzero(at < 0)
        for k in range(0, len(new), _CALL_WORDS):
            out[new[k : k + _CALL_WORDS]] = self.unseen(words.take(pa.array(new[k : k + _CALL_WORDS])))
        return out

    def score(self, word: str) -> np.ndarray:
        return self.scores(pa.array([word]))[0]


def _tokens(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of lower-cased texts, and where each text's begin; a text without words has one empty word."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(text, "").cast(pa.large_string())), pattern=_SPLIT)
    return lists.flatten(), lists.offsets.to_numpy()[:-1].astype(np.int64) - lists.offsets[0].as_py()


def _count_words(batches):
    for batch in batches:
        for piece in text_slices(batch, "text"):
            tokens, starts = _tokens(piece.column("text"))
            langs = np.repeat(np.arange(piece.num_rows), np.diff(np.append(starts, len(tokens))))
            t = pa.table({"lang": pc.take(piece.column("lang").cast(pa.string()), pa.array(langs)), "word": tokens.cast(pa.string())})
            got = t.filter(pc.field("word") != "").group_by(["lang", "word"]).aggregate([("word", "count")])
            yield from got.select(["lang", "word", "word_count"]).rename_columns(["lang", "word", "n"]).to_batches()


def remainder(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def train(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, most_numbers: int = MODEL_NUMBERS) -> Model:
    """(doc_id, text, lang) -> a model, from rows with text and lang whose remainder isn't 1.

    Of each language a hash of the id picks about ``docs_per_language`` documents, the same in each run; all their words
    and n-grams are learned, whole. The model is a row of a number a language for each word, and is broadcast: one of more than
    ``most_numbers`` numbers is an error, never cut.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id")) != 1))
    size = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not size:
        return Model.fit([])
    share = F.create_map(*[F.lit(x) for lang, n in size.items() for x in (lang, min(1.0, docs_per_language / n))])
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.where(draw < share[F.col("lang")]).select("lang", "text")
    counts = materialize(sample.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "lang-words")
    numbers = counts.select("word").distinct().count() * len(size)
    if numbers > most_numbers:
        raise ValueError(f"the model would have {numbers} numbers, more than {most_numbers}: fit it on fewer documents of a language or languages")
    model = Model.fit(counts.toArrow())
    discard(counts)
    return model


def _predict(model: Model, piece: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
    text = piece.column("text")
    letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    if not model.languages:
        return ["und"] * piece.num_rows, np.zeros(piece.num_rows)
    tokens, starts = _tokens(text)
    coded = tokens.dictionary_encode()
    rows = model.scores(coded.dictionary)
    rows[pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False)] = 0.0
    sums = np.add.reduceat(rows[coded.indices.to_numpy()], starts, axis=0)
    best = sums.argmax(axis=1)
    sure = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
    return [model.languages[k] if ok else "und" for k, ok in zip(best, letters, strict=True)], np.where(letters, sure, 0.0)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, held_out, lang_pred, score, a row for each row.

    ``und`` with score 0 for a null text, a text without a letter, or a model without languages; else the most
    likely language and its posterior, ties to the first by name. Whole texts are read, a few megabytes at a time.
    Repeated rows get equal rows; other columns are not looked at; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        fitted = shared.value
        for batch in batches:
            for piece in text_slices(batch, "text"):
                langs, score = _predict(fitted, piece)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("held_out"), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", (remainder(F.col("doc_id")) == 1).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
