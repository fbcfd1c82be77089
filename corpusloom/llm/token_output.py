"""Token-ID output: documents become ids, ids become coded blocks in segments of a Parquet table.

A row is a segment: whole documents, in order, of about ``SEGMENT_IDS`` ids. It holds their doc_ids and
numbers of ids, and the ids as blocks of the range coder, each with its own model, header and checksum, so a
segment is read without any other. Spark's writer commits the files, so tasks that run twice leave one copy.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import uuid
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .codec import BLOCK_IDS, LANES, decode_blocks, encode_blocks
from .common import give_back, shared_dir, small_batches, table, text_slices
from .words import WordIndex

END_ID = 2
SEGMENT_IDS = LANES * BLOCK_IDS
#: Bytes of text of one shard on average, and of the least shard that is worth a task of its own.
SHARD_BYTES, SHARD_LEAST = 16_000_000, 2_000_000
#: Bytes of text that are cut into words at a time.
TEXT_BYTES = 3_000_000
_GAP = re.compile(rb"[ \t-\r]")
#: Words that the library gets in one call; what it returns takes over 100 bytes an id.
_CALL_WORDS = 16_000
#: Words whose ids a worker keeps; beyond, those that it has met once go.
_CACHED = 1_000_000
#: Words of letters that have one lower-case form each and no other composition, and of marks behind them (no apostrophe, which may begin a piece).
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_PLAIN = r"^([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+)([!-&(-/:-@\[-`{-~]*)$"


def _plain_letters(parts: dict) -> bool:
    """Whether the tokenizer lower-cases, takes runs of letters and of marks as pieces, spells them as byte letters and ends each with a suffix."""
    normal = [x["type"] for x in (parts["normalizer"] or {}).get("normalizers", [])]
    before = (parts["pre_tokenizer"] or {}).get("pretokenizers", [])
    pattern = before[0].get("pattern", {}).get("Regex", "") if before else ""
    if set(normal) != {"NFC", "Replace", "Lowercase"} or [x["type"] for x in before] != ["Split", "ByteLevel"] or not pattern.endswith("|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"):
        return False
    model = parts["model"]
    suffix = model.get("end_of_word_suffix")
    return model["type"] == "BPE" and bool(suffix) and all(x + suffix in model["vocab"] for x in _byte_letters())


def _byte_letters() -> str:
    """The letter that byte-level tokenizers write for each byte: itself if it prints, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return "".join(chr(b) if b in shown else chr(next(hidden)) for b in range(256))


class Encoder:
    """A tokenizer, and the ids of words it has met.

    Only for tokenizers that split at white space and drop it: the ids of a text are then those of its words
    in turn, each given to the library whole. Words of plain letters and marks at their end, whose pieces are known
    beforehand, go straight to the library's model, many in one call.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.pieces = Tokenizer.from_file(path), None
        parts = json.loads(self.tokenizer.to_str())
        if _plain_letters(parts):
            self.pieces = Tokenizer(self.tokenizer.model)
            self.pieces.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
            letters = _byte_letters()
            self.letters = letters[:32] + " " + letters[33:]
            suffix = parts["model"]["end_of_word_suffix"]
            self.last = np.zeros(max(parts["model"]["vocab"].values()) + 1, bool)
            self.last[[i for token, i in parts["model"]["vocab"].items() if token.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        self.words, self.hits = WordIndex(), np.zeros(0, bool)
        self.flat, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _forget(self) -> None:
        """Keeps the words that were met again since the last time, or none if there are too many of them."""
        kept = self.hits
        if 2 * kept.sum() > _CACHED:
            return self.clear()
        starts, lengths = self.starts[kept], self.lengths[kept]
        self.words, self.hits = self.words.only(kept), np.zeros(int(kept.sum()), bool)
        self.flat, self.starts, self.lengths = _gather(self.flat, starts, lengths), (np.cumsum(lengths) - lengths).astype(np.int32), lengths

    def _ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in turn, and how many each has."""
        plain = pc.match_substring_regex(words, _PLAIN) if self.pieces else pa.array(np.zeros(len(words), bool))
        mask = plain.to_numpy(zero_copy_only=False)
        lengths, parts = np.zeros(len(words), np.int64), [np.zeros(0, np.uint32)]
        rest, lower = words.filter(pc.invert(plain)), pc.utf8_lower(words.filter(plain))
        sizes = [np.zeros(0, np.int64)]
        for k in range(0, len(lower), _CALL_WORDS):
            some = lower.slice(k, _CALL_WORDS)
            tails = pc.less(pc.binary_length(pc.utf8_rtrim(some, characters=_MARKS)), pc.binary_length(some)).to_numpy(zero_copy_only=False)
            spaced = pc.replace_substring_regex(some, _PLAIN, r"\1 \2 ")
            text = codecs.charmap_decode(memoryview(spaced.buffers()[2])[: pc.sum(pc.binary_length(spaced)).as_py()], "strict", self.letters)[0]
            parts.append(np.array(self.pieces.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32))
            ends = np.flatnonzero(self.last[parts[-1]]) + 1  # one for each piece, and a word has one or two
            sizes.append(np.diff(ends[np.cumsum(1 + tails) - 1], prepend=0))
        lengths[mask] = np.concatenate(sizes)
        sizes = [np.zeros(0, np.int64)]
        for k in range(0, len(rest), _CALL_WORDS):
            got = [e.ids for e in self.tokenizer.encode_batch_fast(rest.slice(k, _CALL_WORDS).to_pylist(), add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, got), np.int64, len(got)))
            parts.append(np.fromiter((x for ids in got for x in ids), np.uint32, int(sizes[-1].sum())))
        lengths[~mask] = np.concatenate(sizes)
        starts = np.zeros(len(words), np.int64)
        starts[mask] = np.cumsum(lengths[mask]) - lengths[mask]
        starts[~mask] = lengths[mask].sum() + np.cumsum(lengths[~mask]) - lengths[~mask]
        return _gather(np.concatenate(parts), starts, lengths), lengths

    def places(self, words: pa.Array) -> np.ndarray:
        """Where the ids of each word are kept; the words differ."""
        if len(self.words) > _CACHED:
            self._forget()
        at, hashes = self.words.find(words)
        new = at < 0
        self.hits[at[~new]] = True
        if new.any():
            fresh = words.filter(pa.array(new))
            ids, lengths = self._ids(fresh)
            at[new] = len(self.words) + np.arange(len(fresh))
            self.words.add(fresh, hashes[new])
            self.hits = np.append(self.hits, np.zeros(len(fresh), bool))
            self.starts = np.concatenate([self.starts, (len(self.flat) + np.cumsum(lengths) - lengths).astype(np.int32)])
            self.lengths = np.concatenate([self.lengths, lengths.astype(np.int32)])
            self.flat = np.concatenate([self.flat, ids])
        return at

    def encode(self, text: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts in turn, an ``end_id`` after each, and how many each text has. A single long text goes in parts, cut at white space."""
        if len(text) == 1 and (pc.binary_length(text)[0].as_py() or 0) > 2 * TEXT_BYTES:
            raw, at, parts = text[0].as_py().encode(), 0, []
            while at < len(raw):
                gap = _GAP.search(raw, at + TEXT_BYTES)
                to = gap.start() if gap else len(raw)
                parts.append(self.encode(pa.array([raw[at:to].decode()]), end_id)[0][:-1] if to - at <= 2 * TEXT_BYTES else self._ids(pa.array([raw[at:to].decode()], pa.large_string()))[0])
                at = to
            ids = np.concatenate([*parts, np.array([end_id], np.uint32)])
            return ids, np.array([len(ids)])
        lists = pc.ascii_split_whitespace(pc.fill_null(text, "").cast(pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        per = self.places(coded.dictionary).take(coded.indices.to_numpy(zero_copy_only=False))
        lengths = self.lengths.take(per)
        ends = lists.offsets.to_numpy().astype(np.int64)[1:] - lists.offsets[0].as_py()
        total = np.concatenate([[0], np.cumsum(lengths)])
        sizes = np.diff(total[ends], prepend=0)
        return np.insert(_gather(self.flat, self.starts.take(per), lengths), np.cumsum(sizes), np.uint32(end_id)), sizes + 1


def _gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[start : start + length] of each, one after the other."""
    ends = np.cumsum(lengths, dtype=np.int64)
    at = np.repeat(starts - ends + lengths, lengths)
    at += np.arange(len(at))
    return values.take(at)


@cache
def _encoder(path: str) -> Encoder:
    """One for a worker, so tasks share what it has met."""
    return Encoder(path)


def _segments(path: str, end_id: int, segment_ids: int):
    def run(batches):
        from pyspark import TaskContext

        shard, segment = TaskContext.get().partitionId(), 0
        encoder = _encoder(path)
        docs, counts, held, size = [], [], [], 0

        def row():
            ids = np.concatenate(held)
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([pa.concat_arrays(docs).to_pylist()], pa.list_(docs[0].type)), pa.array([np.concatenate(counts)], pa.list_(pa.int64())), pa.array([encode_blocks(ids)], pa.list_(pa.binary()))],
                names=["shard", "segment", "doc_ids", "counts", "blocks"],
            )

        for batch in batches:
            for piece in text_slices(batch, "text", TEXT_BYTES):
                ids, sizes = encoder.encode(piece.column("text"), end_id)
                docs.append(piece.column("doc_id"))
                counts.append(sizes)
                held.append(ids)
                size += len(ids)
                if size >= segment_ids:
                    yield row()
                    give_back()
                    docs, counts, held, size, segment = [], [], [], 0, segment + 1
        if docs:
            yield row()
        give_back()

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS, shard_bytes: int = SHARD_BYTES, shard_rows: int | None = None) -> None:
    """(doc_id, text, ...) -> a Parquet table of segments in ``folder``, in ascending order of doc_id.

    Null texts are empty and have the end id alone; null ids come first; rows with equal ids follow each other
    by a hash of their text; other columns are not written. An empty table writes an empty table. ``tokenizer`` is the path, on
    every machine, of a tokenizer that drops white space. Rows are range-partitioned by id and text hash, so
    no key is too large to split, into as many shards as their bytes ask for (and rows, where ``shard_rows`` is given);
    a task holds one segment at a time.
    """
    path = tokenizer or default_tokenizer()
    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("rows")).first()
    text = size["bytes"] or 0
    shards = max(1, -(-text // shard_bytes), -(-size["rows"] // (shard_rows or max(1, size["rows"]))), min(docs.sparkSession.sparkContext.defaultParallelism, text // SHARD_LEAST))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie").asc()]
    kind = dict(docs.dtypes)["doc_id"]
    dealt = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")
    with small_batches(docs.sparkSession):
        dealt.mapInArrow(_segments(path, end_id, segment_ids), f"shard int, segment int, doc_ids array<{kind}>, counts array<bigint>, blocks array<binary>").write.option("compression", "none").parquet(folder)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _decoded(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            docs, counts = row.column(2).flatten(), row.column(3).flatten().to_numpy(zero_copy_only=False)
            ids = np.concatenate([*decode_blocks(row.column(4).flatten().to_pylist()), np.zeros(0, "<u4")])
            ends = np.cumsum(counts)
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
            same = lambda x, n=len(docs): pa.array(np.full(n, x.as_py()), x.type)
            yield pa.RecordBatch.from_arrays([docs, same(row.column(0)[0]), same(row.column(1)[0]), pa.array(ends - counts), pa.array(counts), pa.array(crc, pa.int64())], names=["doc_id", "shard", "segment", "inside", "n_tokens", "ids_crc32"])
        give_back()


def _whole(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            counts = row.column(3).flatten()
            ids = np.concatenate([*decode_blocks(row.column(4).flatten().to_pylist()), np.zeros(0, "<u4")])
            offsets = pa.array(np.append(0, np.cumsum(counts.to_numpy(zero_copy_only=False))), pa.int32())
            yield pa.RecordBatch.from_arrays([row.column(2).flatten(), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int64)))], names=["doc_id", "ids"])


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, ids: array<bigint> of each document in the files. Raises where a block fails its checksum."""
    files = spark.read.parquet(folder)
    return files.mapInArrow(_whole, f"doc_id {files.schema['doc_ids'].dataType.elementType.simpleString()}, ids array<bigint>")


def read_token_index(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the decoded ids.

    start is a prefix sum over shards, over the segments of a shard, and inside a segment; only one row a
    shard is ever summed in one task.
    """
    files = spark.read.parquet(folder)
    sizes = files.select("shard", "segment", F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))
    ahead = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n")).select(F.col("shard").alias("of_shard"), ahead(Window.orderBy("shard")).alias("shard_start"))
    segments = sizes.withColumn("segment_start", ahead(Window.partitionBy("shard").orderBy("segment"))).select(F.col("shard").alias("at_shard"), F.col("segment").alias("at_segment"), "segment_start")
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    decoded = files.select("shard", "segment", "doc_ids", "counts", "blocks").mapInArrow(_decoded, f"doc_id {kind}, shard int, segment int, inside bigint, n_tokens bigint, ids_crc32 bigint")
    placed = segments.join(shards, F.col("at_shard") == F.col("of_shard")).select("at_shard", "at_segment", (F.col("segment_start") + F.col("shard_start")).alias("base"))
    return decoded.join(placed, (F.col("shard") == F.col("at_shard")) & (F.col("segment") == F.col("at_segment"))).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes the token files of ``docs`` to the shared folder and returns their index, read back from them."""
    folder = f"{shared_dir(docs.sparkSession)}/corpusloom/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, folder, tokenizer)
    return read_token_index(docs.sparkSession, folder)


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"))
