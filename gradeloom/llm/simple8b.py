"""Token-id files in Simple-8b: word-aligned coding with escapes, and offsets per block for vectorised decoding.

Format, one Parquet row per block of whole documents (so Spark's committer and splits carry it through lost executors):

* ``words``: little-endian 64-bit words; the top 4 bits select how many codes of how many bits the other 60 hold (``SELECTORS``);
* codes are id + 1 for ids below ``ESCAPED``; 0 is an escape, whose id stands in ``escapes`` (little-endian 32 bits, in order);
* ``doc_ids``, ``doc_ends``: the documents of the block, and the count of ids up to the end of each;
* ``shard``, ``block``: place in the file order; ``n_ids``.

Shards are ranges of doc_id in ascending order, blocks ascend within a shard, so (shard, block) is the order of the whole file set.
Offsets of a shard are the sum of the shards before it: one number per shard, never a global sort of ids.

Ids are those of the tokenizers library without special tokens, ``END`` after each document. Where a tokenizer's pre-tokens never cross white
space, which is checked when it is loaded, recurring pieces and pre-tokens are encoded once per worker; else every whole text is.

Null or empty text: only the end id. Null doc_id: sorts first. Repeated doc_ids: ordered by the hash of the text, then the text; equal rows follow one another. Extra columns
are not written. Empty table: no blocks, empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import batches_of, batches_of_bytes, documents, lean, stage

TOKENIZER, END = "word_bpe_49k.json", 2
BLOCK_IDS = 1 << 16
ESCAPED = (1 << 15) - 1
#: Fixed by the format: codes per word and bits per code, by selector.
SELECTORS = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
#: Bits of every code.
WIDTH = np.array([c.bit_length() for c in range(ESCAPED + 1)], np.uint8)
# How a tokenizer must normalise and cut a text for its ids to be put together from those of pre-tokens.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Pieces whose characters no normal form changes and whose lower case is the same everywhere, and ``CUT`` for such pieces.
_PLAIN = "^[!-~À-ÖØ-öø-ÿ‘’“”–—…]+$"
_PRE_TOKENS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]| |[^ a-z0-9ß-öø-ÿ]+")
#: Entries and ids that a worker's store holds before it starts anew; a matter of speed only.
ENTRIES, STORED = 500_000, 1 << 22
#: Pre-tokens asked for in one text.
TOGETHER = 500
#: Texts cut at a time, and their bytes; a matter of speed and memory only.
TEXTS, TEXT_BYTES = 1024, 1 << 21

BLOCK = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_ends", pa.list_(pa.int64())),
                   ("n_ids", pa.int64()), ("words", pa.binary()), ("escapes", pa.binary())])
BLOCK_DDL = "shard int, block long, doc_ids array<long>, doc_ends array<long>, n_ids long, words binary, escapes binary"
DOC = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("nth", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()),
                 ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])


# ---- the code -----------------------------------------------------------------------------------------------------------------

def pack(ids: np.ndarray) -> tuple[bytes, bytes]:
    """Words and escapes of non-negative 32-bit ids."""
    wide = ids >= ESCAPED
    codes = np.where(wide, 0, ids.astype(np.int64) + 1).astype(np.uint64)
    n = len(codes)
    if not n:
        return b"", b""
    # widest code of every window, by windows of 1, 2, 4, ... codes; past the end codes count as 0
    wide_by = {1: np.r_[WIDTH[codes], np.zeros(240, np.uint8)]}
    for size in (1, 2, 4, 8, 16, 32, 64):
        half = wide_by[size]
        wide_by[2 * size] = np.r_[np.maximum(half[:-size], half[size:]), half[-size:]]
    chosen = np.full(n, len(SELECTORS) - 1, np.int8)
    for s in range(len(SELECTORS) - 2, -1, -1):  # the densest selector that fits from each place on
        count, bits = SELECTORS[s]
        size = 1 << (count.bit_length() - 1)
        fits = np.maximum(wide_by[size][:n], wide_by[size][count - size:count - size + n]) <= bits
        fits[max(n - count + 1, 0):] = False  # a word holds no more codes than are left
        chosen[fits] = s
    jump = (np.arange(n) + np.array([c for c, _ in SELECTORS])[chosen]).tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at = jump[at]
    starts = np.array(starts)
    picked = chosen[starts]
    padded = np.r_[codes, np.zeros(240, np.uint64)]
    words = picked.astype(np.uint64) << np.uint64(60)
    for s, (count, bits) in enumerate(SELECTORS):
        mine = np.flatnonzero(picked == s)
        if bits and len(mine):
            for k in range(count):
                words[mine] |= padded[starts[mine] + k] << np.uint64(k * bits)
    return words.astype("<u8").tobytes(), ids[wide].astype("<u4").tobytes()


def unpack(words: bytes, escapes: bytes, n: int) -> np.ndarray:
    """The n ids of a block; every selector's words are decoded at once."""
    packed = np.frombuffer(words, "<u8")
    picked = (packed >> np.uint64(60)).astype(np.int64)
    counts = np.array([c for c, _ in SELECTORS])[picked]
    starts = np.cumsum(counts) - counts
    codes = np.zeros(n + 240, np.int64)
    for s, (count, bits) in enumerate(SELECTORS):
        mine = np.flatnonzero(picked == s)
        if bits and len(mine):
            mask = np.uint64((1 << bits) - 1)
            for k in range(count):
                codes[starts[mine] + k] = (packed[mine] >> np.uint64(k * bits)) & mask
    ids = codes[:n] - 1
    ids[ids < 0] = np.frombuffer(escapes, "<u4")
    return ids


# ---- encoding -----------------------------------------------------------------------------------------------------------------

class Store(dict):
    """Numbers of strings, given as they are first asked for, and their ids, which lie in one array.

    ``fill`` returns the ids of new strings, one after the other, and how many each has.
    """

    def __init__(self, fill: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], fixed: dict[str | None, list[int]]):
        super().__init__()
        self.fill, self.fixed = fill, fixed
        self.start_anew()

    def start_anew(self) -> None:
        self.clear()
        self.update({key: i for i, key in enumerate(self.fixed)})
        self.sizes = np.array([len(x) for x in self.fixed.values()])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.ids = np.array([i for x in self.fixed.values() for i in x], "<u4")

    def numbers(self, keys: list[str | None]) -> np.ndarray:
        """Numbers of strings, good until more are asked for."""
        if len(self) > ENTRIES or len(self.ids) > STORED:
            self.start_anew()
        numbers = np.fromiter(map(self.get, keys, repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            asked = [keys[i] for i in missing.tolist()]
            new = list(dict.fromkeys(asked))
            ids, sizes = self.fill(new)
            self.update(zip(new, range(len(self), len(self) + len(new)), strict=True))
            numbers[missing] = np.fromiter(map(self.__getitem__, asked), np.int64, len(asked))
            self.starts = np.r_[self.starts, len(self.ids) + np.cumsum(sizes) - sizes]
            self.sizes, self.ids = np.r_[self.sizes, sizes], np.r_[self.ids, ids]
        return numbers

    def ids_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of numbered strings, one after the other, and how many there are up to the end of each."""
        sizes = self.sizes[numbers]
        upto = np.cumsum(sizes)
        places = np.repeat(self.starts[numbers] - (upto - sizes), sizes)
        places += np.arange(len(places))
        return self.ids[places], upto


class Encoder:
    """Ids of whole texts, put together from those of their pre-tokens where the tokenizer's own configuration shows that this is the same.

    A text is cut at blanks and line feeds, a plain piece further as ``CUT`` does; the library is asked for each pre-token once. Pieces with
    other characters or a mark of an added token are asked for whole. A tokenizer that works in another way gets whole texts. Arrow cuts a batch
    of texts and tells its different pieces apart; each of them is looked up once, and the ids of the batch are gathered at once; new pieces
    likewise from their pre-tokens.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = Store(self.fill_pieces, {None: [END], "": []})
        self.pre_tokens = Store(self.fill_pre_tokens, {" ": []})
        told = json.loads(self.tokenizer.to_str())
        cuts = (told["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        self.by_pieces = (
            (told["normalizer"] or {}).get("normalizers") == NORMALIZERS
            and cuts[0] == {"type": "Split", "pattern": {"Regex": CUT}, "behavior": "Removed", "invert": True}
            and [(c.get("type"), c.get("add_prefix_space"), c.get("use_regex")) for c in cuts[1:]] == [("ByteLevel", False, False)]
            and not told["truncation"] and not told["padding"] and not told["model"].get("dropout"))
        # an added token may stand inside a text: its content must show by its mark, hold no blank and take none beside it
        self.by_pieces &= all(t["content"].startswith("<|") and " " not in t["content"] and not (t["lstrip"] or t["rstrip"] or t["single_word"])
                              for t in told["added_tokens"])
        # every character can end a pre-token, and exactly the ids with the suffix do
        vocab, suffix = told["model"]["vocab"], told["model"].get("end_of_word_suffix")
        self.by_pieces &= bool(suffix) and sum(len(t) == 1 + len(suffix) and t.endswith(suffix) for t in vocab) >= 256
        if self.by_pieces:
            self.is_end = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.is_end[[i for t, i in vocab.items() if t.endswith(suffix)]] = True

    def asked(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def fill_pre_tokens(self, pre_tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain pre-tokens: many in one text, which is cut after the ids that end a pre-token."""
        texts = [" ".join(pre_tokens[i:i + TOGETHER]) for i in range(0, len(pre_tokens), TOGETHER)]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(found), "<u4", sum(map(len, found)))
        sizes = np.diff(np.flatnonzero(self.is_end[ids]), prepend=-1)
        if len(sizes) != len(pre_tokens):
            raise ValueError("the tokenizer cuts plain text in another way than its configuration says")
        return ids, sizes

    def fill_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces: plain ones from their pre-tokens, the others as the library gives them."""
        column = pa.array(pieces, pa.string())
        plain = pc.and_not(pc.match_substring_regex(column, _PLAIN), pc.match_substring(column, "<|")).to_numpy(zero_copy_only=False)
        odd = list(compress(pieces, ~plain))
        asked = self.asked(odd)
        # a blank, which has number 0 and no ids, stands after each plain piece
        numbers = self.pre_tokens.numbers(_PRE_TOKENS.findall("".join([f"{p} " for p in compress(pieces, plain)]).lower()))
        ids, upto = self.pre_tokens.ids_of(numbers)
        ends = upto[numbers == 0]
        sizes = np.zeros(len(pieces), np.int64)
        sizes[plain], sizes[~plain] = np.diff(ends, prepend=0), [len(x) // 4 for x in asked]
        out, of_plain = np.empty(sizes.sum(), "<u4"), np.repeat(plain, sizes)
        out[of_plain], out[~of_plain] = ids, np.frombuffer(b"".join(asked), "<u4")
        return out, sizes

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers, END included."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not self.by_pieces:
            end = END.to_bytes(4, "little")
            return [ids + end for ids in self.asked(texts.to_pylist())]
        if not len(texts):
            return []
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        found, ends = cut.flatten().dictionary_encode(), np.cumsum(cut.value_lengths().to_numpy())
        kinds = len(found.dictionary)
        # a piece holds no blank, so blanks may part the different ones; END follows the pieces of each text
        pieces = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, kinds], pa.int32()), found.dictionary), " ")[0].as_py().split(" ")
        ids, upto = self.pieces.ids_of(self.pieces.numbers([*pieces, None])[np.insert(found.indices.to_numpy(), ends, kinds)])
        raw, ends = ids.tobytes(), (4 * upto[ends + np.arange(len(ends))]).tolist()
        return [raw[x:y] for x, y in zip([0, *ends], ends, strict=False)]


@lru_cache(maxsize=2)
def load(path: str) -> Encoder:
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def write(docs: DataFrame, path: str | None = None, partitions: int | None = None) -> DataFrame:
    """The blocks of ``docs``, written to the shared folder and read back as a table (``BLOCK_DDL``)."""
    path, spark = path or default_path(), docs.sparkSession
    partitions = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = docs.select("doc_id", "text").repartitionByRange(partitions, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, block, keys, blobs, held = load(path), 0, [], [], 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(blobs), "<u4")
            words, escapes = pack(ids)
            ends = np.cumsum([len(b) // 4 for b in blobs])
            return pa.RecordBatch.from_pylist([{"shard": 0, "block": block, "doc_ids": keys, "doc_ends": ends.tolist(), "n_ids": len(ids),
                                                "words": words, "escapes": escapes}], schema=BLOCK)

        for batch in batches_of_bytes(batches, "text", TEXT_BYTES, TEXTS):
            for key, blob in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
                keys.append(key)
                blobs.append(blob)
                held += len(blob) // 4
                if held >= BLOCK_IDS:
                    yield flush()
                    block, keys, blobs, held = block + 1, [], [], 0
        if keys:
            yield flush()

    return stage(ordered.mapInArrow(lean(run, "simple8b"), BLOCK_DDL).withColumn("shard", F.spark_partition_id()))


def documents_of(blocks: DataFrame, with_ids: bool = False) -> DataFrame:
    """Read back: shard, block, nth, doc_id, at (ids before it in its block), n_tokens, ids_crc32 and, on request, ids."""
    fields = DOC if with_ids else pa.schema([*list(DOC)[:6], ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 8):
            for row in batch.to_pylist():
                ids = unpack(row["words"], row["escapes"], row["n_ids"]).astype("<u4")
                ends = row["doc_ends"]
                starts = [0, *ends[:-1]]
                raw = memoryview(ids.tobytes())
                last = ([ids[a:b].astype(np.int32) for a, b in zip(starts, ends, strict=True)] if with_ids
                        else [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(starts, ends, strict=True)])
                n = len(ends)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(
                    ([row["shard"]] * n, [row["block"]] * n, range(n), row["doc_ids"], starts, np.diff([0, *ends]), last), fields, strict=True)],
                    schema=fields)

    ddl = "shard int, block long, nth long, doc_id long, at long, n_tokens long, " + ("ids array<int>" if with_ids else "ids_crc32 long")
    return blocks.mapInArrow(run, ddl)


def starts_of(blocks: DataFrame) -> DataFrame:
    """shard, block, base: ids before each block. Sums per shard first; the running sum over shards has a row per shard."""
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("shard_base"))
    within = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return (blocks.select("shard", "block", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("inner")).join(shards, "shard")
            .select("shard", "block", (F.col("inner") + F.col("shard_base")).alias("base")))


def op5_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = write(documents(spark, sf_dir))
    return (documents_of(blocks).join(starts_of(blocks), ["shard", "block"])
            .select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"))
