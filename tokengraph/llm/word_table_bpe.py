"""Byte-level BPE by a table of distinct words.

Texts are split into the words that the tokenizer's own pattern makes, in blocks of documents: a block holds each of its
words once and, for every position, the word's number. The words of all blocks are dealt by hash, each distinct word is
encoded once, and its ids go back to the blocks that hold it, where they are joined to the positions. Decoding joins every
position's id to the table of pieces. Only the small word and id lists meet across blocks: a word that fills
a third of all positions is one entry per block.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
import zlib
from itertools import batched

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokengraph.llm import common as C
from tokengraph.session import shared_dir

BLOCK_CHARS = 16_000_000
ENTRIES_PER_LIST = 160_000
"""A list is streamed and holds only its distinct words, so a fixed number of lists bounds the rows each block is cut into."""
# The pattern of byte-level pre-tokenisation, white space spelled out as Unicode's White_Space.
SPACE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
SETTLED = re.compile("[^" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0, 0x36F), (0x384, 0x52F), (0x2000, 0x206F), (0x20A0, 0x20BF))) + "]")
"""A character outside: its class may differ between Unicode versions, so the tokenizer itself splits such a text."""


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a piece: itself where printable, else the next from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def load(tokenizer_json: str):
    """The library's tokenizer, on one thread: Spark gives a task one core, and every further thread keeps memory."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(tokenizer_json)
    t.no_truncation()
    t.no_padding()
    return t


class Splitter:
    def __init__(self, tokenizer_json: str):
        from tokenizers import pre_tokenizers

        self.marks = [a["content"] for a in json.loads(tokenizer_json)["added_tokens"]]
        self.mark = re.compile("(" + "|".join(map(re.escape, self.marks)) + ")") if self.marks else None
        self.exact = pre_tokenizers.ByteLevel(add_prefix_space=False)

    def __call__(self, text: str) -> list[str]:
        parts = self.mark.split(text) if self.mark and any(m in text for m in self.marks) else (text,)
        words: list[str] = []
        for i, part in enumerate(parts):
            if i % 2:
                words.append(part)
            elif not SETTLED.search(part):
                words += WORDS.findall(part)
            else:
                at = 0
                for piece, _ in self.exact.pre_tokenize_str(part):
                    n = piece_chars(piece)
                    words.append(part[at : at + n])
                    at += n
        return words


LETTER_BYTE = {c: b for b, c in byte_letters().items()}


def piece_bytes(piece: str) -> bytes:
    return bytes(LETTER_BYTE[c] for c in piece) if all(c in LETTER_BYTE for c in piece) else piece.encode()


def piece_chars(piece: str) -> int:
    return sum(1 for c in piece if LETTER_BYTE[c] & 0xC0 != 0x80)


BUCKETS, COMMON = 4096, 255
BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("doc_ids", pa.binary()), ("doc_words", pa.binary()), ("numbers", pa.binary()), ("buckets", pa.binary()), ("words", pa.binary()), ("n_words", pa.int32())])
BLOCKS = "block bigint, doc_ids binary, doc_words binary, numbers binary, buckets binary, words binary, n_words int"


def pack_numbers(numbers: np.ndarray) -> bytes:
    """One byte for each of the common words, an escape and three bytes in planes for the others."""
    rest = (numbers[numbers >= COMMON] - COMMON).astype("<u4")
    planes = rest.view(np.uint8).reshape(-1, 4).T[:3].tobytes()
    return C.squeeze(np.uint64(len(numbers)).tobytes() + np.minimum(numbers, COMMON).astype(np.uint8).tobytes() + planes)


def unpack_numbers(data: bytes) -> np.ndarray:
    raw = np.frombuffer(C.expand(data), np.uint8)
    n = int(raw[:8].view("<u8")[0])
    small, planes = raw[8 : 8 + n].astype(np.uint32), raw[8 + n :].reshape(3, -1).astype(np.uint32)
    small[small == COMMON] = COMMON + (planes[0] | planes[1] << np.uint32(8) | planes[2] << np.uint32(16))
    return small


def bucket_of(words: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in words), np.uint16, len(words))


def split(docs: DataFrame, tokenizer_json: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per block of documents: ids, words per document, word number of every position, the distinct words.

    The words are in the order of their numbers: the most common of the block, then all others by hash bucket.
    """

    def run(batches):
        splitter = Splitter(tokenizer_json)
        count, base = 0, C.partition_id() << 32
        ids, lengths, numbers, table, size = [], [], [], {}, 0

        def block():
            nonlocal count, ids, lengths, numbers, table, size
            count += 1
            words = list(table)
            flat = np.concatenate(numbers) if numbers else np.empty(0, np.uint32)
            buckets, seen = bucket_of(words), np.bincount(flat, minlength=len(words))
            common = np.lexsort((np.arange(len(words)), -seen))[:COMMON]
            others = np.setdiff1d(np.arange(len(words)), common)
            others = others[np.argsort([words[i] for i in others.tolist()], kind="stable")] if len(others) else others
            order = np.concatenate([common, others[np.argsort(buckets[others], kind="stable")]]).astype(np.int64)
            number = np.empty(len(words), np.uint32)
            number[order] = np.arange(len(words), dtype=np.uint32)
            known = np.array([i is not None for i in ids])
            made = {"block": base + count, "doc_ids": C.pack(np.concatenate([known.astype(np.int64), np.array([i or 0 for i in ids], np.int64)])), "doc_words": C.pack(np.array(lengths, np.int64))}
            made |= {"numbers": pack_numbers(number[flat]), "buckets": C.pack(buckets[order]), "words": C.squeeze(json.dumps([words[i] for i in order.tolist()], ensure_ascii=False).encode("utf-8", "surrogatepass"), 6), "n_words": len(words)}
            ids, lengths, numbers, table, size = [], [], [], {}, 0
            return pa.RecordBatch.from_pylist([made], schema=BLOCK_SCHEMA)

        for r in C.rows_of(batches):
            words = splitter(r["text"])
            ids.append(r["doc_id"])
            lengths.append(len(words))
            numbers.append(np.fromiter((table.setdefault(w, len(table)) for w in words), np.uint32, len(words)))
            size += len(r["text"]) + 16
            if size >= block_chars:
                yield block()
        if ids:
            yield block()

    return C.texts(docs).mapInArrow(run, BLOCKS)


def list_of(buckets: np.ndarray, n_lists: int) -> np.ndarray:
    return (buckets.astype(np.int64) * n_lists) // BUCKETS


def narrow(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint16) if not len(a) or a.max() < 1 << 16 else a.astype(np.uint32)


def word_ids(blocks: DataFrame, tokenizer_json: str, n_lists: int) -> DataFrame:
    """``block, part, ids``: ids of the words of a block in list ``part``; every distinct word is encoded in one place.

    Words are dealt to ``n_lists`` lists by a hash of the word. A list holds a word once per block at most; it is streamed,
    only its distinct words stay in memory.
    """

    def deal(batches):
        for r in C.rows_of(batches, 1):
            words = json.loads(C.expand(r["words"]).decode("utf-8", "surrogatepass"))
            lists = list_of(C.unpack(r["buckets"], np.uint16), n_lists)
            order = np.argsort(lists, kind="stable")
            ends = np.searchsorted(lists[order], np.arange(n_lists + 1))
            for p in range(n_lists):
                own = order[ends[p] : ends[p + 1]]
                if len(own):
                    yield pa.RecordBatch.from_pylist([{"part": p, "block": r["block"], "words": C.squeeze(json.dumps([words[i] for i in own.tolist()], ensure_ascii=False).encode("utf-8", "surrogatepass"), 6)}], schema=pa.schema([("part", pa.int32()), ("block", pa.int64()), ("words", pa.binary())]))

    def encode(batches):
        tokenizer = load(tokenizer_json)
        for _, rows in C.in_groups(C.rows_of(batches, 16), lambda r: r["part"]):
            known: dict[str, list[int]] = {}
            for r in rows:
                words = json.loads(C.expand(r["words"]).decode("utf-8", "surrogatepass"))
                new = [w for w in words if w not in known]
                for i in range(0, len(new), 10_000):
                    some = new[i : i + 10_000]
                    known.update((w, e.ids) for w, e in zip(some, tokenizer.encode_batch_fast(some, add_special_tokens=False)))
                ids = [known[w] for w in words]
                flat = narrow(np.fromiter((x for i in ids for x in i), np.uint32))
                lengths = narrow(np.fromiter(map(len, ids), np.uint32, len(ids)))
                yield pa.RecordBatch.from_pylist([{"block": r["block"], "part": r["part"], "lengths": C.pack(lengths), "ids": C.pack(flat), "width": lengths.itemsize * 8 + flat.itemsize}], schema=pa.schema([("block", pa.int64()), ("part", pa.int32()), ("lengths", pa.binary()), ("ids", pa.binary()), ("width", pa.int32())]))

    dealt = blocks.select("block", "words", "buckets").mapInArrow(deal, "part int, block bigint, words binary")
    return dealt.repartition("part").sortWithinPartitions("part", "block").mapInArrow(encode, "block bigint, part int, lengths binary, ids binary, width int")


def stored(blocks: DataFrame) -> DataFrame:
    """The blocks as a table in the shared folder, bucketed by block, so that no later join moves the positions again."""
    spark, name = blocks.sparkSession, f"word_blocks_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks.write.bucketBy(n, "block").sortBy("block").option("path", f"{shared_dir(spark)}/tables/{name}").saveAsTable(name)
    return spark.table(name)


def assemble(blocks: DataFrame, ids: DataFrame, n_lists: int, each, schema: str) -> DataFrame:
    """Give ``each(row of the block, ids of all positions, ids per position)`` what belongs to a block.

    The lists of ids, small beside the positions, are shuffled to the buckets of the blocks.
    """
    lists = ids.groupBy("block").agg(F.collect_list(F.struct("part", "lengths", "ids", "width")).alias("lists"))
    rows = blocks.drop("words").join(lists, "block", "left")

    def run(batches):
        of_width = {2: np.uint16, 4: np.uint32}
        for r in C.rows_of(batches, 1):
            lengths, flats = [], []  # in the order of the lists
            for p in sorted(r["lists"] or [], key=lambda p: p["part"]):
                lengths.append(C.unpack(p["lengths"], of_width[p["width"] // 8]).astype(np.int64))
                flats.append(C.unpack(p["ids"], of_width[p["width"] % 8]).astype(np.uint32))
            order = np.argsort(list_of(C.unpack(r["buckets"], np.uint16), n_lists), kind="stable")
            dealt = np.concatenate([*lengths, np.empty(0, np.int64)])
            flat = np.concatenate([*flats, np.empty(0, np.uint32)])
            length, start = np.empty(r["n_words"], np.int64), np.empty(r["n_words"], np.int64)
            length[order], start[order] = dealt, np.cumsum(dealt) - dealt
            yield from each(r, flat, start, length, unpack_numbers(r["numbers"]))

    return rows.mapInArrow(run, schema)


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The entries of each numbered word, one after the other."""
    n = length[numbers]
    total = int(n.sum())
    at = np.arange(total, dtype=np.int64) - np.repeat(np.cumsum(n) - n, n)
    return flat[np.repeat(start[numbers], n) + at]


def documents_of(r: dict, flat: np.ndarray, start: np.ndarray, length: np.ndarray, numbers: np.ndarray):
    """``(doc_id, ids of the document)`` of every document of a block, in its order."""
    both = C.unpack(r["doc_ids"], np.int64).reshape(2, -1)
    words = np.concatenate([[0], np.cumsum(C.unpack(r["doc_words"], np.int64))]).tolist()
    for i, (known, doc) in enumerate(both.T.tolist()):
        yield (doc if known else None), gather(flat, start, length, numbers[words[i] : words[i + 1]])


def _lists(blocks: DataFrame) -> int:
    total = blocks.agg(F.sum("n_words")).first()[0] or 0
    return max(8, min(BUCKETS, total // ENTRIES_PER_LIST))


def encode(docs: DataFrame, tokenizer_json: str) -> DataFrame:
    """``doc_id, ids``: the ids of every text as the tokenizer gives them, without special tokens added.

    One row per input row. A null text is empty and has no ids; other columns are not carried.
    """
    blocks = stored(split(docs, tokenizer_json))
    n = _lists(blocks)

    def each(*block):
        for some in batched(documents_of(*block), 256):
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in some], pa.int64()), pa.array([x.astype(np.int32) for _, x in some], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return assemble(blocks, word_ids(blocks, tokenizer_json, n), n, each, "doc_id bigint, ids array<int>")


def piece_table(spark: SparkSession, tokenizer_json: str) -> DataFrame:
    """``id, piece``: one row per id of the vocabulary, which bounds its size."""
    t = load(tokenizer_json)
    marks = {a["id"]: a["content"].encode() for a in json.loads(tokenizer_json)["added_tokens"]}
    rows = [(i, bytearray(marks.get(i) or piece_bytes(p))) for p, i in t.get_vocab(with_added_tokens=True).items()]
    return spark.createDataFrame(pd.DataFrame({"id": [i for i, _ in rows], "piece": [bytes(p) for _, p in rows]}), "id int, piece binary")


ROUND = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def round_trip(docs: DataFrame, tokenizer_json: str) -> DataFrame:
    """Encode and decode every text: ``doc_id, n_tokens``, digests of the ids and of the decoded text.

    The id-to-piece table has one row per id of the vocabulary, so it is joined to the positions as a broadcast.
    """
    blocks = stored(split(docs, tokenizer_json))
    n = _lists(blocks)
    rows = piece_table(docs.sparkSession, tokenizer_json).collect()
    pieces = docs.sparkSession.sparkContext.broadcast({r["id"]: (bytes(r["piece"]), str(r["id"])) for r in rows})

    def each(*block):
        joined, rows = pieces.value, []
        for d, x in documents_of(*block):
            own = [joined[i] for i in x.tolist()]
            text = b"".join([p for p, _ in own]).decode("utf-8", "replace")
            rows.append({"doc_id": d, "n_tokens": len(own), "ids_sha256": hashlib.sha256(",".join([i for _, i in own]).encode()).hexdigest(), "decoded_sha256": hashlib.sha256(text.encode()).hexdigest()})
        yield pa.RecordBatch.from_pylist(rows, schema=ROUND)

    return assemble(blocks, word_ids(blocks, tokenizer_json, n), n, each, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
