"""Token ids in shards compressed by Re-Pair, with random access to the ids of a document.

A shard holds the ids of consecutive documents. Its most frequent pairs of neighbouring symbols are replaced by new
symbols again and again; a rule stores the two symbols and the length of the expansion. Pairs never cross the end of a
document, so each document is a slice of the compressed sequence and can be expanded alone.

File format, one row per shard of a Parquet table: ``part, seq`` (place in document order), ``n_docs, n_tokens``,
``known, doc_ids`` (ids and whether there is one), ``doc_symbols`` and ``doc_tokens`` (lengths of each document, compressed
and expanded), ``rules`` (pairs, 16-bit), ``rule_lengths`` (32-bit), ``symbols`` (16-bit). Symbols below ``base`` are token
ids; ``base + i`` is rule ``i``. All arrays are little-endian.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from tokengraph.llm import common as C
from tokengraph.llm.word_table_bpe import load
from tokengraph.session import shared_dir

SHARD_TOKENS = 1 << 19
ROUNDS, RULES_PER_ROUND, LEAST_COUNT = 5, 2048, 8


def compress(ids: np.ndarray, ends: np.ndarray, base: int, rounds: int = ROUNDS, per_round: int = RULES_PER_ROUND, least: int = LEAST_COUNT):
    """``symbols, ends, rules, rule lengths``; ``ends`` are the places after each document's last symbol.

    In a round the most frequent pairs are taken in order of count as long as no symbol stands left in one and right in
    another of them, so replacing them together equals replacing them one after the other.
    """
    seq = ids.astype(np.uint32)
    last = np.zeros(len(seq) + 1, bool)
    last[ends - 1] = True  # an empty document marks the symbol before it, or the extra last place
    last = last[:-1] if len(seq) else np.zeros(0, bool)
    doc_of_symbol = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(ends, prepend=0))
    rules: list[tuple[int, int]] = []
    lengths: list[int] = []
    room = 65536 - base
    for _ in range(rounds):
        if len(seq) < 2 or len(rules) >= room:
            break
        codes = (seq[:-1] << np.uint32(16)) | seq[1:]
        inside = ~last[:-1]
        found = np.sort(codes[inside])
        new = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1], [True]])) if len(found) else np.zeros(1, int)
        counts, found = np.diff(new), found[new[:-1]]
        often = np.flatnonzero(counts >= least)
        often = often[np.argsort(-counts[often], kind="stable")][: 4 * per_round]
        lefts, rights, taken = set(), set(), []
        for code in found[often].tolist():
            a, b = code >> 16, code & 0xFFFF
            if a in rights or b in lefts or (a == b and (a in lefts or a in rights)):
                continue
            lefts.add(a)
            rights.add(b)
            taken.append(code)
            if len(taken) == min(per_round, room - len(rules)):
                break
        if not taken:
            break
        order = np.sort(np.array(taken, np.uint32))
        may = np.zeros((2, 1 << 16), bool)
        may[0, order >> np.uint32(16)], may[1, order & np.uint32(0xFFFF)] = True, True
        where = np.flatnonzero(may[0, seq[:-1]] & may[1, seq[1:]] & inside)
        which = np.minimum(np.searchsorted(order, codes[where]), len(order) - 1)
        pick = order[which] == codes[where]
        where, which = where[pick], which[pick]
        twin = seq[where] == seq[where + 1]
        if twin.any():  # in a run of one symbol every second pair counts
            place = np.arange(len(where))
            joined = np.concatenate([[False], twin[1:] & twin[:-1] & (where[1:] == where[:-1] + 1)])
            begin = np.maximum.accumulate(np.where(joined, -1, place))
            pick = ~twin | ((place - begin) % 2 == 0)
            where, which = where[pick], which[pick]
        size = {i: n for i, n in enumerate(lengths, base)}
        symbol = base + len(rules)
        for code in order.tolist():
            a, b = code >> 16, code & 0xFFFF
            rules.append((a, b))
            lengths.append(size.get(a, 1) + size.get(b, 1))
        seq[where] = (symbol + which).astype(np.uint32)
        last[where] = last[where + 1]
        keep = np.ones(len(seq), bool)
        keep[where + 1] = False
        seq, last, doc_of_symbol = seq[keep], last[keep], doc_of_symbol[keep]
    new_ends = np.searchsorted(doc_of_symbol, np.arange(len(ends)), side="right")
    return seq.astype(np.uint16), new_ends, np.array(rules, np.uint16).reshape(-1, 2), np.array(lengths, np.uint32)


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids of a slice of the compressed sequence."""
    seq = symbols.astype(np.int64)
    while len(seq):
        rule = seq >= base
        if not rule.any():
            break
        width = 1 + rule.astype(np.int64)
        at = np.cumsum(width) - width
        out = np.empty(int(width.sum()), np.int64)
        out[at[~rule]] = seq[~rule]
        pairs = rules[seq[rule] - base]
        out[at[rule]], out[at[rule] + 1] = pairs[:, 0], pairs[:, 1]
        seq = out
    return seq.astype(np.uint32)


SHARDS = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("base", pa.int32()), ("known", pa.binary()), ("doc_ids", pa.binary()), ("doc_symbols", pa.binary()), ("doc_tokens", pa.binary()), ("rules", pa.binary()), ("rule_lengths", pa.binary()), ("symbols", pa.binary())])
SHARDS_SQL = "part int, seq int, n_docs bigint, n_tokens bigint, base int, known binary, doc_ids binary, doc_symbols binary, doc_tokens binary, rules binary, rule_lengths binary, symbols binary"


def shard(part: int, seq: int, ids: list, arrays: list[np.ndarray], base: int) -> pa.RecordBatch:
    n = np.array([len(a) for a in arrays], np.int64)
    symbols, ends, rules, lengths = compress(np.concatenate(arrays), np.cumsum(n), base)
    row = {"part": part, "seq": seq, "n_docs": len(ids), "n_tokens": int(n.sum()), "base": base}
    row |= {"known": np.array([i is not None for i in ids], np.uint8).tobytes(), "doc_ids": np.array([i or 0 for i in ids], "<i8").tobytes()}
    row |= {"doc_symbols": np.diff(ends, prepend=0).astype("<u4").tobytes(), "doc_tokens": n.astype("<u4").tobytes()}
    row |= {"rules": rules.astype("<u2").tobytes(), "rule_lengths": lengths.astype("<u4").tobytes(), "symbols": symbols.astype("<u2").tobytes()}
    return pa.RecordBatch.from_pylist([row], schema=SHARDS)


class Encoder:
    """Ids of texts. White space parts words in this vocabulary, so each stretch between is encoded once and kept.

    Stretches of plain letters with marks behind are two words of the tokenizer each. Such words need no normalisation but
    lower case; they are encoded many at once and told apart by the pieces that end a word. All others are encoded alone.
    """

    MOST, TOGETHER = 500_000, 1000
    # No letter here turns into more than one when lower-cased, and no mark is part of a contraction.
    PLAIN = re.compile("([A-Za-z" + "".join(map(chr, (*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x130), *range(0x131, 0x250)))) + r"]+)([,.!?;:*%&#$|]*)")

    def __init__(self, tokenizer_json: str):
        self.tokenizer, self.known, self.plain = load(tokenizer_json), {}, {}
        bare = json.loads(tokenizer_json) | {"normalizer": None, "added_tokens": []}
        suffix = bare["model"]["end_of_word_suffix"]
        self.bare = Tokenizer.from_str(json.dumps(bare))
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends_word = np.zeros(1 << 16, bool)
        self.ends_word[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True

    def encode(self, words: list[str]) -> None:
        groups = [words[i : i + self.TOGETHER] for i in range(0, len(words), self.TOGETHER)]
        for group, e in zip(groups, self.bare.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint16)
            ends = (2 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
            data = ids.tobytes()
            self.plain.update((w, data[a:z]) for w, a, z in zip(group, [0, *ends], ends, strict=False))

    def learn(self, new: list[bytes]) -> None:
        fits = self.PLAIN.fullmatch
        parts = [(c, m[1].lower(), m[2]) if (m := fits(c.decode("utf-8", "surrogatepass"))) else (c, None, None) for c in new]
        alone = [c for c, a, _ in parts if a is None]
        found = self.tokenizer.encode_batch_fast([c.decode("utf-8", "surrogatepass") for c in alone], add_special_tokens=False)
        self.known.update((c, np.array(e.ids, np.uint16).tobytes()) for c, e in zip(alone, found))
        plain = self.plain
        self.encode(list({w for _, a, z in parts if a is not None for w in (a, z) if w and w not in plain}))
        plain[""] = b""
        self.known.update((c, plain[a] + plain[z]) for c, a, z in parts if a is not None)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        split = [t.encode("utf-8", "surrogatepass").split() for t in texts]  # at ASCII white space
        new = set().union(*split).difference(self.known)
        if new:
            self.learn(list(new))
        out = [np.frombuffer(b"".join(map(self.known.__getitem__, s)), np.uint16) for s in split]
        if len(self.known) > self.MOST:
            self.known, self.plain = {}, {}
        return out


def write(docs: DataFrame, path: str, tokenizer_json: str, end_id: int = 2, rows_per_range: int = 4000, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode every text, append ``end_id`` and write the shards in ascending ``doc_id`` order.

    A null text is empty and gives the end id alone; a null id comes first; rows with one id are ordered by their ids.
    Documents go to ranges of ids with their ids already encoded, two bytes a token. An empty table writes no shard.
    """
    src = C.texts(docs)
    bounds = np.array(C.range_bounds(src, rows_per_range), np.int64)
    base = load(tokenizer_json).get_vocab_size(with_added_tokens=True)
    if not end_id < base < 1 << 16:
        raise ValueError("the file format has 16-bit symbols")

    def encode(batches):
        encoder = Encoder(tokenizer_json)
        for whole in batches:
            for i in range(0, whole.num_rows, 128):
                b = whole.slice(i, 128)
                ids = encoder(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(C.range_of(bounds, b.column("doc_id"))), b.column("doc_id"), pa.array([x.tobytes() for x in ids], pa.binary())], names=["part", "doc_id", "ids"])

    def store(batches):
        for part, rows in C.in_groups(C.rows_of(batches), lambda r: r["part"]):
            seq, ids, arrays, size = 0, [], [], 0
            for r in rows:
                a = np.append(np.frombuffer(r["ids"], np.uint16), np.uint16(end_id))
                if size and size + len(a) > shard_tokens:
                    yield shard(part, seq, ids, arrays, base)
                    seq, ids, arrays, size = seq + 1, [], [], 0
                ids.append(r["doc_id"])
                arrays.append(a)
                size += len(a)
            yield shard(part, seq, ids, arrays, base)

    encoded = src.mapInArrow(encode, "part int, doc_id bigint, ids binary")
    ordered = encoded.repartition("part").sortWithinPartitions("part", "doc_id", "ids")
    ordered.mapInArrow(store, SHARDS_SQL).write.parquet(path)


def with_starts(shards: DataFrame) -> DataFrame:
    """Each shard with the number of tokens before it: a running sum inside a range, on top of the ranges before."""
    sizes = shards.select("part", "seq", "n_tokens")
    inside = sizes.select("part", "seq", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")).alias("within"))
    totals = sizes.groupBy("part").agg(F.sum("n_tokens").alias("t"))
    before = totals.select("part", (F.sum("t").over(Window.orderBy("part")) - F.col("t")).alias("before"))
    starts = inside.join(before, "part").select("part", "seq", (F.col("within") + F.col("before")).alias("start"))
    return shards.join(starts, ["part", "seq"])


def read(spark, path: str) -> DataFrame:
    """``doc_id, start, ids``: the documents of the written shards, expanded."""

    def run(batches):
        for r in C.rows_of(batches, 1):
            for d, start, ids in unpacked(r):
                yield pa.RecordBatch.from_pylist([{"doc_id": d, "start": start, "ids": ids.tolist()}], schema=pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    return with_starts(spark.read.schema(SHARDS_SQL).parquet(path)).mapInArrow(run, "doc_id bigint, start bigint, ids array<int>")


def unpacked(r: dict):
    """``(doc_id, start, ids)`` of every document of a shard."""
    rules = np.frombuffer(r["rules"], "<u2").reshape(-1, 2)
    ids = expand(np.frombuffer(r["symbols"], "<u2"), rules, r["base"])
    n = np.frombuffer(r["doc_tokens"], "<u4").astype(np.int64)
    ends = np.cumsum(n)
    for known, d, a, b in zip(r["known"], np.frombuffer(r["doc_ids"], "<i8").tolist(), (ends - n).tolist(), ends.tolist()):
        yield (d if known else None), r["start"] + a, ids[a:b]


def document(r: dict, index: int, begin: int = 0, end: int | None = None) -> np.ndarray:
    """Random access: ids ``begin`` to ``end`` of one document of a shard row, touching only its symbols.

    Symbols that lie wholly outside are skipped by their expansion lengths.
    """
    n = np.frombuffer(r["doc_symbols"], "<u4").astype(np.int64)
    stop = int(n[: index + 1].sum())
    symbols = np.frombuffer(r["symbols"], "<u2")[stop - int(n[index]) : stop]
    lengths = np.concatenate([np.ones(r["base"], np.int64), np.frombuffer(r["rule_lengths"], "<u4").astype(np.int64)])[symbols]
    total = int(lengths.sum())
    end = total if end is None else min(end, total)
    ends = np.cumsum(lengths)
    inside = (ends > begin) & (ends - lengths < end)
    if not inside.any():
        return np.empty(0, np.uint32)
    first = int((ends - lengths)[inside][0])
    return expand(symbols[inside], np.frombuffer(r["rules"], "<u2").reshape(-1, 2), r["base"])[begin - first : end - first]


READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def digests(spark, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files."""

    def run(batches):
        for r in C.rows_of(batches, 1):
            rows = [{"doc_id": d, "start": s, "n_tokens": len(x), "ids_crc32": zlib.crc32(x.astype("<u4").tobytes())} for d, s, x in unpacked(r)]
            yield pa.RecordBatch.from_pylist(rows, schema=READ)

    return with_starts(spark.read.schema(SHARDS_SQL).parquet(path)).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def new_path(spark) -> str:
    return f"{shared_dir(spark)}/tables/token_shards_{uuid.uuid4().hex}"
