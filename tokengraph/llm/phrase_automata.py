"""Repeated passages, found by window fingerprints and removed by Aho-Corasick automata.

Documents are packed into blocks. Each block sends a fingerprint of every window of its words, once per block, to the
bucket of the fingerprint; a bucket tells every block which of its windows stand in an earlier document of another block,
and where. Windows in a row become passages, whose words the earlier document's block sends back: a passage is confirmed by
those words, not by fingerprints. Every block then compiles its passages into automata of bounded size, streams all of its
documents through them and marks each occurrence. Blocks and buckets bound all memory; a passage found in a third of all
documents is one entry per block.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokengraph.llm import common as C

WINDOW = 13
BLOCK_CHARS, BUCKET_WINDOWS, AUTOMATON_CHARS = 2_000_000, 2_000_000, 1_000_000
HASH_BYTES = 7
"""Stored bytes of a fingerprint, beside the bits its bucket implies. Two different windows in one bucket that agree in all
of them could hide an earlier occurrence: about one window in 3e10 at this bucket size, whatever the size of the corpus."""
NO_ID = (1 << 63) - 1

BLOCKS = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary()), ("words", pa.binary()), ("n_windows", pa.int64())])
BLOCKS_SQL = "block bigint, ids binary, counts binary, words binary, n_windows bigint"


def pack_blocks(docs: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per block: ids in order, words per document, and the words of all documents joined by single spaces."""

    def run(batches):
        count, base = 0, C.partition_id() << 32
        held, size = [], 0

        def block():
            nonlocal count, held, size
            count += 1
            held.sort(key=lambda x: x[0])
            counts = np.array([n for _, n, _ in held], np.int64)
            made = {"block": base + count, "ids": C.pack(np.array([i for i, _, _ in held], np.int64)), "counts": C.pack(counts)}
            made |= {"words": C.squeeze(b" ".join(w for _, n, w in held if n)), "n_windows": int(np.maximum(counts - window + 1, 0).sum())}
            held, size = [], 0
            return pa.RecordBatch.from_pylist([made], schema=BLOCKS)

        for r in C.rows_of(batches):
            words = r["text"].encode("utf-8", "surrogatepass").split()
            held.append((NO_ID if r["doc_id"] is None else r["doc_id"], len(words), b" ".join(words)))
            size += len(held[-1][2]) + 16
            if size >= block_chars:
                yield block()
        if held:
            yield block()

    return C.texts(docs).mapInArrow(run, BLOCKS_SQL)


class Block:
    def __init__(self, row: dict, window: int):
        self.window = window
        self.ids, self.counts = C.unpack(row["ids"], np.int64), C.unpack(row["counts"], np.int64)
        self.words = C.expand(row["words"])
        self.ends = np.cumsum(self.counts)
        data = np.frombuffer(self.words + b" ", np.uint8) if self.words else np.empty(0, np.uint8)
        self.data, self.stops = data, np.flatnonzero(data == 32)
        self.starts = np.concatenate([[0], self.stops[:-1] + 1]) if len(self.stops) else self.stops

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First words of all windows, their fingerprints, and the place of the first equal one in the block."""
        n = len(self.stops) - self.window + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
        doc = np.repeat(np.arange(len(self.counts)), self.counts)
        at = np.flatnonzero(doc[:n] == doc[self.window - 1 :])
        h = C.span_hashes(self.data, self.starts[at], self.stops[at + self.window - 1])
        _, first, same = np.unique(h, return_index=True, return_inverse=True)
        return at, h, first[same]

    def doc_at(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, word, side="right")

    def id_at(self, word: np.ndarray) -> np.ndarray:
        return self.ids[self.doc_at(word)]

    def text(self, first: int, n: int) -> bytes:
        return self.words[self.starts[first] : self.stops[first + n - 1]]


def deltas(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=a.dtype.type(0))


def planes(a: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of every entry, byte by byte of the entries, compressed."""
    return C.squeeze(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize)[:, :width].T.tobytes())


def from_planes(b: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(C.expand(b), np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :width] = raw.T
    return out.view("<u8")[:, 0]


def schema(**kinds) -> pa.Schema:
    return pa.schema(list(kinds.items()))


PACKET = schema(bucket=pa.int32(), block=pa.int64(), hashes=pa.binary(), places=pa.binary(), ids=pa.binary(), docs=pa.binary())
REPLY = schema(block=pa.int64(), owners=pa.binary(), counts=pa.binary(), found=pa.binary())
ASKED = schema(block=pa.int64(), target=pa.int64(), runs=pa.binary())
PHRASES = schema(block=pa.int64(), ids=pa.binary(), texts=pa.binary())
MADE = schema(doc_id=pa.int64(), n_words=pa.int64(), n_removed=pa.int64(), kept=pa.string(), removed=pa.binary())


def spans_of(keys: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of every stretch of equal keys."""
    if not len(keys):
        return []
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])).tolist()
    return list(zip(cuts, cuts[1:]))


def fingerprints(blocks: DataFrame, n_buckets: int, window: int) -> DataFrame:
    def run(batches):
        for r in C.rows_of(batches, 1):
            b = Block(r, window)
            at, h, first = b.windows()
            own = np.flatnonzero(first == np.arange(len(at)))  # each fingerprint once per block, where it stands first
            more = np.flatnonzero(first != np.arange(len(at)))
            more = more[b.doc_at(at[more]) == b.doc_at(at[first[more]])]
            again = np.zeros(len(at), np.int64)
            again[first[more]] = 1  # it stands again in that document: it will be asked for by itself, too
            at, h, again = at[own], h[own], again[own]
            bucket = ((h >> np.uint64(56)) << np.uint64(24) ^ (h >> np.uint64(32) & np.uint64(0xFFFFFF))) % np.uint64(n_buckets)
            order = np.argsort(bucket.astype(np.uint16) if n_buckets < 1 << 16 else bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1, dtype=np.uint64))
            doc = b.doc_at(at)
            made: list[list] = [[] for _ in PACKET]
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                pick = order[cuts[k] : cuts[k + 1]]
                docs, local = np.unique(doc[pick], return_inverse=True)  # only documents with a window here
                places = planes(deltas(at[pick] * 2 + again[pick]).astype(np.uint32), 4)
                row = (k, r["block"], planes(h[pick], HASH_BYTES), places, C.pack(deltas(b.ids[docs])), C.pack(deltas(local.astype(np.int64)).astype(np.uint8)))
                for column, value in zip(made, row):
                    column.append(value)
            if made[0]:
                yield C.batch(PACKET, made)

    return blocks.mapInArrow(run, "bucket int, block bigint, hashes binary, places binary, ids binary, docs binary")


def earlier(packets: DataFrame) -> DataFrame:
    """One row per bucket and block: which windows of the block stand where in a document with a smaller id of another."""

    def run(batches):
        for _, rows in C.in_groups(C.rows_of(batches, 8), lambda r: r["bucket"]):
            names, h, place, doc, source, again = [], [], [], [], [], []
            for r in rows:
                at = np.cumsum(from_planes(r["places"], 4).astype(np.int64))
                again.append(at & 1)
                at >>= 1
                h.append(from_planes(r["hashes"], HASH_BYTES))
                place.append(at)
                doc.append(np.cumsum(C.unpack(r["ids"], np.int64))[np.cumsum(C.unpack(r["docs"], np.uint8), dtype=np.int64)])
                source.append(np.full(len(at), len(names), np.int32))
                names.append(r["block"])
            h, place, doc, source, again = map(np.concatenate, (h, place, doc, source, again))
            order = np.argsort(h, kind="stable")
            s = h[order]
            new = np.ones(len(s), bool)
            new[1:] = s[1:] != s[:-1]
            group = np.cumsum(new) - 1
            several = np.bincount(group)[group] > 1
            order, group = order[several], group[several]
            if not len(order):
                continue
            order = order[np.lexsort((place[order], doc[order], group))]  # groups keep their places
            lead = np.ones(len(order), bool)
            lead[1:] = group[1:] != group[:-1]
            owner = order[np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))]
            pick = doc[owner] < doc[order]
            order, owner = order[pick], owner[pick]
            target, theirs = source[order], source[owner]
            by = np.lexsort((place[order], theirs, target))
            order, owner, target, theirs = order[by], owner[by], target[by], theirs[by]
            made: list[list] = [[] for _ in REPLY]
            for a, z in spans_of(target):
                t, o = place[order[a:z]], place[owner[a:z]]
                parts = spans_of(theirs[a:z])
                made[0].append(names[target[a]])
                made[1].append(C.pack(np.array([names[theirs[a + x]] for x, _ in parts], np.int64)))
                made[2].append(C.pack(np.array([y - x for x, y in parts], np.int32)))
                made[3].append(C.pack(np.concatenate([deltas(t * 2 + again[order[a:z]]), deltas(o - t)]).astype(np.int32)))
            yield C.batch(REPLY, made)

    return packets.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "block bigint, owners binary, counts binary, found binary")


def passages(replies: DataFrame, window: int) -> DataFrame:
    """Windows in a row as passages: one row per owner block and asking block, with first words there and lengths in words."""

    def run(batches):
        for block, rows in C.in_groups(C.rows_of(batches, 64), lambda r: r["block"]):
            at, shift, owner = [], [], []
            for r in rows:
                both = C.unpack(r["found"], np.int32).reshape(2, -1).astype(np.int64).cumsum(axis=1)
                at.append(both[0])
                shift.append(both[1])
                owner.append(np.repeat(C.unpack(r["owners"], np.int64), C.unpack(r["counts"], np.int32)))
            at, shift, owner = map(np.concatenate, (at, shift, owner))
            order = np.lexsort((at, shift, owner))
            at, shift, owner = at[order], shift[order], owner[order]
            single = (at & 1).astype(bool)
            at >>= 1
            begin = np.ones(len(at), bool)
            begin[1:] = (owner[1:] != owner[:-1]) | (shift[1:] != shift[:-1]) | (at[1:] != at[:-1] + 1)
            first = np.flatnonzero(begin)
            n = np.diff(np.append(first, len(at))) + window - 1
            alone = np.flatnonzero(single)
            runs = np.stack([np.append(owner[first], owner[alone]), np.append((at + shift)[first], (at + shift)[alone]), np.append(n, np.full(len(alone), window))])
            runs = np.unique(runs, axis=1)
            made: list[list] = [[] for _ in ASKED]
            for a, z in spans_of(runs[0]):
                made[0].append(int(runs[0, a]))
                made[1].append(block)
                made[2].append(C.pack(runs[1:, a:z]))
            yield C.batch(ASKED, made)

    return replies.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block bigint, target bigint, runs binary")


def confirmed(blocks: DataFrame, asked: DataFrame, window: int) -> DataFrame:
    """The words of the passages and the document each stands in, for the blocks that asked."""

    def run(batches):
        own = None
        for r in C.rows_of(batches, 4):
            if r["words"] is not None:
                own = Block(r, window)
                continue
            first, n = C.unpack(r["runs"], np.int64).reshape(2, -1)
            texts = b"\n".join([own.text(a, k) for a, k in zip(first.tolist(), n.tolist())])
            yield pa.RecordBatch.from_pylist([{"block": r["target"], "ids": C.pack(own.id_at(first)), "texts": C.squeeze(texts)}], schema=PHRASES)

    nothing = [F.lit(None).cast("binary").alias(c) for c in ("ids", "counts", "words")]
    wanted = asked.select("block").distinct()
    rows = blocks.join(wanted, "block", "left_semi").select("block", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("target"), F.lit(None).cast("binary").alias("runs"), "ids", "counts", "words")
    rows = rows.unionByName(asked.select("block", F.lit(1).alias("kind"), "target", "runs", *nothing))
    return rows.repartition("block").sortWithinPartitions("block", "kind", "target").mapInArrow(run, "block bigint, ids binary, texts binary")


def automata(phrases: dict[str, int], most_chars: int = AUTOMATON_CHARS):
    """Automata over the phrases, each of about ``most_chars`` letters; a phrase's value is its document and length."""
    part, size = ahocorasick.Automaton(), 0
    for phrase, doc in phrases.items():
        key = f" {phrase} "
        part.add_word(key, (doc, key.count(" ") - 1))
        size += len(key)
        if size >= most_chars:
            part.make_automaton()
            yield part
            part, size = ahocorasick.Automaton(), 0
    if size:
        part.make_automaton()
        yield part


def own_phrases(b: Block) -> dict[str, int]:
    """Passages of a later document of the block that stand in an earlier one of the same block."""
    at, _, first = b.windows()
    out: dict[str, int] = {}
    if not len(at):
        return out
    doc, doc_first = b.id_at(at), b.id_at(at[first])
    pick = np.flatnonzero(doc_first < doc)
    if not len(pick):
        return out
    there = at[first[pick]]
    begin = np.ones(len(pick), bool)
    begin[1:] = (at[pick][1:] != at[pick][:-1] + 1) | (there[1:] != there[:-1] + 1)
    lead = np.flatnonzero(begin)
    n = np.diff(np.append(lead, len(pick))) + b.window - 1
    for a, k, d in zip(there[lead].tolist(), n.tolist(), doc_first[pick][lead].tolist()):
        phrase = b.text(a, k).decode("utf-8", "surrogatepass")
        out[phrase] = min(d, out.get(phrase, d))
    return out


def marked(b: Block, phrases: dict[str, int]) -> np.ndarray:
    """Words of the block that lie in an occurrence of a phrase from a document with a smaller id."""
    gone = np.zeros(len(b.stops), bool)
    ends = b.ends.tolist()
    texts, spaces = [], []
    for i, n in enumerate(b.counts.tolist()):
        first = ends[i] - n
        texts.append(f" {b.text(first, n).decode('utf-8', 'surrogatepass')} " if n >= b.window else None)
        spaces.append(None)
    for machine in automata(phrases):
        for i, text in enumerate(texts):
            if text is None or b.ids[i] == NO_ID:
                continue
            own = int(b.ids[i])
            for end, (doc, n) in machine.iter(text):
                if doc >= own:
                    continue
                if spaces[i] is None:
                    spaces[i] = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") == 32)
                last = int(np.searchsorted(spaces[i], end)) + ends[i] - int(b.counts[i])
                gone[last - n : last] = True
    return gone


def located(blocks: DataFrame, phrases: DataFrame, window: int) -> DataFrame:
    def run(batches):
        for _, rows in C.in_groups(C.rows_of(batches, 8), lambda r: r["block"]):
            known: dict[str, int] = {}
            for r in rows:
                if r["texts"] is not None:
                    for phrase, d in zip(C.expand(r["texts"]).decode("utf-8", "surrogatepass").split("\n"), C.unpack(r["ids"], np.int64).tolist()):
                        known[phrase] = min(d, known.get(phrase, d))
                    continue
                b = Block(r, window)
                for phrase, d in own_phrases(b).items():
                    known[phrase] = min(d, known.get(phrase, d))
                gone = marked(b, known) if known else np.zeros(len(b.stops), bool)
                made, words = [], b.words.split(b" ") if b.words else []
                for d, n, end in zip(b.ids.tolist(), b.counts.tolist(), b.ends.tolist()):
                    mask = gone[end - n : end]
                    removed = int(mask.sum())
                    kept = [w for w, g in zip(words[end - n : end], mask.tolist()) if not g] if removed else words[end - n : end]
                    made.append({"doc_id": None if d == NO_ID else d, "n_words": n, "n_removed": removed, "kept": b" ".join(kept).decode("utf-8", "surrogatepass"), "removed": np.packbits(mask).tobytes() if removed else b""})
                    if len(made) >= 256:
                        yield pa.RecordBatch.from_pylist(made, schema=MADE)
                        made = []
                if made:
                    yield pa.RecordBatch.from_pylist(made, schema=MADE)

    nothing = [F.lit(None).cast("binary").alias(c) for c in ("counts", "words")]
    rows = blocks.select("block", F.lit(1).alias("kind"), "ids", F.lit(None).cast("binary").alias("texts"), "counts", "words")
    rows = rows.unionByName(phrases.select("block", F.lit(0).alias("kind"), "ids", "texts", *nothing))
    return rows.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept string, removed binary")


def deduplicate(docs: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS, bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept, removed``: one row per input row.

    Words are runs of anything but ASCII white space. A word goes if it lies in a window of ``window`` words that also
    stands in a document with a smaller id; windows are judged on the input. ``kept`` is the rest joined by single spaces,
    ``removed`` a bit per word (empty if none). A null text has no words; a row without an id loses nothing and takes
    nothing from others; rows that share an id take nothing from each other. Other columns are not carried.
    """
    blocks = C.cut(pack_blocks(docs, window, block_chars))
    total = blocks.agg(F.sum("n_windows")).first()[0] or 0
    packets = fingerprints(blocks, max(1, -(-total // bucket_windows)), window)
    asked = C.cut(passages(earlier(packets), window))
    return located(blocks, confirmed(blocks, asked, window), window)
