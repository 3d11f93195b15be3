"""Hash-chained audit log that is appended, verified and searched in parallel.

Entries carry a dense ``seq``. The chain is cut into segments of ``segment`` entries; inside a segment each entry
names the hash of the one before, and the segment ends are chained the same way one level up, and so on to one root.
Changing, dropping or moving any entry changes the root, and no task ever handles more than one segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokengraph.functions import constants as K
from tokengraph.session import cut

SEGMENT = 1000
ENTRY_TYPE = "array<struct<seq:bigint,prev_hash:string,entry_hash:string>>"


def json_string(c: Column) -> Column:
    """A JSON string literal, quotes and escapes included."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)


def canonical_entry(details: Column, event_type: Column, prev_hash: Column, timestamp: Column) -> Column:
    """Entry text with sorted keys and ``", "`` / ``": "`` separators; ``details`` is already JSON."""
    return F.concat(
        F.lit('{"details": '), details,
        F.lit(', "event_type": '), json_string(event_type),
        F.lit(', "prev_hash": "'), prev_hash,
        F.lit('", "timestamp": '), json_string(timestamp),
        F.lit("}"),
    )


def _fold(rows: Column, first_prev: Column) -> Column:
    """Chain an ordered array of (seq, head, tail) where an entry's text is head || prev_hash || tail."""
    zero = F.struct(first_prev.alias("prev"), F.array().cast(ENTRY_TYPE).alias("out"))

    def step(acc: Column, r: Column) -> Column:
        digest = F.sha2(F.concat(r["head"], acc["prev"], r["tail"]), 256)
        # Bind the digest once per entry.
        one = F.transform(
            F.array(digest),
            lambda h: F.struct(
                h.alias("prev"),
                F.concat(
                    acc["out"],
                    F.array(F.struct(r["seq"].alias("seq"), acc["prev"].alias("prev_hash"), h.alias("entry_hash"))),
                ).alias("out"),
            ),
        )
        return F.get(one, F.lit(0))

    return F.aggregate(rows, zero, step, lambda acc: acc["out"])


def chain_entries(events: DataFrame, segment: int = SEGMENT, genesis: str = K.GENESIS, head: tuple[int, str] | None = None) -> DataFrame:
    """(seq, segment, prev_hash, entry_hash) for events (seq, event_type, details, ts). One shuffle of the texts.

    A segment is a fixed range of ``seq``, so a group has at most ``segment`` entries whatever the data looks like.
    ``head`` (seq, entry_hash) is the last stored entry: the segment it left open goes on from it.
    """
    first = F.lit(genesis)
    if head is not None and (head[0] + 1) % segment:
        first = F.when(F.col("segment") == head[0] // segment, F.lit(head[1])).otherwise(first)
    parts = events.select(
        F.floor(F.col("seq") / segment).cast("bigint").alias("segment"),
        F.struct(
            F.col("seq").cast("bigint").alias("seq"),
            F.concat(
                F.lit('{"details": '), "details", F.lit(', "event_type": '), json_string(F.col("event_type")),
                F.lit(', "prev_hash": "'),
            ).alias("head"),
            F.concat(F.lit('", "timestamp": '), json_string(F.col("ts")), F.lit("}")).alias("tail"),
        ).alias("e"),
    )
    folded = parts.groupBy("segment").agg(F.array_sort(F.collect_list("e")).alias("es")).withColumn("es", _fold(F.col("es"), first))
    return folded.select("segment", F.explode("es").alias("e")).select("e.seq", "segment", "e.prev_hash", "e.entry_hash")


def segment_ends(chained: DataFrame) -> DataFrame:
    """(segment, n, end_hash)."""
    return chained.groupBy("segment").agg(
        F.count("*").alias("n"), F.max(F.struct("seq", "entry_hash"))["entry_hash"].alias("end_hash")
    )


def seal_level(ends: DataFrame, segment: int = SEGMENT, genesis: str = K.GENESIS) -> DataFrame:
    """Chain segment ends into the next level: (segment, n, end_hash) with ``segment`` counted one level up."""
    parts = ends.select(
        F.floor(F.col("segment") / segment).cast("bigint").alias("up"),
        F.struct(
            F.col("segment").alias("seq"), F.lit("").alias("head"), F.concat(F.lit("|"), "end_hash").alias("tail"), "n"
        ).alias("e"),
    )
    grouped = parts.groupBy("up").agg(F.array_sort(F.collect_list("e")).alias("es"), F.sum("e.n").alias("n"))
    return grouped.select(
        F.col("up").alias("segment"), "n", F.element_at(_fold(F.col("es"), F.lit(genesis)), -1)["entry_hash"].alias("end_hash")
    )


def seal(chained: DataFrame, max_seq: int, segment: int = SEGMENT) -> DataFrame:
    """One-row root over all segments. ``max_seq`` only sets the number of levels (its logarithm)."""
    return seal_ends(segment_ends(chained), max_seq, segment)


def seal_ends(ends: DataFrame, max_seq: int, segment: int = SEGMENT) -> DataFrame:
    """``seal`` of (segment, n, end_hash)."""
    level, count = ends, max_seq // segment + 1
    while count > 1:
        level, count = seal_level(level, segment), (count - 1) // segment + 1
    return level


def verify_links(entries: DataFrame, segment: int = SEGMENT, genesis: str = K.GENESIS) -> DataFrame:
    """Add ``chain_valid``: the entry names the hash of the entry before it in its segment (or the genesis).

    An equi-join of each entry with its successor; ``seq`` is unique, so no key is hot and no window is needed.
    """
    before = entries.select((F.col("seq") + 1).alias("seq"), F.col("entry_hash").alias("_before"))
    starts = F.pmod(F.col("seq"), F.lit(segment)) == 0
    ok = F.when(starts, F.col("prev_hash") == genesis).otherwise(F.col("prev_hash") == F.col("_before"))
    return entries.join(before, "seq", "left").withColumn("chain_valid", F.coalesce(ok, F.lit(False))).drop("_before")


def verify_contents(entries: DataFrame) -> DataFrame:
    """Add ``content_valid``: the stored hash is the hash of the stored fields."""
    text = canonical_entry(F.col("details"), F.col("event_type"), F.col("prev_hash"), F.col("ts"))
    return entries.withColumn("content_valid", F.sha2(text, 256) == F.col("entry_hash"))


def append_events(log: DataFrame, events: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The new entries of a stored log, in its shape: ``events`` (seq from 0 on, ts, event_type, details) follow its last one."""
    last = log.agg(F.max(F.struct("seq", "entry_hash")).alias("h")).first()["h"]
    head = None if last is None else (last["seq"], last["entry_hash"])
    fresh = events.withColumn("seq", F.col("seq") + (0 if head is None else head[0] + 1))
    chained = chain_entries(fresh, segment, head=head).select("seq", "prev_hash", "entry_hash")
    return fresh.join(chained, "seq").select("seq", "ts", "event_type", "details", "prev_hash", "entry_hash")


def root_of(log: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(n, end_hash) of a stored log: what is kept beside it. No row for an empty log."""
    top = log.agg(F.max("seq")).first()[0]
    if top is None:
        return log.select(F.lit(0).cast("bigint").alias("n"), F.lit("").alias("end_hash")).limit(0)
    placed = log.select("seq", "entry_hash", F.floor(F.col("seq") / segment).cast("bigint").alias("segment"))
    return seal(placed, top, segment).select("n", "end_hash")


def checked_segments(log: DataFrame, segment: int = SEGMENT, genesis: str = K.GENESIS) -> DataFrame:
    """(segment, n, low, high, ok, twice, end_hash) per segment of a stored log: count, range, links and contents, repeated places, end.

    Contents are checked where entries are read; of an entry only its place and its hashes are exchanged, once, and what
    comes before it is found in its segment, which holds its predecessor unless it is the segment's first.
    """
    seq = F.col("seq")
    placed = verify_contents(log).select(F.floor(seq / segment).cast("bigint").alias("segment"), "seq", "prev_hash", "entry_hash", "content_valid").repartition("segment")
    linked = placed.withColumn("_b", F.lag(F.struct("seq", "entry_hash")).over(Window.partitionBy("segment").orderBy("seq")))
    follows = (F.col("_b.seq") == seq - 1) & (F.col("prev_hash") == F.col("_b.entry_hash"))
    link = F.coalesce(F.when(F.pmod(seq, F.lit(segment)) == 0, F.col("prev_hash") == genesis).otherwise(follows), F.lit(False))
    return linked.groupBy("segment").agg(
        F.count("*").alias("n"), F.min("seq").alias("low"), F.max("seq").alias("high"), F.every(link & F.col("content_valid")).alias("ok"),
        F.max(F.coalesce(F.col("_b.seq") == seq, F.lit(False))).alias("twice"), F.max(F.struct("seq", "entry_hash"))["entry_hash"].alias("end_hash"),
    )


def log_status(log: DataFrame, root: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(entries, valid): links, contents, every ``seq`` from 0 on exactly once, and the root kept beside the log.

    Links and contents alone do not show a missing or exchanged segment or a cut tail; the root does. All follows from a
    row per segment, which is materialised.
    """
    parts = cut(checked_segments(log, segment))
    state = parts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("entries"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.coalesce(F.every("ok"), F.lit(False)).alias("ok"), F.max("twice").alias("twice"),
    )
    top = parts.agg(F.max("high")).first()[0]
    ends = parts.select("segment", "n", "end_hash")
    now = ends.limit(0) if top is None else seal_ends(ends, top, segment)
    kept = root.agg(F.max("n").alias("n"), F.max("end_hash").alias("root"))
    whole = state.join(kept, F.lit(True)).join(now.select(F.col("n").alias("n_now"), F.col("end_hash").alias("root_now")), F.lit(True), "left")  # one row each
    valid = F.col("ok") & ~F.col("twice") & (F.col("low") == 0) & (F.col("high") == F.col("entries") - 1) & (F.col("n") == F.col("n_now")) & (F.col("root") == F.col("root_now"))
    return whole.select("entries", F.coalesce(valid, F.lit(False)).alias("valid"))


def chain_status(verified: DataFrame) -> DataFrame:
    """(entries, valid): valid only when there is an entry and every check holds."""
    checks = [c for c in ("chain_valid", "content_valid") if c in verified.columns]
    ok = F.lit(True)
    for c in checks:
        ok = ok & F.col(c)
    return verified.agg(
        F.count("*").alias("entries"), F.coalesce(F.every(ok), F.lit(False)).alias("valid")
    )


def tail(entries: DataFrame, n: int = 50) -> DataFrame:
    """The last ``n`` entries, oldest first (a distributed top-n)."""
    return entries.orderBy(F.col("seq").desc()).limit(n).orderBy("seq")


def search(entries: DataFrame, needle: str) -> DataFrame:
    """Entries whose type, details or hash contain ``needle``, any case."""
    n = F.lit(needle.lower())
    fields = [F.contains(F.lower(F.col(c)), n) for c in ("event_type", "details", "entry_hash")]
    return entries.filter(fields[0] | fields[1] | fields[2])
