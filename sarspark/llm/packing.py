"""Mixture-controlled packing: deficit round-robin over source queues, with deficits known at every window.

A source's documents form one queue of tokens over the whole corpus. Every window of 2048 tokens
adds each queue's share to what it is owed, queues are visited in a fixed round, and each is
served the whole tokens of the running sum; fractions stay owed. So after n windows a queue has
had ``floor(n * high) - floor(n * low)`` tokens, where low and high are the sums of the shares of
the queues before it and up to it: never a token away from its target, and
under two in any one window. As that is a closed form, the deficits at any window are known
without the windows before it, and partitions carry them on exactly: nothing begins at zero, and
the corpus has one window that is not full, the last.

Documents are tokenised once, into chunks of one source's ids. A prefix sum over the narrow chunk
table gives each chunk its place in its queue, and a chunk then cuts itself into the pieces of the
windows that it meets. Ids are never shuffled by key unless the chunk table outgrows a broadcast.

With a target of its own a queue may run out before the others. Windows up to there follow the
formula; the window in which it runs out is filled by the others' shares; then the formula goes
on, with nothing owed, for those that are left.

Queues are bounded by the window: a source whose share is under one token a window waits in one
queue with the others of that size, and those without a share wait in one that is served last.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Written, spare, text_of

WINDOW = 2048
END_ID = 1
SEED = 20
#: Tokens of a chunk, and tokens that may wait for their chunks in one task (four bytes each at most).
CHUNK, WAITING = 1 << 18, 1 << 24
#: Chunks that a bucket of the prefix sum holds on average, while there are fewer buckets than the second.
BUCKET_CHUNKS, BUCKET_BITS = 512, 16


@lru_cache(maxsize=2)
def _slow(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _fast(path: str):
    """The same vocabulary as byte ranks, where the file beside ``path`` has them: four times faster."""
    ranks = Path(path).with_suffix(".tiktoken")
    if not ranks.exists():
        return None
    import base64

    import public_tokenizers
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.open("rb"))}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def token_ids(text: str, path: str) -> np.ndarray:
    """The ids that ``tokenizers`` gives ``text``, as unsigned 32-bit integers, without an end id.

    The quick library serves where both agree (see the README); what it refuses, such as a run
    of a million blanks, goes to ``tokenizers``.
    """
    fast = _fast(path)
    if fast is not None and "<|" not in text and (text.isascii() or not _odd(text)):
        try:
            return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), dtype="<u4")
        except ValueError:
            pass
    return np.array(_slow(path).encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")


def _odd(text: str) -> bool:
    """Whether ``text`` has white space on which the two libraries' patterns might differ."""
    return any(c in text for c in "\x85\u180e\u2028\u2029\ufeff")


@dataclass
class Stretch:
    """Windows from ``first`` on with the same shares.

    ``sums`` are the running sums of the queues' weights after a zero, ``total`` their last one,
    ``served`` what each queue had before. A stretch of one window with ``quotas`` has these instead.
    """

    first: int
    count: int
    served: np.ndarray
    sums: np.ndarray
    total: int
    quotas: np.ndarray | None = None

    def had(self, queue: int, n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Of ``queue`` after n windows of the stretch: its tokens, and those of the queues before it in this stretch."""
        n = n.astype(object)  # exact at any size of corpus
        before = (n * window * int(self.sums[queue]) // self.total).astype(np.int64)
        upto = (n * window * int(self.sums[queue + 1]) // self.total).astype(np.int64)
        return upto - before + self.served[queue], before


def _apportion(weights: list[int], n: int) -> list[int]:
    """n tokens by weight: what one window of the round-robin serves."""
    total, at, out, given = sum(weights), 0, [], 0
    for w in weights:
        at += w
        out.append(n * at // total - given)
        given += out[-1]
    return out


def stretches(weights: list[int], tokens: list[int], window: int = WINDOW) -> list[Stretch]:
    """The whole schedule of queues with these weights and lengths; a weight of zero is served last."""
    served, first, out = [0] * len(tokens), 0, []
    while True:
        left = [t - s for t, s in zip(tokens, served)]
        now = [w if x else 0 for w, x in zip(weights, left)]
        now = now if sum(now) else [int(x > 0) for x in left]
        total = sum(now)
        if not total:
            return out
        had, sums = np.array(served, np.int64), np.concatenate(([0], np.cumsum(now, dtype=np.int64)))
        count = min(x * total // (window * w) for x, w in zip(left, now) if w)
        if count:
            stretch = Stretch(first, count, had, sums, total)
            served = [int(stretch.had(q, np.array([count]), window)[0][0]) for q in range(len(tokens))]
        else:  # some queue ends in this window; what it lacks comes from the others
            count, need, quotas = 1, window, [0] * len(tokens)
            while need and any(left):
                more = [min(x, n) for x, n in zip(left, _apportion(now, need))]
                quotas, left = [q + m for q, m in zip(quotas, more)], [x - m for x, m in zip(left, more)]
                need -= sum(more)
                now = [w if x else 0 for w, x in zip(now, left)]
                now = now if sum(now) else [int(x > 0) for x in left]
            stretch = Stretch(first, 1, had, sums, total, np.array(quotas, np.int64))
            served = [s + q for s, q in zip(served, quotas)]
        out.append(stretch)
        first += count


def cuts(plan: list[Stretch], queue: int, start: int, end: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, window, offset): where tokens [start, end) of a queue are cut, and where they go.

    From each position in the queue to the next they lie in that window, from that offset on.
    """
    found: list[tuple] = []
    for s in plan:
        base = int(s.served[queue])
        if s.quotas is not None:
            size = int(s.quotas[queue])
            if size and base < end and base + size > start:
                found.append((np.array([base]), np.array([s.first]), np.array([int(s.quotas[:queue].sum())])))
            continue
        weight = int(s.sums[queue + 1] - s.sums[queue])
        if not weight or base >= end:
            continue
        at = [(x - base) * s.total // (window * weight) for x in (start, end)]
        low, high = max(at[0] - 2, 0), min(at[1] + 3, s.count)
        if low >= high:
            continue
        n = np.arange(low, high + 1)
        mine, others = s.had(queue, n, window)
        met = (mine[1:] > start) & (mine[:-1] < end) & (mine[1:] > mine[:-1])
        found.append((mine[:-1][met], s.first + n[:-1][met], (others[1:] - others[:-1])[met]))
    return tuple(np.concatenate(x) for x in zip(*found))  # type: ignore[return-value]


def _chunked(docs: DataFrame, path: str, id_type: str) -> DataFrame:
    """(chunk, source, tokens, doc_ids, lengths, ids): documents of one source at a time, tokenised, in the order of the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, kind, waiting = TaskContext.get().partitionId() << 32, None, 0
        held: dict[str | None, list] = {}

        def flush(source: str | None) -> pa.RecordBatch:
            nonlocal name, waiting
            names, parts = held.pop(source)
            ids = np.concatenate(parts)
            waiting, name = waiting - len(ids), name + 1
            raw = ids.astype("<u2" if ids.max() < 1 << 16 else "<u4").tobytes()
            row = [
                pa.array([name - 1], pa.int64()), pa.array([source], pa.string()), pa.array([len(ids)], pa.int64()),
                pa.array([names], pa.list_(kind)), pa.array([[len(p) for p in parts]], pa.list_(pa.int32())), pa.array([raw], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(row, names=["chunk", "source", "tokens", "doc_ids", "lengths", "ids"])

        sizes: dict[str | None, int] = {}
        for batch in batches:
            kind = batch.column(0).type
            for doc_id, text, source in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                ids = np.append(token_ids(text, path), np.uint32(END_ID))
                names, parts = held.setdefault(source, [[], []])
                names.append(doc_id)
                parts.append(ids)
                sizes[source] = sizes.get(source, 0) + len(ids)
                waiting += len(ids)
                if sizes[source] >= CHUNK:
                    sizes.pop(source)
                    yield flush(source)
                elif waiting >= WAITING:
                    sizes.clear()
                    yield from map(flush, list(held))
        yield from map(flush, list(held))

    return docs.mapInArrow(run, f"chunk long, source string, tokens long, doc_ids array<{id_type}>, lengths array<int>, ids binary")


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))


def _queues(chunks: DataFrame, target: DataFrame | None, window: int) -> tuple[DataFrame, list[int], list[int]]:
    """(of, queue) of every source's key, and weights and lengths by queue; the driver gets at most ``window`` sources and some sums.

    After the queues of single sources come that of small shares and that of no share.
    """
    sums = chunks.groupBy(_key(F.col("source")).alias("key")).agg(F.sum("tokens").alias("tokens"))
    if target is None:
        sums = sums.withColumn("weight", F.col("tokens").cast("double"))
    else:
        shares = target.groupBy(_key(F.col("source").cast("string")).alias("key")).agg(F.sum(F.col("share").cast("double")).alias("weight"))
        sums = sums.join(shares, "key", "left").withColumn("weight", F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0))
    sums = Written(sums).df
    total = sums.agg(F.sum("weight")).first()[0] or 0.0
    # a share of a token a window or more: there cannot be more than ``window`` of them
    large = (F.col("weight") > 0) & (F.col("weight") * window >= total)
    named = sums.where(large).orderBy("key").collect()
    rest = sums.where(~large).groupBy((F.col("weight") > 0).alias("small")).agg(F.sum("tokens").alias("tokens"), F.sum("weight").alias("weight")).collect()
    small, last = (next((r for r in rest if r["small"] == x), None) for x in (True, False))

    def whole(weight: float) -> int:
        return int(weight) if target is None else max(1, round(weight / total * (1 << 40)))

    weights = [whole(r["weight"]) for r in named] + [whole(small["weight"]) if small else 0, 0]
    tokens = [r["tokens"] for r in named] + [x["tokens"] if x else 0 for x in (small, last)]
    known = chunks.sparkSession.createDataFrame([(r["key"], k) for k, r in enumerate(named)], "of string, single int")
    queue = F.coalesce("single", F.when(F.col("weight") > 0, len(named)).otherwise(len(named) + 1))
    return Written(sums.join(F.broadcast(known), F.col("key") == F.col("of"), "left").select(F.col("key").alias("of"), queue.alias("queue"))).df, weights, tokens


def _places(chunks: DataFrame) -> DataFrame:
    """(chunk, before): the tokens of its queue in front of each chunk, in a seeded order; no queue meets in one task."""
    from pyspark.sql import Window

    bits = min(max(chunks.count() // BUCKET_CHUNKS, 1).bit_length() - 1, BUCKET_BITS)
    order = F.shiftrightunsigned(F.xxhash64("chunk", F.lit(SEED)), 1)
    rows = chunks.select("chunk", "queue", "tokens", order.alias("order")).withColumn("bucket", F.shiftright("order", 63 - bits))
    sums = rows.groupBy("queue", "bucket").agg(F.sum("tokens").alias("n"))
    ahead = sums.select(F.col("queue").alias("of"), F.col("bucket").alias("of_bucket"), (F.sum("n").over(Window.partitionBy("queue").orderBy("bucket")) - F.col("n")).alias("ahead"))
    inside = Window.partitionBy("queue", "bucket").orderBy("order", "chunk")
    met = rows.withColumn("upto", F.sum("tokens").over(inside)).join(ahead, (F.col("queue") == F.col("of")) & (F.col("bucket") == F.col("of_bucket")))
    return met.select("chunk", (F.col("ahead") + F.col("upto") - F.col("tokens")).alias("before"))


def pack(
    docs: DataFrame, tokenizer_path: str, target: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", window: int = WINDOW, with_ids: bool = False
) -> DataFrame:
    """A row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, and with ``with_ids`` its ids.

    ``target`` is (source, share); without it the corpus' own mixture holds. Sequences are numbered
    without a gap and have none inside; all but the last are full. A null text is empty and has
    its end id only; a null source is a source; repeated rows are packed each; other columns are
    ignored; an empty table has no pieces; ids may be of any simple type. Sources of equal
    shares are served in the order of their names.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    out_id = spare(["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "ids"], id_col)
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), F.col(source_col).cast("string").alias("source"))
    chunks = Written(_chunked(base, tokenizer_path, id_type)).df
    queues, weights, tokens = _queues(chunks, target, window)
    queued = chunks.join(queues, _key(F.col("source")) == F.col("of"))
    places = Written(_places(queued.select("chunk", "queue", "tokens"))).df
    rows = queued.join(places, "chunk").select("queue", "before", "source", "tokens", "doc_ids", "lengths", "ids")
    names = [out_id, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = stretches(weights, tokens, window)
        for batch in batches:
            for k in range(batch.num_rows):
                queue, before, source, n = (batch.column(i)[k].as_py() for i in range(4))
                raw = batch.column(6)[k].as_buffer()
                ids = np.frombuffer(raw, "<u2" if raw.size == 2 * n else "<u4").astype("<u4")
                lengths = batch.column(5)[k].values.to_numpy()
                starts = before + np.concatenate(([0], np.cumsum(lengths[:-1], dtype=np.int64)))
                at, windows, offsets = cuts(plan, queue, before, before + n, window)
                first = np.union1d(starts, at[at > before])
                length = np.diff(np.append(first, before + n))
                doc, cut = np.searchsorted(starts, first, "right") - 1, np.searchsorted(at, first, "right") - 1
                view = memoryview(ids.tobytes())
                edges = (first - before) * 4
                crc = [zlib.crc32(view[a:b]) for a, b in zip(edges.tolist(), (edges + 4 * length).tolist())]
                columns = [
                    batch.column(4)[k].values.take(pa.array(doc)), pa.array(first - starts[doc]), pa.array(length), pa.array(crc, pa.int64()), pa.array(lengths[doc].astype(np.int64)),
                    pa.array(windows[cut].astype(np.int64)), pa.array(offsets[cut] + first - at[cut]), pa.array([source] * len(first), pa.string()),
                ]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(first - before, n), pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"`{out_id}` {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string" + ", ids array<long>" * with_ids
    return rows.mapInArrow(run, schema)
