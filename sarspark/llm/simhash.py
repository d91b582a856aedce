"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most three of 64 bits differ in at most two bits of some
pair of three bit blocks (22, 21 and 21 bits wide): dropping the block with the most
differences leaves two. Within the kept 42 or 43 bits each fingerprint emits every variant
within half of that radius, one bit; fingerprints two bits apart meet in the variant between
them. Variants are shuffled, equal ones meet in a sorted run, and each run is verified on
whole fingerprints. This loses no link, and 131 variants of a distinct fingerprint replace the
2081 that a ball of radius two over all 64 bits would take.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Written, spare, text_of
from .components import components

SEED = 42
SHINGLE = 3
RADIUS = 3
#: The bits of each block as (first, end); one block is dropped at a time.
BLOCKS = ((0, 22), (22, 43), (43, 64))
_ALL = (1 << 64) - 1


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 for a text without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    n = len(words)
    if not n:
        return 0
    digest = xxhash.xxh64_intdigest
    if n < SHINGLE:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: n - 2].tolist(), ends[2:].tolist())]
    ones = np.zeros(64, np.int64)
    values = np.array(hashes, dtype="<u8")
    for at in range(0, len(values), 16384):
        part = values[at : at + 16384]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(len(part), 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return base.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _print_all(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _signed(fingerprint(t)))


def variants(distinct: DataFrame) -> DataFrame:
    """(variant, block, fp): for each dropped block the kept bits and all their one-bit variants."""
    keys, first = [], []
    for lo, hi in BLOCKS:
        kept = _ALL ^ (((1 << (hi - lo)) - 1) << lo)
        base = F.col("fp").bitwiseAND(F.lit(_signed(kept)))
        first.append(len(keys))
        keys.append(base)
        keys += [base.bitwiseXOR(F.lit(_signed(1 << b))) for b in range(64) if kept >> b & 1]
    made = distinct.select("fp", F.posexplode(F.array(*keys)).alias("pos", "variant"))
    block = F.when(F.col("pos") < first[1], 0).when(F.col("pos") < first[2], 1).otherwise(2)
    return made.select("variant", block.cast("byte").alias("block"), "fp")


#: How many fingerprints a task turns into variants, at most about; smaller tables are spread over all cores.
TASK_PRINTS = 1 << 17


def _run_edges(block: int, variant: int, fps: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join all linked fingerprints of one run, as paths of linked groups.

    Members with equal dropped bits are at most two bits apart, so they are one group. Groups
    whose dropped bits differ in one place are linked; in two, if a kept distance of one or
    none occurs; in three, if an equal kept part occurs. Memory is linear in the run.
    """
    lo, hi = BLOCKS[block]
    shift, width = np.uint64(lo), np.uint64((1 << (hi - lo)) - 1)
    dropped = (fps >> shift) & width
    order = np.argsort(dropped, kind="stable")
    fps, dropped = fps[order], dropped[order]
    kept = fps & ~(width << shift)
    flip = kept ^ np.uint64(variant & _ALL)  # no bit or one
    flip[flip == 0] = np.uint64(1) << shift  # a bit of the dropped block stands for "none"
    starts = np.flatnonzero(np.concatenate(([True], dropped[1:] != dropped[:-1])))
    same = [(int(fps[i - 1]), int(fps[i])) for i in range(1, len(fps)) if dropped[i] == dropped[i - 1]]
    flips = np.bitwise_or.reduceat(flip, starts)
    none = np.uint64(1) << shift
    value, least = dropped[starts], fps[starts]
    rest, edges = np.arange(len(starts)), same
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            g = front.pop()
            apart = np.bitwise_count(value[rest] ^ value[g])
            shared = (flips[rest] & flips[g]) != 0
            either = ((flips[rest] | flips[g]) & none) != 0
            linked = (apart <= 1) | ((apart == 2) & (shared | either)) | ((apart == 3) & shared)
            if linked.any():
                new = rest[linked]
                path = [g, *new.tolist()]
                edges += [(int(least[a]), int(least[b])) for a, b in zip(path, path[1:])]
                front += new.tolist()
                rest = rest[~linked]
    return edges


def edges_of(distinct: DataFrame) -> DataFrame:
    """(u, v) edges with the same components as all links between the distinct ``fp``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # parts of the last run, which the next batch may continue
        out: list[tuple[int, int]] = []

        def close(variant: np.ndarray, block: np.ndarray, fp: np.ndarray) -> None:
            if len(fp) < 2:
                return
            new = np.concatenate(([True], (variant[1:] != variant[:-1]) | (block[1:] != block[:-1])))
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(fp)))
            two = starts[sizes == 2]
            near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= RADIUS]
            out.extend(zip(fp[near].tolist(), fp[near + 1].tolist()))
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                out.extend(_run_edges(int(block[s]), int(variant[s]), fp[s : s + n]))

        def emit() -> pa.RecordBatch:
            pairs = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
            variant, block, _ = now
            last = np.flatnonzero((variant != variant[-1]) | (block != block[-1]))
            cut = last[-1] + 1 if len(last) else 0
            if held and (cut or (variant[0], block[0]) != (held[0][0][0], held[0][1][0])):
                # a run that goes on over many batches is put together once
                close(*[np.concatenate([*(h[i] for h in held), now[i][:cut]]) for i in range(3)])
                held = []
            elif cut:
                close(*[x[:cut] for x in now])
            held.append([x[cut:] for x in now])
            if len(out) > 50_000:
                yield emit()
        if held:
            close(*[np.concatenate([h[i] for h in held]) for i in range(3)])
        if out:
            yield emit()

    # the table of fingerprints is small and so are its scan's tasks' inputs; what a task emits is what counts
    tasks = max(distinct.sparkSession.sparkContext.defaultParallelism, -(-distinct.count() // TASK_PRINTS))
    met = variants(distinct.repartition(tasks, "fp")).repartition("variant", "block").sortWithinPartitions("variant", "block", "fp")
    return met.mapInArrow(run, "u long, v long").where("u <> v").distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """(id, fp, component_id) of every row, and ``more``: ``root``, which tells components of one least id apart."""
    rows = Written(fingerprints(docs, id_col, text_col)).df
    distinct = Written(rows.groupBy("fp").agg(F.min("id").alias("least"))).df
    roots = Written(components(edges_of(distinct.select("fp")))).df
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = Written(rooted.where("root <> fp or least is not null").groupBy("root").agg(F.min("least").alias("component_id"))).df
    named = Written(rooted.join(least, "root", "left").select(F.col("fp").alias("named_fp"), "component_id", *more)).df
    return rows.join(named, rows["fp"] == named["named_fp"], "left").select("id", "fp", "component_id", *more)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint, component_id) of every row of ``docs``.

    Null and wordless texts have fingerprint zero, which links like any other. Repeated rows
    each get a row; a null id gets its component but never names one. Components hold all
    rows that links of at most three bits connect; other columns are ignored.
    """
    return _grouped(docs, id_col, text_col).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the document of least id of each component, once; all columns stay.

    Texts of one id that lie in different components are told apart by their fingerprints, so
    each component keeps its own; rows that repeat an id and a fingerprint are kept once. Rows
    without an id cannot be told apart and all stay. Texts of ids that occur once move only if the
    narrow table of ids to drop outgrows a broadcast.
    """
    mark, bits = spare(docs.columns, "kept_id"), spare(docs.columns, "kept_fp")
    of_fp = spare(docs.columns, "kept_of")
    known = docs.where(F.col(id_col).isNotNull())
    found = Written(_grouped(known, id_col, text_col, "root")).df
    ids = found.groupBy("id").agg(F.count("*").alias("n"), F.max("component_id").alias("least")).where("n > 1 or least <> id")
    gone = Written(ids.select(F.col("id").alias(mark), (F.col("n") > 1).alias(bits))).df
    same = F.col(id_col) == F.col(mark)
    once = docs.join(gone.select(mark), same, "left_anti")
    again = gone.where(F.col(bits)).select(mark)
    if again.isEmpty():
        return once
    kept = Written(found.where("id = component_id").groupBy("id", "root").agg(F.min("fp").alias(of_fp)).select(F.col("id").alias(mark), of_fp)).df
    printed = F.pandas_udf(_print_all, "long")
    more = known.join(again, same, "left_semi").withColumn(bits, printed(text_of(text_col)))
    more = more.join(kept, same & (F.col(bits) == F.col(of_fp)), "left_semi").dropDuplicates([id_col, bits]).drop(bits)
    return once.unionByName(more)
