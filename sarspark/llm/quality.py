"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule looks at counts of the whole text and votes good, bad or nothing. The corpus is
reduced to counts of vote patterns (at most 3 to the power of the rules, whatever the corpus
size), from which EM estimates how each class votes; the posterior probability of "good" then
decides, in place of asking that every rule passes. Hard base failures stay failures.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Written, spare, text_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: How right a rule is taken to be when it objects, and how many times its votes that belief weighs.
PRECISION, TRUST = 0.95, 1.0
_SPACE = " \t\n\r\x0b\x0c"
_MARK = np.array([33 <= c < 127 and not chr(c).isalnum() for c in range(256)])
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_unique", "n_bangs", "n_upper", "n_letters", "n_stops", "n_marks")


def _repeated(ids: np.ndarray) -> int:
    """Words in windows of WINDOW words that occur twice or more; ranks double exactly, nothing is hashed."""
    n = len(ids)
    if n < WINDOW + 1:
        return 0
    rank, width = ids.astype(np.int64), 1
    while width < WINDOW:
        both = rank[:-width] * np.int64(n + 1) + rank[width:]
        values, rank = np.unique(both, return_inverse=True)
        if len(values) == len(both):
            return 0
        width *= 2
    twice = np.bincount(rank)[rank] > 1
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def metrics_of(text: str | None) -> tuple[int, ...]:
    """METRICS of one text; null counts as empty."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    lines = [x for x in text.split("\n") if x.strip(_SPACE)] if n else []
    codes = np.frombuffer(raw, np.uint8)
    upper = int(((codes >= 65) & (codes <= 90)).sum())
    lower = int(((codes >= 97) & (codes <= 122)).sum())
    return (
        n,
        len(text) - sum(map(text.count, _SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeated(ids) if len(seen) < n else 0,
        len(lines),
        len(seen),
        text.count("!"),
        upper,
        upper + lower,
        sum(map(text.count, ".?!")),
        int(_MARK[codes].sum()),
    )


def measure(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with one more struct column of METRICS, and that column's name."""
    name = spare(docs.columns, "quality_metrics")
    kind = T.StructType([T.StructField(m, T.LongType()) for m in METRICS])
    at = docs.columns.index(text_col)
    arrow = pa.struct([(m, pa.int64()) for m in METRICS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [metrics_of(t) for t in batch.column(at).to_pylist()]
            fields = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64()) for _ in METRICS]
            added = pa.StructArray.from_arrays(fields, fields=list(arrow))
            yield pa.RecordBatch.from_arrays([*batch.columns, added], names=[*batch.schema.names, name])

    base = docs.withColumn(text_col, F.col(text_col).cast("string"))
    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField(name, kind)])), name


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * MAX_REPEAT_PERCENT)


def rules(m: Column) -> dict[str, Column]:
    """Each rule's vote: 1 good, -1 bad, 0 abstains. What the base already fails no rule objects to again."""

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    words = F.greatest(m["n_words"], F.lit(1)).cast("double")
    chars = F.greatest(m["word_chars"], F.lit(1)).cast("double")
    lines = F.greatest(m["n_lines"], F.lit(1)).cast("double")
    letters = F.greatest(m["n_letters"], F.lit(1)).cast("double")
    never = F.lit(False)
    return {
        "length": vote(never, m["n_words"] >= 40),
        "word_length": vote((m["word_chars"] / words < 2) | (m["word_chars"] / words > 12), (m["word_chars"] / words).between(3, 10)),
        "stops": vote((m["n_stops"] == 0) & (m["n_words"] >= 40), (m["n_stops"] / words).between(0.02, 0.5)),
        "symbols": vote(m["n_symbols"] / words > 0.1, never),
        "symbol_share": vote(m["n_symbols"] / chars > 0.03, never),
        "marks": vote(m["n_marks"] / chars > 0.12, never),
        "capitals": vote(m["n_upper"] / letters > 0.5, never),
        "bangs": vote(m["n_bangs"] / words > 0.2, never),
        "repetition": vote((m["n_dup_lines"] / lines > 0.3) | ((m["n_unique"] / words < 0.15) & (m["n_words"] < 2000)), never),
    }


@dataclass
class Model:
    """Log odds of "good": a bias and, for each rule, what a vote of -1, 0 or 1 adds."""

    bias: float
    weights: dict[str, dict[int, float]]
    accuracy: dict[str, float]

    def log_odds(self, votes: dict[str, Column]) -> Column:
        total = F.lit(self.bias)
        for name, w in self.weights.items():
            total = total + F.when(votes[name] > 0, w[1]).when(votes[name] < 0, w[-1]).otherwise(w[0])
        return total


def estimate(names: list[str], patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60, silent: tuple[str, ...] = ()) -> Model:
    """EM over vote patterns and their counts; no pattern gives an evenly weighted vote.

    A class votes on each rule independently, with two priors: a thousandth of all rows is added
    to each count, so no rule passes for infallible, and each rule's objections are added TRUST
    times as if they were PRECISION right. One rule alone cannot show EM a class, so every kind
    of junk has some that see it from different sides. It starts from the objections: each
    makes a row less likely to be good. A rule whose estimate would turn its meaning round gets
    no say.
    """
    default = {n: {-1: -1.0, 0: 0.0, 1: 0.5} for n in names}
    if not patterns:
        return Model(0.0, default, {n: 0.5 for n in names})
    votes = np.array([p for p, _ in patterns])
    count = np.array([c for _, c in patterns], float)
    good = 0.95 * 0.2 ** (votes < 0).sum(1)
    added = max(1.0, count.sum() / 1000)
    objections = np.array([(count * (votes[:, j] < 0)).sum() for j in range(len(names))])
    for _ in range(rounds):
        share = np.clip((good * count).sum() / count.sum(), 0.02, 0.98)
        table = {}
        for y, w in ((1, good * count), (0, (1 - good) * count)):
            table[y] = np.array([[(w * (votes[:, j] == v)).sum() + added for v in (-1, 0, 1)] for j in range(len(names))])
            table[y][:, 0] += TRUST * objections * (1 - PRECISION if y else PRECISION)
            table[y] /= table[y].sum(1, keepdims=True)
        ratio = np.log(table[1] / table[0])
        ratio[:, 0], ratio[:, 2] = np.minimum(ratio[:, 0], 0), np.maximum(ratio[:, 2], 0)
        ratio[[n in silent for n in names], 1] = 0
        odds = math.log(share / (1 - share)) + sum(ratio[j][votes[:, j] + 1] for j in range(len(names)))
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        if np.abs(new - good).max() < 1e-6:
            break
        good = new
    accuracy = {n: float(share * table[1][j][2] + (1 - share) * table[0][j][0]) for j, n in enumerate(names)}
    return Model(float(math.log(share / (1 - share))), {n: {v: float(ratio[j][v + 1]) for v in (-1, 0, 1)} for j, n in enumerate(names)}, accuracy)


def fit(measured: DataFrame, name: str) -> Model:
    """A model from all rows that pass the base; the driver gets only the counts of vote patterns.

    Rows that fail the base are decided already, and their junk would be all the model sees.
    """
    votes = rules(F.col(name))
    found = measured.where(~base_failed(F.col(name))).select(*[v.alias(k) for k, v in votes.items()]).groupBy(*votes).count().orderBy(*votes).collect()
    return estimate(list(votes), [(tuple(r[k] for k in votes), r["count"]) for r in found])


def judge(measured: DataFrame, name: str, model: Model) -> DataFrame:
    """``measured`` with base_failed, p_good and kept inside the struct column ``name``."""
    m = F.col(name)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-model.log_odds(rules(m))))
    full = F.struct(*[m[c].alias(c) for c in METRICS], base_failed(m).alias("base_failed"), p.alias("p_good"))
    both = measured.withColumn(name, full)
    m = F.col(name)
    return both.withColumn(name, m.withField("kept", ~m["base_failed"] & (m["p_good"] >= 0.5)))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, METRICS, base_failed, p_good and kept for every row.

    Null texts count as empty and fail; repeated rows each get a row; an empty table gives an
    empty result; other columns are ignored.
    """
    narrow = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    measured, name = measure(narrow, "text")
    measured = Written(measured.select("id", name)).df
    judged = judge(measured, name, fit(measured, name))
    return judged.select(F.col("id").alias(id_col), f"{name}.*")


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns; counts are taken twice, no text is stored."""
    measured, name = measure(docs.select(text_of(text_col).alias("text")), "text")
    model = fit(measured, name)
    measured, name = measure(docs, text_col)
    return judge(measured, name, model).where(F.col(name)["kept"]).select(*docs.columns)
