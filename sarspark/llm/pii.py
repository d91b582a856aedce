"""Personal data by weak supervision, in DataFrame functions only.

Strict patterns give base spans, which always stay. Loose patterns give more candidates.
Labelers vote on every candidate: the strict regex, a gazetteer (top-level domains, issuers,
country codes, reserved networks), the words before it, its shape and its neighbours.
Expectation-maximisation over the counts of vote patterns (a few hundred for each kind,
whatever the corpus size) estimates the labelers' reliabilities; its posteriors train a naive
Bayes span classifier over shape, preceding word and length, and that classifier decides which
loose candidates are added.

Positions are running sums of the lengths of what lies between matches, overlaps are found by one
pass over sorted spans, and texts are put together from blocks of characters, so a text costs time
in proportion to its length and, but for sorting, to its matches; no text is cut or sampled.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Written, spare, text_of
from .quality import estimate

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("regex", "gazetteer", "context", "shape", "neighbours")
#: Strict patterns with a cheap test that any text with a match passes. Look-behinds and
#: possessive quantifiers change no match; they keep long runs linear.
STRICT = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){13,}+", r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
LOOSE = {
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[]at[)\]] ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]++)++", r"[(\[]at[)\]]"),
    "ip": (r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"),
    "card": (r"(?<![0-9.])[0-9]{4}(?:[./][0-9]{4}){3}(?![0-9.])", r"[0-9]{4}[./][0-9]{4}"),
    "phone": (r"(?<![0-9A-Za-z+(])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9A-Za-z])", r"[0-9]{3}[-. ][0-9]{4}"),
}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Cues in the words before a candidate, and words that speak against it.
CUES = {
    "email": (r"mail|contact|write|reach|kontakt|correo|courriel", r"regex|pattern"),
    "ip": (r"\bip\b|address|host|server|adresse|direcci", r"version|\bv\b|release|section|chapter"),
    "card": (r"card|visa|credit|karte|tarjeta|carte|pay", r"isbn|order|invoice|serial|token"),
    "phone": (r"phone|call|tel|mobil|fax|contact|anruf|llam|appel", r"isbn|order|invoice|serial"),
}
BUCKETS = 256
CONTEXT = 48
#: Elements and characters of a block.
BLOCK, CHARS = 256, 1024


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, strict: bool) -> Callable[[Column], Column]:
    """What a match must pass besides its pattern."""
    if kind == "card":
        return lambda m: F.length(_digits(m)).between(14, 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return lambda m: F.length(_digits(m)).between(10, 15)
    if kind == "ip" and strict:
        return lambda m: m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    return lambda m: F.lit(True)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def _gazetteer(kind: str, m: Column) -> Column:
    if kind == "email":
        known = m.rlike(r"(?i)[.)\] ](?:com|org|net|edu|gov|int|info|biz|io|eu|de|fr|es|uk|it|nl|ch|at|us|ca|mx)$")
        return _vote(known, ~known)
    if kind == "ip":
        return _vote(F.lit(True), m.rlike(r"^0*(?:0|10|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\.|^192\.168\."))
    if kind == "card":
        issuer = _digits(m).rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))")
        return _vote(issuer, ~issuer)
    known = m.rlike(r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|^\(?[2-9][0-9]{2}")
    return _vote(known, ~known)


def _shape(kind: str, m: Column) -> Column:
    if kind == "email":
        return _vote(m.rlike(r"^[A-Za-z0-9._%+-]*[A-Za-z][A-Za-z0-9._%+-]"), m.rlike(r"\.\.|-\."))
    if kind == "ip":
        return _vote(m.rlike(r"[0-9]{2}.*[0-9]{2}"), m.rlike(r"^[0-9]\.[0-9]\.[0-9]\.[0-9]$"))
    same = _digits(m).rlike(r"^([0-9])\1*$")
    return _vote(F.length(_digits(m)).isin(10, 11, 12) if kind == "phone" else F.length(_digits(m)).isin(14, 15, 16, 19), same)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once; inside a lambda an outer expression is computed for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _scan(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], out_type: str) -> Column:
    """What ``step(state, item)``, a new state and a result, gives for each item in order.

    Results are gathered in blocks, since appending to one long array would copy it each time. An
    aggregate's end hands references on; a ``_let`` there would copy all that was gathered so far.
    """

    def one(acc: Column, x: Column) -> Column:
        new, out = step(acc["state"], x)
        return F.struct(new.alias("state"), F.concat(acc["out"], F.array(out)).alias("out"))

    def block(acc: Column, b: Column) -> Column:
        none = F.struct(acc["state"].alias("state"), F.array().cast(f"array<{out_type}>").alias("out"))
        return F.aggregate(b, none, one, lambda x: F.struct(x["state"].alias("state"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    def run(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(xs) / F.lit(BLOCK)).cast("int")), lambda b: F.slice(xs, b * BLOCK + 1, F.lit(BLOCK)))
        start = F.struct(state.alias("state"), F.array().cast(f"array<array<{out_type}>>").alias("out"))
        return F.flatten(F.aggregate(blocks, start, block, lambda acc: acc["out"]))

    return _let(items, run)


def _holds(text: Column, kind: str, strict: bool) -> Column:
    hint = (STRICT if strict else LOOSE)[kind][1]
    return text.contains(hint) if hint == "@" else text.rlike(hint)


def _matches(text: Column, kind: str, strict: bool) -> Column:
    """array<struct<start, end, gap, m, before, after>> of all matches; the gap is the text since the last one."""
    pattern = (STRICT if strict else LOOSE)[kind][0]
    item = "struct<start:int,end:int,gap:string,m:string,before:string,after:string>"

    def step(at: Column, p: Column) -> tuple[Column, Column]:
        start = at + F.length(p["gap"])
        end = start + F.length(p["m"])
        made = F.struct(start.alias("start"), end.alias("end"), p["gap"].alias("gap"), p["m"].alias("m"), F.right(p["gap"], F.lit(CONTEXT)).alias("before"), F.left(p["after"], F.lit(1)).alias("after"))
        return end, made

    def zipped(parts: Column) -> Column:
        n = F.size(parts["found"])
        names = F.arrays_zip(F.slice(parts["gaps"], F.lit(1), n).alias("gap"), parts["found"].alias("m"), F.slice(parts["gaps"], F.lit(2), n).alias("after"))
        return _scan(names.cast("array<struct<gap:string,m:string,after:string>>"), F.lit(0), step, item)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.struct(F.split(text, pattern, -1).alias("gaps"), found.alias("found"))
    return F.when(_holds(text, kind, strict), _let(both, zipped)).otherwise(F.array().cast(f"array<{item}>"))


def _labelled(s: Column, kind: str, strict: bool) -> Column:
    """A match as a candidate: its span, its votes and its features."""
    m, before = s["m"], F.lower(s["before"])
    cue, against = CUES[kind]
    edge = s["before"].rlike(r"[\p{L}\p{N}]$") | s["after"].rlike(r"^[\p{L}\p{N}]")
    votes = (F.lit(1 if strict else 0), _gazetteer(kind, m), _vote(before.rlike(cue), before.rlike(against)), _shape(kind, m), _vote(~edge, edge))
    shape = F.regexp_replace(F.regexp_replace(m, "[0-9]+", "9"), "[A-Za-z]+", "a")
    word = F.regexp_extract(before, r"([\p{L}\p{N}]+)[^\p{L}\p{N}]*$", 1)
    return F.struct(
        s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end"), F.lit(strict).alias("base"),
        *[v.alias(n) for n, v in zip(LABELERS, votes)],
        F.pmod(F.xxhash64(shape), F.lit(BUCKETS)).cast("int").alias("f_shape"),
        F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int").alias("f_word"),
        F.least(s["end"] - s["start"], F.lit(BUCKETS - 1)).alias("f_size"),
    )


def _candidates(text: Column, kind: str, strict: bool) -> Column:
    valid = _valid(kind, strict)
    return F.transform(F.filter(_matches(text, kind, strict), lambda s: valid(s["m"])), lambda s: _labelled(s, kind, strict))


def candidates(text: Column) -> Column:
    """All strict spans, and the loose ones that no strict span overlaps, by start and kind."""
    strict = F.flatten(F.array(*[_candidates(text, k, True) for k in KINDS]))
    loose = F.flatten(F.array(*[_candidates(text, k, False) for k in KINDS]))

    def free(both: Column) -> Column:
        # a strict span comes up at its start; a loose one at its end, where strict ones that start there do not touch it
        met = F.transform(both["strict"], lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("strict"), s["end"].alias("other"), F.lit(-1).alias("i")))
        asked = F.transform(both["loose"], lambda s, i: F.struct(s["end"].alias("at"), F.lit(0).alias("strict"), s["start"].alias("other"), i.alias("i")))

        def step(reach: Column, e: Column) -> tuple[Column, Column]:
            strict = e["strict"] == 1
            return F.when(strict, F.greatest(reach, e["other"])).otherwise(reach), F.when(~strict & (reach <= e["other"]), e["i"]).otherwise(-1)

        kept = F.filter(_scan(F.array_sort(F.concat(met, asked)), F.lit(0), step, "int"), lambda i: i >= 0)
        whole = F.concat(both["strict"], F.transform(kept, lambda i: F.get(both["loose"], i)))
        return F.array_sort(F.when(F.size(both["loose"]) > 0, whole).otherwise(both["strict"]))

    return _let(F.struct(strict.alias("strict"), loose.alias("loose")), free)


@dataclass
class Model:
    """Log odds of each kind's votes, and of the classifier's features: bias[kind], table[feature][kind * BUCKETS + bucket]."""

    votes: list = field(default_factory=list)
    bias: list = field(default_factory=list)
    table: dict = field(default_factory=dict)

    def posterior(self, s: Column) -> Column:
        """EM's probability that a candidate is real, from its votes."""
        odds = F.lit(0.0)
        for k, m in enumerate(self.votes):
            odds = F.when(s["kind"] == k, m.log_odds({n: s[n] for n in LABELERS})).otherwise(odds)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))

    def real(self, s: Column) -> Column:
        """Whether the classifier takes a candidate for real; strict ones are."""
        odds = F.get(F.array(*map(F.lit, self.bias)), s["kind"])
        for name, values in self.table.items():
            odds = odds + F.get(F.array(*map(F.lit, values)), s["kind"] * BUCKETS + s[name])
        return s["base"] | (odds >= 0)


def fit(found: DataFrame, col: str = "pii") -> Model:
    """A model from a table of candidates; the driver gets counts of bounded patterns only."""
    each = found.select(F.explode(col).alias("s"))
    by = [F.col("s.kind").alias("kind"), *[F.col(f"s.{n}").alias(n) for n in LABELERS]]
    seen = each.groupBy(*by).count().collect()
    model = Model()
    for k in range(len(KINDS)):
        patterns = sorted((tuple(r[n] for n in LABELERS), r["count"]) for r in seen if r["kind"] == k)
        model.votes.append(estimate(list(LABELERS), patterns, silent=("regex",)))  # loose candidates lack it by definition
    features = ("f_shape", "f_word", "f_size")
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col("s")[f].alias("v")) for f in features])).alias("x")
    scored = each.select(F.col("s.kind").alias("kind"), model.posterior(F.col("s")).alias("p"), pairs)
    sums = scored.groupBy("kind", "x.f", "x.v").agg(F.sum("p").alias("real"), F.sum(1 - F.col("p")).alias("not")).collect()
    model.table = {f: [0.0] * (len(KINDS) * BUCKETS) for f in features}
    for k in range(len(KINDS)):
        rows = [r for r in sums if r["kind"] == k]
        yes, no = (sum(r[c] for r in rows) / len(features) + 1.0 for c in ("real", "not"))
        model.bias.append(math.log(yes / no))
        for r in rows:
            # counts are smoothed towards the kind's own odds, so a rare feature says little
            odds = (r["real"] + yes / (yes + no)) / (r["not"] + no / (yes + no))
            model.table[r["f"]][k * BUCKETS + r["v"]] = math.log(odds) - model.bias[k]
    return model


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, pii (array of all spans with votes) and base (the strict ones), a row per row.

    A null text is empty; repeated rows each get a row; other columns are ignored; an empty
    table gives an empty result.
    """
    found = Written(docs.select(F.col(id_col).alias("id"), candidates(text_of(text_col)).alias("pii"))).df
    model = fit(found)
    return found.select(F.col("id").alias(id_col), F.filter("pii", model.real).alias("pii"), F.filter("pii", lambda s: s["base"]).alias("base"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of strict spans by kind, the hash of their list, and all spans as text."""

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(id_col, *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"))


def masked(text: Column, found: Column) -> Column:
    """``text`` with each span replaced by ``<KIND>``; of overlapping spans the first to start covers all."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def step(reach: Column, s: Column) -> tuple[Column, Column]:
        new = F.struct(reach.alias("from"), s["start"].alias("to"), s["kind"].alias("kind"))
        return F.greatest(reach, s["end"]), F.when(s["start"] >= reach, new)

    def cut(blocks: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / F.lit(CHARS)).cast("int")
        n = F.floor((end - 1) / F.lit(CHARS)).cast("int") - first + 1
        some = F.substring(F.array_join(F.slice(blocks, first + 1, n), ""), F.pmod(start, F.lit(CHARS)) + 1, end - start)
        return F.when(end > start, some).otherwise("")

    def made(x: Column) -> Column:
        parts = F.transform(x["parts"], lambda p: F.concat(cut(x["blocks"], p["from"], p["to"]), F.get(names, p["kind"])))
        rest = cut(x["blocks"], F.array_max(F.transform(found, lambda s: s["end"])), F.length(text))
        return F.array_join(F.concat(parts, F.array(rest)), "")

    parts = F.array_compact(_scan(found, F.lit(0), step, "struct<from:int,to:int,kind:int>"))
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHARS}}}"), F.lit(0))
    return F.when(F.size(found) > 0, _let(F.struct(parts.alias("parts"), blocks.alias("blocks")), made)).otherwise(text)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced by ``<KIND>``; all columns stay, null texts too.

    The model is fitted on the candidates alone, which are written; texts are scanned twice, not stored.
    """
    model = fit(Written(docs.select(candidates(text_of(text_col)).alias("pii")).where(F.size("pii") > 0)).df)
    mark = spare(docs.columns, "pii")
    found = docs.withColumn(mark, F.filter(candidates(text_of(text_col)), model.real))
    return found.withColumn(text_col, masked(F.col(text_col), F.col(mark))).select(*docs.columns)
