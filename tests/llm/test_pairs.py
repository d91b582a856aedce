"""Near-duplicates, decontamination and personal data against brute force, with their edge cases."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sarspark.llm import components, decontam, pii, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, pii int, kept_id long, row int, words string"


def frame(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, None if k % 3 == 0 else "en", f"s{k % 2}" if k % 5 else None, None, "x", 1, 2, 3, "w") for k, (i, t) in enumerate(zip(ids, texts))], SCHEMA)


EDGE = [None, "", " ", "one", "one", "one two", "a b c", "A B C", "x " * 30000, "é😀 ß " * 50, "tie tie tie tie", None]


def slow_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = sorted(root)
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {f: find(f) for f in fps}


def test_simhash_of_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").unionByName(frame(spark, EDGE, [5000 + k for k in range(len(EDGE))]).select("doc_id", "text", "lang", "source", "n_chars"))
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    fps = {i: slow_fingerprint(t) for i, t in texts.items()}
    comp = slow_components(set(fps.values()))
    least = {}
    for i, f in sorted(fps.items(), reverse=True):
        least[comp[f]] = i
    got = simhash.near_duplicates(docs).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{f:016x}", least[comp[f]]) for i, f in fps.items()} and len(got) == len(texts)


def test_links_at_every_distance(spark):
    rng = np.random.default_rng(1)
    fps = set()
    for _ in range(60):
        base = int(rng.integers(0, 1 << 63)) * 2
        for d in (1, 2, 3, 3, 4, 5):
            for b in rng.choice(64, d, replace=False):
                base ^= 1 << int(b)
            fps.add(base)
    hub = int(rng.integers(0, 1 << 63))  # a dense ball: runs with many members
    fps |= {hub ^ (1 << a) ^ (1 << b) for a in range(0, 64, 2) for b in range(1, 30, 3)}
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    edges = [(r.u % (1 << 64), r.v % (1 << 64)) for r in simhash.edges_of(df).collect()]
    want = slow_components(fps)
    assert all(want[a] == want[b] for a, b in edges)
    got = {f: f for f in fps} | {r.node % (1 << 64): r.root for r in components.components(simhash.edges_of(df)).collect()}
    groups = {}
    for f in fps:
        groups.setdefault(want[f], set()).add(got[f])
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_paths_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, i) for i in range(501, 600)] + [(7, 7), (3, 2), (900, 901), (901, 900)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(101)} | {i: 500 for i in range(500, 600)} | {900: 900, 901: 900}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_keep_one(spark):
    text = " ".join(f"word{k}" for k in range(200))
    docs = frame(spark, [text, text, "else " + text[::-1], None, "", text], [4, 2, 9, 11, 12, None]).union(frame(spark, [text], [2]))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 2), (False, 9), (False, 11), (True, 0)]
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_keep_one_tells_texts_of_one_id_apart(spark):
    text, other, third = (" ".join(f"{w}{k}" for k in range(200)) for w in ("word", "thing", "else"))
    docs = frame(spark, [text, text, other, other, third, text + " end", third], [2, 5, 5, 5, 2, 2, 9])
    kept = sorted((r.doc_id, r.text[:4]) for r in simhash.keep_one(docs).collect())
    near = bin(slow_fingerprint(text) ^ slow_fingerprint(text + " end")).count("1") <= 3
    assert kept == [(2, "else"), *[(2, "word")] * (1 if near else 2), (5, "thin")]


def test_simhash_of_text_ids(spark):
    text = " ".join(f"word{k}" for k in range(100))
    docs = spark.createDataFrame([("b", text, 1), ("a", text, 2), (None, text, 3), ("c", None, 4)], "name string, text string, FP int")
    assert sorted((r.name or "", r.component_id) for r in simhash.near_duplicates(docs, "name").collect()) == [("", "a"), ("a", "a"), ("b", "a"), ("c", "c")]
    assert sorted(r.name or "" for r in simhash.keep_one(docs, "name").collect()) == ["", "a", "c"]


def test_runs_that_span_batches(spark):
    """Equal kept bits over many small batches are one run."""
    base = 0x0123456789ABCDEF
    fps = [base ^ x for x in range(300)] + [base ^ (x << 43) for x in range(1, 300)]
    want = slow_components(set(fps))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = components.components(simhash.edges_of(spark.createDataFrame([(simhash._signed(f),) for f in set(fps)], "fp long"))).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    got = {r.node % (1 << 64): r.root for r in rows}
    assert all((got.get(a, a) == got.get(b, b)) == (want[a] == want[b]) for a in fps[::29] for b in fps)


def slow_shingles(text, size=5):
    w = re.sub(r"[\W_]+", " ", (text or "").lower()).split()
    return {" ".join(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()


def slow_held(doc, item):
    """(shared, size) of an item's shingles in a document; an item of under five words is one shingle."""
    size = min(5, len(re.sub(r"[\W_]+", " ", (item or "").lower()).split()))
    s = slow_shingles(item, max(size, 1))
    return len(s & slow_shingles(doc, max(size, 1))), len(s)


SHORT = [(710, "capital of france"), (711, "The Capital"), (712, "capital of france answer"), (713, "never-there"), (714, "a b c d")]
HOLD = [(9110, "trivia what is the capital of france answer paris"), (9111, "the capital"), (9112, "capital of"), (9113, "of the capitals"), (9114, "x a b c d")]


def test_decontamination_against_all_pairs(spark, data):
    docs, items = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    extra = [(i.item_id, i.text) for i in items.limit(4).collect()]
    cut = [(9000 + k, "before here " + " ".join(t.split()[k:]) + " and after") for k, t in extra]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(cut + HOLD + [(9100, None), (9101, ""), (9102, "tiny"), (9103, "tiny"), (None, extra[0][1])], "doc_id long, text string"))
    items = items.select("item_id", "text").union(spark.createDataFrame(SHORT + [(700, None), (701, " , "), (702, "Tiny!"), (703, extra[0][1])], "item_id long, text string"))
    d = [(r.doc_id, r.text) for r in docs.collect()]
    want = set()
    for i in items.collect():
        for x, y in d:
            shared, n = slow_held(y, i.text)
            if n and shared >= 0.8 * n - 1e-9:
                want.add((x, i.item_id, shared, n))
    got = decontam.contained(docs, items).collect()
    assert {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in got} == want and len(got) == len(want)
    assert {(9102, 702), (9103, 702), (9110, 710), (9110, 711), (9110, 712), (9111, 711), (9114, 714)} <= {(a, b) for a, b, _, _ in want}
    assert not {9112, 9113} & {a for a, _, _, _ in want}
    left = decontam.drop_contaminated(docs, items)
    held = {a for a, _, _, _ in want} - {None}
    assert sorted(r.doc_id or -1 for r in left.collect()) == sorted(x or -1 for x, _ in d if x not in held)


def test_decontamination_sql_finds_short_items(spark, tmp_path):
    import duckdb

    from sarspark.llm import queries

    con = duckdb.connect()
    for name, key, rows in (("documents", "doc_id", HOLD), ("benchmark", "item_id", [*SHORT, (1, "what is the capital of france"), (2, None), (3, "")])):
        spark.createDataFrame(rows, f"{key} long, text string").write.parquet(str(tmp_path / f"{name}.parquet"))
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = sorted(tuple(r[c] for c in ("doc_id", "item_id", "n_shared", "n_item")) for r in queries.op9_decontamination(spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(f"SELECT doc_id, item_id, n_shared, n_item FROM ({queries.oracle_sql()['op9_decontamination']})").fetchall()) and len(got) == 6


def test_decontamination_judges_each_text_of_an_id(spark):
    item = "one two three four five six seven eight"
    docs = frame(spark, [f"a {item} b", "a clean text that holds nothing of it", item, "clean too"], [1, 1, 2, 3])
    left = decontam.drop_contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert left.columns == docs.columns and sorted((r.doc_id, r.text) for r in left.collect()) == [(1, "a clean text that holds nothing of it"), (3, "clean too")]


def test_decontamination_of_nothing(spark):
    docs, none = frame(spark, EDGE), spark.createDataFrame([], "item_id long, text string")
    assert decontam.contained(docs, none).count() == 0
    assert decontam.drop_contaminated(docs, none).columns == docs.columns
    assert decontam.drop_contaminated(docs, none).count() == len(EDGE)
    assert decontam.contained(docs.limit(0), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


def luhn(d):
    return sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def slow_spans(text):
    out = []
    for k, (kind, p) in enumerate(
        [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    ):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind != "ip" or all(int(x) < 256 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, kind, m.end()))
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out))


PII_EDGE = [
    *EDGE, "a@b.c_d@e.f x", "1.2.3.4.5.6.7.8 256.1.1.1", "é😀 4111 1111 1111 1111 then 4111-1111-1111-1112", "+1 (555) 123-4567.", "9" * 20000, "a" * 30000 + "@x", "x@y.z " * 800,
    "+1 555 123 4567 at x.y+z@example.com, 10.0.0.1", "12345678901234567890 4111111111111111", "a@b a@b.c. @b.c ++12345678901", "mail me: joe (at) mail (dot) com", "call (212) 555-1234 today", "v 1:2:3:4:5:6:7:8 ip",
]


def test_base_spans(spark, data):
    docs = frame(spark, PII_EDGE).select("doc_id", "text").union(spark.read.parquet(f"{data}/documents.parquet").select(F.col("doc_id") + 1000, "text"))
    want = {r.doc_id: slow_spans(r.text) for r in docs.collect()}
    got = pii.digest(pii.spans(docs)).collect()
    assert len(got) == len(want)
    for r in got:
        base = want[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(filter(None, r.spans.split(",")))
        for kind in pii.KINDS:
            assert r[f"n_{kind}"] == base.count(kind)
    more = {r.doc_id: r.spans for r in got}
    assert more[len(EDGE) + 10] == "email:9:32" and more[len(EDGE) + 11] == "phone:5:19"


def test_redaction(spark):
    docs = frame(spark, PII_EDGE)
    got = pii.redact(docs)
    assert got.columns == docs.columns and got.count() == len(PII_EDGE)
    by = {r.doc_id: r.text for r in got.collect()}
    for k, text in enumerate(PII_EDGE):
        if not slow_spans(text) and k < len(EDGE):
            assert by[k] == text
        elif text:
            assert not slow_spans(by[k])
    assert by[len(EDGE) + 2] == "é😀 <CARD> then 4111-1111-1111-1112"
    assert pii.redact(docs.limit(0)).count() == 0 and pii.spans(docs.limit(0)).count() == 0


def test_many_matches_in_one_text(spark):
    """A directory of 15,000 matches: results are those of the same lines alone, and it takes seconds, not minutes."""
    import time

    line, n = "é Ann +1 555 123 4567, ann@x.org, (212) 555-1234, 10.0.0.1; 4111 1111 1111 1111\n", 3000
    docs = spark.createDataFrame([(1, line * n), (2, line)], "doc_id long, text string")
    began = time.perf_counter()
    text = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert text[1] == text[2] * n and text[2] == "é Ann <PHONE>, <EMAIL>, <PHONE>, <IP>; <CARD>\n"
    found = {r.doc_id: [(s.start, s.kind, s.end, s.base) for s in r.s] for r in docs.select("doc_id", pii.candidates(F.col("text")).alias("s")).collect()}
    assert len(found[2]) == 5 and found[1] == [(a + i * len(line), k, b + i * len(line), x) for i in range(n) for a, k, b, x in found[2]]
    assert time.perf_counter() - began < 90


def test_masks_of_overlapping_spans(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(40):
        text = "".join(rng.choice(list("aé😀 \n."), int(rng.integers(1, 5000))))
        ends = [sorted(int(x) for x in rng.integers(0, len(text) + 1, 2)) for _ in range(k)]
        rows.append((k, text, sorted((a, int(rng.integers(0, 4)), b) for a, b in ends if a < b)))
    df = spark.createDataFrame(rows, "id int, text string, found array<struct<start:int,kind:int,end:int>>")
    for r in df.select("id", pii.masked(F.col("text"), F.col("found")).alias("m")).collect():
        _, text, found = rows[r.id]
        want, at = "", 0
        for a, kind, b in found:
            if a >= at:
                want += text[at:a] + f"<{pii.KINDS[kind].upper()}>"
            at = max(at, b)
        assert r.m == want + text[at:]


def test_em_lets_reliable_labelers_win():
    from sarspark.llm.quality import estimate

    real, false = (1, 1, 1, 1, 1), (0, -1, -1, -1, -1)
    m = estimate(list(pii.LABELERS), [(real, 900), (false, 100), ((0, 1, 1, 1, 1), 50)])
    odds = lambda v: m.bias + sum(m.weights[n][x] for n, x in zip(pii.LABELERS, v))
    assert odds(real) > 0 > odds(false) and odds((0, 1, 1, 1, 1)) > 0


@pytest.mark.parametrize("module", ["decontam", "pii", "shard", "urlfilter"])
def test_native_operators_use_no_python_on_executors(module):
    from pathlib import Path

    import sarspark.llm as llm

    source = (Path(llm.__file__).parent / f"{module}.py").read_text()
    assert not re.search(r"mapIn|applyIn|udf|\.rdd|pandas|pyarrow", source)
