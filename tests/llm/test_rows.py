"""Row-wise operators against brute force, round trips and the tokenizer libraries, with their edge cases."""

import base64
import hashlib
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from sarspark.llm import html_text, packing, quality, queries, shard, tokencount, urlfilter, warc

from .test_pairs import EDGE, frame


# quality


def slow_metrics(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search("[^\x20\x09-\x0d]", x):
            dup += x in seen
            seen.add(x)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


REPEATS = ["a b c d e f g h " * 5, "same line here\nsame line here\n\n \nsame line here", "x " * 9, "x " * 8, "a b c d e f g h a b c d e f g h", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 z\u00a0y\u2003 w", "#*$%&|<> !!"]


def test_metrics(spark, data):
    docs = frame(spark, EDGE + REPEATS).select("doc_id", "text").union(spark.read.parquet(f"{data}/documents.parquet").select(F.col("doc_id") + 1000, "text"))
    want = {r.doc_id: slow_metrics(r.text) for r in docs.collect()}
    got = quality.score(docs).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[r.doc_id]
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert r.base_failed == failed and (not failed or not r.kept)


def test_verdict_against_labels(spark):
    """Junk that passes the base goes, clean documents stay; labels are not used in fitting."""
    sf = "/root/testdata/sf0.01"
    scored = quality.score(spark.read.parquet(f"{sf}/documents.parquet")).where("not base_failed")
    both = scored.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in both}
    assert n.get((1, False), 0) <= 0.01 * n[1, True] and n.get((0, False), 0) >= 0.85 * (n.get((0, False), 0) + n.get((0, True), 0))


def test_keep_good_keeps_columns_and_agrees(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").withColumn("Quality_Metrics", F.lit(1))
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.score(docs).where("kept").collect()}
    assert quality.keep_good(docs.limit(0)).count() == 0 and quality.score(docs.limit(0)).count() == 0


def test_a_model_without_rows_votes_evenly():
    m = quality.estimate(["a", "b"], [])
    assert m.bias == 0 and m.weights["a"][-1] < 0 < m.weights["a"][1]


# sharding


def test_shards(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "source").union(frame(spark, EDGE * 3, [7] * 36).select("doc_id", "text", "source"))
    rows, texts = docs.collect(), Counter()
    for r in rows:
        raw = (r.text or "").encode()
        texts[r.doc_id, len(raw) + 8, zlib.crc32(raw), r.source] += 1
    got = shard.interleave(docs).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.source) for r in got) == texts
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert set(by) == set(range(24)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    key = lambda r: (r.doc_id, r["size"], r.text_crc32, r.source or "", r.shard, r.slot)
    for other in (docs.repartition(5), docs.coalesce(1), docs.orderBy(F.desc("text"))):
        assert Counter(map(key, shard.interleave(other).collect())) == Counter(map(key, got))


def slow_order(spark, docs):
    """Rows in the order of their fractional ranks, by one sort of each source and one of all."""
    hashed = docs.select("doc_id", "source", F.length("text").alias("n"), F.shiftrightunsigned(F.xxhash64(F.lit(shard.SEED), "doc_id", F.coalesce("text", F.lit(""))), 1).alias("order")).collect()
    by = {}
    for r in sorted(hashed, key=lambda r: (r.order, r.doc_id)):
        by.setdefault(r.source, []).append(r)
    ranked = [((2.0 * k + 1) / (2.0 * len(rows)), "null" if s is None else "s" + s, r.order, r.doc_id) for s, rows in by.items() for k, r in enumerate(rows)]
    return [x[3] for x in sorted(ranked)]


@pytest.mark.parametrize("rows, bits", [(512, 16), (40, 3), (7, 16)])
def test_shards_against_one_sort(spark, monkeypatch, rows, bits):
    """Whatever the buckets, shards are cuts of the one order."""
    monkeypatch.setattr(shard, "BUCKET_ROWS", rows)
    monkeypatch.setattr(shard, "BUCKET_BITS", bits)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('ab ', cast(id % 7 as int))").alias("text"), F.expr("case when id % 3 > 0 then 'hot' when id % 10 < 6 then 'b' end").alias("source"))
    got = sorted((r.shard, r.slot, r.doc_id) for r in shard.interleave(docs, 7).collect())
    assert [x[2] for x in got] == slow_order(spark, docs)


def test_many_copies_of_one_row_are_spread(spark):
    docs = spark.range(30_000).select(F.expr("case when id % 3 = 0 then 1L else id end").alias("doc_id"), F.lit("t").alias("text"), F.lit("s").alias("source"))
    got = Counter(r.shard for r in shard.interleave(docs).collect())
    assert set(got) == set(range(24)) and set(got.values()) == {1250}


def test_shards_hold_the_mixture(spark):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.expr("case when id % 3 = 0 then 'hot' when id % 10 < 6 then 'b' end").alias("source"))
    total = {r.source: r.n for r in docs.groupBy("source").agg(F.count("*").alias("n")).collect()}
    for r in shard.interleave(docs).groupBy("shard", "source").count().collect():
        assert abs(r["count"] - total[r.source] / 24) <= 2
    assert shard.interleave(docs.limit(0)).count() == 0 and shard.interleave(docs.limit(1)).count() == 1
    assert shard.interleave(frame(spark, EDGE, [None] * len(EDGE))).count() == len(EDGE)


# tokens


def test_token_counts_are_those_of_the_library(spark, data):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = queries.tokenizer_path("piece_bpe_32k.model")
    pieces = tokencount.vocabulary(path)
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=False))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    odd = ["", " ", "  a  b ", "\n\n", "😀😀 x", "▁a b", "日本 語\n\nabc", "a" * 500, "ab😀\n😀cd"]
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").union(frame(spark, odd + EDGE, list(range(5000, 5000 + len(odd + EDGE)))).select("doc_id", "text"))
    want = {r.doc_id: len(t.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}
    got = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(docs, path).collect()}
    assert got == want
    assert tokencount.count_tokens(docs.limit(0), path).count() == 0


def test_a_word_of_any_length_takes_little_memory():
    import tracemalloc

    one = tokencount._counter(queries.tokenizer_path("piece_bpe_32k.model"))
    base, took = "日本語abcdefghij", []
    for n in (2_000, 40_000):
        tracemalloc.start()
        one.word(base * n)
        took.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert took[1] - took[0] < 8 * 38_000 * len(base)  # the automaton's copy of the word, and no lists
    part = one.word(tokencount.SPACE + base * 500)[0]
    assert abs(one.text(base * 40_000)[0] - 80 * part) <= 160


def test_token_counts_take_text_ids_and_other_columns(spark):
    docs = spark.createDataFrame([("a", "one two", 1), (None, None, 2)], "n_tokens string, text string, N_Chars int")
    got = tokencount.count_tokens(docs.withColumnRenamed("n_tokens", "name"), queries.tokenizer_path("piece_bpe_32k.model"), "name").collect()
    assert [(r.name, r.n_chars) for r in got] == [("a", 7), (None, 0)]


def test_ties_go_to_the_earlier_start():
    from tokenizers import Tokenizer, models

    pieces = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("c", -1.0), ("ab", -2.0), ("bc", -2.0), ("abc", -3.0), ("cc", -1.0), ("ccc", -2.0)]
    t, mine = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=False)), tokencount.Counter(pieces)
    for s in ("abc", "abcabc", "ccccc", "zabz", "zz", "abzzcc", "cabcab"):
        assert mine.word(s)[0] == len(t.encode(s).ids), s


# packing


def check_pieces(rows, docs, window=2048):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    ids = [(d, np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")) for d, x in docs]
    want = Counter((d, len(x)) for d, x in ids)
    starts, by_doc, windows = Counter(), {}, {}
    for r in rows:
        starts[r.doc_id, r.doc_tokens] += r.start == 0
        by_doc.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert starts == want
    for d, x in ids:
        if sum(n for k, n in want.items() if k[0] == d) == 1:
            at = 0
            for r in sorted(by_doc[d], key=lambda r: r.start):
                assert r.start == at and r.ids_crc32 == zlib.crc32(x[at : at + r.length].tobytes())
                at += r.length
            assert at == len(x)
    for w in windows.values():
        at = 0
        for offset, n in sorted(w):
            assert offset == at and n > 0
            at += n
        assert at <= window
    return windows


def test_packing(spark, data):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    odd = [*EDGE, "a <|endoftext|> b", "\u0085x\u180ey\u2028z\ufeff  \u00a0 q", "x" * 5000]
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "source").union(frame(spark, odd, list(range(5000, 5000 + len(odd)))).select("doc_id", "text", "source"))
    docs = docs.withColumn("START", F.lit("x")).withColumn("ids", F.lit(1)).withColumn("queue", F.lit(2))
    rows = packing.pack(docs, path).collect()
    windows = check_pieces(rows, [(r.doc_id, r.text) for r in docs.collect()])
    used = sum(r.length for r in rows)
    assert len(windows) == -(-used // 2048) and sorted(windows) == list(range(len(windows)))  # one partial window
    assert packing.pack(docs.limit(0), path).count() == 0


def test_packing_of_runs_that_one_library_refuses(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    text = "a" + " " * 2_000_000 + "b"
    rows = packing.pack(spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string"), path, with_ids=True).collect()
    got = [x for r in sorted(rows, key=lambda r: r.start) for x in r.ids]
    assert got == [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 1]
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows)


def test_packing_takes_text_ids_and_repeats(spark):
    docs = spark.createDataFrame([("a", "one two", None), ("a", "one two", None), (None, None, ""), ("b", "x " * 3000, "s")], "start string, text string, source string")
    rows = packing.pack(docs, queries.tokenizer_path("byte_bpe_50k.json"), id_col="start").collect()
    assert Counter(r[0] for r in rows if r[1] == 0) == {"a": 2, None: 1, "b": 1}


def test_every_full_window_holds_the_mixture(spark):
    """The registered query on 25 MB: both ends of a source's part of a window are within a token of where they should be."""
    sf = "/root/testdata/sf0.1"
    rows = queries.op8_packing(spark, sf).groupBy("sequence_id", "source").agg(F.sum("length").alias("n")).collect()
    total, full = Counter(), Counter()
    for r in rows:
        total[r.source] += r.n
        full[r.sequence_id] += r.n
    got, used = {(r.sequence_id, r.source): r.n for r in rows}, sum(total.values())
    assert sorted(full) == list(range(len(full))) and all(n == 2048 for w, n in full.items() if w + 1 < len(full))
    assert all(abs(got.get((w, s), 0) - 2048 * t / used) < 2 for w, n in full.items() if n == 2048 for s, t in total.items())


def slow_round_robin(weights, tokens, window):
    """Quotas of every window by walking through the queues, with what each is owed; the quantum of a window that a queue cannot fill goes to the others."""
    from fractions import Fraction

    left, out, until = list(tokens), [], 0
    while any(left):
        need, quota = window, [0] * len(left)
        if not until:  # shares hold for so many windows, in which all queues surely last
            now = [w if x else 0 for w, x in zip(weights, left)]
            now = now if sum(now) else [int(x > 0) for x in left]
            until, sums = min(x // Fraction(window * w, sum(now)) for x, w in zip(left, now) if w), [Fraction(0)] * len(left)
        if until:
            carried, given, until = Fraction(0), 0, until - 1
            for q, w in enumerate(now):
                carried += Fraction(window * w, sum(now))
                new = sums[q] + carried  # what queues up to here are due since the last queue ran out
                quota[q] = int(new) - int(sums[q]) - given
                sums[q], given = new, given + quota[q]
        else:
            while need and any(left[q] - quota[q] for q in range(len(left))):
                free = [w if left[q] > quota[q] else 0 for q, w in enumerate(now)]
                free = free if sum(free) else [int(left[q] > quota[q]) for q in range(len(left))]
                at, given = 0, 0
                for q, w in enumerate(free):
                    at += w
                    n = need * at // sum(free) - given
                    given += n
                    quota[q] += min(n, left[q] - quota[q])
                need = window - sum(quota)
        left = [x - q for x, q in zip(left, quota)]
        out.append(quota)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_the_schedule_is_a_round_robin_of_deficits(seed):
    rng = np.random.default_rng(seed)
    tokens = [int(x) for x in rng.integers(1, 4000, 6)] + [int(rng.integers(0, 3)), int(rng.integers(0, 50))]
    weights = tokens[:7] + [0] if seed % 2 else [int(x) for x in rng.integers(50, 900, 6)] + [1, 0]
    plan, want = packing.stretches(weights, tokens, 64), slow_round_robin(weights, tokens, 64)
    got = np.zeros((len(want), len(tokens)), int)
    for q, n in enumerate(tokens):
        parts = sorted({0, n, *[int(x) for x in rng.integers(0, n + 1, 3)]})
        for a, b in zip(parts, parts[1:]):  # whatever the chunks
            at, window, offset = packing.cuts(plan, q, a, b, 64)
            edges = np.clip(np.append(at, n if not len(at) else b), a, b)
            for w, k in zip(window, np.diff(edges)):
                got[w, q] += k
            assert all(want[w][q] and sum(want[w][:q]) == o for w, o in zip(window, offset))
    assert (got == want).all() and all(sum(x) == 64 for x in want[:-1])


def test_a_target_mixture_holds_while_queues_last(spark):
    docs = spark.createDataFrame([(k, "x " * 25_000, s) for k in range(4) for s in ("a", "b", "none")], "doc_id long, text string, source string")
    target = spark.createDataFrame([("a", 0.25), ("b", 0.75), ("absent", 3.0)], "source string, share double")
    rows = packing.pack(docs, queries.tokenizer_path("byte_bpe_50k.json"), target).collect()
    n = sum(r.length for r in rows if r.source == "b")
    whole = n // 1536
    got = Counter()
    for r in rows:
        if r.sequence_id < whole:
            got[r.source] += r.length
    assert got == {"a": 512 * whole, "b": 1536 * whole}
    last = min(r.sequence_id for r in rows if r.source == "none")
    assert last >= max(r.sequence_id for r in rows if r.source == "a")
    check_pieces([r for r in rows], [(r.doc_id, r.text) for r in docs.collect()])


# web pages


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><div id=sidebar>Side bar text with many words in it</div>
<main><article><header><h1>Title &amp; more</h1></header><p>First   paragraph
with <b>bold</b> and <a href=y>a link</a>.<p>Second &lt;one&gt; &copy; 2024<br>after break</p><div class="ad">Buy now</div><ul><li>item one</li><li>item two</li></ul>
<form><input value=1>Sign up</form><section class="comments"><p>Great post, thanks a lot for all of it!</p></section></article></main><footer>&copy; Foot</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Title & more\nFirst paragraph with bold and a link.\nSecond <one> © 2024 after break\nitem one\nitem two"
    for empty in (None, "", " ", "<p></p>", "<script>x</script>", "<!-- c -->"):
        assert html_text.main_text(empty) == ""
    assert html_text.main_text("plain &amp text") == "plain & text"
    assert html_text.main_text("<p>one<p>two <b>x") == "one\ntwo x"
    assert html_text.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert html_text.main_text("<p>" + "word " * 100_000).count("word") == 100_000


STORY = "<p>A first paragraph that is long enough to be the story of this page.</p><p>A second paragraph, &amp; as long as the first one was.</p>"
SAID = "<p>A reader says more than the story itself does, and goes on and on about it without any end.</p>" * 5
LAYOUTS = [
    f'<div class="layout with-sidebar"><div class="sidebar-right"><article><h1>T</h1>{STORY}</article><aside>side</aside></div></div>',
    f'<div class="content no-sidebar"><h1>T</h1>{STORY}</div><div class="sidebar"><p>side</p></div>',
    f'<article><h1>T</h1>{STORY}<div class="ad"><h2>Buy</h2></div></article><div class="comments"><article>{SAID}</article></div>',
    f'<main><article class="post"><h1>T</h1>{STORY}</article><ol><li><article class="comment-body">{SAID}</article></li></ol></main>',
    f'<div id="head"><h1>T</h1></div><div><div>{STORY}</div></div><div id="respond">{SAID}</div>',
]


@pytest.mark.parametrize("page", LAYOUTS)
def test_main_text_of_other_layouts(page):
    assert html_text.main_text(f"<html><body>{page}</body></html>").split("\n") == ["T", "A first paragraph that is long enough to be the story of this page.", "A second paragraph, & as long as the first one was."]


@pytest.mark.parametrize("start", ["<head><title>x</title><body>", "<head><title>x</title><meta name=a>", "<head><script>x</script>\n<head>", "<head><noscript><link rel=a><body>", "<head><noscript><p>x</p></noscript>"])
def test_main_text_without_the_end_of_the_head(start):
    assert html_text.main_text(f"<html>{start}<p>one</p><p>two</p>") == "one\ntwo"
    assert html_text.main_text(f"<html>{start}bare text") == "bare text"


LONG = "a paragraph with words enough to outweigh what is beside it"
WHOLE = [
    (f"<article><h1>T</h1><div class=body><p>{LONG}</p><p>{LONG}</p></div><p>Short end.</p></article>", ["T", LONG, LONG, "Short end."]),
    (f"<main><h2>T</h2>bare <b>bold</b><section><p>{LONG}</p><p>{LONG}</p></section><section><h3>S</h3><ul><li>i<li>j</ul></section></main>", ["T", "bare bold", LONG, LONG, "S", "i", "j"]),
    (f"<main><h1>T</h1><article><h2>S</h2><div><p>{LONG}</p><p>{LONG}</p></div><figure><figcaption>c</figcaption></figure></article><p>other</p></main>", ["T", "S", LONG, LONG, "c"]),
    (f"<article><p>start</p><article><p>{LONG}</p><p>{LONG}</p></article><aside>no</aside><p>end</p></article><p>{LONG}</p>", ["start", LONG, LONG, "end"]),
]


@pytest.mark.parametrize("page, want", WHOLE)
def test_main_text_is_the_whole_article(page, want):
    assert html_text.main_text(f"<html><body>{page}</body></html>").split("\n") == want


WRAPPED = [
    (f'<div class="content-with-sidebar"><h1>T</h1><p>{LONG}</p><div class="sidebar">side</div></div>', ["T", LONG]),
    (f'<div class="sidebar-right"><article><h2>T</h2><p>{LONG}</p></article><div class="share">Share</div></div>', ["T", LONG]),
    (f'<div id="search"><div class="page alert-on"><h2>T</h2><p>{LONG}</p></div></div><div class="comments">{SAID}</div>', ["T", LONG]),
    (f'<div class="nav-open"><div><p>{LONG}</p><p>{LONG}</p></div><nav>menu</nav></div>', [LONG, LONG]),
    (f'<div><h2>T</h2><p>{LONG}</p></div><div class="sidebar"><h2>S</h2>{SAID}</div><div class="banner"><h1>Site</h1></div>', ["T", LONG]),
    (f'<article><p>{LONG}</p></article><div class="cookie-box"><h1>C</h1>{SAID}</div>', [LONG]),
    (f'<div><p>{LONG}</p></div><div class="comment-list">{SAID}</div><div class="newsletter">{SAID}</div>', [LONG]),
]


@pytest.mark.parametrize("page, want", WRAPPED)
def test_main_text_in_a_block_named_like_noise(page, want):
    assert html_text.main_text(f"<html><body>{page}</body></html>").split("\n") == want


FORMS = [
    (f"<form id=aspnetForm><input type=hidden value=x><div><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div><label for=q>Name</label><input id=q><button>Go</button></form>", ["T", LONG, LONG]),
    (f"<form><div><p>{LONG}</p><p>{LONG}</p></div></form><footer>foot</footer>", [LONG, LONG]),
    (f'<form><nav>menu</nav><article><h1>T</h1><p>{LONG}</p><form class="signup"><p>{LONG}</p></form></article></form>', ["T", LONG]),
    (f'<div><h1>T</h1><p>{LONG}</p></div><form class="search-form"><fieldset>{SAID}</fieldset></form>', ["T", LONG]),
    (f"<article><p>{LONG}</p><form><p>{LONG}</p><p>{LONG}</p></form></article>", [LONG]),
    (f"<div><p>{LONG} <label>inner</label> and on</p></div>", [f"{LONG} inner and on"]),
    (f'<div class="elementor-widget-container"><h1>T</h1><p>{LONG}</p></div>', ["T", LONG]),
    (f'<div class="elementor-widget-container"><p>{LONG}</p></div>', [LONG]),
    (f'<div class="research search-result"><p>{LONG}</p></div>', [LONG]),
    (f"<article><h1>T</h1><p>Short lead.</p><div><p>{LONG}</p><p>{LONG}</p></div><p>Short end.</p></article>", ["T", "Short lead.", LONG, LONG, "Short end."]),
]


@pytest.mark.parametrize("page, want", FORMS)
def test_main_text_in_and_beside_forms(page, want):
    assert html_text.main_text(f"<html><body>{page}</body></html>").split("\n") == want


@pytest.mark.parametrize("bomb", ["<!--", "<!-- <p>", "<![CDATA[", "<!doctype", "<?x ", "<a ", "</", "</p ", "<!--a--", "<b c='", "&#", "&am", "<p>"])
def test_main_text_of_unclosed_markup_takes_linear_time(bomb):
    import time

    began = time.perf_counter()
    assert html_text.main_text(f"<p>one <b>two</b></p>{bomb * 20_000}").startswith("one two")
    assert html_text.main_text(f"<p>one</p><!-- {bomb * 20_000} --><p>two</p>").startswith("one")
    assert time.perf_counter() - began < 5


def test_main_text_around_comments():
    assert html_text.main_text("<p>a</p><!--> <p>b</p><!---><p>c</p><!-- x --!><p>d</p><!-- <p>no</p>") == "a\nb\nc\nd"
    assert html_text.main_text("<p>a</p><![CDATA[x]]><p>b</p><p>c <a href='x") == "a\nb\nc"


def test_pages_with_other_ids_and_columns(spark):
    pages = spark.createDataFrame([("x", "u", "<p>a</p>", 1, 2), (None, None, None, 1, 2)], "name string, url string, html string, TEXT int, n_chars int")
    assert [tuple(r) for r in html_text.extract(pages, "name").collect()] == [("x", "u", "a", 1), (None, None, "", 0)]
    assert html_text.extract(pages.limit(0), "name").count() == 0


def test_main_text_takes_linear_time():
    many = "<div>a line of text</div>" * 30_000
    assert html_text.main_text(f"<div><p>best</p>{many}</div>").count("line") == 30_000
    assert html_text.main_text("<div class=ad>" * 5000 + "<article>" * 5000 + "<h1>x</h1>" * 5000).count("x") == 5000
    assert html_text.main_text("<div class=ad-x><p class=ad>y</p>" * 5000 + "x" * 10_000) == "x" * 10_000


def test_pages_match_their_articles(spark, data):
    import html

    pages = spark.read.parquet(f"{data}/pages.parquet").unionByName(spark.createDataFrame([(None, None, None), (-1, "u", "")], "page_id long, url string, html string"))
    source = {r.page_id: r.html for r in pages.collect()}
    got = html_text.extract(pages).collect()
    assert len(got) == len(source)
    for r in got:
        article = re.search("<article>(.*?)(</article>|$)", source[r.page_id] or "", re.S)
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", x))).strip() for x in re.split(r"<(?:h1|p)>|</h1>|</p>", article[1])] if article else []
        assert r.text == "\n".join(filter(None, parts)) and r.n_chars == len(r.text)


# archives


def test_archives_round_trip(spark, data):
    rows = [(1, "http://a\r\nX: y", "same"), (2, "http://b", "same"), (3, None, None), (4, "u", ""), (9, "é", "other"), (9, "é", "other"), (None, "n", "same"), (5, "l", "x" * 600_000)]
    pages = spark.read.parquet(f"{data}/pages.parquet").select((F.col("page_id") + 100).alias("page_id"), "url", "html").union(spark.createDataFrame(rows, "page_id long, url string, html string"))
    source, first = Counter(), {}
    for r in pages.collect():
        raw = (r.html or "").encode()
        source[r.page_id, raw] += 1
        if r.page_id is not None:
            first[raw] = min(first.get(raw, r.page_id), r.page_id)
    want = Counter()
    for (i, raw), n in source.items():
        old = None if i is None or first[raw] == i else first[raw]
        want[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if old is None else "revisit", old] += n
    assert Counter(tuple(r) for r in warc.round_trip(pages).collect()) == want
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_archives_as_files(spark, data, tmp_path):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    archives = warc.Written(warc.bundles(pages)).df
    files = warc.export(archives, f"file://{tmp_path}").collect()
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted(f"{r.bundle_id}.warc.zst" for r in files)
    assert sum(r.bytes for r in files) == sum(p.stat().st_size for p in tmp_path.iterdir())
    plain = b"".join(zstandard.ZstdDecompressor().stream_reader(Path(r.path).read_bytes(), read_across_frames=True).read() for r in files)
    assert plain.count(b"WARC/1.1\r\nWARC-Type: ") == pages.count()
    back = warc.read(warc.imported(spark, f"file://{tmp_path}"))
    assert Counter(map(tuple, back.collect())) == Counter(map(tuple, warc.read(archives).collect()))
    assert warc.export(archives.limit(0), f"file://{tmp_path}/none").count() == 0


def test_bundles_seek_and_are_plain_zstandard():
    b = warc.Bundle(frame_bytes=2000)
    records = {i: warc.record(i, f"http://x/{i}", b"payload %d " % i * 50, None) for i in range(40)}
    for i, r in records.items():
        b.add(i, r)
    data = b.finish()
    reader = warc.Reader(data)
    assert len(reader.frames) > 5 and reader.record(33) == records[33] and list(reader.records()) == list(records.values())
    b.add(33, records[0])
    assert warc.Reader(b.finish()).record(33) == records[33]
    with pytest.raises(KeyError):
        reader.record(40)
    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert whole == b"".join(records.values())
    bad = records[0].replace(b"payload 0", b"payload 1")
    with pytest.raises(ValueError):
        warc.parse(bad)
    with pytest.raises(ValueError):
        warc.Reader(b"not a bundle at all")


# URLs


def slow_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match("[^?#]*", rest[len(host) :])[0]


URLS = [
    None, "", "no scheme", "http://", "https://NET/", "http://a.net/x", "http://net", "http://net?x=/", "https://www.example.net/en/1", "https://example.net/english", "http://badexample.net/en/", "http://org/fr/a",
    "http://x.org/fr", "http://example.com/de/", "http://Example.COM/de/#f", "http://example.com/DE/", "a://b://c/d", "http://free-bets.example.com/x", "http://x.com/casino/1", "http://ads.x.com/", "http://é.net/ü", "http://a.net/x", "http://" + "a" * 100_000 + ".net/", "x\ny://a.net/b\nc",
]


def test_urls(spark):
    rules = dict(queries.URL_RULES)
    pages = spark.createDataFrame([(k if k != 3 else None, u, "r", "t") for k, u in enumerate(URLS)], "page_id long, url string, rule string, tokens string")
    table = urlfilter.rule_table(spark, [urlfilter.host_rule(*r) for r in rules.items()] + urlfilter.PATTERNS)
    got = {r.page_id: r for r in urlfilter.judge(pages, table).collect()}
    assert len(got) == len(URLS)
    for k, u in enumerate(URLS):
        r, (host, path) = got[k if k != 3 else None], slow_url(u)
        assert (r.host, r.path) == (host, path)
        fits = [x for x in rules if (host == x.split("/", 1)[0] or host.endswith("." + x.split("/", 1)[0])) and path.startswith("/" + x.split("/", 1)[1])]
        if fits:
            best = max(fits, key=len)
            assert (r.rule, r.verdict) == (best, rules[best]), u
        else:
            assert r.rule not in rules
            assert r.verdict == ("block" if any(re.search(p, host + path) for _, _, p, _, _ in urlfilter.PATTERNS) else "allow"), u
    assert urlfilter.judge(pages.limit(0), table).count() == 0


def test_rules_are_filed_under_their_rarest_token(spark):
    urls = spark.createDataFrame([(["common", "rare"],), (["common"],)], "tokens array<string>")
    table = urlfilter.rule_table(spark, [urlfilter.pattern_rule("r", "block", "x", ["common", "rare"]), urlfilter.pattern_rule("n", "block", "y", ["never", "rare"])])
    assert {r.rule: r.token for r in urlfilter.index(table, urls).collect()} == {"r": "rare", "n": "never"}


def test_rules_of_files(spark, data, tmp_path):
    rng = np.random.default_rng(5)
    urls = [r.url for r in spark.read.parquet(f"{data}/pages.parquet").select("url").collect()] + URLS
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    parsed = [slow_url(u) for u in urls]
    hosts = sorted({h for h, _ in parsed if h and len(h) < 100 and "\t" not in h})
    rules = {f"{h.split('.', int(rng.integers(0, h.count('.') + 1)))[-1]}/{'' if k % 3 else 'a.b+c/'}": ("block", "allow")[k % 2] for k, h in enumerate(hosts)}
    rules |= {f"h{k}.com/p{k}/": "block" for k in range(5000)} | {"é.net/": "allow", "net": "block"}
    (tmp_path / "hosts.txt").write_text("# a list\n\n" + "".join(f"{a}\t{r}\n" for r, a in rules.items()))
    (tmp_path / "own.txt").write_text("block\tcasino\tcasino\t(?:^|[./-])casino(?:[./-]|$)\nblock\tport\t\t:[0-9]+/\n")
    table = urlfilter.load_rules(spark, str(tmp_path))
    assert table.count() == len(rules) + 2
    got = {r.page_id: r for r in urlfilter.judge(pages, table).collect()}
    assert len(got) == len(urls)
    named = 0
    for k, (host, path) in enumerate(parsed):
        fits = [r for r in rules if (host + "/").endswith("." + (h := r.partition("/")[0]) + "/") or host == h]
        fits = sorted((r for r in fits if path.startswith("/" + r.partition("/")[2])), key=lambda r: (-len(r), r))
        if fits:
            named += 1
            assert (got[k].rule, got[k].verdict) == (fits[0], rules[fits[0]]), urls[k]
        else:
            own = [n for n, p in (("casino", r"(?:^|[./-])casino(?:[./-]|$)"), ("port", ":[0-9]+/")) if re.search(p, host + path)]
            assert got[k].verdict == ("block" if own else "allow") and (got[k].rule in own if own else got[k].rule is None), urls[k]
    assert named > 50


def test_a_line_that_is_no_rule_is_an_error(spark, tmp_path):
    (tmp_path / "bad.txt").write_text("forbid\texample.com/\n")
    with pytest.raises(Exception, match="not a rule"):
        urlfilter.load_rules(spark, str(tmp_path)).collect()


def test_rules_without_a_token_are_tried_on_every_url(spark):
    pages = spark.createDataFrame([(k, f"http://{'x' if k % 3 else 'y'}.com/{k}") for k in range(300)] + [(None, None)], "page_id long, url string")
    table = urlfilter.rule_table(spark, [urlfilter.pattern_rule("any", "block", r"^y", []), urlfilter.pattern_rule("no host", "block", "^$", [])])
    got = urlfilter.judge(pages, table).collect()
    assert len(got) == 301
    assert all(r.rule == ("no host" if r.page_id is None else None if r.page_id % 3 else "any") for r in got)


# registered queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_sql(spark, data, name):
    con = duckdb.connect()
    for f in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = queries.queries()[name](spark, data)
    order = sorted(df.columns)
    found = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == order
    assert sorted(repr(tuple(r[c] for c in order)) for r in df.collect()) == sorted(repr(tuple(r[names.index(c)] for c in order)) for r in found.fetchall())
