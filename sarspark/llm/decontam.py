"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Short test items lie inside long documents, where Jaccard similarity says nothing, so items
are searched by containment. An item's sketch is the bottom of its shingles in hash order
(a bottom-k MinHash). Items are partitioned by size; a partition whose largest item has q
shingles keeps q - ceil(threshold * q) + 1 of them. A document that holds at least the
threshold of an item's shingles must hold one of those, so the search misses nothing.
Documents probe the sketches with all their shingles (so the sketch is a prefix filter; a document is
not sketched itself). Items of one to four words are one shingle of that many words, and where
there are such items documents probe with their runs of as many words as well. What meets is a candidate pair of a text
(by its hash) and an item; documents with such a text are then verified by intersecting the two
whole shingle sets as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Written, spare, text_of

WORDS = 5
THRESHOLD = 0.8


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def _shingle(words: Column, i: Column, size: int = WORDS) -> list[Column]:
    return [F.get(words, i + k) for k in range(size)]


def shingles_of(words: Column, size: Column | None = None) -> Column:
    """The distinct shingles of ``size`` words (WORDS of them) as text; a shorter text is one shingle, an empty one the empty shingle."""
    size = F.lit(WORDS) if size is None else size
    at = F.sequence(F.lit(0), F.greatest(F.size(words) - size, F.lit(0)))
    return F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(words, i + 1, size), " ")))


def item_sketches(items: DataFrame, id_col: str = "item_id", text_col: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(item, size, shingles, n_item) of items with a word, and (item, size, n_item, probe) of their sketches.

    ``size`` is the words of a shingle: WORDS, or all words of an item that has fewer.
    """
    whole = items.select(F.col(id_col).alias("item"), words_of(text_of(text_col)).alias("words")).where("words[0] <> ''")
    whole = whole.select("item", F.least(F.size("words"), F.lit(WORDS)).alias("size"), shingles_of(F.col("words")).alias("shingles")).withColumn("n_item", F.size("shingles"))
    # sizes from 2^(c-1)+1 to 2^c form a partition; its sketch length serves its largest item
    largest = F.pow(2, F.ceil(F.log2(F.col("n_item").cast("double"))))
    length = (largest - F.ceil(largest * threshold - 1e-9) + 1).cast("int")
    order = F.array_sort(F.transform("shingles", lambda s: F.struct(F.xxhash64(s, F.lit(9)).alias("rank"), s.alias("shingle"))))
    sketch = whole.select("item", "size", "n_item", F.explode(F.slice(order, F.lit(1), length)).alias("s"))
    parts = [F.get(F.split("s.shingle", " "), F.lit(k)) for k in range(WORDS)]
    return whole, sketch.select("item", "size", "n_item", F.xxhash64(*parts).alias("probe"))


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc id, item id, n_shared, n_item, containment) of every document and item that it holds.

    Null and wordless texts match nothing. An item of fewer than five words is one shingle of all
    its words, which documents are searched for too. A repeated row or id gives its pair once; null
    ids are kept as null. Other columns are ignored.
    """
    whole, sketch = item_sketches(items, item_id_col, item_text_col, threshold)
    whole, sketch = Written(whole).df, Written(sketch.distinct()).df
    # probes name their text by a hash, so that neither a shuffle nor the distinct pairs carry words
    text = docs.select(F.col(id_col).alias("doc"), text_of(text_col).alias("text")).withColumn("key", F.xxhash64("text"))
    rows = text.select("key", words_of(F.col("text")).alias("words")).where("words[0] <> ''")

    def probes(size: int) -> DataFrame:
        """Hashes of all shingles of so many words; a shorter text gives that of all its words."""
        at = F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0)))
        each = rows.select("key", "words", F.explode(at).alias("i"))
        return each.select("key", F.size("words").alias("n_words"), F.xxhash64(*_shingle(F.col("words"), F.col("i"), size)).alias("probe"))

    pairs = None
    for (size,) in sketch.select("size").distinct().orderBy("size").collect():  # at most WORDS of them
        # the sketches' written size lets Spark broadcast them, or shuffle them when they outgrow that
        met = probes(size).join(sketch.where(F.col("size") == size), "probe")
        met = met.where((F.col("n_words") >= F.col("n_item") * threshold) & (F.col("n_words") >= F.col("size"))).select("key", "item")
        pairs = met if pairs is None else pairs.union(met)
    if pairs is None:  # no item has a word
        pairs = rows.join(whole.withColumn("key", F.lit(0).cast("long")), "key").where(F.lit(False)).select("key", "item")
    pairs = Written(pairs.distinct()).df
    both = text.join(pairs, "key").select("doc", "item", words_of(F.col("text")).alias("words")).join(whole, "item")
    shared = F.size(F.array_intersect(shingles_of(F.col("words"), F.col("size")), F.col("shingles")))
    found = both.select("doc", "item", shared.cast("long").alias("n_shared"), F.col("n_item").cast("long").alias("n_item"))
    found = found.where(F.col("n_shared") >= F.col("n_item") * F.lit(threshold) - 1e-9).groupBy("doc", "item").agg(F.max("n_shared").alias("n_shared"), F.max("n_item").alias("n_item"))
    return found.select(F.col("doc").alias(id_col), F.col("item").alias(item_id_col if item_id_col != id_col else "item_id"), "n_shared", "n_item", (F.col("n_shared") / F.col("n_item").cast("double")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that hold an item; rows with a null id stay.

    A row's own text decides (by its hash), so a clean row stays whatever else has its id.
    """
    mark = spare(docs.columns, "held_text")
    known = docs.where(F.col(id_col).isNotNull())
    texts = known.select(F.xxhash64(text_of(text_col)).alias(mark), F.col(text_col).alias("text"))
    held = Written(contained(texts, items, mark, "text", item_id_col, item_text_col, threshold).select(mark).distinct()).df
    return known.join(held, F.xxhash64(text_of(text_col)) == F.col(mark), "left_anti").unionByName(docs.where(F.col(id_col).isNull()))
