"""Benchmark decontamination: which document words lie inside benchmark passages.

A prefix-filtered set join. An item's windows (``window`` consecutive words; a
shorter item is one window) are sets of shingles, short runs of words. The
shingles of the benchmark are counted over the whole corpus, which orders them
by rarity. A document that contains a window contains all its shingles, so the
necessary prefix is one: its rarest. Only that one is joined with the
documents' shingles; its offset gives the place where the window must begin
(positional bound), the document's end the words it needs (length bound), and
the words there are compared one by one. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewise.llm.common import drop_written, written

#: What stands between words, after lower-casing A-Z (a fixed value of the task).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10
#: Words of a shingle (of a window with fewer words: all of them).
SHINGLE = 3
#: Rows of the benchmark's side that are broadcast at a time (about 200 bytes each); a larger
#: benchmark meets the documents in several such blocks.
BLOCK = 1 << 17


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, SEPARATORS, -1), "")


def shingle(w: Column, at: Column, size: int) -> Column:
    """Hash of the ``size`` words of ``w`` from index ``at`` on (words past the end count as missing)."""
    return F.xxhash64(F.lit(size), *[F.get(w, at + i) for i in range(size)])


def shingles(w: Column, sizes: list[int]) -> Column:
    """Hashes at every word, for each size in turn."""
    def of(size: int) -> Column:
        return F.transform(w, lambda _, i: shingle(w, i, size))

    return F.concat(*map(of, sizes))


def item_windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """win (array of words), items (sorted distinct ids as strings): the distinct windows."""
    w = items.select(F.coalesce(items[item_id].cast("string"), F.lit("")).alias("item"),
                     words(items[text]).alias("w")).where(F.size("w") > 0).distinct()
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1))
    each = w.select("item", F.explode(F.transform(
        starts, lambda i: F.slice(F.col("w"), i, F.lit(window)))).alias("win"))
    return each.groupBy("win").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _blocks(df: DataFrame, n: int, rows: int) -> list[DataFrame]:
    """``df`` (of ``n`` rows, with a hash ``h``) in blocks of about ``rows`` rows."""
    k = max(1, -(-n // rows))
    return [df.where(F.pmod(F.xxhash64("h", F.lit("block")), F.lit(k)) == b) if k > 1 else df for b in range(k)]


def prefixes(docs: DataFrame, windows: DataFrame, sizes: list[int], rows: int, size: int = SHINGLE) -> DataFrame:
    """``windows`` (win, class) with n, h and off: their rarest shingle and its offset.

    Rarity is the number of occurrences in all documents, then the hash.
    Windows with a shingle that no document has are left out: they occur nowhere.
    """
    def at(k: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size("win") - k),
                           lambda i: F.struct(shingle(F.col("win"), i, k).alias("h"), i.alias("off")))

    own = F.when(F.size("win") >= size, at(size))
    for k in range(size - 1, 0, -1):
        own = own.when(F.size("win") == k, at(k))
    parts = written(windows.select("win", "class", F.explode(own).alias("s"))
                    .select("win", "class", "s.h", "s.off"), "shingles")
    wanted = written(parts.select("h").distinct(), "wanted")
    of_docs = docs.select(F.explode(shingles(F.col("w"), sizes)).alias("h"))
    counted = None
    for block in _blocks(wanted, wanted.count(), rows * 8):
        one = of_docs.join(F.broadcast(block), "h").groupBy("h").agg(F.count("h").alias("seen"))
        counted = one if counted is None else counted.unionByName(one)
    out = (parts.join(counted, "h", "left")
           .groupBy("win", "class")
           .agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "h", "off")).alias("p"))
           .where("p.seen > 0").select("win", "class", F.size("win").alias("n"), "p.h", "p.off"))
    out = written(out, "prefixes")
    drop_written(parts)
    drop_written(wanted)
    return out


def covered(spans: Column) -> Column:
    """Number of words in the union of spans (begin, n)."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("words"))
    return F.aggregate(
        F.sort_array(spans), start,
        lambda s, x: F.struct(
            F.greatest(s["end"], x["begin"] + x["n"]).alias("end"),
            (s["words"] + F.greatest(F.lit(0), x["begin"] + x["n"] - F.greatest(s["end"], x["begin"]))).alias("words")),
        lambda s: s["words"])


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text",
         item_id: str = "item_id", item_text: str = "text", rows: int = BLOCK) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    n_hit counts the words inside any occurrence of any window, n_items the
    items with a window in the document; items_sha256 is the digest of their
    ids, sorted as strings, joined by commas. Null texts have no words; an item
    without words fits nothing; an item id that is null counts as the empty
    string, one that several rows have stands for the windows of all of them.
    Repeated rows of documents each give a row. No documents: no rows; no
    items: nothing is hit. Other columns of the tables are not read.

    The documents are scanned twice (rarity, then the join) and their texts
    never shuffled; what is shuffled is a row for each document and each hit.
    """
    narrow = docs.select(docs[doc_id].alias("doc_id"), F.md5(F.coalesce(docs[text], F.lit(""))).alias("key"),
                         words(docs[text]).alias("w"))
    found = written(item_windows(items, item_id, item_text, window), "windows")
    classes = written(found.select("items").distinct().withColumn("class", F.monotonically_increasing_id()),
                      "classes")
    sizes = sorted(r[0] for r in found.select(F.least(F.size("win"), F.lit(SHINGLE))).distinct().collect())
    prefix = prefixes(narrow, found.join(classes, "items").select("win", "class"), sizes or [SHINGLE], rows)

    # the first element stands for the document itself; after it every place of each size
    places = narrow.select("doc_id", "key", "w", F.size("w").alias("n_words"), F.posexplode(
        F.concat(F.array(F.lit(None).cast("long")), shingles(F.col("w"), sizes or [SHINGLE]))).alias("pos", "h"))
    begin = F.pmod(F.col("pos") - 1, F.greatest(F.col("n_words"), F.lit(1))) - F.col("p.off")
    hits = None
    for i, block in enumerate(_blocks(prefix, prefix.count(), rows)):
        met = places.join(
            F.broadcast(block).alias("p"),
            (places["h"] == F.col("p.h")) & (begin >= 0) & (begin + F.col("p.n") <= F.col("n_words"))
            & (F.slice(F.col("w"), F.greatest(begin, F.lit(0)) + 1, F.col("p.n")) == F.col("p.win")), "left")
        is_hit = F.col("p.h").isNotNull()
        one = (met.where(is_hit | ((F.col("pos") == 0) & F.lit(i == 0)))
               .select("doc_id", "key", "n_words", (F.col("pos") == 0).alias("whole"),
                       F.when(is_hit, F.struct(begin.alias("begin"), F.col("p.n").alias("n"))).alias("span"),
                       F.col("p.class").alias("class")))
        hits = one if hits is None else hits.unionByName(one)
    of_doc = written(
        hits.groupBy("doc_id", "key")
        .agg(F.max("n_words").cast("long").alias("n_words"), F.count(F.when(F.col("whole"), 1)).alias("copies"),
             F.collect_set("span").alias("spans"), F.collect_set("class").alias("classes"))
        .select("doc_id", "key", "n_words", "copies", covered(F.col("spans")).alias("n_hit"), "classes"), "hits")
    named = (of_doc.select("doc_id", "key", F.explode("classes").alias("class")).join(classes, "class")
             .select(F.col("doc_id").alias("d"), F.col("key").alias("k"), F.explode("items").alias("item"))
             .groupBy("d", "k").agg(F.array_sort(F.collect_set("item")).alias("ids")))
    out = of_doc.join(named, of_doc["doc_id"].eqNullSafe(named["d"]) & (of_doc["key"] == named["k"]), "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    # a row that stands several times in the documents stands as often in the result
    return (out.select("doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"),
                       F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
                       (F.col("n_hit") > 0).alias("contaminated"),
                       F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
            .drop("copy"))
