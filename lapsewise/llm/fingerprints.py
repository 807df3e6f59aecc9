"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraphs.

A text's paragraphs (cut at line breaks and sentence ends) are hashed; a
sketch is a table of cells that hold a count, the XOR of the digests and the
XOR of their checks, each digest being in one cell of each of three parts.
The sketches of two versions subtract cell by cell; what both have cancels,
and peeling cells that hold one digest recovers the digests in which they
differ. Digests are dealt to small tables by their hash, so every table stays
small however long the text; a table that does not peel is made again with
more cells. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapsewise.llm.common import written

#: Digests of the first version in a table, on average, and cells of a part on each try.
PER_TABLE, CELLS = 3, (4, 12, 48)
#: Cells of a part in the printed fingerprint.
PRINTED_CELLS = 4
#: Rounds of peeling before a larger table is tried.
ROUNDS = 6
PARAGRAPH = r"\n|(?<=[.!?])[ \t]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def digests(text: Column) -> Column:
    """The distinct hashes of a text's paragraphs; blank ones do not count."""
    parts = F.filter(F.split(text, PARAGRAPH), lambda p: F.trim(p) != "")
    return F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p)))


def _check(d: Column) -> Column:
    return F.xxhash64(d, F.lit("check"))


def _placed(d: Column, check: Column, cells: int, **more: Column) -> Column:
    """struct(d, h, p0, p1, p2): a digest, its check, and its cell in each part; and ``more``."""
    return let(F.xxhash64(d, F.lit(cells)), lambda h: F.struct(
        d.alias("d"), check.alias("h"), *[
            (F.pmod(F.shiftrightunsigned(h, 20 * part), F.lit(cells)) + part * cells).cast("int")
            .alias(f"p{part}") for part in range(3)], *[v.alias(k) for k, v in more.items()]))


def _cell(count: Column, key: Column, check: Column) -> Column:
    return F.struct(count.cast("int").alias("c"), key.alias("k"), check.alias("h"))


def sketch(keys: Column, cells: int) -> Column:
    """The table of an array of distinct digests: 3 * ``cells`` cells."""
    nothing = _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))

    def part(some: Column, number: int) -> Column:
        return F.transform(
            F.sequence(F.lit(number * cells), F.lit((number + 1) * cells - 1)),
            lambda i: F.aggregate(
                F.filter(some, lambda e: e[f"p{number}"] == i), nothing,
                lambda s, e: _cell(s["c"] + 1, s["k"].bitwiseXOR(e["d"]), s["h"].bitwiseXOR(e["h"]))))

    placed = F.transform(keys, lambda d: _placed(d, _check(d), cells))
    return let(placed, lambda some: F.concat(*[part(some, number) for number in range(3)]))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _cell(x["c"] - y["c"], x["k"].bitwiseXOR(y["k"]),
                                               x["h"].bitwiseXOR(y["h"])))


def peel(table: Column, cells: int) -> Column:
    """struct(ok, plus, minus): whether the table of a difference peels to nothing, and how many
    digests only the first and only the second version has."""
    def remove(x: Column, i: Column, found: Column) -> Column:
        own = F.filter(found, lambda p: (p["p0"] == i) | (p["p1"] == i) | (p["p2"] == i))
        return F.aggregate(own, x, lambda s, p: _cell(
            s["c"] - p["c"], s["k"].bitwiseXOR(p["d"]), s["h"].bitwiseXOR(p["h"])))

    def step(state: Column) -> Column:
        pure = F.filter(state["cells"], lambda x: (F.abs(x["c"]) == 1) & (x["h"] == _check(x["k"])))
        keys = F.transform(F.array_distinct(pure), lambda x: _placed(x["k"], x["h"], cells, c=x["c"]))
        return let(keys, lambda found: F.when(F.size(found) == 0, state).otherwise(F.struct(
            F.transform(state["cells"], lambda x, i: remove(x, i, found)).alias("cells"),
            (state["plus"] + F.size(F.filter(found, lambda p: p["c"] == 1))).alias("plus"),
            (state["minus"] + F.size(F.filter(found, lambda p: p["c"] == -1))).alias("minus"))))

    start = F.struct(table.alias("cells"), F.lit(0).alias("plus"), F.lit(0).alias("minus"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda state, _: step(state))
    return let(end, lambda s: F.struct(
        (~F.exists(s["cells"], lambda x: (x["c"] != 0) | (x["k"] != 0) | (x["h"] != 0))).alias("ok"),
        s["plus"].alias("plus"), s["minus"].alias("minus")))


def differences(a: Column, others: dict[str, Column]) -> Column:
    """For each of ``others``, struct(ok, plus, minus) against ``a`` from the sketches, larger ones
    where one fails; should the largest fail too, the arrays themselves are compared."""
    def attempt(b: Column, sizes: tuple[int, ...], own: Column | None = None) -> Column:
        if not sizes:
            return F.struct(F.lit(True).alias("ok"), F.size(F.array_except(a, b)).alias("plus"),
                            F.size(F.array_except(b, a)).alias("minus"))
        own = sketch(a, sizes[0]) if own is None else own
        tried = peel(subtract(own, sketch(b, sizes[0])), sizes[0])
        return let(tried, lambda r: F.when(r["ok"], r).otherwise(attempt(b, sizes[1:])))

    return let(sketch(a, CELLS[0]), lambda own: F.struct(
        *[attempt(b, CELLS, own).alias(name) for name, b in others.items()]))


def printed(keys: Column) -> Column:
    """A fingerprint: the digests' number and the cells of their fixed-size sketch, in hexadecimal."""
    cells = F.transform(sketch(keys, PRINTED_CELLS), lambda x: F.concat(
        F.hex(x["c"].cast("long")), F.lit("."), F.hex(x["k"])))
    return F.concat_ws(":", F.size(keys).cast("string"), F.concat_ws(":", cells))


def followers(docs: DataFrame) -> DataFrame:
    """k, h (a document's key) and before (struct of k, h, n): the document that it follows.

    Order: descending doc_id (null last), then descending text hash; the first
    follows the last. Only keys and lengths move.
    """
    narrow = (docs.select("k", "h", "n").distinct()
              .repartitionByRange(F.col("k").desc(), F.col("h").desc())
              .withColumn("part", F.spark_partition_id()))
    narrow = written(narrow, "order")
    own = F.struct("k", "h", "n")
    by_part = Window.orderBy("part")
    last = narrow.groupBy("part").agg(F.min(own).alias("last"))
    edges = last.select("part", F.coalesce(F.lag("last").over(by_part), F.min("last").over(
        by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("edge"))
    inside = Window.partitionBy("part").orderBy(F.col("k").desc(), F.col("h").desc())
    return (narrow.join(F.broadcast(edges), "part")
            .select("k", "h", F.coalesce(F.lag(own).over(inside), F.col("edge")).alias("before")))


def compare_edited(docs: DataFrame, text: str = "text") -> DataFrame:
    """Fingerprints of each document and its edited text, and their likeness.

    The edited text has the last third of the code points (rounded down)
    replaced by as many first ones of the next document (descending doc_id;
    after the last the first). Likeness of two texts: shared digests over all
    digests, from the peeled difference (1 for two texts without paragraphs).
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, one row for each row. Null text is empty; of
    repeated rows one takes part in the order; a null doc_id comes last.
    The texts are shuffled once, and once more the part that others need.
    """
    whole = docs.select(docs["doc_id"].cast("long").alias("doc_id"),
                        F.coalesce(docs[text], F.lit("")).alias("text"))
    whole = whole.select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")).alias("k"),
        F.xxhash64("text", F.col("doc_id").isNull()).alias("h"), F.length("text").alias("n"))
    links = followers(whole)
    keyed = whole.withColumn("copy", F.row_number().over(Window.partitionBy("k", "h").orderBy("n")))
    # the conditions on n and doc_id always hold; they make this side read the same columns as the
    # other, and abs keeps the row limit behind the exchange, so that both read one exchange of the texts
    given = (keyed.where("abs(copy) = 1 and n >= 0 and (doc_id is not null or k < 0)").join(links, ["k", "h"])
             .select(F.col("before.k").alias("k"), F.col("before.h").alias("h"),
                     F.substring(F.col("text"), F.lit(1), F.floor(F.col("before.n") / 3).cast("int"))
                     .alias("head"), digests(F.col("text")).alias("x")))
    both = (keyed.join(given, ["k", "h"])
            .withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n") - F.floor(
                F.col("n") / 3).cast("int")), F.col("head")))
            .withColumns({"a": digests(F.col("text")), "e": digests(F.col("edited"))}))
    tables = F.greatest(F.lit(1), F.ceil(F.size("a") / PER_TABLE)).cast("long")

    def dealt(side: int, name: str) -> Column:
        return F.transform(F.col(name), lambda d: F.struct(
            F.pmod(F.xxhash64(d, F.lit("table")), tables).alias("table"), F.lit(side).alias("side"),
            d.alias("d"), F.lit(None).cast(ABOUT).alias("about")))

    about = F.struct("n", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                     printed(F.col("a")).alias("fingerprint"), printed(F.col("e")).alias("edited_fingerprint"),
                     F.size("a").alias("size"))
    first = F.array(F.struct(F.lit(0).cast("long").alias("table"), F.lit(-1).alias("side"),
                             F.lit(None).cast("long").alias("d"), about.cast(ABOUT).alias("about")))
    rows = both.select("doc_id", "k", "h", "copy", F.explode(F.concat(
        first, dealt(0, "a"), dealt(1, "e"), dealt(2, "x"))).alias("r"))

    def of(side: int) -> Column:
        return F.collect_list(F.when(F.col("r.side") == side, F.col("r.d")))

    small = rows.groupBy("k", "h", "copy", "r.table").agg(
        of(0).alias("a"), of(1).alias("e"), of(2).alias("x"), F.max("r.about").alias("about"),
        F.max("doc_id").alias("doc_id"))
    found = small.select("k", "h", "copy", "doc_id", "about", differences(
        F.col("a"), {"edit": F.col("e"), "next": F.col("x")}).alias("by"))
    total = found.groupBy("k", "h", "copy").agg(
        F.max("doc_id").alias("doc_id"), F.max("about").alias("about"),
        *[F.sum(f"by.{v}.{s}").alias(f"{v}_{s}") for v in ("edit", "next") for s in ("plus", "minus")])

    def near(v: str) -> Column:
        union = F.col("about.size") + F.col(f"{v}_minus")
        return F.when(union == 0, F.lit(1.0)).otherwise((F.col("about.size") - F.col(f"{v}_plus")) / union)

    return total.select("doc_id", F.col("about.n").cast("long").alias("n_chars"), "about.edited_sha256",
                        "about.fingerprint", "about.edited_fingerprint",
                        near("edit").alias("near_edited"), near("next").alias("near_next"))


ABOUT = "struct<n:int,edited_sha256:string,fingerprint:string,edited_fingerprint:string,size:int>"
