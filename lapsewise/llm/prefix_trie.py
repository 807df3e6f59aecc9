"""Prefix trie of conversations, built as burst tries.

Every turn is a 128-bit digest of its role and text. A container holds the
conversations that share a prefix; one with more than ``limit`` of them is
burst: the prefix that all its members share (from the least and the greatest
of its sequences) becomes trie heads, members that end there are put aside, and
the others go to new containers by their next turn id. Rounds go on while an
oversized container is left, so a round passes a branching of a very common
prefix, however many turns long. The remaining containers are dealt to shards by
key, sorted there, and swept: neighbouring sequences share their longest common
prefix, so a stack of open nodes gives every node as it closes. Sums over the
subtrees of heads are one aggregation over the heads above each container.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapsewise.llm.common import written

#: Conversations of a container that is not burst.
LIMIT = 1024
#: Ids of a conversation list that are joined before they are digested.
RUN = 8192
ROOT = ""
NO_IDS = hashlib.sha256(b"").hexdigest()

CONTAINED = "conv_id long, ids array<binary>, lens array<int>, at int, key string, above array<string>, parent long"
NODE = ("conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends_sha256 string")


def rebuilt(turns: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """conv_id, ids (digest of each turn), lens (code points of its text): the rebuilt conversations.

    A conversation c is the first h turns of conversation c - c % group (all
    if it has fewer, none if it does not exist), then its own turns after its
    first h; h = crc32(decimal c) % heads. Turns stand by number, null first;
    those of one number by role, then by digest. Null roles and texts are
    empty; turns without a conversation id belong to no conversation and are
    left out. One shuffle, by c - c % group; texts do not take part in it. A
    conversation's digests (20 bytes a turn) are held in one row.
    """
    role, text = F.coalesce(turns["role"], F.lit("")), F.coalesce(turns["text"], F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    conv = turns["conv_id"].cast("long")
    own = (turns.where(conv.isNotNull())
           .select((conv - conv % group).alias("home"), conv.alias("conv_id"), F.struct(
               turns["turn"].alias("turn"), role.alias("role"), digest.alias("id"),
               F.length(text).alias("len")).alias("t"))
           .repartition("home")
           .groupBy("home", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")))
    first = F.first(F.when(F.col("conv_id") == F.col("home"), F.slice("t", 1, heads - 1)), ignorenulls=True)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    made = own.withColumn("first", first.over(Window.partitionBy("home"))).withColumn("h", h)
    after = F.slice("t", F.col("h") + 1, F.greatest(F.size("t") - F.col("h"), F.lit(0)))
    whole = F.concat(F.coalesce(F.slice("first", F.lit(1), F.col("h")), F.slice("t", 1, 0)), after)
    return made.select("conv_id", F.transform(whole, lambda x: x["id"]).alias("ids"),
                       F.transform(whole, lambda x: x["len"]).alias("lens"))


def _common(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    other = F.array_position(same, False)
    return F.when(other > 0, other - 1).otherwise(F.size(same)).cast("int")


def _rest(at: Column) -> Column:
    return F.slice("ids", at + 1, F.greatest(F.size("ids") - at, F.lit(0)))


def _into_next(df: DataFrame, end: Column, key: Column, above: Column, parent: Column) -> DataFrame:
    """Rows that go on behind turn ``end``, in their new containers."""
    below = F.md5(F.concat(key.cast("binary"), F.get("ids", end)))
    return (df.where(F.size("ids") > end)
            .select("conv_id", "ids", "lens", (end + 1).alias("at"), below.alias("key"),
                    above.alias("above"), parent.alias("parent")))


def burst(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(contained, heads, ends): the containers that stay, the burst ones, and who ends at their branching.

    ``rows`` are rebuilt conversations. heads: key, top and end (depths of the
    first and the last head of a burst container), lens (of their texts),
    n_convs, conv_id (its least member), parent (that of the head above) and
    above (the keys of the heads above). The root is burst first.
    """
    root = rows.agg(F.min("conv_id")).scalar()
    ends = [rows.where(F.size("ids") == 0).select(F.lit(ROOT).alias("key"), "conv_id")]
    active = written(_into_next(rows, F.lit(0), F.lit(ROOT), F.array(F.lit(ROOT)), root), "burst")
    kept, heads = [], []
    while True:
        sizes = active.groupBy("key").agg(F.count("key").alias("n_convs"), F.min("conv_id").alias("least"))
        big = written(sizes.where(F.col("n_convs") > limit), "oversized")
        if big.isEmpty():
            return _union([*kept, active]), _union(heads) if heads else None, _union(ends)
        kept.append(written(active.join(big, "key", "left_anti").select(*active.columns), "contained"))
        over = active.join(big, "key")
        rest = _rest(F.col("at"))
        found = written(
            over.groupBy("key").agg(
                F.min(rest).alias("a"), F.max(rest).alias("b"),
                F.min(F.struct("conv_id", "at", "lens", "above", "parent", "n_convs", "least")).alias("m"))
            .select("key", F.col("m.at").alias("top"), (F.col("m.at") + _common(F.col("a"), F.col("b"))).alias("end"),
                    "m.lens", F.col("m.n_convs").alias("n_convs"), F.col("m.least").alias("conv_id"),
                    F.col("m.parent").alias("parent"), F.col("m.above").alias("above")), "heads")
        heads.append(found.withColumn("lens", F.slice("lens", F.col("top"), F.col("end") - F.col("top") + 1)))
        met = active.join(found.select("key", "end", F.col("conv_id").alias("least")), "key")
        ends.append(written(met.where(F.size("ids") == F.col("end")).select("key", "conv_id"), "ends"))
        active = written(_into_next(met, F.col("end"), F.col("key"), F.concat("above", F.array("key")),
                                    F.col("least")), "burst")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def sweep(rows: list[tuple], top: int, parent: int) -> list[list]:
    """The nodes of one container: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256; its top node last.

    rows: (ids, conv_id, lens), sorted; all share the first ``top`` ids.
    """
    out: list[list] = []
    stack: list[dict] = []

    def close() -> None:
        node = stack.pop()
        node["saved"] += (node["n"] - 1) * node["len"]
        row = [node["least"], node["depth"], parent, node["n"], node["children"], node["leaves"] or 1, node["saved"],
               hashlib.sha256(",".join(map(str, node["ends"])).encode()).hexdigest() if node["ends"] else NO_IDS]
        for child in node["below"]:
            child[2] = node["least"]
        out.append(row)
        if stack:
            up = stack[-1]
            up["n"] += node["n"]
            up["least"] = min(up["least"], node["least"])
            up["children"] += 1
            up["leaves"] += row[5]
            up["saved"] += node["saved"]
            up["below"].append(row)

    before: list | None = None
    for ids, conv_id, lens in rows:
        same = top
        if before is not None:
            most = min(len(ids), len(before))
            while same < most and ids[same] == before[same]:
                same += 1
            while len(stack) > same - top + 1:
                close()
        for depth in range(top + len(stack), len(ids) + 1):
            stack.append({"depth": depth, "len": lens[depth - 1], "n": 0, "least": conv_id, "children": 0,
                          "leaves": 0, "saved": 0, "ends": [], "below": []})
        node = stack[-1]
        node["ends"].append(conv_id)
        node["n"] += 1
        node["least"] = min(node["least"], conv_id)
        before = ids
    while stack:
        close()
    return out


def _swept(contained: DataFrame) -> DataFrame:
    """The nodes of all containers; ``above`` is set for the top node of each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        made: list[list] = []
        key = about = None

        def done() -> None:
            nonlocal held
            if held:
                nodes = sweep(held, about["at"], about["parent"])
                made.extend([*n, None] for n in nodes[:-1])
                made.append([*nodes[-1], about["above"]])
                held = []

        def batch_of(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), FIELDS, strict=True)],
                                              names=[n for n, _ in FIELDS])

        for batch in batches:
            for r in batch.to_pylist():
                if r["key"] != key:
                    done()
                    key, about = r["key"], r
                    if len(made) >= RUN:
                        yield batch_of(made)
                        made = []
                held.append((r["ids"], r["conv_id"], r["lens"]))
        done()
        if made:
            yield batch_of(made)

    return (contained.repartition("key").sortWithinPartitions("key", "ids", "conv_id")
            .mapInArrow(run, NODE + ", above array<string>"))


FIELDS = [("conv_id", pa.int64()), ("depth", pa.int32()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
          ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
          ("ends_sha256", pa.string()), ("above", pa.list_(pa.string()))]


def id_digests(ends: DataFrame) -> DataFrame:
    """key, ends_sha256: the digest of each key's ids, ascending, joined by commas.

    A key may hold any share of the rows: they are dealt by range of (key,
    conv_id) and joined into runs of RUN ids there; a key's runs are then fed
    to its digest one after the other.
    """
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def run_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"key": [key], "first": [ids[0]], "run": [",".join(map(str, ids))]})

        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (k != key or len(ids) >= RUN):
                    yield run_of()
                    ids = []
                key = k
                ids.append(c)
        if ids:
            yield run_of()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            for k, run in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key:
                    if state is not None:
                        yield pa.RecordBatch.from_pydict({"key": [key], "ends_sha256": [state.hexdigest()]})
                    key, state = k, hashlib.sha256(run.encode())
                else:
                    state.update(b"," + run.encode())
        if state is not None:
            yield pa.RecordBatch.from_pydict({"key": [key], "ends_sha256": [state.hexdigest()]})

    dealt = (ends.select("key", "conv_id").repartitionByRange("key", "conv_id")
             .sortWithinPartitions("key", "conv_id").mapInArrow(runs, "key string, first long, run string"))
    return (dealt.repartition("key").sortWithinPartitions("key", "first").select("key", "run")
            .mapInArrow(digest, "key string, ends_sha256 string"))


def nodes(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row for each distinct prefix of the conversations ``rows`` (conv_id, ids, lens).

    conv_id (least member), depth, parent_conv_id (null for the root),
    n_convs, n_children, n_leaves (childless nodes of the subtree, itself
    included), saved_tokens (sum over the subtree of n_convs - 1 times the code
    points of the node's last text), ends_sha256 (digest of the members that
    end there). A conversation without turns is a member of the root alone. No
    conversations: no rows. conv_id is unique in ``rows``.
    """
    rows = written(rows, "rebuilt")
    contained, heads, ends = burst(rows, limit)
    swept = written(_swept(contained), "swept")
    below = swept.where(F.col("above").isNotNull()).select(
        "above", "n_leaves", F.col("saved_tokens").alias("saved"))
    if heads is not None:
        # a burst container of equal sequences has nothing below it: it is a leaf itself
        branches = (swept.where(F.col("above").isNotNull()).select(F.element_at("above", -1).alias("key"))
                    .unionByName(heads.select(F.element_at("above", -1).alias("key"))).distinct()
                    .withColumn("branches", F.lit(True)))
        heads = heads.join(branches, "key", "left").withColumn("leaf", F.col("branches").isNull()).drop("branches")
        heads = written(heads, "all-heads")
        own = F.aggregate("lens", F.lit(0).cast("long"), lambda s, x: s + x) * (F.col("n_convs") - 1)
        below = below.unionByName(heads.select("above", F.col("leaf").cast("long").alias("n_leaves"),
                                               own.alias("saved")))
    sums = (below.select("n_leaves", "saved", F.size("above").alias("last"), F.posexplode("above").alias("i", "key"))
            .groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"),
                                F.count(F.when(F.col("i") == F.col("last") - 1, 1)).alias("n_children")))
    root = (rows.agg(F.count("conv_id").alias("n_convs"), F.min("conv_id").alias("conv_id"))
            .where(F.col("n_convs") > 0)
            .select(F.lit(ROOT).alias("key"), F.lit(0).alias("top"), F.lit(0).alias("end"),
                    F.array(F.lit(0)).alias("lens"), "n_convs", "conv_id", F.lit(None).cast("long").alias("parent"),
                    F.lit(False).alias("leaf")))
    every = written(root if heads is None else root.unionByName(heads.select(*root.columns)), "trie-heads")
    every = (every.join(sums, "key", "left").join(id_digests(ends), "key", "left")
             .fillna({"n_leaves": 0, "saved": 0, "n_children": 0})
             .fillna(NO_IDS, ["ends_sha256"]))
    depth, last = F.col("depth"), F.col("depth") == F.col("end")
    rest = F.aggregate(F.slice("lens", depth - F.col("top") + 1, F.col("end") - depth + 1),
                       F.lit(0).cast("long"), lambda s, x: s + x)
    of_heads = (every.withColumn("depth", F.explode(F.sequence("top", "end")))
                .select("conv_id", "depth", F.when(depth == F.col("top"), F.col("parent"))
                        .otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
                        F.when(last, F.col("n_children")).otherwise(1).cast("long").alias("n_children"),
                        F.greatest("n_leaves", F.lit(1)).alias("n_leaves"),
                        (F.col("saved") + rest * (F.col("n_convs") - 1)).alias("saved_tokens"),
                        F.when(last, F.col("ends_sha256")).otherwise(F.lit(NO_IDS)).alias("ends_sha256")))
    out = swept.drop("above").unionByName(of_heads)
    return out.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs",
                      "n_children", "n_leaves", "saved_tokens", "ends_sha256")
