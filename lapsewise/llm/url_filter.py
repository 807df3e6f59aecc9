"""URL filter: a blocked Bloom filter passes possible hits to an exact hash join.

The list holds canonical addresses (``host/path``) and prefixes of addresses
(``host/path-prefix``). A URL can only match its own address, or a prefix
whose host is one of its host's suffixes and whose path prefix has one of the
listed lengths, so its candidate keys are few. The keys go through a blocked
Bloom filter (one 64-bit block per key, ``probes`` bits in it), a table with a
row for each block; only keys that pass are joined with the list, and that
hash join removes the false positives. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsewise.llm.common import written

PROBES = 4
KEYS_PER_BLOCK = 4
#: Blocks of a filter that is broadcast (16 bytes a row); larger ones are joined by a shuffle.
BROADCAST_BLOCKS = 1 << 20
#: In front of the key of a whole address; no host can hold it.
WHOLE = "?"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; then the
    path up to ``?`` or ``#``. A null URL, or one without ``://``, has both empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    rest = F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, rest).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def block_of(key: Column, blocks) -> Column:
    return F.pmod(F.xxhash64(key), blocks)


def mask_of(key: Column) -> Column:
    """``PROBES`` bits of one 64-bit block, from a hash independent of the block's."""
    h = F.xxhash64(key, F.lit("bits"))
    mask = F.lit(0).cast("long")
    for i in range(PROBES):
        bit = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return mask


def listed_keys(listed: DataFrame, addresses: DataFrame | None) -> DataFrame:
    """key, plen (of a prefix, null for a whole address), rank, verdict: one row a key, the best said."""
    proper = listed.where("prefix is not null and host != '' and not host rlike '[/?#]'")
    keys = proper.select(F.concat("host", "prefix").alias("key"), F.length("prefix").alias("plen"),
                         F.struct("rank", "verdict").alias("said"))
    if addresses is not None:
        proper = addresses.where("path is not null and host != '' and not host rlike '[/?#]'")
        keys = keys.unionByName(proper.select(
            F.concat(F.lit(WHOLE), "host", "path").alias("key"), F.lit(None).cast("int").alias("plen"),
            F.struct("rank", "verdict").alias("said")))
    return (keys.groupBy("key", "plen").agg(F.max("said").alias("said"))
            .select("key", "plen", "said.rank", "said.verdict"))


def blocked_bloom(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter's blocks that have bits: block, word (64 bits)."""
    return (keys.select(block_of(F.col(key), F.lit(blocks)).alias("block"), mask_of(F.col(key)).alias("m"))
            .groupBy("block").agg(F.bit_or("m").alias("word")))


def judge(pages: DataFrame, listed: DataFrame, addresses: DataFrame | None = None, url: str = "url",
          default: str = "allow", broadcast_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """``pages`` plus host, path, entry and rank (of the listed entry that decides, else null), verdict.

    listed: ``host``, ``prefix`` (of the path, with its slash), ``verdict``,
    ``rank``; an entry fits its host and all subdomains where the path starts
    with the prefix. addresses: ``host``, ``path``, ``verdict``, ``rank``; an
    entry fits just this host and path. The highest rank wins, in it the
    longest entry, of equally long ones a block before an allow, then a prefix
    before an address, then by text. Without a fitting entry the verdict is ``default``.
    Repeated entries count once; null parts, an empty host, or one with ``/``, ``?`` or ``#`` fit nothing.
    Columns of ``pages`` that have a result's name are replaced by it.

    Verdicts are found once per distinct URL; AQE splits a URL that many pages
    share. The list is written once and its keys counted (one row to the
    driver, with the prefixes' lengths). A filter of at most ``broadcast_blocks``
    blocks is broadcast, a larger one joined by block.
    """
    keyed = written(listed_keys(listed, addresses), "listed")
    n, lengths = keyed.agg(F.count("key"), F.sort_array(F.collect_set("plen"))).first()
    blocks = max(1, -(-n // KEYS_PER_BLOCK))
    bloom = blocked_bloom(keyed, "key", blocks)
    if blocks <= broadcast_blocks:
        bloom = F.broadcast(bloom)
    host_u, path_u = split_url(F.col("__url"))
    labels = F.split(F.col("__h"), r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(
        F.filter(F.lit(lengths).cast("array<int>"), lambda k: k <= F.length("__p")),
        lambda k: F.substring(F.col("__p"), F.lit(1), k))
    fitting = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    whole = F.array(F.concat(F.lit(WHOLE), "__h", "__p"))
    hits = (pages.where(F.col(url).isNotNull()).select(F.col(url).alias("__url")).distinct()
            .withColumns({"__h": host_u, "__p": path_u}).where(F.col("__h") != "")
            .select("__url", F.explode(F.array_distinct(F.concat(fitting, whole))).alias("key"))
            .withColumns({"block": block_of(F.col("key"), F.lit(blocks)), "__mask": mask_of(F.col("key"))})
            .join(bloom, "block").where(F.col("word").bitwiseAND(F.col("__mask")) == F.col("__mask"))
            .join(keyed, "key")
            .select("__url", F.struct(
                "rank", F.length(F.ltrim(F.col("key"), F.lit(WHOLE))).alias("n"), "verdict",
                F.col("plen").isNotNull().alias("prefix"), "key").alias("hit"))
            .groupBy("__url").agg(F.max("hit").alias("__hit")))
    host, path = split_url(F.col(url))
    made = {"host": host, "path": path, "entry": F.ltrim(F.col("__hit.key"), F.lit(WHOLE)),
            "rank": F.col("__hit.rank"), "verdict": F.coalesce(F.col("__hit.verdict"), F.lit(default))}
    own = [F.col(f"`{c}`") for c in pages.columns if c not in made]
    return (pages.join(hits, pages[url] == hits["__url"], "left")
            .select(*own, *[value.alias(name) for name, value in made.items()]))
