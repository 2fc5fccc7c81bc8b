"""Line dedup by distinct-site spread: lines that many sites share are boilerplate, and only their first place keeps them.

Each line's sites go into a HyperLogLog sketch; sketches of a line's hash merge by aggregation, before the shuffle
and after it. Lines whose estimate is near the threshold get an exact distinct count, so the outcome is that of
exact counting everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm import common

#: Distinct sites that make a line boilerplate, characters that a line needs to count, and the sketch's size (2^12 registers: 1.6 % error).
SITES, LEAST_CHARS, LG_K = 3, 20, 12
#: Estimates within this share of the threshold, or within one site, are counted exactly: some twelve standard errors. Sketches of a few sites are lists of them, which are short by one only where two of their hashes of 26 bits agree.
NEAR = 0.2
#: ASCII white space, which doesn't count around a line.
BLANK = " \t\n\r\x0b\x0c"


def _lines(df: DataFrame, text: str, site: str, least_chars: int) -> DataFrame:
    """Lines that count: their row's id and text hash, place, site, and two hashes of the line without white space around it."""
    key: list[Column] = [F.col("doc_id"), F.xxhash64(text).alias("th")]
    e = df.where(F.col(text).isNotNull()).select(*key, F.col(site).cast("string").alias("site"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    e = e.withColumn("line", F.btrim("line", F.lit(BLANK))).where(F.length("line") >= least_chars)
    return e.select("doc_id", "th", "pos", "site", F.xxhash64("line").alias("h"), F.hash("line").alias("g"))


def spread(lines: DataFrame, sites: int, near: float = NEAR) -> DataFrame:
    """h, g, n (places), first (smallest doc_id, text hash, position), and clear: true where the sketch alone tells that the line has `sites` sites.

    Lines whose estimate tells that they have fewer are left out.
    """
    place = F.struct("doc_id", "th", "pos")
    groups = lines.groupBy("h", "g").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min(place).alias("first"), F.count("*").alias("n"))
    groups = groups.where(F.col("n") >= sites).withColumn("spread", F.hll_sketch_estimate("sketch"))
    band = max(1.0, near * sites)
    return groups.where(F.col("spread") >= sites - band).select("h", "g", "n", "first", (F.col("spread") > sites + band).alias("clear"))


def copies(lines: DataFrame, sites: int) -> DataFrame:
    """doc_id, th, pos of lines that stand on at least `sites` sites, but for the first place of each.

    Lines are joined with the spread ones once; hot lines are split. Distinct sites are counted exactly on what the
    join leaves, for lines near the threshold only, each task adding up its own first.
    """
    groups = common.cut(spread(lines, sites))
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    met = common.cut(common.join_spread(lines, groups, ["h", "g"], "n", total, ["doc_id", "th", "pos"]))
    near = met.where(~F.col("clear"))
    exact = near.where(F.col("site").isNotNull()).select("h", "g", "n", "site").distinct().groupBy("h", "g", "n").agg(F.count("*").alias("sites")).where(F.col("sites") >= sites).drop("sites")
    place = ["doc_id", "th", "pos"]
    later = ~F.struct(*place).eqNullSafe(F.col("first"))
    counted = common.join_spread(near.where(later).select("h", "g", *place), common.cut(exact), ["h", "g"], "n", total, place)
    return met.where(F.col("clear") & later).select(place).unionByName(counted.select(place))


def dedup(df: DataFrame, site: str = "source", text: str = "text", sites: int = SITES, least_chars: int = LEAST_CHARS) -> DataFrame:
    """All columns of df, and n_lines, n_removed, cleaned: the text without boilerplate lines that stand elsewhere first.

    Lines end at \\n; of those with at least `least_chars` characters between ASCII white space, the ones on `sites` or
    more distinct sites stay only at their first place: smallest doc_id (null first), text hash, position. A null
    site is none. A null text has no lines and stays null; an empty one has one line. Rows that repeat doc_id and
    text are treated alike. An empty table gives no rows. df's columns of the names above are replaced.
    """
    df = df.drop("n_lines", "n_removed", "cleaned")
    gone = copies(_lines(df, text, site, least_chars), sites)
    gone = gone.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("gone")).select(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_th"), "gone")
    full = df.withColumn("gone_key", F.xxhash64(text))
    full = full.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("gone_key") == F.col("gone_th")), "left")
    parts = F.split(text, "\n", -1)
    kept = F.filter(F.transform(parts, lambda x, i: F.when(~F.array_contains("gone", i), x)), lambda x: x.isNotNull())
    cleaned = F.when(F.col("gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    removed = F.coalesce(F.size("gone"), F.lit(0))
    return full.select(
        *df.columns, F.when(F.col(text).isNull(), 0).otherwise(F.size(parts)).cast("bigint").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(removed).cast("bigint").alias("n_removed"), cleaned.alias("cleaned"),
    )
