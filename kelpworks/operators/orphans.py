"""References to records that do not exist.

A word-blocked Bloom filter of the parent keys is broadcast to the references, packed in rows of 1,024 words of 64 bits. It
grows with the parents up to a bound. What it denies is proven missing and needs no further
work; only filter-positive references go through the exact join with the parents' lives.

Skew: keys that hold more than one in `hot_share` of the references are fewer than `hot_share` by
construction; their references are salted and their parents copied to each salt, all others keep salt
0. Repeated rows are removed only from the orphans, which are few. A symbol with more than `most_lives` lives is not
brought together: its lives and references go through a distributed running maximum instead.

Defined cases: null and empty ids are no references; ids compare byte for byte; repeated rows are one
record; a null observed_at can show that an id is missing but no life can be denied, so nothing else is
reported for it (its day is null); a life without seen_at covers nothing but makes the id known; empty
tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F, types as T

from ..functions.ranks import running_max
from ..functions.skew import salted_join


def word_of(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(words)).cast("int")


def mask_of(key: Column, bits: int = 4) -> Column:
    """A long with up to `bits` of its 64 bits set, taken from a second hash."""
    h = F.xxhash64(F.lit(7919), key)
    mask = F.lit(0).cast("long")
    for i in range(bits):
        at = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at))
    return mask


def bloom_table(keys: DataFrame, column: str, words: int) -> DataFrame:
    """`word int, bits long`: at most `words` rows whatever the number of keys."""
    k = F.col(column)
    return keys.filter(k.isNotNull()).select(word_of(k, words).alias("word"), mask_of(k).alias("m")).groupBy("word").agg(F.bit_or("m").alias("bits"))


def bloom_blocks(keys: DataFrame, column: str, words: int) -> DataFrame:
    """`block long, bits array<long>` of 1,024 words each, packed for a broadcast: 8 bytes a word."""
    none = keys.sparkSession.range(words).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bits"))
    whole = bloom_table(keys, column, words).unionByName(none).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    placed = whole.groupBy(F.expr("word div 1024").alias("block")).agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("w"))
    return placed.select("block", F.transform("w", lambda x: x["bits"]).alias("bits"))


def references(edges: DataFrame, key: str = "edge_id", sides: tuple[tuple[str, str], ...] = (("from", "from_id"), ("to", "to_id")), at: str = "observed_at") -> DataFrame:
    """`edge_id, at, side, id`: one row per endpoint that refers to something."""
    pairs = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(c).alias("id")) for s, c in sides)))
    return edges.select(F.col(key).alias("edge_id"), F.col(at).alias("at"), pairs.alias("r")).select("edge_id", "at", "r.side", "r.id").filter("edge_id IS NOT NULL AND id IS NOT NULL AND id <> ''")


def orphan_references(edges: DataFrame, symbols: DataFrame, external: DataFrame, words: int | None = None, max_words: int = 1 << 24, hot_share: int = 200, salt: int = 16, most_lives: int = 64) -> DataFrame:
    """`edge_id, side, reason, day`: the references that name nothing existing at observed_at.

    words sizes the broadcast filter; left out, it follows the number of parent rows (6 a word, about 1 %
    false positives) up to max_words, which are 128 MB and serve 100 million parents. Beyond that bound more references are
    filter-positive and go through the exact join; the result is the same.
    """
    refs = references(edges)
    lives = symbols.select(F.col("symbol_id").alias("p_id"), "seen_at", "deleted_at").filter("p_id IS NOT NULL AND p_id <> ''")
    fixed = external.select(F.col("symbol_id").alias("p_id")).filter("p_id IS NOT NULL")
    if words is None:
        words = min(max_words, max(64, -(-(symbols.count() + external.count()) // 6)))
    bloom = F.broadcast(bloom_blocks(lives.select("p_id").unionByName(fixed), "p_id", words))
    bits = F.get("bits", F.col("word") % 1024)
    hit = F.coalesce(bits.bitwiseAND(mask_of(F.col("id"))) == mask_of(F.col("id")), F.lit(False))
    probe = refs.withColumn("word", word_of(F.col("id"), words)).withColumn("block", F.expr("word div 1024")).join(bloom, "block", "left").withColumn("maybe", hit)
    denied = probe.filter(~F.col("maybe")).select("edge_id", "side", F.lit("missing").alias("reason"), "at")

    # A parent is one row: its lives in an array if they are few, else only when the first of them ended.
    counts = lives.groupBy("p_id").agg(F.count(F.lit(1)).alias("n"), F.min("deleted_at").alias("ended_at"))
    many = counts.filter(F.col("n") > most_lives).select("p_id", "ended_at")
    kind = T.ArrayType(lives.select(F.struct("seen_at", "deleted_at").alias("l")).schema["l"].dataType)
    few = lives.join(counts.filter(F.col("n") <= most_lives).select("p_id"), "p_id", "left_semi")
    none, no_time = F.array().cast(kind), F.lit(None).cast(lives.schema["deleted_at"].dataType)
    every = (
        few.select("p_id", F.array(F.struct("seen_at", "deleted_at")).cast(kind).alias("l"), "deleted_at", F.lit(False).alias("ext"), F.lit(False).alias("later"))
        .unionByName(many.select("p_id", none.alias("l"), F.col("ended_at").alias("deleted_at"), F.lit(False).alias("ext"), F.lit(True).alias("later")))
        .unionByName(fixed.select("p_id", none.alias("l"), no_time.alias("deleted_at"), F.lit(True).alias("ext"), F.lit(False).alias("later")))
    )
    parents = every.groupBy("p_id").agg(F.flatten(F.collect_set("l")).alias("lives"), F.min("deleted_at").alias("ended_at"), F.max("ext").alias("always"), F.max("later").alias("later"))
    asked = probe.filter("maybe").select("edge_id", "side", "at", "id")
    # Hot keys are looked for among one in 16 of these references; which are taken for hot changes no result.
    some = asked.filter(F.pmod(F.xxhash64("edge_id", "side"), F.lit(16)) == 0)
    found = salted_join(asked, parents, "id", "p_id", spread_by="edge_id", counted=some, hot_share=hot_share, salt=salt)

    covers = F.exists("lives", lambda x: (x["seen_at"] <= F.col("at")) & (x["deleted_at"].isNull() | (x["deleted_at"] > F.col("at"))))
    reason = F.when(F.col("p_id").isNull(), "missing").when(F.coalesce(F.col("ended_at") <= F.col("at"), F.lit(False)), "deleted").otherwise("late")
    absent = F.col("p_id").isNull() | (~F.col("always") & ~F.col("later") & F.col("at").isNotNull() & ~F.coalesce(covers, F.lit(False)))
    verified = found.filter(absent).select("edge_id", "side", reason.alias("reason"), "at")
    late = _many_lives(refs.filter("at IS NOT NULL"), lives, many.join(fixed, "p_id", "left_anti"), words)
    return denied.unionByName(verified).unionByName(late).dropDuplicates(["edge_id", "side", "reason", "at"]).select("edge_id", "side", "reason", F.to_date("at").alias("day"))


def _many_lives(refs: DataFrame, lives: DataFrame, many: DataFrame, words: int) -> DataFrame:
    """`edge_id, side, reason, at`: the orphans among references to symbols with many lives.

    Lives and references of a symbol are put in order of time; a life covers a reference if the latest end of
    the lives begun by then lies after it. The order is kept in range partitions, so neither one
    symbol's lives nor its references come together in one task. A filter of the symbols' keys keeps all other
    references out before anything is shuffled.
    """
    bloom = F.broadcast(bloom_table(many, "p_id", words))
    close = F.col("bits").bitwiseAND(mask_of(F.col("id"))) == mask_of(F.col("id"))
    near = refs.withColumn("word", word_of(F.col("id"), words)).join(bloom, "word").filter(close).select("edge_id", "side", "at", "id")
    # An inner join (ids are unique): a semi-join would be pushed below the filter and shuffle all references.
    near = near.join(many.select(F.col("p_id").alias("id")), "id").dropDuplicates(["edge_id", "side", "at"])
    time = lives.schema["seen_at"].dataType
    far = F.lit("9999-12-31 00:00:00").cast(time)
    begun = lives.filter("seen_at IS NOT NULL").join(many.select("p_id"), "p_id", "left_semi")
    events = begun.select(F.col("p_id").alias("id"), F.col("seen_at").alias("at"), F.lit(0).alias("is_ref"), F.coalesce("deleted_at", far).alias("until"), F.lit(None).cast("long").alias("edge_id"), F.lit(None).cast("string").alias("side"))
    events = events.unionByName(near.select("id", F.col("at").cast(time).alias("at"), F.lit(1).alias("is_ref"), F.lit(None).cast(time).alias("until"), "edge_id", "side"))
    dated = running_max(events, ["id"], [F.col("at").asc(), F.col("is_ref").asc()], "until").filter("is_ref = 1 AND (running IS NULL OR running <= at)")
    ends = many.select(F.col("p_id").alias("e_id"), "ended_at")
    reason = F.when(F.col("ended_at") <= F.col("at"), "deleted").otherwise("late")
    return salted_join(dated.select("edge_id", "side", "id", "at"), ends, "id", "e_id", spread_by="edge_id", how="inner").select("edge_id", "side", reason.alias("reason"), "at")


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """`side, reason, day, n`: the report per endpoint, reason and day."""
    return orphans.groupBy("side", "reason", "day").agg(F.count(F.lit(1)).alias("n"))
