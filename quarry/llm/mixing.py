"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

All words make a house of blocks of equal numbers of words. Its blocks go to sources by the
highest quotients target / (2 k + 1), and a source's blocks go to its shards by the highest
quotients size / (2 k + 1), so each shard has a whole number of blocks. In a shard documents lie
end to end in seeded order; every block is taken once for each full pass of the quota, the rest
are the blocks from a seeded start on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import text as T
from quarry.llm.common import FEW, beside, column, cut, own_names, partitions

#: Words in a block, about how many in a shard, and equal rows that are dealt at once.
BLOCK, SHARD, EQUAL = 16, 1 << 18, 100_000
WEIGHTS, MOST = (5.0, 2.0, 1.0), 3
#: Divisors tried at once in a pass, and passes at most.
TRIED, PASSES = 24, 10


def gathered(df: DataFrame) -> tuple[DataFrame, bool]:
    """df, cut, and whether it has few rows: then in one partition, so that nothing is shuffled to group or join them."""
    df = cut(df)
    few = df.count() <= FEW
    return (df.coalesce(1) if few else df), few


def numbered(df: DataFrame, *keys: Column, parts: int) -> DataFrame:
    """df with n: each row's place by the keys, from 0. Rows are ranked in their ranges, then ranges added up."""
    spread = cut(df.repartitionByRange(parts, *keys).withColumn("__p", F.spark_partition_id()))
    sizes = spread.groupBy("__p").agg(F.count("*").alias("__c"))  # a row for each partition
    before = F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("__p", F.coalesce(before, F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__p").orderBy(*keys)) - 1
    return spread.withColumn("__r", place).join(F.broadcast(sizes), "__p").withColumn("n", F.col("__r") + F.col("__before")).drop("__p", "__r", "__before")


def with_targets(sources: DataFrame) -> DataFrame:
    """sources (source, source_size, any others) with target: weights repeat over sources by code point, null last.

    Targets share all words by weight; one over MOST times its source's size stops there, and
    the excess is shared again by weight among the others until none is over.
    """
    sources, few = gathered(sources)
    place = numbered(sources, F.col("source").asc_nulls_last(), parts=1 if few else partitions(sources.sparkSession))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("n") % len(WEIGHTS) + 1).cast("int"))
    table = cut(place.withColumn("w", weight).drop("n"))
    total, level, capped = float(table.agg(F.sum("source_size")).first()[0] or 0), None, -1
    while True:  # more sources are capped in each round
        full = F.lit(False) if level is None else F.lit(level) * F.col("w") > MOST * F.col("source_size")
        n, taken, free = table.agg(F.sum(full.cast("long")), F.sum(F.when(full, MOST * F.col("source_size")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("w")))).first()
        if not free or n == capped:
            break
        capped, level = n, (total - float(taken)) / free
    return table.withColumn("target", F.least((MOST * F.col("source_size")).cast("double"), F.lit(level or 0.0) * F.col("w"))).drop("w")


def _seats(divisor: Column) -> Column:
    """Quotients votes / (2 k + 1) that are at least half the divisor, of a unit that takes `most` seats."""
    return F.least(F.col("most"), F.floor(F.col("votes") / divisor + 0.5).cast("long"))


def apportioned(units: DataFrame, houses: DataFrame) -> DataFrame:
    """(key, unit, quota): the seats of each key's house by the highest quotients votes / (2 k + 1).

    units: (key, unit, votes, most), a unit taking `most` seats at most; houses: (key, house).
    Equal quotients are served by unit. Each pass tries divisors for all keys at once and narrows
    the range in which the last seat's is; the few quotients in the range are then ranked, over
    tasks. No task gets a key's units together.
    """
    units, few = gathered(units)
    houses, _ = gathered(houses)
    by = F.xxhash64("unit")
    table = units.groupBy("key").agg(F.sum("votes").alias("votes"), F.count("*").alias("n"), F.max("votes").alias("top")).join(houses, "key")
    low = F.least(F.col("votes") / (F.col("house") + F.col("n") / 2 + 1), F.lit(0.5))  # all seats or more are won
    table = cut(table.select("key", "house", low.alias("lo"), (2.0 * F.col("top") + 1.0).alias("hi"), "n").where("house > 0 and lo > 0"))
    for _ in range(PASSES):
        tried = F.transform(F.sequence(F.lit(0), F.lit(TRIED)), lambda j: F.col("lo") * F.pow(F.col("hi") / F.col("lo"), j / TRIED))
        sums = [F.sum(_seats(F.col("tried")[j])).alias(f"s{j}") for j in range(TRIED + 1)]
        won = beside(units, table.withColumn("tried", tried), "key", by).groupBy("key", "house", "tried", "n").agg(*sums)
        # at the lesser of two divisors the house is full, at the greater one it isn't yet
        full = F.size(F.filter(F.array(*[f"s{j}" for j in range(1, TRIED)]), lambda x: x >= F.col("house")))
        won = won.withColumn("at", full).withColumn("sums", F.array(*[f"s{j}" for j in range(TRIED + 1)]))
        table = cut(won.select("key", "house", "n", F.get("tried", "at").alias("lo"), F.get("tried", F.col("at") + 1).alias("hi"), (F.get("sums", "at") - F.get("sums", F.col("at") + 1)).alias("open")))
        if table.where(F.col("open") > TRIED * F.col("n")).isEmpty():
            break
    # one quotient more on either side, for what rounding of the divisors may have cost
    sure = F.greatest(_seats(F.col("hi")) - 1, F.lit(0))
    both = cut(beside(units, table, "key", by).select("key", "unit", "votes", "house", sure.alias("sure"), F.least(F.col("most"), _seats(F.col("lo")) + 1).alias("upto")))
    need = both.groupBy("key", "house").agg(F.sum("sure").alias("given")).select("key", (F.col("house") - F.col("given")).alias("need"))
    seats = both.where("upto > sure").withColumn("seat", F.explode(F.sequence("sure", F.col("upto") - 1)))
    quotient = (F.col("votes") / (2 * F.col("seat") + 1)).alias("quotient")
    placed = numbered(seats.select("key", "unit", "seat", quotient), F.col("key"), F.col("quotient").desc(), F.col("unit"), F.col("seat"), parts=1 if few else partitions(units.sparkSession))
    first = cut(placed.groupBy("key").agg(F.min("n").alias("first")).join(need, "key"))
    won = beside(placed, first, "key", by).where(F.col("n") - F.col("first") < F.col("need")).groupBy("key", "unit").agg(F.count("*").alias("more"))
    mine = units.select("key", "unit").join(both.select("key", "unit", "sure"), ["key", "unit"], "left").join(won, ["key", "unit"], "left")
    return mine.select("key", "unit", (F.coalesce("sure", F.lit(0)) + F.coalesce("more", F.lit(0))).cast("long").alias("quota"))


def _most(size: Column) -> Column:
    """Blocks that MOST times a size makes, the last one perhaps in part."""
    return F.ceil(MOST * size / BLOCK).cast("long")


def _told(text_col: str, source_col: str) -> Column:
    """Tells documents of one id apart."""
    return F.xxhash64(F.coalesce(column(text_col), F.lit("")), F.coalesce(F.concat(F.lit("s"), column(source_col).cast("string")), F.lit("null")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """(doc_id, size, source_size, target, taken, th, nth, passes, parts) for each document.

    size: words of the text (null or empty: 0). taken: words that the mix takes of the document,
    repeats counted, at most MOST times its size: all of them `passes` times, and those of the
    ranges (lo, hi) of `parts` once more. A null source is a source, the last; a null id stays
    null. Repeated rows are different documents, told apart by nth, from 0; th is a hash of text
    and source. Other columns are ignored; with no words at all, targets are 0.
    """
    equal = docs.select(
        column(id_col).alias("doc_id"),
        column(source_col).cast("string").alias("source"),
        F.coalesce(T.n_words(column(text_col)), F.lit(0)).cast("long").alias("size"),
        _told(text_col, source_col).alias("th"),
    ).groupBy("doc_id", "source", "size", "th").agg(F.count("*").alias("n"))
    some = equal.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / EQUAL)))).repartition(partitions(docs.sparkSession), "th", "doc_id", "part")
    each = some.withColumn("nth", F.explode(F.sequence(F.col("part") * EQUAL, F.least("n", (F.col("part") + 1) * EQUAL) - 1)))
    rows = cut(
        each.select(
            "doc_id", "source", "size", "th", "nth",
            F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")).alias("key"),
            F.xxhash64(F.lit(seed), "doc_id", "th", "nth").alias("h"),
        )
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    sources, _ = gathered(with_targets(sizes).withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))))
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"))
    house = total.select(F.lit("all").alias("key"), F.floor((F.col("total") + BLOCK // 2) / BLOCK).alias("house"))
    blocks = apportioned(sources.select(F.lit("all").alias("key"), F.col("key").alias("unit"), F.col("target").alias("votes"), _most(F.col("source_size")).alias("most")), house)
    n_shards = F.greatest(F.ceil((F.col("source_size") + F.col("n_docs")) / SHARD), F.lit(1)).cast("long")
    dealt = beside(rows, sources.select("key", "source_size", "target", n_shards.alias("n_shards")), "key", F.col("h")).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "h"), "n_shards"))
    shards, _ = gathered(dealt.groupBy("key", "shard").agg(F.sum("size").alias("shard_size")))
    votes = shards.select("key", F.col("shard").alias("unit"), F.col("shard_size").cast("double").alias("votes"), _most(F.col("shard_size")).alias("most"))
    quotas = apportioned(votes, blocks.select(F.col("unit").alias("key"), F.col("quota").alias("house")))
    quotas = shards.join(quotas.withColumnRenamed("unit", "shard"), ["key", "shard"])
    line = Window.partitionBy("key", "shard").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("lo", F.coalesce(F.sum("size").over(line), F.lit(0))).join(quotas, ["key", "shard"])
    n_blocks = F.greatest(F.ceil(F.col("shard_size") / BLOCK), F.lit(1)).cast("long")
    start = F.pmod(F.xxhash64(F.lit(seed + 2), "key", "shard"), n_blocks)
    placed = placed.withColumns({"passes": F.least(F.floor(F.col("quota") / n_blocks), F.lit(MOST)).cast("long"), "more": F.col("quota") % n_blocks, "first": start, "n_blocks": n_blocks})

    def within(lo: Column, hi: Column) -> Column:
        """The document's words in these blocks of its shard, as a range."""
        a = F.greatest(lo * BLOCK - F.col("lo"), F.lit(0))
        return F.struct(a.cast("long").alias("lo"), F.greatest(a, F.least(hi * BLOCK - F.col("lo"), F.col("size"))).cast("long").alias("hi"))

    end = F.col("first") + F.col("more")
    ranges = F.array(within(F.lit(0), end - F.col("n_blocks")), within(F.col("first"), F.least(end, F.col("n_blocks"))))
    placed = placed.withColumn("parts", F.when(F.col("passes") < MOST, F.filter(ranges, lambda r: r["hi"] > r["lo"])).otherwise(F.slice(ranges, 1, 0)))
    taken = F.col("passes") * F.col("size") + F.aggregate("parts", F.lit(0).cast("long"), lambda a, r: a + r["hi"] - r["lo"])
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "th", "nth", "passes", "parts")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """The mix itself, with the columns of docs: whole copies, and of a part the words drawn.

    A document of which no word is taken goes. Copies keep the id; a part keeps the white space
    between its words; n_chars, if there is such a column, follows the text. Repeated rows, null
    ids and null sources are as in mix().
    """
    a, b, c, d, e, f, g, k = own_names(docs, "own_id", "own_th", "own_nth", "mix_id", "mix_th", "mix_nth", "mix_take", "mix_copy")
    plan = mix(docs, id_col, text_col, source_col, seed).where("taken > 0")
    takes = plan.select(F.col("doc_id").alias(d), F.col("th").alias(e), F.col("nth").alias(f), F.struct("passes", "parts").alias(g))
    rows = docs.withColumns({a: column(id_col), b: _told(text_col, source_col)})
    rows = rows.withColumn(c, (F.row_number().over(Window.partitionBy(a, b).orderBy(F.lit(0))) - 1).cast("long"))  # equal rows take theirs in turn
    both = rows.join(takes, F.col(a).eqNullSafe(F.col(d)) & (F.col(b) == F.col(e)) & (F.col(c) == F.col(f)))
    drawn = F.size(f"{g}.parts") > 0
    copies = both.withColumn(k, F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{g}.passes") + drawn.cast("long"))))
    # each word with the white space after it
    pieces = F.split(F.regexp_replace(column(text_col), "^[\\x20\\x09-\\x0D]+", ""), "(?<=[\\x20\\x09-\\x0D])(?=[^\\x20\\x09-\\x0D])")
    cuts = F.transform(f"{g}.parts", lambda r: F.array_join(F.slice(pieces, (r["lo"] + 1).cast("int"), (r["hi"] - r["lo"]).cast("int")), ""))
    text = F.when(F.col(k) <= F.col(f"{g}.passes"), column(text_col)).otherwise(F.array_join(cuts, " "))
    out = {text_col: text} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in docs.columns else {})
    return copies.select(*[out[x].alias(x) if x in out else column(x) for x in docs.columns])
