"""Mixing sources to target weights with DataFrame operations only.

Sources' targets come from weighted shares of all words with a ceiling per source (water filling in closed form over
the sorted ratios ceiling / weight). Sainte-Lague then turns targets into whole numbers of equal-token blocks: first
blocks per source, then each source's blocks per range of shards, then each range's blocks per shard, so that no task
sees more of a hot source than a table of ranges or the shards of one range. Within a shard the documents stand in a seeded order, their
words laid end to end and cut into blocks; the first blocks are taken, as many as the shard's quota, going round again
when the quota is more than the shard holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, drop_table, finished, marked, materialize


def sainte_lague(df: DataFrame, group: list[str], key: list[str], votes: str, seats: str, out: str) -> DataFrame:
    """Add `out`: the seats that each row gets when its group's `seats` go one by one to the highest votes / (2k + 1).

    No quotient below the certain ones is ever laid out: with n rows in a group the divisor lies between total /
    (seats + n / 2) and total / (seats - n / 2), which leaves fewer than 3n seats open. Ties go by key order.
    """
    own = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    n, total = F.count("*").over(own), F.sum(votes).over(own)
    share = lambda m: F.when(F.col("_t") > 0, F.col(votes) * m / F.col("_t")).otherwise(F.lit(0.0))
    sure = F.greatest(F.lit(0), F.ceil(share(F.col(seats) - F.col("_n") / 2) - 0.5)).cast("long")
    most = F.greatest(F.col("_sure"), F.floor(share(F.col(seats) + F.col("_n") / 2) + 0.5).cast("long"))
    base = df.withColumn("_n", n).withColumn("_t", total).withColumn("_sure", sure).withColumn("_most", most)
    base = base.withColumn("_open", F.when(F.col("_t") > 0, F.col(seats) - F.sum("_sure").over(own)).otherwise(F.lit(0)))
    rank = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy(F.col("_q").desc(), *key, "_k")
    won = (
        base.filter("_most > _sure")
        .select(*group, *key, votes, "_open", F.explode(F.sequence("_sure", F.col("_most") - 1)).alias("_k"))
        .withColumn("_q", F.col(votes) / (2 * F.col("_k") + 1))
        .withColumn("_rank", F.row_number().over(rank))
        .filter("_rank <= _open")
        .groupBy(*group, *key).agg(F.count("*").alias("_won"))
    )
    return base.join(won, [*group, *key], "left").withColumn(out, F.col("_sure") + F.coalesce("_won", F.lit(0))).drop("_n", "_t", "_sure", "_most", "_open", "_won")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), ceiling: int = 3) -> DataFrame:
    """(key, source, source_size) rows with target added: weights repeat over the sources in code point order, null last.

    A source stands at its ceiling if ceiling * size / weight is at most the water level; the level is what the ceilings
    below leave of all words, over the weights that remain.
    """
    one = Window.partitionBy(F.lit(0))
    by_name = one.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    )
    cap = F.lit(ceiling) * F.col("source_size")
    ranked = ranked.withColumn("cap", cap.cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = one.orderBy("ratio", "rank")
    left = F.sum("source_size").over(one) - F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levelled = ranked.withColumn("level", left / rest).withColumn("pos", F.row_number().over(by_ratio))
    first = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("pos", "level"))).over(one)
    return levelled.withColumn("free", first).withColumn(
        "target", F.when(F.col("free").isNull() | (F.col("pos") < F.col("free.pos")), F.col("cap")).otherwise(F.col("weight") * F.col("free.level"))
    ).select("key", "source", "source_size", "n_rows", "target")


def _key(source_col: str) -> Column:
    """A source's name as a value that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit(""))


def _place(seed: int, id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))


def _shard(place: str, shards: str) -> Column:
    return F.pmod(F.xxhash64(place), F.col(shards))


def _copies(taken: Column, size: Column) -> Column:
    return F.floor(F.try_divide(taken, size) + 0.5).cast("int")


def _laid_out(docs: DataFrame, weights: tuple[int, ...], ceiling: int, seed: int, block: int, rows_per_shard: int, shards_per_range: int, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, list[DataFrame]]:
    """Every document's row in its shard's order, with what the mix takes of it, and the written tables that this reads.

    id, source, key, place, shard, size, source_size, target, rounds (how often the shard's documents are taken whole),
    rest (the words that the last round still has to take when it comes to the document), taken.
    """
    sized = materialize(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            _key(source_col).alias("key"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            _place(seed, id_col, text_col).alias("place"),
        ),
        "mix-sizes", docs,
    )
    sizes = sized.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    targets = source_targets(sizes, weights, ceiling)
    targets = targets.withColumn("all_seats", F.round(F.sum("source_size").over(Window.partitionBy(F.lit(0))) / block).cast("long"))
    sources = sainte_lague(targets, [], ["key"], "target", "all_seats", "seats").drop("source", "all_seats")
    sources = materialize(sources.withColumn("shards", F.ceil(F.col("n_rows") / rows_per_shard)), "mix-sources", sized)
    rows = sized.join(sources, "key").withColumn("shard", _shard("place", "shards")).withColumn("range", F.floor(F.col("shard") / shards_per_range))
    shards = materialize(rows.groupBy("key", "range", "shard").agg(F.sum("size").alias("words"), F.first("seats").alias("all_seats")), "mix-shards", sized)
    ranges = shards.groupBy("key", "range").agg(F.sum("words").cast("double").alias("votes"), F.first("all_seats").alias("all_seats"))
    ranges = sainte_lague(ranges, ["key"], ["range"], "votes", "all_seats", "seats").select("key", "range", "seats")
    voted = shards.drop("all_seats").join(ranges, ["key", "range"]).withColumn("votes", F.col("words").cast("double"))
    quotas = (
        sainte_lague(voted, ["key", "range"], ["shard"], "votes", "seats", "quota")
        .withColumn("take", F.least(F.col("quota") * block, F.lit(ceiling) * F.col("words")))
        .select("key", "shard", "words", "take")
    )
    quotas = materialize(quotas, "mix-quotas", shards)
    laid = Window.partitionBy("key", "shard").orderBy("place", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rounds = F.when(F.col("words") > 0, F.floor(F.col("take") / F.col("words"))).otherwise(F.lit(0))
    rest = F.col("take") - F.col("rounds") * F.col("words") - F.coalesce(F.sum("size").over(laid), F.lit(0))
    taken = F.col("rounds") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest")))
    laid_out = rows.join(quotas, ["key", "shard"]).withColumn("rounds", rounds).withColumn("rest", rest).withColumn("taken", taken.cast("long"))
    return laid_out, [sized, sources, shards, quotas]


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), ceiling: int = 3, seed: int = 7, block: int = 1, rows_per_shard: int = 512, shards_per_range: int = 1024,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """How many words the mix takes of every document: id, source, size, source_size, target, taken.

    size is the number of words (null text: 0); taken is at most ceiling * size, repeats counted, and may end inside
    one document of a shard. A source's taken words are its quota of blocks of `block` words, within half a block of its
    target; the work does not depend on the number of blocks. A null source is a source; sources without words take
    none; equal rows are interchangeable; an empty table gives no rows. Other columns are not read, whatever their
    names. The same rows and seed give the same mix, whatever their order and partitioning. Sources themselves, one row
    each, are ranked in one task.
    """
    rows, used = _laid_out(docs, weights, ceiling, seed, block, rows_per_shard, shards_per_range, id_col, text_col, source_col)
    taken = rows.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "taken")
    return finished(taken, "mix-taken", *used)


def mixed_copies(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), ceiling: int = 3, seed: int = 7, block: int = 1, rows_per_shard: int = 512, shards_per_range: int = 1024,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """docs as often as the mix takes them: taken / size, rounded, of `mix_sources`; none of what it leaves out.

    Only one document of a shard is taken in part, so rounding moves a source by under half a document a shard. Rows
    that share an id and a source are copied alike, by the sum of what is taken of them; null ids and sources are values
    here. A text without words has no copy to take. An empty table gives no rows.

    Texts stay where they are read: how often a document is taken follows from its place and that of the document at
    which its shard's last round ends, and a shard has a row of a small table, which is broadcast: one for about
    `rows_per_shard` documents, and one a source at least. Only rows whose id stands more than once in a source, and few
    others, are shuffled to be told apart.
    """
    rows, used = _laid_out(docs, weights, ceiling, seed, block, rows_per_shard, shards_per_range, id_col, text_col, source_col)
    sized, sources = used[:2]
    rows = materialize(rows.select("id", "source", "key", "place", "shard", "size", "rounds", "rest", "taken"), "mix-laid", sized)
    last = F.min(F.when(F.col("rest") < F.col("size"), F.struct(F.struct("place", "id").alias("at"), _copies(F.col("taken"), F.col("size")).alias("copies")))).alias("last")
    ends = materialize(rows.groupBy("key", "shard").agg(F.first("rounds").alias("rounds"), last), "mix-ends", *used[2:])
    again = rows.groupBy("id", "source").agg(F.count("*").alias("n"), _copies(F.sum("taken"), F.sum("size")).alias("copies")).filter("n > 1").drop("n")
    again = materialize(again, "mix-repeated", sized)
    repeated = materialize(again.select("id").distinct(), "mix-repeated-ids", again)
    drop_table(rows, sized, *used[2:])

    own = docs.select(*docs.columns, _place(seed, id_col, text_col).alias("_place"), _key(source_col).alias("_key"))
    placed = own.join(F.broadcast(sources.select(F.col("key").alias("_key"), F.col("shards").alias("_shards"))), "_key").withColumn("_shard", _shard("_place", "_shards"))
    ends = ends.select(*(F.col(c).alias(f"_{c}") for c in ends.columns))
    found = placed.join(F.broadcast(ends), ["_key", "_shard"])
    here = F.struct(F.col("_place").alias("place"), F.col(id_col).alias("id"))
    times = F.when(here < F.col("_last.at"), F.col("_rounds") + 1).when(here == F.col("_last.at"), F.col("_last.copies")).otherwise(F.col("_rounds"))
    told = found.select(*docs.columns, F.when(F.col(text_col).rlike(WORD), times).otherwise(0).cast("int").alias("_copies"))
    told = marked(told, id_col, repeated, "_again")
    some, named = told.filter("_again"), again.withColumnsRenamed({c: f"_{c}_again" for c in again.columns})
    same = [some[id_col].eqNullSafe(named["_id_again"]), some[source_col].eqNullSafe(named["_source_again"])]
    some = some.join(named, same, "left").withColumn("_copies", F.coalesce("_copies_again", "_copies"))
    both = told.filter("not _again").select(*docs.columns, "_copies").unionByName(some.select(*docs.columns, "_copies")).filter("_copies > 0")
    return both.select(*docs.columns, F.explode(F.sequence(F.lit(1), "_copies")).alias("_copies")).drop("_copies")
