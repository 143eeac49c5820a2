"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words. A source whose target is r times its size takes floor(r) certain whole
copies of every document, and for the rest a Pareto order sample of unequal probabilities: a document's inclusion
probability is min(1, c x), where x, its measure, is the bit length of its size, so that long documents are likelier
than short ones, and c is the source's, such that the words expected are those that are left of the target. The
documents are ranked by the odds of a uniform number over the odds of their inclusion (certain ones first), and the
lowest ranks are taken until the words reach what is left. The uniform number comes from a keyed digest of the id, so
that reruns agree.

No source is ever sorted in one task: the rank is a 60-bit integer, the words are summed by its leading digits with a
map-side combine, and only the digit in which a source's sum crosses its target is looked at more closely.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basaltine.llm.scratch import saved
from basaltine.llm.words import n_words, whole

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: The mix has this many times the words of its input, and takes no document more often than this.
TOTAL, MOST = 1.5, 2
#: Bits of a rank, and of one digit of it.
RANK_BITS, DIGIT_BITS = 60, 12


def numbered(df: DataFrame, by: str) -> DataFrame:
    """``df`` with ``number``, its place (from 0) in the order of ``by``, nulls last, found without one sorting task."""
    local = F.monotonically_increasing_id()
    parts = saved(
        df.repartitionByRange(F.col(by).asc_nulls_last()).sortWithinPartitions(F.col(by).asc_nulls_last()).select("*", F.shiftright(local, 33).alias("__part"), local.bitwiseAND(F.lit((1 << 33) - 1)).alias("__at"))
    )
    # a row per partition of the sort
    counts = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return parts.join(before, "__part").select(*df.columns, (F.col("__before") + F.col("__at")).alias("number"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """sizes (source, source_size) with ``target``: shares by weight, held to ``most`` times the size.

    What a source cannot take is shared again by weight among the others, until no target is above its bound.
    """
    ranked = numbered(sizes, "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    ranked = saved(ranked.select("source", "source_size", weight.alias("weight")))
    bound = F.col("source_size") * F.lit(float(most))
    per_weight = None
    everything = (ranked.agg(F.sum("source_size")).first()[0] or 0) * total
    while True:
        full = F.lit(False) if per_weight is None else F.col("weight") * F.lit(per_weight) > bound
        held, rest, n = ranked.agg(F.sum(F.when(full, bound)), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if not rest:
            per_weight = float("inf")
            break
        now = (everything - (held or 0.0)) / rest
        if now == per_weight:
            break
        per_weight = now
    share = F.col("weight") * F.lit(per_weight)
    return ranked.select("source", "source_size", F.when((share > bound) | (F.col("weight") == 0), bound).otherwise(share).alias("target"))


def uniform(doc_id: Column, seed: str, other: Column) -> Column:
    """A number above 0 and below 1 that follows from the seed and the id, or of a null id ``other`` (52 bits of an MD5 digest)."""
    digest = F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(doc_id.cast("string"), F.concat(F.lit(":"), other))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def pareto_rank(u: Column, p: Column) -> Column:
    """The place of the Pareto key q = odds(u) / odds(p), from 0 to 1: q / (1 + q) rises with q; 0 where p is 1."""
    q = (u / (1 - u)) * (F.lit(1.0) - p) / p
    return F.when(p >= 1, F.lit(0.0)).otherwise(q / (1 + q))


def measure(size: Column) -> Column:
    """What inclusion is proportional to: the bit length of the size."""
    return F.length(F.bin(size)).cast("long")


def inclusion(classes: DataFrame) -> DataFrame:
    """classes (source, x, words, need) with ``p``, the inclusion probability of documents of measure x.

    The c of a source is the first (classes in falling order of x) for which no further class would be over 1: those
    before it are certain. A source has as many classes as its sizes have bit lengths.
    """
    falling = Window.partitionBy("source").orderBy(F.desc("x"))
    before = F.coalesce(F.sum("words").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("x") * F.col("words")).over(falling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    tried = classes.select("*", F.try_divide(F.col("need") - before, rest).alias("c"))
    good = F.max(F.struct("x", "c")).alias("top")
    scale = tried.where(F.col("c") * F.col("x") <= 1).groupBy(F.col("source").alias("s")).agg(good)
    joined = classes.join(scale, F.col("source").eqNullSafe(F.col("s")), "left")
    return joined.select("source", "x", "words", "need", F.coalesce(F.when(F.col("x") > F.col("top.x"), 1.0).otherwise(F.least(F.col("top.c") * F.col("x"), F.lit(1.0))), F.lit(1.0)).alias("p"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix-1") -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, inclusion, copies, taken.

    ``size`` is the number of words (null text: 0), ``copies`` how often the mix takes the document (0 to 2) and
    ``taken`` its words. Documents without words are never needed to reach a target; they take the certain copies
    only. ``inclusion`` is the probability of one more copy than the certain ones. Ranks that tie (repeated ids, or
    equal texts without one) are told apart by a row number. A null source is a source of its own, the last
    in the order. An empty table gives no rows; other columns of ``docs`` are neither read nor returned.
    """
    tie = F.md5(whole(text))
    rows = saved(docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(whole(text)).alias("size"), F.when(F.col(doc_id).isNull(), tie).alias("tie")))
    rows = rows.withColumn("x", measure(F.col("size")))
    classes = saved(rows.groupBy("source", "x").agg(F.sum("size").alias("words")))
    targets = source_targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")))
    rate = F.try_divide(F.col("target"), F.col("source_size"))
    targets = targets.select("source", "source_size", "target", F.coalesce(F.floor(rate).cast("int"), F.lit(0)).alias("whole"), F.coalesce(rate - F.floor(rate), F.lit(0.0)).alias("part"))
    targets = saved(targets.select(F.col("source").alias("s"), "source_size", "target", "whole", (F.col("part") * F.col("source_size")).alias("need")))
    sampled = classes.join(targets.where("need > 0"), F.col("source").eqNullSafe(F.col("s")))
    odds = inclusion(sampled.select("source", "x", "words", "need")).select("source", "x", "p")
    facts = classes.select("source", "x").join(targets, F.col("source").eqNullSafe(F.col("s"))).select("s", F.col("x").alias("c"), "source_size", "target", "whole")
    odds = odds.select(F.col("source").alias("o"), F.col("x").alias("ox"), "p")
    facts = saved(facts.join(odds, F.col("s").eqNullSafe(F.col("o")) & (F.col("c") == F.col("ox")), "left").select("s", "c", "source_size", "target", "whole", "p"))
    steps = F.lit(float(1 << RANK_BITS))
    u = uniform(F.col("doc_id"), seed, F.col("tie"))
    rank = F.when(F.col("p").isNotNull(), F.least((pareto_rank(u, F.col("p")) * steps).cast("long"), F.lit((1 << RANK_BITS) - 1)))
    ranked = rows.join(facts, F.col("source").eqNullSafe(F.col("s")) & (F.col("x") == F.col("c")))
    ranked = saved(ranked.select("row", "doc_id", "source", "size", "source_size", "target", "whole", "p", rank.alias("rank")))
    # the digits before the one where a source crosses its need, and the words below them
    edge = targets.where("need > 0").select("s", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"), "need")
    for shift in range(RANK_BITS - DIGIT_BITS, -1, -DIGIT_BITS):
        inside = ranked.where("rank is not null").join(edge, ranked["source"].eqNullSafe(edge["s"]) & (F.shiftright("rank", shift + DIGIT_BITS) == F.col("prefix")))
        digits = inside.groupBy("s", "prefix", "below", edge["need"], F.shiftright("rank", shift).alias("digit")).agg(F.sum("size").alias("n"))
        # at most two to DIGIT_BITS rows a source
        order = Window.partitionBy("s").orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        upto = digits.withColumn("upto", F.col("below") + F.sum("n").over(order))
        last = upto.groupBy("s").agg(F.max("digit").alias("last"))
        crossing = upto.where("upto >= need").groupBy("s", "need").agg(F.min(F.struct("digit", "upto", "n")).alias("x"))
        edge = saved(crossing.select("s", F.col("x.digit").alias("prefix"), (F.col("x.upto") - F.col("x.n")).alias("below"), "need"))
    # rows of one rank (copies of one id): whole ranks below, then the rows at the crossing one by one
    tied = ranked.where("rank is not null and size > 0").join(edge, ranked["source"].eqNullSafe(edge["s"]) & (F.col("rank") == F.col("prefix")))
    order = Window.partitionBy("s").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    at_edge = tied.withColumn("before", F.col("below") + F.coalesce(F.sum("size").over(order), F.lit(0))).where(F.col("before") + F.col("size") / 2.0 <= edge["need"])
    at_edge = saved(at_edge.select(F.col("row").alias("edge_row")))
    out = ranked.join(edge.select("s", "prefix"), ranked["source"].eqNullSafe(F.col("s")), "left").join(at_edge, F.col("row") == F.col("edge_row"), "left")
    extra = F.when(F.col("rank").isNull() | (F.col("size") == 0), 0).when(F.col("rank") < F.coalesce(F.col("prefix"), F.lit(1 << RANK_BITS)), 1).when(F.col("edge_row").isNotNull(), 1).otherwise(0)
    copies = (F.col("whole") + extra).cast("int")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("p", F.lit(0.0)).alias("inclusion"), copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix-1") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes each, with all their columns, whatever their names.

    Rows that share an id are told apart by their place among them. Null texts and texts without words stay as often
    as their source takes whole copies; an empty table stays empty.
    """
    taken = mix(docs, doc_id, text, source, seed).select(F.col("doc_id").alias("k0"), F.col("source").alias("k1"), F.col("size").alias("k2"), "copies")
    here = docs.select(F.struct("*").alias("d"), F.col(doc_id).alias("h0"), F.col(source).alias("h1"))
    keys = 1
    if not docs.groupBy(doc_id).count().where("count > 1").isEmpty():  # rows of one id: matched by source and size, then by their order
        keys = 4
        here = here.withColumn("h2", n_words(whole(F.col("d").getField(text))))
        here = here.withColumn("h3", F.row_number().over(Window.partitionBy("h0", "h1", "h2").orderBy(F.col("d").getField(text))))
        taken = taken.withColumn("k3", F.row_number().over(Window.partitionBy("k0", "k1", "k2").orderBy(F.desc("copies"))))
    on = [F.col(f"h{k}").eqNullSafe(F.col(f"k{k}")) for k in range(keys)]
    found = here.join(taken.where("copies > 0"), on)
    return found.select("d", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("d.*")
