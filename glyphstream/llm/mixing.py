"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the key -ln(u) / w, with u uniform from a hash of its id and
text and w its quality weight. Ordered by that key within a source, each prefix is
a weighted sample without replacement. A source whose target exceeds its size is
taken whole as often as that fits, and only the rest is selected by key.

No source is ever ordered in one task: sizes are summed by (source, bin of the
key), which finds the bin that the budget ends in; that bin is cut into bins again
until few keys are left in it, and only these are ordered. Rows that repeat have one
key, so the edge may fall inside of them: then they are counted, and as many as fit
are taken. Everything here is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import cut

WORD = r"[^\x20\x09-\x0D]+"
MAX_EPOCHS = 3
#: Bins that a range of keys is cut into; keys of a source that are ordered at most, unless no range tells them apart.
BINS, ORDERED = 1024, 20_000
ON = ["_no_source", "_source"]


def quality_weight(text: Column) -> Column:
    """0.25 to 1: falls with the share of the symbols #*$%&|<> among the characters."""
    chars = F.length(text)
    symbols = chars - F.length(F.translate(text, "#*$%&|<>", ""))
    return F.when(chars > 0, F.greatest(F.lit(0.25), 1 - 4 * symbols / chars)).otherwise(F.lit(1.0))


def key_columns(docs: DataFrame, seed: int = 17, weight: str | None = None) -> dict[str, Column]:
    """_size (words; null text: 0), _key, and the null-safe source columns _no_source, _source, of a table with doc_id, text and source.

    `weight` names a column with positive quality weights; a missing or other weight counts as
    1. Without it the weight is quality_weight() of the text.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), docs["doc_id"], docs["text"]), 11)
    uniform = (bits + 0.5) * F.lit(2.0**-53)
    w = quality_weight(text)
    if weight is not None:
        given = docs[weight].cast("double")
        w = F.when((given > 0) & (given < float("inf")), given).otherwise(F.lit(1.0))
    return {
        "_size": F.regexp_count(text, F.lit(WORD)).cast("long"),
        "_key": -F.log(uniform) / w,
        "_no_source": docs["source"].isNull(),
        "_source": F.coalesce(docs["source"], F.lit("")),
    }


def targets(keyed: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """A row for each source: source_size, target and epochs.

    Sources in code point order, null last, weigh `weights` in turn. With the sources
    ordered by cap / weight, a source is held at its cap exactly if the share that the
    words still free give it is above the cap: one pass over running sums then does what
    resharing the excess again and again does. There is a row for each source here, so
    the windows without a key see the list of sources, never documents.
    """
    one = keyed.groupBy(*ON).agg(F.sum("_size").alias("source_size"), F.min("_key").alias("_least"), F.max("_key").alias("_most"))
    by_name = Window.orderBy("_no_source", "_source")
    weight = F.array(*map(F.lit, weights))
    one = one.withColumn("_w", F.get(weight, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))))
    one = one.withColumn("_cap", MAX_EPOCHS * F.col("source_size").cast("double"))
    all_rows = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = (
        Window.partitionBy(F.lit(0))
        .orderBy(F.col("_cap") / F.col("_w"), "_no_source", "_source")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    one = one.withColumns(
        {
            "_total": F.sum("source_size").over(all_rows).cast("double"),
            "_all_w": F.sum("_w").over(all_rows),
            "_cap_before": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
            "_w_before": F.coalesce(F.sum("_w").over(before), F.lit(0.0)),
        }
    )
    level = (F.col("_total") - F.col("_cap_before")) / (F.col("_all_w") - F.col("_w_before"))
    one = one.withColumn("_capped", F.col("_cap") < level * F.col("_w"))
    held = lambda c: F.sum(F.when(F.col("_capped"), F.col(c)).otherwise(F.lit(0.0))).over(all_rows)
    free = F.col("_all_w") - held("_w")
    one = one.withColumn("_level", F.when(free > 0, (F.col("_total") - held("_cap")) / free).otherwise(F.lit(0.0)))
    target = F.when(F.col("_capped"), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_level") * F.col("_w")))
    size = F.col("source_size")
    return one.select(
        "_no_source",
        "_source",
        "source_size",
        target.alias("target"),
        "_least",
        "_most",
        F.when(size > 0, F.floor(target / size)).otherwise(F.lit(0)).cast("long").alias("_epochs"),
    ).withColumn("_rest", F.col("target") - F.col("_epochs") * size)


def _edges(keyed: DataFrame, goal: DataFrame) -> DataFrame:
    """goal with the range of keys that its budget ends in, _lo to _most, and _full, the words of all keys below it.

    Each round cuts every source's range into BINS; it goes on until no range has more than
    ORDERED keys, or can't be cut any more because they are equal.
    """
    goal, width = goal.withColumnRenamed("_least", "_lo"), F.col("_most") - F.col("_lo")
    now = goal.select(*ON, "_rest", "_lo", "_most", F.lit(0).cast("long").alias("_full"))
    goal = goal.drop("_lo", "_most")
    while True:
        inside = keyed.join(now, ON).where(F.col("_key").between(F.col("_lo"), F.col("_most")))
        bin_ = F.when(width > 0, F.least(F.lit(BINS - 1), F.floor((F.col("_key") - F.col("_lo")) / width * BINS))).otherwise(F.lit(0)).cast("int")
        by_bin = inside.groupBy(*ON, bin_.alias("_bin")).agg(F.sum("_size").alias("_in"), F.count("*").alias("_n"), F.min("_key").alias("_least"), F.max("_key").alias("_last"))
        upto = Window.partitionBy(*ON).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
        bins = by_bin.withColumn("_upto", F.sum("_in").over(upto)).join(now, ON)
        below = (F.col("_full") + F.col("_upto") - F.col("_in")).alias("_below")
        over = bins.where(F.col("_full") + F.col("_upto") > F.col("_rest")).groupBy(*ON).agg(F.min_by(F.struct("_n", "_least", "_last", below), "_bin").alias("_e"))
        found = cut(over.select(*ON, "_e.*"), "mix-bins")
        most = found.agg(F.max(F.when(F.col("_last") > F.col("_least"), F.col("_n")).otherwise(F.lit(0)))).first()[0] or 0
        now = found.join(goal.select(*ON, "_rest"), ON).select(*ON, "_rest", F.col("_least").alias("_lo"), F.col("_last").alias("_most"), F.col("_below").alias("_full"))
        if most <= ORDERED:
            return goal.join(now.drop("_rest"), ON, "left")


def plan(keyed: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """targets() with what the fractional selection takes: all keys below _edge_key, _edge_rows rows of that key, and one row of _extra_key.

    The prefix ends before the row that would exceed the budget; of the rows beyond, the one
    whose size is nearest to the gap is added if that comes nearer. Without an edge the
    whole source fits, and all keys are below.
    """
    goal = cut(targets(keyed, weights), "mix-targets")
    goal = cut(_edges(keyed, goal), "mix-edges")
    inside = keyed.join(goal.select(*ON, "_rest", "_full", "_lo", "_most"), ON).where(F.col("_key").between(F.col("_lo"), F.col("_most")))
    # Rows that repeat are one group here, so what is ordered are different keys.
    groups = inside.groupBy(*ON, "_key").agg(F.sum("_size").alias("_in"), F.count("*").alias("_n"), F.first("_rest").alias("_rest"), F.first("_full").alias("_full"))
    in_order = Window.partitionBy(*ON).orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("_below", F.col("_full") + F.coalesce(F.sum("_in").over(in_order), F.lit(0)))
    first = groups.where(F.col("_below") + F.col("_in") > F.col("_rest")).groupBy(*ON).agg(F.min_by(F.struct("_key", "_in", "_n", "_below", "_rest"), "_key").alias("_e"))
    each = F.col("_e._in") / F.col("_e._n")
    rows = F.least(F.col("_e._n") - 1, F.floor((F.col("_e._rest") - F.col("_e._below")) / each)).cast("long")
    edge = first.select(*ON, F.col("_e._key").alias("_edge_key"), rows.alias("_edge_rows"), F.col("_e._n").alias("_edge_n"), (F.col("_e._rest") - F.col("_e._below") - rows * each).alias("_gap"))
    goal = cut(goal.drop("_lo", "_most", "_full").join(edge, ON, "left"), "mix-edge")
    gap = F.abs(F.col("_gap") - F.col("_size"))
    beyond = keyed.join(goal.select(*ON, "_gap", "_edge_key"), ON).where(F.col("_key") >= F.col("_edge_key"))
    beyond = beyond.where((F.col("_size") > 0) & (gap < F.col("_gap"))).groupBy(*ON).agg(F.min_by("_key", F.struct(gap, F.col("_key"))).alias("_extra_key"))
    goal = goal.join(beyond, ON, "left")
    more = F.coalesce((F.col("_extra_key") == F.col("_edge_key")).cast("long"), F.lit(0))
    goal = goal.withColumn("_edge_rows", F.col("_edge_rows") + more).withColumn("_extra_key", F.when(more == 0, F.col("_extra_key")))
    counts = keyed.join(goal.select(*ON, "_extra_key"), ON).where(F.col("_key") == F.col("_extra_key")).groupBy(*ON).agg(F.count("*").alias("_extra_n"))
    return cut(goal.join(counts, ON, "left").select(*ON, "source_size", "target", "_epochs", "_edge_key", "_edge_rows", "_edge_n", "_extra_key", "_extra_n"), "mix-plan")


def _taken(docs: DataFrame, weights: tuple[float, ...], seed: int, weight: str | None) -> DataFrame:
    """(_d, a struct of all columns of docs, _size, source_size, target, _copies) for each row; inside, docs' own names can't clash."""
    keys = key_columns(docs, seed, weight)
    own = F.struct(*[docs[c] for c in docs.columns]).alias("_d")
    keyed = docs.select(own, *[c.alias(k) for k, c in keys.items()])
    small = cut(docs.select(*[c.alias(k) for k, c in keys.items()]), "mix-keys")
    chosen = plan(small, weights)
    key = F.col("_key")
    at_edge, at_extra = F.coalesce(key == F.col("_edge_key"), F.lit(False)), F.coalesce(key == F.col("_extra_key"), F.lit(False))
    below = F.col("_edge_key").isNull() | (key < F.col("_edge_key"))
    rows = keyed.join(chosen, ON)
    wanted = F.when(at_edge, F.col("_edge_rows")).when(at_extra, F.lit(1)).otherwise(F.lit(0))
    whole = F.when(at_edge, F.col("_edge_n")).when(at_extra, F.col("_extra_n")).otherwise(F.lit(0))
    out = lambda df, picked: df.select("_d", "_size", "source_size", "target", F.least(F.col("_epochs") + F.when(picked, 1).otherwise(0), F.lit(MAX_EPOCHS)).cast("long").alias("_copies"))
    again = chosen.agg(F.max(F.greatest(F.coalesce("_edge_n", F.lit(1)), F.coalesce("_extra_n", F.lit(1))))).first()[0] or 1
    if again == 1:
        return out(rows, below | (wanted > 0))
    # Rows of the edge's key that repeat are numbered; which of them are taken makes no difference, as they are alike.
    split = (wanted > 0) & (wanted < whole)
    few = rows.where(split).withColumn("_at", F.row_number().over(Window.partitionBy(*ON, "_key").orderBy("_size")))
    return out(rows.where(~split), below | (wanted > 0)).unionByName(out(few, F.col("_at") <= wanted))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), seed: int = 17, weight: str | None = None) -> DataFrame:
    """docs with size, source_size, target, copies and taken.

    docs needs doc_id, text and source; all other columns are kept, but those of the result's
    names are replaced. A null text has size 0 and is taken 0 times in words (its copies follow
    its key like any other). A null source is a source of its own, the last. Rows that repeat, id
    and text alike, have one key; if only some of them fit, as many as fit are taken. An empty
    table gives an empty result. `weight` names a column of quality weights (see key_columns()).
    """
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    out = _taken(docs, weights, seed, weight)
    return out.select(*[F.col("_d")[c].alias(c) for c in own], F.col("_size").alias("size"), "source_size", "target", F.col("_copies").alias("copies"), (F.col("_copies") * F.col("_size")).alias("taken"))


def sample(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), seed: int = 17, weight: str | None = None) -> DataFrame:
    """The rows of docs, each as often as mix() takes it, with all their columns as they are, whatever these are called."""
    out = _taken(docs, weights, seed, weight).where("_copies > 0")
    out = out.select("_d", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return out.select(*[F.col("_d")[c].alias(c) for c in docs.columns])
