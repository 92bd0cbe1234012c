"""Mixing sources to target weights: Efraimidis-Spirakis order, whole epochs first.

Each source has a target number of words. It is met by complete epochs of the
source and then a weighted sample without replacement: every document draws the
exponential key -ln(u) / w, with u a hash of its id and text and w its quality
weight, and documents are taken in ascending order of key while the words before
them stay under what the epochs leave.

DataFrame functions only. A source may hold most rows: keys are cut into bins,
BINS to each doubling, so that they are fine whatever the weights; words are
pre-aggregated by (source, bin), and prefix sums run over the bins of a source.
The bin in which the budget runs out is cut into BINS again, and only the rows
of that finest bin, less than one in 10,000 of a source, are ever sorted by key,
equal ones as one. What comes out is one threshold a source, so the decision on
a document is a comparison.

Defined cases: null text has size 0; a null source is a source of its own, last
in order; a document of size 0 takes 0; sources without words have target 0;
null ids draw as the empty string beside the text does; equal keys are taken in
order of id, size and a hash of the whole row; of rows that are equal in all
columns just as many are taken as the budget needs, so that a source exceeds its
target by less than one document even if all its rows are the same; null,
negative, zero or non-finite weights count as the smallest weight; an empty
table gives no rows; other columns are kept by ``mix`` whatever their names
(outputs replace those of their names).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.llm.scratch import Scratch

BINS = 512
EPOCHS = 3
#: Smallest weight a document may draw with.
LEAST = 1e-6
#: Parts in which equal rows at a threshold are counted.
SALTS = 1024


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), epochs: int = EPOCHS) -> DataFrame:
    """sizes (_s, source_size), "" for the null source, with target double: shares by weight, none above epochs * source_size.

    Sources in order of code points, null last, weigh ``weights`` over and
    again. Resharing the excess by weight until none is above ends at the level L
    with target = min(cap, L * weight) and sum(target) = sum(source_size); with
    sources in order of cap / weight, L is the level at the first source that it
    does not fill; levels taken further on are no higher.
    """
    cyc = F.array(*[F.lit(float(w)) for w in weights])
    order = Window.orderBy(F.col("_s") == "", "_s")
    ranked = sizes.withColumn("weight", F.element_at(cyc, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))).withColumn("cap", epochs * F.col("source_size").cast("double"))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("_s") == "", "_s")
    upto, after = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("weight").over(after)
    leveled = ranked.withColumn("level", level).withColumn("fits", F.col("level") <= F.col("cap") / F.col("weight"))
    settled = leveled.withColumn("level", F.max(F.when(F.col("fits"), F.col("level"))).over(every))
    return settled.select("_s", "source_size", "weight", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def uniform(key: Column, text: Column) -> Column:
    """A number in (0, 1) from 48 bits of md5 of a key as text, a colon and a text; nulls are empty."""
    parts = [F.coalesce(x.cast("string"), F.lit("")) for x in (key, text)]
    digits = F.substring(F.md5(F.concat(parts[0], F.lit(":"), parts[1]).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def row_hash(docs: DataFrame) -> Column:
    """A 64-bit hash of all columns of a row but maps, which have none."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])


def by_label(quality: Column) -> Column:
    """Weights of the draw from 0/1 quality labels: good documents 2, bad ones 0.5, those without a label 1."""
    return F.when(quality == 1, 2.0).when(quality == 0, 0.5).otherwise(1.0)


def _draw(chance: Column, quality: Column | None) -> Column:
    """The exponential key of a document."""
    if quality is None:
        return -F.log(chance)
    weight = quality.cast("double")
    usable = weight.isNotNull() & ~F.isnan(weight) & (weight >= LEAST) & (weight < float("inf"))
    return -F.log(chance) / F.when(usable, weight).otherwise(LEAST)


def _cut(binned: DataFrame, on: str, column: str) -> DataFrame:
    """(on, left, column): the bin at whose end the words reach ``left``, with what of it is left there."""
    before = Window.partitionBy(on).orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    within = binned.withColumn("_before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    return within.where("_before < left and _before + words >= left").select(on, (F.col("left") - F.col("_before")).alias("left"), column)


def thresholds(narrow: DataFrame, weights: tuple[float, ...], epochs: int, bins: int) -> DataFrame:
    """A row a source of ``narrow`` (_s, _id, size, _key, _tie).

    source_size, target, whole (epochs taken whole), _last (the last of the
    sample: key, id, size, tie), _equal (rows that are equal to it) and _room (how
    many of them the sample takes).
    """
    power = F.floor(F.log2("_key"))
    # Exponent and mantissa of the key: its order, and equal shares of each doubling.
    place = (power + F.least(F.greatest(F.col("_key") / F.pow(F.lit(2.0), power) - 1, F.lit(0.0)), F.lit(1 - 2.0**-40))) * bins
    binned = narrow.withColumn("_bin", F.floor(place).cast("int")).withColumn("_fine", F.least(F.floor((place - F.floor(place)) * bins), F.lit(bins - 1)).cast("int"))
    goals = targets(narrow.groupBy("_s").agg(F.sum("size").alias("source_size")), weights, epochs)
    goals = goals.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    goals = goals.withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    first = _cut(binned.groupBy("_s", "_bin").agg(F.sum("size").alias("words")).join(goals.select("_s", "left"), "_s"), "_s", "_bin")
    inside = binned.join(first, ["_s", "_bin"])
    second = _cut(inside.groupBy("_s", "_fine").agg(F.sum("size").alias("words"), F.first("left").alias("left")), "_s", "_fine")
    final = inside.drop("left").join(second, ["_s", "_fine"]).where("size > 0")
    once = final.groupBy("_s", "_key", "_id", "size", "_tie").agg(F.count(F.lit(1)).alias("_equal"), F.first("left").alias("left"))
    before = Window.partitionBy("_s").orderBy("_key", "_id", "size", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    taken = once.withColumn("_before", F.coalesce(F.sum(F.col("size") * F.col("_equal")).over(before), F.lit(0))).where("_before < left")
    room = F.least(F.ceil((F.col("left") - F.col("_before")) / F.col("size")), F.col("_equal"))
    last = taken.groupBy("_s").agg(F.max(F.struct("_key", "_id", "size", "_tie", room.alias("room"), "_equal")).alias("x"))
    last = last.select("_s", F.struct("x._key", "x._id", "x.size", "x._tie").alias("_last"), F.col("x.room").alias("_room"), F.col("x._equal").alias("_equal"))
    return goals.join(last, "_s", "left").select("_s", "source_size", "target", "whole", "_last", "_room", "_equal")


def _share(tied: DataFrame, scratch: Scratch) -> DataFrame:
    """``tied`` (equal rows of each source) with ``in``: true for _room of them. Counted in SALTS parts, so that no task holds a source's."""
    salted = scratch.keep(tied.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))), "tied")
    counts = salted.groupBy("_s", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_s").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("_s").alias("_of"), F.col("_salt").alias("_part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = salted.join(starts, (F.col("_s") == F.col("_of")) & (F.col("_salt") == F.col("_part")))
    number = F.col("_start") + F.row_number().over(Window.partitionBy("_s", "_salt").orderBy("_salt"))
    return placed.withColumn("in", number <= F.col("_room"))


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", quality: Column | None = None, weights: tuple[float, ...] = (1.0, 2.0, 3.0), epochs: int = EPOCHS, bins: int = BINS,
    keep: tuple[str, ...] | None = None, words: str | None = None, draw: str | None = None, tie: str | None = None,
) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all if None) with size, source_size, target, copies int and taken long.

    ``quality``: weights of the draw, an expression over ``docs`` (all 1 if
    None). ``words``, ``draw`` and ``tie``: columns that already hold word_count(),
    uniform() and row_hash(), so that joins need not carry texts. copies: the complete epochs,
    plus 1 for the documents of the fractional selection. taken = copies * size:
    the words taken, repeats counted. A source's taken words exceed its target by
    less than a document.
    """
    outs = ("size", "source_size", "target", "copies", "taken")
    names = [c for c in (docs.columns if keep is None else keep) if c not in outs]
    places = [f"c{i}" for i in range(len(names))]
    # Columns travel under their places, so no name of theirs can clash. "" stands for the null source; any other has a mark before it.
    rows = docs.select(
        *[F.col(f"`{c}`").alias(p) for c, p in zip(names, places, strict=True)],
        F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit("")).alias("_s"),
        F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("_id"),
        (word_count(F.col(f"`{text}`").cast("string")) if words is None else F.coalesce(F.col(f"`{words}`").cast("long"), F.lit(0))).alias("size"),
        _draw(uniform(F.col(f"`{key}`"), F.col(f"`{text}`")) if draw is None else F.col(f"`{draw}`"), quality).alias("_key"),
        (row_hash(docs if keep is None else docs.select(*[F.col(f"`{c}`") for c in keep])) if tie is None else F.col(f"`{tie}`")).alias("_tie"),
    )
    scratch = Scratch(docs.sparkSession, "mixture")
    slim = names == [key]
    narrow = scratch.keep(rows.select(*places * slim, "_s", "_id", "size", "_key", "_tie"), "narrow")
    cuts = scratch.keep(thresholds(narrow, weights, epochs, bins), "thresholds")
    joined = (narrow if slim else rows).join(cuts, "_s")
    own = F.struct("_key", "_id", "size", "_tie")
    tied = own.eqNullSafe(F.col("_last")) & (F.col("_room") < F.col("_equal"))
    decided = joined.withColumn("in", F.coalesce(own <= F.col("_last"), F.lit(False)))
    if not cuts.where("_room < _equal").isEmpty():
        decided = decided.where(~tied).unionByName(_share(joined.where(tied), scratch).select(*decided.columns))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("in").cast("int")).otherwise(0).cast("int")
    done = decided.withColumn("copies", copies)
    return done.select(*[F.col(p).alias(c) for c, p in zip(names, places, strict=True)], "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as many times as ``copies`` says."""
    names = mixed.columns
    every = mixed.where("copies > 0").select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("n"))
    return every.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
