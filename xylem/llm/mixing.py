"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

A source's target over its size is the copies that each of its documents should have; the whole part is taken, and the
fraction is rounded so that the source's words stay as they are. In a block of documents, the largest is paired with all
smaller ones as one: it takes words from them, or gives to them, until it is whole (all its words or none) or they are.
The direction is drawn from a hash, with the odds that leave each document's expected words unchanged (but in a source's
last block, where a document too large for what the others have goes the one way it can); what the smaller
ones give or get, they share, in proportion to what they have or lack. Then the next smaller is paired with the rest.
So a block leaves one document undecided, mostly its smallest; these meet in larger blocks, level by level, until a
source has one left, which goes to the nearer end. The documents of a source that are large beside it, a bounded number,
come first, paired with all its others as one. So a source misses its target by half of its last document at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xylem.llm.common import Scratch, fresh, save

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
#: Documents of one block, on average; the tree has a level for each power of it. A block of more than CROWDED (alike ids and sizes) is split.
BLOCK, CROWDED = 128, 512
#: Documents of more than this part of their source (fewer than so many) are rounded first, against all others as one.
LARGE = 512
SEED = 11

UNIT = "struct<s:bigint,d:bigint,u:bigint,m:double>"
DONE = "array<struct<d:bigint,s:bigint,u:bigint,take:int>>"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, total_share: float, scratch: Scratch) -> DataFrame:
    """(source, source_size, n) -> with target, one row per source, however many there are.

    Each source's weight goes by its place (code points, null last), which a range partitioning gives. Filled like water:
    a level times the weight, but MOST_COPIES times its size at most. The level rises step by step: what sources below it
    cannot take is shared by the weights of the others, until no more of them are filled. Only sums come to the driver.
    """
    order, cap = F.col("source").asc_nulls_last(), F.col("source_size") * float(MOST_COPIES)
    placed = sizes.repartitionByRange(int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")), order).sortWithinPartitions(order)
    placed = scratch.save(placed.withColumn("at", F.monotonically_increasing_id()), "placed").withColumns({"part": F.shiftright("at", 33), "nth": F.col("at").bitwiseAND((1 << 33) - 1)})
    before, starts = 0, []
    for part, n in sorted((r.part, r["count"]) for r in placed.groupBy("part").count().collect()):
        starts.append((part, before))
        before += n
    starts = F.broadcast(sizes.sparkSession.createDataFrame(starts, "part long, before long"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("before") + F.col("nth")) % len(WEIGHTS) + 1).cast("int"))
    t = placed.join(starts, "part").select("source", "source_size", "n", weight.alias("weight"), cap.alias("cap"))
    total, level = (t.agg(F.sum("source_size")).first()[0] or 0) * total_share, 0.0
    while True:
        below = F.col("cap") <= F.lit(level) * F.col("weight")
        held, open_weight = t.agg(F.sum(F.when(below, F.col("cap")).otherwise(0.0)), F.sum(F.when(below, 0).otherwise(F.col("weight")))).first()
        risen = (total - held) / open_weight if open_weight else level
        if risen <= level * (1 + 1e-12):
            break
        level = risen
    return t.select("source", "source_size", "n", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def _let(values: list[Column], use) -> Column:
    """use(*values), each value computed once (a lambda's body is not searched for what it repeats)."""
    named = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return F.transform(F.array(named), lambda v: use(*[v[f"v{i}"] for i in range(len(values))]))[0]


def _rounded(units: Column, room: Column, mass: Column, last: Column) -> Column:
    """Folds a block, largest unit first: {c: the undecided unit, out: what is decided, ...}.

    mass and room, at first of all units, are those of the units not yet met: what they have, and all they can have. Each of these has
    a * m + b * s now, since what the rest gives or gets is shared in proportion to what each has or lacks. In a source's
    last block a unit that can be whole one way only goes that way, or its words would stay beside the target.
    """

    def unit(x: Column, m: Column) -> Column:
        return F.struct(x["s"].alias("s"), x["d"].alias("d"), x["u"].alias("u"), m.alias("m"))

    def step(acc: Column, x: Column) -> Column:
        size, room, none = x["s"].cast("double"), acc["room"] - x["s"], F.lit(0.0)

        def met(has: Column, mass: Column) -> Column:
            gain, lose = F.least(size - has, mass), F.least(has, room - mass)
            return _let([gain, lose, gain >= size - has, lose >= has], lambda gain, lose, filled, emptied: drawn(has, mass, gain, lose, filled, emptied))

        def drawn(has: Column, mass: Column, gain: Column, lose: Column, filled: Column, emptied: Column) -> Column:
            draw = F.pmod(F.xxhash64(F.lit(SEED), x["d"], x["s"], acc["room"]), F.lit(1 << 52)) / float(1 << 52)
            up = F.when(last & (filled != emptied), filled).when(gain + lose > 0, draw * (gain + lose) < lose).otherwise(has >= size)
            return _let([up], lambda up: _let([F.when(up, filled).otherwise(emptied), F.when(up, gain).otherwise(-lose)], lambda ends, moved: after(has, mass, up, ends, moved)))

        def after(has: Column, mass: Column, up: Column, ends: Column, moved: Column) -> Column:
            # The rest changes by -moved: it gives in proportion to what it has, and gets in proportion to what it lacks.
            keep = F.when(moved > 0, F.when(mass > 0, (mass - moved) / mass).otherwise(none)).when(moved < 0, F.when(room > mass, (room - mass + moved) / (room - mass)).otherwise(none)).otherwise(1.0)
            done = F.struct(x["d"].alias("d"), x["s"].alias("s"), x["u"].alias("u"), up.cast("int").alias("take"))
            left, out = F.when(~ends, unit(x, has + moved)).otherwise(acc["c"]), F.when(ends, F.concat(acc["out"], F.array(done))).otherwise(acc["out"])
            return _let([keep], lambda keep: F.struct(left.alias("c"), out.cast(DONE).alias("out"), (acc["a"] * keep).alias("a"), (acc["b"] * keep + F.when(moved < 0, 1 - keep).otherwise(none)).alias("b"), room.alias("room"), (mass - moved).alias("mass")))

        has = F.greatest(none, F.least(size, acc["a"] * x["m"] + acc["b"] * size))
        return _let([has], lambda has: _let([F.when(room > 0, F.greatest(none, F.least(room, acc["mass"] - has))).otherwise(none)], lambda mass: met(has, mass)))

    start = F.struct(F.lit(None).cast(UNIT).alias("c"), F.array().cast(DONE).alias("out"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), room.cast("double").alias("room"), mass.cast("double").alias("mass"))
    return F.aggregate(units, start, step)


def _folded(here: DataFrame) -> DataFrame:
    """One fold for each source and block. A crowded block (rows alike in all that a block hangs on) is split by row, so no row or group of rows is folded whole."""
    crowded = here.groupBy("source", "block").agg(F.count("*").alias("rows")).where(F.col("rows") > CROWDED)
    crowded = crowded.select(F.col("source").alias("of"), F.col("block").alias("at"), "rows")
    dealt = here.join(crowded, here["source"].eqNullSafe(crowded["of"]) & (here["block"] == crowded["at"]), "left")
    dealt = dealt.withColumn("part", F.coalesce(F.pmod(F.xxhash64(F.lit(SEED), "x.u"), F.ceil(F.col("rows") / BLOCK)), F.lit(0).cast("long")))
    listed = dealt.groupBy("source", "block", "part").agg(F.max("blocks").alias("blocks"), F.sort_array(F.collect_list("x"), asc=False).alias("units"))
    total = lambda field: F.aggregate("units", F.lit(0.0), lambda acc, x: acc + x[field].cast("double"))
    return listed.select("source", "block", "blocks", _rounded(F.col("units"), total("s"), total("m"), F.col("blocks") == 1).alias("r"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", total_share: float = 1.0) -> DataFrame:
    """One row per row of docs: id_col, size, source_size, target, taken, copies, source.

    size counts the words of the whole text (null or blank: 0). A source of no words has target 0; a document of no
    words takes 0 and has the whole part of the copies. A null source is a source of its own. Repeated rows, null ids
    and ties are drawn one by one; ids must be numbers or texts of numbers. Draws hang on ids and sizes alone, so reruns agree; only among
    hundreds of rows alike in both does it hang on their place in the input which are taken. An empty table gives an
    empty result. Other columns are not read, so their names don't matter.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("s"), F.monotonically_increasing_id().alias("u"))
    scratch = Scratch()
    return scratch.result(_drawn(rows, total_share, scratch).select(F.col("d").alias(id_col), F.col("s").alias("size"), "source_size", "target", (F.col("s") * F.col("copies")).alias("taken"), "copies", "source"), "mix")


def _drawn(rows: DataFrame, total_share: float, scratch: Scratch) -> DataFrame:
    """rows (d, source, s, u: id, source, words, a key of the row) with source_size, target and copies."""
    rows = scratch.save(rows, "sizes")
    sizes = scratch.save(targets(rows.groupBy("source").agg(F.sum("s").alias("source_size"), F.count("*").alias("n")), total_share, scratch), "targets")
    share = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST_COPIES)))).otherwise(F.lit(0.0))
    sizes = sizes.withColumn("base", F.least(F.floor(share), F.lit(MOST_COPIES))).withColumn("fraction", share - F.col("base"))

    unit = F.struct("s", "d", "u", (F.col("s") * F.col("fraction")).alias("m")).alias("x")
    large = F.col("s") * LARGE > F.col("source_size")
    whole = rows.join(sizes, rows["source"].eqNullSafe(sizes["source"])).select("d", rows["source"], "s", "u", "fraction", "source_size")
    units = whole.where(large).groupBy("source", "source_size", "fraction").agg(F.sort_array(F.collect_list(unit), asc=False).alias("units"))
    first = scratch.save(units.select("source", "fraction", _rounded(F.col("units"), F.col("source_size"), F.col("source_size") * F.col("fraction"), F.lit(True)).alias("r")), "large")
    shared = first.select(F.col("source").alias("of"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("r.a") * F.col("fraction") + F.col("r.b"))).alias("rest"))
    rest = sizes.join(shared, F.col("source").eqNullSafe(F.col("of")), "left").select(F.col("source").alias("of"), "source_size", "n", F.coalesce("rest", "fraction").alias("fraction"))
    plain = rows.join(rest, F.col("source").eqNullSafe(F.col("of"))).where(~large)
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.lit(1))
    here = plain.where("s > 0").select("source", unit, blocks.alias("blocks"), F.pmod(F.xxhash64(F.lit(SEED), "d", "s"), blocks).alias("block"))
    here = here.unionAll(first.where("r.c is not null").select("source", F.col("r.c").alias("x"), F.lit(1).cast("long"), F.lit(0).cast("long")))
    decided = plain.where("s = 0").select("source", "d", "s", "u", F.lit(0).alias("take"))
    decided = decided.unionAll(first.select("source", F.explode("r.out").alias("o")).select("source", "o.d", "o.s", "o.u", "o.take"))
    while True:
        folded = scratch.save(_folded(here), "rounded")
        decided = decided.unionAll(folded.select("source", F.explode("r.out").alias("o")).select("source", "o.d", "o.s", "o.u", "o.take"))
        left = folded.where("r.c is not null").select("source", F.col("r.c").alias("x"), "blocks", "block")
        if left.groupBy("source").count().where("count > 1").isEmpty():
            break
        above = F.greatest(F.ceil(F.col("blocks") / BLOCK), F.lit(1))
        here = left.select("source", "x", above.alias("blocks"), F.pmod(F.col("block"), above).alias("block"))
    decided = decided.unionAll(left.select("source", "x.d", "x.s", "x.u", (F.col("x.m") * 2 >= F.col("x.s")).cast("int").alias("take")))
    per = sizes.select(F.col("source").alias("of"), "source_size", "target", "base")
    out = decided.join(per, F.col("source").eqNullSafe(F.col("of")))
    return out.select("d", "s", "u", "source", "source_size", "target", F.least(F.col("base") + F.col("take"), F.lit(MOST_COPIES)).cast("long").alias("copies"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", total_share: float = 1.0) -> DataFrame:
    """docs with each row as often as the mix takes it, by the row and not by its id (see mix for nulls, repeats and empty tables).

    All columns are kept, whatever their names. The rows are written once, with a key of their own.
    """
    key, times = fresh(docs, "row"), fresh(docs, "copies")
    rows = save(docs.withColumn(key, F.monotonically_increasing_id()), "mix_rows")
    slim = rows.select(F.col(id_col).cast("long").alias("d"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("s"), F.col(key).alias("u"))
    scratch = Scratch()
    copies = scratch.result(_drawn(slim, total_share, scratch).where("copies > 0").select(F.col("u").alias(key), F.col("copies").alias(times)), "mix_copies")
    # As many copies as rows, so they are met by a merge at every size.
    return rows.join(copies.hint("merge"), key).withColumn(times, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*docs.columns)
