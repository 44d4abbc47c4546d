"""Free names without probing: which number each repeat of a name gets, by counting.

Rows ask for names in an order.  Who comes first has the name; later ones get the least number
from 2 on that is free for its stem.  A numbered name may itself be asked for ("b-2"), and then
it matters which of the two came first.

Counting instead of probing.  Let ``c`` be a name, ``k`` count its repeats in order, and let
``B`` hold the numbers n whose name ``c-n`` was asked for before the repeats got there.  Numbers
given to ``c`` only grow, so its k-th repeat gets the k-th number that isn't in ``B``; and ``c-n``, asked for
after K repeats, is in ``B`` exactly if K is at most the n - 2 numbers below it less those in ``B``: one
pass over a stem's numbers, in order, which carries a count.  If ``c-n`` isn't in ``B`` it is
taken when it is asked for, so all who ask are repeats.  Stems are settled before the names that
are numbers of theirs, one depth ("b", "b-2", "b-2-2") at a time.

Counts run over blocks (``running``), so a name with any number of copies spans tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.storage import bounded_rows, materialise

#: A number at a stem's end that numbering could have put there.
_NUMBER = r"-([2-9]|[1-9][0-9]{1,17})\z"


def running(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """Adds each value's sum over the rows of the same keys up to and with the row's own, in order.

    Rows are dealt by ranges of keys and order.  Windows run within a range; a row a key and range
    carries its sums on, so no key needs one task.  Null keys are keys.
    """
    dealt = rows.withColumns({f"_value{i}": v.cast("long") for i, v in enumerate(values.values())})
    dealt = materialise(dealt.repartitionByRange(*keys, *order).withColumn("_block", F.spark_partition_id()), "ranges")  # a row's range must not change between two readings
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*(f"_k{i}" for i in range(len(keys)))).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    some = range(len(values))
    blocks = dealt.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_block").alias("_at")).agg(*(F.sum(f"_value{i}").alias(f"_in{i}") for i in some))
    blocks = blocks.select("*", *(F.sum(f"_in{i}").over(before).alias(f"_before{i}") for i in some)).where(F.coalesce(*(f"_before{i}" for i in some)).isNotNull())
    same = F.col("_block") == F.col("_at")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = dealt.select("*", *(F.sum(f"_value{i}").over(inside).alias(f"_own{i}") for i in some)).join(blocks, same, "left")
    return out.select(*rows.columns, *((F.col(f"_own{i}") + F.coalesce(f"_before{i}", F.lit(0))).alias(name) for i, name in enumerate(values)))


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (group, stem, num, asked), sorted: adds ``free``, the numbers free below, and ``blocked``: whether the number was free when it was asked for."""
    last, s = None, 0
    for batch in batches:
        group, stem, num, asked = (c.to_pylist() for c in batch.columns)
        free, blocked = [], []
        for key, n, before in zip(zip(group, stem, strict=True), num, asked, strict=True):
            if key != last:
                last, s = key, 0
            free.append(n - 2 - s)
            blocked.append(before <= n - 2 - s)
            s += blocked[-1]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(free, pa.int64()), pa.array(blocked, pa.bool_())], ["group", "stem", "num", "asked", "free", "blocked"])


def _settled(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Adds ``number`` (1: the name itself) to rows of a few families with ``head``, ``tail`` and ``nth`` of each name."""
    stem = F.concat(F.regexp_replace("head", _NUMBER, ""), F.lit("\0"), F.col("tail"))
    rows = rows.withColumn("_name", F.concat("head", F.lit("\0"), F.col("tail"))).withColumn("_num", F.nullif(F.regexp_extract("head", _NUMBER, 1), F.lit("")).cast("long"))
    depth = (F.length("head") - F.length(F.regexp_replace("head", r"(?:-(?:[2-9]|[1-9][0-9]{1,17}))+\z", ""))).alias("_depth")  # a stem is shorter than its numbers
    rows = materialise(rows.withColumn("_stem", F.when(F.col("_num").isNotNull(), stem)).select("*", depth), "odd")
    taken = None  # (group, name) of names that repeats of their stems have got before anyone asked
    out = None
    for at in [r["_depth"] for r in rows.select("_depth").distinct().orderBy("_depth").collect()]:  # as many as a name has numbers
        own = rows.where(F.col("_depth") == at)
        if taken is None:
            own = own.withColumn("_late", F.lit(False))
        else:
            late = taken.select(F.col("group").alias("_g"), F.col("name").alias("_m"), F.lit(True).alias("_l"))
            own = own.join(late, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_name") == F.col("_m")), "left").withColumn("_late", F.coalesce("_l", F.lit(False))).drop("_g", "_m", "_l")
        own = own.withColumn("_k", F.when(F.col("_late"), F.col("nth")).otherwise(F.col("nth") - 1))
        # those who first ask for a number of these stems, among the repeats
        asks = rows.where("nth = 1 and _num is not null").join(own.select(F.col(group).alias("_g"), F.col("_name").alias("_m")).distinct(), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_stem") == F.col("_m")), "left_semi")
        asks = asks.select(F.col(group).alias("group"), F.col("_stem").alias("stem"), F.col(order).alias("order"), F.col("_num").alias("num"), F.col("_name").alias("name"))
        if bounded_rows(asks, 0) is not None:
            done = own.withColumn("number", F.col("_k") + 1)
        else:
            repeats = own.where("_k > 0").select(F.col(group).alias("group"), F.col("_name").alias("stem"), F.col(order).alias("order"), F.lit(None).cast("long").alias("num"), F.lit(None).cast("string").alias("name"))
            both = running(repeats.unionByName(asks), ["group", "stem"], ["order"], {"asked": F.when(F.col("num").isNull(), 1).otherwise(0)}).where("num is not null")
            scan = both.select("group", "stem", "num", "asked").repartition("group", "stem").sortWithinPartitions("group", "stem", "num")
            schema = scan.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ").replace(",", ", ")
            found = materialise(scan.mapInArrow(_blocked, f"{schema}, free long, blocked boolean"), "numbers")
            new = both.join(found.where("not blocked").select(F.col("group").alias("_g"), F.col("stem").alias("_m"), F.col("num").alias("_n")), F.col("group").eqNullSafe(F.col("_g")) & (F.col("stem") == F.col("_m")) & (F.col("num") == F.col("_n")), "left_semi").select("group", "name")
            taken = materialise(new if taken is None else new.unionByName(taken), "taken")
            # a repeat is shifted by the blocked numbers with fewer free ones below than its count
            steps = own.where("_k > 0").select(F.col(group).alias("group"), F.col("_name").alias("stem"), (2 * F.col("_k")).alias("place"), F.lit(0).alias("up"), F.col(order).alias("order"))
            steps = steps.unionByName(found.where("blocked").select("group", "stem", (2 * F.col("free") + 1).alias("place"), F.lit(1).alias("up"), F.lit(None).cast(own.schema[order].dataType).alias("order")))
            shift = running(steps, ["group", "stem"], ["place"], {"shift": F.col("up")}).where("up = 0").select(F.col("group").alias("_g"), F.col("stem").alias("_m"), F.col("place").alias("_p"), "shift")
            same = F.col(group).eqNullSafe(F.col("_g")) & (F.col("_name") == F.col("_m")) & (2 * F.col("_k") == F.col("_p"))
            done = own.join(shift, same, "left").withColumn("number", F.col("_k") + 1 + F.coalesce("shift", F.lit(0))).drop("_g", "_m", "_p", "shift")
        done = done.drop("_late", "_k", "_name", "_num", "_stem", "_depth")
        out = done if out is None else out.unionByName(done)
    return out


def numbered(rows: DataFrame, group: str, order: str, head: Column, tail: Column) -> DataFrame:
    """Adds ``head``, ``tail`` and ``number``: who asks for ``head + tail`` gets head, "-" and number (from 2 on), tail.

    ``order`` tells rows of a group apart.
    """
    rows = running(rows.withColumn("head", head).withColumn("tail", tail), [group, "head", "tail"], [order], {"nth": F.lit(1)})
    # numbers only meet within a family: names that are equal but for numbers at the stem's end
    family = F.concat(F.regexp_replace("head", "(?:-[0-9]+)+$", ""), F.lit("\0"), F.col("tail"))
    rows = materialise(rows.withColumn("_family", family), "counted")
    given = F.concat("head", F.when(F.col("nth") > 1, F.concat(F.lit("-"), F.col("nth"))).otherwise(""))
    clash = rows.groupBy(group, "_family", given.alias("given")).agg(F.count("*").alias("n")).where("n > 1").select(F.col(group).alias("_g"), F.col("_family").alias("_f")).distinct()
    clash = materialise(clash, "clash")
    fine = lambda rows: rows.withColumn("number", F.col("nth")).drop("nth", "_family")
    if bounded_rows(clash, 0) is not None:
        return fine(rows)
    same = F.col(group).eqNullSafe(F.col("_g")) & (F.col("_family") == F.col("_f"))
    odd = _settled(rows.join(clash, same, "left_semi").drop("_family"), group, order).drop("nth")
    return fine(rows.join(clash, same, "left_anti")).unionByName(odd)


def with_number(head: Column | str, number: Column, tail: Column) -> Column:
    head = F.col(head) if isinstance(head, str) else head
    return F.concat(head, F.when(number > 1, F.concat(F.lit("-"), number)).otherwise(""), tail)
