"""Owners of tags as bits: an owner's tags are words of 64 bits, so that counting them shuffles a row an order and not one a purchase."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordering import row_numbers
from tessera.plans.materialize import checkpointed

BITS = 64


def _looked_up(lines: DataFrame, numbered: DataFrame) -> DataFrame | None:
    """(order, word, bits) of lines (order, part) by the numbers of parts (part, number), kept in every task; None where a part has two.

    A batch's lines of one order are one row for each word.
    """
    import numpy as np

    table = numbered.where("part is not null").toArrow()
    parts, numbers = table.column("part").to_numpy(), table.column("number").to_numpy()
    sort = np.argsort(parts, kind="stable")
    parts, numbers = parts[sort].astype(np.int64), numbers[sort].astype(np.int32)
    if (parts[1:] == parts[:-1]).any():
        return None
    shared = lines.sparkSession.sparkContext.broadcast((parts, numbers))

    def look(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        known, number = shared.value
        for batch in batches:
            valid = np.asarray(pc.and_(batch.column(0).is_valid(), batch.column(1).is_valid()))
            order, part = (np.asarray(pc.fill_null(batch.column(i), 0)) for i in range(2))
            at = np.minimum(np.searchsorted(known, part), max(len(known) - 1, 0))
            found = valid & (known[at] == part) if len(known) else np.zeros(len(part), bool)
            order, at = order[found], number[at[found]]
            if not len(order):
                continue
            word, bit = at >> 6, np.left_shift(np.uint64(1), (at & 63).astype(np.uint64))
            sort = np.lexsort((word, order))
            order, word, bit = order[sort], word[sort], bit[sort]
            first = np.flatnonzero(np.concatenate([[True], (order[1:] != order[:-1]) | (word[1:] != word[:-1])]))
            bits = np.bitwise_or.reduceat(bit, first).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(order[first]), pa.array(word[first]), pa.array(bits)], names=["order", "word", "bits"])

    return lines.select("order", "part").mapInArrow(look, f"order {dict(lines.dtypes)['order']}, word int, bits long")


def idf(lines: DataFrame, orders: DataFrame, parts: DataFrame, most: int = 4_000_000) -> DataFrame:
    """(tag, idf, df), a checkpoint, over the owners that bought a part of a tag: lines (order, part), orders (order, artist_id), parts (part, tag).

    As vectors.tag_idf of the distinct (artist_id, tag).  Up to so many parts
    are looked up in the tasks, 12 bytes each; more are joined.
    """
    tags = checkpointed(row_numbers(parts.select("tag").distinct(), ["tag"], "number"))
    numbered = checkpointed(parts.join(tags, parts["tag"].eqNullSafe(tags["tag"])).select("part", F.col("number").cast("int").alias("number")))
    kinds, bits = dict(lines.dtypes), None
    if {kinds["order"], kinds["part"], dict(parts.dtypes)["part"]} <= {"int", "bigint"} and numbered.count() <= most:
        bits = _looked_up(lines, numbered)
    if bits is None:
        bits = lines.join(numbered, "part").select("order", F.shiftright("number", 6).alias("word"), F.expr("shiftleft(1L, number & 63)").alias("bits"))
    owned = bits.join(orders, "order").groupBy("artist_id", "word").agg(F.bit_or("bits").alias("bits"))
    # An owner counts once, at the least of its words.
    counted = owned.withColumn("least", F.min("word").over(Window.partitionBy("artist_id")) == F.col("word"))
    by_word = checkpointed(counted.groupBy("word").agg(F.array(*(F.sum(F.getbit("bits", F.lit(b)).cast("long")) for b in range(BITS))).alias("df"), F.count_if(F.col("least") & F.col("artist_id").isNotNull()).alias("n")))
    n = by_word.agg(F.sum("n").alias("n"))
    df = by_word.select("word", F.posexplode("df").alias("bit", "df")).select((F.col("word") * BITS + F.col("bit")).cast("long").alias("number"), "df").where("df > 0")
    counts = df.join(tags, "number").join(F.broadcast(n), F.lit(True))
    return checkpointed(counts.select("tag", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"), "df"))

