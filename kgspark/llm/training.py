"""Which rows a classifier may learn from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import written

#: Characters of all texts of a class that a fit takes at most; a text that does not fit in what is left is passed over.
CLASS_CHARS = 24_000_000


def held_out(id_col: str = "doc_id") -> Column:
    """True for rows that only test: crc32 of the id as text leaves 0 modulo 5. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: dict[int, int]) -> list[tuple[str, int]]:
    """(text, label) of up to per_class[y] rows of class y (the first by a hash of the id), in an order that does not depend on partitions.

    Only the classifier is fitted on it; nothing else is counted here. An id counts once: with its larger label, and with the text of
    the least hash where it has several. Texts of any length are taken, whole, as long as a class has no more than CLASS_CHARS.
    Rows without text, id or label and held-out rows are left out.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("y").alias("y"))
    one_text = F.min(F.struct(F.xxhash64("text").alias("sign"), F.length("text").alias("n"))).alias("t")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("length(text) > 0").groupBy("doc_id").agg(one_text)
    fits = written(known.join(texts, "doc_id").select("doc_id", "y", "t.sign", "t.n", F.xxhash64("doc_id").alias("h")), "labelled")
    chosen = []
    for y in (0, 1):
        left = CLASS_CHARS
        for r in fits.where(F.col("y") == y).orderBy("h", "doc_id").limit(per_class[y]).collect():
            if r.n <= left:
                left -= r.n
                chosen.append((r.doc_id, r.sign, y))
    if not chosen:
        return []
    wanted = F.broadcast(spark.createDataFrame(chosen, "id long, sign long, y int"))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").withColumn("sign", F.xxhash64("text")).join(wanted, ["id", "sign"])
    return [(r.text, r.y) for r in sorted(rows.groupBy("id", "y").agg(F.min("text").alias("text")).collect(), key=lambda r: r.id)]
