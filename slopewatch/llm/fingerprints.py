"""Document fingerprints by a threshold-scaled sketch, in DataFrame functions alone (operator 7).

A sketch keeps every shingle hash below a fixed fraction of the hash range and nothing else.  So the sketch of a union is
the union of the sketches, whatever their sizes: sketches merge, and their overlap estimates similarity and containment
even between texts of very unequal length.

Two fingerprints are compared by their sketches as soon as either text has ``FEWEST`` hashes there: about 200 shingles.
Shorter texts have few hashes below the threshold, or none, so a fingerprint carries a fallback beside the sketch: the next
smallest hashes, until it has FEWEST.  Two short texts are compared up to the smaller of the limits below which each
fingerprint is complete: exactly where both have fewer than FEWEST shingles, else by FEWEST hashes of the union at least.  So
the standard deviation of a likeness is 0.5 / sqrt(FEWEST) = 0.0625 at most, either way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The fraction of the hash range that a sketch keeps, and the hashes that a fingerprint has at least (if the text has).
FRACTION, FEWEST = 5 / 16, 64
TOP = 2**63 - 1


def let(value: Column, use) -> Column:
    """use(value), with the value computed once: inside a function of arrays an expression is computed for each element
    and each mention."""
    return F.element_at(F.transform(F.array(value), use), 1)


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(text: Column, size: int = 5) -> Column:
    """Hashes of runs of ``size`` words; all words as one run if there are fewer; none without words."""
    def of(h: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(h) - size + 1), lambda i: F.xxhash64(F.slice(h, i, F.lit(size))))
        return F.when(F.size(h) >= size, runs).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<long>"))

    return let(word_hashes(text), of)


def limit_of(fraction: float) -> int:
    """The largest hash of the fraction."""
    return round(-(2**63) + fraction * 2**64) if fraction < 1 else TOP


def sketch(hashes: Column, fraction: float = FRACTION) -> Column:
    """The distinct hashes below the threshold, in order: none, if none is that small."""
    return F.array_sort(F.array_distinct(F.filter(hashes, lambda x: x <= limit_of(fraction))))


def merge(a: Column, b: Column) -> Column:
    """The sketch of the union of two sets, from their sketches."""
    return F.array_sort(F.array_union(a, b))


def similarity(a: Column, b: Column) -> Column:
    """Estimate of intersection / union from two sketches; null if they say nothing."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    """Estimate of the share of a's shingles that b has, from two sketches; null if a's sketch is empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(a))


def smallest(hashes: Column, fraction: float = FRACTION, fewest: int = FEWEST) -> Column:
    """The hashes of a fingerprint, in order: the sketch, filled up to ``fewest``."""

    def of(all_: Column) -> Column:
        below = F.size(F.filter(all_, lambda x: x <= limit_of(fraction)))
        return F.slice(all_, F.lit(1), F.greatest(below, F.lit(fewest)))

    return let(F.array_sort(F.array_distinct(hashes)), of)


def complete_to(fp: Column, fraction: float = FRACTION, fewest: int = FEWEST) -> Column:
    """The limit up to which a fingerprint has all hashes of its text."""
    return F.when(F.size(fp) < fewest, F.lit(TOP)).otherwise(F.greatest(F.element_at(fp, -1), F.lit(limit_of(fraction))))


def likeness(a: Column, b: Column, fraction: float = FRACTION, fewest: int = FEWEST) -> Column:
    """Estimate of intersection / union from the hashes of two fingerprints; 1 for two texts without words."""

    def of(limit: Column) -> Column:
        x, y = (F.filter(fp, lambda h: h <= limit) for fp in (a, b))
        return F.struct(F.size(F.array_intersect(x, y)).alias("both"), F.size(F.array_union(x, y)).alias("any"))

    n = let(F.least(complete_to(a, fraction, fewest), complete_to(b, fraction, fewest)), of)
    return let(n, lambda c: F.when(c["any"] == 0, F.lit(1.0)).otherwise(c["both"] / c["any"]))


def as_text(fp: Column) -> Column:
    """Sixteen hexadecimal digits for each hash."""
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def fingerprint_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", fraction: float = FRACTION) -> DataFrame:
    """One row per input row: doc_id, sketch array<long>, hashes array<long>, fingerprint string.

    A null text counts as empty: no hashes and an empty fingerprint.  Other columns are ignored.
    """
    hashes = shingle_hashes(F.coalesce(F.col(text_column).cast("string"), F.lit("")))
    out = docs.select(F.col(id_column).alias("doc_id"), let(hashes, lambda h: F.struct(sketch(h, fraction).alias("sketch"), smallest(h, fraction).alias("hashes"))).alias("_of"))
    return out.select("doc_id", "_of.*").withColumn("fingerprint", as_text(F.col("hashes")))


def in_order(docs: DataFrame, parts: int) -> DataFrame:
    """doc_id, text and a hash of it (``tie``), with the bucket of rows that follow each other by (doc_id, tie).

    Bounds are quantiles of the ids, as many numbers as buckets.  A missing id comes first.  An id that fills several
    buckets, the missing one too, is split among them by ranges of the hash.
    """
    rows = docs.withColumn("tie", F.xxhash64("text"))
    count = rows.agg(F.count("*").alias("all"), F.count("doc_id").alias("known")).first()
    bounds = [int(x) for x in docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)] if parts > 1 and count.known else []
    missing = max(1, parts * (count["all"] - count.known) // max(1, count["all"]))
    single = sorted(set(bounds))
    heavy = {x: bounds.count(x) for x in single if bounds.count(x) > 1}
    step = max(1, int(len(single) ** 0.5))
    table = [single[i : i + step] for i in range(0, len(single), step)]

    def share(n: Column | int) -> Column:
        """A number below n, in the order of the hash."""
        return F.floor((F.col("tie") / 2.0**64 + 0.5) * n).cast("int")

    of = F.lit(0)
    if table:
        heads = F.array(*[F.lit(r[0]) for r in table])
        rest = F.array(*[F.array(*[F.lit(x) for x in r]) for r in table])
        below = F.size(F.filter(heads, lambda x: x < F.col("doc_id")))  # rows whose head is below the id
        inner = F.size(F.filter(F.element_at(rest, F.greatest(below, F.lit(1))), lambda x: x < F.col("doc_id")))
        of = F.when(below == 0, 0).otherwise((below - 1) * step + inner)
    known = F.struct((1 + of).alias("of"), F.lit(0).alias("after"), F.lit(0).alias("part"))
    if heavy:  # smaller ids of the bucket come first, then the id itself
        n = F.element_at(F.create_map(*[F.lit(x) for pair in heavy.items() for x in pair]), F.col("doc_id"))
        known = F.when(n.isNull(), known).otherwise(F.struct((1 + of).alias("of"), F.lit(1).alias("after"), share(n).alias("part")))
    none = F.struct(F.lit(0).alias("of"), F.lit(0).alias("after"), share(missing).alias("part"))
    return rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), none).otherwise(known))


def with_next(docs: DataFrame, parts: int, extra: dict[str, Column]) -> DataFrame:
    """Adds the columns ``extra`` and, as next_<name>, the text and extra columns of the next row by doc_id (nulls
    first, then by a hash of the text), the first row's after the last.  Texts are shuffled once, by buckets of ids; each
    bucket also gets the first row of the next one."""
    rows = in_order(docs, parts)
    first = rows.groupBy("bucket").agg(F.min(F.struct("doc_id", "tie", "text")).alias("row"))
    turn = Window.orderBy("bucket")  # one row for each bucket
    guests = first.select(F.coalesce(F.lag("bucket").over(turn), F.max("bucket").over(Window.partitionBy())).alias("bucket"), "row.*", F.lit(True).alias("guest"))
    both = rows.select("bucket", "doc_id", "tie", "text", F.lit(False).alias("guest")).unionByName(guests)
    both = both.repartition("bucket").withColumns(extra)
    following = Window.partitionBy("bucket").orderBy("guest", "doc_id", "tie", "text")
    return both.withColumns({f"next_{c}": F.lead(c).over(following) for c in ["text", *extra]}).filter("not guest")


def compare_edited(docs: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last floor(n / 2) characters are replaced by the first as
    many of the next document's.

    One row per input row.  Null text counts as empty.  Rows without an id come first; rows that repeat an id, or have
    none, follow each other by a hash of the text; the only row of a table is its own next.  Other columns are ignored.
    """
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(slim, parts, {"hashes": smallest(shingle_hashes(F.col("text")), fraction)})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.withColumn("edited_hashes", smallest(shingle_hashes(F.col("edited")), fraction))
    a, b, c = F.col("hashes"), F.col("edited_hashes"), F.col("next_hashes")
    return rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), as_text(a).alias("fingerprint"), as_text(b).alias("edited_fingerprint"),
        likeness(a, b, fraction).alias("near_edited"), likeness(a, c, fraction).alias("near_next"),
    )


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
