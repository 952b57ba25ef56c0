"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph (a line of the text) is hashed to a wide vector of LANES small signed entries. A
document's fingerprint is the sum of its paragraphs' vectors, each lane modulo 2**36. So it
does not depend on the order of the paragraphs, paragraphs are inserted or deleted by adding
or subtracting their vectors (``combined``), and equal texts have equal fingerprints. As the
entries have mean zero, the cosine of two fingerprints estimates the cosine of the two multisets
of paragraphs, which serves as likeness. A text has 2**31 paragraphs at most, so a lane is within
15 * 2**31 < 2**35 of 0 and read as a signed number it is the exact sum, however long the text.

Defined results: a null text counts as empty and is one empty paragraph; ids may repeat (the
rows of an id are then ordered by text), null ids come last in descending order (among
themselves by ranges of a hash of the text, then by text); the next row of the only row is that row
itself; an empty table gives no rows. Ids are integers of up to 64 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Entries of a vector; an entry takes 4 bits of a hash: the odd numbers from -15 to 15.
LANES, ENTRY_BITS = 64, 4
#: Lanes are kept modulo 2**MODULUS_BITS, which the sum of no text can wrap.
MODULUS_BITS = 36
#: Paragraphs whose entries are summed in 16 bits each, so that the highest sum leaves the sign alone.
BLOCK = 2048
#: Neighbours are found within ranges of ids of about so many rows, made from so many quantiles.
RANGE_ROWS, QUANTILES = 2_000, 256
#: The table of ranges is broadcast up to this number of parts of a quantile (24 bytes for each part and quantile).
BROADCAST_PARTS = 1_000

_PER_HASH, _FIELD_BITS = 64 // ENTRY_BITS, 16
_MASK = (1 << ENTRY_BITS) - 1


def paragraphs(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def lanes(text: Column) -> Column:
    """The fingerprint as an array of LANES integers from 0 to 2**MODULUS_BITS - 1.

    Every paragraph is hashed once for each 16 lanes. Entries are summed as they lie in the hash, four
    to a number with 16 bits for each, over blocks of so many paragraphs that no sum overflows.
    """
    seeds, shifts, fields = range(LANES // _PER_HASH), range(0, _FIELD_BITS, ENTRY_BITS), range(0, 64, _FIELD_BITS)
    spread = sum(_MASK << at for at in fields)
    words = [(seed, shift) for seed in seeds for shift in shifts]

    def sums(block: Column) -> Column:
        """The sum of the entries, from 0 to 15, of each lane."""
        hashes = F.transform(block, lambda p: F.array(*[F.xxhash64(p, F.lit(seed)) for seed in seeds]))
        step = lambda acc, h: F.struct(*[(acc[f"w{i}"] + F.shiftrightunsigned(h[seed], shift).bitwiseAND(F.lit(spread))).alias(f"w{i}") for i, (seed, shift) in enumerate(words)])
        lane = lambda acc, seed, at, shift: F.shiftrightunsigned(acc[f"w{words.index((seed, shift))}"], at).bitwiseAND(F.lit((1 << _FIELD_BITS) - 1))
        zero = F.struct(*[F.lit(0).cast("long").alias(f"w{i}") for i in range(len(words))])
        return F.aggregate(hashes, zero, step, lambda acc: F.array(*[lane(acc, seed, at, shift) for seed in seeds for at in fields for shift in shifts]))

    def total(parts: Column) -> Column:
        last = F.floor((F.size(parts) - 1) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda k: sums(F.slice(parts, k * BLOCK + 1, F.lit(BLOCK))))
        added = F.aggregate(blocks, F.array_repeat(F.lit(0).cast("long"), LANES), lambda acc, x: F.zip_with(acc, x, lambda u, v: u + v))
        return F.transform(added, lambda v: F.pmod(v * 2 - F.size(parts).cast("long") * _MASK, F.lit(1 << MODULUS_BITS)))

    return F.transform(F.array(paragraphs(text)), total)[0]


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """The lanes after the paragraphs of ``b`` are inserted into ``a`` (sign 1) or deleted from it (-1).

    The empty multiset has all lanes 0.
    """
    return F.zip_with(a, b, lambda x, y: F.pmod(x + sign * y, F.lit(1 << MODULUS_BITS)))


def as_hex(vector: Column) -> Column:
    return F.lower(F.array_join(F.transform(vector, lambda x: F.lpad(F.hex(x), MODULUS_BITS // 4, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: 1 for equal fingerprints, else the cosine of the lanes taken as signed, at least 0."""
    half, full = 1 << (MODULUS_BITS - 1), 1 << MODULUS_BITS
    signed = lambda v: F.transform(v, lambda x: F.when(x >= half, x - full).otherwise(x).cast("double"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)
    dot = total(F.zip_with(signed(a), signed(b), lambda x, y: x * y))
    norms = F.sqrt(total(F.transform(signed(a), lambda x: x * x)) * total(F.transform(signed(b), lambda x: x * x)))
    return F.when(a == b, F.lit(1.0)).when(norms == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / norms)))


def _id_range(doc_id: Column, cuts: list[int], low: int, parts: int) -> Column:
    """A number that grows with the id: the quantile range it falls in, and which of ``parts`` equal stretches of that."""
    edges = F.split(F.lit(" ".join(map(str, [low, *cuts]))), " ")
    at = F.size(F.filter(edges, lambda c: c.cast("long") <= doc_id))
    if parts == 1:
        return at.cast("long")
    lo = F.element_at(edges, at).cast("double")
    hi = F.coalesce(F.try_element_at(edges, at + 1).cast("double"), lo + 1)
    stretch = F.least(F.floor((doc_id.cast("double") - lo) / (hi - lo) * parts), F.lit(parts - 1))
    return at.cast("long") * parts + F.greatest(stretch, F.lit(0))


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, fingerprint, next_text, next_fingerprint): next is the row that follows in descending order of ids, after the last the first.

    Ids are cut into ranges of about RANGE_ROWS rows. The first row of each range is also sent,
    as a guest, to the range before it, so that every range finds all its neighbours on its own.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    shares = [i / QUANTILES for i in range(1, QUANTILES)]
    n_rows, n_bare, low, found = rows.agg(F.count("*"), F.count_if(F.col("doc_id").isNull()), F.min("doc_id"), F.percentile_approx("doc_id", shares, 10_000)).first()
    parts = 1 + n_rows // (QUANTILES * RANGE_ROWS)
    bucket = _id_range(F.col("doc_id"), sorted({*(found or [])} - {low}), low, parts) if low is not None else F.lit(0).cast("long")
    bare = -1 - F.pmod(F.xxhash64("text"), F.lit(1 + n_bare // RANGE_ROWS))
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), bare).otherwise(bucket))
    tops = rows.groupBy("bucket").agg(F.max("doc_id").alias("top"))  # one row for each range
    order = Window.orderBy(F.col("bucket").desc())
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = tops.select(F.col("bucket").alias("at"), "top", F.coalesce(F.lag("bucket").over(order), F.min("bucket").over(everything)).alias("before"))
    if parts <= BROADCAST_PARTS:
        tops = F.broadcast(tops)
    guests = rows.join(tops, (F.col("bucket") == F.col("at")) & F.col("doc_id").eqNullSafe(F.col("top")))
    guests = guests.groupBy("before", "doc_id").agg(F.min("text").alias("text")).select("doc_id", "text", F.col("before").alias("bucket"), F.lit(1).alias("guest"))
    both = rows.select("doc_id", "text", "bucket", F.lit(0).alias("guest")).unionByName(guests).withColumn("fingerprint", lanes(F.col("text")))
    along = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")
    both = both.withColumns({"next_text": F.lead("text").over(along), "next_fingerprint": F.lead("fingerprint").over(along)})
    return both.where("guest = 0").drop("bucket", "guest")


def edited_text(text: Column, next_text: Column) -> Column:
    """``text`` whose last third (code points, rounded down) is replaced by as much of the head of ``next_text``, or all of it."""
    cut = F.floor(F.char_length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - cut), F.substring(next_text, F.lit(1), cut))


def edited_lanes(text: Column, vector: Column, edited: Column) -> Column:
    """The lanes of ``edited``, which shares a head with ``text``, from the lanes of ``text``.

    Paragraphs that end within the common head stay; those behind it are deleted and the new ones inserted.
    """
    head = F.substring(text, F.lit(1), F.char_length(text) - F.floor(F.char_length(text) / 3).cast("int"))
    kept = F.char_length(head) - F.char_length(F.substring_index(head, "\n", -1))  # up to the last line break
    rest = lambda whole: F.substring(whole, kept + 1, F.char_length(whole))
    return combined(combined(vector, lanes(rest(text)), -1), lanes(rest(edited)))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the column fingerprint, an array of lanes."""
    return docs.withColumn("fingerprint", lanes(F.col(text)))
