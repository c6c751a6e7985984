"""Document fingerprints: 128-bit SimHash of weighted terms, and a search of all fingerprints within a Hamming radius.

Everything here is DataFrame expressions; texts never leave the JVM.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyfold.llm.common import staged, text_of
from tallyfold.operators.ranking import order_bounds, with_order_bucket

BITS = 64
LANES, SHIFTS = 4, 16
#: Every sixteenth bit, one in each 16-bit lane of a long.
SPREAD = 0x0001_0001_0001_0001
#: Terms whose votes one packed counter takes; weights are 3 at most, so a lane stays below 2^15 and the sum within a long.
CHUNK = 8_192
#: A word with more characters than this counts as one that carries meaning.
SHORT_WORD = 3
GAP = r"[\x09-\x0D ]+"
#: Bits of the number of buckets the documents' order is cut into at most.
ORDER_BITS = 13


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _votes(hashes: dict[str, Column], weight: Column) -> list[Column]:
    """Packed votes: counter j of a hash adds the weight to lane l if bit 16 l + j is set."""
    return [
        F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(SPREAD)) * weight).alias(f"{name}{j}")
        for name, h in hashes.items()
        for j in range(SHIFTS)
    ]


def _bits(name: str) -> Column:
    """64 bits from the lane totals ``{name}{bit}``: set where over half of the weight voted for it."""
    each = [F.when(2 * F.col(f"{name}{b}") > F.col("total"), F.lit(_signed(1 << b))).otherwise(F.lit(0)) for b in range(BITS)]
    return reduce(lambda x, y: x.bitwiseOR(y), each)


def text_fingerprints(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(*keys, hi, lo): fingerprint of each row's ``text``; ``keys`` tell rows apart and are not null.

    Lower-cased words are cut at ASCII white space.  A term is a word with its follower, the last word stands alone;
    each place counts, so a term's weight grows with its frequency, and it is 1, 2 or 3 by how many of its words have
    more than three characters.  A text without words, null included, has fingerprint zero.  If the rows are already
    dealt by some of ``keys``, nothing is shuffled.  Votes are added in packed 16-bit lanes, chunk by chunk, so texts
    of any length count whole.
    """
    words = F.filter(F.split(F.lower(text_of(text)), GAP), lambda w: w != "")
    terms = df.select(*keys, words.alias("_w")).select(*keys, F.posexplode_outer(F.arrays_zip(F.col("_w").alias("a"), F.slice("_w", F.lit(2), F.greatest(F.size("_w"), F.lit(1))).alias("b"))).alias("_at", "_t"))
    a, b = F.col("_t.a"), F.col("_t.b")
    weight = F.when(a.isNull(), 0).otherwise(1 + (F.length(a) > SHORT_WORD).cast("int") + F.coalesce((F.length(b) > SHORT_WORD).cast("int"), F.lit(0)))
    terms = terms.select(*keys, F.floor(F.col("_at") / CHUNK).alias("_chunk"), weight.cast("bigint").alias("_weight"), F.xxhash64(a, b).alias("_x"), F.xxhash64(F.lit("second"), a, b).alias("_y"))
    packed = terms.groupBy(*keys, "_chunk").agg(F.sum("_weight").alias("_total"), *_votes({"x": F.col("_x"), "y": F.col("_y")}, F.col("_weight")))
    lanes = [
        F.sum(F.shiftrightunsigned(f"{name}{j}", SHIFTS * lane).bitwiseAND(F.lit(0xFFFF))).alias(f"{name}_{SHIFTS * lane + j}")
        for name in "xy"
        for lane in range(LANES)
        for j in range(SHIFTS)
    ]
    counted = packed.groupBy(*keys).agg(F.sum("_total").alias("total"), *lanes)
    return counted.select(*keys, _bits("x_").alias("hi"), _bits("y_").alias("lo"))


def likeness(hi: Column, lo: Column, other_hi: Column, other_lo: Column) -> Column:
    """Share of equal bits, 0 to 1."""
    return F.lit(1.0) - distance(hi, lo, other_hi, other_lo) / F.lit(2.0 * BITS)


def distance(hi: Column, lo: Column, other_hi: Column, other_lo: Column) -> Column:
    return F.bit_count(hi.bitwiseXOR(other_hi)) + F.bit_count(lo.bitwiseXOR(other_lo))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, row, own, doc_id, text, next_text): each document beside the next one by descending id.

    After the last comes the first again; a single document is next to itself.  Rows without an id come last, equal ids
    are ordered by a hash of the text, so the order is one of all rows whatever repeats.  Ids are cut into ranges; a
    range gets the first document of the range below as a guest (``own`` false), so texts move once and nothing is
    sorted whole.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    keys = staged(rows.select("doc_id", "hash"), "fingerprint-order")
    bounds = order_bounds(keys, ["doc_id", "hash"], ORDER_BITS)
    # one row per range, at most 2 ** ORDER_BITS of them
    tops = with_order_bucket(keys, ["doc_id", "hash"], "bucket", bounds).groupBy("bucket").agg(F.max(F.struct("doc_id", "hash")).alias("top"))
    tops = sorted((r.bucket, tuple(r.top)) for r in tops.collect())
    above = [(*top, tops[(i + 1) % len(tops)][0]) for i, (_, top) in enumerate(tops)]
    kind = rows.schema["doc_id"].dataType.simpleString()
    guests = docs.sparkSession.createDataFrame(above, f"_id {kind}, _hash bigint, guest int")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))
    placed = with_order_bucket(rows, ["doc_id", "hash"], "mine", bounds).join(F.broadcast(guests), same, "left")
    each = F.array_compact(F.array(F.struct(F.col("mine").alias("bucket"), F.lit(True).alias("own")), F.when(F.col("guest").isNotNull(), F.struct(F.col("guest").alias("bucket"), F.lit(False).alias("own")))))
    dealt = placed.select("doc_id", "text", "hash", F.inline(each))
    # guests come after a range's own rows, also that of the topmost range in the lowest one
    inside = Window.partitionBy("bucket").orderBy(F.desc("own"), F.desc_nulls_last("doc_id"), F.desc("hash"))
    return dealt.select("bucket", F.row_number().over(inside).alias("row"), "own", "doc_id", "text", F.lead("text").over(inside).alias("next_text"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, n_chars, edited_sha256, hi, lo, edited_hi, edited_lo, next_hi, next_lo).

    The edited text has its last floor(n_chars / 2) characters replaced by the first as many of the next document, by
    :func:`with_next`.  Null texts count as empty, repeated rows give repeated rows, an empty table an empty result;
    other columns are ignored.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(text_of("next_text"), F.lit(1), half))
    keys = ["bucket", "row", "own", "doc_id", "n_chars", "edited_sha256"]
    both = with_next(docs, id_col, text_col).select("bucket", "row", "own", "doc_id", F.length("text").cast("bigint").alias("n_chars"), "text", edited.alias("edited"))
    both = both.withColumn("edited_sha256", F.sha2("edited", 256))
    each = both.select(*keys, F.inline(F.array(F.struct(F.lit(False).alias("changed"), "text"), F.struct(F.lit(True).alias("changed"), F.col("edited").alias("text")))))
    each = each.withColumn("doc_id", F.struct("doc_id"))  # a key that is never null itself
    prints = text_fingerprints(each, [*keys, "changed"], "text")
    pick = lambda c, changed: F.max(F.when(F.col("changed") == changed, F.col(c)))
    wide = prints.groupBy(*keys).agg(pick("hi", False).alias("hi"), pick("lo", False).alias("lo"), pick("hi", True).alias("edited_hi"), pick("lo", True).alias("edited_lo"))
    inside = Window.partitionBy("bucket").orderBy("row")
    wide = wide.withColumns({"next_hi": F.lead("hi").over(inside), "next_lo": F.lead("lo").over(inside)})
    return wide.where("own").select(F.col("doc_id.doc_id").alias("doc_id"), *keys[4:], "hi", "lo", "edited_hi", "edited_lo", "next_hi", "next_lo")


# ------------------------------------------------------------------------------------- permuted block tables


def block_masks(radius: int, spare: int) -> list[tuple[int, int]]:
    """(hi, lo) masks of all choices of ``spare`` out of ``radius + spare`` blocks of the 128 bits."""
    blocks = radius + spare
    edges = [round(i * 2 * BITS / blocks) for i in range(blocks + 1)]
    whole = [sum((1 << edges[i + 1]) - (1 << edges[i]) for i in chosen) for chosen in combinations(range(blocks), spare)]
    return [(m >> BITS, m & ((1 << BITS) - 1)) for m in whole]


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = 5, spare: int = 1) -> DataFrame:
    """(q_hi, q_lo, hi, lo, distance): all of ``prints`` (hi, lo distinct) within ``radius`` bits of each of ``queries``.

    Two fingerprints within ``radius`` bits agree in at least ``spare`` of ``radius + spare`` blocks, so each is filed
    under every choice of blocks (one table per choice) and only rows of one table with the same bits there meet.  More
    spare blocks give more tables with longer keys, for billions of fingerprints.  A pair is taken from the first table
    that joins it, so it comes once.  Copies are one fingerprint; nulls are left out.
    """
    masks = [(_signed(h), _signed(low)) for h, low in block_masks(radius, spare)]

    def filed(df: DataFrame, prefix: str) -> DataFrame:
        ways = [F.struct(F.lit(i).alias("way"), F.col("hi").bitwiseAND(F.lit(h)).alias("_h"), F.col("lo").bitwiseAND(F.lit(m)).alias("_l")) for i, (h, m) in enumerate(masks)]
        known = df.where("hi is not null and lo is not null").select("hi", "lo").distinct()
        return known.select(F.col("hi").alias(f"{prefix}hi"), F.col("lo").alias(f"{prefix}lo"), F.inline(F.array(*ways)))

    differ = F.struct(F.col("q_hi").bitwiseXOR(F.col("hi")).alias("h"), F.col("q_lo").bitwiseXOR(F.col("lo")).alias("l"))
    agree = [(differ["h"].bitwiseAND(F.lit(h)) == 0) & (differ["l"].bitwiseAND(F.lit(m)) == 0) for h, m in masks]
    first = F.coalesce(*[F.when(a, F.lit(i)) for i, a in enumerate(agree)])
    apart = distance(F.col("q_hi"), F.col("q_lo"), F.col("hi"), F.col("lo"))
    met = filed(queries, "q_").join(filed(prints, ""), ["way", "_h", "_l"]).where((apart <= radius) & (F.col("way") == first))
    return met.select("q_hi", "q_lo", "hi", "lo", apart.alias("distance"))
