"""Fingerprints of documents as sums of vectors hashed from their paragraphs.

A fingerprint does not depend on the order of paragraphs, and adding or taking away a paragraph adds or
subtracts that paragraph's vector: a changed document is not hashed again as a whole. Every lane is a sum
modulo 2**20; three lanes share one long, each with a guard bit, so a sum of longs sums the lanes.
All of it is column arithmetic.

A vector has three parts: a count of sentences, lanes hashed from the whole paragraph (two texts with the
same lanes have the same paragraphs, up to chance of 2**-240), and lanes that each count one hash bit
of the sentences of the paragraph. Taken as signs, the latter are projections of the multiset of sentences: their
normalised product estimates how much two documents share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import positions, whole_text

LANE = 21
MASK = sum(((1 << 20) - 1) << (LANE * i) for i in range(3))
BITS = sum(1 << (LANE * i) for i in range(3))
EXACT = 4
SIGNS = LANE


def _sum_lanes(hashes: Column, hashed) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("bigint"), lambda acc, h: (acc + hashed(h)).bitwiseAND(F.lit(MASK)))


def with_vector(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the fingerprint vector of a text, as longs: count, EXACT longs of whole paragraphs, SIGNS longs of sentences.

    A paragraph is a line with a non-space character; a sentence is what lies between full stops, exclamation
    and question marks in it. The empty text has the zero vector. Texts are cut and hashed in a projection of
    their own, once for all lanes.
    """
    filled = lambda parts: F.filter(parts, lambda p: F.trim(p) != "")
    cut = df.withColumn("__paragraphs", filled(F.split(text, "\n"))).withColumn("__sentences", F.transform(filled(F.split(text, "[\n.!?]+")), lambda s: F.xxhash64(F.trim(s))))
    exact = [_sum_lanes(F.col("__paragraphs"), lambda p, i=i: F.xxhash64(F.lit(i), p).bitwiseAND(F.lit(MASK))) for i in range(EXACT)]
    signs = [_sum_lanes(F.col("__sentences"), lambda h, i=i: F.shiftrightunsigned(h, i).bitwiseAND(F.lit(BITS))) for i in range(SIGNS)]
    return cut.withColumn(name, F.array(F.size("__sentences").cast("bigint"), *exact, *signs)).drop("__paragraphs", "__sentences")


def add_vectors(a: Column, b: Column, sign: int = 1) -> Column:
    """Vector of the union of two paragraph multisets, or (sign -1) of their difference."""

    def lane(x: Column, i: int) -> Column:
        return F.shiftright(x, LANE * i).bitwiseAND(F.lit((1 << 20) - 1))

    def both(x: Column, y: Column) -> Column:
        parts = [F.shiftleft((lane(x, i) + sign * lane(y, i)).bitwiseAND(F.lit((1 << 20) - 1)), LANE * i) for i in range(3)]
        return parts[0].bitwiseOR(parts[1]).bitwiseOR(parts[2])

    return F.zip_with(a, b, both)


def as_text(v: Column) -> Column:
    """The vector as hexadecimal digits, 16 per long."""
    return F.array_join(F.transform(v, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimate of 2 x shared / (sentences of both), 0 to 1; 1 for equal vectors, also two empty ones."""

    def product(x: Column, y: Column) -> Column:
        def lanes(v: Column, n: Column) -> list[Column]:
            return [2 * F.shiftright(v, LANE * i).bitwiseAND(F.lit((1 << 20) - 1)) - n for i in range(3)]

        def dot(s: Column, t: Column) -> Column:
            return sum((p * q for p, q in zip(lanes(s, F.element_at(x, 1)), lanes(t, F.element_at(y, 1)), strict=True)), F.lit(0))

        signs = lambda v: F.slice(v, EXACT + 2, SIGNS)
        return F.aggregate(F.zip_with(signs(x), signs(y), dot), F.lit(0).cast("bigint"), lambda acc, p: acc + p)

    shared = F.least(F.greatest(2.0 * product(a, b) / F.nullif(product(a, a) + product(b, b), F.lit(0)), F.lit(0.0)), F.lit(1.0))
    return F.when(a == b, 1.0).otherwise(F.coalesce(shared, F.lit(0.0)))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprint of each document and of its edited text, and how alike they and the next document's are.

    The edited text has the last floor(n_chars / 2) code points replaced by as many (or all) of the next
    document in descending doc_id; after the last comes the first. Documents with equal doc_id follow one
    another by the hash of their text; rows that are equal in both stand in one place and get equal results.
    A null doc_id comes last. Null text is empty. A single document is its own next one.

    The order is settled on ids and lengths. Texts are dealt once by row key; of a document only as many
    characters are sent to the one before it as that one takes.
    """
    own = whole_text()
    name = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), own), 256)
    rows = docs.select("doc_id", own.alias("text"), name.alias("name"))
    places = positions(
        rows.select("doc_id", "name", F.length("text").alias("n_chars")).distinct(), [F.col("doc_id").desc_nulls_last(), F.col("name")], "place"
    )
    count = places.agg(F.max("place")).first()[0] or 1
    following = places.select(F.col("name").alias("before"), F.floor(F.col("n_chars") / 2).cast("int").alias("half"), (F.col("place") % count + 1).alias("place"))
    takes = places.select("name", "place").join(following, "place").select("name", "before", "half")
    giving = with_vector(rows.join(takes.hint("shuffle_hash"), "name"), "text", "next_vector")
    sent = giving.select(F.col("before").alias("name"), F.col("doc_id").alias("next_doc_id"), F.expr("substring(text, 1, half)").alias("tail"), "next_vector").dropDuplicates(["name"])
    met = rows.join(sent.hint("shuffle_hash"), "name").withColumn("n_chars", F.length("text").cast("bigint"))
    edited = met.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 2) as int))"), "tail"))
    vectors = with_vector(with_vector(edited, "text", "v"), "edited", "ev")
    return vectors.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("v")).alias("fingerprint"), as_text(F.col("ev")).alias("edited_fingerprint"),
        likeness(F.col("v"), F.col("ev")).alias("near_edited"), likeness(F.col("v"), F.col("next_vector")).alias("near_next"), "next_doc_id",
    )
