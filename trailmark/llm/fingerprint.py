"""Document fingerprints: a homomorphic multiset hash over paragraphs, in DataFrame functions only.

A paragraph is a line. It is hashed into a vector of EXACT numbers (of its whole text, modulo 2^32) and LANES numbers
(sums of +1 and -1 hashed from its word triples, modulo 2^16). A document's fingerprint is the sum of its paragraphs'
vectors, so it doesn't depend on their order, and a paragraph is inserted or deleted by adding or subtracting its
vector. The exact numbers decide equality; the lanes estimate how much two documents share.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm._arrow import cut

#: 32-bit numbers of the exact part (256 bits) and lanes of the estimate; two lanes share a sum, so LANES is even.
EXACT, LANES = 8, 128
_LOW = 0xFFFFFFFF
#: Two counters of 31 bits in one sum: bit 0 and bit 31. A text has under 2^31 words, so they never run into each other.
_PAIR = 1 | 1 << 31


def multiset_sums(texts: DataFrame) -> DataFrame:
    """texts: key columns and `text`. Returns the keys, `grams` (count), e0.. (exact sums) and s0.. (packed lane sums).

    Paragraphs with fewer than three words are one gram; blank ones count in the exact part only.
    """
    keys = [c for c in texts.columns if c != "text"]
    paragraphs = texts.select(*keys, F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("p"))
    words = paragraphs.select(*keys, "p", F.filter(F.split("p", r"[\x20\t\r\x0b\x0c]+"), lambda w: w != "").alias("a"))
    words = words.select(*keys, "p", "a", F.slice("a", 2, F.greatest(F.size("a"), F.lit(1))).alias("b"), F.slice("a", 3, F.greatest(F.size("a"), F.lit(1))).alias("c"), F.size("a").alias("n"))
    short = F.array(F.struct(F.array_join("a", " ").alias("a"), F.lit("").alias("b"), F.lit("").alias("c")))
    triples = F.when(F.col("n") >= 3, F.slice(F.arrays_zip("a", "b", "c"), 1, F.greatest(F.col("n") - 2, F.lit(1)))).otherwise(short)
    grams = words.select(*keys, "p", "n", F.posexplode(triples).alias("k", "g"))
    # The exact part belongs to the paragraph, so only its first gram carries it.
    exact = [F.when(F.col("k") == 0, F.xxhash64(F.lit(i), "p")).otherwise(F.lit(0)).alias(f"x{i}") for i in range(EXACT // 2)]
    hashed = grams.select(*keys, *exact, F.when(F.col("n") > 0, F.xxhash64("g")).alias("u"), F.when(F.col("n") > 0, F.xxhash64(F.lit(1), "g")).alias("v"))
    hashed = hashed.withColumn("w", F.col("u").bitwiseXOR(F.shiftleft("v", 17)))
    half = lambda c, i: (F.shiftrightunsigned(c, 32) if i else c).bitwiseAND(F.lit(_LOW))
    sums = [F.sum(half(F.col(f"x{i // 2}"), i % 2)).alias(f"e{i}") for i in range(EXACT)]
    # Bit b and bit b + 31 of a hash are two lanes; 31 of these pairs come from each hash.
    lanes = [F.coalesce(F.sum(F.shiftrightunsigned("uvw"[j // 31], j % 31).bitwiseAND(F.lit(_PAIR))), F.lit(0)).alias(f"s{j}") for j in range(LANES // 2)]
    return hashed.groupBy(*keys).agg(F.count("u").alias("grams"), *sums, *lanes)


def fingerprint_of() -> Column:
    """array<bigint> from the columns of multiset_sums: two exact numbers in each of the first 4, four lanes in each other."""
    mask = F.lit((1 << 31) - 1)
    ones = [f(F.col(f"s{j}")) for f in (lambda c: c.bitwiseAND(mask), lambda c: F.shiftrightunsigned(c, 31)) for j in range(LANES // 2)]
    lanes = [(F.col("grams") - 2 * c).bitwiseAND(F.lit(0xFFFF)) for c in ones]
    exact = [F.col(f"e{i}").bitwiseAND(F.lit(_LOW)) for i in range(EXACT)]
    pack = lambda part, width: reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(c, width * i) for i, c in enumerate(part)])
    return F.array(*[pack(exact[i : i + 2], 32) for i in range(0, EXACT, 2)], *[pack(lanes[i : i + 4], 16) for i in range(0, LANES, 4)])


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of two multisets together (sign 1), or of the first without the second (sign -1)."""

    def added(x: Column, y: Column, width: int) -> Column:
        mask = F.lit((1 << width) - 1)
        part = lambda c, at: F.shiftrightunsigned(c, at).bitwiseAND(mask)
        return reduce(lambda p, q: p.bitwiseOR(q), [F.shiftleft((part(x, at) + sign * part(y, at)).bitwiseAND(mask), at) for at in range(0, 64, width)])

    exact = F.zip_with(F.slice(a, 1, EXACT // 2), F.slice(b, 1, EXACT // 2), lambda x, y: added(x, y, 32))
    return F.concat(exact, F.zip_with(F.slice(a, EXACT // 2 + 1, LANES // 4), F.slice(b, EXACT // 2 + 1, LANES // 4), lambda x, y: added(x, y, 16)))


def to_hex(fingerprint: Column) -> Column:
    """16 hex digits for each of its numbers."""
    return F.lower(F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated cosine of two documents' word-triple counts, 0 to 1: 1 for equal fingerprints, 0 if just one has no words."""

    def lane(x: Column, at: int) -> Column:
        # Moved to the top and back, so that the sign bit of the 16 is kept.
        return F.shiftright(F.shiftleft(x, 48 - at), 48)

    lanes = lambda v: F.slice(v, EXACT // 2 + 1, LANES // 4)
    four = lambda x, y: reduce(lambda p, q: p + q, [lane(x, at) * lane(y, at) for at in (0, 16, 32, 48)])
    dot = lambda p, q: F.aggregate(F.zip_with(lanes(p), lanes(q), four), F.lit(0).cast("bigint"), lambda s, v: s + v).cast("double")
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(a == b, F.lit(1.0)).when(norm == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b) / norm)))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text): the id in a struct, so that a null one is a value like others, the least; null texts are empty."""
    return docs.select(F.struct(F.col(id_col).alias("id")).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))


def _counted(rows: DataFrame) -> DataFrame:
    """Rows equal in id and text as one, with `sha` and `copies`."""
    rows = rows.withColumn("sha", F.sha2("text", 256))
    return rows.groupBy("id", "sha").agg(*[F.first(c).alias(c) for c in rows.columns if c not in ("id", "sha")], F.count(F.lit(1)).alias("copies"))


def _as_often(rows: DataFrame) -> DataFrame:
    """Each row `copies` times."""
    return rows.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).drop("copies")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint array) of every row's whole text; null and empty texts are one empty paragraph.

    Rows with equal ids, or without one, are told apart by their texts; rows equal in both are worked on once and come as
    often as they are in the input.
    """
    sums = multiset_sums(_counted(_keyed(docs, id_col, text_col)))
    return _as_often(sums.select(F.col("id.id").alias(id_col), fingerprint_of().alias("fingerprint"), "copies"))


def next_ids(ids: DataFrame) -> DataFrame:
    """(id, next_id): the next larger one of each distinct id, the first after the last.

    Ids are range-partitioned and ordered inside each range. The ranges' ends meet in a table with a row for each
    range, so no task holds more than a range.
    """
    ids = cut(ids.distinct().repartitionByRange("id").withColumn("part", F.spark_partition_id()))
    inner = ids.withColumn("next_id", F.lead("id").over(Window.partitionBy("part").orderBy("id")))
    ends = ids.groupBy("part").agg(F.min("id").alias("low"))
    order = Window.orderBy("part")
    after = ends.select("part", F.coalesce(F.lead("low").over(order), F.min("low").over(Window.partitionBy())).alias("after"))
    return inner.join(after, "part", "left").select("id", F.coalesce("next_id", "after").alias("next_id"))


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, next_id, n_chars, text, edited), the ids in structs: the edit takes the last floor(n_chars/2) code points
    away and appends the first as many (or all) of the next document's text, in ascending order of ids, a null id before
    all others; the first follows the last.

    Null texts are empty. Where rows share an id, each is edited for itself, and the smallest fitting head of the next
    id's texts is taken. The texts are shuffled once by id and their heads (half of them at most) once more.
    """
    # Read twice below with the same columns, so that Spark shuffles it once.
    texts = _keyed(docs, id_col, text_col)
    half = F.floor(F.char_length("text") / 2).cast("int")
    sizes = texts.groupBy("id").agg(F.max(half).alias("half"))
    links = cut(sizes.join(next_ids(texts.select("id")), "id"))
    wanted = links.select(F.col("next_id").alias("id"), F.col("id").alias("target"), "half")
    heads = texts.join(wanted, "id").select("target", F.substring("text", F.lit(1), F.col("half")).alias("head"))
    heads = heads.groupBy("target").agg(F.min("head").alias("head"))
    both = texts.join(links.select("id", "next_id"), "id").join(heads, F.col("id") == F.col("target"))
    n = F.char_length("text")
    edited = F.concat(F.substring("text", F.lit(1), (n - half).cast("int")), F.substring("head", F.lit(1), half))
    return both.select("id", "next_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit, and how alike the fingerprints say they are.

    Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hex), near_edited, near_next, a row for each row of
    the input: rows equal in id and text are worked on once. Where the next id has several texts, near_next is to the one
    with the least fingerprint. Lanes hold 16 bits, so a word triple that a text repeats over 32,767 times makes its
    likeness (never its equality) meaningless.
    """
    rows = _counted(with_edits(docs, id_col, text_col).withColumn("edited_sha256", F.sha2("edited", 256)))
    versions = F.explode(F.array(F.struct(F.lit(0).alias("edit"), F.col("text").alias("text")), F.struct(F.lit(1).alias("edit"), F.col("edited").alias("text"))))
    keys = ["id", "next_id", "n_chars", "sha", "edited_sha256", "copies"]
    sums = multiset_sums(rows.select(*keys, versions.alias("v")).select(*keys, "v.edit", "v.text"))
    prints = sums.select(*keys, "edit", fingerprint_of().alias("f"))
    pick = lambda e: F.max(F.when(F.col("edit") == e, F.col("f")))
    prints = cut(prints.groupBy(*keys).agg(pick(0).alias("f"), pick(1).alias("g")))
    following = prints.groupBy(F.col("id").alias("follows")).agg(F.min("f").alias("h"))
    both = prints.join(following, F.col("next_id") == F.col("follows"), "left")
    return _as_often(both.select(F.col("id.id").alias(id_col), "n_chars", "edited_sha256", to_hex(F.col("f")).alias("fingerprint"), to_hex(F.col("g")).alias("edited_fingerprint"), likeness(F.col("f"), F.col("g")).alias("near_edited"), likeness(F.col("f"), F.col("h")).alias("near_next"), "copies"))
