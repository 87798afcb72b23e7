"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Each five-word shingle is hashed once; the hash's high bits choose one of `BINS` bins, which keeps the least of the rest. An empty bin
takes the value of a filled one: for each empty bin the filled bins are ranked by a hash of both numbers, so every document picks
through the same random order (optimal densification). Of each bin `BITS` low-order bits are stored, in hexadecimal. Two bins agree
by chance with probability 2**-BITS; the likeness takes that out.

Defined cases: a null text is an empty one; a text without a word has the empty fingerprint, which is 1 like another empty one and 0 like any
other; a text of fewer than five words has one shingle, all its words. Equal texts have equal fingerprints. A likeness is from 0 to 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textarrays import own_column

BINS, BITS, WORDS = 128, 8, 5
_BIN_SHIFT = 64 - (BINS - 1).bit_length()
#: Blocks of neighbouring ids: coarse and fine bounds, FINE of the latter within each of the former.
COARSE, FINE = 32, 32
#: Ids that aren't numbers and come to the driver to find bounds; a bound's place is off by some 1 / sqrt(SAMPLE) of a block's rows at most.
SAMPLE = 32 * COARSE * FINE
#: Blocks of rows without an id.
NAMELESS = 256


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of the word shingles of a text, repeats included; empty if it has no word."""
    split = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return _of_words(split, words)


def _of_words(split: Column, words: int) -> Column:
    def grams(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - words), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(words)]))
        few = F.array(F.xxhash64(F.array_join(w, " ")))
        return F.when(F.size(w) >= words, many).when(F.size(w) > 0, few).otherwise(F.array().cast("array<bigint>"))

    # The words are bound once by a one-element transform, so that the plan doesn't split the text for each use.
    return F.flatten(F.transform(F.array(split), grams))


def bins(hashes: Column) -> Column:
    """The least hash of each filled bin, in order of bins; the bin is in the high bits."""
    def firsts(ordered: Column) -> Column:
        return F.filter(ordered, lambda x, i: (i == 0) | (F.shiftrightunsigned(x, _BIN_SHIFT) != F.shiftrightunsigned(F.get(ordered, i - 1), _BIN_SHIFT)))

    return F.flatten(F.transform(F.array(F.array_sort(hashes)), firsts))


def densified(filled: Column) -> Column:
    """The stored bits of every bin, an empty one with those of the filled bin it ranks first; empty if none is filled."""
    def dense(own: Column) -> Column:
        number = F.transform(own, lambda x: F.shiftrightunsigned(x, _BIN_SHIFT).cast("int"))
        bits = F.transform(own, lambda x: x.bitwiseAND(F.lit(2**BITS - 1)).cast("int"))
        pick = lambda j: F.array_min(F.transform(own, lambda x: F.struct(F.xxhash64(F.shiftrightunsigned(x, _BIN_SHIFT), j).alias("rank"), x.alias("x"))))["x"]
        return F.flatten(F.transform(F.array(F.map_from_arrays(number, bits)), lambda m: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.coalesce(F.try_element_at(m, j), pick(j).bitwiseAND(F.lit(2**BITS - 1)).cast("int")))))

    return F.when(F.size(filled) > 0, F.flatten(F.transform(F.array(filled), dense))).otherwise(F.array().cast("array<int>"))


def signature(text: Column, words: int = WORDS) -> Column:
    """A text's bins as an array of small integers."""
    return F.flatten(F.transform(F.array(bins(shingle_hashes(F.coalesce(text, F.lit("")), words))), densified))


def packed(bits: Column) -> Column:
    """A signature's bins in hexadecimal, BITS bits each."""
    width = (BITS + 3) // 4
    return F.array_join(F.transform(bits, lambda v: F.lower(F.lpad(F.hex(v), width, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard similarity of two signatures, corrected for chance."""
    agree = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.lit(float(BINS))
    chance = 2.0**-BITS
    corrected = F.greatest(F.lit(0.0), (agree - chance) / (1.0 - chance))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(corrected)


def fingerprints(docs: DataFrame, text: str = "text", fingerprint: str = "fingerprint") -> DataFrame:
    """All columns of docs with the fingerprint of their text."""
    return docs.withColumn(fingerprint, packed(signature(F.col(text).cast("string"))))


def id_blocks(docs: DataFrame, doc_id: str, hashed: Column) -> Column:
    """The number of a row's block of neighbouring (id, hash), rising with them; rows without an id have negative ones, by hash.

    Bounds are quantiles: of the ids, if these are numbers; else of SAMPLE rows' ids and hashes, chosen by a hash, so ids with a
    common beginning, or one id that many rows have, are dealt out as any other.
    """
    dtype = dict(docs.dtypes)[doc_id]
    numeric = dtype in ("tinyint", "smallint", "int", "bigint", "float", "double") or dtype.startswith("decimal")
    if numeric:
        value = F.col(doc_id).cast("double")
        ids = docs.select(value.alias("id")).where("id is not null")
        cuts = ids.approxQuantile("id", [i / (COARSE * FINE) for i in range(1, COARSE * FINE)], 0.0002)
        bounds = [F.lit(x) for x in sorted(set(cuts)) or [0.0]]
    else:
        value = F.struct(F.col(doc_id).cast("string").alias("id"), hashed.alias("hash"))
        ids = docs.where(F.col(doc_id).isNotNull()).select(value.alias("v")).select("v.*")
        found = sorted((r["id"], r["hash"]) for r in ids.orderBy(F.xxhash64("id", "hash")).limit(SAMPLE).collect())
        cuts = sorted({found[i * len(found) // (COARSE * FINE)] for i in range(1, COARSE * FINE)} if found else {("", 0)})
        bounds = [F.struct(F.lit(x).alias("id"), F.lit(h).cast("long").alias("hash")) for x, h in cuts]
    groups = [bounds[i : i + FINE] for i in range(0, len(bounds), FINE)]
    heads, fine = F.array(*[g[0] for g in groups]), F.array(*[F.array(*g) for g in groups])
    coarse = F.size(F.filter(heads, lambda x: x <= value)) - 1
    nameless = F.floor((hashed.cast("double") + F.lit(2.0**63)) / F.lit(2.0**64) * F.lit(NAMELESS)) - F.lit(NAMELESS + 2)
    block = F.when(F.col(doc_id).isNull(), nameless).when(coarse < 0, -1).otherwise(coarse * FINE + F.size(F.filter(F.get(fine, coarse), lambda x: x <= value)))
    return block.cast("int")


def with_next(docs: DataFrame, doc_id: str, carried: list[str]) -> DataFrame:
    """Each row with next_<c> of the row that follows by descending doc_id, for every carried column c; the last is followed by the first.

    Equal ids follow one another by a hash of their carried columns; null ids come last, by that hash. Rows are dealt into blocks of
    neighbouring ids by bounds found on the ids alone, those without an id into blocks of neighbouring hashes, and the first row of each
    block is sent to the block before it too, so the texts are shuffled once and no block or task holds more than its share. Ids may be
    numbers or of any type that is ordered as its text.
    """
    dtype = dict(docs.dtypes)[doc_id]
    order_, block_, place_ = (own_column(docs, x) for x in ("id_order", "id_block", "id_place"))
    hashed = F.xxhash64(*carried)
    order = F.struct(F.col(doc_id).isNotNull().alias("has_id"), F.col(doc_id).alias("id"), hashed.alias("hash"))
    dealt = docs.withColumns({order_: order, block_: id_blocks(docs, doc_id, hashed)})
    tops = {r[0]: (r[1], r[2]) for r in dealt.groupBy(block_).agg(F.max(order_).alias("top")).select(block_, "top.id", "top.hash").collect()}
    names = sorted(tops, reverse=True)  # of blocks, no more than COARSE * FINE + NAMELESS + 2
    before = {b: names[i - 1] for i, b in enumerate(names)}  # the first block follows the last
    table = F.create_map(*[F.lit(x) for b in names for x in (b, before[b])]) if names else F.create_map(F.lit(0), F.lit(0))
    top_hash = F.create_map(*[F.lit(x) for b in names for x in (b, tops[b][1])]) if names else F.create_map(F.lit(0), F.lit(0).cast("long"))
    top_ids = [F.lit(x) for b in names for x in (b, tops[b][0]) if tops[b][0] is not None]
    top_id = F.create_map(*top_ids) if top_ids else F.create_map(F.lit(0), F.lit(None).cast(dtype))
    is_top = F.col(f"{order_}.id").eqNullSafe(F.try_element_at(top_id, F.col(block_))) & (F.col(f"{order_}.hash") == F.try_element_at(top_hash, F.col(block_)))
    own = F.struct(F.col(block_).alias("block"), F.lit(False).alias("guest"))
    guest = F.struct(F.try_element_at(table, F.col(block_)).alias("block"), F.lit(True).alias("guest"))
    placed = dealt.withColumn(place_, F.explode(F.when(is_top, F.array(own, guest)).otherwise(F.array(own))))
    w = Window.partitionBy(f"{place_}.block").orderBy(F.col(f"{place_}.guest").asc(), F.col(order_).desc())
    followed = placed.withColumns({f"next_{c}": F.lead(c).over(w) for c in carried}).where(~F.col(f"{place_}.guest"))
    return followed.drop(order_, block_, place_)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumns({"n_chars": F.char_length("text").cast("long"), "bins": signature(F.col("text"))})
    rows = with_next(docs, "doc_id", ["text", "bins"])
    n = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - n), F.substring(F.col("next_text"), F.lit(1), n))
    rows = rows.withColumn("edited", edited).withColumn("edited_bins", signature(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        packed(F.col("bins")).alias("fingerprint"),
        packed(F.col("edited_bins")).alias("edited_fingerprint"),
        likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"),
        likeness(F.col("bins"), F.col("next_bins")).alias("near_next"),
    )
