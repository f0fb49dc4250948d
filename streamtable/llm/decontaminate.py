"""Benchmark decontamination by MinHash containment search, in DataFrame functions only.

A document's shingles are hashed and sorted in place. The range of hashes is cut into bins, a power of two that grows with the
size of the document (its size partition), and the least hash of each bin is the document's signature: one permutation, every bin
of which is a hash function. As a document has at most one shingle for 64 bins, a shared shingle is the least of its bin in the
document with a chance of over 0.992. In the item, a hash that is the least of its bin stays so in all finer partitions, so one row
holds for all of them. An item is searched for by its rarest shingles among items, so many of them that at least four (all, if it has
fewer) are in any document that holds enough of it: what many items share multiplies nothing. Pairs that agree in enough bins
to reach the threshold are candidates; the share of the item's shingles, compared as text, decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from streamtable.llm._store import stored

BROADCAST_BYTES = 32 << 20  # of item shingles or of candidates, as measured; more are shuffled
SHARED = 4  # probes of an item that a document which holds it has at least


def words_of(text: str) -> str:
    """SQL for the lower-cased words of a text column, an empty array if it has none."""
    bare = f"trim(BOTH concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)) FROM lower(coalesce({text}, '')))"
    return f"case when {bare} = '' then cast(array() as array<string>) else split({bare}, '[ \\\\t-\\\\r]+') end"


def let(name: str, value: str, body: str) -> str:
    """SQL for body with name bound to value, which is evaluated once, whatever the optimizer merges."""
    return f"transform(array({value}), {name} -> {body})[0]"


def each_shingle(n: int, of: str) -> str:
    """SQL for the array of `of` over all n-word shingles of w, where {} stands for the shingle's words; fewer words make one shingle."""
    return f"case when size(w) >= {n} then transform(sequence(0, size(w) - {n}), i -> {of.format(', '.join(f'get(w, i + {k})' for k in range(n)))}) when size(w) > 0 then array({of.format('array_join(w, chr(32))')}) else array() end"


def hashes_of(text: str, n: int) -> str:
    return let("w", words_of(text), f"sort_array(cast({each_shingle(n, 'xxhash64({})')} as array<bigint>))")


def shingles_of(text: str, n: int) -> str:
    return let("w", words_of(text), f"array_distinct(cast({each_shingle(n, 'concat_ws(chr(32), {})')} as array<string>))")


def small(df: DataFrame) -> DataFrame:
    """df, which must be stored, to be broadcast if its measured size allows that."""
    texts = [F.sum(F.octet_length(F.col(c).cast("string")) if t == "string" else F.lit(0)) for c, t in df.dtypes]
    n, *size = df.agg(F.count("*"), *texts).first()
    return F.broadcast(df) if n * 24 * len(df.columns) + sum(x or 0 for x in size) <= BROADCAST_BYTES else df


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", words: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of documents that hold at least threshold of an item's distinct shingles.

    Lower-cased words split at [\\x20\\x09-\\x0D]; with fewer words than a shingle has, the sequence is one shingle, which only
    such short texts share. Null, empty and blank texts, and rows with a null id, are in no pair. Repeated rows and rows of one id give one row
    a pair, with the largest share. Empty tables: empty result.
    """
    given = items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("t")).where("item_id is not null")
    # the least number of leading bits by which the hash differs from the one before it
    first = "case when j = 0 then 0 when (x ^ get(h, j - 1)) < 0 then 1 else 65 - length(bin(x ^ get(h, j - 1))) end"
    bins = given.select("item_id", F.expr(hashes_of("t", words)).alias("h")).select("item_id", F.expr(let("h", "h", f"transform(h, (x, j) -> named_struct('x', x, 'bits', {first}))")).alias("b")).select("item_id", F.explode("b").alias("b"))
    bins = stored(bins.groupBy("item_id", "b.x").agg(F.min("b.bits").alias("bits")))
    often = bins.groupBy("x").agg(F.count("*").alias("often"))
    rarest = W.partitionBy("item_id").orderBy("often", "x")
    held = bins.join(often, "x").select("item_id", "x", "bits", F.row_number().over(rarest).alias("r"), F.count("*").over(W.partitionBy("item_id")).alias("n"))
    held = held.withColumn("least", F.ceil(F.col("n") * threshold - 1e-9).cast("int"))
    # of any `least` of n shingles, min(least, SHARED) are among the n - least + SHARED rarest; two of SHARED bins at least then agree
    probes = stored(held.where(F.col("r") <= F.col("n") - F.col("least") + SHARED).select("item_id", "x", "bits", F.when(F.col("least") < SHARED, 1).otherwise(2).alias("wanted")))
    keys = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).where("doc_id is not null")
    head = "filter(h, (x, j) -> j = 0 or shiftrightunsigned(x, 64 - bits) <> shiftrightunsigned(get(h, j - 1), 64 - bits))"
    signature = let("h", hashes_of("t", words), let("bits", "length(bin(64L * size(h) - 1))", f"named_struct('bits', bits, 'least', {head})"))
    least = keys.select("doc_id", F.expr(signature).alias("s")).select("doc_id", F.col("s.bits").alias("doc_bits"), F.explode("s.least").alias("x"))
    agree = least.join(small(probes), "x").where("doc_bits >= bits").groupBy("doc_id", "item_id").agg(F.count_distinct("x").alias("agree"), F.max("wanted").alias("wanted"))
    pairs = stored(agree.where("agree >= wanted").select("doc_id", "item_id"))
    near = keys.join(small(stored(pairs.select("doc_id").distinct())), "doc_id", "left_semi")
    told = given.select("item_id", F.explode(F.expr(shingles_of("t", words))).alias("s")).distinct()
    wanted = stored(told.join(told.groupBy("item_id").agg(F.count("*").alias("n_item")), "item_id"))
    known = small(stored(wanted.select("s").distinct()))
    text = near.select("doc_id", F.xxhash64("t").alias("tag"), F.explode(F.expr(shingles_of("t", words))).alias("s")).join(known, "s", "left_semi").distinct()
    asked = pairs.join(small(wanted), "item_id")
    shared = text.join(asked, ["doc_id", "s"]).groupBy("doc_id", "tag", "item_id", "n_item").agg(F.count("*").alias("n_shared"))
    shared = shared.groupBy("doc_id", "item_id", "n_item").agg(F.max("n_shared").alias("n_shared"))
    return shared.withColumn("containment", F.col("n_shared") / F.col("n_item")).where(F.col("containment") >= threshold).select("doc_id", "item_id", "n_item", "n_shared", "containment")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without those in contamination(). Rows with a null id stay."""
    found = stored(contamination(docs, items, id_col=id_col, **options).select(F.col("doc_id").alias("_contaminated")).distinct())
    return docs.join(small(found), docs[id_col] == found["_contaminated"], "left_anti")
