"""Line dedup with two Bloom filters.

One scan sends a 64-bit hash of each line's key, once a task, to the filters (see _repeats). A second scan tests every line and
shuffles only the suspected repeats, gathered by key within the task; grouping whole keys confirms them and picks the
smallest document id. The decisions then meet their documents in one join, of which Spark can split hot keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from streamtable.llm._repeats import BITS, suspected
from streamtable.llm._store import held, small_batches, tidy

BLANK = b" \t\n\x0b\x0c\r"
SUSPECTS = "key binary, h binary, least bigint, most bigint, docs array<bigint>"


def line_keys(text: str | None) -> list[bytes]:
    """The key of each line: stripped of [\\x20\\x09-\\x0D], A-Z lower-cased. Null and empty texts are one empty line."""
    return [x.strip(BLANK).lower() for x in (text or "").encode("utf-8", "surrogatepass").split(b"\n")]


def counts(key: bytes, least: int) -> bool:
    """Whether the key has at least so many code points."""
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "surrogatepass")) >= least)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, max_filter_bits: int = BITS) -> DataFrame:
    """docs without the lines whose key, of at least min_chars code points, is in a document with a smaller id.

    Returns the columns of docs, text_col holding the kept lines joined by "\\n", then n_lines (before) and n_dropped, which
    take the place of columns of those names. Null text: one empty line, kept as "". Rows with a null id neither lose lines nor
    make others lose any. Rows with one id are one document: a repeated row changes nothing. Empty table: empty result.
    A key twice in one document and in no other stays.
    """
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null")

    def hashes(data, offs):
        """Of each different key of a text."""
        raw, out, begin = data.tobytes(), [], [0]
        for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            out += [xxhash.xxh3_64_intdigest(k) for k in {x.strip(BLANK).lower() for x in raw[a:b].split(b"\n")} if counts(k, min_chars)]
            begin.append(len(out))
        return np.array(out, np.uint64), begin

    rows, test = suspected(slim, hashes, max_filter_bits)

    def suspects(batches):
        seen: dict[bytes, list[int]] = {}
        n = 0

        def flush():
            if seen:
                keys = list(seen)
                ids = [sorted(set(seen[k])) for k in keys]
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.binary()), "h": pa.array([xxhash.xxh3_128_digest(k) for k in keys], pa.binary()), "least": pa.array([x[0] for x in ids], pa.int64()), "most": pa.array([x[-1] for x in ids], pa.int64()), "docs": pa.array(ids, pa.list_(pa.int64()))})

        for batch in batches:
            twice = test(batch.column(2))
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys = [k for k in set(line_keys(text)) if counts(k, min_chars)]
                if keys:
                    for j in np.flatnonzero(twice.has(np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys)))):
                        seen.setdefault(keys[j], []).append(i)
                        n += 1
            if n >= 200_000:
                yield from flush()
                seen, n = {}, 0
        yield from flush()

    found = held(rows.mapInArrow(tidy(suspects), SUSPECTS))
    sure = found.groupBy("key").agg(F.min("least").alias("keep"), F.max("most").alias("last"), F.first("h").alias("h")).where("keep < last").select("h", "keep")
    drops = found.where("size(docs) > 0").select("h", "docs").join(sure, "h").select("h", "keep", F.explode("docs").alias("id")).where("id > keep").groupBy("id").agg(F.collect_set("h").alias("drop"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("row"), F.col(id_col).cast("bigint").alias("own"))
    at = docs.columns.index(text_col)
    keep = [k for k, c in enumerate(docs.columns) if c.lower() not in ("n_lines", "n_dropped")]

    def cut(batches):
        for batch in batches:
            row = batch.column(0)
            columns = row.flatten()
            texts, lines, dropped = [], [], []
            for text, drop in zip(columns[at].to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys = line_keys(text)
                lines.append(len(keys))
                if drop:
                    drop = set(drop)
                    kept = [x for x, k in zip(text.split("\n"), keys, strict=True) if not (counts(k, min_chars) and xxhash.xxh3_128_digest(k) in drop)]
                    texts.append("\n".join(kept))
                    dropped.append(len(keys) - len(kept))
                else:
                    texts.append(text or "")
                    dropped.append(0)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*(columns[k] for k in keep), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=[*(f"c{k}" for k in keep), "n_lines", "n_dropped"])

    schema = StructType([*(StructField(f"c{k}", StringType() if k == at else docs.schema[k].dataType) for k in keep), StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    met = whole.join(drops, whole["own"] == drops["id"], "left").select("row", "drop")
    return met.mapInArrow(tidy(cut), schema).toDF(*(docs.columns[k] for k in keep), "n_lines", "n_dropped")
