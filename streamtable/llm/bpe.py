"""Byte-pair encoding and decoding with a priority queue of merge ranks over a doubly linked list of symbols."""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from streamtable.llm._store import kept, small_batches, tidy

VOCABULARY_BYTES = 64 << 20  # what is broadcast at most
CACHE = 1 << 19  # words whose ids a Python worker remembers while it has texts to encode


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, others from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [], 256
    for b in range(256):
        if b in own:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


def checked(j: dict) -> dict:
    """j, if it describes the kind of tokenizer that Bpe is: NFC, white space as one space, lower case, split by a pattern, byte letters, word ends. Else ValueError."""
    model, normal, split = j["model"], j["normalizer"] or {}, (j["pre_tokenizer"] or {}).get("pretokenizers", [])
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    steps = [(x["type"], x.get("pattern"), x.get("content")) for x in normal.get("normalizers", [])]
    plain &= steps == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
    plain &= [x["type"] for x in split] == ["Split", "ByteLevel"] and (split[0]["behavior"], split[0]["invert"], split[1]["add_prefix_space"], split[1]["use_regex"]) == ("Removed", True, False, False)
    plain &= j["decoder"] is None and not any(a[k] for a in j["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if not plain:
        raise ValueError("this vocabulary file has settings that this encoder does not follow")
    return j


class Bpe:
    """Equals the tokenizers library for files that pass checked()."""

    def __init__(self, spec: str):
        j = checked(json.loads(spec))
        model = j["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.tokens.update({a["id"]: a["content"] for a in j["added_tokens"]})
        self.added = {a["content"]: a["id"] for a in j["added_tokens"]}
        self.split_added = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.ranks[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        parts = j["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(parts[0]["pattern"]["Regex"])
        letters = byte_letters()
        self.inner = [self.vocab[x] for x in letters]
        self.last = [self.vocab[x + self.end] for x in letters]
        self.cache: dict[str, bytes] = {}
        self.settled: dict[str, bool] = {}
        self.spec, self.library = spec, None

    def known(self, text: str) -> bool:
        """Whether Python's tables have all letters of text; only later letters are classed or lower-cased otherwise by some tables."""
        settled = self.settled
        for c in set(text):
            if c not in settled:
                settled[c] = unicodedata.category(c) != "Cn"
            if not settled[c]:
                return False
        return True

    def words(self, text: str) -> list[str]:
        if text.isascii() or self.known(text):
            return self.pattern.findall(self.normal(text))
        if self.library is None:
            from tokenizers import Regex, Tokenizer, pre_tokenizers

            self.library = Tokenizer.from_str(self.spec).normalizer, pre_tokenizers.Split(Regex(self.pattern.pattern), "removed", invert=True)
        normalizer, split = self.library
        return [w for w, _ in split.pre_tokenize_str(normalizer.normalize_str(text))]

    def normal(self, text: str) -> str:
        """NFC and lower case letter by letter, so that no letter depends on its neighbours. White space separates in any form."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def word(self, word: str) -> bytes:
        """Ids of one word: the queue gives the least rank, leftmost first; entries whose symbols have changed since are skipped."""
        raw = word.encode("utf-8", "surrogatepass")
        n = len(raw)
        sym = [self.inner[b] for b in raw]
        sym[-1] = self.last[raw[-1]]
        if n > 1:
            before, after = list(range(-1, n - 1)), [*range(1, n), -1]
            ranks, queue = self.ranks, []
            for i in range(n - 1):
                if (r := ranks.get((sym[i], sym[i + 1]))) is not None:
                    queue.append((r[0], i, r[1], sym[i], sym[i + 1]))
            heapq.heapify(queue)
            while queue:
                _, i, new, a, b = heapq.heappop(queue)
                j = after[i]
                if sym[i] != a or j < 0 or sym[j] != b:
                    continue
                sym[i], sym[j] = new, -1
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                    if (r := ranks.get((new, sym[k]))) is not None:
                        heapq.heappush(queue, (r[0], i, r[1], new, sym[k]))
                h = before[i]
                if h >= 0 and (r := ranks.get((sym[h], new))) is not None:
                    heapq.heappush(queue, (r[0], h, r[1], sym[h], new))
            sym = [s for s in sym if s >= 0]
        return array("I", sym).tobytes()

    def encode(self, text: str) -> np.ndarray:
        out: list[bytes] = []
        cache = self.cache
        for part in self.split_added.split(text) if any(a in text for a in self.added) else [text]:
            if (i := self.added.get(part)) is not None:
                out.append(array("I", [i]).tobytes())
                continue
            for w in self.words(part):
                ids = cache.get(w)
                if ids is None:
                    ids = self.word(w)
                    if len(w) <= 40:
                        if len(cache) >= CACHE:
                            cache.clear()
                        cache[w] = ids
                out.append(ids)
        return np.frombuffer(b"".join(out), np.uint32)

    def decode(self, ids) -> str:
        """Vocabulary strings, joined as a tokenizer without a decoder does."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids.tolist()])


def encoding(spark: SparkSession, vocabulary: str, names: list[str]) -> Callable:
    """A function for mapInArrow, from a text and then the columns names to these, ids and decoded."""
    small_batches(spark)
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()
    if len(spec) > VOCABULARY_BYTES:
        raise ValueError(f"a vocabulary of over {VOCABULARY_BYTES} bytes isn't broadcast")
    checked(json.loads(spec))
    shared = spark.sparkContext.broadcast(spec)

    def run(batches):
        bpe = kept(shared.value, lambda: Bpe(shared.value))
        for batch in batches:
            ids, decoded = [], []
            for text in batch.column(0).to_pylist():
                x = bpe.encode(text or "")
                ids.append(x.view(np.int32))
                decoded.append(bpe.decode(x))
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(decoded, pa.string())], names=[*(f"c{k}" for k in range(len(names))), "ids", "decoded"])

    return run


def encode_decode(docs: DataFrame, vocabulary: str, text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """docs with ids (array of int) and decoded (string) of each whole text under the vocabulary file.

    keep: columns of docs to return, all unless given; columns named ids or decoded give way. Null and empty texts: no ids, "".
    Every row is encoded alone: repeated rows, ties and very long texts are nothing special. Empty table: empty result. Special
    tokens written out in a text become their ids, as in the library's default. Texts with letters that Python's Unicode tables
    don't have yet are normalised and split, not merged, by the library itself. Files with other settings are refused.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("ids", "decoded")]
    run = encoding(docs.sparkSession, vocabulary, names)
    given = docs.select(F.col(text_col).alias("t"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)))
    schema = StructType([*(StructField(f"c{k}", docs.schema[c].dataType) for k, c in enumerate(names)), StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())])
    return given.mapInArrow(tidy(run, keeps=True), schema).toDF(*names, "ids", "decoded")


def digesting(with_ids: bool) -> Callable:
    """A function for mapInArrow, from an id, ids and decoded to the columns of digests()."""
    middle = ["ids"] if with_ids else []

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            flat, offs = np.asarray(lists.values, dtype="<u4"), np.asarray(lists.offsets)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(np.diff(offs).astype(np.int64)), *([lists] if with_ids else []), pa.array([hashlib.sha256(flat[a:b].tobytes()).hexdigest() for a, b in zip(offs[:-1], offs[1:], strict=True)], pa.string()),
                pa.array([hashlib.sha256(x.encode("utf-8")).hexdigest() for x in batch.column(2).to_pylist()], pa.string())], names=["doc_id", "n_tokens", *middle, "ids_sha256", "decoded_sha256"])

    return run


def digested(id_type, with_ids: bool) -> StructType:
    return StructType([StructField("doc_id", id_type), *StructType.fromDDL("n_tokens bigint, " + "ids array<int>, " * with_ids + "ids_sha256 string, decoded_sha256 string").fields])


def digests(encoded: DataFrame, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids if asked for, ids_sha256 (ids as little-endian unsigned 32-bit integers) and decoded_sha256 of encode_decode()'s rows."""
    return encoded.select(F.col(id_col).alias("doc_id"), "ids", "decoded").mapInArrow(tidy(digesting(with_ids), keeps=True), digested(encoded.schema[id_col].dataType, with_ids))


def encoded_digests(docs: DataFrame, vocabulary: str, text_col: str = "text", id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """digests() of encode_decode(), both by one Python worker: one after the other, each task has two at once."""
    run, told = encoding(docs.sparkSession, vocabulary, [id_col]), digesting(with_ids)
    given = docs.select(F.col(text_col).alias("t"), F.col(id_col).alias("c0"))
    return given.mapInArrow(tidy(lambda batches: told(run(batches)), keeps=True), digested(docs.schema[id_col].dataType, with_ids))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")

