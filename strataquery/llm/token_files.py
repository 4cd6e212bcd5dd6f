"""Token-ID files: ORC with integer run-length encoding, row indexes and Bloom filters on document ids.

``write_tokens`` deals documents into ranges of ascending doc_id, encodes each range in its order and writes one ORC file a range:
a row holds part, doc_id, offset (ids of the documents before it in its part), n_tokens and ids (a list of integers, which ORC
stores with run-length encoding). A second, small ORC table has each part's first global position. Stripes are the unit of parallel
reading: a reader takes the stripes that begin in its split. Row indexes on part, doc_id and offset and the Bloom filter on doc_id let
``lookup`` and ``window`` skip row groups and stripes by metadata.

Encoding is the tokenizers library's. A text in a normal form that lower-casing keeps is cut at white space, and at ASCII
punctuation that ends a word; no token reaches over such a cut, so words are encoded once a task and kept in two bounded
generations of a cache. Any other text (special-token strings, capital sigma, characters to be composed) is encoded whole.
By the library's default a special token's string in a text becomes that token.

Defined results: null text is empty and has the end id alone; documents are ordered by doc_id, null last, and rows of one doc_id by a
hash of their text and the text, so only rows alike in both are interchangeable; a doc_id or row that many documents repeat is split over ranges; very long texts
are one row of ids; an empty table gives files without rows; other columns are ignored. Memory: a batch of texts and the cache.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from strataquery.llm.common import bound_batches, sized

END_ID = 1
STRIPE_BYTES = 16 * 1024 * 1024
#: Rows of a row group, the unit that row indexes and Bloom filters skip.
GROUP_ROWS = 1000
#: Words in the younger generation of a task's cache; the older holds as many.
CACHE = 300_000
#: Words encoded by one call.
TOGETHER = 500
#: Punctuation that may be cut off: after a letter or digit and at the end of a word, apostrophes excluded.
TAIL = r"([\pL\pN])([!-&(-/:-@\[-`{-~]+)(\s|$)"
ROW = "part int, doc_id long, offset long, n_tokens long, ids array<int>"


class Encoder:
    """Ids of texts by a tokenizer file, the words of ordinary texts from a cache."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.special = [t.content.lower() for t in self.library.get_added_tokens_decoder().values()]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<i4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: set[str]) -> None:
        """Puts words into the younger generation. Words of letters are one word of the vocabulary's kind each, so many are encoded as one text."""
        for w in [w for w in words if w in self.old]:
            self.young[w] = self.old[w]
            words.discard(w)
        plain, other = [w for w in words if w.isalpha()], [w for w in words if not w.isalpha()]
        for at in range(0, len(plain), TOGETHER):
            part = plain[at : at + TOGETHER]
            ids = np.array(self.library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<i4")
            ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(ends) != len(part):  # a letter of a newer Unicode than the library's
                other += part
                continue
            raw, begin = ids.tobytes(), 0
            for word, end in zip(part, ends.tolist()):
                self.young[word] = raw[begin:end]
                begin = end
        self.young.update(zip(other, self.whole(other)))

    def lowered(self, column: pa.Array) -> tuple[pa.Array, list[int]]:
        """Lower-cased texts, and the rows that must be encoded whole, which are empty here."""
        low = pc.ascii_lower(column)
        other = ~pc.string_is_ascii(column).to_numpy(zero_copy_only=False)
        whole, texts = [], []
        for i in np.flatnonzero(other).tolist():
            text = column[i].as_py()
            small = text.lower()
            if "Σ" in text or not unicodedata.is_normalized("NFC", text) or not unicodedata.is_normalized("NFC", small):
                whole.append(i)
                small = ""
            texts.append(small)
        low = pc.replace_with_mask(low, pa.array(other), pa.array(texts, type=low.type))
        marked = np.zeros(len(column), dtype=bool)
        for token in self.special:
            marked |= pc.match_substring(low, token).to_numpy(zero_copy_only=False)
        if marked.any():
            whole += np.flatnonzero(marked).tolist()
            low = pc.if_else(pa.array(marked), pa.scalar("", type=low.type), low)
        return low, whole

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has."""
        low, whole = self.lowered(column)
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(low, pattern=TAIL, replacement=r"\1 \2\3"))
        coded = lists.flatten().dictionary_encode()
        words, each = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        self.learn({w for w in words if w not in self.young})
        raw = list(map(self.young.__getitem__, words))
        sizes = np.fromiter((len(r) >> 2 for r in raw), dtype=np.int64, count=len(raw))
        known, starts = np.frombuffer(b"".join(raw), dtype="<i4"), np.cumsum(sizes) - sizes
        n = sizes[each]
        upto = np.cumsum(n)
        ids = known[np.repeat(starts[each] - upto + n, n) + np.arange(upto[-1] if len(n) else 0)]
        ends = np.concatenate(([0], upto))[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        counts = np.diff(ends)
        if whole:
            parts = np.split(ids, ends[1:-1])
            for i, own in zip(whole, self.whole([column[i].as_py() for i in whole])):
                parts[i] = np.frombuffer(own, dtype="<i4")
            ids, counts = np.concatenate(parts), np.array([len(x) for x in parts], dtype=np.int64)
        if len(self.young) > CACHE:
            self.young, self.old = {}, self.young
        return ids, counts


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_ranges(docs: DataFrame, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Rows of the files: ranges of ascending doc_id, each in its order."""
    bound_batches(docs.sparkSession)
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("at"), text.alias("text"))
    by = [F.col("doc_id").asc_nulls_last(), F.col("h").asc()]
    # rows of one doc_id are split by their text, and rows alike by where they stand
    rows = rows.repartitionByRange(parts, *by, F.col("at").asc()).sortWithinPartitions(*by, "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, offset = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, n = encoder(tokenizer).encode(batch.column(1))
            upto = np.cumsum(n)
            n, ids = n + 1, np.insert(ids, upto, end_id)
            upto = np.cumsum(n)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], upto)).astype(np.int32)), pa.array(ids))
            columns = [pa.array(np.full(len(n), part, dtype=np.int32)), batch.column(0), pa.array(offset + upto - n), pa.array(n), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "offset", "n_tokens", "ids"])
            offset += int(upto[-1])

    return rows.mapInArrow(run, ROW)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> None:
    """Writes path/tokens and path/parts; what stands there is replaced, so a repeated call leaves the same files."""
    rows = encode_ranges(docs, tokenizer, end_id, id_col, text_col, parts)
    options = {"orc.create.index": "true", "orc.row.index.stride": str(GROUP_ROWS), "orc.stripe.size": str(STRIPE_BYTES), "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "compression": "zstd", "orc.compression.zstd.level": "1"}
    rows.write.mode("overwrite").options(**options).orc(f"{path}/tokens")
    counts = docs.sparkSession.read.schema(ROW).orc(f"{path}/tokens").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row a part
    starts = counts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("first"), F.col("n").alias("part_tokens"))
    starts.coalesce(1).write.mode("overwrite").orc(f"{path}/parts")


def _starts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part int, first long, part_tokens long").orc(f"{path}/parts")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of every document of the files."""
    rows, starts = spark.read.schema(ROW).orc(f"{path}/tokens"), _starts(spark, path)
    return rows.join(sized(starts, 20), "part").select("doc_id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The documents of some ids; the filter reaches the files, where row indexes and Bloom filters skip row groups."""
    return read_tokens(spark, path).where(F.col("doc_id").isin(doc_ids))


def window(spark: SparkSession, path: str, begin: int, end: int) -> DataFrame:
    """The documents that hold ids of the global positions begin to end (exclusive), with those ids alone: doc_id, start, ids.
    The parts that the range meets are told from the small table, and their rows by offset, from metadata."""
    own = _starts(spark, path).where((F.col("first") < end) & (F.col("first") + F.col("part_tokens") > begin))
    first, last = own.agg(F.min("part"), F.max("part")).first()
    rows = read_tokens(spark, path) if first is None else spark.read.schema(ROW).orc(f"{path}/tokens").where(F.col("part").between(first, last)).join(sized(own, 20), "part").select("doc_id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids")
    hit = rows.where((F.col("start") < end) & (F.col("start") + F.col("n_tokens") > begin))
    skip, upto = F.greatest(F.lit(begin) - F.col("start"), F.lit(0)), F.least(F.lit(end) - F.col("start"), F.col("n_tokens"))
    return hit.select("doc_id", (F.col("start") + skip).alias("start"), F.slice("ids", (skip + 1).cast("int"), (upto - skip).cast("int")).alias("ids"))


def digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers) of rows that read_tokens() gave."""
    bound_batches(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            values, ends = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
            crcs = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crcs, type=pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
