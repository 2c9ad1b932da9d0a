"""Token ids in wavelet matrices: one compressed file per shard.

``write_shards`` deals the documents by ascending id, encodes every whole text and writes files of
at most ``SHARD_TOKENS`` ids (a single longer document gets a file of its own). A file holds the ids
as a wavelet matrix: one bit plane per bit of an id, highest first, where each plane's zeros and
then its ones make up the next plane's order. Planes are cut into blocks, each compressed (zstd) where that
helps, with the rank at every block's start, so ``access``, ``rank`` (counting) and ``select``
(occurrence lookup) read one block per plane.

File: b"MRWM1", a little-endian header length, a JSON header (number of ids, planes, zeros per plane,
block length in bits, where each block begins, ranks, ids and starts of documents), then the blocks.
The file's name carries its partition and its place there, so that name order is document order;
files appear under their names when complete, so a task that runs twice leaves the same file.

Defined results: NULL text is empty; every document ends with the end id; rows with a NULL id come
first; rows of equal ids are ordered by their text's hash; ids may have any type that can be ordered
and cast from a string; a very long text gets a file of its own; an empty table writes no file; only
the id and text columns are read, so others may have any name.
"""

from __future__ import annotations

import json
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType, LongType
from pyspark.sql.window import Window

from millrace.llm.common import materialize, read_table, register, shared_path, shuffle_parts, texts

MAGIC = b"MRWM1"
END_ID = 1
SHARD_TOKENS = 1 << 21
BLOCK_BITS = 1 << 17
#: words whose ids a worker process remembers, about 200 bytes each, twice
CACHE_WORDS = 1 << 19
#: marks that the vocabulary's splitter takes for one run when they follow each other; not the
#: apostrophe, which begins contractions, nor the signs of the added tokens
_MARKS = b".,!?;:%$#&*()[]\"-_/@+=~^`{}"


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=1 << 16)
def _stays_letter(c: str) -> bool:
    """Whether the normaliser leaves a letter last: some become a letter and a combining sign, which
    the splitter takes for the beginning of the marks that follow."""
    return unicodedata.category(unicodedata.normalize("NFC", c).lower()[-1])[0] == "L"


class WordEncoder:
    """Ids of a text, word by word: the vocabulary's normaliser turns white space into single spaces
    and its splitter drops them, so a text's ids are its words' ids in a row. Ids of the words used
    last are remembered, in two generations of at most ``cache_words`` each, as little-endian bytes.
    The vocabulary has small letters only, so words are looked up with A-Z lower-cased; a run of
    ASCII marks after letters is split off, as the splitter does it, where the letters end in one
    after the normaliser too."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # Spark's tasks are the parallel units
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.last = np.zeros(size, bool)                 # tokens that end a run of letters, a digit or a run of marks
        for token, i in self.tokenizer.get_vocab().items():
            self.last[i] = token.endswith("</w>")
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end = np.array([END_ID], self.dtype).tobytes()
        self.room = cache_words
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _encode(self, letters: list[bytes], others: list[bytes]) -> None:
        """Encode words of letters many at a time: each ends with its only last token."""
        size = self.dtype.itemsize
        for i in range(0, len(letters), 512):
            part = letters[i:i + 512]
            ids = self._ids(b" ".join(part).decode())
            cuts = (np.flatnonzero(self.last[ids]) + 1).tolist()
            if len(cuts) != len(part):                   # a letter that the normaliser takes apart
                others += part
                continue
            raw = ids.tobytes()
            self.young.update(zip(part, [raw[x * size:y * size] for x, y in zip([0, *cuts], cuts)]))
        for w in others:
            self.young[w] = self._ids(w.decode()).tobytes()

    def _learn(self, words: set[bytes]) -> None:
        letters, others, joined, before, young = set(), set(), [], self.old.get, self.young
        for w in words:
            ids = before(w)
            if ids is not None:
                young[w] = ids
            elif w.isalpha():
                letters.add(w)
            else:
                core = w.rstrip(_MARKS)
                marks = w[len(core):]
                alpha = core.isalpha() or (core and not core.isascii() and core.decode().isalpha() and _stays_letter(core.decode()[-1]))
                if not alpha:
                    others.add(w)
                elif not marks:
                    letters.add(w)
                else:
                    joined.append((w, core, marks))
                    for x, kind in ((core, letters), (marks, others)):
                        if x not in young:
                            ids = before(x)
                            if ids is None:
                                kind.add(x)
                            else:
                                young[x] = ids
        self._encode(list(letters), list(others))
        for w, core, marks in joined:
            young[w] = young[core] + young[marks]

    def batch(self, docs: list[bytes]) -> list[bytes]:
        """The ids of each text and the end id."""
        if len(self.young) > self.room:
            self.old, self.young = self.young, {}
        known, split, parts, gaps = self.young.get, [], [], []
        for d in docs:
            low = d.lower()
            words = (d if any(t in low for t in self.added) else low).split()
            ids = list(map(known, words))
            split.append(words)
            parts.append(ids)
            gaps.append([i for i, x in enumerate(ids) if x is None] if None in ids else ())
        self._learn({words[i] for words, gap in zip(split, gaps) for i in gap})
        out = []
        for words, ids, gap in zip(split, parts, gaps):
            for i in gap:
                ids[i] = self.young[words[i]]
            ids.append(self.end)
            out.append(b"".join(ids))
        return out


@lru_cache(maxsize=1)
def encoder(path: str, cache_words: int) -> WordEncoder:
    """One encoder per worker process, so that its words stay known from task to task."""
    return WordEncoder(path, cache_words)


#: positions that are dealt at a time, few enough for a processor's cache
_STRIDE = 1 << 17


def _sorted_by(a: np.ndarray, bit: np.ndarray, zeros: int) -> np.ndarray:
    """The values whose bit is 0, then the others, each in order."""
    out, i, j = np.empty_like(a), 0, zeros
    for s in range(0, len(a), _STRIDE):
        part, b = a[s:s + _STRIDE], bit[s:s + _STRIDE]
        low, high = part.take(np.flatnonzero(~b)), part.take(np.flatnonzero(b))
        out[i:i + len(low)], out[j:j + len(high)] = low, high
        i, j = i + len(low), j + len(high)
    return out


def _unsorted_by(a: np.ndarray, bit: np.ndarray, zeros: int) -> np.ndarray:
    """What ``_sorted_by`` was given."""
    out, i, j = np.empty_like(a), 0, zeros
    for s in range(0, len(a), _STRIDE):
        part, b = out[s:s + _STRIDE], bit[s:s + _STRIDE]
        low, high = np.flatnonzero(~b), np.flatnonzero(b)
        part[low], part[high] = a[i:i + len(low)], a[j:j + len(high)]
        i, j = i + len(low), j + len(high)
    return out


def build(ids: np.ndarray, doc_ids: list, starts: np.ndarray) -> bytes:
    """The file of one shard."""
    planes = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    a = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    zeros, ranks, ends, blocks = [], [], [], []
    at, squeeze = 0, zstandard.ZstdCompressor(level=1, write_content_size=True).compress
    for b in range(planes - 1, -1, -1):
        bit = (a & a.dtype.type(1 << b)) != 0
        packed = np.packbits(bit, bitorder="little")
        plane_ranks, plane_ends = [], []
        for i in range(0, len(packed), BLOCK_BITS // 8):
            raw = packed[i:i + BLOCK_BITS // 8]
            plane_ranks.append(int(np.bitwise_count(raw).sum()))
            small = squeeze(raw.tobytes())
            small = small if len(small) < len(raw) else raw.tobytes()
            at += len(small)
            plane_ends.append(at)
            blocks.append(small)
        zeros.append(int(len(a) - bit.sum()))
        ranks.append([0, *np.cumsum(plane_ranks).tolist()])
        ends.append(plane_ends)
        a = _sorted_by(a, bit, zeros[-1])
    head = json.dumps({"n": len(ids), "planes": planes, "block_bits": BLOCK_BITS, "zeros": zeros, "ranks": ranks,
                       "ends": ends, "docs": doc_ids, "starts": np.asarray(starts).tolist()}).encode()
    head = zlib.compress(head)
    return b"".join((MAGIC, struct.pack("<I", len(head)), head, *blocks))


class WaveletMatrix:
    """Queries on a file's bytes; nothing but the blocks that a query needs is decompressed."""

    def __init__(self, data: bytes):
        if data[:5] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        size, = struct.unpack("<I", data[5:9])
        h = json.loads(zlib.decompress(data[9:9 + size]))
        self.n, self.planes, self.block = h["n"], h["planes"], h["block_bits"]
        self.zeros, self.ranks, self.ends, self.docs, self.starts = h["zeros"], h["ranks"], h["ends"], h["docs"], h["starts"]
        self.base, self.data = 9 + size, memoryview(data)
        self.expand = zstandard.ZstdDecompressor().decompress

    def _bits(self, plane: int, block: int) -> np.ndarray:
        ends = self.ends[plane]
        begin = ends[block - 1] if block else (self.ends[plane - 1][-1] if plane else 0)
        raw = bytes(self.data[self.base + begin:self.base + ends[block]])
        length = min(self.block, self.n - block * self.block)
        if len(raw) < (length + 7) // 8:
            raw = self.expand(raw)
        return np.unpackbits(np.frombuffer(raw, np.uint8), count=length, bitorder="little")

    def _ones(self, plane: int, i: int) -> int:
        """Ones before position ``i`` of a plane."""
        block, rest = divmod(i, self.block)
        return self.ranks[plane][block] + (int(self._bits(plane, block)[:rest].sum()) if rest else 0)

    def access(self, i: int) -> int:
        value = 0
        for p in range(self.planes):
            block, rest = divmod(i, self.block)
            bits = self._bits(p, block)
            ones = self.ranks[p][block] + int(bits[:rest].sum())
            value = value << 1 | int(bits[rest])
            i = self.zeros[p] + ones if bits[rest] else i - ones
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where the first position's and position ``i``'s tokens of this value lie below the last plane."""
        lo, hi = 0, i
        for p in range(self.planes):
            a, b = self._ones(p, lo), self._ones(p, hi)
            if token >> (self.planes - 1 - p) & 1:
                lo, hi = self.zeros[p] + a, self.zeros[p] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """Occurrences of a token before position ``i``."""
        if token >> self.planes:
            return 0
        lo, hi = self._range(token, i)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of occurrence number ``k`` (from 0) of a token."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._range(token, 0)[0] + k
        for p in range(self.planes - 1, -1, -1):
            one = token >> (self.planes - 1 - p) & 1
            i = self._find(p, one, i - self.zeros[p] if one else i)
        return i

    def _find(self, plane: int, one: int, k: int) -> int:
        """Position of bit number ``k`` (from 0) that is ``one`` in a plane."""
        ranks = np.asarray(self.ranks[plane])
        before = ranks if one else np.minimum(np.arange(len(ranks)) * self.block, self.n) - ranks
        block = int(np.searchsorted(before, k, "right")) - 1
        return block * self.block + int(np.flatnonzero(self._bits(plane, block) == one)[k - before[block]])

    def tokens(self) -> np.ndarray:
        """All ids in order: planes are undone from the lowest."""
        a = np.zeros(self.n, np.uint16 if self.planes <= 16 else np.uint32)
        for p in range(self.planes - 1, -1, -1):
            blocks = range(len(self.ends[p]))
            bit = np.concatenate([self._bits(p, b) for b in blocks]).view(bool) if self.n else np.zeros(0, bool)
            a[self.zeros[p]:] |= a.dtype.type(1 << (self.planes - 1 - p))
            a = _unsorted_by(a, bit, self.zeros[p])
        return a


def _put(uri: str, data: bytes) -> None:
    """Write a file so that it appears complete or not at all."""
    fs, path = pafs.FileSystem.from_uri(uri)
    folder, _, name = path.rpartition("/")
    task = TaskContext.get()
    part = f"{folder}/_{name}.{task.taskAttemptId() if task else 0}"
    with fs.open_output_stream(part) as f:
        f.write(data)
    fs.move(part, path)


def _uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def write_shards(docs: DataFrame, folder: str, vocabulary: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text", shard_tokens: int = SHARD_TOKENS, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Encode ``docs`` into wavelet matrix files below ``folder`` (a path that every executor
    reaches); the list of files: name, docs, tokens."""
    vocabulary = vocabulary or default_vocabulary()
    spark = docs.sparkSession
    fs, path = pafs.FileSystem.from_uri(_uri(folder))
    fs.create_dir(path, recursive=True)
    uri = _uri(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary, cache_words)
        part, made, size = TaskContext.get().partitionId(), 0, words.dtype.itemsize
        ids, names, sizes, held = [], [], [], 0

        def shard() -> pa.RecordBatch:
            nonlocal made, held
            name = f"{part:06d}-{made:06d}.wm"
            lengths = np.array(sizes, np.int64)
            all_ids = np.frombuffer(b"".join(ids), words.dtype)
            _put(f"{uri}/{name}", build(all_ids, list(names), np.cumsum(lengths) - lengths))
            out = pa.RecordBatch.from_pydict({"name": [name], "docs": [len(names)], "tokens": [len(all_ids)]})
            made, held = made + 1, 0
            ids.clear(), names.clear(), sizes.clear()
            return out

        for batch in batches:
            doc_ids, column = batch.column(0).to_pylist(), batch.column(1)
            for i in range(0, len(doc_ids), 64):
                for key, x in zip(doc_ids[i:i + 64], words.batch(list(texts(column.slice(i, 64))))):
                    n = len(x) // size
                    if held and held + n > shard_tokens:
                        yield shard()
                    ids.append(x), names.append(key), sizes.append(n)
                    held += n
        if names:
            yield shard()

    # Ranges follow the ids alone; the hash only settles equal ids.
    id_type = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange(shuffle_parts(spark), F.col("id").asc_nulls_first(), F.xxhash64("text"))
    rows = rows.sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"))
    if not isinstance(id_type, IntegralType):            # a file's header holds numbers or strings
        rows = rows.withColumn("id", F.col("id").cast("string"))
    return materialize(rows.mapInArrow(write, "name string, docs long, tokens long"), "shard-list")


def read_shards(spark: SparkSession, folder: str, shards: DataFrame, id_type: DataType | None = None) -> DataFrame:
    """The documents in the files: id, start (ids of all documents before it), n_tokens, ids_crc32
    (of the ids as little-endian 32-bit numbers). ``shards`` is the list that ``write_shards`` gave,
    ``id_type`` the type of the documents' ids, long if not given."""
    id_type = id_type or LongType()
    number = isinstance(id_type, IntegralType)
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                m = WaveletMatrix(data.as_py())
                all_ids = m.tokens().astype("<u4")
                ends = [*m.starts[1:], m.n]
                yield pa.RecordBatch.from_pydict({
                    "name": pa.array([name] * len(ends), pa.string()), "id": pa.array(m.docs, pa.int64() if number else pa.string()),
                    "at": pa.array(m.starts, pa.int64()),
                    "n_tokens": pa.array([b - a for a, b in zip(m.starts, ends)], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(all_ids[a:b].data) for a, b in zip(m.starts, ends)], pa.int64())})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    rows = files.mapInArrow(read, f"name string, id {'long' if number else 'string'}, at long, n_tokens long, ids_crc32 long")
    # a file's place: the ids of the ranges before its own (a row per range), and of its range's files before it
    part = F.substring("name", 1, 6)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = shards.groupBy(part.alias("part")).agg(F.sum("tokens").alias("in_part"))
    ranges = ranges.select("part", F.coalesce(F.sum("in_part").over(earlier), F.lit(0)).alias("base"))
    before = Window.partitionBy(part).orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    files = shards.select("name", part.alias("part"), F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("inner"))
    offsets = files.join(ranges, "part").select("name", (F.col("base") + F.col("inner")).alias("offset"))
    return rows.join(offsets, "name").select(F.col("id").cast(id_type).alias("id"), (F.col("offset") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def encode_corpus(docs: DataFrame, **kw) -> DataFrame:
    """Write ``docs`` as shards into the shared folder and read them back."""
    spark = docs.sparkSession
    folder = shared_path(spark, "tokens")
    return read_shards(spark, folder, write_shards(docs, folder, **kw), docs.schema[kw.get("id_col", "doc_id")].dataType)


@register("op2_wavelet_tokens")
def op2_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, length and checksum of every document's ids, from the files."""
    return encode_corpus(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
