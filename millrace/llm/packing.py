"""Packing token sequences by swap-based local search.

Documents become ids and an end id; longer ones than a sequence are cut into pieces of its full length,
the first of which may be shorter. Full pieces are sequences. The others are dealt into blocks of some
thousand by a hash of their number and packed block by block: best fit, longest first, and then a local
search that works on the least filled bin. It moves one of its pieces into a bin with room, or exchanges
one for one, two for one or one for two with a bin that becomes fuller by what this one loses, always the
change that moves most; the sum of squared fills rises with each, until the bin is empty and gone or no
change is left. A block then gives back its least filled bins (of those with room, at most a quarter of its pieces), which
meet those of other blocks in a round of fewer blocks, until one block is left.

Ids: ``tokenizers``' byte-level vocabulary. A space that is followed by anything but white space begins a
piece of the vocabulary's splitter, so the ids of a text are its words' ids in a row, and those of words
seen before are remembered in two generations; new words go through the same vocabulary's ranks many at a
time. Texts with the vocabulary's special token, or with a space inside a run of white space, are encoded
whole.

Defined results: NULL text is empty and gives the end id alone; equal or NULL ids and repeated rows are
documents of their own; a text of any length is cut, never dropped; an empty table gives an empty result;
only the id and text columns are read, so others may have any name. Numbers of pieces follow the table's
partitions, so reruns over the same files agree.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import materialize, read_table, register, texts

LENGTH = 2048
END_ID = 0
#: pieces packed together
BLOCK_PIECES = 4096
#: share of a block's pieces that go into the next round (at least one bin's, at most half of them)
_GIVE_BACK = 1 / 4
#: least filled bins of a block that the search tries to empty without success before it ends
_TRIES = 64
#: words whose ids a worker process remembers, twice
CACHE_WORDS = 3 << 17
_LONG_WORD = 64
#: a space between white space: what it belongs to depends on what follows
_INNER_SPACE = re.compile(r"\s (?:\s|\Z)")


def default_vocabulary() -> tuple[str, str]:
    """Paths of the vocabulary and of its ranks."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class ByteEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers, without an end id."""

    def __init__(self, vocabulary: str, ranks: str, cache_words: int = CACHE_WORDS):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # Spark's tasks are the parallel units
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.bytes = np.zeros(max(table.values()) + 1, np.int64)
        for token, i in table.items():
            self.bytes[i] = len(token)
        self.room = cache_words
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.ranks.encode_ordinary(text), "<u4").tobytes()

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words with a space before them; those that are remembered no longer than a batch are returned."""
        new, long = [], {}
        for w in words:
            ids = self.old.get(w)
            if ids is not None:
                self.young[w] = ids
            elif not w or w[0].isspace():
                long[w] = self._whole(" " + w)
            else:
                new.append(w)
        if new:
            ids = np.array(self.ranks.encode_ordinary(" " + " ".join(new)), "<u4")
            ends = np.cumsum(np.fromiter((len(w.encode()) + 1 for w in new), np.int64, len(new)))
            cuts = (np.searchsorted(np.cumsum(self.bytes[ids]), ends) + 1).tolist()
            raw, a = ids.tobytes(), 0
            for w, b in zip(new, cuts):
                (self.young if len(w) <= _LONG_WORD else long)[w] = raw[4 * a:4 * b]
                a = b
        return long

    def batch(self, docs: list[str]) -> list[bytes]:
        if len(self.young) > self.room:
            self.old, self.young = self.young, {}
        known, split, gaps = self.young.get, [], set()
        for text in docs:
            if _INNER_SPACE.search(text) or any(s in text for s in self.special):
                split.append(None)
                continue
            first, *words = text.split(" ")
            ids = list(map(known, words))
            if None in ids:
                gaps.update(w for w, x in zip(words, ids) if x is None)
            split.append((first, words, ids))
        long = self._learn(gaps)
        out = []
        for text, parts in zip(docs, split):
            if parts is None:
                out.append(self._whole(text))
                continue
            first, words, ids = parts
            if None in ids:
                ids = [x if x is not None else known(w) or long[w] for w, x in zip(words, ids)]
            out.append(b"".join((self._whole(first), *ids)))
        return out


@lru_cache(maxsize=1)
def encoder(vocabulary: str, ranks: str, cache_words: int) -> ByteEncoder:
    """One encoder per worker process, so that its words stay known from task to task."""
    return ByteEncoder(vocabulary, ranks, cache_words)


def cuts(n: int, length: int = LENGTH) -> list[int]:
    """Starts of the pieces of ``n`` ids, and ``n``."""
    return [*([0] if n % length else []), *range(n % length, n, length), n]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_ids: bool = False,
           vocabulary: tuple[str, str] | None = None, cache_words: int = CACHE_WORDS) -> DataFrame:
    """A row per piece: id, piece, start, length, ids_crc32 and, if asked for, ids (32-bit, little-endian, as binary)."""
    files = vocabulary or default_vocabulary()
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*files, cache_words).batch
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                of, cols = [], [[], [], [], [], []]
                for k, ids in enumerate(encode([x.decode() for x in texts(batch.column(1).slice(i, 64))])):
                    ids += end
                    at = cuts(len(ids) // 4, length)
                    for p, (a, b) in enumerate(zip(at, at[1:])):
                        own = ids[4 * a:4 * b]
                        of.append(i + k)
                        for col, v in zip(cols, (p, a, b - a, zlib.crc32(own), own)):
                            col.append(v)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                arrays = [batch.column(0).take(pa.array(of, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds))]
                yield pa.RecordBatch.from_arrays(arrays[:6 if with_ids else 5], names[:6 if with_ids else 5])

    names = ["id", "piece", "start", "length", "ids_crc32", "ids"]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return rows.mapInArrow(cut, schema + (", ids binary" if with_ids else ""))


def best_fit(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Longest first, each into the fullest bin with room: the bin of each piece, the fill of each bin."""
    bins, fill = np.empty(len(sizes), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(length + 1)]
    some = 0                                           # bit r is set if a bin has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = some >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                some ^= 1 << room
        else:
            b, room = len(fill), length
            fill.append(0)
        bins[i] = b
        fill[b] += size
        if room > size:
            by_room[room - size].append(b)
            some |= 1 << (room - size)
    return bins, np.array(fill, np.int64)


def _step(sizes: np.ndarray, bins: np.ndarray, fill: np.ndarray, a: int, length: int) -> tuple[int, list[int], list[int]]:
    """The change that moves most out of bin ``a`` into another bin: (how much, pieces that leave ``a``,
    pieces that come); (0, [], []) if there is none. A bin that takes has at least the fill of ``a``."""
    room = np.where((fill >= fill[a]) & (fill > 0), length - fill, 0)
    room[a] = 0
    mine = np.flatnonzero(bins == a)
    mine = mine[np.argsort(-sizes[mine], kind="stable")].tolist()
    for i in mine:
        where = np.flatnonzero(room >= sizes[i])
        if len(where):
            return int(sizes[i]), [i], [-1 - int(where[room[where].argmin()])]
    free, best = room[bins], (0, [], [])

    def look(out: list[int], others: np.ndarray, room_there: np.ndarray, back) -> None:
        nonlocal best
        gain = int(sizes[out].sum()) - others
        gain = np.where((gain > 0) & (gain <= room_there), gain, 0)
        if len(gain) and gain.max() > best[0]:
            j = int(gain.argmax())
            best = int(gain[j]), out, back(j)
    some = mine if len(mine) <= 8 else mine[:4] + mine[-4:]
    for k, i in enumerate(some):
        look([i], sizes, free, lambda j: [j])
        for x in some[k + 1:]:
            look([i, x], sizes, free, lambda j: [j])
    order = np.argsort(bins, kind="stable")
    for k in (1, 2, 3):
        one, two = order[:-k], order[k:]
        there = np.where(bins[one] == bins[two], free[one], 0)
        for i in some:
            look([i], sizes[one] + sizes[two], there, lambda j: [int(one[j]), int(two[j])])
    return best


def local_search(sizes: np.ndarray, bins: np.ndarray, fill: np.ndarray, length: int = LENGTH) -> None:
    """Empty bins in place by moves and exchanges; ``fill`` is 0 where a bin is gone."""
    least, stuck = -(-int(sizes.sum()) // length), np.zeros(len(fill), bool)
    while np.count_nonzero(fill) > least and stuck.sum() < _TRIES:
        order = np.where(stuck | (fill == 0), length, fill)
        a = int(order.argmin())
        if order[a] >= length:
            return
        while fill[a]:
            gain, out, back = _step(sizes, bins, fill, a, length)
            if not gain:
                stuck[a] = True
                break
            b = -1 - back[0] if back[0] < 0 else int(bins[back[0]])
            if back[0] >= 0:
                bins[back] = a
            bins[out] = b
            fill[a] -= gain
            fill[b] += gain


def pack_block(sizes: np.ndarray, length: int, give_back: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and whether it stays (or goes into the next round)."""
    bins, fill = best_fit(sizes, length)
    local_search(sizes, bins, fill, length)
    order = np.argsort(bins, kind="stable")
    ends = np.cumsum(sizes[order])
    starts = np.r_[True, bins[order][1:] != bins[order][:-1]]
    begin = ends - sizes[order]
    offsets = np.empty(len(sizes), np.int64)
    offsets[order] = begin - np.maximum.accumulate(np.where(starts, begin, 0))
    stays = np.ones(len(sizes), bool)
    if give_back:
        count = np.bincount(bins, minlength=len(fill))
        loose = np.flatnonzero((fill > 0) & (fill < length - length // 64))
        loose = loose[np.argsort(fill[loose], kind="stable")]
        given = np.cumsum(count[loose])
        most = min(max(len(sizes) * _GIVE_BACK, given[0] if len(given) else 0), len(sizes) / 2)
        stays = ~np.isin(bins, loose[given <= most])
    return bins, offsets, stays


def pack(rows: DataFrame, length: int = LENGTH, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """``rows`` with a column ``length`` (1 to ``length``), as ``pieces`` gives them, with two more: ``sequence_id`` and
    ``offset``. No sequence is longer than ``length``, none has a gap."""
    number, named = "piece_number", rows.columns
    rows = materialize(rows.withColumn(number, F.monotonically_increasing_id()), "pieces")
    out = [rows.where(F.col("length") == length).withColumn("sequence_id", -1 - F.col(number)).withColumn("offset", F.lit(0).cast("long"))]
    todo, turn = rows.where(F.col("length") < length), 0

    def packer(give_back: bool):
        def packed(table: pa.Table) -> pa.Table:
            found = pack_block(table.column("length").to_numpy().astype(np.int64), length, give_back)
            for name, values in zip(("bin", "offset", "stays"), found):
                table = table.append_column(name, pa.array(values))
            return table
        return packed
    while True:
        blocks = -(-todo.count() // block_pieces)
        if not blocks:
            break
        block = F.pmod(F.xxhash64(number, F.lit(turn)), F.lit(blocks).cast("long"))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in todo.schema)
        done = todo.withColumn("block", block).groupBy("block").applyInArrow(
            packer(blocks > 1), schema + ", block long, bin long, offset long, stays boolean")
        done = materialize(done, "packed")
        at = F.lit(turn).cast("long") * (1 << 57) + F.col("block") * (1 << 20) + F.col("bin")
        out.append(done.where("stays").withColumn("sequence_id", at))
        if blocks == 1:
            break
        todo, turn = done.where("NOT stays").select(*rows.columns), turn + 1
    return reduce(DataFrame.unionByName, (x.select(*named, "sequence_id", "offset") for x in out))


def sequences(packed: DataFrame) -> DataFrame:
    """``pack(pieces(..., with_ids=True))`` -> (sequence_id, length, ids): the packed sequences themselves."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda p: p.ids)
    whole = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), whole.alias("ids"))


@register("op11_swap_packing")
def op11_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences of at most 2048 ids."""
    rows = pack(pieces(read_table(spark, sf_dir, "documents")))
    return rows.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
