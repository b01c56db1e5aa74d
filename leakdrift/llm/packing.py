"""Best-fit packing of tokenised documents, improved by a swap-based local search."""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakdrift.llm.common import shuffled_join, small_batches, table, written

END_ID = 1
#: Pieces that one task packs at most, about; more pieces make more groups.
GROUP = 20_000
#: The share of a sequence from which on it is not packed again.
FULL = 63 / 64
#: Bytes of text pieces and their ids that a worker remembers, about; the rest are encoded again.
REMEMBERED = 60_000_000
#: Texts with any other character than these are cut by the tokenizer itself.
NOT_PLAIN = re.compile(r"[^\t\n\r -~\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2010-\u2027]")
#: How the tokenizer cuts a lower-case text, for the characters above: letters, digits, beginnings of suffixes, marks.
_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u02af\u2c65\u2c66"
PIECE = re.compile(rf"[{_LETTERS}]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^\s0-9{_LETTERS}]+")
#: The signs that stand for bytes in the vocabulary: printable ones for themselves, the others from code point 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_SIGNS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Remembered(dict):
    """Ids of a text's pieces as little-endian bytes, made when asked for the first time."""

    def __init__(self, ids_of: Callable[[str], list[int]]) -> None:
        self.ids_of = ids_of
        self.size = 0

    def __missing__(self, piece: str) -> bytes:
        ids = self.ids_of(piece)
        if self.size > REMEMBERED:
            self.clear()
            self.size = 0
        self.size += 200 + 2 * len(piece) + 4 * len(ids)
        known = self[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return known


class Encoder:
    """Ids of whole texts as little-endian bytes; each piece of a text is encoded once as long as it is remembered.

    The tokenizer lower-cases, drops white space and cuts a text into words, digits and runs of marks before it merges
    anything, so a text's ids are its pieces' ids one after another. Texts of the characters that NOT_PLAIN leaves, where lower-casing
    and the classes of characters are the same in Python, are cut here and only new pieces meet the model; of all other
    texts, and of those that spell a special token, the words between spaces go through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        model, encode = self.tok.model, self.tok.encode

        def merged(piece: str) -> list[int]:
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(BYTE_SIGNS)
            return [t.id for t in model.tokenize(shown)]

        self.pieces = Remembered(merged)
        self.words = Remembered(lambda word: encode(word, add_special_tokens=False).ids)

    def ids(self, text: str) -> bytes:
        if NOT_PLAIN.search(text) is None and not any(t in text for t in self.special):
            return b"".join(map(self.pieces.__getitem__, PIECE.findall(text.lower())))
        return b"".join(map(self.words.__getitem__, text.split(" ")))


#: One for each tokenizer, kept by a worker from task to task.
ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(path)
    return ENCODERS[path]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = 4096) -> DataFrame:
    """(doc_id, text) to pieces of at most `capacity` ids, with the CRC-32 of the ids as little-endian uint32.

    A document is its text's ids and then END_ID; null and empty texts are END_ID alone. Longer documents are cut into
    full pieces and a rest, whole texts whatever their length. Rows that repeat are documents of their own; null ids
    stay null; an empty table has no pieces; extra columns are not looked at.
    """
    path = path or tokenizer_file()
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from leakdrift.llm.packing import encoder

        ids_of = encoder(path).ids
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            rows, out = [], []
            for row, text in enumerate(batch["text"].to_pylist()):
                ids = ids_of(text or "") + end
                for k, at in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * at : 4 * (at + capacity)]
                    rows.append(row)
                    out.append((k, at, len(part) // 4, zlib.crc32(part)))
            # Ids stay in Arrow, where they are whole beside nulls.
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)] if out else []
            if columns:
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(rows)), *columns], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Longest first, each into the fullest bin that has room; free room is found in a bit set."""
    room: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    some = 0
    bins: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        above = some >> need
        if above:
            free = need + (above & -above).bit_length() - 1
            one = room[free].pop()
            if not room[free]:
                some &= ~(1 << free)
        else:
            free, one = capacity, []
            bins.append(one)
        one.append(i)
        free -= need
        if free:
            room[free].append(one)
            some |= 1 << free
    return bins


def gifts(own: np.ndarray, capacity: int) -> np.ndarray:
    """For each room up to twice the capacity the longest one or two of the own lengths that fit into it, 0 if none."""
    some, n = np.unique(own, return_counts=True)
    sums = np.concatenate([some, (some[:, None] + some)[np.triu_indices(len(some), 1)], 2 * some[n > 1]])
    table = np.zeros(2 * capacity + 1, dtype=np.int64)
    table[sums] = sums
    return np.maximum.accumulate(table)


def given(own: list[int], lengths: np.ndarray, total: int) -> list[int]:
    """One or two of the own pieces that are so long together."""
    seen: dict[int, int] = {}
    for i in own:
        if lengths[i] == total:
            return [i]
    for i in own:
        if total - int(lengths[i]) in seen:
            return [seen[total - int(lengths[i])], i]
        seen[int(lengths[i])] = i
    raise AssertionError(total)


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Empties underfull bins: moves, one-for-one and two-for-one exchanges with any bin that has room.

    Each step takes the emptiest bin that may have one; it gives one or two pieces, takes back one at most, and so
    shifts the largest length that increases the sum of squared fills; a bin that is left without pieces is dropped.
    A bin without a step is looked at again only against the bins that have changed since. Ends at the lower bound,
    or when no bin has a step.
    """
    lengths = lengths.astype(np.int64)
    fewest = -(-int(lengths.sum()) // capacity)
    if len(bins) <= fewest:
        return bins
    live, count = [list(b) for b in bins], len(bins)
    fill = np.array([int(lengths[b].sum()) for b in bins], dtype=np.int64)
    free = capacity - fill
    # Behind the pieces there is one of length 0 for each bin: to take back nothing.
    n = len(lengths)
    size = np.concatenate([lengths, np.zeros(count, dtype=np.int64)])
    at = np.zeros(n + count, dtype=np.int64)
    at[n:] = np.arange(count)
    for k, b in enumerate(bins):
        at[b] = k
    changed: list[int] = []
    #: How many of the changes a bin has been held against; -1 where its own pieces are new.
    seen = [-1] * len(bins)
    heap = [(int(fill[k]), k) for k in range(len(bins)) if free[k]]
    heapq.heapify(heap)
    while count > fewest:
        if not heap:
            heap = [(int(fill[k]), k) for k in range(len(bins)) if free[k] and live[k] and seen[k] < len(changed)]
            heapq.heapify(heap)
            if not heap:
                break
        was, v = heapq.heappop(heap)
        if was != fill[v] or not live[v] or seen[v] == len(changed):
            continue
        if seen[v] < 0 or len(changed) - seen[v] > len(bins) // 8:
            size_of, bin_of, ids = size, at, None
        else:
            some = set(changed[seen[v] :])
            ids = np.array([i for k in some for i in (*live[k], n + k)], dtype=np.int64)
            size_of, bin_of = size[ids], at[ids]
        room = free[bin_of]
        gain = gifts(lengths[live[v]], capacity)[size_of + room] - size_of
        good = (gain > 0) & (room > 0) & (bin_of != v) & (fill[bin_of] + gain > fill[v])
        score = np.where(good, gain * (capacity + 1) + fill[bin_of], 0)
        best = int(score.argmax()) if len(score) else 0
        if not len(score) or not score[best]:
            seen[v] = len(changed)
            continue
        back = best if ids is None else int(ids[best])
        o, shift = int(bin_of[best]), int(gain[best])
        give = given(live[v], lengths, shift + int(size[back]))
        back = [back] if back < n else []
        live[v] = [x for x in live[v] if x not in give] + back
        live[o] = [x for x in live[o] if x not in back] + give
        at[give], at[back] = o, v
        for k, by in ((v, -shift), (o, shift)):
            fill[k] += by
            free[k] -= by
            seen[k] = -1
            changed.append(k)
        if not live[v]:
            count, free[v] = count - 1, 0
        for k in (v, o):
            if free[k] and live[k]:
                heapq.heappush(heap, (int(fill[k]), k))
    return [b for b in live if b]


def pack(found: DataFrame, capacity: int = 4096, group: int = GROUP, full: float = FULL) -> DataFrame:
    """Pieces to pieces with sequence_id and a gapless offset from 0 within each sequence.

    Pieces are dealt to groups by a hash, one task packs a group by best fit and local search, and the pieces of the
    sequences that stay underfull are dealt and packed again by another hash; those filled to `full` or more stay as
    they are, where less than that share of a sequence could be gained. Every row is packed, repeated rows too.
    """

    def packer(shift: int):  # noqa: ANN202
        def run(key: tuple, rows: pa.Table) -> pa.Table:
            rows = rows.sort_by([("length", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
            lengths = rows["length"].to_numpy()
            bins = local_search(best_fit(lengths, capacity), lengths, capacity)
            at = np.concatenate([np.array(b, dtype=np.int64) for b in bins])
            per = lengths[at]
            ends = np.cumsum(per)
            first = np.cumsum([0] + [len(b) for b in bins[:-1]])
            begin = np.repeat(np.concatenate([[0], ends])[first], [len(b) for b in bins])
            number = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
            out = rows.select(["doc_id", "piece", "start", "length", "ids_crc32"]).take(pa.array(at))
            out = out.append_column("sequence_id", pa.array((key[0].as_py() * 2 + shift) * 10_000_000 + number))
            return out.append_column("offset", pa.array(ends - per - begin))

        return run

    found = written(found)
    groups = max(1, -(-found.count() // group))
    key = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).alias("g")
    first = written(found.select("*", key).groupBy("g").applyInArrow(packer(0), PACKED))
    if groups == 1:
        return first
    fills = first.groupBy("sequence_id").agg(F.sum("length").alias("fill"))
    under = fills.where(F.col("fill") < int(capacity * full)).select("sequence_id")
    again = written(shuffled_join(first, under, "sequence_id", "left_semi"))
    groups = max(1, -(-again.count() // group))
    again = again.withColumn("g", F.pmod(F.xxhash64(F.lit(1), "doc_id", "piece", "ids_crc32"), F.lit(groups)))
    again = again.groupBy("g").applyInArrow(packer(1), PACKED)
    return shuffled_join(first, under, "sequence_id", "left_anti").select(*again.columns).unionByName(again)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents")))
