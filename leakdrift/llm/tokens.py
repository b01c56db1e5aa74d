"""Token counts: huge texts are encoded in overlapping chunks that are spliced where both have a proven boundary."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakdrift.llm.common import sized_semi_join, small_batches, table, written
from leakdrift.llm.packing import BYTE_SIGNS, NOT_PLAIN, tokenizer_file

#: Code points of a chunk, and of what it shares with the next one at first; longer texts than both are cut.
STEP, OVERLAP = 65_536, 4_096
#: Code points before a chunk's end within which no boundary counts, besides the longest special string: what decides
#: on a boundary is two code points behind it at most, by the tokenizer's contractions and its rule for white space.
MARGIN = 3
#: Pieces of texts whose counts a worker remembers: some 150 bytes each.
REMEMBERED = 400_000
#: How the tokenizer cuts texts of the characters that NOT_PLAIN leaves.
_LETTERS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+")

CUT = "row long, doc_id long, n_bytes long, n_tokens long, piece int, text string"
CHUNK = "row long, chunk int, total long, head array<struct<at:long,before:long>>, tail array<struct<at:long,after:long>>"


class Counter(dict):
    """How many tokens a text has. Counts of pieces are remembered, since no merge crosses a piece's edge.

    Texts of the characters that NOT_PLAIN leaves, where the classes of characters are the same in Python, are cut here;
    all others, and those that spell a special token, go through the tokenizer as they are.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.margin = MARGIN + max(map(len, self.special), default=0)

    def __missing__(self, piece: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        shown = piece.encode().decode("latin-1").translate(BYTE_SIGNS)
        n = self[piece] = len(self.tok.model.tokenize(shown))
        return n

    def count(self, text: str) -> int:
        if NOT_PLAIN.search(text) is None and not any(t in text for t in self.special):
            return sum(map(self.__getitem__, PIECE.findall(text)))
        return len(self.tok.encode(text, add_special_tokens=False).ids)

    def boundaries(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """Where the tokenizer cuts a text before it merges anything, how many tokens come before, and all tokens."""
        found = self.tok.encode(text, add_special_tokens=False)
        word = np.array([-1 if w is None else w for w in found.word_ids], dtype=np.int64)
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, dtype=np.int64)
        at = np.array([s for s, _ in found.offsets], dtype=np.int64)[first]
        return at, first, len(word)


#: One for each tokenizer, kept by a worker from task to task.
COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in COUNTERS:
        COUNTERS[path] = Counter(path)
    return COUNTERS[path]


def counted_or_cut(docs: DataFrame, path: str, step: int, overlap: int) -> DataFrame:
    """(row, doc_id, text) to a row with its count for each text, and for huge ones to their pieces of `step` code points."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from leakdrift.llm.tokens import counter

        count = counter(path).count
        for batch in batches:
            rows, cuts, n, has = [], [], [], []
            for k, text in enumerate(batch["text"]):
                text = text or ""
                huge = len(text) > step + overlap
                rows.append(k)
                cuts.append((-1, None))
                has.append(not huge)
                n.append(0 if huge else count(text))
                if huge:
                    some = range(-(-len(text) // step))
                    rows += [k] * len(some)
                    cuts += [(i, text[i * step : (i + 1) * step]) for i in some]
                    n += [0] * len(some)
                    has += [False] * len(some)
            out = batch[["row", "doc_id", "n_bytes"]].iloc[rows].reset_index(drop=True)
            out["n_tokens"] = pd.array(n, dtype="Int64")
            out.loc[~np.array(has, dtype=bool), "n_tokens"] = pd.NA
            out["piece"] = np.array([c[0] for c in cuts], dtype=np.int32)
            out["text"] = pd.Series([c[1] for c in cuts], dtype=object)
            yield out

    # Ids go as text: pandas has no 64-bit integers beside nulls.
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    rows = docs.select("row", F.col("doc_id").cast("string").alias("doc_id"), size.alias("n_bytes"), "text")
    found = rows.mapInPandas(work, CUT.replace("doc_id long", "doc_id string"))
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def encoded(pieces: DataFrame, path: str, step: int, overlap: int, wider: int) -> DataFrame:
    """Pieces to chunks of `wider` pieces and `wider` overlaps more, with the boundaries in what neighbours share.

    `before` counts a chunk's tokens before a boundary that it shares with the chunk before, `after` those behind one
    that it shares with the next.
    """
    reach = overlap * wider

    def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        from leakdrift.llm.tokens import counter

        known = counter(path)
        chunk = int(key[1])
        start, size = chunk * wider * step, wider * step
        text = "".join(rows.sort_values("piece")["text"])
        last = len(text) <= size
        text = text[: size + reach]
        at, before, total = known.boundaries(text)
        head = (at < reach) if chunk else np.zeros(len(at), dtype=bool)
        tail = (at >= size) & (at + known.margin <= len(text)) if not last else np.zeros(len(at), dtype=bool)
        pairs = lambda some, n, name: [{"at": start + a, name: c} for a, c in zip(at[some].tolist(), n[some].tolist(), strict=True)]
        return pd.DataFrame([(int(key[0]), chunk, total, pairs(head, before, "before"), pairs(tail, total - before, "after"))], columns=["row", "chunk", "total", "head", "tail"])

    own = F.floor(F.col("piece") / wider).cast("int")
    lent = (F.col("piece") >= wider) & ((F.col("piece") - own * wider) * step < reach)
    chunks = F.when(lent, F.array(own, own - 1)).otherwise(F.array(own))
    rows = pieces.select("row", "piece", "text", F.explode(chunks).alias("chunk"))
    return rows.groupBy("row", "chunk").applyInPandas(work, CHUNK)


def spliced(chunks: DataFrame) -> DataFrame:
    """(row, n_tokens) of chunked texts; null where two neighbours have no boundary in common.

    A boundary of the first chunk is one of the text, and so is each of a later chunk from the first on that it shares
    with the chunk before it, as long as what decides on it lies inside: behind a boundary the tokenizer starts anew.
    All tokens behind it in one chunk, and all before it in the next, are left out.
    """
    ends = chunks.select("row", "chunk", "tail")
    starts = chunks.where("chunk > 0").select("row", (F.col("chunk") - 1).alias("chunk"), "head")
    met = starts.join(ends, ["row", "chunk"])
    at = F.array_min(F.array_intersect(F.transform("head", lambda x: x["at"]), F.transform("tail", lambda x: x["at"])))
    met = met.withColumn("at", at)
    before = F.get(F.filter("head", lambda x: x["at"] == F.col("at")), F.lit(0))["before"]
    after = F.get(F.filter("tail", lambda x: x["at"] == F.col("at")), F.lit(0))["after"]
    less = met.groupBy("row").agg(F.sum(before + after).alias("less"), F.count_if(F.col("at").isNull()).alias("apart"))
    sums = chunks.groupBy("row").agg(F.sum("total").alias("total")).join(less, "row", "left")
    return sums.select("row", F.when(F.coalesce("apart", F.lit(0)) == 0, F.col("total") - F.coalesce("less", F.lit(0))).alias("n_tokens"))


def token_counts(docs: DataFrame, path: str | None = None, step: int = STEP, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, text) to (doc_id, n_bytes, n_tokens): UTF-8 bytes and tokens of whole texts, one row for each row.

    `path` is a byte-level BPE vocabulary of the library tokenizers; special strings inside texts count as one token
    each, as by its default. Texts of more than step + overlap code points are cut into chunks that tasks encode apart;
    chunks overlap, and are spliced at a boundary that both have. Texts with two chunks that share none, such as of one
    endless word, are done again with chunks and overlaps twice as large, until all meet or one chunk holds the text.
    Null and empty texts have no bytes and no tokens; repeated rows and null ids are rows of their own; an empty table
    has no rows; extra columns, whatever their names, are not looked at.
    """
    if not 0 < overlap <= step:
        raise ValueError("the overlap must be positive, and no longer than a chunk")
    path = path or tokenizer_file("byte_bpe_50k.json")
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    found = written(counted_or_cut(rows, path, step, overlap))
    heads = found.where("piece = -1").select("row", "doc_id", "n_bytes", "n_tokens")
    pieces = found.where("piece >= 0").select("row", "piece", "text")
    done, wider = heads.where("n_tokens is not null").select("doc_id", "n_bytes", "n_tokens"), 1
    huge = heads.where("n_tokens is null").drop("n_tokens")
    while not huge.isEmpty():
        sums = written(spliced(written(encoded(pieces, path, step, overlap, wider))))
        counts = sums.where("n_tokens is not null")
        done = done.unionByName(huge.join(counts, "row").select("doc_id", "n_bytes", "n_tokens"))
        apart = sums.where("n_tokens is null").select("row")
        huge, pieces = sized_semi_join(huge, apart, "row"), sized_semi_join(pieces, apart, "row")
        wider *= 2
    return done


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))
