"""Fuzzy line deduplication: character-shingle MinHash, banding, exact Jaccard, union-find; one line stays of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakdrift.llm.common import BROADCAST_IDS, connected_components, let, shuffled_join, table, with_hubs, with_links, written

#: Characters of a shingle; a shorter line is one shingle.
WIDTH = 8
#: One hash deals a line's shingles to so many bins, and each bin keeps its least value. ROWS of them make a band:
#: at a similarity of 0.8 a pair shares a band with probability 1 - (1 - 0.8 ** 3) ** 8 = 0.997, at 0.9 0.99997.
BINS, ROWS = 24, 3
BANDS = BINS // ROWS
#: Only shingles whose hash is under a line's bar are sorted into bins: so many of them are expected, all where the
#: line has no more. Lines of similar lengths have nearly the same bar.
UNDER = 40
#: Pairs are candidates whose unlike bins are at most half of the bins that either has, and SPARE; at a similarity of 0.8
#: that leaves out one pair in 2,000. Bins that are empty in both say nothing.
SPARE = 1
#: 64-bit words of a line's odd sketch. Sketches of two sets differ in no more bits than the sets in elements, so that
#: what is left out by them has a smaller similarity for certain.
WORDS = 16
#: Documents whose needed lines are sent to every task at most; more are joined by a shuffle.
BROADCAST_DOCS = 100_000
#: Lines of a bucket that one task compares with as many others at once.
CHUNK = 1024
HAS_WORD = r"[^ \t-\r]"


def wide(line: Column) -> Column:
    """Four bytes for each code point, so that a shingle is cut out without a search from the line's start."""
    return F.encode(line, "UTF-32")


def hashes(line: Column, width: int = WIDTH) -> Column:
    """Hashes of a line's character shingles."""
    starts = F.sequence(F.lit(1), 4 * F.greatest(F.length(line) - width, F.lit(0)) + 1, F.lit(4))
    return let(wide(line), lambda b: F.transform(starts, lambda i: F.xxhash64(F.substr(b, i, F.lit(4 * width)))))


def shingles(line: Column) -> Column:
    """Distinct hashes of a line's character shingles."""
    return F.array_distinct(hashes(line))


def hash_1(line: Column) -> Column:
    return F.xxhash64(line)


def hash_2(line: Column) -> Column:
    return F.xxhash64(F.lit(1), line)


def numbered(docs: DataFrame) -> DataFrame:
    """Every line with a word: doc_id, pos, line and its 128-bit hash as h1 and h2."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.where(F.col("line").rlike(HAS_WORD))
    return rows.select("doc_id", "pos", "line", hash_1(F.col("line")).alias("h1"), hash_2(F.col("line")).alias("h2"))


def least(k: int) -> str:
    return f"m{k}"


def signatures(lines: DataFrame) -> DataFrame:
    """(h1, h2, line) to one row for each different line: h1, h2 and m0, m1, ..., the least shingle hash of each bin
    that has any, else null. Lines without a shingle under the bar have no row.

    Shingles are rows of a generator inside one generated loop, which few leave: those under the line's bar, of which
    bins are partial minima before the shuffle, so that repeated lines are one row for each task at most. A filter leaves
    the other bins' minima alone, where a condition on the value would write all of them for each shingle.
    """
    last = F.greatest(F.length("line") - WIDTH, F.lit(0))
    rows = lines.select("h1", "h2", wide(F.col("line")).alias("b"), last.alias("last"))
    rows = rows.select("h1", "h2", "b", "last", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("i"))
    rows = rows.select("h1", "h2", "last", F.hash(F.substr("b", F.col("i") * 4 + 1, F.lit(4 * WIDTH))).alias("x"))
    bar = F.lit(float(UNDER) * 2**32) / (F.col("last") + 1) - F.lit(float(2**31))
    rows = rows.where(F.col("x") < bar).select("h1", "h2", "x", F.pmod("x", F.lit(BINS)).alias("bin"))
    return rows.groupBy("h1", "h2").agg(*[F.expr(f"min(x) filter (where bin = {k})").alias(least(k)) for k in range(BINS)])


def keyed(sigs: DataFrame) -> DataFrame:
    """(id, m0, ...) to (id, key): a row for each band that has any value. A value tells its bin.

    A band of one value takes the next band's bins too, or each frequent shingle would make a bucket.
    """
    bands = [[F.col(least(b * ROWS + k)) for k in range(ROWS)] for b in range(BANDS)]
    keys = []
    for b, ms in enumerate(bands):
        values = sum(m.isNotNull().cast("int") for m in ms)
        key = F.when(values > 1, F.xxhash64(F.lit(b), *ms))
        keys.append(key.when(values == 1, F.xxhash64(F.lit(b), *ms, *bands[(b + 1) % BANDS])))
    return sigs.select("id", F.explode(F.array(*keys)).alias("key")).where("key is not null")


def digests() -> list[Column]:
    """A signature as longs of eight bins, one byte for each bin's value and 0 for an empty bin."""

    def word(k: int) -> Column:
        out = F.lit(0).cast("long")
        for j in range(8):
            m = F.col(least(8 * k + j))
            byte = F.when(m.isNull(), F.lit(0)).otherwise(F.pmod(F.hash(m), F.lit(255)) + 1).cast("long")
            out = out.bitwiseOR(F.shiftleft(byte, 8 * j))
        return out

    return [word(k).alias(f"w{k}") for k in range(BINS // 8)]


def digests_agree(x: str, y: str) -> Column:
    """Whether the digests of two lines are alike. All of it is generated code."""

    def bytes_set(word: Column) -> Column:
        any_bit = word
        for i in range(1, 8):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(word, i))
        return F.bit_count(any_bit.bitwiseAND(F.lit(0x0101010101010101)))

    pairs = [(F.col(f"{x}.w{k}"), F.col(f"{y}.w{k}")) for k in range(BINS // 8)]
    unlike = sum(bytes_set(p.bitwiseXOR(q)) for p, q in pairs)
    either = sum(bytes_set(p.bitwiseOR(q)) for p, q in pairs)
    return 2 * unlike <= either + 2 * SPARE


def sketches(texts: DataFrame) -> DataFrame:
    """(id, line) to id, size, o0, o1, ...: the number of a line's distinct shingles and their odd sketch, in which each
    flips a bit."""
    rows = texts.select("id", F.explode(shingles(F.col("line"))).alias("x"))
    rows = rows.select("id", F.shiftrightunsigned("x", 58).cast("int").alias("bit"), F.pmod("x", F.lit(WORDS)).alias("word"))
    words = [F.coalesce(F.expr(f"bit_xor(shiftleft(1L, bit)) filter (where word = {k})"), F.lit(0).cast("long")).alias(f"o{k}") for k in range(WORDS)]
    return rows.groupBy("id").agg(F.count("*").alias("size"), *words)


def sketches_allow(x: str, y: str, threshold: float) -> Column:
    """False only for lines whose shingle sets are less similar than the threshold: of n and m elements, they would
    differ in (1 - threshold) / (1 + threshold) * (n + m) at most."""
    n, m = F.col(f"{x}.size"), F.col(f"{y}.size")
    unlike = sum(F.bit_count(F.col(f"{x}.o{k}").bitwiseXOR(F.col(f"{y}.o{k}"))) for k in range(WORDS))
    most = (n + m) * F.lit((1 - threshold) / (1 + threshold)) + F.lit(1e-3)
    return (F.abs(n - m) <= most) & (unlike <= most)


def bucketed(sigs: DataFrame) -> DataFrame:
    """(id, key, hub, n): the lines of each bucket of more than one, with its least line and its size.

    Nearly all keys are those of one line, so the keys are shuffled once, as they are, for the buckets' least lines and
    for what is joined with them; these are a row for each bucket, and the lines of a large one only stream past its row.
    """
    slots = keyed(sigs).repartition("key")
    hubs = slots.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1")
    return written(slots.join(hubs.hint("shuffle_hash"), "key"))


def with_digests(slots: DataFrame, sigs: DataFrame) -> DataFrame:
    """Adds the digest of each slot's line."""
    return shuffled_join(slots, sigs.select("id", *digests()), "id")


def with_hub(slots: DataFrame, columns: list[str], alike: Column) -> DataFrame:
    """(a, b): lines with the least line of their bucket. A bucket of n lines makes n pairs."""
    pairs = slots.where("id <> hub").select("id", "hub", *columns).distinct().alias("l")
    hubs = slots.where("id = hub").select("hub", *columns).distinct().alias("r")
    both = shuffled_join(pairs, hubs, (F.col("l.hub") == F.col("r.hub")) & alike)
    return both.select(F.col("l.hub").alias("a"), F.col("l.id").alias("b"))


DIGEST = [f"w{k}" for k in range(BINS // 8)]
SKETCH = ["size", *[f"o{k}" for k in range(WORDS)]]


def candidates(slots: DataFrame) -> DataFrame:
    """(a, b): lines with the least line of their bucket, where the digests are alike."""
    return with_hub(slots, DIGEST, digests_agree("l", "r"))


def against_all(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join of a bucket's `minor` lines with all its lines, by key, ours and theirs.

    Buckets are dealt to chunks by a hash, and a pair of chunks is one key of the join, so that no task has a large
    bucket to itself.
    """
    rows = rows.withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int")).drop("n")
    rows = written(rows.withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks").cast("int")))
    minors = rows.where("minor").groupBy("key").agg(F.collect_set("chunk").alias("ours"))
    left = rows.where("minor").withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    right = shuffled_join(rows.withColumnRenamed("chunk", "theirs"), minors, "key").withColumn("ours", F.explode("ours"))
    return left.withColumnRenamed("chunk", "ours"), right


def same_chunks() -> Column:
    return (F.col("l.key") == F.col("r.key")) & (F.col("l.ours") == F.col("r.ours")) & (F.col("l.theirs") == F.col("r.theirs"))


def near_others(slots: DataFrame, stars: DataFrame) -> DataFrame:
    """(id): all lines that any candidate pair of a bucket has; stars are the pairs with the least lines."""
    met = written(stars.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    rows = shuffled_join(slots.where("n > 2"), met.withColumn("met", F.lit(True)), "id", "left")
    rows = rows.select("id", "key", "n", *DIGEST, F.col("met").isNull().alias("minor"))
    left, right = against_all(rows)
    alike = (F.col("l.id") != F.col("r.id")) & digests_agree("l", "r")
    return met.unionByName(shuffled_join(left.alias("l"), right.alias("r"), same_chunks() & alike, "left_semi").select("id").distinct())


def crossing(slots: DataFrame, parts: DataFrame, threshold: float) -> DataFrame:
    """(a, b): all candidate pairs of a bucket's lines that are in different components (node, component).

    What isn't in a bucket's largest component meets all lines of other components, but for the least line, which has
    met all. The condition is held against sketches before a pair is made. A pair of several buckets comes once.
    """
    parts = parts.withColumnRenamed("node", "id")
    rows = slots.where("n > 2 and id <> hub").drop("hub")
    rows = written(shuffled_join(rows, parts, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component"))
    sizes = rows.groupBy("key", "comp").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("big"), F.count("*").alias("m"))
    rows = shuffled_join(rows, largest.where("m > 1").select("key", "big"), "key").withColumn("minor", F.col("comp") != F.col("big"))
    left, right = against_all(rows.drop("big"))
    apart = (F.col("l.comp") != F.col("r.comp")) & (~F.col("r.minor") | (F.col("l.id") < F.col("r.id")))
    alike = sketches_allow("l", "r", threshold)
    both = shuffled_join(left.alias("l"), right.alias("r"), same_chunks() & apart & alike)
    a, b = F.col("l.id"), F.col("r.id")
    return both.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def texts_of(ids: DataFrame, firsts: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, line) of the lines with the ids, read where each stands first; each document is split once.

    Where rows share a doc_id, the line that has the hash is taken.
    """
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    need = firsts.join(F.broadcast(ids), "id", "left_semi") if small else shuffled_join(firsts, ids, "id", "left_semi")
    need = need.groupBy(F.col("at.doc_id").alias("_id")).agg(F.collect_list(F.struct("id", "at.pos", "h1", "h2")).alias("need"))
    few = small and need.limit(BROADCAST_DOCS + 1).count() <= BROADCAST_DOCS
    texts, same = docs.select("doc_id", "text"), F.col("doc_id").eqNullSafe(F.col("_id"))
    rows = texts.join(F.broadcast(need), same) if few else shuffled_join(texts, need, same)
    rows = rows.select("need", F.split("text", "\n").alias("ls"))
    rows = rows.select(F.inline(F.transform("need", lambda x: F.struct(x["id"].alias("id"), x["h1"].alias("h1"), x["h2"].alias("h2"), F.get("ls", x["pos"]).alias("line")))))
    rows = rows.where((F.col("h1") == hash_1(F.col("line"))) & (F.col("h2") == hash_2(F.col("line"))))
    return written(rows.select("id", "line").dropDuplicates(["id"]))


def confirmed(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose shingle sets have a Jaccard similarity of at least the threshold; texts has id, line and size."""
    rows = shuffled_join(pairs, texts.select(F.col("id").alias("a"), F.col("line").alias("x"), F.col("size").alias("n")), "a")
    rows = shuffled_join(rows, texts.select(F.col("id").alias("b"), F.col("line").alias("y"), F.col("size").alias("m")), "b")
    both = F.size(F.array_intersect(hashes(F.col("x")), hashes(F.col("y"))))
    # A generator keeps the optimiser from moving the condition before the count, which would be made several times.
    rows = rows.select("a", "b", "n", "m", F.explode(F.array(both)).alias("both"))
    return written(rows.where(F.col("both") >= F.lit(threshold) * (F.col("n") + F.col("m") - F.col("both"))).select("a", "b"))


def line_links(firsts: DataFrame, sigs: DataFrame, docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(node, component) of the different lines, by id, that are linked with others.

    Lines that have a candidate in any bucket are read and sketched. They are compared with the least lines of their
    buckets first; then every candidate pair of a bucket that still lies in two components is compared too, so that no
    link is lost which could change a component.
    """
    slots = written(with_digests(bucketed(sigs), sigs))
    texts = texts_of(written(near_others(slots, candidates(slots))), firsts, docs)
    known = written(sketches(texts))
    texts = written(shuffled_join(texts, known.select("id", "size"), "id"))
    slots = written(shuffled_join(slots.drop(*DIGEST), known, "id"))
    links = confirmed(with_hub(slots, SKETCH, sketches_allow("l", "r", threshold)), texts, threshold)
    parts = connected_components(links)
    pairs = written(crossing(slots, parts, threshold))
    return parts if pairs.isEmpty() else connected_components(with_links(parts, confirmed(pairs, texts, threshold)))


def dedup_lines(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs with `text` without the lines that repeat a kept one, and n_lines, n_kept; every row stays.

    Lines with a word that are equal, or linked by similar ones, are a component, of which the line with the
    smallest (doc_id, position) stays. Blank lines stay where they are. A document of which no line is left has
    blank lines or an empty text; a null text stays null. Rows that share a doc_id count as one document: what is
    kept of it stays in each of them. A null doc_id comes before all others. An empty table gives an empty one. Extra
    columns are passed on, but for n_lines and n_kept, which are replaced.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_kept")]
    docs = docs.select(*columns)
    lines = numbered(docs.select("doc_id", "text"))
    places = written(lines.select("doc_id", "pos", "h1", "h2"))
    firsts = places.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "pos")).alias("at"), F.count("*").alias("n"))
    # Lines that are repeated most have the least ids and so are the hubs of their buckets.
    # Both sides are grouped by the hash, so that they meet without another shuffle.
    firsts = firsts.hint("shuffle_hash").join(signatures(lines.select("h1", "h2", "line")), ["h1", "h2"], "left")
    firsts = written(firsts.withColumn("id", F.monotonically_increasing_id() - F.shiftleft(F.least("n", F.lit(1000)).cast("long"), 52)))
    sigs = firsts.select("id", *[least(k) for k in range(BINS)])
    firsts = firsts.select("id", "h1", "h2", "at", "n")
    linked = written(line_links(firsts, sigs, docs, threshold))
    linked = written(shuffled_join(firsts.select("id", "at"), linked.withColumnRenamed("node", "id"), "id"))
    heads = linked.groupBy("component").agg(F.min("at").alias("head"), F.count("*").alias("n"))
    lost = with_hubs(linked, heads, ["component"], linked.count()).where("at <> head").select("id", F.lit(True).alias("gone"))
    # Every line with a word whose place isn't the first of its text, or whose text is lost, goes.
    doubtful = shuffled_join(firsts.select("id", "h1", "h2", "at", "n"), written(lost), "id", "left").where("n > 1 or gone")
    gone = shuffled_join(places, doubtful.select("h1", "h2", "at", "gone"), ["h1", "h2"]).where(
        F.coalesce("gone", F.lit(False)) | ~F.struct("doc_id", "pos").eqNullSafe(F.col("at"))
    )
    gone = gone.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("pos").alias("_gone"))
    rows = docs.alias("d").join(gone.hint("shuffle_hash").alias("g"), F.col("d.doc_id").eqNullSafe(F.col("g._id")), "left")
    n_lines = F.coalesce(F.size(F.filter(F.split("d.text", "\n"), lambda x: x.rlike(HAS_WORD))), F.lit(0))
    kept = F.array_join(F.filter(F.split("d.text", "\n"), lambda x, i: ~F.array_contains("g._gone", i)), "\n")
    text = F.when(F.col("g._gone").isNull(), F.col("d.text")).otherwise(kept).alias("text")
    n_kept = (n_lines - F.coalesce(F.size("g._gone"), F.lit(0))).alias("n_kept")
    return rows.select(*[text if c == "text" else F.col(f"d.{c}") for c in columns], n_lines.alias("n_lines"), n_kept)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines kept of every document: doc_id, n_lines (with a word), n_kept and the text that is left."""
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_kept", "text")
