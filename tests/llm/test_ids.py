"""Ids that repeat, are null or are over 2^53: one row out for each row in, under the row's own id."""

import zlib
from collections import Counter

import numpy as np
from test_operators import WORD, components

from leakdrift.llm import neardup, packing, vectors

BIG = 2**60


def words_of(start, n=30):
    return [f"w{k}" for k in range(start, start + n)]


def test_documents_with_one_id_and_several_texts(spark):
    near = lambda w: " ".join([*w[:-1], "other"])
    a, b, c, d = (words_of(100 * k) for k in range(4))
    rows = [(3, " ".join(a)), (5, near(a)), (5, " ".join(b)), (7, near(b)), (9, " ".join(c)), (9, " ".join(c)), (9, " ".join(d)), (1, near(d)), (None, " ".join(a)), (5, None), (BIG + 1, near(c)), (BIG + 3, "alone here")]
    sets = [set(zip(w, w[1:], strict=False)) if (w := WORD.findall(t or "")) else set() for _, t in rows]
    own = [k for k, (i, _) in enumerate(rows) if i is not None and sets[k]]
    links = [(x, y) for x in own for y in own if x < y and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])]
    root = components(range(len(rows)), links)
    least = {r: min(rows[k][0] for k in own if root[k] == r) for r in {root[k] for k in own}}
    want = Counter((i, len(sets[k]), least[root[k]] if k in own else i, i is None or i == (least[root[k]] if k in own else i)) for k, (i, _) in enumerate(rows))
    got = Counter(tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect())
    assert got == want and sum(got.values()) == len(rows)


def test_vectors_with_one_id(spark):
    e = np.eye(4)
    near = lambda k: (e[k] + 0.1 * e[3 - k]).tolist()
    rows = [(1, e[0].tolist()), (1, e[1].tolist()), (2, near(0)), (3, near(1)), (3, near(1)), (None, e[0].tolist()), (BIG + 1, e[2].tolist()), (BIG + 3, [0.0] * 4), (7, e[2].tolist()), (0, near(2))]
    x = np.array([v for _, v in rows])
    norm = np.linalg.norm(x, axis=1)
    own = [k for k, (i, _) in enumerate(rows) if i is not None and norm[k]]
    links = [(p, q) for p in own for q in own if p < q and x[p] @ x[q] / norm[p] / norm[q] >= 0.95]
    root, degree = components(range(len(rows)), links), Counter(k for pair in links for k in pair)
    least = {r: min(rows[k][0] for k in own if root[k] == r) for r in {root[k] for k in own}}
    comp = [least[root[k]] if k in own else rows[k][0] for k in range(len(rows))]
    want = Counter((i, degree[k], comp[k], i is None or i == comp[k]) for k, (i, _) in enumerate(rows))
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block in (4096, 2):
        assert Counter(tuple(r) for r in vectors.near_vectors(frame, block=block).collect()) == want
    assert vectors.near_vectors(frame.limit(0)).count() == 0


def test_packed_ids_stay_whole(spark):
    rows = [(BIG + 1, "one two"), (BIG + 3, "three"), (None, "four"), (None, None), (5, ""), (BIG + 1, "one two")]
    encode = packing.encoder(packing.tokenizer_file()).ids
    crc = lambda t: zlib.crc32(encode(t or "") + np.array([1], dtype="<u4").tobytes())
    found = packing.pack(packing.pieces(spark.createDataFrame(rows, "doc_id long, text string")))
    assert Counter((r.doc_id, r.ids_crc32) for r in found.collect()) == Counter((i, crc(t)) for i, t in rows)
    again = packing.pack(packing.pieces(spark.createDataFrame(rows * 40, "doc_id long, text string")), group=50)
    assert Counter((r.doc_id, r.ids_crc32) for r in again.collect()) == Counter({(i, crc(t)): 40 * n for (i, t), n in Counter(rows).items()})
    assert packing.pack(packing.pieces(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_columns_with_our_names_are_passed_on(spark):
    import corpus_pipeline
    from pyspark.sql import functions as F

    from leakdrift.llm import mixing

    rows = [(k, "s" if k % 2 else None, f"some words of the text {k}", "mine") for k in range(20)] + [(None, "s", None, "mine")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, rejected string")
    for c in ("_copy", "_size", "_nth", "_taken", "scores", "_more", "size", "taken", "target", "a.b"):
        docs = docs.withColumn(c, F.lit("mine"))
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() > 20
    assert all(r[c] == "mine" for r in mixed.collect() for c in docs.columns if c not in ("doc_id", "source", "text"))
    assert mixing.mix_documents(docs.limit(0)).count() == 0
    kept = corpus_pipeline.toxicity(spark, docs, "/root/testdata/sf0.001")
    assert kept.columns == docs.columns and all(r.rejected == r.scores == "mine" for r in kept.collect())
