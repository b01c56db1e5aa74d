"""Manifest, periodic runs and token counts against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leakdrift.llm import manifest, periods, tokens

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TABLE = "doc_id long, source string, lang string, n_chars long, text string"
#: Null ids and texts, repeated rows and ids, a null and an empty language, a lone leaf.
ROWS = [
    (5, "a", "en", 3, "abc"), (5, "a", "en", 3, "abc"), (5, "b", "en", None, "other"), (None, "a", "en", 1, "x"), (7, None, None, 2, None),
    (2**60 + 1, "é", "", 9, "é😀"), (8, "s", "de", 4, ""), *[(100 + i, "s", "fr", i, f"text {i}") for i in range(37)],
]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H(*map(part, (r[0], r[1], r[2], r[3], r[4])))


def grown(nodes, fanout):
    """All levels of a tree."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][k : k + fanout]) for k in range(0, len(out[-1]), fanout)])
    return out


def way(levels, i, fanout):
    """(left, right) siblings from a leaf up."""
    out = []
    for level in levels[:-1]:
        f = i - i % fanout
        out.append((level[f:i], level[i + 1 : f + fanout]))
        i //= fanout
    return out


def whole_manifest(rows, fanout=2):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for x in langs}
    lower = {x: grown([leaf_of(r) for r in own[x]], fanout) for x in langs}
    upper = grown([lower[x][-1][0] for x in langs], fanout)
    root, out = upper[-1][0], []
    for k, x in enumerate(langs):
        for i, r in enumerate(own[x]):
            proof = way(lower[x], i, fanout) + way(upper, k, fanout)
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            h = leaf_of((*r[:3], r[3] + 1, r[4])) if changed else leaf_of(r)
            for left, right in proof:
                h = H(*left, h, *right)
            out.append((r[0], leaf_of(r), lower[x][-1][0], root, H(*[y for a, b in proof for y in a + b]), h, h == root))
    return sorted(out, key=str)


def with_clashes(df):
    """df with columns named as those that operators make inside."""
    from pyspark.sql import functions as F

    for c in ("row", "piece", "chunk", "leaf", "tree", "order", "nth", "block", "n", "one", "root", "proof", "runs", "f", "_levels"):
        df = df.withColumn(c, F.lit("x"))
    return df


def manifest_query(found):
    from pyspark.sql import functions as F

    back = manifest.folded(F.coalesce("tampered", "leaf"), F.col("proof"))
    rows = found.select("doc_id", "leaf", "subroot", "root", manifest.siblings_digest(F.col("proof")).alias("p"), back.alias("b"))
    return sorted(((*r, r.b == r.root) for r in rows.collect()), key=str)


@pytest.mark.parametrize(("fanout", "block"), [(2, 4), (3, 3), (2, 8192), (4, 16)])
def test_manifest_of_edge_rows(spark, fanout, block):
    docs = with_clashes(spark.createDataFrame(ROWS, TABLE).repartition(3))
    found = manifest.manifest(docs, also=(manifest.tampered_leaf(),), fanout=fanout, block=block)
    assert manifest_query(found) == whole_manifest(ROWS, fanout)


def test_manifest_of_one_and_of_no_row(spark):
    docs = spark.createDataFrame(ROWS[:1], TABLE)
    assert manifest_query(manifest.manifest(docs, also=(manifest.tampered_leaf(),))) == whole_manifest(ROWS[:1])
    assert manifest_query(manifest.manifest(docs.limit(0), also=(manifest.tampered_leaf(),))) == []


def test_manifest_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = sorted((tuple(r) for r in manifest.op11_merkle_manifest(spark, SF).collect()), key=str)
    assert got == whole_manifest(rows)
    assert {r[6] for r in got} == {True, False}


def plain_runs(w):
    """All maximal runs by trying every period at every place."""
    out, n = set(), len(w)
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            e = i
            while e < n and w[e] == w[e - q]:
                e += 1
            s = i - q
            length = e - s
            if length >= max(6, 4 * q) and not any(all(w[x] == w[x - d] for x in range(s + d, e)) for d in range(1, q)):
                out.add((s, length, q))
            i = e + 1
    return sorted((s, n, q) for s, n, q in out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_runs_of_few_symbols(w):
    assert periods.text_runs([b"%d" % x for x in w]) == plain_runs(w)
    known = sorted(set(w))
    assert periods.runs_of([known.index(x) for x in w], max(1, len(known))) == plain_runs(w)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=5), st.integers(1, 7)), max_size=8))
def test_runs_of_repeated_parts(parts):
    w = [x for part, k in parts for x in part * k]
    assert periods.text_runs([b"%d" % x for x in w]) == plain_runs(w)


def test_a_long_run_takes_little_time():
    w = [b"w%d" % (i % 977) for i in range(60_000)]
    assert periods.text_runs(w) == [(0, 60_000, 977)]


def runs_row(doc_id, text):
    w = WORD.findall(text or "")
    if doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0:
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w) if len(w) < 3000 else periods.text_runs([x.encode() for x in w])
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {x for s, n, q in runs for x in range(s + q, s + n)}
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    best = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *best, H(lines), H(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {tuple(r) for r in periods.op12_periodic_runs(spark, SF).collect()}
    assert got == {runs_row(*r) for r in rows}
    assert sum(r[1] > 0 for r in got) > 10


def test_runs_of_edge_rows(spark):
    texts = [(1, None), (2, ""), (3, " \n\t"), (3, " \n\t"), (None, "a a a a a a a"), (4, "x\xa0x " * 9), (5, "é b\vc\f" * 5)]
    docs = with_clashes(spark.createDataFrame(texts, "doc_id long, text string"))
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periods.periodic_runs(docs).collect()), key=str)
    want = [(i, len(w := WORD.findall(t or "")), r := plain_runs(w), " ".join(x for k, x in enumerate(w) if not any(s + q <= k < s + n for s, n, q in r))) for i, t in texts]
    assert got == sorted(want, key=str)
    assert periods.periodic_runs(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    from leakdrift.llm.packing import tokenizer_file

    tok = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    return lambda text: len(tok.encode(text or "", add_special_tokens=False).ids)


def hard_texts():
    """Texts that are hard to cut: white space, contractions, special strings and endless words around every place."""
    rng = random.Random(5)
    parts = ["don't", " we'll", "'re", "  ", "\n\n ", "<|endoftext|>", "<|endof", "text|>", "word", " Wörter", "日本語", "12345", "²½", " !?", " ", "\x1c", "😀", "'", "\xa0", "x" * 40, " " * 40]
    texts = ["".join(rng.choice(parts) for _ in range(n)) for n in (0, 1, 30, 200, 200, 300) for _ in range(6)]
    return [*texts, "a" * 5000, " " * 3000 + "b", "-" * 2000 + "<|endoftext|>" * 100, "ab " * 2000, "x" * 1000 + " y" * 500 + "z" * 900]


@pytest.mark.parametrize(("step", "overlap"), [(64, 32), (100, 100), (256, 40)])
def test_counts_of_hard_texts(spark, library, step, overlap):
    rows = [*enumerate(hard_texts()), (900, None), (900, None), (None, "with no id " * 50), (None, None), (2**60 + 1, "big id " * 90)]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((tuple(r) for r in tokens.token_counts(docs, step=step, overlap=overlap).collect()), key=str)
    assert got == sorted(((i, len((t or "").encode()), library(t)) for i, t in rows), key=str)
    assert tokens.token_counts(docs.limit(0)).count() == 0


@settings(max_examples=500, deadline=None)
@given(st.text(st.characters(max_codepoint=0x2030, exclude_categories=["Cs"]), max_size=60))
def test_pieces_are_the_tokenizers(library, text):
    from leakdrift.llm.packing import tokenizer_file

    assert tokens.counter(tokenizer_file("byte_bpe_50k.json")).count(text) == library(text)


def test_counts_query(spark, library):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted((tuple(r) for r in tokens.op13_token_counts(spark, SF).collect()), key=str)
    want = [(r.doc_id, len((r.text or "").encode()), n := library(r.text), n > 1024) for r in rows]
    assert got == sorted(want, key=str)
