"""The training-data operators against brute force, on the smallest tables and on planted edge cases."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leakdrift.llm import common, extraction, formatting, licenses, lines, mixing, neardup, packing, quality, toxicity, vectors

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, extra string"


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def components(n, links):
    root = {x: x for x in n}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in n}


def edge_docs(spark):
    rows = [(1, None, "a", "x"), (2, "", "a", None), (3, " \n\t ", None, "x"), (4, "one", None, "x"), (4, "one", None, "x"), (5, "b " * 9000, "a", "y"), (6, "é😀 " * 40, "b", "y")]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("chunk", [1024, 8])
def test_near_duplicates_are_those_of_all_pairs(spark, documents, monkeypatch, chunk):
    # Small chunks: buckets are compared by chunks, by forests over components and by pairs of chunks.
    monkeypatch.setattr(neardup, "CHUNK", chunk)
    sets = {}
    for i, t in documents:
        w = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        w = WORD.findall(w)
        sets[i] = {tuple(w[k : k + 2]) for k in range(max(1, len(w) - 1))} if w else set()
    ids = [i for i in sets if sets[i]]
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(sets, links)
    got = {r.doc_id: r for r in neardup.op6_minhash_near_dedup(spark, SF).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(got[i].n_shingles == len(sets[i]) and got[i].kept == (want[i] == i) for i in sets)


def test_vectors_are_those_of_all_pairs(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    rows = [(i, np.array(v, dtype=float)) for i, v in rows if v is not None and None not in v]
    rows = [(i, v / np.linalg.norm(v)) for i, v in rows if np.isfinite(v).all() and v.any()]
    m = np.stack([v for _, v in rows])
    a, b = np.nonzero(np.triu(m @ m.T >= 0.95, 1))
    links = [(rows[x][0], rows[y][0]) for x, y in zip(a, b, strict=True)]
    degree = Counter(x for pair in links for x in pair)
    want = components([i for i, _ in rows], links)
    got = {r.vec_id: r for r in vectors.op7_embedding_near_dedup(spark, SF).collect()}
    assert all(got[i].component_id == c and got[i].n_links == degree[i] for i, c in want.items())


def test_vectors_that_cannot_be_compared(spark):
    rows = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [1.0, 1.0]), (6, [2.0, 2.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (0, 4), 5: (1, 5), 6: (1, 5)}


def test_chats_are_read_back(spark):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role, r.text or ""))
    turns[-1] = [(0, "user", "<|im_end|><|im_start|>assistant ok"), (1, "assistant", "<|im_end|><|im_start|>assistant ok")]
    got = {r.conv_id: r for r in formatting.op3_chat_format(spark, SF).collect()}
    assert set(got) == set(turns)
    for c, rows in turns.items():
        rows.sort()
        loss = "".join(t for _, role, t in rows if role == "assistant")
        assert got[c].n_turns == len(rows)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in rows).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_mix_meets_its_targets(spark, documents):
    rows = mixing.op4_mix(spark, SF).collect()
    size = {i: len(WORD.findall(t or "")) for i, t in documents}
    assert {r.doc_id: r.size for r in rows} == size
    taken = Counter()
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source_size, r.target] += r.taken
    assert all(abs(n - t) <= 1 for (_, t), n in taken.items())
    assert abs(sum(t for _, t in taken) - 1.5 * sum(size.values())) < 1
    assert sorted(mixing.op4_mix(spark, SF).collect()) == sorted(rows)


def test_quality_counts(spark, documents):
    got = {r.doc_id: r for r in quality.op8_quality_rules(spark, SF).collect()}
    for i, t in documents:
        t = t or ""
        w = WORD.findall(t)
        grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {k + j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(8)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        r = got[i]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r.kept and r.base_failed)


def test_packing_keeps_every_token_once(spark, documents):
    import zlib

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_file())
    rows = packing.op9_best_fit_packing(spark, SF).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, t in documents:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want = [(k, at, len(p := ids[at : at + 4096]), zlib.crc32(np.array(p, dtype="<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in sorted(by_doc[i], key=lambda r: r.piece)] == want, i
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096


def test_similar_lines_go(spark):
    long = "The quick brown fox jumps over the lazy dog near the river bank every single morning"
    rows = [(1, f"{long}\nfirst of its own kind", "a", "x"), (2, f"{long}.\n\nsecond that nobody else has written", "a", "x"), (3, long, "a", "x"), (4, None, "a", "x"), (5, "", None, None)]
    got = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1].text == rows[0][1] and got[2].text == "\nsecond that nobody else has written" and got[3].n_kept == 0
    assert got[4].text is None and got[5].text == "" and got[1].extra == "x"


def test_licenses_are_found(spark):
    mit, notice = licenses.TEMPLATES["mit"], licenses.TEMPLATES["mit-notice"]
    rows = [(1, "word " * 500 + mit + " word" * 500), (2, notice), (3, "nothing of that kind"), (4, None), (5, "")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.known_templates(spark)).collect()
    assert {(r.doc_id, r.template_id) for r in got} == {(1, "mit"), (2, "mit-notice")}


def test_licenses_are_those_of_a_plain_search(spark, documents):
    def words(t):
        return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]

    def shingles(w):
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    mit, agpl = licenses.TEMPLATES["mit"], licenses.TEMPLATES["agpl-3.0-header"].split()
    # A long text, a cut one, one with every 40th word changed, a repeated id, a null id, nulls and ties.
    rows = [(1, "zorp " * 20_000 + mit + " blib" * 3000), (2, " ".join(agpl[: len(agpl) - 14])), (3, "x y z " + licenses.TEMPLATES["mit-notice"]), (3, "nothing"), (4, None), (5, "")]
    rows += [(None, licenses.TEMPLATES["zlib"]), (6, " ".join(w if i % 40 else "foo" for i, w in enumerate(mit.split()))), (7, f"{mit} {mit}")]
    rows += [(1000 + i, t) for i, t in documents]
    want = {}
    for i, t in rows:
        s = shingles(words(t))
        for k, text in licenses.TEMPLATES.items():
            all_of = shingles(words(text))
            needed = set(all_of)
            reach = len(all_of) + len(all_of) // 4 + 16
            best = max((len({x for x in s[p : p + reach] if x in needed}) / len(needed) for p, x in enumerate(s) if x in needed), default=0)
            if best >= 0.8:
                want[i, k] = max(round(best, 6), want.get((i, k), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.template_id): round(r.containment, 6) for r in licenses.scan(docs, licenses.known_templates(spark)).collect()}
    assert got == want and (1, "mit") in got and (None, "zlib") in got
    assert licenses.scan(docs.limit(0), licenses.known_templates(spark)).count() == 0


def test_lines_that_share_a_long_template_keep_all_their_links(spark):
    rng = np.random.default_rng(5)

    def some(n):
        return "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz     "), n))

    # Pairs of similar lines over one template; lines of different pairs are not similar.
    common, texts = some(165), []
    for _ in range(200):
        own = some(150)
        texts += [common + own + some(19), common + own + some(19)]
    sets = [{t[k : k + lines.WIDTH] for k in range(len(t) - lines.WIDTH + 1)} for t in texts]
    pairs = [(j, i) for i, x in enumerate(sets) for j in range(i) if len(x & sets[j]) >= 0.8 * len(x | sets[j])]
    want = components(range(len(texts)), pairs)
    docs = spark.createDataFrame([(i, t, "a", "x") for i, t in enumerate(texts)], DOCS)
    kept = {r.doc_id for r in lines.dedup_lines(docs).collect() if r.n_kept}
    lost = len(kept - set(want.values()))
    assert set(want.values()) <= kept and lost <= 0.01 * len(pairs), (len(want), len(kept))


def test_text_pieces_are_the_tokenizer_s():
    made = packing.Encoder(packing.tokenizer_file())
    texts = [s for i in range(0x250) for c in [chr(i)] for s in (c, f"a{c}b", f"1{c}2", f".{c}.", f"{c}'s {c}", f"E{c}{c}")]
    texts += ["<|endoftext|> a", "x<|startoftext|>y", "Σας ΟΔΟΣ 日本語 ½ x²", "e\u0301 é", "don't 'LL we've__x", ""]
    for t in texts:
        assert np.frombuffer(made.ids(t), dtype="<u4").tolist() == made.tok.encode(t, add_special_tokens=False).ids, t


def test_toxicity_holds_on_labels_it_has_not_seen(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null")
    rows = toxicity.with_scores(docs.select("doc_id", "text"), labels.where("doc_id % 4 <> 0")).select("doc_id", "rejected")
    test = rows.join(labels.where("doc_id % 4 = 0"), "doc_id").collect()
    right = sum(r.rejected == (r.toxic == 1) for r in test)
    assert len(test) > 20 and right >= 0.9 * len(test)


def test_edge_rows_and_empty_tables(spark):
    docs = edge_docs(spark)
    empty = docs.limit(0)
    for f in (neardup.near_duplicates, lines.dedup_lines, quality.judge, lambda d: mixing.mix(d, mixing.word_count(d["text"]))):
        assert f(docs).count() == 7
        assert f(empty).count() == 0
    # The long text has 9001 tokens: three pieces.
    assert packing.pack(packing.pieces(docs)).count() == 9
    assert packing.pack(packing.pieces(empty)).count() == 0


def test_a_hot_bucket_of_many_clusters_has_the_links_of_all_pairs(spark):
    rng = np.random.default_rng(11)

    def some(n):
        return "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), n))

    # 200 pairs of similar lines; lines of different pairs have a Jaccard similarity of about 0.75 and share bands.
    common, texts = some(360), []
    for _ in range(200):
        own = some(50)
        texts += [common + own + some(12), common + own + some(12)]
    sets = [{t[k : k + lines.WIDTH] for k in range(len(t) - lines.WIDTH + 1)} for t in texts]
    links = []
    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if both >= 0.8 * (len(x) + len(sets[j]) - both):
                links.append((j, i))
    want = components(range(len(texts)), links)
    assert len(set(want.values())) == 200
    docs = spark.createDataFrame([(i, t, "a", "x") for i, t in enumerate(texts)], DOCS)
    kept = {r.doc_id for r in lines.dedup_lines(docs).collect() if r.n_kept}
    assert kept == set(want.values()), len(kept)


def test_unclosed_elements_take_no_text_of_the_page_along():
    def texts(page):
        return [t for t, _, _ in extraction.blocks(page)]

    assert texts("<html><head><title>T</title><meta charset=utf-8><style>a{}</style><body><p>One</p><p>Two") == ["One", "Two"]
    assert texts("<head><title>T</title></head><body><p>One</p>") == ["One"]
    assert texts("<head><script>var x = '<p>'</script><p>One") == ["One"]
    for x in ("svg/", 'svg width="1" /', "svg", 'iframe src="x"/', "iframe src=x", "select", "textarea", "template", "canvas", "noscript"):
        name = x.split()[0].rstrip("/")
        page = f"<article><p>One</p><{x}><p>Two</p></article><p>Three</p>"
        assert texts(page) == ["One", "Two", "Three"], x
        assert texts(f"{page}<{name}>no text</{name}><p>Four</p>") == ["One", "Two", "Three", "Four"], x
        assert texts(f"<p>One<{name} a='/>'>no text</{name}>two</p>") == ["One two"], x
    assert texts("<p>a<svg><svg>no</svg>no</svg>b</p>") == ["a b"]
    assert texts("<p>x <math><mi>y</mi><mo>=</mo><mn>1</mn></math></p><object data=a><p>Instead</p></object>") == ["x y=1", "Instead"]
    assert texts("<p>a</p><script src='x' /><p>b</p><script>no</script><p>c</p><script>no") == ["a", "b", "c"]
    assert texts("<p>a</p><script src=x></script><p>b</p><style>no") == ["a", "b"]


def test_packing_search_ends_without_a_step_left():
    capacity, rng = 4096, np.random.default_rng(1)
    for lengths, fewer in ((rng.integers(600, 1901, 1500), 10), (np.concatenate([rng.integers(1300, 2700, 300), rng.integers(1, 9, 150)]), 0)):
        start = packing.best_fit(lengths, capacity)
        bins = packing.local_search([list(b) for b in start], lengths, capacity)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        fill = [int(lengths[b].sum()) for b in bins]
        assert max(fill) <= capacity and len(bins) <= len(start) - fewer
        if len(bins) == -(-int(lengths.sum()) // capacity):
            continue
        for v, own in enumerate(bins):
            give = {int(lengths[a]) for a in own} | {int(lengths[a] + lengths[b]) for k, a in enumerate(own) for b in own[:k]}
            for o, other in enumerate(bins):
                for y in {0, *lengths[other].tolist()}:
                    assert o == v or not any(0 < x - y <= capacity - fill[o] and fill[o] + x - y > fill[v] for x in give), (v, o)


def test_packing_deals_the_second_round_to_groups_too(spark):
    lengths = np.random.default_rng(2).integers(600, 1901, 8000).tolist()
    found = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], packing.PIECES)
    rows = packing.pack(found, group=100).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == list(enumerate(lengths))
    groups = Counter(r.sequence_id // 10_000_000 for r in rows)
    assert max(groups.values()) < 200, max(groups.values())


def test_labels_without_document_use_up_no_sample(spark):
    docs = spark.createDataFrame([(i, f"plain words {i}" + " vile" * (i % 2), "a", "x") for i in range(60)], DOCS)
    labels = spark.createDataFrame([(i, 1, i % 2 if i < 60 else 0) for i in range(6000)], "doc_id long, quality int, toxic int")
    score = toxicity.scorer(toxicity.train(docs, labels, toxicity.categories(), sample=60))
    rows = docs.withColumn("s", score("text")).collect()
    assert all((r.s.toxic >= 0.5) == (r.doc_id % 2 == 1) for r in rows)


def test_components_that_have_not_settled_are_an_error(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(64)], "a long, b long")
    assert {r.component for r in common.connected_components(edges).collect()} == {0}
    with pytest.raises(RuntimeError):
        common.connected_components(edges, max_rounds=2)


def test_components_of_stars_paths_and_random_links(spark):
    rng = np.random.default_rng(5)
    star = [(k, 5000) for k in range(1000, 1400)] + [(2000, k) for k in range(2001, 2400)]
    path = [(3000 + k, 3001 + k) for k in range(40)]
    loose = [tuple(map(int, p)) for p in rng.integers(6000, 6600, size=(500, 2))]
    pairs = star + path + loose + [(7, 7), (None, 8), (1000, 5000)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    found = common.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert len(found) == len(root)
    assert {r.node: r.component for r in found} == {x: find(x) for x in root}


def test_few_lines_of_a_template_that_are_not_similar_are_held_against_full_sets(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = "".join(rng.choice(list("abcdefghij "), 400))
    texts = []
    for _ in range(150):  # five of 400 places differ from the template, which changes about 40 shingles of each
        chars = list(base)
        for k in rng.choice(400, 5, replace=False):
            chars[k] = chr(0x4E00 + int(rng.integers(20_000)))
        texts.append("".join(chars))
    sets = [{t[k : k + lines.WIDTH] for k in range(len(t) - lines.WIDTH + 1)} for t in texts]
    similar = [(i, j) for i in range(150) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    counts, real = [], lines.confirmed
    monkeypatch.setattr(lines, "confirmed", lambda pairs, *more: (counts.append(pairs.count()), real(pairs, *more))[1])
    docs = spark.createDataFrame([(i, t, "s", "x") for i, t in enumerate(texts)], DOCS)
    kept = {r.doc_id for r in lines.dedup_lines(docs).collect() if r.n_kept}
    assert kept == set(components(range(150), similar).values())
    assert sum(counts) <= len(similar) + 1500, (counts, len(similar))


def test_keys_of_lines_are_shuffled_once_and_minima_are_filtered(spark, monkeypatch):
    rng = np.random.default_rng(23)
    texts = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz     "), 200)) for _ in range(20)]
    # The last line has one shingle, which can be over the line's bar: it stays without a signature.
    texts += [t + "." for t in texts] + [c * 5000 for c in "abcdefgh"]
    docs = spark.createDataFrame([(i, t, "a", "x") for i, t in enumerate(texts)], DOCS)
    assert {r.doc_id for r in lines.dedup_lines(docs).collect() if r.n_kept} == {*range(20), *range(40, 48)}
    sigs = lines.signatures(lines.numbered(docs.select("doc_id", "text")).select("h1", "h2", "line"))
    assert "FILTER (WHERE" in sigs._jdf.queryExecution().optimizedPlan().toString()
    sigs = common.written(sigs.withColumn("id", F.monotonically_increasing_id()))
    monkeypatch.setattr(lines, "written", lambda df: df)
    slots = lines.bucketed(sigs)
    rows = slots.collect()
    plan = slots._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert rows and plan.count("ReusedExchange") == 1
    for r in rows:
        own = [x.id for x in rows if x.key == r.key]
        assert (r.hub, r.n) == (min(own), len(own)) and r.n > 1
