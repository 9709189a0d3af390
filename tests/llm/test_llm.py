"""The training-data operators against brute force on small tables: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import pytest

pytest.importorskip("lattica.llm")
from pyspark.sql import functions as F  # noqa: E402

from lattica.llm import common, exact_dedup, fingerprints, lm_scores, mixing, near_copies, packing, pii, quality, queries, token_count, warc, wordbpe, words  # noqa: E402
from lattica.llm.components import UnionFind, components  # noqa: E402
from tests.oracle import duck, duck_rows, rows_of  # noqa: E402

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, sha string, n long, word string, score double"


def held(i, r):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == r


def make(spark, texts, first=1):
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", 9, "w", 0.5) for i, t in enumerate(texts, first)], DOCS)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    words = ["alpha", "Beta", "gamma,", "DELTA.", "it's", "naïve", "3.14", "x" * 40, "don't", "<|endoftext|>", "<|ENDOFTEXT|>", "é́", "日本語", "a\x1cb", " ", "end."]
    base = [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(40)]
    return [*base, None, "", " \n\t", base[0], base[0] + " ", base[1].replace(" ", "\n"), "word " * 5000, "y" * 30000]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def tokenizer():
    return wordbpe.load()


def ids_of(tokenizer, t):
    return tokenizer.encode(t or "", add_special_tokens=False).ids


def test_token_counts(spark, texts, tokenizer, empty):
    docs = make(spark, texts)
    for head in (1, 200_000):
        got = {r.doc_id: r for r in token_count.count_tokens(spark, docs, head=head, limit=50).collect()}
        for i, t in enumerate(texts, 1):
            n = len(ids_of(tokenizer, t))
            assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 50)
    twice = make(spark, ["a b"]).unionByName(make(spark, ["a b"]))
    assert token_count.count_tokens(spark, twice).count() == 2
    assert token_count.count_tokens(spark, empty).count() == 0


def test_word_ids_are_the_librarys(tokenizer, texts):
    import pyarrow as pa

    w = wordbpe.WordIds(max_words=8)
    for some in (texts, [], texts[3:5], texts[40:41]):
        assert [x.tolist() for x in w.encode(pa.array(some, pa.string()))] == [ids_of(tokenizer, t) for t in some]


@pytest.mark.parametrize("size", [7, 1 << 20])
def test_batch_words_are_each_texts_words(monkeypatch, texts, size):
    import pyarrow as pa

    monkeypatch.setattr(words, "SLICE", size)
    some = [t if t is None or len(t) < 3000 else t[:400] for t in texts]
    got = words.split_words(pa.array(["x y", *some], pa.string()).slice(1))
    want = [(t or "").encode().split() for t in some]
    assert [[got.word(k) for k in range(got.ends[i], got.ends[i + 1])] for i in range(len(some))] == want
    by_word: dict = {}
    for h, w in zip(got.hashes.tolist(), (w.lower() for x in want for w in x), strict=True):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)
    assert words.split_words(pa.array([None, ""], pa.string())).ends.tolist() == [0, 0, 0]


def test_exact_dedup(spark, texts, empty):
    docs = make(spark, texts)
    for capacity in (1, 1 << 24):
        got = {r.doc_id: r for r in exact_dedup.exact_dedup(spark, docs, capacity=capacity).collect()}
        groups: dict = {}
        norm = lambda t: "".join(c for c in t or "" if c not in common.BLANKS)
        for i, t in enumerate(texts, 1):
            groups.setdefault(norm(t), []).append((-len(t or ""), i))
        for i, t in enumerate(texts, 1):
            g = groups[norm(t)]
            keep = min(g)[1]
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (keep, len(g), keep == i, hashlib.sha256(norm(t).encode()).hexdigest())
    assert exact_dedup.exact_dedup(spark, empty).count() == 0
    assert exact_dedup.kept_documents(spark, docs).count() == len(groups)
    assert exact_dedup.kept_documents(spark, docs).columns == docs.columns


def test_directory_splits_until_buckets_fit():
    slots = exact_dedup.directory({0: 5, 1: 5, 6: 50, 7: 1}, capacity=10, depth=3)
    assert slots == sorted(slots) and len(slots) == 8
    assert slots[0] == slots[1] and slots[6] != slots[7]
    assert exact_dedup.directory({}, 10, 3) == [0] * 8


def test_exact_dedup_query_matches_sql(spark):
    con = duck(DIR)
    for q in ("op3_exact_dedup", "op8_warc_archives"):
        assert rows_of(queries.queries()[q](spark, DIR)) == duck_rows(con, queries.oracle_sql()[q])


def test_packing(spark, texts, tokenizer, empty):
    docs = make(spark, texts)
    for block in (7, 2048):
        got = packing.pack(spark, docs, capacity=100, block=block).collect()
        want = {i: [*ids_of(tokenizer, t), 1] for i, t in enumerate(texts, 1)}
        seen: dict = {}
        places: dict = {}
        for r in got:
            ids = want[r.doc_id][r.start : r.start + r.length]
            assert len(ids) == r.length and r.start == r.piece * 100
            assert zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)) == r.ids_crc32
            seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert seen == {i: len(x) for i, x in want.items()}
        for p in places.values():
            at = 0
            for offset, length in sorted(p):
                assert offset == at
                at += length
            assert at <= 100
    assert len(places) <= math.ceil(sum(seen.values()) / 100 * 1.1)
    assert packing.pack(spark, empty).count() == 0


def test_crossover_keeps_every_piece_once():
    r = random.Random(1)
    sizes = [r.randint(1, 60) for _ in range(80)]
    a, b = packing.start(sizes, 100, r, 0.5), packing.start(sizes, 100, r, 0.5)
    for _ in range(20):
        c = packing.crossover(sizes, a, b, 100, r)
        assert sorted(i for x in c for i in x) == list(range(80))
        assert all(sum(sizes[i] for i in x) <= 100 for x in c)
        a, b = b, c
    best, greedy = packing.evolve(sizes, 100, 1)
    assert len(best) <= greedy == len(packing.start(sizes, 100, r, 0.0))
    assert packing.evolve([], 100, 1) == ([], 0) and packing.evolve([5], 100, 1) == ([[0]], 1)


def test_packing_evolves_on_real_lengths(spark, monkeypatch):
    from lattica.llm.common import table

    calls = []
    crossing = packing.crossover
    monkeypatch.setattr(packing, "crossover", lambda *a: calls.append(1) or crossing(*a))
    lengths = [r.n // 4 + 2 for r in table(spark, "/root/testdata/sf0.01", "documents").select(F.least("n_chars", F.lit(16000)).alias("n")).collect()]
    best, greedy = packing.evolve(lengths, 4096, 3)
    assert len(calls) == packing.GENERATIONS and len(best) <= greedy
    assert packing.fitness(lengths, best, 4096) >= packing.fitness(lengths, packing.start(lengths, 4096, random.Random(0), 0.0), 4096)
    rows = packing.pack(spark, table(spark, "/root/testdata/sf0.01", "documents")).collect()
    assert {r.generations for r in rows} <= {packing.GENERATIONS * 3, packing.GENERATIONS * 4}
    ids = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= math.ceil(ids / 4096) + 2 and all(r.greedy_bins >= 1 for r in rows)


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, d, "documents"), common.table(spark, d, "labels")
    rows = quality.classify(spark, docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 40
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    assert sum(a > b for a in good for b in bad) / (len(good) * len(bad)) > 0.95
    assert all(r.predicted == int(r.score >= 0.3) and held(r.doc_id, 0) for r in rows)


def test_quality_edges(spark, texts, empty):
    none = spark.createDataFrame([(1, None), (None, 1), (999, 1)], "doc_id long, quality int")
    got = quality.classify(spark, make(spark, texts), none).collect()
    assert len(got) == len(texts) and all(r.score == 0.5 for r in got)
    assert quality.classify(spark, empty, none).count() == 0


def test_fingerprints(spark, texts, empty):
    docs = make(spark, texts)
    got = {r.doc_id: r for r in fingerprints.fingerprints(spark, docs).collect()}
    by_text: dict = {}
    for i, t in enumerate(texts, 1):
        t = t or ""
        k = len(t) // 2
        after = texts[i % len(texts)] or ""
        edited = t[: len(t) - k] + after[:k]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        if edited == t:
            assert r.near_edited == 1 and r.edited_fingerprint == r.fingerprint
    assert fingerprints.fingerprints(spark, empty).count() == 0
    same = fingerprints.fingerprints(spark, make(spark, ["one two"])).collect()[0]
    assert same.near_next == 1
    odd = make(spark, ["one two", "three"]).unionByName(make(spark, ["one two"])).unionByName(make(spark, ["x y"]).withColumn("doc_id", F.lit(None).cast("long")))
    assert sorted((r.doc_id or 0, r.near_next is None) for r in fingerprints.fingerprints(spark, odd).collect()) == [(0, True), (1, False), (2, False)]


def test_fingerprint_likeness_falls_with_change(spark):
    rows = fingerprints.fingerprints(spark, common.table(spark, "/root/testdata/sf0.01", "documents")).select(F.avg("near_edited"), F.avg("near_next"), F.avg((F.col("near_edited") > F.col("near_next")).cast("int"))).first()
    assert rows[0] > 20 * rows[1] and rows[2] > 0.75


def test_language_model(spark, texts, empty):
    docs = make(spark, texts)
    got = {r.doc_id: r for r in lm_scores.score_texts(spark, docs).collect()}
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(w for i, t in enumerate(texts, 1) if not held(i, 1) for w in tokens(t))
    n, z = sum(c.values()), sum(c.values()) + 0.5 * (len(c) + 1)
    for i, t in enumerate(texts, 1):
        r, k = got[i], tokens(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i, 1), len(k), sum(c[w] > 0 for w in k), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / z) for w in k))
        assert r.score < 0
    assert lm_scores.score_texts(spark, empty).count() == 0
    one = next(i for i in range(1, 99) if held(i, 1))
    alone = lm_scores.score_texts(spark, make(spark, ["a b"], first=one)).collect()[0]
    assert (alone.base_score, alone.train_tokens, alone.n_known) == (0, 0, 0)


def tokens_of(text):
    import pyarrow as pa

    return next(lm_scores.tokens(pa.array([text])))[0]


def test_tokens_of_some_texts_at_a_time():
    import pyarrow as pa

    some = ["a b", "", "c d e f g h", None, "a"]
    whole = [tokens_of(t or "").tolist() for t in some]
    for most in (1, 4, 99):
        got = []
        for t, ends in lm_scores.tokens(pa.array(some), most):
            got += [t[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends)]
        assert got == whole


def test_log_frequency_filter_gives_counts_back(spark):
    import numpy as np

    docs = make(spark, ["a b c a b c a b"] * 20 + ["z q"] * 3)
    rows = docs.select("doc_id", F.col("text").alias("_text"))
    counted = common.written(spark, lm_scores.word_counts(rows, "_text", lower=True), "w")
    counts = lm_scores.gram_counts(spark, rows, counted, "_text", 4)
    data, slice_bits, least = lm_scores.build_filter(spark, counts, 4)
    f = lm_scores.Filter(data, 4, slice_bits)
    t = tokens_of("a b z nowhere")
    got = lm_scores.count_of(f.levels(lm_scores.word_grams(t[1:-1])), 1)
    assert 60 / 1.5 < got[0] < 60 * 1.5 and 3 / 1.5 < got[2] < 3 * 1.5 and got[3] == 0
    pair = lm_scores.count_of(f.levels(lm_scores.pair_grams(t[1:2], t[2:3])), least)
    assert 60 / 1.5 < pair[0] < 60 * 1.5
    levels = lm_scores.level(np.array([0, 1, 2, 3, 4, 1000]), 1)
    assert levels[0] == 0 and list(levels) == sorted(levels)


def test_pairs_seen_once_are_held(spark):
    rows = make(spark, ["a b c d"]).select("doc_id", F.col("text").alias("_text"))
    counted = common.written(spark, lm_scores.word_counts(rows, "_text", lower=True), "w")
    data, slice_bits, least = lm_scores.build_filter(spark, lm_scores.gram_counts(spark, rows, counted, "_text", 4), 4)
    t = tokens_of("b c")
    assert lm_scores.count_of(lm_scores.Filter(data, 4, slice_bits).levels(lm_scores.pair_grams(t[1:2], t[2:3])), least)[0] == 1


@pytest.mark.parametrize("filter_bits, chunk", [(1 << 28, 500_000), (1 << 10, 500_000), (1 << 10, 700)])
def test_language_model_does_not_overfill(spark, monkeypatch, filter_bits, chunk):
    monkeypatch.setattr(lm_scores, "CHUNK", chunk)
    r = random.Random(8)
    words = [f"w{int(400 * r.random() ** 3)}" for _ in range(40_000)]
    docs = [" ".join(words[i : i + 100]) for i in range(0, len(words), 100)] + [None, "", words[0], "w1 W2 " * 200]
    tokens = lambda t: [0, *(t or "").lower().split(), 1]
    single: Counter = Counter()
    pair: Counter = Counter()
    for i, t in enumerate(docs, 1):
        if not held(i, 1):
            k = tokens(t)
            single.update(k)
            pair.update(zip(k, k[1:]))
    z = sum(single.values()) - single[0] + 0.5 * (len(single) - 1 + 1)
    got = {x.doc_id: x.score for x in lm_scores.score_texts(spark, make(spark, docs), filter_bits=filter_bits).collect()}
    assert len(got) == len(docs)
    off = []
    for i, t in enumerate(docs, 1):
        k = tokens(t)
        want = sum(math.log10(0.2 * pair[a, b] / single[a] + 0.8 * (single[b] + 0.5) / z if single[a] else (single[b] + 0.5) / z) for a, b in zip(k, k[1:]))
        off.append(abs(got[i] - want) / (len(k) - 1))
    assert max(off) < 0.2 and sum(off) / len(off) < 0.05


def test_model_beats_base_on_held_out_texts(spark):
    r = lm_scores.score_texts(spark, common.table(spark, "/root/testdata/sf0.01", "documents")).filter("held_out").agg(F.sum("score").alias("m"), F.sum("base_score").alias("b")).first()
    assert r.m > r.b


def test_warc_round_trip_and_lookup(spark):
    long = "<p>" + "x" * 200
    rows = [(1, "http://a.example.com/x?y=1", long, "f"), (2, "http://b.example.com/", long, "f"), (3, "http://a.example.com/x?y=1", "short", "f"), (4, None, None, "f"), (5, "not a url", "short", "f"), (2, "http://b.example.com/", long, "f"), (None, "http://c.org/ü \n", long, "f"), (7, "http://d.org/", "é" * 100_000, "f"), (9, "http://e.org/", long, "f"), (9, "http://e.org/", "other " * 50, "f")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, file string")
    archive = warc.write_archives(spark, pages)
    assert archive.parts.count() >= 1
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.round_trip(spark, pages).collect()), key=lambda x: (x[0], x[1], x[3]))
    want = []
    for i, _, html, _ in rows:
        b = (html or "").encode()
        ref = 1 if i == 2 or i == 9 and html == long else None
        want.append((i or 0, "revisit" if ref else "response", ref, len(b), hashlib.sha256(b).hexdigest()))
    assert got == sorted(want, key=lambda x: (x[0], x[1], x[3]))
    found = archive.lookup("http://a.example.com/x?y=1")
    assert sorted(p for _, p in found) == sorted([long.encode(), b"short"])
    assert archive.lookup("http://none.example/") == []
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_warc_index_has_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "LINES", 3)
    pages = spark.range(40).selectExpr("id AS page_id", "concat('http://h', id % 7, '.example.org/', id % 5) AS url", "repeat(cast(id AS string), 3) AS html")
    archive = warc.write_archives(spark, pages)
    parts = archive.places()
    assert archive.parts.agg(F.sum("blocks")).first()[0] >= 13
    reads = []
    raw = warc._raw
    monkeypatch.setattr(warc, "_raw", lambda *a: reads.append(a) or raw(*a))
    for r in pages.collect():
        reads.clear()
        found = archive.lookup(r.url, warc.Reader(parts))
        assert r.html.encode() in [p for _, p in found]
        assert len(reads) <= 4 + 2 + len(found)  # two parts, a block or two of each, and the records
    some = spark.createDataFrame([(warc.surt_of("http://h3.example.org/3"), 3), (warc.surt_of("http://none/"), 1)], "key string, id long")
    assert [r.page_id for r in warc.read_captures(spark, archive, some).collect()] == [3]


def test_base_spans():
    spans = lambda t: pii.written_spans(pii.base_spans(t))
    assert spans("mail a.b@x.example.com, 10.0.0.255 and 300.1.1.1") == "email:5:22,ip:24:34"
    assert spans("a@b.c_d@e.f") == "email:0:5,email:5:11"
    assert spans("4111 1111 1111 1111 and 4111 1111 1111 1112") == "card:0:19"
    assert spans("call +1 (363) 555-6578 now") == "phone:5:22"
    assert spans("") == "" and spans("@ @@ .@.") == ""
    assert spans("0" * 5000 + "1.2.3.4") == "ip:0:5007" and spans("9" * 5000 + ".2.3.4") == ""
    assert not pii.shaped("1.2.3.²", (1, 0, 7)) and pii.shaped("1.2.3.4", (1, 0, 7))
    assert spans("1" * 50_000) == "" and spans("a" * 50_000 + "@") == ""


def test_pii_gradient():
    import numpy as np

    p = {k: v.astype(np.float64) for k, v in pii.initial().items()}
    data = pii.labelled(3, 5)
    ids, mask = pii.batch([t for t, _ in data])
    y = np.zeros(ids.shape, int)
    for k, (t, s) in enumerate(data):
        y[: len(t), k] = pii.tags(len(t), s)
    _, g = pii.gradient(p, ids, mask, y)
    for k, i in (("V", (3, 1)), ("A", (0, 3)), ("fW", (2, 5)), ("rU", (4, 9)), ("fb", (7,))):
        q = {**p, k: p[k].copy()}
        q[k][i] += 1e-4
        a = pii.gradient(q, ids, mask, y)[0]
        q[k][i] -= 2e-4
        b = pii.gradient(q, ids, mask, y)[0]
        assert (a - b) / 2e-4 == pytest.approx(g[k][i], rel=2e-2, abs=2e-3)


def test_pii_operator(spark, texts, empty):
    model = pii.default_model()
    held_out = pii.labelled(150, 987)
    found = pii.decode(model, [t for t, _ in held_out])
    right = sum(len(set(a) & set(s)) for a, (_, s) in zip(found, held_out, strict=True))
    assert right / sum(map(len, found)) > 0.95 and right / sum(len(s) for _, s in held_out) > 0.9
    rows = [*texts, "call +1 (269) 555-3296 4524132264652876 and", "write to me@host.example.org " * 400]
    got = {r.doc_id: r for r in pii.find_pii(spark, make(spark, rows), model=model).collect()}
    for i, t in enumerate(rows, 1):
        base = pii.base_spans(t or "")
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(pii.written_spans(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in range(4)]
        assert set(filter(None, pii.written_spans(base).split(","))) <= set(r.spans.split(","))
    assert got[len(rows)].n_email == 400
    assert pii.find_pii(spark, empty, model=model).count() == 0


def test_a_long_text_of_digits_is_decoded_in_linear_time():
    import time

    p = pii.initial()
    took = []
    for n in (100_000, 200_000):
        t = ("4111 1111 1111 1111, " * (n // 21))[:n]
        begun = time.process_time()
        pii.decode(p, [t])
        took.append(time.process_time() - begun)
    assert took[1] < 3 * took[0]


def test_a_name_before_at_stays_in_one_window():
    t = "x " * 60 + "maximiliana.wolfeschlegelstein @ host.example.com and " + "y " * 60
    a, b = t.index("maximiliana"), t.index(" and")
    assert any(x <= a and b <= y for x, y in pii.windows(t))


def test_windows_cover_every_mark():
    r = random.Random(2)
    t = "".join(r.choice("ab 1@") if r.random() < 0.1 else "x" for _ in range(3000))
    for m in pii.MARK.finditer(t):
        assert any(a <= m.start() < b and (a == 0 or m.start() - a >= pii.MARGIN) and (b == len(t) or b - m.start() >= pii.MARGIN) for a, b in pii.windows(t))


def brute_components(texts, k, percent):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])

    sets = {i: shingles(t) for i, t in enumerate(texts, 1)}
    uf = UnionFind()
    for i in sets:
        for j in range(1, i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                uf.union(i, j)
    return {i: (len(s), uf.find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("k, percent, chunk, short, frequent", [(4, 85, 600, 64, 16), (4, 85, 5, 3, 1), (5, 80, 4, 2, 2)])
def test_near_copies(spark, monkeypatch, k, percent, chunk, short, frequent):
    r = random.Random(k * chunk)
    words = [f"w{i}" for i in range(400)]
    passage = [r.choice(words) for _ in range(30)]
    out = []
    for _ in range(6):
        base = [r.choice(words) for _ in range(r.randint(40, 120))]
        for _ in range(r.randint(2, 25)):
            w = list(base)
            for _ in range(r.randint(0, 6)):
                w[r.randrange(len(w))] = r.choice(words)
            out.append(" ".join(w))
    out += [" ".join([*passage, *(r.choice(words) for _ in range(r.randint(0, 40)))]) for _ in range(25)]
    out += [None, "", "  ", "one", "ONE", "one two", out[0], out[0].upper()]
    r.shuffle(out)
    monkeypatch.setattr(near_copies.chains, "__defaults__", (short,))
    got = near_copies.near_copies(spark, make(spark, out), words=k, percent=percent, chunk=chunk, frequent=frequent)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got.collect()} == brute_components(out, k, percent)


def test_near_copies_of_a_template(spark, monkeypatch):
    """Texts that share a long passage: links are whole, and the passage alone makes no candidates."""
    r = random.Random(7)
    passage = [f"p{i}" for i in range(100)]
    own = [r.choice([0, 1, 2, 3, 4, 6, 8, 9, 10, 11, 12, 14, 17, 20, 25]) for _ in range(150)]
    out = [" ".join([*(f"a{i}x{j}" for j in range(n // 2)), *passage, *(f"b{i}x{j}" for j in range(n - n // 2))]) for i, n in enumerate(own)]
    out += [" ".join([*passage[:50], *(f"m{i}x{j}" for j in range(r.randint(0, 9))), *passage[50:]]) for i in range(60)]
    monkeypatch.setattr(near_copies.chains, "__defaults__", (8,))
    for frequent in (2, 16):
        got = near_copies.near_copies(spark, make(spark, out), words=4, percent=85, chunk=20, frequent=frequent)
        assert {x.doc_id: (x.n_shingles, x.component_id) for x in got.collect()} == brute_components(out, 4, 85)
    unlike = [" ".join([*(f"a{i}x{j}" for j in range(5)), *passage, *(f"b{i}x{j}" for j in range(5 + i % 2))]) for i in range(150)]
    unlike = make(spark, unlike).select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    sent = spark.sparkContext.broadcast(near_copies.frequent_grams(spark, unlike, 4, 85, 2).tobytes())
    sets = near_copies.prefixes(spark, unlike, 4, 85, sent).select(F.col("_id").alias("gid"), "n", "rare", "prefix")
    assert sets.count() == 150 and near_copies.chains(spark, sets, 85).count() == 0


def test_near_copies_edges(spark, empty):
    assert near_copies.near_copies(spark, empty).count() == 0
    odd = make(spark, ["a b c d e f"]).unionByName(make(spark, ["a b c d e f"])).unionByName(make(spark, ["a b c d e f", "z y x w v"]).withColumn("doc_id", F.lit(None).cast("long")))
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in near_copies.near_copies(spark, odd).collect()) == [(0, 0), (0, 1), (1, 1), (1, 1)]
    kept = near_copies.first_of_each(spark, make(spark, ["a b c d e f g h", "q", "A b c d e f g h"]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.v: r.component for r in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    uf = UnionFind()
    for a, b in edges:
        uf.union(a, b)
    assert got == {v: uf.find(v) for e in edges for v in e if uf.find(v) != v}
    assert components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixing_meets_targets(spark, empty):
    d = "/root/testdata/sf0.01"
    got = queries.op2_mixing_to_targets(spark, d).collect()
    names = sorted(queries.LANGUAGES)
    totals = {n: sum(r[f"p_{n}"] * r.n_tokens * r.rate for r in got) for n in names}
    for n in names:
        assert totals[n] / sum(totals.values()) == pytest.approx(queries.LANGUAGES[n], abs=1e-4)
    assert all(r.rate >= 0 and sum(r[f"p_{n}"] for n in names) == pytest.approx(1) for r in got)
    langs = {r.doc_id: r.lang for r in common.table(spark, d, "documents").collect()}
    assert sum(max(names, key=lambda n: r[f"p_{n}"]) == langs[r.doc_id] for r in got) / len(got) > 0.9
    labels = spark.createDataFrame([], "doc_id long, domain string")
    assert mixing.mix(spark, empty, labels, {"a": 1.0, "b": 1.0}).count() == 0
    rates = mixing.mix(spark, make(spark, ["x y", None, ""]), labels, {"a": 3.0, "b": 1.0}).collect()
    assert len(rates) == 3 and all(r.p_a == 0.5 for r in rates)


def test_rates_stay_within_bounds(spark):
    soft = spark.createDataFrame([(100, [1.0, 0.0]), (10, [0.0, 1.0]), (50, [0.5, 0.5])], "__tokens long, __p array<double>")
    steps = mixing.fit_rates(soft, [0.0, 1.0])
    rows = soft.select("__tokens", "__p", mixing._rate(steps, 0.0, 10.0).alias("r")).collect()
    assert all(0 <= r.r <= 10 for r in rows) and rows[0].r < 0.2


@pytest.mark.parametrize("shares, low, high, grow, sharp", [([0.2, 0.59, 0.015, 0.195], 0.0, 4.0, False, 2.0), ([0.2, 0.59, 0.015, 0.195], 1.0, math.inf, True, 2.0), ([0.05, 0.9, 0.02, 0.03], 1.0, math.inf, True, 1.0)])
def test_rates_reach_targets_where_bounds_bind(spark, shares, low, high, grow, sharp):
    import numpy as np

    g = np.random.default_rng(4)
    own = g.choice(4, 3000, p=shares)
    s = g.normal(0, 1, (3000, 4))
    s[np.arange(3000), own] += 2 * sharp
    q = np.exp(s)
    q /= q.sum(1, keepdims=True)
    tokens = g.integers(50, 500, 3000)
    soft = spark.createDataFrame([(int(t), x.tolist()) for t, x in zip(tokens, q, strict=True)], "__tokens long, __p array<double>").coalesce(1).cache()
    want = [0.17, 0.50, 0.15, 0.18]
    steps = mixing.fit_rates(soft, want, low, high, grow)
    rates = np.array([r.r for r in soft.select(mixing._rate(steps, low, high).alias("r")).collect()])
    assert rates.min() >= low and rates.max() <= high
    got = (rates * tokens) @ q
    assert np.abs(got / got.sum() - want).max() < 1e-4


def test_resampling_meets_targets_on_a_skewed_mix(spark):
    words = {"de": "der hund und die katze", "en": "the dog and a cat", "es": "el perro y los gatos", "fr": "le chien avec une souris"}
    n = {"de": 100, "en": 780, "es": 50, "fr": 70}
    docs = make(spark, [f"{words[d]} " * 5 + f"x{i}" for d in words for i in range(n[d])])
    langs = [d for d in words for _ in range(n[d])]
    labels = spark.createDataFrame([(i, d) for i, d in enumerate(langs, 1)], "doc_id long, domain string")
    targets = queries.LANGUAGES
    times = Counter(r.doc_id for r in mixing.resampled(spark, docs, labels, targets).select("doc_id").collect())
    assert len(times) == 1000
    got = Counter()
    for i, k in times.items():
        got[langs[i - 1]] += k
    for d in targets:
        assert got[d] / got.total() == pytest.approx(targets[d], abs=0.015)


def test_resampling_repeats_rare_texts_in_parts_and_wordless_ones_not_at_all(spark, monkeypatch):
    docs = make(spark, ["the dog and a cat in house " * 10 for _ in range(50)] + ["", None, " \n", "zzz"])
    labels = spark.createDataFrame([(i, "en") for i in range(1, 51)], "doc_id long, domain string")
    times = Counter(r.doc_id for r in mixing.resampled(spark, docs, labels, queries.LANGUAGES).select("doc_id").collect())
    assert [times[i] for i in (51, 52, 53)] == [1, 1, 1] and times[54] > mixing.COPIES and set(times) == set(range(1, 55))
    monkeypatch.setattr(mixing, "fit_rates", lambda *args, **more: [[-1e11] * 4])  # more copies than an int counts
    wordless = docs.filter("doc_id BETWEEN 51 AND 53")
    assert Counter(r.doc_id for r in mixing.resampled(spark, wordless, labels, queries.LANGUAGES).collect()) == {51: 1, 52: 1, 53: 1}


def test_repeated_rows_are_dealt_to_tasks(spark, monkeypatch):
    n = [1, 2, 10, 11, 20, 21, 5_003]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(n)], "i long, n long")
    for at_once in (1, 10, 10_000):
        assert Counter(r.i for r in mixing.repeated(df, F.col("n"), ["i"], at_once).collect()) == dict(enumerate(n))
    monkeypatch.setattr(mixing, "TASK_COPIES", 100_000)
    one = mixing.repeated(spark.range(1), F.lit(2_000_500).cast("long"), ["id"])
    sizes = one.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r[1] for r in sizes) == 2_000_500 and max(r[1] for r in sizes) <= 200_000


def test_pipeline_by_stages(spark):
    import corpus_pipeline as cp

    d = "/root/testdata/sf0.01"
    docs = common.table(spark, d, "documents")
    columns = docs.columns
    labels = {r.doc_id: r.quality for r in common.table(spark, d, "labels").collect()}
    before = docs
    results = []
    for name, stage in cp.STAGES:
        after = common.written(spark, stage(spark, before, d), "stage")
        results.append((name, before, after))
        if name != cp.STAGES[-1][0]:
            assert after.columns == columns
        before = after
    _, a, b = results[0]
    kept = {r.doc_id for r in b.select("doc_id").collect()}
    assert sum(i in kept for i, y in labels.items() if y == 1) / sum(labels.values()) > 0.95
    assert sum(i in kept for i, y in labels.items() if y == 0) < 0.1 * sum(y == 0 for y in labels.values())
    _, a, b = results[1]
    norm = lambda t: "".join(c for c in t if c not in common.BLANKS)
    rows = a.collect()
    best: dict = {}
    for r in rows:
        best[norm(r.text)] = min(best.get(norm(r.text), (0, 1 << 60)), (-len(r.text), r.doc_id))
    assert sorted(r.doc_id for r in b.collect()) == sorted(x[1] for x in best.values())
    _, a, b = results[2]
    rows = sorted(a.collect(), key=lambda r: r.doc_id)
    comp = brute_components([r.text for r in rows], 5, 80)
    assert sorted(r.doc_id for r in b.collect()) == [r.doc_id for i, r in enumerate(rows, 1) if comp[i][1] == i]
    _, a, b = results[3]
    assert {r.doc_id for r in a.collect()} == {r.doc_id for r in b.collect()}
    _, a, b = results[4]
    assert Counter(r.doc_id for r in b.filter("piece = 0").collect()) == Counter(r.doc_id for r in a.collect())
    assert cp.run(spark, d).count() == b.count()


ODD = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (None, None), (2, None), (3, ""), (4, " \n"), (5, "x " * 3000), (6, "call me@host.example.org 4111 1111 1111 1111")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", 9, "w", 0.5) for i, t in ODD], DOCS)


def test_null_ids_and_repeated_rows(spark, odd, tokenizer):
    ids = Counter(i for i, _ in ODD)
    of = lambda df: Counter(r.doc_id for r in df.collect())
    assert of(token_count.count_tokens(spark, odd)) == ids
    kept = exact_dedup.exact_dedup(spark, odd).collect()
    assert Counter(r.doc_id for r in kept) == ids and {r.keep_id for r in kept if r.group_size == 3} == {1}
    assert sorted((r.doc_id or 0) for r in exact_dedup.kept_documents(spark, odd).collect()) == [1, 4, 5, 6]
    pieces_ = packing.pack(spark, odd, capacity=1000).collect()
    assert Counter(r.doc_id for r in pieces_ if r.piece == 0) == ids
    assert sum(r.length for r in pieces_) == sum(len(ids_of(tokenizer, t)) + 1 for _, t in ODD)
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 1, 2, 3, 5)], "doc_id long, quality int")
    scores = quality.classify(spark, odd, labels).collect()
    assert Counter(r.doc_id for r in scores) == ids and len({r.score for r in scores if r.doc_id in (2, 3, 4)}) == 1
    assert of(lm_scores.score_texts(spark, odd)) == ids
    assert of(pii.find_pii(spark, odd, model=pii.initial())) == ids
    assert of(near_copies.near_copies(spark, odd)) == ids
    domains = spark.createDataFrame([(1, "a"), (5, "b")], "doc_id long, domain string")
    assert of(mixing.mix(spark, odd, domains, {"a": 1.0, "b": 1.0})) == ids


def test_scores_are_sparse_dot_products(spark, texts):
    import numpy as np

    docs = make(spark, texts)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, len(texts) + 1)], "doc_id long, quality int")
    weights = quality.train(spark, docs, labels)
    codes = quality.WordCodes()
    for r in quality.scored(spark, docs.drop("score"), weights).collect():
        at, x = quality.vector(quality.grams(codes, (r.text or "").encode()))
        assert r.score == pytest.approx(1 / (1 + math.exp(-float(np.dot(weights[at], x)))), abs=1e-5)


def test_fits_take_whole_texts():
    import pyarrow as pa

    at, x = quality.vector(quality.grams(quality.WordCodes(), b" ".join(b"w%d" % i for i in range(5000))))
    assert len(at) > 9000
    assert len(mixing.slots_of(pa.array(["w " * 5000]))[0]) == 5000


def test_pipeline_stages_on_odd_and_empty_tables(spark, odd, empty):
    import corpus_pipeline as cp

    plain = ["doc_id", "text", "lang", "source", "n_chars"]
    for name, stage in cp.STAGES:
        for docs in (odd.select(*plain), empty.select(*plain)):
            out = stage(spark, docs, DIR)
            rows = out.collect()
            if name != cp.STAGES[-1][0]:
                assert out.columns == plain
            if docs is not odd and not docs.take(1):
                assert not rows
    assert sum(r.doc_id in (2, 3, 4) for r in cp.near_copies(spark, odd.select(*plain), DIR).collect()) == 3
