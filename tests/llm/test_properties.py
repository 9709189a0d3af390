"""Properties over random inputs."""

from __future__ import annotations

import re

import pyarrow as pa
import pytest

pytest.importorskip("lattica.llm")
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from lattica.llm import exact_dedup, near_copies, packing, pii, warc, wordbpe  # noqa: E402

TEXT = st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(list("aAbB .,'!<|>123\n\té́ßİ-_&s"))), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_word_ids_equal_whole_text_ids(text):
    ids = wordbpe.load().encode(text, add_special_tokens=False).ids
    assert [x.tolist() for x in wordbpe.WordIds(max_words=64).encode(pa.array(["a", text]).slice(1))] == [ids]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1.@_-+ ", max_size=40))
def test_emails_are_the_patterns(text):
    pattern = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    assert [(0, *m.span()) for m in pattern.finditer(text)] == pii._emails(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="0129. ", max_size=40))
def test_ips_are_the_patterns(text):
    pattern = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    want = [(1, *m.span()) for m in pattern.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    assert [s for s in pii.base_spans(text) if s[0] == 1] == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60), st.integers(0, 5))
def test_packings_are_whole(sizes, seed):
    bins, _ = packing.evolve(sizes, 50, seed)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 50 for b in bins)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 63), st.integers(1, 30), max_size=40), st.integers(1, 60))
def test_directories_are_prefixes(histogram, capacity):
    slots = exact_dedup.directory(histogram, capacity, 6)
    assert len(slots) == 64 and slots == sorted(slots) and set(slots) == set(range(slots[-1] + 1))
    for b in set(slots):
        mine = [i for i in range(64) if slots[i] == b]
        n = len(mine)
        assert n & (n - 1) == 0 and mine[0] % n == 0
        assert n == 1 or sum(histogram.get(i, 0) for i in mine) <= capacity


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 30), min_size=1, max_size=20), st.sets(st.integers(0, 30), min_size=1, max_size=20), st.integers(50, 95), st.sets(st.integers(0, 30), max_size=8))
def test_similar_sets_share_enough_of_their_prefixes(a, b, percent, frequent):
    import numpy as np

    s = near_copies.Shingler(4, percent, np.array(sorted(frequent), np.uint64))
    x, y = (np.array(sorted(v), np.uint64) for v in (a, b))
    both = len(a & b)
    if 100 * both >= percent * (len(a) + len(b) - both):
        shared = len(set(s.prefix(x)[0].tolist()) & set(s.prefix(y)[0].tolist()))
        total, top = len(a) + len(b), max(len(a), len(b))
        need = max(1, -(-percent * total // (100 + percent)) - -(-percent * top // 100) + 1)
        assert shared >= need
        assert near_copies.linked(x, y, percent)


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.none(), st.integers(0, 2**40)), st.one_of(st.none(), st.text(max_size=30)), st.binary(max_size=200), st.one_of(st.none(), st.integers(0, 99)))
def test_records_round_trip(page, url, payload, ref):
    headers, body = warc.parsed(warc.record(page, url, payload, ref))
    assert body == (b"" if ref is not None else payload)
    assert headers["warc-type"] == ("response" if ref is None else "revisit")
    assert int(headers["x-payload-length"]) == len(payload)
