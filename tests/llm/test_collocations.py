import random
import re
from collections import Counter

import numpy as np
import pytest

from lendframe.llm import collocations, flat, queries, quotient
from tests.compare import differences
from tests.llm.conftest import make_docs


def brute(rows, least, longest, top):
    """rows: (lang, text). The first phrases of each language, straight from the definition."""
    counts, sizes = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for k in range(1, longest + 1):
                for s in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[s : s + k])] += 1
    out = []
    for lang, f in counts.items():
        n, found = sizes[lang], []
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        for p, a in candidates.items():
            inside = any(
                len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, b in candidates.items()
            )
            if not inside:
                score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def found(docs, **more):
    names = "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    return sorted(tuple(r[c] for c in names) for r in collocations.collocations(docs, **more).collect())


def lang_docs(spark, rows):
    made = [(i, text, lang, "s", 1, "v", 2, "i") for i, (lang, text) in enumerate(rows)]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, shard string, a long, vocab string, n long, ids string")


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(11)
    words = ["to", "be", "or", "Not", "é", "日本", "that", "is", "x", "zz"]
    marks = [" ", " ", " ", "  ", "\t", ", ", ".\n", " ?", "\x0b", "\xa0"]
    out = []
    for i in range(300):
        text = "".join(w + draw.choice(marks) for w in draw.choices(words, weights=range(10, 0, -1), k=draw.randint(0, 80)))
        out.append((["en", "de", None, ""][min(3, i % 7)], text + "to be or not to be" * (i % 3 == 0)))
    return [*out, ("en", None), ("en", ""), (None, None), ("en", " . , "), ("fr", "never often"), *out[:20]]


def test_equals_sql(spark, sf_dir):
    name = "op12_collocations"
    assert not differences(spark, sf_dir, queries.queries()[name], queries.oracle_sql()[name])


@pytest.mark.parametrize(("least", "longest", "top"), [(100, 5, 2000), (3, 5, 2000), (8, 3, 7), (20, 2, 3), (1, 4, 50)])
def test_equals_all_phrases(spark, rows, least, longest, top):
    assert found(lang_docs(spark, rows), least=least, longest=longest, top=top) == brute(rows, least, longest, top)


def test_many_shards_and_ranges(spark, rows, monkeypatch):
    """Filters of many shards over many ranges, merged: what one shard has is rarely frequent by itself."""
    parts = collocations.frequent_phrases
    monkeypatch.setattr(collocations, "RANGE_KEYS", 40)
    docs = lang_docs(spark, rows).repartition(13)
    from lendframe.llm.tables import Store

    words, _, phrases = parts(docs, 5, 5, Store(spark))
    name = {r["id"]: (r["lang"], r["word"]) for r in words.collect()}
    got = Counter({(name[r["ids"][0]][0], tuple(name[i][1] for i in r["ids"])): r["a"] for r in phrases.collect()})
    want = Counter()
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            have = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 6):
                for s in range(len(have) - k + 1):
                    want["und" if lang is None else lang, tuple(have[s : s + k])] += 1
    assert got == Counter({p: a for p, a in want.items() if a >= 5})


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [("en", r["text"]) for r in odd_docs.collect()]
    assert found(odd_docs, least=4) == brute(rows, 4, 5, 2000)
    assert not found(no_docs)
    assert not found(make_docs(spark, [(1, None), (2, ""), (3, ".,;")]))


def test_two_words_of_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(flat, "hashes", lambda data, starts, stops: np.zeros(len(starts), np.uint64))
    data = np.frombuffer(b"a bb a cc bb a", np.uint8)
    starts, stops = np.array([0, 2, 5, 7, 10, 13]), np.array([1, 4, 6, 9, 12, 14])
    first, inverse, counts, _ = collocations._numbered(data, starts, stops, np.zeros(6, np.int64), np.zeros(1, np.uint64))
    words = [data[starts[i] : stops[i]].tobytes() for i in first]
    assert [words[i] for i in inverse] == [b"a", b"bb", b"a", b"cc", b"bb", b"a"] and counts[inverse[0]] == 3


@pytest.mark.parametrize(("n", "bits"), [(2, 1), (2, 7), (3, 17), (5, 12), (5, 14), (4, 32), (5, 32), (2, 32)])
def test_filters_lose_nothing(n, bits):
    layout, draw = quotient.Layout(n, bits), np.random.default_rng(n * bits)
    ids = [draw.integers(0, 1 << bits, 4000, dtype=np.uint64) for _ in range(n)]
    packed = quotient.pack(ids, layout)
    keys = quotient.permute(packed, layout)
    for a, b in zip(quotient.unpack(quotient.restore(keys, layout), layout), ids, strict=True):
        assert (a == b).all()
    order, heads = quotient.sorted_groups(keys, layout)
    keys = [p[order[heads]] for p in keys]
    counts = draw.choice([1, 1, 2, 254, 255, 256, 1 << 40], len(heads))
    range_bits = min(2, layout.widths[0])
    of = quotient.range_of(keys, layout, range_bits)
    for number in np.unique(of):
        own = [p[of == number] for p in keys]
        read = quotient.decode(quotient.encode(own, counts[of == number], layout, range_bits), layout, range_bits)
        assert all((a == b).all() for a, b in zip(read.keys(int(number), layout, range_bits), own, strict=True))
        assert (read.counts == counts[of == number]).all()
        assert (read.count_of(own, layout, range_bits) == read.counts).all()
        other = [draw.integers(0, 1 << w, 500, dtype=np.uint64) if w < 64 else draw.integers(0, 2**63, 500).astype(np.uint64) for w in layout.widths]
        other[0] = (other[0] & quotient._mask(layout.widths[0] - range_bits)) | (np.uint64(number) << np.uint64(layout.widths[0] - range_bits))
        known = {t: c for *t, c in zip(*(p.tolist() for p in own), counts[of == number].tolist(), strict=True) for t in [tuple(t)]}
        asked = list(zip(*(p.tolist() for p in other), strict=True))
        assert read.count_of(other, layout, range_bits).tolist() == [known.get(t, 0) for t in asked]


def test_filters_are_compact():
    """About the full remainder and three bits a key: far less than the packed n-gram and a counter of eight bytes."""
    layout, draw = quotient.Layout(2, 17), np.random.default_rng(1)
    keys = quotient.permute(quotient.pack([draw.integers(0, 1 << 17, 100_000) for _ in range(2)], layout), layout)
    order, heads = quotient.sorted_groups(keys, layout)
    data = quotient.encode([p[order[heads]] for p in keys], np.ones(len(heads), np.int64), layout, 0)
    assert len(data) < 5 * len(heads)


def test_merging_adds_up():
    layout, draw = quotient.Layout(3, 5), np.random.default_rng(4)
    held, want = [], Counter()
    for _ in range(4):
        ids = [draw.integers(0, 8, 300) for _ in range(3)]
        keys = quotient.permute(quotient.pack(ids, layout), layout)
        order, heads = quotient.sorted_groups(keys, layout)
        held.append(([p[order[heads]] for p in keys], np.diff(np.append(heads, 300))))
        want.update(zip(*(i.tolist() for i in ids), strict=True))
    keys, total, group = quotient.merged([k for k, _ in held], [c for _, c in held], layout)
    ids = quotient.unpack(quotient.restore(keys, layout), layout)
    assert dict(zip(zip(*(i.tolist() for i in ids), strict=True), total.tolist(), strict=True)) == want
    assert np.bincount(group, np.concatenate([c for _, c in held])).astype(int).tolist() == total.tolist()
