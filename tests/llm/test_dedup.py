import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendframe.llm import components, minhash, suffixes
from lendframe.llm.tables import Store
from tests.llm.conftest import make_docs

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORDS.findall(low)
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def smallest_in_reach(ids, links):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def brute_groups(rows, size):
    sets = [(i, shingles(t, size)) for i, t in rows if i is not None]
    links = [
        (i, j)
        for k, (i, a) in enumerate(sets)
        for j, b in sets[:k]
        if a and b and min(len(a), len(b)) * 10 >= max(len(a), len(b)) * 8 and 100 * len(a & b) >= 80 * len(a | b)
    ]
    return smallest_in_reach({i for i, _ in sets}, links)


@pytest.mark.parametrize("size", [2, 5])
def test_groups_are_those_of_all_pairs(given, size):
    rows, docs = given
    want = brute_groups(rows, size)
    found = minhash.near_duplicates(docs, size=size).collect()
    assert {r.doc_id: r.component_id for r in found} == want
    assert {r.doc_id: r.n_shingles for r in found} == {i: len(shingles(t, size)) for i, t in rows}
    assert all(r.kept == (r.doc_id == r.component_id) for r in found) and len(found) == len(rows)


def test_large_groups_of_unequal_copies(spark, prose):
    """Copies at growing distance from one text, and groups that only hang together by single links."""
    base, other = prose(90).split(), prose(80).split()
    rows = [(1000 + k, " ".join(base[: 90 - k % 30] + [f"w{k}x{j}" for j in range(k % 30)])) for k in range(150)]
    rows += [(500 + k, " ".join(other[k : k + 40])) for k in range(0, 40, 2)]
    found = minhash.near_duplicates(make_docs(spark, rows), size=2).collect()
    assert {r.doc_id: r.component_id for r in found} == brute_groups(rows, 2)


def test_blocks_of_a_list_give_the_links_of_the_whole(spark, prose, monkeypatch):
    base = prose(60).split()
    rows = [(k, " ".join(base[: 60 - k % 25] + [f"v{k}y{j}" for j in range(k % 25)])) for k in range(100)]
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 900)
    found = minhash.near_duplicates(make_docs(spark, rows), size=2).collect()
    assert {r.doc_id: r.component_id for r in found} == brute_groups(rows, 2)


def test_texts_of_common_shingles_are_not_compared(spark, monkeypatch):
    """Texts of few words share every shingle with many others: what is kept must not hold each under all of these."""
    draw = np.random.default_rng(5)
    rows = [(k, " ".join(f"w{w}" for w in draw.integers(0, 60, 150))) for k in range(400)]
    rows += [(1000 + k, f"{rows[k][1]} end{k}") for k in (0, 200)]
    kept, keep = [], Store.keep
    monkeypatch.setattr(Store, "keep", lambda self, df: kept.append(keep(self, df)) or kept[-1])
    found = minhash.near_duplicates(make_docs(spark, rows), size=2).collect()
    assert {r.doc_id: r.component_id for r in found} == brute_groups(rows, 2)
    # The table that is dropped has as many rows as there are texts.
    assert max(df.count() for df in kept[1:]) < 2 * len(rows)


def test_bits_and_keys_let_pairs_of_the_bound_pass():
    """Pairs of exactly four fifths, for sets of every size: the bits never rule them out, one key at least is common."""
    draw = np.random.default_rng(6)
    most = minhash.most_differing(minhash.key_count(6, 80) * 6, 80)
    for n in (4, 8, 40, 400):
        for _ in range(100):
            values = draw.integers(-(2**63), 2**63 - 1, n + n // 4)
            one, other = np.unique(values[:n]), np.unique(values[n // 8 : n // 8 + n])
            shared = len(np.intersect1d(one, other))
            if 100 * shared < 80 * (len(one) + len(other) - shared):
                one, other = np.unique(values), np.unique(values[:n])
            keys, bits = minhash.signatures([one, other], 6, 80)
            assert (keys[0] == keys[1]).any()
            assert np.bitwise_count(bits[0].view(np.uint64) ^ bits[1].view(np.uint64)).sum() <= most
    far = [np.unique(draw.integers(-(2**63), 2**63 - 1, 300)) for _ in range(60)]
    keys, bits = minhash.signatures(far, 6, 80)
    assert all(len(np.unique(column)) == len(far) for column in keys.T)
    for word in range(1, len(far)):
        assert np.bitwise_count(bits[0].view(np.uint64) ^ bits[word].view(np.uint64)).sum() > most


def test_sets_are_read_from_where_they_begin(tmp_path):
    sets = [np.arange(n, dtype=np.int64) * 7 + n for n in (3, 1, 9, 4)]
    for name in "pq":
        (tmp_path / name).write_bytes(b"".join(s.tobytes() for s in sets))
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    wanted = [2, 0, 2, 3, 1, 0]
    uris = np.array([f"file://{tmp_path}/{name}" for name in "pqqppq"], dtype=object)
    found = minhash.read_sets(uris, starts[wanted], sizes[wanted])
    assert all(np.array_equal(f, sets[i]) for f, i in zip(found, wanted, strict=True))


def test_near_duplicates_of_odd_rows(odd_docs, no_docs):
    found = minhash.near_duplicates(odd_docs, size=2).collect()
    assert len(found) == odd_docs.count()
    of = defaultdict(set)
    for r in found:
        of[r.doc_id].add((r.n_shingles > 0, r.component_id, r.kept))
    assert of[None] == {(True, None, True), (False, None, True)}
    assert of[1] == {(False, 1, True)} and of[2] == {(False, 2, True)} and of[3] == {(False, 3, True)}
    assert of[4] == {(True, 4, True)} and of[6] == {(True, 6, True)} and of[7] == {(True, 6, False)}
    assert minhash.near_duplicates(no_docs).count() == 0


def test_two_texts_of_one_doc_id_are_one_document(spark, prose):
    one, two = prose(50), prose(50)
    rows = [(1, one), (2, one), (2, two), (3, two), (4, prose(50))]
    found = minhash.near_duplicates(make_docs(spark, rows), size=2).collect()
    assert {r.doc_id: r.component_id for r in found} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_components_over_many_partitions(spark, monkeypatch):
    """A long path, a star and loops, contracted in several partitions."""
    monkeypatch.setattr(components, "BLOCK_EDGES", 40)
    draw = np.random.default_rng(3)
    path = draw.permutation(300).tolist()
    links = [(a, b) for a, b in zip(path[:100], path[1:100])] + [(400, k) for k in range(401, 460)] + [(5000, 5000)]
    frame = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    found = {r.node: r.component for r in components.components(frame, Store(spark)).collect()}
    nodes = {x for link in links for x in link} - {5000}
    want = smallest_in_reach(nodes, [link for link in links if link[0] != link[1]])
    assert found == want


def covered(rows, least=50):
    where = defaultdict(set)
    for i, t in rows:
        words = WORDS.findall(t or "")
        for p in range(len(words) - least + 1):
            where[tuple(words[p : p + least])].add(i)
    out = defaultdict(set)
    for i, t in rows:
        words = WORDS.findall(t or "")
        for p in range(len(words) - least + 1):
            if len(where[tuple(words[p : p + least])]) > 1:
                out[i].update(range(p, p + least))
    return dict(out)


def spans_of(frame):
    out = defaultdict(set)
    for r in frame.collect():
        assert r.n_words == r.end_word - r.start_word >= 50 and r.other_doc_id != r.doc_id
        out[r.doc_id].update(range(r.start_word, r.end_word))
    return dict(out)


def test_passages_are_those_of_all_windows(given):
    rows, docs = given
    assert spans_of(suffixes.repeated_passages(docs)) == covered(rows)


def test_passages_of_every_length_and_over_partition_ends(spark, prose):
    shared = prose(200).split()
    rows = [(k, f"{prose(30)} {' '.join(shared[k : k + 40 + k])} {prose(25)}") for k in range(0, 90, 3)]
    rows += [(900, " ".join([*shared[:60]] * 5)), (901, " ".join(shared[:60]))]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        assert spans_of(suffixes.repeated_passages(make_docs(spark, rows))) == covered(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_passages_of_odd_rows(odd_docs, no_docs):
    found = spans_of(suffixes.repeated_passages(odd_docs))
    assert set(found) == {6, 7} and all(v == set(range(120)) for v in found.values())
    assert suffixes.repeated_passages(no_docs).count() == 0


def test_edges_of_a_hub_are_dealt_over_all_tasks(spark, monkeypatch):
    """A star around the smallest id, its edges in many parts: none holds more than twice the mean."""
    monkeypatch.setattr(components, "BLOCK_EDGES", 500)
    seen = []
    dealt = components._contracted

    def counted(edges, parts):
        held = edges.repartition(parts, F.xxhash64("a", "b")) if parts > 1 else edges.repartition(1)
        seen.append([r["count"] for r in held.groupBy(F.spark_partition_id()).count().collect()])
        return dealt(edges, parts)

    monkeypatch.setattr(components, "_contracted", counted)
    edges = [(i, 0) for i in range(1, 8001)] + [(i, i + 1) for i in range(9000, 9400)]
    df = spark.createDataFrame(edges, "a long, b long")
    labels = dict(map(tuple, components.components(df, Store(spark)).collect()))
    assert labels == {i: 0 for i in range(8001)} | {i: 9000 for i in range(9000, 9401)}
    parts = seen[0]
    assert len(parts) == 17 and max(parts) <= 2 * sum(parts) / len(parts)


def test_passages_among_texts_that_share_more_on_one_side(spark, prose):
    """Two texts share 56 words; twenty others share 41 of them with one of the two, more on one side and less on the
    other, so that the two are neighbours in neither order."""
    for seed in range(4):
        rows, number = [], 0
        for _ in range(10):
            left, core, right = (prose(n).split() for n in (20, 16, 20))
            more_left, more_right = prose(10).split(), prose(10).split()

            def text(before, after):
                return " ".join([*prose(5).split(), *before, *core, *after, *prose(5).split()])

            rows += [(number, text(left, right)), (number + 1, text(more_left[:1] + left, right + more_right[:1]))]
            for k in range(10):
                rows.append((number + 2 + k, text([], right + more_right[:5])))
                rows.append((number + 12 + k, text(more_left[:5] + left, [])))
            number += 100
        order = np.random.default_rng(seed).permutation(len(rows))
        docs = make_docs(spark, [rows[i] for i in order])
        assert spans_of(suffixes.repeated_passages(docs)) == covered(rows)


def test_partner_has_the_passage(spark, prose):
    """A row names a document that has n_shared words of it in one piece, also where passages with several overlap."""
    words = prose(100).split()
    texts = {1: words, 2: words[:60], 3: words[25:], 4: [*prose(9).split(), *words[40:93]]}
    docs = make_docs(spark, [(i, " ".join(t)) for i, t in texts.items()])
    found = {r.doc_id: r for r in suffixes.repeated_passages(docs).collect()}
    assert set(found) == set(texts) and found[1].n_words == 100
    for i, r in found.items():
        own, other = texts[i][r.start_word : r.end_word], f" {' '.join(texts[r.other_doc_id])} "
        pieces = (" ".join(own[k : k + r.n_shared]) for k in range(len(own) - r.n_shared + 1))
        assert r.n_shared >= 50 and any(f" {piece} " in other for piece in pieces), i


def test_keys_of_very_many_texts_are_spread(spark, prose, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT_ROWS", 3)
    base = prose(70)
    rows = [(i, f"{prose(4)} {base} {prose(4)}") for i in range(12)] + [(50, prose(80)), (51, base)]
    assert spans_of(suffixes.repeated_passages(make_docs(spark, rows))) == covered(rows)
