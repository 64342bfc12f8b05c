import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard

from lendframe.llm import covertree, flat, mixing, pieces, queries, tokenfile, warc
from lendframe.llm.tables import Store
from tests.compare import differences
from tests.llm.conftest import make_docs

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

TRICKY = [
    "", " ", "  a", "a ", "a\n\nb", "a\nb \n c", "▁x", "a▁ b", "it's 's' a 's b", "x\u0000y", "日本 😀 x", "a\xa0b \xa0 c",
    "a b 　c", "a\x85 b", "é à ç\nñ", "a\x1c b", "<|endoftext|> a <|endoftext|>", "<s> hi </s>", "<0x41>", "\t a\tb",
    "a \r\n b", "\x7f a \x7f\n b", "ﬁ é", "aab" * 300, "日本語のテキスト" * 60, " \n \n ", "🏳️‍🌈 family 👨‍👩‍👧", None,
]


def tricky_texts():
    draw = random.Random(5)
    alphabet = list("ab e\nth 's ing ▁日é😀\t0Ā\xa0 \x85\x1c,.!<|endoftext|>")
    return TRICKY + ["".join(draw.choices(alphabet, k=draw.randint(0, 60))) for _ in range(1500)]


def flat_of(texts):
    return flat.flat(pa.array(texts, pa.string()))


def test_pieces_are_those_of_the_library(given):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    encode = pieces.Encoder(PIECES)
    texts = tricky_texts() + [t for _, t in given[0]]
    ids, ends = encode(*flat_of(texts))
    out, cuts = encode.model.decode(ids, ends)
    for i, text in enumerate(texts):
        want = library.encode(text or "", add_bos=True, add_eos=True)
        assert ids[ends[i] : ends[i + 1]].tolist() == want, text
        assert out[cuts[i] : cuts[i + 1]].tobytes().decode() == library.decode(want), text


def test_decoding_of_any_ids():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    model = pieces.model(PIECES)
    draw = random.Random(2)
    for _ in range(300):
        ids = [draw.choice([draw.randrange(3, 259), draw.randrange(259, 32_000), 1, 2, 0]) for _ in range(draw.randint(0, 12))]
        out, _ = model.decode(np.array(ids, np.int64), np.array([0, len(ids)]))
        assert out.tobytes().decode() == library.decode(ids), ids


def test_encoded_rows(spark, odd_docs, no_docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = {i: t for i, t in odd_docs.select("doc_id", "text").collect() if i is not None}
    found = pieces.encoded(odd_docs, PIECES, with_ids=True).collect()
    assert len(found) == odd_docs.count() and pieces.encoded(no_docs, PIECES).count() == 0
    for r in found:
        if r.doc_id is not None:
            want = library.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
            assert r.ids == want and r.n_tokens == len(want)
            assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(library.decode(want).encode()).hexdigest()


def test_byte_level_ids_are_those_of_the_library(given):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    texts = tricky_texts() + [t for _, t in given[0][:80]]
    ids, counts = tokenfile.Encoder(BPE)(*flat_of(texts))
    ends = np.concatenate([[0], np.cumsum(counts)])
    for i, text in enumerate(texts):
        assert ids[ends[i] : ends[i + 1]].tolist() == library.encode(text or "", add_special_tokens=False).ids, text


@pytest.mark.parametrize("unit", [1, 8])
def test_planes_round_trip(unit):
    class Kept(io.BytesIO):
        def close(self):
            pass

    sizes = np.array([3, 0, 600_000, 5, 1])
    ids = np.random.default_rng(1).integers(0, 1 << 17, sizes.sum()).astype(np.uint32)
    stream = Kept()
    writer = tokenfile.Writer(stream, unit)
    writer.add(np.arange(5), ids, sizes)
    writer.close()
    reader = tokenfile.Reader(pa.BufferReader(stream.getvalue()))
    runs = list(reader.documents())
    assert np.array_equal(np.concatenate([r[2] for r in runs]), ids)
    assert np.concatenate([r[1] for r in runs]).tolist() == sizes.tolist()
    assert np.array_equal(reader.block(1), ids[tokenfile.BLOCK_IDS : 2 * tokenfile.BLOCK_IDS])
    broken = bytearray(stream.getvalue())
    broken[40] ^= 255
    with pytest.raises((ValueError, zstandard.ZstdError)):
        tokenfile.Reader(pa.BufferReader(bytes(broken))).block(0)


def test_token_files(spark, given, odd_docs, no_docs, monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    start, want = 0, {}
    for i, text in sorted(given[0]):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    found = tokenfile.token_files(given[1].repartition(5), BPE).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in found} == want
    odd = tokenfile.token_files(odd_docs, BPE).collect()
    assert len(odd) == odd_docs.count() and {r.n_tokens for r in odd if r.doc_id in (1, 2)} == {1}
    ordered = sorted(odd, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted((r.doc_id for r in odd), key=lambda i: -1 if i is None else i)
    assert all(b.start == a.start + a.n_tokens for a, b in zip(ordered, ordered[1:]))
    assert tokenfile.token_files(no_docs, BPE).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_with_sql(spark, sf_dir, name):
    assert differences(spark, sf_dir, queries.queries()[name], queries.oracle_sql()[name]) == []


def mixed_by_hand(rows):
    """(doc_id, source, size) to taken words, by the definition, in plain Python."""
    names = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    of = {s: sum(n for _, x, n in rows if x == s) for s in names}
    total, capped = sum(of.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * of[s] for s in capped)
        level = left / sum(weight[s] for s in free) if free else 0.0
        over = {s for s in free if level * weight[s] > 3 * of[s]}
        if not over:
            return {s: 3.0 * of[s] if s in capped else level * weight[s] for s in names}, of, total
        capped |= over


@pytest.mark.parametrize("chunk_rows", [2, 50_000])
def test_mixing_meets_its_targets(spark, chunk_rows):
    draw = random.Random(4)
    sources = ["b", "a", "Z", None, "é", "hot"]
    rows = [(k, draw.choices(sources, [1, 2, 3, 4, 5, 40])[0], draw.choice([0, 1, 5, 9, 30])) for k in range(300)]
    docs = make_docs(spark, [(k, " ".join(["w"] * n) if n else None, [s]) for k, s, n in rows])
    targets, of, total = mixed_by_hand(rows)
    found = mixing.mix(docs, chunk_rows=chunk_rows).collect()
    again = mixing.mix(docs.repartition(3), chunk_rows=7).collect()
    assert sorted(found, key=lambda r: r.doc_id) == sorted(again, key=lambda r: r.doc_id)
    source, taken = {k: s for k, s, _ in rows}, dict.fromkeys(of, 0)
    for r in found:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (rows[r.doc_id][2], of[s]) and r.target == pytest.approx(targets[s])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    assert sum(taken.values()) <= total and all(abs(taken[s] - targets[s]) <= 60 for s in of)


def test_mixing_of_odd_rows(odd_docs, no_docs):
    found = mixing.mix(odd_docs).collect()
    assert len(found) == odd_docs.count() and mixing.mix(no_docs).count() == 0
    copies = mixing.mix_documents(odd_docs)
    assert copies.columns == odd_docs.columns
    words = sum(r.taken for r in found)
    assert copies.select(mixing.word_count().alias("n")).groupBy().sum("n").first()[0] == words
    assert mixing.mix_documents(no_docs).count() == 0
    assert mixing.mix(odd_docs.where("text IS NULL")).groupBy().sum("taken").first()[0] == 0


VECTORS = "vec_id long, embedding array<float>, label int, query_id long, rank int, part long, block long, size int"


def make_vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, 3, 4, 5) for i, v in rows], VECTORS)


def brute_top(rows, k):
    import math

    fine = [
        (i, [math.floor(1024 * float(np.float32(x))) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, x in dict(fine).items():
        if q % 100 == 0:
            scores = [(-sum(a * b for a, b in zip(x, y)), i) for i, y in fine if i != q and len(y) == len(x)]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def test_top_k_is_that_of_all_pairs(spark, monkeypatch):
    draw = np.random.default_rng(6)
    centres = draw.normal(size=(7, 12))
    rows = [(k, (centres[k % 7] + draw.normal(size=12) * (k % 5) / 3).tolist()) for k in range(1500)]
    rows += [(2000 + k, rows[0][1]) for k in range(30)]  # ties
    monkeypatch.setattr(covertree, "CANDIDATE_BLOCK", 400)
    monkeypatch.setattr(covertree, "QUERY_BLOCK", 6)
    found = covertree.top_k(make_vectors(spark, rows)).collect()
    assert sorted(tuple(r) for r in found) == brute_top(rows, 10)


def test_top_k_leaves_most_pairs_out():
    """The bounds prune: far clusters are never compared with a query's own."""
    draw = np.random.default_rng(8)
    centres = draw.normal(size=(20, 8)) * 1000
    points = np.concatenate([c + draw.normal(size=(200, 8)) * 5 for c in centres]).astype(np.int64)
    compared = []

    class Counted(covertree.Search):
        def compare(self, rows, others):
            compared.append(len(rows) * len(others))
            super().compare(rows, others)

    Counted(np.arange(0, 4000, 40), points[::40], np.arange(4000), points, 10)
    assert sum(compared) < 0.5 * 100 * 4000


def test_top_k_of_odd_rows(spark):
    rows = [
        (0, [1.0, 0.5]), (0, [1.0, 0.5]), (1, [0.25, 0.25]), (2, None), (3, [float("nan"), 1.0]), (4, [None, 1.0]),
        (5, [float("inf"), 0.0]), (None, [9.0, 9.0]), (6, [1.0, 2.0, 3.0]), (100, [1.0, 1.0, 1.0]), (200, []), (7, []),
        (8, [-1e-9, 0.0]), (8, [-1e-9, 0.0]),
    ]
    found = covertree.top_k(make_vectors(spark, rows)).collect()
    assert sorted(tuple(r) for r in found) == brute_top(rows, 10)
    assert covertree.top_k(make_vectors(spark, [])).count() == 0
    assert covertree.top_k(make_vectors(spark, [(3, [1.0])])).count() == 0


PAGES = "page_id long, url string, html string, digest string, first long, n long, r boolean, refers_to long"


def make_pages(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, 2, True, 3) for r in rows], PAGES)


def test_archives_of_odd_rows(spark, prose):
    long = prose(60_000)
    rows = [
        (1, "http://a/ b\r\nX: y", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", long), (6, "u", long),
        (6, "u", long), (None, "u", "same"), (None, "u", "alone"), (7, "u", "ž€😀\r\n\r\n\0"),
    ]
    found = warc.archives(make_pages(spark, rows)).collect()
    first = {}
    for i, _, h in rows:
        first[h or ""] = max(first.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        lead = first[h or ""]
        again = lead >= 0 and i != lead
        want.append((i, len(data), warc.base32_sha1(data), "revisit" if again else "response", lead if again else None))
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
    assert warc.archives(make_pages(spark, [])).count() == 0
    few = warc.archives(make_pages(spark, rows), least_bytes=5).collect()
    assert all(r.record_type == "response" for r in few if r.payload_bytes < 5)


def test_archive_files_can_be_read_frame_by_frame(spark, sf_dir, monkeypatch):
    """Each record is a frame of its own that needs the leading dictionary and nothing else of the file."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = warc.write_archives(pages.coalesce(1), Store(spark)).collect()
    assert sum(m.records for m in manifest) == pages.count()
    path = manifest[0].uri.removeprefix("file:")
    data = open(path, "rb").read()
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_FRAME
    size = int.from_bytes(data[4:8], "little")
    tool = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    frame = tool.decompressobj()
    assert frame.decompress(data[8 + size :]).startswith(b"WARC/1.1\r\nWARC-Type: ")
    with pytest.raises(ValueError):
        list(warc.frames(io.BytesIO(data[:-10])))
    one = next(d for d in warc.frames(io.BytesIO(data)) if b"WARC-Type: response" in d)
    with pytest.raises(ValueError):
        warc.parse(one.replace(b"<body>", b"<bodi>"))
