import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from pathgrade.llm import bpe, packed, separators

from .conftest import EDGES


@pytest.fixture(scope="module")
def enc():
    return bpe.encoder(bpe.vocabulary_path())


def plain(enc, text):
    return enc.tok.encode(text or "", add_special_tokens=False).ids


TEXTS = ["", None, "It's don't 'SE I'LL", "a<|endoftext|>b", "ÀÉ, ß!? ÿ:;", "é ̈x İ K ﬁ", "12 3a4 a,b ,,, x\u0085z", "a\x1cb", "Two, two. TWO two"]


def test_columns_equal_single_texts(enc):
    ids, at = enc.column(pa.array(TEXTS))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [plain(enc, t) for t in TEXTS]


@pytest.mark.parametrize("text", ["ab" * 3000, "a" * 5000, "!" * 3000, "x<|endoftext|>" * 300, " " * 3000, "日本語" * 900, "'s't're" * 500, "é" * 2000])
def test_tree_equals_whole(enc, text):
    for size in (300, 777, 2048):
        pieces = []
        for k in range(0, len(text), size):
            ids, at = enc.placed(text[k : k + size])
            pieces.append((text[k : k + size], k, ids, at + k))
        assert bpe.encode_tree(enc, pieces).tolist() == plain(enc, text)


def test_tree_on_random_text(enc):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdeé'sl1 ,") for _ in range(6000))
    pieces = []
    for k in range(0, len(text), 500):
        ids, at = enc.placed(text[k : k + 500])
        pieces.append((text[k : k + 500], k, ids, at + k))
    assert bpe.encode_tree(enc, pieces).tolist() == plain(enc, text)


def test_digests(spark, enc, edges, nothing):
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip_digests(edges).collect())
    want = []
    for doc, text, *_ in EDGES:
        ids = plain(enc, text)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((doc or -1, len(ids), sha(" ".join(map(str, ids))), sha(enc.tok.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want)
    assert bpe.round_trip_digests(nothing).count() == 0


def test_decode_inverts(spark, enc, edges):
    rows = bpe.decode_documents(bpe.encode_documents(edges.where("doc_id < 6"))).collect()
    assert {r.doc_id: r.text for r in rows}[5] == enc.decode(np.array(plain(enc, EDGES[5][1])))


@pytest.mark.parametrize("width", [1, 5, 8, 15, 16, 17, 31])
def test_packing(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1001).astype(np.uint32)
    data = packed.pack(ids, width)
    assert len(data) == -(-len(ids) * width // 8) and (packed.unpack(data, width, len(ids)) == ids).all()


def test_packed_files(spark, enc, edges, nothing, tmp_path):
    manifest = packed.write(edges, f"file://{tmp_path}/ids", block=1000)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in packed.read(manifest).orderBy("start").collect()]
    order = sorted(EDGES, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, want = 0, []
    import zlib

    for doc, text, *_ in order:
        ids = np.array([*plain(enc, text), packed.END_ID], "<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    first = packed.Reader(manifest.orderBy("shard").first().path)
    assert first.document(0).tolist() == [*plain(enc, order[0][1]), packed.END_ID]
    assert packed.read(packed.write(nothing)).count() == 0
    # files that end early give the same rows
    many = packed.write(edges, f"file://{tmp_path}/many", block=1000, file_ids=3000, file_docs=2)
    assert many.count() > manifest.count() and [tuple(r) for r in packed.read(many).orderBy("start").collect()] == want


def test_separator_scan(spark, enc, edges, nothing):
    special = bpe.encoder(bpe.vocabulary_path(), plain_specials=True)
    got = sorted((r.doc_id or -1, r.n_tokens) for r in separators.document_token_counts(edges).collect())
    assert got == sorted((r[0] or -1, len(plain(special, r[1]))) for r in EDGES)
    assert separators.document_token_counts(nothing).count() == 0


def test_documents_span_blocks(spark, tmp_path):
    ids = np.array([5, 6, 9, 9, 1, 2, 3, 4, 5, 6, 7, 9, 8, 8], "<u2")
    (tmp_path / "x.tokens").write_bytes(ids.tobytes())
    (tmp_path / "empty.tokens").write_bytes(b"")
    paths = spark.createDataFrame([(f"file://{tmp_path}/{n}.tokens",) for n in ("x", "empty")], "file string")
    for block, group in ((2, 1), (2, 3), (4, 2), (6, 1024), (1000, 1)):
        rows = separators.count_tokens(paths, end_id=9, block_bytes=block, group_blocks=group).orderBy("nth").collect()
        assert [(r.nth, r.start, r.n_tokens, r.closed) for r in rows] == [(0, 0, 2, True), (1, 3, 0, True), (2, 4, 7, True), (3, 12, 2, False)]
