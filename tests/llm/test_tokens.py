"""Token shards, the digest cache and the encoder behind both."""

import random
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from floodgrid.llm import encoding, token_cache, wavelet
from floodgrid.runtime import shared_dir

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
PIECES = ["word", "Word", "É", "é", "ß", "İ", "Σ", "don't", "'s", "''ll", "I'M", " ", "  ", "\n", "\n\n", "\t", "\x1c", " ", " ", "“q”", "12", "³",
          "%%%", "-", "_x_", "×", "漢字", "😀", "é", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", ".", ",", "\x00", "\x7f"]


@pytest.fixture(scope="module")
def libraries():
    return {f: Tokenizer.from_file(public_tokenizers.path(f)) for f in FILES}


@pytest.mark.parametrize("file", FILES)
@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), min_size=1, max_size=4))
def test_encoder_gives_the_library_ids(libraries, file, texts):
    enc = encoding.encoder(public_tokenizers.path(file), counts=False)
    made = enc.encode([t.encode() for t in texts])
    want = [libraries[file].encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(m, "<u4").tolist() for m in made] == want
    counts = encoding.encoder(public_tokenizers.path(file), counts=True).encode([t.encode() for t in texts])
    assert counts == [len(w) for w in want]


def test_encoder_keeps_few_parts(monkeypatch, libraries):
    monkeypatch.setattr(encoding, "PARTS_KEPT", 5)
    enc = encoding.PieceEncoder(public_tokenizers.path(FILES[0]), counts=True)
    texts = [" ".join(random.Random(i).choices("abcdefghijklmnop", k=30)) for i in range(20)]
    assert enc.encode([t.encode() for t in texts]) == [len(libraries[FILES[0]].encode(t, add_special_tokens=False).ids) for t in texts]
    assert len(enc.recent) <= 5


@pytest.mark.parametrize("n,symbols", [(0, 1), (1, 1), (5, 1), (513, 2), (4000, 300), (3000, 70000)])
def test_wavelet_matrix_answers(n, symbols):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % symbols).astype("<u4") if symbols < 70000 else np.arange(n, dtype="<u4") * 20
    _, lengths, m = wavelet.open_shard(wavelet.pack_shard([7, None], [n, 0], ids))
    assert m.decode().tolist() == ids.tolist() and lengths.tolist() == [n, 0]
    for i in range(0, n, max(1, n // 25)):
        assert m.access(i) == ids[i]
    for token in [*np.unique(ids)[:15].tolist(), 123456]:
        places = np.flatnonzero(ids == token).tolist()
        assert m.count(token) == len(places) and m.occurrences(token) == places
        assert m.count(token, n // 3, 2 * n // 3) == sum(n // 3 <= p < 2 * n // 3 for p in places)


def test_shards_round_trip(spark, odd, prose_table, libraries):
    lib = libraries[FILES[0]]
    for table in (odd, prose_table, odd.limit(0)):
        out = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        wavelet.write_shards(table, out, public_tokenizers.path(FILES[0]), 2, shard_tokens=500)
        docs = sorted(table.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
        got = sorted(wavelet.read_documents(spark, out).collect(), key=lambda r: r.start)
        start, want = 0, []
        for d, t in docs:
            ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
            want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        assert [tuple(r) for r in got] == want
        assert sum(r.n for r in wavelet.token_counts_by_shard(spark, out, 2).collect()) == len(docs)
        ends = sorted((r.doc_id, r.place) for r in wavelet.token_places(spark, out, 2).where("doc_id IS NOT NULL").collect())
        assert ends == sorted((d, n - 1) for d, _, n, _ in want if d is not None)


def test_cache_counts_and_is_used(spark, odd, prose_table, libraries):
    path = public_tokenizers.path(FILES[1])
    cache = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    for table in (odd.select("doc_id", "text"), prose_table.select("doc_id", "text"), odd.select("doc_id", "text").limit(0)):
        got = token_cache.token_counts(table, path, cache)
        rows = [(r.row.doc_id, r.row.text, r.n_bytes, r.n_tokens) for r in got.collect()]
        assert len(rows) == table.count()
        for _, t, n_bytes, n_tokens in rows:
            t = t or ""
            assert (n_bytes, n_tokens) == (len(t.encode()), len(libraries[FILES[1]].encode(t, add_special_tokens=False).ids))
    version = token_cache.tokenizer_version(path)
    known = token_cache.read_cache(spark, cache, version).count()
    texts = odd.select("text").unionByName(prose_table.select("text")).na.fill("").distinct().count()
    assert known == texts
    before = spark.read.parquet(cache).count()
    token_cache.add_misses(prose_table, path, cache)
    assert spark.read.parquet(cache).count() == before
    assert token_cache.read_cache(spark, cache, "another version").count() == 0


def test_counts_with_a_hot_text(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'the same text' ELSE concat('text ', id) END AS text")
    cache = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    got = token_cache.token_counts(docs, public_tokenizers.path(FILES[1]), cache, keep=["doc_id"])
    assert got.count() == 3000 and got.select("row.doc_id").distinct().count() == 3000


def test_matrix_of_ids_counted_in_a_table_is_that_of_sorted_ids(monkeypatch):
    import numpy as np
    from floodgrid.llm import wavelet

    ids = np.random.default_rng(3).zipf(1.4, 5_000).clip(0, 40_000).astype("<u4")
    fast = [wavelet.pack_shard([1], [len(x)], x) for x in (ids, ids[:1], ids[:0])]
    # Ids that are too large for the table keep the way by sorting.
    wide = wavelet.WaveletMatrix.build(ids + np.uint32(1 << 30))
    assert (wide.decode() == ids + np.uint32(1 << 30)).all()
    monkeypatch.setattr(wavelet, "_DIRECT", 0)
    assert fast == [wavelet.pack_shard([1], [len(x)], x) for x in (ids, ids[:1], ids[:0])]
    assert (wavelet.open_shard(fast[0])[2].decode() == ids).all()
