import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from ledgerloom.llm import wavelet
from ledgerloom.llm.common import scratch
from tests.llm.fixtures import folder, none, odd  # noqa: F401


def test_matrix_against_the_ids():
    rng = np.random.default_rng(1)
    for size, top in ((0, 10), (1, 1), (513, 3), (5000, 50256)):
        ids = np.minimum(rng.zipf(1.3, size), top).astype("<u2")
        matrix = wavelet.WaveletMatrix.of(ids, 16)
        assert (matrix.ids() == ids).all()
        assert all(matrix.access(int(k)) == ids[k] for k in rng.integers(0, size, min(size, 60)))
        for token in {1, 2, 77, top, 1 << 20, *ids[:5].tolist()}:
            where = np.flatnonzero(ids == token)
            assert matrix.count(token) == len(where)
            assert matrix.count(token, size // 3, size // 2) == ((where >= size // 3) & (where < size // 2)).sum()
            for k in {0, len(where) // 2, len(where) - 1} - {-1}:
                if k < len(where):
                    assert matrix.find(token, k) == where[k]
            assert matrix.find(token, len(where)) == -1


def test_file_round_trip():
    ids = np.array([5, 2, 2, 9, 9, 2], "<u2")
    shard = wavelet.Shard(wavelet.pack([7, None, 9], [2, 1, 3], ids, 16))
    assert shard.doc_ids == [7, None, 9] and shard.starts.tolist() == [0, 2, 3, 6]
    assert [shard.document(k).tolist() for k in range(3)] == [[5, 2], [2], [9, 9, 2]]


def brute(docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, at = [], 0
    for doc, text in docs:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def in_order(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))


def test_shards_of_odd_rows(spark, odd, none):
    for shard in (50, 1 << 20):
        folder = scratch(spark, "files")
        wavelet.write(wavelet.encode_shards(odd, "byte_bpe_50k.json", 2, shard=shard), folder)
        assert sorted(map(str, map(tuple, wavelet.decode(spark, folder).collect()))) == sorted(map(str, brute(in_order(odd))))
    folder = scratch(spark, "files")
    wavelet.write(wavelet.encode_shards(none, "byte_bpe_50k.json", 2), folder)
    assert wavelet.decode(spark, folder).collect() == []


def test_query(spark, folder):
    rows = [(k * 3 % 101, "word " * (k % 17) + "é\n\n") for k in range(100)]
    path = folder(documents=spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    assert sorted(map(tuple, wavelet.op8_wavelet_shards(spark, path).collect())) == brute(sorted(rows))
