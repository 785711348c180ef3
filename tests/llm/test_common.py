"""What the operators share."""

import zlib

import numpy as np

from colloquy.llm.common import Remembering, fold, packed, squeezed, unpacked, unsqueezed


def test_folds(spark):
    ids = spark.createDataFrame([(k,) for k in [*range(50), None]], "doc_id long")
    for r in ids.withColumn("f", fold("doc_id", 5)).collect():
        assert r.f == zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5


def test_remembering():
    class Squares(Remembering):
        def work_out(self, key):
            return key + key

    s = Squares(3_000)
    for k in map(str, range(100)):
        assert s[k] == k + k
        s.age()
    assert len(s) + len(s.old) <= 45
    assert s["long" * 100] == "long" * 200 and "long" * 100 not in s


def test_packing():
    for x in ([], [0], [5, 2**40, 3], [-7, 2**31 - 1]):
        assert unsqueezed(squeezed(np.array(x, np.int64))).tolist() == x
    keys = np.array([0, 1, 2**56 - 1], np.uint64)
    assert unpacked(packed(keys, 7), 7).tolist() == keys.tolist()


def test_registered_names():
    from colloquy.llm import registry

    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
    assert set(registry.ORACLES) <= set(registry.QUERIES)
