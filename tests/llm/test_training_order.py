import hashlib

import numpy as np
import pytest

from textloom.llm import training_order as to


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000, 70_001])
def test_permutation(n):
    p, all_ = to.Permutation(n, "k"), np.arange(n)
    s = p.slot(all_)
    assert sorted(s.tolist()) == all_.tolist() and (p.number(s) == all_).all()
    if n > 60:
        assert (s != to.Permutation(n, "other").slot(all_)).any() and abs(np.corrcoef(s, all_)[0, 1]) < 0.3


def test_order_and_shards(spark, tmp_path):
    rows = [(3, "three " * 100), (None, None), (1, ""), (7, "seven"), (7, "seven"), (2, "a b c " * 400), (5, "日本 <|endoftext|>")] + [(100 + i, f"text {i} " * (i % 9)) for i in range(60)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, slot int")
    path = str(tmp_path / "shards")
    got = to.training_order(df, length=16, per_shard=10, path=path).collect()
    n = len(got)
    ids = {r.slot: np.array(r.ids, "<u2") for r in to.read_slots(spark, path, 0, n, 16, 10).collect()}
    assert sorted(r.slot for r in got) == list(range(n)) == sorted(ids)
    assert all((r.shard, r.byte_offset) == (r.slot // 10, r.slot % 10 * 33) for r in got)
    assert all(r.ids_sha256 == hashlib.sha256(ids[r.slot].tobytes()).hexdigest() for r in got)
    # whole texts come back, and the order is the permutation of the documents' order
    number = to.Permutation(n, "textloom").number(np.array([r.slot for r in got]))
    stream = [got[k] for k in np.argsort(number)]
    texts, own = [], []
    for r in stream:
        own += ids[r.slot][: r.n_tokens].tolist()
        assert (ids[r.slot][r.n_tokens :] == to.END).all()
        if r.n_tokens < 16:
            texts.append((r.doc_id, to.library().decode(own)))
            own = []
    assert sorted(texts, key=str) == sorted([(i, t or "") for i, t in rows], key=str)
    assert [i for i, _ in texts] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    back = {r.slot: r.ids for r in to.read_slots(spark, path, 7, min(n, 33), 16, 10).collect()}
    assert back == {s: ids[s].tolist() for s in range(7, min(n, 33))}
    again = {(r.doc_id, r.seq, r.ids_sha256): r.slot for r in to.training_order(df.repartition(3), length=16, per_shard=10).collect() if r.doc_id != 7}
    assert again == {(r.doc_id, r.seq, r.ids_sha256): r.slot for r in got if r.doc_id != 7}
    assert to.training_order(df.limit(0)).count() == 0
    (tmp_path / "shards" / "shard=0" / "part-second").write_bytes(b"x" * 33)
    with pytest.raises(ValueError):
        to.read_slots(spark, path, 0, 5, 16, 10)
