"""One small case for each mended finding of the third round."""

from __future__ import annotations

from lexiscope.llm import bpe
from lexiscope.llm.common import per_document


def test_a_chunk_is_kept_when_it_comes_again_and_until_the_task_ends():
    c = bpe.Coder(bpe.coder().ranks, r"\w+| ?[^\s\w]+|\s+")
    texts = ["abc qwxz", "abc", None, "abc  déjà", "abc"]
    first = [c.encode(t) for t in texts]
    assert set(c.cache) == {"abc", " "}
    assert [c.decode(x).decode() for x in first] == ["abc qwxz", "abc", "", "abc  déjà", "abc"]
    c.forget()
    assert not any((c.cache, c.older, c.fits, c.halves, c.shorter)) and not any(c.seen)
    assert [c.encode(t) for t in texts] == first


def test_a_task_that_has_ended_leaves_no_large_memo(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 2)
    docs = spark.createDataFrame([(i, "one two one two") for i in range(6)], "doc_id long, text string")
    ended = []
    monkeypatch.setattr(bpe, "per_document", lambda *a: ended.append(a[-1]) or per_document(*a))
    for out in (bpe.digests(docs), bpe.encode(docs)):
        assert out.count() == 6
        bpe.coder(None, None).encode("one one two two one one two two" * 2)
        assert len(bpe.coder(None, None).cache) >= 2
        ended[-1]()
        assert not bpe.coder(None, None).cache
    flag = tmp_path / "ended"
    per_document(docs, ["doc_id"], lambda i: {"n": i}, "n long", flag.touch).collect()
    assert flag.exists()
