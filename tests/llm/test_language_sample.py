"""The bounded sample of the language dictionaries."""

from gridweave.llm import language


def test_every_sampled_document_teaches(spark):
    """64 texts of 10 KB: each is in the dictionary with an equal part, and not each from its start."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(1200)), "en") for i in range(64)], "doc_id long, text string, lang string")
    d = language.fit(docs).dictionaries["en"]
    parts = d.split(b"\n")
    assert len(d) <= language.DICT_BYTES and len(parts) == 64 and {len(p) for p in parts} == {(language.DICT_BYTES - 64) // 64}
    assert all(f"w{i}x".encode() in p for i, p in enumerate(parts))
    assert sum(p.startswith(f"w{i}x0 ".encode()) for i, p in enumerate(parts)) < 32


def test_short_documents_leave_their_room():
    assert language.even_parts([b"a" * 10, b"b" * 100, b"c" * 50], 73) == [b"a" * 10, b"b" * 30, b"c" * 30]
    assert language.even_parts([b"a", b"bb"], 99) == [b"a", b"bb"] and language.even_parts([], 9) == []
