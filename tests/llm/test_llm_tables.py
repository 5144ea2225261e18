"""Operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import hashlib
import math
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from gridweave.llm import archive, byte_bpe, decontaminate, language, lattice, near_text, near_vectors, quality, queries, token_files  # noqa: E402
from gridweave.session import work_path  # noqa: E402

WORDS = "sun moon river stone cloud tree bird fish wind fire rain snow leaf root seed".split()


def prose(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] + str(j) for i, j in zip(rng.integers(0, len(WORDS), n), rng.integers(0, 40, n)))


TEXTS = [(1, prose(60, 1)), (2, prose(60, 1)), (3, prose(60, 1).replace("sun", "SUN") + " end"), (4, prose(60, 2)), (5, ""), (6, None), (6, None), (None, "lone text"), (8, "!?"), (9, prose(20_000, 3)), (9, prose(20_000, 3)), (10, "short one")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", None, 0, "clash") for i, t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long, node string")


def test_near_classes(docs):
    got = Counter((r.doc_id, r.class_id, r.kept) for r in near_text.near_classes(docs).collect())
    assert got == Counter([(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (5, 5, True), (6, 5, False), (6, 5, False), (None, None, True), (8, 8, True), (9, 9, True), (9, 9, True), (10, 10, True)])
    kept = near_text.keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 4, 5, None, 8, 9, 10]))
    assert near_text.near_classes(docs.limit(0)).count() == 0 and near_text.keep_one(docs.limit(0)).count() == 0


def test_byte_bpe_equals_the_library(docs, spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks, pattern = byte_bpe.load_ranks(queries.tokenizer_file("byte_bpe_50k.tiktoken")), queries.tokenizer_pattern()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    odd = spark.createDataFrame([(20, "日本 x\x1c\x85y\n\n z  "), (21, "é" * 70 + "ab" * 90)], "doc_id long, text string")
    done = byte_bpe.encode(docs.select("doc_id", "text").unionByName(odd), ranks, pattern)
    got = Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4"))) for r in done.collect())
    texts = TEXTS + [(r.doc_id, r.text) for r in odd.collect()]
    assert got == Counter((i, tuple(enc.encode_ordinary(t or ""))) for i, t in texts)
    back = Counter((r.doc_id, bytes(r.decoded)) for r in byte_bpe.decode(done, ranks).collect())
    assert back == Counter((i, (t or "").encode()) for i, t in texts)
    assert byte_bpe.encode(docs.limit(0), ranks, pattern).count() == 0


def test_byte_bpe_words_run_through_small_blocks(spark, monkeypatch):
    """A word that an earlier block of the task brought is found again; empty and null texts make no words."""
    tiktoken = pytest.importorskip("tiktoken")
    monkeypatch.setattr(byte_bpe, "BLOCK_WORDS", 3)
    ranks, pattern = byte_bpe.load_ranks(queries.tokenizer_file("byte_bpe_50k.tiktoken")), queries.tokenizer_pattern()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = [(0, ""), (1, None), (2, "one two three four"), (3, "two"), (4, "four five one"), (5, ""), (6, "six two six five"), (7, "one")]
    done = byte_bpe.encode(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), ranks, pattern, decoded=True)
    got = {r.doc_id: (np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in done.collect()}
    assert got == {i: (enc.encode_ordinary(t or ""), (t or "").encode()) for i, t in texts}


def test_token_files_of_marks_and_latin_letters(spark):
    tokenizers = pytest.importorskip("tokenizers")
    file = queries.tokenizer_file("word_bpe_49k.json")
    tok, path = tokenizers.Tokenizer.from_file(file), work_path(spark, "latin")
    tok.encode_special_tokens = True
    texts = ["été ÀÉ'S ÿ µm ªº ß*** word'*** don't'", "Ünï<|endoftext|> x<|endoftext|> ×÷a a×b ÞÐ_", "e\u0301 é*** a\u2260 a=\u0338 \u0130stanbul ΣΑΣ ΑΣ.", "...", "Straße!? ÄÖÜ,"]
    token_files.write_files(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, queries._word_tokenizer(file), 2)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in token_files.read_files(spark, path).collect()}
    assert got == {i: tok.encode(t, add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}


def test_token_files_equal_the_library(docs, spark):
    tokenizers = pytest.importorskip("tokenizers")
    file = queries.tokenizer_file("word_bpe_49k.json")
    tok, path = tokenizers.Tokenizer.from_file(file), work_path(spark, "tokens")
    token_files.write_files(docs, path, queries._word_tokenizer(file), 2)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_files(spark, path).collect()))
    want, at = [], 0
    for i, t in sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((at, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    token_files.write_files(docs.limit(0), path + "-none", queries._word_tokenizer(file), 2)
    assert token_files.read_files(spark, path + "-none").count() == 0


def test_token_file_pages_end_by_size(spark, monkeypatch):
    """Few rows of token files are much: groups end by bytes, not after 100 rows."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(token_files, "FILE_IDS", 1000)
    monkeypatch.setattr(token_files, "PAGE_BYTES", 4 << 10, raising=False)
    monkeypatch.setattr(token_files, "GROUP_BYTES", 16 << 10, raising=False)
    texts, path = [(i, " ".join(f"w{i * k}" for k in range(200))) for i in range(100)], work_path(spark, "pages")
    load = queries._word_tokenizer(queries.tokenizer_file("word_bpe_49k.json"))
    token_files.write_files(spark.createDataFrame(texts, "doc_id long, text string"), path, load, 2)
    groups = [m.row_group(k) for f in Path(path.removeprefix("file:")).glob("*.parquet") for m in [pq.ParquetFile(f).metadata] for k in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) > 20 and max(g.total_byte_size for g in groups) < 32 << 10
    tok = load()
    want = {i: tok.encode(t, add_special_tokens=False).ids + [2] for i, t in texts}
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in token_files.read_files(spark, path).collect()} == want


def test_lattice_base_score(docs):
    from pyspark.sql import functions as F

    got = Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lattice.score(docs, queries.tokenizer_file("piece_bpe_32k.model"), F.col("doc_id") < 5).collect())
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for i, t in TEXTS]
    c = Counter(w for i, ws in words if i is not None and i < 5 for w in ws)
    n, v = sum(c.values()) + 4, len(c) + 1
    p = lambda k: math.log10((k + 0.5) / (n + 0.5 * (v + 1)))
    assert got == Counter((i, len(ws) + 1, sum(c[w] > 0 for w in ws) + 1, n, round(sum(p(c[w]) for w in ws) + p(4), 6)) for i, ws in words)
    assert lattice.score(docs.limit(0), queries.tokenizer_file("piece_bpe_32k.model"), F.lit(True)).count() == 0


def test_archive_with_copies(spark):
    rows = [(1, "u", "<p>a</p>"), (5, "u\r\nx: y", "<p>a</p>"), (3, None, "<p>a</p>"), (4, "v", None), (2, "v", ""), (None, "w", "é"), (7, "w", "z"), (7, "w", "z")]
    pages, path = spark.createDataFrame(rows, "page_id long, url string, html string"), work_path(spark, "warc")
    archive.write_archive(pages, path)
    got = archive.read_archive(spark, path).collect()
    assert spark.read.parquet(path + "/payloads").count() == 4
    holder = {"<p>a</p>": "5", "": "4", "é": None, "z": "7"}
    for r in got:
        body = bytes(r.payload).decode()
        assert r.payload_digest == base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode()
        assert (r.record_type == "response") == (r.record_id == holder[body]) and r.refers_to == (None if r.record_type == "response" else holder[body])
        head, block = bytes(r.record).split(b"\r\n\r\n", 1)
        assert int(re.search(rb"Content-Length: (\d+)", head)[1]) == len(block) and (r.record_type != "response" or block.endswith(bytes(r.payload)))
    assert len(got) == len(rows)
    archive.write_archive(pages.limit(0), path + "-none")
    assert archive.read_archive(spark, path + "-none").count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal(16)
    near = [base, base * 3, base + 0.02 * rng.standard_normal(16), base]
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(near)] + [(10, [float(x) for x in base], 2), (11, [float(x) for x in base], None), (12, None, 1), (13, [0.0] * 16, 1), (14, [float("nan")] * 16, 1), (15, [None] * 16, 1), (16, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors.near_vectors(df).collect()}
    assert [got[i] for i in range(4)] == [(3, 0, True), (3, 0, False), (3, 0, False), (3, 0, False)]
    assert all(got[i] == (0, i, True) for i in range(10, 17))
    assert near_vectors.near_vectors(df.limit(0)).count() == 0


def test_row_filters_keep_columns(docs, spark):
    items = spark.createDataFrame([(1, prose(60, 1)), (2, None)], "item_id long, text string")
    index = decontaminate.build_index(items)
    assert {r.doc_id for r in decontaminate.find_leaks(docs, index).collect()} == {1, 2, 3}
    clean = decontaminate.keep_clean(docs, index)
    assert clean.columns == docs.columns and clean.count() == len(TEXTS) - 3
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (9, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert quality.score(docs, model).count() == len(TEXTS) and quality.keep(docs, model).columns == docs.columns
    known = language.fit(docs)
    rows = language.identify(docs, known).collect()
    assert {r.lang_pred for r in rows if r.doc_id in (5, 6, 8)} == {"und"} and len(rows) == len(TEXTS)
    nothing = language.fit(docs.limit(0))
    assert language.keep(docs, nothing).count() == len(TEXTS)
    with pytest.raises(ValueError):
        decontaminate.build_index(items, max_bytes=10)


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).collect()
    ids = [r.doc_id for r in out]
    assert 0 < len(ids) == len(set(ids)) < docs.count()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in out)


def test_archive_records_are_a_file(spark):
    """Records one after another, each with its closing line ends; control characters of a url don't break a header."""
    rows = [(1, "http://a/\r\nX: \x00y\t", "<p>a</p>"), (2, "http://a/%0D", "<p>a</p>"), (3, None, "é" * 1000)]
    path = work_path(spark, "warc")
    archive.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    read = archive.read_archive(spark, path).orderBy("record_id").collect()
    data, seen = b"".join(bytes(r.closed_record) for r in read), []
    while data:
        head, rest = data.split(b"\r\n\r\n", 1)
        size = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
        seen.append(re.search(rb"\r\nWARC-Record-ID: <urn:page:(\d+)>", head)[1])
        assert head.startswith(b"WARC/1.1\r\n") and rest[size : size + 4] == b"\r\n\r\n"
        data = rest[size + 4 :]
    assert seen == [b"1", b"2", b"3"]
    assert [r.target_uri for r in read] == ["http://a/%0D%0AX: %00y%09", "http://a/%0D", None]


def test_token_files_of_all_scripts(spark):
    """Random texts over many scripts, cases and marks, as the library encodes them whole."""
    tokenizers = pytest.importorskip("tokenizers")
    file = queries.tokenizer_file("word_bpe_49k.json")
    tok, path = tokenizers.Tokenizer.from_file(file), work_path(spark, "scripts")
    tok.encode_special_tokens = True
    rng = np.random.default_rng(8)
    ranges = [(33, 127), (33, 127), (0xA1, 0x180), (0x180, 0x250), (0x2B0, 0x370), (0x370, 0x400), (0x400, 0x480), (0x590, 0x5F0), (0x600, 0x6FF), (0x900, 0x97F), (0xE00, 0xE7F), (0x1E00, 0x1F00), (0x1F00, 0x2000), (0x2000, 0x2070), (0x3040, 0x3100), (0x4E00, 0x4F00), (0xAC00, 0xAD00), (0xFB00, 0xFB50), (0x1F300, 0x1F400)]
    odd = list(".,!?'\"-_*= \t\n\x0b\x1c\x85\xa0̸́̇İıſẞﬁÅ")

    def text():
        parts = []
        for _ in range(rng.integers(1, 12)):
            low, high = ranges[rng.integers(len(ranges))]
            parts.append("".join(map(chr, rng.integers(low, high, rng.integers(1, 8)))))
            parts.append("".join(odd[i] for i in rng.integers(0, len(odd), rng.integers(0, 3))))
        return "".join(parts)

    texts = ["TARİHİ, 1923.", "İ.", "İ, x", "Straße.", "ΣΑΣ. ΣΑΣ", "ŒUVRE, ŒUVRE"] + [text() for _ in range(10_000)]
    token_files.write_files(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, queries._word_tokenizer(file), 2)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in token_files.read_files(spark, path).collect()}
    wrong = [i for i, t in enumerate(texts) if got[i] != tok.encode(t, add_special_tokens=False).ids + [2]]
    assert not wrong, [(i, texts[i]) for i in wrong[:5]]
