"""Near-copy classes against all pairs, compared by plain sets and a plain table of edits."""

import re
from random import Random

import numpy as np

from gridweave.llm import near_text


def plain_similar(a: list[str], b: list[str]) -> bool:
    grams = [{tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))} for x in (a, b)]
    both = len(grams[0] & grams[1])
    if both < 0.8 * len(grams[0] | grams[1]) - 1e-9:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1] <= int(0.2 * max(len(a), len(b)) + 1e-9)


def classes_by_pairs(texts: list[str]) -> list[int]:
    words = [re.findall(r"\w+", t.lower()) for t in texts]
    head = list(range(len(texts)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            same = words[i] == words[j] if not (words[i] and words[j]) else plain_similar(words[i], words[j])
            if same and (words[i] or texts[i] == texts[j]) and find(i) != find(j):
                a, b = sorted((find(i), find(j)))
                head[b] = a
    return [find(i) for i in range(len(texts))]


def varied_texts(seed: int) -> list[str]:
    """Families of texts whose members lie from equal to half rewritten, some with a passage that all share."""
    r = Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    shared = r.choices(vocabulary, k=60)
    texts = ["", "...", "one two", "one two", "One, two!"]
    for size in (20, 45, 48, 120, 200):
        base = r.choices(vocabulary, k=size)
        for n in range(9):
            words = list(base)
            for _ in range(n * size // 150 + n // 2):
                at = r.randrange(len(words))
                words[at : at + r.randint(0, 1)] = r.choices(vocabulary, k=r.randint(0, 2))
            texts.append(" ".join(words))
        texts.append(" ".join(base[::-1] + shared))
    r.shuffle(texts)
    return texts


def test_classes_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_text, "BLOCK", 4)
    texts = varied_texts(2)
    expected = classes_by_pairs(texts)
    assert len(texts) > len(set(expected)) > 12
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in near_text.near_classes(docs).collect()}
    assert [got[i].class_id for i in range(len(texts))] == expected
    assert {i for i in got if got[i].kept} == set(expected)


def test_blocks_find_links_between_classes_of_a_group(spark, monkeypatch):
    monkeypatch.setattr(near_text, "BLOCK", 3)
    r = np.random.default_rng(5)
    bases = [r.integers(1, 1 << 40, 120).astype(np.uint64) for _ in range(4)]
    words = []
    for base in bases:
        for k in range(5):
            w = base.copy()
            w[10 + k * 20] = k + 1
            words.append(w)
    nodes = [bytes([i]) for i in range(len(words))]
    table = spark.createDataFrame([(x, bytearray(w.tobytes())) for x, w in zip(nodes, words)], "node binary, words binary")
    groups = spark.createDataFrame([(nodes[0], x) for x in nodes], "lead binary, node binary")
    # The first base is one class already; texts of the other bases stand alone.
    roots = spark.createDataFrame([(x, nodes[0]) for x in nodes[:5]], "node binary, component binary")
    found = {(bytes(x.lead), bytes(x.node)) for x in near_text._compare_blocks(groups, roots, table, 0.8, 5).collect()}
    pairs = {(nodes[i], nodes[j]) for i in range(20) for j in range(20) if i // 5 == j // 5 > 0 and i != j and near_text.similar(words[i], words[j])}
    assert len(pairs) == 60 and {frozenset(p) for p in found} == {frozenset(p) for p in pairs}


def test_sketch_of_a_long_text_is_the_same_in_parts(monkeypatch):
    words = np.random.default_rng(3).integers(0, 1 << 60, 3000, dtype=np.uint64)
    whole = near_text.sketches(words)
    for most in (1, 5_000, 40_000):
        monkeypatch.setattr(near_text, "HASHES", most)
        assert (near_text.sketches(words) == whole).all()
