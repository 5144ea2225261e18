"""Merkle manifest, similarity digests and centroid clustering against plain versions."""

import hashlib
import math
import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from gridweave.llm import clusters, digests, merkle  # noqa: E402


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(nodes):
    """Root, and the siblings of each leaf from the bottom up."""
    paths, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, own = [], []
        for k in range(0, len(nodes), 3):
            run = nodes[k : k + 3]
            for j in range(len(run)):
                for i in owners[k + j]:
                    paths[i] += run[:j] + run[j + 1 :]
            up.append(sha("".join(run)))
            own.append(sum(owners[k : k + 3], []))
        nodes, owners = up, own
    return nodes[0], paths


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


@pytest.mark.parametrize("depth", [1, 2, 6])
def test_manifest_equals_a_plain_tree(spark, monkeypatch, depth):
    """Sources of many sizes, a null one, one that looks like a key, null and repeated ids, repeated rows, clashing columns."""
    monkeypatch.setattr(merkle, "DEPTH", depth)
    rng = random.Random(1)
    rows = [(i * 7 % 1000, rng.choice(["a", "a", "a", "é", "zz", None, "=x"]), "en", i, f"t\n{i}é" if i % 5 else None) for i in range(120)]
    rows += [(5000, "lone", None, None, ""), (None, "a", "en", 1, "x"), (3, "a", "en", 1, "y"), (3, "a", "en", 1, "y"), (9, "a", None, None, "long " * 50_000)]
    df = spark.createDataFrame([(*r, "c", "d") for r in rows], "doc_id long, source string, lang string, n_chars int, text string, tree string, digest string")
    manifest = merkle.build(df, merkle.digest_of("doc_id", "source", "lang", "n_chars", "text"))
    path = F.col("path")
    got = merkle.proofs(manifest).select("doc_id", "leaf", "subroot", "root", merkle.path_digest(path), merkle.fold_path(F.col("leaf"), path))
    by_source = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r))):
        by_source.setdefault(r[1], []).append(r)
    keys = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([plain_leaf(r) for r in by_source[s]]) for s in keys}
    root, tops = plain_tree([trees[s][0] for s in keys])
    want = Counter((r[0], plain_leaf(r), trees[s][0], root, sha("".join(p + top)), root) for s, top in zip(keys, tops) for r, p in zip(by_source[s], trees[s][1]))
    assert Counter(tuple(r) for r in got.collect()) == want


def test_manifest_tells_changed_rows(spark):
    df = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    manifest = merkle.build(df, merkle.digest_of("doc_id"), carry={"bad": F.when(F.col("doc_id") == 7, F.lit("0" * 64)), "doc_id": F.col("doc_id")})
    folded = merkle.fold_path(F.coalesce("bad", "leaf"), F.col("path"))
    wrong = merkle.proofs(manifest).where(folded != F.col("root")).select("doc_id").collect()
    assert [r.doc_id for r in wrong] == [7]


def test_manifest_of_nothing_and_of_many_sources(spark):
    none = spark.createDataFrame([], "doc_id long, source string")
    empty = merkle.build(none, merkle.digest_of("doc_id"))
    assert empty.root is None and merkle.proofs(empty).count() == 0
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("www.host-name-"), F.col("id").cast("string")).alias("source"))
    manifest = merkle.build(df, merkle.digest_of("doc_id"))
    names = sorted((f"www.host-name-{i}", i) for i in range(1000))
    assert manifest.root == plain_tree([plain_leaf((i,)) for _, i in names])[0]
    assert merkle.proofs(manifest).count() == 1000


def plain_grade(window):
    part = lambda c: round(c * math.log2(max(c, 1)) * (1 << 32))
    return digests.GRADES - sum(part(c) for c in Counter(window).values()) * digests.GRADES // part(digests.WINDOW)


def plain_features(data, ranks):
    """Places that win WINS of the runs, each tried for itself."""
    keys = [(int(ranks[plain_grade(data[i : i + digests.WINDOW])]), i) for i in range(len(data) - digests.WINDOW + 1)]
    wins = Counter(min(keys[max(0, r) : r + digests.RUN])[1] for r in range(1 - digests.RUN, len(keys)))
    seen, out = set(), []
    for i in sorted(p for p, n in wins.items() if n >= digests.WINS):
        if (w := data[i : i + digests.WINDOW]) not in seen:
            seen.add(w)
            out.append(i)
    return out


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghiklmnoprstuéß") for _ in range(rng.randint(1, 9))) for _ in range(n))


TEXTS = ["", "short", "x" * 300, prose(90, 1), prose(90, 1), prose(30, 2) * 4, "a" * 63, "b" * 64, prose(40, 3), "日本語" * 60, prose(700, 4)]


@pytest.mark.parametrize("piece", [1 << 20, 200])
def test_features_equal_a_plain_search(monkeypatch, piece):
    """Whether texts are graded together, alone or in small pieces."""
    monkeypatch.setattr(digests, "PIECE", piece)
    texts = pa.array(TEXTS, pa.large_string())
    data, starts = digests._joined(texts)
    counts = Counter(plain_grade(t.encode()[i : i + 64]) for t in TEXTS for i in range(len(t.encode()) - 63))
    assert dict(enumerate(digests.grade_counts(data, starts).tolist())) == {g: counts.get(g, 0) for g in range(digests.GRADES + 1)}
    ranks = digests.rarity(digests.grade_counts(data, starts))
    assert all(ranks[a] < ranks[b] for a, b in zip(range(1000), range(1, 1001)) if counts[a] <= counts[b])
    owner, hashes = digests._features(data, starts, ranks)
    for k, t in enumerate(TEXTS):
        raw = t.encode()
        if len(raw) < digests.WINDOW:
            assert (owner == k).sum() == (len(raw) > 0)
        else:
            places = plain_features(raw, ranks)
            assert places and hashes[owner == k].tolist() == digests._hashes(np.frombuffer(raw, np.uint8), np.array(places)).tolist()


def plain_likeness(a, b):
    """By sets of bits, for digests given as lists of hashes."""
    chain = lambda hs: [(len(hs[i : i + 160]), {h >> 11 * k & 2047 for h in hs[i : i + 160] for k in range(5)}) for i in range(0, len(hs), 160)]
    x, y = sorted([chain(a), chain(b)], key=lambda c: (len(c), sum(n for n, _ in c)))
    if not x:
        return float(not y)
    total = 0.0
    for n, s in x:
        best = 0.0
        for _, t in y:
            chance, most = len(s) * len(t) / 2048, min(len(s), len(t))
            low = chance + 0.3 * (most - chance)
            best = max(best, min(1.0, (len(s & t) - low) / (most - low)))
        total += n * best
    return total / sum(n for n, _ in x)


def test_likeness_equals_sets_of_bits():
    rng = random.Random(5)
    make = lambda n: [rng.getrandbits(64) for _ in range(n)]
    base = make(500)
    lists = [[], base[:3], base[:160], base, base[100:400] + make(90), make(40), base[::2]]
    for a in lists:
        da = digests.Digest.of(np.array(a, np.uint64))
        assert digests.Digest.parse(da.text()).text() == da.text() and da.likeness(digests.Digest.parse(da.text())) == 1.0
        for b in lists:
            got = da.likeness(digests.Digest.of(np.array(b, np.uint64)))
            assert got == pytest.approx(plain_likeness(a, b)) and got == digests.Digest.of(np.array(b, np.uint64)).likeness(da)


def test_edits(spark, monkeypatch):
    """Next documents over shard ends, nulls, ties, repeated rows, an empty table, clashing columns and long texts."""
    rows = [(i * 3, t) for i, t in enumerate(TEXTS)] + [(None, prose(50, 9)), (7, None), (9, prose(20, 8)), (9, prose(20, 8)), (40, prose(30_000, 6)), (-5, "é" * 200)]
    df = spark.createDataFrame([(*r, 0, True) for r in rows], "doc_id long, text string, shard int, guest boolean").repartition(3)
    ranks = digests.fit_ranks(df)
    ordered = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    edited = [digests.half_edited(t, n) for (_, t), (_, n) in zip(ordered, ordered[1:] + ordered[:1])]
    print_of = lambda ts: digests.digests(pa.array(ts, pa.large_string()), ranks)
    own, other = print_of([t for _, t in ordered]), print_of(edited)
    want = Counter()
    for i, (k, t) in enumerate(ordered):
        after = own[(i + 1) % len(own)]
        want[k, len(t), sha(edited[i]), own[i].text(), other[i].text(), own[i].likeness(other[i]), own[i].likeness(after)] += 1
    for size in (16 << 20, 2_000):
        monkeypatch.setattr(digests, "SHARD_BYTES", size)
        got = digests.edits(df, ranks)
        assert Counter(tuple(r) for r in got.collect()) == want
    prints = {(r.doc_id, r.fingerprint) for r in digests.fingerprints(df, ranks).collect()}
    assert prints == {(k, d.text()) for (k, _), d in zip(ordered, own)}
    assert digests.edits(df.limit(0), digests.fit_ranks(df.limit(0))).count() == 0
    lone = digests.edits(df.where("doc_id = 9").limit(1), ranks).first()
    assert lone.doc_id == 9 and lone.near_next == 1.0


def test_half_edited_texts_are_nearer_than_strangers(spark):
    texts = [prose(400, 100 + i) for i in range(40)]
    found = digests.edits(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), digests.fit_ranks(spark.createDataFrame([(t,) for t in texts], "text string")))
    rows = found.collect()
    assert min(r.near_edited for r in rows) > 0.15 and max(r.near_next for r in rows) == 0.0


def plain_clusters(rows, k, rounds):
    """Whole numbers of Python only."""
    kept = [(i, [math.floor(x * 1024) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, sha(f"3:{r[0]}"), r[1]))[:k]
    means = [v for _, v in start]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for r in range(rounds + 1):
        near = [min((square(v, m), c) for c, m in enumerate(means)) for _, v in kept]
        if r < rounds:
            groups = {}
            for (_, v), (_, c) in zip(kept, near):
                groups.setdefault(c, []).append(v)
            means = [[sum(x) // len(groups[c]) for x in zip(*groups[c])] if c in groups else m for c, m in enumerate(means)]
    return Counter((i, c, d) for (i, _), (d, c) in zip(kept, near)), means


@pytest.mark.parametrize("bits", [2, 8])
def test_clusters_equal_whole_numbers(spark, monkeypatch, bits):
    monkeypatch.setattr(clusters, "BITS", bits)
    rng = np.random.default_rng(2)
    middles = rng.standard_normal((5, 64))
    rows = [(i, (middles[i % 5] + 0.5 * rng.standard_normal(64)).tolist()) for i in range(150)]
    rows += [(200 + i, middles[0].tolist()) for i in range(40)] + [(3, rows[3][1]), (3, rows[3][1]), (None, rows[4][1]), (None, None)]
    rows += [(300, None), (301, [1.0] * 63), (302, [1.0] * 65), (303, [None] + [1.0] * 63), (304, [float("nan")] * 64), (305, [float("inf")] * 64), (306, []), (307, [0.0] * 64)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, vector string, key int")
    got, means = clusters.cluster(df, centroids=4, rounds=5)
    want, plain = plain_clusters(rows, 4, 5)
    assert Counter(tuple(r) for r in got.collect()) == want and means.tolist() == plain


def test_clusters_of_few_and_none(spark):
    one = spark.createDataFrame([(1, [0.5] * 64), (2, [0.5] * 64)], "vec_id long, embedding array<float>")
    got, means = clusters.cluster(one, rounds=3)
    assert len(means) == 2 and sorted(tuple(r) for r in got.collect()) == [(1, 0, 0), (2, 0, 0)]
    rows, means = clusters.cluster(one.limit(0))
    assert rows.count() == 0 and len(means) == 0
    unmoved, _ = clusters.cluster(one, rounds=0)
    assert unmoved.count() == 2
    with pytest.raises(Exception, match="squared distance"):
        clusters.cluster(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>"))


def test_few_vectors_are_fetched(spark):
    """Cells decide for vectors that lie clearly nearest to one centroid."""
    rng = np.random.default_rng(4)
    middles = rng.standard_normal((4, 64)) * 3
    rows = [(i, (middles[i % 4] + 0.2 * rng.standard_normal(64)).tolist()) for i in range(200)]
    whole = spark.createDataFrame([(i, np.floor(np.array(v) * 1024).astype("<i4").tobytes()) for i, v in rows], "vec_id long, vector binary")
    from gridweave.session import work_path

    file = clusters.VectorFile(whole, work_path(spark, "vectors"), 64)
    means = np.floor(middles * 1024).astype(np.int64)
    assert file.fetched(means, means + 1).count() == 0
    assert file.fetched(means, means[[1, 0, 2, 3]]).count() == 100
    file.close()
