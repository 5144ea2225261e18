import itertools
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridweave.functions.similarity import common_subsequences, indel_ratio, weighted_ratios
from gridweave.operators import linkage as L
from gridweave.session import cut_lineage


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b, 1):
            row[j] = old[j - 1] + 1 if x == y else max(old[j], row[j - 1])
    return row[-1]


def ratio(a, b):
    n = len(a) + len(b)
    return 100.0 if n == 0 else (1.0 - (n - 2 * lcs(a, b)) / n) * 100.0


def brute(records, cols, weights, threshold, null_is_match=True):
    """Pairs, groups in report order, and averages, as the definition says."""
    clean = [[("nan" if null_is_match else None) if r[c] is None else r[c].lower().strip() for c in cols] for r in records]
    block = ["".join((x if x is not None else "nan")[:2] for x in r) for r in clean]
    edges = {}
    for i, j in itertools.combinations(range(len(records)), 2):
        if block[i] != block[j]:
            continue
        s = sum((0.0 if a is None or b is None else ratio(a, b)) * w for a, b, w in zip(clean[i], clean[j], weights)) / 100
        if s > threshold:
            edges[i, j] = s
    label = list(range(len(records)))
    for _ in records:
        for i, j in edges:
            label[i] = label[j] = min(label[i], label[j])
    groups = {}
    for i, j in edges:
        groups.setdefault(label[i], set()).update((i, j))
    first = {}
    for i, b in enumerate(block):
        first.setdefault(b, i)
    order = sorted(groups, key=lambda g: (first[block[g]], g))
    out = []
    for g in order:
        scores = [s for (i, _), s in edges.items() if label[i] == g]
        out.append((sorted(groups[g]), round(sum(scores) / len(scores), 9)))
    return edges, out


def contacts(seed, n, letters="abc"):
    rnd = random.Random(seed)
    word = lambda k: "".join(rnd.choice(letters) for _ in range(rnd.randint(0, k)))
    out = []
    for _ in range(n):
        if out and rnd.random() < 0.3:
            out.append(dict(rnd.choice(out)))
        else:
            out.append({c: (None if rnd.random() < 0.1 else word(7) + rnd.choice(["", " ", "é"])) for c in L.CONTACT_WEIGHTS})
    return out


@pytest.mark.parametrize("seed, n, letters, threshold, null_is_match", [(1, 80, "ab", 0.7, True), (2, 120, "abc", 0.6, True), (3, 80, "ab", 0.7, False), (4, 60, "a", 0.9, True)])
def test_against_brute_force(spark, seed, n, letters, threshold, null_is_match):
    records = contacts(seed, n, letters)
    cols, weights = list(L.CONTACT_WEIGHTS), list(L.CONTACT_WEIGHTS.values())
    schema = "idx bigint, `Record ID` string, " + ", ".join(f"`{c}` string" for c in cols)
    rows = [(i, f"r{i}", *[r[c] for c in cols]) for i, r in enumerate(records)]
    random.Random(9).shuffle(rows)
    found = L.find_duplicates(spark.createDataFrame(rows, schema), "idx", L.CONTACT_WEIGHTS, threshold, "Record ID", null_is_match)
    edges, groups = brute(records, cols, weights, threshold, null_is_match)
    assert edges, "the fixture must have pairs"
    got = found.details().select("Duplicate_Group_ID", "idx", "Similarity_Score").collect()
    by = {}
    for g, i, s in got:
        by.setdefault(g, []).append((i, s))
    assert [(sorted(i for i, _ in by[g]), round(by[g][0][1], 9)) for g in sorted(by)] == groups
    total = found.pairs.agg(F.sum(F.col("copies_a") * F.col("copies_b"))).first()[0] or 0
    assert total <= len(edges)
    summary = found.summary(ids_per_part=3).orderBy("Duplicate_Group_ID", "Part").collect()
    ids = {}
    for r in summary:
        ids.setdefault(r["Duplicate_Group_ID"], []).extend(r["Record_IDs"].split(", "))
        assert len(r["Record_IDs"].split(", ")) <= 3
    assert [ids[g] for g in sorted(ids)] == [[f"r{i}" for i in members] for members, _ in groups]


def test_hot_copies(spark):
    """A third of all rows are equal: one profile, all counts exact."""
    rows = [(i, "ann", "x") for i in range(50)] + [(50 + i, f"an{i:03d}", "x") for i in range(100)]
    df = spark.createDataFrame(rows, "idx int, a string, b string")
    found = L.find_duplicates(df, "idx", {"a": 0.9, "b": 0.1}, 0.95, "idx")
    top = found.summary().where("Duplicate_Group_ID = 1").first()
    assert top["Number_of_Records"] == 50 and top["Average_Similarity"] == pytest.approx(1.0)
    assert len(top["Record_IDs"].split(", ")) == 50


def test_no_duplicates_and_missing_id(spark):
    df = spark.createDataFrame([(1, "aa"), (2, "bb")], "idx int, a string")
    assert L.find_duplicates(df, "idx", {"a": 1.0}).summary().count() == 0
    df = spark.createDataFrame([(1, "aab"), (2, "aab")], "idx int, a string")
    found = L.find_duplicates(df, "idx", {"a": 1.0})
    assert {r["Record_ID"] for r in found.details().collect()} == {"N/A"}
    assert [r["Record_IDs"] for r in found.summary().collect()] == [""]


def test_ratio(spark):
    rnd = random.Random(3)
    pairs = [("", ""), ("a", ""), ("kitten", "sitting"), ("x" * 300, "x" * 299 + "y"), ("😀a", "a😀")]
    pairs += [("".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 90))), "".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 90)))) for _ in range(60)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", indel_ratio(F.col("a"), F.col("b")).alias("r"), indel_ratio(F.col("b"), F.col("a")).alias("s")).collect():
        assert r["r"] == ratio(r["a"], r["b"]) == r["s"]


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(200, 200 + i) for i in range(30)]
    got = {r["node"]: r["component"] for r in L.connected_components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    label = {n: n for e in edges for n in e}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {n: c for n, c in label.items() if any(n in e and e[0] != e[1] for e in edges)}


def test_written_steps_are_not_broadcast(spark):
    """A written table's file tells nothing of its size in memory; none goes to the driver as a whole."""
    rows = [(i, f"name {i:05d}", "same") for i in range(300)]
    df = spark.createDataFrame(rows, "idx int, a string, b string").repartition(3)
    profiles = cut_lineage(L.build_profiles(df, "idx", ["a", "b"]))
    for step in (L.with_prefixes(profiles, [0.5, 0.5], 0.9), L.similar_pairs(profiles, [0.5, 0.5], 0.9)):
        step.collect()
        plan = step._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("most, letters", [(7, "ab"), (64, "xé😀"), (65, "ab"), (150, "abcd"), (130, "a")])
def test_all_common_subsequences(most, letters):
    """Texts of any length, in words of 64 characters, with and without a common beginning."""
    rnd = random.Random(most)
    for start in ("", "same "):
        a, b = ([start + "".join(rnd.choice(letters) for _ in range(rnd.choice([0, 1, most, rnd.randint(0, most)]))) for _ in range(9)] for _ in "ab")
        assert common_subsequences(a, b).tolist() == [[lcs(x, y) for y in b] for x in a]


def test_weighted_ratios():
    a, b = ["ab", None, "", "ab", "b"], ["", "abc", None]
    want = [[0.0 if x is None or y is None else ratio(x, y) * 0.3 for y in b] for x in a]
    assert weighted_ratios(pa.array(a), pa.array(b), 0.3).tolist() == want
    assert weighted_ratios(pa.array([None], pa.string()), pa.array(["x"]), 1.0).tolist() == [[0.0]]


def test_alike_profiles_are_no_edge_each(spark, monkeypatch):
    """All profiles of a block may be alike: what is written and linked grows with the profiles, not with their pairs."""
    seen, plain, write = [], L.connected_components, L.cut_lineage
    monkeypatch.setattr(L, "TILE", 100)
    monkeypatch.setattr(L, "connected_components", lambda e, *a: seen.append(e.count()) or plain(e, *a))
    monkeypatch.setattr(L, "cut_lineage", lambda df: (out := write(df), seen.append(out.count()))[0])
    rows = [(i, f"name {i:05d}", "same") for i in range(300)] + [(300, "name 00007", "same"), (301, "na", "sa")]
    df = spark.createDataFrame(rows, "idx int, a string, b string")
    found = L.find_duplicates(df, "idx", {"a": 0.5, "b": 0.5}, 0.8, "idx")
    assert max(seen) <= 300 * 3 * 3
    pairs = [0.5 * ratio(f"name {i:05d}", f"name {j:05d}") / 100 + 0.5 for i, j in itertools.combinations([*range(300), 7], 2)]
    got = found.pairs.agg(F.count("*"), F.sum(F.col("copies_a") * F.col("copies_b")), F.max(F.col("rep_a") >= F.col("rep_b"))).first()
    assert list(got) == [300 * 299 // 2, len(pairs) - 1, False]
    top = found.summary().collect()
    assert [(r["Number_of_Records"], len(r["Record_IDs"].split(", "))) for r in top] == [(301, 301)]
    assert top[0]["Average_Similarity"] == pytest.approx(sum(pairs) / len(pairs), abs=1e-12)


@pytest.mark.parametrize("wide", [1 << 14, 20])
@pytest.mark.parametrize("seed, n, letters, threshold", [(5, 150, "ab", 0.7), (6, 150, "abcdefghijklmnopqrstuvwxyz", 0.8), (7, 60, "ab", 0.6)])
def test_pairs_of_several_tiles(spark, monkeypatch, wide, seed, n, letters, threshold):
    """A block of many small tiles, whole and by its characters, gives each pair once."""
    monkeypatch.setattr(L, "TILE", 8)
    monkeypatch.setattr(L, "WIDE", wide)
    rnd = random.Random(seed)
    word = lambda: "no" + "".join(rnd.choice(letters) for _ in range(rnd.randint(3, 12)))
    records = [{"a": word(), "b": rnd.choice([None, word(), "no" + "x" * 70])} for _ in range(n)]
    records = [dict(t) for t in dict.fromkeys(tuple(r.items()) for r in records)]
    edges, _ = brute(records, ["a", "b"], [0.6, 0.4], threshold, False)
    rows = [(i, r["a"], r["b"]) for i, r in enumerate(records)]
    df = spark.createDataFrame(rows, "idx int, a string, b string")
    profiles = cut_lineage(L.build_profiles(df, "idx", ["a", "b"], False))
    got = L.similar_pairs(profiles, [0.6, 0.4], threshold).collect()
    assert edges and sorted((r["rep_a"], r["rep_b"], r["similarity"]) for r in got) == sorted((*e, s) for e, s in edges.items())
    if wide == 20 and seed == 6:
        assert L._cells(profiles, [0.6, 0.4], threshold).where("h <> 0").count(), "some block must go by its characters"


def test_pairs_meet_no_more_than_their_block(spark):
    """Characters that all profiles share must not multiply the rows that meet."""
    rows = [(i, f"common words {i:04d}", "same") for i in range(1500)]
    df = spark.createDataFrame(rows, "idx int, a string, b string")
    profiles = cut_lineage(L.build_profiles(df, "idx", ["a", "b"]))
    assert L.similar_pairs(profiles, [0.5, 0.5], 0.85).count() == 1500 * 1499 // 2
    assert L._tiles(profiles, [0.5, 0.5], 0.85).count() == 1500 * -(-1500 // L.TILE)
