import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from evstrata.llm import hashing
from evstrata.llm.components import connected_components
from evstrata.llm.near_dup import Registers, Rule, _borrow_order, band_keys, chance, estimate, linked, linked_in_block, near_duplicates, registers, sure_below
from evstrata.llm.shared import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows):
    """Components of all pairs that share enough of their whole sets."""
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [shingles(t) for _, t in rows]
    where = defaultdict(list)
    for n, (i, _) in enumerate(rows):
        common = Counter(m for x in sets[n] for m in where[x])
        for x in sets[n]:
            where[x].append(n)
        for m, c in common.items():
            if 100 * c >= 75 * (len(sets[n]) + len(sets[m]) - c):
                a, b = find(i), find(rows[m][0])
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for (i, _), s in zip(rows, sets, strict=True)}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_table_equals_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = near_duplicates(docs)
    assert result(out) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out.collect())


def test_edges(edge_docs, no_docs):
    out = near_duplicates(edge_docs)
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    assert result(out) == brute(list(dict(rows).items()))
    assert out.count() == len(rows)
    assert near_duplicates(no_docs).count() == 0


def test_large_group_of_near_copies_is_whole(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(400):
        words = list(base)
        for at in rng.choice(120, int(rng.integers(1, 5)), replace=False):
            words[at] = f"x{rng.integers(10**6)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    # Small limits, so that large buckets go through blocks.
    assert result(near_duplicates(docs, rule=Rule(pair_limit=8, block=64))) == brute(rows)


@pytest.mark.parametrize(("n", "pairs"), [(4, 20_000), (8, 2000), (16, 1000), (100, 500), (4000, 40)])
def test_no_pair_at_the_threshold_is_lost(n, pairs):
    """Pairs at exactly three quarters share a band, and pass what stands before the exact test."""
    shape, order, rule = Registers(), _borrow_order(256), Rule()
    rng = np.random.default_rng(n)
    for _ in range(pairs):
        u = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        a, b = u, np.sort(u[rng.permutation(len(u))[: len(u) * 3 // 4]])
        ra, rb = registers(a, shape, order), registers(b, shape, order)
        ka, kb = band_keys(np.array([ra, rb]), shape)
        assert (ka == kb).any()
        assert linked(a, b, ra, rb, rule, shape) and linked(b, a, rb, ra, rule, shape)


@pytest.mark.parametrize("sizes", [(3000, 3000), (3000, 9000), (200, 200)])
def test_collisions_are_as_many_as_expected(sizes):
    # Few mantissa bits, so that there are some to count.
    shape = Registers(mantissa_bits=4)
    rng = np.random.default_rng(1)
    order = _borrow_order(256)
    share = []
    for _ in range(120):
        a, b = (np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64)) for n in sizes)
        index = [np.unique(x >> np.uint64(56)).astype(int) for x in (a, b)]
        both = np.intersect1d(*index)
        share.append(np.mean(registers(a, shape, order)[both] == registers(b, shape, order)[both]))
    assert abs(np.mean(share) - chance(*sizes, shape)) < 5 * np.std(share) / len(share) ** 0.5 + 0.05 * chance(*sizes, shape)


def test_estimate_is_sure_where_it_is_asked():
    rule, shape = Rule(), Registers()
    assert 0.5 < sure_below(rule, shape) < 0.6
    rng, order = np.random.default_rng(2), _borrow_order(256)
    for share in (0.3, 0.75, 0.9):
        u = np.unique(rng.integers(0, 1 << 64, 30_000, dtype=np.uint64))
        # Both drop the same number of the rest.
        rest = int(len(u) * (1 - share) / 2)
        a, b = np.sort(u[rest:]), np.sort(u[: len(u) - rest])
        got = estimate(registers(a, shape, order), registers(b, shape, order), len(a), len(b), shape)
        assert abs(got - share) < 0.16


def test_repeated_ids_with_different_texts(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "pq")
    near_two = two.replace("q0 ", "other ")
    rows = [(5, one), (5, two), (9, near_two), (3, one), (5, None), (None, two), (5, one)]
    want = sorted([(5, 3, False)] * 3 + [(9, 3, False), (3, 3, True)])
    for order in (rows, rows[::-1], sorted(rows, key=str)):
        out = near_duplicates(spark.createDataFrame(order, "doc_id bigint, text string").repartition(3)).collect()
        # Row (5, null) has no shingles and stays by itself.
        assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in out if r["doc_id"] and r["n_shingles"]) == want
        assert [(r["component_id"], r["kept"]) for r in out if r["doc_id"] is None] == [(None, True)]


def test_block_links_join_what_all_links_join():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 14, rng.integers(4, 40)).astype(np.uint64)) for _ in range(30)]
    ids = np.arange(30)
    want = {(i, j) for i in range(30) for j in range(30) if i < j and 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))}

    def groups(links):
        root = list(range(30))
        for _ in range(30):
            for i, j in links:
                root[i] = root[j] = min(root[i], root[j])
        return root

    got = linked_in_block(ids, ids, np.zeros(30, int), sets, 60)
    assert {(min(p), max(p)) for p in got} <= want and groups(got) == groups(want) and len(got) < 30
    assert len(want) > len(got)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 300), (400, 300)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert got == {**dict.fromkeys(range(101), 0), 300: 300, 400: 300, 500: 300}


def test_words_and_case():
    import pyarrow as pa

    texts = ["A b\u00e9\tC", "a B\u00c9 c", " a  b\u00e9 \n c ", "", None]
    data, at = hashing.strings(pa.array(texts))
    sets = [s.tolist() for s in hashing.shingle_sets(data, at)]
    assert sets[0] == sets[2] != sets[1] and sets[3] == sets[4] == []
