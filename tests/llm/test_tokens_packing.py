import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evstrata.llm import packing, token_counts, tokens
from evstrata.llm.shared import table

ODD = ["<|endoftext|> x", "a\x1cb", "İstanbul ı", "Σας ΟΔΟΣ", "éa \u0301x", "it's we'LL 'S don't", "1234 ½ ²", "日本語 text", "a\u00a0b\u2003c\u0085d", "x" * 5000, "\u200bzero", "ﬁne ǅ", "ß ẞ ÀÉ", "<|startoftext|", "", "ſK \u212a"]


@pytest.fixture(scope="module")
def bpe():
    return tokens.WordTokenizer(tokens.tokenizer_path())


def whole(bpe, text):
    return np.array(bpe.whole.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


def test_ids_equal_the_tokenizer(bpe, spark, sf_dir):
    texts = ODD + [r["text"] for r in table(spark, sf_dir, "documents").collect()]
    for text, ids in zip(texts, bpe.ids(texts), strict=True):
        assert ids == whole(bpe, text)[:-1].tobytes(), text[:40]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    bpe = tokens.WordTokenizer.cached(tokens.tokenizer_path())
    assert bpe.ids([text])[0] == whole(bpe, text)[:-1].tobytes()


def check_packing(docs, out, bpe, capacity=2048):
    want = Counter()
    for r in docs.collect():
        ids = whole(bpe, r["text"])
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want[(r["doc_id"], k // capacity, k, len(part), zlib.crc32(part.tobytes()))] += 1
    rows = out.collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(r["length"] for r in rows) // capacity)


def test_packing_round_trip(spark, sf_dir, bpe):
    docs = table(spark, sf_dir, "documents")
    used, least = check_packing(docs, packing.pack(docs), bpe)
    assert used <= least * 1.01 + 1


def test_packing_edges(edge_docs, no_docs, bpe):
    check_packing(edge_docs, packing.pack(edge_docs), bpe)
    check_packing(edge_docs, packing.pack(edge_docs, capacity=7), bpe, 7)
    assert packing.pack(no_docs).count() == 0


def fewest(items, capacity):
    best = [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                bins[k] += items[i]
                place(i + 1, bins)
                bins[k] -= items[i]
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best[0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=8))
def test_reduction_keeps_the_optimum(items):
    items.sort(reverse=True)
    counts = Counter(items)
    plan = packing.plan_bins(counts, 20)
    used = Counter()
    for kinds, times in plan:
        assert sum(kinds) <= 20 and times > 0
        for s in kinds:
            used[s] += times
    assert used == counts
    left = packing._Sizes(dict(counts))
    fixed = packing.reduce_dominated(left, 20)
    rest = sorted((s for s, n in left.n.items() for _ in range(n)), reverse=True)
    assert sum(n for _, n in fixed) + fewest(rest, 20) == fewest(items, 20)


@pytest.fixture(scope="module")
def unigram():
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = token_counts.unigram_pieces(token_counts.vocabulary_path())
    reference = Tokenizer(models.Unigram([("<unk>", -1.0), *pieces, *((f"<0x{i:02X}>", -2.0) for i in range(256))], 0, True))
    reference.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
    return token_counts.CountingViterbi(pieces), reference


def test_counts_equal_the_unigram_tokenizer(unigram, spark, sf_dir):
    mine, reference = unigram
    texts = [r["text"] for r in table(spark, sf_dir, "documents").collect()] + ["", "  a  b ", "    indented\n        more  \n\t x\n  \n", "a" + " " * 37 + "b   ", " ", "   ", "\n \n  a", "a\nb\n\nc", "日本語のテキスト", "▁▁x", "\0a b", "𝔘nicode 🎉🎉", "a" * 300]
    for t in texts:
        assert mine.count(t) == len(reference.encode(t, add_special_tokens=False).ids), t[:40]


def test_ties_go_to_the_longer_last_piece():
    # a|bc and ab|c score alike; the last piece that starts first is bc.
    m = token_counts.CountingViterbi([("▁a", -1.0), ("bc", -1.0), ("▁ab", -1.0), ("c", -1.0), ("▁", -9.0), ("b", -9.0), ("b c", -9.0)])
    assert m.count_word("▁abc") == 2


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab  \n▁\t\0é", max_size=30))
def test_any_spacing(unigram, text):
    mine, reference = unigram
    assert mine.count(text) == len(reference.encode(text, add_special_tokens=False).ids)


def test_vocabulary_with_inner_spaces_is_run_over_whole_texts():
    m = token_counts.CountingViterbi([("▁a", -1.0), ("▁b", -1.0), ("▁a▁b", -1.5), ("c", -3.0), ("▁", -9.0)])
    assert not m.splits and m.count("a b") == 1 and m.count("a b a") == 2 and m.count("c a b") == 3


def test_token_count_edges(edge_docs, no_docs, unigram):
    rows = token_counts.count_tokens(edge_docs).collect()
    texts = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    assert sorted((r["doc_id"], r["n_tokens"]) for r in rows) == sorted((i, unigram[0].count(t)) for i, t in texts)
    assert token_counts.count_tokens(no_docs).count() == 0
