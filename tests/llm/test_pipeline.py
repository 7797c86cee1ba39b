"""Every stage of the pipeline against brute force, and rows without ids, with repeated ids and repeated rows."""

import math
from collections import Counter

import pytest
from test_near_dup import brute
from test_others import best_overlap, words_of
from test_quality_language import counts
from test_tokens_packing import check_packing

from evstrata.llm import language, quality, tokens
from evstrata.llm.shared import cut, table


def votes(text):
    """The rules' votes on a text, from counts made here."""
    n_words, word_chars, n_symbols, n_dup, n_repeat = counts(text)
    letters = sum(c.isalpha() or c.isnumeric() for c in text)
    lines = sum(1 for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r"))
    upper = sum("A" <= c <= "Z" for c in text)
    odd = 1 - letters / max(word_chars, 1)
    bad = (odd > 0.10, n_symbols / max(n_words, 1) > 0.10, n_dup / max(lines, 1) > 0.30, n_repeat / max(n_words, 1) > 0.40, upper / max(word_chars, 1) > 0.40, abs(word_chars / max(n_words, 1) - 6.0) > 4.5)
    return tuple(-1 if b else 1 if i == 0 and 0 <= odd <= 0.05 else 0 for i, b in enumerate(bad))


def posteriors(all_votes, rounds=100):
    """Expectation-maximisation, document by document: P(good | votes) under independent votes in two classes."""
    n, rules = len(all_votes), range(6)
    good = [1 / (1 + math.exp(-(1 + 0.5 * v.count(1) - 6 * v.count(-1)))) for v in all_votes]
    for _ in range(rounds):
        weight = {1: good, 0: [1 - g for g in good]}
        # A tenth of the documents is believed, beforehand, to be good, and to vote as the classes are meant.
        size = {0: 1 + sum(weight[0]), 1: 1 + sum(weight[1]) + 0.1 * n}
        table_ = {}
        for c in (0, 1):
            for r in rules:
                mass = {v: 1.0 + 0.1 * n * (v == 0 or v == (1 if c else -1)) for v in (-1, 0, 1)}
                for w, seen in zip(weight[c], all_votes, strict=True):
                    mass[seen[r]] += w
                total = sum(mass.values())
                table_[c, r] = {v: m / total for v, m in mass.items()}
        new = []
        for seen in all_votes:
            a, b = (size[c] * math.prod(table_[c, r][seen[r]] for r in rules) for c in (1, 0))
            new.append(a / (a + b))
        moved = max(abs(x - y) for x, y in zip(new, good, strict=True))
        good = new
        if moved < 1e-9:
            break
    return good


def verdicts(texts):
    """Posterior and verdict of each text."""
    out = []
    for text, q in zip(texts, posteriors([votes(t) for t in texts]), strict=True):
        n = counts(text)
        out.append((q, n[0] >= 50 and 100 * n[4] <= 50 * n[0] and q >= 0.5))
    return out


def test_quality_verdicts_equal_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    got = {r["doc_id"]: r for r in quality.judge(table(spark, sf_dir, "documents")).collect()}
    for (i, _), (q, kept) in zip(rows, verdicts([t for _, t in rows]), strict=True):
        assert abs(got[i]["quality"] - q) < 1e-6 and got[i]["kept"] == kept


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    """The table, with a benchmark item in a document, a near copy of one, and rows in an unlearned language."""
    docs = table(spark, sf_dir, "documents")
    item = table(spark, sf_dir, "benchmark").orderBy("item_id").first()["text"]
    long = max((r["text"] for r in docs.filter("lang = 'en'").collect()), key=len)
    foreign = "satunnainen suomenkielinen lause on kirjoitettu kokeeksi ja se jatkuu viela hetken aikaa ennen kuin loppuu kokonaan " * 6
    more = [(10_000_001, long + "\n" + item), (10_000_002, long + " and then"), (10_000_003, foreign), (None, foreign + "x"), (None, long), (None, long), (10_000_004, long.upper()), (10_000_004, long[: len(long) // 2]), (10_000_005, None)]
    return cut(docs.unionByName(spark.createDataFrame([(i, t, None, "x", 0) for i, t in more], "doc_id bigint, text string, lang string, source string, n_chars bigint")), "documents")


def rows_of(docs):
    return Counter((r["doc_id"], r["text"]) for r in docs.collect())


def test_stages_equal_brute_force(spark, sf_dir, documents):
    import corpus_pipeline as pipeline

    stage = dict(pipeline.STAGES)
    docs, seen = documents, rows_of(documents)

    def step(name, want):
        nonlocal docs, seen
        out = cut(stage[name](spark, docs, sf_dir), name)
        assert out.columns == documents.columns
        got = rows_of(out)
        assert got == want, [sorted(map(str, (got - want)))[:2], sorted(map(str, (want - got)))[:2]]
        docs, seen = out, got

    gone = {r["text_key"] for r in language.language_of(docs).filter("rejected").collect()}
    from hashlib import md5

    step("language_id", Counter({k: n for k, n in seen.items() if k[1] is not None and md5(k[1].encode()).hexdigest() not in gone}))
    assert not any("suomenkielinen" in t for _, t in seen)

    texts = [k[1] for k, n in seen.items() for _ in range(n)]
    kept = {t for t, (_, good) in zip(texts, verdicts(texts), strict=True) if good}
    step("quality_rules", Counter({k: n for k, n in seen.items() if k[1] in kept}))
    assert seen[None, next(t for i, t in seen if i is None)] == 2

    # Rows without an id are in no group; of repeated rows one stays.
    named = sorted((i, t) for i, t in seen if i is not None)
    component = {i: c for i, (_, c) in brute(named).items()}
    step("near_dedup", Counter(k for k in seen if k[0] is None or component[k[0]] == k[0]))
    assert 10_000_002 not in {i for i, _ in seen}

    items = [words_of(r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    hit = lambda t: any(len(set(w) & set(words_of(t))) >= 6 and best_overlap(words_of(t), w) >= 12 for w in items)
    step("benchmark_decontamination", Counter({k: n for k, n in seen.items() if not hit(k[1])}))
    assert 10_000_001 not in {i for i, _ in seen}

    check_packing(docs, stage["best_fit_packing"](spark, docs, sf_dir), tokens.WordTokenizer(tokens.tokenizer_path()))


def test_run_is_all_stages(spark, sf_dir):
    import corpus_pipeline as pipeline

    docs = table(spark, sf_dir, "documents")
    for name, stage in pipeline.STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    assert {r["doc_id"] for r in pipeline.run(spark, sf_dir).collect()} == {r["doc_id"] for r in docs.collect()}
