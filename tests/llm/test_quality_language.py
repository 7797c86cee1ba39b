import math
import random
import re
from collections import Counter

import numpy as np

from evstrata.llm import language, quality
from evstrata.llm.shared import table


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = list(zip(words, words[1:], words[2:], strict=False))
    n = Counter(runs)
    covered = {i + k for i, g in enumerate(runs) if n[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def check_measures(docs, out):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = out.collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in docs.collect())
    for r in rows:
        want = counts(texts[r["doc_id"]])
        assert tuple(r[n] for n in NAMES) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_measures_equal_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    check_measures(docs, quality.judge(docs))


def test_quality_edges(edge_docs, no_docs):
    check_measures(edge_docs, quality.judge(edge_docs))
    assert quality.judge(no_docs).count() == 0


def test_labelled_quality(spark, sf_dir):
    out = quality.judge(table(spark, sf_dir, "documents")).join(table(spark, sf_dir, "labels").withColumnRenamed("quality", "label"), "doc_id").filter("NOT base_failed").collect()
    assert sum(r["kept"] == (r["label"] == 1) for r in out) >= 0.97 * len(out)


FINE, SILENT, JUNK, SHOUT = (1, 0, 0, 0, 0, 0), (0, 0, 0, 0, 0, 0), (-1, -1, 0, 0, 0, 0), (-1, 0, 0, 0, -1, 0)


def test_clean_tables_stay_and_junk_goes_at_any_share():
    for fine, silent, junk, shout in ((900, 100, 0, 0), (10, 0, 0, 0), (0, 10, 0, 0), (5, 500, 0, 0), (500, 20, 3, 2), (50_000, 20, 3, 2), (50, 5, 50, 50), (0, 0, 100, 50)):
        counts = [(p, n) for p, n in ((FINE, fine), (SILENT, silent), (JUNK, junk), (SHOUT, shout)) if n]
        post = quality.fit_votes(counts)
        assert all((q >= 0.5) == (p in (FINE, SILENT)) for p, q in post.items()), (counts, post)
    assert quality.fit_votes([]) == {}


def test_language_held_out(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = language.language_of(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and sum(r["lang"] == r["lang_pred"] for r in out) >= 0.97 * len(out)
    assert all(0 <= r["score"] <= 1 for r in rows) and sum(r["rejected"] for r in rows) <= 0.01 * len(rows)


def test_language_edges(edge_docs, no_docs):
    rows = language.language_of(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 and by[i]["rejected"] for i in (1, 2, 3, 9))
    assert all(by[i]["lang_pred"] == "en" for i in (4, 5, 7, 10))
    assert language.language_of(no_docs).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id bigint, text string, lang string")
    assert language.language_of(docs).first()["lang_pred"] == "und"


class DirectKneserNey:
    """Interpolated Kneser-Ney by the book, over dictionaries of tuples."""

    def __init__(self, texts, alphabet):
        runs = [self.read(t) for t in texts]
        top = Counter(tuple(r[i - 3 : i + 1]) for r in runs for i in range(3, len(r)))
        self.n = {4: top}
        for k in (3, 2, 1):
            # How many different symbols stand before a shorter n-gram.
            self.n[k] = Counter(g[1:] for g in self.n[k + 1])
        self.d, self.total, self.kinds = {}, {}, {}
        for k in (1, 2, 3, 4):
            ones, twos = (sum(v == i for v in self.n[k].values()) for i in (1, 2))
            self.d[k] = (ones + 0.5) / (ones + 2 * twos + 1)
            self.total[k], self.kinds[k] = Counter(), Counter()
            for g, v in self.n[k].items():
                self.total[k][g[:-1]] += v
                self.kinds[k][g[:-1]] += 1
        self.floor = 1 / (4 * alphabet)

    @staticmethod
    def read(text):
        out = [1, 1, 1]
        for c in text.lower():
            s = ord(c) if c.isalpha() else 32
            if s != 32 or out[-1] != 32:
                out.append(s)
        return out

    def p(self, g):
        if not g:
            return self.floor
        k, context = len(g), g[:-1]
        if not self.total[k][context]:
            return self.p(g[1:])
        direct = max(self.n[k][g] - self.d[k], 0) / self.total[k][context]
        return direct + self.d[k] * self.kinds[k][context] / self.total[k][context] * self.p(g[1:])

    def entropy(self, text):
        s = self.read(text)
        return -sum(math.log(self.p(tuple(s[i - 3 : i + 1]))) for i in range(3, len(s))) / (len(s) - 3)


def test_entropies_equal_a_direct_computation(spark):
    rng = random.Random(11)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 8)))
    line = lambda letters, n: rng.choice(("", " ", "7, ")) + rng.choice((" ", ". ", "\n")).join(word(letters) for _ in range(n))
    alphabets = {"x": "abcde", "y": "cdefgÉ", "z": "日本語文"}
    rows = [(i, line(a, 60), lang) for i, (lang, a) in enumerate([*alphabets.items()] * 12)]
    own = {lang: [t for _, t, of in rows if of == lang] for lang in alphabets}
    alphabet = int(sum(len({s for t in ts for s in DirectKneserNey.read(t)[3:]}) for ts in own.values()) / len(own))
    direct = {lang: DirectKneserNey(ts, alphabet) for lang, ts in own.items()}
    model = language.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    texts = [line("abcdefgÉ日本q", 20) for _ in range(30)] + ["a", "  b", "日本", "\0c\0"]
    entropy, size = language.score_texts(model, texts)
    for t, row, n in zip(texts, entropy, size, strict=True):
        assert n == len(DirectKneserNey.read(t)) - 3
        for lang, e in zip(model.langs, row, strict=True):
            assert abs(e - direct[lang].entropy(t)) < 1e-4, (t, lang)


def test_score_is_the_share_of_the_likelihoods(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(80)
    model = language.learn(docs)
    rows = language.identify(docs.withColumn("own", docs["text"]), model, ["doc_id", "own"]).collect()
    for r in rows:
        if r["lang_pred"] == "und":
            continue
        entropy, size = language.score_texts(model, [r["own"]])
        likelihood = [math.exp(-(e - entropy[0].min()) * size[0]) for e in entropy[0]]
        assert abs(r["score"] - 1 / sum(likelihood)) < 1e-9 and r["lang_pred"] == model.langs[int(entropy[0].argmin())]


def test_model_is_a_distribution(spark):
    """Over all symbols after a context."""
    docs = spark.createDataFrame([(1, "abab abba baab", "x"), (2, "abba", "x")], "doc_id bigint, text string, lang string")
    m = language.learn(docs)
    symbols = [ord(c) for c in "ab "]
    for context in ([1, 1, 1], [ord("a"), ord("b"), ord("a")], [32, ord("a"), ord("b")]):
        total = 0.0
        for s in symbols:
            seq = np.array([1, *context, s], np.uint32)
            slots = [c.view(np.int64) for c in language.codes(seq)]
            g = [c[1:] for c in slots]
            x = [slots[0][1:]] + [c[:-1] for c in slots[:-1]]
            total += float(np.exp(m.logs(g, x, language.ORDER - 1))[0, 0])
        # What is left is for symbols never seen.
        assert 0.8 < total <= 1.0001
