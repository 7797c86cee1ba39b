"""No counted n-gram is merged or dropped, and a model too large to broadcast gives the same results."""

import random

import numpy as np
import pytest

from evstrata.llm import language
from evstrata.llm.shared import table


def test_every_counted_ngram_is_held(spark):
    rng = random.Random(3)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(3000)) for _ in range(20)]
    docs = spark.createDataFrame([(i, t, "zh") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    m = language.learn_any(docs)
    want = set()
    for t in texts:
        padded = "\x01" * 3 + t
        want |= {padded[i : i + 4] for i in range(len(t))}
    # The next text's pads and the symbol before the first belong to no 4-gram that is counted.
    assert len(m.slots[3]) == len(want)
    assert all(np.all(np.diff(a) > 0) for a in m.slots)


@pytest.mark.parametrize("which", ["documents", "edges"])
def test_joined_model_equals_arrays(which, spark, sf_dir, edge_docs):
    docs = table(spark, sf_dir, "documents") if which == "documents" else edge_docs
    a = sorted(language.language_of(docs).collect(), key=lambda r: (r["doc_id"], r["symbols"]))
    b = sorted(language.language_of(docs, cells=0).collect(), key=lambda r: (r["doc_id"], r["symbols"]))
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert (x["doc_id"], x["held_out"], x["lang_pred"], x["rejected"]) == (y["doc_id"], y["held_out"], y["lang_pred"], y["rejected"])
        assert abs(x["score"] - y["score"]) < 1e-3
        assert x["symbols"] == y["symbols"] and abs(x["entropy"] - y["entropy"]) < 1e-4
