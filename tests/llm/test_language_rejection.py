"""Documents of no learned language and of random letters are rejected, whichever fold they are in."""

import random

from evstrata.llm import language
from evstrata.llm.shared import table

FOREIGN = "satunnainen suomenkielinen lause on kirjoitettu kokeeksi ja se jatkuu viela hetken aikaa ennen kuin loppuu kokonaan "


def test_planted_foreign_and_junk_are_rejected_in_both_folds(spark, sf_dir):
    rng = random.Random(5)
    junk = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(rng.choice((60, 300, 1500)))) for _ in range(40)]
    foreign = [FOREIGN * rng.choice((1, 4, 12)) for _ in range(40)]
    planted = [(10_000_000 + i, t, None) for i, t in enumerate(junk + foreign)]
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows = language.language_of(docs.unionByName(spark.createDataFrame(planted, "doc_id bigint, text string, lang string"))).collect()
    bad = [r for r in rows if r["doc_id"] >= 10_000_000]
    assert len(bad) == 80 and {r["held_out"] for r in bad} == {False, True}
    assert [r["doc_id"] for r in bad if not r["rejected"]] == []
    clean = [r for r in rows if r["doc_id"] < 10_000_000]
    assert sum(r["rejected"] for r in clean) <= 0.01 * len(clean)
