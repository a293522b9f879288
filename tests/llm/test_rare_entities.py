"""Terms that reveal an entity met in one line only."""

import random

from millrace.llm import privacy

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def test_a_term_of_a_single_line_is_hidden_and_common_words_stay(spark):
    rng = random.Random(8)
    common = ["".join(rng.choice(LETTERS) for _ in range(6)) for _ in range(60)]
    plain = [" ".join(rng.choice(common) for _ in range(12)) for _ in range(3000)]
    line = f"{common[0]} Zanzarella {common[1]}: ask ann@mail.example.org, {common[2]} zanzarella Zanzarella"
    rows = [(i, "\n".join(plain[10 * i:10 * i + 10])) for i in range(300)] + [(None, plain[0] + "\n" + line), (900, line + "\n" + plain[1])]
    got = {r.doc_id: r for r in privacy.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc_id, text in rows[300:]:
        r = got[doc_id]
        assert "anzarella" not in r.sanitised and "[EMAIL]" in r.sanitised
        assert all(w in r.sanitised for w in common[:3])
        assert {text[s.start:s.end] for s in r.entities.terms} == {"Zanzarella", "zanzarella", "ask"}
        assert all(s.value == text[s.start:s.end] for s in r.entities.terms)
    assert all(got[i].sanitised == text for i, text in rows[:300])
    rarer = {r.doc_id: r for r in privacy.sanitise(spark.createDataFrame(rows, "doc_id long, text string"), smoothing=50.0).collect()}
    assert not rarer[900].entities.terms
