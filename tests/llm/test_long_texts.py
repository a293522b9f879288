"""Fingerprints of texts of many words."""

import numpy as np
import pytest

from millrace.llm import imatch


@pytest.mark.parametrize("n", [5000, 15000, 50000])
def test_likeness_of_long_texts_follows_their_terms(n):
    rng = np.random.default_rng(n)
    pool = [f"t{i}" for i in range(200_000)]
    lexicon = np.sort(imatch._hashes([t.encode() for t in pool]))
    maker, got, want = imatch.Fingerprinter(lexicon), [], []
    for _ in range(12):
        text, following = (" ".join(pool[i] for i in rng.integers(0, len(pool), n)) for _ in range(2))
        changed = imatch.edited(text, following)
        a, b = imatch.terms_of(text), imatch.terms_of(changed)
        want.append(len(a & b) / len(a | b))
        row = maker.row(text)
        got.append(maker.likeness(row, maker.row(changed)))
        assert maker.likeness(row, maker.row(following)) < 0.35
    assert abs(np.mean(got) - np.mean(want)) < 0.12, (np.mean(got), np.mean(want))
