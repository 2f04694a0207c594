"""What a scorer holds follows blocks of windows, however many different words its texts have."""

import numpy as np

from braidseq.llm import toxicity


def test_new_words_are_spelled_in_blocks_and_scores_stay(monkeypatch):
    model = toxicity.Model({}, toxicity._fresh(2, np.random.default_rng(3)))
    texts = [" ".join(f"w{k}x{i}" for i in range(3000)) for k in range(20)] + ["a b c", "", None]
    alone = [toxicity.Scorer(model)([t])[0] for t in texts]
    most, spell = [], model.spell

    def watched(words, keep=None):
        most.append(len(words))
        return spell(words, keep)

    monkeypatch.setattr(model, "spell", watched)
    assert np.allclose(toxicity.Scorer(model)(texts), alone, atol=1e-6)
    assert sum(most) >= 60_000 and max(most) <= 30_000
