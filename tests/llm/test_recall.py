"""Recall of the leak search against the alignment of every item with every document."""

from __future__ import annotations

import numpy as np
import pytest

from skarv.llm import leakage

SIZES = (3, 5, 8, 12, 20, 25, 40, 100, 300)


def _corpus(rng: np.random.Generator, each: int):
    """Items of all sizes from one skewed vocabulary, as texts in common use have."""
    words = [f"w{i}" for i in range(3000)]
    draw = lambda n: [words[int(i)] for i in np.minimum(rng.zipf(1.3, n) - 1, 2999)]
    return draw, [(k, " ".join(draw(size))) for k, size in enumerate(np.repeat(SIZES, each).tolist())]


def _edited(rng: np.random.Generator, text: list[str], share: float) -> list[str]:
    out = list(text)
    for i in rng.permutation(len(out))[: int(share * len(out))]:
        out[i] = ["", f"x{i}", f"{out[i]} x{i}"][int(rng.integers(0, 3))]  # left out, changed, put in
    return [w for w in " ".join(out).split() if w]


@pytest.mark.parametrize("edits", [0.0, 0.1, 0.2, 0.3])
@pytest.mark.parametrize("parts", [1, 3])
def test_recall_of_edited_leaks(edits, parts):
    rng = np.random.default_rng(int(100 * edits) + parts)
    draw, items = _corpus(rng, 8)
    index = leakage.Index(items)
    documents = []
    for _, text in items:
        edited = _edited(rng, text.split(), edits)
        cuts = [len(edited) * k // parts for k in range(parts + 1)]
        documents.append(" ".join(w for a, b in zip(cuts, cuts[1:]) for w in (*draw(60), *edited[a:b])) + " " + " ".join(draw(60)))
    ids = [[index.vocabulary.get(w, 0) for w in leakage.words(t)] for t in documents]
    found = {(n, item) for n, item, _ in index.leaks(ids)}
    share = lambda n, k: leakage.carried(index.items[k], np.array(ids[n], dtype=np.int32), np.arange(len(ids[n])))
    own = {(n, n) for n in range(len(documents)) if share(n, n) >= leakage.CARRIED}
    assert len(own & found) >= 0.95 * len(own)
    for size in SIZES:
        mine = {(n, k) for n, k in own if len(index.items[k]) == size}
        assert len(mine & found) >= 0.85 * len(mine), size
    assert all(share(n, k) >= leakage.CARRIED for n, k in list(found)[:100])


def test_the_number_of_walks_follows_the_recall_asked_for():
    items = _corpus(np.random.default_rng(1), 12)[1]
    walks = [len(leakage.Index(items, recall).walks) for recall in (0.5, 0.9, 0.999)]
    assert walks == sorted(walks) and walks[0] < walks[-1]
