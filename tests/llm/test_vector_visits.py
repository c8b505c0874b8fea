"""Embedding near-duplicates in shares of cells: visits are written without vectors, and shares change no result."""

import numpy as np

from graphjobs.llm import imi


def table(spark, x, kind):
    return spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], f"vec_id bigint, embedding array<{kind}>")


def test_visits_in_shares(spark, monkeypatch):
    """No written table holds a vector more than once; shares, chunks and the element type change no result."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(25, 16))
    x = np.concatenate([centres.repeat(8, 0) + rng.normal(size=(200, 16)) * 0.2, centres[:3], centres[:3], rng.normal(size=(100, 16))]).astype(np.float32)
    tables, written = [], imi.materialise

    def kept(df, name):
        made = written(df, name)
        tables.append((name, made.count() if "v" in made.columns else 0))
        return made

    monkeypatch.setattr(imi, "materialise", kept)
    whole = sorted(map(tuple, imi.embedding_classes(table(spark, x, "float")).collect()))
    assert max(rows for _, rows in tables) <= len(x) and [name for name, _ in tables].count("links") == 1
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    close = (u @ u.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    assert 0.9 * close.sum() <= sum(r[1] for r in whole) <= close.sum()
    tables.clear()
    monkeypatch.setattr(imi, "VISITS", 1)
    shared = imi.embedding_classes(table(spark, x, "double"), chunk=40).collect()
    assert [name for name, _ in tables].count("links") > 1
    assert sorted(map(tuple, shared)) == whole


def test_joined_groups():
    rng = np.random.default_rng(13)
    root, want = np.arange(60), np.arange(60)
    for _ in range(12):
        a, b = rng.integers(0, 60, (2, 5))
        root = imi._joined(root, a, b)
        for x, y in zip(a, b):
            want[(want == want[x]) | (want == want[y])] = min(want[x], want[y])
        assert (root == want).all()
