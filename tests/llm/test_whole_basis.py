"""The latent space is fitted on every passage."""

import numpy as np

from vitalgrid.llm import decontamination


def test_every_passage_takes_part_in_the_fit(spark):
    """The sketch over twelve passages adds up to A'(A R) worked out directly, however few are taken at a time."""
    r = np.random.default_rng(5)
    codes = [r.integers(0, 12, n).astype("<u2") for n in (70, 33, 1, 100, 64)]
    rows = [(0, bytearray(c.tobytes()), h) for h, c in enumerate(codes)]
    encoded = spark.createDataFrame(rows, "kind int, codes binary, __h long")
    idf = np.linspace(0.5, 2.0, 12)
    passages = [c[i : i + 32] for c in codes for i in range(0, len(c), 32)]
    a = np.array([np.bincount(p, minlength=12) * idf / np.linalg.norm(idf[p]) for p in passages])
    for fit in (3, 1 << 14):
        settings = decontamination.Settings(rank=4, extra=8, fit=fit)
        basis, root = decontamination.latent_basis(encoded, idf, settings)
        value, vector = np.linalg.eigh(a.T @ a)
        assert np.allclose(root[:4] ** 2, value[::-1][:4], rtol=1e-3)
        assert np.allclose(np.abs((basis[:, :4] * vector[:, ::-1][:, :4]).sum(axis=0)), 1, atol=1e-3)
