"""The disaggregated model on dense NumPy arrays, step by step: what the column expressions are tested against."""

import numpy as np


def project_block(surv: np.ndarray, reprod: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Cohorts [n, m, t, k], births [n, t] and native-born [n, t, k].

    surv [n, T, K + 1] (last entry: survival of the open group), reprod
    [n, T, K], starts [n, T, K] (arrivals of each period). A step uses the
    previous period's rates.
    """
    n, periods, k = reprod.shape
    cohorts = np.zeros((n, periods, periods, k))
    births, native = np.zeros((n, periods)), np.zeros((n, periods, k))

    def aged(pop, t):
        out = np.zeros_like(pop)
        s = surv[:, t] if pop.ndim == 2 else surv[:, None, t]
        out[..., 1:] = pop[..., :-1] * s[..., 1:k]
        out[..., k - 1] += pop[..., k - 1] * s[..., k]
        return out

    for t in range(periods):
        if t:
            before = cohorts[:, :t, t - 1]
            cohorts[:, :t, t] = aged(before, t - 1)
            births[:, t] = np.einsum("nk,nmk->n", reprod[:, t - 1], before)
            native[:, t] = aged(native[:, t - 1], t - 1)
            native[:, t, 0] += np.einsum("nk,nk->n", reprod[:, t - 1], native[:, t - 1]) + births[:, t]
        cohorts[:, t, t] = starts[:, t]
    return cohorts, births, native
