"""Plain versions that several tests hold the library against."""

import numpy as np


def plain_spikes(x, alpha, threshold, refractory, longest, settle=1):
    """Spikes of one trace, sample by sample: the mean moves, then the amplitude is taken; the last peak is kept after
    every stretch."""
    mean, start, peak, top, last, found = float(np.mean(x[:settle])), None, None, 0.0, -1000, []
    for i, v in enumerate(np.asarray(x, float).tolist()):
        mean += alpha * (v - mean)
        amp = mean - v
        if amp > threshold:
            if start is None:
                start, peak, top = i, i, amp
            elif amp > top:
                peak, top = i, amp
        elif start is not None:
            if peak - last > refractory and i - start <= longest:
                found.append((peak, top))
            last, start = peak, None
    return found


def plain_filter(b, a, x, z=None):
    """y[i] = sum b x - sum a y, one sample at a time (transposed direct form)."""
    p = max(len(a), len(b)) - 1
    b, a = list(b) + [0.0] * (p + 1 - len(b)), list(a) + [0.0] * (p + 1 - len(a))
    z, out = list(z if z is not None else [0.0] * p) + [0.0], []
    for v in x:
        y = b[0] * v + z[0]
        for i in range(p):
            z[i] = b[i + 1] * v - a[i + 1] * y + z[i + 1]
        out.append(y)
    return np.array(out)
