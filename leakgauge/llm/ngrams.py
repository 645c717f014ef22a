"""Hashed n-grams of whole texts, vectorised, for the classifiers of this subpackage."""

import numpy as np

_ODD, _MIX, _WORD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Texts are hashed in runs of this many bytes, so that a long text needs no more memory than a short one.
RUN = 1 << 20


def byte_grams(data, longest, bits):
    """For runs of the bytes and n = 1 .. longest: hashes of the n-grams in 2**bits places (n-grams of different n differ)."""
    codes = np.frombuffer(b"\x02" + data + b"\x03", np.uint8)
    for start in range(0, len(codes), RUN):
        run = codes[start:start + RUN + longest - 1].astype(np.uint64)
        fresh = min(RUN, len(codes) - start)
        rolling = np.zeros(len(run), np.uint64)
        for n in range(1, longest + 1):
            m = len(run) - n + 1
            if m <= 0:
                break
            rolling = rolling[:m] * _ODD + run[n - 1:n - 1 + m] + np.uint64(1)
            mixed = (rolling[:fresh] + np.uint64(n)) * _MIX
            mixed ^= mixed >> np.uint64(29)
            mixed *= _WORD
            yield (mixed >> np.uint64(64 - bits)).astype(np.int64)


def repeat_grams(text, longest, bits):
    """N-grams over the marks "this word equals the one before", those with at least one such mark."""
    words = text.split()
    same = np.fromiter(map(str.__eq__, words, words[1:]), np.int64, max(0, len(words) - 1))
    found = [np.zeros(0, np.int64)]
    if same.any():
        history = same
        for n in range(1, longest + 1):
            if n > 1:
                history = history[:-1] * 2 + same[n - 1:]
            seen = np.unique(history[history > 0])
            found.append((seen * 31 + n * 1009 + 5) % (1 << bits))
    return np.concatenate(found)


def indicators(text, longest, bits, repeats=8):
    """Sorted places of the n-grams that occur in a text."""
    mark = np.zeros(1 << bits, bool)
    for places in byte_grams(text.encode(), longest, bits):
        mark[places] = True
    mark[repeat_grams(text, repeats, bits)] = True
    return np.flatnonzero(mark).astype(np.int32)


def shares(text, longest, bits):
    """Square roots of the n-grams' shares, a vector of length 1."""
    counts = np.zeros(1 << bits, np.float32)
    for places in byte_grams(text.encode(), longest, bits):
        counts += np.bincount(places, minlength=len(counts))
    return np.sqrt(counts / counts.sum())
