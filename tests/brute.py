"""Plain loop versions of the operators, for comparison on small series."""

from __future__ import annotations

import math


def runs(flags):
    out, start = [], None
    for i, f in enumerate(list(flags) + [False]):
        if f and start is None:
            start = i
        elif not f and start is not None:
            out.append((start, i))
            start = None
    return out


def clean(x, low=50, high=240, limit=40, jump=30):
    r = [v if v is not None and low <= v <= high and v != 0 else None for v in x]
    v = list(r)
    for i in range(1, len(r)):
        if r[i] is not None and r[i - 1] is not None and abs(r[i] - r[i - 1]) > jump:
            v[i] = None
    out, filled = list(v), [False] * len(v)
    for s, e in runs([q is None for q in v]):
        before = v[s - 1] if s > 0 else None
        after = v[e] if e < len(v) else None
        if e - s > limit or (before is None and after is None):
            continue
        for k in range(s, e):
            filled[k] = True
            if before is None or after is None:
                out[k] = after if before is None else before
            else:
                out[k] = before + (after - before) / (e - (s - 1)) * (k - (s - 1))
    return out, filled


def interpolate(x, method="linear"):
    known = [i for i, v in enumerate(x) if v is not None]
    out = list(x)
    if not known:
        return out
    for i, v in enumerate(x):
        if v is None:
            b = max((k for k in known if k < i), default=None)
            a = min((k for k in known if k > i), default=None)
            if b is None or a is None:
                out[i] = x[a if b is None else b]
            elif method == "nearest":
                out[i] = x[b] if i - b <= a - i else x[a]
            else:
                out[i] = (x[a] - x[b]) / (a - b) * (i - b) + x[b]
    return out


def percentile(x, q):
    s = sorted(x)
    at = (len(s) - 1) * q
    lo, hi = math.floor(at), math.ceil(at)
    return s[lo] + (s[hi] - s[lo]) * (at - lo)


def peaks(u, distance):
    """Accepted contraction peaks of a whole series."""
    n = len(u)
    mean = sum(u) / n
    sd = math.sqrt(sum((v - mean) ** 2 for v in u) / n)
    if max(abs(v) for v in u) == 0 or sd < 1e-6:
        return []
    found, i = [], 1
    while i < n - 1:
        j = i
        while j < n and u[j] == u[i]:
            j += 1
        if u[i - 1] < u[i] and j < n and u[j] < u[i]:
            found.append((i + j - 1) // 2)
        i = j
    floor = percentile(u, 0.75)
    found = [p for p in found if u[p] >= floor]
    kept = []
    for p in sorted(found, key=lambda p: (-u[p], -p)):
        if all(abs(p - k) >= distance for k in kept):
            kept.append(p)
    out = []
    for p in sorted(kept):
        left = right = u[p]
        k = p
        while k >= 0 and u[k] <= u[p]:
            left = min(left, u[k])
            k -= 1
        k = p
        while k < n and u[k] <= u[p]:
            right = min(right, u[k])
            k += 1
        if u[p] - max(left, right) >= 0.5 * sd:
            out.append(p)
    return out


def decelerations(x, uc, base, fs=4.0):
    out = []
    for s, e in runs([v is not None and v < base - 15 for v in x]):
        if e - s < 60:
            continue
        seg = x[s:e]
        low = min(seg)
        nadir = s + seg.index(low)
        rate = (x[s] - low) / (nadir - s) if nadir > s else 0.0
        a, b = max(0, s - 480), min(len(x), s + 240)
        part = uc[a:b]
        lag, contraction = 0.0, False
        if not all(v is None for v in part) and not all(v is not None and v == 0 for v in part):
            zeroed = [0.0 if v is None else v for v in part]
            lag, contraction = (nadir - a - zeroed.index(max(zeroed))) / fs, True
        if rate > 0.5:
            kind = "Variable"
        elif not contraction:
            kind = "Unclassified"
        elif abs(lag) < 5:
            kind = "Early"
        elif lag > 15:
            kind = "Late"
        else:
            kind = "Variable" if rate > 0.3 else "Unclassified"
        if (e - s) / fs > 120:
            kind = "Prolonged"
        signs = []
        if sum(v < 70 for v in seg) / fs > 60:
            signs.append("Severe drop (<70 bpm for >60s)")
        if max(seg) - low < 5:
            signs.append("Absent internal variability")
        if (e - nadir) / fs > 60:
            signs.append(f"Slow recovery ({(e - nadir) / fs:.0f}s)")
        post = [v for v in x[e : e + 240] if v is not None]
        if post and max(post) > base + 10:
            signs.append("Overshoot")
        mid = (e - s) // 2
        first, second = min(seg[:mid]), min(seg[mid:])
        if first < base - 10 and second < base - 10 and max(seg[mid - 5 : mid + 5]) > first + 10:
            signs.append("W-shape (biphasic)")
        out.append((s, e, nadir, kind, round(lag, 1), tuple(signs)))
    return out
