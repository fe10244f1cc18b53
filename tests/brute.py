"""Scores and verification straight from their definitions, one window and one edit at a time."""


def f1(p):
    return max(1, 5 - p)


def f2(p):
    return max(2, 10 - 2 * p)


def replacement(q, s):
    found = [2 * (len(q) - 1) - f1(bad[0]) for i in range(len(s) - len(q) + 1) if q and len(bad := [p for p in range(len(q)) if s[i + p] != q[p]]) == 1]
    return max(found, default=None)


def extra(q, s):
    return max((2 * (len(q) - 1) - f2(p) for p in range(len(q)) if q[:p] + q[p + 1 :] in s), default=None)


def missing(q, s):
    found = [2 * len(q) - f2(p) for i in range(len(s) - len(q)) for p in range(len(q) + 1) if q and (w := s[i : i + len(q) + 1])[:p] + w[p + 1 :] == q]
    return max(found, default=None)


def score(q, s):
    if not q or not s:
        return None
    if q in s:
        return 2 * len(q)
    return max((x for x in (replacement(q, s), extra(q, s), missing(q, s)) if x is not None), default=None)


def verify(q, s):
    if not q:
        return False, None, None
    if q in s:
        return True, s.index(q), "exact"
    n = len(q)
    for kind, fits in (
        ("substitution", [i for i in range(len(s) - n + 1) if sum(a != b for a, b in zip(q, s[i : i + n])) == 1]),
        ("insertion", [s.index(q[:p] + q[p + 1 :]) for p in range(n) if q[:p] + q[p + 1 :] in s]),
        ("deletion", [i for i in range(len(s) - n) if any(s[i : i + p] + s[i + p + 1 : i + n + 1] == q for p in range(n + 1))]),
    ):
        if fits:
            return True, min(fits), kind
    return False, None, None
