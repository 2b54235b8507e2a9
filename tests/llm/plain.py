"""Plain versions of the query contracts, one text at a time."""

import re
from collections import Counter

BREAKS = "[\x20\x09-\x0d]+"


def words(text):
    return [w for w in re.split(BREAKS, text or "") if w]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def base_counts(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {p for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def _luhn(digits):
    each = [int(c) for c in reversed(digits)]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(each)) % 10 == 0


KINDS = ["email", "ip", "card", "phone"]


def pii(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and _luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def license_words(text):
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text)) if w]


def license_places(text):
    w, out = license_words(text), {}
    for label, phrase in {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}.items():
        p = phrase.split()
        out[label] = [i for i in range(len(w)) if w[i : i + len(p)] == p]
    return out


def shingles(text, size=3):
    w = words(lower(text))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def groups(texts, percent=90, size=3):
    """{doc_id: smallest linked doc_id} over {doc_id: text}, by comparing all pairs that share a shingle."""
    sets = {d: shingles(t, size) for d, t in texts.items()}
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = {}
    for d in sorted(sets):
        shared = Counter(e for g in sets[d] for e in seen.get(g, ()))
        for e, k in shared.items():
            if 100 * k >= percent * (len(sets[d]) + len(sets[e]) - k):
                a, b = top(d), top(e)
                parent[max(a, b)] = min(a, b)
        for g in sets[d]:
            seen.setdefault(g, []).append(d)
    return {d: top(d) for d in sets}
