"""Plain Python versions of what the operators compute."""

import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = WORDS.findall(lowered(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(docs):
    """doc_id -> (set size, smallest doc_id reachable) for (doc_id, text) pairs with distinct ids."""
    sets = {d: shingles(t) for d, t in docs}
    out = {d: d for d in sets}

    def root(x):
        while out[x] != x:
            x = out[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
                    x, y = sorted((root(a), root(b)))
                    out[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


BENCH_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(text, items, window=10):
    """(n_words, n_hit, sorted item ids as strings)."""
    w = BENCH_WORDS.findall(lowered(text))
    hits, ids = set(), set()
    for item, t in items:
        v = BENCH_WORDS.findall(lowered(t))
        k = min(len(v), window)
        grams = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if k else set()
        for i in range(len(w) - k + 1) if k else ():
            if tuple(w[i : i + k]) in grams:
                hits.update(range(i, i + k))
                ids.add(str(item))
    return len(w), len(hits), sorted(ids)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c)
        total += (v * 2 - 9 if v > 4 else v * 2) if i % 2 else v
    return total % 10 == 0


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def personal(text):
    """Base spans: (start, kind's place, end, kind)."""
    out = []
    for k, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))) or (kind == "card" and 14 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 10 <= len(d) <= 15):
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)
