"""Plain-Python statements of the operators' results, for small fixtures."""

import hashlib
import re
from collections import Counter, defaultdict


def words(text):
    return (text or "").encode().split()


def repeats(docs, window):
    """{doc_id: (n_words, n_removed, sha256)}"""
    first = {}
    for i, text in docs:
        w = words(text)
        for k in range(len(w) - window + 1):
            t = tuple(w[k : k + window])
            first[t] = min(first.get(t, i), i)
    out = {}
    for i, text in docs:
        w = words(text)
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())
    return out


def similar(a, b, percent=75):
    return bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b)


def shingles(text, k=5):
    w = [x.lower() for x in words(text)]
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(docs, k=5):
    """{doc_id: (n_shingles, component_id)}"""
    sets = {i: shingles(t, k) for i, t in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and similar(sets[x], sets[y]):
                a, b = sorted((root(x), root(y)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def lines(docs, least=5):
    """{doc_id: numbers of removed lines}"""
    seen, holders, out = [], defaultdict(list), defaultdict(list)
    for i, text in sorted(docs):
        for k, line in enumerate((text or "").split("\n")):
            w = [x.lower() for x in words(line)]
            if len(w) < least:
                continue
            own = set(w)
            shared = Counter(j for t in own for j in holders[t])
            if any(similar(own, seen[j]) for j in shared):
                out[i].append(k)
            for t in own:
                holders[t].append(len(seen))
            seen.append(own)
    return dict(out)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(text):
    d = [int(c) for c in text if c in "0123456789"][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def spans(x):
    digits = lambda s: sum(c in "0123456789" for c in s)
    out = [("email", *m.span()) for m in EMAIL.finditer(x)]
    out += [("ip", *m.span()) for m in IP.finditer(x) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(x) if 13 <= digits(m.group()) <= 19 and luhn(m.group())]
    return out + [("phone", *m.span()) for m in PHONE.finditer(x) if 9 <= digits(m.group()) <= 15]
