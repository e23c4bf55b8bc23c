"""Plain versions of the operators, a document at a time or all pairs of a small table."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {x: x + 32 for x in range(65, 91)}


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def lower(text):
    return (text or "").translate(UPPER)


def shingles(text, size=5):
    words = WORD.findall(lower(text))
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def components(docs):
    """doc_id -> smallest id that links of Jaccard 0.8 reach."""
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def kept_lines(docs):
    """doc_id -> (lines, dropped, kept text)."""
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    first, holders = {}, {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            k = key(line)
            if len(k) >= 10:
                first[k] = min(first.get(k, i), i)
                holders.setdefault(k, set()).add(i)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(key(x)) >= 10 and len(holders[key(x)]) > 1 and first[key(x)] != i)]
        out[i] = (len(lines), len(lines) - len(stay), "\n".join(stay))
    return out


def kept_words(docs, size=13):
    """doc_id -> (words, removed, kept words)."""
    words = {i: WORD.findall(t or "") for i, t in docs}
    first = {}
    for i, w in words.items():
        for p in range(len(w) - size + 1):
            k = tuple(w[p : p + size])
            first[k] = min(first.get(k, i), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for p in range(len(w) - size + 1):
            if first[tuple(w[p : p + size])] < i:
                gone.update(range(p, p + size))
        out[i] = (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
    return out


def leaks(docs, items):
    """(doc_id, item_id, shingles of the item, common ones) of containments of 0.8."""
    out = set()
    for i, t in docs:
        held = shingles(t)
        for j, x in items:
            own = shingles(x)
            if own and 100 * len(own & held) >= 80 * len(own):
                out.add((i, j, len(own), len(own & held)))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def personal(text):
    """[(kind, start, end)] of the seed kinds."""
    out = []
    for kind, pattern in KINDS:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def audit(docs, labels):
    """(part, order, step) -> (kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), each order filtered anew; docs are (id, text, part)."""
    from itertools import permutations

    ids = {}
    for i, t, _ in docs:
        if i is not None:
            ids.setdefault(t or "", []).append(i)
    fails = []
    for i, t, _ in docs:
        t = t or ""
        words = WORD.findall(t)
        bad = set()
        if len(words) < 100:
            bad.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            bad.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t):
            bad.add("C")
        if re.search("[#$%&*|]", t):
            bad.add("D")
        if i is not None and min(ids[t]) < i:
            bad.add("E")
        fails.append(bad)
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, x in labels if x == 1} - {None}
    out = {}
    for part in {p or "" for _, _, p in docs}:
        mine = [n for n, d in enumerate(docs) if (d[2] or "") == part]
        sums = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [n for n in left if f in fails[n]]
                left = [n for n in left if f not in fails[n]]
                sums[f] += len(gone)
                early = sum(f in fails[n] for n in mine) - len(gone)
                alone = sum(fails[n] == {f} for n in mine)
                out[part, order, step] = [len(left), len(gone), early, alone, sum(docs[n][0] in good for n in gone), sum(docs[n][0] in toxic for n in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(sums[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def license_matches(text, templates):
    """{(template, first word, end word, containment)}: every window of every template judged."""
    words = LICENSE_WORD.findall(lower(text))
    out = set()
    for number, t in enumerate(templates):
        own = t.text.split()
        for begin in range(0, max(1, len(words)), t.stride):
            block = words[begin : begin + 2 * t.stride]
            share = len(set(own) & set(block)) / len(set(own))
            if share + 1e-9 < (1 if t.exact else t.least) or not set(t.must) <= set(block) or set(t.never) & set(block):
                continue
            if not t.exact:
                out.add((number, begin, begin + len(block), share))
        if t.exact:
            out |= {(number, i, i + len(own), 1.0) for i in range(len(words)) if words[i : i + len(own)] == own}
    return out


def planted(doc_id, text):
    """The words of operator 13's query."""
    import zlib

    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def runs(words):
    """[(start, length, smallest period)] of the maximal stretches that repeat four times and have six words, each period tried."""
    out = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q):
                out.setdefault((i, length), q)  # a multiple of the smallest period covers the same stretch
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)
