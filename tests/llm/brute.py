"""Plain versions of the operators' results, over lists of rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

FOLDED = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SPACED = re.compile("[^\x20\x09-\x0d]+")


def lower(text: str | None) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def folded(text: str | None) -> list[str]:
    return FOLDED.findall(lower(text))


def spaced(text: str | None) -> list[str]:
    return SPACED.findall(text or "")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def crc_mod(doc_id, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n if doc_id is not None else 0


def decontaminated(docs, items, window=10):
    windows: dict[tuple, set[str]] = {}
    for item, text in items:
        words = folded(text)
        size = min(window, len(words))
        for k in range(len(words) - size + 1 if words else 0):
            windows.setdefault(tuple(words[k : k + size]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        words, hit, found = folded(text), set(), set()
        for size in sizes:
            for k in range(len(words) - size + 1):
                if owners := windows.get(tuple(words[k : k + size])):
                    hit |= set(range(k, k + size))
                    found |= {str(x) for x in owners if x is not None}
        out.append((doc, len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def repeated(docs, window=35):
    words = [(doc, spaced(text)) for doc, text in docs]
    counts = Counter(tuple(w[k : k + window]) for _, w in words for k in range(len(w) - window + 1))
    out = []
    for doc, w in words:
        gone = {k + j for k in range(len(w) - window + 1) if counts[tuple(w[k : k + window])] > 1 for j in range(window)}
        out.append((doc, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}


def licensed(docs):
    out = []
    for doc, text in docs:
        words, starts, labels = folded(text), [], set()
        for phrase, label in PHRASES.items():
            for k in range(len(words) - len(phrase) + 1):
                if tuple(words[k : k + len(phrase)]) == phrase:
                    starts.append(k)
                    labels.add(label)
        out.append((doc, len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))))
    return out


def base_scores(docs):
    rows = [(doc, crc_mod(doc, 7) == 2, spaced(lower(text)) + ["\n"]) for doc, text in docs]
    counts = Counter(w for _, held, words in rows if not held for w in words)
    n, v = sum(counts.values()), len(counts)
    return [(doc, held, len(words), sum(counts[w] > 0 for w in words), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)) for doc, held, words in rows]


def components(docs, size=4, percent=85):
    sets = {}
    for doc, text in docs:
        words = spaced(lower(text))
        sets[doc] = {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
    up = {doc: doc for doc in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    holders: dict[tuple, list] = {}
    for a in ids:
        shared = Counter(b for s in sets[a] for b in holders.get(s, ()))
        for b, both in shared.items():
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                up[y] = x
        for s in sets[a]:
            holders.setdefault(s, []).append(a)
    return [(doc, len(sets[doc]), find(doc)) for doc in ids]


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def real(kind, value):
    digits = [int(x) for x in value if x in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if kind == "card":
        doubled = [2 * d - 9 * (d > 4) if k % 2 else d for k, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return True


def private(docs):
    out = []
    for doc, text in docs:
        spans = {k: [m.span() for m in re.finditer(p, text or "") if real(k, m[0])] for k, p in PLAIN.items()}
        joined = ",".join(f"{k}:{a}:{b}" for k, found in spans.items() for a, b in found)
        out.append((doc, *(len(found) for found in spans.values()), sha(joined)))
    return out


def wider(kind, value):
    digits = "".join(x for x in value if x in "0123456789")
    if kind == "email":
        return value.rsplit("@", 1)[1].lower()
    if kind == "ip":
        return ".".join(value.split(".")[:3])
    return digits[:6] if kind == "card" else digits[:-4]


def disclosed(docs, chance=0.5, bits=4.0, least=3, support=2):
    """Spans of terms of each document, from counts of all pairs of a term and an entity; docs by place, ids may repeat."""
    words, base, holders, entities = [], [], {}, {}
    for k, (_, text) in enumerate(docs):
        text = text or ""
        words.append([(m.start(), m.end(), re.sub(r"^[\W_]+|[\W_]+$", "", m[0]).lower()) for m in SPACED.finditer(text)])
        base.append([(kind, *m.span(), m[0]) for kind, p in PLAIN.items() for m in re.finditer(p, text) if real(kind, m[0])])
        for _, _, t in words[k]:
            if len(t) >= least:
                holders.setdefault(t, set()).add(k)
        for kind, _, _, value in base[k]:
            entities.setdefault((kind, value), set()).add(k)
            entities.setdefault((kind, "of", wider(kind, value)), set()).add(k)
    marked: list[set] = [set() for _ in docs]
    for owners in entities.values():
        for t, have in holders.items():
            both = len(have & owners)
            if both >= chance * len(have) and both and math.log2(both * len(docs) / (len(have) * len(owners))) >= bits:
                for k in have if both >= support else have & owners:
                    marked[k].add(t)
    return [
        (doc, [(a, b) for a, b, t in words[k] if t in marked[k] and not any(x < b and a < y for _, x, y, _ in base[k])])
        for k, (doc, _) in enumerate(docs)
    ]
