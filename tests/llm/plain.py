"""Plain versions of the operators, for small data."""

import hashlib
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from itertools import accumulate, permutations

import xxhash

SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile("[^\x20\x09-\x0d]+")


def fold(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


def words(text):
    return WORD.findall(fold(text or ""))


def runs(w, k):
    return [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else ([" ".join(w)] if w else [])


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def secrets(text):
    text, found = text or "", []
    kinds = [
        ("assign", r"""(?ia:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20),
        ("hex", r"[0-9a-f]+", 0, 24),
    ]
    for k, (name, pattern, group, least) in enumerate(kinds):
        for m in re.finditer(pattern, text):
            if len(m[group]) >= least:
                found.append((m.start(), k, m.end(), name, m[group]))
    return sorted(found)


def uncovered(texts, length):
    """(bytes, removed, spans, kept) of each text without its repeated strings."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + length] for b in raw for p in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return out


def dedup_lines(rows, min_chars=40, min_docs=5):
    """Kept text, lines, dropped lines of each (id, text)."""
    low = lambda d: (d is not None, d or 0)
    key = lambda line: fold(line.strip(SPACE))
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(low(d))
    gone = {k: max(v) for k, v in holders.items() if len(k) >= min_chars and len(v) >= min_docs}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in gone or gone[key(x)] == low(d)]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def simhash(text, size, seed=42):
    w = runs(words(text), size)
    ones = [0] * 64
    for s in w:
        h = xxhash.xxh64(s.encode(), seed=seed).intdigest()
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(w))


def components(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in links:
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def base_counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if seen[x] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def _byte_alphabet():
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def alignment(texts, tokenizer, pieces):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text, encoded whole."""
    letters, found = _byte_alphabet(), []
    for t in texts:
        if not t:
            found.append(None)
            continue
        e = tokenizer.encode(" " + t, add_special_tokens=False)
        a = [(i, bytes(letters[c] for c in token)) for i, token in zip(e.ids, e.tokens, strict=True)]
        b = []
        for i in pieces.encode(t):
            p = pieces.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("\u2581", " ").encode()))
        whole = (" " + t).encode()
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            found.append(None)
            continue
        ends = [list(accumulate(len(x) for _, x in side)) for side in (a, b)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in cuts]
        for k, side in enumerate((a, b)):
            for (i, _), end in zip(side, ends[k], strict=True):
                groups[bisect_left(cuts, end)][k].append(i)
        links = Counter((i, j) for x, y in groups for i in x for j in y)
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        found.append((len(a), len(b), len(cuts), links, sha(said)))
    counts = Counter(p for f in found if f for p in f[3])
    best = Counter()
    for (i, _), c in counts.items():
        best[i] = max(best[i], c)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = f[3]
        n_best = sum(m for p, m in links.items() if counts[p] == best[p[0]])
        out.append((*f[:3], sum(links.values()), n_best, sum(m * counts[p] for p, m in links.items()), f[4]))
    return out


def similar_sets(rows, size=3, percent=90):
    """(shingles, smallest id reachable) of each (id, text)."""
    sets = [set(runs(words(t), size)) for _, t in rows]
    links = [
        (i, j)
        for i in range(len(rows))
        for j in range(i)
        if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    group, least = components(len(rows), links), {}
    for g, (d, _) in zip(group, rows, strict=True):
        least[g] = d if least.get(g) is None else (least[g] if d is None else min(least[g], d))
    return [(len(s), least[g]) for s, g in zip(sets, group, strict=True)]


def filter_audit(rows, labels):
    """Rows of (part, order, step, counts ...) from (id, part, text) and (id, quality, toxic)."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    parts = defaultdict(list)
    for d, part, text in rows:
        text = text or ""
        w = WORD.findall(text)
        copy = d is not None and any(e is not None and e < d and (t or "") == text for e, _, t in rows)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": copy,
        }
        parts[part or ""].append((d, {k for k, v in fails.items() if v}))
    out, removed = {}, Counter()
    for part, docs in parts.items():
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [(d, x) for d, x in docs if f in x and not x & before]
                removed[part, f] += len(here)
                out[part, "".join(order), step] = (
                    sum(not x & {*before, f} for _, x in docs),
                    len(here),
                    sum(f in x and bool(x & before) for _, x in docs),
                    sum(x == {f} for _, x in docs),
                    sum(d in good for d, _ in here),
                    sum(d in toxic for d, _ in here),
                )
    return {(*k, *v, removed[k[0], k[1][k[2] - 1]]) for k, v in out.items()}
