"""Plain versions of what the operators compute, for small inputs."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def repeats(rows, length=50):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of (doc_id, text) rows; a null id is larger than all."""
    rows = [(d, float("inf") if d is None else d, (t or "").encode()) for d, t in rows]
    seen = {}
    for _, d, b in rows:
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            seen[s] = min(seen.get(s, float("inf")), d)
    out = []
    for name, d, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, x in zip(b, gone, strict=True) if not x)
        out.append((name, len(b), sum(gone), sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text, n=4):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def groups(rows, percent=85):
    """(doc_id, n_shingles, component_id, n_links) of (doc_id, text) rows without null ids."""
    sets = [shingles(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least[find(i)], links[i]) for i, (d, _) in enumerate(rows)]


def edit_distance_inside(item, text):
    """The least edit distance of item to any substring of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def base_pii(text):
    """(start, kind, end) by the patterns as the contract writes them."""
    rx = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for k, r in enumerate(rx):
        for m in re.finditer(r, text or ""):
            d = re.sub(r"[^0-9]", "", m[0])
            ok = (True, all(int(p) <= 255 for p in m[0].split(".")) if k == 1 else True, 12 <= len(d) <= 19 and luhn(d), 9 <= len(d) <= 15)[k]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)
