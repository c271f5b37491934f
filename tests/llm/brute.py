"""Plain versions of the operators, for small inputs."""

from __future__ import annotations


def removed_bytes(texts: dict[int, str | None], width: int = 50) -> dict[int, tuple[int, int, int, bytes]]:
    """doc_id -> bytes, removed bytes, removed runs, kept bytes."""
    data = {doc: (text or "").encode() for doc, text in texts.items()}
    smallest: dict[bytes, int] = {}
    for doc in sorted(data):
        for at in range(len(data[doc]) - width + 1):
            smallest.setdefault(data[doc][at : at + width], doc)
    out = {}
    for doc, value in data.items():
        gone = bytearray(len(value))
        for at in range(len(value) - width + 1):
            if smallest[value[at : at + width]] < doc:
                gone[at : at + width] = b"\x01" * width
        runs = sum(1 for n, g in enumerate(gone) if g and not (n and gone[n - 1]))
        kept = bytes(b for b, g in zip(value, gone) if not g)
        out[doc] = (len(value), sum(gone), runs, kept)
    return out


def shingles(text: str | None, width: int = 5) -> set[tuple[str, ...]]:
    import re

    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    if not words:
        return set()
    return {tuple(words[n : n + width]) for n in range(max(len(words) - width + 1, 1))}


def components(texts: dict[int, str | None]) -> dict[int, tuple[int, int]]:
    """doc_id -> size of its set, smallest id reachable by links."""
    sets = {doc: shingles(text) for doc, text in texts.items()}
    parent = {doc: doc for doc in texts}

    def find(doc: int) -> int:
        while parent[doc] != doc:
            doc = parent[doc]
        return doc

    holders: dict = {}
    for doc, own in sets.items():
        for shingle in own:
            holders.setdefault(shingle, []).append(doc)
    for doc, own in sets.items():
        for other in {o for shingle in own for o in holders[shingle] if o < doc}:
            both = len(own & sets[other])
            if 100 * both >= 75 * (len(own) + len(sets[other]) - both):
                low, high = sorted((find(doc), find(other)))
                parent[high] = low
    return {doc: (len(sets[doc]), find(doc)) for doc in texts}


def base_spans(text: str | None) -> str:
    """Base personal data, written as kind:start:end."""
    import re

    def luhn(digits: str) -> bool:
        doubled = [int(d) * (1 + n % 2) for n, d in enumerate(reversed(digits))]
        return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0

    def digits(value: str) -> str:
        return re.sub("[^0-9]", "", value)

    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 12 <= len(digits(v)) <= 19 and luhn(digits(v))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(digits(v)) <= 15),
    }
    found = []
    for rank, (kind, (pattern, check)) in enumerate(kinds.items()):
        found += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text or "") if check(m.group())]
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in sorted(found))


def clusters(vectors: dict[int, list[float]], k: int = 16, rounds: int = 3) -> dict[int, tuple[int, int, list[int]]]:
    """vec_id -> cluster, squared distance, final centroid; every distance evaluated."""
    import hashlib
    import math

    x = {i: [math.floor(64 * float(c)) for c in v] for i, v in vectors.items()}
    first = sorted(x, key=lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest())[:k]
    centroids = [list(x[i]) for i in first]

    def nearest() -> dict[int, tuple[int, int]]:
        return {i: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for i, v in x.items()}

    for _ in range(rounds):
        found = nearest()
        for j in range(len(centroids)):
            mine = [x[i] for i, (_, own) in found.items() if own == j]
            if mine:
                centroids[j] = [sum(column) // len(mine) for column in zip(*mine)]
    return {i: (j, d, centroids[j]) for i, (d, j) in nearest().items()}


def vector_codes(vectors: dict[int, list[float]], parts: int, entries: int, rounds: int) -> tuple[dict[int, tuple[str, int]], str]:
    """vec_id -> code in hex, squared error; and the checksum of the codebooks."""
    import hashlib
    import math

    x = {i: [math.floor(1024 * float(c)) for c in v] for i, v in vectors.items()}
    width = len(next(iter(x.values()))) // parts
    cut = {i: [v[p * width : (p + 1) * width] for p in range(parts)] for i, v in x.items()}
    books = [[list(cut[i][p]) for i in sorted(cut)[:entries]] for p in range(parts)]

    def nearest(part: list[int], book: list[list[int]]) -> tuple[int, int]:
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), j) for j, entry in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            held: dict[int, list] = {}
            for own in cut.values():
                held.setdefault(nearest(own[p], book)[1], []).append(own[p])
            books[p] = [[sum(c) // len(held[j]) for c in zip(*held[j])] if j in held else entry for j, entry in enumerate(book)]
    found = {}
    for i, own in cut.items():
        pairs = [nearest(part, book) for part, book in zip(own, books)]
        found[i] = ("".join(f"{j:02x}" for _, j in pairs), sum(d for d, _ in pairs))
    written = ",".join(str(c) for book in books for entry in book for c in entry)
    return found, hashlib.sha256(written.encode()).hexdigest()


def base_secrets(text: str | None) -> str:
    """Base secrets, written as kind:start:end."""
    import re

    keys = "password|passwd|secret|token|api_?key"
    either = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in keys)
    kinds = {
        "assign": (rf"""({either})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(2)) >= 6),
        "access": (r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 20),
        "hex": (r"[0-9a-f]+", lambda m: len(m.group()) >= 24),
    }
    found = []
    for rank, (kind, (pattern, check)) in enumerate(kinds.items()):
        found += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text or "") if check(m)]
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in sorted(found))
