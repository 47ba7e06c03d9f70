"""Plain Python versions of the definitions, for small fixtures."""

from __future__ import annotations

from collections import Counter, defaultdict
from datetime import datetime, timedelta, timezone
from hashlib import md5
from itertools import combinations

from twinfold.schemas import ARTICLE

PRIME = 2**31 - 1
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def low32(text: str) -> int:
    return int(md5(text.encode()).hexdigest()[24:], 16)


def norm(title: str, content: str) -> str:
    return f"{title} {content}".strip().lower()


def shingles(text: str) -> set[str]:
    return {text[i : i + 5] for i in range(len(text) - 4)}


def simhash(text: str) -> int:
    words = text.split()
    value = 0
    for bit in range(64):
        ones = sum(int(md5(w.encode()).hexdigest()[16:], 16) >> bit & 1 for w in words)
        value |= (2 * ones > len(words)) << bit
    return value


def minhash(text: str) -> list[int]:
    hashes = [low32(s) % PRIME for s in shingles(text)]
    pairs = [(1 + low32(f"a{i}") % (PRIME - 1), low32(f"b{i}") % PRIME) for i in range(120)]
    return [min((a * h + b) % PRIME for h in hashes) for a, b in pairs] if hashes else []


def bands(text: str) -> list[str]:
    values = minhash(text)
    return [md5(",".join(map(str, values[i : i + 6])).encode()).hexdigest()[:8] for i in range(0, len(values), 6)]


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 0.0


def candidates(texts: dict[str, str]) -> dict[tuple[str, str], int]:
    """Pairs of ids and the bands they share."""
    buckets = defaultdict(list)
    for key, text in texts.items():
        for band, value in enumerate(bands(text)):
            buckets[band, value].append(key)
    return Counter(pair for ids in buckets.values() for pair in combinations(sorted(ids), 2))


def edges(texts: dict[str, str], threshold: float = 0.8, exact: bool = True) -> dict[tuple[str, str], float]:
    sets = {k: shingles(t) for k, t in texts.items()}
    found = {(a, b): jaccard(sets[a], sets[b]) for a, b in candidates(texts)}
    found = {pair: score for pair, score in found.items() if score >= threshold}
    if exact:
        hashes = {k: simhash(t) for k, t in texts.items()}
        found.update({(a, b): 1.0 for a, b in combinations(sorted(texts), 2) if hashes[a] == hashes[b]})
    return found


def components(pairs) -> dict[str, str]:
    label: dict[str, str] = {}

    def root(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    return {x: root(x) for x in label}


def clusters(texts: dict[str, str], exact: bool = True) -> dict[str, tuple]:
    """article id -> (cluster id, score), (None, None) when unique."""
    found = edges(texts, exact=exact)
    root = components(found)
    alike = simhash if exact else str
    scores = cluster_scores({k: texts[k] for k in root}, root, alike)
    return {k: (f"cluster_{root[k]}", scores[k]) if k in root else (None, None) for k in texts}


def cluster_scores(texts: dict[str, str], cluster: dict[str, str], alike=simhash) -> dict[str, float]:
    """1.0 with an article alike in the cluster, otherwise the similarity with the cluster's smallest id."""
    number = Counter((cluster[k], alike(texts[k])) for k in texts)
    first = {}
    for key in sorted(texts):
        first.setdefault(cluster[key], key)
    sets = {k: shingles(t) for k, t in texts.items()}
    return {
        k: 1.0 if k == first[cluster[k]] or number[cluster[k], alike(t)] > 1 else jaccard(sets[k], sets[first[cluster[k]]])
        for k, t in texts.items()
    }


def frame(spark, rows, first_minute: int = 0):
    """Article rows from ``(id, title, content)``."""
    data = [
        (key, title, content, START + timedelta(minutes=first_minute + i), "src", 1, 0, [], [])
        for i, (key, title, content) in enumerate(rows)
    ]
    return spark.createDataFrame(data, ARTICLE)
