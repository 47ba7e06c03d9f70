"""A small corpus with copies, near copies, chains, boilerplate, short and blank texts."""

from __future__ import annotations

import random


def sentence(rng: random.Random, words: int) -> list[str]:
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(words)]


def corpus(seed: int = 7, families: int = 12, template: int = 0) -> list[tuple[str, str, str]]:
    rng = random.Random(seed)
    texts: list[str] = []
    for _ in range(families):
        words = sentence(rng, 60)
        texts.append(" ".join(words))
        current = words
        for _ in range(rng.randint(0, 4)):  # a chain of small edits
            current = list(current)
            for _ in range(rng.randint(1, 3)):
                current[rng.randrange(len(current))] = sentence(rng, 1)[0]
            texts.append(" ".join(current))
        if rng.random() < 0.5:
            texts.append(" ".join(words).upper())  # equal after normalising
        if rng.random() < 0.5:
            shuffled = list(words)
            rng.shuffle(shuffled)
            texts.append(" ".join(shuffled))  # equal SimHash, other shingles
    page = sentence(rng, 50)
    for i in range(template):  # one text with a changed number: a large bucket
        texts.append(" ".join(page) + f" item {i}")
    frame = sentence(rng, 30)
    for _ in range(template // 2):  # half boilerplate: shares bands now and then, never similar
        texts.append(" ".join(frame + sentence(rng, 30)))
    texts += ["abc", "abc", "abcd", "abcde", "　", "café \U0001f600\U0001f600 naïve café", "新闻聚类系统"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(str(i), "", texts[position]) for i, position in enumerate(order)]


def as_texts(rows) -> dict[str, str]:
    return {key: f"{title} {content}".strip().lower() for key, title, content in rows}
