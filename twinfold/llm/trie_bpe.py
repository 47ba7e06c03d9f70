"""BPE encoding and decoding of documents through a trie of their distinct words.

The distinct words of a block of documents form a trie whose edges are symbols (the
last symbol of a word carries the end mark). In sorted order the words are its leaves as a depth-first
walk meets them, so the trie needs no nodes: the common prefix of two neighbours says how far the walk goes
back, and a stack holds the states of the present path. Going down, each prefix gets the
last token of its encoding. BPE keeps the encoding of a prefix that ends at a
token border, so the last token of a prefix is the one suffix that is a token and may
follow the last token of what is before it. Each shared prefix is thus encoded once, and a
word's ids are read by walking the last tokens back.

Two tokens may stand side by side if no merge across their border comes before the merges
that build them; this is decided by walking the two facing edges of their merge trees.

Edge cases: null and empty texts have no ids and decode to the empty text. Special tokens in a
text become their ids, as the tokenizers library does it. Repeated ids are separate rows, an empty
table gives an empty result. Only ``doc_id`` and ``text`` are read; other columns may have any name.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.llm.common import as_bytes, grouped, share, shared, small_batches

_BLOCK = 4_000_000  # bytes of text whose words are inserted together
_KEEP = 400_000  # words in each of the two generations that a worker remembers

#: Characters for which Python's normalisation and letter classes are those of the tokenizer.
_PLAIN = regex.compile("[\x21-\x7e\xa1-ɏ‐-‧€]*")
_NEVER = 1 << 60
#: Stands for the tokenizer's end-of-word mark inside this module; no byte symbol is this character.
END = "\n"


def byte_symbols() -> list[str]:
    """The printable character that byte-level tokenizers write for each byte value."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Merges:
    """A tokenizer's tokens, their merge ranks and the facing edges of their merge trees."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.text = {i: t for t, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.rank: dict[tuple[int, int], int] = {}
        made: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            pair = (self.ids[a], self.ids[b])
            self.rank.setdefault(pair, rank)
            whole = self.ids[a + b]
            if whole in made:
                raise ValueError(f"two merges make token {whole}")
            made[whole] = pair
            if any(part in made and self.rank[made[part]] > rank for part in pair):
                raise ValueError(f"token {whole} is merged before its parts")
        # From the whole token inwards: the ids on its left and right edge and the ranks that made them.
        self.left: dict[int, list[tuple[int, int]]] = {}
        self.right: dict[int, list[tuple[int, int]]] = {}
        for token in self.text:
            for side, edges in ((0, self.left), (1, self.right)):
                at, edge = token, []
                while at in made:
                    edge.append((at, self.rank[made[at]]))
                    at = made[at][side]
                edges[token] = [*edge, (at, -1)][::-1]
        self.side_by_side: dict[tuple[int, int], bool] = {}
        # A token that its own text is not encoded as can never come out of the merges.
        reachable = {t for t in self.text if t not in made or self.allowed(*made[t], self.rank[made[t]])}
        tokens = {self.text[t].replace(self.end, END): t for t in reachable}
        # An automaton over the tokens: of every prefix of a token, the longest token that ends it and
        # the longest shorter suffix that is such a prefix too.
        self.states: dict[str, tuple[int, str]] = {"": (-1, "")}
        prefixes = sorted({text[:n] for text in tokens for n in range(1, len(text) + 1)}, key=len)
        known = set(prefixes)
        for prefix in prefixes:
            back = self.states[prefix[:-1]][1] if len(prefix) > 1 else None
            while back is not None and back + prefix[-1] not in known:
                back = self.states[back][1] if back else None
            shorter = "" if back is None else back + prefix[-1]
            own = tokens.get(prefix)
            self.states[prefix] = (self.states[shorter][0] if own is None else own, shorter)
        # Of every token its number of symbols, and the next shorter token that ends it, or -1.
        self.shorter = {t: (len(x) - x.endswith(END), self.states[self.states[x][1]][0]) for x, t in tokens.items()}

    def allowed(self, a: int, b: int, until: int = _NEVER) -> bool:
        """Whether no merge across the border of ``a`` and ``b`` comes before rank ``until``."""
        if until == _NEVER and (a, b) in self.side_by_side:
            return self.side_by_side[a, b]
        left, right, i, j, fine = self.right[a], self.left[b], 0, 0, True
        while True:
            over = self.rank.get((left[i][0], right[j][0]), _NEVER)
            next_left = left[i + 1][1] if i + 1 < len(left) else _NEVER
            next_right = right[j + 1][1] if j + 1 < len(right) else _NEVER
            # Of equal ranks the leftmost is merged first.
            if over < until and over < next_left and over <= next_right:
                fine = False
                break
            if min(next_left, next_right) == _NEVER:
                break
            if next_left <= next_right:
                i += 1
            else:
                j += 1
        if until == _NEVER:
            self.side_by_side[a, b] = fine
        return fine


def encodings(merges: Merges, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
    """Every distinct word, written in byte symbols, with its ids, by one depth-first walk of their trie."""
    states, shorter = merges.states, merges.shorter
    allowed, known = merges.allowed, merges.side_by_side
    # By depth on the present path: the state, the last token and its number of symbols.
    path: list[str] = [""]
    tokens, sizes = [-1], [0]
    before = ""
    for word in sorted(words):
        last = len(word) - 1  # the symbol with the end mark, an edge of this word alone
        depth, most = 0, min(last, len(before) - 1)
        while depth < most and before[depth] == word[depth]:
            depth += 1
        del path[depth + 1 :], tokens[depth + 1 :], sizes[depth + 1 :]
        state = path[depth]
        while depth <= last:
            symbol = word[depth]
            longer = state + symbol
            while longer not in states:
                if not state:
                    raise ValueError(f"symbol {symbol!r} is not in the vocabulary")
                state = states[state][1]
                longer = state + symbol
            state = longer
            if depth == last:
                longer = state + END
                while longer not in states:
                    state = states[state][1]
                    longer = state + END
                state = longer
            depth += 1
            # The tokens that end the prefix, longer ones first.
            token = states[state][0]
            while token >= 0:
                size, next_token = shorter[token]
                left = tokens[depth - size]
                fine = left < 0 or known.get((left, token))
                if allowed(left, token) if fine is None else fine:
                    break
                token = next_token
            else:
                raise ValueError(f"no token ends at {symbol!r}")
            path.append(state)
            tokens.append(token)
            sizes.append(size)
        found, at = [], depth
        while at:
            found.append(tokens[at])
            at -= sizes[at]
        before = word
        yield word, found[::-1]


class Encoder:
    """Encodes byte words of texts, block by block, and remembers what it has encoded."""

    def __init__(self, merges: Merges, definition: str):
        from tokenizers import Tokenizer

        self.merges = merges
        self.exact = Tokenizer.from_str(definition)
        pattern = json.loads(definition)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern)
        self.symbols = byte_symbols()
        self.of: dict[bytes, tuple[int, str, str]] = {}
        self.old: dict[bytes, tuple[int, str, str]] = {}
        self.blank = False  # whether a word without any token was met
        self.cut = regex.compile("|".join(map(regex.escape, merges.special)).encode()) if merges.special else None
        self.of_special = {t.encode(): (1, str(i), t) for t, i in merges.special.items()}

    def split(self, word: bytes) -> list[str]:
        """The pre-tokens of a word, written in byte symbols."""
        text = word.decode()
        if _PLAIN.fullmatch(text):
            found = self.pieces.findall(unicodedata.normalize("NFC", text).lower())
            # The printable ASCII characters are their own symbols.
            return [p if p.isascii() else "".join(map(self.symbols.__getitem__, p.encode())) for p in found]
        tidy = self.exact.normalizer.normalize_str(text)
        return [p for p, _ in self.exact.pre_tokenizer.pre_tokenize_str(tidy)]

    def learn(self, words: set[bytes]) -> None:
        """Encode words not met before: their distinct pieces by one walk of a trie."""
        new = words.difference(self.of)
        if len(self.of) + len(new) > _KEEP:
            # The older generation goes; what this block needs of the other one is taken over.
            self.old, self.of, new = self.of, {}, words
        if self.old:
            known = self.old
            again = {w: known[w] for w in new if w in known}
            self.of.update(again)
            new = new.difference(again)
        pieces = {w: self.split(w) for w in new}
        # Of a piece: how many ids, the ids as text, the tokens as text.
        text = self.merges.text
        coded = {
            piece: (len(ids), " ".join(map(str, ids)), " ".join([text[i] for i in ids]))
            for piece, ids in encodings(self.merges, {p for found in pieces.values() for p in found})
        }
        for word, found in pieces.items():
            if len(found) == 1:
                self.of[word] = coded[found[0]]
            else:
                parts = [coded[p] for p in found]
                self.of[word] = (sum(p[0] for p in parts), " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts]))
                self.blank |= not parts

    def words(self, text: bytes) -> list[tuple[bool, list[bytes]]]:
        """``(special, words)`` runs of a text: words are cut at ASCII white space, in lower case."""
        if self.cut is None or b"<|" not in text:
            return [(False, text.lower().split())]
        runs, at = [], 0
        for hit in self.cut.finditer(text):
            runs += [(False, text[at : hit.start()].lower().split()), (True, [hit.group()])]
            at = hit.end()
        return [*runs, (False, text[at:].lower().split())]

    def documents(self, texts: list[bytes]) -> Iterator[tuple[int, str, str]]:
        """Of each text: number of ids, the ids joined by a space, the decoded text."""
        cut = [self.words(t) for t in texts]
        self.learn({w for runs in cut for special, words in runs if not special for w in words})
        for runs in cut:
            found = []
            for special, words in runs:
                found += map((self.of_special if special else self.of).__getitem__, words)
            if self.blank:
                found = [f for f in found if f[0]]
            counts, ids, tokens = zip(*found) if found else ((), (), ())
            yield sum(counts), " ".join(ids), " ".join(tokens)


class Shared:
    """What tasks are sent; a worker that runs several tasks keeps the words it has encoded."""

    def __init__(self, definition: str):
        self.definition = definition
        self.merges = Merges(definition)
        self._encoder: Encoder | None = None

    def encoder(self) -> Encoder:
        if self._encoder is None:
            self._encoder = Encoder(self.merges, self.definition)
        return self._encoder


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded)`` of every text with the tokenizer file at ``path``.

    ``ids`` are decimal numbers joined by one space. The tokenizer is read where the plan is
    made; its size does not depend on the data.
    """
    return docs.select("doc_id", _coder(docs, path, "n long, ids string, decoded string", lambda n, i, d: (n, i, d))(
        F.col("text")).alias("c")).select("doc_id", F.col("c.n").alias("n_tokens"), "c.ids", "c.decoded")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: the digests are taken where the row is."""

    def digest(n: int, ids: str, decoded: str) -> tuple:
        return n, sha256(ids.encode()).hexdigest(), sha256(decoded.encode()).hexdigest()

    coded = _coder(docs, path, "n long, ids string, decoded string", digest)(F.col("text"))
    return docs.select("doc_id", coded.alias("c")).select(
        "doc_id", F.col("c.n").alias("n_tokens"), F.col("c.ids").alias("ids_sha256"),
        F.col("c.decoded").alias("decoded_sha256"),
    )


def _coder(docs: DataFrame, path: str, schema: str, finish):
    spark = docs.sparkSession
    small_batches(spark)
    with open(path, encoding="utf-8") as file:
        definition = file.read()
    sent = share(spark, Shared(definition))

    @F.pandas_udf(schema)
    def code(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = shared(sent).encoder()
        for texts in batches:
            whole = list(as_bytes(texts))
            rows = []
            for block in grouped(whole, map(len, whole), _BLOCK):
                rows += [finish(*found) for found in encoder.documents(block)]
            frame = pd.DataFrame(rows, columns=["n", "ids", "decoded"])
            yield frame.astype({"n": np.int64})

    return code
