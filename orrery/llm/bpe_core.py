"""Byte-level BPE in numpy: vocabularies, pre-tokens and rank-synchronous merging.

Pre-tokens of a batch lie end to end in one array of symbols with the number
of the sequence each belongs to. In each round every sequence merges its
lowest-rank pair, all sequences at once, until no pair has a rank.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterable

import numpy as np

NONE = np.int64(2**62)


def byte_symbols() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for themselves, others follow from 256."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairTable:
    """Hash table in arrays: pair of symbols -> rank and merged symbol."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self.bits = max(8, int(np.ceil(np.log2(max(len(keys), 1) * 3))))
        size = 1 << self.bits
        self.keys = np.full(size, np.uint64(2**64 - 1))
        self.rank = np.full(size, NONE)
        self.merged = np.zeros(size, np.int64)
        left_over, step = np.arange(len(keys)), 0
        while len(left_over):
            at = (self.slot(keys[left_over]) + step) & (size - 1)
            free = self.keys[at] == np.uint64(2**64 - 1)
            _, first = np.unique(at, return_index=True)
            chosen = np.zeros(len(at), bool)
            chosen[first] = True
            chosen &= free
            done = left_over[chosen]
            self.keys[at[chosen]], self.rank[at[chosen]], self.merged[at[chosen]] = keys[done], rank[done], merged[done]
            left_over, step = left_over[~chosen], step + 1
        self.steps = step

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if there is none) and merged symbol of each pair."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = self.slot(keys)
        rank, merged = np.full(len(keys), NONE), np.zeros(len(keys), np.int64)
        todo, mask = np.arange(len(keys)), len(self.keys) - 1
        for _ in range(self.steps):
            held = self.keys[at]
            hit = held == keys[todo]
            rank[todo[hit]], merged[todo[hit]] = self.rank[at[hit]], self.merged[at[hit]]
            on = ~hit & (held != np.uint64(2**64 - 1))
            if not on.any():
                break
            todo, at = todo[on], (at[on] + 1) & mask
        return rank, merged


class Vocabulary:
    """Token bytes by id, the pair table and which merges may be done all at once."""

    def __init__(self, tokens: dict[bytes, int], pairs: list[tuple[bytes, bytes]] | None, whole: bool, special: dict[str, int] | None = None):
        """pairs: in rank order; None: any pair whose bytes are a token, ranked by its id. whole: a pre-token that is a token isn't merged."""
        self.special = special or {}
        size = max([*tokens.values(), *self.special.values()]) + 1
        parts = [b""] * size
        for token, i in tokens.items():
            parts[i] = token
        for token, i in self.special.items():
            parts[i] = token.encode()
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.of_byte = np.array([tokens[bytes([b])] for b in range(256)], np.int64)
        self.whole = dict(tokens) if whole else None
        left, right, rank, merged = [], [], [], []
        if pairs is None:
            for token, i in tokens.items():
                for k in range(1, len(token)):
                    a, b = tokens.get(token[:k]), tokens.get(token[k:])
                    if a is not None and b is not None:
                        left.append(a), right.append(b), rank.append(i), merged.append(i)
        else:
            for k, (a, b) in enumerate(pairs):
                left.append(tokens[a]), right.append(tokens[b]), rank.append(k), merged.append(tokens[a + b])
        left, right, rank, merged = (np.array(x, np.int64) for x in (left, right, rank, merged))
        self.pairs = PairTable(left, right, rank, merged)
        # A merge may be applied to all its places at once if no pair with its result ranks before it.
        least = np.full(size, NONE)
        np.minimum.at(least, left, rank)
        np.minimum.at(least, right, rank)
        at = np.full(int(rank.max(initial=0)) + 1, False)
        np.logical_or.at(at, rank, least[merged] < rank)
        self.one_by_one = at


def from_ranks(path: str) -> Vocabulary:
    """A .tiktoken file: lines of base64 bytes and rank."""
    with open(path, "rb") as f:
        tokens = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return Vocabulary(tokens, None, whole=True)


def from_json(path: str) -> Vocabulary:
    """A .json file of byte-level BPE with merges."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    to_byte = byte_symbols()
    raw = lambda s: bytes(to_byte[c] for c in s)
    special = {x["content"]: x["id"] for x in held["added_tokens"]}
    merges = [m if isinstance(m, list) else m.split(" ") for m in held["model"]["merges"]]
    tokens = {raw(k): v for k, v in held["model"]["vocab"].items() if k not in special}
    return Vocabulary(tokens, [(raw(a), raw(b)) for a, b in merges], whole=False, special=special)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of ranges laid end to end."""
    total = int(lengths.sum())
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) if len(lengths) else np.zeros(0, np.int64)
    return np.arange(total, dtype=np.int64) + shift


def merge(symbols: np.ndarray, lengths: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Surviving symbols and their number for each sequence; sequences lie end to end."""
    out = [None, lengths.astype(np.int64).copy()]
    n = len(lengths)
    seq = np.repeat(np.arange(n), lengths)
    done_symbols, done_seq = [], []
    pairs, slow = vocabulary.pairs, vocabulary.one_by_one
    while len(symbols) > 1:
        rank, merged = pairs.find(symbols[:-1], symbols[1:])
        rank[seq[:-1] != seq[1:]] = NONE
        # The first symbol of each sequence that is still here, and each one's lowest rank.
        first = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
        ranks = np.concatenate([rank, [NONE]])
        low = np.minimum.reduceat(ranks, first)
        size = np.diff(np.concatenate([first, [len(symbols)]]))
        of = np.repeat(low, size)
        at = np.flatnonzero((ranks == of) & (ranks != NONE))
        if len(at):
            # In a run of overlapping places every second one merges, from the left.
            starts = np.concatenate([[True], np.diff(at) != 1])
            run = np.cumsum(starts) - 1
            head = np.flatnonzero(starts)
            at = at[(np.arange(len(at)) - head[run]) % 2 == 0]
            careful = slow[ranks[at]]
            if careful.any():
                lead = np.concatenate([[True], seq[at[1:]] != seq[at[:-1]]])
                at = at[~careful | lead]
            symbols = symbols.copy()
            symbols[at] = merged[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
        else:
            keep = np.ones(len(symbols), bool)
        ended = np.repeat(low == NONE, size)
        if ended.any():
            done_symbols.append(symbols[ended]), done_seq.append(seq[ended])
            keep &= ~ended
        symbols, seq = symbols[keep], seq[keep]
    done_symbols.append(symbols), done_seq.append(seq)
    flat, owner = np.concatenate(done_symbols), np.concatenate(done_seq)
    order = np.argsort(owner, kind="stable")
    out[0], out[1] = flat[order], np.bincount(owner, minlength=n).astype(np.int64)
    return out[0], out[1]


def encode_words(words: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each pre-token, end to end, and their number."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    symbols = vocabulary.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
    if vocabulary.whole is None:
        return merge(symbols, lengths, vocabulary)
    known = np.fromiter((vocabulary.whole.get(r, -1) for r in raw), np.int64, len(raw))
    is_known = known >= 0
    sub, sub_n = merge(symbols[np.repeat(~is_known, lengths)], lengths[~is_known], vocabulary)
    counts = np.ones(len(raw), np.int64)
    counts[~is_known] = sub_n
    flat = np.empty(int(counts.sum()), np.int64)
    inside = np.repeat(is_known, counts)
    flat[inside], flat[~inside] = known[is_known], sub
    return flat, counts


def gathered(table: np.ndarray, starts: np.ndarray, lengths: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """Entries ``picks`` of a ragged table, end to end."""
    return table[ragged(starts[picks], lengths[picks])]


def decimals(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ragged table of ids as decimals with a comma after each."""
    parts = [b"%d," % i for i in range(size)]
    lengths = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64), lengths


def by_size(sizes: Iterable[int], most: int) -> list[tuple[int, int]]:
    """Ranges of consecutive items whose sizes add up to ``most`` or little more."""
    found, start, total, k = [], 0, 0, 0
    for k, n in enumerate(sizes, 1):
        total += n
        if total >= most:
            found.append((start, k))
            start, total = k, 0
    if k > start:
        found.append((start, k))
    return found
