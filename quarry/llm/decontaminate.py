"""Benchmark decontamination by CGK embeddings and bit-sampling LSH over item-sized windows.

The embedding of Chakraborty, Goldenberg and Koucky (2016) walks over a string:
step j emits the current character and advances by a random bit that depends on
j and on the character. Two strings at a small edit distance soon walk in step
again after each edit, so their embeddings differ in few places (Hamming
distance). Here a window is embedded in pieces that begin at its words, so that
walks are in step again at every word that is left, and the pieces' distances
add up. A key samples some places of the pieces of a few words in a row; keys
are taken at every word of an item, hence over its whole length, and at every
word of the documents. Many keys are drawn; those that text has often by chance
are left out as far as edited copies of the items, the evenly spaced edits that
are worst for it among them, still reach the target recall. Hits are verified
by the exact edit distance between the item and the best-matching passage, in
characters, over all text that a passage within the bound can reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import NO_ID, flat_bytes, marked, slices, stored, tidy
from quarry.llm.words import ALNUM, word_spans

#: Steps of a piece (it covers about half as many bytes) and sampled places, walks to choose pieces from, and keys by words.
STEPS, PLACES, WALKS, KEYS = 6, 2, 48, {4: 40, 3: 8}
WORDS = max(KEYS)
#: Steps of a walk that goes on from the first word, by size class (bytes of the item, down to a power of two): for items
#: that the keys above don't find well enough, as those of one or two words.
LONG_STEPS, LONG_KEYS = {1: 1, 2: 2, 4: 3, 8: 6, 16: 12, 32: 18, 64: 21, 128: 24}, 24
#: Steps that are looked up at once, by as many bytes; walks that start together stay in the processor's cache.
LEAP, STARTS = 3, 1 << 15
#: Walks see a byte as one of 32 letters: a-z apart, others by their last bits. Equal texts walk alike all the same.
LETTER = np.where(np.arange(256) == 32, 0, np.arange(256) & 31).astype(np.uint16)
#: Share of edited copies at the bound, of each kind of edits, that the keys of a size class find; copies of each kind.
TARGET, COPIES = 0.96, 200
#: Chances of a key in text from which the least is taken that reaches TARGET; an item keeps its rarest eighth in any case.
CHANCES = (1e-7, 2e-7, 5e-7, 1e-6, 2e-6, 5e-6, 1e-5, 2e-5, 5e-5, 1e-4, 1e-3, 1.0)
FILTER_BITS = 18
#: Characters of an item compared at once, a bit each; candidates compared at once.
BLOCK, AT_ONCE = 60, 1 << 18


@dataclass
class Key:
    """The walks of its pieces, by their numbers, and the sorted keys of the items that use it."""

    walks: tuple[int, ...]
    mask: np.ndarray  # 2^FILTER_BITS: whether some item key has these leading bits
    keys: np.ndarray
    runs: np.ndarray  # how many keys equal it, at the first of equal keys
    owners: np.ndarray  # (item, characters of the item before the start)


@dataclass
class Items:
    ids: list[list[int | None]]  # by text: the items that have it
    joined: list[str]
    codes: list[np.ndarray]  # by item: a number under 64 for each character
    walks: list[list[np.ndarray]]  # each by LEAP steps and the letters at hand: a number for what is emitted, its last two bits the advance
    keys: list[Key]


def normalized(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words in lower case with a space after each, then spaces that walks can run into; and where each word starts."""
    size = end - begin
    letters = ALNUM[raw]
    letters = letters[letters != 0]
    first = np.cumsum(size + 1) - size - 1
    out = np.full(int(size.sum()) + len(size) + max(LONG_STEPS.values()) + 1, 32, np.uint8)
    out[np.arange(len(letters)) + np.repeat(np.arange(len(size)), size)] = letters
    return out, first


def _joined(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Normalized texts one after the other, where each begins and the last ends, and each without its last space."""
    raw = np.frombuffer(b"".join(data), np.uint8)
    begin, end, n = word_spans(raw, np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64))
    flat, first = normalized(raw, begin, end)
    edges = np.append(first, int((end - begin).sum()) + len(begin))[np.concatenate([[0], np.cumsum(n)])]
    whole = flat.tobytes()
    return flat, edges, [whole[a : max(a, b - 1)].decode(errors="replace") for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False)]


def _codes(flat: np.ndarray) -> np.ndarray:
    """A number under 64 for each character."""
    lead = np.flatnonzero((flat & 0xC0) != 0x80)
    out = flat[lead]
    for k, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
        long = np.flatnonzero(flat[lead] >= least)
        out[long] ^= flat.take(lead[long] + k, mode="clip") * np.uint8(2 * k - 1)
    return out & np.uint8(63)


def _starts(flat: np.ndarray, length: int) -> np.ndarray:
    """Where walks begin: at words, and at each character of scripts that write without spaces."""
    here = flat[:length] >= 0xE0
    here[:1] = True
    here[1:] |= flat[: max(length - 1, 0)] == 32
    return np.flatnonzero(here)


def triples(flat: np.ndarray) -> np.ndarray:
    """At each byte, the letters of it and the two behind it, in one number."""
    x = LETTER[flat]
    out = x << 10
    out[:-1] |= x[1:] << 5
    out[:-2] |= x[2:]
    return out


def walk(letters: np.ndarray, start: np.ndarray, leaps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of what the walks from each start emit at the sampled places, and where the walks end. letters: see triples."""
    return walk_on(letters, start, letters.take(start, mode="clip"), leaps)


def walk_on(letters: np.ndarray, start: np.ndarray, here: np.ndarray, leaps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """walk, with the letters at the starts given."""
    at, h = start, np.zeros(len(start), np.uint32)
    for j, leap in enumerate(leaps):
        v = leap.take(letters.take(at, mode="clip") if j else here)
        at = at + (v & np.uint32(3))
        h += v >> np.uint32(2)  # what unsampled places do to the way is no part of the key
        h *= np.uint32(0x9E3779B1)
    return h, at


def joined_pieces(pieces: list[np.ndarray]) -> np.ndarray:
    """Keys from pieces: the first of one start, the second of the next start, and so on; of as many starts as have all."""
    n = max(0, len(pieces[0]) - len(pieces) + 1)
    h = pieces[0][:n].copy()
    for j, piece in enumerate(pieces[1:], 1):
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        h += piece[j : j + n]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    return h


def _random_walk(steps: int, k: int, seed: int, places: int = 0) -> list[np.ndarray]:
    """Coins and sampled places of a walk, composed to leaps. Without a number of places, one in each two steps."""
    rng = np.random.default_rng((seed, steps, k))
    edges = np.linspace(0, steps, max(1, (steps + 1) // 2) + 1).astype(int)
    # One place in each stretch: neighbouring steps often emit the same character.
    sampled = rng.choice(steps, places, replace=False).tolist() if places else [int(rng.integers(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    coins, names = rng.integers(0, 2, (steps, 32)), rng.integers(0, 1 << 32, (steps, 32), np.uint32)
    seen = np.arange(1 << 15)
    ahead = np.stack([seen >> 10, seen >> 5 & 31, seen & 31])
    leaps = []
    for first in range(0, steps, LEAP):
        at, h = np.zeros(len(seen), np.int64), np.zeros(len(seen), np.uint32)
        for j in range(first, min(first + LEAP, steps)):
            letter = ahead[at, seen]
            if j in sampled:
                h = (h ^ names[j, letter]) * np.uint32(0x85EBCA6B)
            at += coins[j, letter]
        leaps.append(h & ~np.uint32(3) | at.astype(np.uint32))
    return leaps


def edited(text: str, edits: int, rng: np.random.Generator, alphabet: str) -> str:
    """A copy with so many characters replaced, put in or taken out, at random."""
    out = list(text)
    for kind, c in zip(rng.integers(0, 3, edits).tolist(), rng.integers(0, len(alphabet), edits).tolist(), strict=True):
        at = int(rng.integers(0, len(out) + (kind == 1))) if out else 0
        out[at : at + (kind != 1)] = [alphabet[c]] if kind < 2 else []
    return "".join(out)


def evenly_edited(text: str, every: int, most: int, kind: int, rng: np.random.Generator, alphabet: str) -> str:
    """A copy whose every so many characters one is replaced, put in or taken out (kind 0, 1, 2), from a random place on, most of them at most."""
    first = int(rng.integers(0, every))
    out = []
    for i, c in enumerate(text):
        hit = i % every == first and i // every < most
        new = alphabet[int(rng.integers(0, len(alphabet)))] if hit and kind < 2 else ""
        out.append(c + new if not hit or kind == 1 else new)
    return "".join(out)


def _copies(texts: list[str], percent: int, rng: np.random.Generator) -> list[tuple[int, int, str]]:
    """(kind, text, copy): edits at the bound, at random, and evenly spaced at two densities and of three kinds."""
    alphabet = "".join(sorted({c for text in texts for c in text}))
    every = -(-100 // max(percent, 1))
    out = []
    for kind in range(7):
        for i in rng.permutation(len(texts))[np.arange(COPIES) % len(texts)].tolist():
            if kind == 6:
                copy = edited(texts[i], len(texts[i]) * percent // 100, rng, alphabet)
            else:
                copy = evenly_edited(texts[i], every + kind // 3, len(texts[i]) * percent // 100, kind % 3, rng, alphabet)
            out.append((kind, i, copy))
    return out


@dataclass
class _Text:
    """Texts one after the other, where walks begin in them and whose they are."""

    flat: np.ndarray
    edges: np.ndarray
    letters: np.ndarray
    start: np.ndarray
    owner: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> "_Text":
        flat, edges, _ = _joined([t.encode() for t in texts])
        start = _starts(flat, int(edges[-1]))
        return cls(flat, edges, triples(flat), start, np.searchsorted(edges, start, "right") - 1)

    def keyed(self, walks: list[list[np.ndarray]], seen: dict[int, tuple[np.ndarray, np.ndarray]], names: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the first starts, and which of them lie within one text (or end on the space after it)."""
        for w in names:
            if w not in seen:
                seen[w] = walk(self.letters, self.start, walks[w])
        h = joined_pieces([seen[w][0] for w in names])
        n = len(h)
        last = len(names) - 1
        inside = (self.owner[:n] == self.owner[last : last + n]) & (seen[names[-1]][1][last : last + n] <= self.edges[self.owner[:n] + 1])
        return h, inside


def _chances(seen: dict[int, tuple[np.ndarray, np.ndarray]], names: tuple[int, ...], n: int) -> np.ndarray:
    """How often text has each key by chance: the product of the shares of words with the same pieces."""
    out = np.zeros(n)
    for j, w in enumerate(names):
        values = seen[w][0]
        _, at, count = np.unique(values, return_inverse=True, return_counts=True)
        out += np.log(count / len(values))[at][j : j + n]
    return np.exp(out)


def _chosen(texts: list[str], walks: list[list[np.ndarray]], names: list[tuple[int, ...]], copies: list[tuple[int, int, str]], caught: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each of names, keys, owners and characters before the start of the items that use it; caught is set for the copies that they find."""
    mine, theirs = _Text.of(texts), _Text.of([c for _, _, c in copies])
    of = np.asarray([i for _, i, _ in copies])
    kind = np.asarray([k for k, _, _ in copies])
    seen, others = {}, {}
    parts, first = [], []
    for key in names:
        h, inside = mine.keyed(walks, seen, key)
        at = np.flatnonzero(inside)
        h, owner, chance = h[at], mine.owner[at], _chances(seen, key, len(inside))[at]
        parts.append((h, owner, mine.start[at], chance))
        # The least chance of a key of its item that a copy shares.
        other, within = theirs.keyed(walks, others, key)
        order = np.lexsort((chance, h, owner))
        ids = owner[order].astype(np.uint64) << np.uint64(32) | h[order]
        place = np.flatnonzero(within)
        wanted = of[theirs.owner[place]].astype(np.uint64) << np.uint64(32) | other[place]
        found = np.searchsorted(ids, wanted)
        hit = found < len(ids)
        hit[hit] = ids[found[hit]] == wanted[hit]
        first.append((theirs.owner[place[hit]], chance[order][found[hit]]))
    least = np.full(len(copies), np.inf)
    for copy, chance in first:
        np.minimum.at(least, copy, chance)
    open_ = ~caught
    limit = CHANCES[-1]
    for limit in CHANCES:
        if all((caught | (least <= limit))[kind == k].mean() >= TARGET for k in np.unique(kind)):
            break
    caught |= open_ & (least <= limit)
    least_kept = np.zeros(len(texts))
    every = np.concatenate([p[1] for p in parts])
    chances = np.concatenate([p[3] for p in parts])
    order = np.lexsort((chances, every))
    count = np.bincount(every, minlength=len(texts))
    begin = np.cumsum(count) - count
    some = count > 0
    least_kept[some] = chances[order][(begin + count // 8)[some]]
    chars = np.cumsum((mine.flat & 0xC0) != 0x80)
    out = []
    for h, owner, start, chance in parts:
        use = chance <= np.maximum(limit, least_kept[owner])
        out.append((h[use], owner[use], (chars[start] - chars[mine.edges[owner]])[use]))
    return out


def build(rows: list[tuple[int | None, str]], percent: int = 20, seed: int = 5) -> Items:
    """The index of a block of items; items without words match nothing, items with equal words are one."""
    _, _, every = _joined([text.encode() for _, text in rows])
    same: dict[str, list[int | None]] = {}
    for (i, _), text in zip(rows, every, strict=True):
        same.setdefault(text, []).append(i)
    joined = list(same)
    by_class: dict[int, list[int]] = {}
    for i, text in enumerate(joined):
        if text:
            by_class.setdefault(min(max(LONG_STEPS), 1 << (len(text.encode()).bit_length() - 1)), []).append(i)
    walks = [_random_walk(STEPS, k, seed, PLACES) for k in range(WALKS)]
    rng = np.random.default_rng(seed)
    names = [tuple(rng.choice(WALKS, words, replace=False).tolist()) for words, n in KEYS.items() for _ in range(n)]
    found: dict[tuple[int, ...], list[tuple[np.ndarray, np.ndarray]]] = {}
    numbers: dict[tuple[int, int], int] = {}
    for size, members in sorted(by_class.items()):
        texts = [joined[i] for i in members]
        copies = _copies(texts, percent, np.random.default_rng((seed, size)))
        kind = np.asarray([k for k, _, _ in copies])
        caught = np.zeros(len(copies), bool)
        used = list(names)
        parts = _chosen(texts, walks, names, copies, caught)
        # Items of few words have no key above, or not enough of them.
        starts = np.bincount(_Text.of(texts).owner, minlength=len(texts))
        if starts.min() < 2 * WORDS or any(caught[kind == k].mean() < TARGET for k in np.unique(kind)):
            long = []
            for k in range(LONG_KEYS):
                at = numbers.setdefault((LONG_STEPS[size], k), len(walks))
                if at == len(walks):
                    walks.append(_random_walk(LONG_STEPS[size], k, seed))
                long.append((at,))
            parts += _chosen(texts, walks, long, copies, caught)
            used += long
        for key, (h, owner, offset) in zip(used, parts, strict=True):
            found.setdefault(key, []).append((h, np.stack([np.asarray(members)[owner], offset], axis=1)))
    keys = []
    for name, parts in sorted(found.items()):
        h, owners = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        if not len(h):
            continue
        order, mask = np.argsort(h, kind="stable"), np.zeros(1 << FILTER_BITS, bool)
        mask[h >> np.uint32(32 - FILTER_BITS)] = True
        _, first, count = np.unique(h[order], return_index=True, return_counts=True)
        runs = np.zeros(len(h), np.int64)
        runs[first] = count
        keys.append(Key(name, mask, h[order], runs, owners[order]))
    return Items(list(same.values()), joined, [_codes(np.frombuffer(text.encode(), np.uint8)) for text in joined], walks, keys)


def _candidates(items: Items, flat: np.ndarray, length: int, edges: np.ndarray, percent: int) -> dict[int, list[tuple[int, int]]]:
    """By document: (item, stretch of as many characters as the item may have edits, in which it would begin) for the shared keys that may lead to a match."""
    start, letters = _starts(flat, length), triples(flat)
    chars = np.cumsum((flat & 0xC0) != 0x80)
    width = np.asarray([max(1, len(text) * percent // 100) for text in items.joined], np.int64)
    found = []
    for first in range(0, len(start), STARTS):
        here = start[first : first + STARTS + WORDS - 1]
        seen: dict[int, np.ndarray] = {}
        at_starts = letters.take(here)
        for key in items.keys:
            for w in key.walks:
                if w not in seen:
                    seen[w] = walk_on(letters, here, at_starts, items.walks[w])[0]
            h = joined_pieces([seen[w] for w in key.walks])[:STARTS]
            at = np.flatnonzero(key.mask.take(h >> np.uint32(32 - FILTER_BITS)))
            h = h[at]
            low = np.minimum(np.searchsorted(key.keys, h), len(key.keys) - 1)
            same = key.keys[low] == h
            at, low = at[same], low[same]
            n = key.runs[low]
            p = here[np.repeat(at, n)]
            item, offset = key.owners[np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)].T
            doc = np.searchsorted(edges, p, "right") - 1
            found.append(np.stack([doc, item, chars[p] - chars[edges[doc]] - offset, offset], axis=1))
    out: dict[int, list[tuple[int, int]]] = {}
    if found:
        rows = np.concatenate(found)
        rows = rows[np.lexsort(rows.T[::-1])]
        rows = rows[np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1))[: len(rows)]]
        codes = _codes(flat)
        for a in range(0, len(rows), AT_ONCE):
            some = rows[a : a + AT_ONCE]
            some = some[_near(items, codes, some[:, 1], chars[edges[some[:, 0]]] - 1 + some[:, 2], some[:, 3], percent)][:, :3]
            some[:, 2] //= width[some[:, 1]]
            for doc, item, place in np.unique(some, axis=0).tolist():
                if (item, place) not in out.setdefault(doc, []):
                    out[doc].append((item, place))
    return out


def least_distances(patterns: list[np.ndarray], pattern: np.ndarray, codes: np.ndarray, low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """By row: the smallest edit distance between a pattern of at most 64 codes and any part of codes[low : low + size]."""
    table = np.zeros((len(patterns), 64), np.uint64)
    lengths = np.asarray([len(x) for x in patterns], np.int64)
    owner = np.repeat(np.arange(len(patterns)), lengths)
    bit = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    np.bitwise_or.at(table, (owner, np.concatenate(patterns)), np.uint64(1) << bit.astype(np.uint64))
    order = np.argsort(-size, kind="stable")
    row, at, length = pattern[order] * 64, low[order], lengths[pattern[order]]
    active = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), "left")
    top, one, table = (length - 1).astype(np.uint64), np.uint64(1), table.ravel()
    up, down = np.full(len(row), ~np.uint64(0)), np.zeros(len(row), np.uint64)
    score, best = length.copy(), length.copy()
    for t, n in enumerate(active.tolist()):
        u, d = up[:n], down[:n]
        same = table.take(row[:n] + codes.take(at[:n] + t, mode="clip"))
        vertical = same | d
        horizontal = (((same & u) + u) ^ u) | same
        plus, minus = d | ~(horizontal | u), u & horizontal
        score[:n] += (plus >> top[:n] & one).astype(np.int64) - (minus >> top[:n] & one).astype(np.int64)
        np.minimum(best[:n], score[:n], out=best[:n])
        plus, minus = plus << one, minus << one
        up[:n], down[:n] = minus | ~(vertical | plus), plus & vertical
    out = np.empty_like(best)
    out[order] = best
    return out


def _near(items: Items, codes: np.ndarray, item: np.ndarray, begin: np.ndarray, offset: np.ndarray, percent: int) -> np.ndarray:
    """Which candidates may be within the bound: the distances of an item's blocks, each where it can lie, add up to no more.

    The block at offset, where the shared key lies, says least and comes last.
    Different characters may have equal codes and text beyond the document is
    compared too; both make the sum smaller only, so no match is lost.
    """
    left = np.arange(len(item))
    total = np.zeros(len(item), np.int64)
    length = np.asarray([len(x) for x in items.codes], np.int64)
    edits, blocks = length * percent // 100, -(-length // BLOCK)
    done = []
    most = int(blocks.max(initial=1))
    hit = np.minimum(offset * blocks[item] // np.maximum(1, length[item]), blocks[item] - 1)
    for j in range(int(blocks[item].max(initial=0))):
        last = blocks[item[left]] <= j
        done.append(left[last])
        left = left[~last]
        if not len(left):
            break
        here = (hit[left] + 1 + j) % blocks[item[left]]
        used, pattern = np.unique(item[left] * most + here, return_inverse=True)
        used, part = used // most, used % most
        a, b = length[used] * part // blocks[used], length[used] * (part + 1) // blocks[used]
        patterns = [items.codes[i][x:y] for i, x, y in zip(used.tolist(), a.tolist(), b.tolist(), strict=True)]
        k = edits[item[left]]
        low = begin[left] + a[pattern] - k
        size = (b - a)[pattern] + 2 * k + 1
        size += np.minimum(low, 0)
        total[left] += least_distances(patterns, pattern, codes, np.maximum(low, 0), np.maximum(size, 0))
        left = left[total[left] <= k]
    return np.sort(np.concatenate([*done, left]))


def best_passage(item: str, text: str) -> tuple[int, int, int]:
    """Smallest edit distance between item and any substring of text, and where that substring begins and ends."""

    def scan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        index = np.arange(len(b) + 1)
        row = np.zeros(len(b) + 1, np.int64)
        for i, c in enumerate(a, 1):
            step = np.empty_like(row)
            step[0] = i
            np.minimum(row[:-1] + (b != c), row[1:] + 1, out=step[1:])
            row = np.minimum.accumulate(step - index) + index
        return row

    a, b = (np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in (item, text))
    row = scan(a, b)
    end = int(row.argmin())
    back = scan(a[::-1], b[:end][::-1])
    reach = np.flatnonzero(back == row[end])
    return int(row[end]), end - int(reach[0]), end


def least_distance(item: str, text: str) -> int:
    """Smallest edit distance between item and any substring of text, by bit vectors over the item (Myers, 1999)."""
    m = len(item)
    if not m:
        return 0
    full, top, places = (1 << m) - 1, 1 << (m - 1), {}
    for i, c in enumerate(item):
        places[c] = places.get(c, 0) | 1 << i
    up, down, score = full, 0, m
    best = score
    for c in text:
        same = places.get(c, 0)
        vertical = same | down
        horizontal = (((same & up) + up) ^ up) | same
        plus = down | ~(horizontal | up) & full
        minus = up & horizontal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
            best = min(best, score)
        plus, minus = plus << 1 & full, minus << 1 & full
        up = minus | ~(vertical | plus) & full
        down = plus & vertical
    return best


def _verify(items: Items, found: list[tuple[int, int]], text: str, percent: int) -> dict[int, tuple[int, int, int]]:
    """{item: (distance, first word, last word)} of one document's passages within the bound; the closest, then the first."""
    out: dict[int, tuple[int, int, int]] = {}
    for item, place in found:
        joined = items.joined[item]
        edits = len(joined) * percent // 100
        width, best = max(1, edits), out.get(item)
        if best and best[0] == 0:
            continue
        # The item begins in this stretch if it has no edits before the shared key, else up to its edits to either side.
        low = max(0, place * width - edits)
        segment = text[low : max(0, (place + 1) * width + len(joined) + edits)]
        at = segment.find(joined)
        if at >= 0:
            distance, begin, end = 0, at, at + len(joined)
        else:
            least = least_distance(joined, segment) if edits else 1
            if least > edits or best and least >= best[0]:
                continue
            distance, begin, end = best_passage(joined, segment)
        out[item] = (distance, text.count(" ", 0, low + begin), 1 + text.count(" ", 0, low + max(begin, end - 1)))
    return out


MATCHES = "doc_id long, tid long, item_id long, distance long, item_chars long, start long, end long"


def _matches_of_block(docs: DataFrame, items: Items, percent: int, slice_bytes: int) -> DataFrame:
    """The matches of one block, stored; its index is freed in driver and executors before the next one is built."""
    shipped = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", slice_bytes):
                yield _found(shipped.value, part, percent)

    text = F.coalesce(F.col("text"), F.lit(""))
    out = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tid"), text.alias("text")).mapInArrow(tidy(run), MATCHES), "matches")
    shipped.unpersist(blocking=True)
    return out


def _found(items: Items, part: pa.RecordBatch, percent: int) -> pa.RecordBatch:
    raw, offsets = flat_bytes(part.column("text"))
    begin, end, n = word_spans(raw, offsets)
    flat, first = normalized(raw, begin, end)
    length = int((end - begin).sum()) + len(begin)
    word = np.cumsum(n) - n
    edges = np.append(first, length)[np.append(word, len(begin))]
    rows = []
    for d, found in _candidates(items, flat, length, edges, percent).items():
        a, low = int(word[d]), int(offsets[d])
        text = flat[edges[d] : edges[d + 1] - 1].tobytes().decode(errors="replace")
        doc_id, tid = part.column("doc_id")[d].as_py(), part.column("tid")[d].as_py()
        for item, (distance, b, e) in sorted(_verify(items, found, text, percent).items()):
            for item_id in items.ids[item]:
                rows.append((doc_id, tid, item_id, distance, len(items.joined[item]), int(begin[a + b]) - low, int(end[a + e - 1]) - low))
    columns = list(zip(*rows, strict=True)) or [()] * 7
    return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "tid", "item_id", "distance", "item_chars", "start", "end"])


def contaminated(
    docs: DataFrame, benchmark: DataFrame, percent: int = 20, block_items: int = 20_000, block_bytes: int = 1 << 24, slice_bytes: int = 1 << 21
) -> DataFrame:
    """A row for each document and benchmark item that it holds: the closest passage, in bytes of the text, and tid, a hash of the text.

    A passage holds an item if the edit distance of their words, joined by
    spaces, is at most percent of the item's characters. Documents aren't
    shuffled; items are searched in blocks of about block_items and
    block_bytes, one after the other, so what a task and the driver hold stays
    bounded. Null or empty texts and items without words match nothing; items
    with equal texts are found each, and a null item_id stays null; of passages
    at equal distance the first counts; repeated documents give a row each;
    empty tables give no rows; other columns are ignored.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // block_items), -(-(size["bytes"] or 0) // block_bytes))
    out = None
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        ordered = sorted(((r["item_id"], r["text"]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        part = _matches_of_block(docs, build(ordered, percent), percent, slice_bytes)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 20) -> DataFrame:
    """The rows of docs whose own text holds no benchmark item; see contaminated.

    Other rows of the same doc_id stay; rows that repeat both stay or go alike.
    Null and empty texts stay, and all rows do without items. Columns are those
    of docs, whatever their names; an empty table gives no rows.
    """
    hits = stored(contaminated(docs, benchmark, percent).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_doc"), F.col("tid").alias("_tid")).distinct(), "hits")
    return marked(docs).join(hits, ["_doc", "_tid"], "left_anti").select("_row.*")
