"""Held-out test items that leak into documents, whole or in part.

A random walk in the manner of CGK turns a window of words into a string in
which few edits change few places: at every step the walk emits the word it
stands on, and a random bit of step and word says whether it moves on. Bit
sampling hashes a few of the places; equal hashes of a document's window and
an item's make the two a candidate. The walks are repeated until a leak in
which ``EDITED`` of the words are changed is met with the recall asked for,
measured on the items themselves. Items too short for a window are looked up
by all their word pairs.

Each candidate is verified exactly: bounds that no leak falls under, then an
alignment of the item with the document.
"""

from __future__ import annotations

import math
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The share of an item's wording that a document has to carry.
CARRIED = 0.5
#: Items in one index; of more items several indexes are made, and so many of them
#: are held against the documents in one scan.
BLOCK, AT_ONCE = 4096, 16
#: A new passage costs as many matched words; a passage has at least one more.
JUMP = 4
#: Words a walk may read, and steps of which it is sampled; the first one always is.
#: A leak of half an item may stand in passages, so windows have the size of one
#: passage and stand at every word of an item, not at its first alone.
WINDOW, STEPS, SAMPLED = 10, 10, 4
#: How likely a walk moves on from a word.
MOVES = 0.8
#: Items of fewer words are looked up by all their pairs.
SHORT = 30
#: Walks are repeated until so many leaks are met in which this share of the words is changed.
RECALL, EDITED = 0.999, 0.3
MOST_WALKS, TRIALS, SEED = 64, 2000, 20240229
#: As many times the walks that the trials need are made, for leaks unlike the trials.
SPARE = 2
#: Words of documents that are looked up at once.
CHUNK = 200_000
#: A word pair's steps from word to word, in the document and in the item.
PAIRS = ((1, 1), (1, 2), (2, 1))
GAP = 2

_JOINED = re.compile(r"(?<=\w)[-­‐‑⁃]\s*(?=\w)|[­​-‏⁠﻿]|(?<=\d)[.,  ](?=\d)|['’`´](?=\w)")
_WORD = re.compile(r"[^\W_]+")
_FOLDED = (("æ", "ae"), ("ø", "o"), ("å", "a"), ("ä", "a"), ("ö", "o"), ("é", "e"), ("ô", "o"), ("è", "e"), ("ß", "ss"), ("đ", "d"), ("ł", "l"))


def words(text: str) -> list[str]:
    """Words without case, accents, hyphens, typography and the marks inside numbers."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).casefold()
        for a, b in _FOLDED:
            if a in text:
                text = text.replace(a, b)
        if not text.isascii() and any(unicodedata.category(c) != "Po" and ord(c) > 0x2FF or 0xC0 <= ord(c) for c in set(text)):
            text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    else:
        text = text.lower()
    return _WORD.findall(_JOINED.sub("", text))


def jump(m: int) -> int:
    """``JUMP``, or what half of an item of ``m`` words can still pay."""
    return min(JUMP, math.ceil(CARRIED * m) - 1)


def _spread(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges ``left`` to ``right``, and which range each is of."""
    many = right - left
    ends = np.cumsum(many)
    of = np.repeat(np.arange(len(many)), many)
    return np.repeat(left - (ends - many), many) + np.arange(len(of)), of


class Walk:
    """One random walk over windows of words, and the places of it that are sampled."""

    def __init__(self, rng: np.random.Generator, words: int):
        self.moves = rng.random((STEPS, words)) < MOVES
        self.sampled = [0, *np.sort(rng.choice(np.arange(1, STEPS), SAMPLED - 1, replace=False))]
        self.mixers = rng.integers(1, 2**62, SAMPLED, dtype=np.int64) | 1

    def hash(self, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows, by their first words, whose sampled words are all known, and their hashes."""
        at, pointer = starts, starts
        key = np.zeros(len(at), dtype=np.int64)
        k = 0
        with np.errstate(over="ignore"):
            for step in range(STEPS):
                here = flat[pointer]
                if self.sampled[k] == step:
                    kept = np.flatnonzero(here)
                    if len(kept) < len(here):
                        at, pointer, key, here = at[kept], pointer[kept], key[kept], here[kept]
                    key = (key + here) * self.mixers[k]
                    key ^= key >> 29
                    k += 1
                    if k == SAMPLED:
                        break
                pointer = pointer + self.moves[step][here]
        return at, key


class Index:
    """The hashes of one block of items, and all that a worker needs to look for them."""

    def __init__(self, items: list[tuple[int, str]], recall: float = RECALL):
        texts = {item: words(text or "") for item, text in items}
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for t in texts.values() for w in t}))}
        self.items = {item: np.array([self.vocabulary[w] for w in t], dtype=np.int32) for item, t in texts.items() if t}
        self.names = np.array(list(self.items), dtype=np.int64)
        self.wanted = list(self.items.values())
        self.lengths = np.array([len(t) for t in self.wanted], dtype=np.int64)
        self.jumps = np.array([jump(len(t)) for t in self.wanted], dtype=np.int64)
        self.local = np.zeros(len(self.vocabulary) + 1, dtype=np.int32)
        self.pairs = self._all_pairs()
        self.walks = self._walks(recall)
        flat = self._joined(self.wanted)
        long = np.concatenate([np.full(n + WINDOW, n >= SHORT) for n in self.lengths] or [np.zeros(WINDOW, dtype=bool)]) & (flat > 0)
        owner = np.repeat(np.arange(len(self.wanted)), self.lengths + WINDOW)
        self.keys = []
        for walk in self.walks:
            at, key = walk.hash(flat, np.flatnonzero(long))
            order = np.lexsort((owner[at], key))
            key, of = key[order], owner[at[order]]
            once = np.ones(len(key), dtype=bool)
            once[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
            self.keys.append((key[once], of[once]))
        self.bits = max(16, int(np.ceil(np.log2(1 + max((len(k) for k, _ in self.keys), default=1)))) + 5)
        self.filters = []
        for key, _ in self.keys:
            maybe = np.zeros(1 << self.bits, dtype=bool)
            maybe[key & ((1 << self.bits) - 1)] = True
            self.filters.append(maybe)

    def _walks(self, recall: float) -> list[Walk]:
        """As many walks as meet ``recall`` of trial leaks: items in which ``EDITED`` of the words are others, and halves of items in passages.

        A leak is met if one of its windows has the hash of one of its item's.
        """
        rng, kinds = np.random.default_rng(SEED), 4
        long = [t for t in self.wanted if len(t) >= SHORT]
        if not long:
            return []
        trials, unknown = [], len(self.vocabulary) + 1
        for n in range(TRIALS):
            item = long[n // 4 % len(long)]
            size, kind = len(item), n % 4
            if kind < 2:  # edits spread evenly leave no long passage, those at random may
                leak = item.copy()
                edits = np.arange(int(EDITED * size)) / EDITED + rng.integers(0, 3) if kind == 0 else rng.permutation(size)[: int(EDITED * size)]
                leak[np.minimum(edits.astype(np.int64), size - 1)] = unknown
            else:  # half of it in a few passages; or all, and edited besides
                parts = int(rng.integers(1, max(1, min(4, -(-size * 13 // 25) // (jump(size) + 1))) + 1))
                each, other = -(-size * (13 if kind == 2 else 25) // (25 * parts)), np.full(WINDOW, unknown, dtype=np.int32)
                leak = item.copy()
                if kind == 3:
                    leak[rng.permutation(size)[: int(EDITED * size * 2 / 3)]] = unknown
                leak = np.concatenate([x for k in range(parts) for x in (leak[size * k // parts :][:each], other)])
            trials.append((item, leak, kind))
        walks, open_ = [], list(range(TRIALS))
        gap = np.zeros(WINDOW, dtype=np.int32)
        allowed = [(1 - recall) * sum(kind == k for *_, kind in trials) for k in range(kinds)]
        while any(sum(trials[n][2] == k for n in open_) > allowed[k] for k in range(kinds)) and len(walks) < MOST_WALKS:
            walk = Walk(rng, unknown + 1)
            walks.append(walk)
            still = []
            for n in open_:
                item, leak = (np.concatenate([t, gap]) for t in trials[n][:2])
                mine, its = (walk.hash(t, np.flatnonzero(t))[1] for t in (item, leak))
                if not np.isin(its, mine).any():
                    still.append(n)
            open_ = still
        return walks + [Walk(rng, unknown + 1) for _ in range((SPARE - 1) * len(walks))]

    def _all_pairs(self) -> list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """The word pairs of the short items: steps in the document and in the item, keys, items and places."""
        flat = self._joined(self.wanted)
        owner = np.repeat(np.arange(len(self.wanted)), self.lengths + WINDOW)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(self.lengths + WINDOW) - self.lengths - WINDOW, self.lengths + WINDOW)
        out = []
        for near, step in (*PAIRS, (0, 0)):
            at, key = self._pairs(flat, step)
            # A passage of a single word has no pair.
            kept = self.jumps[owner[at]] == 0 if not step else self.lengths[owner[at]] < SHORT
            at, key = at[kept], key[kept]
            order = np.argsort(key, kind="stable")
            out.append((near, step, key[order], owner[at[order]], place[at[order]]))
        return out

    @staticmethod
    def _joined(texts: list[np.ndarray]) -> np.ndarray:
        gap = np.zeros(WINDOW, dtype=np.int32)
        return np.concatenate([x for t in texts for x in (t, gap)] or [gap])

    def _pairs(self, flat: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Where two known words stand ``step`` apart, and the pair as a number."""
        first, second = flat[: len(flat) - step], flat[step:]
        at = np.flatnonzero((first > 0) & (second > 0))
        return at, first[at].astype(np.int64) * (len(self.vocabulary) + 2) + second[at]

    def colliding(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(place, item number)`` of the windows of ``flat`` that have a window's hash of a longer item, and of the word pairs of a short one."""
        places, owners = [], []
        starts = np.flatnonzero(flat)
        for walk, maybe, (keys, owner) in zip(self.walks, self.filters, self.keys):
            at, key = walk.hash(flat, starts)
            kept = np.flatnonzero(maybe[key & ((1 << self.bits) - 1)])
            at, key = at[kept], key[kept]
            left, right = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            entry, of = _spread(left, right)
            places.append(at[of])
            owners.append(owner[entry])
        for near, _, keys, owner, _ in self.pairs:
            if len(keys):
                at, key = self._pairs(flat, near)
                left, right = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                entry, of = _spread(left, right)
                places.append(at[of])
                owners.append(owner[entry])
        none = np.zeros(0, dtype=np.int64)
        return np.concatenate(places or [none]), np.concatenate(owners or [none])

    def candidates(self, documents: list[np.ndarray]):
        """``(document number, item number, document places of hits)`` where the item may be carried.

        What collides is held against bounds that no leak falls under: half of
        the item's words stand in the document; its word pairs there (two
        words side by side, or one word apart, as in the item) are as many,
        and on as many words, as the least passage has; and half of its words
        stand near these, in its order.
        """
        flat, many = self._joined(documents), len(self.wanted)
        begins = np.cumsum([0] + [len(d) + WINDOW for d in documents])
        place, owner = self.colliding(flat)
        kind = np.unique((np.searchsorted(begins, place, "right") - 1) * many + owner)
        for number, mine in _by_document(kind, kind // many):
            document = documents[number]
            present = np.zeros(len(self.local), dtype=bool)
            present[document] = True
            item = mine % many
            sizes = self.lengths[item]
            shared = np.add.reduceat(present[np.concatenate([self.wanted[i] for i in item])].astype(np.int64), np.cumsum(sizes) - sizes)
            for i, most in zip(item, shared):
                if most >= CARRIED * self.lengths[i]:
                    hits = self._hits(self.wanted[i], document, int(most))
                    if hits is not None:
                        yield number, int(i), hits

    def _hits(self, item: np.ndarray, document: np.ndarray, most: int) -> np.ndarray | None:
        """The places of the item's word pairs in the document that a passage can hold; null if no leak can.

        A passage that is worth its jump has one word more than the jump, a
        skipped word costs a half, and two skipped words between matched ones
        use up what the next matched one earns; so it holds as many pairs as
        the jump costs, on one word more.
        """
        least, own = jump(len(item)), np.unique(item, return_counts=True)
        many = len(own[0]) + 1
        self.local[own[0]] = np.arange(1, many)
        codes, mine = self.local[document], self.local[item].astype(np.int64)
        self.local[own[0]] = 0
        at = np.flatnonzero(codes)
        codes = codes[at].astype(np.int64)
        if least == 0:
            return at if len(at) else None
        # Of each pair of words its item places, one step apart and two.
        paired = [mine[: len(mine) - step] * many + mine[step:] for step in (1, 2)]
        known = [np.zeros(many * many, dtype=bool) for _ in paired]
        for table, keys in zip(known, paired):
            table[keys] = True
        gap = np.diff(at)
        beside, apart = np.flatnonzero(gap <= 2), np.flatnonzero(gap[1:] + gap[:-1] == 2)
        first, second = np.concatenate([beside, apart]), np.concatenate([beside + 1, apart + 2])
        key, side = codes[first] * many + codes[second], at[second] - at[first] == 1
        hit = known[0][key] | (side & known[1][key])
        hits = np.unique(at[first[hit]])
        if hit.sum() < least:
            return None
        met = np.zeros(many * many, dtype=bool)
        met[key[hit]] = True
        covered = np.zeros(len(item), dtype=bool)
        for step, keys in zip((1, 2), paired):
            of = np.flatnonzero(met[keys])
            covered[of] = covered[of + step] = True
        if covered.sum() <= least:
            return None
        return self._near(item, own, at, codes, hits, most, least)

    @staticmethod
    def _near(item: np.ndarray, own, at: np.ndarray, codes: np.ndarray, hits: np.ndarray, most: int, least: int) -> np.ndarray | None:
        """The hits that a passage can hold; null if the words near them aren't half of the item.

        A passage of at most ``most`` words skips fewer than twice those that
        are left when its jump is paid, which bounds its reach.
        """
        while True:
            before = len(hits), most
            reach = most + 2 * (most - least)
            if least > 1:
                if len(hits) < least:
                    return None
                close = np.flatnonzero(hits[least - 1 :] - hits[: len(hits) - least + 1] <= reach)
                hits = hits[np.unique(close[:, None] + np.arange(least))]
            if not len(hits):
                return None
            after = np.searchsorted(hits, at)
            inside = np.minimum(np.abs(at - hits[np.maximum(after - 1, 0)]), np.abs(hits[np.minimum(after, len(hits) - 1)] - at)) <= reach
            most = int(np.minimum(np.bincount(codes[inside], minlength=len(own[0]) + 1)[1:], own[1]).sum())
            if most < CARRIED * len(item):
                return None
            if (len(hits), most) == before:
                return hits if _in_order(own[0], item, codes[inside]) >= CARRIED * len(item) else None

    def leaks(self, documents: list[list[int]]):
        """``(document number, item, share carried)`` of all leaks in the documents, given as word ids."""
        begin = 0
        while self.wanted and begin < len(documents):
            end, total = begin, 0
            while end < len(documents) and (end == begin or total + len(documents[end]) <= CHUNK):
                total += len(documents[end])
                end += 1
            arrays = [np.array(d, dtype=np.int32) for d in documents[begin:end]]
            for number, item, hits in self.candidates(arrays):
                share = carried(self.wanted[item], arrays[number], hits)
                if share >= CARRIED:
                    yield begin + number, int(self.names[item]), share
            begin = end


def _in_order(own: np.ndarray, item: np.ndarray, codes: np.ndarray) -> int:
    """How many of the item's words stand in its order, bit by bit; ``codes`` number the words in ``own`` from 1."""
    places = [0] * (len(own) + 1)
    for i, code in enumerate((np.searchsorted(own, item) + 1).tolist()):
        places[code] |= 1 << i
    every = (1 << len(item)) - 1
    row = every
    for code in codes.tolist():
        met = row & places[code]
        row = ((row + met) | (row - met)) & every
    return len(item) - row.bit_count()


def _by_document(chosen: np.ndarray, number: np.ndarray):
    """``(document number, those of chosen that are its)``, ``number`` being sorted."""
    cuts = np.flatnonzero(np.diff(number)) + 1
    for mine in np.split(np.arange(len(chosen)), cuts):
        if len(mine):
            yield int(number[mine[0]]), chosen[mine]


def carried(item: np.ndarray, document: np.ndarray, near: np.ndarray) -> float:
    """The share of the item's words that the document has in the item's order, in passages.

    An alignment in which a matched word earns one, a skipped or changed one
    costs a half on either side, and a new passage anywhere later costs
    ``jump``. Only the item's words within three times its length of a hit
    are aligned, which is all that a passage can reach.
    """
    m = len(item)
    paid = jump(m)
    kept = np.zeros(len(document) + 1, dtype=np.int32)
    np.add.at(kept, np.maximum(near - 3 * m, 0), 1)
    np.add.at(kept, np.minimum(near + 3 * m + GAP, len(document)), -1)
    at = np.flatnonzero(np.cumsum(kept[:-1]) > 0)
    at = at[np.isin(document[at], item)]
    text = document[at]
    n = len(text)
    if n == 0:
        return 0.0
    low = -1e9
    cost = 0.5 * at
    after = np.concatenate(([0], cost[:-1] + 0.5))  # the cost at the word behind the one before
    row = np.full(n, low)  # the best score of a chain whose last word matched is at this item word or before, ending here
    count = np.zeros(n, dtype=np.int32)
    best, most = np.zeros(n + 1), np.zeros(n + 1, dtype=np.int32)  # the best chain that ends before this word
    for i in range(m):
        near_row = row - 0.5
        before = np.concatenate(([low], near_row[:-1]))
        gap = np.maximum.accumulate(before + after)
        index = np.maximum.accumulate(np.where(before + after >= gap, np.arange(n), 0))
        close, close_count = gap - cost, np.concatenate(([0], count[:-1]))[index]
        new = best[:-1] - paid
        fresh = new > close + 0.5
        score = np.where(fresh, new, np.minimum(close + 0.5, low * -1)) + 1
        counted = np.where(fresh, most[:-1], close_count) + 1
        match = text == item[i]
        row, count = np.where(match, score, near_row), np.where(match, counted, count)
        if match.any():
            ends = np.where(match, score, low)
            top = np.maximum.accumulate(ends)
            at = np.maximum.accumulate(np.where(ends >= top, np.arange(n), 0))
            better = top > best[1:]
            best[1:] = np.where(better, top, best[1:])
            most[1:] = np.where(better, counted[at], most[1:])
    return float(most[-1]) / m


def find_leaks(documents: DataFrame, items: DataFrame, block: int = BLOCK, recall: float = RECALL) -> DataFrame:
    """``doc_id, item_id, share``: the documents that carry at least half of an item.

    * ``recall`` is the share of leaks with ``EDITED`` of their words changed
      that the walks have to meet; less changed ones are met more surely.

    * Every document is compared with every item, in blocks of ``block``
      items, ``AT_ONCE`` blocks a scan; only items, a stated set of queries,
      are sent to the workers, never anything of the documents. There is no
      shuffle.
    * Null and empty texts, and texts without a word, leak nothing. Copies of
      a document come out one by one; ids are taken to be unique.
    * Texts are read whole, however long.
    """
    spark = documents.sparkSession
    texts = items.where("item_id is not null and text is not null").select("item_id", "text")
    blocks = max(1, math.ceil(texts.count() / block))
    out = None
    for begin in range(0, blocks, AT_ONCE):
        shared = []
        for b in range(begin, min(begin + AT_ONCE, blocks)):
            rows = texts.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
            shared.append(spark.sparkContext.broadcast(Index([(r.item_id, r.text) for r in sorted(rows)], recall)))

        def compare(batches, shared=shared):
            for frame in batches:
                frame = frame[frame["text"].notna()]
                keys, read = frame["doc_id"].tolist(), [words(t) for t in frame["text"]]
                got = []
                for index in (s.value for s in shared):
                    if index.items:
                        known = index.vocabulary.get
                        got += index.leaks([[known(w, 0) for w in t] for t in read])
                yield pd.DataFrame({"doc_id": [keys[n] for n, _, _ in got], "item_id": [i for _, i, _ in got], "share": [s for _, _, s in got]}).astype({"doc_id": "int64", "item_id": "int64", "share": "float64"})

        part = documents.select("doc_id", "text").where("doc_id is not null and text is not null").mapInPandas(compare, "doc_id long, item_id long, share double")
        out = part if out is None else out.unionByName(part)
    return out
