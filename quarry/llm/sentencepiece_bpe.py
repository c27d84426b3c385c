"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding."""

from __future__ import annotations

import heapq
from collections import Counter, deque
from collections.abc import Iterator
from itertools import chain, islice, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import give_back, mix64, small_batches

SPACE = "▁"
#: Segmentations remembered in a worker until all are forgotten, of words not longer than LONG_WORD.
REMEMBERED, LONG_WORD = 200_000, 48
#: Texts that a worker is given at a time, and characters of them that it encodes together (or one longer text).
BATCH, TOGETHER = 256, 3 << 19
#: Occurrences that are looked up together, that draw side by side, and words that merge side by side.
WORDS, RUN, SIDE_BY_SIDE = 400_000, 50_000, 20_000
#: Marks, by hash, of words that have come up: a word is remembered from its second time on.
MET = 1 << 22
NONE = float("-inf")
_K1, _K2, _K3 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93
#: Pairs of symbols are keyed by left * _PAIR + right; code points beyond the ids stay below it.
_BITS = 21
_PAIR = 1 << _BITS


def load_pieces(model_path: str) -> tuple[dict[str, tuple[int, float]], list[int], list[bytes]]:
    """From a BPE model with byte fallback: piece -> (id, score), ids of the 256 bytes, and what
    each id stands for. Read on the driver; a vocabulary is of fixed size."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces, byte_ids, surface = {}, [0] * 256, []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            surface.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            surface.append(b"")
        else:
            pieces[piece] = (i, model.get_score(i))
            surface.append(piece.replace(SPACE, " ").encode())
    if any(a != SPACE and b == SPACE for p in pieces for a, b in zip(p, p[1:], strict=False)) or any("\n" in p for p in pieces):
        raise ValueError("a piece reaches beyond a word; this encoder splits texts at spaces and line ends")
    return pieces, byte_ids, surface


def spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers begins[0], begins[0] + 1 and so on, sizes[0] of them, then those from begins[1] on."""
    ends = sizes.cumsum()
    return np.repeat(begins - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def split(texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """Words of texts with a space in front, and how many each text has: spaces and what follows them
    up to the next space or line end. Line ends are words of their own."""
    parts = [(" " + t).encode() if t else b"" for t in texts]
    whole = b"".join(parts)
    ends = np.cumsum([0, *map(len, parts)])
    letters = np.frombuffer(whole, np.uint8)
    space, line = letters == 32, letters == 10
    starts = line.copy()
    starts[1:] |= line[:-1] | (space[1:] & ~space[:-1])
    starts[ends[:-1][np.diff(ends) > 0]] = True
    places = np.append(np.nonzero(starts)[0], len(letters))
    words = pa.LargeStringArray.from_buffers(len(places) - 1, pa.py_buffer(places), pa.py_buffer(whole))
    return words, np.diff(np.searchsorted(places[:-1], ends))


class Rows:
    """Rows of unlike length, one after another in one array that grows by doubling."""

    def __init__(self, *kinds: type):
        self.columns = [np.empty(1 << 16, k) for k in kinds]
        self.ends, self.n = np.zeros(1 << 14, np.int64), 0

    def add(self, sizes: np.ndarray, *columns: np.ndarray | int) -> np.ndarray:
        """The numbers of the rows added."""
        first, last = self.n, self.n + len(sizes)
        low = self.ends[first]
        high = low + int(sizes.sum())
        if last + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(last + 1, np.int64)])
        self.ends[first + 1 : last + 1] = low + sizes.cumsum()
        for i, values in enumerate(columns):
            if high > len(self.columns[i]):
                self.columns[i] = np.concatenate([self.columns[i], np.empty(high, self.columns[i].dtype)])
            self.columns[i][low:high] = values
        self.n = last
        return np.arange(first, last)

    def sizes(self, rows: np.ndarray) -> np.ndarray:
        return self.ends[rows + 1] - self.ends[rows]

    def places(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Where the values of these rows, which may repeat, stand in the columns."""
        return spread(self.ends[rows], sizes)


class Encoder:
    """Encodes words by agenda: the adjacent pair whose merged piece scores best goes first, the
    leftmost of equals. A pair that comes up is skipped when the hash of the occurrence's key and the pair's
    place falls below the dropout; symbols left without a piece become their bytes.

    What a word becomes if some pairs are skipped is a node. A node has ids and its merges in their
    order (start * 64 + length); each merge knows the node that follows if it is skipped too. Nodes are
    made for what comes up again: an occurrence whose word or skip is new is encoded with its own draws."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], dropout: float, seed: int):
        self.ids, self.byte_ids = {p: i for p, (i, _) in pieces.items()}, byte_ids
        self.scores = {p: s for p, (_, s) in pieces.items()}
        self.limit, self.seed = int(dropout * 2**32), seed
        self.size = max(self.ids.values(), default=0) + 1
        # at -1, which stands for no piece, there is no score
        self.piece_scores, self.lengths = np.full(self.size + 1, NONE, np.float32), np.zeros(self.size + 1, np.int64)
        #: Key of a pair and, in the last bits, the piece it makes.
        self.slots = np.full(1 << 20, -1, np.int64)
        # a symbol without a piece is its code beyond all ids: no pair has it; a literal U+2581 is one
        self.symbols = np.arange(0x110000, dtype=np.int32) + self.size
        for p, (i, score) in pieces.items():
            self.piece_scores[i], self.lengths[i] = score, len(p)
            if len(p) == 1:
                self.symbols[32 if p == SPACE else ord(p)] = i
            for cut in range(1, len(p)):
                a, b = self.ids.get(p[:cut]), self.ids.get(p[cut:])
                if a is not None and b is not None:
                    slot = (((a * _PAIR + b) * _K1) & 0xFFFFFFFFFFFFFFFF) >> 44
                    while self.slots[slot] >= 0:
                        slot = (slot + 1) % len(self.slots)
                    self.slots[slot] = (a * _PAIR + b) * _PAIR + i
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.met = np.zeros(MET, bool)
        #: Of each word: its symbols, and the piece that each makes with the next (or -1).
        self.words, self.nodes = Rows(np.int32, np.int32), Rows(np.int32)
        #: Of each merge: place in the hash, start and length, node, and the node after it (-1: never
        #: asked for, -2: asked for once).
        self.merges = Rows(np.uint64, np.int64, np.int32, np.int32)
        #: Of each node: its word, the node it comes from and the merge skipped there.
        self.origin = Rows(np.int64, np.int64, np.int64)

    def word(self, chunk: str, key: int = 0) -> bytes:
        """The ids of one occurrence of a word, as packed 32-bit integers."""
        # a literal U+2581 is no space: it takes a name that no piece has, and ends as bytes
        symbols = [SPACE if c == " " else "\0" + c if c == SPACE else c for c in chunk]
        out: list[int] = []
        for s in self.by_heap(symbols, key):
            at = self.ids.get(s)
            out += [at] if at is not None else [self.byte_ids[b] for b in (SPACE if s == "\0" + SPACE else s).encode("utf-8", "surrogatepass")]
        return np.array(out, np.int32).tobytes()

    def skips(self, key: int, start: int, length: int) -> bool:
        draw = (key + start * _K1 + length * _K2) & 0xFFFFFFFFFFFFFFFF
        return ((((draw ^ (draw >> 31)) * _K3) & 0xFFFFFFFFFFFFFFFF) >> 32) < self.limit

    def encode_many(self, chunks: list[str], keys: int | np.ndarray) -> list[bytes]:
        """word() for many occurrences."""
        ids, sizes = self.encode_run(pa.array(chunks, pa.large_string()), np.broadcast_to(np.asarray(keys, np.uint64), len(chunks)))
        packed, ends = ids.tobytes(), (4 * sizes.cumsum()).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode_run(self, chunks: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many occurrences in a row, and how many each has. Occurrences of a word that skip
        the same pairs share a node, and new nodes are encoded side by side. Each round finds the first
        merge that an occurrence skips; one that no other asks for goes its own way."""
        if self.nodes.n > REMEMBERED:
            self.forget()
        coded = chunks.dictionary_encode()
        words, which = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        node = self._look_up(words, np.bincount(which, minlength=len(words)))[which]
        heaped, fresh, rows = (np.nonzero(a)[0] for a in (node == -2, node == -1, node >= 0))
        alone = [rows[:0]]
        while self.limit and len(rows):
            rows, turns = self._first_skips(rows, node[rows], keys)
            child = self.merges.columns[3][turns]
            lacking, asked = np.unique(turns[child < 0], return_counts=True)
            again = (asked > 1) | (self.merges.columns[3][lacking] == -2)
            self.merges.columns[3][lacking[~again]] = -2
            if again.any():
                self._follow(lacking[again])
            child = self.merges.columns[3][turns]
            alone.append(rows[child < 0])
            rows = rows[child >= 0]
            node[rows] = child[child >= 0]
        lone = np.concatenate(alone)
        own = self.origin.columns[0][node[lone]]
        node[lone] = -1
        shared = np.nonzero(node >= 0)[0]
        n_own = self.words.sizes(own)
        symbols, pairs, n_new = self._spell([words[i] for i in which[fresh].tolist()])
        symbols, pairs = (np.concatenate([a, c[self.words.places(own, n_own)]]) for a, c in zip((symbols, pairs), self.words.columns, strict=True))
        single = np.concatenate([fresh, lone])
        done = [(single[at], *found) for at, found in self._drawn(symbols, pairs, np.concatenate([n_new, n_own]), keys[single])]
        n_shared = self.nodes.sizes(node[shared])
        done.append((shared, self.nodes.columns[0][self.nodes.places(node[shared], n_shared)], n_shared))
        if len(heaped):
            ids = [np.frombuffer(self.word(words[which[i]], int(keys[i])), np.int32) for i in heaped.tolist()]
            done.append((heaped, np.concatenate(ids), np.array([len(i) for i in ids])))
        sizes = np.zeros(len(which), np.int64)
        for at, _, n_ids in done:
            sizes[at] = n_ids
        begins = sizes.cumsum() - sizes
        out = np.empty(int(sizes.sum()), np.int32)
        for at, ids, n_ids in done:
            out[spread(begins[at], n_ids)] = ids
        return out, sizes

    def _look_up(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Nodes of distinct words in which nothing is skipped; -1 where a word comes up for the first
        time, and once only, -2 where it is long."""
        node = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.nonzero(node < 0)[0]
        named = [words[i] for i in new.tolist()]
        bits = np.fromiter(map(hash, named), np.int64, len(named)) % MET
        again = (counts[new] > 1) | self.met[bits]
        self.met[bits] = True
        long = np.fromiter(map(len, named), np.int64, len(named)) > LONG_WORD
        node[new[long]] = -2
        learnt = new[again & ~long]
        node[learnt] = self._learn([words[i] for i in learnt.tolist()])
        return node

    def _first_skips(self, rows: np.ndarray, node: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of these rows at their nodes those that skip a merge, and the first that each skips."""
        found: list[tuple[np.ndarray, np.ndarray]] = [(rows[:0], rows[:0])]
        for i in range(0, len(rows), RUN):
            part, at = rows[i : i + RUN], node[i : i + RUN]
            sizes = self.merges.sizes(at)
            places = self.merges.places(at, sizes)
            hit = np.nonzero(self._skipped(np.repeat(keys[part], sizes), self.merges.columns[0][places]))[0]
            row = np.searchsorted(sizes.cumsum(), hit, side="right")
            first = np.diff(row, prepend=-1) > 0
            found.append((part[row[first]], places[hit[first]]))
        return np.concatenate([r for r, _ in found]), np.concatenate([t for _, t in found])

    def _skipped(self, draw: np.ndarray, places: np.ndarray) -> np.ndarray:
        """skips() of many keys, which are overwritten, and places in the hash."""
        if not self.limit:
            return np.zeros(len(draw), bool)
        with np.errstate(over="ignore"):
            draw += places
            draw ^= draw >> np.uint64(31)
            draw *= np.uint64(_K3)
        return draw <= np.uint64((self.limit << 32) - 1)

    def _spell(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of words, the piece that each makes with the next of its word, and lengths of the words."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.symbols[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        pairs = np.full(len(symbols), -1, np.int32)
        inner = np.ones(len(symbols), bool)
        inner[sizes.cumsum() - 1] = False
        left = np.nonzero(inner)[0]
        pairs[left] = self._pair(symbols[left].astype(np.int64), symbols[left + 1].astype(np.int64))
        return symbols, pairs, sizes

    def _learn(self, new: list[str]) -> np.ndarray:
        """Nodes for words in which nothing is skipped."""
        symbols, pairs, sizes = self._spell(new)
        words = self.words.add(sizes, symbols, pairs)
        node = self._add(words, np.zeros((len(words), 0), np.int64), -1, -1)
        self.known.update(zip(new, node.tolist(), strict=True))
        return node

    def _follow(self, turns: np.ndarray) -> None:
        """The nodes after these merges, if they are skipped; all of them skip equally many."""
        _, merge, owner, _ = self.merges.columns
        parents, last = owner[turns].astype(np.int64), merge[turns]
        word, parent, skipped = self.origin.columns
        lasts, up = [last], parents
        while parent[up[0]] >= 0:
            lasts.append(skipped[up])
            up = parent[up]
        nodes = self._add(word[parents], np.stack(lasts, axis=1), parents, last)
        self.merges.columns[3][turns] = nodes

    def _add(self, words: np.ndarray, skipped: np.ndarray, parents: np.ndarray | int, last: np.ndarray | int) -> np.ndarray:
        out = np.empty(len(words), np.int64)
        sizes = self.words.sizes(words)
        parents, last = np.broadcast_to(parents, len(words)), np.broadcast_to(last, len(words))
        for at in self._alike(sizes):
            places = self.words.places(words[at], sizes[at])
            (ids, n_ids), merges, n_merges = self._side_by_side(*(c[places] for c in self.words.columns), sizes[at], skipped[at], None)
            out[at] = nodes = self.nodes.add(n_ids, ids)
            self.merges.add(n_merges, self._places(merges >> 6, merges & 63), merges, np.repeat(nodes, n_merges), -1)
            self.origin.add(np.ones(len(at), np.int64), words[at], parents[at], last[at])
        return out

    def _drawn(self, symbols: np.ndarray, pairs: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]]:
        """Numbers of some of the words and their ids, each with the draws of its key."""
        begins = sizes.cumsum() - sizes
        for at in self._alike(sizes):
            places = spread(begins[at], sizes[at])
            yield at, self._side_by_side(symbols[places], pairs[places], sizes[at], None, keys[at])[0]

    def _alike(self, sizes: np.ndarray) -> Iterator[np.ndarray]:
        """Numbers of words of like length, not too many at a time."""
        for low, high in ((0, 6), (6, 8), (8, 10), (10, 13), (13, 18), (18, LONG_WORD)):
            at = np.nonzero((sizes > low) & (sizes <= high))[0]
            for i in range(0, len(at), SIDE_BY_SIDE):
                yield at[i : i + SIDE_BY_SIDE]

    def _places(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return start.astype(np.uint64) * np.uint64(_K1) + length.astype(np.uint64) * np.uint64(_K2)

    def _side_by_side(self, own: np.ndarray, pairs: np.ndarray, sizes: np.ndarray, skipped: np.ndarray | None, keys: np.ndarray | None) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
        """Ids, with their number by word, of words given by their symbols and pairs, and the merges they
        take. What does not merge is in a word's row of `skipped`, or follows from the draws of its key;
        then no merges are noted. Symbols are addressed by row * width + place."""
        n, width = len(sizes), int(sizes.max())
        begins = np.arange(n) * width
        at = spread(begins, sizes)
        living = np.zeros(n * width, bool)
        living[at] = True
        symbols, merged = np.zeros(n * width, np.int64), np.full(n * width, -1, np.int64)
        symbols[at], merged[at] = own, pairs
        after, before = np.arange(1, n * width + 1), np.arange(-1, n * width - 1)
        after[begins + sizes - 1] = before[begins] = -1
        scores = self.piece_scores[merged]
        best = scores.reshape(n, width)
        rows = np.arange(n)
        done: list[tuple[np.ndarray, np.ndarray]] = [(rows[:0], rows[:0])]
        while len(rows):
            k = best.take(rows, axis=0).argmax(axis=1)
            f = rows * width + k
            open_ = scores[f] > NONE
            rows, k, f = rows[open_], k[open_], f[open_]
            length, r = self.lengths[merged[f]], rows
            if keys is None:
                pair = k * 64 + length
                goes = (skipped[rows] != pair[:, None]).all(axis=1) if skipped.shape[1] else None
            else:
                goes = ~self._skipped(keys[rows], self._places(k, length)) if self.limit else None
            if goes is not None:
                scores[f[~goes]] = NONE
                r, f = rows[goes], f[goes]
            if keys is None:
                done.append((r, pair if goes is None else pair[goes]))
            g = after[f]
            symbols[f] = merged[f]
            living[g] = False
            scores[f] = scores[g] = NONE
            following, leading = after[g], before[f]
            after[f] = following
            has, led = following >= 0, leading >= 0
            following, leading = following[has], leading[led]
            before[following] = f[has]
            left, right = np.concatenate([f[has], leading]), np.concatenate([following, f[led]])
            merged[left] = found = self._pair(symbols[left], symbols[right])
            scores[left] = self.piece_scores[found]
        owner = np.concatenate([r for r, _ in done])
        merges = np.concatenate([m for _, m in done])[np.argsort(owner, kind="stable")]
        return self._in_bytes(symbols[living], living.reshape(n, width).sum(axis=1)), merges, np.bincount(owner, minlength=n)

    def _in_bytes(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols by word, those without a piece as the ids of their bytes."""
        odd = np.nonzero(symbols >= self.size)[0]
        if not len(odd):
            return symbols, sizes
        signs, which = np.unique(symbols[odd], return_inverse=True)
        spelt = [[self.byte_ids[b] for b in chr(c - self.size).encode()] for c in signs.tolist()]
        n_bytes = np.array([len(s) for s in spelt])
        widths = np.ones(len(symbols), np.int64)
        widths[odd] = n_bytes[which]
        ends = widths.cumsum()
        out = np.repeat(symbols, widths)
        out[spread(ends[odd] - widths[odd], widths[odd])] = np.concatenate(spelt)[spread((n_bytes.cumsum() - n_bytes)[which], widths[odd])]
        return out, np.diff(ends[sizes.cumsum() - 1], prepend=0)

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that two adjacent symbols make, or -1."""
        key = a * _PAIR + b
        with np.errstate(over="ignore"):
            slot = ((key.view(np.uint64) * np.uint64(_K1)) >> np.uint64(44)).view(np.int64)
        seen = self.slots[slot]
        hit = seen >> _BITS == key
        out = np.where(hit, seen & (_PAIR - 1), -1)
        left = np.nonzero((seen >= 0) & ~hit)[0]
        while len(left):
            slot[left] = (slot[left] + 1) % len(self.slots)
            seen = self.slots[slot[left]]
            hit = seen >> _BITS == key[left]
            out[left[hit]] = seen[hit] & (_PAIR - 1)
            left = left[~hit & (seen >= 0)]
        return out

    def by_heap(self, symbols: list[str], key: int) -> list[str]:
        """The symbols of a word of any length, by a heap and linked symbols."""
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[float, int, int, str]] = []

        def propose(i: int, j: int) -> None:
            merged = symbols[i] + symbols[j]
            best = self.scores.get(merged)
            if best is not None:
                heapq.heappush(agenda, (-best, i, j, merged))

        for i in range(n - 1):
            propose(i, i + 1)
        while agenda:
            _, i, j, merged = heapq.heappop(agenda)
            if after[i] != j or not symbols[i] or symbols[i] + symbols[j] != merged:
                continue
            if self.limit and self.skips(key, i, len(merged)):
                continue
            symbols[i], symbols[j] = merged, ""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                propose(i, after[j])
            if before[i] >= 0:
                propose(before[i], i)
        return [s for s in symbols if s]

    def texts(self, texts: list[str | None], doc_keys: list[int]) -> list[np.ndarray | None]:
        """Ids of whole texts. The key of an occurrence is the hash of seed, doc_key and its number in
        the text, so each occurrence of a word has draws of its own."""
        words, counts = split(texts)
        drawn = self._keys(counts, doc_keys)
        runs = [self.encode_run(words.slice(i, WORDS), drawn[i : i + WORDS]) for i in range(0, len(words), WORDS)]
        ids = np.concatenate([np.empty(0, np.int32), *[r[0] for r in runs]])
        tokens = np.concatenate([np.zeros(1, np.int64), *[r[1] for r in runs]]).cumsum()
        ends = tokens[np.cumsum([0, *counts.tolist()])].tolist()
        return [None if t is None else ids[a:b] for t, a, b in zip(texts, ends, ends[1:], strict=False)]

    def _keys(self, counts: int | np.ndarray, doc_keys: int | list[int]) -> np.ndarray:
        """Keys of so many occurrences of each doc_key."""
        counts = np.atleast_1d(counts)
        start = [(k * _K1 + self.seed) & 0xFFFFFFFFFFFFFFFF for k in (doc_keys if isinstance(doc_keys, list) else [doc_keys])]
        number = spread(np.zeros(len(counts), np.int64), counts).astype(np.uint64)
        with np.errstate(over="ignore"):
            return mix64(number + np.repeat(mix64(np.array(start, np.uint64), 7), counts), 11)


def together(batches: Iterator[tuple], characters: int) -> Iterator[list[tuple]]:
    """Batches, whose last column is texts, in lists of at least so many characters (the last may have fewer)."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += sum(map(len, filter(None, batch[-1])))
        if size >= characters:
            yield held
            held, size = [], 0
    if held:
        yield held


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(vocabulary: tuple, dropout: float, seed: int) -> Encoder:
    """The encoder of this worker process: the words it has met stay known to its next tasks."""
    key = (len(vocabulary[0]), hash(tuple(vocabulary[0].items())), dropout, seed)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(*vocabulary, dropout, seed)
    return _ENCODERS[key]


def _let_go() -> None:
    """A worker's own dictionary is cleared by name: functions that Spark ships bring copies of what they mention."""
    _ENCODERS.clear()


def encode(docs: DataFrame, model_path: str, dropout: float = 0.1, seed: int = 0, copies: bool = False, turns: bool = False) -> DataFrame:
    """docs with ids (array<int>) and n_tokens of each whole text.

    A null text has null ids and no tokens, an empty one an empty list. The same seed, doc_id and text
    give the same ids in every run, and repeated rows agree. With copies, rows of one doc_id and text are numbered
    (column `copy`, from 1) and have draws by their number: the first those of a single row, the others
    their own. Such rows meet in one task, so that neither files nor partitions change what they get. Dropout 0
    gives the model's own segmentation (a literal U+2581 apart, which stays itself here). Null doc_ids count as
    one. Extra columns pass through; those named ids, n_tokens (and copy, with copies) are replaced. turns is another
    name of copies.
    """
    spark = docs.sparkSession
    small_batches(spark, BATCH)
    pieces, byte_ids, _ = load_pieces(model_path)
    shared = spark.sparkContext.broadcast((pieces, byte_ids))  # one vocabulary

    def drawn(batches: Iterator[tuple[list[int], list[int], list[str | None]]]) -> Iterator[pd.Series]:
        """Ids of batches of doc_ids, numbers of their copies and texts. Some are encoded together, but not with
        copies: in the pipeline the workers of earlier stages leave less memory. There the encoder goes with its task too,
        as an executor keeps more workers than it has tasks, takes them in turn and hands them on to other stages."""
        encoder = _encoder(shared.value, dropout, seed)
        for held in together(batches, 0 if copies or turns else TOGETHER):
            keys, numbers, texts = (list(chain.from_iterable(c)) for c in zip(*held, strict=True))
            ids = iter(encoder.texts(texts, [k + (n - 1) * _K2 for k, n in zip(keys, numbers, strict=True)]))
            yield from (pd.Series(list(islice(ids, len(batch[0]))), dtype=object) for batch in held)
        if copies or turns:
            del encoder
            _let_go()
        give_back()

    @F.pandas_udf("array<int>")
    def encoded(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        yield from drawn((keys.tolist(), [1] * len(keys), texts.tolist()) for keys, texts in batches)

    @F.pandas_udf("ids array<int>, copy long")
    def numbered(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        seen: Counter[tuple[int, int]] = Counter()  # how often a row has come up in this task
        given: deque[list[int]] = deque()  # of batches that are not encoded yet

        def count() -> Iterator[tuple[list[int], list[int], list[str | None]]]:
            for keys, hashes, texts in batches:
                numbers = []
                for row in zip(keys.tolist(), hashes.tolist(), strict=True):
                    seen[row] += 1
                    numbers.append(seen[row])
                given.append(numbers)
                yield keys.tolist(), numbers, texts.tolist()

        for ids in drawn(count()):
            yield pd.DataFrame({"ids": ids, "copy": given.popleft()})

    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))
    if copies or turns:
        # the hash deals; one function numbers and encodes, so that a task needs one Python worker
        hashed = F.xxhash64("text")
        both = docs.repartition(key, hashed).withColumn("ids", numbered.asNondeterministic()(key, hashed, "text"))
        out = both.withColumn("copy", F.col("ids.copy")).withColumn("ids", F.col("ids.ids"))
    else:
        out = docs.withColumn("ids", encoded(key, "text"))
    return out.withColumn("n_tokens", F.when(F.col("ids").isNull(), 0).otherwise(F.size("ids")).cast("long"))


def spelt_out(surface: pa.Array, lists: list[np.ndarray | None]) -> list[str | None]:
    """What lists of ids stand for, without the space in front."""
    ids = np.concatenate([np.empty(0, np.int32), *[r for r in lists if r is not None]])
    _, ends, letters = surface.take(pa.array(ids)).buffers()
    counts = np.array([0, *[0 if r is None else len(r) for r in lists]])
    places = np.frombuffer(ends, np.int64)[counts.cumsum()].tolist() if len(ids) else [0] * len(counts)
    view = memoryview(letters or b"")
    return [None if r is None else str(view[a:b], "utf-8", "replace")[1:] for r, a, b in zip(lists, places, places[1:], strict=False)]


def decode(tokens: DataFrame, model_path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """tokens with the text that each list of ids stands for; null for null, empty for empty."""
    small_batches(tokens.sparkSession)
    shared = tokens.sparkSession.sparkContext.broadcast(load_pieces(model_path)[2])

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        surface = pa.array(shared.value, pa.large_binary())
        for rows in batches:
            yield pd.Series(spelt_out(surface, rows.tolist()), dtype=object)

    return tokens.withColumn(name, decoded(ids))
