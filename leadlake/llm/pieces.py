"""SentencePiece encoding with seeded merge-dropout, and decoding.

A text is cut into chunks at spaces, since no piece of the model has a space before its end. In a chunk the agenda holds
candidate merges by rank; each is skipped where a hash keyed by seed, row key, number of the chunk in its text, rank and
place says so. The draw is made anew for every occurrence of a word, so one word is segmented in varied yet repeatable
ways, always by merges that the model knows. Characters that the model lacks (and the space mark itself, if a text holds
it) become byte pieces, so that decoding gives the text back exactly.

A merge is known by its rank and place, that is, by a piece and where it stands in the word. So the pieces that stand
anywhere in a word are all its possible candidates, and which of them are dropped decides the segmentation: occurrences
of a word that drop the same ones are segmented once, side by side with others.

Defined results: null texts give null ids and null text; empty texts give no ids; repeated rows are encoded alike, since
the key of a row enters its draws; texts are encoded whole, whatever their length; an empty table gives an empty
table; other columns are neither read nor returned.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.llm.ship import map_arrow
from leadlake.llm.textbytes import flat, mix, prefix_hash, slices, span_hash

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words and segmentations kept in one Python worker.
KEPT = 400_000
#: Words of more characters, or with more possible candidates than bits in a number, are segmented at each occurrence.
LONG_WORD, MOST_CANDIDATES = 32, 64
#: Occurrences of words whose draws are made together.
DRAWN_TOGETHER = 1 << 16
#: Widths of the tables in which parts of words are merged side by side; longer parts are merged one by one.
WIDTHS = (4, 8, 16, 32, 64)
#: Bytes of the texts that are encoded together.
TOGETHER = 1 << 21
#: A symbol that nothing merges with, and a place whose symbol went into the one before it.
ALONE, GONE = -1, -2
NEVER = np.iinfo(np.int32).max
_SALTS = (0x9E3779B97F4A7C15, 0x85EBCA77C2B2AE63, 0xC2B2AE3D27D4EB4F)
_ALL_BITS = (1 << 64) - 1

_CHUNKS = re.compile(r" *[^ ]+| +")


class HashTable:
    """Whole numbers from 64-bit keys, looked up for many keys at a time (open addressing, a tenth full)."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        keys = np.asarray(keys).astype(np.uint64)
        self.shift = np.uint64(64 - max(10, (10 * len(keys)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.mask = size - 1
        self.keys, self.values = np.zeros(size, np.uint64), np.full(size, -1, np.int32)  # -1: an empty place
        at, left = self._first(keys), np.arange(len(keys))
        while len(left):
            free = left[self.values[at[left]] == -1]
            self.values[at[free]], self.keys[at[free]] = values[free], keys[free]  # of several keys for one place the last stays
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & self.mask

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(_SALTS[0]) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray, none: int = -1) -> np.ndarray:
        keys = np.ascontiguousarray(keys).view(np.uint64)
        at = self._first(keys)
        values = self.values[at]
        hit = self.keys[at] == keys
        found = np.where(hit & (values != -1), values, none)
        left = np.flatnonzero(~hit.ravel() & (values.ravel() != -1))
        if len(left):
            flat_keys, flat_at, flat_found = keys.ravel(), at.ravel(), found.ravel()
            while len(left):
                flat_at[left] = (flat_at[left] + 1) & self.mask
                values, hit = self.values[flat_at[left]], self.keys[flat_at[left]] == flat_keys[left]
                flat_found[left[hit & (values != -1)]] = values[hit & (values != -1)]
                left = left[~hit & (values != -1)]
            found = flat_found.reshape(found.shape)
        return found


class PieceModel:
    """Ranks and ids of a merge-type model, and segmentation by its merges."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.size = sp.get_piece_size()
        ids: dict[str, int] = {}
        self.byte_ids = np.zeros(256, np.int32)
        raw: list[bytes] = []
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                raw.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                raw.append(b"")
            else:
                ids[piece] = i
                raw.append(piece.replace(MARK, " ").encode())
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(r) for r in raw])
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size

        # symbols: the pieces, and characters that occur in pieces only
        symbols = dict(ids)
        for piece in ids:
            for c in piece:
                symbols.setdefault(c, size + len(symbols))
        self.n_symbols = size + len(symbols)
        self.symbol_of = np.full(0x110000, ALONE, np.int32)
        for c, i in symbols.items():
            if len(c) == 1:
                self.symbol_of[ord(" " if c == MARK else c)] = i
        self.symbol_of[ord(MARK)] = ALONE  # a mark that stands in a text
        by_rank = sorted(ids, key=lambda p: (-sp.get_score(ids[p]), ids[p]))
        self.id_of_rank = np.array([ids[p] for p in by_rank], np.int32)
        pairs, joined = {}, set()
        for rank, p in enumerate(by_rank):
            for i in range(1, len(p)):
                joined.add(symbols[p[i - 1]] * self.n_symbols + symbols[p[i]])
                if p[:i] in symbols and p[i:] in symbols:
                    pairs[symbols[p[:i]] * self.n_symbols + symbols[p[i:]]] = rank
        #: symbol pairs that merge, each with the rank of what it gives
        self.pairs = HashTable(np.array([*pairs], np.int64), np.array([*pairs.values()], np.int32))
        self.rank_of_pair = pairs
        #: neighbouring characters of any piece: between others no merge is possible
        self.joined = HashTable(np.array([*joined], np.int64), np.zeros(len(joined), np.int32))
        #: hashes of what pieces begin with, and the rank of those that are pieces
        spelt = [p.replace(MARK, " ") for p in by_rank]
        codes = np.frombuffer("".join(spelt).encode("utf-32-le"), np.uint32)
        sizes = np.array([len(p) for p in spelt])
        starts, self.longest, sums = np.cumsum(sizes) - sizes, int(sizes.max(initial=0)), prefix_hash(codes)
        begins: dict[int, int] = {}
        for n in range(2, self.longest + 1):
            some = np.flatnonzero(sizes >= n)
            for h, r in zip(span_hash(sums, starts[some], starts[some] + n).tolist(), np.where(sizes[some] == n, some, NEVER).tolist()):
                begins[h] = min(r, begins.get(h, NEVER))
        self.begins = HashTable(np.array([*begins], np.uint64), np.array([*begins.values()], np.int32))
        self.limit = 0
        self._forget()

    def _forget(self) -> None:
        """Words by hash; where the candidates of each begin, and their part of the draw; segmentations by word and dropped ones."""
        self.words, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes in order, and the word of each
        self.bounds, self.draws, self.apart = np.zeros(1, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
        self._forget_segments()

    def _forget_segments(self) -> None:
        self.kept = np.zeros(0, np.uint64)  # keys in order; the pieces of each are kept_ids[kept_start : + kept_size]
        self.kept_start, self.kept_size, self.kept_ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _learn(self, codes: np.ndarray, sizes: np.ndarray) -> None:
        """Number new words (characters of all, and how many each has) and list their possible candidates: the pieces of two
        characters or more in them."""
        ends, sums = np.cumsum(sizes), prefix_hash(codes)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        a, b, _ = (np.uint64(s) for s in _SALTS)
        at = np.flatnonzero(sizes[owner] <= LONG_WORD)
        owners, draws = [], []
        for n in range(2, self.longest + 1):
            at = at[at + n <= ends[owner[at]]]
            h = span_hash(sums, at, at + n)
            rank = self.begins.find(h)
            at, rank = at[rank != -1], rank[rank != -1]
            whole = at[rank != NEVER]
            place = whole - (ends - sizes)[owner[whole]]
            owners.append(owner[whole])
            draws.append(rank[rank != NEVER].astype(np.uint64) * a + place.astype(np.uint64) * b)
        owners, draws = np.concatenate(owners), np.concatenate(draws)
        count = np.bincount(owners, minlength=len(sizes))
        apart = (sizes > LONG_WORD) | (count > MOST_CANDIDATES)
        inside = ~apart[owners]
        order = np.argsort(owners[inside], kind="stable")
        self.draws = np.concatenate([self.draws, draws[inside][order]])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(np.where(apart, 0, count))])
        self.apart = np.concatenate([self.apart, apart])

    def _dropped(self, words: np.ndarray, salts: np.ndarray, limit: int) -> np.ndarray:
        """For occurrences of words, a bit for each possible candidate that the occurrence drops."""
        out, c = np.zeros(len(words), np.uint64), np.uint64(_SALTS[2])
        for i in range(0, len(words) if limit else 0, DRAWN_TOGETHER):
            some = slice(i, i + DRAWN_TOGETHER)
            first, count = self.bounds[words[some]], np.diff(self.bounds)[words[some]]
            begin = np.cumsum(count) - count
            nth = np.arange(count.sum()) - np.repeat(begin, count)
            drawn = (np.repeat(salts[some], count) ^ self.draws[np.repeat(first, count) + nth]) * c >> np.uint64(32)
            bits = (drawn < np.uint64(limit)).astype(np.uint64) << nth.astype(np.uint64)
            full = np.flatnonzero(count)
            if len(full):
                out[i + full] = np.bitwise_or.reduceat(bits, begin[full])
        return out

    def _key(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where((left < 0) | (right < 0), -1, left.astype(np.int64) * self.n_symbols + right)

    def _candidates(self, left: np.ndarray, right: np.ndarray, salt: np.ndarray, place: np.ndarray, limit: int) -> np.ndarray:
        """Ranks of candidate merges, ``NEVER`` where there is none or the hash of salt, rank and place drops it."""
        key = self._key(left, right)
        rank = self.pairs.find(key, NEVER)
        if limit:
            a, b, c = (np.uint64(s) for s in _SALTS)
            drawn = (salt ^ (rank.astype(np.uint64) * a + place.astype(np.uint64) * b)) * c >> np.uint64(32)
            rank[drawn < np.uint64(limit)] = NEVER
        return rank

    def segment(self, symbols: list[int], salt: int, limit: int, first: int = 0) -> list[int]:
        """Merge neighbours in order of rank (then place), skipping those that the hash drops; for parts of any length.
        ``first``: the place in its word at which the part begins."""
        n, size, ranks = len(symbols), self.n_symbols, self.rank_of_pair
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, int]] = []

        def offer(i: int, j: int) -> None:
            pair = symbols[i] * size + symbols[j]
            if symbols[i] >= 0 and symbols[j] >= 0 and (r := ranks.get(pair)) is not None:
                drawn = ((salt ^ (r * _SALTS[0] + (first + i) * _SALTS[1]) & _ALL_BITS) * _SALTS[2] & _ALL_BITS) >> 32
                if drawn >= limit:
                    heapq.heappush(agenda, (r, i, pair))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            r, i, pair = heapq.heappop(agenda)
            j = after[i]
            if symbols[i] < 0 or j >= n or symbols[i] * size + symbols[j] != pair:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = int(self.id_of_rank[r]), GONE
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                offer(i, k)
            if before[i] >= 0:
                offer(before[i], i)
        return symbols

    def _segment_rows(self, symbols: np.ndarray, salt: np.ndarray, limit: int, first: np.ndarray | None = None) -> np.ndarray:
        """:meth:`segment` for many short parts at a time: every round merges the first candidate of each row.

        Rows begin and end with a symbol that merges with nothing, so no place needs a test for the border.
        """
        n, width = symbols.shape
        column = np.arange(width)
        after, before = np.tile(column + 1, (n, 1)), np.tile(column - 1, (n, 1))
        rank = np.full((n, width), NEVER, np.int32)
        first = np.full(n, -1) if first is None else first - 1  # the place of column 0
        rank[:, :-1] = self._candidates(symbols[:, :-1], symbols[:, 1:], salt[:, None], first[:, None] + column[None, :-1], limit)
        rows = np.arange(n)
        while len(rows):
            i = rank[rows].argmin(1)
            r = rank[rows, i]
            live = r != NEVER
            rows, i, r = rows[live], i[live], r[live]
            j = after[rows, i]
            k, h = after[rows, j], before[rows, i]
            merged = self.id_of_rank[r]
            symbols[rows, i], symbols[rows, j] = merged, GONE
            after[rows, i], before[rows, k] = k, i
            rank[rows, j] = NEVER
            rank[rows, i] = self._candidates(merged, symbols[rows, k], salt[rows], first[rows] + i, limit)
            rank[rows, h] = self._candidates(symbols[rows, h], merged, salt[rows], first[rows] + h, limit)
        return symbols

    def segment_chunks(self, chunks: list[str], salts: np.ndarray, limit: int) -> list[bytes]:
        """Ids of chunks as 32-bit numbers."""
        codes = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)
        ids, sizes = self._segment_codes(codes, np.array([len(c) for c in chunks], np.int64), salts, limit)
        cuts = np.cumsum([0, *sizes.tolist()])
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]

    def _segment_codes(self, codes: np.ndarray, lengths: np.ndarray, salts: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks, and how many each has. ``codes``: the characters of the chunks, ``lengths``: how many each has. A chunk falls apart
        where no merge is possible; its parts are merged each alone, and what a part becomes hangs on its characters, its place
        in the chunk and the chunk's salt only."""
        heads = np.concatenate([[0], np.cumsum(lengths)])
        symbols = self.symbol_of[codes]
        apart = np.ones(len(codes), bool)
        apart[1:] = self.joined.find(self._key(symbols[:-1], symbols[1:])) == -1
        apart[heads[:-1]] = True
        starts = np.flatnonzero(apart)
        sizes = np.diff(starts, append=len(codes))
        owner = np.searchsorted(heads, starts, "right") - 1
        salts, firsts = salts[owner], starts - heads[owner]
        least = 1
        for width in WIDTHS:
            some = np.flatnonzero((sizes > least) & (sizes <= width))
            least = width
            place = np.arange(width)
            inside = place < sizes[some, None]
            where = np.where(inside, starts[some, None] + place, 0)
            rows = np.full((len(some), width + 2), ALONE, np.int32)
            rows[:, 1:-1] = np.where(inside, symbols[where], ALONE)
            symbols[where[inside]] = self._segment_rows(rows, salts[some], limit, firsts[some])[:, 1:-1][inside]
        for p in np.flatnonzero(sizes > least).tolist():
            span = slice(starts[p], starts[p] + sizes[p])
            symbols[span] = self.segment(symbols[span].tolist(), int(salts[p]), limit, int(firsts[p]))

        # one id for a piece, one for each byte of a character that is none
        other = np.flatnonzero((symbols == ALONE) | (symbols >= self.size))
        spelt = [chr(c).encode() for c in codes[other].tolist()]
        count = (symbols >= 0).astype(np.int64)
        count[other] = [len(s) for s in spelt]
        ends = np.cumsum(count)
        ids = np.zeros(ends[-1] if len(ends) else 0, np.int32)
        whole = (symbols >= 0) & (symbols < self.size)
        ids[ends[whole] - 1] = symbols[whole]
        if spelt:
            n = count[other]
            at = np.repeat(ends[other] - np.cumsum(n), n) + np.arange(n.sum())
            ids[at] = self.byte_ids[np.frombuffer(b"".join(spelt), np.uint8)]
        return ids, np.diff(np.concatenate([[0], ends])[heads])

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray, seed: int, dropout: float, keys: list) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each has. ``data`` and ``offsets``: their UTF-8 bytes. An empty text has none."""
        limit = int(dropout * (1 << 32))
        if limit != self.limit or len(self.apart) >= KEPT:
            self._forget()
            self.limit = limit
        if len(self.kept) >= KEPT:
            self._forget_segments()
        # each text with a space before it; a chunk begins with a space behind another character
        size = np.diff(offsets)
        full = np.flatnonzero(size)
        lead = np.cumsum(size[full]) - size[full] + np.arange(len(full))
        spaced = np.full(int(size.sum()) + len(full), 32, np.uint8)
        body = np.ones(len(spaced), bool)
        body[lead] = False
        spaced[body] = data
        blank = spaced == 32
        begin = blank.copy()
        begin[1:] &= ~blank[:-1]
        begin[lead] = True
        heads = np.flatnonzero(begin)
        stops = np.append(heads[1:], len(spaced))
        text = np.searchsorted(lead, heads, "right") - 1
        hashes = span_hash(prefix_hash(spaced), heads, stops)

        def characters(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The characters of some chunks, and how many each has."""
            n = stops[some] - heads[some]
            at = np.repeat(heads[some] - np.cumsum(n) + n, n) + np.arange(n.sum())
            raw = spaced[at]
            codes = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
            first = np.cumsum(n) - n
            return codes, np.add.reduceat((raw & 0xC0) != 0x80, first, dtype=np.int64) if len(some) else first

        different, place, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.words, different), max(len(self.words) - 1, 0))
        known = self.words[at] == different if len(self.words) else np.zeros(len(different), bool)
        base, number = len(self.apart), np.empty(len(different), np.int64)
        number[known] = self.number[at[known]]
        if not known.all():
            fresh = np.flatnonzero(~known)
            number[fresh] = base + np.arange(len(fresh))
            self._learn(*characters(place[fresh]))
            words, numbers = np.concatenate([self.words, different[fresh]]), np.concatenate([self.number, number[fresh]])
            order = np.argsort(words, kind="stable")
            self.words, self.number = words[order], numbers[order]
        words = number[back]

        bits = np.array([xxhash.xxh64_intdigest(str(keys[i]), seed & _ALL_BITS) if limit else 0 for i in full.tolist()], np.uint64)
        nth = np.arange(len(heads)) - np.searchsorted(text, np.arange(len(full)))[text]
        salts = mix(bits[text] + nth.astype(np.uint64) * np.uint64(_SALTS[0]))
        dropped = self._dropped(words, salts, limit)
        alone = self.apart[words] if limit else np.zeros(len(words), bool)  # words that stand for themselves at each occurrence
        dropped[alone] = np.flatnonzero(alone)
        name = mix(hashes ^ mix(mix(dropped) + alone.astype(np.uint64)))
        kinds, some, kind, often = np.unique(name, return_index=True, return_inverse=True, return_counts=True)
        at = np.minimum(np.searchsorted(self.kept, kinds), max(len(self.kept) - 1, 0))
        known = self.kept[at] == kinds if len(self.kept) else np.zeros(len(kinds), bool)
        start, count = np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.int64)
        start[known], count[known] = self.kept_start[at[known]], self.kept_size[at[known]]
        gaps, pool = np.flatnonzero(~known), self.kept_ids
        if len(gaps):
            ids, count[gaps] = self._segment_codes(*characters(some[gaps]), salts[some[gaps]], limit)
            start[gaps] = len(pool) + np.cumsum(count[gaps]) - count[gaps]
            pool = np.concatenate([pool, ids])
        n = count[kind]
        out = pool[np.repeat(start[kind] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        sizes = np.zeros(len(size), np.int64)
        if len(full):
            sizes[full] = np.add.reduceat(n, np.searchsorted(text, np.arange(len(full))))

        keep = gaps[(often[gaps] > 1) & ~alone[some[gaps]]]  # met more than once: kept
        if len(keep):
            n = count[keep]
            ids = pool[np.repeat(start[keep] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            begins = len(self.kept_ids) + np.cumsum(n) - n
            order = np.argsort(np.concatenate([self.kept, kinds[keep]]), kind="stable")
            self.kept = np.concatenate([self.kept, kinds[keep]])[order]
            self.kept_start, self.kept_size = np.concatenate([self.kept_start, begins])[order], np.concatenate([self.kept_size, n])[order]
            self.kept_ids = np.concatenate([self.kept_ids, ids])
        return out, sizes

    def encode_together(self, texts: list[str | None], seed: int = 0, dropout: float = 0.0, keys: list | None = None) -> list[bytes | None]:
        """The ids of texts as 32-bit numbers; segmentations not met before are made side by side."""
        data, offsets = flat(pa.array(texts, pa.string()))
        ids, sizes = self.encode_bytes(data, offsets, seed, dropout, keys or texts)
        cuts = np.cumsum([0, *sizes.tolist()])
        return [None if t is None else ids[a:b].tobytes() for t, a, b in zip(texts, cuts, cuts[1:])]

    def encode(self, text: str, seed: int = 0, dropout: float = 0.0, key: object = None) -> bytes:
        return self.encode_together([text], seed, dropout, [key])[0]

    def decode(self, ids: bytes) -> str:
        return self.decode_bytes(np.frombuffer(ids, np.int32)).tobytes()[1:].decode()

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of pieces one behind the other; a text has a space before it."""
        sizes = self.raw_size[ids]
        return self.raw[np.repeat(self.raw_start[ids] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]

    def same_texts(self, ids: np.ndarray, sizes: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts their ids decode to."""
        decoded = self.decode_bytes(ids)
        ends = np.cumsum(sizes)
        length = np.diff(np.concatenate([[0], np.cumsum(self.raw_size[ids])])[np.concatenate([[0], ends])])
        same = length == np.diff(offsets) + (sizes > 0)
        body = np.ones(len(decoded), bool)
        first = (np.cumsum(length) - length)[length > 0]
        body[first] = decoded[first] != 32  # the space that was put there
        if same.all() and body.sum() == len(data) and np.array_equal(decoded[body], data):
            return same
        at = np.concatenate([[0], np.cumsum(length)])
        return np.array([decoded[a:b].tobytes()[1:] == data[c:d].tobytes() for a, b, c, d in zip(at, at[1:], offsets, offsets[1:])], bool)


@lru_cache(maxsize=2)
def piece_model(model: bytes) -> PieceModel:
    return PieceModel(model)


def model_bytes(path: str) -> bytes:
    """The model file, read by the driver and broadcast (its size is that of a vocabulary, whatever the corpus)."""
    with open(path, "rb") as f:
        return f.read()


def encode_pieces(
    docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 17, dropout: float = 0.1, model: str = MODEL
) -> DataFrame:
    """(key, ids, lossless) of every row; ``lossless`` says that decoding the ids gave the text back."""
    shared = docs.sparkSession.sparkContext.broadcast(model_bytes(model))
    kind = docs.schema[key].dataType.simpleString()

    def work(batches):
        pieces = piece_model(shared.value)
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for start, stop in slices(offsets, TOGETHER):
                some = batch.slice(start, stop - start)
                body, ends = data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
                ids, sizes = pieces.encode_bytes(body, ends, seed, dropout, some.column(0).to_pylist())
                none = np.asarray(some.column(1).is_null())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(ids), mask=pa.array(none))
                same = pa.array(pieces.same_texts(ids, sizes, body, ends), mask=none)
                yield pa.RecordBatch.from_arrays([some.column(0), lists, same], names=["key", "ids", "lossless"])

    found = map_arrow(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), work, f"key {kind}, ids array<int>, lossless boolean")
    return found.withColumnRenamed("key", key)


def decode_pieces(encoded: DataFrame, ids: str = "ids", key: str = "doc_id", model: str = MODEL) -> DataFrame:
    """(key, text) of every row."""
    shared = encoded.sparkSession.sparkContext.broadcast(model_bytes(model))
    kind = encoded.schema[key].dataType.simpleString()

    def work(batches):
        pieces = piece_model(shared.value)
        for batch in batches:
            texts = [None if r is None else pieces.decode(np.array(r, np.int32).tobytes()) for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    found = map_arrow(encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids")), work, f"key {kind}, text string")
    return found.withColumnRenamed("key", key)
