"""SentencePiece encoding and decoding by Viterbi over batches of words.

The vocabulary of a ``.model`` file becomes sorted hashes of its pieces. Texts are cut
into units (a run of word-boundary marks and the characters up to the next one; line
ends stand alone), which no piece crosses. The different units of a block are encoded
together, sorted by length: equally long ones, and those about as long, advance in one
matrix, which a unit leaves at its end. For each end position the hashes of all
substrings that end there probe the sorted keys, and the best of them becomes the
position's backpointer.

*Which path is best* depends on the model. A unigram model adds piece scores. A BPE model
has merge priorities instead, for which a sum of scores gives wrong pieces; there, a path
counts if each two neighbours would stay apart under the merges, which holds for exactly
one path, the one that merging gives. Whether two pieces stay apart is found from the
merges inside them and remembered. That also lets long units, as of texts without blanks,
go in parts of ``PART`` characters. Units that begin with several boundary marks are
merged directly, as the priorities of such runs are tied.

Defined results: a null or empty text has no pieces; characters outside the vocabulary
become their bytes if the model has byte pieces, else the unknown piece. Decoding gives
the text back, but for the mark U+2581 itself, which reads as a blank, as in the library.
"""

from __future__ import annotations

import heapq
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from costlens.llm.words import BLOCK_BYTES, U64, blocks, mix, span_hash

MARK = "▁"
_BASE = U64(0x9E3779B97F4A7C55)
_BACK = U64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
KEPT_UNITS = 1 << 20
PART = 128  # characters of a unit that are encoded at once
AROUND = (4, 16)  # pieces on both sides of a cut that are encoded anew
CELLS = 1 << 20  # of a matrix of units and characters
SLOT_BITS = 20  # of remembered pairs of pieces
UNIGRAM, BPE = 1, 2


class Vocabulary:
    """Pieces of a model, with what encoding and decoding need; small enough to broadcast."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[int], model: int):
        self.pieces, self.scores, self.model = pieces, np.array(scores), model
        self.normal = [i for i, k in enumerate(kinds) if k in (1, 4)]
        self.unknown = kinds.index(2)
        self.byte_ids = np.full(256, -1, np.int32)
        for i, k in enumerate(kinds):
            if k == 6:
                self.byte_ids[int(pieces[i][3:5], 16)] = i
        self.ids = {pieces[i]: i for i in self.normal}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces that go on behind a word boundary are not supported")
        if any("\n" in p for p in self.ids):
            raise ValueError("pieces that hold a line end are not supported")
        if len(self.ids) != len(self.normal):
            raise ValueError("the vocabulary holds a piece twice")
        texts = [self._bytes_of(p, k) for p, k in zip(pieces, kinds, strict=True)]
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.cumsum([len(t) for t in texts])
        self.longest = max(map(len, self.ids))
        if model == BPE:
            self._learn_merges()
        elif model != UNIGRAM:
            raise ValueError("unigram and BPE models are supported")
        self._index()

    @staticmethod
    def _bytes_of(piece: str, kind: int) -> bytes:
        """What a piece decodes to: nothing for the unknown and the control pieces."""
        if kind == 6:
            return bytes([int(piece[3:5], 16)])
        return b"" if kind in (2, 3) else piece.replace(MARK, " ").encode()

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """From a ``.model`` file that leaves texts as they are but for the boundary marks."""
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        spec = proto.normalizer_spec
        changes = spec.precompiled_charsmap or spec.remove_extra_whitespaces
        if changes or not (spec.add_dummy_prefix and spec.escape_whitespaces):
            raise ValueError("the model's normalisation is not supported")
        rows = proto.pieces
        return cls([p.piece for p in rows], [p.score for p in rows], [p.type for p in rows], proto.trainer_spec.model_type)

    # --- merges -------------------------------------------------------------

    def merge(self, unit: str, steps: list | None = None) -> list[str]:
        """Merge the best pair, the leftmost if tied, until none is a piece."""
        parts: list[str | None] = list(unit)
        after = [*range(1, len(parts)), -1]
        before = [-1, *range(len(parts) - 1)]
        queue: list[tuple] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (both := parts[i] + parts[j]) in self.ids:
                heapq.heappush(queue, (-self.scores[self.ids[both]], i, both, j))

        for i in range(len(parts)):
            offer(i)
        while queue:
            _, i, both, j = heapq.heappop(queue)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != both:
                continue
            if steps is not None:
                steps.append((parts[i], parts[j]))
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [p for p in parts if p is not None]

    def _learn_merges(self) -> None:
        """The two parts each piece is merged from last; pieces that merging never makes go."""
        size = len(self.pieces)
        self.left, self.right = np.full(size + 1, -1, np.int32), np.full(size + 1, -1, np.int32)
        reachable = {}
        for piece, i in self.ids.items():
            steps: list = []
            if len(piece) > 1:
                if self.merge(piece, steps) != [piece] or any(p not in self.ids for p in steps[-1]):
                    continue
                self.left[i], self.right[i] = (self.ids[p] for p in steps[-1])
            reachable[piece] = i
        self.ids_all, self.normal = self.ids, list(reachable.values())
        order = np.argsort(-self.scores[self.normal], kind="stable")
        # When a piece comes to be: single characters are there from the start.
        self.turn = np.full(size + 1, -1, np.int32)
        self.turn[np.array(self.normal)[order]] = np.arange(len(order))
        self.turn[[i for p, i in reachable.items() if len(p) == 1]] = -1

    # --- hashes ---------------------------------------------------------------

    def _index(self) -> None:
        points, length = _points([self.pieces[i] for i in self.normal])
        sums = _sums(points)
        raw = sums[np.arange(len(length)), length]
        keys = mix(raw + length.astype(U64))
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array(self.normal, np.int32)[order]
        self.raw, self.length = np.zeros(len(self.pieces) + 1, U64), np.ones(len(self.pieces) + 1, np.int64)
        for piece, i in self.ids.items():
            self.length[i] = len(piece)
        self.raw[self.normal] = raw
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[self.keys >> U64(44)] = True
        self.powers = _powers(2 * self.longest + 1, _BASE)
        self.slot_pairs, self.slot_stays = np.full(1 << SLOT_BITS, -1, np.int64), np.zeros(1 << SLOT_BITS, bool)

    def probe(self, keys: np.ndarray) -> np.ndarray:
        """Ids of hashed substrings, -1 for those that are no pieces."""
        out = np.full(keys.shape, -1, np.int32)
        maybe = np.nonzero(self.sieve[keys >> U64(44)])
        wanted = keys[maybe]
        place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        out[maybe] = np.where(self.keys[place] == wanted, self.key_ids[place], -1)
        return out

    def stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging keeps the pieces ``a`` and ``b`` apart where they meet."""
        pairs = a.astype(np.int64) * (len(self.pieces) + 1) + b
        slot = (mix(pairs.view(U64)) >> U64(64 - SLOT_BITS)).astype(np.int64)
        out = self.slot_stays[slot]
        new = np.flatnonzero(self.slot_pairs[slot] != pairs)
        if len(new):
            out[new] = self._stay_apart(a[new], b[new])
            # Of pairs with one slot the last is remembered; which one does not matter.
            self.slot_pairs[slot[new]] = pairs[new]
            self.slot_stays[slot[new]] = self._last_of(slot[new], out[new])
        return out

    @staticmethod
    def _last_of(slot: np.ndarray, values: np.ndarray) -> np.ndarray:
        """For each place the value that writing all places in order leaves in its slot."""
        _, back = np.unique(slot, return_inverse=True)
        left = np.empty(back.max() + 1, values.dtype)
        left[back] = values
        return left[back]

    def _stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undo the merges on both sides of the border, latest first; a merge across it that
        would have come before the one undone joins the two."""
        out = np.ones(len(a), bool)
        limit = np.full(len(a), 1 << 30)
        live = np.flatnonzero((a < len(self.pieces)) & (b < len(self.pieces)))
        while len(live):
            x, y = a[live], b[live]
            raw = self.raw[x] + self.raw[y] * self.powers[self.length[x]]
            joined = self.probe(mix(raw + (self.length[x] + self.length[y]).astype(U64)))
            across = (joined >= 0) & (self.turn[joined] < limit[live])
            out[live[across]] = False
            live, x, y = live[~across], x[~across], y[~across]
            undo_left = self.turn[x] > self.turn[y]
            undo_right = ~undo_left & (self.turn[y] >= 0)
            limit[live[undo_left]] = self.turn[x[undo_left]]
            a[live[undo_left]] = self.right[x[undo_left]]
            limit[live[undo_right]] = self.turn[y[undo_right]] + 1
            b[live[undo_right]] = self.left[y[undo_right]]
            live = live[undo_left | undo_right]
        return out

    # --- units ------------------------------------------------------------------

    def unit_ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units between ``starts`` and ``ends`` in UTF-8 bytes, and how many each has."""
        size = ends - starts
        total = np.concatenate([[0], np.cumsum(size)])
        own = data[np.arange(total[-1]) + np.repeat(starts - total[:-1], size)]
        lead = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])[total]  # characters before each unit
        text = own.tobytes().decode("utf-8", "surrogatepass")
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        length = np.diff(lead)
        run = np.zeros(len(length), bool)
        if self.model == BPE and len(points):
            second = np.minimum(lead[:-1] + 1, len(points) - 1)
            run = (length > 1) & (points[lead[:-1]] == ord(MARK)) & (points[second] == ord(MARK))
        flat, count = self._paths(points, lead[:-1], np.where(run, 0, length))
        if run.any():
            merged = {i: self._merged(points[lead[i] : lead[i + 1]]) for i in np.flatnonzero(run).tolist()}
            flat, count = _replaced(flat, count, merged)
        return self._final(points, lead[:-1], flat, count)

    def _merged(self, points: np.ndarray) -> np.ndarray:
        """The path of one unit by merging it step by step."""
        parts = self.merge("".join(map(chr, points.tolist())))
        return np.array([self.ids_all.get(p, len(self.pieces)) for p in parts], np.int32)

    def _paths(self, points: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Paths of the spans of characters, and the pieces of each; long ones go in parts."""
        long = np.flatnonzero(length > PART) if self.model == BPE else np.zeros(0, np.int64)
        if not len(long):
            return self._short_paths(points, begin, length)
        flat, count = self._short_paths(points, begin, np.where(length > PART, 0, length))
        return _replaced(flat, count, dict(zip(long.tolist(), self._long_paths(points, begin[long], length[long]), strict=True)))

    def _long_paths(self, points: np.ndarray, begin: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
        """Paths of long units: cut anywhere, and encoded anew around the cuts that show.

        As one path only has neighbours that all stay apart, parts whose last and first
        pieces stay apart are the unit's path, wherever they were cut. Where a cut goes
        through a piece, the pieces around it are encoded as a unit of their own, whose
        two borders must hold. Units for which that fails too are merged.
        """
        parts = (length + PART - 1) // PART
        unit = np.repeat(np.arange(len(length)), parts)
        place = np.arange(len(unit)) - np.repeat(np.cumsum(parts) - parts, parts)
        at = begin[unit] + place * PART
        size = np.minimum(PART, length[unit] - place * PART)
        flat, count = self._short_paths(points, at, size)
        paths = np.split(flat, np.cumsum(count)[:-1])
        left = np.flatnonzero(unit[1:] == unit[:-1])  # borders, by the part before them
        last, first = (np.array([p[i] for p in paths], np.int32) for i in (-1, 0))
        open_ = left[~self.stay_apart(last[left], first[left + 1])]
        between: dict[int, tuple[int, np.ndarray, int]] = {}
        stuck = []
        for reach in AROUND:
            before = np.minimum(reach, (count[open_] - 1) // 2)
            behind = np.minimum(reach, (count[open_ + 1] - 1) // 2)
            some = before + behind > 0
            stuck += open_[~some].tolist()
            open_, before, behind = open_[some], before[some], behind[some]
            if not len(open_):
                break
            heads = np.array([self.length[paths[i][len(paths[i]) - n :]].sum() for i, n in zip(open_, before, strict=True)], np.int64)
            tails = np.array([self.length[paths[i + 1][:n]].sum() for i, n in zip(open_, behind, strict=True)], np.int64)
            around, sizes = self._short_paths(points, at[open_ + 1] - heads, heads + tails)
            middle = np.split(around, np.cumsum(sizes)[:-1])
            holds = np.ones(len(open_), bool)
            for side in (0, 1):
                edge = [paths[i][len(paths[i]) - n - 1] if side == 0 else paths[i + 1][n] for i, n in zip(open_, (before, behind)[side], strict=True)]
                inner = np.array([m[0 if side == 0 else -1] for m in middle], np.int32)
                pair = (np.array(edge, np.int32), inner) if side == 0 else (inner, np.array(edge, np.int32))
                holds &= self.stay_apart(*pair)
            for i, n, path, m, good in zip(open_.tolist(), before.tolist(), middle, behind.tolist(), holds, strict=True):
                if good:
                    between[i] = (n, path, m)
            open_ = open_[~holds]
        broken = set(unit[[*open_.tolist(), *stuck]].tolist())
        out = []
        for number, (start, many) in enumerate(zip((np.cumsum(parts) - parts).tolist(), parts.tolist(), strict=True)):
            if number in broken:
                out.append(self._merged(points[begin[number] : begin[number] + length[number]]))
                continue
            joined, skip = [], 0
            for i in range(start, start + many):
                cut, path, following = between.get(i, (0, None, 0)) if i + 1 < start + many else (0, None, 0)
                joined.append(paths[i][skip : len(paths[i]) - cut])
                joined += [] if path is None else [path]
                skip = following
            out.append(np.concatenate(joined))
        return out

    def _short_paths(self, points: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Paths of the spans, those of near lengths together."""
        order = np.argsort(length, kind="stable")
        order = order[np.searchsorted(length[order], 1) :]
        count, parts, at = np.zeros(len(length), np.int64), [], 0
        cells = length[order] * np.arange(1, len(order) + 1)  # of a matrix from the first span on
        while at < len(order):
            end = max(at + 1, int(np.searchsorted(cells - length[order] * at, CELLS, side="right")))
            some = order[at:end][::-1]
            path, count[some] = self._advance(points, begin[some], length[some])
            parts.append(path)
            order[at:end] = some
            at = end
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        # From the order of lengths back to that of the spans.
        total = np.cumsum(count)
        made = np.zeros(len(length), np.int64)
        made[order] = np.cumsum(count[order]) - count[order]
        return flat[np.arange(len(flat)) + np.repeat(made - (total - count), count)], count

    def _advance(self, points: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Paths of spans, the longest first, that advance together by one character a step.

        Those of one length end at the same step; the rest goes on without them.
        """
        n, most, unknown = len(length), int(length[0]), len(self.pieces)
        sums = _sums(points[np.minimum(begin[:, None] + np.arange(most), len(points) - 1)])
        back = _powers(most + 1, _BACK)
        score = np.full((n, most + 1), -np.inf)
        score[:, 0] = 0
        piece = np.full((n, most + 1), -1, np.int32)
        origin = np.zeros((n, most + 1), np.int32)
        penalty = self.scores[self.normal].min() - 10
        going = np.searchsorted(-length, -np.arange(most + 1), side="right")
        for end in range(1, most + 1):
            live = going[end]
            starts = np.arange(max(0, end - self.longest), end)
            keys = mix((sums[:live, end, None] - sums[:live, starts]) * back[starts] + (end - starts).astype(U64))
            found = self.probe(keys)
            found[found[:, -1] < 0, -1] = unknown
            row, at = np.nonzero((found >= 0) & (score[:live, starts] > -np.inf))
            ids, last = found[row, at], piece[row, starts[at]]
            if self.model == UNIGRAM:
                gain = np.where(ids == unknown, penalty, self.scores[np.minimum(ids, unknown - 1)])
            else:
                # The path goes on with the piece that stays apart from the one before it.
                gain = np.zeros(len(ids))
                check = np.flatnonzero(last >= 0)
                gain[check[~self.stay_apart(last[check], ids[check])]] = -np.inf
            total = np.full(found.shape, -np.inf)
            total[row, at] = score[row, starts[at]] + gain
            best, every = total.argmax(1), np.arange(live)
            score[:live, end], piece[:live, end], origin[:live, end] = total[every, best], found[every, best], starts[best]
        out = np.full((n, most), -1, np.int32)  # filled from the right
        at, live, column = length.copy(), np.arange(n), most - 1
        while len(live):
            out[live, column] = piece[live, at[live]]
            at[live] = origin[live, at[live]]
            live, column = live[at[live] > 0], column - 1
        return out[out >= 0], (out >= 0).sum(1)

    def _final(self, points: np.ndarray, begin: np.ndarray, flat: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Paths with bytes, or the unknown piece, for characters outside the vocabulary."""
        strange = np.flatnonzero(flat == len(self.pieces))
        if not len(strange):
            return flat, count
        size = self.length[flat]
        row = np.repeat(np.arange(len(count)), count)
        behind = np.cumsum(size)
        at = behind - size - (np.concatenate([[0], behind])[np.cumsum(count) - count])[row] + begin[row]
        chars, which = np.unique(points[at[strange]], return_inverse=True)
        own = [self.byte_ids[np.frombuffer(chr(c).encode("utf-8", "surrogatepass"), np.uint8)] for c in chars.tolist()]
        own = [x if (x >= 0).all() else np.array([self.unknown], np.int32) for x in own]
        begins, sizes = np.cumsum([0, *map(len, own)])[:-1], np.array([len(x) for x in own])
        wide = np.ones(len(flat), np.int64)
        wide[strange] = sizes[which]
        out = np.repeat(flat, wide)
        place = np.cumsum(wide) - wide
        step = np.arange(wide[strange].sum()) - np.repeat(np.cumsum(wide[strange]) - wide[strange], wide[strange])
        out[np.repeat(place[strange], wide[strange]) + step] = np.concatenate(own)[np.repeat(begins[which], wide[strange]) + step]
        return out, np.bincount(row, weights=wide, minlength=len(count)).astype(np.int64)

    # --- texts --------------------------------------------------------------------

    @cached_property
    def encoder(self) -> Encoder:
        return Encoder(self)

    def decode_block(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of each row's pieces, with the blank that encoding puts before a text; row bounds."""
        begin = np.concatenate([[0], self.ends])
        size = begin[ids + 1] - begin[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        places = np.arange(total[-1]) + np.repeat(begin[ids] - total[:-1], size)
        return self.bytes[places], total[bounds]


class Encoder:
    """Encodes blocks of texts and remembers the units it has seen, up to a bound."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, U64)  # sorted hashes of units
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def __getstate__(self):
        return {"vocabulary": self.vocabulary}

    def __setstate__(self, state):
        self.__init__(state["vocabulary"])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the bounds of each text's ids."""
        marked = pc.replace_substring(column.fill_null(""), " ", MARK)
        full = pc.greater(pc.binary_length(marked), 0)
        marked = pc.if_else(full, pc.binary_join_element_wise(MARK, marked, ""), "")
        block = next(blocks(marked, 1 << 62), (None, None))[1]
        if block is None or not len(block.data):
            return np.zeros(0, np.int32), np.zeros(len(column) + 1, np.int64)
        data, bounds = block.data, block.bounds
        starts = _unit_starts(data, bounds)
        ends = np.append(starts[1:], len(data))
        hashes = span_hash(block.prefix_sums(), starts, ends)
        different, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > KEPT_UNITS:
            self._forget()
        place = np.searchsorted(self.known, different)
        new = np.ones(len(different), bool)
        inside = place < len(self.known)
        new[inside] = self.known[place[inside]] != different[inside]
        if new.any():
            flat, count = self.vocabulary.unit_ids(data, starts[first[new]], ends[first[new]])
            begin = len(self.flat) + np.cumsum(count) - count
            self.known = np.insert(self.known, place[new], different[new])
            self.begin, self.count = np.insert(self.begin, place[new], begin), np.insert(self.count, place[new], count)
            self.flat = np.concatenate([self.flat, flat])
            place = np.searchsorted(self.known, different)
        own = place[back]
        count = self.count[own]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.flat[np.arange(total[-1]) + np.repeat(self.begin[own] - total[:-1], count)]
        return ids, total[np.searchsorted(starts, bounds)]


def _replaced(flat: np.ndarray, count: np.ndarray, paths: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The paths with those of some units put in, which had none."""
    if not paths:
        return flat, count
    count = count.copy()
    count[list(paths)] = [len(p) for p in paths.values()]
    new = np.zeros(len(count), bool)
    new[list(paths)] = True
    from_new = np.repeat(new, count)
    out = np.empty(len(from_new), np.int32)
    out[~from_new] = flat
    out[from_new] = np.concatenate([paths[i] for i in sorted(paths)])
    return out, count


def _unit_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where texts begin, a run of boundary marks begins, and before and behind line ends."""
    head = np.zeros(len(data) + 1, bool)
    mark = np.zeros(len(data) + 3, bool)
    mark[: len(data) - 2] = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
    head[: len(data)] = mark[: len(data)]
    head[3 : len(data)] &= ~mark[: len(data) - 3]
    line = np.flatnonzero(data == 0x0A)
    head[line] = True
    head[line + 1] = True
    head[bounds] = True
    return np.flatnonzero(head[:-1])


def _points(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters as numbers in one matrix padded with zeros, and the lengths."""
    length = np.array([len(u) for u in units])
    width = int(length.max()) if len(units) else 0
    flat = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros((len(units), width), np.uint32)
    out[np.arange(width) < length[:, None]] = flat
    return out, length


def _powers(n: int, base: np.uint64) -> np.ndarray:
    steps = np.full(n, base, U64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def _sums(points: np.ndarray) -> np.ndarray:
    out = np.zeros((len(points), points.shape[1] + 1), U64)
    np.cumsum(mix(points.astype(U64)) * _powers(max(points.shape[1], 1), _BASE)[: points.shape[1]], axis=1, out=out[:, 1:])
    return out


def _encoded(vocabulary: Vocabulary, column: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Lists of ids, and whether decoding them gives the text back."""
    lists, exact = [], []
    for at, block in blocks(column, 2 * BLOCK_BYTES):
        ids, bounds = vocabulary.encoder.encode(column.slice(at.start, at.stop - at.start))
        lists.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)))
        data, ends = vocabulary.decode_block(ids, bounds)
        joined = data.tobytes()
        for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            exact.append(joined[min(a + 1, b) : b] == block.text(i).replace(MARK.encode(), b" "))
    if not lists:
        return pa.array([], pa.list_(pa.int32())), pa.array([], pa.bool_())
    return pa.concat_arrays(lists), pa.array(exact, pa.bool_())


def encode(spark: SparkSession, vocabulary: Vocabulary, text: Column) -> Column:
    """A struct of ``ids`` and ``exact``: the pieces of a whole text and whether they decode to it."""
    shared = spark.sparkContext.broadcast(vocabulary)  # bounded by the model file

    @F.arrow_udf("struct<ids:array<int>,exact:boolean>")
    def encoded(column: pa.Array) -> pa.Array:
        ids, exact = _encoded(shared.value, column)
        return pa.StructArray.from_arrays([ids, exact], names=["ids", "exact"])

    return encoded(text)


def decode(spark: SparkSession, vocabulary: Vocabulary, ids: Column) -> Column:
    """The text of each list of ids; null for a null list."""
    shared = spark.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("string")
    def decoded(column: pa.Array) -> pa.Array:
        out = []
        for row in column:
            if not row.is_valid:
                out.append(None)
                continue
            own = row.values.to_numpy(zero_copy_only=False).astype(np.int64)
            data, _ = shared.value.decode_block(own, np.array([0, len(own)]))
            out.append(data.tobytes()[1:].decode("utf-8", "replace"))
        return pa.array(out, pa.string())

    return decoded(ids)
