"""SentencePiece encoding and decoding: the N best segmentations over the piece lattice.

A forward Viterbi pass gives every place of the lattice its best score from the start. A search from the end backward then has the
exact best completion of every partial path, so A* pops complete paths best first: the first N are the N best.

Score: the sum of the pieces' log-probabilities, a unigram model over the pieces of the model file, estimated by expectation maximisation
(forward-backward sums over the same lattice) on the parts of all texts, each as often as it occurs. Expected counts are summed as whole numbers, so that partitions do not change them. The file's own scores are merge ranks, whose sums mean nothing. Text is taken as it is, but for spaces,
which become space marks, and one in front; the file's normaliser is not applied. A character without a piece becomes its byte pieces at the score
UNKNOWN below the least. Order: score, then fewer pieces, then as found from the end on.

A text is cut wherever no piece joins two characters, as before the space mark of a word. The cut (Lattice.cut_all) and the count of different
parts are array operations on a slice of texts. The forward pass runs over all new parts of a slice at once (Lattice.forward_all): it gives their best paths, and what their second best lose: on the best path, the least
difference between a place's best and next best way in. A document's N best change few parts, those of the N - 1 least losses; only
these are searched by A*, and their lists combined. Parts above LONGEST go through the pass one by one.

Defined results: a null or empty text has no pieces and one (empty) segmentation; a text with fewer than N segmentations has them all;
equal texts have equal results; a corpus without words gives all pieces one score; an empty table gives an empty table. Decoding gives the text back, byte by byte, save
that the space mark itself decodes as a space.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from bisect import insort
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import documents, materialize, scratch, tidy, trim, worker_cache
from quarry.llm.tokens import vocabulary

MARK, N, UNKNOWN, LIMIT = "▁", 3, 10.0, 80_000
LONGEST, EPOCHS, FLOOR, UNIT = 64, 4, 0.01, 1 << 20  # of the fit; FLOOR is added to the count of each piece
LEAN, SAFE = 2.5, 1e150
COUNT = 2.0**-20  # what a piece costs in ties of scores
BYTE = re.compile(r"<0x([0-9A-F]{2})>\Z")
SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
OTHER = 1 << 24  # codes from here on are characters that become byte pieces


STEP, CHUNK = np.uint64(0x9E3779B97F4A7C15), 10_000
SLICE, NEAR, BITS = 2 << 20, 0x250, 18  # bytes of texts taken at once; characters below NEAR have their pairs in a table; first bits of a digest that have an index

Best = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # of parts: how many ids the best segmentation has, these in a row, its score, what the second best loses (infinite: there is none)


def string_digest(text: str) -> int:
    """A 64-bit digest, a character at a time."""
    h = 0
    for c in text:
        h = (h ^ ord(c)) * int(STEP) & (1 << 64) - 1
        h ^= h >> 32
    return h


def chosen(best: Best, which: np.ndarray) -> Best:
    n, ids, total, loss = best
    m = n[which]
    return m, ids[np.repeat(np.cumsum(n)[which] - np.cumsum(m), m) + np.arange(m.sum())], total[which], loss[which]


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """From and to of rows in a row that have so many bytes together, or are one."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def chosen_edges(chosen: np.ndarray, size: np.ndarray, start: np.ndarray, length: np.ndarray, own: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sizes of chosen segments, and start, length, segment and score of their edges, as if there were no others."""
    e, less = chosen[own], np.cumsum(size * ~chosen)
    return size[chosen], start[e] - less[own[e]], length[e], (np.cumsum(chosen) - 1)[own[e]], score[e]


class Lattice:
    """The pieces of a model, and the best of the parts found so far (two bounded generations)."""

    def __init__(self, path: str, n: int = N, limit: int = LIMIT, scores: np.ndarray | None = None):
        """scores: a log-probability for each id; by default those of no sample, all alike."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n, self.limit = n, limit
        self.pieces, self.bytes_of, self.byte_ids = {}, [], {}
        for k in range(model.get_piece_size()):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                self.byte_ids[int(BYTE.match(piece)[1], 16)] = k
                self.bytes_of.append(bytes([int(BYTE.match(piece)[1], 16)]))
            elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
                self.bytes_of.append(b"")
            else:
                self.pieces[piece] = (k, 0.0)
                self.bytes_of.append(piece.replace(MARK, " ").encode())
        by = {}
        for p, (k, _) in self.pieces.items():
            for j in range(1, len(p)):
                by.setdefault(string_digest(p[:j]), -1)
            by[string_digest(p)] = k
        #: Digests of all beginnings of pieces, the piece that each is, if any, and where those of the same first bits begin.
        self.digests = np.array([*sorted(by), (1 << 64) - 1], np.uint64)
        self.piece_of = np.array([*(by[d] for d in sorted(by)), -1], np.int64)
        self.first = np.searchsorted(self.digests, np.arange(1 << BITS, dtype=np.uint64) << np.uint64(64 - BITS)).astype(np.int32)
        self.score_by(self.alike() if scores is None else scores)
        self.pairs = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.pieces):
            raise ValueError("pieces that go on past a space mark are not supported")
        codes = np.array([[ord(c) for c in x] for x in self.pairs], np.uint64).reshape(-1, 2)
        self.far = np.sort(np.append(codes[:, 0] << np.uint64(21) | codes[:, 1], np.uint64(1 << 63)))
        self.near = np.zeros((NEAR + 2, NEAR + 2), bool)
        codes = np.where(codes == ord(MARK), NEAR + 1, np.minimum(codes, NEAR)).astype(np.int64)
        codes = codes[(codes != NEAR).all(1)]
        self.near[codes[:, 0], codes[:, 1]] = True
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.sizes = np.array([len(b) for b in self.bytes_of], np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes

    def alike(self) -> np.ndarray:
        return np.full(len(self.bytes_of), -float(np.log(max(1, len(self.pieces)))))

    def score_by(self, scores: np.ndarray) -> None:
        """Pieces get their scores by id; what was found by others goes."""
        self.cache: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.best = self.older_best = self.none()
        self.lists: dict[str, list[tuple[float, bytes]]] = {}
        self.scores = scores
        self.pieces = {p: (k, float(scores[k])) for p, (k, _) in self.pieces.items()}
        self.unknown = min((s for _, s in self.pieces.values()), default=0.0) - UNKNOWN
        self.score_of = np.asarray(scores, float) - COUNT
        self.costs = self.score_of.tolist()

    @staticmethod
    def none() -> Best:
        return np.zeros(0, np.int32), np.zeros(0, "<u4"), np.zeros(0), np.zeros(0)

    @cached_property
    def root(self) -> dict:
        """A trie of (next letters, id of what ends here, if it is a piece)."""
        root: dict = {}
        for p, (k, _) in self.pieces.items():
            node = root
            for c in p[:-1]:
                node = node.setdefault(c, ({}, None))[0]
            node[p[-1]] = (node.get(p[-1], ({}, None))[0], k)
        return root

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """All pieces in a text: from, to, id."""
        out, n = [], len(text)
        for i in range(n):
            node = self.root
            for j in range(i, n):
                step = node.get(text[j])
                if step is None:
                    break
                node, piece = step
                if piece is not None:
                    out.append((i, j + 1, piece))
        return out

    def edges(self, names: list[str]) -> tuple[np.ndarray, ...]:
        """Of segments, none empty: their sizes; and in the order of segments and places, of each piece in them the step from the start before, its length and id (OTHER: a character without a piece)."""
        _, begin, size, place, start, end, piece = self.spans_all(names)
        order = np.argsort(start << 8 | end - start)
        start, end, piece = start[order], end[order], piece[order]
        text = start - place[start]
        whose = np.searchsorted(begin, text)
        return size, np.diff(start - whose, prepend=0), end - start, np.minimum(piece, OTHER)  # places as if no segment had an end of its own

    def expected(self, edges: tuple[np.ndarray, ...], count: np.ndarray, scores: np.ndarray | None) -> np.ndarray:
        """How often each piece is expected in segments that occur count times, in units of 1 / UNIT, whole so that their sums have no order; without scores each piece counts wherever it is.

        Sums of products, each character's scaled by LEAN; segments of which these leave the range SAFE are summed by their logarithms.
        """
        size, step, length, piece = edges
        start = np.cumsum(step)
        own = np.repeat(np.arange(len(size)), size)[start]
        known = piece < OTHER
        if scores is None:
            found = np.ones(len(piece))
        else:
            low = scores[self.known_ids()].min() - UNKNOWN
            score = np.where(known, scores[np.where(known, piece, 0)], low)
            node = start + own  # nodes of a segment: one more than its places
            first = np.cumsum(size) - size + np.arange(len(size))
            level = node - first[own] + length
            order = np.argsort(level.astype(np.uint16) if level.max(initial=0) < 1 << 16 else level, kind="stable")
            source, p = node[order], np.exp(score + LEAN * length)[order]
            target = source + length[order]
            groups = np.flatnonzero(np.diff(target, prepend=-1))
            cuts = np.r_[np.flatnonzero(np.diff(level[order], prepend=-1)), len(order)]
            at = np.searchsorted(groups, cuts)
            ahead, behind = (np.zeros(int(size.sum()) + len(size)) for _ in range(2))
            ahead[first] = behind[first + size] = 1.0
            steps = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True))
            for i, j, k, m in steps:
                ahead[target[groups[k:m]]] = np.add.reduceat(p[i:j] * ahead[source[i:j]], groups[k:m] - i)
            for i, j, *_ in reversed(steps):
                np.add.at(behind, source[i:j], p[i:j] * behind[target[i:j]])
            total = ahead[first + size]
            found = np.empty(len(piece))
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                found[order] = ahead[source] * p * behind[target] / total[own[order]]
            if len(size):
                narrow = np.minimum(np.minimum.reduceat(ahead, first), np.minimum.reduceat(behind, first)) < 1 / SAFE
                narrow |= np.maximum(np.maximum.reduceat(ahead, first), np.maximum.reduceat(behind, first)) > SAFE
                if narrow.any():
                    found[narrow[own]] = self.by_logarithms(*chosen_edges(narrow, size, start, length, own, score))
        return np.bincount(piece[known], np.rint(UNIT * found * count[own])[known], len(self.sizes))

    def by_logarithms(self, size: np.ndarray, start: np.ndarray, length: np.ndarray, own: np.ndarray, score: np.ndarray) -> np.ndarray:
        """How often each edge is expected, in whatever range."""
        first = np.cumsum(size) - size
        at = start - first[own]
        node = start + own  # nodes of a segment: one more than its places
        ahead, behind = (np.zeros(int(size.sum()) + len(size)) for _ in range(2))
        for level, values, target, other in ((at + length, ahead, node + length, node), (-at, behind, node, node + length)):
            order = np.argsort(level, kind="stable")
            cuts = np.r_[np.flatnonzero(np.diff(level[order], prepend=level.min() - 1)), len(order)]
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                e = order[i:j]
                v, t = score[e] + values[other[e]], target[e]
                groups = np.flatnonzero(np.diff(t, prepend=-1))
                top = np.maximum.reduceat(v, groups)
                v = np.exp(v - np.repeat(top, np.diff(np.r_[groups, len(t)])))
                values[t[groups]] = top + np.log(np.add.reduceat(v, groups))
        return np.exp(ahead[node] + score + behind[node + length] - behind[first + np.arange(len(size))][own])

    def known_ids(self) -> list[int]:
        return [k for k, _ in self.pieces.values()]

    def estimated(self, expect: Callable[[np.ndarray | None], np.ndarray], epochs: int) -> np.ndarray:
        """Log-probabilities by id, after as many epochs of expectation maximisation, from the counts of all pieces on; expect: as expected(), of all segments."""
        known = np.zeros(len(self.sizes), bool)
        known[self.known_ids()] = True
        scores = None
        for _ in range(epochs + 1):
            p = np.where(known, expect(scores) / UNIT + FLOOR, 0.0)
            scores = np.log(np.maximum(p / max(p.sum(), 1e-300), 1e-300))
        return scores

    def fit(self, words: dict[str, int], epochs: int = EPOCHS) -> np.ndarray:
        """estimated() over words and their counts."""
        edges, count = self.edges(list(words)), np.array(list(words.values()), float)
        return self.estimated(lambda scores: self.expected(edges, count, scores), epochs)

    def forward(self, text: str) -> tuple[list[float], list[list[tuple[float, int, int]]]]:
        """Viterbi: the best score of each place, and the pieces that end there as (best score by way of it, where it starts, code)."""
        n, root = len(text), self.root
        best = [-np.inf] * (n + 1)
        best[0] = 0.0
        ends: list[list] = [[] for _ in range(n + 1)]
        for i in range(n):
            here, alone, node = best[i], False, root
            for j in range(i, n):
                step = node.get(text[j])
                if step is None:  # no piece begins like this
                    break
                node, piece = step
                if piece is not None:
                    v = here + self.costs[piece]
                    ends[j + 1].append((v, i, piece))
                    if v > best[j + 1]:
                        best[j + 1] = v
                    alone |= j == i
            if not alone:
                v = here + self.unknown - COUNT * len(text[i].encode("utf-8", "surrogatepass"))
                ends[i + 1].append((v, i, OTHER + ord(text[i])))
                best[i + 1] = max(best[i + 1], v)
        return best, ends

    def ids(self, codes) -> list[int]:
        out = []
        for c in codes:
            out += [c] if c < OTHER else [self.byte_ids[b] for b in chr(c - OTHER).encode("utf-8", "surrogatepass")]
        return out

    def search(self, text: str) -> list[tuple[float, tuple]]:
        """The n best of one segment: (score less COUNT a piece, codes from the end on).

        A* from the end: what a partial path can still reach is known exactly, so its rank is what it has lost against the best. The
        extension that loses nothing is followed at once; the others wait in the heap, unless n with less loss are known.
        """
        best, ends = self.forward(text)
        total = best[-1]
        heap, out, known, order = [(0.0, 0, len(text), ())], [], [0.0], 0
        while heap and len(out) < self.n:
            loss, _, j, suffix = heapq.heappop(heap)
            while j:
                top, b = None, best[j]
                for v, i, k in ends[j]:
                    if top is None and v == b:
                        top = i, k
                        continue
                    d = loss + b - v
                    if len(known) < self.n or d < known[-1]:
                        insort(known, d)
                        del known[self.n :]
                        order += 1
                        heapq.heappush(heap, (d, order, i, (*suffix, k)))
                j = top[0]
                suffix = (*suffix, top[1])
            out.append((total - loss, suffix))
        return out

    def packed(self, suffix: tuple) -> bytes:
        return array("I", self.ids(reversed(suffix))).tobytes()

    def joined(self, codes: np.ndarray) -> np.ndarray:
        """Of each character: whether a piece joins it to the one before."""
        i = np.minimum(codes, NEAR).astype(np.int32)
        i[codes == ord(MARK)] = NEAR + 1
        out = np.zeros(len(codes), bool)
        out[1:] = self.near.ravel()[i[:-1] * (NEAR + 2) + i[1:]]
        far = i == NEAR
        far = np.flatnonzero(far[1:] | far[:-1])
        key = codes[far].astype(np.uint64) << np.uint64(21) | codes[far + 1]
        out[far + 1] = self.far[np.searchsorted(self.far, key)] == key
        return out

    def parts(self, text: str) -> list[str]:
        """A string, cut where no piece joins its characters."""
        cuts = [k for k in range(1, len(text)) if text[k - 1 : k + 1] not in self.pairs]
        return [text[i:j] for i, j in zip([0, *cuts], [*cuts, len(text)], strict=True)]

    def cut_all(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """parts() of all texts, each but the empty ones with a space mark in front; and the place of each text's first, and of the end."""
        found, counts = [pa.array([], pa.string())], [np.zeros(1, np.int64)]
        for at, to in slices(texts, SLICE // 2):
            some = texts.slice(at, to - at)
            marked = pc.binary_join_element_wise(pc.if_else(pc.equal(some, ""), "", MARK), pc.replace_substring(some, " ", MARK), "")
            offsets = np.frombuffer(marked.buffers()[1], np.int32)[marked.offset : marked.offset + len(marked) + 1]
            first = offsets[:-1] - offsets[0]
            if offsets[0] == offsets[-1]:
                counts.append(np.zeros(len(some), np.int64))
                continue
            data = marked.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
            whole = np.frombuffer(data, np.uint8)
            cut = ~self.joined(np.frombuffer(str(data, "utf-8").encode("utf-32-le"), "<u4"))
            begin = np.zeros(len(whole) + 1, bool)
            begin[np.flatnonzero(whole & 0xC0 != 0x80)[cut]] = True
            begin[first] = begin[-1] = True
            begin = np.flatnonzero(begin).astype(np.int32)
            found.append(pa.StringArray.from_buffers(len(begin) - 1, pa.py_buffer(begin), data))
            counts.append(np.diff(np.searchsorted(begin, np.append(first, len(whole)))))
        return pa.concat_arrays(found), np.cumsum(np.concatenate(counts))

    def listed(self, part: str) -> list[tuple[float, bytes]]:
        """The n best of a part."""
        found = self.lists.get(part)
        if found is None:
            found = [(score, self.packed(codes)) for score, codes in self.search(part)]
            if len(self.lists) >= self.limit // 8:
                self.lists.clear()
            self.lists[part] = found
        return found

    def spans_all(self, names: list[str]) -> tuple[np.ndarray, ...]:
        """Of segments, none empty, joined with an end after each: codes, where each begins, its size, the place of each code; from, to and id of all pieces (OTHER and above: characters without a piece)."""
        codes = np.frombuffer("\0".join([*names, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
        size = np.fromiter(map(len, names), np.int64, len(names))
        begin = np.cumsum(size + 1) - size - 1
        place = np.arange(len(codes)) - np.repeat(begin, size + 1)
        ends_at = np.zeros(len(codes), bool)
        ends_at[begin + size] = True
        # All pieces at all places: digests of ever longer strings, as long as some piece begins so.
        at, h = np.flatnonzero(~ends_at), np.zeros(len(codes) - len(names), np.uint64)
        starts, lengths, pieces = [], [], []
        length = 0
        while len(at):
            h = (h ^ codes[at + length].astype(np.uint64)) * STEP
            h ^= h >> np.uint64(32)
            length += 1
            where = self.first[h >> np.uint64(64 - BITS)]
            late = np.flatnonzero(self.digests[where] < h)
            while len(late):
                where[late] += 1
                late = late[self.digests[where[late]] < h[late]]
            ok = self.digests[where] == h
            at, h, where = at[ok], h[ok], where[ok]
            piece = self.piece_of[where]
            starts.append(at[piece >= 0])
            pieces.append(piece[piece >= 0])
            lengths.append(np.full(len(starts[-1]), length))
            more = ~ends_at[at + length]
            at, h = at[more], h[more]
        alone = ends_at.copy()
        alone[starts[0] if starts else []] = True
        other = np.flatnonzero(~alone)
        start = np.concatenate([*starts, other])
        end = start + np.concatenate([*lengths, np.ones(len(other), np.int64)])
        return codes, begin, size, place, start, end, np.concatenate([*pieces, OTHER + codes[other].astype(np.int64)])

    def forward_all(self, names: list[str]) -> Best:
        """The best of parts, none empty."""
        codes, begin, size, place, start, end, piece = self.spans_all(names)
        c = np.maximum(piece - OTHER, 0)
        score = np.where(piece < OTHER, self.score_of[np.where(piece < OTHER, piece, 0)], self.unknown - COUNT * (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)))
        level = place[start] + end - start
        order = np.argsort(level << 40 | end << 8 | 255 - (end - start))
        start, end, piece, score, level = start[order], end[order], piece[order], score[order], level[order]
        steps = np.r_[np.flatnonzero(np.diff(level, prepend=-1)), len(start)]
        best, gap, back, by = np.zeros(len(codes)), np.full(len(codes), np.inf), np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
        for i, j in zip(steps[:-1].tolist(), steps[1:].tolist(), strict=True):
            v, e = best[start[i:j]] + score[i:j], end[i:j]
            first = np.flatnonzero(np.diff(e, prepend=-1))
            n = np.diff(np.r_[first, j - i])
            top = np.maximum.reduceat(v, first)
            chosen = np.minimum.reduceat(np.where(v == np.repeat(top, n), np.arange(j - i), j - i), first)
            v[chosen] = -np.inf
            node = e[first]
            best[node], gap[node], back[node], by[node] = top, top - np.maximum.reduceat(v, first), start[i:j][chosen], piece[i:j][chosen]
        # Back along the best paths of all segments, a piece at a time.
        whose, node = np.arange(len(names)), begin + size
        total, loss, found = best[node], np.full(len(names), np.inf), []
        while len(whose):
            loss[whose] = np.minimum(loss[whose], gap[node])
            found.append((whose, by[node]))
            node = back[node]
            left = node > begin[whose]
            whose, node = whose[left], node[left]
        whose, piece = (np.concatenate(x[::-1]) for x in zip(*found, strict=True))
        order = np.argsort(whose, kind="stable")
        whose, piece = whose[order], piece[order]
        odd = piece >= OTHER
        if odd.any():
            ids = [self.ids([c]) for c in piece[odd].tolist()]
            n = np.ones(len(piece), np.int64)
            n[odd] = [len(x) for x in ids]
            whose, piece, odd = np.repeat(whose, n), np.repeat(piece, n), np.repeat(odd, n)
            piece[odd] = [k for x in ids for k in x]
        return np.bincount(whose, minlength=len(names)).astype(np.int32), piece.astype("<u4"), total, loss

    def found(self, names: list[str]) -> Best:
        """The best of different parts, none empty. They are kept for the next time."""
        at = np.fromiter(map(self.cache.get, names, repeat(-1)), np.int64, len(names))
        others = np.flatnonzero(at < 0)
        before = np.fromiter((self.older.get(names[k], -1) for k in others.tolist()), np.int64, len(others))
        new = others[before < 0].tolist()
        short, long = ([k for k in new if (len(names[k]) <= LONGEST) == x] for x in (True, False))
        best = [self.best, chosen(self.older_best, before[before >= 0])]
        best += [self.forward_all([names[k] for k in short[i : i + CHUNK]]) for i in range(0, len(short), CHUNK)]
        for k in long:
            listed = self.search(names[k])
            ids = np.array(self.ids(reversed(listed[0][1])), "<u4")
            best.append((np.array([len(ids)], np.int32), ids, np.array([listed[0][0]]), np.array([listed[0][0] - listed[1][0] if len(listed) > 1 else np.inf])))
        added = np.concatenate([others[before >= 0], np.array(short + long, np.int64)])
        at[added] = np.arange(len(added)) + len(self.best[0])
        self.best = tuple(np.concatenate(x) for x in zip(*best, strict=True))
        self.cache.update(zip([names[k] for k in added.tolist()], at[added].tolist(), strict=True))
        out = chosen(self.best, at)
        if len(self.cache) >= self.limit:
            self.cache, self.older, self.best, self.older_best = {}, self.cache, self.none(), self.best
        return out

    def encode(self, text: str) -> list[tuple[float, bytes]]:
        """The n best of a whole text: (score, ids as little-endian unsigned 32-bit)."""
        return next(self.encode_all(pa.array([text], pa.string())))

    def combined(self, data: bytes, total: float, losses: np.ndarray, ends: np.ndarray, sizes: np.ndarray, name: Callable[[int], str]) -> list[tuple[float, bytes]]:
        """The n best of parts in a row, from their best ids, what their second best lose, where their ids end and how many they are, and their names."""
        out = []
        for loss, changes in self.changes(losses, name):
            ids = data
            for at, k in reversed(changes):
                end = 4 * int(ends[at])
                ids = ids[: end - 4 * int(sizes[at])] + self.listed(name(at))[k][1] + ids[end:]
            out.append((round(total - loss + COUNT * (len(ids) // 4), 3), ids))
        return out

    def changes(self, losses: np.ndarray, name: Callable[[int], str]) -> list[tuple[float, tuple]]:
        """The n least total losses, and which parts leave their best for which other; ties: the change that comes first."""
        m = self.n - 1
        few = np.arange(len(losses))
        if len(losses) > m:
            limit = np.partition(losses, m - 1)[m - 1] if m else -np.inf
            few = np.flatnonzero(losses <= limit)
            few = few[np.argsort(losses[few], kind="stable")][:m]
        few = few[np.isfinite(losses[few])]
        out: list[tuple[float, tuple]] = [(0.0, ())]
        for at in sorted(few.tolist()):
            listed = self.listed(name(at))
            own = [listed[0][0] - x for x, _ in listed]
            out = sorted(((loss + own[k], (*c, *([(at, k)] if k else []))) for loss, c in out for k in range(len(own))), key=lambda x: (x[0], x[1]))[: self.n]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of pieces in a row, the space mark of the start included."""
        n = self.sizes[ids]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.begin[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()

    def encode_all(self, texts: pa.Array) -> Iterator[list[tuple[float, bytes]]]:
        """encode() of every text; different parts of the array are looked up once."""
        parts, first = self.cut_all(texts)
        words = parts.dictionary_encode()
        names = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        which = words.indices.to_numpy()
        n, ids, scores, losses = chosen(self.found(names), which)
        ends = np.cumsum(n, dtype=np.int64)
        for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if i == j:
                yield [(0.0, b"")]
                continue
            at = int(ends[i] - n[i])
            yield self.combined(ids[at : ends[j - 1]].tobytes(), float(scores[i:j].sum()), losses[i:j], ends[i:j] - at, n[i:j], lambda k, i=i: names[which[i + k]])


_lattices: dict[tuple[str, int], Lattice] = worker_cache("lattices")


def lattice(path: str, n: int, scores: np.ndarray | None = None) -> Lattice:
    """The lattice of a worker process, with the scores in use, if they matter."""
    if (path, n) not in _lattices:
        _lattices[path, n] = Lattice(path, n, scores=scores)
    own = _lattices[path, n]
    if scores is not None and not np.array_equal(own.scores, scores):
        own.score_by(scores)
    return own


def counted_words(batches: Iterator[pa.RecordBatch], own: Lattice) -> Iterator[pa.RecordBatch]:
    """The parts of the texts of each slice of a batch and how often they occur."""
    for b in batches:
        texts = b.column("text")
        for i, j in slices(texts, 2 * SLICE):
            found = own.cut_all(texts.slice(i, j - i))[0].value_counts()
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "n"])


EDGES = {"size": "<u4", "step": "<u4", "length": "u1", "piece": "<u4", "count": "<i8"}


def packed_edges(batches: Iterator[pa.RecordBatch], own: Lattice) -> Iterator[pa.RecordBatch]:
    """edges() of parts and their counts, packed."""
    for b in batches:
        for k in range(0, b.num_rows, CHUNK):
            words, count = b.column("word").slice(k, CHUNK).to_pylist(), b.column("n").slice(k, CHUNK).to_pylist()
            arrays = *own.edges(words), np.array(count)
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(kind).tobytes()], pa.binary()) for x, kind in zip(arrays, EDGES.values(), strict=True)], names=list(EDGES))


def expected_counts(batches: Iterator[pa.RecordBatch], own: Lattice, scores: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """expected() of all segments of a task."""
    total = np.zeros(len(own.sizes))
    for b in batches:
        for k in range(b.num_rows):
            *edges, count = (np.frombuffer(b.column(c)[k].as_buffer(), kind).astype(np.int64) for c, kind in EDGES.items())
            total += own.expected(tuple(edges), count.astype(float), scores)
    ids = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(total[ids].astype(np.int64))], names=["piece", "n"])


def fitted(docs: DataFrame, path: str, n: int) -> np.ndarray:
    """estimated() over the parts of all texts."""
    own = Lattice(path, n)
    words = documents(docs).select("text").mapInArrow(lambda x: tidy(counted_words(x, lattice(path, n)), "lattices"), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    with scratch(docs.sparkSession):
        table = materialize(words.mapInArrow(lambda x: tidy(packed_edges(x, lattice(path, n)), "lattices"), ", ".join(f"{c} binary" for c in EDGES)), "edges")

        def expect(scores: np.ndarray | None) -> np.ndarray:
            found = table.mapInArrow(lambda x: tidy(expected_counts(x, lattice(path, n), scores), "lattices"), "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
            out = np.zeros(len(own.sizes))
            out[[r["piece"] for r in found]] = [r["n"] for r in found]
            return out

        return own.estimated(expect, EPOCHS)


SCHEMA = "doc_id long, n_pieces long, ids_crc32 array<long>, scores array<double>, decoded_crc32 long, round_trip boolean"


def encode_documents(docs: DataFrame, path: str | None = None, n: int = N) -> DataFrame:
    """Of every row: pieces of the best segmentation; checksums of the ids and scores of the n best; the best one decoded again."""
    path = path or vocabulary("piece_bpe_32k.model")
    scores = fitted(docs, path, n).round(6)
    types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.int64(), pa.bool_()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(path, n, scores)
        for b in batches:
            for i, j in slices(b.column("text")):
                part, out = b.slice(i, j - i), []
                texts = part.column("text")
                for doc_id, text, best in zip(part.column("doc_id").to_pylist(), texts, own.encode_all(texts), strict=True):
                    data = own.decode(np.frombuffer(best[0][1], "<u4"))[1:]
                    same = data == text.as_py().replace(MARK, " ").encode("utf-8", "surrogatepass")
                    out.append((doc_id, len(best[0][1]) // 4, [zlib.crc32(x) for _, x in best], [s for s, _ in best], zlib.crc32(data), same))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                trim()

    return documents(docs).mapInArrow(lambda batches: tidy(work(batches), "lattices"), SCHEMA)
