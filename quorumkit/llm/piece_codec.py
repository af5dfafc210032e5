"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

SPACE = "▁"
#: Symbols from here on stand for characters that are no piece of their own: OTHER + code point.
OTHER = 1 << 21
#: Texts of a step hold so many characters; stretches longer than HEAP_FROM use the heap.
STEP_CHARS, HEAP_FROM = 120_000, 256
#: Characters with a table of pairs; the last number stands for all others.
CLASSES = 512
#: Ids of stretches that are remembered; beyond, all are forgotten.
MEMO_IDS = 1_000_000
_NEVER = np.int64(2**62)
_LOW = np.int64(2**32 - 1)


class PieceCodec:
    """Encodes with an agenda of adjacent symbol pairs: the pair whose joint piece scores highest merges
    first, of equal scores the leftmost, until no joint piece is left. Characters that are no piece
    become byte pieces.

    A text falls into stretches where two neighbours stand together in no piece: no merge reaches over
    such a place, so the stretches have agendas of their own. All new stretches of a step pop the head of
    their agendas together, in numpy; long ones use a heap. The ids of stretches are remembered. Covers models with the identity normaliser,
    a dummy prefix, byte fallback and no user-defined or unused pieces; others raise ValueError.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, kinds = model.normalizer_spec, proto.ModelProto.SentencePiece
        if norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only the identity normaliser with a dummy prefix is covered")
        if not model.trainer_spec.byte_fallback or model.trainer_spec.model_type != model.trainer_spec.BPE or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("only BPE with byte fallback and plain pieces is covered")
        ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        rank = {s: r for r, s in enumerate(sorted({-model.pieces[i].score for i in ids.values()}))}
        self.byte_id, raw = [0] * 256, []
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                self.byte_id[int(p.piece[3:-1], 16)] = i
                raw.append(bytes([int(p.piece[3:-1], 16)]))
            else:
                raw.append({kinds.CONTROL: "", kinds.UNKNOWN: " ⁇ "}.get(p.type, p.piece.replace(SPACE, " ")).encode())
        self.raw, self.raw_size = np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        self.char_id = {s: i for s, i in ids.items() if len(s) == 1}
        self.together = {s[k : k + 2] for s in ids for k in range(len(s) - 1)}

        def symbol(s: str) -> int | None:
            return ids.get(s, OTHER + ord(s) if len(s) == 1 else None)

        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for s, i in ids.items():
            for k in range(1, len(s)):
                a, b = symbol(s[:k]), symbol(s[k:])
                if a is not None and b is not None:
                    self.merge[a, b] = rank[-model.pieces[i].score], i
        self.keys = np.array([a << 32 | b for a, b in self.merge], dtype=np.int64)
        self.ranks = np.array([r for r, _ in self.merge.values()], dtype=np.int64)
        self.made = np.array([i for _, i in self.merge.values()], dtype=np.int32)
        self.hash_at = self._hash_table(1 << (4 * len(self.keys)).bit_length())
        self.class_of = np.full(0x110000, -1, np.int16)
        self.chars: list[str] = []
        self.memo: dict[str, bytes] = {}  # the ids of stretches that have been encoded
        self.held, self.noise = 0, np.zeros(0, np.uint64)
        self.symbol_of = np.zeros(CLASSES, np.int32)
        self.pairs = np.full((CLASSES, CLASSES), -1, np.int32)  # the place of a pair in keys, -1: never merges, -2: in no piece

    def _hash_table(self, slots: int) -> np.ndarray:
        """Open addressing: the place of each key in self.keys, -1 where a slot is free."""
        self.shift = np.uint64(64 - (slots.bit_length() - 1))
        at, table, left = self._slot(self.keys), np.full(slots, -1, np.int32), np.arange(self.keys.size)
        while left.size:
            free = table[at[left]] < 0
            _, first = np.unique(at[left[free]], return_index=True)
            taken = left[free][first]
            table[at[taken]] = taken
            left = np.setdiff1d(left, taken, assume_unique=True)
            at[left] = (at[left] + 1) % slots
        return table

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def _found(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair in self.keys, -1 for pairs that never merge."""
        want = left.astype(np.int64) << 32 | right
        at = self._slot(want)
        got = self.hash_at[at]
        open_ = np.flatnonzero((self.keys[got] != want) & (got >= 0))
        while open_.size:
            at[open_] = (at[open_] + 1) % self.hash_at.size
            got[open_] = self.hash_at[at[open_]]
            open_ = open_[(got[open_] >= 0) & (self.keys[got[open_]] != want[open_])]
        return got

    def _add_class(self, char: str) -> None:
        n = len(self.chars)
        if n == CLASSES - 1:
            self.class_of[ord(char)] = n
            return
        self.chars.append(char)
        self.class_of[ord(char)] = n
        self.symbol_of[n] = self.char_id.get(char, OTHER + ord(char))
        every, own = self.symbol_of[: n + 1], np.full(n + 1, self.symbol_of[n])
        self.pairs[: n + 1, n], self.pairs[n, : n + 1] = self._found(every, own), self._found(own, every)
        for m, c in enumerate(self.chars):
            if c + char not in self.together:
                self.pairs[m, n] = -2
            if char + c not in self.together:
                self.pairs[n, m] = -2

    def _by_heap(self, s: list[int]) -> list[int]:
        """The agenda of one long stretch as a heap; -1 where a symbol went into the one before it."""
        n, after, before, merge = len(s), list(range(1, len(s) + 1)), list(range(-1, len(s) - 1)), self.merge
        agenda = [(m[0], i, s[i], s[i + 1], m[1]) for i in range(n - 1) if (m := merge.get((s[i], s[i + 1])))]
        heapify(agenda)
        while agenda:
            _, i, a, b, made = heappop(agenda)
            j = after[i]
            if s[i] != a or j >= n or s[j] != b:
                continue
            s[i], s[j], after[i] = made, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if m := merge.get((made, s[after[i]])):
                    heappush(agenda, (m[0], i, made, s[after[i]], m[1]))
            if before[i] >= 0 and (m := merge.get((s[before[i]], made))):
                heappush(agenda, (m[0], before[i], s[before[i]], made, m[1]))
        return s

    def _first_pairs(self, points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol of each character, and the place in keys of its pair with the next one (-1: never merges, -2: a stretch ends)."""
        classes = self.class_of[points]
        if (classes < 0).any():
            for p in np.unique(points[classes < 0]):
                self._add_class(chr(p))
            classes = self.class_of[points]
        n = points.size
        symbol = np.append(self.symbol_of[classes], np.int32(-1))
        found = np.append(self.pairs.ravel()[classes[:-1].astype(np.int32) * CLASSES + classes[1:]], np.int32(-2))
        rare = np.flatnonzero(classes == CLASSES - 1)
        if rare.size:
            symbol[rare] = [self.char_id.get(c, OTHER + ord(c)) for c in map(chr, points[rare])]
            near = np.unique(np.concatenate((rare, rare[rare > 0] - 1)))
            near = near[near < n - 1]
            found[near] = self._found(symbol[near], symbol[near + 1])
        found[ends - 1] = -2
        return symbol, found

    def _symbols(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The symbols that are left of each character after all merges, -1 where none is; texts end at `ends`."""
        n = points.size
        symbol, found = self._first_pairs(points, ends)
        last = found == -2
        part = np.append(np.cumsum(last) - last, -1).astype(np.int32)  # the stretch of each character
        begins = np.concatenate(([0], np.flatnonzero(last)[:-1] + 1))
        sizes = np.diff(np.append(begins, n))
        key = np.where(found >= 0, self.ranks[found] << 32 | np.arange(n), _NEVER)
        for k in np.flatnonzero(sizes > HEAP_FROM):
            lo, hi = begins[k], begins[k] + sizes[k]
            symbol[lo:hi] = self._by_heap(symbol[lo:hi].tolist())
            key[lo:hi] = _NEVER
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        live = np.flatnonzero(np.minimum.reduceat(key, begins) < _NEVER)
        open_ = np.zeros(begins.size + 1, bool)
        open_[live] = True
        at = np.flatnonzero(open_[part[:-1]])
        while at.size:
            own = part[at]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            head = np.minimum.reduceat(key[at], first)
            going = head < _NEVER
            i = (head[going] & _LOW).astype(np.int64)
            j = after[i]
            k = after[j]
            made = self.made[found[i]]
            symbol[i], symbol[j], key[j], after[i], before[k] = made, -1, _NEVER, k, i
            for left, right in ((i, k), (before[i], i)):
                key_at = left if right is k else left[left >= 0]
                to = right if right is k else right[left >= 0]
                near = np.flatnonzero(part[key_at] == part[to])
                if right is k:
                    key[i] = _NEVER
                x, y = key_at[near], to[near]
                got = self._found(symbol[x], symbol[y])
                found[x] = got
                key[x] = np.where(got >= 0, self.ranks[got] << 32 | x, _NEVER)
            keep = symbol[at] >= 0
            if not going.all():
                keep &= np.repeat(going, np.diff(np.append(first, at.size)))
            at = at[keep]
        return symbol[:-1]

    def _by_agenda(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts in a row, and how many each has; no merge reaches from one part into the next."""
        points = np.frombuffer("".join(parts).encode("utf-32-le"), "<u4")
        ends = np.cumsum([len(t) for t in parts])
        symbols = self._symbols(points, ends)
        alive = symbols >= 0
        width = alive.astype(np.int64)
        odd = np.flatnonzero(symbols >= OTHER)
        width[odd] = [len(chr(c).encode()) for c in (symbols[odd] - OTHER).tolist()]
        total = np.cumsum(width)
        out = np.repeat(symbols[alive], width[alive])
        for c in np.unique(symbols[odd]).tolist():
            begin = total[odd[symbols[odd] == c]] - len(data := chr(c - OTHER).encode())
            for k, b in enumerate(data):
                out[begin + k] = self.byte_id[b]
        return out.astype("<i4"), np.diff(total[ends - 1], prepend=0)

    def _marks(self, points: np.ndarray, cuts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """64 bits for each stretch: the sum of its characters, each times the noise of its place."""
        if (longest := int(sizes.max())) > self.noise.size:
            self.noise = np.random.default_rng(5).integers(1, 2**64, 2 * longest, dtype=np.uint64) | np.uint64(1)
        place = np.arange(points.size) - np.repeat(cuts - sizes, sizes)
        mixed = (points + np.uint64(1)) * self.noise[place]
        return np.add.reduceat(mixed ^ (mixed >> np.uint64(29)), cuts - sizes)

    def _different(self, points: np.ndarray, cuts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Stretches that stand for all, and for each stretch the place of the one of them that has the same characters.

        Marks bring stretches together; one whose characters aren't those of the first with its mark stands for itself.
        """
        _, first, which = np.unique(self._marks(points, cuts, sizes), return_index=True, return_inverse=True)
        begin, chief = cuts - sizes, first[which]
        near = np.repeat(begin[chief] - begin, sizes) + np.arange(points.size)
        alien = np.logical_or.reduceat(points[np.minimum(near, points.size - 1)] != points, begin) | (sizes[chief] != sizes)
        if alien.any():
            alone = np.flatnonzero(alien)
            which[alone] = first.size + np.arange(alone.size)
            first = np.concatenate((first, alone))
        return first, which

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has.

        Stretches recur from text to text, most of them words: an agenda runs once for each that isn't remembered.
        """
        counts = np.zeros(len(texts), np.int64)
        full = [k for k, t in enumerate(texts) if t]
        if not full:
            return np.zeros(0, np.int32), counts
        marked = [SPACE + texts[k].replace(" ", SPACE) for k in full]
        joined = "".join(marked)
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        ends = np.cumsum([len(t) for t in marked])
        cuts = np.flatnonzero(self._first_pairs(points, ends)[1] == -2) + 1
        sizes = np.diff(cuts, prepend=0)
        first, which = self._different(points, cuts, sizes)
        stop = cuts[first]
        keys = [joined[i:j] for i, j in zip((stop - sizes[first]).tolist(), stop.tolist())]
        got = list(map(self.memo.get, keys))
        missing = [k for k, g in enumerate(got) if g is None]
        if missing:
            ids, n = self._by_agenda([keys[k] for k in missing])
            raw, stops = ids.tobytes(), (4 * np.cumsum(n)).tolist()
            for k, i, j in zip(missing, [0, *stops], stops):
                got[k] = self.memo[keys[k]] = raw[i:j]
            self.held += ids.size
            if self.held > MEMO_IDS:
                self.memo, self.held = {}, 0
        width = np.fromiter(map(len, got), np.int64, len(got)) // 4
        each = width[which]
        total = np.cumsum(each)
        at = np.repeat((np.cumsum(width) - width)[which] - (total - each), each) + np.arange(total[-1])
        counts[full] = np.diff(total[np.searchsorted(cuts, ends)], prepend=0)
        return np.frombuffer(b"".join(got), "<i4")[at], counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of ids in a row: pieces joined, bytes read as UTF-8, without the space of the dummy prefix."""
        size = self.raw_size[ids]
        total = np.concatenate(([0], np.cumsum(size)))
        data = self.raw[np.repeat(self.raw_at[ids] - total[:-1], size) + np.arange(total[-1])].tobytes()
        cuts = total[np.concatenate(([0], np.cumsum(counts)))].tolist()
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:])]
        return [t[1:] if t.startswith(" ") else t for t in texts]


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def _steps(texts: list[str]) -> Iterator[tuple[int, int]]:
    at, chars = 0, 0
    for k, t in enumerate(texts):
        chars += len(t)
        if chars >= STEP_CHARS:
            yield at, k + 1
            at, chars = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def checked(c: PieceCodec, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], list[bool]]:
    """The ids of all texts in a row, where each text's begin and the last one's end, what they decode to, and whether the
    library says the same of each text. The agenda's ids stand, but for texts on which it and the library differ."""
    ids, counts = c.encode(texts)
    decoded = c.decode(ids, counts)
    lists = c.library.encode(texts, num_threads=1)
    plain = c.library.decode(lists, num_threads=1)
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    if np.array_equal(counts, sizes) and decoded == plain and np.array_equal(ids, np.fromiter(chain.from_iterable(lists), "<i4", int(sizes.sum()))):
        return ids, np.concatenate(([0], np.cumsum(counts))), decoded, [True] * len(texts)
    own = np.split(ids, np.cumsum(counts)[:-1])
    agrees = [x.tolist() == y and t == u for x, y, t, u in zip(own, lists, decoded, plain)]
    own = [x if same else np.array(y, "<i4") for x, y, same in zip(own, lists, agrees)]
    text = [t if same else u for t, u, same in zip(decoded, plain, agrees)]
    return np.concatenate(own), np.concatenate(([0], np.cumsum([x.size for x in own]))), text, agrees


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ids (array<int>), decoded (string), agrees (boolean).

    ids are those of the sentencepiece library for the model file at `path` (which every executor can
    open), without begin or end ids. They come from PieceCodec's agenda, and so does the decoded text. The library
    checks every text: one on which it differs takes the library's ids and decoding, and its `agrees` is false.
    A null text counts as empty; an empty one has no ids and decodes to an empty text.
    Repeated rows each have a row; an empty table gives none; other columns are not read.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in _steps(texts):
                ids, ends, text, agrees = checked(c, texts[lo:hi])
                made = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)), pa.array(text, pa.string()), pa.array(agrees, pa.bool_())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *made], names=["doc_id", "ids", "decoded", "agrees"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string, agrees boolean")
