"""SentencePiece encoding and decoding by suffix-array matching.

Texts are cut into chunks that no piece can cross (before a space that follows
another character, and around line breaks). The chunks of a batch that the
worker has not met yet are put in a row and indexed by a suffix array, sorted to
the depth of the longest piece. Every piece of the vocabulary is looked up in it
by binary search, which gives its range of occurrences; each is an edge from one
position to another. The edges are sorted by position and then relaxed.

The vocabulary is a BPE model, so relaxation takes edges in the order of their
scores: of all edges that join two neighbouring symbols of a chunk, the best one
(leftmost if equal) is taken, until none is left. A shortest path over the same
edges would not give the ids of the model. Characters without a piece become
their bytes.

Null texts have null ids; the empty text has none. The character U+2581 is the
model's own sign for a space and is decoded as one. Rows without doc_id and
repeated rows are rows like others. Empty tables give no rows. Further columns
are left alone.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from activity_timeline.llm.common import in_tasks, resident
from activity_timeline.llm.words import slices

SPACE = "▁"
CHUNK = re.compile(r"\n| *[^ \n]+| +")
WIDE = 32            # longest chunk that is relaxed together with others
REMEMBER = 120_000   # chunks whose ids a worker remembers
INDEXED_BYTES = 1 << 20  # text that is indexed at once
NONE = np.iinfo(np.int32).max
BYTE_LETTERS = 254   # characters of a text that still fit bytes
PIECE_BITS = 20      # a piece's number in a sorted edge


@dataclass
class Vocabulary:
    """Pieces of a BPE model: text, id and rank (0 is the best score); ids of the 256 bytes."""
    pieces: np.ndarray
    after: np.ndarray      # the first text beyond all that begin with the piece
    lengths: np.ndarray
    ids: np.ndarray
    ranks: np.ndarray
    bytes_at: np.ndarray
    table: list[bytes]     # what each id stands for
    longest: int
    points: np.ndarray     # code points of the pieces, 0 behind their ends


def read_vocabulary(model_file: str) -> Vocabulary:
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    size = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(size)]
    is_byte = [model.is_byte(i) for i in range(size)]
    special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
               for i in range(size)]
    plain = [i for i in range(size) if not special[i] and not is_byte[i]]
    scores = np.array([model.get_score(i) for i in plain])
    ranks = np.empty(len(plain), np.int32)
    ranks[np.lexsort((np.arange(len(plain)), -scores))] = np.arange(len(plain))
    bytes_at = np.zeros(256, np.int32)
    table = [b""] * size
    for i in range(size):
        if is_byte[i]:
            bytes_at[int(names[i][3:5], 16)] = i
            table[i] = bytes([int(names[i][3:5], 16)])
        elif not special[i]:
            table[i] = names[i].replace(SPACE, " ").encode()
    if any("\n" in names[i] or SPACE in names[i].lstrip(SPACE) for i in plain):
        raise ValueError("pieces of this model cross spaces or lines")
    spelled = [names[i] for i in plain]
    whole = np.array(spelled)
    longest = max(len(p) for p in spelled)
    return Vocabulary(whole, np.array([p[:-1] + chr(ord(p[-1]) + 1) for p in spelled]),
                      np.array([len(p) for p in spelled]), np.array(plain, np.int32), ranks,
                      bytes_at, table, longest, whole.view(np.uint32).reshape(-1, longest))


def suffix_array(points: np.ndarray, chunk: np.ndarray, depth: int) -> np.ndarray:
    """Order of all suffixes by their first `depth` characters inside their chunk.

    By doubling: ranks of 2, 4, 8 ... characters from pairs of ranks.
    """
    n = len(points)
    rank = np.unique(points, return_inverse=True)[1].astype(np.int64) + 1
    size = 1
    while size < depth:
        after = np.zeros(n, np.int64)
        same = chunk[:-size] == chunk[size:] if n > size else np.zeros(0, bool)
        after[:n - size][same] = rank[size:][same]
        rank = np.unique(rank * (n + 2) + after, return_inverse=True)[1].astype(np.int64) + 1
        size *= 2
    return np.argsort(rank, kind="stable")


def _spelled(points: np.ndarray, words: Vocabulary):
    """The text in an alphabet of its own, of bytes if it has few enough characters; and the
    pieces, and the first texts beyond those that begin with them, in the same one.

    Also which pieces these are: those with other characters cannot occur.
    """
    alphabet = np.unique(points)
    if len(alphabet) > BYTE_LETTERS:
        return points, np.uint32, words.pieces, words.after, np.arange(len(words.pieces))
    at = np.minimum(np.searchsorted(alphabet, words.points), len(alphabet) - 1)
    inside = (alphabet[at] == words.points) | (words.points == 0)
    possible = np.flatnonzero(inside.all(axis=1))
    low = np.where(words.points[possible] > 0, at[possible] + 1, 0).astype(np.uint8)
    high = low.copy()
    high[np.arange(len(high)), words.lengths[possible] - 1] += 1
    kind = f"S{words.longest}"
    return ((np.searchsorted(alphabet, points) + 1).astype(np.uint8), np.uint8,
            low.view(kind).ravel(), high.view(kind).ravel(), possible)


def edges(points: np.ndarray, chunk: np.ndarray, words: Vocabulary):
    """All occurrences of pieces, sorted by position and length: key, number of the piece.

    key is position * 64 + length.
    """
    order = suffix_array(points, chunk, words.longest)
    n, deep = len(points), words.longest
    text, unit, pieces, after, possible = _spelled(points, words)
    head = np.zeros((n, deep), unit)
    for i in range(min(deep, n)):
        same = chunk[:n - i] == chunk[i:]
        head[:n - i, i][same] = text[i:][same]
    heads = head.view(f"{'S' if unit is np.uint8 else 'U'}{deep}").ravel()[order]
    low = np.searchsorted(heads, pieces, "left")
    high = np.searchsorted(heads, after, "left")
    del heads, head
    counts = high - low
    piece = np.repeat(possible, counts)
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    key = order[np.repeat(low, counts) + place] * 64 + words.lengths[piece]
    both = np.sort(key << PIECE_BITS | piece)
    return both >> PIECE_BITS, both & ((1 << PIECE_BITS) - 1)


class Edges:
    """Edges sorted by position and length, found by counting those before on their position."""

    def __init__(self, keys: np.ndarray, pieces: np.ndarray, ranks: np.ndarray, n: int):
        at, self.pieces, self.ranks = keys >> 6, pieces, ranks[pieces]
        self.first = np.searchsorted(at, np.arange(n + 1))
        self.lengths = np.zeros(n + 1, np.uint64)   # bit i: there is an edge of length i
        runs = self.first[:n][np.diff(self.first) > 0]
        if len(runs):
            bits = np.uint64(1) << (keys & 63).astype(np.uint64)
            self.lengths[at[runs]] = np.bitwise_or.reduceat(bits, runs)

    def _find(self, at: np.ndarray, length: np.ndarray):
        bit = np.uint64(1) << np.minimum(length, 63).astype(np.uint64)
        own = self.lengths[at]
        hit = (own & bit) > 0
        return self.first[at] + np.bitwise_count(own & (bit - np.uint64(1))), hit

    def _of(self, values: np.ndarray, at, length, none: int) -> np.ndarray:
        i, hit = self._find(at, length)
        out = np.full(len(at), none, np.int64)
        out[hit] = values[i[hit]]
        return out

    def rank(self, at, length):
        return self._of(self.ranks, at, length, NONE)

    def piece(self, at, length):
        """Number of the piece, -1 if there is none."""
        return self._of(self.pieces, at, length, -1)


def relax(starts: np.ndarray, sizes: np.ndarray, found: Edges) -> np.ndarray:
    """Length of the symbol that begins at each place of each chunk (0 inside a symbol)."""
    n, width = len(starts), int(sizes.max())
    columns = np.arange(width)
    length = (columns < sizes[:, None]).astype(np.int32)
    before = np.broadcast_to(columns - 1, (n, width)).astype(np.int32).copy()
    at = starts[:, None] + columns
    rank = np.full((n, width), NONE, np.int32)
    pair = columns < sizes[:, None] - 1
    rank[pair] = found.rank(at[pair], np.full(int(pair.sum()), 2))
    rows = np.arange(n)
    while len(rows):
        place = np.argmin(rank[rows], axis=1)
        live = rank[rows, place] != NONE
        rows, place = rows[live], place[live]
        if not len(rows):
            break
        right = place + length[rows, place]
        joined = length[rows, place] + length[rows, right]
        length[rows, place], length[rows, right] = joined, 0
        rank[rows, right] = NONE
        after = place + joined
        more = after < sizes[rows]
        rank[rows[~more], place[~more]] = NONE
        r, p, a = rows[more], place[more], after[more]
        before[r, a] = p
        rank[r, p] = found.rank(starts[r] + p, joined[more] + length[r, a])
        left = place > 0
        r, p = rows[left], before[rows[left], place[left]]
        rank[r, p] = found.rank(starts[r] + p, length[r, p] + joined[left])
    return length


def relax_long(start: int, size: int, found: Edges) -> np.ndarray:
    """The same for one long chunk, with a heap of edges."""
    length = np.ones(size, np.int64)
    before, after = np.arange(-1, size - 1), np.arange(1, size + 1)
    first = found.rank(np.arange(start, start + size - 1), np.full(size - 1, 2))
    heap = [(int(first[i]), i, 1, 1) for i in np.flatnonzero(first != NONE).tolist()]
    heapq.heapify(heap)

    def push(left: int) -> None:
        right = after[left]
        if right < size:
            a, b = int(length[left]), int(length[right])
            rank = int(found.rank(np.array([start + left]), np.array([a + b]))[0])
            if rank != NONE:
                heapq.heappush(heap, (rank, left, a, b))

    while heap:
        _, left, a, b = heapq.heappop(heap)
        right = int(after[left])
        if length[left] != a or right >= size or length[right] != b:
            continue
        length[left], length[right] = a + b, 0
        after[left] = after[right]
        if after[left] < size:
            before[after[left]] = left
        push(left)
        if before[left] >= 0:
            push(int(before[left]))
    return length


def encode_chunks(chunks: list[str], words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all chunks in a row, and where those of each begin (one more at the end)."""
    sizes = np.array([len(c) for c in chunks], np.int64)
    points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum(sizes) - sizes
    chunk = np.repeat(np.arange(len(chunks)), sizes)
    found = Edges(*edges(points, chunk, words), words.ranks, len(points))
    length = np.zeros(len(points), np.int64)
    short = np.flatnonzero(sizes <= WIDE)
    for group in np.array_split(short[np.argsort(sizes[short], kind="stable")],
                                max(1, len(short) // 20_000)):
        if len(group):
            solved = relax(starts[group], sizes[group], found)
            inside = np.arange(solved.shape[1]) < sizes[group][:, None]
            length[(starts[group][:, None] + np.arange(solved.shape[1]))[inside]] = solved[inside]
    for i in np.flatnonzero(sizes > WIDE).tolist():
        length[starts[i]:starts[i] + sizes[i]] = relax_long(int(starts[i]), int(sizes[i]), found)
    at = np.flatnonzero(length)
    piece = found.piece(at, length[at])
    ids = np.where(piece >= 0, words.ids[piece], -1)
    owner = chunk[at]
    missing = np.flatnonzero(ids < 0)
    if len(missing):
        spelled = [chr(points[at[i]]).encode("utf-8", "replace") for i in missing.tolist()]
        repeat = np.ones(len(at), np.int64)
        repeat[missing] = [len(b) for b in spelled]
        first = np.cumsum(repeat) - repeat
        ids, owner = np.repeat(ids, repeat), np.repeat(owner, repeat)
        for i, b in zip(missing.tolist(), spelled):
            ids[first[i]:first[i] + len(b)] = words.bytes_at[list(b)]
    return ids.astype(np.int32), np.searchsorted(owner, np.arange(len(chunks) + 1))


class Encoder:
    """Encodes batches; remembers the ids of chunks it has met."""

    def __init__(self, words: Vocabulary):
        self.words = words
        self.known: dict[str, int] = {}
        self.ids, self.begins = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.met = np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Forget all chunks but those that were met again, or all if these are too many."""
        often = self.met > 1
        kept = [(c, i) for c, i in self.known.items() if often[i]]
        if len(kept) > REMEMBER // 2:
            kept = []
        codes = np.array([i for _, i in kept], np.int64)
        ids = self._gather(codes)
        counts = self.begins[codes + 1] - self.begins[codes]
        self.known = {c: i for i, (c, _) in enumerate(kept)}
        self.ids, self.begins = ids, np.concatenate([[0], np.cumsum(counts)])
        self.met = np.zeros(len(kept), np.int64)

    def _learn(self, new: list[str]) -> None:
        """Ids of chunks that are not known; about INDEXED_BYTES of text are indexed at once."""
        ends = np.cumsum([len(c) for c in new])
        at = 0
        while at < len(new):
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + INDEXED_BYTES, "right")))
            block = new[at:stop]
            ids, begins = encode_chunks([c.replace(" ", SPACE) for c in block], self.words)
            first = len(self.begins) - 1
            self.known.update(zip(block, range(first, first + len(block))))
            self.begins = np.concatenate([self.begins, begins[1:] + self.begins[-1]])
            self.ids = np.concatenate([self.ids, ids])
            at = stop
        self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        if len(self.known) > REMEMBER:
            self._forget()
        cut = [CHUNK.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        new = set().union(*cut) - self.known.keys()
        if new:
            self._learn(sorted(new))
        get = self.known.__getitem__
        codes = [np.fromiter(map(get, c), np.int64, len(c)) for c in cut]
        for c in codes:
            self.met[np.unique(c)] += 1   # in how many texts
        return [None if t is None else self._gather(c) for t, c in zip(texts, codes)]

    def _gather(self, codes: np.ndarray) -> np.ndarray:
        first = self.begins[codes]
        counts = self.begins[codes + 1] - first
        total = int(counts.sum())
        shift = np.repeat(first - (np.cumsum(counts) - counts), counts)
        return self.ids[shift + np.arange(total)]


def decode(ids: np.ndarray | None, words: Vocabulary) -> str | None:
    if ids is None:
        return None
    table = words.table
    spelled = b"".join([table[i] for i in ids.tolist()])
    return spelled.decode("utf-8", "replace")[1:] if spelled[:1] == b" " else \
        spelled.decode("utf-8", "replace")


def restores(text: str | None, ids: np.ndarray | None, words: Vocabulary) -> bool | None:
    """Whether decoding gives the text, but for the sign that the model takes for a space."""
    return None if text is None else decode(ids, words) == text.replace(SPACE, " ")


def _encoder(model_name: str) -> Encoder:
    """One encoder for each worker process and model."""
    return resident(("pieces", model_name),
                    lambda: Encoder(read_vocabulary(SparkFiles.get(model_name))))


def _ship(docs: DataFrame, model_file: str) -> str:
    docs.sparkSession.sparkContext.addFile(model_file)
    return model_file.rsplit("/", 1)[-1]


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_ids, ids, restored (decoding gives the text back) of every document."""
    name = _ship(docs, model_file)

    def run(batches):
        encoder = _encoder(name)
        for whole in batches:
            for batch in slices(whole, "text", INDEXED_BYTES):
                texts = batch.column("text").to_pylist()
                found = encoder.encode(texts)
                yield pa.record_batch(
                    [batch.column("doc_id"),
                     pa.array([None if x is None else len(x) for x in found], pa.int64()),
                     pa.array(found, pa.list_(pa.int32())),
                     pa.array([restores(t, x, encoder.words) for t, x in zip(texts, found)],
                              pa.bool_())],
                    names=["doc_id", "n_ids", "ids", "restored"])

    return in_tasks(docs.select("doc_id", "text"), run,
                    "doc_id bigint, n_ids bigint, ids array<int>, restored boolean")


def decode_ids(encoded: DataFrame, model_file: str) -> DataFrame:
    """doc_id, text of (doc_id, ids)."""
    name = _ship(encoded, model_file)

    def run(batches):
        words = _encoder(name).words
        for batch in batches:
            lists = [None if x is None else np.array(x, np.int64)
                     for x in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"),
                                   pa.array([decode(x, words) for x in lists], pa.string())],
                                  names=["doc_id", "text"])

    return in_tasks(encoded.select("doc_id", "ids"), run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_ids, ids_sha256 (little-endian 32-bit numbers), restored: decoding gives the text."""
    name = _ship(docs, model_file)

    def run(batches):
        encoder = _encoder(name)
        for whole in batches:
            for batch in slices(whole, "text", INDEXED_BYTES):
                rows = []
                texts = batch.column("text").to_pylist()
                for text, ids in zip(texts, encoder.encode(texts)):
                    if text is None:
                        rows.append((None, None, None))
                        continue
                    same = restores(text, ids, encoder.words)
                    rows.append((len(ids), hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(),
                                 same))
                yield pa.record_batch(
                    [batch.column("doc_id"), *[pa.array([r[i] for r in rows], t) for i, t in
                                               enumerate([pa.int64(), pa.string(), pa.bool_()])]],
                    names=["doc_id", "n_ids", "ids_sha256", "restored"])

    return in_tasks(docs.select("doc_id", "text"), run,
                    "doc_id bigint, n_ids bigint, ids_sha256 string, restored boolean")
