"""Benchmark decontamination by canonical templates.

Words lose case and outer punctuation. Windows of eight tokens of benchmark items
and of documents are joined by hash in two ways: as they are, and as templates,
in which numbers, names and units are typed placeholders and a run of one type is
one token. Matches of an item on one diagonal (document place minus item place,
runs of placeholders counted once), or on diagonals at most a window apart, are
put together, and the values behind the placeholders are compared: the same value
of the item must always stand for the same value of the document. Equal values
make a verbatim copy (words may be put in), a consistent change a re-parameterised
question; an inconsistent one is no match.

A capitalised word (not one in capitals) is a name unless it begins a text or a
line or follows the end of a sentence. Templates are also made without line
breaks as starts, without names, and with the first word of a window read the
other way. Windows with fewer than four plain words say too little as templates;
they match only as they are. An item is found by six windows, or half of all its
windows, or half of those that are templates. Items of fewer tokens than a window
are compared as a whole. Items of fewer than LEAST_TOKENS tokens ("yes", "Paris")
say too little to blame a document that holds them: they match nothing, and
`short_items` lists them.

Only document windows whose hash is in a bitmap of the benchmark's hashes (of
fixed size) are passed on to the join. Null and empty texts match nothing. Rows
without doc_id take part; repeated rows give the same rows once. Items without
id or text are left out. Empty tables give no rows. Further columns are left
alone.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from activity_timeline.llm.common import in_tasks, resident, row_key, stored, without_keys
from activity_timeline.llm.words import MIX, slices, token_hash, window_hashes, word_hashes

WINDOW = 8
PLAIN = 4            # plain words that a window needs
RUN = 6              # windows in a row (13 tokens) that are enough in a long item
LEAST_TOKENS = 5     # tokens of the shortest item that is looked for
BITS = 1 << 23       # size of the bitmap of benchmark hashes
KNOWN_WORDS = 250_000  # words whose canonical form a worker remembers

# fixed values: units of measure that follow a number
UNITS = frozenset("mm cm m km in ft yd mi g kg mg lb oz t ml l s ms min h d % ° °c °f hz khz mhz "
                  "ghz b kb mb gb tb v w kw a pa kpa bar j kj cal kcal mph kmh usd eur gbp $ € £ "
                  "dollars euros pounds meters metres miles inches feet hours minutes seconds days "
                  "weeks months years percent degrees grams kilograms liters litres".split())
NUMBER = re.compile(r"[+-]?[$€£]?\d+(?:[.,:/]\d+)*(?:st|nd|rd|th)?")
EDGES = "\"'`.,;:!?()[]{}<>|*_~“”‘’«»…—–-"
ENDS = tuple(".!?:")
QUOTES = "\"')]»”’"
SIGNS = tuple("+-$€£")
GLUED = re.compile(rf"({NUMBER.pattern})(\D+)")
PLAIN_WORD, NAME, NUMBERS, UNIT = range(4)
KIND_HASHES = np.array([0, *map(token_hash, ("\x00name", "\x00number", "\x00unit"))], np.uint64)
TEXT_END, LINE_END, LINE_ENDS = "\x01", "\x02", "\n\r\x0b\x0c\x85\u2028\u2029"


class Words:
    """Codes of raw words with what canonical tokens need to know of them."""

    def __init__(self):
        self.codes: dict[str, int] = {}
        self.raw: list[str] = []
        self.hash = np.zeros(1024, np.uint64)
        self.flags = np.zeros(1024, np.uint8)  # 1 number, 2 unit, 4 capital, 8 ends a sentence,
        #                                        16 no token, 32 number and unit in one
        self.parts: dict[int, tuple[int, int]] = {}  # codes of the number and of the unit
        self._add([TEXT_END, LINE_END])
        self.text_end, self.line_end = 0, 1
        self.flags[[self.text_end, self.line_end]] = 16

    def _add(self, words: list[str]) -> None:
        """Codes for words that have none yet; their hashes are worked out together."""
        first = len(self.raw)
        cores = [w.strip(EDGES) for w in words]
        lows = [c.lower() for c in cores]
        self.codes.update(zip(words, range(first, first + len(words))))
        self.raw += lows
        while len(self.raw) > len(self.hash):
            self.hash = np.concatenate([self.hash, np.zeros_like(self.hash)])
            self.flags = np.concatenate([self.flags, np.zeros_like(self.flags)])
        full = np.array([c != "" for c in lows], bool)
        own = np.zeros(len(words), np.uint64)
        own[full] = word_hashes(pa.array([c for c in lows if c], pa.string()))[0]
        self.hash[first:first + len(words)] = own
        self.flags[first:first + len(words)] = [self._flags(*x) for x in zip(words, cores, lows)]
        for at in (first + np.flatnonzero(self.flags[first:first + len(words)] & 32)).tolist():
            word, core = words[at - first], cores[at - first]
            number = GLUED.fullmatch(core)
            unit = word[word.index(core) + number.start(2):]  # with what ends a sentence
            missing = [w for w in dict.fromkeys((number[1], unit)) if w not in self.codes]
            if missing:
                self._add(missing)
            self.parts[at] = (self.codes[number[1]], self.codes[unit])

    @staticmethod
    def _flags(word: str, core: str, low: str) -> int:
        flags = 2 if low in UNITS else 0 if core else 16
        first = core[:1]
        if first.isupper():
            flags |= 0 if core.isupper() else 4
        elif first.isdecimal() or first in SIGNS:   # otherwise neither pattern can match
            if NUMBER.fullmatch(core):
                flags |= 1
            elif (glued := GLUED.fullmatch(core)) and glued[2].lower() in UNITS:
                flags |= 32
        return flags | (8 if word.rstrip(QUOTES)[-1:] in ENDS else 0)

    def encode(self, texts: list[str]) -> np.ndarray:
        """Codes of the words of all texts, of the ends of lines and of texts."""
        whole = f" {TEXT_END} ".join(t.replace(TEXT_END, " ") for t in texts)
        for end in LINE_ENDS:
            whole = whole.replace(end, f" {LINE_END} ")
        split = pc.utf8_split_whitespace(pa.array([whole], pa.large_string())).flatten()
        split = split.dictionary_encode()
        words = split.dictionary.to_pylist()
        new = [w for w in words if w not in self.codes]
        if new:
            self._add(new)
        own = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
        found = own[split.indices.to_numpy()]
        glued = np.flatnonzero(self.flags[found] & 32)
        if len(glued):
            pairs = np.array([self.parts[c] for c in found[glued].tolist()], np.int64)
            found[glued] = pairs[:, 0]
            found = np.insert(found, glued + 1, pairs[:, 1])
        return found


def _shared_words() -> list[Words]:
    return resident("words", lambda: [Words()])


class Tokens:
    """Tokens of some texts in a row, and their kinds in every reading."""

    def __init__(self, words: Words, texts: list[str]):
        codes = words.encode(texts)
        flags = words.flags[codes]
        text = np.cumsum(codes == words.text_end)
        real = np.flatnonzero((flags & 16) == 0)
        self.words, self.codes, self.text = words, codes[real], text[real]
        self.hashes, flags = words.hash[self.codes], flags[real]
        first = np.ones(len(real), bool)
        first[1:] = self.text[1:] != self.text[:-1]
        # what stands between a token and the one before it, that one included
        starts = first | self._since(((words.flags[codes] & 8) > 0), real)
        lines = starts | self._since(codes == words.line_end, real)
        number = (flags & 1) > 0
        unit = (flags & 2) > 0
        unit[:1] = False
        unit[1:] &= number[:-1] & ~first[1:]
        fixed = np.where(number, NUMBERS, np.where(unit, UNIT, PLAIN_WORD)).astype(np.int8)
        self.capital = ((flags & 4) > 0) & (fixed == PLAIN_WORD)
        by_sentence = np.where(self.capital & ~starts, NAME, fixed)
        by_line = np.where(self.capital & ~lines, NAME, fixed)
        self.readings = [by_sentence]
        if (by_sentence != by_line).any():
            self.readings.append(by_line)
        if (by_sentence == NAME).any():
            self.readings.append(fixed)   # case says nothing
        # places in which a run of placeholders is one, counted from the start of each text
        place = np.cumsum(self._begins(by_sentence)) - 1
        origin = np.maximum.accumulate(np.where(first, np.arange(len(real)), 0))
        self.place = place - place[origin] if len(real) else place

    @staticmethod
    def _since(marks: np.ndarray, real: np.ndarray) -> np.ndarray:
        """Whether there is a mark from the token before up to each token."""
        before = np.concatenate([[0], np.cumsum(marks)])[real]
        return before > np.concatenate([[-1], before[:-1]])[:len(real)]

    def _begins(self, kinds: np.ndarray) -> np.ndarray:
        begins = np.ones(len(kinds), bool)
        begins[1:] = ((kinds[1:] == PLAIN_WORD) | (kinds[1:] != kinds[:-1])
                      | (self.text[1:] != self.text[:-1]))
        return begins

    def verbatim(self, size: int):
        """Hashes of the windows of raw tokens, and their first tokens."""
        h = window_hashes(self.hashes, size) ^ np.uint64((size + 64) * MIX % 2**64)
        inside = np.flatnonzero(self.text[size - 1:] == self.text[:len(h)])
        return h[inside], inside

    def templates(self, sizes: list[int]):
        """Per reading and size: hashes of windows with enough plain words, their first tokens,
        which groups they begin with, whether the first word is read the other way; and the
        groups' first tokens and kinds."""
        for kinds in self.readings:
            starts = np.flatnonzero(self._begins(kinds))
            own = kinds[starts]
            hashes = np.where(own == PLAIN_WORD, self.hashes[starts], KIND_HASHES[own])
            text, plain = self.text[starts], own == PLAIN_WORD
            before = np.concatenate([[0], np.cumsum(plain)])
            alone = np.diff(np.append(starts, len(kinds))) == 1
            other = self.capital[starts] & alone
            for size in sizes:
                n = len(starts) - size + 1
                if n <= 0:
                    continue
                salt = np.uint64(size * MIX % 2**64)
                inside = text[size - 1:] == text[:n]
                n_plain = before[size:] - before[:-size]
                least = min(PLAIN, size)
                at = np.flatnonzero(inside & (n_plain >= least))
                h = window_hashes(hashes, size) ^ salt
                yield h[at], at, False, size, starts, own
                if kinds is self.readings[0]:
                    turned = n_plain + np.where(plain[:n], -1, 1)
                    at = np.flatnonzero(inside & other[:n] & (turned >= least))
                    if len(at):
                        swapped = np.where(plain[at], KIND_HASHES[NAME], self.hashes[starts[at]])
                        yield (window_hashes(hashes, size, at, swapped) ^ salt, at, True, size,
                               starts, own)

    def slots(self, at: int, turned: bool, size: int, starts: np.ndarray,
              kinds: np.ndarray) -> list[str]:
        """Values behind the placeholders of a window, in order; runs are joined."""
        out = []
        for g in range(at, at + size):
            if (kinds[g] != PLAIN_WORD) != (turned and g == at):
                stop = starts[g + 1] if g + 1 < len(starts) else len(self.codes)
                value = " ".join(self.words.raw[c] for c in self.codes[starts[g]:stop].tolist())
                out.append(value if len(value) <= 64 else f"\x00{token_hash(value)}")
        return out


MATCHES = "h bigint, at int, slots array<string>"


def _item_sizes(batches):
    words = Words()
    for batch in batches:
        sizes = [len(Tokens(words, [text]).codes) for text in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("item_id"), pa.array(sizes, pa.int64())],
                              names=["item_id", "n_tokens"])


def short_items(benchmark: DataFrame) -> DataFrame:
    """item_id, n_tokens of the items that are too short to be looked for (null: no tokens)."""
    texts = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    return (in_tasks(texts, _item_sizes, "item_id bigint, n_tokens bigint")
            .where(F.col("n_tokens") < LEAST_TOKENS))


def _item_windows(batches):
    words = Words()
    for batch in batches:
        rows = []
        for item, text in zip(batch.column("item_id").to_pylist(),
                              batch.column("text").to_pylist()):
            tokens = Tokens(words, [text])
            if len(tokens.codes) < LEAST_TOKENS:
                continue
            size = min(WINDOW, len(tokens.codes))
            found = {(int(x), s, True, size): [] for x, s in zip(
                *(a.tolist() for a in tokens.verbatim(size)))}
            total = len(found)
            for reading in tokens.readings:
                size = min(WINDOW, int(tokens._begins(reading).sum()))
                for h, at, turned, _, starts, kinds in tokens.templates([size]):
                    for x, g in zip(h.tolist(), at.tolist()):
                        found[int(x), int(starts[g]), False, size] = tokens.slots(
                            g, turned, size, starts, kinds)
            usable = len({s for _, s, whole, _ in found if not whole})
            place = tokens.place.tolist()
            rows += [(item, size, whole, total, usable, x - (x >> 63 << 64), s, place[s], slots)
                     for (x, s, whole, size), slots in found.items()]
        yield pa.record_batch(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate(
                [pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(),
                 pa.int32(), pa.int32(), pa.list_(pa.string())])],
            names=["item_id", "size", "whole", "n_windows", "n_usable", "h", "start", "at",
                   "slots"])


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    whole = benchmark.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    return in_tasks(whole, _item_windows, "item_id bigint, size int, whole boolean, n_windows int,"
                    " n_usable int, h bigint, start int, at int, slots array<string>")


def _document_windows(whole_sizes: list[int], sizes: list[int], bitmap: np.ndarray):
    def known(h: np.ndarray) -> np.ndarray:
        """Which hashes may be the benchmark's: two bits are set for each."""
        hit = np.arange(len(h))
        for shift in (0, 32):
            bit = (h[hit] >> np.uint64(shift) & np.uint64(BITS - 1)).astype(np.int64)
            hit = hit[(bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & 1) > 0]
        return hit

    def run(batches):
        shared = _shared_words()
        for whole in batches:
            for batch in slices(whole, "text"):
                if len(shared[0].raw) > KNOWN_WORDS:
                    shared[0] = Words()
                ids, keys, texts = (batch.column(c).to_pylist()
                                    for c in ("doc_id", "row_key", "text"))
                tokens = Tokens(shared[0], texts)
                found = {}
                for size in whole_sizes:
                    h, starts = tokens.verbatim(size)
                    for i in known(h).tolist():
                        found[int(h[i]), int(starts[i])] = []
                for h, at, turned, size, starts, kinds in tokens.templates(sizes):
                    for i in known(h).tolist():
                        g = int(at[i])
                        found[int(h[i]), int(starts[g])] = tokens.slots(
                            g, turned, size, starts, kinds)
                text = tokens.text
                of = [int(text[s]) for _, s in found]
                yield pa.record_batch(
                    [pa.array([ids[t] for t in of], pa.int64()),
                     pa.array([keys[t] for t in of], pa.int64()),
                     pa.array([x - (x >> 63 << 64) for x, _ in found], pa.int64()),
                     pa.array([int(tokens.place[s]) for _, s in found], pa.int32()),
                     pa.array(list(found.values()), pa.list_(pa.string()))],
                    names=["doc_id", "row_key", "h", "at", "slots"])
    return run


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """Bits of all benchmark hashes; at most BITS / 8 numbers reach the driver."""
    bits = F.array(*[F.expr(f"shiftrightunsigned(h, {n}) & {BITS - 1}") for n in (0, 32)])
    cells = (hashes.select(F.explode(bits).alias("bit")).distinct()
             .groupBy(F.shiftright("bit", 3).alias("cell"))
             .agg(F.expr("bit_or(shiftleft(1, cast(bit % 8 AS INT)))").alias("bits")))
    out = np.zeros(BITS // 8, np.uint8)
    for cell, bits in cells.toLocalIterator():
        out[cell] = bits
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, row_key, item_id, kind, n_matched, n_windows of the documents that hold items."""
    items = stored(benchmark_windows(benchmark), "items")
    sizes = items.select("whole", "size").distinct().collect()  # WINDOW at most
    run = _document_windows(sorted(s for whole, s in sizes if whole),
                            sorted(s for whole, s in sizes if not whole), _bitmap(items))
    keyed = docs.select("doc_id", row_key().alias("row_key"), "text").where("text IS NOT NULL")
    found = in_tasks(keyed, run, "doc_id bigint, row_key bigint, " + MATCHES)
    own = items.select("item_id", "whole", "n_windows", "n_usable", "h", "start",
                       F.col("at").alias("item_at"), F.col("slots").alias("item_slots"))
    joined = (found.join(own, "h").withColumn("diagonal", F.col("at") - F.col("item_at"))
              .where(F.size("slots") == F.size("item_slots")))
    # along a diagonal there are at most as many values as the item has tokens
    runs = joined.groupBy("row_key", "item_id", "diagonal").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_windows").alias("n_windows"),
        F.first("n_usable").alias("n_usable"), F.collect_set("start").alias("starts"),
        F.collect_set(F.when(~F.col("whole"), F.col("start"))).alias("usable"),
        F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("item_slots", "slots"))))
        .alias("pairs"))
    near = (Window.partitionBy("row_key", "item_id").orderBy("diagonal")
            .rangeBetween(-WINDOW, WINDOW))

    def judged(over) -> Column:
        """n_matched and kind of a diagonal, or of the near ones together; null if no match."""
        starts, usable, pairs = (over(c) for c in ("starts", "usable", "pairs"))
        values = F.size(F.array_distinct(F.transform(pairs, lambda p: p["item_slots"])))
        changed = F.exists(pairs, lambda p: p["item_slots"] != p["slots"])

        def enough(matched: Column, n: str) -> Column:
            return F.size(matched) >= F.least(F.lit(RUN), F.ceil(F.col(n) * 0.5))

        ok = ((enough(starts, "n_windows") | ((F.col("n_usable") > 0) & enough(usable, "n_usable")))
              & (values == F.size(pairs)))
        return F.when(ok, F.struct(
            F.size(starts).cast("bigint").alias("n_matched"),
            F.when(changed, "reparameterised").otherwise("verbatim").alias("kind")))

    together = runs.select("*", *[
        F.array_distinct(F.flatten(F.collect_list(c).over(near))).alias(f"near_{c}")
        for c in ("starts", "usable", "pairs")])
    best = F.greatest(judged(F.col), judged(lambda c: F.col(f"near_{c}")))
    kept = together.withColumn("best", best).where("best IS NOT NULL")
    return (kept.groupBy("row_key", "item_id")
            .agg(F.first("doc_id").alias("doc_id"), F.max("best").alias("best"),
                 F.first("n_windows").alias("n_windows"))
            .select("doc_id", "row_key", "item_id", "best.kind", "best.n_matched", "n_windows"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, all columns as they were."""
    bad = stored(contaminated(docs, benchmark).select("row_key").distinct(), "contaminated")
    kept = without_keys(docs.select(row_key().alias("row_key"), F.struct("*").alias("row")), bad)
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
