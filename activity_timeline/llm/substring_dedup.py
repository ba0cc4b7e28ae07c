"""Substring dedup: words covered by windows that also start elsewhere are removed.

A window of `size` words is an edge of a de Bruijn graph over words. Edges are
dealt out by their minimizer (the smallest hash of the six-word pieces they
hold), so that all occurrences of an edge meet: a text becomes runs of windows
with one minimizer, one row each. In the task that holds a minimizer the rows
are sorted by it and streamed; windows that occur more than once are repeated
edges. Repeated edges that follow each other both in the text and in the text of
their first occurrence are a path without a branch, and come out as one row.
Paths that were cut between minimizers are put together per document by Spark.
Last, the words of every path are compared with the words at the coordinates of
its first occurrence, by a digest; if two differ, hashes have collided and all
is worked out again with other hashes.

A minimizer that very many rows share is recognised by a count over all rows (in
a fixed number of cells) and split: its parts find repeats by themselves, and
what is single in a part meets the other parts in a second exchange, one row per
part and window at most.

Windows are judged on the input, and the same document counts as elsewhere.
Null and empty texts have no words. Rows without doc_id and repeated rows are
rows like others (so all windows of a repeated row are repeated). Empty tables
give no rows. Further columns are left alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from activity_timeline.llm.common import in_tasks, row_key, stored
from activity_timeline.llm.words import mix, slices, window_hashes, window_starts, word_hashes

SIZE = 35
PIECE = 6              # words of the pieces that minimizers are taken from
CELLS = 1 << 14        # cells of the count of minimizers
LEAST_HOT = 1_000      # rows of a minimizer that are never split
HASH_BYTES = 6         # of a window's hash, beside the 8 of its minimizer
ATTEMPTS = 3


def minimizer_runs(texts: pa.Array, size: int, salt: int):
    """Runs of windows with one minimizer, for all texts of a batch.

    Text number, first word, minimizer of each run; where its windows begin in the list of
    window hashes (one more at the end); window hashes.
    """
    hashes, first = word_hashes(texts)
    hashes = mix(hashes + np.uint64(salt)) if salt else hashes
    n = len(hashes) - size + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint64)
    piece = min(PIECE, size)
    least = window_hashes(hashes, piece)
    width, have = size - piece + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:len(least) - step], least[step:])
        have += step
    inside = window_starts(first, size, n)
    starts = np.flatnonzero(inside)
    least, windows = least[starts], window_hashes(hashes, size)[starts]
    text = np.searchsorted(first, starts, "right") - 1
    new = np.ones(len(starts), bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return (text[at], starts[at] - first[text[at]], least[at],
            np.append(at, len(starts)), windows)


def _cell_counts(size: int, salt: int):
    def run(batches):
        total = np.zeros(CELLS, np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                seeds = minimizer_runs(batch.column("text"), size, salt)[2]
                total += np.bincount((seeds % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["cell", "n"])
    return run


def split_cells(docs: DataFrame, size: int, salt: int, least_hot: int = LEAST_HOT) -> np.ndarray:
    """Parts that the minimizers of each cell are split into; CELLS numbers reach the driver."""
    counts = in_tasks(docs.select("text"), _cell_counts(size, salt), "cell bigint, n bigint")
    cells = np.zeros(CELLS, np.int64)
    for cell, n in counts.groupBy("cell").agg(F.sum("n")).collect():
        cells[cell] = n
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(least_hot, int(cells.sum()) // (4 * tasks), 8 * int(cells.sum()) // CELLS)
    return np.maximum(1, -(-cells // share)).astype(np.int32)


RUNS = "seed bigint, part int, parts int, row_key bigint, first int, windows binary"


def _runs(size: int, salt: int, parts: np.ndarray):
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                text, first, seeds, at, windows = minimizer_runs(batch.column("text"), size, salt)
                keys = batch.column("row_key").to_numpy()[text]
                split = parts[(seeds % np.uint64(CELLS)).astype(np.int64)]
                place = mix(keys.view(np.uint64) + first.astype(np.uint64))
                part = (place % split.astype(np.uint64)).astype(np.int32)
                packed = np.ascontiguousarray(
                    windows.view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES])
                binary = pa.Array.from_buffers(
                    pa.binary(), len(text),
                    [None, pa.py_buffer((at * HASH_BYTES).astype(np.int32).tobytes()),
                     pa.py_buffer(packed.tobytes())])
                yield pa.record_batch(
                    [pa.array(seeds.view(np.int64)), pa.array(part), pa.array(split),
                     pa.array(keys), pa.array(first.astype(np.int32)), binary],
                    names=["seed", "part", "parts", "row_key", "first", "windows"])
    return run


PATHS = ("kind string, row_key bigint, start int, n int, first_row bigint, first_start int,"
         " seed bigint, w bigint")
_NAMES = ["kind", "row_key", "start", "n", "first_row", "first_start", "seed", "w"]


def _repeats(batches):
    """Rows sorted by seed and part: paths of repeated windows, and open windows of split seeds."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        seeds = batch.column("seed").to_numpy()
        parts = batch.column("part").to_numpy()
        same = (seeds == seeds[-1]) & (parts == parts[-1])
        cut = int(len(same) - np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield from _paths([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        elif held and (held[-1].column("seed")[-1].as_py() != seeds[0]
                       or held[-1].column("part")[-1].as_py() != parts[0]):
            yield from _paths(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield from _paths(held)


def _paths(batches):
    for batch in pa.Table.from_batches(batches).combine_chunks().to_batches():
        yield from _group_paths(batch)


def _group_paths(batch):
    seeds, parts, split, keys, first = (batch.column(c).to_numpy() for c in
                                        ("seed", "part", "parts", "row_key", "first"))
    binary = batch.column("windows")
    offsets = np.frombuffer(binary.buffers()[1], np.int32)[
        binary.offset:binary.offset + len(binary) + 1].astype(np.int64)
    data = np.frombuffer(binary.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    sizes = np.diff(offsets) // HASH_BYTES
    wide = np.zeros((len(data) // HASH_BYTES, 8), np.uint8)
    wide[:, :HASH_BYTES] = data.reshape(-1, HASH_BYTES)
    w = wide.reshape(-1).view(np.uint64)
    row = np.repeat(np.arange(len(seeds)), sizes)
    start = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    group = np.concatenate([[0], np.cumsum((seeds[1:] != seeds[:-1]) | (parts[1:] != parts[:-1]))])
    order = np.lexsort((w, group[row]))
    gs, ws = group[row][order], w[order]
    new = np.ones(len(order), bool)
    new[1:] = (gs[1:] != gs[:-1]) | (ws[1:] != ws[:-1])
    heads = np.flatnonzero(new)
    counts = np.diff(np.append(heads, len(order)))
    head_of = np.repeat(order[heads], counts)       # the first occurrence of each window
    leader, repeated = np.empty_like(order), np.empty(len(order), bool)
    leader[order], repeated[order] = head_of, np.repeat(counts > 1, counts)
    # paths: repeated windows that go on together with those of their first occurrence
    hits = np.flatnonzero(repeated)
    if len(hits):
        lead = leader[hits]
        on = np.zeros(len(hits), bool)
        on[1:] = ((hits[1:] == hits[:-1] + 1) & (row[hits[1:]] == row[hits[:-1]])
                  & (lead[1:] == lead[:-1] + 1) & (row[lead[1:]] == row[lead[:-1]]))
        at = np.flatnonzero(~on)
        n = np.diff(np.append(at, len(hits)))
        yield pa.record_batch(
            [pa.array(["path"] * len(at), pa.string()), pa.array(keys[row[hits[at]]]),
             pa.array(start[hits[at]].astype(np.int32)), pa.array(n.astype(np.int32)),
             pa.array(keys[row[lead[at]]]), pa.array(start[lead[at]].astype(np.int32)),
             pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int64())], names=_NAMES)
    # windows of split seeds: one row for each in this part
    one = order[heads]
    open_ = split[row[one]] > 1
    one, single = one[open_], (counts == 1)[open_]
    if len(one):
        yield pa.record_batch(
            [pa.array(np.where(single, "single", "many").tolist(), pa.string()),
             pa.array(keys[row[one]]), pa.array(start[one].astype(np.int32)),
             pa.array(np.ones(len(one), np.int32)), pa.nulls(len(one), pa.int64()),
             pa.nulls(len(one), pa.int32()), pa.array(seeds[row[one]]),
             pa.array(w[one].view(np.int64))], names=_NAMES)


def repeated_paths(docs: DataFrame, size: int = SIZE, salt: int = 0,
                   least_hot: int = LEAST_HOT) -> DataFrame:
    """row_key, start, n (windows), first_row, first_start of all paths of repeated windows."""
    keyed = docs.select(row_key().alias("row_key"), "text").where("text IS NOT NULL")
    parts = split_cells(keyed, size, salt, least_hot)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = (in_tasks(keyed, _runs(size, salt, parts), RUNS)
            .repartition(tasks, "seed", "part").sortWithinPartitions("seed", "part"))
    found = stored(in_tasks(runs, _repeats, PATHS), "paths")
    open_ = found.where("kind <> 'path'")
    across = (open_.groupBy("seed", "w")
              .agg(F.count("*").alias("n_parts"), F.min(F.struct("row_key", "start")).alias("head"))
              .where("n_parts > 1"))
    late = (open_.where("kind = 'single'").select("seed", "w", "row_key", "start", "n")
            .join(across, ["seed", "w"])
            .select("row_key", "start", "n", F.col("head.row_key").alias("first_row"),
                    F.col("head.start").alias("first_start")))
    own = found.where("kind = 'path'").select("row_key", "start", "n", "first_row", "first_start")
    return own.unionByName(late)


CUT = ("doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string,"
       " checks array<struct<first_row:bigint,first_start:int,n:int,digest:bigint>>")
_CUT = pa.list_(pa.struct([("first_row", pa.int64()), ("first_start", pa.int32()),
                           ("n", pa.int32()), ("digest", pa.int64())]))


def glue(spans: list[dict]) -> list[tuple[int, int, int, int]]:
    """Paths of one document in order, those that go on put together."""
    out: list[tuple[int, int, int, int]] = []
    for start, n, first_row, first_start in sorted(
            (s["start"], s["n"], s["first_row"], s["first_start"]) for s in spans):
        if out:
            a, m, row, at = out[-1]
            if row == first_row and start - a == first_start - at and start <= a + m:
                out[-1] = (a, max(m, start + n - a), row, at)
                continue
        out.append((start, n, first_row, first_start))
    return out


def _digest(words: list[bytes]) -> int:
    return int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "little",
                          signed=True)


def _cut(size: int):
    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = []
                for key, text, spans, asked in zip(*(batch.column(c).to_pylist() for c in
                                                     ("row_key", "text", "spans", "asked"))):
                    words = text.encode().split() if text else []
                    keep = np.ones(len(words), bool)
                    checks = [{"first_row": key, "first_start": a["start"], "n": a["n"],
                               "digest": _digest(words[a["start"]:a["start"] + a["n"]])}
                              for a in asked or []]
                    for start, n, first_row, first_start in ((s["start"], s["n"], s["first_row"],
                                                              s["first_start"])
                                                             for s in spans or []):
                        keep[start:start + n] = False
                        if (first_row, first_start) != (key, start):
                            checks.append({"first_row": first_row, "first_start": first_start,
                                           "n": n, "digest": _digest(words[start:start + n])})
                    kept = b" ".join(words) if keep.all() else \
                        b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])
                    rows.append((len(words), int((~keep).sum()),
                                 hashlib.sha256(kept).hexdigest(), checks))
                yield pa.record_batch(
                    [batch.column("doc_id"), *[pa.array([r[i] for r in rows], t) for i, t in
                                               enumerate([pa.int64(), pa.int64(), pa.string(),
                                                          _CUT])]],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", "checks"])
    return run


def _glued(size: int):
    def run(batches):
        for batch in batches:
            keys, out = batch.column("row_key").to_pylist(), []
            for key, spans in zip(keys, batch.column("spans").to_pylist()):
                out += [(key, a, n + size - 1, row, at) for a, n, row, at in glue(spans)]
            yield pa.record_batch(
                [pa.array([r[i] for r in out], t) for i, t in enumerate(
                    [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()])],
                names=["row_key", "start", "n", "first_row", "first_start"])
    return run


def repeated_spans(docs: DataFrame, size: int = SIZE, salt: int = 0,
                   least_hot: int = LEAST_HOT) -> DataFrame:
    """row_key, start, n (words), first_row, first_start: paths put together, per document.

    The spans of one document are at most as many as its words.
    """
    grouped = repeated_paths(docs, size, salt, least_hot).groupBy("row_key").agg(
        F.collect_set(F.struct("start", "n", "first_row", "first_start")).alias("spans"))
    return in_tasks(grouped, _glued(size), "row_key bigint, start int, n int, first_row bigint,"
                                           " first_start int")


def remove_repeats(docs: DataFrame, size: int = SIZE, least_hot: int = LEAST_HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    for salt in range(ATTEMPTS):
        spans = stored(repeated_spans(docs, size, salt, least_hot), "spans")
        own = spans.groupBy("row_key").agg(F.collect_list(
            F.struct("start", "n", "first_row", "first_start")).alias("spans"))
        # what other documents compare themselves with: each place and length once
        asked = (spans.where("first_row <> row_key OR first_start <> start")
                 .select(F.col("first_row").alias("row_key"), F.col("first_start").alias("start"),
                         "n").distinct()
                 .groupBy("row_key").agg(F.collect_list(F.struct("start", "n")).alias("asked")))
        keyed = docs.select(row_key().alias("row_key"), "doc_id", "text")
        whole = (own.join(asked, "row_key", "full").join(keyed, "row_key", "right"))
        cut = stored(in_tasks(whole, _cut(size), CUT), "cut")
        pairs = cut.select(F.inline("checks"))
        wrong = (pairs.groupBy("first_row", "first_start", "n")
                 .agg(F.min("digest").alias("low"), F.max("digest").alias("high"))
                 .where("low <> high"))
        if wrong.isEmpty():
            return cut.drop("checks")
    raise RuntimeError("hashes collided in every attempt")
