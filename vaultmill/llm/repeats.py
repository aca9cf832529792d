"""Exact substring deduplication by suffix sorting.

Removed is every byte covered by a string of ``LEAST`` bytes that also starts earlier in the corpus
(smaller id, or same document and smaller offset). Strings are judged on the input, and never
cross documents.

Suffixes of the whole corpus are not sorted in one place. Equal strings of 100 bytes have the same
anchor - the leftmost smallest hash among their 32-byte pieces - at the same offset, so strings can
only match within the group of one anchor hash, and groups are independent:

1. Each document yields its anchors, each with the run of window starts it governs; the bytes that
   those windows cover are the context. Equal contexts are one text with several owners: the earliest
   goes on, the others repeat it. This collapses copies before their bytes are shuffled, within a batch
   by comparing the bytes, then in the group by a digest of them (BLAKE2b, 128 bits). Anchors that only
   one context has are done, since two windows of one context are never equal.
2. The bytes of all other contexts are fetched and meet in their group. Windows whose hash no other
   window of the group has are set aside, and all other regions go to the suffix sorter (``lyndon``).
   Windows equal in 100 bytes are neighbours in its order; all but the earliest of each such run go.
   Groups with more than ``HOT`` different contexts are split first: their windows are dealt singly,
   by their own hash, after equal ones of a batch are collapsed, so a passage that a third of all
   documents share does not meet in one task. An anchor with ``CROWD`` contexts in one batch (a passage
   in many different surroundings) is dealt so from the start: the batch sends its windows singly and
   a note that the anchor's group is split, so no group gets more than CROWD contexts from a batch.
3. Removed runs are merged per document and cut out of the text.

The 64-bit hashes decide what is compared, never what is removed: that takes equal bytes, equal digests
or neighbours in the suffix order. Should two hashes collide, more is compared and nothing else happens.

Anchors travel as packed columns, one row for each batch and partition, not as rows.

Null text: as empty. Rows with equal id and text count as one document and get equal results; rows
with equal id and different text are ordered by a hash of the text; null ids come last. Empty input:
empty output.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultmill.llm.common import LAST_ID, cut, integer_id, row_id, shuffle_width, table, text_hash
from vaultmill.llm.lyndon import suffix_array

LEAST, PIECE, HOT = 100, 32, 4096
CROWD, SINGLE = 64, 128  # contexts of one anchor in a batch that make it a crowd; mark of a single window
SPAN = LEAST - PIECE + 1  # pieces of one window
CHUNK, POS = 1 << 19, 20  # window starts handled at once; bits for a position in a chunk
SEND = 1 << 25  # bytes of texts and contexts that are fetched at once, if a text allows
SORT = 1 << 18  # letters for one run of the sorter, if its groups allow
U = np.uint64
_rng = np.random.Generator(np.random.PCG64(7))
LETTER = _rng.integers(0, 2**64, 256, dtype=U)
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.concatenate([[U(1)], np.full(n - 1, b, U)])) for b in (BASE, INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def stir(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x ^ (x >> U(31))
        x = x * U(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U(29))
        x = x * U(0x94D049BB133111EB)
        return x ^ (x >> U(32))


def prefix(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash, and the powers that bring differences to a common base."""
    p, q = powers(max(CHUNK + 4096, len(buf) + 1))
    h = np.zeros(len(buf) + 1, U)
    with np.errstate(over="ignore"):
        np.cumsum(LETTER[buf] * p[: len(buf)], out=h[1:])
    return h, q[: len(buf) + 1]


def pieces_of(lengths: np.ndarray) -> Iterator[list[tuple[int, int, int]]]:
    """Chunks of (document, first start, end of bytes): whole documents, or one part of a long one."""
    chunk, size = [], 0
    for k in np.flatnonzero(lengths >= LEAST).tolist():
        n = int(lengths[k])
        if size + n > CHUNK and chunk:
            yield chunk
            chunk, size = [], 0
        if n > CHUNK:
            for a in range(0, n - LEAST + 1, CHUNK):
                yield [(k, a, min(n, a + CHUNK + LEAST - 1))]
        else:
            chunk.append((k, 0, n))
            size += n
    if chunk:
        yield chunk


def anchors(data: np.ndarray, starts: np.ndarray, chunk: list[tuple[int, int, int]]) -> tuple[np.ndarray, ...]:
    """(document, first start, further starts, anchor hash, context hash) of each governed run."""
    lens = np.array([b - a for _, a, b in chunk])
    buf = np.concatenate([data[starts[k] + a : starts[k] + b] for k, a, b in chunk]) if len(chunk) > 1 else data[starts[chunk[0][0]] + chunk[0][1] : starts[chunk[0][0]] + chunk[0][2]]
    ends = np.cumsum(lens)
    h, q = prefix(buf)
    with np.errstate(over="ignore"):
        piece = stir((h[PIECE:] - h[:-PIECE]) * q[: len(h) - PIECE])
    low = U((1 << POS) - 1)
    key = (piece & ~low) | np.arange(len(piece), dtype=U)
    width = 1
    while width * 2 <= SPAN:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < SPAN:
        key = np.minimum(key[: len(key) - (SPAN - width)], key[SPAN - width :])
    pid = np.repeat(np.arange(len(chunk)), lens)[: len(key)]
    ok = np.flatnonzero(np.arange(len(key)) + LEAST <= ends[pid])
    pos, pid = (key[ok] & low).astype(np.int64), pid[ok]
    head = np.flatnonzero(np.concatenate([[True], (pos[1:] != pos[:-1]) | (pid[1:] != pid[:-1])]))
    lo = ok[head]
    hi = ok[np.append(head[1:], len(ok)) - 1]
    at, pid = pos[head], pid[head]
    with np.errstate(over="ignore"):
        context = stir((h[hi + LEAST] - h[lo]) * q[lo] + stir((hi - lo).astype(U)))
    base = (ends - lens)[pid]
    first = np.array([a for _, a, _ in chunk])[pid]
    return np.array([k for k, _, _ in chunk])[pid], lo - base + first, hi - lo, piece[at], context


# packed columns: anchors (hash, context digest in two, id, tie, start, further starts) and runs (id, tie, from, to)
ANCHOR = (U, U, U, np.int64, np.int64, np.int32, np.uint8)
RUN = (np.int64, np.int64, np.int32, np.int32)
OPEN = (np.int64, np.int64, np.int32, np.uint8, U, np.uint8)  # id, tie, start, further, hash, hot

CONTEXT = (U, np.int64, np.int64, np.int32, np.uint8)  # group, id, tie, start, further starts


def pack(cols: Iterable[np.ndarray], kinds: tuple) -> bytes:
    return b"".join(np.ascontiguousarray(c, k).tobytes() for c, k in zip(cols, kinds))


def unpack(blobs: Iterable[bytes], kinds: tuple) -> list[np.ndarray]:
    width = sum(np.dtype(k).itemsize for k in kinds)
    parts: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in kinds]
    for b in blobs:
        n, at = len(b) // width, 0
        for i, k in enumerate(kinds):
            parts[i].append(np.frombuffer(b, k, n, at))
            at += n * np.dtype(k).itemsize
    return [np.concatenate(p) for p in parts]


def dealt(cols: list[np.ndarray], kinds: tuple, bucket: np.ndarray) -> dict[int, bytes]:
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    cols = [c[order] for c in cols]
    return {int(bucket[a]): pack([c[a:b] for c in cols], kinds) for a, b in zip(cuts, np.append(cuts[1:], len(bucket)))}


def rows_of(*parts: dict[int, bytes]) -> pa.RecordBatch:
    keys = sorted(set().union(*parts))
    return pa.record_batch([pa.array(keys, pa.int64()), *(pa.array([p.get(k, b"") for k in keys], pa.binary()) for p in parts)], ["bucket", *"abc"[: len(parts)]])


def later(keys: list[np.ndarray], order: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorts by keys then order. Returns the sorting, which rows start a group of equal keys, and
    which come after the group's first in ``order``."""
    s = np.lexsort(tuple(reversed([*keys, *order])))
    new = np.zeros(len(s), bool)
    if len(s):
        new[0] = True
        for k in keys:
            new[1:] |= k[s][1:] != k[s][:-1]
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(s) else np.zeros(0, np.int64)
    past = np.zeros(len(s), bool)
    for o in order:
        past |= o[s] != o[s][first]
    return s, new, past


def shared(x: np.ndarray) -> np.ndarray:
    """Where a value occurs more than once."""
    s = np.sort(x)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(len(x), bool)
    at = np.searchsorted(twice, x)
    at[at == len(twice)] = 0
    return twice[at] == x


def equal(data: np.ndarray, one: np.ndarray, two: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes at each pair of places are equal."""
    same = np.zeros(len(one), bool)
    for n in np.unique(size).tolist():
        of = np.flatnonzero(size == n)
        for i in range(0, len(of), step := max(1, CHUNK // (4 * n))):
            part, span = of[i : i + step], np.arange(n)[None, :]
            same[part] = (data[one[part][:, None] + span] == data[two[part][:, None] + span]).all(axis=1)
    return same


def settle(a: list[np.ndarray], data: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Anchor columns and where their contexts stand in the bytes -> which rows go on (the earliest of
    equal contexts), and the runs of all that repeat one of them."""
    mh, ch, did, tie, lo, more = a
    size = (more & (SINGLE - 1)).astype(np.int64) + LEAST
    many = np.flatnonzero(shared(mh))
    s, new, past = later([mh[many], ch[many]], [did[many], tie[many], lo[many]])
    s = many[s]
    keep = np.ones(len(mh), bool)
    if not len(s):
        return keep, [np.zeros(0, k) for k in RUN]
    first = s[np.flatnonzero(new)[np.cumsum(new) - 1]]
    again = np.flatnonzero(~new & (size[s] == size[first]))
    again = again[equal(data, place[s[again]], place[first[again]], size[s[again]])]
    keep[s[again]] = False
    gone = s[again[past[again]]]
    return keep, [did[gone], tie[gone], lo[gone], (lo[gone] + size[gone]).astype(np.int32)]


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of the runs of one document; touching runs become one."""
    if not len(start):
        return start, end
    s = np.argsort(start, kind="stable")
    start, end = start[s], np.maximum.accumulate(end[s])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def merged_all(r: list[np.ndarray]) -> list[np.ndarray]:
    """The same for the runs of many documents at once, sorted by document."""
    did, tie, a, b = r
    if not len(did):
        return r
    s = np.lexsort((a, tie, did))
    did, tie, a, b = did[s], tie[s], a[s].astype(np.int64), b[s].astype(np.int64)
    doc = np.cumsum(np.concatenate([[False], (did[1:] != did[:-1]) | (tie[1:] != tie[:-1])]))
    shift = doc * (int(b.max()) + 2)
    ga, gb = a + shift, np.maximum.accumulate(b + shift)
    new = np.concatenate([[True], ga[1:] > gb[:-1]])
    ends = gb[np.append(np.flatnonzero(new)[1:] - 1, len(gb) - 1)]
    return [did[new], tie[new], a[new].astype(np.int32), (ends - shift[new]).astype(np.int32)]


def by_document(cols: list[np.ndarray]) -> Iterator[tuple[int, int, slice]]:
    """Slices of columns that are sorted by their first two."""
    did, tie = cols[0], cols[1]
    if not len(did):
        return
    cuts = np.flatnonzero(np.concatenate([[True], (did[1:] != did[:-1]) | (tie[1:] != tie[:-1])]))
    for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(did)).tolist()):
        yield int(did[a]), int(tie[a]), slice(a, b)


def window_hashes(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the 100 bytes at each of the ascending positions."""
    value = np.empty(len(at), U)
    step = max(1, CHUNK // 32)  # single windows lie 100 bytes apart
    for i in range(0, len(at), step):
        part = at[i : i + step]
        a = int(part[0])
        h, q = prefix(buf[a : int(part[-1]) + LEAST])
        x = part - a
        with np.errstate(over="ignore"):
            value[i : i + step] = stir((h[x + LEAST] - h[x]) * q[x])
    return value


def gathered(data: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of bytes one after the other."""
    out = np.empty(int(size.sum()), np.uint8)
    at, i = 0, 0
    ends = np.cumsum(size)
    while i < len(place):
        j = max(i + 1, int(np.searchsorted(ends, at + CHUNK, side="right")))
        n = int(ends[j - 1]) - at
        out[at : at + n] = data[np.repeat(place[i:j] - (ends[i:j] - size[i:j] - at), size[i:j]) + np.arange(n)]
        at, i = at + n, j
    return out


def digests(data: np.ndarray, place: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BLAKE2b of each stretch of bytes, as two numbers."""
    view, make = memoryview(np.ascontiguousarray(data)), hashlib.blake2b
    out = np.empty(2 * len(place), U)
    for i in range(0, len(place), step := 1 << 14):
        a = place[i : i + step]
        b = a + size[i : i + step]
        out[2 * i : 2 * (i + len(a))] = np.frombuffer(b"".join([make(view[x:y], digest_size=16).digest() for x, y in zip(a.tolist(), b.tolist())]), U)
    return out[::2], out[1::2]


def context_hashes(buf: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of stretches that stand one after the other."""
    value = np.empty(len(size), U)
    ends = np.cumsum(size)
    i, at = 0, 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(ends, at + CHUNK, side="right")))
        h, q = prefix(buf[at : int(ends[j - 1])])
        to = ends[i:j] - at
        x = to - size[i:j]
        with np.errstate(over="ignore"):
            value[i:j] = stir((h[to] - h[x]) * q[x])
        at, i = int(ends[j - 1]), j
    return value


def singles(data: np.ndarray, place: np.ndarray, a: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Anchor columns, with the anchors' places in the bytes -> one row per window, keyed by its hash, and its place."""
    mh, ch, did, tie, lo, more = a
    n = more.astype(np.int64) + 1
    size = n + LEAST - 1
    buf = gathered(data, place, size)
    off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    value = window_hashes(buf, np.repeat(np.cumsum(size) - size, n) + off)
    r = lambda c: np.repeat(c, n)
    return [value, value, r(did), r(tie), (r(lo) + off).astype(np.int32), np.full(len(value), SINGLE, np.uint8)], r(place) + off


def spread(x: np.ndarray, n: int) -> np.ndarray:
    return (stir(x.astype(np.int64).view(U) if x.dtype != U else x) % U(n)).astype(np.int64)


def columns(batches: Iterator[pa.RecordBatch]) -> list[list[bytes]]:
    got: list[list[bytes]] = []
    for b in batches:
        for i in range(1, b.num_columns):
            if len(got) < i:
                got.append([])
            got[i - 1] += b.column(i).to_pylist()
    return got or [[], [], []]


def repeated_windows(meta: list[np.ndarray], buf: np.ndarray) -> list[np.ndarray]:
    """Contexts (group, id, tie, start, further starts) and their bytes -> runs of repeated windows."""
    grp, did, tie, lo, more = meta
    more = more.astype(np.int64)
    size = more + LEAST
    base = np.cumsum(size) - size
    win = np.repeat(np.arange(len(grp)), more + 1)  # the context of each window
    off = np.arange(len(win)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
    at = base[win] + off
    with np.errstate(over="ignore"):
        value = stir(window_hashes(buf, at) + stir(grp[win]))
    live = np.flatnonzero(shared(value))
    out: list[list[np.ndarray]] = []
    if not len(live):
        return [np.zeros(0, k) for k in RUN]
    # regions of neighbouring live windows, sorted by group so that a run of the sorter has whole groups
    new = np.concatenate([[True], (live[1:] != live[:-1] + 1) | (win[live][1:] != win[live][:-1])])
    head = np.flatnonzero(new)
    ra, rc = at[live[head]], win[live[head]]
    rn = np.diff(np.append(head, len(live)))
    order = np.argsort(grp[rc], kind="stable")
    ra, rc, rn = ra[order], rc[order], rn[order]
    i = 0
    while i < len(ra):
        j, letters = i, 0
        while j < len(ra) and (letters < SORT or grp[rc[j]] == grp[rc[j - 1]]):
            letters += int(rn[j]) + LEAST
            j += 1
        out.append(sorted_windows(buf, ra[i:j], rn[i:j], [did[rc[i:j]], tie[rc[i:j]], lo[rc[i:j]] + (ra[i:j] - base[rc[i:j]])]))
        i = j
    return merged_all([np.concatenate(c) for c in zip(*out)])


def sorted_windows(buf: np.ndarray, ra: np.ndarray, rn: np.ndarray, who: list[np.ndarray]) -> list[np.ndarray]:
    """Suffix-sorts the regions and returns the runs of the windows that repeat an earlier one."""
    text: list[int] = []
    place = []  # of each region in the text
    for a, n in zip(ra.tolist(), rn.tolist()):
        place.append(len(text))
        text += (buf[a : a + n + LEAST - 1].astype(np.int16) + 2).tolist()
        text.append(1)
    text.append(0)
    order = np.array(suffix_array(text), np.int64)
    region = np.full(len(text), -1, np.int64)
    start = np.zeros(len(text), np.int64)
    for k, (p, n) in enumerate(zip(place, rn.tolist())):
        region[p : p + n] = k
        start[p : p + n] = np.arange(n)
    order = order[region[order] >= 0]  # window starts, in the order of their suffixes
    letters = np.array(text, np.int16)
    same = np.zeros(len(order), bool)
    step = 1 << 14
    for i in range(1, len(order), step):
        j = min(len(order), i + step)
        w = letters[order[i - 1 : j][:, None] + np.arange(LEAST)[None, :]]
        same[i:j] = (w[1:] == w[:-1]).all(axis=1)
    label = np.cumsum(~same)
    r = region[order]
    did, tie, at = who[0][r], who[1][r], (who[2][r] + start[order]).astype(np.int64)
    s, _, past = later([label], [did, tie, at])
    gone = s[past]
    a = at[gone].astype(np.int32)
    return merged_all([did[gone], tie[gone], a, a + np.int32(LEAST)])


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (binary)."""
    spark = docs.sparkSession
    width = shuffle_width(spark)
    buckets = width  # a bucket's number is its partition
    text = docs[f"`{text_col}`"].cast("string")
    src = docs.select(row_id(integer_id(docs, id_col)).alias("did"), text_hash(text).alias("tie"), F.coalesce(text, F.lit("")).cast("binary").alias("data"))
    # both joins below read these very columns, so that they share one shuffle of the texts
    src = src.select("did", "tie", "data")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            did, tie = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            x = b.column(2).cast(pa.large_binary())
            at = np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1]
            data = np.frombuffer(x.buffers()[2], np.uint8) if x.buffers()[2] is not None else np.zeros(0, np.uint8)
            found = [anchors(data, at, c) for c in pieces_of(np.diff(at))]
            if not found:
                continue
            k, lo, more, mh, ch = (np.concatenate(c) for c in zip(*found))
            a = [mh, ch, did[k], tie[k], lo.astype(np.int32), more.astype(np.uint8)]
            place = at[k] + lo
            del found
            keep, gone = settle(a, data, place)
            a, place = [c[keep] for c in a], place[keep]
            _, where, count = np.unique(a[0], return_inverse=True, return_counts=True)
            crowd = count[where] >= CROWD
            notes = np.unique(a[0][crowd])
            one, at_one = singles(data, place[crowd], [c[crowd] for c in a])
            keep, more_gone = settle(one, data, at_one)
            gone = [np.concatenate(c) for c in zip(gone, more_gone)]
            # windows that go singly meet by their bytes later on, and need no digest
            whole = [c[~crowd] for c in a]
            marks = digests(data, place[~crowd], whole[5].astype(np.int64) + LEAST)
            none = np.zeros(keep.sum(), U)
            a = [np.concatenate([x, y]) for x, y in zip([whole[0], *marks, *whole[2:]], [one[0][keep], none, none, *(c[keep] for c in one[2:])])]
            gone = merged_all(gone)
            yield rows_of(dealt(a, ANCHOR, spread(a[0], buckets)), dealt(gone, RUN, spread(gone[0], buckets)), dealt([notes], (U,), spread(notes, buckets)))

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = columns(batches)
        a, gone = unpack(got[0], ANCHOR), unpack(got[1], RUN)
        notes = unpack(got[2] if len(got) > 2 else [], (U,))[0]
        whole = np.flatnonzero((a[6] != SINGLE) & shared(a[0]))
        s, new, past = later([c[whole] for c in a[:3]], [c[whole] for c in a[3:6]])
        s = whole[s]
        again, keep = s[past], np.ones(len(a[0]), bool)
        keep[s[~new]] = False
        runs = [a[3][again], a[4][again], a[5][again], a[5][again] + a[6][again] + np.int32(LEAST)]
        gone = merged_all([np.concatenate(c) for c in zip(gone, runs)])
        mh, _, _, did, tie, lo, n = (c[keep] for c in a)
        single, split = n == SINGLE, np.isin(mh, notes)
        several = np.flatnonzero(shared(mh) | single | split)
        _, where, count = np.unique(mh[several], return_inverse=True, return_counts=True)
        hot = (count[where] > HOT) | (single | split)[several]
        o = [did[several], tie[several], lo[several], (n & (SINGLE - 1))[several], mh[several], hot.astype(np.uint8)]
        yield rows_of(dealt(gone, RUN, spread(gone[0], buckets)), dealt(o, OPEN, spread(o[0], buckets)))

    def per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = columns(batches)
        gone, o = merged_all(unpack(got[0], RUN)), unpack(got[1] if len(got) > 1 else [], OPEN)
        s = np.lexsort((o[4], o[2], o[1], o[0]))
        o = [c[s] for c in o]
        new = np.ones(len(s), bool)  # rows that repeat id and text tell the same
        new[1:] = np.logical_or.reduce([o[c][1:] != o[c][:-1] for c in (0, 1, 2, 4)])
        o = [c[new] for c in o]
        rows: dict[tuple[int, int], list[bytes]] = {}
        for d, t, w in by_document(gone):
            rows.setdefault((d, t), [b"", b""])[0] = pack([c[w] for c in gone[2:]], RUN[2:])
        for d, t, w in by_document(o):
            rows.setdefault((d, t), [b"", b""])[1] = pack([c[w] for c in o[2:]], OPEN[2:])
        keys = list(rows)
        for i in range(0, len(keys), 4096):
            part = keys[i : i + 4096]
            yield pa.record_batch([pa.array([k[0] for k in part], pa.int64()), pa.array([k[1] for k in part], pa.int64()), *(pa.array([rows[k][x] for k in part], pa.binary()) for x in (0, 1))], ["did", "tie", "gone", "open"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: list[tuple[np.ndarray, list[np.ndarray]]] = []
            size, last = 0, None
            for k, (did, tie, blob) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist())):
                if (did, tie) == last:  # a row that repeats id and text
                    continue
                last = did, tie
                lo, n, mh, hot = unpack([blob], OPEN[2:])
                held.append((np.frombuffer(b.column(2)[k].as_buffer(), np.uint8), [np.full(len(lo), did, np.int64), np.full(len(lo), tie, np.int64), lo, n, mh, hot]))
                length = n.astype(np.int64)
                size += len(held[-1][0]) + int((length + LEAST).sum()) + int(length[hot > 0].sum()) * LEAST
                if size > SEND:
                    yield sent(held)
                    held, size = [], 0
            if held:
                yield sent(held)

    def sent(held: list[tuple[np.ndarray, list[np.ndarray]]]) -> pa.RecordBatch:
        data = np.concatenate([d for d, _ in held])
        start = np.cumsum([len(d) for d, _ in held]) - [len(d) for d, _ in held]
        did, tie, lo, n, mh, hot = (np.concatenate(c) for c in zip(*(c for _, c in held)))
        place = np.repeat(start, [len(c[0]) for _, c in held]) + lo
        h, w = hot > 0, hot == 0
        # windows of hot groups go on their own; equal ones of the batch are settled here
        one, at = singles(data, place[h], [mh[h], mh[h], did[h], tie[h], lo[h], n[h]])
        keep, gone = settle(one, data, at)
        runs = merged_all(gone)
        cols = [np.concatenate(x) for x in zip([mh[w], did[w], tie[w], lo[w], n[w]], [one[0][keep], one[2][keep], one[3][keep], one[4][keep], np.zeros(keep.sum(), np.uint8)])]
        place = np.concatenate([place[w], at[keep]])
        bucket = spread(cols[0], buckets)
        order = np.argsort(bucket, kind="stable")
        cols, place, bucket = [x[order] for x in cols], place[order], bucket[order]
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
        bits = {int(bucket[x]): gathered(data, place[x:y], cols[4][x:y].astype(np.int64) + LEAST).tobytes() for x, y in zip(cuts.tolist(), np.append(cuts[1:], len(bucket)).tolist())}
        return rows_of(dealt(cols, CONTEXT, bucket), bits, dealt(runs, RUN, spread(runs[0], buckets)))

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = columns(batches)
        gone = unpack(got[2] if len(got) > 2 else [], RUN)
        meta, buf = unpack(got[0], CONTEXT), np.frombuffer(b"".join(got[1]), np.uint8)
        grp, did, tie, lo, more = meta
        size = more.astype(np.int64) + LEAST
        keep, same = settle([grp, context_hashes(buf, size), did, tie, lo, more], buf, np.cumsum(size) - size)
        runs = repeated_windows([c[keep] for c in meta], buf[np.repeat(keep, size)])
        both = merged_all([np.concatenate(c) for c in zip(gone, same, runs)])
        none: dict[int, bytes] = {}
        yield rows_of(dealt(both, RUN, spread(both[0], buckets)), none)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data, x, y in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist()):
                buf = memoryview(data.as_buffer())
                a, e = merged(*unpack([z for z in (x, y) if z], RUN[2:]))
                kept, at = [], 0
                for s, t in zip(a.tolist(), e.tolist()):
                    kept.append(buf[at:s])
                    at = t
                kept.append(buf[at:])
                whole = b"".join(kept)
                out.append((len(buf), len(buf) - len(whole), len(a), hashlib.sha256(whole).hexdigest(), whole))
            cols = list(zip(*out)) or [[]] * 5
            yield pa.record_batch([b.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    two, three = "bucket long, a binary, b binary", "bucket long, a binary, b binary, c binary"
    doc_rows = "did long, tie long, gone binary, open binary"
    found = src.mapInArrow(find, three).repartitionById(width, F.col("bucket").cast("int")).mapInArrow(group, two)
    first = cut(found.repartitionById(width, F.col("bucket").cast("int")).mapInArrow(per_document, doc_rows))
    unsettled = src.join(first.where(F.octet_length("open") > 0).select("did", "tie", "open"), ["did", "tie"]).select("did", "tie", "data", "open")
    second = unsettled.mapInArrow(fetch, three).repartitionById(width, F.col("bucket").cast("int")).mapInArrow(sort, two)
    second = second.repartitionById(width, F.col("bucket").cast("int")).mapInArrow(per_document, doc_rows).select("did", "tie", F.col("gone").alias("gone2"))
    j = src.join(first.select("did", "tie", "gone"), ["did", "tie"], "left").join(second, ["did", "tie"], "left")
    return j.select(F.when(F.col("did") < LAST_ID, F.col("did")).alias("doc_id"), "data", "gone", "gone2").mapInArrow(clean, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op4_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


# for tables in which ids do not repeat with different texts
OP4_SQL = """
WITH d AS (SELECT DISTINCT doc_id, text, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(n - 99)) AS i FROM d WHERE n >= 100)),
r AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
g AS (SELECT doc_id, i, sum(CASE WHEN i <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
  FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r)),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, run),
p AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM s
  UNION ALL SELECT d.doc_id, coalesce(max(b), 0), any_value(n) FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id),
o AS (SELECT doc_id, sha256(unhex(string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x))) AS kept FROM p JOIN d USING (doc_id) GROUP BY doc_id),
t AS (SELECT doc_id, sum(b - a)::BIGINT AS removed, count(*) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, strlen(coalesce(documents.text, ''))::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, kept AS kept_sha256
FROM documents JOIN o USING (doc_id) LEFT JOIN t USING (doc_id)
"""
