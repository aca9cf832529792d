"""SentencePiece encoding and decoding (BPE models) by vectorised merge rounds.

Encoding follows the library's rule: of all neighbours that form a piece, the pair with the best score
merges first, of equal ones the leftmost, until no two neighbours form a piece. A batch of texts becomes
one flat array of symbols with the number of the word that each belongs to. A round looks up the rank of
every pair, takes the smallest rank of each word (a segmented minimum), and merges all its occurrences at
once, every other one where they overlap, starting on the left. The array is compacted, only pairs beside
a merge are looked up anew, and words without a pair leave; rounds end when no word is left.

Merging all at once equals merging one by one unless a merge makes a pair that is as good as the one just
merged. Pieces for which the vocabulary has such a pair are known beforehand; where one of them arises
and finds that neighbour, the word's later occurrences wait for the next round.

Words are what no merge can cross: texts are cut before a run of spaces, if no piece has a space behind
another character, and around characters that are in no longer piece. Equal words of a batch are encoded
once, and short ones are kept (``KEPT`` of them at most) for later batches of the task.

Characters without a piece become their bytes, or the unknown piece in models without byte pieces (one for
each run). Decoding gathers the bytes of all pieces at once; bytes that are no UTF-8 become U+FFFD each, and control pieces nothing.

Null and empty texts: no ids, and an empty text. Repeated rows: encoded each. Very long texts: worked on
apart, ``BLOCK`` characters of a batch at a time. Empty tables: empty. The model file is read by the driver,
and its tables, of the size of the vocabulary, are broadcast; other columns of the table stay untouched.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaultmill.llm.common import table

SPACE = "▁"  # fixed value: how models write a space
BLOCK = 1 << 18  # characters, or ids, worked on at once
KEPT, SHORT = 100_000, 32  # words kept from batch to batch; characters of such a word
NEVER = np.iinfo(np.int32).max  # rank of two neighbours that form no piece
CODES = 0x110000

codecs.register_error("each_byte", lambda e: ("�", e.start + 1))


class Model:
    """A BPE model's tables. A symbol is a piece's id, or for a character without one, the number of pieces plus its code."""

    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(data)
        kind, spec = pb.ModelProto.SentencePiece, m.normalizer_spec
        if m.trainer_spec.model_type != pb.TrainerSpec.BPE:
            raise ValueError("only BPE models")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix or m.denormalizer_spec.precompiled_charsmap:
            raise ValueError("only models that leave texts as they are but for spaces")
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in m.pieces):
            raise ValueError("only models without user-defined and unused pieces")
        self.size, self.prefix = len(m.pieces), spec.add_dummy_prefix
        names = {p.piece: i for i, p in enumerate(m.pieces) if p.type == kind.NORMAL}
        place = {s: k for k, s in enumerate(sorted({p.score for p in m.pieces}, reverse=True))}
        self.symbol = np.arange(CODES, dtype=np.int64) + self.size
        for name, i in names.items():
            if len(name) == 1:
                self.symbol[ord(name)] = i
        part = lambda s: names[s] if s in names else self.size + ord(s) if len(s) == 1 else None
        pairs = [(a, b, i, place[m.pieces[i].score]) for name, i in names.items() for k in range(1, len(name)) if (a := part(name[:k])) is not None and (b := part(name[k:])) is not None]
        left, right, self.merged, self.rank = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else np.zeros((4, 0), np.int64)
        self.width = self.size + CODES
        key = left * self.width + right
        order = np.argsort(key)
        self.key, self.merged, self.rank = key[order], self.merged[order], self.rank[order].astype(np.int32)
        # pieces that may form a pair no worse than the one that made them
        own = np.full(self.width, -1, np.int64)
        own[self.merged] = self.rank
        self.early = np.zeros(self.width, bool)
        for side in (left[order], right[order]):
            self.early[side[self.rank <= own[side]]] = True
        longer = [n for n in names if len(n) > 1]
        inside = {c for n in longer for c in n}
        alone = re.escape("".join(chr(c) for c in range(128) if chr(c) not in inside))
        self.words = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+|[{alone}]" if not any(SPACE in n.lstrip(SPACE) for n in longer) else r"(?s).+")
        self.unknown = next(i for i, p in enumerate(m.pieces) if p.type == kind.UNKNOWN)
        self.byte = np.full(256, -1, np.int32)
        shown = [b""] * self.size
        for i, p in enumerate(m.pieces):
            if p.type == kind.BYTE:
                value = int(p.piece.strip("<>"), 16)
                self.byte[value], shown[i] = i, bytes([value])
            elif p.type == kind.NORMAL:
                shown[i] = p.piece.replace(SPACE, " ").encode()
            elif p.type == kind.UNKNOWN:
                shown[i] = m.trainer_spec.unk_surface.encode()
        self.by_bytes = bool((self.byte >= 0).all())
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.ends = np.cumsum([len(x) for x in shown])
        self.sizes = np.diff(self.ends, prepend=0)
        self.spaced = np.array([p.type == kind.NORMAL and p.piece.startswith(SPACE) for p in m.pieces])
        self.is_byte = np.array([p.type == kind.BYTE for p in m.pieces])

    @cached_property
    def seen(self) -> dict[str, bytes]:
        """Ids of words, as bytes of 32-bit numbers; a task's own."""
        return {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "seen"}

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What neighbours merge into, and the rank of that (``NEVER`` if into nothing)."""
        want = a * self.width + b
        at = np.minimum(np.searchsorted(self.key, want), max(0, len(self.key) - 1))
        if not len(self.key):
            return np.zeros(len(want), np.int64), np.full(len(want), NEVER, np.int32)
        found = self.key[at] == want
        return self.merged[at], np.where(found, self.rank[at], NEVER).astype(np.int32)

    def rounds(self, sym: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges the symbols of words of the given sizes (none is 0). Returns symbols and new sizes, in order."""
        n_words = len(sizes)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        name = np.arange(n_words)  # of the words still at work
        word = np.repeat(np.arange(n_words), sizes)

        def lookup(at: np.ndarray) -> None:
            """Ranks of the pairs that begin at some places."""
            inside = at[at + 1 < len(sym)]
            ends = inside[word[inside] != word[inside + 1]]
            merged[inside], rank[inside] = self.pair(sym[inside], sym[inside + 1])
            rank[ends] = NEVER

        merged, rank = np.zeros(len(sym), np.int64), np.full(len(sym), NEVER, np.int32)
        lookup(np.arange(len(sym)))
        while len(sym):
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            best = np.minimum.reduceat(rank, starts)
            over = best == NEVER
            if over.any():  # these words leave
                done = over[word]
                out.append((name[word[done]], sym[done]))
                stay = ~done
                new = np.cumsum(~over) - 1
                sym, rank, merged, word, name = sym[stay], rank[stay], merged[stay], new[word[stay]], name[~over]
                if not len(sym):
                    break
                best = best[~over]
            at = np.flatnonzero(rank == best[word])
            # of occurrences that overlap, every other one from the left
            run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            first = np.repeat(at[run], np.diff(np.append(run, len(at))))
            at = at[(at - first) % 2 == 0]
            risky = self.early[merged[at]]
            if risky.any():
                at = self.before_better(at, risky, sym, merged, rank, word)
            sym[at] = merged[at]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            moved = at - np.arange(len(at))
            sym, rank, merged, word = sym[stay], rank[stay], merged[stay], word[stay]
            rank[-1] = NEVER
            anew = np.zeros(len(sym) + 1, bool)  # the last place stands for the one before the first
            anew[moved] = anew[moved - 1] = True
            lookup(np.flatnonzero(anew[:-1]))
        name = np.concatenate([a for a, _ in out]) if out else np.zeros(0, np.int64)
        sym = np.concatenate([b for _, b in out]) if out else np.zeros(0, np.int64)
        return sym[np.argsort(name, kind="stable")], np.bincount(name, minlength=n_words)

    def before_better(self, at: np.ndarray, risky: np.ndarray, sym: np.ndarray, merged: np.ndarray, rank: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The merges of each word up to the first that makes a pair no worse than itself."""
        taken = np.zeros(len(sym), bool)
        taken[at] = True
        r = at[risky]
        left = r - 1
        has = (left >= 0) & (word[left] == word[r])
        joined = (r >= 2) & taken[r - 2]
        a = np.where(joined, merged[r - 2], sym[left])
        bad = has & (self.pair(a, merged[r])[1] <= rank[r])
        right = np.minimum(r + 2, len(sym) - 1)
        has = (r + 2 < len(sym)) & (word[right] == word[r])
        bad |= has & (self.pair(merged[r], sym[right])[1] <= rank[r])
        worse = np.zeros(len(at), np.int64)
        worse[np.flatnonzero(risky)[bad]] = 1
        before = np.cumsum(worse) - worse  # merges of that kind before each
        first = np.flatnonzero(np.diff(word[at], prepend=-1))
        base = np.repeat(before[first], np.diff(np.append(first, len(at))))
        return at[before == base]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of every word, as bytes of 32-bit numbers."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sym, sizes = self.rounds(self.symbol[codes], np.fromiter(map(len, words), np.int64, len(words)))
        lost = np.flatnonzero(sym >= self.size)
        if len(lost):
            word = np.repeat(np.arange(len(words)), sizes)
            if self.by_bytes:
                spelled = [self.byte[list(chr(c).encode())] for c in (sym[lost] - self.size).tolist()]
                times = np.ones(len(sym), np.int64)
                times[lost] = [len(x) for x in spelled]
                sym, word = np.repeat(sym, times), np.repeat(word, times)
                sym[sym >= self.size] = np.concatenate(spelled)
            else:
                sym[lost] = self.unknown
            sizes = np.bincount(word, minlength=len(words))
        data = sym.astype("<i4").tobytes()
        ends = (4 * np.cumsum(sizes)).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, one text after the other, and the number of each text's ids."""
        split = [self.words.findall(f"{SPACE}{t.replace(' ', SPACE)}" if self.prefix else t.replace(" ", SPACE)) if t else [] for t in texts]
        new = list({w for ws in split for w in ws}.difference(self.seen))
        if len(self.seen) + len(new) > KEPT:
            self.seen.clear()
            new = list({w for ws in split for w in ws})
        at = self.seen | dict(zip(new, self.encode_words(new))) if new else self.seen
        self.seen.update((w, at[w]) for w in new if len(w) <= SHORT)
        rows = [b"".join(map(at.__getitem__, ws)) for ws in split]
        ids, counts = np.frombuffer(b"".join(rows), "<i4"), np.array([len(r) // 4 for r in rows], np.int64)
        if not self.by_bytes:  # a run of unknown characters is one piece, also across words
            text = np.repeat(np.arange(len(texts)), counts)
            lost = ids == self.unknown
            again = np.append(False, lost[1:] & lost[:-1] & (text[1:] == text[:-1])) if len(ids) else lost
            ids, counts = ids[~again], np.bincount(text[~again], minlength=len(texts))
        return ids, counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of ids, one text after the other; each text has so many of them."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("no such piece")
        size, from_ = self.sizes[ids], self.ends[ids] - self.sizes[ids]
        ends = np.cumsum(size)
        flat = self.shown[np.repeat(from_ - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        upto = np.append(0, ends)[np.append(0, np.cumsum(counts))]
        out = [data.decode("utf-8", "each_byte") for a, b in zip(upto.tolist(), upto[1:].tolist()) for data in [flat[a:b]]]
        begin = np.cumsum(counts) - counts
        gaps = np.flatnonzero(size == 0)  # control pieces: bytes before and after make no character together
        for i in np.unique(np.searchsorted(begin + counts, gaps, side="right")).tolist():
            own = gaps[np.searchsorted(gaps, begin[i]) : np.searchsorted(gaps, begin[i] + counts[i])]
            cuts = [int(upto[i]), *ends[own].tolist(), int(upto[i + 1])]
            out[i] = "".join(flat[a:b].decode("utf-8", "each_byte") for a, b in zip(cuts, cuts[1:]))
        if self.prefix:  # the space before a text goes
            shown = np.flatnonzero((size > 0) | self.is_byte[ids]) if len(ids) else np.zeros(0, np.int64)
            k = np.searchsorted(shown, begin)
            for i in np.flatnonzero((counts > 0) & (k < len(shown))).tolist():
                if shown[k[i]] < begin[i] + counts[i] and self.spaced[ids[shown[k[i]]]]:
                    out[i] = out[i][1:]
        return out


def load(spark: SparkSession, path: str) -> Broadcast:
    """The model for all tasks; read by the driver."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(Model(f.read()))


def blocks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``BLOCK`` in size, of one row at least."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BLOCK, side="right")))
        yield a, b
        a = b


def encode(text: Column, model: Broadcast) -> Column:
    """The ids of a text, without begin and end."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def run(texts: pa.Array) -> pa.Array:
        lengths = pa.compute.fill_null(pa.compute.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
        ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for a, b in blocks(lengths):
            i, c = model.value.encode([t or "" for t in texts.slice(a, b - a).to_pylist()])
            ids.append(i)
            counts.append(c)
        ends = np.cumsum(np.concatenate(counts))
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(np.concatenate(ids), pa.int32()))

    return run(text.cast("string"))


def decode(ids: Column, model: Broadcast) -> Column:
    """The text of ids; no ids (also null) are the empty text."""

    @F.arrow_udf(T.StringType())
    def run(rows: pa.Array) -> pa.Array:
        counts = pa.compute.list_value_length(rows).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, ends = rows.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(counts))
        out: list[str] = []
        for a, b in blocks(counts):
            out += model.value.decode(flat[ends[a] : ends[b]], counts[a:b])
        return pa.array(out, pa.string())

    # an expression between the two functions, else Spark chains them and encodes once more for the decoder
    return run(F.coalesce(ids, F.array().cast("array<int>")))


def encoded(docs: DataFrame, path: str, *, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """The table with the ids of its texts."""
    return docs.withColumn(ids_col, encode(F.col(f"`{text_col}`"), load(docs.sparkSession, path)))


def decoded(docs: DataFrame, path: str, *, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """The table with the texts of its ids."""
    return docs.withColumn(text_col, decode(F.col(f"`{ids_col}`"), load(docs.sparkSession, path)))


def op12_sentencepiece_ids(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    rows = decoded(encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), path), path)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
