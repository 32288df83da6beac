"""SentencePiece encoding and decoding of merge-type (BPE) models, exactly as the library's.

A segmentation into pieces is the model's own exactly if every two neighbours are
compatible: merging their joined text again gives the same two pieces. So a text needs no
merging: an Aho-Corasick automaton gives the longest piece at each place, a check of the two
merge trees along the common border accepts or refuses it, shorter pieces follow, and a
field of failed places keeps the search linear.

The vocabulary is the model's (32,000 pieces): it is read once and broadcast. Texts are cut
where no piece can lie, as before word marks and stops; the different words of a batch are
coded once, and a worker remembers the codes of two times ``MEMORY`` words. A text whose
words' pieces spell it is its own decoding.

Nulls and empty texts have no ids and decode to the empty text. Every row gives one row;
all other columns are kept, a column named like a result is replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.llm.shipping import received, shared
from broadsheet.llm.words import sliced
from broadsheet.sources.tables import table

MARK = "▁"
#: Words and pairs a worker remembers before it forgets older ones.
MEMORY = 150_000


class Pieces:
    """A model's pieces with their merge trees."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = " é  AＡﬁ\t"
        if model.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("the model rewrites texts; only models with the identity rule are supported")
        n = model.get_piece_size()
        self.path = path
        self.unknown = model.unk_id()
        self.text = [model.id_to_piece(i) for i in range(n)]
        self.special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.bytes = {int(self.text[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        plain = [i for i in range(n) if i not in self.special and not model.is_byte(i)]
        self.id = {self.text[i]: i for i in plain}
        self.rank = {self.text[i]: -model.get_score(i) for i in plain}
        self.split: dict[str, tuple[str, str]] = {}
        for word in list(self.id):
            parts = self._merged(word)
            if len(parts) > 1:  # merging never makes this piece
                del self.id[word]
        self.letters = {w for w in self.id if len(w) == 1}
        self.openers = self._openers()
        self._coder: Coder | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_coder": None}

    def coder(self) -> Coder:
        """The coder of this process: what it remembers serves all tasks of a worker."""
        if self._coder is None:
            self._coder = Coder(self)
        return self._coder

    def _openers(self) -> set[str]:
        """Letters that no piece holds behind another kind of letter: a piece may begin at
        one, or go on from one, but never reaches one. So a text can be cut before them."""
        behind = {(a, b) for w in self.id for a, b in zip(w, w[1:])}
        out = {c for c in self.letters if not (c.isalpha() or c.isdecimal())}
        while refuted := {b for a, b in behind if b in out and a not in out}:
            out -= refuted
        return out

    def _merged(self, word: str) -> list[str]:
        """Plain merging of a piece's own letters; notes the last merge of a whole piece."""
        parts = list(word)
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, math.inf) for a, b in zip(parts, parts[1:])]
            best = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[best] == math.inf:
                break
            if len(parts) == 2:
                self.split[word] = (parts[0], parts[1])
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def border(self, word: str, side: int) -> list[tuple[str, float, float]]:
        """What stands at an end of a piece while it is merged: part, rank made, rank used up."""
        out, used = [], math.inf
        while True:
            made = self.rank[word] if word in self.split else -math.inf
            out.append((word, made, used))
            if word not in self.split:
                return out
            used, word = made, self.split[word][side]


class Coder:
    """Encodes and decodes with a model's pieces."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.find = ahocorasick.Automaton()
        for word in pieces.id:
            self.find.add_word(word, word)
        self.find.make_automaton()
        #: The longest piece that a piece begins with, itself aside.
        self.shorter = {w: next((w[:n] for n in range(len(w) - 1, 0, -1) if w[:n] in pieces.id), "") for w in pieces.id}
        self.fits: dict[tuple[str, str], bool] = {}
        self.codes: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}
        self.ends: dict[str, list] = {}
        self.starts: dict[str, list] = {}
        if pieces.openers:
            some = "".join(map(re.escape, sorted(pieces.openers)))
            known = "".join(map(re.escape, sorted(pieces.letters - pieces.openers)))
            # What the model has no letter for stands between pieces, too.
            self.cut = re.compile(f"[{some}]*[{known}]+|[{some}]+|[^{some}{known}]+").findall
        else:
            self.cut = lambda text: [text]
        self.plain = [b"" if i in pieces.special else t.replace(MARK, " ").encode() for i, t in enumerate(pieces.text)]
        for value, i in pieces.bytes.items():
            self.plain[i] = bytes([value])
        self.library = None
        self.spelled = pa.array(self.plain, pa.binary())
        self.sizes = np.array([len(p) for p in self.plain], np.int64)
        # No piece goes on with a space behind any other letter than these.
        behind = {a for w in pieces.id for a, b in zip(w, w[1:]) if b == MARK} | {MARK, " "}
        self.uncut = "(^|[" + "".join(map(re.escape, sorted(behind))) + "]) "

    def compatible(self, pair: tuple[str, str]) -> bool:
        """True if no merge crosses the border of the two pieces when their text is merged."""
        found = self.fits.get(pair)
        if found is None:
            if len(self.fits) > MEMORY:
                self.fits.clear()
            found = self.fits[pair] = not self._crossed(*pair)
        return found

    def _crossed(self, left: str, right: str) -> bool:
        lefts = self.ends.get(left) or self.ends.setdefault(left, self.pieces.border(left, 1))
        rights = self.starts.get(right) or self.starts.setdefault(right, self.pieces.border(right, 0))
        for a, a_made, a_used in lefts:
            for b, b_made, b_used in rights:
                if a_made < b_used and b_made < a_used:
                    # Of two equal merges the left one comes first.
                    rank = self.pieces.rank.get(a + b)
                    if rank is not None and rank < a_used and rank <= b_used:
                        return True
        return False

    def word(self, word: str) -> list[int]:
        found = self.codes.get(word)
        if found is None:
            if len(self.codes) > MEMORY:
                self.codes, self.older = {}, self.codes
            found = self.older.get(word)
            found = self.codes[word] = self._word(word) if found is None else found
        return found

    def _word(self, word: str) -> list[int]:
        if self.pieces.letters.issuperset(word):
            parts = [p for _, p in self.find.iter_long(word)]
            if not all(map(self.fits.get, zip(parts, parts[1:]))):
                parts = self._search(word)
            return [self.pieces.id[p] for p in parts]
        out: list[int] = []
        for known, text in self._known(word):
            out += [self.pieces.id[p] for p in self._search(text)] if known else self._spelled(text)
        return out

    def _known(self, word: str) -> Iterator[tuple[bool, str]]:
        """Stretches of letters that are pieces, and of those that are not."""
        start, known = 0, None
        for i, letter in enumerate(word):
            now = letter in self.pieces.id
            if known is not None and now != known:
                yield known, word[start:i]
                start = i
            known = now
        if word:
            yield bool(known), word[start:]

    def _spelled(self, text: str) -> list[int]:
        """Letters without a piece: by their bytes, or one unknown for a stretch of them."""
        if not self.pieces.bytes:
            return [self.pieces.unknown]
        return [self.pieces.bytes[b] for b in text.encode()]

    def _search(self, text: str) -> list[str]:
        fits, shorter, longest, end = self.fits, self.shorter, self.find.iter_long, len(text)
        failed = b""
        taken: list[str] = []
        at, before, steps = 0, "", longest(text)
        while at < end:
            piece = first = next(steps)[1]
            while True:
                while piece:
                    to = at + len(piece)
                    if not (failed and failed[to >> 3] >> (to & 7) & 1):
                        fit = not before or fits.get((before, piece))
                        if fit or (fit is None and self.compatible((before, piece))):
                            break
                    piece = shorter[piece]
                if piece:
                    break
                failed = failed or bytearray(end // 8 + 1)
                failed[at >> 3] |= 1 << (at & 7)
                last = taken.pop()
                at -= len(last)
                before, piece, first = taken[-1] if taken else "", shorter[last], ""
            taken.append(piece)
            at, before = to, piece
            if piece is not first:  # the walk over the longest pieces goes on from here
                steps = longest(text, at)
        return taken

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        return list(chain.from_iterable(map(self.word, self.cut(MARK + text.replace(" ", MARK)))))

    def decode(self, ids: list[int]) -> str:
        try:
            if self.pieces.unknown in ids:
                raise ValueError
            out = b"".join(map(self.plain.__getitem__, ids)).decode()
        except ValueError:  # bytes that are no text, and unknowns: the library has rules for them
            self.library = self.library or sentencepiece.SentencePieceProcessor(model_file=self.pieces.path)
            return self.library.decode([int(i) for i in ids])
        first = next((i for i in ids if i not in self.pieces.special), None)
        return out[1:] if first is not None and self.pieces.text[first].startswith(MARK) else out


    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words that stand behind a space, where each word's begin (n + 1 places), and
        whether they spell it."""
        texts = words.to_pylist()
        codes = [list(chain.from_iterable(map(self.word, self.cut(MARK + w)))) for w in texts]
        starts = np.r_[0, np.cumsum(np.fromiter(map(len, codes), np.int64, len(codes)))]
        ids = np.fromiter(chain.from_iterable(codes), np.int32, int(starts[-1]))
        got = np.frombuffer(self.spelled.take(pa.array(ids)).buffers()[2] or b"", np.uint8)
        at = np.r_[0, np.cumsum(self.sizes[ids])][starts]
        to = np.arange(len(texts) + 1) + np.r_[0, np.cumsum(pc.binary_length(words).to_numpy())]
        same = np.diff(at) == np.diff(to)
        want = "".join(f" {w}" for w in texts).encode()
        if got[: at[-1]].tobytes() != want:
            same &= np.array([got[a:b].tobytes() == want[c:d] for a, b, c, d in zip(at[:-1], at[1:], to[:-1], to[1:])], bool)
        return ids, starts, same

    def batch(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Ids and decoded texts of a column."""
        texts = texts.cast(pa.string()).fill_null("")
        odd = pc.match_substring_regex(texts, self.uncut)
        plain = np.flatnonzero(pc.and_(pc.greater(pc.binary_length(texts), 0), pc.invert(odd)).to_numpy(zero_copy_only=False))
        lists = pc.split_pattern(texts.take(pa.array(plain)), " ")
        flat = lists.flatten().dictionary_encode()
        ids, starts, same = self.words(flat.dictionary)
        place = flat.indices.to_numpy()
        sizes = np.diff(starts)[place]
        ends = np.cumsum(sizes)
        long = ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[place] - (ends - sizes), sizes)]
        rows = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))].astype(np.int64)
        bounds = np.r_[0, ends][rows]
        spelled = np.logical_and.reduceat(same[place], rows[:-1]) if len(plain) else np.zeros(0, bool)
        parts: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        decoded: dict[int, str] = {}
        for row, a, b, whole in zip(plain.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), spelled.tolist()):
            parts[row] = long[a:b]
            if not whole:
                decoded[row] = self.decode(parts[row].tolist())
        for row in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            code = self.encode(texts[row].as_py())
            parts[row], decoded[row] = np.array(code, np.int32), self.decode(code)
        listed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *parts])))
        if decoded:
            other = np.zeros(len(texts), bool)
            other[list(decoded)] = True
            texts = pc.replace_with_mask(texts, pa.array(other), pa.array([decoded[row] for row in sorted(decoded)], pa.string()))
        return listed, texts


def coded(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int) and ``decoded`` (the ids' text)."""
    docs = docs.drop(*({"ids", "decoded"} - {text}))
    pieces = shared(docs.sparkSession.sparkContext, Pieces(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = received(pieces).coder()
        for batch in sliced(batches, text):
            added = coder.batch(batch.column(text))
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "ids", "decoded"])

    schema = T.StructType([*docs.schema, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: number of ids, and digests of the ids and of the decoded text."""
    return coded(docs.select("doc_id", "text"), path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
