"""Alignment of two tokenizers' tokens by the bytes that they share.

A text is encoded by a byte-level vocabulary (A) and a piece vocabulary (B). Places where
tokens of both end cut it into groups; tokens whose bytes overlap are linked. Both come from
one galloping intersection of the two lists of ends: the shorter one drives, an exponential
and then a binary search find each of its ends in the longer one. Equal ends cut the groups,
and the difference between the places of two ends is the range of tokens that overlap.

Neither vocabulary has a token across a space that stands between two other characters, so a
text is encoded and aligned word by word, the different words of a batch all at once. The
links of a pair of ids are counted over all documents in a first pass: per batch by word, then
by a grouped sum. Workers map the sorted counts from the shared folder in a second pass. Counts are at most
one per pair of ids, cut into files by id; the highest count per id of B (as many as the
vocabulary has) is broadcast.

Null and empty texts, and texts whose tokens' bytes are not those of the text behind a space,
have no tokens: all numbers are 0 and ``groups`` is empty. Every row gives one row; other
columns but the text are kept, columns named like a result are replaced.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.llm.arrays import Run, Sorted, write
from broadsheet.llm.words import sliced
from broadsheet.session import materialize, work_path
from broadsheet.sources.tables import table

MARK = "▁"
#: Bytes of text aligned at a time; a longer text is aligned by itself.
SLICE = 1 << 23
#: Words of up to so many tokens gallop side by side.
LANE = 64
#: Links counted in a worker before they are handed on.
BUFFER = 1 << 21
#: Ids of A in one file of counts.
RANGE = 512
NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
# Fixed value: how byte-level vocabularies split a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space by any of the rules in use.
SPACE = "\x09-\x0d\x1c-\x20\x85\xa0  -     　"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes: printable ones for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def read_vocabularies(byte_path: str, piece_path: str) -> tuple[dict[bytes, int], bytes]:
    """Ranks of A's tokens and B's model. A's ids must follow its merges."""
    with open(byte_path, encoding="utf-8") as source:
        whole = json.load(source)
    letters, model, rule = byte_letters(), whole["model"], whole["pre_tokenizer"]
    special = {t["content"] for t in whole["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    made = [ranks[bytes(letters[c] for c in "".join(pair.split(" ") if isinstance(pair, str) else pair))] for pair in model["merges"]]
    if whole["normalizer"] or rule["type"] != "ByteLevel" or rule["add_prefix_space"] or made != list(range(256, 256 + len(made))):
        raise ValueError("only byte-level vocabularies in the order of their merges are supported")
    with open(piece_path, "rb") as source:
        return ranks, source.read()


def _spans(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the stretches of these lengths."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def places(short: list[int], long: list[int]) -> list[int]:
    """For each number of ``short`` the place of the first one of ``long`` that is no smaller.
    Both ascend and end alike."""
    out, at = [], 0
    for end in short:
        low, step = at, 1
        while at < len(long) and long[at] < end:
            low, at, step = at + 1, at + step, step * 2
        at = bisect_left(long, end, low, min(at, len(long) - 1))
        out.append(at)
    return out


def side_by_side(short: np.ndarray, s: np.ndarray, long: np.ndarray, t: np.ndarray) -> np.ndarray:
    """``places`` of many pairs of lists at once, one list of each pair in the stretches ``s``
    (from, to) of ``short``, the other in ``t`` of ``long``: each pair gallops by itself."""
    out = np.zeros(len(short), np.int64)
    sizes, at = s[1] - s[0], t[0].copy()
    for i in np.flatnonzero(sizes > LANE):
        out[s[0][i] : s[1][i]] = t[0][i] + np.array(places(short[s[0][i] : s[1][i]].tolist(), long[t[0][i] : t[1][i]].tolist()))
    live = np.flatnonzero(sizes <= LANE)
    for k in range(int(sizes[live].max(initial=0))):
        live = live[sizes[live] > k]
        end, low, high, last, step = short[s[0][live] + k], at[live], at[live], t[1][live] - 1, 1
        on = np.flatnonzero(long[high] < end)
        while len(on):
            low[on] = high[on] + 1
            high[on] = np.minimum(high[on] + step, last[on])
            on, step = on[long[high[on]] < end[on]], step * 2
        on = np.flatnonzero(low < high)
        while len(on):
            middle = (low[on] + high[on]) >> 1
            less = long[middle] < end[on]
            low[on[less]], high[on[~less]] = middle[less] + 1, middle[~less]
            on = on[low[on] < high[on]]
        out[s[0][live] + k] = at[live] = low
    return out


def intersect(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of pairs of lists of ends, stretches of ``a`` and ``b``: where both have an end (a flag
    for each end of either), and the overlapping ranges (places in ``a``, places in ``b``)."""
    spans = [np.stack([starts[:-1], starts[1:]]) for starts in (a_starts, b_starts)]
    swap = np.diff(b_starts) < np.diff(a_starts)
    flags, links = (np.zeros(len(a), bool), np.zeros(len(b), bool)), []
    for turned in (False, True):
        one, other = (1, 0) if turned else (0, 1)
        short, long = (a, b)[one], (a, b)[other]
        s, t = spans[one][:, swap == turned], spans[other][:, swap == turned]
        found = side_by_side(short, s, long, t)
        sizes = s[1] - s[0]
        each = np.repeat(s[0], sizes) + _spans(sizes)
        at = found[each]
        same = long[at] == short[each]
        flags[one][each[same]] = flags[other][at[same]] = True
        first = np.r_[0, at[:-1] + same[:-1]][: len(at)]
        heads = np.cumsum(sizes) - sizes
        first[heads] = t[0]
        wide = at - first + 1
        pair = np.repeat(each, wide), np.repeat(first, wide) + _spans(wide)
        links.append(pair[::-1] if turned else pair)
    return *flags, *(np.concatenate(x) for x in zip(*links))


class Words:
    """The alignments of different words.

    ``good`` tells the words whose tokens spell them, ``numbers`` has a row per word (n_a, n_b,
    n_groups, n_links), ``links`` are numbers a * kinds + b, ``owner`` is the word of each.
    """

    def __init__(self, good: np.ndarray, numbers: np.ndarray, links: np.ndarray, owner: np.ndarray, groups: pa.Array):
        self.good, self.numbers, self.links, self.owner, self.groups = good, numbers, links, owner, groups

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per word the sum of its links' values."""
        out = np.zeros(len(self.good), np.int64)
        np.add.at(out, self.owner, values)
        return out


class Aligner:
    """Both vocabularies in a worker process."""

    def __init__(self, ranks: dict[bytes, int], model: bytes):
        self.bytes_coder = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.piece_coder = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.a_sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.a_sizes[i] = len(token)
        n = self.kinds = self.piece_coder.get_piece_size()
        pieces = [self.piece_coder.id_to_piece(i) for i in range(n)]
        spelled = [bytes([int(p[3:5], 16)]) if self.piece_coder.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.b_sizes, self.spelled = np.array([len(p) for p in spelled], np.int64), pa.array(spelled, pa.binary())
        # Behind these a piece can go on with a space, so no cut is safe.
        joined = {x for p in pieces for x, y in zip(p, p[1:]) if y == MARK} | {MARK}
        unsafe = SPACE + "".join(map(re.escape, sorted(joined)))
        self.cut = re.compile(f"(?<=[^{unsafe}]) (?=[^{SPACE}])").split
        self.irregular = f"(^|[{unsafe}]) | ([{SPACE}]|$)"
        self.edged = f"^[{SPACE}]|[{SPACE}]$"
        #: Ids as text behind a sign: all with the first sign, all with the second, and so on.
        self.signs = max(len(self.a_sizes), n)
        self.signed = pa.array([f"{sign}{i}" for sign in ";|," for i in range(self.signs)], pa.string())

    def _spell(self, words: list[str], sizes: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """True for words that are what their pieces spell."""
        spelled = self.spelled.take(pa.array(ids))
        ends = np.cumsum(self.b_sizes[ids])
        at = np.r_[0, ends][starts]
        got = np.frombuffer(spelled.buffers()[2] or b"", np.uint8)[: at[-1]].tobytes()
        want = "".join(f" {w}" for w in words).encode()
        out = np.diff(at) == sizes
        if got != want:
            to = np.r_[0, np.cumsum(sizes)]
            out &= np.array([got[a:b] == want[c:d] for a, b, c, d in zip(at[:-1], at[1:], to[:-1], to[1:])], bool)
        return out

    def words(self, dictionary: pa.Array) -> tuple[np.ndarray, Words]:
        """The alignments of words (in an order of their own) and the place of each word in it."""
        edged = pc.match_substring_regex(dictionary, self.edged).to_numpy(zero_copy_only=False)
        order = np.r_[np.flatnonzero(~edged), np.flatnonzero(edged)]
        words = dictionary.take(pa.array(order)).to_pylist()
        plain = len(words) - int(edged.sum())
        sizes = pc.binary_length(dictionary).to_numpy().astype(np.int64)[order] + 1
        pieces = self.piece_coder.encode(words, num_threads=1)
        n_b = np.fromiter(map(len, pieces), np.int64, len(pieces))
        b = np.fromiter(chain.from_iterable(pieces), np.int64, int(n_b.sum()))
        good = self._spell(words, sizes, b, np.r_[0, np.cumsum(n_b)])
        kept = np.flatnonzero(good)
        b, n_b, sizes = b[np.repeat(good, n_b)], n_b[kept], sizes[kept]
        # Words without white space at their ends are cut from each other by the spaces between.
        whole = [words[i] for i in kept[: np.searchsorted(kept, plain)]]
        a = self.bytes_coder.encode_ordinary(" " + " ".join(whole)) if whole else []
        for i in kept[len(whole) :]:
            a += self.bytes_coder.encode_ordinary(" " + words[i])
        a = np.array(a, np.int64)
        a_ends, b_ends, ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b]), np.cumsum(sizes)
        a_starts, b_starts = np.r_[0, np.searchsorted(a_ends, ends) + 1], np.r_[0, np.cumsum(n_b)]
        a_flags, b_flags, x, y = intersect(a_ends, a_starts, b_ends, b_starts)
        owner = np.searchsorted(a_starts, x, side="right") - 1
        some = np.r_[0, np.cumsum(a_flags)]
        numbers = np.zeros((len(words), 4), np.int64)
        numbers[kept] = np.stack([np.diff(a_starts), n_b, np.diff(some[a_starts]), np.bincount(owner, minlength=len(kept))], axis=1)
        groups = self._groups(a, a_flags, b, b_flags, a_starts + b_starts, good)
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        return place, Words(good, numbers, a[x] * self.kinds + b[y], kept[owner], groups)

    def _groups(self, a: np.ndarray, a_flags: np.ndarray, b: np.ndarray, b_flags: np.ndarray, starts: np.ndarray, good: np.ndarray) -> pa.Array:
        """The words' groups as texts, each with a semicolon before it; empty for bad words."""
        mine = [np.cumsum(f) - f for f in (a_flags, b_flags)]
        n_a, n_b = (np.bincount(m, minlength=int(a_flags.sum())) for m in mine)
        begin = np.cumsum(n_a + n_b) - n_a - n_b
        out = np.empty(len(a) + len(b), np.int64)
        for ids, own, size, skip, sign in ((a, mine[0], n_a, 0, 0), (b, mine[1], n_b, n_a, 1)):
            within = _spans(size)
            out[(begin + skip)[own] + within] = ids + self.signs * np.where(within == 0, sign, 2)
        spelled = self.signed.take(pa.array(out))
        bounds = np.r_[0, np.cumsum(pc.binary_length(spelled).to_numpy())][starts]
        all_bounds = np.zeros(len(good) + 1, np.int32)
        np.cumsum(_scattered(np.diff(bounds), good), out=all_bounds[1:])
        return pa.StringArray.from_buffers(len(good), pa.py_buffer(all_bounds), spelled.buffers()[2])

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words]:
        """Rows with tokens, where their words begin, the words' places among the different
        ones, and the alignments of those."""
        texts = texts.cast(pa.string()).fill_null("")
        some = pc.greater(pc.binary_length(texts), 0)
        odd = pc.match_substring_regex(texts, self.irregular)
        parts, rows = [], []
        for odds in (False, True):
            mine = np.flatnonzero(pc.and_(some, odd if odds else pc.invert(odd)).to_numpy(zero_copy_only=False))
            chosen = texts.take(pa.array(mine))
            if odds:
                split = [self.cut(" " + t) for t in chosen.to_pylist()]
                lists = pa.array([[s[0][1:], *s[1:]] for s in split], pa.list_(pa.string()))
            else:
                lists = pc.split_pattern(chosen, " ").cast(pa.list_(pa.string()))
            parts.append(lists)
            rows.append(mine)
        lists = pa.concat_arrays(parts)
        coded = lists.flatten().dictionary_encode()
        starts = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))].astype(np.int64)
        order, found = self.words(coded.dictionary)
        place = order[coded.indices.to_numpy()]
        rows = np.concatenate(rows)
        if not found.good.all():  # a text with such a word has no tokens at all
            good = np.logical_and.reduceat(found.good[place], starts[:-1])
            sizes = np.diff(starts)
            place = place[np.repeat(good, sizes)]
            rows, starts = rows[good], np.r_[0, np.cumsum(sizes[good])]
        return rows, starts, place, found


def _scattered(values: np.ndarray, where: np.ndarray) -> np.ndarray:
    out = np.zeros(len(where), values.dtype)
    out[where] = values
    return out


def _aligner(state: list) -> Aligner:
    """The process's aligner, made from the broadcast vocabularies by its first task."""
    if len(state) == 1:
        state.append(Aligner(*state[0]))
    return state[1]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[cuts], np.add.reduceat(counts, cuts) if len(cuts) else counts


def link_counts(docs: DataFrame, vocabularies: tuple[dict[bytes, int], bytes], text: str = "text") -> DataFrame:
    """(pair, links): how many links of all documents hold a pair of ids."""
    shared = docs.sparkSession.sparkContext.broadcast([vocabularies])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(shared.value)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def counted() -> tuple[np.ndarray, np.ndarray]:
            return _summed(*(np.concatenate(c) for c in zip(*held)))

        for batch in sliced(batches, 0, SLICE):
            _, _, place, found = aligner.batch(batch.column(0))
            often = np.bincount(place, minlength=len(found.good))
            held.append(_summed(found.links, often[found.owner]))
            if sum(len(k) for k, _ in held) > BUFFER:
                held = [counted()]
                if len(held[0][0]) > BUFFER // 2:
                    yield pa.RecordBatch.from_arrays([*map(pa.array, held[0])], names=["pair", "links"])
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([*map(pa.array, counted())], names=["pair", "links"])

    parts = docs.select(text).mapInArrow(run, "pair long, links long")
    return parts.groupBy("pair").agg(F.sum("links").alias("links"))


def _mapped(counts: DataFrame, kinds: int, folder: str) -> list[Run]:
    """The counts as sorted files of the shared folder, each with a range of A's ids."""

    def store(rows: pa.Table) -> pa.Table:
        keys, links = (rows.column(c).to_numpy() for c in ("pair", "links"))
        order = np.argsort(keys)
        name = write(folder, [keys[order], links[order]])
        return pa.table({"first": [int(keys[order[0]])], "rows": [len(keys)], "name": [name]})

    files = counts.groupBy(F.floor(F.col("pair") / (kinds * RANGE))).applyInArrow(store, "first long, rows long, name string")
    return [Run(f["first"], f["rows"], f["name"], ("<i8", "<i8")) for f in files.collect()]


def aligned(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text") -> DataFrame:
    """``docs`` without its text, with n_a, n_b, n_groups, n_links, n_best (links whose pair is
    the most frequent one of its id of B), count_sum (of the links' pairs) and ``groups``."""
    spark = docs.sparkSession
    ranks, model = vocabularies = read_vocabularies(byte_path, piece_path)
    kinds = sentencepiece.SentencePieceProcessor(model_proto=model).get_piece_size()
    counts = materialize(link_counts(docs, vocabularies, text), "links")
    folder = work_path(spark, "pairs")
    runs = [(r.first, r.rows, r.name, r.types) for r in _mapped(counts, kinds, folder)]
    best = np.zeros(kinds, np.int64)
    for piece, most in counts.groupBy((F.col("pair") % kinds).alias("piece")).agg(F.max("links")).collect():
        best[piece] = most
    shared = spark.sparkContext.broadcast([vocabularies])
    figures = spark.sparkContext.broadcast((folder, runs, best))
    kept = [c for c in docs.columns if c != text and c not in (*NUMBERS, "groups")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(shared.value)
        place_, files, most = figures.value
        known = Sorted(place_, [Run(*r) for r in files])
        for batch in sliced(batches, text, SLICE):
            rows, starts, place, found = aligner.batch(batch.column(text))
            keys, back = np.unique(found.links, return_inverse=True)
            often = known.take(known.find(keys), 1)
            top = often == most[keys % kinds]
            numbers = np.column_stack([found.numbers, found.sums(top[back]), found.sums(often[back])])
            out = np.zeros((batch.num_rows, 6), np.int64)
            spelled = found.groups.take(pa.array(place))
            if len(rows):
                out[rows] = np.add.reduceat(numbers[place], starts[:-1], axis=0)
            # The documents' texts lie one behind the other, in the order of ``rows``.
            bounds = np.r_[0, np.cumsum(pc.binary_length(spelled).to_numpy())][starts].astype(np.int32)
            texts = pa.StringArray.from_buffers(len(rows), pa.py_buffer(bounds), spelled.buffers()[2])
            turn = np.full(batch.num_rows, -1)
            turn[rows] = np.arange(len(rows))
            groups = pc.utf8_slice_codeunits(texts.take(pa.array(turn, mask=turn < 0)), 1).fill_null("")
            columns = [*(batch.column(c) for c in kept), *(pa.array(out[:, k]) for k in range(6)), groups]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *NUMBERS, "groups"])

    schema = docs.select(*kept).schema
    for name in NUMBERS:
        schema = schema.add(name, "long")
    return docs.select(*kept, text).mapInArrow(run, schema.add("groups", "string"))


def digests(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Per document: the numbers and a digest of the groups, empty without tokens."""
    rows = aligned(docs.select("doc_id", "text"), byte_path, piece_path)
    digest = F.when(F.col("groups") != "", F.sha2("groups", 256)).otherwise("")
    return rows.select("doc_id", *NUMBERS, digest.alias("groups_sha256"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return digests(table(spark, folder, "documents"), *paths)
