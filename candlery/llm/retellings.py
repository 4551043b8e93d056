"""Near-duplicate texts with small edits by Order MinHash and banded alignment (problem 1)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: (minima per sketch, sketches) that keep text order, and that don't. The first find nearly all; the others are the way
#: out for texts whose sentences were cut differently, so that their order can't be restored.
ORDERED, ORDERLESS = (6, 22), (8, 16)
#: Texts of at most so many words have too few for those and get these sketches, which keep order, besides.
SHORT_WORDS, SHORT = 24, (3, 12)
SIMILARITY = 0.7
#: Stands between the texts of an item and ends a sentence.
BETWEEN = " "
# Marks that end a sentence before a space, and those that end one by themselves.
MARKS, WIDE_MARKS = ".!?…؟", "。！？।" + BETWEEN
WORD, SPACE, MARK, WIDE_MARK, OTHER, UNKNOWN = 1, 2, 3, 4, 0, 255
_PAD = np.uint64(2**64 - 1)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Keys have so many bits; the zeros above them compress. Chance meetings of unlike keys are candidates like any other.
KEY_BITS = np.uint64(48)
#: Texts or pairs that one step works on, and cells of the alignment table that advance together.
TEXTS, CELLS = 2_000, 1 << 18
_kinds = np.full(0x110000, UNKNOWN, np.uint8)
#: What a code point adds to the hash of its word, before the power of its place; 0 outside words.
_parts = np.zeros(0x110000, np.uint64)


def _kind(c: str) -> int:
    if c in WIDE_MARKS:
        return WIDE_MARK
    if c in MARKS:
        return MARK
    if c.isspace():
        return SPACE
    return WORD if unicodedata.category(c)[0] in "LN" else OTHER


def _kinds_of(codes: np.ndarray) -> np.ndarray:
    kinds = _kinds[codes]
    fresh = np.unique(codes[kinds == UNKNOWN])
    if len(fresh):
        _kinds[fresh] = [_kind(chr(c)) for c in fresh.tolist()]
        _parts[fresh] = np.where(_kinds[fresh] == WORD, _mixed(fresh.astype(np.uint64) * _GOLDEN), np.uint64(0))
        kinds = _kinds[codes]
    return kinds


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(n, base, np.uint64))


#: Powers 1, 2, ... of the odd factor and of its inverse modulo 2⁶⁴, for as many code points as most steps have.
_UP, _DOWN = _powers(_GOLDEN, 1 << 21), _powers(np.uint64(pow(int(_GOLDEN), -1, 1 << 64)), 1 << 21)


def _words(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of many texts as one run, the number of each text's words; kinds of all code points, and the
    place of each word in them.

    Words are the longest runs of letters and digits of the lower-cased text. All texts are cut at once, by arrays over
    their code points.
    """
    lowered = [t.lower() for t in texts]
    bounds = np.cumsum(np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1)
    codes = np.frombuffer((" ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.intp)
    kinds = _kinds_of(codes)
    edges = np.flatnonzero(np.diff(kinds == WORD, prepend=False))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(lowered), np.int64), kinds, starts
    # powers count from the first code point of all; the inverse takes back what lies before a word
    n = len(codes)
    up, down = (_UP, _DOWN) if n <= len(_UP) else (_powers(_UP[0], n), _powers(_DOWN[0], n))
    sums = np.add.reduceat(_parts[codes] * up[:n], starts)
    sums *= np.where(starts > 0, down[starts - 1], np.uint64(1))
    return _mixed(sums + lengths.astype(np.uint64)), np.diff(np.searchsorted(starts, bounds), prepend=0), kinds, starts


def tokenised(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of many texts as one run of 64-bit hashes, the number of each text's words, and which words begin a sentence."""
    hashes, lengths, kinds, starts = _words(texts)
    begins = np.zeros(len(hashes), bool)
    begins[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    # a sentence begins after a mark and a space, after a mark that needs none, and with the text; the last mark counts
    spots = np.flatnonzero(kinds >= MARK)
    follows = np.searchsorted(starts, spots)
    last = np.append(follows[1:] != follows[:-1], True)[: len(spots)] & (follows < len(starts))
    spots, follows = spots[last], follows[last]
    spaces = np.append(-1, np.flatnonzero(kinds == SPACE))
    spaced = spaces[np.searchsorted(spaces, starts[follows]) - 1] > spots
    begins[follows[spaced | (kinds[spots] == WIDE_MARK)]] = True
    return hashes, lengths, begins


def class_of(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each text's words, counted as often as they occur, whatever their order."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(hashes ^ _GOLDEN))])
    ends = np.cumsum(lengths)
    return _mixed(sums[ends] - sums[ends - lengths] + lengths.astype(np.uint64))


def _moved(order: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of all members of runs that are put into another order."""
    n = lengths[order]
    return np.repeat(starts[order] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def in_sentence_order(hashes: np.ndarray, doc: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The words with the sentences of each text in the order of their least hashes, so that moved sentences meet again."""
    starts = np.flatnonzero(begins)
    if not len(starts):
        return hashes
    lengths = np.diff(np.append(starts, len(hashes)))
    x, keys = _mixed(hashes * _GOLDEN), []
    for _ in range(3):
        least = np.minimum.reduceat(x, starts)
        keys.append(least)
        x = np.where(x == np.repeat(least, lengths), _PAD, x)
    return hashes[_moved(np.lexsort((*keys[::-1], doc[starts])), starts, lengths)]


def _labelled(tokens: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Tokens told apart by their occurrence in their text: the first, the second and so on of equal words differ."""
    key = (doc.astype(np.uint64) << np.uint64(52)) | (tokens >> np.uint64(12))
    order = np.argsort(key)
    key = key[order]
    same = np.zeros(len(key), bool)
    same[1:] = key[1:] == key[:-1]
    same[:-1] |= same[1:]
    # the sort is not stable: only words that come again are put in the order of the text
    again = order[same]
    again = again[np.lexsort((again, key[same]))]
    t, d = tokens[again], doc[again]
    fresh = np.ones(len(t), bool)
    fresh[1:] = (t[1:] != t[:-1]) | (d[1:] != d[:-1])
    starts = np.flatnonzero(fresh)
    occurrence = np.arange(len(t)) - np.repeat(starts, np.diff(np.append(starts, len(t))))
    out, later = tokens.copy(), occurrence > 0
    out[again[later]] = _mixed(t[later] + _mixed(occurrence[later].astype(np.uint64) * _GOLDEN))
    return out


def _keys(matrix: np.ndarray, seeds: Sequence[int], minima: int, ordered: bool) -> np.ndarray:
    """A key per row and seed: the minima of a random order of the row's tokens, in text order or in none.

    Tokens are ordered by 20 bits of a hash, ties by position, in 32 bits while the position fits beside them.
    """
    pad = matrix == _PAD
    width = matrix.shape[1]
    half = (matrix >> np.uint64(32)).astype(np.uint32)
    narrow = width <= 1 << 12
    kind, low, most = (np.uint32, 0xFFF, 0xFFFFFFFF) if narrow else (np.uint64, 0xFFFFFFFF, 2**64 - 1)
    position = np.where(pad, kind(most), np.arange(width, dtype=kind))
    labels = np.where(pad, np.uint64(0), matrix).ravel()
    powers = np.multiply.accumulate(np.full(minima, _GOLDEN, np.uint64)) if ordered else np.ones(minima, np.uint64)
    first, least = np.arange(len(matrix))[:, None] * width, np.empty((len(seeds), len(matrix), min(minima, width)), kind)
    x, y = np.empty_like(half), np.empty_like(half)
    for s, seed in enumerate(seeds):
        np.multiply(half, np.uint32((2 * seed + 1) & 0xFFFFFFFF), out=x)
        np.right_shift(x, np.uint32(16), out=y)
        np.bitwise_xor(x, y, out=x)
        np.multiply(x, np.uint32(0x7FEB352D), out=x)
        np.bitwise_and(x, np.uint32(0xFFFFF000), out=x)
        z = x if narrow else x.astype(np.uint64) << np.uint64(32)
        z |= position
        if width > minima:
            z.partition(minima - 1, axis=1)
        least[s] = z[:, :minima]
    least &= kind(low)
    if ordered:
        least.sort(axis=2)
    # places beyond the row are those of rows with too few words, whose last place is empty
    labels = labels[first + np.minimum(least, kind(width - 1)).astype(np.int64)]
    sums = (labels * powers[: labels.shape[2]]).sum(axis=2, dtype=np.uint64) + np.array(seeds, np.uint64)[:, None]
    return (_mixed(sums) >> (np.uint64(64) - KEY_BITS)).T


def sketch_keys(hashes: np.ndarray, lengths: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all sketches of texts given as one run of word hashes; and the text of each key."""
    seeds = np.random.default_rng(20_240).integers(1, 2**62, ORDERED[1] + ORDERLESS[1] + SHORT[1]).tolist()
    one, two = ORDERED[1], ORDERED[1] + ORDERLESS[1]
    doc = np.repeat(np.arange(len(lengths)), lengths)
    labels = _labelled(in_sentence_order(hashes, doc, begins), doc)
    starts = np.cumsum(lengths) - lengths
    keys, owners = [], []
    width = -(-lengths // 16) * 16
    for w in np.unique(width[lengths > 0]):
        rows = np.flatnonzero((width == w) & (lengths > 0))
        matrix = np.full((len(rows), w), _PAD, np.uint64)
        inside = np.arange(w) < lengths[rows, None]
        matrix[inside] = labels[(starts[rows, None] + np.arange(w))[inside]]
        parts = [(rows, _keys(matrix, seeds[:one], ORDERED[0], True)), (rows, _keys(matrix, seeds[one:two], ORDERLESS[0], False))]
        few = lengths[rows] <= SHORT_WORDS
        if few.any():
            parts.append((rows[few], _keys(matrix[few], seeds[two:], SHORT[0], True)))
        for r, k in parts:
            keys.append(k.ravel())
            owners.append(np.repeat(r, k.shape[1]))
    return (np.concatenate(keys), np.concatenate(owners)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def banded_edits(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Insertions and deletions that turn one of each pair of word sequences into the other, along a band of so many cells
    on either side of the diagonal; -1 where the ends of the sequences lie beyond the band.

    ``a`` and ``b`` are runs of word numbers, ``la`` and ``lb`` the lengths of the sequences in them. All pairs advance
    together, a counterdiagonal of the alignment at a time: its cells depend on the two before it, not on each other.
    """
    n, w, steps = len(la), int(band.max(initial=0)), int((la + lb).max(initial=0))
    padded = []
    for x, lengths, nothing in ((a, la, -2), (b, lb, -1)):
        table = np.full((n, int(lengths.max(initial=0))), nothing, np.int32)
        table[np.arange(table.shape[1]) < lengths[:, None]] = x
        around = np.full((steps + 2 * w + 4, n), nothing, np.int32)  # word i in row w + 1 + i
        around[w + 1 : w + 1 + table.shape[1]] = table.T
        padded.append(around)
    left, right = padded
    small = np.int16 if steps < 8_000 else np.int32
    far = small(16_000 if small is np.int16 else 1 << 29)
    cost = np.full((2 * w + 3, n), far, small)  # of the last cell on each diagonal k = j - i, in row w + 1 + k
    cost[w + 1] = 0
    out, reach = np.full(n, -1, np.int64), np.abs(lb - la) <= band
    ends = np.argsort(la + lb, kind="stable")
    bounds = np.searchsorted((la + lb)[ends], np.arange(steps + 2))
    for d in range(steps + 1):
        if d:
            k = min(w, d)
            k -= (k + d) & 1  # diagonals -k, -k + 2, ..., k
            i, j = (d + k) // 2, (d - k) // 2
            cells = slice(w + 1 - k, w + 2 + k, 2)
            same = left[w + i - k : w + i + 1][::-1] == right[w + j : w + j + k + 1]
            step = np.minimum(cost[w - k : w + 1 + k : 2], cost[w + 2 - k : w + 3 + k : 2]) + small(1)
            cost[cells] = np.minimum(step, np.where(same, cost[cells], far))
        done = ends[bounds[d] : bounds[d + 1]]
        done = done[reach[done]]
        if len(done):
            out[done] = cost[w + 1 + (lb - la)[done], done]
    return out


def _in_order_of(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, begins: np.ndarray, numbers: int) -> np.ndarray:
    """Sequences ``b`` with their sentences in the order in which their words come in ``a``.

    A sentence stands where the words lie, on average, that are in both texts once; one without such words stays behind
    the sentence before it.
    """
    if not len(b):
        return b
    pa_, pb = np.repeat(np.arange(len(la)), la), np.repeat(np.arange(len(lb)), lb)
    ua, ia, na = np.unique(pa_ * numbers + a, return_index=True, return_counts=True)
    ub, ib, nb = np.unique(pb * numbers + b, return_index=True, return_counts=True)
    ua, ia, ub, ib = ua[na == 1], ia[na == 1], ub[nb == 1], ib[nb == 1]
    _, ka, kb = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    starts = np.flatnonzero(begins)
    lengths = np.diff(np.append(starts, len(b)))
    segment = np.searchsorted(starts, ib[kb], "right") - 1
    met = np.bincount(segment, minlength=len(starts))
    place = np.bincount(segment, weights=ia[ka], minlength=len(starts)) / np.maximum(met, 1)
    # a sentence without a place takes that of the last one that has any, within the pair
    pair = pb[starts]
    known = np.maximum.accumulate(np.where(met > 0, np.arange(len(starts)), -1))
    has = (known >= 0) & (pair[known] == pair)
    place = np.where(has, place[known], -1.0)
    return b[_moved(np.lexsort((np.arange(len(starts)), place, pair)), starts, lengths)]


def _at(lengths: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    return _moved(chosen, np.cumsum(lengths) - lengths, lengths)


def _shared(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, numbers: int) -> np.ndarray:
    """How many words the texts of each pair share, counted as often as they occur in both: one sort of numbers that hold
    the pair, the word and, in the last bit, the side."""
    kind = np.uint32 if 2 * len(la) * numbers < 1 << 32 else np.uint64
    sides = []
    for side, (n, x) in enumerate(((la, a), (lb, b))):
        keys = np.repeat(np.arange(len(n), dtype=kind) * kind(2 * numbers), n)
        keys += x.astype(kind) * kind(2) + kind(side)
        sides.append(keys)
    keys = np.sort(np.concatenate(sides))
    words = keys >> kind(1)
    fresh = np.ones(len(words), bool)
    fresh[1:] = words[1:] != words[:-1]
    runs = np.flatnonzero(fresh)
    if not len(runs):
        return np.zeros(len(la), np.int64)
    second = np.add.reduceat((keys & kind(1)).astype(np.int64), runs)
    both = np.minimum(np.diff(np.append(runs, len(words))) - second, second)
    return np.bincount((words[runs] // kind(numbers)).astype(np.int64), weights=both, minlength=len(la)).astype(np.int64)


def judged_pairs(first: Sequence[str], second: Sequence[str], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(edits, similar) of pairs of texts; edits is -1 where no alignment within the band proves them similar.

    Shared words are counted exactly; only the pairs that have enough of them are aligned, as an alignment keeps no other
    words: the sentences of one text are put in the order of the other's, then words are aligned, with so few insertions
    and deletions that enough words are kept. A text of several pairs is cut once.
    """
    texts: dict[str, int] = {}
    of = np.fromiter((texts.setdefault(t, len(texts)) for side in (first, second) for t in side), np.int64, len(first) + len(second))
    hashes, lengths, begins = tokenised(list(texts))
    known, words = np.unique(hashes, return_inverse=True)
    ia, ib = of[: len(first)], of[len(first) :]
    la, lb = lengths[ia], lengths[ib]
    enough = np.ceil(threshold / (1 + threshold) * (la + lb) - 1e-9).astype(np.int64)
    edits, similar = np.full(len(la), -1, np.int64), np.zeros(len(la), bool)
    chosen = np.flatnonzero((np.minimum(la, lb) >= enough) & (enough > 0))
    shared = _shared(words[_at(lengths, ia[chosen])], la[chosen], words[_at(lengths, ib[chosen])], lb[chosen], len(known) + 1)
    chosen = chosen[shared >= enough[chosen]]
    if not len(chosen):
        return edits, similar
    similar[chosen] = True
    chosen = chosen[np.argsort(np.maximum(la, lb)[chosen], kind="stable")]
    # the text with more sentences is the one whose sentences can be moved to where they are in the other
    sentences = np.bincount(np.repeat(np.arange(len(lengths)), lengths), weights=begins, minlength=len(lengths))
    more = sentences[ia] > sentences[ib]
    at = 0
    while at < len(chosen):
        size = max(1, CELLS // (2 * int((np.maximum(la, lb) - enough)[chosen[at]]) + 8))
        part = chosen[at : at + size]
        at += len(part)
        for side, (i, j) in ((more[part], (ia, ib)), (~more[part], (ib, ia))):
            p = part[side]
            if len(p):
                ix, iy = _at(lengths, i[p]), _at(lengths, j[p])
                xs = _in_order_of(words[iy], lengths[j[p]], words[ix], lengths[i[p]], begins[ix], len(known) + 1)
                edits[p] = banded_edits(words[iy], lengths[j[p]], xs, lengths[i[p]], (np.maximum(la, lb) - enough)[p])
    # so many words are kept by the alignment
    edits[(edits < 0) | (la + lb - edits < 2 * enough)] = -1
    return edits, similar


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, TEXTS):
            yield whole.slice(at, TEXTS)


@F.arrow_udf(T.LongType())
def _class(texts: pa.Array) -> pa.Array:
    found = []
    for at in range(0, len(texts), TEXTS):
        hashes, lengths, _, _ = _words(texts.slice(at, TEXTS).to_pylist())
        found.append(class_of(hashes, lengths).view(np.int64))
    return pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        keys, owners = sketch_keys(*tokenised(batch.column("text").to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column("cls").take(pa.array(owners))], names=["key", "cls"])


def _verifier(threshold: float):
    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            edits, similar = judged_pairs(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), threshold)
            columns = [batch.column("cls_a"), batch.column("cls_b"), pa.array(edits, mask=edits < 0)]
            yield pa.RecordBatch.from_arrays(columns, names=["cls_a", "cls_b", "edits"]).filter(pa.array(similar))

    return verified


def text_classes(items: DataFrame, key: str, *texts: str) -> tuple[DataFrame, DataFrame]:
    """(item, cls) of every item with a word, each key once; and (cls, text), one text for each class.

    A class holds the texts with the same words, counted as often as they occur: cls is a 64-bit hash of the words (of n
    texts two unlike ones share it with probability n²/2⁶⁵). Copies collapse before anything is compared.
    """
    rows = items.select(F.col(key).alias("item"), F.concat_ws(BETWEEN, *texts).alias("text")).where(F.col("text").rlike(r"[\p{L}\p{N}]"))
    rows = rows.select("item", "text", F.coalesce(_class("text"), F.lit(0).cast("long")).alias("cls"))  # never null: no filters that tell its uses apart
    members = rows.where("item is not null").groupBy("item").agg(F.min("cls").alias("cls"))
    return members, rows.groupBy("cls").agg(F.min("text").alias("text"))


def similar_classes(classes: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """cls_a < cls_b, edits (null if many) of the pairs of classes whose texts are similar.

    Order MinHash sketches of the words, sentences in an order of their own, put texts into buckets; texts that share one
    are candidates. The exact count of shared words decides; a banded alignment, sentence by sentence, gives the edits of
    those that are similar. Buckets hold each class once and are joined, not collected, so adaptive execution
    splits a large one.
    """
    buckets = classes.mapInArrow(_buckets, "key long not null, cls long not null")
    left, right = buckets.alias("l"), buckets.alias("r")
    pairs = (
        left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l.cls") < F.col("r.cls")))
        .select(F.col("l.cls").alias("cls_a"), F.col("r.cls").alias("cls_b"))
        .distinct()
    )
    texts = pairs.join(classes.select(F.col("cls").alias("cls_a"), F.col("text").alias("text_a")), "cls_a")
    texts = texts.join(classes.select(F.col("cls").alias("cls_b"), F.col("text").alias("text_b")), "cls_b")
    return texts.select("cls_a", "cls_b", "text_a", "text_b").mapInArrow(_verifier(threshold), "cls_a long not null, cls_b long not null, edits long")


def similar_pairs(items: DataFrame, key: str, *texts: str, threshold: float = SIMILARITY) -> DataFrame:
    """item_a < item_b of all pairs of items whose texts are similar, copies included.

    Items without a word (null, empty or punctuation only) are in no pair. A repeated key counts once.
    """
    members, classes = text_classes(items, key, *texts)
    linked = similar_classes(classes, threshold)
    a, b = (members.select(F.col("cls").alias(f"cls_{s}"), F.col("item").alias(f"i_{s}")) for s in "ab")
    unlike = linked.select("cls_a", "cls_b").join(a, "cls_a").join(b, "cls_b").select("i_a", "i_b")
    alike = members.alias("l").join(members.alias("r"), (F.col("l.cls") == F.col("r.cls")) & (F.col("l.item") < F.col("r.item")))
    both = unlike.union(alike.select(F.col("l.item"), F.col("r.item")))
    return both.select(F.least("i_a", "i_b").alias("item_a"), F.greatest("i_a", "i_b").alias("item_b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, least) of every node of (a, b): the least node of its connected component.

    Alternates large-star and small-star: every node hands its neighbours to the least of them, so the number of rounds
    grows with the logarithm of a component's size, not with its diameter. Minima are combined before each shuffle and a
    star's rows are joined, never collected. Rounds end when one of them leaves the edges as they are.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        near = pairs.union(pairs.select("b", "a")).toDF("u", "v") if large else pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = near.join(least, "u")
        if large:
            return moved.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        ends = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
        return ends.where("a != b").distinct()

    edges = edges.toDF("a", "b").where("a != b").distinct().checkpoint()
    seen = None
    while True:
        edges = star(star(edges, True), False).checkpoint()
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == seen:
            break
        seen = state
    return edges.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), "least").union(edges.select("b", "b").distinct())


def story_groups(items: DataFrame, key: str, *texts: str, threshold: float = SIMILARITY) -> DataFrame:
    """item, story, links, copies: one row per item with a word.

    story is the smallest class of the connected component of similar classes; links counts the other classes linked to
    the item's, copies the items of its own class. Links are cut off by a checkpoint in the shared folder.
    """
    members, classes = text_classes(items, key, *texts)
    linked = similar_classes(classes, threshold).select("cls_a", "cls_b").checkpoint()
    links = linked.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
    stories = components(linked).toDF("cls", "story")
    copies = members.groupBy("cls").agg(F.count("*").alias("copies"))
    known = members.join(copies, "cls").join(stories, "cls", "left").join(links, "cls", "left")
    return known.select("item", F.coalesce("story", "cls").alias("story"), F.coalesce("links", F.lit(0)).alias("links"), "copies")
