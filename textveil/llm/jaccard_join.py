"""Near-duplicate documents by an exact n-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct k-word shingles, lower-cased in A-Z, as 64-bit hashes. Two
documents link when ``100 * intersection >= percent * union``. Sets are ordered by rarity: a bounded
table of frequent shingles puts those last, all others go by hash. In this order, sets that link
share at least l tokens within their first ``n - ceil(t * n) + l`` tokens. Each document picks the l
of least estimated cost (tokens to index, and pairs to verify), so a prefix that holds frequent
tokens is lengthened, and a pair is verified only if it shares as many prefix tokens as the smaller
of both l demands.

Documents with equal sets are one class and travel once. A prefix token travels with a parity sketch
of its class: one bit for each of a number of cells that grows with the set, whether the cell holds an
odd number of its shingles. What two sets share cancels out, so the bits in which two sketches differ
are at most as many as the shingles in which the sets differ, and classes that share a token by chance
are told apart where their rows meet; only others are emitted. A token whose classes would make more
than ``pairs_most`` comparisons of fitting sizes, or ``emit_most`` pairs, for each class, yields no
pairs. Its classes are joined on partition keys instead: shingles are dealt by hash into more parts than two sets that link
can differ in shingles, so some part is the same in both, and its content's hash is a key that
unrelated texts don't share. A key that more than ``group_most`` classes share, a family of copies,
yields a star around its first class instead of all pairs; the classes that stars hold together are
compared with the one among them that is in most groups, and then, those that this left apart, with
all others, in blocks of bounded size whose tasks return spanning links alone. So no link between
components is lost and no list of pairs grows with the square of a group. All tables between the
first and the last are keyed by class; a class or a component of very many rows is looked up in a
broadcast of bounded size (``common.looked_up``).

Defined results: a text with fewer than k words is one shingle of all its words; a null text or one
without words has no shingles, links with nothing and is its own component. Copies and repeated rows
share a component; its name is the smallest id in it. A row whose id is null is dropped from the
join and kept by ``keep_first``. An empty table gives an empty table; other columns are not read.
Set equality and intersections are exact up to collisions of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textveil.llm.common import checkpointed, looked_up
from textveil.llm.components import connected_components
from textveil.llm.textblock import blocks, mix, windows

#: Rows of the table of frequent shingles, which is broadcast: four megabytes. A task reports a quarter at most.
FREQUENT_MOST = 1 << 18
#: Ids up to which the list of documents to verify is broadcast: some 32 MB.
BROADCAST_IDS = 1_000_000
#: A star outranks every demand for shared prefix tokens.
STAR = 1 << 20


def shingle_sets(column, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text of an Arrow column, in order."""
    for block in blocks(column):
        starts, ends, first = block.words()
        hashes = block.hashes(starts, ends, lower=True)
        at, value = windows(hashes, first, k)
        cut = np.searchsorted(at, first)
        for d in range(block.n):
            n = first[d + 1] - first[d]
            if 0 < n < k:
                yield windows(hashes[first[d] : first[d + 1]], np.array([0, n]), int(n))[1]
            else:
                yield np.unique(value[cut[d] : cut[d + 1]])


def class_keys(sets: list[np.ndarray]) -> list[int]:
    """64-bit names of sets: equal sets have one name."""
    size = np.array([len(s) for s in sets], dtype=np.uint64)
    total = np.zeros(len(sets), dtype=np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        flat = np.concatenate([sets[i] for i in full])
        begin = np.cumsum(size[full]).astype(np.int64) - size[full].astype(np.int64)
        total[full] = np.add.reduceat(mix(flat + np.uint64(0x2545F4914F6CDD1D)), begin)
    return mix(total + size * np.uint64(0xD1342543DE82EF95)).view(np.int64).tolist()


def meta_of(size, place, demand):
    """A set's size, a token's place in its order (up to 2**24), and the shared tokens that it demands (up to 7), as one number."""
    return (size << 27) | (place << 3) | demand


def least_common(n, percent: int):
    """Tokens that a set of n must share to link with any set: ceil(percent * n / 100)."""
    return -(-percent * n // 100)


def sketch_words(n: int, percent: int, most: int = 8) -> int:
    """64-bit words of the sketch of a set of n: enough to tell unrelated sets apart, a power of two up to ``most``."""
    apart, words = 2 * n * (100 - percent) / (100 + percent), 1
    while words < most and 64 * words - 2 * (64 * words) ** 0.5 < 2 * apart:
        words *= 2
    return words


def sketch(shingles: np.ndarray, words: int) -> np.ndarray:
    """A set's parity sketch, as bytes. Sketches of twice the words fold into it by exclusive or of their halves."""
    cell = (mix(shingles + np.uint64(0xA24BAED4963EE407)) & np.uint64(64 * words - 1)).astype(np.int64)
    return np.packbits(np.bincount(cell, minlength=64 * words).astype(np.uint8) & 1, bitorder="little")


def _classes_and_counts(batches, k: int, count_frequent: bool) -> Iterator[pa.RecordBatch]:
    """Rows (kind 0, id, class, size), and (kind 1, null, shingle, documents) for shingles that a run of texts repeats."""
    held: list[np.ndarray] = []
    heavy = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    seen: set[int] = set()
    room = 0

    def count() -> None:
        nonlocal heavy
        if held:
            values, n = np.unique(np.concatenate(held), return_counts=True)
            heavy = _summed(np.concatenate([heavy[0], values[n > 1]]), np.concatenate([heavy[1], n[n > 1]]), FREQUENT_MOST)
            held.clear()

    for batch in batches:
        sets = [*shingle_sets(batch.column(1), k)]
        keys, sizes = class_keys(sets), [len(s) for s in sets]
        for key, s in zip(keys, sets, strict=True):
            if count_frequent and key not in seen:
                seen.add(key)
                held.append(s)
                room += len(s)
            if room > 1 << 21:
                count()
                room = 0
        n = len(keys)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int8)), batch.column(0).cast(pa.int64()), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64())], ["kind", "id", "key", "n"])
    count()
    value, n = _summed(*heavy, FREQUENT_MOST // 4)
    yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(n), np.int8)), pa.nulls(len(n), pa.int64()), pa.array(value.view(np.int64)), pa.array(n)], ["kind", "id", "key", "n"])


def _summed(values: np.ndarray, n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Totals by value, the ``most`` largest."""
    values, at = np.unique(values, return_inverse=True)
    n = np.bincount(at, weights=n, minlength=len(values)).astype(np.int64)
    top = np.argsort(-n, kind="stable")[:most]
    return values[top], n[top]


def ordered_tokens(shingles: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a set from rare to frequent, and the other documents expected to hold each.

    A token is the shingle's hash below six bits for the logarithm of its count.
    """
    expected = np.zeros(len(shingles))
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        expected = np.where(frequent[at] == shingles, counts[at], 0.0)
    level = np.ceil(np.log2(expected + 1)).astype(np.uint64)
    tokens = (level << np.uint64(58)) | (shingles >> np.uint64(6))
    order = np.argsort(tokens)
    return tokens[order], expected[order]


def choose_matches(expected: np.ndarray, n: int, percent: int, most: int = 7, verify_cost: float = 0.5, unlisted: float = 0.3, again: float = 0.3) -> tuple[int, int]:
    """How many shared tokens to demand, and the prefix length that this takes, at least estimated cost.

    Indexing costs a unit for each token and each posting that it meets: those expected, and
    ``unlisted`` for a token that the table of frequent shingles doesn't list. A document that shares
    a token by chance shares one more with probability ``again``; verifying one that shares as many
    as demanded costs ``verify_cost`` for each token of the set.
    """
    common = least_common(n, percent)
    met = np.cumsum(np.maximum(expected, unlisted))
    demand = np.arange(1, min(most, max(common, 1)) + 1)
    length = np.minimum(n, n - common + demand)
    postings = met[length - 1]
    best = int(np.argmin(length + postings + verify_cost * n * postings * again ** (demand - 1)))
    return int(demand[best]), int(length[best])


def _prefix_rows(batches, k: int, percent: int, frequent: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (token, class, size and place and demand, sketch) of every class's prefix; a task sends a class once."""
    seen: set[int] = set()
    for batch in batches:
        tokens, keys, metas, sketches, widths = [], [], [], [], []
        sets = [*shingle_sets(batch.column(1), k)]
        for key, s in zip(class_keys(sets), sets, strict=True):
            if not len(s) or key in seen:
                continue
            seen.add(key)
            ordered, expected = ordered_tokens(s, frequent, counts)
            demand, length = choose_matches(expected, len(s), percent)
            own = sketch(s, sketch_words(len(s), percent))
            tokens.append(ordered[:length])
            keys.append(np.full(length, key, np.int64))
            metas.append(meta_of(len(s), np.arange(length), demand))
            sketches.append(np.tile(own, length))
            widths.append(np.full(length, len(own), np.int32))
        if tokens:
            ends = np.concatenate([[0], np.cumsum(np.concatenate(widths), dtype=np.int32)]).astype(np.int32)
            written = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate(sketches))])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(metas)), written], ["token", "key", "meta", "sketch"])


def partition_keys(shingles: np.ndarray, percent: int, frequent: np.ndarray) -> list[np.ndarray]:
    """Keys of a set's parts: sets that link have one in common.

    Sizes fall into classes of ratio 100 / percent, so sizes of a link are in the same or in
    neighbouring classes; a set is dealt out for its own class and for the next. Below a size of
    ``top``, two sets that link differ in d = ``top * 2 * (1 - t) / (1 + t)`` shingles at most. With
    d + s parts, s are the same in both, so by the prefix rule one of these is among the first d + 1
    of either set in any order that goes by a part's content. Parts come in the order of how many
    shingles they hold that the table doesn't list as frequent, then of how many they hold; so those
    that chance or a common passage makes alike are left out.
    """
    n = len(shingles)
    own = int(np.floor(np.log(n) / -np.log(percent / 100) + 1e-9))
    rare = np.ones(n, dtype=np.int64)
    if len(frequent):
        rare[frequent[np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)] == shingles] = 0
    out = []
    for level in (own, own + 1):
        differ = int((100 / percent) ** (level + 1) * 2 * (100 - percent) / (100 + percent) + 1e-6)
        parts = differ + max(4, differ // 3)
        part = (mix(shingles + np.uint64(level)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        held, begin = np.unique(part[order], return_index=True)
        content = np.zeros(parts, dtype=np.uint64)
        content[held] = np.add.reduceat(mix(shingles[order] + np.uint64(0x5851F42D4C957F2D)), begin)
        key = mix(content ^ mix(np.arange(parts, dtype=np.uint64) + np.uint64(level << 32)))
        rank = np.lexsort((key, -np.bincount(part, minlength=parts), -np.bincount(part, weights=rare, minlength=parts)))
        out.append(key[rank[: differ + 1]])
    return out


def _partition_rows(batches, k: int, percent: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (key of a part, class, size) of every class; a task sends a class once."""
    seen: set[int] = set()
    for batch in batches:
        tokens, keys, metas = [], [], []
        sets = [*shingle_sets(batch.column(1), k)]
        for key, s in zip(class_keys(sets), sets, strict=True):
            if not len(s) or key in seen:
                continue
            seen.add(key)
            for part in partition_keys(s, percent, frequent):
                tokens.append(part)
                keys.append(np.full(len(part), key, np.int64))
                metas.append(np.full(len(part), meta_of(len(s), 0, 1), np.int64))
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(metas))], ["token", "key", "meta"])


_PAIRS = ["a", "b", "na", "nb", "need", "shared"]
PAIRS = "a long, b long, na long, nb long, need long, shared long"


class _Pairs:
    """Pairs that a task has found, summed up by pair before they go on."""

    def __init__(self, percent: int):
        self.percent, self.n = percent, 0
        self.found: list[tuple[np.ndarray, ...]] = []

    def may_link(self, meta1, meta2) -> np.ndarray:
        """Whether sizes and places allow a link: what two sets share lies before the token in both, or behind it in both."""
        n1, n2 = meta1 >> 27, meta2 >> 27
        i, j = (meta1 >> 3) & 0xFFFFFF, (meta2 >> 3) & 0xFFFFFF
        most = np.minimum(i, j) + np.minimum(n1 - i, n2 - j)
        return 100 * most >= self.percent * (n1 + n2 - most)

    def add(self, key1, meta1, key2, meta2, shared: int) -> None:
        if len(key1):
            low = key1 <= key2
            n1, n2 = meta1 >> 27, meta2 >> 27
            self.found.append((np.where(low, key1, key2), np.where(low, key2, key1), np.where(low, n1, n2), np.where(low, n2, n1), np.minimum(meta1 & 7, meta2 & 7), np.full(len(key1), shared)))
            self.n += len(key1)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.found:
            a, b, na, nb, need, shared = (np.concatenate(x) for x in zip(*self.found, strict=True))
            self.found, self.n = [], 0
            order = np.lexsort((b, a))
            a, b, shared = a[order], b[order], shared[order]
            new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            columns = a[new], b[new], na[order][new], nb[order][new], need[order][new], np.add.reduceat(shared, new)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], _PAIRS)


def _starts(token: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)


def _by_token(batches, columns: int, rows: int) -> Iterator[tuple[list, bool]]:
    """Columns of rows sorted by token, in runs of about ``rows``: whole groups of equal tokens, but for a group that alone exceeds a run (then True). Repeated rows of a class follow each other and count once."""
    held: list[pa.RecordBatch] = []
    kept = None  # the run's rest: the group under way
    size = 0

    def gathered(more: list[pa.RecordBatch]) -> list:
        table = pa.Table.from_batches(more).combine_chunks() if more else None
        own = [] if table is None else [table.column(i).to_numpy() for i in range(3)] + [np.asarray(table.column(i).to_pylist(), dtype=object) for i in range(3, columns)]
        own = own if kept is None else kept if not own else [np.concatenate([x, y]) for x, y in zip(kept, own, strict=True)]
        if own and len(own[0]):
            new = np.concatenate([[True], (own[0][1:] != own[0][:-1]) | (own[1][1:] != own[1][:-1])])
            own = [x[new] for x in own]
        return own

    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size < rows:
            continue
        own = gathered(held)
        held, size, last = [], 0, int(_starts(own[0])[-1])
        if last:
            yield [x[:last] for x in own], False
            kept = [x[last:] for x in own]
        else:
            yield own, True
            kept = [x[-1:] for x in own]  # in case its class goes on
    own = gathered(held)
    if own and len(own[0]):
        yield own, False


class _Sketches:
    """Sketches of rows, folded to each width."""

    def __init__(self, column: np.ndarray):
        self.words = np.array([len(x) >> 3 for x in column], dtype=np.int64)
        most = int(self.words.max()) if len(column) else 1
        whole = np.zeros((len(column), most), dtype=np.uint64)
        for w in np.unique(self.words):
            at = np.flatnonzero(self.words == w)
            whole[at, :w] = np.frombuffer(b"".join(column[at]), dtype="<u8").reshape(len(at), w)
        self.folded = {most: whole}
        while most > 1:
            half = most >> 1
            self.folded[half] = np.where((self.words > half)[:, None], whole[:, :half] ^ whole[:, half:], whole[:, :half])
            whole, most = self.folded[half], half

    def differ(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """In how many shingles the sets of rows i and j differ at least."""
        words, out = np.minimum(self.words[i], self.words[j]), np.zeros(len(i), dtype=np.int64)
        for w, folded in self.folded.items():
            at = np.flatnonzero(words == w)
            if len(at):
                out[at] = np.bitwise_count(folded[i[at]] ^ folded[j[at]]).sum(axis=1, dtype=np.int64)
        return out


def _prefix_pairs(batches, percent: int, pairs_most: int, emit_most: int, run_rows: int = 1 << 15, chunk: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Pairs of classes that share a token and may link, from rows sorted by token and size; and, with b null, the classes of tokens that yield no pairs.

    For each class of a token, others of like size follow it. A token that would take more than
    ``pairs_most`` comparisons a class, or yield more than ``emit_most`` pairs a class, yields none.
    """
    out, marked = _Pairs(percent), set()
    over = None  # the token of a group that is larger than a run

    def marks(keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.array([x for x in np.unique(keys).tolist() if x not in marked], dtype=np.int64)
        marked.update(new.tolist())  # a task names a class once
        if len(new):
            nothing, none = np.zeros(len(new), np.int64), pa.nulls(len(new), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(new), none, pa.array(nothing), pa.array(nothing), pa.array(nothing), pa.array(nothing)], _PAIRS)

    for (token, key, meta, column), large in _by_token(batches, 4, run_rows):
        if large:
            over = token[0]
            yield from marks(key)
            continue
        begin = _starts(token)
        size = np.diff(np.append(begin, len(token)))
        group = np.repeat(np.arange(len(begin)), size)
        n = meta >> 27
        place = (group << 32) + n
        follow = np.searchsorted(place, (group << 32) + 100 * n // percent, side="right") - np.arange(len(token)) - 1
        wide = np.add.reduceat(follow, begin) > pairs_most * size
        wide[0] |= token[0] == over
        follow[wide[group]] = 0
        sketches = _Sketches(column)
        found, ends = [], np.cumsum(follow)
        at = 0
        while at < len(token):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chunk, side="right")))
            count = follow[at:stop]
            i = np.repeat(np.arange(at, stop), count)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
            fit = out.may_link(meta[i], meta[j])
            i, j = i[fit], j[fit]
            fit = sketches.differ(i, j) * (100 + percent) <= (n[i] + n[j]) * (100 - percent)
            found.append((i[fit], j[fit]))
            at = stop
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        wide |= np.bincount(group[i], minlength=len(begin)) > emit_most * size
        few = ~wide[group[i]]
        i, j = i[few], j[few]
        out.add(key[i], meta[i], key[j], meta[j], 1)
        yield from marks(key[wide[group]])
        if out.n > 100_000:
            yield from out.flush()
    yield from out.flush()


def _star_pairs(batches, percent: int, group_most: int, run_rows: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """Pairs of classes from rows sorted by token and size: all of a token, or, of more than ``group_most`` classes, the first with each other."""
    out = _Pairs(percent)
    centre = None  # (token, class, meta) of a group that is streaming

    def star(key1, meta1, keys, metas) -> None:
        # Classes of a star are compared with each other later, however unlike their sizes are to its centre's.
        out.add(np.full(len(keys), key1), np.full(len(keys), meta1), keys, metas, STAR)

    for (token, key, meta), large in _by_token(batches, 3, run_rows):
        begin = _starts(token)
        size = np.diff(np.append(begin, len(token)))
        for s in np.unique(size[size > 1]):
            at = begin[size == s]
            if centre is not None and token[0] == centre[0]:
                at = at[at > 0]
            if large or s > group_most:
                for x in at:
                    star(key[x], meta[x], key[x + 1 : x + s], meta[x + 1 : x + s])
                continue
            for i in range(s):
                for j in range(i + 1, s):
                    fit = out.may_link(meta[at + i], meta[at + j])
                    out.add(key[at + i][fit], meta[at + i][fit], key[at + j][fit], meta[at + j][fit], 1)
        if centre is not None and len(token) and token[0] == centre[0]:
            more = key[: size[0]] != centre[1]
            star(centre[1], centre[2], key[: size[0]][more], meta[: size[0]][more])
        elif large:
            centre = (token[0], key[0], meta[0])
        if out.n > 100_000:
            yield from out.flush()
    yield from out.flush()


def _verified(batches, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs that link, from rows (a, part, id, set): the set of a itself comes first in each part."""
    centre = None
    for batch in batches:
        a, part, ids, sets = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)
        links = []
        for i, own in enumerate(zip(a, part, strict=True)):
            values = np.frombuffer(sets[i].as_buffer(), dtype=np.uint64)
            if ids[i] == a[i]:
                centre = (own, values.copy())
            elif centre[0] != own:
                raise ValueError(f"the set of {own} is missing")
            else:
                common = len(np.intersect1d(centre[1], values, assume_unique=True))
                if 100 * common >= percent * (len(values) + len(centre[1]) - common):
                    links.append((a[i], ids[i]))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], ["a", "b"])


def common_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products of bounded width."""
    sides = [(np.repeat(np.arange(len(x)), [len(s) for s in x]), np.concatenate(x) if x else np.zeros(0, np.uint64)) for x in (left, right)]
    both = np.intersect1d(sides[0][1], sides[1][1])
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for c in range(0, len(both), columns):
        part = both[c : c + columns]
        dense = []
        for (row, value), n in zip(sides, (len(left), len(right)), strict=True):
            at = np.minimum(np.searchsorted(part, value), len(part) - 1)
            hit = part[at] == value
            m = np.zeros((n, len(part)), dtype=np.float32)
            m[row[hit], at[hit]] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return np.rint(out).astype(np.int64)


def _block_links(rows: pa.Table, percent: int) -> pa.Table:
    """Spanning links between the components of two blocks of a cluster."""
    side, ids, comps = (rows.column(c).to_numpy() for c in ("side", "id", "comp"))
    sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in rows.column("sets").combine_chunks()]
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    n = np.array([len(s) for s in sets])
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    out = []
    if len(left) and len(right):
        common = common_counts([sets[i] for i in left], [sets[i] for i in right])
        linked = 100 * common >= percent * (n[left][:, None] + n[right][None, :] - common)
        linked &= comps[left][:, None] != comps[right][None, :]
        for i, j in zip(*np.nonzero(linked), strict=True):
            a, b = root(int(comps[left[i]])), root(int(comps[right[j]]))
            if a != b:
                parent[a] = b
                out.append((int(ids[left[i]]), int(ids[right[j]])))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})


def _chosen(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is in ``ids(id)``; the list is broadcast up to a fixed size, else both sides are dealt by id."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "id", "left_semi")


def _sets_of(docs: DataFrame, classes: DataFrame, names: DataFrame, k: int, unique: bool) -> DataFrame:
    """``(id, sets)`` of the classes ``names(id)``: the class, and its set as packed hashes, from the first document of each.

    Without ``unique``, rows that repeat a document's id count once.
    """

    def run(batches):
        for batch in batches:
            sets = [*shingle_sets(batch.column(1), k)]
            yield pa.RecordBatch.from_arrays([pa.array(class_keys(sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "sets"])

    names = checkpointed(classes.join(names, classes["key"] == names["id"]).select("key", F.col("first").alias("id")))
    chosen = _chosen(docs, names.select("id").distinct())
    if not unique:
        chosen = chosen.groupBy("id").agg(F.min("text").alias("text"))
    return chosen.mapInArrow(run, "id long, sets binary")


def _verify(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, percent: int, unique: bool, part_rows: int = 512) -> DataFrame:
    """The pairs ``(a, b)`` that link. The set of a travels once for every ``part_rows`` of its partners."""
    total = pairs.count()
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / part_rows).alias("parts"), F.count("*").alias("key_rows"))
    met = checkpointed(looked_up(pairs, parts, "a", total).select("a", F.pmod(F.xxhash64("b"), "parts").alias("part"), "b"))
    rows = met.select("a", "part", F.col("b").alias("id")).union(met.select("a", "part", "a").distinct())
    sets = _sets_of(docs, classes, rows.select("id").distinct(), k, unique)
    rows = rows.join(sets, "id").select("a", "part", "id", "sets").repartition("a", "part").sortWithinPartitions("a", "part", F.col("id") != F.col("a"))
    return checkpointed(rows.mapInArrow(lambda b: _verified(b, percent), "a long, b long"))


def _clusters(stars: DataFrame) -> DataFrame:
    """``(node, n, cluster, main)``: clusters that stars ``(a, b, na, nb, tokens)`` span; main is the node in the most groups."""
    nodes = stars.select(F.col("b").alias("node"), F.col("nb").alias("n"), "tokens").union(stars.select("a", "na", "tokens"))
    nodes = nodes.groupBy("node").agg(F.max("n").alias("n"), F.max("tokens").alias("tokens"))
    placed = checkpointed(nodes.join(connected_components(stars), "node").withColumnRenamed("component", "cluster"))
    main = placed.groupBy("cluster").agg(F.max_by("node", F.struct("tokens", "node")).alias("main"), F.count("*").alias("key_rows"))
    return checkpointed(looked_up(placed, main, "cluster", placed.count()).select("node", "n", "cluster", "main"))


def _cluster_links(docs: DataFrame, classes: DataFrame, clusters: DataFrame, links: DataFrame, k: int, percent: int, unique: bool, block_rows: int, block_tokens: int) -> DataFrame:
    """Links within clusters between components of ``links(a, b)``."""
    comp = connected_components(links)
    member = checkpointed(
        clusters.join(comp.withColumnRenamed("component", "comp"), "node", "left").select(F.col("node").alias("id"), "cluster", "n", F.coalesce("comp", "node").alias("comp"))
    )
    each = member.groupBy("cluster", "comp").agg(F.count("*").alias("rows"), F.sum("n").alias("tokens"))
    whole = each.groupBy("cluster").agg(F.count("*").alias("comps"), F.max_by("comp", F.struct("rows", "comp")).alias("main"), F.max("rows").alias("rows"), F.max("tokens").alias("tokens"), F.sum("rows").alias("all_rows"), F.sum("tokens").alias("all_tokens"), F.sum("rows").alias("key_rows")).where("comps > 1")

    def parts(rows, tokens):
        return F.greatest(F.lit(1), F.ceil(F.greatest(F.col(rows) / block_rows, F.col(tokens) / block_tokens)).cast("long"))

    # The members of the main component are compared with others alone: blocks below ``inner`` are theirs.
    whole = whole.select("cluster", "key_rows", "main", parts("rows", "tokens").alias("inner"), (F.col("all_rows") - F.col("rows")).alias("rows"), (F.col("all_tokens") - F.col("tokens")).alias("tokens"))
    placed = looked_up(member, whole.select("cluster", "key_rows", "main", "inner", parts("rows", "tokens").alias("outer")), "cluster", member.count())
    block = F.when(F.col("comp") == F.col("main"), F.pmod(F.xxhash64("id"), "inner")).otherwise(F.col("inner") + F.pmod(F.xxhash64("id"), "outer"))
    placed = checkpointed(placed.select("cluster", "id", "comp", "inner", "outer", block.alias("block")))
    outside = F.sequence(F.col("inner"), F.col("inner") + F.col("outer") - 1)
    other = F.when(F.col("block") < F.col("inner"), outside).otherwise(F.concat(F.sequence(F.lit(0), F.col("inner") - 1), outside))
    sent = placed.withColumn("other", F.explode(other)).select(
        "cluster", "id", "comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"),
    )
    sets = _sets_of(docs, classes, placed.select("id").distinct(), k, unique)

    def run(rows: pa.Table) -> pa.Table:
        return _block_links(rows, percent)

    return sent.join(sets, "id").groupBy("cluster", "i", "j").applyInArrow(run, "a long, b long")


def linked_components(
    docs: DataFrame, k: int, percent: int, candidates, count_frequent: bool = True, unique: bool = True, partition: bool = False,
    group_most: int = 12, pairs_most: int = 64, emit_most: int = 6, block_rows: int = 512, block_tokens: int = 1 << 19,
) -> DataFrame:
    """``(id, n, component, copies)`` of every row of ``docs(id, text)``: its set's size, its component, and the rows of its class.

    ``candidates(table)`` is given the broadcast table of frequent shingles and returns the function
    that makes rows (token, class, ``meta_of``) of batches of ``docs``; classes that share as
    many tokens as they demand are compared. Without ``unique``, many rows may repeat an id and its text.
    With ``partition``, rows have a sketch too, and classes of tokens that many share are compared if
    they share a partition key.
    """
    spark = docs.sparkSession
    found = checkpointed(docs.mapInArrow(lambda b: _classes_and_counts(b, k, count_frequent), "kind byte, id long, key long, n long"))
    top = found.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(FREQUENT_MOST).toArrow() if count_frequent else None
    frequent = top.column("key").to_numpy().view(np.uint64) if top is not None else np.zeros(0, np.uint64)
    order = np.argsort(frequent)
    counts = top.column("n").to_numpy().astype(np.float64)[order] if top is not None else np.zeros(0)
    table = spark.sparkContext.broadcast((frequent[order], counts))
    found = found.where("kind = 0").select("id", "key", "n")
    classes = checkpointed(found.where("n > 0").groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("copies")))

    def paired(tokens: DataFrame, pairs) -> DataFrame:
        sorted_rows = tokens.repartition("token").sortWithinPartitions("token", "meta", "key")
        met = sorted_rows.mapInArrow(pairs, PAIRS).groupBy("a", "b", "na", "nb").agg(F.min("need").alias("need"), F.sum("shared").alias("shared"))
        return checkpointed(met.where("shared >= need").select("a", "b", "na", "nb", F.floor(F.col("shared") / STAR).alias("tokens")))

    def star_pairs(batches):
        return _star_pairs(batches, percent, group_most)

    rows = docs.mapInArrow(candidates(table), "token long, key long, meta long" + (", sketch binary" if partition else ""))
    if partition:
        pairs = paired(rows, lambda b: _prefix_pairs(b, percent, pairs_most, emit_most))
        marked, pairs = pairs.where("b is null").select(F.col("a").alias("key")), pairs.where("b is not null")
        if not marked.isEmpty():
            chosen = checkpointed(classes.join(marked, "key").select(F.col("first").alias("id")).distinct())
            rows = _chosen(docs, chosen).mapInArrow(lambda b: _partition_rows(b, k, percent, table.value[0]), "token long, key long, meta long")
            pairs = checkpointed(pairs.union(paired(rows, star_pairs)).groupBy("a", "b", "na", "nb").agg(F.max("tokens").alias("tokens")))
    else:
        pairs = paired(rows, star_pairs)

    fit = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (F.col("tokens") == 0)
    verify = pairs.where(fit).select("a", "b")
    stars = pairs.where("tokens > 0")
    starry = not stars.isEmpty()
    if starry:
        clusters = _clusters(stars)
        verify = verify.union(clusters.where("node <> main").select(F.col("main").alias("a"), F.col("node").alias("b")))
    links = _verify(docs, classes, verify, k, percent, unique)
    if starry:
        links = checkpointed(links.union(_cluster_links(docs, classes, clusters, links, k, percent, unique, block_rows, block_tokens)))
    comps = checkpointed(classes.join(connected_components(links).withColumnRenamed("node", "key"), "key"))
    least = comps.groupBy("component").agg(F.min("first").alias("least"), F.count("*").alias("key_rows"))
    named = looked_up(comps, least, "component", comps.count()).select("key", "copies", F.col("least").alias("component"))
    named = named.union(classes.join(comps, "key", "left_anti").select("key", "copies", "first"))
    full = looked_up(found.where("n > 0"), named.withColumn("key_rows", F.col("copies")), "key", found.count())
    return full.select("id", "n", "component", "copies").union(found.where("n = 0").select("id", "n", "id", F.lit(1)))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, **settings) -> DataFrame:
    """``(id_col, n_shingles, component_id)`` of every document: see the module."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    found = linked_components(docs, k, percent, lambda table: lambda b: _prefix_rows(b, k, percent, *table.value), partition=True, **settings)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those of documents whose component has a smaller id."""
    found = jaccard_components(docs, id_col, text_col, k, percent)
    gone = checkpointed(found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col)).distinct())
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, id_col, "left_anti").select(*docs.columns)
