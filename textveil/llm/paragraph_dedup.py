"""Removal of passages that several documents hold, by MinHash banding of paragraphs.

A paragraph is a line of at least ``min_words`` words. Its signature has ``bands`` bands of ``rows``
minimum hashes of its five-word shingles, chosen so that a pair at the threshold collides with a
probability of ``recall`` or more; colliding paragraphs are verified by the exact Jaccard similarity
of their shingles, and links form components. Equal paragraphs are one class throughout.

A passage may also sit inside longer lines. So every text is cut into anchored windows as well: of
each ``span`` consecutive ``width``-word windows, the one of least hash (a local minimum hash, so
copies of a passage select alike wherever they stand). Any passage of ``width + span - 1`` words, 50
by default, holds a selected window, and equal windows form a component at once. Where windows meet,
the words around them are compared with the keeper's, so that the whole shared run goes: its first and
last windows that both select are within ``span - 1`` words of its ends.

In each component the first place (least document, then least position) stays; places in other
documents are removals. Overlapping removals of a document are one.

Defined results: a null, empty or wordless text has no paragraphs. Windows of fewer
distinct words than ``distinct`` (one or two words, repeated) are not chosen from, so passages of these
alone are found as lines only; between other words they go with the shared run. Copies inside one
document are no removals. Repeated rows with one id are one document. An empty table gives an empty
table; other columns are not read (finding) or pass through unchanged (removing).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textveil.llm.common import checkpointed, deleted, fresh, looked_up, shared_folder, stored_at
from textveil.llm.jaccard_join import BROADCAST_IDS, class_keys, linked_components, meta_of, shingle_sets
from textveil.llm.textblock import Block, blocks, mix, owners, windows


def tuned(percent: int = 80, recall: float = 0.99, rows: int = 2) -> int:
    """The least number of bands whose recall at the threshold is ``recall``."""
    miss, bands = 1 - (percent / 100) ** rows, 1
    while 1 - miss**bands < recall:
        bands += 1
    return bands


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """n minimum hashes of each set, none of which is empty."""
    flat = np.concatenate(sets)
    begin = np.cumsum([0, *(len(s) for s in sets[:-1])])
    return np.stack([np.minimum.reduceat(mix(flat ^ seed), begin) for seed in mix(np.arange(1, n + 1, dtype=np.uint64))], axis=1)


def _band_rows(batches, k: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Rows (band, class, size) of every class of paragraphs; a task sends a class once."""
    seen: set[int] = set()
    for batch in batches:
        sets, keys, found = [], [], [*shingle_sets(batch.column(1), k)]
        for key, s in zip(class_keys(found), found, strict=True):
            if len(s) and key not in seen:
                seen.add(key)
                sets.append(s)
                keys.append(key)
        if sets:
            value = signatures(sets, bands * rows).reshape(len(keys), bands, rows)
            band = np.zeros((len(keys), bands), dtype=np.uint64)
            for r in range(rows):
                band = mix(band * np.uint64(0x9E3779B97F4A7C15) + value[:, :, r])
            band = mix(band + np.arange(bands, dtype=np.uint64))
            metas = np.array([meta_of(len(s), 0, 1) for s in sets], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(band.reshape(-1).view(np.int64)), pa.array(np.repeat(np.array(keys, dtype=np.int64), bands)), pa.array(np.repeat(metas, bands))], ["token", "key", "meta"])


def varieties(hashes: np.ndarray, width: int) -> np.ndarray:
    """Distinct words of the ``width`` words from each word on, for windows within a text."""
    order = np.argsort(hashes, kind="stable")
    before, after = order[:-1], order[1:]
    near = (hashes[before] == hashes[after]) & (after - before < width)
    change = np.bincount(np.maximum(after[near] - width + 1, 0), minlength=len(hashes) + 1) - np.bincount(before[near] + 1, minlength=len(hashes) + 1)
    return width - np.cumsum(change)[: len(hashes)]


def anchors(hashes: np.ndarray, first: np.ndarray, width: int, span: int, distinct: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ``width`` words, ``distinct`` of them distinct, that have the least hash among ``span`` in sequence (the last of equals): begin and hash."""
    at, value = windows(hashes, first, width)
    if not len(at):
        return at, value
    varied = varieties(hashes, width)[at] >= distinct
    value = np.where(varied, value, ~np.uint64(0))
    cut = np.searchsorted(at, first)
    chosen = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        if b > a:
            n = b - a
            if n <= span:
                chosen.append(np.array([b - 1 - np.argmin(value[a:b][::-1])]))
            else:
                runs = np.lib.stride_tricks.sliding_window_view(value[a:b], span)[:, ::-1]
                chosen.append(np.unique(a + np.arange(n - span + 1) + span - 1 - np.argmin(runs, axis=1)))
    chosen = np.concatenate(chosen)
    chosen = chosen[varied[chosen]]
    return at[chosen], value[chosen]


def _window_rows(batches, width: int, span: int, distinct: int) -> Iterator[pa.RecordBatch]:
    """Rows (token, doc, start, end) of anchored windows, in code points."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for block in blocks(batch.column(1)):
            starts, ends, first = block.words()
            hashes = block.hashes(starts, ends)
            at, value = anchors(hashes, first, width, span, distinct)
            if not len(at):
                continue
            owner = owners(first)[at]
            points = block.points()
            zero = points[block.offsets[owner]]
            columns = value.view(np.int64), ids[block.first + owner], points[starts[at]] - zero, points[ends[at + width - 1]] - zero
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], ["token", "id", "start", "end"])


def _later(batches) -> Iterator[pa.RecordBatch]:
    """From rows (token, id, start, end) sorted so: rows (id, start, end, kept) of all documents but the first of each token.

    A token's first row is all that is held of it, however many follow.
    """
    lead = (None, None)
    for batch in batches:
        token, ids, start, end = (batch.column(i).to_numpy() for i in range(4))
        if not len(token):
            continue
        begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        first = ids[begin]
        if lead[0] == token[0]:
            first[0] = lead[1]
        keeper = np.repeat(first, np.diff(np.append(begin, len(token))))
        lead = (token[-1], keeper[-1])
        later = keeper != ids
        yield pa.RecordBatch.from_arrays([pa.array(x[later]) for x in (ids, start, end, keeper)], ["id", "start", "end", "kept"])


def _shared(batches) -> Iterator[pa.RecordBatch]:
    """From rows (token, id, start, end) sorted so: the rows of tokens that two documents or more hold.

    The first document's rows of a token are all that is held of it.
    """
    names = ["token", "id", "start", "end"]
    held, lead = [], (None, None, False)
    for batch in batches:
        token, ids, start, end = (batch.column(i).to_numpy() for i in range(4))
        if not len(token):
            continue
        begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        first, runs = ids[begin], np.diff(np.append(begin, len(token)))
        on = lead[0] == token[0]
        if on:
            first[0] = lead[1]
        many = np.add.reduceat(np.repeat(first, runs) != ids, begin) > 0
        if on:
            if many[0] and not lead[2]:
                yield from (pa.RecordBatch.from_arrays([pa.array(x) for x in h], names) for h in held)
                held = []
            many[0] |= lead[2]
        if not on or len(begin) > 1:
            held = []
        if not many[-1]:
            held.append(tuple(x[begin[-1] :].copy() for x in (token, ids, start, end)))
        lead = (token[-1], first[-1], bool(many[-1]))
        chosen = np.repeat(many, runs)
        yield pa.RecordBatch.from_arrays([pa.array(x[chosen]) for x in (token, ids, start, end)], names)


def _around_rows(batches, width: int, span: int, distinct: int) -> Iterator[pa.RecordBatch]:
    """From rows (id, text, hits): rows (token, id, start, end, left, left_at, right, right_at) of each hit (token, start, end).

    They reach over ``span - 1`` words, or over all windows beside the hit that were not chosen from.
    ``left`` and ``right`` are 32-bit hashes of the words around a window, outwards; ``left_at`` and
    ``right_at`` are the code points that each of these words adds.
    """
    for batch in batches:
        ids, hits = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
        bounds = hits.offsets.to_numpy()
        values = hits.values.flatten()
        tokens, from_, until = values[0].to_numpy(zero_copy_only=False).view(np.uint64), values[1].to_numpy(zero_copy_only=False), values[2].to_numpy(zero_copy_only=False)
        for block in blocks(batch.column(1)):
            starts, ends, first = block.words()
            hashes = block.hashes(starts, ends)
            points = block.points()
            at, value = windows(hashes, first, width)
            window = np.zeros(len(starts), dtype=np.uint64)
            window[at] = value
            varied = at[varieties(hashes, width)[at] >= distinct]
            begin, end, short = points[starts], points[ends], (hashes >> np.uint64(32)).astype(np.uint32)
            out: list[list] = [[] for _ in range(8)]
            for d in range(block.n):
                a, b, row = int(first[d]), int(first[d + 1]), block.first + d
                zero = points[block.offsets[d]]
                own = slice(bounds[row], bounds[row + 1])
                found = a + np.searchsorted(begin[a:b], zero + from_[own])
                for i, token, start, stop in zip(found.tolist(), tokens[own], from_[own].tolist(), until[own].tolist(), strict=True):
                    if i + width > b or window[i] != token or begin[i] != zero + start:
                        continue  # the place of another row of this id
                    last, k = i + width, int(np.searchsorted(varied, i))
                    before = int(varied[k - 1]) + 1 if k and varied[k - 1] >= a else a
                    after = int(varied[k + 1]) - 1 + width if k + 1 < len(varied) and varied[k + 1] < b else b
                    left, right = slice(max(a, min(i - span + 1, before)), i), slice(last, min(b, max(last + span - 1, after)))
                    cells = (
                        token.view(np.int64), ids[row], start, stop, short[left][::-1].tobytes(), np.diff(begin[left.start : i + 1])[::-1].astype(np.int32).tobytes(),
                        short[right].tobytes(), np.diff(end[last - 1 : right.stop]).astype(np.int32).tobytes(),
                    )
                    for column, cell in zip(out, cells, strict=True):
                        column.append(cell)
            types = [pa.int64()] * 4 + [pa.binary()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["token", "id", "start", "end", "left", "left_at", "right", "right_at"])


def _common(a: bytes, b: bytes) -> int:
    """How many 32-bit values two sequences begin with in common."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // 4
    return int(np.argmax(np.frombuffer(a[:n], np.uint32) != np.frombuffer(b[:n], np.uint32)))


def _extended(batches) -> Iterator[pa.RecordBatch]:
    """From rows of ``_around_rows`` sorted by token, document and place: rows (id, start, end, kept) of all documents but the first of each token.

    A place takes in the words around it that are also around the first document's; that document's
    surroundings, each once, are all that is held of a token.
    """
    token, keeper, kept = None, None, {}
    for batch in batches:
        out = []
        for t, i, start, end, left, left_at, right, right_at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if t != token:
                token, keeper, kept = t, i, {}
            if i == keeper:
                kept[left, right] = None
                continue
            for before, after in kept:
                n, m = _common(left, before), _common(right, after)
                ahead, behind = (int(np.frombuffer(x[: 4 * c], np.int32).sum(dtype=np.int64)) for x, c in ((left_at, n), (right_at, m)))
                out.append((i, start - ahead, end + behind, keeper))
        yield _spans(sorted(set(out)))


def _merged(batches) -> Iterator[pa.RecordBatch]:
    """From rows (id, start, end, kept) sorted so: overlapping or touching places of a document as one row."""
    held = None
    for batch in batches:
        out = []
        for i, start, end, kept in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            if held is not None and held[0] == i and start <= held[2] + 1:
                held = (i, held[1], max(end, held[2]), min(kept, held[3]))
            else:
                out += [held] if held is not None else []
                held = (i, start, end, kept)
        yield _spans(out)
    yield _spans([held] if held is not None else [])


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], ["id", "start", "end", "kept"])


def _long_lines(block: Block, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Lines of at least ``min_words`` words: their text's number in the block, their bytes' begin and end, and the bytes."""
    starts, _, _ = block.words()
    begin, end, first = block.spans(block.data != 0x0A)
    long = np.flatnonzero(np.searchsorted(starts, end) - np.searchsorted(starts, begin) >= min_words)
    begin, end, raw = begin[long], end[long], block.data.tobytes()
    return owners(first)[long], begin, end, [raw[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]


def _names(lines: list[bytes]) -> pa.Array:
    """The xxhash64 of each line, as Spark has it."""
    return pa.array(np.array([xxhash.xxh64_intdigest(x, seed=42) for x in lines], dtype=np.uint64).view(np.int64))


def _line_texts(batches, min_words: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) of lines of at least ``min_words`` words, named by their hash."""
    for batch in batches:
        for block in blocks(batch.column(0)):
            lines = _long_lines(block, min_words)[3]
            yield pa.RecordBatch.from_arrays([_names(lines), pa.array(lines, pa.binary()).view(pa.string())], ["id", "text"])


def _line_rows(batches, min_words: int) -> Iterator[pa.RecordBatch]:
    """Rows (line, id, start, end) of lines of at least ``min_words`` words."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for block in blocks(batch.column(1)):
            owner, begin, end, lines = _long_lines(block, min_words)
            points = block.points()
            zero = points[block.offsets[owner]]
            columns = ids[block.first + owner], points[begin] - zero, points[end] - zero
            yield pa.RecordBatch.from_arrays([_names(lines), *(pa.array(x.astype(np.int64)) for x in columns)], ["line", "id", "start", "end"])


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, recall: float = 0.99,
    rows: int = 2, min_words: int = 50, width: int = 26, span: int = 25, distinct: int = 3,
) -> DataFrame:
    """``(id_col, start, end, kept_id)``: code points of each removal, and a document that keeps the passage."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    bands = tuned(percent, recall, rows)
    # Lines are cut out of the texts once, to the shared folder, as they are read three times.
    at = f"{shared_folder(docs.sparkSession)}/lines-{uuid.uuid4().hex}"
    lines = stored_at(docs.select("text").mapInArrow(lambda b: _line_texts(b, min_words), "id long, text string"), at)
    comps = linked_components(lines, k, percent, lambda table: lambda b: _band_rows(b, k, bands, rows), count_frequent=False, unique=False)
    comps = checkpointed(comps.select(F.col("id").alias("line"), "component", "copies").distinct())
    deleted(docs.sparkSession, at)
    many = comps.groupBy("component").agg(F.count("*").alias("key_rows"), F.max("copies").alias("most")).where("key_rows > 1 or most > 1").drop("most")
    shared = checkpointed(looked_up(comps, many, "component", comps.count()).select("line", "component"))
    few = shared.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    place = "id long, start long, end long"
    order = ["token", "id", "start", "end"]
    places = docs.mapInArrow(lambda b: _line_rows(b, min_words), f"line long, {place}").join(F.broadcast(shared) if few else shared, "line")
    tokens = docs.mapInArrow(lambda b: _window_rows(b, width, span, distinct), f"token long, {place}")
    hits = tokens.repartition("token").sortWithinPartitions(*order).mapInArrow(_shared, f"token long, {place}")
    hits = hits.groupBy("id").agg(F.collect_list(F.struct("token", "start", "end")).alias("hits"))
    around = docs.join(hits, "id").select("id", "text", "hits").mapInArrow(lambda b: _around_rows(b, width, span, distinct), f"token long, {place}, left binary, left_at binary, right binary, right_at binary")
    later = around.repartition("token").sortWithinPartitions(*order).mapInArrow(_extended, f"{place}, kept long")
    lines = places.select(F.xxhash64("component").alias("token"), "id", "start", "end").repartition("token").sortWithinPartitions(*order)
    later = later.union(lines.mapInArrow(_later, f"{place}, kept long"))
    spans = later.repartition("id").sortWithinPartitions("id", "start", "end").mapInArrow(_merged, f"{place}, kept long")
    return spans.select(F.col("id").alias(id_col), "start", "end", F.col("kept").alias("kept_id"))


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without spans (disjoint, in order). A line that a cut leaves without words goes, too; all other lines stay as they are."""
    out, at, seams = [], 0, []
    for start, end in spans:
        out.append(text[at:start])
        seams.append(start - at + (seams[-1] if seams else 0))
        at = end
    out.append(text[at:])
    kept, begin, s = [], 0, 0
    for line in "".join(out).split("\n"):
        seamed = s < len(seams) and seams[s] <= begin + len(line)
        while s < len(seams) and seams[s] <= begin + len(line):
            s += 1
        if not seamed or line.strip():
            kept.append(line)
        begin += len(line) + 1
    return "\n".join(kept)


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", **settings) -> DataFrame:
    """``docs`` without the passages that earlier documents hold; a document of which no word is left goes.

    ``length_col``, if there, is set to the new length. Rows that nothing is removed from are unchanged.
    """
    found = repeated_passages(docs, id_col, text_col, **settings)
    key = fresh("removal_id", docs.columns)
    removed = fresh("removals", [*docs.columns, key])
    gathered = found.groupBy(F.col(id_col).alias(key)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(removed))
    joined = docs.join(gathered, docs[id_col] == gathered[key], "left").drop(gathered[key])
    names = list(docs.columns)
    at, n = names.index(text_col), names.index(length_col) if length_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns[:-1])
            removals = batch.column(len(columns)).to_pylist()
            hit = [i for i, r in enumerate(removals) if r]
            if hit:
                texts = columns[at].to_pylist()
                for i in hit:
                    texts[i] = cut(texts[i], [(r["start"], r["end"]) for r in removals[i]])
                columns[at] = pa.array(texts, columns[at].type)
                if n is not None:
                    lengths = columns[n].to_pylist()
                    for i in hit:
                        lengths[i] = len(texts[i])
                    columns[n] = pa.array(lengths, columns[n].type)
            out = pa.RecordBatch.from_arrays(columns, names)
            gone = np.zeros(len(removals), dtype=bool)
            gone[[i for i in hit if not texts[i].strip()]] = True
            yield out.filter(pc.invert(pa.array(gone)))

    return joined.mapInArrow(run, docs.schema)
