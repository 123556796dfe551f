"""Finding text that repeats across documents: anchored regions.

Every window of ``width`` units (bytes or words) is assigned to one of its k-grams, its anchor: the
one with the smallest hash.  Equal windows have equal anchors, so only windows that share an anchor
need to be compared, and consecutive windows mostly share theirs and travel together as one region.
Anchors that occur once in the corpus are dropped before any text moves.

Frequent k-grams (common lines and passages) are ranked behind all others, so a window is only
assigned to one if it holds nothing else.  Which k-grams are frequent comes from a pass over all
documents that counts them in 2**SKETCH_BITS cells; the driver gets one bit a cell, 512 KB at any size
of the corpus.  The ranking changes which anchors are used, never the result.

Documents are keyed by ``doc_id``; a null id counts as the smallest.  Rows that share an id stand for
one document: what is found in one row's text applies to all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .memory import lean
from .store import saved

U = np.uint64
NULL_ID = -(2**63)
SKETCH_BITS, HOT_SHARE, HOT_LEAST = 22, 2.0**-17, 64
#: Bytes of text that a Python worker holds as arrays at a time.
CHUNK_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE_HASH = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_BASE_K, _BASE_S, _BASE_W = (U(int(x) | 1) for x in _rng.integers(2**62, 2**63, 3))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def powers(base: U, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i (mod 2**64) for i < n at least."""
    known = _POWERS.get(int(base))
    if known is None or len(known[0]) < n:
        n = max(n, CHUNK_BYTES + 1024)
        inverse = U(pow(int(base), -1, 2**64))
        known = tuple(np.multiply.accumulate(np.concatenate([[U(1)], np.full(n - 1, x, U)])) for x in (base, inverse))
        if n <= 4 * CHUNK_BYTES:
            _POWERS[int(base)] = known
    return known


def span_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: U) -> np.ndarray:
    """Hash of units[start:end] for many spans, independent of where they lie."""
    up, down = powers(base, len(units) + 1)
    total = np.concatenate([[U(0)], np.cumsum(units * up[: len(units)])])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))


def gram_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive units, by doubling."""
    block, width, power, out, have = units, 1, _BASE_K, None, 0
    n = len(units)
    while k:
        if k & 1:
            if out is None:
                out, have = block, width
            else:
                m = n - have - width + 1
                out, have = out[:m] * power + block[have : have + m], have + width
        k >>= 1
        if k:
            m = n - 2 * width + 1
            block, width = block[:m] * power + block[width : width + m], 2 * width
            with np.errstate(over="ignore"):
                power = power * power
    return mix(out)


def window_minima(x: np.ndarray, w: int) -> np.ndarray:
    n = 1
    m = x
    while 2 * n <= w:
        m = np.minimum(m[:-n], m[n:])
        n *= 2
    k = len(x) - w + 1
    return np.minimum(m[:k], m[w - n : w - n + k])


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column and the offsets of its rows; null counts as empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null("" if "string" in str(column.type) else b"")
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes; a longer text is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes other than space and tab to carriage return) of consecutive rows: starts and
    ends in data, and the number of words before each row."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    inside = ~_SPACE[data[lo:hi]]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    rows = offsets[:-1][np.diff(offsets) > 0] - lo
    begins[rows] = inside[rows]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[rows[rows > 0] - 1] = inside[rows[rows > 0] - 1]
    starts = np.flatnonzero(begins)
    return starts + lo, np.flatnonzero(ends) + lo + 1, np.searchsorted(starts + lo, offsets)


@dataclass(frozen=True)
class Plan:
    """What repeats are: windows of ``width`` units with anchors of ``k``; unit is "byte" or "word".

    scope "later": a window is covered if an equal one starts earlier (smaller id, or same document);
    "any": if an equal one starts anywhere else; "docs": if another document of the same group has it.
    """

    width: int
    k: int
    unit: str = "byte"
    scope: str = "later"

    def units(self, data: np.ndarray, offsets: np.ndarray):
        """Hash of each unit of consecutive rows, offsets of rows in units, and a function from ranges of
        units to ranges of bytes in data."""
        if self.unit == "byte":
            lo = int(offsets[0])
            return _BYTE_HASH[data[lo : int(offsets[-1])]], offsets - lo, lambda a, b: (a + lo, b + lo)
        starts, ends, rows = words_of(data, offsets)
        lo = int(offsets[0])
        part = data[lo : int(offsets[-1])]
        hashes = span_hashes(_BYTE_HASH[part], starts - lo, ends - lo, _BASE_W)
        return hashes, rows, lambda a, b: (starts[a], ends[b - 1])

    def regions(self, hashes: np.ndarray, rows: np.ndarray, hot: np.ndarray, salt: np.ndarray | None = None):
        """Row, first unit (in the row), number of windows and anchor of each region, in order, and
        whether its anchor occurs in it more than once (so windows in it may equal each other)."""
        n = len(hashes)
        if n < self.width:
            none = np.zeros(0, np.int64)
            return none, none, none, none.astype(U), none.astype(bool)
        grams = gram_hashes(hashes, self.k)
        grams = (grams >> U(1)) | (hot[(grams >> U(64 - SKETCH_BITS)).astype(np.int64)].astype(U) << U(63))
        least = window_minima(grams, self.width - self.k + 1)
        count = np.maximum(np.diff(rows) - self.width + 1, 0)
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, rows[:-1][count > 0], 1)
        np.add.at(edge, (rows[:-1] + count)[count > 0], -1)
        inside = np.cumsum(edge)[: len(least)] > 0
        begins = inside.copy()
        begins[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
        begins[rows[:-1][count > 0]] = True
        starts = np.flatnonzero(begins)
        row = np.searchsorted(rows, starts, "right") - 1
        last = rows[row] + count[row]
        ends = np.minimum(np.append(starts[1:], n), last)
        anchors = least[starts]
        reach = self.width - self.k + 1
        most = np.pad(least, reach - 1)
        minimal = np.flatnonzero(grams == ~window_minima(~most, reach))
        pair = np.flatnonzero((grams[minimal[1:]] == grams[minimal[:-1]]) & (np.diff(minimal) <= reach))
        twins = np.searchsorted(minimal[pair + 1], ends + reach - 1) > np.searchsorted(minimal[pair], starts)
        if salt is not None:
            anchors = (mix((anchors << U(1)) + salt[row]) >> U(1)) | (anchors & U(1 << 63))
        return row, starts - rows[row], ends - starts, anchors, twins


def _per_chunk(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        data, offsets = texts_of(batch.column("text"))
        for i, j in chunks(offsets):
            yield batch, i, j, data, offsets[i : j + 1]


def hot_cells(docs: DataFrame, plan: Plan) -> np.ndarray:
    """For each cell of k-gram hashes whether it is frequent, as found by any task in its part of docs."""

    def count(batches):
        cells = total = 0
        for _, _, _, data, offsets in _per_chunk(batches):
            hashes = plan.units(data, offsets)[0]
            if len(hashes) >= plan.k:
                grams = gram_hashes(hashes, plan.k) >> U(64 - SKETCH_BITS)
                cells = cells + np.bincount(grams.astype(np.int64), minlength=1 << SKETCH_BITS).astype(np.int32)
                total += len(grams)
        if total:
            found = np.flatnonzero(cells >= max(HOT_LEAST, total * HOT_SHARE))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["cell"])

    hot = np.zeros(1 << SKETCH_BITS, bool)
    rows = docs.select("text").mapInArrow(lean(count), "cell long").distinct()
    hot[[r.cell for r in rows.toLocalIterator()]] = True
    return hot


def _spread(anchor: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Frequent anchors (negative) are known to repeat and need no counting: they are dealt out by document,
    the others by themselves. Applied twice it gives the anchors again."""
    return np.where(anchor < 0, anchor ^ (mix(doc.astype(np.int64).view(U)) >> U(1)).view(np.int64), anchor)


def _copies(raw: bytes, anchor: np.ndarray, content: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each region the first one of equal anchor and equal text: found by hash, confirmed on the bytes."""
    order = np.lexsort((content, anchor))
    same = np.append(False, (anchor[order][1:] == anchor[order][:-1]) & (content[order][1:] == content[order][:-1]))
    lead = np.empty(len(order), np.int64)
    lead[order] = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    for k in np.flatnonzero(lead != np.arange(len(order))).tolist():
        j = lead[k]
        if raw[begin[k] : end[k]] != raw[begin[j] : end[j]]:
            lead[k] = k
    return lead


def _mask_runs(mask: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of a mask of windows, which don't go on from one string (from base[k]) to the next: string, begin, end."""
    if not len(mask):
        return (np.zeros(0, np.int64),) * 3
    front = np.zeros(len(mask), bool)
    front[base] = True
    begins = np.flatnonzero(mask & (front | ~np.append(False, mask[:-1])))
    ends = np.flatnonzero(mask & (np.append(front[1:], True) | ~np.append(mask[1:], False))) + 1
    string = np.searchsorted(base, begins, "right") - 1
    return string, begins - base[string], ends - base[string]


def merge_runs(group: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """Union of ranges within each group, sorted."""
    order = np.lexsort((begin, group))
    group, begin, end = group[order], begin[order], end[order]
    if not len(group):
        return group, begin, end
    head = np.append(True, group[1:] != group[:-1])
    rank = np.cumsum(head) - 1
    span = int(end.max()) - min(0, int(begin.min())) + 1
    reach = np.maximum.accumulate(end + rank * span) - rank * span
    head[1:] |= begin[1:] > reach[:-1]
    at = np.flatnonzero(head)
    return group[at], begin[at], np.maximum.reduceat(end, at)


_SENT = pa.schema([("anchor", pa.int64()), ("doc", pa.int64()), ("start", pa.int64()), ("windows", pa.int32()), ("copies", pa.int64()), ("high", pa.int64()), ("twin", pa.bool_()), ("text", pa.binary())])
_COVER = pa.schema([("doc", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])


def _cover_batch(doc, begin, end):
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (doc, begin, end)], schema=_COVER)


def repeated_ranges(docs: DataFrame, plan: Plan, compare: Callable) -> DataFrame:
    """(doc, begin, end): ranges of units of documents that repeated windows cover. docs: key, text, for
    scope "docs" also ``grp`` (long), within which windows are compared, and other columns but not those
    of the steps here (found, doc).

    compare(plan, strings, windows, copies) gets different texts, sorted by the first place of each, with their numbers of windows and of copies. It gives the windows that may occur at
    more than one place (numbered through all strings) in classes of equal ones, and where each class begins. What
    is covered follows from the classes alone, for copies of a text as for the text itself.

    Copies are aggregated before they are shuffled: a task compares the texts that it has several of by
    itself and sends one of each kind, so a large group of copies costs its shard a row for each chunk.
    """
    hot = hot_cells(docs, plan)
    packed = np.packbits(hot)
    salted = plan.scope == "docs"
    columns = ["key", "text", *(["grp"] if salted else [])]

    def hot_table():
        return np.unpackbits(packed).astype(bool)

    def find(batches):
        table = hot_table()
        for batch, i, j, data, offsets in _per_chunk(batches):
            hashes, rows, _ = plan.units(data, offsets)
            salt = batch.column("grp").to_numpy(zero_copy_only=False)[i:j].astype(np.int64).view(U) if salted else None
            row, start, windows, anchor, twins = plan.regions(hashes, rows, table, salt)
            key = batch.column("key").to_numpy(zero_copy_only=False)[i:j]
            place = (start << 32) | (windows << 1) | twins
            slot = _spread(anchor.view(np.int64), key[row])
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(key[row]), pa.array(place)], names=["slot", "doc", "place"])

    many = F.count(F.lit(1)).over(Window.partitionBy("slot"))
    found = docs.select(*columns).mapInArrow(lean(find), "slot long, doc long, place long").withColumn("n", many)
    found = saved(found.filter("n > 1 or slot < 0 or place % 2 = 1").select("slot", "doc", "place"), "anchors")
    by_doc = found.groupBy("doc").agg(F.collect_list(F.struct("slot", "place")).alias("found"))
    # With all columns of docs, so that a later join of docs on key can use the same exchange of texts.
    joined = docs.join(by_doc.hint("shuffle_merge"), F.col("key") == F.col("doc")).drop("doc")

    def cut(batches):
        for batch, i, j, data, offsets in _per_chunk(batches):
            lists = batch.column("found").slice(i, j - i)
            flat = lists.flatten()
            at = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(j - i), at)
            slot = flat.field(0).to_numpy()
            place = flat.field(1).to_numpy()
            start, windows, twin = place >> 32, (place & 0xFFFFFFFF) >> 1, (place & 1).astype(bool)
            key = batch.column("key").to_numpy(zero_copy_only=False)[i:j][row]
            anchor = _spread(slot, key)
            hashes, rows, to_bytes = plan.units(data, offsets)
            first = rows[row] + start
            fits = first + windows + plan.width - 1 <= rows[row + 1]  # else another row with this id has it
            row, anchor, start, windows, twin, key, first = (x[fits] for x in (row, anchor, start, windows, twin, key, first))
            content = span_hashes(hashes, first, first + windows + plan.width - 1, _BASE_S)
            a, b = to_bytes(first, first + windows + plan.width - 1)
            lo = int(offsets[0])
            raw = data[lo : int(offsets[-1])].tobytes()
            a, b = (a - lo).tolist(), (b - lo).tolist()
            lead = _copies(raw, anchor, content, np.array(a), np.array(b))
            # the first place of each text stands for its copies; what several places show is decided here
            order = np.lexsort((start, key, lead))
            head = np.append(True, lead[order][1:] != lead[order][:-1])
            group = np.empty(len(order), np.int64)
            group[order] = np.cumsum(head) - 1
            first = order[head]
            copies, high = np.bincount(group, minlength=len(first)), np.full(len(first), NULL_ID)
            np.maximum.at(high, group, key)
            # a document's own copies say nothing yet where other documents are asked for
            whole = copies > 1 if plan.scope != "docs" else high > key[first]
            rows = np.flatnonzero(whole[group])
            if len(rows):
                number = np.cumsum(whole) - 1
                strings = [raw[a[k] : b[k]] for k in first[whole].tolist()]
                yield as_sent(decide(strings, anchor[first[whole]], windows[first[whole]], number[group[rows]], key[rows], start[rows], np.ones(len(rows), np.int64), key[rows]))
            sent = first if plan.scope != "docs" else np.flatnonzero(~whole[group] | np.isin(np.arange(len(order)), first))
            text = [raw[a[k] : b[k]] for k in sent.tolist()]
            alike = copies[group[sent]] if plan.scope == "any" else np.ones(len(sent), np.int64)
            high = np.where(whole, high, NULL_ID)[group[sent]]
            yield pa.RecordBatch.from_arrays([pa.array(anchor[sent]), pa.array(key[sent]), pa.array(start[sent]), pa.array(windows[sent].astype(np.int32)), pa.array(alike), pa.array(np.maximum(high, key[sent])), pa.array(twin[sent]), pa.array(text, pa.binary())], schema=_SENT)

    def as_sent(cover):
        """Ranges that are decided already, as rows without a text."""
        doc, begin, end = cover
        spot, n = mix(doc.astype(np.int64).view(U) + begin.astype(np.int64).view(U)).view(np.int64), len(doc)
        return pa.RecordBatch.from_arrays([pa.array(spot), pa.array(doc), pa.array(begin), pa.nulls(n, pa.int32()), pa.array(end), *(pa.nulls(n, f.type) for f in list(_SENT)[5:])], schema=_SENT)

    def decide(strings, anchor, size, of, doc, start, copies, high):
        """Ranges (doc, begin, end) that repeated windows cover: of[k] is the string at place k (doc, start), where
        copies[k] places are alike, up to document high[k]."""
        order = np.lexsort((start, doc, of))
        lead = order[np.searchsorted(of[order], np.arange(len(strings)))]  # the first place of each string
        sort = np.lexsort((start[lead], doc[lead]))
        strings, anchor, size, lead = [strings[k] for k in sort.tolist()], anchor[sort], size[sort], lead[sort]
        rank = np.empty(len(sort), np.int64)
        rank[sort] = np.arange(len(sort))
        of = rank[of]
        base = np.cumsum(size) - size
        total = np.bincount(of, copies, len(strings)).astype(np.int64)
        numbers, heads = compare(plan, strings, size, total)
        mask = np.zeros(int(size.sum()), bool)
        if plan.scope == "docs" and len(numbers):  # equal windows of different anchors are those of different groups
            own, kind = anchor[np.searchsorted(base, numbers, "right") - 1], np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(numbers))))
            apart = np.lexsort((own, kind))
            numbers, own, kind = numbers[apart], own[apart], kind[apart]
            heads = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (kind[1:] != kind[:-1])))
        if len(numbers):
            lengths = np.diff(np.append(heads, len(numbers)))
            owner = np.searchsorted(base, numbers, "right") - 1
            if plan.scope == "docs":
                least, most = np.full(len(strings), 2**63 - 1), np.full(len(strings), NULL_ID)
                np.minimum.at(least, of, doc)
                np.maximum.at(most, of, high)
                mask[numbers] = np.repeat(np.minimum.reduceat(least[owner], heads) != np.maximum.reduceat(most[owner], heads), lengths)
            else:
                mask[numbers] = np.repeat(np.add.reduceat(total[owner], heads) > 1, lengths)
        if plan.scope != "later":
            return spread(mask, base, of, doc, start)
        # at a text's first place, the first window of a class stays
        again = (doc != doc[lead[of]]) | (start != start[lead[of]])
        copied = spread(mask, base, of[again], doc[again], start[again])
        if len(numbers):
            mask[np.minimum.reduceat(numbers, heads)] = False
        own = spread(mask, base, of[~again], doc[~again], start[~again])
        return tuple(np.concatenate(x) for x in zip(copied, own))

    def spread(mask, base, of, doc, start):
        """Ranges of documents that the masked windows of the string at each place cover."""
        string, begin, end = _mask_runs(mask, base)
        count = np.bincount(string, minlength=len(base))[of]
        place = np.repeat(np.arange(len(of)), count)
        at = np.arange(len(place)) + np.repeat(np.searchsorted(string, of) - (np.cumsum(count) - count), count)
        return merge_runs(doc[place], start[place] + begin[at], start[place] + end[at] + plan.width - 1)

    def settle(rows: list[pa.RecordBatch]):
        table = pa.Table.from_batches(rows).combine_chunks()
        anchor, doc, start, windows, copies, high = (table.column(c).to_numpy().astype(np.int64) for c in ("anchor", "doc", "start", "windows", "copies", "high"))
        text = table.column("text").chunk(0)
        # regions of equal anchor and bytes are one group
        name = text.dictionary_encode().indices.to_numpy()
        order = np.lexsort((start, doc, name, anchor))
        head = np.append(True, (anchor[order][1:] != anchor[order][:-1]) | (name[order][1:] != name[order][:-1]))
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(head) - 1
        first = order[head]  # the first place of each group
        _, inverse, often = np.unique(anchor, return_inverse=True, return_counts=True)
        use = often[inverse[first]] > 1
        if plan.scope != "docs":
            use |= table.column("twin").to_numpy(zero_copy_only=False).astype(bool)[first]
        if not use.any():
            return
        number, rows = np.cumsum(use) - 1, np.flatnonzero(use[group])
        strings = text.take(pa.array(first[use])).to_pylist()
        yield _cover_batch(*decide(strings, anchor[first[use]], windows[first[use]], number[group[rows]], doc[rows], start[rows], copies[rows], high[rows]))

    def shard(batches):
        held, size = [], 0
        for batch in batches:
            cover = batch.filter(batch.column("text").is_null())
            if cover.num_rows:
                yield pa.RecordBatch.from_arrays([cover.column("doc"), cover.column("start"), cover.column("copies")], schema=_COVER)
            batch = batch.filter(batch.column("text").is_valid())
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size >= CHUNK_BYTES:  # settle up to the last anchor, which may go on
                table = pa.Table.from_batches(held).combine_chunks()
                anchor = table.column("anchor").to_numpy()
                cutoff = int(np.searchsorted(anchor, anchor[-1]))
                if cutoff:
                    yield from settle(table.slice(0, cutoff).to_batches())
                    held = table.slice(cutoff).to_batches()
                    size = sum(x.nbytes for x in held)
        if held:
            yield from settle(held)

    sent = joined.mapInArrow(lean(cut), "anchor long, doc long, start long, windows int, copies long, high long, twin boolean, text binary")
    return sent.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lean(shard), "doc long, begin long, end long")
