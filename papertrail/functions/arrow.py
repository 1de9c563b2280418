"""The functions that need Python: all run on Arrow batches inside tasks."""

from __future__ import annotations

import difflib
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

PAIRS = 1 << 20  # pairs of boxes that are compared at a time


@F.pandas_udf(DoubleType())
def _ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)], dtype="float64")


def similarity(left: Column, right: Column) -> Column:
    """Ratcliff-Obershelp ratio. Callers cut candidates with joins first."""
    return _ratio(left, right)


@F.pandas_udf(DoubleType())
def _entropy(content: pd.Series) -> pd.Series:
    def one(data: bytes) -> float:
        if not data:
            return 0.0
        share = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256) / len(data)
        share = share[share > 0]
        return float(-(share * np.log2(share)).sum()) + 0.0
    return content.map(one)


def byte_entropy(content: Column) -> Column:
    """Shannon entropy in bits per byte over the whole content."""
    return F.round(_entropy(content.cast("binary")), 3)


def _joined(a: tuple, b: tuple, least: float) -> np.ndarray:
    """Whether the later box b (x, y, width, height) and the earlier box a overlap by ``least`` or b has its centre in a."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = a, b
    right, bottom = np.minimum(ax + aw, bx + bw), np.minimum(ay + ah, by + bh)
    left, top = np.maximum(ax, bx), np.maximum(ay, by)
    inter = np.maximum(0.0, right - left) * np.maximum(0.0, bottom - top)
    union = aw * ah + bw * bh - inter
    overlap = np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)
    cx, cy = bx + bw / 2, by + bh / 2
    centred = (cx >= ax) & (cx <= ax + aw) & (cy >= ay) & (cy <= ay + ah)
    return (left <= right) & (top <= bottom) & ((overlap >= least) | centred)


@F.arrow_udf(ArrayType(LongType()))
def _merged(cases: pa.Array) -> pa.Array:
    flat, sizes = cases.flatten(), np.diff(cases.offsets.to_numpy())
    number = flat.field("ord").to_numpy(zero_copy_only=False)
    case = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((number, case))
    box = [flat.field(c).to_numpy(zero_copy_only=False)[order] for c in ("x", "y", "width", "height")]
    ends = np.cumsum(sizes)
    partners = np.repeat(ends, sizes) - np.arange(len(order)) - 1  # later boxes of the case
    made = np.cumsum(partners)
    label, begin, edges = np.arange(len(order)), 0, []
    while begin < len(order):
        stop = max(begin + 1, int(np.searchsorted(made, (made[begin - 1] if begin else 0) + PAIRS, "right")))
        count = partners[begin:stop]
        a = np.repeat(np.arange(begin, stop), count)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
        hit = _joined(tuple(c[a] for c in box), tuple(c[b] for c in box), 0.18)
        edges.append((a[hit], b[hit]))
        begin = stop
    if edges:
        a, b = (np.concatenate(side) for side in zip(*edges))
        while True:
            least = np.minimum(label[a], label[b])
            lowered = label.copy()
            np.minimum.at(lowered, a, least)
            np.minimum.at(lowered, b, least)
            lowered = lowered[lowered]
            if (lowered == label).all():
                break
            label = lowered
    merged = np.empty(len(order), dtype="int64")
    merged[order] = number[order][label]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype("int32")), pa.array(merged))


def merged_boxes(boxes: Column) -> Column:
    """Per box of an array (ord, x, y, width, height) the smallest ``ord`` of its cluster: two boxes join when IoU >= 0.18 or the
    centre of the later one lies in the earlier one."""
    return _merged(boxes)


def repeated_runs(tokens: Column, size: int) -> Column:
    """Positions of the runs of ``size`` tokens that occur again in their array. Runs are told apart by 64-bit hashes, so a
    position may be listed whose run has no copy; none with a copy is missing."""
    @F.arrow_udf(ArrayType(IntegerType()))
    def positions(texts: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        words = pc.fill_null(texts.flatten().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.uint64)
        text, first = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
        starts = np.arange(max(0, len(words) - size + 1))
        starts = starts[text[starts] == text[starts + size - 1]]
        key = (text[starts].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        for i in range(size):
            key = (key ^ words[starts + i]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        order = np.argsort(key, kind="stable")
        same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
        again = np.zeros(len(starts), dtype=bool)
        again[order[same]] = again[order[same + 1]] = True
        at = starts[again]
        ends = np.concatenate([[0], np.cumsum(np.bincount(text[at], minlength=len(sizes)))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at - first[text[at]], pa.int32()))
    return positions(tokens)


# ----------------------------------------------------------------- layout of pages
# A page is an array of words (left, top, width, height, conf); all pages of a batch are worked on at once. NULL is NaN.
DEVIANT, DRIFT, OFF = (tuple(f"{name}_{c}" for c in ("x0", "y0", "x1", "y1")) for name in ("dev", "drift", "off"))
ROW_COUNTS, COLUMN_COUNTS = ("row", "case_words", "weak_words", "odd_words", "drift_words"), ("column", "off_words", "column_words")
SUMMARY_COUNTS = ("words", "weak_words", "odd_words", "baseline_sets", "column_sets")
SUMMARY_CORNERS = tuple(f"{side}{c}" for side in "rc" for c in ("x0", "y0", "x1", "y1"))


def _median(group: np.ndarray, value: np.ndarray, groups: int) -> np.ndarray:
    known = ~np.isnan(value)
    group, value = group[known], value[known]
    value = value[np.lexsort((value, group))]
    count = np.bincount(group, minlength=groups)
    first, some = np.cumsum(count) - count, count > 0
    out = np.full(groups, np.nan)
    out[some] = (value[(first + (count - 1) // 2)[some]] + value[(first + count // 2)[some]]) / 2
    return out


def _corners(group: np.ndarray, groups: int, kept: np.ndarray, low: tuple, high: tuple) -> list[np.ndarray]:
    """Smallest values of ``low`` and largest of ``high`` among the kept rows of every group."""
    def edge(pick, value, none):
        out, known = np.full(groups, none), kept & ~np.isnan(value)
        pick.at(out, group[known], value[known])
        return np.where(out == none, np.nan, out)
    return [edge(np.minimum, v, np.inf) for v in low] + [edge(np.maximum, v, -np.inf) for v in high]


def _count(group: np.ndarray, groups: int, which: np.ndarray) -> np.ndarray:
    return np.bincount(group[which], minlength=groups)


def _numbered(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by ``keys`` (the last one first), and where in that order a new key begins."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), dtype=bool)
    for key in keys:
        new[1:] |= key[order[1:]] != key[order[:-1]]
    new[:1] = True
    return order, new


def _words_of(pages: pa.Array) -> tuple[int, np.ndarray, dict[str, np.ndarray]]:
    sizes = pc.fill_null(pc.list_value_length(pages), 0).to_numpy(zero_copy_only=False)
    flat = pages.flatten()
    word = {c: pc.cast(flat.field(c), pa.float64()).to_numpy(zero_copy_only=False) for c in ("left", "top", "width", "height", "conf")}
    return len(sizes), np.repeat(np.arange(len(sizes)), sizes), word


def _typical(pages: int, page: np.ndarray, word: dict) -> np.ndarray:
    height = _median(page, word["height"], pages)
    return np.where(height == 0, 12.0, height)


def _rows_of(pages: int, page: np.ndarray, word: dict) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    typical, words = _typical(pages, page, word), np.bincount(page, minlength=pages)
    line = np.floor(word["top"] / np.fmax(2.0, typical * 0.5)[page])
    placed = ~np.isnan(line)
    page, line = page[placed], line[placed]
    left, top, width, height, conf = (word[c][placed] for c in ("left", "top", "width", "height", "conf"))
    order, new = _numbered(line, page)
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    head, n = order[new], int(new.sum())
    size, weak, bottom = np.bincount(group, minlength=n), (_count(group, n, conf < 40) >= 3)[group], top + height
    usual = typical[page]
    odd = ~weak & (usual > 6) & ((height > 2.0 * usual) | (height < 0.45 * usual))
    reach = 2.5 * np.fmax(5.0, 0.12 * _median(group, height, n))
    drift = (size[group] >= 4) & (np.abs(bottom - _median(group, bottom, n)[group]) > reach[group])
    low, high, owner = (left, top), (left + width, bottom), page[head]
    out = {"row": line[head], "case_words": words[owner], "typ_h": typical[owner], "weak_words": _count(group, n, weak),
           "odd_words": _count(group, n, odd), "drift_words": _count(group, n, drift)}
    out |= dict(zip(DEVIANT, _corners(group, n, weak | odd, low, high))) | dict(zip(DRIFT, _corners(group, n, drift, low, high)))
    return owner, out


def _columns_of(pages: int, page: np.ndarray, word: dict) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    reach = np.fmax(24.0, _typical(pages, page, word))
    centre = word["left"] + word["width"] / 2
    placed = ~np.isnan(centre)
    page, centre = page[placed], centre[placed]
    left, top, width, height = (word[c][placed] for c in ("left", "top", "width", "height"))
    order, _ = _numbered(centre, page)
    owner, value = page[order], centre[order]
    begins = np.ones(len(order), dtype=bool)
    begins[1:] = owner[1:] != owner[:-1]
    new = begins.copy()
    new[1:] |= value[1:] - value[:-1] > reach[owner[1:]]
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    n, owner = int(new.sum()), owner[new]
    first = np.flatnonzero(begins[new])
    number = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    size = np.bincount(group, minlength=n)
    reach = 2.0 * np.fmax(6.0, 0.5 * _median(group, width, n))
    off = (size[group] >= 3) & (np.abs(left - _median(group, left, n)[group]) > reach[group])
    out = {"column": number, "off_words": _count(group, n, off), "column_words": size}
    return owner, out | dict(zip(OFF, _corners(group, n, off, (left, top), (left + width, top + height))))


def _struct(values: dict[str, np.ndarray], whole: tuple[str, ...]) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(v.astype(np.int64)) if n in whole else pa.array(v.astype(np.float64), from_pandas=True)
                                       for n, v in values.items()], list(values))


def _kind(names: tuple[str, ...], whole: tuple[str, ...]) -> StructType:
    return StructType([StructField(n, LongType() if n in whole else DoubleType()) for n in names])


def _listed(owner: np.ndarray, pages: int, values: dict[str, np.ndarray], whole: tuple[str, ...]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=pages))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _struct(values, whole))


@F.arrow_udf(ArrayType(_kind((*ROW_COUNTS[:2], "typ_h", *ROW_COUNTS[2:], *DEVIANT, *DRIFT), ROW_COUNTS)))
def page_rows(pages: pa.Array) -> pa.Array:
    """Text rows of every page with their deviant words (see ``words.row_outliers``)."""
    n, page, word = _words_of(pages)
    owner, rows = _rows_of(n, page, word)
    return _listed(owner, n, rows, ROW_COUNTS)


@F.arrow_udf(ArrayType(_kind((*COLUMN_COUNTS, *OFF), COLUMN_COUNTS)))
def page_columns(pages: pa.Array) -> pa.Array:
    """Columns of every page with the words off their edge (see ``words.column_outliers``)."""
    n, page, word = _words_of(pages)
    owner, columns = _columns_of(n, page, word)
    return _listed(owner, n, columns, COLUMN_COUNTS)


@F.arrow_udf(_kind((*SUMMARY_COUNTS, *SUMMARY_CORNERS), SUMMARY_COUNTS))
def page_layout(pages: pa.Array) -> pa.Array:
    """Counts and corners of every page's rows and columns together; no words where a page has no row or no column."""
    return _struct(_layout_of(*_words_of(pages)), SUMMARY_COUNTS)


def _layout_of(n: int, page: np.ndarray, word: dict) -> dict[str, np.ndarray]:
    at, row = _rows_of(n, page, word)
    across, column = _columns_of(n, page, word)
    drifting, off = row["drift_words"] >= 2, column["off_words"] >= 3
    known = (np.bincount(at, minlength=n) > 0) & (np.bincount(across, minlength=n) > 0)
    out = {"words": np.where(known, np.bincount(page, minlength=n), 0)}
    out |= {c: np.bincount(at, weights=row[c], minlength=n) for c in ("weak_words", "odd_words")}
    out |= {"baseline_sets": _count(at, n, drifting) > 0, "column_sets": _count(across, n, off) > 0}

    def edges(group, kept, names, values):
        found = [values[c] for c in names]
        return _corners(group, n, kept, tuple(found[:2]), tuple(found[2:]))
    deviant, drift = edges(at, np.ones(len(at), dtype=bool), DEVIANT, row), edges(at, drifting, DRIFT, row)
    both = [pick(a, b) for pick, a, b in zip((np.fmin, np.fmin, np.fmax, np.fmax), deviant, drift)]
    return out | dict(zip(SUMMARY_CORNERS, both + edges(across, off, OFF, column)))


# ----------------------------------------------------------------- price lists and mark sheets of pages
# A word has idx, left, top, width, height, conf, number, amount and labels: ``number`` is what the text says, ``amount`` the text where it is a
# plain amount, ``labels`` the bits of the labels it starts with. The rules are those of ``operators.ledger``.
LABEL_BITS = {"subtotal": 1, "tax": 2, "total": 4, "marks": 8, "percentage": 16}
CHECKS = ("line_amount", "grand_total", "subtotal", "total", "percentage")
_CHECK = ("kind", "ord", "expected", "actual", "tolerance", "min_conf", "x0", "y0", "x1", "y1")


class _Ledger:
    """The words of some pages, and the look-ups that lists and sheets share."""

    def __init__(self, n: int, page: np.ndarray, words: pa.Table):
        self.n, self.page = n, page
        self.word = {c: _floats(words[c]) for c in ("idx", "left", "top", "width", "height", "conf", "number")}
        self.labels = pc.fill_null(words["labels"], 0).to_numpy()
        self.amount = words["amount"].combine_chunks()
        height = self.word["height"]
        self.typical = _median(self.page, np.where(height > 0, height, np.nan), self.n)
        self.middle = 2 * self.word["top"] + height
        plain = self.amount.is_valid().to_numpy(zero_copy_only=False)
        self.amounts = np.flatnonzero(plain & ~np.isnan(self.word["number"] + self.middle + self.word["left"]) & (height > 0))

    def first(self, rows: np.ndarray, *keys: np.ndarray) -> np.ndarray:
        """Per page the first of ``rows`` by ``keys`` (no value comes first), -1 where there is none."""
        return _heads(self.page[rows], self.n, rows, *[k[rows] for k in keys])

    def label(self, name: str, which: str) -> np.ndarray:
        idx, top, left = (self.word[c] for c in ("idx", "top", "left"))
        hits = np.flatnonzero(self.labels & LABEL_BITS[name])
        return self.first(hits[~np.isnan(idx[hits])], idx) if which == "first" else self.first(hits, -top, -left, idx)

    def of(self, column: str, rows: np.ndarray) -> np.ndarray:
        """Values of words, NaN for -1."""
        return np.where(rows >= 0, self.word[column][rows], np.nan) if len(self.page) else np.full(len(rows), np.nan)

    def beside(self, label: np.ndarray) -> np.ndarray:
        """Per page the amount nearest to the right of its label word."""
        height = self.of("height", label)
        own = np.where(height > 0, 2 * self.of("top", label) + height, np.nan)
        edge = self.of("left", label) + self.of("width", label) - 2
        rows, at = self.amounts, self.page[self.amounts]
        seen = (np.abs(self.middle[rows] - own[at]) <= 2 * self.typical[at]) & (self.word["left"][rows] >= edge[at])
        rows = rows[seen]
        left, idx, conf, top, width, height = (self.word[c][rows] for c in ("left", "idx", "conf", "top", "width", "height"))
        order, new = _numbered(idx, left, self.page[rows])
        text = np.zeros(len(rows)) if new.all() else pc.rank(self.amount.take(pa.array(rows)), tiebreaker="dense").to_numpy().astype(float)
        return _heads(self.page[rows], self.n, rows, left, idx, text, conf, top, width, height)

    def box(self, rows: np.ndarray) -> list[np.ndarray]:
        left, top, width, height = (self.of(c, rows) for c in ("left", "top", "width", "height"))
        return [left, top, left + width, top + height]

    def trusted(self, rows: np.ndarray) -> np.ndarray:
        conf = self.of("conf", rows)
        return np.where(conf >= 50, conf, np.nan)


def _heads(group: np.ndarray, groups: int, rows: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    order = np.lexsort((*[np.where(np.isnan(k), -np.inf, k) for k in reversed(keys)], group))
    heads = order[np.flatnonzero(np.diff(group[order], prepend=-1))]
    out = np.full(groups, -1, dtype=np.int64)
    out[group[heads]] = rows[heads]
    return out


def _least(group: np.ndarray, groups: int, value: np.ndarray) -> np.ndarray:
    out, known = np.full(groups, np.inf), ~np.isnan(value)
    np.minimum.at(out, group[known], value[known])
    return np.where(out == np.inf, np.nan, out)


def _price_list(x: _Ledger, from_left: float = 300, row_gap: float = 18, column_gap: float = 34, span: float = 55, least_rows: int = 3):
    """Checks of the price list of every page: owner and values, in parts."""
    subtotal, tax, total = x.label("subtotal", "first"), x.label("tax", "first"), x.label("total", "last")
    above = x.of("top", subtotal)
    bottom = np.where(np.isnan(above), x.of("top", total), above) - 12
    left, top = x.word["left"], x.word["top"]
    figures = np.flatnonzero(~np.isnan(x.word["number"]) & (left >= from_left) & (top < bottom[x.page]))
    figures = figures[np.lexsort((top[figures], x.page[figures]))]
    page, centre = x.page[figures], left[figures] + x.word["width"][figures] / 2
    begins = np.ones(len(figures), dtype=bool)
    begins[1:] = page[1:] != page[:-1]
    new = begins.copy()
    new[1:] |= np.diff(top[figures]) > row_gap
    row, owner = np.cumsum(new) - 1, page[new]
    rows = len(owner)
    opened = np.full(x.n, rows)  # the first row of every page
    opened[page[begins]] = row[begins]
    bank = np.arange(rows) - opened[owner]
    starts, beyond = [], np.full(rows, -np.inf)
    for _ in range(3):
        ahead = centre > beyond[row]
        start = _least(row[ahead], rows, centre[ahead])
        starts.append(start)
        beyond = start + column_gap
    grid = np.full(x.n, rows)  # the row that opens the columns
    whole = np.flatnonzero(~np.isnan(starts[2]))
    np.minimum.at(grid, owner[whole], whole)
    inside = row >= grid[page]
    row_in, word, page = row[inside], figures[inside], page[inside]
    distance = np.abs(centre[inside] - np.array([s[grid[page]] for s in starts]).reshape(3, -1))
    near = np.where(np.isnan(distance), np.inf, distance).argmin(axis=0) if len(word) else np.zeros(0, dtype=np.int64)
    close = distance[near, np.arange(len(word))] <= span
    kept = word[close]
    cell = _heads((row_in * 3 + near)[close], rows * 3, kept, top[kept], left[kept], x.word["idx"][kept]).reshape(rows, 3)
    listed = np.arange(rows) >= grid[owner]
    full = listed & (cell >= 0).all(axis=1)
    size, complete = np.bincount(owner[listed], minlength=x.n), np.bincount(owner[full], minlength=x.n)
    line = np.flatnonzero(full & (size >= least_rows)[owner])
    at, (q, r, a) = owner[line], cell[line].T
    expected, actual = x.of("number", q) * x.of("number", r), x.of("number", a)
    low = np.fmin(np.fmin(x.of("conf", q), x.of("conf", r)), x.of("conf", a))
    tolerance = np.maximum(2.0, 0.05 * expected)
    judged = (low >= 60) & (expected > 0)
    prices = np.bincount(at[judged & (np.abs(expected - actual) <= tolerance)], minlength=x.n) > 0
    shown = judged & prices[at]

    def part(rows, kind, ord_, *values):
        return rows, [np.full(len(rows), kind), ord_, *values]
    yield part(at[shown], 0, bank[line][shown].astype(float), *[v[shown] for v in (expected, actual, tolerance, low, *x.box(a))])
    value = {n: x.beside(w) for n, w in (("subtotal", subtotal), ("tax", tax), ("total", total))}
    number, conf = ({n: fn(w) for n, w in value.items()} for fn in (lambda w: x.of("number", w), x.trusted))
    grand, none = number["subtotal"] + number["tax"], np.full(x.n, np.nan)
    values = (none, grand, number["total"], np.maximum(2.0, 0.01 * grand), np.fmin(np.fmin(conf["subtotal"], conf["tax"]), conf["total"]), *x.box(value["total"]))
    pages = np.flatnonzero(~np.isnan(grand) & (value["total"] >= 0))
    yield part(pages, 1, *[v[pages] for v in values])
    added = np.bincount(at, weights=actual, minlength=x.n)
    sure = np.fmin(_least(at, x.n, x.trusted(a)), conf["subtotal"])
    values = (none, added, number["subtotal"], np.maximum(2.0, 0.01 * number["subtotal"]), sure, *x.box(value["subtotal"]))
    pages = np.flatnonzero((size == complete) & (complete >= 3) & prices & (value["subtotal"] >= 0))
    yield part(pages, 2, *[v[pages] for v in values])


def _mark_sheet(x: _Ledger, reach: float = 40, least_rows: int = 3):
    """Checks of the mark sheet of every page. The mean that a percentage is held against is not rounded yet."""
    marks, total, percentage = x.label("marks", "last"), x.label("total", "last"), x.label("percentage", "first")
    value, share = x.beside(total), x.beside(percentage)
    sheet = (marks >= 0) & (value >= 0)
    middle, above, below = x.of("left", marks) + x.of("width", marks) / 2, x.of("top", marks) + 14, x.of("top", total) - 4
    number, top, conf = x.word["number"], x.word["top"], x.word["conf"]
    word = np.flatnonzero(sheet[x.page] & ~np.isnan(number) & (top > above[x.page]) & (top < below[x.page]))
    page = x.page[word]
    off = np.abs(x.word["left"][word] + x.word["width"][word] / 2 - middle[page])
    kept = (off <= reach) & ((number[word] >= 10) | (conf[word] >= 85))
    n = np.bincount(page[kept], minlength=x.n)
    added = np.bincount(page[kept], weights=number[word[kept]], minlength=x.n)
    maxima = np.bincount(page[(off > reach) & (number[word] == 100)], minlength=x.n)
    low = _least(page[kept], x.n, x.trusted(word[kept]))
    printed = x.of("number", value)
    tolerance = np.maximum(2.5, 0.015 * printed)
    pages = np.flatnonzero(sheet & (n >= least_rows) & (n == maxima))
    none = np.full(x.n, np.nan)
    values = (none, added, printed, tolerance, np.fmin(low, x.trusted(value)), *x.box(value))
    yield pages, [np.full(len(pages), 3), *[v[pages] for v in values]]
    pages = pages[(np.abs(added - printed) <= tolerance)[pages] & (share[pages] >= 0)]
    values = (none, added / np.maximum(n, 1), x.of("number", share), np.full(x.n, 0.5), np.fmin(low, x.trusted(share)), *x.box(share))
    yield pages, [np.full(len(pages), 4), *[v[pages] for v in values]]


def checks_of(*readers):
    """Checks of some pages as rows (``CHECK_FIELDS``), for ``pages_read``."""
    def read(n: int, page: np.ndarray, words: pa.Table) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        x = _Ledger(n, page, words)
        owners, parts = zip(*[part for reader in readers for part in reader(x)])
        return np.concatenate(owners), {c: np.concatenate(v).astype(float) for c, v in zip(_CHECK, zip(*parts))}
    return read


def layout_of(n: int, page: np.ndarray, words: pa.Table) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """What ``page_layout`` says of some pages."""
    found = _layout_of(n, page, {c: _floats(words[c]) for c in ("left", "top", "width", "height", "conf")})
    return np.arange(n), {c: v.astype(float) for c, v in found.items()}


price_lists, mark_sheets = _price_list, _mark_sheet
CHECK_FIELDS = [StructField(c, DoubleType()) for c in _CHECK]
LAYOUT_FIELDS = [StructField(c, DoubleType()) for c in (*SUMMARY_COUNTS, *SUMMARY_CORNERS)]
WORDS_AT_ONCE = 1 << 16


def _floats(column: pa.ChunkedArray) -> np.ndarray:
    return pc.cast(column, pa.float64()).to_numpy()


def pages_read(readers, fields: list[StructField]):
    """Function over the words of pages, those of a page (``case_id``) behind one another, with the number of words of their page in
    ``page_words``: what each of ``readers`` says of the pages, one below the other; NULL in ``fields`` of other readers."""
    kinds = [pa.float64()] * len(fields)

    def said(words: pa.Table, starts: np.ndarray):
        page = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, words.num_rows)))
        for reader in readers:
            owner, values = reader(len(starts), page, words)
            case = words["case_id"].take(pa.array(starts[owner])).combine_chunks()
            columns = [pa.array(values[f.name], from_pandas=True) if f.name in values else pa.nulls(len(owner), kind) for f, kind in zip(fields, kinds)]
            yield pa.RecordBatch.from_arrays([case, *columns], ["case_id", *[f.name for f in fields]])

    def read(batches):
        held, rows = [], 0

        def full(last: bool):
            """Whole pages of what is held; the rest stays."""
            nonlocal held, rows
            words = pa.Table.from_batches(held)
            case = words["case_id"].combine_chunks()
            starts = np.flatnonzero(np.append(True, pc.not_equal(case[1:], case[:-1]).to_numpy(zero_copy_only=False)))
            open_ = not last and words.num_rows - starts[-1] < words["page_words"][int(starts[-1])].as_py()
            held, rows = (words.slice(starts[-1]).to_batches(), words.num_rows - int(starts[-1])) if open_ else ([], 0)
            words, starts = (words.slice(0, starts[-1]), starts[:-1]) if open_ else (words, starts)
            if len(starts):
                yield from said(words, starts)
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
                if rows >= WORDS_AT_ONCE:
                    yield from full(False)
        if held:
            yield from full(True)
    return read


_ONES = np.array([(1 << n) - 1 for n in range(65)], np.uint64)  # the n lowest bits


def _covered(cases: pa.Array, width: int, height: int) -> pa.Array:
    """Pixels that the boxes of each case cover: side 0 (p), side 1 (t) and both (u). A row of pixels is a row of bits."""
    flat, sizes = cases.flatten(), np.diff(cases.offsets.to_numpy())
    side, x0, x1, y0, y1 = (flat.field(c).to_numpy(zero_copy_only=False)[:, None] for c in ("side", "x0", "x1", "y0", "y1"))
    word = 64 * np.arange(-(-width // 64))
    bits = _ONES[np.clip(x1 - word, 0, 64)] & ~_ONES[np.clip(x0 - word, 0, 64)]
    rows, first = np.arange(height), np.cumsum(sizes) - sizes
    step = max(1, (1 << 21) // (2 * height * len(word)))
    out = np.zeros((3, len(sizes)), np.int64)
    for start in range(0, len(sizes), step):
        part = slice(start, start + step)
        raster = np.zeros((len(sizes[part]), 2, height, len(word)), np.uint64)
        for k in range(int(sizes[part].max(initial=0))):  # the next box of every case that has one
            live = np.flatnonzero(sizes[part] > k)
            box = first[part][live] + k
            inside = (rows >= y0[box]) & (rows < y1[box])
            raster[live, side[box, 0]] |= np.where(inside[:, :, None], bits[box][:, None, :], np.uint64(0))
        for i, seen in enumerate((raster[:, 0], raster[:, 1], raster[:, 0] | raster[:, 1])):
            out[i, part] = np.bitwise_count(seen).sum((1, 2), dtype=np.int64)
    return pa.StructArray.from_arrays([pa.array(x) for x in out], names=["p", "t", "u"])


def covered_areas(boxes: Column, width: int, height: int) -> Column:
    """Pixels covered by an array of boxes (side 0 or 1, x0, x1, y0, y1; ends exclusive) on a raster: struct of ``p`` (side 0),
    ``t`` (side 1) and ``u`` (either)."""
    @F.arrow_udf(StructType([StructField(c, LongType()) for c in "ptu"]))
    def covered(cases: pa.Array) -> pa.Array:
        return _covered(cases, width, height)
    return covered(boxes)
