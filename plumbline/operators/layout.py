"""Layout of pages: table cells with spans, text lines from glyph intervals, and cells between ruling lines.

Everything is keyed by page; no page is compared as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..sources.storage import cut

#: Fixed values of the HTML standard: the widest and the highest cell there is.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
#: Boxes and ruling lines of a page that one task takes whole, and about how many of several pages it takes at once.
PAGE = 50_000
#: About how many pairs of a box and a cell are compared at once.
PAIRS = 1_000_000


def _with(schema: StructType, **more: str) -> StructType:
    out = StructType(list(schema.fields))
    for name, kind in more.items():
        out.add(name, kind)
    return out


def placed_cells(cells: DataFrame, table: list[str], row: str, seq: str, row_span: str, column_span: str) -> DataFrame:
    """``cells`` with ``first_column, end_column, end_row`` and ``overlaps``: the place of each cell in its table's grid.

    A cell takes the first free column after its row's last cell.  A column is taken in later rows as far as a cell
    above spans; a cell that spans over columns taken so ``overlaps``.  Spans that are null or below 1 count as 1, wider
    and higher ones than the standard allows as its limit, and no cell reaches below the last row.  Rows are walked in order
    in one pass over sorted partitions, which remembers the row until which each column is taken.  A table is a unit: its rows meet in
    one task, one at a time.  Empty tables give empty tables; repeated rows are cells of their own.
    """
    whole = lambda c, most: F.least(F.greatest(F.coalesce(F.col(c).cast("int"), F.lit(1)), F.lit(1)), F.lit(most))
    # the windows bring a table's rows to one task (no other shuffle, where the cells are dealt by their page already) and sort them for the walk
    in_order = Window.partitionBy(*table).orderBy("_row", seq)
    keyed = cells.withColumns({"_wide": whole(column_span, MOST_COLUMNS), "_high": whole(row_span, MOST_ROWS), "_row": F.col(row).cast("long")})
    last = F.max("_row").over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    inner = keyed.withColumns({"_begins": F.row_number().over(in_order) == 1, "_last": last}).sortWithinPartitions(*table, "_row", seq)
    names = inner.columns
    at = [names.index(c) for c in ("_begins", "_row", "_wide", "_high")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current_row, cursor, taken = None, 0, []
        for batch in batches:
            first, end, over = [], [], []
            for begins, r, wide, high in zip(*(batch.column(i).to_pylist() for i in at), strict=True):
                if begins:
                    current_row, taken = None, []
                if r != current_row:
                    current_row, cursor = r, 0
                while cursor < len(taken) and taken[cursor] > r:
                    cursor += 1
                first.append(cursor)
                stop = cursor + wide
                if stop > len(taken):
                    taken += [0] * (stop - len(taken))
                clash, until = False, r + high
                for i in range(cursor, stop):
                    if taken[i] > r:
                        clash = True
                    if taken[i] < until:
                        taken[i] = until
                over.append(clash)
                cursor = stop
                end.append(stop)
            grid = [pa.array(first, pa.int32()), pa.array(end, pa.int32()), pa.array(over, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *grid], names=[*names, "first_column", "end_column", "overlaps"])

    out = inner.mapInArrow(walk, _with(inner.schema, first_column="integer", end_column="integer", overlaps="boolean"))
    out = out.dropna(subset=table)
    end_row = F.least(F.col("_row") + F.col("_high"), F.col("_last") + 1).cast("long")
    return out.withColumn("end_row", end_row).drop("_wide", "_high", "_begins", "_row", "_last")


_TAG = r"(?i)^<(/?(?:table|tr|td|th))\b"
_SCRIPTS = r"(?is)<!--.*?-->|<(script|style|template|noscript)\b.*?</\1\s*>"
#: Entities that texts of cells are read with, the ampersand last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
SCOPES = ("row", "col", "rowgroup", "colgroup")


def _plain(html: Column) -> Column:
    text = F.regexp_replace(html, "<[^>]*>", "")
    for entity, character in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def _attributes(tags: DataFrame, tag: str, names: list[str]) -> DataFrame:
    """``tags`` with the values of attributes as columns of their names, empty where a tag has none."""
    value = r"""("[^"]*"|'[^']*'|[^\s"'>]+)"""
    raw = tags.withColumns({n: F.regexp_extract(tag, rf"(?is)(?:^|\s){n}\s*=\s*{value}", 1) for n in names})
    # the value without its quotes
    quoted = lambda n: F.left(n, F.lit(1)).isin("'", '"')
    return raw.withColumns({n: F.when(quoted(n), F.substr(n, F.lit(2), F.length(n) - 2)).otherwise(F.col(n)) for n in names})


def table_cells(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """A row per cell of the tables of every page: ``id_col, table, row, seq, header, scope, row_span, column_span, text, runs``.

    A page is cut before each tag of a table, row or cell.  Which table a piece belongs to is the last one opened at its
    depth of nesting, so a table within a cell is a table of its own, and its text is no part of the cell's.  Rows without cells count.
    ``row_span`` and ``column_span`` are as declared, null unless whole numbers above 0.  ``runs`` is an array of ``kind``
    (``text``, ``superscript``, ``subscript``) and ``text``, null where a cell has neither super- nor subscripts.  Null pages and pages without
    tables have no row.  Built-in functions only.
    """
    clean = F.regexp_replace(F.col(html_col), _SCRIPTS, "")
    pieces = pages.select(id_col, F.posexplode(F.split(clean, r"(?i)(?=</?(?:table|tr|td|th)\b)")).alias("k", "piece"))
    # one search a piece; the rest of a tag is read where it is a cell's
    pieces = pieces.withColumn("tag", F.lower(F.regexp_extract("piece", _TAG, 1))).where((F.col("tag") != "") & F.col("piece").contains(">"))
    pieces = pieces.withColumns({"name": F.ltrim("tag", F.lit("/")), "start": ~F.col("tag").startswith("/")}).drop("tag")
    by_page = Window.partitionBy(id_col).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.when(F.col("name") == "table", F.when(F.col("start"), 1).otherwise(-1)).otherwise(0)
    pieces = pieces.withColumn("depth", F.sum(opens).over(by_page))
    opened = (F.col("name") == "table") & F.col("start")
    at_depth = Window.partitionBy(id_col, "depth").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    pieces = pieces.where("depth > 0").withColumn("table", F.last(F.when(opened, F.col("k")), ignorenulls=True).over(at_depth))
    in_table = Window.partitionBy(id_col, "table").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    is_cell = F.col("name").isin("td", "th") & F.col("start")
    row = F.sum(F.when((F.col("name") == "tr") & F.col("start"), 1).otherwise(0)).over(in_table) - 1
    # the cell that is open: begun by its tag, ended by its end tag or by a tag of a row
    cell = F.last(F.when(is_cell, F.col("k")).when(F.col("name") != "table", F.lit(-1)), ignorenulls=True).over(in_table)
    inside = pieces.withColumns({"row": row, "cell": cell}).where("row >= 0 AND cell >= 0")
    body = F.array_sort(F.collect_list(F.struct("k", F.substr("piece", F.locate(">", "piece") + 1).alias("html"))))
    head = F.min_by(F.struct("name", F.substring_index("piece", ">", 1).alias("tag")), "k")
    found = inside.groupBy(id_col, "table", "row", F.col("cell").alias("seq")).agg(head.alias("head"), F.array_join(body["html"], "").alias("body"))
    found = found.withColumn("tag", F.substr("head.tag", F.length("head.name") + 2))
    found = _attributes(found, "tag", ["scope", "rowspan", "colspan"])
    declared = lambda n: F.nullif(F.regexp_extract(F.trim(n), r"^\d{1,9}$", 0).try_cast("int"), F.lit(0))
    scope = F.lower("scope")
    parts = F.split("body", r"(?i)(?=</?(?:sup|sub)\b)")
    kind = lambda p: F.when(p.rlike("(?i)^<sup"), "superscript").when(p.rlike("(?i)^<sub"), "subscript").otherwise("text")
    runs = F.filter(F.transform(parts, lambda p: F.struct(kind(p).alias("kind"), _plain(p).alias("text"))), lambda r: r["text"] != "")
    return found.select(
        id_col,
        "table",
        "row",
        "seq",
        (F.col("head.name") == "th").alias("header"),
        F.when(scope.isin(*SCOPES), scope).alias("scope"),
        declared("rowspan").alias("row_span"),
        declared("colspan").alias("column_span"),
        _plain(F.col("body")).alias("text"),
        F.when(F.col("body").rlike(r"(?i)<su[pb]\b"), runs).alias("runs"),
    )


def text_lines(glyphs: DataFrame, key: list[str], id_col: str, bottom: str = "bottom", top: str = "top") -> DataFrame:
    """``glyphs`` with ``line``: runs of vertical intervals that overlap, one through the other, numbered from 0 upwards.

    Intervals that only touch are on different lines.  Rows whose interval is unknown or has no inside are left out.  A page
    is not a unit: rows are dealt by ranges of (page, bottom), the highest top and the lines begun so far are carried within a range, and from
    range to range as one row per page and range.
    """
    sound = glyphs.where(F.col(bottom) < F.col(top))
    dealt = cut(sound.repartitionByRange(*key, bottom, id_col).withColumn("_part", F.spark_partition_id()))
    w = Window.partitionBy(*key, "_part").orderBy(bottom, id_col)
    before, over_parts = w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*key).orderBy("_part")
    highest = dealt.groupBy(*key, "_part").agg(F.max(top).alias("_top"))
    carried = highest.withColumn("_carried", F.max("_top").over(over_parts.rowsBetween(Window.unboundedPreceding, -1))).drop("_top")
    reach = F.greatest(F.max(top).over(before), F.col("_carried"))
    begins = F.coalesce(F.col(bottom) >= reach, F.lit(True)).cast("long")
    marked = cut(dealt.join(carried, [*key, "_part"]).withColumn("_begins", begins).drop("_carried"))
    counts = marked.groupBy(*key, "_part").agg(F.sum("_begins").alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(over_parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.sum("_begins").over(w.rowsBetween(Window.unboundedPreceding, 0))
    counted = marked.join(counts.select(*key, "_part", earlier.alias("_earlier")), [*key, "_part"])
    return counted.withColumn("line", own + F.col("_earlier") - 1).drop("_part", "_begins", "_earlier")


class _Lines:
    """Rules of any number of groups, and for an item of a group the nearest of them that covers it; all items at once.

    Rules lie by (group, at, rule).  An item begins at the first one whose edge can be beyond it, and from a rule that does not cover it goes
    on to the next one that is not within that rule's range, so rules that a nearer one covers are passed over together.
    """

    def __init__(self, group: np.ndarray, rule: np.ndarray, low: np.ndarray, high: np.ndarray, at: np.ndarray, edge: np.ndarray):
        order = np.lexsort((rule, at, group))
        self.group, self.rule, self.low, self.high, self.at, self.edge = (x[order] for x in (group, rule, low, high, at, edge))
        self.edges, rank = np.unique(self.edge, return_inverse=True)
        self.step = len(self.edges) + 1
        # the highest edge so far in a group, as its place among all edges
        self.reach = np.maximum.accumulate(self.group * self.step + rank) if len(order) else self.group
        end = np.searchsorted(self.group, self.group, "right")
        self.next = np.arange(1, len(order) + 1)
        some = np.flatnonzero(self.next < end)
        while len(some):
            then = self.next[some]
            some, then = (x[(self.low[then] >= self.low[some]) & (self.high[then] <= self.high[some])] for x in (some, then))
            self.next[some] = self.next[then]
            some = some[self.next[some] < end[some]]

    def nearest(self, group: np.ndarray, low: np.ndarray, high: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The place of each item's rule, -1 where it has none."""
        out = np.full(len(group), -1)
        place = np.searchsorted(self.reach, group * self.step + np.searchsorted(self.edges, at, "left"), "left")
        end = np.searchsorted(self.group, group, "right")
        asked = np.flatnonzero(place < end)
        place = place[asked]
        while len(asked):
            covers = (self.low[place] <= low[asked]) & (high[asked] <= self.high[place])
            hit = covers & (self.edge[place] >= at[asked])
            out[asked[hit]] = place[hit]
            place = np.where(covers, place + 1, self.next[place])
            on = ~hit & (place < end[asked])
            asked, place = asked[on], place[on]
        return out


def _covers(items: DataFrame, rules: DataFrame, key: list[str], width: float, sides: tuple[str, str]) -> DataFrame:
    """``items`` with ``<side>_rule, <side>_at, <side>_low, <side>_high`` of the nearest covering rule before and after them, ``sides`` being
    the names of both; where one of these is empty, that side is not asked for.

    ``items`` have ``_low, _high, _from, _to``, ``rules`` ``key, _id, _low, _high`` too and, of ``_from, _to``, where they stand.  Before an item is the nearest rule
    whose ``_edge_from`` is at or below its ``_from``, after it the one whose ``_edge_to`` is at or beyond its ``_to``; all are doubles but ``_id``.  A covering
    rule's range holds the item's.  Items that lack a rule on a side asked for have no row.

    Both are dealt once for both sides: rules stand in every bucket of ``width`` that they cover, items in that of ``_low``.  Rows of a task are sorted by
    one number, a hash of page and bucket with the rules first, which is much cheaper than by the keys themselves; pages and buckets of the same hash
    are told apart by their keys.  A task holds the rules of one page and bucket.
    """
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    carried = items.columns
    spread = rules.withColumns({"_bucket": F.explode(F.sequence(bucket("_low"), bucket("_high"))), "_kind": F.lit(0).cast("long")})
    asked = items.withColumns({"_bucket": bucket("_low"), "_kind": F.lit(1).cast("long")})
    both = spread.unionByName(asked, allowMissingColumns=True)
    place = F.xxhash64(*key, "_bucket").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("_kind"))
    dealt = both.withColumn("_place", place).drop("_kind").repartition(*key, "_bucket").sortWithinPartitions("_place")
    names = [s for s in sides if s]
    of_sides = {f"{s}_{c}": kind for s in names for c, kind in (("rule", "long"), ("at", "double"), ("low", "double"), ("high", "double"))}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the rules of the place that the batch before ended in
        number = lambda batch, c: batch.column(c).to_numpy(zero_copy_only=False)
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.concat_batches([held, batch])
            where = number(batch, "_place")
            own, at = np.flatnonzero(where % 2 == 0), np.flatnonzero(where % 2)
            held = batch.take(pa.array(own[where[own] == where[-1] // 2 * 2]))
            if not len(own) or not len(at):
                continue
            group = np.zeros(batch.num_rows, np.int64)
            for c in (*key, "_bucket"):
                codes = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy()
                group = np.unique(group * (int(codes.max()) + 1) + codes, return_inverse=True)[1]
            lines, some = batch.take(pa.array(own)), batch.take(pa.array(at))
            of, ends = [number(lines, c) for c in ("_id", "_low", "_high")], [number(some, c) for c in ("_low", "_high")]
            found = {}
            for name, c, sign in zip(sides, ("_from", "_to"), (-1, 1), strict=True):
                if name:
                    near = _Lines(group[own], *of, number(lines, c) * sign, number(lines, f"_edge{c}") * sign)
                    found[name] = near, near.nearest(group[at], *ends, number(some, c) * sign), sign
            whole = np.flatnonzero(np.logical_and.reduce([k >= 0 for _, k, _ in found.values()]))
            answers = []
            for near, k, sign in found.values():
                answers += [pa.array(x) for x in (near.rule[k[whole]], near.at[k[whole]] * sign, near.low[k[whole]], near.high[k[whole]])]
            some = some.take(pa.array(whole))
            yield pa.RecordBatch.from_arrays([*(some.column(c) for c in carried), *answers], names=[*carried, *of_sides])

    return dealt.mapInArrow(walk, _with(StructType([dealt.schema[c] for c in carried]), **of_sides))


def nearest_cover(items: DataFrame, rules: DataFrame, key: list[str], width: float) -> DataFrame:
    """``key, id, rule, at``: for every item (``key, id, low, high, at``) the rule (``key, rule, low, high, at, edge``) that covers
    ``low`` to ``high``, has its ``edge`` at or beyond the item's ``at``, and of these the least ``at`` (equal ones: the least ``rule``).

    Rules stand in every bucket of ``width`` that they cover, items in that of ``low``.  An item is compared with its neighbours and not with
    its page: it begins at the first rule beyond it, and passes over those that a nearer one covers.  Items without such a rule have no
    row; rows with an unknown number are left out.
    """
    double = lambda c: F.col(c).cast("double")
    known = items.where(F.col("low").isNotNull() & F.col("high").isNotNull() & F.col("at").isNotNull())
    asked = known.select(*key, F.col("id").cast("long").alias("id"), double("low").alias("_low"), double("high").alias("_high"), double("at").alias("_to"))
    sound = rules.where((F.col("low") <= F.col("high")) & F.col("edge").isNotNull() & F.col("at").isNotNull()).select(
        *key, F.col("rule").cast("long").alias("_id"), double("low").alias("_low"), double("high").alias("_high"), double("at").alias("_to"), double("edge").alias("_edge_to")
    )
    return _covers(asked, sound, key, width, ("", "far")).select(*key, "id", F.col("far_rule").alias("rule"), F.col("far_at").alias("at"))


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole pages, some at a time, of rows sorted by ``_place``."""
    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n < PAGE:
            continue
        rows = pa.Table.from_batches(held)
        place = rows["_place"].to_numpy()
        end = int(np.searchsorted(place, place[-1]))
        if end:
            yield rows.slice(0, end).combine_chunks()
        held, n = rows.slice(end).to_batches(), len(place) - end
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _codes(table: pa.Table, key: list[str]) -> np.ndarray:
    """A number of each row that only rows of the same key have."""
    group = np.zeros(len(table), np.int64)
    for c in key:
        codes = table[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        group = np.unique(group * (int(codes.max(initial=0)) + 1) + codes, return_inverse=True)[1]
    return group


def _steps(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers from ``first`` to ``last`` of every row: the row, and the number."""
    n = np.maximum(last - first + 1, 0).astype(np.int64)
    of = np.repeat(np.arange(len(n)), n)
    return of, first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


def _bounds(*numbers: np.ndarray) -> tuple[float, float]:
    """The least and the greatest finite number."""
    known = np.concatenate(numbers)
    known = known[np.isfinite(known)]
    return (float(known.min()), float(known.max())) if len(known) else (0.0, 0.0)


def _around(lines: dict[str, np.ndarray], items: list[np.ndarray], width: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``at, low, high`` of the nearest line before each item and of the nearest after it that cover it, not numbers where it has none.

    ``items``: their group, low, high, and where they begin and end across.  Lines and items meet in buckets of ``width``, as in ``_covers``.
    """
    group, low, high, begin, end = items
    bucket = lambda x: np.floor(x / width)
    least, most = _bounds(bucket(low))
    of, at = _steps(np.maximum(bucket(lines["_low"]), least), np.minimum(bucket(lines["_high"]), most))
    span = int(most - least) + 1
    place, asked = (g * span + (b - least).astype(np.int64) for g, b in ((lines["group"][of], at), (group, np.clip(bucket(low), least, most))))
    places, place = np.unique(place, return_inverse=True)
    own = np.searchsorted(places, asked)
    known = np.flatnonzero(places[np.minimum(own, len(places) - 1)] == asked) if len(places) else np.zeros(0, np.int64)
    found = []
    for sign, edge, across in ((-1, "_edge_from", begin), (1, "_edge_to", end)):
        near = _Lines(place, *(lines[c][of] for c in ("_rule", "_low", "_high")), lines["_at"][of] * sign, lines[edge][of] * sign)
        k = near.nearest(own[known], low[known], high[known], across[known] * sign)
        hit = k >= 0
        side = []
        for x in (near.at * sign, near.low, near.high):
            out = np.full(len(group), np.nan)
            out[known[hit]] = x[k[hit]]
            side.append(out)
        found.append(tuple(side))
    return found


_NUMBERS = ["x0", "x1", "y0", "y1"]
_PLACE = ["left", "right", "bottom", "top"]


def _cells_of_boxes(rows: DataFrame, key: list[str], width: float) -> DataFrame:
    """``key, _place, id`` and sides of boxes with the ``left, right, bottom, top`` of the cell they lie in, not numbers where they lie in none.

    ``rows`` are boxes (``_kind`` 2), level (0) and upright (1) lines, sorted by ``_place``, a page of them in one task.
    """
    carried = [*key, "_place", "id", *_NUMBERS]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for page in _pages(batches):
            group, kind = _codes(page, key), page["_kind"].to_numpy()
            of_kind = []
            for k in (0, 1):
                lines = page.filter(pa.array(kind == k))
                ruled = {c: lines[c].to_numpy() for c in ("_rule", "_low", "_high", "_at", "_edge_from", "_edge_to")} | {"group": group[kind == k]}
                # an unknown number is in no comparison
                sound = ~np.isnan(np.stack([ruled[c] for c in ("_low", "_high", "_at", "_edge_from", "_edge_to")])).any(axis=0)
                of_kind.append({c: x[sound] for c, x in ruled.items()})
            boxes = page.filter(pa.array(kind == 2))
            x0, x1, y0, y1 = sides = [boxes[c].to_numpy() for c in _NUMBERS]
            place = np.full((4, len(boxes)), np.nan)
            at = np.flatnonzero(~np.isnan(np.stack(sides)).any(axis=0))
            own = group[kind == 2]
            (bottom, b_low, b_high), (top, t_low, t_high) = _around(of_kind[0], [own[at], x0[at], x1[at], y0[at], y1[at]], width)
            both = np.flatnonzero(~np.isnan(bottom) & ~np.isnan(top))
            at, bottom, top = at[both], bottom[both], top[both]
            least, most = np.maximum(b_low, t_low)[both], np.minimum(b_high, t_high)[both]
            (left, _, _), (right, _, _) = _around(of_kind[1], [own[at], bottom, top, x0[at], x1[at]], width)
            whole = (least <= left) & (most >= right)
            place[:, at[whole]] = np.stack([left, right, bottom, top])[:, whole]
            out = pa.Table.from_arrays([*boxes.select(carried).columns, *map(pa.array, place)], [*carried, *_PLACE])
            yield from out.combine_chunks().to_batches()

    return rows.mapInArrow(walk, _with(StructType([rows.schema[c] for c in carried]), **dict.fromkeys(_PLACE, "double")))


def _boxes_of_cells(boxes: DataFrame, key: list[str], width: float) -> DataFrame:
    """The cells of ``grid_cells`` from boxes of ``_cells_of_boxes``, which lie page by page."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = lambda x: np.floor(x / width)
        for page in _pages(batches):
            group = _codes(page, key)
            sides = np.stack([page[c].to_numpy() for c in _PLACE]) + 0.0
            some = np.flatnonzero(~np.isnan(sides[0]))
            if not len(some):
                continue
            some = some[np.lexsort((*sides[:, some], group[some]))]
            facts = np.vstack([group[some], sides[:, some]])
            some = some[np.concatenate([[True], (facts[:, 1:] != facts[:, :-1]).any(axis=0)])]
            # an unknown number is greater than any other here
            x0, x1, y0, y1 = (np.where(np.isnan(x), np.inf, x) for x in (page[c].to_numpy() for c in _NUMBERS))
            left, right, bottom, top = sides[:, some]
            across, along = _bounds(bucket(x0), bucket(x1)), _bounds(bucket(y0), bucket(y1))
            at = lambda x, ends: np.clip(bucket(x), *ends)

            def spread(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                ranges = [np.sort([at(low, ends), at(high, ends)], axis=0) for low, high, ends in ((a, b, across), (c, d, along))]
                of, cx = _steps(*ranges[0])
                again, cy = _steps(*ranges[1][:, of])
                return of[again], cx[again], cy

            cell, cell_x, cell_y = spread(left, right, bottom, top)
            box, box_x, box_y = spread(x0, x1, y0, y1)
            place = np.concatenate([group[some][cell], group[box]])
            for x in (np.concatenate([cell_x, box_x]), np.concatenate([cell_y, box_y])):
                code = np.unique(x, return_inverse=True)[1]
                place = np.unique(place * (int(code.max()) + 1) + code, return_inverse=True)[1]
            of_cell, of_box = place[: len(cell)], place[len(cell) :]
            order = np.argsort(of_box, kind="stable")
            first, end = (np.searchsorted(of_box[order], of_cell, side) for side in ("left", "right"))
            crossed, held = np.zeros(len(some), bool), []
            # a share of the pairs at a time
            share = np.cumsum(end - first) // PAIRS
            for these in np.split(np.arange(len(cell)), np.flatnonzero(np.diff(share)) + 1):
                k, near = _steps(first[these], end[these] - 1)
                k, b = these[k], box[order[near]]
                c = cell[k]
                # a pair meets in several buckets and counts in that of the lower corner of what they share
                here = (at(np.maximum(x0[b], left[c]), across) == cell_x[k]) & (at(np.maximum(y0[b], bottom[c]), along) == cell_y[k])
                touches = (y0[b] < top[c]) & (y1[b] > bottom[c]) & (x0[b] < right[c]) & (x1[b] > left[c]) & (y0[b] > bottom[c])
                inside = (x0[b] >= left[c]) & (x1[b] <= right[c]) & (y1[b] < top[c])
                crossed[c[here & touches & ~inside]] = True
                held.append((c[here & touches & inside], b[here & touches & inside]))
            c, b = (np.concatenate(x) for x in zip(*held, strict=True))
            if not len(c):
                continue
            # boxes of one id are one item
            ids = page["id"].combine_chunks()
            code = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
            pair = np.unique(c * (int(code.max()) + 1) + code[b], return_index=True)[1]
            c, b = c[pair], b[pair]
            known = ids.is_valid().to_numpy(zero_copy_only=False)[b]
            owner = np.unique(group[b] * (int(code.max()) + 1) + code[b], return_inverse=True)[1]
            n = np.bincount(c, minlength=len(some))
            good = (n > 0) & ~crossed & (np.bincount(c, (np.bincount(owner)[owner] > 1) & known, len(some)) == 0)
            named = good[c] & known
            listed = np.bincount(c[named], minlength=len(some))[good]
            # pairs lie by cell
            items = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(listed)]), pa.int32()), ids.take(pa.array(b[named])))
            columns = [page[k].combine_chunks().take(pa.array(some[good])) for k in key]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x[good]) for x in (left, right, bottom, top)), pa.array(n[good]), items], names=names)

    names = [*key, *_PLACE, "n_items", "items"]
    out = _with(StructType([boxes.schema[c] for c in key]), **dict.fromkeys(_PLACE, "double"), n_items="long").add("items", ArrayType(boxes.schema["id"].dataType))
    return boxes.mapInArrow(walk, out).withColumn("items", F.array_sort("items"))


def grid_cells(boxes: DataFrame, rules: DataFrame, key: list[str], width: float) -> DataFrame:
    """``key, left, right, bottom, top, n_items, items``: the cells between ruling lines that own boxes.

    ``boxes`` have ``key, id, x0, x1, y0, y1``; ``rules`` ``key, rule, x0, x1, y0, y1, ink``, upright or level lines of a thickness
    that reaches ``ink`` beyond them.  A box lies in the cell of the nearest level lines above and below it that pass over its whole width, and
    of the nearest upright ones that pass from one of these to the other; the level ones must reach both.  A cell owns the boxes inside it.  One
    that a box crosses, or that shares a box with another cell, is no cell: a part of a text gains no owner.  ``items`` are sorted.
    ``width`` is the bucket of all comparisons, about the width of a cell.

    Boxes and lines are dealt once, by page, where a page has at most ``PAGE`` of both; a larger one is dealt by buckets, once for each comparison.
    """
    double = lambda c: c.cast("double")

    def lines(df: DataFrame, along: str, across: str) -> DataFrame:
        a, b, ink, at = F.col(f"{along}0"), F.col(f"{along}1"), F.col("ink"), F.col(f"{across}0")
        columns = {"_low": F.least(a, b) - ink, "_high": F.greatest(a, b) + ink, "_from": at, "_to": at, "_edge_from": at + ink, "_edge_to": at - ink}
        found = df.select(*key, F.col("rule").cast("long").alias("_id"), *[double(c).alias(n) for n, c in columns.items()])
        return found.where("_low <= _high AND _edge_to IS NOT NULL")

    own = boxes.select(*key, "id", *_NUMBERS).dropna(subset=key)
    level, upright = lines(rules.where(F.col("y0") == F.col("y1")), "x", "y"), lines(rules.where(F.col("x0") == F.col("x1")), "y", "x")
    rows = reduce(DataFrame.unionAll, [df.select(*key) for df in (own, level, upright)])
    crowded = rows.dropna(subset=key).groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > PAGE).drop("_n").collect()

    def paged(own: DataFrame, level: DataFrame, upright: DataFrame) -> DataFrame:
        numbers = own.select(*key, "id", *[double(F.col(c)).alias(c) for c in _NUMBERS]).where(" AND ".join(f"{c} IS NOT NULL" for c in _NUMBERS))
        both = numbers.withColumn("_kind", F.lit(2).cast("byte"))
        for kind, ruled in enumerate((level, upright)):
            more = ruled.dropna(subset=key).select(
                *key, F.col("_id").alias("_rule"), "_low", "_high", F.col("_from").alias("_at"), "_edge_from", "_edge_to", F.lit(kind).cast("byte").alias("_kind")
            )
            both = both.unionByName(more, allowMissingColumns=True)
        dealt = both.withColumn("_place", F.xxhash64(*key)).repartition(*key).sortWithinPartitions("_place")
        return _boxes_of_cells(_cells_of_boxes(dealt, key, width), key, width)

    if not crowded:
        return paged(own, level, upright)
    full = F.broadcast(own.sparkSession.createDataFrame(crowded, StructType([own.schema[c] for c in key])))
    few, many = ([df.join(full, key, how) for df in (own, level, upright)] for how in ("left_anti", "left_semi"))
    return paged(*few).unionByName(_bucketed_cells(*many, key, width))


def _bucketed_cells(own: DataFrame, level: DataFrame, upright: DataFrame, key: list[str], width: float) -> DataFrame:
    """``grid_cells`` of pages that are too large for one task: a task holds the lines of one page and bucket."""
    double = lambda c: c.cast("double")
    ends = {"_low": "x0", "_high": "x1", "_from": "y0", "_to": "y1"}
    asked = own.select(*key, *[double(F.col(c)).alias(n) for n, c in ends.items()]).dropna(subset=[*ends])
    held = _covers(asked, level, key, width, ("bottom", "top")).select(
        *key, F.col("bottom_at").alias("_low"), F.col("top_at").alias("_high"), F.col("_low").alias("_from"), F.col("_high").alias("_to"),
        F.greatest("bottom_low", "top_low").alias("_least"), F.least("bottom_high", "top_high").alias("_most"),
    )
    sides = _covers(held, upright, key, width, ("left", "right")).where("_least <= left_at AND _most >= right_at")
    cells = sides.select(*key, F.col("left_at").alias("left"), F.col("right_at").alias("right"), F.col("_low").alias("bottom"), F.col("_high").alias("top")).distinct()

    at = lambda c: F.floor((F.col(c) if isinstance(c, str) else c) / width).cast("long")
    spread = lambda df, x0, x1, y0, y1: df.withColumn("_cx", F.explode(F.sequence(at(x0), at(x1)))).withColumn(
        "_cy", F.explode(F.sequence(at(y0), at(y1)))
    )
    # sorted and joined by one number, which is cheaper than by the keys; these decide
    meeting = lambda df: df.withColumn("_place", F.xxhash64(*key, "_cx", "_cy"))
    theirs = {c: f"_of_{c}" for c in (*key, "_cx", "_cy")}
    around = meeting(spread(cells, "left", "right", "bottom", "top")).withColumnsRenamed(theirs)
    met = around.join(meeting(spread(own, "x0", "x1", "y0", "y1")), "_place").where(reduce(and_, [F.col(c) == F.col(n) for c, n in theirs.items()]))
    touches = (F.col("y0") < F.col("top")) & (F.col("y1") > F.col("bottom")) & (F.col("x0") < F.col("right")) & (F.col("x1") > F.col("left"))
    starts_within = (F.col("y0") > F.col("bottom")) & (F.col("y0") < F.col("top")) & (F.col("x0") < F.col("right")) & (F.col("x1") > F.col("left"))
    inside = (F.col("x0") >= F.col("left")) & (F.col("x1") <= F.col("right")) & (F.col("y0") > F.col("bottom")) & (F.col("y1") < F.col("top"))
    place = ["left", "right", "bottom", "top"]
    # a pair meets in several buckets and counts in that of the lower corner of what they share
    here = (at(F.greatest("x0", "left")) == F.col("_cx")) & (at(F.greatest("y0", "bottom")) == F.col("_cy"))
    pairs = met.where(touches & (inside | starts_within) & here).select(*key, *place, "id", inside.alias("inside"))
    pairs = pairs.repartition(*key, "id").distinct().withColumn("_cells", F.count_if("inside").over(Window.partitionBy(*key, "id")))
    bad = ~F.col("inside") | ((F.col("_cells") > 1) & F.col("id").isNotNull())
    owned = pairs.groupBy(*key, *place).agg(F.bool_or(bad).alias("_bad"), F.count("*").alias("n_items"), F.array_sort(F.collect_list("id")).alias("items"))
    return owned.where(~F.col("_bad")).drop("_bad")
