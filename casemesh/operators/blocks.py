"""What one task does with a bounded slice of queries and a bounded block of the index.

Slices and blocks arrive as Arrow tables; a matrix product compares them, and only what
the join asked for leaves the task.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Distances are compared at this resolution, so that the order of summation inside a
# matrix product cannot change which of two equally near cases comes first.
DECIMALS = 9
# Adding COARSE to a number near zero rounds it to multiples of GRID, about 1e-9.
GRID = 2.0**-30
COARSE = 1.5 * 2.0**52 * GRID
# Distances held at once inside a task.
STRIP_CELLS = 1 << 21
# Lengths of vectors up to which squares are safe in single precision, and candidates for each of
# the nearest that single precision may leave.
SINGLE_LIMIT = 1e15
CANDIDATES = 16
# Slack of a limit on unsquared distances, far above rounding noise.
LIMIT_SLACK = 1e-6


def matrix_of(column, metric: str, side: str) -> np.ndarray:
    """An Arrow list column as a matrix of doubles.

    For ``cosine`` the rows are scaled to length one and two coordinates are added, which
    put zero vectors at right angles to everything. Half the squared distance is then
    ``1 - cos`` for every pair, so both metrics obey the same geometry.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = len(column)
    if rows == 0:
        return np.zeros((0, 1))
    widths = pc.unique(pc.list_value_length(column)).to_pylist()
    if len(widths) > 1 or None in widths:
        raise ValueError(f"vectors must have one width, found {sorted(map(str, widths))}")
    if column.flatten().null_count:
        raise ValueError("vectors must not hold nulls")
    matrix = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = matrix.reshape(rows, -1)
    if metric == "cosine":
        length = np.sqrt((matrix * matrix).sum(axis=1))
        zero = length == 0.0
        matrix = matrix / np.where(zero, 1.0, length)[:, None]
        extra = np.zeros((rows, 2))
        extra[zero, 0 if side == "query" else 1] = 1.0
        matrix = np.hstack([matrix, extra])
    return matrix


def square_distances(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    squares = (queries * queries).sum(axis=1)[:, None] + (points * points).sum(axis=1)[None, :]
    return np.maximum(squares - 2.0 * (queries @ points.T), 0.0)


def strips_of(rows: int, points: int):
    """Row ranges of a slice that keep a strip of the distance matrix small."""
    step = max(16, STRIP_CELLS // max(points, 1))
    return [slice(at, min(at + step, rows)) for at in range(0, rows, step)]


def _prepared(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What all queries share: the transposed points times -2, and their squared lengths."""
    return np.ascontiguousarray(-2.0 * points.T), (points * points).sum(axis=1)


def _scale(metric: str) -> float:
    """Squared distances per unit of reported distance."""
    return 2.0 if metric == "cosine" else 1.0


def _exact(queries, points, query, entry, metric: str) -> np.ndarray:
    """Distances of chosen pairs from the differences of their coordinates."""
    found = np.empty(len(query))
    step = max(1, STRIP_CELLS // max(points.shape[1], 1))
    for at in range(0, len(query), step):
        gap = queries[query[at : at + step]] - points[entry[at : at + step]]
        found[at : at + step] = (gap * gap).sum(axis=1)
    return np.round(found / _scale(metric), DECIMALS)


def _nearest(queries: np.ndarray, prepared, depth: int, open_to) -> tuple[np.ndarray, np.ndarray]:
    """``(query, entry)`` of the ``depth`` nearest of each query, and of what is as near as the last."""
    turned, squares = prepared()
    near = queries @ turned
    near += squares
    # At this magnitude a double only resolves GRID: nearly equal distances become
    # equal, and the first of them is taken whatever the product's rounding.
    near += COARSE
    if open_to is not None:
        near[~open_to] = np.inf
    rows, last, parts = np.arange(len(near)), np.full(len(near), -np.inf), []
    for _ in range(depth):
        best = near.argmin(axis=1)
        there = near[rows, best] < np.inf
        parts.append((rows[there], best[there]))
        last = np.where(there, near[rows, best], last)
        near[rows, best] = np.inf
    # The product rounds: what lies within two steps of the last one is compared too.
    parts.append(_places(near <= (last + 2 * GRID)[:, None]))
    return tuple(np.concatenate(column) for column in zip(*parts))


def _single_precision(queries: np.ndarray, points: np.ndarray, squares: np.ndarray):
    """Both sides for one product in single precision that gives the squared distances less the
    queries' own squares, and by how much it may be wrong for each query. None where numbers
    are too large for it."""
    length = np.sqrt((queries * queries).sum(axis=1))
    longest = np.sqrt(squares.max())
    if not max(length.max(), longest) < SINGLE_LIMIT:
        return None
    left = np.empty((len(queries), queries.shape[1] + 1), dtype=np.float32)
    left[:, :-1], left[:, -1] = queries, 1.0
    right = np.empty((left.shape[1], len(points)), dtype=np.float32)
    right[:-1], right[-1] = -2.0 * points.T, squares
    wrong = (left.shape[1] + 8) * 2.0**-24 * (2.0 * length * longest + longest**2) + 1e-30
    return left, right, wrong


def _nearest_coarsely(queries, strip: slice, prepared, single, depth: int, open_to, beyond):
    """``_nearest`` from a product in single precision: what by its error may be among the
    nearest, so that exact distances decide. ``beyond`` is where entries of each query stop
    to count. Queries with many candidates are compared in double precision."""
    left, right, wrong = single
    near = left[strip] @ right
    wrong = wrong[strip]
    if open_to is not None:
        near[~open_to] = np.inf
    limit = np.full(len(near), np.inf)
    if beyond is not None:
        limit = beyond + wrong
    # Where no limit is known, or a wide one, the last of the nearest is one.
    crowded = np.arange(len(near))
    within = near <= _upwards(limit)[:, None] if np.isfinite(limit).all() else None
    if within is not None:
        crowded = np.flatnonzero(np.count_nonzero(within, axis=1) > CANDIDATES * depth)
    if len(crowded):
        part = near[crowded] if len(crowded) < len(near) else near
        rows, last, taken = np.arange(len(part)), np.full(len(part), -np.inf), []
        for _ in range(depth):
            best = part.argmin(axis=1)
            value = part[rows, best]
            last = np.where(value < np.inf, value, last)
            taken.append((best, value))
            part[rows, best] = np.inf
        for best, value in reversed(taken):
            part[rows, best] = value
        own = np.minimum(limit[crowded], last + 2.0 * wrong[crowded] + 2 * GRID)
        closer = part <= _upwards(own)[:, None]
        closer &= part < np.inf
        many = np.flatnonzero(np.count_nonzero(closer, axis=1) > CANDIDATES * depth)
        closer[many] = False
        row, entry = _places(closer)
        parts = [(crowded[row], entry)]
        if len(many):
            many = crowded[many]
            shown = open_to[many] if open_to is not None else None
            row, entry = _nearest(queries[strip][many], prepared, depth, shown)
            parts.append((many[row], entry))
        if within is not None:
            within[crowded] = False
            parts.append(_places(within))
        return tuple(np.concatenate(column) for column in zip(*parts))
    return _places(within)


def _places(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of what is marked: ``np.nonzero``, faster where that is little."""
    return np.divmod(np.flatnonzero(marked), marked.shape[1])


def _upwards(limit: np.ndarray) -> np.ndarray:
    """In single precision, and not below ``limit``."""
    return np.nextafter(limit.astype(np.float32), np.float32(np.inf))


def _within(queries: np.ndarray, prepared, limit: float, metric: str):
    """For a strip of queries: which entries are, at the stated resolution, within the limit."""
    turned, squares = prepared
    partial = queries @ turned
    partial += squares
    own = (queries * queries).sum(axis=1)
    reach = (limit + 0.5 * 10.0**-DECIMALS) * _scale(metric) - own
    return partial <= reach[:, None]


def _single_ids(block: pa.Table):
    """The ids of a block whose entries have one id each."""
    return block["ids"].combine_chunks().flatten()


def k_nearest_in_block(metric: str, k: int, exclude_self: bool):
    """Compares one slice with one block; emits the k best of each query, already ranked.

    Queries are known by ``qkey`` where they have one, so that ids may repeat. ``seen`` says
    which groups of entries count for each query, ``group`` the group of each entry; nothing
    beyond ``limit``, the unsquared distance of each query's worst useful answer, is returned.
    """
    depth = k + 1 if exclude_self else k

    def compare(left: pa.Table, right: pa.Table, seen=None, group=None, limit=None) -> pa.Table:
        carried = [name for name in ("qkey", "qid") if name in left.schema.names]
        id_type = right.schema.field("ids").type.value_type
        schema = pa.schema(
            [(name, left.schema.field(name).type) for name in carried]
            + [("rank", pa.int32()), ("id", id_type), ("distance", pa.float64())]
        )
        if left.num_rows == 0 or right.num_rows == 0:
            return schema.empty_table()
        ids = right["ids"].combine_chunks()
        flat, offsets = ids.flatten(), ids.offsets.to_numpy()
        offsets = offsets - offsets[0]
        # Each distinct vector stands at the place of its smallest id, so that argmin,
        # which takes the first of equals, breaks ties by id.
        order = pc.sort_indices(flat).to_numpy()
        position = np.empty(len(flat), dtype=np.int64)
        position[order] = np.arange(len(flat))
        entries = np.argsort(position[offsets[:-1]], kind="stable")
        points = matrix_of(right["vec"], metric, "index")[entries]
        starts, counts = offsets[:-1][entries], np.diff(offsets)[entries]
        group = group[entries] if seen is not None else None
        qids = left["qid"].combine_chunks()
        keys = [left[name].combine_chunks() for name in carried]
        queries = matrix_of(left["vec"], metric, "query")

        depth_here = min(depth, len(points))
        squares = (points * points).sum(axis=1)
        single = _single_precision(queries, points, squares)
        prepared = functools.cache(lambda: (np.ascontiguousarray(-2.0 * points.T), squares))
        far = None
        if limit is not None:
            far = (limit + LIMIT_SLACK) ** 2 - (queries * queries).sum(axis=1)
        parts = []
        for strip in strips_of(len(queries), len(points)):
            open_to = seen[strip][:, group] if seen is not None else None
            if single is None:
                found = _nearest(queries[strip], prepared, depth_here, open_to)
            else:
                beyond = far[strip] if far is not None else None
                found = _nearest_coarsely(queries, strip, prepared, single, depth_here, open_to, beyond)
            parts.append((found[0] + strip.start, found[1]))
        query, entry = (np.concatenate(column) for column in zip(*parts))
        distance = _exact(queries, points, query, entry, metric)
        if limit is not None:
            useful = np.sqrt(distance * _scale(metric)) <= limit[query] + LIMIT_SLACK
            query, entry, distance = query[useful], entry[useful], distance[useful]

        # One row per id behind each chosen vector.
        times = counts[entry]
        within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        flat_at = np.repeat(starts[entry], times) + within
        query, distance = np.repeat(query, times), np.repeat(distance, times)
        if exclude_self:
            same = pc.equal(qids.take(pa.array(query)), flat.take(pa.array(flat_at)))
            same = same.to_numpy(zero_copy_only=False)
            query, distance, flat_at = query[~same], distance[~same], flat_at[~same]
        by = np.lexsort((position[flat_at], distance, query))
        query, distance, flat_at = query[by], distance[by], flat_at[by]
        first = np.searchsorted(query, query, side="left")
        rank = np.arange(len(query)) - first + 1
        keep = rank <= k
        return pa.table(
            [
                *[key.take(pa.array(query[keep])) for key in keys],
                pa.array(rank[keep].astype(np.int32)),
                flat.take(pa.array(flat_at[keep])),
                pa.array(distance[keep]),
            ],
            schema=schema,
        )

    return compare


def tightened(limit: np.ndarray, keys: np.ndarray, found: pa.Table, k: int, metric: str) -> np.ndarray:
    """``limit``, the unsquared distance beyond which nothing is useful to the queries with the
    sorted ``keys``, after ``found`` gave some of them their k-th."""
    last = pc.equal(found["rank"], k).to_numpy(zero_copy_only=False)
    at = np.searchsorted(keys, found["qkey"].to_numpy()[last])
    limit = limit.copy()
    limit[at] = np.minimum(limit[at], np.sqrt(found["distance"].to_numpy()[last] * _scale(metric)))
    return limit


def best_of(found: pa.Table, k: int) -> pa.Table:
    """The k best of every ``qkey`` among what several blocks gave, ranked again."""
    order = [(name, "ascending") for name in ("qkey", "distance", "id")]
    found = found.take(pc.sort_indices(found, order))
    keys = found["qkey"].to_numpy()
    rank = np.arange(len(keys)) - np.searchsorted(keys, keys, side="left") + 1
    at = found.schema.get_field_index("rank")
    found = found.set_column(at, found.schema.field(at), pa.array(rank.astype(np.int32)))
    return found.filter(pa.array(rank <= k))


def pairs_in_block(metric: str, limit: float):
    """The pairs of one slice and one block that are within the limit, smaller id first."""

    def compare(left: pa.Table, right: pa.Table, *_) -> pa.Table:
        kind = left.schema.field("qid").type
        schema = pa.schema([("a", kind), ("b", kind), ("distance", pa.float64())])
        if left.num_rows == 0 or right.num_rows == 0:
            return schema.empty_table()
        a, b = left["qid"].to_numpy(), _single_ids(right).to_numpy(zero_copy_only=False)
        queries = matrix_of(left["vec"], metric, "query")
        points = matrix_of(right["vec"], metric, "index")
        prepared = _prepared(points)
        parts = []
        for strip in strips_of(len(queries), len(points)):
            near = _within(queries[strip], prepared, limit, metric)
            rows, cols = np.nonzero(near)
            forward = a[rows + strip.start] < b[cols]
            rows, cols = rows[forward] + strip.start, cols[forward]
            parts.append((rows, cols, _exact(queries, points, rows, cols, metric)))
        rows, cols, distance = (np.concatenate(column) for column in zip(*parts))
        return pa.table(
            [
                left["qid"].combine_chunks().take(pa.array(rows)),
                _single_ids(right).take(pa.array(cols)),
                pa.array(distance),
            ],
            schema=schema,
        )

    return compare


def links_in_block(metric: str, limit: float):
    """Links that join the same rows into groups as all pairs of this block would.

    Every row of a group is linked to the smallest id of the group, so a slice and a block
    yield fewer links than they have rows, however many pairs are within the limit.
    """

    def compare(left: pa.Table, right: pa.Table, *_) -> pa.Table:
        kind = left.schema.field("qid").type
        schema = pa.schema([("a", kind), ("b", kind)])
        if left.num_rows == 0 or right.num_rows == 0:
            return schema.empty_table()
        a, b = left["qid"].to_numpy(), _single_ids(right).to_numpy(zero_copy_only=False)
        names = np.unique(np.concatenate([a, b]))
        of_a, of_b = np.searchsorted(names, a), np.searchsorted(names, b)
        queries = matrix_of(left["vec"], metric, "query")
        points = matrix_of(right["vec"], metric, "index")
        prepared = _prepared(points)
        ends = []
        for strip in strips_of(len(queries), len(points)):
            rows, cols = np.nonzero(_within(queries[strip], prepared, limit, metric))
            ends.append((of_a[rows + strip.start], of_b[cols]))
        one, other = (np.concatenate(column) for column in zip(*ends))
        group = np.arange(len(names))
        while True:
            least = np.minimum(group[one], group[other])
            settled = group.copy()
            for end in (one, other, group[one], group[other]):
                np.minimum.at(settled, end, least)
            settled = settled[settled]
            if np.array_equal(settled, group):
                break
            group = settled
        linked = np.flatnonzero(group != np.arange(len(names)))
        return pa.table(
            [pa.array(names[group[linked]], kind), pa.array(names[linked], kind)], schema=schema
        )

    return compare
