"""Products of blocks inside tasks: the best cosines of a block of vectors, matches of term sets, postings and the best scores of these.

Small numpy helpers for cogrouped Arrow tables; dealing the blocks and bringing
their results together is Spark's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cells of one slice of a product.
SLICE_CELLS = 1 << 23
#: How far a matrix product and a sum in order may be apart, and more.
MARGIN = 1e-8


def _by_length(column: pa.ChunkedArray) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """({length: (rows, matrix)}, rows that are null or hold a null) of a column of lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    ends = np.cumsum(sizes)
    holes = np.flatnonzero(flat.is_null().to_numpy(zero_copy_only=False)) if flat.null_count else np.zeros(0, np.int64)
    void = column.is_null().to_numpy(zero_copy_only=False).copy()
    void[np.searchsorted(ends, holes, side="right")] = True
    values = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
    found = {}
    for n in np.unique(sizes[~void]).tolist():
        rows = np.flatnonzero((sizes == n) & ~void)
        found[n] = (rows, values[(ends[rows] - n)[:, None] + np.arange(n)])
    return found, np.flatnonzero(void)


def _norms(matrix: np.ndarray) -> np.ndarray:
    """Lengths of the rows; squares are added in order, as a fold over the array does."""
    out = np.zeros(len(matrix))
    for i in range(matrix.shape[1]):
        out += matrix[:, i] * matrix[:, i]
    return np.sqrt(out)


def _dots(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> np.ndarray:
    """a[x] . b[y], added in order."""
    out = np.zeros(len(x))
    for i in range(a.shape[1]):
        out += a[x, i] * b[y, i]
    return out


def _first_copies(matrix: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Row numbers without those that equal ``k`` rows of smaller ids."""
    _, same = np.unique(_keys(matrix), return_inverse=True)
    order = np.lexsort((ids, same))
    starts = np.flatnonzero(np.r_[True, np.diff(same[order]) != 0])
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return np.sort(order[place < k])


def _keys(matrix: np.ndarray) -> np.ndarray:
    """Rows as comparable bytes; the two zeros are one."""
    rows = np.ascontiguousarray(matrix + 0.0)
    return rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).reshape(-1)


def block_best(queries: pa.ChunkedArray, vectors: pa.ChunkedArray, ids: pa.ChunkedArray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, cosine) of pairs of ``least`` or more, among them the ``k`` best per query.

    Vectors without length, or with nulls, have cosine 0 with every vector;
    vectors of different lengths have none; one that is not finite has NaN, which
    counts as the largest.
    """
    asked, no_query = _by_length(queries)
    held, no_vector = _by_length(vectors)
    order = np.empty(len(ids), np.int64)
    order[pc.sort_indices(ids if not isinstance(ids, pa.ChunkedArray) else ids.combine_chunks(), null_placement="at_start").to_numpy()] = np.arange(len(ids))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    flat_q, flat_v = [no_query], [no_vector]
    with np.errstate(all="ignore"):
        for n, (rows, matrix) in held.items():
            flat_v.append(rows[~(_norms(matrix) > 0) & ~np.isnan(_norms(matrix))])
        for n, (rows, q) in asked.items():
            qn = _norms(q)
            flat_q.append(rows[~(qn > 0) & ~np.isnan(qn)])
            if n not in held or not n:
                continue
            where, v = held[n]
            vn = _norms(v)
            rows, q, qn = (x[(qn > 0) | np.isnan(qn)] for x in (rows, q, qn))
            some = (vn > 0) | np.isnan(vn)
            where, v, vn = where[some], v[some], vn[some]
            if not len(rows) or not len(where):
                continue
            first = _first_copies(v, order[where], k)
            where, v, vn = where[first], v[first], vn[first]
            units = np.ascontiguousarray((v / vn[:, None]).T)
            step = max(1, SLICE_CELLS // len(where))
            for at in range(0, len(rows), step):
                near = (q[at : at + step] / qn[at : at + step, None]) @ units
                near[~np.isfinite(near)] = np.inf
                if len(where) > k:
                    floor = np.maximum(np.partition(near, len(where) - k, axis=1)[:, len(where) - k], least) - MARGIN
                else:
                    floor = np.full(len(near), least - MARGIN)
                x, y = np.nonzero(near >= floor[:, None])
                for i in range(0, len(x), SLICE_CELLS):
                    a, b = x[i : i + SLICE_CELLS] + at, y[i : i + SLICE_CELLS]
                    score = _dots(q, a, v, b) / (qn[a] * vn[b])
                    kept = ~(score < least)
                    out.append((rows[a[kept]], where[b[kept]], score[kept]))
    if least <= 0:  # vectors without length have cosine 0 with all others: each query's first k of these are enough
        out += _flat(np.concatenate(flat_q), np.concatenate(flat_v), len(queries), order, k)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(parts) for parts in zip(*out, strict=True))


def _flat(flat_q: np.ndarray, flat_v: np.ndarray, n_queries: int, order: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of which one side has no length."""
    by_id = np.argsort(order)[:k]
    first = flat_v[np.argsort(order[flat_v])][:k]
    others = np.setdiff1d(np.arange(n_queries), flat_q)
    pairs = [(np.repeat(flat_q, len(by_id)), np.tile(by_id, len(flat_q))), (np.repeat(others, len(first)), np.tile(first, len(others)))]
    return [(x, y, np.zeros(len(x))) for x, y in pairs]


def block_matches(keys: pa.Array, terms: pa.Array, chunks: pa.Array, tokens: pa.Array, tags: pa.Array, least: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(key number, tag, chunks): how many of a block's chunks with a tag hold ``least`` or more of a key's terms.

    ``keys`` and ``terms`` (lists) are one row per key, the others one row per
    chunk; rows of the same chunk are one, and their tags count each.
    """
    asked = pc.list_parent_indices(terms).to_numpy()
    values = pc.unique(terms.flatten())
    wanted = pc.index_in(terms.flatten(), value_set=values).to_numpy().astype(np.int64)
    order = np.argsort(wanted, kind="stable")
    lists, first = asked[order], np.searchsorted(wanted[order], np.arange(len(values) + 1))
    codes = pc.dictionary_encode(chunks)
    number, n = codes.indices.to_numpy(), len(codes.dictionary)
    found = pc.index_in(tokens.flatten(), value_set=values)
    known = found.is_valid().to_numpy(zero_copy_only=False)
    # One posting per chunk and term.
    posts = np.unique(number[pc.list_parent_indices(tokens).to_numpy()[known]].astype(np.int64) * len(values) + found.drop_null().to_numpy())
    held, code = np.divmod(posts, max(len(values), 1))
    tagged = pc.dictionary_encode(tags.flatten(), null_encoding="encode")
    tag_of, n_tags = tagged.indices.to_numpy(), len(tagged.dictionary)
    owner = number[pc.list_parent_indices(tags).to_numpy()]
    # tags of a chunk, with repeats, as counts per kind of chunk: chunks of the same tags are added up at once
    profile = np.zeros((n, n_tags), np.int32)
    np.add.at(profile, (owner, tag_of), 1)
    kinds, kind = np.unique(profile, axis=0, return_inverse=True)
    total = np.zeros((len(keys), len(kinds)), np.int64)
    step = max(1, SLICE_CELLS // max(len(keys), 1))
    cuts = np.searchsorted(held, np.arange(0, n + step, step))
    sizes = np.diff(first)
    for i in range(len(cuts) - 1):
        a, b = cuts[i], cuts[i + 1]
        if a == b:
            continue
        many = sizes[code[a:b]]
        at = np.repeat(first[code[a:b]] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
        cell = np.repeat(held[a:b] - i * step, many) * len(keys) + lists[at]
        hit = np.flatnonzero(np.bincount(cell, minlength=step * len(keys)) >= least)
        chunk, key = np.divmod(hit, len(keys))
        total += np.bincount(key * len(kinds) + kind.reshape(-1)[chunk + i * step], minlength=total.size).reshape(total.shape)
    counts = total @ kinds.astype(np.int64)
    x, y = np.nonzero(counts)
    return x, tagged.dictionary.take(pa.array(y)), counts[x, y]


def pair_codes(terms: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """What ``block_postings`` looks ``terms`` up by: the words that they are or are made of, the term of each word (-1: none), pairs of words as sorted keys, and the term of each."""
    cuts = [(t[:i], t[i + 1 :], n) for n, t in enumerate(terms) for i, c in enumerate(t) if c == " "]
    number: dict[str, int] = {t: n for n, t in enumerate(terms)}
    for left, right, _ in cuts:
        number.setdefault(left, len(number))
        number.setdefault(right, len(number))
    word = np.full(len(number), -1, np.int64)
    word[: len(terms)] = np.arange(len(terms))
    keys = np.array([number[left] * len(number) + number[right] for left, right, _ in cuts], np.int64)
    order = np.argsort(keys)
    return pa.array(list(number), pa.string()), word, keys[order], np.array([n for _, _, n in cuts], np.int64)[order]


def block_postings(tokens: pa.Array, words: pa.Array, word: np.ndarray, pairs: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term number, times) of the terms of ``pair_codes`` among the words of each list and, where there are ``pairs``, its neighbouring words."""
    owner = pc.list_parent_indices(tokens).to_numpy().astype(np.int64)
    code = pc.fill_null(pc.index_in(tokens.flatten(), value_set=words), -1).to_numpy().astype(np.int64)
    one = np.flatnonzero(code >= 0)
    one = one[word[code[one]] >= 0]
    rows, terms = [owner[one]], [word[code[one]]]
    if len(pairs):
        two = np.flatnonzero((code[:-1] >= 0) & (code[1:] >= 0) & (owner[:-1] == owner[1:]))
        key = code[two] * len(words) + code[two + 1]
        at = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
        known = pairs[at] == key
        rows.append(owner[two[known]])
        terms.append(pair[at[known]])
    n = max(len(word), 1)
    posts, times = np.unique(np.concatenate(rows) * n + np.concatenate(terms), return_counts=True)
    return posts // n, posts % n, times


def _by_term(rows: tuple[np.ndarray, ...], n: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Columns sorted by the first one, a term number below ``n``, and where each term begins."""
    order = np.argsort(rows[0], kind="stable")
    return np.searchsorted(rows[0][order], np.arange(n + 1)), tuple(c[order] for c in rows[1:])


def _spread(first: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``terms``, row of its term) for all rows of each term."""
    many = first[terms + 1] - first[terms]
    return np.repeat(np.arange(len(terms)), many), np.repeat(first[terms] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())


def block_bm25(chunks: pa.Array, terms: np.ndarray, fields: np.ndarray, parts: np.ndarray, boosts: tuple, groups: tuple, strict: np.ndarray, loose: np.ndarray, n: int) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(query, chunk, score, strict) of a block's postings, one per row: among them the ``n`` best per query of the strict hits and of the loose ones.

    ``boosts(term, query, boost)`` and ``groups(term, query, group)`` are numbered
    from 0; a hit is strict (loose) with so many different groups of its query, 0
    for queries without.  The best field of a chunk counts.
    """
    codes = pc.dictionary_encode(chunks, null_encoding="encode")
    by_id = pc.sort_indices(codes.dictionary, null_placement="at_start")
    ids, place = codes.dictionary.take(by_id), np.empty(len(by_id), np.int64)
    place[by_id.to_numpy()] = np.arange(len(ids))
    number = place[codes.indices.to_numpy()]  # smaller ids have smaller numbers
    n_terms, n_queries = int(max(boosts[0].max(initial=-1), terms.max(initial=-1), groups[0].max(initial=-1))) + 1, len(strict)
    first, (query, boost) = _by_term(boosts, n_terms)
    g_first, (g_query, group) = _by_term(groups, n_terms)
    width = int(group.max(initial=0)) + 1
    order = np.argsort(number, kind="stable")
    number, terms, fields, parts = number[order], terms[order], fields[order], parts[order]
    # Slices hold whole chunks, and a bounded number of cells and of products.
    work = np.bincount(number, (first[terms + 1] - first[terms]).astype(np.float64), len(ids)).astype(np.int64)
    piece = (np.cumsum(work) - work) // SLICE_CELLS + np.arange(len(ids)) // max(1, SLICE_CELLS // max(n_queries, 1))
    starts = np.flatnonzero(np.r_[True, np.diff(piece) != 0]) if len(ids) else np.zeros(0, np.int64)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))]
    for low, high in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True):
        a, b = np.searchsorted(number, [low, high])
        shape, score = (high - low, n_queries), None
        for f in np.unique(fields[a:b]).tolist():
            own = a + np.flatnonzero(fields[a:b] == f)
            at, row = _spread(first, terms[own])
            cell = (number[own][at] - low) * n_queries + query[row]
            total = np.bincount(cell, parts[own][at] * boost[row], shape[0] * n_queries)
            missed = np.ones(len(total), bool)
            missed[cell] = False
            total[missed] = -np.inf
            score = total if score is None else np.maximum(score, total)
        at, row = _spread(g_first, terms[a:b])
        met = np.unique(((number[a:b][at] - low) * n_queries + g_query[row]) * width + group[row])
        held = np.bincount(met // width, minlength=shape[0] * n_queries).reshape(shape)
        score = score.reshape(shape)
        hit, full = (score > -np.inf) & (held >= loose), held >= strict
        for kind in (True, False):
            near = np.where(hit & (full == kind), score, -np.inf)
            least = np.partition(near, len(near) - n, axis=0)[len(near) - n] if len(near) > n else np.full(n_queries, -np.inf)
            # Scores equal to nine digits tie.
            x, y = np.nonzero((near > -np.inf) & (near >= least - 2e-9))
            s = near[x, y]
            best = np.lexsort((x, -s, y))
            x, y, s = x[best], y[best], s[best]
            fresh = np.flatnonzero(np.r_[True, (np.diff(y) != 0) | (np.diff(s) != 0)]) if len(x) else np.zeros(0, np.int64)
            # Of equal scores the first n ids are enough.
            kept = np.arange(len(x)) - np.repeat(fresh, np.diff(np.r_[fresh, len(x)])) < n
            out.append((y[kept], x[kept] + low, s[kept], np.full(int(kept.sum()), kind)))
    q, c, s, kind = (np.concatenate(x) for x in zip(*out, strict=True))
    return q, ids.take(pa.array(c)), s, kind
