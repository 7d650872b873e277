"""Self-join of documents on the Jaccard similarity of their word shingles, exact, by partitioning the universe.

1. *Profiles.* Every document's set of hashed shingles gives its size, a 128-bit fingerprint and an odd sketch: the
   parities of the set over buckets, whose Hamming distance never exceeds the sets' difference. Equal sets are one node.
2. *Segments.* Sizes fall into bands of ratio 4/3, so similar sets lie in one band or in neighbours. In the scheme of a
   band with largest size u, similar sets differ by at most H = 2u/7 shingles. The universe is hashed into m = H + 1 + c
   segments; two similar sets then agree in at least 1 + c of them.
3. *Allocation.* An empty segment is the most expensive one to look up and gets no budget (0); others get 1, an exact
   look-up. Of the c spare look-ups that a set has left it gives up those with the longest postings, counted over all sets:
   a passage that many texts share is not looked up as long as the rest of a text suffices. A set with more than c empty
   segments raises its segments of two or more shingles to 2: their one-deletion neighbourhoods are indexed too, which
   finds every set that differs there by one shingle. If even that leaves the sum of budgets below H + 1, the set goes on
   to a next, independently hashed universe. A pair is found as soon as the look-ups of one of its sets suffice, since both
   index what the other looks up.
4. *Postings.* Signatures meet in hash buckets as packed blocks; those of one set alone are dropped there.
5. *Verification.* Each posting links its members to its smallest one; candidates that pass size and sketch are verified on
   the whole sets, and links are joined into components. Postings that still span several components are put together by
   their smallest member and cut into cells of bounded bytes, each with its members' sketches. Inside a cell, pairs across
   components of which one looks the other up are compared, and those leave it that would join components, the closest
   first, a forest: fewer than the members. They are verified. Then all pairs leave that are still across components and
   that the sketch can't tell from links: its buckets are at least four times the set's size, so these are links, or pairs
   that miss the similarity by little.

No group emits all its pairs.

Defined cases: texts without words have no shingles and link with nothing; each row is judged by its own text, rows that
share a doc_id too; a null doc_id names no component, but its text links others; repeated rows are equal sets; an empty table
gives an empty table; extra columns are not read. Shingles and sets are told apart by hashes of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keydrift.llm import shingles, tables
from keydrift.llm.shingles import U, mixed

WORDS = 5
#: The similarity as a fraction of whole numbers.
SIMILAR = (75, 100)
#: Members, and shingles of members, of a block; a cell holds one or two blocks of one group.
GROUP = 1000
BLOCK_SHINGLES = 1 << 20
#: Members of a posting that is no cost to look up.
SHORT = 8
#: Pairs of a cell from which it is compared as a whole; the result is the same.
LARGE = 20_000
#: Pairs that are held in memory at a time while a task compares sketches.
PAIRS = 500_000
#: Signatures of a bucket, and those that a task holds before it packs them.
BUCKET = 2_000_000
PACKED = 500_000
#: Identifiers that may be broadcast: 8 bytes each.
SENT = 500_000
SEED = [U(0), *(mixed(np.arange(1, 65, dtype=np.uint64) * U(0xD6E8FEB86659FD93)))]
KIND_DELETION = U(0xA0761D6478BD642F)
OF_SEGMENT, OF_SCHEME, OF_SEED, OF_CONTENT = U(0xE7037ED1A0B428DB), U(0x8EBC6AF09C88C6E3), U(0x589965CC75374CC3), U(0x1D8E4E27C47D124F)


def bands(largest: int) -> np.ndarray:
    """The largest size of each band; a set of size n pairs with sizes up to 4n/3 only."""
    out = [3]
    while out[-1] < largest or len(out) < 2:
        out.append(out[-1] * 4 // 3)
    out.append(out[-1] * 4 // 3)
    return np.array(out, np.int64)


class Schemes:
    """Sizes, differences, spare segments and segments by band."""

    def __init__(self, largest: int):
        self.top = bands(largest)
        self.differ = 2 * self.top // 7
        self.spare = self.differ // 4 + 1
        self.segments = self.differ + 1 + self.spare


def odd_sketch(h: np.ndarray) -> bytes:
    """Parities of a set over a power of two of buckets, at least four times its size and 64."""
    size = max(64, 1 << (4 * max(1, len(h)) - 1).bit_length())
    at = (mixed(h + OF_CONTENT) & U(size - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=size).astype(np.uint8) & 1, bitorder="little").tobytes()


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) of a smaller size: parities of merged buckets."""
    while sketch.shape[-1] > size:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def node_of(sets: list[np.ndarray]) -> np.ndarray:
    """A set's identifier: a hash of its size, its sum and the sum of its shingles otherwise hashed."""
    one = np.array([mixed(x + OF_SEED).sum(dtype=np.uint64) for x in sets], np.uint64)
    two = np.array([mixed(x + OF_SCHEME).sum(dtype=np.uint64) for x in sets], np.uint64)
    return mixed(one ^ mixed(two + np.array([len(x) for x in sets], np.uint64))).view(np.int64)


def named(ids: pa.Array, sets: list[np.ndarray]) -> np.ndarray:
    """What sets are known by in postings: a doc_id that is one set's alone, which packs well, or a negative hash."""
    hashes = (node_of(sets).view(np.uint64) >> U(1)).astype(np.int64)
    return np.where(ids.is_null().to_numpy(zero_copy_only=False), -1 - hashes, ids.fill_null(0).to_numpy())


def _cut(h: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    return np.split(h, np.cumsum(n)[:-1])


def allowances(h: np.ndarray, n: np.ndarray, schemes: Schemes) -> np.ndarray:
    """Look-ups that each set can do without in the scheme of even and of odd number: spare segments less empty ones."""
    out = np.zeros((2, len(n)), np.int64)
    band, owner = np.searchsorted(schemes.top, n), np.repeat(np.arange(len(n)), n)
    for up in (0, 1):
        scheme = band + up
        seg = ((h >> U(32)) * schemes.segments[scheme[owner]].astype(np.uint64)) >> U(32)
        new = np.ones(len(h), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (seg[1:] != seg[:-1])
        empty = schemes.segments[scheme] - np.bincount(owner[new], minlength=len(n))
        out[scheme & 1, np.arange(len(n))] = np.maximum(schemes.spare[scheme] - empty, 0)
    return out


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, nodes, odd, less = [], [], [], []
        for _, _, data, offsets in shingles.slices(batch.column("text")):
            h, n = shingles.shingle_sets(data, offsets, WORDS)
            parts = _cut(h, n)
            nodes.append(node_of(parts))
            odd += [odd_sketch(part) if len(part) else b"" for part in parts]
            less.append(allowances(h, n, Schemes(int(n.max(initial=0)))))
            sizes.append(n)
        n, node, less = (np.concatenate(x, axis=-1) for x in (sizes, nodes, less))
        arrays = [batch.column("doc_id"), batch.column("key"), pa.array(node), pa.array(n, pa.int64()), *map(pa.array, less), pa.array(odd, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "key", "node", "n", "less0", "less1", "odd"])


def _content(h: np.ndarray) -> np.ndarray:
    return mixed(h ^ OF_CONTENT)


def _signature(content: np.ndarray, segment: np.ndarray, scheme: np.ndarray, seed: int, kind: np.uint64 = U(0)) -> np.ndarray:
    """A hash; its last bit tells the schemes apart that a set may be in, which follow each other."""
    return mixed(content + segment * OF_SEGMENT + scheme * OF_SCHEME + U(seed) * OF_SEED + kind) & ~U(1) | scheme & U(1)


def signatures(h: np.ndarray, n: np.ndarray, schemes: Schemes) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets laid one after the other, and the index of the set of each."""
    band = np.searchsorted(schemes.top, n)
    owner = np.repeat(np.arange(len(n)), n)
    found, of = [], []
    for up in (0, 1):
        scheme = band + up
        used = (n > 0) & (schemes.differ[scheme] > 0) & ((n * 4 // 3 > schemes.top[band]) if up else True)
        take = used[owner]
        x, o = h[take], owner[take]
        if not len(x):
            continue
        seg = ((x >> U(32)) * schemes.segments[scheme[o]].astype(np.uint64)) >> U(32)
        new = np.ones(len(x), bool)
        new[1:] = (o[1:] != o[:-1]) | (seg[1:] != seg[:-1])
        at = np.flatnonzero(new)
        content = np.add.reduceat(_content(x), at)
        whose = o[at]
        found.append(_signature(content, seg[at], scheme[whose].astype(np.uint64), 0))
        of.append(whose)
        empty = schemes.segments[scheme] - np.bincount(whose, minlength=len(n))
        ends = np.cumsum(n)
        for k in np.flatnonzero(used & (empty > schemes.spare[scheme])):
            more = _raised(h[ends[k] - n[k] : ends[k]], int(scheme[k]), schemes)
            found.append(more)
            of.append(np.full(len(more), k))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(of)


def _raised(h: np.ndarray, scheme: int, schemes: Schemes) -> np.ndarray:
    """What a set with too many empty segments indexes besides the exact segments of the first universe."""
    m, need, out = int(schemes.segments[scheme]), int(schemes.differ[scheme]) + 1, []
    s = np.array([scheme], np.uint64)
    for seed, salt in enumerate(SEED):
        x = h if seed == 0 else np.sort(mixed(h ^ salt))
        seg = ((x >> U(32)) * U(m)) >> U(32)
        at = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
        size = np.diff(np.r_[at, len(x)])
        each = _content(x)
        content = np.add.reduceat(each, at)
        if seed:
            out.append(_signature(content, seg[at], s, seed))
        if m - len(at) <= schemes.spare[scheme]:
            break
        out.append(_signature(content, seg[at], s, seed, KIND_DELETION))
        less = (np.repeat(content, size) - each)[np.repeat(size, size) > 1]
        out.append(_signature(less, seg[np.repeat(size, size) > 1], s, seed, KIND_DELETION))
        if len(at) + (size > 1).sum() >= need:
            break
    return np.concatenate(out)


def _packed(sigs: np.ndarray, ids: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A row for each bucket: six bytes of each signature, and differences of the identifiers, both by byte planes."""
    bucket = ((sigs >> U(32)) * U(buckets)) >> U(32)
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    bucket, sigs, ids = bucket[order].astype(np.int64), sigs[order], ids[order]
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    a, b = [], []
    for start, end in zip(at, np.r_[at[1:], len(bucket)], strict=True) if len(at) else []:
        a.append(sigs[start:end].view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
        b.append(np.diff(ids[start:end], prepend=0).view(np.uint8).reshape(-1, 8).T.tobytes())
    return pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["bucket", "sigs", "ids"])


def _unpacked(sigs: bytes, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(sigs) // 6
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :6] = np.frombuffer(sigs, np.uint8).reshape(n, 6)
    deltas = np.ascontiguousarray(np.frombuffer(ids, np.uint8).reshape(8, n).T).view(np.int64).ravel()
    return wide.view(np.int64).ravel(), np.cumsum(deltas)


def _indexed(largest: int, buckets: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schemes, waiting, size = Schemes(largest), [], 0
        for batch in batches:
            for a, b, data, offsets in shingles.slices(batch.column("text")):
                h, n = shingles.shingle_sets(data, offsets, WORDS)
                sigs, of = signatures(h, n, schemes)
                waiting.append((sigs, named(batch.column("name")[a:b], _cut(h, n))[of]))
                size += len(sigs)
                if size >= PACKED:
                    yield _packed(np.concatenate([s for s, _ in waiting]), np.concatenate([i for _, i in waiting]), buckets)
                    waiting, size = [], 0
        if size:
            yield _packed(np.concatenate([s for s, _ in waiting]), np.concatenate([i for _, i in waiting]), buckets)

    return index


def _grouped(table: pa.Table) -> pa.Table:
    """The signatures of a bucket that several sets have: (sig, side, id, first, g); side is the scheme's parity, first the
    smallest id of the g that have the signature."""
    bucket = table.column("bucket")[0].as_py()
    parts = [_unpacked(s.as_py(), i.as_py()) for s, i in zip(table.column("sigs"), table.column("ids"), strict=True)]
    sigs, ids = np.concatenate([s for s, _ in parts]), np.concatenate([i for _, i in parts])
    del parts
    order = np.argsort(sigs, kind="stable")
    sigs = sigs[order]
    twin = np.zeros(len(sigs), bool)
    twin[1:] |= sigs[1:] == sigs[:-1]
    twin[:-1] |= sigs[1:] == sigs[:-1]
    sigs, ids = sigs[twin], ids[order[twin]]
    del order, twin
    order = np.lexsort((ids, sigs))
    sigs, ids = sigs[order], ids[order]
    if len(sigs):
        new = np.r_[True, (sigs[1:] != sigs[:-1]) | (ids[1:] != ids[:-1])]
        sigs, ids = sigs[new], ids[new]
    at = np.flatnonzero(np.r_[True, sigs[1:] != sigs[:-1]]) if len(sigs) else np.zeros(0, np.int64)
    size = np.diff(np.r_[at, len(sigs)])
    first, several = np.repeat(ids[at], size), np.repeat(size, size) > 1
    # a signature is told apart from those of other buckets by the bucket's number
    named = mixed(sigs.view(np.uint64) + np.full(len(sigs), bucket, np.uint64) * OF_SEED).view(np.int64)
    side = (sigs & 1).astype(np.int32)
    return pa.table({"sig": named[several], "side": side[several], "id": ids[several], "first": first[several], "g": np.repeat(size, size)[several]})


def _fits(na: np.ndarray, nb: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes may be similar at this least difference."""
    p, q = SIMILAR
    both = na + nb
    return (q * np.minimum(na, nb) >= p * np.maximum(na, nb)) & ((p + q) * distance <= (q - p) * both)


def _sieved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("odd_a", "odd_b")), strict=True)
        distance = []
        for a, b in rows:
            x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            size = min(len(x), len(y))
            distance.append(int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()))
        na, nb = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
        keep = pa.array(_fits(na, nb, np.array(distance, np.int64)))
        yield batch.select(["a", "b"]).filter(keep)


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (len(x) + len(y) - both)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = zip(batch.column("set_a"), batch.column("set_b"), strict=True)
        keep = [_similar(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)) for a, b in sets]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in shingles.slices(batch.column("text")):
            parts = _cut(*shingles.shingle_sets(data, offsets, WORDS))
            ids = named(batch.column("name")[a:b], parts)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([x.tobytes() for x in parts], pa.binary())], ["id", "set"])


def _distances(odd: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch distances of pairs of sets, by index, the larger sketch folded to the smaller one's size."""
    words = np.array([len(o) for o in odd], np.int64) // 8
    least, out = np.minimum(words[a], words[b]), np.zeros(len(a), np.int64)
    for size in np.unique(least).tolist():
        at = np.flatnonzero(least == size)
        used, where = np.unique(np.concatenate([a[at], b[at]]), return_inverse=True)
        m = np.stack([folded(np.frombuffer(odd[k], np.uint64), size) for k in used])
        step = max(1, PAIRS // size)
        for k in range(0, len(at), step):
            x, y = where[: len(at)][k : k + step], where[len(at) :][k : k + step]
            out[at[k : k + step]] = np.bitwise_count(m[x] ^ m[y]).sum(axis=1, dtype=np.int64)
    return out


def _pairs(start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows inside runs of rows, about ``PAIRS`` at a time."""
    shape: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    p, q, waiting = [], [], 0
    for at, g in zip(start.tolist(), size.tolist(), strict=True):
        if g not in shape:
            shape[g] = np.triu_indices(g, 1)
        p.append(shape[g][0] + at)
        q.append(shape[g][1] + at)
        waiting += len(shape[g][0])
        if waiting >= PAIRS:
            yield np.concatenate(p), np.concatenate(q)
            p, q, waiting = [], [], 0
    if p:
        yield np.concatenate(p), np.concatenate(q)


def _cell_pairs(who: np.ndarray, looks: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a large cell's members of which one looks a run's signature up, each once however many runs have it: runs
    are marked in a table of the cell's members, which are two blocks at most."""
    members, at = np.unique(who, return_inverse=True)
    met = np.zeros((len(members), len(members)), bool)
    for first, n in zip(start.tolist(), size.tolist(), strict=True):
        run = at[first : first + n]
        met[np.ix_(run[looks[first : first + n]], run)] = True
    x, y = np.nonzero(np.triu(met | met.T, 1))
    return members[x], members[y]


def _compared(forest: bool):
    """Candidate pairs (a, b) inside a part's cells, across components. ``members``: first, cell, sig, id, comp, looks,
    block, across; ``whole``: member, n, odd. ``forest``: only pairs that would join components, the closest first."""

    def compare(members: pa.Table, whole: pa.Table) -> pa.Table:
        ids, size = whole.column("member").to_numpy(), whole.column("n").to_numpy()
        odd = whole.column("odd").to_pylist()
        order = np.argsort(ids)
        names = ("first", "cell", "sig", "id", "comp", "looks", "block", "across")
        rows = [members.column(c).to_numpy(zero_copy_only=False) for c in names]
        by = np.lexsort((rows[2], rows[1], rows[0]))
        first, cell, sig, who, comp, looks, block, across = (v[by] for v in rows)
        who = order[np.searchsorted(ids[order], who)]
        cut = np.flatnonzero(np.r_[True, (sig[1:] != sig[:-1]) | (cell[1:] != cell[:-1]) | (first[1:] != first[:-1])])
        runs = np.diff(np.r_[cut, len(sig)])
        mixed_run = np.maximum.reduceat(comp, cut) != np.minimum.reduceat(comp, cut)
        component = np.zeros(len(ids), np.int64)
        component[who] = comp
        found = [np.zeros((3, 0), np.int64)]
        cut, runs = cut[mixed_run], runs[mixed_run]
        # runs of one cell follow each other; a cell of many pairs is compared as a whole
        new_cell = np.r_[True, (cell[cut][1:] != cell[cut][:-1]) | (first[cut][1:] != first[cut][:-1])] if len(cut) else np.zeros(0, bool)
        number = np.cumsum(new_cell) - 1
        large = np.bincount(number, weights=runs * (runs - 1) / 2)[number] > LARGE if len(cut) else new_cell

        def compared(x: np.ndarray, y: np.ndarray) -> None:
            for k in range(0, len(x), PAIRS):
                a, b = x[k : k + PAIRS], y[k : k + PAIRS]
                ok = (component[a] != component[b]) & _fits(size[a], size[b], np.zeros(len(a), np.int64))
                a, b = a[ok], b[ok]
                distance = _distances(odd, a, b)
                ok = _fits(size[a], size[b], distance)
                found.append(np.stack([distance[ok], np.minimum(a[ok], b[ok]), np.maximum(a[ok], b[ok])]))

        for x, y in _pairs(cut[~large], runs[~large]):
            ok = (comp[x] != comp[y]) & (looks[x] | looks[y]) & (~across[x] | (block[x] != block[y]))
            x, y = who[x[ok]], who[y[ok]]
            pair = np.unique(np.minimum(x, y) * len(ids) + np.maximum(x, y))
            compared(pair // len(ids), pair % len(ids))
        half = np.zeros(len(ids), np.int64)
        for k in np.unique(number[large]).tolist():
            of = number == k
            lo, hi = cut[of][0], cut[of][-1] + runs[of][-1]
            x, y = _cell_pairs(who[lo:hi], looks[lo:hi], cut[of] - lo, runs[of])
            half[who[lo:hi]] = block[lo:hi]
            if across[lo]:
                ok = half[x] != half[y]
                x, y = x[ok], y[ok]
            compared(x, y)
        _, x, y = np.unique(np.concatenate(found, axis=1), axis=1)
        if forest:
            joins = _joining(component[x], component[y])
            x, y = x[joins], y[joins]
        return pa.table({"a": np.minimum(ids[x], ids[y]), "b": np.maximum(ids[x], ids[y])})

    return compare


def _joining(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which edges between components, in this order, join what no earlier one did."""
    root: dict[int, int] = {}

    def top(c: int) -> int:
        while root.setdefault(c, c) != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = np.zeros(len(x), bool)
    for k, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        a, b = top(a), top(b)
        if a != b:
            root[a], out[k] = b, True
    return out


def only(docs: DataFrame, ids: DataFrame, column: str | list[str], how: str) -> DataFrame:
    """A semi or anti join on one table of identifiers, sent to all tasks if it is small."""
    ids = F.broadcast(ids) if ids.count() <= SENT else ids.hint("merge")
    return docs.join(ids, column, how)


def _whole_sets(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, set) of the given sets, each once. ``texts``: name, text."""
    ids = tables.stored(ids)
    wanted = only(texts.where("name is not null"), ids.where("id >= 0").select(F.col("id").alias("name")), "name", "left_semi")
    nameless = texts.where("name is null") if ids.where("id < 0").take(1) else texts.limit(0)
    sets = wanted.unionByName(nameless).mapInArrow(_sets, "id long, set binary")
    return tables.stored(sets.groupBy("id").agg(F.first("set").alias("set")).join(ids, "id", "left_semi"))


def _confirmed(texts: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Those of the candidate edges (a, b) that are links: by size and sketch, then on the whole sets."""
    a, b = (nodes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("odd").alias(f"odd_{x}")) for x in "ab")
    near = tables.stored(edges.join(a, "a").join(b, "b").mapInArrow(_sieved, "a long, b long"))
    sets = _whole_sets(texts, near.select(F.col("a").alias("id")).union(near.select("b")).distinct())
    x, y = (sets.select(F.col("id").alias(c), F.col("set").alias(f"set_{c}")) for c in "ab")
    rows = near.join(y, "b").join(x, "a").mapInArrow(_verified, "a long, b long")
    return tables.stored(rows.distinct())


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) of every end of the edges, comp the smallest id it reaches: large and small stars in turn, each turn a
    written table, until nothing changes."""
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    edges, last = tables.stored(edges), None
    while True:
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == last or not state[0]:
            break
        last = state
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m"))
        edges = tables.stored(small.where("u != v").distinct())
    ends = edges.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("id"), "comp")
    return tables.stored(ends.union(ends.select(F.col("comp").alias("id"), "comp").distinct()))


def _allocated(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """The postings with ``looks``: whether a member looks the signature up. Of those of one scheme it gives up as many as
    it can do without, the longest first; the short ones cost nothing and are all looked up. ``wide`` are those of more than
    two members."""
    less = nodes.select("id", F.posexplode(F.array("less0", "less1")).alias("side", "less")).where("less > 0")
    rank = F.row_number().over(Window.partitionBy("id", "side").orderBy(F.desc("g"), "sig"))
    ranked = groups.where(F.col("g") > SHORT).withColumn("rank", rank).join(less.hint("merge"), ["id", "side"], "left")
    ranked = ranked.select("sig", "id", "first", (F.col("rank") > F.coalesce("less", F.lit(0))).alias("looks"), F.lit(True).alias("wide"))
    return ranked.union(groups.where(F.col("g") <= SHORT).select("sig", "id", "first", F.lit(True).alias("looks"), (F.col("g") > 2).alias("wide")))


def _open(groups: DataFrame, comp: DataFrame) -> DataFrame:
    """The postings that span several components and that a member looks up, with the component of each member."""
    rows = groups.join(comp, "id", "left").select("sig", "id", "first", "looks", F.coalesce("comp", "id").alias("comp"))
    open_ = rows.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("looks").alias("any")).where("lo != hi and any")
    return tables.stored(rows.join(open_.select("sig"), "sig"))


def _unsettled(nodes: DataFrame, rows: DataFrame, forest: bool) -> DataFrame:
    """Candidate edges inside open postings, from cells of two blocks of a group each."""
    sizes = rows.select("first", "id").distinct().join(nodes.select("id", "n"), "id").groupBy("first").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / GROUP), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("k"), F.sum("n").alias("volume")
    )
    sizes = tables.stored(sizes)
    # each pair of blocks is a cell; a member goes to the k cells of its block
    placed = rows.join(sizes.select("first", "k"), "first").withColumn("block", F.pmod(F.xxhash64("id"), "k"))
    placed = placed.withColumn("o", F.explode(F.expr("sequence(0L, k - 1)"))).withColumn("across", F.col("block") != F.col("o"))
    cell = F.least("block", "o") * F.col("k") + F.greatest("block", "o")
    volume = sizes.agg(F.sum(F.col("volume") * F.col("k"))).first()[0] or 0
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(volume) // (16 * BLOCK_SHINGLES)))
    placed = placed.select(
        "first", cell.alias("cell"), "sig", "id", "comp", "looks", "block", "across",
        F.pmod(F.xxhash64("first", cell), F.lit(parts)).alias("part"),
    )
    homes = placed.select(F.col("part").alias("home"), F.col("id").alias("member")).distinct()
    whole = homes.join(nodes.select(F.col("id").alias("member"), "n", "odd"), "member")
    met = placed.groupBy("part").cogroup(whole.select("home", "member", "n", "odd").groupBy("home"))
    return met.applyInArrow(_compared(forest), "a long, b long").distinct()


def _links(texts: DataFrame, nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """Links enough to join every two sets that links join: to the smallest member of each posting, then a forest inside
    the postings that are left, at last all that the sketch can't tell from links."""
    asked = groups.where("looks").select("sig").distinct()
    tried = groups.join(asked, "sig", "left_semi").where("id != first").select(F.least("first", "id").alias("a"), F.greatest("first", "id").alias("b"))
    tried = tables.stored(tried.distinct())
    links = _confirmed(texts, nodes, tried)
    # the only pair of a posting of two members has been tried; a posting that is settled stays so
    rows = groups.where("wide").drop("wide")
    for forest in (True, False):
        rows = _open(rows.drop("comp"), components(links))
        more = tables.stored(_unsettled(nodes, rows, forest).join(tried, ["a", "b"], "left_anti"))
        links = tables.stored(links.union(_confirmed(texts, nodes, more)))
        tried = tried.union(more)
    return links


def _sets_linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The profiles (doc_id, key, node, n, ...) of all rows, key being a text's hash and node its set's, and the sets
    (node, doc_id, comp): the smallest doc_id each has, and a number that those share that links join."""
    docs = docs.select("doc_id", "text")
    profile = tables.stored(docs.withColumn("key", F.xxhash64("text")).mapInArrow(_profiles, "doc_id long, key long, node long, n long, less0 long, less1 long, odd binary"))
    # sets of rows that share a doc_id, or have none, are known by their hashes
    by_node = profile.where("n > 0").groupBy("node")
    first_of = tables.stored(by_node.agg(F.min("doc_id").alias("doc_id")))
    shared = tables.stored(first_of.where("doc_id >= 0").groupBy("doc_id").count().where("count > 1").select("doc_id").withColumn("shared", F.lit(True)))
    hashed = F.lit(-1) - F.shiftrightunsigned("node", 1)
    alone = F.col("shared").isNull() & (F.col("doc_id") >= 0)
    named_sets = first_of.join(shared, "doc_id", "left").select("node", "doc_id", F.when(alone, F.col("doc_id")).otherwise(hashed).alias("id"))
    kept = (F.first(c).alias(c) for c in ("n", "less0", "less1", "odd"))
    nodes = tables.stored(by_node.agg(*kept).join(named_sets, "node"))
    size = profile.agg(F.max("n"), F.sum("n")).first()
    largest, total = size[0] or 0, size[1] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET))
    copies = profile.where("doc_id is not null").select("doc_id").distinct().join(nodes.select("doc_id"), "doc_id", "left_anti")
    one = only(docs, tables.stored(copies), "doc_id", "left_anti")
    named_ = only(one.where("doc_id >= 0"), shared.select("doc_id"), "doc_id", "left_anti").select(F.col("doc_id").alias("name"), "text")
    others = only(one.where("doc_id >= 0"), shared.select("doc_id"), "doc_id", "left_semi").unionByName(one.where("doc_id is null or doc_id < 0"))
    texts = named_.unionByName(others.select(F.lit(None).cast("long").alias("name"), "text"))
    index = texts.mapInArrow(_indexed(largest, buckets), "bucket long, sigs binary, ids binary")
    groups = tables.stored(index.groupBy("bucket").applyInArrow(_grouped, "sig long, side int, id long, first long, g long"))
    groups = tables.stored(_allocated(groups, nodes))
    comp = components(_links(texts, nodes, groups))
    return profile, nodes.join(comp, "id", "left").select("node", "doc_id", F.coalesce("comp", "id").alias("comp"))


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    profile, sets = _sets_linked(docs)
    sets = tables.stored(sets)
    least = sets.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    found = sets.join(least, "comp").select("node", "component_id")
    rows = profile.select("doc_id", "node", "n").join(found, "node", "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """The documents without near copies: one row of each component, that of the smallest doc_id (then of the smallest hash
    of its text; a null doc_id comes last). Rows without words all stay."""
    profile, sets = _sets_linked(docs)
    rows = profile.where("n > 0").groupBy("doc_id", "key", "node").agg(F.count(F.lit(1)).alias("rows"))
    rows = tables.stored(rows.join(sets.select("node", "comp"), "node"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    stays = rows.groupBy("comp").agg(F.min(order).alias("o")).select("comp", F.col("o.doc_id").alias("_doc"), F.col("o.key").alias("_key"))
    judged = rows.join(stays, "comp").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")))
    keys = (F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), F.col("key").alias("_key"))
    judged = tables.stored(judged.where("NOT stays OR rows > 1").select(*keys, "stays"))
    on = ["_id", "_none", "_key"]
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    texts = docs.select(row, F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), F.xxhash64("text").alias("_key"))
    kept = only(texts, judged.select(*on), on, "left_anti")
    # equal texts of one doc_id that stays may be several rows: one of them
    once = only(texts, judged.where("stays").select(*on), on, "left_semi").groupBy(*on).agg(F.first("row").alias("row"))
    return kept.select("row.*").union(once.select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(tables.table(spark, sf_dir, "documents"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
pairs AS (SELECT a.r AS x, b.r AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
link AS (
  SELECT x, y FROM pairs JOIN n nx ON nx.r = x JOIN n ny ON ny.r = y WHERE 100 * o >= 75 * (nx.n + ny.n - o)
), reach AS (
  SELECT r AS x, r AS y FROM d UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (r)
JOIN (SELECT x, min(e.doc_id) AS component_id FROM reach JOIN d e ON e.r = reach.y GROUP BY x) c ON c.x = d.r
"""
