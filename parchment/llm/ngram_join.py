"""Exact similarity self-join on word shingles with signature trees, and the groups that its links make.

Two documents link when num/den of the union of their shingle sets is shared. Every pair that can link meets in a
block: of each set only a prefix is routed (under one global order of shingles, two sets that link share a shingle of
their prefixes, whatever the order). The order starts with shingles of rare words and ends with shingles that many
documents hold, by count sketches over all documents, so common passages route little; the sketches only move work,
never results. In each block
a signature tree is built: nodes hold the OR of their documents' token bitmaps and the range of their set sizes. A
dual traversal from the root drops node pairs whose sizes cannot link or whose largest possible overlap is too small.
That happens twice: on small signatures, so that only documents with a partner left travel with their
texts, and on the whole sets, where what is left is compared exactly. Hot blocks are dealt as pairs of bounded parts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import components, join_hot, materialize, mix, pieces, shingle_set, shingles

LEAF = 16
#: Elements that small sets have at most at level 0, and the least bits of a signature.
SAMPLE, MAP_BITS = 256, 1024
FANOUT = 4
#: Slots of each count sketch, the bits of a hash below a slot, and slots that travel together.
SLOTS = 1 << 20
_SHIFT = np.uint64(44)
CHUNK = 1 << 16
#: Ids of documents to compare that are broadcast; with more, the texts are joined by a shuffle.
BROADCAST_IDS = 1 << 18


def overlap_needed(a, b, num: int, den: int):
    """The smallest intersection with which sets of a and b elements link."""
    return -(-(num * (a + b)) // (num + den))


def bitmap(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Which of bits slots the hashes fall in, as 64-bit words."""
    flags = np.zeros(bits, bool)
    flags[(hashes >> np.uint64(65 - bits.bit_length())).astype(np.int64)] = True
    return np.packbits(flags).view(np.uint64)


class SignatureTree:
    """Documents in order of (size, bitmap); leaves of LEAF documents; FANOUT nodes below each inner node.

    Each node has the OR of its documents' bitmaps, the least and largest set size, and the largest slack: elements
    less bits, which is what a bitmap cannot tell. Two documents share at most their common bits and the smaller slack.
    """

    def __init__(self, ids: list[int], sizes: list[int], maps: np.ndarray, sets: list[np.ndarray] | None = None):
        order = np.lexsort((maps[:, 0], np.array(sizes, np.int64)))
        self.ids = [ids[i] for i in order]
        self.sets = [sets[i] for i in order] if sets else None
        self.size, self.map = np.array(sizes, np.int64)[order], maps[order]
        self.slack = self.size - np.bitwise_count(self.map).sum(axis=1, dtype=np.int64)
        at = np.arange(0, len(ids), LEAF)
        self.levels = [(np.bitwise_or.reduceat(self.map, at, axis=0), np.minimum.reduceat(self.size, at), np.maximum.reduceat(self.size, at), np.maximum.reduceat(self.slack, at))]
        while len(self.levels[-1][1]) > 1:
            maps, low, high, slack = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(maps, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(slack, at)))

    @classmethod
    def of_sets(cls, docs: list[tuple[int, np.ndarray]], bits: int) -> SignatureTree:
        return cls([d for d, _ in docs], [len(s) for _, s in docs], np.stack([bitmap(s, bits) for _, s in docs]), [s for _, s in docs])


def _open_pairs(x, y, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which node pairs may hold a link: by size ranges and by the largest possible overlap."""
    (xm, xl, xh, xs), (ym, yl, yh, ys) = x, y
    ok = (xh[i] * den >= num * yl[j]) & (yh[j] * den >= num * xl[i])
    k = np.flatnonzero(ok)
    for part in np.array_split(k, max(1, len(k) * xm.shape[1] // (1 << 20))):
        a, b = i[part], j[part]
        common = np.bitwise_count(xm[a] & ym[b]).sum(axis=1, dtype=np.int64)
        ok[part] = common + np.minimum(xs[a], ys[b]) >= overlap_needed(xl[a], yl[b], num, den)
    return ok


def dual_traversal(x: SignatureTree, y: SignatureTree, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves that may hold a link. x and y may be the same tree: then pairs with i <= j."""
    same = x is y
    top = max(len(x.levels), len(y.levels))
    level = lambda t, k: t.levels[min(k, len(t.levels) - 1)]  # noqa: E731  the shorter tree waits at its root
    i = j = np.zeros(1, np.int64)
    for k in range(top - 1, -1, -1):
        ok = _open_pairs(level(x, k), level(y, k), i, j, num, den)
        i, j = i[ok], j[ok]
        if k == 0 or not len(i):
            break
        step = []
        for t, n in ((x, i), (y, j)):
            if k < len(t.levels):
                child = n[:, None] * FANOUT + np.arange(FANOUT)
                step.append((child, child < len(t.levels[k - 1][1])))
            else:
                step.append((n[:, None], np.ones((len(n), 1), bool)))
        (ci, oi), (cj, oj) = step
        ok = oi[:, :, None] & oj[:, None, :]
        a, b = np.broadcast_arrays(ci[:, :, None], cj[:, None, :])
        i, j = a[ok], b[ok]
        if same:
            i, j = i[i <= j], j[i <= j]
    return i, j


def _leaf_pairs(x: SignatureTree, y: SignatureTree, a: int, b: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Of two leaves, which pairs of documents may link, and the overlap that each needs."""
    rows, cols = slice(a * LEAF, (a + 1) * LEAF), slice(b * LEAF, (b + 1) * LEAF)
    na, nb = x.size[rows][:, None], y.size[cols][None, :]
    common = np.bitwise_count(x.map[rows][:, None, :] & y.map[cols][None, :, :]).sum(axis=2, dtype=np.int64)
    need = overlap_needed(na, nb, num, den)
    ok = (common + np.minimum(x.slack[rows][:, None], y.slack[cols][None, :]) >= need) & (np.minimum(na, nb) >= need)
    return (np.triu(ok, 1) if x is y and a == b else ok), need


def block_partners(left: list[tuple], right: list[tuple] | None, num: int, den: int) -> set[int]:
    """Ids with some partner in the block that their signatures do not rule out. Items: (id, size, level, map, next map).

    Signatures of large sets hold a sample of their elements; what is not in the sample is slack. A signature is there as
    of its level and of the next: where sizes that link may differ by more than a level, only sizes rule a pair out.
    """
    out: set[int] = set()
    if 2 * num < den:  # sizes that link may be more than a factor of 2 apart
        return _partners_by_size(left, right, num, den)
    for level in sorted({d[2] for d in left + (right or [])}):
        trees = []
        for side in (left, right if right is not None else []):
            own = [(d[0], d[1], d[3] if d[2] == level else d[4]) for d in side if d[2] in (level, level - 1)]
            if own:
                trees.append(SignatureTree([d[0] for d in own], [d[1] for d in own], np.stack([np.frombuffer(d[2], np.uint64) for d in own])))
        if right is not None and len(trees) < 2:
            continue
        x, y = trees[0], trees[-1]
        for a, b in zip(*(v.tolist() for v in dual_traversal(x, y, num, den))):
            rows, cols = x.ids[a * LEAF : (a + 1) * LEAF], y.ids[b * LEAF : (b + 1) * LEAF]
            if out.issuperset(rows) and out.issuperset(cols):
                continue
            ok, _ = _leaf_pairs(x, y, a, b, num, den)
            out.update(d for d, hit in zip(rows, ok.any(axis=1)) if hit)
            out.update(d for d, hit in zip(cols, ok.any(axis=0)) if hit)
    return out


def _partners_by_size(left: list[tuple], right: list[tuple] | None, num: int, den: int) -> set[int]:
    """Ids with some partner whose size does not rule a link out."""

    def hits(own: list[tuple], other: list[tuple], twice: int) -> set[int]:
        sizes = np.sort(np.array([d[1] for d in other], np.int64))
        least, most = (np.array([f(d[1]) for d in own], np.int64) for f in (lambda n: -(-(num * n) // den), lambda n: n * den // num if num else 2**62))
        n = np.searchsorted(sizes, most, "right") - np.searchsorted(sizes, least, "left")
        return {d[0] for d, k in zip(own, n.tolist()) if k > twice}

    return hits(left, left, 1) if right is None else hits(left, right, 0) | hits(right, left, 0)


def block_links(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]] | None, num: int, den: int) -> tuple[list[tuple[int, int]], int]:
    """A spanning forest of the links within left, or between left and right. Also how many pairs were compared.

    A pair whose documents are joined already needs no comparison: it cannot change a component.
    """
    every = left + (right or [])
    middle = sorted(len(s) for _, s in every)[len(every) // 2]
    bits = min(1 << 14, max(256, 1 << (4 * middle - 1).bit_length()))
    x = SignatureTree.of_sets(left, bits)
    y = x if right is None else SignatureTree.of_sets(right, bits)
    parent: dict[int, int] = {}

    def find(v: int) -> int:
        while (p := parent.get(v, v)) != v:
            parent[v] = parent.get(p, p)
            v = p
        return v

    out, compared = [], 0
    li, lj = dual_traversal(x, y, num, den)
    near = np.lexsort((li, np.abs(li - lj)))
    for a, b in zip(li[near].tolist(), lj[near].tolist()):
        rows, cols = slice(a * LEAF, (a + 1) * LEAF), slice(b * LEAF, (b + 1) * LEAF)
        ra, rb = [find(d) for d in x.ids[rows]], [find(d) for d in y.ids[cols]]
        if len({*ra, *rb}) == 1:
            continue
        ok, need = _leaf_pairs(x, y, a, b, num, den)
        for p, q in np.argwhere(ok):
            if (u := find(x.ids[a * LEAF + p])) == (v := find(y.ids[b * LEAF + q])):
                continue
            compared += 1
            s, t = x.sets[a * LEAF + p], y.sets[b * LEAF + q]
            if len(s) + len(t) - len(np.unique(np.concatenate((s, t)))) >= need[p, q]:
                parent[max(u, v)] = min(u, v)
                out.append((u, v))
    return out, compared


def _common_counts(rows: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """How many elements each of others shares with each of rows (few, each without repeats)."""
    out = np.zeros((len(others), len(rows)), np.int64)
    lengths = np.array([len(s) for s in others], np.int64)
    some = np.flatnonzero(lengths)
    if not len(some) or not any(map(len, rows)):
        return out
    known, place = np.unique(np.concatenate(rows), return_inverse=True)
    member = np.zeros((len(known), len(rows)), np.uint8)
    member[place, np.repeat(np.arange(len(rows)), [len(s) for s in rows])] = 1
    starts = np.cumsum(lengths[some]) - lengths[some]
    flat = np.concatenate([others[i] for i in some])
    at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
    out[some] = np.add.reduceat(member[at] * (known[at] == flat)[:, None], starts, axis=0, dtype=np.int64)
    return out


def count_links(lead: int, left: list[tuple], right: list[tuple] | None, num: int, den: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Compare every pair of the block that may link: a spanning forest of the links, and per row of left + right the
    copies of its partners. Items: (id, set, copies, leads). Two documents may meet in several blocks: their link counts
    in that of their least common lead alone, so that nothing needs to list the pairs."""
    every = left + (right or [])
    sets, copies = [d[1] for d in every], np.array([d[2] for d in every], np.int64)
    earlier = [np.array([v for v in d[3] if v < lead], np.int64) for d in every]
    middle = sorted(map(len, sets))[len(sets) // 2]
    bits = min(1 << 14, max(256, 1 << (4 * middle - 1).bit_length()))
    # trees of places in every
    x, y = (SignatureTree.of_sets([(i, sets[i]) for i in part], bits) if len(part) else None for part in (range(len(left)), range(len(left), len(every))))
    y = x if right is None else y
    found, label, forest = np.zeros(len(every), np.int64), np.arange(len(every)), []
    li, lj = dual_traversal(x, y, num, den)
    for a in np.unique(li).tolist():
        rows = np.array(x.ids[a * LEAF : (a + 1) * LEAF])
        leaves = lj[li == a]
        sizes = np.add.reduceat(y.size, np.arange(0, len(y.size), LEAF))[leaves]
        for part in np.split(leaves, np.flatnonzero(np.diff(np.cumsum(sizes) >> 18)) + 1):
            cols = np.concatenate([y.ids[b * LEAF : (b + 1) * LEAF] for b in part.tolist()])
            place = np.concatenate([np.arange(b * LEAF, min((b + 1) * LEAF, len(y.ids))) for b in part.tolist()])
            ok = _common_counts([earlier[i] for i in rows], [earlier[i] for i in cols]) == 0
            if x is y:
                ok &= place[:, None] > np.arange(a * LEAF, a * LEAF + len(rows))[None, :]
            some = ok.any(axis=1)
            if not some.any():
                continue
            cols, ok = cols[some], ok[some]
            n, m = (np.array([len(sets[i]) for i in v], np.int64) for v in (cols, rows))
            ok &= _common_counts([sets[i] for i in rows], [sets[i] for i in cols]) >= overlap_needed(n[:, None], m[None, :], num, den)
            np.add.at(found, cols, ok @ copies[rows])
            np.add.at(found, rows, copies[cols] @ ok)
            while True:
                p, q = np.divmod(np.argmax(ok & (label[cols][:, None] != label[rows][None, :])), len(rows))
                u, v = label[cols[p]], label[rows[q]]
                if not ok[p, q] or u == v:
                    break
                forest.append((every[cols[p]][0], every[rows[q]][0]))
                label[label == max(u, v)] = min(u, v)
    return forest, found


# ---- what runs on the executors ------------------------------------------------------------------------------------


def _texts(batch: pa.RecordBatch, at: int = 1):
    for v in batch.column(at).cast(pa.large_binary()):
        yield v.as_buffer() if v.is_valid else b""


def _sketch_partial(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((2, SLOTS), np.uint32)
        for batch in batches:
            for text in _texts(batch, 0):
                words, found = shingles(text, k)
                np.add.at(table[0], words >> _SHIFT, 1)
                np.add.at(table[1], np.unique(found) >> _SHIFT, 1)
        for c, part in enumerate(table.reshape(-1, CHUNK)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([zlib.compress(part, 1)], pa.binary())], ["chunk", "counts"])

    return run


def _sketch_merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, v in zip(batch.column(0).to_pylist(), batch.column(1)):
            total[c] = total.get(c, 0) + np.frombuffer(zlib.decompress(v.as_buffer()), np.uint32).astype(np.int64)
    for c, v in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([zlib.compress(v, 1)], pa.binary())], ["chunk", "counts"])


def rarity(docs: DataFrame, text_col: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each slot of words its weight (eighths of the binary logarithm of how often they occur), and of each slot of
    shingles its class: 0, or more for those far above the mean. A byte each, 2 * SLOTS bytes whatever the input."""
    parts = docs.select(text_col).mapInArrow(_sketch_partial(k), "chunk int, counts binary")
    n = np.zeros((2, SLOTS), np.int64)
    for c, v in parts.repartition("chunk").mapInArrow(_sketch_merge, "chunk int, counts binary").toLocalIterator():
        n.reshape(-1, CHUNK)[c] = np.frombuffer(zlib.decompress(v), np.int64)
    often = np.maximum(n[1] / (2 * n[1].mean() + 8), 0.5)
    return np.minimum(np.log2(n[0] + 1.0) * 8, 255).astype(np.uint8), np.minimum(np.floor(np.log2(often)) + 1, 15).astype(np.uint8)


def _order(words: np.ndarray, found: np.ndarray, weight: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """The place of each shingle in the global order: frequent shingles last, then by how common their words are.

    A shingle with a rare word is rare itself, however many documents there are; what is frequent against its words
    (a passage that many documents hold) shows in the counts of shingles.
    """
    w = weight[words >> _SHIFT].astype(np.uint64)
    common = w[: len(found)].copy()
    for i in range(1, len(words) - len(found) + 1):
        common += w[i : i + len(found)]
    return kind[found >> _SHIFT].astype(np.uint64) << np.uint64(60) | np.minimum(common, np.uint64(4095)) << np.uint64(48) | mix(found) >> np.uint64(16)


def signature(s: np.ndarray) -> tuple[int, bytes, bytes]:
    """(level, map, next): bitmaps of a set of up to SAMPLE * 2**level elements as of level and level + 1. Up to level 2
    a level halves the sample; from there on a quarter is sampled (fewer could not rule a link out) and maps grow."""
    level = max(0, -(-len(s) // SAMPLE) - 1).bit_length()
    h = mix(s)
    return level, *(bitmap(h[h & np.uint64((1 << min(x, 2)) - 1) == 0], MAP_BITS << max(0, x - 2)).tobytes() for x in (level, level + 1))


def _route(k: int, num: int, den: int, tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, kind = tables.value
        for batch in pieces(batches):
            n, digest, keys, ends, signs = [], [], [], [0], []
            for text in _texts(batch):
                words, found = shingles(text, k)
                s = np.unique(found)
                n.append(len(s))
                digest.append(hashlib.blake2b(s, digest_size=16).digest())
                signs.append(signature(s))
                if len(s):
                    keys.append(np.unique(_order(words, found, weight, kind))[: len(s) - -(-(num * len(s)) // den) + 1])
                ends.append(ends[-1] + (len(keys[-1]) if len(s) else 0))
            flat = np.concatenate(keys).view(np.int64) if keys else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), *(pa.array([x[i] for x in signs], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary())))], ["id", "hash", "n", "digest", "keys", "level", "map", "next"])

    return run


def _by_block(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[tuple, list, list | None]]:
    """(block, left rows, right rows or None) of rows sorted by lead, i, j, side. names: the columns of a row."""
    now, sides = None, ([], [])
    for batch in batches:
        blocks = zip(*(batch.column(c).to_pylist() for c in ("lead", "i", "j", "side")))
        rows = zip(*(_texts(batch, batch.schema.get_field_index(c)) if c == "text" else batch.column(c).to_pylist() for c in names))
        for (lead, i, j, side), row in zip(blocks, rows):
            if (lead, i, j) != now:
                if now is not None:
                    yield now, sides[0], None if now[1] == now[2] else sides[1]
                now, sides = (lead, i, j), ([], [])
            sides[side].append(row)
    if now is not None:
        yield now, sides[0], None if now[1] == now[2] else sides[1]


def _prune_blocks(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (lead, _, _), left, right in _by_block(batches, ("id", "n", "level", "map", "next")):
            if len(left) > 1 if right is None else left and right:
                kept = sorted(block_partners(left, right, num, den))
                yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array([lead] * len(kept), pa.int64())], ["id", "lead"])

    return run


def _join_blocks(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, left, right in _by_block(batches, ("id", "text")):
            if len(left) > 1 if right is None else left and right:
                sets = [None if side is None else [(d, shingle_set(t, k)) for d, t in side] for side in (left, right)]
                out, _ = block_links(*sets, num, den)
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def _count_blocks(k: int, num: int, den: int):
    """Links as (a, b, null), and per document and block the copies of its partners as (id, hash, links)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (lead, _, _), left, right in _by_block(batches, ("id", "hash", "copies", "leads", "text")):
            # rows that repeat an id and its text are one
            sides = [None if side is None else {d[:2]: d for d in side} for side in (left, right)]
            if len(sides[0]) > 1 if right is None else left and right:
                items = [None if side is None else [(d, shingle_set(t, k), c or 0, v) for d, _, c, v, t in side.values()] for side in sides]
                forest, found = count_links(lead, *items, num, den)
                counted = [(*key, n) for key, n in zip([key for side in sides for key in side or ()], found.tolist()) if n]
                rows = [(a, b, None) for a, b in forest] + counted
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["a", "b", "links"])

    return run


def _deal(rows: DataFrame, most: dict[str, int]) -> DataFrame:
    """rows of (lead, id, ...) by block, or, where a block exceeds most (rows: *, or sums), by pairs (i, j) of its parts."""
    parts = F.greatest(*[F.ceil((F.count("*") if c == "*" else F.sum(c)) / n) for c, n in most.items()], F.lit(1)).cast("int")
    both = rows.join(rows.groupBy("lead").agg(parts.alias("parts")), "lead").withColumn("p", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    both = both.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = both.select(*rows.columns, F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"), (F.col("p") > F.col("o")).cast("int").alias("side"))
    return dealt


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, num: int = 90, den: int = 100, block_rows: int = 4096, block_shingles: int = 4_000_000, count: bool = False) -> DataFrame:
    """Per document (id_col, n_shingles, component_id), and with count its n_links.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a set is the distinct k-word shingles (with fewer words
    the whole sequence is one). Documents link when den * intersection >= num * union; a component is named by its
    smallest id. Null and empty texts, and texts without words, have n_shingles 0 and link with nothing. A row with a
    null id keeps its n_shingles and has a null component. Rows that repeat an id each get a row. Ties need no rule:
    links are symmetric. Other columns are ignored; an empty table gives an empty result.
    block_rows and block_shingles bound the documents that one task holds at a time; larger blocks are dealt as pairs
    of sub-blocks.
    n_links is the number of other rows with an id that the row links with, rows of equal sets included; it is null where the
    id is. Without count, pairs that a component already joins are not compared; with it every pair that the trees leave is.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))
    tables = spark.sparkContext.broadcast(rarity(docs, "text", k))
    sets = materialize(docs.mapInArrow(_route(k, num, den, tables), "id long, hash long, n long, digest binary, keys array<long>, level int, map binary, next binary"), "prefixes")
    # equal sets are one class, led by its smallest id
    classes = sets.where("n > 0 and id is not null").groupBy("digest").agg(F.min(F.struct("id", "hash")).alias("least"), F.count("*").alias("copies"))
    classes = classes.select("digest", F.col("least.id").alias("rep"), F.col("least.hash").alias("hash"), "copies")
    routed = sets.where("n > 0 and id is not null").select("id", F.explode("keys").alias("key"))
    # the smallest id with a key leads its block. Keys that the sketches call frequent may hold any share of all rows:
    # their least ids are found by an aggregation that combines before the shuffle; one sort serves the others
    frequent = F.shiftrightunsigned("key", 60) > 0
    first = F.first("id").over(Window.partitionBy("key").orderBy("id"))
    cold = routed.where(~frequent).select("id", first.alias("lead"))
    reps = classes.select(F.col("rep").alias("id"))
    hot = routed.where(frequent).join(reps, "id", "left_semi")
    hot = hot.join(hot.groupBy("key").agg(F.min("id").alias("lead")), "key").select("id", "lead")
    member = cold.unionByName(hot).where("id <> lead").distinct().join(reps, "id", "left_semi")
    member = materialize(member, "members")
    member = member.unionByName(member.select(F.col("lead").alias("id"), "lead").distinct())
    signs = sets.where("n > 0 and id is not null").select("id", "digest", "n", "level", "map", "next").dropDuplicates(["id", "digest"]).drop("digest")
    order = ["lead", "i", "j", "side", "id"]
    blocks = _deal(member.join(signs, "id"), {"*": block_rows}).repartition("lead", "i", "j").sortWithinPartitions(*order)
    near = materialize(blocks.select(*order, "n", "level", "map", "next").mapInArrow(_prune_blocks(num, den), "id long, lead long").distinct(), "partners")
    sizes = sets.where("n > 0 and id is not null").groupBy("id").agg(F.max("n").alias("n"))
    wanted = near.select("id").distinct()
    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(wanted) if few else wanted, "id", "left_semi")
    dealt, more, joined = near.join(sizes, "id"), [], _join_blocks(k, num, den)
    if count:
        # of each class one row, its least, counts for all copies
        ranked = classes.select(F.col("rep").alias("id"), "hash", "copies").join(wanted, "id", "left_semi")
        texts = texts.join(F.broadcast(ranked) if few and ranked.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ranked, ["id", "hash"], "left")
        dealt, more, joined = dealt.join(near.groupBy("id").agg(F.collect_list("lead").alias("leads")), "id"), ["leads", "hash", "copies"], _count_blocks(k, num, den)
    rows = _deal(dealt, {"*": block_rows, "n": block_shingles}).select(*order, *more[:1]).join(texts, "id")
    links = rows.repartition("lead", "i", "j").sortWithinPartitions(*order).select(*order, *more, "text").mapInArrow(joined, "a long, b long" + ", links long" * count)
    if count:
        links = materialize(links, "links")
        found = links.where("links is not null").groupBy(F.col("a").alias("rep"), F.col("b").alias("hash")).agg(F.sum("links").alias("links"))
        classes = classes.join(found, ["rep", "hash"], "left").withColumn("links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
        links = links.where("links is null").select("a", "b")
    groups = components(links)
    shown = [F.col("links").alias("n_links")] if count else []
    named = classes.join(groups, F.col("rep") == F.col("node"), "left").select(F.col("digest").alias("key"), F.coalesce("component", "rep").alias("least"), *shown)
    least = F.when(F.col("id").isNull(), None).otherwise(F.coalesce("least", "id"))
    if count:
        shown = [F.when(F.col("id").isNotNull(), F.coalesce("n_links", F.lit(0))).alias("n_links")]
    # what has no shingles is in no class, whatever its digest
    out = join_hot(sets.select("id", "n", "digest"), F.when(F.col("n") > 0, F.col("digest")), F.xxhash64("id"), named)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), least.alias("component_id"), *shown)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, **options) -> DataFrame:
    """docs without near copies: of each component the row with the smallest id stays. Rows that repeat an id are one
    document, of which one stays; rows with a null id are in no group and stay."""
    linked = link_documents(docs, id_col, text_col, k, num, **options)
    leads = linked.where(F.col("component_id") == F.col(id_col)).select(F.col(id_col).alias("lead")).distinct()
    # the columns of docs travel as one, so that no name of theirs can clash
    whole = docs.where(F.col(id_col).isNotNull()).select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))
    named = whole.join(leads, F.col("id") == F.col("lead"), "left_semi")
    first = named.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("hash"))).where("nth = 1")
    return first.select("row.*").unionByName(docs.where(F.col(id_col).isNull()))


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    return link_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), count=True)
