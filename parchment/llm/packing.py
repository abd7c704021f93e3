"""Packing documents into sequences by bin completion, planned on the counts of lengths.

How many pieces have each length fits the driver whatever the input (at most as many rows as a sequence has tokens),
and so does the plan: fillings with multiplicities. Bin completion takes the largest piece left, lists undominated
fillings of the room beside it, and applies one as often as the counts allow; branches whose waste leaves no room to
beat the incumbent (best-fit decreasing at first) are cut. Pieces then find their place by their rank within their
length, which needs one shuffle of small rows and no sort of a whole length.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import materialize, pieces as slices

CAPACITY = 2048
Plan = list[tuple[tuple[int, ...], int]]


# ---- the plan ---------------------------------------------------------------------------------------------------------


def lower_bound(counts: np.ndarray) -> int:
    """Martello and Toth's L2: no packing has fewer sequences. counts[n]: pieces of length n, up to the capacity."""
    cap = len(counts) - 1
    n, s = np.concatenate(([0], np.cumsum(counts))), np.concatenate(([0], np.cumsum(counts * np.arange(cap + 1))))
    best = -(-int(s[-1]) // cap)
    half = cap // 2
    for alpha in range(half + 1):
        big, mid = n[-1] - n[cap - alpha + 1], n[cap - alpha + 1] - n[half + 1]
        room = mid * cap - (s[cap - alpha + 1] - s[half + 1])
        best = max(best, int(big + mid + max(0, -(-(int(s[half + 1] - s[alpha]) - int(room)) // cap))))
    return best


def best_fit_decreasing(counts: np.ndarray) -> Plan:
    """Best-fit decreasing over counts: sequences alike are handled as one with a multiplicity."""
    cap = len(counts) - 1
    bins: dict[int, dict[tuple, int]] = defaultdict(lambda: defaultdict(int))
    for length in range(cap, 0, -1):
        left = int(counts[length])
        while left:
            room = min((r for r in bins if r >= length), default=None)
            if room is None:
                q = min(left, cap // length)
                m = left // q
                bins[cap - q * length][(length,) * q] += m
                left -= q * m
                continue
            for items, n in list(bins[room].items()):
                # into one sequence as many as fit: best fit would choose it again
                q = min(left, room // length)
                m = min(n, left // q)
                bins[room][items] -= m
                if not bins[room][items]:
                    del bins[room][items]
                bins[room - q * length][items + (length,) * q] += m
                left -= q * m
                if not left:
                    break
            if not bins[room]:
                del bins[room]
    return [(items, n) for held in bins.values() for items, n in held.items()]


def fillings(room: int, counts: np.ndarray, width: int) -> list[tuple[int, ...]]:
    """Up to width undominated fillings of room by pieces left, least waste first, then fewest and largest pieces.

    One piece as long as the room dominates every other filling. Of two pieces, the partner of each is the largest
    that fits: a shorter one is dominated. Three and more are looked for where two leave waste.
    """
    fits = np.flatnonzero(counts[: room + 1] > 0)
    if not len(fits):
        return [()]
    if fits[-1] == room:
        return [(room,)]
    floor = np.zeros(room + 1, np.int64)  # the largest length left, up to each
    floor[fits] = fits
    floor = np.maximum.accumulate(floor)

    def pairs(space: int, most: int, used: dict) -> tuple[np.ndarray, np.ndarray]:
        a = fits[: np.searchsorted(fits, min(space, most), "right")][::-1]
        a = a[counts[a] > np.array([used.get(int(x), 0) for x in a])] if used else a
        b = np.minimum(floor[space - a], a)
        b = floor[b]
        again = (a == b) & (counts[a] < 2 + (0 if not used else np.array([used.get(int(x), 0) for x in a], np.int64)))
        b = np.where(again, floor[np.maximum(a - 1, 0)], b)
        b = np.where(b <= space - a, b, 0)
        if used:
            b = np.where((b > 0) & (counts[b] <= np.array([used.get(int(x), 0) for x in b])), 0, b)
        return a, b

    found: dict[tuple, int] = {}
    a, b = pairs(room, room, {})
    waste = room - a - b
    for i in np.lexsort((-a, waste))[: 2 * width]:
        found[tuple(int(x) for x in (a[i], b[i]) if x)] = int(waste[i])
    if min(found.values(), default=1) > 0 or len(found) < width:
        for first in fits[::-1][:192].tolist():
            a, b = pairs(room - first, first, {first: 1})
            if len(a):
                waste = room - first - a - b
                i = int(np.argmin(waste))
                found[tuple(int(x) for x in (first, a[i], b[i]) if x)] = int(waste[i])
                if waste[i] == 0 and len(found) > 2 * width:
                    break
    done: dict[tuple, int] = {}
    for items, w in found.items():  # what is still free takes the largest that fit
        used = defaultdict(int)
        for x in items:
            used[x] += 1
        while w and (x := next((int(f) for f in fits[: np.searchsorted(fits, w, "right")][::-1] if counts[f] > used[int(f)]), 0)):
            used[x] += 1
            items, w = (*items, x), w - x
        done[tuple(sorted(items, reverse=True))] = w
    return sorted(done, key=lambda t: (done[t], len(t), tuple(-x for x in t)))[:width]


def completions(room: int, counts: np.ndarray, width: int, steps: int) -> tuple[list[tuple[int, ...]], bool]:
    """Up to width of all fillings of room by pieces left to which no piece left can be added, least waste first, then
    fewest and largest pieces; and whether these are all. Looks at steps choices at most. Fillings to which a piece
    could be added are dominated, so a search over all of these finds the optimum."""
    fits = np.flatnonzero(counts[: room + 1] > 0)[::-1].tolist()
    if fits and fits[0] == room:
        return [(room,)], True
    found: dict[tuple, int] = {}
    # (place in fits, pieces of that length and shorter may follow; room left; pieces; the shortest length left out)
    stack, whole = [(0, room, (), room + 1)], True
    while stack:
        if not steps:
            whole = False
            break
        steps -= 1
        k, space, items, out = stack.pop()
        while k < len(fits) and fits[k] > space:
            k += 1
        if k == len(fits):
            if space < out:
                found[items] = space
            continue
        x = fits[k]
        most = min(int(counts[x]), space // x)
        for q in range(most + 1):  # the last pushed, with most pieces, comes first
            stack.append((k + 1, space - q * x, items + (x,) * q, out if q == counts[x] else min(out, x)))
    best = sorted(found, key=lambda t: (found[t], len(t), tuple(-x for x in t)))
    return best[:width] or [()], whole and len(best) <= width


def bin_completion(counts: np.ndarray, width: int = 3, nodes: int | None = 20_000) -> Plan:
    """Branch and bound over completions of the largest piece left. Its best is returned, which is the optimum where it
    meets lower_bound() or where the search came to its end.

    At first width fillings that look best, with two departures from the first choice at most and each as often as the
    counts allow, over nodes nodes. Where that leaves the bound unmet, over as many nodes again, all fillings with
    smaller multiplicities too: each round doubles the fillings, the departures and the steps that list the fillings,
    until none of them cuts a branch off. nodes None sets no bound: the search then ends with the optimum.
    """
    nodes = 1 << 62 if nodes is None else nodes
    total, least = int((counts * np.arange(len(counts))).sum()), lower_bound(counts)
    best = best_fit_decreasing(counts)
    visited = 0
    for limit in range(3):
        best, visited, _ = _search(counts, best, least, total, limit, visited, nodes, lambda room, left: (fillings(room, left, width), False), False)
        if _size(best) <= least or visited >= nodes:
            break
    visited, limit, steps = 0, 4, 64
    while _size(best) > least and visited < nodes:
        width, limit, steps = 2 * width, 2 * limit, 2 * steps
        # a round has an eighth of the nodes at least, so that wide rounds get their turn
        best, visited, whole = _search(counts, best, least, total, limit, visited, min(nodes, visited + max(nodes // 8, 1)), lambda room, left: completions(room, left, width, steps), True)  # noqa: B023
        if whole:
            break
    return best


def _size(plan: Plan) -> int:
    return sum(n for _, n in plan)


def _search(counts: np.ndarray, best: Plan, least: int, total: int, limit: int, visited: int, nodes: int, options_of, fewer: bool) -> tuple[Plan, int, bool]:
    """Depth first with few departures from the best filling first. (best plan, nodes visited, whether nothing but
    branches that cannot beat it was left out.) options_of(room, counts): fillings, and whether these are all. fewer:
    fillings are also applied half as often, a quarter, ... and once."""
    cap, whole = len(counts) - 1, True
    stack = [(0, counts.copy(), [], 0)]  # (departures so far, counts, plan, waste)
    while stack and _size(best) > least:
        gone, left, plan, waste = stack.pop()
        while True:
            if visited >= nodes:
                return best, visited, False
            visited += 1
            # one sequence fewer than the incumbent leaves so much waste at most
            if waste > (_size(best) - 1) * cap - total:
                break
            held = np.flatnonzero(left)
            if not len(held):
                best = plan
                break
            largest = int(held[-1])
            left[largest] -= 1
            options, every = options_of(cap - largest, left)
            left[largest] += 1
            choices = [(largest, *other) for other in options]
            whole &= every
            steps = [(items, 0) for items in choices]
            if fewer:
                for items in choices:
                    times = _times(left, items)
                    while times > 1:
                        times //= 2
                        steps.append((items, times))
            if gone < limit:
                for items, times in steps[1:]:
                    l2, p2, w2 = _apply(left, plan, waste, items, cap, times)
                    stack.append((gone + 1, l2, p2, w2))
            else:
                whole &= len(steps) == 1
            left, plan, waste = _apply(left, plan, waste, choices[0], cap)
    return best, visited, whole


def _times(left: np.ndarray, items: tuple[int, ...]) -> int:
    kinds, need = np.unique(items, return_counts=True)
    return int((left[kinds] // need).min())


def _apply(left: np.ndarray, plan: Plan, waste: int, items: tuple[int, ...], cap: int, times: int = 0) -> tuple[np.ndarray, Plan, int]:
    """items applied times times, or as often as the counts allow."""
    kinds, need = np.unique(items, return_counts=True)
    times = times or _times(left, items)
    left = left.copy()
    left[kinds] -= need * times
    return left, [*plan, (items, times)], waste + times * (cap - sum(items))


def places(plan: Plan) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length, runs of ranks: first rank, sequence of that rank (the next rank's is the next), offset."""
    runs, rank, sequence = defaultdict(list), defaultdict(int), 0
    for items, n in plan:
        offset = 0
        for x in items:
            runs[x].append((rank[x], sequence, offset))
            rank[x] += n
            offset += x
        sequence += n
    return {x: tuple(np.array(c, np.int64) for c in zip(*r)) for x, r in runs.items()}


# ---- tokens -------------------------------------------------------------------------------------------------------------


@lru_cache(4)
def _encoder(path: str):
    """Texts to ids as tokenizers gives them for a byte-level BPE file without added tokens.

    Where ids follow the order of merges (checked), tiktoken merges by them, several times faster; otherwise
    tokenizers itself is used.
    """
    spec = json.load(open(path, encoding="utf-8"))
    model, vocab = spec["model"], spec["model"]["vocab"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model.get("merges", ())]
    chars = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(chars)]
    byte_of = {chr(b): b for b in chars} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
    pre = spec.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer")
    if plain and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges)):
        import tiktoken

        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        return lambda text: fast.encode(text, allowed_special="all")
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    return lambda text: slow.encode(text, add_special_tokens=False).ids


def cut_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32): each document's ids and end_id, cut where longer than capacity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer)
        for batch in slices(batches):
            take, rows = [], ([], [], [], [])
            for i, v in enumerate(batch.column(1)):
                ids = np.array(encode(v.as_py() or ""), "<u4")
                ids = np.append(ids, np.uint32(end_id))
                first = (len(ids) - 1) % capacity + 1
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    take.append(i)
                    for col, x in zip(rows, (k, a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes()))):
                        col.append(x)
            cols = [pa.array(c, t) for c, t in zip(rows, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), *cols], [id_col, "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


def pack_pieces(pieces: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY, ranked: int = 50_000, **search) -> DataFrame:
    """pieces with sequence_id and offset: each sequence holds at most capacity tokens, without gaps.

    pieces is read several times, so it should be a table. ranked: rows of a length that one task puts in order.
    """
    counted = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in counted.items():
        counts[length] = n
    runs = pieces.sparkSession.sparkContext.broadcast(places(bin_completion(counts, **search)))
    salt = F.pmod(F.xxhash64(id_col, "piece", "start"), F.lit(max(1, int(counts.max()) // ranked + 1)))
    salted = pieces.withColumn("salt", salt)
    order = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(order), F.lit(0))).drop("n")
    within = Window.partitionBy("length", "salt").orderBy(id_col, "piece", "ids_crc32")
    rows = salted.withColumn("nth", F.row_number().over(within) - 1).join(sums, ["length", "salt"])
    names = pieces.columns
    rows = rows.select(*names, (F.col("base") + F.col("nth")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                first, start, place = runs.value[int(x)]
                i = np.searchsorted(first, rank[at], "right") - 1
                sequence[at], offset[at] = start[i] + rank[at] - first[i], place[i]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return rows.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, **search) -> DataFrame:
    """Per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is a document of end_id alone; documents longer than capacity are cut into full pieces, of
    which the first may be shorter. Rows that repeat an id, and null ids, are documents of their own. Equal lengths
    are ranked by a hash and the id. Other columns are ignored; an empty table gives an empty result.
    """
    return pack_pieces(materialize(cut_documents(docs, tokenizer, id_col, text_col, capacity), "pieces"), id_col, capacity, **search)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_pack(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
