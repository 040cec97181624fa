"""Variable-capacity best-fit packing of documents into training sequences.

Operator 3. A document's length is its number of tokens, counted by the BPE operator with a given vocabulary file, so
a sequence never holds more tokens than its capacity. Documents above the largest capacity are cut into pieces of that
capacity; the rest is packed best-fit decreasing over several permitted sequence lengths jointly: a piece goes to the
open bin with the least room that still holds it; where none does, a bin opens of the size that costs least per token
that it would hold, were it filled at once with the longest pieces left that fit, and shrunk to them. At the end every
bin shrinks to the least permitted length that holds its contents.

Documents are dealt by hash into groups of about GROUP, packed independently, so memory and time of a task are
bounded and a group leaves at most a few bins part-filled. A row's group depends on its place in the written table of
lengths, too, so copies of one document are spread. Null and empty texts have nothing to pack and are in no bin.
Repeated rows are packed once per row; a null doc_id stays null in the lists. Ties in length go by doc_id. Only doc_id
and text are read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragmill.llm import bpe
from fragmill.llm.common import materialise

CAPACITIES = (512, 1024, 2048, 4096)
#: Documents per group.
GROUP = 50_000
#: Cost of a sequence of c tokens: FIXED + c + c * c / ATTENTION.
FIXED, ATTENTION = 64, 16_384
SCHEMA = "bin_group long, bin long, capacity int, used int, doc_ids array<long>, starts array<long>, lengths array<int>"


def cost(capacity: int) -> float:
    return FIXED + capacity + capacity * capacity / ATTENTION


def _filled(room: int, here: int, left: dict[int, int]) -> int:
    """What goes into ``room`` if the longest pieces that fit are taken first; ``here`` has a bit for every length left."""
    total = 0
    while fitting := here & ((2 << room) - 1):
        length = fitting.bit_length() - 1
        taken = min(left[length], room // length)
        total, room = total + taken * length, room - taken * length
        here = fitting & ~(1 << length)
    return total


def best_fit(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES) -> list[tuple[int, list[int]]]:
    """Bins as (capacity, indices into ``lengths``); lengths are positive, at most the largest capacity.

    Pieces are taken longest first, ties by index; of equally full bins the one filled last is taken.
    """
    order = np.argsort(-np.asarray(lengths, np.int64), kind="stable")
    least = lambda n: min(c for c in capacities if c >= n)
    left = Counter(int(x) for x in lengths)
    here = sum(1 << x for x in left)
    bins: list[list[int]] = []
    with_room: dict[int, list[int]] = {}
    rooms: list[int] = []
    for k in order:
        length = int(lengths[k])
        left[length] -= 1
        if not left[length]:
            here &= ~(1 << length)
        at = bisect_left(rooms, length)
        if at < len(rooms):
            room = rooms[at]
            stack = with_room[room]
            target = stack.pop()
            if not stack:
                del with_room[room], rooms[at]
        else:
            held = {c: length + _filled(c - length, here, left) for c in capacities if c >= length}
            room = min(held, key=lambda c: (cost(least(held[c])) / held[c], c))
            target = len(bins)
            bins.append([])
        bins[target].append(int(k))
        room -= length
        if room:
            if room not in with_room:
                with_room[room] = []
                insort(rooms, room)
            with_room[room].append(target)
    return [(least(sum(int(lengths[k]) for k in held)), held) for held in bins]


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    group, most = int(rows["bin_group"].iloc[0]), max(CAPACITIES)
    rows = rows.sort_values(["n", "doc_id"], ascending=[False, True], kind="stable")
    ids = [None if pd.isna(x) else int(x) for x in rows["doc_id"]]
    n = rows["n"].to_numpy(np.int64)
    out = []
    for k in np.flatnonzero(n >= most):
        out += [(most, most, [ids[k]], [start], [most]) for start in range(0, int(n[k]) - most + 1, most)]
    rest = n % most
    kept = np.flatnonzero(rest)
    for capacity, held in best_fit(rest[kept]):
        where = kept[held]
        lengths = rest[where]
        out.append((capacity, int(lengths.sum()), [ids[k] for k in where], (n[where] - lengths).tolist(), lengths.tolist()))
    frame = pd.DataFrame(out, columns=["capacity", "used", "doc_ids", "starts", "lengths"])
    frame.insert(0, "bin", np.arange(len(frame)))
    frame.insert(0, "bin_group", group)
    return frame


def pack(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row a bin: its group and number, capacity, tokens used, and the pieces as doc_ids, starts and lengths in tokens.

    ``vocabulary`` is the path of a tokenizer's file, as the BPE operator reads it.
    """
    lengths = bpe.lengths(docs, vocabulary).where("n > 0").withColumn("at", F.monotonically_increasing_id())
    lengths = materialise(lengths, "packing-lengths")
    groups = max(1, -(-lengths.count() // GROUP))
    dealt = lengths.withColumn("bin_group", F.pmod(F.xxhash64("doc_id", "n", "at"), F.lit(groups))).drop("at")
    return dealt.groupBy("bin_group").applyInPandas(_pack, SCHEMA)
