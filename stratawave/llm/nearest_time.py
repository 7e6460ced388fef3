"""Nearest record in time for the same entity, by x-fast tries of timestamp prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratawave.session import changes, finite, usable, whole_groups

#: Width of a block of time in tolerances: at most this many tolerances of readings meet in one task's group.
BLOCK_TOLERANCES = 1024
OUT = "query_id long, record_id long, distance double, record_time double"


def ordered_bits(times: np.ndarray) -> np.ndarray:
    """64 bits of each time, as unsigned integers in the order of the times."""
    bits = (times + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def above(keys: np.ndarray, level) -> np.ndarray:
    """Keys without their lowest ``level`` bits; a level of 64 leaves nothing."""
    level = np.asarray(level, np.uint64)
    return (keys >> np.minimum(level, np.uint64(63))) >> (level > 63).astype(np.uint64)


class PrefixTable:
    """A hash table of (group, prefix) pairs, filled and searched for many at a time; each pair has the number of its entry."""

    def __init__(self, groups: np.ndarray, prefixes: np.ndarray):
        self.groups, self.prefixes = groups, prefixes
        self.bits = max(1, int(2 * len(groups) - 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        left, at = np.arange(len(groups)), self.start(groups, prefixes)
        while len(left):  # who finds a free slot stays, the others go on to the next
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            moves = self.slots[at] != left
            left, at = left[moves], (at[moves] + 1) & (len(self.slots) - 1)

    def start(self, groups: np.ndarray, prefixes: np.ndarray) -> np.ndarray:
        h = (prefixes + groups.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        return ((h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, groups: np.ndarray, prefixes: np.ndarray) -> np.ndarray:
        """The entries of pairs, -1 for those that are not there."""
        out, left, at = np.full(len(groups), -1, np.int64), np.arange(len(groups)), self.start(groups, prefixes)
        while len(left):
            entry = self.slots[at]
            there = entry >= 0
            same = there & (self.groups[entry] == groups[left]) & (self.prefixes[entry] == prefixes[left])
            out[left[same]] = entry[same]
            on = there & ~same
            left, at = left[on], (at[on] + 1) & (len(self.slots) - 1)
        return out


class XFastTrie:
    """Hash tables of the bit prefixes of keys, one for each prefix length, for many groups of keys at once.

    Keys are sorted by group and distinct within it; each group is a trie of its own.
    Every prefix maps to the least and the largest key below it, and the keys form a
    linked list by their order. Prefixes that all keys of a group share are not searched.
    A query finds its longest prefix in the tables by binary search over the lengths; the
    missing child there tells on which side of it the keys lie, so one of the node's ends
    is the neighbour on that side and the list gives the other. All queries take a step of
    their search together.
    """

    def __init__(self, groups: np.ndarray, keys: np.ndarray):
        self.groups, self.keys = groups, keys
        starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if len(groups) else np.zeros(0, int)
        self.names, self.first, self.last = groups[starts], starts, np.append(starts[1:], len(groups)) - 1
        spread = keys[self.first] ^ keys[self.last]
        self.bits = np.array([int(x).bit_length() for x in spread], np.int64)  # the prefix above these is common to a group
        self.tables: dict[int, tuple[PrefixTable, np.ndarray, np.ndarray]] = {}

    def table(self, level: int) -> tuple[PrefixTable, np.ndarray, np.ndarray]:
        """The prefixes that leave out ``level`` bits, with their first and last key; built when a search first asks for them."""
        if level not in self.tables:
            prefixes = above(self.keys, level)
            first = np.flatnonzero(np.concatenate([[True], (prefixes[1:] != prefixes[:-1]) | (self.groups[1:] != self.groups[:-1])]))
            self.tables[level] = PrefixTable(self.groups[first], prefixes[first]), first, np.append(first[1:], len(prefixes)) - 1
        return self.tables[level]

    def neighbours(self, groups: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the largest key at most, and of the least key at least, each of ``keys`` in its group; -1 where there is none."""
        before, after = np.full(len(keys), -1, np.int64), np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return before, after
        own = np.minimum(np.searchsorted(self.names, groups), len(self.names) - 1)
        known = self.names[own] == groups
        first, last, bits = self.first[own], self.last[own], self.bits[own]
        outside = known & (above(keys, bits) != above(self.keys[first], bits))
        small = outside & (keys < self.keys[first])
        after[small], before[outside & ~small] = first[small], last[outside & ~small]
        asked = np.flatnonzero(known & ~outside)
        low, high = np.zeros(len(asked), np.int64), bits[asked]  # the prefix without `high` bits is there; find the least such level
        node = np.full(len(asked), -1, np.int64)
        while (open_ := low < high).any():
            middle = (low + high) // 2
            for level in np.unique(middle[open_]):
                some = np.flatnonzero(open_ & (middle == level))
                found = self.table(int(level))[0].find(groups[asked[some]], above(keys[asked[some]], level)) >= 0
                high[some[found]], low[some[~found]] = level, level + 1
        left, right = np.empty(len(asked), np.int64), np.empty(len(asked), np.int64)
        for level in np.unique(high):
            some = np.flatnonzero(high == level)
            table, starts, ends = self.table(int(level))
            node = table.find(groups[asked[some]], above(keys[asked[some]], level))
            left[some], right[some] = starts[node], ends[node]
        ones = (high > 0) & (above(keys[asked], np.maximum(high - 1, 0)) & np.uint64(1) == 1)  # the child of the ones is missing: all keys of the node are smaller
        zeros = (high > 0) & ~ones
        group_first, group_last = first[asked], last[asked]
        before[asked] = np.where(ones, right, np.where(zeros, np.where(left > group_first, left - 1, -1), left))
        after[asked] = np.where(ones, np.where(right < group_last, right + 1, -1), left)
        return before, after


def match_groups(chunk: pd.DataFrame, group: np.ndarray) -> pd.DataFrame | None:
    """Pair each query (kind 0) of some whole groups with the nearer of its two neighbours among the records (kind 1) of its group, within its tolerance."""
    kind, times, ids = chunk["kind"].to_numpy(), chunk["time"].to_numpy(float), chunk["id"].to_numpy(np.int64)
    r, q = np.flatnonzero(kind == 1), np.flatnonzero(kind == 0)
    if not len(r) or not len(q):
        return None
    r = r[np.lexsort((ids[r], times[r], group[r]))]
    r = r[np.concatenate([[True], (times[r][1:] != times[r][:-1]) | (group[r][1:] != group[r][:-1])])]  # of records at the same time the smallest id stands for all
    trie = XFastTrie(group[r], ordered_bits(times[r]))
    before, after = trie.neighbours(group[q], ordered_bits(times[q]))
    side = lambda at: np.where(at >= 0, np.abs(times[r][at] - times[q]), np.inf)
    d0, d1 = side(before), side(after)
    later = (d1 < d0) | ((d1 == d0) & (ids[r][after] < ids[r][before]) & (after >= 0))
    at, distance = np.where(later, after, before), np.where(later, d1, d0)
    good = (at >= 0) & (distance <= chunk["tolerance"].to_numpy(float)[q])
    return pd.DataFrame({"query_id": ids[q][good], "record_id": ids[r][at[good]], "distance": distance[good], "record_time": times[r][at[good]]}) if good.any() else None


def matched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    keys = ["entity", "block"]
    for chunk in whole_groups(batches, keys):
        if (out := match_groups(chunk, np.cumsum(changes(chunk, keys)))) is not None:
            yield out


def nearest_in_time(queries: DataFrame, records: DataFrame) -> DataFrame:
    """For each query the nearest record of the same entity, at most its tolerance away.

    ``queries`` has id, entity, time and tolerance; ``records`` has id, entity and time.
    Result: query_id, record_id, distance, record_time; queries without a record in
    reach, with a null, NaN or infinite time, a null entity, or a null, infinite or negative
    tolerance are left out. Of two records equally near the one with the smaller id is
    taken; a query that is stored repeatedly with the same values gives one row, one id
    with different times gives the nearest of them.

    Records and queries meet in blocks of time, so a hot entity spreads over many groups; a
    query goes to every block its tolerance reaches. Blocks are ``width`` seconds wide: a
    column of both sides that is the same for all rows of an entity, or else
    BLOCK_TOLERANCES times the largest tolerance of all queries. Records at the same time become one before the
    shuffle. Each block builds the levels of
    its trie that searches ask for, once.
    """
    asked = queries.filter(finite(F.col("time")) & F.col("entity").isNotNull() & F.col("id").isNotNull() & finite(F.col("tolerance")) & (F.col("tolerance") >= 0))
    if "width" in queries.columns and "width" in records.columns:
        width = F.greatest(F.col("width"), F.lit(1e-3))
    else:
        largest = asked.agg(F.max("tolerance")).first()[0]
        width = F.lit(max(float(largest or 0.0), 1e-3) * BLOCK_TOLERANCES)
    reach = F.sequence(F.floor((F.col("time") - F.col("tolerance")) / width), F.floor((F.col("time") + F.col("tolerance")) / width))
    sent = asked.select("entity", F.explode(reach).alias("block"), F.lit(0).alias("kind"), "id", "time", "tolerance").distinct()
    kept = (
        records.filter(finite(F.col("time")) & F.col("id").isNotNull() & F.col("entity").isNotNull())
        .withColumn("block", F.floor(F.col("time") / width))
        .groupBy("entity", "block", "time").agg(F.min("id").alias("id"))
        .select("entity", "block", F.lit(1).alias("kind"), "id", "time", F.lit(0.0).alias("tolerance"))
    )
    pairs = (
        kept.unionByName(sent)
        .repartition("entity", "block")
        .sortWithinPartitions("entity", "block")
        .mapInPandas(matched, OUT)
    )
    best = F.min(F.struct("distance", "record_id", "record_time"))
    return pairs.groupBy("query_id").agg(best.alias("best")).select("query_id", "best.record_id", "best.distance", "best.record_time")


def match_captures(capture: DataFrame, message: DataFrame, spec: DataFrame) -> DataFrame:
    """Each capture with the usable message of its topic nearest in time: capture_id, msg_id, distance, record_time.

    ``spec`` has one tolerance for each topic and is a reference table of fixed size.
    Rows stored repeatedly count once; captures of topics without ``spec`` match nothing.
    """
    tolerances = F.broadcast(spec.select("topic", "tolerance").dropDuplicates(["topic"]))
    width = (F.col("tolerance") * BLOCK_TOLERANCES).alias("width")
    queries = capture.join(tolerances, "topic").select(F.col("capture_id").alias("id"), F.col("topic").alias("entity"), F.col("timestamp").alias("time"), "tolerance", width)
    records = usable(message).join(tolerances, "topic").select(F.col("msg_id").alias("id"), F.col("topic").alias("entity"), F.col("timestamp").alias("time"), width)
    return nearest_in_time(queries, records).select(F.col("query_id").alias("capture_id"), F.col("record_id").alias("msg_id"), "distance", "record_time")
