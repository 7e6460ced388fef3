"""Token ids of a whole corpus, encoding every content-defined chunk once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratawave.llm.tokenizer import Pieces, default_path, pieces
from stratawave.session import changes, cut, whole_groups

#: Bytes the rolling hash sees; a border comes where its lowest bits are zero; least and largest bytes of a chunk. A text of at most LEAST bytes is one chunk.
WINDOW, MASK, LEAST, MOST = 16, 0x3FF, 512, 8192
#: Characters that the pattern may look at from the start of a piece before it knows the piece ("'re).
AHEAD = 3
#: A chunk is common from this share of all chunks on, so there are at most 1 / COMMON common ones; tasks that a common chunk is spread over.
COMMON, SPREAD = 0.001, 64
#: Pieces at the start of a chunk whose borders are kept for joins; a join that needs more finds them anew.
HEAD = 6

CHUNKS = "doc_id long, pos int, chunk string"
ENCODED = "doc_id long, pos int, chunk string, ids array<int>, ends array<int>, upto array<int>, sure_end int, sure_ids int"
IDS = "doc_id long, ids array<int>"


def gear() -> np.ndarray:
    """A pseudo-random 32-bit number for each byte, from a multiplicative rule."""
    x = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = gear()


def borders(data: bytes) -> list[int]:
    """Ends of the chunks of UTF-8 text: they depend on the bytes just before them, not on their place in the text.

    A border is never within a character.
    """
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    raw = np.frombuffer(data, np.uint8)
    g, h = GEAR[raw], np.zeros(n, np.uint32)
    for k in range(min(WINDOW, n)):
        h[k:] += g[: n - k] << np.uint32(k)
    starts = np.ones(n + 1, bool)
    starts[:n] = (raw & 0xC0) != 0x80
    allowed = np.flatnonzero(((h >> np.uint32(10)) & np.uint32(MASK) == 0) & starts[1:]) + 1
    out, last, i = [], 0, 0
    allowed = allowed.tolist()
    while n - last > LEAST:
        while i < len(allowed) and allowed[i] < last + LEAST:
            i += 1
        end = allowed[i] if i < len(allowed) else n
        if end - last > MOST:
            end = last + MOST
            while not starts[end]:
                end -= 1
        out.append(end)
        last = end
    if last < n:
        out.append(n)
    return out


def chunked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ids, places, chunks = [], [], []
        for doc, text in zip(batch["doc_id"].tolist(), batch["text"].tolist()):
            data, last = text.encode("utf-8", "surrogatepass"), 0
            for place, end in enumerate(borders(data)):
                ids.append(doc)
                places.append(place)
                chunks.append(data[last:end].decode("utf-8", "surrogatepass"))
                last = end
        yield pd.DataFrame({"doc_id": ids, "pos": places, "chunk": chunks})


def encode_chunk(tokens: Pieces, chunk: str) -> tuple[list[int], list[int], list[int], int, int]:
    """A chunk by itself: its ids, the ends of its first pieces with the numbers of ids up to there, and how many characters and ids are certain whatever follows."""
    found = tokens.pattern.findall(chunk)
    ids = tokens.flat(chunk)
    ends: list[int] = []
    upto: list[int] = []
    end = n = 0
    for piece in found[:HEAD]:
        end += len(piece)
        n += len(tokens.ids(piece))
        ends.append(end)
        upto.append(n)
    sure_end, sure_ids = len(chunk), len(ids)
    for piece in reversed(found):
        start = sure_end - len(piece)
        if sure_end < len(chunk) and start + AHEAD <= len(chunk):
            break
        sure_end, sure_ids = start, sure_ids - len(tokens.ids(piece))
    return ids, ends, upto, sure_end, sure_ids


def all_borders(tokens: Pieces, chunk: str) -> dict[int, int]:
    """Number of ids up to the end of each piece of a chunk by itself."""
    out, end, n = {}, 0, 0
    for piece in tokens.pattern.findall(chunk):
        end += len(piece)
        n += len(tokens.ids(piece))
        out[end] = n
    return out


def by_runs(batches: Iterator[pd.DataFrame], column: str, encode) -> Iterator[tuple[pd.DataFrame, list]]:
    """Each batch, sorted by ``key``, with what ``encode`` makes of the texts of a column: equal texts, which follow each other, are encoded once."""
    at, known = None, {}
    for batch in batches:
        out = []
        for key, text in zip(batch["key"].tolist(), batch[column].tolist()):
            if key != at:
                at, known = key, {}
            if text not in known:
                known[text] = encode(text)
            out.append(known[text])
        yield batch, out


def encoder(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = pieces(path)
        for batch, coded in by_runs(batches, "chunk", lambda text: encode_chunk(tokens, text)):
            yield pd.DataFrame({"doc_id": batch["doc_id"], "pos": batch["pos"], "chunk": batch["chunk"], **{name: [c[i] for c in coded] for i, name in enumerate(("ids", "ends", "upto", "sure_end", "sure_ids"))}})

    return run


def whole_encoder(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = pieces(path)
        for batch, ids in by_runs(batches, "text", lambda text: np.asarray(tokens.flat(text), np.int32)):
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": ids})

    return run


def joined(tokens: Pieces, chunks: list[tuple]) -> np.ndarray:
    """Ids of the text that ``chunks`` (chunk and the results of encode_chunk) make up.

    A piece depends only on the text from its start on, and at most up to one character
    behind its end or AHEAD behind its start. So what a chunk says of its pieces holds
    from any place where the true pieces have a border as well, up to the pieces at its
    end. At a join the text is split anew, from the last piece that is certain, until a
    border agrees with one of the next chunk; there that chunk's ids take over.
    """
    out: list = []
    waiting: list[str] = []  # text without a certain border since the last one
    size = enough = 0
    for text, ids, ends, upto, sure_end, sure_ids in chunks:
        at, n = 0, 0  # where the chunk takes over: characters and ids
        if waiting:
            if size < enough:  # a long piece: look again when there is twice as much of it
                waiting.append(text)
                size += len(text)
                continue
            tail = "".join(waiting)
            whole, place, known = tail + text, 0, None
            again: list[int] = []
            while True:
                m = tokens.pattern.match(whole, place)
                end = m.end()
                if end >= len(whole) or place + AHEAD > len(whole):
                    at = -1
                    break
                again += tokens.ids(m.group())
                place = end
                inside = end - len(tail)
                if inside < 0:
                    continue
                if inside == 0:
                    break
                if known is None:
                    known = dict(zip(ends, upto))
                if inside > ends[-1] and len(known) == len(ends):
                    known = all_borders(tokens, text)
                if inside in known:
                    at, n = inside, known[inside]
                    break
            if again:
                out.append(again)
            if at < 0:
                waiting = [whole[place:]]
                size = len(waiting[0])
                enough = 2 * size
                continue
        enough = 0
        if at > sure_end:
            waiting = [text[at:]]
        else:
            out.append(ids[n:sure_ids])
            waiting = [text[sure_end:]] if sure_end < len(text) else []
        size = len(waiting[0]) if waiting else 0
    if size:
        out.append([i for piece in tokens.pattern.findall("".join(waiting)) for i in tokens.ids(piece)])
    return np.concatenate([np.asarray(o, np.int32) for o in out]) if out else np.zeros(0, np.int32)


def assembler(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = pieces(path)
        for group in whole_groups(batches, ["doc_id"]):
            starts = np.append(np.flatnonzero(changes(group, ["doc_id"])), len(group))
            rows = list(zip(*(group[c].tolist() for c in ("chunk", "ids", "ends", "upto", "sure_end", "sure_ids"))))
            yield pd.DataFrame({"doc_id": group["doc_id"].to_numpy()[starts[:-1]], "ids": [joined(tokens, rows[a:b]) for a, b in zip(starts[:-1], starts[1:])]})

    return run


def encode_corpus(documents: DataFrame, path: str | None = None) -> DataFrame:
    """Token ids of each document: doc_id, ids.

    ``documents`` has a unique doc_id and text. The ids are those of the tokenizer at
    ``path`` (a rank file of a byte-level tokenizer) without special tokens, so the text
    of a special token is ordinary text. Empty and null texts have the empty list. A row
    without doc_id cannot be named and is left out.

    Texts are cut where a rolling hash of their bytes says so; equal chunks of all
    documents meet in one task and are encoded once there; each document is put together
    from its chunks and repaired at their joins, where exact agreement is reached by
    construction. Texts of at most LEAST bytes are one chunk and need no putting together.
    The copies of a common chunk, of which there are at most 1 / COMMON, are spread over
    up to SPREAD tasks, each of which encodes it once. A document must fit a task, as its
    row of the result does.
    """
    path = path or default_path()
    named = documents.filter(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    short, long = named.filter(F.octet_length("text") <= LEAST), named.filter(F.octet_length("text") > LEAST)
    chunks = long.mapInPandas(chunked, CHUNKS)
    columns = ["doc_id", "pos", "chunk", "ids", "ends", "upto", "sure_end", "sure_ids"]
    coded = spread(chunks, "chunk", F.struct("doc_id", "pos")).mapInPandas(encoder(path), ENCODED)
    filled = coded.select(columns).repartition("doc_id").sortWithinPartitions("doc_id", "pos").mapInPandas(assembler(path), IDS)
    return filled.unionByName(spread(short, "text", F.col("doc_id")).mapInPandas(whole_encoder(path), IDS))


def spread(rows: DataFrame, column: str, own: Column) -> DataFrame:
    """Rows with ``key``, a hash of a text column, where equal texts follow each other in one task, or in some tasks where they are common."""
    hashed = rows.withColumn("key", F.xxhash64(column))
    counts = cut(hashed.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    common = counts.filter(F.col("n") > total * COMMON).select("key", F.lit(True).alias("is_common"))
    salted = hashed.join(F.broadcast(common), "key", "left").withColumn("salt", F.when(F.col("is_common"), F.pmod(F.xxhash64(own), F.lit(SPREAD))).otherwise(0))
    return salted.drop("is_common").repartition("key", "salt").sortWithinPartitions("key")


def count_tokens(documents: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """The columns ``keep`` of each document with its number of tokens; empty and null texts have 0."""
    path = path or default_path()
    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep) + ", tokens long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = pieces(path)
        for batch in batches:
            out = batch[list(keep)].copy()
            out["tokens"] = [len(tokens.flat(t)) if t else 0 for t in batch["text"]]
            yield out

    return documents.select(*keep, "text").mapInPandas(run, schema)
