"""Substring dedup over suffixes: bytes covered by a string of 50 bytes that also starts in a document with a smaller id.

The order of suffixes matters here only as far as their first 50 bytes, and of these only which are equal. So a triple of bytes, of names,
and of names of names gets a 64-bit name at once, instead of its rank after a sort; only the names of the whole 50 bytes are dealt out,
sorted and compared with their neighbours. With each goes a check of 32 bits: two strings count as equal if both are. Name and check
are two mixtures of the names of a string's two parts of 27 bytes, which overlap. So unlike strings pass for equal if all 96 bits agree by
chance, or if they share one part and two unlike parts share a 64-bit name. Suffixes that can't have a partner are left out before, and so are
whole texts that also have a smaller id: they are covered, and what they would cover, the text with the smaller id does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import copies_of, forget_shuffles, release_memory, staged, table, text_key
from .sketch import contains, frequency_maps

LENGTH = 50
#: Each string of LENGTH bytes is represented by the least hash among its parts of PART bytes.
PART = 32
#: The names are dealt out and sorted in so many rounds at least, to need less disk at a time, each with a sixth of the texts' strings at most,
#: and in groups of about GROUP names.
ROUNDS, GROUP = 2, 1_000_000
#: Bits of the map of representatives that occur in several documents: 32 MB up to 2 GB of text, 128 MB at most. OFTEN_BITS: of those in 64.
MAP_BITS, MOST_BITS, OFTEN_BITS = 28, 30, 24
#: What is dealt out by bucket is gathered from so many bytes first, and what is found by so many bytes of text: the rows that a batch sends to
#: each bucket grow with the square of the input, and so are kept few.
_GATHERED, _PART = 1 << 21, 8 << 20
#: Bytes hashed at a time, so that the arrays stay in the processor's cache.
_PIECE = 1 << 18
_BYTES = np.random.default_rng(50).integers(1, 1 << 63, 256, dtype=np.uint64)
_K, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_UNKNOWN = (1 << 63) - 1


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _triple(h: np.ndarray, step: int) -> np.ndarray:
    """A name for each run of three names that are ``step`` apart."""
    n = max(0, len(h) - 2 * step)
    return _mix((h[:n] * _K + h[step : step + n]) * _K + h[2 * step : 2 * step + n])


def _thrice(data: np.ndarray) -> np.ndarray:
    """A name for the 27 bytes from each place: triples of triples of triples."""
    return _triple(_triple(_triple(_BYTES[data], 1), 3), 9)


def _longer(h: np.ndarray, size: int) -> np.ndarray:
    """A name for the ``size`` bytes from each place: two names of 27 bytes that overlap."""
    n = max(0, len(h) - (size - 27))
    return _mix(h[:n] * _K + h[size - 27 : size - 27 + n])


def _names(h: np.ndarray, place: np.ndarray, name_bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Names and checks of the 50 bytes from some places."""
    a, b = h[place], h[place + LENGTH - 27]
    return _mix(a * _K + b) >> np.uint64(64 - name_bits), (_mix(a * _OTHER + b) >> np.uint64(32)).astype(np.uint32)


def _least(h: np.ndarray) -> np.ndarray:
    """The least hash of a part of PART bytes within the 50 bytes from each place; mixed again, as least values are all small ones."""
    h = _longer(h, PART)
    for step in (1, 2, 4, 8, LENGTH - PART + 1 - 16):  # the least of 2, 4, 8, 16, then of all 19
        h = np.minimum(h[:-step], h[step:]) if len(h) > step else h[:0]
    return _mix(h * _K)


def pieces(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (document, first byte, bytes) of bounded size; pieces of one document overlap, so that each string is in one of them whole."""
    some, room = [], _PIECE
    for d, text in enumerate(texts):
        for at in range(0, max(1, len(text) - LENGTH + 1), _PIECE):
            part = text[at : at + _PIECE + LENGTH - 1]
            if len(part) >= LENGTH:
                some.append((d, at, part))
                room -= len(part)
            if room <= 0:
                yield some
                some, room = [], _PIECE
    if some:
        yield some


def _strings(some: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a group: its bytes; the piece of each string that doesn't cross pieces, and its place in the group."""
    sizes = np.array([len(b) for _, _, b in some])
    data = np.frombuffer(b"".join(b for _, _, b in some), np.uint8)
    n = sizes - LENGTH + 1
    piece = np.repeat(np.arange(len(some)), n)
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    return data, piece, place


def _encoded(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "replace") for t in texts]


def part_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text the distinct least hashes of its strings."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for some in pieces(_encoded(texts)):
        data, piece, place = _strings(some)
        least = _least(_thrice(data))[place]
        change = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (piece[1:] != piece[:-1])))
        least, piece = least[change], piece[change]
        for p, cut in enumerate(np.split(least, np.searchsorted(piece, np.arange(1, len(some))))):
            found[some[p][0]].append(cut)
    for cuts in found:
        yield np.unique(np.concatenate(cuts)) if cuts else np.zeros(0, np.uint64)


def _contains(bitmap: np.ndarray, least: np.ndarray) -> np.ndarray:
    """0 or 1 for each representative; neighbours mostly share one, which is looked up once."""
    begin = np.flatnonzero(np.append(True, least[1:] != least[:-1])) if len(least) else np.zeros(0, np.int64)
    return np.repeat(contains(bitmap, least[begin], (8 * len(bitmap)).bit_length() - 1), np.diff(np.append(begin, len(least))))


def _fragments(maps):
    """The parts of each text whose strings may occur in another document too."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        twice = np.frombuffer(maps.value, np.uint8)
        for rows in batches:
            ids, keys = rows["doc_id"].tolist(), rows["key"].tolist()
            out: list[tuple[int, int, int, bytes]] = []
            for some in pieces(_encoded(rows["text"].tolist())):
                data, piece, place = _strings(some)
                kept = np.flatnonzero(_contains(twice, _least(_thrice(data))[place]))
                if not len(kept):
                    continue
                begin = np.flatnonzero(np.append(True, (np.diff(kept) != 1) | (np.diff(piece[kept]) != 0)))
                size = np.diff(np.append(begin, len(kept))) + LENGTH - 1
                kept = kept[begin]
                own = piece[kept]
                at = place[kept] - np.cumsum([0] + [len(b) for _, _, b in some])[own]
                for p, a, m in zip(own.tolist(), at.tolist(), size.tolist()):
                    d, start, text = some[p]
                    out.append((ids[d], keys[d], start + a, text[a : a + m]))
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "key", "at", "data"])
        release_memory()

    return of


def _runs(order: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, length) of the runs of consecutive places of one document among the rows ``order``."""
    d, a = doc[order], at[order]
    begin = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (a[1:] != a[:-1] + 1))) if len(order) else np.zeros(0, np.int64)
    return order[begin], np.diff(np.append(begin, len(order)))


_RUN = np.dtype([("doc", np.uint32), ("at", np.uint32), ("n", np.uint32)])
_FOUND = np.dtype([("doc_id", np.int64), ("key", np.int64), ("at", np.uint32), ("n", np.uint32)])
PACKED = "bucket int, names binary, checks binary, runs binary, known binary, ids binary, keys binary"


def _ordered(name: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by name and check, ties as they come, and where in it each new string begins. Names are sorted with their places in the low
    bits; where two strings agree in the other bits, again by all bits."""
    if not len(name):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = np.uint64((1 << (len(name) - 1).bit_length()) - 1)
    key = np.sort((name & ~low) | np.arange(len(name), dtype=np.uint64))
    order = (key & low).astype(np.int64)
    high = key & ~low
    for again in (False, True):
        if again:
            order = np.lexsort((check, name))
        n, c = name[order], check[order]
        change = (n[1:] != n[:-1]) | (c[1:] != c[:-1])
        if not (change & (high[1:] == high[:-1])).any():
            break
    return order, np.flatnonzero(np.append(True, change))


def _gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches put together until they have _GATHERED bytes."""
    some, held = [], 0
    for rows in batches:
        some.append(rows)
        held += int(rows["data"].map(len).sum())
        if held >= _GATHERED:
            yield pd.concat(some)
            some, held = [], 0
    if some:
        yield pd.concat(some)


def _packed(turn: int, buckets: int, often, name_bits: int = 64, rounds: int | None = None):
    """For each of some batches together and each bucket: names with the runs of places they belong to, of each name only those in the smallest
    document there. The others are not the first for sure: their runs are ``known``, and go along with any bucket, here one chosen by batch.

    A representative names the round and the bucket, so that neighbours go together; for one that is ``often`` the name itself names both,
    as many different strings may share it."""
    rounds = rounds or ROUNDS

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent = np.frombuffer(often.value, np.uint8)
        for rows in _gathered(batches):
            rows = rows.sort_values(["doc_id", "key", "at"], kind="stable")
            ids, keys, starts, data = (rows[c].to_numpy() for c in ("doc_id", "key", "at", "data"))
            fresh = np.append(True, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])) if len(ids) else np.zeros(0, bool)
            number = np.cumsum(fresh) - 1
            ids, keys = ids[fresh].astype(np.int64), keys[fresh].astype(np.int64)
            parts: list[tuple[np.ndarray, ...]] = []
            sizes = np.array([len(b) for b in data], np.int64)
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // _PIECE, prepend=-1))
            for lo, hi in zip(cuts, np.append(cuts[1:], len(data))):
                joined, piece, place = _strings([(i, 0, b) for i, b in enumerate(data[lo:hi])])
                thrice = _thrice(joined)
                least = _least(thrice)[place]
                split = np.flatnonzero(_contains(frequent, least))
                least[split] = _names(thrice, place[split], name_bits)[0]
                share = (least * _K >> np.uint64(20)) % np.uint64(rounds * buckets)
                mine = np.flatnonzero(share // np.uint64(buckets) == turn)
                piece, place, bucket = piece[mine], place[mine], share[mine] % np.uint64(buckets)
                name, check = _names(thrice, place, name_bits)
                size = sizes[lo:hi]
                at = starts[lo:hi][piece] + place - (np.cumsum(size) - size)[piece]
                parts.append((name, check, number[lo:hi][piece].astype(np.uint32), at.astype(np.uint32), bucket.astype(np.int32)))
            if not parts:
                continue
            name, check, doc, at, bucket = (np.concatenate(x) for x in zip(*parts))
            del parts
            order, first = _ordered(name, check)  # places are in order of documents
            least = np.repeat(ids[doc[order[first]]], np.diff(np.append(first, len(order))))
            later = np.empty(len(name), bool)
            later[order] = ids[doc[order]] > least
            out = []
            sent = np.flatnonzero(~later)
            by = sent[np.argsort(bucket[sent].astype(np.uint16 if buckets <= 1 << 16 else np.int32), kind="stable")]  # of 16 bits by radix
            groups = [(int(bucket[own[0]]), own, own[:0]) for own in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1) if len(own)]
            old = np.flatnonzero(later)
            if len(old):
                groups.append((int(keys[doc[old[0]]]) % buckets, old[:0], old))
            for b, sent, old in groups:
                here = doc[sent if len(sent) else old]  # in order
                here = here[np.flatnonzero(np.append(True, here[1:] != here[:-1]))]
                blobs = []
                for x in (sent, old):
                    begin, n = _runs(x, doc, at)
                    run = np.zeros(len(n), _RUN)
                    run["doc"], run["at"], run["n"] = np.searchsorted(here, doc[begin]), at[begin], n
                    blobs.append(run.tobytes())
                out.append((b, name[sent].tobytes(), check[sent].tobytes(), *blobs, ids[here].tobytes(), keys[here].tobytes()))
            yield pd.DataFrame(out, columns=["bucket", "names", "checks", "runs", "known", "ids", "keys"]).astype({"bucket": "int32"})
        release_memory()

    return of


def _compared(rows: pd.DataFrame, parts: int = 1) -> pd.DataFrame:
    """One bucket: sort the names; all places of a name in documents after its first one. Runs of starts, as _FOUND, in ``parts`` by document."""
    names, checks, doc, at, ids, keys, base = [], [], [], [], [], [], 0
    known = []
    for r in rows.itertuples():
        runs, old = np.frombuffer(r.runs, _RUN), np.frombuffer(r.known, _RUN)
        n = runs["n"].astype(np.int64)
        names.append(np.frombuffer(r.names, np.uint64))
        checks.append(np.frombuffer(r.checks, np.uint32))
        doc.append(np.repeat(runs["doc"].astype(np.int64) + base, n))
        at.append(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(runs["at"].astype(np.int64), n))
        own = np.frombuffer(r.ids, np.int64)
        known.append((old["doc"].astype(np.int64) + base, old["at"].astype(np.int64), old["n"].astype(np.int64)))
        ids.append(own)
        keys.append(np.frombuffer(r.keys, np.int64))
        base += len(own)
    name, check, doc, at, ids, keys = (np.concatenate(x) for x in (names, checks, doc, at, ids, keys))
    order, first = _ordered(name, check)
    own = ids[doc[order]]
    least = np.repeat(np.minimum.reduceat(own, first) if len(own) else own, np.diff(np.append(first, len(order))))
    begin, n = _runs(np.sort(order[own > least]), doc, at)
    old_doc, old_at, old_n = (np.concatenate(x) for x in zip(*known))
    d = np.concatenate([doc[begin], old_doc])
    part = keys[d] % parts
    by = np.argsort(part, kind="stable")
    d, part = d[by], part[by]
    found = np.zeros(len(d), _FOUND)
    found["doc_id"], found["key"], found["at"], found["n"] = ids[d], keys[d], np.concatenate([at[begin], old_at])[by], np.concatenate([n, old_n])[by]
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    return pd.DataFrame({"part": part[cuts], "found": [x.tobytes() for x in np.split(found, cuts[1:])] if len(d) else []}).astype({"part": "int64"})


def _covered(rows: pd.DataFrame) -> pd.DataFrame:
    """One part of the documents: for each that strings cover, the first byte and the end of each covered run, in order."""
    found = np.frombuffer(b"".join(rows["found"]), _FOUND)
    found = found[np.lexsort((found["at"], found["key"], found["doc_id"]))]
    fresh = np.append(True, (found["doc_id"][1:] != found["doc_id"][:-1]) | (found["key"][1:] != found["key"][:-1]))
    base = (np.cumsum(fresh) - 1) << 34  # documents stand behind one another, over 2^32 apart
    at = found["at"].astype(np.int64)
    top = np.maximum.accumulate(base + at + found["n"] + LENGTH - 1)
    first = np.flatnonzero(np.append(True, (base + at)[1:] > top[:-1]))
    last = np.append(first[1:], len(found)) - 1
    edges = np.stack([at[first], top[last] - base[last]], 1)
    cuts = np.flatnonzero(fresh[first])
    return pd.DataFrame({"d": found["doc_id"][first[cuts]], "k": found["key"][first[cuts]], "edges": [x.tobytes() for x in np.split(edges, cuts[1:])]})


@F.pandas_udf(T.StructType([T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())]))
def _cut(text: pd.Series, edges: pd.Series) -> pd.DataFrame:
    out = []
    for t, found in zip(text, edges):
        if t is None or found is None:
            out.append((0, 0, None))
            continue
        data, runs = t.encode("utf-8", "replace"), np.frombuffer(found, np.int64).reshape(-1, 2)
        kept = zip([0, *runs[:, 1].tolist()], [*runs[:, 0].tolist(), len(data)])
        out.append((int((runs[:, 1] - runs[:, 0]).sum()), len(runs), b"".join([data[a:b] for a, b in kept])))
    return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept"])


def remove_substrings(docs: DataFrame, name_bits: int = 64) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept (binary), with the bytes removed that a string of
    50 bytes covers which also starts in a document with a smaller doc_id. Strings are judged on the input.

    Texts are UTF-8 bytes and may be cut anywhere; null is empty. Rows with one id don't take from each other. Null ids come after all
    others and don't take from each other either. Documents under 50 bytes stay whole. Further columns aren't looked at. Strings are told
    apart by 96 bits; name_bits: of the 64 that they are dealt out by.

    A row whose whole text also has a smaller id goes if it has 50 bytes, and takes no further part: the row with the smaller id has all its strings.
    Each string of the others has a representative, the least hash among its parts of 32 bytes; strings whose representative is in one document
    only are left out (by a map of up to 128 MB, which lets through too many rather than too few). Those left get names, are dealt out by their
    representative, or by name if the representative is in 64 documents or more, sorted by name, and compared with their neighbours. Of
    equal names in one batch of rows only those of the smallest document are dealt out, the other places are spread over all buckets; so
    neither a string nor a representative that a third of all documents share gathers in one task. What is found is gathered by document, packed.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_UNKNOWN)).alias("doc_id"), text_key(text).alias("key"), text.alias("text"))
    rows, size = copies_of(rows)
    rows = rows.withColumn("copy", F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)) & (F.col("n_bytes") >= LENGTH)).drop("first")
    own = rows.where(~F.col("copy")).select("doc_id", "key", "text")
    bits = min(max(MAP_BITS, (size // 8).bit_length()), MOST_BITS)
    maps, often = (spark.sparkContext.broadcast(m) for m in frequency_maps(own, part_sets, map_bits=bits, often_bits=OFTEN_BITS, size=size, share=16 << 20, gathered=_GATHERED))
    forget_shuffles(spark)
    fragments = staged(own.mapInPandas(_fragments(maps), "doc_id long, key long, at long, data binary"), "fragments")
    maps.destroy()
    del maps
    total = fragments.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    rounds = max(ROUNDS, -(-6 * total // max(size, 1)))
    buckets, parts = max(1, -(-total // (rounds * GROUP))), max(1, size // _PART)
    found = None
    for turn in range(rounds):
        packed = fragments.mapInPandas(_packed(turn, buckets, often, name_bits, rounds), PACKED)
        some = staged(packed.groupBy("bucket").applyInPandas(lambda r: _compared(r, parts), "part long, found binary"), "runs", 4_000)
        found = some if found is None else found.unionByName(some)
        forget_shuffles(spark)
    often.destroy()
    each = found.groupBy("part").applyInPandas(_covered, "d long, k long, edges binary")
    texts = rows.select("doc_id", "key", "n_bytes", "copy", F.when(~F.col("copy"), F.col("text")).alias("text"))
    joined = texts.join(each, (F.col("doc_id") == F.col("d")) & (F.col("key") == F.col("k")), "left")
    cut = joined.select("doc_id", "n_bytes", "copy", "text", _cut(F.when(F.col("edges").isNotNull(), F.col("text")), F.col("edges")).alias("x"))
    return cut.select(
        F.nullif("doc_id", F.lit(_UNKNOWN)).alias("doc_id"), "n_bytes", F.when(F.col("copy"), F.col("n_bytes")).otherwise(F.col("x.n_removed")).alias("n_removed"),
        F.when(F.col("copy"), F.lit(1).cast("long")).otherwise(F.col("x.n_spans")).alias("n_spans"),
        F.coalesce("x.kept", F.col("text").cast("binary"), F.lit(b"")).alias("kept"),
    )


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
