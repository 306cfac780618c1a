"""N-gram Jaccard self-join by prefix tree.

A document's set holds the hashes of its distinct word n-grams. Documents with equal sets are one class. Grams are put
in one global order, most shared first, by how many classes hold them; read from its rare end, a set that can link to
another shares one of its rarest few grams with it (the prefix), so a class whose prefix grams are all its own links to
nothing and leaves early. The others are met in two passes. First, blocks of sets that agree on a minimum hash give links
that join most of each group cheaply; which links they miss doesn't matter. Then units (components, and piles of classes
still alone) that share a prefix gram are compared: every class of the smaller with all of the larger.

A block's sets, in the global order from its shared end, stand in lexicographic order with the lengths of their common
prefixes, which is a trie laid flat: a probe walks it once, keeps the overlap at each depth, and jumps over a subtree when
the longest set in it cannot reach the threshold. Only a spanning forest of a block's links is emitted, never all pairs of
a group.

Grams that very many classes hold are found while documents are read (counts of each stretch of a partition, summed); they
go straight to their classes and are not gathered by gram, so no task holds all postings of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medtab.llm.common import cut, give_back
from medtab.llm.components import components

#: Bits of a gram hash; the top BUCKET_BITS or more of them choose the bucket that counts it.
GRAM_BITS, BUCKET_BITS = 54, 6
#: Grams of a bucket, which one task holds.
BUCKET_GRAMS = 2_500_000
#: Postings from which a gram is not gathered by gram, and classes of a stretch from which it is counted there.
HOT_POSTINGS, HOT_LEAST = 250_000, 64
#: Share of all grams (as a power of two) that such a gram holds at least, which bounds their number.
HOT_SHARE = 20
#: Largest count that orders grams; larger ones are equal in order.
MOST_DF = 65535
#: Sets in a block of the tree join, and minimum hashes that choose the blocks of the first pass.
BLOCK, MIN_HASHES = 512, 2
#: Sets before it in a block with which the first pass compares a set: half are the block's first, which hold most of what
#: the block shares, half the nearest in order. The second pass makes up for all others.
NEAREST = 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64(seed * 0x632BE59BD9B4E019 & (1 << 64) - 1)) * _MIX
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def gram_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a whole text; of the whole sequence where it has fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(n, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ hashes[i : i + len(out)]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out >> np.uint64(64 - GRAM_BITS))


def _digest(grams: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes()))))


def _frequent(sets: list[np.ndarray], into: dict[int, int]) -> None:
    """Add the counts of grams that many of some sets hold."""
    grams, count = np.unique(np.concatenate(sets), return_counts=True)
    often = count >= max(HOT_LEAST, len(sets) >> 7)
    for g, c in zip(grams[often].tolist(), count[often].tolist(), strict=True):
        into[g] = into.get(g, 0) + c


def _classes(n: int):
    """A row for each document, and at a partition's end one of size -1 with the grams that many of its classes hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["doc_id", "n", "digest", "often"], [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("gram", pa.int64()), ("count", pa.int64())]))]
        often: dict[int, int] = {}
        seen: set[int] = set()
        sets, held = [], 0
        for b in batches:
            sizes, digests = [], []
            for text in b.column(1):
                g = gram_set(text.as_py(), n)
                d = _digest(g) if len(g) else None
                sizes.append(len(g))
                digests.append(d)
                if d is None or d in seen:
                    continue
                seen.add(d)
                sets.append(g)
                held += len(g)
                if held >= 1_000_000:
                    _frequent(sets, often)
                    sets, held = [], 0
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, k) for v, k in zip([sizes, digests, [None] * len(sizes)], kinds[1:], strict=True))], names)
        if sets:
            _frequent(sets, often)
        if often:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([None, -1, None, [{"gram": g, "count": c} for g, c in often.items()]], kinds, strict=True)], names)
        del sets, seen
        give_back()

    return run


def _postings(n: int, bits: int, hot: np.ndarray):
    """Gram postings of each class, packed by bucket: one row for a bucket and about a million grams. Those of ``hot`` grams
    (sorted) are packed by the part of their class instead, under the bucket -1 - part."""
    low = np.uint64((1 << GRAM_BITS - bits) - 1)

    def pack(sets: list[np.ndarray], digests: list[int]) -> pa.RecordBatch:
        size = np.array([len(x) for x in sets], np.uint32)
        grams = np.concatenate(sets)
        doc = np.repeat(np.arange(len(sets), dtype=np.uint32), size)
        ids, rows = np.array(digests, np.int64), []
        if len(hot):
            is_hot = hot[np.minimum(np.searchsorted(hot, grams), len(hot) - 1)] == grams
            of, own = doc[is_hot], grams[is_hot]
            part = (ids[of].view(np.uint64) & np.uint64((1 << bits) - 1)).astype(np.int64)
            for k in np.unique(part).tolist():
                mine = part == k
                rows.append((-1 - k, b"", own[mine].tobytes(), ids[of[mine]].tobytes(), size[of[mine]].tobytes(), b""))
            grams, doc = grams[~is_hot], doc[~is_hot]
        bucket = (grams >> np.uint64(GRAM_BITS - bits)).astype(np.uint32)
        order = np.argsort(bucket, kind="stable")
        grams, doc, bucket = grams[order] & low, doc[order], bucket[order]
        edges = np.searchsorted(bucket, np.arange((1 << bits) + 1))
        for i in np.unique(bucket).tolist():
            part, who = grams[edges[i] : edges[i + 1]], doc[edges[i] : edges[i + 1]]
            held, count = np.unique(who, return_counts=True)
            rows.append((i, (part >> np.uint64(32)).astype(np.uint16).tobytes(), part.astype(np.uint32).tobytes(), ids[held].tobytes(), size[held].tobytes(), count.astype(np.uint32).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["bucket", "hi", "lo", "digest", "n", "count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a partition's classes: its copies go out once
        sets, digests, held = [], [], 0
        for b in batches:
            for text in b.column(0):
                g = gram_set(text.as_py(), n)
                if not len(g) or (d := _digest(g)) in seen:
                    continue
                seen.add(d)
                sets.append(g)
                digests.append(d)
                held += len(g)
                if held >= 1_000_000:
                    yield pack(sets, digests)
                    sets, digests, held = [], [], 0
        if sets:
            yield pack(sets, digests)
        del sets
        give_back()

    return run


def _shared(bits: int, parts: int):
    """Of one bucket's postings those whose gram two or more classes hold, packed by class."""

    def packed(part: np.ndarray, digest: np.ndarray, size: np.ndarray, grams: np.ndarray, df: np.ndarray) -> pd.DataFrame:
        order = np.lexsort((digest, part))
        grams, digest, size, df, part = grams[order], digest[order], size[order], df[order], part[order]
        edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
        cut_at = [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)] if len(part) else []
        return pd.DataFrame({"part": [int(part[s.start]) for s in cut_at], "digest": [digest[s].tobytes() for s in cut_at], "n": [size[s].astype(np.uint32).tobytes() for s in cut_at], "gram": [grams[s].tobytes() for s in cut_at], "df": [np.minimum(df[s], MOST_DF).astype(np.uint16).tobytes() for s in cut_at]})

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        give_back()
        if int(key[0]) < 0:  # hot grams of one part's classes: shared in any case
            grams, digest, size = (np.concatenate([np.frombuffer(x, kind) for x in rows[c]]) for c, kind in (("lo", np.uint64), ("digest", np.int64), ("n", np.uint32)))
            order = np.lexsort((grams, digest))
            grams, digest, size = grams[order], digest[order], size[order]
            new = np.ones(len(grams), bool)
            new[1:] = (grams[1:] != grams[:-1]) | (digest[1:] != digest[:-1])
            return packed(np.full(new.sum(), -1 - int(key[0])), digest[new], size[new], grams[new], np.full(new.sum(), MOST_DF))
        grams = np.concatenate([(np.frombuffer(h, np.uint16).astype(np.uint64) << np.uint64(32)) | np.frombuffer(lo, np.uint32).astype(np.uint64) for h, lo in zip(rows.hi, rows.lo, strict=True)])
        count = np.concatenate([np.frombuffer(c, np.uint32) for c in rows["count"]])
        digest = np.repeat(np.concatenate([np.frombuffer(d, np.int64) for d in rows.digest]), count)
        size = np.repeat(np.concatenate([np.frombuffer(d, np.uint32) for d in rows.n]), count)
        order = np.argsort(grams)
        grams, digest, size = grams[order], digest[order], size[order]
        twice = np.zeros(len(grams), bool)
        same = grams[1:] == grams[:-1]
        twice[1:] |= same
        twice[:-1] |= same
        grams, digest, size = grams[twice], digest[twice], size[twice]
        order = np.lexsort((digest, grams))  # a class that several partitions sent counts once
        grams, digest, size = grams[order], digest[order], size[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (digest[1:] != digest[:-1])
        grams, digest, size = grams[new], digest[new], size[new]
        _, back, df = np.unique(grams, return_inverse=True, return_counts=True)
        df = df[back]
        keep = df > 1
        grams, digest, size, df = grams[keep] | np.uint64(int(key[0]) << GRAM_BITS - bits), digest[keep], size[keep], df[keep]
        return packed((digest.view(np.uint64) % np.uint64(parts)).astype(np.int64), digest, size, grams, df)

    return run


def _needed(n: np.ndarray | int, percent: int):
    """Least overlap of a set of n grams with any set it links to."""
    return -(-percent * n // 100)


def _candidates(percent: int):
    """Classes of one part that can link at all, with their shared grams in global order and their prefix."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        give_back()
        digest = np.concatenate([np.frombuffer(x, np.int64) for x in rows.digest])
        size = np.concatenate([np.frombuffer(x, np.uint32) for x in rows.n]).astype(np.int64)
        gram = np.concatenate([np.frombuffer(x, np.uint64) for x in rows.gram])
        df = np.concatenate([np.frombuffer(x, np.uint16) for x in rows.df])
        order = np.lexsort((gram, df, digest))
        digest, size, gram = digest[order], size[order], gram[order]
        start = np.flatnonzero(np.r_[True, digest[1:] != digest[:-1]])
        out = []
        for a, b in zip(start.tolist(), [*start[1:].tolist(), len(digest)], strict=True):
            n, held = int(size[a]), b - a
            if held < _needed(n, percent):
                continue
            prefix = held - _needed(n, percent) + 1  # its own grams stand before these, in the part of the prefix that matches nothing
            g, often = gram[a:b], df[a:b]
            keys = [int(np.int64(_mix(g, m + 1).min())) for m in range(MIN_HASHES)]
            out.append((int(digest[a]), n, g[:prefix].astype(np.int64).tolist(), g[::-1].tobytes() + often[::-1].tobytes(), keys))
        return pd.DataFrame(out, columns=["digest", "n", "prefix", "grams", "keys"])

    return run


class FlatTrie:
    """Sets in lexicographic order of their globally ordered grams, with common-prefix lengths: a trie laid flat."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        universe, flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.universe = universe
        ends = np.cumsum([len(s) for s in sets])
        dense = np.split(flat.astype(np.int32), ends[:-1])
        self.order = np.array(sorted(range(len(sets)), key=lambda i: dense[i].astype(">i4").tobytes()), int)
        self.rows = [dense[i] for i in self.order]
        self.sizes = sizes[self.order]
        self.common = np.zeros(len(sets), int)
        for i in range(1, len(self.rows)):
            a, b = self.rows[i - 1], self.rows[i]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            self.common[i] = differ[0] if len(differ) else m
        # the subtree that a row opens: the rows from it on that share more with it than the row before it does
        n = len(self.rows)
        self.end, self.longest, self.least = np.arange(1, n + 1), np.array([len(r) for r in self.rows]), self.sizes.copy()
        for i in range(n - 1, -1, -1):
            j = i + 1
            while j < n and self.common[j] > self.common[i]:
                self.longest[i] = max(self.longest[i], self.longest[j])
                self.least[i] = min(self.least[i], self.least[j])
                j = int(self.end[j])
            self.end[i] = j

    def mask(self, grams: np.ndarray) -> np.ndarray:
        """Which grams of the trie a set holds."""
        at = np.minimum(np.searchsorted(self.universe, grams), len(self.universe) - 1)
        hit = np.zeros(len(self.universe), bool)
        hit[at[self.universe[at] == grams]] = True
        return hit

    def walk(self, mask: np.ndarray, n: int, wanted: np.ndarray, percent: int) -> Iterator[int]:
        """Rows among ``wanted`` (ascending places in the trie) that link with a set of ``n`` grams.

        ``path[d]`` is the overlap of the first ``d`` grams of the row walked last; the part that the next row shares
        with it is not counted again. Where that partial overlap and all that remains of the longest row of a subtree stay
        under what the two sizes need, the walk goes on behind the subtree.
        """
        path, depth, last, k = np.zeros(1, np.int64), 0, -1, 0
        while k < len(wanted):
            i = int(wanted[k])
            if last >= 0:
                depth = min(depth, int(self.common[last + 1 : i + 1].min()))
            last = i
            if path[depth] + self.longest[i] - depth < -(-percent * (n + int(self.least[i])) // (100 + percent)):
                k = int(np.searchsorted(wanted, self.end[i]))
                continue
            k += 1
            row = self.rows[i]
            need = -(-percent * (n + int(self.sizes[i])) // (100 + percent))
            if path[depth] + len(row) - depth < need:
                continue
            path = np.concatenate([path[: depth + 1], path[depth] + np.cumsum(mask[row[depth:]])])
            depth = len(row)
            if path[depth] >= need:
                yield i


def block_links(digests: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links within one block as (digest, smallest digest of its tree), each set met with the NEAREST before it."""
    trie = FlatTrie(sets, sizes)
    ids, n = digests[trie.order], trie.sizes
    comp = np.arange(len(ids))
    for i in range(1, len(ids)):
        while True:
            other = np.flatnonzero((comp[:i] != comp[i]) & (100 * np.minimum(n[:i], n[i]) >= percent * np.maximum(n[:i], n[i])))
            if not len(other):
                break
            mask = np.zeros(len(trie.universe), bool)
            mask[trie.rows[i]] = True
            near = other if len(other) <= NEAREST else np.r_[other[: NEAREST // 2], other[-NEAREST // 2 :]]
            found = next(trie.walk(mask, int(n[i]), near, percent), None)
            if found is None:
                break
            a, b = comp[found], comp[i]
            comp[comp == max(a, b)] = min(a, b)
    out = []
    for c in np.unique(comp):
        held = ids[comp == c]
        if len(held) > 1:
            out += [(int(x), int(held.min())) for x in held if x != held.min()]
    return out


_EDGE = "a long, b long"


def _ranked(*frames: pd.DataFrame) -> list[np.ndarray]:
    """The frames' sets with grams numbered in the global order from its shared end, so that near copies share long paths."""
    parts = [x for f in frames for x in f.grams]
    sizes = [len(x) // 10 for x in parts]
    grams = np.concatenate([np.frombuffer(x, np.uint64, n) for x, n in zip(parts, sizes, strict=True)])
    df = np.concatenate([np.frombuffer(x, np.uint16, n, 8 * n) for x, n in zip(parts, sizes, strict=True)])
    universe, at, back = np.unique(grams, return_index=True, return_inverse=True)
    rank = np.empty(len(universe), np.uint64)
    rank[np.lexsort((universe, -df[at].astype(np.int64)))] = np.arange(len(universe), dtype=np.uint64)
    return [np.sort(x) for x in np.split(rank[back], np.cumsum(sizes)[:-1])]


def _first_links(percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in rows.groupby(["m", "key", "salt"], sort=False):
            g = g.drop_duplicates("digest")
            if len(g) > 1:
                out += block_links(g.digest.to_numpy(np.int64), g.n.to_numpy(np.int64), _ranked(g), percent)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _cross_links(percent: int):
    """Probes against the members of the units they may link to: within one component one link for a probe suffices, so a
    probe leaves a unit at its first link to a component, and meets all members of a pile."""

    def run(probes: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        give_back()
        out = []
        held = dict(tuple(members.groupby(["comp", "salt", "pblock"], sort=False)))
        for key, p in probes.groupby(["comp", "salt", "pblock"], sort=False):
            if key not in held:
                continue
            m = held[key]
            joint = _ranked(m, p)
            n, ids, pile = m.n.to_numpy(np.int64), m.digest.to_numpy(np.int64), bool(m.pile.iloc[0])
            trie = FlatTrie(joint[: len(m)], n)
            for probe, size, grams in zip(p.digest, p.n, joint[len(m) :], strict=True):
                wanted = np.flatnonzero((100 * np.minimum(trie.sizes, size) >= percent * np.maximum(trie.sizes, size)) & (ids[trie.order] != probe))
                for found in trie.walk(trie.mask(grams), int(size), wanted, percent):
                    out.append((int(probe), int(ids[trie.order[found]])))
                    if not pile:
                        break
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def document_classes(docs: DataFrame, n: int = 5) -> DataFrame:
    """``(doc_id, n, digest, often)``: set size and class of every document; digest is null where there are no words. Rows of
    size -1 are no documents: ``often`` lists grams that many classes of a partition hold, with their counts."""
    return docs.select("doc_id", "text").mapInArrow(_classes(n), "doc_id long, n long, digest long, often array<struct<gram:long,count:long>>")


def hot_grams(classes: DataFrame, total: int) -> np.ndarray:
    """Grams of ``document_classes`` that are not gathered by gram, at most ``2**HOT_SHARE`` of them."""
    least = max(HOT_POSTINGS, total >> HOT_SHARE)
    counts = classes.where("n < 0").select(F.explode("often").alias("o")).groupBy("o.gram").agg(F.sum("o.count").alias("c"))
    return np.sort(np.array([r.gram for r in counts.where(F.col("c") >= least).select("gram").collect()], np.uint64))


def link_components(docs: DataFrame, total: int, n: int = 5, percent: int = 75, hot: np.ndarray | None = None) -> DataFrame:
    """``(node long, comp long)`` over class digests that link with another class (see the module's docstring).

    ``total`` is the number of grams of all documents; buckets are as many as keep each to about BUCKET_GRAMS of them.
    ``hot`` grams (of ``hot_grams``) only travel another way.
    """
    bits = BUCKET_BITS
    while total >> bits > BUCKET_GRAMS:
        bits += 1
    parts = 1 << bits
    packed = docs.select("text").mapInArrow(_postings(n, bits, np.empty(0, np.uint64) if hot is None else hot), "bucket long, hi binary, lo binary, digest binary, n binary, count binary")
    shared = packed.groupBy("bucket").applyInPandas(_shared(bits, parts), "part long, digest binary, n binary, gram binary, df binary")
    able = cut(shared.groupBy("part").applyInPandas(_candidates(percent), "digest long, n long, prefix array<long>, grams binary, keys array<long>"), "able")
    bundles = max(16, able.count() // 1000)

    keyed = able.select("digest", F.posexplode("keys").alias("m", "key"))
    many = keyed.groupBy("m", "key").count().where("count > 1").select("m", "key", F.ceil(F.col("count") / BLOCK).cast("int").alias("salts"))
    block = keyed.join(many, ["m", "key"]).withColumn("salt", F.pmod(F.xxhash64("digest", "m"), "salts"))
    first = (block.join(able.select("digest", "n", "grams"), "digest")
             .withColumn("bundle", F.pmod(F.xxhash64("m", "key", "salt"), F.lit(bundles)))
             .select("bundle", "m", "key", "salt", "digest", "n", "grams")
             .groupBy("bundle").applyInPandas(_first_links(percent), _EDGE))
    first = cut(first, "first")
    comps = cut(components(first), "comps")

    # units: components of two or more classes, and piles of single classes that agree on a minimum hash
    sized = comps.groupBy("comp").agg(F.count("*").alias("size"))
    where = (able.select("digest", F.xxhash64(F.col("keys")[0]).alias("pile")).join(comps.withColumnRenamed("node", "digest"), "digest", "left")
             .join(sized, "comp", "left"))
    where = where.select("digest", F.coalesce("comp", "pile").alias("unit"), F.col("comp").isNull().alias("pile"))
    held = where.groupBy("unit").agg(F.count("*").alias("held"))
    where = cut(where.join(held, "unit"), "where")
    post = able.select("digest", "n", F.explode("prefix").alias("gram")).join(where, "digest")
    seen = post.groupBy("gram", "unit", "pile", "held").agg(F.count("*").alias("c"), F.min("n").alias("n_lo"), F.max("n").alias("n_hi"))
    seen = cut(seen, "seen")
    # a list with one unit that is a component has nothing left to compare
    open_ = seen.groupBy("gram").agg(F.count("*").alias("units"), F.max(F.col("pile") & (F.col("c") > 1)).alias("inner")).where("units > 1 or inner").select("gram")
    seen = seen.join(open_, "gram")
    to = seen.select("gram", F.col("unit").alias("to"), F.col("held").alias("to_held"), F.col("n_lo").alias("to_lo"), F.col("n_hi").alias("to_hi"))
    cross = (F.col("unit") != F.col("to")) & (F.struct("held", "unit") < F.struct(F.col("to_held").alias("held"), F.col("to").alias("unit")))
    own = (F.col("unit") == F.col("to")) & F.col("pile") & (F.col("c") > 1)
    pairs = (seen.join(to, "gram").where(cross | own)
             .where((100 * F.col("to_hi") >= percent * F.col("n_lo")) & (100 * F.col("n_hi") >= percent * F.col("to_lo")))
             .select("unit", "to", "to_held").distinct())
    probe = cut(where.select("digest", "unit").join(pairs, "unit").select("digest", F.col("to").alias("comp"), F.col("to_held").alias("held")), "probe")
    # both sides in blocks, each block of probes against each block of members
    blocks = probe.groupBy("comp").agg(F.count("*").alias("asked"), F.max("held").alias("held"))
    blocks = cut(blocks.select("comp", "asked", "held", F.ceil(F.col("held") / BLOCK).alias("salts"), F.ceil(F.col("asked") / BLOCK).alias("pblocks")), "blocks")
    sent = blocks.agg(F.sum(F.col("asked") * F.col("salts") + F.col("held") * F.col("pblocks"))).first()[0] or 0
    bundle = F.pmod(F.xxhash64("comp", "salt", "pblock"), F.lit(max(16, sent // 1000))).alias("bundle")
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    own_block = lambda c, seed: F.pmod(F.xxhash64("digest", F.lit(seed)), F.col(c))
    sets, at = able.select("digest", "n", "grams"), blocks.select("comp", "salts", "pblocks")
    left = (probe.select("digest", "comp").join(at, "comp").withColumn("pblock", own_block("pblocks", 1)).withColumn("salt", each("salts")).join(sets, "digest")
            .select(bundle, "comp", "salt", "pblock", "digest", "n", "grams"))
    right = (where.withColumnRenamed("unit", "comp").join(at, "comp").withColumn("salt", own_block("salts", 2)).withColumn("pblock", each("pblocks")).join(sets, "digest")
             .select(bundle, *(F.col(c).alias(c) for c in ("comp", "salt", "pblock", "pile", "digest", "n", "grams"))))
    cross = left.groupBy("bundle").cogroup(right.groupBy("bundle")).applyInPandas(_cross_links(percent), _EDGE)
    cross = cut(cross, "cross")
    if cross.isEmpty():
        return comps
    stars = comps.select(F.col("node").alias("a"), F.col("comp").alias("b"))
    return cut(components(stars.unionByName(cross)), "linked")


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row for each row of ``docs(doc_id, text, ...)``.

    Documents link when ``100 * overlap >= percent * union`` of their word n-gram sets; component_id is the smallest
    doc_id reachable. A text without words (or null) has size 0 and its own id. Repeated rows stay and link with each
    other; a null doc_id never names a component unless all of it is null. Further columns are ignored. Sets are
    compared by 54-bit hashes of their grams and classes by 64-bit digests.
    """
    every = cut(document_classes(docs, n), "classes")
    cls = every.where("n >= 0").select("doc_id", "n", "digest")
    total = cls.agg(F.sum("n")).first()[0] or 0
    links = link_components(docs, total, n, percent, hot_grams(every, total))
    root = cls.groupBy("digest").agg(F.min("doc_id").alias("low")).where("digest is not null")
    root = root.join(links.withColumnRenamed("node", "digest"), "digest", "left").withColumn("comp", F.coalesce("comp", "digest"))
    low = root.groupBy("comp").agg(F.min("low").alias("component_id"))
    named = root.select("digest", "comp").join(low, "comp").select("digest", "component_id")
    return cls.join(named, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
