"""Exact similarity components over sets of word shingles.

Texts with equal sets are one class. Classes meet in two ways, and every pair that
meets goes through the same tests: sizes, then the bits of hashed bitmap signatures,
whose difference bounds the overlap from above, then the exact intersection of the
sorted arrays.

1. Stars: classes that share one of the six smallest shingle hashes are tested with
   one of them, drawn for each hash. Classes that link form families.
2. Tiles: two sets can only link if their prefixes share a shingle, for any one order
   of all shingles (here: rare ones first, by a sketch of counts over all texts).
   Prefix shingles that only one class has are dropped, and in each pass those that
   only one family has; both are aggregated before the shuffle. The others' classes
   meet in tiles of shingle and size band, where all pairs of different families are tested by their
   bits. A tile of more than ``BLOCK`` classes is dealt out in blocks. In two passes
   each class looks in a few tiles, the same ones for similar classes, and brings its
   most promising partner, so that families grow together; the last pass takes all
   tiles and brings every pair that is left.

No link between different families is lost, and links inside a family don't change
the components. A shingle is a 64-bit hash, a class 64 bits of a digest.

The links themselves (``similarity_links``) follow from the components, as a link
never leaves one: the classes of a component are dealt into blocks, and two blocks
that share a prefix shingle meet in a cell, where every pair with a common prefix
shingle is tested by its exact sets. All of a pair's shingles lie in one cell, so it
is tested once.

Defined cases: a null text, or one without words, has an empty set and links with
nothing; a text of fewer words than a shingle is one shingle; rows equal in text
always link; rows without an id take part, but no component is named after them;
other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_scope
from . import hashing
from .common import Bitmap, bins_for, by_bin, packed, shared, slices, text_buffer
from .graph import components

SHINGLE = 5
#: Link when 100 * intersection >= PERCENT * union.
PERCENT = 75
STARS = 6
LOG2_SKETCH = 20
BLOCK = 2048
#: Classes of a component in each block of a cell.
CELL = 256
#: Shingles by which a class looks for its best partner in the passes before the last, which takes all of them.
GROWING = (6, 12)
#: First prefix shingles of a class that each of its rows carries, so that a pair is brought by the first tile it shares.
HEADS = 8
#: Classes, and postings, whose rows go to one bin on average.
CLASSES_A_BIN, POSTINGS_A_BIN = 2000, 50000
#: First size of each band; sizes that can link lie in the same band or in neighbouring ones.
BANDS = np.unique(np.ceil((4 / 3) ** np.arange(1, 160)).astype(np.float64))


def band_of(sizes: np.ndarray) -> np.ndarray:
    return np.searchsorted(BANDS, sizes, "right")


def shingle_sets(column: pa.Array, size: int = SHINGLE):
    """(row, sorted distinct shingle hashes) of each text, in order."""
    data, offsets = text_buffer(column)
    for a, b in slices(offsets):
        part, bounds = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = hashing.spans(part, bounds, hashing.WHITE)
        words = hashing.word_hashes(hashing.FOLD[part], starts, ends)
        grams = hashing.windows(words, size)
        for i in range(b - a):
            n = first[i + 1] - first[i]
            if n >= size:
                yield a + i, np.unique(grams[first[i] : first[i + 1] - size + 1])
            else:
                yield a + i, hashing.windows(words[first[i] : first[i + 1]], n) if n else np.zeros(0, np.uint64)


def node_of(found: np.ndarray) -> int:
    """The class of a set: 64 bits of a digest of its size and hashes."""
    if not len(found):
        return 0
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8, person=str(len(found)).encode()[:16]).digest(), "little", signed=True)


def signature(found: np.ndarray) -> bytes:
    """Parities of hashed places, twice as many as the set is large at least, as a power of two."""
    places = max(64, 1 << int(2 * len(found) - 1).bit_length()) if len(found) else 64
    odd = (np.bincount((found >> np.uint64(8)) & np.uint64(places - 1), minlength=places) & 1).astype(bool)
    return np.packbits(odd, bitorder="little").tobytes()


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Signatures (rows of bytes) folded to ``width`` bytes."""
    while bits.shape[-1] > width:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of bits that differ, row by row: at most the size of the symmetric difference."""
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)).sum(axis=-1, dtype=np.int64)


def may_link(differ: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether so many differing bits allow enough overlap; ``sizes``: sum of both set sizes."""
    return (sizes - differ) * (100 + PERCENT) >= 2 * PERCENT * sizes


def describe(documents: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, text_hash, none, node, n, stars, bits) of each row, and the level of each sketch cell, log2 of its count."""
    cells, step = 1 << LOG2_SKETCH, 1 << 14

    def run(batches):
        counts = np.zeros(cells, np.int64)
        for batch in batches:
            rows, seen = [], []
            for _, found in shingle_sets(batch.column(1)):
                rows.append((node_of(found), len(found), found[:STARS].view(np.int64), signature(found)))
                seen.append((found & np.uint64(cells - 1)).astype(np.int32))
                if len(seen) == 512:
                    counts += np.bincount(np.concatenate(seen), minlength=cells)
                    seen = []
            if seen:
                counts += np.bincount(np.concatenate(seen), minlength=cells)
            node, n, stars, bits = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), pa.compute.is_null(batch.column(1)), pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(list(stars), pa.list_(pa.int64())),
                    pa.array(bits, pa.binary()), pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary()),
                ],
                names=["doc_id", "text_hash", "none", "node", "n", "stars", "bits", "at", "counts"],
            )
        at = [k for k in range(0, cells, step) if counts[k : k + step].any()]
        none = len(at)
        yield pa.RecordBatch.from_arrays(
            [
                pa.nulls(none, pa.int64()), pa.nulls(none, pa.int64()), pa.nulls(none, pa.bool_()), pa.nulls(none, pa.int64()), pa.nulls(none, pa.int64()), pa.nulls(none, pa.list_(pa.int64())),
                pa.nulls(none, pa.binary()), pa.array(at, pa.int32()), pa.array([packed(np.uint32, counts[k : k + step]) for k in at], pa.binary()),
            ],
            names=["doc_id", "text_hash", "none", "node", "n", "stars", "bits", "at", "counts"],
        )

    schema = "doc_id long, text_hash long, none boolean, node long, n long, stars array<long>, bits binary, at int, counts binary"
    text = F.col("text").cast("string")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash")).mapInArrow(run, schema)
    rows = cut_lineage(rows, "sets")

    def merge(table):
        total = sum(np.frombuffer(x, np.uint32).astype(np.int64) for x in table["counts"].to_pylist())
        return pa.table({"at": table["at"][:1], "counts": pa.array([total.tobytes()], pa.binary())})

    counts = np.zeros(cells, np.int64)
    for r in rows.filter("at is not null").select("at", "counts").groupBy("at").applyInArrow(merge, "at int, counts binary").collect():
        counts[r.at : r.at + step] = np.frombuffer(r.counts, np.int64)
    return rows.filter("at is null").drop("at", "counts"), np.log2(counts + 1).astype(np.uint8)


def star_pairs(classes: DataFrame) -> DataFrame:
    """(a, b): each class with one other, drawn anew for each hash, that shares one of its smallest hashes."""
    tokens = classes.select("node", F.explode("stars").alias("token"))
    rank = F.struct(F.xxhash64("node", "token").alias("h"), F.col("node").alias("pivot"))
    centres = tokens.groupBy("token").agg(F.min(rank)["pivot"].alias("pivot"), F.count("*").alias("m")).filter("m > 1").drop("m")
    pairs = tokens.join(centres, "token").filter("node <> pivot")
    return pairs.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()


def bounded(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and signature bits allow a link."""
    of = lambda column, end, name: classes.select(F.col("node").alias(end), F.col(column).alias(name + end))
    rows = pairs.join(of("n", "a", "n"), "a").join(of("n", "b", "n"), "b")
    rows = rows.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT)
    rows = rows.join(of("bits", "a", "x"), "a").join(of("bits", "b", "x"), "b")

    def run(batches):
        for batch in batches:
            keep = []
            for na, xa, nb, xb in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                width = min(len(xa), len(xb))
                x, y = (folded(np.frombuffer(z, np.uint8), width) for z in (xa, xb))
                keep.append(bool(may_link(difference(x, y), np.int64(na + nb))))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.select("a", "b", "na", "xa", "nb", "xb").mapInArrow(run, "a long, b long")


def sets_of(documents: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, hashes): the packed set of each class in ``nodes`` (node), once; no other set moves.

    Of a class only texts with the hash of the one that stands for it are taken apart again.
    """
    wanted = cut_lineage(classes.select("node", "text_hash").join(nodes.distinct(), "node", "left_semi"), "wanted")
    chosen = shared(documents.sparkSession, Bitmap.of(wanted, "text_hash", 24))

    def sets(batches):
        known, sent = chosen(), set()
        for batch in batches:
            batch = batch.filter(pa.array(known.holds(batch.column(1).to_numpy().view(np.uint64))))
            nodes, found = [], []
            for _, s in shingle_sets(batch.column(0)):
                node = node_of(s)
                if len(s) and node not in sent:
                    sent.add(node)
                    nodes.append(node)
                    found.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(found, pa.binary())], names=["node", "hashes"])

    text = F.col("text").cast("string")
    found = documents.select(text.alias("text"), F.xxhash64(text).alias("h")).mapInArrow(sets, "node long, hashes binary").dropDuplicates(["node"])
    return cut_lineage(found.join(wanted, "node", "left_semi"), "found")


def linked(pairs: DataFrame, documents: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that link, by exact intersection. Only the sets of classes in a pair move."""
    pairs = cut_lineage(pairs, "pairs")

    def test(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= PERCENT * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    found = sets_of(documents, classes, ends)
    x = found.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    y = found.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(test, "a long, b long")


def prefixes(documents: DataFrame, levels: np.ndarray) -> DataFrame:
    """(node, n, tokens): the prefix of each set in the order of level and hash, packed; once per task and class."""
    table = shared(documents.sparkSession, levels)

    def run(batches):
        levels, sent = table(), set()
        for batch in batches:
            nodes, sizes, tokens = [], [], []
            for _, s in shingle_sets(batch.column(0)):
                node = node_of(s)
                if len(s) and node not in sent:
                    sent.add(node)
                    kept = len(s) - (-(-len(s) * PERCENT // 100)) + 1
                    order = np.argsort(levels[s & np.uint64(len(levels) - 1)], kind="stable")[:kept]
                    nodes.append(node)
                    sizes.append(len(s))
                    tokens.append(s[order].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(tokens, pa.binary())], names=["node", "n", "tokens"]
            )

    return documents.select(F.col("text").cast("string")).mapInArrow(run, "node long, n long, tokens binary").dropDuplicates(["node"])


def shared_tokens(prefix: DataFrame, bins: int) -> DataFrame:
    """(token): those in the prefixes of several classes. Each batch sends a token once, with a mark if it repeats there."""

    def send(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            token, times = np.unique(data[offsets[0] : offsets[-1]].view(np.uint64), return_counts=True)
            for b, part in by_bin({"token": token, "m": (times > 1).astype(np.uint8)}, "token", bins):
                yield pa.RecordBatch.from_pydict({"bin": pa.array([b], pa.int32()), "token": [part["token"].tobytes()], "m": [part["m"].tobytes()]})

    def find(table):
        token = np.frombuffer(b"".join(table["token"].to_pylist()), np.uint64)
        marked = np.frombuffer(b"".join(table["m"].to_pylist()), np.uint8) > 0
        order = np.argsort(token, kind="stable")
        ordered = token[order]
        again = np.concatenate([ordered[1:][ordered[1:] == ordered[:-1]], token[marked]])
        return pa.table({"token": pa.array(np.unique(again).view(np.int64), pa.int64())})

    rows = prefix.select("tokens").mapInArrow(send, "bin int, token binary, m binary")
    return rows.groupBy("bin").applyInArrow(find, "token long")


def postings(prefix: DataFrame, bins: int) -> DataFrame:
    """(node, n, token, band, turn) of every prefix shingle that several classes have; no other can ever bring two together.

    ``turn`` is the shingle's place by a hash among those of its class: similar classes share their first ones.
    """
    # written first: two Arrow functions in one stage would take two workers per core
    tokens = cut_lineage(shared_tokens(prefix, bins), "tokens")
    known = shared(prefix.sparkSession, Bitmap.of(tokens, "token"))

    def run(batches):
        bitmap = known()
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            token = data[offsets[0] : offsets[-1]].view(np.uint64)
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets) // 8)
            keep = bitmap.holds(token)
            token, row = token[keep], row[keep]
            order = np.lexsort((hashing.mix(token), row))
            token, row = token[order], row[order]
            turn = np.arange(len(row)) - np.searchsorted(row, row, "left")
            band = band_of(batch.column(1).to_numpy())[row]
            other = [batch.column(i).take(pa.array(row)) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*other, pa.array(token.view(np.int64)), pa.array(band, pa.int32()), pa.array(turn, pa.int32())], names=["node", "n", "token", "band", "turn"])

    return prefix.select("node", "n", "tokens").mapInArrow(run, "node long, n long, token long, band int, turn int")


def marked(posted: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, bits, heads): signature and first prefix shingles of each class that has any, packed in their order by ``turn``."""

    def pack(batches):
        for batch in batches:
            heads = [packed(np.int64, np.array([h["token"] for h in found], np.int64)) for found in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(heads, pa.binary())], names=["node", "heads"])

    heads = posted.filter(F.col("turn") < HEADS).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("turn", "token"))).alias("found"))
    return classes.select("node", "bits").join(heads.mapInArrow(pack, "node long, heads binary"), "node")


def first_met(token: np.ndarray, x: np.ndarray, y: np.ndarray, many: int) -> np.ndarray:
    """Whether ``token`` is the first shingle that two classes share, as far as their heads (packed, by ``many``) tell.

    If the heads share one, all tiles agree on the first of them, which both classes look in; if
    not, every tile counts as the first.
    """
    first, found = token.copy(), np.zeros(len(token), bool)
    for k in range(many):
        hit = ((y == x[:, k : k + 1]) & (y != 0)).any(axis=1) & ~found
        first[hit] = x[hit, k]
        found |= hit
    return first == token


def tile_pairs(posted: DataFrame, families: DataFrame, classes: DataFrame, bins: int, best: bool) -> DataFrame:
    """(a, b): classes of different families in one tile whose sizes and bits allow a link.

    ``classes`` are ``marked``. A pair comes from one tile, unless it only shares shingles behind its heads.
    With ``best`` only the most promising partner of each class, so never more pairs than classes.
    """
    rows = posted.join(families, "node")
    opened = rows.groupBy("token").agg(F.min("family").alias("f0"), F.max("family").alias("f1")).filter("f0 <> f1").select("token")
    rows = cut_lineage(rows.join(opened, "token", "left_semi"), "open")
    rows = rows.withColumn("tile", F.explode(F.array("band", F.col("band") + 1)))
    home = F.max(F.col("tile") == F.col("band"))
    sizes = rows.groupBy("token", "tile").agg(F.count("*").alias("m"), F.min("family").alias("f0"), F.max("family").alias("f1"), home.alias("home"))
    sizes = sizes.filter("home and f0 <> f1").select("token", "tile", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(sizes, ["token", "tile"])
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = rows.withColumn("block", block).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"low": F.least("block", "with"), "high": F.greatest("block", "with")})
    place = F.xxhash64("token", "tile", "low", "high")
    rows = rows.join(classes, "node")
    rows = rows.select(
        F.pmod(place, F.lit(bins)).cast("int").alias("bin"), place.alias("place"), "tile", "band",
        ((F.col("low") != F.col("high")).cast("int") * (1 + (F.col("block") == F.col("high")).cast("int"))).alias("side"),
        "family", "node", "n", "token", "bits", "heads",
    )

    def meet(table):
        tile = table["tile"].to_numpy()
        found = [_tile(table.filter(pa.array(tile == t))) for t in np.unique(tile)]
        pairs, differ = (np.concatenate(x) for x in zip(*found))
        if best:
            either = np.concatenate([pairs[:, 0], pairs[:, 1]])
            order = np.lexsort((np.concatenate([differ, differ]), either))
            kept = np.unique(order[np.unique(either[order], return_index=True)[1]] % max(1, len(pairs)))
        else:
            kept = np.unique(pairs, axis=0, return_index=True)[1]
        pairs, differ = pairs[kept], differ[kept]
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64()), "differ": pa.array(differ, pa.float64())})

    found = rows.groupBy("bin").applyInArrow(meet, "a long, b long, differ double")
    if best:
        # one row for each class and bin at most; the partner of each class is chosen over all of them
        found = cut_lineage(found, "met")
        ends = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "differ"))
        partner = F.min(F.struct("differ", F.col("b").alias("to")))["to"]
        found = ends.groupBy("a").agg(partner.alias("to")).select(F.least("a", "to").alias("a"), F.greatest("a", "to").alias("b"))
    return found.select("a", "b").distinct()


def _tile(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of all tiles of one size band, and the share of bits that differ: place by place, each row with the next, the one after that, and so on.

    ``side`` tells the two blocks of a tile apart (0 if there is only one); rows of
    one block meet in a tile of their own. Two rows of the band below meet there.
    """
    place, band, side, family, node, n, token = (table[c].to_numpy() for c in ("place", "band", "side", "family", "node", "n", "token"))
    order = np.argsort(place, kind="stable")
    place, band, side, family, node, n, token = (x[order] for x in (place, band, side, family, node, n, token))
    heads = np.stack([np.pad(np.frombuffer(h, np.int64), (0, HEADS - len(h) // 8)) for h in table["heads"].to_pylist()])[order]
    guest = band < table["tile"][0].as_py()
    bits = table["bits"].to_pylist()
    width = min(map(len, bits))
    bits = np.stack([folded(np.frombuffer(bits[i], np.uint8), width) for i in order])
    out, differ = [np.zeros((0, 2), np.int64)], [np.zeros(0)]
    for lag in range(1, len(place)):
        i = np.flatnonzero(place[lag:] == place[:-lag])
        if not len(i):
            break
        j = i + lag
        keep = (family[i] != family[j]) & ~(guest[i] & guest[j]) & ((side[i] == 0) | (side[i] != side[j]))
        keep &= np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * PERCENT
        i, j = i[keep], j[keep]
        for at in range(0, len(i), 1 << 16):
            x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            d = difference(bits[x], bits[y])
            ok = np.flatnonzero(may_link(d, n[x] + n[y]))
            ok = ok[first_met(token[x[ok]], heads[x[ok]], heads[y[ok]], HEADS)]
            differ.append(d[ok] / (n[x] + n[y])[ok])
            x, y = node[x[ok]], node[y[ok]]
            out.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
    return np.concatenate(out), np.concatenate(differ)


def merged(families: DataFrame, links: DataFrame) -> DataFrame:
    """(node, family) after joining the families that the links (a, b) of classes connect; kept beyond the scratch scope."""
    family = lambda end: families.select(F.col("node").alias(end), F.col("family").alias(f"f{end}"))
    ends = links.join(family("a"), "a").join(family("b"), "b").select(F.col("fa").alias("a"), F.col("fb").alias("b"))
    roots = components(ends).withColumnRenamed("node", "family")
    return cut_lineage(families.join(roots, "family", "left").select("node", F.coalesce("root", "family").alias("family")), "families", outlives=True)


def inner_links(posted: DataFrame, families: DataFrame, classes: DataFrame, documents: DataFrame, bins: int) -> DataFrame:
    """(a, b), a < b: every pair of classes that link, once. The families must be whole components."""
    blocks = families.groupBy("family").agg(F.ceil(F.count("*") / CELL).cast("int").alias("blocks"), F.count("*").alias("m")).filter("m > 1")
    rows = posted.select("node", "token").join(families, "node").join(blocks.drop("m"), "family")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    with_ = rows.groupBy("token", "family").agg(F.collect_set("block").alias("present"), F.min("node").alias("n0"), F.max("node").alias("n1"))
    with_ = with_.filter("n0 <> n1").drop("n0", "n1")
    rows = rows.join(with_, ["token", "family"]).withColumn("with", F.explode("present"))
    cell = F.xxhash64("family", F.least("block", "with"), F.greatest("block", "with"))
    side = (F.col("block") != F.col("with")).cast("int") * (1 + (F.col("block") > F.col("with")).cast("int"))
    rows = rows.select(F.pmod(cell, F.lit(bins)).cast("int").alias("bin"), cell.alias("cell"), side.alias("side"), "token", "node")
    rows = cut_lineage(rows, "cells")
    ends = rows.select(F.col("bin").alias("to"), "node").distinct()
    sets = sets_of(documents, classes, ends.select("node")).join(ends, "node").select("to", "node", "hashes")

    def meet(cells, found):
        known = {k.as_py(): np.frombuffer(v.as_buffer(), np.uint64) for k, v in zip(found["node"], found["hashes"])}
        cell = cells["cell"].to_numpy()
        order = np.argsort(cell, kind="stable")
        cell, side, token, node = cell[order], *(cells[c].to_numpy()[order] for c in ("side", "token", "node"))
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else []
        out = [np.zeros((0, 2), np.int64)]
        for low, high in zip(starts, [*starts[1:], len(cell)]):
            out.append(_cell(side[low:high], token[low:high], node[low:high], known))
        pairs = np.concatenate(out)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    return rows.groupBy("bin").cogroup(sets.groupBy("to")).applyInArrow(meet, "a long, b long")


def _cell(side: np.ndarray, token: np.ndarray, node: np.ndarray, known: dict[int, np.ndarray]) -> np.ndarray:
    """The linked pairs of a cell among those with a common token; two blocks only meet each other."""
    names, node = np.unique(node, return_inverse=True)
    sizes = np.array([len(known[x]) for x in names.tolist()])
    order = np.argsort(token, kind="stable")
    side, token, node = side[order], token[order], node[order]
    met = np.zeros((len(names), len(names)), bool)
    for lag in range(1, len(token)):
        i = np.flatnonzero(token[lag:] == token[:-lag])
        if not len(i):
            break
        i = i[(side[i] == 0) | (side[i] != side[i + lag])]
        met[np.minimum(node[i], node[i + lag]), np.maximum(node[i], node[i + lag])] = True
    met &= np.minimum.outer(sizes, sizes) * 100 >= np.maximum.outer(sizes, sizes) * PERCENT
    np.fill_diagonal(met, False)
    out = [np.zeros((0, 2), np.int64)]
    for i in np.flatnonzero(met.any(axis=1)):
        partners = np.flatnonzero(met[i])
        own, others = known[int(names[i])], np.concatenate([known[x] for x in names[partners].tolist()])
        hit = own[np.minimum(np.searchsorted(own, others), len(own) - 1)] == others
        common = np.add.reduceat(hit.astype(np.int64), np.r_[0, np.cumsum(sizes[partners])[:-1]])
        partners = partners[100 * common >= PERCENT * (sizes[i] + sizes[partners] - common)]
        out.append(np.stack([np.full(len(partners), names[i]), names[partners]], axis=1))
    return np.concatenate(out)


def similarity_components(documents: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row; the component is named by its smallest doc_id."""
    with scratch_scope(documents.sparkSession, "jaccard"):
        rows, _, _, families = _components(documents)
        return cut_lineage(_named(rows, families).select("doc_id", "n_shingles", "component_id"), "components", outlives=True)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A key of a row's id and text, which rows equal in both share; ids and texts may be null."""
    own = F.col(doc_id).cast("long").cast("string")
    return F.concat_ws("-", F.coalesce(own, F.lit("~")), F.hex(F.xxhash64(F.col(text).cast("string"))), F.col(text).isNull().cast("string"))


def representatives(documents: DataFrame) -> DataFrame:
    """(key): of each component the ``row_key`` of one row, the smallest by id (null last) and key; every row without words stands alone."""
    with scratch_scope(documents.sparkSession, "jaccard"):
        rows, _, _, families = _components(documents)
        hashed = F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), F.hex("text_hash"), F.col("none").cast("string"))
        rows = rows.withColumn("key", hashed).join(families, "node", "left")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "key"))["key"]
        heads = rows.filter("family is not null").groupBy("family").agg(first.alias("key")).select("key")
        alone = rows.filter("family is null").select("key")
        return cut_lineage(heads.unionByName(alone).distinct(), "heads", outlives=True)


def similarity_links(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The whole join: the linked pairs of classes, and each row with its class and number of links.

    The pairs are (class_a, class_b), each once, the smaller name first; a class is
    named by its smallest doc_id, and has a null name if no row of it has an id. The
    rows are (doc_id, n_shingles, component_id, class_id, n_links), where n_links counts
    the other rows that the row links with, those of its own class among them.
    """
    with scratch_scope(documents.sparkSession, "jaccard"):
        rows, described, posted, families = _components(documents)
        with scratch_scope(documents.sparkSession, "cells"):
            links = cut_lineage(inner_links(posted, families, described, documents, bins_for(posted, POSTINGS_A_BIN)), "links", outlives=True)
        classes = cut_lineage(rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("m")), "named")
        of = lambda end: classes.select(F.col("node").alias(end), F.col("class_id").alias(f"c{end}"))
        pairs = links.join(of("a"), "a").join(of("b"), "b")
        class_b = F.when(F.col("ca").isNotNull() & F.col("cb").isNotNull(), F.greatest("ca", "cb"))
        pairs = pairs.select(F.least("ca", "cb").alias("class_a"), class_b.alias("class_b"))
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.join(classes.select(F.col("node").alias("b"), "m"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("m").alias("near"))
        members = _named(rows, families).join(classes, "node", "left").join(near, "node", "left")
        n_links = F.coalesce(F.col("m") - 1, F.lit(0)) + F.coalesce("near", F.lit(0))
        class_id = F.when(F.col("n_shingles") > 0, F.col("class_id")).otherwise(F.col("doc_id"))
        members = members.select("doc_id", "n_shingles", "component_id", class_id.alias("class_id"), n_links.alias("n_links"))
        return cut_lineage(pairs, "class_pairs", outlives=True), cut_lineage(members, "members", outlives=True)


def _components(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The rows as described, the classes, the postings, and the component of each class as its family."""
    spark = documents.sparkSession
    rows, levels = describe(documents)
    firsts = [F.first(c).alias(c) for c in ("text_hash", "n", "stars", "bits")]
    classes = cut_lineage(rows.filter("n > 0").groupBy("node").agg(*firsts), "classes")
    families = classes.select("node", F.col("node").alias("family"))
    # what only one pass reads goes when the families of that pass are written
    with scratch_scope(spark, "stars"):
        families = merged(families, linked(bounded(star_pairs(classes), classes), documents, classes))
    with scratch_scope(spark, "prefixes"):
        prefix = cut_lineage(prefixes(documents, levels), "prefix")
        posted = cut_lineage(postings(prefix, bins_for(classes, CLASSES_A_BIN)), "postings", outlives=True)
        marks = cut_lineage(marked(posted, classes), "marks", outlives=True)
    bins = bins_for(posted, POSTINGS_A_BIN)
    for turns in (*GROWING, None):
        with scratch_scope(spark, "tiles"):
            some = posted.filter(F.col("turn") < turns) if turns else posted
            families = merged(families, linked(tile_pairs(some, families, marks, bins, turns is not None), documents, classes))
    return rows, classes, posted, families


def _named(rows: DataFrame, families: DataFrame) -> DataFrame:
    """(node, doc_id, n_shingles, component_id) of each row."""
    rows = rows.join(families, "node", "left")
    names = rows.filter("family is not null").groupBy("family").agg(F.min("doc_id").alias("component_id"))
    rows = rows.join(names, "family", "left")
    return rows.select("node", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
