"""N-gram Jaccard join: universe-partition pigeonhole with exact verification.

A text's set holds its distinct n-word shingles (64-bit hashes). Two sets link
when their Jaccard similarity reaches num/den; then they differ in at most
D = (|a| + |b|) * (den - num) / (den + num) shingles. Sizes are cut into bands,
and the shingle universe into m segments per band by a hash. By the pigeonhole
principle a linked pair agrees on a whole segment, or on a segment but for one
shingle where the one-deletion neighbourhood of the segment is indexed as well.
How many segments a band gets, how many of them with deletions, and how many
empty segments a set may leave out is chosen by a cost model that knows the
band's row count.

Order of work: equal sets are one node; nodes that share a signature hang on
the best connected node of that signature, those pairs are verified, and
components form. Only signatures whose nodes still lie in several components go
on: their nodes are compared in blocks of bounded size by size and parity
sketch (both exact bounds), never as emitted pairs, and what passes is verified.
So no link between components is lost, and links inside one need not be listed.
``join_links`` compares all nodes of every shared signature in such blocks and
lists every link between different sets; copies are given by membership.
``join_counts`` gives the class and the number of links per row instead.

Rules for odd input: null, empty and blank texts have the empty set and link
with nothing; a text of fewer than n words is one shingle; rows without doc_id
link like others (a component none of whose rows has one has no component_id);
rows with one doc_id and different texts are nodes of their own; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekrank.llm import common
from seekrank.llm.components import components

#: Text turned into sets at once inside a task.
SLICE_BYTES = 2 << 20
#: Nodes of one signature that are compared as one block, and bytes of their parity sketches, at most.
BLOCK, BLOCK_BYTES = 2048, 2 << 20
#: Cost model: one verification against one signature row; the share of shingles that unrelated texts have in common.
VERIFY_COST, COMMON_SHARE = 20.0, 1e-3
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (one to one)."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Measure:
    """Shingle length and similarity num/den."""

    n: int = 3
    num: int = 90
    den: int = 100

    def most_apart(self, total):
        """Largest symmetric difference of a linked pair with ``total`` shingles in both sets."""
        return total * (self.den - self.num) // (self.den + self.num)

    def links(self, common_n: int, a: int, b: int) -> bool:
        return a + b > 0 and self.den * common_n >= self.num * (a + b - common_n)

    def least_partner(self, size):
        return -(-size * self.num // self.den)


class Sets:
    """The shingle sets of texts: hashes by text (``of``), sorted and distinct, with sizes and starts."""

    def __init__(self, texts: list[str | None], n: int):
        words = common.Words([(t or "").encode() for t in texts], plain=True)
        counts, keys = words.counts, words.keys
        begin = np.cumsum(counts) - counts
        hashes, owners = [], []
        for w in range(1, n + 1):  # w < n: short texts as a whole; w = n: the runs
            picked = np.flatnonzero(counts >= n) if w == n else np.flatnonzero(counts == w)
            runs = counts[picked] - w + 1
            at = common.spread(begin[picked], runs)
            h = np.full(len(at), w, np.uint64)
            for k in range(w):
                h = mix(h * _M1 + keys[at + k])
            hashes.append(h)
            owners.append(np.repeat(picked, runs))
        h, of = np.concatenate(hashes), np.concatenate(owners).astype(np.uint16)
        order = np.argsort(h)
        order = order[np.argsort(of[order], kind="stable")]
        h, of = h[order], of[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])] if len(h) else np.zeros(0, bool)
        self.h, self.of = h[new], of[new].astype(np.int64)
        self.size = np.bincount(self.of, minlength=len(texts))
        self.start = np.cumsum(self.size) - self.size

    def sums(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.size), np.uint64)
        np.add.at(out, self.of, values)
        return out

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit names of each set."""
        return mix(self.sums(mix(self.h)) + self.size.astype(np.uint64)), mix(self.sums(mix(self.h ^ _M3)) ^ _M1)

    def parity(self, measure: "Measure") -> list[bytes]:
        """Per set, bits that each hold the parity of the shingles falling on it.

        Two sets differ in at least as many shingles as bits. There are a power
        of two of bits, at least four times the difference allowed, so that unlike sets
        of any size show more differing bits than that.
        """
        need = np.maximum(256, 4 * measure.most_apart(2 * self.size))
        width = np.ceil(np.log2(need)).astype(np.int64)
        start = np.cumsum(1 << width) - (1 << width)
        at = start[self.of] + (self.h >> (np.uint64(64) - width[self.of].astype(np.uint64))).astype(np.int64)
        bits = np.packbits(np.bincount(at, minlength=int((1 << width).sum())).astype(np.uint8) & 1).tobytes()
        return [bits[o // 8: (o + (1 << w)) // 8] for o, w in zip(start, width)]

    def row(self, i: int) -> np.ndarray:
        return self.h[self.start[i]: self.start[i] + self.size[i]]


@dataclass(frozen=True)
class Band:
    """Sizes low..high; segments 0..deletions-1 of ``segments`` are indexed with their one-deletion neighbourhoods.

    segments + deletions = D + 1 + slack: a set may leave out empty segments up
    to the slack and still has enough segments for the pigeonhole.
    """

    low: int
    high: int
    segments: int
    deletions: int
    slack: int


def allocate(measure: Measure, low: int, high: int, rows: int) -> Band:
    """The cheapest sound allocation for a band with ``rows`` sets."""
    apart = measure.most_apart(high + high * measure.den // measure.num)
    best = None
    for deletions in range(0, min(3, apart + 1) + 1):
        for slack in range(0, 13):
            m = apart + 1 + slack - deletions
            if m < max(1, deletions):
                continue
            g = low / m
            lost = m * math.exp(-g)
            over = 1 - sum(math.exp(-lost) * lost ** i / math.factorial(i) for i in range(slack + 1))
            emitted = m * (1 - math.exp(-g)) + deletions * g
            chance = m * math.exp(-2 * g) * (min(1.0, g * g * COMMON_SHARE) + max(0.0, over) ** 2)
            cost = emitted + VERIFY_COST * rows * chance
            if best is None or cost < best[0]:
                best = (cost, Band(low, high, m, deletions, slack))
    return best[1]


def band_edges(largest: int) -> list[int]:
    """First sizes of the bands, each 1.4 times the one before."""
    edges = [1]
    while edges[-1] <= largest:
        edges.append(max(edges[-1] + 1, math.ceil(edges[-1] * 1.4)))
    return edges


def signatures(sets: Sets, bands: list[Band], measure: Measure) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set number) rows: each set under its own band and those its smaller partners may be in."""
    edges = np.array([b.low for b in bands])
    own = np.searchsorted(edges, sets.size, "right") - 1
    least = np.searchsorted(edges, measure.least_partner(sets.size), "right") - 1
    out_sig, out_set = [], []
    for j in np.unique(np.r_[own, least]):
        if j < 0:
            continue
        band, sel = bands[j], np.flatnonzero((least <= j) & (j <= own) & (sets.size > 0))
        if not len(sel):
            continue
        m = band.segments
        at = common.spread(sets.start[sel], sets.size[sel])
        h = sets.h[at]
        spot = mix(h + np.full(1, j + 1, np.uint64) * _M1) >> np.uint64(32)
        seg = ((spot * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
        cell = np.repeat(np.arange(len(sel)), sets.size[sel]) * m + seg
        value = mix(h ^ _M2)
        total = np.zeros(len(sel) * m, np.uint64)
        np.add.at(total, cell, value)
        count = np.bincount(cell, minlength=len(total))
        salt = mix(np.full(m, j + 1, np.uint64) * _M3 + np.arange(m, dtype=np.uint64))
        grid = count.reshape(-1, m)
        lost = (grid[:, band.deletions:] == 0).sum(1) + np.maximum(0, 2 - grid[:, : band.deletions]).sum(1)
        over = np.repeat(lost > band.slack, m)
        whole = np.flatnonzero((count > 0) | over)
        out_sig.append(mix(total[whole] + salt[whole % m]))
        out_set.append(sel[whole // m])
        if band.deletions:
            near = np.flatnonzero((seg < band.deletions) & ((count[cell] > 1) | over[cell]))
            out_sig.append(mix(total[cell[near]] - value[near] + salt[seg[near]]))
            out_set.append(sel[cell[near] // m])
    if not out_sig:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out_sig), np.concatenate(out_set)


_SETS = "doc_id long, text_key binary, n_shingles long, f long, g long, p binary"


def _describe(measure: Measure):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, limit=SLICE_BYTES):
            sets = Sets(b.column("text").to_pylist(), measure.n)
            f, g = sets.names()
            yield pa.record_batch({"doc_id": b.column("doc_id"), "text_key": b.column("text_key"), "n_shingles": pa.array(sets.size), "f": pa.array(f.view(np.int64)),
                                   "g": pa.array(g.view(np.int64)), "p": pa.array(sets.parity(measure), pa.binary())})
    return run


def folded(bits: list[bytes]) -> np.ndarray:
    """Parities of different widths brought to the least one (neighbouring bits meet), as rows of 64-bit words."""
    least = min(map(len, bits))

    def fold(p: bytes) -> bytes:
        if len(p) == least:
            return p
        return np.packbits(np.unpackbits(np.frombuffer(p, np.uint8)).reshape(8 * least, -1).sum(1) & 1).tobytes()
    return np.frombuffer(b"".join(map(fold, bits)), np.uint64).reshape(len(bits), -1)


def _index(measure: Measure, bands: list[Band]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, limit=SLICE_BYTES):
            sets = Sets(b.column("text").to_pylist(), measure.n)
            sig, of = signatures(sets, bands, measure)
            yield pa.record_batch({"sig": pa.array(sig.view(np.int64)), "f": pa.array(sets.names()[0].view(np.int64)[of])})
    return run


def _elements(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, limit=SLICE_BYTES):
            sets = Sets(b.column("text").to_pylist(), n)
            f, g = (x.view(np.int64) for x in sets.names())
            yield pa.record_batch({"f": pa.array(f), "g": pa.array(g), "elements": pa.array([sets.row(i).tobytes() for i in range(b.num_rows)], pa.binary())})
    return run


def _verify(measure: Measure):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                keep.append(measure.links(len(np.intersect1d(u, v, assume_unique=True)), len(u), len(v)))
            yield b.drop_columns(["x", "y"]).filter(pa.array(keep, pa.bool_()))
    return run


def _pairs_pass(measure: Measure):
    """Keeps the pairs (a, b; na, nb, pa, pb) whose differing bits allow a link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for n, x, y in zip((b.column("na").to_numpy() + b.column("nb").to_numpy()).tolist(), b.column("pa").to_pylist(), b.column("pb").to_pylist()):
                u, v = folded([x, y])
                keep.append(int(np.bitwise_count(u ^ v).sum()) <= measure.most_apart(n))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _compare_blocks(measure: Measure):
    """Rows hold the nodes of one signature (or of two of its blocks); yields the pairs that size and parity let pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = [], []
            for nodes in b.column("nodes"):
                t = nodes.values
                node, root = t.field("node"), t.field("root")
                label = root.dictionary_encode().indices.to_numpy()
                size = t.field("n_shingles").to_numpy()
                side = t.field("side").to_numpy()
                bits = folded(t.field("p").to_pylist())
                one_block = (side == 0).all()
                first = np.flatnonzero(side == 0)
                second = first if one_block else np.flatnonzero(side == 1)
                for lo in range(0, len(first), 256):
                    i = first[lo: lo + 256]
                    total = size[i][:, None] + size[second][None, :]
                    ok = (label[i][:, None] != label[second][None, :]) & (np.minimum(size[i][:, None], size[second][None, :]) >= measure.least_partner(np.maximum(size[i][:, None], size[second][None, :])))
                    if one_block:
                        ok &= i[:, None] < second[None, :]
                    a, c = np.nonzero(ok)
                    fits = np.zeros(len(a), bool)
                    for at in range(0, len(a), 65_536):
                        own = slice(at, at + 65_536)
                        apart = np.bitwise_count(bits[i[a[own]]] ^ bits[second[c[own]]]).sum(1, dtype=np.int64)
                        fits[own] = apart <= measure.most_apart(total[a[own], c[own]])
                    left.append(node.take(pa.array(i[a[fits]])))
                    right.append(node.take(pa.array(second[c[fits]])))
            none = pa.array([], pa.binary())
            yield pa.record_batch({"a": pa.concat_arrays([*left, none]), "b": pa.concat_arrays([*right, none])})
    return run


def _node(f: str = "f", g: str = "g"):
    """The 128-bit name of a set."""
    return F.unhex(F.concat(F.lpad(F.hex(f), 16, "0"), F.lpad(F.hex(g), 16, "0")))


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, measure: Measure) -> DataFrame:
    """The linked pairs (a, b) among ``pairs``, by the sets themselves.

    The sets are built again for the texts needed: a fixed-size mark set skips
    the others before the exact join on the representative row.
    """
    need = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct().join(nodes.select("node", "rep"), "node").select("rep").distinct()
    rows = common.Marks(need).filter(docs.select("doc_id", representative(text_key()).alias("rep"), "text"), "rep").join(need, "rep")
    texts = rows.filter("doc_id is not null").select("text").unionByName(rows.filter("doc_id is null").select("text").distinct())
    sets = texts.mapInArrow(_elements(measure.n), "f long, g long, elements binary")
    sets = common.staged(sets.select(_node().alias("node"), "elements").dropDuplicates(["node"]), "sets")
    full = (pairs.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("elements").alias("y")), "b").select("a", "b", "x", "y"))
    return full.mapInArrow(_verify(measure), "a binary, b binary")


def text_key():
    """The 128-bit name of a row's text; of no bytes for a null text."""
    return F.coalesce(F.unhex(F.md5("text")), F.unhex(F.lit("")))


def representative(key: Column) -> Column:
    """Which rows can stand for a set: those of a doc_id, else those of a text (by its key)."""
    return F.coalesce(F.col("doc_id"), F.xxhash64(key))


def blocks_needed(measure: Measure) -> Column:
    """Into how many blocks the nodes of a group (n_shingles) are dealt, so that none holds more than BLOCK nodes or BLOCK_BYTES."""
    apart = F.floor(2 * F.col("n_shingles") * (measure.den - measure.num) / (measure.den + measure.num))
    width = F.greatest(F.lit(256), 4 * apart) / 4  # bytes of a parity sketch: its bits are less than twice as many as needed
    return F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(width) / BLOCK_BYTES)).cast("int")


def _members(docs: DataFrame, measure: Measure) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The named sets of all rows, their nodes (distinct sets that aren't empty), and the nodes of every shared signature."""
    sets = common.staged(docs.withColumn("text_key", text_key()).mapInArrow(_describe(measure), _SETS), "set-names").withColumn("node", _node())
    nodes = sets.filter("n_shingles > 0").groupBy("node", "f", "n_shingles", "p").agg(
        F.min("doc_id").alias("doc_id"), F.coalesce(F.min("doc_id"), F.min(representative(F.col("text_key")))).alias("rep"))

    # bands and their cost-based allocation, from the sizes of all sets (one count per band comes back)
    largest = sets.agg(F.max("n_shingles")).first()[0] or 0
    edges = band_edges(largest)
    number = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("n_shingles")))
    rows = {r[0]: r[1] for r in sets.filter("n_shingles > 0").groupBy(number.alias("band")).count().collect()}
    bands = [allocate(measure, lo, hi - 1, rows.get(i + 1, 0)) for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:]))]

    index = common.staged(docs.select("text").mapInArrow(_index(measure, bands), "sig long, f long"), "signatures")
    shared = common.staged(index.groupBy("sig").agg(F.min("f").alias("lo"), F.max("f").alias("hi")).filter("lo < hi").select("sig"), "shared")
    member = common.Marks(shared).filter(index, "sig").join(shared, "sig").distinct()
    member = common.staged(member.join(nodes.select("f", "node", "n_shingles"), "f").select("sig", "node", "n_shingles"), "members")
    return sets, nodes, member


def _passed(dealt_from: DataFrame, open_sigs: DataFrame, nodes: DataFrame, measure: Measure) -> DataFrame:
    """The pairs (a, b) of nodes with different roots in one of the signatures (sig, blocks) that size and parity let pass."""
    k = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = dealt_from.join(open_sigs, "sig").join(nodes.select("node", "p"), "node").withColumn("k", k).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    fields = F.struct("node", "root", "n_shingles", "p", (F.col("k") > F.least("k", "other")).cast("int").alias("side"))
    blocks = dealt.groupBy("sig", F.least("k", "other").alias("i"), F.greatest("k", "other").alias("j")).agg(F.collect_list(fields).alias("nodes"))
    passed = blocks.select("nodes").mapInArrow(_compare_blocks(measure), "a binary, b binary")
    return common.staged(passed.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "passed", batch="8m")


def join_links(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """Every link between different sets, and which rows hold which set.

    links: a, b (set names, a > b), a_doc_id, b_doc_id (smallest doc_id of each).
    membership: doc_id, n_shingles, node (set name) per row; null for the empty
    set. Two rows link when their sets are one or linked. There are as many rows
    as linked pairs.
    """
    measure = Measure(n, num, den)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets, nodes, member = _members(docs, measure)
    sigs = member.groupBy("sig").agg(F.count("*").alias("n"), blocks_needed(measure).alias("blocks")).filter("n > 1").select("sig", "blocks")
    passed = _passed(member.withColumn("root", F.col("node")), common.staged(sigs, "link-signatures"), nodes, measure)
    links = common.staged(verified(passed, nodes, docs, measure), "links", batch="8m")
    for c in "ab":
        links = links.join(nodes.select(F.col("node").alias(c), F.col("doc_id").alias(f"{c}_doc_id")), c)
    return links.select("a", "b", "a_doc_id", "b_doc_id"), sets.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node"))


def join_counts(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, class_id, n_links per row: the class, and with how many different sets the row's set links.

    Copies have one set, so a row's links to other texts are counted once per
    text; class_id is the name of a set of the class, null for the empty set.
    """
    links, membership = join_links(docs, n, num, den)
    links = common.staged(links.select("a", "b"), "all-links", batch="8m")
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    classes = degree.join(components(links), "node")
    return membership.join(classes, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("root", "node").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def rooted(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, text_key, n_shingles, root per row; rows of one component have one root (no meaning for empty sets)."""
    measure = Measure(n, num, den)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets, nodes, member = _members(docs, measure)

    # every node of a signature against the one that shares most signatures
    degree = member.groupBy("node").agg(F.count("*").alias("degree"))
    centre = common.staged(member.join(degree, "node").groupBy("sig").agg(F.max(F.struct("degree", "node", "n_shingles")).alias("y")), "centres")
    small, large = F.least("n_shingles", "y.n_shingles"), F.greatest("n_shingles", "y.n_shingles")
    pairs = (member.join(centre, "sig").filter((F.col("node") != F.col("y.node")) & (small * den >= large * num))
             .select(F.greatest("node", "y.node").alias("a"), F.least("node", "y.node").alias("b")).distinct())
    sized = nodes.select("node", "n_shingles", "p")
    for c in "ab":
        pairs = pairs.join(sized.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("p").alias(f"p{c}")), c)
    pairs = pairs.mapInArrow(_pairs_pass(measure), "a binary, b binary")
    links = common.staged(verified(common.staged(pairs, "pairs", batch="8m"), nodes, docs, measure), "links", batch="8m")
    roots = common.staged(components(links), "roots")

    # signatures whose nodes still lie in several components, in blocks
    open_member = member.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_sigs = (open_member.groupBy("sig").agg(F.count("*").alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1"), blocks_needed(measure).alias("blocks"))
                 .filter("n > 2 and r0 <> r1").select("sig", "blocks"))
    open_sigs = common.staged(open_sigs, "open-signatures")  # as a table, so that a join with a hot signature can be split
    passed = _passed(open_member, open_sigs, nodes, measure)
    more = common.staged(verified(passed, nodes, docs, measure), "links", batch="8m")
    if not more.isEmpty():
        roots = common.staged(components(links.unionByName(more)), "roots")

    return sets.join(roots, "node", "left").select("doc_id", "text_key", "n_shingles", F.coalesce("root", "node").alias("root"))


def join_components(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id per row: the smallest doc_id reachable over links, itself included."""
    named = rooted(docs, n, num, den)
    least = common.staged(named.filter("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("component_id")), "component-ids")
    return named.join(least, "root", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
