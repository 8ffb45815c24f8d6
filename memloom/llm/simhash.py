"""Operator 6, SimHash near-dedup by Golay-code fuzzy hashing.

A 64-bit fingerprint falls into segments of 23, 23 and 18 bits. Two fingerprints
at most two bits apart agree in one segment (pigeonhole) and differ by at most two
bits in each other one. In the perfect (23,12) Golay code, the codewords nearest to
a segment and to its one-bit neighbours are at most six; segments within two bits
of each other share one, through the word between them. So each key is an exact
segment with the codeword index of another: several keys each, joined and verified.

Keys with many fingerprints are not paired: their fingerprints are grouped by
their one-bit neighbourhoods instead (two are linked exactly if these meet), and
each is linked to the smallest of its group. No link is lost, no group is squared.

Texts whose sets of shingles are similar (0.8 or more) mostly have fingerprints more
than two bits apart, beyond what these keys reach. `similar_documents` therefore adds
min-wise keys to the fingerprint's and verifies every candidate on the whole sets.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.llm.common import cut, salted_join, small_batches, table
from memloom.llm.links import components

#: Width and offset of the segments; (exact segment, coded segment) of the keys.
SEGMENTS = ((23, 0), (23, 23), (18, 46))
FAMILIES = ((0, 1), (1, 2), (2, 0))
#: Fingerprints under one key from which neighbourhoods replace pairs.
CROWD = 16
SEED = 42
#: Similarity of sets of shingles from which texts are near duplicates; min-wise keys of so many values each.
SIMILAR, KEYS, VALUES = 0.8, 12, 3
#: Nodes under one key that are all paired; larger groups are compared with two of their members, and joined exactly where components remain.
PAIRED = 64
#: Sets of up to so many shingles carry the list of their rarest ones through the join of crowds (it only saves work).
LISTED = 2000
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the code.
GENERATOR = 0b110001110101


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Unsigned hashes of a text's word shingles, repeats included; of the whole sequence if it is shorter."""
    raw = np.frombuffer((text or "").encode().lower(), dtype=np.uint8)
    solid = (raw != 32) & ((raw < 9) | (raw > 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8)))
    if not len(edge):
        return np.zeros(0, dtype="<u8")
    # the words with one space between them, and where each begins and ends in that; no list of all words is made
    sizes = edge[1::2] - edge[::2]
    if solid[-1]:
        solid, raw = np.append(solid, False), np.append(raw, np.uint8(32))
    keep = solid.copy()
    keep[edge[1::2]] = True
    joined = np.where(solid, raw, np.uint8(32))[keep].tobytes()
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    width = min(shingle, len(sizes))
    one = xxhash.xxh64_intdigest
    starts, ends = starts[: len(sizes) - width + 1], ends[width - 1 :]
    out = np.empty(len(starts), dtype="<u8")
    for k in range(0, len(out), 65_536):
        out[k : k + 65_536] = [one(joined[i:j], SEED) for i, j in zip(starts[k : k + 65_536].tolist(), ends[k : k + 65_536].tolist(), strict=True)]
    return out


def majority(hashes: np.ndarray) -> int:
    """Unsigned 64 bits, each set if it is in over half of the hashes; 0 without hashes."""
    if not len(hashes):
        return 0
    votes = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 65_536):
        part = hashes[k : k + 65_536]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int) -> int:
    """Unsigned 64 bits; 0 for a text without words."""
    return majority(shingle_hashes(text, shingle))


def _syndrome(words: np.ndarray) -> np.ndarray:
    words = words.copy()
    for bit in range(22, 10, -1):
        words ^= np.where(words >> bit & 1, GENERATOR << (bit - 11), 0)
    return words


@functools.lru_cache(maxsize=1)
def _errors() -> np.ndarray:
    """By syndrome, the pattern of at most three errors that causes it (each of 2^11 has one)."""
    bits = [1 << k for k in range(23)]
    patterns = [0, *bits, *(a | b for i, a in enumerate(bits) for b in bits[i + 1 :])]
    patterns += [a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[i + 1 :], i + 1) for c in bits[j + 1 :]]
    patterns = np.array(patterns)
    out = np.zeros(1 << 11, dtype=np.int64)
    out[_syndrome(patterns)] = patterns
    return out


def codewords(words: np.ndarray, width: int = 23) -> np.ndarray:
    """Per 23-bit word, sorted indices (12 bits) of the codewords nearest to it and its one-bit
    neighbours in the low `width` bits; -1 where one repeats."""
    around = words[:, None] ^ np.array([0, *(1 << k for k in range(width))])
    found = np.sort((around ^ _errors()[_syndrome(around)]) >> 11, axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of unsigned fingerprints."""
    parts = [(prints >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64) for width, at in SEGMENTS]
    rows, out = [], []
    for family, (exact, coded) in enumerate(FAMILIES):
        index = codewords(parts[coded], SEGMENTS[coded][0])
        row, col = np.nonzero(index >= 0)
        rows.append(row)
        out.append((family << 35) | (parts[exact][row] << 12) | index[row, col])
    return np.concatenate(rows), np.concatenate(out)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """A table of (key, fp): fp is the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], ["key", "fp"])

    return cut(docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(run, f"key {kind}, fp long"), "fingerprints")


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp), enough to connect all within two bits."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False)
            rows, out = keys(own.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(out), pa.array(own[rows])], ["k", "fp"])

    at = cut(prints.mapInArrow(keyed, "k long, fp long"), "golay-keys")
    sizes = at.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1")
    few = at.join(sizes.filter(F.col("n") <= CROWD), "k")
    pairs = few.groupBy("k").agg(F.collect_list("fp").alias("f"))  # CROWD at most
    pairs = pairs.select("f", F.explode("f").alias("a")).select("a", F.explode("f").alias("b"))
    near = pairs.filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b")
    crowded = salted_join(at, sizes.filter(F.col("n") > CROWD).withColumnRenamed("k", "big"), "k", "big", F.col("fp"), "inner").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.shiftleft(F.lit(1).cast("long"), k) for k in range(64)))
    around = crowded.select("fp", F.explode(flips).alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("z"))
    stars = around.groupBy("z").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("f")).select("a", F.explode("f").alias("b")).filter("a <> b")  # 65 at most
    return near.union(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp, component_id) of each row: component_id is the smallest id among the documents that
    links of at most two bits reach.

    Null and wordless texts have fingerprint 0 and link like any other; repeated rows and ids give
    a row each; a component of null ids only has a null component_id; an empty table gives an empty result. Other columns
    are ignored, whatever their names.
    """
    rows = fingerprints(docs, id_col, text_col, shingle)
    prints = cut(rows.groupBy("fp").agg(F.min("key").alias("least")), "distinct-prints")
    parts = components(links(prints.select("fp")))
    whole = prints.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("part"))
    least = whole.groupBy("part").agg(F.min("least").alias("component_id"))
    named = salted_join(whole.select("fp", "part"), least.withColumnRenamed("part", "of"), "part", "of", F.col("fp")).select(F.col("fp").alias("its"), "component_id")
    return salted_join(rows, named, "fp", "its", F.col("key")).select(F.col("key").alias(id_col), "fp", "component_id")


def sketches(docs: DataFrame, key: Column, text_col: str, shingle: int) -> DataFrame:
    """A table of (key, node, fp, ks, size, grams): key as given, node names the set of shingles, grams holds it as 32-bit hashes
    (two of 20,000 shingles fall together in 1 of 20 texts), size is their number, ks are min-wise keys."""
    rows = docs.select(key.alias("key"), F.col(text_col).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    draw = np.random.default_rng(SEED)
    times = draw.integers(0, 1 << 63, (KEYS, VALUES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    plus = draw.integers(0, 1 << 63, (KEYS, VALUES), dtype=np.uint64)

    def one(text: str | None) -> tuple:
        hashes = shingle_hashes(text, shingle)
        own = np.unique(hashes)
        node = xxhash.xxh64_intdigest(own.tobytes(), SEED)
        ks = []
        for k in range(KEYS if len(own) else 0):
            least = [(own * times[k, j] + plus[k, j]).min() for j in range(VALUES)]
            ks.append(xxhash.xxh64_intdigest(np.array([k, *least], dtype="<u8").tobytes(), SEED))
        return node, majority(hashes), ks, np.unique(own.astype(np.uint32)).view(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed = lambda v: np.array(v, dtype=np.uint64).view(np.int64)
        for b in batches:
            rows = [one(t) for t in b.column(1).to_pylist()]
            node, fp = signed([r[0] for r in rows]), signed([r[1] for r in rows])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(node), pa.array(fp), pa.array([signed(r[2]) for r in rows], pa.list_(pa.int64())), pa.array([len(r[3]) for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.list_(pa.int32()))], ["key", "node", "fp", "ks", "size", "grams"])

    return cut(rows.mapInArrow(run, f"key {kind}, node long, fp long, ks array<long>, size int, grams array<int>"), "sketches")


def keyed_nodes(nodes: DataFrame) -> DataFrame:
    """(node, k): the min-wise keys of each node, and its fingerprint as one more."""
    return nodes.select("node", F.explode(F.array_append("ks", F.xxhash64("fp", F.lit("fp")))).alias("k"))


def candidates(nodes: DataFrame, at: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes under a common key: all of a small group; of a crowd each with two of it, others under each key
    (`strays` finds what these leave). Under Golay keys the pairs that links() has, by the least node of each fingerprint."""
    few = at.join(sizes.filter(F.col("n") <= PAIRED).select("k"), "k").groupBy("k").agg(F.collect_list("node").alias("f"))
    near = few.select("f", F.explode("f").alias("a")).select("a", F.explode("f").alias("b"))
    heads = sizes.filter(F.col("n") > PAIRED).select(F.col("k").alias("big"), F.array("lo.node", "hi.node").alias("f"))
    crowd = salted_join(at, heads, "k", "big", F.col("node"), "inner").select(F.col("node").alias("a"), F.explode("f").alias("b"))
    first = nodes.groupBy("fp").agg(F.min("node").alias("node"))
    named = lambda c: first.select(F.col("fp").alias(c), F.col("node").alias(f"{c}_node"))
    coded = links(first.select("fp")).join(named("a"), "a").join(named("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    return near.union(crowd).union(coded).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def sets_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, grams) of the nodes that are wanted, from rows of which several may have one node."""
    return rows.select("node", "grams").join(wanted.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])


def verified(pairs: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose whole sets have a similarity of `least` or more."""
    sets = sets_of(rows, pairs.select(F.explode(F.array("a", "b")).alias("node")))
    side = lambda c: sets.select(F.col("node").alias(c), F.col("grams").alias(f"{c}_grams"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("shared", F.size(F.array_intersect("a_grams", "b_grams")))
    return met.filter(F.col("shared") >= least * (F.size("a_grams") + F.size("b_grams") - F.col("shared"))).select("a", "b")


def strays(rows: DataFrame, nodes: DataFrame, at: DataFrame, sizes: DataFrame, parts: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of different components, that may be similar, among the nodes of crowds that are not one component yet.

    A crowd inside one component has nothing left to find. For the others this is an exact similarity join by rarest
    shingles: two sets similar by `least` share one of the (1 - least) share of their shingles that is rarest in a common
    order, they differ little in size, and what follows their first common one must be long enough for the overlap.
    Texts that only share a template differ in just these shingles, so they do not meet.
    """
    label = nodes.select("node", "size").join(parts.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("node", "size", F.coalesce("component", "node").alias("part"))
    label = cut(label, "crowd-labels")
    big = sizes.filter(F.col("n") > PAIRED).select(F.col("k").alias("big"))
    crowded = salted_join(at, big, "k", "big", F.col("node"), "inner").join(label, "node")
    mixed = crowded.groupBy("k").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo <> hi").select(F.col("k").alias("big"))
    rest = cut(salted_join(crowded, mixed, "k", "big", F.col("node"), "inner").select("node", "size", "part").distinct(), "crowd-rest")
    grams = sets_of(rows, rest).join(rest, "node").select("node", "size", "part", F.explode("grams").alias("gram"))
    often = grams.groupBy("gram").agg(F.count("*").alias("often"))
    ranked = salted_join(grams, often.withColumnRenamed("gram", "of"), "gram", "of", F.col("node"), "inner")
    ranked = ranked.withColumn("pos", F.row_number().over(Window.partitionBy("node").orderBy("often", "gram")))
    heads = cut(ranked.filter(F.col("pos") <= F.col("size") - F.ceil(least * F.col("size") - 1e-9) + 1).select("node", "size", "part", "gram", "pos"), "crowd-prefixes")
    split = heads.groupBy("gram").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo <> hi").select(F.col("gram").alias("of"))
    lists = heads.filter(F.col("size") <= LISTED).groupBy(F.col("node").alias("_n")).agg(F.array_sort(F.collect_list(F.struct("pos", "gram"))).alias("l"))
    heads = salted_join(heads, split, "gram", "of", F.col("node"), "inner")
    heads = heads.join(lists, F.col("node") == F.col("_n"), "left").withColumn("list", F.col("l.gram"))
    one = lambda c: heads.select("gram", F.col("node").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in ("size", "part", "pos", "list")))
    need = least / (1 + least) * (F.col("a_size") + F.col("b_size")) - 1e-9
    close = (F.col("a") < F.col("b")) & (F.col("a_part") != F.col("b_part"))
    close &= F.least("a_size", "b_size") >= least * F.greatest("a_size", "b_size") - 1e-9
    close &= 1 + F.least(F.col("a_size") - F.col("a_pos"), F.col("b_size") - F.col("b_pos")) >= need
    # with both lists at hand a pair is made once, at its first common shingle, and its overlap is bounded by what the lists share
    both = F.array_intersect("a_list", "b_list")
    rest = F.greatest(F.col("a_size") - F.size("a_list"), F.col("b_size") - F.size("b_list"))
    close &= F.coalesce((F.get(both, F.lit(0)) == F.col("gram")) & (F.size(both) + rest >= need), F.lit(True))
    return one("a").join(one("b"), "gram").filter(close).select("a", "b").distinct()


def similar_sets(docs: DataFrame, key: Column, text_col: str, shingle: int, least: float) -> tuple[DataFrame, DataFrame]:
    """(key, node, ...) of each row and (node, least key, part) of each different set: one part holds what links between
    texts of similarity `least` or more (shared shingles in all shingles of both) reach.

    Every link is verified on the whole sets. Candidates come from the Golay keys and from min-wise keys, which
    miss a pair of similarity 0.8 with a chance of 0.0003. Under a key of more than PAIRED different sets each is compared
    with two of them; where that does not make the crowd one component, `strays` joins its components exactly.
    Null and wordless texts are equal to each other.
    """
    rows = sketches(docs, key, text_col, shingle)
    nodes = cut(rows.groupBy("node").agg(F.min("key").alias("least"), F.first("fp").alias("fp"), F.first("ks").alias("ks"), F.first("size").alias("size")), "nodes")
    at = keyed_nodes(nodes)
    mixed = F.struct(F.xxhash64("node", "k").alias("h"), "node")
    sizes = cut(at.groupBy("k").agg(F.count("*").alias("n"), F.min(mixed).alias("lo"), F.max(mixed).alias("hi")).filter("n > 1"), "crowds")
    pairs = cut(candidates(nodes.select("node", "fp", "ks"), at, sizes), "candidates")
    alike = cut(verified(pairs, rows, least), "alike")
    parts = components(alike)
    found = cut(strays(rows, nodes, at, sizes, parts, least), "strays")
    late = None if found.isEmpty() else cut(verified(found, rows, least), "alike-late")
    if late is not None and not late.isEmpty():
        parts = components(alike.union(late))
    whole = nodes.select("node", "least").join(parts.withColumnRenamed("node", "of_node"), F.col("node") == F.col("of_node"), "left").select("node", "least", F.coalesce("component", "node").alias("part"))
    return rows, whole


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = SIMILAR) -> DataFrame:
    """(id, component_id) of each row: component_id is the smallest id among the documents of its part in
    `similar_sets`. Repeated rows and ids give a row each; a component of null ids only has a null component_id.
    """
    rows, whole = similar_sets(docs, F.col(id_col), text_col, shingle, least)
    smallest = whole.groupBy("part").agg(F.min("least").alias("component_id"))
    named = salted_join(whole.select("node", "part"), smallest.withColumnRenamed("part", "of"), "part", "of", F.col("node")).select(F.col("node").alias("its"), "component_id")
    return salted_join(rows.select("key", "node"), named, "node", "its", F.col("key")).select(F.col("key").alias(id_col), "component_id")


def one_of_similar(docs: DataFrame, row_col: str, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = SIMILAR) -> DataFrame:
    """(row_col) of one row of each part in `similar_sets`: the one of smallest id, null ids last, then of smallest row_col,
    which is a key of the rows. Ids may be null or repeated."""
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(row_col).alias("row"))
    _, whole = similar_sets(docs, key, text_col, shingle, least)
    return whole.groupBy("part").agg(F.min("least").alias("least")).select(F.col("least.row").alias(row_col))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their components at two differing bits."""
    small_batches(spark)
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
