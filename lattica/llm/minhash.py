"""MinHash near-duplicates by a multi-index Hamming join.

A document's signature is SYMBOLS min-hashes of its word shingles, each cut to 16 bits. The
signature is split into CHUNKS chunks; each chunk is filed under one key for each way to allow one
wrong symbol in it (the key leaves that symbol out). By the pigeonhole principle two signatures that
differ in fewer than 2 * CHUNKS symbols agree in some chunk but for one symbol, and so meet in a
bucket: every pair under that distance is found. A pair at the similarity threshold itself, a
quarter of its symbols wrong on average, escapes all sixteen chunks with a chance of 5 in a million.
Pairs that meet are checked against SIGNATURE_LIMIT wrong symbols (five standard deviations beyond
the threshold's mean) and then on their full shingle sets.

Equal sets are one class. A bucket is joined as a star around its least class, twice: within a task,
which then sends one class a bucket, and among the tasks. Stars that pass the signature limit are
candidates, and candidates give clusters. A bucket whose members do not all hang together by two steps
along candidates (its centre is unlike some of them) is compared whole, signature by signature and
across such clusters, in blocks of MEET_ROWS; what passes the limit joins the candidates. So every pair that shares a bucket
and passes the limit is in one cluster. Confirmed candidates give components. A cluster that still
holds two components or more is compared across its components in blocks of CLUSTER_ROWS: a large component
fills parts of its own, which never meet each other, so its texts go only to where other components are. So
no cluster is one task's load, no pair is emitted (a block of either kind gives a forest of the links
it finds) and no link between texts that share a bucket and pass the limit is lost. Full sets are
compared from the texts of candidates alone: a filter of fixed size lets the candidates' rows (and, of very many, others with them) through the second scan, compressed, to a join that takes the candidates' alone. Buckets
grow in number with the classes. Tables that grow with the corpus meet in sort-merge joins at every size.

Nulls: a null or blank text has the empty set and links with nothing. Rows that repeat an id are
rows of their own; with a row column given, exactly one of them is kept. A null id never names a component that has another id. An empty table gives an
empty result. Texts are whole at any length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.bpe import _squeeze, _unsqueeze
from lattica.llm.common import LOWER, U64, Stage, bytes_of, cut_rows, flat_ranges, mix, presence_filter, present, shuffle_width, span_hashes, words_of
from lattica.llm.components import connected_components
from lattica.llm.suffix import _gather_sorted, _spread_sorted

SHINGLE = 5
CHUNKS, CHUNK = 16, 6
SYMBOLS = CHUNKS * CHUNK
SIGNATURE_LIMIT = 45
CLUSTER_ROWS = 400
MEET_ROWS = 2000
STAR_ROWS = 500
PIECE_BYTES = 1 << 20
TASK_CLASSES = 1 << 15
#: Bits of a bucket key. Keys that are equal by chance make candidates, which their signatures drop.
KEY_BITS = 48
#: A bucket task gets the keys of about so many classes.
BUCKET_CLASSES = 1 << 14

_random = np.random.default_rng(5)
_WORD = _random.integers(1, 1 << 63, SHINGLE, dtype=U64) * U64(2) + U64(1)
_TIMES = _random.integers(1, 1 << 63, SYMBOLS, dtype=U64) * U64(2) + U64(1)
_PLACE = _random.integers(1, 1 << 63, (CHUNKS, CHUNK), dtype=U64) * U64(2) + U64(1)
_KEY = _random.integers(1, 1 << 63, (CHUNKS, CHUNK), dtype=U64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Each row's set of shingles, as sorted distinct 64-bit hashes."""
    starts, ends, first = words_of(data, offsets)
    words = span_hashes(LOWER[data], starts, ends)
    n = len(words)
    rolled = np.zeros(max(0, n - SHINGLE + 1), U64)
    for j in range(SHINGLE):
        rolled += words[j : j + len(rolled)] * _WORD[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(rolled[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(mix((words[a:b] * _WORD[: b - a]).sum(dtype=U64, keepdims=True) + U64(b - a)))
        else:
            out.append(np.zeros(0, U64))
    return out


def class_of(shingles: np.ndarray) -> int:
    """A 64-bit name of a set, as a signed number."""
    mixed = mix(shingles)
    parts = np.stack([shingles.sum(dtype=U64, keepdims=True), mixed.sum(dtype=U64, keepdims=True), np.bitwise_xor.reduce(mixed, keepdims=True)])
    return int(mix(parts[0] + mix(parts[1] ^ mix(parts[2] + U64(len(shingles))))).view(np.int64)[0])


def signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(SYMBOLS, np.iinfo(U64).max, U64)
    for lo in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[lo : lo + 1024, None] * _TIMES).min(0), out=least)
    return (mix(least) >> U64(48)).astype(np.uint16)


def bucket_keys(signatures: np.ndarray) -> np.ndarray:
    """CHUNKS * CHUNK keys for each row of SYMBOLS symbols: one for each chunk and symbol left out."""
    parts = mix(signatures.reshape(-1, CHUNKS, CHUNK).astype(U64) + _PLACE) * _PLACE
    return mix(parts.sum(2, keepdims=True) - parts + _KEY).reshape(len(signatures), -1) >> U64(64 - KEY_BITS)


def _sketch(rows):
    for batch in rows:
        data, offsets = bytes_of(batch.column(1))
        for lo, hi in cut_rows(offsets, PIECE_BYTES):
            sets = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, hi - lo),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    batch.column(2).slice(lo, hi - lo),
                    batch.column(3).slice(lo, hi - lo),
                ],
                names=["id", "n", "class", "signature", "row", "hash"],
            )


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in column), np.uint16).reshape(-1, SYMBOLS)


def _star(keys: np.ndarray, ids: np.ndarray):
    """(key, centre) of each distinct key, and the (centre, other) edges of equal keys."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    centre = ids[new][np.cumsum(new) - 1] if len(keys) else ids
    edges = np.unique(np.stack([centre[~new], ids[~new]], 1), axis=0)
    return keys[new], ids[new], edges[edges[:, 0] != edges[:, 1]]


def _file(buckets: int):
    """(bucket, blob): keys of a task's classes after a star within the task."""

    def flush(ids, signatures):
        ids = np.concatenate(ids)
        keys = bucket_keys(np.concatenate(signatures))
        keys, centres, edges = _star(keys.ravel(), np.repeat(ids, keys.shape[1]))
        at = ((keys >> U64(16)) % U64(buckets)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        bounds = np.searchsorted(at[order], np.arange(buckets + 1))
        for b in range(buckets):
            some = order[bounds[b] : bounds[b + 1]]
            mine = edges[b::buckets]
            if len(some) or len(mine):
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int64()), "blob": pa.array([_squeeze(_spread_sorted(keys[some]), centres[some], mine)], pa.binary())})

    def run(rows):
        ids, signatures, held = [], [], 0
        for batch in rows:
            if batch.num_rows:
                ids.append(batch.column(0).to_numpy())
                signatures.append(_signatures(batch.column(1)))
                held += batch.num_rows
            if held >= TASK_CLASSES:
                yield from flush(ids, signatures)
                ids, signatures, held = [], [], 0
        if ids:
            yield from flush(ids, signatures)

    return run


def _meet(table):
    """The edges of a bucket of keys."""
    blobs = [_unsqueeze(x.as_py()) for x in table["blob"]]
    _, _, edges = _star(np.concatenate([_gather_sorted(b[0]) for b in blobs]), np.concatenate([b[1] for b in blobs]))
    edges = np.concatenate([edges, *(b[2].reshape(-1, 2) for b in blobs)])
    edges = np.unique(np.sort(edges, 1), axis=0)
    return pa.table({"a": pa.array(edges[:, 0], pa.int64()), "b": pa.array(edges[:, 1], pa.int64())})


def _refile(buckets: int):
    """(bucket, blob): the keys, classes and clusters of a task's (class, cluster, signature) rows."""

    def run(rows):
        for batch in rows:
            if batch.num_rows:
                keys = bucket_keys(_signatures(batch.column(2)))
                ids, clusters = (np.repeat(batch.column(k).to_numpy(), keys.shape[1]) for k in (0, 1))
                keys = keys.ravel()
                at = ((keys >> U64(16)) % U64(buckets)).astype(np.int64)
                order = np.lexsort((keys, at))
                bounds = np.searchsorted(at[order], np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(bounds)).tolist():
                    some = order[bounds[b] : bounds[b + 1]]
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int64()), "blob": pa.array([_squeeze(_spread_sorted(keys[some]), ids[some], clusters[some])], pa.binary())})

    return run


def _mixed(table):
    """(meet, class, cluster, part, parts): the members of each key that holds two clusters or more.

    meet names the members, so keys of the same members are one.
    """
    blobs = [_unsqueeze(x.as_py()) for x in table["blob"]]
    keys = np.concatenate([_gather_sorted(b[0]) for b in blobs])
    ids, clusters = (np.concatenate([b[k] for b in blobs]) for k in (1, 2))
    order = np.lexsort((ids, keys))
    keys, ids, clusters = keys[order], ids[order], clusters[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    lengths = np.diff(np.r_[starts, len(keys)])
    meet = mix(np.add.reduceat(mix(ids.view(U64)), starts) + lengths.astype(U64))
    mixed = np.minimum.reduceat(clusters, starts) < np.maximum.reduceat(clusters, starts)
    starts, lengths, meet = starts[mixed], lengths[mixed], meet[mixed]
    rows = flat_ranges(starts, lengths)
    part = (rows - np.repeat(starts, lengths)) // MEET_ROWS
    parts = np.repeat(-(-lengths // MEET_ROWS), lengths)
    names = np.repeat(meet.view(np.int64), lengths)
    return pa.table({"meet": pa.array(names, pa.int64()), "class": pa.array(ids[rows], pa.int64()), "cluster": pa.array(clusters[rows], pa.int64()), "part": pa.array(part, pa.int32()), "parts": pa.array(parts, pa.int32())})


class _Forest:
    """Union of groups; joined() is true where two were apart."""

    def __init__(self, groups: np.ndarray):
        self.parent = {int(g): int(g) for g in groups}

    def joined(self, a: int, b: int) -> bool:
        a, b = self._root(int(a)), self._root(int(b))
        self.parent[max(a, b)] = min(a, b)
        return a != b

    def _root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x


def _across_signatures(key, table):
    """Within a block of a bucket: the edges between classes of different clusters whose sizes and signatures allow the similarity, as a forest of them."""
    side, ids, clusters, sizes = (np.asarray(table[c]) for c in ("side", "class", "cluster", "n"))
    signatures = _signatures(table["signature"])
    same = key[1].as_py() == key[2].as_py()
    left = np.flatnonzero(side == 0)
    right = left if same else np.flatnonzero(side == 1)
    theirs = signatures[right]
    forest, edges = _Forest(clusters), []
    for k, x in enumerate(left.tolist()):
        lo = k + 1 if same else 0
        others = right[lo:]
        near = (clusters[others] != clusters[x]) & (4 * np.minimum(sizes[others], sizes[x]) >= 3 * np.maximum(sizes[others], sizes[x]))
        if near.any():
            some = np.flatnonzero(near)
            some = some[(theirs[lo:][some] != signatures[x]).sum(1) <= SIGNATURE_LIMIT]
            edges += [(ids[x], ids[y]) for y in others[some].tolist() if forest.joined(clusters[x], clusters[y])]
    return pa.table({"a": pa.array([min(e) for e in edges], pa.int64()), "b": pa.array([max(e) for e in edges], pa.int64())})


def _blocks(rows: DataFrame, group: str, cols: list[str]) -> DataFrame:
    """(group, p, q, side, *cols): the rows of parts p and q of a group meet in the block (p, q), once for p = q."""
    cols = [group, "p", "q", "side", *cols]
    first = rows.withColumn("q", F.explode(F.sequence("part", F.col("parts") - 1))).withColumn("p", F.col("part")).withColumn("side", F.lit(0))
    second = rows.where("part > 0").withColumn("p", F.explode(F.sequence(F.lit(0), F.col("part") - 1))).withColumn("q", F.col("part")).withColumn("side", F.lit(1))
    return first.select(cols).union(second.select(cols))


def _across(percent: int):
    """Within a block of a cluster: the links between texts of different components, as a forest of them.

    A text meets all texts of the other sub-block through the postings of their shingles.
    """

    def run(key, table):
        unzip = zstandard.ZstdDecompressor()
        side, ids, comp = (np.asarray(table[c]) for c in ("side", "class", "comp"))
        sets = []
        for blob in table["text"]:
            data = np.frombuffer(unzip.decompress(blob.as_py()), np.uint8)
            sets.append(shingle_sets(data, np.array([0, len(data)]))[0])
        sizes = np.array([len(x) for x in sets])
        left = np.flatnonzero(side == 0)
        right = left if key[1].as_py() == key[2].as_py() else np.flatnonzero(side == 1)
        forest, edges = _Forest(comp), []
        if len(left) and len(right):
            owner = np.repeat(np.arange(len(right)), sizes[right])
            flat = np.concatenate([sets[k] for k in right])
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            for x in left.tolist():
                lo, hi = np.searchsorted(flat, sets[x], "left"), np.searchsorted(flat, sets[x], "right")
                both = np.bincount(owner[flat_ranges(lo, hi - lo)], minlength=len(right))
                linked = (100 * both >= percent * (sizes[right] + sizes[x] - both)) & (comp[right] != comp[x])
                for y in right[linked].tolist():
                    if forest.joined(comp[x], comp[y]):
                        edges.append((ids[x], ids[y]))
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return run


def _similar(edges: DataFrame, classes: Stage) -> DataFrame:
    """The (a, b) edges whose sizes and signatures allow the similarity."""
    side = lambda s: classes.df.select(F.col("class").alias(s), F.col("n").alias(f"n_{s}"), F.col("signature").alias(f"s_{s}")).hint("merge")

    def run(rows):
        for batch in rows:
            if batch.num_rows:
                wrong = (_signatures(batch.column(2)) != _signatures(batch.column(3))).sum(1)
                yield batch.select(["a", "b"]).filter(pa.array(wrong <= SIGNATURE_LIMIT))

    near = F.least("n_a", "n_b") * 4 >= F.greatest("n_a", "n_b") * 3
    return edges.join(side("a"), "a").join(side("b"), "b").where(near).select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def _candidate_texts(docs: DataFrame, edges: Stage, classes: Stage) -> Stage:
    """(class, text) of one row of each class that has an edge; texts are compressed. docs: (id, hash of the text, text)."""
    nodes = edges.df.select(F.col("a").alias("class")).union(edges.df.select("b")).distinct()
    nodes = Stage(nodes.join(classes.df.select("class", "at").hint("merge"), "class").select("class", "at.*"), "nodes")
    shared = presence_filter(nodes.df, "hash")

    def send(rows):
        zip_ = zstandard.ZstdCompressor(level=3)
        for batch in rows:
            batch = batch.filter(pa.array(present(shared.value, np.asarray(batch.column(1)))))
            seen = set()
            first = [k for k, x in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)) if x not in seen and not seen.add(x)]
            batch = batch.take(pa.array(first, pa.int64()))
            data, offsets = bytes_of(batch.column(2))
            texts = [zip_.compress(data[a:b].tobytes()) for a, b in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], names=["id", "hash", "text"])

    texts = docs.select("id", "hash", "text").mapInArrow(send, "id long, hash long, text binary")
    wanted = nodes.df.select("class", F.col("id").alias("wanted_id"), F.col("hash").alias("wanted"))
    same = (F.col("hash") == F.col("wanted")) & F.col("id").eqNullSafe(F.col("wanted_id"))
    texts = Stage(texts.join(wanted.hint("merge"), same).groupBy("class").agg(F.min("text").alias("text")), "candidates")
    nodes.drop()
    return texts


def _cluster_blocks(clusters: DataFrame) -> DataFrame:
    """(cluster, p_owner, p, q_owner, q, side, class, comp): the blocks in which two components of a cluster meet.

    A component of CLUSTER_ROWS classes or more has parts of its own (owner: the component); smaller ones share
    parts (owner: null), each whole in one. Two parts meet unless both hold one and the same component.
    """
    comps = clusters.groupBy("cluster", "comp").agg(F.count("*").alias("rows"))
    mixed = comps.groupBy("cluster").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum(F.when(F.col("rows") < CLUSTER_ROWS, F.col("rows"))).alias("small")).where("lo < hi")
    comps = comps.join(mixed.select("cluster", "small"), "cluster")
    large = F.col("rows") >= CLUSTER_ROWS
    comps = comps.select("cluster", "comp", F.when(large, F.col("comp")).alias("owner"), F.ceil(F.when(large, F.col("rows")).otherwise(F.col("small")) / CLUSTER_ROWS).cast("int").alias("parts"))
    spot = F.when(F.col("owner").isNull(), F.xxhash64("comp")).otherwise(F.xxhash64("class"))
    members = Stage(clusters.join(comps, ["cluster", "comp"]).select("cluster", "class", "comp", "owner", F.pmod(spot, F.col("parts")).cast("int").alias("part")), "members").df
    parts = members.groupBy("cluster", F.struct("owner", "part").alias("p")).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    others = parts.select("cluster", F.col("p").alias("q"), F.col("lo").alias("q_lo"), F.col("hi").alias("q_hi"))
    pairs = parts.join(others, "cluster").where("p <= q and not (lo = hi and q_lo = q_hi and lo = q_lo)").select("cluster", "p", "q")
    members = members.select("cluster", "class", "comp", F.struct("owner", "part").alias("at"))
    cols = ["cluster", "p", "q", "side", "class", "comp"]
    met = lambda at, other, side: members.withColumnRenamed("at", at).join(pairs.where("p <> q") if side else pairs, ["cluster", at]).withColumn("side", F.lit(side)).select(cols)
    return met("p", "q", 0).union(met("q", "p", 1)).select("cluster", F.to_json("p").alias("p"), F.to_json("q").alias("q"), "side", "class", "comp")


def _confirm(edges: Stage, texts: Stage, percent: int) -> DataFrame:
    """The (a, b) edges with 100 * intersection >= percent * union on full sets."""
    stars = edges.df.groupBy("a").agg(F.ceil(F.count("*") / STAR_ROWS).cast("int").alias("parts"))
    salted = edges.df.join(stars, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    members = salted.join(texts.df.select(F.col("class").alias("b"), "text").hint("merge"), "b").select("a", "part", "b", "text")
    centres = stars.join(texts.df.select(F.col("class").alias("a"), "text").hint("merge"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "text")

    def compare(members, centres):
        unzip = zstandard.ZstdDecompressor()

        def whole(blob):
            data = np.frombuffer(unzip.decompress(blob), np.uint8)
            return shingle_sets(data, np.array([0, len(data)]))[0]

        kept = []
        if members.num_rows and centres.num_rows:
            centre = whole(centres["text"][0].as_py())
            for k in range(members.num_rows):
                other = whole(members["text"][k].as_py())
                both = len(np.intersect1d(centre, other, assume_unique=True))
                if 100 * both >= percent * (len(centre) + len(other) - both):
                    kept.append(k)
        return members.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    return members.groupBy("a", "part").cogroup(centres.groupBy("a", "part")).applyInArrow(compare, "a long, b long")


def minhash_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = 75, row: Column | None = None) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row. percent: the least similarity, 75 and up.

    row: text that tells rows of one id apart. It is returned as row, and kept is then true for the
    component's least (id, row) alone, null ids last; without it, for all rows of the component's least id.
    """
    if percent < 75:
        raise ValueError("signatures are laid out for a similarity of 0.75 and more")
    spark = docs.sparkSession
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"), (F.lit(None) if row is None else row).cast("string").alias("row"), F.xxhash64(text).alias("hash"))
    sketches = Stage(rows.mapInArrow(_sketch, "id long, n long, class long, signature binary, row string, hash long"), "sketches")
    at = F.min(F.struct("id", "hash")).alias("at")  # a row of the class whose text is fetched
    classes = sketches.df.where("class is not null").groupBy("class").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("signature").alias("signature"), at)
    classes = Stage(classes, "classes")
    buckets = max(shuffle_width(spark), classes.df.count() // BUCKET_CLASSES)

    filed = classes.df.select("class", "signature").mapInArrow(_file(buckets), "bucket long, blob binary")
    stars = Stage(filed.groupBy("bucket").applyInArrow(_meet, "a long, b long").distinct(), "stars")
    near = Stage(_similar(stars.df, classes), "near")

    # buckets whose members are not known to be in one cluster: compared across clusters by signature
    step = near.df.groupBy(F.col("b").alias("class")).agg(F.min("a").alias("up"))
    twice = step.join(step.select(F.col("class").alias("up"), F.col("up").alias("top")), "up", "left").select("class", F.coalesce("top", "up").alias("cluster"))
    met = stars.df.select(F.col("a").alias("class")).union(stars.df.select("b")).distinct()
    met = met.join(twice, "class", "left").join(classes.df.select("class", "signature").hint("merge"), "class")
    refiled = met.select("class", F.coalesce("cluster", "class").alias("cluster"), "signature").mapInArrow(_refile(buckets), "bucket long, blob binary")
    mixed = refiled.groupBy("bucket").applyInArrow(_mixed, "meet long, class long, cluster long, part int, parts int").distinct()
    mixed = Stage(mixed, "mixed").df.join(classes.df.select("class", "n", "signature").hint("merge"), "class")
    blocks = _blocks(mixed, "meet", ["class", "cluster", "n", "signature"]).groupBy("meet", "p", "q")
    beside = Stage(blocks.applyInArrow(_across_signatures, "a long, b long").distinct(), "beside")
    if beside.df.limit(1).count():
        near = Stage(near.df.union(beside.df), "near")

    texts = _candidate_texts(rows, near, classes)
    links = Stage(_confirm(near, texts, percent), "links")
    comps = Stage(connected_components(links.df), "comps")

    # clusters of similar signatures that still hold two components: compared across components, block by block
    clusters = connected_components(near.df).select(F.col("node").alias("class"), F.col("root").alias("cluster"))
    clusters = clusters.join(comps.df.withColumnRenamed("node", "class"), "class", "left").select("class", "cluster", F.coalesce("root", "class").alias("comp"))
    clusters = Stage(clusters, "clusters")
    met = _cluster_blocks(clusters.df).join(texts.df.hint("merge"), "class")
    more = met.groupBy("cluster", "p", "q").applyInArrow(_across(percent), "a long, b long")
    more = Stage(more, "links")
    if more.df.limit(1).count():
        comps = Stage(connected_components(links.df.union(more.df)), "comps")

    named = classes.df.select("class", "id").join(comps.df.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    named = Stage(named.join(least, "root").select("class", "root", "component_id"), "named")
    out = sketches.df.select("id", "n", "class", "row").join(named.df, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id"))
    if row is not None:
        place = F.struct(F.col("id").isNull(), "id", "row")
        first = out.where("root is not null").groupBy("root").agg(F.min(place).alias("first"))
        kept = F.col("class").isNull() | place.eqNullSafe(F.col("first"))
        return out.join(first, "root", "left").select(F.col("id").alias(id), F.col("n").alias("n_shingles"), component.alias("component_id"), "row", kept.alias("kept"))
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col(id).eqNullSafe(F.col("component_id")))
