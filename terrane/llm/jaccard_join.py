"""N-gram Jaccard join by prefix trees: every pair of documents whose shingle sets are similar enough is a link."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm import blocks, bloom
from terrane.llm.components import components
from terrane.llm.repeats import tagged
from terrane.llm.tables import scratch, spread, written

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Shingles of the sets that one tree holds; a larger group of candidates is joined block by block.
TREE_SHINGLES = 1 << 20
#: Shingles that a step down a tree reads at most before bounds are looked at.
LABEL = 64
#: From this percentage on sets meet by their parts (see _near), below by rare shingles (see _candidates): parts of more
#: unlike sets would hold less than two shingles.
PARTS_FROM = 75
#: The sizes at which classes of sets begin (see _near), each half as large again as the one before.
_LEAST = [1]
while _LEAST[-1] < 1 << 40:
    _LEAST.append(max(_LEAST[-1] + 1, 3 * _LEAST[-1] // 2))
_LEAST = np.array(_LEAST)
#: A shingle is hot if steps in which at least HOT_LEAST sets and a share of 1 / HOT_STEP have it count, together, a share
#: of 1 / HOT_ALL of all documents; so there are at most HOT_ALL times the mean prefix of them.
HOT_LEAST, HOT_STEP, HOT_ALL = 16, 64, 1024


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-word shingles (hashes) of each document in ascending order, and each document's bounds among them."""
    data = _LOWER[data]
    starts, ends, bounds = blocks.words(data, offsets)
    values = blocks.Spans(blocks.byte_values(data))(starts, ends)
    words = np.diff(bounds)
    many = np.where(words >= n, words - n + 1, np.minimum(words, 1))
    doc = np.repeat(np.arange(len(words)), many)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + bounds[:-1][doc]
    hashes = blocks.Spans(values)(at, np.minimum(at + n, bounds[1:][doc]))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(len(words) + 1))


def _spare(size: np.ndarray, percent: int) -> np.ndarray:
    """How many of its shingles a set may lack in another one that it links to."""
    return size - -(-size * percent // 100)


def _shared(size: np.ndarray, percent: int) -> np.ndarray:
    """How many of the long prefix must be shared, by the size of the smaller set."""
    return np.maximum(1, _spare(size, percent))


_SALTS = (0x2545F4914F6CDD1D, 0x6C8E9CF570932BD5)


def _signs(hashes: np.ndarray, bounds: np.ndarray, salt: int) -> np.ndarray:
    sums = np.append(np.uint64(0), np.cumsum(blocks.mix(hashes ^ np.uint64(salt)), dtype=np.uint64))
    return (sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64)


def _prefix(hashes: np.ndarray, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, signature of each one's set): the long prefixes (see _candidates) of the sets, of those that repeat one."""
    sign, one = np.unique(_signs(hashes, bounds, _SALTS[0]), return_index=True)
    size = np.diff(bounds)[one]
    length = np.minimum(size, _spare(size, percent) + _shared(size, percent))
    ends = np.cumsum(length)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(bounds[one] - (ends - length), length)
    return hashes[at].view(np.int64), np.repeat(sign, length)


def _differ(shingles: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles only one of two linked sets has, at most, that have so many together, common ones counted twice."""
    return shingles * (100 - percent) // (100 + percent)


def _parts(hashes: np.ndarray, bounds: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, signature of each one's set): the largest parts (see _near) of the sets, of those that repeat one."""
    sign, one = np.unique(_signs(hashes, bounds, _SALTS[0]), return_index=True)
    size, begin = np.diff(bounds)[one], bounds[:-1][one]
    sums = np.append(np.uint64(0), np.cumsum(blocks.mix(hashes ^ np.uint64(_SALTS[1])), dtype=np.uint64))
    most = 100 * size // percent  # shingles of a set that links to it
    own, last = (np.searchsorted(_LEAST, x, "right") for x in (size, most))
    tokens, signs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(int((last - own).max(initial=0)) + 1):
        limit = _LEAST[own + step] - 1  # the largest size of the class
        spare = _differ(size + np.minimum(most, limit), percent)
        use = np.flatnonzero((own + step <= last) & (spare > 0))  # without spare shingles only equal sets link
        spare, level, parts = spare[use], (own + step)[use].astype(np.uint64), -(-3 * (_differ(2 * limit[use], percent) + 1) // 2)
        many = size[use]
        ends = np.cumsum(many)
        doc = np.repeat(np.arange(len(use)), many)
        at = np.arange(len(doc)) + np.repeat(begin[use] - (ends - many), many)
        # shingles are in order of hash, and so in order of part
        part = (hashes[at] >> np.uint64(32)) * parts.astype(np.uint64)[doc] >> np.uint64(32)
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])
        head = np.flatnonzero(new)
        count = np.diff(np.append(head, len(doc)))
        doc, part, value = doc[head], part[head], sums[at[head] + count] - sums[at[head]]
        # a set with too few parts that hold anything has its empty ones also
        few = np.flatnonzero(np.bincount(doc, minlength=len(use)) <= spare)
        every = np.cumsum(parts[few])
        of, which = np.repeat(few, parts[few]), np.arange(every[-1] if len(few) else 0) - np.repeat(every - parts[few], parts[few])
        empty = ~np.isin((of << 32) + which, (doc << 32) + part.astype(np.int64))
        doc, part = np.append(doc, of[empty]), np.append(part, which[empty].astype(np.uint64))
        value, count = np.append(value, np.zeros(empty.sum(), np.uint64)), np.append(count, np.zeros(empty.sum(), np.int64))
        token = blocks.mix(value ^ blocks.mix((level[doc] << np.uint64(48)) + part)).view(np.int64)
        order = np.lexsort((token, -count, doc))
        doc, token = doc[order], token[order]
        stays = np.arange(len(doc)) - np.searchsorted(doc, doc) <= spare[doc]
        tokens.append(token[stays])
        signs.append(sign[use][doc[stays]])
    return np.concatenate(tokens), np.concatenate(signs)


def _near(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Edges (u, v) of signatures such that every two sets that can link are connected, by parts that they share.

    Linked sets differ in few shingles, by their sizes. The sets of a class of sizes, and smaller ones that may link to
    them, are cut by hash into parts, half as many again as any two of them differ in shingles, and one more. Each
    shingle in which two sets differ spoils one part at most. Of a set that differs from any it links to in d shingles,
    d parts at most are larger (by shingles, then by token) than the largest part that both have whole: so sets meet by
    their d + 1 largest parts, of several shingles each, which unlike sets seldom share by chance.
    """
    schema = pa.schema([("token", pa.int64()), ("s1", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in blocks.texts(batch):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _parts(*shingle_sets(data, offsets, n), percent)], schema=schema)

    keys = docs.select("text").mapInArrow(run, "token long, s1 long")
    least = F.min("s1").over(Window.partitionBy("token"))
    return keys.select(F.col("s1").alias("u"), least.alias("v")).where("u != v").distinct()


def _sets(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, tag (a hash of the text), size of the shingle set, two signatures of it, and, below PARTS_FROM, in one row of
    each step of a task, the tokens that many sets of the step have in their prefixes (often: token, times)."""
    many = pa.list_(pa.struct([("token", pa.int64()), ("times", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("size", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("often", many)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in blocks.texts(batch):
                hashes, bounds = shingle_sets(data, offsets, n)
                signs = [pa.array(_signs(hashes, bounds, salt)) for salt in _SALTS]
                often = [None] * (j - i)
                if percent < PARTS_FROM:
                    token, times = np.unique(_prefix(hashes, bounds, percent)[0], return_counts=True)
                    hot = times >= max(HOT_LEAST, (j - i) / HOT_STEP)
                    often[0] = [{"token": t, "times": x} for t, x in zip(token[hot].tolist(), times[hot].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in (0, 1)), pa.array(np.diff(bounds)), *signs, pa.array(often, many)], schema=schema)

    return tagged(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, tag long, size long, s1 long, s2 long, often array<struct<token:long,times:long>>")


def _hot(sets: DataFrame) -> np.ndarray:
    """The hot tokens, in order: a list of bounded length, which the driver holds."""
    found = sets.where("often IS NOT NULL").select(F.explode("often").alias("o")).groupBy("o.token").agg(F.sum("o.times").alias("times"))
    return np.sort(np.array([r.token for r in found.where(F.col("times") >= sets.count() / HOT_ALL).select("token").collect()], np.int64))


def _prefixes(docs: DataFrame, n: int, percent: int, hot: np.ndarray) -> DataFrame:
    """token, s1, hot: the long prefix of each set, its shingles of least hash (see _candidates); sets that repeat within one
    step of a task come once."""
    schema = pa.schema([("token", pa.int64()), ("s1", pa.int64()), ("hot", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in blocks.texts(batch):
                token, sign = _prefix(*shingle_sets(data, offsets, n), percent)
                at = np.searchsorted(hot, token)
                is_hot = hot[np.minimum(at, len(hot) - 1)] == token if len(hot) else np.zeros(len(token), bool)
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(sign), pa.array(is_hot)], schema=schema)

    return docs.select("text").mapInArrow(run, "token long, s1 long, hot boolean")


def _candidates(prefixes: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) of signatures such that every two sets that can link are connected. sizes: s1, size.

    With d spare shingles, the first d + l shingles in hash order of two linked sets share l at least (l goes by the
    smaller set). So a set with fewer than l shingles there that others have too links to none. Of the d + l, in one
    order for all sets, those that no other set has first and then the rarest, the first d + 1 hold the first shared
    one. Sets meet by those.
    """
    size = F.col("size")

    def spare(x):
        return x - F.ceil(x * percent / 100)

    def shared(x):
        return F.greatest(F.lit(1), spare(x))

    # rows meet by token to learn how many sets have it; a hot one is known to be shared, is the last in order, and meets
    # nowhere: its rows are spread by their sets
    by_token = Window.partitionBy("token", "salt")
    tokens = prefixes.withColumn("salt", F.when(F.col("hot"), F.col("s1")).otherwise(0))
    tokens = tokens.select("*", F.count(F.lit(1)).over(by_token).alias("n"), F.min("s1").over(by_token).alias("low"), F.max("s1").over(by_token).alias("high"))
    df = F.when(F.col("hot"), F.lit(1 << 60)).otherwise(F.col("n"))
    common = tokens.where("hot OR low != high").groupBy("s1").agg(F.sort_array(F.collect_set(F.struct(df.alias("df"), "token"))).alias("common"))
    width = F.least(size, spare(size) + shared(size))
    needed = F.least(shared(F.ceil(size * percent / 100)), width)
    rare = width - F.size("common")
    keys = common.join(sizes, "s1").where(F.size("common") >= needed)
    keys = keys.select("s1", F.explode(F.slice("common", 1, F.greatest(F.lit(0), width - needed + 1 - rare).cast("int"))["token"]).alias("token"))
    keys = written(keys)
    return keys.join(keys.groupBy("token").agg(F.min("s1").alias("v")), "token").select(F.col("s1").alias("u"), "v").where("u != v").distinct()


class PrefixTree:
    """Sets of ranked shingles, the commonest first, as a path-compressed trie of labels of at most LABEL; walked level by
    level."""

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].tolist())
        rows = [sets[i] for i in order]
        shared = [0]
        for a, b in zip(rows, rows[1:]):
            m = min(len(a), len(b))
            unlike = np.flatnonzero(a[:m] != b[:m])
            shared.append(int(unlike[0]) if len(unlike) else m)
        shared = np.array(shared)
        size = np.array([len(r) for r in rows])
        labels, todo = [], [(0, len(rows), 0, 0)]
        nodes: list[tuple] = []
        while todo:
            lo, hi, depth, at = todo.pop()
            deep = int(shared[lo + 1 : hi].min()) if hi - lo > 1 else int(size[lo])
            least, most = int(size[lo:hi].min()), int(size[lo:hi].max())
            while deep - depth > LABEL:
                nodes.append((at, depth + LABEL, least, most, -1))
                labels.append(rows[lo][depth : depth + LABEL])
                at, depth = len(nodes) - 1, depth + LABEL
            index = len(nodes)
            ends = [k for k in range(lo, hi) if size[k] == deep]  # only the first can be: rows are distinct and sorted
            nodes.append((at, deep, least, most, order[ends[0]] if ends else -1))
            labels.append(rows[lo][depth:deep])
            if hi - lo > 1:
                begin = lo + len(ends)
                for cut in [*(begin + 1 + np.flatnonzero(shared[begin + 1 : hi] == deep)).tolist(), hi]:
                    todo.append((begin, cut, deep, index))
                    begin = cut
        parent, self.depth, self.least, self.most, self.holds = (np.array(c, np.int64) for c in zip(*nodes, strict=True))
        lengths = np.array([len(x) for x in labels])
        self.length, self.start, self.flat = lengths, np.cumsum(lengths) - lengths, np.concatenate(labels) if len(labels) else np.zeros(0, np.int64)
        kids = np.argsort(parent[1:], kind="stable") + 1
        self.kids, count = kids, np.bincount(parent[1:], minlength=len(nodes))
        self.n_kids, self.kid_at = count, np.cumsum(count) - count

    def similar(self, mask: np.ndarray, own: np.ndarray, percent: int) -> np.ndarray:
        """The sets that link to `own` (ascending), which `mask` marks."""
        size = len(own)
        at, overlap, found = np.zeros(1, np.int64), np.zeros(1, np.int64), []
        while len(at):
            length = self.length[at]
            ends = np.cumsum(length)
            index = np.repeat(self.start[at] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
            hits = np.append(0, np.cumsum(mask[self.flat[index]]))
            overlap = overlap + hits[ends] - hits[ends - length]
            here = self.holds[at] >= 0
            depth = self.depth[at]
            good = here & (100 * overlap >= percent * (size + depth - overlap))
            found.append(self.holds[at][good])
            last = np.where(length > 0, self.flat[np.maximum(self.start[at] + length - 1, 0)], -1)
            left = size - np.searchsorted(own, last, "right")  # what the set has beyond this node
            reach = overlap + np.minimum(left, self.most[at] - depth)
            live = (self.n_kids[at] > 0) & ((100 + percent) * reach >= percent * (size + np.maximum(self.least[at], overlap)))
            at, overlap, left, depth = at[live], overlap[live], left[live], depth[live]
            many = self.n_kids[at]
            ends = np.cumsum(many)
            index = np.repeat(self.kid_at[at] - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)
            at, overlap = self.kids[index], np.repeat(overlap, many)
            reach = overlap + np.minimum(np.repeat(left, many), self.most[at] - np.repeat(depth, many))
            live = (100 + percent) * reach >= percent * (size + np.maximum(self.least[at], overlap))
            at, overlap = at[live], overlap[live]
        return np.concatenate(found)


def links_of(probes: list[np.ndarray], held: list[np.ndarray], percent: int) -> list[np.ndarray]:
    """For each probe set, which of the held sets (distinct, not empty) link to it. Shingles are given by hash."""
    every, rank = np.unique(np.concatenate([*held, *probes]), return_inverse=True)
    sizes = [len(s) for s in [*held, *probes]]
    count = np.bincount(rank[: sum(sizes[: len(held)])], minlength=len(every))
    order = np.argsort(-count, kind="stable")
    place = np.empty(len(every), np.int64)
    place[order] = np.arange(len(every))
    ranked = [np.sort(x) for x in np.split(place[rank], np.cumsum(sizes)[:-1])]
    tree = PrefixTree(ranked[: len(held)])
    mask, out = np.zeros(len(every), bool), []
    for own in ranked[len(held) :]:
        mask[own] = True
        out.append(tree.similar(mask, own, percent))
        mask[own] = False
    return out


def _joined(sets: DataFrame, percent: int) -> DataFrame:
    """sets (cell, kind, copies, probe, held, sign, shingles) as kind, root (the least kind it is connected with in its cell) and
    links (documents of other kinds that link to it, probes or held ones on the other side)."""
    schema = pa.schema([("kind", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])

    def solve(rows: pa.Table) -> pa.RecordBatch:
        one = np.unique(rows["sign"].to_numpy(), return_index=True)[1]  # repeated rows of a document may bring its kind again
        rows = rows.take(pa.array(one))
        sign, kind, copies = rows["sign"].to_numpy(), rows["kind"].to_numpy(), rows["copies"].to_numpy()
        probes = rows["probe"].to_numpy()
        probe, held = np.flatnonzero(probes), np.flatnonzero(rows["held"].to_numpy())
        shingles = [np.frombuffer(x.as_py(), np.uint64) for x in rows["shingles"]]
        root, links = kind.copy(), np.zeros(len(kind), np.int64)
        if len(kind) > 1 and len(held):
            for i, hit in zip(probe.tolist(), links_of([shingles[i] for i in probe], [shingles[i] for i in held], percent), strict=True):
                hit = held[hit]
                hit = hit[sign[hit] != sign[i]]
                links[i] += copies[hit].sum()
                links[hit[~probes[hit]]] += copies[i]
                old = np.unique(np.append(root[hit], root[i]))
                if len(old) > 1:
                    root[np.isin(root, old)] = old[0]
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(root), pa.array(links)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks.groups(batches, "cell"):
            yield solve(rows)

    return spread(sets, "cell").sortWithinPartitions("cell").mapInArrow(run, "kind long, root long, links long")


def similar_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """Documents linked by shingle sets with 100 * intersection >= percent * union: doc_id, n_shingles, component_id, n_links.

    A set: the distinct n-word shingles of the text, A-Z lower-cased, words being runs of anything but ASCII white space;
    with fewer words the whole sequence is one shingle; without words it is empty and links to nothing. component_id is
    the least doc_id reachable by links, n_links the number of documents that link to this one.

    Documents with one and the same set are one kind from then on. Kinds that can link are gathered by parts that they
    share (see _near; below PARTS_FROM by rare shingles of their long prefixes, see _candidates), and each group is joined
    exactly in a prefix tree: sets in one global order, commonest shingle first, share their overlaps with a probe along
    the tree, and subtrees go when what is left of both can't reach the threshold. Groups over TREE_SHINGLES are joined
    block against block, so that no task holds more, in rounds, so that no more travels at a time than all sets have.

    Repeated rows are documents like others, also those of one id with unlike texts (sets whose least id is one and the
    same are one in components); a document with a null id links and connects others, but names no component: it gets the least id of its own, null if
    it is linked with null ids alone. An empty table gives no rows; other columns are ignored.
    """
    with scratch(docs.sparkSession) as outlives:
        sets = written(_sets(docs, n, percent))
        # a kind's node is its least id, or, of null ids alone, its signature
        first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tag"))
        kinds = sets.where("size > 0").groupBy("s1", "s2", "size").agg(first.alias("f"), F.count(F.lit(1)).alias("copies"))
        kinds = written(kinds.select("s1", "s2", "size", "copies", F.coalesce("f.doc_id", "s1").alias("kind"), F.col("f.doc_id").alias("doc_id"), F.col("f.tag").alias("tag")))
        if percent >= PARTS_FROM:
            edges = _near(docs, n, percent)
        else:
            edges = _candidates(_prefixes(docs, n, percent, _hot(sets)), kinds.select("s1", "size"), percent)
        groups = components(edges).withColumnRenamed("node", "s1").withColumnRenamed("root", "group")
        members = written(groups.join(kinds, "s1"))
        weight = written(members.groupBy("group").agg(F.sum("size").alias("shingles")).withColumn("parts", F.ceil(F.col("shingles") / TREE_SHINGLES).cast("int")))
        cells = members.join(weight, "group").withColumn("part", F.pmod(F.xxhash64("s1"), F.col("parts")).cast("int"))
        linked = None
        for lo, hi in _rounds(kinds, weight):
            joined = written(_joined(_with_shingles(docs, _roles(cells, lo, hi), n), percent))
            linked = joined if linked is None else linked.unionByName(joined)
        roots = written(components(linked.select(F.col("kind").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "kind"))
        called = roots.join(kinds.where("doc_id IS NOT NULL").select("kind").distinct(), "kind").groupBy("root").agg(F.min("kind").alias("component"))
        roots = roots.join(called, "root", "left").select("kind", F.lit(True).alias("linked"), "component")
        degree = linked.groupBy("kind").agg(F.sum("links").alias("links"))
        found = kinds.select("kind", F.col("doc_id").alias("own"), "copies", "s1", "s2", F.col("size").alias("of")).join(roots, "kind", "left").join(degree, "kind", "left")
        result = (
            sets.select("doc_id", "size", "s1", "s2")
            .join(found, (sets.s1 == found.s1) & (sets.s2 == found.s2) & (sets.size == found.of), "left")
            .select(
                "doc_id",
                F.col("size").alias("n_shingles"),
                F.when(F.col("linked"), F.col("component")).otherwise(F.coalesce("own", "doc_id")).alias("component_id"),
                F.when(F.col("size") == 0, 0).otherwise(F.coalesce(F.col("links"), F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("n_links"),
            )
        )
        return outlives(result)


def _rounds(kinds: DataFrame, weight: DataFrame) -> list[tuple[int, int]]:
    """The distances of blocks (see _roles) that are joined at a time, (first, end): so many that the sets of groups of
    several blocks, which travel twice for each distance, are not more than all sets, or one distance."""
    every = kinds.agg(F.sum("size")).first()[0] or 0
    most, heavy = weight.agg(F.max("parts"), F.sum(F.when(F.col("parts") > 1, F.col("shingles")))).first()
    end, wide = (most or 1) // 2 + 1, max(1, every // (2 * (heavy or 1)))
    return [(lo, min(lo + wide, end)) for lo in range(0, end, wide)]


def _roles(cells: DataFrame, lo: int, hi: int) -> DataFrame:
    """What kinds do in the cells of blocks that are lo to hi - 1 apart: every two blocks of a group (each `part` of `parts`, in
    a ring) meet in one cell, where one probes and the other is held; within one block both roles are one row."""
    names = ["kind", "doc_id", "tag", "copies", "s1"]
    far = F.least(F.lit(hi - 1), F.floor(F.col("parts") / 2)).cast("int")
    cells = cells.where(F.col("parts") >= 2 * lo).select("*", F.explode(F.sequence(F.lit(lo), far)).alias("apart"))
    # blocks that face each other in the ring would meet twice
    other = F.pmod(F.col("part") + F.col("apart"), F.col("parts"))
    probes = cells.where("2 * apart < parts OR part < apart").select(*names, F.xxhash64("group", "part", other).alias("cell"), F.lit(True).alias("probe"), (F.col("apart") == 0).alias("held"))
    other = F.pmod(F.col("part") - F.col("apart"), F.col("parts"))
    held = cells.where("apart > 0 AND (2 * apart < parts OR part >= apart)").select(*names, F.xxhash64("group", other, "part").alias("cell"), F.lit(False).alias("probe"), F.lit(True).alias("held"))
    return probes.unionByName(held)


def _with_shingles(docs: DataFrame, roles: DataFrame, n: int) -> DataFrame:
    """roles with the shingles of their kind, read from one of its documents, as bytes of unsigned longs."""
    names = ["cell", "kind", "copies", "probe", "held"]
    schema = pa.schema([("cell", pa.int64()), ("kind", pa.int64()), ("copies", pa.int64()), ("probe", pa.bool_()), ("held", pa.bool_()), ("sign", pa.int64()), ("shingles", pa.binary())])
    # a kind's cells travel as one list; their number is that of the blocks of its group
    wanted = roles.groupBy("s1").agg(F.first("doc_id").alias("of"), F.first("tag").alias("of_tag"), F.collect_list(F.struct(*names)).alias("roles"))
    texts = tagged(docs.select("doc_id", "text"))
    on = texts.doc_id.eqNullSafe(wanted.of) & (texts.tag == wanted.of_tag)
    joined = bloom.beside(texts, wanted, "xxhash64(doc_id, tag)", "xxhash64(of, of_tag)", on, "inner").select("text", "s1", "roles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = None
        for batch in batches:
            sign, roles_ = batch.column(1).to_numpy(), batch.column(2)
            for i, j, data, offsets in blocks.texts(batch):
                hashes, bounds = shingle_sets(data, offsets, n)
                rows = []
                for k in range(j - i):
                    if sign[i + k] != done:  # repeated rows of a document bring it again
                        done, own = sign[i + k], hashes[bounds[k] : bounds[k + 1]].tobytes()
                        rows += [(*(r[x] for x in names), done, own) for r in roles_[i + k].as_py()]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return joined.mapInArrow(run, "cell long, kind long, copies long, probe boolean, held boolean, sign long, shingles binary")
