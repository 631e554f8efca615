"""Exact n-gram Jaccard join with a token-group matrix.

Method. Documents with the same shingle set form one class; classes are joined. A global token order puts frequent shingles last;
a class's prefix is its first n - ceil(t n) + 1 tokens, and two similar classes share a prefix token. Classes that lean on the same
classes by shared prefix tokens form a group. The token-group matrix holds, for each group, the union of its
members' prefix tokens with their size range. The number of a class's prefix tokens in a group's union bounds the overlap with every
member (prefix overlap + what can lie behind the prefixes); only groups where the bound reaches the needed overlap are opened.
Opened groups are solved exactly on the full sets.

Links are kept as components: what is already connected need not be compared again. Round one compares
each class within its own group; round two opens the other qualifying groups, but only where components differ. So thousands of near
copies cost one comparison each, and no link between different components is lost.

Scale. Full sets are shuffled only for classes in opened groups. A large group is cut into blocks of `block_tokens` tokens;
its leader goes to each block, and members that do not connect to it visit all blocks in round two. Hot tokens are joined by
plain equi-joins (split by adaptive execution) after map-side aggregation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .kernel import Step, grams, text_steps
from .scratch import materialise, passing, small_batches


def shingles(step: Step, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row: k words each; all words if there are fewer; empty without words."""
    w = step.words("space")
    h, of = w.hashes(), w.of.tolist()
    g = grams(h, k)
    for a, b in zip(of, of[1:], strict=False):
        if b - a >= k:
            yield np.unique(g[a : b - k + 1])
        else:
            yield grams(h[a:b], b - a) if b > a else h[:0]


def set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def common_shingles(rows: DataFrame, k: int, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and document counts of about the `keep` most frequent shingles. Only the token order depends on them, no result does.

    A task passes on what three, and one of 3000, of its documents share; it forgets rare shingles when its table grows. The list has
    `keep` entries at most: a histogram of the counts tells from which count on they fit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, held, docs, pending = np.empty(0, np.uint64), np.empty(0, np.int64), [], 0, 0
        for batch in batches:
            for step in text_steps(batch.column(1)):
                held += list(shingles(step, k))
                docs += step.hi - step.lo
                pending += sum(map(len, held[-(step.hi - step.lo) :]))
                if pending > 500_000:
                    key, n = _added(key, n, held)
                    held, pending = [], 0
                    while len(key) > 1_500_000:
                        key, n = key[n > n.min()], n[n > n.min()]
        key, n = _added(key, n, held)
        take = n >= max(3, docs // 3000)
        yield pa.RecordBatch.from_arrays([pa.array(key[take].view(np.int64)), pa.array(n[take])], names=["h", "n"])

    counts = materialise(rows.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "common")
    fit, least = 0, None
    for r in counts.groupBy(F.floor(F.log2("n") * 8).alias("b")).agg(F.count("*").alias("c"), F.min("n").alias("least")).orderBy(F.desc("b")).collect():
        fit += r.c
        if fit > keep:
            break
        least = r.least
    top = counts.where(F.col("n") >= (least if least is not None else 1 << 60)).toArrow()
    h, n = top["h"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _added(key: np.ndarray, n: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    u, inverse = np.unique(np.concatenate([key, *sets]), return_inverse=True)
    return u, np.bincount(inverse, np.concatenate([n, np.ones(len(inverse) - len(n), np.int64)]), len(u)).astype(np.int64)


def _required(n: Column, lo: Column, hi: Column, num: int, den: int) -> Column:
    """Prefix tokens that a class of n tokens must share with one of lo to hi tokens; null if no size there can be similar."""
    ceil = lambda a, b: F.floor((a + (b - 1)) / b)
    low, high = F.greatest(lo, ceil(n * num, den)), F.least(hi, F.floor(n * den / num))
    overlap = lambda m: ceil((n + m) * num, num + den)
    behind_n = overlap(low) - (ceil(n * num, den) - 1)
    behind_m = overlap(high) - (ceil(high * num, den) - 1) - 1  # less one: ceilings make this side not quite monotone
    return F.when(low <= high, F.greatest(F.lit(1), F.least(behind_n, behind_m)))


class _Union:
    def __init__(self, labels: list[int]):
        self.up = list(range(len(labels)))
        first: dict[int, int] = {}
        for i, x in enumerate(labels):
            self.join(i, first.setdefault(x, i))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def linked_pairs(sets: list[np.ndarray], labels: list[int], visitor: np.ndarray | None, num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect all that is similar, by position in `sets`. Without visitors all pairs count, else pairs of a visitor and another.

    labels: equal for what is known to be connected. A row of overlaps is computed for a position only while it may still connect something.
    """
    n, m = len(sets), np.array([len(s) for s in sets])
    tokens, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), m)
    at = np.concatenate([[0], np.cumsum(m)])
    # group bound: a visitor needs so much of the union of the others
    order = np.argsort(ids, kind="stable")
    holders, start = owner[order], np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=len(tokens)))])
    uf, out = _Union(labels), []
    here = np.zeros(len(tokens), bool) if visitor is not None else None
    if here is not None:
        here[ids[~visitor[owner]]] = True

    def row(i: int) -> np.ndarray:
        mine = ids[at[i] : at[i + 1]]
        lengths = start[mine + 1] - start[mine]
        flat = np.repeat(start[mine] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        both = np.bincount(holders[flat], minlength=n)
        good = den * both >= num * (m[i] + m - both)
        if visitor is not None:
            good &= ~visitor
        good[i] = False
        return np.flatnonzero(good)

    if visitor is not None:
        for i in np.flatnonzero(visitor).tolist():
            if den * here[ids[at[i] : at[i + 1]]].sum() >= num * m[i]:
                out += [(i, int(j)) for j in row(i) if uf.join(i, int(j))]
        return out
    done = np.zeros(n, bool)
    leader = 0
    out += [(leader, int(j)) for j in row(leader) if uf.join(leader, int(j))]
    done[leader] = True
    for i in range(n):  # whatever is outside the leader's component is compared with all
        if not done[i] and uf.root(i) != uf.root(leader):
            out += [(i, int(j)) for j in row(i) if uf.join(i, int(j))]
    return out


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100, common: int = 500_000, block_tokens: int = 500_000, bucket_tokens: int = 1_000_000, mark: Column | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id of every row: the smallest doc_id reachable over links den * |A & B| >= num * |A | B|.

    Words are lower-cased (A-Z) runs without ASCII white space; sets hold k-word shingles, or all words as one if there are fewer.
    Null texts and texts without words have no shingles and link with nothing: they get their own id. Rows that repeat
    are copies of each other. A null id never names a component unless all its ids are null. Ids that repeat with different texts can name two components.
    mark: what tells a row besides its id. It is returned, with group: a number of the component that is not shared (null without shingles).
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    with passing(spark) as keep:
        out = _grouped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (F.lit(None) if mark is None else mark).cast("string").alias("mark")), k, num, den, common, block_tokens, bucket_tokens, keep)
    return out if mark is not None else out.select("doc_id", "n_shingles", "component_id")


def _grouped(marked: DataFrame, k: int, num: int, den: int, common: int, block_tokens: int, bucket_tokens: int, keep: list[DataFrame]) -> DataFrame:
    spark, rows = marked.sparkSession, marked.select("doc_id", "text")
    often = spark.sparkContext.broadcast(common_shingles(rows, k, common))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, count = often.value
        for batch in batches:
            ids = batch.column(0)
            for step in text_steps(batch.column(1)):
                keys, sizes, prefixes = [], [], []
                for s in shingles(step, k):
                    n = len(s)
                    sizes.append(n)
                    keys.append(set_key(s) if n else None)
                    if n and len(hot):
                        i = np.searchsorted(hot, s)
                        i[i == len(hot)] = 0
                        rank = np.where(hot[i] == s, count[i], 0)
                        s = s[np.argsort(rank, kind="stable")] if rank.any() else s
                    prefixes.append(s[: n - -(-n * num // den) + 1].view(np.int64) if n else None)
                yield pa.RecordBatch.from_arrays([ids.slice(step.lo, step.hi - step.lo).cast(pa.int64()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), batch.column(2).slice(step.lo, step.hi - step.lo)], names=["doc_id", "key", "n", "prefix", "mark"])

    described = materialise(marked.mapInArrow(describe, "doc_id long, key binary, n long, prefix array<long>, mark string"), "shingles")
    classes = described.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    classes = materialise(classes.select(F.monotonically_increasing_id().alias("rid"), "key", "doc", "n", "prefix"), "classes")
    edges = _links(rows, classes, k, num, den, block_tokens, bucket_tokens)
    parts = connected_components(edges)
    labelled = classes.join(parts, classes.rid == parts.node, "left").select("key", "doc", F.coalesce("component", "rid").alias("label"))
    least = materialise(labelled.groupBy("label").agg(F.min("doc").alias("component_id")), "least")
    by_key = materialise(labelled.join(least, "label").select("key", "component_id", "label"), "by-key")
    keep += [described, by_key]
    joined = described.select("doc_id", "key", "n", "mark").join(by_key, "key", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "mark", F.col("label").alias("group"))


def _links(rows: DataFrame, classes: DataFrame, k: int, num: int, den: int, block_tokens: int, bucket_tokens: int) -> DataFrame:
    """Edges (a, b) between class ids whose components are those of all links."""
    # a smaller class can't be similar to another one: n tokens of n + 1 are already too few
    posting = classes.where((F.col("n") + 1) * num <= F.col("n") * den).select(F.explode("prefix").alias("token"), "rid", "n")
    shared = posting.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    posting = materialise(posting.join(shared, "token"), "postings")
    needed = _required(F.col("n"), F.col("lo"), F.col("hi"), num, den)
    bound = (F.count("*").alias("t"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))

    # groups: each class hangs on the first class of its tokens if half of what a link needs is there; any grouping gives right results
    first = posting.groupBy("token").agg(F.min(F.struct("rid", "n")).alias("x")).select("token", F.col("x.rid").alias("lead"), F.col("x.n").alias("lo"), F.col("x.n").alias("hi"))
    leaning = posting.join(first, "token").where("rid <> lead").groupBy("rid", "n", "lead").agg(*bound).where(2 * F.col("t") >= needed)
    groups = connected_components(leaning.select(F.col("rid").alias("a"), F.col("lead").alias("b")))
    posting = posting.join(groups.select(F.col("node").alias("rid"), F.col("component").alias("g")), "rid", "left").withColumn("g", F.coalesce("g", "rid"))
    posting = materialise(posting.select("token", "rid", "n", "g"), "grouped")
    matrix = materialise(posting.groupBy("token", "g").agg(F.count("*").alias("members"), F.min("n").alias("lo"), F.max("n").alias("hi")), "matrix")

    # round one: within groups
    opened = posting.join(matrix.where("members > 1"), ["token", "g"]).groupBy("rid", "n", "g").agg(*bound).where(F.col("t") >= needed)
    opened = materialise(opened.select("rid", "n", "g"), "opened")
    edges = _solve(rows, classes, _blocks_of_one(opened, block_tokens), k, num, den, bucket_tokens)
    comp = connected_components(edges).select(F.col("node").alias("rid"), "component")

    # round two: what still differs
    labelled = posting.join(comp, "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    mixed = labelled.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("g").alias("g0"), F.max("g").alias("g1")).where("x <> y AND g0 <> g1").select("token")
    mass = materialise(matrix.groupBy("g").agg(F.sum("members").alias("mass")), "mass")  # a table of its own, so a join with a large group can be split
    left = materialise(labelled.join(mixed, "token").join(mass, "g"), "left-over")
    other = left.groupBy("token", F.col("g").alias("h")).agg(F.first("mass").alias("h_mass"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("component").alias("x"), F.max("component").alias("y"))
    onward = (F.col("h") != F.col("g")) & (F.struct("h_mass", "h") > F.struct("mass", "g")) & ~((F.col("x") == F.col("y")) & (F.col("x") == F.col("component")))
    fits = (F.col("hi") * den >= F.col("n") * num) & (F.col("lo") * num <= F.col("n") * den)
    cross = left.join(other, "token").where(onward & fits).groupBy("rid", "n", "component", "h").agg(*bound).where(F.col("t") >= needed).select("rid", "n", "component", F.col("h").alias("g"))
    # members of a group in several blocks that its leader's component doesn't hold
    total = materialise(opened.groupBy("g").agg(F.sum("n").alias("s"), F.min("rid").alias("leader")).where(F.col("s") > block_tokens), "large")
    lead = total.join(comp.withColumnRenamed("rid", "leader"), "leader", "left").select("g", F.coalesce("component", "leader").alias("main"))
    apart = opened.join(lead, "g").join(comp, "rid", "left").withColumn("component", F.coalesce("component", "rid")).where("component <> main").select("rid", "n", "component", "g")
    visits = materialise(cross.unionByName(apart).distinct(), "visits")
    if visits.isEmpty():
        return edges
    hosts = labelled.select("rid", "n", "component", "g").distinct().join(visits.select("g").distinct(), "g", "left_semi").select("rid", "n", "component", "g")
    more = _solve(rows, classes, _blocks_of_two(hosts, visits, block_tokens), k, num, den, bucket_tokens)
    return edges.unionByName(more)


def _blocks_of_one(opened: DataFrame, block_tokens: int) -> DataFrame:
    """g, block, role, rid, label, n: groups of two and more, cut into blocks; the leader of a group that is cut goes to each of its blocks."""
    size = opened.groupBy("g").agg(F.count("*").alias("c"), F.sum("n").alias("s"), F.min("rid").alias("leader")).where("c > 1")
    size = materialise(size.withColumn("blocks", F.ceil(F.col("s") / block_tokens).cast("int")), "sizes")
    placed = opened.join(size, "g")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    one = F.array(F.pmod(F.hash("rid"), F.col("blocks")))
    return placed.select("g", F.explode(F.when((F.col("blocks") > 1) & (F.col("rid") == F.col("leader")), every).otherwise(one)).alias("block"), F.lit(0).alias("role"), "rid", F.col("rid").alias("label"), "n")


def _blocks_of_two(home: DataFrame, visits: DataFrame, block_tokens: int) -> DataFrame:
    """As above for visitors (role 2) and hosts (role 1): each block of visitors meets each block of hosts."""
    h = home.groupBy("g").agg(F.ceil(F.sum("n") / block_tokens).cast("int").alias("hb"))
    v = visits.groupBy("g").agg(F.ceil(F.sum("n") / block_tokens).cast("int").alias("vb"))
    size = materialise(h.join(v, "g"), "sizes")
    block = lambda mine, other, which: F.transform(F.sequence(F.lit(0), other - 1), lambda o: (mine * other + o) if which else (o * F.col("hb") + mine))
    hosts = home.join(size, "g").select("g", F.explode(block(F.pmod(F.hash("rid"), F.col("hb")), F.col("vb"), False)).alias("block"), F.lit(1).alias("role"), "rid", F.col("component").alias("label"), "n")
    guests = visits.join(size, "g").select("g", F.explode(block(F.pmod(F.hash("rid"), F.col("vb")), F.col("hb"), True)).alias("block"), F.lit(2).alias("role"), "rid", F.col("component").alias("label"), "n")
    return hosts.unionByName(guests)


SIEVE_BITS = 26
_SPREAD = 40503


def _sieve(needed: DataFrame) -> np.ndarray:
    """A bit array of fixed size: which (key, doc) may be needed. It is put together on the executors, 64 bits a row."""
    h = F.pmod(F.conv(F.hex(F.substring("key", 1, 6)), 16, 10).cast("long") + F.pmod(F.coalesce("doc", F.lit(-1)), F.lit(1 << 40)) * _SPREAD, F.lit(1 << SIEVE_BITS))
    words = needed.select(h.alias("h")).groupBy(F.shiftright("h", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(h % 64 AS INT))")).alias("m")).toArrow()
    out = np.zeros(1 << (SIEVE_BITS - 6), np.int64)
    out[words["w"].to_numpy()] = words["m"].to_numpy()
    return out


def _passes(words: np.ndarray, key: bytes, doc: int | None) -> bool:
    h = (int.from_bytes(key[:6], "big") + (-1 if doc is None else doc) % (1 << 40) * _SPREAD) % (1 << SIEVE_BITS)
    return bool(int(words[h >> 6]) >> (h & 63) & 1)


def _solve(rows: DataFrame, classes: DataFrame, placed: DataFrame, k: int, num: int, den: int, bucket_tokens: int) -> DataFrame:
    """Edges between class ids, found on the full sets of the placed classes."""
    spark = rows.sparkSession
    placed = materialise(placed, "placed")
    total = placed.agg(F.sum("n")).first()[0]
    if not total:
        return spark.createDataFrame([], "a long, b long")
    buckets = max(1, -(-int(total) // bucket_tokens))
    need = classes.select("rid", "key", "doc").join(placed.select("rid").distinct(), "rid", "left_semi")
    sieve = spark.sparkContext.broadcast(_sieve(need))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sieve.value
        for batch in batches:
            for step in text_steps(batch.column(1)):
                found = []
                for doc, s in zip(batch.column(0).slice(step.lo, step.hi - step.lo).to_pylist(), shingles(step, k), strict=True):
                    if len(s) and _passes(words, key := set_key(s), doc):
                        found.append((doc, key, s.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary()), pa.array([f[2] for f in found], pa.binary())], names=["doc", "key", "set"])

    sets = rows.mapInArrow(fetch, "doc long, key binary, set binary")
    # rows that repeat give the same set again; one is enough
    sets = need.join(sets.withColumnRenamed("key", "key_").withColumnRenamed("doc", "doc_"), (F.col("key") == F.col("key_")) & F.col("doc").eqNullSafe(F.col("doc_"))).groupBy("rid").agg(F.first("set").alias("set"))
    work = placed.join(sets, "rid").select(F.pmod(F.xxhash64("g", "block"), F.lit(buckets)).alias("bucket"), "g", "block", "role", "rid", "label", "set")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["g", "block", "rid"], kind="stable")
        g, block, role, rid, label, data = (pdf[c].to_numpy() for c in ("g", "block", "role", "rid", "label", "set"))
        cut = np.flatnonzero((np.diff(g) != 0) | (np.diff(block) != 0)) + 1
        out: list[tuple[int, int]] = []
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(g)], strict=True):
            if hi - lo < 2:
                continue
            found = [np.frombuffer(x, np.uint64) for x in data[lo:hi]]
            guests = role[lo:hi] == 2
            visitor = guests if (role[lo:hi] > 0).any() else None
            if visitor is not None and (not guests.any() or guests.all()):
                continue
            out += [(int(rid[lo + i]), int(rid[lo + j])) for i, j in linked_pairs(found, label[lo:hi].tolist(), visitor, num, den)]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return materialise(work.groupBy("bucket").applyInPandas(solve, "a long, b long"), "links")
