"""Near-duplicate documents by SetSketch registers.

A document is the set of its word shingles. Register i holds the truncated minimum over the set of
exponentially spaced values, K_i = max(0, floor(1 - log_b(min h_i))) with h_i ~ Exp(RATE): sketches of
two sets merge by max, and equal registers are the likelier the more similar the sets are. The way:

1. Documents with equal sets are one class; the rest works on one representative a class.
2. Registers are cut into bands; representatives that share a band are candidates. A bucket of up
   to ``small_bucket`` members gives its pairs; in a larger one each member meets the bucket's first
   member, in one of a few orders, so that a large group has several first members, not one a band.
3. A candidate's similarity is estimated from all registers jointly, by maximum likelihood; pairs
   whose estimate is five standard errors below the bound go, the rest is confirmed on full sets.
4. Links give components. In large buckets that still hold several components, every member outside
   the bucket's main component meets all members of other components, block by block on both sides,
   as products of matrices of whole sets. Each block hands on a spanning forest of the links it finds, so that what
   is joined is joined whole, and the links handed on grow with the components, not with the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import Scratch, components, free_name, give_back, materialize, slices

#: Base of the registers' scale, and the rate of the exponential values.
BASE, RATE = 1.001, 20.0

#: Orders by which large buckets choose their first member.
ORDERS = 6

#: Words that a worker remembers the hash of.
KNOWN_WORDS = 400_000

_M64 = (1 << 64) - 1


class Shingler:
    """Sets of 64-bit shingle hashes of texts; words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased."""

    def __init__(self, k: int):
        self.k, self.known = k, {}

    def _words(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def hashes(self, text: str | None) -> np.ndarray:
        """The sorted distinct shingle hashes; with fewer than k words the whole sequence is the one shingle."""
        words = (text or "").encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        h, k = self._words(words), min(self.k, len(words))
        out = np.full(len(h) - k + 1, np.uint64(0x9E3779B97F4A7C15 * k & _M64))
        with np.errstate(over="ignore"):
            for i in range(k):
                out = mix(out ^ h[i : len(h) - k + 1 + i])
        out.sort()
        return out[np.concatenate(([True], out[1:] != out[:-1]))]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: multiplications and shifts."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class SetSketch:
    """m registers of 16 bits."""

    def __init__(self, m: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.m = m
        self.mul = (rng.integers(0, 1 << 31, m, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)[:, None]
        self.add = rng.integers(0, 1 << 32, m, dtype=np.uint64).astype(np.uint32)[:, None]

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        """The least of the m uniform hashes over the set, as 32-bit numbers."""
        low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
        out = np.full(self.m, 0xFFFFFFFF, np.uint32)
        with np.errstate(over="ignore"):
            for k in range(0, len(low), 256):
                x = low[k : k + 256][None, :] * self.mul
                x += self.add
                x ^= x >> np.uint32(16)
                x *= np.uint32(0x7FEB352D)
                x ^= x >> np.uint32(15)
                np.minimum(out, x.min(axis=1), out=out)
        return out

    def registers(self, hashes: np.ndarray) -> np.ndarray:
        return scale(self.minima(hashes))


def scale(minima: np.ndarray) -> np.ndarray:
    """Registers from uniform minima: the exponential value of each, on a logarithmic scale, truncated."""
    value = -np.log1p(-(minima.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, 65535).astype(np.uint16)


def estimate(n_u: np.ndarray, n_v: np.ndarray, equal: np.ndarray, more_u: np.ndarray, more_v: np.ndarray) -> np.ndarray:
    """The Jaccard similarity with the largest joint likelihood, given both sizes and how many registers are equal or larger on one side.

    With u, v the shares of the sizes, P(K_u > K_v) = p(u - v J') and so on, where
    p(x) = -log_b(1 - x (b - 1) / b); the rest is P(equal). Newton steps are replaced by a search on a
    grid that is refined three times: the likelihood is concave in J.
    """
    n_u, n_v = n_u.astype(np.float64), n_v.astype(np.float64)
    u, v = n_u / (n_u + n_v), n_v / (n_u + n_v)
    most = np.minimum(u / v, v / u)
    lo, hi = np.zeros_like(u), most.copy()

    def p(x):
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1.0)

    for _ in range(3):
        grid = lo[:, None] + (hi - lo)[:, None] * np.linspace(0, 1, 21)[None, :]
        a, b = p(u[:, None] - v[:, None] * grid), p(v[:, None] - u[:, None] * grid)
        same = np.clip(1 - a - b, 1e-12, 1.0)
        fit = more_u[:, None] * np.log(a) + more_v[:, None] * np.log(b) + equal[:, None] * np.log(same)
        best = fit.argmax(axis=1)
        at = grid[np.arange(len(best)), best]
        step = (hi - lo) / 20
        lo, hi = np.maximum(at - step, 0), np.minimum(at + step, most)
    return at


def estimated(u: np.ndarray, v: np.ndarray, n_u: np.ndarray, n_v: np.ndarray) -> np.ndarray:
    """The estimate for rows of registers u against rows of registers v."""
    more_u, more_v = (u > v).sum(axis=1), (v > u).sum(axis=1)
    return estimate(n_u, n_v, u.shape[1] - more_u - more_v, more_u, more_v)


def _sketches(k: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        shingler, sketch = Shingler(k), SetSketch(m)
        for batch in slices(batches):
            size, key, registers = [], [], []
            for text in batch.column(1):
                h = shingler.hashes(text.as_py())
                size.append(len(h))
                key.append(blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                registers.append(sketch.registers(h).tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(registers, pa.binary())],
                ["doc_id", "text_key", "n_shingles", "set_key", "registers"],
            )
        del shingler
        give_back()

    return run


def _bands(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                small = batch.slice(at, 2000)
                width, keys = 2 * rows, []
                for r in small.column(2).to_pylist():
                    keys += [xxhash.xxh3_64_intdigest(r[j * width : (j + 1) * width], seed=j) - (1 << 63) for j in range(bands)]
                ids = np.repeat(small.column(0).to_numpy(), bands)
                sizes = np.repeat(small.column(1).to_numpy(), bands)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(keys, np.int64)), pa.array(ids), pa.array(sizes)], ["bucket", "id", "n"]
                )

    return run


def _estimate_pairs(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            u, v = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in (4, 5))
            near = estimated(u, v, batch.column(2).to_numpy(), batch.column(3).to_numpy()) >= least
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(near)), batch.column(1).filter(pa.array(near))], ["u", "v"])

    return run


def _confirm(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, last, last_text = Shingler(k), None, None
        for batch in batches:
            us, vs, keep = batch.column(0), batch.column(1), []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a = a.as_py()
                if last_text is None or a != last_text:
                    last, last_text = shingler.hashes(a), a
                other = shingler.hashes(b.as_py())
                both = len(np.intersect1d(last, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(last) + len(other) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([us.filter(keep), vs.filter(keep)], ["u", "v"])

    return run


def _sets(k: int):
    """A text's shingle hashes, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingler.hashes(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], ["id", "hashes"])

    return run


#: Cells of a task's matrix of members by shingles.
CELLS = 1 << 24


class Forest:
    """Union-find over component ids; ``join`` tells whether a link joined two trees."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _outsiders(percent: int):
    """A block of a large bucket against the bucket's outsiders: intersections of all pairs as one matrix product.

    Whole sets are compared, so what passes is a link. Links matter here only for what they join: of
    those found, the ones that join two components go out, at most one less than there are components.
    """

    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        us, vs, forest = [], [], Forest()
        if mine.num_rows and theirs.num_rows:
            get = lambda t: (t["id"].to_numpy(), t["n"].to_numpy(), t["component"].to_numpy(), [np.frombuffer(x, np.uint64) for x in t["hashes"].to_pylist()])
            (a, n_a, c_a, s_a), (b, n_b, c_b, s_b) = get(mine), get(theirs)
            for rows in _parts(s_a):
                words = np.unique(np.concatenate([s_a[k] for k in rows]))
                left = _matrix([s_a[k] for k in rows], words)
                step = max(1, CELLS // max(1, len(words)))
                for at in range(0, len(b), step):
                    own = slice(at, at + step)
                    fits = (c_a[rows][:, None] != c_b[own][None]) & (100 * np.minimum(n_a[rows][:, None], n_b[own][None]) >= percent * np.maximum(n_a[rows][:, None], n_b[own][None]))
                    if fits.any():
                        both = left @ _matrix(s_b[own], words).T
                        i, j = np.nonzero(fits & (100 * both >= percent * (n_a[rows][:, None] + n_b[own][None] - both)))
                        joins = np.stack([c_a[rows][i], c_b[own][j]], axis=1)
                        first = np.unique(joins, axis=0, return_index=True)[1] if len(i) else ()
                        for k in first:
                            if forest.join(int(joins[k, 0]), int(joins[k, 1])):
                                us.append(int(a[rows][i[k]]))
                                vs.append(int(b[own][j[k]]))
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return run


def _parts(sets: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Rows in runs whose matrix has CELLS cells at most, or one row."""
    run, size = [], 0
    for k, s in enumerate(sets):
        if run and (len(run) + 1) * (size + len(s)) > CELLS:
            yield np.array(run)
            run, size = [], 0
        run.append(k)
        size += len(s)
    yield np.array(run)


def _matrix(sets: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(words)), np.float32)
    for k, s in enumerate(sets):
        at = np.minimum(np.searchsorted(words, s), len(words) - 1)
        out[k, at[words[at] == s]] = 1
    return out


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 48, rows: int = 6, small_bucket: int = 12, block: int = 512, out_block: int = 1024) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id, kept: one row per input row.

    Two documents are linked if their sets' Jaccard similarity is at least ``percent`` percent,
    which full sets confirm; component_id is the smallest doc_id reachable over links, kept says
    whether that is the document itself. class_id is the smallest doc_id with an equal set. A null
    or empty text has the empty set and no link. Rows with one doc_id are one document: what one of
    them is linked with, all of them reach. Rows with a null doc_id take part by their text and are no
    component's smallest; their kept is false where the component holds an id, else true. Extra columns are
    ignored. A pair at exactly 0.8 shares no band of 6 registers in 48 with probability 5e-7.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        sketched, classes, found = _grouped(scratch, docs, shingle, percent, bands, rows, small_bucket, block, out_block, one_document_an_id=True)
        classes = classes.select("set_key", "id", F.col("rep.doc_id").alias("class_id"))
        known = classes.join(found.hint("merge"), F.col("id") == F.col("node"), "left")
        known = scratch.put(known.select("set_key", "class_id", F.coalesce("component", "id").alias("component")), "known")
        least = known.groupBy(F.col("component").alias("of")).agg(F.min("class_id").alias("component_id"), F.count("*").alias("n")).where("n > 1").drop("n")
        known = known.join(least.hint("merge"), F.col("component") == F.col("of"), "left")
        known = known.select("set_key", "class_id", F.coalesce("component_id", "class_id").alias("component_id"))
        out = sketched.join(known.hint("merge"), "set_key", "left")
        component = F.coalesce("component_id", "class_id", "doc_id")
        return materialize(
            out.select(
                "doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), component.alias("component_id"),
                F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"),
            ),
            "near",
        )


def one_of_each_group(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 48, rows: int = 6) -> DataFrame:
    """The input's rows and columns less near duplicates: of each component of linked rows one row stays.

    Rows are judged by their texts, so rows that repeat a doc_id with another text stand for themselves. The one
    that stays has the smallest doc_id (null last), then the smallest MD5 of its text; of rows that
    repeat both, the one with the smallest other columns. Rows without words are linked with nothing
    and all stay. Only rows that repeat id and text are aggregated; all others are kept or dropped by an anti-join.
    """
    id_, key = free_name(docs, "row_id"), free_name(docs, "row_key")
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        sketched, classes, found = _grouped(scratch, docs, shingle, percent, bands, rows, one_document_an_id=False)
        known = classes.join(found.hint("merge"), F.col("id") == F.col("node"), "left")
        known = scratch.put(known.select("set_key", "rep", F.coalesce("component", "id").alias("component")), "known")
        best = known.groupBy(F.col("component").alias("of")).agg(F.min("rep").alias("best"), F.count("*").alias("n")).where("n > 1").drop("n")
        known = known.join(best.hint("merge"), F.col("component") == F.col("of"), "left").select("set_key", F.coalesce("best", "rep").alias("best"))
        rows_of = sketched.where("set_key IS NOT NULL").groupBy("set_key", "doc_id", "text_key").agg(F.count("*").alias("copies"))
        rows_of = rows_of.join(known.hint("merge"), "set_key")
        stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key"))
        marked = rows_of.select(F.col("doc_id").alias(id_), F.col("text_key").alias(key), stays.alias("stays"), "copies").where("NOT stays OR copies > 1")
        marked = materialize(marked, "marked")
    text_id, text_key = free_name(docs, "text_id"), free_name(docs, "text_key")
    keyed = docs.withColumns({text_id: F.col("doc_id").cast("long"), text_key: F.unhex(F.md5(F.col("text").cast("string")))})
    same = F.col(text_id).eqNullSafe(F.col(id_)) & (F.col(text_key) == F.col(key))
    out = keyed.join(marked.select(id_, key).hint("merge"), same, "left_anti").select(*docs.columns)
    again = marked.where("stays").select(id_, key)
    if again.isEmpty():
        return out
    whole = F.struct(*docs.columns)
    one = keyed.join(again.hint("merge"), same).groupBy(id_, key).agg(F.min(whole).alias(key + "_row"))
    return out.unionByName(one.select(f"{key}_row.*"))


def _grouped(scratch: Scratch, docs: DataFrame, shingle: int, percent: int, bands: int, rows: int, small_bucket: int = 12, block: int = 512, out_block: int = 1024, one_document_an_id: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, text_key, n_shingles, set_key), classes (set_key, id, rep, n, registers), and components (node, component) of class ids.

    A class is a set of shingles. Its id is a number of its own; rep names a row that holds it, by
    doc_id and the MD5 of its text, so that texts are found again whatever ids repeat. With
    ``one_document_an_id``, classes that share a doc_id are linked as well.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("text_key", F.unhex(F.md5("text")))
    m, put = bands * rows, scratch.put
    # five standard errors of the share of equal registers at the bound
    least = percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / m) ** 0.5
    sketched = put(docs.mapInArrow(_sketches(shingle, m), "doc_id long, text_key binary, n_shingles long, set_key binary, registers binary"), "sketches")
    full = sketched.where("set_key IS NOT NULL")
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key")
    classes = full.groupBy("set_key").agg(F.min(row).alias("rep"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"))
    # written once, so that the numbers stay what they are
    classes = put(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    reps = classes.select("id", "n", "registers")
    banded = reps.mapInArrow(_bands(bands, rows), "bucket long, id long, n long")
    sizes = banded.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    members = put(banded.join(sizes.hint("merge"), "bucket"), "members")

    near = put(_near(_first_pairs(members, small_bucket, percent), reps, least), "candidates")
    links = _confirmed(scratch, near, docs, classes, shingle, percent)
    if one_document_an_id:
        links = links.unionByName(_shared_ids(full, classes))
    links = put(links, "links")
    labels = put(components(links, "near", scratch=scratch), "labels")
    # what large buckets still hold apart
    large = members.where(F.col("members") > small_bucket)
    large = large.join(labels.hint("merge"), large["id"] == labels["node"], "left").select(
        "bucket", "id", "n", F.coalesce("component", "id").alias("component")
    )
    large = put(large, "large")
    parts = large.groupBy("bucket", "component").agg(F.count("*").alias("size"))
    main = parts.groupBy("bucket").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.count("*").alias("parts"), F.sum("size").alias("members"), (F.sum("size") - F.max("size")).alias("apart")).where("parts > 1")
    large = put(large.join(main.hint("merge"), "bucket"), "apart")
    needed = _texts(docs, classes, large.select("id").distinct())
    large = large.join(needed.mapInArrow(_sets(shingle), "id long, hashes binary").hint("merge"), "id")
    # blocks of members by blocks of outsiders: a task holds block + out_block sets, however large the bucket
    cut = lambda salt, count, size: F.pmod(F.xxhash64(F.lit(salt), "id"), F.ceil(F.col(count) / size)).cast("int")
    each = lambda count, size: F.explode(F.sequence(F.lit(0), F.ceil(F.col(count) / size).cast("int") - 1))
    large = put(large.withColumns({"block": cut(0, "members", block), "side": cut(1, "apart", out_block)}), "apart")
    outsiders = large.where("component <> main").withColumn("block", each("members", block))
    large = large.withColumn("side", each("apart", out_block))
    cell = ["bucket", "block", "side"]
    more = large.groupBy(*cell).cogroup(outsiders.groupBy(*cell)).applyInArrow(_outsiders(percent), "u long, v long")
    found = components(links.unionByName(put(more, "links")), "near", scratch=scratch)
    return sketched.drop("registers"), classes, found


def _shared_ids(full: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of rows that share a doc_id: each with the first."""
    twice = full.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("set_key").alias("first"), F.max("set_key").alias("last")).where("first <> last")
    pairs = full.join(twice.hint("merge"), "doc_id").where("set_key <> first").select("set_key", "first").distinct()
    number = lambda key, name: classes.select(F.col("set_key").alias(key), F.col("id").alias(name)).hint("merge")
    return pairs.join(number("set_key", "u"), "set_key").join(number("first", "v"), "first").select("u", "v")


def _first_pairs(members: DataFrame, small: int, percent: int) -> DataFrame:
    """All pairs of small buckets; in large ones each member with the first."""
    fits = f"100 * least(n_u, n_v) >= {percent} * greatest(n_u, n_v)"
    few = members.where(F.col("members") <= small).groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("all"))
    few = few.select(F.posexplode("all").alias("at", "v"), "all").select(
        "v", F.explode(F.slice("all", F.col("at") + 2, F.lit(small))).alias("u")
    )
    few = few.select(F.col("u.id").alias("u"), F.col("v.id").alias("v"), F.col("u.n").alias("n_u"), F.col("v.n").alias("n_v"))
    many = members.where(F.col("members") > small)
    # the bucket's first member comes by a pre-aggregated min; buckets share a few orders, so that a group's buckets mostly agree on it
    place = F.xxhash64(F.pmod("bucket", F.lit(ORDERS)), F.col("id"))
    firsts = many.groupBy("bucket").agg(F.min_by(F.struct("id", "n"), place).alias("f"))
    stars = many.join(firsts.hint("merge"), "bucket").select(
        F.col("id").alias("u"), F.col("f.id").alias("v"), F.col("n").alias("n_u"), F.col("f.n").alias("n_v")
    )
    out = few.unionByName(stars).where("u IS NOT NULL AND v IS NOT NULL AND u <> v").where(fits)
    return out.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _near(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """The pairs whose estimated similarity reaches ``least``."""
    side = lambda c: reps.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("registers").alias(f"r_{c}")).hint("merge")
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    return both.select("u", "v", "n_u", "n_v", "r_u", "r_v").mapInArrow(_estimate_pairs(least), "u long, v long")


def _texts(docs: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the classes in ``ids``: a row's id and the MD5 of its text name it, so equal rows give one text."""
    wanted = classes.join(ids.hint("merge"), "id", "left_semi").select("id", F.col("rep.doc_id").alias("of"), F.col("rep.text_key").alias("of_key"))
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("of_key"))
    return docs.join(wanted.hint("merge"), same).dropDuplicates(["id"]).select("id", "text")


def _confirmed(scratch: Scratch, pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose full sets confirm the link; only the texts that stand in a pair are moved."""
    ids = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    texts = scratch.put(_texts(docs, classes, ids), "texts")
    side = lambda c: texts.select(F.col("id").alias(c), F.col("text").alias(f"t_{c}")).hint("merge")
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    return both.select("v", "u", "t_v", "t_u").mapInArrow(_confirm(k, percent), "u long, v long")
