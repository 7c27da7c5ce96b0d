"""MinHash near-duplicates: bands find candidates, b-bit signatures sift them, full sets confirm.

A text's set holds its distinct two-word shingles as 64-bit hashes. ``HASHES`` affine
permutations give its minima. Full minima, ``ROWS`` to a band, form the band keys; of each
minimum only ``BITS`` low bits (after mixing) are retained, packed as bit planes. Equal bits
of two signatures are counted by popcount, and the chance collisions of unequal minima are
taken out: ``(share - 2**-BITS) / (1 - 2**-BITS)`` estimates the similarity. Candidates
estimated below ``threshold - MARGIN`` are dropped (the margin is five standard errors and
more), and so are sizes that rule a link out; the others are confirmed exactly on their full
sets. Two sets at the threshold 0.8 share no band with a chance of 2e-9.

Groups of copies and near copies:

* texts of equal sets count once (one representative per 128-bit digest of the set);
* buckets of one representative are dropped by an aggregate before any row is joined;
* first the buckets of a few bands report a spanning forest of their candidates, by blocks
  of at most ``BLOCK`` rows that share the bucket's first row, so a large group falls into
  few components with as many pairs as rows;
* then all bands are searched for candidates between different components. In a bucket only
  rows outside its largest component need comparing, with all its rows: both sides are cut
  in blocks, so no task holds more than two blocks, and a settled bucket is not read at all.
  A group reports a spanning forest of its components, which gives clusters: any candidate
  pair that is left lies inside one;
* in a cluster the rows outside its largest component meet all its rows, again by blocks, now
  with their full sets: pairs of different components that the signatures allow are confirmed
  there, and only links that join components leave the task. So texts that are nearly alike
  by the thousand, but not alike enough, cost comparisons and no rows.

No candidate is capped. Components come from alternating star contractions, whose rounds
are written to the shared folder, as are the signatures, buckets and links.

Defined results: null, empty and blank texts have no shingles and are linked with nothing
(``component_id`` is their own ``doc_id``); one word is one shingle; rows that repeat an id
with other texts are told apart, and linked rows of one id share the component; null ids
name a component only if no id can (then ``component_id`` is null and ``kept`` true, else
``kept`` is false for them); ties do not occur (the smallest id names a group, rows sharing
it are all kept); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import blocks, prepare, stored, texts_of
from quarry.llm.simhash import components

SHINGLE = 2
#: Links: 100 * shared >= PERCENT * united.
PERCENT = 80
ROWS, BANDS, BITS = 5, 51, 2
HASHES = 256
MARGIN = 0.15
#: Bands whose forests collapse large groups first.
FIRST_BANDS = 8
#: Rows of a bucket compared by one task at once.
BLOCK = 2048
#: Shingles of the sets that one side of a task holds, about.
SET_ITEMS = 2_000_000
#: Groups up to this size are compared by shifts of the whole batch, all pairs.
SHORT = 12
#: Shingles hashed at once.
STRETCH = 1 << 12
SEED = 7
WORDS = [f"s{i}" for i in range(HASHES * BITS // 64)]
MARKED = ("doc_id long, t1 long, t2 int, n_shingles int, d1 long, d2 long, bands array<long>, "
          + ", ".join(f"{s} long" for s in WORDS))

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], "u8")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[3]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


class _WordHashes(dict):
    """64-bit hash of each word, looked up once per block."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return h


def shingle_set(text: str, hashes: _WordHashes | None = None) -> np.ndarray:
    """Sorted distinct hashes of the two-word shingles, or of the only word."""
    hashes = _WordHashes() if hashes is None else hashes
    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    h = np.fromiter(map(hashes.__getitem__, words), "u8", len(words))
    if len(h) < SHINGLE:
        return _mixed(h * _ODD[0])
    return np.unique(_mixed(h[:-1] * _ODD[1] + _mixed(h[1:] * _ODD[2])))


class Signer:
    """Minima of sets under fixed affine permutations of 32-bit numbers."""

    def __init__(self) -> None:
        rng = np.random.default_rng(SEED)
        self.a = (rng.integers(0, 1 << 31, HASHES, "u4") * np.uint32(2) + np.uint32(1))[:, None]
        self.b = rng.integers(0, 1 << 32, HASHES, "u4")[:, None]
        self.band = _mixed(np.arange(1, BANDS + 1).astype("u8"))

    def minima(self, items: np.ndarray) -> np.ndarray:
        x = (items >> np.uint64(32)).astype("u4")
        low = np.full(HASHES, 0xFFFFFFFF, "u4")
        for at in range(0, len(x), STRETCH):
            low = np.minimum(low, (x[None, at:at + STRETCH] * self.a + self.b).min(axis=1))
        return low

    def bands(self, minima: np.ndarray) -> np.ndarray:
        """A 64-bit key per band, from full minima."""
        rows = minima[:, :ROWS * BANDS].astype("u8").reshape(len(minima), BANDS, ROWS)
        key = np.broadcast_to(self.band, rows.shape[:2])
        for r in range(ROWS):
            key = _mixed(key * _ODD[0] + rows[:, :, r])
        return key.view("i8")

    def packed(self, minima: np.ndarray) -> np.ndarray:
        """BITS planes of HASHES bits: the low bits of the minima, mixed first, since the
        low bits of an affine value depend on the low bits of its argument alone."""
        m = _mixed(minima.astype("u8"))
        planes = [np.packbits((m >> np.uint64(b) & np.uint64(1)).astype("u1"), axis=1, bitorder="little")
                  for b in range(BITS)]
        return np.concatenate(planes, axis=1).view("<u8")


def estimates(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of packed signatures (last axis: words)."""
    plane = HASHES // 64
    differ = one ^ other
    any_bit = differ[..., :plane]
    for b in range(1, BITS):
        any_bit = any_bit | differ[..., b * plane:(b + 1) * plane]
    share = 1 - np.bitwise_count(any_bit).sum(axis=-1, dtype="i4") / HASHES
    chance = 2.0 ** -BITS
    return (share - chance) / (1 - chance)


def signatures(docs: DataFrame) -> DataFrame:
    """Per row: hashes that tell texts apart, set size, set digest, band keys, packed bits."""
    prepare(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        signer = Signer()
        for block in blocks(batches):
            hashes, size, digest, minima = _WordHashes(), [], [], []
            for text in texts_of(block):
                items = shingle_set(text, hashes)
                size.append(len(items))
                digest.append(xxhash.xxh3_128_digest(items.tobytes()))
                minima.append(signer.minima(items))
            minima = np.stack(minima)
            d = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
            keys, bits = signer.bands(minima), signer.packed(minima).view("i8")
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [block.column(0), block.column(2), block.column(3), pa.array(size, pa.int32()), pa.array(d[:, 0].copy()),
                 pa.array(d[:, 1].copy()), lists, *[pa.array(bits[:, i].copy()) for i in range(len(WORDS))]],
                names=["doc_id", "t1", "t2", "n_shingles", "d1", "d2", "bands", *WORDS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t1"),
                       F.hash("text").alias("t2")).mapInArrow(run, MARKED)


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of whole groups: rows equal in the first ``keys`` columns are never cut."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
        if not len(cols[0]):
            continue
        same = np.all([c == c[-1] for c in cols[:keys]], axis=0)
        cut = 0 if same.all() else len(same) - int(np.argmin(same[::-1]))
        if cut:
            yield [c[:cut] for c in cols]
        held = [c[cut:].copy() for c in cols]
    if held is not None and len(held[0]):
        yield held


def _compare(met: DataFrame, keys: list[str], percent: int, out: str,
             long_group: Callable[..., Iterator[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """Candidates (a, b), a < b, named by column ``out``, from the groups of ``met(*keys, role,
    rep, comp, n, *WORDS)``: all pairs of short groups, ``long_group`` of longer ones. Pairs of one
    component, of sizes that rule a link out, or estimated too low, are left out."""
    least = percent / 100 - MARGIN
    met = met.select(*keys, "role", "rep", "comp", "n", *WORDS)
    met = met.repartition(*keys).sortWithinPartitions(*keys, F.desc("role"), "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _whole_groups(batches, len(keys)):
            key, (role, rep, comp, n) = cols[:len(keys)], cols[len(keys):len(keys) + 4]
            bits = np.stack(cols[len(keys) + 4:], axis=1).view("u8")

            def likely(i, j):
                """Candidates among rows i and rows j, by sizes and signatures; broadcasts."""
                small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
                ok = (comp[i] != comp[j]) & (100 * small.astype("i8") >= percent * large.astype("i8"))
                if ok.any():
                    ok[ok] = estimates(bits[np.broadcast_to(i, ok.shape)[ok]], bits[np.broadcast_to(j, ok.shape)[ok]]) >= least
                return ok

            change = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in key], axis=0)])
            group = np.cumsum(change)
            bounds = np.append(np.flatnonzero(change), len(change))
            length = np.diff(bounds)[group - 1]
            name, found = rep if out == "rep" else comp, []
            for step in range(1, SHORT):
                i = np.flatnonzero((group[step:] == group[:-step]) & (length[step:] <= SHORT))
                if not len(i):
                    break
                i = i[likely(i, i + step)]
                found.append((name[i], name[i + step]))
            for start, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if stop - start > SHORT:
                    found.extend((name[i], name[j]) for i, j in long_group(np.arange(start, stop), role, comp, likely))
            a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, "i8")
            b = np.concatenate([x for _, x in found]) if found else np.zeros(0, "i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return met.mapInArrow(run, "a long, b long").distinct()


def _forest(rows: np.ndarray, role, comp, likely) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that span the candidates of a group: search from each unseen row in turn."""
    rest = rows
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            near = np.full(len(rest), -1)
            for at in range(0, len(front), 256):  # bounded comparison matrix
                hit = likely(front[at:at + 256, None], rest[None, :])
                found = hit.any(axis=0) & (near < 0)
                near[found] = front[at + hit.argmax(axis=0)[found]]
            new = near >= 0
            yield near[new], rest[new]
            front, rest = rest[new], rest[~new]


class Roots:
    """Union of few names, by path halving."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def of(self, x: int) -> int:
        up = self.up
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.of(x), self.of(y)
        self.up[x] = y
        return x != y


def _spanned_components(rows: np.ndarray, role: np.ndarray, comp: np.ndarray, likely) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates between the rows of role 1 and those of role 0 that span their components."""
    ones, others = rows[role[rows] == 1], rows[role[rows] == 0]
    roots = Roots()
    for one in ones.tolist():
        j = others[likely(np.array([one]), others)]
        _, first = np.unique(comp[j], return_index=True)
        new = [x for x in j[first].tolist() if roots.join(int(comp[one]), int(comp[x]))]
        if new:
            yield np.full(len(new), one), np.array(new)


def _block_of(column: str, parts) -> F.Column:
    return F.pmod(F.xxhash64(column), parts).cast("int")


def collapsing_pairs(buckets: DataFrame, reps: DataFrame, percent: int, block: int) -> DataFrame:
    """Forest candidates of the first bands' buckets. A bucket's first row stands in all its blocks."""
    rows = buckets.filter(F.col("band") < FIRST_BANDS).withColumn("parts", F.ceil(F.col("size") / block).cast("int"))
    own = rows.select("key", _block_of("rep", F.col("parts")).alias("part"), "rep", "parts", "pivot")
    first = own.filter("parts > 1 AND rep = pivot").select(
        "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "rep")
    met = own.filter("parts = 1 OR rep != pivot").select("key", "part", "rep").unionByName(first)
    met = met.join(reps, "rep").withColumns({"role": F.lit(0), "comp": F.col("rep")})
    return _compare(met, ["key", "part"], percent, "rep", _forest)


def _outside_largest(rows: DataFrame, group: str, minors, members) -> DataFrame:
    """Rows ``(group, rep, comp, n)`` of groups of several components, dealt out so that each row
    outside a group's largest component (role 1) meets each row of it (role 0) in one (group,
    minor, member). ``minors`` and ``members`` give the numbers of blocks from ``m``, ``m_items``
    (rows outside, and their set sizes) and ``s``, ``s_items`` (all rows)."""
    counts = rows.groupBy(group, "comp").agg(F.count(F.lit(1)).alias("of"), F.sum("n").alias("items"))
    top = counts.groupBy(group).agg(F.max(F.struct("of", "comp", "items")).alias("top"), F.count(F.lit(1)).alias("comps"),
                                    F.sum("of").alias("s"), F.sum("items").alias("s_items")).filter("comps > 1")
    top = top.select(group, F.col("top.comp").alias("major"), "s", "s_items", (F.col("s") - F.col("top.of")).alias("m"),
                     (F.col("s_items") - F.col("top.items")).alias("m_items"))
    top = stored(top.select(group, "major", minors.cast("int").alias("minors"), members.cast("int").alias("members")), "mixed")
    rows = rows.join(top, group)
    all_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    member = rows.select(group, "rep", "comp", F.lit(0).alias("role"), all_of("minors").alias("minor"),
                         _block_of("rep", F.col("members")).alias("member"))
    minor = rows.filter("comp != major").select(group, "rep", "comp", F.lit(1).alias("role"),
                                                _block_of("rep", F.col("minors")).alias("minor"), all_of("members").alias("member"))
    return member.unionByName(minor)


def clusters(buckets: DataFrame, reps: DataFrame, comps: DataFrame, percent: int, block: int) -> DataFrame:
    """(comp, cluster): components that candidates connect. Components without any are left out."""
    rows = buckets.select("key", "rep").join(comps, "rep", "left").select(
        "key", "rep", F.coalesce("comp", "rep").alias("comp"), F.lit(1).alias("n"))
    met = _outside_largest(rows, "key", F.ceil(F.col("m") / block), F.ceil(F.col("s") / block)).join(reps, "rep")
    linked = components(_compare(met, ["key", "minor", "member"], percent, "comp", _spanned_components))
    return linked.select(F.col("node").alias("comp"), F.col("root").alias("cluster"))


def links_in_clusters(found: DataFrame, reps: DataFrame, comps: DataFrame, docs: DataFrame, marked: DataFrame,
                      percent: int, block: int) -> DataFrame:
    """(a, b): exact links between different components of each cluster, enough to join all
    components that links join."""
    found = stored(found, "clusters")
    every = reps.select("rep", "n").join(comps, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    # A component that is the smallest of its cluster names it.
    named = found.unionByName(found.select(F.col("cluster").alias("comp"), "cluster")).distinct()
    rows = stored(every.join(named, "comp").select("cluster", "rep", "comp", "n"), "cluster-rows")
    parts = lambda c: F.greatest(F.ceil(F.col(c) / block), F.ceil(F.col(f"{c}_items") / SET_ITEMS))
    met = _outside_largest(rows, "cluster", parts("m"), parts("s"))
    wanted = marked.join(rows.select(F.col("rep").alias("row")), "row").select(
        F.col("row").alias("rep"), F.col("doc_id").alias("id"), "t1", "t2")
    sets = stored(full_sets(docs, wanted), "cluster-sets")
    met = met.join(reps, "rep").join(sets, "rep")
    least = percent / 100 - MARGIN

    def run(table: pa.Table) -> pa.Table:
        role, rep, comp, n = (table.column(c).to_numpy() for c in ("role", "rep", "comp", "n"))
        bits = np.stack([table.column(w).to_numpy() for w in WORDS], axis=1).view("u8")
        lists = table.column("items").combine_chunks()
        items, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy().astype("i8")
        ends = ends - ends[0]
        ones, others = np.flatnonzero(role == 1), np.flatnonzero(role == 0)
        roots, a, b = Roots(), [], []
        for i in ones.tolist():
            own = items[ends[i]:ends[i + 1]]
            j = others[comp[others] != comp[i]]
            j = j[100 * np.minimum(n[j], n[i]).astype("i8") >= percent * np.maximum(n[j], n[i]).astype("i8")]
            guess = estimates(bits[i], bits[j])
            j, guess = j[guess >= least], guess[guess >= least]
            j, size = j[np.argsort(-guess, kind="stable")], 16  # the likely ones first
            while len(j):
                mine = roots.of(int(comp[i]))
                j = j[[roots.of(c) != mine for c in comp[j].tolist()]]  # joined already
                part, j, size = j[:size], j[size:], size * 4
                if not len(part):
                    break
                at = np.concatenate([np.arange(ends[x], ends[x + 1]) for x in part.tolist()])
                place = np.minimum(np.searchsorted(own, items[at]), len(own) - 1)
                hit = np.concatenate([[0], np.cumsum(own[place] == items[at])])
                stops = np.cumsum(ends[part + 1] - ends[part])
                shared = hit[stops] - hit[stops - (ends[part + 1] - ends[part])]
                ok = 100 * shared >= percent * (n[i].astype("i8") + n[part] - shared)
                for x in part[ok].tolist():
                    if roots.join(int(comp[i]), int(comp[x])):
                        a.append(int(rep[i]))
                        b.append(int(rep[x]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return met.groupBy("cluster", "minor", "member").applyInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, items): the full sets of the representatives ``wanted(rep, id, t1, t2)``, from their texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       F.xxhash64("text").alias("t1_"), F.hash("text").alias("t2_"))
    rows = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("t1_") == F.col("t1"))
                     & (F.col("t2_") == F.col("t2"))).select("rep", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            hashes = _WordHashes()
            items = [np.sort(shingle_set(t, hashes).view("i8")) for t in texts_of(block)]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(items, pa.list_(pa.int64()))], names=["rep", "items"])

    return rows.mapInArrow(run, "rep long, items array<long>").dropDuplicates(["rep"])


def confirmed(pairs: DataFrame, docs: DataFrame, marked: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    pairs = stored(pairs, "candidates")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    wanted = marked.join(ends, "row").select(F.col("row").alias("rep"), F.col("doc_id").alias("id"), "t1", "t2")
    sets = stored(full_sets(docs, wanted), "sets")
    met = pairs.join(sets.select(F.col("rep").alias("a"), F.col("items").alias("one")), "a")
    met = met.join(sets.select(F.col("rep").alias("b"), F.col("items").alias("other")), "b")
    met = met.withColumn("shared", F.size(F.array_intersect("one", "other")))
    return met.filter(100 * F.col("shared") >= percent * (F.size("one") + F.size("other") - F.col("shared"))).select("a", "b")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs(doc_id, text)``."""
    if percent / 100 - MARGIN <= 0.5:
        raise ValueError("bands and margin are set for similarities from 0.66 on")
    marked = stored(signatures(docs).withColumn("row", F.monotonically_increasing_id()), "signatures")
    groups = stored(marked.filter("n_shingles > 0").groupBy("d1", "d2").agg(
        F.min("row").alias("rep"), F.min("doc_id").alias("first")), "sets")
    of_rep = marked.join(groups.select(F.col("rep").alias("row")), "row", "left_semi")
    reps = of_rep.select(F.col("row").alias("rep"), F.col("n_shingles").alias("n"), *WORDS)
    lists = of_rep.select(F.col("row").alias("rep"), F.posexplode("bands").alias("band", "key"))
    sizes = lists.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("pivot")).filter("size > 1")
    buckets = stored(lists.join(sizes, "key"), "buckets")
    links = confirmed(collapsing_pairs(buckets, reps, percent, block), docs, marked, percent)
    first = stored(components(links).select(F.col("node").alias("rep"), F.col("root").alias("comp")), "components")
    links = links_in_clusters(clusters(buckets, reps, first, percent, block), reps, first, docs, marked, percent, block)
    to = lambda c: first.select(F.col("rep").alias(c), F.col("comp").alias(f"{c}_"))
    between = links.join(to("a"), "a", "left").join(to("b"), "b", "left").select(
        F.coalesce("a_", "a").alias("a"), F.coalesce("b_", "b").alias("b"))
    second = components(between).select(F.col("node").alias("comp"), "root")
    rooted = groups.join(first, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")).join(second, "comp", "left")
    rooted = stored(rooted.select("d1", "d2", "first", F.coalesce("root", "comp").alias("root")), "roots")
    # Stored, so that a root with very many sets is a plain join that adaptive execution can split.
    names = stored(rooted.groupBy("root").agg(F.min("first").alias("component")), "names")
    named = rooted.join(names, "root").select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), "component")
    rows = marked.select("doc_id", "n_shingles", "d1", "d2").join(
        named, (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")), "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return rows.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), component.alias("component_id"),
                       F.col("doc_id").eqNullSafe(component).alias("kept"))
