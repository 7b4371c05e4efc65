"""Jaccard join of shingle sets by signature trees.

1. Documents become sets of hashed five-word shingles; equal sets form one class.
2. Candidate shards. With a similarity of at least t, two sets of sizes a <= b differ in at most
   (a + b)(1 - t)/(1 + t) shingles. Sizes fall into bands of ratio 1/t, each band cuts the hash
   range into more parts than sets of the band may differ in, so similar sets agree in a whole
   non-empty part. A set offers a key for each of its parts, in its own band and the next. The
   least set that offers a key leads it, and all sets that offer it belong to the leader's shard.
   So every similar pair shares a shard. (Sets with so many empty parts that the count does
   not hold share one more key.)
3. In a shard the sets, sorted by size, are the leaves of a tree whose nodes hold the OR of the
   bitmaps below and their range of sizes. A traversal of pairs of nodes drops a pair when the
   sizes are too far apart, when the largest overlap the bitmaps allow is too small, or when
   all sets below are connected already. What remains is compared exactly.
4. Shards of up to one block are first traversed with the sets' bitmaps alone: a set without
   any possible partner leaves the shard, most for good. Whole sets travel for the others only.
5. A first round puts each set into one shard, the one with its least leader, which connects
   almost all near copies. The second round visits the shards that still hold several
   components, so that no link between components is lost. Large shards are dealt in blocks: the
   sets of the shard's largest component in blocks against all others, which suffices as sets
   of one component need no comparison.

Null text or text without words has an empty set and is linked with nothing. Copies and
repeated rows share a class. Null ids take part in links but are never a component's
smallest id. An empty table gives an empty result; further columns are ignored.
"""

import numpy as np
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F

from cashtide import session
from cashtide.llm.common import (
    Memo,
    documents,
    in_arrow,
    row_key,
    row_order,
    utf8,
    worker_state,
)
from cashtide.llm.components import components

WORDS = 5
#: Similarity of at least NUMBER / OF.
NUMBER, OF = 80, 100
#: Keys compared in one task, and sets and shingles of one tree.
SLICE_KEYS = 1_000_000
BLOCK_SETS = 2048
BLOCK_SHINGLES = 4_000_000
#: Sets below the lowest nodes of a tree, and nodes below each other node.
LEAF, FAN = 16, 8
REMEMBERED = 250_000

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(x):
    """A one-to-one scrambling of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def shingles(data, words=WORDS):
    """Sorted distinct 64-bit hashes of the word sequences of a text."""
    found = (data or b"").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    number = worker_state("word_hash", lambda: Memo(xxhash.xxh3_64_intdigest, REMEMBERED))
    hashes = np.array([number[w] for w in found], np.uint64)
    size = min(words, len(found))
    total = np.zeros(len(found) - size + 1, np.uint64)
    for i in range(size):
        total = total * _MULTIPLIER + hashes[i : len(found) - size + 1 + i]
    return np.unique(mixed(total + np.uint64(size)))


def digest(tokens):
    return xxhash.xxh3_128_digest(tokens.tobytes())


def bitmap(tokens, bits):
    """A bit for each token's place in the hash range; ``bits`` is a power of two."""
    flags = np.zeros(bits, bool)
    flags[tokens >> np.uint64(65 - bits.bit_length())] = True
    return np.packbits(flags)


def bits_for(n):
    return 1 << max(6, (4 * n - 1).bit_length())


class Bands:
    """Size bands and the parts of each."""

    def __init__(self, number=NUMBER, of=OF, most=1 << 40):
        self.number, self.of = number, of
        limits = [1]
        while limits[-1] < most:
            limits.append(max(limits[-1] + 1, -(-limits[-1] * of // number)))
        self.limits = np.array(limits, np.int64)

    def differ(self, sizes):
        """The most shingles that two similar sets differ in, given the sum of their sizes."""
        return sizes * (self.of - self.number) // (self.of + self.number)

    def of_size(self, n):
        return int(np.searchsorted(self.limits, n, "right")) - 1

    def parts(self, band):
        top = int(self.limits[band + 1]) - 1
        return max(64, (self.differ(2 * top) + 1) * 28 // 25)

    def keys(self, tokens, band):
        """A key for each non-empty part of sorted ``tokens`` in the scheme of ``band``."""
        parts = self.parts(band)
        place = ((tokens >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        sums = np.add.reduceat(mixed(tokens), starts)
        keys = mixed(sums + place[starts] * _MULTIPLIER)
        partner = min(int(self.limits[band + 1]) - 1, len(tokens) * self.of // self.number)
        if len(starts) <= self.differ(len(tokens) + partner):
            keys = np.append(keys, mixed(np.array([parts], np.uint64)))
        return keys


# --- 1. classes of equal sets ---------------------------------------------------------------


def _digest_task(words, bands):
    def task(batches):
        for batch in batches:
            sets = [shingles(data, words) for data in utf8(batch.column("text"))]
            yield {
                "doc_id": batch.column("doc_id"),
                "text_hash": batch.column("text_hash"),
                "digest": [digest(s) for s in sets],
                "n": [len(s) for s in sets],
                "band": [bands.of_size(len(s)) for s in sets],
                "map": [bitmap(s, bits_for(len(s))).tobytes() for s in sets],
            }

    return task


def hashed(docs):
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


def set_digests(docs, words, bands):
    return in_arrow(
        hashed(docs),
        _digest_task(words, bands),
        "doc_id bigint, text_hash bigint, digest binary, n bigint, band int, map binary",
    )


# --- 2. shards ------------------------------------------------------------------------------


def _key_task(words, bands, slices):
    """Packed keys: a row for each band and slice with the sets (first 8 bytes of their digest),
    their numbers of keys, and the keys without the slice's bits in 5 bytes each."""

    def packed(held):
        for (band, piece), rows in held.items():
            names, counts, keys = zip(*rows)
            yield band, piece, b"".join(names), np.array(counts, "<u4").tobytes(), b"".join(keys)

    def columns(held):
        rows = list(packed(held))
        held.clear()
        names = ("band", "slice", "sets", "counts", "keys")
        return {name: [r[i] for r in rows] for i, name in enumerate(names)}

    def task(batches):
        held, size, seen = {}, 0, set()
        for batch in batches:
            for data in utf8(batch.column("text")):
                tokens = shingles(data, words)
                name = digest(tokens)
                if not len(tokens) or name in seen:
                    continue
                seen.add(name)
                own = bands.of_size(len(tokens))
                for band in (own, own + 1):
                    keys = np.sort(bands.keys(tokens, band))
                    bits = slices.get(band, 0)
                    piece = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else keys * 0
                    edges = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1], [True])))
                    raw = (keys << np.uint64(bits)).astype(">u8").view(np.uint8).reshape(-1, 8)
                    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                        row = (name[:8], b - a, raw[a:b, :5].tobytes())
                        held.setdefault((band, int(piece[a])), []).append(row)
                    size += len(keys)
            if size > 1_000_000:
                yield columns(held)
                size = 0
        if held:
            yield columns(held)

    return task


def _lead(table):
    """For the keys of one slice: (set, leader) for each key that several sets offer."""
    import pyarrow as pa

    names, counts, keys = [], [], []
    for sets, numbers, raw in zip(*(table.column(c).to_pylist() for c in ("sets", "counts", "keys"))):
        number = np.frombuffer(numbers, "<u4")
        names.append(np.repeat(np.frombuffer(sets, "<i8"), number))
        wide = np.zeros((int(number.sum()), 8), np.uint8)
        wide[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
        keys.append(wide.view(">u8").ravel().astype(np.uint64))
    names, keys = np.concatenate(names), np.concatenate(keys)
    order = np.lexsort((names, keys))
    names, keys = names[order], keys[order]
    new_key = np.concatenate(([True], keys[1:] != keys[:-1]))
    new = new_key | np.concatenate(([True], names[1:] != names[:-1]))
    names, new_key = names[new], new_key[new]
    starts = np.flatnonzero(new_key)
    sizes = np.diff(np.append(starts, len(names)))
    several = np.repeat(sizes > 1, sizes)
    pairs = np.stack((names, np.repeat(names[starts], sizes)), axis=1)[several]
    pairs = np.unique(pairs, axis=0) if len(pairs) else pairs
    return pa.table({"name": pairs[:, 0], "leader": pairs[:, 1]})


def shard_members(docs, classes, words, bands):
    """Distinct (name, leader) of all sets that share a key with another set."""
    per_band = classes.filter("n > 0").groupBy("band").agg(F.sum("n").alias("n")).collect()
    held = {r["band"]: r["n"] for r in per_band}  # one row per band
    slices = {}
    for band in {*held, *(b + 1 for b in held)}:
        keys = (held.get(band, 0) + held.get(band - 1, 0)) // 2
        slices[band] = max(0, (-(-keys // SLICE_KEYS) - 1).bit_length())
    packed = in_arrow(
        hashed(docs),
        _key_task(words, bands, slices),
        "band int, slice bigint, sets binary, counts binary, keys binary",
    )
    pairs = packed.groupBy("band", "slice").applyInArrow(_lead, "name bigint, leader bigint")
    return pairs.distinct()


# --- 3. trees -------------------------------------------------------------------------------


class Tree:
    """A signature tree over sets in order of size."""

    def __init__(self, sizes, maps, labels, number=NUMBER, of=OF):
        """``maps``: bitmaps as rows of bytes; ``labels``: numbers of the sets' components."""
        self.number, self.of = number, of
        self.label = np.array(labels)
        self.size = np.array(sizes)
        maps = np.ascontiguousarray(maps).view(np.uint64)
        spare = self.size - np.bitwise_count(maps).sum(axis=1)
        self.maps, self.spare = maps, spare
        # Levels from the leaves' blocks up to one root: (bitmaps, least, largest, spare, step).
        step, self.levels = LEAF, []
        level = (maps, self.size, self.size, spare)
        group = LEAF
        while True:
            at = np.arange(0, len(level[0]), group)
            level = (
                np.bitwise_or.reduceat(level[0], at, axis=0),
                np.minimum.reduceat(level[1], at),
                np.maximum.reduceat(level[2], at),
                np.maximum.reduceat(level[3], at),
            )
            self.levels.append((*level, step))
            if len(at) == 1:
                break
            group = FAN
            step *= FAN

    def needed(self, sizes):
        """The least overlap of similar sets, given the sum of their sizes."""
        return -(-sizes * self.number // (self.number + self.of))

    def may_match(self, level, a, b):
        maps, least, most, spare, step = level
        if most[a] * self.of < least[b] * self.number or most[b] * self.of < least[a] * self.number:
            return False
        common = int(np.bitwise_count(maps[a] & maps[b]).sum())
        if common + min(spare[a], spare[b]) < self.needed(least[a] + least[b]):
            return False
        first = self.label[a * step]
        same = self.label[a * step : (a + 1) * step] == first
        return not (same.all() and (self.label[b * step : (b + 1) * step] == first).all())

    def pairs(self):
        """Pairs of places that may be similar and have different labels when they come."""
        stack = [(len(self.levels) - 1, 0, 0)]
        while stack:
            depth, a, b = stack.pop()
            if not self.may_match(self.levels[depth], a, b):
                continue
            if depth == 0:
                yield from self._leaves(a * LEAF, b * LEAF)
                continue
            n = len(self.levels[depth - 1][0])
            left = range(a * FAN, min(n, (a + 1) * FAN))
            right = range(b * FAN, min(n, (b + 1) * FAN))
            below = [(depth - 1, x, y) for x in left for y in right if x <= y]
            # Neighbours come first from the stack: what they connect spares the others.
            stack += sorted(below, key=lambda p: p[1] - p[2])

    def _leaves(self, a, b):
        x, y = slice(a, a + LEAF), slice(b, b + LEAF)
        common = np.bitwise_count(self.maps[x][:, None] & self.maps[y][None]).sum(axis=2)
        bound = common + np.minimum(self.spare[x][:, None], self.spare[y][None])
        sizes = self.size[x][:, None] + self.size[y][None]
        fits = (bound >= self.needed(sizes)) & (self.label[x][:, None] != self.label[y][None])
        for i, j in np.argwhere(fits).tolist():
            i, j = i + a, j + b
            if i < j and self.label[i] != self.label[j]:
                yield i, j

    def connect(self, sets):
        """Labels after all similar sets are connected; the smaller label stays."""
        for i, j in self.pairs():
            if self._similar(sets[i], sets[j]):
                low, high = sorted((self.label[i], self.label[j]))
                self.label[self.label == high] = low
        return self.label

    def _similar(self, x, y):
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        both = int((y[at] == x).sum())
        return self.of * both >= self.number * (len(x) + len(y) - both)


def same_width(maps):
    """Bitmaps of several widths as rows of the least width, neighbouring bits folded."""
    width = min(map(len, maps))
    rows = np.empty((len(maps), width), np.uint8)
    for row, data in zip(rows, maps):
        flags = np.frombuffer(data, np.uint8)
        if len(data) > width:
            bits = np.unpackbits(flags).reshape(width * 8, -1)
            flags = np.packbits(bits.any(axis=1))
        row[:] = flags
    return rows


def _grouped(batches, columns):
    """The rows of each group, of batches sorted by ``group``; ``None`` after each batch."""

    def values(batch, name):
        column = batch.column(name)
        return column.to_pylist() if name in ("group", "n") else utf8(column)

    group, rows = None, []
    for batch in batches:
        for key, *row in zip(*(values(batch, c) for c in ("group", *columns))):
            if key != group:
                if rows:
                    yield group, rows
                group, rows = key, []
            rows.append(row)
        yield None, None
    if rows:
        yield group, rows


def _partner_task(number, of):
    def partners(rows):
        if len(rows) < 2:
            return []
        maps = same_width([r[2] for r in rows])
        tree = Tree([r[1] for r in rows], maps, range(len(rows)), number, of)
        return sorted({at for pair in tree.pairs() for at in pair})

    def task(batches):
        names, leaders = [], []
        for group, rows in _grouped(batches, ("digest", "n", "map")):
            if rows is None:
                yield {"digest": names, "leader": leaders}
                names, leaders = [], []
                continue
            rows = sorted({r[0]: r for r in rows}.values(), key=lambda r: (r[1], r[0]))
            found = partners(rows)
            names += [rows[at][0] for at in found]
            leaders += [group] * len(found)
        yield {"digest": names, "leader": leaders}

    return task


def with_partners(members, classes, number=NUMBER, of=OF):
    """Members that their bitmaps do not rule out; shards of more than a block stay whole."""
    counted = members.groupBy("leader").agg(F.count(F.lit(1)).alias("sets"))
    known = members.join(counted, "leader")
    small = known.filter(F.col("sets") <= BLOCK_SETS).drop("sets")
    maps = classes.select(name_of(F.col("digest")).alias("name"), "digest", "n", "map")
    rows = small.join(maps, "name").select(F.col("leader").alias("group"), "digest", "n", "map")
    dealt = rows.repartition("group").sortWithinPartitions("group")
    found = in_arrow(dealt, _partner_task(number, of), "digest binary, leader bigint")
    kept = found.select(name_of(F.col("digest")).alias("name"), "leader").distinct()
    large = known.filter(F.col("sets") > BLOCK_SETS).select("name", "leader")
    return session.cut(kept.unionByName(large), "partners")


def _tree_task(number, of):
    def shard(rows):
        """Links of one group between labels, each to the smallest it is connected with; rows
        (digest, label, tokens), repeated ones counted once."""
        rows = sorted({r[0]: r for r in rows}.values(), key=lambda r: (len(r[2]), r[0]))
        names = sorted({r[1] for r in rows})
        if len(names) < 2:
            return []
        number_of = {name: i for i, name in enumerate(names)}
        labels = [number_of[r[1]] for r in rows]
        sets = [np.frombuffer(r[2], "<u8") for r in rows]
        bits = bits_for(len(sets[-1]))
        maps = np.stack([bitmap(s, bits) for s in sets])
        tree = Tree([len(s) for s in sets], maps, labels, number, of)
        found = set(zip(tree.connect(sets).tolist(), labels))
        return [(names[a], names[b]) for a, b in found if a != b]

    def task(batches):
        found = []
        for _, rows in _grouped(batches, ("digest", "label", "tokens")):
            if rows is None:
                yield {"a": [f[0] for f in found], "b": [f[1] for f in found]}
                found = []
            else:
                found += shard(rows)
        yield {"a": [f[0] for f in found], "b": [f[1] for f in found]}

    return task


def tree_links(assigned, sets, number=NUMBER, of=OF):
    """Links of all groups. ``assigned``: (group, name, label) with names of ``sets``."""
    rows = assigned.join(sets, "name").select(
        "group", "digest", F.coalesce("label", "digest").alias("label"), "tokens"
    )
    dealt = rows.repartition("group").sortWithinPartitions("group")
    return session.cut(in_arrow(dealt, _tree_task(number, of), "a binary, b binary"), "links")


# --- 5. rounds ------------------------------------------------------------------------------


def _set_task(words):
    def task(batches):
        for batch in batches:
            rows = []
            for data, wanted in zip(utf8(batch.column("text")), utf8(batch.column("digest"))):
                tokens = shingles(data, words)
                if digest(tokens) == wanted:
                    rows.append((wanted, tokens))
            yield {
                "digest": [r[0] for r in rows],
                "name": [int(np.frombuffer(r[0][:8], "<i8")[0]) for r in rows],
                "n": [len(r[1]) for r in rows],
                "tokens": [r[1].astype("<u8").tobytes() for r in rows],
            }

    return task


def name_of(column):
    """The first 8 bytes of a digest as a little-endian number, as the tasks name sets."""
    swapped = F.concat(*[F.substring(column, 8 - i, 1) for i in range(8)])
    return F.conv(F.hex(swapped), 16, -10).cast("bigint")


def candidate_sets(docs, classes, members, words):
    """The sets of all shard members, read from one copy of each."""
    wanted = classes.withColumn("name", name_of(F.col("digest"))).join(
        members.select("name").distinct(), "name", "left_semi"
    )
    wanted = wanted.select(
        "digest", F.col("copy.text_hash").alias("h"), F.col("copy.doc_id").alias("d")
    )
    same = (F.col("text_hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("d"))
    texts = hashed(docs).join(wanted.hint("shuffle_hash"), same).select("text", "digest")
    sets = in_arrow(texts, _set_task(words), "digest binary, name bigint, n bigint, tokens binary")
    return session.cut(sets, "sets")


def blocks():
    """Blocks for a number of sets and shingles."""
    return F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES), F.lit(1)
    ).cast("int")


def first_round(members, sizes):
    """Each set in the shard of its least leader, large shards in blocks with the leader in each."""
    one = members.groupBy("name").agg(F.min("leader").alias("leader"))
    one = one.unionByName(one.select(F.col("leader").alias("name"), "leader")).distinct()
    counted = one.join(sizes, "name").groupBy("leader").agg(blocks().alias("blocks"))
    block = F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    return (
        one.join(counted, "leader")
        .withColumn("block", F.explode(F.when(F.col("name") == F.col("leader"), every).otherwise(F.array(block))))
        .select(
            F.concat_ws(":", F.col("leader").cast("string"), F.col("block").cast("string")).alias("group"),
            "name",
            F.lit(None).cast("binary").alias("label"),
        )
    )


def second_round(members, sizes, labels):
    """Shards that hold several components: their largest one in blocks against the others."""
    leaders = members.select(F.col("leader").alias("name"), "leader")
    every = members.unionByName(leaders).distinct()
    held = every.join(labels, "name")
    mixed_shards = (
        held.groupBy("leader")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"))
        .filter("low <> high")
        .select("leader")
    )
    held = session.cut(
        held.join(mixed_shards, "leader", "left_semi").join(sizes, "name"), "mixed-shards"
    )
    counted = held.groupBy("leader", "label").agg(F.count(F.lit(1)).alias("sets"))
    largest = counted.groupBy("leader").agg(F.max_by("label", F.struct("sets", "label")).alias("main"))
    parted = held.join(largest, "leader").withColumn("in_main", F.col("label") == F.col("main"))
    per = parted.groupBy("leader", "in_main").agg(blocks().alias("blocks"))
    per = per.groupBy("leader").agg(
        F.max(F.when(F.col("in_main"), F.col("blocks"))).alias("mains"),
        F.max(F.when(~F.col("in_main"), F.col("blocks"))).alias("others"),
    )
    parted = parted.join(per, "leader")

    def block(n):
        return F.pmod(F.xxhash64("name"), n).cast("int")

    def upto(n):
        return F.sequence(F.lit(0), n - 1)

    own = block(F.col("others"))
    cells = F.when(
        F.col("in_main"),
        F.transform(upto(F.col("others")), lambda o: F.struct(block(F.col("mains")).alias("m"), o.alias("o"))),
    ).otherwise(
        F.concat(
            F.transform(upto(F.col("mains")), lambda m: F.struct(m.alias("m"), own.alias("o"))),
            # Blocks of the others against each other; one block meets itself above.
            F.when(
                F.col("others") > 1,
                F.transform(
                    upto(F.col("others")),
                    lambda o: F.struct(
                        (-1 - F.least(o, own)).alias("m"), F.greatest(o, own).alias("o")
                    ),
                ),
            ).otherwise(F.array().cast("array<struct<m:int,o:int>>")),
        )
    )
    text = [F.col(c).cast("string") for c in ("leader", "cell.m", "cell.o")]
    return parted.withColumn("cell", F.explode(cells)).select(
        F.concat_ws(":", *text).alias("group"), "name", "label"
    )


def similarity_components(docs, words=WORDS, number=NUMBER, of=OF):
    """Per document: doc_id, text_hash, size of its set, the smallest doc_id of its component
    (``component_id``), and whether it is the component's first (``first``): the one with the
    smallest id, then text hash, nulls last. Documents with empty sets are all first."""
    bands = Bands(number, of)
    digests = session.cut(set_digests(docs, words, bands), "set-digests")
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash")
    classes = session.cut(
        digests.groupBy("digest").agg(
            F.first("n").alias("n"),
            F.first("band").alias("band"),
            F.first("map").alias("map"),
            F.min(place).alias("copy"),
        ),
        "set-classes",
    )
    members = session.cut(shard_members(docs, classes, words, bands), "members")
    members = with_partners(members, classes, number, of)
    sets = candidate_sets(docs, classes, members, words)
    sizes = sets.select("name", "n").distinct()
    links = tree_links(first_round(members, sizes), sets, number, of)
    rooted = components(links)
    labels = sets.select("name", "digest").distinct().join(
        rooted.withColumnRenamed("node", "digest"), "digest", "left"
    )
    labels = session.cut(
        labels.select("name", "digest", F.coalesce("root", "digest").alias("label")), "set-labels"
    )
    rest = tree_links(
        second_round(members, sizes, labels.select("name", "label")), sets, number, of
    )
    # Links of the second round join components of the first, by their roots.
    final = components(rest).withColumnRenamed("node", "label")
    roots = labels.join(final, "label", "left").select(
        F.col("digest").alias("node"), F.coalesce("root", "label").alias("root")
    )
    named = classes.select("digest", "copy").join(
        roots.distinct(), F.col("digest") == F.col("node"), "left"
    )
    named = named.select("digest", "copy", F.coalesce("root", "digest").alias("root"))
    least = named.groupBy("root").agg(F.min("copy").alias("least"))
    of_class = session.cut(named.join(least, "root").select("digest", "least"), "of-class")
    empty = F.col("n") == 0
    return digests.join(of_class, "digest", "left").select(
        "doc_id",
        "text_hash",
        F.col("n").alias("n_shingles"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"),
        (empty | (place == F.col("least"))).alias("first"),
    )


def keep_one(docs, **more):
    """The first document of each component, of its repeated rows the least by all columns."""
    kept = similarity_components(docs, **more).filter("first")
    keys = kept.select(row_key("text_hash").alias("kept_key")).distinct()
    keyed = docs.select(F.struct("*").alias("row"), row_key(F.xxhash64("text")).alias("key"))
    own = Window.partitionBy("key").orderBy(*row_order(docs.schema))
    return (
        keyed.join(keys.hint("shuffle_hash"), F.col("key") == F.col("kept_key"), "left_semi")
        .withColumn("copy", F.row_number().over(own))
        .filter("copy = 1")
        .select("row.*")
    )


def op4_jaccard_components(spark, sf_dir):
    found = similarity_components(documents(spark, sf_dir))
    return found.select("doc_id", "n_shingles", "component_id")
